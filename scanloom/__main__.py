"""The command line: ``scanloom scan/p007.pgm fix-bg 5 bin auto w out%03d.pgm``, or ``python -m scanloom``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from scanloom.plans.pipeline import HELP, PipelineError, run


def main(words: list[str] | None = None) -> int:
    """Run the words of a pipeline in the session at hand; 0, or 1 and a message on standard error."""
    words = sys.argv[1:] if words is None else words
    if not words or words[0] in ("-h", "--help"):
        print(HELP)
        return 0
    spark = SparkSession.builder.appName("scanloom").getOrCreate()
    try:
        machine = run(spark, words, sys.stdin.buffer.read() if "-" in words[:1] else b"")
    except PipelineError as error:
        print(f"scanloom: {error}", file=sys.stderr)
        return 1
    for item in machine.output:
        if isinstance(item, bytes):
            sys.stdout.buffer.write(item)
        else:
            print(item if isinstance(item, str) else "\n".join(map(str, item)))
    sys.stdout.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())
