"""The stack language: a list of words as a lazy pipeline of image sets.

``run(spark, "scan/p007.pgm fix-bg 5 bin auto w out%03d.pgm".split())``. Nothing runs
until a ``w``, ``stat`` or the caller reads a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import to_px
from scanloom.operators import geometry, joins, pointwise, scan, solvers, stats
from scanloom.sources import create, pnm

#: Commands that may be written longer.
PREFIXES = ("chan", "con", "div", "histo", "lapl", "pag", "pois", "rect", "rot", "stat")
LIMIT = 256

HELP = """images   NAME.EXT - (stdin)  image D W H  clone D W H  copy  w NAME|-
stack    pop  unpop  swap  quit
planes   chan N  alpha  opaque  fill A R G B  rect V X0 Y0 X1 Y1
values   bg D  fix-bg D  con B W|auto  bin T|auto  div  darker F...  diff  dither STEP  grid STEP
shape    cropx L R  cropy T B  double K  half  rot ANGLE  skew ANGLE  deskew  splitx N  splity N
solvers  lapl  pois TOL  s-paste
figures  histo N  stat  test N
pages    pag N  ex H  odd  even  all"""


class PipelineError(ValueError):
    """A command that cannot be run."""


def token_kind(token: str | None) -> str:
    """d decimal, i integer, f file name, - none, w word, 0 missing."""
    if token is None:
        return "0"
    if token == "-":
        return "-"
    if re.fullmatch(r"[+-]?[0-9]+", token):
        return "i"
    if re.fullmatch(r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+)", token):
        return "d"
    return "f" if "." in token else "w"


def number(token: str) -> float | int:
    """A whole or decimal number; whole ones stay whole, except -0."""
    kind = token_kind(token)
    if kind == "i":
        return -0.0 if token == "-0" else int(token)
    if kind == "d":
        return float(token)
    raise PipelineError(f"{token}: a number was expected")


@dataclass
class Machine:
    """The stack, what was popped from it, and what the session keeps."""

    spark: SparkSession
    stdin: bytes = b""
    stack: list[DataFrame] = field(default_factory=list)
    popped: list[DataFrame] = field(default_factory=list)
    output: list[object] = field(default_factory=list)
    ex: float = 25.0
    parity: str | None = None
    heights: dict[int, tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def top(self, depth: int = 1) -> DataFrame:
        """The item at a depth from the top, from 1."""
        if len(self.stack) < depth:
            raise PipelineError("Missing image")
        return self.stack[-depth]

    def push(self, item: DataFrame) -> None:
        """Put an item on top."""
        if len(self.stack) >= LIMIT:
            raise PipelineError("Stack overflow")
        self.stack.append(item)

    def pop(self) -> DataFrame:
        """Take the top item; ``unpop`` brings it back."""
        self.top()
        self.popped.append(self.stack.pop())
        return self.popped[-1]

    def unpop(self) -> None:
        """Bring back what was popped or replaced last."""
        if not self.popped:
            raise PipelineError("Nothing was popped")
        self.push(self.popped.pop())

    def swap(self) -> None:
        """Exchange the two top items."""
        self.top(2)
        self.stack[-2:] = self.stack[:-3:-1]

    def ex_of(self, item: DataFrame) -> DataFrame:
        """img and ex, the height of its letters, of an item's images: what was set for them, else the session's."""
        known = self.heights.get(id(item))
        return known[1] if known else item.select("img").distinct().withColumn("ex", F.lit(float(self.ex)))

    def inherit(self, new: DataFrame, old: DataFrame, factor: float = 1.0) -> DataFrame:
        """An item made of another keeps its ex, times a factor."""
        known = self.heights.get(id(old))
        if known or factor != 1:
            table = self.ex_of(old)
            self.heights[id(new)] = (new, table if factor == 1 else table.withColumn("ex", F.col("ex") * factor))
        return new

    def set_ex(self, h: float) -> None:
        """Set the top images' ex, below 1 as a share of their heights; the first image's becomes the session's."""
        if h <= 0:
            raise PipelineError("ex: the height must be positive")
        old = self.top()
        new = old.select("*")  # copies of the item elsewhere on the stack keep theirs
        table = old.groupBy("img").agg((F.max("h") * float(h) if h < 1 else F.lit(float(h))).alias("ex"))
        self.stack[-1] = new
        self.heights[id(new)] = (new, table)
        self.ex = float(h) if h >= 1 else table.orderBy("img").first()["ex"]

    def replace(self, change: Callable[[DataFrame], DataFrame], factor: float = 1.0) -> None:
        """Change the top item, on the pages of the parity asked for; ``factor`` is what becomes of its ex."""
        old, rest = self.top(), None
        part = old
        if self.parity and "pag" in old.columns:
            odd = self.parity == "odd"
            part, rest = pointwise.by_parity(old, odd), pointwise.by_parity(old, not odd)
        self.popped.append(self.stack.pop())
        new = change(part)
        self.stack.append(self.inherit(new if rest is None else new.unionByName(rest), old, factor))

    def merge(self, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """The top two items become one: ``change(below, top)``."""
        below, top = self.top(2), self.top()
        self.popped.append(self.stack.pop())
        self.stack[-1] = change(below, joins_key(top, below))


def joins_key(px: DataFrame, like: DataFrame) -> DataFrame:
    """A set of images under the keys of another: matched by their order."""
    from pyspark.sql import Window

    def places(p: DataFrame, name: str) -> DataFrame:
        return p.select("img").distinct().select(F.col("img").alias(name), F.row_number().over(Window.orderBy("img")).alias("place"))  # one row per image

    keys = places(px, "of").join(places(like, "to"), "place").select("of", "to")
    return px.join(keys, F.col("img") == F.col("of")).withColumn("img", F.col("to")).drop("of", "to")


def _needs(args: list[str], n: int) -> list[float | int]:
    if len(args) < n:
        raise PipelineError("a parameter is missing")
    return [number(a) for a in args[:n]]


def _write(m: Machine, name: str) -> None:
    item = m.pop()
    if "vec_id" in item.columns:
        if name == "-":
            m.output.append("".join(f"{r.line}\n" for r in pnm.vector_text(item).orderBy("vec_id", "i").collect()))
        else:
            pnm.write_vector(item, name)
    elif name == "-":
        m.output.append(b"".join(bytes(r.content) for r in pnm.encoded(item).orderBy("pag").collect()))
    else:
        pnm.write_images(item, name).collect()


def _page_number(n: float) -> int:
    if not 0 <= n < pnm.PAGES:
        raise PipelineError("pag: the number is too large")
    return int(n)


def _fill_value(token: str) -> float | None:
    if token == "-":
        return None
    v = number(token)
    return v * 255 if isinstance(v, float) and token_kind(token) == "d" else v


def _histogram(px: DataFrame, chan: int) -> DataFrame:
    return stats.histogram(px, chan).select(F.col("img").alias("vec_id"), F.col("level").alias("i"), F.col("n").cast("double").alias("v"))


def _split(m: Machine, halves: tuple[DataFrame, DataFrame]) -> None:
    old = m.pop()
    m.push(m.inherit(halves[1], old))
    m.push(m.inherit(halves[0], old))


def _command(m: Machine, name: str, args: list[str]) -> int:
    """Run one command; the number of parameters it took."""
    one: dict[str, Callable[[float], None]] = {
        "bg": lambda d: m.replace(lambda p: scan.background(p, d)),
        "fix-bg": lambda d: m.replace(lambda p: joins.fix_background(p, d)),
        "dither": lambda s: m.replace(lambda p: solvers.floyd_dither(p, s)),
        "grid": lambda s: m.replace(lambda p: pointwise.grid(p, s)),
        "chan": lambda n: m.replace(lambda p: pointwise.extract_channel(p, int(n))),
        "histo": lambda n: m.push(_histogram(m.top(), int(n))),
        "double": lambda k: m.replace(lambda p: geometry.double(p, k), 2.0),
        "rot": lambda a: m.replace(lambda p: geometry.rotate(p, a)),
        "skew": lambda a: m.replace(lambda p: geometry.skew(p, a)),
        "splitx": lambda n: _split(m, geometry.split_x(m.top(), n)),
        "splity": lambda n: _split(m, geometry.split_y(m.top(), n)),
        "pois": lambda t: m.merge(lambda g, p: solvers.poisson_solve(g, p, tol=t)),
        "pag": lambda n: m.replace(lambda p: p.withColumn("pag", F.lit(_page_number(n)))),
        "ex": m.set_ex,
        "test": lambda n: m.replace(lambda p: scan.convolve_3x3(p, 4, -1, -1, 0)),
    }
    none: dict[str, Callable[[], object]] = {
        "pop": m.pop, "unpop": m.unpop, "swap": m.swap, "copy": lambda: m.push(m.top()),
        "alpha": lambda: m.replace(pointwise.add_alpha), "opaque": lambda: m.replace(pointwise.opaque), "half": lambda: m.replace(geometry.half),
        "deskew": lambda: m.replace(geometry.deskew), "lapl": lambda: m.replace(scan.laplacian), "diff": lambda: m.merge(joins.diff), "div": lambda: m.merge(joins.divide),
        "s-paste": lambda: m.merge(lambda onto, paste: solvers.seamless_paste(paste, onto)), "stat": lambda: m.output.append(stats.statistics(m.top()).orderBy("img").collect()),
        "odd": lambda: setattr(m, "parity", "odd"), "even": lambda: setattr(m, "parity", "even"), "all": lambda: setattr(m, "parity", None),
    }
    if name in none:
        none[name]()
        return 0
    if name in one:
        one[name](*_needs(args, 1))
        return 1
    if name in ("bin", "con") and args and args[0] == "auto":
        auto = pointwise.binarize_auto if name == "bin" else pointwise.contrast_auto
        m.replace(lambda p: auto(p, stats.statistics(p)))
        return 1
    if name == "bin":
        (t,) = _needs(args, 1)
        m.replace(lambda p: pointwise.binarize(p, t))
        return 1
    if name == "con":
        b, w = _needs(args, 2)
        m.replace(lambda p: pointwise.contrast(p, b, w))
        return 2
    if name in ("cropx", "cropy"):
        a, b = _needs(args, 2)
        m.replace(lambda p: (geometry.crop_x if name == "cropx" else geometry.crop_y)(p, a, b))
        return 2
    if name == "image":
        m.push(create.new_image(m.spark, *(int(x) for x in _needs(args, 3))))
        return 3
    if name == "clone":
        m.push(create.clone_shape(m.top(), *(int(x) for x in _needs(args, 3))))
        return 3
    if name == "fill":
        values = dict(enumerate(_fill_value(a) for a in args[:4]))
        m.replace(lambda p: pointwise.fill(p, values))
        return 4
    if name == "rect":
        v, *box = _needs(args, 5)
        m.replace(lambda p: pointwise.select_rectangle(p, v, *box))
        return 5
    if name == "darker":
        files = args[: next((k for k, a in enumerate(args) if token_kind(a) != "f"), len(args))]
        if not files:
            raise PipelineError("darker: a file is missing")
        first, *others = (to_px(pnm.load(m.spark, f)) for f in files)
        m.push(joins.darker(first, *(joins_key(o, first) for o in others)))
        return len(files)
    if name == "w":
        if not args:
            raise PipelineError("w: a name is missing")
        _write(m, args[0])
        return 1
    raise PipelineError(f"{name}: unknown command")


def run(spark: SparkSession, words: list[str], stdin: bytes = b"", machine: Machine | None = None) -> Machine:
    """Run the words of a pipeline; the machine holds the stack and what was written to standard output."""
    m = machine or Machine(spark, stdin)
    at = 0
    while at < len(words):
        word, at = words[at], at + 1
        if word in ("-h", "--help"):
            m.output.append(HELP)
        elif word == "quit":
            break
        elif word == "-":
            m.push(to_px(pnm.read_images(spark.createDataFrame([("-", m.stdin)], "path string, content binary"))))
        elif token_kind(word) == "f":
            m.push(to_px(pnm.load(spark, word)))
        else:
            name = next((p for p in PREFIXES if word.startswith(p)), word)
            at += _command(m, name, words[at:])
    return m
