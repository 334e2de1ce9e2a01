"""Pages that arrive as files."""
