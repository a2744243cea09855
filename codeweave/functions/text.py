"""Scalar expressions of paths, ids and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names by file extension.
LABELS = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "tsx": "TSX", "jsx": "JSX", "rs": "Rust", "go": "Go", "java": "Java",
    "c": "C", "cpp": "C++", "h": "C/C++ Header", "rb": "Ruby", "sh": "Shell", "bash": "Bash", "zsh": "Zsh", "css": "CSS",
    "html": "HTML", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "md": "Markdown", "sql": "SQL", "lua": "Lua",
}


def leaf(c: Column, mark: str = "::") -> Column:
    """What follows the last mark: the display name of an id that has no symbol."""
    return F.substring_index(c, mark, -1)


def parent(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, the outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def escaped_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def language_label(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.upper(ext))


def padded(c: Column, width: int) -> Column:
    """Left-aligned to a width; longer text is not cut."""
    return F.rpad(c, F.greatest(F.length(c), F.lit(width)), F.lit(" "))


def radius(pagerank: Column) -> Column:
    return F.greatest(F.lit(3.0), F.sqrt(pagerank * 5000))


def fresh(prefix: str = "") -> Column:
    """A summary counts if it isn't stale and has text."""
    return ~F.col(f"{prefix}is_stale") & (F.length(F.col(f"{prefix}summary_text")) > 0)
