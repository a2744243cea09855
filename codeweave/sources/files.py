"""Source trees as DataFrames."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave import schemas


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """A line of an ignore file → (negated, regular expression over relative paths); None for blanks and comments.

    `*` and `?` stay inside a path part, `**` crosses parts, a slash before the end anchors at the root, a trailing one
    means directories; whatever matches takes all below it along.
    """
    p = pattern.rstrip("\n").rstrip(" ")
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    p = p.removeprefix("\\")
    directory = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            inner = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return negated, ("^" if anchored else "^(?:.*/)?") + out + ("/.+$" if directory else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides."""
    out = F.lit(False)
    for negated, regex in filter(None, map(ignore_regex, patterns)):
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def selected(paths: DataFrame, languages=tuple(schemas.LANGUAGES.values()), excluded=schemas.EXCLUDED, ignore: list[str] = ()) -> DataFrame:
    """paths (path) → (path, language) of the files to index."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in schemas.LANGUAGES.items() for x in kv])
    rows = paths.withColumn("language", F.try_element_at(table, ext)).where(F.col("language").isin(*languages))
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))) if excluded else F.lit(True))
    return rows.where(~ignored(F.col("path"), list(ignore)))


def discover(spark: SparkSession, root: str, languages=tuple(schemas.LANGUAGES.values()), excluded=schemas.EXCLUDED) -> DataFrame:
    """(path, language, content) of a tree's source files; the root's .gitignore counts."""
    base = Path(root).resolve()
    ignore = (base / ".gitignore").read_text(errors="replace").splitlines() if (base / ".gitignore").exists() else []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(base.as_uri())
    rel = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+" + re.escape(str(base).lstrip("/")) + "/", "")
    # The scan passes over empty files; the listing, which the driver has anyway, names them too.
    names = spark.createDataFrame([(n,) for n in files.inputFiles()], "raw string").select(rel(F.col("raw")).alias("path"))
    read = files.select(rel(F.col("path")).alias("path"), "content")
    return selected(names, languages, excluded, ignore).join(read, "path", "left").select("path", "language", F.coalesce("content", F.lit(b"")).alias("content"))


def source_text(root: str, path: str) -> str:
    """A file's text with what isn't UTF-8 replaced; paths outside the root are refused."""
    base = Path(root).resolve()
    file = (base / path).resolve()
    if not file.is_relative_to(base):
        raise PermissionError(f"{path} is outside the project")
    return file.read_bytes().decode("utf-8", "replace")


def _git(root: str, seconds: int, *args: str) -> str | None:
    try:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout if got.returncode == 0 else None


def head(root: str) -> str | None:
    got = _git(root, 10, "rev-parse", "HEAD")
    return got.strip() if got else None


def diff(spark: SparkSession, root: str, since: str) -> DataFrame:
    """(path, change_type) of a commit range; a rename is a deletion and an addition. The primary method compares hashes."""
    rows = []
    for line in (_git(root, 30, "diff", "--name-status", since, "HEAD") or "").splitlines():
        status, *names = line.split("\t")
        if status.startswith("R"):
            rows += [(names[0], "deleted"), (names[1], "added")]
        elif status.startswith("C"):
            rows.append((names[1], "added"))
        else:
            rows.append((names[0], {"D": "deleted", "A": "added"}.get(status[0], "changed")))
    return spark.createDataFrame(rows, schemas.CHANGES)
