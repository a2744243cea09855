"""Source files → symbols and raw references: the one stage of indexing that runs Python, a file per row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.operators.tables import ship

ROWS = "file_path string, language string, what int, ordinal int, name string, qualified_name string, kind string, start_line int, end_line int, signature string, source string, ref_text string"


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, language, content binary) → (symbols with ordinal, raw references).

    Symbols keep the order of their file: of equal ids the last one counts. Bytes that aren't UTF-8 are replaced.
    """
    ship(files.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeweave.functions.lang import extract as one

        columns = [c.split(" ")[0] for c in ROWS.split(", ")]
        for b in batches:
            rows = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                symbols, refs = one(language, bytes(content).decode("utf-8", "replace"))
                rows += [(path, language, 0, k, *s, None, None) for k, s in enumerate(symbols)]
                rows += [(path, language, 1, k, None, None, kind, None, None, None, source, text) for k, (source, text, kind) in enumerate(refs)]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("start_line", "end_line", "what", "ordinal"):
                out[c] = out[c].astype("Int32")
            yield out

    rows = files.select("path", "language", "content").mapInPandas(each, ROWS)
    ident = lambda c: F.concat("file_path", F.lit("::"), c)
    symbols = rows.where("what = 0").select(ident("qualified_name").alias("id"), "file_path", "name", "qualified_name", "kind", "start_line", "end_line", "signature", "ordinal")
    refs = rows.where("what = 1").select(ident("source").alias("source_id"), "ref_text", "kind", "file_path", "language", "ordinal")
    return symbols, refs


def file_rows(files: DataFrame) -> DataFrame:
    """files (path, language, content) → rows of the files table."""
    text = F.decode("content", "ISO-8859-1")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    return files.select("path", "language", F.sha2("content", 256).alias("content_hash"), lines.alias("line_count"), F.current_timestamp().alias("last_indexed"))

