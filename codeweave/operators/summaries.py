"""Summaries of files, symbols and directories: which are due, prompts, replies, and matching replies to symbols.

The model is a callable from a list of prompts to a list of replies (or None); without one a text is made of the
symbols' names, which needs no network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave import schemas
from codeweave.functions.text import fresh

REPLY = "file_summary string, symbols map<string,string>"
ASK = (
    'Answer with one JSON object and nothing else: {"file_summary": "what the file is for, in one or two sentences", '
    '"symbols": {"qualified name": "one sentence"}}. Give every symbol listed, by its exact qualified name.'
)


def short_enough(files: DataFrame, limit: int = schemas.MAX_SUMMARY_CHARS) -> DataFrame:
    return files.where(F.length(F.coalesce("text", F.lit(""))) <= limit)


def to_do(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Files (path) without a fresh summary."""
    return files.join(summaries.where(fresh()).select(F.col("target_id").alias("path")), "path", "left_anti")


def prompts(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """sources (path, text) → (file_path, prompt) with the file's symbols in order of line."""
    line = F.concat_ws(" ", F.lit("-"), "kind", "qualified_name", F.concat(F.lit("(lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("):")), "signature")
    listed = symbols.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", line.alias("line")))).alias("s"))
    rows = short_enough(sources).join(listed, sources.path == listed.file_path, "left")
    names = F.coalesce(F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit(""))
    return rows.select(F.col("path").alias("file_path"), F.concat_ws("\n", F.concat(F.lit("File: "), "path"), F.lit("Symbols:"), names, F.lit("Source:"), "text", F.lit(ASK)).alias("prompt"))


def replies(asked: DataFrame, model: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """asked (file_path, prompt) → (file_path, response); prompts without a reply have no row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = model(b["prompt"].tolist()) if model else [_plain(p) for p in b["prompt"]]
            out = pd.DataFrame({"file_path": b["file_path"], "response": got})
            yield out[out["response"].notna()]

    return asked.mapInPandas(each, "file_path string, response string")


def _plain(prompt: str) -> str:
    import json

    head, _, rest = prompt.partition("\nSymbols:\n")
    names = [x.split(" ")[2] for x in rest.partition("\nSource:\n")[0].split("\n") if x.startswith("- ") and len(x.split(" ")) > 2]
    path = head.removeprefix("File: ")
    return json.dumps({"file_summary": f"{path} defines {', '.join(names) or 'nothing'}.", "symbols": {n: f"{n} of {path}." for n in names}})


def parsed(responses: DataFrame) -> DataFrame:
    """(file_path, response) → file_path, file_summary, symbols. Fences are stripped; what isn't JSON is the file's summary, 500 characters of it."""
    t = F.trim(F.regexp_replace("response", r"^\s+|\s+$", ""))
    bare = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"```[^`]*$", "")).otherwise(t)
    rows = responses.withColumn("bare", F.trim(F.regexp_replace(bare, r"\s+$", "")))
    ok = F.try_parse_json("bare").isNotNull()
    reply = F.from_json("bare", REPLY)
    return rows.select("file_path", F.when(ok, reply["file_summary"]).otherwise(F.substring(t, 1, 500)).alias("file_summary"), F.when(ok, reply["symbols"]).alias("symbols"))


def matched(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """keys (file_path, key, any others) with the id of the file's symbol: of that qualified name, else the first by line
    whose name or last part is the key. Both are joins on equal values: the last part is a column of its own."""
    first = Window.partitionBy("file_path", "key").orderBy("rank", "start_line", "id")
    ways = symbols.select("file_path", "id", "start_line", F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.col("qualified_name").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("name").alias("key")),
        F.struct(F.lit(1).alias("rank"), F.substring_index("qualified_name", ".", -1).alias("key")))).alias("w")).select("file_path", "id", "start_line", "w.*")
    best = ways.join(keys.select("file_path", "key").distinct(), ["file_path", "key"], "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").select("file_path", "key", "id")
    return keys.join(best, ["file_path", "key"])


def rows(replied: DataFrame, symbols: DataFrame, model: str) -> DataFrame:
    """Replies → rows of the summaries table."""
    p = parsed(replied)
    of_files = p.where("file_summary is not null").select(F.col("file_path").alias("target_id"), F.lit("file").alias("target_kind"), F.col("file_summary").alias("summary_text"))
    keys = p.select("file_path", F.explode("symbols").alias("key", "summary_text"))
    of_symbols = matched(keys, symbols).select(F.col("id").alias("target_id"), F.lit("symbol").alias("target_kind"), "summary_text").dropDuplicates(["target_id"])
    return of_files.unionByName(of_symbols).select("target_id", "target_kind", "summary_text", F.lit(model).alias("model"), F.current_timestamp().alias("generated_at"), F.lit(False).alias("is_stale"))
