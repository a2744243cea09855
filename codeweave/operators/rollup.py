"""Directory trees and summaries of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions.text import ancestors, fresh, parent


def tree(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, kind, symbol_count, file_count): files and all directories above them, with what they hold in all depths."""
    per = symbols.groupBy("file_path").agg(F.count("*").alias("n"))
    rows = files.join(per, files.path == per.file_path, "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    dirs = rows.select(F.explode(ancestors(F.col("path"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("symbol_count"), F.count("*").alias("file_count"))
    leaves = rows.select("path", F.lit("file").alias("kind"), F.col("n").alias("symbol_count"), F.lit(1).cast("long").alias("file_count"))
    return dirs.select("path", F.lit("directory").alias("kind"), "symbol_count", "file_count").unionByName(leaves)


def directory_files(files: DataFrame, directory: str) -> DataFrame:
    """Files in a directory or below; '.' and '' mean all; the path itself counts too."""
    rel = directory.rstrip("/")
    if rel in ("", "."):
        return files
    return files.where(F.col("path").startswith(rel + "/") | (F.col("path") == rel))


def module_summary(files: DataFrame, symbols: DataFrame, directory: str) -> DataFrame:
    """(path, kind, symbols): how many symbols of each kind a directory's files have."""
    chosen = directory_files(files, directory).select("path")
    return chosen.join(symbols, chosen.path == symbols.file_path).groupBy("path", "kind").agg(F.count("*").alias("symbols"))


def directory_summaries(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(directory, text): the fresh summaries of the files right in a directory, a line each, sorted; the top is left out."""
    rows = files.join(summaries.where(fresh()), files.path == summaries.target_id).select(parent(F.col("path")).alias("directory"), F.concat("path", F.lit(": "), "summary_text").alias("line"))
    return rows.where("directory <> ''").groupBy("directory").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
