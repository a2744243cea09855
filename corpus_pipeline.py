"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Columns that a stage needs are doc_id, text and source; all others pass through, whatever their names. Rows whose id
is null or occurs again are told apart by a hash of id and text, so every stage judges each row by its own text; of rows
that agree in id and text near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import leaks, mixing, neardup, shared, tokens, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last category's probability reaches the limit go."""
    judged, names = toxicity.scored(spark, docs, sf_dir)
    return judged.where(F.col(names[-1]) < toxicity.REJECT).select(*docs.columns)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the document with the smallest key (its id, mostly) stays."""
    key = shared.unused(docs.columns, "near_key")
    told, again = shared.keyed(docs, key)
    classes = neardup.classes(told.select(F.col(key).alias("doc_id"), "text"))
    # Those that go are few, so they are sent to the texts.
    others = shared.stored(classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(key)).distinct(), "others")
    kept = told.join(shared.small(others, 200_000), key, "left_anti")
    return (kept.dropDuplicates([key]) if again else kept).select(*docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of five words or more go; fewer words are no evidence."""
    key = shared.unused(docs.columns, "leak_key")
    told, _ = shared.keyed(docs, key)
    found = leaks.matches(told.select(F.col(key).alias("doc_id"), "text"), shared.table(spark, sf_dir, "benchmark"))
    found = shared.stored(found.where(F.col("n_words") >= leaks.SIZE).select(F.col("doc_id").alias(key)).distinct(), "leaked")
    return told.join(shared.small(found, 200_000), key, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; shards in order, each shuffled by slot."""
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("mix_size"), F.struct(*docs.columns).alias("document"))
    plan = mixing.plan(shared.stored(sized.select("doc_id", "source", "mix_size"), "mix-sizes"))
    taken = mixing.apply(sized, plan).select("document", F.explode("mix_copies").alias("copy"))
    by = ["copy.shard", "copy.slot"]
    return taken.repartitionByRange(*by).sortWithinPartitions(*by).select("document.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, in the order of its files, with a row for each document in them."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:  # not as they were read from files: by doc_id then
        place = None
    return tokens.read(tokens.write(docs, shared.place(spark, "tokens"), place=place))


STAGES = [("toxicity", toxic_out), ("near_dedup", near_out), ("decontamination", leaks_out), ("mixing", mixed), ("token_files", token_files)]

#: Hashed features, sketches and a tokenizer: SQL can't express it. The tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
