"""What the operators share: tables in the cluster's shared folder, code on the executors, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
ROOT = Path(__file__).resolve().parents[2]

#: Arrow batches for Python workers: both sides of the pipe hold a few at a time.
BATCH_BYTES = 8 << 20

#: A side is broadcast only when a count has shown that it has at most so many (narrow) rows.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset on a single machine (tests)."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/codeweave-{spark.sparkContext.applicationId}"


def local(spark: SparkSession) -> bool:
    """Whether the executors are the driver's own threads."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a cut of the lineage that outlives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_arrays(path: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays as one file of the shared folder, whose name it returns; loaded() reads it once for each worker."""
    import io

    from pyarrow import fs

    data = io.BytesIO()
    np.savez(data, **arrays)
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data.getbuffer())
    return path


def get_arrays(path: str) -> dict[str, np.ndarray]:
    import io

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        data = np.load(io.BytesIO(f.read()))
    return {k: data[k] for k in data.files}


_LOADED: dict[str, object] = {}


def loaded(path: str, make: Callable[[dict[str, np.ndarray]], T]) -> T:
    """What make() makes of a file's arrays; a worker keeps the last.

    Stages must reach this function by its module: what a nested function names is copied for every task.
    """
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = make(get_arrays(path))
    return _LOADED[path]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most `limit` rows, else df as it is (a shuffle join then)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unused(columns: list[str], name: str) -> str:
    """name, made longer until no column has it (names are alike in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """(docs with a key that tells rows of different id or text apart, whether any id is null or repeated).

    The key is doc_id, or a hash of id and text for rows whose id is null or occurs again.
    """
    again = stored(docs.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1)).select("doc_id"), "ids-again")
    if not again.limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), False
    mark = unused([*docs.columns, key], "id_again")
    marked = docs.join(small(again.where(F.col("doc_id").isNotNull()).withColumn(mark, F.lit(True)), 100_000), "doc_id", "left")
    odd = F.col("doc_id").isNull() | F.col(mark).isNotNull()
    # A hash leaves out nulls, so what is null is hashed too.
    own = F.xxhash64(F.lit("id and text"), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    return marked.withColumn(key, F.when(odd, own).otherwise(F.col("doc_id").cast("long"))).drop(mark), True


def ship(spark: SparkSession) -> None:
    """Readies a session for Python stages: the package on the executors of a cluster, small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if local(spark) and str(ROOT) in [os.path.abspath(p or ".") for p in sys.path] or getattr(sc, "_codeweave_shipped", False):
        return
    with tempfile.NamedTemporaryFile(suffix=".zip", prefix="codeweave-", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for p in sorted((ROOT / "codeweave").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
    sc.addPyFile(f.name)
    sc._codeweave_shipped = True


def lean(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A stage's function that gives freed memory back to the system when its task ends: workers are used again, and the next stage needs it elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows that are sorted by an integer column → batches that hold all rows of each of their values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch[column].to_numpy()
        other = np.flatnonzero(key != key[-1])
        start = int(other[-1]) + 1 if len(other) else 0
        if held and held[-1][column][0].as_py() != key[0]:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        if start:
            yield from pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks().to_batches()
            held = []
        held.append(batch.slice(start))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
