"""What the operators share: tables in the cluster's shared folder, settings for a while, code on the executors."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def local(spark: SparkSession) -> bool:
    """Whether the executors are the driver's own threads."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/codeweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "graph") -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "graph", of: str = "true") -> tuple[DataFrame, int]:
    """As cut(), with the number of rows, or of those that a condition holds for, counted while they are written.

    What is asked of the number is whether it is 0: a lost executor's rows may count twice.
    """
    spark = df.sparkSession
    path, seen = shared_folder(spark, name), Observation()
    df.observe(seen, F.count_if(F.expr(of)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def bucketed(df: DataFrame, key: str, parts: int, name: str = "graph", distinct: bool = False) -> DataFrame:
    """As cut(), in `parts` buckets of key: joins and aggregates on it need no exchange, if they have as many partitions.

    distinct: equal rows once, by the same exchange.
    """
    spark = df.sparkSession
    table = f"codeweave_{uuid.uuid4().hex}"
    dealt = df.repartition(parts, key)
    (dealt.distinct() if distinct else dealt).write.bucketBy(parts, key).option("path", shared_folder(spark, name)).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # analysed before its name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Settings (dots as __) for a while; the former ones come back."""
    names = {k.replace("__", "."): str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ship(spark: SparkSession) -> None:
    """The package on a cluster's executors, for stages that run Python."""
    sc = spark.sparkContext
    if local(spark) and str(ROOT) in [os.path.abspath(p or ".") for p in sys.path] or getattr(sc, "_codeweave_sources", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        name = os.path.join(folder, "codeweave-sources.zip")
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted((ROOT / "codeweave").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(name)
    sc._codeweave_sources = True
