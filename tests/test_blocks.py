"""Edges spelled out in blocks: each once, in order of what repeats, so that files of them stay small."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from codeweave.operators import resolve
from codeweave.plans.queries import QUERIES


def test_edges_of_a_popular_name_are_whole_and_small(spark, tmp_path):
    n, m = 2001, 2003
    ids = lambda many, c, leaf: spark.range(many).select(F.lit(leaf).alias("leaf"), F.concat(F.lit("p/page"), "id", F.lit(".html::"), F.lit(leaf)).alias(c))
    callers = ids(n, "source_id", "hot").unionByName(ids(3, "source_id", "cold")).unionByName(ids(2, "source_id", "alone"))
    targets = ids(m, "target_id", "hot").unionByName(ids(9, "target_id", "cold"))
    out = f"{tmp_path}/edges"
    resolve.spelled(callers, targets).write.parquet(out)
    edges = spark.read.parquet(out)
    assert edges.groupBy("leaf").agg(F.count("*"), F.count_distinct(F.xxhash64("source_id", "target_id"))).sort("leaf").collect() == [("cold", 27, 27), ("hot", n * m, n * m)]
    assert sum(map(os.path.getsize, Path(out).glob("*.parquet"))) < 0.4 * n * m


def test_names_are_not_made_for_every_edge(spark, tmp_path):
    rows = [(k, f"http://x/{k}", '<title>the hot</title><a href="/the"><a href="/none">') for k in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = QUERIES["edge_names"](spark, str(tmp_path))
    assert "substring_index" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.where("source_name = '__module__'").count() == 20 * 20 + 20
