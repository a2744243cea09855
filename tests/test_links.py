"""Queries on edges where a name has many callers and many symbols: whole, and nothing of the product's size is shuffled."""

import duckdb
import pytest

from codeweave.plans.queries import QUERIES, SQL
from jobs import queries as jobs

N = 150
NAMES = ["resolve_edges", "degrees", "graph_nodes", "orphans", "resolution_ratio", "resolve_delta", "simple_graph", "symbol_neighbours", "cascade_delete", "callees", "callers", "edge_names", "hub_files", "graph_edges", "overview_density", "stats_counts", "symbol_info", "job1_refresh_index", "job2_architecture_report"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    body = lambda k: "<title>the Hot %s</title>" % ("alone" if k % 5 else "twin twin") + '<a href="/the"><a href="/hot"><a href="/Hot"><a href="/none">' + ('<a href="/alone">' if k % 7 == 0 else "")
    rows = [(k, f"http://x/{k}", body(k)) for k in range(N)] + [(N, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    docs = [(k, f"text {k % 3}", "en", "s") for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("name", NAMES)
def test_hot_names(spark, data, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet/*.parquet'")
    before = shuffled(spark)
    ours = (QUERIES | jobs.QUERIES)[name](spark, data).toPandas()
    assert shuffled(spark) - before < N * N
    theirs = con.execute((SQL | jobs.SQL)[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)
