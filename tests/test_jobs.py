"""The jobs: over growing input, run again, broken off, on odd rows, from the command line, and against their SQL."""

import logging
import os
import subprocess
import sys

import duckdb
import pytest

from codeweave.operators.resolve import resolve
from codeweave.plans import fixtures
from jobs import architecture_report, queries, refresh_index

DATA = "/root/testdata/sf0.001"


def page(k, title, links=(), extra=""):
    return (k, f"http://x/{k}", f"<title>{title}</title>" + "".join(f'<a href="/{x}">' for x in links) + extra)


def pages(spark, rows):
    return spark.createDataFrame(rows, refresh_index.PAGES)


def state(spark, out):
    return {t: sorted(map(str, refresh_index.current(spark, out, t).drop("change_type").collect())) for t in refresh_index.TABLES}


def whole(spark, rows, tmp_path, name):
    """The index that one run over the final pages makes."""
    pages(spark, rows).write.parquet(str(tmp_path / f"{name}-in"))
    refresh_index.run(spark, str(tmp_path / f"{name}-in"), str(tmp_path / name))
    return state(spark, str(tmp_path / name))


def test_growing_pages(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, out = str(tmp_path / "pages"), str(tmp_path / "index")
    first = [page(1, "alpha beta", ["gamma", "alpha"]), page(2, "delta", ["alpha", "nowhere"]), page(3, "same", ["delta"])]
    pages(spark, first).coalesce(1).write.parquet(source)
    refresh_index.run(spark, source, out)
    assert state(spark, out) == whole(spark, first, tmp_path, "one")
    before = state(spark, out)
    refresh_index.run(spark, source, out)  # nothing new
    assert state(spark, out) == before
    # A new symbol catches an old reference, a changed page loses one, an equal one is passed over, an odd page comes in.
    more = [page(4, "gamma nowhere"), page(2, "epsilon", ["beta"]), page(3, "same", ["delta"]), (5, None, None), (None, "u", "<title>lost</title>")]
    pages(spark, more).coalesce(1).write.mode("append").parquet(source)
    caplog.clear()
    refresh_index.run(spark, source, out)
    assert "read 4 pages, 2 new, 1 changed" in caplog.text
    now = [first[0], first[2], more[1], more[0], more[3]]
    assert state(spark, out) == whole(spark, now, tmp_path, "two")
    edges = {(r.source_id, r.target_id): r.resolved for r in refresh_index.current(spark, out, "edges").collect()}
    p = [f"p{k}/d{k % 3}/page{k}.html" for k in range(6)]
    assert edges[f"{p[1]}::__module__", f"{p[4]}::gamma"] and not edges[f"{p[3]}::__module__", "delta"]
    found = pages(spark, now)
    want = {(r.source_id, r.target_id): r.resolved for r in resolve(fixtures.refs_of(found), fixtures.symbols_of(found)).collect()}
    assert edges == want


def test_a_batch_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "pages"), str(tmp_path / "index")
    first, more = [page(1, "alpha", ["beta"]), page(2, "beta", ["alpha"])], [page(2, "gamma", ["alpha"]), page(3, "beta")]
    pages(spark, first).coalesce(1).write.parquet(source)
    refresh_index.run(spark, source, out)
    pages(spark, more).coalesce(1).write.mode("append").parquet(source)
    write = refresh_index._write
    for table in ("refs", "files", "edges"):

        def broken(df, out, t, *parts, table=table):
            if t == table:
                raise OSError("gone")
            write(df, out, t, *parts)

        monkeypatch.setattr(refresh_index, "_write", broken)
        with pytest.raises(Exception, match="gone"):
            refresh_index.run(spark, source, out)
    monkeypatch.setattr(refresh_index, "_write", write)
    refresh_index.run(spark, source, out)
    assert state(spark, out) == whole(spark, [first[0], *more], tmp_path, "want")


def test_empty_and_repeated_pages(spark, tmp_path):
    source, out = str(tmp_path / "pages"), str(tmp_path / "index")
    pages(spark, []).write.parquet(source)
    refresh_index.run(spark, source, out)
    assert state(spark, out) == {t: [] for t in refresh_index.TABLES}
    twice = [page(1, "alpha", ["alpha"]), page(1, "alpha", ["alpha"]), page(1, "omega", ["alpha"])]
    pages(spark, twice).coalesce(1).write.mode("append").parquet(source)
    refresh_index.run(spark, source, out)
    assert refresh_index.current(spark, out, "files").count() == 1 and refresh_index.current(spark, out, "symbols").count() == 1


def test_report(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb", "en", "s"), (2, "a\nb", "en", "s"), (3, None, None, "t"), (4, "", "fr", None)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "docs"))
    pages(spark, [page(k, f"own{'x' * k} shared", ["shared", "none"]) for k in range(1, 5)]).write.parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "report")
    read = lambda: sorted(map(str, spark.read.schema(architecture_report.REPORT).orc(out).collect()))
    for _ in range(2):
        architecture_report.run(spark, str(tmp_path / "docs"), str(tmp_path / "pages"), out, {"god_degree": 4, "top": 2})
        got = {(r.section, r["rank"], r.name): r.n for r in spark.read.schema(architecture_report.REPORT).orc(out).collect()}
        assert got["copies", 0, "s/en/1.txt"] == 2 and got["directories", 0, "s"] == 2 and got["languages", 0, None] == 1
        assert got["gods", 1, "p1/d1/page1.html::__module__"] == 4 and got["hubs", 2, "p2/d2/page2.html"] == 4
        assert sum(n for (s, _, _), n in got.items() if s == "orphans") == 4
        once = read()
    assert read() == once


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.architecture_report", "--documents", f"{DATA}/documents.parquet", "--pages", f"{DATA}/pages.parquet", "--out", str(tmp_path / "out")], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and (tmp_path / "out/section=languages").is_dir()
