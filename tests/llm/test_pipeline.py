"""The pipeline's stages against brute force, on rows with nulls, ties, repeated ids and clashing column names."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from codeweave.llm import neardup, shared, tokens
from codeweave.llm.textcols import runs, shingles, words

DATA = "/root/testdata/sf0.001"
R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 7))) for _ in range(500)]
CLASHES = ["p_toxic", "mix_note", "mix_key", "near_key", "leak_key", "document", "copy", "sig", "n", "label", "bucket", "row", "block"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder of documents, labels and benchmark."""
    folder = tmp_path_factory.mktemp("tables")
    rows, labels = [], []

    def add(i, text, source, toxic=None):
        rows.append((i, text, source))
        if toxic is not None and i is not None:
            labels.append((i, R.randrange(2), int(toxic)))

    for k in range(200):
        toxic = k % 4 == 0
        add(k, prose(70, k) + (" zzvile zzfoul zzrot" if toxic else ""), ["a", "b", "c", None][k % 3 if k % 7 else 3], toxic)
    near = prose(120, 7).split()
    near[60] = "edited"
    for i, text in [(1000, prose(120, 7)), (1001, prose(120, 7)), (1002, " ".join(near)), (None, prose(120, 7)), (None, prose(90, 800)), (None, prose(90, 801)), (None, prose(90, 800))]:
        add(i, text, "a")
    item = prose(40, 900)
    for i, text in [(2000, prose(30, 21) + " " + item.upper() + " " + prose(30, 22)), (None, prose(30, 23) + " " + item), (2001, item), (2002, prose(60, 24))]:
        add(i, text, "b")
    for text in (prose(80, 30), prose(80, 31), prose(80, 31), prose(30, 32) + " " + item):  # one id, other texts
        add(3000, text, "c")
    for i, text in [(4000, None), (4001, ""), (4002, prose(30000, 33)), (None, None)]:
        add(i, text, None)
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] for r in rows]}
    columns |= {c: [f"{c} {k}" for k in range(len(rows))] for c in CLASHES}
    pq.write_table(pa.table(columns), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1, 2, None], "text": [item, "zz", prose(20, 901)]}), folder / "benchmark.parquet")
    return str(folder)


def sets(text):
    (_, _, data, offsets), *_ = [*runs(pa.array([text or ""]))] or [(0, 0, np.zeros(0, np.uint8), np.zeros(2, np.int64))]
    h, _, first = words(data, offsets)
    return np.sort(shingles(h, first)[0])


def key(r):
    return r.doc_id, r.text


def test_stages(spark, tables):
    docs = shared.table(spark, tables, "documents")
    names, before = docs.columns, docs.collect()
    stage = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = shared.stored(stage[name](spark, docs, tables), f"test-{name}")
        return out, out.collect()

    docs, rows = after("toxicity", docs)
    assert docs.columns == names
    assert Counter(map(key, rows)) == Counter(key(r) for r in before if "zzvile" not in (r.text or ""))
    assert {r.p_toxic for r in rows} <= {r.p_toxic for r in before}  # the document's own column

    before = rows
    docs, rows = after("near_dedup", docs)
    assert docs.columns == names
    told = sorted({key(r) for r in before}, key=str)
    held, up = [sets(t) for _, t in told], list(range(len(told)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(told)):
        for j in range(i):
            if neardup.probability_jaccard(held[i], held[j]) >= 0.8:
                up[top(i)] = top(j)
    kept = Counter(top(told.index(key(r))) for r in rows)
    assert {told[top(x)] for x in range(len(told))} - {told[x] for x in kept} == set() and set(kept.values()) == {1}

    before = rows
    docs, rows = after("decontamination", docs)
    item = prose(40, 900)
    assert docs.columns == names
    assert Counter(map(key, rows)) == Counter(key(r) for r in before if item not in (r.text or "").lower())
    assert len(rows) < len(before)

    before = rows
    docs, rows = after("mixing", docs)
    assert docs.columns == names
    size = lambda r: len((r.text or "").split())
    by, taken = Counter(), Counter()
    for r in before:
        by[r.source] += size(r)
    for r in rows:
        taken[r.source] += size(r)
    copies, there = Counter(map(key, rows)), Counter(map(key, before))
    assert all(copies[k] <= 2 * n for k, n in there.items()) and set(copies) <= set(there)
    assert all(taken[s] <= 2 * n + 1 for s, n in by.items())
    again = stage["mixing"](spark, shared.stored(spark.createDataFrame(before, docs.schema), "again"), tables).collect()
    assert Counter(map(key, again)) == copies

    library = tokens.encoder(None).tokenizer
    out = stage["token_files"](spark, docs, tables).orderBy("start").collect()
    files = docs.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    start = 0
    assert len(out) == len(files)
    for r, d in zip(out, files, strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def shuffles(spark, work):
    """What work() returns, and the rows of each shuffle that it wrote."""
    store, none = spark._jsc.sc().statusStore(), spark._sc._gateway.new_array(spark._jvm.double, 0)

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before, out = written(), work()
    return out, [n for k, n in written().items() if k not in before]


def test_token_files_shuffle_no_texts(spark, tmp_path):
    """Texts are taken as they are read, several files and batches a task; files' order stands."""
    rows = [(k * 37 % 101, prose(k % 9, k)) for k in range(300)]
    for k in range(3):
        pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows[k::3]], pa.int64()), "text": [r[1] for r in rows[k::3]]}), str(tmp_path / f"{k}.parquet"))
    docs = spark.read.parquet(str(tmp_path)).coalesce(1)
    stage = dict(corpus_pipeline.STAGES)["token_files"]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    former = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        out, moved = shuffles(spark, lambda: shared.stored(stage(spark, docs, str(tmp_path)), "test-tokens"))
    finally:
        spark.conf.set(batch, former)
    assert max(moved, default=0) < 50
    assert [r.doc_id for r in out.orderBy("start").collect()] == [r[0] for k in range(3) for r in rows[k::3]]


def test_near_out_shuffles_no_texts(spark, tables):
    """The documents that go are sent to the texts, however small a table Spark broadcasts by itself."""
    docs = shared.stored(shared.table(spark, tables, "documents").dropDuplicates(["doc_id"]).where("doc_id is not null"), "test-docs")
    name = "spark.sql.autoBroadcastJoinThreshold"
    former = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = corpus_pipeline.near_out(spark, docs, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, former)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_empty(spark, tables):
    docs = shared.table(spark, tables, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, tables), f"test-empty-{name}")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    names = shared.table(spark, DATA, "documents").columns
    n = shared.table(spark, DATA, "documents").count()
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert names and 0.5 * n < out.count()
