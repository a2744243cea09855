"""Ranked search against brute force: fall-through, ties, nulls, empty and long texts, repeated rows, clashing columns."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweave.llm import tiers

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, top=20, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("segment", F.lit("clash")).withColumn("score", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in tiers.search(tiers.build(d, **how), q, top).collect()], key=str)


@pytest.mark.parametrize("how", [{}, {"tiers": (2, 6), "segment_bytes": 400}, {"tiers": (1,), "segment_bytes": 1500}, {"tiers": ()}])
def test_search_is_exact_in_every_tier(spark, how):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(300)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 20, 60])))) for k in range(150)]
    docs += [(1000 + k, docs[0][1]) for k in range(40)]  # exact copies: ties
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 12])))) for k in range(12)] + [(50, docs[0][1]), (51, "w1 w1 W1"), (52, "unheard of")]
    assert found(spark, docs, items, 5, **how) == brute(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "  ;\n"), (None, "Ärger über Öl"), (5, "ärger Ärger naïve_x9"), (6, "日本語 テスト x9 " * 30000), (7, "x9"), (7, "x9"), (None, "x9"), (8, "\x7fa\x00b"), (-4, "x9")]
    items = [(1, "Ärger"), (1, "ÄRGER x9"), (2, None), (3, ""), (4, "日本語 naïve X9"), (None, "a b"), (6, "x9 " * 3000)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 2, tiers=(1, 2)) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_items_fall_through_only_without_proof(spark, monkeypatch):
    """A rare term is proven by the first tier; an item of common terms is not."""
    docs = [(k, "common " * (1 + k % 3) + ("rare " if k < 3 else "") + "x" * (k % 7)) for k in range(300)]
    read = []
    each = tiers._round
    monkeypatch.setattr(tiers, "_round", lambda found, t, k, block, live, top: read.append((k, sorted(live))) or each(found, t, k, block, live, top))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, "rare"), (1, "common")], "item_id long, text string")
    rows = tiers.search(tiers.build(d, (4, 200)), q, 3).collect()
    assert read[0] == (0, [0, 1]) and [live for _, live in read[1:]] == [[1]] * (len(read) - 1) and len(read) > 1
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in rows], key=str) == brute(docs, [(0, "rare"), (1, "common")], 3)
