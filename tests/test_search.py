"""Gram search against LIKE, moves between two states against brute force, resolution kept up against a whole one."""

import random
import re

import pytest

from codeweave.operators import renames, resolve, search


def like(term, name):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term.lower())
    return re.search(pattern, name.lower(), re.S) is not None


def test_search_many(spark):
    r = random.Random(1)
    names = ["", "a", "get_user", "GetUser", "getxuser", "naïve", "ÄRGER", "a\\b", "x%y", None, *["".join(r.choice("abc_") for _ in range(r.randrange(1, 9))) for _ in range(150)]]
    rows = [(f"id{k}", n, f"Cls.{n}" if k % 2 and n is not None else n) for k, n in enumerate(names)]
    symbols = spark.createDataFrame(rows, "id string, name string, qualified_name string")
    terms = ["a", "ab", "abc", "cab_", "get_user", "GET", "%", "_", "a%c", "zzz", "", None, "ärg", "\\", "a\\b", "x%y", "cls.", "abc", "aab%bca", "_____"]
    got = search.search_many(symbols, search.postings(symbols), spark.createDataFrame([(t,) for t in terms], "term string"))
    got = sorted((r.term, r.id) for r in got.collect())
    assert got == sorted((t, i) for t in set(terms) if t for i, n, q in rows if any(x is not None and like(t, x) for x in (n, q)))
    assert search.search_many(symbols, search.postings(symbols), spark.createDataFrame([], "term string")).count() == 0
    assert search.search_many(symbols.limit(0), search.postings(symbols.limit(0)), spark.createDataFrame([("a",)], "term string")).count() == 0


def grams(text, size=5):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_moves(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(40)) for _ in range(r.randrange(3, 60))) for _ in range(30)]
    change = lambda t: " ".join(w if r.random() > 0.06 else "new" for w in t.split(" "))
    old = [(f"o{k:02d}", f"h{t}", t) for k, t in enumerate([*base, base[0], "", None])] + [("stays", "h", base[3])]
    new = [(f"n{k:02d}", f"h{t}", t) for k, t in enumerate([*base[:8], *map(change, base[8:]), change(base[9]), "", None, "lone"])] + [("stays", "other", "x")]
    schema = "path string, content_hash string, text string"
    got = {(x.old_path, x.new_path): x.similarity for x in renames.renames(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    want, used = {}, set()
    for o, h, _ in sorted(old, key=lambda x: x[0]):
        n = next((n for n, g, _ in sorted(new, key=lambda x: x[0]) if g == h and n not in used and n != "stays"), None)
        if n and o != "stays":
            want[o, n] = 1.0
            used |= {o, n}
    pairs = []
    for o, _, s in old:
        for n, _, t in new:
            x, y = grams(s), grams(t)
            if {o, n} & used or "stays" in (o, n) or not x or not y:
                continue
            like = len(x & y) / len(x | y)
            if like >= 0.5:
                pairs.append((-like, o, n))
    for like, o, n in sorted(pairs):
        if not {o, n} & used:
            want[o, n] = -like
            used |= {o, n}
    assert got.keys() == want.keys() and len(want) > 15 and any(0.5 <= v < 1 for v in want.values())
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_shingles_of_one_state_go_no_further(spark, monkeypatch):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    old = [(k, f"o{k}", words(k)) for k in range(20)]
    new = [(k, f"n{k}", words(k) + " more" if k < 2 else words(k + 100)) for k in range(20)]
    kept = []
    monkeypatch.setattr(renames, "cut", lambda df, name: kept.append(df) or df)
    got = renames.similar(*(spark.createDataFrame(x, "key long, path string, text string") for x in (old, new))).collect()
    assert {(x.old_path, x.new_path) for x in got} == {("o0", "n0"), ("o1", "n1")} and all(abs(x.similarity - 56 / 57) < 1e-12 for x in got)
    assert kept[0].count() == 2 * 2 * 56


@pytest.mark.parametrize("seed", [1, 2])
def test_maintained_edges(spark, seed):
    r = random.Random(seed)
    ref = lambda f: (f"{f}::m", r.choice("abcde") if r.random() < 0.8 else f"from {r.choice('xy')} import {r.choice('abcde')}, {r.choice('abcde')}", None, f, "python")
    kind = lambda x: (*x[:2], "imports" if " " in x[1] else r.choice(["calls", "inherits"]), *x[3:])
    files = {f"f{k}": ([kind(ref(f"f{k}")) for _ in range(4)], [f"f{k}::{n}" for n in r.sample("abcde", 2)]) for k in range(8)}
    after = {**files, "f1": ([kind(ref("f1"))], ["f1::e"]), "f9": ([kind(ref("f9"))], ["f9::a"])}
    del after["f2"]

    def tables(x):
        refs = spark.createDataFrame([y for v, _ in x.values() for y in v], "source_id string, ref_text string, kind string, file_path string, language string")
        symbols = spark.createDataFrame([(i, i[-1]) for _, v in x.values() for i in v], "id string, name string")
        return refs, symbols

    changed = ["f1", "f2", "f9"]
    before = resolve.by_name(*tables(files)).where(~resolve.F.substring_index("source_id", "::", 1).isin(changed))
    touched = resolve.touched(tables({k: v for k, v in files.items() if k in changed}), tables({k: v for k, v in after.items() if k in changed}))
    assert 0 < touched.count()
    key = lambda df: sorted((x.source_id, x.target_id, x.kind, x.leaf, x.resolved) for x in df.collect())
    assert key(resolve.maintained(before, *tables(after), touched)) == key(resolve.by_name(*tables(after)))
