"""URL filter: parts and rules against plain Python, trees against a numpy version, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://NET/", "https://a.Net/x?u=http://org/fr/", "http://example.net/en/", "http://example.net/en", "ftp://x.example.net/en/1#a/b",
    "http://notexample.net/en/", "http://example.com/de/", "http://example.com/DE/", "http://m.example.com:80/de/", "http://org/fr/", "http://a.b.c.org/fr/x?y", "http://xorg/fr/", "http://org?fr/",
    "//example.com/de/", "x://y://z/w", "http://a.net", "http://.net/", "http://ärger.org/fr/ü", "http://ex\nample.com/de/\nx?q", "http://u@example.com/de/", "http://" + "a." * 5000 + "net/" + "9" * 100_000,
]


def parts(url):
    _, mark, rest = (url or "").partition("://")
    ends = lambda s, marks: min([s.find(m) for m in marks if m in s], default=len(s))
    host = rest[: ends(rest, "/?#")]
    tail = rest[len(host) :]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[: ends(tail, "?#")]


def decided(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), r.text), default=None)


def entropy(s):
    return sum(-n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def test_parts_rules_and_features(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)], "page_id long, url string, url_facts_hit string").withColumns({"Host": F.lit(1), "rule": F.lit("clash")})
    rules = [*urls.RULES, urls.rule("a.net/", "allow"), urls.rule("b.c.org/fr/x", "block"), urls.rule("example.com/de/", "block")]
    x = urls.lexical(F.col("url"))
    got = {r.page_id: r for r in urls.judge(df, rules, urls.Model()).collect()}
    facts = {r.page_id: r for r in df.select("page_id", *[c.alias(f) for f, c in x.items()]).collect()}
    for k, u in enumerate(URLS):
        host, path = parts(u)
        r = decided(host, path, rules)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, r.text if r else None)
        assert got[k].verdict == (r.verdict if r else "allow") and (got[k].probability is None) == bool(r)
        u = u or ""
        assert facts[k].length == len(u) and facts[k].depth == path.count("/") and abs(facts[k].entropy - entropy(u)) < 1e-9
        assert facts[k].digits == pytest.approx(sum(c in "0123456789" for c in u) / max(1, len(u)))
    assert facts[6].parameters == 1 and urls.judge(df.limit(0), rules, urls.Model()).count() == 0


def made(n, seed):
    """Blocked: many digits and parameters, or a bad suffix."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        bad = r.random() < 0.4
        kind = r.random()
        name = "".join(r.choice("abcdefgh") for _ in range(6))
        tld = r.choice(["example", "test"]) if not bad or kind < 0.6 else "invalid"
        tail = "".join(r.choice("0123456789") for _ in range(18)) + "?" + "&".join(f"k{j}={j}" for j in range(5)) if bad and kind < 0.6 else "/".join(r.choice(["news", "page", "about"]) for _ in range(r.randrange(1, 4)))
        out.append((f"http://{name}.{tld}/{tail}", int(bad)))
    return out


def test_held_out_accuracy_and_reruns(spark):
    train, test = made(1200, 1), made(400, 2)
    rows = [*train, *train[:50], (None, 1), ("http://x/", None), ("http://y/", 7)]
    fitted = urls.fit(spark.createDataFrame(rows, "url string, label int"))
    again = urls.fit(spark.createDataFrame(rows[::-1], "url string, label int").repartition(5))
    assert fitted.trees == again.trees and fitted.base == again.base
    got = urls.judge(spark.createDataFrame(test, "url string, label int"), [], fitted).collect()
    assert np.mean([(r.verdict == "block") == bool(r.label) for r in got]) > 0.95


def brute(bins, pos, neg, trees, depth):
    """Boosted trees over cut numbers, from the definition."""
    base = math.log((pos.sum() + 0.5) / (neg.sum() + 0.5))
    f = np.full(len(bins), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        node = np.zeros(len(bins), int)
        score = lambda at: g[at].sum() ** 2 / (h[at].sum() + urls.RIDGE)
        for _ in range(depth):
            new = node * 2
            for k in np.unique(node):
                at = node == k
                best = max((round(score(at & (bins[:, j] <= c)) + score(at & (bins[:, j] > c)) - score(at), 6), -j, -c) for j in range(bins.shape[1]) for c in np.unique(bins[at, j]))
                if best[0] > 1e-6:
                    new[at & (bins[:, -best[1]] > -best[2])] += 1
            node = new
        for k in np.unique(node):
            at = node == k
            f[at] += urls.RATE * g[at].sum() / (h[at].sum() + urls.RIDGE)
    return f


def test_trees_against_numpy(spark):
    r = np.random.default_rng(5)
    bins = np.unique(r.integers(0, 5, (60, len(urls.FEATURES))), axis=0)
    pos, neg = r.integers(0, 9, len(bins)) + 5 * (bins[:, 2] > 2), r.integers(0, 9, len(bins)) + 4 * (bins[:, 0] < 2)
    table = spark.createDataFrame([(*map(int, b), int(p), int(n)) for b, p, n in zip(bins, pos, neg, strict=True)], ", ".join(f"{f} int" for f in urls.FEATURES) + ", pos long, neg long").coalesce(1)
    model = urls.Model(base=math.log((pos.sum() + 0.5) / (neg.sum() + 0.5)))
    for _ in range(3):
        model.trees.append(urls._tree(table, model))
    got = {tuple(r[:-1]): r[-1] for r in table.select(*urls.FEATURES, model.margin({f: F.col(f) for f in urls.FEATURES}).alias("m")).collect()}
    want = brute(bins, pos, neg, 3, urls.DEPTH)
    assert all(abs(got[tuple(map(int, b))] - w) < 1e-5 for b, w in zip(bins, want, strict=True))


def test_one_class_and_none(spark):
    df = spark.createDataFrame([("http://a.b/c",), (None,)], "url string")
    for label, verdict in ((1, "block"), (0, "allow")):
        model = urls.fit(spark.createDataFrame([("http://a.b/c", label), ("http://d.e/f", label)], "url string, label int"))
        assert {r.verdict for r in urls.judge(df, [], model).collect()} == {verdict}
    assert {r.verdict for r in urls.judge(df, [], urls.fit(spark.createDataFrame([], "url string, label int"))).collect()} == {"allow"}


def test_many_suffixes_are_joined_salted(spark, monkeypatch):
    """A join with salted keys gives what a broadcast gives."""
    labelled = spark.createDataFrame(made(300, 3), "url string, label int")
    model = urls.fit(labelled)
    key = lambda rows: sorted((r.url, r.verdict, round(r.probability, 12)) for r in rows.collect())
    want = key(urls.judge(labelled, [], model))
    monkeypatch.setattr(urls.shared, "small", lambda df, limit=0: df)
    assert key(urls.judge(labelled, [], model)) == want
