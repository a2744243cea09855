"""Each operator on small tables: nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweave.llm import caps, chat, ctw, leaks, lines, mixing, neardup, tokens, toxicity, warc
from codeweave.llm.textcols import runs, shingles, words

R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


# --- op1


def test_warc(spark):
    big = b"x" * 1500
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", b"tiny"), (4, "http://d", b"tiny"), (5, "", None), (3, "http://c", b"tiny")]
    src = spark.createDataFrame(rows, "record_id long, uri string, payload binary").withColumn("sha256", F.lit("clash"))
    a = warc.write(src)
    got = sorted(warc.read(spark, a).collect(), key=lambda r: (r.record_id, r.record_type))
    assert [(r.record_id, r.record_type, r.refers_to) for r in got] == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (3, "response", None), (4, "response", None), (5, "response", None)]
    assert spark.read.parquet(a.payloads).count() == 3  # each payload once
    for r in got:
        head, _, block = next(warc.parse(bytes(r.record)))
        assert r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest()
        assert block.endswith(bytes(r.payload)) == (r.record_type == "response" or not r.payload)
        assert head.count("\r\nX:") == 0
    assert warc.read(spark, warc.write(src.limit(0))).count() == 0


def test_warc_files(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://x\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(bytes(r.block) == b"hello" and r.uri == "http://x" for r in got)


def test_warc_finds_damage(spark):
    src = spark.createDataFrame([(1, "u", b"payload")], "record_id long, uri string, payload binary")
    a = warc.write(src)
    bad = spark.read.parquet(a.payloads).withColumn("payload", F.lit(b"other"))
    bad.write.parquet(a.payloads + "-bad")
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, warc.Archive(a.headers, a.payloads + "-bad")).collect()


# --- op2


def test_toxicity(spark):
    bad = ["zzvile", "zzfoul"]
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        text = prose(60, k) + (f" {R.choice(bad)} " + R.choice(bad) if toxic else "")
        rows.append((k, text))
        labels.append((k, k % 3 == 0, toxic))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (901, "")], "doc_id long, text string").withColumn("p_toxic", F.lit("clash"))
    table = spark.createDataFrame([(i, int(a), int(b)) for i, a, b in labels] + [(1, None, 1)], "doc_id long, poor int, toxic int")
    chain = toxicity.train_table(docs, table, ["poor", "toxic"])
    got = {r.doc_id: r.p_toxic for r in toxicity.score(docs.drop("p_toxic"), chain, ["p_poor", "p_toxic"]).collect()}
    assert all((got[k] >= 0.5) == t for k, _, t in labels)
    assert got[900] < 0.5 and got[900] == got[901]
    assert chain[1].earlier.shape == (1,)  # the second category is fed the first's probability
    none = toxicity.train_table(docs, table.limit(0), ["poor", "toxic"])
    assert all(r.p_toxic < 0.01 for r in toxicity.score(docs.drop("p_toxic"), none, ["p_poor", "p_toxic"]).collect())
    assert toxicity.score(docs.drop("p_toxic").limit(0), chain, ["p_poor", "p_toxic"]).count() == 0


# --- op3


def kt_brute(train, tests):
    """The weighted trees by their definition, without any pruning."""
    from collections import defaultdict
    from functools import cache

    count, d = defaultdict(lambda: [0, 0]), ctw.DEPTH
    pad = lambda t: bytes([255]) * d + t.lower() + b"\xff"
    for t in map(pad, train):
        for p in range(d, len(t)):
            for bit in range(8):
                node = (1 << bit) | (t[p] >> (8 - bit))
                for k in range(d + 1):
                    count[node, t[p - k : p]][(t[p] >> (7 - bit)) & 1] += 1
    children = defaultdict(list)
    for node, context in list(count):
        if context:
            children[node, context[1:]].append((node, context))
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def weighted(n):
        own = log_kt(*count[n])
        return np.logaddexp(own, sum(map(weighted, children[n]))) - math.log(2) if children[n] else own

    def zero(node, context):
        p = None
        for k in range(d, -1, -1):
            n = (node, context[d - k :])
            if n in count:
                a, b = count[n]
                kt = (a + 0.5) / (a + b + 1)
                if p is None:
                    p = kt
                else:
                    stop = 1 / (1 + math.exp(min(700, sum(map(weighted, children[n])) - log_kt(a, b))))
                    p = stop * kt + (1 - stop) * p
        return 0.5 if p is None else p

    out = []
    for t in map(pad, tests):
        s = 0.0
        for p in range(d, len(t)):
            for bit in range(8):
                z = zero((1 << bit) | (t[p] >> (8 - bit)), t[p - d : p])
                s += math.log10(1 - z if (t[p] >> (7 - bit)) & 1 else z)
        out.append(s)
    return out


@pytest.mark.parametrize("common", [1 << 20, 40])
def test_ctw(spark, common):
    """Against the definition; with few common codes and words most come by the join."""
    texts = [(k, prose(12, k) + ("\nÄé!" if k % 5 == 0 else "")) for k in range(30)] + [(100, None), (101, ""), (102, "  "), (3, prose(12, 3)), (None, "no id")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    got = ctw.scores(spark.createDataFrame(texts, "doc_id long, text string").withColumns({"score": F.lit("clash"), "row": F.lit(1), "train": F.lit(0)}), common, common).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    got = {r.doc_id: r for r in got}
    data = [(i, (t or "").encode()) for i, t in texts]
    exact = dict(zip([i for i, _ in data], kt_brute([t for i, t in data if not held(i)], [t for _, t in data]), strict=True))
    c = Counter(w for i, t in data if not held(i) for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in data:
        w = [*t.lower().split(), None]
        assert abs(got[i].score - exact[i]) < 1e-6 * abs(exact[i])
        assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (held(i), len(w), n)
        assert got[i].n_known == sum(c[x] > 0 for x in w)
        assert abs(got[i].base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6


def test_ctw_without_training(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ctw.scores(spark.createDataFrame([(i, "ab")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.base_score, r.n_known) == (0, 0.0, 0) and abs(r.score - 24 * math.log10(0.5)) < 1e-9
    assert ctw.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ctw_sums_to_one():
    text = np.frombuffer(b"abcdefghijabcxyz" * 9, np.uint8)
    keys, _ = ctw.codes(text, np.array([0, len(text)]))
    k, n = np.unique(keys, return_counts=True)
    lower = ctw.subtrees(k, n)
    upper = ctw.top_levels(*lower[-1].above(ctw.TOP - 1))
    levels = [(x.node, x.zero, x.stop) for x in lower + upper]
    for context in (b"cdefgh", b"zzzzzz", b"\xff" * 6):
        all_bytes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp2(ctw.log2_bytes(all_bytes, levels)).sum() - 1) < 1e-9


def test_ctw_sums_merge(monkeypatch):
    r, sums, exact = np.random.default_rng(1), ctw.Sums(), Counter()
    for k in range(9):
        keys, counted = r.integers(0, 500, 400).astype(np.uint64), r.random(400) < 0.5
        sums.add(keys, None if k % 3 else counted)
        exact.update({int(x): 0 for x in keys})
        exact.update(int(x) for x, c in zip(keys, counted, strict=True) if k % 3 or c)
        if k % 2:
            sums.merge()
    sums.merge()
    assert dict(zip(sums.keys.tolist(), sums.counts.tolist(), strict=True)) == dict(exact)


# --- op4


def test_leaks(spark):
    items = [(1, prose(20, 901)), (2, prose(59, 902)), (3, "too short"), (4, None), (5, prose(20, 901))]
    near = items[1][1].split()
    near[30] = "changed"
    docs = [
        (1, prose(50, 1) + " " + items[0][1].upper() + "\n" + prose(50, 2)), (2, prose(200, 3)), (3, None), (4, ""), (5, items[1][1]), (6, prose(9, 4) + " " + " ".join(near)),
        (7, " ".join(items[0][1].split()[:10])), (2, prose(200, 3)), (8, prose(20000, 5) + " " + items[0][1]), (9, "too short"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.matches(d, b).collect()}
    assert set(got) == {(1, 1), (1, 5), (5, 2), (6, 2), (8, 1), (8, 5), (9, 3)}
    assert got[1, 1].start_word == 50 and got[1, 1].n_words == 20 and got[1, 1].similarity == 1
    assert 0.8 <= got[6, 2].similarity < 1
    assert leaks.matches(d, b.limit(0)).count() == 0 and leaks.matches(d.limit(0), b).count() == 0


def test_leaks_of_few_words(spark):
    docs = [(1, "a b c a  B"), (2, "b"), (3, "a\tb"), (4, "a"), (5, "b a"), (6, None)]
    items = [(1, "A b"), (2, "b"), (3, "c a b b"), (4, ""), (5, "a b")]
    found = leaks.matches(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in found}
    assert got == {(1, 1): (0, 2, 1.0), (1, 5): (0, 2, 1.0), (1, 2): (1, 1, 1.0), (2, 2): (0, 1, 1.0), (3, 1): (0, 2, 1.0), (3, 5): (0, 2, 1.0), (3, 2): (1, 1, 1.0), (5, 2): (0, 1, 1.0)}


def test_leaks_against_all_windows(spark):
    """Every window of every item's length, compared exactly; the words of some windows are changed."""
    r = random.Random(17)
    items = [(k, prose(n, 950 + k)) for k, n in enumerate((15, 15, 22, 40, 60))]
    docs = []
    for k in range(60):
        w = items[k % 5][1].split()
        for i in r.sample(range(len(w)), k // 5 % 3):
            w[i] = "other"
        docs.append((k, " ".join([prose(r.randrange(40), k), *w[: len(w) - (k % 7 == 0)], prose(r.randrange(40), 100 + k)])))
    want = {}
    for i, t in docs:
        w = t.lower().split()
        for item, text in items:
            own, n = text.split(), len(text.split())
            grams = lambda x: Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))
            b = grams(own)
            for s in range(len(w) - n + 1):
                a = grams(w[s : s + n])
                like = sum((a & b).values()) / sum((a | b).values())
                if like >= 0.8 and like > want.get((i, item), (0, 0))[0]:
                    want[i, item] = (like, s)
    got = {(x.doc_id, x.item_id): (x.similarity, x.start_word) for x in leaks.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_leaks_in_shorter_documents(spark):
    item = prose(50, 910).split()
    docs = [(1, " ".join(item[:46])), (2, " ".join(item[4:])), (3, " ".join(item[:41])), (4, " ".join(item[:40])), (5, " ".join(item)), (6, prose(46, 911)), (7, prose(3, 912))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = leaks.matches(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    got = {r.doc_id: (r.start_word, r.n_words, round(r.similarity, 9)) for r in found}
    assert got == {1: (0, 46, round(42 / 46, 9)), 2: (0, 46, round(42 / 46, 9)), 3: (0, 41, round(37 / 46, 9)), 5: (0, 50, 1.0)}


def test_leaks_index_finds_all_within_radius():
    r = np.random.default_rng(1)
    texts = [r.integers(0, 1 << 63, 20).astype(np.uint64) for _ in range(30)]
    items = leaks.Items(np.arange(30), texts)
    some = items.prints[r.integers(0, 30, 300)] ^ np.array([[0, 1, 2, 4]], np.uint16) ^ r.integers(0, 16, (300, 4)).astype(np.uint16)
    w, item = items.within(some)
    near = np.bitwise_count(some[:, None] ^ items.prints[None]).sum(axis=2) <= leaks.RADIUS
    assert set(zip(w.tolist(), item.tolist(), strict=True)) == set(map(tuple, np.argwhere(near).tolist()))


# --- op5


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
@pytest.mark.parametrize("high", [2, 50_000, 1 << 62])
def test_simple8b(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint64)
    ids[::3] = 0
    w, offsets = tokens.pack(ids)
    assert (tokens.unpack(w, offsets, n) == ids).all()


def test_tokens(spark):
    odd = ["a  b", "a   b\n\n  c", "\x1c !\x1c x\x85y", "  lead", "trail  \n", "", None, "a　b ​ c", "<|endoftext|> x <|endoftext|>", "it's 's  's x-y_z 12a", "é ñ  z\t\tq", prose(30000, 1)]
    rows = [(k * 3 % 13, t) for k, t in enumerate(odd)] + [(4, "again"), (4, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = [tuple(r) for r in tokens.read(tokens.write(d, f"/tmp/checkpoints/test-{R.random()}")).orderBy("start").collect()]
    library = tokens.encoder(None).tokenizer
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = tokens.read(tokens.write(d.limit(0), f"/tmp/checkpoints/test-{R.random()}"))
    assert empty.count() == 0


# --- op6


def test_chat(spark):
    turns = [("system", "a\\<|b"), ("user", "x " * 500), ("assistant", "\\i[INST]\\\\ < \\l"), ("assistant", ""), ("user|>", None), (None, "hey " * 300), ("assistant", "q [/INST] </s> <|end|>\n" * 100)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(None, None, "user", "u"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("text2", F.lit(1))
    back = chat.parse(chat.windows(c)).orderBy("conv_id", "window").collect()
    new = lambda i: [(t.role, t.text) for w in back if w.conv_id == i for t in w.turns[w.repeated :]]
    assert new(1) == [(r or "", t or "") for r, t in turns]
    assert new(None) == [("user", "u")] and new(2) == [("assistant", "same")] * 2
    assert [t for w in back if w.conv_id == 1 for t in w.targets] == [t for r, t in turns if r == "assistant" and t]
    assert all(w.turns[0].role == "system" for w in back if w.conv_id == 1)
    assert not any(x in w.text for w in back for x in ("</s>", "[INST]", "[/INST]"))
    assert chat.windows(c.limit(0)).count() == 0


def test_chat_of_null_and_negative_turns(spark):
    """Null turns first, then by number; internal names are free for other columns."""
    turns = [-3000, 5000, None, -1, 0, -(1 << 62)]
    rows = [(1, t, "user", str(t)) for t in turns]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(7) for x in ("tokens", "span", "before", "place", "chunk")})
    back = chat.parse(chat.windows(c)).orderBy("window").collect()
    assert [t.text for w in back for t in w.turns[w.repeated :]] == ["None", str(-(1 << 62)), "-3000", "-1", "0", "5000"]


# --- op7


def test_lines(spark):
    long = prose(80, 50)
    near = long.split()
    near[40] = "other"
    docs = [(1, f"Head one 12\n{long}\n\nonly one"), (2, f"head, ONE 12!\n\n{long.upper()}"), (3, " ".join(near) + "\n---"), (4, None), (5, "---\n\n  "), (6, prose(40, 51)), (6, prose(40, 51)), (-1, "head one 12"),
            (7, "Total: 1,234"), (8, "Total: 98"), (None, long), (9, ""), (10, prose(30000, 52)), (11, prose(30000, 52) + " end")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"pos": F.lit("clash"), "dropped": F.lit("clash")})
    got = {r.doc_id: r.dropped for r in lines.dropped(d).collect()}
    assert got == {1: [0], 2: [0, 2], 3: [0], 5: [0], 11: [0]}
    rows = lines.without(d, lines.dropped(d))
    assert rows.columns == d.columns and rows.count() == len(docs)
    text = {r.doc_id: r.text for r in rows.collect()}
    assert text[2] == "" and text[1] == f"{long}\n\nonly one" and text[4] is None and text[None] == long
    assert lines.dropped(d.limit(0)).count() == 0


def lines_by_definition(text):
    """(pos, words) of the lines that aren't blank."""
    out = []
    for pos, line in enumerate((text or "").split("\n")):
        low = "".join(c.lower() if c.isascii() else c for c in line)
        found = re.findall(r"[a-z0-9\x80-\U0010ffff]+", low) or re.findall(r"[^ \t-\r]+", low)
        if found:
            out.append((pos, " ".join(found)))
    return out


def test_lines_split():
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "B", "\n", " ", "é", "中", "-", "7", "\r", "...", "\n\n"]) for _ in range(r.randrange(30))) for _ in range(300)] + ["", None, "\n", "x"]
    for i, _, data, offsets in runs(pa.array(texts), 200):
        x = lines.split(data, offsets)
        want = [(i0, pos, form) for i0 in range(len(offsets) - 1) for pos, form in lines_by_definition(texts[i + i0])]
        assert [(a, b, x.form(k)) for k, (a, b) in enumerate(zip(x.row.tolist(), x.pos.tolist(), strict=True))] == want
        assert x.chars.tolist() == [len(form) for _, _, form in want]
        by = {}
        for form, h in zip([form for _, _, form in want], zip(*(v.tolist() for v in x.hashes()), strict=True), strict=True):
            assert by.setdefault(form, h) == h
        assert len(set(by.values())) == len(by)


def test_lines_within():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    r = random.Random(8)
    for _ in range(400):
        a = [r.choice("abcé") for _ in range(r.randrange(90))]
        b = list(a)
        for _ in range(r.randrange(20)):
            b[r.randrange(len(b) + 1) : r.randrange(len(b) + 1)] = r.choices("abcé", k=r.randrange(3)) if r.random() < 0.2 else b[:0]
            if b:
                b[r.randrange(len(b))] = r.choice("abcé")
        d = distance(a, b)
        for most in {0, max(0, d - 1), d, d + 1, 5}:
            assert lines.within("".join(a), "".join(b), most) == (d <= most), (a, b, d, most)


def near_lines():
    """Lines of 1 to 130 words, each with copies: a word added, a word or a tenth of the words or 3 % of the characters changed."""
    r, out = random.Random(21), []
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    for n in (1, 2, 3, 6, 10, 20, 23, 24, 25, 40, 48, 80, 96, 130):
        for _ in range(12):
            w = [r.choice(vocabulary) for _ in range(n)]
            out += [w, [*w, r.choice(vocabulary)]]
            for many in (1, max(1, n // 10)):
                near = list(w)
                for i in r.sample(range(n), many):
                    near[i] = r.choice(vocabulary)
                out.append(near)
            c = list(" ".join(w))
            for i in r.sample(range(len(c)), max(1, len(c) * 3 // 100)):
                c[i] = r.choice("abcdefghij")
            out.append("".join(c).split())
    return sorted({" ".join(x) for x in out})


def test_lines_possible_loses_no_pair():
    r = random.Random(11)
    a, b, most = [], [], []
    for letters in ("ab", "abcdefghijklmnop ", "aß日𝒳 é"):
        for n in (0, 1, 2, 5, 40, 200):
            for edits in (0, 1, 3, 9):
                x = [r.choice(letters) for _ in range(n)]
                y = list(x)
                for _ in range(edits):
                    at, kind = r.randrange(len(y) + 1), r.randrange(3)
                    y[at : at + (kind > 0)] = [r.choice(letters)] if kind < 2 else []
                a.append("".join(x))
                b.append("".join(y))
                most.append(edits)
    assert lines.possible(a, b, np.array(most)).all()
    assert lines.near(a, b, most).all()
    few = [k for k in range(len(a)) if len(a[k]) <= 64]
    for k, d in zip(few, lines.distances([a[k] for k in few], [b[k] for k in few]).tolist(), strict=True):
        assert lines.within(a[k], b[k], d) and (not d or not lines.within(a[k], b[k], d - 1)), (a[k], b[k], d)
        assert lines.near([a[k]], [b[k]], [d]).all() and not (d and lines.near([a[k]], [b[k]], [d - 1]).any())
    far = ["one line about the weather of the north", "some other words, cut from a quite different page"]
    assert lines.possible(far[:1], far[1:], np.array([9])).tolist() == [False]
    assert lines.possible([""], [""], np.array([0])).tolist() == [True]
    assert lines.distances([], []).tolist() == [] and lines.near([], [], []).tolist() == []
    assert lines.distances(["", "a" * 64], ["abc", "b" + "a" * 64]).tolist() == [3, 1]


def test_lines_recall(spark):
    texts = near_lines()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    a, b = d.toDF("a", "fa"), d.toDF("b", "fb")
    close = (F.length("fa") * 5 >= F.length("fb") * 4 - 5) & (F.length("fb") * 5 >= F.length("fa") * 4 - 5)  # else the distance is too large
    similar = a.join(b, (F.col("a") < F.col("b")) & close).where("levenshtein(fa, fb, int(floor(greatest(length(fa), length(fb)) * 0.2 + 1e-9))) >= 0")
    pairs = [(r.a, r.b) for r in similar.select("a", "b").collect()]
    met = {}
    for r in lines.tabled(d).join(lines.fingerprinted(d), "h1").collect():
        met.setdefault(r.doc_id, set()).add(r.key >> lines.LENGTH_BITS)
    found = [bool(met[x] & met[y]) for x, y in pairs]
    print("recall", len(pairs), sum(found) / len(found))
    by = {}
    for (x, y), f in zip(pairs, found, strict=True):
        by.setdefault(min(9, len(texts[x].split()) // 12), []).append(f)
    assert len(pairs) > 700
    assert sum(found) >= 0.95 * len(found)
    assert all(sum(v) >= 0.9 * len(v) for v in by.values())
    # Groups by all pairs: lines dropped against those that a full comparison drops.
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in pairs:
        p, q = top(x), top(y)
        up[max(p, q)] = min(p, q)
    want = {x for x in range(len(texts)) if top(x) != x}
    got = {r.doc_id for r in lines.dropped(d).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("words, times", [(6, 6), (40, 1)])
def test_lines_of_common_words_are_seldom_compared(spark, monkeypatch, words, times):
    """Unlike lines that share their common words only; pairs must not grow with the square of their number."""
    r, some = random.Random(31), "of the in and to on".split()
    rare = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    texts = [" ".join(f"{rare()} {' '.join(r.choices(some, k=2))}" for _ in range(words // 3)) for _ in range(2000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    compared, real = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    assert lines.dropped(d).count() == 0
    assert sum(compared) < times * len(texts)


@pytest.mark.parametrize("n", [24, 48, 96])
def test_lines_a_word_longer(spark, n):
    rows = [(2 * k + j, prose(n, 700 + k) + " appended" * j) for k in range(40) for j in (0, 1)]
    got = {r.doc_id for r in lines.dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {2 * k + 1 for k in range(40)} and len(got) >= 39


# --- op8


def test_mixing(spark):
    rows = [(k, ["a", "b", "c", None][k % 4] if k % 3 else "a", k % 50 if k % 7 else 0) for k in range(4000)] + [(1, "a", 5)] * 2
    sized = spark.createDataFrame(rows, "doc_id long, source string, mix_size long").withColumn("cut", F.lit("clash"))
    plan = mixing.plan(sized, shards=8)
    got = mixing.apply(sized.withColumn("mix_target", F.lit(1)), plan).collect()
    again = mixing.apply(sized, mixing.plan(sized, shards=8)).collect()
    key = lambda r: (r.doc_id, str(r.source), r.mix_size)
    assert sorted(map(str, sorted(got, key=key))) == sorted(map(str, sorted(again, key=key)))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.mix_size
        taken[r.source] += r.mix_size * len(r.mix_copies)
        target[r.source] = r.mix_target
        assert len(r.mix_copies) <= 2
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 50
    shards = Counter(c.shard for r in got for c in r.mix_copies)
    assert set(shards) <= set(range(8))
    assert mixing.apply(sized.limit(0), mixing.plan(sized.limit(0))).count() == 0


def test_splitting_keeps_quotas(spark):
    q = spark.createDataFrame([("a", 100), ("b", 7), ("c", 0)], "mix_key string, n long")
    got = mixing.split(q, 6, 1).toPandas()
    assert got.groupby("mix_key").n.sum().to_dict() == {"a": 100, "b": 7, "c": 0}
    assert got.groupby("shard").n.sum().between(17, 19).all() and (got.n >= 0).all()


# --- op9


def sets(text):
    data = np.frombuffer(text.encode(), np.uint8)
    h, _, first = words(data, np.array([0, len(data)]))
    return np.sort(shingles(h, first)[0])


def test_neardup(spark):
    rows = []
    for k in range(12):
        text = prose(120, k).split()
        for c in range(6):
            rows.append((k * 100 + c, " ".join(text)))
            text[R.randrange(120)] = f"edit{k}{c}"
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, "one two"), (5004, "One  two"), (5005, prose(40000, 77)), (5006, prose(40000, 77)), (100, rows[6][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = {r.doc_id: r.class_id for r in neardup.classes(d).collect()}
    by = {i: sets(t or "") for i, t in rows}
    up = {i: i for i in by}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(by)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if neardup.probability_jaccard(by[a], by[b]) >= 0.8:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in by}
    assert neardup.classes(d.limit(0)).count() == 0


def test_probability_jaccard():
    def brute(x, y):
        total = 0.0
        for i in set(x) & set(y):
            total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y))
        return total

    for k in range(20):
        r = random.Random(k)
        a, b = ([r.randrange(8) for _ in range(r.randrange(1, 20))] for _ in range(2))
        got = neardup.probability_jaccard(np.sort(np.array(a, np.uint64)), np.sort(np.array(b, np.uint64)))
        assert abs(got - brute(Counter(a), Counter(b))) < 1e-12


# --- op10


def test_caps(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((30, 24))
    rows = []
    for k in range(300):
        v = base[k % 30] + 0.09 * r.standard_normal(24)
        rows.append((k, int(k % 30 > 9), v.tolist()))
    rows += [(400, 0, rows[0][2]), (401, 0, [2 * x for x in rows[0][2]]), (402, None, rows[0][2]), (403, 0, None), (404, 0, [0.0] * 24), (405, 0, [float("nan")] * 24), (406, 0, [None, 1.0]), (407, 0, [1.0, 2.0]), (408, 0, [])]
    d = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumn("caps", F.lit("clash"))
    got = {x.vec_id: (x.n_links, x.component_id) for x in caps.similar(d).collect()}
    assert len(got) == len(rows)
    good = [(i, lab, np.array(v) / np.linalg.norm(v)) for i, lab, v in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {(a[0], b[0]) for n, a in enumerate(good) for b in good[n + 1 :] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] >= 0.98}
    n = Counter(x for p in links for x in p)
    found = sum(v[0] for v in got.values()) / 2
    assert found >= 0.98 * len(links) and all(got[i][0] <= n[i] for i in got)
    assert got[402] == (0, 402) and got[404] == (0, 404) and got[406] == (0, 406)
    assert got[400][1] == got[0][1]
    assert caps.similar(d.limit(0)).count() == 0


def test_caps_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.001]), (None, [0.0, -1.0]), (7, [0.001, -1.0]), (1, [1.0, 0.0])]
    d = spark.createDataFrame([(i, 0, [*v, *[0.0] * 14]) for i, v in rows], "vec_id long, label int, vector array<double>").coalesce(1)
    got = sorted(map(tuple, caps.similar(d).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (2, 2, 1), (3, 1, 1), (None, 1, None), (None, 1, None), (None, 1, 7), (7, 1, 7), (1, 2, 1)], key=str)


def test_caps_of_64_components_in_large_buckets(spark):
    """All links within one label, where a bucket has more members than a block: recall against brute force."""
    r = np.random.default_rng(8)
    base = r.standard_normal((6, 64))
    x = np.concatenate([b + (0.1 if k else 0.03) * r.standard_normal((700 if not k else 60, 64)) for k, b in enumerate(base)])
    ids = r.permutation(len(x)) // 2  # every id twice
    d = spark.createDataFrame([(int(i), 1, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, label int, vector array<double>").coalesce(1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.98).sum(axis=1) - 1).tolist()
    got = Counter((v.vec_id, v.n_links) for v in caps.similar(d).collect())
    assert sum(n for _, n in got.elements()) >= 0.9 * sum(want) and sum(n for _, n in got.elements()) <= sum(want)
    assert sum(got.values()) == len(x) and max(want) > caps.BLOCK
