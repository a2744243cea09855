"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision, told by the bits before it in its byte, has a context tree over the
bytes before: the node at depth d stands for the d last bytes and keeps how often a 0 and a 1 followed. Its
Krichevsky-Trofimov (KT) probability of those is Pe; its weighted probability is half Pe and half the product of its
children's weighted probabilities (Pe alone at the greatest depth). A new bit's probability mixes the KT estimates
(n0 + 1/2) / (n + 1) of all depths of its path by what training made of these halves; a path ends at its last node that
training met. log2 over a text's bits, with an end symbol (byte 0xFF, not in UTF-8) before and after it, is its code length.

The whole tree is kept, however large the corpus is; it is never in one place.

1. A code is a byte with the DEPTH bytes before it. Tasks count the codes of all texts (those of texts that are held out
   with 0) and the words of the training texts; sums are by key.
2. The subtrees below the nodes of depth TOP have nothing in common, so codes are dealt out by their TOP last bytes and
   every task works on whole subtrees. A first pass makes the nodes of depth TOP; those above (at most 2**24 contexts and
   decisions at any size, as TOP - 1 is two bytes) are made from their sums and are a small file. A second pass walks the paths of every code and gives its
   log2 probability.
3. Texts add up the values of their codes. The COMMON most frequent codes and COMMON_WORDS words are a file of bounded
   size that each worker loads; the rest of a text's codes and words are joined to the table of all values by key.

Scores are of the text with A-Z in lower case; logarithms are to base 10.

Defined results: a null text is empty (one end token); a null id is held in training; every row keeps its own row,
repeated ones too; without training tokens base_score is 0 and every bit costs one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import shared
from codeweave.llm.textcols import GOLD, LOWER, runs, words

DEPTH, TOP = 6, 3
#: What each worker has at hand: at most so many codes and words.
COMMON, COMMON_WORDS = 1 << 21, 1 << 20
END = 0xFF
GRAM, WORD = 0, 1
#: Different keys that a task counts before it passes them on.
HELD = 3_000_000
SLICE = 1 << 16


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each byte of each text and its end, with the DEPTH bytes before it, as one number; first of each text and the count)."""
    rows = len(offsets) - 1
    n = len(data) + rows * (DEPTH + 1)
    padded = np.full(n, END, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded[np.arange(len(data)) + row * (DEPTH + 1) + DEPTH] = LOWER[data]
    two = padded[:-1].astype(np.uint16) << np.uint16(8) | padded[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    m = n - DEPTH
    code = four[:m].astype(np.uint64) << np.uint64(24) | (two[4 : 4 + m].astype(np.uint32) << np.uint32(8) | padded[6:])
    size = np.diff(offsets) + 1
    at = np.concatenate([[0], np.cumsum(size)])
    # The windows that would end in the padding of the next text are left out.
    begin = np.repeat(np.arange(rows) * DEPTH, size) + np.arange(at[-1])
    return code[begin], at


class Sums:
    """Counts by key: a sorted table, and keys that are new to it until there are many."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def add(self, keys: np.ndarray, counted: np.ndarray | None = None) -> None:
        """counted: which keys count; the others are met 0 times."""
        order = np.argsort(keys, kind="stable") if counted is not None else None
        k = np.sort(keys) if order is None else keys[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(k))) if order is None or not len(k) else np.add.reduceat(counted[order].astype(np.int64), first)
        k = k[first]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            known = self.keys[at] == k
            self.counts[at[known]] += n[known]
            k, n = k[~known], n[~known]
        self.new.append((k, n))
        self.fresh += len(k)
        if self.fresh > max(1 << 19, len(self.keys) // 2):
            self.merge()

    def merge(self) -> None:
        k = np.concatenate([self.keys, *(x for x, _ in self.new)])
        n = np.concatenate([self.counts, *(x for _, x in self.new)])
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.keys, self.counts = k[first], np.add.reduceat(n, first) if len(k) else n
        self.new, self.fresh = [], 0


def _place(kind: int, keys: np.ndarray) -> np.ndarray:
    """What a key is dealt out by: a code by its subtree, a word by itself."""
    return (keys >> np.uint64(8)) & np.uint64((1 << (8 * TOP)) - 1) if kind == GRAM else keys


def counts(docs: DataFrame) -> DataFrame:
    """docs (text, train) → (place, kind, key, n): codes and words with their training counts; the end token's key is 0."""

    def out(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), SLICE):
            k = keys[i : i + SLICE]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (_place(kind, k).view(np.int64), np.full(len(k), kind, np.int32), k.view(np.int64), n[i : i + SLICE])], ["place", "kind", "key", "n"]
            )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {GRAM: Sums(), WORD: Sums()}
        ends = 0
        for batch in batches:
            train = batch["train"].to_numpy(zero_copy_only=False)
            for i, j, data, offsets in runs(batch["text"]):
                code, at = codes(data, offsets)
                mine = train[i:j]
                sums[GRAM].add(code, None if mine.all() else np.repeat(mine, np.diff(at)))
                h, row, _ = words(data, offsets)
                sums[WORD].add(h if mine.all() else h[mine[row]])
                ends += int(mine.sum())
                for kind, s in sums.items():
                    if len(s.keys) > HELD:
                        s.merge()
                        yield from out(kind, s.keys, s.counts)
                        sums[kind] = Sums()
        for kind, s in sums.items():
            s.merge()
            yield from out(kind, s.keys, s.counts)
        yield from out(WORD, np.zeros(1, np.uint64), np.array([ends]))

    # Fewer, larger tasks send fewer copies of what they all count.
    docs = docs.select("text", "train")
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 4)
    rows = docs.coalesce(tasks).mapInArrow(shared.lean(each), "place long, kind int, key long, n long")
    # The sums of a task's keys can't shrink further before they are dealt out.
    return rows.repartition("place").groupBy("place", "kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    return s - np.log(low)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth in order of their numbers: the context's bytes, and a 1 before the bits of the byte so far.

    zero: the KT estimate of a 0; stop: the weight of stopping here against going deeper; log: the weighted probability.
    """

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deep: np.ndarray | None):
        """deep: sums of the children's log, None at the greatest depth."""
        self.node, self.zeros, self.ones = node, zeros, ones
        self.zero = (zeros + 0.5) / (zeros + ones + 1)
        self.log, self.stop = _log_kt(zeros, ones), np.ones(len(node))
        if deep is not None:
            self.stop = 1 / (1 + np.exp(np.clip(deep - self.log, -700, 700)))
            self.log = np.logaddexp(self.log, deep) - math.log(2)

    def above(self, depth: int) -> tuple[np.ndarray, ...]:
        """(node, zeros, ones, deep) of the nodes over these, at `depth`."""
        up = (self.node >> np.uint64(8) & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8) | self.node & np.uint64(255)
        node, at = np.unique(up, return_inverse=True)
        return node, *(np.bincount(at, weights=x, minlength=len(node)).astype(float) for x in (self.zeros, self.ones, self.log))


def _prefix(code: np.ndarray, bit: int) -> np.ndarray:
    return np.uint64(1 << bit) | ((code & np.uint64(255)) >> np.uint64(8 - bit))


def subtrees(code: np.ndarray, n: np.ndarray) -> list[Level]:
    """Different codes of whole subtrees with their counts → the levels of depth DEPTH to TOP."""
    code, n = code[n > 0], n[n > 0].astype(float)
    number = np.concatenate([(code >> np.uint64(8)) << np.uint64(8) | _prefix(code, bit) for bit in range(8)])
    one = np.concatenate([(code >> np.uint64(7 - bit)) & np.uint64(1) for bit in range(8)]).astype(bool)
    node, at = np.unique(number, return_inverse=True)
    n8 = np.tile(n, 8)
    ones = np.bincount(at, weights=n8 * one, minlength=len(node)).astype(float)
    levels = [Level(node, np.bincount(at, weights=n8, minlength=len(node)) - ones, ones, None)]
    for depth in range(DEPTH - 1, TOP - 1, -1):
        levels.append(Level(*levels[-1].above(depth)))
    return levels


def top_levels(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deep: np.ndarray) -> list[Level]:
    """The nodes of depth TOP - 1, with the sums of their children's logs → the levels from there to the root."""
    order = np.argsort(node)
    levels = [Level(node[order], zeros[order].astype(float), ones[order].astype(float), deep[order])]
    for depth in range(TOP - 2, -1, -1):
        levels.append(Level(*levels[-1].above(depth)))
    return levels


def log2_bytes(code: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log2 of each code's byte after its context; levels: (node, zero, stop) of every depth from DEPTH to 0."""
    out = np.zeros(len(code))
    context = code >> np.uint64(8)
    for bit in range(8):
        prefix = _prefix(code, bit)
        # From the last node that training met up to the root, mixed with each one's above.
        p, below = np.full(len(code), 0.5), np.zeros(len(code), bool)
        for depth, (node, zero, stop) in zip(range(DEPTH, -1, -1), levels, strict=True):
            if not len(node):
                continue
            number = (context & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8) | prefix
            at = np.minimum(np.searchsorted(node, number), len(node) - 1)
            met = node[at] == number
            z, s = zero[at], stop[at]
            p = np.where(met, np.where(below, s * z + (1 - s) * p, z), p)
            below |= met
        one = (code >> np.uint64(7 - bit)) & np.uint64(1) == 1
        out += np.log2(np.where(one, 1 - p, p))
    return out


def in_subtrees(grams: DataFrame) -> DataFrame:
    """The codes, with those of a subtree side by side."""
    return grams.select("place", "key", "n").repartition("place").sortWithinPartitions("place")


def tops(grams: DataFrame) -> list[Level]:
    """grams (place, key, n) → the levels above TOP; their rows are at most 2**16 contexts' at any size of the corpus."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.grouped(batches, "place"):
            last = subtrees(batch["key"].to_numpy().view(np.uint64), batch["n"].to_numpy())[-1]
            node, zeros, ones, deep = last.above(TOP - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node.view(np.int64), zeros, ones, deep)], ["node", "zeros", "ones", "deep"])

    rows = in_subtrees(grams).mapInArrow(shared.lean(each), "node long, zeros double, ones double, deep double")
    got = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "deep")]).toArrow().combine_chunks()
    return top_levels(got["node"].to_numpy().view(np.uint64), *(got[c].to_numpy() for c in ("zeros", "ones", "deep")))


def _top(arrays: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [tuple(arrays[f"{c}{d}"] for c in ("node", "zero", "stop")) for d in range(TOP - 1, -1, -1)]


def values(grams: DataFrame, top: str) -> DataFrame:
    """grams (place, key, n) and the file of the levels above → (key, n, log2)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.loaded(top, _top)
        for batch in shared.grouped(batches, "place"):
            code = batch["key"].to_numpy().view(np.uint64)
            lower = [(x.node, x.zero, x.stop) for x in subtrees(code, batch["n"].to_numpy())]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n"], pa.array(log2_bytes(code, lower + upper))], ["key", "n", "log2"])

    return in_subtrees(grams).mapInArrow(shared.lean(each), "key long, n long, log2 double")


class Table:
    """Open addressing from 64-bit keys to values; keys that it doesn't have are found to be so."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        values, keys = values[keys != self.EMPTY], keys[keys != self.EMPTY]
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, values.dtype)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[slot] == self.EMPTY
            self.key[slot[free]] = keys[todo[free]]
            self.value[slot[free]] = values[todo[free]]
            left = self.key[slot] != keys[todo]
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys * GOLD
        return ((x ^ x >> np.uint64(32)) * GOLD >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether the key is there)."""
        slot = self._slot(keys)
        held = self.key[slot]
        out, known = self.value[slot], held == keys
        todo = np.flatnonzero(~known & (held != self.EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            held = self.key[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.value[slot[hit]]
            known[todo[hit]] = True
            more = ~hit & (held != self.EMPTY)
            todo, slot = todo[more], slot[more]
        return out, known


def _tables(arrays: dict[str, np.ndarray]) -> tuple[Table, Table]:
    return Table(arrays["code"], arrays["log"]), Table(arrays["word"], arrays["word_log"])


def _often() -> Column:
    """An eighth of a power of two: the steps by which the most frequent keys are told."""
    return F.when(F.col("n") > 0, F.floor(F.log2("n") * 8)).otherwise(-1)


def _least(table: DataFrame, most: int) -> int:
    """The least step such that at most `most` keys are at it or above."""
    steps = sorted(table.groupBy(_often().alias("step")).count().collect(), key=lambda r: -r.step)  # 512 rows at most
    least, held = steps[0].step + 1 if steps else 0, 0
    for r in steps:
        held += r["count"]
        if held > most:
            break
        least = r.step
    return least


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


RARE = pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("times", pa.int32())])


def _apart(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, times) of the different pairs, by row."""
    order = np.lexsort((keys, row))
    r, k = row[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[new], k[new], np.diff(np.append(new, len(r)))


def scores(docs: DataFrame, common: int = COMMON, common_words: int = COMMON_WORDS) -> DataFrame:
    """docs (doc_id, text) → doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = docs.sparkSession
    shared.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = shared.stored(counts(docs.withColumn("train", ~held_out())), "ctw-counts")
    grams, vocabulary = table.where(F.col("kind") == GRAM), table.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    base = math.log10(total.n + 0.1 * (total.v + 1)) if total.n else 0.0

    upper = {f"{c}{d}": getattr(x, c) for d, x in zip(range(TOP - 1, -1, -1), tops(grams), strict=True) for c in ("node", "zero", "stop")}
    known = shared.stored(values(grams, shared.put_arrays(shared.place(spark, "ctw-top"), upper)), "ctw-values").withColumn("step", _often())
    vocabulary = vocabulary.withColumn("step", _often())
    least, least_word = _least(known, common), _least(vocabulary, common_words)
    here = known.where(F.col("step") >= least).select("key", F.col("log2").cast("float").alias("log2")).toArrow().combine_chunks()
    here_words = vocabulary.where(F.col("step") >= least_word).select("key", "n").toArrow().combine_chunks()
    name = shared.put_arrays(
        shared.place(spark, "ctw-common"),
        {
            "code": here["key"].to_numpy().view(np.uint64),
            "log": here["log2"].to_numpy(),
            "word": here_words["key"].to_numpy().view(np.uint64),
            "word_log": np.log10(here_words["n"].to_numpy() + 0.1) - base,
        },
    )
    del here, here_words, upper

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_code, by_word = shared.loaded(name, _tables)
        for batch in batches:
            for i, j, data, offsets in runs(batch["text"], 1 << 19):
                code, at = codes(data, offsets)
                value, found = by_code.find(code)
                score = np.add.reduceat(np.where(found, value, 0).astype(float), at[:-1])
                lost = np.flatnonzero(~found)
                gram = _apart(np.searchsorted(at, lost, "right") - 1, code[lost])
                h, row, first = words(data, offsets)
                h, row = np.concatenate([h, np.zeros(j - i, np.uint64)]), np.concatenate([row, np.arange(j - i)])  # and the end tokens
                value, found = by_word.find(h)
                mine = np.bincount(row[found], weights=value[found], minlength=j - i).astype(float)
                n_known = np.bincount(row[found], minlength=j - i)
                word = _apart(row[~found], h[~found])
                r = np.concatenate([gram[0], word[0]])
                order = np.argsort(r, kind="stable")
                kind = np.repeat(np.array([GRAM, WORD], np.int32), [len(gram[0]), len(word[0])])
                parts = [kind, np.concatenate([gram[1], word[1]]).view(np.int64), np.concatenate([gram[2], word[2]]).astype(np.int32)]
                rare = pa.StructArray.from_arrays([pa.array(x[order]) for x in parts], fields=list(RARE))
                cut = np.searchsorted(r[order], np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(i, j - i) for c in ("row", "doc_id")), *(pa.array(x) for x in (np.diff(first) + 1, n_known, mine, score, np.diff(offsets))), pa.ListArray.from_arrays(cut, rare)],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "n_bytes", "rare"],
                )

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<struct<kind:int,key:long,times:int>>"
    made = shared.stored(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(shared.lean(each), schema), "ctw-texts")
    rest = known.where(F.col("step") < least).select(F.lit(GRAM).alias("kind"), "key", F.col("log2").alias("value"))
    rest = rest.unionByName(vocabulary.where(F.col("step") < least_word).select(F.lit(WORD).alias("kind"), "key", (F.log10(F.col("n") + 0.1) - base).alias("value")))
    rare = made.select("row", F.inline("rare")).join(rest, ["kind", "key"], "left")
    is_word = F.col("kind") == WORD
    # Every code of the corpus has a value; a word that training doesn't have counts 0 times.
    more = rare.groupBy("row").agg(
        F.sum(F.when(~is_word, F.col("times") * F.col("value"))).alias("more_score"),
        F.sum(F.when(is_word, F.col("times") * F.coalesce("value", F.lit(-1.0 - base)))).alias("more_base"),
        F.sum(F.when(is_word & F.col("value").isNotNull(), F.col("times"))).alias("more_known"),
    )
    rows = made.drop("rare").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        plus("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (plus("base", "more_base") if total.n else F.lit(0.0)).alias("base_score"),
        (plus("score", "more_score") * math.log10(2)).alias("score"),
        "n_bytes",
    )


def op3_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(shared.table(spark, sf_dir, "documents"))
