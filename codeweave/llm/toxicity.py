"""A classifier chain for toxicity categories.

Categories are labelled columns in a fixed order. The model of each is a logistic regression over the text's
features and the probabilities of the categories before it. Those inputs are out-of-fold predictions in training:
for every category, k models are fitted without one fold each, and the later models see only what a model said of
rows it had not seen; a last fit over all folds scores new texts.

Features are hashed: whole words, the first 3 to 6 bytes of words (A-Z in lower case) and, in words of more than LONG
bytes, all pairs of neighbouring characters that begin with one of several bytes (scripts without spaces); present or not.
Of all hashed features, those whose rates in the two classes differ most in standard errors are kept for a category;
the linear models weigh only these, so what a long text has in plenty stays out of the sum.

Training rows are a bounded sample: `sample` labelled rows (default 12000), lowest hash of doc_id first. Only their
feature numbers reach the driver. Scoring covers every whole text.

Defined results: a null text is empty and gets the intercepts' probabilities; rows with a null label are not trained
on; with no row of some category's either class its probability is the constant base rate (0 without labels);
ids may repeat; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweave.llm import shared
from codeweave.llm.textcols import BYTE, LOWER, mix, powers, runs

BITS = 20
SAMPLE = 12_000
FOLDS = 5
KEEP = 1536
MIN_Z = 4.5
PREFIXES = (3, 4, 5, 6)
#: Words of more bytes give their pairs of characters of several bytes, too.
LONG = 24
#: A text is rejected from this probability of the last category on.
REJECT = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) of a run of texts, each pair once."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    # Letters, digits and bytes of longer characters make words here; all else parts them.
    inside = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    start = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    end = np.flatnonzero(stops) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    # A hash of any stretch of bytes comes from sums over all before its ends.
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[low] * power[:n], out=total[1:])
    part = lambda a, b: mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
    length = end - start
    parts = [(row, part(start, end) ^ np.uint64(0x5555555555555555))]
    for k in PREFIXES:
        more = length >= k
        parts.append((row[more], part(start[more], start[more] + k)))
    # Scripts without spaces: a long word's pairs of characters, all along it.
    long = length > LONG
    if long.any():
        first = np.flatnonzero((low & 0xC0) != 0x80)
        word = np.searchsorted(start, first, "right") - 1
        third = np.append(first[2:], [n, n])[: len(first)]
        ok = (word >= 0) & long[word] & (third <= end[word]) & (low[first] >= 128)
        parts.append((row[word[ok]], part(first[ok], third[ok]) ^ np.uint64(0x3333333333333333)))
    rows = np.concatenate([r for r, _ in parts])
    number = (mix(np.concatenate([x for _, x in parts])) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = np.unique((rows << BITS) | number)
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Linear:
    """weight by feature number (0 where not kept), weights of the earlier categories, intercept."""

    kept: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray
    intercept: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse binary rows: feature numbers sorted by row, both in 32 bits."""

    def __init__(self, row: np.ndarray, number: np.ndarray, n: int):
        self.row, self.number, self.n = row, number, n

    def take(self, chosen: np.ndarray) -> Rows:
        to = np.full(self.n, -1, np.int32)
        to[chosen] = np.arange(len(chosen), dtype=np.int32)
        row = to[self.row]
        keep = row >= 0
        return Rows(row[keep], self.number[keep], len(chosen))

    def common(self, least: int) -> Rows:
        """Without features of fewer rows: those can't reach MIN_Z."""
        keep = (np.bincount(self.number, minlength=1 << BITS) >= least)[self.number]
        return Rows(self.row[keep], self.number[keep], self.n)


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray, steps: int = 80, ridge: float = 0.2) -> Linear:
    """A ridge logistic regression by accelerated gradient steps over the features that tell the classes apart."""
    pos, n = y.sum(), len(y)
    rate = (pos + 0.5) / (n + 1)
    none = np.zeros(0, np.int64)
    if pos == 0 or pos == n:
        return Linear(none, np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))) if n else -30.0)
    size = 1 << BITS
    all_df = np.bincount(rows.number, minlength=size)
    pos_df = np.bincount(rows.number[(y == 1)[rows.row]], minlength=size)
    expected = all_df * (pos / n)
    z = np.abs(pos_df - expected) / np.sqrt(expected * (1 - pos / n) * (1 - np.minimum(all_df / n, 1)) + 1)
    kept = np.flatnonzero(z >= MIN_Z)
    kept = np.sort(kept[np.argsort(-z[kept], kind="stable")[:KEEP]])
    to = np.full(size, -1, np.int16)
    to[kept] = np.arange(len(kept))
    at = to[rows.number]
    r, c = rows.row[at >= 0], at[at >= 0]
    del at
    k = len(kept)
    w = np.zeros(k + earlier.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    dense = np.concatenate([earlier, np.ones((n, 1))], axis=1)
    # A diagonal bound on the curvature: a row's features times each feature's rows, over four.
    per_row = np.bincount(r, minlength=n) + np.abs(dense).sum(axis=1)
    bound = np.concatenate([np.bincount(c, weights=per_row[r], minlength=k), np.abs(dense).T @ per_row]) / 4 + ridge
    look, t = w.copy(), 1.0
    for _ in range(steps):
        score = np.bincount(r, weights=look[c], minlength=n) + dense @ look[k:]
        error = _sigmoid(score) - y
        grad = np.concatenate([np.bincount(c, weights=error[r], minlength=k), dense.T @ error]) + ridge * look
        grad[-1] -= ridge * look[-1]
        new = look - grad / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return Linear(kept, w[:k], w[k:-1], float(w[-1]))


def predict(model: Linear, rows: Rows, earlier: np.ndarray, lookup: np.ndarray | None = None) -> np.ndarray:
    if lookup is None:
        lookup = np.zeros(1 << BITS)
        lookup[model.kept] = model.weight
    score = np.bincount(rows.row, weights=lookup[rows.number], minlength=rows.n) + earlier @ model.earlier + model.intercept
    return _sigmoid(score)


def train(rows: Rows, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """labels (n, categories) 0/1 → the chain's models; folds: a fold number for each row."""
    earlier = np.zeros((rows.n, 0))
    chain = []
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        out = np.zeros(rows.n)
        for f in range(FOLDS if j + 1 < labels.shape[1] else 0):  # no model reads the last one's
            inside, left = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if len(left):
                out[left] = predict(fit(rows.take(inside), earlier[inside], y[inside]), rows.take(left), earlier[left])
        chain.append(fit(rows, earlier, y))
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return chain


def _featured(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in runs(column):
        row, number = features(data, offsets)
        yield i, j, row, number


def train_table(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> list[Linear]:
    """docs (doc_id, text) and labels (doc_id, categories 0/1) → chain, from the `sample` labels with the lowest hash of doc_id.

    At most `sample` narrow label rows are broadcast and as many lists of feature numbers come to the driver.
    """
    shared.ship(docs.sparkSession)
    usable = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna().withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(usable.orderBy("h", "doc_id").limit(sample)), "doc_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, number in _featured(batch["text"]):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                value = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(number.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch[c].slice(i, j - i) for c in ("h", *categories)] + [value], ["h", *categories, "f"])

    schema = "h long, " + ", ".join(f"{c} int" for c in categories) + ", f array<int>"
    got = chosen.mapInArrow(shared.lean(each), schema).toArrow().sort_by("h").combine_chunks()
    if not got.num_rows:
        return train(Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0), np.zeros((0, len(categories))), np.zeros(0))
    lists = got["f"].chunk(0) if got["f"].num_chunks else got["f"].combine_chunks()
    row = np.repeat(np.arange(got.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    labels = np.stack([got[c].to_numpy() for c in categories], axis=1)
    folds = got["h"].to_numpy() % FOLDS
    rows = Rows(row, lists.flatten().to_numpy(), got.num_rows).common(5)
    del got, lists, row
    return train(rows, labels, folds)


def score(docs: DataFrame, chain: list[Linear], names: list[str]) -> DataFrame:
    """docs with a new column (double) for each category's probability. Models go out in the closure: at most 1536 weights each."""
    shared.ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for m in chain:
            table = np.zeros(1 << BITS)
            table[m.kept] = m.weight
            tables.append(table)
        for batch in batches:
            parts = []
            for i, j, row, number in _featured(batch["text"]):
                rows, earlier = Rows(row, number, j - i), np.zeros((j - i, 0))
                for m, table in zip(chain, tables, strict=True):
                    earlier = np.concatenate([earlier, predict(m, rows, earlier, table)[:, None]], axis=1)
                parts.append(earlier)
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, k]) for k in range(len(names))]], [*batch.schema.names, *names])

    return docs.mapInArrow(shared.lean(each), schema)


CATEGORIES = ["poor", "toxic"]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's categories, in order: poor (quality 0), toxic."""
    return shared.table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """docs with a probability for each category, from a chain fitted on the labelled rows of the documents table, and the new columns' names.

    They are p_poor and p_toxic, or longer names where docs has those.
    """
    chain = train_table(shared.table(spark, sf_dir, "documents"), labels(spark, sf_dir), CATEGORIES)
    names = [shared.unused(docs.columns, f"p_{c}") for c in CATEGORIES]
    return score(docs, chain, names), names


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its categories' probabilities and the verdict."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(spark, docs, sf_dir)[0].select("doc_id", "p_poor", "p_toxic", (F.col("p_toxic") >= REJECT).alias("toxic"))
