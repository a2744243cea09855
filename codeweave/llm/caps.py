"""Similar embeddings by spherical-cap filters.

Filters are the directions of a random product code: the unit vector, turned by fixed random signs, a Hadamard
transform and a random permutation of coordinates, is cut into BLOCKS parts, each with CODES random unit directions;
a filter is one direction of each part, side by side. A vector belongs to the cap of a filter when the sum of its
parts' scores reaches a level. List decoding finds all such filters without looking at the CODES ** BLOCKS others: the
parts' scores are sorted, and a part's tail is cut where even the best rest can't reach the level.

Vectors whose cosine is `threshold` share a cap by chance only, so several codes are drawn; each gives a vector the
filters above a level relative to its own best score, so every vector has filters. The slack is over two standard
deviations of what parts two such vectors' best scores, so a code misses about one pair in a hundred, and two
independent codes one in ten thousand; the tests measure recall against brute force.

Buckets are (label, code, filter). They are worked on in blocks of at most BLOCK x BLOCK members, dealt over tasks by
block. Each pair is verified once, in the first filter both have: the cosine in double precision. Blocks pass on link
counts per vector and a spanning forest of their links, not their pairs.

Equal vectors of a label (equal bytes after normalisation of zeros) are searched once and counted as often as they
occur, so many copies of a vector cost one.

Defined results: vectors that are null, zero, hold null or non-finite components, or have a null label link with
nothing; vectors of different lengths link with nothing; rows of equal or null ids are vectors of their own, each with
a row; null ids name a component only if it has no other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import shared
from codeweave.llm.links import components
from codeweave.llm.neardup import _forest

THRESHOLD = 0.98
CODES_DRAWN, BLOCKS, CODES = 2, 2, 128
#: How far below its best filter's score a vector's filters reach, times the square root of the components: scores of
#: one filter for two vectors of cosine 0.98 differ by 0.2 of that in standard deviation.
SLACK = 0.52
BLOCK = 512


class Code:
    """One random product code for vectors of `dim` components."""

    def __init__(self, dim: int, seed: int):
        rng = np.random.default_rng([dim, seed])
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.size = max(self.size, BLOCKS)
        self.signs = rng.choice([-1.0, 1.0], (2, self.size))
        self.order = rng.permutation(self.size)
        width = self.size // BLOCKS
        book = rng.standard_normal((BLOCKS, CODES, width))
        self.book = book / np.linalg.norm(book, axis=2, keepdims=True) / np.sqrt(BLOCKS)

    def turn(self, x: np.ndarray) -> np.ndarray:
        """Signs and a Hadamard transform, twice, then the permutation."""
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for s in self.signs:
            y *= s
            h = 1
            while h < self.size:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.size)
                h *= 2
            y /= np.sqrt(self.size)
        return y[:, self.order]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter number) of all filters whose score is at least the row's best less the slack."""
        y = self.turn(x).reshape(len(x), BLOCKS, -1)
        scores = np.einsum("nbw,bcw->nbc", y, self.book)
        order = np.argsort(-scores, axis=2)
        ranked = np.take_along_axis(scores, order, axis=2)
        best = ranked[:, :, 0].sum(axis=1)
        level = best - SLACK / np.sqrt(self.size)
        rows = np.arange(len(x))
        total, number, row = np.zeros(len(x)), np.zeros(len(x), np.int64), rows
        for b in range(BLOCKS):
            rest = ranked[:, b + 1 :, 0].sum(axis=1)
            grown = total[:, None] + ranked[row, b]
            # Ranks beyond the first that can't reach the level, with the best of the parts to come, are cut.
            reach = grown + rest[row][:, None] >= level[row][:, None] - 1e-12
            i, k = np.nonzero(reach)
            total, number, row = grown[i, k], number[i] * CODES + order[row[i], b, k], row[i]
        return row, number


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length → (good, their unit vectors in double precision)."""
    x = np.array(vectors, np.float64)
    with np.errstate(all="ignore"):
        big = np.abs(x).max(axis=1, initial=0.0)
        good = np.isfinite(big) & (big > 0)
        x = x[good] / big[good, None]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return good, x


def filters(x: np.ndarray) -> list[np.ndarray]:
    """All filters of each unit vector, as sorted 64-bit numbers."""
    parts_r, parts_f = [], []
    for c in range(CODES_DRAWN):
        code = Code(x.shape[1], c)
        row, number = code.decode(x)
        parts_r.append(row)
        parts_f.append(number + (np.int64(c) << np.int64(48)) + (np.int64(x.shape[1]) << np.int64(52) if x.shape[1] < 2048 else 0))
    row, number = np.concatenate(parts_r), np.concatenate(parts_f)
    order = np.lexsort((number, row))
    cut = np.searchsorted(row[order], np.arange(len(x) + 1))
    return [number[order][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def filtered(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, label, vector array<double>) → the usable ones with unit (packed doubles) and caps."""
    shared.ship(vectors.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["vector"].to_pylist()
            by: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                if v and None not in v:
                    by.setdefault(len(v), []).append(i)
            for at in by.values():
                for k in range(0, len(at), 1024):
                    some = np.array(at[k : k + 1024])
                    good, x = unit([values[i] for i in some])
                    if not len(x):
                        continue
                    kept = pa.array(some[good])
                    caps = filters(x)
                    yield pa.RecordBatch.from_arrays(
                        [batch["vec_id"].take(kept), batch["label"].take(kept), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(caps, pa.list_(pa.int64()))],
                        ["vec_id", "label", "unit", "caps"],
                    )

    usable = vectors.where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    return usable.mapInArrow(shared.lean(each), "vec_id long, label long, unit binary, caps array<long>")


RESULT = "kind int, a long, b long, n long"


def _block(ids: np.ndarray, times: np.ndarray, x: np.ndarray, caps: list[np.ndarray], side: np.ndarray, cap: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Link counts (id, n) and forest links (a, b) of one block."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none, none, none
    dots = x[left] @ x[right].T
    i, j = np.nonzero(dots >= threshold - 1e-9)
    a, b = left[i], right[j]
    single = side[a] == 2
    keep = ~single | (a < b)
    a, b = a[keep], b[keep]
    if not len(a):
        return none, none, none, none
    exact = np.einsum("ij,ij->i", x[a], x[b])
    ok = exact >= threshold
    a, b = a[ok], b[ok]
    # A pair counts in the smallest filter both have: of the smaller ones, those that two members have or more matter.
    before = [c[: np.searchsorted(c, cap)] for c in caps]
    row = np.repeat(np.arange(len(ids)), [len(c) for c in before])
    number, at, held = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    keep = held[at] > 1
    if keep.any() and len(a):
        shared_number, at = np.unique(at[keep], return_inverse=True)
        has = np.zeros((len(ids), len(shared_number)), np.float32)
        has[row[keep], at] = 1
        earlier = has @ has.T > 0
        mine = ~earlier[a, b]
        a, b = a[mine], b[mine]
    n = np.bincount(a, weights=times[b], minlength=len(ids)) + np.bincount(b, weights=times[a], minlength=len(ids))
    with_links = np.flatnonzero(n)
    tree = _forest(a, b, len(ids))
    return ids[with_links], n[with_links].astype(np.int64), ids[a[tree]], ids[b[tree]]


def linked(heads: DataFrame, threshold: float) -> DataFrame:
    """heads (vec_id, label, unit, caps, times) → rows of kind 0 (a: vec_id, n: links to others) and 1 (a, b: a link)."""
    spark = heads.sparkSession
    shared.ship(spark)
    rows = heads.select("vec_id", "label", F.explode("caps").alias("cap"))
    sizes = shared.stored(rows.groupBy("label", "cap").agg(F.count("*").alias("n")).where("n > 1"), "cap-sizes")
    rows = rows.join(sizes, ["label", "cap"])
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumns({"parts": parts, "mine": F.pmod(F.xxhash64("vec_id", F.lit(3)), parts).cast("int")})
    rows = rows.select("vec_id", "label", "cap", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), F.lit(2)).when(F.col("mine") < F.col("other"), F.lit(0)).otherwise(F.lit(1))
    block = F.xxhash64("label", "cap", F.least("mine", "other"), F.greatest("mine", "other"))
    rows = rows.select("vec_id", "cap", block.alias("block"), side.alias("side"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            block = t["block"].to_numpy()
            ids, cap, side, times = (t[c].to_numpy() for c in ("vec_id", "cap", "side", "times"))
            packed, caps = t["unit"].to_pylist(), t["caps"]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            found = [[], [], [], []]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j - i > 1:
                    x = np.frombuffer(b"".join(packed[i:j])).reshape(j - i, -1)
                    lists = [caps[k].values.to_numpy() for k in range(i, j)]
                    for to, got in zip(found, _block(ids[i:j], times[i:j], x, lists, side[i:j], int(cap[i]), threshold), strict=True):
                        to.append(got)
            v, n, a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
            none = np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(v), np.int32)), pa.array(v), pa.array(none), pa.array(n)], ["kind", "a", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], ["kind", "a", "b", "n"])

        for t in shared.grouped(batches, "block"):
            yield from work(t)

    joined = rows.join(heads.select("vec_id", "unit", "caps", "times"), "vec_id").repartition(F.col("block")).sortWithinPartitions("block")
    return joined.select("block", "cap", "vec_id", "side", "times", "unit", "caps").mapInArrow(shared.lean(each), RESULT)


def similar(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, label, vector array<double>) → vec_id, n_links, component_id: a row per vector.

    Inside, a row goes by a number of its own, stored once; vec_ids name components in the end.
    """
    row = F.monotonically_increasing_id().alias("row")
    vectors = vectors.select(row, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    vectors = shared.stored(vectors, "caps-rows")
    usable = shared.stored(filtered(vectors.select(F.col("row").alias("vec_id"), "label", "vector")), "caps")
    key = F.sha2("unit", 256)
    copies = shared.stored(usable.groupBy("label", key.alias("key")).agg(F.min("vec_id").alias("head"), F.count("*").alias("times")), "copies")
    members = usable.select(F.col("vec_id").alias("row"), "label", key.alias("key")).join(copies, ["label", "key"]).select("row", "head", "times")
    heads = shared.stored(usable.join(copies.select(F.col("head").alias("vec_id"), "times"), "vec_id"), "cap-heads")
    found = shared.stored(linked(heads, threshold), "cap-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n"))
    label = components(found.where("kind = 1").select("a", "b")).select(F.col("id").alias("head"), "component")
    facts = members.join(counts, "head", "left").join(label, "head", "left").select(
        "row",
        (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"),
        F.coalesce("component", "head").alias("c"),
    )
    rows = shared.stored(vectors.select("row", "vec_id").join(facts, "row", "left"), "cap-facts")
    least = rows.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("vec_id").alias("least"))
    named = rows.join(least, "c", "left")
    return named.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))


def op10_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, compared within their label."""
    rows = shared.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return similar(rows).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id AND reach.c < links.b),
best AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN best ON best.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
