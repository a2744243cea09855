"""Ranked lexical search over a tiered index of whole documents.

An index is cut into segments, about SEGMENT_BYTES of text each, and a segment is one row: its documents, its terms and
the postings (document, impact) of each term, those of the highest impact first. The first TIERS[0] postings of every
term are its first tier, those up to TIERS[1] its second, the rest its last; the tiers are columns, so a search that
needs the first one only reads no other. With each tier goes a residual bound for every term: the largest impact that
the tiers below it hold.

A search starts with the first tier. A document's score so far is a lower bound, and with the residuals of the terms it
was not yet met under it is an upper bound. An item is proven when no document that could still gain reaches the lower
bound of the last place; items without that proof fall through to the next tier, and the last one leaves nothing open.

Scale: the index is made where the documents are read, without a shuffle of texts or postings, in two passes (one counts
terms, for the mean length). Items are taken in blocks of ITEMS and ITEM_BYTES, so what is broadcast is bounded (by the
longest item beyond that). A task hands on at most 2 * top rows and a bound for each item; places are ranked in two steps,
so no task gets more than SALTS * top rows of an item.

Scoring, in 64-bit integers: a term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), its impact in a document
1000000000 tf div (1000 tf + 12 m), with m = 75 + 25 n N div L for a document of n terms, N documents that have terms and
L terms in all. A score sums weight times impact over an item's terms, repeats included.

Defined results: terms are runs of digits, ASCII letters (A-Z in lower case) and characters beyond ASCII; null and empty
texts have none, such documents don't count and such items get no rows; every row of documents is one document, also where
ids repeat; null ids come after all others among equal scores, rows of equal id and score in the order of the index; rows
of items with equal ids are ranked apart; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.llm import shared
from codeweave.llm.textcols import LOWER, runs

SEGMENT_BYTES = 8 << 20
#: Postings of a term in a segment that make its first, and its first two tiers.
TIERS = (128, 1024)
TOP = 20
ITEMS, ITEM_BYTES = 2_000, 4 << 20
SALTS = 64

TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

FOUND = "pos int, kind int, doc_id long, place long, score long"
EXACT, OPEN, BOUND = 0, 1, 2
NO_ID = np.iinfo(np.int64).max


@dataclass
class Index:
    """Paths of the segments and of the dictionary (term, df), and what all documents have together."""

    segments: str
    terms: str
    n_docs: int
    n_terms: int
    tiers: tuple[int, ...]


def schema(tiers: tuple[int, ...]) -> str:
    """Columns of a segment; its number is the task's and the documents of the task before it."""
    parts = "".join(f", floor{k} array<int>, docs{k} array<int>, impacts{k} array<int>" for k in range(len(tiers) + 1))
    return "segment long, doc_ids array<long>, terms array<string>, sizes array<int>" + parts


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A run of texts → (number of each term, the distinct terms, first term of each row and the count of all)."""
    inside = TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    at = np.concatenate([np.cumsum(inside)[start] - 1, [np.count_nonzero(inside)]]).astype(np.int64)
    kept = LOWER[data[inside]]
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(kept)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string()), np.searchsorted(start, offsets)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for _, _, data, offsets in runs(batch["text"]):
            inside = TERM[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            begins[edges] = inside[edges]
            n = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
            docs, terms = docs + int(np.count_nonzero(n)), terms + int(n.sum())
    yield pa.record_batch([[docs], [terms]], names=["n_docs", "n_terms"])


def _list(x: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    values = x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def segment(number: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int, tiers: tuple[int, ...]) -> pa.RecordBatch:
    """A run of texts as a row of the index."""
    codes, terms, first = cut(data, offsets)
    d = len(offsets) - 1
    n = np.diff(first)
    spread = np.array([75 + 25 * x * n_docs // max(1, n_terms) for x in n.tolist()], np.int64)
    own, tf = np.unique(codes * d + np.repeat(np.arange(d), n), return_counts=True)
    term, doc = own // d, own % d
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * spread[doc])
    order = np.argsort((term << 20) + ((1 << 20) - 1 - impact), kind="stable")  # impacts are below 2**20
    doc, impact = doc[order], impact[order]
    sizes = np.bincount(term, minlength=len(terms))
    starts = np.cumsum(sizes) - sizes
    rank = np.arange(len(doc)) - starts[term]
    tier = np.searchsorted(np.array(tiers), rank, "right")
    columns = [pa.array([number]), _list(ids, pa.int64()), _list(terms, pa.string()), _list(sizes, pa.int32())]
    for k in range(len(tiers) + 1):
        floor = np.zeros(len(terms), np.int64)
        if k < len(tiers):
            more = sizes > tiers[k]
            floor[more] = impact[starts[more] + tiers[k]]
        columns += [_list(floor, pa.int32()), _list(doc[tier == k], pa.int32()), _list(impact[tier == k], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in schema(tiers).split(", ")])


def build(docs: DataFrame, tiers: tuple[int, ...] = TIERS, segment_bytes: int = SEGMENT_BYTES) -> Index:
    """docs (doc_id, text) → the index of all of them."""
    spark = docs.sparkSession
    shared.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = docs.select("text").mapInArrow(shared.lean(_counts), "n_docs long, n_terms long").agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = sums.d or 0, sums.t or 0
    index = Index(shared.place(spark, "tiers"), shared.place(spark, "tiers-terms"), n_docs, n_terms, tiers)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, offsets in runs(batch["text"], segment_bytes):
                yield segment(number, batch["doc_id"].slice(i, j - i), data, offsets, n_docs, n_terms, tiers)
                number += j - i

    # A row group holds a segment: it is written and read whole, and Parquet looks at its size every hundred rows only.
    groups = {"parquet.block.size": max(segment_bytes // 8, 1), "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    docs.mapInArrow(shared.lean(each), schema(tiers)).write.options(**groups).parquet(index.segments)
    parts = segments(spark, index).select(F.explode(F.arrays_zip("terms", "sizes")).alias("t"))
    parts.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df")).write.parquet(index.terms)
    return index


def segments(spark: SparkSession, index: Index) -> DataFrame:
    return spark.read.schema(schema(index.tiers)).parquet(index.segments)


class Block:
    """Some items: their distinct terms, and of each item the numbers of its terms and what an impact of one is worth."""

    def __init__(self, texts: list[str]):
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        known: dict[str, int] = {}
        for i, j, data, offsets in runs(pa.array(texts, pa.string())):
            codes, terms, first = cut(data, offsets)
            number = np.array([known.setdefault(t, len(known)) for t in terms.to_pylist()], np.int64)
            self.items += [np.unique(number[codes[first[k] : first[k + 1]]], return_counts=True) for k in range(j - i)]
        self.terms = list(known)

    def weigh(self, df: dict[str, int], n_docs: int) -> None:
        """Terms that no document has are left out from here on."""
        have = np.array([t in df for t in self.terms], bool)
        weight = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) if t in df else 0 for t in self.terms], np.int64)
        number = np.cumsum(have) - 1
        self.items = [(number[t[have[t]]], (c * weight[t])[have[t]]) for t, c in self.items]
        self.terms = [t for t in self.terms if t in df]


class Segment:
    """A row of the index, as far as tier k."""

    def __init__(self, batch: pa.RecordBatch, row: int, block: Block, tiers: tuple[int, ...], k: int):
        of = lambda c: batch[c][row].values
        self.number = batch["segment"][row].as_py()
        ids = of("doc_ids")
        self.null = np.asarray(ids.is_null())
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.at = pc.index_in(pa.array(block.terms, pa.string()), value_set=of("terms")).fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = of("sizes").to_numpy().astype(np.int64)
        limits = [0, *tiers, NO_ID]
        self.tiers = []
        for j in range(k + 1):
            length = np.clip(sizes, limits[j], limits[j + 1]) - limits[j]
            self.tiers.append((np.cumsum(length) - length, length, of(f"docs{j}").to_numpy(), of(f"impacts{j}").to_numpy()))
        self.floor = of(f"floor{k}").to_numpy().astype(np.int64)

    def scores(self, terms: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bound of every document's score for an item."""
        at = self.at[terms]
        worth, at = worth[at >= 0], at[at >= 0]
        low, up = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), int((worth * self.floor[at]).sum()), np.int64)
        for start, length, docs, impacts in self.tiers:
            n = length[at]
            place = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc = docs[place]
            np.add.at(low, doc, impacts[place] * np.repeat(worth, n))
            np.subtract.at(up, doc, np.repeat(worth * self.floor[at], n))
        return low, up + low


class Best:
    """The first rows of an item so far, by score, id and place."""

    def __init__(self, top: int):
        self.top = top
        self.rows = (np.zeros(0, np.int64),) * 3

    def add(self, score: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        if len(score) > self.top:
            least = np.partition(score, -self.top)[-self.top]
            some = score >= least
            score, ids, place = score[some], ids[some], place[some]
        score, ids, place = (np.concatenate(x) for x in zip(self.rows, (score, ids, place), strict=True))
        order = np.lexsort((place, ids, -score))[: self.top]
        self.rows = (score[order], ids[order], place[order])

    def least(self) -> int:
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.top else 0


def _round(found: DataFrame, tiers: tuple[int, ...], k: int, block: Block, live: dict[int, int], top: int) -> DataFrame:
    """What tiers up to k say of the live items (number → score that the last place is known to have): FOUND rows.

    EXACT: documents whose score is known, OPEN: lower bounds of others, BOUND: the largest upper bound of the others.
    """
    sent = found.sparkSession.sparkContext.broadcast((block, live))
    columns = ["segment", "doc_ids", "terms", "sizes", f"floor{k}", *(f"{c}{j}" for j in range(k + 1) for c in ("docs", "impacts"))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, live = sent.value
        exact, some, bound = {i: Best(top) for i in live}, {i: Best(top) for i in live}, dict.fromkeys(live, 0)
        null: set[int] = set()
        for batch in batches:
            for row in range(batch.num_rows):
                here = Segment(batch, row, block, tiers, k)
                place = here.number + np.arange(len(here.ids))
                if here.null.any():
                    null.update(place[here.null].tolist())
                for i, least in live.items():
                    low, up = here.scores(*block.items[i])
                    for best, mine in ((exact[i], up == low), (some[i], up > low)):
                        at = np.flatnonzero(mine & (low > 0) & (low >= max(least, best.least())))
                        best.add(low[at], here.ids[at], place[at])
                    if (up > low).any():
                        bound[i] = max(bound[i], int(up[up > low].max()))
        for kind, bests in ((EXACT, exact), (OPEN, some)):
            for i, best in bests.items():
                score, ids, place = best.rows
                if len(score):
                    ids = pa.array(ids, pa.int64(), mask=np.array([p in null for p in place.tolist()], bool))
                    yield pa.record_batch([np.full(len(score), i, np.int32), np.full(len(score), kind, np.int32), ids, place, score], names=["pos", "kind", "doc_id", "place", "score"])
        open_ = [(i, b) for i, b in bound.items() if b]
        if open_:
            pos, b = (np.array(x) for x in zip(*open_, strict=True))
            none = pa.nulls(len(b), pa.int64())
            yield pa.record_batch([pos.astype(np.int32), np.full(len(b), BOUND, np.int32), none, none, b.astype(np.int64)], names=["pos", "kind", "doc_id", "place", "score"])

    return found.select(*columns).mapInArrow(shared.lean(each), FOUND)


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each item with their rank, in two steps so that no task gets many rows of one item."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pos", "salt").orderBy(*by))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(*by))).where(F.col("rank") <= top).drop("salt")


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """items (item_id, text) → item_id, rank (from 1), doc_id, score: the `top` best documents with a score above 0."""
    spark = items.sparkSession
    shared.ship(spark)
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    kept = [_search(spark, index, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), top) for b in range(blocks)]
    return reduce(DataFrame.unionByName, kept)


def _search(spark: SparkSession, index: Index, items: DataFrame, top: int) -> DataFrame:
    mine = items.orderBy("item_id", "text").collect()
    block = Block([r.text for r in mine])
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in block.terms], "term string"))
    block.weigh({r.term: r.df for r in spark.read.schema("term string, df long").parquet(index.terms).join(wanted, "term").collect()}, index.n_docs)
    live = {i: 0 for i, (terms, _) in enumerate(block.items) if len(terms)}
    exact = None
    for k in range(len(index.tiers) + 1):
        if not live:
            break
        found = shared.stored(_round(segments(spark, index), index.tiers, k, block, live, top), "tiers-found")
        mine_exact = found.where(F.col("kind") == EXACT)
        exact = mine_exact if exact is None else exact.unionByName(mine_exact)
        bound = {r.pos: r.score for r in found.where(F.col("kind") == BOUND).groupBy("pos").agg(F.max("score").alias("score")).collect()}
        last = {r.pos: r.score for r in _first(found.where(F.col("kind") != BOUND), top).where(F.col("rank") == top).collect()}
        live = {i: max(least, last.get(i, 0)) for i, least in live.items() if bound.get(i, 0) and bound[i] >= last.get(i, 0)}
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(mine)], f"pos int, item_id {items.schema['item_id'].dataType.simpleString()}")
    if exact is None:
        exact = spark.createDataFrame([], FOUND)
    places = _first(exact.drop("kind").dropDuplicates(["pos", "place"]), top)
    return places.join(F.broadcast(names), "pos").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    return search(build(shared.table(spark, sf_dir, "documents")), shared.table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, docs),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
s AS (SELECT item_id, k, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (k), g GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s JOIN d USING (k) WHERE score > 0) WHERE rank <= 20
"""
