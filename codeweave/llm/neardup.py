"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A text's shingles (five words, see textcols) weigh as often as they occur. Each shingle is a Poisson process of
arrivals, at its weight as rate, that fall on random registers; a register keeps the earliest arrival. Arrivals are
made round by round and end once every later one would come after all registers' times, so most shingles make a few
at most. Two texts agree in a register with the probability Jaccard similarity of their shingles:
J(x, y) = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i).

1. Texts with the same words are one class; the smallest id stands for it.
2. 25 bands of 5 registers: texts at 0.8 meet in no band once in 20000 pairs; all others are candidates.
3. A bucket is cut by a hash of its members into parts of about BLOCK, dealt over tasks, so a bucket of any size is
   spread. A part looks at each pair in the first band it shares and estimates its similarity from all registers; it
   passes on a spanning forest of its pairs from MARGIN on, the most similar first: a link for every member, not for
   every pair. Buckets of several parts whose members aren't joined by then are worked on again: first one member of
   each joined group for all of it, then, where groups are left, all pairs of members of different groups in blocks,
   with a link for a pair of groups at most. So a large group of near copies costs as many links as it has members.
4. Passed pairs are verified: exact J over all shingles of both texts. Verified links make components.
5. All passed pairs, verified or not, make clusters: every pair from MARGIN on that shares a band lies in one. Clusters
   of several components are worked on in blocks once more, now with the shingles: pairs of different components from
   MARGIN on are verified, the most similar first, and those that a link found before has joined are left out. A block
   passes on its links, at most one for each member. Components of all links are the classes. A link is lost only if an
   estimate of 125 registers falls below MARGIN at a true 0.8, four standard errors off.

Texts aren't shuffled: a bitmap of fixed size says which documents may be in a passed pair, and only their shingles are.

Defined results: null texts and texts without words are alone in their class; texts of 1 to 4 words have one shingle;
rows that repeat an id fall together under it; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import shared
from codeweave.llm.links import components
from codeweave.llm.textcols import GOLD, mix, runs, shingles, words

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
THRESHOLD, MARGIN = 0.8, 0.65
BLOCK = 384
UNIT = 1.0 / (1 << 53)


def weighted(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of rows → (shingle, times, first distinct shingle of each row and the count of all), sorted by row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    return h[first], times, np.searchsorted(row[first], np.arange(len(at)))


def signatures(h: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(rows, REGISTERS) uint32: the shingle whose arrival each register keeps."""
    rows = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(rows), size)
    clock = np.full(rows * REGISTERS, np.inf)
    winner = np.zeros(rows * REGISTERS, np.uint32)
    short = (mix(h + np.uint64(99)) >> np.uint64(32)).astype(np.uint32)
    live, now, step = np.arange(len(h)), np.zeros(len(h)), 0
    while len(live):
        # One arrival each at first; the few shingles of short texts go on by sixteen.
        many = 1 if step < 3 else 16
        word = mix(h[live, None] + (np.arange(step + 1, step + many + 1, dtype=np.uint64) * GOLD)[None, :])
        time = now[:, None] + np.cumsum(-np.log1p(-((word >> np.uint64(11)) * UNIT)) / times[live, None], axis=1)
        step += many
        place = row[live, None] * REGISTERS + (mix(word) % np.uint64(REGISTERS)).astype(np.int64)
        better = time < clock[place]
        p, t, s = place[better], time[better], np.broadcast_to(short[live, None], place.shape)[better]
        order = np.argsort(-t, kind="stable")  # of several on one register the earliest is written last
        p, t, s = p[order], t[order], s[order]
        clock[p] = t
        winner[p] = s
        # A shingle whose last arrival came after every register's time is done: its later ones can't matter.
        now = time[:, -1]
        keep = now < clock.reshape(rows, REGISTERS).max(axis=1)[row[live]]
        live, now = live[keep], now[keep]
    return winner.reshape(rows, REGISTERS)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact J of two sorted arrays of shingles, repeats included."""
    if not len(a) or not len(b):
        return 0.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if nx.max() == 1 and ny.max() == 1:
        return len(common) / (len(x) + len(y) - len(common))
    wx, wy = nx[i].astype(float), ny[j].astype(float)
    only_x, only_y = nx.sum() - wx.sum(), ny.sum() - wy.sum()
    ratio = wy / wx
    total = 0.0
    for r in np.unique(ratio):
        of = ratio == r
        total += wx[of].sum() / (only_x + only_y / r + np.maximum(wx, wy / r).sum())
    return float(total)


def sketch(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) → doc_id, exact (hash of all words, null without words), sig (REGISTERS words, packed)."""
    shared.ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in runs(batch["text"]):
                h, row, first = words(data, offsets)
                s, at = shingles(h, first)
                one, times, at = weighted(s, at)
                sig = signatures(one, at, times)
                # The order of words counts: each is weighed by its place.
                place = (np.arange(len(h)) - first[row]).astype(np.uint64)
                spread = mix(h + mix(place * GOLD))
                ends = np.concatenate([[0], np.cumsum(spread)])
                ends2 = np.concatenate([[0], np.cumsum(mix(spread + GOLD))])
                exact = [
                    None if b == a else f"{int(ends[b] - ends[a]):016x}{int(ends2[b] - ends2[a]):016x}{b - a:x}"
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(exact, pa.string()), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "exact", "sig"]
                )

    with np.errstate(over="ignore"):
        return docs.select("doc_id", "text").mapInArrow(shared.lean(each), "doc_id long, exact string, sig binary")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) of 64-bit bucket numbers."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * GOLD + parts[:, :, r])
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, REGISTERS)


def banded(reps: DataFrame) -> DataFrame:
    """reps (doc_id, sig) → (bucket, doc_id), a row for each band."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch["sig"]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch["doc_id"].to_numpy(), BANDS))], ["bucket", "doc_id"])

    return reps.select("doc_id", "sig").mapInArrow(shared.lean(each), "bucket long, doc_id long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Of pairs in order, those that join two trees."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _alike(sig: np.ndarray, side: np.ndarray, keys: np.ndarray | None, band: int, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A block's pairs of places from MARGIN on, the most similar first.

    side: 0 in the first part only, 1 in the second, 2 in a single part. keys: pairs that share a band before `band` are
    left out. label: pairs of equal labels are left out.
    """
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found_a, found_b, found_e = [], [], []
    for at, x in enumerate(left):
        other = right[at + 1 :] if side[x] == 2 else right
        if label is not None:
            other = other[label[other] != label[x]]
        if band and keys is not None:
            other = other[~(keys[other, :band] == keys[x, :band]).any(axis=1)]
        e = (sig[other] == sig[x]).sum(axis=1)
        ok = e >= MARGIN * REGISTERS
        found_a.append(np.full(int(ok.sum()), x))
        found_b.append(other[ok])
        found_e.append(e[ok])
    none = np.zeros(0, np.int64)
    a, b, e = (np.concatenate(f) if f else none for f in (found_a, found_b, found_e))
    order = np.argsort(-e, kind="stable")
    return a[order], b[order]


def within(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, doc_id, n: the group's size) → block, doc_id, group, side: every member in one part of its group."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.ceil(F.col("n") / BLOCK))
    return rows.select(F.xxhash64(group, part).alias("block"), "doc_id", group, F.lit(2).alias("side"))


def across(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, doc_id, label) of groups with several labels → block, doc_id, label, side: each pair of different labels in a block.

    The members of a group's largest label meet only the others, so they are copied once for each BLOCK of others.
    """
    sizes = rows.groupBy(group, "label").agg(F.count("*").alias("m"))
    most = sizes.groupBy(group).agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
    most = shared.stored(most.select(group, F.col("top.label").alias("top"), F.ceil(F.col("top.m") / BLOCK).alias("pl"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).alias("pm")), "near-sizes")
    rows = rows.join(most, group)
    in_top = F.col("label") == F.col("top")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.when(in_top, F.col("pl")).otherwise(F.col("pm"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block = lambda kind, i, j, side: F.struct(F.xxhash64(group, F.lit(kind), i, j).alias("block"), side.cast("int").alias("side"))
    mine = F.col("mine")
    side = lambda x: F.when(mine == x, 2).when(mine < x, 0).otherwise(1)
    others = F.concat(
        F.transform(upto("pm"), lambda x: block(0, F.least(mine, x), F.greatest(mine, x), side(x))),
        F.transform(upto("pl"), lambda x: block(1, mine, x, F.lit(0))),
    )
    top = F.transform(upto("pm"), lambda x: block(1, x, mine, F.lit(1)))
    return rows.select("doc_id", "label", F.explode(F.when(in_top, top).otherwise(others)).alias("to")).select("to.block", "doc_id", "label", "to.side")


def _cuts(t: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    block = t["block"].to_numpy()
    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    return ((i, j) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if j - i > 1)


def _links(ids: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x, y = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _forests(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """rows (block, bucket or label, doc_id, side) → pairs (a, b): a spanning forest of each block, over its labels if it has some."""
    own = "bucket" if "bucket" in rows.columns else "label"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in shared.grouped(batches, "block"):
            ids, tag, side, sig = t["doc_id"].to_numpy(), t[own].to_numpy(), t["side"].to_numpy(), _matrix(t["sig"])
            out = []
            for i, j in _cuts(t):
                if own == "bucket":
                    keys = band_keys(sig[i:j])
                    band = int(np.flatnonzero(keys[0].view(np.int64) == tag[i])[0])
                    tree = np.arange(j - i)
                    a, b = _alike(sig[i:j], side[i:j], keys, band, None)
                else:
                    _, tree = np.unique(tag[i:j], return_inverse=True)
                    a, b = _alike(sig[i:j], side[i:j], None, 0, tree)
                out += [(i + int(a[k]), i + int(b[k])) for k in _forest(tree[a], tree[b], j - i)]
            yield _links(ids, out)

    rows = rows.join(reps.select("doc_id", "sig"), "doc_id")
    rows = rows.repartition(F.col("block")).sortWithinPartitions("block", "doc_id").select("block", own, "doc_id", "side", "sig")
    return rows.mapInArrow(shared.lean(each), "a long, b long").distinct()


def candidates(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """buckets (bucket, doc_id, n) of n >= 2 members → distinct pairs (a, b) that join all members alike of a bucket."""
    pairs = shared.stored(_forests(within(buckets, "bucket"), reps), "pairs")
    large = shared.stored(buckets.where(F.col("n") > BLOCK).select("bucket", "doc_id"), "large")
    if not large.limit(1).count():
        return pairs

    def open_ones(pairs: DataFrame) -> DataFrame:
        label = components(pairs).select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
        rows = shared.stored(large.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "large")
        several = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        return shared.stored(rows.join(several, "bucket", "left_semi"), "large-open")

    # First a member of each label for all of it, which joins the parts of a group of near copies.
    heads = open_ones(pairs).groupBy("bucket", "label").agg(F.min("doc_id").alias("doc_id")).select("bucket", "doc_id")
    heads = heads.join(heads.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    pairs = shared.stored(pairs.unionByName(_forests(within(heads, "bucket"), reps)).distinct(), "pairs")
    rest = open_ones(pairs)
    if not rest.limit(1).count():
        return pairs
    return pairs.unionByName(_forests(across(rest, "bucket"), reps)).distinct()


def closed(members: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """members (cluster, doc_id, label) of clusters with several labels → verified links (a, b) between labels."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in shared.grouped(batches, "block"):
            ids, side, label, sig, s = t["doc_id"].to_numpy(), t["side"].to_numpy(), t["label"].to_numpy(), _matrix(t["sig"]), t["s"]
            out = []
            for i, j in _cuts(t):
                _, tree = np.unique(label[i:j], return_inverse=True)
                up = list(range(int(tree.max()) + 1))
                texts = [np.frombuffer(s[k].as_py(), np.uint64) for k in range(i, j)]

                def top(x: int, up: list[int] = up) -> int:
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                for a, b in zip(*(v.tolist() for v in _alike(sig[i:j], side[i:j], None, 0, tree)), strict=True):
                    x, y = top(int(tree[a])), top(int(tree[b]))
                    if x != y and probability_jaccard(texts[a], texts[b]) >= threshold:
                        up[max(x, y)] = min(x, y)
                        out.append((i + a, i + b))
            yield _links(ids, out)

    rows = across(members.select("cluster", "doc_id", "label"), "cluster").join(reps.select("doc_id", "sig"), "doc_id").join(sets, "doc_id")
    rows = rows.repartition(F.col("block")).sortWithinPartitions("block").select("block", "doc_id", "side", "label", "sig", "s")
    return rows.mapInArrow(shared.lean(each), "a long, b long")


BITMAP_BITS = 26


def bitmap(ids: DataFrame) -> np.ndarray:
    """2**BITMAP_BITS bits (8 MB at any size): those of the ids' hashes are set."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    rows = ids.select(F.bitmap_bucket_number(spot).alias("k"), F.bitmap_bit_position(spot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8 + 4096, np.uint8)
    for r in rows.collect():  # at most 2**26 / 2**15 + 1 rows of 4 KB
        # Bucket k holds numbers 32768 (k - 1) + 1 to 32768 k; a number of 0 is in bucket 0's place.
        at = int(r.k) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def shingled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, s): the sorted shingles of the documents among ids."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bitmap(ids))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    place = F.bitmap_bucket_number(spot) * (1 << 15) + F.bitmap_bit_position(spot)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at = batch["place"].to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for i, j, data, offsets in runs(batch["text"]):
                h, _, first = words(data, offsets)
                s, at = shingles(h, first)
                row = np.repeat(np.arange(j - i), np.diff(at))
                s = s[np.lexsort((s, row))]
                value = [s[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(value, pa.binary())], ["doc_id", "s"])

    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", place.alias("place"), "text")
    return known.mapInArrow(shared.lean(each), "doc_id long, s binary").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose exact J is at least threshold; sets (doc_id, s) has the shingles of both."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [probability_jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= threshold for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep, pa.bool_())), batch["b"].filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    x, y = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(shared.lean(each), "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) → (doc_id, class_id): class_id is the smallest id of the class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = shared.stored(sketch(docs), "sketches")
    heads = sketches.where(F.col("exact").isNotNull()).groupBy("exact").agg(F.min("doc_id").alias("head"))
    members = shared.stored(sketches.select("doc_id", "exact").join(heads, "exact", "left").select("doc_id", F.coalesce("head", "doc_id").alias("head")), "members")
    chosen = heads.select(F.col("head").alias("doc_id")).distinct()
    reps = shared.stored(sketches.where(F.col("exact").isNotNull()).select("doc_id", "sig").join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "reps")
    buckets = banded(reps)
    sized = shared.stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    buckets = shared.stored(buckets.join(sized, "bucket"), "buckets")
    pairs = shared.stored(candidates(buckets, reps), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = shared.stored(shingled(docs, shared.stored(ids, "pair-ids")), "shingles")
    links = shared.stored(verified(pairs, sets, threshold), "verified")
    label = components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
    cluster = components(pairs).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
    both = shared.stored(cluster.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "clusters")
    open_ones = both.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cluster")
    open_members = shared.stored(both.join(shared.stored(open_ones, "open"), "cluster"), "open-members")
    more = shared.stored(closed(open_members, reps, sets, threshold), "verified")
    label = components(links.unionByName(more)).select(F.col("id").alias("head"), "component")
    return members.join(label, "head", "left").select("doc_id", F.coalesce("component", "head").alias("class_id"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class and whether it is the one that stays."""
    got = classes(shared.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
