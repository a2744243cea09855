"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: every source weighs something, all share a total, none gets more than `ceiling` times its words
   (water filling over one row per source).
2. Passes: a source's target is so many whole passes over its documents and a part of one more. A hash of the id
   fixes each source's permuted order; the partial pass takes a prefix of it. Its end is found by radix refinement:
   sums by 1024 cells of the hash, then by 1024 cells of the one cell that holds the end, and so on, so no task
   ever sorts a source.
3. Blocks: the top bits of the hash cut a source's order into disjoint blocks. A tree halves the output shards; at
   each node the left half's blocks are drawn from the node's exact per-source quotas without replacement (a
   hypergeometric draw per source, conditional on the ones before). A shard takes its quota off the source's
   permuted sequence of blocks, and orders what it has by a hash (a local shuffle).

Everything is DataFrame expressions; only per-source and per-block tables are ever joined to documents, and they
are broadcast if a count shows they are small, else joined by shuffle.

Defined results: a null text has size 0; a null source is a source of its own, last in order; ids and sources may
repeat; rows with equal source and id are taken together; empty tables give empty mixes; reruns give the same rows.
Columns whose names begin with `mix_` are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2.0
SHARDS = 32
BLOCK_BITS, CELL_BITS, LEVELS, HASH_BITS = 7, 10, 3, 63


@dataclass
class Plan:
    """sources: a row per source (mix_key, source_size, target, whole, cut); blocks: (mix_key, block, shards by pass)."""

    sources: DataFrame
    blocks: DataFrame


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(df: DataFrame, seed: int) -> DataFrame:
    """Adds mix_key (the source, not null), mix_at (the place in the permuted order) and mix_block."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - HASH_BITS)
    return df.withColumns({"mix_key": key, "mix_at": at}).withColumn("mix_block", F.shiftright("mix_at", HASH_BITS - BLOCK_BITS).cast("int"))


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """(mix_key, source_size, target): sums are per source, so the windows below see one row per source."""
    per = sized.groupBy("mix_key").agg(F.first("source").alias("source"), F.sum("mix_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = per.withColumn("weight", weight).withColumn("cap", ceiling * F.col("source_size"))
    w = w.withColumns({"total": share * F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    before = Window.orderBy(F.col("cap") / F.col("weight"), "mix_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("full", F.col("cap") < level * F.col("weight"))
    held = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(every)
    rest = F.col("all_weight") - held("weight")
    level = F.when(rest > 0, (F.col("total") - held("cap")) / rest).otherwise(0.0)
    return w.select("mix_key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"))


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(mix_key, cut): the partial pass takes the documents whose mix_at is at most cut; no row: takes none."""
    at = Window.partitionBy("mix_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sources.where(F.col("source_size") > 0).select("mix_key", F.lit(0).cast("long").alias("prefix"), F.col("part").alias("left"))
    done = 0
    for bits in [CELL_BITS] * LEVELS + [HASH_BITS - CELL_BITS * LEVELS]:
        inside = sized.withColumn("prefix", F.shiftright("mix_at", HASH_BITS - done)) if done else sized.withColumn("prefix", F.lit(0).cast("long"))
        done += bits
        last = done == HASH_BITS
        cells = (
            inside.join(shared.small(cut), ["mix_key", "prefix"])
            .groupBy("mix_key", "left", F.shiftright("mix_at", HASH_BITS - done).alias("cell"))
            .agg(F.sum("mix_size").alias("n"))
            .withColumn("end", F.sum("n").over(at))
        )
        if last:  # the nearest whole document
            return shared.stored(cells.where(F.col("end") - F.col("n") / 2 <= F.col("left")).groupBy("mix_key").agg(F.max("cell").alias("cut"), F.first("left").alias("l")).where("l > 0").select("mix_key", "cut").unionByName(
                # nothing of the last cell fits: the pass ends before it
                cells.groupBy("mix_key").agg(F.min("cell").alias("cut"), F.min(F.col("end") - F.col("n") / 2 - F.col("left")).alias("over")).where("over > 0").select("mix_key", (F.col("cut") - 1).alias("cut"))
            ).groupBy("mix_key").agg(F.max("cut").alias("cut")), "mix-cuts")
        found = cells.where((F.col("end") > F.col("left")) & (F.col("end") - F.col("n") <= F.col("left")))
        cut = shared.stored(found.select("mix_key", F.col("cell").alias("prefix"), (F.col("left") - F.col("end") + F.col("n")).alias("left")), "mix-cells")


def _uniform(*columns) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _log_factorial(x: Column) -> Column:
    """Stirling's series, within 1e-5 from 2 on."""
    x = x.cast("double")
    return F.when(x < 2, 0.0).otherwise(x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hypergeometric(pool: Column, good: Column, need: Column, u: Column) -> Column:
    """How many of `need` draws without replacement from `pool` are among its `good` ones: the inverse distribution at u."""
    low, high = F.greatest(F.lit(0), need + good - pool), F.least(good, need)
    logs = F.transform(F.sequence(low, high), lambda k: -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(need - k) + _log_factorial(pool - good - need + k)))
    weights = _let(logs, lambda x: _let(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top))))

    def inverse(w: Column, goal: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))
        step = lambda a, x: F.when(a["sum"] > goal, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["k"] + 1).alias("k")))
        return F.aggregate(w, start, step, lambda a: a["k"])

    steps = _let(weights, lambda w: _let(u * F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda goal: inverse(w, goal)))
    return F.least(low + F.greatest(steps, F.lit(0)), high)


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (mix_key, n) → (mix_key, shard, n): exact integer quotas of every shard, by the splitting tree."""
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("mix_key", F.col("n").cast("long").alias("n")))).alias("q"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(shards).alias("width"), "q")
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    for _ in range(max(0, shards - 1).bit_length()):
        half = F.expr("width div 2").cast("int")
        zero = F.struct(total.alias("pool"), F.floor(total * half / F.col("width")).alias("need"), F.array().cast("array<bigint>").alias("out"))

        def draw(a: Column, x: Column) -> Column:
            k = _hypergeometric(a["pool"], x["n"], a["need"], _uniform(F.lit(seed), F.col("lo"), F.col("width"), x["mix_key"]))
            return _let(k, lambda v: F.struct((a["pool"] - x["n"]).alias("pool"), (a["need"] - v).alias("need"), F.concat(a["out"], F.array(v)).alias("out")))

        nodes = nodes.withColumn("left", F.aggregate("q", zero, draw, lambda a: a["out"]))
        ways = F.array(
            F.struct(F.col("lo"), half.alias("width"), F.transform("q", lambda x, i: F.struct(x["mix_key"].alias("mix_key"), F.get("left", i).alias("n"))).alias("q")),
            F.struct((F.col("lo") + half).alias("lo"), (F.col("width") - half).alias("width"), F.transform("q", lambda x, i: F.struct(x["mix_key"].alias("mix_key"), (x["n"] - F.get("left", i)).alias("n"))).alias("q")),
        )
        one = F.array(F.struct("lo", "width", "q"))
        nodes = nodes.select(F.inline(F.when(F.col("width") > 1, ways).otherwise(one)))
    return nodes.select(F.col("lo").alias("shard"), F.inline("q"))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, shards: int = SHARDS, seed: int = 42) -> Plan:
    """sized (doc_id, source, mix_size), narrow and cheap to read again → the mix's small tables."""
    sized = _keyed(sized.select("doc_id", "source", "mix_size"), seed)
    sources = targets(sized, weights, share, ceiling)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = shared.stored(sources.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    sources = sources.join(_cuts(sized, sources), "mix_key", "left").select("mix_key", "source_size", "target", "whole", "cut")
    sources = shared.stored(sources, "mix-plan")
    held = sized.groupBy("mix_key", "mix_block").count().join(sources, "mix_key")
    reach = F.shiftright("cut", HASH_BITS - BLOCK_BITS)
    passes = F.col("whole") + F.when(F.col("mix_block") <= reach, 1).otherwise(0)
    draws = held.where(passes > 0).select("mix_key", "mix_block", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"))
    draws = shared.stored(draws, "mix-draws")
    quotas = split(draws.groupBy("mix_key").agg(F.count("*").alias("n")), shards, seed)
    upto = F.sum("n").over(Window.partitionBy("mix_key").orderBy("shard"))
    quotas = quotas.select("mix_key", "shard", (upto - F.col("n")).alias("from"), upto.alias("to"))
    turn = F.row_number().over(Window.partitionBy("mix_key").orderBy(F.xxhash64(F.lit(seed + 1), "mix_block", "pass"), "mix_block", "pass"))
    placed = draws.withColumn("turn", turn).join(quotas, "mix_key").where((F.col("turn") > F.col("from")) & (F.col("turn") <= F.col("to")))
    blocks = placed.groupBy("mix_key", "mix_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("mix_shards"))
    return Plan(sources, shared.stored(blocks, "mix-blocks"))


def apply(docs: DataFrame, p: Plan, seed: int = 42) -> DataFrame:
    """docs (doc_id, source, mix_size, any others) → the same rows with source_size, target and mix_copies.

    mix_copies: struct(pass, shard, slot) for each time the mix takes the row; slot orders a shard. Documents meet
    only the plan's small tables; they are not shuffled when those are broadcast.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_") and c != "mix_size"])
    facts = p.sources.select("mix_key", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), F.col("cut").alias("mix_cut"))
    keyed = _keyed(docs, seed).join(shared.small(facts), "mix_key", "left")
    keyed = keyed.join(shared.small(p.blocks, 200_000), ["mix_key", "mix_block"], "left")
    times = F.col("mix_whole") + F.when(F.col("mix_at") <= F.col("mix_cut"), 1).otherwise(0)
    taken = F.filter(F.coalesce("mix_shards", F.array().cast("array<struct<pass:int,shard:int>>")), lambda x: x["pass"] < times)
    copies = F.transform(taken, lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), "doc_id", x["pass"]).alias("slot")))
    return keyed.withColumn("mix_copies", copies).drop("mix_key", "mix_at", "mix_block", "mix_shards", "mix_whole", "mix_cut")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("mix_size"))
    sized = shared.stored(docs, "mix-sizes")
    mixed = apply(sized, plan(sized))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_copies")).alias("taken"),
        F.transform("mix_copies", lambda x: x["shard"]).alias("shards"),
    )
