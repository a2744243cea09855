"""PageRank and betweenness as rounds of joins; no vertex, edge or path passes the driver or meets all others in a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave import schemas
from codeweave.operators.tables import bucketed, counted, cut, settings

#: Edges (or vertices) of a graph for each task of a round.
PER_TASK = 500_000
#: A vertex with more callers than this, and than a MOST_HOT-th of all edges, is hot; so at most MOST_HOT vertices are.
HOT, MOST_HOT = 500_000, 10_000
#: Rounds in a job, where none needs an answer before the next.
ROUNDS = 5
#: Graphs of so few vertices take many rounds at once, as powers of the matrix of a round.
DENSE = 256
#: (source, vertex) pairs that a batch of betweenness' sources may have.
PAIRS = 1_000_000_000
#: Sources that go side by side in a row.
WIDTH = 12


def pagerank(edges: DataFrame, v: DataFrame, mode: str = "fixed", damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """(id, pagerank) on the reversed graph: who calls important code ranks high.

    pr(v) = (1 - d) / n + d * sum over v → c of pr(c) / in_degree(c). "fixed": so many rounds, nothing redistributed;
    "standard": what vertices without callers hold is spread evenly, and rounds end at a tolerance.

    Edges are written once, in buckets of the end whose rank they carry, and vertices in buckets of their id, so a round
    has one exchange: the sums, added up in each task first. Edges to hot vertices are spread instead and meet a broadcast
    of these vertices' ranks, of which there are MOST_HOT at most. Fixed rounds end when ranks stay to the last digits, as
    all further rounds would be alike.
    """
    spark = edges.sparkSession
    e, m = counted(edges.select("src", "dst"))
    v, n = counted(v.select("id"))
    if not n:
        return v.withColumn("pagerank", F.lit(0.0))
    if mode == "fixed" and n <= DENSE:
        return _power(e, v, n, damping, rounds)
    parts = max(1, -(-max(m, n) // PER_TASK))
    limit = max(HOT, m // MOST_HOT)
    with settings(spark, spark__sql__shuffle__partitions=parts, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__enabled=False):
        weight = cut(e.groupBy("dst").agg(F.count("*").alias("callers")))
        nodes = bucketed(v.join(weight.withColumnRenamed("dst", "id"), "id", "left").select("id", F.coalesce("callers", F.lit(0)).alias("callers")), "id", parts)
        cold = bucketed(e.join(weight.where(F.col("callers") <= limit), "dst"), "dst", parts)
        hot, hottest = None, nodes.where(F.col("callers") > limit)
        if m > limit and hottest.limit(1).count():
            hot = cut(e.join(F.broadcast(hottest.withColumnRenamed("id", "dst")), "dst").repartition(parts))
        rank = last = nodes.select("id", F.lit(1.0 / n).alias("pagerank"))
        spread = nodes.where("callers = 0").count() / n / n if mode == "standard" else 0.0
        for k in range(rounds):
            new = _round(nodes, cold, hot, limit, rank, n, damping, spread)
            if mode == "standard":
                was = rank.select(F.col("id").alias("_id"), F.col("pagerank").alias("was")).hint("shuffle_hash")
                rank = bucketed(new.join(was, F.col("id") == F.col("_id")).drop("_id"), "id", parts)
                ends = F.sum(F.when(F.col("callers") == 0, F.col("pagerank")).otherwise(0.0)) / n
                moved, spread = rank.agg(F.sum(F.abs(F.col("pagerank") - F.col("was"))), ends).first()
                if moved < 1e-6 * n:
                    break
            elif hot is not None or k % ROUNDS == ROUNDS - 1 or k == rounds - 1:
                new, before = bucketed(new, "id", parts), last
                rank = last = new
                apart = F.abs(F.col("pagerank") - F.col("was")) > 1e-14 * F.col("pagerank")
                was = before.select(F.col("id").alias("_id"), F.col("pagerank").alias("was")).hint("shuffle_hash")
                if not rank.join(was, F.col("id") == F.col("_id")).where(apart).limit(1).count():
                    break
            else:
                rank = new
    return rank.select("id", "pagerank")


def _power(e: DataFrame, v: DataFrame, n: int, damping: float, rounds: int) -> DataFrame:
    """Fixed rounds for few vertices: a round is a matrix (row, col, w) with a column '' for what is added, and all rounds
    are its power, by squaring: at most 2 log(rounds) joins of tables of n * n rows.
    """
    callers = e.groupBy("dst").agg(F.count("*").alias("callers"))
    one = e.join(callers, "dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), (damping / F.col("callers")).alias("w"))
    added = v.select(F.col("id").alias("row"), F.lit(None).cast("string").alias("col"), F.lit((1 - damping) / n).alias("w"))
    one = cut(one.unionByName(added))

    def after(a: DataFrame, b: DataFrame) -> DataFrame:
        """The rounds of b, then those of a; what a adds stays as it is."""
        x, y = a.where("col is not null").select("row", F.col("col").alias("mid"), "w"), b.select(F.col("row").alias("mid"), "col", F.col("w").alias("u"))
        rows = x.join(y, "mid").select("row", "col", (F.col("w") * F.col("u")).alias("w")).unionByName(a.where("col is null"))
        return cut(rows.groupBy("row", "col").agg(F.sum("w").alias("w")))

    power = one
    for bit in f"{rounds:b}"[1:]:
        power = after(power, power)
        if bit == "1":
            power = after(one, power)
    rank = power.groupBy(F.col("row").alias("id")).agg(F.sum(F.when(F.col("col").isNull(), F.col("w")).otherwise(F.col("w") / n)).alias("pagerank"))
    return cut(rank)


def _round(nodes: DataFrame, cold: DataFrame, hot: DataFrame | None, limit: int, rank: DataFrame, n: int, damping: float, spread: float) -> DataFrame:
    """(id, pagerank, callers) after one more round."""
    by_end = rank.select(F.col("id").alias("dst"), "pagerank")
    sent = cold.join(by_end.hint("shuffle_hash"), "dst").select("src", (F.col("pagerank") / F.col("callers")).alias("part"))
    if hot is not None:
        ranks = nodes.where(F.col("callers") > limit).select(F.col("id").alias("dst")).join(by_end.hint("shuffle_hash"), "dst")
        sent = sent.unionByName(hot.join(F.broadcast(ranks), "dst").select("src", (F.col("pagerank") / F.col("callers")).alias("part")))
    got = sent.groupBy("src").agg(F.sum("part").alias("got"))
    new = nodes.join(got.hint("shuffle_hash"), nodes["id"] == got["src"], "left")
    return new.select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + spread)).alias("pagerank"), "callers")


def betweenness(edges: DataFrame, v: DataFrame, exact: int = schemas.EXACT_VERTICES, sample: int = 500, seed: int = 42) -> DataFrame:
    """(id, betweenness), directed, over (n - 1)(n - 2): Brandes' sums from every source, or from `sample` seeded ones.

    All sources of a batch go forward together, level by level, WIDTH of them side by side in a row: rows (id, side,
    shortest paths from each of the side's sources) meet the edges, and what a source has seen is left out. Then what
    vertices owe to their predecessors flows back, a level at a time, over the same edges. Edges are written twice, in
    buckets of either end, and stay there: a level shuffles a number for each edge and source that it follows, added up
    in each task first, and no edges. The seeded sources are those whose id and seed have the smallest MD5; their sums
    count n / sample times.
    """
    spark = edges.sparkSession
    v, n = counted(v.select("id"))
    e, m = counted(edges.select("src", "dst").where("src <> dst"))
    chosen = n if n <= exact else min(n, sample)
    if not chosen or not m:
        return v.withColumn("betweenness", F.lit(0.0))
    sources = v if n <= exact else v.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(sample)
    sources = cut(sources)
    scale = (n / chosen) / max(1, (n - 1) * (n - 2))
    batches = max(1, -(-chosen * n // PAIRS))
    tasks = max(1, -(-max(m, n) // PER_TASK))
    parts = []
    with settings(spark, spark__sql__shuffle__partitions=tasks, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__enabled=False):
        down = bucketed(e, "src", tasks, distinct=True)
        up = bucketed(down, "dst", tasks)
        for b in range(batches):
            mine = sources.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b) if batches > 1 else sources
            parts += _owed(up, _levels(down, mine, n, tasks), tasks)
        if not parts:
            return v.withColumn("betweenness", F.lit(0.0))
        sums = cut(reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("owed").alias("owed")))
    return v.join(sums, "id", "left").select("id", (F.coalesce("owed", F.lit(0.0)) * scale).alias("betweenness"))


def _columns(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(WIDTH)]


def _mask(columns: list[str]) -> Column:
    """A bit for each column that isn't null."""
    return reduce(Column.bitwiseOR, (F.when(F.col(c).isNotNull(), 1 << k).otherwise(0) for k, c in enumerate(columns)))


def _levels(down: DataFrame, sources: DataFrame, n: int, tasks: int) -> list[DataFrame]:
    """(id, side, mask, p0, ...) of each level, the sources themselves first: the shortest paths from each of the side's sources, null if it isn't of this level; mask: a bit for each that is."""
    paths = _columns("p")
    place = F.row_number().over(Window.orderBy("id")) - 1  # over a batch's sources only
    first = sources.withColumn("place", place).select("id", F.expr(f"place div {WIDTH}").cast("int").alias("side"), *[F.when(F.col("place") % WIDTH == k, 1.0).alias(c) for k, c in enumerate(paths)])
    levels = [bucketed(first.withColumn("mask", _mask(paths)), "id", tasks)]
    seen, reached, goal = levels[0].select("id", "side", "mask"), 0, None
    while True:
        now = levels[-1].select(F.sum(F.bit_count("mask"))).first()[0]
        if not now:
            return levels[:-1]
        reached += now
        goal = goal or now * n
        if reached == goal:  # every source has seen every vertex
            return levels
        step = down.join(levels[-1].hint("shuffle_hash"), down["src"] == levels[-1]["id"]).groupBy(F.col("dst").alias("id"), "side").agg(*[F.sum(c).alias(c) for c in paths])
        was = seen.groupBy(F.col("id").alias("_id"), F.col("side").alias("_side")).agg(F.bit_or("mask").alias("mask"))
        got = step.withColumn("got", _mask(paths)).join(was, (F.col("id") == F.col("_id")) & (F.col("side") == F.col("_side")), "left")
        got = got.withColumn("mask", F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0))))).where("mask <> 0")
        fresh = [F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col(c)).alias(c) for k, c in enumerate(paths)]
        levels.append(bucketed(got.select("id", "side", "mask", *fresh), "id", tasks))
        seen = seen.unionByName(levels[-1].select("id", "side", "mask"))
        if len(levels) % 16 == 0:  # not a table more to read for every level
            seen = cut(seen)


def _owed(up: DataFrame, levels: list[DataFrame], tasks: int) -> list[DataFrame]:
    """(id, owed) of each level but the sources': of every shortest path through a vertex the share that ends beyond it."""
    paths, owed, each = _columns("p"), _columns("o"), _columns("e")
    below, out = levels[-1].select("*", *[F.when(F.col(c).isNotNull(), 0.0).alias(o) for c, o in zip(paths, owed, strict=True)]), []
    for k in range(len(levels) - 2, 0, -1):
        sent = below.select("id", "side", *[((F.col(o) + 1) / F.col(c)).alias(x) for c, o, x in zip(paths, owed, each, strict=True)])
        got = up.join(sent.hint("shuffle_hash"), up["dst"] == sent["id"]).groupBy(F.col("src").alias("_id"), F.col("side").alias("_side")).agg(*[F.sum(x).alias(x) for x in each])
        above = levels[k].join(got, (F.col("id") == F.col("_id")) & (F.col("side") == F.col("_side")), "left")
        rows = above.select("id", "side", *paths, *[(F.col(c) * F.coalesce(x, F.lit(0.0))).alias(o) for c, x, o in zip(paths, each, owed, strict=True)])
        below = bucketed(rows.withColumn("owed", reduce(Column.__add__, (F.coalesce(o, F.lit(0.0)) for o in owed))), "id", tasks)
        out.append(below.select("id", "owed").where("owed > 0"))
    return out
