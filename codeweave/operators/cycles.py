"""Strongly connected components: whole chains and rings go in doubling steps, the rest by colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.operators.tables import counted, cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the strongly connected components of two vertices or more; component is the smallest id.

    Vertices that no cycle can hold are trimmed (see _trimmed) until none is found. Then every vertex takes the smallest
    id that reaches it, a colour, so there is a pivot for each colour; within a colour those that reach its root are the
    root's component. The rest goes round again.
    """
    left, rows = counted(edges.select("src", "dst").where("src <> dst").distinct())
    found: list[DataFrame] = []
    while rows:
        trimmed = True
        while rows and trimmed:
            left, rows, rings, trimmed = _trimmed(left, rows)
            if rings is not None:
                found.append(rings)
        if not rows:
            break
        done = _roots(left, _colours(left))
        found.append(done)
        left, rows = _without(left, done.select("id"))
    if not found:
        return edges.sparkSession.createDataFrame([], "id string, component string")
    all_found = reduce(DataFrame.unionByName, found)
    sizes = all_found.groupBy("component").count().where("count > 1").select("component")
    return all_found.join(sizes, "component", "left_semi").select("id", "component")


def _without(left: DataFrame, gone: DataFrame) -> tuple[DataFrame, int]:
    gone = gone.distinct()
    rest = left.join(gone.select(F.col("id").alias("src")), "src", "left_anti")
    return counted(rest.join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))


def _trimmed(left: DataFrame, before: int) -> tuple[DataFrame, int, DataFrame | None, bool]:
    """(edges that are left, their number, rings (id, component) or None, whether anything went).

    A vertex with one predecessor hangs on it: a cycle through the one goes through the other. Such vertices are followed
    up to one that has none or several, all at once, each step twice as far as the last. What hangs on a vertex that
    nothing comes to lies on no cycle. What hangs on nothing but such vertices comes from a ring of them, which is a
    component as it is, and the vertices below the ring are on no cycle. So a chain or a ring of n vertices takes log n
    steps. The same holds for successors, and both ways (`way` 0 and 1) are followed in the same steps.
    """
    one = lambda c, other: F.struct(F.col(c).alias("id"), F.lit(int(c == "dst")).alias("i"), F.when(F.lit(c == "dst"), F.col(other)).alias("before"), F.lit(int(c == "src")).alias("o"), F.when(F.lit(c == "src"), F.col(other)).alias("after"))
    ends = left.select(F.explode(F.array(one("src", "dst"), one("dst", "src"))).alias("e")).select("e.*")
    ends = ends.groupBy("id").agg(F.sum("i").alias("i"), F.min("before").alias("before"), F.sum("o").alias("o"), F.min("after").alias("after"))
    ends, loose = counted(ends, of="i <= 1 or o <= 1")
    if not loose:
        return left, before, None, False
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("i").alias("n"), F.col("before").alias("up")), F.struct(F.lit(1).alias("way"), F.col("o").alias("n"), F.col("after").alias("up")))
    ends = ends.select("id", F.explode(ways).alias("w")).select("w.way", "id", "w.n", "w.up")
    hanging = ends.where("n = 1").select("way", "id", "up", F.least("id", "up").alias("low"))
    ended: list[DataFrame] = []
    reach, most, going = 1, loose, loose
    while going and reach <= 2 * most:
        up = hanging.select("way", F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"))
        for past in ended:
            up = up.unionByName(past.select("way", F.col("id").alias("up"), F.col("up").alias("next"), F.lit(None).cast("string").alias("next_low")))
        # Whose next vertex has ended, or hangs on nothing, has come to its top.
        step = hanging.join(up, ["way", "up"], "left").select("way", "id", F.coalesce("next", "up").alias("up"), F.least("low", "next_low").alias("low"), F.col("next_low").isNull().alias("ended"))
        step, going = counted(step, of="not ended")
        ended.append(step.where("ended").select("way", "id", "up"))
        hanging = step.where("not ended").drop("ended")
        reach *= 2
    tops = ends.where("n = 0").select("way", F.col("id").alias("up"))
    gone = [tops.select(F.col("up").alias("id")), *[x.join(tops, ["way", "up"], "left_semi").select("id") for x in ended]]
    rings = None
    if going:
        gone.append(hanging.select("id"))
        on = hanging.select("way", F.col("up").alias("id")).distinct()
        rings = cut(hanging.join(on, ["way", "id"], "left_semi").select("id", F.col("low").alias("component")).distinct())
    rest, rows = _without(left, reduce(DataFrame.unionByName, gone))
    return rest, rows, rings, rows < before


def _colours(left: DataFrame) -> DataFrame:
    """(id, colour): the smallest id that reaches a vertex; a round's messages come from what changed in the last one."""
    everything = cut(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
    colour = everything
    front = everything
    k = 0
    while True:
        sent = front.join(left, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
        front, n = counted(sent.join(colour, "id").where("new < colour").select("id", F.col("new").alias("colour")))
        if not n:
            return colour
        colour = colour.unionByName(front).groupBy("id").agg(F.min("colour").alias("colour"))
        k += 1
        if k % 4 == 0:
            colour = cut(colour)


def _roots(left: DataFrame, colour: DataFrame) -> DataFrame:
    """(id, component): backwards from each colour's root, inside its colour."""
    colour = cut(colour)
    a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
    inside = cut(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
    seen = front = cut(colour.where("id = colour"))
    k = 0
    while True:
        step = inside.join(front.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
        front, n = counted(step.join(seen.select("id"), "id", "left_anti"))
        if not n:
            return seen.select("id", F.col("colour").alias("component"))
        seen = seen.unionByName(front)
        k += 1
        if k % 8 == 0:
            seen = cut(seen)
