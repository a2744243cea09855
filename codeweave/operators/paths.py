"""What can be reached, and shortest paths, by breadth-first rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave.operators.tables import counted, cut


def reachable(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(id, hops) of what can be reached from the ids of start in 1 to depth steps, start itself left out."""
    seen = cut(start.select("id", F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges, front.id == edges.src).select(F.col("dst").alias("id")).distinct()
        front, rows = counted(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(k)))
        if not rows:
            break
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def traces(edges: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """pairs (pair, a, b) → (pair, path array): of each pair the first `most` shortest paths from a to b, in order of their ids.

    All pairs are searched at once, from both ends: rows (pair, vertex, steps) of the side with fewer rows take the next
    step, until a pair's sides meet or one of them ends. Paths then grow from b back to a over vertices on shortest
    paths only. A head keeps its first `most` paths to b: what follows a head doesn't depend on what comes before it, so
    no other one can be among the first in the end. Equal ends have one path of one vertex; ends that no edge touches
    have none.
    """
    e = edges.select("src", "dst")
    touched = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = pairs.join(touched.select(F.col("id").alias("a")), "a", "left_semi").join(touched.select(F.col("id").alias("b")), "b", "left_semi")
    known, rows = counted(known.select("pair", "a", "b").distinct())
    if not rows:
        return edges.sparkSession.createDataFrame([], f"pair {pairs.schema['pair'].dataType.simpleString()}, path array<string>")
    sides = [_Side(known, "a", "src", "dst", rows), _Side(known, "b", "dst", "src", rows)]
    meets = _met(*sides)
    while True:
        near, far = sorted(sides, key=lambda s: s.rows)
        near.advance(e, far, meets)
        if not near.rows:
            break
        meets = meets.unionByName(_met(*sides))
    return _grown(e, known, *sides, cut(meets), most)


class _Side:
    """One direction of a search: (pair, id, steps) of all that was reached, and of the last step."""

    def __init__(self, known: DataFrame, end: str, here: str, there: str, rows: int):
        self.here, self.there, self.rows, self.depth = here, there, rows, 0
        self.front = self.seen = known.select("pair", F.col(end).alias("id"), F.lit(0).alias("steps"))

    def advance(self, e: DataFrame, other: _Side, meets: DataFrame) -> None:
        """A step more, for pairs whose other side goes on and that have not met."""
        front = self.front.join(other.front.select("pair").distinct(), "pair", "left_semi").join(meets.select("pair").distinct(), "pair", "left_anti")
        step = front.join(e, F.col("id") == F.col(self.here)).select("pair", F.col(self.there).alias("id")).distinct()
        self.depth += 1
        new = step.join(self.seen.select("pair", "id"), ["pair", "id"], "left_anti")
        self.front, self.rows = counted(new.withColumn("steps", F.lit(self.depth)))
        self.seen = self.seen.unionByName(self.front)
        if self.depth % 16 == 0:  # not a table more to read for every step
            self.seen = cut(self.seen)


def _met(a: _Side, b: _Side) -> DataFrame:
    """(pair, id, left, length): vertices where the sides meet, the steps left to the end and the length of the paths."""
    here = a.front.join(b.front.select("pair", "id"), ["pair", "id"], "left_semi")
    return cut(here.select("pair", "id", F.lit(b.depth).alias("left"), F.lit(a.depth + b.depth).alias("length")))


def _grown(e: DataFrame, known: DataFrame, a: _Side, b: _Side, meets: DataFrame, most: int) -> DataFrame:
    """Paths from b back to a over the vertices that are so many steps from b on a shortest path."""
    of = cut(meets.groupBy("pair").agg(F.first("left").alias("half"), F.first("length").alias("length")))
    on = [meets.select("pair", "id", "left")]
    for k in range(b.depth - 1, -1, -1):  # from where the sides met on towards b
        before = on[0].where(F.col("left") == k + 1) if k == b.depth - 1 else on[-1].unionByName(on[0].where(F.col("left") == k + 1))
        step = before.join(e, F.col("id") == F.col("src")).select("pair", F.col("dst").alias("id")).distinct()
        at = b.seen.where(F.col("steps") == k).select("pair", "id")
        on.append(cut(step.join(at, ["pair", "id"], "left_semi").withColumn("left", F.lit(k))))
    first_half = a.seen.join(of, "pair").select("pair", "id", (F.col("length") - F.col("steps")).alias("left"), "half").where(F.col("left") > F.col("half")).drop("half")
    dag = cut(reduce(DataFrame.unionByName, [*on, first_half]).distinct())
    longest = of.agg(F.max("length")).first()[0]
    paths = known.join(of, "pair").select("pair", "length", F.array("b").alias("path"))
    out = [paths.where("length = 0")]
    first = Window.partitionBy("pair", F.get("path", F.lit(0))).orderBy("path")
    for k in range(1, (longest or 0) + 1):
        level = dag.where(F.col("left") == k).select("pair", F.col("id").alias("src"))
        step = paths.join(e, F.get("path", F.lit(0)) == F.col("dst")).join(level, ["pair", "src"], "left_semi")
        step = step.select("pair", "length", F.concat(F.array("src"), "path").alias("path")).withColumn("rank", F.row_number().over(first))
        paths = cut(step.where(F.col("rank") <= most).drop("rank"))
        out.append(paths.where(F.col("length") == k))
    return reduce(DataFrame.unionByName, out).select("pair", "path")


def steps(paths: DataFrame) -> DataFrame:
    """(pair, path) → (pair, path_no, position, id): numbered by their ids' order, a row a vertex, both from 1."""
    numbered = paths.withColumn("path_no", F.row_number().over(Window.partitionBy("pair").orderBy("path")))
    return numbered.select("pair", "path_no", F.posexplode("path").alias("at", "id")).select("pair", "path_no", (F.col("at") + 1).alias("position"), "id")


def shortest_paths(edges: DataFrame, a: str, b: str, most: int = 5) -> DataFrame:
    """(path array) of the first `most` shortest paths from a to b, in order of their ids; equal ends: one path of one."""
    pairs = edges.sparkSession.createDataFrame([(0, a, b)], "pair int, a string, b string")
    return traces(edges, pairs, most).select("path").orderBy("path")
