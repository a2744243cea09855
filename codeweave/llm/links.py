"""Connected components of a link table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) → (id, component): each id that is in a link, with the smallest id it reaches.

    Every round points each id at its smallest neighbour, then at that one's, and contracts the links by these pointers:
    links between ids that meet vanish, so what is left shrinks geometrically, and the pointers of all rounds, followed
    from the last back to the first, name the components. Each round is written to the shared folder.
    Rows with a null end and links from an id to itself are ignored. No links: no rows.
    """
    edges = stored(_apart(links.select("a", "b")), "links")
    rounds: list[DataFrame] = []
    while True:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up"))
        near = stored(near, "near")
        x, y = near.alias("x"), near.alias("y")
        far = stored(x.join(y, F.col("x.up") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.up").alias("up")), "far")
        rounds.append(far)
        one = edges.join(far.select(F.col("id").alias("a"), F.col("up").alias("ua")), "a").select("ua", "b")
        two = one.join(far.select(F.col("id").alias("b"), F.col("up").alias("ub")), "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        edges = stored(_apart(two), "links")
        if not edges.limit(1).count():
            break
    out = rounds[-1].select("id", F.col("up").alias("component"))
    for far in reversed(rounds[:-1]):
        known = out.select(F.col("id").alias("up"), "component")
        out = far.join(known, "up", "left").select("id", F.coalesce("component", "up").alias("component"))
    return stored(out, "components")


def _apart(edges: DataFrame) -> DataFrame:
    """Distinct links with the smaller end first."""
    a, b = F.col("a"), F.col("b")
    return edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
