"""Graph operators: vertices and edges are DataFrames (id) and (src, dst).

Loops cut their lineage by writing each round to the cluster's checkpoint folder. Rounds are in centrality (PageRank,
betweenness), paths (reachability, shortest paths) and cycles (strongly connected components).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave import schemas
from codeweave.operators.centrality import betweenness, pagerank
from codeweave.operators.cycles import components
from codeweave.operators.paths import reachable, shortest_paths, steps, traces
from codeweave.operators.resolve import Links, spelled
from codeweave.operators.tables import cut, shared_folder

__all__ = ["betweenness", "components", "cut", "degree_hubs", "degrees", "god_objects", "highlighted", "hub_files", "kinds", "link_components", "link_degrees", "link_kinds", "metrics", "neighbourhood", "orphans", "pagerank", "reachable", "shared_folder", "shortest_paths", "simple_edges", "steps", "traces", "vertices"]


def simple_edges(edges: DataFrame) -> DataFrame:
    """Resolved edges (source_id, target_id, kind, resolved) → distinct (src, dst)."""
    return edges.where("resolved").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()


def kinds(edges: DataFrame) -> DataFrame:
    """Resolved edges → (src, dst, kind): an edge once, of several kinds the last one in order of their names."""
    return edges.where("resolved").groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max("kind").alias("kind"))


def highlighted(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """edges with `highlighted`: whether one of the chosen vertices (id) is an end of it."""
    marks = chosen.select("id").distinct()
    src, dst = (marks.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")) for c in ("src", "dst"))
    rows = edges.join(src, "src", "left").join(dst, "dst", "left")
    return rows.select(*edges.columns, F.coalesce("_src", "_dst", F.lit(False)).alias("highlighted"))


def vertices(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The ends of edges and the given ids (id)."""
    v = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (v.unionByName(ids.select("id")) if ids is not None else v).distinct()


def degrees(edges: DataFrame, v: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) from one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    none = v.select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    sums = ends.select("e.*").unionByName(none).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return sums.select("id", F.col("in_degree").cast("int").alias("in_degree"), F.col("out_degree").cast("int").alias("out_degree"))


def link_degrees(of: Links, ids: DataFrame | None = None) -> DataFrame:
    """As degrees(simple_edges(...), vertices(..., ids)), from edges that are not spelled out: a caller of a name has all
    its symbols below it, a symbol all callers of its name above it.
    """
    calls, single = of.callers.select("source_id", "leaf").distinct(), simple_edges(of.single)
    size = lambda df, n: df.groupBy("leaf").agg(F.count("*").alias(n))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = [
        calls.join(size(of.targets, "n"), "leaf").select(F.col("source_id").alias("id"), zero.alias("i"), F.col("n").alias("o")),
        of.targets.join(size(calls, "n"), "leaf").select(F.col("target_id").alias("id"), F.col("n").alias("i"), zero.alias("o")),
        single.select(F.col("src").alias("id"), zero.alias("i"), one.alias("o")),
        single.select(F.col("dst").alias("id"), one.alias("i"), zero.alias("o")),
    ]
    if ids is not None:
        rows.append(ids.select("id", zero.alias("i"), zero.alias("o")))
    sums = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return sums.select("id", F.col("i").cast("int").alias("in_degree"), F.col("o").cast("int").alias("out_degree"))


def link_kinds(of: Links) -> DataFrame:
    """As kinds(), from edges that are not spelled out."""
    named = cut(of.callers.groupBy("source_id", "leaf").agg(F.max("kind").alias("kind")), "links")
    rows = spelled(named, of.targets).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "kind")
    return rows.unionByName(kinds(of.single))


def metrics(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The metrics table: of all symbols and ends of resolved edges."""
    e = cut(simple_edges(edges))
    v = cut(vertices(e, symbols.select("id")))
    rows = degrees(e, v).join(betweenness(e, v), "id").join(pagerank(e, v), "id")
    return rows.select(F.col("id").alias("symbol_id"), "in_degree", "out_degree", "betweenness", "pagerank")


def god_objects(degree: DataFrame, least: int = schemas.GOD_DEGREE, top: int | None = schemas.TOP) -> DataFrame:
    """Vertices of total degree `least` or more, the largest first."""
    total = F.col("in_degree") + F.col("out_degree")
    rows = degree.select("id", total.alias("degree")).where(total >= least).orderBy(F.desc("degree"), "id")
    return rows.limit(top) if top else rows


def orphans(degree: DataFrame, top: int | None = schemas.TOP) -> DataFrame:
    rows = degree.where("in_degree = 0 and out_degree = 0").select("id").orderBy("id")
    return rows.limit(top) if top else rows


def hub_files(edges: DataFrame, symbols: DataFrame, top: int | None = schemas.TOP) -> DataFrame:
    """Files by the ends of edges their symbols are."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    rows = ends.join(symbols.select("id", "file_path"), "id").groupBy("file_path").agg(F.count("*").alias("edge_count")).orderBy(F.desc("edge_count"), "file_path")
    return rows.limit(top) if top else rows


def degree_hubs(degree: DataFrame, symbols: DataFrame, top: int | None = schemas.TOP) -> DataFrame:
    """As hub_files(), from the vertices' degrees."""
    rows = degree.join(symbols.select("id", "file_path"), "id").groupBy("file_path")
    rows = rows.agg(F.sum(F.col("in_degree").cast("long") + F.col("out_degree")).alias("edge_count")).where("edge_count > 0").orderBy(F.desc("edge_count"), "file_path")
    return rows.limit(top) if top else rows


def link_components(of: Links) -> DataFrame:
    """As components(simple_edges(...)), from edges that are not spelled out: a name is a vertex between its callers and
    its symbols, so vertices reach each other as they do by edges. Names are left out of what is found.
    """
    vertex = lambda c: F.concat(F.lit("v"), F.col(c))
    name = F.concat(F.lit("n"), F.col("leaf"))
    single = simple_edges(of.single)
    rows = [
        of.callers.select(vertex("source_id").alias("src"), name.alias("dst")),
        of.targets.select(name.alias("src"), vertex("target_id").alias("dst")),
        single.select(vertex("src").alias("src"), vertex("dst").alias("dst")),
    ]
    found = components(reduce(DataFrame.unionByName, rows).where("src is not null and dst is not null"))
    found = found.where("id like 'v%'").select(F.substring("id", 2, 1 << 30).alias("id"), "component")
    first = found.groupBy("component").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return found.join(first, "component").select("id", F.col("first").alias("component"))


def neighbourhood(edges: DataFrame, centre: str) -> tuple[DataFrame, DataFrame]:
    """The centre with its neighbours in either direction, and the edges among them."""
    touch = edges.where((F.col("src") == centre) | (F.col("dst") == centre))
    ids = vertices(touch)
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ids, inside
