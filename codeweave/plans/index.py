"""Indexing a source tree: what changed by content hash, extraction, resolution, metrics, and one commit of snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave import schemas
from codeweave.operators import details, extract, graph, resolve, rollup, store, summaries
from codeweave.sources import files as sources
from codeweave.streaming import incremental


def run(spark: SparkSession, root: str, folder: str, force: bool = False, languages=tuple(schemas.LANGUAGES.values()), excluded=schemas.EXCLUDED) -> dict:
    """Brings the index in `folder` up to the tree at `root`; returns counts.

    Files whose hash is as stored are not read again (unless forced). References are stored too, so all edges are
    resolved anew against all symbols: a new symbol catches old references. Nothing changed: nothing is written.
    """
    index = store.Index(spark, folder)
    found = sources.discover(spark, root, languages, excluded)
    records = graph.cut(extract.file_rows(found))
    old = index.tables()
    change = graph.cut(incremental.changes(old["files"], records))
    by = {r.change_type: r["count"] for r in change.groupBy("change_type").count().collect()}
    if force:
        todo = records.select("path")
    else:
        todo = change.where("change_type <> 'deleted'").select("path")
    stats = {k: by.get(k, 0) for k in ("added", "changed", "deleted")}
    if not force and not by and index.state()["version"]:
        return stats | counts(index)
    gone = change.where("change_type <> 'added'").select("path").unionByName(todo).distinct()
    kept = store.delete_files({k: old[k] for k in ("files", "symbols", "edges", "raw_refs")}, gone)
    new_symbols, new_refs = extract.extract(found.join(todo, "path", "left_semi"))
    new_symbols = store.last_wins(new_symbols, ["id"]).drop("ordinal")
    symbols = graph.cut(kept["symbols"].unionByName(new_symbols.select(*kept["symbols"].columns)))
    refs = graph.cut(kept["raw_refs"].unionByName(new_refs.select(*kept["raw_refs"].columns)))
    edges = graph.cut(resolve.resolve(refs, symbols))
    removed = change.where("change_type = 'deleted'").select("path")
    notes = store.delete_files({"files": old["files"], "edges": old["edges"], "summaries": old["summaries"]}, removed)["summaries"]
    changed = {
        "files": store.upsert(kept["files"], records.join(todo, "path", "left_semi"), ["path"]),
        "symbols": symbols,
        "raw_refs": refs,
        "edges": edges,
        "metrics": graph.metrics(symbols, edges),
        "summaries": store.mark_stale(notes, change.where("change_type = 'changed'").select("path")),
    }
    index.commit(changed, sources.head(root))
    return stats | counts(index)


def counts(index: store.Index) -> dict:
    state = index.state()
    return {n: index.table(n, state).count() for n in ("files", "symbols", "edges", "metrics", "summaries")} | {"commit": state["commit"]}


def summarize(spark: SparkSession, root: str, folder: str, model: Callable | None = None, name: str = "plain", skip_fresh: bool = True) -> dict:
    """Summaries of files and their symbols, then of directories from their files' summaries."""
    index = store.Index(spark, folder)
    files, symbols, old = index.table("files"), index.table("symbols"), index.table("summaries")
    todo = summaries.to_do(files, old) if skip_fresh else files
    text = sources.discover(spark, root).select("path", F.decode(F.col("content"), "ISO-8859-1").alias("text"))
    asked = summaries.prompts(text.join(todo.select("path"), "path", "left_semi"), symbols)
    new = graph.cut(summaries.rows(summaries.replies(asked, model), symbols, name))
    both = store.upsert(old, new, ["target_id"])
    lines = rollup.directory_summaries(files, both)
    dirs = lines.select(F.col("directory").alias("target_id"), F.lit("directory").alias("target_kind"), F.col("text").alias("summary_text"), F.lit(name).alias("model"), F.current_timestamp().alias("generated_at"), F.lit(False).alias("is_stale"))
    dirs = graph.cut(dirs if not skip_fresh else dirs.join(both.where("not is_stale").select("target_id"), "target_id", "left_anti"))
    index.commit({"summaries": store.upsert(both, dirs, ["target_id"])})
    asked_files, made = asked.count(), new.where("target_kind = 'file'").count()
    skipped = files.count() - todo.count()
    return {"asked": asked_files, "skipped": skipped, "errors": asked_files - made, "files": made, "symbols": new.where("target_kind = 'symbol'").count(), "directories": dirs.count()}


class Views:
    """The read side: every tool and endpoint as DataFrames over one index."""

    def __init__(self, index: store.Index):
        self.index = index
        self.files, self.symbols, self.edges, self.metrics, self.summaries = map(index.tables().get, ("files", "symbols", "edges", "metrics", "summaries"))

    def overview(self) -> dict:
        c = counts(self.index)
        n = c["symbols"]
        return c | {
            "by_language": {r.language: r["count"] for r in self.files.groupBy("language").count().collect()},
            "by_kind": {r.kind: r["count"] for r in self.symbols.groupBy("kind").count().collect()},
            "density": c["edges"] / (n * (n - 1)) if n > 1 else 0.0,
        }

    def named(self, ids: DataFrame) -> DataFrame:
        """(id, …) with display names."""
        names = self.symbols.select("id", "qualified_name", "file_path")
        return ids.join(names, "id", "left").withColumn("name", F.coalesce("qualified_name", F.substring_index("id", "::", -1)))

    def symbol(self, name: str) -> DataFrame:
        """All symbols of a name (or id) with their metrics and summaries, callers and callees with names and files."""
        chosen = self.symbols.where((F.col("name") == name) | (F.col("id") == name))
        return details.symbol_details(chosen, self.metrics, self.summaries, self.edges, self.symbols).orderBy("id")

    def search(self, q: str, limit: int = 20) -> DataFrame:
        from codeweave.plans.queries import search

        return search(self.symbols, q, limit)

    def hotspots(self, n: int = 20) -> DataFrame:
        """The n best ranked with their rank; those without a symbol drop out afterwards, which leaves gaps."""
        by = [F.desc("pagerank"), F.asc("symbol_id")]
        top = self.metrics.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # n rows
        return top.join(self.symbols, top.symbol_id == self.symbols.id).select("rank", "id", "qualified_name", "file_path", "pagerank", "in_degree", "out_degree").orderBy("rank")

    def trace(self, a: str, b: str, most: int = 5) -> DataFrame:
        """(source, target, path_no, position, id, name, file_path): shortest paths between all symbols of two names, in one search."""
        e = graph.cut(graph.simple_edges(self.edges))
        ids = lambda n, c: self.symbols.where((F.col("name") == n) | (F.col("id") == n)).select(F.lit(f"{a} {b}").alias("asked"), F.col("id").alias(c))
        pairs = ids(a, "a").join(ids(b, "b"), "asked").select(F.struct("a", "b").alias("pair"), "a", "b")
        steps = graph.steps(graph.traces(e, pairs, most))
        named = self.named(steps.select(F.col("pair.a").alias("source"), F.col("pair.b").alias("target"), "path_no", "position", "id"))
        return named.select("source", "target", "path_no", "position", "id", "name", "file_path").orderBy("source", "target", "path_no", "position")

    def related(self, name: str) -> DataFrame:
        start = self.symbols.where((F.col("name") == name) | (F.col("id") == name)).select("id").orderBy("id").limit(1)
        e = graph.cut(graph.simple_edges(self.edges))
        calls = self.edges.where("kind = 'calls'")
        callers = calls.join(start, calls.target_id == start.id).select(F.col("source_id").alias("id"))
        callees = calls.where("resolved").join(start, calls.source_id == start.id).select(F.col("target_id").alias("id"))
        near = graph.reachable(e, start, 2).select("id").join(callers.unionByName(callees), "id", "left_anti")
        tag = lambda df, t: df.distinct().withColumn("relation", F.lit(t))
        return self.named(tag(callers, "caller").unionByName(tag(callees, "callee")).unionByName(tag(near, "nearby"))).select("relation", "id", "name", "file_path").orderBy("relation", "id")

    def hot_paths(self, name: str, depth: int = 5, n: int = 15) -> DataFrame:
        start = self.symbols.where((F.col("name") == name) | (F.col("id") == name)).select("id").orderBy("id").limit(1)
        near = graph.reachable(graph.cut(graph.simple_edges(self.edges)), start, depth)
        ranked = near.join(self.metrics, near.id == self.metrics.symbol_id, "left").select("id", "hops", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
        return ranked.orderBy(F.desc("pagerank"), "id").limit(n)

    def module(self, path: str) -> DataFrame:
        return rollup.module_summary(self.files, self.symbols, path).orderBy("path", "kind")

    def patterns(self, top: int = schemas.TOP) -> dict:
        e = graph.cut(graph.simple_edges(self.edges))
        g = graph.degrees(e, graph.vertices(e, self.symbols))
        rings = graph.components(e).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("component").limit(top)
        rows = lambda df: [r.asDict() for r in df.collect()]
        return {"god_objects": rows(graph.god_objects(g, top=top)), "orphans": [r.id for r in graph.orphans(g, top).collect()], "cycles": [r.ids for r in rings.collect()], "hub_files": rows(graph.hub_files(e, self.symbols, top))}

    def tree(self) -> DataFrame:
        notes = self.summaries.select(F.col("target_id").alias("path"), "summary_text")
        return rollup.tree(self.files.select("path"), self.symbols).join(notes, "path", "left").orderBy("path")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes = self.symbols.join(self.metrics, F.col("id") == F.col("symbol_id"), "left")
        nodes = nodes.select("id", "name", "kind", F.col("file_path").alias("filePath"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.coalesce("in_degree", F.lit(0)).alias("inDegree"), F.coalesce("out_degree", F.lit(0)).alias("outDegree"))
        return nodes, self.edges.where("resolved").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind")

    def file(self, path: str) -> DataFrame:
        """A file with its summary and its symbols; no row if there is no such file."""
        return details.file_details(self.files.where(F.col("path") == path), self.symbols.where(F.col("file_path") == path), self.summaries)
