"""Raw references → edges, by name."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.functions import imports
from codeweave.operators.tables import cut


def names(refs: DataFrame, strict: bool = True) -> DataFrame:
    """refs with `candidate`, the full text an unresolved edge points at, and `leaf`, the name to look up."""
    calls = refs.where("kind = 'calls'").withColumn("candidate", F.col("ref_text")).withColumn("leaf", F.col("ref_text"))
    tail = lambda c: F.substring_index(c, ".", -1)
    found = refs.where("kind = 'imports'").withColumn("candidate", F.explode(imports.candidates(F.col("ref_text"), F.coalesce("language", F.lit("python")), strict)))
    bases = refs.where("kind = 'inherits'").withColumn("candidate", F.col("ref_text"))
    return calls.unionByName(found.withColumn("leaf", tail(F.col("candidate")))).unionByName(bases.withColumn("leaf", tail(F.col("candidate"))))


#: A block is a square of callers and symbols of a name, of SIDES at least and at most; a task takes about BLOCKS of them.
#: Of a block's symbols TILE at once go to all its callers.
SIDES, BLOCKS, TILE = (256, 4096), 16, 256


@dataclass
class Links:
    """Edges before they are spelled out. Every caller of a name has each symbol of it for a target, so edges grow with the
    product of both; these tables grow with references and symbols only, and so does what is counted or joined on them.

    callers (source_id, kind, leaf, more), each once; targets (leaf, target_id, more), each once; single (source_id,
    target_id, kind, resolved, more): the edges that no name gives, those without a symbol above all.
    """

    callers: DataFrame
    targets: DataFrame
    single: DataFrame

    def edges(self) -> DataFrame:
        """All edges, each once."""
        rows = spelled(self.callers, self.targets)
        if "resolved" not in rows.columns:
            rows = rows.withColumn("resolved", F.lit(True))
        return rows.select(*self.single.columns).unionByName(self.single)


def spelled(callers: DataFrame, targets: DataFrame) -> DataFrame:
    """callers (leaf, any others) with all targets (leaf, any others) of their name, in blocks of both.

    A block's callers are one row and so are TILE of its targets, and only copies of these are shuffled, one for each
    block; no task gets a popular name whole. Blocks grow with the edges, up to SIDES[1], where a task makes about
    BLOCKS * SIDES[1] ** 2 of them and tasks get more. A task's rows are in order of callers and tiles, and the tiles'
    length is a multiple of 8 mostly, so files of them, with dictionaries, stay small: ids repeat at whole bytes.
    """
    size = lambda df, n: df.groupBy("leaf").agg(F.count("*").alias(n))
    sizes = size(callers, "_callers").join(size(targets, "_targets"), "leaf")
    edges = sizes.agg(F.sum(F.col("_callers") * F.col("_targets"))).first()[0] or 0
    parts = max(int(callers.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges // (BLOCKS * SIDES[1] ** 2))
    side = min(max(SIDES[0], math.isqrt(edges // (BLOCKS * parts))), SIDES[1])
    blocks = sizes.select("leaf", F.ceil(F.col("_callers") / side).alias("_rows"), F.ceil(F.col("_targets") / side).alias("_columns"))

    def packed(df: DataFrame, mine: str, n: str, to: str) -> DataFrame:
        rest = [c for c in df.columns if c != "leaf"]
        dealt = df.join(blocks.select("leaf", n), "leaf").withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.col(n)))
        return dealt.groupBy("leaf", mine).agg(F.collect_list(F.struct(*rest)).alias(to))

    def copied(df: DataFrame, other: str, m: str) -> DataFrame:
        copies = df.join(blocks.select("leaf", m), "leaf").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))).drop(m)
        # The blocks are small and what comes of them is not, so they aren't put together by their bytes.
        return copies.repartition(parts, "leaf", "_i", "_j")

    whole = F.size("_b") - F.size("_b") % 8
    tiles = F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1)), F.lit(TILE)), lambda at: F.slice("_b", at, F.greatest(F.least(F.lit(TILE), whole - at + 1), F.lit(0))))
    tiles = F.filter(F.concat(tiles, F.array(F.slice("_b", whole + 1, F.lit(8)))), lambda tile: F.size(tile) > 0)
    a = copied(packed(callers, "_i", "_rows", "_a"), "_j", "_columns")
    b = copied(packed(targets, "_j", "_columns", "_b").withColumn("_b", F.explode(tiles)), "_i", "_rows")
    return b.join(a, ["leaf", "_i", "_j"]).select("leaf", "_b", F.inline("_a")).select("*", F.inline("_b")).drop("_b")


def links(found: DataFrame, symbols: DataFrame, *by: str) -> Links:
    """For what names() made of references. Every reference meets all symbols of its name, in any file and language;
    without any it keeps its text. One edge stays of each (source, target, kind) and `by`, resolved if any was.
    """
    rest = [c for c in by if c != "leaf"]
    symbols = symbols.select(F.col("name").alias("leaf"), F.col("id").alias("target_id")).distinct()
    w = Window.partitionBy("target_id")
    known = symbols.where("target_id is not null").withColumn("_several", F.min("leaf").over(w) < F.max("leaf").over(w))
    callers = found.select("source_id", "kind", "leaf", *rest).distinct()
    # An id of several names can be met by each of them.
    several = callers.join(known.where("_several"), "leaf").select("source_id", "target_id", "kind", *by).distinct().withColumn("resolved", F.lit(True))
    met = symbols.groupBy("leaf").agg(F.every(F.col("target_id").isNotNull()).alias("whole")).where("whole")
    lone = found.join(met, "leaf", "left_anti").select("source_id", F.col("candidate").alias("target_id"), "kind", *by).distinct()
    lone = unmet(lone, callers, known.select("leaf", "target_id"), *by).withColumn("resolved", F.lit(False))
    return Links(callers, known.where("not _several").drop("_several"), several.unionByName(lone))


def unmet(lone: DataFrame, callers: DataFrame, targets: DataFrame, *by: str) -> DataFrame:
    """lone (source_id, target_id, kind, by) without the texts that are ids of symbols which their sources meet by name."""
    same = lambda columns: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    ids = lone.join(targets.select("target_id", F.col("leaf").alias("_leaf")), "target_id").alias("a")
    by_name = [F.col("a._leaf") == F.col("b.leaf"), *same(["source_id", "kind", *by])]
    met = ids.join(callers.alias("b"), reduce(Column.__and__, by_name), "left_semi").select(*lone.columns)
    return lone.alias("a").join(met.alias("b"), reduce(Column.__and__, same(lone.columns)), "left_anti")


def resolve(refs: DataFrame, symbols: DataFrame, strict: bool = True) -> DataFrame:
    """The edges (source_id, target_id, kind, resolved) of links()."""
    return resolve_named(names(refs, strict), symbols)


def resolve_named(found: DataFrame, symbols: DataFrame, *by: str) -> DataFrame:
    """As resolve(), for what names() made of references; the columns `by` of these stay, edges are told apart by them.

    An edge depends on its name alone: references and symbols of some names give these names' edges.
    """
    return links(found, symbols, *by).edges()


def stored(of: Links) -> Links:
    return Links(*(cut(df, "links") for df in (of.callers, of.targets, of.single)))


def by_name(refs: DataFrame, symbols: DataFrame, strict: bool = True) -> DataFrame:
    """Edges with the name (leaf) they were resolved by, for maintained()."""
    return resolve_named(names(refs, strict), symbols, "leaf")


def maintained(edges: DataFrame, refs: DataFrame, symbols: DataFrame, touched: DataFrame, strict: bool = True) -> DataFrame:
    """Edges by name of the state before, references and symbols of the state after → edges by name after.

    touched (leaf): the names that came, went or are referred to otherwise. Only their references and symbols meet
    again; the edges of all other names stay.
    """
    touched = touched.select("leaf").distinct()
    kept = edges.join(touched, "leaf", "left_anti")
    found = names(refs, strict).join(touched, "leaf", "left_semi")
    mine = symbols.join(touched.withColumnRenamed("leaf", "name"), "name", "left_semi")
    return kept.unionByName(resolve_named(found, mine, "leaf").select(*kept.columns))


def touched(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], strict: bool = True) -> DataFrame:
    """(leaf) of the names that (references, symbols) of changed files have, before and after."""
    leaves = [names(refs, strict).select("leaf") for refs, _ in (before, after)] + [s.select(F.col("name").alias("leaf")) for _, s in (before, after)]
    return reduce(DataFrame.unionByName, leaves).distinct()


def relinked(before: Links, found: DataFrame, symbols: DataFrame, touched: DataFrame) -> Links:
    """As maintained(), for links by leaf: the tables before, names() and symbols after → the tables after."""
    touched = touched.select("leaf").distinct()
    mine = symbols.join(touched.withColumnRenamed("leaf", "name"), "name", "left_semi")
    new = links(found.join(touched, "leaf", "left_semi"), mine, "leaf")
    both = lambda old, df: old.join(touched, "leaf", "left_anti").select(*df.columns).unionByName(df)
    return Links(both(before.callers, new.callers), both(before.targets, new.targets), both(before.single, new.single))


def counts(of: Links) -> DataFrame:
    """(edges, resolved): the numbers of edges, from those of callers and symbols of each name."""
    size = lambda df, n: df.groupBy("leaf").agg(F.count("*").alias(n))
    named = size(of.callers, "c").join(size(of.targets, "t"), "leaf").select((F.col("c") * F.col("t")).alias("n"), F.lit(True).alias("resolved"))
    rows = named.unionByName(of.single.select(F.lit(1).cast("long").alias("n"), "resolved"))
    none = F.lit(0).cast("long")
    return rows.agg(F.coalesce(F.sum("n"), none).alias("edges"), F.coalesce(F.sum(F.when(F.col("resolved"), F.col("n"))), none).alias("resolved"))


def resolution_ratio(of: Links) -> DataFrame:
    """(edges, resolved, ratio), the ratio null without edges."""
    ratio = F.when(F.col("edges") > 0, F.col("resolved") / F.col("edges"))
    return counts(of).select("edges", "resolved", F.round(ratio, 6).alias("ratio"))


def callers(of: Links, kind: str = "calls") -> DataFrame:
    """(target_id, n_callers, first_caller) of edges of a kind, resolved or not: callers are counted name by name."""
    count = (F.count("*").alias("n_callers"), F.min("source_id").alias("first_caller"))
    mine = lambda df: df.where(F.col("kind") == kind)
    named = mine(of.callers).groupBy("leaf").agg(*count).join(of.targets, "leaf").select("target_id", "n_callers", "first_caller")
    rows = named.unionByName(mine(of.single).groupBy("target_id").agg(*count))
    return rows.groupBy("target_id").agg(F.sum("n_callers").alias("n_callers"), F.min("first_caller").alias("first_caller"))
