"""A report on the structure of an indexed tree: languages, directories, copies, gods, hubs, orphans and cycles.

    python -m jobs.architecture_report --documents PATH --pages PATH --out PATH [--config FILE]

Documents are the tree's files; pages give symbols, references and, resolved, the graph. The report is one table
(section, rank, name, n), partitioned by section and written anew by each run, so a run again gives the same report.

`rank` counts from 1 where a section has a top, and is 0 where it is whole.

- `languages`: files by language, `directories`: files in a directory and below it, all of them, most first;
- `copies`: contents that several files have, by the number of files, with the first one's path;
- `gods`: symbols of `god_degree` edges or more, `hubs`: files with most ends of edges, `top` each;
- `orphans`: symbols without edges (their number by file), `cycles`: strongly connected symbols (by their smallest id).

Ties go by name. Null texts are empty files; empty tables give an empty report.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.functions.text import ancestors
from codeweave.operators import graph, resolve
from codeweave.operators.resolve import Links
from codeweave.operators.tables import cut
from codeweave.plans import fixtures

LOG = logging.getLogger("architecture_report")
CONFIG = Path(__file__).with_suffix(".json")
REPORT = "rank long, name string, n long, section string"


def _ranked(rows: DataFrame, section: str, top: int | None = None) -> DataFrame:
    """rows (name, n), most first. Only the few of a section with a top are numbered."""
    if top:
        rows = rows.orderBy(F.desc("n"), "name").limit(top)
        rank: Column = F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("long")
    else:
        rank = F.lit(0).cast("long")
    return rows.select(rank.alias("rank"), "name", F.col("n").cast("long").alias("n"), F.lit(section).alias("section"))


def sections(files: DataFrame, symbols: DataFrame, links: Links, config: dict) -> list[DataFrame]:
    """files (path, language, content_hash), symbols and links of an index → the report's sections."""
    top = config["top"]
    degree = cut(graph.link_degrees(links, symbols), "report")
    count = F.count("*").alias("n")
    directories = files.select(F.explode(ancestors(F.col("path"))).alias("name")).groupBy("name").agg(count)
    copies = files.groupBy("content_hash").agg(F.min("path").alias("name"), count).where("n > 1")
    gods = graph.god_objects(degree, config["god_degree"], top).select(F.col("id").alias("name"), F.col("degree").alias("n"))
    hubs = graph.degree_hubs(degree, symbols, top).select(F.col("file_path").alias("name"), F.col("edge_count").alias("n"))
    lone = graph.orphans(degree, None).join(symbols.select("id", "file_path"), "id").groupBy(F.col("file_path").alias("name")).agg(count)
    cycles = graph.link_components(links).groupBy(F.col("component").alias("name")).agg(count)
    return [
        _ranked(files.groupBy(F.col("language").alias("name")).agg(count), "languages"),
        _ranked(directories, "directories"),
        _ranked(copies.select("name", "n"), "copies"),
        _ranked(gods, "gods", top),
        _ranked(hubs, "hubs", top),
        _ranked(lone, "orphans"),
        _ranked(cycles, "cycles"),
    ]


def run(spark: SparkSession, documents: str, pages: str, out: str, config: dict | None = None) -> None:
    """Writes the report on the files at documents and the pages at pages to out."""
    config = json.loads(CONFIG.read_text()) | (config or {})
    docs, found = spark.read.parquet(documents), spark.read.parquet(pages)
    LOG.info("reading %s (%d rows) and %s (%d rows)", documents, docs.count(), pages, found.count())
    symbols = cut(fixtures.symbols_of(found), "report")
    links = resolve.stored(resolve.links(cut(resolve.names(fixtures.refs_of(found)), "report"), symbols))
    report = cut(reduce(DataFrame.unionByName, sections(fixtures.files_of(docs), symbols, links, config)), "report")
    report.write.mode("overwrite").partitionBy("section").orc(out)
    for r in report.groupBy("section").count().orderBy("section").collect():
        LOG.info("wrote %d rows of %s to %s", r["count"], r.section, out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="architecture_report", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "pages", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", type=Path, default=CONFIG)
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("architecture_report").getOrCreate()
    try:
        run(spark, args.documents, args.pages, args.out, json.loads(args.config.read_text()))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
