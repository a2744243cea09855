"""Index tables and graphs that stand in for a source tree, made of the test tables; with the same in SQL.

A page is a file, the words of its title are its symbols, its links are references from its module. Nations and the
two nations each buys most from are a call graph with cycles; suppliers and their parts are a large one without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.functions.text import line_count
from codeweave.operators import resolve
from codeweave.operators.tables import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(table(spark, sf_dir, "documents"))


def files_of(documents: DataFrame) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    text = F.coalesce("text", F.lit(""))
    return documents.select(path.alias("path"), F.col("lang").alias("language"), F.sha2(text, 256).alias("content_hash"), line_count(text).alias("line_count"))


FILES = """files AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path, lang AS language, sha256(coalesce(text, '')) AS content_hash,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::INTEGER AS line_count FROM documents)"""


def page_path(page: Column) -> Column:
    return F.concat(F.lit("p"), (page % 10).cast("string"), F.lit("/d"), (page % 3).cast("string"), F.lit("/page"), page.cast("string"), F.lit(".html"))


PAGE_PATH = "'p' || (page_id % 10) || '/d' || (page_id % 3) || '/page' || page_id || '.html'"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files_of(table(spark, sf_dir, "pages"))


def page_files_of(pages: DataFrame) -> DataFrame:
    return pages.select(page_path(F.col("page_id")).alias("path"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols_of(table(spark, sf_dir, "pages"))


def symbols_of(pages: DataFrame) -> DataFrame:
    p = pages.select(page_path(F.col("page_id")).alias("file_path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    words = p.select("file_path", F.posexplode(F.regexp_extract_all("title", F.lit("([A-Za-z]+)"), 1)).alias("at", "word"))
    words = words.groupBy("file_path", F.lower("word").alias("name")).agg((F.min("at") + 1).cast("int").alias("start_line"))
    kind = F.element_at(F.array(F.lit("class"), F.lit("function"), F.lit("method")), (F.length("name") % 3 + 1).cast("int"))
    return words.select(
        F.concat("file_path", F.lit("::"), "name").alias("id"), "file_path", "name", F.col("name").alias("qualified_name"), kind.alias("kind"),
        "start_line", (F.col("start_line") + F.length("name")).cast("int").alias("end_line"), F.concat(F.lit("def "), "name", F.lit("()")).alias("signature"),
    )


SYMBOLS = f"""words AS (SELECT {PAGE_PATH} AS file_path, unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '([A-Za-z]+)', 1)) AS word,
    generate_subscripts(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '([A-Za-z]+)', 1), 1) AS pos FROM pages),
symbols AS (SELECT file_path || '::' || name AS id, file_path, name, name AS qualified_name, ['class', 'function', 'method'][length(name) % 3 + 1] AS kind,
    start_line, (start_line + length(name))::INTEGER AS end_line, 'def ' || name || '()' AS signature
  FROM (SELECT file_path, lower(word) AS name, min(pos)::INTEGER AS start_line FROM words GROUP BY ALL))"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs_of(table(spark, sf_dir, "pages"))


def refs_of(pages: DataFrame) -> DataFrame:
    p = pages.select(page_path(F.col("page_id")).alias("file_path"), F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), 1)).alias("word"))
    kind = F.when(F.length("word") % 4 == 0, "inherits").otherwise("calls")
    return p.select(F.concat("file_path", F.lit("::__module__")).alias("source_id"), F.lower("word").alias("ref_text"), kind.alias("kind"), "file_path", F.lit("python").alias("language"))


REFS = f"""refs AS (SELECT file_path || '::__module__' AS source_id, lower(word) AS ref_text, CASE WHEN length(word) % 4 = 0 THEN 'inherits' ELSE 'calls' END AS kind
  FROM (SELECT {PAGE_PATH} AS file_path, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS word FROM pages))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).edges()


def links(spark: SparkSession, sf_dir: str) -> resolve.Links:
    """The edges by name, before they are spelled out; the pages are read once for each side."""
    return resolve.stored(resolve.links(cut(resolve.names(refs(spark, sf_dir))), cut(symbols(spark, sf_dir).select("id", "name"))))


EDGES = f"""{SYMBOLS}, {REFS},
edges AS (SELECT DISTINCT source_id, coalesce(id, ref_text) AS target_id, r.kind, id IS NOT NULL AS resolved FROM refs r LEFT JOIN symbols s ON s.name = r.ref_text)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name")
    buyer = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("src"))
    seller = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy("src", "dst").agg(F.sum("l_quantity").alias("q"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("q"), "dst"))
    return sums.withColumn("rank", rank).where("rank <= 2").select("src", "dst")


TRADE = """e AS MATERIALIZED (SELECT src, dst FROM (SELECT c.n_name AS src, s.n_name AS dst, row_number() OVER (PARTITION BY c.n_name ORDER BY sum(l_quantity) DESC, s.n_name) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2) WHERE k <= 2),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


SUPPLIES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the parts that come next to them in an order: a graph with large cycles."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("a <> b")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    return rows.distinct().select(name("a").alias("src"), name("b").alias("dst"), "a", "b")


FOLLOWS = """e AS MATERIALIZED (SELECT DISTINCT 'p' || a AS src, 'p' || b AS dst, a, b FROM (SELECT l_partkey AS a,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE a <> b),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of every third page and its staleness."""
    p = table(spark, sf_dir, "pages").where("page_id % 3 = 0")
    return p.select(
        page_path(F.col("page_id")).alias("target_id"), F.lit("file").alias("target_kind"), F.concat(F.lit("about "), "url").alias("summary_text"),
        F.lit("none").alias("model"), (F.col("page_id") % 4 == 0).alias("is_stale"),
    )


SUMMARIES = f"summaries AS (SELECT {PAGE_PATH} AS target_id, 'file' AS target_kind, 'about ' || url AS summary_text, 'none' AS model, page_id % 4 = 0 AS is_stale FROM pages WHERE page_id % 3 = 0)"
