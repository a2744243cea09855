"""The jobs as queries on the given tables: each runs twice into a new folder and returns its whole output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators.tables import shared_folder
from codeweave.plans import fixtures as X
from jobs import architecture_report, refresh_index


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, id, other, kind, n) of the index of pages: files, symbols, references and edges."""
    out = shared_folder(spark, "job1")
    for _ in range(2):
        refresh_index.run(spark, f"{sf_dir.rstrip('/')}/pages.parquet", out)
    none = F.lit(None).cast("string")
    rows = {
        "files": (F.col("path"), F.col("content_hash"), none, F.col("line_count")),
        "symbols": (F.col("id"), F.col("file_path"), F.col("kind"), F.col("start_line")),
        "refs": (F.col("source_id"), F.col("ref_text"), F.col("kind"), F.lit(0)),
        "edges": (F.col("source_id"), F.col("target_id"), F.col("kind"), F.col("resolved").cast("int")),
    }
    parts = [refresh_index.current(spark, out, t).select(F.lit(t).alias("part"), a.alias("id"), b.alias("other"), c.alias("kind"), n.cast("long").alias("n")) for t, (a, b, c, n) in rows.items()]
    return reduce(DataFrame.unionByName, parts)


JOB1_SQL = f"""WITH {X.EDGES}
SELECT 'files' AS part, {X.PAGE_PATH} AS id, sha256(coalesce(html, '')) AS other, NULL::VARCHAR AS kind,
  (length(coalesce(html, '')) - length(replace(coalesce(html, ''), chr(10), '')) + 1)::BIGINT AS n FROM pages
UNION ALL SELECT 'symbols', id, file_path, kind, start_line::BIGINT FROM symbols
UNION ALL SELECT 'refs', source_id, ref_text, kind, 0 FROM refs
UNION ALL SELECT 'edges', source_id, target_id, kind, resolved::BIGINT FROM edges"""


def job2_architecture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, rank, name, n) of the report on documents and pages."""
    out, d = shared_folder(spark, "job2"), sf_dir.rstrip("/")
    for _ in range(2):
        architecture_report.run(spark, f"{d}/documents.parquet", f"{d}/pages.parquet", out)
    return spark.read.schema(architecture_report.REPORT).orc(out)


JOB2_SQL = f"""WITH {X.FILES}, {X.EDGES}, e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE resolved),
ends AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e), g AS (SELECT id, count(*) AS n FROM ends GROUP BY id),
gods AS (SELECT id AS name, n FROM g WHERE n >= 20 ORDER BY n DESC, id LIMIT 10),
hubs AS (SELECT file_path AS name, count(*) AS n FROM ends JOIN symbols USING (id) GROUP BY file_path ORDER BY n DESC, file_path LIMIT 10),
parts AS (SELECT string_split(path, '/') AS p FROM files),
directories AS (SELECT array_to_string(p[1:i], '/') AS name FROM (SELECT p, unnest(range(1, len(p))) AS i FROM parts))
SELECT 0::BIGINT AS rank, language AS name, count(*)::BIGINT AS n, 'languages' AS section FROM files GROUP BY language
UNION ALL SELECT 0, name, count(*), 'directories' FROM directories GROUP BY name
UNION ALL SELECT 0, min(path), count(*), 'copies' FROM files GROUP BY content_hash HAVING count(*) > 1
UNION ALL SELECT row_number() OVER (ORDER BY n DESC, name), name, n, 'gods' FROM gods
UNION ALL SELECT row_number() OVER (ORDER BY n DESC, name), name, n, 'hubs' FROM hubs
UNION ALL SELECT 0, file_path, count(*), 'orphans' FROM symbols WHERE id NOT IN (SELECT id FROM g) GROUP BY file_path"""

QUERIES = {"job1_refresh_index": job1_refresh_index, "job2_architecture_report": job2_architecture_report}
SQL = {"job1_refresh_index": JOB1_SQL, "job2_architecture_report": JOB2_SQL}
