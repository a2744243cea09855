"""The catalogue: each query as a DataFrame on the test tables, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.functions import imports, text
from codeweave.operators import details, graph, renames, resolve, rollup, search as lookup, store, summaries
from codeweave.plans import fixtures as X
from codeweave.sources import files as sources
from codeweave.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}
NAME = "the"
PAGE = "p0/d0/page0.html"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- counts and records


@query(f"WITH {X.FILES}, {X.EDGES} SELECT 'files' AS name, count(*)::BIGINT AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'resolved', count(*) FROM edges WHERE resolved UNION ALL SELECT 'summaries', count(*) FROM pages WHERE page_id % 3 = 0")
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = {"files": X.files(spark, d), "symbols": X.symbols(spark, d), "summaries": X.summaries(spark, d)}
    n = resolve.counts(X.links(spark, d))
    out = n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in n.columns])))
    for name, df in parts.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


@query(f"WITH {X.FILES} SELECT language, count(*)::BIGINT AS n FROM files GROUP BY language")
def files_by_language(spark, d):
    return X.files(spark, d).groupBy("language").agg(F.count("*").alias("n"))


@query(f"WITH {X.SYMBOLS} SELECT kind, count(*)::BIGINT AS n FROM symbols GROUP BY kind")
def symbols_by_kind(spark, d):
    return X.symbols(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {X.FILES} SELECT path, language, content_hash, line_count FROM files")
def file_records(spark, d):
    return X.files(spark, d)


PATHS = "regexp_replace(url, '^https?://', '') || ['.py', '.JAVA', '.ts', '.tsx', '.md'][page_id % 5 + 1]"


@query(f"""SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.ts' THEN 'typescript' ELSE 'tsx' END AS language
FROM (SELECT {PATHS} AS path FROM pages)
WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.py', '.java', '.ts', '.tsx') AND NOT list_contains(string_split(path, '/'), 'fr')
  AND NOT (path LIKE 'm.%' AND NOT regexp_matches(path, '^[^/]*\\.net/'))""")
def discover_filter(spark, d):
    """Extensions, an excluded directory and an ignore file with a negated pattern."""
    p = X.table(spark, d, "pages")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".JAVA", ".ts", ".tsx", ".md"))), (F.col("page_id") % 5 + 1).cast("int"))
    paths = p.select(F.concat(F.regexp_replace("url", "^https?://", ""), ext).alias("path"))
    return sources.selected(paths, excluded=("fr",), ignore=["m.*", "!*.net"])


@query(f"WITH {X.SYMBOLS} SELECT id, file_path, kind, start_line, end_line, signature FROM symbols WHERE name = '{NAME}'")
def symbol_lookup(spark, d):
    return X.symbols(spark, d).where(F.col("name") == NAME).select("id", "file_path", "kind", "start_line", "end_line", "signature")


@query(f"WITH {X.SYMBOLS} SELECT id, name, kind, start_line FROM symbols WHERE file_path = '{PAGE}'")
def symbols_in_file(spark, d):
    return X.symbols(spark, d).where(F.col("file_path") == PAGE).orderBy("start_line", "id").select("id", "name", "kind", "start_line")


@query(f"WITH {X.SYMBOLS} SELECT id, name FROM symbols WHERE name ILIKE '%TION%' OR qualified_name ILIKE '%TION%' ORDER BY name, id LIMIT 20")
def symbol_search(spark, d):
    """The search box's 20 results."""
    return search(X.symbols(spark, d), "TION").select("id", "name")


def search(symbols: DataFrame, q: str, limit: int = 20) -> DataFrame:
    if not q:
        raise ValueError("an empty search")
    like = f"%{q}%"
    return symbols.where(F.col("name").ilike(like) | F.col("qualified_name").ilike(like)).orderBy("name", "id").limit(limit)


TERMS = "terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{2,5}')) AS term FROM benchmark)"


@query(f"WITH {X.SYMBOLS}, {TERMS} SELECT term, id FROM terms JOIN symbols ON name ILIKE '%' || term || '%' OR qualified_name ILIKE '%' || term || '%'")
def search_many(spark, d):
    """Every run of letters in the benchmark, five at a time, looked up in one search."""
    s = graph.cut(X.symbols(spark, d))
    terms = X.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,5})"), 1)).alias("term"))
    return lookup.search_many(s, graph.cut(lookup.postings(s)), terms)


# --- extraction and resolution


@query(f"WITH {X.SYMBOLS} SELECT * FROM symbols")
def extract_symbols(spark, d):
    return X.symbols(spark, d)


@query(f"WITH {X.REFS} SELECT source_id, ref_text, kind, count(*)::BIGINT AS n FROM refs GROUP BY ALL")
def extract_refs(spark, d):
    return X.refs(spark, d).groupBy("source_id", "ref_text", "kind").agg(F.count("*").alias("n"))


#: Import statements made of the first four words of every document, of four forms by its id.
FORMS = {
    "python": ["from {0}.{1} import {2}, {3} as e", "from ..{0} import ({1},\n  {2})", "from {0} import *", "import {0}.{1} as c, {2}"],
    "java": ["import {0}.{1}.{2};", "import static {0}.{1}.{2};", "import {0}.{1}.*;", "import {3};"],
    "typescript": ["{0}|./{1}", " {0} |{1}", "|{0}", "{3}"],
}
#: The names that the forms bring in.
BROUGHT = {
    "python": ["{2},{0}.{1}.{2},{3},{0}.{1}.{3}", "{1},{0}.{1},{2},{0}.{2}", "{0}", "{0}.{1},{2}"],
    "java": ["{2},{0}.{1}.{2}", "{2},{0}.{1}.{2}", "", "{3},{3}"],
    "typescript": ["{0}", "{0}", "", "{3}"],
}


def _imports(spark: SparkSession, d: str, language: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([a-z]{2,})"), 1)
    word = [F.coalesce(F.get(words, F.lit(k)), F.lit("x")) for k in range(4)]
    made = [F.concat(*[word[int(x)] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\d)\}", form))]) for form in FORMS[language]]
    rows = X.table(spark, d, "documents").select("doc_id", F.get(F.array(*made), (F.col("doc_id") % 4).cast("int")).alias("statement"))
    return rows.select("doc_id", F.array_join(imports.candidates(F.col("statement"), F.lit(language)), ",").alias("names"))


def _brought(language: str) -> str:
    made = ["concat(" + ", ".join(f"w[{int(x) + 1}]" if k % 2 else f"'{x}'" for k, x in enumerate(re.split(r"\{(\d)\}", form))) + ")" for form in BROUGHT[language]]
    words = ", ".join(f"coalesce(regexp_extract_all(text, '[a-z]{{2,}}')[{k}], 'x')" for k in range(1, 5))
    return f"SELECT doc_id, [{', '.join(made)}][doc_id % 4 + 1] AS names FROM (SELECT doc_id, [{words}] AS w FROM documents)"


@query(_brought("python"))
def parse_python_import(spark, d):
    return _imports(spark, d, "python")


@query(_brought("java"))
def parse_java_import(spark, d):
    return _imports(spark, d, "java")


@query(_brought("typescript"))
def parse_typescript_import(spark, d):
    return _imports(spark, d, "typescript")


@query(f"WITH {X.EDGES} SELECT * FROM edges")
def resolve_edges(spark, d):
    return X.edges(spark, d)


@query("WITH " + X.EDGES.replace("FROM pages", "FROM (SELECT * FROM pages WHERE page_id % 7 <> 0)") + " SELECT * FROM edges")
def resolve_delta(spark, d):
    """The edges after every seventh page is deleted, from those before: only names of the deleted pages resolve again."""
    pages = X.table(spark, d, "pages")
    gone, left = pages.where("page_id % 7 = 0"), pages.where("page_id % 7 <> 0")
    before = resolve.stored(resolve.links(graph.cut(resolve.names(X.refs_of(pages))), graph.cut(X.symbols_of(pages).select("id", "name")), "leaf"))
    before = store.delete_links(before, X.page_files_of(gone))
    touched = resolve.touched((X.refs_of(gone), X.symbols_of(gone)), (X.refs_of(gone.limit(0)), X.symbols_of(gone.limit(0))))
    after = resolve.relinked(before, graph.cut(resolve.names(X.refs_of(left))), graph.cut(X.symbols_of(left).select("id", "name")), graph.cut(touched))
    return resolve.stored(after).edges().select("source_id", "target_id", "kind", "resolved")


@query(f"WITH {X.EDGES} SELECT count(*)::BIGINT AS edges, sum(resolved::INTEGER)::BIGINT AS resolved, round(avg(resolved::INTEGER), 6) AS ratio FROM edges")
def resolution_ratio(spark, d):
    return resolve.resolution_ratio(X.links(spark, d))


# --- graph


@query(f"WITH {X.EDGES} SELECT target_id, count(*)::BIGINT AS n_callers, min(source_id) AS first_caller FROM edges WHERE kind = 'calls' GROUP BY target_id")
def callers(spark, d):
    """By target, resolved or not."""
    return resolve.callers(X.links(spark, d))


@query(f"WITH {X.EDGES} SELECT source_id, target_id FROM edges WHERE kind = 'calls' AND resolved")
def callees(spark, d):
    e = X.links(spark, d)
    calls = resolve.Links(e.callers.where("kind = 'calls'"), e.targets, e.single.where("kind = 'calls' and resolved"))
    return calls.edges().select("source_id", "target_id")


@query(f"""WITH {X.TRADE}, n AS (SELECT src AS id FROM e WHERE dst = (SELECT min(id) FROM v) UNION SELECT dst FROM e WHERE src = (SELECT min(id) FROM v) UNION SELECT min(id) FROM v)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def neighborhood(spark, d):
    """The edges among a nation and its neighbours in either direction."""
    e = graph.cut(X.trade(spark, d))
    return graph.neighbourhood(e, graph.vertices(e).agg(F.min("id")).first()[0])[1]


@query(f"""WITH {X.EDGES}, e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE resolved), v AS (SELECT id FROM symbols UNION SELECT src FROM e UNION SELECT dst FROM e)
SELECT id, (SELECT count(*) FROM e WHERE dst = id)::INTEGER AS in_degree, (SELECT count(*) FROM e WHERE src = id)::INTEGER AS out_degree FROM v""")
def degrees(spark, d):
    return graph.link_degrees(X.links(spark, d), X.symbols(spark, d))


GOD = "WITH " + X.SUPPLIES + ", g AS (SELECT id, count(*)::INTEGER AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT id, degree FROM g WHERE degree >= 20 ORDER BY degree DESC, id LIMIT 10"


@query(GOD)
def god_objects(spark, d):
    """The report's ten vertices of degree 20 or more."""
    e = X.supplies(spark, d)
    return graph.god_objects(graph.degrees(e, graph.vertices(e)))


@query(f"WITH {X.EDGES} SELECT id FROM symbols WHERE id NOT IN (SELECT target_id FROM edges WHERE resolved UNION SELECT source_id FROM edges WHERE resolved) ORDER BY id LIMIT 10")
def orphans(spark, d):
    """The report's ten symbols without edges."""
    return graph.orphans(graph.link_degrees(X.links(spark, d), X.symbols(spark, d)))


@query(f"""WITH {X.EDGES}, e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE resolved), ends AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)
SELECT file_path, count(*)::BIGINT AS edge_count FROM ends JOIN symbols USING (id) GROUP BY file_path ORDER BY edge_count DESC, file_path LIMIT 10""")
def hub_files(spark, d):
    """The report's ten files with the most edges."""
    return graph.degree_hubs(graph.link_degrees(X.links(spark, d)), X.symbols(spark, d))


def _rank_sql(graph: str) -> str:
    return f"""WITH RECURSIVE {graph}, n AS (SELECT count(*) AS n FROM v), d AS (SELECT dst, count(*) AS c FROM e GROUP BY dst),
r(step, id, pr) AS (SELECT 0, id, 1.0::DOUBLE / n.n FROM v, n UNION ALL
  SELECT s.step + 1, v.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(sum(r.pr / d.c), 0) FROM (SELECT max(step) AS step FROM r) s CROSS JOIN n CROSS JOIN v
  LEFT JOIN e ON e.src = v.id LEFT JOIN d ON d.dst = e.dst LEFT JOIN r ON r.id = e.dst WHERE s.step < 100 GROUP BY s.step, v.id, n.n),
ranks AS (SELECT id, pr FROM r WHERE step = 100)"""


RANK = _rank_sql(X.TRADE)


def _ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    e = graph.cut(X.trade(spark, d))
    return e, graph.pagerank(e, graph.vertices(e))


@query(RANK + " SELECT id, round(pr, 6) AS pagerank FROM ranks")
def pagerank(spark, d):
    return _ranked(spark, d)[1].select("id", F.round("pagerank", 6).alias("pagerank"))


@query(_rank_sql(X.SUPPLIES) + " SELECT id, round(pr, 9) AS pagerank FROM ranks")
def pagerank_large(spark, d):
    """Suppliers and parts."""
    e = X.supplies(spark, d)
    return graph.pagerank(e, graph.vertices(e)).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(f"""WITH RECURSIVE {X.FOLLOWS}, n AS (SELECT count(*) AS n FROM v), d AS (SELECT dst, count(*) AS c FROM e GROUP BY dst),
r(step, id, pr) AS (SELECT 0, id, 1.0::DOUBLE / n.n FROM v, n UNION ALL
  SELECT s.step + 1, v.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (coalesce(sum(r.pr / d.c), 0) + s.loose / n.n)
  FROM (SELECT max(step) AS step, coalesce(sum(pr) FILTER (id NOT IN (SELECT dst FROM d)), 0) AS loose FROM r) s CROSS JOIN n CROSS JOIN v
  LEFT JOIN e ON e.src = v.id LEFT JOIN d ON d.dst = e.dst LEFT JOIN r ON r.id = e.dst WHERE s.step < 30 GROUP BY s.step, s.loose, v.id, n.n),
ended AS (SELECT min(step) AS step FROM (SELECT b.step FROM r a JOIN r b ON a.id = b.id AND b.step = a.step + 1, n GROUP BY b.step, n.n HAVING sum(abs(a.pr - b.pr)) < 1e-6 * n.n))
SELECT id, round(pr, 7) AS pagerank FROM r JOIN ended USING (step)""")
def pagerank_standard(spark, d):
    """Parts by what follows them in orders, until ranks stay."""
    e = X.follows(spark, d).select("src", "dst")
    return graph.pagerank(e, graph.vertices(e), mode="standard").select("id", F.round("pagerank", 7).alias("pagerank"))


@query(RANK + ", g AS (SELECT id, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT row_number() OVER (ORDER BY round(pr, 6) DESC, id)::INTEGER AS rank, id, round(pr, 6) AS pagerank, degree FROM ranks JOIN g USING (id) ORDER BY rank LIMIT 20")
def hotspots_topk(spark, d):
    """The report's twenty best ranked, with their degree."""
    e, r = _ranked(spark, d)
    top = r.select("id", F.round("pagerank", 6).alias("pagerank")).orderBy(F.desc("pagerank"), "id").limit(20)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pagerank"), "id")))
    g = graph.degrees(e, graph.vertices(e)).select("id", (F.col("in_degree") + F.col("out_degree")).cast("long").alias("degree"))
    return top.join(g, "id").select("rank", "id", "pagerank", "degree")


REACH = "b(id, hops) AS (SELECT min(id), 0 FROM v UNION SELECT dst, hops + 1 FROM b JOIN e ON e.src = b.id WHERE hops < {k}), near AS (SELECT id, min(hops)::INTEGER AS hops FROM b GROUP BY id HAVING min(hops) > 0)"


@query(f"WITH RECURSIVE {X.TRADE}, {REACH.format(k=3)} SELECT id, hops FROM near")
def reachable_k(spark, d):
    e = graph.cut(X.trade(spark, d))
    return graph.reachable(e, graph.vertices(e).agg(F.min("id").alias("id")), 3)


@query(RANK + f", {REACH.format(k=5)} SELECT id, hops, round(pr, 6) AS pagerank FROM near JOIN ranks USING (id) ORDER BY pagerank DESC, id LIMIT 15")
def hot_paths(spark, d):
    """What five steps reach, the fifteen best ranked."""
    e, r = _ranked(spark, d)
    near = graph.reachable(e, graph.vertices(e).agg(F.min("id").alias("id")), 5)
    return near.join(r, "id", "left").select("id", "hops", F.round(F.coalesce("pagerank", F.lit(0.0)), 6).alias("pagerank")).orderBy(F.desc("pagerank"), "id").limit(15)


@query(f"""WITH RECURSIVE {X.TRADE}, p(node, path, len) AS (SELECT min(id), [min(id)], 0 FROM v UNION ALL SELECT e.dst, list_append(path, e.dst), len + 1 FROM p JOIN e ON e.src = p.node WHERE len < 12 AND NOT list_contains(path, e.dst)),
goal AS (SELECT max(hops) AS far FROM (SELECT node, min(len) AS hops FROM p GROUP BY node)), target AS (SELECT max(node) AS t FROM (SELECT node, min(len) AS hops FROM p GROUP BY node), goal WHERE hops = far)
SELECT array_to_string(path, ' > ') AS path FROM p, target, goal WHERE node = t AND len = far ORDER BY path LIMIT 5""")
def shortest_paths(spark, d):
    """From the first nation to the one furthest from it: five shortest paths."""
    e = graph.cut(X.trade(spark, d))
    start = graph.vertices(e).agg(F.min("id").alias("id"))
    far = graph.reachable(e, start, 12).orderBy(F.desc("hops"), F.desc("id")).first()
    return graph.shortest_paths(e, start.first()[0], far.id).select(F.array_join("path", " > ").alias("path"))


@query(f"""WITH RECURSIVE {X.TRADE}, w(k, s, v, c) AS (SELECT 0, id, id, 1.0::DOUBLE FROM v UNION ALL SELECT w.k + 1, w.s, e.dst, sum(w.c) FROM w JOIN e ON e.src = w.v WHERE w.k < 25 GROUP BY w.k, w.s, e.dst),
m AS (SELECT s, v, min(k) AS d FROM w GROUP BY s, v), q AS (SELECT m.s, m.v, m.d, w.c FROM m JOIN w ON w.s = m.s AND w.v = m.v AND w.k = m.d), n AS (SELECT count(*) AS n FROM v)
SELECT v.id, round(coalesce(sum(a.c * b.c / t.c), 0) / ((n.n - 1) * (n.n - 2)), 6) AS betweenness FROM v CROSS JOIN n
LEFT JOIN (q a JOIN q b ON a.v = b.s AND a.s <> a.v AND b.v <> a.v AND a.s <> b.v JOIN q t ON t.s = a.s AND t.v = b.v AND t.d = a.d + b.d) ON a.v = v.id GROUP BY v.id, n.n""")
def betweenness(spark, d):
    e = graph.cut(X.trade(spark, d))
    return graph.betweenness(e, graph.vertices(e)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query(f"""WITH RECURSIVE {X.FOLLOWS}, n AS (SELECT count(*) AS n FROM v), sources AS (SELECT id FROM v ORDER BY md5(id || '42'), id LIMIT 12),
w(k, s, v, c) AS (SELECT 0, id, id, 1.0::DOUBLE FROM sources UNION ALL SELECT w.k + 1, w.s, e.dst, sum(w.c) FROM w JOIN e ON e.src = w.v WHERE w.k < 14 GROUP BY w.k, w.s, e.dst),
q AS MATERIALIZED (SELECT s, v, min(k) AS k, arg_min(c, k) AS c FROM w GROUP BY s, v),
b(k, s, v, c, owed) AS (SELECT k, s, v, c, 0.0::DOUBLE FROM q WHERE k = (SELECT max(k) FROM q) UNION ALL
  SELECT q.k, q.s, q.v, q.c, coalesce(sum(q.c / b.c * (1 + b.owed)), 0) FROM (SELECT max(k) AS k FROM b) m JOIN q ON q.k = m.k - 1
  LEFT JOIN (e JOIN b ON b.v = e.dst) ON e.src = q.v AND b.s = q.s GROUP BY q.k, q.s, q.v, q.c)
SELECT v.id, round(coalesce(sum(b.owed), 0) * (n.n / 12.0::DOUBLE) / ((n.n - 1) * (n.n - 2)), 9) AS betweenness FROM v CROSS JOIN n LEFT JOIN b ON b.v = v.id AND b.k > 0 GROUP BY v.id, n.n""")
def betweenness_sample(spark, d):
    """Parts, from twelve seeded sources."""
    e = graph.cut(X.follows(spark, d).select("src", "dst"))
    return graph.betweenness(e, graph.vertices(e), exact=0, sample=12).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(f"""WITH RECURSIVE {X.FOLLOWS}, f AS (SELECT src, dst FROM e WHERE a // 100 = b // 100), c(a, b) AS (SELECT src, dst FROM f UNION SELECT c.a, f.dst FROM c JOIN f ON f.src = c.b),
m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT id, component FROM m""")
def scc_large(spark, d):
    """Parts that follow each other within a hundred of keys: chains, rings and large components."""
    near = X.follows(spark, d).where(F.floor(F.col("a") / 100) == F.floor(F.col("b") / 100))
    return graph.components(near.select("src", "dst"))


@query(f"""WITH RECURSIVE {X.TRADE}, p(s, node, path, len) AS (SELECT id, id, [id], 0 FROM v UNION ALL
  SELECT s, e.dst, list_append(path, e.dst), len + 1 FROM p JOIN e ON e.src = p.node WHERE len < 10 AND NOT list_contains(path, e.dst)),
m AS MATERIALIZED (SELECT s, node, len, path FROM (SELECT s, node, len, path, min(len) OVER (PARTITION BY s, node) AS least FROM p) WHERE len = least),
k AS (SELECT s, node, path, row_number() OVER (PARTITION BY s, node ORDER BY path)::INTEGER AS path_no FROM m
  JOIN nation a ON a.n_name = s JOIN nation b ON b.n_name = node AND b.n_regionkey = a.n_regionkey)
SELECT s AS source, node AS target, path_no, unnest(generate_series(1, len(path)))::INTEGER AS position, unnest(path) AS id FROM k WHERE path_no <= 5""")
def trace_pairs(spark, d):
    """Five shortest paths from every nation to every one of its region, all pairs in one search."""
    e = graph.cut(X.trade(spark, d))
    a, b = (X.table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias(c)) for c in "ab")
    pairs = a.join(b, "n_regionkey").select(F.struct("a", "b").alias("pair"), "a", "b")
    return graph.steps(graph.traces(e, pairs)).select(F.col("pair.a").alias("source"), F.col("pair.b").alias("target"), "path_no", "position", "id")


@query(f"""WITH RECURSIVE {X.TRADE}, c(a, b) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b),
m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT id, component FROM m""")
def scc_cycles(spark, d):
    return graph.components(X.trade(spark, d))


@query(f"WITH {X.EDGES}, n AS (SELECT count(*) AS n FROM symbols), m AS (SELECT count(*) AS m FROM edges) SELECT n::BIGINT AS symbols, m::BIGINT AS edges, round(CASE WHEN n > 1 THEN m / (n * (n - 1.0)) ELSE 0 END, 9)::DOUBLE AS density FROM n, m")
def overview_density(spark, d):
    """Unresolved edges count too."""
    n = X.symbols(spark, d).agg(F.count("*").alias("symbols"))
    m = resolve.counts(X.links(spark, d)).select("edges")
    density = F.when(F.col("symbols") > 1, F.col("edges") / (F.col("symbols") * (F.col("symbols") - 1.0))).otherwise(0.0)
    return n.crossJoin(m).select("symbols", "edges", F.round(density, 9).cast("double").alias("density"))  # a row each


@query("WITH " + X.EDGES + """, e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE resolved), i AS (SELECT dst AS id, count(*) AS i FROM e GROUP BY dst), o AS (SELECT src AS id, count(*) AS o FROM e GROUP BY src)
SELECT s.id, s.name, s.kind, s.file_path AS "filePath", coalesce(i, 0)::INTEGER AS "inDegree", coalesce(o, 0)::INTEGER AS "outDegree", coalesce(i, 0) + coalesce(o, 0) >= 20 AS god FROM symbols s LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def graph_nodes(spark, d):
    """Symbols with their metrics, 0 where there are none."""
    rows = X.symbols(spark, d).join(graph.link_degrees(X.links(spark, d)), "id", "left")
    i, o = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
    return rows.select("id", "name", "kind", F.col("file_path").alias("filePath"), i.alias("inDegree"), o.alias("outDegree"), (i + o >= 20).alias("god"))


@query(f"WITH {X.EDGES} SELECT source_id AS source, target_id AS target, kind FROM edges WHERE resolved")
def graph_edges(spark, d):
    e = X.links(spark, d)
    resolved = resolve.Links(e.callers, e.targets, e.single.where("resolved"))
    return resolved.edges().select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind")


@query(f"WITH {X.EDGES} SELECT source_id AS src, target_id AS dst, max(kind) AS kind FROM edges WHERE resolved GROUP BY ALL")
def simple_graph(spark, d):
    return graph.link_kinds(X.links(spark, d))


@query("WITH " + X.SUPPLIES + ", g AS (SELECT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id HAVING count(*) >= 20) SELECT src, dst, src IN (SELECT id FROM g) OR dst IN (SELECT id FROM g) AS highlighted FROM e")
def highlighted_edges(spark, d):
    """Edges at god objects."""
    e = X.supplies(spark, d)
    return graph.highlighted(e, graph.god_objects(graph.degrees(e, graph.vertices(e)), top=None))


@query(f"WITH {X.EDGES} SELECT e.source_id, e.target_id, coalesce(s.qualified_name, list_extract(string_split(e.target_id, '::'), -1)) AS target_name, coalesce(list_extract(string_split(e.source_id, '::'), -1)) AS source_name FROM edges e LEFT JOIN symbols s ON s.id = e.target_id")
def edge_names(spark, d):
    """Display names: of the symbol, or the id's last part."""
    e, s = X.links(spark, d), X.symbols(spark, d).select(F.col("id").alias("target_id"), "qualified_name")
    named = lambda df: df.join(s, "target_id", "left").withColumn("target_name", F.coalesce("qualified_name", text.leaf(F.col("target_id")))).drop("qualified_name")
    # Names of callers too are made before they meet: once each, not for every edge.
    called = lambda df: df.withColumn("source_name", text.leaf(F.col("source_id")))
    rows = resolve.stored(resolve.Links(called(e.callers), named(e.targets), called(named(e.single)))).edges()
    return rows.select("source_id", "target_id", "target_name", "source_name")


@query(f"""WITH RECURSIVE {X.TRADE}, {REACH.format(k=2)}, f AS (SELECT min(id) AS f FROM v) SELECT 'caller' AS relation, src AS id FROM e, f WHERE dst = f UNION SELECT 'callee', dst FROM e, f WHERE src = f
UNION SELECT 'nearby', id FROM near, f WHERE id NOT IN (SELECT src FROM e WHERE dst = f UNION SELECT dst FROM e WHERE src = f)""")
def find_related(spark, d):
    """Callers, callees, and what two steps reach besides."""
    e = graph.cut(X.trade(spark, d))
    first = graph.vertices(e).agg(F.min("id").alias("id"))
    name = first.first()[0]
    callers_, callees_ = e.where(F.col("dst") == name).select(F.col("src").alias("id")), e.where(F.col("src") == name).select(F.col("dst").alias("id"))
    nearby = graph.reachable(e, first, 2).select("id").join(callers_.union(callees_), "id", "left_anti")
    named = lambda df, n: df.distinct().select(F.lit(n).alias("relation"), "id")
    return named(callers_, "caller").unionByName(named(callees_, "callee")).unionByName(named(nearby, "nearby"))


@query("""WITH ev AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, dst, count(*)::BIGINT AS n FROM ev WHERE dst IS NOT NULL GROUP BY ALL""")
def transitions(spark, d):
    """Which event follows which."""
    e = X.table(spark, d, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


# --- trees and modules


@query(f"""WITH {X.SYMBOLS}, f AS (SELECT {X.PAGE_PATH} AS path FROM pages), c AS (SELECT file_path, count(*) AS n FROM symbols GROUP BY 1), r AS (SELECT path, coalesce(n, 0) AS n FROM f LEFT JOIN c ON c.file_path = f.path),
a AS (SELECT unnest([array_to_string(string_split(path, '/')[1:1], '/'), array_to_string(string_split(path, '/')[1:2], '/')]) AS path, n FROM r)
SELECT path, 'directory' AS kind, sum(n)::BIGINT AS symbol_count, count(*)::BIGINT AS file_count FROM a GROUP BY path UNION ALL SELECT path, 'file', n::BIGINT, 1 FROM r""")
def tree_rollup(spark, d):
    return rollup.tree(X.page_files(spark, d), X.symbols(spark, d))


@query(f"WITH {X.SYMBOLS} SELECT file_path AS path, kind, count(*)::BIGINT AS symbols FROM symbols WHERE starts_with(file_path, 'p1/') GROUP BY ALL")
def module_summary_dir(spark, d):
    return rollup.module_summary(X.page_files(spark, d), X.symbols(spark, d), "p1/")


@query(f"WITH {X.SYMBOLS} SELECT file_path AS path, kind, count(*)::BIGINT AS symbols FROM symbols WHERE file_path = '{PAGE}' GROUP BY ALL")
def module_summary_file(spark, d):
    return rollup.module_summary(X.page_files(spark, d), X.symbols(spark, d), PAGE)


@query(f"WITH {X.SYMBOLS} SELECT file_path, string_agg(kind || ':' || n, ',' ORDER BY kind) AS histogram FROM (SELECT file_path, kind, count(*) AS n FROM symbols GROUP BY ALL) GROUP BY file_path")
def kind_histogram(spark, d):
    per = X.symbols(spark, d).groupBy("file_path", "kind").agg(F.count("*").alias("n"))
    return per.groupBy("file_path").agg(F.array_join(F.sort_array(F.collect_list(F.concat("kind", F.lit(":"), F.col("n").cast("string")))), ",").alias("histogram"))


# --- changes to tables


_PREV = """docs AS (SELECT path, content_hash, line_count FROM files), old AS (SELECT * FROM docs WHERE hash_of(path) <> 0), new AS (SELECT path, 'new-' || content_hash AS content_hash, line_count + 1 AS line_count FROM docs WHERE hash_of(path) < 3)"""
PREV = f"WITH {X.FILES}, " + _PREV.replace("hash_of(path)", "(('0x' || substr(content_hash, 1, 4))::INTEGER % 10)")


def _split(spark, d):
    """Old and new rows by the first 16 bits of the content's hash."""
    docs = X.files(spark, d).drop("language")
    one = F.conv(F.substring("content_hash", 1, 4), 16, 10).cast("int") % 10
    new = docs.where(one < 3).select("path", F.concat(F.lit("new-"), "content_hash").alias("content_hash"), (F.col("line_count") + 1).cast("int").alias("line_count"))
    return docs.where(one != 0), new


@query(PREV + " SELECT path, content_hash, line_count FROM new UNION ALL SELECT path, content_hash, line_count FROM old WHERE path NOT IN (SELECT path FROM new)")
def upsert_rows(spark, d):
    old, new = _split(spark, d)
    return store.upsert(old, new, ["path"])


@query(f"WITH {X.SYMBOLS} SELECT name, max(id) AS id FROM symbols GROUP BY name")
def upsert_last_wins(spark, d):
    """Of the rows with a key in a batch the last counts."""
    return store.last_wins(X.symbols(spark, d).select("name", "id"), ["name"], "id").select("name", "id")


@query(PREV + " SELECT path, content_hash, line_count FROM old UNION ALL SELECT path, content_hash, line_count FROM new WHERE path NOT IN (SELECT path FROM old)")
def insert_ignore(spark, d):
    old, new = _split(spark, d)
    return store.insert_ignore(old, new, ["path"])


@query(PREV + """ SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'same' ELSE 'changed' END AS change_type
FROM old o FULL JOIN new n ON o.path = n.path""")
def changeset(spark, d):
    old, new = _split(spark, d)
    return incremental.changes(old, new, keep_same=True)


MOVES = """s AS (SELECT doc_id % 2 AS state, doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS hash, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT state, path, hash, row_number() OVER (PARTITION BY state, hash ORDER BY path) AS nth, w FROM s),
same AS (SELECT a.path AS old_path, b.path AS new_path FROM x a JOIN x b ON a.hash = b.hash AND a.nth = b.nth AND a.state = 0 AND b.state = 1),
rest AS (SELECT * FROM x WHERE path NOT IN (SELECT old_path FROM same UNION ALL SELECT new_path FROM same) AND len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT state, path, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT state, path, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM rest)),
n AS (SELECT path, count(*) AS n FROM g GROUP BY path),
common AS (SELECT a.path AS old_path, b.path AS new_path, count(*) AS c FROM g a JOIN g b USING (shingle) WHERE a.state = 0 AND b.state = 1 GROUP BY ALL),
pairs AS MATERIALIZED (SELECT old_path, new_path, c / (a.n + b.n - c) AS similarity FROM common JOIN n a ON a.path = old_path JOIN n b ON b.path = new_path WHERE c / (a.n + b.n - c) >= 0.5),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY similarity DESC, old_path, new_path) AS k FROM pairs),
r(k, olds, news, taken) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], FALSE UNION ALL
  SELECT k.k, CASE WHEN list_contains(olds, old_path) OR list_contains(news, new_path) THEN olds ELSE list_append(olds, old_path) END,
    CASE WHEN list_contains(olds, old_path) OR list_contains(news, new_path) THEN news ELSE list_append(news, new_path) END,
    NOT (list_contains(olds, old_path) OR list_contains(news, new_path)) FROM r JOIN k ON k.k = r.k + 1)"""


@query(f"WITH RECURSIVE {MOVES} SELECT old_path, new_path, 1.0::DOUBLE AS similarity FROM same UNION ALL SELECT old_path, new_path, round(similarity, 9) FROM k JOIN r USING (k) WHERE taken")
def moved_files(spark, d):
    """Documents of even ids as a state, those of odd ids as the next: equal and similar ones were moved."""
    docs = X.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "text")
    moved = renames.renames(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))
    return moved.select("old_path", "new_path", F.round("similarity", 9).alias("similarity"))


GONE = "gone AS (SELECT " + X.PAGE_PATH + " AS path FROM pages WHERE page_id % 7 = 0)"


def _gone(spark, d):
    return X.table(spark, d, "pages").where("page_id % 7 = 0").select(X.page_path(F.col("page_id")).alias("path"))


@query(f"WITH {X.EDGES}, {GONE} SELECT source_id, target_id, kind, resolved AND string_split(target_id, '::')[1] NOT IN (SELECT path FROM gone) AS resolved FROM edges WHERE string_split(source_id, '::')[1] NOT IN (SELECT path FROM gone)")
def cascade_delete(spark, d):
    """Edges after the deletion of every seventh file."""
    return resolve.stored(store.delete_links(X.links(spark, d), _gone(spark, d))).edges()


@query(f"WITH {X.SYMBOLS}, {GONE} SELECT id FROM symbols WHERE file_path NOT IN (SELECT path FROM gone)")
def cascade_delete_symbols(spark, d):
    tables = {"files": X.page_files(spark, d), "symbols": X.symbols(spark, d)}
    return store.delete_files(tables, _gone(spark, d))["symbols"].select("id")


@query(f"WITH {X.SUMMARIES}, {GONE} SELECT target_id, is_stale OR target_id IN (SELECT path FROM gone) AS is_stale FROM summaries")
def mark_stale(spark, d):
    return store.mark_stale(X.summaries(spark, d), _gone(spark, d)).select("target_id", "is_stale")


# --- summaries


REPLY = """CASE page_id % 4 WHEN 0 THEN '{"file_summary": "page ' || page_id || '", "symbols": {"the": "an article"}}'
  WHEN 1 THEN '```json' || chr(10) || '{"file_summary": "fenced ' || page_id || '"}' || chr(10) || '```' WHEN 2 THEN 'no json ' || page_id ELSE '{"symbols": {"x.y": "deep"}}' END"""


def _replies(spark, d):
    k = F.col("page_id").cast("string")
    reply = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('{"file_summary": "page '), k, F.lit('", "symbols": {"the": "an article"}}')))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit('```json\n{"file_summary": "fenced '), k, F.lit('"}\n```')))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("no json "), k))
        .otherwise('{"symbols": {"x.y": "deep"}}')
    )
    return X.table(spark, d, "pages").select(X.page_path(F.col("page_id")).alias("file_path"), reply.alias("response"))


@query(f"SELECT {X.PAGE_PATH} AS file_path, CASE page_id % 4 WHEN 0 THEN 'page ' || page_id WHEN 1 THEN 'fenced ' || page_id WHEN 2 THEN 'no json ' || page_id END AS file_summary, CASE page_id % 4 WHEN 0 THEN 'the=an article' WHEN 3 THEN 'x.y=deep' ELSE '' END AS symbols FROM pages")
def summary_parse(spark, d):
    """Replies with JSON, fenced JSON, no JSON, and no file summary."""
    r = summaries.parsed(_replies(spark, d))
    pairs = F.transform(F.map_entries("symbols"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return r.select("file_path", "file_summary", F.coalesce(F.array_join(F.sort_array(pairs), ","), F.lit("")).alias("symbols"))


KEYED = "keyed AS (SELECT file_path, key FROM (SELECT DISTINCT file_path FROM symbols), (VALUES ('the'), ('tion'), ('x')) t(key))"


@query(f"""WITH {X.SYMBOLS}, q AS (SELECT id, file_path, name, 'C' || length(name) || '.' || name AS qualified_name, start_line FROM symbols), {KEYED}
SELECT k.file_path, key, min_by(id, (start_line, id)) AS id FROM keyed k JOIN q ON q.file_path = k.file_path AND (q.name = key OR ends_with(q.qualified_name, '.' || key)) GROUP BY ALL""")
def summary_fuzzy_match(spark, d):
    """Keys meet qualified names, else the first symbol whose name or last part they are."""
    s = X.symbols(spark, d).withColumn("qualified_name", F.concat(F.lit("C"), F.length("name").cast("string"), F.lit("."), "name"))
    keys = s.select("file_path").distinct().select("file_path", F.explode(F.array(*map(F.lit, ("the", "tion", "x")))).alias("key"))
    return summaries.matched(keys, s).select("file_path", "key", "id")


@query(f"WITH {X.SUMMARIES} SELECT directory, string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT regexp_extract(target_id, '^(.*)/[^/]*$', 1) AS directory, target_id || ': ' || summary_text AS line FROM summaries WHERE NOT is_stale) GROUP BY directory")
def dir_summary_rollup(spark, d):
    return rollup.directory_summaries(X.page_files(spark, d), X.summaries(spark, d))


@query(f"WITH {X.SUMMARIES} SELECT {X.PAGE_PATH} AS path FROM pages WHERE {X.PAGE_PATH} NOT IN (SELECT target_id FROM summaries WHERE NOT is_stale)")
def skip_fresh(spark, d):
    """Files that need a summary."""
    return summaries.to_do(X.page_files(spark, d), X.summaries(spark, d)).select("path")


@query(f"WITH {X.SUMMARIES} SELECT count(*)::BIGINT AS total, count(*) FILTER (NOT is_stale AND length(summary_text) > 0)::BIGINT AS fresh, count(*) FILTER (is_stale)::BIGINT AS stale FROM summaries")
def summary_coverage(spark, d):
    s = X.summaries(spark, d)
    return s.agg(F.count("*").alias("total"), F.count_if(text.fresh()).alias("fresh"), F.count_if("is_stale").alias("stale"))


@query("SELECT doc_id FROM documents WHERE length(text) <= 2000 UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def small_enough(spark, d):
    """Files short enough to be summarised (2000 characters here)."""
    return summaries.short_enough(X.table(spark, d, "documents"), 2000).select("doc_id")


# --- views of one file, display


@query(f"WITH {X.SYMBOLS}, m AS (SELECT *, row_number() OVER (PARTITION BY file_path, start_line % 3 ORDER BY start_line, id) AS k FROM symbols) SELECT file_path, (start_line % 3)::INTEGER AS line, id FROM m WHERE k = 1")
def code_markers(spark, d):
    """The first symbol on each line."""
    s = X.symbols(spark, d).withColumn("line", (F.col("start_line") % 3).cast("int"))
    w = Window.partitionBy("file_path", "line").orderBy("start_line", "id")
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").select("file_path", "line", "id")


@query("SELECT doc_id, pos::INTEGER AS line, line_text FROM (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line_text FROM documents) WHERE pos BETWEEN 2 AND 4")
def focus_lines(spark, d):
    """Lines 2 to 4 of every file."""
    rows = X.table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "line_text"))
    return rows.select("doc_id", (F.col("p") + 1).alias("line"), "line_text").where(F.col("line").between(2, 4))


@query(RANK + " SELECT id, round(greatest(3.0::DOUBLE, sqrt(round(pr, 6) * 5000)), 4) AS radius, round(pr, 6) > 0.005 OR (SELECT count(*) FROM v) < 80 AS labelled FROM ranks")
def node_style(spark, d):
    e, r = _ranked(spark, d)
    n = graph.vertices(e).count()
    pr = F.round("pagerank", 6)
    return r.select("id", F.round(text.radius(pr), 4).alias("radius"), ((pr > 0.005) | F.lit(n < 80)).alias("labelled"))


@query("SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, rpad(url, greatest(length(url), 45)::INTEGER, ' ') AS padded, upper(regexp_extract(url, '([^.]*)$', 1)) AS label, printf('%.4f', page_id / 7.0) AS number FROM pages")
def display_text(spark, d):
    p = X.table(spark, d, "pages")
    return p.select("page_id", text.escaped_html(F.col("url")).alias("escaped"), text.padded(F.col("url"), 45).alias("padded"), text.language_label(F.col("url")).alias("label"), F.format_string("%.4f", F.col("page_id") / 7.0).alias("number"))


@query(f"WITH {X.EDGES} SELECT s.id, s.kind, s.start_line, count(DISTINCT e.source_id)::BIGINT AS n_callers FROM symbols s LEFT JOIN edges e ON e.target_id = s.id AND e.kind = 'calls' WHERE s.name = '{NAME}' GROUP BY ALL")
def symbol_info(spark, d):
    s = X.symbols(spark, d).where(F.col("name") == NAME)
    e = resolve.callers(X.links(spark, d))
    return s.join(e, s.id == e.target_id, "left").select("id", "kind", "start_line", F.coalesce("n_callers", F.lit(0)).cast("long").alias("n_callers"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_incremental(spark, d):
    """Events through a stream of all there is, added up batch by batch."""
    return incremental.totals(spark, f"{d.rstrip('/')}/events.parquet")


@query(f"""WITH {X.EDGES}, w AS (SELECT target_id AS id, 'caller' AS relation, source_id AS other FROM edges WHERE kind = 'calls'
  UNION SELECT source_id, 'callee', target_id FROM edges WHERE kind = 'calls' AND resolved)
SELECT w.id, relation, other, coalesce(s.name, string_split(other, '::')[-1]) AS name, s.file_path FROM w LEFT JOIN symbols s ON s.id = w.other WHERE w.id IN (SELECT id FROM symbols)""")
def symbol_neighbours(spark, d):
    """Callers and callees of every symbol with names and files."""
    return details.link_neighbours(X.links(spark, d), X.symbols(spark, d))


@query(f"""WITH {X.SYMBOLS}, {X.SUMMARIES}, p AS (SELECT {X.PAGE_PATH} AS path, url, html FROM pages)
SELECT path, split_part(url, '/', 4) AS language, (length(coalesce(html, '')) - length(replace(coalesce(html, ''), chr(10), '')) + 1)::INTEGER AS line_count,
  (SELECT any_value(summary_text) FROM summaries WHERE target_id = path AND NOT is_stale) AS summary,
  (SELECT coalesce(string_agg(name, ' ' ORDER BY start_line, id), '') FROM symbols WHERE file_path = path) AS names FROM p""")
def file_views(spark, d):
    """Every page as a file with its summary and its symbols' names in order."""
    pages = X.table(spark, d, "pages")
    files = pages.select(X.page_path(F.col("page_id")).alias("path"), F.split_part("url", F.lit("/"), F.lit(4)).alias("language"), text.line_count(F.coalesce("html", F.lit(""))).alias("line_count"))
    rows = details.file_details(files, X.symbols(spark, d), X.summaries(spark, d))
    return rows.select("path", "language", "line_count", "summary", F.array_join(F.transform("symbols", lambda s: s["name"]), " ").alias("names"))
