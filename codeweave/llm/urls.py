"""URL filter: rules first, then gradient-boosted trees on lexical features, learnt from labelled URLs.

Rules are (host, path prefix, verdict): a rule fits its host and all hosts below it when the URL's path starts with its
prefix, and the longest fitting rule decides. URLs that no rule fits are judged by the trees. Features: length, depth of
the path, share of digits, entropy of the characters, number of parameters, and two suffix statistics: the smoothed share
of blocked ones among the labelled URLs whose host has the same last label, or the same last two.

Learning: suffix counts cover all distinct labelled URLs. The trees are fitted on at most SAMPLE of these, the ones with
the smallest hashes; a row of the sample gets the suffix shares of the other folds, so its own label is not in them.
Features are cut at sample quantiles, rows of equal cuts are counted together (this table, of SAMPLE rows at most, is one
partition), and each level of a tree is one aggregate over (node, feature, cut). Gradients are summed as integers, so
reruns agree to the bit. Judging is one pass over the URLs without an exchange; suffix counts are broadcast if a count has shown
that they are few, else joined with salted keys. Trees are CASE expressions.

Defined results: a null URL, or one without `://`, has host and path '' and is judged as the empty text; A-Z of the host
are in lower case, nothing else is; of fitting rules of equal length the one greatest in code-point order wins; labels
other than 0 and 1 and null URLs aren't learnt from; a URL labelled both ways counts for both; without labelled URLs every
verdict is allow, with one class it is that class; repeated rows and null ids are judged like any other; an empty table
gives no rows; other columns are kept by judge() whatever their names, but those named as one it adds are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.llm import shared

FEATURES = ("length", "depth", "digits", "entropy", "parameters", "last_label", "last_two")
SAMPLE = 10_000
FOLDS = 5
CUTS = 16
TREES, DEPTH, RATE, RIDGE = 8, 3, 0.5, 1.0
#: Labelled URLs that every suffix is thought to have besides its own, with the share of all.
PRIOR = 5.0
UNIT = 1 << 30
SALTS = 16
#: A list of more rules than this does not belong into an expression.
MOST_RULES = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"
ADDED = ("host", "path", "rule", "probability", "verdict")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str, verdict: str) -> Rule:
    """`example.net/en/` → a rule."""
    host, slash, path = text.partition("/")
    return Rule(host.translate(str.maketrans(UPPER, LOWER)), slash + path, verdict)


def _rest(url: Column) -> Column:
    """What follows the first `://`, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, null without one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    found = []
    for labels in sorted({r.host.count(".") + 1 for r in rules}):
        by: dict[str, list[Column]] = {}
        for r in sorted(rules, key=lambda r: r.text):
            if r.host.count(".") + 1 == labels:
                row = F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))
                by.setdefault(r.host, []).append(row)
        table = F.map_from_arrays(F.array(*map(F.lit, by)), F.array(*[F.array(*v) for v in by.values()]))
        found.append(F.try_element_at(table, F.substring_index(host, ".", -labels)))
    fitting = F.filter(F.flatten(F.array_compact(F.array(*found))), lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["length"], r["rule"], r["verdict"])))


def _entropy(text: Column) -> Column:
    """Shannon's entropy of the characters, in bits: one walk over the sorted characters, by lengths of runs."""
    spread = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        same = s["c"] == c
        return F.struct(c.alias("c"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"), (s["sum"] + F.when(same, 0.0).otherwise(spread(s["run"]))).alias("sum"))

    n = F.length(text).cast("double")
    return F.when(n > 0, F.aggregate(chars, start, step, lambda s: F.log2(n) - (s["sum"] + spread(s["run"])) / n)).otherwise(0.0)


def lexical(url: Column) -> dict[str, Column]:
    """The features of a URL's text alone."""
    text = F.coalesce(url, F.lit(""))
    count = lambda c, mark: (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))).cast("double")
    query = F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return {
        "length": F.length(text).cast("double"),
        "depth": count(path(url), "/"),
        "digits": F.when(F.length(text) > 0, digits / F.length(text)).otherwise(0.0),
        "entropy": _entropy(text),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
    }


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


@dataclass
class Model:
    """Suffix counts (paths of tables) and trees: (feature, cut) by node of each level, then leaves."""

    suffixes: dict[int, str] = field(default_factory=dict)
    share: float = 0.5
    base: float = 0.0
    trees: list[tuple[list[dict[int, tuple[str, float]]], list[float]]] = field(default_factory=list)

    def margin(self, x: dict[str, Column]) -> Column:
        """The log odds of being blocked."""
        return sum((_split(levels, x, leaves) for levels, leaves in self.trees), F.lit(self.base))


def _split(levels: list[dict[int, tuple[str, float]]], x: dict[str, Column], leaves: Sequence[float], node: int = 0, level: int = 0) -> Column:
    """The leaf that a row comes to: right where a feature exceeds its cut, left otherwise and where nothing is split."""
    if level == len(levels):
        return F.lit(leaves[node])
    left = _split(levels, x, leaves, 2 * node, level + 1)
    if node not in levels[level]:
        return left
    name, cut = levels[level][node]
    return F.when(x[name] > cut, _split(levels, x, leaves, 2 * node + 1, level + 1)).otherwise(left)


def _joined(rows: DataFrame, host: Column, suffixes: dict[int, str], name: str) -> DataFrame:
    """rows with the counts of their host's suffixes as <name>1 and <name>2; few counts are broadcast, many are salted."""
    spark = rows.sparkSession
    for labels, at in suffixes.items():
        counts = spark.read.parquet(at)
        key, salt = f"{name}_key{labels}", f"{name}_salt{labels}"
        counts = counts.select(F.col("suffix").alias(key), F.struct(*[c for c in counts.columns if c != "suffix"]).alias(f"{name}{labels}"))
        few = shared.small(counts)
        rows = rows.withColumn(key, suffix(host, labels))
        if few is counts:
            rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
            few = counts.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            rows = rows.join(few, [key, salt], "left").drop(key, salt)
        else:
            rows = rows.join(few, key, "left").drop(key)
    return rows


def _share(n: Column, blocked: Column, share: float) -> Column:
    return (F.coalesce(blocked, F.lit(0)) + PRIOR * share) / (F.coalesce(n, F.lit(0)) + PRIOR)


def fit(labelled: DataFrame) -> Model:
    """labelled (url, label 0 or 1; 1: blocked) → a model."""
    spark = labelled.sparkSession
    rows = labelled.select("url", F.col("label").cast("int").alias("label")).where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).distinct()
    rows = shared.stored(rows.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")), "urls-labelled")
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    if not total.n:
        return Model()
    model = Model(share=total.blocked / total.n)
    sums = [F.count("*").alias("n"), F.sum("label").alias("blocked")]
    sums += [F.array(*[F.sum(F.when(F.col("fold") == f, c).otherwise(0)) for f in range(FOLDS)]).alias(a) for a, c in (("fold_n", F.lit(1)), ("fold_blocked", F.col("label")))]
    for labels in (1, 2):
        model.suffixes[labels] = shared.place(spark, "urls-suffixes")
        rows.groupBy(suffix(host(F.col("url")), labels).alias("suffix")).agg(*sums).write.parquet(model.suffixes[labels])

    sample = rows.orderBy(F.xxhash64("url", F.lit(1)), "url", "label").limit(SAMPLE)
    sample = _joined(sample, host(F.col("url")), model.suffixes, "s")
    x = lexical(F.col("url"))
    for labels, name in ((1, "last_label"), (2, "last_two")):
        others = lambda c, s=F.col(f"s{labels}"): s[c] - F.get(s[f"fold_{c}"], F.col("fold"))
        x[name] = _share(others("n"), others("blocked"), model.share)
    sample = shared.stored(sample.select("label", *[x[f].alias(f) for f in FEATURES]), "urls-sample")
    places = [k / CUTS for k in range(1, CUTS)]
    at = sample.agg(*[F.percentile(f, places).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(at[f])) for f in FEATURES}
    binned = [sum((F.col(f) > c).cast("int") for c in cuts[f]).alias(f) for f in FEATURES]
    table = sample.select("label", *binned).groupBy(*FEATURES).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    table = shared.stored(table.coalesce(1), "urls-binned").coalesce(1)  # one partition: the aggregates below need no exchange
    sums = sample.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).first()
    model.base = math.log((sums.pos + 0.5) / (sums.neg + 0.5))
    numbers = Model(base=model.base)  # the same trees on numbers of cuts
    for _ in range(TREES):
        levels, leaves = _tree(table, numbers)
        if not any(levels):
            break
        numbers.trees.append((levels, leaves))
        model.trees.append(([{k: (f, cuts[f][int(c)]) for k, (f, c) in level.items()} for level in levels], leaves))
    return model


def _tree(table: DataFrame, model: Model) -> tuple[list[dict[int, tuple[str, float]]], list[float]]:
    """The next tree over rows of cut numbers: at each node the split that lowers the loss most, a job a level."""
    x = {f: F.col(f) for f in FEATURES}
    p = 1 / (1 + F.exp(-model.margin(x)))
    n = F.col("pos") + F.col("neg")
    rows = table.select(*FEATURES, F.round((F.col("pos") - n * p) * UNIT).cast("long").alias("g"), F.round(n * p * (1 - p) * UNIT).cast("long").alias("h"))
    levels: list[dict[int, tuple[str, float]]] = []
    value: dict[int, float] = {}
    for _ in range(DEPTH):
        node = _split(levels, x, range(1 << len(levels))).alias("node")
        each = rows.select(node, "g", "h", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("cut")) for k, f in enumerate(FEATURES)])).alias("x"))
        bins = each.groupBy("node", "x.f", "x.cut").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        w = Window.partitionBy("node", "f")
        up = w.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sides = bins.select("node", "f", "cut", F.sum("g").over(up).alias("gl"), F.sum("h").over(up).alias("hl"), F.sum("g").over(w).alias("g"), F.sum("h").over(w).alias("h"))
        gain = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
        gl, hl, g, h = (F.col(c) for c in ("gl", "hl", "g", "h"))
        sides = sides.withColumn("gain", F.round(gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h), 9))
        order = F.struct("gain", -F.col("f"), -F.col("cut"))
        best = sides.groupBy("node").agg(F.max_by(F.struct("f", "cut", "gain", "gl", "hl", "g", "h"), order).alias("s")).orderBy("node").collect()
        level, value = {}, {}
        leaf = lambda g, h: RATE * (g / UNIT) / (h / UNIT + RIDGE)
        for r in best:
            s = r.s
            if s.gain > 1e-6:
                level[r.node] = (FEATURES[s.f], float(s.cut))
                value[2 * r.node], value[2 * r.node + 1] = leaf(s.gl, s.hl), leaf(s.g - s.gl, s.h - s.hl)
            else:
                value[2 * r.node] = leaf(s.g, s.h)
        levels.append(level)
    return levels, [value.get(k, 0.0) for k in range(1 << DEPTH)]


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model) -> DataFrame:
    """pages (url, …) → their columns with host, path, rule, probability of being blocked (null where a rule decides) and verdict."""
    url = F.col("url")
    kept = [c for c in pages.columns if c.lower() not in ADDED]
    pages = pages.select(*kept)
    name = "url_facts"
    while any(c.lower().startswith(name) for c in pages.columns):
        name += "_"
    rows = _joined(pages, host(url), model.suffixes, name)
    facts = {"host": host(url), "path": path(url), "hit": matched(host(url), path(url), rules)} | lexical(url)
    for labels, feature in ((1, "last_label"), (2, "last_two")):
        s = F.col(f"{name}{labels}") if model.suffixes else None
        facts[feature] = _share(s["n"], s["blocked"], model.share) if s is not None else F.lit(model.share)
    # Each fact is a column of its own, worked out once, before the trees use it many times.
    rows = rows.select(*pages.columns, *[c.alias(f"{name}_{f}") for f, c in facts.items()])
    fact = {f: F.col(f"{name}_{f}") for f in facts}
    p = 1 / (1 + F.exp(-model.margin({f: fact[f] for f in FEATURES})))
    p = F.when(fact["hit"].isNull(), p)
    verdict = F.coalesce(fact["hit"]["verdict"], F.when(p > 0.5, BLOCK).otherwise(ALLOW))
    return rows.select(*pages.columns, fact["host"].alias("host"), fact["path"].alias("path"), fact["hit"]["rule"].alias("rule"), p.alias("probability"), verdict.alias("verdict"))


#: The rules of the query.
RULES = (rule("net/", BLOCK), rule("example.net/en/", ALLOW), rule("example.com/de/", BLOCK), rule("org/fr/", ALLOW))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL; the URLs that rules decide are the labelled ones."""
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    hit = matched(host(F.col("url")), path(F.col("url")), RULES)["verdict"]
    model = fit(pages.select("url", F.when(hit == BLOCK, 1).when(hit == ALLOW, 0).alias("label")))
    return judge(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "probability")
