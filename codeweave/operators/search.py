"""Search for many terms at once: postings of character grams, kept with an index, and an exact check of what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grams of one and two characters are there for terms that have no longer ones.
LONGEST = 3
#: Postings of a term that are met: those of its rarest grams.
KEPT = 3


def _cut(text: Column, n: int) -> Column:
    """All runs of n characters, none of a shorter text."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def postings(symbols: DataFrame) -> DataFrame:
    """symbols (id, name, qualified_name) → (gram, id): the distinct grams of both names in lower case, and the empty one."""
    both = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "qualified_name")]
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_cut(c, n) for c in both for n in range(1, LONGEST + 1)]))
    return symbols.select("id", F.explode(grams).alias("gram")).select("gram", "id").distinct()


def search_many(symbols: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """symbols, their postings and terms (term) → (term, id): symbols with a name like %term%, in any case.

    `%` and `_` in a term stand for any text and any character, as in LIKE. The pieces between them have grams; of a
    term's grams the rarest are met, so a common gram's postings are read only for a term that has no other, and what
    all of them have is checked against the names. Counts and postings are read for grams of the terms alone. A term
    of wildcards only finds every symbol with a long enough name; null and empty terms find nothing.
    """
    terms = terms.select("term").where(F.length("term") > 0).distinct()
    pieces = F.filter(F.split(F.lower("term"), "[%_]"), lambda p: p != "")
    grams = F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) < LONGEST, F.array(p)).otherwise(_cut(p, LONGEST)))))
    grams = F.when(F.size(grams) > 0, grams).otherwise(F.array(F.lit("")))
    asked = terms.select("term", F.explode(grams).alias("gram"))
    counts = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy("n", "gram"))
    known = asked.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.withColumn("rank", rank).where(F.col("rank") <= KEPT)
    rarest = rarest.select("term", "gram", F.count("*").over(Window.partitionBy("term")).alias("of"))
    found = rarest.join(index, "gram").groupBy("term", "id", "of").agg(F.count("*").alias("n")).where("n = of").select("term", "id")
    like = F.concat(F.lit("%"), F.replace("term", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    names = symbols.select("id", "name", "qualified_name")
    return found.join(names, "id").withColumn("like", like).where(F.expr("name ilike like or qualified_name ilike like")).select("term", "id")

