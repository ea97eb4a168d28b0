"""Document frequencies of terms, coverage and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.session import spread_join


#: First words of aliases up to which they are sent around as a set.
FIRST_WORDS = 20_000


def mentions(docs: DataFrame, key: str, text: str, terms: DataFrame, term: str, alias: str) -> DataFrame:
    """Rows (key, term, mentions): how often each term's aliases stand in a document as whole words, case ignored.

    Aliases become word sequences. Documents are cut into sequences of as many words as some alias has, but only where a
    word stands that some alias begins with (a set of measured size; beyond FIRST_WORDS everywhere), and these are joined
    by equality, instead of a pattern search of every text for every alias."""
    plain = lambda c: F.array_join(T.tokens(F.col(c)), " ")
    wanted = terms.select(F.col(term).alias("term"), plain(alias).alias("g")).filter("g <> ''").distinct()
    sizes = sorted(r["n"] for r in wanted.select(F.size(F.split("g", " ")).alias("n")).distinct().collect())
    ws = docs.select(key, T.tokens(F.col(text)).alias("w")).filter(F.size("w") > 0)
    lengths = F.array(*map(F.lit, sizes)).cast("array<int>")
    firsts = [r["f"] for r in wanted.select(F.split("g", " ")[0].alias("f")).distinct().limit(FIRST_WORDS + 1).collect()]
    places = F.sequence(F.lit(0), F.size("w") - 1)
    if len(firsts) <= FIRST_WORDS:
        places = F.filter(places, lambda i: F.get("w", i).isin(*firsts)) if firsts else F.array().cast("array<int>")
    grams = F.transform(places, lambda i: F.transform(F.filter(lengths, lambda n: n <= F.size("w") - i), lambda n: F.array_join(F.slice(F.col("w"), i + 1, n), " ")))
    flat = ws.select(key, F.explode(F.flatten(grams)).alias("g"))
    return spread_join(flat, wanted, ["g"], key).groupBy(key, "term").agg(F.count("*").alias("mentions"))


def document_frequency(hits: DataFrame, key: str, term: str) -> DataFrame:
    """Rows (term, doc_frequency, total_mentions)."""
    return hits.groupBy(term).agg(F.countDistinct(key).alias("doc_frequency"), F.sum("mentions").alias("total_mentions"))


def coverage_by_group(terms: DataFrame, held: DataFrame, doc: str, group: str, term: str) -> DataFrame:
    """Rows (doc, group, matched, total): of a group's terms those a document holds. Documents holding none of a
    group's terms have no row of it."""
    totals = terms.select(group, term).distinct().groupBy(group).agg(F.count("*").alias("total"))
    hit = held.select(doc, term).distinct().join(terms.select(group, term).distinct(), term).groupBy(doc, group).agg(F.count("*").alias("matched"))
    return hit.join(totals, group).select(doc, group, "matched", "total")


def top_per_group(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group, with `place`."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= most)
