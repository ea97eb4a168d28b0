"""Consensus of several raters' yes/no answers, with agreement and a reliability per rater."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.replies import read_replies
from tallyforge.session import cut, once, spread_join

#: Raters up to which their weights travel as one constant; beyond it they are joined.
WEIGHTS_AS_CONSTANT = 20_000


def reply_answers(df: DataFrame, reply_key: list[str], reply: str, slugs: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """Rows (reply_key, criterion_id, met): the yes/no answers of JSON replies to the given categories and criteria, the
    first of each; see read_replies. Equal rows count once; only rows whose first key occurs several times are moved."""
    read = read_replies(once(df.select(*reply_key, reply), reply_key[0]), reply_key, reply, slugs, criteria)
    return read.select(*reply_key, F.concat_ws("/", "slug", "criterion").alias("criterion_id"), "met")


def votes_by_rater(answers: DataFrame, item: list[str], rater: str) -> DataFrame:
    """Cut table (item, v): per item the yes and no counts of each rater, at most one entry a rater."""
    counts = answers.groupBy(*item, rater).agg(F.count_if("met").cast("double").alias("y"), F.count_if(~F.col("met")).cast("double").alias("n"))
    return cut(counts.groupBy(*item).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("r"), "y", "n"))).alias("v")))


def reweighted_consensus(votes: DataFrame, item: list[str], rounds: int = 25, tolerance: float = 5e-4, smoothing: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(items, raters) of votes_by_rater.

    items: (item, score, consensus, replies), consensus true where the weighted votes for yes outweigh those for no;
    an even score is no. raters: (rater, accuracy, on_yes, on_no, weight_yes, weight_no, answers). In turn the items'
    scores follow from the raters' weights, and a rater's accuracy on yes and on no items from how their answers agree
    with the score of all others on the same item (leave-one-out, as a probability), smoothed by `smoothing` answers
    at one half. The weights are the log odds of an answer under either accuracy, so a lenient rater's yes weighs
    little, and a rater that is wrong more often than right counts against. It ends when no accuracy moves by
    `tolerance`, or after `rounds`. Raters without an answer aren't listed; without votes both are empty.

    Items with the same votes have the same score, so the rounds run over distinct votes with their numbers of items.
    """
    same = cut(votes.groupBy("v").agg(F.count("*").cast("double").alias("m")))
    raters = votes.select(F.explode("v.r").alias("r")).groupBy("r").agg(F.count("*").alias("answers"))
    weights = cut(raters.select("r", *(F.lit(x).alias(c) for c, x in (("accuracy", 0.5), ("on_yes", 0.5), ("on_no", 0.5), ("wy", 1.0), ("wn", 1.0))), F.lit(0.0).alias("answers")))
    constant = weights.count() <= WEIGHTS_AS_CONSTANT
    worth = lambda x: x["wy"] * x["y"] - x["wn"] * x["n"]
    score = F.aggregate("v", F.lit(0.0), lambda a, x: a + worth(x))
    half = smoothing / 2
    for _ in range(rounds):
        each = _weighed(same, weights, ["m"], constant).select(F.explode("v").alias("x"), score.alias("s"), "m")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("s") - worth(F.col("x"))))))
        y, n = F.col("m") * F.col("x.y"), F.col("m") * F.col("x.n")
        sums = each.groupBy(F.col("x.r").alias("r")).agg(F.sum(p * y).alias("tp"), F.sum(p * (y + n)).alias("pos"), F.sum((1 - p) * n).alias("tn"), F.sum((1 - p) * (y + n)).alias("neg"))
        rates = sums.select("r", ((F.col("tp") + F.col("tn") + half) / (F.col("pos") + F.col("neg") + smoothing)).alias("accuracy"), ((F.col("tp") + half) / (F.col("pos") + smoothing)).alias("on_yes"), ((F.col("tn") + half) / (F.col("neg") + smoothing)).alias("on_no"), (F.col("pos") + F.col("neg")).alias("answers"))
        odds = {"wy": F.log(F.col("on_yes") / (1 - F.col("on_no"))), "wn": F.log(F.col("on_no") / (1 - F.col("on_yes")))}
        last, weights = weights, cut(rates.select("r", "accuracy", "on_yes", "on_no", *(x.alias(c) for c, x in odds.items()), "answers"))
        step = F.greatest(*(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in ("on_yes", "on_no")))
        moved = weights.alias("a").join(last.alias("b"), "r").agg(F.max(step)).first()[0]
        if moved is None or moved < tolerance:
            break
    replies = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["y"] + x["n"])
    items = _weighed(votes, weights, item, constant).select(*item, score.alias("score"), (score > 1e-9).alias("consensus"), replies.alias("replies"))
    return items, weights.select(F.col("r").alias("rater"), "accuracy", "on_yes", "on_no", F.col("wy").alias("weight_yes"), F.col("wn").alias("weight_no"), "answers")


def _weighed(votes: DataFrame, weights: DataFrame, item: list[str], constant: bool) -> DataFrame:
    """votes with the weights wy and wn in each entry."""
    if constant:
        known = json.dumps({str(r["r"]): {"wy": r["wy"], "wn": r["wn"]} for r in weights.select("r", "wy", "wn").collect()})
        table = F.from_json(F.lit(known), "map<string,struct<wy:double,wn:double>>")
        own = lambda x: F.try_element_at(table, x["r"].cast("string"))
        return votes.withColumn("v", F.transform("v", lambda x: F.struct(x["r"].alias("r"), x["y"].alias("y"), x["n"].alias("n"), F.coalesce(own(x)["wy"], F.lit(0.0)).alias("wy"), F.coalesce(own(x)["wn"], F.lit(0.0)).alias("wn"))))
    flat = votes.withColumn("__i", F.monotonically_increasing_id()).select("__i", *item, F.explode("v").alias("x")).select("__i", *item, F.col("x.r").alias("r"), "x.y", "x.n")
    flat = spread_join(cut(flat), weights.select("r", "wy", "wn"), ["r"], "__i")
    return flat.groupBy("__i", *item).agg(F.collect_list(F.struct("r", "y", "n", "wy", "wn")).alias("v"))


def nominal_alpha(votes: DataFrame, group: list[str]) -> DataFrame:
    """Rows (group, items, answers, alpha): Krippendorff's nominal alpha of yes/no answers, items with fewer than two
    answers left out; null where nothing could disagree (one value only, or no item with two answers)."""
    y = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["y"])
    n = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["n"])
    units = votes.select(*group, y.alias("y"), n.alias("n")).filter(F.col("y") + F.col("n") >= 2)
    off = F.sum(2 * F.col("y") * F.col("n") / (F.col("y") + F.col("n") - 1))
    sums = units.groupBy(*group).agg(F.count("*").alias("items"), F.sum("y").alias("sy"), F.sum("n").alias("sn"), off.alias("off"))
    total = F.col("sy") + F.col("sn")
    alpha = 1 - (total - 1) * F.col("off") / F.nullif(2 * F.col("sy") * F.col("sn"), F.lit(0.0))
    return sums.select(*group, "items", total.cast("long").alias("answers"), alpha.alias("alpha"))
