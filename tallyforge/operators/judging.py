"""Repeated judgements folded: votes, k of n, unions, bands; and how far judges agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def majority(answers: DataFrame, item: list[str], met: str) -> DataFrame:
    """Rows (item, met, yes, no): more yes than no is yes, a tie is no, no answers at all is null."""
    yes, no = F.count_if(F.col(met)), F.count_if(~F.col(met))
    return answers.groupBy(*item).agg(F.when(yes + no == 0, None).otherwise(yes > no).alias("met"), yes.alias("yes"), no.alias("no"))


def exemplar(answers: DataFrame, item: list[str], sample: str, met: str, evidence: str) -> DataFrame:
    """Rows (item, met, sample): the majority, and the first sample on its side, those with evidence before others."""
    per = Window.partitionBy(*item)
    side = F.when(F.count(met).over(per) > 0, F.count_if(F.col(met)).over(per) > F.count_if(~F.col(met)).over(per))
    rank = F.struct((F.col(met) != F.col("__m")).cast("int"), F.when(F.coalesce(F.col(evidence), F.lit("")) != "", 0).otherwise(1), F.col(sample))
    sided = answers.withColumn("__m", side)
    return sided.groupBy(*item).agg(F.first("__m").alias("met"), F.min_by(sample, rank).alias("sample"))


def k_of_n(votes: DataFrame, item: list[str], provider: str, sample: str, k: int, returned: DataFrame | None = None) -> DataFrame:
    """Rows (item, providers, confidence): items stated in at least k of a provider's samples (or all that were
    returned, if fewer); joined over providers, confidence 'high' if several state it, else 'medium'.

    `returned` holds the samples that came back (item[0], provider, sample), those that state nothing among them;
    without it the votes stand for them."""
    given = (votes if returned is None else returned).groupBy(item[0], provider).agg(F.countDistinct(sample).alias("__n"))
    stated = votes.groupBy(*item, provider).agg(F.countDistinct(sample).alias("__k"))
    kept = stated.join(given, [item[0], provider]).filter(F.col("__k") >= F.least(F.lit(k), F.col("__n")))
    out = kept.groupBy(*item).agg(F.count("*").alias("providers"))
    return out.withColumn("confidence", F.when(F.col("providers") > 1, "high").otherwise("medium"))


def band_table(spark: SparkSession, rules: dict[str, Sequence[str]]) -> DataFrame:
    """Rows (scheme, mask, band, position) for all 32 answer sets of five criteria, criterion i being bit i - 1.

    rules: scheme -> five conditions in SQL on c1..c5 and met (the number of yes), for bands E to A in that order;
    the first that holds counts, so a table is total if the last condition is."""
    bits = spark.range(32).select(F.col("id").cast("int").alias("mask"), *(((F.shiftright(F.col("id"), i) % 2) == 1).alias(f"c{i + 1}") for i in range(5)))
    bits = bits.withColumn("met", F.bit_count("mask"))
    out = None
    for scheme, conditions in rules.items():
        place = None
        for i, c in enumerate(conditions):
            place = F.when(F.expr(c), i) if place is None else place.when(F.expr(c), i)
        part = bits.select(F.lit(scheme).alias("scheme"), "mask", place.alias("position"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("band", F.substring(F.lit("EDCBA"), 1, 5).substr(F.col("position") + 1, F.lit(1)))


def leverage(bands: DataFrame) -> DataFrame:
    """Rows (scheme, criterion, flips, widest): of the 32 answer sets, those whose band moves if the criterion's answer
    does, and by how many bands at most."""
    flips = bands.select("scheme", "mask", "position", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("criterion"))
    flips = flips.withColumn("other", F.col("mask").bitwiseXOR(F.pow(F.lit(2), F.col("criterion") - 1).cast("int")))
    other = bands.select("scheme", F.col("mask").alias("other"), F.col("position").alias("moved"))
    joined = flips.join(F.broadcast(other), ["scheme", "other"])  # 32 rows a scheme
    return joined.groupBy("scheme", "criterion").agg(F.count_if(F.col("position") != F.col("moved")).alias("flips"), F.max(F.abs(F.col("position") - F.col("moved"))).alias("widest"))


def lower_band(judged: DataFrame, item: list[str], position: str) -> DataFrame:
    """Rows (item, lowest, highest, gap, judges): of several judges' bands the lower one counts."""
    return judged.groupBy(*item).agg(F.min(position).alias("lowest"), F.max(position).alias("highest"), (F.max(position) - F.min(position)).alias("gap"), F.count(position).alias("judges"))


def spreads(values: DataFrame, item: list[str], judge: str, value: str) -> DataFrame:
    """Rows (item, between, within): the range of the judges' means, and the widest range of one judge's values; null
    with fewer than two judges or no judge with two values."""
    per = values.groupBy(*item, judge).agg(F.avg(value).alias("__mean"), F.when(F.count(value) > 1, F.max(value) - F.min(value)).alias("__range"))
    return per.groupBy(*item).agg(F.when(F.count("__mean") > 1, F.max("__mean") - F.min("__mean")).alias("between"), F.max("__range").alias("within"))


def krippendorff(values: DataFrame, unit: list[str], value: str, scale: str, group: list[str] | None = None) -> DataFrame:
    """Rows (group, units, answers, alpha): Krippendorff's alpha for 'nominal', 'ordinal' or 'interval' values.

    Units with fewer than two values are left out; alpha is null where expected disagreement is zero. Values are
    counted per unit first, so a unit weighs by its distinct values, not its answers; pairs are pairs of those."""
    group = group or []
    counts = values.filter(F.col(value).isNotNull()).groupBy(*group, *unit, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    per = Window.partitionBy(*group, *unit)
    counts = counts.withColumn("__m", F.sum("__n").over(per)).filter("__m >= 2")
    sums = counts.groupBy(*group, "__v").agg(F.sum("__n").alias("__n"))
    order = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumn("__c", F.sum("__n").over(order) - F.col("__n") / 2)  # the middle of a value's ranks
    at = {"nominal": F.col("__v"), "ordinal": F.col("__c"), "interval": F.col("__v").cast("double")}[scale]
    placed = ranked.select(*group, "__v", F.col("__n").alias("__all"), at.alias("__x"))
    held = counts.join(placed.drop("__all"), [*group, "__v"])
    if scale == "nominal":
        seen = held.groupBy(*group, *unit).agg(F.first("__m").alias("__m"), F.sum(F.col("__n") * F.col("__n")).alias("__s"))
        observed = seen.groupBy(*group).agg(F.sum((F.col("__m") * F.col("__m") - F.col("__s")) / (F.col("__m") - 1)).alias("__do"), F.count("*").alias("units"), F.sum("__m").alias("answers"))
        expected = placed.groupBy(*group).agg((F.sum("__all") * F.sum("__all") - F.sum(F.col("__all") * F.col("__all"))).alias("__de"))
    else:  # the sum over pairs of a squared difference is 2 (n sum of squares - square of sum)
        x, n = F.col("__x"), F.col("__n")
        seen = held.groupBy(*group, *unit).agg(F.first("__m").alias("__m"), F.sum(n * x * x).alias("__q"), F.sum(n * x).alias("__s"))
        observed = seen.groupBy(*group).agg(F.sum(2 * (F.col("__m") * F.col("__q") - F.col("__s") * F.col("__s")) / (F.col("__m") - 1)).alias("__do"), F.count("*").alias("units"), F.sum("__m").alias("answers"))
        n = F.col("__all")
        expected = placed.groupBy(*group).agg((2 * (F.sum(n) * F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x))).alias("__de"))
    both = observed.join(expected, group) if group else observed.join(F.broadcast(expected))
    alpha = 1 - (F.col("answers") - 1) * F.col("__do") / F.nullif(F.col("__de").cast("double"), F.lit(0.0))
    return both.select(*group, "units", "answers", alpha.alias("alpha"))


def set_overlap(members: DataFrame, item: list[str], judge: str, element: str, universe: int) -> DataFrame:
    """Rows (item, judge_a, judge_b, jaccard, chance, kappa) for each pair of an item's judges.

    members holds each judge's distinct elements. chance is the Jaccard of independent sets of the same sizes among
    `universe` elements. Pairs are of judges of one item, in one row, never of elements."""
    sets = members.groupBy(*item, judge).agg(F.collect_set(element).alias("s"))
    packed = sets.groupBy(*item).agg(F.array_sort(F.collect_list(F.struct(F.col(judge).alias("j"), "s"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: F.struct(a["j"].alias("judge_a"), b["j"].alias("judge_b"), F.size(F.array_intersect(a["s"], b["s"])).alias("both"), F.size(a["s"]).alias("na"), F.size(b["s"]).alias("nb")))))
    flat = packed.select(*item, F.explode(pairs).alias("p")).select(*item, "p.*")
    joint = F.col("na") * F.col("nb") / F.lit(float(universe))
    jaccard = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    chance = joint / (F.col("na") + F.col("nb") - joint)
    return flat.select(*item, "judge_a", "judge_b", jaccard.alias("jaccard"), chance.alias("chance"), ((jaccard - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def spearman(df: DataFrame, group: str, x: str, y: str, tie: str) -> DataFrame:
    """Rows (group, n, rho): rank correlation, ties ranked in order of `tie`; null below three rows."""
    rx, ry = (F.row_number().over(Window.partitionBy(group).orderBy(c, tie)) for c in (x, y))
    ranked = df.select(group, rx.cast("long").alias("__x"), ry.cast("long").alias("__y"))
    n = F.count("*")
    gap = F.sum((F.col("__x") - F.col("__y")) * (F.col("__x") - F.col("__y")))
    return ranked.groupBy(group).agg(n.alias("n"), F.when(n >= 3, 1 - 6.0 * gap / (n * (n * n - 1))).alias("rho"))


def missing(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """What was expected and isn't there."""
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti")


def compared(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, old, new, status): 'carried', 'changed', 'gone' or 'new'. Keys are unique on either side."""
    a, b = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("__a")), new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("__b"))
    both = a.join(b, keys, "full")
    status = F.when(F.col("__b").isNull(), "gone").when(F.col("__a").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "carried").otherwise("changed")
    return both.select(*keys, "old", "new", status.alias("status"))


def place_answers(answers: DataFrame, item: list[str], place: str, met: str) -> DataFrame:
    """Rows (item, place, met): each place's answer; a place answered both ways is left out, and so are abstentions."""
    said = answers.filter(F.col(met).isNotNull()).groupBy(*item, place).agg(F.min(met).alias("met"), F.max(met).alias("__hi"))
    return said.filter(F.col("met") == F.col("__hi")).drop("__hi")


def any_place(required: DataFrame, answers: DataFrame, item: list[str], place: str) -> DataFrame:
    """Rows (item, met): yes if some required place says yes; null if one that could change that is unanswered; else no.

    required: (item, place); answers: (item, place, met), one row a place."""
    both = required.join(answers, [*item, place], "left")
    return both.groupBy(*item).agg(F.when(F.max("met"), True).when(F.count("met") < F.count("*"), None).otherwise(False).alias("met"))


def every_group(required: DataFrame, answers: DataFrame, item: list[str], group: str, place: str) -> DataFrame:
    """Rows (item, met): no if some group is answered in full without a yes; else null if a group without a yes has
    unanswered places; else yes. required: (item, group, place); a group without places has no yes."""
    both = required.join(answers, [*item, place], "left")
    per = both.groupBy(*item, group).agg(F.coalesce(F.max("met"), F.lit(False)).alias("__yes"), (F.count("met") == F.count(place)).alias("__full"))
    failing, undecided = F.max(~F.col("__yes") & F.col("__full")), F.max(~F.col("__yes") & ~F.col("__full"))
    return per.groupBy(*item).agg(F.when(failing, False).when(undecided, None).otherwise(True).alias("met"))


def band_verdicts(judged: DataFrame, item: list[str], group: str, judge: str, position: str) -> DataFrame:
    """Rows (group, items, exact, adjacent, far, unstable, verdict): per item the widest gap between two judges' bands.
    'FAIL' with a far gap or several adjacent ones, 'look' with one or with a judge that contradicts itself."""
    per = judged.groupBy(group, *item, judge).agg(F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    packed = per.groupBy(group, *item).agg(F.collect_list(F.struct(F.col(judge).alias("j"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))).alias("__x"), F.max((F.col("__lo") != F.col("__hi")).cast("int")).alias("__u"))
    gaps = F.flatten(F.transform("__x", lambda a: F.transform("__x", lambda b: F.when(a["j"] != b["j"], a["hi"] - b["lo"]))))
    gap = packed.select(group, "__u", F.array_max(gaps).alias("__g"))
    sums = gap.groupBy(group).agg(F.count("__g").alias("items"), F.count_if(F.col("__g") <= 0).alias("exact"), F.count_if(F.col("__g") == 1).alias("adjacent"), F.count_if(F.col("__g") > 1).alias("far"), F.sum("__u").alias("unstable"))
    verdict = F.when((F.col("far") > 0) | (F.col("adjacent") > 1), "FAIL").when((F.col("adjacent") > 0) | (F.col("unstable") > 0), "look").otherwise("pass")
    return sums.withColumn("verdict", verdict)


def spread_verdicts(values: DataFrame, item: list[str], judge: str, value: str, passes: float = 5.0, fails: float = 8.0) -> DataFrame:
    """Rows (item, spread, verdict): the widest difference between values of two judges; null with one judge."""
    per = values.groupBy(*item, judge).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    packed = per.groupBy(*item).agg(F.collect_list(F.struct(F.col(judge).alias("j"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))).alias("x"))
    gaps = F.array_max(F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.when(a["j"] != b["j"], a["hi"] - b["lo"])))))
    return packed.select(*item, gaps.alias("spread")).withColumn("verdict", F.when(F.col("spread") <= passes, "pass").when(F.col("spread") <= fails, "look").when(F.col("spread").isNotNull(), "FAIL"))


def offsets(pairs: DataFrame, group: str, a: str, b: str, bar: float = 5.0) -> DataFrame:
    """Rows (group, n, offset, worst, mean_residual, inside, higher): the mean difference of two judges, what is left once
    it is taken out, how many are within `bar` then, and in how many the second is higher."""
    diff = F.col(b) - F.col(a)
    means = pairs.groupBy(group).agg(F.avg(diff).alias("offset"))
    left = pairs.join(F.broadcast(means), group).withColumn("__r", F.abs(diff - F.col("offset")))  # a row a group
    return left.groupBy(group).agg(F.count("*").alias("n"), F.first("offset").alias("offset"), F.max("__r").alias("worst"), F.avg("__r").alias("mean_residual"), F.count_if(F.col("__r") <= bar).alias("inside"), F.count_if(diff > 0).alias("higher"))


def key_score(key: DataFrame, samples: DataFrame, answers: DataFrame, item: list[str], judge: list[str]) -> DataFrame:
    """Rows (judge, matched, wrong, missing): each judge's answers against a key (item, answer). `samples` lists the
    judges that were asked, so that one without any answer has a row; an entry a judge left out is missing."""
    asked = samples.select(*judge).distinct().join(F.broadcast(key))  # every judge is asked every entry of a small key
    both = asked.join(answers.select(*judge, *item, F.col("met").alias("__m")), [*judge, *item], "left")
    return both.groupBy(*judge).agg(F.count_if(F.col("__m") == F.col("answer")).alias("matched"), F.count_if(F.col("__m") != F.col("answer")).alias("wrong"), F.count_if(F.col("__m").isNull()).alias("missing"))
