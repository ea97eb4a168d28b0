"""Findings priced, clamped, grouped and rolled up. Amounts are whole hundredths (BIGINT), so sums are exact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(column: str, table: Mapping[str, int | str]):
    """A constant table as an expression; null for what it lacks."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(column))


def evidenced(findings: DataFrame, evidence: str, locator: str, everywhere: str = "document") -> DataFrame:
    """Findings with evidence, or about the document as a whole."""
    return findings.filter((F.coalesce(F.col(evidence), F.lit("")).rlike(r"\S")) | (F.col(locator) == everywhere))


def clamped_costs(findings: DataFrame, points: str, scale: str, category: str, limits: Mapping[str, int]) -> DataFrame:
    """findings with `cost`, in hundredths: points times scale, at most the category's limit where it has one."""
    raw = F.round(F.coalesce(F.col(points), F.lit(0.0)) * F.coalesce(F.col(scale), F.lit(1.0)) * 100).cast("long")
    limit = lookup(category, limits)
    return findings.withColumn("cost", F.least(raw, F.coalesce(limit, raw)))


def deductions(costs: DataFrame, doc: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Rows (doc, category, cost) for every document and listed category, zero where nothing was found.

    One conditional sum a category, unpivoted: documents aren't joined with the list."""
    sums = costs.groupBy(doc).agg(*(F.coalesce(F.sum(F.when(F.col(category) == c, F.col("cost"))), F.lit(0)).alias(f"__{i}") for i, c in enumerate(categories)))
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"__{i}").alias("cost")) for i, c in enumerate(categories)))
    return sums.select(doc, F.explode(pairs).alias("x")).select(doc, F.col("x.category").alias(category), F.col("x.cost").alias("cost"))


def floor_scaled(costs: DataFrame, doc: str, category: str, ceiling: int) -> DataFrame:
    """costs with `points`: a document's costs of a category scaled down so that they sum to `ceiling` at most."""
    total = F.sum("cost").over(Window.partitionBy(doc, category))
    return costs.withColumn("points", F.when(total > ceiling, F.floor(F.col("cost") * ceiling / total)).otherwise(F.col("cost")).cast("long"))


def ledger(costs: DataFrame, doc: str, rule: str, visible: int) -> DataFrame:
    """Rows (doc, ord, label, cost): per document the `visible` rules that cost most, then the rest as one row 'other'.

    Ties go to the rule's name; rules without cost are left out. The rows of a document sum to its costs."""
    sums = costs.groupBy(doc, rule).agg(F.sum("cost").alias("cost")).filter("cost > 0")
    ranked = sums.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("cost"), rule)))
    label = F.when(F.col("__r") <= visible, F.col(rule)).otherwise("other")
    return ranked.groupBy(doc, F.least(F.col("__r"), F.lit(visible + 1)).alias("ord"), label.alias("label")).agg(F.sum("cost").alias("cost"))


def best_per_rule(findings: DataFrame, doc: str, rule: str, order: list, most: int) -> DataFrame:
    """The first finding of each rule in `order`, and of those the first `most` of each document, with `place`."""
    once = findings.withColumn("__r", F.row_number().over(Window.partitionBy(doc, rule).orderBy(*order))).filter("__r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).filter(F.col("place") <= most).drop("__r")


def weighted_scores(parts: DataFrame, doc: str, score: str, weight: str) -> DataFrame:
    """Rows (doc, composite): the weighted mean over parts with a score, 0 to 100, one decimal; null without any."""
    seen = F.col(score).isNotNull()
    top, low = F.sum(F.when(seen, F.col(score) * F.col(weight))), F.sum(F.when(seen, F.col(weight)))
    mean = top / F.nullif(low, F.lit(0))
    return parts.groupBy(doc).agg(F.when(low > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean)), 1)).alias("composite"))


def grade(score, steps: Mapping[str, float], lowest: str):
    """The first grade whose bound the score reaches, in the order given."""
    out = None
    for name, bound in steps.items():
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return F.when(score.isNotNull(), out.otherwise(lowest))


def derived_weights(counts: DataFrame, count: str, budget: float) -> DataFrame:
    """counts with `weight`: the budget shared out in proportion, two decimals; zero if all counts are."""
    total = F.sum(count).over(Window.partitionBy())
    return counts.withColumn("weight", F.coalesce(F.bround(F.lit(budget) * F.col(count) / F.nullif(total, F.lit(0)), 2), F.lit(0.0)))


def capped_severity(severity, provenance, caps: Mapping[str, str], order: Sequence[str]):
    """A severity held down to its provenance's cap; `order` lists severities from the gravest."""
    rank = F.array_position(F.array(*map(F.lit, order)), severity)
    cap = F.try_element_at(F.create_map(*(F.lit(x) for pair in caps.items() for x in pair)), provenance)
    bound = F.array_position(F.array(*map(F.lit, order)), cap)
    return F.when(cap.isNotNull() & (rank < bound), cap).otherwise(severity)


def finding_costs(findings: DataFrame, rule: str, category: str, severity: str, scale: str, points: Mapping[str, int], weights: Mapping[str, float], multipliers: Mapping[str, float], fraud: Sequence[str]) -> DataFrame:
    """findings with `cost`: points of the severity times the rule's multiplier times its scale, at most the category's
    weight; rules of fraud have no such bound. Zero where the category has no weight."""
    raw = F.coalesce(lookup(severity, points), F.lit(0)) * F.coalesce(lookup(rule, multipliers), F.lit(1.0)) * F.coalesce(F.col(scale), F.lit(1.0))
    bound = lookup(category, weights)
    return findings.withColumn("cost", F.when(F.col(rule).isin(*fraud), raw).when(bound.isNull(), F.lit(0.0)).otherwise(F.least(raw, bound)))


def category_scores(costs: DataFrame, doc: str, category: str, weights: Mapping[str, float], withheld: DataFrame | None = None, no_evidence: float = 10.0) -> DataFrame:
    """Rows (doc, category, weight, score): 100 less the costs of each category, not below zero; a withheld category
    (doc, category) scores as one without evidence whatever it cost."""
    left = deductions(costs, doc, category, list(weights))
    left = left.withColumns({"weight": lookup(category, weights).cast("double"), "score": F.greatest(F.lit(0.0), 100.0 - F.col("cost"))}).drop("cost")
    if withheld is None:
        return left
    marked = left.join(withheld.select(doc, category, F.lit(True).alias("__w")).distinct(), [doc, category], "left")
    return marked.withColumn("score", F.when(F.col("__w"), no_evidence).otherwise(F.col("score"))).drop("__w")


def gate_scores(scores: DataFrame, doc: str, gate, names: Sequence[str]) -> DataFrame:
    """One column a gate: the weighted mean of its categories, one decimal; null where nothing was assessed."""
    top = lambda g: F.sum(F.when(gate == g, F.col("score") * F.col("weight")))
    low = lambda g: F.sum(F.when(gate == g, F.col("weight")))
    return scores.groupBy(doc).agg(*(F.bround(top(g) / F.nullif(low(g), F.lit(0.0)), 1).alias(g) for g in names))


def capped(composites: DataFrame, findings: DataFrame, doc: str, rule: str, caps: Mapping[str, float]) -> DataFrame:
    """composites with `capped` and `cap_rule`: the score held down by the lowest cap of a rule found in the document."""
    hit = findings.filter(F.col(rule).isin(*caps)).groupBy(doc).agg(F.min(F.struct(lookup(rule, caps).alias("cap"), F.col(rule).alias("rule"))).alias("__c"))
    both = composites.join(hit, doc, "left")
    down = F.col("__c.cap") < F.col("composite")
    return both.select(composites["*"], F.when(down, F.col("__c.cap")).otherwise(F.col("composite")).alias("capped"), F.when(down, F.col("__c.rule")).alias("cap_rule"))


def running_ledger(rows: DataFrame, doc: str, start: int) -> DataFrame:
    """Ledger rows with `total`: what is left of `start` after each row, in order."""
    upto = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.lit(start) - F.sum("cost").over(upto))


def worst_case(prompts: DataFrame, group: str, tokens: str, calls: int, attempts: int, price_in: float, price_out: float, cap: int) -> DataFrame:
    """Rows (group, documents, dollars): what judging a group's documents may cost at most, prices per million tokens.
    Refused: negative calls or prices, and a cap below one, which would hide another's cost."""
    if calls < 0 or attempts < 0 or price_in < 0 or price_out < 0 or cap < 1:
        raise ValueError("calls, attempts and prices must not be negative, and the cap at least 1")
    spent = F.sum(F.col(tokens) * price_in + cap * price_out)
    return prompts.groupBy(group).agg(F.count("*").alias("documents"), (calls * attempts * spent / 1e6).alias("dollars"))


def largest_cap(costs: DataFrame, budget: float, calls: int, attempts: int, price_out: float, cap: int):
    """`fits` and `largest_cap`: whether a group's worst case is within the budget, and the cap at which it just would be;
    null if none does."""
    each = calls * attempts * F.col("documents") * price_out / 1e6
    best = F.floor(F.round((F.lit(budget) - F.col("dollars")) / each, 6)) + cap
    return costs.withColumns({"fits": F.col("dollars") <= budget, "largest_cap": F.when(best >= 1, best)})
