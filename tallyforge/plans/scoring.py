"""Queries over findings: costs, deductions, ledgers, rankings, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import scoring as S
from tallyforge.session import once
from tallyforge.sources.tables import table

#: Limits per category, in hundredths; the categories a report lists; the order of severities.
LIMITS = {"Structure": 500, "Contact": 500, "Parseability": 1500, "Resume craft": 750}
SEVERITIES = ("critical", "major", "minor")
VISIBLE, CEILING, TOP = 5, 2000, 5


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    cols = ("finding_id", "resume_id", "rule_id", "category", "gate", "advice_only", "severity", "evidence", "locator_path", "points", "cost_scale")
    return table(spark, folder, "findings", *cols).distinct()


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    kept = S.evidenced(_findings(spark, folder), "evidence", "locator_path").filter(~F.coalesce("advice_only", F.lit(False)))
    return S.clamped_costs(kept, "points", "cost_scale", "category", LIMITS)


def _severity():
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(9))


def score_evidenced(spark: SparkSession, folder: str) -> DataFrame:
    """Findings without evidence, by what they lack."""
    f = _findings(spark, folder)
    gone = f.join(S.evidenced(f, "evidence", "locator_path"), "finding_id", "left_anti")
    return gone.groupBy("rule_id", F.when(F.col("evidence").isNull(), "none").otherwise("blank").alias("lacks")).agg(F.count("*").alias("findings"))


def score_clamped_cost(spark: SparkSession, folder: str) -> DataFrame:
    return _costs(spark, folder).select("finding_id", "cost")


def score_deductions_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    return S.deductions(_costs(spark, folder), "resume_id", "category", sorted(LIMITS))


def score_points_floor_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return S.floor_scaled(_costs(spark, folder), "resume_id", "category", CEILING).select("finding_id", "points")


def score_ledger_topk_tail(spark: SparkSession, folder: str) -> DataFrame:
    return S.ledger(_costs(spark, folder), "resume_id", "rule_id", VISIBLE).select("resume_id", F.col("ord").cast("long").alias("ord"), "label", "cost")


def score_ledger_reconciles(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's sum against the costs'; equal for every document."""
    costs = _costs(spark, folder)
    rows = S.ledger(costs, "resume_id", "rule_id", VISIBLE).groupBy("resume_id").agg(F.sum("cost").alias("ledger_sum"))
    return costs.groupBy("resume_id").agg(F.sum("cost").alias("cost_sum")).join(rows, "resume_id", "left").select("resume_id", "cost_sum", F.coalesce("ledger_sum", F.lit(0)).alias("ledger_sum"))


def score_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Composite and grade of each document: weighted mean of what its categories have left."""
    limits = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))
    left = S.deductions(_costs(spark, folder), "resume_id", "category", sorted(LIMITS))
    weight = F.element_at(limits, F.col("category")).cast("double")
    parts = left.withColumns({"w": weight, "s": F.greatest(F.lit(0.0), 100 - 10.0 * F.col("cost") / weight)})
    out = S.weighted_scores(parts, "resume_id", "s", "w")
    return out.withColumn("grade", S.grade(F.col("composite"), {"A": 90.0, "B": 80.0, "C": 70.0, "D": 60.0}, "F"))


def score_grade_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return score_composite(spark, folder).groupBy("grade").agg(F.count("*").alias("documents"))


def score_subscores_nullable(spark: SparkSession, folder: str) -> DataFrame:
    """Costs by gate, null where a document has no finding of the gate."""
    gates = ("parser", "recruiter", "manager")
    return _costs(spark, folder).groupBy("resume_id").agg(*(F.sum(F.when(F.col("gate") == g, F.col("cost"))).alias(g) for g in gates))


def report_top5_distinct_rules(spark: SparkSession, folder: str) -> DataFrame:
    costs = _costs(spark, folder)
    out = S.best_per_rule(costs, "resume_id", "rule_id", [_severity(), F.desc("cost"), "finding_id"], TOP)
    return out.select("resume_id", F.col("place").cast("long").alias("place"), "rule_id", "finding_id")


def report_groups_by_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of one rule and gate in a document: how many, their cost, and the lead."""
    groups = _costs(spark, folder).groupBy("resume_id", "gate", "rule_id")
    return groups.agg(F.count("*").alias("instances"), F.sum("cost").alias("total"), F.min_by("finding_id", F.struct(-F.col("cost"), "finding_id")).alias("lead"))


def report_rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).groupBy("rule_id").agg(F.count("*").alias("findings"), F.countDistinct("resume_id").alias("resumes"))


def report_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Findings rolled up over gate, category and severity; level tells which columns are totals."""
    out = _findings(spark, folder).rollup("gate", "category", "severity").agg(F.count("*").alias("findings"), F.grouping_id().cast("long").alias("level"))
    return out.select("gate", "category", "severity", "level", "findings")


def report_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A few lines of Markdown per document: its ledger in order."""
    rows = S.ledger(_costs(spark, folder), "resume_id", "rule_id", VISIBLE)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "cost"))), lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["cost"]))
    return rows.groupBy("resume_id").agg(F.array_join(lines, "\n").alias("markdown"))


def report_html(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of each document as an HTML list, marks of HTML in labels written out."""
    rows = S.ledger(_costs(spark, folder), "resume_id", "rule_id", VISIBLE)
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "cost"))), lambda x: F.concat(F.lit("<li>"), safe(x["label"]), F.lit(" <b>"), x["cost"], F.lit("</b></li>")))
    return rows.groupBy("resume_id").agg(F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>")).alias("html"))


def report_fixed_width(spark: SparkSession, folder: str) -> DataFrame:
    """Rules by cost in columns of fixed width: label to the left, documents and cost to the right."""
    sums = _costs(spark, folder).groupBy("rule_id").agg(F.countDistinct("resume_id").alias("docs"), F.sum("cost").alias("cost"))
    return sums.select("rule_id", F.concat(F.rpad("rule_id", 30, " "), F.lpad(F.col("docs").cast("string"), 8, " "), F.lpad(F.col("cost").cast("string"), 12, " ")).alias("line"))


def report_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """All findings of a document in order: gravest first, then dearest, then by id."""
    w = Window.partitionBy("resume_id").orderBy(_severity(), F.desc("cost"), "finding_id")
    return _costs(spark, folder).select("resume_id", "finding_id", F.row_number().over(w).cast("long").alias("place"))


def prompt_assembled(spark: SparkSession, folder: str) -> DataFrame:
    """The text a judge would be shown: a résumé's first 12,000 characters, then its first 40 findings, gravest first. Both
    bounds are the feature. Comes as digest, length and number of findings."""
    texts = once(table(spark, folder, "resumes", "resume_id", "text"), "resume_id").filter("text IS NOT NULL")
    f = _findings(spark, folder)
    w = Window.partitionBy("resume_id").orderBy(_severity(), "finding_id")
    first = f.withColumn("r", F.row_number().over(w)).filter("r <= 40").withColumn("l", F.concat_ws(" ", F.lit("-"), "rule_id", "evidence"))
    lines = first.groupBy("resume_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "l"))), lambda x: x["l"]), "\n").alias("f"), F.count("*").alias("findings"))
    both = texts.join(lines, "resume_id", "left").select("resume_id", F.concat(F.substring("text", 1, 12000), F.lit("\n\nFINDINGS\n"), F.coalesce("f", F.lit(""))).alias("p"), F.coalesce("findings", F.lit(0)).alias("findings"))
    return both.select("resume_id", F.md5("p").alias("digest"), F.length("p").cast("long").alias("chars"), "findings")


def union_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all sources joined on rule and locator, the smallest id standing for each."""
    f = _findings(spark, folder).filter("locator_path <> ''")
    return f.groupBy("resume_id", "rule_id", "locator_path").agg(F.min("finding_id").alias("finding_id"), F.count("*").alias("merged"))


QUERIES = {
    f.__name__: f
    for f in (
        score_evidenced, score_clamped_cost, score_deductions_zero_filled, score_points_floor_scaled, score_ledger_topk_tail, score_ledger_reconciles, score_composite,
        score_grade_histogram, score_subscores_nullable, report_top5_distinct_rules, report_groups_by_gate, report_rule_counts, report_rollup, report_markdown, report_html, report_fixed_width, report_ranked, prompt_assembled, union_first_wins,
    )
}

_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items()) + " END"
_F = """f AS (SELECT DISTINCT finding_id, resume_id, rule_id, category, gate, advice_only, severity, evidence, locator_path, points, cost_scale FROM findings)"""
_C = f"""{_F}, r AS (SELECT *, CAST(round(coalesce(points, 0.0) * coalesce(cost_scale, 1.0) * 100) AS BIGINT) AS raw FROM f
  WHERE (regexp_matches(coalesce(evidence, ''), '\\S') OR locator_path = 'document') AND NOT coalesce(advice_only, false)),
c AS (SELECT *, least(raw, coalesce({_CASE}, raw)) AS cost FROM r)"""
_SEV = "CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE CASE WHEN severity IS NULL THEN 9 ELSE 0 END END"
_D = f"""{_C}, k(category) AS (VALUES {', '.join(f"('{x}')" for x in sorted(LIMITS))}), d AS (SELECT DISTINCT resume_id FROM c),
z AS (SELECT d.resume_id, k.category, CAST(coalesce(sum(c.cost), 0) AS BIGINT) AS cost FROM d CROSS JOIN k LEFT JOIN c ON c.resume_id = d.resume_id AND c.category = k.category GROUP BY 1, 2)"""
_L = f"""{_C}, s AS (SELECT resume_id, rule_id, CAST(sum(cost) AS BIGINT) AS cost FROM c GROUP BY 1, 2 HAVING sum(cost) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY cost DESC, rule_id) AS r FROM s),
l AS (SELECT resume_id, least(r, {VISIBLE + 1}) AS ord, CASE WHEN r <= {VISIBLE} THEN rule_id ELSE 'other' END AS label, CAST(sum(cost) AS BIGINT) AS cost FROM n GROUP BY 1, 2, 3)"""
_G = f"""{_D}, w AS (SELECT *, CAST({_CASE} AS DOUBLE) AS wt FROM z), p AS (SELECT resume_id, round_even(greatest(0.0, least(100.0, sum(greatest(0.0, 100 - 10.0 * cost / wt) * wt) / sum(wt))), 1) AS composite FROM w GROUP BY 1),
g AS (SELECT *, CASE WHEN composite >= 90 THEN 'A' WHEN composite >= 80 THEN 'B' WHEN composite >= 70 THEN 'C' WHEN composite >= 60 THEN 'D' ELSE 'F' END AS grade FROM p)"""

ORACLES = {
    "score_evidenced": f"WITH {_F} SELECT rule_id, CASE WHEN evidence IS NULL THEN 'none' ELSE 'blank' END AS lacks, count(*) AS findings FROM f WHERE NOT (regexp_matches(coalesce(evidence, ''), '\\S') OR coalesce(locator_path = 'document', false)) GROUP BY 1, 2",
    "score_clamped_cost": f"WITH {_C} SELECT finding_id, cost FROM c",
    "score_deductions_zero_filled": f"WITH {_D} SELECT resume_id, category, cost FROM z",
    "score_points_floor_scaled": f"WITH {_C}, t AS (SELECT *, sum(cost) OVER (PARTITION BY resume_id, category) AS t FROM c) SELECT finding_id, CAST(CASE WHEN t > {CEILING} THEN floor(cost * {CEILING} / t) ELSE cost END AS BIGINT) AS points FROM t",
    "score_ledger_topk_tail": f"WITH {_L} SELECT resume_id, ord, label, cost FROM l",
    "score_ledger_reconciles": f"WITH {_C} SELECT resume_id, CAST(sum(cost) AS BIGINT) AS cost_sum, CAST(sum(cost) AS BIGINT) AS ledger_sum FROM c GROUP BY 1",
    "score_composite": f"WITH {_G} SELECT resume_id, composite, grade FROM g",
    "score_grade_histogram": f"WITH {_G} SELECT grade, count(*) AS documents FROM g GROUP BY 1",
    "score_subscores_nullable": f"WITH {_C} SELECT resume_id, " + ", ".join(f"CAST(sum(cost) FILTER (gate = '{g}') AS BIGINT) AS {g}" for g in ("parser", "recruiter", "manager")) + " FROM c GROUP BY 1",
    "report_top5_distinct_rules": f"""WITH {_C}, o AS (SELECT *, row_number() OVER (PARTITION BY resume_id, rule_id ORDER BY {_SEV}, cost DESC, finding_id) AS r FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY {_SEV}, cost DESC, finding_id) AS place FROM o WHERE r = 1) SELECT resume_id, place, rule_id, finding_id FROM p WHERE place <= {TOP}""",
    "report_groups_by_gate": f"""WITH {_C}, o AS (SELECT *, row_number() OVER (PARTITION BY resume_id, gate, rule_id ORDER BY cost DESC, finding_id) AS r FROM c)
SELECT resume_id, gate, rule_id, count(*) AS instances, CAST(sum(cost) AS BIGINT) AS total, min(finding_id) FILTER (r = 1) AS lead FROM o GROUP BY 1, 2, 3""",
    "report_rule_counts": f"WITH {_F} SELECT rule_id, count(*) AS findings, count(DISTINCT resume_id) AS resumes FROM f GROUP BY 1",
    "report_rollup": f"WITH {_F} SELECT gate, category, severity, CAST(grouping(gate, category, severity) AS BIGINT) AS level, count(*) AS findings FROM f GROUP BY ROLLUP (gate, category, severity)",
    "report_markdown": f"WITH {_L} SELECT resume_id, string_agg('- ' || label || ': ' || cost, chr(10) ORDER BY ord, label) AS markdown FROM l GROUP BY 1",
    "union_first_wins": f"WITH {_F} SELECT resume_id, rule_id, locator_path, min(finding_id) AS finding_id, count(*) AS merged FROM f WHERE locator_path <> '' GROUP BY 1, 2, 3",
}
ORACLES["report_html"] = f"WITH {_L} SELECT resume_id, '<ul>' || string_agg('<li>' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' <b>' || cost || '</b></li>', '' ORDER BY ord, label) || '</ul>' AS html FROM l GROUP BY 1"
ORACLES["report_fixed_width"] = f"WITH {_C}, s AS (SELECT rule_id, count(DISTINCT resume_id) AS docs, CAST(sum(cost) AS BIGINT) AS cost FROM c GROUP BY 1) SELECT rule_id, rpad(rule_id, 30, ' ') || lpad(CAST(docs AS VARCHAR), 8, ' ') || lpad(CAST(cost AS VARCHAR), 12, ' ') AS line FROM s"
ORACLES["report_ranked"] = f"WITH {_C} SELECT resume_id, finding_id, row_number() OVER (PARTITION BY resume_id ORDER BY {_SEV}, cost DESC, finding_id) AS place FROM c"
ORACLES["prompt_assembled"] = f"""WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY {_SEV}, finding_id) AS r FROM f), g AS (SELECT resume_id, string_agg(concat_ws(' ', '-', rule_id, evidence), chr(10) ORDER BY r) AS f, count(*) AS findings FROM r WHERE r <= 40 GROUP BY 1),
p AS (SELECT t.resume_id, left(text, 12000) || chr(10) || chr(10) || 'FINDINGS' || chr(10) || coalesce(f, '') AS p, coalesce(findings, 0) AS findings FROM (SELECT DISTINCT resume_id, text FROM resumes WHERE text IS NOT NULL) t LEFT JOIN g ON g.resume_id = t.resume_id) SELECT resume_id, md5(p) AS digest, length(p) AS chars, findings FROM p"""
