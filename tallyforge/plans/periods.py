"""Queries over the roles' intervals and packed skill fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.intervals import latest_rows, periods_and_gaps
from tallyforge.operators.packed import split_packed
from tallyforge.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """A row per unbroken period of work and per gap between neighbouring periods of a résumé."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", "start_date", "end_date", "is_current")
    valid = latest_rows(roles, ["resume_id", "role_ix"], ["parsed_at"], ["start_date", "end_date", "is_current"])
    spans = periods_and_gaps(valid, ["resume_id"], "start_date", "end_date", "is_current")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return spans.select("resume_id", "kind", day("from_at").alias("from_date"), F.when(F.col("is_open"), "open").otherwise(day("to_at")).alias("to_date"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each skill of a résumé's packed field with its position."""
    return split_packed(table(spark, folder, "resumes", "resume_id", "skills_text"), "resume_id", "skills_text").withColumn("item_pos", F.col("item_pos").cast("int"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found}

ORACLES = {
    "p1_found": """
WITH latest AS (
  SELECT resume_id, role_ix, max(parsed_at) AS parsed_at FROM resume_roles GROUP BY 1, 2
), valid AS (
  SELECT DISTINCT r.resume_id, r.role_ix, r.start_date AS s,
    CASE WHEN coalesce(r.is_current, false) THEN DATE '9999-12-31' ELSE r.end_date END AS e
  FROM resume_roles r JOIN latest l ON r.resume_id = l.resume_id AND r.role_ix = l.role_ix AND r.parsed_at = l.parsed_at
), usable AS (
  SELECT * FROM valid WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s
), seen AS (
  SELECT *, max(e) OVER (PARTITION BY resume_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM usable
), islands AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM seen
), periods AS (
  SELECT resume_id, i, min(s) AS f, max(e) AS t FROM islands GROUP BY 1, 2
), following AS (
  SELECT *, lead(f) OVER (PARTITION BY resume_id ORDER BY f) AS nf FROM periods
)
SELECT resume_id, 'period' AS kind, strftime(f, '%Y-%m-%d') AS from_date,
  CASE WHEN t = DATE '9999-12-31' THEN 'open' ELSE strftime(t, '%Y-%m-%d') END AS to_date FROM following
UNION ALL
SELECT resume_id, 'gap', strftime(t, '%Y-%m-%d'), strftime(nf, '%Y-%m-%d') FROM following WHERE nf IS NOT NULL
""",
}
