"""Queries over the star schema and across tables: intervals, gaps, layout shapes, manifests, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import judging as J
from tallyforge.operators import segments as G
from tallyforge.operators.intervals import latest_rows, periods_and_gaps
from tallyforge.sources.tables import table

#: Months an order counts as an interval; months from which a gap counts; hundredths of a page that are its edge.
SPAN, GAP = 3, 6


def _months(a: str, b: str):
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    day = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", day.alias("s"), F.add_months(day, SPAN).alias("e"))


def interval_merge_months(spark: SparkSession, folder: str) -> DataFrame:
    """Months covered by each customer's orders, overlaps counted once."""
    spans = periods_and_gaps(_spans(spark, folder), ["o_custkey"], "s", "e").filter("kind = 'period'")
    return spans.groupBy("o_custkey").agg(F.count("*").alias("periods"), F.sum(_months("from_at", "to_at")).alias("months"))


def interval_gaps_chunked(spark: SparkSession, folder: str) -> DataFrame:
    """The same gaps with the running maximum carried over yearly chunks."""
    spans = periods_and_gaps(_spans(spark, folder), ["o_custkey"], "s", "e", chunk="year").filter("kind = 'gap'")
    return spans.select("o_custkey", F.col("from_at").cast("date").alias("from_at"), F.col("to_at").cast("date").alias("to_at"))


def rule_employment_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Roles that start six months or more after the end of the one before, in order of start."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", "start_date", "end_date")
    valid = latest_rows(roles, ["resume_id", "role_ix"], ["parsed_at"], ["start_date", "end_date"]).filter("start_date IS NOT NULL AND end_date IS NOT NULL")
    w = Window.partitionBy("resume_id").orderBy("start_date", "end_date", "role_ix")
    before = valid.withColumn("prev_end", F.lag("end_date").over(w))
    return before.select("resume_id", "role_ix", _months("prev_end", "start_date").alias("months")).filter(F.col("months") >= GAP)


def rule_reverse_chron_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of each customer, by key, that is dated before the one ahead of it."""
    orders = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return orders.withColumn("p", F.lag("o_orderdate").over(w)).filter("o_orderdate < p").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


def years_experience(spark: SparkSession, folder: str) -> DataFrame:
    """Years of each résumé's merged dated roles, one decimal, open roles as of a given day."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", "start_date", "end_date", "is_current")
    valid = latest_rows(roles, ["resume_id", "role_ix"], ["parsed_at"], ["start_date", "end_date", "is_current"])
    today = F.lit("2026-07-01").cast("date")
    end = F.when(F.coalesce("is_current", F.lit(False)), today).otherwise(F.col("end_date"))
    spans = periods_and_gaps(valid.withColumn("end_date", end), ["resume_id"], "start_date", "end_date").filter("kind = 'period'")
    return spans.groupBy("resume_id").agg(F.sum(_months("from_at", "to_at")).alias("months")).select("resume_id", "months", F.bround(F.col("months") / 12, 1).alias("years"))


def rule_count_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Roles with one bullet (thin) or more than four (bloated)."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", "bullets")
    valid = latest_rows(roles, ["resume_id", "role_ix"], ["parsed_at"], ["bullets"]).withColumn("n", F.size("bullets").cast("long"))
    return valid.select("resume_id", "role_ix", "n", F.when(F.col("n") == 1, "thin").when(F.col("n") > 4, "bloated").alias("finding")).filter("finding IS NOT NULL")


def layout_largest_gap(spark: SparkSession, folder: str) -> DataFrame:
    """The widest gap between neighbouring values of each user's events."""
    x = F.round(F.col("value") * 100).cast("long")
    return G.largest_gap(table(spark, folder, "events", "user_id", "value").select("user_id", x.alias("x")), "user_id", "x")


def layout_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of three or more events of one type of a user."""
    runs = G.runs(table(spark, folder, "events", "user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return runs.filter("length >= 3").select("user_id", F.col("value").alias("event_type"), "first", "length")


def layout_edge_share(spark: SparkSession, folder: str) -> DataFrame:
    """Text in the first and last twentieth of a document's lines, by characters."""
    lines = T.lines(F.col("text"))
    n = F.size(lines)
    edge = F.ceil(n / 20).cast("int")
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    rows = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return rows.select("doc_id", (chars(F.slice(lines, F.lit(1), edge)) + chars(F.slice(lines, n - edge + 1, edge))).alias("edge_chars"), chars(lines).alias("all_chars"))


def seg_first_seen_order(spark: SparkSession, folder: str) -> DataFrame:
    """Types of event of each user in the order first seen."""
    first = table(spark, folder, "events", "user_id", "event_type", "ts", "event_id").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ">").alias("types"))


def quote_in_haystack(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that stands word for word in its résumé, by where it begins."""
    f = table(spark, folder, "findings", "finding_id", "resume_id", "evidence").distinct().filter(F.length(T.stripped(F.col("evidence"))) > 0)
    quote = F.regexp_replace("evidence", r"^(?:> |Line: |“)|”$", "")
    texts = table(spark, folder, "resumes", "resume_id", "text").distinct()
    return f.withColumn("q", quote).join(texts, "resume_id").select("finding_id", F.expr("locate(q, text)").cast("long").alias("place")).filter("place > 0")


def locator_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Findings whose locator, or else what stands before its first colon, names a bullet of their résumé."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", "bullets")
    valid = latest_rows(roles, ["resume_id", "role_ix"], ["parsed_at"], ["bullets"])
    places = G.located_bullets(valid, "resume_id", "role_ix", "bullets").select("resume_id", F.col("locator").alias("locator_path"))
    f = table(spark, folder, "findings", "finding_id", "resume_id", "locator_path").distinct()
    tried = f.select("finding_id", "resume_id", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("o"), F.col("locator_path").alias("l")), F.struct(F.lit(1).alias("o"), F.split_part("locator_path", F.lit(":"), F.lit(1)).alias("l"))))).alias("x")).select("finding_id", "resume_id", "x.o", F.col("x.l").alias("locator_path"))
    return tried.join(places, ["resume_id", "locator_path"], "left_semi").groupBy("finding_id").agg(F.min_by("locator_path", "o").alias("locator_path"))


def manifest_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Roles as parsed up to the end of 2024 against as parsed last: new, changed and carried, by digest."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", "start_date", "end_date")
    digest = T.sha_hex(F.concat_ws("|", F.coalesce(F.col("start_date").cast("string"), F.lit("-")), F.coalesce(F.col("end_date").cast("string"), F.lit("-"))))
    keys = ["resume_id", "role_ix"]
    last = lambda rows: latest_rows(rows, keys, ["parsed_at"], ["start_date", "end_date"]).select(*keys, digest.alias("digest"))
    frozen = last(roles.filter(F.col("parsed_at") < F.lit("2025-01-01").cast("timestamp_ntz")))
    return J.compared(frozen, last(roles), keys, "digest").select(*keys, "status")


def sidebyside_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Rules under two sources of findings: counts of each and whether carried, changed, gone or new."""
    f = table(spark, folder, "findings", "finding_id", "rule_id", "finding_source").distinct().filter("rule_id IS NOT NULL")
    sides = [f.filter(F.col("finding_source") == s).groupBy("rule_id").agg(F.count("*").alias("n")) for s in ("deterministic", "judge-ash")]
    return J.compared(*sides, ["rule_id"], "n")


def text_dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence lines that differ in case only, the smallest finding standing for each."""
    f = table(spark, folder, "findings", "finding_id", "evidence").distinct().filter(F.coalesce("evidence", F.lit("")).rlike(r"\S"))
    return f.groupBy(F.md5(F.lower(T.stripped(F.col("evidence")))).alias("digest")).agg(F.min("finding_id").alias("finding_id"), F.count("*").alias("lines"))


def upload_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Why a document's bytes would be refused: none, too many, or no capital or mark in front."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    reason = F.when(n == 0, "empty").when(n > 12_000, "too large").when(~F.col("text").rlike("^[A-ZÀ-Ý“]"), "unknown start")
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", n.cast("long").alias("bytes"), reason.alias("reason")).filter("reason IS NOT NULL")


def props_salvaged(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the events' JSON, whatever stands around it."""
    cleaned = T.salvaged_json(F.concat(F.lit("reply: "), F.col("props"), F.lit(" end")))
    keys = F.json_object_keys(cleaned)
    return table(spark, folder, "events", "event_id", "props").select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"))


def settings_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of each market segment: a base block under the segment's own."""
    base = F.create_map(F.lit("rounds"), F.lit("3"), F.lit("effort"), F.lit("low"))
    own = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.create_map(F.lit("effort"), F.lit("high"))).otherwise(F.create_map(F.lit("cap"), F.lit("9")))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    rows = table(spark, folder, "customer", "c_mktsegment").distinct()
    return rows.select("c_mktsegment", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda x: F.concat_ws("=", x["key"], x["value"]))), ";").alias("settings"))


def argmin_provider(spark: SparkSession, folder: str) -> DataFrame:
    """For each résumé the provider that replied first, ties to the name."""
    j = table(spark, folder, "judgments", "resume_id", "provider", "judged_at").distinct()
    return j.groupBy("resume_id").agg(F.min_by("provider", F.struct("judged_at", "provider")).alias("provider"))


def hashed_layout(spark: SparkSession, folder: str) -> DataFrame:
    """A choice of three that depends on a document's name alone."""
    return table(spark, folder, "resumes", "doc_name").distinct().filter("doc_name IS NOT NULL").select("doc_name", T.hashed_choice(F.col("doc_name"), 3).alias("layout"))


def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens a document may take at three characters each, in all per source."""
    n = F.ceil(F.length("text") / 3)
    return table(spark, folder, "documents", "source", "text").groupBy("source").agg(F.sum(n).alias("tokens"), F.max(n).alias("largest"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_merge_months, interval_gaps_chunked, rule_employment_gap, rule_reverse_chron_first, years_experience, rule_count_bounds, layout_largest_gap, layout_runs,
        layout_edge_share, seg_first_seen_order, quote_in_haystack, locator_resolved, manifest_full_outer, sidebyside_full_outer, text_dedupe_first, upload_validation,
        props_salvaged, settings_overlay, argmin_provider, hashed_layout, token_estimate,
    )
}

_O = f"""o AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS s, CAST(date_trunc('month', o_orderdate) + INTERVAL {SPAN} MONTH AS DATE) AS e FROM orders),
pe AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o),
il AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM pe),
sp AS (SELECT o_custkey, i, min(s) AS f, max(e) AS t FROM il GROUP BY 1, 2)"""
_V = """lt AS (SELECT resume_id, role_ix, max(parsed_at) AS parsed_at FROM resume_roles GROUP BY 1, 2),
v AS (SELECT DISTINCT r.resume_id, r.role_ix, r.start_date, r.end_date, r.is_current, r.bullets FROM resume_roles r JOIN lt USING (resume_id, role_ix, parsed_at))"""
_LN = r"string_split_regex(text, '\r\n|\n|\r')"
_M = lambda a, b: f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"

ORACLES = {
    "interval_merge_months": f"WITH {_O} SELECT o_custkey, count(*) AS periods, CAST(sum({_M('f', 't')}) AS BIGINT) AS months FROM sp GROUP BY 1",
    "interval_gaps_chunked": f"WITH {_O}, n AS (SELECT *, lead(f) OVER (PARTITION BY o_custkey ORDER BY f) AS nf FROM sp) SELECT o_custkey, t AS from_at, nf AS to_at FROM n WHERE nf IS NOT NULL",
    "rule_employment_gap": f"""WITH {_V}, p AS (SELECT *, lag(end_date) OVER (PARTITION BY resume_id ORDER BY start_date, end_date, role_ix) AS pe FROM v WHERE start_date IS NOT NULL AND end_date IS NOT NULL)
SELECT resume_id, role_ix, {_M('pe', 'start_date')} AS months FROM p WHERE {_M('pe', 'start_date')} >= {GAP}""",
    "rule_reverse_chron_first": "WITH p AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM p WHERE o_orderdate < p GROUP BY 1",
    "years_experience": f"""WITH {_V}, u AS (SELECT resume_id, start_date AS s, CASE WHEN coalesce(is_current, false) THEN DATE '2026-07-01' ELSE end_date END AS e FROM v),
pe AS (SELECT *, max(e) OVER (PARTITION BY resume_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM u WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s),
il AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM pe), sp AS (SELECT resume_id, i, min(s) AS f, max(e) AS t FROM il GROUP BY 1, 2),
m AS (SELECT resume_id, CAST(sum({_M('f', 't')}) AS BIGINT) AS months FROM sp GROUP BY 1) SELECT resume_id, months, round_even(months / 12.0::DOUBLE, 1) AS years FROM m""",
    "rule_count_bounds": f"WITH {_V} SELECT * FROM (SELECT resume_id, role_ix, len(bullets) AS n, CASE WHEN len(bullets) = 1 THEN 'thin' WHEN len(bullets) > 4 THEN 'bloated' END AS finding FROM v) WHERE finding IS NOT NULL",
    "layout_largest_gap": """WITH x AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS x FROM events), g AS (SELECT user_id, x AS left_x, lead(x) OVER (PARTITION BY user_id ORDER BY x) - x AS gap FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, left_x) AS r FROM g WHERE gap IS NOT NULL) SELECT user_id, left_x, gap FROM r WHERE r = 1""",
    "layout_runs": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, any_value(event_type) AS event_type, min(n) AS first, count(*) AS length FROM r GROUP BY user_id, run HAVING count(*) >= 3""",
    "layout_edge_share": f"""WITH l AS (SELECT doc_id, {_LN} AS l FROM documents WHERE text IS NOT NULL), n AS (SELECT *, len(l) AS n, CAST(ceil(len(l) / 20.0) AS BIGINT) AS e FROM l)
SELECT doc_id, CAST(list_sum(list_transform(l[1:e], lambda x: length(x))) + list_sum(list_transform(l[n - e + 1:n], lambda x: length(x))) AS BIGINT) AS edge_chars, CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT) AS all_chars FROM n""",
    "seg_first_seen_order": """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, event_type, min(n) AS n FROM r GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, '>' ORDER BY n) AS types FROM f GROUP BY 1""",
    "quote_in_haystack": r"""WITH f AS (SELECT DISTINCT finding_id, resume_id, evidence FROM findings WHERE regexp_matches(coalesce(evidence, ''), '[^\s\x{a0}]')), t AS (SELECT DISTINCT resume_id, text FROM resumes)
SELECT * FROM (SELECT finding_id, strpos(text, regexp_replace(evidence, '^(?:> |Line: |“)|”$', '', 'g')) AS place FROM f JOIN t USING (resume_id)) WHERE place > 0""",
    "locator_resolved": f"""WITH {_V}, b AS (SELECT resume_id, 'exp[' || role_ix || '].bullet[' || unnest(generate_series(0, len(bullets) - 1)) || ']' AS locator_path FROM v),
t AS (SELECT DISTINCT finding_id, resume_id, o, l FROM (SELECT finding_id, resume_id, 0 AS o, locator_path AS l FROM findings UNION ALL SELECT finding_id, resume_id, 1, split_part(locator_path, ':', 1) FROM findings))
SELECT finding_id, arg_min(l, o) AS locator_path FROM t WHERE (resume_id, l) IN (SELECT resume_id, locator_path FROM b) GROUP BY 1""",
    "manifest_full_outer": """WITH r AS (SELECT DISTINCT resume_id, role_ix, parsed_at, sha256(coalesce(CAST(start_date AS VARCHAR), '-') || '|' || coalesce(CAST(end_date AS VARCHAR), '-')) AS h, start_date, end_date FROM resume_roles),
a AS (SELECT *, row_number() OVER (PARTITION BY resume_id, role_ix ORDER BY parsed_at DESC, start_date DESC NULLS LAST, end_date DESC NULLS LAST) AS n FROM r WHERE parsed_at < TIMESTAMP '2025-01-01'),
b AS (SELECT *, row_number() OVER (PARTITION BY resume_id, role_ix ORDER BY parsed_at DESC, start_date DESC NULLS LAST, end_date DESC NULLS LAST) AS n FROM r)
SELECT b.resume_id, b.role_ix, CASE WHEN a.h IS NULL THEN 'new' WHEN a.h = b.h THEN 'carried' ELSE 'changed' END AS status FROM b LEFT JOIN a ON a.resume_id = b.resume_id AND a.role_ix = b.role_ix AND a.n = 1 WHERE b.n = 1""",
    "sidebyside_full_outer": """WITH f AS (SELECT DISTINCT finding_id, rule_id, finding_source FROM findings WHERE rule_id IS NOT NULL), a AS (SELECT rule_id, count(*) AS n FROM f WHERE finding_source = 'deterministic' GROUP BY 1), b AS (SELECT rule_id, count(*) AS n FROM f WHERE finding_source = 'judge-ash' GROUP BY 1)
SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, a.n AS old, b.n AS new, CASE WHEN b.rule_id IS NULL THEN 'gone' WHEN a.rule_id IS NULL THEN 'new' WHEN a.n = b.n THEN 'carried' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.rule_id = b.rule_id""",
    "text_dedupe_first": r"""SELECT md5(lower(regexp_replace(evidence, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'))) AS digest, min(finding_id) AS finding_id, count(*) AS lines FROM (SELECT DISTINCT finding_id, evidence FROM findings WHERE regexp_matches(coalesce(evidence, ''), '\S')) GROUP BY 1""",
    "upload_validation": """SELECT * FROM (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 'empty' WHEN strlen(text) > 12000 THEN 'too large' WHEN NOT regexp_matches(text, '^[A-ZÀ-Ý“]') THEN 'unknown start' END AS reason FROM documents) WHERE reason IS NOT NULL""",
    "props_salvaged": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "settings_overlay": "SELECT DISTINCT c_mktsegment, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'effort=high;rounds=3' ELSE 'cap=9;effort=low;rounds=3' END AS settings FROM customer",
    "argmin_provider": "WITH r AS (SELECT DISTINCT resume_id, provider, judged_at FROM judgments), n AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY judged_at NULLS FIRST, provider) AS n FROM r) SELECT resume_id, provider FROM n WHERE n = 1",
    "hashed_layout": "SELECT DISTINCT doc_name, CAST(CAST('0x' || substr(sha256(doc_name), 1, 8) AS BIGINT) % 3 AS INTEGER) AS layout FROM resumes WHERE doc_name IS NOT NULL",
    "token_estimate": "SELECT source, CAST(sum(ceil(length(text) / 3.0::DOUBLE)) AS BIGINT) AS tokens, CAST(max(ceil(length(text) / 3.0::DOUBLE)) AS BIGINT) AS largest FROM documents GROUP BY 1",
}
