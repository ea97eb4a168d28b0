"""Findings of the rule families over résumés, each a frame of the same shape, united by name.

A finding: (resume_id, rule_id, severity, locator, evidence). Severities follow each rule; heuristic ones are minor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import claims as C
from tallyforge.functions import text as T
from tallyforge.operators import packed, segments
from tallyforge.operators.intervals import latest_rows, periods_and_gaps
from tallyforge.plans import claims as Q
from tallyforge.plans.documents import _SEC, _VALID, SECTIONS, _bullets
from tallyforge.session import once
from tallyforge.sources.tables import table

#: Bounds of the structure rules, and the day on which open roles are measured.
BULLETS_LEAST, BULLETS_MOST, BULLET_WORDS, GAP_MONTHS, QUANTIFIED, TODAY = 2, 8, 30, 6, 0.5, "2026-07-01"
#: Contact details in a header; hosts of the profile sites may have any ending. Fixed values.
CONTACT = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "phone": r"(?:\+?\d{1,2}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "linkedin": r"(?i)linkedin\.[a-z]+/[\w/-]+",
    "github": r"(?i)github\.[a-z]+/[\w/-]+",
    "place": r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*,\s*[A-Z]{2}\b",
}
URL = r"(?i)(?:https?://|www\.)[\w./-]+"
PLACE_LINE = r"^[A-Z][a-z]+(?:\s[A-Z][a-z]+)*,\s*[A-Z][a-z]+(?:\s[A-Z][a-z]+)*$|(?i:\bremote\b|relocat)"
DATES = r"(?i)(?:[a-z]{3,9}\.? )?(?:\d{1,2}/)?(?:19|20)\d\d\s*(?:-|–|—|to|until)\s*(?:(?:[a-z]{3,9}\.? )?(?:\d{1,2}/)?(?:19|20)\d\d|present|current|now)"
HEADER_LINES, HEADLINE_LINES = 6, 4
#: Patterns of the bullet and title rules. Fixed values.
WEAK = r"(?i)^\s*(?:responsible for|worked on|helped (?:to|with)?|assisted (?:with|in)?|participated in|involved in|tasked with|duties includ|contributed to)\b"
PASSIVE = r"(?i)\b(?:was|were|been|being)\s+\w+(?:ed|en)\b"
FIRST_PERSON = r"(?i)(?:^|\s)(?:I|my|me)\b"
TEAM_SUBJECT = r"(?i)^\s*(?:we|our team|the team)\b"
JUNIOR = r"(?i)\b(?:junior|jr\.?|associate|intern|trainee|entry[- ]level)\b"
AI_TITLE = r"(?i)\b(?:ai|ml|machine learning|deep learning|research|data scien|mlops|nlp|applied scien|llm)\b"
PIVOT = "ai|ml|machine learning|data|research"
EVALUATED = r"(?i)\b(?:eval(?:uation|s)?|benchmark|accuracy|precision|recall|f1|auc|roc|bleu|rouge|perplexity|held[- ]out|test set|ground truth|labell?ed|annotat|a/b test|offline metric|groundedness|hallucination rate)\b"
PRODUCTION = r"(?i)\b(?:production|prod|deployed|shipped|serving|live|users?|customers?|traffic|uptime|sla|slo|on[- ]call|incident|p9\d|qps|rps|throughput|latency|rollout|canary|req/min|requests per second)\b"
NOTEBOOK = r"(?i)\b(?:jupyter|notebook|colab|kaggle|coursework|class project|tutorial|bootcamp|proof of concept|poc)\b"
IDENTITY = r"(?i)\b(?:ai|ml|machine learning|deep learning|software|data|research|mlops|nlp)\s+(?:engineer|scientist|developer|researcher)\b"
SOFT = r"(?i)\b(?:communication|teamwork|leadership|problem solving|detail oriented|hard working|self motivated|team player|time management|on-call)\b"
CYCLES = (("built", "created", "developed", "engineered", "constructed", "crafted"), ("improved", "enhanced", "optimized", "refined", "elevated", "boosted"), ("led", "spearheaded", "drove", "orchestrated", "championed"))
SKILLS_MOST, REPEATS_MOST, UNSUPPORTED_LEAST = 25, 6, 4

COLUMNS = ("resume_id", "rule_id", "severity", "locator", "evidence")


def _finding(df: DataFrame, rule, severity, locator, evidence) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("resume_id", lit(rule).alias("rule_id"), lit(severity).alias("severity"), lit(locator).alias("locator"), lit(evidence).cast("string").alias("evidence"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (resume_id, text, header, summary, heads): header lines, summary text and the sections' names in order."""
    rows = once(table(spark, folder, "resumes", "resume_id", "text"), "resume_id").filter("text IS NOT NULL")
    lines = T.lines(F.col("text"))
    part = F.transform(lines, lambda x: segments.section_heading(x, SECTIONS))
    rows = rows.select("resume_id", "text", lines.alias("l"), part.alias("p"))
    first = F.coalesce(F.nullif(F.array_position(F.transform("p", lambda x: x.isNotNull()), True), F.lit(0)), F.size("l") + 1)
    heads = F.array_distinct(F.filter("p", lambda x: x.isNotNull()))
    at = F.array_position(F.transform("p", lambda x: F.coalesce(x, F.lit(""))), "summary")
    after = F.slice("p", F.col("at") + 1, F.size("p"))
    ends = F.coalesce(F.nullif(F.array_position(F.transform(after, lambda x: x.isNotNull()), True), F.lit(0)) - 1, F.size(after))
    out = rows.select("*", first.alias("first"), heads.alias("heads"), at.cast("int").alias("at"))
    summary = F.when(F.col("at") > 0, F.slice("l", F.col("at") + 1, ends.cast("int"))).otherwise(F.array().cast("array<string>"))
    told = F.array_join(F.filter(F.transform(summary, T.stripped), lambda x: x != ""), " ")
    return out.select("resume_id", "text", F.slice("l", F.lit(1), (F.col("first") - 1).cast("int")).alias("header"), told.alias("summary"), "heads")


def _contacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder)
    blob = F.when(F.size("header") > 0, F.array_join(F.slice("header", 1, HEADER_LINES), "\n")).otherwise(F.substring("text", 1, 400))
    site = F.coalesce(F.get(F.filter(F.regexp_extract_all(blob, F.lit(URL), F.lit(0)), lambda u: ~F.lower(u).rlike("linkedin|github")), F.lit(0)), F.lit(""))
    return rows.select("resume_id", *(F.regexp_extract(blob, p, 0).alias(k) for k, p in CONTACT.items()), site.alias("website"))


def contact_details(spark: SparkSession, folder: str) -> DataFrame:
    """First address, number, profiles, place and site in the first six lines of a résumé's header; the first 400
    characters where there is none; empty if absent."""
    return _contacts(spark, folder)


def contact_headline(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of a résumé, or else the second of its header lines without contact details; none if the header has
    more than four such lines or a range of dates."""
    rows = _texts(spark, folder)
    lines = F.filter(F.transform("header", T.stripped), lambda x: x != "")
    detail = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in (*CONTACT.values(), URL, PLACE_LINE)])
    plain = F.filter(lines, lambda x: ~detail(x))
    fallback = F.when((F.size(plain) > HEADLINE_LINES) | F.exists(lines, lambda x: x.rlike(DATES)), "").otherwise(F.coalesce(F.get(plain, F.lit(1)), F.lit("")))
    return rows.select("resume_id", F.when(F.col("summary") != "", F.col("summary")).otherwise(fallback).alias("told")).filter("told <> ''")


def rules_contact(spark: SparkSession, folder: str) -> DataFrame:
    """Contact details a header lacks."""
    lacks = F.array_compact(F.array(*(F.when(F.col(k) == "", f"contact/no-{k}") for k in ("email", "phone", "linkedin", "github"))))
    rows = _contacts(spark, folder).select("resume_id", F.explode(lacks).alias("r"))
    return _finding(rows, F.col("r"), "minor", "header", "header")


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    cols = ("heading", "title", "company", "subtitle", "start_date", "end_date", "is_current", "bullets")
    return latest_rows(table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", *cols), ["resume_id", "role_ix"], ["parsed_at"], list(cols))


def rules_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Missing sections and dates, thin and bloated roles, order and gaps of roles."""
    texts, roles = _texts(spark, folder), _roles(spark, folder)
    wanted = F.array_except(F.array(*map(F.lit, ("education", "experience", "skills"))), F.col("heads"))
    gone = texts.select("resume_id", F.explode(wanted).alias("s"))
    at, n = F.format_string("exp[%d]", F.col("role_ix")), F.size("bullets")
    parts = [
        _finding(gone, F.concat(F.lit("struct/missing-"), "s"), "major", "document", F.col("s")),
        _finding(roles.filter("start_date IS NULL"), "struct/missing-dates", "major", at, F.substring("heading", 1, 80)),
        _finding(roles.filter((n > 0) & (n < BULLETS_LEAST)), "struct/thin-role", "minor", at, F.substring("heading", 1, 80)),
        _finding(roles.filter(n > BULLETS_MOST), "struct/bloated-role", "minor", at, F.substring("heading", 1, 80)),
    ]
    dated = F.array_sort(F.collect_list(F.when(F.col("start_date").isNotNull(), F.struct("role_ix", "start_date"))))
    ordered = roles.groupBy("resume_id").agg(dated.alias("d"))
    later = F.filter(F.transform("d", lambda x, i: F.when((i > 0) & (x["start_date"] > F.get("d", i - 1)["start_date"]), x["role_ix"])), lambda x: x.isNotNull())
    parts.append(_finding(ordered.withColumn("v", F.get(later, F.lit(0))).filter("v IS NOT NULL"), "struct/not-reverse-chron", "minor", "experience", F.col("v")))
    today = F.lit(TODAY).cast("date")
    spans = roles.withColumn("end_date", F.when(F.coalesce("is_current", F.lit(False)), today).otherwise(F.col("end_date")))
    gaps = periods_and_gaps(spans, ["resume_id"], "start_date", "end_date").filter("kind = 'gap'")
    months = (F.year("to_at") - F.year("from_at")) * 12 + F.month("to_at") - F.month("from_at")
    parts.append(_finding(gaps.filter(months >= GAP_MONTHS), "struct/employment-gap", "minor", "experience", F.concat_ws("/", F.col("from_at").cast("string"), F.col("to_at").cast("string"))))
    return reduce(DataFrame.unionByName, parts)


def rules_title(spark: SparkSession, folder: str) -> DataFrame:
    """The first role's title: outside the field, or junior after two and a half years."""
    roles = _roles(spark, folder)
    first = roles.groupBy("resume_id").agg(F.min_by(F.coalesce(F.nullif("title", F.lit("")), "heading"), "role_ix").alias("t"))
    end = F.when(F.coalesce("is_current", F.lit(False)), F.lit(TODAY).cast("date")).otherwise(F.col("end_date"))
    spans = periods_and_gaps(roles.withColumn("end_date", end), ["resume_id"], "start_date", "end_date").filter("kind = 'period'")
    months = spans.groupBy("resume_id").agg(F.sum((F.year("to_at") - F.year("from_at")) * 12 + F.month("to_at") - F.month("from_at")).alias("m"))
    both = first.join(months, "resume_id", "left").filter("t IS NOT NULL")
    junior = F.col("t").rlike(JUNIOR) & (F.coalesce(F.bround(F.col("m") / 12, 1), F.lit(0.0)) >= 2.5)
    return _finding(both.filter(~F.col("t").rlike(AI_TITLE)), "title/off-domain", "major", "exp[0]", F.substring("t", 1, 80)).unionByName(_finding(both.filter(junior), "title/seniority-mismatch", "minor", "exp[0]", F.substring("t", 1, 80)))


def rules_bullets(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets without outcome, weak openers, passives, the team as subject, first person, long ones."""
    b = F.col("bullet")
    told = F.substring(b, 1, 80)
    checks = [
        ("content/no-outcome", "major", ~C.invariants(b)["outcome"], told), ("content/weak-opener", "minor", b.rlike(WEAK), told), ("content/passive-voice", "minor", b.rlike(PASSIVE), F.regexp_extract(b, PASSIVE, 0)),
        ("content/ownership", "major", b.rlike(TEAM_SUBJECT), told), ("content/first-person", "minor", b.rlike(FIRST_PERSON), told), ("content/long-bullet", "minor", F.size(T.words(b)) > BULLET_WORDS, told),
    ]
    hits = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), e.alias("e"))) for r, s, test, e in checks)))
    rows = _bullets(spark, folder).filter("bullet IS NOT NULL").select("resume_id", "locator", F.explode(hits).alias("h"))
    return _finding(rows, F.col("h.r"), F.col("h.s"), F.col("locator"), F.col("h.e"))


def rules_quantification(spark: SparkSession, folder: str) -> DataFrame:
    """Résumés fewer than half of whose bullets carry a measurable result; advice only."""
    per = _bullets(spark, folder).groupBy("resume_id").agg(F.count("*").alias("n"), F.count_if(C.has_metric(F.col("bullet"))).alias("q"))
    return _finding(per.filter(F.col("q") < QUANTIFIED * F.col("n")), "content/quantification", "major", "experience", F.concat_ws("/", "q", "n"))


def rules_slop(spark: SparkSession, folder: str) -> DataFrame:
    """Empty phrases in bullets and summaries, portable bullets, rotating synonyms; each once a place."""
    b = F.col("bullet")
    bullets = _bullets(spark, folder).filter("bullet IS NOT NULL")
    found = bullets.select("resume_id", "locator", F.explode(C.slop_hits(b, "bullet")).alias("h"))
    told = _texts(spark, folder).filter("summary <> ''")
    in_summary = told.select("resume_id", F.lit("summary").alias("locator"), F.explode(F.concat(C.slop_hits(F.col("summary"), "summary"), C.slop_hits(F.col("summary"), "bullet"))).alias("h"))
    hits = found.unionByName(in_summary).groupBy("resume_id", "locator", F.col("h.rule").alias("r"), F.col("h.severity").alias("s"), F.lower("h.hit").alias("e")).count()
    portable = bullets.filter((C.portability(b) > 0.82) & (F.size(T.words(b)) >= 8) & ~C.has_metric(b))
    used = [F.sort_array(F.array_compact(F.array(*(F.max(F.when(F.lower(b).rlike(rf"\b{w}\b"), w)) for w in group)))) for group in CYCLES]
    cycles = bullets.groupBy("resume_id").agg(F.count("*").alias("n"), F.array(*used).alias("u")).filter("n >= 4").select("resume_id", F.explode("u").alias("w")).filter(F.size("w") >= 3)
    return _finding(hits, F.col("r"), F.col("s"), F.col("locator"), F.col("e")).unionByName(_finding(portable, "slop/portable", "major", F.col("locator"), F.substring(b, 1, 120))).unionByName(_finding(cycles, "slop/synonym-cycling", "minor", "experience", F.array_join("w", ", ")))


def rules_credibility(spark: SparkSession, folder: str) -> DataFrame:
    """What no bullet or summary shows: evaluation, production; notebooks alone; a pivot without a bridge; nothing that
    says what one is."""
    b = F.col("bullet")
    per = _bullets(spark, folder).groupBy("resume_id").agg(F.count("*").alias("n"), *(F.coalesce(F.max(b.rlike(p)), F.lit(False)).alias(k) for k, p in (("ev", EVALUATED), ("pr", PRODUCTION), ("nb", NOTEBOOK))))
    told = _texts(spark, folder).select("resume_id", "summary", *(F.col("summary").rlike(p).alias(k) for k, p in (("sev", EVALUATED), ("spr", PRODUCTION), ("snb", NOTEBOOK), ("sid", IDENTITY))))
    both = per.join(told.drop("sid"), "resume_id", "left").fillna(False, ["sev", "spr", "snb"])
    ev, pr, nb = F.col("ev") | F.col("sev"), F.col("pr") | F.col("spr"), F.col("nb") | F.col("snb")
    lacks = F.array_compact(F.array(F.when(~ev, F.struct(F.lit("cred/no-evaluation").alias("r"), F.lit("major").alias("s"))), F.when(~pr, F.struct(F.lit("cred/no-production").alias("r"), F.lit("major").alias("s"))), F.when(nb & ~pr, F.struct(F.lit("cred/notebook-only").alias("r"), F.lit("minor").alias("s")))))
    rows = both.select("resume_id", F.explode(lacks).alias("x"))
    title = F.lower(F.coalesce(F.nullif("title", F.lit("")), "heading"))
    flags = _roles(spark, folder).filter("start_date IS NOT NULL").select("resume_id", F.struct("role_ix", title.rlike(PIVOT).alias("ai")).alias("x"))
    arc = flags.groupBy("resume_id").agg(F.count("*").alias("n"), F.min("x").alias("first"), F.count_if("x.ai").alias("ai")).filter("n >= 2 AND first.ai AND ai = 1")
    silent = told.filter("summary = ''")
    return _finding(rows, F.col("x.r"), F.col("x.s"), "experience", "none").unionByName(_finding(arc, "scan/unexplained-pivot", "minor", "experience", F.col("n"))).unionByName(_finding(silent, "scan/no-summary", "minor", "document", "no summary"))


def rules_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Long lists of skills, soft skills among them, skills that no bullet backs."""
    rows = once(table(spark, folder, "resumes", "resume_id", "skills_text"), "resume_id").filter("skills_text <> ''")
    items = packed.split_packed(rows, "resume_id", "skills_text")
    per = items.groupBy("resume_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("item").rlike(SOFT), F.lower("item")))).alias("soft"))
    dump, soft = per.filter(F.col("n") > SKILLS_MOST), per.filter(F.size("soft") > 0)
    said = _bullets(spark, folder).select("resume_id", F.explode(F.array_distinct(T.tokens(F.col("bullet")))).alias("w")).distinct()
    claimed = items.filter(F.length("item").between(3, 27) & ~F.col("item").rlike(SOFT)).select("resume_id", F.lower("item").alias("item")).distinct()
    words = claimed.select("resume_id", "item", F.explode(F.array_distinct(T.tokens(F.col("item")))).alias("w"))
    unmet = words.join(said, ["resume_id", "w"], "left_anti").select("resume_id", "item").distinct()
    bare = unmet.groupBy("resume_id").agg(F.array_sort(F.collect_list("item")).alias("x")).filter(F.size("x") >= UNSUPPORTED_LEAST)
    return _finding(dump, "kw/skills-dump", "minor", "skills", F.col("n")).unionByName(_finding(soft, "kw/soft-skill-padding", "minor", "skills", F.array_join("soft", ", "))).unionByName(_finding(bare, "kw/unsupported-skills", "minor", "skills", F.array_join("x", ", ")))


FAMILIES = (rules_structure, rules_contact, rules_title, rules_bullets, rules_quantification, rules_slop, rules_credibility, rules_keywords)


def rules_all(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all families but the keywords' (whose values SQL can't split), by rule and severity: how many, over
    how many résumés."""
    every = reduce(DataFrame.unionByName, (f(spark, folder) for f in FAMILIES if f is not rules_keywords))
    return every.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.countDistinct("resume_id").alias("resumes"))


QUERIES = {f.__name__: f for f in (contact_details, contact_headline, *FAMILIES, rules_all)}

_q = Q._q
_TR = r"'^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'"
_TX = f"""{_SEC}, hl AS (SELECT resume_id, list(line ORDER BY line_no) AS header FROM pt WHERE section = 'header' AND h IS NULL GROUP BY 1),
hs AS (SELECT resume_id, list(h) AS heads, min(line_no) FILTER (h = 'summary') AS sat FROM hd WHERE h IS NOT NULL GROUP BY 1),
nx AS (SELECT s.resume_id, s.sat, min(d.line_no) AS nxt FROM hs s LEFT JOIN hd d ON d.resume_id = s.resume_id AND d.h IS NOT NULL AND d.line_no > s.sat GROUP BY 1, 2),
sm AS (SELECT l.resume_id, string_agg(regexp_replace(line, {_TR}), ' ' ORDER BY line_no) AS summary FROM ln l JOIN nx n ON n.resume_id = l.resume_id AND line_no > sat AND (nxt IS NULL OR line_no < nxt) WHERE regexp_replace(line, {_TR}) <> '' GROUP BY 1),
tx AS (SELECT src.resume_id, src.text, coalesce(header, []) AS header, coalesce(summary, '') AS summary, coalesce(heads, []) AS heads FROM src LEFT JOIN hl ON hl.resume_id = src.resume_id LEFT JOIN hs ON hs.resume_id = src.resume_id LEFT JOIN sm ON sm.resume_id = src.resume_id)"""
_CT = f"""{_TX}, bl AS (SELECT resume_id, CASE WHEN len(header) > 0 THEN array_to_string(header[1:{HEADER_LINES}], chr(10)) ELSE left(text, 400) END AS b FROM tx),
ct AS (SELECT resume_id, {', '.join(f"regexp_extract(b, '{p}') AS {k}" for k, p in CONTACT.items())}, coalesce(list_filter(regexp_extract_all(b, '{URL}'), lambda u: NOT regexp_matches(lower(u), 'linkedin|github'))[1], '') AS website FROM bl)"""
_RO = """lt AS (SELECT resume_id, role_ix, max(parsed_at) AS parsed_at FROM resume_roles GROUP BY 1, 2),
ro AS (SELECT DISTINCT r.resume_id, r.role_ix, r.heading, r.title, r.start_date, r.end_date, r.is_current, r.bullets FROM resume_roles r JOIN lt USING (resume_id, role_ix, parsed_at))"""
_SP = f"""{_RO}, us AS (SELECT resume_id, start_date AS s, CASE WHEN coalesce(is_current, false) THEN DATE '{TODAY}' ELSE end_date END AS e FROM ro),
pe AS (SELECT *, max(e) OVER (PARTITION BY resume_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM us WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s),
il AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM pe), sp AS (SELECT resume_id, i, min(s) AS f, max(e) AS t FROM il GROUP BY 1, 2),
gp AS (SELECT *, lead(f) OVER (PARTITION BY resume_id ORDER BY f) AS nf FROM sp)"""
_MO = lambda a, b: f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"
_row = lambda rule, sev, loc, ev, rest: f"SELECT resume_id, {rule} AS rule_id, {sev} AS severity, {loc} AS locator, CAST({ev} AS VARCHAR) AS evidence {rest}"


def _struct() -> str:
    at, ev = "'exp[' || role_ix || ']'", "left(heading, 80)"
    parts = [
        _row("'struct/missing-' || s", "'major'", "'document'", "s", "FROM tx, (VALUES ('education'), ('experience'), ('skills')) v(s) WHERE NOT list_contains(heads, s)"),
        _row("'struct/missing-dates'", "'major'", at, ev, "FROM ro WHERE start_date IS NULL"), _row("'struct/thin-role'", "'minor'", at, ev, f"FROM ro WHERE len(bullets) > 0 AND len(bullets) < {BULLETS_LEAST}"),
        _row("'struct/bloated-role'", "'minor'", at, ev, f"FROM ro WHERE len(bullets) > {BULLETS_MOST}"),
        _row("'struct/not-reverse-chron'", "'minor'", "'experience'", "min(role_ix)", "FROM (SELECT resume_id, role_ix, start_date, lag(start_date) OVER (PARTITION BY resume_id ORDER BY role_ix) AS p FROM ro WHERE start_date IS NOT NULL) WHERE start_date > p GROUP BY resume_id"),
        _row("'struct/employment-gap'", "'minor'", "'experience'", "t || '/' || nf", f"FROM gp WHERE {_MO('t', 'nf')} >= {GAP_MONTHS}"),
    ]
    return " UNION ALL ".join(parts)


_FT = f"ft AS (SELECT resume_id, arg_min(coalesce(nullif(title, ''), heading), role_ix) AS t FROM ro GROUP BY 1), mo AS (SELECT resume_id, sum({_MO('f', 't')}) AS m FROM sp GROUP BY 1), tt AS (SELECT ft.resume_id, t, coalesce(round_even(m / 12.0::DOUBLE, 1), 0) AS y FROM ft LEFT JOIN mo ON mo.resume_id = ft.resume_id WHERE t IS NOT NULL)"
_NW = r"len(list_filter(string_split_regex(b, '[\s\x{a0}]+'), lambda w: w <> ''))"


def _bul() -> str:
    checks = [("no-outcome", "major", "NOT outcome", "left(b, 80)"), ("weak-opener", "minor", f"regexp_matches(b, '{WEAK}')", "left(b, 80)"), ("passive-voice", "minor", f"regexp_matches(b, '{PASSIVE}')", f"regexp_extract(b, '{PASSIVE}')"), ("ownership", "major", f"regexp_matches(b, '{TEAM_SUBJECT}')", "left(b, 80)"), ("first-person", "minor", f"regexp_matches(b, '{FIRST_PERSON}')", "left(b, 80)"), ("long-bullet", "minor", f"{_NW} > {BULLET_WORDS}", "left(b, 80)")]
    return " UNION ALL ".join(_row(f"'content/{r}'", f"'{s}'", "locator", e, f"FROM iv WHERE {c}") for r, s, c, e in checks)


_PORT = f"len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{C.SPECIFIC}', '', 'g'), '{_q(C.UNIT)}', '', 'g'), '{C.NUMBER}', '', 'g'), '{C.CAPITAL}', '', 'g'), '\\w+')) / greatest(len(regexp_extract_all(x, '\\w+')), 1)::DOUBLE"
_SEV_OF = "CASE h.rule " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, (_, s, _p) in C.SLOP.items()) + " END"
_SL = f"""sh AS (SELECT resume_id, locator, unnest({Q._slop('b', 'bullet')}) AS h FROM bb UNION ALL SELECT resume_id, 'summary', unnest(list_concat({Q._slop('summary', 'summary')}, {Q._slop('summary', 'bullet')})) FROM tx WHERE summary <> ''),
xb AS (SELECT *, regexp_replace(b, '{C.MARKED}', 'x', 'g') AS x FROM bb)"""
_SLQ = " UNION ALL ".join(
    ["SELECT DISTINCT resume_id, h.rule AS rule_id, " + _SEV_OF + " AS severity, locator, lower(h.hit) AS evidence FROM sh", _row("'slop/portable'", "'major'", "locator", "left(b, 120)", f"FROM xb WHERE {_PORT} > 0.82 AND {_NW} >= 8 AND NOT m")]
    + [_row("'slop/synonym-cycling'", "'minor'", "'experience'", "array_to_string(list_sort(u), ', ')", "FROM (SELECT resume_id, count(*) AS n, list_filter([" + ", ".join(f"CASE WHEN bool_or(regexp_matches(lower(b), '\\b{w}\\b')) THEN '{w}' END" for w in g) + "], lambda z: z IS NOT NULL) AS u FROM bb GROUP BY 1) WHERE n >= 4 AND len(u) >= 3") for g in CYCLES]
)
_CR = f"""pb AS (SELECT resume_id, count(*) AS n, {', '.join(f"coalesce(bool_or(regexp_matches(bullet, '{p}')), false) AS {k}" for k, p in (('ev', EVALUATED), ('pr', PRODUCTION), ('nb', NOTEBOOK)))} FROM located GROUP BY 1),
cb AS (SELECT pb.resume_id, {', '.join(f"{k} OR coalesce(regexp_matches(summary, '{p}'), false) AS {k}" for k, p in (('ev', EVALUATED), ('pr', PRODUCTION), ('nb', NOTEBOOK)))} FROM pb LEFT JOIN tx ON tx.resume_id = pb.resume_id),
ar AS (SELECT resume_id, count(*) AS n, arg_min(ai, role_ix) AS f, count(*) FILTER (ai) AS a FROM (SELECT resume_id, role_ix, regexp_matches(lower(coalesce(nullif(title, ''), heading)), '{PIVOT}') AS ai FROM ro WHERE start_date IS NOT NULL) GROUP BY 1)"""
_CRQ = " UNION ALL ".join([_row("'cred/no-evaluation'", "'major'", "'experience'", "'none'", "FROM cb WHERE NOT ev"), _row("'cred/no-production'", "'major'", "'experience'", "'none'", "FROM cb WHERE NOT pr"), _row("'cred/notebook-only'", "'minor'", "'experience'", "'none'", "FROM cb WHERE nb AND NOT pr"), _row("'scan/unexplained-pivot'", "'minor'", "'experience'", "n", "FROM ar WHERE n >= 2 AND f AND a = 1"), _row("'scan/no-summary'", "'minor'", "'document'", "'no summary'", "FROM tx WHERE summary = ''")])

ORACLES = {
    "contact_details": f"WITH {_CT} SELECT * FROM ct",
    "contact_headline": f"""WITH {_TX}, hh AS (SELECT resume_id, summary, list_filter(list_transform(header, lambda z: regexp_replace(z, {_TR})), lambda z: z <> '') AS ls FROM tx),
pl AS (SELECT *, list_filter(ls, lambda z: NOT ({' OR '.join(f"regexp_matches(z, '{p}')" for p in (*CONTACT.values(), URL, PLACE_LINE))})) AS p FROM hh)
SELECT * FROM (SELECT resume_id, CASE WHEN summary <> '' THEN summary WHEN len(p) > {HEADLINE_LINES} OR len(list_filter(ls, lambda z: regexp_matches(z, '{DATES}'))) > 0 THEN '' ELSE coalesce(p[2], '') END AS told FROM pl) WHERE told <> ''""",
    "rules_contact": f"WITH {_CT} " + " UNION ALL ".join(_row(f"'contact/no-{k}'", "'minor'", "'header'", "'header'", f"FROM ct WHERE {k} = ''") for k in ("email", "phone", "linkedin", "github")),
    "rules_structure": f"WITH {_TX}, {_SP} {_struct()}",
    "rules_title": f"WITH {_SP}, {_FT} " + _row("'title/off-domain'", "'major'", "'exp[0]'", "left(t, 80)", f"FROM tt WHERE NOT regexp_matches(t, '{AI_TITLE}')") + " UNION ALL " + _row("'title/seniority-mismatch'", "'minor'", "'exp[0]'", "left(t, 80)", f"FROM tt WHERE regexp_matches(t, '{JUNIOR}') AND y >= 2.5"),
    "rules_bullets": f"WITH {Q._I} {_bul()}",
    "rules_quantification": f"WITH {_VALID}, p AS (SELECT resume_id, count(*) AS n, count(*) FILTER ({Q._metric('bullet')}) AS q FROM located GROUP BY 1) " + _row("'content/quantification'", "'major'", "'experience'", "q || '/' || n", f"FROM p WHERE q < {QUANTIFIED} * n"),
    "rules_slop": f"WITH {Q._I}, {_TX.replace('sec AS', 'sec_ AS')}, {_SL} {_SLQ}",
    "rules_credibility": f"WITH {_VALID}, {_TX}, {_RO}, {_CR} {_CRQ}",
}
ORACLES["rules_all"] = "SELECT rule_id, severity, count(*) AS findings, count(DISTINCT resume_id) AS resumes FROM (" + " UNION ALL ".join(f"SELECT * FROM ({ORACLES[f.__name__]})" for f in FAMILIES if f is not rules_keywords) + ") GROUP BY 1, 2"
