"""Queries over single sentences: what they claim, empty phrases, rewritten ones ranked, audited and chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import claims as C
from tallyforge.functions import text as T
from tallyforge.plans.documents import _VALID, _bullets
from tallyforge.sources.tables import table


def claim_has_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets with a number that measures something."""
    return _bullets(spark, folder).filter(C.has_metric(F.col("bullet"))).select("resume_id", "locator")


def claim_vacuous_number(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence lines whose only number counts trivia, with that number."""
    f = table(spark, folder, "findings", "finding_id", "message", "evidence").distinct()
    both = F.concat_ws(" with 3 new people: ", F.col("message"), F.col("evidence"))
    return f.select("finding_id", C.vacuous_number(both).alias("number")).filter("number IS NOT NULL")


def claim_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome, measurability, mechanism and ownership of each bullet."""
    return _bullets(spark, folder).filter("bullet IS NOT NULL").select("resume_id", "locator", C.invariants(F.col("bullet")).alias("x")).select("resume_id", "locator", "x.*")


def claim_portability(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each bullet that would fit anybody."""
    return _bullets(spark, folder).filter("bullet IS NOT NULL").select("resume_id", "locator", F.round(C.portability(F.col("bullet")), 6).alias("share"))


def claim_slop_bullets(spark: SparkSession, folder: str) -> DataFrame:
    """Empty phrases in bullets and in documents' lines, protected spans excepted."""
    docs = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    hits = docs.select("doc_id", F.explode(C.slop_hits(F.col("text"), "bullet")).alias("h"))
    return hits.groupBy("doc_id", F.col("h.rule").alias("rule_id"), F.lower("h.hit").alias("hit")).agg(F.count("*").alias("times"))


def claim_slop_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The patterns for summaries, over documents; the same phrase counts once a document."""
    docs = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    hits = docs.select("doc_id", F.explode(C.slop_hits(F.col("text"), "summary")).alias("h"))
    return hits.select("doc_id", F.col("h.rule").alias("rule_id"), F.md5(F.lower("h.hit")).alias("hit")).distinct()


def claim_rank_score(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking score of each bullet."""
    return _bullets(spark, folder).filter("bullet IS NOT NULL").select("resume_id", "locator", C.rank_score(F.col("bullet")).alias("score"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (resume_id, locator, bullet, provider, text): three rewritings of each bullet, by rule: cut at its first
    comma, with a figure added, with its first number and name taken out."""
    b = _bullets(spark, folder).filter("bullet IS NOT NULL").select("resume_id", "locator", "bullet")
    text = F.col("bullet")
    ways = F.array(
        F.struct(F.lit("ash").alias("provider"), F.regexp_replace(text, r"^([^,;]*)[,;].*$", "$1").alias("text")),
        F.struct(F.lit("birch").alias("provider"), F.concat(text, F.lit(", cutting time by 12%")).alias("text")),
        F.struct(F.lit("cedar").alias("provider"), F.regexp_replace(text, r"^(\D*)\d+%?", "$1some").alias("text")),
        F.struct(F.lit("dogwood").alias("provider"), F.concat(F.lit("Reduced the time it took: "), text).alias("text")),
    )
    return b.select("resume_id", "locator", "bullet", F.explode(ways).alias("w")).select("resume_id", "locator", "bullet", "w.provider", "w.text")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    same = T.squeezed_lower(F.col("text")) == T.squeezed_lower(F.col("bullet"))
    c = _candidates(spark, folder).filter((F.col("text") != "") & ~same)
    return c.select("*", C.rank_score(F.col("text")).alias("rank"), C.rank_score(F.col("bullet")).alias("base"), C.audit(F.col("bullet"), F.col("text")).alias("a")).select("resume_id", "locator", "provider", "rank", "base", F.col("a.score").alias("audit"), F.size("a.problems").cast("long").alias("problems"))


def rewrite_audited(spark: SparkSession, folder: str) -> DataFrame:
    """Each rewriting with its ranking and audit scores and how many problems it has."""
    return _judged(spark, folder)


def rewrite_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Rewritings the audit lets through, before anybody says how good they sound."""
    return _judged(spark, folder).filter("problems = 0 AND audit >= 100").select("resume_id", "locator", "provider", "rank")


def rewrite_selected(spark: SparkSession, folder: str, margin: float = 1.0) -> DataFrame:
    """Per bullet the first of its rewritings by rank that beats the original by a margin and is clean, if any; and
    whether the best by rank won by breaking what the audit holds back."""
    j = _judged(spark, folder)
    order = Window.partitionBy("resume_id", "locator").orderBy(F.desc("rank"), "provider")
    ranked = j.withColumn("r", F.row_number().over(order))
    fits = (F.col("rank") >= F.col("base") + margin) & (F.col("audit") >= 100) & (F.col("problems") == 0)
    out = ranked.groupBy("resume_id", "locator").agg(F.min_by("provider", F.when(fits, F.col("r"))).alias("any"), F.count_if(fits).alias("eligible"), F.max((F.col("r") == 1) & (F.col("rank") > F.col("base")) & (F.col("audit") < 100)).alias("hacked"), F.count("*").alias("candidates"))
    return out.select("resume_id", "locator", F.when(F.col("eligible") > 0, F.col("any")).alias("provider"), "hacked", "candidates")


def rewrite_adjudicator(spark: SparkSession, folder: str) -> DataFrame:
    """Per bullet the provider with the fewest clean rewritings, ties by name: it judges the others."""
    clean = rewrite_clean(spark, folder)
    own = [F.count_if(F.col("provider") == p).alias(p) for p in ("ash", "birch", "cedar", "dogwood")]
    counts = clean.groupBy("resume_id", "locator").agg(*own)
    least = F.array_min(F.array(*(F.struct(F.col(p).alias("n"), F.lit(p).alias("p")) for p in ("ash", "birch", "cedar", "dogwood"))))
    return counts.select("resume_id", "locator", least["p"].alias("judge"))


def rewrite_targets(spark: SparkSession, folder: str, most: int = 12) -> DataFrame:
    """The bullets of a résumé worth rewriting: those that keep the fewest invariants, the longest first."""
    inv = C.invariants(F.col("bullet"))
    passed = sum(inv[k].cast("int") for k in ("outcome", "measurability", "mechanism", "ownership"))
    b = _bullets(spark, folder).filter("bullet IS NOT NULL").select("resume_id", "locator", passed.alias("passed"), F.length("bullet").alias("n")).filter("passed < 4")
    w = Window.partitionBy("resume_id").orderBy("passed", F.desc("n"), "locator")
    return b.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= most).select("resume_id", "place", "locator", F.col("passed").cast("long").alias("passed"))


QUERIES = {
    f.__name__: f
    for f in (claim_has_metric, claim_vacuous_number, claim_invariants, claim_portability, claim_slop_bullets, claim_slop_summaries, claim_rank_score, rewrite_audited, rewrite_clean, rewrite_selected, rewrite_adjudicator, rewrite_targets)
}

_q = lambda p: p.replace("'", "''")
_list = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"


def _metric(t: str) -> str:
    parts, nums = f"string_split_regex({t}, '{C.NUMBER}')", f"regexp_extract_all({t}, '{C.NUMBER}')"
    length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda z: length(z))), 0)"
    start = f"({length(f'({parts})[1:i + 1]')} + {length(f'({nums})[1:i]')})"
    window = f"substr({t}, CAST(greatest(0, {start} - 30) AS BIGINT) + 1, CAST({start} + length(({nums})[i + 1]) + 30 - greatest(0, {start} - 30) AS BIGINT))"
    return f"coalesce(regexp_matches({t}, '{_q(C.UNIT)}') OR list_bool_or(list_transform(range(len({nums})), lambda i: NOT regexp_matches({window}, '{_q(C.TRIVIA)}') AND regexp_matches({window}, '{C.COMPARISON}'))), false)"


def _vacuous(t: str) -> str:
    return f"CASE WHEN NOT regexp_matches({t}, '{_q(C.UNIT)}') THEN nullif(regexp_extract({t}, '{_q(C.TRIVIA)}'), '') END"


def _inv(t: str) -> str:
    """The columns outcome, measurability, mechanism, ownership of a table with a column b and its metric m."""
    names = f"len(list_distinct(list_concat(regexp_extract_all({t}, '{C.SPECIFIC}'), list_filter(regexp_extract_all(substr({t}, 2), '{C.WITHIN}', 1), lambda w: w NOT IN {_list(C.NOT_NAMES)}))))"
    first = f"regexp_extract(lower({t}), '{C.FIRST_WORD}')"
    return f"""(({first} IN {_list(C.OUTCOME_VERBS)} OR regexp_matches(lower({t}), '{C.OUTCOME_WORD}') OR (regexp_matches({t}, '{C.CHANGE}') AND m)) AND NOT ({first} IN {_list(C.ACTIVITY_VERBS)} AND NOT m)) AS outcome,
  m AS measurability, ({names} >= 1 AND NOT (regexp_matches({t}, '{C.GENERIC}') AND {names} < 2)) AS mechanism,
  (NOT regexp_matches({t}, '{C.TEAM_FIRST}') AND (NOT regexp_matches({t}, '{C.TEAM}') OR regexp_matches({t}, '{C.DONE}'))) AS ownership"""


def _slop(t: str, scope: str) -> str:
    """A list of {rule, hit} of a text."""
    occ = lambda a, b: f"((length({a}) - length(replace({a}, {b}, ''))) // length({b}))"
    free = f"lambda h: {occ(t, 'h')} > coalesce(list_sum(list_transform(regexp_extract_all({t}, '{_q(C.PROTECTED)}'), lambda s: {occ('s', 'h')})), 0)"
    trim = r"'^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'"
    parts = [f"list_transform(list_filter(regexp_extract_all({t}, '{_q(p)}'), {free}), lambda h: {{'rule': '{r}', 'hit': regexp_replace(h, {trim})}})" for r, (s, _, p) in C.SLOP.items() if s == scope]
    return f"flatten([{', '.join(parts)}])"


_WORDS = r"len(list_filter(string_split_regex({t}, '[\s\x{{a0}}]+'), lambda w: w <> ''))"
_I = f"{_VALID}, bb AS (SELECT resume_id, locator, bullet AS b, {_metric('bullet')} AS m FROM located WHERE bullet IS NOT NULL), iv AS (SELECT resume_id, locator, b, {_inv('b')} FROM bb)"
_PASSED = "(CAST(outcome AS INTEGER) + CAST(measurability AS INTEGER) + CAST(mechanism AS INTEGER) + CAST(ownership AS INTEGER))"


def _rank(t: str) -> str:
    return f"round_even({_PASSED} * 10.0::DOUBLE - (len({_slop(t, 'bullet')}) + len({_slop(t, 'summary')})) * 6.0 - greatest(0, {_WORDS.format(t=t)} - 32) * 0.4::DOUBLE, 2)"


_QTY = lambda t: f"list_distinct(regexp_extract_all(regexp_replace({t}, '{_q(C.IDENTIFIER)}', ' ', 'g'), '\\d+(?:\\.\\d+)?'))"
_CON = lambda t: f"list_filter(list_distinct(list_transform(regexp_extract_all({t}, '[A-Za-z][\\w-]{{3,}}'), lambda w: lower(w))), lambda w: w NOT IN {_list(C.FILLER)})"
_SPE = lambda t: f"list_distinct(list_concat(list_transform(list_concat(regexp_extract_all(substr({t}, 2), '\\b[A-Z][A-Za-z0-9.-]{{2,}}\\b'), regexp_extract_all({t}, '\\b[A-Z]{{2,8}}\\b')), lambda w: lower(w)), {_QTY(t)}))"
_CAP = lambda t: f"len(regexp_extract_all(substr({t}, 2), '\\b[A-Z][a-zA-Z]{{2,}}\\b'))"
_SQ = lambda t: f"lower(regexp_replace(regexp_replace({t}, '[\\s\\x{{a0}}]+', ' ', 'g'), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'))"
_J = f"""{_VALID}, o AS (SELECT resume_id, locator, bullet FROM located WHERE bullet IS NOT NULL),
c AS (SELECT resume_id, locator, bullet, 'ash' AS provider, regexp_replace(bullet, '^([^,;]*)[,;].*$', '\\1') AS text FROM o UNION ALL SELECT resume_id, locator, bullet, 'birch', bullet || ', cutting time by 12%' FROM o
  UNION ALL SELECT resume_id, locator, bullet, 'cedar', regexp_replace(bullet, '^(\\D*)\\d+%?', '\\1some') FROM o UNION ALL SELECT resume_id, locator, bullet, 'dogwood', 'Reduced the time it took: ' || bullet FROM o),
k AS (SELECT * FROM c WHERE text <> '' AND {_SQ('text')} <> {_SQ('bullet')}),
tx AS (SELECT t, {_metric('t')} AS m FROM (SELECT DISTINCT text AS t FROM k UNION SELECT DISTINCT bullet FROM k)), ti AS (SELECT t, {_inv('t')} FROM tx), rk AS (SELECT t, {_rank('t')} AS rank FROM ti),
au AS (SELECT *, list_filter({_QTY('text')}, lambda n: NOT list_contains({_QTY('bullet')}, n)) AS inv, ({_vacuous('text')}) IS NOT NULL AND ({_vacuous('bullet')}) IS NULL AS vac,
  len(list_filter({_SPE('bullet')}, lambda n: NOT list_contains({_SPE('text')}, n))) AS lost, len({_CON('bullet')}) AS nc, len(list_filter({_CON('bullet')}, lambda n: list_contains({_CON('text')}, n))) AS kc, len({_SPE('text')}) AS ns,
  {_CAP('text')} > {_CAP('bullet')} + 2 AS pad FROM k),
ag AS (SELECT *, nc > 0 AND kc * 1.0 / nullif(nc, 0) < 0.45 AND ns = 0 AS gut FROM au),
j AS (SELECT resume_id, locator, provider, a.rank, b.rank AS base, 100.0::DOUBLE - 60 * len(inv) - CASE WHEN vac THEN 40 ELSE 0 END - CASE WHEN lost > 0 THEN 35 ELSE 0 END - CASE WHEN gut THEN 35 ELSE 0 END - CASE WHEN pad THEN 25 ELSE 0 END AS audit,
  len(inv) + CAST(vac AS INTEGER) + CAST(lost > 0 AS INTEGER) + CAST(gut AS INTEGER) + CAST(pad AS INTEGER) AS problems FROM ag JOIN rk a ON a.t = text JOIN rk b ON b.t = bullet)"""

ORACLES = {
    "claim_has_metric": f"WITH {_VALID} SELECT resume_id, locator FROM located WHERE {_metric('bullet')}",
    "claim_vacuous_number": f"WITH f AS (SELECT DISTINCT finding_id, concat_ws(' with 3 new people: ', message, evidence) AS t FROM (SELECT DISTINCT finding_id, message, evidence FROM findings)) SELECT * FROM (SELECT finding_id, {_vacuous('t')} AS number FROM f) WHERE number IS NOT NULL",
    "claim_invariants": f"WITH {_I} SELECT resume_id, locator, outcome, measurability, mechanism, ownership FROM iv",
    "claim_portability": f"""WITH {_VALID} SELECT resume_id, locator, round(len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{C.SPECIFIC}', '', 'g'), '{_q(C.UNIT)}', '', 'g'), '{C.NUMBER}', '', 'g'), '{C.CAPITAL}', '', 'g'), '\\w+'))
  / greatest(len(regexp_extract_all(x, '\\w+')), 1)::DOUBLE, 6) AS share FROM (SELECT *, regexp_replace(bullet, '{C.MARKED}', 'x', 'g') AS x FROM located WHERE bullet IS NOT NULL)""",
    "claim_slop_bullets": f"WITH h AS (SELECT doc_id, unnest({_slop('text', 'bullet')}) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, h.rule AS rule_id, lower(h.hit) AS hit, count(*) AS times FROM h GROUP BY 1, 2, 3",
    "claim_slop_summaries": f"WITH h AS (SELECT doc_id, unnest({_slop('text', 'summary')}) AS h FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id, h.rule AS rule_id, md5(lower(h.hit)) AS hit FROM h",
    "claim_rank_score": f"WITH {_I} SELECT resume_id, locator, {_rank('b')} AS score FROM iv",
    "rewrite_audited": f"WITH {_J} SELECT * FROM j",
    "rewrite_clean": f"WITH {_J} SELECT resume_id, locator, provider, rank FROM j WHERE problems = 0 AND audit >= 100",
    "rewrite_selected": f"""WITH {_J}, r AS (SELECT *, row_number() OVER (PARTITION BY resume_id, locator ORDER BY rank DESC, provider) AS r, rank >= base + 1 AND audit >= 100 AND problems = 0 AS fits FROM j)
SELECT resume_id, locator, arg_min(provider, r) FILTER (fits) AS provider, bool_or(r = 1 AND rank > base AND audit < 100) AS hacked, count(*) AS candidates FROM r GROUP BY 1, 2""",
    "rewrite_adjudicator": f"""WITH {_J}, k2 AS (SELECT DISTINCT resume_id, locator FROM j WHERE problems = 0 AND audit >= 100), p AS (SELECT * FROM k2, (VALUES ('ash'), ('birch'), ('cedar'), ('dogwood')) v(p)),
n AS (SELECT p.resume_id, p.locator, p.p, count(j.provider) AS n FROM p LEFT JOIN j ON j.resume_id = p.resume_id AND j.locator = p.locator AND j.provider = p.p AND j.problems = 0 AND j.audit >= 100 GROUP BY 1, 2, 3),
w AS (SELECT *, row_number() OVER (PARTITION BY resume_id, locator ORDER BY n, p) AS o FROM n) SELECT resume_id, locator, p AS judge FROM w WHERE o = 1""",
    "rewrite_targets": f"""WITH {_I}, p AS (SELECT resume_id, locator, {_PASSED} AS passed, length(b) AS n FROM iv), w AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY passed, n DESC, locator) AS place FROM p WHERE passed < 4)
SELECT resume_id, place, locator, CAST(passed AS BIGINT) AS passed FROM w WHERE place <= 12""",
}
