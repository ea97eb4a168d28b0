"""Queries over judges' replies: validation, votes, bands, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import judging as J
from tallyforge.operators.replies import read_replies
from tallyforge.session import once
from tallyforge.sources.tables import table

SLUGS = ("agentic-systems", "ai-assisted-coding-fluency", "evaluation-rigour", "production-ownership", "resume-craft")
CRITERIA = ("C1", "C2", "C3", "C4", "C5")

_STEPS = ("NOT c1", "NOT c2 OR NOT (c3 OR c4)", "NOT (c3 AND c4)", "NOT c5", "true")
#: Conditions of the bands E to A for each scheme of criteria. Fixed values.
BANDS = {
    "agentic-systems": _STEPS,
    "ai-assisted-coding-fluency": ("NOT c1", "NOT (c2 AND c3)", "NOT (c4 OR c5)", "NOT (c4 AND c5)", "true"),
    "evaluation-rigour": _STEPS,
    "production-ownership": _STEPS,
    "resume-craft": ("met <= 1", "met = 2", "met = 3", "met = 4", "true"),
}


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "judgments", "judgment_id", "resume_id", "provider", "sample_no", "categories"), "judgment_id")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["judgment_id", "resume_id", "provider", "sample_no"]
    read = read_replies(_replies(spark, folder), keys, "categories", SLUGS, CRITERIA)
    return read.withColumn("criterion_id", F.concat_ws("/", "slug", "criterion"))


def _banded(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of complete answer sets: rows (judgment_id, resume_id, provider, sample_no, slug, mask, position)."""
    bit = F.when(F.col("met"), F.pow(F.lit(2), F.substring("criterion", 2, 1).cast("int") - 1)).otherwise(0).cast("int")
    sets = _answers(spark, folder).groupBy("judgment_id", "resume_id", "provider", "sample_no", "slug").agg(F.sum(bit).cast("int").alias("mask"), F.count("*").alias("n"))
    lut = J.band_table(spark, BANDS).withColumnRenamed("scheme", "slug")
    return sets.filter("n = 5").join(F.broadcast(lut), ["slug", "mask"])  # 160 rows


def reply_answers(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("judgment_id", "criterion_id", "met")


def reply_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Replies that give no valid answer."""
    return J.missing(_replies(spark, folder).select("judgment_id", "provider"), _answers(spark, folder), ["judgment_id"])


def reply_samples_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Samples below a provider's highest for a résumé of which there is no reply."""
    seen = _replies(spark, folder).select("resume_id", "provider", "sample_no")
    expected = seen.groupBy("resume_id", "provider").agg(F.max("sample_no").alias("most")).select("resume_id", "provider", F.explode(F.sequence(F.lit(0), "most")).alias("sample_no"))
    return J.missing(expected, seen, ["resume_id", "provider", "sample_no"])


def vote_majority(spark: SparkSession, folder: str) -> DataFrame:
    return J.majority(_answers(spark, folder), ["resume_id", "provider", "criterion_id"], "met")


def vote_exemplar(spark: SparkSession, folder: str) -> DataFrame:
    return J.exemplar(_answers(spark, folder), ["resume_id", "provider", "criterion_id"], "sample_no", "met", "evidence")


def vote_k_of_n_then_union(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria found unmet in two samples of a provider (or all that were answered), over providers."""
    answers = _answers(spark, folder)
    return J.k_of_n(answers.filter("NOT met"), ["resume_id", "criterion_id"], "provider", "sample_no", 2, answers)


def place_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria a provider's samples answer both ways."""
    per = _answers(spark, folder).groupBy("resume_id", "provider", "criterion_id").agg(F.countDistinct("met").alias("ways"), F.count("*").alias("samples"))
    return per.filter("ways > 1").select("resume_id", "provider", "criterion_id", "samples")


def place_every_role(spark: SparkSession, folder: str) -> DataFrame:
    """Per résumé and criterion: yes if every provider says yes in some sample, no if one that answered never does."""
    per = _answers(spark, folder).groupBy("resume_id", "criterion_id", "provider").agg(F.max("met").alias("any_yes"))
    return per.groupBy("resume_id", "criterion_id").agg(F.min("any_yes").alias("met"), F.count("*").alias("providers"))


def band_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _banded(spark, folder).select("judgment_id", "slug", "mask", "band")


def band_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _banded(spark, folder).groupBy("slug", "band").agg(F.count("*").alias("replies"))


def band_leverage(spark: SparkSession, folder: str) -> DataFrame:
    return J.leverage(J.band_table(spark, BANDS)).select("scheme", "criterion", "flips", "widest")


def band_lower_wins(spark: SparkSession, folder: str) -> DataFrame:
    return J.lower_band(_banded(spark, folder), ["resume_id", "slug"], "position")


def agree_spread_within_between(spark: SparkSession, folder: str) -> DataFrame:
    per = J.spreads(_banded(spark, folder), ["resume_id", "slug"], "provider", "position")
    return per.select("resume_id", "slug", F.round("between", 6).alias("between"), "within")


def agree_criterion(spark: SparkSession, folder: str) -> DataFrame:
    """Items on which a criterion's judges agree, differ, or contradict themselves."""
    per = _answers(spark, folder).groupBy("criterion_id", "resume_id", "provider").agg(F.min("met").alias("lo"), F.max("met").alias("hi"))
    items = per.groupBy("criterion_id", "resume_id").agg(F.max((F.col("lo") != F.col("hi")).cast("int")).alias("unstable"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    state = F.when(F.col("unstable") == 1, "unstable").when(F.col("lo") == F.col("hi"), "agree").otherwise("disagree")
    return items.groupBy("criterion_id", state.alias("state")).agg(F.count("*").alias("items"))


def agree_krippendorff_nominal(spark: SparkSession, folder: str) -> DataFrame:
    out = J.krippendorff(_answers(spark, folder), ["resume_id"], "met", "nominal", ["criterion_id"])
    return out.select("criterion_id", "units", "answers", F.round("alpha", 6).alias("alpha"))


def agree_krippendorff_interval(spark: SparkSession, folder: str) -> DataFrame:
    out = J.krippendorff(_banded(spark, folder), ["resume_id"], "position", "interval", ["slug"])
    return out.select("slug", "units", "answers", F.round("alpha", 6).alias("alpha"))


def agree_krippendorff_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    out = J.krippendorff(_banded(spark, folder), ["resume_id"], "position", "ordinal", ["slug"])
    return out.select("slug", "units", "answers", F.round("alpha", 6).alias("alpha"))


def agree_jaccard_chance_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """How far the criteria each pair of a résumé's judges found met overlap."""
    met = vote_majority(spark, folder).filter("met")
    out = J.set_overlap(met, ["resume_id"], "provider", "criterion_id", 25)
    return out.select("resume_id", "judge_a", "judge_b", *(F.round(c, 6).alias(c) for c in ("jaccard", "chance", "kappa")))


def agree_spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of price and size of each type of part."""
    parts = table(spark, folder, "part", "p_partkey", "p_type", "p_retailprice", "p_size")
    return J.spearman(parts, "p_type", "p_retailprice", "p_size", "p_partkey").select("p_type", "n", F.round("rho", 6).alias("rho"))


def coverage_constant(spark: SparkSession, folder: str) -> DataFrame:
    """Per criterion the answers and yes answers, and whether it never varies."""
    per = _answers(spark, folder).groupBy("criterion_id").agg(F.count("*").alias("answered"), F.count_if("met").alias("met"))
    return per.withColumn("constant", (F.col("met") == 0) | (F.col("met") == F.col("answered")))


def vocabulary_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Rule ids per source of findings, and those several sources use."""
    f = table(spark, folder, "findings", "rule_id", "finding_source").filter("rule_id IS NOT NULL AND finding_source IS NOT NULL").distinct()
    shared = f.groupBy("rule_id").agg((F.count("*") > 1).cast("long").alias("shared"))
    return f.join(shared, "rule_id").groupBy("finding_source").agg(F.count("*").alias("rules"), F.sum("shared").alias("shared"))


QUERIES = {
    f.__name__: f
    for f in (
        reply_answers, reply_unreadable, reply_samples_missing, vote_majority, vote_exemplar, vote_k_of_n_then_union, place_conflicts, place_every_role, band_lookup, band_histogram,
        band_leverage, band_lower_wins, agree_spread_within_between, agree_criterion, agree_krippendorff_nominal, agree_krippendorff_interval, agree_krippendorff_ordinal,
        agree_jaccard_chance_kappa, agree_spearman, coverage_constant, vocabulary_shared,
    )
}

_R = """rp AS (SELECT DISTINCT judgment_id, resume_id, provider, sample_no, categories FROM judgments),
js AS (SELECT * EXCLUDE (categories), TRY_CAST(regexp_extract(categories, '\\{.*\\}', 0, 's') AS JSON) AS j FROM rp)"""
_TRIM = r"'^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'"
_A = f"""{_R}, ks AS (SELECT * EXCLUDE (j), j, unnest(json_keys(j)) AS key, generate_subscripts(json_keys(j), 1) AS place FROM js WHERE j IS NOT NULL),
sl AS (SELECT * EXCLUDE (j), lower(regexp_replace(key, {_TRIM})) AS slug, json_extract(j, '$."' || key || '".criteria') AS c FROM ks),
it AS (SELECT judgment_id, resume_id, provider, sample_no, slug, place, c, unnest(generate_series(0, CAST(json_array_length(c) AS BIGINT) - 1)) AS pos FROM sl WHERE json_type(c) = 'ARRAY'),
ty AS (SELECT *, upper(regexp_replace(json_extract_string(c, '$[' || pos || '].id'), {_TRIM})) AS cid,
  lower(regexp_replace(regexp_replace(json_extract_string(c, '$[' || pos || '].answer'), {_TRIM}), '[.\\s]+$', '')) AS said, json_extract_string(c, '$[' || pos || '].evidence') AS evidence FROM it),
cr AS (SELECT *, regexp_replace(CASE WHEN starts_with(cid, upper(slug) || '/') THEN substr(cid, length(slug) + 2) ELSE cid END, {_TRIM}) AS criterion FROM ty),
va AS (SELECT *, said IN ('yes', 'true', 'y', 'met') AS met, row_number() OVER (PARTITION BY judgment_id, resume_id, provider, sample_no, slug, criterion ORDER BY place, pos) AS rn FROM cr
  WHERE said IN ('yes', 'true', 'y', 'met', 'no', 'false', 'n', 'unmet', 'not met') AND criterion IN ('C1', 'C2', 'C3', 'C4', 'C5') AND slug IN ({', '.join(f"'{s}'" for s in SLUGS)})),
a AS (SELECT *, slug || '/' || criterion AS criterion_id FROM va WHERE rn = 1)"""
_POS = """CASE WHEN slug = 'resume-craft' THEN greatest(met, 1) - 1
  WHEN slug = 'ai-assisted-coding-fluency' THEN CASE WHEN NOT c1 THEN 0 WHEN NOT (c2 AND c3) THEN 1 WHEN NOT (c4 OR c5) THEN 2 WHEN NOT (c4 AND c5) THEN 3 ELSE 4 END
  ELSE CASE WHEN NOT c1 THEN 0 WHEN NOT c2 OR NOT (c3 OR c4) THEN 1 WHEN NOT (c3 AND c4) THEN 2 WHEN NOT c5 THEN 3 ELSE 4 END END"""
_B = f"""{_A}, st AS (SELECT judgment_id, resume_id, provider, sample_no, slug, {', '.join(f"bool_or(met AND criterion = 'C{i}') AS c{i}" for i in range(1, 6))}, count(*) FILTER (met) AS met, count(*) AS n FROM a GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT *, CAST({' + '.join(f"CASE WHEN c{i} THEN {2 ** (i - 1)} ELSE 0 END" for i in range(1, 6))} AS INTEGER) AS mask, CAST({_POS} AS INTEGER) AS position FROM st WHERE n = 5),
bb AS (SELECT *, substr('EDCBA', position + 1, 1) AS band FROM b)"""
_MAJ = "SELECT resume_id, provider, criterion_id, count(*) FILTER (met) > count(*) FILTER (NOT met) AS met, count(*) FILTER (met) AS yes, count(*) FILTER (NOT met) AS no FROM a GROUP BY 1, 2, 3"


def _alpha(source: str, group: str, unit: str, value: str, distance: str, place: str) -> str:
    return f"""v AS (SELECT {group} AS g, {unit} AS u, {value} AS v, count(*) AS n FROM {source} GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY g, u) AS m FROM v), k AS (SELECT * FROM m WHERE m >= 2),
t AS (SELECT g, v, sum(n) AS n FROM k GROUP BY 1, 2), x AS (SELECT *, {place} AS x FROM t),
o AS (SELECT a.g, sum(a.n * b.n * {distance} / (a.m - 1)) AS o FROM k a JOIN k b ON a.g = b.g AND a.u = b.u JOIN x p ON p.g = a.g AND p.v = a.v JOIN x q ON q.g = b.g AND q.v = b.v GROUP BY 1),
e AS (SELECT p.g, sum(p.n * q.n * {distance}) AS e FROM x p JOIN x q ON p.g = q.g GROUP BY 1),
s AS (SELECT g, count(DISTINCT u) AS units, CAST(sum(n) AS BIGINT) AS answers FROM k GROUP BY 1)
SELECT s.g AS {group}, s.units, s.answers, round(1 - (s.answers - 1) * o.o / nullif(e.e, 0), 6) AS alpha FROM s JOIN o USING (g) JOIN e USING (g)"""


_LUT = """bt AS (SELECT i AS mask, (i & 1) > 0 AS c1, (i & 2) > 0 AS c2, (i & 4) > 0 AS c3, (i & 8) > 0 AS c4, (i & 16) > 0 AS c5, bit_count(i) AS met FROM range(32) r(i)),
lt AS (SELECT s.slug, mask, """ + _POS + " AS position FROM bt CROSS JOIN (VALUES " + ", ".join(f"('{s}')" for s in SLUGS) + ") s(slug))"

ORACLES = {
    "reply_answers": f"WITH {_A} SELECT judgment_id, criterion_id, met FROM a",
    "reply_unreadable": f"WITH {_A} SELECT judgment_id, provider FROM rp WHERE judgment_id NOT IN (SELECT judgment_id FROM a)",
    "reply_samples_missing": f"WITH {_R}, x AS (SELECT resume_id, provider, unnest(generate_series(0, max(sample_no))) AS sample_no FROM rp GROUP BY 1, 2) SELECT resume_id, provider, CAST(sample_no AS INTEGER) AS sample_no FROM x EXCEPT SELECT resume_id, provider, sample_no FROM rp",
    "vote_majority": f"WITH {_A} {_MAJ}",
    "vote_exemplar": f"""WITH {_A}, j AS ({_MAJ}), k AS (SELECT a.*, j.met AS side, row_number() OVER (PARTITION BY a.resume_id, a.provider, a.criterion_id ORDER BY a.met <> j.met, coalesce(a.evidence, '') = '', a.sample_no) AS r
FROM a JOIN j USING (resume_id, provider, criterion_id)) SELECT resume_id, provider, criterion_id, side AS met, sample_no AS sample FROM k WHERE r = 1""",
    "vote_k_of_n_then_union": f"""WITH {_A}, u AS (SELECT * FROM a WHERE NOT met), g AS (SELECT resume_id, provider, count(DISTINCT sample_no) AS n FROM a GROUP BY 1, 2),
s AS (SELECT resume_id, criterion_id, provider, count(DISTINCT sample_no) AS k FROM u GROUP BY 1, 2, 3)
SELECT resume_id, criterion_id, count(*) AS providers, CASE WHEN count(*) > 1 THEN 'high' ELSE 'medium' END AS confidence FROM s JOIN g USING (resume_id, provider) WHERE k >= least(2, n) GROUP BY 1, 2""",
    "place_conflicts": f"WITH {_A} SELECT resume_id, provider, criterion_id, count(*) AS samples FROM a GROUP BY 1, 2, 3 HAVING count(DISTINCT met) > 1",
    "place_every_role": f"WITH {_A}, p AS (SELECT resume_id, criterion_id, provider, bool_or(met) AS y FROM a GROUP BY 1, 2, 3) SELECT resume_id, criterion_id, bool_and(y) AS met, count(*) AS providers FROM p GROUP BY 1, 2",
    "band_lookup": f"WITH {_B} SELECT judgment_id, slug, mask, band FROM bb",
    "band_histogram": f"WITH {_B} SELECT slug, band, count(*) AS replies FROM bb GROUP BY 1, 2",
    "band_leverage": f"""WITH {_LUT} SELECT a.slug AS scheme, CAST(k + 1 AS INTEGER) AS criterion, count(*) FILTER (a.position <> b.position) AS flips, CAST(max(abs(a.position - b.position)) AS INTEGER) AS widest
FROM lt a CROSS JOIN range(5) r(k) JOIN lt b ON b.slug = a.slug AND b.mask = xor(a.mask, 1 << k) GROUP BY 1, 2""",
    "band_lower_wins": f"WITH {_B} SELECT resume_id, slug, min(position) AS lowest, max(position) AS highest, max(position) - min(position) AS gap, count(*) AS judges FROM bb GROUP BY 1, 2",
    "agree_spread_within_between": f"""WITH {_B}, p AS (SELECT resume_id, slug, provider, avg(position) AS m, CASE WHEN count(*) > 1 THEN max(position) - min(position) END AS r FROM bb GROUP BY 1, 2, 3)
SELECT resume_id, slug, round(CASE WHEN count(m) > 1 THEN max(m) - min(m) END, 6) AS "between", max(r) AS "within" FROM p GROUP BY 1, 2""",
    "agree_criterion": f"""WITH {_A}, p AS (SELECT criterion_id, resume_id, provider, bool_and(met) AS lo, bool_or(met) AS hi FROM a GROUP BY 1, 2, 3),
i AS (SELECT criterion_id, CASE WHEN bool_or(lo <> hi) THEN 'unstable' WHEN bool_and(lo) = bool_or(hi) THEN 'agree' ELSE 'disagree' END AS state FROM p GROUP BY criterion_id, resume_id) SELECT criterion_id, state, count(*) AS items FROM i GROUP BY 1, 2""",
    "agree_krippendorff_nominal": f"WITH {_A}, " + _alpha("a", "criterion_id", "resume_id", "met", "CASE WHEN p.v = q.v THEN 0.0 ELSE 1.0 END", "0"),
    "agree_krippendorff_interval": f"WITH {_B}, " + _alpha("bb", "slug", "resume_id", "position", "CAST((p.x - q.x) * (p.x - q.x) AS DOUBLE)", "v"),
    "agree_krippendorff_ordinal": f"WITH {_B}, " + _alpha("bb", "slug", "resume_id", "position", "CAST((p.x - q.x) * (p.x - q.x) AS DOUBLE)", "sum(n) OVER (PARTITION BY g ORDER BY v) - n / 2"),
    "agree_jaccard_chance_kappa": f"""WITH {_A}, j AS ({_MAJ}), s AS (SELECT resume_id, provider, list(criterion_id) AS s FROM j WHERE met GROUP BY 1, 2),
p AS (SELECT a.resume_id, a.provider AS judge_a, b.provider AS judge_b, len(list_intersect(a.s, b.s)) AS nn, len(a.s) AS na, len(b.s) AS nb FROM s a JOIN s b ON a.resume_id = b.resume_id AND a.provider < b.provider),
q AS (SELECT *, CAST(nn AS DOUBLE) / (na + nb - nn) AS jaccard, (na * nb / 25.0::DOUBLE) / (na + nb - na * nb / 25.0::DOUBLE) AS chance FROM p)
SELECT resume_id, judge_a, judge_b, round(jaccard, 6) AS jaccard, round(chance, 6) AS chance, round((jaccard - chance) / nullif(1 - chance, 0), 6) AS kappa FROM q""",
    "agree_spearman": """WITH r AS (SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS x, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS y FROM part)
SELECT p_type, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN 1 - 6.0::DOUBLE * sum((x - y) * (x - y)) / (count(*) * (count(*) * count(*) - 1)) END, 6) AS rho FROM r GROUP BY 1""",
    "coverage_constant": f"WITH {_A} SELECT criterion_id, count(*) AS answered, count(*) FILTER (met) AS met, count(*) FILTER (met) IN (0, count(*)) AS constant FROM a GROUP BY 1",
    "vocabulary_shared": """WITH f AS (SELECT DISTINCT rule_id, finding_source FROM findings WHERE rule_id IS NOT NULL AND finding_source IS NOT NULL), s AS (SELECT rule_id, CAST(count(*) > 1 AS BIGINT) AS shared FROM f GROUP BY 1)
SELECT finding_source, count(*) AS rules, CAST(sum(shared) AS BIGINT) AS shared FROM f JOIN s USING (rule_id) GROUP BY 1""",
}
