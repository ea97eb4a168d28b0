"""Queries that settle judgements: answers of places, verdicts on agreement, keys; costs, caps, budgets; draws and extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import judging as J
from tallyforge.operators import scoring as S
from tallyforge.operators import segments as G
from tallyforge.plans import claims as CL
from tallyforge.plans import corpus
from tallyforge.plans import judging as PJ
from tallyforge.plans import scoring as PS
from tallyforge.plans.documents import _VALID, _bullets
from tallyforge.sources.tables import table

#: Points of severities, caps of provenances, category weights, gates, shares of rules in judged categories,
#: values of bands E to A, and rules with caps of the composite.
POINTS = {"critical": 25, "major": 12, "minor": 4}
PROVENANCE_CAPS = {"heuristic": "minor"}
SEVERITIES = ("critical", "major", "minor")
WEIGHTS = {"Parseability": 15.0, "Structure": 5.0, "Title alignment": 5.0, "Resume craft": 25.0, "Production ownership": 15.0, "Agentic systems": 15.0, "Evaluation rigour": 12.5, "AI-assisted coding fluency": 7.5}
GATES = {"Parseability": "parser", "Structure": "parser", "Title alignment": "recruiter", "Resume craft": "manager", "Production ownership": "manager", "Agentic systems": "manager", "Evaluation rigour": "manager", "AI-assisted coding fluency": "manager"}
RULE_SHARES = {"production-ownership": 0.4, "evaluation-rigour": 0.4, "ai-assisted-coding-fluency": 0.0, "agentic-systems": 0.0, "resume-craft": 0.7}
SLUG_WEIGHTS = {"production-ownership": 15.0, "evaluation-rigour": 12.5, "ai-assisted-coding-fluency": 7.5, "agentic-systems": 15.0, "resume-craft": 25.0}
BAND_VALUES = (10.0, 35.0, 58.0, 78.0, 95.0)
RULE_CAPS = {"parse/hidden-text": 40.0, "parse/no-text-layer": 15.0, "parse/tables": 40.0}  # the last stands in: the tables hold neither other rule
#: What a rule's cost is multiplied with: 1 + 0.5 * the share of postings that state its dimension. Fixed value here.
MULTIPLIERS = {"title/seniority-mismatch": 1.25}


def _value(spark: SparkSession, folder: str) -> DataFrame:
    """Banded replies with the value of their band."""
    value = F.element_at(F.array(*map(F.lit, BAND_VALUES)), F.col("position") + 1)
    return PJ._banded(spark, folder).withColumn("value", value)


def _places(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(required, answers): every provider that replied for a résumé is a place of each criterion asked there; samples that
    contradict each other leave it unanswered."""
    a = PJ._answers(spark, folder).select("resume_id", "criterion_id", "provider", "met")
    answers = J.place_answers(a, ["resume_id", "criterion_id"], "provider", "met")
    asked = a.select("resume_id", "criterion_id").distinct()
    required = asked.join(PJ._replies(spark, folder).select("resume_id", "provider").distinct(), "resume_id")
    return required, answers


def place_conflicts_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder)[1]


def place_any(spark: SparkSession, folder: str) -> DataFrame:
    """Per résumé and criterion: yes if any provider's settled answer is yes, null if a silent one could change a no."""
    required, answers = _places(spark, folder)
    return J.any_place(required, answers, ["resume_id", "criterion_id"], "provider")


def place_every_group(spark: SparkSession, folder: str) -> DataFrame:
    """Per résumé and slug: every criterion needs a yes of some provider; a criterion answered in full without one is no."""
    required, answers = _places(spark, folder)
    at = F.concat_ws("@", "criterion_id", "provider")
    slug = F.split("criterion_id", "/")[0]
    req = required.select("resume_id", slug.alias("slug"), "criterion_id", at.alias("place"))
    ans = answers.select("resume_id", slug.alias("slug"), at.alias("place"), "met")
    return J.every_group(req, ans, ["resume_id", "slug"], "criterion_id", "place")


def agree_band_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return J.band_verdicts(PJ._banded(spark, folder), ["resume_id"], "slug", "provider", "position")


def agree_spread_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The spread between judges of each résumé's mean band value."""
    per = _value(spark, folder).groupBy("resume_id", "provider", "sample_no").agg(F.avg("value").alias("v"))
    out = J.spread_verdicts(per, ["resume_id"], "provider", "v")
    return out.select("resume_id", F.round("spread", 6).alias("spread"), "verdict")


def agree_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """The two first providers by name: how far apart their mean band values lie per slug, and what is left without that."""
    v = _value(spark, folder).groupBy("slug", "resume_id", "provider").agg(F.avg("value").alias("v"))
    two = v.groupBy("slug", "resume_id").agg(F.array_sort(F.collect_list(F.struct("provider", "v"))).alias("x")).filter(F.size("x") >= 2)
    pairs = two.select("slug", F.col("x")[0]["v"].alias("a"), F.col("x")[1]["v"].alias("b"))
    out = J.offsets(pairs, "slug", "a", "b")
    return out.select("slug", "n", *(F.round(c, 6).alias(c) for c in ("offset", "worst", "mean_residual")), "inside", "higher")


def key_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Each provider's samples against a key: the criteria of which all answers of a résumé are the same."""
    a = PJ._answers(spark, folder)
    key = a.groupBy("resume_id", "criterion_id").agg(F.min("met").alias("answer"), F.max("met").alias("hi"), F.countDistinct("provider").alias("p")).filter("answer = hi AND p > 1").select("resume_id", "criterion_id", "answer")
    samples = PJ._replies(spark, folder).select("provider", "sample_no").distinct()
    return J.key_score(key, samples, a.groupBy("provider", "sample_no", "resume_id", "criterion_id").agg(F.min("met").alias("met")), ["resume_id", "criterion_id"], ["provider", "sample_no"])


def reply_try_buckets(spark: SparkSession, folder: str, votes: int = 2) -> DataFrame:
    """Tries grouped into voted samples, `votes` tries each."""
    r = PJ._replies(spark, folder)
    return r.groupBy("resume_id", "provider", F.floor(F.col("sample_no") / votes).alias("sample")).agg(F.count("*").alias("tries"))


def reply_planned_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every provider, sample and objective of a plan, and how many replies there are of each provider's sample."""
    r = PJ._replies(spark, folder)
    planned = r.select("provider").distinct().select("provider", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample_no")).select("*", F.explode(F.array(*map(F.lit, ("clarity", "impact", "brevity")))).alias("objective"))
    return planned.join(r.groupBy("provider", "sample_no").agg(F.count("*").alias("n")), ["provider", "sample_no"], "left").select("provider", "sample_no", "objective", F.coalesce("n", F.lit(0)).alias("replies"))


def band_split_moves(spark: SparkSession, folder: str) -> DataFrame:
    """How far one answer can move the composite: per scheme and criterion the widest and least move of a band's value, in
    composite points."""
    bands = J.band_table(spark, PJ.BANDS).withColumn("v", F.element_at(F.array(*map(F.lit, BAND_VALUES)), F.col("position") + 1))
    flips = bands.select("scheme", "mask", "v", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("criterion")).withColumn("other", F.col("mask").bitwiseXOR(F.pow(F.lit(2), F.col("criterion") - 1).cast("int")))
    moved = flips.join(F.broadcast(bands.select("scheme", F.col("mask").alias("other"), F.col("v").alias("w"))), ["scheme", "other"]).withColumn("d", F.abs(F.col("v") - F.col("w"))).filter("d > 0")
    scale = (1 - S.lookup("scheme", RULE_SHARES)) * S.lookup("scheme", SLUG_WEIGHTS) / F.lit(sum(WEIGHTS.values()))
    return moved.groupBy("scheme", "criterion").agg(F.round(F.max(F.col("d") * scale), 6).alias("widest"), F.round(F.min(F.col("d") * scale), 6).alias("least"))


def _priced(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "findings", "finding_id", "resume_id", "rule_id", "category", "severity", "provenance", "evidence", "locator_path", "cost_scale", "advice_only").distinct()
    kept = S.evidenced(f, "evidence", "locator_path").filter(~F.coalesce("advice_only", F.lit(False)))
    kept = kept.withColumn("category", F.when(F.col("category") == "Contact", "Structure").otherwise(F.col("category")))
    held = kept.withColumn("severity", S.capped_severity(F.col("severity"), F.col("provenance"), PROVENANCE_CAPS, SEVERITIES))
    return S.finding_costs(held, "rule_id", "category", "severity", "cost_scale", POINTS, WEIGHTS, MULTIPLIERS, tuple(RULE_CAPS))


def score_capped_severity(spark: SparkSession, folder: str) -> DataFrame:
    """Severities after the cap of their provenance."""
    f = table(spark, folder, "findings", "finding_id", "severity", "provenance").distinct()
    held = S.capped_severity(F.col("severity"), F.col("provenance"), PROVENANCE_CAPS, SEVERITIES)
    return f.select("provenance", "severity", held.alias("held")).groupBy("provenance", "severity", "held").agg(F.count("*").alias("findings"))


def score_finding_costs(spark: SparkSession, folder: str) -> DataFrame:
    return _priced(spark, folder).select("finding_id", F.round("cost", 6).alias("cost"))


def _categories(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per category; the judged ones of résumés without any role are withheld."""
    costs = _priced(spark, folder).withColumn("cost", F.round(F.col("cost"), 6))
    roles = table(spark, folder, "resume_roles", "resume_id").distinct()
    judged = [c for c in WEIGHTS if GATES[c] == "manager"]
    bare = costs.select("resume_id").distinct().join(roles, "resume_id", "left_anti").select("resume_id", F.explode(F.array(*map(F.lit, judged))).alias("category"))
    return S.category_scores(costs, "resume_id", "category", WEIGHTS, bare)


def score_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _categories(spark, folder).select("resume_id", "category", F.round("score", 6).alias("score"))


def score_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted means of each gate's categories."""
    return S.gate_scores(_categories(spark, folder), "resume_id", S.lookup("category", GATES), ("parser", "recruiter", "manager"))


def score_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Composites, held down where a rule with a cap was found, and that rule."""
    composites = S.weighted_scores(_categories(spark, folder), "resume_id", "score", "weight")
    return S.capped(composites, table(spark, folder, "findings", "resume_id", "rule_id"), "resume_id", "rule_id", RULE_CAPS)


def score_running_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Each ledger row with what is left after it, in hundredths."""
    rows = PS.score_ledger_topk_tail(spark, folder)
    return S.running_ledger(rows, "resume_id", 10_000).select("resume_id", "ord", "label", "total")


def score_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Composites by all findings against those by deterministic ones: lower, higher, unchanged, mean and range of the move."""
    costs = _priced(spark, folder).withColumn("cost", F.round(F.col("cost"), 6))
    sources = table(spark, folder, "findings", "finding_id", "finding_source").distinct().filter("finding_source = 'deterministic'")
    own = costs.join(sources, "finding_id", "left_semi")
    old, new = (S.weighted_scores(S.category_scores(c, "resume_id", "category", WEIGHTS), "resume_id", "score", "weight") for c in (costs, own))
    both = old.join(new.withColumnRenamed("composite", "other"), "resume_id").select((F.col("other") - F.col("composite")).alias("d"))
    d = F.round("d", 6)
    return both.agg(F.count_if(d < 0).alias("lower"), F.count_if(d > 0).alias("higher"), F.count_if(d == 0).alias("unchanged"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.min("d"), 6).alias("least"), F.round(F.max("d"), 6).alias("most"))


def weights_all(spark: SparkSession, folder: str) -> DataFrame:
    """Authored weights and those derived from how often postings state a dimension, in one table."""
    authored = spark.createDataFrame(list(_AUTHORED.items()), "name string, weight double").withColumn("kind", F.lit("authored"))
    derived = corpus.tax_derived_weights(spark, folder).select(F.col("dimension").alias("name"), "weight", F.lit("derived").alias("kind"))
    return authored.unionByName(derived)


def budget_worst_case(spark: SparkSession, folder: str) -> DataFrame:
    """What judging each source's documents may cost at most, whether 2 dollars are enough, and the cap that would fit."""
    prompts = table(spark, folder, "documents", "source", "text").withColumn("tokens", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 3))
    out = S.largest_cap(S.worst_case(prompts, "source", "tokens", 3, 2, 0.1, 0.5, 16_000), 2.0, 3, 2, 0.5, 16_000)
    return out.select("source", "documents", F.round("dollars", 6).alias("dollars"), "fits", "largest_cap")


def rewrite_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The best by rank of the first n rewritings: mean rank and audit score, and how many would be clean, by n."""
    j = CL._judged(spark, folder).withColumn("i", F.ascii("provider") - F.ascii(F.lit("a")) + 1)
    per = j.select("*", F.explode(F.filter(F.array(*map(F.lit, (1, 2, 3, 4))), lambda n: n >= F.col("i"))).alias("n"))
    best = per.groupBy("resume_id", "locator", "n").agg(F.max(F.struct("rank", (-F.col("i")).alias("o"), "audit", "problems")).alias("b"))
    return best.groupBy("n").agg(F.count("*").alias("bullets"), F.round(F.avg("b.rank"), 6).alias("rank"), F.round(F.avg("b.audit"), 6).alias("audit"), F.count_if(F.col("b.problems") == 0).alias("clean"))


def rule_role_retelling(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets that retell one of an earlier role of the same résumé."""
    b = _bullets(spark, folder).filter("bullet IS NOT NULL")
    found = G.near_duplicates_first(b, "resume_id", ["role_ix", "bullet_ix"], "bullet")
    order = Window.partitionBy("resume_id").orderBy("role_ix", "bullet_ix")
    placed = b.withColumn("ix", F.row_number().over(order) - 1).select("resume_id", "ix", "role_ix")
    first = placed.select("resume_id", F.col("ix").alias("first_ix"), F.col("role_ix").alias("first_role"))
    return found.join(placed, ["resume_id", "ix"]).join(first, ["resume_id", "first_ix"]).filter("role_ix <> first_role").select("resume_id", "role_ix", "first_role").groupBy("resume_id", "role_ix", "first_role").agg(F.count("*").alias("bullets"))


def sample_seeded_draw(spark: SparkSession, folder: str, seed: str = "draw-1", most: int = 3) -> DataFrame:
    """A draw of documents from each source that depends on a seed and the documents' keys alone."""
    docs = table(spark, folder, "documents", "doc_id", "source").distinct()
    drawn = docs.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    place = F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))
    return drawn.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("source", "place", "doc_id")


def extract_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Findings without anything quoted, résumés renamed by their rank."""
    f = table(spark, folder, "findings", "finding_id", "resume_id", "rule_id", "evidence").distinct()
    names = f.select("resume_id").distinct()
    rank = names.withColumn("n", F.rank().over(Window.orderBy(F.md5(F.col("resume_id").cast("string")))))  # one row a résumé, the key alone
    return f.join(rank, "resume_id").select("finding_id", F.concat(F.lit("private_resume_"), "n").alias("resume"), "rule_id", F.length("evidence").alias("quoted"))


def report_cache(spark: SparkSession, folder: str, seconds: int = 3600 * 24, most: int = 24) -> DataFrame:
    """What a cache would hold after the last event: events no older than a time to live, the latest `most`."""
    e = table(spark, folder, "events", "event_id", "ts")
    last = e.agg(F.max("ts").alias("now"))
    fresh = e.join(F.broadcast(last)).filter(F.col("ts") >= F.col("now") - F.make_interval(secs=F.lit(seconds)))  # one row
    return fresh.orderBy(F.desc("ts"), F.desc("event_id")).limit(most).select("event_id")


def listing_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the intake's documents with how often each came in, the latest of each."""
    r = table(spark, folder, "resumes", "resume_id", "doc_name", "extracted_at").distinct().filter("doc_name IS NOT NULL")
    stem = F.regexp_replace("doc_name", r"\.[^./]*$", "")
    return r.groupBy(stem.alias("name")).agg(F.count("*").alias("times"), F.max(F.struct("extracted_at", "resume_id")).alias("l")).select("name", "times", F.col("l.resume_id").alias("latest"))


def reply_clipped(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of unmet criteria, at most 40 characters."""
    a = PJ._answers(spark, folder).filter("NOT met AND evidence <> ''")
    return a.select("judgment_id", "criterion_id", F.substring("evidence", 1, 40).alias("evidence"))


QUERIES = {
    f.__name__: f
    for f in (
        place_conflicts_dropped, place_any, place_every_group, agree_band_verdicts, agree_spread_verdicts, agree_offsets, key_scores, reply_try_buckets, reply_planned_calls, band_split_moves, score_capped_severity,
        score_finding_costs, score_categories, score_gates, score_capped, score_running_ledger, score_sides, weights_all, budget_worst_case, rewrite_sweep, rule_role_retelling, sample_seeded_draw, extract_redacted,
        report_cache, listing_documents, reply_clipped,
    )
}

_case = lambda column, values, other="NULL": f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"
_P = f"""{PJ._A}, an AS (SELECT resume_id, criterion_id, provider, bool_and(met) AS met FROM a GROUP BY 1, 2, 3 HAVING bool_and(met) = bool_or(met)),
rq AS (SELECT DISTINCT x.resume_id, x.criterion_id, r.provider FROM a x JOIN rp r USING (resume_id)), bo AS (SELECT rq.*, an.met FROM rq LEFT JOIN an USING (resume_id, criterion_id, provider))"""
_VAL = "[" + ", ".join(f"{v}::DOUBLE" for v in BAND_VALUES) + "]"
_GAPS = "SELECT {g}, max(a.hi - b.lo) AS g FROM p a JOIN p b ON {on} AND a.provider <> b.provider GROUP BY ALL"
_SEVC = "CASE WHEN provenance = 'heuristic' AND severity IN ('critical', 'major') THEN 'minor' ELSE severity END"
_FC = f"""f AS (SELECT DISTINCT finding_id, resume_id, rule_id, category, severity, provenance, evidence, locator_path, cost_scale, advice_only FROM findings),
k AS (SELECT * EXCLUDE (category), CASE WHEN category = 'Contact' THEN 'Structure' ELSE category END AS category, {_SEVC} AS sev FROM f WHERE (regexp_matches(coalesce(evidence, ''), '\\S') OR locator_path = 'document') AND NOT coalesce(advice_only, false)),
r AS (SELECT *, coalesce({_case('sev', POINTS)}, 0) * {_case('rule_id', MULTIPLIERS, '1.0')}::DOUBLE * coalesce(cost_scale, 1.0) AS raw, {_case('category', WEIGHTS)}::DOUBLE AS w FROM k),
c AS (SELECT *, round(CASE WHEN rule_id IN ({', '.join(f"'{x}'" for x in RULE_CAPS)}) THEN raw WHEN w IS NULL THEN 0 ELSE least(raw, w) END, 6) AS cost FROM r)"""
_CATS = ", ".join(f"('{k}', {v}::DOUBLE, '{GATES[k]}')" for k, v in WEIGHTS.items())


def _scores(source: str, withheld: bool) -> str:
    score = "CASE WHEN gate = 'manager' AND any_value(rr.x) IS NULL THEN 10.0 ELSE greatest(0.0, 100.0 - coalesce(sum(cost), 0)) END" if withheld else "greatest(0.0, 100.0 - coalesce(sum(cost), 0))"
    return f"SELECT d.resume_id, v.category, v.weight, v.gate, {score} AS score FROM (SELECT DISTINCT resume_id FROM {source}) d CROSS JOIN (VALUES {_CATS}) v(category, weight, gate) LEFT JOIN {source} c ON c.resume_id = d.resume_id AND c.category = v.category LEFT JOIN (SELECT DISTINCT resume_id AS x FROM resume_roles) rr ON rr.x = d.resume_id GROUP BY d.resume_id, v.category, v.weight, v.gate"


_CO = "SELECT resume_id, round_even(greatest(0.0, least(100.0, sum(score * weight) / sum(weight))), 1) AS composite FROM {s} GROUP BY 1"

ORACLES = {
    "place_conflicts_dropped": f"WITH {_P} SELECT * FROM an",
    "place_any": f"WITH {_P} SELECT resume_id, criterion_id, CASE WHEN bool_or(met) THEN true WHEN count(met) < count(*) THEN NULL ELSE false END AS met FROM bo GROUP BY 1, 2",
    "place_every_group": f"""WITH {_P}, g AS (SELECT resume_id, split_part(criterion_id, '/', 1) AS slug, criterion_id, coalesce(bool_or(met), false) AS y, count(met) = count(*) AS f FROM bo GROUP BY 1, 2, 3)
SELECT resume_id, slug, CASE WHEN bool_or(NOT y AND f) THEN false WHEN bool_or(NOT y AND NOT f) THEN NULL ELSE true END AS met FROM g GROUP BY 1, 2""",
    "agree_band_verdicts": f"""WITH {PJ._B}, p AS (SELECT slug, resume_id, provider, min(position) AS lo, max(position) AS hi FROM bb GROUP BY 1, 2, 3), u AS (SELECT slug, resume_id, bool_or(lo <> hi) AS u FROM p GROUP BY 1, 2),
g AS (SELECT a.slug, a.resume_id, max(a.hi - b.lo) AS g FROM p a JOIN p b ON a.slug = b.slug AND a.resume_id = b.resume_id AND a.provider <> b.provider GROUP BY 1, 2),
s AS (SELECT u.slug, count(g) AS items, count(*) FILTER (g <= 0) AS exact, count(*) FILTER (g = 1) AS adjacent, count(*) FILTER (g > 1) AS far, CAST(sum(CAST(u AS BIGINT)) AS BIGINT) AS unstable FROM u LEFT JOIN g USING (slug, resume_id) GROUP BY 1)
SELECT *, CASE WHEN far > 0 OR adjacent > 1 THEN 'FAIL' WHEN adjacent > 0 OR unstable > 0 THEN 'look' ELSE 'pass' END AS verdict FROM s""",
    "agree_spread_verdicts": f"""WITH {PJ._B}, v AS (SELECT resume_id, provider, sample_no, avg({_VAL}[position + 1]) AS v FROM bb GROUP BY 1, 2, 3), p AS (SELECT resume_id, provider, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1, 2),
g AS (SELECT a.resume_id, max(a.hi - b.lo) AS g FROM p a JOIN p b ON a.resume_id = b.resume_id AND a.provider <> b.provider GROUP BY 1)
SELECT DISTINCT p.resume_id, round(g, 6) AS spread, CASE WHEN g <= 5 THEN 'pass' WHEN g <= 8 THEN 'look' WHEN g IS NOT NULL THEN 'FAIL' END AS verdict FROM p LEFT JOIN g USING (resume_id)""",
    "agree_offsets": f"""WITH {PJ._B}, v AS (SELECT slug, resume_id, provider, avg({_VAL}[position + 1]) AS v, row_number() OVER (PARTITION BY slug, resume_id ORDER BY provider) AS n FROM bb GROUP BY 1, 2, 3),
p AS (SELECT a.slug, b.v - a.v AS d FROM v a JOIN v b ON a.slug = b.slug AND a.resume_id = b.resume_id AND a.n = 1 AND b.n = 2), o AS (SELECT slug, avg(d) AS o FROM p GROUP BY 1)
SELECT p.slug, count(*) AS n, round(any_value(o), 6) AS "offset", round(max(abs(d - o)), 6) AS worst, round(avg(abs(d - o)), 6) AS mean_residual, count(*) FILTER (abs(d - o) <= 5) AS inside, count(*) FILTER (d > 0) AS higher FROM p JOIN o USING (slug) GROUP BY 1""",
    "key_scores": f"""WITH {PJ._A}, k AS (SELECT resume_id, criterion_id, bool_and(met) AS answer FROM a GROUP BY 1, 2 HAVING bool_and(met) = bool_or(met) AND count(DISTINCT provider) > 1), s AS (SELECT DISTINCT provider, sample_no FROM rp),
m AS (SELECT provider, sample_no, resume_id, criterion_id, bool_and(met) AS met FROM a GROUP BY 1, 2, 3, 4)
SELECT s.provider, s.sample_no, count(*) FILTER (m.met = k.answer) AS matched, count(*) FILTER (m.met <> k.answer) AS wrong, count(*) FILTER (m.met IS NULL) AS missing FROM s CROSS JOIN k LEFT JOIN m USING (provider, sample_no, resume_id, criterion_id) GROUP BY 1, 2""",
    "reply_try_buckets": f"WITH {PJ._R} SELECT resume_id, provider, CAST(floor(sample_no / 2) AS BIGINT) AS sample, count(*) AS tries FROM rp GROUP BY 1, 2, 3",
    "reply_planned_calls": f"WITH {PJ._R} SELECT p.provider, CAST(s AS INTEGER) AS sample_no, o AS objective, (SELECT count(*) FROM rp WHERE rp.provider = p.provider AND rp.sample_no = s) AS replies FROM (SELECT DISTINCT provider FROM rp) p, range(3) t(s), (VALUES ('clarity'), ('impact'), ('brevity')) v(o)",
    "band_split_moves": f"""WITH {PJ._LUT}, x AS (SELECT *, {_VAL}[position + 1] AS v FROM lt), d AS (SELECT a.slug AS scheme, CAST(k + 1 AS INTEGER) AS criterion, abs(a.v - b.v) * (1 - {_case('a.slug', RULE_SHARES)}) * {_case('a.slug', SLUG_WEIGHTS)} / {sum(WEIGHTS.values())}::DOUBLE AS d FROM x a CROSS JOIN range(5) r(k) JOIN x b ON b.slug = a.slug AND b.mask = xor(a.mask, 1 << k) WHERE a.v <> b.v)
SELECT scheme, criterion, round(max(d), 6) AS widest, round(min(d), 6) AS least FROM d GROUP BY 1, 2""",
    "score_capped_severity": f"SELECT provenance, severity, {_SEVC} AS held, count(*) AS findings FROM (SELECT DISTINCT finding_id, severity, provenance FROM findings) GROUP BY 1, 2, 3",
    "score_finding_costs": f"WITH {_FC} SELECT finding_id, cost FROM c",
    "score_categories": f"WITH {_FC}, s AS ({_scores('c', True)}) SELECT resume_id, category, round(score, 6) AS score FROM s",
    "score_gates": f"WITH {_FC}, s AS ({_scores('c', True)}) SELECT resume_id, " + ", ".join(f"round_even(sum(score * weight) FILTER (gate = '{g}') / sum(weight) FILTER (gate = '{g}'), 1) AS {g}" for g in ("parser", "recruiter", "manager")) + " FROM s GROUP BY 1",
    "score_capped": f"""WITH {_FC}, s AS ({_scores('c', True)}), o AS ({_CO.format(s='s')}), h AS (SELECT resume_id, min(x) AS cap, arg_min(rule_id, (x, rule_id)) AS rule FROM (SELECT resume_id, rule_id, {_case('rule_id', RULE_CAPS)}::DOUBLE AS x FROM findings) WHERE x IS NOT NULL GROUP BY 1)
SELECT o.resume_id, composite, CASE WHEN cap < composite THEN cap ELSE composite END AS capped, CASE WHEN cap < composite THEN rule END AS cap_rule FROM o LEFT JOIN h ON h.resume_id = o.resume_id""",
    "score_running_ledger": f"WITH {PS._L} SELECT resume_id, ord, label, CAST(10000 - sum(cost) OVER (PARTITION BY resume_id ORDER BY ord) AS BIGINT) AS total FROM l",
    "score_sides": f"""WITH {_FC}, dt AS (SELECT * FROM c WHERE finding_id IN (SELECT finding_id FROM findings WHERE finding_source = 'deterministic')), s AS ({_scores('c', False)}), t AS ({_scores('dt', False)}), a AS ({_CO.format(s='s')}), b AS ({_CO.format(s='t')}),
d AS (SELECT b.composite - a.composite AS d FROM a JOIN b ON a.resume_id = b.resume_id) SELECT count(*) FILTER (round(d, 6) < 0) AS lower, count(*) FILTER (round(d, 6) > 0) AS higher, count(*) FILTER (round(d, 6) = 0) AS unchanged, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS most FROM d""",
    "budget_worst_case": """WITH t AS (SELECT source, ceil(length(coalesce(text, '')) / 3.0::DOUBLE) AS n FROM documents), c AS (SELECT source, count(*) AS documents, 6 * sum(n * 0.1::DOUBLE + 16000 * 0.5::DOUBLE) / 1e6 AS d FROM t GROUP BY 1),
b AS (SELECT *, CAST(floor(round((2.0::DOUBLE - d) / (6 * documents * 0.5::DOUBLE / 1e6), 6)) AS BIGINT) + 16000 AS m FROM c) SELECT source, documents, round(d, 6) AS dollars, d <= 2.0 AS fits, CASE WHEN m >= 1 THEN m END AS largest_cap FROM b""",
    "rewrite_sweep": f"""WITH {CL._J}, i AS (SELECT *, ascii(provider) - 96 AS i FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY resume_id, locator, n ORDER BY rank DESC, i) AS r FROM i, range(1, 5) t(n) WHERE n >= i)
SELECT CAST(n AS INTEGER) AS n, count(*) AS bullets, round(avg(rank), 6) AS rank, round(avg(audit), 6) AS audit, count(*) FILTER (problems = 0) AS clean FROM n WHERE r = 1 GROUP BY 1""",
    "rule_role_retelling": f"""WITH {_VALID}, s AS (SELECT resume_id, role_ix, row_number() OVER (PARTITION BY resume_id ORDER BY role_ix, bullet_ix) - 1 AS ix, list_distinct(regexp_extract_all(lower(bullet), '[\\pL\\pN]+')) AS w FROM located WHERE bullet IS NOT NULL),
d AS (SELECT b.resume_id, b.role_ix, b.ix, arg_min(a.role_ix, a.ix) AS first_role FROM s a JOIN s b ON a.resume_id = b.resume_id AND a.ix < b.ix AND len(list_intersect(a.w, b.w)) > 0.8 * greatest(len(a.w), len(b.w)) GROUP BY 1, 2, 3)
SELECT resume_id, role_ix, first_role, count(*) AS bullets FROM d WHERE role_ix <> first_role GROUP BY 1, 2, 3""",
    "sample_seeded_draw": "WITH d AS (SELECT DISTINCT doc_id, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('draw-1:' || doc_id), doc_id) AS place FROM d) SELECT source, place, doc_id FROM r WHERE place <= 3",
    "extract_redacted": "WITH f AS (SELECT DISTINCT finding_id, resume_id, rule_id, evidence FROM findings), n AS (SELECT resume_id, rank() OVER (ORDER BY md5(CAST(resume_id AS VARCHAR))) AS n FROM (SELECT DISTINCT resume_id FROM f)) SELECT finding_id, 'private_resume_' || n AS resume, rule_id, CAST(length(evidence) AS INTEGER) AS quoted FROM f JOIN n USING (resume_id)",
    "report_cache": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND ORDER BY ts DESC, event_id DESC LIMIT 24",
    "listing_documents": "SELECT regexp_replace(doc_name, '\\.[^./]*$', '') AS name, count(*) AS times, arg_max(resume_id, (extracted_at, resume_id)) AS latest FROM (SELECT DISTINCT resume_id, doc_name, extracted_at FROM resumes WHERE doc_name IS NOT NULL) GROUP BY 1",
    "reply_clipped": f"WITH {PJ._A} SELECT judgment_id, criterion_id, left(evidence, 40) AS evidence FROM a WHERE NOT met AND evidence <> ''",
}
_AUTHORED = {k: v for k, v in WEIGHTS.items() if GATES[k] != "manager" or k == "Resume craft"}
ORACLES["weights_all"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE, 'authored')" for k, v in _AUTHORED.items()) + f") v(name, weight, kind) UNION ALL SELECT dimension, weight, 'derived' FROM ({corpus.ORACLES['tax_derived_weights']})"
