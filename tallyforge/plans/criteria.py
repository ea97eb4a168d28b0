"""Queries of the criterion judge: specs of every kind over résumés, and the bands their answers buy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import claims as C
from tallyforge.operators import criteria as K
from tallyforge.operators import judging as J
from tallyforge.plans import claims as Q
from tallyforge.plans import judging as PJ
from tallyforge.plans import rules as R

#: Specs of the queries, with short lists of words; a folder of specs is read by read_specs.
SPECS = {
    "ai-assisted-coding-fluency": [
        {"id": "C1", "kind": "alias", "words": ["agent", "assistant", "prompt", "prompt registry"]}, {"id": "C2", "kind": "alias_in", "anchor": "C1", "words": ["built", "wrote", "migrated", "rebuilt"]},
        {"id": "C3", "kind": "alias_in", "anchor": "C1", "words": ["cut", "reduced", "serving", "with"]}, {"id": "C4", "kind": "number_in", "anchor": "C3"}, {"id": "C5", "kind": "none"},
    ],
    "production-ownership": [
        {"id": "C1", "kind": "alias", "words": ["production", "shipped", "rolled out", "on call"]}, {"id": "C2", "kind": "named_in", "anchor": "C1"}, {"id": "C3", "kind": "alias", "words": ["incidents", "requests", "latency", "pager load"]},
        {"id": "C4", "kind": "alias", "words": ["maintained", "owned", "was on call"]}, {"id": "C5", "kind": "unhedged_in", "anchor": "C1"},
    ],
    "evaluation-rigour": [
        {"id": "C1", "kind": "alias", "words": ["evaluation", "measured", "regression", "quality"]}, {"id": "C2", "kind": "number_in", "anchor": "C1"}, {"id": "C3", "kind": "alias", "requires": "C1", "words": ["samples", "cases", "set"]},
        {"id": "C4", "kind": "alias", "requires": "C1", "words": ["before"], "patterns": [r"\bfrom\s+\$?\d", r"\b\d+(?:\.\d+)?%?\s+to\s+\$?\d"]}, {"id": "C5", "kind": "alias", "requires": "C1", "words": ["failure", "fell", "drift"]},
    ],
    "resume-craft": [{"id": "C1", "kind": "identity"}, {"id": "C2", "kind": "outcome_per_role"}, {"id": "C3", "kind": "alias", "words": ["support", "claims", "policy"]}, {"id": "C4", "kind": "roles_differ"}, {"id": "C5", "kind": "unportable"}],
}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (resume_id, text, summary, roles) of résumés with text and roles."""
    texts = R._texts(spark, folder).select("resume_id", "text", "summary")
    bullets = F.coalesce(F.filter("bullets", lambda b: b.isNotNull()), F.array().cast("array<string>"))
    roles = R._roles(spark, folder).groupBy("resume_id").agg(F.array_sort(F.collect_list(F.struct("role_ix", "heading", bullets.alias("bullets")))).alias("roles"))
    return texts.join(roles, "resume_id")


def _answers(spark: SparkSession, folder: str, slug: str) -> DataFrame:
    return K.answered(_documents(spark, folder), "resume_id", {"slug": slug, "criteria": SPECS[slug]}).select("resume_id", "criterion", "met", F.md5("evidence").alias("evidence"))


def criteria_assisted(spark: SparkSession, folder: str) -> DataFrame:
    """Words in a bullet, words and numbers in the bullet of another criterion, and one no pattern can answer."""
    return _answers(spark, folder, "ai-assisted-coding-fluency")


def criteria_ownership(spark: SparkSession, folder: str) -> DataFrame:
    """Names in the role of another criterion's bullet, and whether that bullet is the writer's own."""
    return _answers(spark, folder, "production-ownership")


def criteria_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria that ask nothing where another one is unmet."""
    return _answers(spark, folder, "evaluation-rigour")


def criteria_craft(spark: SparkSession, folder: str) -> DataFrame:
    """Questions about whole documents."""
    return _answers(spark, folder, "resume-craft")


def criteria_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The band each complete set of answers buys."""
    out = None
    for slug in ("production-ownership", "evaluation-rigour", "resume-craft"):
        part = _answers(spark, folder, slug).withColumn("slug", F.lit(slug))
        out = part if out is None else out.unionByName(part)
    bit = F.when(F.col("met"), F.pow(F.lit(2), F.substring("criterion", 2, 1).cast("int") - 1)).otherwise(0).cast("int")
    sets = out.filter("met IS NOT NULL").groupBy("resume_id", "slug").agg(F.sum(bit).cast("int").alias("mask"), F.count("*").alias("n")).filter("n = 5")
    lut = J.band_table(spark, PJ.BANDS).withColumnRenamed("scheme", "slug")
    return sets.join(F.broadcast(lut), ["slug", "mask"]).select("resume_id", "slug", "mask", "band")  # 160 rows


QUERIES = {f.__name__: f for f in (criteria_assisted, criteria_ownership, criteria_evaluation, criteria_craft, criteria_bands)}

_D = f"""{R._TX}, {R._RO}, rl AS (SELECT resume_id, list({{'h': heading, 'b': list_filter(coalesce(bullets, []), lambda z: z IS NOT NULL)}} ORDER BY role_ix) AS roles FROM ro GROUP BY 1),
dc AS (SELECT tx.resume_id, tx.text, tx.summary, roles FROM tx JOIN rl ON rl.resume_id = tx.resume_id WHERE len(list_filter(roles, lambda r: len(r.b) > 0)) > 0)"""
_BM = f"""bu AS (SELECT DISTINCT b, {Q._metric('b')} AS m FROM (SELECT unnest(flatten(list_transform(roles, lambda r: r.b))) AS b FROM dc)), bv AS (SELECT b, {Q._inv('b')} FROM bu),
bp AS (SELECT b, {R._PORT} > {K.PORTABLE} AND {R._NW} >= 8 AND NOT m AS bare FROM (SELECT *, regexp_replace(b, '{C.MARKED}', 'x', 'g') AS x FROM bu)),
ri AS (SELECT resume_id, unnest(roles) AS r, generate_subscripts(roles, 1) AS i FROM dc), rb AS (SELECT resume_id, i, unnest(r.b) AS b FROM ri),
oc AS (SELECT resume_id, bool_and(coalesce(o, false)) AS o FROM (SELECT ri.resume_id, ri.i, bool_or(outcome) AS o FROM ri LEFT JOIN rb ON rb.resume_id = ri.resume_id AND rb.i = ri.i LEFT JOIN bv ON bv.b = rb.b GROUP BY 1, 2) GROUP BY 1),
un AS (SELECT resume_id, NOT bool_or(bare) AS u FROM rb JOIN bp ON bp.b = rb.b GROUP BY 1),
rs AS (SELECT resume_id, i, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(r.b, ' ')), '\\w+'), lambda w: length(w) > 3)) AS w FROM ri),
df AS (SELECT d.resume_id, NOT coalesce(bool_or(len(list_intersect(a.w, b.w)) > {K.SAME} * greatest(len(a.w), len(b.w)) AND len(a.w) > 0 AND len(b.w) > 0), false) AS d FROM dc d LEFT JOIN rs a ON a.resume_id = d.resume_id LEFT JOIN rs b ON b.resume_id = a.resume_id AND a.i < b.i GROUP BY 1)"""


def _chain(slug: str) -> str:
    """CTEs s0, s1, ... that add m<id> and a<id> (the bullet and role that settle it) one criterion at a time."""
    none = "CAST(NULL AS STRUCT(b VARCHAR, r VARCHAR))"
    steps, last = [], "dc"
    for n, c in enumerate(SPECS[slug]):
        p = Q._q(K.word_pattern(c.get("words", ()), c.get("patterns", ())))
        a = f"a{c['anchor']}" if c.get("anchor") else none
        tests = {"alias_in": f"regexp_matches({a}.b, '{p}')", "number_in": f"regexp_matches({a}.b, '\\d')", "named_in": f"regexp_matches({a}.r, '{C.SPECIFIC}')", "unhedged_in": f"NOT (regexp_matches({a}.b, '{K.HEDGE}') OR regexp_matches({a}.b, '{C.TEAM_FIRST}') OR regexp_matches({a}.b, '{C.TEAM}'))"}
        if c["kind"] == "alias":
            held = f"flatten(list_transform(roles, lambda r: list_transform(list_filter(r.b, lambda z: regexp_matches(z, '{p}')), lambda z: {{'b': z, 'r': array_to_string(r.b, ' ')}})))[1]"
            met = f"({held}) IS NOT NULL"
        elif c["kind"] in tests:
            met = f"coalesce({tests[c['kind']]}, false)"
            held = f"CASE WHEN {met} THEN {a} END"
        else:
            head = "concat_ws(' ', summary, CASE WHEN length(roles[1].h) > 0 THEN split_part(text, roles[1].h, 1) ELSE text END)"
            met = {"none": "CAST(NULL AS BOOLEAN)", "identity": f"coalesce(regexp_matches({head}, '{K.IDENTITY}') AND regexp_matches({head}, '{K.LEVEL}'), false)", "outcome_per_role": "(SELECT o FROM oc WHERE oc.resume_id = x.resume_id)", "roles_differ": "(SELECT d FROM df WHERE df.resume_id = x.resume_id)", "unportable": "coalesce((SELECT u FROM un WHERE un.resume_id = x.resume_id), true)"}[c["kind"]]
            held = none
        if c.get("requires"):
            met, held = f"CASE WHEN m{c['requires']} THEN {met} ELSE false END", f"CASE WHEN m{c['requires']} THEN {held} END"
        steps.append(f"s{n} AS (SELECT *, {met} AS m{c['id']}, {held} AS a{c['id']} FROM {last} x)")
        last = f"s{n}"
    rows = " UNION ALL ".join(f"SELECT resume_id, '{c['id']}' AS criterion, m{c['id']} AS met, md5(CASE WHEN m{c['id']} THEN a{c['id']}.b END) AS evidence FROM {last}" for c in SPECS[slug])
    return f"{_D}, {_BM}, " + ", ".join(steps) + f", an AS ({rows})"


_NAMES = {"criteria_assisted": "ai-assisted-coding-fluency", "criteria_ownership": "production-ownership", "criteria_evaluation": "evaluation-rigour", "criteria_craft": "resume-craft"}
ORACLES = {name: f"WITH {_chain(slug)} SELECT * FROM an" for name, slug in _NAMES.items()}
_ALL = " UNION ALL ".join(f"SELECT *, '{_NAMES[n]}' AS slug FROM ({ORACLES[n]})" for n in ("criteria_ownership", "criteria_evaluation", "criteria_craft"))
ORACLES["criteria_bands"] = f"""WITH al AS ({_ALL}), st AS (SELECT resume_id, slug, {', '.join(f"bool_or(met AND criterion = 'C{i}') AS c{i}" for i in range(1, 6))}, count(*) FILTER (met) AS met, count(*) AS n FROM al WHERE met IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, CAST({' + '.join(f"CASE WHEN c{i} THEN {2 ** (i - 1)} ELSE 0 END" for i in range(1, 6))} AS INTEGER) AS mask, CAST({PJ._POS} AS INTEGER) AS position FROM st WHERE n = 5) SELECT resume_id, slug, mask, substr('EDCBA', position + 1, 1) AS band FROM b"""
