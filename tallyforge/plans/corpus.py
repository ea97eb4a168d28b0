"""Queries over the corpus of postings and documents: terms, weights, coverage, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import corpus as C
from tallyforge.operators import scoring as S
from tallyforge.sources.tables import table

#: What a posting asks for, by pattern. Fixed values of the queries.
DIMENSIONS = {
    "production": r"in production|on-call|on call",
    "measurement": r"measure|evaluation",
    "years": r"[0-9]+ (?:years|months)",
    "collaboration": r"work with|explain",
}


#: The eight families of what a posting may ask for. "Your own" and the like is taken out before. Fixed values.
_SHIP, _PLACE = r"(?:ship(?:s|ped|ping)?|deploy(?:s|ed|ing)?|launch(?:es|ed|ing)?|deliver(?:s|ed|ing)?|release[sd]?|releasing)", r"(?:production|prod|customers?|users?)"
FAMILIES = {
    "production": rf"\b(?:in|into|to|reach(?:ed|ing)?|within)\s+production\b|\bproduction[- ](?:grade|quality|code|system|systems|service|services|environment|application|applications|llm|ml|ai|logs|traffic|readiness|ready)\b|\b{_SHIP}\b[^.]{{0,40}}\b{_PLACE}\b|\bon.call\b|\bincident (?:response|management)\b|\bsl[ao]s?\b|\b(?:live|real|production)\s+traffic\b",
    "ownership": r"\bown(?:s|ed|ing|ership)\b|\bown\b|\bend[ -]?to[ -]?end\b|\bafter launch\b|\bfull(?: project| product)? lifecycle\b",
    "reliability": r"\breliabilit(?:y|ies)\b|\breliable\b|\brobustness\b|\buptime\b|\bavailability\b|\bguardrails?\b|\btrustworthy\b|\bauditability\b|\bauditable\b|\bmonitor(?:s|ed|ing)?\b|\b(?:failure|error) (?:modes?|analysis|handling)\b",
    "agentic": r"\bagentic\b|\bagents?\b|\btool[- ](?:use|using|calling)\b|\bautonomous\b|\bautonomy\b",
    "evaluation": r"\bevals?\b|\bevaluations?\b|\bevaling\b|\bbenchmark(?:s|ed|ing)?\b|\ba/b test|\bmeasure\b[^.]{0,40}\b(?:quality|performance|regressions?|accuracy)\b",
    "ai_assisted_coding": r"\bai[- ]assisted\b|\bai[- ](?:coding|dev|development)\b|\b(?:coding|dev|development)\s+(?:models?|agents?|assistants?)\b|\bagentic (?:development|coding|engineering)\b|\b(?:copilot|cursor|codeium|windsurf|aider)\b|\b(?:with|using)\s+ai\s+(?:coding\s+)?tools?\b",
    "seniority": r"ambiguous problems?|\bambiguity\b|\b0 ?(?:to|-) ?1\b|greenfield|minimal (?:guidance|oversight|supervision)|self.directed",
    "experience_gate": r"\b\d+\+?\s*(?:-|to)?\s*\d*\+?\s*years?\b[^.]{0,40}\bexperience\b|\bexperience\b[^.]{0,20}\b\d+\+?\s*years?\b",
}
_THEIRS = r"\b(?:your|our|their|my|its) own\b"
#: Which families each judged category unites. Fixed value.
UNIONS = {"Production ownership": ("production", "ownership", "reliability"), "Agentic systems": ("agentic",), "Evaluation rigour": ("evaluation",), "AI-assisted coding fluency": ("ai_assisted_coding",)}


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "postings", "posting_id", "company", "raw_text").distinct().filter("raw_text IS NOT NULL")


def _families(spark: SparkSession, folder: str) -> DataFrame:
    """Families with their aliases, the family's own name among them."""
    tax = table(spark, folder, "taxonomy", "family", "aliases")
    return tax.select("family", F.explode(F.concat(F.array("family"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).distinct()


def _role_terms(spark: SparkSession, folder: str) -> DataFrame:
    roles = table(spark, folder, "resume_roles", "resume_id", "title").distinct().filter("title IS NOT NULL")
    return C.mentions(roles, "resume_id", "title", _families(spark, folder), "family", "alias")


def tax_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Taxonomy families named in documents, with how often."""
    docs = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return C.mentions(docs, "doc_id", "text", _families(spark, folder), "family", "alias").withColumnRenamed("term", "family")


def tax_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    hits = tax_mentions(spark, folder).withColumnRenamed("family", "term")
    out = C.document_frequency(hits, "doc_id", "term")
    return out.withColumnRenamed("term", "family")


def tax_ranked_top20(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty words of four letters or more that most documents of a kind use."""
    docs = table(spark, folder, "documents", "doc_kind", "doc_id", "text")
    ws = docs.select("doc_kind", "doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).filter(F.length("word") >= 4)
    df = ws.groupBy("doc_kind", "word").agg(F.count("*").alias("docs"))
    out = C.top_per_group(df, ["doc_kind"], [F.desc("docs"), "word"], 20)
    return out.select("doc_kind", F.col("place").cast("long").alias("place"), "word", "docs")


def tax_dimension_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Which dimensions each posting states."""
    return _postings(spark, folder).select("posting_id", *(F.lower("raw_text").rlike(p).alias(k) for k, p in DIMENSIONS.items()))


def tax_families(spark: SparkSession, folder: str) -> DataFrame:
    """Postings and documents that state each family, by number."""
    posts = _postings(spark, folder).select(F.lit("posting").alias("kind"), F.lower("raw_text").alias("t"))
    docs = table(spark, folder, "documents", "text").filter("text IS NOT NULL").select(F.lit("document").alias("kind"), F.lower("text").alias("t"))
    plain = F.regexp_replace("t", _THEIRS, " ")
    return posts.unionByName(docs).select("kind", plain.alias("t")).groupBy("kind").agg(F.count("*").alias("texts"), *(F.count_if(F.col("t").rlike(p)).alias(k) for k, p in FAMILIES.items()))


def tax_category_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that state any family of a category, and the weight a budget of 50 gives it."""
    docs = table(spark, folder, "documents", "text").filter("text IS NOT NULL").select(F.regexp_replace(F.lower("text"), _THEIRS, " ").alias("t"))
    sums = docs.agg(*(F.count_if(F.col("t").rlike("|".join(FAMILIES[f] for f in fs))).alias(c) for c, fs in UNIONS.items()))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("documents")) for c in UNIONS))).alias("x")).select("x.*")
    return S.derived_weights(rows, "documents", 50.0)


def tax_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per company its postings, distinct titles in the order first seen, and first and last date."""
    posts = table(spark, folder, "postings", "posting_id", "company", "title", "date_added").distinct().filter("company IS NOT NULL AND title IS NOT NULL")
    company = F.lower(T.stripped(F.col("company")))
    first = posts.groupBy(company.alias("company"), "title").agg(F.min("posting_id").alias("p"), F.countDistinct("posting_id").alias("n"), F.min("date_added").alias("a"), F.max("date_added").alias("b"))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("p", "title"))), lambda x: x["title"])
    return first.groupBy("company").agg(F.sum("n").alias("postings"), F.md5(F.array_join(titles, "|")).alias("titles"), F.min("a").alias("first_date"), F.max("b").alias("last_date"))


def tax_common8(spark: SparkSession, folder: str) -> DataFrame:
    """The eight commonest words of four letters or more of each language code's documents."""
    ws = table(spark, folder, "documents", "lang", "text").select("lang", F.explode(T.tokens(F.col("text"))).alias("word")).filter(F.length("word") >= 4)
    out = C.top_per_group(ws.groupBy("lang", "word").agg(F.count("*").alias("times")), ["lang"], [F.desc("times"), "word"], 8)
    return out.select("lang", F.col("place").cast("long").alias("place"), "word", "times")


def tax_derived_weights(spark: SparkSession, folder: str) -> DataFrame:
    """A budget of 50 shared out by the postings that state each dimension."""
    flags = tax_dimension_flags(spark, folder)
    sums = flags.agg(*(F.count_if(F.col(k)).alias(k) for k in DIMENSIONS))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("postings")) for k in DIMENSIONS))).alias("x")).select("x.*")
    return S.derived_weights(rows, "postings", 50.0)


def tax_category_df_union(spark: SparkSession, folder: str) -> DataFrame:
    """Postings of each company that state any of two dimensions."""
    lower = F.lower("raw_text")
    both = F.greatest(*(lower.rlike(DIMENSIONS[k]) for k in ("production", "measurement")))
    company = F.lower(T.stripped(F.col("company")))
    return _postings(spark, folder).filter("company IS NOT NULL").groupBy(company.alias("company")).agg(F.countDistinct("posting_id").alias("postings"), F.countDistinct(F.when(both, F.col("posting_id"))).alias("stating"))


def tax_weighted_required_nice(spark: SparkSession, folder: str) -> DataFrame:
    """Brands weighed by required (R) and nice (A) lines: (R + 0.4 A) / all, three decimals."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand")
    lines = table(spark, folder, "lineitem", "l_partkey", "l_returnflag")
    n = F.count("*")
    sums = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("required"), F.count_if(F.col("l_returnflag") == "A").alias("nice"), n.alias("total"))
    return sums.select("p_brand", "required", "nice", F.bround((5 * F.col("required") + 2 * F.col("nice")) / (5 * F.col("total")), 3).alias("weight"))


def tax_coverage_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Of the brands of each type of part, those each supplier delivers."""
    parts = table(spark, folder, "part", "p_partkey", "p_type", "p_brand")
    held = table(spark, folder, "lineitem", "l_suppkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    out = C.coverage_by_group(parts.withColumn("term", F.concat_ws("/", "p_type", "p_brand")), held.withColumn("term", F.concat_ws("/", "p_type", "p_brand")), "l_suppkey", "p_type", "term")
    return out.select("l_suppkey", "p_type", "matched", "total")


def tax_thin_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Types of part of which a supplier delivers fewer than nine in ten of the brands."""
    return tax_coverage_by_group(spark, folder).filter(10 * F.col("matched") < 9 * F.col("total"))


def tax_coverage_score(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the weight of all brands that a supplier's brands hold; 1 if nothing weighs."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_size")
    weights = parts.groupBy("p_brand").agg(F.sum("p_size").alias("w"))
    held = table(spark, folder, "lineitem", "l_suppkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    total = weights.agg(F.sum("w").alias("total"))
    sums = held.join(weights, "p_brand").groupBy("l_suppkey").agg(F.sum("w").alias("matched"))
    return sums.join(F.broadcast(total)).select("l_suppkey", "matched", F.coalesce(F.bround(F.col("matched") / F.nullif(F.col("total"), F.lit(0)), 4), F.lit(1.0)).alias("coverage"))


def tax_jd_gap_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Families of posting titles that no role of a résumé names, for résumés that name any."""
    posts = table(spark, folder, "postings", "posting_id", "title").distinct().filter("title IS NOT NULL")
    asked = C.mentions(posts, "posting_id", "title", _families(spark, folder), "family", "alias").groupBy("term").agg(F.collect_set("posting_id").alias("p")).select("term")
    wanted = asked.agg(F.array_sort(F.collect_set("term")).alias("wanted"))  # the taxonomy bounds it
    held = _role_terms(spark, folder).groupBy("resume_id").agg(F.collect_set("term").alias("held"))
    gaps = held.join(F.broadcast(wanted)).select("resume_id", F.explode(F.array_except("wanted", "held")).alias("family"))
    return gaps


def tax_top_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The four first gaps of each résumé by the taxonomy's document frequency."""
    weight = table(spark, folder, "taxonomy", "family", "title", "doc_frequency").filter("title = family").select("family", "doc_frequency")
    gaps = tax_jd_gap_anti(spark, folder).join(weight, "family")
    out = C.top_per_group(gaps, ["resume_id"], [F.desc("doc_frequency"), "family"], 4)
    return out.select("resume_id", F.col("place").cast("long").alias("place"), "family")


def seniority_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Roles titled junior that lasted 30 months or more."""
    r = table(spark, folder, "resume_roles", "resume_id", "role_ix", "title", "start_date", "end_date").distinct()
    months = (F.year("end_date") - F.year("start_date")) * 12 + F.month("end_date") - F.month("start_date")
    return r.filter(F.lower("title").rlike(r"\b(?:junior|jr|jnr|intern)\b") & (months >= 30)).select("resume_id", "role_ix", months.cast("long").alias("months"))


QUERIES = {
    f.__name__: f
    for f in (
        tax_mentions, tax_document_frequency, tax_ranked_top20, tax_dimension_flags, tax_families, tax_category_frequency, tax_digest, tax_common8, tax_derived_weights, tax_category_df_union, tax_weighted_required_nice, tax_coverage_by_group,
        tax_thin_groups, tax_coverage_score, tax_jd_gap_anti, tax_top_gaps, seniority_mismatch,
    )
}

_FAM = "fam AS (SELECT DISTINCT family, array_to_string(regexp_extract_all(lower(alias), '[\\pL\\pN]+'), ' ') AS g FROM (SELECT family, unnest(list_concat([family], coalesce(aliases, []))) AS alias FROM taxonomy))"


def _mentions(source: str, key: str, text: str) -> str:
    return f"""{_FAM}, w AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '[\\pL\\pN]+') AS w FROM {source} WHERE {text} IS NOT NULL),
p AS (SELECT k, w, unnest(generate_series(1, len(w))) AS i FROM w), n AS (SELECT *, unnest([1, 2, 3, 4]) AS n FROM p),
g AS (SELECT k, array_to_string(w[i:i + n - 1], ' ') AS g FROM n WHERE i + n - 1 <= len(w)), m AS (SELECT k, family, count(*) AS mentions FROM g JOIN fam USING (g) GROUP BY 1, 2)"""


_DIM = ", ".join(f"regexp_matches(lower(raw_text), '{p}') AS {k}" for k, p in DIMENSIONS.items())
_POST = "po AS (SELECT DISTINCT posting_id, company, raw_text FROM postings WHERE raw_text IS NOT NULL)"
_COV = """t AS (SELECT DISTINCT p_type, p_brand FROM part), n AS (SELECT p_type, count(*) AS total FROM t GROUP BY 1),
h AS (SELECT DISTINCT l_suppkey, p_type, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT l_suppkey, p_type, count(*) AS matched, any_value(total) AS total FROM h JOIN n USING (p_type) GROUP BY 1, 2)"""
_GAP = _mentions("(SELECT DISTINCT resume_id, title FROM resume_roles)", "resume_id", "title") + ", pf AS (SELECT DISTINCT f FROM (WITH " + _mentions("(SELECT DISTINCT posting_id, title FROM postings)", "posting_id", "title") + " SELECT family AS f FROM m)), gp AS (SELECT r.k AS resume_id, pf.f AS family FROM (SELECT DISTINCT k FROM m) r CROSS JOIN pf LEFT JOIN m ON m.k = r.k AND m.family = pf.f WHERE m.k IS NULL)"

ORACLES = {
    "tax_mentions": f"WITH {_mentions('documents', 'doc_id', 'text')} SELECT k AS doc_id, family, mentions FROM m",
    "tax_document_frequency": f"WITH {_mentions('documents', 'doc_id', 'text')} SELECT family, count(*) AS doc_frequency, CAST(sum(mentions) AS BIGINT) AS total_mentions FROM m GROUP BY 1",
    "tax_ranked_top20": """WITH w AS (SELECT DISTINCT doc_kind, doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS word FROM documents), d AS (SELECT doc_kind, word, count(*) AS docs FROM w WHERE length(word) >= 4 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY docs DESC, word) AS place FROM d) SELECT doc_kind, place, word, docs FROM r WHERE place <= 20""",
    "tax_dimension_flags": f"WITH {_POST} SELECT posting_id, {_DIM} FROM po",
    "tax_derived_weights": f"WITH {_POST}, f AS (SELECT {_DIM} FROM po), s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, count(*) FILTER ({k}) AS postings FROM f" for k in DIMENSIONS) + ") SELECT dimension, postings, coalesce(round_even(50.0::DOUBLE * postings / nullif(sum(postings) OVER (), 0), 2), 0.0) AS weight FROM s",
    "tax_category_df_union": f"""WITH {_POST} SELECT lower(regexp_replace(company, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')) AS company, count(DISTINCT posting_id) AS postings,
  count(DISTINCT posting_id) FILTER (regexp_matches(lower(raw_text), '{DIMENSIONS['production']}') OR regexp_matches(lower(raw_text), '{DIMENSIONS['measurement']}')) AS stating FROM po WHERE company IS NOT NULL GROUP BY 1""",
    "tax_weighted_required_nice": """WITH s AS (SELECT p_brand, count(*) FILTER (l_returnflag = 'R') AS required, count(*) FILTER (l_returnflag = 'A') AS nice, count(*) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, required, nice, round_even(CAST(5 * required + 2 * nice AS DOUBLE) / (5 * total), 3) AS weight FROM s""",
    "tax_coverage_by_group": f"WITH {_COV} SELECT l_suppkey, p_type, matched, total FROM c",
    "tax_thin_groups": f"WITH {_COV} SELECT l_suppkey, p_type, matched, total FROM c WHERE 10 * matched < 9 * total",
    "tax_coverage_score": """WITH w AS (SELECT p_brand, sum(p_size) AS w FROM part GROUP BY 1), h AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT l_suppkey, CAST(sum(w) AS BIGINT) AS matched FROM h JOIN w USING (p_brand) GROUP BY 1) SELECT l_suppkey, matched, round_even(CAST(matched AS DOUBLE) / (SELECT sum(w) FROM w), 4) AS coverage FROM s""",
    "tax_jd_gap_anti": f"WITH {_GAP} SELECT resume_id, family FROM gp",
    "tax_top_gaps": f"""WITH {_GAP}, r AS (SELECT resume_id, gp.family, row_number() OVER (PARTITION BY resume_id ORDER BY doc_frequency DESC, gp.family) AS place FROM gp JOIN taxonomy t ON t.family = gp.family AND t.title = t.family) SELECT resume_id, place, family FROM r WHERE place <= 4""",
    "seniority_mismatch": """SELECT resume_id, role_ix, m AS months FROM (SELECT DISTINCT resume_id, role_ix, title, (year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) AS m, start_date, end_date FROM resume_roles)
WHERE regexp_matches(lower(title), '\\b(?:junior|jr|jnr|intern)\\b') AND m >= 30""",
}
_LOW = lambda c: f"regexp_replace(lower({c}), '{_THEIRS}', ' ', 'g')"
ORACLES["tax_families"] = f"WITH {_POST}, t AS (SELECT 'posting' AS kind, {_LOW('raw_text')} AS t FROM po UNION ALL SELECT 'document', {_LOW('text')} FROM documents WHERE text IS NOT NULL) SELECT kind, count(*) AS texts, " + ", ".join(f"count(*) FILTER (regexp_matches(t, '{p}')) AS {k}" for k, p in FAMILIES.items()) + " FROM t GROUP BY 1"
ORACLES["tax_category_frequency"] = f"WITH t AS (SELECT {_LOW('text')} AS t FROM documents WHERE text IS NOT NULL), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) FILTER (regexp_matches(t, '{'|'.join(FAMILIES[f] for f in fs)}')) AS documents FROM t" for c, fs in UNIONS.items()) + ") SELECT category, documents, coalesce(round_even(50.0::DOUBLE * documents / nullif(sum(documents) OVER (), 0), 2), 0.0) AS weight FROM s"
ORACLES["tax_digest"] = r"""WITH p AS (SELECT DISTINCT posting_id, lower(regexp_replace(company, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS company, title, date_added FROM postings WHERE company IS NOT NULL AND title IS NOT NULL),
f AS (SELECT company, title, min(posting_id) AS p, count(DISTINCT posting_id) AS n, min(date_added) AS a, max(date_added) AS b FROM p GROUP BY 1, 2) SELECT company, CAST(sum(n) AS BIGINT) AS postings, md5(string_agg(title, '|' ORDER BY p, title)) AS titles, min(a) AS first_date, max(b) AS last_date FROM f GROUP BY 1"""
ORACLES["tax_common8"] = r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS times FROM w WHERE length(word) >= 4 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY times DESC, word) AS place FROM c) SELECT lang, place, word, times FROM r WHERE place <= 8"""
