"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import boilerplate, consensus, leakage, packing, personal, titles, truncation, twins
from tallyforge.sources.tables import table


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "title")
    return titles.map_to_reference(roles, ["resume_id", "role_ix"], "title", table(spark, folder, "taxonomy"), "title_id", "title", "family", "aliases")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every titled role with the taxonomy entry it means, -1 if none."""
    return _titles(spark, folder).select("resume_id", "role_ix", "title_id")


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that mean no entry, with the roles that bear them."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "title")
    missing = _titles(spark, folder).filter("title_id = -1")
    return roles.join(missing, ["resume_id", "role_ix"], "left_semi").distinct().groupBy("title").agg(F.count("*").alias("roles"))


#: The searched fields: table, key, column.
FIELDS = (("resumes", "resume_id", "text"), ("findings", "finding_id", "evidence"), ("resumes", "resume_id", "contact_email"))


def _per_field(spark: SparkSession, folder: str, operator) -> DataFrame:
    out = None
    for name, key, column in FIELDS:
        part = operator(table(spark, folder, name, key, column), key, column).withColumnRenamed(key, "row_id")
        part = part.withColumn("field_name", F.lit(f"{name}.{column}"))
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every personal detail, with its place."""
    return _per_field(spark, folder, personal.personal_details).select("field_name", "row_id", "kind", "char_start")


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts with a typed placeholder for each detail."""
    return _per_field(spark, folder, personal.redacted).select("field_name", "row_id", "clean_text", "details")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines repeated across the postings of a company."""
    return boilerplate.repeated_lines(table(spark, folder, "postings", "posting_id", "company", "raw_text"), "posting_id", "company", "raw_text")


def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The longest blocks of lines repeated across the postings of a company."""
    docs = boilerplate.documents_with_ids(table(spark, folder, "postings", "posting_id", "company", "raw_text"), "posting_id", "company", "raw_text")
    found = boilerplate.maximal_blocks(boilerplate.repeated_blocks(docs))
    return found.select(F.col("src").alias("company"), F.col("k").alias("lines"), "docs", F.xxhash64("block").alias("block"))


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every posting without those lines."""
    return boilerplate.without_repeated_lines(table(spark, folder, "postings", "posting_id", "company", "raw_text"), "posting_id", "company", "raw_text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Postings that agree with one of smaller id but for formatting."""
    classes = twins.twin_classes(table(spark, folder, "postings", "posting_id", "raw_text"), "posting_id", "raw_text")
    return classes.filter("posting_id > class_id").select(F.col("class_id").alias("first_posting_id"), "posting_id")


def p6_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One posting of each class with the number of its copies."""
    classes = twins.twin_classes(table(spark, folder, "postings", "posting_id", "raw_text"), "posting_id", "raw_text")
    return classes.filter("posting_id = class_id").select("posting_id", "copies")


#: The categories and criteria the judges answer. Fixed values.
SLUGS = ("agentic-systems", "ai-assisted-coding-fluency", "evaluation-rigour", "production-ownership", "resume-craft")
CRITERIA = ("C1", "C2", "C3", "C4", "C5")


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    replies = table(spark, folder, "judgments", "judgment_id", "resume_id", "provider", "categories")  # answers are read once a reply
    answers = consensus.reply_answers(replies, ["judgment_id", "resume_id", "provider"], "categories", SLUGS, CRITERIA)
    return consensus.votes_by_rater(answers, ["resume_id", "criterion_id"], "provider")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose consensus is yes."""
    items, _ = consensus.reweighted_consensus(_votes(spark, folder), ["resume_id", "criterion_id"])
    return items.filter("consensus").select("resume_id", "criterion_id")


def p7_reliability(spark: SparkSession, folder: str) -> DataFrame:
    """How far each provider can be relied on."""
    _, raters = consensus.reweighted_consensus(_votes(spark, folder), ["resume_id", "criterion_id"])
    return raters.select(F.col("rater").alias("provider"), *(F.round(c, 6).alias(c) for c in ("accuracy", "on_yes", "on_no")), F.round("answers").cast("long").alias("answers"))


def p7_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Chance-corrected agreement per criterion."""
    found = consensus.nominal_alpha(_votes(spark, folder), ["criterion_id"])
    return found.withColumn("alpha", F.round("alpha", 6))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_evidence(table(spark, folder, "documents", "doc_id", "source", "text"), "doc_id", "source", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut."""
    return _evidence(spark, folder).filter("is_cut").select("doc_id").distinct()


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The share cut in each source."""
    return truncation.truncation_by_source(_evidence(spark, folder), "source")


#: Where the tokenizer's rank file lies on every machine.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p8_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed into blocks of 2,048 tokens."""
    counts = packing.token_counts(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", RANKS)
    placed = packing.pack(counts, "doc_id", "n_tokens", 2048, text_id="text_id")
    return placed.withColumnsRenamed({"first_unit": "first_token", "n_units": "n_tokens"})


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text")
    return leakage.leaked_passages(docs, "doc_id", "text", items, "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold ten consecutive words of an item, and the item: the verified passages without any edit."""
    return _leaks(spark, folder).filter("edits = 0 AND words >= 10").select("doc_id", "item_id")


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """All leaked passages, those with a changed word among them."""
    return _leaks(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_unmatched, p3_found, p3_redacted, p5_found, p5_blocks, p5_cleaned, p6_found, p6_copies, p7_found, p7_reliability, p7_agreement, p8_blocks, p9_found, p9_near, p10_found, p10_sources)
}

ORACLES = {
    "p5_found": r"""
WITH rows_ AS (
  SELECT DISTINCT posting_id, lower(regexp_replace(company, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS src, raw_text FROM postings
), kept AS (
  SELECT * FROM rows_ WHERE src <> ''
), sizes AS (
  SELECT src, count(DISTINCT posting_id) AS n FROM kept GROUP BY 1
), numbered AS (
  SELECT posting_id, src, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM kept
), ids AS (
  SELECT posting_id, src, line_no, regexp_replace(lower(line), '[^\pL\pM]+', '', 'g') AS id FROM numbered
  WHERE length(regexp_replace(regexp_replace(line, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'), '[\s\x{a0}]+', ' ', 'g')) >= 30
), often AS (
  SELECT src, id, count(DISTINCT posting_id) AS docs FROM ids GROUP BY 1, 2
)
SELECT DISTINCT i.posting_id, CAST(i.line_no AS INTEGER) AS line_no
FROM ids i JOIN often o ON i.src = o.src AND i.id = o.id JOIN sizes s ON i.src = s.src
WHERE o.docs >= 5 AND o.docs >= s.n * 0.2
""",
    "p9_found": r"""
WITH texts AS (
  SELECT 'd' AS t, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items
), words AS (
  SELECT t, id, regexp_extract_all(lower(regexp_replace(text, '([\pL\pN])[-‐‑\x{ad}][ \t]*\r?\n\s*([\pL\pN])', '\1\2', 'g')), '[\pL\pN]+') AS w FROM texts WHERE text IS NOT NULL
), places AS (
  SELECT t, id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM words WHERE len(w) >= 10
), grams AS (
  SELECT DISTINCT t, id, array_to_string(w[i:i + 9], ' ') AS g FROM places
)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g WHERE d.t = 'd' AND i.t = 'i'
""",
}
