"""Queries over texts: normalisation, lines, sections, bullets, rules on bullets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import segments
from tallyforge.operators.intervals import latest_rows
from tallyforge.operators.roles import parsed_roles
from tallyforge.session import once
from tallyforge.sources.tables import table

SECTIONS = {"summary": "summary", "profile": "summary", "experience": "experience", "work experience": "experience", "employment": "experience", "skills": "skills", "education": "education", "references": "references", "personal": "personal", "personal details": "personal"}

#: Header lines of postings, as their bucket's phrases, in order of precedence, and the family of headings that say who
#: fits. Fixed values.
HEADERS = {
    "duties": "about the role|about this role|about the opportunity|the opportunity|the role|what you'll do|what you will do|what you'll be doing|responsibilities|your role|day to day|day-to-day|role overview|role scope|scope of the role",
    "required": r"what we're looking for|what we are looking for|what we expect|who you are|what you'll bring|what you will bring|your background|requirements|qualifications|minimum qualifications|basic qualifications|must haves|must-haves|required skills|skills & experience|skills and experience|about you|you have|what you need|what you'll need|what you will need|you (?:may|might|could|would) be an? (?:good|great|strong|ideal) fit(?: if you\b[a-z' ]*)?",
    "nice": "nice to have|nice-to-have|bonus points|bonus|preferred qualifications|preferred|extra credit|a plus|technical environment|core engineering stack|tech stack|our stack|technologies we use",
    "other": "benefits|perks|what we offer|compensation|about us|about the company|about the team|equal opportunity|how to apply|diversity|our values|who we are",
}
BUCKETS = {k: rf"^(?:{v}) ?:?$" for k, v in HEADERS.items()}
HEADER_CHARS = 60
#: Sentences that state a requirement or a duty. Fixed values.
REQUIREMENT = r"\byou (?:have|need|should have)\b|\bmust have\b|\bexperience (?:with|in)\b|\bproficiency (?:with|in)\b|\b\d+\+?\s*years?\b|\brequired\b"
DUTY = r"\byou(?:'| wi)ll\b|\byou will\b"
#: Typographic quotes, dashes and blanks, and the plain ones.
MARKS = ("‘’ʼ“”–—\u00a0", "'''" + '""' + "-- ")


def plain_marks(text):
    return F.translate(text, *MARKS)


RULES = {
    "dash_cluster": "—[^—\n]*—",
    "long_number": r"\d{5,}",
    "rhetorical": r"\?\s",
    "praise": r"\b(?:honest|thorough|patient|careful|practical)\b",
    "percent": r"\d+ ?%",
}


def _resumes(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "resumes", "resume_id", "text"), "resume_id")


def _bullets(spark: SparkSession, folder: str) -> DataFrame:
    """The bullets of each role's valid row."""
    roles = table(spark, folder, "resume_roles", "resume_id", "role_ix", "parsed_at", "bullets")
    valid = latest_rows(roles, ["resume_id", "role_ix"], ["parsed_at"], ["bullets"])
    return segments.located_bullets(valid, "resume_id", "role_ix", "bullets")


def scan_documents_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, blank lines and longest line of each document."""
    ls = T.lines(F.col("text"))
    return table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.size(ls).cast("long").alias("n_lines"), F.size(F.filter(ls, lambda x: ~x.rlike(r"\S"))).cast("long").alias("blank_lines"), F.array_max(F.transform(ls, F.length)).cast("long").alias("longest"))


def norm_whitespace_lower(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of each document's normalised text."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.md5(T.squeezed_lower(F.col("text"))).alias("digest"))


def filter_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Résumés with fewer than 40 characters of text."""
    n = F.length(T.stripped(F.coalesce("text", F.lit(""))))
    return _resumes(spark, folder).select("resume_id", n.cast("long").alias("chars")).filter("chars < 40")


def contact_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """First address, link and place in the first 400 characters of a résumé; empty if absent."""
    head = F.substring("text", 1, 400)
    pick = lambda p: F.regexp_extract(head, p, 0)
    return _resumes(spark, folder).filter("text IS NOT NULL").select("resume_id", pick(r"[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+").alias("email"), pick(r"[a-z]+\.example/[a-z0-9/]+").alias("link"), pick(r"[A-Z][a-z]+, [A-Z][A-Z]\b").alias("place"))


def glyph_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of each résumé's text with its glyph codes resolved."""
    clean = T.without_glyph_codes(F.col("text"))
    return _resumes(spark, folder).filter("text IS NOT NULL").select("resume_id", F.md5(clean).alias("digest"), F.regexp_count("text", F.lit(r"\(cid:[0-9]+\)")).cast("long").alias("codes"))


def exotic_bullets(spark: SparkSession, folder: str) -> DataFrame:
    """Line marks of a résumé that are neither letters, digits, ASCII nor the usual bullet."""
    marks = F.transform(T.lines(F.col("text")), lambda x: F.substring(T.stripped(x), 1, 1))
    odd = F.array_sort(F.array_distinct(F.filter(marks, lambda c: c.rlike(r"[^\p{L}\p{N}\x00-\x7f•–—“”‘’]"))))
    return _resumes(spark, folder).select("resume_id", F.array_join(odd, "").alias("marks")).filter("marks <> ''")


def section_lines(spark: SparkSession, folder: str) -> DataFrame:
    """First line and number of lines of each section of a résumé."""
    out = segments.sections(_resumes(spark, folder), "resume_id", "text", SECTIONS)
    return out.select("resume_id", "section", F.col("first_line").cast("long").alias("first_line"), "n_lines")


def section_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Required sections a résumé with text lacks, in order."""
    held = segments.sections(_resumes(spark, folder), "resume_id", "text", SECTIONS).groupBy("resume_id").agg(F.collect_set("section").alias("s"))
    gone = F.array_sort(F.array_except(F.array(*map(F.lit, ("education", "experience", "skills"))), F.col("s")))
    return held.select("resume_id", F.array_join(gone, ",").alias("missing")).filter("missing <> ''")


def bullet_locators(spark: SparkSession, folder: str) -> DataFrame:
    """Every bullet with its locator."""
    return _bullets(spark, folder).select("resume_id", "locator", F.md5("bullet").alias("digest"))


def rule_long_bullet(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets of more than 16 words; the bound of 30 is in rules_bullets."""
    n = F.size(T.words(F.col("bullet"))).cast("long")
    return _bullets(spark, folder).select("resume_id", "locator", n.alias("n_words")).filter("n_words > 16")


def rule_quantified_share(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets of a résumé, and those with a measured number."""
    hit = F.col("bullet").rlike(r"[0-9]+ ?%|[0-9]+k ")
    return _bullets(spark, folder).groupBy("resume_id").agg(F.count("*").alias("bullets"), F.count_if(hit).alias("measured"))


def rule_rhythm(spark: SparkSession, folder: str) -> DataFrame:
    """Résumés of five bullets or more of nearly equal length (spread below a tenth of the mean) or few openers."""
    n = F.size(T.words(F.col("bullet"))).cast("long")
    opener = F.lower(F.regexp_extract("bullet", r"^\s*(\S+)", 1))
    per = _bullets(spark, folder).groupBy("resume_id").agg(F.count("*").alias("bullets"), F.sum(n).alias("s"), F.sum(n * n).alias("q"), F.countDistinct(opener).alias("openers"))
    even = 100 * (F.col("bullets") * F.col("q") - F.col("s") * F.col("s")) < F.col("s") * F.col("s")
    few = F.col("openers") <= F.greatest(F.lit(2), F.floor(F.col("bullets") / 4))
    return per.filter(F.col("bullets") >= 5).select("resume_id", "bullets", "openers", even.alias("even_length"), few.alias("few_openers")).filter("even_length OR few_openers")


def rule_synonym_cycling(spark: SparkSession, folder: str) -> DataFrame:
    """Résumés of four bullets or more that use three or more words of one group."""
    group = ("built", "rebuilt", "designed", "prototyped", "replaced")
    used = [F.max(F.lower("bullet").rlike(rf"\b{w}\b").cast("int")).alias(w) for w in group]
    per = _bullets(spark, folder).groupBy("resume_id").agg(F.count("*").alias("bullets"), *used)
    return per.select("resume_id", "bullets", sum(F.col(w) for w in group).cast("long").alias("used")).filter("bullets >= 4 AND used >= 3")


def rule_over_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Words of four letters or more that a résumé's bullets use more than six times."""
    ws = _bullets(spark, folder).select("resume_id", F.explode(T.tokens(F.col("bullet"))).alias("word")).filter(F.length("word") >= 4)
    return ws.groupBy("resume_id", "word").agg(F.count("*").alias("times")).filter("times > 6")


def rule_duplicate_bullet_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets that overlap with an earlier one of the résumé by more than four fifths."""
    out = segments.near_duplicates_first(_bullets(spark, folder), "resume_id", ["role_ix", "bullet_ix"], "bullet")
    return out.select("resume_id", F.col("ix").cast("long").alias("ix"), F.col("first_ix").cast("long").alias("first_ix"))


def text_named_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Acronyms and mixed-case names in each bullet."""
    return _bullets(spark, folder).select("resume_id", "locator", F.array_join(T.named_tokens(F.col("bullet")), ",").alias("names")).filter("names <> ''")


def text_quantities(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of each bullet once identifiers are taken out."""
    found = T.quantities(F.col("bullet"), r"[0-9]{8}-[0-9]{4}|[A-Za-z]+[0-9]+")
    return _bullets(spark, folder).select("resume_id", "locator", F.array_join(found, ",").alias("numbers")).filter("numbers <> ''")


def text_portability(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each bullet before and after its specifics (names, numbers) are taken out."""
    rest = F.regexp_replace("bullet", r"[A-Z][A-Za-z]*|[0-9]+%?", " ")
    n = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z]{2,}"), F.lit(0))).cast("long")
    return _bullets(spark, folder).select("resume_id", "locator", n(F.col("bullet")).alias("before"), n(rest).alias("after"))


def rule_pattern_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of each static pattern per document."""
    docs = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return docs.select("doc_id", F.explode(T.pattern_hits(F.col("text"), RULES)).alias("x")).select("doc_id", "x.pattern", "x.hits")


def text_truncated_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages longer than 24 characters, cut at a word."""
    f = table(spark, folder, "findings", "finding_id", "message").distinct().filter(F.length("message") > 24)
    return f.select("finding_id", T.cut_at_word(F.col("message"), 24).alias("short"))


def text_rule_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs of messages with how often each occurs, the second and later of a slug numbered."""
    return table(spark, folder, "findings", "finding_id", "message").distinct().filter("message IS NOT NULL").groupBy(T.slug(F.col("message"), 30).alias("slug")).agg(F.count("*").alias("times"))


def posting_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each bucket of a posting, duties moved to required where nothing is."""
    posts = once(table(spark, folder, "postings", "posting_id", "raw_text"), "posting_id")
    posts = posts.withColumn("raw_text", plain_marks(F.col("raw_text")))
    out = segments.bucketed(posts, "posting_id", "raw_text", BUCKETS, "duties", "required", "duties", REQUIREMENT, HEADER_CHARS)
    return out.groupBy("posting_id", "bucket").agg(F.count("*").alias("n_lines"), F.min("line_no").cast("long").alias("first_line"))


def posting_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of documents that state a requirement or else a duty: how a posting without headings is sorted; where
    none does, the whole text is required."""
    docs = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    parts = F.split("text", r"(?<=[.!?])\s+", -1)
    sort = lambda x: F.when(F.lower(plain_marks(x)).rlike(REQUIREMENT), "required").when(F.lower(plain_marks(x)).rlike(DUTY), "duties")
    sorted_ = F.filter(F.transform(parts, sort), lambda b: b.isNotNull())
    flat = docs.select("doc_id", sorted_.alias("b")).select("doc_id", (F.size("b") == 0).alias("whole"), F.explode(F.when(F.size("b") > 0, F.col("b")).otherwise(F.array(F.lit("required")))).alias("bucket"))
    return flat.groupBy("doc_id", "bucket", "whole").agg(F.count("*").alias("sentences"))


def posting_bullets_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Rejoined bullets of 40 to 260 characters without links or addresses."""
    posts = once(table(spark, folder, "postings", "posting_id", "raw_text"), "posting_id")
    out = segments.rejoined_bullets(segments.numbered_lines(posts, "posting_id", "raw_text"), "posting_id")
    kept = out.filter(F.length("bullet").between(40, 260) & ~F.col("bullet").rlike(r"(?i)https?://|www\.|@|equal opportunity"))
    return kept.groupBy("posting_id").agg(F.count("*").alias("bullets"), F.sum(F.length("bullet")).alias("chars"))


def posting_bullets_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets of postings with the lines that continue them."""
    posts = once(table(spark, folder, "postings", "posting_id", "raw_text"), "posting_id")
    out = segments.rejoined_bullets(segments.numbered_lines(posts, "posting_id", "raw_text"), "posting_id")
    return out.select("posting_id", F.col("first_line").cast("long").alias("first_line"), "n_lines", F.md5("bullet").alias("digest"))


def posting_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled lines that open a posting, one column each; empty if absent."""
    posts = once(table(spark, folder, "postings", "posting_id", "raw_text"), "posting_id").filter("raw_text IS NOT NULL")
    return posts.select("posting_id", *(F.regexp_extract("raw_text", rf"(?im)^[ \t]*{x}[ \t]*:[ \t]*([^\n]*)", 1).alias(x) for x in ("level", "team", "location", "contract")))


def seg_roles_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Roles read off the experience section of each résumé."""
    return parsed_roles(_resumes(spark, folder), "resume_id", "text").withColumn("bullets", F.size("bullets"))


QUERIES = {
    f.__name__: f
    for f in (
        seg_roles_parsed, scan_documents_lines, norm_whitespace_lower, filter_unreadable, contact_first_match, glyph_normalise, exotic_bullets, section_lines, section_missing, bullet_locators,
        rule_long_bullet, rule_quantified_share, rule_rhythm, rule_synonym_cycling, rule_over_repetition, rule_duplicate_bullet_first_match, text_named_tokens, text_quantities,
        text_portability, rule_pattern_hits, text_truncated_messages, text_rule_slugs, posting_buckets, posting_sentences, posting_bullets_kept, posting_bullets_rejoined, posting_labels,
    )
}

_VALID = """latest AS (
  SELECT resume_id, role_ix, max(parsed_at) AS parsed_at FROM resume_roles GROUP BY 1, 2
), roles AS (
  SELECT DISTINCT r.resume_id, r.role_ix, r.bullets FROM resume_roles r JOIN latest l USING (resume_id, role_ix, parsed_at)
), bullets AS (
  SELECT resume_id, role_ix, unnest(bullets) AS bullet, generate_subscripts(bullets, 1) - 1 AS bullet_ix FROM roles
), located AS (
  SELECT *, 'exp[' || role_ix || '].bullet[' || bullet_ix || ']' AS locator FROM bullets
)"""

_LINES = r"string_split_regex(text, '\r\n|\n|\r')"
_qq = lambda p: p.replace("'", "''")
_PLAIN_MARKS = f"translate(raw_text, '{MARKS[0][:-1]}' || chr(160), '{_qq(MARKS[1])}')"
_TRIM = r"'^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'"
_SEC = f"""src AS (SELECT DISTINCT resume_id, text FROM resumes WHERE text IS NOT NULL),
ln AS (SELECT resume_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS line_no FROM src),
hd AS (SELECT *, CASE WHEN length(line) <= 40 THEN CASE regexp_replace(lower(regexp_replace(regexp_replace(line, '[\\s\\x{{a0}}]+', ' ', 'g'), {_TRIM})), '[:\\s]+$', '')
  {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTIONS.items())} END END AS h FROM ln),
pt AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') AS section FROM hd),
sec AS (SELECT resume_id, section, min(line_no) AS first_line, count(*) AS n_lines FROM pt WHERE h IS NULL AND regexp_matches(line, '\\S') GROUP BY 1, 2)"""

ORACLES = {
    "scan_documents_lines": f"""SELECT doc_id, len({_LINES}) AS n_lines, len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '\\S'))) AS blank_lines,
  list_max(list_transform({_LINES}, lambda x: length(x))) AS longest FROM documents WHERE text IS NOT NULL""",
    "norm_whitespace_lower": f"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '[\\s\\x{{a0}}]+', ' ', 'g'), {_TRIM}))) AS digest FROM documents",
    "filter_unreadable": f"SELECT * FROM (SELECT resume_id, length(regexp_replace(coalesce(text, ''), {_TRIM})) AS chars FROM (SELECT DISTINCT resume_id, text FROM resumes)) WHERE chars < 40",
    "contact_first_match": r"""SELECT resume_id, regexp_extract(h, '[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+') AS email, regexp_extract(h, '[a-z]+\.example/[a-z0-9/]+') AS link,
  regexp_extract(h, '[A-Z][a-z]+, [A-Z][A-Z]\b') AS place FROM (SELECT DISTINCT resume_id, left(text, 400) AS h FROM resumes WHERE text IS NOT NULL)""",
    "glyph_normalise": r"""SELECT resume_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\(cid:(127|128|129|149|183)\)', '•', 'g'), '\(cid:[0-9]+\)', '', 'g'), '[ \t]+(\n|$)', '\1', 'g')) AS digest,
  len(regexp_extract_all(text, '\(cid:[0-9]+\)')) AS codes FROM (SELECT DISTINCT resume_id, text FROM resumes WHERE text IS NOT NULL)""",
    "exotic_bullets": f"""SELECT * FROM (SELECT resume_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_LINES}, lambda x: left(regexp_replace(x, {_TRIM}), 1)),
  lambda c: regexp_matches(c, '[^\\pL\\pN\\x00-\\x7f•–—“”‘’]')))), '') AS marks FROM (SELECT DISTINCT resume_id, text FROM resumes WHERE text IS NOT NULL)) WHERE marks <> ''""",
    "section_lines": f"WITH {_SEC} SELECT resume_id, section, first_line, n_lines FROM sec",
    "section_missing": f"""WITH {_SEC}, held AS (SELECT resume_id, list(section) AS s FROM sec GROUP BY 1)
SELECT * FROM (SELECT resume_id, array_to_string(list_filter(['education', 'experience', 'skills'], lambda x: NOT list_contains(s, x)), ',') AS missing FROM held) WHERE missing <> ''""",
    "bullet_locators": f"WITH {_VALID} SELECT resume_id, locator, md5(bullet) AS digest FROM located",
    "rule_long_bullet": f"""WITH {_VALID} SELECT * FROM (SELECT resume_id, locator, len(list_filter(string_split_regex(coalesce(bullet, ''), '[\\s\\x{{a0}}]+'), lambda w: w <> '')) AS n_words FROM located) WHERE n_words > 16""",
    "rule_quantified_share": f"WITH {_VALID} SELECT resume_id, count(*) AS bullets, count(*) FILTER (regexp_matches(bullet, '[0-9]+ ?%|[0-9]+k ')) AS measured FROM located GROUP BY 1",
    "rule_rhythm": f"""WITH {_VALID}, n AS (SELECT resume_id, len(list_filter(string_split_regex(coalesce(bullet, ''), '[\\s\\x{{a0}}]+'), lambda w: w <> '')) AS n, lower(regexp_extract(bullet, '^\\s*(\\S+)', 1)) AS o FROM located),
per AS (SELECT resume_id, count(*) AS bullets, CAST(sum(n) AS BIGINT) AS s, CAST(sum(n * n) AS BIGINT) AS q, count(DISTINCT o) AS openers FROM n GROUP BY 1)
SELECT * FROM (SELECT resume_id, bullets, openers, 100 * (bullets * q - s * s) < s * s AS even_length, openers <= greatest(2, bullets // 4) AS few_openers FROM per WHERE bullets >= 5) WHERE even_length OR few_openers""",
    "rule_synonym_cycling": f"""WITH {_VALID}, per AS (SELECT resume_id, count(*) AS bullets, {' + '.join(f"max(CAST(regexp_matches(lower(bullet), '\\b{w}\\b') AS BIGINT))" for w in ("built", "rebuilt", "designed", "prototyped", "replaced"))} AS used FROM located GROUP BY 1)
SELECT * FROM per WHERE bullets >= 4 AND used >= 3""",
    "rule_over_repetition": f"""WITH {_VALID}, w AS (SELECT resume_id, unnest(regexp_extract_all(lower(bullet), '[\\pL\\pN]+')) AS word FROM located)
SELECT resume_id, word, count(*) AS times FROM w WHERE length(word) >= 4 GROUP BY 1, 2 HAVING count(*) > 6""",
    "rule_duplicate_bullet_first_match": f"""WITH {_VALID}, s AS (SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY role_ix, bullet_ix) - 1 AS ix, list_distinct(regexp_extract_all(lower(bullet), '[\\pL\\pN]+')) AS w FROM located)
SELECT b.resume_id, b.ix, min(a.ix) AS first_ix FROM s a JOIN s b ON a.resume_id = b.resume_id AND a.ix < b.ix AND len(list_intersect(a.w, b.w)) > 0.8 * greatest(len(a.w), len(b.w)) GROUP BY 1, 2""",
    "text_named_tokens": f"""WITH {_VALID} SELECT * FROM (SELECT resume_id, locator, array_to_string(list_sort(list_distinct(regexp_extract_all(bullet, '\\b(?:[A-Z][a-z]+[A-Z][A-Za-z]*|[A-Z]{{2,8}})\\b'))), ',') AS names FROM located) WHERE names <> ''""",
    "text_quantities": f"""WITH {_VALID} SELECT * FROM (SELECT resume_id, locator, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(bullet, '[0-9]{{8}}-[0-9]{{4}}|[A-Za-z]+[0-9]+', ' ', 'g'), '\\d+'))), ',') AS numbers FROM located) WHERE numbers <> ''""",
    "text_portability": f"""WITH {_VALID} SELECT resume_id, locator, len(regexp_extract_all(bullet, '[A-Za-z]{{2,}}')) AS "before", len(regexp_extract_all(regexp_replace(bullet, '[A-Z][A-Za-z]*|[0-9]+%?', ' ', 'g'), '[A-Za-z]{{2,}}')) AS "after" FROM located""",
    "rule_pattern_hits": " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{k}' AS pattern, len(regexp_extract_all(text, '{p}')) AS hits FROM documents) WHERE hits > 0" for k, p in RULES.items()),
    "text_truncated_messages": r"""SELECT finding_id, regexp_replace(CASE WHEN regexp_extract(left(message, 24), '^(.*)\s\S*$', 1) = '' THEN left(message, 24) ELSE regexp_extract(left(message, 24), '^(.*)\s\S*$', 1) END, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') || '…' AS short
FROM (SELECT DISTINCT finding_id, message FROM findings) WHERE length(message) > 24""",
    "text_rule_slugs": r"""SELECT regexp_replace(left(regexp_replace(lower(message), '[^a-z0-9]+', '-', 'g'), 30), '^-+|-+$', '', 'g') AS slug, count(*) AS times FROM (SELECT DISTINCT finding_id, message FROM findings WHERE message IS NOT NULL) GROUP BY 1""",
    "posting_buckets": rf"""WITH src AS (SELECT DISTINCT posting_id, {_PLAIN_MARKS} AS text FROM postings WHERE raw_text IS NOT NULL), ln AS (SELECT posting_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS line_no FROM src),
hd AS (SELECT *, CASE WHEN length(k) <= {HEADER_CHARS} THEN CASE {' '.join(f"WHEN regexp_matches(k, '{_qq(p)}') THEN '{b}'" for b, p in BUCKETS.items())} END END AS h FROM (SELECT *, lower(regexp_replace(regexp_replace(line, '[\s\x{{a0}}]+', ' ', 'g'), {_TRIM})) AS k FROM ln)),
pt AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY posting_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'duties') AS part, h IS NULL AND regexp_matches(line, '\S') AS body FROM hd),
fl AS (SELECT *, bool_or(h IS NOT NULL) OVER (PARTITION BY posting_id) AND NOT bool_or(body AND part = 'required') OVER (PARTITION BY posting_id) AS rescue FROM pt),
bk AS (SELECT *, CASE WHEN rescue AND part = 'duties' AND regexp_matches(lower(line), '{REQUIREMENT}') THEN 'required' ELSE part END AS bucket FROM fl WHERE body)
SELECT posting_id, bucket, count(*) AS n_lines, min(line_no) AS first_line FROM bk GROUP BY 1, 2""",
    "posting_sentences": rf"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS raw_text FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, lower({_PLAIN_MARKS}) AS t FROM s),
b AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{REQUIREMENT}') THEN 'required' WHEN regexp_matches(t, '{_qq(DUTY)}') THEN 'duties' END AS bucket FROM n), c AS (SELECT doc_id, bucket, count(*) AS sentences FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, bucket, false AS whole, sentences FROM c UNION ALL SELECT doc_id, 'required', true, 1 FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM c)""",
    "posting_bullets_rejoined": rf"""WITH src AS (SELECT DISTINCT posting_id, raw_text AS text FROM postings WHERE raw_text IS NOT NULL), ln AS (SELECT posting_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS line_no FROM src),
mk AS (SELECT *, regexp_matches(line, '^\s*[•*\-▪]\s') AS m FROM ln), mo AS (SELECT *, regexp_matches(line, '^\s{{2,}}\S') AND NOT m AS more FROM mk),
il AS (SELECT *, sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY posting_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS i FROM mo)
SELECT posting_id, min(line_no) AS first_line, count(*) AS n_lines, md5(regexp_replace(string_agg(regexp_replace(line, {_TRIM}), ' ' ORDER BY line_no), '^[•*\-▪]\s*', '')) AS digest FROM il GROUP BY posting_id, i HAVING arg_min(m, line_no)""",
    "posting_labels": "SELECT posting_id, " + ", ".join(rf"regexp_extract(raw_text, '(?im)^[ \t]*{x}[ \t]*:[ \t]*([^\n]*)', 1) AS {x}" for x in ("level", "team", "location", "contract")) + " FROM (SELECT DISTINCT posting_id, raw_text FROM postings WHERE raw_text IS NOT NULL)",
}
_REJOINED = ORACLES["posting_bullets_rejoined"].replace("md5(regexp_replace(string_agg", "(regexp_replace(string_agg").replace("AS digest", "AS bullet")
ORACLES["posting_bullets_kept"] = f"SELECT posting_id, count(*) AS bullets, CAST(sum(length(bullet)) AS BIGINT) AS chars FROM ({_REJOINED}) WHERE length(bullet) BETWEEN 40 AND 260 AND NOT regexp_matches(bullet, '(?i)https?://|www\\.|@|equal opportunity') GROUP BY 1"
