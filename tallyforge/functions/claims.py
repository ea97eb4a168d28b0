"""What a sentence claims: metrics, outcome, mechanism, ownership, and how much of it would fit anybody. JVM only.

The word lists and patterns are fixed values; SQL in the plans uses the same ones, so they keep to what Java and RE2 share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import text as T

#: A number with a unit. Fixed value.
UNIT = (
    r"(?i)\b(?:\d+(?:\.\d+)?[\s-]*(?:%|percent|pts?|points?|x\b|bps)"
    r"|\$\s?\d[\d,.]*\s*(?:k|m|bn|b|million|billion)?"
    r"|\d+(?:\.\d+)?\s*(?:ms|s|sec|secs|seconds|min|mins|minutes|hrs?|hours|days?|weeks?|months?)"
    r"|\d+(?:\.\d+)?\s*(?:k|m|bn|b)?\s*(?:req|requests|qps|rps|tps|queries|tokens|rows|records|users|customers|tickets|events|images|docs|documents|samples|examples|pairs|params|parameters|gb|tb|mb)"
    r"|p\d{2}\b"
    r"|\d+(?:\.\d+)?\s*(?:gpus?|nodes?|replicas?|shards?))"
)
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
#: A number that counts colleagues, meetings or tools. Fixed value.
TRIVIA = r"(?i)\b\d+\s*\+?\s*(?:\w+\s+){0,2}?(?:engineers?|people|teams?|members?|colleagues?|developers?|stakeholders?|meetings?|sprints?|tools?|technologies|frameworks?|languages?|libraries|projects?|clients?)\b"
COMPARISON = r"(?i)\b(?:from|to|by|under|over|within|below|above)\b"
#: Fixed word lists.
OUTCOME_VERBS = "cut reduced increased raised improved grew shipped launched delivered eliminated removed accelerated doubled tripled halved saved boosted lowered scaled migrated automated unblocked recovered restored decreased drove landed achieved enabled".split()
ACTIVITY_VERBS = "worked helped assisted participated contributed supported responsible involved collaborated attended learned used utilized leveraged handled managed maintained developed built created designed implemented wrote researched".split()
NOT_NAMES = "The This That These Those Their There When While With From For And But Our After Before Using".split()
#: Names of things: hyphenated, mixed case, capitals, files. Fixed value.
SPECIFIC = r"\b(?:[A-Z][a-zA-Z]*(?:-[A-Za-z0-9.]+)+|[A-Z][a-z]+[A-Z][A-Za-z]*|[A-Z]{2,8}|[a-z]+\.(?:py|js|ts|go|rs|sql)|vLLM|k8s)\b"
WITHIN = r"[a-z,)\s]([A-Z][a-z]{2,})\b"
GENERIC = r"(?i)\b(?:various|multiple|several|numerous|different|cutting-edge|state-of-the-art|industry-standard|best practices|modern|advanced|innovative|robust|scalable)\b"
TEAM_FIRST, TEAM, DONE = r"(?i)^\s*(?:we|our team|the team|our group|us)\b", r"(?i)\b(?:we|our team|the team)\b", r"(?i)^\s*[a-z]+ed\b"
CHANGE, OUTCOME_WORD = r"(?i)\b(?:from|to)\b.*\b(?:to|from)\b", "(?:^| )(?:" + "|".join(OUTCOME_VERBS) + ")(?: |$)"
MARKED = "[À-ÖØ-öø-ɏ]"
CAPITAL, FIRST_WORD = r"\b[A-Z][a-zA-Z]+\b", r"[a-z]+"
#: Characters on either side of a number that are looked at.
WINDOW = 30


def number_windows(text: Column) -> Column:
    """array<string>: the surroundings of each number. Places follow from the lengths of what lies between numbers."""
    parts, numbers = F.split(text, NUMBER, -1), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))

    def window(n: Column, i: Column) -> Column:
        start = length(F.slice(parts, F.lit(1), i + 1)) + length(F.slice(numbers, F.lit(1), i))
        first = F.greatest(F.lit(0), start - WINDOW)
        return F.substring(text, first + 1, start + F.length(n) + WINDOW - first)

    return F.transform(numbers, window)


def has_metric(text: Column) -> Column:
    """Whether a number measures something: it has a unit, or stands near a comparison and counts no trivia."""
    near = F.exists(number_windows(text), lambda w: ~w.rlike(TRIVIA) & w.rlike(COMPARISON))
    return F.coalesce(text.rlike(UNIT) | near, F.lit(False))


def vacuous_number(text: Column) -> Column:
    """The first number that counts trivia, if none has a unit; else null."""
    return F.when(~text.rlike(UNIT), F.nullif(F.regexp_extract(text, TRIVIA, 0), F.lit("")))


def named_things(text: Column) -> Column:
    """Distinct names of tools, models and files in a sentence; its first word counts only if its form is a name's."""
    inside = F.filter(F.regexp_extract_all(F.substring(text, 2, 1 << 30), F.lit(WITHIN), F.lit(1)), lambda w: ~w.isin(*NOT_NAMES))
    return F.array_union(F.regexp_extract_all(text, F.lit(SPECIFIC), F.lit(0)), inside)


def invariants(text: Column) -> Column:
    """struct<outcome, measurability, mechanism, ownership>: what changed, by how much, by which means, by whom."""
    lower = F.lower(text)
    first, metric, names = F.regexp_extract(lower, FIRST_WORD, 0), has_metric(text), F.size(named_things(text))
    outcome = (first.isin(*OUTCOME_VERBS) | lower.rlike(OUTCOME_WORD) | (text.rlike(CHANGE) & metric)) & ~(first.isin(*ACTIVITY_VERBS) & ~metric)
    mechanism = (names >= 1) & ~(text.rlike(GENERIC) & (names < 2))
    ownership = ~text.rlike(TEAM_FIRST) & (~text.rlike(TEAM) | text.rlike(DONE))
    return F.struct(outcome.alias("outcome"), metric.alias("measurability"), mechanism.alias("mechanism"), ownership.alias("ownership"))


def portability(text: Column) -> Column:
    """The share of a sentence's words left once names, numbers and capitalised words are taken out. Latin letters with
    marks count as letters."""
    text = F.regexp_replace(text, MARKED, "x")
    bare = text
    for pattern in (SPECIFIC, UNIT, NUMBER, CAPITAL):
        bare = F.regexp_replace(bare, pattern, "")
    count = lambda x: F.regexp_count(x, F.lit(r"\w+"))
    return count(bare) / F.greatest(count(text), F.lit(1))


# --- sentences that say nothing -------------------------------------------------------------------------------------------

#: Patterns of empty prose by scope: rule -> (scope, severity, pattern). Fixed values.
SLOP = {
    "slop/banned-word": ("bullet", "minor", r"(?i)\b(?:delve|delving|delved|foster|fostering|leverage|leveraging|leveraged|utilize|utilizing|utilized|facilitate|facilitating|empower|empowering|streamline|streamlining|robust|cutting-edge|paradigm shift|game changer|tapestry|realm|beacon|multifaceted|meticulous|meticulously|intricate|paramount|transformative|elevate|elevating|embark|supercharge|harness|harnessing|ever-evolving|seamless|seamlessly|holistic|synergy|synergies)\b"),
    "slop/superficial-analysis": ("bullet", "major", r"(?i),\s*(?:highlighting|underscoring|reflecting|showcasing|demonstrating|emphasizing|illustrating|signifying|showing)\b[^.]*"),
    "slop/importance-puffery": ("bullet", "major", r"(?i)\b(?:stands as a testament|marks a pivotal|plays a (?:vital|key|crucial) role|solidif\w+ (?:its|my|their) position|underscores? (?:its|my|the) significance|commitment to excellence|passion for excellence|proven track record of success|a testament to)\b"),
    "slop/fake-strong-verb": ("bullet", "minor", r"(?i)\b(?:serv(?:es|ed|ing) as a|act(?:s|ed|ing) as a|function(?:s|ed|ing) as a)\s+(?:centralized|central|single|unified|comprehensive)?\s*(?:hub|solution|platform|resource|vehicle|framework)\b"),
    "slop/weasel-attribution": ("bullet", "major", r"(?i)\b(?:experts agree|industry reports suggest|many argue|widely regarded as|studies show|it is well known|research suggests)\b"),
    "slop/empty-phrase": ("summary", "minor", r"(?i)\b(?:at the end of the day|when it comes to|at its core|in today'?s world|in the age of|in the world of|the reality is|going forward)\b"),
    "slop/binary-contrast": ("summary", "major", r"(?i)(?:(?:it'?s|this is|that'?s) not (?:just )?(?:about )?[^.]{2,50}?\.\s*(?:it'?s|but)\b|the question isn'?t[^.]{2,60}?,?\s*it'?s\b|not only[^.]{2,60}?but also\b)"),
    "slop/negative-listing": ("summary", "minor", r"(?i)\bnot a [^.]{2,30}\.\s*not a [^.]{2,30}\."),
    "slop/throat-clearing": ("summary", "minor", r"(?i)\b(?:here'?s the thing|here'?s what i mean|let me be clear|i'?ll be honest|the uncomfortable truth is|make no mistake)\b"),
    "slop/faux-insight": ("summary", "major", r"(?i)\b(?:this is the part most people skip|what most people get wrong|here'?s what nobody tells you|the part everyone misses|what they don'?t tell you)\b"),
    "slop/rhetorical-setup": ("summary", "minor", r"(?i)\b(?:what if i told you|think about it:|plot twist:|here'?s the kicker)"),
    "slop/metadiscourse": ("summary", "minor", r"(?i)\b(?:that last part matters|the key point is|as you can see|this distinction matters|in other words|it'?s worth noting|it'?s important to note)\b"),
    "slop/colon-reveal": ("summary", "minor", r"(?m)^[A-Z][\w ]{2,40}:\s+[a-z][^.\n]{10,}$"),
    "slop/summary-recap": ("summary", "minor", r"(?i)\b(?:in conclusion|ultimately|overall,|to sum up)\b"),
}
#: Spans in which a word is a name or plain technical language. Fixed value.
PROTECTED = r"(?:\b(?:[Ee]val|[Ee]valuation|[Tt]est|[Tt]esting|[Tt]raining|[Bb]enchmark|CI|[Bb]uild)\s+[Hh]arness\b|\b[Hh]arness(?:es|ed|ing)?\s+(?:the\s+)?(?:GPU|CPU|cluster|parallelism)\b|\b[Rr]obust(?:ness)?\s+(?:to|against)\s+\w+|\b[Ss]treamlit\b|\b(?:Harness|Robust Intelligence|Streamlit|Elevate|Delve|Fostering|Synergy|Beacon|Tapestry|Realm|Paradigm|Catalyst)\b|\b[A-Z][a-z]+ (?:Inc|LLC|Ltd|Labs|AI|Technologies|Systems|Corp)\b|\b(?:https?://|www\.)\S+|`[^`]+`)"


def occurrences(text: Column, part: Column) -> Column:
    """How often a non-empty part stands in a text."""
    return F.coalesce(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"), F.lit(0))


def slop_hits(text: Column, scope: str) -> Column:
    """array<struct<rule, severity, hit>>: the hits of a scope's patterns, but for those that only occur inside protected
    spans; spans are found in one scan."""
    spans = F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))

    def free(hit: Column) -> Column:
        return occurrences(text, hit) > F.aggregate(spans, F.lit(0), lambda a, s: a + occurrences(s, hit))

    def named(rule: str, severity: str, pattern: str) -> Column:
        hits = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), free)
        return F.transform(hits, lambda h: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), T.stripped(h).alias("hit")))

    return F.flatten(F.array(*(named(rule, severity, pattern) for rule, (own, severity, pattern) in SLOP.items() if own == scope)))


def rank_score(text: Column) -> Column:
    """Ten for each invariant kept, less six for each empty phrase and 0.4 for each word beyond 32."""
    kept = invariants(text)
    passed = sum(kept[k].cast("int") for k in ("outcome", "measurability", "mechanism", "ownership"))
    hits = F.size(slop_hits(text, "bullet")) + F.size(slop_hits(text, "summary"))
    return F.bround(passed * 10.0 - hits * 6.0 - F.greatest(F.lit(0), F.size(T.words(text)) - 32) * 0.4, 2)


#: Digits that belong to a name, not a measurement; and small words. Fixed values.
IDENTIFIER = r"(?i)\b(?:bm|gpt|llama|mistral|qwen|gemma|phi|t|clip|f|p|a|h|v|s|ec|k)[- ]?\d+[\w.-]*|\b\w+@\d+|\b[a-z]+\d+(?:[a-z]\w*)?\b|\[add:[^\]]*\]"
FILLER = "with that this from into were have been their them our for the and was are his her its".split()


def quantities(text: Column) -> Column:
    """Distinct numbers that assert a measurement."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, IDENTIFIER, " "), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def content_words(text: Column) -> Column:
    """Distinct words of four characters or more in lower case, small ones left out."""
    return F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][\w-]{3,}"), F.lit(0)), F.lower)), F.array(*map(F.lit, FILLER)))


def specifics(text: Column) -> Column:
    """Names, acronyms and quantities of a sentence, in lower case."""
    named = F.regexp_extract_all(F.substring(text, 2, 1 << 30), F.lit(r"\b[A-Z][A-Za-z0-9.-]{2,}\b"), F.lit(0))
    capitals = F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,8}\b"), F.lit(0))
    return F.array_distinct(F.concat(F.transform(F.concat(named, capitals), F.lower), quantities(text)))


def audit(original: Column, candidate: Column) -> Column:
    """struct<score, problems>: what a rewritten sentence made up, lost or padded; 100 and none if nothing."""
    invented = F.array_except(quantities(candidate), quantities(original))
    vacuous = vacuous_number(candidate).isNotNull() & vacuous_number(original).isNull()
    lost = F.size(F.array_except(specifics(original), specifics(candidate)))
    words = content_words(original)
    kept = F.size(F.array_intersect(content_words(candidate), words)) / F.nullif(F.size(words), F.lit(0))
    gutted = F.coalesce(kept < 0.45, F.lit(False)) & (F.size(specifics(candidate)) == 0)
    names = lambda x: F.regexp_count(F.substring(x, 2, 1 << 30), F.lit(r"\b[A-Z][a-zA-Z]{2,}\b"))
    padded = names(candidate) > names(original) + 2
    score = 100.0 - 60.0 * F.size(invented) - F.when(vacuous, 40.0).otherwise(0.0) - F.when(lost > 0, 35.0).otherwise(0.0) - F.when(gutted, 35.0).otherwise(0.0) - F.when(padded, 25.0).otherwise(0.0)
    told = [F.transform(invented, lambda n: F.concat(F.lit("invented "), n)), F.when(vacuous, F.array(F.lit("vacuous"))), F.when(lost > 0, F.array(F.concat(F.lit("lost "), lost))), F.when(gutted, F.array(F.lit("gutted"))), F.when(padded, F.array(F.lit("padded")))]
    return F.struct(F.bround(score, 2).alias("score"), F.flatten(F.array(*(F.coalesce(t, F.array().cast("array<string>")) for t in told))).alias("problems"))
