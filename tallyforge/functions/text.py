"""Column functions on text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\x{a0}]+"


def stripped(text: Column) -> Column:
    """Outer white space of any kind removed; Spark's trim knows blanks only."""
    return F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")


def squeezed_lower(text: Column) -> Column:
    """Lower case, runs of white space one blank, outer ones none."""
    return F.lower(stripped(F.regexp_replace(text, BLANKS, " ")))


def words(text: Column) -> Column:
    """Pieces between white space, empty ones dropped; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def without_glyph_codes(text: Column, bullets: Sequence[int] = (127, 128, 129, 149, 183)) -> Column:
    """Codes "(cid:N)" left by extraction: a bullet for the codes in `bullets`, the character for 32 to 126, else
    nothing; then white space at line ends removed."""
    parts = F.split(text, r"\(cid:", -1)

    def decoded(part: Column, i: Column) -> Column:
        code = F.regexp_extract(part, r"^([0-9]{1,6})\)", 1)
        n = F.expr("0") + F.coalesce(F.try_to_number(F.nullif(code, F.lit("")), F.lit("999999")), F.lit(0)).cast("int")
        rest = F.regexp_replace(part, r"^[0-9]{1,6}\)", "")
        shown = F.when(n.isin(*bullets), F.lit("•")).when(n.between(32, 126), F.char(n)).otherwise("")
        return F.when(i == 0, part).when(code == "", F.concat(F.lit("(cid:"), part)).otherwise(F.concat(shown, rest))

    return F.regexp_replace(F.array_join(F.transform(parts, decoded), ""), r"[ \t]+(\n|$)", "$1")


def cut_at_word(text: Column, most: int, mark: str = "…") -> Column:
    """Texts longer than `most` cut after their last whole word within it, and marked."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"^(.*)\s\S*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(stripped(F.when(whole == "", head).otherwise(whole)), F.lit(mark)))


def slug(text: Column, most: int = 40) -> Column:
    """Lower case, runs of anything but letters and digits one hyphen, at most `most` characters, no outer hyphens."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), 1, most), r"^-+|-+$", "")


def first_present(text: Column, patterns: Mapping[str, str]) -> Column:
    """Name of the first pattern that occurs in the text, in the order given; null if none does."""
    out = None
    for name, pattern in patterns.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def pattern_hits(text: Column, patterns: Mapping[str, str]) -> Column:
    """array<struct<pattern, hits>> of the patterns that occur; the patterns are constants, so each compiles once."""
    found = F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_count(text, F.lit(p)).cast("long").alias("hits")) for k, p in patterns.items()))
    return F.filter(found, lambda x: x["hits"] > 0)


def quantities(text: Column, identifiers: str = r"[A-Za-z]+[\-@]?\d[\w.\-]*|\d{8}-\d{4}") -> Column:
    """Distinct numbers of a text once identifiers (BM25, p99, build numbers) are taken out."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, identifiers, " "), F.lit(r"\d+"), F.lit(0))))


def named_tokens(text: Column, names: str = r"\b(?:[A-Z][a-z]+[A-Z][A-Za-z]*|[A-Z]{2,8})\b") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(names), F.lit(0))))


def salvaged_json(reply: Column) -> Column:
    """The JSON object inside a reply, whatever stands around it; empty if there is none."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def sha_hex(text: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def hashed_choice(key: Column, n: int) -> Column:
    """A choice below n that depends on the key alone."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n).cast("int")
