"""Line scans: sections and buckets carried forward, islands of lines, located bullets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no, line), lines counted from 0; none for null texts."""
    return df.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def carried_forward(lines: DataFrame, key: str, heading, start: str) -> DataFrame:
    """lines with `part`: the last heading at or before each line, `start` before the first, and `is_heading`.

    The window is over one document, whose lines are the bound of what a task sorts at once."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__h", heading)
    return marked.withColumn("part", F.coalesce(F.last("__h", ignorenulls=True).over(w), F.lit(start))).withColumn("is_heading", F.col("__h").isNotNull()).drop("__h")


def section_heading(line, names: Mapping[str, str], most_chars: int = 40):
    """The section a heading line names: a short line all of whose parts (cut at &, / and "and") name one section."""
    parts = F.transform(F.split(F.regexp_replace(T.squeezed_lower(line), r"[:\s]+$", ""), r"\s*(?:&|/|\band\b)\s*"), lambda p: p)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    named = F.transform(parts, lambda p: F.try_element_at(table, p))
    whole = F.forall(named, lambda x: x.isNotNull()) & (F.size(F.array_distinct(named)) == 1)
    return F.when((F.length(line) <= most_chars) & whole, F.get(named, F.lit(0)))


def sections(df: DataFrame, key: str, text: str, names: Mapping[str, str], start: str = "header") -> DataFrame:
    """Rows (key, section, first_line, n_lines), blank and heading lines not counted."""
    lines = numbered_lines(df, key, text)
    parts = carried_forward(lines, key, section_heading(F.col("line"), names), start)
    kept = parts.filter(~F.col("is_heading") & F.col("line").rlike(r"\S"))
    return kept.groupBy(key, F.col("part").alias("section")).agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def bucketed(df: DataFrame, key: str, text: str, headings: Mapping[str, str], start: str, rescue_to: str, rescue_from: str, rescue_if: str, most_chars: int = 60) -> DataFrame:
    """Rows (key, line_no, bucket, line): the non-blank lines of postings under the bucket of the last header line, which
    has at most `most_chars` characters.

    `headings`: bucket by pattern, in order of precedence. A document with headers but nothing under `rescue_to`
    gets those lines of `rescue_from` there that match `rescue_if`."""
    line = T.squeezed_lower(F.col("line"))
    parts = carried_forward(numbered_lines(df, key, text), key, F.when(F.length(line) <= most_chars, T.first_present(line, headings)), start)
    per_doc = Window.partitionBy(key)
    body = ~F.col("is_heading") & F.col("line").rlike(r"\S")
    has_headers = F.max(F.col("is_heading").cast("int")).over(per_doc) == 1
    empty = F.max((body & (F.col("part") == rescue_to)).cast("int")).over(per_doc) == 0
    moved = has_headers & empty & (F.col("part") == rescue_from) & F.lower("line").rlike(rescue_if)
    flagged = parts.withColumn("bucket", F.when(moved, rescue_to).otherwise(F.col("part")))
    return flagged.filter(body).select(key, "line_no", "bucket", "line")


def rejoined_bullets(lines: DataFrame, key: str, marker: str = r"^\s*[•*\-▪]\s") -> DataFrame:
    """Rows (key, first_line, n_lines, bullet): each marked line with the indented lines that continue it."""
    marked = lines.withColumn("__m", F.col("line").rlike(marker))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    more = F.col("line").rlike(r"^\s{2,}\S") & ~F.col("__m")
    islands = marked.withColumns({"__i": F.sum(F.when(more, 0).otherwise(1)).over(w), "__more": more})
    grouped = islands.groupBy(key, "__i").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.min_by("__m", "line_no").alias("__m"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("__x"))
    text = F.array_join(F.transform("__x", lambda x: T.stripped(x["line"])), " ")
    return grouped.filter("__m").select(key, "first_line", "n_lines", F.regexp_replace(text, r"^[•*\-▪]\s*", "").alias("bullet"))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows (key, run, value, first, length): maximal runs of equal values in order; null equals null."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    step = df.withColumn("__c", changed.cast("int"))
    ordered = step.withColumns({"run": F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.row_number().over(w)})
    return ordered.groupBy(key, "run").agg(F.min_by(value, "__n").alias("value"), F.min("__n").cast("long").alias("first"), F.count("*").alias("length"))


def largest_gap(df: DataFrame, key: str, x: str) -> DataFrame:
    """Rows (key, left_x, gap): the widest gap between neighbouring positions; of equal gaps the leftmost."""
    w = Window.partitionBy(key).orderBy(x)
    gaps = df.select(key, F.col(x).alias("left_x"), (F.lead(x).over(w) - F.col(x)).alias("gap")).filter(F.col("gap").isNotNull())
    best = Window.partitionBy(key).orderBy(F.desc("gap"), "left_x")
    return gaps.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def located_bullets(roles: DataFrame, key: str, role: str, bullets: str) -> DataFrame:
    """Rows (key, role, bullet_ix, locator, bullet)."""
    flat = roles.select(key, role, F.posexplode(bullets).alias("bullet_ix", "bullet"))
    return flat.withColumn("locator", F.concat(F.lit("exp["), F.col(role), F.lit("].bullet["), F.col("bullet_ix"), F.lit("]")))


def near_duplicates_first(bullets: DataFrame, key: str, order: list[str], text: str, share: float = 0.8) -> DataFrame:
    """Rows (key, ix, first_ix): each bullet whose words overlap with an earlier one of its document by more than
    `share` of the larger set, with the first such. The bullets of a document are compared in one row."""
    packed = bullets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.array_distinct(T.tokens(F.col(text))).alias("__w")))).alias("__b"))
    sets = packed.withColumn("__s", F.transform("__b", lambda b: b["__w"]))

    def first_match(ws, i):
        hits = F.transform(F.slice(F.col("__s"), F.lit(1), i), lambda o, j: F.when(F.size(F.array_intersect(o, ws)) > share * F.greatest(F.size(o), F.size(ws)), j))
        return F.struct(i.alias("ix"), F.array_min(F.array_compact(hits)).alias("first_ix"))

    found = sets.select(key, F.explode(F.transform("__s", first_match)).alias("x")).select(key, "x.ix", "x.first_ix")
    return found.filter(F.col("first_ix").isNotNull())
