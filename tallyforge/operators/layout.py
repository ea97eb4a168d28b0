"""Page geometry over tables of words, characters and pages, as an extractor leaves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def near_white(color):
    """A grey above 0.92, RGB all above it, or CMYK all below 0.06; false for null and other lengths."""
    n = F.size(color)
    light = F.forall(color, lambda x: x > 0.92) & n.isin(1, 3)
    return F.coalesce(light | (F.forall(color, lambda x: x < 0.06) & (n == 4)), F.lit(False))


def hidden_spans(chars: DataFrame, least: int = 4) -> DataFrame:
    """Rows (doc_id, page, first, span): maximal runs of invisible characters (nearly white, or below size 2) that have
    `least` characters or more once trimmed. A page's characters are sorted together, no more."""
    w = Window.partitionBy("doc_id", "page").orderBy("char_ix")
    unseen = near_white(F.col("color")) | (F.coalesce(F.col("size"), F.lit(10.0)) < 2)
    flagged = chars.withColumn("__h", unseen).withColumn("__c", (F.col("__h") != F.lag("__h", 1, False).over(w)).cast("int"))
    runs = flagged.withColumn("__i", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__h")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_ix", "text"))), lambda x: x["text"]), "")
    out = runs.groupBy("doc_id", "page", "__i").agg(F.min("char_ix").alias("first"), F.trim(text).alias("span"))
    return out.filter(F.length("span") >= least).select("doc_id", "page", "first", "span")


def gutters(words: DataFrame, pages: DataFrame, least_words: int = 40, gap: float = 0.06, side: float = 0.2, straddlers: int = 1) -> DataFrame:
    """Rows (doc_id, page, left_x, width_share): pages of two columns. The widest gap between neighbouring middles of
    words (the leftmost of equals) must be `gap` of the page's width, hold `side` of the words on either side, and at
    most `straddlers` words may cross its middle."""
    mid = (F.col("x0") + F.col("x1")) / 2
    w = Window.partitionBy("doc_id", "page").orderBy("__x")
    placed = words.select("doc_id", "page", "x0", "x1", mid.alias("__x")).withColumns({"__n": F.count("*").over(Window.partitionBy("doc_id", "page")), "__g": F.lead("__x").over(w) - F.col("__x"), "__r": F.row_number().over(w)})
    best = Window.partitionBy("doc_id", "page").orderBy(F.desc_nulls_last("__g"), "__x")
    top = placed.filter(F.col("__n") >= least_words).withColumn("__b", F.row_number().over(best)).filter("__b = 1 AND __g IS NOT NULL")
    wide = top.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).filter((F.col("__g") >= gap * F.col("width")) & (F.least("__r", F.col("__n") - F.col("__r")) >= side * F.col("__n")))
    middle = wide.select("doc_id", "page", F.col("__x").alias("left_x"), (F.col("__x") + F.col("__g")).alias("__m"), (F.col("__g") / F.col("width")).alias("width_share"))
    crossing = words.join(middle, ["doc_id", "page"]).groupBy("doc_id", "page", "left_x", "width_share").agg(F.count_if((F.col("x0") < F.col("left_x")) & (F.col("x1") > F.col("__m"))).alias("__s"))
    return crossing.filter(F.col("__s") <= straddlers).drop("__s")


def edge_words(words: DataFrame, pages: DataFrame, band: float = 0.06) -> DataFrame:
    """Words that end in the top band of their page or begin in the bottom one."""
    sized = words.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    return sized.filter((F.col("bottom") < band * F.col("height")) | (F.col("top") > (1 - band) * F.col("height"))).drop("height")


def fold_text(words: DataFrame, pages: DataFrame, share: float = 0.33, line: float = 4.0) -> DataFrame:
    """Rows (doc_id, fold): the words of the first page's upper third, line by line."""
    sized = words.filter("page = 0").join(pages.filter("page = 0").select("doc_id", "height"), "doc_id").filter(F.col("top") <= share * F.col("height"))
    ordered = F.array_sort(F.collect_list(F.struct(F.bround(F.col("top") / line).alias("row"), "x0", "text")))
    return sized.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("fold"))


def font_families(fonts: DataFrame) -> DataFrame:
    """Rows (doc_id, families): distinct fonts without subset prefix and style."""
    family = F.lower(F.regexp_replace(F.regexp_replace("font_name", r"^[A-Z]{6}\+", ""), r"[-,](?:Bold|Italic|Regular|Oblique|Medium|Light|Roman|MT|PS).*$", ""))
    return fonts.groupBy("doc_id").agg(F.countDistinct(family).alias("families"))


def line_spacing(words: DataFrame, most: float = 60.0) -> DataFrame:
    """Rows (doc_id, spacing): the median distance between neighbouring tops of the first page's words, distances of zero
    and of `most` or more left out."""
    w = Window.partitionBy("doc_id").orderBy("top")
    gaps = words.filter("page = 0").select("doc_id", (F.col("top") - F.lag("top").over(w)).alias("g")).filter((F.col("g") > 0) & (F.col("g") < most))
    return gaps.groupBy("doc_id").agg(F.median("g").alias("spacing"))


def visible_text(docs: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows (doc_id, visible, dropped): texts with every hidden span replaced by a blank, and how many there were."""
    spans = hidden.groupBy("doc_id").agg(F.array_sort(F.collect_list("span")).alias("__h"))
    both = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", F.aggregate(F.coalesce("__h", none), F.col("text"), lambda t, h: F.replace(t, h, F.lit(" "))).alias("visible"), F.size(F.coalesce("__h", none)).alias("dropped"))
