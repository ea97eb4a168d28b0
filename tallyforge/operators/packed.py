"""Fields that pack several values behind inconsistent delimiters, split into one row per value.

A text is cut at the delimiters that stand outside quotes and brackets, by one regular expression. Each piece is reduced
to its skeleton: runs of ordinary characters (blanks between them included) become 'a', outer blanks ' ', quotes stay.
One rule is worked out per distinct skeleton: where the value lies and whether it is quoted. Since every skeleton
character stands for one token of the piece, the rule is applied to the tokens by position, in the JVM. Skeletons of
pieces, unlike those of whole texts, are few however many texts there are, so the rules can be broadcast.

Brackets nested deeper than the expression knows, and quotes far from their delimiter, are left to rules on the skeletons
of whole texts, which have no such bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut, spread_join, table_or_none

BREAKS = ",;|•·\n\t"
SPECIAL = BREAKS + "/\"'“”():"
_ORDINARY = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in SPECIAL) + r"\s\x{a0}\x{2007}\x{202f}\x{2000}-\x{200a}\x{3000}]"
_BLANK = r"[^\S\n\t]|[\x{a0}\x{2007}\x{202f}\x{2000}-\x{200a}\x{3000}]"
_TOKEN = f"{_ORDINARY}+|(?:{_BLANK})+|[\\s\\S]"

#: Blanks that may stand between a delimiter and an opening apostrophe, and the depth of brackets, for one expression.
NEAR, DEPTH = 20, 4
_WIDE = r"\s\x{a0}\x{2007}\x{202f}\x{2000}-\x{200a}\x{3000}"
_SLASH = f"(?<=[{_WIDE}])/(?=[{_WIDE}])"
_ENDS_VALUE = f"(?=(?:{_BLANK})*+(?:[{BREAKS}/]|\\z))"


def _brackets(depth: int) -> str:
    return r"\((?:[^()]" + (f"|{_brackets(depth - 1)}" if depth > 1 else "") + r")*+\)"


_APOSTROPHES = rf"(?<=(?:^|[{BREAKS}]|[{_WIDE}]/[{_WIDE}])[{_WIDE}]{{0,{NEAR}}})'[^']*+(?:'(?!{_ENDS_VALUE[3:]}[^']*+)*+'{_ENDS_VALUE}"
#: A piece: quoted or bracketed stretches and single characters, up to a delimiter.
_PIECE = rf"(?:\"(?:[^\"]|\"\")*+\"|“[^”]*+”|{_brackets(DEPTH)}|{_APOSTROPHES}|(?!{_SLASH})[^{BREAKS}])++"
_LABEL = "^" + _ORDINARY.replace("[^", "(?:[^", 1) + f"|{_BLANK})*+:"
_BODY = "[^\"“”'" + _WIDE + "]+"
_PIECE_TOKEN = f"{_BODY}(?:[{_WIDE}]+{_BODY})*|[{_WIDE}]+|[\"“”']"


def piece_rule(skeleton: str) -> tuple[int, int, bool] | None:
    """(first token, tokens, quoted) of the value in a piece, tokens counted from 1; None if there is none."""
    a, b = len(skeleton) - len(skeleton.lstrip(" ")), len(skeleton.rstrip(" "))
    quoted = a + 1 < b and skeleton[a] in "\"“'" and _closing(skeleton, a, True) == b - 1
    a, b = (a + 1, b - 1) if quoted else (a, b)
    return (a + 1, b - a, quoted) if a < b else None


def split_rule(skeleton: str) -> list[tuple[int, int, bool]]:
    """(first token, tokens, quoted) of each value of a whole text, tokens counted from 1 as Spark's slice does."""
    n, i = len(skeleton), 0
    label = 0
    while label < n and skeleton[label] in "a ":
        label += 1
    if label < n and skeleton[label] == ":" and "a" in skeleton[:label]:
        i = label + 1
    cuts, begin, fresh = [], i, True
    while i < n:
        c = skeleton[i]
        step = 1
        if c in BREAKS:
            cuts.append((begin, i))
            begin, fresh = i + 1, True
        elif c == "/" and 0 < i < n - 1 and skeleton[i - 1] in " \n\t" and skeleton[i + 1] in " \n\t":
            cuts.append((begin, i))
            begin, fresh = i + 1, True
        elif c in "\"“'(":
            close = _closing(skeleton, i, fresh)
            step = close - i + 1 if close else 1
            fresh = False
        elif c != " ":
            fresh = False
        i += step
    cuts.append((begin, n))
    out = []
    for a, b in cuts:
        while a < b and skeleton[a] == " ":
            a += 1
        while a < b and skeleton[b - 1] == " ":
            b -= 1
        if a == b:
            continue
        quoted = a + 1 < b and skeleton[a] in "\"“'" and _closing(skeleton, a, True) == b - 1
        a, b = (a + 1, b - 1) if quoted else (a, b)
        if a < b:
            out.append((a + 1, b - a, quoted))
    return out


def _closing(s: str, i: int, fresh: bool) -> int:
    """Where the quote or bracket at i closes; 0 if it doesn't or is none."""
    c = s[i]
    if c == "(":
        depth = 0
        for j in range(i, len(s)):
            depth += (s[j] == "(") - (s[j] == ")")
            if not depth:
                return j
        return 0
    if c == "'":  # an apostrophe unless it opens a value and closes before a delimiter
        if not fresh:
            return 0
        j = s.find("'", i + 1)
        while j > 0:
            rest = s[j + 1 :].lstrip(" ")
            if (not rest or rest[0] in BREAKS + "/") and j > i:
                return j
            j = s.find("'", j + 1)
        return 0
    end = {'"': '"', "“": "”"}[c]
    j = i + 1
    while j < len(s):
        if s[j] == end:
            if end == '"' and s[j + 1 : j + 2] == '"':
                j += 2
                continue
            return j
        j += 1
    return 0


_RULE = "array<struct<first:int,size:int,quoted:boolean>>"


def _rules(of_pieces: bool):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[r for r in [piece_rule(x)] if r] if of_pieces else split_rule(x) for x in b["__shape"]]
            yield b.assign(__rule=[[{"first": a, "size": n, "quoted": q} for a, n, q in r] for r in found])

    return work


def _too_deep(text):
    """Whether brackets are nested deeper than DEPTH, or an apostrophe stands after many blanks."""
    steps = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    state = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, c: F.struct(F.greatest(F.lit(0), a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c == "(", 1).otherwise(0)).alias("m")))
    opened = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    return F.when(opened > DEPTH, state["m"] > DEPTH).otherwise(False) | text.rlike(f"[{_WIDE}]{{{NEAR + 1},}}'")


def pieces(text):
    """array<string>: a text without its leading label, cut at the delimiters outside quotes and brackets."""
    bare = F.when(text.rlike(_LABEL), F.when(F.regexp_extract(text, _LABEL, 0).rlike(_ORDINARY), F.regexp_replace(text, _LABEL, "")).otherwise(text)).otherwise(text)
    return F.regexp_extract_all(bare, F.lit(_PIECE), F.lit(0))


def piece_shape(piece):
    """The skeleton of a piece."""
    return F.regexp_replace(F.regexp_replace(piece, f"{_BODY}(?:[{_WIDE}]+{_BODY})*", "a"), f"[{_WIDE}]+", " ")


def _value(tokens, r):
    raw = F.array_join(F.slice(tokens, r["first"], r["size"]), "")
    raw = F.when(r["quoted"], F.replace(raw, F.lit('""'), F.lit('"'))).otherwise(raw)
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def split_packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, item_pos, item): each non-empty value of `text`, trimmed, in order from 1.

    Delimiters are , ; | • · tab, line feed, and a slash with blanks on both sides. Text in quotes or round brackets
    is never split; quotes around a value are dropped and doubled ones inside are single; a leading label ending in
    a colon is no value. A quote or bracket that never closes is an ordinary character. Null, empty and blank texts
    give no rows; repeated rows count once; a key with several texts gives the values of each. Other columns are
    ignored. The rules are broadcast if their measured size allows, else joined on salted skeletons.
    """
    src = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).filter(F.col("__text").rlike(r"\S")).distinct()
    src = src.withColumn("__deep", _too_deep(F.col("__text")))
    cutup = src.filter("NOT __deep").select("__key", F.transform(pieces(F.col("__text")), lambda x: F.struct(x.alias("t"), piece_shape(x).alias("s"))).alias("__p"))
    rules = cutup.select(F.explode("__p.s").alias("__shape")).distinct().mapInPandas(_rules(True), f"__shape string, __rule {_RULE}")
    whole = src.filter("__deep").withColumn("__shape", F.regexp_replace(F.regexp_replace("__text", f"{_ORDINARY}+", "a"), f"(?:{_BLANK})+", " "))
    deep_rules = whole.select("__shape").distinct().mapInPandas(_rules(False), f"__shape string, __rule {_RULE}")
    tokens = F.regexp_extract_all("__text", F.lit(_TOKEN), F.lit(0))
    deep = spread_join(whole, deep_rules, ["__shape"], "__key").select("__key", tokens.alias("__tok"), "__rule")
    deep = deep.select("__key", F.transform("__rule", lambda r: _value(F.col("__tok"), r)).alias("__v"))

    known = table_or_none(rules, "__shape", "__rule")
    if known is not None:
        rule = lambda p: F.get(F.try_element_at(known, p["s"]), F.lit(0))
        values = F.transform("__p", lambda p: _value(F.regexp_extract_all(p["t"], F.lit(_PIECE_TOKEN), F.lit(0)), rule(p)))
        cut_values = cutup.select("__key", values.alias("__v"))
    else:
        flat = cutup.withColumn("__doc", F.monotonically_increasing_id()).select("__doc", "__key", F.posexplode("__p").alias("__n", "p")).select("__doc", "__key", "__n", F.col("p.t").alias("__t"), F.col("p.s").alias("__shape"))
        met = spread_join(cut(flat), rules, ["__shape"], "__n").withColumn("__one", F.get("__rule", F.lit(0)))
        value = _value(F.regexp_extract_all("__t", F.lit(_PIECE_TOKEN), F.lit(0)), F.col("__one"))
        rows = met.select("__doc", "__key", F.struct("__n", value.alias("v")).alias("x")).groupBy("__doc", "__key").agg(F.array_sort(F.collect_list("x")).alias("x"))
        cut_values = rows.select("__key", F.col("x.v").alias("__v"))
    items = F.filter("__v", lambda x: x.isNotNull() & (x != ""))
    out = cut_values.unionByName(deep).select("__key", F.posexplode(items).alias("__p", "item"))
    return out.select(F.col("__key").alias(key), (F.col("__p") + 1).alias("item_pos"), "item")
