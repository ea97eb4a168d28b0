"""Texts that were cut off inside a word or sentence.

Evidence, all of it counted over the whole corpus, equal texts once, the last word of each text and words before an
ellipsis left out, words broken at a line end joined:

* a vocabulary trie, held as one row per node: the final token is no known word but a proper prefix of one;
* contexts: how often the final word, and the final two and three words, are followed by the end of a sentence or line
  rather than by another word;
* lengths: a number of characters or bytes at which far more texts end than at its neighbours, in the corpus;
* closing lines: final lines that several texts share ("page 3 of 7"), digits aside, are complete unless lines often
  begin with the same characters and go on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.leakage import Digests, bitmap_of, held
from tallyforge.session import cut, spread_join

#: A word, a number with its per cent sign, or the end of a sentence or line. The only tokeniser here.
TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*%?|[.!?…]+(?=[\s\"”’)]|$)|\n+")
DIGITS, STOPS = re.compile(r"\d+"), frozenset(".!?…\n")
#: A hyphen at which a word is broken over two lines; a word that an ellipsis may have cut, in counts of words.
HYPHEN = re.compile(r"[-‐‑\xad](?<=[^\W_].)[ \t]*\r?\n\s*(?=[^\W_])")
HIDDEN = "\0"
OPEN_END = r"[,;:(\[{“„«\-–—/&•▪*]$"
ENTITY_END = re.compile(r"&#?\w{0,6}$")
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2007\u202f\u3000"
WORD_END = r"[\p{L}\p{M}\p{N}%]$"


def tokens_of(text: str) -> list[str]:
    """Tokens in lower case, every number the same, a word broken by a hyphen at a line end in one piece."""
    return TOKEN.findall(DIGITS.sub("0", HYPHEN.sub("", text).lower()))


def ending(text: str) -> tuple[str, bool, bool]:
    """The text without an ellipsis or replacement character at its end; whether it ended in a replacement character, in an ellipsis."""
    t = text.rstrip(BLANKS)
    broken, dots = t.endswith("\ufffd"), t.endswith(("…", "..."))
    return t.rstrip(BLANKS + "….") if dots else t.rstrip("\ufffd") if broken else t, broken, dots


def last_tokens(text: str, n: int = 3) -> list[str]:
    """The last n tokens; only as much of the text's end is cut up as holds them."""
    size = 256
    while size < len(text):
        tail = text[-size:]
        blank = min((i for i in map(tail.find, " \t\r") if i >= 0), default=-1)
        if blank >= 0:
            toks = tokens_of(tail[blank:])
            if len(toks) > n + 1:  # the first two may be the end of a broken word
                return toks[-n:]
        size *= 4
    return tokens_of(text)[-n:]


def _finals(df: DataFrame, key: str, source: str, text: str, words: int) -> DataFrame:
    """Cut table (id, src, h, chars, octets, broken, dots, entity, last, line, w, times): how each distinct row's text
    ends; `h` is its digest, `line` its final line if that has at most `words` tokens, `w` its last three tokens, `times`
    how often the row is there."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, src, text, h in zip(b["id"], b["src"], b["t"], b["h"]):
                t, broken, dots = ending(text)
                entity, start = bool(ENTITY_END.search(text.rstrip(BLANKS)[-10:])), t.rfind("\n") + 1
                toks = list(islice((m.group() for m in TOKEN.finditer(DIGITS.sub("0", t[start:].lower()))), words + 1))
                whole = len(toks) <= words and not HYPHEN.search(t[max(0, start - 9) : start + 1])
                out.append((i, src, h, len(text), len(text.encode("utf-8", "replace")), broken, dots, entity, t[-1:], " ".join(toks) if whole else None, last_tokens(t)))
            yield pd.DataFrame(out, columns=["id", "src", "h", "chars", "octets", "broken", "dots", "entity", "last", "line", "w"]).astype({"id": b["id"].dtype, "chars": "int64", "octets": "int64"})

    rows = df.select(F.col(key).alias("id"), F.col(source).alias("src"), F.col(text).alias("t")).filter(F.col("t").isNotNull()).withColumn("h", F.md5("t"))
    kinds = dict(rows.dtypes)
    found = rows.mapInPandas(scan, f"id {kinds['id']}, src {kinds['src']}, h string, chars long, octets long, broken boolean, dots boolean, entity boolean, last string, line string, w array<string>")
    return cut(found.groupBy(*found.columns).agg(F.count("*").alias("times")))


def truncation_evidence(df: DataFrame, key: str, source: str, text: str, min_known: int = 2, min_seen: int = 3, min_peak: int = 8, peak: float = 10.0, closing_docs: int = 3, closing_words: int = 8) -> DataFrame:
    """Rows (key, source, chars, is_cut, reason), one per distinct row. Equal texts count once in everything, so copies of
    a corpus under other keys change nothing, though the texts themselves are moved only if the digests of repeated ones
    can't be broadcast.

    `reason`: 'character' (ends in the replacement character), 'open' (ends in a comma, dash, opening bracket, bullet
    or part of a character reference), 'prefix' (trie: no known word but the start of one, or in a context never seen
    a word far rarer than those it starts), 'context' (hardly ever seen before an end), 'length' (at a length peak, in
    a context never seen or one that usually goes on, or before an ellipsis); null if not cut. A text that ends in a full stop, a question or exclamation mark, or a closing quote or
    bracket isn't cut; an ellipsis is, if what stands before it was. Null, empty and blank texts aren't cut.
    `closing_docs`, `closing_words`: texts that share a closing line, and the words of the longest one.
    `min_known`: texts a known word occurs in as often at least; `min_seen`: occurrences from which a longer context
    is trusted; `min_peak`, `peak`: texts at a length, at least and as a multiple of those at the lengths near it.
    """
    finals = _finals(df, key, source, text, closing_words)
    texts = cut(finals.groupBy("h", "chars", "octets", "line").agg(F.min(F.struct("id", "src", "times")).alias("first"), F.sum("times").alias("times")))
    again = texts.filter("times > 1").select("h", F.col("first.id").alias("first_id"), F.col("first.src").alias("first_src"), (F.col("first.times") > 1).alias("often"))

    # Contexts wanted: those of texts that end in a word; final lines that several texts share.
    asked = finals.filter(F.col("last").rlike(WORD_END)).select(
        F.when(F.size("w") >= 2, F.concat_ws(" ", F.slice("w", -2, 2))).alias("w2"),
        F.when(F.size("w") >= 3, F.concat_ws(" ", "w")).alias("w3"),
    )
    grams = cut(asked.select(F.explode(F.array_compact(F.array("w2", "w3"))).alias("g")).distinct())
    shared = texts.filter(F.size(F.split("line", " ")) >= 2).groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= closing_docs)
    shared = cut(shared)

    # One pass over all tokens: how often each word, and each context wanted, is followed by anything, and by an end.
    counts = cut(_counted(df, key, source, text, grams, shared, again, closing_words))
    vocabulary = counts.filter((F.col("words") == 1) & (F.col("n") >= min_known)).select(F.col("g").alias("w"), "n", "ends")
    contexts = spread_join(counts.filter("words IN (2, 3)").select("g", "n", "ends"), grams, ["g"], "n").filter(F.col("n") >= min_seen)
    begun = counts.filter("words = 0")
    size = F.length(F.substring_index("g", " ", -1))
    inside = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(F.col("g"), F.lit(1), F.length("g") - i))
    longer = begun.filter(size > 1).select(F.explode(inside).alias("line"), "n").groupBy("line").agg(F.sum("n").alias("n"))
    opened = begun.select(F.col("g").alias("line"), (F.col("n") - F.col("ends")).alias("n")).unionByName(longer).join(shared.select("line"), "line", "left_semi").groupBy("line").agg(F.sum("n").alias("more"))
    closings = shared.join(opened, "line", "left").filter(F.coalesce("more", F.lit(0)) <= 0.2 * F.col("n")).select("line", F.lit(True).alias("closing"))

    # The trie's nodes under unknown final tokens.
    unknown = finals.filter(F.col("last").rlike(WORD_END)).select(F.try_element_at("w", F.lit(-1)).alias("w")).distinct().join(vocabulary.select("w"), "w", "left_anti")
    stems = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), F.lit(1), i))
    nodes = vocabulary.filter(F.length("w") > 1).select(F.explode(stems).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("below"))
    stubs = unknown.join(nodes, "w", "left_semi").select("w", F.lit(True).alias("stub"))
    known = vocabulary.join(nodes, "w", "left").select("w", "n", "ends", F.coalesce("below", F.lit(0)).alias("below"))

    peaks = _peaks(texts, "chars", min_peak, peak).withColumnRenamed("peak", "char_peak")
    octet_peaks = _peaks(texts, "octets", min_peak, peak).withColumnRenamed("peak", "octet_peak")

    x = finals.withColumns({"w1": F.try_element_at("w", F.lit(-1)), "w2": F.when(F.size("w") >= 2, F.concat_ws(" ", F.slice("w", -2, 2))), "w3": F.when(F.size("w") >= 3, F.concat_ws(" ", "w"))})
    x = spread_join(x, known.select(F.col("w").alias("w1"), F.col("n").alias("n1"), F.col("ends").alias("e1"), "below"), ["w1"], "id", "left")
    for k in ("2", "3"):
        x = spread_join(x, contexts.select(F.col("g").alias("w" + k), F.col("n").alias("n" + k), F.col("ends").alias("e" + k)), ["w" + k], "id", "left")
    x = spread_join(x, stubs.withColumnRenamed("w", "w1"), ["w1"], "id", "left")
    x = spread_join(x, closings, ["line"], "id", "left")
    x = spread_join(spread_join(x, peaks, ["chars"], "id", "left"), octet_peaks, ["octets"], "id", "left")

    in_word = F.col("last").rlike(WORD_END)
    ends = F.coalesce(F.col("e3") / F.col("n3"), F.col("e2") / F.col("n2"), F.col("e1") / F.col("n1"))
    at_peak = F.coalesce("char_peak", F.lit(False)) | F.coalesce("octet_peak", F.lit(False))
    closing = F.coalesce("closing", F.lit(False))
    unseen = F.col("n3").isNull() & F.col("n2").isNull() & F.col("w2").isNotNull()
    reason = (
        F.when(F.col("broken"), "character")
        .when(F.col("entity") | F.col("last").rlike(OPEN_END), "open")
        .when(~in_word, None)
        .when(F.col("stub"), "prefix")
        .when(closing, None)
        .when(unseen & (F.col("below") >= 20 * F.col("n1")), "prefix")
        .when((at_peak & F.col("dots")) | (at_peak & unseen), "length")
        .when(ends.isNull(), None)
        .when(ends <= 0.02, "context")
        .when(at_peak & (ends <= 0.6), "length")
    )
    out = x.select(F.col("id").alias(key), F.col("src").alias(source), "chars", reason.alias("reason"))
    return out.select(key, source, "chars", F.col("reason").isNotNull().alias("is_cut"), "reason")


def _counted(df: DataFrame, key: str, source: str, text: str, grams: DataFrame, shared: DataFrame, again: DataFrame, most: int) -> DataFrame:
    """Rows (words, g, n, ends): counts of every word (1), of the contexts of two or three words among `grams` (and a few
    others that share a bit with one), and of the beginnings of lines that have the first words of one of the `shared`
    lines, `ends` being whole lines (0).

    Bitmaps of bounded size tell which contexts and lines are wanted. Of the rows of a text that is there `again`, those
    of its first key count, and where that has several, their counts bear the text's digest, under which they fall
    together. A task's table is emptied whenever it holds half a million entries."""
    spark = df.sparkSession

    def of(table: DataFrame, column: str, size: int | None, take: int | None = None):
        def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            d = Digests(1)
            for b in batches:
                parts = [g.split(" ")[:take] for g in b[column]]
                yield pd.DataFrame({"h": [int(d.stretches(d.words(p), len(p)).astype("int64")[0]) for p in parts if size is None or len(p) == size]}).astype("int64")

        return bitmap_of(cut(table.mapInPandas(digest, "h long").distinct()))

    sent = spark.sparkContext.broadcast((of(grams, "g", 2), of(grams, "g", 3), of(shared, "line", None, 2), of(shared.filter(F.size(F.split("line", " ")) == 2), "line", None, 1), most))
    rows = df.select(F.col(key).alias("id"), F.col(source).alias("src"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    rows = spread_join(rows.withColumn("h", F.md5("t")), again, ["h"], "id", "left")
    rows = rows.filter(F.col("often").isNull() | (F.col("id").eqNullSafe(F.col("first_id")) & F.col("src").eqNullSafe(F.col("first_src"))))
    rows = rows.select("t", F.when(F.col("often"), F.col("h")).alias("dup"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, triples, lines, heads, most = sent.value
        digests = Digests(2)
        n: list[Counter] = [Counter() for _ in range(4)]
        ends: list[Counter] = [Counter() for _ in range(4)]

        def out(dup=None):
            for w in [w for w in n[1] if w[0] in STOPS or w == HIDDEN]:
                del n[1][w]
            for k in range(4):
                if n[k]:
                    yield pd.DataFrame({"words": k, "g": list(n[k]), "dup": pd.Series([dup] * len(n[k]), dtype=object), "n": list(n[k].values()), "ends": [ends[k][g] for g in n[k]]}).astype({"words": "int32", "n": "int64", "ends": "int64"})
                n[k].clear()
                ends[k].clear()

        def count(text: str) -> None:
            toks = tokens_of(ENTITY_END.sub("", ending(text)[0]))
            if len(toks) < 2:
                return
            if "…" in text or "..." in text:
                toks = [HIDDEN if "…" in after or "..." in after else w for w, after in zip(toks, [*toks[1:], ""])]
            body = toks[:-1]
            n[1].update(body)
            ends[1].update([body[i] for i, w in enumerate(toks[1:]) if w[0] in STOPS])
            h = digests.words(toks)
            for k, bitmap in ((2, pairs), (3, triples)):
                for i in held(bitmap, digests.stretches(h[:-1], k)).tolist():
                    g = " ".join(body[i : i + k])
                    n[k][g] += 1
                    ends[k][g] += toks[i + k][0] in STOPS
            begins = dict.fromkeys(held(heads, digests.stretches(h, 1)).tolist(), 2) | dict.fromkeys(held(lines, digests.stretches(h, 2)).tolist(), most)
            for i, upto in begins.items():
                if i == 0 or toks[i - 1][0] == "\n":
                    stop = next((j for j in range(i, min(len(toks), i + most + 1)) if toks[j][0] == "\n"), min(len(toks), i + most + 1))
                    for j in range(i + 2, min(stop, i + upto) + 1):
                        g = " ".join(toks[i:j])
                        n[0][g] += 1
                        ends[0][g] += j == stop

        for b in batches:
            again = [(t, d) for t, d in zip(b["t"], b["dup"]) if isinstance(d, str)]
            if again:
                yield from out()
                for t, d in again:
                    count(t)
                    yield from out(d)
            for t, d in zip(b["t"], b["dup"]):
                if not isinstance(d, str):
                    count(t)
            if sum(map(len, n)) > 500_000:
                yield from out()
        yield from out()

    parts = rows.mapInPandas(scan, "words int, g string, dup string, n long, ends long")
    one = lambda c: F.when(F.col("dup").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c)
    return parts.groupBy("words", "g", "dup").agg(one("n"), one("ends")).groupBy("words", "g").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _peaks(finals: DataFrame, column: str, least: int, times: float) -> DataFrame:
    """Lengths at which at least `least` texts end, and `times` the mean of the ten lengths on either side."""
    counts = finals.groupBy(column).agg(F.count("*").alias("n"))
    spread = counts.select(F.explode(F.sequence(F.col(column) - 10, F.col(column) + 10)).alias(column), F.col(column).alias("__from"), "n")
    near = spread.groupBy(column).agg(F.sum(F.when(F.col("__from") != F.col(column), F.col("n")).otherwise(0)).alias("near"), F.max(F.when(F.col("__from") == F.col(column), F.col("n"))).alias("n"))
    return near.filter((F.col("n") >= least) & (F.col("n") >= times * F.greatest(F.col("near") / 20, F.lit(0.25)))).select(column, F.lit(True).alias("peak"))


def truncation_by_source(evidence: DataFrame, source: str) -> DataFrame:
    """Rows (source, texts, cut_texts, share)."""
    n = F.count_if("is_cut")
    return evidence.groupBy(source).agg(F.count("*").alias("texts"), n.alias("cut_texts"), (n / F.count("*")).alias("share"))
