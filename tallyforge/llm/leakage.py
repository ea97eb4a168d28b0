"""Passages of test items that stand, wholly or partly, in a corpus.

A passage of `passage` words may differ by `edits` words. Cut into edits + 1 pieces, at least one of them stands
unchanged: any `edits` changes spoil at most as many. Since a passage may begin at any word of its item, the pieces of
all passages are the item's stretches of `passage // (edits + 1)` words. They form a table, one row a stretch with its
digest and the words around it. The corpus is read once: stretches whose digest isn't among the items' (a bitmap of
bounded size tells) are passed over, the others are joined to the table by digest, and each hit is verified with Myers'
bit-parallel edit distance, on words, of the passages that hold the piece against the words around the hit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut, spread_join

#: Bits of the largest bitmap of digests sent to the executors (16 MB), as a power of two, and bits a digest.
MOST_BITS, BITS_EACH = 27, 64

_BROKEN = re.compile(r"(?<=[^\W_])[-‐‑­][^\S\n]*\r?\n\s*(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


_HYPHENED = re.compile(r"[-‐‑­][^\S\n]*\r?\n")
#: Every byte but ASCII letters and digits a blank.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case; a word broken by a hyphen at a line end is one. Lines of ASCII alone
    need no regular expression."""
    if _HYPHENED.search(text):
        text = _BROKEN.sub("", text)
    if text.isascii():
        return text.lower().encode().translate(_PLAIN).decode().split()
    out: list[str] = []
    for line in text.split("\n"):
        out += line.lower().encode().translate(_PLAIN).decode().split() if line.isascii() else _WORD.findall(line.lower())
    return out


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(least edit distance of the pattern to a stretch of the text, end of the first such stretch), on words."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Digests:
    """64-bit digests of all stretches of `piece` words; digests of words are kept, up to a million at a time."""

    def __init__(self, piece: int):
        self.piece, self.known = piece, {}

    def of(self, words: list[str]) -> np.ndarray:
        return self.stretches(self.words(words), self.piece)

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def stretches(h: np.ndarray, piece: int) -> np.ndarray:
        n = len(h) - piece + 1
        out = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(piece if n > 0 else 0):
            out = (out ^ (out >> np.uint64(29))) * _FACTOR + h[j : j + n]
        return out ^ (out >> np.uint64(32))


def _pieces(items: DataFrame, key: str, text: str, passage: int, edits: int, piece: int) -> DataFrame:
    """Cut table (h, i, at, left, words, size): every piece of every item's passages, the item's words around it, how
    many of these stand before it, and the words of a passage (all of the item if it is shorter)."""
    room = passage - piece

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests = Digests(piece)
        for b in batches:
            out = []
            for i, t in zip(b["i"], b["t"]):
                ws = words_of(t)
                for at, h in enumerate(digests.of(ws).view(np.int64).tolist()):
                    lo = max(0, at - room)
                    out.append((h, i, at, at - lo, ws[lo : at + piece + room], min(passage, len(ws))))
            yield pd.DataFrame(out, columns=["h", "i", "at", "left", "words", "size"]).astype({"h": "int64", "at": "int32", "left": "int32", "size": "int32", "i": b["i"].dtype})

    rows = items.select(F.col(key).alias("i"), F.col(text).alias("t")).filter((F.length("t") > 0) & F.col("i").isNotNull()).distinct()
    return cut(rows.mapInPandas(work, f"h long, i {dict(items.dtypes)[key]}, at int, left int, words array<string>, size int"))


def bitmap_of(digests: DataFrame) -> tuple[np.ndarray, int]:
    """(words of 64 bits, bits as a power of two) of a (cut) table with digests `h`: a bit for the low end of each. The
    driver gets one number a word, of which there are at most 2 ** (MOST_BITS - 6); with more digests than fit it only
    lets more through."""
    bits = max(10, min(MOST_BITS, (BITS_EACH * max(1, digests.count())).bit_length()))
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = digests.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return out.view(np.uint64), bits


def held(bitmap: tuple[np.ndarray, int], digests: np.ndarray) -> np.ndarray:
    """The places of the digests whose bit is set."""
    low = digests & np.uint64((1 << bitmap[1]) - 1)
    return np.flatnonzero((bitmap[0][low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))


def leaked_passages(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, passage: int = 10, edits: int = 1) -> DataFrame:
    """Rows (doc_key, item_key, edits, words, first_word), one per document and item: some `passage` consecutive words
    of the item stand in the document with at most `edits` words changed, added or left out. `edits` is the least
    distance found, `words` the length of the passages compared, `first_word` the first place of a hit, from 1.

    An item shorter than a passage is one passage, and found if it stands in the document unchanged; items shorter than
    a piece are left out. Every document is searched whole for every item, in one scan. Null and empty texts hold
    nothing; null keys are left out; repeated rows count once; item keys with several texts are taken apart by text and
    joined by key. Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    piece = passage // (edits + 1)
    room = passage - piece
    margin = room + edits
    pieces = _pieces(items, item_key, item_text, passage, edits, piece)
    sent = spark.sparkContext.broadcast(bitmap_of(pieces))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests = Digests(piece)
        for b in batches:
            out = []
            for d, t in zip(b["d"], b["t"]):
                ws = words_of(t)
                h = digests.of(ws)
                for at in held(sent.value, h).tolist():
                    lo = max(0, at - margin)
                    out.append((int(h[at : at + 1].view(np.int64)[0]), d, at, at - lo, ws[lo : at + piece + margin]))
            yield pd.DataFrame(out, columns=["h", "d", "d_at", "d_left", "d_words"]).astype({"h": "int64", "d_at": "int32", "d_left": "int32", "d": b["d"].dtype})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, i, d_at, d_left, d_words, left, words, size in zip(b["d"], b["i"], b["d_at"], b["d_left"], b["d_words"], b["left"], b["words"], b["size"]):
                iw, dw = list(words), list(d_words)
                allowed = edits if size == passage else 0
                for k in range(edits + 1) if size == passage else range(size - piece + 1):
                    a = left - (k * piece if size == passage else k)  # the passage's first word, the piece being its k-th
                    if a < 0 or a + size > len(iw):
                        continue
                    lo = max(0, d_left - (left - a) - allowed)
                    e, _ = myers(iw[a : a + size], dw[lo : d_left + size - (left - a) + allowed])
                    if e <= allowed:
                        out.append((d, i, e, size, d_at))
            yield pd.DataFrame(out, columns=["d", "i", "edits", "words", "first_word"]).astype({"edits": "int32", "words": "int32", "first_word": "int32", "d": b["d"].dtype, "i": b["i"].dtype})

    d_type, i_type = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    rows = docs.select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t")).filter((F.length("t") > 0) & F.col("d").isNotNull())
    hits = rows.mapInPandas(scan, f"h long, d {d_type}, d_at int, d_left int, d_words array<string>")
    met = spread_join(hits, pieces, ["h"], "d").drop("h", "at")
    found = met.mapInPandas(verify, f"d {d_type}, i {i_type}, edits int, words int, first_word int")
    best = found.groupBy("d", "i").agg(F.min("edits").alias("edits"), F.max("words").alias("words"), (F.min("first_word") + 1).alias("first_word"))
    return best.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), "edits", "words", "first_word")
