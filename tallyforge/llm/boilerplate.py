"""Lines and blocks of lines repeated across the documents of one source.

Lines that recur too seldom can be in no repeated block, so they are counted out first; what is left of a document is its
runs, stretches of neighbouring lines that each recur. A suffix is the rest of a run from one of its lines, whatever its
length. All suffixes of a source, put in order, form its suffix array; the common prefixes of neighbours are the blocks
that recur. The array is built distributed: documents with the same runs are combined before anything is cut into
suffixes, equal suffixes before the shuffle, the sort is by range, and a common prefix that reaches the edge of a batch
is summed over batches, so no source is ever held by one task. A document is counted once per block: within a document
each suffix knows how many lines it shares with the one before it in the document's own order, and adds only to longer
prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut, spread_join

_WIDE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def source_key(column: str):
    """Sources are the same if they agree but for case and outer blanks."""
    return F.lower(F.regexp_replace(column, f"^[{_WIDE}]+|[{_WIDE}]+$", ""))


def line_ids(text: str, min_chars: int):
    """An identifier per line, 0 for lines too short; equal but for case, white space, punctuation and digits."""
    squeezed = lambda x: F.regexp_replace(F.regexp_replace(x, f"^[{_WIDE}]+|[{_WIDE}]+$", ""), f"[{_WIDE}]{{2,}}", " ")
    letters = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}]+", "")
    known = lambda x: F.when(F.length(x) < min_chars, F.lit(0)).when(F.length(squeezed(x)) < min_chars, F.lit(0)).otherwise(F.xxhash64(letters(x)))
    return F.transform(F.split(F.col(text), "\n", -1), known)


def documents_with_ids(df: DataFrame, key: str, source: str, text: str, min_chars: int = 30) -> DataFrame:
    """Cut table (id, src, texts): a document's distinct texts as line identifiers, so that texts aren't shuffled;
    documents without source are left out, null texts have no lines but their document counts."""
    rows = df.select(F.col(key).alias("id"), source_key(source).alias("src"), F.col(text).alias("text")).filter(F.col("src") != "")
    ids = rows.select("id", "src", line_ids("text", min_chars).alias("ids"))
    return cut(ids.groupBy("id", "src").agg(F.collect_set("ids").alias("texts")))


def _need(docs: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Rows (src, need): documents a block of the source must stand in."""
    return docs.groupBy("src").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(min_share)).alias("need"))


def _with_runs(docs: DataFrame, need: DataFrame) -> DataFrame:
    """docs with `kept`: texts, identifiers of lines that recur too seldom set to 0. A source has at most 1 / min_share
    times its lines a document of the others, so they travel as one array a source."""
    counts = docs.select("src", F.explode(F.array_distinct(F.flatten("texts"))).alias("h")).filter("h <> 0").groupBy("src", "h").agg(F.count("*").alias("docs"))
    often = spread_join(counts, need, ["src"], "h").filter("docs >= need").groupBy("src").agg(F.collect_set("h").alias("often"))
    kept = F.transform("texts", lambda t: F.transform(t, lambda x: F.when(F.array_contains("often", x), x).otherwise(F.lit(0))))
    return spread_join(docs, often, ["src"], "id").select("id", "src", kept.alias("kept"))


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(src, suffix, skip, n) of rows (src, kept, n): the suffixes of all runs of n documents."""
    for b in batches:
        out = []
        for src, kept, n in zip(b["src"], b["kept"], b["n"]):
            own = set()
            for ids in kept:
                run: list[int] = []
                for x in [*map(int, ids), 0]:
                    if x:
                        run.append(x)
                    else:
                        own.update(tuple(run[i:]) for i in range(len(run)))
                        run = []
            last: tuple = ()
            for s in sorted(own):
                shared = next((k for k, (x, y) in enumerate(zip(s, last)) if x != y), min(len(s), len(last)))
                out.append((src, list(s), shared, n))
                last = s
        yield pd.DataFrame(out, columns=["src", "suffix", "skip", "n"]).astype({"skip": "int32", "n": "int64"})


def _common_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a sorted stretch of the array: the documents of each run of suffixes with a common prefix of each length."""
    for b in batches:
        if not len(b):
            continue
        suffixes, sizes = b["suffix"].tolist(), b["suffix"].map(len).to_numpy()
        skips, docs, src = b["skip"].to_numpy(), b["n"].to_numpy(), b["src"].to_numpy()
        same = np.ones(len(b), dtype=bool)
        same[0], same[1:] = False, src[1:] == src[:-1]
        for k in range(1, int(sizes.max()) + 1):
            column = np.array([s[k - 1] if len(s) >= k else 0 for s in suffixes], dtype=np.int64)
            same = same.copy()
            same[1:] &= (column[1:] == column[:-1]) & (sizes[1:] >= k) & (sizes[:-1] >= k)
            start = np.flatnonzero(~same)
            total = np.add.reduceat(np.where((skips < k) & (sizes >= k), docs, 0), start)
            edge = np.zeros(len(start), dtype=bool)
            edge[0] = edge[-1] = True
            keep = (sizes[start] >= k) & ((total > 1) | edge)
            if keep.any():
                at = start[keep]
                yield pd.DataFrame({"src": src[at], "k": np.int32(k), "block": [list(suffixes[i][:k]) for i in at], "docs": total[keep]})


def _blocks(kept: DataFrame, need: DataFrame) -> DataFrame:
    """Cut table (src, k, block, docs): every block of lines that stands in enough documents of its source."""
    combined = kept.filter(F.exists("kept", lambda t: F.exists(t, lambda x: x != 0))).groupBy("src", "kept").agg(F.count("*").alias("n"))
    array = combined.mapInPandas(_suffixes, "src string, suffix array<long>, skip int, n long").groupBy("src", "suffix", "skip").agg(F.sum("n").alias("n"))
    array = array.repartitionByRange("src", "suffix").sortWithinPartitions("src", "suffix")
    runs = array.mapInPandas(_common_prefixes, "src string, k int, block array<long>, docs long").groupBy("src", "k", "block").agg(F.sum("docs").alias("docs"))
    return cut(spread_join(runs, need, ["src"], "block").filter("docs >= need").select("src", "k", "block", "docs"))


def repeated_blocks(docs: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """Rows (src, k, block, docs): every block of k lines, however many, that stands in at least `min_docs` documents of
    its source and at least `min_share` of them. `docs` comes from documents_with_ids."""
    need = cut(_need(docs, min_docs, min_share))
    return _blocks(_with_runs(docs, need), need)


def maximal_blocks(blocks: DataFrame) -> DataFrame:
    """The repeated blocks that no line before or after extends to another repeated block."""
    longer = blocks.filter("k > 1")
    within = longer.select("src", F.slice("block", F.lit(1), F.col("k") - 1).alias("block")).union(longer.select("src", F.slice("block", F.lit(2), F.col("k") - 1).alias("block")))
    return blocks.join(within.distinct(), ["src", "block"], "left_anti").select("src", "k", "block", "docs")


def repeated_lines(df: DataFrame, key: str, source: str, text: str, min_chars: int = 30, min_docs: int = 5, min_share: float = 0.2, least_lines: int = 1) -> DataFrame:
    """Rows (key, line_no), lines counted from 1: the lines of each document that lie in a repeated block of at least
    `least_lines` lines.

    Lines shorter than `min_chars` (trimmed, inner blanks reduced to one) belong to no block. Documents with null,
    empty or blank source are left out, null texts have no lines but count as documents of their source, repeated
    rows count once, and a document with several texts counts once. Empty input gives no rows; other columns are ignored.
    """
    docs = documents_with_ids(df, key, source, text, min_chars)
    need = cut(_need(docs, min_docs, min_share))
    kept = cut(_with_runs(docs, need))
    # A block's first least_lines lines recur too, so blocks of that length cover the lines of all longer ones.
    blocks = _blocks(kept, need).filter(F.col("k") == least_lines).groupBy("src").agg(F.collect_set(F.xxhash64("block")).alias("blocks"))
    joined = spread_join(kept, blocks, ["src"], "id")

    def lines_of(t):
        begins = F.transform(t, lambda x, i: (x != 0) & F.array_contains("blocks", F.xxhash64(F.slice(t, i + 1, least_lines))))
        inside = lambda i: F.exists(F.slice(begins, F.greatest(i - (least_lines - 2), F.lit(1)), F.least(i + 1, F.lit(least_lines))), lambda b: b) if least_lines > 1 else F.get(begins, i)
        return F.array_compact(F.transform(begins, lambda _, i: F.when(inside(i), i + 1)))

    found = joined.select("id", F.explode(F.array_distinct(F.flatten(F.transform("kept", lines_of)))).alias("line_no"))
    return found.distinct().select(F.col("id").alias(key), F.col("line_no").cast("int").alias("line_no"))


def without_repeated_lines(df: DataFrame, key: str, source: str, text: str, min_chars: int = 30, min_docs: int = 5, min_share: float = 0.2, least_lines: int = 1) -> DataFrame:
    """Rows (key, clean_text, removed): each document without its repeated lines, and how many were removed.
    Documents without source keep their text; null texts stay null. Repeated rows come out once: rows of one key and
    one digest of the text are joined, so only a row a text is moved."""
    lines = repeated_lines(df, key, source, text, min_chars, min_docs, min_share, least_lines).groupBy(key).agg(F.collect_set("line_no").alias("__bad"))
    rows = spread_join(df.select(F.col(key), F.col(text).alias("__text")), lines, [key], key, "left")
    kept = F.filter(F.transform(F.split("__text", "\n", -1), lambda x, i: F.when(~F.array_contains("__bad", i + 1), x)), lambda x: x.isNotNull())
    clean = F.when(F.col("__bad").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(key, clean.alias("clean_text"), F.coalesce(F.size("__bad"), F.lit(0)).alias("removed")).distinct()
