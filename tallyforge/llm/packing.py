"""Containers of fixed capacity filled with items of varying size.

Hierarchical residual packing: every task fills containers best-fit from its own items, largest first, and emits
those that are nearly full. Containers left with room become items of the next round, where they meet others in fewer
tasks; rounds go on while they help. An item larger than the capacity is split into full pieces and a rest first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut

#: Items one best-fit table holds; a task works through its items in lots of this many.
LOT = 100_000


def token_counts(df: DataFrame, key: str, text: str, ranks: str, pattern: str | None = None) -> DataFrame:
    """Rows (key, text_id, n_tokens), one per distinct key and text: tokens of a byte-level BPE whose rank file is at
    `ranks` on every executor (or under a shared folder). `text_id` is a digest, so that texts of one key stay apart.
    `pattern` splits words; by default the usual one of that vocabulary. Null and empty texts have no tokens. Texts
    are counted whole; strings that look like special tokens are plain text."""
    pat = pattern or r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(n) for a, n in map(bytes.split, Path(ranks).read_bytes().splitlines())}
        bpe = tiktoken.Encoding("ranks", pat_str=pat, mergeable_ranks=table, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "text_id": b["d"], "n_tokens": [len(bpe.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    rows = df.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("d"), F.col(text).alias("t"))
    return rows.mapInPandas(count, f"k {dict(df.dtypes)[key]}, text_id long, n_tokens long").distinct().select(F.col("k").alias(key), "text_id", "n_tokens")


class BestFit:
    """Open containers by room left; a bit per room says whether there is one, so best fit is one bit operation."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.bits = capacity, [[] for _ in range(capacity + 1)], 0

    def put(self, size: int, parts: list) -> None:
        fits = self.bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = self.open[room].pop()
            if not self.open[room]:
                self.bits ^= 1 << room
            held.append(parts)
            room -= size
        else:
            held, room = [parts], self.capacity - size
        self.open[room].append(held)
        self.bits |= 1 << room

    def take(self, least_room: int, most_room: int) -> list[tuple[int, list]]:
        out = []
        for room in range(least_room, most_room + 1):
            out += [(self.capacity - room, held) for held in self.open[room]]
            self.open[room] = []
            self.bits &= ~(1 << room)
        return out


def _pack(capacity: int, slack: int, lot: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[tuple] = []

        def rows(bins, full):
            columns = {c: [np.concatenate([x[k] for x in held]) for _, held in bins] for k, c in enumerate(("ids", "texts", "parts", "sizes"), 1)}
            return pd.DataFrame({"full": full, "size": np.array([size for size, _ in bins], dtype=np.int32), **columns})

        def fill(items):
            fit = BestFit(capacity)
            for x in sorted(items, key=lambda x: -x[0]):
                fit.put(x[0], x)
            return fit.take(0, slack), fit.take(slack + 1, capacity)

        for b in batches:
            left += list(zip(b["size"].tolist(), b["ids"], b["texts"], b["parts"], b["sizes"]))
            while len(left) >= lot:
                done, rest = fill(left[:lot])
                if done:
                    yield rows(done, True)
                rest = [(size, *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))) for size, held in rest]
                half = rest[: lot // 2]  # what meets the next lot; more would leave it no room
                if rest[lot // 2 :]:
                    yield rows([(x[0], [x]) for x in rest[lot // 2 :]], False)
                left = half + left[lot:]
        done, rest = fill(left)
        for bins, full in ((done, True), (rest, False)):
            if bins:
                yield rows(bins, full)

    return run


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048, slack: int = 16, lot: int = LOT, rounds: int = 6, text_id: str | None = None) -> DataFrame:
    """Rows (block_id, position, key, part, first_unit, n_units): each item's place, blocks and positions from 0. With
    `text_id`, a column that tells items of one key apart, it comes after the key; keys may be of any type.

    An item is split only if larger than `capacity`, into full parts and a rest; first_unit is where the part begins
    in its item, from 0. A container with at most `slack` units of room is full; the others go on to the next round,
    in so many tasks that each gets about `lot` of them, until a round saves less than one in a hundred or `rounds`
    have passed. So no task ever holds more than a lot, and all containers come out, full or not. Items of null, zero
    or negative size need no room and are left out; repeated rows count once, items of one key and size too unless
    `text_id` tells them apart. Empty input gives no rows.
    """
    mark = F.col(text_id) if text_id else F.lit(0)
    items = sizes.select(F.col(key).alias("id"), mark.cast("long").alias("x"), F.col(size).cast("long").alias("n")).filter("n > 0").distinct()
    pieces = items.select("id", "x", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("part", "at"), "n")
    piece = F.least(F.col("n") - F.col("at"), F.lit(capacity)).cast("int")
    todo = pieces.select(piece.alias("size"), F.array("id").alias("ids"), F.array("x").alias("texts"), F.array(F.col("part").cast("int")).alias("parts"), F.array(piece).alias("sizes"))
    shape = f"full boolean, size int, ids array<{dict(sizes.dtypes)[key]}>, texts array<long>, parts array<int>, sizes array<int>"
    step = _pack(capacity, slack, lot)
    packed = cut(todo.mapInPandas(step, shape))
    done = packed.filter("full")
    open_ = packed.filter("not full")
    before = open_.count()
    for _ in range(rounds):
        if before <= 1:
            break
        tasks = max(1, round(before / lot))
        packed = cut(open_.drop("full").repartition(tasks, F.xxhash64(F.get("ids", F.lit(0)), F.get("texts", F.lit(0)), F.lit(tasks))).mapInPandas(step, shape))
        done = done.unionByName(packed.filter("full"))
        open_ = packed.filter("not full")
        now = open_.count()
        saved, before = before - now - packed.filter("full").count(), now
        if tasks == 1 or saved < 0.01 * before:
            break
    # A block is named by its first part, which no other block holds.
    first = lambda c: F.get(c, F.lit(0))
    name = F.concat_ws(":", first("ids"), *([first("texts")] if text_id else []), first("parts"))
    blocks = done.unionByName(open_).select(name.alias("block_id"), F.posexplode(F.arrays_zip("ids", "texts", "parts", "sizes")).alias("position", "x"))
    marks = [F.col("x.texts").alias(text_id)] if text_id else []
    return blocks.select("block_id", "position", F.col("x.ids").alias(key), *marks, F.col("x.parts").alias("part"), (F.col("x.parts").cast("long") * capacity).alias("first_unit"), F.col("x.sizes").alias("n_units"))
