"""Records that are the same but for formatting.

A record is read as a tree: an unordered node of labelled lines ("Label: value") followed by the body. Leaves are
normalised (case, white space and punctuation dropped) and hashed, the digests of the labelled lines are sorted, and
the root is the digest of both. Records with the same root are one, confirmed by comparing the whole normalised form.

Where a record's layout was flattened, its lines can't be told apart, and neither can the end of its last label's value
from the body. Whatever the layout, copies hold the same letters and digits: records are gathered by the counts of
these, and only within such a bag is a flattened record laid over the others' labelled lines.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut, spread_join

#: Words of a value that is taken for one although no record has it on a line of its own. It only matters for a label
#: that stands at the same place in front of two flattened records.
MAX_WORDS = 6

_MARKS = "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c)[0] == "M")
_NAME = r"[^\W\d_](?:[^\W_]| ){0,30}?"
_LABEL, _COLON, _OTHER = re.compile(rf"[\W_]*({_NAME})\s*:\s*\S"), re.compile(r"((?:[^\W_]|\s){1,40})\s*:"), re.compile(f"[^\\w{_MARKS}]+|_+")


#: Every byte but ASCII letters and digits.
_DROPPED = bytes(c for c in range(256) if not (c < 128 and chr(c).isalnum()))


def _plain(x: str) -> str:
    """Letters, digits and combining marks alone; text of ASCII needs no regular expression."""
    if x.isascii():
        return x.encode().translate(None, _DROPPED).decode()
    if "\n" in x:
        return "".join(map(_plain, x.split("\n")))
    return _OTHER.sub("", x)


def _lower(text: str) -> str:
    return text.replace("\r", " ").replace("\xa0", " ").lower()


def _tree(t: str) -> tuple[list[str], list[str], str]:
    """(leaves, their names, body): the labelled lines that lead the text, each up to its line end."""
    leaves, found, at = [], [], 0
    while at < len(t):
        end = t.find("\n", at)
        end = len(t) if end < 0 else end
        line = t[at:end]
        leaf = _plain(line)
        if leaf:  # rules and empty lines belong to neither
            m = _LABEL.match(line)
            if not m:
                break
            leaves.append(leaf)
            found.append(" ".join(m[1].split()))
        at = end + 1
    return leaves, found, _plain(t[at:])


def _digests(leaves: list[str], body: str) -> tuple[str, str]:
    """(bag, root): the digest of the counts of bytes, the same for any order of lines, and the Merkle root."""
    counts = np.bincount(np.frombuffer("".join([*leaves, body]).encode(), dtype=np.uint8), minlength=256)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return hashlib.sha256(counts.tobytes()).hexdigest()[:32], digest("".join(sorted(map(digest, leaves))) + digest(body))


def _laid_over(plain: str, leaves: list[str], body: str) -> bool:
    """Whether the text is the leaves in some order, then the body."""
    if not plain.endswith(body):
        return False
    stop, seen = len(plain) - len(body), set()
    kinds = Counter(leaves)
    stack = [(0, tuple(kinds.values()))]
    while stack:
        at, left = stack.pop()
        if at == stop and not any(left):
            return True
        for i, leaf in enumerate(kinds):
            if left[i] and plain.startswith(leaf, at):
                step = at + len(leaf), (*left[:i], left[i] - 1, *left[i + 1 :])
                if step not in seen:
                    seen.add(step)
                    stack.append(step)
    return False


def _pieces(t: str, names: list[str]) -> tuple[list[str], list[float], bool]:
    """(pieces, words of their values, flat): a text cut before each name. A piece that holds whole lines after its own
    has infinitely many words; flat if a line holds several names, or more than MAX_WORDS words, maybe of the body."""
    alt = "|".join(r"\s+".join(map(re.escape, n.split(" "))) for n in sorted(names, key=lambda x: (-len(x), x)))
    at = [m.start() for m in re.finditer(rf"(?<![^\W_])(?:{alt})\s*:", t)] if names else []
    if not at or _plain(t[: at[0]]):
        return [], [], False
    cuts = [t[a:b].split(":", 1) for a, b in zip(at, [*at[1:], len(t)])]
    lines = [value.lstrip().partition("\n") for _, value in cuts]
    words = [float("inf") if _plain(rest) else sum(bool(_plain(w)) for w in own.split()) for own, _, rest in lines]
    flat = any("\n" not in value for _, value in cuts[:-1]) or any(len(own.split()) > MAX_WORDS for own, _, _ in lines)
    return [_plain("".join(c)) for c in cuts], words, flat


def _reordered(a: tuple[list[str], list[float], bool], b: tuple[list[str], list[float], bool], offered: set[str]) -> bool:
    """Whether two flattened records are the same labels in another order, then the same body. The end of the value
    that one has last is known from the other, where a label follows it."""
    n = 0
    while n < min(len(a[0]), len(b[0])) and a[0][-1 - n] == b[0][-1 - n]:
        n += 1
    x, y = a[0][: len(a[0]) - n], b[0][: len(b[0]) - n]
    if not (x and y and a[2] and b[2]) or float("inf") in a[1][: len(x) - 1] + b[1][: len(y) - 1]:
        return False
    for p, q, size in zip(x, y, a[1]):
        if p != q:
            break
        if size > MAX_WORDS and p not in offered:
            return False
    more, less = Counter(x[:-1]) - Counter(y[:-1]), Counter(y[:-1]) - Counter(x[:-1])
    if sum(more.values()) != 1 or sum(less.values()) != 1:
        return False
    mine, other = next(iter(less)), next(iter(more))
    return x[-1].startswith(mine) and y[-1].startswith(other) and x[-1][len(mine) :] == y[-1][len(other) :]


def _classes(b: pd.DataFrame) -> pd.DataFrame:
    """The forms of one bag, and the smallest id of each one's class."""
    texts = [_lower(t) for t in b["text"]]
    names = list(b["known"].iloc[0]) if b["known"].iloc[0] is not None else []
    trees = [_tree(t) for t in texts]
    plain, pieces = [_plain(t) for t in texts], [_pieces(t, names) for t in texts]
    offered = {leaf for leaves, _, body in trees if len(leaves) > 1 or body for leaf in leaves}
    group = list(range(len(b)))
    for i in range(len(b)):
        for j in range(i):
            if group[i] != group[j] and (_laid_over(plain[i], trees[j][0], trees[j][2]) or _laid_over(plain[j], trees[i][0], trees[i][2]) or _reordered(pieces[i], pieces[j], offered)):
                group = [group[j] if g == group[i] else g for g in group]
    first = b["first"].groupby(group).transform("min")
    return pd.DataFrame({"root": b["root"], "form": b["form"], "class_id": first})


def twin_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, class_id, copies): the smallest key of a record's class and the records in the class.

    Records agree if their texts do but for white space, case, punctuation and the order of the labelled lines. A
    repeated row counts once; a record whose text is null, or holds no letter or digit, is a class of its own. Empty
    input gives no rows; other columns are ignored. Texts alone in their bag don't move; the distinct forms of a bag
    are compared in one task.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}\p{M}]"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = [_tree(_lower(t)) for t in b["text"]]
            both = [_digests(leaves, body) for leaves, _, body in trees]
            yield pd.DataFrame({"id": b["id"], "bag": [x[0] for x in both], "root": [x[1] for x in both], "names": [sorted(set(n)) for _, n, _ in trees]})

    def formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = [_tree(_lower(t)) for t in b["text"]]
            both = [_digests(leaves, body) for leaves, _, body in trees]
            forms = ["|".join(sorted(leaves)) + "||" + body for leaves, _, body in trees]
            yield pd.DataFrame({"id": b["id"], "bag": [x[0] for x in both], "root": [x[1] for x in both], "form": forms, "text": b["text"]})

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for bag, t in zip(b["bag"], b["text"]):
                for m in _COLON.finditer(_lower(t)):
                    ws = m[1].split()
                    out += [(bag, " ".join(ws[i:])) for i in range(len(ws))]
            yield pd.DataFrame(out, columns=["bag", "name"]).drop_duplicates()

    ids = cut(rows.mapInPandas(read, f"id {kind}, bag string, root string, names array<string>").distinct())
    shared = ids.groupBy("bag").agg(F.count_distinct("id").alias("n")).filter("n > 1").select("bag")
    wanted = spread_join(ids.select("id", "bag"), shared, ["bag"], "id").select("id").distinct()
    members = cut(spread_join(rows, wanted, ["id"], "id").mapInPandas(formed, f"id {kind}, bag string, root string, form string, text string"))
    forms = cut(members.groupBy("bag", "root", "form").agg(F.min("id").alias("first"), F.min_by("text", "id").alias("text")))
    several = cut(spread_join(forms, forms.groupBy("bag").count().filter("count > 1").select("bag"), ["bag"], "root"))
    maybe = cut(several.mapInPandas(named, "bag string, name string").distinct())
    known = spread_join(ids.select(F.explode("names").alias("name")).distinct(), maybe.select("name").distinct(), ["name"], "name")
    by_bag = spread_join(maybe, known, ["name"], "bag").groupBy("bag").agg(F.collect_set("name").alias("known"))
    compared = several.join(by_bag, "bag", "left").groupBy("bag").applyInPandas(_classes, f"root string, form string, class_id {kind}")
    alone = forms.join(several.select("bag").distinct(), "bag", "left_anti").select("root", "form", F.col("first").alias("class_id"))
    found = cut(spread_join(members.select("id", "root", "form"), compared.unionByName(alone), ["root", "form"], "id").select("id", "class_id").distinct())
    sizes = found.groupBy("class_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    own = spread_join(found, sizes, ["class_id"], "id").groupBy("id").agg(F.min(F.struct("class_id", -F.col("copies"))).alias("b")).select("id", "b.class_id", (-F.col("b.col2")).alias("copies"))
    everything = df.select(F.col(key).alias("id")).distinct()
    out = everything.join(own, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
