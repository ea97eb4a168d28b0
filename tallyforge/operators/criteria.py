"""Criteria answered without a judge, from what patterns can see: a chain of small questions per document.

A criterion is a dict: id, kind, and what the kind needs. Kinds about a bullet: 'alias' (some bullet holds one of its
words), 'alias_in' (the anchor's bullet does), 'number_in' (a digit in the anchor's bullet), 'named_in' (a name in the
anchor's whole role), 'unhedged_in' (the anchor's bullet is the writer's own), 'none' (no pattern can tell: no answer).
Kinds about the document: 'identity', 'outcome_per_role', 'roles_differ', 'unportable'. 'anchor' names the criterion whose
bullet is read, 'requires' one without which the answer is no. The chain is compiled to columns; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import claims as C
from tallyforge.functions import text as T

KINDS = ("alias", "alias_in", "number_in", "named_in", "unhedged_in", "none", "identity", "outcome_per_role", "roles_differ", "unportable")
#: Fixed values.
HEDGE = r"(?i)^\s*(?:helped|assisted|contributed|participated|supported|worked|involved|collaborated|aided|took part)\b"
LEVEL = r"(?i)\b(?:\d+\+?\s*(?:years?|yrs?)|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|twenty)\s+years?|junior|senior|staff|principal|lead|new grad(?:uate)?)\b"
IDENTITY = r"(?i)\b(?:ai|ml|machine learning|deep learning|software|data|research|mlops|nlp)\s+(?:engineer|scientist|developer|researcher)\b"
PORTABLE, SAME = 0.82, 0.8


def word_pattern(words: Sequence[str], patterns: Sequence[str] = ()) -> str:
    """One pattern for a criterion's words, each standing alone, and its raw patterns; Java and RE2 both read it."""
    alone = "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("\\/", "/") for w in words)
    return "(?i)(?:" + "|".join([*([rf"(?:^|[^A-Za-z0-9])(?:{alone})(?:$|[^A-Za-z0-9])"] if words else []), *patterns]) + ")"


def checked_spec(spec: dict) -> dict:
    """A spec {slug, criteria}, refused if an id is repeated, a kind unknown, or an anchor not answered before."""
    seen: list[str] = []
    for c in spec["criteria"]:
        if c["kind"] not in KINDS or c["id"] in seen or any(c.get(k) not in (None, *seen) for k in ("anchor", "requires")):
            raise ValueError(f"{spec['slug']}/{c['id']} can't be compiled")
        seen.append(c["id"])
    return spec


def read_specs(folder: str) -> list[dict]:
    """The specs of a folder of JSON files, each named after its slug."""
    specs = [(p, json.loads(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.json"))]
    for path, spec in specs:
        if spec["slug"] != path.stem:
            raise ValueError(f"{path.name} holds the slug {spec['slug']}")
    return [checked_spec(spec) for _, spec in specs]


def read_settings(path: str, mode: str | None = None, block: str = "ensemble") -> dict:
    """Settings of a TOML file; in `block`, those of a named mode lie over the block's own."""
    settings = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    own = settings.get(block, {})
    modes = {k: v for k, v in own.items() if isinstance(v, dict)}
    settings[block] = {k: v for k, v in own.items() if k not in modes} | modes.get(mode or "", {})
    return settings


def answered(docs: DataFrame, key: str, spec: dict) -> DataFrame:
    """Rows (key, criterion, met, evidence) of documents with columns text, summary and roles, an array of (heading,
    bullets): met is null where no pattern can tell. Documents without roles or bullets give no rows: their criteria have
    no subject."""
    nothing = F.lit(None).cast("struct<b:string,r:string>")
    df = docs.filter(F.exists("roles", lambda r: F.size(r["bullets"]) > 0)).withColumn("__x", F.array().cast("array<struct<criterion:string,met:boolean,evidence:string>>"))
    for c in checked_spec(spec)["criteria"]:
        anchor = F.col(f"__a{c['anchor']}") if c.get("anchor") else nothing
        met, held = _met(c, anchor)
        if c.get("requires"):
            asked = F.coalesce(F.element_at(F.filter("__x", lambda x: x["criterion"] == c["requires"]), 1)["met"], F.lit(False))
            met, held = F.when(asked, met).otherwise(F.lit(False)), F.when(asked, held)
        df = df.withColumns({"__m": met.cast("boolean"), f"__a{c['id']}": held})
        entry = F.struct(F.lit(c["id"]).alias("criterion"), F.col("__m").alias("met"), F.when(F.col("__m"), F.col(f"__a{c['id']}")["b"]).alias("evidence"))
        df = df.withColumn("__x", F.concat("__x", F.array(entry)))
    return df.select(key, F.explode("__x").alias("x")).select(key, "x.criterion", "x.met", "x.evidence")


def _met(c: dict, anchor: Column) -> tuple[Column, Column]:
    """(answer, struct of the bullet and role that settle it)."""
    nothing = F.lit(None).cast("struct<b:string,r:string>")
    pattern = word_pattern(c.get("words", ()), c.get("patterns", ()))
    match c["kind"]:
        case "none":
            return F.lit(None), nothing
        case "alias":
            hits = F.transform("roles", lambda r: F.transform(F.filter(r["bullets"], lambda b: b.rlike(pattern)), lambda b: F.struct(b.alias("b"), F.array_join(r["bullets"], " ").alias("r"))))
            first = F.get(F.flatten(hits), F.lit(0))
            return first.isNotNull(), first
        case "alias_in":
            test = anchor["b"].rlike(pattern)
        case "number_in":
            test = anchor["b"].rlike(r"\d")
        case "named_in":
            test = anchor["r"].rlike(C.SPECIFIC)
        case "unhedged_in":
            test = ~(anchor["b"].rlike(HEDGE) | anchor["b"].rlike(C.TEAM_FIRST) | anchor["b"].rlike(C.TEAM))
        case "identity":
            first = F.get("roles", F.lit(0))["heading"]
            head = F.concat_ws(" ", "summary", F.when(F.length(first) > 0, F.split_part("text", first, F.lit(1))).otherwise(F.col("text")))
            return F.coalesce(head.rlike(IDENTITY) & head.rlike(LEVEL), F.lit(False)), nothing
        case "outcome_per_role":
            return F.forall("roles", lambda r: F.exists(r["bullets"], lambda b: C.invariants(b)["outcome"])), nothing
        case "roles_differ":
            sets = F.transform("roles", lambda r: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.array_join(r["bullets"], " ")), F.lit(r"\w+"), F.lit(0)), lambda w: F.length(w) > 3)))
            again = lambda s, i: F.exists(F.slice(sets, F.lit(1), i), lambda o: (F.size(o) > 0) & (F.size(s) > 0) & (F.size(F.array_intersect(o, s)) > SAME * F.greatest(F.size(o), F.size(s))))
            return ~F.exists(F.transform(sets, again), lambda x: x), nothing
        case "unportable":
            bare = lambda b: (C.portability(b) > PORTABLE) & (F.size(T.words(b)) >= 8) & ~C.has_metric(b)
            return ~F.exists("roles", lambda r: F.exists(r["bullets"], bare)), nothing
    test = F.coalesce(test, F.lit(False))
    return test, F.when(test, anchor)
