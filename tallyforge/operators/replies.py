"""Judges' JSON replies read against a closed list of categories and criteria."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

#: Spellings of a yes and of a no; anything else is no answer. Fixed values.
YES = ("yes", "true", "y", "met")
NO = ("no", "false", "n", "unmet", "not met")

SHAPE = "map<string,struct<criteria:array<struct<id:string,answer:string,evidence:string>>>>"


def typed_answer(answer):
    """True, False, or null for an abstention; case, outer white space and full stops at the end don't matter."""
    said = F.lower(F.regexp_replace(T.stripped(answer), r"[.\s]+$", ""))
    return F.when(said.isin(*YES), True).when(said.isin(*NO), False)


def criterion_of(slug, written):
    """The criterion an id names: in capitals, without the category in front ("slug/C1")."""
    plain = F.upper(T.stripped(written))
    own = F.concat(F.upper(slug), F.lit("/"))
    return T.stripped(F.when(F.startswith(plain, own), F.substring(plain, F.length(own) + 1, F.length(plain))).otherwise(plain))


def read_replies(replies: DataFrame, keys: list[str], reply: str, slugs: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """Rows (keys, slug, criterion, met, evidence): the valid answers of each reply, the first of each criterion.

    Dropped: replies without readable JSON, unknown slugs and criteria, abstentions. White space around the JSON, slugs'
    case and outer blanks don't matter. All of it happens within the reply's row, so nothing is shuffled; equal rows
    give equal answers, so keep them once before."""
    entries = F.map_entries(F.from_json(T.salvaged_json(F.col(reply)), SHAPE))

    def answers(e):
        slug = F.lower(T.stripped(e["key"]))
        return F.transform(F.coalesce(e["value"]["criteria"], F.array().cast("array<struct<id:string,answer:string,evidence:string>>")), lambda q: F.struct(slug.alias("slug"), criterion_of(slug, q["id"]).alias("criterion"), typed_answer(q["answer"]).alias("met"), q["evidence"].alias("evidence")))

    valid = F.filter(F.flatten(F.transform(entries, answers)), lambda x: x["slug"].isin(*slugs) & x["criterion"].isin(*criteria) & x["met"].isNotNull())
    held = replies.select(*keys, valid.alias("__v")).withColumn("__n", F.transform("__v", lambda x: F.concat_ws("/", x["slug"], x["criterion"])))
    first = F.filter("__v", lambda x, i: F.array_position("__n", F.concat_ws("/", x["slug"], x["criterion"])) == i + 1)
    return held.select(*keys, F.explode(first).alias("a")).select(*keys, "a.slug", "a.criterion", "a.met", "a.evidence")
