"""Free-entered values mapped to a reference list.

A value and the reference strings are brought to one plain form (case, marks, abbreviations, level words, word order),
then matched by a partition-based pigeonhole join: a reference string of k allowed edits is cut into k + 1 segments, of
which a value within k edits holds at least one unchanged, shifted by k characters at most. So substrings of the values
at these places are joined to the segments by equality, verified with the built-in levenshtein, and values without a
match come from an anti-join. All of it is SQL on distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut, spread_join

class Spellings(NamedTuple):
    """What is known of how titles are written: spellings of level words (the reference list's own first), abbreviations,
    abbreviations that may be glued to the end of another word, and what is said of the post rather than the occupation.
    All of it is an argument; the standard set holds common ones. Words that only lack their vowels need no entry."""

    levels: Mapping[str, Sequence[str]]
    short: Mapping[str, str]
    glued: Mapping[str, str]
    remarks: Sequence[str]


STANDARD = Spellings(
    levels={"senior": ("senior", "snr", "sr", "sen"), "junior": ("junior", "jnr", "jr", "jun"), "lead": ("lead", "ld"), "staff": ("staff", "stf"), "principal": ("principal", "princ", "prin", "prncpl")},
    short={
        "eng": "engineer", "engr": "engineer", "engg": "engineer", "mgr": "manager", "dev": "developer", "devs": "developer", "sci": "scientist", "scient": "scientist", "arch": "architect", "archt": "architect",
        "admin": "administrator", "spec": "specialist", "mach": "machine", "tech": "technical", "soln": "solutions", "solns": "solutions", "res": "research", "db": "database", "ml": "machine learning", "sw": "software",
        "prog": "program", "prod": "product", "ops": "operations", "sec": "security",
    },
    glued={"engr": "engineer", "eng": "engineer", "mgr": "manager", "dev": "developer", "admin": "administrator", "archt": "architect", "arch": "architect", "scient": "scientist", "sci": "scientist", "spec": "specialist"},
    remarks=("remote", "hybrid", "on-site", "onsite", "on site", "part time", "part-time", "full time", "full-time", "contract", "contractor", "temp", "temporary", "fixed term", "fixed-term", "maternity cover", "freelance", "interim", "permanent"),
)


def _plain(text, spell: Spellings):
    """Lower case, one kind of blank, no marks around it, remarks about the post dropped."""
    x = F.lower(F.regexp_replace(text, r"[\s\x{a0}\x{2000}-\x{200a}]+", " "))
    x = F.regexp_replace(F.regexp_replace(x, r"[\"“”'’*_`]+", ""), r"\bs/w\b", "sw")
    x = F.regexp_replace(x, r"^[\s\-–—.,]+|[\s\-–—.,]+$", "")
    remark = "|".join(spell.remarks)
    x = F.regexp_replace(x, rf"\s*[(\[]\s*(?:{remark})\s*[)\]]", " ")
    x = F.regexp_replace(x, rf"\s*(?:[-–—/|,]\s*)(?:{remark})\s*$", " ")
    return F.regexp_replace(x, r"^[\s\-–—.,]+|[\s\-–—.,]+$", "")


def _level_at(x, where: str, spell: Spellings):
    """The level named at the start ('^') or the end ('$') of x, or glued to its start ('+'); null if none."""
    out = None
    for level, spellings in spell.levels.items():
        alt = "|".join(spellings)
        hit = F.regexp_like(x, F.lit({"^": rf"^(?:{alt})(?:[^a-z]|$)", "$": rf"(?:^|[^a-z])(?:{alt})\.?\)?$", "+": rf"^(?:{alt})[a-z]{{3,}}"}[where]))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def without_vowels(words: DataFrame, column: str) -> DataFrame:
    """Rows (word, long): the consonants of a reference word (its first letter included) and the word, where only one
    word has them."""
    x = words.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}{5,}"), F.lit(0)))).alias("w")).distinct()
    bare = x.select("w", F.regexp_replace("w", r"(?<=.)[aeiou]", "").alias("k")).filter("k <> w AND length(k) >= 3")
    return bare.groupBy(F.col("k").alias("word")).agg(F.min("w").alias("long"), F.max("w").alias("z")).filter("long = z").drop("z")


def plain_titles(values: DataFrame, column: str, spell: Spellings = STANDARD, consonants: DataFrame | None = None) -> DataFrame:
    """Rows (value, form, less): the plain forms a distinct value may have: the level word in front, the rest without blanks,
    abbreviations and words of `consonants` (word, long) written out; as written and with what follows the first comma put in front ("engineer, data"); with
    and without what follows the last comma (a place); with a level or abbreviation glued to the rest cut off."""
    any_level = "|".join(s for spellings in spell.levels.values() for s in spellings)
    x = values.select(F.col(column).alias("value")).filter(F.col("value").rlike(r"[\p{L}\p{N}]")).distinct().withColumn("x", _plain("value", spell))
    shorter = F.when(F.col("x").contains(",") & _level_at(F.col("x"), "$", spell).isNull(), F.struct(F.regexp_replace("x", r"\s*,[^,]*$", "").alias("x"), F.lit(1).alias("less")))
    x = x.select("value", F.explode(F.array_compact(F.array(F.struct("x", F.lit(0).alias("less")), shorter))).alias("v")).select("value", "v.x", "v.less")
    lead_in, tail = _level_at(F.col("x"), "^", spell), _level_at(F.col("x"), "$", spell)
    x = x.withColumn("level", F.coalesce(lead_in, tail, F.lit("")))
    rest = F.when(lead_in.isNotNull(), F.regexp_replace("x", rf"^(?:{any_level})(?=[^a-z]|$)[.\s,\-–—]*", "")).when(tail.isNotNull(), F.regexp_replace("x", rf"[\s,\-–—(/|]*(?<![a-z])(?:{any_level})\.?\)?$", "")).otherwise(F.col("x"))
    x = x.withColumn("rest", F.regexp_replace(rest, r"^[\s\-–—.,(]+|[\s\-–—.,(]+$", ""))
    parts = F.split("rest", r"\s*,[\s\-–—]*")
    turned = F.concat_ws(" ", F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)))
    forms = x.select("value", "level", "less", F.explode(F.array_distinct(F.array(F.array_join(parts, " "), turned))).alias("form"))
    words = F.filter(F.split("form", r"[^\p{L}\p{N}+#]+"), lambda w: w != "")
    short = F.create_map(*(F.lit(a) for pair in spell.short.items() for a in pair))
    less = F.when((F.col("less") == 1) & (F.size(words) < 2), 2).otherwise(F.col("less")).alias("less")
    forms = forms.select("value", "level", less, "form", F.posexplode_outer(words).alias("at", "word"))
    forms = spread_join(forms, consonants, ["word"], "value", "left") if consonants is not None else forms.withColumn("long", F.lit(None).cast("string"))
    word = F.struct("at", F.coalesce(F.try_element_at(short, "word"), "long", "word").alias("full"), "word")
    forms = forms.groupBy("value", "level", "less", "form").agg(F.array_sort(F.collect_list(word)).alias("words"))
    forms = forms.select("value", "level", "less", F.explode(F.array_distinct(F.array(F.array_join("words.full", ""), F.array_join("words.word", "")))).alias("rest"))
    stuck = F.when(F.col("level") == "", _level_at(F.col("rest"), "+", spell))
    cut_off = F.when(stuck.isNotNull(), F.concat(stuck, F.regexp_replace("rest", rf"^(?:{any_level})", "")))
    whole = F.array_compact(F.array(F.concat("level", "rest"), cut_off))

    def written_out(form):
        for end, long in spell.glued.items():
            form = F.regexp_replace(form, rf"(?<=[a-z]{{2}}){end}$", long)
        return form

    out = forms.select("value", "less", F.explode(F.array_union(whole, F.transform(whole, written_out))).alias("form")).filter("form <> ''")
    return out.groupBy("value", "form").agg(F.min("less").alias("less"))


def reference_forms(ref: DataFrame, key: str, title: str, family: str, aliases: str, spell: Spellings = STANDARD) -> DataFrame:
    """Rows (ref_id, form): the plain form of each title, and of each alias of its family with the title's level. The
    aliases of a family stand at one of its titles and hold for all; titles of the same form count once, smallest id."""
    rows = ref.select(F.col(key).alias("ref_id"), F.col(title).alias("title"), F.col(family).alias("family"), F.col(aliases).alias("aliases")).filter(F.col("title").isNotNull()).distinct()
    named = rows.select("family", F.explode("aliases").alias("name")).union(rows.select("family", F.col("family").alias("name"))).filter("name IS NOT NULL").distinct()
    level = F.coalesce(_level_at(_plain(F.col("title"), spell), "^", spell), F.lit(""))
    squeeze = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}+#]+", "")
    own = rows.select("ref_id", squeeze("title").alias("form"), F.length(level).alias("lead"))
    shared = rows.withColumn("level", level).join(named, "family").select("ref_id", F.concat("level", squeeze("name")).alias("form"), F.length("level").alias("lead"))
    return own.union(shared).filter("form <> ''").groupBy("form").agg(F.min("ref_id").alias("ref_id"), F.max("lead").alias("lead"))


def allowed_edits(length):
    """Edits by the length of a reference string without its level: none for abbreviations of up to 5 characters, 1 up
    to 9, 2 up to 13, 3 up to 22, else 4. Two neighbours swapped are two edits."""
    return F.when(length <= 5, 0).when(length <= 9, 1).when(length <= 13, 2).when(length <= 22, 3).otherwise(4)


def pigeonhole_matches(forms: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows (value, ref_id, less, distance): every (value, form) within the edits its reference string allows."""
    k = F.col("k")
    cutup = refs.withColumn("base", F.length("form") - F.col("lead")).withColumn("k", allowed_edits(F.col("base"))).withColumn("len", F.length("form"))
    cutup = cutup.select("ref_id", F.col("form").alias("ref"), "base", "k", "len", F.explode(F.sequence(F.lit(0), k)).alias("s"))
    first = F.floor(F.col("s") * F.col("len") / (k + 1)).cast("int")
    after = F.floor((F.col("s") + 1) * F.col("len") / (k + 1)).cast("int")
    segments = cutup.withColumns({"at": first, "seg": F.col("ref").substr(first + 1, after - first)})
    # What a value of a length must be asked for: all (length, segment) shapes of the list.
    shapes = segments.select("len", "k", "s", "at", F.length("seg").alias("size")).distinct()
    plan = shapes.select("len", "s", "size", "k", F.explode(F.sequence(F.col("at") - F.col("k"), F.col("at") + F.col("k"))).alias("from"))
    plan = plan.filter("from >= 0").select("len", "s", "size", "from", F.explode(F.sequence(F.greatest(F.col("len") - F.col("k"), F.lit(1)), F.col("len") + F.col("k"))).alias("n"))
    plan = plan.filter(F.col("from") + F.col("size") <= F.col("n")).groupBy("n").agg(F.collect_set(F.struct("len", "s", "size", "from")).alias("asks"))
    tasks = max(forms.sparkSession.sparkContext.defaultParallelism, int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    forms = forms.withColumn("n", F.length("form")).repartition(tasks, "value")  # small now, a hundred times larger below
    asked = spread_join(forms, plan, ["n"], "value").select("value", "form", "less", F.explode("asks").alias("a"))
    probes = asked.select("value", "form", "less", F.col("a.len").alias("len"), F.col("a.s").alias("s"), F.col("form").substr(F.col("a.from") + 1, F.col("a.size")).alias("seg"))
    pairs = spread_join(probes, segments.select("ref_id", "ref", "base", "k", "len", "s", "seg"), ["len", "s", "seg"], "value").select("value", "form", "less", "ref_id", "ref", "base", "k").distinct()
    near = pairs.withColumn("distance", F.levenshtein("form", "ref", 4)).filter((F.col("distance") >= 0) & (F.col("distance") <= F.col("k")))
    letters = lambda x: F.array_sort(F.split(x, ""))
    near = near.filter((F.col("distance") < 4) | (F.col("base") > 22) | (letters("form") == letters("ref"))).filter("less < 2 OR distance = 0")
    return near.groupBy("value", "ref_id").agg(F.min(F.struct("less", "distance")).alias("b")).select("value", "ref_id", "b.less", "b.distance")


def map_to_reference(df: DataFrame, keys: list[str], value: str, ref: DataFrame, ref_key: str, ref_title: str, ref_family: str, ref_aliases: str, spell: Spellings = STANDARD) -> DataFrame:
    """Rows (keys, ref_key, distance): each row's value with the reference entry it means, -1 and null if none.

    The closest entry to the whole value wins, else to the value without its last part; ties go to the smallest key. Null, empty and blank values are left out; values without
    letters or digits mean no entry; repeated rows count once, as do repeated keys with the same value. An empty list
    leaves all unmatched. Other columns are ignored. Only distinct values are matched, the result is joined back.
    """
    rows = df.select(*keys, F.col(value).alias("value")).filter(F.col("value").rlike(r"[^\s\x{a0}]")).distinct()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = cut(rows.select("value").distinct().repartition(tasks, "value"))  # few bytes, much work
    matches = pigeonhole_matches(plain_titles(distinct, "value", spell, without_vowels(ref, ref_title)), reference_forms(ref, ref_key, ref_title, ref_family, ref_aliases, spell))
    best = cut(matches.groupBy("value").agg(F.min(F.struct("less", "distance", "ref_id")).alias("b")).select("value", F.col("b.ref_id").alias("ref_id"), F.col("b.distance").alias("distance")))
    unmatched = distinct.join(best.select("value"), "value", "left_anti").select("value", F.lit(-1).cast("long").alias("ref_id"), F.lit(None).cast("int").alias("distance"))
    mapped = best.unionByName(unmatched)
    return spread_join(rows, mapped, ["value"], keys[0]).select(*keys, F.col("ref_id").alias(ref_key), "distance")
