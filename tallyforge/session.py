"""Sessions, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its JSON form, that is ever sent to every executor.
BROADCAST_BYTES = 16 << 20


def local_session(cores: str = "8", name: str = "tallyforge", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tallyforge-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bytes_of(df: DataFrame) -> int:
    """Bytes of a (cut) table as JSON; an aggregate, nothing is collected but one number."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()
    return int(row[0] or 0)


def small_or_none(df: DataFrame, limit: int | None = None) -> DataFrame | None:
    """`broadcast(df)` if the measured size of the (cut) table is within `limit` (BROADCAST_BYTES), else None."""
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if limit is None else limit) else None


def table_or_none(df: DataFrame, key: str, value: str, limit: int = 1 << 20) -> Column | None:
    """A (cut) two-column table as one map constant if its measured size is within `limit`, else None."""
    small = cut(df.select(F.col(key).alias("k"), F.col(value).alias("v")))
    if bytes_of(small) > limit:
        return None
    shape = small.schema["v"].dataType.simpleString()
    pairs = small.select(F.to_json(F.struct("k", "v")).alias("j")).collect()
    known = F.from_json(F.lit("[" + ",".join(r["j"] for r in pairs) + "]"), f"array<struct<k:string,v:{shape}>>")
    return F.map_from_entries(known)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: str, how: str = "inner", limit: int | None = None, salts: int | None = None) -> DataFrame:
    """Equi-join where one key may hold much of `big`.

    `small` is cut and measured. Within `limit` it is broadcast, so `big` isn't shuffled at all; beyond it, each
    key is spread over `salts` tasks by a hash of `salt_on`, and `small` is repeated as often: by default as many as
    there are shuffle partitions for a key that holds more than a task's share of the rows, which are counted, and
    one for the others. `how`: inner or left, `big` being the left side; its null keys match nothing.
    """
    small = cut(small)
    sent = small_or_none(small, limit)
    if sent is not None:
        return big.join(sent, keys, how)
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts is not None:
        small = small.withColumn("__n", F.lit(salts))
        big = big.withColumn("__n", F.lit(salts))
    else:
        counted = big.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).count()
        total = counted.agg(F.sum("count")).first()[0] or 1
        hot = cut(counted.filter(F.col("count") * tasks > F.lit(int(total))).select(*keys, F.least(F.lit(tasks), F.ceil(F.col("count") * tasks / F.lit(int(total)))).cast("int").alias("__n")))  # fewer than `tasks` keys
        small = small.join(F.broadcast(hot), keys, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
        big = big.join(F.broadcast(hot), keys, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    big = big.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.col("__n")).cast("int")).drop("__n")
    small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    return big.join(small, [*keys, "__salt"], how).drop("__salt")


def once(df: DataFrame, key: str) -> DataFrame:
    """df with equal rows once. Only rows of keys that occur several times are moved, if those keys can be broadcast."""
    many = cut(df.groupBy(key).count().filter("count > 1").select(F.col(key).alias("__k")))
    if bytes_of(many) > BROADCAST_BYTES:
        return df.distinct()
    same = df[key].eqNullSafe(many["__k"])
    return df.join(F.broadcast(many), same, "left_anti").unionByName(df.join(F.broadcast(many), same, "left_semi").distinct())
