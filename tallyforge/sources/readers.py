"""Folders of texts, postings and uploads read into tables, and tables written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T

POSTING = "title string, company string, source_url string, date_added string, raw_text string"


def _stem(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, labels, body): text files that open with "# key: value" lines; the body in lower case."""
    files = spark.read.text(path, wholetext=True).select(_stem(F.input_file_name()).alias("name"), T.lines(F.col("value")).alias("l"))
    heads = F.filter("l", lambda x: x.rlike(r"^#\s*\w+\s*:"))
    entry = lambda x: F.struct(F.lower(F.regexp_extract(x, r"^#\s*(\w+)", 1)).alias("key"), F.regexp_extract(x, r":\s*(.*?)\s*$", 1).alias("value"))
    body = F.filter("l", lambda x: ~x.rlike(r"^#\s*\w+\s*:"))
    return files.select("name", F.map_from_entries(F.transform(heads, entry)).alias("labels"), F.lower(F.array_join(body, "\n")).alias("body"))


def json_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings, one JSON object a file, with the file's name; unreadable files give nulls."""
    return spark.read.schema(POSTING).json(path, multiLine=True).withColumn("name", _stem(F.input_file_name()))


def with_file_names(postings: DataFrame, order: str) -> DataFrame:
    """postings with `file_name`: a slug of company and title, the second and later of a slug numbered -2, -3, ..."""
    slugged = postings.withColumn("__s", T.slug(F.concat_ws(" ", "company", "title"), 60))
    n = F.row_number().over(Window.partitionBy("__s").orderBy(order))
    return slugged.withColumn("file_name", F.when(n == 1, F.col("__s")).otherwise(F.concat_ws("-", "__s", n))).drop("__s")


def checked_uploads(spark: SparkSession, path: str, most_bytes: int = 12 << 20, magic: bytes = b"%PDF") -> DataFrame:
    """Rows (name, bytes, digest, reason): files with why they'd be refused, null if they wouldn't. Spark's file sources
    pass over files without any bytes; those come from the folder's listing, names alone."""
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") > most_bytes, "too large").when(F.substring("content", 1, len(magic)) != F.lit(bytearray(magic)), "not a document")
    held = files.select(_stem(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"), reason.alias("reason"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    listed = system.listStatus(where) if system.isDirectory(where) else system.globStatus(where)
    empty = [(f.getPath().toString(),) for f in listed if f.isFile() and f.getLen() == 0]
    none = spark.createDataFrame(empty, "path string").select(_stem(F.col("path")).alias("name"), F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(""), 256).alias("digest"), F.lit("empty").alias("reason"))
    return held.unionByName(none)


def save_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append a run's rows under its id; earlier runs stay."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)
