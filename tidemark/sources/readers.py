"""Sources with declared schemas. Optional sources are empty frames where their path is absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARTS = "week_date date, rank int, uri string, track_name string, artist_names string, streams bigint, is_hebrew boolean"
MAPPING = "original_artist string, hebrew_artist string"
OVERRIDES = "spotify_uri string, track_name string, artist_names string, action string, shironet_url string, note string, pct_streams double"
WEEKLY = "week_date date, joy double, sadness double, anger double, fear double, trust double, disgust double, anticipation double, stream_coverage double"
PAGES = "url string, html string, status int"


#: Bytes of rows that Spark hands to a Python worker at a time, where whole texts go through Python.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, whose Arrow batches from now on have ARROW_BYTES at most; one that asks for less keeps its setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")
    return spark


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def csv(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """A CSV with header; a byte-order mark is dropped and doubled quotes are one quote."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def first_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first path that exists, else an empty frame."""
    for p in paths:
        if exists(spark, p):
            return csv(spark, p, schema)
    return spark.createDataFrame([], schema)


def charts(spark: SparkSession, path: str, dates_as_text: bool = False) -> DataFrame:
    """Chart entries; with dates_as_text the dates are parsed after the scan, and unreadable ones are null."""
    if not dates_as_text:
        return csv(spark, path, CHARTS)
    return csv(spark, path, CHARTS.replace("week_date date", "week_date string")).withColumn("week_date", F.try_to_date("week_date"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of each text file of a folder, whole."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def named_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the files that sinks.write_texts wrote; the line end that it puts behind a text goes."""
    found = spark.read.schema("value string, name string").text(folder, wholetext=True)
    return found.select("name", F.regexp_replace("value", "\n$", "").alias("text"))


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def last_wins(mapping: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: the last in the given order, as a dictionary made from pairs keeps it."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return mapping.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cached_pages(wanted: DataFrame, pages: DataFrame, order: str | None = None) -> DataFrame:
    """wanted (url) with html and status: fetched pages by the SHA-1 of their url, not_cached where there is none.

    Of several pages of a url that have html the first by the column `order` counts, and the least html of those alike in it.
    """
    kept = F.struct(*([F.col(order).alias("o")] if order else []), F.col("html"))
    keyed = pages.where("html IS NOT NULL").groupBy(F.sha1("url").alias("key")).agg(F.min(kept)["html"].alias("html"))
    found = wanted.withColumn("key", F.sha1("url")).join(keyed, "key", "left")
    return found.withColumn("status", F.when(F.col("html").isNull(), "not_cached").otherwise("ok"))
