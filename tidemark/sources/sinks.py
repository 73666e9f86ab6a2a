"""Sinks: CSV, JSON lines, one JSON document, texts, tables that grow by what is missing, and printed reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists

#: Rows that a report has at most; it is gathered by the driver.
REPORT_ROWS = 10_000
#: What a spreadsheet reads as a file in UTF-8.
BOM = "\ufeff"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); where it is unset, under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir') + '/_shared').rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV files with a header each, quotes doubled; with `bom` each begins with a byte-order mark."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _report_rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has {REPORT_ROWS} rows at most")
    return rows


def json_report(df: DataFrame) -> str:
    """A frame of at most REPORT_ROWS rows as one JSON document; letters beyond ASCII are kept."""
    return json.dumps([r.asDict(recursive=True) for r in _report_rows(df)], ensure_ascii=False, indent=1, default=str)


def write_json_document(df: DataFrame, path: str) -> None:
    """json_report as one file."""
    df.sparkSession.createDataFrame([(json_report(df),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def printed(df: DataFrame, digits: int = 3) -> str:
    """A frame of at most REPORT_ROWS rows as lines of text with right-aligned columns, numbers rounded."""
    shown = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in _report_rows(df)]
    width = [max(map(len, column)) for column in zip(df.columns, *shown)]
    return "\n".join(" ".join(c.rjust(w) for c, w in zip(row, width)) for row in [df.columns, *shown])


def write_texts(df: DataFrame, folder: str, name: str, text: str) -> None:
    """A text file for each row, in a folder by its name; readers.named_texts reads them."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(folder)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append to the table at `path` the rows of df whose keys it does not have yet, one row a key; their number.

    A job that ended early is finished by running it again: what is there is neither made nor written a second time, and
    the rows of one call come all or not at all.
    """
    fresh = df.dropDuplicates(keys)
    if exists(df.sparkSession, path):
        fresh = fresh.join(df.sparkSession.read.schema(df.schema).parquet(path).select(*keys), keys, "left_anti")
    staged = shared_folder(df.sparkSession, "staged")
    fresh.select(*df.columns).write.parquet(staged)
    new = df.sparkSession.read.schema(df.schema).parquet(staged)
    n = new.count()
    if n or not exists(df.sparkSession, path):
        new.write.mode("append").parquet(path)
    return n


def append_pages(pages: DataFrame, path: str) -> int:
    """Put fetched pages (url, html, more) into the page cache by the SHA-1 of their url; pages it has stay as they are."""
    return append_missing(pages.withColumn("key", F.sha1("url")), path, ["key"])


def joined_parts(parts: DataFrame, key: str, order: str, text: str, sep: str = "\n\n") -> DataFrame:
    """One text a key: its parts in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x"))))
    return parts.where(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["x"]), sep).alias(text))
