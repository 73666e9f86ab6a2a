"""Queries that write a table through a sink and read it back through a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources import readers, sinks

from .analogues import CHARTS_SQL, charts, table

#: Where a quoted comma, quotes and a line break go through a CSV file.
NAME = 'the "best", of\n'


def _charts_file(spark: SparkSession, d: str) -> str:
    names = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), "p_name", F.col("p_brand").alias("artist_names"))
    title = F.concat(F.lit(NAME), "p_name", F.when(F.col("uri") % 4 == 0, " שיר").otherwise(""))
    rows = charts(spark, d).join(names, "uri").withColumn("track_name", title)
    rows = rows.select(
        "week_date", "rank", F.concat(F.lit("spotify:track:"), "uri").alias("uri"), "track_name", "artist_names", "streams",
        X.has_hebrew(F.col("track_name")).alias("is_hebrew"),
    )
    path = sinks.shared_folder(spark, "charts")
    sinks.write_csv(rows, path, bom=True)
    return path


def csv_charts(spark: SparkSession, d: str) -> DataFrame:
    """Chart entries with names through a CSV file with a byte-order mark, quotes, commas and line breaks."""
    return readers.charts(spark, _charts_file(spark, d)).select("week_date", "rank", "uri", "track_name", "artist_names", "streams", "is_hebrew")


def csv_text_dates(spark: SparkSession, d: str) -> DataFrame:
    """The same file with dates read as texts: the entries with a Hebrew title by week."""
    got = readers.charts(spark, _charts_file(spark, d), dates_as_text=True).where("is_hebrew")
    return got.groupBy("week_date").agg(F.count("*").alias("n"), F.sum("streams").alias("streams"))


def csv_index_column(spark: SparkSession, d: str) -> DataFrame:
    """A result table whose first column is its index, through a plain CSV file."""
    path = sinks.shared_folder(spark, "result")
    sinks.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


def csv_optional(spark: SparkSession, d: str) -> DataFrame:
    """Sources that may be absent: the second of two paths is read, and an optional file that is not there has no rows."""
    path, absent = sinks.shared_folder(spark, "overrides"), sinks.shared_folder(spark, "absent")
    n = table(spark, d, "nation")
    action = F.when(F.col("n_nationkey") % 3 == 0, "none").otherwise("url")
    rows = n.select(
        F.col("n_nationkey").cast("string").alias("spotify_uri"), F.col("n_name").alias("track_name"), F.lit(None).cast("string").alias("artist_names"),
        action.alias("action"),
    )
    rows = rows.withColumns({"shironet_url": F.lit(None).cast("string"), "note": F.lit('said "no"'), "pct_streams": F.lit(0.5)})
    sinks.write_csv(rows, path)
    found = readers.first_csv(spark, [absent, path], readers.OVERRIDES).select("action", "note", "pct_streams")
    old = readers.csv(spark, absent, readers.WEEKLY, optional=True).select(
        F.lit("old").alias("action"), F.lit("").alias("note"), F.col("joy").alias("pct_streams"),
    )
    return found.union(old).groupBy("action", "note").agg(F.count("*").alias("n"), F.sum("pct_streams").alias("pct"))


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each nation, read back by its name."""
    folder = sinks.shared_folder(spark, "texts")
    rows = table(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("name"), F.concat("n_name", F.lit("\n\nמילים\n"), "n_regionkey").alias("text"),
    )
    sinks.write_texts(rows, folder, "name", "text")
    return readers.named_texts(spark, folder).select("name", F.md5("text").alias("md5"), F.length("text").alias("chars"))


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log of each customer's orders as nested JSON lines, read back and opened."""
    path = sinks.shared_folder(spark, "log")
    logged = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("orders"))
    sinks.write_json_lines(logged, path)
    got = spark.read.schema(logged.schema).json(path)
    return got.select("o_custkey", F.posexplode("orders").alias("pos", "o")).select("o_custkey", "pos", "o.o_orderkey", "o.o_orderpriority")


def json_document(spark: SparkSession, d: str) -> DataFrame:
    """Nations by region as one JSON document, letters beyond ASCII kept."""
    path = sinks.shared_folder(spark, "document")
    n, r = table(spark, d, "nation"), table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    rows = n.join(r, "n_regionkey").groupBy("n_regionkey", "r_name").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat("n_name", F.lit(" ארץ")))).alias("nations"),
    )
    sinks.write_json_document(rows, path)
    got = readers.json_document(spark, path, "n_regionkey int, r_name string, n bigint, nations array<string>")
    return got.select("n_regionkey", "r_name", "n", F.array_join("nations", ",").alias("nations"))


def page_cache_append(spark: SparkSession, d: str) -> DataFrame:
    """A page cache filled in two runs, the second of which stopped early and was run again: each url once."""
    path, p = sinks.shared_folder(spark, "pages"), table(spark, d, "pages").select("url", "html")
    sinks.append_pages(p.where("length(url) % 3 <> 0"), path)
    sinks.append_pages(p, path)
    sinks.append_pages(p, path)
    return spark.read.parquet(path).select("key", "url", (F.length("html") > 0).cast("int").alias("filled"))


ORACLES = {
    "csv_charts": f"""WITH {CHARTS_SQL}
SELECT week_date, rank::INT AS rank, 'spotify:track:' || c.uri AS uri, 'the "best", of' || chr(10) || p_name || CASE WHEN c.uri % 4 = 0 THEN ' שיר' ELSE '' END AS track_name,
  p_brand AS artist_names, streams, c.uri % 4 = 0 AS is_hebrew FROM charts c JOIN part ON p_partkey = c.uri""",
    "csv_text_dates": f"WITH {CHARTS_SQL} SELECT week_date, count(*) AS n, sum(streams)::BIGINT AS streams FROM charts WHERE uri % 4 = 0 GROUP BY 1",
    "csv_index_column": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "csv_optional": "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'none' ELSE 'url' END AS action, 'said \"no\"' AS note, count(*) AS n, count(*) * 0.5::DOUBLE AS pct FROM nation GROUP BY 1",
    "text_files": "WITH t AS (SELECT 'n' || n_nationkey AS name, n_name || chr(10) || chr(10) || 'מילים' || chr(10) || n_regionkey AS text FROM nation) SELECT name, md5(text) AS md5, length(text)::INT AS chars FROM t",
    "json_lines": "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderpriority) - 1)::INT AS pos, o_orderkey, o_orderpriority FROM orders",
    "json_document": "SELECT n_regionkey, r_name, count(*) AS n, string_agg(n_name || ' ארץ', ',' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
    "page_cache_append": "SELECT sha1(url) AS key, url, max((length(html) > 0)::INT) AS filled FROM pages GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (csv_charts, csv_text_dates, csv_index_column, csv_optional, text_files, json_lines, json_document, page_cache_append)}
