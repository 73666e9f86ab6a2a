"""The library's domain on a star schema: charts from line items, song scores from parts, events at fixed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series as S

TOP = 20
EVENTS = (("a", "1994-12-01"), ("b", "1996-03-15"), ("c", "1997-07-04"), ("d", "1998-11-11"), ("e", "1999-12-31"), ("f", "2001-06-01"))
HALF_YEARS = ("1995-01-01", "1996-01-01", "1997-01-01", "1998-07-01", "2000-01-01", "2002-01-01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six_digits(x: Column) -> Column:
    """x to six digits as SQL's round has it, by the double times a million: round() goes by the shortest decimal of a double."""
    return F.round(x * 1e6) / 1e6


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TOP parts of each shipping week by quantity: week_date, uri, streams, rank."""
    l = table(spark, sf_dir, "lineitem")
    weekly = l.groupBy(
        F.date_trunc("week", "l_shipdate").cast("date").alias("week_date"), F.col("l_partkey").alias("uri"),
    ).agg(F.sum("l_quantity").cast("bigint").alias("streams"))
    by = Window.partitionBy("week_date").orderBy(F.desc("streams"), "uri")
    return weekly.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 != 0)
    return p.select(
        F.col("p_partkey").alias("uri"), F.col("p_name").alias("track_name"), F.col("p_brand").alias("artist_names"), (F.col("p_size") / 50.0).alias("joy"),
        ((F.col("p_partkey") % 97) / 97.0).alias("fear"),
    )


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weighted_means(charts(spark, sf_dir), scores(spark, sf_dir), ["joy", "fear"])


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_long(weekly(spark, sf_dir), ["joy", "fear", "stream_coverage"])


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EVENTS), "code string, date string").withColumn("date", F.col("date").cast("date"))


CHARTS_SQL = f"""
weekly AS (
  SELECT date_trunc('week', l_shipdate)::DATE AS week_date, l_partkey AS uri, sum(l_quantity)::BIGINT AS streams FROM lineitem GROUP BY 1, 2),
charts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week_date ORDER BY streams DESC, uri) AS rank FROM weekly) WHERE rank <= {TOP}),
scores AS (
  SELECT p_partkey AS uri, p_name AS track_name, p_brand AS artist_names, p_size / 50.0::DOUBLE AS joy, (p_partkey % 97) / 97.0::DOUBLE AS fear
  FROM part WHERE p_partkey % 3 <> 0)"""

WIDE_SQL = (
    CHARTS_SQL
    + """,
wide AS (
  SELECT c.week_date, sum(s.joy * c.streams) / sum(c.streams) FILTER (WHERE s.uri IS NOT NULL) AS joy,
         sum(s.fear * c.streams) / sum(c.streams) FILTER (WHERE s.uri IS NOT NULL) AS fear,
         (sum(c.streams) FILTER (WHERE s.uri IS NOT NULL))::DOUBLE / sum(c.streams)::DOUBLE AS stream_coverage
  FROM charts c LEFT JOIN scores s USING (uri) GROUP BY 1 HAVING count(s.uri) > 0)"""
)

LONG_SQL = (
    WIDE_SQL
    + """,
pairs AS (
  SELECT 'joy' AS series, week_date, joy AS value FROM wide UNION ALL SELECT 'fear', week_date, fear FROM wide
  UNION ALL SELECT 'stream_coverage', week_date, stream_coverage FROM wide),
long AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY week_date) - 1 AS t, week_date, value FROM pairs)"""
)
