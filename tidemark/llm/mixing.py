"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rank bins of a source, at least, and rows of all sources that a bin is meant for: the running sum of words is found over
#: bins first, then within each bin, so bins grow with the rows.
BINS, BIN_ROWS = 1024, 20_000
#: Sources whose targets are broadcast at most (about 60 bytes each).
BROADCAST_SOURCES = 500_000


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sources (source, source_size, more) with target: shares of all sizes by weight, none above cap x source_size.

    Sources are ordered by code point, null last, and take the weights in turn. The excess of capped sources is
    reshared by weight until none is above: with sources in ascending order of cap x size / weight the capped ones
    are a prefix, so running sums find the final level. One row per source passes through one task.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("_rn") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy("_ratio", "_rn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = (
        sources.withColumn("_rn", rank)
        .withColumn("_w", w.cast("long"))
        .withColumn("_ratio", cap * F.col("source_size") / F.col("_w"))
        .withColumn("_full", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_full")) / F.col("_rest"))
        .withColumn("_at", F.row_number().over(order))
    )
    free = F.col("_level") * F.col("_w") <= cap * F.col("source_size")
    level = F.min(F.when(free, F.struct("_at", "_level"))).over(everything)["_level"]
    return (
        x.withColumn("_final", level)
        .withColumn("target", F.least(F.coalesce(F.col("_final") * F.col("_w"), F.lit(float("inf"))), (cap * F.col("source_size")).cast("double")))
        .select(*sources.columns, "target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 1,
    importance: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and text_hash (XXH64 of the text, null as empty) of each row.

    A source's target over its size is its rate: the whole part of the rate is given to every row as certain copies;
    the rest is sampled without replacement. A row's inclusion probability there is proportional to `importance` (an
    integer column over `size`; the default 1 + floor(sqrt(size)) slightly prefers longer texts), at most 1; what the cap
    at 1 takes away is not spread over the other rows, whose ranks it would not change in order. Rows are ranked by
    u/(1-u) over p/(1-p) with u from a hash of seed and doc_id, and taken in rank order until the source's residual words
    are filled as nearly as whole rows allow: the size that is fixed is the words, not the number of rows. No row gets
    more than `cap` copies.

    Nulls: a null text has size 0, a null source is a source of its own, the last; null doc_ids share one u. Rows with
    equal doc_id share u and are ordered by size and hash of the text. An empty table gives none. Other columns are
    ignored. The text is read once; the narrow rows are written to the shared folder. A hot source is spread over rank
    bins; sources, a row each, pass through one task.
    """
    importance = F.floor(F.sqrt("size")) + 1 if importance is None else importance
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    base = written(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            u.alias("u"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        ),
        "mix-base",
    )
    bins_ = max(BINS, base.count() // BIN_ROWS)
    base = base.withColumn("w", importance.cast("long")).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sums = base.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("_mass"))
    targets = source_targets(sums, weights, cap)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = (
        targets.withColumn("_whole", F.floor(rate).cast("long"))
        .withColumn("_part", rate - F.col("_whole"))
        .withColumn("_residual", F.col("target") - F.col("_whole") * F.col("source_size"))
        .drop("source")
    )
    # a row a source: broadcast after a count, or the rows would be dealt by source; beyond it Spark splits hot sources
    plan = written(plan, "mix-plan")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    p = F.col("_part") * F.col("w") * F.col("source_size") / F.col("_mass")
    odds = F.col("u") / (1 - F.col("u"))
    sampled = F.col("_part") > 0
    ranked = (
        base.join(plan, "key")
        .withColumn("_p", F.when(sampled & (F.col("_mass") > 0), F.least(p, F.lit(1.0))))
        .withColumn("_rank", F.when(F.col("_p") < 1, odds / (F.col("_p") / (1 - F.col("_p")))))
        # certain rows (p = 1) come first; they and unsampled rows are spread over bins of their own
        .withColumn(
            "_bin",
            F.when(F.col("_p") >= 1, -1 - F.floor(F.col("u") * bins_))
            .when(F.col("_rank").isNotNull(), F.floor(F.col("_rank") / (1 + F.col("_rank")) * bins_))
            .otherwise(F.floor(F.col("u") * bins_)),
        )
    )
    in_bin = Window.partitionBy("key", "_bin").orderBy("_rank", "u", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that the running sum of a source reads one row a bin
    bins = written(ranked.groupBy("key", "_bin").agg(F.sum("size").alias("_words")), "mix-bins")
    below = bins.withColumn(
        "_below", F.coalesce(F.sum("_words").over(Window.partitionBy("key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_words")
    extra = F.when((F.col("_p") >= 1) | (F.col("_p").isNotNull() & (F.col("_below") + F.col("_in") + F.col("size") / 2 <= F.col("_residual"))), 1).otherwise(0)
    return (
        ranked.withColumn("_in", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
        .join(below, ["key", "_bin"])
        .withColumn("copies", F.least(F.col("_whole") + extra, F.lit(cap)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
    )


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 and a cap of 3.

    Null and empty texts have size 0 and are taken as 0 words; a null source comes last; null and repeated doc_ids share
    their random number and have a row each; other columns of documents are ignored; an empty table gives none.
    """
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
weighed AS (SELECT *, (floor(sqrt(size)) + 1)::BIGINT AS w FROM base),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * w)::BIGINT AS mass FROM weighed GROUP BY source),
ranked_sources AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS sw,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM sums),
levels AS (
  SELECT *, row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / sw, rn) AS pos,
         ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / sw, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / ((sum(sw) OVER ())::BIGINT - coalesce(sum(sw) OVER (ORDER BY (3 * source_size)::DOUBLE / sw, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE AS lvl
  FROM ranked_sources),
final AS (SELECT min_by(lvl, pos) AS lvl FROM levels WHERE lvl * sw <= 3 * source_size),
targets AS (
  SELECT l.source, l.source_size, l.mass, least(f.lvl * l.sw, (3 * l.source_size)::DOUBLE) AS target FROM levels l, final f),
rates AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole,
         CASE WHEN source_size = 0 THEN 0 ELSE target / source_size - floor(target / source_size) END AS part FROM targets),
probable AS (
  SELECT d.doc_id, d.size, d.u, d.w, r.source, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS residual,
         CASE WHEN r.part > 0 AND r.mass > 0 THEN least(r.part * d.w * r.source_size / r.mass, 1.0::DOUBLE) END AS p
  FROM weighed d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
ordered AS (SELECT *, CASE WHEN p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS rnk FROM probable),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p >= 1 THEN 0 ELSE 1 END, rnk, u, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM ordered)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN p >= 1 OR (p IS NOT NULL AND below + size / 2.0::DOUBLE <= residual) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
