"""Weighted weekly series: means with coverage, long form, windows, events and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inference import by, in_time

#: Events that are sent to all tasks at most.
SMALL = 100_000


def weighted_means(
    charts: DataFrame, scores: DataFrame, values: Sequence[str], key: str = "uri", week: str = "week_date", weight: str = "streams",
) -> DataFrame:
    """Each week's weighted means over its scored entries, and the share of the week's weight that they hold.

    A week without scored entries has no row. A null score leaves the numerator but not the denominator.
    """
    hit = charts.join(scores.select(key, *values).withColumn("_hit", F.lit(1)), key, "left")
    w = F.when(F.col("_hit") == 1, F.col(weight))
    means = [F.try_divide(F.sum(F.col(v) * w), F.sum(w)).alias(v) for v in values]
    return hit.groupBy(week).agg(*means, F.try_divide(F.sum(w), F.sum(weight)).alias("stream_coverage"), F.count("_hit").alias("_n")).where("_n > 0").drop("_n")


def to_long(wide: DataFrame, values: Sequence[str], week: str = "week_date") -> DataFrame:
    """(series, t, week_date, value): one row a series and week; t counts the weeks of the series from 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("value")) for v in values]))
    x = wide.select(F.col(week).alias("week_date"), pairs.alias("p")).select("p.series", "week_date", "p.value")
    return x.withColumn("t", F.row_number().over(by().orderBy("week_date")) - 1).select("series", "t", "week_date", "value")


def rolling_mean(series: DataFrame, width: int, least: int, name: str = "smooth") -> DataFrame:
    """Centred rolling means; an even width looks one further back than ahead. Null with under `least` values."""
    w = in_time().rowsBetween(-(width // 2), (width - 1) // 2)
    return series.withColumn(name, F.when(F.count("value").over(w) >= least, F.avg("value").over(w)))


def peak(series: DataFrame, width: int = 3) -> DataFrame:
    """The highest standardised centred mean of each series and its week, the earliest among equals."""
    x = rolling_mean(series, width, width).withColumn("z", F.try_divide(F.col("smooth") - F.avg("value").over(by()), F.stddev_samp("value").over(by())))
    return x.where("z IS NOT NULL").groupBy("series").agg(F.max("z").alias("peak_z"), F.min_by("week_date", F.struct(-F.col("z"), "t")).alias("peak_week"))


def edge_means(series: DataFrame, edge: int = 26) -> DataFrame:
    x = series.withColumn("n", F.count("*").over(by()))
    return x.groupBy("series").agg(
        F.avg("value").alias("mean"), F.avg(F.when(F.col("t") < edge, F.col("value"))).alias("first_mean"),
        F.avg(F.when(F.col("t") >= F.col("n") - edge, F.col("value"))).alias("last_mean"),
    )


def bucket_means(series: DataFrame, edges: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """Means over half-open date buckets [edge, next edge); dates outside all buckets are left out."""
    labels = labels or [f"{a}..{b}" for a, b in zip(edges, edges[1:])]
    period = F.lit(None).cast("string")
    for lo, hi, label in zip(edges, edges[1:], labels):
        period = F.when((F.col("week_date") >= F.lit(lo).cast("date")) & (F.col("week_date") < F.lit(hi).cast("date")), label).otherwise(period)
    return series.withColumn("period", period).where("period IS NOT NULL").groupBy("series", "period").agg(F.avg("value").alias("mean"))


def monthly_means(series: DataFrame) -> DataFrame:
    """Means by month, with a null mean for months without weeks between a series' first and last."""
    month = F.trunc("week_date", "MM")
    span = series.groupBy("series").agg(F.sequence(F.min(month), F.max(month), F.expr("INTERVAL 1 MONTH")).alias("m"))
    spine = span.select("series", F.explode("m").alias("month")).withColumn("month", F.col("month").cast("date"))
    return spine.join(series.groupBy("series", month.cast("date").alias("month")).agg(F.avg("value").alias("mean")), ["series", "month"], "left")


def month_contrast(series: DataFrame, month: int = 12) -> DataFrame:
    here = F.month("week_date") == month
    return series.groupBy("series").agg((F.avg(F.when(here, F.col("value"))) - F.avg(F.when(~here, F.col("value")))).alias("difference"))


def first_weeks(series: DataFrame, events: DataFrame) -> DataFrame:
    """(series, code, t): each event's first week on or after its date; series without one have no row.

    An as-of join by union: weeks and events of a series in one order, and for each event the next week. The result has a
    row for each series and event, so events are repeated by series, whose names are few against their weeks.
    """
    names = series.select("series").distinct()
    asked = names.join(F.broadcast(events.select("code", "date")) if events.limit(SMALL + 1).count() <= SMALL else events.select("code", "date"), how="cross")
    weeks = series.select("series", F.col("week_date").alias("date"), F.col("t").alias("week"), F.lit(None).cast("string").alias("code"))
    both = weeks.unionByName(asked.select("series", F.col("date").cast("date").alias("date"), F.lit(None).cast("int").alias("week"), F.col("code").cast("string").alias("code")))
    # an event stands before the weeks of its day
    ahead = Window.partitionBy("series").orderBy("date", F.col("code").isNull()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("t", F.first("week", ignorenulls=True).over(ahead))
    return found.where(F.col("code").isNotNull() & F.col("t").isNotNull()).select("series", "code", "t")


def event_windows(series: DataFrame, events: DataFrame, k: int = 3) -> DataFrame:
    """Change of the mean of k weeks from an event against the k before, its permutation p and the level after it.

    events: code, date. An event is at its first week on or after its date; the null holds every week of the series
    with k weeks on both sides, the event's own too. Without them change and p are null; the level may use fewer weeks.
    """
    after, before = in_time().rowsBetween(0, k - 1), in_time().rowsBetween(-k, -1)
    x = series.withColumn("n", F.count("*").over(by())).withColumn("mean", F.avg("value").over(by())).withColumn("sd", F.stddev_samp("value").over(by()))
    full = (F.col("t") >= k) & (F.col("t") <= F.col("n") - k)
    x = x.withColumn("change", F.when(full, F.avg("value").over(after) - F.avg("value").over(before)))
    x = x.withColumn("level_z", F.try_divide(F.avg("value").over(after) - F.col("mean"), "sd"))
    hit = first_weeks(series, events).join(x.select("series", "t", "week_date", "change", "level_z", "sd"), ["series", "t"])
    null = x.where("change IS NOT NULL").select("series", F.abs("change").alias("size"))
    p = hit.select("series", "code", F.abs("change").alias("mine")).join(null, "series").groupBy("series", "code").agg(F.avg(F.when(F.col("size") >= F.col("mine"), 1.0).when(F.col("mine").isNotNull(), 0.0)).alias("p_perm"))
    return hit.join(p, ["series", "code"], "left").select(
        "series", "code", F.col("week_date").alias("week"), "change", F.try_divide("change", "sd").alias("change_sd"), "p_perm", "level_z",
    )


def mean_weekly_contribution(charts: DataFrame, scores: DataFrame, value: str, weeks: Sequence[str], key: str = "uri") -> DataFrame:
    """Each key's share of a week's scored weight times its value, averaged over the given weeks."""
    x = charts.where(F.col("week_date").isin([F.lit(w).cast("date") for w in weeks])).join(scores.select(key, value), key)
    share = F.col("streams") / F.sum("streams").over(Window.partitionBy("week_date"))
    return x.withColumn("_c", share * F.col(value)).groupBy(key).agg((F.sum("_c") / len(weeks)).alias("contribution"))


def drivers(charts: DataFrame, scores: DataFrame, value: str, before: Sequence[str], after: Sequence[str], top: int = 3, key: str = "uri") -> DataFrame:
    """The keys that moved a weighted mean most between two runs of weeks, with their share of the whole change."""
    a, b = mean_weekly_contribution(charts, scores, value, after, key), mean_weekly_contribution(charts, scores, value, before, key)
    d = a.withColumnRenamed("contribution", "a").join(b.withColumnRenamed("contribution", "b"), key, "full_outer").select(
        key, (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("contribution"),
    )
    total = d.agg(F.sum("contribution").alias("total"))
    best = d.orderBy(F.abs("contribution").desc(), key).limit(top)
    return best.crossJoin(total).select(key, "contribution", F.try_divide("contribution", "total").alias("share"))  # one row on the right


def event_drivers(charts: DataFrame, scores: DataFrame, hits: DataFrame, k: int = 3, top: int = 2, key: str = "uri") -> DataFrame:
    """(series, code, place, key, contribution, share): the keys that moved a series most from the k weeks before to the k
    weeks from an event, with their share of the whole change.

    scores: key, series, value. hits: series, code, t and the series' weeks (series, t, week_date) around them as `weeks`
    of (week_date, side), side -1 before and 1 from the event on. Contributions are as in `drivers`.
    """
    inside = hits.select("series", "code", F.explode("weeks").alias("w")).select("series", "code", "w.week_date", "w.side")
    entries = charts.join(inside.select("week_date").distinct(), "week_date", "left_semi").join(scores, key)
    share = F.col("streams") / F.sum("streams").over(Window.partitionBy("week_date", "series"))
    part = entries.withColumn("_c", share * F.col("value")).select("week_date", "series", key, "_c")
    d = inside.join(part, ["series", "week_date"]).groupBy("series", "code", key).agg((F.sum(F.col("side") * F.col("_c")) / k).alias("contribution"))
    of = Window.partitionBy("series", "code")
    d = d.withColumn("share", F.try_divide("contribution", F.sum("contribution").over(of))).withColumn(
        "place", F.row_number().over(of.orderBy(F.abs("contribution").desc(), key)),
    )
    return d.where(F.col("place") <= top).select("series", "code", "place", key, "contribution", "share")


def weeks_around(series: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """hits (series, code, t, more) with weeks: the k weeks before t (side -1) and the k from t on (side 1)."""
    near = series.select("series", F.col("t").alias("_t"), "week_date")
    places = hits.select(*hits.columns, F.explode(F.sequence(F.col("t") - k, F.col("t") + k - 1)).alias("_t")).join(near, ["series", "_t"])
    side = F.when(F.col("_t") < F.col("t"), -1).otherwise(1)
    return places.groupBy(*hits.columns).agg(F.collect_list(F.struct("week_date", side.alias("side"))).alias("weeks"))


def decomposition(charts: DataFrame, scores: DataFrame, value: str, early: str, late: str, key: str = "uri") -> DataFrame:
    """Each key's change of pooled weight share from before `early` to `late` on, times its value."""
    x = charts.join(scores.select(key, value), key)

    def pooled(rows: DataFrame, name: str) -> DataFrame:
        s = rows.groupBy(key, value).agg(F.sum("streams").alias("s"))
        return s.join(rows.agg(F.sum("streams").alias("all")), how="cross").select(key, value, (F.col("s") / F.col("all")).alias(name))  # one row on the right

    e, l = pooled(x.where(F.col("week_date") < F.lit(early).cast("date")), "e"), pooled(x.where(F.col("week_date") >= F.lit(late).cast("date")), "l")
    return e.join(l, [key, value], "full_outer").select(key, ((F.coalesce("l", F.lit(0.0)) - F.coalesce("e", F.lit(0.0))) * F.col(value)).alias("contribution"))


def concentration(changes: DataFrame, top: int = 5, key: str = "uri") -> DataFrame:
    """The sum of changes and the share of it that its `top` largest hold; opposite signs can bring it beyond 1."""
    best = changes.orderBy(F.abs("contribution").desc(), key).limit(top).agg(F.sum("contribution").alias("best"))
    return changes.agg(F.sum("contribution").alias("change")).crossJoin(best).select("change", F.try_divide("best", "change").alias("top_share"))


#: Rows of a sample for each range that running sums are taken in.
RANGE_SAMPLE = 32


def _ranges(rows: DataFrame, weight: str, key: str) -> Column:
    """The number of each row's range, from the largest weight down, then by key: about as many as shuffle partitions.

    The bounds are taken from a sample once and are constants of the expression, so each evaluation of a row has one range,
    whatever the sample. Rows alike in weight and key are in one range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.select(F.col(weight).alias("w"), F.col(key).alias("k")).where("w IS NOT NULL AND k IS NOT NULL")
    some = some.orderBy(F.xxhash64("w", "k")).limit(RANGE_SAMPLE * n).distinct().orderBy(F.desc("w"), "k").collect()
    bounds = [some[i * len(some) // n] for i in range(1, n)] if len(some) > n else []

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        w, k = bounds[mid]
        first = (F.col(weight) > F.lit(w)) | ((F.col(weight) == F.lit(w)) & (F.col(key).isNull() | (F.col(key) <= F.lit(k))))
        return F.when(first, branch(low, mid)).otherwise(branch(mid + 1, high))

    return branch(0, len(bounds))


def cumulative_share(rows: DataFrame, weight: str, key: str) -> DataFrame:
    """rows from the largest weight down, with their place and running share of all weight; rows alike in weight and key
    have the share of the last of them.

    The running sum is taken in ranges of weight and key first, so no task holds more than a range and one row a range.
    """
    cut = rows.withColumn("_part", _ranges(rows, weight, key))
    parts = cut.groupBy("_part").agg(F.sum(weight).alias("_s"), F.count("*").alias("_n"))
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(
        "_part", F.coalesce(F.sum("_s").over(up), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_n0"),
        F.sum("_s").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(F.col(weight).desc(), key)
    x = cut.join(F.broadcast(base), "_part")
    return x.withColumn("place", F.col("_n0") + F.row_number().over(inside)).withColumn(
        "cum_share", (F.col("_s0") + F.coalesce(F.sum(weight).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))) / F.col("_all"),
    ).select(*rows.columns, "place", "cum_share")


def status_shares(matches: DataFrame, charts: DataFrame, key: str = "uri") -> DataFrame:
    """Songs by status and their share of all charted weight; shares need not sum to one."""
    total = charts.agg(F.sum("streams").alias("all"))
    return matches.groupBy("status").agg(F.count("*").alias("n"), F.sum("total_streams").alias("s")).crossJoin(total).select(
        "status", "n", F.try_divide("s", "all").alias("stream_share"),
    )


def window_scores(windows: DataFrame, values: Sequence[str], key: str = "uri", tokens: str = "n_tokens") -> DataFrame:
    """Scores of texts from those of their windows, weighted by the windows' lengths; overlaps count in each."""
    return windows.groupBy(key).agg(F.count("*").alias("n_windows"), *[F.try_divide(F.sum(F.col(v) * F.col(tokens)), F.sum(tokens)).alias(v) for v in values])
