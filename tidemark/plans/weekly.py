"""Queries over the weekly series: aggregation, windows, events, attribution and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import text as X
from tidemark.operators import inference as I
from tidemark.operators import lexicon as L
from tidemark.operators import matching as M
from tidemark.operators import series as S
from tidemark.sources import readers

from .analogues import CHARTS_SQL, EVENTS, HALF_YEARS, LONG_SQL, WIDE_SQL, charts, events, long, scores, table, weekly

BEFORE = ("1997-06-16", "1997-06-23", "1997-06-30")
AFTER = ("1997-07-07", "1997-07-14", "1997-07-21")
EARLY, LATE = "1996-01-01", "2001-01-01"
PEAK_FROM, PEAK_TO = "1997-01-01", "1998-01-01"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names or [c for c, t in df.dtypes if t == "double"]})


def R(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


#: Words of part names that stand for themes.
THEMED = {"tool": ("gear", "bolt", "gizmo"), "look": ("red", "blue", "hot")}


def song_themes(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("text"))
    return L.code_themes(names, {k: (w, 1) for k, w in THEMED.items()}, joined="", letters=r"\p{L}").select("uri", *THEMED)


def weekly_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weekly(spark, d), digits=9)


def weekly_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = weekly(spark, d).select("stream_coverage")
    return rounded(w.agg(F.count("*").alias("weeks"), F.avg("stream_coverage").alias("coverage_mean"), F.min("stream_coverage").alias("coverage_min"), F.max("stream_coverage").alias("coverage_max")))


def weekly_topk(spark: SparkSession, d: str) -> DataFrame:
    return charts(spark, d).where("rank <= 5").select("week_date", "rank", "uri", "streams")


def named_charts(spark: SparkSession, d: str) -> DataFrame:
    """Charts with titles and credited artists; some titles are Hebrew."""
    p = table(spark, d, "part")
    artist = lambda k: F.concat("p_brand", F.lit("-"), (F.col("p_size") + k).cast("string"))
    title = F.concat("p_name", F.when(F.col("p_partkey") % 41 == 0, " שיר").otherwise(""))
    names = p.select(F.col("p_partkey").alias("uri"), title.alias("track_name"), F.concat(artist(0), F.lit(", "), artist(1)).alias("artist_names"))
    return charts(spark, d).join(names, "uri")


def song_universe(spark: SparkSession, d: str) -> DataFrame:
    """Songs in scope: a Hebrew title, or an artist with a Hebrew-titled song or a mapped name."""
    mapping = spark.createDataFrame([("Brand#3-7", "מותג"), ("Brand#9-20", "אחר")], "original_artist string, hebrew_artist string")
    return M.song_universe(named_charts(spark, d), mapping)


def song_totals(spark: SparkSession, d: str) -> DataFrame:
    c = charts(spark, d)
    return c.groupBy("uri").agg(
        F.sum("streams").alias("total_streams"), F.min("rank").alias("peak_rank"), F.min("week_date").alias("first_week"),
        F.min_by("rank", F.struct("week_date", "rank")).alias("first_rank"), F.countDistinct("week_date").alias("n_weeks"),
    )


def dedup_scores_join(spark: SparkSession, d: str) -> DataFrame:
    """Charts against scores of which a song has several rows under another key's name: the first row counts."""
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("spotify_uri"), "l_orderkey", "l_linenumber", F.col("l_discount").alias("joy"))
    one = readers.first_wins(l, ["spotify_uri"], F.col("l_orderkey"), F.col("l_linenumber")).select(F.col("spotify_uri").alias("uri"), "joy")
    return rounded(S.weighted_means(charts(spark, d), one, ["joy"]))


def full_outer_scores(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).select("uri", "joy")
    t = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("uri"), (F.col("p_size") > 25).cast("int").alias("flag"))
    return rounded(s.join(t, "uri", "full_outer"), "joy")


def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A series against the one of half the songs: correlation and both rank trends, joined on the week."""
    c, s = charts(spark, d), scores(spark, d)
    old = S.to_long(S.weighted_means(c, s.where("uri % 2 = 0"), ["joy"]), ["joy"]).withColumn("series", F.lit("old"))
    new = S.to_long(S.weighted_means(c, s, ["joy"]), ["joy"])
    both = old.select("week_date", F.col("value").alias("old")).join(new.select("week_date", F.col("value").alias("new")), "week_date")
    r = both.agg(I.safe_corr("old", "new").alias("r"))
    rho = I.spearman_trend(old.unionByName(new)).groupBy().agg(
        F.max(F.when(F.col("series") == "old", F.col("rho"))).alias("rho_old"), F.max(F.when(F.col("series") == "joy", F.col("rho"))).alias("rho_new"),
    )
    return rounded(r.crossJoin(rho))  # one row on either side


def anti_join_impact(spark: SparkSession, d: str) -> DataFrame:
    """Weekly means with and without a list of suspect songs."""
    c, s = charts(spark, d), scores(spark, d)
    suspects = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("uri"))
    a = S.weighted_means(c, s, ["joy"]).select("week_date", F.col("joy").alias("all_songs"))
    b = S.weighted_means(c, s.join(suspects, "uri", "left_anti"), ["joy"]).select("week_date", F.col("joy").alias("cleared"))
    x = a.join(b, "week_date")
    change = x.agg(
        F.count("*").alias("weeks"), I.safe_corr("all_songs", "cleared").alias("r"), F.avg(F.abs(F.col("all_songs") - F.col("cleared"))).alias("mean_change"),
    )
    rho = I.spearman_trend(S.to_long(x, ["all_songs", "cleared"]))
    both = rho.agg(*(F.max(F.when(F.col("series") == c, F.col("rho"))).alias(f"rho_{c}") for c in ("all_songs", "cleared")))
    return rounded(change.crossJoin(both))  # one row on either side


def semi_join_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of a bucket's streams that belongs to a set of songs."""
    ours = table(spark, d, "part").where("p_brand LIKE 'Brand#1%'").select(F.col("p_partkey").alias("uri")).withColumn("hit", F.lit(1))
    w = charts(spark, d).join(ours, "uri", "left").groupBy("week_date").agg((F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("streams"))), F.lit(0)) / F.sum("streams")).alias("share"))
    return rounded(S.bucket_means(S.to_long(w, ["share"]), HALF_YEARS))


def status_share(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_streams"))
    return rounded(S.status_shares(o, table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("streams"))))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority")


def saturation(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    above, below = (lambda c: F.avg(F.when(F.col(c) > 0.9, 1.0).otherwise(0.0)).alias(f"{c}_gt90")), (lambda c: F.avg(F.when(F.col(c) < 0.1, 1.0).otherwise(0.0)).alias(f"{c}_lt10"))
    return rounded(s.agg(above("joy"), below("joy"), above("fear"), below("fear")))


def first_last_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.edge_means(long(spark, d)))


def monthly_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.monthly_means(long(spark, d)))


def half_year_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.bucket_means(long(spark, d), HALF_YEARS))


def december_effect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.month_contrast(long(spark, d)))


def cumulative_share(spark: SparkSession, d: str) -> DataFrame:
    songs = charts(spark, d).groupBy("uri").agg(F.sum("streams").alias("streams"))
    return S.cumulative_share(songs, "streams", "uri").withColumn("cum_share", F.round("cum_share", 6))


def fiftieth_share(spark: SparkSession, d: str) -> DataFrame:
    """What the first fifty songs hold together: the fiftieth place of the running share."""
    return cumulative_share(spark, d).where("place = 50")


def asof_events(spark: SparkSession, d: str) -> DataFrame:
    x = long(spark, d).where("series = 'joy'")
    return S.first_weeks(x, events(spark)).join(x, ["series", "t"]).select("code", F.col("week_date").alias("week"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.event_windows(long(spark, d), events(spark)))


def event_drivers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.drivers(charts(spark, d), scores(spark, d), "joy", BEFORE, AFTER))


def early_late_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.decomposition(charts(spark, d), scores(spark, d), "fear", EARLY, LATE))


def top5_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.concentration(S.decomposition(charts(spark, d), scores(spark, d), "fear", EARLY, LATE)))


def leave_top_out_peak(spark: SparkSession, d: str) -> DataFrame:
    """The peak of a series with and without the song that contributes most in a window."""
    c, s = charts(spark, d), scores(spark, d)
    win = c.where((F.col("week_date") >= F.lit(PEAK_FROM).cast("date")) & (F.col("week_date") < F.lit(PEAK_TO).cast("date"))).join(s.select("uri", "joy"), "uri")
    top = win.groupBy("uri").agg(F.sum(F.col("joy") * F.col("streams")).alias("c")).orderBy(F.desc("c"), "uri").limit(1).select("uri")
    both = [S.to_long(S.weighted_means(c, x, ["joy"]), ["joy"]).withColumn("series", F.lit(n)) for n, x in (("all", s), ("without_top", s.join(top, "uri", "left_anti")))]
    return rounded(S.peak(both[0].unionByName(both[1])))


def rolling3_z(spark: SparkSession, d: str) -> DataFrame:
    x = S.rolling_mean(long(spark, d), 3, 3)
    return rounded(x.select("series", "week_date", F.try_divide(F.col("smooth") - F.avg("value").over(I.by()), F.stddev_samp("value").over(I.by())).alias("z")))


def rolling8_min4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.rolling_mean(long(spark, d), 8, 4).select("series", "week_date", "smooth"))


def pearson(spark: SparkSession, d: str) -> DataFrame:
    w = weekly(spark, d)
    by = Window.partitionBy(F.lit(1)).orderBy("week_date")  # one row a week
    x = w.select("joy", "fear", (F.col("joy") - F.lag("joy").over(by)).alias("dj"), (F.col("fear") - F.lag("fear").over(by)).alias("df"))
    return rounded(x.agg(I.safe_corr("joy", "fear").alias("r"), I.safe_corr("dj", "df").alias("r_diff")))


def spearman_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.spearman_trend(long(spark, d)))


def acf_two_ways(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.lag_correlations(long(spark, d)))


def ols_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.ols_trend(long(spark, d)), digits=8)


def chow_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.chow(long(spark, d)), digits=5)


def chow_anywhere(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.chow_anywhere(long(spark, d)))


def ar1_trend_unrolled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.ar1_unrolled(long(spark, d), rounds=4), digits=8)


def hac_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.hac_trend(long(spark, d)))


def trend_table(spark: SparkSession, d: str) -> DataFrame:
    """The trend record of each series in two corpora: all scored songs, and an older one of half of them."""
    old = S.to_long(S.weighted_means(charts(spark, d), scores(spark, d).where("uri % 2 = 0"), ["joy", "fear"]), ["joy", "fear"])
    tag = lambda x, name: x.withColumn("series", F.concat(F.lit(name + ":"), "series"))
    got = I.trend_table(tag(long(spark, d), "v2").unionByName(tag(old, "old")))
    parts = F.split("series", ":")
    return rounded(got.withColumn("corpus", parts[0]).withColumn("series", parts[1]))


def theme_trends(spark: SparkSession, d: str) -> DataFrame:
    """The trend of each theme's weekly share."""
    got = I.trend_table(S.to_long(S.weighted_means(charts(spark, d), song_themes(spark, d), list(THEMED)), list(THEMED)))
    names = {
        "series": "theme", "mean": "mean_share", "first": "first_6mo", "last": "last_6mo", "slope_per_year": "change_per_year", "p_ar1": "p_ar1",
        "spearman": "rho",
    }
    return rounded(got.select(*[F.col(a).alias(b) for a, b in names.items()]))


def theme_validity(spark: SparkSession, d: str) -> DataFrame:
    """Songs with themes and emotions: fear of those with a theme against the others', by the rank sum test."""
    both = song_themes(spark, d).join(scores(spark, d), "uri")
    rows = both.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("theme"), F.col(k).alias("flag")) for k in THEMED])).alias("x"), F.col("fear").alias("value"),
    ).select("x.theme", "x.flag", "value")
    return rounded(I.rank_sum_test(rows, "flag", "value", "theme"))


def trajectory_shapes(spark: SparkSession, d: str) -> DataFrame:
    return I.trajectory_shapes(long(spark, d))


def lowess_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.smoothed(long(spark, d)))


def trajectory_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The highest and lowest weeks of the smoothed curves, and where they start and end."""
    x = I.smoothed(long(spark, d))
    high, low = F.max_by("week_date", F.struct("smooth", -F.unix_date("week_date"))), F.min_by("week_date", F.struct("smooth", "week_date"))
    ends = [F.min_by("smooth", "week_date").alias("at_start"), F.max_by("smooth", "week_date").alias("at_end")]
    return rounded(x.groupBy("series").agg(high.alias("peak_week"), F.max("smooth").alias("peak"), low.alias("trough_week"), F.min("smooth").alias("trough"), *ends))


def z_panels(spark: SparkSession, d: str) -> DataFrame:
    """Each series standardised, with its smoothed curve: the points and lines of a panel."""
    w = long(spark, d)
    z = w.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(I.by()), F.stddev_samp("value").over(I.by())))
    return rounded(z.select("series", "week_date", F.col("value").alias("z")).join(I.smoothed(z), ["series", "week_date"]))


def change_points(spark: SparkSession, d: str) -> DataFrame:
    return I.change_points(long(spark, d))


def placebo(spark: SparkSession, d: str) -> DataFrame:
    """The share of placebo paths with a strong rank trend: one generator, so one task."""
    share = F.pandas_udf(lambda n: n.map(lambda k: stats.placebo_share(int(k))), "double")
    return spark.range(1).select(share(F.lit(2000)).alias("share"))


def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(
        "p_brand", (F.col("p_type").contains("ECONOMY")).cast("int").alias("flag"), F.col("p_size").cast("double").alias("value"),
    )
    return rounded(I.rank_sum(x, "flag", "value", "p_brand"), "u")


def mann_whitney_test(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(
        "p_brand", (F.col("p_type").contains("ECONOMY")).cast("int").alias("flag"), F.col("p_size").cast("double").alias("value"),
    )
    return rounded(I.rank_sum_test(x, "flag", "value", "p_brand"))


def numbers_report(spark: SparkSession, d: str) -> DataFrame:
    """One row of headline numbers: chart sizes, coverage, saturation, trends, breaks, peak, attribution and correlations."""
    w, c, s = long(spark, d), charts(spark, d), scores(spark, d)
    sizes = c.agg(F.count("*").alias("entries"), F.countDistinct("uri").alias("tracks"))
    scored = s.agg(F.count("*").alias("scored"))
    by_name = lambda *cs: F.concat_ws("; ", F.array_sort(F.collect_list(F.concat_ws(" ", "series", *[F.format_number(F.coalesce(x, F.lit(0.0)), 4) for x in cs]))))
    edges = S.edge_means(w).agg(by_name("first_mean", "last_mean").alias("edges"))
    breaks = I.chow_anywhere(w).agg(by_name("share").alias("chow_anywhere"))
    peak = S.peak(w.where("series = 'joy'")).select(F.col("peak_z").alias("joy_peak_z"), F.col("peak_week").alias("joy_peak_week"))
    top = S.concentration(S.decomposition(c, s, "fear", EARLY, LATE)).select(F.col("change").alias("fear_change"), F.col("top_share").alias("fear_top5_share"))
    rows = [sizes, scored, weekly_coverage(spark, d), saturation(spark, d), edges, breaks, rounded(peak), rounded(top), pearson(spark, d)]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # one row on either side
    return out


def monthly_z(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means standardised within their series: a heat map's cells."""
    m = S.monthly_means(long(spark, d))
    return rounded(m.select("series", "month", F.try_divide(F.col("mean") - F.avg("mean").over(I.by()), F.stddev_samp("mean").over(I.by())).alias("z")))


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the series that moved at p < .05, in order of p, and the songs that hold over a fifth of a change."""
    w, hits = long(spark, d), events(spark)
    e = S.event_windows(w, hits).where("p_perm < 0.05").join(S.first_weeks(w, hits), ["series", "code"])
    text = F.concat(
        "series", F.lit(" "), F.when(F.col("change_sd") >= 0, "+").otherwise(""), X.signed(F.col("change_sd")), F.lit(" SD (p "), X.apa_p(F.col("p_perm")),
        F.lit(")"),
    )
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(*key))), lambda x: x["text"])
    shifts = e.withColumn("text", text).groupBy("code").agg(F.count("*").alias("n"), F.array_join(listed(["p_perm", "series", "text"]), "; ").alias("shifts"))
    s = scores(spark, d)
    values = s.select(
        "uri", F.explode(F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).alias("value")) for v in ("joy", "fear")])).alias("v"),
    ).select("uri", "v.series", "v.value")
    moved = S.event_drivers(charts(spark, d), values, S.weeks_around(w, e.select("series", "code", "t", "p_perm"))).where("share > 0.2")
    named = moved.join(e.select("series", "code", "p_perm"), ["series", "code"]).join(
        s.select("uri", F.concat("track_name", F.lit(" ("), "artist_names", F.lit(")")).alias("text")), "uri",
    )
    songs = named.groupBy("code").agg(F.array_join(F.array_distinct(listed(["p_perm", "series", "place", "text"])), "; ").alias("songs"))
    out = hits.join(shifts, "code", "left").join(songs, "code", "left")
    return out.select(
        "code", "date", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("shifts", F.lit("None at p < .05")).alias("shifts"),
        F.coalesce("songs", F.lit("-")).alias("songs"),
    )


def hourly_users(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means of a short series by event type: hours of the event stream."""
    e = table(spark, d, "events")
    h = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("mean"), F.countDistinct("user_id").alias("users"))
    return rounded(h)


def weekly_stream_batch(spark: SparkSession, d: str) -> DataFrame:
    """The streaming weekly aggregate, run over the events as a batch."""
    from tidemark.streaming.weekly import weekly_means

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value", F.lit(1.0).alias("w"))
    return rounded(weekly_means(e, "value", "w").select(F.col("week_start").cast("date").alias("week_start"), "mean", "weight"))


EVENTS_SQL = "events_at(code, date) AS (VALUES " + ", ".join(f"('{c}', DATE '{x}')" for c, x in EVENTS) + ")"
CASES_SQL = " ".join(f"WHEN week_date >= DATE '{a}' AND week_date < DATE '{b}' THEN '{a}..{b}'" for a, b in zip(HALF_YEARS, HALF_YEARS[1:]))
DECOMPOSED = f""",
x AS (SELECT c.*, s.fear FROM charts c JOIN scores s USING (uri)),
e AS (SELECT uri, fear, sum(streams)::DOUBLE / (SELECT sum(streams) FROM x WHERE week_date < DATE '{EARLY}') AS e FROM x WHERE week_date < DATE '{EARLY}' GROUP BY 1, 2),
l AS (SELECT uri, fear, sum(streams)::DOUBLE / (SELECT sum(streams) FROM x WHERE week_date >= DATE '{LATE}') AS l FROM x WHERE week_date >= DATE '{LATE}' GROUP BY 1, 2),
d AS (SELECT coalesce(e.uri, l.uri) AS uri, (coalesce(l, 0) - coalesce(e, 0)) * coalesce(e.fear, l.fear) AS contribution FROM e FULL JOIN l ON e.uri = l.uri)"""


def _contribution(name: str, weeks: tuple[str, ...]) -> str:
    days = ", ".join(f"DATE '{w}'" for w in weeks)
    return f"""
{name} AS (SELECT uri, sum(streams / all_streams * joy) / {len(weeks)} AS c FROM (
  SELECT c.uri, s.joy, c.streams, sum(c.streams) OVER (PARTITION BY c.week_date)::DOUBLE AS all_streams FROM charts c JOIN scores s USING (uri) WHERE c.week_date IN ({days})) GROUP BY 1)"""


def _simpson(f: str, top: str) -> str:
    """The integral of f, an expression of x, from 0 to |top|."""
    h = f"(abs({top}) / 2000)"
    return f"({h} / 3 * list_sum(list_transform(range(2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * {f.replace('x', f'({h} * i)')})))"


def T_P(t: str, df: str) -> str:
    """Two-sided p value of t by numeric integration."""
    front = f"exp(lgamma(({df} + 1) / 2::DOUBLE) - lgamma({df} / 2::DOUBLE)) / sqrt({df} * pi())"
    return f"greatest(0.0::DOUBLE, 1 - 2 * {front.replace('exp', 'EXP')} * {_simpson(f'pow(1 + pow(x, 2) / {df}, -({df} + 1) / 2::DOUBLE)', t)})"


def N_P(z: str) -> str:
    """Two-sided normal p value by numeric integration."""
    return f"greatest(0.0::DOUBLE, 1 - 2 / sqrt(2 * pi()) * {_simpson('EP(-pow(x, 2) / 2)', z).replace('EP(', 'exp(')})"


def _rounds(n: int) -> str:
    """The AR(1) iteration unrolled, a round a few common tables."""
    out = ["s0 AS (SELECT series, t::DOUBLE AS t, value, lag(value) OVER w AS bv, lag(t) OVER w::DOUBLE AS bt, count(*) OVER (PARTITION BY series) AS n, 0.0::DOUBLE AS rho, NULL::DOUBLE AS b, NULL::DOUBLE AS a, false AS stop FROM long WINDOW w AS (PARTITION BY series ORDER BY t))"]
    for i in range(n):
        out += [
            f"f{i} AS (SELECT series, regr_slope(value - rho * bv, t - rho * bt) AS nb, regr_intercept(value - rho * bv, t - rho * bt) / (1 - any_value(rho)) AS na FROM s{i} GROUP BY 1)",
            f"g{i} AS (SELECT s.*, nb, na, stop OR coalesce(greatest(abs((nb - b) / b), abs((na - a) / a)) < 1e-4, false) AS stop2, value - na - nb * t AS u0 FROM s{i} s JOIN f{i} USING (series))",
            f"h{i} AS (SELECT *, u0 - avg(u0) OVER (PARTITION BY series) AS u FROM g{i})",
            f"k{i} AS (SELECT *, lag(u) OVER (PARTITION BY series ORDER BY t) AS bu FROM h{i})",
            f"r{i} AS (SELECT series, (sum(u * bu) / (any_value(n) - 1)) / (sum(u * u) / any_value(n)) AS nr FROM k{i} GROUP BY 1)",
            f"s{i + 1} AS (SELECT series, t, value, bv, bt, n, CASE WHEN stop2 THEN rho ELSE nr END AS rho, nb AS b, na AS a, stop2 AS stop FROM k{i} JOIN r{i} USING (series))",
        ]
    return ",\n".join(out)


ORACLES = {
    "weekly_weighted_mean": f"WITH {WIDE_SQL} SELECT week_date, {R('joy', 'fear', 'stream_coverage').replace(', 6)', ', 9)')} FROM wide",
    "weekly_coverage": f"WITH {WIDE_SQL} SELECT count(*) AS weeks, {R('avg(stream_coverage) AS coverage_mean', 'min(stream_coverage) AS coverage_min', 'max(stream_coverage) AS coverage_max')} FROM wide",
    "weekly_topk": f"WITH {CHARTS_SQL} SELECT week_date, rank::INT AS rank, uri, streams FROM charts WHERE rank <= 5",
    "song_universe": f"WITH {CHARTS_SQL} SELECT uri, sum(streams)::BIGINT AS total_streams, min(rank)::INT AS peak_rank, min(week_date) AS first_week, arg_min(rank, week_date)::INT AS first_rank, count(DISTINCT week_date) AS n_weeks FROM charts GROUP BY 1",
    "full_outer_scores": f"WITH {CHARTS_SQL}, t AS (SELECT p_partkey AS uri, (p_size > 25)::INT AS flag FROM part WHERE p_partkey % 2 = 0) SELECT coalesce(s.uri, t.uri) AS uri, {R('joy')}, flag FROM scores s FULL JOIN t ON s.uri = t.uri",
    "anti_join_impact": f"""WITH {CHARTS_SQL},
a AS (SELECT week_date, sum(joy * streams) / sum(streams) AS x FROM charts JOIN scores USING (uri) GROUP BY 1),
b AS (SELECT week_date, sum(joy * streams) / sum(streams) AS y FROM charts JOIN scores USING (uri) WHERE uri NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1)
SELECT count(*) AS weeks, {R('corr(x, y) AS r', 'avg(abs(x - y)) AS mean_change')} FROM a JOIN b USING (week_date)""",
    "semi_join_share": f"""WITH {CHARTS_SQL},
w AS (SELECT week_date, coalesce(sum(streams) FILTER (WHERE uri IN (SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%')), 0)::DOUBLE / sum(streams)::DOUBLE AS value FROM charts GROUP BY 1)
SELECT 'share' AS series, CASE {CASES_SQL} END AS period, {R('avg(value) AS mean')} FROM w GROUP BY 2 HAVING period IS NOT NULL""",
    "status_share": f"SELECT o_orderstatus AS status, count(*) AS n, {R('sum(o_totalprice) / (SELECT sum(l_extendedprice) FROM lineitem) AS stream_share')} FROM orders GROUP BY 1",
    "value_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "saturation": f"WITH {CHARTS_SQL} SELECT {R('avg((joy > 0.9)::INT) AS joy_gt90', 'avg((joy < 0.1)::INT) AS joy_lt10', 'avg((fear > 0.9)::INT) AS fear_gt90', 'avg((fear < 0.1)::INT) AS fear_lt10')} FROM scores",
    "first_last_means": f"WITH {LONG_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM long) SELECT series, {R('avg(value) AS mean', 'avg(value) FILTER (WHERE t < 26) AS first_mean', 'avg(value) FILTER (WHERE t >= n - 26) AS last_mean')} FROM c GROUP BY 1",
    "monthly_mean": f"""WITH {LONG_SQL},
spine AS (SELECT series, unnest(generate_series(date_trunc('month', min(week_date))::TIMESTAMP, date_trunc('month', max(week_date))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM long GROUP BY 1),
m AS (SELECT series, date_trunc('month', week_date)::DATE AS month, avg(value) AS mean FROM long GROUP BY 1, 2)
SELECT series, month, {R('mean')} FROM spine LEFT JOIN m USING (series, month)""",
    "half_year_means": f"WITH {LONG_SQL} SELECT series, CASE {CASES_SQL} END AS period, {R('avg(value) AS mean')} FROM long GROUP BY 1, 2 HAVING period IS NOT NULL",
    "december_effect": f"WITH {LONG_SQL} SELECT series, {R('avg(value) FILTER (WHERE month(week_date) = 12) - avg(value) FILTER (WHERE month(week_date) <> 12) AS difference')} FROM long GROUP BY 1",
    "cumulative_share": f"WITH {CHARTS_SQL}, s AS (SELECT uri, sum(streams)::BIGINT AS streams FROM charts GROUP BY 1) SELECT uri, streams, row_number() OVER (ORDER BY streams DESC, uri) AS place, round(sum(streams) OVER (ORDER BY streams DESC, uri)::DOUBLE / sum(streams) OVER ()::DOUBLE, 6) AS cum_share FROM s",
    "asof_events": f"WITH {LONG_SQL}, {EVENTS_SQL} SELECT code, min(week_date) AS week FROM events_at JOIN long ON week_date >= date WHERE series = 'joy' GROUP BY 1",
    "event_windows": f"""WITH {LONG_SQL}, {EVENTS_SQL},
x AS (SELECT *, count(*) OVER p AS n, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS sd,
        avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS after,
        avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM long WINDOW p AS (PARTITION BY series)),
y AS (SELECT *, CASE WHEN t >= 3 AND t <= n - 3 THEN after - before END AS change FROM x),
hit AS (SELECT series, code, min(t) AS t FROM y JOIN events_at ON week_date >= date GROUP BY 1, 2),
at AS (SELECT h.series, h.code, y.week_date AS week, y.change, y.change / y.sd AS change_sd, (y.after - y.mean) / y.sd AS level_z FROM hit h JOIN y ON y.series = h.series AND y.t = h.t),
p AS (SELECT a.series, a.code, avg(CASE WHEN abs(y.change) >= abs(a.change) THEN 1.0 WHEN a.change IS NOT NULL THEN 0.0 END) AS p_perm FROM at a JOIN y ON y.series = a.series AND y.change IS NOT NULL GROUP BY 1, 2)
SELECT series, code, week, {R('change', 'change_sd', 'p_perm', 'level_z')} FROM at JOIN p USING (series, code)""".replace("at AS", "hits_at AS").replace("FROM at ", "FROM hits_at "),
    "event_drivers": f"""WITH {CHARTS_SQL}, {_contribution("b", BEFORE)}, {_contribution("a", AFTER)},
d AS (SELECT coalesce(a.uri, b.uri) AS uri, coalesce(a.c, 0) - coalesce(b.c, 0) AS contribution FROM a FULL JOIN b ON a.uri = b.uri)
SELECT uri, {R('contribution', 'contribution / (SELECT sum(contribution) FROM d) AS share')} FROM (SELECT * FROM d ORDER BY abs(contribution) DESC, uri LIMIT 3)""",
    "early_late_decomposition": f"WITH {CHARTS_SQL}{DECOMPOSED} SELECT uri, {R('contribution')} FROM d",
    "top5_concentration": f"WITH {CHARTS_SQL}{DECOMPOSED} SELECT {R('(SELECT sum(contribution) FROM d) AS change', '(SELECT sum(contribution) FROM (SELECT * FROM d ORDER BY abs(contribution) DESC, uri LIMIT 5)) / (SELECT sum(contribution) FROM d) AS top_share')}",
    "leave_top_out_peak": f"""WITH {CHARTS_SQL},
top AS (SELECT uri FROM charts JOIN scores USING (uri) WHERE week_date >= DATE '{PEAK_FROM}' AND week_date < DATE '{PEAK_TO}' GROUP BY uri ORDER BY sum(joy * streams) DESC, uri LIMIT 1),
w AS (SELECT 'all' AS series, week_date, sum(joy * streams) / sum(streams) AS value FROM charts JOIN scores USING (uri) GROUP BY 2
  UNION ALL SELECT 'without_top', week_date, sum(joy * streams) / sum(streams) FROM charts JOIN scores USING (uri) WHERE uri NOT IN (SELECT uri FROM top) GROUP BY 2),
m AS (SELECT *, avg(value) OVER o AS s, count(*) OVER o AS c, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS sd FROM w
  WINDOW o AS (PARTITION BY series ORDER BY week_date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), p AS (PARTITION BY series)),
z AS (SELECT series, week_date, (s - mean) / sd AS z FROM m WHERE c = 3)
SELECT series, {R('max(z) AS peak_z')}, arg_max(week_date, z) AS peak_week FROM z GROUP BY 1""",
    "rolling3_z": f"""WITH {LONG_SQL}, m AS (SELECT *, avg(value) OVER o AS s, count(*) OVER o AS c, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS sd FROM long
  WINDOW o AS (PARTITION BY series ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), p AS (PARTITION BY series)) SELECT series, week_date, {R('CASE WHEN c = 3 THEN (s - mean) / sd END AS z')} FROM m""",
    "rolling8_min4": f"WITH {LONG_SQL}, m AS (SELECT *, avg(value) OVER o AS s, count(*) OVER o AS c FROM long WINDOW o AS (PARTITION BY series ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)) SELECT series, week_date, {R('CASE WHEN c >= 4 THEN s END AS smooth')} FROM m",
    "pearson": f"WITH {WIDE_SQL}, x AS (SELECT joy, fear, joy - lag(joy) OVER (ORDER BY week_date) AS dj, fear - lag(fear) OVER (ORDER BY week_date) AS df FROM wide) SELECT {R('corr(joy, fear) AS r', 'corr(dj, df) AS r_diff')} FROM x",
    "spearman_trend": f"WITH {LONG_SQL}, r AS (SELECT series, t, rank() OVER (PARTITION BY series ORDER BY value) + (count(*) OVER (PARTITION BY series, value) - 1) / 2.0 AS r FROM long) SELECT series, count(*) AS n, {R('corr(t, r) AS rho')} FROM r GROUP BY 1",
    "acf_two_ways": f"""WITH {LONG_SQL}, x AS (SELECT series, value, lag(value) OVER (PARTITION BY series ORDER BY t) AS before, avg(value) OVER (PARTITION BY series) AS m FROM long),
y AS (SELECT series, count(value) AS n, corr(value, before) AS pearson_lag1, sum((value - m) * (before - m)) / sum((value - m) * (value - m)) AS acf1 FROM x GROUP BY 1)
SELECT series, n, {R('pearson_lag1', 'acf1', 'n * (1 - acf1) / (1 + acf1) AS n_eff')} FROM y""",
    "ols_trend": f"""WITH {LONG_SQL}, y AS (SELECT series, count(value) AS n, regr_slope(value, t) AS slope, regr_sxx(value, t) AS sxx, regr_syy(value, t) AS syy, regr_sxy(value, t) AS sxy FROM long GROUP BY 1)
SELECT series, n, round(slope, 8) + 0.0 AS slope, round(slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 8) + 0.0 AS t_value FROM y""",
    "chow_stat": f"""WITH {LONG_SQL}, x AS (SELECT series, t, count(*) OVER p AS n,
  regr_syy(value, t) OVER p - regr_sxy(value, t) OVER p ** 2 / regr_sxx(value, t) OVER p AS s,
  regr_syy(value, t) OVER a - regr_sxy(value, t) OVER a ** 2 / regr_sxx(value, t) OVER a AS s1,
  regr_syy(value, t) OVER b - regr_sxy(value, t) OVER b ** 2 / regr_sxx(value, t) OVER b AS s2 FROM long
  WINDOW p AS (PARTITION BY series), a AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, t, n, round(((s - s1 - s2) / 2) / ((s1 + s2) / (n - 4)), 5) + 0.0 AS f FROM x WHERE t >= 15 AND t < n - 14""",
    "ar1_trend_unrolled": f"WITH {LONG_SQL}, {_rounds(3)} SELECT series, round(regr_slope(value - rho * bv, t - rho * bt), 8) + 0.0 AS slope, round(any_value(rho), 8) + 0.0 AS rho FROM s3 GROUP BY 1",
    "mann_whitney_u": f"""WITH x AS (SELECT p_brand, p_type LIKE '%ECONOMY%' AS flag, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r FROM part),
y AS (SELECT p_brand, count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag) AS n0, sum(r) FILTER (WHERE flag) AS s FROM x GROUP BY 1)
SELECT p_brand, n1, n0, {R('s - n1 * (n1 + 1) / 2.0 AS u')} FROM y""",
    "version_comparison": f"""WITH {CHARTS_SQL},
n AS (SELECT week_date, sum(joy * streams) / sum(streams) AS v FROM charts JOIN scores USING (uri) GROUP BY 1),
o AS (SELECT week_date, sum(joy * streams) / sum(streams) AS v FROM charts JOIN scores USING (uri) WHERE uri % 2 = 0 GROUP BY 1),
rn AS (SELECT row_number() OVER (ORDER BY week_date) AS t, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM n),
ro AS (SELECT row_number() OVER (ORDER BY week_date) AS t, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM o)
SELECT {R('(SELECT corr(n.v, o.v) FROM n JOIN o USING (week_date)) AS r', '(SELECT corr(t, r) FROM ro) AS rho_old', '(SELECT corr(t, r) FROM rn) AS rho_new')}""",
    "monthly_z": f"WITH {LONG_SQL}, m AS (SELECT series, date_trunc('month', week_date)::DATE AS month, avg(value) AS mean FROM long GROUP BY 1, 2), spine AS (SELECT series, unnest(generate_series(date_trunc('month', min(week_date))::TIMESTAMP, date_trunc('month', max(week_date))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM long GROUP BY 1) SELECT series, month, {R('(mean - avg(mean) OVER (PARTITION BY series)) / stddev_samp(mean) OVER (PARTITION BY series) AS z')} FROM spine LEFT JOIN m USING (series, month)",
    "hourly_users": f"SELECT event_type, date_trunc('hour', ts) AS hour, {R('avg(value) AS mean')}, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "weekly_stream_batch": f"SELECT (DATE '1970-01-01' + CAST(floor(epoch(ts) / 86400 / 7) * 7 AS INT)) AS week_start, {R('avg(value) AS mean', 'count(*)::DOUBLE AS weight')} FROM events GROUP BY 1",
}

RANKED = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0::DOUBLE"
HAC = """ln AS (SELECT series, count(value) AS n, regr_slope(value, t) AS slope, regr_intercept(value, t) AS start, regr_sxx(value, t) AS sxx, avg(t) AS mt FROM long GROUP BY 1),
hs AS (SELECT series, l.t, (l.t - mt) * (value - start - slope * l.t) AS s FROM long l JOIN ln USING (series)),
hm AS (SELECT a.series, sum(CASE WHEN a.t = b.t THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (1 - (b.t - a.t) / 13.0::DOUBLE) END * a.s * b.s) AS meat FROM hs a JOIN hs b ON a.series = b.series AND b.t BETWEEN a.t AND a.t + 12 GROUP BY 1),
hac AS (SELECT series, n, slope, slope * sxx / sqrt(meat) AS z FROM ln JOIN hm USING (series))"""
SPEARMAN = f"""sr AS (SELECT series, t, {RANKED.format(g='series', v='value')} AS r FROM long),
sp AS (SELECT series, count(*) AS n, corr(t, r) AS rho FROM sr GROUP BY 1)"""
SPEARMAN_P = T_P("(rho * sqrt(n - 2) / sqrt(1 - rho * rho))", "(n - 2)")


def _ar1(rounds: int) -> str:
    return f"""{_rounds(rounds)},
aw AS (SELECT series, any_value(n) AS n, any_value(rho) AS rho_ar1, regr_slope(value - rho * bv, t - rho * bt) AS slope, regr_sxx(value - rho * bv, t - rho * bt) AS sxx,
  regr_syy(value - rho * bv, t - rho * bt) AS syy, regr_sxy(value - rho * bv, t - rho * bt) AS sxy FROM s{rounds} GROUP BY 1),
ar AS (SELECT series, n, rho_ar1, slope, slope / sqrt((syy - sxy * sxy / sxx) / (n - 3) / sxx) AS t_value FROM aw)"""


TRENDS = f"""{SPEARMAN},
{HAC},
{_ar1(9)},
ed AS (SELECT series, avg(value) AS mean, avg(value) FILTER (WHERE t < 26) AS first_mean, avg(value) FILTER (WHERE t >= m - 26) AS last_mean FROM (SELECT *, count(*) OVER (PARTITION BY series) AS m FROM long) GROUP BY 1),
ac AS (SELECT series, corr(value, before) AS acf1 FROM (SELECT series, value, lag(value) OVER (PARTITION BY series ORDER BY t) AS before FROM long) GROUP BY 1),
trends AS (SELECT series, mean, rho AS spearman, {SPEARMAN_P.replace('n -', 'sp.n -')} AS p_naive, {N_P('z')} AS p_hac, {T_P('t_value', '(ar.n - 3)')} AS p_ar1, ar.slope * 52 AS slope_per_year, rho_ar1, acf1, first_mean, last_mean
  FROM ed JOIN sp USING (series) JOIN hac USING (series) JOIN ar USING (series) JOIN ac USING (series))"""
TWO_CORPORA = LONG_SQL.replace("long AS (", "base AS (") + """,
wide2 AS (SELECT week_date, sum(joy * streams) / sum(streams) AS joy, sum(fear * streams) / sum(streams) AS fear FROM charts JOIN scores USING (uri) WHERE uri % 2 = 0 GROUP BY 1),
pairs2 AS (SELECT 'old:joy' AS series, week_date, joy AS value FROM wide2 UNION ALL SELECT 'old:fear', week_date, fear FROM wide2),
long AS (SELECT 'v2:' || series AS series, t, week_date, value FROM base UNION ALL SELECT series, row_number() OVER (PARTITION BY series ORDER BY week_date) - 1, week_date, value FROM pairs2)"""
THEMES_SQL = "themes AS (SELECT p_partkey AS uri, " + ", ".join(f"list_has_any(string_split(p_name, ' '), {list(w)})::INT AS {k}" for k, w in THEMED.items()) + " FROM part)"
THEME_LONG = f"""{CHARTS_SQL}, {THEMES_SQL},
tw AS (SELECT week_date, sum(tool * streams)::DOUBLE / sum(streams) AS tool, sum(look * streams)::DOUBLE / sum(streams) AS look FROM charts JOIN themes USING (uri) GROUP BY 1),
tp AS (SELECT 'tool' AS series, week_date, tool AS value FROM tw UNION ALL SELECT 'look', week_date, look FROM tw),
long AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY week_date) - 1 AS t, week_date, value FROM tp)"""


def _lowess(robust: int = 3) -> str:
    """Local lines over the nearest fifth with tricube weights, reweighted by bisquares of the residuals; ends in `smoothed`."""
    out = [
        "lm AS (SELECT *, greatest(2, floor(0.2 * count(*) OVER (PARTITION BY series) + 1e-10)) AS k FROM long)",
        "lnb AS (SELECT a.series, a.t AS i, b.t AS j, b.value AS y, abs(b.t - a.t) AS d FROM lm a JOIN lm b USING (series) QUALIFY row_number() OVER (PARTITION BY a.series, a.t ORDER BY abs(b.t - a.t), b.t) <= a.k)",
        "lh AS (SELECT *, max(d) OVER (PARTITION BY series, i) AS h FROM lnb)",
        "lw AS (SELECT series, i, j, y, CASE WHEN d <= 0.001 * h THEN 1.0::DOUBLE WHEN d >= 0.999 * h THEN 0.0::DOUBLE ELSE pow(1 - pow(d / h::DOUBLE, 3), 3) END AS w FROM lh)",
        "lt0 AS (SELECT series, t, week_date, value, 1.0::DOUBLE AS tr FROM long)",
    ]
    for r in range(robust + 1):
        out += [
            f"ls{r} AS (SELECT w.series, i, sum(w * tr) AS s, sum(w * tr * j) / sum(w * tr) AS m, sum(w * tr * y) / sum(w * tr) AS my, sum(w * tr * j * j) / sum(w * tr) AS mjj, sum(w * tr * j * y) / sum(w * tr) AS mjy FROM lw w JOIN lt{r} q ON q.series = w.series AND q.t = w.j GROUP BY 1, 2)",
            f"lf{r} AS (SELECT q.*, CASE WHEN s > 0 THEN my + CASE WHEN mjj - m * m > 1e-12 THEN (mjy - m * my) / (mjj - m * m) ELSE 0 END * (t - m) ELSE value END AS fit FROM lt{r} q JOIN ls{r} l ON l.series = q.series AND l.i = q.t)",
            f"lr{r} AS (SELECT *, abs(value - fit) AS r, 6 * median(abs(value - fit)) OVER (PARTITION BY series) AS sc FROM lf{r})",
            f"lt{r + 1} AS (SELECT series, t, week_date, value, CASE WHEN NOT sc > 0 OR r <= 0.001 * sc THEN 1.0::DOUBLE WHEN r >= 0.999 * sc THEN 0.0::DOUBLE ELSE pow(1 - pow(r / sc, 2), 2) END AS tr FROM lr{r})",
        ]
    return ",\n".join([*out, f"smoothed AS (SELECT series, t, week_date, value, fit AS smooth FROM lf{robust})"])


LOWESS = _lowess()


def _binseg(breaks: int = 3) -> str:
    """The split of the best gain in squared residuals of lines, again and again, at multiples of five."""
    out = [
        "bz AS (SELECT series, t, week_date, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS z, count(*) OVER p AS n FROM long WINDOW p AS (PARTITION BY series))",
        "be AS (SELECT DISTINCT series, t AS e FROM bz WHERE t % 5 = 0 UNION SELECT DISTINCT series, n FROM bz)",
        "bc AS (SELECT x.series, x.e AS a, y.e AS b, regr_syy(z, t) - coalesce(pow(regr_sxy(z, t), 2) / nullif(regr_sxx(z, t), 0), 0) AS c FROM be x JOIN be y ON x.series = y.series AND x.e < y.e JOIN bz ON bz.series = x.series AND t >= x.e AND t < y.e GROUP BY 1, 2, 3)",
        "b0 AS (SELECT series, list_sort([0, any_value(n)]) AS cuts FROM bz GROUP BY 1)",
    ]
    for k in range(breaks):
        out += [
            f"bs{k} AS (SELECT series, cuts, unnest(list_slice(cuts, 1, -2)) AS a, unnest(list_slice(cuts, 2, -1)) AS b FROM b{k})",
            f"bg{k} AS (SELECT s.series, any_value(s.cuts) AS cuts, arg_max(l.b, (w.c - l.c - r.c, -l.b)) AS best FROM bs{k} s JOIN bc w ON w.series = s.series AND w.a = s.a AND w.b = s.b JOIN bc l ON l.series = s.series AND l.a = s.a AND l.b >= s.a + 2 AND l.b <= s.b - 2 JOIN bc r ON r.series = s.series AND r.a = l.b AND r.b = s.b GROUP BY 1)",
            f"b{k + 1} AS (SELECT series, list_sort(list_append(cuts, best)) AS cuts FROM bg{k})",
        ]
    last = f"bl AS (SELECT series, unnest(list_slice(cuts, 2, -2)) AS t FROM b{breaks})"
    return ",\n".join([*out, last]) + " SELECT bl.series, bl.t::INT AS t, week_date FROM bl JOIN bz ON bz.series = bl.series AND bz.t = bl.t"


BINSEG = _binseg()


def _rank_sum(rows: str, group: str, value: str) -> str:
    """The rank sum test over common tables `rows` that end in x (group, flag, value)."""
    z = "CASE WHEN sd > 0 THEN greatest(0.0::DOUBLE, abs(u - n1 * n0 / 2.0::DOUBLE) - 0.5) / sd ELSE 0.0::DOUBLE END"
    return f"""WITH {rows},
r AS (SELECT *, {RANKED.format(g=group, v=value)} AS r FROM x),
y AS (SELECT {group}, count(*) FILTER (WHERE flag = 1) AS n1, count(*) FILTER (WHERE flag <> 1) AS n0, avg({value}) FILTER (WHERE flag = 1) AS mean1, avg({value}) FILTER (WHERE flag <> 1) AS mean0, sum(r) FILTER (WHERE flag = 1) AS s FROM r GROUP BY 1),
tie AS (SELECT {group}, sum(pow(c, 3) - c) AS ties FROM (SELECT {group}, {value}, count(*)::DOUBLE AS c FROM x GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT *, s - n1 * (n1 + 1) / 2.0::DOUBLE AS u, sqrt(n1 * n0 / 12.0::DOUBLE * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM y JOIN tie USING ({group}) WHERE n1 >= 5 AND n0 > 0),
w AS (SELECT *, {z} AS z FROM q)
SELECT {group}, n1, n0, {R('mean1', 'mean0', 'u', 'z', N_P('z') + ' AS p')} FROM w"""


ORACLES |= {
    "song_totals": ORACLES["song_universe"],
    "song_universe": f"""WITH {CHARTS_SQL},
n AS (SELECT p_partkey AS uri, p_name || CASE WHEN p_partkey % 41 = 0 THEN ' שיר' ELSE '' END AS track_name, p_brand || '-' || p_size || ', ' || p_brand || '-' || (p_size + 1) AS artist_names, p_partkey % 41 = 0 AS hebrew FROM part),
s AS (SELECT uri, track_name, artist_names, any_value(hebrew) AS hebrew, sum(streams)::BIGINT AS total_streams, min(rank)::INT AS peak_rank, min(week_date) AS first_week, count(DISTINCT week_date) AS n_weeks FROM charts JOIN n USING (uri) GROUP BY 1, 2, 3),
e AS (SELECT uri, hebrew, unnest(string_split(artist_names, ', ')) AS artist FROM s),
ours AS (SELECT artist FROM e WHERE hebrew UNION SELECT 'Brand#3-7' UNION SELECT 'Brand#9-20')
SELECT uri, track_name, artist_names, total_streams, peak_rank, first_week, n_weeks, CASE WHEN hebrew THEN 'hebrew_title' ELSE 'israeli_artist' END AS selection FROM s WHERE hebrew OR uri IN (SELECT uri FROM e JOIN ours USING (artist))""",
    "dedup_scores_join": f"""WITH {CHARTS_SQL}, f AS (SELECT l_partkey AS uri, l_discount AS joy, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT week_date, {R('sum(joy * streams) / sum(streams) FILTER (WHERE rn = 1) AS joy', '(sum(streams) FILTER (WHERE rn = 1))::DOUBLE / sum(streams)::DOUBLE AS stream_coverage')} FROM charts LEFT JOIN (SELECT * FROM f WHERE rn = 1) f USING (uri) GROUP BY 1""",
    "fiftieth_share": ORACLES["cumulative_share"] + " QUALIFY place = 50",
    "anti_join_impact": f"""WITH {CHARTS_SQL},
a AS (SELECT week_date, sum(joy * streams) / sum(streams) AS x FROM charts JOIN scores USING (uri) GROUP BY 1),
b AS (SELECT week_date, sum(joy * streams) / sum(streams) AS y FROM charts JOIN scores USING (uri) WHERE uri NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1),
j AS (SELECT *, row_number() OVER (ORDER BY week_date) AS t, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM a JOIN b USING (week_date))
SELECT count(*) AS weeks, {R('corr(x, y) AS r', 'avg(abs(x - y)) AS mean_change', 'corr(t, rx) AS rho_all_songs', 'corr(t, ry) AS rho_cleared')} FROM j""",
    "spearman_trend": f"WITH {LONG_SQL}, {SPEARMAN} SELECT series, n, {R('rho', SPEARMAN_P + ' AS p')} FROM sp",
    "ols_trend": f"""WITH {LONG_SQL}, y AS (SELECT series, count(value) AS n, regr_slope(value, t) AS slope, regr_sxx(value, t) AS sxx, regr_syy(value, t) AS syy, regr_sxy(value, t) AS sxy FROM long GROUP BY 1),
v AS (SELECT series, n, slope, slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t_value FROM y)
SELECT series, n, round(slope, 8) + 0.0 AS slope, round(t_value, 8) + 0.0 AS t_value, round({T_P('t_value', '(n - 2)')}, 8) + 0.0 AS p FROM v""",
    "hac_trend": f"WITH {LONG_SQL}, {HAC} SELECT series, n, {R('slope', 'z', N_P('z') + ' AS p')} FROM hac",
    "ar1_trend_unrolled": f"WITH {LONG_SQL}, {_ar1(3)} SELECT series, round(slope, 8) + 0.0 AS slope, round(rho_ar1, 8) + 0.0 AS rho, round(t_value, 8) + 0.0 AS t_value, round({T_P('t_value', '(n - 3)')}, 8) + 0.0 AS p FROM ar",
    "chow_anywhere": ORACLES["chow_stat"].replace("SELECT series, t, n, round(((s - s1 - s2) / 2) / ((s1 + s2) / (n - 4)), 5) + 0.0 AS f FROM x WHERE", "SELECT series, round(avg((pow(1 + 2 * greatest(((s - s1 - s2) / 2) / ((s1 + s2) / (n - 4)), 0) / (n - 4), -(n - 4) / 2.0::DOUBLE) < 0.001)::INT), 6) + 0.0 AS share FROM x WHERE") + " GROUP BY 1",
    "trend_table": f"WITH {TWO_CORPORA}, {TRENDS} SELECT split_part(series, ':', 1) AS corpus, split_part(series, ':', 2) AS series, {R('mean', 'spearman', 'p_naive', 'p_hac', 'p_ar1', 'slope_per_year', 'rho_ar1', 'acf1')}, round(first_mean, 6) + 0.0 AS \"first\", round(last_mean, 6) + 0.0 AS \"last\" FROM trends",
    "theme_trends": f"WITH {THEME_LONG}, {TRENDS} SELECT series AS theme, {R('mean AS mean_share', 'first_mean AS first_6mo', 'last_mean AS last_6mo', 'slope_per_year AS change_per_year', 'p_ar1', 'spearman AS rho')} FROM trends",
    "lowess_smooth": f"WITH {LONG_SQL}, {LOWESS} SELECT series, week_date, {R('smooth')} FROM smoothed",
    "trajectory_extremes": f"""WITH {LONG_SQL}, {LOWESS} SELECT series, arg_max(week_date, (smooth, -t)) AS peak_week, arg_min(week_date, (smooth, t)) AS trough_week,
{R('max(smooth) AS peak', 'min(smooth) AS trough', 'arg_min(smooth, t) AS at_start', 'arg_max(smooth, t) AS at_end')} FROM smoothed GROUP BY 1""",
    "z_panels": f"""WITH {LONG_SQL.replace("long AS (", "base AS (")},
long AS (SELECT series, t, week_date, (value - avg(value) OVER (PARTITION BY series)) / stddev_samp(value) OVER (PARTITION BY series) AS value FROM base),
{LOWESS} SELECT series, week_date, {R('value AS z', 'smooth')} FROM smoothed""",
    "change_points": f"""WITH {LONG_SQL}, {BINSEG}""",
    "theme_validity": _rank_sum(f"{CHARTS_SQL}, {THEMES_SQL}, x AS (SELECT 'tool' AS theme, tool AS flag, fear AS value FROM themes JOIN scores USING (uri) UNION ALL SELECT 'look', look, fear FROM themes JOIN scores USING (uri))", "theme", "value"),
    "mann_whitney_test": _rank_sum("x AS (SELECT p_brand, (p_type LIKE '%ECONOMY%')::INT AS flag, p_size::DOUBLE AS value FROM part)", "p_brand", "value"),
    "event_summary": f"""WITH {LONG_SQL}, {EVENTS_SQL},
x AS (SELECT *, count(*) OVER p AS n, stddev_samp(value) OVER p AS sd, avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM long WINDOW p AS (PARTITION BY series)),
y AS (SELECT *, CASE WHEN t >= 3 AND t <= n - 3 THEN c END AS change FROM x),
hit AS (SELECT series, code, min(t) AS t FROM y JOIN events_at ON week_date >= date GROUP BY 1, 2),
m AS (SELECT h.series, h.code, h.t, y.change, y.change / y.sd AS change_sd FROM hit h JOIN y ON y.series = h.series AND y.t = h.t),
pp AS (SELECT m.series, m.code, m.t, m.change_sd, avg((abs(y.change) >= abs(m.change))::INT) AS p FROM m JOIN y ON y.series = m.series AND y.change IS NOT NULL WHERE m.change IS NOT NULL GROUP BY 1, 2, 3, 4),
e AS (SELECT * FROM pp WHERE p < 0.05),
f AS (SELECT *, series || ' ' || CASE WHEN change_sd >= 0 THEN '+' ELSE '' END || replace(regexp_replace(printf('%.2f', change_sd), '^(-?)0\\.', '\\1.'), '-', chr(8722)) || ' SD (p ' || CASE WHEN p < 0.001 THEN '< .001' ELSE '= ' || regexp_replace(printf('%.3f', p), '^0\\.', '.') END || ')' AS text FROM e),
sh AS (SELECT code, count(*) AS n, string_agg(text, '; ' ORDER BY p, series) AS shifts FROM f GROUP BY 1),
sc AS (SELECT uri, 'joy' AS series, joy AS value FROM scores UNION ALL SELECT uri, 'fear', fear FROM scores),
ct AS (SELECT sc.series, c.week_date, c.uri, c.streams::DOUBLE / sum(c.streams) OVER (PARTITION BY sc.series, c.week_date) * sc.value AS c FROM charts c JOIN sc USING (uri)),
wk AS (SELECT e.series, e.code, e.p, l.week_date, CASE WHEN l.t < e.t THEN -1 ELSE 1 END AS side FROM e JOIN long l ON l.series = e.series AND l.t BETWEEN e.t - 3 AND e.t + 2),
d AS (SELECT series, code, any_value(p) AS p, uri, sum(side * c) / 3 AS contribution FROM wk JOIN ct USING (series, week_date) GROUP BY 1, 2, 4),
g AS (SELECT *, contribution / sum(contribution) OVER (PARTITION BY series, code) AS share, row_number() OVER (PARTITION BY series, code ORDER BY abs(contribution) DESC, uri) AS place FROM d),
nm AS (SELECT code, p, series, place, track_name || ' (' || artist_names || ')' AS text FROM g JOIN scores USING (uri) WHERE place <= 2 AND share > 0.2),
fi AS (SELECT *, row_number() OVER (PARTITION BY code, text ORDER BY p, series, place) AS rn FROM nm),
so AS (SELECT code, string_agg(text, '; ' ORDER BY p, series, place) AS songs FROM fi WHERE rn = 1 GROUP BY 1)
SELECT code, date, coalesce(n, 0) AS n, coalesce(shifts, 'None at p < .05') AS shifts, coalesce(songs, '-') AS songs FROM events_at LEFT JOIN sh USING (code) LEFT JOIN so USING (code)""",
}
ORACLES["numbers_report"] = f"""SELECT * FROM (WITH {CHARTS_SQL} SELECT count(*) AS entries, count(DISTINCT uri) AS tracks FROM charts), (WITH {CHARTS_SQL} SELECT count(*) AS scored FROM scores),
({ORACLES['weekly_coverage']}), ({ORACLES['saturation']}),
(SELECT string_agg(series || ' ' || printf('%.4f', first_mean) || ' ' || printf('%.4f', last_mean), '; ' ORDER BY series) AS edges FROM ({ORACLES['first_last_means']})),
(SELECT string_agg(series || ' ' || printf('%.4f', share), '; ' ORDER BY series) AS chow_anywhere FROM ({ORACLES['chow_anywhere']})),
(SELECT peak_z AS joy_peak_z, peak_week AS joy_peak_week FROM ({ORACLES['leave_top_out_peak']}) WHERE series = 'all'),
(SELECT change AS fear_change, top_share AS fear_top5_share FROM ({ORACLES['top5_concentration']})), ({ORACLES['pearson']})"""

QUERIES = {f.__name__: f for f in (
    weekly_weighted_mean, weekly_coverage, weekly_topk, song_universe, song_totals, dedup_scores_join, full_outer_scores, version_comparison, anti_join_impact, semi_join_share, status_share,
    value_counts, saturation, first_last_means, monthly_mean, half_year_means, december_effect, cumulative_share, fiftieth_share, asof_events, event_windows, event_drivers,
    early_late_decomposition, top5_concentration, leave_top_out_peak, rolling3_z, rolling8_min4, pearson, spearman_trend, acf_two_ways, ols_trend, chow_stat,
    chow_anywhere, ar1_trend_unrolled, hac_trend, trend_table, theme_trends, theme_validity, trajectory_shapes, trajectory_extremes, lowess_smooth, z_panels, change_points, placebo, mann_whitney_u, mann_whitney_test, numbers_report,
    monthly_z, event_summary, hourly_users, weekly_stream_batch,
)}
