"""Inference over long series (series, t, week_date, value): closed forms as SQL, kernels one series at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import stats


def by() -> WindowSpec:
    return Window.partitionBy("series")


def in_time() -> WindowSpec:
    return by().orderBy("t")


def grouped(series: DataFrame, schema: str, kernel) -> DataFrame:
    """kernel(name, weeks, values) -> dict of columns or list of them, for each series; nulls are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("t")
        rows = kernel(pdf["week_date"].to_numpy(), pdf["value"].to_numpy(float)) if len(pdf) > 6 else []
        rows = [rows] if isinstance(rows, dict) else rows
        out = pd.DataFrame(rows)
        out.insert(0, "series", pdf["series"].iloc[0] if len(pdf) else None)
        return out if rows else pd.DataFrame(columns=["series"] + [c.split()[0] for c in schema.split(", ")])

    return series.groupBy("series").applyInPandas(one, "series string, " + schema)


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """corr, null where either side does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when(
        (F.coalesce(F.stddev_samp(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_samp(y), F.lit(0.0)) > 0),
        F.regr_sxy(x, y) / F.sqrt(F.regr_sxx(x, y) * F.regr_syy(x, y)),
    )


def average_rank(value: str, within: str = "series") -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(within)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(within, value)) - 1) / 2


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value of a t statistic; null stays null. One row a series or group."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else stats.t_tail(a, b) for a, b in zip(t, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p value of a normal statistic; null stays null."""
    return pd.Series([None if pd.isna(a) else stats.normal_tail(a) for a in z], dtype=float)


def spearman_trend(series: DataFrame) -> DataFrame:
    """The rank correlation of a series with time, and its naive p value."""
    ranked = series.where("value IS NOT NULL").withColumn("r", average_rank("value"))
    got = ranked.groupBy("series").agg(F.count("*").alias("n"), safe_corr("t", "r").alias("rho"))
    t = F.try_divide(F.col("rho") * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(F.greatest(1 - F.col("rho") ** 2, F.lit(0.0))))
    return got.withColumn("p", F.when(F.abs("rho") >= 1, 0.0).otherwise(t_p(t, (F.col("n") - 2).cast("double"))))


def lag_correlations(series: DataFrame) -> DataFrame:
    """Lag-1 autocorrelation twice: the correlation of neighbours, and the biased form over one mean; n_eff of the latter."""
    x = series.withColumn("before", F.lag("value").over(in_time())).withColumn("m", F.avg("value").over(by()))
    acf = F.try_divide(F.sum((F.col("value") - F.col("m")) * (F.col("before") - F.col("m"))), F.sum((F.col("value") - F.col("m")) ** 2))
    got = x.groupBy("series").agg(
        F.count("value").alias("n"), safe_corr(F.when(F.col("before").isNotNull(), F.col("value")), "before").alias("pearson_lag1"), acf.alias("acf1"),
    )
    return got.withColumn("n_eff", F.try_divide(F.col("n") * (1 - F.col("acf1")), 1 + F.col("acf1")))


def ols_trend(series: DataFrame) -> DataFrame:
    """Slope, its t value in closed form, and p."""
    got = series.groupBy("series").agg(
        F.count("value").alias("n"), F.regr_slope("value", "t").alias("slope"), F.regr_sxx("value", "t").alias("sxx"), F.regr_syy("value", "t").alias("syy"),
        F.regr_sxy("value", "t").alias("sxy"),
    )
    rest = F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")
    got = got.select("series", "n", "slope", F.try_divide("slope", F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))).alias("t_value"))
    return got.withColumn("p", t_p("t_value", (F.col("n") - 2).cast("double")))


def hac_trend(series: DataFrame, lags: int = 12) -> DataFrame:
    """Slope with Newey-West errors of Bartlett weights, no small-sample correction, and the normal tail, as grouped sums.

    With time centred, the slope's variance is the sum over lags of weighted products of (t - mean) x residual, over sxx
    squared, so a series needs one pass for the line and one for its lagged products. Values must not be null.
    """
    line = series.groupBy("series").agg(
        F.count("value").alias("n"), F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("start"),
        F.regr_sxx("value", "t").alias("sxx"), F.avg("t").alias("mt"),
    )
    x = series.join(line, "series").withColumn("s", (F.col("t") - F.col("mt")) * (F.col("value") - F.col("start") - F.col("slope") * F.col("t")))
    x = x.withColumns({f"s{k}": F.lag("s", k).over(in_time()) for k in range(1, lags + 1)})
    meat = F.sum(F.col("s") ** 2)
    for k in range(1, lags + 1):
        meat = meat + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("s") * F.col(f"s{k}")), F.lit(0.0))
    got = x.groupBy("series", "n", "slope", "sxx").agg(meat.alias("meat"))
    z = F.try_divide(F.col("slope") * F.col("sxx"), F.sqrt(F.greatest("meat", F.lit(0.0))))
    return got.select("series", "n", "slope", z.alias("z")).withColumn("p", normal_p("z"))


def chow(series: DataFrame, margin: int = 15) -> DataFrame:
    """F of a break before each t, from regression sums over the points before it and from it on."""

    def rest(w) -> Column:
        sxx, syy, sxy = (F.expr(f"{f}(value, t)").over(w) for f in ("regr_sxx", "regr_syy", "regr_sxy"))
        return syy - F.try_divide(sxy * sxy, sxx)

    everything = in_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = series.withColumn("n", F.count("*").over(everything)).withColumn("s", rest(everything))
    x = x.withColumn(
        "s1", rest(in_time().rowsBetween(Window.unboundedPreceding, -1)),
    ).withColumn("s2", rest(in_time().rowsBetween(0, Window.unboundedFollowing)))
    x = x.where((F.col("t") >= margin) & (F.col("t") < F.col("n") - margin + 1))
    return x.select("series", "t", "n", F.try_divide((F.col("s") - F.col("s1") - F.col("s2")) / 2, (F.col("s1") + F.col("s2")) / (F.col("n") - 4)).alias("f"))


def chow_anywhere(series: DataFrame, margin: int = 15, level: float = 0.001) -> DataFrame:
    """The share of break points whose Chow test is below `level`: with two numerator degrees F's tail has a closed form."""
    rest = F.col("n") - 4
    p = F.pow(1 + 2 * F.greatest("f", F.lit(0.0)) / rest, -rest / 2)
    return chow(series, margin).groupBy("series").agg(F.avg(F.when(p < level, 1.0).otherwise(0.0)).alias("share"))


def ar1_unrolled(series: DataFrame, rounds: int = 10) -> DataFrame:
    """The AR(1) trend's slope, rho, t value and p by `rounds` - 1 regressions of whitened values on whitened time, each a grouped aggregate.

    A round that finds the coefficients changed by less than 1e-4 keeps rho, as the iterated estimator does.
    """
    x = series.select("series", F.col("t").cast("double").alias("t"), "value").withColumn("bv", F.lag("value").over(in_time())).withColumn("bt", F.lag("t").over(in_time())).withColumn("n", F.count("*").over(by()))
    x = x.withColumn("rho", F.lit(0.0)).withColumn("b", F.lit(None).cast("double")).withColumn("a", F.lit(None).cast("double")).withColumn("stop", F.lit(False))
    v, t = F.col("value") - F.col("rho") * F.col("bv"), F.col("t") - F.col("rho") * F.col("bt")
    for _ in range(rounds - 1):
        x = x.withColumn("wv", v).withColumn("wt", t)
        x = x.withColumn("nb", F.expr("regr_slope(wv, wt)").over(by())).withColumn("na", F.expr("regr_intercept(wv, wt)").over(by()) / (1 - F.col("rho")))
        change = F.greatest(F.abs(F.try_divide(F.col("nb") - F.col("b"), "b")), F.abs(F.try_divide(F.col("na") - F.col("a"), "a")))
        x = x.withColumn("stop", F.col("stop") | F.coalesce(change < 1e-4, F.lit(False)))
        x = x.withColumn("u", F.col("value") - F.col("na") - F.col("nb") * F.col("t"))
        x = x.withColumn("u", F.col("u") - F.avg("u").over(by())).withColumn("bu", F.lag("u").over(in_time()))
        new = (F.sum(F.col("u") * F.col("bu")).over(by()) / (F.col("n") - 1)) / (F.sum(F.col("u") * F.col("u")).over(by()) / F.col("n"))
        x = x.withColumn("rho", F.when(F.col("stop"), F.col("rho")).otherwise(new)).withColumn("b", F.col("nb")).withColumn("a", F.col("na"))
    sums = {f: F.expr(f"{f}(wv, wt)") for f in ("regr_slope", "regr_sxx", "regr_syy", "regr_sxy")}
    got = x.withColumn("wv", v).withColumn("wt", t).groupBy("series").agg(
        F.first("rho").alias("rho"), F.first("n").alias("n"), *(c.alias(f) for f, c in sums.items()),
    )
    rest = F.greatest(F.col("regr_syy") - F.col("regr_sxy") ** 2 / F.col("regr_sxx"), F.lit(0.0))
    value = F.try_divide("regr_slope", F.sqrt(rest / (F.col("n") - 3) / F.col("regr_sxx")))
    return got.select("series", F.col("regr_slope").alias("slope"), "rho", value.alias("t_value"), t_p(value, (F.col("n") - 3).cast("double")).alias("p"))


def trend_table(series: DataFrame, edge: int = 26, year: int = 52) -> DataFrame:
    """Mean, rank trend, naive, HAC and AR(1) p values, slope a year, autocorrelation and edge means of each series."""

    def kernel(_, y: np.ndarray) -> dict:
        t = np.arange(len(y))
        r, p = stats.spearman(t, y)
        b, pv, rho = stats.glsar(stats.line(len(y)), y)
        near = float(np.corrcoef(y[:-1], y[1:])[0, 1]) if y[:-1].std() > 0 and y[1:].std() > 0 else None
        return {
            "mean": y.mean(), "spearman": r, "p_naive": p, "p_hac": stats.hac_p(y), "p_ar1": pv[1], "slope_per_year": b[1] * year, "rho_ar1": rho, "acf1": near,
            "first": y[:edge].mean(), "last": y[-edge:].mean(),
        }

    return grouped(
        series,
        "mean double, spearman double, p_naive double, p_hac double, p_ar1 double, slope_per_year double, rho_ar1 double, acf1 double, first double, last double",
        kernel,
    )


def trajectory_shapes(series: DataFrame) -> DataFrame:
    """Spline against line, and the smoothed curve's peak, trough, start and end."""

    def kernel(weeks, y: np.ndarray) -> dict:
        f, p = stats.spline_f(y)
        s = stats.lowess(y)
        return {
            "f_nonlinear": f, "p_nonlinear": p, "peak_week": weeks[s.argmax()], "peak": s.max(), "trough_week": weeks[s.argmin()], "trough": s.min(),
            "start": s[0], "end": s[-1],
        }

    return grouped(
        series, "f_nonlinear double, p_nonlinear double, peak_week date, peak double, trough_week date, trough double, start double, end double", kernel,
    )


def smoothed(series: DataFrame) -> DataFrame:
    return grouped(series, "week_date date, smooth double", lambda weeks, y: [{"week_date": w, "smooth": s} for w, s in zip(weeks, stats.lowess(y))])


def change_points(series: DataFrame, breaks: int = 3) -> DataFrame:
    return grouped(series, "t int, week_date date", lambda weeks, y: [{"t": k, "week_date": weeks[k]} for k in stats.binseg(y, breaks)])


def rank_sum(rows: DataFrame, flag: str, value: str, group: str) -> DataFrame:
    """U of flagged rows' values against the others' for each `group`, from average ranks; null values are left out."""
    x = rows.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).withColumn("r", average_rank(value, group))
    on = F.col(flag) == 1
    got = x.groupBy(group).agg(F.count_if(on).alias("n1"), F.count_if(~on).alias("n0"), F.sum(F.when(on, F.col("r"))).alias("s"))
    return got.select(group, "n1", "n0", (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


def rank_sum_test(rows: DataFrame, flag: str, value: str, group: str, least: int = 5) -> DataFrame:
    """rank_sum with means, the normal statistic (tie and continuity corrections) and the two-sided p value, for groups with
    `least` flagged rows and any others. A group whose values are all alike has a p of 1."""
    x = rows.where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    on = F.col(flag) == 1
    means = x.groupBy(group).agg(F.avg(F.when(on, F.col(value))).alias("mean1"), F.avg(F.when(~on, F.col(value))).alias("mean0"))
    ties = x.groupBy(group, value).agg(F.count("*").cast("double").alias("c")).groupBy(group).agg(F.sum(F.col("c") ** 3 - F.col("c")).alias("ties"))
    got = rank_sum(rows, flag, value, group).join(means, group).join(ties, group).where((F.col("n1") >= least) & (F.col("n0") > 0))
    n = F.col("n1") + F.col("n0")
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when(sd > 0, F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("n1") * F.col("n0") / 2) - 0.5) / sd).otherwise(0.0)
    return got.select(group, "n1", "n0", "mean1", "mean0", "u", z.alias("z")).withColumn("p", normal_p("z"))
