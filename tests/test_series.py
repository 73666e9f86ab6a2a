import csv
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import inference as I
from tidemark.operators import series as S
from tidemark.sources import readers, sinks
from tidemark.streaming.weekly import weekly_means

# The published weekly means in fixtures/weekly.csv, and the published statistics that tests below ask for.
ROWS = list(csv.DictReader((Path(__file__).parent / "fixtures/weekly.csv").open()))
FEAR = np.array([float(r["fear"]) for r in ROWS])
JOY = np.array([float(r["joy"]) for r in ROWS])


@pytest.fixture(scope="module")
def weekly(spark):
    wide = spark.createDataFrame([(r["week_date"], float(r["joy"]), float(r["fear"])) for r in ROWS], "d string, joy double, fear double").select(F.col("d").cast("date").alias("week_date"), "joy", "fear")
    return S.to_long(wide, ["joy", "fear"]).cache()


def test_tails():
    assert math.isclose(stats.t_tail(2.0, 10), 0.07338803477074037, rel_tol=1e-10)
    assert math.isclose(stats.f_tail(3.0, 2, 10), 0.09536743164062499, rel_tol=1e-9)
    assert math.isclose(stats.normal_tail(1.96), 0.04999579029644087, rel_tol=1e-10)


def test_trends_match_published_values(weekly):
    got = {r["series"]: r for r in I.trend_table(weekly).collect()}["fear"]
    want = {"mean": 0.018926259795117292, "spearman": -0.7318772619984264, "p_naive": 4.65953121799226e-22, "p_hac": 1.2270639752612279e-18, "p_ar1": 7.43809495278645e-05, "slope_per_year": -0.0057545800471874246, "acf1": 0.8532477776900075, "first": 0.02549718706138313, "last": 0.013336246642081986}
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-6), k


def test_unrolled_ar1_equals_the_kernel(weekly):
    got = {r["series"]: r for r in I.ar1_unrolled(weekly).collect()}
    for name, y in (("joy", JOY), ("fear", FEAR)):
        b, _, rho = stats.glsar(stats.line(len(y)), y)
        assert math.isclose(got[name]["slope"], b[1], rel_tol=1e-8) and math.isclose(got[name]["rho"], rho, rel_tol=1e-8)


def test_hac_in_sums_equals_the_kernel(weekly):
    got = {r["series"]: r["p"] for r in I.hac_trend(weekly).collect()}
    assert all(math.isclose(got[n], stats.hac_p(y), rel_tol=1e-6) for n, y in (("joy", JOY), ("fear", FEAR)))
    t = {r["series"]: r for r in I.trend_table(weekly).collect()}
    p, rho = ({r["series"]: r["p"] for r in f(weekly).collect()} for f in (I.ar1_unrolled, I.spearman_trend))
    assert all(math.isclose(p[n], t[n]["p_ar1"], rel_tol=1e-6) and math.isclose(rho[n], t[n]["p_naive"], rel_tol=1e-6) for n in ("joy", "fear"))


def test_lowess_equals_weighted_lines():
    """Local lines by least squares with weights, and bisquare weights of the residuals, in plain loops."""
    rng = np.random.default_rng(2)
    y = np.sin(np.arange(40) / 6) + rng.normal(0, 0.3, 40)
    y[11] = 9
    k, trust = int(0.2 * 40), np.ones(40)
    for turn in range(4):
        fit = []
        for i in range(40):
            near = sorted(range(40), key=lambda j: (abs(j - i), j))[:k]
            h = max(abs(j - i) for j in near)
            w = np.array([(1 if abs(j - i) <= 0.001 * h else 0 if abs(j - i) >= 0.999 * h else (1 - (abs(j - i) / h) ** 3) ** 3) * trust[j] for j in near])
            X = np.column_stack([np.ones(k), np.array(near) - i])
            fit.append(np.linalg.lstsq(X * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0][0])
        fit = np.array(fit)
        r = np.abs(y - fit)
        s = 6 * np.median(r)
        trust = np.where(r <= 0.001 * s, 1, np.where(r >= 0.999 * s, 0, (1 - (r / s) ** 2) ** 2))
    assert np.allclose(stats.lowess(y), fit, atol=1e-8)


def test_breaks_equal_the_search_of_all_splits():
    rng = np.random.default_rng(6)
    for _ in range(5):
        y = np.concatenate([rng.normal(0, 0.1, 20), rng.normal(3, 0.1, 25), np.arange(15) / 4])
        z = (y - y.mean()) / y.std(ddof=1)
        rest = lambda a, b: float(np.polyfit(np.arange(b - a), z[a:b], 1, full=True)[1].sum()) if b - a > 2 else 0.0
        best = min((k for k in range(5, 60, 5) if k >= 2 and 60 - k >= 2), key=lambda k: rest(0, k) + rest(k, 60))
        assert stats.binseg(y, 1) == [best]


def test_shapes_match_published_values(weekly):
    got = {r["series"]: r for r in I.trajectory_shapes(weekly).collect()}
    assert math.isclose(got["joy"]["f_nonlinear"], 0.9383414532269964, rel_tol=1e-8) and math.isclose(got["joy"]["p_nonlinear"], 0.3941517449702145, rel_tol=1e-8)
    assert str(got["joy"]["peak_week"]) == "2024-12-12" and math.isclose(got["joy"]["peak"], 0.0538502118723471, rel_tol=1e-8)
    assert str(got["fear"]["trough_week"]) == "2025-08-14" and math.isclose(got["fear"]["start"], 0.0269491837718542, rel_tol=1e-8)


def test_chow_and_peak(weekly):
    share = {r["series"]: r["share"] for r in I.chow_anywhere(weekly).collect()}
    assert math.isclose(share["fear"], 0.11578947368421053) and math.isclose(share["joy"], 0.9263157894736842)
    top = {r["series"]: r for r in S.peak(weekly).collect()}["joy"]
    assert math.isclose(top["peak_z"], 2.833236420755006, rel_tol=1e-9) and str(top["peak_week"]) == "2024-10-31"


def test_events(spark, weekly):
    events = spark.createDataFrame([("a", "2023-10-07"), ("b", "2024-04-13"), ("c", "2024-06-08"), ("z", "2030-01-01")], "code string, date string").withColumn("date", F.col("date").cast("date"))
    got = {(r["series"], r["code"]): r for r in S.event_windows(weekly, events).collect()}
    a, b = got["fear", "a"], got["fear", "b"]
    assert a["change"] is None and a["p_perm"] is None and math.isclose(a["level_z"], 1.441762227184879, rel_tol=1e-9)
    assert str(b["week"]) == "2024-04-18" and math.isclose(b["change"], -0.0028768288605799, rel_tol=1e-9) and math.isclose(b["p_perm"], 37 / 119)
    assert ("fear", "z") not in got


def test_weighted_means_and_coverage(spark):
    charts = spark.createDataFrame([("2024-01-04", "a", 3), ("2024-01-04", "b", 1), ("2024-01-11", "c", 5), ("2024-01-18", "a", 2), ("2024-01-18", "n", 2)], "week_date string, uri string, streams long")
    scores = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("n", None)], "uri string, joy double")
    got = {r["week_date"]: r for r in S.weighted_means(charts, scores, ["joy"]).collect()}
    assert got["2024-01-04"]["joy"] == 0.75 and got["2024-01-04"]["stream_coverage"] == 1
    assert "2024-01-11" not in got  # no scored song
    assert got["2024-01-18"]["joy"] == 0.5  # a null score keeps its weight below


def test_contributions_sum_to_the_change(spark):
    charts = spark.createDataFrame([("2024-01-04", u, s) for u, s in (("a", 3), ("b", 1))] + [("2024-01-11", u, s) for u, s in (("a", 1), ("c", 3))], "week_date string, uri string, streams long").withColumn("week_date", F.col("week_date").cast("date"))
    scores = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.5)], "uri string, joy double")
    d = S.drivers(charts, scores, "joy", ["2024-01-04"], ["2024-01-11"], top=9).collect()
    assert math.isclose(sum(r["contribution"] for r in d), (0.25 + 0.375) - 0.75) and math.isclose(sum(r["share"] for r in d), 1)


def test_flat_series_give_null_not_errors(spark):
    x = spark.createDataFrame([("flat", t, None, 1.0) for t in range(30)], "series string, t int, week_date date, value double")
    assert I.spearman_trend(x).first()["rho"] is None and I.lag_correlations(x).first()["acf1"] is None
    assert S.peak(x).count() == 0
    assert I.spearman_trend(x.limit(0)).count() == 0


def test_breaks_rank_sum_placebo():
    y = np.concatenate([np.zeros(40), np.arange(40) * 1.0, np.full(40, 5.0)])
    assert set(stats.binseg(y, 2)) == {40, 80}
    u, p = stats.mann_whitney(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert u == 0 and 0.05 < p < 0.1
    assert stats.placebo_share(2000) == 0.338  # the published share


def test_cumulative_share(spark):
    rows = spark.createDataFrame([(f"u{i}", i % 7 + 1) for i in range(50)], "uri string, streams long")
    got = sorted(S.cumulative_share(rows, "streams", "uri").collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 51)) and math.isclose(got[-1]["cum_share"], 1.0)
    assert all(a["streams"] >= b["streams"] for a, b in zip(got, got[1:]))


def test_cumulative_share_of_more_rows_than_a_sample_has(spark):
    """Rows with a column that the sums do not need, some alike in weight and key, some without a weight."""
    rows = spark.range(60_000).selectExpr("concat('u', id % 50000) AS uri", "IF(id % 5000 = 7, NULL, id * 7919 % 1000 + 1) AS streams", "id AS reason").where("uri <> 'u3' OR reason < 50000")
    got = S.cumulative_share(rows, "streams", "uri").collect()
    want = sorted((r["streams"] is None, -(r["streams"] or 0), r["uri"]) for r in rows.collect())
    total, run, last = -sum(w[1] for w in want), 0, {}
    for w in want:
        run -= w[1]
        last[w] = run / total
    assert sorted(r["place"] for r in got) == list(range(1, len(want) + 1))
    assert [(r["streams"], r["uri"]) for r in sorted(got, key=lambda r: r["place"])] == [(-w[1] or None, w[2]) for w in want]
    assert all(math.isclose(r["cum_share"], last[r["streams"] is None, -(r["streams"] or 0), r["uri"]]) for r in got)


def test_the_first_page_of_a_url_is_cached(spark):
    """Of pages of one url the first by the order that has html counts, in whatever order the rows come."""
    rows = [(i, f"u{i % 40}", None if i < 80 else f"page {i}") for i in range(4000)]
    pages = spark.createDataFrame(rows, "n long, url string, html string").orderBy(F.desc("n")).repartition(7)
    got = readers.cached_pages(spark.createDataFrame([(f"u{i}",) for i in range(41)], "url string"), pages, "n").collect()
    assert {r["url"]: r["html"] for r in got} == {f"u{i}": f"page {80 + i}" for i in range(40)} | {"u40": None}
    assert [r["url"] for r in got if r["status"] == "not_cached"] == ["u40"]


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text('﻿spotify_uri,track_name,artist_names,action,shironet_url,note,pct_streams\nu1,"a ""q"" b",x,none,,,1.5\nu1,b,x,url,,,\n', encoding="utf-8")
    got = readers.first_csv(spark, [str(tmp_path / "absent.csv"), str(p)], readers.OVERRIDES)
    assert got.first()["spotify_uri"] == "u1" and got.first()["track_name"] == 'a "q" b' and got.count() == 2
    assert readers.csv(spark, str(tmp_path / "absent.csv"), readers.WEEKLY, optional=True).count() == 0
    assert readers.first_wins(got, ["spotify_uri"], F.col("track_name")).count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("one\ntwo")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "t")).collect()] == [("x.txt", "one\ntwo")]
    sinks.write_csv(got, str(tmp_path / "out"))
    assert readers.csv(spark, str(tmp_path / "out"), readers.OVERRIDES).count() == 2
    sinks.write_json_lines(got, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert '"u1"' in sinks.json_report(got)


def test_growing_tables_and_reports(spark, tmp_path):
    path, rows = str(tmp_path / "cache"), [("u1", "a"), ("u2", "b"), ("u2", "b")]
    df = lambda x: spark.createDataFrame(x, "url string, html string")
    assert sinks.append_pages(df(rows[:1]), path) == 1 and sinks.append_pages(df(rows), path) == 1 and sinks.append_pages(df(rows), path) == 0
    got = spark.read.parquet(path)
    assert sorted((r["url"], r["html"]) for r in got.collect()) == [("u1", "a"), ("u2", "b")] and "key" in got.columns
    assert sinks.append_pages(df([]), str(tmp_path / "none")) == 0 and spark.read.parquet(str(tmp_path / "none")).count() == 0
    shown = sinks.printed(spark.createDataFrame([("שם", 1.23456, None), ("b", 2.0, 3)], "name string, x double, n int"))
    assert shown.split("\n") == ["name     x n", "  שם 1.235  ", "   b 2.000 3"]
    with pytest.raises(ValueError):
        sinks.json_report(spark.range(sinks.REPORT_ROWS + 1))


def test_drivers_of_an_event(spark):
    """Shares of two songs before and after: each song's move, and the share of the whole that the top one has."""
    week = lambda k: f"2024-01-{4 + 7 * k:02d}"
    charts = spark.createDataFrame([(week(k), u, s) for k in range(2) for u, s in ((("a", 3), ("b", 1)) if k == 0 else (("a", 1), ("b", 3)))], "week_date string, uri string, streams long").withColumn("week_date", F.col("week_date").cast("date"))
    values = spark.createDataFrame([("a", "joy", 1.0), ("b", "joy", 0.2)], "uri string, series string, value double")
    series = spark.createDataFrame([("joy", k, week(k), 0.0) for k in range(2)], "series string, t int, week_date string, value double").withColumn("week_date", F.col("week_date").cast("date"))
    hits = S.first_weeks(series, spark.createDataFrame([("e", "2024-01-05"), ("late", "2025-01-01")], "code string, date string").withColumn("date", F.col("date").cast("date")))
    assert [tuple(r) for r in hits.collect()] == [("joy", "e", 1)]
    got = S.event_drivers(charts, values, S.weeks_around(series, hits, k=1), k=1).collect()
    assert [(r["uri"], r["place"], round(r["contribution"], 9)) for r in got] == [("a", 1, -0.5), ("b", 2, 0.1)] and math.isclose(got[0]["share"], 1.25)


def test_weekly_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([("2024-01-04 10:00:00", 1.0, 2.0), ("2024-01-10 10:00:00", 4.0, 1.0), ("2024-01-11 01:00:00", 5.0, 1.0)], "ts string, v double, w double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(src))
    stream = weekly_means(spark.readStream.schema(rows.schema).parquet(str(src)), "v", "w")
    q = stream.writeStream.format("memory").queryName("weekly_means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {str(r["week_start"])[:10]: r["mean"] for r in spark.table("weekly_means").collect()}
    assert got == {"2024-01-04": 2.0, "2024-01-11": 5.0}
