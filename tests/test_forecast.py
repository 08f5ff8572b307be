"""Forecast pieces: deviation/flag golden rows, schedule, trend recovery, additive model."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import forecast as FC

# Golden: (yhat, actual, deviation_pct, is_anomalous) of the six held-out months per metric.
GOLDEN = [
    (3309445.5886932933, 3501970.95, 5.817450571312277, False),
    (3567238.2249111263, 3947317.93, 10.654732908911434, False),
    (2559919.0146195684, 4290266.29, 67.5938287695238, True),
    (3735666.0616858853, 4542350.3, 21.594120700126563, True),
    (4800432.596192646, 5023370.99, 4.644131322334843, False),
    (4078352.6402993565, 2765188.27, -32.198401808701085, True),
    (3745392.7437770185, 3282659.44, -12.35473381385307, False),
    (3334917.1231148504, 3730395.91, 11.858729086369863, False),
    (2640514.3328092424, 4085629.2, 54.728537135161105, True),
    (3275336.4636496953, 4252411.14, 29.831276486982766, True),
    (4991076.745614524, 4114549.85, -17.561879736365423, True),
    (3709459.4103955105, 1284965.48, -65.35976437971067, True),
]


def test_deviation_golden(spark):
    df = spark.createDataFrame([(y, a) for y, a, _, _ in GOLDEN], "yhat double, actual double")
    out = df.select(X.deviation_pct("actual", "yhat").alias("d")) \
        .select("d", X.is_anomalous("d").alias("f")).collect()
    for r, (_, _, d, f) in zip(out, GOLDEN):
        assert r["d"] == pytest.approx(d, rel=1e-12) and r["f"] == f
    none = spark.createDataFrame([(1.0, None), (0.0, 5.0)], "yhat double, actual double")
    assert [r["f"] for r in none.select(X.is_anomalous(X.deviation_pct("actual", "yhat")).alias("f")).collect()] \
        == [False, False]


def _series(spark, n=40, keys=("a", "b")):
    rows = []
    for k in keys:
        for i in range(n):
            y = 1000.0 + 50.0 * i + (30.0 if k == "b" else 0.0)
            rows.append((k, "revenue", dt.date(2020 + (i // 12), i % 12 + 1, 1), y))
    df = spark.createDataFrame(rows, "series_key string, metric string, ds date, y double")
    return df.withColumn("t", FC.month_index("ds"))


def test_trend_backtest_recovers_line(spark):
    s = _series(spark)
    bt = FC.forecast_backtest(s)
    assert bt.count() == 2 * (40 + 6)
    err = bt.filter(F.col("actual").isNotNull()).agg(F.max(F.abs(F.col("actual") - F.col("yhat")))).first()[0]
    assert err < 1e-6
    assert bt.filter("is_anomalous").count() == 0
    assert bt.filter("held_out").count() == 12


def test_cv_schedule(spark):
    s = _series(spark, n=40, keys=("a",))
    cuts = sorted(r["cutoff"] for r in FC.cv_cutoffs(s).collect())
    t0 = 2020 * 12
    assert cuts == [t0 + 18, t0 + 21, t0 + 24, t0 + 27, t0 + 30, t0 + 33]
    cv = FC.cross_validate(s).first()
    assert cv["cv_rmse_mean"] < 1e-6 and cv["cv_horizons"] == 6


def test_additive_model_properties(spark):
    s = _series(spark, n=36)
    out = FC.fit_additive(s)
    assert out.count() == 2 * (36 + 6)
    stats = out.join(s, ["series_key", "ds"]).agg(
        F.max(F.abs(F.col("y") - F.col("yhat")) / F.col("y")).alias("rel"),
        F.min(F.col("yhat_upper") - F.col("yhat_lower")).alias("w")).first()
    assert stats["rel"] < 0.05 and stats["w"] >= 0
