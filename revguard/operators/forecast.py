"""Monthly forecasting T1-T8: many series in one job.

A series is ``(metric, extra keys)`` over the monthly revenue mart; the two
measures (revenue = invoiced, collections = collected) are unpivoted into
rows, so every fit, back-test and cross-validation step is a grouped operator
over ``series_key`` (and ``cutoff`` for CV) instead of a driver loop.  Every
group holds one row per month, so group sizes are bounded by the calendar, not
by the data volume.

Two fitters:

* ``fit_trend`` (T2a): least-squares line on the month index per series
  (``regr_slope`` / ``regr_intercept``), 90 % band = yhat +- 1.645 sigma of the
  training residuals.  Pure SQL aggregates, checked by the oracle.
* ``fit_additive`` (T2b): ``applyInPandas`` per series, a piecewise-linear trend
  with sparse slope changes (``changepoints``) times (1 + yearly Fourier season),
  fitted in the executors; its band widens with the distance into the future.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import changepoints

# Series measures, anomaly cut-off, horizon / back-test length and
# the rolling-origin schedule in months (~548 / 91 / 182 days).
METRICS = {"total_invoiced": "revenue", "total_collected": "collections"}
ANOMALY_THRESHOLD_PCT = 15.0
HORIZON_MONTHS = 6
BACKTEST_MONTHS = 6
CV_INITIAL, CV_PERIOD, CV_HORIZON = 18, 3, 6
Z90 = 1.645


def month_index(ds) -> "F.Column":
    return F.year(ds) * 12 + F.month(ds) - 1


def series_frame(monthly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """T1 + T8: ``(series_key, metric, keys..., ds, t, y)`` from the monthly mart."""
    keys = list(keys or [])
    arr = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(k).alias("y")) for k, v in METRICS.items()])
    df = monthly.select(*keys, "period_month", F.explode(arr).alias("m"))
    sk = F.concat_ws("|", F.col("m.metric"), *[F.col(k).cast("string") for k in keys])
    return df.select(sk.alias("series_key"), F.col("m.metric").alias("metric"), *keys,
                     X.month_start("period_month").alias("ds"),
                     F.coalesce(X.dbl("m.y"), F.lit(0.0)).alias("y")) \
        .withColumn("t", month_index("ds"))


def backtest_split(series: DataFrame, n: int = BACKTEST_MONTHS) -> DataFrame:
    """Mark the last ``n`` months of every series as held out."""
    w = Window.partitionBy("series_key").orderBy(F.col("ds").desc())
    return series.withColumn("held_out", F.row_number().over(w) <= n)


def fit_trend(train: DataFrame, by: list[str]) -> DataFrame:
    """Slope, intercept and residual sigma per group (two aggregate passes)."""
    fit = train.groupBy(*by).agg(F.regr_slope("y", "t").alias("slope"),
                                 F.regr_intercept("y", "t").alias("intercept"),
                                 F.count(F.lit(1)).alias("n_train"))
    res = train.join(fit, by).select(*by, (F.col("y") - (F.col("intercept") + F.col("slope") * F.col("t")))
                                     .alias("r"))
    sig = res.groupBy(*by).agg(F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sigma"))
    return fit.join(sig, by)


def future_frame(series: DataFrame, horizon: int = HORIZON_MONTHS) -> DataFrame:
    """Every month from the first one to ``horizon`` months after the last, per series."""
    span = series.groupBy("series_key", "metric").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    ds = F.explode(F.sequence("first", F.add_months("last", horizon), F.expr("INTERVAL 1 MONTH")))
    return span.select("series_key", "metric", ds.alias("ds")).withColumn("t", month_index("ds"))


def forecast_backtest(series: DataFrame, *, horizon: int = HORIZON_MONTHS,
                      backtest: int = BACKTEST_MONTHS,
                      threshold_pct: float = ANOMALY_THRESHOLD_PCT) -> DataFrame:
    """T4 with T2a: fit on all but the last ``backtest`` months, predict history + horizon,
    join actuals, deviation %, anomaly flag."""
    s = backtest_split(series, backtest)
    fit = fit_trend(s.filter(~F.col("held_out")), ["series_key"])
    fut = future_frame(series, horizon)
    yhat = F.col("intercept") + F.col("slope") * F.col("t")
    pred = fut.join(fit, "series_key").select(
        "series_key", "metric", "ds", yhat.alias("yhat"),
        (yhat - Z90 * F.col("sigma")).alias("yhat_lower"), (yhat + Z90 * F.col("sigma")).alias("yhat_upper"))
    act = s.select("series_key", "ds", F.col("y").alias("actual"), "held_out")
    out = pred.join(act, ["series_key", "ds"], "left")  # J9
    dev = X.deviation_pct("actual", "yhat")
    return out.select("*", X.month_key("ds").alias("period_month"), dev.alias("deviation_pct"),
                      X.is_anomalous(dev, threshold_pct).alias("is_anomalous"))


def cv_cutoffs(series: DataFrame, *, initial: int = CV_INITIAL, period: int = CV_PERIOD,
               horizon: int = CV_HORIZON) -> DataFrame:
    """T5 schedule: cutoffs stepping back ``period`` months from ``last - horizon``
    while at least ``initial`` months of history remain."""
    span = series.groupBy("series_key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    ok = (F.col("t1") - horizon) >= (F.col("t0") + initial)
    cut = F.explode(F.sequence(F.col("t1") - horizon, F.col("t0") + initial, F.lit(-period)))
    return span.filter(ok).select("series_key", cut.alias("cutoff"))


def cross_validate(series: DataFrame, *, initial: int = CV_INITIAL, period: int = CV_PERIOD,
                   horizon: int = CV_HORIZON) -> DataFrame:
    """T5: rolling-origin CV of T2a; RMSE / MAE / MAPE per series, averaged over horizon steps."""
    cuts = cv_cutoffs(series, initial=initial, period=period, horizon=horizon)
    pts = series.join(cuts, "series_key")  # months x cutoffs per series: calendar-bounded
    fit = fit_trend(pts.filter(F.col("t") <= F.col("cutoff")), ["series_key", "cutoff"])
    ev = pts.filter((F.col("t") > F.col("cutoff")) & (F.col("t") <= F.col("cutoff") + horizon)) \
        .join(fit, ["series_key", "cutoff"]) \
        .select("series_key", (F.col("t") - F.col("cutoff")).alias("h"), "y",
                (F.col("intercept") + F.col("slope") * F.col("t")).alias("yhat"))
    return _cv_errors(ev)


def _cv_errors(ev: DataFrame) -> DataFrame:
    """RMSE / MAE / MAPE per series of (series_key, h, y, yhat), averaged over horizon steps."""
    e = F.col("y") - F.col("yhat")
    per_h = ev.groupBy("series_key", "h").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.col("y") != 0, F.abs(e) / F.abs(F.col("y")))).alias("mape"))
    return per_h.groupBy("series_key").agg(F.avg("rmse").alias("cv_rmse_mean"),
                                           F.avg("mae").alias("cv_mae_mean"),
                                           F.avg("mape").alias("cv_mape_mean"),
                                           F.count(F.lit(1)).alias("cv_horizons"))


def summary(bt: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """Per series: months with actuals, anomalous months, in-sample and held-out errors."""
    err = F.abs(F.col("actual") - F.col("yhat"))
    ape = F.when(F.col("actual") != 0, err / F.abs(F.col("actual")))
    s = bt.groupBy("series_key", "metric").agg(
        F.count("actual").alias("training_months"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_anomalous"), F.col("period_month")))),
                     ",").alias("anomalous_months"),
        F.count_if(F.col("is_anomalous")).alias("n_anomalous"),
        F.avg(err).alias("backtest_mae"), F.avg(ape).alias("backtest_mape"),
        F.avg(F.when(F.col("held_out"), err)).alias("heldout_mae"),
        F.avg(F.when(F.col("held_out"), ape)).alias("heldout_mape"))
    return s.join(cv, "series_key", "left") if cv is not None else s


def forecast_rows(bt: DataFrame, *, model_name: str = "trend", model_version: str = "v1",
                  threshold_pct: float = ANOMALY_THRESHOLD_PCT) -> DataFrame:
    """T6 record shape: money rounded to cents as decimals, unique by model, version, metric, series and month."""
    money = lambda c: F.round(F.col(c).cast("decimal(20,4)"), 2).cast("decimal(16,2)")
    return bt.select(F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
                     "metric", "series_key", "period_month", money("yhat").alias("forecasted_value"),
                     money("actual").alias("actual_value"), money("yhat_lower").alias("lower_bound"),
                     money("yhat_upper").alias("upper_bound"), "deviation_pct", "is_anomalous",
                     F.lit(threshold_pct).alias("anomaly_threshold_pct"))


# ---------------------------------------------------------------------------- T2b
_ADD_SCHEMA = ("series_key string, metric string, ds date, yhat double, yhat_lower double, "
               "yhat_upper double")


def _additive_fit(horizon: int, backtest: int, n_changepoints: int, fourier: int, ridge: float, tau: float):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t_all = pdf["t"].to_numpy(dtype=float)
        y_all = pdf["y"].to_numpy(dtype=float)
        n_train = max(len(pdf) - backtest, 2)
        t_tr, y_tr = t_all[:n_train], y_all[:n_train]
        t_out = np.arange(t_all[0], t_all[-1] + horizon + 1, dtype=float)

        def season_x(t):
            m = np.mod(t, 12.0)
            cols = []
            for k in range(1, fourier + 1):
                cols += [np.sin(2 * np.pi * k * m / 12), np.cos(2 * np.pi * k * m / 12)]
            return np.column_stack(cols)

        def ridge_fit(a, b):
            reg = ridge * np.eye(a.shape[1])
            reg[0, 0] = 0.0
            return np.linalg.solve(a.T @ a + reg, a.T @ b)

        scale = max(np.abs(y_tr).mean(), 1.0)
        trend = changepoints.fit(t_tr, y_tr / scale, n_changepoints, tau)
        tr_tr = trend.value(t_tr)
        xs = season_x(t_tr) * tr_tr[:, None]                           # multiplicative season
        bs = ridge_fit(np.column_stack([np.ones(len(t_tr)), xs]), y_tr / scale - tr_tr)
        tr_out = trend.value(t_out)
        yhat = (tr_out + np.column_stack([np.ones(len(t_out)), season_x(t_out) * tr_out[:, None]]) @ bs) * scale
        fit_tr = (tr_tr + np.column_stack([np.ones(len(t_tr)), xs]) @ bs) * scale
        sigma = float(np.std(y_tr - fit_tr, ddof=1)) if len(t_tr) > 1 else 0.0
        half = Z90 * np.sqrt(sigma ** 2 + (scale * trend.future_sd(t_out)) ** 2)
        years, months = np.divmod(t_out.astype(int), 12)
        ds = pd.to_datetime({"year": years, "month": months + 1, "day": 1}).dt.date
        return pd.DataFrame({"series_key": pdf["series_key"].iloc[0], "metric": pdf["metric"].iloc[0],
                             "ds": ds, "yhat": yhat, "yhat_lower": yhat - half, "yhat_upper": yhat + half})
    return fit


def fit_additive(series: DataFrame, *, horizon: int = HORIZON_MONTHS, backtest: int = BACKTEST_MONTHS,
                 n_changepoints: int = 12, fourier: int = 3, ridge: float = 1e-3, tau: float = 0.05) -> DataFrame:
    """Per-series trend x season model fitted in ``applyInPandas`` (one group = one series)."""
    fn = _additive_fit(horizon, backtest, n_changepoints, fourier, ridge, tau)
    return series.select("series_key", "metric", "t", "y").groupBy("series_key") \
        .applyInPandas(fn, schema=_ADD_SCHEMA)


def additive_backtest(series: DataFrame, **kw) -> DataFrame:
    """T4 with T2b."""
    thr = kw.pop("threshold_pct", ANOMALY_THRESHOLD_PCT)
    backtest = kw.get("backtest", BACKTEST_MONTHS)
    pred = fit_additive(series, **kw)
    act = backtest_split(series, backtest).select("series_key", "ds", F.col("y").alias("actual"), "held_out")
    out = pred.join(act, ["series_key", "ds"], "left")
    dev = X.deviation_pct("actual", "yhat")
    return out.select("*", X.month_key("ds").alias("period_month"), dev.alias("deviation_pct"),
                      X.is_anomalous(dev, thr).alias("is_anomalous"))


def cross_validate_additive(series: DataFrame, *, initial: int = CV_INITIAL, period: int = CV_PERIOD,
                            horizon: int = CV_HORIZON, **kw) -> DataFrame:
    """T5 with T2b: one additive fit per series and cutoff (each group is calendar-bounded)."""
    cuts = cv_cutoffs(series, initial=initial, period=period, horizon=horizon)
    pts = series.join(cuts, "series_key")
    group = F.concat_ws("@", "series_key", F.col("cutoff").cast("string"))
    past = pts.filter(F.col("t") <= F.col("cutoff")).select(group.alias("series_key"), "metric", "t", "y")
    pred = fit_additive(past, horizon=horizon, backtest=0, **kw).select(F.col("series_key").alias("_g"), "ds", "yhat")
    ahead = pts.filter((F.col("t") > F.col("cutoff")) & (F.col("t") <= F.col("cutoff") + horizon)) \
        .select(group.alias("_g"), "series_key", "ds", (F.col("t") - F.col("cutoff")).alias("h"), "y")
    return _cv_errors(ahead.join(pred, ["_g", "ds"]))
