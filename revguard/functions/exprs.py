"""Scalar Column expressions (the F-series of the survey).

Every helper maps Columns to a Column, so it stays inside whole-stage codegen:
no Python runs per row.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    """Decimal/int -> double (ratios are computed in double on both engines)."""
    return c(x).cast("double")


def safe_ratio(a, b, eps: float = EPS) -> Column:
    """``a / (b + eps)`` in double; never raises under ANSI."""
    return dbl(a) / (dbl(b) + F.lit(eps))


def zero_if_null(x) -> Column:
    """``COALESCE(x, 0)``."""
    return F.coalesce(c(x), F.lit(0))


def num_or_zero(x) -> Column:
    """lossy numeric cast, bad or NULL -> 0."""
    return F.coalesce(c(x).cast("string").try_cast("double"), F.lit(0.0))


def finite_or_zero(x) -> Column:
    """replace NaN, +inf, -inf and NULL by 0."""
    x = dbl(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def days_since(d, as_of: _dt.date) -> Column:
    """``greatest(datediff(as_of, d), 0)``."""
    return F.greatest(F.datediff(F.lit(as_of), c(d)), F.lit(0))


def month_key(d) -> Column:
    """F8: ``yyyy-MM`` month key."""
    return F.date_format(c(d), "yyyy-MM")


def month_start(key) -> Column:
    """``yyyy-MM`` -> first day of that month."""
    return F.to_date(F.concat(c(key), F.lit("-01")))


def log1p_pos(x) -> Column:
    """``log1p(max(x, 0))``."""
    return F.log1p(F.greatest(dbl(x), F.lit(0.0)))


def flag(pred: Column) -> Column:
    """boolean -> 0/1 int; NULL counts as 0."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def banded(value, bands: list[tuple[str, float]], default: str, op: str = ">=") -> Column:
    """first band whose threshold the value passes, else ``default``.

    ``bands`` is ordered from the most severe threshold down.
    """
    v = c(value)
    expr = None
    for label, thr in bands:
        cond = {">=": v >= thr, ">": v > thr, "<": v < thr, "<=": v <= thr}[op]
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def risk_severity(prob) -> Column:
    """probability -> critical / high / medium / low."""
    return banded(prob, [("critical", 0.80), ("high", 0.60), ("medium", 0.40)], "low")


def money_text(x) -> Column:
    """``$1,234.56``."""
    return F.concat(F.lit("$"), F.format_number(dbl(x), 2))


def pct_text(r, places: int = 1) -> Column:
    """ratio -> ``12.3%``."""
    return F.format_string(f"%.{places}f%%", dbl(r) * 100)


def signed_text(v, places: int = 3) -> Column:
    """``+0.123`` / ``-0.456``."""
    return F.format_string(f"%+.{places}f", dbl(v))


def round_money(x, places: int = 2) -> Column:
    """round a DECIMAL half-up (identical in Spark and DuckDB)."""
    return F.round(c(x), places)


def deviation_pct(actual, forecast) -> Column:
    """``(actual - yhat) / |yhat| * 100``; NULL when no actual or yhat = 0."""
    a, y = dbl(actual), dbl(forecast)
    return F.when(a.isNotNull() & (y != 0), (a - y) / F.abs(y) * 100)


def is_anomalous(dev, threshold_pct: float = 15.0) -> Column:
    """``|deviation| > threshold``; NULL deviation -> false."""
    return F.coalesce(F.abs(c(dev)) > threshold_pct, F.lit(False))


def code_map(x, mapping: dict, default) -> Column:
    """F16: category -> code with default."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(m[c(x)], F.lit(default))


def any_flag(*cols) -> Column:
    """OR of 0/1 flags as 0/1."""
    return F.greatest(*[c(x) for x in cols]) if len(cols) > 1 else c(cols[0])


def pct_guarded(a, b, places: int = 2) -> Column:
    """F32: ``round(a / b * 100, places)``, 0 when b is 0 or NULL (decimal rounding)."""
    r = F.try_divide(c(a).cast("decimal(38,6)") * F.lit(Decimal(100)), c(b).cast("decimal(38,6)"))
    return F.coalesce(F.round(r, places).cast("double"), F.lit(0.0))


def minmax_norm(x, lo, hi, eps: float = 1e-9) -> Column:
    """``(x - lo) / (hi - lo + eps)``."""
    return (dbl(x) - dbl(lo)) / (dbl(hi) - dbl(lo) + F.lit(eps))


def blend(a, b, wa: float = 0.7, wb: float = 0.3) -> Column:
    """weighted blend of two probabilities."""
    return F.lit(wa) * dbl(a) + F.lit(wb) * dbl(b)


def top_abs_names(names: list[str], k: int) -> Column:
    """names of the k largest |value| among ``names``, list order on ties.

    Builds ``array(struct(-|v|, position, name))``, sorts it natively and keeps
    the names of the first k entries.
    """
    arr = F.array(*[
        F.struct(F.abs(finite_or_zero(n)).__neg__().alias("k"), F.lit(i).alias("i"), F.lit(n).alias("n"))
        for i, n in enumerate(names)
    ])
    return F.transform(F.slice(F.array_sort(arr), 1, k), lambda s: s["n"])


def underscore_label(x) -> Column:
    """F27 fallback: ``a_b_c`` -> ``a b c``."""
    return F.regexp_replace(c(x), "_", " ")


def contains_any(cols: list[str], term: str) -> Column:
    """Case-insensitive substring search over several columns, OR-ed."""
    t = term.lower()
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.lower(c(x).cast("string")).contains(t), F.lit(False)) for x in cols])


def exact_filters(filters: dict) -> Column:
    """Conjunction of ``col == value``."""
    conds = [c(k) == F.lit(v) for k, v in filters.items()]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def json_field(col, key: str, default=None) -> Column:
    """read ``key`` from a JSON object string, with a default when absent."""
    v = F.get_json_object(c(col), f"$.{key}")
    return F.coalesce(v, F.lit(default)) if default is not None else v


def left_lookup(df, dim, key: str, unique: str):
    """Left join of a dimension on a nullable key whose NULLs are no hot key.

    A NULL key finds nothing, yet all NULLs hash to one partition.  They join on
    ``-1 - unique`` instead, a value no (non-negative) key has, so these rows
    spread like any other.
    """
    spread = F.coalesce(F.col(key).cast("bigint"), F.lit(-1).cast("bigint") - F.col(unique).cast("bigint"))
    right = dim.select(F.col(key).cast("bigint").alias("_lookup"), *[c for c in dim.columns if c != key])
    return df.withColumn("_spread", spread).join(right, F.col("_spread") == F.col("_lookup"), "left") \
        .drop("_spread", "_lookup")
