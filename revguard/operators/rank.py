"""Global order without one task: percent rank (W1b), row index and split.

A window with ``ORDER BY`` and no ``PARTITION BY`` moves every row into one
task.  These helpers compute the same numbers in three distributed steps:

1. aggregate to distinct order keys (partial aggregation, so a tie held by a
   third of all rows becomes one row before any shuffle),
2. range-partition the distinct keys, materialise them with a reliable
   checkpoint (range bounds are sampled, so both passes must see the same
   partitions), and take per-partition totals,
3. broadcast the per-partition offsets (one row per partition: a bound set by
   the partition count, not by the data) and add them to running sums that were
   taken inside each sorted range partition.

The keyed result is joined back to the rows on the order key; keys with more
rows than a partition's share are salted for that join.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revguard.session import cut_lineage


MAX_RANKED_ROWS = 10_000


def _order(cols: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def prefix_sums(keyed: DataFrame, order_cols: list[str], measures: list[str], *,
                descending: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Exclusive prefix sums of ``measures`` over the total order of ``order_cols``.

    ``keyed`` must be unique on ``order_cols`` (aggregate first).  Adds
    ``before_<m>`` = sum of ``m`` over all keys strictly before this one.
    """
    spark = keyed.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _order(order_cols, descending)
    local = T.StructType([*keyed.schema.fields, *[T.StructField(f"_l_{m}", keyed.schema[m].dataType) for m in measures]])

    def running(batches):
        done = [0] * len(measures)
        for batch in batches:
            for i, m in enumerate(measures):
                column = batch.column(batch.schema.get_field_index(m))
                ends = np.cumsum(column.to_numpy(zero_copy_only=False)) + done[i]
                before = np.concatenate([[done[i]], ends[:-1]])[: len(ends)]
                batch = batch.append_column(f"_l_{m}", pa.array(before, column.type))
                done[i] = ends[-1] if len(ends) else done[i]
            yield batch

    # the running sum within a partition is taken as it is sorted: no second exchange for a window
    ranged = cut_lineage(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .mapInArrow(running, local).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[F.sum(m).alias(f"_p_{m}") for m in measures])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_p_{m}").over(before), F.lit(0))
                                      .alias(f"_o_{m}") for m in measures])
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.select(*[c for c in keyed.columns],
                      *[(F.col(f"_o_{m}") + F.col(f"_l_{m}")).alias(f"before_{m}") for m in measures])


def percent_rank(df: DataFrame, score: str, *, partition_cols: list[str] | None = None,
                 out: str = "percent_rank", num_partitions: int | None = None) -> DataFrame:
    """``PERCENT_RANK() OVER (PARTITION BY p ORDER BY score)`` without one task.

    ``(rows in the partition with a smaller score) / (rows in the partition - 1)``;
    0 for a one-row partition; NULL scores sort first, as in SQL.
    """
    keys = list(partition_cols or []) + [score]
    names = [f"_k{i}" for i in range(len(keys))]
    ranks = cut_lineage(percent_rank_keys(df, score, partition_cols=partition_cols, out=out,
                                          num_partitions=num_partitions, count_out="_cnt"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    # A key with more rows than a partition's share: at most one per partition, so these are few enough to broadcast.
    # Its rows are dealt to as many salts as it fills shares, and its rank is repeated for each.
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = ranks.agg(F.sum("_cnt").alias("n"), F.max("_cnt").alias("most")).first()
    share = max((sizes["n"] or 0) / parts, 1)
    if (sizes["most"] or 0) <= share:
        return df.join(ranks, same).drop(*names, "_cnt")
    count = F.when(F.col("_cnt") > share, F.ceil(F.col("_cnt") / share)).otherwise(1).cast("int")
    hot = ranks.where(F.col("_cnt") > share).select(*[F.col(k).alias(f"_h{k}") for k in names], count.alias("_salts"))
    same_hot = [F.col(k).eqNullSafe(F.col(f"_h{n}")) for k, n in zip(keys, names)]
    salted = df.join(F.broadcast(hot), same_hot, "left").withColumn("_salt", F.pmod(
        F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int"))
    spread = ranks.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), count - 1)))
    return salted.join(spread, same + [F.col("_salt") == F.col("_rsalt")]).drop(
        *names, *[f"_h{n}" for n in names], "_salts", "_salt", "_rsalt", "_cnt")


def percent_rank_keys(df: DataFrame, score: str, *, partition_cols: list[str] | None = None,
                      out: str = "percent_rank", num_partitions: int | None = None,
                      count_out: str | None = None) -> DataFrame:
    """The percent rank per distinct ``(partition, score)`` key, as ``_k0.._kn, out``.

    For callers that reduce the rows first (e.g. the latest score per invoice)
    and attach the rank of the whole table afterwards by key.
    """
    p = list(partition_cols or [])
    keys = p + [score]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    pre = prefix_sums(counts, keys, ["_cnt"], num_partitions=num_partitions)
    if p:
        grp = pre.groupBy(*p).agg(F.min("before__cnt").alias("_g0"), F.sum("_cnt").alias("_gn"))
        pre = pre.join(grp, p)  # one row per partition group; AQE broadcasts it when small
    else:
        grp = pre.agg(F.lit(0).cast("bigint").alias("_g0"), F.sum("_cnt").alias("_gn"))
        pre = pre.crossJoin(F.broadcast(grp))  # exactly one row
    pr = F.when(F.col("_gn") <= 1, F.lit(0.0)).otherwise(
        (F.col("before__cnt") - F.col("_g0")).cast("double") / (F.col("_gn") - 1).cast("double"))
    return pre.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], pr.alias(out),
                      *([F.col("_cnt").alias(count_out)] if count_out else []))


def percent_rank_of(rows: DataFrame, population: DataFrame, score: str, *,
                    partition_cols: list[str] | None = None, out: str = "percent_rank") -> DataFrame:
    """W1 for a bounded set of ``rows`` (a top-k or one page) against a whole ``population``.

    Same value as ``percent_rank`` computed over ``population`` and then looked
    up for ``rows``, without ranking every row.  The scores of ``rows``, sorted,
    are one array per partition; each population row is put between two of them
    and only counted, so a task sends one row per array entry at most and no row
    is copied.  Prefix sums of these counts are the ranks.  (NULL scores sort
    first.)  More than ``MAX_RANKED_ROWS`` rows are ranked with all others.
    """
    p = list(partition_cols or [])
    rows = cut_lineage(rows)
    if rows.limit(MAX_RANKED_ROWS + 1).count() > MAX_RANKED_ROWS:
        ranks = percent_rank_keys(population, score, partition_cols=p, out=out)
        cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*p, score])]
        return rows.join(ranks, cond, "left").drop(*[f"_k{i}" for i in range(len(p) + 1)])
    marks = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in p]).agg(
        F.sort_array(F.collect_set(score)).alias("_marks"))
    same = reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in p], F.lit(True))
    own = [f"_k_{c}" for c in p]
    below = F.when(F.col(score).isNull(), F.lit(0)).otherwise(
        F.size(F.filter("_marks", lambda m: m <= F.col(score))))
    counts = population.select(*p, score).join(F.broadcast(marks), same) \
        .groupBy(*own, below.alias("_b")).agg(F.count(F.lit(1)).alias("_cnt"))
    # at most one row per mark and partition from here on
    w = Window.partitionBy(*own)
    counts = cut_lineage(counts.withColumn("_n", F.sum("_cnt").over(w))
                         .withColumn("_upto", F.sum("_cnt").over(w.orderBy("_b"))))
    at = marks.select(*own, F.posexplode("_marks").alias("_i", "_k_s"))
    c = counts.select(*[F.col(k).alias(f"_c{k}") for k in own], "_b", "_n", "_upto")
    near = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_c{k}")), own, F.col("_b") <= F.col("_i"))
    lower = at.join(F.broadcast(c), near, "left").groupBy(*own, "_k_s").agg(
        F.coalesce(F.max("_upto"), F.lit(0)).alias("_lt"))
    sizes = counts.groupBy(*own).agg(F.max("_n").alias("_n"))
    sizes = sizes.select(*[F.col(k).alias(f"_z{k}") for k in own], "_n")
    back = reduce(lambda a, x: a & x, [F.col(x).eqNullSafe(F.col(f"_z_k_{x}")) for x in p], F.lit(True))
    mark = [F.col(x).eqNullSafe(F.col(f"_k_{x}")) for x in p] + [F.col(score) == F.col("_k_s")]
    pr = F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce("_lt", F.lit(0)).cast("double") / (F.col("_n") - 1).cast("double"))
    return rows.join(F.broadcast(sizes), back).join(F.broadcast(lower), mark, "left").withColumn(out, pr) \
        .drop(*own, "_k_s", "_lt", "_n", *[f"_z{k}" for k in own])


def row_index(df: DataFrame, order_cols: list[str], *, out: str = "row_index",
              num_partitions: int | None = None, count_out: str | None = None) -> DataFrame:
    """0-based position in the total order ``order_cols`` (must be unique).

    One range shuffle of the rows: after ``repartitionByRange`` and a sort within
    partitions, the rows are checkpointed; the position inside a partition is
    ``monotonically_increasing_id() - (partition_id << 33)`` (a narrow,
    JVM-side projection), and only the per-partition row counts (one row per
    partition) are aggregated and broadcast back as offsets, with the number of
    all rows in ``count_out`` if asked for.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *_order(order_cols, False)).sortWithinPartitions(*order_cols)
    ck = cut_lineage(ranged)
    pid = F.spark_partition_id()
    pos = ck.withColumn("_pid", pid).withColumn(
        "_pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33))
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            *([F.sum("_n").over(every).alias(count_out)] if count_out else []))
    return pos.join(F.broadcast(offsets), "_pid") \
        .withColumn(out, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off")


def time_split(df: DataFrame, date_col: str, id_col: str, *, train: float = 0.70,
               val: float = 0.15, num_partitions: int | None = None) -> DataFrame:
    """Positional chronological split on the total order ``(date, id)``.

    Row ``i`` (0-based) of ``n`` goes to train when ``i < floor(n*train)``,
    to val when ``i < floor(n*(train+val))``, else to test.
    """
    j = row_index(df, [date_col, id_col], out="_i", num_partitions=num_partitions, count_out="_total")
    cut1 = F.floor(F.col("_total") * F.lit(train))
    cut2 = F.floor(F.col("_total") * F.lit(train + val))
    split = F.when(F.col("_i") < cut1, "train").when(F.col("_i") < cut2, "val").otherwise("test")
    return j.withColumn("split", split).drop("_i", "_total")


def split_summary(split_df: DataFrame, date_col: str) -> DataFrame:
    """Rows and date range per split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                         F.min(date_col).alias("min_date"),
                                         F.max(date_col).alias("max_date"))


def quantile(df: DataFrame, col: str, q: float, *, num_partitions: int | None = None) -> float | None:
    """Exact ``q``-quantile with linear interpolation (numpy's default), distributed.

    Counts per distinct value -> distributed prefix sums -> the (at most two)
    values around position ``q * (n - 1)`` are the only rows returned to the driver.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    pre = prefix_sums(counts, [col], ["_cnt"], num_partitions=num_partitions)
    n = pre.agg(F.sum("_cnt")).first()[0]
    if not n:
        return None
    pos = q * (n - 1)
    lo, hi = int(pos // 1), int(-(-pos // 1))
    rows = pre.filter(((F.col("before__cnt") <= lo) & (F.col("before__cnt") + F.col("_cnt") > lo)) |
                      ((F.col("before__cnt") <= hi) & (F.col("before__cnt") + F.col("_cnt") > hi))) \
        .select(col, "before__cnt", "_cnt").collect()

    def at(k):
        for r in rows:
            if r["before__cnt"] <= k < r["before__cnt"] + r["_cnt"]:
                return float(r[col])
        raise RuntimeError("quantile position not found")

    v_lo, v_hi = at(lo), at(hi)
    return v_lo + (v_hi - v_lo) * (pos - lo)
