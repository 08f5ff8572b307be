"""Operator 2: quality rules by robust multivariate outliers, with DataFrame functions only.

Each document gets a vector of transformed statistics: log mean word length, log
symbols per word, share of lines that are copies of an earlier line and share of
words in repeated five-word windows.  Per language and source a deterministic
minimum-covariance-determinant estimate says where its bulk lies: start from
coordinate-wise medians and quartile ranges, then repeat concentration steps
(keep the ``KEEP`` share of documents nearest by Mahalanobis distance, take
their mean and covariance) until a group's chosen documents stay the same, at
most ``STEPS`` times, correct for consistency and reweight once.  ``KEEP`` is one
half, so outliers may be nearly half of a group before they enter its estimate.
A document goes if its squared Mahalanobis distance is over the ``TAIL`` quantile
of chi-square with as many degrees as statistics.

Every step is one aggregate per group of the vectors alone: counts, sums and
cross products per distance bin, pre-aggregated before the shuffle, so a source
that holds a third of all documents is a handful of rows by then.  Groups under
``MIN_GROUP`` documents are too few for four dimensions and use their language's
estimate, languages under it that of the whole corpus.  ``FLOORS`` keep a
statistic that is constant in the bulk from rejecting every other value.

Defined cases: a null text has no words; null language and source are a group of
their own; documents that the base rules fail take no part in the estimates
and are not kept; ties in distance are kept or left out of the concentration
together; repeated rows count each; an empty table gives an empty result; other
columns are ignored (``kept_rows`` returns them as they are).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revguard.llm.common import bounded_broadcast, cut_lineage, let, pick, words_of

WINDOW_WORDS = 5
KEEP = 0.5
STEPS = 12
MIN_GROUP = 40
TAIL = 1e-6
# Least standard deviation of each statistic.
FLOORS = {"x_length": 0.15, "x_symbols": 0.05, "x_lines": 0.10, "x_repeats": 0.05}
BINS_PER_DOUBLING = 16
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MAX_BROADCAST_GROUPS = 100_000
# Means of one and the same set of documents differ by rounding only (in floors).
SAME = 1e-9
XS = list(FLOORS)


# --- statistics ----------------------------------------------------------------------------------

def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW_WORDS`` words found twice or more, the first find included."""
    n = WINDOW_WORDS

    def covered(starts: Column) -> Column:
        # sorted starts: each adds what the next one does not cover
        nothing = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-n).cast("long").alias("last"))
        return F.aggregate(
            starts, nothing,
            lambda a, s: F.struct((a["total"] + F.least(F.lit(n).cast("long"), s - a["last"])).alias("total"),
                                  s.alias("last")),
            lambda a: a["total"])

    def doubled(windows: Column) -> Column:
        # equal windows are neighbours once sorted
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return let(placed, lambda p: covered(F.sort_array(F.transform(
            F.filter(F.transform(p, lambda x, i: F.struct(
                x["i"].alias("i"),
                (F.get(p, i - 1)["h"].eqNullSafe(x["h"]) | F.get(p, i + 1)["h"].eqNullSafe(x["h"]))
                .alias("again"))),
                lambda x: x["again"]), lambda x: x["i"]))))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)),
                              lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(n)]))
        return F.when(F.size(w) < n, F.lit(0).cast("long")).otherwise(let(windows, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(doubled(h))))

    return counted(words)


def with_statistics(docs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """``docs`` and one struct column ``names['stats']`` of its statistics, transformed values and base verdict."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    of_words = let(words_of(docs["text"]), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")

    def all_of(w: Column, x: Column, s: Column) -> Column:
        n = w["n_words"]
        some, n_lines = F.greatest(n, F.lit(1)), F.greatest(x["n_lines"], F.lit(1))
        return F.struct(
            n.alias("n_words"), w["word_chars"].alias("word_chars"), s.alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            ((n < 10) | (100 * w["n_repeat_words"] > 20 * n)).alias("base_failed"),
            F.log(F.greatest(w["word_chars"], F.lit(1)) / some).alias("x_length"),
            F.log(1 + s / some).alias("x_symbols"), (x["n_dup_lines"] / n_lines).alias("x_lines"),
            (w["n_repeat_words"] / some).alias("x_repeats"))

    stats = let(of_words, lambda w: let(of_lines, lambda x: let(symbols, lambda s: all_of(w, x, s))))
    return docs.withColumn((names or {}).get("stats", "stats"), stats)


# --- estimates -----------------------------------------------------------------------------------

def chi2_cdf(x: float, degrees: int) -> float:
    """Chi-square distribution function for an even number of degrees."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** i / math.factorial(i) for i in range(degrees // 2))


def chi2_quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, degrees) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, degrees: int) -> float:
    """What the covariance of the nearest ``share`` of a normal sample is short of."""
    return share / chi2_cdf(chi2_quantile(share, degrees), degrees + 2)


def group_key(level: int, lang: Column, source: Column) -> Column:
    """A text that names the group of a level: 2 language and source, 1 language, 0 all."""
    parts = [F.lit(level).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source")]
    return F.to_json(F.struct(*parts[: level + 1]))


def _vectors(rows: DataFrame) -> DataFrame:
    """One row per document and level: g and the transformed statistics.  Base failures stay out."""
    keys = F.array(*[group_key(k, F.col("lang"), F.col("source")) for k in (0, 1, 2)])
    return rows.where(~F.col("base_failed")).select(F.explode(keys).alias("g"), *XS)


def _start(vectors: DataFrame) -> DataFrame:
    """Coordinate-wise medians and quartile ranges, to a quarter of a floor, from counts per value bin."""
    values = F.array(*[F.struct(F.lit(x).alias("x"), F.floor(F.col(x) * (4 / FLOORS[x])).alias("bin")) for x in XS])
    counts = (vectors.select("g", F.explode(values).alias("v")).groupBy("g", "v.x", "v.bin")
              .agg(F.count("*").alias("n")))
    w = Window.partitionBy("g", "x")
    below = counts.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("cum") >= F.col("all") * q, F.col("bin")))

    per_x = below.groupBy("g", "x").agg(F.max("all").alias("n"), quantile(0.5).alias("mid"),
                                        (quantile(0.75) - quantile(0.25)).alias("range"))
    columns = [F.max("n").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("moved")]
    for i, x in enumerate(XS):
        unit = FLOORS[x] / 4
        columns += [F.max(F.when(F.col("x") == x, (F.col("mid") + 0.5) * unit)).alias(f"m{i}"),
                    F.max(F.when(F.col("x") == x, F.col("range") * unit / 1.349)).alias(f"sd{i}")]
    est = per_x.groupBy("g").agg(*columns)
    for i, x in enumerate(XS):
        for j in range(i):
            est = est.withColumn(f"s{i}{j}", F.lit(0.0))
        est = est.withColumn(f"s{i}{i}", F.col(f"sd{i}") * F.col(f"sd{i}")).withColumn(f"o{i}", F.col(f"m{i}"))
    return est


def _factored(est: DataFrame, factor: float) -> DataFrame:
    """Adds the Cholesky factor of the covariance (s..), made consistent by ``factor`` and raised by the floors."""
    for i, x in enumerate(XS):
        for j in range(i + 1):
            value = F.col(f"s{i}{j}") * factor + (FLOORS[x] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    p = range(len(XS))
    return cut_lineage(est.select("g", "n", "k", "moved", *[f"o{i}" for i in p], *[f"m{i}" for i in p],
                                  *[f"l{i}{j}" for i in p for j in range(i + 1)]))


def distance2(xs: list[Column], est) -> Column:
    """Squared Mahalanobis distance of a vector from an estimate's mean under its Cholesky factor."""
    z: list[Column] = []
    for i, x in enumerate(xs):
        rest = x - est(f"m{i}")
        for j in range(i):
            rest = rest - est(f"l{i}{j}") * z[j]
        z.append(rest / est(f"l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _moments(vectors: DataFrame, est: DataFrame, cut: float | None) -> DataFrame:
    """Mean and covariance of the documents nearest to ``est``: the KEEP share in whole bins, or all within ``cut``.

    ``moved`` says whether they are other documents than those ``est`` was taken from.
    """
    p = range(len(XS))
    near = vectors.join(bounded_broadcast(est, MAX_BROADCAST_GROUPS), "g")
    d2 = distance2([F.col(x) for x in XS], F.col)
    off = [F.col(x) - F.col(f"o{i}") for i, x in enumerate(XS)]
    sums = [F.count("*").alias("k"), *[F.sum(off[i]).alias(f"a{i}") for i in p],
            *[F.sum(off[i] * off[j]).alias(f"b{i}{j}") for i in p for j in range(i + 1)]]
    names = ["k", *[f"a{i}" for i in p], *[f"b{i}{j}" for i in p for j in range(i + 1)]]
    if cut is None:
        bins = (near.withColumn("bin", F.floor(BINS_PER_DOUBLING * F.log2(d2 + 1e-9)))
                .groupBy("g", "bin").agg(*sums, F.max("n").alias("n")))
        before = F.coalesce(F.sum("k").over(Window.partitionBy("g").orderBy("bin")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = bins.withColumn("before", before).where(F.col("before") < F.ceil(F.col("n") * KEEP))
    else:
        chosen = near.where(d2 <= cut).groupBy("g").agg(*sums)
    total = chosen.groupBy("g").agg(*[F.sum(x).alias(x) for x in names])
    out = (est.select("g", "n", F.col("k").alias("k_before"), *[f"o{i}" for i in p], *[f"m{i}" for i in p])
           .join(total, "g"))
    mean = [F.col(f"a{i}") / F.col("k") for i in p]
    moved = F.col("k") != F.col("k_before")
    for i, x in enumerate(XS):
        moved = moved | (F.abs(F.col(f"o{i}") + mean[i] - F.col(f"m{i}")) > SAME * FLOORS[x])
    return out.select(
        "g", "n", "k", moved.alias("moved"), *[f"o{i}" for i in p], *[(F.col(f"o{i}") + mean[i]).alias(f"m{i}") for i in p],
        *[(F.col(f"b{i}{j}") / F.col("k") - mean[i] * mean[j]).alias(f"s{i}{j}") for i in p for j in range(i + 1)])


def estimates(rows: DataFrame) -> DataFrame:
    """g, n, mean and Cholesky factor of every language and source, language, and the whole of ``rows``.

    ``rows`` (lang, source, base_failed and the x columns) should be materialised.
    """
    vectors = _vectors(rows)
    est = _factored(_start(vectors), 1.0)
    settled = []
    for _ in range(STEPS):
        est = _factored(_moments(vectors, est, None), consistency(KEEP, len(XS)))
        settled.append(est.where(~F.col("moved")))
        est = est.where("moved")
        if est.isEmpty():
            break
    est = cut_lineage(reduce(DataFrame.unionByName, settled, est))
    inner = 0.975
    return _factored(_moments(vectors, est, chi2_quantile(inner, len(XS))), consistency(inner, len(XS)))


def _chosen(rows: DataFrame, est: DataFrame) -> DataFrame:
    """lang, source -> the estimate of the smallest of its groups with MIN_GROUP documents (or of all)."""
    pairs = rows.select("lang", "source").distinct()
    keys = F.array(*[F.struct(F.lit(k).alias("level"), group_key(k, F.col("lang"), F.col("source")).alias("g"))
                     for k in (0, 1, 2)])
    p = range(len(XS))
    values = F.struct("level", "n", *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)])
    found = (pairs.select("lang", "source", F.explode(keys).alias("k")).select("lang", "source", "k.level", "k.g")
             .join(est, "g").where((F.col("n") >= MIN_GROUP) | (F.col("level") == 0)))
    return cut_lineage(found.groupBy("lang", "source").agg(F.max_by(values, "level").alias("est"))
                       .select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), "est"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the flat statistics of every row, materialised."""
    return cut_lineage(with_statistics(pick(docs, "doc_id", "text", "lang", "source"))
                       .select("doc_id", "lang", "source", "stats.*"))


def judged(docs: DataFrame) -> DataFrame:
    """Statistics of every row, ``distance2`` from its group's estimate, ``base_failed`` and ``kept``."""
    rows = statistics(docs)
    chosen = bounded_broadcast(_chosen(rows, estimates(rows)), MAX_BROADCAST_GROUPS)
    out = rows.join(chosen, rows["lang"].eqNullSafe(chosen["e_lang"]) & rows["source"].eqNullSafe(chosen["e_source"]),
                    "left")
    d2 = distance2([F.col(x) for x in XS], lambda name: F.col("est")[name])
    kept = ~F.col("base_failed") & F.coalesce(d2 <= chi2_quantile(1 - TAIL, len(XS)), F.lit(True))
    return out.select("doc_id", "lang", "source", *STATS, *XS, d2.alias("distance2"), "base_failed", kept.alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows = statistics(docs)
    chosen = bounded_broadcast(_chosen(rows, estimates(rows)), MAX_BROADCAST_GROUPS)
    own = with_statistics(docs, {"stats": "__stats"})
    out = own.join(chosen.withColumnsRenamed({"e_lang": "__lang", "e_source": "__source", "est": "__est"}),
                   docs["lang"].eqNullSafe(F.col("__lang")) & docs["source"].eqNullSafe(F.col("__source")), "left")
    d2 = distance2([F.col("__stats")[x] for x in XS], lambda name: F.col("__est")[name])
    limit = chi2_quantile(1 - TAIL, len(XS))
    return out.where(~F.col("__stats")["base_failed"] & F.coalesce(d2 <= limit, F.lit(True))).select(*docs.columns)
