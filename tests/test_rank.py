"""The distributed rank helpers equal the single-task windows."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revguard.operators import rank


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    n = 3000
    vals = np.round(rng.random(n), 2)          # many ties
    vals[:1000] = 0.5                           # one hot value holding a third of the rows
    grp = rng.integers(0, 3, n)
    rows = [(i, float(v), int(g)) for i, (v, g) in enumerate(zip(vals, grp))]
    return spark.createDataFrame(rows, "id long, score double, g int")


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_percent_rank_matches_window(scores, parts):
    got = rank.percent_rank(scores, "score", num_partitions=parts)
    ref = scores.withColumn("ref", F.percent_rank().over(Window.orderBy("score")))
    bad = got.join(ref, "id").filter(F.abs(F.col("percent_rank") - F.col("ref")) > 1e-12).count()
    assert bad == 0 and got.count() == scores.count()


@pytest.mark.parametrize("parts", [1, 5])
def test_percent_rank_partitioned(scores, parts):
    got = rank.percent_rank(scores, "score", partition_cols=["g"], num_partitions=parts)
    ref = scores.withColumn("ref", F.percent_rank().over(Window.partitionBy("g").orderBy("score")))
    assert got.join(ref, "id").filter(F.abs(F.col("percent_rank") - F.col("ref")) > 1e-12).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_row_index_and_split(scores, parts):
    idx = rank.row_index(scores, ["score", "id"], num_partitions=parts)
    ref = scores.withColumn("ref", F.row_number().over(Window.orderBy("score", "id")) - 1)
    assert idx.join(ref, "id").filter(F.col("row_index") != F.col("ref")).count() == 0
    sp = rank.time_split(scores, "score", "id", num_partitions=parts)
    c = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert c == {"train": 2100, "val": 450, "test": 450}
    # every train row precedes every test row in (score, id)
    mx = sp.filter("split = 'train'").agg(F.max(F.struct("score", "id"))).first()[0]
    mn = sp.filter("split = 'test'").agg(F.min(F.struct("score", "id"))).first()[0]
    assert (mx["score"], mx["id"]) < (mn["score"], mn["id"])


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantile_exact(scores, q):
    vals = np.array([r[0] for r in scores.select("score").collect()])
    assert rank.quantile(scores, "score", q, num_partitions=5) == pytest.approx(np.percentile(vals, q * 100))


def test_percent_rank_of_top_rows_matches_window(spark, scores):
    # NULL scores sort first; a hot tie (0.5) holds a third of the rows.
    pop = scores.withColumn("score", F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("score")))
    top = pop.orderBy(F.col("score").desc_nulls_last(), F.col("id")).limit(40) \
        .unionByName(pop.filter(F.col("score").isNull() | (F.col("score") == 0.5)).orderBy("id").limit(10))
    got = rank.percent_rank_of(top, pop, "score", partition_cols=["g"], out="pr")
    ref = pop.withColumn("ref", F.percent_rank().over(Window.partitionBy("g").orderBy("score")))
    j = got.join(ref.select("id", "ref"), "id")
    assert j.count() == top.count() == 50
    assert j.filter(F.abs(F.col("pr") - F.col("ref")) > 1e-12).count() == 0
