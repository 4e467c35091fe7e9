import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqrank.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group and a third of the values equal."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        value = 1.5 if rng.random() < 0.33 else rng.random() * 10
        rows.append((key, value, i))
    return pd.DataFrame(rows, columns=["key", "x", "id"])


@pytest.mark.parametrize("along", [None, lambda: -F.col("x")])
def test_rank_rows_matches_pandas(spark, skewed, along):
    df = spark.createDataFrame(skewed).repartition(7)
    got = R.rank_rows(df, ["key"], [F.col("x").desc(), F.col("id")], "rank", along and along()).toPandas().sort_values("id")
    want = skewed.sort_values(["x", "id"], ascending=[False, True])
    want = want.assign(rank=want.groupby("key").cumcount() + 1).sort_values("id")
    assert got["rank"].tolist() == want["rank"].tolist()


def test_rank_rows_without_groups(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = R.rank_rows(df, [], [F.col("x"), F.col("id")], "rank", F.col("x"))
    assert got.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first() == (1, 3000, 3000)


@pytest.mark.parametrize("along", [None, lambda: F.col("id")])
def test_running_totals(spark, skewed, along):
    df = spark.createDataFrame(skewed).withColumn("one", F.lit(1))
    got = R.running_totals(df, ["key"], [F.col("id")], {"upto": "one"}, along and along()).toPandas().sort_values("id")
    want = skewed.sort_values("id").groupby("key").cumcount() + 1
    assert got["upto"].tolist() == want.tolist()


def test_quantiles_match_numpy(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = R.quantiles(df, ["key"], "x", {"q25": 0.25, "mid": 0.5, "q90": 0.9}).toPandas().set_index("key")
    for key, part in skewed.groupby("key"):
        assert got.loc[key].tolist() == pytest.approx(np.quantile(part["x"], [0.25, 0.5, 0.9]).tolist())


@pytest.mark.parametrize("values", [[7.0] * 50, [0.0] * 49 + [1e9], [1.0], [1.0, 2.0], list(range(20_000)), [None, float("nan"), 3.0, None]])
def test_quantiles_of_ties_outliers_and_few_rows(spark, values):
    df = spark.createDataFrame([("a", v if v is None else float(v)) for v in values], "key string, x double").repartition(5)
    finite = [v for v in values if v is not None and v == v]
    probs = {f"p{i}": i / 10 for i in range(11)} | {"p37": 0.37}
    for keys in ([], ["key"]):
        got = R.quantiles(df, keys, "x", probs).first()
        assert [got[n] for n in probs] == pytest.approx(np.quantile(finite, list(probs.values())).tolist())
    assert R.quantiles(df.where("false"), ["key"], "x", probs).count() == 0


def test_ranks_in_buckets_with_nulls_and_ties(spark):
    rows = [(float(i % 7) if i % 5 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, id long").repartition(6)
    got = R.rank_rows(df, [], [F.col("x").desc_nulls_last(), F.col("id")], "rank", -F.col("x")).orderBy("rank").collect()
    assert [(r.x, r.id) for r in got] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [r["rank"] for r in got] == list(range(1, 501))


def test_average_ranks(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = R.average_ranks(df, ["key"], "x", "r", pct=True).toPandas().sort_values("id")
    want = skewed.sort_values("id").groupby("key")["x"].rank(method="average", pct=True)
    assert got["r"].tolist() == pytest.approx(want.tolist())


@pytest.mark.parametrize("buckets", [2, 64])
def test_top_fraction_mean(spark, skewed, buckets):
    df = spark.createDataFrame(skewed)
    got = R.top_fraction_mean(df, ["key"], "x", 0.05, "m", buckets).toPandas().set_index("key")["m"]
    for key, part in skewed.groupby("key"):
        n = max(1, math.ceil(len(part) * 0.05))
        assert got[key] == pytest.approx(part["x"].nlargest(n).mean())


def test_bins_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "n double")
    edges = R.quantile_edges(df, "n", 20).first()[0]
    assert edges == [5.0]
    lit = F.array(F.lit(5.0))
    assert df.select(R.bin_of("n", lit).alias("b")).distinct().collect()[0][0] == 0
