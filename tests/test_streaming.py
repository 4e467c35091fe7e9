"""Keyed stream state: few keys touch few files, and a batch may run twice."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from seqrank.operators import genes as G
from seqrank.streaming import incremental as I

ORDER = (lambda: [F.col("s").desc(), F.col("id")])
SCHEMA = "k int, s double, id int"


def data(spark, ids):
    return spark.createDataFrame([(i % 40, float((i * 37) % 101), i) for i in ids], SCHEMA)


def parts(folder):
    return {os.path.relpath(p, folder) for p in glob.glob(f"{folder}/batch=*/part=*")}


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "id", "window_rank").collect())


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_a_batch_of_one_key_rewrites_one_part(spark, folder):
    all_rows = data(spark, range(400))
    step = I.top_n_step(spark, all_rows.schema, ["k"], ORDER(), 3, folder, parts=16)
    step(all_rows, 0)
    before = parts(folder)
    assert len(before) > 8
    one = spark.createDataFrame([(7, 500.0, 9000), (7, 1.0, 9001)], SCHEMA)
    step(one, 1)
    assert len(parts(folder) - before) == 1 and before < parts(folder)
    step(one.withColumn("id", F.col("id") + 10), 2)
    # the version that a replay of the last batch reads is still there, the one before it is gone
    new = parts(folder)
    assert len(before - new) == 1 and len(new - before) == 2
    kept = I.KeyedState(spark, folder, ["k"], 16).read(all_rows.withColumn("window_rank", F.lit(0)).schema)
    want = G.top_n(all_rows.union(one).union(one.withColumn("id", F.col("id") + 10)), ["k"], ORDER(), 3, "window_rank")
    assert rows(kept) == rows(want)


def test_a_batch_may_break_off_and_run_again(spark, folder):
    first, second, third = (data(spark, ids) for ids in (range(200), range(200, 300), range(300, 400)))
    step = I.top_n_step(spark, first.schema, ["k"], ORDER(), 4, folder)
    step(first, 0)
    step(second, 1)
    # a batch that broke off has written some files, but no mark that it is done
    junk = spark.createDataFrame([(1, 999.0, -1, 1)], "k int, s double, id int, window_rank int")
    junk.write.parquet(f"{folder}/batch=2/part=3")
    state = I.KeyedState(spark, folder, ["k"])
    assert all(2 not in found for found in state.versions().values())
    step(third, 2)
    step(third, 2)  # and once more, after it was done
    kept = state.read(first.withColumn("window_rank", F.lit(0)).schema)
    assert rows(kept) == rows(G.top_n(data(spark, range(400)), ["k"], ORDER(), 4, "window_rank"))


def test_restart_of_the_query_in_the_middle(spark, folder):
    data(spark, range(150)).coalesce(1).write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    I.finished(I.stream_top_n(stream(), ["k"], ORDER(), 2, f"{folder}/s", f"{folder}/log"), spark, f"{folder}/s")
    data(spark, range(150, 400)).repartition(3).write.mode("append").parquet(f"{folder}/in")
    out = I.finished(I.stream_top_n(stream(), ["k"], ORDER(), 2, f"{folder}/s", f"{folder}/log"), spark, f"{folder}/s")
    assert rows(out) == rows(G.top_n(data(spark, range(400)), ["k"], ORDER(), 2, "window_rank"))


def test_no_rows(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/in")
    run = I.stream_extremes(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), ["k"], "s", f"{folder}/s", f"{folder}/log")
    assert I.finished(run, spark, f"{folder}/s", "k int, least double, greatest double, n long").count() == 0
