"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir`` that driver and executors reach alike."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; later steps read that table, whatever executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no later step reads."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def first_by_hash(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most ``most`` rows: the first in order of a hash of ``key``, then of all columns.

    Rows are counted first, and only those among about three times as many go on to be sorted: what tasks
    hand over doesn't grow with the table.
    """
    n, place = df.count(), F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    if n > most:
        df = df.where(place < max(1, min(1 << 30, ((3 * most + 100) << 30) // n)))
    return df.orderBy(place, *df.columns).limit(most)


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Cut batches of rows sorted by integer ``keys`` into runs of equal keys; a run may come in several pieces."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)
