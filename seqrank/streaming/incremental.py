"""Per-key top-N and extremes over arriving rows, with a state that is kept by parts of the keys.

Both reductions are associative, so a micro-batch is merged with the kept state. Keys are dealt into a fixed number of
parts by their hash. A batch reads and writes only the parts that its keys fall into: batch ``n`` writes
them below ``batch=n/part=p``, and the state is the latest version of every part. A batch that runs
again after a failure reads versions of earlier batches only and overwrites its own folder with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqrank.operators.ranking import top_n

#: Parts of a state. A batch that touches few keys rewrites that share of the state at most.
PARTS = 64


class KeyedState:
    """Versions of the parts of one state below a folder."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], parts: int = PARTS):
        self.spark, self.folder, self.keys, self.parts = spark, folder, list(keys), parts
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _names(self, folder: str, prefix: str) -> list[int]:
        path = self.path(folder)
        if not self.files.exists(path):
            return []
        found = [f.getPath().getName() for f in self.files.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith(prefix))

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """Batches that wrote each part, oldest first: only finished ones, and only those before ``before``."""
        out: dict[int, list[int]] = {}
        for batch in self._names(self.folder, "batch="):
            if (before is None or batch < before) and self.files.exists(self.path(f"{self.folder}/batch={batch}/_SUCCESS")):
                for part in self._names(f"{self.folder}/batch={batch}", "part="):
                    out.setdefault(part, []).append(batch)
        return out

    def read(self, schema, parts: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The latest rows of the named parts (default: all), or None if there are none."""
        versions = self.versions(before)
        paths = [f"{self.folder}/batch={v[-1]}/part={p}" for p, v in sorted(versions.items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def update(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame | None], DataFrame], schema) -> None:
        """Merge the rows of a batch with what is kept of their parts, and write these parts anew."""
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(self.part()).distinct().collect()]  # at most PARTS numbers
            merged = merge(batch, self.read(schema, touched, batch_id))
            dealt = merged.withColumn("part", self.part()).repartition("part")
            dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/batch={batch_id}")
        finally:
            batch.unpersist()
        # a batch that runs again needs the versions before it, and no older ones
        for part, found in self.versions(batch_id).items():
            for old in found[:-1]:
                self.files.delete(self.path(f"{self.folder}/batch={old}/part={part}"), True)


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def top_n_step(spark: SparkSession, schema, keys: Sequence[str], order: Sequence[Column], n: int, folder: str, rank: str = "window_rank", parts: int = PARTS):
    """The work of one batch of :func:`stream_top_n`, for rows of ``schema``."""
    state = KeyedState(spark, folder, keys, parts)
    kept_schema = spark.createDataFrame([], schema).withColumn(rank, F.lit(0)).schema

    def merge(batch: DataFrame, kept: DataFrame | None) -> DataFrame:
        rows = batch if kept is None else batch.unionByName(kept.drop(rank))
        return top_n(rows, keys, order, n, rank)

    return lambda batch, batch_id: state.update(batch, batch_id, merge, kept_schema)


def stream_top_n(
    stream: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, folder: str, checkpoint: str, rank: str = "window_rank", parts: int = PARTS
) -> StreamingQuery:
    """Keeps the ``n`` best rows per key; equal to the batch top-N over all rows seen."""
    return _run(stream, top_n_step(stream.sparkSession, stream.schema, keys, order, n, folder, rank, parts), checkpoint)


def stream_extremes(stream: DataFrame, keys: Sequence[str], value: str, folder: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Keeps smallest, largest and number of values per key."""
    spark = stream.sparkSession
    state = KeyedState(spark, folder, keys, parts)
    figures = [F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(F.lit(1)).alias("n")]
    kept_schema = spark.createDataFrame([], stream.schema).groupBy(*keys).agg(*figures).schema

    def merge(batch: DataFrame, kept: DataFrame | None) -> DataFrame:
        fresh = batch.groupBy(*keys).agg(*figures)
        rows = fresh if kept is None else fresh.unionByName(kept)
        return rows.groupBy(*keys).agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n"))

    return _run(stream, lambda batch, batch_id: state.update(batch, batch_id, merge, kept_schema), checkpoint)


def finished(query: StreamingQuery, spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """Waits for the available rows and returns the state after the last batch."""
    query.awaitTermination()
    state = KeyedState(spark, folder, [])
    versions = state.versions()
    paths = [f"{folder}/batch={v[-1]}/part={p}" for p, v in sorted(versions.items())]
    if not paths:
        if schema is None:
            raise ValueError("no rows have arrived, and no schema is given")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*paths)
