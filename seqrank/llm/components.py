"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import discard, saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its group) that join the same nodes as the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)].copy(), at[len(a) :].copy()
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches):
    """One task's links, a bounded slice at a time, as forests."""
    for batch in batches:
        if batch.num_rows:
            node, root = forest(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (two long columns a, b): the least node it reaches.

    Every round keeps only distinct links, hooks each node's larger neighbours to its least
    neighbour (large star) and then its smaller ones (small star). The minimum per node is a
    partial aggregate, and joins meet one row per node, so that a hub is split by adaptive
    execution. Rounds are written tables in the shared folder. Links with a null end are ignored;
    an empty table gives an empty result.
    """
    spark = links.sparkSession
    tidy = links.where("a is not null and b is not null and a <> b").mapInArrow(_contract, "a long, b long")
    edges, path = saved(tidy.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node's own hook is among these: it is a larger neighbour of its least neighbour
        large = larger.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        following, step = saved(small.where("a <> b").distinct())
        count = following.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("g")
        ).first()
        discard(spark, path)
        edges, path = following, step
        if count == size:
            break
        size = count
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
