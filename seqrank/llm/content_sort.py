"""Exact duplicates by sorting content: sampled splitters, sorted partitions, comparisons of neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import saved, shuffle_width

#: Characters of a text that a splitter holds; texts that agree in them are ordered by a hash, then by themselves.
SPLITTER_CHARS = 48

_RUNS = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, part int, run long, last boolean, edge string"


def _runs(batches):
    """Runs of equal texts in one sorted partition.

    A text is compared in whole with the one before it. Runs within a batch leave at once; of a run that
    goes on in the next batch only the text and the ids are held, eight bytes a row. ``edge`` is the text of the
    partition's first run and of its last one, which may go on in the next partition; their first rows have it.
    """
    part = TaskContext.get().partitionId()
    run, text, ids, gone = -1, None, [], []  # the open run

    def rows(doc, null, sizes, digests, last=False, edge=None):
        """Whole runs, the first of which is number ``run``."""
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(np.arange(len(sizes)), sizes)
        kept = np.zeros(len(doc), dtype=bool)
        kept[first] = True
        edges = pa.array([edge], pa.string()) if len(doc) == 1 else pa.concat_arrays([pa.array([edge], pa.string()), pa.nulls(len(doc) - 1, pa.string())])
        out = [pa.array(doc, pa.int64(), mask=null), pa.array(doc[first][at], pa.int64(), mask=null[first][at]), pa.array(sizes[at]), pa.array(kept)]
        out += [pa.array(digests, pa.string()).take(pa.array(at)), pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(run + at), pa.array(np.full(len(doc), last)), edges]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "part", "run", "last", "edge"])

    def close(last: bool):
        doc, null = np.concatenate(ids), np.concatenate(gone)
        edge = text.decode() if last or run == 0 else None
        yield from rows(doc, null, np.array([len(doc)]), [hashlib.sha256(text).hexdigest()], last, edge)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, column = batch.column(0).cast(pa.binary()), batch.column(1)
        doc, null = np.asarray(pc.fill_null(column, 0), dtype=np.int64), np.asarray(pc.is_null(column))
        new = np.ones(n, dtype=bool)
        new[1:] = np.asarray(pc.not_equal(texts.slice(1), texts.slice(0, n - 1)))
        new[0] = text is None or texts[0].as_py() != text
        starts = np.flatnonzero(new)
        head = int(starts[0]) if len(starts) else n
        if head:
            ids.append(doc[:head])
            gone.append(null[:head])
        if not len(starts):
            continue
        if text is not None:
            yield from close(False)
        run += 1
        tail = int(starts[-1])
        if tail > head:
            digests = [hashlib.sha256(t).hexdigest() for t in texts.take(pa.array(starts[:-1])).to_pylist()]
            yield from rows(doc[head:tail], null[head:tail], np.diff(starts), digests, edge=texts[head].as_py().decode() if run == 0 else None)
            run += len(starts) - 1
        text, ids, gone = texts[tail].as_py(), [doc[tail:]], [null[tail:]]
    if text is not None:
        yield from close(True)


def exact_duplicates(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = lambda c: c, width: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Rows are sorted by (first characters, hash, text, doc_id): Spark samples such keys for the splitters,
    without the texts, deals the rows out to ``width`` ranges and sorts each one, on disk if it must.
    Equal texts are neighbours then, and each text is compared in whole with its neighbour. As the id is part of the
    order, any number of copies spreads over as many ranges as they fill; runs at the ends of neighbouring
    ranges are compared and joined afterwards, and what that takes grows with the number of ranges only.

    ``keep`` names the doc_id that a group keeps. ``normalise`` is applied to texts first; the digest is of the result.
    Null texts count as empty, empty ones are equal to each other. A null doc_id comes after all others; a group of such
    rows only has a null keep_id. Exactly one row of a group is kept, also among repeated rows. Other columns are
    neither read nor returned; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep the smallest or the largest doc_id")
    spark = docs.sparkSession
    text = F.coalesce(normalise(F.coalesce(F.col("text"), F.lit(""))), F.lit(""))
    own = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    keyed = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    keyed = keyed.withColumn("head", F.substring("text", 1, SPLITTER_CHARS)).withColumn("hash", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(width or shuffle_width(spark), "head", "hash", own).sortWithinPartitions("head", "hash", "text", own)
    runs, _ = saved(dealt.select("text", "doc_id").mapInArrow(_runs, _RUNS))

    # one row for the first and one for the last run of every range that holds rows
    ends = runs.where("edge is not null")
    known = {(r.part, r.run): (r.keep_id, r.group_size) for r in ends.select("part", "run", "keep_id", "group_size").collect()}
    last: dict[int, int] = {}
    for p, r in known:
        last[p] = max(r, last.get(p, 0))
    parts = sorted(last)
    following = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next_part int")
    after = ends.where("run = 0").select(F.col("part").alias("next_part"), F.col("edge").alias("next_edge"))
    goes_on = {r.part for r in ends.where("last").join(following, "part").join(after, "next_part").where("edge = next_edge").select("part").collect()}
    fixes = spark.createDataFrame(_chains(parts, last, goes_on, known), "part int, run long, head boolean, whole_keep long, whole_size long")
    # one row or two for each range
    out = runs.join(F.broadcast(fixes), ["part", "run"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("whole_size").isNotNull(), F.col("whole_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("whole_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce(F.col("head"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _chains(parts: list[int], last: dict[int, int], goes_on: set[int], known: dict) -> list[tuple]:
    """(part, run, whether the group starts there, id that stays, rows of the group) for runs that reach over the ends of ranges."""
    out, chain = [], []

    def close():
        if len(chain) > 1:
            total = sum(known[c][1] for c in chain)
            out.extend((*c, k == 0, known[chain[0]][0], total) for k, c in enumerate(chain))
        chain.clear()

    for p in parts:
        chain.append((p, 0))
        if last[p]:
            close()
            chain.append((p, last[p]))
        if p not in goes_on:
            close()
    return out
