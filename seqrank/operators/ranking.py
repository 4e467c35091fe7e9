"""Ranks, running totals, quantiles and top-N that stay exact when one group is huge.

Groups whose size has a fixed bound use an ordinary window. For the rest, rows are dealt out by
(group, bucket of the order): cut points are literals from one aggregate, so a large group is
spread over many tasks; each numbers its own rows, and bucket totals supply the offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrank.functions.numeric import finite
from seqrank.session import durable

MOST_CUTS = 256  # literals of one expression
_ACCURACY, _BRACKET = 5_000, 1 / 1_000  # the aggregate is exact to 1 / 5,000 of the rows


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows per key. Spark cuts each partition to ``n`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def rank_bounded(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    """Row number inside groups that have a known, small size (k-mers, grids, seeds)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def cut_points(df: DataFrame, along: Column) -> list[float]:
    """About evenly filled cut points of a numeric column: one aggregate, and at most MOST_CUTS numbers.

    As literals they are the same whenever a task runs again.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(2, min(MOST_CUTS, width))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.agg(F.percentile_approx(along.cast("double"), shares, F.lit(10 * n))).first()[0]
    return sorted(set(found or []))


def leading(digest: str) -> Column:
    """The first digits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")


def text_number(column: str) -> Column:
    """A number that never falls along the order of a text: its first six bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def bucket(along: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below a value, by bisection; NULL comes last."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(along <= F.lit(cuts[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return F.when(along.isNull(), F.lit(len(cuts) + 1)).otherwise(between(0, len(cuts)))


def _offsets(parts: DataFrame, keys: Sequence[str], total: str) -> Column:
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(before), F.lit(0))


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str, along: Column | None = None) -> DataFrame:
    """Exact row number per key.

    ``along`` is a number that never falls along ``order`` (NULL last): rows are dealt out by its cut
    points, so that a group of any size is numbered by many tasks, and the counts of the buckets before
    are added. Without it, groups are numbered whole, for groups of a bounded size.
    """
    keys = list(keys)
    if along is None:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    dealt = df.withColumn("_part", bucket(along, cut_points(df, along)))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    dealt = dealt.withColumn("_local", F.row_number().over(local).cast("bigint"))
    parts = dealt.groupBy(*keys, "_part").agg(F.max("_local").alias("_n"))
    parts = parts.withColumn("_shift", _offsets(parts, keys, "_n")).drop("_n")
    out = dealt.join(parts, [*keys, "_part"])
    return out.withColumn(rank, F.col("_local") + F.col("_shift")).drop("_local", "_part", "_shift")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, str], along: Column | None = None, cuts: Sequence[float] | None = None
) -> DataFrame:
    """Inclusive running sums per key: ``totals`` maps new column to summed column; ``along`` as in :func:`rank_rows`.

    ``cuts`` may hold cut points of rows that are cheaper to look at than ``df``.
    """
    keys = list(keys)
    if along is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(src).over(whole) for out, src in totals.items()})
    dealt = df.withColumn("_part", bucket(along, cut_points(df, along) if cuts is None else cuts))
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({out: F.sum(src).over(local) for out, src in totals.items()})
    parts = dealt.groupBy(*keys, "_part").agg(*[F.sum(src).alias(f"_t_{out}") for out, src in totals.items()])
    parts = parts.select(*keys, "_part", *[_offsets(parts, keys, f"_t_{out}").alias(f"_o_{out}") for out in totals])
    joined = dealt.join(parts, [*keys, "_part"])
    for out in totals:
        joined = joined.withColumn(out, F.col(out) + F.col(f"_o_{out}"))
    return joined.drop("_part", *[f"_o_{out}" for out in totals])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct finite values per key with ``_n`` rows and ``_upto``, the rows at or below the value."""
    rows = df.select(*keys, finite(value).alias(value)).where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return running_totals(counts, keys, [F.col(value)], {"_upto": "_n"}, F.col(value), cut_points(rows, F.col(value)))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str, pct: bool = False) -> DataFrame:
    """Average-method rank of ``value`` per key (ties share the mean rank; NULL stays NULL)."""
    counts = value_counts(df, keys, value)
    ranked = counts.select(
        *keys, value, ((2 * F.col("_upto") - F.col("_n") + 1) / F.lit(2.0)).alias(rank), "_upto"
    )
    if pct:
        if keys:
            size = ranked.groupBy(*keys).agg(F.max("_upto").alias("_size"))
            ranked = ranked.join(size, list(keys))
        else:
            ranked = ranked.withColumn("_size", counts.agg(F.max("_upto")).scalar())
        ranked = ranked.withColumn(rank, F.col(rank) / F.col("_size")).drop("_size")
    return df.join(ranked.drop("_upto"), [*keys, value], "left")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, for groups of any size.

    An approximate aggregate brackets every quantile. A second pass counts: rows outside of all brackets
    as a whole for each gap between them, rows inside (about one in 500 for each quantile) by value. So no
    row is sorted or exchanged but those counts.
    """
    keys = list(keys)
    shares = list(dict.fromkeys(float(p) for p in probs.values()))
    rows = df.select(*keys, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    ends = [min(max(p + side * _BRACKET, 0.0), 1.0) for p in shares for side in (-1, 1)]
    near = F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(_ACCURACY))
    # a table of one row a key: its size on disk decides about a broadcast
    brackets = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), near.alias("_ends")))
    placed = rows.join(brackets, keys) if keys else rows.join(F.broadcast(brackets))
    v, edge = F.col("_v"), [F.col("_ends")[j] for j in range(len(ends))]
    inside = reduce(or_, (v.between(edge[2 * i], edge[2 * i + 1]) for i in range(len(shares))))
    gap = reduce(add, ((v > e).cast("int") for e in edge))
    counts = placed.groupBy(*keys, F.when(inside, v).alias("_v"), F.when(~inside, gap).alias("_gap")).agg(
        F.first("_size").alias("_size"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    order = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(order))
    out = []
    for name, p in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(p))
        ends_ = []
        for pos in (F.floor(h), F.ceil(h)):
            first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
            # of a gap only its first and its last row can be asked for
            own = F.when(F.col("_gap").isNull() | (pos == first), F.col("_lo")).when(pos == last, F.col("_hi"))
            ends_.append(F.max(F.when((first <= pos) & (pos <= last), own)))
        share = F.max(h - F.floor(h))
        out.append((ends_[0] + (ends_[1] - ends_[0]) * share).alias(name))
    return counts.groupBy(*keys).agg(*out)


def top_fraction_mean(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, out: str, buckets: int = 4096
) -> DataFrame:
    """Mean of the largest ceil(fraction * n) values per key.

    Equal-width buckets are counted first; whole buckets above the cut enter as sums and only
    the bucket that holds the cut is looked at value by value.
    """
    keys = list(keys)
    rows = df.select(*keys, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    span = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    span = span.withColumn("_take", F.greatest(F.ceil(F.col("_size") * F.lit(fraction)), F.lit(1)))
    place = F.least(
        F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets),
        F.lit(buckets - 1),
    )
    tagged = rows.join(span, keys).withColumn("_b", F.coalesce(place, F.lit(0).cast("bigint")))
    hist = tagged.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"), F.first("_take").alias("_take")
    )
    higher = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_above", F.coalesce(F.sum("_c").over(higher), F.lit(0))).withColumn(
        "_above_sum", F.coalesce(F.sum("_s").over(higher), F.lit(0.0))
    )
    cut = hist.where((F.col("_above") < F.col("_take")) & (F.col("_above") + F.col("_c") >= F.col("_take")))
    cut = cut.select(*keys, "_b", "_above", "_above_sum")
    edge = (
        tagged.join(cut, [*keys, "_b"])
        .groupBy(*keys, "_v")
        .agg(
            F.count(F.lit(1)).alias("_c"),
            F.first(F.col("_take") - F.col("_above")).alias("_need"),
            F.first("_above_sum").alias("_above_sum"),
            F.first("_take").alias("_take"),
        )
    )
    seen = Window.partitionBy(*keys).orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    used = F.greatest(
        F.least(F.col("_c"), F.col("_need") - F.coalesce(F.sum("_c").over(seen), F.lit(0))), F.lit(0)
    )
    edge = edge.withColumn("_used", used)
    return edge.groupBy(*keys).agg(
        ((F.sum(F.col("_v") * F.col("_used")) + F.first("_above_sum")) / F.first("_take")).alias(out)
    )


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row with ``edges``: the distinct quantile cut points of a column."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    q = quantiles(df, [], value, probs)
    return q.select(F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in probs]))).alias("edges"))


def bin_of(value: str | Column, edges: Column) -> Column:
    """Right-closed bin number from 0; the lowest edge belongs to the first bin."""
    x = F.col(value) if isinstance(value, str) else value
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0)))
