"""Window-count bias, classification metrics and grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.functions.numeric import finite
from seqrank.operators.ranking import average_ranks, bin_of, cut_points, quantile_edges, quantiles, running_totals


def correlations(rows: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman over complete pairs; NULL for fewer than two or constant columns."""
    pairs = rows.select(*groups, finite(x).alias("_x"), finite(y).alias("_y")).dropna(subset=["_x", "_y"])
    pairs = average_ranks(average_ranks(pairs, groups, "_x", "_rx"), groups, "_y", "_ry")
    safe = (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    found = pairs.groupBy(*groups).agg(
        F.when((F.count(F.lit(1)) > 1) & safe, F.corr("_x", "_y")).alias("pearson"),
        F.when((F.count(F.lit(1)) > 1) & safe, F.corr("_rx", "_ry")).alias("spearman"),
    )
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_genes"))
    return sizes.join(found, list(groups), "left")


def bias_flags(corr: DataFrame, limit: float = 0.2) -> DataFrame:
    """Rankings whose score follows the window count."""
    return corr.where((F.abs("pearson") >= limit) | (F.abs("spearman") >= limit))


def add_bins(genes: DataFrame, value: str, bins: int, out: str = "window_count_bin") -> DataFrame:
    """Quantile bin number of a column (equal cut points merged)."""
    found = quantile_edges(genes, value, bins).first()  # at most bins + 1 numbers, looked for once
    edges = F.array(*[F.lit(float(e)) for e in (found[0] if found else []) if e is not None]).cast("array<double>")
    return genes.withColumn(out, bin_of(finite(value), edges))


def bin_adjust(genes: DataFrame, value: str, score: str, bins: int = 20) -> DataFrame:
    """Percentile rank and sample z of a score inside its window-count bin."""
    binned = add_bins(genes, value, bins)
    ranked = average_ranks(
        binned.withColumn(score, finite(score)), ["window_count_bin"], score, "bin_adjusted_percentile", pct=True
    )
    stats = ranked.groupBy("window_count_bin").agg(
        F.avg(score).alias("_mean"), F.nullif(F.stddev_samp(score), F.lit(0.0)).alias("_std")
    )
    joined = ranked.join(F.broadcast(stats), "window_count_bin", "left")  # at most a row for each bin
    z = (F.col(score) - F.col("_mean")) / F.col("_std")
    return joined.withColumn("bin_adjusted_zscore", z).drop("_mean", "_std")


def bin_summary(adjusted: DataFrame, value: str, score: str) -> DataFrame:
    """Size, range, means and exact medians per bin."""
    flat = adjusted.groupBy("window_count_bin").agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.min(value).alias("min_n_windows"),
        F.max(value).alias("max_n_windows"),
        F.avg(score).alias("raw_score_mean"),
        F.avg("bin_adjusted_percentile").alias("adjusted_percentile_mean"),
    )
    raw = quantiles(adjusted, ["window_count_bin"], score, {"raw_score_median": 0.5})
    adapted = quantiles(adjusted, ["window_count_bin"], "bin_adjusted_percentile", {"adjusted_percentile_median": 0.5})
    return flat.join(raw, "window_count_bin", "left").join(adapted, "window_count_bin", "left")


def binary_metrics(rows: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """AUROC, average precision, and mean and median of either class; NULL with one class only.

    Scores are counted per distinct value first, then swept from the lowest upwards.
    """
    groups = list(groups)
    base = rows.select(*groups, F.col(label).cast("int").alias("_y"), finite(score).alias("_s"))
    known = F.col("_s").isNotNull()
    totals = base.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_y") == 1).alias("n_positive"),
        F.count_if(F.col("_y") == 0).alias("n_negative"),
        F.count_if((F.col("_y") == 1) & known).alias("_P"),
        F.count_if((F.col("_y") == 0) & known).alias("_N"),
    )
    scored = base.where(known)
    counts = scored.groupBy(*groups, "_s").agg(
        F.count_if(F.col("_y") == 1).alias("_tp"), F.count_if(F.col("_y") == 0).alias("_fp")
    )
    swept = running_totals(counts, groups, [F.col("_s")], {"_ctp": "_tp", "_cfp": "_fp"}, F.col("_s"), cut_points(scored, F.col("_s")))
    joined = swept.join(totals.select(*groups, "_P", "_N"), groups)
    tp, fp = F.col("_tp").cast("double"), F.col("_fp").cast("double")
    above_tp = F.col("_P") - F.col("_ctp") + tp
    above_all = above_tp + F.col("_N") - F.col("_cfp") + fp
    both = (F.first("_P") > 0) & (F.first("_N") > 0)

    def middle(total: str, upto: str, own: str) -> Column:
        """The median of a class, from the running counts."""
        h = (F.col(total) - 1) / F.lit(2.0)

        def at(pos: Column) -> Column:
            return F.max(F.when((F.col(upto) > pos) & (F.col(upto) - F.col(own) <= pos), F.col("_s")))

        return F.when(both, at(F.floor(h)) + (at(F.ceil(h)) - at(F.floor(h))) * F.max(h - F.floor(h)))

    curves = joined.groupBy(*groups).agg(
        F.when(both, F.sum(tp * (F.col("_cfp") - fp + fp / 2.0)) / F.first(F.col("_P") * F.col("_N"))).alias("auroc"),
        F.when(both, F.sum(tp / F.nullif(F.col("_P"), F.lit(0)) * (above_tp / above_all))).alias("auprc"),
        F.when(both, F.sum(F.col("_s") * tp) / F.first(F.nullif(F.col("_P"), F.lit(0)))).alias("positive_mean"),
        F.when(both, F.sum(F.col("_s") * fp) / F.first(F.nullif(F.col("_N"), F.lit(0)))).alias("negative_mean"),
        middle("_P", "_ctp", "_tp").alias("positive_median"),
        middle("_N", "_cfp", "_fp").alias("negative_median"),
    )
    return totals.drop("_P", "_N").join(curves, groups, "left")


def group_summary(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and exact median of many columns per group, long: (groups, feature, n, mean, median)."""
    long = rows.select(*groups, *[finite(c).alias(c) for c in columns]).unpivot(list(groups), list(columns), "feature", "x")
    means = long.groupBy(*groups, "feature").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("x").alias("mean"))
    mids = quantiles(long, [*groups, "feature"], "x", {"median": 0.5})
    return means.join(mids, [*groups, "feature"], "left")


def inverse_frequency_weights(rows: DataFrame, family: str) -> DataFrame:
    """Weight 1 / family size, scaled to sum to 1."""
    sizes = rows.groupBy(family).agg(F.count(F.lit(1)).alias("_n"))
    families = sizes.agg(F.count(F.lit(1))).scalar()
    return rows.join(sizes, family).withColumn("sample_weight", 1.0 / F.col("_n") / families).drop("_n")


def value_table(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def zero_fraction(rows: DataFrame, groups: Sequence[str], value: str, limit: float = 0.95) -> DataFrame:
    """Share of zeros per group with a warning above the limit."""
    share = F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0))
    out = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), share.alias("zero_fraction"))
    return out.withColumn("warning", F.col("zero_fraction") > limit)
