"""Feature tables of windows and their summaries per gene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.functions import sequence as S
from seqrank.functions import structure as A

HAIRPIN_FEATURES = [
    "longest_high_paired_run",
    "high_paired_run_count",
    "paired_run_density",
    "paired_unpaired_boundary_count",
    "max_local_paired_mean_31nt",
    "max_local_paired_mean_41nt",
    "max_local_paired_mean_81nt",
    "stem_like_score",
    "structure_peakiness_score",
    "paired_architecture_score",
    "is_high_paired_architecture_window",
]
_FOLD_EMPTY = [
    "MFE",
    "MFE_per_nt",
    "normalized_MFE",
    "predicted_stem_count",
    "predicted_longest_stem_length",
    "predicted_hairpin_loop_size",
    "predicted_stem_loop_score",
]


def hairpin_columns(windows: DataFrame, paired: str | None) -> DataFrame:
    """Pairing-architecture features; all NULL without values."""
    if paired is None:
        empty = {n: F.lit(None).cast("double") for n in [*HAIRPIN_FEATURES, *_FOLD_EMPTY]}
        return windows.withColumns(empty)
    df = windows.withColumn("_a", A.architecture(paired))
    p = F.col("_a")
    df = df.withColumns(
        {
            "longest_high_paired_run": p["longest"],
            "high_paired_run_count": p["runs"],
            "paired_run_density": p["density"],
            "paired_unpaired_boundary_count": p["boundaries"],
            **{f"max_local_paired_mean_{w}nt": p[f"mean{w}"] for w in (31, 41, 81)},
            "_mean": p["mean"],
        }
    )
    longest, density = F.col("longest_high_paired_run"), F.col("paired_run_density")
    l31, l41, l81 = (F.col(f"max_local_paired_mean_{w}nt") for w in (31, 41, 81))
    df = df.withColumns(
        {
            "stem_like_score": A.stem_like(longest, l41, density),
            "structure_peakiness_score": F.greatest(l31, l41, l81) - F.col("_mean"),
        }
    )
    df = df.withColumn(
        "paired_architecture_score",
        A.paired_architecture(
            F.col("stem_like_score"), density, l41, l81, longest, F.col("structure_peakiness_score")
        ),
    )
    df = df.withColumn(
        "paired_architecture_score", F.when(p.isNotNull(), F.col("paired_architecture_score"))
    ).withColumn("stem_like_score", F.when(p.isNotNull(), F.col("stem_like_score")))
    df = df.withColumns(
        {
            "is_high_paired_architecture_window": (F.col("paired_architecture_score") >= 0.6).cast("double"),
            **{n: F.lit(None).cast("double") for n in _FOLD_EMPTY},
        }
    )
    return df.drop("_a", "_mean")


def attach_pairing(windows: DataFrame, pairing: DataFrame) -> DataFrame:
    """Left join of vectors on the window key; of equal keys the least vector counts."""
    key = ["transcript_id", "window_start", "window_end"]
    one = pairing.groupBy(*key).agg(F.min("paired").alias("paired"))
    return windows.join(one, key, "left")


def gene_means(top: DataFrame, means: dict[str, Column], maxima: dict[str, Column], keys: Sequence[str] = ("gene_id",)) -> DataFrame:
    """NULL-skipping means and maxima over the kept windows of a gene."""
    return top.groupBy(*keys).agg(
        *[F.avg(c).alias(n) for n, c in means.items()], *[F.max(c).alias(n) for n, c in maxima.items()]
    )


def composition(df: DataFrame, seq: str = "rna_seq") -> DataFrame:
    """Letter shares, entropy and U runs of a sequence: each letter and the runs are counted once, the rest is derived."""
    counted = df.withColumns({f"_n{b}": S.letter_count(seq, b) for b in S.BASES} | {"_length": F.length(seq), "_runs": S.u_runs(seq)})
    length = F.col("_length").cast("double")

    def share(letters: str) -> Column:
        n = sum((F.col(f"_n{b}") for b in letters[1:]), F.col(f"_n{letters[0]}"))
        return F.try_divide(n.cast("double"), length)

    terms = [F.when(share(b) > 0, -share(b) * F.log2(share(b))).otherwise(0.0) for b in S.BASES]
    entropy = F.when(F.col("_length") > 0, sum(terms[1:], terms[0]))
    out = counted.withColumns({f"{x}_content": share(x) for x in ("U", "C", "UC", "AU", "GC")} | {"shannon_entropy": entropy})
    run = F.coalesce(F.array_max("_runs"), F.lit(0))
    words = F.aggregate("_runs", F.lit(0), lambda acc, n: acc + F.greatest(n - 6, F.lit(0)))
    low = F.when(F.col("shannon_entropy").isNotNull(), F.lit(1.0) - F.least(F.col("shannon_entropy") / 2.0, F.lit(1.0)))
    out = out.withColumns({"low_complexity_score": low, "max_homopolymer_U_len": run, "UUUUUUU_count": words})
    return out.drop(*[f"_n{b}" for b in S.BASES], "_length", "_runs")
