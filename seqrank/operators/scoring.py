"""Window scores: base scorer, robust scaling and score ablations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.functions.numeric import finite, sigmoid
from seqrank.functions.sequence import letter_fraction
from seqrank.functions.structure import pairing_statistics, structure_signal
from seqrank.operators.ranking import quantiles
from seqrank.session import durable

ABLATIONS = [
    "base_score",
    "inverted_base_score",
    "motif_only_score",
    "structure_only_score",
    "motif_structure_score",
    "base_motif_score",
    "inverted_base_motif_score",
    "base_motif_structure_score",
    "inverted_base_motif_structure_score",
]
_TINY = 1e-6  # fixed value: smaller spreads count as none


def linear_logit(weights: dict[str, float], bias: float = 0.0, seq: str = "rna_seq") -> Column:
    """Default base scorer: a weighted sum of base shares."""
    out = F.lit(float(bias))
    for letter, weight in weights.items():
        out = out + F.lit(float(weight)) * letter_fraction(seq, letter)
    return out


def apply_scorer(
    windows: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray], out: str = "base_logit"
) -> DataFrame:
    """Logits from any batch scorer (for example a model loaded inside the function)."""
    schema = ", ".join(f"`{n}` {t}" for n, t in windows.dtypes) + f", {out} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: np.asarray(scorer(batch), dtype=float)})

    return windows.mapInPandas(run, schema)


def base_columns(df: DataFrame, joint: bool = False) -> DataFrame:
    """Scores of the base logit, and of joint_logit when the scorer gives one."""
    df = df.withColumns({"base_score": sigmoid("base_logit")})
    df = df.withColumns({"inverted_base_score": 1.0 - F.col("base_score")})
    joint_logit = finite("joint_logit") if joint else F.lit(None).cast("double")
    df = df.withColumns({"joint_logit": joint_logit, "joint_score": sigmoid(joint_logit)})
    return df.withColumns({"score_delta_joint_minus_base": F.col("joint_score") - F.col("base_score")})


def robust_scale(df: DataFrame, raw: str, score: str, center: str, scale: str, keys: Sequence[str] = ("rbp_id",)) -> DataFrame:
    """(x - median) / IQR per key; the spread falls back to the population deviation, then to 1."""
    return robust_scales(df, [(raw, score, center, scale)], keys)


def robust_scales(df: DataFrame, columns: Sequence[tuple[str, str, str, str]], keys: Sequence[str] = ("rbp_id",)) -> DataFrame:
    """:func:`robust_scale` for several (raw, score, center, scale) columns, whose statistics are taken together."""
    keys = list(keys)
    values = F.array(*[F.struct(F.lit(raw).alias("_name"), finite(raw).alias("_x")) for raw, *_ in columns])
    long = df.select(*keys, F.inline(values))
    by = [*keys, "_name"]
    q = quantiles(long, by, "_x", {"_q25": 0.25, "_mid": 0.5, "_q75": 0.75})
    spread = long.groupBy(*by).agg(F.stddev_pop("_x").alias("_std"))
    width = F.col("_q75") - F.col("_q25")
    stats = q.join(spread, by).select(
        *by, "_mid", F.when(width >= _TINY, width).when(F.col("_std") >= _TINY, F.col("_std")).otherwise(1.0).alias("_scale")
    )

    def of(raw: str, column: str) -> Column:
        return F.max(F.when(F.col("_name") == raw, F.col(column)))

    wide = stats.groupBy(*keys).agg(*[of(raw, "_mid").alias(c) for raw, _, c, _ in columns], *[of(raw, "_scale").alias(s) for raw, _, _, s in columns])
    # one row a key in a table: its size is known before the windows are exchanged for the join
    out = df.join(durable(wide), keys, "left")
    return out.withColumns({score: (finite(raw) - F.col(center)) / F.col(scale) for raw, score, center, scale in columns})


def add_pairing_statistics(df: DataFrame, paired: str = "paired", mode: str = "combined") -> DataFrame:
    return df.withColumns(pairing_statistics(paired)).withColumn("structure_match_raw", structure_signal(mode))


def ablate(df: DataFrame, motif_alpha: float, structure_alpha: float) -> DataFrame:
    """Sigmoid of every signed combination of base logit, motif and structure scores."""
    b = finite("base_logit")
    m = F.lit(float(motif_alpha)) * finite("motif_match_score")
    s = F.lit(float(structure_alpha)) * finite("structure_match_score")
    logits = {
        "base_score": b,
        "motif_only_score": m,
        "structure_only_score": s,
        "motif_structure_score": m + s,
        "base_motif_score": b + m,
        "inverted_base_motif_score": -b + m,
        "base_motif_structure_score": b + m + s,
        "inverted_base_motif_structure_score": -b + m + s,
    }
    df = df.withColumns({name: sigmoid(logit) for name, logit in logits.items()})
    return df.withColumn("inverted_base_score", 1.0 - F.col("base_score"))


def posthoc(df: DataFrame, motif_alpha: float, structure_alpha: float | None = None) -> DataFrame:
    """Base logit shifted by the motif (and structure) score, its sigmoid and change to the base."""
    logit = F.col("base_logit") + F.lit(float(motif_alpha)) * F.col("motif_match_score")
    if structure_alpha is not None:
        logit = logit + F.lit(float(structure_alpha)) * F.col("structure_match_score")
    df = df.withColumn("posthoc_logit", logit).withColumn("posthoc_score", sigmoid("posthoc_logit"))
    return df.withColumn("score_delta_posthoc_minus_base", F.col("posthoc_score") - F.col("base_score"))


def primary_score(use_posthoc: bool, use_joint: bool) -> str:
    """Column that ranks windows for the chosen inputs."""
    return "posthoc_score" if use_posthoc else "joint_score" if use_joint else "base_score"


def restrict_to_proteins(windows: DataFrame, proteins: DataFrame) -> DataFrame:
    """Pair windows with proteins given as (rbp_id, query_id).

    Rows that carry an rbp_id meet the protein whose id or query id equals it; windows without
    that column meet every protein of the (short) list.
    """
    names = proteins.withColumn("_name", F.explode(F.array_distinct(F.array("rbp_id", "query_id"))))
    if "rbp_id" in windows.columns:
        own = names.select(F.col("rbp_id").alias("_rbp"), "query_id", "_name")
        return (
            windows.join(own, windows["rbp_id"] == own["_name"])
            .drop("rbp_id", "_name")
            .withColumnRenamed("_rbp", "rbp_id")
        )
    listed = proteins.agg(F.collect_list(F.struct("rbp_id", "query_id"))).scalar()
    return windows.select("*", F.explode(listed).alias("_p")).select(*windows.columns, "_p.rbp_id", "_p.query_id")
