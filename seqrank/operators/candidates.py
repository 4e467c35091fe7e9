"""Context score candidates: standardised features blended with the baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.functions.numeric import finite
from seqrank.operators.ranking import average_ranks, quantiles

MAD_TO_SIGMA = 0.67448975  # fixed value


def _stats_lookup(stats: DataFrame, fields: Sequence[str]) -> Column:
    """A few rows (one per feature) as one map value, read by a scalar subquery."""
    entries = F.collect_list(F.struct("feature", F.struct(*fields)))
    return stats.agg(F.map_from_entries(entries)).scalar()


def robust_z(genes: DataFrame, features: Sequence[str], suffix: str = "_z") -> DataFrame:
    """0.6745 (x - median) / MAD per feature; without spread in the MAD the ordinary z, else 0.

    All features are measured together: one long pass for the medians, one for the deviations.
    """
    features = list(features)
    long = genes.select(*[finite(f).alias(f) for f in features]).unpivot([], features, "feature", "x")
    moments = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    center = quantiles(long, ["feature"], "x", {"median": 0.5})
    # as many rows as features
    deviations = long.join(F.broadcast(center), "feature").select(
        "feature", F.abs(F.col("x") - F.col("median")).alias("d")
    )
    spread = quantiles(deviations, ["feature"], "d", {"mad": 0.5})
    stats = moments.join(center, "feature", "left").join(spread, "feature", "left")
    table = genes.withColumn("_stats", _stats_lookup(stats, ["mean", "std", "median", "mad"]))
    out = {}
    for f in features:
        s = F.try_element_at(F.col("_stats"), F.lit(f))
        x = finite(f)
        out[f + suffix] = (
            F.when(s["mad"] > 0, MAD_TO_SIGMA * (x - s["median"]) / s["mad"])
            .when(s["std"] > 0, (x - s["mean"]) / s["std"])
            .otherwise(0.0)
        )
    return table.withColumns(out).drop("_stats")


def context_bonuses(genes: DataFrame, region: bool = True, repeat: bool = True, hairpin: bool = True) -> DataFrame:
    """Baseline z and the region, repeat and hairpin bonuses; a module that is off gives 0."""
    parts = {
        "region": ["top3_UTR_fraction", "top3_ncRNA_fraction", "top3_CDS_fraction"] if region else [],
        "repeat": [
            "top3_inverted_repeat_score_mean",
            "top3_local_self_complementarity_score_mean",
            "top3_reverse_complement_5mer_density_mean",
            "top3_palindrome_score_mean",
        ]
        if repeat
        else [],
        "hairpin": [
            "top3_stem_like_score_mean",
            "top3_structure_peakiness_score_mean",
            "top3_max_local_paired_mean_41nt_mean",
            "top3_paired_run_density_mean",
        ]
        if hairpin
        else [],
    }
    z = robust_z(genes, ["baseline_score", *[f for fs in parts.values() for f in fs]])
    zero = F.lit(0.0)
    bonus = {name: zero for name in parts}
    if region:
        utr, nc, cds = (F.col(f + "_z") for f in parts["region"])
        bonus["region"] = (utr + nc - cds) / 3.0
    for name in ("repeat", "hairpin"):
        if parts[name]:
            zs = [F.col(f + "_z") for f in parts[name]]
            bonus[name] = sum(zs[1:], zs[0]) / float(len(zs))
    return z.select(
        "gene_id",
        "baseline_score",
        F.col("baseline_score_z"),
        *[bonus[n].alias(f"{n}_context_score") for n in parts],
    )


def context_candidates(bonuses: DataFrame, betas: Sequence[float]) -> DataFrame:
    """Every beta combination as one long (gene_id, family, candidate, score) table."""
    rows = [("baseline_score", "baseline_score", None, None, None)]
    for b in betas:
        rows += [
            ("region", f"region__beta_{b}", b, 0.0, 0.0),
            ("repeat", f"repeat__beta_{b}", 0.0, b, 0.0),
            ("hairpin", f"hairpin__beta_{b}", 0.0, 0.0, b),
        ]
        rows += [
            ("all_context", f"all_context__beta_region_{b}__beta_repeat_{r}__beta_hairpin_{h}", b, r, h)
            for r in betas
            for h in betas
        ]
    grid = F.array(
        *[
            F.struct(
                F.lit(f).alias("family"),
                F.lit(c).alias("candidate"),
                *[F.lit(x).cast("double").alias(n) for n, x in (("b1", b1), ("b2", b2), ("b3", b3))],
            )
            for f, c, b1, b2, b3 in rows
        ]
    )
    blend = (
        F.col("baseline_score_z")
        + F.col("b1") * F.col("region_context_score")
        + F.col("b2") * F.col("repeat_context_score")
        + F.col("b3") * F.col("hairpin_context_score")
    )
    return bonuses.select("*", F.inline(grid)).select(
        "gene_id", "family", "candidate", F.when(F.col("b1").isNull(), F.col("baseline_score")).otherwise(blend).alias("score")
    )


def diagnostic_components(genes: DataFrame) -> DataFrame:
    """Components of the wider grid for one number of top windows."""
    features = [
        "baseline_score",
        "topk_UTR_fraction",
        "topk_ncRNA_fraction",
        "topk_CDS_fraction",
        "topk_inferred_UTR_fraction",
        "topk_inferred_ncRNA_fraction",
        "topk_inferred_CDS_fraction",
        "topk_self_complementarity_score_mean",
        "topk_inverted_repeat_score_mean",
        "topk_simple_repeat_penalty_score_mean",
        "topk_paired_architecture_score_mean",
        "max_paired_architecture_score",
        "fraction_high_paired_architecture_windows",
        "topk_max_local_paired_mean_41nt_mean",
        "topk_max_local_paired_mean_81nt_mean",
    ]
    z = robust_z(genes, features)
    c = {f: F.col(f + "_z") for f in features}

    def region(prefix: str) -> Column:
        # Weights of the region component.
        utr, nc, cds = (c[f"topk_{prefix}{part}_fraction"] for part in ("UTR", "ncRNA", "CDS"))
        return (utr + 0.25 * nc - 0.5 * cds) / 1.75

    arch = [c[f] for f in features[10:]]
    return z.select(
        "gene_id",
        "baseline_score",
        c["baseline_score"].alias("baseline_score_z"),
        region("").alias("region_explicit"),
        region("inferred_").alias("region_inferred"),
        c["topk_self_complementarity_score_mean"].alias("self_complementarity"),
        c["topk_inverted_repeat_score_mean"].alias("inverted_repeat"),
        c["topk_simple_repeat_penalty_score_mean"].alias("simple_repeat_penalty"),
        (sum(arch[1:], arch[0]) / 5.0).alias("paired_architecture"),
    )


REPEAT_VARIANTS = {
    "self_complementarity": (1.0, 0.0, 0.0),
    "inverted_repeat": (0.0, 1.0, 0.0),
    "minus_simple_repeat_penalty": (0.0, 0.0, -1.0),
    "self_complementarity_minus_simple_repeat_penalty": (1.0, 0.0, -1.0),
}


def diagnostic_candidates(components: DataFrame, betas: Sequence[float], k: int) -> DataFrame:
    """Raw components and all blends, long: family, variant, region_mode, candidate, score.

    A candidate is a row of weights over (baseline, baseline z, two regions, three repeats,
    pairing), so the whole grid is one array of weights applied to each gene.
    """
    names = [
        "baseline_score",
        "baseline_score_z",
        "region_explicit",
        "region_inferred",
        "self_complementarity",
        "inverted_repeat",
        "simple_repeat_penalty",
        "paired_architecture",
    ]
    grid: list[tuple[str, str, str, str, dict[str, float]]] = [("baseline", "", "", "baseline_score", {"baseline_score": 1.0})]
    for mode in ("explicit", "inferred"):
        grid.append(("region_raw", "", mode, f"region_{mode}__k_{k}", {f"region_{mode}": 1.0}))
    for raw in ("self_complementarity", "inverted_repeat"):
        grid.append(("self_complementarity_raw", raw, "", f"{raw}__k_{k}", {raw: 1.0}))
    grid.append(
        ("paired_architecture_raw", "paired_architecture", "", f"paired_architecture__k_{k}", {"paired_architecture": 1.0})
    )

    def repeat_weights(variant: str, beta: float) -> dict[str, float]:
        return dict(zip(names[4:7], [beta * w for w in REPEAT_VARIANTS[variant]], strict=True))

    base = {"baseline_score_z": 1.0}
    for b in betas:
        for mode in ("explicit", "inferred"):
            grid.append(("region", "", mode, f"region__{mode}__k_{k}__beta_{b}", {**base, f"region_{mode}": b}))
        for variant in REPEAT_VARIANTS:
            grid.append(
                ("self_complementarity", variant, "", f"repeat__{variant}__k_{k}__beta_{b}", {**base, **repeat_weights(variant, b)})
            )
        grid.append(
            (
                "paired_architecture",
                "paired_architecture",
                "",
                f"paired__k_{k}__beta_{b}",
                {**base, "paired_architecture": b},
            )
        )
        for r in betas:
            for h in betas:
                for variant in REPEAT_VARIANTS:
                    weights = {**base, "region_inferred": b, **repeat_weights(variant, r), "paired_architecture": h}
                    grid.append(
                        ("all_context", variant, "inferred", f"all__k_{k}__region_{b}__repeat_{r}__hairpin_{h}__{variant}", weights)
                    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("family"),
                F.lit(variant).alias("module_variant"),
                F.lit(mode).alias("region_mode"),
                F.lit(c).alias("candidate"),
                F.array(*[F.lit(float(w.get(n, 0.0))) for n in names]).alias("w"),
            )
            for f, variant, mode, c, w in grid
        ]
    )
    values = F.array(*[F.col(n) for n in names])
    terms = F.zip_with("w", values, lambda w, x: F.when(w == 0.0, F.lit(0.0)).otherwise(w * x))
    score = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return components.select("*", F.inline(cells)).select(
        "gene_id", F.lit(int(k)).alias("top_window_k"), "family", "module_variant", "region_mode", "candidate", score.alias("score")
    )


def two_branch(genes: DataFrame, a: str, b_features: Sequence[str]) -> DataFrame:
    """Percentile rank of ``a`` (A), mean percentile rank of the features (B) and four blends, long.

    All columns are ranked in one pass over the unpivoted table.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), finite(f).alias("_x")) for i, f in enumerate([a, *b_features])])
    ranked = average_ranks(genes.select("gene_id", F.inline(cells)), ["_i"], "_x", "_p", pct=True)
    first = F.col("_i") == 0
    ranked = ranked.groupBy("gene_id").agg(F.max(F.when(first, F.col("_p"))).alias("A"), F.avg(F.when(~first, F.col("_p"))).alias("B"))
    A, B = F.col("A"), F.col("B")
    # Blends of the two branches.
    blends = {
        "A_branch_score": A,
        "B_branch_score": B,
        "final_score_max": F.greatest(A, B),
        "final_score_0.7A_0.3B": 0.7 * A + 0.3 * B,
        "final_score_0.5A_0.5B": 0.5 * A + 0.5 * B,
        "final_score_0.3A_0.7B": 0.3 * A + 0.7 * B,
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("score_variant"), x.alias("score")) for n, x in blends.items()])
    return ranked.select("gene_id", F.inline(pairs))
