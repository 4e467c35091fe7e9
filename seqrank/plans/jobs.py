"""The jobs a user runs, from files to ranked genes, calibration and reports.

Tables that several later steps read (scored windows, gene tables, enrichment rows) are written once
to the checkpoint folder and read back, so that nothing upstream is computed twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.functions import sequence as S
from seqrank.functions import structure as A
from seqrank.functions.numeric import finite, rounded
from seqrank.operators import bias, candidates, enrichment, features, genes, regions, scoring, supervised
from seqrank.operators.motif import rich_u_kmers, scan_windows
from seqrank.operators.repeats import add_repeat_features
from seqrank.operators.windows import attach_genes, tile
from seqrank.session import durable
from seqrank.sources.annotation import read_annotation
from seqrank.sources.fasta import read_fasta

PRIMARY = "inverted_base_motif_structure_score"


def build_gene_map(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Transcript-to-gene pairs of an annotation file; fails when there are none."""
    pairs = regions.gene_map(read_annotation(spark, path, fmt), fmt)
    if pairs.isEmpty():
        raise ValueError(f"no transcript-gene pairs in {path}")
    return pairs


def build_windows(spark: SparkSession, fasta_path: str, gene_map: DataFrame, size: int = 200, stride: int = 50) -> DataFrame:
    """Window table of all transcripts that have a gene."""
    rows = tile(attach_genes(read_fasta(spark, fasta_path), gene_map), size, stride)
    return rows.select("gene_id", "transcript_id", "window_start", "window_end", "rna_seq")


def score_windows(
    windows: DataFrame,
    profiles: DataFrame,
    base_logit: Column,
    pairing: DataFrame | None = None,
    motif_alpha: float = 0.6,
    structure_alpha: float = 0.3,
    structure_mode: str = "combined",
) -> DataFrame:
    """Every window under every profile with all component and combined scores."""
    rows = windows.withColumn("base_logit", base_logit)
    if pairing is not None:
        rows = scoring.add_pairing_statistics(features.attach_pairing(rows, pairing), mode=structure_mode).drop("paired")
    rows = durable(scan_windows(rows, profiles))
    rows = scoring.robust_scale(
        rows, "motif_match_top_mean_zscore", "motif_match_score", "motif_match_center", "motif_match_scale"
    )
    if pairing is not None:
        rows = scoring.robust_scale(
            rows, "structure_match_raw", "structure_match_score", "structure_match_center", "structure_match_scale"
        )
    else:
        rows = rows.withColumn("structure_match_score", F.lit(None).cast("double"))
    rows = scoring.ablate(scoring.base_columns(rows), motif_alpha, structure_alpha)
    return durable(scoring.posthoc(rows, motif_alpha, structure_alpha if pairing is not None else None))


def rank_genes(scored: DataFrame, score: str = PRIMARY) -> tuple[DataFrame, DataFrame]:
    """Gene table of one score, and its six rankings in one long table."""
    table = durable(genes.aggregate_genes(scored, score))
    return table, genes.ranking_views(table)


def baseline_run(
    table: DataFrame, truth: DataFrame, seeds: Sequence[int], aggregation: str = "top3_mean_score", ks: Sequence[int] = enrichment.TOP_KS
) -> dict[str, DataFrame]:
    """Baseline ranking, enrichment on the full and on held-out truth, and audits at 200 and 1000."""
    base = durable(genes.baseline_table(table, PRIMARY, aggregation))
    known = durable(enrichment.comparable_truth(truth, base))
    splits = durable(enrichment.truth_splits(known, seeds))
    audits = [enrichment.audit_groups(base, known, "baseline_score", k) for k in (200, 1000)]
    return {
        "ranking": base,
        "full_truth": enrichment.topk_enrichment(base, known, "baseline_score", ks),
        "heldout": enrichment.fixed_score_validation(base, "baseline_score", splits, ks),
        "audit": audits[0].unionByName(audits[1]),
    }


def window_modules(
    top: DataFrame,
    annotation: DataFrame | None,
    pairing: DataFrame | None,
    version: str = "v2_1",
    region: bool = True,
    repeat: bool = True,
    hairpin: bool = True,
) -> DataFrame:
    """Region, repeat and pairing features of selected windows. Modules that are off, or lack their
    input, give NULL."""
    rows = regions.annotate_windows(top, annotation, region)
    rows = add_repeat_features(rows, version=version, enabled=repeat)
    if hairpin and pairing is not None:
        return features.hairpin_columns(features.attach_pairing(rows, pairing), "paired").drop("paired")
    return features.hairpin_columns(rows, None)


_TOP3_MEANS = {
    "top3_inverted_repeat_score_mean": "inverted_repeat_score",
    "top3_palindrome_score_mean": "palindrome_score",
    "top3_reverse_complement_4mer_density_mean": "reverse_complement_4mer_density",
    "top3_reverse_complement_5mer_density_mean": "reverse_complement_5mer_density",
    "top3_reverse_complement_6mer_density_mean": "reverse_complement_6mer_density",
    "top3_local_self_complementarity_score_mean": "local_self_complementarity_score",
    "top3_simple_repeat_score_mean": "simple_repeat_score",
    "top3_stem_like_score_mean": "stem_like_score",
    "top3_structure_peakiness_score_mean": "structure_peakiness_score",
    "top3_longest_high_paired_run_mean": "longest_high_paired_run",
    "top3_paired_run_density_mean": "paired_run_density",
    "top3_max_local_paired_mean_41nt_mean": "max_local_paired_mean_41nt",
    "top3_max_local_paired_mean_81nt_mean": "max_local_paired_mean_81nt",
}
_TOP3_MAXIMA = {"max_stem_like_score": "stem_like_score", "max_longest_high_paired_run": "longest_high_paired_run"}


def context_features(modules: DataFrame, base: DataFrame) -> DataFrame:
    """Baseline genes with region shares, 13 means and 2 maxima over their three best windows."""
    top = modules.where("window_rank <= 3")
    means = features.gene_means(
        top, {n: F.col(c) for n, c in _TOP3_MEANS.items()}, {n: F.col(c) for n, c in _TOP3_MAXIMA.items()}
    )
    return base.join(regions.region_summary(top), "gene_id", "left").join(means, "gene_id", "left")


_DIAGNOSTIC_MEANS = (
    "self_complementarity_score",
    "inverted_repeat_score",
    "simple_repeat_score",
    "simple_repeat_penalty_score",
    "reverse_complement_4mer_density",
    "reverse_complement_5mer_density",
    "reverse_complement_6mer_density",
    "paired_architecture_score",
    "stem_like_score",
    "paired_run_density",
    "max_local_paired_mean_31nt",
    "max_local_paired_mean_41nt",
    "max_local_paired_mean_81nt",
    "longest_high_paired_run",
)


def diagnostic_features(modules: DataFrame, base: DataFrame, ks: int | Sequence[int]) -> DataFrame:
    """Baseline genes with the wider feature set over their ``k`` best windows, a row for each gene and k.

    The best windows of a smaller k are among those of a larger one: one pass over the windows fills the sums of every k.
    """
    ks = [ks] if isinstance(ks, int) else list(ks)
    means = {**regions.region_shares("topk"), **{f"topk_{n}_mean": F.col(n) for n in _DIAGNOSTIC_MEANS}}
    means["fraction_high_paired_architecture_windows"] = F.col("is_high_paired_architecture_window")
    figures = []
    for k in ks:
        inside = F.col("window_rank") <= k
        figures += [F.avg(F.when(inside, c)).alias(f"_{k}_{n}") for n, c in means.items()]
        figures.append(F.max(F.when(inside, F.col("paired_architecture_score"))).alias(f"_{k}_max_paired_architecture_score"))
    best = regions.best_window_region()
    wide = modules.where(F.col("window_rank") <= max(ks)).groupBy("gene_id").agg(*best, *figures)
    names = [*means, "max_paired_architecture_score"]
    per_k = F.array(*[F.struct(F.lit(int(k)).alias("top_window_k"), *[F.col(f"_{k}_{n}").alias(n) for n in names]) for k in ks])
    kept = [c for c in wide.columns if c.startswith("best_window_")]
    long = wide.select("gene_id", *kept, F.inline(per_k))
    genes_by_k = base.withColumn("top_window_k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    return genes_by_k.join(long, ["gene_id", "top_window_k"], "left")


def context_calibration(
    grid: DataFrame, truth: DataFrame, seeds: Sequence[int], fraction: float = 0.7, ks: Sequence[int] = enrichment.TOP_KS
) -> dict[str, DataFrame]:
    """Selects a candidate per seed and family on calibration truth and reports held-out results.

    ``grid`` is the long candidate table (gene_id, family, candidate, score). Every candidate and
    seed is evaluated in the same job.
    """
    if not {200, 500} <= set(ks):
        raise ValueError("selection needs K = 200 and K = 500")
    grid = durable(grid)
    known = durable(enrichment.comparable_truth(truth, grid))
    splits = enrichment.truth_splits(known, seeds, fraction)
    rows = durable(enrichment.topk_enrichment(grid, splits, "score", ks, ["family", "candidate"], ["seed", "role"]))
    chosen = durable(
        enrichment.best_by_top200(rows.where("role = 'calibration'"), ["seed", "family"], "candidate")
    )
    picked = chosen.select("seed", "family", "candidate")
    heldout = rows.where("role = 'heldout'").join(picked, ["seed", "family", "candidate"])
    modal = enrichment.modal_value(picked, ["family"], "candidate", "seed")
    oracle = enrichment.topk_enrichment(
        grid.join(modal, ["family", "candidate"], "left_semi"), known, "score", ks, ["family", "candidate"]
    )
    return {"selected": chosen, "heldout": heldout, "modal": modal, "oracle": oracle}


def calibration_run(
    scored: DataFrame,
    scores: Sequence[str],
    truth: DataFrame,
    seeds: Sequence[int],
    ks: Sequence[int] = enrichment.TOP_KS,
    ties: Sequence[str] = genes.TIES,
    digits: int | None = None,
) -> dict[str, DataFrame]:
    """Scores times aggregations on random truth splits, selected at Top1000, with a held-out summary.

    With ``digits``, gene scores are compared at that many decimals, so that no rank hangs on the last bits of a mean.
    """
    table = durable(genes.aggregate_scores(scored, scores))
    names = [c for c in genes.RANKINGS.values() if c != "window_count_adjusted_score"]
    grid = durable(_at_digits(table.unpivot(["score_name", "gene_id"], names, "aggregation", "score"), digits))
    splits = enrichment.truth_splits(enrichment.comparable_truth(truth, table), seeds)
    rows = durable(enrichment.topk_enrichment(grid, splits, "score", ks, ["score_name", "aggregation"], ["seed", "role"]))
    keys = ["score_name", "aggregation"]
    best = enrichment.best_by_top1000(rows.where("role = 'calibration'"), ["seed"], keys)
    objectives = enrichment.best_per_objective(rows.where("role = 'calibration'"), ["seed"], keys)
    heldout = rows.where("role = 'heldout'").join(best.select("seed", *keys), ["seed", *keys])
    return {
        "rows": rows,
        "selected": best,
        "objectives": objectives,
        "summary": enrichment.summarise_splits(heldout, [*keys, "top_k"]),
    }


# Window columns averaged over the three (and five) best windows of a gene.
_EXTRA_MEANS = {
    "motif_positive_fraction_top3_mean": "motif_positive_fraction",
    "top3_paired_probability_mean": "paired_probability_mean",
    "top3_fraction_high_paired": "fraction_high_paired",
    "local_41nt_paired_mean_top3": "max_local_paired_mean_41nt",
    "local_81nt_paired_mean_top3": "max_local_paired_mean_81nt",
    "paired_run_density_top3": "paired_run_density",
    "reverse_complement_kmer_pair_density_top3": "reverse_complement_6mer_density",
    "AU_rich_paired_density_top3": "AU_rich_paired_density",
    "U_rich_paired_density_top3": "U_rich_paired_density",
    "U_content_top3": "U_content",
    "UC_content_top3": "UC_content",
    "AU_content_top3": "AU_content",
    "shannon_entropy_top3": "shannon_entropy",
    "low_complexity_score_top3": "low_complexity_score",
    "top_Urich_kmer_density_top3": "top_Urich_kmer_density",
}
_EXTRA_MAXIMA = {
    "longest_high_paired_run_max": "longest_high_paired_run",
    "max_U_homopolymer_len_max": "max_homopolymer_U_len",
    "UUUUUUU_count_max": "UUUUUUU_count",
}


def gene_feature_table(
    scored: DataFrame, pairing: DataFrame, rich_words: Sequence[str], score: str = PRIMARY, bins: int = 20, rc_k: int = 4
) -> DataFrame:
    """The forty gene features used for supervised calibration (one protein).

    Sequence and pairing features are computed for the five best windows only; the rest are plain
    aggregates over all windows.
    """
    table = genes.aggregate_genes(scored, score, ["gene_id"], best=("transcript_id",))
    extremes = genes.window_count_features(genes.window_extremes(scored, score)).drop("n_windows")
    top = durable(genes.top_windows(scored, score, 5))
    rows = features.hairpin_columns(features.attach_pairing(top, pairing), "paired")
    rows = features.composition(add_repeat_features(rows))
    words = S.kmers("rna_seq", 7)
    rows = rows.withColumns(
        {
            "max_homopolymer_U_len": F.col("max_homopolymer_U_len").cast("double"),
            "UUUUUUU_count": F.col("UUUUUUU_count").cast("double"),
            "top_Urich_kmer_density": S.density_in(words, S.rich_words(rich_words)),
            "AU_rich_paired_density": A.rich_paired_density("rna_seq", "paired", "AU", 6),
            "U_rich_paired_density": A.rich_paired_density("rna_seq", "paired", "U", 5),
        }
    )
    rc = f"reverse_complement_{rc_k}mer_density"
    three = F.col("window_rank") <= 3
    means = {n: F.when(three, F.col(rc if c == "reverse_complement_6mer_density" else c)) for n, c in _EXTRA_MEANS.items()}
    for n in (3, 5):
        inside = F.col("window_rank") <= n
        means[f"mean_top{n}_inverted_base_score"] = F.when(inside, F.col("inverted_base_score"))
        means[f"top{n}_motif_score"] = F.when(inside, F.col("motif_match_score"))
        means[f"top{n}_structure_score"] = F.when(inside, F.col("structure_match_raw"))
    maxima = {n: F.when(three, F.col(c)) for n, c in _EXTRA_MAXIMA.items()}
    detail = features.gene_means(rows, {n: finite(c) for n, c in means.items()}, maxima)
    out = durable(table.join(extremes, "gene_id").join(detail, "gene_id", "left"))
    return bias.add_bins(out, "n_windows", bins, "n_windows_bin_code")


def feature_calibration(
    table: DataFrame,
    feature_names: Sequence[str],
    truth: DataFrame,
    seeds: Sequence[int],
    score: str = "top3_mean_score",
    ks: Sequence[int] = enrichment.TOP_KS,
) -> dict[str, DataFrame]:
    """Per seed and model: predictions for all genes, enrichment on both truth parts, coefficients and their importance.

    All seeds and both models are drawn, fitted and evaluated together.
    """
    table = durable(table)
    splits = durable(enrichment.truth_splits(enrichment.comparable_truth(truth, table), seeds))
    roles = durable(supervised.training_roles(table, splits, score, "n_windows_bin_code"))
    rows, stats = supervised.standardised(table, roles, feature_names)
    models = supervised.fit_models(rows, len(feature_names))
    scores = durable(supervised.predict(models, table, stats, feature_names))
    # a model's scores meet its own seed's truth parts only
    per_seed = [
        enrichment.topk_enrichment(scores.where(F.col("seed") == s).drop("seed"), splits.where(F.col("seed") == s), "prediction_score", ks, ["model_name"], ["seed", "role"]) for s in seeds
    ]
    coefficients = supervised.coefficients(models, table.sparkSession, feature_names)
    return {
        "metrics": reduce(DataFrame.unionByName, per_seed),
        "predictions": scores.join(roles, ["seed", "gene_id"]),
        "coefficients": coefficients,
        "importance": supervised.importance(coefficients),
    }


def _at_digits(rows: DataFrame, digits: int | None) -> DataFrame:
    return rows if digits is None else rows.withColumn("score", rounded("score", digits))


def two_branch_validation(
    table: DataFrame, structure_features: Sequence[str], truth: DataFrame, seeds: Sequence[int], ks: Sequence[int] = enrichment.TOP_KS, digits: int | None = None
) -> DataFrame:
    """Held-out enrichment of the six two-branch scores; ``digits`` as in :func:`calibration_run`."""
    variants = durable(_at_digits(candidates.two_branch(table, "top3_mean_score", structure_features), digits))
    splits = enrichment.truth_splits(enrichment.comparable_truth(truth, table), seeds)
    return enrichment.fixed_score_validation(variants, "score", splits, ks, ["score_variant"])


#: Annotations of the audit that no job fills: typed columns without a value.
UNFILLED = ("region_annotation", "repeat_annotation", "utr_annotation", "intron_annotation", "mirna_annotation")


def false_positive_audit(
    table: DataFrame, truth: DataFrame, windows: DataFrame, pairing: DataFrame, top_kmers: DataFrame, k: int = 1000, score: str = "top3_mean_score"
) -> DataFrame:
    """True and false positives among the ``k`` best genes, and missed truth, with features of each gene's best window.

    ``table`` has the genes with transcript_id, best_window_start and best_window_end, ``windows`` the sequences, ``top_kmers`` the protein's
    k-mers with direction, zscore and rank, from which the U-rich words are taken. A best window without a vector has NULL pairing features.
    Only audited genes' windows are measured.
    """
    ranked = genes.rank_rows(table, [], [F.col(score).desc_nulls_last(), F.col("gene_id")], "audit_rank", -F.col(score))
    audited = enrichment.audit_groups(ranked, truth, score, k).where("audit_group <> 'background'").withColumnRenamed(score, "ranking_score")
    key = {"window_start": F.col("best_window_start"), "window_end": F.col("best_window_end")}
    rows = durable(audited.withColumns(key).join(windows.select("transcript_id", "window_start", "window_end", "rna_seq"), ["transcript_id", "window_start", "window_end"], "left"))
    words = [r.kmer for r in rich_u_kmers(top_kmers).collect()]  # twenty at most
    rows = features.hairpin_columns(features.attach_pairing(rows, pairing), "paired")
    rows = features.composition(add_repeat_features(rows)).withColumns(
        {
            "top_Urich_kmer_density": S.density_in(S.kmers("rna_seq", 7), words),
            "AU_rich_paired_density": A.rich_paired_density("rna_seq", "paired", "AU", 6),
            "U_rich_paired_density": A.rich_paired_density("rna_seq", "paired", "U", 5),
            **{c: F.lit(None).cast("string") for c in UNFILLED},
        }
    )
    return rows.drop("paired", "window_start", "window_end", "top_k_group").withColumnRenamed("rna_seq", "best_window_seq")


def bias_report(table: DataFrame, truth: DataFrame, score: str = "top3_mean_score", bins: int = 20, ks: Sequence[int] = enrichment.TOP_KS) -> DataFrame:
    """Enrichment and window-count correlation before and after the bin adjustment."""
    adjusted = durable(bias.bin_adjust(table, "n_windows", score, bins))
    pairs = F.array(
        F.struct(F.lit("raw").alias("comparison"), F.col(score).alias("score")),
        F.struct(F.lit("bin_adjusted").alias("comparison"), F.col("bin_adjusted_percentile").alias("score")),
    )
    long = durable(adjusted.select("gene_id", "n_windows", F.inline(pairs)))
    rows = enrichment.topk_enrichment(long, truth, "score", ks, ["comparison"])
    corr = bias.correlations(long, ["comparison"], "n_windows", "score").drop("n_genes")
    return rows.join(corr, "comparison")
