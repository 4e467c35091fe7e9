"""Motif words, their k-mer clusters, and the quality of predicted k-mer profiles.

Every table here is keyed by (protein, k-mer) and so holds at most 4**7 rows per protein; windows
per protein are bounded by that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrank.functions.labels import (
    FAILURE_MODES,
    HARD_FAILURE,
    OTHER_FAILURE,
    PUMILIO_PROTEINS,
    REPORTED_PROTEIN,
    RETAINED_PROTEINS,
    UNSCORED_EXPECTATIONS,
    VALIDATION_PROTEINS,
    collapse_status,
    is_control,
    motif_group,
)
from seqrank.operators.bias import binary_metrics
from seqrank.operators.motif import vocabulary
from seqrank.operators.ranking import rank_bounded

MISSING_SCORE = -5.0  # fixed value: score of a k-mer without prediction
CLUSTER_TOP = 100


def expand_word(word: Column) -> Column:
    """All spellings of a word over ACGU and N; empty for other letters. Four for each N: give it short words."""
    letters = F.filter(F.split(word, ""), lambda x: x != "")

    def grow(acc: Column, letter: Column) -> Column:
        options = F.when(letter == "N", F.array(*[F.lit(b) for b in "ACGU"])).otherwise(F.array(letter))
        return F.flatten(F.transform(acc, lambda p: F.transform(options, lambda o: F.concat(p, o))))

    start = F.array(F.lit("")).cast("array<string>")
    return F.when(word.rlike("^[ACGUN]+$"), F.aggregate(letters, start, grow)).otherwise(F.array().cast("array<string>"))


def _spelled(pieces: Column) -> Column:
    """Distinct spellings of k-letter pieces: at most 4**k."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(pieces), expand_word)))


def compatible_kmers(word: Column, k: int) -> Column:
    """K-mers that equal a spelling, contain it, or are part of it.

    The word is cut into pieces of k letters, or filled up to k with N, before an N is spelled out, so that
    the number of N in it doesn't matter.
    """
    n = F.length(word)

    def filled(left: Column) -> Column:
        return F.concat(F.repeat(F.lit("N"), left), word, F.repeat(F.lit("N"), k - n - left))

    fills = F.transform(F.sequence(F.lit(0), F.greatest(k - n, F.lit(0))), filled)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))
    plain = word.rlike("^[ACGUN]+$")
    return F.when(plain, _spelled(F.when(n < k, fills).otherwise(parts))).otherwise(F.array().cast("array<string>"))


def shifted_kmers(word: Column, k: int) -> Column:
    """Parts of longer spellings shifted by one or two, kept inside the word."""
    room = F.length(word) - k
    deltas = F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])
    moved = F.transform(deltas, lambda d: F.substring(word, F.greatest(F.least(room, d), F.lit(0)) + 1, F.lit(k)))
    return F.when((room > 0) & word.rlike("^[ACGUN]+$"), _spelled(moved)).otherwise(F.array().cast("array<string>"))


def hamming_kmers(kmer: Column, k: int) -> Column:
    """K-mers that differ in exactly one letter."""
    spots = F.sequence(F.lit(1), F.lit(k))
    bases = F.array(*[F.lit(b) for b in "ACGU"])
    changed = F.flatten(
        F.transform(spots, lambda i: F.transform(bases, lambda b: F.overlay(kmer, b, i, F.lit(1))))
    )
    return F.array_distinct(F.filter(changed, lambda x: x != kmer))


def anchor_cores(word: Column) -> Column:
    """Plain stretches of 4 to 6 letters inside a word."""
    n = F.length(word)
    cores = F.flatten(
        F.transform(
            F.array(*[F.lit(s) for s in (4, 5, 6)]),
            lambda size: F.when(
                n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(word, i, size))
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.array_distinct(F.filter(cores, lambda c: c.rlike("^[ACGU]+$")))


def clusters(words: DataFrame, ks: Sequence[int] = (6, 7)) -> DataFrame:
    """Weighted k-mers of each (rbp_id, token): strong 1.0 or 0.7, one-letter neighbours 0.35.

    Counting per protein is left to the caller; :func:`cluster_rules` does it per rule.
    """
    token = F.col("token")
    kind = F.when((F.length(token) > 7) | token.contains("N"), "long_or_degenerate_motif").otherwise("direct_token")
    # words recur between proteins, so each is expanded once and joined back
    base = words.select("token").distinct()
    base = base.withColumns({"source_type": kind, "_cores": anchor_cores(token)})
    out = None
    for k in ks:
        pool = F.array_union(compatible_kmers(token, k), shifted_kmers(token, k))
        strong = base.withColumn("kmer", F.explode(pool))
        cored = F.exists("_cores", lambda c: F.col("kmer").contains(c))
        strong = strong.withColumn("weight", F.when(cored, 1.0).otherwise(0.7)).drop("_cores")
        near = strong.withColumn("kmer", F.explode(hamming_kmers(F.col("kmer"), k))).withColumn("weight", F.lit(0.35))
        keys = ["token", "source_type", "kmer"]
        both = strong.unionByName(near).groupBy(*keys).agg(F.max("weight").alias("weight"))
        part = both.withColumns({"k": F.lit(k), "is_strong": F.col("weight") > 0.5})
        out = part if out is None else out.unionByName(part)
    return words.select("rbp_id", "token").distinct().join(out, "token")


def cluster_rules(clustered: DataFrame) -> DataFrame:
    """Number of strong and of weak-only k-mers per rule."""
    return clustered.groupBy("rbp_id", "token", "k", F.col("source_type").alias("rule_type")).agg(
        F.count_if("is_strong").alias("strong_positive_count"), F.count_if(~F.col("is_strong")).alias("weak_positive_count")
    )


def six_from_seven(scores: DataFrame, key: str = "rbp_id", value: str = "score", missing: float | None = MISSING_SCORE) -> DataFrame:
    """6-mer scores as the best score of the 7-mers that contain them at either end."""
    ends = F.explode(F.array(F.substring("kmer", 1, 6), F.substring("kmer", 2, 6)))
    best = scores.select(key, ends.alias("kmer"), value).groupBy(key, "kmer").agg(F.max(value).alias(value))
    return best if missing is None else fill_vocabulary(best, 6, key, value, missing)


def fill_vocabulary(scores: DataFrame, k: int, key: str = "rbp_id", value: str = "score", missing: float = MISSING_SCORE) -> DataFrame:
    """One row for each of the 4**k k-mers of every protein."""
    every = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(4**k - 1).cast("bigint")), lambda i: i)
    names = scores.select(key).distinct().withColumn("kmer_idx", F.explode(every))
    named = names.join(F.broadcast(vocabulary(scores.sparkSession, k)), "kmer_idx")  # 4**k rows
    return named.join(scores.select(key, "kmer", value), [key, "kmer"], "left").withColumn(
        value, F.coalesce(value, F.lit(missing))
    )


def truth_profile(truth: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """(rbp_id, k, kmer, truth_score): listed 7-mers, their 6-mers, listed 6-mers and cluster weights."""
    rows = truth.select("rbp_id", "kmer", "truth_score")
    seven = rows.where(F.length("kmer") == 7)
    six = six_from_seven(seven, value="truth_score", missing=None).unionByName(rows.where(F.length("kmer") == 6))
    out = seven.withColumn("k", F.lit(7)).unionByName(six.withColumn("k", F.lit(6)))
    if clustered is not None:
        strong = clustered.where("is_strong").select("rbp_id", "kmer", F.col("weight").alias("truth_score"), "k")
        out = out.unionByName(strong)
    return out.groupBy("rbp_id", "k", "kmer").agg(F.max("truth_score").alias("truth_score"))


def sparse_profile(top: DataFrame, key: str = "rbp_id") -> DataFrame:
    """Scores 2 - 0.05 * rank from an ordered top list (rank, kmer) for k = 7, and for k = 6 from
    the first ten distinct ends of the list."""
    seven = top.where(F.length("kmer") == 7)
    ends = seven.select(
        key, F.posexplode(F.array(F.substring("kmer", 1, 6), F.substring("kmer", 2, 6))).alias("_side", "_six"), "rank"
    )
    first = ends.groupBy(key, F.col("_six").alias("kmer")).agg(F.min(F.col("rank") * 2 + F.col("_side")).alias("_o"))
    six = rank_bounded(first, [key], [F.col("_o")], "rank").where("rank <= 10").drop("_o").withColumn("k", F.lit(6))
    both = seven.select(key, "kmer", "rank").withColumn("k", F.lit(7)).unionByName(six.select(key, "kmer", "rank", "k"))
    return both.withColumn("score", 2.0 - 0.05 * F.col("rank"))


def _average_rank(column: str, keys: Sequence[str]) -> Column:
    ordered = Window.partitionBy(*keys).orderBy(column)
    tied = Window.partitionBy(*keys, column)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def profile_metrics(scores: DataFrame, truth: DataFrame, key: str = "rbp_id") -> DataFrame:
    """Correlation and rank measures of dense scores (key, kmer_idx, kmer, score) against the truth.

    The share of the first twenty truth k-mers takes them in index order.
    """
    joined = scores.join(truth.select(key, "kmer", "truth_score"), [key, "kmer"], "left").withColumn(
        "truth_score", F.coalesce("truth_score", F.lit(0.0))
    )
    order = [F.col("score").desc(), F.col("kmer_idx")]
    w = Window.partitionBy(key)
    ranked = rank_bounded(joined, [key], order, "rank").withColumns(
        {
            "_rs": _average_rank("score", [key]),
            "_rt": _average_rank("truth_score", [key]),
            "_n": F.count(F.lit(1)).over(w),
            "_true": F.col("truth_score") > 0,
        }
    )
    nth = F.sum(F.col("_true").cast("int")).over(w.orderBy("kmer_idx").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_nth", nth)
    varied = (F.stddev_pop("score") > 0) & (F.stddev_pop("truth_score") > 0)
    out = ranked.groupBy(key).agg(
        F.when(varied, F.corr("score", "truth_score")).alias("pearson"),
        F.when(varied, F.corr("_rs", "_rt")).alias("spearman"),
        *[F.count_if(F.col("_true") & (F.col("rank") <= k)).alias(f"top{k}_overlap") for k in (20, 50, 100)],
        F.avg(F.when(F.col("_true") & (F.col("_nth") <= 20), F.col("rank") / F.col("_n"))).alias("truth_mean_rank_percentile"),
        F.min(F.when(F.col("_true"), F.col("rank"))).alias("best_truth_rank"),
        F.count_if("_true").alias("_truths"),
    )
    known = [c for c in out.columns if c not in (key, "_truths")]
    return out.select(key, *[F.when(F.col("_truths") > 0, F.col(c)).alias(c) for c in known])


def cluster_metrics(scores: DataFrame, clustered: DataFrame, key: str = "rbp_id") -> DataFrame:
    """Weighted recovery in the first 100, weighted mean and best rank, and AUC against all other k-mers."""
    ranked = rank_bounded(scores, [key], [F.col("score").desc(), F.col("kmer_idx")], "rank")
    members = ranked.join(clustered.select(key, "token", "kmer", "weight"), [key, "kmer"])
    sums = members.groupBy(key).agg(
        (F.sum(F.when(F.col("rank") <= CLUSTER_TOP, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("cluster_topk_recovery"),
        (F.sum(F.col("rank") * F.col("weight")) / F.sum("weight")).alias("cluster_mean_rank"),
        F.min("rank").alias("cluster_best_rank"),
    )
    others = ranked.join(members.select(key, "kmer").distinct(), [key, "kmer"], "left_anti")
    labelled = members.select(key, "score", F.lit(1).alias("label")).unionByName(
        others.select(key, "score", F.lit(0).alias("label"))
    )
    auc = binary_metrics(labelled, [key], "label", "score").select(key, F.col("auroc").alias("cluster_auc"))
    return sums.join(auc, key, "left")


def group_mass(scores: DataFrame, key: str = "rbp_id") -> DataFrame:
    """Share of positive score per motif group; an all-zero profile counts as uniform."""
    w = Window.partitionBy(key)
    clipped = scores.withColumns({"_pos": F.greatest("score", F.lit(0.0)), "motif_group": motif_group("kmer")})
    clipped = clipped.withColumn("_all", F.sum("_pos").over(w))
    mass = F.when(F.col("_all") == 0, F.lit(1.0)).otherwise(F.col("_pos"))
    sums = clipped.groupBy(key, "motif_group").agg(F.sum(mass).alias("_m"))
    return sums.withColumn("mass", F.col("_m") / F.sum("_m").over(w)).drop("_m")


def dominant_group(scores: DataFrame, key: str = "rbp_id", n: int = 20) -> DataFrame:
    """Most common motif group of the first ``n`` k-mers, ties to the one ranked first, with its share."""
    ranked = rank_bounded(scores, [key], [F.col("score").desc(), F.col("kmer_idx")], "rank").where(F.col("rank") <= n)
    counts = ranked.groupBy(key, motif_group("kmer").alias("predicted_motif_group")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first")
    )
    total = F.sum("_n").over(Window.partitionBy(key))
    counts = counts.withColumn("prediction_confidence", F.col("_n") / total)
    best = rank_bounded(counts, [key], [F.col("_n").desc(), F.col("_first")], "_r").where("_r = 1")
    return best.select(key, "predicted_motif_group", "prediction_confidence")


def evaluation_rows(metrics: DataFrame, dominant: DataFrame, meta: DataFrame, key: str = "rbp_id") -> DataFrame:
    """Metrics with the predicted group, its collapse status and the recovery flag.

    ``meta`` has (rbp_id, protein_family, expected_motif_type).
    """
    rows = meta.join(metrics, key, "left").join(dominant, key, "left")
    rows = rows.withColumn("predicted_motif_group", F.coalesce("predicted_motif_group", F.lit("missing")))
    e, p = F.col("expected_motif_type"), F.col("predicted_motif_group")
    excluded = ["U-rich", "UC-rich", *UNSCORED_EXPECTATIONS[:3]]
    return rows.withColumns(
        {
            "collapse_status": collapse_status(e, p),
            "non_u_uc_recovery": (~e.isin(excluded) & ~p.isin("U-rich", "UC-rich")).cast("int"),
        }
    )


def collapse_summary(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Collapse and recovery rates per group (protein family, model version or both)."""
    judged = ~F.col("expected_motif_type").isin(["U-rich", "UC-rich", *UNSCORED_EXPECTATIONS[:3]])
    collapsed = (F.col("collapse_status") == "collapsed_to_U_UC").cast("double")
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rbps"),
        F.avg(collapsed).alias("collapse_rate"),
        F.avg(F.when(judged, collapsed)).alias("judged_collapse_rate"),
        F.avg(F.when(judged, F.col("non_u_uc_recovery").cast("double"))).alias("non_u_recovery_rate"),
    )


def training_flags(proteins: DataFrame, truth: DataFrame, key: str = "rbp_id") -> DataFrame:
    """(key, protein_family, control_only, strict_train, split, class_pool) of every protein of (key, protein_family).

    A protein is strict if it is no control and a row of ``truth`` (key, use_for_training) may be trained on. Strict ones are
    for training or, if they are on the fixed list, for validation; all proteins of a known family but these are in the class pool.
    """
    usable = truth.where("use_for_training = 1").select(key).distinct().withColumn("_usable", F.lit(True))
    control = is_control("protein_family", key)
    rows = proteins.select(key, "protein_family").distinct().join(usable, key, "left")
    strict = ~control & F.coalesce("_usable", F.lit(False))
    chosen = F.col(key).isin(VALIDATION_PROTEINS)
    return rows.select(
        key,
        "protein_family",
        control.cast("int").alias("control_only"),
        strict.cast("int").alias("strict_train"),
        F.when(strict & chosen, "validation").when(strict, "train").otherwise("none").alias("split"),
        ((F.col("protein_family") != "unknown") & ~(strict & chosen)).cast("int").alias("class_pool"),
    )


def chosen_k(truth: DataFrame, key: str = "rbp_id") -> DataFrame:
    """(key, metric_k): 7 for proteins with a 7-mer of positive truth, else 6."""
    seven = (F.col("k") == 7) & (F.col("truth_score") > 0)
    return truth.groupBy(key).agg(F.when(F.bool_or(seven), 7).otherwise(6).alias("metric_k"))


def evaluate_models(scores: DataFrame, truth: DataFrame, proteins: DataFrame) -> DataFrame:
    """A row for each model and protein: metrics over the protein's k, predicted group, collapse status and flags.

    ``scores`` is dense (model_version, rbp_id, k, kmer_idx, kmer, score), ``truth`` (rbp_id, k, kmer, truth_score), ``proteins`` (rbp_id,
    protein_family, expected_motif_type). Only scores and truth of the chosen k are compared; groups always come from the 7-mers.
    """
    models = scores.select("model_version").distinct()
    k = chosen_k(truth)
    meta = proteins.join(k, "rbp_id", "left").withColumn("metric_k", F.coalesce("metric_k", F.lit(6))).crossJoin(F.broadcast(models))
    pair = F.struct("model_version", "rbp_id").alias("pair")
    meta = meta.select(pair, "*")
    own = scores.join(meta.select("model_version", "rbp_id", "metric_k"), ["model_version", "rbp_id"])
    rated = own.where("k = metric_k").select(pair, "kmer_idx", "kmer", "score")
    known = truth.join(meta.select("pair", "model_version", "rbp_id", F.col("metric_k").alias("k")), ["rbp_id", "k"]).select("pair", "kmer", "truth_score")
    dominant = dominant_group(own.where("k = 7").select(pair, "kmer_idx", "kmer", "score"), "pair")
    rows = evaluation_rows(profile_metrics(rated, known, "pair"), dominant, meta, "pair")
    return rows.withColumn("hard_failure_tracking", (F.col("rbp_id") == HARD_FAILURE).cast("int")).drop("pair")


def cluster_metrics_over_k(scores: DataFrame, clustered: DataFrame, keys: Sequence[str] = ("rbp_id",)) -> DataFrame:
    """Cluster measures of each k, averaged over the k that have clusters (of the best rank, the least).

    ``scores`` has (keys, k, kmer_idx, kmer, score), ``clustered`` (rbp_id, k, token, kmer, weight).
    """
    key = F.struct(*keys, "k").alias("_key")
    rows = scores.select(key, "kmer_idx", "kmer", "score")
    members = scores.select(*keys, "k").distinct().join(clustered, ["rbp_id", "k"]).select(key, "token", "kmer", "weight")
    each = cluster_metrics(rows, members, "_key")
    return each.groupBy(*[F.col(f"_key.{c}").alias(c) for c in keys]).agg(
        F.avg("cluster_topk_recovery").alias("cluster_topk_recovery"),
        F.avg("cluster_mean_rank").alias("cluster_mean_rank"),
        F.min("cluster_best_rank").alias("cluster_best_rank"),
        F.avg("cluster_auc").alias("cluster_auc"),
    )


def _judged() -> Column:
    return ~F.col("expected_motif_type").isin(["U-rich", "UC-rich", *UNSCORED_EXPECTATIONS[:3]])


def _retained() -> Column:
    kept = F.col("predicted_motif_group").isin("U-rich", "UC-rich").cast("double")
    return F.when(F.col("rbp_id").isin(RETAINED_PROTEINS), kept)


def family_summary(rows: DataFrame, flags: DataFrame, models: Sequence[str], retained_by: str) -> DataFrame:
    """A row for each family: sizes, and collapse and recovery rate of each model as columns, in one pass over the rows.

    ``good_case_retention`` is that of the model ``retained_by``, for the laboratory's family only.
    """
    collapsed = (F.col("collapse_status") == "collapsed_to_U_UC").cast("double")
    figures = []
    for m in models:
        mine = F.col("model_version") == m
        figures.append(F.avg(F.when(mine, collapsed)).alias(f"{m}_collapse_rate"))
        figures.append(F.avg(F.when(mine & _judged(), F.col("non_u_uc_recovery").cast("double"))).alias(f"{m}_non_u_recovery_rate"))
    good = F.avg(F.when(F.col("model_version") == retained_by, _retained())).alias("_good")
    rates = rows.groupBy("protein_family").agg(F.countDistinct("rbp_id").alias("n_rbps"), *figures, good)
    strict = flags.groupBy("protein_family").agg(F.sum("strict_train").alias("n_strict_truth"))
    modes = F.create_map(*[F.lit(x) for item in FAILURE_MODES.items() for x in item])
    return rates.join(strict, "protein_family", "left").select(
        "protein_family",
        "n_rbps",
        F.col("n_rbps").alias("n_with_embedding"),
        F.coalesce("n_strict_truth", F.lit(0)).cast("bigint").alias("n_strict_truth"),
        *[c for c in rates.columns if c.endswith("_rate")],
        F.when(F.col("protein_family") == "RBNS_lab", F.col("_good")).alias("good_case_retention"),
        F.coalesce(F.try_element_at(modes, F.col("protein_family")), F.lit(OTHER_FAILURE)).alias("major_failure_mode"),
    )


def model_comparison(rows: DataFrame, cluster_rows: DataFrame) -> DataFrame:
    """A row for each model: collapse and recovery among judged proteins, retention, and figures of named proteins."""
    collapsed = (F.col("collapse_status") == "collapsed_to_U_UC").cast("double")
    named = F.array_sort(F.collect_list(F.when(F.col("rbp_id") == REPORTED_PROTEIN, F.col("predicted_motif_group"))))
    out = rows.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n_eval_rbps"),
        F.avg(F.when(_judged(), collapsed)).alias("u_uc_rich_collapse_rate"),
        F.avg(F.when(_judged(), F.col("non_u_uc_recovery").cast("double"))).alias("non_u_uc_recovery_rate"),
        F.avg(_retained()).alias("good_case_retention_rate"),
        F.concat_ws(",", named).alias("reported_protein_group"),
    )
    pumilio = cluster_rows.where(F.col("rbp_id").isin(PUMILIO_PROTEINS)).groupBy("model_version").agg(F.avg("cluster_auc").alias("pumilio_mean_cluster_auc"))
    return out.join(pumilio, "model_version", "left")


def reconstruction_metrics(pairs: DataFrame, key: str = "profile_id") -> DataFrame:
    """Smooth-L1 over masked cells and the mean per-profile correlation (constant profiles skipped).

    ``pairs`` has (key, predicted, target, mask).
    """
    d = F.abs(F.col("predicted") - F.col("target"))
    loss = F.when(F.col("mask"), F.when(d < 1.0, 0.5 * d * d).otherwise(d - 0.5))
    on = F.col("mask")
    p, t = F.when(on, F.col("predicted")), F.when(on, F.col("target"))
    varied = (F.stddev_pop(p) > 0) & (F.stddev_pop(t) > 0)
    per = pairs.groupBy(key).agg(F.sum(loss).alias("_l"), F.count(loss).alias("_n"), F.when(varied, F.corr(p, t)).alias("_r"))
    return per.agg((F.sum("_l") / F.sum("_n")).alias("smooth_l1"), F.avg("_r").alias("mean_profile_pearson"))
