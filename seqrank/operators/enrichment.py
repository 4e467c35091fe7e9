"""Agreement of ranked genes with a truth list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.functions.numeric import hypergeom_sf, neg_log10
from seqrank.operators.ranking import leading, rank_bounded, rank_rows, top_n

TOP_KS = (50, 100, 200, 500, 1000)


def topk_enrichment(
    genes: DataFrame,
    truth: DataFrame,
    score: str,
    ks: Sequence[int] = TOP_KS,
    groups: Sequence[str] = (),
    truth_groups: Sequence[str] = (),
) -> DataFrame:
    """Overlap of the K best genes with the truth, for every K, group and truth group.

    ``genes`` has one row per (groups, gene_id); ``truth`` one per (truth_groups, gene_id). Only
    the max(ks) best genes per group meet the truth list, so all candidates run in one job.
    """
    groups, truth_groups = list(groups), list(truth_groups)
    genes = genes.select(*groups, "gene_id", F.col(score).alias("_score")).withColumn("_all", F.lit(1))
    groups = groups + ["_all"]
    truth = truth.select(*truth_groups, "gene_id").distinct()
    both = groups + truth_groups

    universe = genes.groupBy(*groups).agg(F.count("gene_id").alias("universe_genes"))
    known = genes.select(*groups, "gene_id").join(truth, "gene_id").groupBy(*both)
    known = known.agg(F.count("gene_id").alias("truth_genes"))
    best = top_n(genes, groups, [F.col("_score").desc_nulls_last(), F.col("gene_id")], max(ks), "_rank")
    hits = best.join(truth, "gene_id").groupBy(*both)
    hits = hits.agg(*[F.count_if(F.col("_rank") <= k).alias(f"_hits{k}") for k in ks])

    # every group meets every truth group, also one without a gene of its universe; both lists are short
    frame = universe.crossJoin(truth.select(*truth_groups).distinct()) if truth_groups else universe
    wide = frame.join(known, both, "left").join(hits, both, "left")
    per_k = F.array(
        *[
            F.struct(
                F.lit(int(k)).alias("top_k"), F.coalesce(F.col(f"_hits{k}"), F.lit(0)).alias("overlap")
            )
            for k in ks
        ]
    )
    truth_n = F.coalesce(F.col("truth_genes"), F.lit(0))
    out = wide.select(*both, "universe_genes", truth_n.alias("truth_genes"), F.inline(per_k)).drop("_all")
    return enrichment_columns(out)


def enrichment_columns(df: DataFrame) -> DataFrame:
    """Precision, recall, expectation, fold and p-value from the counts."""
    drawn = F.least(F.col("top_k").cast("bigint"), F.col("universe_genes"))
    hit, known = F.col("overlap").cast("double"), F.col("truth_genes").cast("double")
    df = df.withColumn("expected_random", F.try_divide(drawn * known, F.col("universe_genes").cast("double")))
    return df.withColumns(
        {
            "precision": F.try_divide(hit, drawn.cast("double")),
            "recall": F.try_divide(hit, known),
            "fold_enrichment": F.try_divide(hit, F.col("expected_random")),
            "hypergeom_pvalue": hypergeom_sf(
                F.col("overlap"), F.col("universe_genes"), F.col("truth_genes"), drawn
            ),
        }
    )


def comparable_truth(truth: DataFrame, genes: DataFrame) -> DataFrame:
    """Truth genes that occur in the universe."""
    return truth.select("gene_id").distinct().join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def truth_splits(truth: DataFrame, seeds: Sequence[int], fraction: float = 0.7) -> DataFrame:
    """(seed, gene_id, role): per seed a share for calibration, the rest held out.

    The order inside a seed is that of md5(seed:gene), so a split does not depend on how the rows
    are stored. At least one gene falls on either side.
    """
    # names are short, but their digests take long: they are dealt out by number, so that they aren't put into a few tasks by their size
    spark = truth.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = truth.select("gene_id").distinct().repartition(n, F.xxhash64("gene_id"))
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    rows = rows.withColumn("_h", F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("gene_id"))))
    ranked = rank_rows(rows, ["seed"], [F.col("_h"), F.col("gene_id")], "_r", leading("_h"))
    sizes = ranked.groupBy("seed").agg(F.count(F.lit(1)).alias("_n"))
    cut = F.least(F.greatest(F.bround(F.col("_n") * F.lit(fraction)), F.lit(1.0)), F.col("_n") - F.lit(1.0))
    return ranked.join(sizes, "seed").select(
        "seed", "gene_id", F.when(F.col("_r") <= cut, "calibration").otherwise("heldout").alias("role")
    )


def three_way_split(ids: DataFrame, column: str, seed: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Train, validation and test roles by md5 order."""
    rows = ids.select(column).distinct()
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))))
    ranked = rank_rows(rows, [], [F.col("_h"), F.col(column)], "_r", leading("_h"))
    n = rows.agg(F.count(F.lit(1))).scalar()
    n_train, n_valid = F.floor(n * F.lit(train)), F.floor(n * F.lit(validation))
    role = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_valid, "validation")
    return ranked.select(column, role.otherwise("test").alias("role"))


def fixed_score_validation(
    genes: DataFrame, score: str, splits: DataFrame, ks: Sequence[int], groups: Sequence[str] = ()
) -> DataFrame:
    """Held-out enrichment of an unchanged score over all splits."""
    held = splits.where("role = 'heldout'")
    return topk_enrichment(genes, held, score, ks, groups, ["seed"])


def pivot_ks(rows: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Enrichment rows with one column per measure and K."""
    measures = {
        "overlap": "overlap",
        "precision": "precision",
        "recall": "recall",
        "fold": "fold_enrichment",
        "pvalue": "hypergeom_pvalue",
    }
    return rows.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("top_k") == k, F.col(c))).alias(f"top{k}_{name}")
            for k in ks
            for name, c in measures.items()
        ]
    )


def pick_first(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per group; groups are candidate grids of fixed size."""
    return rank_bounded(df, groups, order, "_pick").where("_pick = 1").drop("_pick")


def best_by_top200(rows: DataFrame, groups: Sequence[str], candidate: str) -> DataFrame:
    """Candidate with the best Top200 p-value, overlap and fold, then Top500 overlap; ties by name."""
    wide = pivot_ks(rows, [*groups, candidate], (200, 500))
    order = [
        neg_log10("top200_pvalue").desc_nulls_last(),
        F.col("top200_overlap").desc(),
        F.col("top200_fold").desc_nulls_last(),
        F.col("top500_overlap").desc(),
        F.col(candidate),
    ]
    return pick_first(wide, groups, order)


def best_by_top1000(rows: DataFrame, groups: Sequence[str], candidate: Sequence[str]) -> DataFrame:
    """Candidate with the best Top1000 p-value, overlap and fold, then Top500 overlap and p-value."""
    wide = pivot_ks(rows, [*groups, *candidate], (500, 1000))
    wide = wide.withColumn("selection_metric", neg_log10("top1000_pvalue"))
    order = [
        F.col("selection_metric").desc_nulls_last(),
        F.col("top1000_overlap").desc(),
        F.col("top1000_fold").desc_nulls_last(),
        F.col("top500_overlap").desc(),
        F.col("top500_pvalue").asc_nulls_last(),
        *[F.col(c) for c in candidate],
    ]
    return pick_first(wide, groups, order)


# The objectives and the column order each one sorts by.
OBJECTIVES = {
    "top200_overlap": [
        "top200_overlap desc",
        "top200_fold desc",
        "top200_pvalue asc",
        "top500_overlap desc",
        "top1000_overlap desc",
    ],
    "top200_hypergeom": [
        "top200_pvalue asc",
        "top200_overlap desc",
        "top200_fold desc",
        "top500_pvalue asc",
        "top1000_pvalue asc",
    ],
    "top200_fold": [
        "top200_fold desc",
        "top200_overlap desc",
        "top200_pvalue asc",
        "top500_fold desc",
        "top1000_fold desc",
    ],
    "weighted_top200_500_1000": [
        "weighted desc",
        "top200_overlap desc",
        "top500_overlap desc",
        "top1000_overlap desc",
    ],
    "top500_hypergeom": [
        "top500_pvalue asc",
        "top500_overlap desc",
        "top500_fold desc",
        "top200_pvalue asc",
        "top1000_pvalue asc",
    ],
    "top1000_hypergeom": [
        "top1000_pvalue asc",
        "top1000_overlap desc",
        "top1000_fold desc",
        "top500_pvalue asc",
        "top200_pvalue asc",
    ],
}


def weighted_objective() -> Column:
    return (
        0.5 * neg_log10("top200_pvalue") + 0.3 * neg_log10("top500_pvalue") + 0.2 * neg_log10("top1000_pvalue")
    )


def best_per_objective(rows: DataFrame, groups: Sequence[str], candidate: Sequence[str]) -> DataFrame:
    """The chosen candidate for each of the six objectives, in one long table."""
    wide = pivot_ks(rows, [*groups, *candidate], (200, 500, 1000)).withColumn("weighted", weighted_objective())
    keyed = []
    for name, parts in OBJECTIVES.items():
        values = []
        for part in parts:
            column, way = part.split()
            x = F.col(column).cast("double")
            values.append(-x if way == "desc" else x)
        values += [F.lit(0.0)] * (5 - len(values))
        last = F.lit(float("inf"))
        keyed.append(
            F.struct(F.lit(name).alias("objective"), F.array(*[F.coalesce(v, last) for v in values]).alias("_key"))
        )
    long = wide.withColumn("_o", F.explode(F.array(*keyed))).select("*", "_o.objective", "_o._key").drop("_o")
    order = [F.col("_key"), *[F.col(c) for c in candidate]]
    return pick_first(long, [*groups, "objective"], order).drop("_key")


def summarise_splits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median and range over seeds (a fixed, small number)."""
    return rows.groupBy(*keys).agg(
        F.count_distinct("seed").alias("n_selected"),
        F.avg("overlap").alias("mean_overlap"),
        F.median("overlap").alias("median_overlap"),
        F.min("overlap").alias("min_overlap"),
        F.max("overlap").alias("max_overlap"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("fold_enrichment").alias("mean_fold_enrichment"),
        F.median("hypergeom_pvalue").alias("median_hypergeom_pvalue"),
    )


def audit_groups(genes: DataFrame, truth: DataFrame, score: str, k: int) -> DataFrame:
    """Labels every gene as true or false positive of the top K, missed truth, or background."""
    known = comparable_truth(truth, genes).withColumn("_truth", F.lit(True))
    best = top_n(
        genes.withColumn("_g", F.lit(1)), ["_g"], [F.col(score).desc_nulls_last(), F.col("gene_id")], k, "_r"
    ).select("gene_id", F.lit(True).alias("_top"))
    flagged = genes.join(known, "gene_id", "left").join(best, "gene_id", "left")
    is_top, is_truth = F.col("_top").isNotNull(), F.col("_truth").isNotNull()
    group = (
        F.when(is_top & is_truth, f"Top{k} true positives")
        .when(is_top, f"Top{k} false positives")
        .when(is_truth, f"truth outside Top{k}")
        .otherwise("background")
    )
    return flagged.withColumn("audit_group", group).withColumn("top_k_group", F.lit(int(k))).drop("_top", "_truth")


def modal_value(rows: DataFrame, groups: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent value per group; ties go to the one seen first in ``order``."""
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return pick_first(counts, groups, [F.col("_n").desc(), F.col("_first"), F.col(value)]).drop("_n", "_first")
