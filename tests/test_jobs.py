"""The false-positive audit and features of several numbers of best windows, on small tables."""

from pyspark.sql import functions as F

from seqrank.plans import jobs

SEQ = {1: "UUUUUUUUUU" * 3, 2: "ACGU" * 8, 3: "CUCUCUU" * 5}


def test_false_positive_audit(spark):
    table = spark.createDataFrame(
        [(f"g{i}", 1.0 - i / 10, f"t{i}", 1, 32, 4) for i in range(1, 4)] + [("g9", 0.1, "t9", 1, 32, 1), ("g8", None, "t8", 1, 32, 1)],
        "gene_id string, top3_mean_score double, transcript_id string, best_window_start int, best_window_end int, n_windows long",
    )
    windows = spark.createDataFrame([(f"t{i}", 1, 32, s) for i, s in SEQ.items()], "transcript_id string, window_start int, window_end int, rna_seq string")
    pairing = spark.createDataFrame([("t1", 1, 32, [0.9] * 30)], "transcript_id string, window_start int, window_end int, paired array<double>")
    top = spark.createDataFrame([("CUCUCUU", "positive", 3.0, 1), ("AAAAAAA", "positive", 2.0, 2), ("UUUUUUU", "negative", -1.0, 1)], "kmer string, direction string, zscore double, rank int")
    truth = spark.createDataFrame([("g2",), ("g9",), ("gx",)], "gene_id string")
    out = {r.gene_id: r for r in jobs.false_positive_audit(table, truth, windows, pairing, top, k=2).collect()}
    assert {g: (r.audit_group, r.audit_rank) for g, r in out.items()} == {
        "g1": ("Top2 false positives", 1),
        "g2": ("Top2 true positives", 2),
        "g9": ("truth outside Top2", 4),
    }
    first, second, none = out["g1"], out["g2"], out["g9"]
    assert first.paired_run_density == 1.0 and first.UUUUUUU_count == 24 and first.top_Urich_kmer_density == 0.0
    assert second.paired_run_density is None and second.best_window_seq == SEQ[2]
    assert none.best_window_seq is None and none.U_content is None
    assert all(r[c] is None for r in out.values() for c in jobs.UNFILLED)


def test_each_k_takes_its_own_windows(spark):
    names = [*jobs._DIAGNOSTIC_MEANS, "is_high_paired_architecture_window"]
    rows = spark.range(1, 13).select(F.lit("g1").alias("gene_id"), F.col("id").cast("int").alias("window_rank"), *[(F.col("id") * 1.0).alias(n) for n in names])
    regions = [f"{p}is_{n}" for p in ("", "inferred_") for n in ("CDS", "5UTR", "3UTR", "ncRNA", "unknown")]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in regions}).withColumns({c: F.lit("x") for c in ("region_type", "inferred_region_type")})
    base = spark.createDataFrame([("g1", 1.0), ("g2", 0.5)], "gene_id string, baseline_score double")
    out = {(r.gene_id, r.top_window_k): r for r in jobs.diagnostic_features(rows, base, (3, 10, 20)).collect()}
    assert set(out) == {(g, k) for g in ("g1", "g2") for k in (3, 10, 20)}
    assert [out["g1", k].topk_stem_like_score_mean for k in (3, 10, 20)] == [2.0, 5.5, 6.5]
    assert [out["g1", k].max_paired_architecture_score for k in (3, 10, 20)] == [3.0, 10.0, 12.0]
    assert out["g2", 3].topk_stem_like_score_mean is None and out["g1", 3].best_window_region_type == "x"
