import gzip
import tempfile
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqrank.operators import audit as Q
from seqrank.operators import bias as B
from seqrank.operators import candidates as C
from seqrank.operators import clusters as K
from seqrank.operators import enrichment as E
from seqrank.operators import genes as G
from seqrank.operators import neighbours as N
from seqrank.operators import regions as R
from seqrank.operators import windows as W
from seqrank.plans import jobs
from seqrank.sources import annotation, fasta, tables
from seqrank.streaming.incremental import finished, stream_extremes, stream_top_n


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_overlap_smoke(spark):
    genes = spark.createDataFrame([("g1", 3.0), ("g2", 2.0), ("g3", 1.0)], "gene_id string, score double")
    truth = spark.createDataFrame([("g1",), ("g3",), ("zz",)], "gene_id string")
    got = {r["top_k"]: r for r in E.topk_enrichment(genes, truth, "score", (1, 2, 3, 9)).collect()}
    assert [got[k]["overlap"] for k in (1, 2, 3, 9)] == [1, 1, 2, 2]
    assert got[9]["precision"] == pytest.approx(2 / 3) and got[1]["universe_genes"] == 3 and got[1]["truth_genes"] == 2


def test_disjoint_truth_gives_nulls(spark):
    genes = spark.createDataFrame([("g1", None), ("g2", 2.0)], "gene_id string, score double")
    row = E.topk_enrichment(genes, spark.createDataFrame([("x",)], "gene_id string"), "score", (1,)).first()
    assert row["overlap"] == 0 and row["recall"] is None and row["hypergeom_pvalue"] is None


def test_gene_aggregate_edges(spark):
    rows = [("r", "one", "t", 1, 200, 0.5), ("r", "none", "t", 1, 200, None), ("r", "none", "t", 51, 250, float("nan"))]
    rows += [("r", "many", "t", i, i + 199, float(i)) for i in range(1, 402)]
    df = spark.createDataFrame(rows, "rbp_id string, gene_id string, transcript_id string, window_start int, window_end int, s double")
    got = {r["gene_id"]: r for r in G.aggregate_genes(df, "s").collect()}
    assert got["one"]["top10_mean_score"] == 0.5 and got["one"]["top5_percent_mean_score"] == 0.5
    assert got["none"]["max_score"] is None and got["none"]["n_windows"] == 2 and got["none"]["top5_percent_mean_score"] is None
    assert got["many"]["top5_percent_mean_score"] == pytest.approx(np.mean(range(381, 402)))
    assert got["many"]["top3_mean_score"] == 400.0 and got["many"]["best_window_start"] == 401
    assert all(r["max_score"] is None or r["top3_mean_score"] <= r["max_score"] for r in got.values())


def test_scores_side_by_side(spark, monkeypatch):
    """Windows are exchanged once with all scores; a gene of any size is dealt out, with the same results."""
    rows = [(f"g{i % 7 if i % 3 else 0}", f"t{i:04}", None if i % 11 == 0 else float(i * 37 % 101), float("nan") if i % 13 == 0 else -float(i % 29)) for i in range(900)]
    df = spark.createDataFrame([*rows, ("none", "t", None, None)], "gene_id string, transcript_id string, a double, b double")
    whole = G.aggregate_scores(df, ["a", "b"])
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Expand" not in plan and plan.index("Generate") < plan.index("Repartition")
    monkeypatch.setattr(G, "MOST_GATHERED", 40)
    dealt = G.aggregate_scores(df, ["a", "b"])
    one = {s: G.aggregate_genes(df, s, ["gene_id"], ["transcript_id"], ["transcript_id"]) for s in ("a", "b")}
    for table in (whole, dealt):
        got = {(r["score_name"], r["gene_id"]): r for r in table.collect()}
        assert len(got) == 16
        for (score, gene), r in got.items():
            values = [x[2 if score == "a" else 3] for x in rows if x[0] == gene]
            kept = sorted((v for v in values if v is not None and v == v), reverse=True)
            assert r["n_windows"] == max(len(values), 1)
            for name, n in (("max_score", 1), ("top3_mean_score", 3), ("top10_mean_score", 10), ("top5_percent_mean_score", max(int(np.ceil(len(kept) * 0.05)), 1))):
                assert r[name] == (pytest.approx(np.mean(kept[:n])) if kept else None)
    for i, score in ((2, "a"), (3, "b")):
        for r in one[score].collect():
            mine = [x for x in rows if x[0] == r["gene_id"]]
            first = min(mine, key=lambda x: (x[i] is None or x[i] != x[i], -(x[i] or 0.0) if x[i] == x[i] else 0, x[1]), default=(0, "t"))
            assert r["transcript_id"] == first[1]


def test_tile_edges(spark):
    df = spark.createDataFrame([("a", "A" * 9), ("b", "A" * 10), ("c", "A" * 17)], "transcript_id string, seq string")
    got = sorted((r["transcript_id"], r["window_start"], r["window_end"]) for r in W.tile(df, 10, 5).collect())
    assert got == [("b", 1, 10), ("c", 1, 10), ("c", 6, 15), ("c", 8, 17)]


def test_unmapped_and_repeated_transcripts(spark):
    tx = spark.createDataFrame([("a", "A"), ("b", "C")], "transcript_id string, seq string")
    gm = spark.createDataFrame([("a", "g1", 1), ("a", "g2", 2)], "transcript_id string, gene_id string, pos int")
    assert [tuple(r) for r in W.attach_genes(tx, gm, "pos").collect()] == [("a", "A", "g2")]


def test_splits_cover_truth(spark):
    truth = spark.createDataFrame([(f"g{i}",) for i in range(10)], "gene_id string")
    rows = E.truth_splits(truth, [1, 2], 0.7).toPandas()
    assert rows.groupby(["seed", "role"]).size().unstack().values.tolist() == [[7, 3], [7, 3]]


def test_audit_groups_partition_the_genes(spark):
    genes = spark.createDataFrame([(f"g{i}", float(-i)) for i in range(6)], "gene_id string, s double")
    truth = spark.createDataFrame([("g0",), ("g5",)], "gene_id string")
    got = dict(E.audit_groups(genes, truth, "s", 2).groupBy("audit_group").count().collect())
    assert got == {"Top2 true positives": 1, "Top2 false positives": 1, "truth outside Top2": 1, "background": 3}


def test_robust_z_fallbacks(spark):
    df = spark.createDataFrame([(f"g{i}", float(i), 1.0, 5.0 if i else 9.0) for i in range(5)], "gene_id string, a double, b double, c double")
    got = C.robust_z(df, ["a", "b", "c"]).toPandas().sort_values("gene_id")
    assert got["a_z"].tolist() == pytest.approx([0.67448975 * (i - 2) / 1 for i in range(5)])
    assert got["b_z"].tolist() == [0.0] * 5
    c = got["c"]
    assert got["c_z"].tolist() == pytest.approx(((c - c.mean()) / c.std()).tolist())


def test_binary_metrics_one_class_and_ties(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.4), ("a", 0, 0.1), ("b", 1, 0.5)]
    got = {r["g"]: r for r in B.binary_metrics(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "y", "s").collect()}
    assert got["a"]["auroc"] == pytest.approx(0.625) and got["b"]["auroc"] is None and got["b"]["positive_median"] is None
    assert got["a"]["auprc"] == pytest.approx(0.5 * 0.5 + 0.5 * (2 / 3))


def test_cluster_weights(spark):
    got = K.clusters(spark.createDataFrame([("p", "AAUAAA")], "rbp_id string, token string")).toPandas()
    six = got[got["k"] == 6].set_index("kmer")["weight"]
    assert six["AAUAAA"] == 1.0 and len(six) == 1 + 18 and (six.drop("AAUAAA") == 0.35).all()
    seven = got[(got["k"] == 7) & got["is_strong"]]["kmer"]
    assert sorted(seven) == sorted({"AAUAAA" + b for b in "ACGU"} | {b + "AAUAAA" for b in "ACGU"})
    assert spark.range(1).select(F.size(K.expand_word(F.lit("NNNNN")))).first()[0] == 1024
    assert spark.range(1).select(F.size(K.compatible_kmers(F.lit("NNNNNACGU"), 7))).first()[0] == 1344


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_references_need_little_memory(k):
    """A slice of queries and a block of references are compared piece by piece, with ties as in a stable sort."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(-2, 3, (3000, 4)).astype(float), rng.integers(-2, 3, (1000, 4)).astype(float)
    tracemalloc.start()
    row, place, cosine = N._best(list(a), list(b), k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6 < len(a) * len(b) * 8 * 2
    sims = np.round(N._unit(a) @ N._unit(b).T, 9)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    assert (row == np.repeat(np.arange(len(a)), k)).all() and (place.reshape(order.shape) == order).all()
    assert (cosine == np.take_along_axis(sims, order, axis=1).ravel()).all()
    assert len(N._best(list(a[:5]), list(b[:2]), k)[0]) == 5 * min(k, 2)


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_nearest_agrees_with_numpy_and_skips_blocks(spark, monkeypatch, spread):
    """Clustered references: most centres are never looked at. Evenly spread ones: all may be, and the result is the same."""
    monkeypatch.setattr(N, "QUERY_ROWS", 7)
    monkeypatch.setattr(N, "REFERENCE_ROWS", 5)
    monkeypatch.setattr(N, "ROUNDS", (1, 4, 10_000))
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 6))
    q = middle[rng.integers(0, 12, 25)] + rng.normal(size=(25, 6)) * spread
    r = middle[rng.integers(0, 12, 150)] + rng.normal(size=(150, 6)) * spread
    r[:20] = r[20]  # a hot block of equal vectors
    r[30], q[3] = 0, 0
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    rs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "reference_id int, embedding array<double>")
    visited = []
    got = N.nearest(qs, rs, 3, visited=visited).toPandas().sort_values(["query_id", "rank"])

    def unit(m):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    sims = np.round(unit(q) @ unit(r).T, 9)
    assert got["reference_id"].tolist() == np.argsort(-sims, axis=1, kind="stable")[:, :3].ravel().tolist()
    assert visited[0] == 25
    if spread < 1:
        assert sum(visited) < 25 * 31 / 2
    assert N.nearest(qs.limit(0), rs, 3).count() == 0 and N.nearest(qs, rs.limit(0), 3).count() == 0


GTF = """#c
1\ts\ttranscript\t1\t300\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; transcript_biotype "protein_coding";
1\ts\texon\t1\t100\t.\t-\t.\tgene_id "G1"; transcript_id "T1";
1\ts\texon\t201\t300\t.\t-\t.\tgene_id "G1"; transcript_id "T1";
1\ts\tCDS\t51\t100\t.\t-\t.\tgene_id "G1"; transcript_id "T1";
1\ts\tCDS\t201\t250\t.\t-\t.\tgene_id "G1"; transcript_id "T1";
short line
"""


def test_annotation_regions_and_windows(spark):
    d = folder()
    with open(f"{d}/a.gtf", "w") as f:
        f.write(GTF)
    assert [tuple(r) for r in jobs.build_gene_map(spark, f"{d}/a.gtf", "gtf").collect()] == [("T1", "G1")]
    a = annotation.read_annotation(spark, f"{d}/a.gtf", "gtf", exact=True)
    exons = R.transcript_exons(a)
    segs = R.project_features(a, exons)
    assert sorted((r["seg_start"], r["seg_end"]) for r in segs.collect()) == [(51, 100), (101, 150)]
    both = sorted((r["label"], r["seg_start"], r["seg_end"]) for r in R.infer_utrs(segs, exons).collect())
    assert both == [("3UTR", 151, 200), ("5UTR", 1, 50), ("CDS", 51, 100), ("CDS", 101, 150)]
    spans = spark.createDataFrame([("T1", 1, 40, 1), ("T1", 40, 90, 2), ("no", 1, 40, 3)], "transcript_id string, window_start int, window_end int, window_rank int")
    got = {r["window_rank"]: r for r in R.annotate_windows(spans, a).collect()}
    assert [got[i]["region_type"] for i in (1, 2, 3)] == ["unknown", "CDS", "unknown"]
    assert [got[i]["inferred_region_type"] for i in (1, 2, 3)] == ["5UTR", "CDS", "unknown"]
    assert R.annotate_windows(spans, None).first()["region_type"] == "NA"
    assert R.annotate_windows(spans, a, enabled=False).first()["is_CDS"] is None


def test_fasta_sources(spark):
    d = folder()
    with gzip.open(f"{d}/x.fa.gz", "wt") as f:
        f.write("junk\n>t1 some text\nACGT\nAC\n>t2\n\n>t1 again\nGG\n")
    got = sorted(tuple(r) for r in fasta.read_fasta(spark, f"{d}/x.fa.gz", leading_text=True).collect())
    assert got == [("t1", "ACGTAC"), ("t1", "GG"), ("t2", "")]
    with open(f"{d}/p.fa", "w") as f:
        f.write(">r|s|resolved=A1|requested=A2\nMKB*\n>h\nAA1\n>h\nCC\n")
    full = fasta.read_fasta_full(spark, f"{d}/p.fa")
    assert {r["header"]: r["sequence"] for r in full.collect()} == {"r|s|resolved=A1|requested=A2": "MKB*", "h": "CC"}
    look = sorted(tuple(r) for r in fasta.accession_lookup(full).collect())
    assert look == [("r", "s", "A1", "MKX"), ("r", "s", "A2", "MKX")]


def test_tables_and_sinks(spark):
    d = folder()
    df = spark.createDataFrame([("g1", 1.0), ("g2", float("nan"))], "gene_id string, score double")
    tables.write_table(df, f"{d}/t", compressed=True)
    back = tables.read_table(spark, f"{d}/t", ["gene_id"], "gene_id string, score double")
    assert {r["gene_id"]: r["score"] for r in back.collect()} == {"g1": 1.0, "g2": None}
    assert tables.read_any(spark, f"{d}/t").columns == ["gene_id", "score"]
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{d}/t", ["nope"])
    truth = spark.createDataFrame([("a",), ("a",), (None,)], "target_gene_id string")
    assert [r[0] for r in tables.read_truth(truth).collect()] == ["a"]
    with pytest.raises(ValueError):
        tables.read_truth(truth, strict=True)
    ranked = spark.createDataFrame([("r/1", f"g{i}", i) for i in (2, 1, 3)], "rbp_id string, gene_id string, rank int")
    tables.write_gene_lists(ranked, f"{d}/lists", (2, 3))
    assert [r[0] for r in spark.read.text(f"{d}/lists/rbp_id=r_1/top_k=2").collect()] == ["g1", "g2"]
    assert [r[1] for r in tables.query_ids(spark, " b, a,,b ").orderBy("position").collect()] == ["b", "a"]


def test_streams_equal_batch_over_many_batches(spark):
    d = folder()
    rows = pd.DataFrame({"k": [i % 3 for i in range(60)], "s": [(i * 37) % 23 * 1.0 for i in range(60)], "id": range(60)})
    data = spark.createDataFrame(rows).select(F.col("k").cast("int"), "s", F.col("id").cast("int"))
    data.repartition(5).write.parquet(f"{d}/in")
    stream = lambda: spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    order = [F.col("s").desc(), F.col("id")]
    got = finished(stream_top_n(stream(), ["k"], order, 3, f"{d}/a", f"{d}/la"), spark, f"{d}/a")
    want = G.top_n(data, ["k"], order, 3, "window_rank")
    assert sorted(map(tuple, got.select("k", "id", "window_rank").collect())) == sorted(map(tuple, want.select("k", "id", "window_rank").collect()))
    ext = finished(stream_extremes(stream(), ["k"], "s", f"{d}/b", f"{d}/lb"), spark, f"{d}/b")
    for r in ext.collect():
        part = rows[rows["k"] == r["k"]]["s"]
        assert (r["least"], r["greatest"], r["n"]) == (part.min(), part.max(), 20)


def test_audits(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    with pytest.raises(Exception, match="expected one row"):
        Q.exactly_one(one, "k").collect()
    assert tuple(Q.duplicate_keys(one, ["k"]).first()) == (3, 2, 1, 1)
    ids = spark.createDataFrame([(0,), (1,), (3,)], "r int")
    row = Q.row_id_check(ids, "r").first()
    assert row["is_unique"] and not row["is_contiguous"]


def test_context_pipeline_smoke(spark):
    """Four genes, two windows each, through features, grid, calibration and oracle."""
    rows = [(f"g{g}", f"t{g}", 1 + 50 * w, 24 + 50 * w, "AUGCAUGCUUUUACGUACGUAAUU", 0.9 - 0.1 * g - 0.05 * w) for g in range(4) for w in range(2)]
    windows = spark.createDataFrame(rows, "gene_id string, transcript_id string, window_start int, window_end int, rna_seq string, score double")
    pairing = windows.select("transcript_id", "window_start", "window_end", F.expr("transform(sequence(0,23), i -> 0.1 + i*0.8/23 + window_start/1000)").alias("paired"))
    top = G.top_windows(windows, "score", 3)
    modules = jobs.window_modules(top, None, pairing)
    base = G.baseline_table(windows.groupBy("gene_id").agg(F.avg("score").alias("top3_mean_score"), F.count("*").alias("n_windows")), "s")
    table = jobs.context_features(modules, base)
    assert table.count() == 4 and table.first()["best_window_region_type"] == "NA"
    grid = C.context_candidates(C.context_bonuses(table), [0.1, 0.5])
    assert grid.count() == 4 * (1 + 3 * 2 + 8)
    truth = spark.createDataFrame([("g0",), ("g1",)], "gene_id string")
    out = jobs.context_calibration(grid, truth, [1, 2], 0.5, (1, 2, 200, 500))
    assert out["selected"].count() == 2 * 5 and out["oracle"].count() == 5 * 4
    with pytest.raises(ValueError):
        jobs.context_calibration(grid, truth, [1], 0.5, (1, 2))
    wide = jobs.diagnostic_features(modules, base, 3)
    many = C.diagnostic_candidates(C.diagnostic_components(wide), [0.1], 3)
    assert many.select("candidate").distinct().count() == 6 + 2 + 4 + 1 + 4


def test_score_and_feature_jobs(spark):
    """Files to scores, gene tables and the forty features."""
    d = folder()
    with open(f"{d}/t.fa", "w") as f:
        for i in range(6):
            f.write(f">t{i}\n{('ACGUU' * (8 + i))[i:]}\n")
    gm = spark.createDataFrame([(f"t{i}", f"g{i // 2}") for i in range(6)], "transcript_id string, gene_id string")
    windows = jobs.build_windows(spark, f"{d}/t.fa", gm, 20, 10)
    profiles = spark.createDataFrame([("r1", i, (i % 7) - 3.0) for i in range(16384)], "rbp_id string, kmer_idx bigint, zscore double")
    pairing = windows.select("transcript_id", "window_start", "window_end", F.expr("transform(sequence(0,19), i -> (i * window_start) % 10 / 10e0)").alias("paired"))
    scored = jobs.score_windows(windows, profiles, F.length("rna_seq") / F.lit(100.0) + F.col("window_start") / F.lit(50.0), pairing)
    assert scored.count() == windows.count() and scored.where("posthoc_score is null").count() == 0
    table, views = jobs.rank_genes(scored)
    assert table.count() == 3 and views.count() == 18
    feats = jobs.gene_feature_table(scored, pairing, ["UUUUUUU"])
    assert feats.count() == 3 and "n_windows_bin_code" in feats.columns
    truth = spark.createDataFrame([("g0",), ("g1",)], "gene_id string")
    base = jobs.baseline_run(table, truth, [1, 2])
    assert base["audit"].count() == 6 and base["heldout"].count() == 10
    assert jobs.two_branch_validation(feats, ["paired_run_density_top3"], truth, [1]).count() == 6 * 5


def test_enrichment_keeps_truth_groups_without_a_gene(spark):
    genes = spark.createDataFrame([("a", "g1", 1.0), ("a", "g2", 2.0), ("b", "g3", None)], "name string, gene_id string, s double")
    truth = spark.createDataFrame([(1, "g1"), (2, "g9")], "seed int, gene_id string")
    rows = {(r.name, r.seed): r for r in E.topk_enrichment(genes, truth, "s", (1, 5), ["name"], ["seed"]).where("top_k = 5").collect()}
    assert set(rows) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert (rows["a", 1].overlap, rows["a", 1].truth_genes) == (1, 1)
    assert (rows["b", 2].overlap, rows["b", 2].truth_genes, rows["b", 2].recall) == (0, 0, None)
