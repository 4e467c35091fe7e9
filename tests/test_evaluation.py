"""Ordered digests, pairing by position, profile metadata and the evaluation of motif models."""

import hashlib

import pytest
from pyspark.sql import functions as F

from seqrank.functions import labels as L
from seqrank.operators import audit as Q
from seqrank.operators import clusters as K
from seqrank.operators import motif as M
from seqrank.operators.ranking import text_number


def plain_digest(texts, width):
    level = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    while True:
        level = [hashlib.sha256("".join(level[i : i + width]).encode()).hexdigest() for i in range(0, len(level), width)]
        if len(level) <= 1:
            return level[0] if level else hashlib.sha256(b"").hexdigest()


def windows(spark, n, parts=4):
    rows = [(f"tx{i // 3:03}", 1 + 50 * (i % 3), 200 + 50 * (i % 3), "ACGU"[i % 4] * 5 + "A" * (i % 7)) for i in range(n)]
    return rows, spark.createDataFrame(rows[::-1], "transcript_id string, window_start int, window_end int, rna_seq string").repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 10, 11, 100, 437])
def test_digest_is_that_of_the_order(spark, n):
    rows, table = windows(spark, n)
    for parts in (1, 5):
        found = Q.ordered_digest(table.repartition(parts), ["transcript_id", "window_start"], F.col("rna_seq"), text_number("transcript_id"), width=10).first()
        assert (found.n_rows, found.digest) == (n, plain_digest([r[3] for r in rows], 10))


def test_vectors_without_keys_are_paired_by_row(spark):
    rows, table = windows(spark, 60)
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(60)], "position long, paired array<double>")
    digest = Q.window_digest(table).first().digest
    out = Q.pair_by_position(table, vectors, digest).collect()
    assert sorted((r.transcript_id, r.window_start, r.paired) for r in out) == [(*r[:2], [float(i)]) for i, r in enumerate(rows)]
    changed = table.withColumn("rna_seq", F.when(F.col("transcript_id") == "tx007", "GGG").otherwise(F.col("rna_seq")))
    renamed = table.withColumn("transcript_id", F.when(F.col("transcript_id") == "tx007", "tx999").otherwise(F.col("transcript_id")))
    for other in (changed, renamed):
        with pytest.raises(ValueError, match="order"):
            Q.pair_by_position(other, vectors, digest)
    for other in (vectors.limit(59), vectors.withColumn("position", F.col("position") + 1), vectors.withColumn("position", F.col("position") % 59)):
        with pytest.raises(ValueError, match="vectors"):
            Q.pair_by_position(table, other)


def test_metadata_follows_the_matrix(spark):
    matrix = spark.createDataFrame([("AAT", 1.0, None, 3.0), ("ACG", float("nan"), 5.0, 6.0)], "kmer string, p3 double, p1 double, p2 double")
    rows = [("p1", "first " + "A" * 30, 1), ("p1", "later", 2), ("p2", "short", 1), ("p3", "mkv*" * 10, 5), ("px", "A" * 40, 1)]
    metadata = spark.createDataFrame(rows, "id string, aa string, pos int")
    kept = M.profile_metadata(matrix, metadata, "id", "aa", F.col("pos"))
    assert [(r.place, r.profile_id, r.protein_length) for r in kept.orderBy("place").collect()] == [(0, "p3", 30), (1, "p1", 36)]
    long = M.placed_profiles(matrix, kept)
    assert sorted((r.place, r.kmer, r.zscore, r.is_finite) for r in long.collect()) == [(0, "AAU", 1.0, True), (0, "ACG", 0.0, False), (1, "AAU", 0.0, False), (1, "ACG", 5.0, True)]
    with pytest.raises(Exception, match="no metadata for profile p3"):
        M.profile_metadata(matrix, metadata.where("id <> 'p3'"), "id", "aa", F.col("pos")).collect()


def test_flags_and_choice_of_k(spark):
    names = ["w1", "w5", "w6", "AtAPUM23", "AtAGO1", "NP1"]
    proteins = spark.createDataFrame([(n,) for n in names], "rbp_id string").withColumn("protein_family", L.family_bucket("rbp_id", F.lit(""), F.lit("")))
    truth = spark.createDataFrame([(n, int(n != "NP1")) for n in names] + [("w1", 0)], "rbp_id string, use_for_training int")
    found = {r.rbp_id: (r.control_only, r.strict_train, r.split, r.class_pool) for r in K.training_flags(proteins, truth).collect()}
    assert found == {
        "w1": (0, 1, "train", 1),
        "w5": (1, 0, "none", 1),
        "w6": (0, 1, "validation", 0),
        "AtAPUM23": (0, 1, "validation", 0),
        "AtAGO1": (1, 0, "none", 1),
        "NP1": (0, 0, "none", 0),
    }
    rows = spark.createDataFrame([("a", 7, "A" * 7, 0.5), ("b", 7, "A" * 7, 0.0), ("b", 6, "A" * 6, 1.0)], "rbp_id string, k int, kmer string, truth_score double")
    assert {r.rbp_id: r.metric_k for r in K.chosen_k(rows).collect()} == {"a": 7, "b": 6}
