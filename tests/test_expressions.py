import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqrank.functions import labels as L
from seqrank.functions import sequence as S
from seqrank.functions import structure as A
from seqrank.functions.numeric import clamp_finite, finite, hypergeom_sf, mean_of, sigmoid
from seqrank.operators.features import HAIRPIN_FEATURES, hairpin_columns
from seqrank.operators.motif import scan_windows
from seqrank.operators.repeats import repeat_table

COMPLEMENT = str.maketrans("ACGU", "UGCA")
EDGES = ["", "ACG", "UUUUUUUUUU", "ACACACACACAC", "ACGU", "ACGUNACGUACGU", "AUGCAUGCAUGCAUGC"]


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


def words(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def brute_repeats(s):
    out = {}
    density = lambda t, k: (sum(rc(w) in set(words(t, k)) for w in words(t, k)) / len(words(t, k))) if len(t) >= k else None
    for k in (4, 5, 6):
        out[f"reverse_complement_{k}mer_density"] = density(s, k)
    out["longest_internal_rc_match"] = max([k for k in range(4, 13) if set(map(rc, words(s, k))) & set(words(s, k))], default=0)
    pairs, w5 = 0, words(s, 5)
    for w in set(w5):
        if w < rc(w):
            pairs += w5.count(w) * w5.count(rc(w))
    out["internal_rc_pair_count"] = pairs
    pal = [sum(w == rc(w) for w in words(s, k)) / len(words(s, k)) for k in (4, 6) if len(s) >= k]
    out["palindrome_score"] = sum(pal) / len(pal) if pal else None

    def local(t):
        d = [x for x in (density(t, 4), density(t, 5)) if x is not None]
        return sum(d) / len(d) if d else None

    out["local_self_complementarity_score"] = (
        local(s) if len(s) <= 40 else max(local(s[i : i + 40]) for i in range(0, len(s) - 39, 20))
    )
    return out


def test_repeat_features_against_brute_force(spark):
    rng = random.Random(1)
    seqs = [s for s in EDGES if s] + ["".join(rng.choice("ACGU") for _ in range(n)) for n in (39, 40, 41, 60, 75, 200)]
    got = repeat_table(spark.createDataFrame([(s,) for s in seqs + [""]], "rna_seq string")).collect()
    for row in got:
        if row["rna_seq"] == "":
            assert row["reverse_complement_4mer_density"] is None
            assert row["longest_internal_rc_match"] == 0
            continue
        for name, want in brute_repeats(row["rna_seq"]).items():
            assert row[name] == (want if want is None else pytest.approx(want)), (row["rna_seq"], name)
        assert row["overlap_TE"] is None


def test_repeat_versions_differ(spark):
    df = spark.createDataFrame([("AUGCAUGCAUGCAUGC",)], "rna_seq string")
    a, b = (repeat_table(df, version=v).first()["inverted_repeat_score"] for v in ("v2", "v2_1"))
    assert a != b
    with pytest.raises(ValueError):
        repeat_table(df, version="other")


def test_scan_windows_against_brute_force(spark):
    rng = random.Random(2)
    score = {(r, i): rng.uniform(-3, 3) for r in ("a", "b") for i in range(64) if rng.random() < 0.7}
    profiles = spark.createDataFrame([(r, i, z) for (r, i), z in score.items()], "rbp_id string, kmer_idx bigint, zscore double")
    seqs = ["", "AC", "ACG", "ACGNNACGU"] + ["".join(rng.choice("ACGU") for _ in range(30)) for _ in range(5)]
    windows = spark.createDataFrame(list(enumerate(seqs)), "w int, rna_seq string")
    for row in scan_windows(windows, profiles, k=3, top=3).collect():
        index = [sum("ACGU".index(c) * 4 ** (2 - j) for j, c in enumerate(w)) for w in words(row["rna_seq"], 3) if "N" not in w]
        z = sorted((score[(row["rbp_id"], i)] for i in index if (row["rbp_id"], i) in score), reverse=True)
        assert row["motif_scanned_kmer_count"] == len(z)
        if z:
            assert row["motif_match_max_zscore"] == pytest.approx(z[0])
            assert row["motif_match_top_mean_zscore"] == pytest.approx(np.mean(z[:3]))
            assert row["motif_match_mean_zscore"] == pytest.approx(np.mean(z))
            assert row["motif_positive_fraction"] == pytest.approx(np.mean([x > 0 for x in z]))
        else:
            assert row["motif_match_max_zscore"] is None and row["motif_positive_fraction"] is None


def test_scan_keeps_to_own_protein(spark):
    profiles = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "rbp_id string, kmer_idx bigint, zscore double")
    windows = spark.createDataFrame([("AAAA", "a"), ("AAAA", "b")], "rna_seq string, rbp_id string")
    got = {r["rbp_id"]: r["motif_match_max_zscore"] for r in scan_windows(windows, profiles, k=3).collect()}
    assert got == {"a": 1.0, "b": 2.0}


def hairpin_brute(p):
    high = [x >= 0.7 for x in p]
    runs = [len(r) for r in "".join("1" if h else " " for h in high).split()]
    slide = lambda w: np.mean(p) if len(p) < w else max(np.mean(p[i : i + w]) for i in range(len(p) - w + 1))
    dens, longest = np.mean(high), max(runs, default=0)
    stem = np.mean([min(longest / 40, 1), slide(41), dens])
    peak = max(slide(31), slide(41), slide(81)) - np.mean(p)
    return {
        "longest_high_paired_run": longest,
        "high_paired_run_count": len(runs),
        "paired_run_density": dens,
        "paired_unpaired_boundary_count": sum(a != b for a, b in zip(high, high[1:])),
        "max_local_paired_mean_31nt": slide(31),
        "stem_like_score": stem,
        "structure_peakiness_score": peak,
        "paired_architecture_score": np.mean([stem, dens, slide(41), slide(81), min(longest / 50, 1), max(peak, 0)]),
    }


def test_hairpin_features(spark):
    rng = random.Random(3)
    vectors = [[rng.random() for _ in range(n)] for n in (1, 8, 30, 31, 41, 90, 200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(97, []), (98, None), (99, [None, float("nan")])], "i int, paired array<double>")
    for row in hairpin_columns(df, "paired").collect():
        if row["i"] >= 97:
            assert all(row[n] is None for n in HAIRPIN_FEATURES)
            continue
        for name, want in hairpin_brute(vectors[row["i"]]).items():
            assert row[name] == pytest.approx(want), name
    assert hairpin_columns(df, None).first()["stem_like_score"] is None


def test_rich_paired_density_keeps_positions(spark):
    df = spark.createDataFrame([("UUUUUUUACGACG", [0.9] * 7 + [0.1] * 6), ("UUU", [0.9] * 3), ("UUUUUUU", [None] * 7)], "s string, p array<double>")
    got = [r[0] for r in df.select(A.rich_paired_density("s", "p", "U", 5)).collect()]
    # stretches at 0, 1 and 2 have enough U; the third one averages below 0.7
    assert got[0] == pytest.approx(2 / 7) and got[1] is None and got[2] is None


def test_pairing_numbers_come_in_batches(spark):
    """Vectors of any lengths with gaps, NaN and infinities, without an interpreted loop over each vector."""
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    draw = lambda: rng.choice([None, nan, 0.7, 0.9, rng.random(), rng.random()])
    rows = [(i, "".join(rng.choice("ACGUé") for _ in range(rng.choice([0, 6, 7, 30]))), [draw() for _ in range(rng.choice([0, 5, 7, 30, 45]))]) for i in range(60)]
    rows += [(98, "UUUUUUUU", [inf] + [0.8] * 7), (99, None, [0.9] * 9), (100, "UUUUUUU", None)]
    df = spark.createDataFrame(rows, "i int, s string, p array<double>")
    out = hairpin_columns(df, "p").withColumn("rich", A.rich_paired_density("s", "p", "U", 2))
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        seen = [x for x in r["p"] or [] if x is not None and x == x]
        for name in ("longest_high_paired_run", "high_paired_run_count", "paired_run_density", "paired_unpaired_boundary_count") if seen else ():
            assert r[name] == pytest.approx(hairpin_brute(seen)[name])
        if seen and inf not in seen:
            assert r["max_local_paired_mean_31nt"] == pytest.approx(hairpin_brute(seen)["max_local_paired_mean_31nt"])
        text = r["s"] or ""
        if len(text) < 7 or not seen:
            assert r["rich"] is None
            continue
        hits = 0
        for k in range(min(len(text), len(r["p"])) - 6):
            known = [x for x in r["p"][k : k + 7] if x is not None]
            mean = sum(known) / len(known) if known else 0.0
            hits += text[k : k + 7].count("U") >= 2 and (mean >= 0.7 or mean != mean)
        assert r["rich"] == pytest.approx(hits / (len(text) - 6))


def test_hypergeom_published_values(spark):
    rows = [(55382, 283, 50, 4, 1.2775e-4), (55382, 283, 200, 16, 1.0297934227e-14), (55382, 283, 1000, 48, 7.0377247908e-32)]
    df = spark.createDataFrame(rows, "m bigint, n bigint, d bigint, k bigint, want double")
    for r in df.select("want", hypergeom_sf(F.col("k"), F.col("m"), F.col("n"), F.col("d")).alias("p")).collect():
        assert r["p"] == pytest.approx(r["want"], rel=1e-4)


def test_hypergeom_small_cases_and_tails(spark):
    def exact(m, n, d, k):
        return sum(math.comb(n, j) * math.comb(m - n, d - j) for j in range(k, min(n, d) + 1) if d - j <= m - n) / math.comb(m, d)

    rows = [(m, n, d, k) for m in (5, 9) for n in range(0, m + 1) for d in range(1, m + 1) for k in range(0, d + 1)]
    df = spark.createDataFrame(rows, "m bigint, n bigint, d bigint, k bigint")
    for r in df.select("*", hypergeom_sf(F.col("k"), F.col("m"), F.col("n"), F.col("d")).alias("p")).collect():
        assert r["p"] is None if r["n"] == 0 else r["p"] == pytest.approx(exact(r["m"], r["n"], r["d"], r["k"]), abs=1e-12)
    far = spark.createDataFrame([(100000, 50000, 2000, 1)], "m bigint, n bigint, d bigint, k bigint")
    assert far.select(hypergeom_sf(F.col("k"), F.col("m"), F.col("n"), F.col("d"))).first()[0] == pytest.approx(1.0)


def test_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    got = [tuple(r) for r in df.select(finite("x"), clamp_finite("x"), clamp_finite("x", 10.0), sigmoid("x"), mean_of("x", F.lit(None))).collect()]
    assert got[0][:3] == (None, 0.0, 0.0)
    assert got[1][:3] == (None, 0.0, 10.0)
    assert got[2][:3] == (None, 0.0, 0.0)
    assert got[3][0] == 2.0 and got[3][3] == pytest.approx(1 / (1 + math.exp(-2)))
    assert spark.range(1).select(sigmoid(F.lit(800.0)), sigmoid(F.lit(-800.0))).first() == (1.0, 0.0)


def test_sequences(spark):
    df = spark.createDataFrame([(s,) for s in EDGES], "s string")
    rows = df.select("s", S.kmers("s", 4).alias("k"), S.u_word_count("s").alias("u7"), S.longest_u_run("s").alias("run"), S.entropy("s").alias("h")).collect()
    for r in rows:
        s = r["s"]
        assert r["k"] == words(s, 4)
        assert r["u7"] == sum(s[i : i + 7] == "U" * 7 for i in range(len(s)))
        assert r["run"] == max((len(x) for x in "".join(c if c == "U" else " " for c in s).split()), default=0)
        assert (r["h"] is None) == (s == "")
    row = spark.range(1).select(S.kmer_index(F.lit("ACGU")), S.kmer_index(F.lit("ACGN")), S.kmer_text(F.lit(27), 4), S.rna(F.lit("acgT"))).first()
    assert tuple(row) == (27, None, "ACGU", "ACGU")


def test_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(L.motif_group(F.lit("UGUAAAA"))) == "PUF_like_UGUA_UUGA"
    assert one(L.motif_group(F.lit("AAUAAAC"))) == "A_rich_polyA"
    assert one(L.motif_group(F.lit("UCUCUCG"))) == "UC-rich"
    assert one(L.motif_group(F.lit("GGGGACC"))) == "G-rich"
    assert one(L.canonical_protein(F.lit("ARATH|AGO1|x|y"))) == "AtAGO1"
    assert one(L.canonical_protein(F.lit("AtHYL1/DRB1"))) == "AtHYL1_DRB1"
    assert one(L.canonical_protein(F.lit(None).cast("string"))) == ""
    assert one(L.family_bucket(F.lit("w3"), F.lit(""), F.lit(""))) == "RBNS_lab"
    assert one(L.collapse_status(F.lit("G-rich"), F.lit("U-rich"))) == "collapsed_to_U_UC"
    assert one(L.motif_tokens(F.lit("binds tgtanata, aauaaa"))) == ["UGUANAUA", "AAUAAA"]


def test_pairing_statistics_of_pandas(spark):
    v = [0.1, 0.9, 0.7, 0.3]
    df = spark.createDataFrame([(v,)], "p array<double>")
    got = df.select(*[c.alias(n) for n, c in A.pairing_statistics("p").items()]).first()
    s = pd.Series(v)
    assert tuple(got) == pytest.approx((s.mean(), s.median(), 0.9, 0.5, 0.5))
