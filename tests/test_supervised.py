"""Training sets and calibration models against plain Python and NumPy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrank.operators import supervised as SV
from seqrank.operators.quantiles import array_quantiles
from seqrank.plans import jobs


def taken_one_by_one(positives, candidates, seed):
    """For each positive in gene order, a gene of the nearest bin with any left; genes of a bin in random order."""
    bins = {}
    for gene, b in candidates:
        bins.setdefault(-1 if b is None else b, []).append(gene)
    for genes in bins.values():
        genes.sort(key=lambda g: (hashlib.md5(f"m:{seed}:{g}".encode()).hexdigest(), g), reverse=True)
    out = []
    for _, b in sorted(positives):
        b = -1 if b is None else b
        for other in sorted(bins, key=lambda x: (abs(x - b), x)):
            if bins[other]:
                out.append(bins[other].pop())
                break
    return sorted(out)


@pytest.mark.parametrize("blocks", [1, 3, 1024])
def test_matches_are_taken_in_gene_order(spark, monkeypatch, blocks):
    """Bins run out at different places of the gene order, for some seeds all of them."""
    monkeypatch.setattr(SV, "BLOCKS", blocks)
    rng = random.Random(4)
    positives, candidates = [], []
    for seed, n, m in ((1, 60, 90), (2, 80, 50), (3, 5, 0), (4, 40, 400)):
        positives += [(seed, f"p{rng.randrange(10**6)}", rng.choice([0, 1, 1, 1, 5, 9, None])) for _ in range(n)]
        candidates += [(seed, f"n{rng.randrange(10**6)}", rng.choice([0, 2, 4, 5, 8, None])) for _ in range(m)]
    schema = "seed int, gene_id string, bin int"
    found = SV.matched_negatives(spark.createDataFrame(candidates, schema), spark.createDataFrame(positives, schema), "bin")
    got = {}
    for r in found.collect():
        got.setdefault(r.seed, []).append(r.gene_id)
    for seed in (1, 2, 3, 4):
        want = taken_one_by_one([p[1:] for p in positives if p[0] == seed], [c[1:] for c in candidates if c[0] == seed], seed)
        assert sorted(got.get(seed, [])) == want


def test_the_order_decides_what_a_bin_gives():
    """The same two genes in another order are served by other bins; as a block without an order they can't be served."""
    for order, given in (([6, 4], {0: 1, 5: 1, 8: 0}), ([4, 6], {0: 0, 5: 1, 8: 1})):
        shelf = SV.Shelf({0: 1, 5: 1, 8: 1})
        assert not shelf.serve_block({4: 1, 6: 1})
        shelf.serve_runs((b, 1) for b in order)
        assert shelf.given == given
    shelf = SV.Shelf({0: 2, 9: 1})
    assert shelf.serve_block({1: 2}) and shelf.left == {9: 1}
    shelf.serve_runs([(0, 5)])
    assert shelf.given == {0: 2, 9: 1} and shelf.serving(3) is None


def plain_fit(x, y, w, ridge, lasso):
    """Proximal gradient steps until nothing moves."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(a.shape[1])
    rate = 1 / (0.25 * np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 + ridge)
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-a @ beta))
        slope = a.T @ (w * (p - y))
        slope[:-1] += ridge * beta[:-1]
        new = beta - rate * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * lasso, 0)
        if np.abs(new - beta).max() < 1e-12:
            break
        beta = new
    return beta


@pytest.fixture(scope="module")
def genes(spark):
    rng = np.random.default_rng(5)
    n = 160
    data = []
    for i in range(n):
        x = rng.normal(size=3)
        data.append((f"g{i:03}", None if i % 11 == 0 else float(x[0] + (i % 4 == 0)), float("nan") if i % 13 == 0 else float(3 * x[1]), float(x[2]), 2.0, i % 5))
    return spark.createDataFrame(data, "gene_id string, a double, b double, score double, same double, bin int")


FEATURES = ["a", "b", "score", "same"]


def test_models_are_the_minimum(spark, genes):
    truth = genes.where("cast(substr(gene_id, 2) as int) % 4 = 0").select("gene_id")
    splits = truth.crossJoin(spark.createDataFrame([(7,), (8,)], "seed int")).selectExpr("seed", "gene_id", "if((cast(substr(gene_id, 2) as int) + seed) % 3 = 0, 'heldout', 'calibration') as role")
    roles = SV.training_roles(genes, splits, "score", "bin", hard_pool=60)
    counts = {(r.seed, r.role): r["count"] for r in roles.groupBy("seed", "role").count().collect()}
    for seed in (7, 8):
        positives = counts[seed, "calibration_truth"]
        assert positives + counts[seed, "heldout_truth"] == 40
        assert 2 * positives <= counts[seed, "train_negative"] <= 3 * positives
        assert sum(n for (s, _), n in counts.items() if s == seed) == 160
    rows, stats = SV.standardised(genes, roles, FEATURES)
    models = SV.fit_models(rows, len(FEATURES))
    assert len(models) == 4 and all(m["gap"] < 1e-8 for m in models)
    data = rows.toPandas()
    for m in models:
        mine = data[data.seed == m["seed"]]
        x = np.array(mine.x.tolist())
        assert np.allclose(x.mean(axis=0), 0) and np.allclose(x.std(axis=0), [1, 1, 1, 0])
        lasso = SV.MODELS[m["model_name"]]
        want = plain_fit(x, mine.y.to_numpy(float), mine.weight.to_numpy(), 1 - lasso, lasso)
        assert np.allclose([*m["coefficients"], m["intercept"]], want, atol=1e-6)
    # predictions by hand
    median = {(r.seed, r.feature): r for r in stats.collect()}
    scores = {(r.seed, r.model_name, r.gene_id): r.prediction_score for r in SV.predict(models, genes, stats, FEATURES).collect()}
    assert len(scores) == 4 * 160
    for r in genes.limit(20).collect():
        for m in models:
            margin = m["intercept"]
            for f, b in zip(FEATURES, m["coefficients"], strict=True):
                s = median[m["seed"], f]
                v = s["median"] if r[f] is None or np.isnan(r[f]) else r[f]
                margin += b * (v - s["mean"]) / s["scale"]
            assert scores[m["seed"], m["model_name"], r.gene_id] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_quantiles_of_many_columns(spark):
    """Atoms, gaps, both signs and empty columns, as NumPy has them."""
    rng, n, shares = np.random.default_rng(1), 6000, [0, 0.1, 0.5, 0.77, 1]
    x = np.stack([rng.random(n), rng.normal(size=n) * 1e5, np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)), np.full(n, np.nan), np.where(rng.random(n) < 0.3, np.nan, -rng.random(n))], axis=1)
    group = rng.integers(0, 2, n)
    rows = spark.createDataFrame([(int(g), [None if np.isnan(v) else float(v) for v in r]) for g, r in zip(group, x, strict=True)], "g int, x array<double>").repartition(5)
    found = array_quantiles(rows, [0, 1, 9], 5, shares)
    assert set(found) == {(g, j) for g in (0, 1) for j in (0, 1, 2, 4)}
    for (g, j), got in found.items():
        own = x[group == g, j]
        assert np.allclose(got, np.quantile(own[np.isfinite(own)], shares), rtol=1e-13, atol=0)


def test_a_fit_ends_when_its_steps_no_longer_move(spark, monkeypatch):
    """Sums over heavy rows are never as small as the tolerance."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x[:, 3] = x[:, 2] + 0.01 * x[:, 3]
    data = [(1, int(v), 1e6 * (1 + i % 3), list(map(float, row))) for i, (row, v) in enumerate(zip(x, x[:, 0] + rng.normal(size=300) > 0, strict=True))]
    rows, passes, moments = spark.createDataFrame(data, "seed int, y int, weight double, x array<double>"), [], SV._moments
    monkeypatch.setattr(SV, "_moments", lambda busy: passes.append(1) or moments(busy))
    for m in SV.fit_models(rows, 4):
        a, y, w = np.concatenate([x, np.ones((300, 1))], axis=1), np.array([d[1] for d in data]), np.array([d[2] for d in data])
        slope = a.T @ (w * (1 / (1 + np.exp(-a @ np.array([*m["coefficients"], m["intercept"]]))) - y))
        lasso = SV.MODELS[m["model_name"]]
        assert SV.optimality_gap(np.array([*m["coefficients"], m["intercept"]]), slope, 1 - lasso, lasso) < 1e-4
    assert len(passes) < 20


def test_the_lasso_step_is_the_minimum():
    """Nearly equal columns, some without weight: the step's subgradient is zero."""
    rng = np.random.default_rng(3)
    for lasso in (0.5, 30.0):
        a = rng.normal(size=(200, 6))
        a[:, 1] = a[:, 0] + 1e-3 * a[:, 1]
        gradient, curvature, beta = a.T @ rng.normal(size=200), a.T @ a, rng.normal(size=6)
        step = SV.penalised_step(beta, gradient, curvature, 0.5, lasso)
        assert SV.optimality_gap(step, gradient + curvature @ (step - beta), 0.5, lasso) < 1e-8


def test_predictions_meet_roles_of_their_seed(spark, genes):
    stats = spark.createDataFrame([(s, f, 0.0, 0.0, 1.0, 1, 1) for s in (7, 8) for f in FEATURES], "seed int, feature string, median double, mean double, scale double, n_pos long, n_neg long")
    models = [{"seed": s, "model_name": "m", "coefficients": [0.1 * s, 0.0, 1.0, 0.0], "intercept": 0.5} for s in (7, 8)]
    roles = genes.where("gene_id < 'g010'").selectExpr("gene_id", "explode(array(7, 8)) seed").where("seed = 7 or gene_id < 'g004'")
    roles = roles.selectExpr("seed", "gene_id", "if(seed = 7, 'unlabeled', 'train_negative') role")
    both = SV.predict(models, genes, stats, FEATURES, roles)
    assert both.columns == ["seed", "gene_id", "model_name", "prediction_score", "role"]
    want = SV.predict(models, genes, stats, FEATURES).join(roles, ["seed", "gene_id"])
    assert both.count() == 14 and sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))


def test_feature_calibration_job(spark, genes):
    table = genes.withColumnRenamed("bin", "n_windows_bin_code").withColumnRenamed("score", "top3_mean_score")
    truth = genes.where("cast(substr(gene_id, 2) as int) % 4 = 0").select("gene_id")
    out = jobs.feature_calibration(table, ["a", "b", "top3_mean_score"], truth, [1, 2, 3], ks=(10, 20))
    assert out["predictions"].count() == 3 * 2 * 160
    assert {(r.seed, r.model_name, r.role, r.top_k) for r in out["metrics"].collect()} == {(s, m, p, k) for s in (1, 2, 3) for m in SV.MODELS for p in ("calibration", "heldout") for k in (10, 20)}
    held = out["predictions"].where("seed = 2 and model_name = 'logistic_l2'").orderBy(F.desc("prediction_score"), "gene_id").limit(10)
    hits = out["metrics"].where("seed = 2 and model_name = 'logistic_l2' and role = 'heldout' and top_k = 10").first().overlap
    assert held.where("role = 'heldout_truth'").count() == hits
    assert out["coefficients"].count() == 18 and out["importance"].count() == 6
