"""Training sets with three kinds of negatives, and logistic calibration models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.functions.numeric import finite
from seqrank.operators.quantiles import array_quantiles, numbers
from seqrank.operators.ranking import leading, rank_rows, text_number
from seqrank.session import durable

#: Share of the l1 penalty.
MODELS = {"logistic_l2": 0.0, "logistic_elasticnet": 0.5}
ROLES = ("calibration_truth", "heldout_truth", "train_negative", "unlabeled")


def seeded(seed: Column, what: str) -> Column:
    """Reproducible random order of genes, another one for each seed."""
    return F.md5(F.concat(F.lit(f"{what}:"), seed.cast("string"), F.lit(":"), F.col("gene_id")))


def first_per_seed(rows: DataFrame, what: str, sizes: DataFrame) -> DataFrame:
    """(seed, gene_id): the first rows of each seed in random order, as many as ``sizes`` (seed, n) says."""
    mixed = rows.select("seed", "gene_id").withColumn("_h", seeded(F.col("seed"), what))
    ranked = rank_rows(mixed, ["seed"], [F.col("_h"), F.col("gene_id")], "_r", leading("_h"))
    return ranked.join(sizes, "seed").where(F.col("_r") <= F.col("n")).select("seed", "gene_id")


class Shelf:
    """What each bin has left to give, while genes take from the nearest bin with any left (ties: the lower one).

    The bin that serves a gene's bin changes only when one runs out, so it is remembered until then.
    """

    def __init__(self, available: dict[int, int]):
        self.left = {b: n for b, n in available.items() if n > 0}
        self.given = dict.fromkeys(self.left, 0)
        self._serves: dict[int, int | None] = {}

    def serving(self, wanted: int) -> int | None:
        if wanted not in self._serves:
            self._serves[wanted] = min(self.left, key=lambda b: (abs(b - wanted), b), default=None)
        return self._serves[wanted]

    def give(self, bin_: int, n: int) -> None:
        self.given[bin_] += n
        self.left[bin_] -= n
        if not self.left[bin_]:
            del self.left[bin_]
            self._serves.clear()

    def serve_block(self, wanted: dict[int, int]) -> bool:
        """Serve a block of genes, given by counts of their bins, if no bin runs out within it."""
        need: dict[int, int] = {}
        for b, n in wanted.items():
            s = self.serving(b)
            if s is not None:
                need[s] = need.get(s, 0) + n
        if any(n > self.left[s] for s, n in need.items()):
            return False
        for s, n in need.items():
            self.give(s, n)
        return True

    def serve_runs(self, runs: Iterable[tuple[int, int]]) -> None:
        """Serve genes in order, given as runs (bin, length) of equal bins."""
        for b, n in runs:
            while n and (s := self.serving(b)) is not None:
                take = min(n, self.left[s])
                self.give(s, take)
                n -= take


#: Blocks of positives in gene order whose counts per bin the driver looks at; of a block in which a bin runs out it looks at the runs.
BLOCKS = 1024


def bin_quotas(positives: DataFrame, available: DataFrame, bin_column: str) -> list[tuple[int, int, int]]:
    """(seed, bin, n): how many genes each bin gives when the positives, in gene order, take one each.

    Positives are numbered by gene and counted by (block, bin): the driver sees at most BLOCKS times the
    number of bins (at most twenty) for each seed. Only where a bin runs out does the order inside a block
    matter; that happens at most once for each bin, and then the block's runs of equal bins are read.
    """
    placed = rank_rows(positives.select("seed", "gene_id", bin_column), ["seed"], [F.col("gene_id")], "_r", text_number("gene_id"))
    totals = positives.groupBy("seed").agg(F.count(F.lit(1)).alias("_n"))
    placed = durable(placed.join(totals, "seed").withColumn("_block", ((F.col("_r") - 1) / F.ceil(F.col("_n") / BLOCKS)).cast("int")))
    counts: dict[int, dict[int, dict[int, int]]] = {}
    for r in placed.groupBy("seed", "_block", bin_column).count().collect():
        counts.setdefault(r[0], {}).setdefault(r[1], {})[r[2]] = r[3]
    shelves = {r[0]: {} for r in available.select("seed").distinct().collect()}
    for r in available.collect():
        shelves[r[0]][r[1]] = r[2]
    out = []
    for seed, blocks in sorted(counts.items()):
        shelf = Shelf(shelves.get(seed, {}))
        for block, wanted in sorted(blocks.items()):
            if not shelf.serve_block(wanted):
                inside = placed.where((F.col("seed") == seed) & (F.col("_block") == block)).select("_r", bin_column)
                shelf.serve_runs((r[1], 1) for r in sorted(inside.collect()))
        out += [(seed, b, n) for b, n in sorted(shelf.given.items()) if n]
    return out


def matched_negatives(candidates: DataFrame, positives: DataFrame, bin_column: str) -> DataFrame:
    """(seed, gene_id): for each positive in gene order, an unused candidate of the same seed from the nearest window-count bin.

    Both tables have (seed, gene_id, ``bin_column``); a NULL bin counts as -1. Bins give their genes in random order, so
    what a bin gives in the end is a prefix of it, whoever took which.
    """
    spark = candidates.sparkSession
    code = F.coalesce(F.col(bin_column), F.lit(-1)).cast("int").alias("_bin")
    candidates, positives = candidates.select("seed", "gene_id", code), positives.select("seed", "gene_id", code)
    available = candidates.groupBy("seed", "_bin").count()
    quotas = spark.createDataFrame(bin_quotas(positives, available, "_bin"), "seed int, _bin int, _quota long")
    mixed = candidates.withColumn("_h", seeded(F.col("seed"), "m"))
    ranked = rank_rows(mixed, ["seed", "_bin"], [F.col("_h"), F.col("gene_id")], "_r", leading("_h"))
    # a row for each seed and bin
    return ranked.join(F.broadcast(quotas), ["seed", "_bin"]).where(F.col("_r") <= F.col("_quota")).select("seed", "gene_id")


def training_roles(genes: DataFrame, splits: DataFrame, score: str, bin_column: str, hard_pool: int = 1000) -> DataFrame:
    """(seed, gene_id, role) for every seed of ``splits``: calibration_truth, heldout_truth, train_negative or unlabeled.

    Negatives are hard ones (of the ``hard_pool`` best genes, without the truth), ones matched by window count, and random
    ones; of the first and the last at most as many as there are positives. All seeds are drawn together.
    """
    seeds = splits.select("seed").distinct()
    parts = splits.select("seed", "gene_id", F.col("role").alias("_split"))
    # seeds are a short list
    tagged = durable(genes.select("gene_id", score, bin_column).crossJoin(F.broadcast(seeds)).join(parts, ["seed", "gene_id"], "left"))
    positives = tagged.where("_split = 'calibration'")
    n_pos = durable(positives.groupBy("seed").agg(F.count(F.lit(1)).alias("n")))
    free = tagged.where(F.col("_split").isNull())
    pool = genes.orderBy(F.col(score).desc_nulls_last(), F.col("gene_id")).limit(hard_pool).select("gene_id")
    hard = durable(first_per_seed(free.join(pool, "gene_id", "left_semi"), "h", n_pos))
    rest = free.join(hard, ["seed", "gene_id"], "left_anti")
    matched = durable(matched_negatives(rest, positives, bin_column))
    random = first_per_seed(rest.join(matched, ["seed", "gene_id"], "left_anti"), "r", n_pos)
    negatives = hard.unionByName(matched).unionByName(random).distinct().withColumn("_neg", F.lit(1))
    role = (
        F.when(F.col("_split") == "calibration", "calibration_truth")
        .when(F.col("_split") == "heldout", "heldout_truth")
        .when(F.col("_neg") == 1, "train_negative")
        .otherwise("unlabeled")
    )
    return tagged.join(negatives, ["seed", "gene_id"], "left").select("seed", "gene_id", role.alias("role"))


def _row(features: Sequence[str]) -> Column:
    return F.array(*[finite(f) for f in features]).alias("x")


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _spread(centre: dict[int, np.ndarray]):
    """Tasks that add up, for every seed and feature, distances from ``centre`` and their squares; gaps count as the centre."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            seeds, x = np.asarray(batch.column(0)), numbers(batch.column(1), batch.num_rows)
            for seed, middle in centre.items():
                mine = x[seeds == seed] - middle
                mine[~np.isfinite(mine)] = 0.0
                sums[seed] = sums.get(seed, 0.0) + np.stack([mine.sum(axis=0), (mine * mine).sum(axis=0)])
        for seed, (first, second) in sums.items():
            k = len(first)
            yield pa.RecordBatch.from_arrays([pa.array([seed] * k, pa.int32()), pa.array(np.arange(k, dtype=np.int32)), pa.array(first), pa.array(second)], ["seed", "place", "first", "second"])

    return run


def standardised(genes: DataFrame, roles: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training rows (seed, y, weight, x) of all seeds, and (seed, feature, median, mean, scale, n_pos, n_neg).

    Gaps are filled with the seed's training median; then columns have mean 0 and population deviation 1 (constant ones: 0).
    Both classes weigh half of the rows. Medians and deviations come from passes over the rows with all features side by side.
    """
    features, spark = list(features), genes.sparkSession
    seed_type = dict(roles.dtypes)["seed"]
    rows = roles.where(F.col("role").isin("calibration_truth", "train_negative")).join(genes, "gene_id")
    rows = durable(rows.select(F.col("seed").cast("int").alias("seed"), (F.col("role") == "calibration_truth").cast("int").alias("y"), _row(features)))
    # a row for each seed
    counted = {r[0]: (r[1], r[2]) for r in rows.groupBy("seed").agg(F.sum("y"), F.sum(1 - F.col("y"))).collect()}
    medians = array_quantiles(rows.select("seed", "x"), sorted(counted), len(features), [0.5])
    centre = {s: np.array([medians.get((s, j), [0.0])[0] for j in range(len(features))]) for s in counted}
    sums = {s: np.zeros((2, len(features))) for s in counted}
    found = rows.select("seed", "x").mapInArrow(_spread(centre), "seed int, place int, first double, second double").groupBy("seed", "place")
    for r in found.agg(F.sum("first").alias("first"), F.sum("second").alias("second")).collect():
        sums[r.seed][:, r.place] = r["first"], r.second
    out, own = [], {}
    for s, (n_pos, n_neg) in sorted(counted.items()):
        first, second = sums[s] / (n_pos + n_neg)
        scale = np.sqrt(np.maximum(second - first * first, 0.0))
        own[s] = (centre[s], centre[s] + first, np.where(scale > 0, scale, 1.0))
        out += [(s, f, medians.get((s, j), [None])[0], float(own[s][1][j]), float(own[s][2][j]), n_pos, n_neg) for j, f in enumerate(features)]
    stats = spark.createDataFrame(out, "seed int, feature string, median double, mean double, scale double, n_pos long, n_neg long").withColumn("seed", F.col("seed").cast(seed_type))
    weights = {s: np.array([(p + n) / (2.0 * n) if n else 0.0, (p + n) / (2.0 * p) if p else 0.0]) for s, (p, n) in counted.items()}

    def scaled(batches):
        for batch in batches:
            seeds, y, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), numbers(batch.column(2), batch.num_rows)
            weight, z = np.zeros(len(y)), np.zeros_like(x)
            for s, numbers_ in own.items():
                mine = seeds == s
                z[mine], weight[mine] = _scaled(x[mine], *numbers_), weights[s][y[mine]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight), _lists(z)], ["seed", "y", "weight", "x"])

    training = durable(rows.mapInArrow(scaled, "seed int, y int, weight double, x array<double>"))
    return training.withColumn("seed", F.col("seed").cast(seed_type)), stats


def _scaled(x: np.ndarray, median: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """``x`` with its gaps filled, by the numbers of one seed."""
    return (np.where(np.isfinite(x), x, median) - mean) / scale


def _moments(models: dict[tuple[int, str], np.ndarray]):
    """Tasks that add up, for every model of a row's seed, loss, gradient and curvature of the weighted logistic loss."""

    def run(batches):
        sums: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            seeds = np.asarray(batch.column(0))
            y, weight = np.asarray(batch.column(1), dtype=float), np.asarray(batch.column(2))
            x = numbers(batch.column(3), batch.num_rows)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            rows = {seed: seeds == seed for seed, _ in models}
            rows = {seed: (x[mine], y[mine], weight[mine]) for seed, mine in rows.items() if mine.any()}
            for key, beta in models.items():
                if key[0] not in rows:
                    continue
                a, t, w = rows[key[0]]
                margin = a @ beta
                p = 1.0 / (1.0 + np.exp(-margin))
                loss = (w * (np.logaddexp(0.0, margin) - t * margin)).sum()
                parts = np.concatenate([[loss], a.T @ (w * (p - t)), ((a.T * (w * p * (1 - p))) @ a)[np.triu_indices(a.shape[1])]])
                sums[key] = sums.get(key, 0.0) + parts
        for (seed, name), parts in sums.items():
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([seed] * k, pa.int32()), pa.array([name] * k), pa.array(np.arange(k, dtype=np.int32)), pa.array(parts)], ["seed", "model", "place", "value"])

    return run


def soft(value: float, limit: float) -> float:
    return float(np.sign(value) * max(abs(value) - limit, 0.0))


def penalised_step(beta: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, ridge: float, lasso: float) -> np.ndarray:
    """The minimum of the loss's quadratic approximation at ``beta`` with both penalties (the last number, the intercept, has none)."""
    n = len(beta)
    flat = np.append(np.full(n - 1, ridge), 0.0)
    if not lasso:
        return beta - np.linalg.solve(curvature + np.diag(flat), gradient + flat * beta)
    out, slope = beta.copy(), gradient.copy()  # slope of the approximation at ``out``
    for sweep in range(10_000):
        if sweep % 10 == 9:
            # with the signs so far, the minimum is the solution of a linear system; if it keeps them, it is that of the whole
            on = np.append(out[:-1] != 0, True)
            sign = np.append(np.sign(out[:-1]), 0.0)[on]
            free = np.linalg.solve(curvature[np.ix_(on, on)] + np.diag(flat[on]), curvature[on] @ beta - gradient[on] - lasso * sign)
            whole = np.zeros(n)
            whole[on] = free
            off = (gradient + curvature @ (whole - beta))[~on]
            if (np.sign(free[:-1]) == sign[:-1]).all() and (np.abs(off) <= lasso).all():
                return whole
        moved = 0.0
        for j in range(n):
            h = curvature[j, j]
            target = h * out[j] - slope[j]
            new = target / h if j == n - 1 else soft(target, lasso) / (h + ridge)
            if new != out[j]:
                slope += curvature[:, j] * (new - out[j])
                moved = max(moved, abs(new - out[j]))
                out[j] = new
        if moved < 1e-13:
            break
    return out


def optimality_gap(beta: np.ndarray, gradient: np.ndarray, ridge: float, lasso: float) -> float:
    """How far the best subgradient of the penalised loss is from zero."""
    slope = gradient.copy()
    slope[:-1] += ridge * beta[:-1]
    inner = beta[:-1] == 0
    gap = np.where(inner, np.maximum(np.abs(slope[:-1]) - lasso, 0.0), np.abs(slope[:-1] + lasso * np.sign(beta[:-1])))
    return float(max(gap.max(initial=0.0), abs(slope[-1])))


def fit_models(training: DataFrame, n_features: int, steps: int = 60, tolerance: float = 1e-9) -> list[dict]:
    """Logistic models of all seeds: minimum of the weighted loss + (1 - l1) / 2 |b|^2 + l1 |b|, intercepts free.

    Every step is one pass over the rows for all models: loss, gradient and curvature are partial sums by task and number
    ((p + 2)(p + 1) / 2 + 1 or so for a model), so only these reach the driver. Newton steps solve the ridge, coordinate descent
    on the curvature the elastic net; a step that doesn't lower the objective is halved. Returned are seed, model, coefficients, intercept and
    the optimality gap.
    """
    seeds = sorted(r[0] for r in training.select("seed").distinct().collect())
    rows = training.select(F.col("seed").cast("int"), F.col("y").cast("double"), "weight", "x")
    size = n_features + 1
    state = {(s, m): {"beta": np.zeros(size), "best": None, "try": np.zeros(size)} for s in seeds for m in MODELS}

    def penalties(name):
        return 1.0 - MODELS[name], MODELS[name]

    for _ in range(steps):
        busy = {k: v["try"] for k, v in state.items() if not v.get("done")}
        if not busy:
            break
        found = rows.mapInArrow(_moments(busy), "seed int, model string, place int, value double").groupBy("seed", "model", "place").agg(F.sum("value").alias("value"))
        sums: dict[tuple[int, str], np.ndarray] = {k: np.zeros(1 + size + size * (size + 1) // 2) for k in busy}
        for r in found.collect():
            sums[r.seed, r.model][r.place] = r.value
        for key, parts in sums.items():
            own, (ridge, lasso) = state[key], penalties(key[1])
            beta = own["try"]
            objective = parts[0] + ridge / 2 * (beta[:-1] ** 2).sum() + lasso * np.abs(beta[:-1]).sum()
            if own["best"] is not None and objective > own["best"] * (1 + 1e-12):
                own["try"] = (own["beta"] + beta) / 2
                if np.abs(own["try"] - own["beta"]).max() < 1e-12:
                    own["done"] = True
                continue
            gradient = parts[1 : 1 + size]
            curvature = np.zeros((size, size))
            curvature[np.triu_indices(size)] = parts[1 + size :]
            curvature = curvature + curvature.T - np.diag(np.diag(curvature)) + 1e-10 * np.eye(size)
            own.update(beta=beta, best=objective, gap=optimality_gap(beta, gradient, ridge, lasso))
            own["try"] = penalised_step(beta, gradient, curvature, ridge, lasso)
            # sums over many rows are rounded: a step that no longer moves is the end, too
            own["done"] = own["gap"] < tolerance or np.abs(own["try"] - beta).max() <= 1e-12 * (1 + np.abs(beta).max())
    return [{"seed": s, "model_name": m, "coefficients": v["beta"][:-1].tolist(), "intercept": float(v["beta"][-1]), "gap": v["gap"]} for (s, m), v in state.items()]


def predict(models: Sequence[dict], genes: DataFrame, stats: DataFrame, features: Sequence[str], roles: DataFrame | None = None) -> DataFrame:
    """(seed, model_name, gene_id, prediction_score) for all genes under all models; with ``roles`` (seed, gene_id, role), for those they have, and their role.

    A gene meets its roles of all seeds at once, before its predictions are made.
    """
    own: dict[int, tuple] = {}
    place = {f: j for j, f in enumerate(features)}
    for r in stats.collect():  # a row for each seed and feature
        median, mean, scale = own.setdefault(r.seed, (np.zeros(len(place)), np.zeros(len(place)), np.ones(len(place))))
        median[place[r.feature]], mean[place[r.feature]], scale[place[r.feature]] = r["median"] or 0.0, r["mean"], r["scale"]
    rows = genes.select("gene_id", _row(features))
    if roles is not None:
        code = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
        codes = roles.groupBy("gene_id").agg(*[F.max(F.when(F.col("seed") == s, code)).alias(f"_r{s}") for s in own])
        rows = rows.join(codes, "gene_id").select("gene_id", "x", *[F.coalesce(f"_r{s}", F.lit(0)).alias(f"_r{s}") for s in own])
    kind, named = dict(genes.dtypes)["gene_id"], roles is not None

    def scores(batches):
        for batch in batches:
            x = numbers(batch.column(1), batch.num_rows)
            for k, (seed, known) in enumerate(own.items()):
                z, gene, role = _scaled(x, *known), batch.column(0), None
                if named:
                    role = np.asarray(batch.column(2 + k))
                    z, gene, role = z[role > 0], gene.filter(pa.array(role > 0)), pa.array(ROLES).take(pa.array(role[role > 0] - 1))
                for m in models:
                    if m["seed"] != seed:
                        continue
                    margin = np.full(len(z), m["intercept"])
                    for j, b in enumerate(m["coefficients"]):
                        margin += z[:, j] * b
                    with np.errstate(over="ignore"):
                        score = 1 / (1 + np.exp(-margin))
                    columns = [pa.array(np.full(len(z), seed, dtype=np.int32)), gene, pa.array([m["model_name"]] * len(z), pa.string()), pa.array(score)]
                    yield pa.RecordBatch.from_arrays([*columns, *([role] if named else [])], names)

    names = ["seed", "gene_id", "model_name", "prediction_score", *(["role"] if named else [])]
    out = rows.mapInArrow(scores, f"seed int, gene_id {kind}, model_name string, prediction_score double" + (", role string" if named else ""))
    seed = F.col("seed").cast(dict(stats.dtypes)["seed"]).alias("seed")
    return out.select(seed, "model_name", "gene_id", "prediction_score") if roles is None else out.select(seed, *names[1:])


def coefficients(models: Sequence[dict], spark: SparkSession, features: Sequence[str]) -> DataFrame:
    """Coefficient and absolute value per seed, model and feature."""
    rows = [(m["seed"], m["model_name"], f, float(b), abs(float(b))) for m in models for f, b in zip(features, m["coefficients"], strict=True)]
    return spark.createDataFrame(rows, "seed int, model_name string, feature_name string, coefficient double, abs_coefficient double")


def importance(coef: DataFrame) -> DataFrame:
    """Mean and median absolute coefficient over the seeds."""
    return coef.groupBy("model_name", "feature_name").agg(
        F.avg("abs_coefficient").alias("mean_importance"), F.median("abs_coefficient").alias("median_importance")
    )
