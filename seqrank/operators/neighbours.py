"""Vectors: standardising, exact nearest neighbours, and blending of neighbour profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.functions.numeric import finite
from seqrank.operators.ranking import top_n
from seqrank.session import durable

QUERY_ROWS = 20000  # most query vectors in one task
REFERENCE_ROWS = 5000  # most reference vectors in one task
MOST_CENTRES = 4096  # centres that every task holds
ROUNDS = (1, 8, MOST_CENTRES + 1)  # centres that a query may have looked at after each round
MOST_PAIRS = 2**18  # pairs of vectors whose cosines or angles a task holds at once


def standardise(vectors: DataFrame, reference: DataFrame, column: str = "embedding", limit: float = 10.0) -> DataFrame:
    """(x - mean) / population deviation per position of the reference, clipped; gaps become 0."""
    cells = reference.select(F.posexplode(column).alias("_i", "_x")).withColumn("_x", finite("_x"))
    stats = cells.groupBy("_i").agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"))
    # one row per vector position
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("_i", "mean", "std"))))
    table = vectors.withColumn("_stats", packed.scalar())

    def scaled(x: Column, s: Column) -> Column:
        spread = F.when(s["std"] >= 1e-6, s["std"]).otherwise(1.0)
        value = (finite(x) - s["mean"]) / spread
        return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.least(value, F.lit(limit)), F.lit(-limit)))

    return table.withColumn(column, F.zip_with(column, "_stats", scaled)).drop("_stats")


def _unit(rows: Sequence) -> np.ndarray:
    m = np.stack(rows).astype(float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _pieces(n: int, partners: int) -> Iterator[slice]:
    """Slices of ``n`` rows, so that a slice has at most MOST_PAIRS pairs with its ``partners``."""
    step = max(1, MOST_PAIRS // max(partners, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def _best(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, cosine) of the ``k`` rows of ``b`` with the highest cosine; ties go to the earlier row of ``b``."""
    a, b = _unit(a), _unit(b)
    found = []
    for piece in _pieces(len(a), len(b)):
        sims = np.round(a[piece] @ b.T, 9)
        far = np.where(np.isnan(sims), np.inf, -sims)
        least = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if k < len(b) else np.inf
        row, place = np.nonzero(far <= least)
        order = np.lexsort((far[row, place], row))  # stable: places stay in order
        row, place = row[order], place[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        found.append((row[kept] + piece.start, place[kept], sims[row[kept], place[kept]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _centred(references: DataFrame, reference_id: str, vector: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """References with the number of their nearest centre and their angle to it, and the centres: ``n`` references in order of a hash.

    Vectors without length have a centre of their own, the last number.
    """
    chosen = references.select(vector, reference_id).where(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x * x) > 0)
    centres = _unit([r[0] for r in chosen.orderBy(F.xxhash64(reference_id), reference_id).limit(n).collect()] or [[1.0]])

    def place(batches):
        for frame in batches:
            if frame.empty:
                continue
            x = _unit(frame[vector].to_numpy())
            none = np.linalg.norm(x, axis=1) == 0
            near, angle = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.pi)
            for piece in _pieces(len(x), len(centres)) if not none.all() else ():
                all_ = _angles(x[piece], centres)
                near[piece], angle[piece] = all_.argmin(axis=1), all_.min(axis=1)
            yield frame.assign(_centre=np.where(none, len(centres), near).astype(np.int32), _angle=np.where(none, np.pi, angle))

    rows = references.select(reference_id, vector)
    return durable(rows.mapInPandas(place, rows.withColumns({"_centre": F.lit(0), "_angle": F.lit(0.0)}).schema)), centres


def _visits(queries: DataFrame, query_id: str, vector: str, centres: np.ndarray, known: np.ndarray, radius: np.ndarray, seen: int, upto: int) -> DataFrame:
    """(query_id, vector, _centre): the centres that a query has to look at next, in the order of their upper bounds.

    No reference of a centre has a higher cosine than that of the query's angle to the centre less the centre's radius. Those
    that can't reach the query's ``_least``, its k-th best cosine so far, are left out, as are the ``seen`` ones of before.
    """
    names = queries.columns
    points = np.concatenate([centres, np.zeros((1, centres.shape[1]))])[known]

    def look(batches):
        for frame in batches:
            if frame.empty:
                continue
            for piece in _pieces(len(frame), len(points)):
                part = frame.iloc[piece]
                bound = np.cos(np.maximum(_angles(_unit(part[vector].to_numpy()), points) - radius, 0.0))
                order = np.argsort(-bound, axis=1, kind="stable")[:, seen:upto]
                # cosines are compared at nine digits
                at, place = np.nonzero(np.take_along_axis(bound, order, axis=1) >= part["_least"].to_numpy()[:, None] - 1e-8)
                yield part.iloc[at].drop(columns="_least").assign(_centre=known[order[at, place]].astype(np.int32))

    return queries.mapInPandas(look, queries.select(*[c for c in names if c != "_least"], F.lit(0).alias("_centre")).schema)


def _compare(visits: DataFrame, placed: DataFrame, sizes: DataFrame, k: int, query_id: str, reference_id: str, vector: str) -> DataFrame:
    """The best ``k`` references of each visit: a centre's references in blocks of bounded size meet its visitors, in slices of bounded size."""
    kinds = dict(visits.dtypes)[query_id], dict(placed.dtypes)[reference_id]
    guests = visits.groupBy("_centre").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("_slices"))
    known = durable(sizes.join(guests, "_centre").select("_centre", "_blocks", "_slices"))  # a row for each centre

    def part(id_: str, n: str) -> Column:
        return F.pmod(F.xxhash64(id_), n).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = visits.join(F.broadcast(known), "_centre").select(query_id, F.col(vector).alias(vector), F.col("_centre").alias("_centre"), part(query_id, "_slices").alias("_slice"), every("_blocks").alias("_block"))
    right = placed.join(F.broadcast(known), "_centre").select(reference_id, F.col(vector).alias("_point"), F.col("_centre").alias("_at"), part(reference_id, "_blocks").alias("_block"), every("_slices").alias("_slice"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({query_id: [], reference_id: [], "cosine": []})
        b = b.sort_values(reference_id).reset_index(drop=True)
        row, place, cosine = _best(a[vector].to_numpy(), b["_point"].to_numpy(), k)
        return pd.DataFrame({query_id: a[query_id].to_numpy()[row], reference_id: b[reference_id].to_numpy()[place], "cosine": cosine})

    # both tables may come from one: the references' columns have names of their own
    return left.groupBy("_centre", "_block", "_slice").cogroup(right.groupBy("_at", "_block", "_slice")).applyInPandas(best, f"{query_id} {kinds[0]}, {reference_id} {kinds[1]}, cosine double")


def nearest(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    query_id: str = "query_id",
    reference_id: str = "reference_id",
    vector: str = "embedding",
    visited: list | None = None,
) -> DataFrame:
    """The ``k`` references of highest cosine per query, exactly: (query_id, reference_id, cosine, rank).

    Branch and bound: references gather around centres, each with the largest angle of its references. A query looks at the
    centre with the highest upper bound first, then at the next few, then at all others that can still reach its k-th best
    cosine, and is sent to no further one. A task compares at most MOST_PAIRS pairs at once. If there are no more references than a task may hold, there is
    one centre and one round. Ties go to the lesser id. ``visited`` receives the number of (query, centre) visits of each round.
    """
    total = references.count()
    n = min(MOST_CENTRES, total // REFERENCE_ROWS + 1)
    order = [F.col("cosine").desc(), F.col(reference_id)]
    if n == 1:
        rows, sizes = references.select(reference_id, vector, F.lit(0).alias("_centre")), references.sparkSession.createDataFrame([(0, 1)], "_centre int, _blocks int")
        return top_n(_compare(queries.select(query_id, vector, F.lit(0).alias("_centre")), rows, sizes, k, query_id, reference_id, vector), [query_id], order, k, "rank")
    placed, centres = _centred(references, reference_id, vector, n)
    figures = placed.groupBy("_centre").agg(F.max("_angle").alias("_radius"), F.ceil(F.count(F.lit(1)) / REFERENCE_ROWS).cast("int").alias("_blocks"))
    figures = durable(figures)
    table = sorted((r[0], r[1]) for r in figures.collect())  # at most MOST_CENTRES + 1 rows
    known, radius = np.array([c for c, _ in table]), np.array([r for _, r in table])
    asked, found, seen = durable(queries.select(query_id, vector).withColumn("_least", F.lit(-2.0))), None, 0
    for upto in ROUNDS:
        visits = durable(_visits(asked, query_id, vector, centres, known, radius, seen, upto))
        size = visits.count()
        if visited is not None:
            visited.append(size)
        if size:
            fresh = _compare(visits, placed, figures.select("_centre", "_blocks"), k, query_id, reference_id, vector)
            rows = fresh if found is None else fresh.unionByName(found)
            found = durable(top_n(rows, [query_id], order, k, "rank").drop("rank"))
        seen = upto
        if found is None or seen >= len(known):
            break
        least = found.groupBy(query_id).agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).otherwise(-2.0).alias("_least"))
        asked = durable(queries.select(query_id, vector).join(least, query_id, "left").withColumn("_least", F.coalesce("_least", F.lit(-2.0))))
    if found is None:
        kinds = dict(queries.dtypes)[query_id], dict(references.dtypes)[reference_id]
        found = queries.sparkSession.createDataFrame([], f"{query_id} {kinds[0]}, {reference_id} {kinds[1]}, cosine double")
    return top_n(found, [query_id], order, k, "rank")


def blend_profiles(predicted: DataFrame, prior: DataFrame, group_prior: DataFrame | None = None) -> DataFrame:
    """(1 - alpha) * predicted + alpha * prior per k-mer.

    ``predicted`` is (protein_id, kmer, zscore); priors are (protein_id, kmer, prior, alpha). The
    group prior replaces the own one where its alpha is larger.
    """
    keys = ["protein_id", "kmer"]
    joined = predicted.join(prior, keys, "left")
    if group_prior is not None:
        other = group_prior.withColumnsRenamed({"prior": "_gp", "alpha": "_ga"})
        joined = joined.join(other, keys, "left")
        stronger = F.coalesce("_ga", F.lit(0.0)) > F.coalesce("alpha", F.lit(0.0))
        joined = joined.withColumns(
            {
                "prior": F.when(stronger, F.col("_gp")).otherwise(F.col("prior")),
                "alpha": F.when(stronger, F.col("_ga")).otherwise(F.col("alpha")),
            }
        )
    a = F.coalesce(F.when(F.col("prior").isNotNull(), F.col("alpha")), F.lit(0.0))
    fused = (1.0 - a) * F.col("zscore") + a * F.coalesce("prior", F.lit(0.0))
    return joined.select(*keys, fused.alias("zscore"), a.alias("alpha"))


def neighbour_profile(neighbours: DataFrame, profiles: DataFrame) -> DataFrame:
    """Similarity-weighted mean profile of a query's neighbours: (query_id, kmer, prior)."""
    w = F.greatest("cosine", F.lit(0.0))
    rows = neighbours.join(profiles.withColumnRenamed("profile_id", "reference_id"), "reference_id")
    return rows.groupBy("query_id", "kmer").agg(F.try_divide(F.sum(w * F.col("zscore")), F.sum(w)).alias("prior"))


def penalise_conflicts(rows: DataFrame, mode: str = "penalize") -> DataFrame:
    """Confidence times 0.35 for conflicting proteins when penalising."""
    if mode != "penalize":
        return rows
    return rows.withColumn(
        "confidence", F.when(F.col("has_conflict"), F.col("confidence") * 0.35).otherwise(F.col("confidence"))
    )


def shared_signatures(priors: DataFrame, length: int = 4) -> DataFrame:
    """Number of conflict-free proteins that share the same first prior ids.

    ``priors`` has (protein_id, prior_rank, prior_id, has_conflict).
    """
    first = priors.where(F.col("prior_rank") <= length)
    ordered = F.array_sort(F.collect_list(F.struct("prior_rank", "prior_id")))
    signature = F.array_join(F.transform(ordered, lambda x: x["prior_id"].cast("string")), "|")
    per = first.groupBy("protein_id").agg(signature.alias("signature"), F.bool_or("has_conflict").alias("has_conflict"))
    counts = per.where(~F.col("has_conflict")).groupBy("signature").agg(
        F.countDistinct("protein_id").alias("shared_proteins")
    )
    return per.join(counts, "signature", "left").withColumn("shared_proteins", F.coalesce("shared_proteins", F.lit(0)))


def best_by_confidence(rows: DataFrame, keys: Sequence[str] = ("protein_id",)) -> DataFrame:
    """Most confident window per protein; earlier windows win ties."""
    return top_n(rows, list(keys), [F.col("confidence").desc_nulls_last(), F.col("window_start")], 1, "_r").drop("_r")


def branch_candidates(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Best window per protein within one branch of motif groups."""
    return best_by_confidence(rows.where(F.col("motif_group").isin(list(groups))))


def teacher_summary(rows: DataFrame) -> DataFrame:
    """One row per protein: best window, its first two motif groups and how many windows were seen."""
    best = best_by_confidence(rows)
    counts = rows.groupBy("protein_id").agg(F.count(F.lit(1)).alias("n_candidate_windows"))
    return best.join(counts, "protein_id").select(
        "protein_id",
        "window_start",
        "confidence",
        F.split_part("motif_group", F.lit("|"), F.lit(1)).alias("first_group"),
        F.split_part("motif_group", F.lit("|"), F.lit(2)).alias("second_group"),
        "n_candidate_windows",
    )
