"""Near-duplicate vectors: an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import discard, key_runs, saved, shuffle_width
from seqrank.llm.components import components, forest

MIN_COSINE = 0.98
#: Vectors of a cell for which one pivot stands, and that one comparison holds.
CELL = 4096
#: Pivots over all labels; what every task gets is bounded by this many vectors.
MAX_PIVOTS = 4096
#: Vectors looked at, for each pivot, when pivots are chosen. Pivots decide about speed only.
LOOK = 8


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles, scaled to length one."""
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch):
    """Rows of ``batch`` in parts of equal vector length."""
    sizes = np.asarray(batch.column("dim"))
    for dim in np.unique(sizes):
        yield int(dim), batch.take(pa.array(np.flatnonzero(sizes == dim)))


def choose_pivots(sample: np.ndarray, wanted: int, radius: float) -> np.ndarray:
    """Up to ``wanted`` unit vectors: means of a few rounds of clustering, further apart than two radii."""
    pivots = sample[:wanted]
    for _ in range(3):
        home = np.argmax(sample @ pivots.T, axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1)
        pivots = sums[norm > 0] / norm[norm > 0, None]
    apart: list[np.ndarray] = []
    for p in pivots:
        if all(np.linalg.norm(p - q) > 2 * radius for q in apart):
            apart.append(p)
    return np.array(apart)


def _pivots(rows: DataFrame, radius: float) -> tuple[dict, int]:
    """Pivots of every (label, dim) with more vectors than a cell holds, and the cell size used."""
    total = rows.count()
    cell = max(CELL, -(-2 * total // MAX_PIVOTS))
    counts = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).collect()
    if not counts:
        return {}, cell
    wanted = {(r.label, r.dim): -(-r.n // cell) for r in counts}
    share = min(1.0, LOOK * 2 / cell)  # about this many for each pivot; a look at fewer would do as well
    big = F.broadcast(rows.sparkSession.createDataFrame(list(wanted), "label long, dim int"))
    seen = rows.join(big, ["label", "dim"]).where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found: dict = {}
    for r in seen.select("label", "dim", "embedding").limit(4 * LOOK * sum(wanted.values())).collect():
        found.setdefault((r.label, r.dim), []).append(r.embedding)
    out = {}
    for key, vectors in found.items():
        sample = np.array(vectors, dtype=np.float64)
        sample /= np.abs(sample).max(axis=1, keepdims=True)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        out[key] = choose_pivots(sample, wanted[key], radius)
    return out, cell


def _place(batches, pivots: dict, radius: float):
    """A row for the cell of each vector's nearest pivot, and one for each later cell that it may reach into."""
    for batch in batches:
        for dim, part in _by_length(batch):
            x, label = _matrix(part.column("embedding")), np.asarray(part.column("label"))
            for one in np.unique(label):
                at = np.flatnonzero(label == one)
                points = pivots.get((int(one), dim))
                if points is None or len(points) < 2:
                    row, cell, home = at, np.zeros(len(at), dtype=np.int32), np.ones(len(at), dtype=bool)
                else:
                    gap = np.maximum(2 - 2 * (x[at] @ points.T), 0)  # squared distances of unit vectors
                    own = gap.argmin(axis=1)
                    between = np.sqrt(np.maximum(2 - 2 * (points @ points.T), 0))[own]
                    between[np.arange(len(at)), own] = 1
                    # how far the other cell's half-space is; a linked vector there is within the radius
                    far = (gap - gap[np.arange(len(at)), own][:, None]) / (2 * between)
                    go = (far <= radius) & (np.arange(len(points)) >= own[:, None])
                    r, cell = np.nonzero(go)
                    row, home = at[r], cell == own[r]
                rows = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("label"), rows.column("dim"), pa.array(cell.astype(np.int32)), pa.array(home), rows.column("node"), rows.column("copies"), rows.column("embedding")],
                    ["label", "dim", "cell", "home", "node", "copies", "embedding"],
                )


class _Cell:
    """A block of home vectors: counts of links on both sides, and links that join the same groups."""

    def __init__(self, parts: list[pa.RecordBatch], least: float):
        self.least = least
        self.raw = pa.concat_arrays([p.column("embedding") for p in parts])
        self.x = np.concatenate([_matrix(p.column("embedding")) for p in parts])
        self.node = np.concatenate([np.asarray(p.column("node")) for p in parts])
        self.copies = np.concatenate([np.asarray(p.column("copies")) for p in parts])
        self.links = np.zeros(len(self.node), dtype=np.int64)
        self.group = np.arange(len(self.node))
        for at, mask in self._near(self.x, self.raw, within=True):
            self.links[at : at + len(mask)] += mask @ self.copies
            for r in np.flatnonzero(mask.any(axis=1)):
                groups = np.unique(np.append(self.group[mask[r]], self.group[at + r]))
                if len(groups) > 1:
                    self.group[np.isin(self.group, groups)] = groups[0]
        order = np.argsort(self.group, kind="stable")
        self.order = order
        sorted_ = self.group[order]
        self.starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        self.heads = self.node[order][self.starts]
        self.inner = (self.node, self.node[self.group])

    def _near(self, x: np.ndarray, raw: pa.Array, within: bool = False):
        step = max(1, (1 << 22) // max(1, len(self.x)))
        for at in range(0, len(x), step):
            cosine = x[at : at + step] @ self.x.T
            mask = cosine >= self.least
            for i, j in np.argwhere(np.abs(cosine - self.least) < 1e-9):  # too close for the rounding of a product
                mask[i, j] = exact_cosine(raw[at + int(i)].as_py(), self.raw[int(j)].as_py()) >= self.least
            if within:
                mask[np.arange(len(mask)), at + np.arange(len(mask))] = False
            yield at, mask

    def meet(self, part: pa.RecordBatch):
        x, node, copies = _matrix(part.column("embedding")), np.asarray(part.column("node")), np.asarray(part.column("copies"))
        links = np.zeros(len(node), dtype=np.int64)
        ends = []
        for at, mask in self._near(x, part.column("embedding")):
            links[at : at + len(mask)] = mask @ self.copies
            self.links += copies[at : at + len(mask)] @ mask
            if mask.any():
                row, group = np.nonzero(np.logical_or.reduceat(mask[:, self.order], self.starts, axis=1))
                ends.append((node[at + row], self.heads[group]))
        return node, links, ends


def exact_cosine(a: list[float], b: list[float]) -> float:
    dot = math.fsum(x * y for x, y in zip(a, b, strict=True))
    return dot / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def _compare(batches, least: float):
    """(a, null, links): how many vectors a has links to in this block; (a, b, null): links that join its groups."""

    def counts(node, links):
        has = links > 0
        if has.any():
            n = int(has.sum())
            yield pa.RecordBatch.from_arrays([pa.array(node[has], pa.int64()), pa.nulls(n, pa.int64()), pa.array(links[has], pa.int64())], ["a", "b", "links"])

    def joins(a, b):
        a, b = forest(a[a != b], b[a != b])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "links"])

    def close(cell, home):
        cell = cell or (_Cell(home, least) if home else None)
        if cell:
            yield from counts(cell.node, cell.links)
            yield from joins(*cell.inner)

    key, home, cell = None, [], None
    for now, run in key_runs(batches, ["label", "dim", "cell", "block"]):
        if now != key:
            yield from close(cell, home)
            key, home, cell = now, [], None
        role = np.asarray(run.column("role"))
        cut = int(np.searchsorted(role, 1))
        if cut:
            home.append(run.slice(0, cut))
        if cut < len(role) and (cell or home):
            cell = cell or _Cell(home, least)
            node, links, ends = cell.meet(run.slice(cut))
            yield from counts(node, links)
            for a, b in ends:
                yield from joins(a, b)
    yield from close(cell, home)


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id long, embedding array, label integer).

    Rows link if their labels are equal and the cosine of their vectors, in doubles, is at least
    ``min_cosine``; vectors of other lengths never do. Rows whose label or vector is null, or whose
    vector is empty, zero, or holds a null, NaN or infinite component, link with nothing.

    On unit vectors the cosine is a distance: the range is r = sqrt(2 - 2 min_cosine). Equal vectors
    are one vector with a weight. A label with more vectors than a cell has pivots; each vector is at
    home with its nearest one. If y, at home with p, links to x, at home with q, then
    d(y,q) - d(y,p) <= 2r by the triangle inequality, and, sharper for Euclidean distances, y is no
    further than r from the plane half-way between p and q. So y is copied into the later cells whose
    plane is that close, and every cell is joined on its own, blocks of home vectors against streams
    of others. Counts add up; groups of links come back as forests, never as all pairs.
    ``component_id`` is the least vec_id within reach and ``kept`` says whether it is the row's own.
    Null vec_ids keep their row but name no component; repeated rows count as other rows.
    """
    spark = vectors.sparkSession
    source = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    distinct = source.where(usable).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    rows, _ = saved(distinct.select(F.monotonically_increasing_id().alias("node"), "label", F.size("embedding").alias("dim"), "embedding", "copies", "least"))
    radius = math.sqrt(2 - 2 * min_cosine) + 1e-6
    pivots, cell = _pivots(rows, radius)
    places = "label long, dim int, cell int, home boolean, node long, copies long, embedding " + dict(rows.dtypes)["embedding"]
    placed, placed_path = saved(rows.drop("least").mapInArrow(lambda batches: _place(batches, pivots, radius), places))
    # only cells of pivots can be full, so at most one row for each pivot
    full = placed.where("home").groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    full = full.select("label", "dim", "cell", F.ceil(F.col("n") / cell).cast("int").alias("blocks"))
    keys = ["label", "dim", "cell"]
    dealt = placed.join(F.broadcast(full), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.when(F.col("home"), F.col("own")).otherwise(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keys, "block", F.when(F.col("home") & (F.col("own") == F.col("block")), 0).otherwise(1).alias("role"), "node", "copies", "embedding")
    ordered = dealt.repartition(shuffle_width(spark), *keys, "block").sortWithinPartitions(*keys, "block", "role")
    found, _ = saved(ordered.mapInArrow(lambda batches: _compare(batches, min_cosine), "a long, b long, links long"))
    discard(spark, placed_path)
    group = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    named = rows.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(first, "component").join(counts.withColumnRenamed("a", "node"), "node", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("compared"))
    out = source.join(known, ["label", "embedding"], "left")
    component = F.when(F.col("compared"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
