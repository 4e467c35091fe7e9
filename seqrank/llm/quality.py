"""Quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import discard, saved
from seqrank.operators.quantiles import array_quantiles, numbers

BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, PRIOR = 120, 60, 0.15, 1.0
#: Rounds of boosting between two passes over the rows.
PER_PASS = 20
#: Sums are whole multiples of 2^-30, added up exactly, so that they don't depend on how rows are dealt; rows of one sum.
_UNIT, _ROWS = 2.0**30, 1 << 14

FEATURES = (
    "log_chars", "upper_share", "digit_share", "space_share", "symbol_share", "shout_share", "stop_share", "bar_share", "other_share",
    "word_length", "distinct_words", "top_word_share", "log_lines", "line_length", "repeated_lines", "marked_words", "entropy", "ended_lines", "short_words", "long_words",
)

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "shout": b"!?", "stop": b".,;:", "bar": b"|"}
_KIND = np.zeros((256, len(_KINDS) + 2))
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes), _i] = 1
_KIND[0x80:, -2] = 1
_KIND[[*range(0x80), *range(0xC0, 0x100)], -1] = 1  # the first byte of a character


def features(text: bytes | None) -> list[float]:
    """The numbers of FEATURES for one whole text; null counts as empty, and shares of nothing are 0."""
    text = text or b""
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, digit, space, symbol, shout, stop, bar, other, chars = seen @ _KIND
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    n, m = max(1, len(words)), max(1, len(lines))
    share = seen[seen > 0] / max(1, len(text))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return [
        float(np.log1p(chars)), upper / max(1, upper + lower), digit / max(1, chars), space / max(1, chars), symbol / max(1, chars), shout / max(1, chars), stop / max(1, chars), bar / max(1, chars), other / max(1, len(text)),
        float(sizes.sum()) / n, len(tally) / n**0.75, max(tally.values(), default=0) / n, float(np.log1p(len(lines))), float(np.log1p(chars / m)), 1 - len(set(lines)) / m if lines else 0.0,
        sum(not w[-1:].isalpha() and w[-1] < 0x80 for w in words) / n, float(-(share * np.log2(share)).sum()), sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, float((sizes <= 2).sum()) / n, float((sizes > 12).sum()) / n,
    ]


@dataclass
class Model:
    """Cut points and lookup tables: a score is the logistic of ``base`` plus one entry of each table."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]
    base: float

    def total(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, cuts in enumerate(self.cuts):
            total += self.tables[j][np.searchsorted(cuts, x[:, j], side="right")]
        coarse = [np.searchsorted(cuts, x[:, j], side="right") for j, cuts in enumerate(self.pair_cuts)]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.total(x), -30, 30)))


def _gain(g, h):
    return g * g / (h + PRIOR)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of at most three leaves over one feature's bins."""
    leaves = [(0, len(g))]
    for _ in range(2):
        tries = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in leaves]
        gain, k, a, b = max(tries)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + PRIOR)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one feature, then the other in either half."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for k in range(1, len(gg)):
            gain, leaf = -_gain(g.sum(), h.sum()), np.zeros_like(gg)
            for half in (slice(0, k), slice(k, None)):
                a, b = gg[half].sum(axis=0), hh[half].sum(axis=0)
                _, c = _best_cut(a, b)
                for side in (slice(0, c), slice(c, None)):
                    gain += _gain(a[side].sum(), b[side].sum())
                    leaf[half, side] = a[side].sum() / (b[side].sum() + PRIOR)
            if gain > best:
                best, out = gain, leaf.T if turn else leaf
    return best, out


def _cells(x: np.ndarray, model: Model, pairs: list[tuple[int, int]] | None) -> tuple[list[np.ndarray], list[int]]:
    """For each table (of a feature, or of each of ``pairs``), the entry of every row, and the table's entries."""
    if pairs is None:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)], [len(c) + 1 for c in model.cuts]
    at, size = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)], [len(c) + 1 for c in model.pair_cuts]
    return [at[i] * size[j] + at[j] for i, j in pairs], [size[i] * size[j] for i, j in pairs]


def _sums(x: np.ndarray, y: np.ndarray, model: Model, pairs: list[tuple[int, int]] | None, crossed: bool) -> np.ndarray:
    """Loss of the rows; by entry, its slope and curvature; if ``crossed``, also the curvature by entries of two tables, in order of the tables."""
    out = 0
    for at in range(0, len(y), _ROWS):
        some, label = x[at : at + _ROWS], y[at : at + _ROWS]
        total = model.total(some)
        p = 1 / (1 + np.exp(-total))
        g, h, loss = (np.rint(v * _UNIT) for v in (label - p, p * (1 - p), np.logaddexp(0, total) - label * total))
        cells, sizes = _cells(some, model, pairs)
        parts = [[loss.sum()], *(np.bincount(c, g, n) for c, n in zip(cells, sizes, strict=True)), *(np.bincount(c, h, n) for c, n in zip(cells, sizes, strict=True))]
        if crossed:
            parts += [np.bincount(cells[i] * sizes[j] + cells[j], h, sizes[i] * sizes[j]) for i in range(len(cells)) for j in range(i + 1, len(cells))]
        out = out + np.concatenate(parts).astype(np.int64)
    return out


def _boosted(sums: Callable, model: Model, pairs: list[tuple[int, int]] | None, rounds: int, step: Callable, put: Callable) -> Model:
    """Cyclic boosting: tables take turns to add RATE times ``step`` (table, slopes, curvatures).

    A pass over the rows gives slopes and curvatures by entry and by entries of two tables. Until the next one, PER_PASS
    rounds later, slopes follow the steps by these. Steps that raise the loss are halved. ``put`` sets the model's tables.
    """
    _, sizes = _cells(np.zeros((0, len(FEATURES))), model, pairs)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = int(ends[-1])
    best, kept, moved, done = np.inf, np.zeros(n), np.zeros(n), 0
    while True:
        found = sums(put(model, [kept[o] + moved[o] for o in own]), pairs, done < rounds)
        if found[0] / _UNIT > best:
            moved = moved / 2
            if np.abs(moved).max() < 1e-6:
                return put(model, [kept[o] for o in own])
            continue
        kept, best = kept + moved, found[0] / _UNIT
        if done >= rounds:
            return put(model, [kept[o] for o in own])
        slope, curve = found[1 : 1 + n] / _UNIT, np.diag(found[1 + n : 1 + 2 * n] / _UNIT)
        at = 1 + 2 * n
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                block = found[at : at + sizes[i] * sizes[j]].reshape(sizes[i], sizes[j]) / _UNIT
                curve[own[i], own[j]], curve[own[j], own[i]] = block, block.T
                at += sizes[i] * sizes[j]
        height, moved = np.diag(curve).copy(), np.zeros(n)
        for _ in range(min(PER_PASS, rounds - done)):
            for j, o in enumerate(own):
                add = RATE * step(j, slope[o], height[o])
                moved[o] += add
                slope -= curve[:, o] @ add
        done += PER_PASS


def _fit(sums: Callable, cuts: list[np.ndarray], pair_cuts: list[np.ndarray], share: float) -> Model:
    """Boosting of every feature's table, then of those of the best pairs; ``sums`` (model, pairs, crossed) adds up :func:`_sums` over all rows."""
    d = len(FEATURES)
    size = [len(c) + 1 for c in pair_cuts]
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], [], pair_cuts, [], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    model = _boosted(sums, model, None, ROUNDS, lambda j, g, h: _shallow(g, h), lambda m, tables: replace(m, tables=tables))
    tried = [(i, j) for i in range(d) for j in range(i)]
    found = sums(model, tried, False)[1:] / _UNIT
    ends = np.cumsum([size[i] * size[j] for i, j in tried])

    def grid(values, k):
        i, j = tried[k]
        return values[ends[k] - size[i] * size[j] : ends[k]].reshape(size[i], size[j])

    ranked = sorted(((_shallow_pair(grid(found, k), grid(found[ends[-1] :], k))[0], i, j) for k, (i, j) in enumerate(tried)), reverse=True)
    pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    if not pairs:
        return model

    def step(k, g, h):
        shape = (size[pairs[k][0]], size[pairs[k][1]])
        return _shallow_pair(g.reshape(shape), h.reshape(shape))[1].ravel()

    def put(m, tables):
        return replace(m, pairs=pairs, pair_tables=[t.reshape(size[i], size[j]) for t, (i, j) in zip(tables, pairs, strict=True)])

    return _boosted(sums, model, pairs, PAIR_ROUNDS, step, put)


def _constant(share: float) -> Model:
    d = len(FEATURES)
    return Model([np.zeros(0)] * d, [np.zeros(1)] * d, [], [np.zeros(0)] * d, [], float(np.log((share + 1e-3) / (1 - share + 1e-3))))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows that are at hand; :func:`learn` fits the same to a table.

    Without rows of either class the score is constant: the share of 1 (one half without rows).
    """
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return _constant(share)
    cuts, pair_cuts = ([np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(len(FEATURES))] for n in (BINS, PAIR_BINS))
    return _fit(lambda *how: _sums(x, y, *how), cuts, pair_cuts, share)


def _measured(batches, column: str):
    for batch in batches:
        at = batch.schema.get_field_index(column)
        yield batch, np.array([features(t.as_py()) for t in batch.column(at)], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))


def fold(doc_id):
    """crc32 of the id as text, mod 3; fold 1 is held out. Null for a null id, which is in no fold."""
    return F.crc32(doc_id.cast("string")) % 3


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on all labelled rows outside fold 1.

    Labels other than 0 and 1, null labels and labels of absent documents are passed over. Only the
    texts are inputs of a score. Rows become numbers before they meet their labels; these are a table in the shared folder, and
    passes over it give the driver cut points and sums by table entry, of which there are as many for any number of rows.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    texts = docs.where(fold(F.col("doc_id")) != 1).select("doc_id", F.col("text").cast("binary").alias("text"))

    def measured(batches):
        for batch, x in _measured(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = texts.select("doc_id", F.array(F.lit(0.0)).alias("x")).schema
    # one row for each chosen label, also where documents are repeated
    rows = texts.mapInArrow(measured, kind).groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, "doc_id")
    rows, path = saved(rows.select("label", "x"))
    count = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    share = count.get(1, 0) / sum(count.values()) if count else 0.5
    if len(count) < 2:
        discard(spark, path)
        return _constant(share)
    few = rows.coalesce(spark.sparkContext.defaultParallelism)  # what a task sums up goes to the driver's aggregate
    inner = [np.linspace(0, 1, n + 1)[1:-1].tolist() for n in (BINS, PAIR_BINS)]
    found = array_quantiles(few.select(F.lit(0).alias("g"), "x"), [0], len(FEATURES), inner[0] + inner[1])
    cuts = [np.unique(found[0, j][: BINS - 1]) for j in range(len(FEATURES))]
    pair_cuts = [np.unique(found[0, j][BINS - 1 :]) for j in range(len(FEATURES))]

    def sums(*how):
        def parts(batches):
            total = 0
            for batch in batches:
                if batch.num_rows:
                    total = total + _sums(numbers(batch.column(1), batch.num_rows), np.asarray(batch.column(0), dtype=np.float64), *how)
            if np.ndim(total):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "value"])

        got = few.mapInArrow(parts, "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        _, sizes = _cells(np.zeros((0, len(FEATURES))), how[0], how[1])
        n = 1 + 2 * sum(sizes) + (sum(sizes) ** 2 - sum(s * s for s in sizes)) // 2 * how[2]
        out = np.zeros(n, dtype=np.int64)
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out

    model = _fit(sums, cuts, pair_cuts, share)
    discard(spark, path)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Whole texts are scored; null counts as empty; a null doc_id is never held out; repeated rows come
    back repeated, other columns are ignored, and an empty table gives no rows.
    """
    source = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def scores(batches):
        for batch, x in _measured(batches, "text"):
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    schema = source.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return source.mapInArrow(scores, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score of at least one half, all columns as they are."""

    def kept(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            x = np.array([features(t.as_py()) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(kept, docs.schema)
