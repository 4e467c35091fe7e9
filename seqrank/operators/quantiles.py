"""Exact quantiles of many columns at once, without a sort or an exchange of values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIRST, _NEXT = 16, 8  # bits of a number that the first pass and those after it look at
_FEW = 512  # rows that may be looked at value by value
_SOME = 1 << 18  # counts that a task holds before it adds them up


def numbers(column: pa.ListArray, rows: int) -> np.ndarray:
    """Lists of equally many doubles as a matrix; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def _key(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; -0.0 is 0.0."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _double(key: int) -> float:
    bits = np.array([key], dtype=np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (slot, digit, n, lo, hi) with one row for each slot and digit."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    at = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))
    return np.stack([rows[0, at], rows[1, at], np.add.reduceat(rows[2], at), np.minimum.reduceat(rows[3], at), np.maximum.reduceat(rows[4], at)])


def _counts(places: dict[int | None, dict[int, tuple[np.ndarray, np.ndarray]]], depth: int, width: int):
    """Tasks that count the next ``width`` bits of numbers whose first ``depth`` bits are a slot's; places are {group: {column: (prefixes, slots)}}."""
    names = ["slot", "digit", "n", "lo", "hi"]

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            group, x = np.asarray(batch.column(0)), numbers(batch.column(1), batch.num_rows)
            known, keys = np.isfinite(x), _key(x)
            for g, columns in places.items():
                mine = group == g
                for j, (prefixes, slots) in columns.items():
                    k = np.sort(keys[mine & known[:, j], j])
                    slot = np.full(len(k), slots[0])
                    if depth:
                        top = k >> np.int64(64 - depth)
                        at = np.minimum(np.searchsorted(prefixes, top), len(prefixes) - 1)
                        hit = prefixes[at] == top
                        k, slot = k[hit], slots[at[hit]]
                    if not len(k):
                        continue
                    digit = k >> np.int64(64 - depth - width)
                    if depth:
                        digit &= np.int64((1 << width) - 1)
                    first = np.flatnonzero(np.concatenate([[True], (digit[1:] != digit[:-1]) | (slot[1:] != slot[:-1])]))
                    stop = np.append(first[1:], len(k))
                    parts.append(np.stack([slot[first], digit[first], stop - first, k[first], k[stop - 1]]))
                    size += len(first)
            if size > _SOME:
                parts = [_added(parts)]
                size = parts[0].shape[1]
                if size > _SOME // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], names)
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(parts)], names)

    return run


def array_quantiles(rows: DataFrame, groups: Sequence[int], columns: int, shares: Sequence[float]) -> dict[tuple[int, int], list[float]]:
    """{(group, column): linearly interpolated quantiles} of ``rows`` (group int, array of ``columns`` doubles).

    Nulls, NaN and infinite numbers are passed over; without any other, a column has no entry. Numbers are told apart by their
    leading bits, a few more in each pass: tasks count those that can still be the wanted ones, so only counts leave them. Few
    passes do, as a count comes with its least and greatest number. The result doesn't depend on how rows are dealt.
    """
    slots = {(g, j, 0): i for i, (g, j) in enumerate((g, j) for g in groups for j in range(columns))}
    wanted: dict[tuple[int, int], list[tuple[float, int, int]]] = {}  # (position, places of its neighbours in ``found``)
    found: list[float] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # slot: (rank inside the slot, place in ``found``)
    depth, width = 0, _FIRST
    while slots:
        places: dict[int | None, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for (g, j, prefix), slot in sorted(slots.items()):
            own = places.setdefault(g, {}).setdefault(j, ([], []))
            own[0].append(prefix)
            own[1].append(slot)
        places = {g: {j: (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for j, (a, b) in own.items()} for g, own in places.items()}
        counted = rows.mapInArrow(_counts(places, depth, width), "slot long, digit long, n long, lo long, hi long")
        counted = counted.groupBy("slot", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
        table = np.stack([c.to_numpy() for c in counted.columns]) if counted.num_rows else np.zeros((5, 0), dtype=np.int64)
        table = table[:, np.lexsort((table[1], table[0]))]
        name = {slot: key for key, slot in slots.items()}
        slots, following, most = {}, {}, 0
        for slot, key in name.items():
            a, b = np.searchsorted(table[0], [slot, slot + 1])
            _, digit, n, lo, hi = table[:, a:b]
            upto = np.cumsum(n)
            if not depth and len(n):
                targets = []
                for share in shares:
                    h = (int(upto[-1]) - 1) * float(share)
                    at = len(found)
                    found += [0.0, 0.0]
                    wanted.setdefault(key[:2], []).append((h - np.floor(h), at, at + 1))
                    targets += [(int(np.floor(h)), at), (int(np.ceil(h)), at + 1)]
                open_[slot] = targets
            for rank, at in open_.get(slot, ()):
                k = int(np.searchsorted(upto, rank, side="right"))
                inside = rank - int(upto[k] - n[k])
                if inside == 0 or lo[k] == hi[k]:
                    found[at] = _double(lo[k])
                elif inside == n[k] - 1:
                    found[at] = _double(hi[k])
                else:
                    prefix = (key[2] << width | int(digit[k])) if depth else int(digit[k])
                    new = slots.setdefault((*key[:2], prefix), len(slots))
                    following.setdefault(new, []).append((inside, at))
                    most = max(most, int(n[k]))
        open_, depth = following, depth + width
        width = 64 - depth if most <= _FEW else min(_NEXT, 64 - depth)
    return {key: [found[a] + (found[b] - found[a]) * float(part) for part, a, b in own] for key, own in wanted.items()}
