"""Expressions over pairing probabilities, an ARRAY<DOUBLE> per window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqrank.functions.numeric import col, mean_of

HIGH_PAIRED = 0.7
LOW_PAIRED = 0.3


def observed(paired: str | Column) -> Column:
    """The finite values, in order; NULL when there are none."""
    kept = F.filter(col(paired), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(kept) > 0, kept)


def array_mean(values: str | Column) -> Column:
    xs = col(values)
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(xs).cast("double"))


def array_median(values: str | Column) -> Column:
    """Median of an array without NULLs."""
    xs = F.sort_array(col(values))
    n = F.size(xs)
    low = F.try_element_at(xs, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(xs, F.floor(n / 2).cast("int") + 1)
    return (low + high) / 2.0


def share(values: str | Column, test) -> Column:
    xs = col(values)
    return F.try_divide(F.size(F.filter(xs, test)).cast("double"), F.size(xs).cast("double"))


def pairing_statistics(paired: str | Column, high: float = HIGH_PAIRED, low: float = LOW_PAIRED) -> dict[str, Column]:
    xs = col(paired)
    return {
        "paired_probability_mean": array_mean(xs),
        "paired_probability_median": array_median(xs),
        "paired_probability_max": F.array_max(xs),
        "fraction_high_paired": share(xs, lambda x: x >= high),
        "fraction_low_paired": share(xs, lambda x: x <= low),
    }


def structure_signal(mode: str = "combined") -> Column:
    """Raw structure signal from the statistics columns."""
    named = {
        "mean": "paired_probability_mean",
        "fraction_high": "fraction_high_paired",
        "max": "paired_probability_max",
    }
    if mode in named:
        return F.col(named[mode])
    if mode != "combined":
        raise ValueError(f"unknown structure mode {mode!r}")
    # Weights of the combined signal.
    return (
        0.45 * F.col("paired_probability_mean")
        + 0.15 * F.col("paired_probability_median")
        + 0.20 * F.col("paired_probability_max")
        + 0.20 * F.col("fraction_high_paired")
    )


def _matrices(values: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the rows of each length, without empty ones."""
    ends = np.cumsum(lengths)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        yield rows, values.reshape(-1, n) if len(rows) == len(lengths) else values[(ends[rows] - n)[:, None] + np.arange(n)]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values (NULL as 0), which of them are there, and the length of each row's list."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return np.asarray(flat.fill_null(0.0)), np.asarray(flat.is_valid()), lengths


ARCHITECTURE = ("longest", "runs", "density", "boundaries", "mean", "mean31", "mean41", "mean81")


def _architecture(paired: pa.Array) -> pa.Array:
    values, there, lengths = _lists(paired)
    row = np.repeat(np.arange(len(lengths)), lengths)
    kept = there & ~np.isnan(values)
    values, lengths = values[kept], np.bincount(row[kept], minlength=len(lengths))
    out = np.zeros((len(ARCHITECTURE), len(lengths)))
    for rows, xs in _matrices(values, lengths):
        n = xs.shape[1]
        high = xs >= HIGH_PAIRED
        last_low = np.maximum.accumulate(np.where(high, -1, np.arange(n)), axis=1)
        upto = np.concatenate([np.zeros((len(xs), 1)), np.cumsum(xs, axis=1)], axis=1)
        mean = upto[:, -1] / n
        out[0, rows] = (np.arange(n) - last_low).max(axis=1)
        out[1, rows] = high[:, 0] + (high[:, 1:] & ~high[:, :-1]).sum(axis=1)
        out[2, rows] = high.sum(axis=1) / n
        out[3, rows] = (high[:, 1:] != high[:, :-1]).sum(axis=1)
        out[4, rows] = mean
        for k, w in enumerate((31, 41, 81)):
            out[5 + k, rows] = mean if n < w else ((upto[:, w:] - upto[:, :-w]) / w).max(axis=1)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], list(ARCHITECTURE), mask=pa.array(lengths == 0))


def architecture(paired: str | Column) -> Column:
    """Struct of numbers over the observed values, NULL when there are none.

    Of stretches at or above HIGH_PAIRED the longest, their number, the share of their positions and the changes between
    high and not high; the mean, and the largest means over 31, 41 and 81 neighbours (of a shorter array the whole mean).
    """
    return F.arrow_udf(_architecture, ", ".join(f"{n} double" for n in ARCHITECTURE))(col(paired))


def _rich_paired(letters: str, least: int, size: int):
    codes = [ord(x) for x in letters]

    def run(seq: pa.Array, paired: pa.Array) -> pa.Array:
        texts = seq.to_pylist()
        spots = np.array([0 if t is None else len(t) for t in texts], dtype=np.int64) - (size - 1)
        rich = np.isin(np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), codes)
        values, there, lengths = _lists(paired)
        observed = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[there & ~np.isnan(values)], minlength=len(lengths)) > 0
        hits = np.zeros(len(lengths))
        text_starts, list_starts = np.cumsum(spots + size - 1) - (spots + size - 1), np.cumsum(lengths) - lengths
        usable = np.minimum(spots, lengths - (size - 1))
        gaps = not there.all()
        for n in np.unique(usable[usable > 0]):
            found = np.flatnonzero(usable == n)
            width = np.arange(n + size - 1)
            # blocks that stay in a core's cache
            for rows in np.array_split(found, len(found) // 512 + 1):
                letter, at = rich[text_starts[rows][:, None] + width], list_starts[rows][:, None] + width
                xs, known = values[at], there[at] if gaps else None
                count, total = np.zeros((len(rows), n), dtype=np.int16), np.zeros((len(rows), n))
                filled = np.zeros((len(rows), n), dtype=np.int16) if gaps else size
                for j in range(size):
                    count += letter[:, j : j + n]
                    total += xs[:, j : j + n]
                    if gaps:
                        filled += known[:, j : j + n]
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = total / filled
                # as in Spark, NaN is larger than all numbers
                high = (filled > 0) & (np.isnan(mean) | (mean >= HIGH_PAIRED))
                hits[rows] = (high & (count >= least)).sum(axis=1)
        good = (spots >= 1) & observed
        return pa.array(hits / np.maximum(spots, 1), mask=~good)

    return run


def rich_paired_density(seq: str | Column, paired: str | Column, letters: str, least: int, size: int = 7) -> Column:
    """Share of 7-letter stretches with at least ``least`` of ``letters`` and mean pairing at least 0.7.

    Positions of the sequence and the vector are kept aligned; missing values are left out of
    the mean of their stretch.
    """
    return F.arrow_udf(_rich_paired(letters, least, size), "double")(col(seq), col(paired))


def stem_like(longest: Column, local41: Column, density: Column) -> Column:
    return mean_of(F.least(longest / 40.0, F.lit(1.0)), local41, density)


def paired_architecture(
    stem: Column, density: Column, local41: Column, local81: Column, longest: Column, peak: Column
) -> Column:
    return mean_of(
        stem, density, local41, local81, F.least(longest / 50.0, F.lit(1.0)), F.greatest(peak, F.lit(0.0))
    )
