"""Inverted-repeat features of sequences, computed in Arrow batches.

Every k-mer of a batch becomes a number, so that "does the reverse complement also occur" is one
table lookup per position instead of a comparison of all pairs of k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.functions.numeric import mean_of
from seqrank.functions.sequence import rna, simple_repeat

REPEAT_FEATURES = [
    "reverse_complement_4mer_density",
    "reverse_complement_5mer_density",
    "reverse_complement_6mer_density",
    "longest_internal_rc_match",
    "internal_rc_pair_count",
    "palindrome_score",
    "self_complementarity_score",
    "inverted_repeat_score",
    "local_self_complementarity_score",
    "simple_repeat_score",
    "simple_repeat_penalty_score",
]
NOT_AVAILABLE = {
    "overlap_TE": "double",
    "TE_class": "string",
    "TE_family": "string",
    "repeat_overlap_fraction": "double",
    "distance_to_nearest_TE": "double",
}
_BATCHED = {
    "reverse_complement_4mer_density": "double",
    "reverse_complement_5mer_density": "double",
    "reverse_complement_6mer_density": "double",
    "longest_internal_rc_match": "double",
    "internal_rc_pair_count": "double",
    "palindrome_score": "double",
    "local_self_complementarity_score": "double",
}
_LETTERS = 5  # A C G U and one code for everything else, which complements to itself


def _grid(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    lengths = texts.str.len().to_numpy()
    width = max(int(lengths.max()), 1)
    codes = np.full(256, 4, dtype=np.int64)
    codes[np.frombuffer(b"ACGU", dtype=np.uint8)] = [0, 1, 2, 3]
    flat = "".join(texts.str.pad(width, side="right", fillchar="N")).encode("ascii", "replace")
    return codes[np.frombuffer(flat, dtype=np.uint8)].reshape(len(texts), width), lengths


def _words(grid: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K-mer numbers, numbers of the reverse complements, and which positions exist."""
    spots = grid.shape[1] - k + 1
    if spots < 1:
        empty = np.zeros((len(grid), 0), dtype=np.int64)
        return empty, empty, empty.astype(bool)
    forward = np.zeros((len(grid), spots), dtype=np.int64)
    backward = np.zeros_like(forward)
    partner = np.array([3, 2, 1, 0, 4])[grid]
    for j in range(k):
        forward = forward * _LETTERS + grid[:, j : j + spots]
        backward += partner[:, j : j + spots] * _LETTERS**j
    return forward, backward, np.arange(spots)[None, :] <= (lengths - k)[:, None]


def _occurs(words: np.ndarray, partners: np.ndarray, real: np.ndarray, k: int) -> np.ndarray:
    """Whether the partner of each k-mer occurs in the same row."""
    rows = np.arange(len(words))[:, None]
    size = _LETTERS**k
    if size <= 20000:
        present = np.zeros((len(words), size), dtype=bool)
        present[np.broadcast_to(rows, words.shape)[real], words[real]] = True
        return present[rows, partners] & real
    return np.isin(rows * size + partners, (rows * size + words)[real]) & real


def _share(hits: np.ndarray, real: np.ndarray) -> np.ndarray:
    n = real.sum(axis=1)
    return np.where(n > 0, hits.sum(axis=1) / np.maximum(n, 1), np.nan)


def _mean(*parts: np.ndarray) -> np.ndarray:
    stacked = np.vstack(parts)
    known = ~np.isnan(stacked)
    n = known.sum(axis=0)
    return np.where(n > 0, np.where(known, stacked, 0.0).sum(axis=0) / np.maximum(n, 1), np.nan)


def _local(grid: np.ndarray, lengths: np.ndarray, width: int = 40) -> np.ndarray:
    def score(part: np.ndarray, n: np.ndarray) -> np.ndarray:
        densities = []
        for k in (4, 5):
            w, p, real = _words(part, n, k)
            densities.append(_share(_occurs(w, p, real, k), real))
        return _mean(*densities)

    best = np.full(len(grid), np.nan)
    short = lengths <= width
    if short.any():
        best[short] = score(grid[short][:, :width], lengths[short])
    for start in range(0, grid.shape[1] - width + 1, width // 2):
        fits = ~short & (lengths >= start + width)
        if fits.any():
            value = score(grid[fits][:, start : start + width], np.full(fits.sum(), width))
            best[fits] = np.fmax(best[fits], value)
    return best


def _pair_counts(words: np.ndarray, partners: np.ndarray, real: np.ndarray, k: int) -> np.ndarray:
    rows = np.broadcast_to(np.arange(len(words))[:, None], words.shape)
    size = _LETTERS**k
    counts = np.bincount((rows * size + words)[real], minlength=len(words) * size).reshape(len(words), size)
    partner_of = np.zeros(size, dtype=np.int64)
    left = np.arange(size)
    for _ in range(k):
        digit = left % _LETTERS
        partner_of = partner_of * _LETTERS + np.array([3, 2, 1, 0, 4])[digit]
        left //= _LETTERS
    own = partner_of == np.arange(size)
    once = np.arange(size) < partner_of
    crossed = (counts[:, once] * counts[:, partner_of[once]]).sum(axis=1)
    return crossed + (counts[:, own] * (counts[:, own] - 1) // 2).sum(axis=1)


def _longest(grid: np.ndarray, lengths: np.ndarray, shortest: int = 4, longest: int = 12) -> np.ndarray:
    """A match of length k contains one of length k-1, so only matching rows go on."""
    best = np.zeros(len(grid))
    alive = np.arange(len(grid))
    for k in range(shortest, longest + 1):
        w, p, real = _words(grid[alive], lengths[alive], k)
        alive = alive[_occurs(w, p, real, k).any(axis=1)] if w.shape[1] else alive[:0]
        best[alive] = k
        if not len(alive):
            break
    return best


def repeat_frame(texts: pd.Series) -> pd.DataFrame:
    """Features of a batch of normalised sequences."""
    grid, lengths = _grid(texts)
    out, palindromes = {}, []
    for k in (4, 5, 6):
        w, p, real = _words(grid, lengths, k)
        out[f"reverse_complement_{k}mer_density"] = _share(_occurs(w, p, real, k), real)
        if k == 5:
            out["internal_rc_pair_count"] = _pair_counts(w, p, real, k).astype(float)
        else:
            palindromes.append(_share((w == p) & real, real))
    out["longest_internal_rc_match"] = _longest(grid, lengths)
    out["palindrome_score"] = _mean(*palindromes)
    out["local_self_complementarity_score"] = _local(grid, lengths)
    return pd.DataFrame(out)


def repeat_table(sequences: DataFrame, seq: str = "rna_seq", version: str = "v2_1") -> DataFrame:
    """Inverted-repeat features of each distinct sequence.

    ``version`` chooses the composite: ``v2`` averages five terms, ``v2_1`` adds the pair count.
    """
    # duplicates go in every task first; what is left is dealt out evenly, as its features take long
    n = max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), sequences.sparkSession.sparkContext.defaultParallelism)
    distinct = sequences.select(seq).distinct().repartition(n, F.xxhash64(seq)).withColumn("_t", rna(seq))
    schema = f"`{seq}` string, _t string, " + ", ".join(f"{n} {t}" for n, t in _BATCHED.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):  # keeps the lookup tables small
                part = batch.iloc[at : at + 2000].reset_index(drop=True)
                yield pd.concat([part, repeat_frame(part["_t"].fillna(""))[list(_BATCHED)]], axis=1)

    df = distinct.mapInPandas(run, schema)
    df = df.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in _BATCHED})
    rc4, rc5, rc6 = (F.col(f"reverse_complement_{k}mer_density") for k in (4, 5, 6))
    local = F.col("local_self_complementarity_score")
    terms = [rc4, rc5, rc6, local, F.least(F.col("longest_internal_rc_match") / 12.0, F.lit(1.0))]
    if version == "v2_1":
        terms.append(F.least(F.col("internal_rc_pair_count") / 100.0, F.lit(1.0)))
    elif version != "v2":
        raise ValueError(f"unknown version {version!r}")
    df = df.withColumns(
        {
            "simple_repeat_score": simple_repeat("_t"),
            "self_complementarity_score": mean_of(rc4, rc5, local),
            "inverted_repeat_score": mean_of(*terms),
        }
    )
    df = df.withColumn("simple_repeat_penalty_score", F.col("simple_repeat_score"))
    df = df.withColumns({name: F.lit(None).cast(kind) for name, kind in NOT_AVAILABLE.items()})
    return df.select(seq, *REPEAT_FEATURES, *NOT_AVAILABLE)


def add_repeat_features(windows: DataFrame, seq: str = "rna_seq", version: str = "v2_1", enabled: bool = True) -> DataFrame:
    """Features joined back from the distinct sequences; NULL when the module is off."""
    if not enabled:
        return windows.withColumns({n: F.lit(None).cast("double") for n in REPEAT_FEATURES})
    return windows.join(repeat_table(windows, seq, version), seq, "left")
