"""Spelling variants against comparing all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqrank.llm import spellings
from tests.llm.helpers import awkward, docs, rows

LETTERS = "abcdeéñ"


def near(a, b):
    """Exactly one edit apart, by trying each."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, factor=10):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        leads = best is not None and counts[best] >= factor * n
        out[w] = (best if leads else None, n, len(others), counts[best] if leads else None)

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return sorted((w, f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items())


def some_words(rng, n):
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    for w in base[: n // 2]:
        i = rng.randrange(len(w) + 1)
        base.append(w[:i] + rng.choice(LETTERS) + w[i:])
        base.append(w[: i - 1] + rng.choice(LETTERS) + w[i:] if i else w)
        base.append("".join(rng.sample(w, len(w))))
    return {w: int(10 ** (4 * rng.random())) + 1 for w in base if w}


@pytest.mark.parametrize("cell", [spellings.CELL, 40])
def test_all_pairs(spark, monkeypatch, cell):
    """Also with so small cells that lengths have trees, cells come in blocks and leaves hold a handful."""
    counts = some_words(random.Random(cell), 500)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in spellings.group_variants(table, cell=cell).collect()) == plain(counts)


def test_tree_visits_lose_nothing():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (600, spellings.DIMENSIONS)) * (rng.random((600, spellings.DIMENSIONS)) < 0.08)
    asks = np.concatenate([points[:150], np.maximum(points[150:300] + rng.integers(-1, 2, (150, spellings.DIMENSIONS)) * (rng.random((150, spellings.DIMENSIONS)) < 0.02), 0)])
    tree = spellings.Tree(points, 5)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(600))
    for radius in (0, 1, 2):
        seen = {(i, j) for leaf, at in tree.visits(asks, radius) for i in at.tolist() for j in tree.members[leaf].tolist()}
        apart = np.abs(asks[:, None] - points[None]).sum(axis=2)
        assert {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= radius), strict=True)} <= seen
        assert len(seen) < 0.9 * apart.size  # boxes are left out


def test_signatures_bound_the_distance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, (2, 200, spellings.DIMENSIONS))
    apart = np.bitwise_count(spellings.signature(a) ^ spellings.signature(b)).sum(axis=1)
    assert (apart <= np.abs(a - b).sum(axis=1)).all()


def test_chains_anagrams_and_long_words(spark):
    """Forms of forms; a cell of equal counts in blocks; words of thousands of letters."""
    chain = {"abcdefg" + "h" * k: 10**k for k in range(1, 8)}
    rng = random.Random(4)
    anagrams = {"".join(rng.sample("aabbccddee", 10)): rng.randint(1, 2000) for _ in range(300)}
    long = "".join(rng.choice(LETTERS) for _ in range(9000))
    many = {long: 70, long[:4000] + long[4001:]: 7, long[:-1] + "z": 700, long + "z": 3}
    counts = {**chain, **anagrams, **many}
    table = spark.createDataFrame([*counts.items(), (None, 3), ("", 4), ("zz", None)], "word string, n long").selectExpr("*", "'clash' as root", "1 as cell", "2 as length")
    assert sorted(tuple(r) for r in spellings.group_variants(table, cell=50).collect()) == plain(counts)


def test_repeated_words_and_empty_table(spark):
    table = spark.createDataFrame([("word", 1), ("word", 2), ("ward", 30)], "word string, n long")
    assert rows(spellings.group_variants(table)) == [("ward", None, "ward", 30, 1, None), ("word", "ward", "ward", 3, 1, 30)]
    assert rows(spellings.group_variants(table.limit(0))) == []


@pytest.mark.parametrize("damage", [None, 3])
def test_document_words(spark, damage):
    data = [*awkward(), (None, "Straße Ñandúes NANDUES×÷ nandues-nandues", None, None, None), (77, "abcdefgh" * 3000 + " ABCDEFGÀ abcdefgÀ", None, None, None)]
    seen = Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    expected = {w: n for w, n in seen.items() if len(w) >= 4 and n >= 2}
    assert dict(map(tuple, spellings.document_words(docs(spark, data, extra=True), 4, 2, damage).collect())) == expected
