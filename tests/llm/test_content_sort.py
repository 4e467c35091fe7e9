"""Exact duplicates by content sort against grouping in a dictionary."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqrank.llm.content_sort import exact_duplicates
from tests.llm.helpers import awkward, docs, rows, sentence


def plain(data, keep, change=lambda t: t):
    """Rows without ``kept``, and the kept ones of each group: one row."""
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        groups[change(text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def compare(found, data, keep, change=lambda t: t):
    expected, digests = plain(data, keep, change)
    got = found.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected
    stay = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in stay) == sorted(digests)
    assert all(r.doc_id == r.keep_id for r in stay)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("width", [None, 1, 13])
def test_awkward_rows(spark, keep, width):
    compare(exact_duplicates(docs(spark, extra=True), keep, width=width), awkward(), keep)


def test_groups_over_many_ranges(spark):
    """One text with a third of the rows and one with a sixth reach over several ranges each; texts share long beginnings."""
    rng = random.Random(3)
    start = sentence(rng, 60)
    data = [(i, start if i % 3 == 0 else start + " b" if i % 6 == 1 else f"{start} {i % 977}", "en", "s", 1) for i in range(6000)]
    data += [(None, start, None, None, None)] * 40 + [(None, "only nulls", None, None, None)] * 3
    rng.shuffle(data)
    for keep in ("smallest", "largest"):
        found = exact_duplicates(docs(spark, data), keep, width=17)
        compare(found, data, keep)


def test_hot_text_is_dealt_out(spark):
    """No range holds a group as a whole: copies are spread by their ids."""
    data = [(i, "same", "en", "s", 4) for i in range(4000)]
    found = exact_duplicates(docs(spark, data), width=8)
    assert found.where("keep_id <> 0 or group_size <> 4000 or kept <> (doc_id = 0)").count() == 0
    keyed = docs(spark, data).repartitionByRange(8, "text", "doc_id").groupBy(F.spark_partition_id()).count()
    assert keyed.count() == 8


def test_normalised_texts(spark):
    data = [(1, "A b", None, None, None), (2, "a B", None, None, None), (3, None, None, None, None), (4, "  ", None, None, None), (5, "ab", None, None, None)]
    compare(exact_duplicates(docs(spark, data), "largest", lambda c: F.trim(F.lower(c))), data, "largest", lambda t: t.lower().strip(" "))


def test_empty_table_and_wrong_choice(spark):
    assert rows(exact_duplicates(docs(spark, []))) == []
    with pytest.raises(ValueError):
        exact_duplicates(docs(spark, []), "any")
