"""SimHash anchors, vector cells and components against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash

from seqrank.llm import components, shared_shingles, simhash, vectors
from tests.llm.helpers import WORDS, awkward, docs, rows, sentence


def groups(nodes, links):
    """Least node reachable, by repeated relabelling."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            for n in (a, b):
                if label[n] != low:
                    label[n], changed = low, True
    return label


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (3, 4), (9, 8), (8, 7)], [(0, i) for i in range(1, 60)], [(i, i + 1) for i in range(40)], [(5, 5), (-3, 4)], []])
def test_components(spark, links):
    table = spark.createDataFrame([*links, *links, (None, 1), (1, None)], "a long, b long")
    nodes = {n for link in links for n in link if link[0] != link[1]}
    assert rows(components.components(table)) == sorted(groups(nodes, [x for x in links if x[0] != x[1]]).items(), key=lambda r: tuple((True, str(v)) for v in r))


def test_forest_joins_the_same_nodes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(-20, 20, (2, rng.integers(1, 40)))
        c, d = components.forest(a, b)
        nodes = {*a.tolist(), *b.tolist()}
        assert groups(nodes, list(zip(a, b, strict=True))) == groups(nodes, list(zip(c, d, strict=True)))
        assert len(c) < len(nodes)


def test_print_is_the_majority_of_hashes():
    for _, text, *_ in awkward():
        if text is None or len(text) < 5000:
            assert simhash.fingerprint(None if text is None else text.encode()) == plain_print(text)
    long = ("alpha beta gamma delta " * 40_000).encode()  # more than one piece
    assert simhash.fingerprint(long) == plain_print(long.decode())


def test_anchors_are_a_linear_code_that_holds_all_affine_functions():
    code = simhash.anchors()
    known = set(code.tolist())
    assert len(known) == 1 << 16
    rng = random.Random(0)
    for _ in range(200):
        assert rng.choice(code.tolist()) ^ rng.choice(code.tolist()) in known
    for mask in range(64):
        for flip in (0, 1):
            assert sum((bin(x & mask).count("1") + flip & 1) << x for x in range(64)) in known


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_links_join_whatever_is_near(spark, block):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for centre in rng.sample(sorted(prints), 12):
        for flips in (1, 2, 3, 4, 4, 5, 6):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), flips)))
    chain = rng.getrandbits(64)
    for step in range(16):
        chain ^= 0xF << (4 * step)
        prints.add(chain)
    hot = rng.getrandbits(64)
    prints |= {hot ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    near = [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "print long"), block=block).collect()

    assert groups(signed, [(r.a, r.b) for r in found]) == groups(signed, near)


def expected_groups(table):
    prints = [(r[0], plain_print(r[1]) if len(r[1] or "") < 50_000 else simhash.fingerprint(r[1].encode())) for r in table]
    distinct = sorted({p for _, p in prints})
    label = groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return sorted(((i, f"{p:016x}", least.get(label[p])) for i, p in prints), key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_near_duplicates(spark):
    table = awkward()
    assert rows(simhash.near_duplicates(docs(spark))) == expected_groups(table)
    assert rows(simhash.near_duplicates(docs(spark, extra=True))) == expected_groups(table)
    assert rows(simhash.near_duplicates(docs(spark, []))) == []
    assert rows(simhash.near_duplicates(docs(spark, [(None, None, None, None, None)] * 2))) == [(None, "0" * 16, None)] * 2


def test_one_document_of_each_group_stays(spark):
    table = awkward()
    out = simhash.one_per_group(docs(spark, extra=True))
    assert out.columns == docs(spark, extra=True).columns
    kept = sorted(r.doc_id for r in out.where("doc_id is not null").select("doc_id").collect())
    assert kept == sorted({c for _, _, c in expected_groups(table) if c is not None})
    assert out.where("doc_id is null").count() == 2
    assert rows(simhash.one_per_group(docs(spark, []))) == []


def plain_links(table, least=0.98):
    def good(label, v):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    out = []
    for i, (_, v, label) in enumerate(table):
        for j in range(i):
            if good(label, v) and good(table[j][2], table[j][1]) and label == table[j][2] and len(v) == len(table[j][1]) and vectors.exact_cosine(v, table[j][1]) >= least:
                out.append((i, j))
    return out


def expected_vectors(table):
    links = plain_links(table)
    label = groups(range(len(table)), links)
    n = [sum(i in x for x in links) for i in range(len(table))]
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[label[i]] = min(r[0], least.get(label[i], r[0]))
    return sorted(((r[0], n[i], least.get(label[i]), r[0] == least.get(label[i])) for i, r in enumerate(table)), key=lambda r: tuple((v is not None, str(v)) for v in r))


def vector_table(n=140, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    out = [(i, np.float32(centres[i % 6] + rng.normal(size=dim) * (0.12 if i % 3 else 0.6)).tolist(), i % 2) for i in range(n)]
    v = out[0][1]
    nan, inf = float("nan"), float("inf")
    out += [(n + k, x, 0) for k, x in enumerate([None, [], [0.0] * dim, [nan] * dim, [inf, *v[1:]], [None, *v[1:]], v, v, [-x for x in v], [x * 2 for x in v], v[:4], [0.0, -0.0, 1.0, *[0.0] * (dim - 3)], [-0.0, 0.0, 1.0, *[0.0] * (dim - 3)]])]
    return [*out, (n + 50, v, None), (None, v, 0), (None, [0.0] * dim, 1), out[0], out[0]]


@pytest.mark.parametrize("cell", [vectors.CELL, 12])
def test_near_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    table = vector_table()
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    assert rows(vectors.near_vectors(frame)) == expected_vectors(table)
    clashing = frame.selectExpr("*", "1 as node", "2 as n", "3 as copies", "4 as cell", "5 as component", "6 as least")
    assert rows(vectors.near_vectors(clashing)) == expected_vectors(table)


def test_vectors_of_an_empty_table(spark):
    assert rows(vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))) == []


def test_pivots_split_a_label_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    rng = np.random.default_rng(8)
    hot = rng.normal(size=6)
    table = [(i, (hot + rng.normal(size=6) * 0.08 if i % 3 == 0 else rng.normal(size=6)).tolist(), 7) for i in range(240)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    assert rows(vectors.near_vectors(frame)) == expected_vectors(table)


def expected_alike(data):
    """(doc_id, least doc_id of the group) of rows whose texts share 0.8 of their five-word shingles; a shorter text is one shingle."""

    def parts(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [parts(r[1]) for r in data]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 9 * len(a & b) >= 4 * (len(a) + len(b))]
    label = groups(range(len(data)), near)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[label[i]] = min(r[0], least.get(label[i], r[0]))
    return [(r[0], least.get(label[i])) for i, r in enumerate(data)]


def alike(a, b):
    """Whether texts of five words or more have a Jaccard similarity of 0.8 of their five-word shingles."""
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) >= 0.8 * len(a | b)


def test_pipeline_stage_finds_every_pair_of_similarity_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(11)
    line = sentence(rng, 30)
    texts = [sentence(rng, rng.randint(60, 200)) for _ in range(40)] + [f"{sentence(rng, 25)} {line}" for _ in range(30)]
    for base in texts[:12]:
        for share in (0.005, 0.01, 0.02, 0.02, 0.03, 0.05):
            texts.append(" ".join(rng.choice(WORDS) if rng.random() < share else w for w in base.split()))
    hot = sentence(rng, 100).split()
    texts += [" ".join(hot[:i] + ["zz", str(i)] + hot[i + 1 :]) for i in range(60)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j])]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in near) > 100  # that the distance of operator 10 misses
    label = groups(range(len(texts)), near)
    table = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kept = corpus_pipeline.one_of_each(spark, docs(spark, table), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_near_copies_that_are_not_linked_meet_in_tiles(spark, monkeypatch):
    """Of a family, most of whose pairs are just too different, few pairs are compared on their own; cells of several slices lose no link."""
    rng = random.Random(4)
    base = sentence(rng, 150).split()
    texts = []
    for i in range(60):
        changed = set(rng.sample(range(150), 1 + i % 6))
        texts.append(" ".join(f"q{i}x{k}" if k in changed else w for k, w in enumerate(base)))
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    asked, confirm = [], shared_shingles._confirmed
    monkeypatch.setattr(shared_shingles, "_confirmed", lambda pairs, *a: asked.append(pairs.count()) or confirm(pairs, *a))
    monkeypatch.setattr(shared_shingles, "CELL", 16, raising=False)
    monkeypatch.setattr(shared_shingles, "SLICE", 7, raising=False)
    found = shared_shingles.near_duplicates(docs(spark, data))
    theirs = expected_alike(data)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == sorted(theirs)
    assert 20 < len({c for _, c in theirs}) < 60
    assert sum(asked) < 60


def test_longer_versions_of_near_copies_are_found(spark):
    """The extra words of a longer version are rarer than what it shares, and it meets sets on both sides of a shingle's largest group."""
    rng, table = random.Random(3), []
    for i in range(120):
        base = [f"w{i}x{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(3):
            text = list(base)
            text[33 * k] = f"c{k}"
            table.append((10 * i + k, " ".join(text), "en", "s", 1))
        table.append((10 * i + 5, " ".join([*base, *(f"e{i}x{j}" for j in range(12 + i % 9))]), "en", "s", 1))
    got = shared_shingles.near_duplicates(docs(spark, table))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == sorted(expected_alike(table))


def test_prefix_bound_loses_no_pair():
    """Sets with a similarity of 0.8 share so many of their first shingles that the bound lets them pass."""
    import duckdb

    rng = random.Random(6)
    rows_ = []
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(200), n))
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 5))):
            b.discard(rng.choice(sorted(a)))
            if rng.random() < 0.5:
                b.add(rng.randrange(200))
        if not b or 9 * len(a & b) < 4 * (len(a) + len(b)):
            continue
        first = [set(sorted(x)[: shared_shingles.prefix_length(len(x))]) for x in (a, b)]
        assert first[0] & first[1]
        rows_.append(f"({len(a)},{len(b)},{len(first[0] & first[1])})")
    assert len(rows_) > 1000
    bound = shared_shingles._bound("a", "b").replace(" div ", " // ")
    assert duckdb.sql(f"select count(*) from (values {','.join(rows_)}) t(a, b, shared) where not ({bound})").fetchall() == [(0,)]


def test_shared_shingles_take_awkward_rows(spark):
    found = shared_shingles.near_duplicates(docs(spark, extra=True))
    assert rows(found) == sorted(expected_alike(awkward()), key=lambda r: tuple((v is not None, str(v)) for v in r))
    out = shared_shingles.one_per_group(docs(spark, extra=True))
    assert out.columns == docs(spark, extra=True).columns
    assert out.where("doc_id is null").count() == 2
    kept = [r.doc_id for r in out.where("doc_id is not null").collect()]
    assert len(kept) == len(set(kept)) and 25 in kept and not {26, 27, 28, 33, 35, 36, 37} & set(kept)
    assert rows(shared_shingles.one_per_group(docs(spark, []))) == []
