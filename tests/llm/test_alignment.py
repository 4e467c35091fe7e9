"""Alignment of two tokenizers against comparing all byte ranges of a document."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seqrank.llm import alignment
from tests.llm.helpers import awkward, docs, rows, sentence

LONG_RUNS = ["a" * 5000, " " * 3000 + "x", "é" * 1500 + "\n" * 1200, "日本語" * 50]
HARD = ["<|endoftext|> and </s><s> ▁mark", "<|endoftext|>", "tab\tand\r\nlines  two", "🙂🙃 naïve don't I'll 12345 ½", *LONG_RUNS]


def plain_tokens():
    """Token ids and bytes of both sides, by the libraries alone."""
    a = Tokenizer.from_file(alignment.BYTES_FILE)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    names = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_FILE)

    def one(text):
        if not text:
            return [], []
        left = [(i, bytes(map(letters.__getitem__, names[i]))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (left, right) if b"".join(t for _, t in left) == whole == b"".join(t for _, t in right) else ([], [])

    return one


def ranges(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain_links(text, tokens):
    a, b = map(ranges, tokens(text))
    near = defaultdict(list)
    for j, (_, s, e) in enumerate(b):
        for byte in range(s, e):
            near[byte].append(j)
    links = sorted({(i, j) for i, (_, s, e) in enumerate(a) for byte in range(s, e) for j in near[byte]})
    ends = {e for _, _, e in a} & {e for _, _, e in b}
    return a, b, links, ends


def plain(data):
    tokens = plain_tokens()
    found = [(doc_id, *plain_links(text, tokens)) for doc_id, text, *_ in data]
    count = Counter((a[i][0], b[j][0]) for _, a, b, links, _ in found for i, j in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, a, b, links, ends in found:
        groups, start = [], 0
        for end in sorted(ends):
            inside = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)]
            groups.append("|".join(inside))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        out.append((doc_id, len(a), len(b), len(ends), len(links), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(12)
    short = [r for r in awkward() if r[1] is None or len(r[1]) < 5000]
    return [*short, *((2000 + i, t, "en", "s", 1) for i, t in enumerate([*HARD, *(sentence(rng, 3 * k) for k in range(30))]))]


@pytest.mark.parametrize("most_sent", [alignment.MOST_SENT, 10])
def test_digests(spark, data, most_sent):
    """Counts sent to the tasks, and joined by batch, give the same."""
    found = alignment.alignment_digests(docs(spark, data, extra=True), most_sent=most_sent)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(data)


def test_links_and_cuts(spark, data):
    tokens = plain_tokens()
    texts = {r[0]: r[1] for r in data if r[0] is not None}
    assert [t for t in texts.values() if t == "<|endoftext|>"]
    for r in alignment.token_alignments(docs(spark, data)).where("doc_id is not null").collect():
        a, b, links, ends = plain_links(texts[r.doc_id], tokens)
        assert r.ids_a == [i for i, *_ in a] and r.ids_b == [i for i, *_ in b]
        assert [tuple(x) for x in r.links] == links
        assert [tuple(x) for x in r.cuts] == [(i, j) for i, j in links if a[i][2] == b[j][2]]
        assert {a[i][2] for i, _ in map(tuple, r.cuts)} == ends


def test_lockstep_on_random_tokens():
    """Batches of documents of very different lengths, whatever the tokens are."""
    rng = np.random.default_rng(7)
    for _ in range(40):
        widths, sides = np.arange(1, 9), ([], [])
        for _ in range(rng.integers(1, 12)):
            total = int(rng.integers(0, 60))
            for side in sides:
                left, own = total, []
                while left:
                    w = int(min(left, rng.integers(1, 9)))
                    own.append(w - 1)
                    left -= w
                side.append(own)
        a, b = (alignment.Side.of(s, widths) for s in sides)
        left, right, cuts = alignment.lockstep(a, b)
        begin = [s.ends - widths[s.ids] for s in (a, b)]
        owner = [np.repeat(np.arange(len(s.sizes)), s.sizes) for s in (a, b)]
        expected = {(i, j) for i in range(len(a.ids)) for j in range(len(b.ids)) if owner[0][i] == owner[1][j] and max(begin[0][i], begin[1][j]) < min(a.ends[i], b.ends[j])}
        assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == sorted(expected)
        assert (cuts == (a.ends[left] == b.ends[right])).all()


def test_both_byte_encoders_agree():
    with open(alignment.BYTES_FILE, "rb") as f:
        tool = alignment.ByteTokenizer(f.read())
    assert tool.fast is not None
    rng = random.Random(8)
    for text in [*HARD, *(sentence(rng, 200) for _ in range(20)), *("".join(chr(rng.choice([rng.randrange(1, 600), rng.randrange(0x2000, 0x2100), rng.randrange(0x1F600, 0x1F640)])) for _ in range(400)) for _ in range(60))]:
        assert tool.encode(text) == tool._slow(text)


def test_packed_numbers():
    for kind in (np.dtype(np.uint32), np.dtype(np.uint64)):
        values = np.array([0, 1, 255, 256, 2**31, 2**32 - 1])
        assert alignment._unpacked(alignment._packed(values, kind), kind).tolist() == values.tolist()
        assert len(alignment._unpacked(alignment._packed(values[:0], kind), kind)) == 0


def test_empty_table(spark):
    assert rows(alignment.alignment_digests(docs(spark, []))) == []
    nothing = docs(spark, [(1, None, None, None, None), (2, "", None, None, None)])
    assert rows(alignment.alignment_digests(nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
