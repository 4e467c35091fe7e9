"""Alignment of two tokenizers: all documents of a batch are merged in lockstep, one NumPy step at a time."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import saved

#: The tokenizers that the query aligns: a byte-level BPE file (A) and a SentencePiece model (B).
BYTES_FILE, PIECES_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of the texts that are merged at once; a longer text is merged alone.
BATCH_BYTES = 4 << 20
#: Id pairs whose counts are sent to every task (16 bytes each); more are joined instead.
MOST_SENT = 1 << 22
#: One text in so many, by a hash, is encoded by a second library, too; other ids stop the job.
VERIFIED = 64

MARK = "▁"  # stands for a space inside pieces

# Fixed value of the byte-level format: the pattern that cuts texts before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The character that the byte-level format writes for each byte: itself where it is printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))})
    return out


class ByteTokenizer:
    """A byte-level BPE file. Its merges, in the order of their ids, are the ranks of a faster library; texts with very
    long words, for which that one is quadratic, and files with other ids go to the tokenizers library."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(data.decode())
        self.slow.encode_special_tokens = True
        file = json.loads(data)
        vocabulary, letters = file["model"]["vocab"], byte_letters()
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
        self.size = max(vocabulary.values(), default=-1) + 1
        self.bytes = [b""] * self.size
        for t, i in ranks.items():
            self.bytes[i] = t
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        pre = file["pre_tokenizer"]
        plain = file["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        ordered = [vocabulary[t] for t in joined] == list(range(256, 256 + len(joined))) and len(ranks) == 256 + len(joined)
        self.fast = None
        if plain and ordered:
            import tiktoken

            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long = re.compile(r"\S{1000}|\s{1000}")

    def _slow(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self.fast is None or self.long.search(text):
            return self._slow(text)
        ids = self.fast.encode_ordinary(text)
        if zlib.crc32(text.encode()) % VERIFIED == 0 and ids != self._slow(text):
            raise ValueError("the two byte-level encoders give other ids")
        return ids


class PieceTokenizer:
    def __init__(self, data: bytes):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@dataclass
class Side:
    """One tokenizer's tokens of a batch: ids of all documents in a row, where documents start, byte offsets of token ends."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, documents: list[list[int]], widths: np.ndarray) -> Side:
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        ids = np.fromiter((i for d in documents for i in d), dtype=np.int32, count=int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], np.cumsum(widths[ids])])
        return cls(ids, starts, total[1:] - np.repeat(total[starts[:-1]], sizes))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def lockstep(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (token of A, token of B) with overlapping bytes, and whether both end there.

    One state vector holds a pointer into A and one into B for each unfinished document. A step
    links the tokens under all pointers, notes a cut where both end, and moves those that end first;
    finished documents leave the vector. Documents must have the same bytes on both sides, and no token without bytes.
    """
    busy = np.flatnonzero(a.sizes)
    at_a, at_b, stop = a.starts[busy].copy(), b.starts[busy].copy(), a.starts[busy + 1]
    left, right = np.empty((2, len(a.ids) + len(b.ids)), dtype=np.int64)
    cuts = np.empty(len(left), dtype=bool)
    n = 0
    while k := len(at_a):
        end_a, end_b = a.ends[at_a], b.ends[at_b]
        left[n : n + k], right[n : n + k] = at_a, at_b
        move_a, move_b = end_a <= end_b, end_b <= end_a
        cuts[n : n + k] = move_a & move_b
        n += k
        at_a += move_a
        at_b += move_b
        going = at_a != stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    return left[:n], right[:n], cuts[:n]


@dataclass
class Batch:
    """Tokens of a batch of documents on both sides, and their links by document."""

    a: Side
    b: Side
    left: np.ndarray
    right: np.ndarray
    cuts: np.ndarray
    link_starts: np.ndarray
    document: np.ndarray

    def __len__(self) -> int:
        return len(self.a.sizes)

    @property
    def n_groups(self) -> np.ndarray:
        return np.bincount(self.document[self.cuts], minlength=len(self))


def plan(texts: list[str | None]):
    """Slices of ``texts`` of at most BATCH_BYTES, or of one text."""
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= BATCH_BYTES // 2):
            size += len((texts[stop] or "").encode())
            stop += 1
            if size >= BATCH_BYTES:
                break
        yield at, stop
        at = stop


class Aligner:
    def __init__(self, bytes_data: bytes, pieces_data: bytes):
        self.a, self.b = ByteTokenizer(bytes_data), PieceTokenizer(pieces_data)
        self.widths = [np.array([len(t) for t in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        most = max(self.a.size, self.b.size)
        self.digits = np.zeros((most, len(str(most)) + 1), dtype=np.uint8)
        for i in range(most):
            word = str(i).encode()
            self.digits[i, : len(word)] = list(word)
        self.n_digits = np.array([len(str(i)) for i in range(most)])

    def batch(self, texts: list[str | None]) -> Batch:
        """Texts that are null or empty, or that the tokens of a side don't spell as space + text, have no tokens."""
        full = [" " + t if t else "" for t in texts]
        side_a = [self.a.encode(t) if t else [] for t in full]
        some = [k for k, t in enumerate(full) if t]
        side_b: list[list[int]] = [[] for _ in full]
        for k, ids in zip(some, self.b.encode([texts[k] for k in some]), strict=True):
            side_b[k] = ids
        for k in some:
            whole = full[k].encode()
            if b"".join(map(self.a.bytes.__getitem__, side_a[k])) != whole or b"".join(map(self.b.bytes.__getitem__, side_b[k])) != whole:
                side_a[k], side_b[k] = [], []
        a, b = Side.of(side_a, self.widths[0]), Side.of(side_b, self.widths[1])
        left, right, cuts = lockstep(a, b)
        owner = np.repeat(np.arange(len(texts)), a.sizes)[left]
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        return Batch(a, b, left[order], right[order], cuts[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), owner)

    def group_digests(self, batch: Batch) -> list[str]:
        """sha256 of each document's groups as ``a1,a2|b1;a3|b2,b3``; without tokens ''."""
        a, b = batch.a, batch.b
        last_a, last_b = np.zeros(len(a.ids), dtype=bool), np.zeros(len(b.ids), dtype=bool)
        last_a[batch.left[batch.cuts]] = True
        last_b[batch.right[batch.cuts]] = True
        # a token stands behind its own side's earlier tokens and those of the other side's earlier groups
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        end_a, end_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        place_a, place_b = np.arange(len(a.ids)) + end_b[group_a], np.arange(len(b.ids)) + (end_a[group_b] if len(end_a) else 0)
        ids = np.empty(len(a.ids) + len(b.ids), dtype=np.int32)
        ids[place_a], ids[place_b] = a.ids, b.ids
        marks = np.full(len(ids), ord(","), dtype=np.uint8)
        marks[place_a[last_a]], marks[place_b[last_b]] = ord("|"), ord(";")
        sizes = self.n_digits[ids]
        cells = self.digits[ids]
        cells[np.arange(len(ids)), sizes] = marks
        text = cells[np.arange(cells.shape[1]) <= sizes[:, None]].tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes + 1)])[a.starts + b.starts]
        return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(stops, stops[1:], strict=False)]

    def codes(self, batch: Batch) -> np.ndarray:
        """The id pair of each link as one number."""
        return batch.a.ids[batch.left].astype(np.int64) * self.b.size + batch.b.ids[batch.right]


@functools.lru_cache(maxsize=2)
def aligner(bytes_data: bytes, pieces_data: bytes) -> Aligner:
    return Aligner(bytes_data, pieces_data)


def _files(docs: DataFrame, bytes_file: str, pieces_file: str):
    """The tokenizers' files, read by the driver and sent to the tasks: a few MB whatever the input."""
    out = []
    for path in (bytes_file, pieces_file):
        with open(path, "rb") as f:
            out.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(out))


def token_alignments(docs: DataFrame, bytes_file: str = BYTES_FILE, pieces_file: str = PIECES_FILE) -> DataFrame:
    """(doc_id, ids_a, ids_b, links, cuts) of every row of ``docs``.

    A encodes space + text, B the text, to which it adds that space; no special tokens. ``links`` are the pairs (place in ids_a, place
    in ids_b) of tokens whose bytes overlap, ``cuts`` those where both end, in order. Texts that are null or empty, or whose
    tokens spell something else on either side, have empty lists. Other columns are neither read nor returned; repeated rows stay.
    """
    files = _files(docs, bytes_file, pieces_file)

    def lists(values, starts):
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)

    def align(batches):
        tool = aligner(*files.value)
        for rows in batches:
            texts = rows.column(1).to_pylist()
            for at, stop in plan(texts):
                x = tool.batch(texts[at:stop])
                pairs = pa.StructArray.from_arrays([pa.array((side - own.starts[x.document]).astype(np.int32)) for side, own in ((x.left, x.a), (x.right, x.b))], ["a", "b"])
                cut_starts = np.concatenate([[0], np.cumsum(x.n_groups)])
                columns = [rows.column(0).slice(at, stop - at), lists(pa.array(x.a.ids), x.a.starts), lists(pa.array(x.b.ids), x.b.starts)]
                yield pa.RecordBatch.from_arrays([*columns, lists(pairs, x.link_starts), lists(pairs.take(pa.array(np.flatnonzero(x.cuts))), cut_starts)], ["doc_id", "ids_a", "ids_b", "links", "cuts"])

    pair = "array<struct<a:int,b:int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, f"doc_id long, ids_a array<int>, ids_b array<int>, links {pair}, cuts {pair}")


def _packed(values: np.ndarray, kind: np.dtype) -> bytes:
    """Numbers by the planes of their bytes, which compress better than one number after the other."""
    return values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel().astype(np.int64)


_COUNTS = np.dtype(np.uint32)
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(rows, pairs: np.ndarray, totals: np.ndarray, best: np.ndarray, kind: np.dtype) -> pa.RecordBatch:
    """Documents' results, with the counts of their pairs looked up; ``pairs`` are sorted."""
    best_links, sums = [], []
    for codes, counts in zip(rows.column("codes").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        own = _unpacked(counts, _COUNTS)
        at = np.searchsorted(pairs, np.cumsum(_unpacked(codes, kind)))
        best_links.append(int(own[best[at]].sum()))
        sums.append(int((own * totals[at]).sum()))
    columns = [rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, pa.array(best_links, pa.int64()), pa.array(sums, pa.int64()), rows.column("groups_sha256")], [f.split()[0] for f in _OUT.split(", ")])


def alignment_digests(docs: DataFrame, bytes_file: str = BYTES_FILE, pieces_file: str = PIECES_FILE, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Documents are aligned as by :func:`token_alignments`, once. Tasks write each document's distinct id pairs, and each batch's
    with their counts; the latter add up to the corpus-wide counts. Up to ``most_sent`` different pairs, the counts go to the tasks; more are joined with
    the batches' pairs, and each batch meets its documents again. ``n_best`` is the number of links whose pair is the most
    frequent one of its B id, ties included; ``count_sum`` adds the counts over the links. Documents without tokens (null and empty
    texts, or texts that a side doesn't spell) have zeros and ''. Other columns are neither read nor returned; repeated rows count each time;
    an empty table gives an empty result.
    """
    files = _files(docs, bytes_file, pieces_file)
    tool = aligner(*files.value)
    width, kind = tool.b.size, np.min_scalar_type(tool.a.size * tool.b.size)
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "counts", "pairs", "times"]

    def align(batches):
        tool = aligner(*files.value)
        chunk = TaskContext.get().partitionId() << 32
        limit = tool.a.size * tool.b.size
        for rows in batches:
            texts = rows.column(1).to_pylist()
            for at, stop in plan(texts):
                x, n = tool.batch(texts[at:stop]), stop - at
                # distinct pairs by document, and of the batch
                own, times = np.unique(x.document * limit + tool.codes(x), return_counts=True)
                starts = np.searchsorted(own, np.arange(n + 1) * limit)
                own %= limit
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                codes = [_packed(np.diff(own[s:e], prepend=0), kind) for s, e in zip(starts, starts[1:], strict=False)]
                counts = [_packed(times[s:e], _COUNTS) for s, e in zip(starts, starts[1:], strict=False)]
                numbers = [pa.array(v.astype(np.int64)) for v in (x.a.sizes, x.b.sizes, x.n_groups, np.diff(x.link_starts))]
                empty = pa.nulls(n, pa.list_(pa.int64()))
                digests = pa.array(tool.group_digests(x), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), rows.column(0).slice(at, n), *numbers, digests, pa.array(codes, pa.binary()), pa.array(counts, pa.binary()), empty, empty], names)
                if len(own):
                    sums = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (own[order][first], np.add.reduceat(times[order], first))]
                    nothing = [pa.nulls(1, t) for t in (*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *nothing, *sums], names)
                chunk += 1

    spark = docs.sparkSession
    schema = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, counts binary, pairs array<long>, times array<long>"
    aligned, _ = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, schema), compression="zstd")
    per_document = aligned.where("codes is not null").drop("pairs", "times")
    per_batch = aligned.where("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    totals = per_batch.groupBy("pair").agg(F.sum("n").alias("n"))
    # a B id has at most as many pairs as A has ids
    best = totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    marked, _ = saved(totals.join(best, F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    if marked.count() <= most_sent:
        table = marked.toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

        def score(batches):
            for rows in batches:
                yield from _scored(rows, *sent.value, kind).to_batches()

        return per_document.mapInArrow(score, _OUT)

    def meet(documents, counts):
        counts = counts.sort_by("pair")
        return _scored(documents, *[counts.column(c).to_numpy() for c in ("pair", "n", "best")], kind)

    known = per_batch.select(F.col("chunk").alias("of"), "pair").join(marked, "pair")
    return per_document.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(meet, _OUT)
