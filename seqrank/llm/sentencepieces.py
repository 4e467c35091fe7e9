"""SentencePiece models on the tokenizers library: encoding and decoding without their own runtime."""

from __future__ import annotations

import functools
import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model that the queries use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space inside pieces
#: Characters of one call of the encoder, and encoded pre-tokens that a worker remembers.
CALL_CHARS, REMEMBERED = 1 << 20, 300_000

# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Spec:
    """What a model file says. Defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(data: bytes):
    """(number, value) of the fields of a protobuf message; lengths give bytes, the rest integers."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        if size is None:
            if tag & 7 != 2:
                raise ValueError("not a model file")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> Spec:
    """Read a model: pieces with scores and kinds, the kind of model, byte fallback, and the normaliser."""
    out = Spec()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.kind = v
                elif n == 35:
                    out.byte_fallback = bool(v)
                elif n == 24 and v:
                    raise ValueError("models with white space as a suffix are not supported")
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.squeeze = bool(v)
                elif n == 5:
                    out.escape = bool(v)
    if out.kind not in (UNIGRAM, BPE):
        raise ValueError(f"models of kind {out.kind} are not supported")
    if any(kind in (UNUSED, USER_DEFINED) for _, _, kind in out.pieces):
        raise ValueError("models with unused or user-defined pieces are not supported")
    return out


def merges(spec: Spec) -> list[tuple[str, str]]:
    """The pairs of pieces that join to a piece, best score first."""
    known = {p for p, _, kind in spec.pieces if kind == NORMAL}
    ranked = [(-score, i, p) for i, (p, score, kind) in enumerate(spec.pieces) if kind == NORMAL and len(p) > 1]
    return [(p[:k], p[k:]) for _, _, p in sorted(ranked) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]


class Codec:
    """Encoder and decoder of one model.

    Text is normalised (character map if the model has one, white space, prefix), spaces become the
    marker, and the tokenizers library encodes it: BPE from the merges, or unigram from the scores,
    both with byte fallback. If no piece has a marker behind another character, no piece reaches over
    the start of a word, and words can be encoded on their own and remembered: the usual case.
    """

    def __init__(self, data: bytes, threads: int = 2):
        # read when the library starts its threads
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import Tokenizer, models, normalizers

        self.spec = spec = parse(data)
        if spec.kind == BPE:
            unknown = spec.pieces[spec.unknown][0]
            model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=unknown, byte_fallback=spec.byte_fallback, fuse_unk=True)
        else:
            model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
        self.backend = Tokenizer(model)
        self.charsmap = normalizers.Precompiled(spec.charsmap) if spec.charsmap else None
        self.split = not any(kind == NORMAL and re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in spec.pieces)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in spec.pieces]

    def normalise(self, text: str) -> str:
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.spec.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if text and self.spec.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.spec.escape else text

    def _encode(self, parts: list[str]) -> None:
        at = 0
        while at < len(parts):
            size, stop = 0, at
            while stop < len(parts) and (size == 0 or size + len(parts[stop]) <= CALL_CHARS):
                size += len(parts[stop])
                stop += 1
            for part, e in zip(parts[at:stop], self.backend.encode_batch_fast(parts[at:stop], add_special_tokens=False), strict=True):
                self.known[part] = np.array(e.ids, dtype=np.int32).tobytes()
            at = stop

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text; what one call gives the library is encoded by several threads."""
        out, at = [], 0
        while at < len(texts):
            size, stop = 0, at
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= CALL_CHARS):
                size += len(texts[stop])
                stop += 1
            cut = [self.words.findall(t) if self.split else [t] * bool(t) for t in map(self.normalise, texts[at:stop])]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self._encode(list({w for words in cut for w in words if w not in self.known}))
            out += [np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.int32) for words in cut]
            if not self.split:
                self.known.clear()
            at = stop
        return out

    def decode(self, ids) -> str:
        """The text of ``ids``: pieces with spaces for markers, bytes of the fallback joined, no prefix."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")
        return text[1:] if self.spec.dummy_prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=4)
def codec(data: bytes, threads: int) -> Codec:
    return Codec(data, threads)


def check_parity(data: bytes, texts: list[str]) -> list[int]:
    """Places of ``texts`` whose ids are not those of the sentencepiece library."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)
    return [i for i, (a, b) in enumerate(zip(Codec(data).encode(texts), theirs, strict=True)) if a.tolist() != b]


#: Texts for which a model must agree with the sentencepiece library before it is used.
PROBES = ["", " ", "a", "  two  spaces ", "Hello, world! 12345", "naïve façade – “quoted” ¡olé! ß", "日本語 テキスト 한국어 русский", "🙂🙃\ttab\nline\r\n nbsp", "aaaaaaaaaaaaaaaa", "</s><s><unk>", "▁marker▁", "x" * 300, "\x00\x01\x7f", "end "]


#: Columns that :func:`with_tokens` adds.
NEW = ["n_tokens", "ids", "decoded", "round_trip"]


def with_tokens(docs: DataFrame, path: str = MODEL, threads: int = 2, probe: int = 200) -> DataFrame:
    """``docs`` with its columns, and ``n_tokens``, ``ids``, ``decoded`` and ``round_trip``.

    ``decoded`` is the text that the ids give back, ``round_trip`` whether it equals the text (a model
    that maps characters or squeezes white space can't return them). The driver reads the model file
    (a bounded number of pieces) and sends its bytes. Before that, parity with the sentencepiece
    library is verified on PROBES and on up to ``probe`` texts of ``docs``; a difference raises.
    Null texts stay null with no ids; empty ones have no ids; other columns, nulls and repeated rows
    stay as they are. Columns of ``docs`` with the names of the new ones are replaced.
    """
    with open(path, "rb") as f:
        data = f.read()
    sample = [r.text for r in docs.select(F.col("text")).where("text is not null").limit(probe).collect()] if probe else []
    if wrong := check_parity(data, [*PROBES, *sample]):
        raise ValueError(f"{len(wrong)} texts get other ids than from sentencepiece")
    new = NEW
    source = docs.drop(*new)
    own = docs.sparkSession.sparkContext.broadcast(data)
    names = source.columns

    def tokens(batches):
        coder = codec(own.value, threads)
        for whole in batches:
            step = 500
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = batch.column(names.index("text")).to_pylist()
                ids = coder.encode([t or "" for t in texts])
                back = [None if t is None else coder.decode(i.tolist()) for t, i in zip(texts, ids, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)))
                same = pa.array([None if t is None else t == b for t, b in zip(texts, back, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(back, pa.string()), same], [*names, *new])

    schema = source.select("*", F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("ids"), F.lit("").cast("string").alias("decoded"), F.lit(True).alias("round_trip")).schema
    for f in schema[-4:]:
        f.nullable = True
    return source.mapInArrow(tokens, schema)


def encode_documents(docs: DataFrame, path: str = MODEL, threads: int = 2) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip) of every row of ``docs``."""
    out = with_tokens(docs.select("doc_id", "text"), path, threads)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
