"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import shuffle_width

#: The tokenizer that the queries use.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: The template's control strings. OPEN is followed by the role and a line break.
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings of this and other templates. In texts an ESCAPE breaks each, and doubles itself.
ESCAPE = "\\"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
#: Characters of a part of a conversation that the tokenizer gets at once; parts end where turns do.
PART = 1 << 20

_UNSAFE = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_INSIDE = {s: s[0] + ESCAPE + s[1:] for s in CONTROL} | {ESCAPE: ESCAPE + ESCAPE}
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without any control string: an escape goes behind the first character of each."""
    return _UNSAFE.sub(lambda m: _INSIDE[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it stands in the output, and where its text begins and ends there."""
    head = OPEN + escape(role).replace("\n", ESCAPE + "\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


# A role ends at the first line break without an escape; texts hold no CLOSE.
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\n\\]|\\.)*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@functools.lru_cache(maxsize=2)
def _tokenizer(data: str, threads: int):
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    from tokenizers import AddedToken, Tokenizer

    out = Tokenizer.from_str(data)
    out.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (OPEN, CLOSE)])
    return out


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens bear loss, and the stretches [start, stop) of characters that they cover of ``spans``.

    ``offsets`` are the tokens' (start, stop), ``spans`` the turns'; both are sorted. Binary search finds
    the first and the last token of each span. Tokens that share one character (bytes of it) cover it once.
    """
    mask = np.zeros(len(offsets), dtype=bool)
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    covered = []
    for (a, b), i, j in zip(spans.tolist(), first.tolist(), last.tolist(), strict=True):
        if a < b and i < j:
            mask[i:j] = True
            covered.append((max(a, int(offsets[i, 0])), min(b, int(offsets[j - 1, 1]))))
    return mask, np.array(covered, dtype=np.int64).reshape(-1, 2)


#: Columns of :func:`format_parts`: a part of a conversation; most have one.
PARTS = "conv_id long, part int, formatted string, n_turns long, ids array<int>, loss array<boolean>, spans array<array<int>>"


def _parts(batches):
    """Runs of turns of one conversation, cut where a part is full: (key, number, [(role, text), ...])."""
    current, number, turns, size = None, 0, [], 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            new = turns and conv != current
            if new or size >= PART:
                yield current, number, turns
                number, turns, size = (0 if new else number + 1), [], 0
            current = conv
            turns.append((role or "", text or ""))
            size += len(turns[-1][1])
    if turns:
        yield current, number, turns


def format_parts(turns: DataFrame, tokenizer: str = TOKENIZER, threads: int = 2, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format the conversations of ``turns`` (conv_id, turn, role, text): the columns of PARTS.

    Turns are sorted by turn, then role and text (nulls first). A turn is OPEN, role, line break, text,
    CLOSE; control strings inside are escaped. ``formatted`` is encoded once, with offsets. ``loss`` marks
    the tokens that the texts of the roles in ``learn`` reach, ``spans`` are the stretches of characters of
    ``formatted`` under that mask. As OPEN and CLOSE are special tokens, no token reaches over the end of a
    turn; so a conversation longer than PART characters comes in several parts with the tokens of the
    whole, and no task holds more than a part of it.

    Null roles and texts are empty; rows with a null conv_id are one conversation with the id null; repeated
    rows are repeated turns; other columns are ignored; an empty table gives no rows.
    """
    spark = turns.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        data = spark.sparkContext.broadcast(f.read())
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*order).repartition(shuffle_width(spark), "conv_id").sortWithinPartitions(*order)
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32()))]
    names = [x.split()[0] for x in PARTS.split(", ")]

    def formatted(batches):
        coder, waiting, size = _tokenizer(data.value, threads), [], 0

        def flush():
            texts, built = [], []
            for conv, number, pairs in waiting:
                pieces, spans, at = [], [], 0
                for role, text in pairs:
                    piece, a, b = render(role, text)
                    if role in learn:
                        spans.append((at + a, at + b))
                    pieces.append(piece)
                    at += len(piece)
                texts.append("".join(pieces))
                built.append((conv, number, len(pairs), np.array(spans, dtype=np.int64).reshape(-1, 2)))
            rows = []
            for text, (conv, number, n, spans), e in zip(texts, built, coder.encode_batch(texts, add_special_tokens=False), strict=True):
                mask, covered = loss_mask(np.array(e.offsets, dtype=np.int64).reshape(-1, 2), spans)
                rows.append((conv, number, text, n, e.ids, mask, covered.tolist()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for item in _parts(batches):
            waiting.append(item)
            size += sum(len(t) for _, t in item[2])
            if size >= PART or len(waiting) >= 500:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()

    return rows.mapInArrow(formatted, PARTS)


def summaries(parts: DataFrame) -> DataFrame:
    """Per conversation what its output says: it is read back from ``formatted`` and ``spans``, part by part in order."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    names = [x.split()[0] for x in out.split(", ")]

    def read(batches):
        current, state = None, None

        def row(conv, s):
            values = (conv, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"], s["tokens"], s["marked"])
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names)

        for batch in batches:
            for conv, part, text, ids, loss, spans in zip(*(batch.column(k) for k in ("conv_id", "part", "formatted", "ids", "loss", "spans")), strict=True):
                conv, text = conv.as_py(), text.as_py()
                if part.as_py() == 0:
                    if state:
                        yield row(current, state)
                    current, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "tokens": 0, "marked": 0}
                for role, said in read_back(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for a, b in spans.as_py():
                    said = unescape(text[a:b])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["size"] += len(text)
                state["tokens"] += len(ids)
                state["marked"] += int(np.asarray(loss.values).sum()) if len(loss) else 0
        if state:
            yield row(current, state)

    return parts.mapInArrow(read, out)


def format_digests(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens) of every conversation.

    The parts of a conversation stay in order in one task: the second step runs on the rows of the first.
    """
    return summaries(format_parts(turns, tokenizer))
