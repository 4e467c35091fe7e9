"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import discard, key_runs, saved, shuffle_width
from seqrank.llm.components import components, forest

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Home fingerprints that one comparison holds; a fuller anchor is dealt out in such blocks.
BLOCK = 4096
_PIECE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit majority print of a text's word shingles (see :func:`fingerprints`)."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(shingle, len(words))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), _PIECE):
        h = b"".join([digest(flat[a:b], SEED) for a, b in zip(first[at : at + _PIECE], last[at : at + _PIECE], strict=True)])
        bits = np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8)[:, ::-1], axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    bits = np.packbits(2 * ones > len(first), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the SimHash of every text as a signed long.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``shingle``
    space-joined words with repeats (a shorter text is one shingle), hashed with XXH64 and
    seed 42; a bit of the print is set if more than half of the hashes have it. Null and
    wordless texts have the print zero.
    """

    def prints(batches):
        for batch in batches:
            out = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "print"])

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(prints, source.select("doc_id", F.lit(0).cast("long").alias("print")).schema)


@functools.cache
def anchors() -> np.ndarray:
    """The 65,536 words of a linear [64, 16] code, as unsigned longs.

    They are the truth tables over GF(64) of Tr(ax) + Tr(bx^3) + Tr8(cx^9) + d: all affine
    functions of six bits, and 512 families of quadratic ones. As it holds the first-order
    Reed-Muller code of that length, no 64-bit word is further than 28 bits from an anchor.
    """

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a * (b & 1)
            a, b = a << 1, b >> 1
            a ^= 0b1000011 * (a >> 6)  # x^6 + x + 1
        return out

    def power(a: int, n: int) -> int:
        return functools.reduce(times, [a] * n, 1)

    def trace(a: int, steps: int) -> int:
        return functools.reduce(lambda x, y: x ^ y, [power(a, 2**i) for i in range(steps)]) & 1

    small = [a for a in range(64) if power(a, 8) == a]  # GF(8); x^9 lies in it
    rows = [sum(trace(times(1 << i, power(x, n)), 6) << x for x in range(64)) for n in (1, 3) for i in range(6)]
    basis = next([a, b, c] for a in small for b in small for c in small if len({0, a, b, c, a ^ b, a ^ c, b ^ c, a ^ b ^ c}) == 8)
    # the trace from GF(8) to GF(2) takes three conjugates
    rows += [sum(trace(times(a, power(x, 9)), 3) << x for x in range(64)) for a in basis]
    words = np.zeros(1, dtype=np.uint64)
    for row in [*rows, (1 << 64) - 1]:
        words = np.concatenate([words, words ^ np.uint64(row)])
    return words


def _visits(prints: np.ndarray, distance: int):
    """Per print: its home anchor, and the anchors where it may meet a link's other end."""
    code = anchors()
    half = code[: len(code) // 2]  # the other half holds the complements, in the same order
    mixed, gap = np.empty_like(half), np.empty(len(half), dtype=np.uint8)
    for value in prints:
        np.bitwise_xor(half, value, out=mixed)
        np.bitwise_count(mixed, out=gap)
        folded = np.minimum(gap, 64 - gap)
        near = int(folded.min())
        # Few are close: first the runs of 64 that hold one, then their members.
        close = (folded <= near + distance).reshape(-1, 64)
        runs = np.flatnonzero(close.view(np.uint64).any(axis=1))
        at = (runs[:, None] * 64 + np.arange(64))[close[runs]]
        own = np.concatenate([gap[at], 64 - gap[at]])
        at = np.concatenate([at, at + len(half)])
        at, own = at[own <= near + distance], own[own <= near + distance]
        home = int(at[np.argmin(own)])
        # At equal distances the link is found at the smaller home.
        yield home, at[(own < near + distance) | (at <= home)]


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct 64-bit prints (column ``print``) that join whatever lies within ``distance`` bits.

    Every print has the nearest anchor as home, n bits away; n is at most the covering radius.
    Of two linked prints, let x be the one with the smaller (n, home). The other is then within
    n_x + distance <= n_y + distance of x's home, so it suffices to send each print to all
    anchors within its own n plus the distance: a part of the ball of covering radius plus
    distance. Each anchor compares its home prints with each other and with its visitors.
    A fuller anchor is dealt out in blocks of home prints; visitors go to all of its blocks and
    home prints to all later ones. Instead of all pairs within a group, a forest with the same
    groups comes back. Nothing is capped.
    """
    spark = prints.sparkSession

    def places(batches):
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            home, anchor, value, near = [], [], [], []
            for v, (h, at) in zip(values, _visits(values, distance), strict=True):
                anchor.append(at)
                home.append(at == h)
                value.append(np.full(len(at), v))
            if anchor:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([a.astype(np.int32) for a in anchor], [x.view(np.int64) for x in value], home)], ["anchor", "print", "home"])

    # a print takes long next to its size: deal them out evenly, whatever their table's size. They come dealt by print; by its hash they are dealt anew
    dealt = prints.select("print").repartition(shuffle_width(spark), F.xxhash64("print"))
    placed, path = saved(dealt.mapInArrow(places, "anchor int, print long, home boolean"))
    # at most one row for each of the 65,536 anchors, and only for the full ones
    full, full_path = saved(placed.where("home").groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1"))
    any_full = full.limit(1).count() > 0
    if any_full:
        placed = placed.join(F.broadcast(full), "anchor", "left")
    n = F.coalesce("blocks", F.lit(1)) if any_full else F.lit(1)
    own = F.pmod(F.xxhash64("print"), n).cast("int")
    dealt = placed.select("anchor", "print", "home", n.alias("n"), own.alias("own"))
    dealt = dealt.select("anchor", "print", F.explode(F.when(F.col("home"), F.sequence("own", F.col("n") - 1)).otherwise(F.sequence(F.lit(0), F.col("n") - 1))).alias("block"), (F.col("home") & (F.col("own") == F.col("block"))).alias("_own"), "home", "own") if any_full else dealt.select("anchor", "print", F.lit(0).alias("block"), F.col("home").alias("_own"))
    dealt = dealt.select("anchor", "block", "print", F.when(F.col("_own"), 0).otherwise(1).alias("role"))
    sorted_ = dealt.repartition(shuffle_width(spark), "anchor", "block").sortWithinPartitions("anchor", "block", "role")
    found, found_path = saved(sorted_.mapInArrow(lambda batches: _compare(batches, distance), "a long, b long").distinct())
    discard(spark, path, full_path)
    return found


def _near(left: np.ndarray, right: np.ndarray, distance: int):
    """Pieces (offset, mask) of the table which of ``left`` lie within ``distance`` of which of ``right``."""
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        yield at, np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= distance


def _groups(values: np.ndarray, distance: int) -> np.ndarray:
    """The group number of each value: those that chains of near values join have the same."""
    group = np.arange(len(values))
    if len(values) < 2:
        return group
    busy = np.concatenate([mask.sum(axis=1) > 1 for _, mask in _near(values, values, distance)])
    left = np.flatnonzero(busy)
    while len(left):
        seed, left = left[:1], left[1:]
        head = seed[0]
        while len(seed) and len(left):
            met = np.zeros(len(left), dtype=bool)
            for _, mask in _near(values[seed], values[left], distance):
                met |= mask.any(axis=0)
            seed, left = left[met], left[~met]
            group[seed] = head
    return group


class _Anchor:
    """One anchor's block: its home prints by group, to be met by visitors."""

    def __init__(self, prints: np.ndarray, distance: int):
        self.distance = distance
        group = _groups(prints, distance)
        order = np.argsort(group, kind="stable")
        self.prints, group = prints[order], group[order]
        self.starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=int)
        self.heads = self.prints[self.starts]
        self.inner = (self.prints, np.repeat(self.heads, np.diff([*self.starts, len(prints)])))

    def meet(self, visitors: np.ndarray):
        for at, mask in _near(visitors, self.prints, self.distance):
            if mask.any():
                row, group = np.nonzero(np.logical_or.reduceat(mask, self.starts, axis=1))
                yield visitors[at + row], self.heads[group]


def _compare(batches, distance: int):
    """Links within the runs of (anchor, block); role 0 rows, the home prints, come first."""
    key, home, cell = None, [], None

    def batch(a: np.ndarray, b: np.ndarray):
        keep = a != b
        if keep.any():
            ends = forest(a[keep].view(np.int64), b[keep].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    for now, run in key_runs(batches, ["anchor", "block"]):
        if now != key:
            if cell is None and home:
                yield from batch(*_Anchor(np.concatenate(home), distance).inner)
            key, home, cell = now, [], None
        prints, role = np.asarray(run.column(2)).view(np.uint64), np.asarray(run.column(3))
        cut = int(np.searchsorted(role, 1))
        if cut:
            home.append(prints[:cut])
        if cut < len(prints) and (cell is not None or home):
            if cell is None:
                cell = _Anchor(np.concatenate(home), distance)
                yield from batch(*cell.inner)
            met = list(cell.meet(prints[cut:]))
            if met:
                yield from batch(np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met]))
    if cell is None and home:
        yield from batch(*_Anchor(np.concatenate(home), distance).inner)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id long, text string).

    ``fingerprint`` is the print in 16 hex digits; ``component_id`` the least doc_id that links
    of at most ``distance`` differing bits reach. Only distinct prints are compared. A row with
    a null doc_id keeps its row and takes part in links, but never names a group; repeated rows
    come back repeated; other columns are ignored; an empty table gives no rows.
    """
    prints, _ = saved(fingerprints(docs, shingle))
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    group = components(links(least, distance, block))
    named = least.join(group.withColumnRenamed("node", "print"), "print", "left")
    named = named.select("print", "least", F.coalesce("component", "print").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(first, "component").select("print", "component_id")
    return prints.join(label, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their group, all columns as they are.

    Equal rows of such a document become one. Rows without an id can't be told apart by one; they stay.
    """
    return keep_least(docs, near_duplicates(docs, shingle, distance))


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``groups`` (doc_id, component_id) names by their least id, and those without an id."""
    least, _ = saved(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    # the list grows with the documents: merge joins at any size, which share one exchange of the documents
    single = docs.join(least.where("n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    repeated = docs.join(least.where("n > 1").select("doc_id").hint("merge"), "doc_id", "left_semi").distinct()
    return single.union(repeated).union(docs.where("doc_id is null"))
