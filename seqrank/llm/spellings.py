"""Spelling variants: words that are one edit apart, found in k-d trees over their letter counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import discard, first_by_hash, free_shuffles, key_runs, saved, shuffle_width

#: Words that a cell should hold, characters that its block of words holds at most, and points of a tree's leaf.
CELL, BLOCK_CHARS, LEAF = 16_384, 1 << 22, 48
#: Words that the trees over whole lengths are built from: that many at most, in order of a hash.
SAMPLE = 1 << 18
#: Elements of one comparison in a leaf, and of one look at letters.
STEP = 1 << 21

DIMENSIONS = 90


def dimension(codes: np.ndarray) -> np.ndarray:
    """The count that a code point adds to: one for each of a-z, the others by their last six bits."""
    return np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + (codes & 63)).astype(np.int64)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, dtype=f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def texts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as objects, and the place of each in code-point order."""
    out = np.array(words, dtype=object)
    return out, np.argsort(np.argsort(out))


def letter_counts(codes: np.ndarray) -> np.ndarray:
    n, width = codes.shape
    out = np.zeros((n, DIMENSIONS), dtype=np.int32)
    step = max(1, STEP // max(1, width))
    for at in range(0, n, step):
        part = codes[at : at + step]
        place = dimension(part) + np.arange(len(part))[:, None] * DIMENSIONS
        out[at : at + step] = np.bincount(place.ravel(), minlength=len(part) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return out


def signature(counts: np.ndarray) -> np.ndarray:
    """Two 64-bit words: counts of 32 classes of letters as up to four set bits.

    The bits in which two signatures differ are no more than the L1 distance of the counts.
    """
    classes = np.zeros((len(counts), 32), dtype=np.int32)
    classes[:, :26] = counts[:, :26]
    for d in range(26, DIMENSIONS):
        classes[:, 26 + d % 6] += counts[:, d]
    out = np.zeros((len(counts), 2), dtype=np.uint64)
    for c in range(32):
        for level in range(4):
            out[:, c // 16] |= (classes[:, c] > level).astype(np.uint64) << np.uint64(c % 16 * 4 + level)
    return out


@dataclass
class Node:
    """A box's split: counts of ``dim`` up to ``cut`` go left. ``low`` and ``high`` bound the box in ``dim`` before it."""

    dim: int
    cut: int
    low: int
    high: int
    left: Node | int
    right: Node | int


class Tree:
    """A k-d tree over letter counts; its leaves are numbered, ``members`` has the points of each."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.members: list[np.ndarray] = []
        low, high = np.zeros(DIMENSIONS, dtype=np.int64), np.full(DIMENSIONS, 1 << 30, dtype=np.int64)
        self.root = self._build(counts, np.arange(len(counts)), low, high, leaf)

    def _build(self, counts, rows, low, high, leaf):
        if len(rows) > leaf:
            # the evenest of the cuts at and below each count's median, on up to 1,024 of the points
            look = counts[rows[:: -(-len(rows) // 1024)]]
            middle = np.sort(look, axis=0)[len(look) // 2]
            cuts = np.stack([middle, middle - 1])
            below = np.stack([(look <= c).mean(axis=0) for c in cuts])
            even = np.minimum(below, 1 - below)
            k, dim = np.unravel_index(int(even.argmax()), even.shape)
            cut, dim = int(cuts[k, dim]), int(dim)
            goes = counts[rows, dim] <= cut
            if goes.any() and not goes.all():
                own_low, own_high = int(low[dim]), int(high[dim])
                high[dim] = cut
                left = self._build(counts, rows[goes], low, high, leaf)
                high[dim], low[dim] = own_high, cut + 1
                right = self._build(counts, rows[~goes], low, high, leaf)
                low[dim] = own_low
                return Node(dim, cut, own_low, own_high, left, right)
        self.members.append(rows)
        return len(self.members) - 1

    def visits(self, counts: np.ndarray, radius: int):
        """(leaf, rows of ``counts``) whose distance to the leaf's box is at most ``radius``: box by box, for all rows at once."""
        stack = [(self.root, np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64))]
        while stack:
            node, rows, cost = stack.pop()
            if not isinstance(node, Node):
                yield node, rows
                continue
            x = counts[rows, node.dim]
            under, over = np.maximum(node.low - x, 0), np.maximum(x - node.high, 0)
            for side, further in ((node.left, np.maximum(x - node.cut, 0) - over), (node.right, np.maximum(node.cut + 1 - x, 0) - under)):
                near = cost + further
                take = near <= radius
                if take.any():
                    stack.append((side, rows[take], near[take]))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one replaced letter, or by one inserted if ``long`` has one more."""
    out = np.zeros(len(short), dtype=bool)
    step = max(1, STEP // short.shape[1])
    for at in range(0, len(short), step):
        a, b = short[at : at + step], long[at : at + step]
        if a.shape[1] == b.shape[1]:
            out[at : at + step] = (a != b).sum(axis=1) == 1
            continue
        ahead, behind = a == b[:, :-1], (a == b[:, 1:])[:, ::-1]
        begin = np.where(ahead.all(axis=1), a.shape[1], ahead.argmin(axis=1))
        end = np.where(behind.all(axis=1), a.shape[1], behind.argmin(axis=1))
        out[at : at + step] = begin + end >= a.shape[1]
    return out


class Block:
    """Words of one length and cell with their tree."""

    def __init__(self, words: list[str], n: np.ndarray):
        (self.words, self.order), self.n = texts(words), n
        self.codes = letters(words)
        counts = letter_counts(self.codes)
        self.signature = signature(counts)
        self.tree = Tree(counts, LEAF)

    def near(self, codes: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, own word) for rows of one length, the own one or one less, that are one edit away."""
        radius = 2 if codes.shape[1] == self.codes.shape[1] else 1
        rows, own = [], []
        for leaf, asks in self.tree.visits(counts, radius):
            members = self.tree.members[leaf]
            # a leaf of many equal counts is taken in pieces
            for first in range(0, len(members), STEP):
                piece = members[first : first + STEP]
                step = max(1, STEP // len(piece))
                for at in range(0, len(asks), step):
                    q = asks[at : at + step]
                    apart = np.bitwise_count(marks[q, None, 0] ^ self.signature[None, piece, 0])
                    apart += np.bitwise_count(marks[q, None, 1] ^ self.signature[None, piece, 1])
                    i, j = np.nonzero(apart <= radius)
                    i, j = q[i], piece[j]
                    for k in range(0, len(i), STEP):
                        a, b = i[k : k + STEP], j[k : k + STEP]
                        # copies of letters of as many pairs as fit
                        fit = max(1, STEP // codes.shape[1])
                        good = np.concatenate([one_edit(codes[a[m : m + fit]], self.codes[b[m : m + fit]]) for m in range(0, len(a), fit)])
                        rows.append(a[good])
                        own.append(b[good])
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(own)


_FOUND = ["word", "n_near", "best_n", "best"]


def _summary(words, at, other_words, other_n, other_order, of) -> pa.RecordBatch:
    """For each word of ``at``: how many of the words ``of`` are near it, and the most frequent one (ties: the first in order)."""
    order = np.lexsort((other_order[of], -other_n[of], at))
    at, of = at[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(at)]]))
    best = of[first]
    return pa.RecordBatch.from_arrays([pa.array(words[at[first]].tolist(), pa.string()), pa.array(sizes.astype(np.int64)), pa.array(other_n[best]), pa.array(other_words[best].tolist(), pa.string())], _FOUND)


def _search(batches):
    """Rows sorted by (cell, block, guest): a block's own words (0) make the tree, guests of their length (1) and shorter ones (2) ask it, a batch at a time."""
    key, block, own = None, None, []
    for found, rows in key_runs(batches, ["length", "cell", "block", "guest"]):
        if found[:3] != key:
            key, block, own = found[:3], None, []
        if not found[3]:
            own.append(rows)
            continue
        if block is None:
            if not own:
                continue
            table = pa.Table.from_batches(own)
            block = Block(table.column("word").to_pylist(), np.asarray(table.column("n")))
            own = []
        words = rows.column(rows.schema.get_field_index("word")).to_pylist()
        codes = letters(words)
        counts = letter_counts(codes)
        i, j = block.near(codes, counts, signature(counts))
        if len(i):
            (asked, order), n = texts(words), np.asarray(rows.column(rows.schema.get_field_index("n")))
            yield _summary(asked, i, block.words, block.n, block.order, j)
            if codes.shape[1] < key[0]:  # words of one length are each other's guests; a shorter guest is also news to the longer word
                yield _summary(block.words, j, asked, n, order, i)


def _placer(trees: dict[int, Tree], guests: bool):
    """Tasks that place words in the cells of their length: as the cell's own, and as guests of all cells within reach."""

    def place(batches):
        for batch in batches:
            for (length,), rows in key_runs([batch.take(pa.array(np.argsort(np.asarray(batch.column(2)), kind="stable")))], ["length"]):
                step = max(1, STEP // length)
                for start in range(0, rows.num_rows, step):
                    part = rows.slice(start, step)
                    counts = letter_counts(letters(part.column(0).to_pylist())) if length in trees or length + 1 in trees else None
                    for target, radius, guest in [(length, 0, 0), (length, 2, 1), (length + 1, 1, 2)][: 3 if guests else 1]:
                        if target in trees:
                            visits = trees[target].visits(counts, radius)
                        else:
                            visits = [(0, np.arange(part.num_rows))]
                        for cell, at in visits:
                            k = len(at)
                            out = part.take(pa.array(at))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(k, target, dtype=np.int32)), pa.array(np.full(k, cell, dtype=np.int32)), pa.array(np.full(k, guest, dtype=np.int32)), out.column(0), out.column(1)],
                                ["length", "cell", "guest", "word", "n"],
                            )

    return place


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, best_n, best) of the distinct words of (word, n) that have a word one edit away.

    One replaced letter changes the letter counts by two in L1, one inserted letter by one. Words
    of a length share a k-d tree built from a bounded sample, whose leaves are the cells: a word lives in one cell and
    is a guest in the cells of its own length within distance two and of the next length within distance one.
    Each cell has a tree of its own words, guests search it box by box, and the letters' order decides. Where the sample
    misjudges a cell, or its words have the same counts, it comes in blocks, each of which meets all guests.
    """
    spark = words.sparkSession
    words = words.select("word", "n", F.length("word").alias("length"))
    full = {r.length: r["count"] for r in words.groupBy("length").count().where(F.col("count") > cell).collect()}
    trees: dict[int, Tree] = {}
    if full:
        by_length: dict[int, list[str]] = {}
        for r in first_by_hash(words.where(F.col("length").isin(list(full))).select("word"), ["word"], SAMPLE).collect():
            by_length.setdefault(len(r.word), []).append(r.word)
        for length, sample in by_length.items():
            trees[length] = Tree(letter_counts(letters(sorted(sample))), max(8, len(sample) * cell // (2 * full[length])))
    schema = "length int, cell int, guest int, word string, n long"
    room = F.greatest(F.lit(1), F.least(F.lit(cell), (F.lit(BLOCK_CHARS) / F.col("length")).cast("long")))
    over = words.mapInArrow(_placer(trees, False), schema).groupBy("length", "cell").count().where(F.col("count") > room)
    over = over.select("length", "cell", F.ceil(F.col("count") / room).cast("int").alias("blocks"))
    placed = words.mapInArrow(_placer(trees, True), schema).join(over, ["length", "cell"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("word"), blocks).cast("int"))
    placed = placed.withColumn("block", F.explode(F.when(F.col("guest") == 0, own).otherwise(F.sequence(F.lit(0), blocks - 1)))).drop("blocks")
    key = ["length", "cell", "block"]
    dealt = placed.repartition(shuffle_width(spark), F.xxhash64(*key)).sortWithinPartitions(*key, "guest")
    found = dealt.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("x")).select("word", "n_near", (-F.col("x.a")).alias("best_n"), F.col("x.b").alias("best"))


def group_variants(words: DataFrame, factor: int = 10, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (word, n).

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the one of these with the largest n
    (ties: the first in code-point order) if its n, ``form_n``, is at least ``factor`` times the word's. ``root`` is where following
    forms ends, the word itself if it has none. Repeated words are one with the sum of their n; null and empty words, and null n, are left
    out; other columns are not read. An empty table gives an empty result.
    """
    spark = words.sparkSession
    rows, kept = saved(words.where("word <> '' and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = rows.join(near_words(rows, cell), "word", "left")
    leads = F.col("best_n") >= F.col("n") * factor
    found, path = saved(near.select("word", F.when(leads, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best_n")).alias("form_n")))
    free_shuffles(spark)
    # each round follows twice as many forms; n grows by the factor at each, so a handful of rounds is the most there can be
    ends, step = found.where("form is not null").select("word", F.col("form").alias("root")), None
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not ends.join(further, "root", "leftsemi").limit(1).count():
            break
        ends, new = saved(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        if step:
            discard(spark, step)
        step = new
    discard(spark, kept)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_words(docs: DataFrame, least_letters: int = 7, least_count: int = 2, damage: int | None = None) -> DataFrame:
    r"""(word, n): the runs ``[A-Za-zÀ-ÿ]+`` of whole texts of ``docs``, A-Z lower-cased, and how often they occur.

    Of words with at least ``least_letters`` letters, those that occur at least ``least_count`` times are returned. With ``damage``, a run
    whose crc32 of "doc_id:run" that number divides loses one letter first, at that hash modulo its length: a stand-in for typing errors. Null and empty
    texts have no words; a null doc_id counts as an empty one; repeated rows count each time.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("([A-Za-zÀ-ÿ]{%d,})" % least_letters), F.lit(1)))
    rows = docs.select("doc_id", run.alias("word"))
    if damage:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (h % F.length("word")).cast("int")
        without = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        rows = rows.select(F.when(h % damage == 0, without).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_letters)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
