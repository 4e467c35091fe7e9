"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash anchors first, then their rarest shingles."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm import simhash
from seqrank.llm.common import discard, free_shuffles, key_runs, saved, shuffle_width
from seqrank.llm.components import components, forest

SHINGLE, SEED, DISTANCE = 5, 42, 4
#: Pairs that one copy of a text is compared in.
HEADS = 512
#: A shingle that so many sets hold may be a cell of sets that are compared at once; a set goes to so many cells at most, in tiles of two slices of about so many sets.
CELL, HOMES, SLICE = 64, 8, 512
#: Documents that are looked at for common shingles, and shingles kept from them. Both set the order of work only.
LOOK, MOST_COMMON = 10_000, 100_000
_PIECE = 1 << 16


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, ascending; words and short texts as in ``simhash.fingerprints``."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(shingle, len(words))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    parts = [np.array([digest(flat[a:b], SEED) for a, b in zip(first[at : at + _PIECE], last[at : at + _PIECE], strict=True)], dtype=np.uint64) for at in range(0, len(first), _PIECE)]
    return np.unique(np.concatenate(parts).view(np.int64))


def _key(found: np.ndarray) -> int:
    """A number for a set of shingles; equal sets have the same."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that several of a bounded number of documents hold."""
    n = max(1, docs.count())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    few = _texts(docs.where(place < min(1 << 30, (LOOK << 30) // n + 1)))

    def hashes(batches):
        for batch in batches:
            for text in batch.column(1):
                found = shingles(text.as_py(), shingle)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found)], ["token"])

    counted = few.mapInArrow(hashes, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = sorted((r.token, r.n) for r in counted.orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect())
    return np.array([t for t, _ in top], dtype=np.int64), np.array([n for _, n in top], dtype=np.int64)


def _print(found: np.ndarray) -> int:
    """The SimHash of a set of shingles: the bits that more than half of their hashes have."""
    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), _PIECE):
        ones += np.unpackbits(found[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def prefix_length(size: int) -> int:
    """How many of a set's rarest shingles must be looked at: sets that share 0.8 of the larger one share one of these."""
    return size - (4 * size + 4) // 5 + 1 if size else 0


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, size, print, tokens): the set of each row's text by its key and size, its SimHash and its rarest shingles.

    All sets follow one order: shingles that are common in a bounded look come last, the rest by their hash. Tokens are
    hashes folded to 32 bits, which can only add candidates.
    """
    common, count = _common(docs, shingle)

    def rows(batches):
        for batch in batches:
            key, size, mark, tokens = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), shingle)
                key.append(_key(found))
                size.append(len(found))
                mark.append(_print(found))
                weight = np.zeros(len(found), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    weight = np.where(common[at] == found, count[at], 0)
                tokens.append(found[np.lexsort((found, weight))[: prefix_length(len(found))]].astype(np.int32))
            columns = [pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(mark, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "key", "size", "print", "tokens"])

    source = _texts(docs)
    kind = source.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("key", "size", "print")), F.array(F.lit(0)).alias("tokens"))
    return source.mapInArrow(rows, kind.withColumn("size", F.col("size").cast("int")).schema)


def _with_keys(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, text) of every row of ``docs``."""

    def rows(batches):
        for batch in batches:
            key = [_key(shingles(text.as_py(), shingle)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column(1)], ["key", "text"])

    return _texts(docs).mapInArrow(rows, "key long, text binary")


def _alike(batches, shingle: int):
    """Of rows sorted by (a, block, role): the pairs of a block's head (role 0) with texts whose sets have a similarity of 0.8 or more."""
    key, head = None, None
    for now, rows in key_runs(batches, ["a", "block", "role"]):
        texts = rows.column(rows.schema.get_field_index("text"))
        if now[2] == 0:
            key, head = now[:2], shingles(texts[0].as_py(), shingle)
            continue
        if now[:2] != key:
            continue
        keep = []
        for text in texts:
            own = shingles(text.as_py(), shingle)
            keep.append(9 * len(np.intersect1d(head, own, assume_unique=True)) >= 4 * (len(head) + len(own)))
        yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(keys: DataFrame, docs: DataFrame, least: DataFrame, shingle: int) -> tuple[DataFrame, str]:
    """(key, text): a written table with one text for each of the distinct ``keys``, and its path."""
    ids = keys.join(least, "key").select("doc_id").where("doc_id is not null").distinct()
    named = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").union(docs.where("doc_id is null").select("doc_id", "text"))
    out = saved(_with_keys(named, shingle).join(keys, "key", "left_semi").dropDuplicates(["key"]), compression="zstd")
    free_shuffles(keys.sparkSession)
    return out


def _confirmed(pairs: DataFrame, docs: DataFrame, least: DataFrame, shingle: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) of keys whose sets have a similarity of 0.8 or more.

    Texts go to the comparison, not sets: compressed, a text takes less than half of the room. The text of b
    goes once for each pair, that of a once for a block of up to HEADS pairs, so that a key with many pairs spreads over blocks.
    """
    spark = pairs.sparkSession
    texts, path = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, least, shingle)
    heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HEADS).cast("int").alias("blocks"))
    members = pairs.join(heads, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
    members = members.join(texts.withColumnRenamed("key", "b"), "b").select("a", "b", "block", F.lit(1).alias("role"), "text")
    opened = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    opened = opened.join(texts.withColumnRenamed("key", "a"), "a").select("a", F.col("a").alias("b"), "block", F.lit(0).alias("role"), "text")
    dealt = opened.union(members).repartition(shuffle_width(spark), F.xxhash64("a", "block")).sortWithinPartitions("a", "block", "role")
    out, _ = saved(dealt.mapInArrow(lambda batches: _alike(batches, shingle), "a long, b long"))
    discard(spark, path)
    free_shuffles(spark)
    return out


class _Tile:
    """The sets of a slice, by shingle, to be met by other sets."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]):
        keys, groups, sets = zip(*held, strict=True)
        self.keys, self.groups, self.sizes = np.array(keys), np.array(groups), np.array([len(x) for x in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def meet(self, group: int, found: np.ndarray) -> np.ndarray:
        """Keys of the sets of other groups that have a similarity of 0.8 or more to ``found``."""
        first = np.searchsorted(self.tokens, found)
        n = np.searchsorted(self.tokens, found, side="right") - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.keys))
        return self.keys[(9 * shared >= 4 * (self.sizes + len(found))) & (self.groups != group)]


def _tiles(batches, shingle: int):
    """Of rows sorted by (token, i, j, role): links between the sets of a tile's slice (role 0), and between these and its other sets, as forests."""
    tile, held, ready, a, b = None, [], None, [], []

    def met(key: int, group: int, found: np.ndarray):
        near = ready.meet(group, found)
        a.append(near)
        b.append(np.full(len(near), key))

    def links(least: int):
        if sum(map(len, a)) > least:
            ends = forest(np.concatenate(a), np.concatenate(b))
            a.clear()
            b.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])

    for now, rows in itertools.chain(key_runs(batches, ["token", "i", "j", "role"]), [(None, None)]):
        if now is None or now[:3] != tile:
            if held and tile[1] == tile[2]:
                # a slice and itself
                ready = _Tile(held)
                for row in held:
                    met(*row)
                yield from links(_PIECE)
            tile, held, ready = now and now[:3], [], None
        if now is None:
            yield from links(0)
            continue
        key, group, text = (rows.column(rows.schema.get_field_index(c)) for c in ("key", "group", "text"))
        for k, g, t in zip(key.to_pylist(), group.to_pylist(), text, strict=True):
            if now[3] == 0:
                held.append((k, g, shingles(t.as_py(), shingle)))
            elif held:
                ready = ready or _Tile(held)
                met(k, g, shingles(t.as_py(), shingle))
        yield from links(_PIECE)


def _within_cells(cells: DataFrame, docs: DataFrame, least: DataFrame, shingle: int) -> DataFrame:
    """Links that join what has a similarity of 0.8 or more, between the sets of each of ``cells`` (token, members, key, group) that are in different groups.

    A text goes once to each tile of its cell, however many it is compared with; a cell of up to SLICE sets is one tile.
    """
    spark = cells.sparkSession
    texts, path = _texts_of(cells.select("key").distinct(), docs, least, shingle)
    n = F.ceil(F.col("members") / SLICE).cast("int")
    placed = cells.join(texts, "key").select("token", "key", "group", "text", n.alias("n"), F.pmod(F.xxhash64("key"), n).cast("int").alias("own"))
    placed = placed.select("token", "key", "group", "text", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    placed = placed.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("role"), "key", "group", "text")
    dealt = placed.repartition(shuffle_width(spark), F.xxhash64("token", "i", "j")).sortWithinPartitions("token", "i", "j", "role")
    out, _ = saved(dealt.mapInArrow(lambda batches: _tiles(batches, shingle), "a long, b long"))
    discard(spark, path)
    free_shuffles(spark)
    return out


def _bound(a: str, b: str, shared: str = "shared") -> str:
    """SQL for whether sets of sizes ``a`` and ``b`` with that many shared prefix shingles can have a similarity of 0.8.

    Of the set whose prefix ends first in the common order, what lies behind its prefix can be shared on top of these.
    """
    rest = "((4 * {0} + 4) div 5 - 1)"
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b}) and 9 * least({shared} + greatest({rest.format(a)}, {rest.format(b)}), {a}, {b}) >= 4 * ({a} + {b})"


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` (doc_id long, text string).

    Two texts are linked if the Jaccard similarity of their sets of word shingles (by 64-bit hash) is 0.8
    or more; ``component_id`` is the least doc_id that links reach. Equal sets are one from the start. Then:

    1. SimHashes of the sets meet at the anchors of ``simhash.links``; pairs within ``distance`` bits are compared exactly, and groups form.
    2. Of a set's rarest shingles, up to HOMES that most sets hold (CELL at least) are its cells. Sets of a cell that are in different groups are compared there.
    3. Sets that share one of their rarest shingles, but no cell, and are in different groups are compared, unless the number of
       shingles shared there rules out a similarity of 0.8. That misses no link, whatever the first two steps found.

    So a large group of near copies, linked or not, goes to a few cells, a text once to each of their tiles; what is compared there grows with the
    square of a cell's sets, but what is exchanged doesn't up to SLICE of them. Nothing is capped. Wordless texts
    are one group; a row with a null doc_id takes part in links, but never names a group; repeated rows come back repeated. Other columns are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found, found_path = saved(_sets(docs, shingle))
    rows, rows_path = saved(found.select("doc_id", "key"))
    least, least_path = saved(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    sets, sets_path = saved(found.drop("doc_id").dropDuplicates(["key"]))
    discard(spark, found_path)
    free_shuffles(spark)

    # sets of one print, then prints: a pair of each
    prints = sets.groupBy("print").agg(F.min("key").alias("head"))
    near = simhash.links(prints.select("print"), distance)
    heads = prints.select(F.col("print").alias("p"), "head")
    apart = near.join(heads, near.a == heads.p).select("b", F.col("head").alias("x")).join(heads, F.col("b") == heads.p).select("x", F.col("head").alias("y"))
    same = sets.join(prints, "print").where("key <> head").select(F.col("head").alias("x"), F.col("key").alias("y"))
    first, _ = saved(apart.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = _confirmed(first, docs, least, shingle)

    # the rows (token, key, size) whose shingle is in several groups, with their group, and the shingle's sets and largest group
    group = components(links).withColumnRenamed("node", "key")
    placed = sets.join(group, "key", "left").select("key", "size", F.coalesce("component", "key").alias("group"), F.explode("tokens").alias("token"))
    placed = placed.repartition(shuffle_width(spark), "token")
    by_group = placed.groupBy("token", "group").agg(F.count(F.lit(1)).alias("n"))
    several = by_group.groupBy("token").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    open_, path = saved(placed.join(several.select("token", "main", "members").hint("merge"), "token"), compression="zstd")
    discard(spark, sets_path)
    free_shuffles(spark)

    largest = F.slice(F.sort_array(F.collect_list(F.struct("members", "token")), asc=False), 1, HOMES)
    homes, homes_path = saved(open_.where(F.col("members") >= CELL).groupBy("key").agg(F.first("group").alias("group"), largest.alias("homes")))
    cells = homes.select("key", "group", F.inline("homes"))
    mixed = cells.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("token")
    cells, cells_path = saved(cells.join(mixed, "token", "left_semi"))
    links = links.union(_within_cells(cells, docs, least, shingle))
    discard(spark, cells_path)

    # of two sets in different groups, one at least is outside the largest group at their shingle; sets that share a cell have been compared
    rows_of = open_.join(homes.select("key", F.col("homes.token").alias("homes")), "key", "left")
    outside = rows_of.where("group <> main").select("token", F.col("key").alias("a"), F.col("size").alias("a_size"), F.col("group").alias("a_group"), F.col("homes").alias("a_homes"))
    other = rows_of.select("token", F.col("key").alias("b"), F.col("size").alias("b_size"), F.col("group").alias("b_group"), (F.col("group") == F.col("main")).alias("b_main"), F.col("homes").alias("b_homes"))
    fits = "a_group <> b_group and (b_main or a < b) and 5 * least(a_size, b_size) >= 4 * greatest(a_size, b_size) and not coalesce(arrays_overlap(a_homes, b_homes), false)"
    met = outside.hint("merge").join(other, "token").where(fits)
    # two sets can meet either way round, by shingles with different largest groups: sizes go with their sets
    low, high = (F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)) for x, y in (("a_size", "b_size"), ("b_size", "a_size")))
    met = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(low).alias("x"), F.min(high).alias("y"))
    met = met.where(_bound("x", "y")).select("a", "b")
    # what was refused needs no second look
    rest, _ = saved(met.join(first.hint("merge"), ["a", "b"], "left_anti"))
    discard(spark, path, homes_path)
    free_shuffles(spark)
    links = links.union(_confirmed(rest, docs, least, shingle))

    named = least.join(components(links).withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    # the least document of a group: partial minima per task, so that a large group is no hot key of the aggregate
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label, label_path = saved(named.join(lowest, "component").select("key", "component_id"))
    out, _ = saved(rows.join(label, "key").select("doc_id", "component_id"))
    discard(spark, rows_path, least_path, label_path)
    free_shuffles(spark)
    return out


def one_per_group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their group; equal rows and rows without an id as in ``simhash.one_per_group``."""
    return simhash.keep_least(docs, near_duplicates(docs, shingle))
