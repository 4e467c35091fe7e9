"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import discard, saved

WINDOW = 10
#: Words of one shard of the index; a longer document is a shard of its own.
SHARD_WORDS = 1 << 16
#: Words of test items that one pass takes to the tasks; more items make more passes.
PASS_WORDS = 1 << 20

# A-Z become a-z; other bytes below 0x80 than digits and letters separate words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class Tests:
    """The windows of one pass, as numbers of terms; what tasks get is bounded by PASS_WORDS."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, items, window: int) -> Tests:
        out = cls()
        for item, text in items:
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                out.windows.setdefault(tuple(ids[at : at + window]), set()).add(item)
        return out


def build_index(docs: DataFrame, tests: Tests) -> tuple[DataFrame, str]:
    """The positional inverted index of all ``docs`` (doc_id, text), a table in the shared folder, and its path.

    A row is a shard of whole documents: ids and word counts of its documents, and for each term of
    the test vocabulary the sorted positions at which it occurs (``counts`` splits ``positions`` by
    term). Positions run on over the shard's documents with a gap between them, so that no window
    reaches over an end. Terms that no test has could never be asked for and have no postings.
    """
    vocabulary = tests.vocabulary

    def shards(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, sizes, found, base = [], [], [], 0

        def shard():
            terms = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
            at = np.flatnonzero(terms >= 0)
            order = np.argsort(terms[at], kind="stable")
            own, counts = np.unique(terms[at], return_counts=True)
            columns = [[(task << 32) + number], [ids], [sizes], [own], [counts.astype(np.int32)], [at[order].astype(np.int32)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(text.as_py())
                if base and base + len(w) > SHARD_WORDS:
                    yield shard()
                    number, base = number + 1, 0
                    ids, sizes, found = [], [], []
                ids.append(doc_id)
                sizes.append(len(w))
                found += [np.fromiter((vocabulary.get(x, -1) for x in w), dtype=np.int32, count=len(w)), np.array([-1], dtype=np.int32)]
                base += len(w) + 1
        if ids:
            yield shard()

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    id_type = pa.int32() if dict(source.dtypes)["doc_id"] == "int" else pa.int64()
    names = ["shard", "doc_ids", "sizes", "terms", "counts", "positions"]
    types = [pa.int64(), pa.list_(id_type), *[pa.list_(pa.int32())] * 4]
    kind = dict(source.dtypes)["doc_id"]
    return saved(source.mapInArrow(shards, f"shard long, doc_ids array<{kind}>, sizes array<int>, terms array<int>, counts array<int>, positions array<int>"))


def _frequencies(index: DataFrame, n: int) -> np.ndarray:
    """How often each test term occurs in all documents; one number a term."""

    def sums(batches):
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            terms, counts = np.asarray(batch.column(0).flatten()), np.asarray(batch.column(1).flatten())
            total += np.bincount(terms, counts, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["term", "n"])

    out = np.zeros(n, dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(sums, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Values of the sorted ``left`` that the sorted ``right`` holds too."""
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    return left[right[at] == left]


def _phrase(postings, terms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Starts of exact occurrences: offset-adjusted lists are intersected from the rarest term on."""
    starts = postings(terms[order[0]]) - order[0]
    for offset in order[1:]:
        starts = _common(starts, postings(terms[offset]) - offset)
        if not len(starts):
            break
    return starts


def _proximity(postings, terms: np.ndarray, order: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Least spans [start, stop) of at most ``most`` words that hold every distinct term."""
    distinct = list(dict.fromkeys(terms[order].tolist()))
    near = postings(distinct[0])
    lists = []
    for t in distinct:  # only occurrences within reach of the rarest term
        p = postings(t)
        at = np.searchsorted(near, p)
        gap = np.minimum(np.abs(near[np.minimum(at, len(near) - 1)] - p), np.abs(near[np.maximum(at - 1, 0)] - p))
        lists.append(p[gap < most])
        if not len(lists[-1]):
            return []
    events = np.unique(np.concatenate(lists))
    last = np.full(len(events), np.iinfo(np.int64).max)
    for p in lists:
        at = np.searchsorted(p, events, side="right") - 1
        last = np.minimum(last, np.where(at >= 0, p[np.maximum(at, 0)], -most - 1))
    good = events - last < most
    spans = list(zip(last[good].tolist(), (events[good] + 1).tolist(), strict=True))
    return [s for k, s in enumerate(spans) if k == 0 or s[0] != spans[k - 1][0]]


def _search(batches, windows: list, items: list, rarity: np.ndarray, slop: int | None):
    """The matches of every document of every shard, also of those without any."""
    full = [np.array(w) for w in windows]
    orders = [np.lexsort((np.arange(len(w)), rarity[w])) for w in full]
    # term pairs of each window that are looked at first: its two rarest
    first = np.array([w[o[0]] for w, o in zip(full, orders, strict=True)], dtype=np.int64)
    second = np.array([w[o[min(1, len(o) - 1)]] for w, o in zip(full, orders, strict=True)], dtype=np.int64)
    entry = pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    for batch in batches:
        for row in range(batch.num_rows):
            ids, sizes, terms, counts, positions = (batch.column(k)[row].values for k in range(1, 6))
            sizes, terms = np.asarray(sizes).astype(np.int64), np.asarray(terms)
            ends, places = np.cumsum(np.asarray(counts).astype(np.int64)), np.asarray(positions).astype(np.int64)
            slot = np.full(len(rarity), -1, dtype=np.int64)
            slot[terms] = np.arange(len(terms))

            def postings(t, slot=slot, ends=ends, places=places):
                s = slot[t]
                return places[ends[s - 1] if s else 0 : ends[s]]

            base = np.concatenate([[0], np.cumsum(sizes + 1)])
            spans: dict[int, dict[str, list]] = {}
            for k in np.flatnonzero((slot[first] >= 0) & (slot[second] >= 0)) if len(full) else ():
                w, order = full[k], orders[k]
                if (slot[w] < 0).any():
                    continue
                if slop is None:
                    found = [(int(s), int(s) + len(w)) for s in _phrase(postings, w, order)]
                else:
                    found = _proximity(postings, w, order, len(w) + slop)
                for start, stop in found:
                    d = int(np.searchsorted(base, start, side="right")) - 1
                    if stop > base[d + 1] - 1:
                        continue  # a proximity span over two documents
                    for item in items[k]:
                        spans.setdefault(d, {}).setdefault(item, []).append((start - int(base[d]), stop - int(base[d])))
            matches = []
            for d in range(len(sizes)):
                own = []
                for item, found in sorted(spans.get(d, {}).items(), key=lambda x: (x[0] is None, x[0])):
                    own += [{"item": item, "start": a, "stop": b} for a, b in _merged(found)]
                matches.append(own)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(0)[row].as_py())), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(sizes), pa.array(matches, pa.list_(entry))], ["shard", "row", "doc_id", "n_words", "matches"]
            )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(doc_id, n_words, matches) of every row of ``docs`` (doc_id, text) for the test ``items`` (item_id, text).

    Windows are ``window`` consecutive words of an item; a shorter item that has words is one window.
    ``matches`` lists, for each item, the stretches of words [start, stop) of the document that
    occurrences of its windows cover. Without ``slop`` these are exact phrases. With it they are
    proximity matches: shortest stretches of at most ``slop`` words more than the window that hold
    all of its distinct words, in any order.

    Test items are a stated query set and go to the tasks in passes of about PASS_WORDS words. Null and empty
    texts have no words; repeated rows come back repeated; a null item_id is matched like others;
    other columns are ignored; without items no row has matches.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // (5 * PASS_WORDS)))
    if passes > 1:
        # every pass must cut the same documents into the same shards: read them from one written table
        docs, _ = saved(docs.select("doc_id", "text"))
    parts = []
    for k in range(passes):
        tests = Tests.of(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).toLocalIterator(), window)
        index, path = build_index(docs, tests)
        rarity = _frequencies(index, len(tests.vocabulary))
        # a window with a term that no document has can't occur
        some = {w: s for w, s in tests.windows.items() if (rarity[list(w)] > 0).all()}
        windows, owners = list(some), [list(s) for s in some.values()]
        send = spark.sparkContext.broadcast((windows, owners, rarity))
        kind = dict(docs.dtypes)["doc_id"]
        found = index.mapInArrow(lambda batches, send=send: _search(batches, *send.value, slop), f"shard long, row int, doc_id {kind}, n_words long, matches array<struct<item:string,start:int,stop:int>>")
        if passes > 1:
            found, _ = saved(found)
            discard(spark, path)
        parts.append(found)
    if passes == 1:
        return parts[0].select("doc_id", "n_words", "matches")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")).select("doc_id", "n_words", "matches")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    ``n_hit`` counts the words inside exact occurrences of windows, ``n_items`` the distinct item_ids
    that have some; the digest is that of those ids, sorted as strings and joined by commas (null ids
    count as one item, and are left out of the joined ids).
    """
    found = find(docs, items, window)
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m.start, m.stop - 1)))))
    names = F.array_distinct(F.transform("matches", lambda m: m.item))
    return found.select(
        "doc_id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(names)), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose doc_id names no document with a test window; rows without an id stay."""
    bad = contamination(docs, items, window).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
