"""Data-quality audits. Each returns rows of counts or the offending keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.functions.numeric import finite
from seqrank.functions.sequence import fingerprint_text
from seqrank.operators.ranking import rank_rows, text_number, top_n
from seqrank.session import durable


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def structure_check(windows: DataFrame, pairing: DataFrame, width: int) -> DataFrame:
    """Row counts of both tables and how many vectors or sequences have another length."""
    w = windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(F.length("rna_seq") != width).alias("bad_sequence_length")
    )
    p = pairing.agg(F.count(F.lit(1)).alias("n_pairing"), F.count_if(F.size("paired") != width).alias("bad_vector_width"))
    both = w.select("*", *[p.select(c).scalar().alias(c) for c in ("n_pairing", "bad_vector_width")])
    return both.withColumn("rows_match", F.col("n_windows") == F.col("n_pairing"))


def fingerprint(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free digest of keyed, normalised sequences: count, XOR and sum of row hashes."""
    row = F.xxhash64(F.sha2(F.concat_ws("\n", *[F.col(k).cast("string") for k in keys], fingerprint_text("rna_seq")), 256))
    return windows.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("digest_xor"), F.sum(F.pmod("h", F.lit(1000003))).alias("digest_sum")
    )


#: Rows of a block of the ordered digest, and block digests of a digest of the next level.
DIGEST_ROWS = 1000


def ordered_digest(rows: DataFrame, order: Sequence[str], text: Column, along: Column, width: int = DIGEST_ROWS) -> DataFrame:
    """(n_rows, digest): one sha-256 for the rows' texts in their order, the same for any number of tasks.

    Rows are numbered along ``order`` (``along`` as in :func:`rank_rows`); each block of ``width`` numbers has the digest of its rows'
    digests in order, and so on with the blocks until one is left. ``order`` must be total. Without rows, the digest is that of nothing.
    """
    at, joined = F.col("_at"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: F.lower(F.hex(x["_d"]))))
    # numbering reads the rows several times: they are a stored table of digests
    brief = durable(rows.select(*order, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_d"), along.alias("_along")))
    numbered = rank_rows(brief, [], [F.col(c) for c in order], "_at", F.col("_along"))
    level = numbered.select((at - 1).alias("_at"), "_d")
    n = size = brief.count()
    while True:
        level = level.groupBy(F.floor(at / width).alias("_at")).agg(F.unhex(F.sha2(joined, 256)).alias("_d"))
        size = -(-size // width)
        if size <= 1:
            break
    nothing = F.sha2(F.lit(""), 256)
    return level.agg(F.lit(n).cast("bigint").alias("n_rows"), F.coalesce(F.lower(F.hex(F.max("_d"))), nothing).alias("digest"))


def window_digest(windows: DataFrame) -> DataFrame:
    """The ordered digest of normalised window sequences by transcript and start."""
    return ordered_digest(windows, ["transcript_id", "window_start"], fingerprint_text("rna_seq"), text_number("transcript_id"))


def pair_by_position(windows: DataFrame, vectors: DataFrame, digest: str | None = None) -> DataFrame:
    """Windows with the vector at their row number; ``vectors`` has (position from 0, paired).

    A stored array of vectors carries no keys, so a changed row order would pair wrongly unseen: with the ``digest`` kept when it
    was made (:func:`window_digest`), another order or another sequence raises. So does another number of rows, or a position that is missing or doubled.
    """
    n, found = windows.count(), vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi")).first()
    if found.n != n or found.d != n or (n and (found.lo, found.hi) != (0, n - 1)):
        raise ValueError(f"{n} windows, but {found.n} vectors at {found.d} positions")
    if digest is not None and window_digest(windows).first().digest != digest:
        raise ValueError("the windows are not in the order of the vectors")
    numbered = rank_rows(windows.withColumn("_along", text_number("transcript_id")), [], [F.col("transcript_id"), F.col("window_start")], "_row", F.col("_along"))
    return numbered.withColumn("position", F.col("_row") - 1).drop("_row", "_along").join(vectors.select("position", "paired"), "position").drop("position")


def fingerprint_parts(windows: DataFrame, key: str) -> DataFrame:
    """Digest per key that any SQL engine can repeat: count and smallest and largest sha-256."""
    d = F.sha2(fingerprint_text("rna_seq"), 256)
    return windows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(d).alias("least_digest"), F.max(d).alias("greatest_digest")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and surplus rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicated_keys"),
    )


def duplicate_sequences(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surplus rows of equal key and equal sequence."""
    hashed = windows.withColumn("_h", F.sha1("rna_seq"))
    return duplicate_keys(hashed, [*keys, "_h"])


def match_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left table with and without a partner."""
    a = left.select(*keys).distinct()
    b = right.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return a.join(b, list(keys), "left").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count("_hit").alias("matched_keys"),
        F.count_if(F.col("_hit").isNull()).alias("missing_keys"),
    )


def missing_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Ids of the left table that the right one lacks."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def vocabulary_check(kmers: DataFrame, column: str = "kmer") -> DataFrame:
    """How many k-mers are not upper case, contain T, or hold foreign letters; and their lengths."""
    k = F.col(column)
    return kmers.agg(
        F.count(F.lit(1)).alias("n_kmers"),
        F.count_if(k != F.upper(k)).alias("n_lower"),
        F.count_if(F.upper(k).contains("T")).alias("n_with_t"),
        F.count_if(~F.upper(k).rlike("^[ACGU]*$")).alias("n_foreign"),
        F.min(F.length(k)).alias("shortest"),
        F.max(F.length(k)).alias("longest"),
    )


def coordinate_base(windows: DataFrame) -> DataFrame:
    """Smallest start and whether positions look 1-based."""
    return windows.agg(F.min("window_start").alias("min_start"), F.max("window_end").alias("max_end")).withColumn(
        "looks_one_based", F.col("min_start") == 1
    )


def offset_match(keys: DataFrame, windows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Matches of validation keys as given and with start + 1; the better offset is reported.

    Both sides are reduced to distinct keys first; each key asks for its two starts in one join.
    """
    groups = list(groups)
    key = ["transcript_id", "window_start"]
    asked = keys.groupBy(*groups, *key).agg(F.count(F.lit(1)).alias("_n"))
    tries = asked.select(*groups, *key, "_n", F.explode(F.array(F.lit(0), F.lit(1))).alias("_off"))
    tries = tries.withColumn("_at", F.col("window_start") + F.col("_off"))
    have = windows.select("transcript_id", F.col("window_start").alias("_at")).distinct().withColumn("_hit", F.lit(1))
    found = tries.join(have, ["transcript_id", "_at"], "left")
    out = found.groupBy(*groups).agg(
        F.count_if(F.col("_off") == 0).alias("n_keys"),
        F.sum(F.when(F.col("_off") == 0, F.col("_n") - 1).otherwise(0)).alias("duplicate_rows"),
        F.count_if((F.col("_off") == 0) & F.col("_hit").isNotNull()).alias("direct_matches"),
        F.count_if((F.col("_off") == 1) & F.col("_hit").isNotNull()).alias("plus_one_matches"),
    )
    best = F.greatest("direct_matches", "plus_one_matches")
    return out.withColumns(
        {
            "chosen_offset": F.when(F.col("plus_one_matches") > F.col("direct_matches"), 1).otherwise(0),
            "match_rate": F.try_divide(best.cast("double"), F.col("n_keys").cast("double")),
            "unmatched_keys": F.col("n_keys") - best,
        }
    )


def index_alignment(index: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows of an index whose (embedding_row, protein_id) the other index contradicts, with issues."""
    by_row = embeddings.select("embedding_row", F.col("protein_id").alias("_id_at_row"))
    by_id = embeddings.groupBy("protein_id").agg(F.min("embedding_row").alias("_row_of_id"))
    joined = index.join(by_row, "embedding_row", "left").join(by_id, "protein_id", "left")
    issue = F.concat_ws(
        ";",
        F.when(F.col("_id_at_row").isNull(), "row_missing"),
        F.when(F.col("_id_at_row") != F.col("protein_id"), "other_protein_at_row"),
        F.when(F.col("_row_of_id").isNull(), "protein_missing"),
        F.when(F.col("_row_of_id") != F.col("embedding_row"), "other_row_for_protein"),
    )
    return joined.withColumn("issue", issue).where(F.col("issue") != "").drop("_id_at_row", "_row_of_id")


def row_id_check(df: DataFrame, row: str) -> DataFrame:
    """Whether row ids are unique and run from 0 to n - 1."""
    counts = df.groupBy(row).agg(F.count(F.lit(1)).alias("_n"))
    out = counts.agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_ids"),
        F.min(row).alias("least_id"),
        F.max(row).alias("greatest_id"),
    )
    unique = F.col("n_rows") == F.col("n_ids")
    return out.withColumns(
        {
            "is_unique": unique,
            "is_contiguous": unique & (F.col("least_id") == 0) & (F.col("greatest_id") == F.col("n_rows") - 1),
        }
    )


def usage_counts(rows: DataFrame, row: str, split: str, splits: Sequence[str], size: int) -> DataFrame:
    """Uses of each embedding row per split and whether the row is out of range."""
    out = rows.groupBy(row).pivot(split, list(splits)).count().na.fill(0, list(splits))
    return out.withColumn("out_of_range", (F.col(row) < 0) | (F.col(row) >= size))


def finite_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and non-finite values per column."""
    bad = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).isNull().cast("bigint").alias("nulls"),
                (F.col(c).isNotNull() & finite(c).isNull()).cast("bigint").alias("non_finite"),
            )
            for c in columns
        ]
    )
    return df.select(F.inline(bad)).groupBy("column").agg(F.sum("nulls").alias("nulls"), F.sum("non_finite").alias("non_finite"))


def probe_ranks(probes: DataFrame, top: DataFrame, key: str = "rbp_id") -> DataFrame:
    """Direction and rank of known probes in a top list; typed NULLs when they are not listed.

    Directions are ordered as text, so a negative entry comes before a positive one.
    """
    joined = probes.join(top.select(key, "kmer", "direction", "rank", "zscore"), [key, "kmer"], "left")
    return top_n(joined, [key, "kmer"], [F.col("direction").asc_nulls_last(), F.col("rank")], 1, "_r").drop("_r")


def exactly_one(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key; fails when a key has none or several (none: a key with NULL payload)."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    good = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("expected one row for "), F.col(key).cast("string"))).cast("boolean")
    )
    return rows.join(counts.where(good).select(key), key)


def first_known(tables: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Per key and column the first non-empty value in the order of the tables."""
    stacked = None
    for i, t in enumerate(tables):
        part = t.select(key, *[(F.col(c) if c in t.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        part = part.withColumn("_p", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)

    def pick(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_p", c)))

    return stacked.groupBy(key).agg(*[pick(c).alias(c) for c in columns])


def last_source(tables: Sequence[DataFrame], key: str, value: str, keep: DataFrame | None = None) -> DataFrame:
    """Union in which the last table wins per key, limited to the keys of ``keep``."""
    stacked = None
    for i, t in enumerate(tables):
        part = t.select(key, value).withColumn("_p", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)
    out = stacked.groupBy(key).agg(F.max_by(value, "_p").alias(value))
    return out if keep is None else out.join(keep.select(key).distinct(), key, "left_semi")


def sequence_coverage(index: DataFrame, sequences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index rows with their sequence and a found flag."""
    return index.join(sequences, list(keys), "left").withColumn("sequence_found", F.col("protein_sequence").isNotNull())
