"""K-mer profiles and their statistics per window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.functions.labels import G_PROBES, UC_PROBES
from seqrank.functions.numeric import clamp_finite, finite
from seqrank.functions.sequence import clean_protein, kmer_index, kmer_text, rna
from seqrank.operators.ranking import rank_bounded, top_n
from seqrank.operators.windows import first_wins

PROFILE_BYTES = 256 * 1024 * 1024  # most profile data held by one task at a time


def vocabulary(spark: SparkSession, k: int) -> DataFrame:
    """All 4**k k-mers with their number."""
    return spark.range(4**k).select(F.col("id").alias("kmer_idx"), kmer_text("id", k).alias("kmer"))


def wide_to_long(matrix: DataFrame, kmer: str = "kmer") -> DataFrame:
    """Matrix with one column per profile to (profile_id, kmer, kmer_idx, zscore)."""
    profiles = [c for c in matrix.columns if c != kmer]
    long = matrix.select(rna(F.trim(kmer)).alias("kmer"), *[finite(c).alias(c) for c in profiles])
    return long.unpivot("kmer", profiles, "profile_id", "zscore").withColumn("kmer_idx", kmer_index("kmer"))


def profile_metadata(matrix: DataFrame, metadata: DataFrame, profile: str, sequence: str, position: Column, kmer: str = "kmer", least: int = 30) -> DataFrame:
    """(place, profile_id, protein_sequence, protein_length, other columns of ``metadata``) of the profiles of a wide matrix.

    Of several rows of a profile the first by ``position`` counts; rows of other profiles are left out. Profiles come in the order of the
    matrix's columns: ``place`` counts those that stay, from 0, as proteins of fewer than ``least`` letters are left out.
    A profile without metadata raises.
    """
    names = [c for c in matrix.columns if c != kmer]
    columns = matrix.sparkSession.createDataFrame(list(enumerate(names)), "_column int, profile_id string")
    known = top_n(metadata.withColumn("_position", position), [profile], [F.col("_position")], 1, "_r").drop("_r", "_position").withColumnRenamed(profile, "profile_id")
    # as many rows as the matrix has columns
    rows = F.broadcast(columns).join(known.withColumn("_known", F.lit(True)), "profile_id", "left")
    unknown = F.raise_error(F.concat(F.lit("no metadata for profile "), F.col("profile_id"))).cast("string")
    rows = rows.withColumn("protein_sequence", F.when(F.col("_known"), clean_protein(sequence)).otherwise(unknown))
    rows = rows.withColumn("protein_length", F.coalesce(F.length("protein_sequence"), F.lit(0)))
    kept = rank_bounded(rows.where(F.col("protein_length") >= least), [], [F.col("_column")], "place")
    others = [c for c in kept.columns if c not in ("place", "profile_id", "protein_sequence", "protein_length", "_column", "_known", sequence)]
    return kept.select((F.col("place") - 1).alias("place"), "profile_id", "protein_sequence", "protein_length", *others)


def placed_profiles(matrix: DataFrame, metadata: DataFrame, kmer: str = "kmer") -> DataFrame:
    """(place, profile_id, kmer_place, kmer, zscore, is_finite): the kept profiles of a wide matrix, in one pass over it.

    The unpivot carries each column's place; ``metadata`` (place, profile_id) is joined on the profile. ``kmer_place`` is the row's own ``row`` if the
    matrix has that column, else its k-mer's number. Scores that are missing or not finite become 0, with ``is_finite`` false.
    """
    names = [c for c in matrix.columns if c not in (kmer, "row")]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("profile_id"), F.col(c).cast("double").alias("z")) for c in names]))
    word = rna(F.trim(kmer))
    place = F.col("row") if "row" in matrix.columns else kmer_index(word)
    long = matrix.select(place.alias("kmer_place"), word.alias("kmer"), cells.alias("_c")).select("kmer_place", "kmer", "_c.*")
    # as many rows as the matrix has columns
    kept = long.join(F.broadcast(metadata.select("place", "profile_id")), "profile_id")
    return kept.select("place", "profile_id", "kmer_place", "kmer", F.coalesce(finite("z"), F.lit(0.0)).alias("zscore"), finite("z").isNotNull().alias("is_finite"))


def long_to_wide(profiles: DataFrame, ids: Sequence[str], id_column: str = "profile_id") -> DataFrame:
    """One row per k-mer and one column per named profile."""
    return profiles.groupBy("kmer").pivot(id_column, list(ids)).agg(F.first("zscore"))


def finite_mask(profiles: DataFrame, limit: float | None = None) -> DataFrame:
    """Adds ``is_finite`` and ``zscore_filled``; see :func:`clamp_finite` for the fill."""
    return profiles.withColumn("is_finite", finite("zscore").isNotNull()).withColumn(
        "zscore_filled", clamp_finite("zscore", limit)
    )


def align_profile(vocab: DataFrame, override: DataFrame, limit: float = 10.0) -> DataFrame:
    """Override scores in vocabulary order; the first duplicate counts and gaps become 0.

    ``override`` has kmer, zscore and a row position ``pos``. Fails when nothing overlaps.
    """
    override = first_wins(
        override.select(rna(F.trim("kmer")).alias("kmer"), "zscore", "pos"), ["kmer"], "pos"
    ).drop("pos")
    joined = vocab.join(override, "kmer", "left")
    shared = vocab.join(override, "kmer", "left_semi").agg(F.count(F.lit(1)))
    ok = F.when(shared.scalar() > 0, F.lit(True)).otherwise(
        F.raise_error(F.lit("the override profile shares no k-mer with the vocabulary")).cast("boolean")
    )
    return joined.where(ok).select("kmer_idx", "kmer", clamp_finite("zscore", limit).alias("zscore"))


def realign(profile: DataFrame, vocab: DataFrame) -> DataFrame:
    """Same scores under another k-mer numbering."""
    return profile.drop("kmer_idx").join(vocab, "kmer").select("kmer_idx", "kmer", "zscore")


def extremes(profiles: DataFrame, key: str = "rbp_id", n: int = 25) -> DataFrame:
    """Top and bottom ``n`` k-mers per profile with direction and rank."""
    tie = F.col("kmer")
    up = top_n(profiles, [key], [F.col("zscore").desc_nulls_last(), tie], n, "rank")
    down = top_n(profiles, [key], [F.col("zscore").asc_nulls_last(), tie], n, "rank")
    return up.withColumn("direction", F.lit("positive")).unionByName(
        down.withColumn("direction", F.lit("negative"))
    )


def joined_top(ranked: DataFrame, key: str = "rbp_id", n: int = 10) -> DataFrame:
    """First ``n`` k-mers per (key, direction) as one comma-joined text."""
    rows = F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "kmer"))))
    return ranked.groupBy(key, "direction").agg(
        F.array_join(F.transform(rows, lambda r: r["kmer"]), ",").alias("top_kmers")
    )


def conflict_targets(profiles: DataFrame, key: str, uc_threshold: float, g_threshold: float) -> DataFrame:
    """Best UC-repeat and G-rich probe score per profile, thresholded, and their conjunction."""
    best = (
        profiles.where(F.col("kmer").isin(UC_PROBES + G_PROBES))
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("kmer").isin(UC_PROBES), F.col("zscore"))).alias("uc_score"),
            F.max(F.when(F.col("kmer").isin(G_PROBES), F.col("zscore"))).alias("g_score"),
        )
    )
    uc = F.when(F.col("uc_score") >= uc_threshold, 1).otherwise(0)
    g = F.when(F.col("g_score") >= g_threshold, 1).otherwise(0)
    return best.select(
        key, "uc_score", "g_score", uc.alias("uc_target"), g.alias("g_target"), (uc * g).alias("conflict_target")
    )


def rich_u_kmers(top: DataFrame, n: int = 20) -> DataFrame:
    """Well-scored U/C-rich positive k-mers, or the first ``n`` positives when there are none."""
    text = rna("kmer")
    length = F.greatest(F.length(text), F.lit(1))

    def part(letters: str):
        return (F.length(text) - F.length(F.translate(text, letters, ""))) / length

    positive = top.where(F.col("direction") == "positive").select(
        text.alias("kmer"), "zscore", "rank", ((part("UC") >= 0.71) & (part("U") >= 0.43)).alias("rich")
    )
    order = [F.col("zscore").desc_nulls_last(), F.col("rank"), F.col("kmer")]
    # the source list is itself a top list, so it has a small fixed size
    best = positive.orderBy(*order).limit(n).withColumn("_group", F.lit(1))
    rich = positive.where("rich").withColumn("_group", F.lit(0))
    pool = rich.unionByName(best)
    chosen = pool.where(F.col("_group") == pool.agg(F.min("_group")).scalar())
    once = chosen.groupBy("kmer").agg(F.max("zscore").alias("zscore"), F.min("rank").alias("rank"))
    return once.orderBy(*order).limit(n).select("kmer")


def _kmer_numbers(texts: pa.Array, k: int) -> np.ndarray:
    """Base-4 numbers of all k-mers, one row per text; 4**k marks foreign letters and padding."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    if (pc.binary_length(texts).to_numpy(zero_copy_only=False) != lengths).any():
        texts = pc.replace_substring_regex(texts, "[^\\x00-\\x7F]", "?")
    width = max(int(lengths.max()) if len(lengths) else 0, k)
    if (lengths != width).any():
        texts = pc.utf8_rpad(texts, width=width, padding="N")
    first = int(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset])
    flat = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first : first + width * len(texts)]
    codes = np.full(256, 4, dtype=np.int32 if k <= 14 else np.int64)
    codes[np.frombuffer(b"ACGUT", dtype=np.uint8)] = [0, 1, 2, 3, 3]
    grid = codes[flat].reshape(len(texts), width)
    spots = width - k + 1
    number = np.zeros((len(texts), spots), dtype=grid.dtype)
    foreign = np.zeros((len(texts), spots), dtype=bool)
    other = grid == 4
    for j in range(k):
        number *= 4
        number += grid[:, j : j + spots]
        foreign |= other[:, j : j + spots]
    number[foreign] = 4**k
    return number.astype(np.intp)


def window_statistics(numbers: np.ndarray, scores: np.ndarray, top: int) -> dict[str, np.ndarray]:
    """Max, mean of the best ``top``, mean, positive share and count of the scored k-mers."""
    z = scores[numbers]
    known = ~np.isnan(z)
    n = np.count_nonzero(known, axis=1)
    low = np.where(known, z, -np.inf)
    take = min(top, z.shape[1])
    best = np.partition(low, z.shape[1] - take, axis=1)[:, z.shape[1] - take :]
    usable = np.isfinite(best)
    with np.errstate(invalid="ignore", divide="ignore"):
        found = {
            "motif_match_max_zscore": best.max(axis=1),
            "motif_match_top_mean_zscore": np.where(usable, best, 0.0).sum(axis=1) / usable.sum(axis=1),
            "motif_match_mean_zscore": np.where(known, z, 0.0).sum(axis=1) / n,
            "motif_positive_fraction": np.count_nonzero(low > 0, axis=1) / n,
        }
    out = {name: np.where(n == 0, np.nan, x) for name, x in found.items()}
    return {**out, "motif_scanned_kmer_count": n.astype("int32")}


STATISTICS = (
    "motif_match_max_zscore double, motif_match_top_mean_zscore double, motif_match_mean_zscore double, "
    "motif_positive_fraction double, motif_scanned_kmer_count int"
)


def scan_windows(
    windows: DataFrame, profiles: DataFrame, k: int = 7, top: int = 3, key: str = "rbp_id", keep: Sequence[str] | None = None
) -> DataFrame:
    """K-mer score statistics of every window under every profile, with the columns ``keep`` of the window (all).

    ``windows`` needs rna_seq; ``profiles`` is (key, kmer_idx, zscore). A profile holds at most
    4**k numbers, so profiles are shipped to the tasks in blocks of bounded size and the windows
    never move. When ``windows`` already has the key column, each row meets its own profile only.
    """
    spark = windows.sparkSession
    vocab = 4**k
    ids = sorted(r[0] for r in profiles.select(key).distinct().collect())
    per_block = max(1, PROFILE_BYTES // (8 * (vocab + 1)))
    own = key in windows.columns
    extra = "" if own else f", {key} string"
    kept = [c for c in windows.columns if keep is None or c in keep or c == key]
    schema = ", ".join(f"`{n}` {t}" for n, t in windows.dtypes if n in kept) + extra + ", " + STATISTICS
    blocks = []
    for at in range(0, len(ids), per_block):
        block = ids[at : at + per_block]
        rows = profiles.where(F.col(key).isin(block)).select(key, "kmer_idx", finite("zscore").alias("z"))
        found = rows.where(F.col("kmer_idx").isNotNull()).toPandas()
        table = np.full((len(block), vocab + 1), np.nan)
        table[found[key].map({b: i for i, b in enumerate(block)}), found["kmer_idx"].astype("int64")] = found["z"]
        shipped = spark.sparkContext.broadcast(table)

        def scan(batches: Iterator[pa.RecordBatch], block=tuple(block), shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                numbers = _kmer_numbers(batch.column("rna_seq"), k)
                rows = batch.select(kept)
                for i, name in enumerate(block):
                    mine, nums, named = rows, numbers, {}
                    if own:
                        at = np.flatnonzero(pc.equal(batch.column(key), name).fill_null(False).to_numpy(zero_copy_only=False))
                        if not len(at):
                            continue
                        mine, nums = rows.take(pa.array(at)), numbers[at]
                    else:
                        named = {key: pa.array([name]).take(pa.array(np.zeros(rows.num_rows, dtype=np.int32)))}
                    added = {**named, **{c: pa.array(x) for c, x in window_statistics(nums, shipped.value[i], top).items()}}
                    yield pa.RecordBatch.from_arrays([*mine.columns, *added.values()], [*kept, *added])

        part = windows.where(F.col(key).isin(block)) if own else windows
        blocks.append(part.mapInArrow(scan, schema))
    if not blocks:
        raise ValueError("no motif profile given")
    out = blocks[0]
    for other in blocks[1:]:
        out = out.unionByName(other)
    scored = [part.split()[0] for part in STATISTICS.split(", ")][:4]
    return out.withColumns({n: finite(n) for n in scored})
