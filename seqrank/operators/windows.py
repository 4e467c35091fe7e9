"""Transcripts, genes and fixed-length windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.functions.sequence import rna
from seqrank.operators.ranking import rank_rows

KEY = ["transcript_id", "window_start", "window_end"]


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the one with the greatest position."""
    rest = [c for c in df.columns if c not in (key, position)]
    packed = F.max_by(F.struct(*rest), F.col(position)).alias("_row")
    return df.groupBy(key).agg(packed).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the least one in the stated order."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def attach_genes(transcripts: DataFrame, gene_map: DataFrame, position: str | None = None) -> DataFrame:
    """Transcripts that have a gene; with ``position`` the last duplicate mapping wins."""
    if position:
        gene_map = last_wins(gene_map, "transcript_id", position)
    return transcripts.join(gene_map.select("transcript_id", "gene_id"), "transcript_id")


def first_transcripts(transcripts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` transcripts by id."""
    return transcripts.orderBy("transcript_id").limit(n)


def tile_starts(length: Column, size: int, stride: int, at_least: int | None = None) -> Column:
    """0-based starts: every stride, plus one window flush with the end."""
    last = length - size
    regular = F.sequence(F.lit(0).cast(INT), F.greatest(last, F.lit(0)), F.lit(stride))
    tiled = F.array_distinct(F.concat(regular, F.array(last)))
    if at_least is None:
        return F.when(length >= size, tiled).otherwise(F.array().cast("array<int>"))
    return (
        F.when(length >= size, tiled)
        .when(length >= at_least, F.array(F.lit(0)))
        .otherwise(F.array().cast("array<int>"))
    )


INT = "int"


#: Windows of a piece of a transcript, and pieces of a larger piece.
TILE_BLOCK = 32


def tile(transcripts: DataFrame, size: int = 200, stride: int = 50, seq: str = "seq") -> DataFrame:
    """Windows with 1-based inclusive ends; transcripts shorter than one window give none.

    Letters of a text are found by walking to them. So a long transcript is cut into large pieces, these into
    pieces of TILE_BLOCK windows, and a window is a short walk in its piece.
    """
    kept, last = [c for c in transcripts.columns if c != seq], F.col("_last")
    rows = transcripts.select(*kept, F.lit(0).alias("_at"), (F.length(seq) - size).alias("_last"), F.col(seq).alias("_piece"))
    reach = last  # of the starts in a piece, the last one
    for span in (stride * TILE_BLOCK**2, stride * TILE_BLOCK):
        pieces = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(reach, F.lit(0)), F.lit(span))).otherwise(F.array().cast("array<int>"))
        text = F.substring(F.col("_piece"), F.col("_p") + 1, F.lit(span + size))
        rows = rows.select("*", F.explode(pieces).alias("_p")).select(*kept, (F.col("_at") + F.col("_p")).alias("_at"), (last - F.col("_p")).alias("_last"), text.alias("_piece"))
        reach = F.least(last, F.lit(span - stride))
    whole = F.sequence(F.lit(0), F.lit(stride * (TILE_BLOCK - 1)), F.lit(stride))
    starts = F.when(last >= stride * TILE_BLOCK, whole).otherwise(tile_starts(last + size, size, stride))
    return rows.select("*", F.explode(starts).alias("_s")).select(
        *kept,
        (F.col("_at") + F.col("_s") + 1).alias("window_start"),
        (F.col("_at") + F.col("_s") + size).alias("window_end"),
        rna(F.substring(F.col("_piece"), F.col("_s") + 1, F.lit(size))).alias("rna_seq"),
    )


def tile_proteins(
    proteins: DataFrame, size: int = 256, stride: int = 64, shortest: int = 128, seq: str = "protein_sequence"
) -> DataFrame:
    """Protein windows plus the full length as window 0."""
    length = F.length(seq)
    cuts = F.transform(
        tile_starts(length, size, stride, shortest),
        lambda s: F.struct((s + 1).alias("start"), F.least(s + size, length).alias("end")),
    )
    whole = F.struct(F.lit(1).alias("start"), length.alias("end"))
    spans = F.array_distinct(F.concat(F.array(whole), cuts))
    kept = [c for c in proteins.columns if c != seq]
    return (
        proteins.where(length > 0)
        .select("*", F.posexplode(spans).alias("window_no", "_w"))
        .select(
            *kept,
            "window_no",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            F.substring(F.col(seq), F.col("_w.start"), F.col("_w.end") - F.col("_w.start") + 1).alias("window_seq"),
        )
    )


def numbered(df: DataFrame, order: list[str], row: str = "row_id") -> DataFrame:
    """Contiguous 0-based row ids in the stated order."""
    first = F.col(order[0])
    kind = dict(df.dtypes)[order[0]]
    # six bytes of a text are a number that doesn't fall along the order of texts
    number = F.conv(F.rpad(F.hex(F.substring(first.cast("binary"), 1, 6)), 12, "0"), 16, 10) if kind == "string" else first
    along = F.coalesce(number.cast("double"), F.lit(float("-inf")))
    return rank_rows(df, [], [F.col(c) for c in order], row, along).withColumn(row, F.col(row) - 1)
