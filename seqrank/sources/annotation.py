"""GTF and GFF3 readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def attribute(text: str | Column, key: str, fmt: str) -> Column:
    """Value of a key in the attribute column; of repeated keys the last. NULL when absent."""
    column = F.col(text) if isinstance(text, str) else text
    joint = "\\s+" if fmt == "gtf" else "="
    found = F.regexp_extract_all(column, F.lit(f"(?:^|;)\\s*{key}{joint}([^;]*)"), F.lit(1))
    value = F.regexp_replace(F.trim(F.try_element_at(found, F.lit(-1))), '^"+|"+$', "")
    return F.when(value != "", value)


def read_annotation(spark: SparkSession, path: str, fmt: str, exact: bool = False) -> DataFrame:
    """Feature rows with the identifiers and biotype that the region model needs.

    ``exact`` keeps only lines of nine fields; otherwise nine or more are accepted.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    fields = F.size(parts)
    rows = lines.where(~F.col("value").startswith("#")).where((fields == 9) if exact else (fields >= 9))
    attrs = parts[8]
    biotype = F.coalesce(
        *[attribute(attrs, k, fmt) for k in ("transcript_biotype", "gene_biotype", "transcript_type", "gene_type")]
    )
    return rows.select(
        parts[2].alias("feature"),
        parts[3].cast("bigint").alias("start"),
        parts[4].cast("bigint").alias("end"),
        parts[6].alias("strand"),
        attribute(attrs, "transcript_id", fmt).alias("transcript_id"),
        attribute(attrs, "gene_id", fmt).alias("gene_id"),
        attribute(attrs, "ID", fmt).alias("attr_id"),
        attribute(attrs, "Parent", fmt).alias("attr_parent"),
        biotype.alias("biotype"),
        "line_no",
    )
