"""FASTA readers: one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.functions.sequence import AMINO_ACIDS
from seqrank.operators.windows import last_wins


def file_position() -> Column:
    """Where a row stands: its file, the split of the file, and the row in the split; sorts as the files are read."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def _records(spark: SparkSession, path: str, leading_text: bool) -> DataFrame:
    """(header, body, position); a record ends where the next line starts with ``>``.

    With ``leading_text`` text before the first header of a file is dropped; finding it costs a
    pass over the row numbers.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(
        "value", file_position().alias("position"), F.col("_metadata.file_path").alias("_file")
    )
    if leading_text:
        first = rows.groupBy("_file").agg(F.min("position").alias("_first"))
        rows = rows.join(first, "_file").where((F.col("position") != F.col("_first")) | F.col("value").startswith(">"))
    text = F.regexp_replace("value", "^>", "")
    header = F.trim(F.regexp_replace(F.split(text, "\n", 2)[0], "\r$", ""))
    body = F.regexp_replace(F.coalesce(F.try_element_at(F.split(text, "\n", 2), F.lit(2)), F.lit("")), "\\s", "")
    return rows.select(header.alias("header"), body.alias("body"), "position").where(F.col("header") != "")


def read_fasta(spark: SparkSession, path: str, leading_text: bool = False) -> DataFrame:
    """(transcript_id, seq): id is the first word of the header. A compressed file is one task, so its
    rows are dealt out; other files are split as they are read."""
    rows = _records(spark, path, leading_text).select(F.split("header", "\\s+")[0].alias("transcript_id"), F.col("body").alias("seq"))
    packed = any(f.endswith((".gz", ".zst", ".xz")) for f in spark.read.text(path).inputFiles())
    return rows.repartition("transcript_id") if packed else rows


def read_fasta_full(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) with whole headers; letters and ``*`` only; the last repeat of a header wins."""
    rows = _records(spark, path, False)
    clean = F.upper(F.regexp_replace("body", "[^A-Za-z*]", ""))
    return last_wins(rows.select("header", clean.alias("sequence"), "position"), "header", "position")


def read_fasta_protein(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_fasta_full`, with letters outside the amino-acid alphabet written as X."""
    full = read_fasta_full(spark, path)
    return full.withColumn("sequence", F.regexp_replace("sequence", f"[^{AMINO_ACIDS}]", "X"))


def accession_lookup(records: DataFrame) -> DataFrame:
    """(rbp, species, acc, sequence) from headers ``rbp|species|resolved=..|requested=..``; both
    accessions lead to the sequence."""
    first = F.split("header", "\\s+")[0]
    fields = F.split(first, "\\|")
    rest = F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0)))

    def value(name: str):
        hits = F.filter(rest, lambda f: f.startswith(name + "="))
        return F.substring_index(F.try_element_at(hits, F.lit(-1)), name + "=", -1)

    accs = F.array_distinct(F.filter(F.array(value("resolved"), value("requested")), lambda a: a.isNotNull() & (a != "")))
    clean = F.regexp_replace(F.regexp_replace(F.upper("sequence"), "\\*", ""), f"[^{AMINO_ACIDS}]", "X")
    return records.where(F.size(fields) >= 4).select(
        fields[0].alias("rbp"), fields[1].alias("species"), F.explode(accs).alias("acc"), clean.alias("sequence")
    )


def write_fasta(df: DataFrame, path: str, header: str, seq: str) -> None:
    """One record per row."""
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)
