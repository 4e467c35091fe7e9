"""Delimited tables, truth lists, structure metadata, and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqrank.functions.numeric import finite
from seqrank.operators.audit import require_columns

# Accepted names of the gene column, in order of preference.
TRUTH_COLUMNS = ["gene_id", "target_gene_id", "truth_gene_id", "gene"]
SCORE_PREFERENCE = ["ranking_score", "max_score", "top3_mean_score", "top5_mean_score", "window_count_adjusted_score"]


def read_table(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = (),
    schema: StructType | str | None = None,
    columns: Sequence[str] | None = None,
    sep: str = "\t",
) -> DataFrame:
    """Delimited text with a header (also gzip), checked for required columns and cut to
    ``columns``. NaN and infinite numbers become NULL."""
    reader = spark.read.option("sep", sep).option("header", True).option("nanValue", "NaN").option("nullValue", "")
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = require_columns(df, [*required, *(columns or [])])
    if columns:
        df = df.select(*columns)
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(c) for c in numbers}) if numbers else df


def read_any(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Delimited text whose separator is taken from the first line."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    sep = max("\t,;", key=line.count)
    return read_table(spark, path, required, sep=sep if sep in line else "\t")


def read_truth(df: DataFrame, strict: bool = False, first_column: bool = False) -> DataFrame:
    """Distinct gene ids from a truth table.

    The first known gene column is used, else the only column; ``strict`` insists on gene_id and
    ``first_column`` falls back to the first column.
    """
    known = [c for c in (["gene_id"] if strict else TRUTH_COLUMNS) if c in df.columns]
    if known:
        name = known[0]
    elif not strict and (first_column or len(df.columns) == 1):
        name = df.columns[0]
    else:
        raise ValueError(f"no gene column among {df.columns}")
    return df.select(F.col(name).cast("string").alias("gene_id")).dropna().distinct()


def ranking_column(df: DataFrame, wanted: str | None = None, preference: Sequence[str] = SCORE_PREFERENCE) -> str:
    """The wanted score column if the table has it, else the first that it has."""
    for name in [wanted, *preference] if wanted else preference:
        if name in df.columns:
            return name
    raise ValueError("no ranking score column")


def query_ids(spark: SparkSession, text: str, known: DataFrame | None = None, column: str = "protein_id") -> DataFrame:
    """Comma-separated ids in order, trimmed and without repeats; fails on ids not in ``known``."""
    ids = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, {column} string")
    if known is not None:
        gone = [r[0] for r in df.join(known.select(column), column, "left_anti").select(column).collect()]
        if gone:
            raise ValueError(f"unknown ids: {', '.join(sorted(gone))}")
    return df


def embeddings(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index rows with the vector stored under their embedding_row."""
    return index.join(vectors.select("embedding_row", "embedding"), "embedding_row")


def read_structure_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def check_structure(meta: DataFrame, windows: DataFrame, pairing: DataFrame) -> DataFrame:
    """Row counts and widths of windows and vectors beside the metadata, with one verdict."""
    w = windows.agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.length("rna_seq")).alias("longest"))
    p = pairing.agg(
        F.count(F.lit(1)).alias("n_pairing"), F.min(F.size("paired")).alias("narrowest"), F.max(F.size("paired")).alias("widest")
    )
    out = meta.select("n_rows", "rna_len", *[w.select(c).scalar().alias(c) for c in ("n_windows", "longest")])
    out = out.select("*", *[p.select(c).scalar().alias(c) for c in ("n_pairing", "narrowest", "widest")])
    rows = (F.col("n_rows") == F.col("n_windows")) & (F.col("n_rows") == F.col("n_pairing"))
    width = (F.col("narrowest") == F.col("rna_len")) & (F.col("widest") == F.col("rna_len"))
    return out.withColumn("consistent", rows & width & (F.col("longest") <= F.col("rna_len")))


def external_proteins(records: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Proteins chosen by header pattern: ``rules`` maps protein id to a regular expression."""
    label = F
    for protein, pattern in rules.items():
        label = label.when(F.col("header").rlike(pattern), protein)
    return records.withColumn("protein_id", label.otherwise(None)).dropna(subset=["protein_id"])


def protein_list(indexed: DataFrame, external: DataFrame) -> DataFrame:
    """Both lists with their source; fails when a sequence is missing."""
    both = indexed.select("protein_id", "sequence", F.lit("index").alias("source")).unionByName(
        external.select("protein_id", "sequence", F.lit("external").alias("source"))
    )
    checked = F.when(F.length("sequence") > 0, F.col("sequence")).otherwise(
        F.raise_error(F.concat(F.lit("no sequence for "), F.col("protein_id")))
    )
    return both.withColumn("sequence", checked)


def write_table(df: DataFrame, path: str, compressed: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Tab-separated files with a header; one folder per value of ``partition_by``."""
    writer = df.write.option("sep", "\t").option("header", True)
    if compressed:
        writer = writer.option("compression", "gzip")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_rankings(long: DataFrame, path: str) -> None:
    """Ranked genes of every ranking in one partitioned table."""
    long.write.partitionBy("ranking_name").parquet(path)


def write_gene_lists(ranked: DataFrame, path: str, ks: Sequence[int] = (200, 500, 1000)) -> None:
    """Headerless gene lists per protein and K; files are ordered by rank."""
    wanted = F.filter(F.array(*[F.lit(int(k)) for k in ks]), lambda k: F.col("rank") <= k)
    rows = ranked.where(F.col("rank") <= max(ks)).select(
        F.regexp_replace("rbp_id", "/", "_").alias("rbp_id"), "gene_id", "rank", F.explode(wanted).alias("top_k")
    )
    rows = rows.repartition("rbp_id", "top_k").sortWithinPartitions("rbp_id", "top_k", "rank")
    rows.select("gene_id", "rbp_id", "top_k").write.partitionBy("rbp_id", "top_k").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small report rows as JSON lines."""
    df.write.json(path)


def report_rows(df: DataFrame, section: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Headline figures as (section, metric, group, value) rows."""
    group = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(F.lit(section).alias("section"), group.alias("group"), F.inline(pairs)).select("section", "metric", "group", "value")
