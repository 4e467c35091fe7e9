"""Annotation: gene maps, transcript coordinates of features, and the region of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.operators.ranking import running_totals
from seqrank.operators.windows import last_wins

# Feature names of the annotation formats.
RNA_FEATURES = ["mRNA", "transcript", "lnc_RNA", "ncRNA", "tRNA", "rRNA", "miRNA", "snoRNA", "snRNA"]
FIVE_PRIME = ["five_prime_utr", "5utr", "utr5"]
THREE_PRIME = ["three_prime_utr", "3utr", "utr3"]
LABELS = ["CDS", "5UTR", "3UTR"]  # also the order in which ties are resolved


def gene_map(annotation: DataFrame, fmt: str) -> DataFrame:
    """(transcript_id, gene_id) pairs; of repeated transcripts the last line counts.

    ``annotation`` comes from :func:`seqrank.sources.annotation.read_annotation`.
    """
    if fmt == "gtf":
        rows = annotation.where(F.col("feature") == "transcript")
        tx, gene = F.col("transcript_id"), F.col("gene_id")
    else:
        rows = annotation.where(F.col("feature").isin(RNA_FEATURES))
        tx = F.regexp_replace(F.coalesce("transcript_id", "attr_id"), "^transcript:", "")
        gene = F.regexp_replace(F.coalesce("gene_id", "attr_parent"), "^gene:", "")
    pairs = rows.select(tx.alias("transcript_id"), gene.alias("gene_id"), "line_no")
    pairs = pairs.where((F.col("transcript_id") != "") & (F.col("gene_id") != ""))
    return last_wins(pairs, "transcript_id", "line_no")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int) -> DataFrame:
    """Pairs with equal ``on`` whose [start, end] and [other_start, other_end] overlap.

    Both sides are cut into bins of ``width`` so that the join is an equality join on (on, bin)
    and a crowded key only meets its own neighbourhood; a pair is kept in the bin where the later
    of its two starts lies, hence once.
    """
    a = left.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    b = right.withColumn("_bin", F.explode(_bins(F.col("other_start"), F.col("other_end"), width)))
    first = F.greatest("start", "other_start")
    meets = (first <= F.least("end", "other_end")) & (F.floor(first / width) == F.col("_bin"))
    return a.join(b, [*on, "_bin"]).where(meets).drop("_bin")


def transcript_exons(annotation: DataFrame) -> DataFrame:
    """Exons with the transcript position of their first base and the running length."""
    exons = annotation.where(F.lower("feature") == "exon").select("transcript_id", "start", "end", "strand")
    exons = exons.withColumn("_len", F.col("end") - F.col("start") + 1).withColumn(
        "_dir", F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    )
    exons = running_totals(exons, ["transcript_id"], [F.col("_dir"), F.col("end")], {"_upto": "_len"})
    return exons.select(
        "transcript_id", "start", "end", "strand", "_upto", (F.col("_upto") - F.col("_len") + 1).alias("tx_start")
    )


def project_features(annotation: DataFrame, exons: DataFrame, width: int = 4096) -> DataFrame:
    """Coding and untranslated parts in transcript coordinates: (transcript_id, label, seg_start, seg_end)."""
    low = F.lower("feature")
    label = (
        F.when(low == "cds", "CDS").when(low.isin(FIVE_PRIME), "5UTR").when(low.isin(THREE_PRIME), "3UTR")
    )
    feats = annotation.withColumn("label", label).where(F.col("label").isNotNull())
    feats = feats.select("transcript_id", "label", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    pairs = overlap_join(exons, feats, ["transcript_id"], width)
    lo, hi = F.greatest("start", "other_start"), F.least("end", "other_end")
    minus = F.col("strand") == "-"
    begin = F.col("tx_start") + F.when(minus, F.col("end") - hi).otherwise(lo - F.col("start"))
    return pairs.select("transcript_id", "label", begin.alias("seg_start"), (begin + hi - lo).alias("seg_end"))


def infer_utrs(segments: DataFrame, exons: DataFrame, mark: bool = False) -> DataFrame:
    """Segments plus UTRs around the coding part where a transcript lists none of that kind.

    With ``mark`` a column ``inferred`` tells the added ones.
    """
    length = exons.groupBy("transcript_id").agg(F.max("_upto").alias("_length"))
    coding = F.col("label") == "CDS"
    bounds = segments.groupBy("transcript_id").agg(
        F.min(F.when(coding, F.col("seg_start"))).alias("_lo"),
        F.max(F.when(coding, F.col("seg_end"))).alias("_hi"),
        F.count_if(F.col("label") == "5UTR").alias("_n5"),
        F.count_if(F.col("label") == "3UTR").alias("_n3"),
    )
    bounds = bounds.where(F.col("_lo").isNotNull()).join(length, "transcript_id")

    def part(label: str, lo: Column, hi: Column, n: Column) -> DataFrame:
        return bounds.where((n == 0) & (lo <= hi)).select(
            "transcript_id", F.lit(label).alias("label"), lo.cast("bigint").alias("seg_start"), hi.cast("bigint").alias("seg_end")
        )

    five = part("5UTR", F.lit(1), F.col("_lo") - 1, F.col("_n5"))
    three = part("3UTR", F.col("_hi") + 1, F.col("_length"), F.col("_n3"))
    if not mark:
        return segments.unionByName(five).unionByName(three)
    return segments.withColumn("inferred", F.lit(False)).unionByName(five.unionByName(three).withColumn("inferred", F.lit(True)))


def transcript_info(annotation: DataFrame) -> DataFrame:
    """Biotype and whether a coding part is listed, for every annotated transcript."""
    return annotation.groupBy("transcript_id").agg(
        F.min("biotype").alias("biotype"), F.max((F.lower("feature") == "cds").cast("int")).alias("has_cds")
    )


def window_regions(
    windows: DataFrame, segments: DataFrame, info: DataFrame, out: str = "region_type", inferred: str | None = None, width: int = 512
) -> DataFrame:
    """Label with the most overlapped bases per window, else ncRNA or unknown.

    ``windows`` has one row per (transcript_id, window_start, window_end) key after deduplication
    here; the label is joined back to all rows. With a column name in ``inferred``, segments marked by
    :func:`infer_utrs` count for that label only, and one join serves both.
    """
    key = ["transcript_id", "window_start", "window_end"]
    spans = windows.select(*key).distinct()
    a = spans.withColumns({"start": F.col("window_start"), "end": F.col("window_end")})
    b = segments.withColumnsRenamed({"seg_start": "other_start", "seg_end": "other_end"})
    pairs = overlap_join(a, b, ["transcript_id"], width)
    size = F.least("end", "other_end") - F.greatest("start", "other_start") + 1
    kinds = {"e": ~F.col("inferred"), "a": F.lit(True)} if inferred else {"a": F.lit(True)}
    sums = pairs.groupBy(*key).agg(
        *[F.coalesce(F.sum(F.when((F.col("label") == n) & own, size)), F.lit(0)).alias(f"_{k}{n}") for k, own in kinds.items() for n in LABELS]
    )
    joined = spans.join(sums, key, "left").join(info, "transcript_id", "left")
    biotype = F.lower(F.coalesce("biotype", F.lit("")))
    noncoding = (F.col("has_cds") == 0) | (biotype.contains("rna") & ~biotype.contains("mrna"))

    def region(kind: str) -> Column:
        most = F.greatest(*[F.col(f"_{kind}{n}") for n in LABELS])
        label = F
        for n in LABELS:
            label = label.when(F.col(f"_{kind}{n}") == most, n)
        return (
            F.when(F.col("has_cds").isNull(), "unknown")
            .when(most > 0, label.otherwise("unknown"))
            .when(noncoding, "ncRNA")
            .otherwise("unknown")
        )

    labels = [region("e").alias(out), region("a").alias(inferred)] if inferred else [region("a").alias(out)]
    return windows.join(joined.select(*key, *labels), key, "left")


def region_flags(df: DataFrame, region: str = "region_type", prefix: str = "") -> DataFrame:
    """0/1 columns per region; unknown also covers a missing annotation."""
    r = F.col(region)
    flags = {f"{prefix}is_{n}": (r == n).cast("double") for n in ("CDS", "5UTR", "3UTR", "ncRNA")}
    flags[f"{prefix}is_unknown"] = r.isin("unknown", "NA").cast("double")
    return df.withColumns(flags)


def annotate_windows(windows: DataFrame, annotation: DataFrame | None, enabled: bool = True) -> DataFrame:
    """Explicit and inferred region of each window with flags.

    Without an annotation every region is NA; a module that is off gives NULL flags.
    """
    if annotation is None or not enabled:
        df = windows.withColumns({"region_type": F.lit("NA"), "inferred_region_type": F.lit("NA")})
    else:
        exons = transcript_exons(annotation)
        segments = project_features(annotation, exons)
        info = transcript_info(annotation)
        df = window_regions(windows, infer_utrs(segments, exons, mark=True), info, "region_type", "inferred_region_type")
    df = region_flags(region_flags(df), "inferred_region_type", "inferred_")
    if not enabled:
        df = df.withColumns({c: F.lit(None).cast("double") for c in df.columns if "is_" in c and c not in windows.columns})
    return df


def region_shares(prefix: str) -> dict[str, Column]:
    """Region shares by name: means of these over windows."""
    shares = {}
    for p in ("", "inferred_"):
        shares[f"{prefix}_{p}CDS_fraction"] = F.col(f"{p}is_CDS")
        shares[f"{prefix}_{p}UTR_fraction"] = F.col(f"{p}is_5UTR") + F.col(f"{p}is_3UTR")
        shares[f"{prefix}_{p}ncRNA_fraction"] = F.col(f"{p}is_ncRNA")
        shares[f"{prefix}_{p}unknown_fraction"] = F.col(f"{p}is_unknown")
    return shares


def best_window_region() -> list[Column]:
    """Region columns of a gene's best window."""
    best = ["region_type", "inferred_region_type"] + [
        f"{p}is_{n}" for p in ("", "inferred_") for n in ("CDS", "5UTR", "3UTR", "ncRNA", "unknown")
    ]
    return [F.min_by(c, "window_rank").alias(f"best_window_{c}") for c in best]


def region_summary(top: DataFrame, prefix: str = "top3", keys: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """Region of the best window and region shares over the kept windows of a gene."""
    return top.groupBy(*keys).agg(*best_window_region(), *[F.avg(c).alias(n) for n, c in region_shares(prefix).items()])


def region_diagnostic(top: DataFrame, genes: DataFrame, groups: DataFrame) -> DataFrame:
    """Long table (section, metric, group, value): match rate, label counts, distributions and
    region make-up of the audit groups. ``groups`` has (gene_id, audit_group)."""

    def rows(df: DataFrame, section: str, metric: Column, group: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), metric.alias("metric"), group.alias("group"), value.cast("double").alias("value")
        )

    kinds = F.array(
        F.struct(F.lit("original").alias("kind"), F.col("region_type").alias("label")),
        F.struct(F.lit("inferred").alias("kind"), F.col("inferred_region_type").alias("label")),
    )
    counts = top.select(F.inline(kinds)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    out = rows(counts, "region_counts", F.col("kind"), F.col("label"), F.col("n"))
    shares = [c for c in genes.columns if c.endswith("_fraction") and "unknown" not in c]
    long = genes.select(*shares).unpivot([], shares, "metric", "x").groupBy("metric")
    dist = long.agg(F.avg("x").alias("mean"), F.count_if(F.col("x") > 0).cast("double").alias("nonzero_count"))
    dist = dist.unpivot(["metric"], ["mean", "nonzero_count"], "g", "v")
    out = out.unionByName(rows(dist, "distribution", F.col("metric"), F.col("g"), F.col("v")))
    best = F.array(
        F.struct(F.lit("original").alias("kind"), F.col("best_window_region_type").alias("label")),
        F.struct(F.lit("inferred").alias("kind"), F.col("best_window_inferred_region_type").alias("label")),
    )
    mixed = groups.where("audit_group <> 'background'").join(genes, "gene_id").select("audit_group", F.inline(best))
    parts = mixed.groupBy("audit_group", "kind", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy("audit_group", "kind").agg(F.sum("n").alias("total"))
    parts = parts.join(totals, ["audit_group", "kind"])
    metric = F.concat_ws("__", "audit_group", "kind")
    return out.unionByName(rows(parts, "group_regions", metric, F.col("label"), F.col("n") / F.col("total")))
