"""Input views for the catalog, derived from the shared tables.

Each view exists twice: as a DataFrame here and as a DuckDB common table expression, so that
queries and their SQL twins start from the same rows.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqrank.functions.numeric import rounded
from seqrank.operators.genes import aggregate_genes
from seqrank.operators.scoring import ABLATIONS, ablate, linear_logit, robust_scales
from seqrank.operators.windows import attach_genes, tile
from seqrank.session import durable, spread


TIES = ("transcript_id", "window_start", "l_suppkey", "l_extendedprice")
WEIGHTS = {"A": -0.7, "C": 0.4, "G": 0.9, "U": 1.3}


class Inputs:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tx(self) -> DataFrame:
        """Transcripts, spread over all cores because one small file is one scan task."""
        rows = spread(self.table("documents"), "doc_id").selectExpr("concat('tx',doc_id) transcript_id", "text")
        letters = bytes(string.ascii_uppercase + string.ascii_lowercase, "ascii")
        table = bytes.maketrans(letters, (b"ACGU" * 7)[:26] * 2)
        others = bytes(set(range(256)) - set(letters))

        def bases(batches):
            for batch in batches:
                # of text in UTF-8, no byte of another character is a letter's
                seq = [None if x is None else x.translate(table, others) for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary()).cast(pa.string())], ["transcript_id", "seq"])

        return rows.mapInArrow(bases, "transcript_id string, seq string")

    def gene_map(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "concat('tx',doc_id) transcript_id", "concat('g',cast(floor(doc_id/3e0) as bigint)) gene_id"
        )

    def windows(self) -> DataFrame:
        return tile(attach_genes(self.tx(), self.gene_map())).select(
            "gene_id", "transcript_id", "window_start", "window_end", "rna_seq"
        )

    def tx_truth(self) -> DataFrame:
        return (
            self.table("labels")
            .where("toxic = 1")
            .selectExpr("concat('g',cast(floor(doc_id/3e0) as bigint)) gene_id")
            .distinct()
        )

    def profiles(self) -> DataFrame:
        """Sparse k-mer scores: three proteins, k-mer numbers and values from order lines."""
        return (
            self.table("lineitem")
            .selectExpr(
                "concat('r',l_returnflag) rbp_id",
                "(l_orderkey*7919+l_partkey*104729+l_suppkey*31) % 16384 kmer_idx",
                "(cast(round(l_extendedprice*100) as bigint) % 601)/1e2-3 z",
            )
            .groupBy("rbp_id", "kmer_idx")
            .agg({"z": "max"})
            .withColumnRenamed("max(z)", "zscore")
        )

    def pairing(self, windows: DataFrame | None = None) -> DataFrame:
        windows = self.windows() if windows is None else windows
        # the value changes every thirteen positions; of the sixteenth, five are left
        runs = ", ".join(f"array_repeat((({b}L*37 + window_start*11) % 100)/1e2, {13 if b < 15 else 5})" for b in range(16))
        return windows.selectExpr("*", f"flatten(array({runs})) paired")

    def window_scores(self) -> DataFrame:
        return spread(self.table("lineitem"), "l_orderkey").selectExpr(
            "concat('g',l_partkey) gene_id",
            "concat('t',l_orderkey) transcript_id",
            "l_linenumber*50-49 window_start",
            "l_linenumber*50+150 window_end",
            "(cast(round(l_extendedprice*100) as bigint) % 1000)/1e2-5 base_logit",
            "case when l_linenumber=7 then null else ((l_suppkey*31+l_orderkey*7) % 500)/1e2-1 end motif_raw",
            "l_quantity/5e1 structure_raw",
            "concat('r',l_returnflag) rbp_id",
            "l_suppkey",
            "l_extendedprice",
        )

    def scored(self, stored: bool = True) -> DataFrame:
        """Window scores with scaled components and all score variants, rounded for stable order.

        ``stored=False`` is for steps that read them once.
        """
        df = self.window_scores()
        names = [(raw, f"{n}_match_score", f"{n}_match_center", f"{n}_match_scale") for raw, n in (("motif_raw", "motif"), ("structure_raw", "structure"))]
        df = robust_scales(df, names)
        df = ablate(df, 0.6, 0.3).withColumnRenamed("structure_raw", "structure_match_raw")
        # the scored windows are a stored table: many later steps read a few columns of it
        df = df.withColumns({n: rounded(n, 9) for n in ABLATIONS})
        return durable(df) if stored else df

    def genes(self, score: str = "inverted_base_motif_structure_score") -> DataFrame:
        return durable(aggregate_genes(self.scored(stored=False), score, ["rbp_id", "gene_id"], TIES).drop("transcript_id"))

    def tx_scores(self) -> DataFrame:
        """Text windows with a rounded linear base score."""
        return self.windows().withColumn("base_score", rounded(linear_logit(WEIGHTS, 0.1), 9))

    def truth(self) -> DataFrame:
        return self.table("part").where("p_size > 40").selectExpr("concat('g',p_partkey) gene_id")

    def exons(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('t',o_orderkey) transcript_id",
            "o_orderkey k",
            "o_orderstatus",
            "o_orderpriority",
            "if(o_orderkey % 2=0,'+','-') strand",
            "explode(array(1,2,3)) exon_no",
        ).selectExpr(
            "*",
            "1000*k+(exon_no-1)*300+1 exon_start",
            "1000*k+(exon_no-1)*300+100+(k+exon_no*13) % 100 exon_end",
        )

    def annotation(self) -> DataFrame:
        """One row per annotated feature: exons, coding parts, explicit 5' parts and the transcript."""
        ex = self.exons().selectExpr(
            "transcript_id",
            "'exon' feature",
            "cast(exon_start as bigint) start",
            "cast(exon_end as bigint) end",
            "strand",
            "o_orderstatus",
            "o_orderpriority",
            "k",
            "exon_no",
            "if(o_orderpriority='5-LOW','lncRNA','protein_coding') biotype",
        )
        keep = ["transcript_id", "feature", "start", "end", "strand", "biotype"]
        cds = ex.where("o_orderpriority <> '5-LOW'").selectExpr(
            "transcript_id",
            "'CDS' feature",
            "greatest(start, 1000*k+41) start",
            "least(end, 1000*k+641) end",
            "strand",
            "biotype",
        ).where("start <= end")
        utr = ex.where("o_orderpriority <> '5-LOW' and o_orderstatus = 'F'").where(
            "exon_no = if(strand='+',1,3)"
        ).selectExpr(
            "transcript_id",
            "'five_prime_utr' feature",
            "if(strand='+', start, end-29) start",
            "if(strand='+', start+29, end) end",
            "strand",
            "biotype",
        )
        return ex.select(*keep).unionByName(cds.select(*keep)).unionByName(utr.select(*keep))


# DuckDB twins: view name -> (views it needs, SQL)
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "tx": (
        [],
        """select concat('tx',doc_id) transcript_id,
       translate(upper(regexp_replace(text,'[^A-Za-z]','','g')),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGUACGUACGUACGUACGUACGUAC') seq
from documents""",
    ),
    "gene_map": (
        [],
        "select concat('tx',doc_id) transcript_id, concat('g',cast(floor(doc_id/3e0) as bigint)) gene_id from documents",
    ),
    "windows": (
        ["tx", "gene_map"],
        """select g.gene_id, t.transcript_id, cast(s0+1 as integer) window_start, cast(s0+200 as integer) window_end,
       substr(seq,s0+1,200) rna_seq
from (select *, unnest(list_distinct(list_append(range(0,length(seq)-199,50), length(seq)-200))) s0
      from tx where length(seq)>=200) t join gene_map g using (transcript_id)""",
    ),
    "tx_truth": (
        [],
        "select distinct concat('g',cast(floor(doc_id/3e0) as bigint)) gene_id from labels where toxic=1",
    ),
    "profiles": (
        [],
        """select concat('r',l_returnflag) rbp_id,
       (l_orderkey*7919+l_partkey*104729+l_suppkey*31) % 16384 kmer_idx,
       max((cast(round(l_extendedprice*100) as bigint) % 601)/1e2-3) zscore
from lineitem group by 1,2""",
    ),
    "pairing": (
        ["windows"],
        """select *, list_transform(range(0,200),
       lambda p: ((cast(floor(p/13e0) as bigint)*37 + window_start*11) % 100)/1e2) paired from windows""",
    ),
    "window_scores": (
        [],
        """select concat('g',l_partkey) gene_id, concat('t',l_orderkey) transcript_id,
       l_linenumber*50-49 window_start, l_linenumber*50+150 window_end,
       (cast(round(l_extendedprice*100) as bigint) % 1000)/1e2-5 base_logit,
       case when l_linenumber=7 then null else ((l_suppkey*31+l_orderkey*7) % 500)/1e2-1 end motif_raw,
       l_quantity/5e1 structure_raw, concat('r',l_returnflag) rbp_id, l_suppkey, l_extendedprice
from lineitem""",
    ),
    "scored": (
        ["window_scores"],
        """select rbp_id, gene_id, transcript_id, window_start, window_end, l_suppkey, l_extendedprice, base_logit, motif_raw,
  structure_raw as structure_match_raw, mc motif_match_center, msc motif_match_scale, motif_match_score,
  sc structure_match_center, ssc structure_match_scale, structure_match_score,
  round(1/(1+exp(-b)),9) base_score, round(1-1/(1+exp(-b)),9) inverted_base_score,
  round(1/(1+exp(-m)),9) motif_only_score, round(1/(1+exp(-s)),9) structure_only_score,
  round(1/(1+exp(-(m+s))),9) motif_structure_score, round(1/(1+exp(-(b+m))),9) base_motif_score,
  round(1/(1+exp(-(-b+m))),9) inverted_base_motif_score, round(1/(1+exp(-(b+m+s))),9) base_motif_structure_score,
  round(1/(1+exp(-(-b+m+s))),9) inverted_base_motif_structure_score
from (select *, base_logit b, 0.6e0*motif_match_score m, 0.3e0*structure_match_score s from (
 select w.*, mc, msc, sc, ssc, (motif_raw-mc)/msc motif_match_score, (structure_raw-sc)/ssc structure_match_score
 from window_scores w join (
  select rbp_id, mc, case when mi>=1e-6 then mi when md>=1e-6 then md else 1e0 end msc,
         sc, case when si>=1e-6 then si when sd>=1e-6 then sd else 1e0 end ssc
  from (select rbp_id, quantile_cont(motif_raw,0.5) mc, quantile_cont(motif_raw,0.75)-quantile_cont(motif_raw,0.25) mi, stddev_pop(motif_raw) md,
               quantile_cont(structure_raw,0.5) sc, quantile_cont(structure_raw,0.75)-quantile_cont(structure_raw,0.25) si, stddev_pop(structure_raw) sd
        from window_scores group by 1)) using (rbp_id)))""",
    ),
    "genes": (
        ["scored"],
        """select rbp_id, gene_id, max(s) max_score, avg(s) filter (rn<=3) top3_mean_score, avg(s) filter (rn<=5) top5_mean_score,
  avg(s) filter (rn<=10) top10_mean_score, avg(s) filter (rn<=greatest(ceil(ns*0.05),1)) top5_percent_mean_score,
  max(s)-0.05e0*log2(count(*)+1) window_count_adjusted_score, count(*) n_windows,
  max(window_start) filter (rn=1) best_window_start, max(window_end) filter (rn=1) best_window_end
from (select *, inverted_base_motif_structure_score s,
        count(inverted_base_motif_structure_score) over (partition by rbp_id,gene_id) ns,
        row_number() over (partition by rbp_id,gene_id order by inverted_base_motif_structure_score desc nulls last,
                           transcript_id, window_start, l_suppkey, l_extendedprice) rn from scored) group by 1,2""",
    ),
    "tx_scores": (
        ["windows"],
        """select *, round(0.1e0 - 0.7e0*((200-length(replace(rna_seq,'A','')))/2e2) + 0.4e0*((200-length(replace(rna_seq,'C','')))/2e2)
   + 0.9e0*((200-length(replace(rna_seq,'G','')))/2e2) + 1.3e0*((200-length(replace(rna_seq,'U','')))/2e2),9) base_score from windows""",
    ),
    "tx_top3": (
        ["tx_scores"],
        """select * from (select *, row_number() over (partition by gene_id order by base_score desc, transcript_id, window_start) window_rank
  from tx_scores) where window_rank <= 3""",
    ),
    "truth": ([], "select concat('g',p_partkey) gene_id from part where p_size > 40"),
    "exons": (
        [],
        """select concat('t',o_orderkey) transcript_id, o_orderkey k, o_orderstatus, o_orderpriority,
       if(o_orderkey % 2=0,'+','-') strand, exon_no,
       1000*o_orderkey+(exon_no-1)*300+1 exon_start,
       1000*o_orderkey+(exon_no-1)*300+100+(o_orderkey+exon_no*13) % 100 exon_end
from orders, (select unnest([1,2,3]) exon_no)""",
    ),
    "annotation": (
        ["exons"],
        """select transcript_id, 'exon' feature, exon_start as start, exon_end as end_, strand,
       if(o_orderpriority='5-LOW','lncRNA','protein_coding') biotype from exons
union all
select * from (select transcript_id, 'CDS', greatest(exon_start, 1000*k+41) s, least(exon_end, 1000*k+641) e, strand, 'protein_coding'
from exons where o_orderpriority <> '5-LOW') where s <= e
union all
select transcript_id, 'five_prime_utr', if(strand='+', exon_start, exon_end-29), if(strand='+', exon_start+29, exon_end),
       strand, 'protein_coding'
from exons where o_orderpriority <> '5-LOW' and o_orderstatus='F' and exon_no = if(strand='+',1,3)""",
    ),
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """SQL text of ``body`` preceded by the views it needs; ``extra`` holds further CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in SQL_VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    # MATERIALIZED keeps a view from being recomputed at every mention
    parts = [f"{n} as materialized ({SQL_VIEWS[n][1]})" for n in ordered]
    if extra.strip():
        parts.append(extra.strip())
    return (f"with {', '.join(parts)}\n" if parts else "") + body
