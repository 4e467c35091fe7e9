"""Queries that run whole jobs: baseline, calibration and two-branch validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.inputs import TIES, with_views
from seqrank.catalog.ranking import BIN_CTE, K_SQL, KS, SEEDS, SQL_SUMMARY, WIDE_CTE, one_protein, report_sql
from seqrank.catalog.registry import SQL, query
from seqrank.catalog.scores import KMER_CTE, enrichment_report, named_profiles
from seqrank.functions.numeric import rounded
from seqrank.operators import candidates as C
from seqrank.operators import genes as G
from seqrank.operators import motif as M
from seqrank.operators import scoring as SC
from seqrank.plans import jobs
from seqrank.session import durable

_SPLITS = """tg as (select gene_id from truth semi join one using (gene_id)),
sp as materialized (select seed, gene_id, if(row_number() over (partition by seed order by md5(concat(seed,':',gene_id)), gene_id) <=
    least(greatest(round_even(count(*) over (partition by seed)*0.7e0,0),1),count(*) over (partition by seed)-1),'calibration','heldout') as role from tg, (select unnest([11,12,13,14,15]) seed))"""

#: Structure features of the second branch: all aggregates of one score, and one of another.
STRUCTURE = [f"structure_{n}" for n in ("max_score", "top3_mean_score", "top5_mean_score", "top10_mean_score", "top5_percent_mean_score")] + ["motif_structure_top3_mean_score"]

_BRANCHES = (
    BIN_CTE
    + """,
six as materialized (select o.gene_id, o.top3_mean_score x0, round(s.max_score,9) x1, round(s.top3_mean_score,9) x2, round(s.top5_mean_score,9) x3, round(s.top10_mean_score,9) x4, round(s.top5_percent_mean_score,9) x5,
  round(m.top3_mean_score,9) x6 from one o join melted s on s.gene_id=o.gene_id and s.score_name='structure_only_score' join melted m on m.gene_id=o.gene_id and m.score_name='motif_structure_score'),
pr as (select gene_id, """
    + ", ".join(f"if(x{i} is null, null, (rank() over (order by x{i} nulls last) + (count(*) over (partition by x{i})-1)/2e0)/count(x{i}) over ()) p{i}" for i in range(7))
    + """ from six),
ab as (select gene_id, p0 a, list_avg([p1,p2,p3,p4,p5,p6]) b from pr),
tb as materialized (select gene_id, unnest(['A_branch_score','B_branch_score','final_score_max','final_score_0.7A_0.3B','final_score_0.5A_0.5B','final_score_0.3A_0.7B']) score_variant,
   unnest([a,b,greatest(a,b),0.7e0*a+0.3e0*b,0.5e0*a+0.5e0*b,0.3e0*a+0.7e0*b]) score from ab)"""
)


def branch_genes(v):
    """Genes with the first branch's score and the six features of the second."""
    names = ["max_score", "top3_mean_score", "top5_mean_score", "top10_mean_score", "top5_percent_mean_score"]
    scored = v.scored()

    def table(score, prefix, columns):
        out = G.aggregate_genes(scored, score, ["gene_id"], TIES, best=("transcript_id",))
        return out.select("gene_id", *[rounded(n, 9).alias(prefix + n) for n in columns])

    first = table("inverted_base_motif_structure_score", "", ["top3_mean_score"])
    second = table("structure_only_score", "structure_", names)
    return durable(first.join(second, "gene_id").join(table("motif_structure_score", "motif_structure_", ["top3_mean_score"]), "gene_id"))


@query("two_branch", with_views("scored", "select gene_id, score_variant, round(score,6) as score from tb", _BRANCHES))
def two_branch(v):
    return C.two_branch(branch_genes(v), "top3_mean_score", STRUCTURE).withColumn("score", rounded("score"))


@query(
    "two_branch_heldout",
    with_views(
        "scored truth",
        report_sql(
            "score_variant, seed",
            f"""select score_variant, seed, k, m, n, count(*) filter (rk<=k) hits from (select *, row_number() over (partition by score_variant order by round(score,9) desc nulls last, gene_id) rk,
   count(*) over (partition by score_variant) m from tb) join sp using (gene_id) join (select seed, count(*) n from sp where role='heldout' group by 1) using (seed) cross join {K_SQL} where role='heldout' group by 1,2,3,4,5""",
        ),
        _BRANCHES + ", " + _SPLITS,
    ),
)
def two_branch_heldout(v):
    out = jobs.two_branch_validation(branch_genes(v), STRUCTURE, v.truth(), SEEDS, KS, digits=9)
    return enrichment_report(out, ["score_variant", "seed"])


@query(
    "baseline_run",
    with_views(
        "scored truth",
        report_sql(
            "part, seed",
            f"""select part, seed, k, m, n, count(*) filter (rk<=k) hits from (select gene_id, row_number() over (order by top3_mean_score desc nulls last, gene_id) rk, count(*) over () m from one)
   join tr using (gene_id) join (select part, seed, count(*) n from tr group by 1,2) using (part, seed) cross join {K_SQL} group by 1,2,3,4,5""",
        ),
        BIN_CTE + ", " + _SPLITS + ", tr as (select 'full_truth' part, 0 seed, gene_id from tg union all select 'heldout', seed, gene_id from sp where role='heldout')",
    ),
)
def baseline_run(v):
    out = jobs.baseline_run(one_protein(v), v.truth(), SEEDS, ks=KS)
    full = out["full_truth"].withColumns({"part": F.lit("full_truth"), "seed": F.lit(0)})
    return enrichment_report(full.unionByName(out["heldout"].withColumn("part", F.lit("heldout"))), ["part", "seed"])


@query("calibration_run", with_views("scored truth", SQL_SUMMARY, WIDE_CTE))
def calibration_run(v):
    out = jobs.calibration_run(v.scored(stored=False), SC.ABLATIONS, v.truth(), SEEDS, KS, TIES, digits=9)["summary"]
    means = ["mean_overlap", "median_overlap", "mean_precision", "mean_recall", "mean_fold_enrichment"]
    return out.select("score_name", "aggregation", "top_k", "n_selected", "min_overlap", "max_overlap", *[rounded(c).alias(c) for c in means])


_DIAGNOSTIC_REPEATS = ("self_complementarity_score", "inverted_repeat_score", "simple_repeat_score", "simple_repeat_penalty_score", "reverse_complement_4mer_density", "reverse_complement_5mer_density", "reverse_complement_6mer_density")
_DIAGNOSTIC_PAIRING = ("paired_architecture_score", "stem_like_score", "paired_run_density", "max_local_paired_mean_31nt", "max_local_paired_mean_41nt", "max_local_paired_mean_81nt", "longest_high_paired_run")


@query(
    "diagnostic_features",
    with_views(
        "tx_scores",
        "select gene_id, k as top_window_k, "
        + ", ".join(f"round(avg({n}),6)+0e0 as topk_{n}_mean" for n in (*_DIAGNOSTIC_REPEATS, *_DIAGNOSTIC_PAIRING))
        + ", round(avg(if(paired_architecture_score>=0.6e0,1e0,0e0)),6) as fraction_high_paired_architecture_windows, round(max(paired_architecture_score),6) as max_paired_architecture_score"
        + f""" from t20 join (select cast(unnest([3,10,20]) as integer) k) on window_rank<=k join ({SQL['repeat_features'].replace('window_rank <= 3', 'window_rank <= 20')}) h on h.seq_md5=md5(rna_seq)
 join ({SQL['hairpin_features']}) p using (transcript_id, window_start) group by 1,2""",
        "t20 as materialized (select * from (select *, row_number() over (partition by gene_id order by base_score desc, transcript_id, window_start) window_rank from tx_scores) where window_rank<=20)",
    ),
)
def diagnostic_features(v):
    """Repeat and pairing features of the 3, 10 and 20 best windows of real sequences."""
    scores = durable(v.tx_scores())
    top = durable(G.top_windows(scores, "base_score", 20, ties=("transcript_id", "window_start")))
    modules = jobs.window_modules(top, None, v.pairing(top).select("transcript_id", "window_start", "window_end", "paired"), region=False)
    modules = modules.withColumns({c: rounded(c) for c in (*_DIAGNOSTIC_REPEATS, *_DIAGNOSTIC_PAIRING)})
    out = jobs.diagnostic_features(modules, top.select("gene_id").distinct(), (3, 10, 20))
    names = [f"topk_{n}_mean" for n in (*_DIAGNOSTIC_REPEATS, *_DIAGNOSTIC_PAIRING)] + ["fraction_high_paired_architecture_windows", "max_paired_architecture_score"]
    return out.select("gene_id", "top_window_k", *[rounded(c).alias(c) for c in names])


@query(
    "fp_audit",
    with_views(
        "tx_scores tx_truth profiles",
        f"""select g as audit_group, cast(r as bigint) as audit_rank, gene_id, transcript_id, round(top3,6) as ranking_score, n_windows, ws as best_window_start, we as best_window_end, rna_seq as best_window_seq,
 c.u_content, c.shannon_entropy, c.low_complexity_score, c.longest_u_run, c.u7_count, rp.reverse_complement_4mer_density, h.longest_high_paired_run, h.high_paired_run_count, h.paired_run_density, h.max_local_paired_mean_41nt,
 d.au_rich_paired_density, d.u_rich_paired_density, round(len(list_filter(range(1,195), lambda i: list_contains(wl, substr(rna_seq,i,7))))/194e0,6) as top_urich_kmer_density, cast(null as varchar) as region_annotation, cast(null as varchar) as mirna_annotation
from fo join (select transcript_id, window_start ws, rna_seq from tx_scores) using (transcript_id, ws) cross join rich
 join ({SQL['composition']}) c on c.transcript_id=fo.transcript_id and c.window_start=ws join ({SQL['hairpin_features']}) h on h.transcript_id=fo.transcript_id and h.window_start=ws
 join ({SQL['au_paired_density']}) d on d.transcript_id=fo.transcript_id and d.window_start=ws join ({SQL['repeat_features']}) rp on rp.seq_md5=md5(rna_seq)""",
        """gg as (select gene_id, round(avg(base_score) filter (rn<=3),9) top3, count(*) n_windows, max(transcript_id) filter (rn=1) transcript_id, max(window_start) filter (rn=1) ws, max(window_end) filter (rn=1) we
 from (select *, row_number() over (partition by gene_id order by base_score desc nulls last, transcript_id, window_start) rn from tx_scores) group by 1),
fo as materialized (select * from (select *, case when r<=100 and t then 'Top100 true positives' when r<=100 then 'Top100 false positives' when t then 'truth outside Top100' end g from
 (select *, row_number() over (order by top3 desc nulls last, gene_id) r, gene_id in (select gene_id from tx_truth) t from gg)) where g is not null),
"""
        + KMER_CTE
        + """, pos as (select kmer, zscore, r, (7-length(translate(kmer,'UC','')))/7e0>=0.71 and (7-length(replace(kmer,'U','')))/7e0>=0.43 ok from (select *, row_number() over (order by zscore desc nulls last, kmer) r from kp where rbp_id='rA') where r<=25),
rich as (select list(kmer) wl from (select kmer from pos where ok or not exists (select 1 from pos where ok) order by zscore desc nulls last, r limit 20))""",
    ),
)
def fp_audit(v):
    """Audited genes of real sequences with the features of their best windows."""
    scores = durable(v.tx_scores())
    table = G.aggregate_genes(scores, "base_score", ["gene_id"], ("transcript_id", "window_start")).withColumn("top3_mean_score", rounded("top3_mean_score", 9))
    pairing = v.pairing(scores).select("transcript_id", "window_start", "window_end", "paired")
    top = M.extremes(named_profiles(v).where("rbp_id = 'rA'"))
    out = jobs.false_positive_audit(durable(table), v.tx_truth(), scores, pairing, top, 100)
    plain = ["audit_group", "audit_rank", "gene_id", "transcript_id", "n_windows", "best_window_start", "best_window_end", "best_window_seq", "longest_high_paired_run", "high_paired_run_count"]
    named = {"U_content": "u_content", "AU_rich_paired_density": "au_rich_paired_density", "U_rich_paired_density": "u_rich_paired_density", "top_Urich_kmer_density": "top_urich_kmer_density"}
    figures = ["ranking_score", "shannon_entropy", "low_complexity_score", "reverse_complement_4mer_density", "paired_run_density", "max_local_paired_mean_41nt"]
    return out.select(
        *plain,
        *[rounded(c).alias(c) for c in figures],
        *[rounded(c).alias(n) for c, n in named.items()],
        F.col("max_homopolymer_U_len").alias("longest_u_run"),
        F.col("UUUUUUU_count").alias("u7_count"),
        "region_annotation",
        "mirna_annotation",
    )
