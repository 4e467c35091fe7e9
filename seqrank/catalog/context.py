"""Queries on annotation, regions, context features and candidate grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.inputs import TIES, with_views
from seqrank.catalog.ranking import BIN_CTE, K_SQL, KS, ONE_CTE, SEEDS, one_protein, p_sql, report_sql
from seqrank.catalog.registry import SQL, query
from seqrank.catalog.scores import enrichment_report
from seqrank.functions.numeric import rounded
from seqrank.operators import candidates as C
from seqrank.operators import enrichment as E
from seqrank.operators import features as FT
from seqrank.operators import genes as G
from seqrank.operators import regions as R
from seqrank.operators.repeats import add_repeat_features
from seqrank.plans import jobs
from seqrank.plans.jobs import context_calibration as context_calibration_job
from seqrank.session import durable

EXON_CTE = """ex as materialized (select *, sum(len) over (partition by transcript_id order by d) upto, sum(len) over (partition by transcript_id order by d)-len+1 tx_start
  from (select *, end_-start+1 len, if(strand='-',-start,start) d from annotation where feature='exon')),
seg as materialized (select e.transcript_id, case f.feature when 'CDS' then 'CDS' else '5UTR' end as label,
   cast(e.tx_start+if(e.strand='-', e.end_-least(e.end_,f.end_), greatest(e.start,f.start)-e.start) as bigint) seg_start,
   cast(e.tx_start+if(e.strand='-', e.end_-least(e.end_,f.end_), greatest(e.start,f.start)-e.start)+least(e.end_,f.end_)-greatest(e.start,f.start) as bigint) seg_end
  from ex e join annotation f on e.transcript_id=f.transcript_id and f.feature<>'exon' and greatest(e.start,f.start)<=least(e.end_,f.end_)),
bounds as (select transcript_id, min(seg_start) filter (label='CDS') lo, max(seg_end) filter (label='CDS') hi, count(*) filter (label='5UTR') n5, count(*) filter (label='3UTR') n3 from seg group by 1),
lens as (select transcript_id, cast(max(upto) as bigint) l from ex group by 1),
seg2 as materialized (select * from seg union all select transcript_id, '5UTR', 1, lo-1 from bounds where lo>1 and n5=0
  union all select transcript_id, '3UTR', hi+1, l from bounds join lens using (transcript_id) where hi<l and n3=0)"""


@query(
    "gene_map_from_annotation",
    """with a as (select concat('t',o_orderkey) transcript_id, concat('g',o_custkey % 500) gene_id, o_orderkey n from orders)
select transcript_id, arg_max(gene_id, n) as gene_id from a group by 1""",
)
def gene_map_from_annotation(v):
    rows = v.table("orders").selectExpr(
        "'mRNA' feature",
        "cast(null as string) transcript_id",
        "cast(null as string) gene_id",
        "concat('transcript:t',o_orderkey) attr_id",
        "concat('gene:g',o_custkey % 500) attr_parent",
        "o_orderkey line_no",
    )
    return R.gene_map(rows, "gff3")


@query("exon_projection", with_views("annotation", "select transcript_id, label, seg_start, seg_end from seg", EXON_CTE))
def exon_projection(v):
    a = v.annotation()
    return R.project_features(a, R.transcript_exons(a))


@query("inferred_utr", with_views("annotation", "select transcript_id, label, seg_start, seg_end from seg2", EXON_CTE))
def inferred_utr(v):
    a = v.annotation()
    exons = durable(R.transcript_exons(a))
    return R.infer_utrs(R.project_features(a, exons), exons)


def region_sql(segments: str, name: str) -> str:
    return f"""{name} as materialized (select w.transcript_id, w.window_start, w.window_end, case when i.transcript_id is null then 'unknown'
  when coalesce(c,0)+coalesce(u5,0)+coalesce(u3,0)>0 then case when coalesce(c,0)>=greatest(coalesce(u5,0),coalesce(u3,0)) then 'CDS' when coalesce(u5,0)>=coalesce(u3,0) then '5UTR' else '3UTR' end
  when has_cds=0 or (contains(lower(biotype),'rna') and not contains(lower(biotype),'mrna')) then 'ncRNA' else 'unknown' end r
 from (select distinct transcript_id, window_start, window_end from window_scores) w
 left join (select transcript_id, window_start, window_end, sum(o) filter (label='CDS') c, sum(o) filter (label='5UTR') u5, sum(o) filter (label='3UTR') u3 from
   (select w.transcript_id, w.window_start, w.window_end, label, least(window_end,seg_end)-greatest(window_start,seg_start)+1 o
    from (select distinct transcript_id, window_start, window_end from window_scores) w join {segments} s on s.transcript_id=w.transcript_id and greatest(window_start,seg_start)<=least(window_end,seg_end)) group by 1,2,3)
   using (transcript_id, window_start, window_end)
 left join (select transcript_id, min(biotype) biotype, max(if(feature='CDS',1,0)) has_cds from annotation group by 1) i on i.transcript_id=w.transcript_id)"""


REGION_CTE = EXON_CTE + ", " + region_sql("seg", "r1") + ", " + region_sql("seg2", "r2")


@query(
    "window_region",
    with_views(
        "annotation window_scores",
        "select transcript_id, window_start, r1.r as region_type, r2.r as inferred_region_type from r1 join r2 using (transcript_id, window_start, window_end)",
        REGION_CTE,
    ),
)
def window_region(v):
    spans = v.window_scores().select("transcript_id", "window_start", "window_end").distinct()
    out = R.annotate_windows(spans, durable(v.annotation()))
    return out.select("transcript_id", "window_start", "region_type", "inferred_region_type")


TOP3_CTE = (
    REGION_CTE
    + """, top3 as materialized (select t.*, r1.r region_type, r2.r inferred_region_type from (select *, row_number() over (partition by gene_id order by inverted_base_motif_structure_score desc nulls last,
    transcript_id, window_start, l_suppkey, l_extendedprice) window_rank from scored) t join r1 using (transcript_id, window_start, window_end) join r2 using (transcript_id, window_start, window_end) where window_rank<=3)"""
)


@query(
    "region_summary",
    with_views(
        "annotation scored",
        """select gene_id, max(region_type) filter (window_rank=1) as best_window_region_type, max(inferred_region_type) filter (window_rank=1) as best_window_inferred_region_type,
  round(avg(cast(region_type='CDS' as double)),6) as top3_CDS_fraction, round(avg(cast(region_type in ('5UTR','3UTR') as double)),6) as top3_UTR_fraction,
  round(avg(cast(region_type='ncRNA' as double)),6) as top3_ncRNA_fraction, round(avg(cast(region_type='unknown' as double)),6) as top3_unknown_fraction,
  round(avg(cast(inferred_region_type in ('5UTR','3UTR') as double)),6) as top3_inferred_UTR_fraction from top3 group by 1""",
        TOP3_CTE,
    ),
)
def region_summary(v):
    out = R.region_summary(top3_regions(v))
    shares = ["top3_CDS_fraction", "top3_UTR_fraction", "top3_ncRNA_fraction", "top3_unknown_fraction", "top3_inferred_UTR_fraction"]
    return out.select("gene_id", "best_window_region_type", "best_window_inferred_region_type", *[rounded(c).alias(c) for c in shares])


def top3_regions(v, scored=None):
    """The three best windows of each gene, without other scores, with their regions."""
    score = "inverted_base_motif_structure_score"
    scored = v.scored(stored=False) if scored is None else scored
    best = scored.select("gene_id", *TIES, "window_end", score)
    top = durable(G.top_windows(best, score, 3, ties=TIES).drop("l_suppkey", "l_extendedprice", score))
    return R.annotate_windows(top, annotation_of(v, top))


def annotation_of(v, windows):
    """The annotation of the transcripts of ``windows``; others have no window to place."""
    return durable(v.annotation().join(windows.select("transcript_id").distinct(), "transcript_id", "left_semi"))


@query(
    "region_diagnostic",
    with_views(
        "annotation scored truth",
        """select 'region_counts' as section, 'original' as metric, region_type as "group", cast(count(*) as double) as value from top3 group by 3
union all select 'region_counts', 'inferred', inferred_region_type, count(*) from top3 group by 3
union all select 'distribution', f, 'mean', round(avg(x),6) from gl group by 2
union all select 'distribution', f, 'nonzero_count', count(*) filter (x>0) from gl group by 2
union all select 'group_regions', concat(audit_group,'__',kind), label, round(count(*)/cast(max(t) as double),6) from
  (select *, count(*) over (partition by audit_group, kind) t from (select audit_group, 'original' kind, b label from ag join gs using (gene_id) union all select audit_group, 'inferred', bi from ag join gs using (gene_id)))
  group by 2,3""",
        TOP3_CTE
        + ", "
        + ONE_CTE
        + """, gs as materialized (select gene_id, max(region_type) filter (window_rank=1) b, max(inferred_region_type) filter (window_rank=1) bi,
  avg(cast(region_type='CDS' as double)) "top3_CDS_fraction", avg(cast(region_type in ('5UTR','3UTR') as double)) "top3_UTR_fraction", avg(cast(region_type='ncRNA' as double)) "top3_ncRNA_fraction",
  avg(cast(inferred_region_type='CDS' as double)) "top3_inferred_CDS_fraction", avg(cast(inferred_region_type in ('5UTR','3UTR') as double)) "top3_inferred_UTR_fraction", avg(cast(inferred_region_type='ncRNA' as double)) "top3_inferred_ncRNA_fraction" from top3 group by 1),
gl as (unpivot (select * exclude (gene_id, b, bi) from gs) on columns(*) into name f value x),
ag as (select gene_id, case when rk<=200 and t then 'Top200 true positives' when rk<=200 then 'Top200 false positives' else 'truth outside Top200' end audit_group
 from (select gene_id, row_number() over (order by top3_mean_score desc nulls last, gene_id) rk, gene_id in (select gene_id from truth) t from one) where rk<=200 or t)""",
    ),
)
def region_diagnostic(v):
    # both read one score of the windows: their scales are found once, and no score is stored
    scored = v.scored(stored=False)
    top = durable(top3_regions(v, scored))
    groups = E.audit_groups(one_protein(v, scored), v.truth(), "top3_mean_score", 200).select("gene_id", "audit_group")
    out = R.region_diagnostic(top, R.region_summary(top), groups)
    return out.withColumn("value", rounded("value"))


Z_CTE = (
    ONE_CTE
    + """, fl as materialized (unpivot (select gene_id, max_score, top3_mean_score, top10_mean_score, top5_percent_mean_score, cast(n_windows as double) n_windows from one) on max_score, top3_mean_score, top10_mean_score, top5_percent_mean_score, n_windows into name f value x),
st as (select f, median(x) med, avg(x) mu, stddev_samp(x) sd from fl group by 1),
md as (select f, median(abs(x-med)) mad from fl join st using (f) group by 1),
zl as materialized (select gene_id, f, case when mad>0 then 0.67448975e0*(x-med)/mad when sd>0 then (x-mu)/sd else 0e0 end z from fl join st using (f) join md using (f)),
zw as materialized (select gene_id, max(z) filter (f='max_score') z1, max(z) filter (f='top3_mean_score') z2, max(z) filter (f='top10_mean_score') z3, max(z) filter (f='top5_percent_mean_score') z4, max(z) filter (f='n_windows') z5 from zl group by 1)"""
)


@query("robust_z", with_views("scored", "select gene_id, round(z1,6)+0e0 as max_z, round(z2,6)+0e0 as top3_z, round(z5,6)+0e0 as n_z from zw", Z_CTE))
def robust_z(v):
    out = C.robust_z(one_protein(v), ["max_score", "top3_mean_score", "top10_mean_score", "top5_percent_mean_score", "n_windows"])
    return out.select(
        "gene_id",
        rounded("max_score_z").alias("max_z"),
        rounded("top3_mean_score_z").alias("top3_z"),
        rounded("n_windows_z").alias("n_z"),
    )


def toy_context(v):
    """Gene table with context columns filled from gene aggregates."""
    g = one_protein(v)
    return durable(
        g.select(
            "gene_id",
            F.col("top3_mean_score").alias("baseline_score"),
            F.col("max_score").alias("top3_UTR_fraction"),
            F.col("top10_mean_score").alias("top3_ncRNA_fraction"),
            F.col("n_windows").cast("double").alias("top3_CDS_fraction"),
            *[F.col("top10_mean_score").alias(c) for c in ("top3_inverted_repeat_score_mean", "top3_palindrome_score_mean")],
            *[F.col("max_score").alias(c) for c in ("top3_local_self_complementarity_score_mean", "top3_reverse_complement_5mer_density_mean")],
            *[F.col("n_windows").cast("double").alias(c) for c in ("top3_stem_like_score_mean", "top3_structure_peakiness_score_mean")],
            *[F.col("top5_percent_mean_score").alias(c) for c in ("top3_max_local_paired_mean_41nt_mean", "top3_paired_run_density_mean")],
        )
    )


BETAS = (0.1, 0.5)
GRID_CTE = (
    Z_CTE
    + """, bon as materialized (select gene_id, top3_mean_score b0, z2 z, (z1+z3-z5)/3 rg, (z3+z1+z1+z3)/4 rp, (z5+z5+z4+z4)/4 hp from one join zw using (gene_id)),
grid as materialized (select gene_id, 'baseline_score' family, 'baseline_score' candidate, b0 score from bon
 union all select gene_id, 'region', concat('region__beta_',b), z+b*rg from bon, bt
 union all select gene_id, 'repeat', concat('repeat__beta_',b), z+b*rp from bon, bt
 union all select gene_id, 'hairpin', concat('hairpin__beta_',b), z+b*hp from bon, bt
 union all select gene_id, 'all_context', concat('all_context__beta_region_',x.b,'__beta_repeat_',y.b,'__beta_hairpin_',w.b), z+x.b*rg+y.b*rp+w.b*hp from bon, bt x, bt y, bt w)"""
).replace("bon as materialized", "bt as (select unnest([0.1e0,0.5e0]) b), bon as materialized")


@query("candidate_grid", with_views("scored", "select gene_id, family, candidate, round(score,6)+0e0 as score from grid", GRID_CTE))
def candidate_grid(v):
    out = C.context_candidates(C.context_bonuses(toy_context(v)), BETAS)
    return out.withColumn("score", rounded("score"))


def grid_scores(v, stored=True):
    """The candidates' scores; ``stored=False`` is for a job that stores them itself."""
    grid = C.context_candidates(C.context_bonuses(toy_context(v)), BETAS)
    grid = grid.withColumn("score", rounded("score", 9))
    return durable(grid) if stored else grid


@query(
    "oracle_grid",
    with_views(
        "scored truth",
        report_sql(
            "family, candidate",
            """select family, candidate, k, count(*) m, count(t.gene_id) n, count(*) filter (rk<=k and t.gene_id is not null) hits from
 (select *, row_number() over (partition by family, candidate order by round(score,9) desc nulls last, gene_id) rk from grid)
 cross join (select cast(unnest([50,100,200,500,1000]) as integer) k) left join truth t using (gene_id) group by 1,2,3""",
        ),
        GRID_CTE,
    ),
)
def oracle_grid(v):
    rows = E.topk_enrichment(grid_scores(v), v.truth(), "score", KS, ["family", "candidate"])
    return enrichment_report(rows, ["family", "candidate"])


@query(
    "oracle_best",
    with_views(
        "scored truth",
        """select family, candidate, hits as overlap from (select *, row_number() over (partition by family order by hits desc, candidate) r from
 (select family, candidate, count(*) filter (rk<=200 and gene_id in (select gene_id from truth)) hits from
 (select *, row_number() over (partition by family, candidate order by round(score,9) desc nulls last, gene_id) rk from grid) group by 1,2)) where r=1""",
        GRID_CTE,
    ),
)
def oracle_best(v):
    rows = E.topk_enrichment(grid_scores(v), v.truth(), "score", (200,), ["family", "candidate"])
    best = E.pick_first(rows, ["family"], [F.col("overlap").desc(), F.col("candidate")])
    return best.select("family", "candidate", "overlap")


@query(
    "context_calibration",
    with_views(
        "scored truth",
        """select cast(seed as integer) as seed, family, candidate, hits as overlap, k as top_k, round(recall,6) as recall from ev2 join pick using (seed, family, candidate) where role='heldout'""",
        GRID_CTE
        + f""", tg as (select gene_id from truth semi join one using (gene_id)),
sp as materialized (select seed, gene_id, if(row_number() over (partition by seed order by md5(concat(seed,':',gene_id)), gene_id) <=
    least(greatest(round_even(count(*) over (partition by seed)*0.7e0,0),1),count(*) over (partition by seed)-1),'calibration','heldout') as role
  from tg, (select unnest([11,12,13,14,15]) seed)),
nt as (select seed, role, count(*) n from sp group by 1,2),
rg as materialized (select *, row_number() over (partition by family, candidate order by round(score,9) desc nulls last, gene_id) rk, count(*) over (partition by family, candidate) m from grid),
ev2 as materialized (select *, hits/cast(n as double) recall, hits*m/(least(k,m)*cast(n as double)) fold, {p_sql(d='least(k,m)')} lp from (select family, candidate, seed, role, k, m, n, count(*) filter (rk<=k) hits
  from rg join sp using (gene_id) join nt using (seed, role) cross join (select cast(unnest([50,100,200,500,1000]) as integer) k) group by all)),
pick as (select seed, family, candidate from (select *, row_number() over (partition by seed, family order by p2 desc nulls last, o2 desc, f2 desc nulls last, o5 desc, candidate) r from
  (select seed, family, candidate, max(lp) filter (k=200) p2, max(hits) filter (k=200) o2, max(fold) filter (k=200) f2, max(hits) filter (k=500) o5 from ev2 where role='calibration' group by 1,2,3)) where r=1)""",
    ),
)
def context_calibration(v):
    out = context_calibration_job(grid_scores(v, stored=False), v.truth(), SEEDS, ks=KS)
    return out["heldout"].select("seed", "family", "candidate", "overlap", "top_k", rounded("recall").alias("recall"))


@query(
    "hairpin_gene_means",
    with_views(
        "tx_top3",
        f"""select gene_id, round(avg(stem_like_score),6) as top3_stem_like_score_mean, round(avg(paired_run_density),6) as top3_paired_run_density_mean,
  round(avg(max_local_paired_mean_41nt),6) as top3_max_local_paired_mean_41nt_mean, round(max(stem_like_score),6) as max_stem_like_score
from tx_top3 join ({SQL['hairpin_features']}) h using (transcript_id, window_start) group by 1""",
    ),
)
def hairpin_gene_means(v):
    top = G.top_windows(v.tx_scores(), "base_score", 3, ties=("transcript_id", "window_start"))
    rows = FT.hairpin_columns(v.pairing(top), "paired")
    rows = rows.withColumns({c: rounded(c) for c in ("stem_like_score", "paired_run_density", "max_local_paired_mean_41nt")})
    out = FT.gene_means(
        rows,
        {f"top3_{c}_mean": F.col(c) for c in ("stem_like_score", "paired_run_density", "max_local_paired_mean_41nt")},
        {"max_stem_like_score": F.col("stem_like_score")},
    )
    return out.select("gene_id", *[rounded(c).alias(c) for c in out.columns if c != "gene_id"])


@query(
    "repeat_gene_means",
    with_views(
        "tx_top3",
        f"""select gene_id, round(avg(inverted_repeat_score),6) as top3_inverted_repeat_score_mean, round(avg(self_complementarity_score),6) as top3_self_complementarity_score_mean
from tx_top3 join ({SQL['repeat_features']}) h on h.seq_md5=md5(rna_seq) group by 1""",
    ),
)
def repeat_gene_means(v):
    top = durable(G.top_windows(v.tx_scores(), "base_score", 3, ties=("transcript_id", "window_start")))
    rows = add_repeat_features(top)
    names = ("inverted_repeat_score", "self_complementarity_score")
    rows = rows.withColumns({c: rounded(c) for c in names})
    out = FT.gene_means(rows, {f"top3_{c}_mean": F.col(c) for c in names}, {})
    return out.select("gene_id", *[rounded(c).alias(c) for c in out.columns if c != "gene_id"])


@query(
    "bias_report",
    with_views(
        "scored truth",
        report_sql(
            "comparison, pearson, spearman",
            f"""select comparison, pearson, spearman, k, count(*) m, count(t.gene_id) n, count(*) filter (rk<=k and t.gene_id is not null) hits
 from rkd join co using (comparison) cross join {K_SQL} left join truth t using (gene_id) group by 1,2,3,4""",
        ),
        BIN_CTE
        + """, cmp as (select gene_id, n_windows, 'raw' comparison, top3_mean_score s from adj union all select gene_id, n_windows, 'bin_adjusted', pct from adj),
rkd as materialized (select *, row_number() over (partition by comparison order by s desc nulls last, gene_id) rk,
   rank() over (partition by comparison, s is null order by n_windows) + (count(*) over (partition by comparison, s is null, n_windows)-1)/2e0 rx,
   rank() over (partition by comparison order by s nulls last) + (count(*) over (partition by comparison, s)-1)/2e0 ry from cmp),
co as (select comparison, round(corr(n_windows,s),6)+0e0 pearson, round(corr(rx,ry) filter (s is not null),6)+0e0 spearman from rkd group by 1)""",
    ),
)
def bias_report(v):
    out = jobs.bias_report(one_protein(v), v.truth())
    out = out.withColumns({c: rounded(c) for c in ("pearson", "spearman")})
    return enrichment_report(out, ["comparison", "pearson", "spearman"])
