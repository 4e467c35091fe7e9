"""Queries on the evaluation of motif models: training flags, metrics over a chosen k, and summaries by family and model."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.motifs import _FAM, _STATUS, CLUSTER_CTE, group_sql, words
from seqrank.catalog.registry import query
from seqrank.functions import labels as L
from seqrank.functions.numeric import rounded
from seqrank.functions.sequence import kmer_text
from seqrank.operators import clusters as K
from seqrank.session import durable

NAMES = "'w1','w2','w3','w4','w5','w6','AtAPUM5','AtAPUM6','AtAPUM23','AtCPSF30','AtGRP7','AtGRP8','OsDRB1','AtAGO1','AtDCL4','AtPPR2','AtFPA','AtHLP1','AtCFIm25','OsHYL1','NP1','NP2','NP3','NP4','NP5'"
EXPECTED = "'UC-rich','PUF_like_UGUA_UUGA','A_rich_polyA','U-rich','PPR_long_target_control','dsRNA_structure_control','G-rich'"
MODELS = ["mA", "mN", "mR"]

_KMER = "translate(array_to_string(list_transform(range(6,-1,-1), lambda j: cast((x//(4**j)::bigint)%4 as varchar)),''),'0123','ACGU')"
_PROTEINS = f"""pr as materialized (select i, rbp_id, expected_motif_type, {_FAM} protein_family from
 (select i, rbp_id, expected_motif_type, rbp_id protein, rbp_id t from (select i, ([{NAMES}])[1+i] rbp_id, ([{EXPECTED}])[1+i%7] expected_motif_type from (select distinct s_suppkey%25 i from supplier)))),
tk as materialized (select rbp_id, if(i%3=0, substr(kmer,1,6), kmer) kmer, max(d) truth_score, max(u) use_for_training from
 (select i, d, u, {_KMER} kmer from (select l_suppkey%25 i, (l_orderkey*31+l_partkey*17+l_suppkey) % 16384 x, l_discount d, if(l_linenumber<=l_suppkey%4,1,0) u from lineitem where l_tax>=0.08 and l_discount>0)) join pr using (i) group by 1,2)"""
_SCORES = f""", tp as materialized (select rbp_id, k, kmer, max(t) t from (select rbp_id, length(kmer) k, kmer, truth_score t from tk union all
  select rbp_id, 6, substr(kmer,s,6), truth_score from tk, (select unnest([1,2]) s) where length(kmer)=7) group by 1,2,3),
raw as materialized (select concat('m',l_returnflag) m, rbp_id, x, max(z) z from (select l_returnflag, l_suppkey%25 i, (l_orderkey*7919+l_partkey*104729+l_suppkey*31) % 16384 x,
  (cast(round(l_extendedprice*100) as bigint) % 601)/1e2-3 z from lineitem) join pr using (i) group by 1,2,3),
v7 as materialized (select x, {_KMER} kmer from range(16384) t(x)),
v6 as materialized (select cast(row_number() over (order by kmer)-1 as bigint) x, kmer from (select distinct substr(kmer,1,6) kmer from v7)),
mr as materialized (select m, rbp_id from (select distinct m from raw), pr),
d7 as materialized (select m, rbp_id, v7.x, v7.kmer, coalesce(z,-5e0) score from mr cross join v7 left join raw using (m, rbp_id, x)),
d6 as materialized (select m, rbp_id, v6.x, kmer, score from (select m, rbp_id, substr(kmer,s,6) kmer, max(score) score from d7, (select unnest([1,2]) s) group by 1,2,3) join v6 using (kmer)),
dk as materialized (select m, rbp_id, 7 k, x, kmer, score from d7 union all select m, rbp_id, 6, x, kmer, score from d6),
mk as materialized (select rbp_id, coalesce(max(if(k=7 and t>0,7,6)),6) metric_k from pr left join tp using (rbp_id) group by 1)"""
_ROWS = f""", met as (select m, rbp_id, count(*) filter (t>0) nt, corr(score,t) pe, corr(rs,rt) sp, count(*) filter (t>0 and rk<=20) o20, count(*) filter (t>0 and rk<=50) o50, count(*) filter (t>0 and rk<=100) o100,
  avg(rk/n::double) filter (t>0 and nth<=20) pc, min(rk) filter (t>0) br from
 (select *, row_number() over (w order by score desc, x) rk, sum(if(t>0,1,0)) over (w order by x) nth, count(*) over w n,
   rank() over (w order by score)+(count(*) over (partition by m,rbp_id,score)-1)/2e0 rs, rank() over (w order by t)+(count(*) over (partition by m,rbp_id,t)-1)/2e0 rt
  from (select d.*, coalesce(tp.t,0e0) t from (select dk.* from dk join mk on dk.rbp_id=mk.rbp_id and k=metric_k) d left join tp using (rbp_id,k,kmer)) window w as (partition by m, rbp_id)) group by 1,2),
dom as (select m, rbp_id, g predicted_motif_group, c/20e0 prediction_confidence from (select *, row_number() over (partition by m,rbp_id order by c desc, f) r from
 (select m, rbp_id, g, count(*) c, min(rk) f from (select *, {group_sql('kmer')} g, row_number() over (partition by m,rbp_id order by score desc, x) rk from d7) where rk<=20 group by 1,2,3)) where r=1),
ev as materialized (select m, rbp_id, protein_family, expected_motif_type, metric_k, met.*exclude(m,rbp_id), predicted_motif_group, prediction_confidence,
  case when expected_motif_type='U-rich' then 'expected_U_UC_family' when expected_motif_type in ('dsRNA_structure_control') then 'not_applicable_control' else {_STATUS} end collapse_status,
  expected_motif_type not in ('U-rich','UC-rich','PPR_long_target_control','dsRNA_structure_control') judged,
  if(expected_motif_type not in ('U-rich','UC-rich','PPR_long_target_control','dsRNA_structure_control') and predicted_motif_group not in ('U-rich','UC-rich'),1,0) non_u_uc_recovery
 from mr join pr using (rbp_id) join mk using (rbp_id) left join met using (m, rbp_id) left join dom using (m, rbp_id))"""
_FLAGS = """, fl as (select rbp_id, protein_family, c control_only, s strict_train, case when s=1 and rbp_id in ('w6','AtAPUM23') then 'validation' when s=1 then 'train' else 'none' end split,
  if(protein_family<>'unknown' and not (s=1 and rbp_id in ('w6','AtAPUM23')),1,0) class_pool from (select *, if(c=0 and coalesce(u,0)=1,1,0) s from
 (select rbp_id, protein_family, if(protein_family in ('PPR_control','dsRNA_control','AGO_control','DICER_control','other_control') or rbp_id in ('AtGRP7','AtGRP8','w5'),1,0) c from pr)
 left join (select rbp_id, max(use_for_training) u from tk group by 1) using (rbp_id)))"""


def proteins(v):
    i = v.table("supplier").selectExpr("s_suppkey % 25 i").distinct()
    p = i.selectExpr("i", f"element_at(array({NAMES}), cast(1+i as int)) rbp_id", f"element_at(array({EXPECTED}), cast(1+i%7 as int)) expected_motif_type")
    return p.withColumn("protein_family", L.family_bucket("rbp_id", F.lit(""), F.lit("")))


def truth_rows(v):
    lines = v.table("lineitem").where("l_tax >= 0.08 and l_discount > 0")
    rows = lines.selectExpr("l_suppkey % 25 i", "(l_orderkey*31+l_partkey*17+l_suppkey) % 16384 x", "l_discount d", "if(l_linenumber<=l_suppkey%4,1,0) u")
    word = kmer_text("x", 7)
    rows = rows.withColumn("kmer", F.when(F.col("i") % 3 == 0, F.substring(word, 1, 6)).otherwise(word)).join(proteins(v), "i")
    return rows.groupBy("rbp_id", "kmer").agg(F.max("d").alias("truth_score"), F.max("u").alias("use_for_training"))


def model_scores(v):
    """Dense scores of three models for all proteins, k = 6 and 7."""
    lines = v.table("lineitem").selectExpr(
        "concat('m',l_returnflag) m", "l_suppkey % 25 i", "(l_orderkey*7919+l_partkey*104729+l_suppkey*31) % 16384 x", "(cast(round(l_extendedprice*100) as bigint) % 601)/1e2-3 z"
    )
    raw = lines.join(proteins(v), "i").groupBy("m", "rbp_id", "x").agg(F.max("z").alias("score"))
    raw = raw.select(F.struct(F.col("m").alias("model_version"), "rbp_id").alias("pair"), kmer_text("x", 7).alias("kmer"), "score")
    seven = durable(K.fill_vocabulary(raw, 7, "pair"))
    six = K.six_from_seven(seven, "pair")
    both = seven.withColumn("k", F.lit(7)).unionByName(six.withColumn("k", F.lit(6)))
    return durable(both.select("pair.*", "k", "kmer_idx", "kmer", "score"))


def evaluated(v):
    truth = K.truth_profile(truth_rows(v))
    return K.evaluate_models(model_scores(v), truth, proteins(v).drop("i"))


@query("motif_splits", f"with {_PROTEINS}{_FLAGS} select * from fl")
def motif_splits(v):
    return K.training_flags(proteins(v), truth_rows(v))


@query(
    "evaluation_rows",
    f"""with {_PROTEINS}{_SCORES}{_ROWS} select m as model_version, rbp_id, protein_family, expected_motif_type, metric_k, if(nt>0,round(pe,6)+0e0,null) as pearson, if(nt>0,round(sp,6)+0e0,null) as spearman,
 if(nt>0,o20,null) as top20_overlap, if(nt>0,o50,null) as top50_overlap, if(nt>0,o100,null) as top100_overlap, round(pc,6) as truth_mean_rank_percentile, cast(br as integer) as best_truth_rank,
 predicted_motif_group, round(prediction_confidence,6) as prediction_confidence, collapse_status, non_u_uc_recovery, if(rbp_id='w5',1,0) as hard_failure_tracking from ev""",
)
def evaluation_rows(v):
    out = evaluated(v)
    return out.withColumns({c: rounded(c) for c in ("pearson", "spearman", "truth_mean_rank_percentile", "prediction_confidence")})


@query(
    "family_summary",
    f"""with {_PROTEINS}{_SCORES}{_ROWS}{_FLAGS} select protein_family, count(distinct rbp_id) as n_rbps, count(distinct rbp_id) as n_with_embedding, any_value(n_strict) as n_strict_truth, """
    + ", ".join(
        f"round(avg(if(collapse_status='collapsed_to_U_UC',1e0,0e0)) filter (m='{m}'),6) as \"{m}_collapse_rate\", round(avg(non_u_uc_recovery) filter (m='{m}' and judged),6) as \"{m}_non_u_recovery_rate\""
        for m in MODELS
    )
    + """, if(protein_family='RBNS_lab', round(avg(if(predicted_motif_group in ('U-rich','UC-rich'),1e0,0e0)) filter (m='mR' and rbp_id in ('w1','w2','w3','w4','w6')),6), null) as good_case_retention,
 case when protein_family='PUF/APUM' then 'main failure family; prior fallback improves but leave-family-out remains weak' when protein_family='polyA_processing' then 'truth shortage and complex-level signal ambiguity'
  when protein_family in ('PPR_control','dsRNA_control','AGO_control','DICER_control') then 'control family not suitable for strict linear motif loss' else 'mixed' end as major_failure_mode
 from ev join (select protein_family, cast(sum(strict_train) as bigint) n_strict from fl group by 1) using (protein_family) group by 1""",
)
def family_summary(v):
    out = K.family_summary(evaluated(v), K.training_flags(proteins(v), truth_rows(v)), MODELS, "mR")
    return out.withColumns({c: rounded(c) for c in out.columns if c.endswith("_rate") or c == "good_case_retention"})


def token_clusters(v):
    """Every word of the documents is a motif of the protein that its length numbers."""
    tokens = words(v).select("token").distinct().withColumn("rbp_id", F.expr(f"element_at(array({NAMES}), cast(1+length(token)%25 as int))"))
    return durable(K.clusters(tokens, (6, 7)))


_CLUSTERS = (
    ", "
    + CLUSTER_CTE
    + f""", tc as materialized (select ([{NAMES}])[1+length(token)%25] rbp_id, * from uc),
rkd as materialized (select *, row_number() over (partition by m, rbp_id, k order by score desc, x) rk from dk),
mem as materialized (select rkd.*, tc.w from rkd join tc using (rbp_id, k, kmer)),
ck as materialized (select m, rbp_id, k, sum(if(rk<=100,w,0))/sum(w) rec, sum(rk*w)/sum(w) mr, min(rk) br, max(auc) auc from mem join
 (select m, rbp_id, k, sum(tp*(cfp-fp/2e0))/nullif(max(P)*max(N),0) auc from (select *, sum(fp) over (partition by m,rbp_id,k order by score) cfp, sum(tp) over (partition by m,rbp_id,k) P, sum(fp) over (partition by m,rbp_id,k) N
   from (select m, rbp_id, k, score, count(*) filter (y=1) tp, count(*) filter (y=0) fp from (select m, rbp_id, k, score, 1 y from mem union all select m, rbp_id, k, score, 0 from rkd semi join mem using (m,rbp_id,k) anti join mem using (m,rbp_id,k,kmer)) group by 1,2,3,4))
  group by 1,2,3) using (m, rbp_id, k) group by 1,2,3),
cm as materialized (select m, rbp_id, avg(rec) rec, avg(mr) mr, min(br) br, avg(auc) auc from ck group by 1,2)"""
)


@query(
    "cluster_metrics_over_k",
    f"""with {_PROTEINS}{_SCORES}{_CLUSTERS} select m as model_version, rbp_id, round(rec,6) as cluster_topk_recovery, round(mr,4)+0e0 as cluster_mean_rank, cast(br as integer) as cluster_best_rank, round(auc,6) as cluster_auc from cm""",
)
def cluster_metrics_over_k(v):
    out = K.cluster_metrics_over_k(model_scores(v), token_clusters(v), ("model_version", "rbp_id"))
    out = out.withColumn("cluster_mean_rank", rounded("cluster_mean_rank", 4))
    return out.withColumns({c: rounded(c) for c in ("cluster_topk_recovery", "cluster_auc")})


@query(
    "model_comparison",
    f"""with {_PROTEINS}{_SCORES}{_ROWS}{_CLUSTERS} select m as model_version, count(*) as n_eval_rbps, round(avg(if(collapse_status='collapsed_to_U_UC',1e0,0e0)) filter (judged),6) as u_uc_rich_collapse_rate,
 round(avg(non_u_uc_recovery) filter (judged),6) as non_u_uc_recovery_rate, round(avg(if(predicted_motif_group in ('U-rich','UC-rich'),1e0,0e0)) filter (rbp_id in ('w1','w2','w3','w4','w6')),6) as good_case_retention_rate,
 string_agg(predicted_motif_group, ',') filter (rbp_id='AtCPSF30') as reported_protein_group, round(avg(auc) filter (rbp_id in ('AtAPUM5','AtAPUM6','AtAPUM23')),6) as pumilio_mean_cluster_auc
 from ev left join cm using (m, rbp_id) group by 1""",
)
def model_comparison(v):
    scores = model_scores(v)
    rows = K.evaluate_models(scores, K.truth_profile(truth_rows(v)), proteins(v).drop("i"))
    named = scores.where(F.col("rbp_id").isin(L.PUMILIO_PROTEINS))
    out = K.model_comparison(rows, K.cluster_metrics_over_k(named, token_clusters(v), ("model_version", "rbp_id")))
    return out.withColumns({c: rounded(c) for c in out.columns if c.endswith(("_rate", "_auc"))})
