"""Queries on motif labels, clusters and profile quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.inputs import with_views
from seqrank.catalog.registry import query
from seqrank.catalog.scores import KMER_CTE, named_profiles
from seqrank.functions import labels as L
from seqrank.functions.numeric import rounded
from seqrank.functions.sequence import kmer_text
from seqrank.operators import clusters as K
from seqrank.operators.bias import inverse_frequency_weights
from seqrank.session import durable


def group_sql(x: str) -> str:
    def n(letters: str) -> str:
        return f"(length({x})-length(translate({x},'{letters}','')))"

    return f"""case when contains({x},'UGUA') or contains({x},'UUGA') then 'PUF_like_UGUA_UUGA' when contains({x},'AAUAAA') or contains({x},'AUUAAA') then 'A_rich_polyA'
 when {n('UC')}>=greatest(4,ceil(length({x})*0.75e0)) then 'UC-rich' when {n('U')}>=greatest(3,ceil(length({x})*0.55e0)) then 'U-rich'
 when {n('A')}>=greatest(3,ceil(length({x})*0.55e0)) then 'A-rich' when {n('G')}>=greatest(3,ceil(length({x})*0.45e0)) then 'G-rich' else 'Other' end"""


@query("motif_group", with_views("profiles", f"select rbp_id, kmer, {group_sql('kmer')} as motif_group from kp", KMER_CTE))
def motif_group(v):
    return named_profiles(v).select("rbp_id", "kmer", L.motif_group("kmer").alias("motif_group"))


_SPECIES = "['ARATH','ORYSJ','YEAST','HUMAN','ECOLI','MAIZE','drome','SCHPO']"
_NAMES = "['GRP7','AGO1','HYL1','LOC_Os05g24160.1','AtAPUM5','DCL4','CPSF30','AGO18','PUM2']"
_EXPECT = "['UC-rich','UGUA core','polyA signal','U-rich','PPR long','structure','diagnostic','CFIm','','G-rich','AGO guide']"
PROTEIN_SQL = f"""select p_partkey, concat(({_SPECIES})[1+p_partkey%8],'|',({_NAMES})[1+p_size%9],'|',p_brand) raw, ({_EXPECT})[1+(p_partkey//7)%11] expected, p_type family from part"""


def proteins(v):
    def pick(values: str, i: str) -> str:
        return f"element_at(array({values.strip('[]')}), cast(1+{i} as int))"

    return v.table("part").selectExpr(
        "p_partkey",
        f"concat({pick(_SPECIES, 'p_partkey%8')},'|',{pick(_NAMES, 'p_size%9')},'|',p_brand) raw",
        f"{pick(_EXPECT, '(p_partkey div 7)%11')} expected",
        "p_type family",
    )


_KING = "case when upper(split_part(raw,'|',1)) in ('ARATH','ORYSJ','ORYSA','MAIZE','SOLLC') then 1 when upper(split_part(raw,'|',1)) in ('YEAST','SCHPO','CANAL','ASPOR','NEUCR') then 2 when upper(split_part(raw,'|',1)) in ('HUMAN','MOUSE','DROME','CAEEL','DANRE','XENLA') then 0 else 3 end"
_CANON = """case when split_part(raw,'|',2) like 'At%' then split_part(raw,'|',2) when split_part(raw,'|',2) like 'LOC_Os05g24160%' then 'OsDRB1'
 when split_part(raw,'|',2) like 'AGO%' and split_part(raw,'|',1)='ARATH' then concat('At',split_part(raw,'|',2))
 when split_part(raw,'|',2) like 'AGO%' and split_part(raw,'|',1)='ORYSJ' then concat('Os',split_part(raw,'|',2))
 when split_part(raw,'|',2) in ('GRP7','GRP8','HYL1','DRB4','DCL1','DCL4') then concat(if(split_part(raw,'|',1)='ARATH','At','Os'),split_part(raw,'|',2),if(split_part(raw,'|',2)='HYL1','_DRB1',''))
 else raw end"""
_EXP = """case when contains(expected,'PUF') or contains(expected,'UGUA') or contains(expected,'UUGA') then 'PUF_like_UGUA_UUGA' when contains(expected,'AAUAAA') or contains(expected,'polyA') or contains(expected,'A_rich') then 'A_rich_polyA'
 when contains(expected,'CFIm') then 'UGUA_like_CFIm' when contains(expected,'UC') then 'UC-rich' when contains(expected,'U-rich') then 'U-rich' when contains(expected,'PPR') then 'PPR_long_target_control'
 when contains(expected,'DRB') or contains(expected,'HYL1') or contains(expected,'structure') or contains(expected,'AGO') then 'dsRNA_structure_control' when contains(expected,'diagnostic') then 'diagnostic_only'
 when expected='' then 'unknown' else expected end"""


def _any(x: str, marks: list[str]) -> str:
    return " or ".join(f"contains({x},'{m}')" for m in marks)


_FAM = (
    "case when protein like 'w%' then 'RBNS_lab' "
    + " ".join(f"when {_any('t', marks)} then '{label}'" for marks, label in L.FAMILY_MARKS)
    + " else 'unknown' end"
)


@query(
    "kingdom_labels",
    f"""select p_partkey, k as kingdom_code, if(k=1,1,0) as kingdom_older, if(k=3,1,k) as kingdom_label,
 case if(k=3,1,k) when 0 then 'animal' when 1 then 'plant' when 2 then 'fungi' else 'other' end as kingdom_name,
 if(k=3,'fallback_label','query_protein_id_prefix') as kingdom_source,
 case when contains(lower(family),'plant') then 1 when contains(lower(family),'fung') then 2 when contains(lower(family),'animal') then 0 else 3 end as taxonomy_label
from (select *, {_KING} k from ({PROTEIN_SQL}))""",
)
def kingdom_labels(v):
    return proteins(v).select(
        "p_partkey",
        L.kingdom_of_species("raw").alias("kingdom_code"),
        L.kingdom_of_species_older("raw").alias("kingdom_older"),
        *[c.alias(n) for n, c in L.kingdom_with_fallback("raw").items()],
        L.kingdom_of_taxonomy("family").alias("taxonomy_label"),
    )


@query(
    "protein_labels",
    f"""select p_partkey, protein, expected_motif_type, protein_family,
  protein_family in ('PPR_control','dsRNA_control','AGO_control','DICER_control','other_control') or protein in ('AtGRP7','AtGRP8','w5') as control_only
from (select *, {_FAM} protein_family from (select *, concat(family,' ',expected,' ',protein) t, {_EXP} expected_motif_type from (select *, {_CANON} protein from ({PROTEIN_SQL}))))""",
)
def protein_labels(v):
    p = proteins(v).withColumn("protein", L.canonical_protein("raw"))
    p = p.withColumns(
        {"expected_motif_type": L.expected_group("expected"), "protein_family": L.family_bucket("protein", "family", "expected")}
    )
    return p.select("p_partkey", "protein", "expected_motif_type", "protein_family", L.is_control("protein_family", "protein").alias("control_only"))


@query(
    "family_weights",
    """select p_partkey, round(1e0/count(*) over (partition by p_type)/(select count(distinct p_type) from part),9) as sample_weight from part""",
)
def family_weights(v):
    out = inverse_frequency_weights(v.table("part").select("p_partkey", "p_type"), "p_type")
    return out.select("p_partkey", rounded("sample_weight", 9).alias("sample_weight"))


TOKEN_CTE = """tok as materialized (select distinct source rbp_id, translate(unnest(regexp_extract_all(upper(text),'[ACGUTN]{4,16}')),'T','U') token from documents)"""


@query("motif_tokens", f"with {TOKEN_CTE} select rbp_id, token from tok")
def motif_tokens(v):
    return words(v)


def words(v):
    return (
        v.table("documents")
        .select(F.col("source").alias("rbp_id"), F.explode(L.motif_tokens("text")).alias("token"))
        .distinct()
    )


# LIKE with one-letter wildcards finds the k-mers of a degenerate word
CLUSTER_CTE = (
    TOKEN_CTE
    + """, voc as materialized (select k, translate(array_to_string(list_transform(range(k-1,-1,-1), lambda j: cast((i//(4**j)::bigint)%4 as varchar)),''),'0123','ACGU') kmer
  from (select cast(6 as integer) k, unnest(range(4096)) i union all select 7, unnest(range(16384)))),
ut as materialized (select distinct token from tok where token similar to '[ACGUN]+'),
pat as materialized (select distinct token, k, concat(repeat('_',l), replace(token,'N','_'), repeat('_',k-length(token)-l)) p from
    (select token, k, unnest(range(0,k-length(token)+1)) l from ut, (select cast(unnest([6,7]) as integer) k) where length(token)<=k)
  union select distinct token, k, replace(substr(token,i,k),'N','_') from (select token, k, unnest(range(1,length(token)-k+2)) i from ut, (select cast(unnest([6,7]) as integer) k) where length(token)>k)),
core as materialized (select distinct token, c from (select token, substr(token,i,s) c from (select token, s, unnest(range(1,length(token)-s+2)) i from ut, (select unnest([4,5,6]) s) where length(token)>=s)) where not contains(c,'N')),
strong as materialized (select token, k, kmer, max(if(c is null,0.7e0,1e0)) w from (select distinct token, k, kmer from pat join voc using (k) where kmer like p) left join core using (token) where c is null or contains(kmer,c) or not exists (select 1) group by 1,2,3),
strong0 as materialized (select distinct token, k, kmer from pat join voc using (k) where kmer like p),
sw as materialized (select s.token, s.k, s.kmer, coalesce(w,0.7e0) w from strong0 s left join strong using (token,k,kmer)),
near as (select distinct token, k, concat(substr(kmer,1,i-1),b,substr(kmer,i+1)) kmer from (select token, k, kmer, unnest(range(1,k+1)) i from sw), (select unnest(['A','C','G','U']) b)),
uc as materialized (select token, k, kmer, max(w) w from (select * from sw union all select token, k, kmer, 0.35e0 from near) group by 1,2,3),
cl as materialized (select rbp_id, uc.* from tok join uc using (token))"""
)


@query(
    "cluster_expand",
    f"""with {CLUSTER_CTE} select rbp_id, token, k, if(length(token)>7 or contains(token,'N'),'long_or_degenerate_motif','direct_token') as rule_type,
 count(*) filter (w>0.5) as strong_positive_count, count(*) filter (w<0.5) as weak_positive_count from cl group by 1,2,3,4""",
)
def cluster_expand(v):
    return K.cluster_rules(K.clusters(words(v)))


@query(
    "kmer_neighbours",
    with_views(
        "profiles",
        """select rbp_id, kmer, neighbour from (select rbp_id, kmer, concat(substr(kmer,1,i-1),b,substr(kmer,i+1)) neighbour from
 (select rbp_id, kmer, unnest(range(1,8)) i from kp), (select unnest(['A','C','G','U']) b)) where neighbour<>kmer""",
        KMER_CTE,
    ),
)
def kmer_neighbours(v):
    return named_profiles(v).select("rbp_id", "kmer", F.explode(K.hamming_kmers(F.col("kmer"), 7)).alias("neighbour"))


DENSE_CTE = (
    KMER_CTE
    + """, v7 as materialized (select i kmer_idx, translate(array_to_string(list_transform(range(6,-1,-1), lambda j: cast((i//(4**j)::bigint)%4 as varchar)),''),'0123','ACGU') kmer from range(16384) t(i)),
dense as materialized (select r.rbp_id, v7.kmer_idx, v7.kmer, coalesce(p.zscore,-5e0) score from v7 cross join (select distinct rbp_id from profiles) r left join profiles p on p.rbp_id=r.rbp_id and p.kmer_idx=v7.kmer_idx),
tr as materialized (select concat('r',l_returnflag) rbp_id, (l_orderkey*31+l_partkey*17+l_suppkey) % 16384 kmer_idx, max(if(l_tax>=0.08 and l_discount>0,l_discount,0e0)) t from lineitem group by 1,2)"""
)


def dense(v):
    return durable(K.fill_vocabulary(named_profiles(v).withColumnRenamed("zscore", "score"), 7))


def truth_kmers(v):
    return (
        v.table("lineitem")
        .selectExpr(
            "concat('r',l_returnflag) rbp_id", "(l_orderkey*31+l_partkey*17+l_suppkey) % 16384 i", "if(l_tax >= 0.08 and l_discount > 0, l_discount, 0e0) t"
        )
        .groupBy("rbp_id", "i")
        .agg(F.max("t").alias("truth_score"))
        .select("rbp_id", kmer_text("i", 7).alias("kmer"), "truth_score")
    )


@query(
    "profile_metrics",
    with_views(
        "profiles",
        """select rbp_id, round(corr(score,t),6)+0e0 as pearson, round(corr(rs,rt),6)+0e0 as spearman, count(*) filter (t>0 and rk<=20) as top20_overlap,
 count(*) filter (t>0 and rk<=50) as top50_overlap, count(*) filter (t>0 and rk<=100) as top100_overlap,
 round(avg(rk/16384e0) filter (t>0 and nth<=20),6) as truth_mean_rank_percentile, cast(min(rk) filter (t>0) as integer) as best_truth_rank
from (select *, row_number() over (partition by rbp_id order by score desc, kmer_idx) rk, sum(if(t>0,1,0)) over (partition by rbp_id order by kmer_idx) nth,
  rank() over (partition by rbp_id order by score)+(count(*) over (partition by rbp_id,score)-1)/2e0 rs, rank() over (partition by rbp_id order by t)+(count(*) over (partition by rbp_id,t)-1)/2e0 rt
 from (select d.*, coalesce(tr.t,0e0) t from dense d left join tr using (rbp_id,kmer_idx))) group by 1""",
        DENSE_CTE,
    ),
)
def profile_metrics(v):
    out = K.profile_metrics(dense(v), truth_kmers(v))
    return out.withColumns({c: rounded(c) for c in ("pearson", "spearman", "truth_mean_rank_percentile")})


@query(
    "group_mass",
    with_views(
        "profiles",
        f"""select rbp_id, motif_group, round(sum(greatest(score,0))/max(t),6) as mass from (select *, {group_sql('kmer')} motif_group, sum(greatest(score,0)) over (partition by rbp_id) t from dense) group by 1,2""",
        DENSE_CTE,
    ),
)
def group_mass(v):
    return K.group_mass(dense(v)).withColumn("mass", rounded("mass"))


EVAL_CTE = (
    DENSE_CTE
    + f""", dom as materialized (select rbp_id, g predicted_motif_group, c/20e0 prediction_confidence from (select *, row_number() over (partition by rbp_id order by c desc, f) r from
 (select rbp_id, g, count(*) c, min(rk) f from (select *, {group_sql('kmer')} g, row_number() over (partition by rbp_id order by score desc, kmer_idx) rk from dense) where rk<=20 group by 1,2)) where r=1)"""
)
_META = """(select concat('r',f) rbp_id, p_type protein_family, p_brand variant, case when p_size<10 then 'UC-rich' when p_size<20 then 'PPR_long_target_control' when p_size<30 then 'A_rich_polyA' else 'G-rich' end expected_motif_type
 from part, (select unnest(['A','N','R']) f))"""
_STATUS = "case when expected_motif_type='UC-rich' then 'expected_U_UC_family' when expected_motif_type='PPR_long_target_control' then 'not_applicable_control' when predicted_motif_group in ('U-rich','UC-rich') then 'collapsed_to_U_UC' else 'not_collapsed' end"


@query("dominant_group", with_views("profiles", "select rbp_id, predicted_motif_group, round(prediction_confidence,6) as prediction_confidence from dom", EVAL_CTE))
def dominant_group(v):
    return K.dominant_group(dense(v)).withColumn("prediction_confidence", rounded("prediction_confidence"))


@query(
    "collapse_summary",
    with_views(
        "profiles",
        f"""select protein_family, rbp_id, count(*) as n_rbps, round(avg(x),6) as collapse_rate, round(avg(x) filter (j),6) as judged_collapse_rate, round(avg(y) filter (j),6) as non_u_recovery_rate
from (select *, if({_STATUS}='collapsed_to_U_UC',1e0,0e0) x, if(expected_motif_type not in ('UC-rich','PPR_long_target_control') and predicted_motif_group not in ('U-rich','UC-rich'),1e0,0e0) y,
  expected_motif_type not in ('UC-rich','PPR_long_target_control') j from {_META} join dom using (rbp_id)) group by 1,2""",
        EVAL_CTE,
    ),
)
def collapse_summary(v):
    scores = dense(v)
    meta = v.table("part").selectExpr(
        "explode(array('rA','rN','rR')) rbp_id",
        "p_type protein_family",
        "case when p_size<10 then 'UC-rich' when p_size<20 then 'PPR_long_target_control' when p_size<30 then 'A_rich_polyA' else 'G-rich' end expected_motif_type",
    )
    rows = K.evaluation_rows(K.profile_metrics(scores, truth_kmers(v)), K.dominant_group(scores), meta)
    out = K.collapse_summary(rows, ["protein_family", "rbp_id"])
    return out.withColumns({c: rounded(c) for c in ("collapse_rate", "judged_collapse_rate", "non_u_recovery_rate")})


@query(
    "six_from_seven",
    with_views(
        "profiles",
        """select rbp_id, kmer, round(max(z),6)+0e0 as score from (select rbp_id, substr(kmer,1,6) kmer, zscore z from kp union all select rbp_id, substr(kmer,2,6), zscore from kp) group by 1,2""",
        KMER_CTE,
    ),
)
def six_from_seven(v):
    out = K.six_from_seven(named_profiles(v), value="zscore", missing=None)
    return out.select("rbp_id", "kmer", rounded("zscore").alias("score"))


@query(
    "sparse_profile",
    with_views(
        "profiles",
        """select rbp_id, k, kmer, round(2-0.05e0*r,6) as score from (
 select rbp_id, 7 as k, kmer, rank r from t7 union all
 select rbp_id, 6, kmer, row_number() over (partition by rbp_id order by o) from (select rbp_id, kmer, min(o) o from (select rbp_id, substr(kmer,1,6) kmer, rank*2 o from t7 union all select rbp_id, substr(kmer,2,6), rank*2+1 from t7) group by 1,2) qualify row_number() over (partition by rbp_id order by o)<=10)""",
        KMER_CTE + ", t7 as materialized (select * from (select *, row_number() over (partition by rbp_id order by zscore desc nulls last, kmer) rank from kp) where rank<=10)",
    ),
)
def sparse_profile(v):
    from seqrank.operators.motif import extremes

    top = extremes(named_profiles(v), n=10).where("direction = 'positive'")
    return K.sparse_profile(top).select("rbp_id", "k", "kmer", rounded("score").alias("score"))


@query(
    "cluster_metrics",
    with_views(
        "profiles",
        f"""select rbp_id, round(sum(if(rk<=100,w,0))/sum(w),6) as cluster_topk_recovery, round(sum(rk*w)/sum(w),4)+0e0 as cluster_mean_rank, cast(min(rk) as integer) as cluster_best_rank, round(if(isnan(max(auc)),null,max(auc)),6) as cluster_auc
from mem join (select rbp_id, sum(tp*(cfp-fp/2e0))/(max(P)*max(N)) auc from (select *, sum(fp) over (partition by rbp_id order by score) cfp, sum(tp) over (partition by rbp_id) P, sum(fp) over (partition by rbp_id) N
   from (select rbp_id, score, count(*) filter (y=1) tp, count(*) filter (y=0) fp from (select rbp_id, score, 1 y from mem union all select rbp_id, score, 0 from rkd anti join mem using (rbp_id,kmer)) group by 1,2)) group by 1) using (rbp_id) group by 1""",
        DENSE_CTE
        + ", "
        + CLUSTER_CTE
        + """, rkd as materialized (select *, row_number() over (partition by rbp_id order by score desc, kmer_idx) rk from dense),
mem as materialized (select rkd.*, uc.w from rkd join uc using (kmer) where uc.k=7 and rkd.rbp_id=case when length(uc.token)>=7 then 'rA' when length(uc.token)>=5 then 'rN' else 'rR' end)""",
    ),
)
def cluster_metrics(v):
    pooled = words(v).select("token").distinct().withColumn("rbp_id", F.expr("case when length(token)>=7 then 'rA' when length(token)>=5 then 'rN' else 'rR' end"))
    out = K.cluster_metrics(dense(v), durable(K.clusters(pooled, (7,))))
    out = out.withColumn("cluster_mean_rank", rounded("cluster_mean_rank", 4))
    return out.withColumns({c: rounded(c) for c in ("cluster_topk_recovery", "cluster_auc")})


@query(
    "truth_profile",
    with_views(
        "",
        """select rbp_id, cast(k as integer) as k, kmer, round(max(t),6) as truth_score from (select rbp_id, 7 k, kmer, t from tk union all select rbp_id, 6, substr(kmer,1,6), t from tk union all select rbp_id, 6, substr(kmer,2,6), t from tk) group by 1,2,3""",
        """tk as materialized (select rbp_id, t, translate(array_to_string(list_transform(range(6,-1,-1), lambda j: cast((kmer_idx//(4**j)::bigint)%4 as varchar)),''),'0123','ACGU') kmer from
 (select concat('r',l_returnflag) rbp_id, (l_orderkey*31+l_partkey*17+l_suppkey) % 16384 kmer_idx, max(if(l_tax>=0.08 and l_discount>0,l_discount,0e0)) t from lineitem group by 1,2))""",
    ),
)
def truth_profile(v):
    return K.truth_profile(truth_kmers(v)).withColumn("truth_score", rounded("truth_score"))


@query(
    "reconstruction_metrics",
    with_views(
        "",
        """select round(sum(l)/sum(n),6) as smooth_l1, round(avg(r),6)+0e0 as mean_profile_pearson from (select p, sum(if(m,if(d<1,0.5e0*d*d,d-0.5e0),0)) l, count(*) filter (m) n, corr(a,b) filter (m) r
from (select l_suppkey p, l_discount*20 a, l_tax*30 b, abs(l_discount*20-l_tax*30) d, l_linenumber<>7 m from lineitem) group by 1)""",
    ),
)
def reconstruction_metrics(v):
    pairs = v.table("lineitem").selectExpr("l_suppkey profile_id", "l_discount*20 predicted", "l_tax*30 target", "l_linenumber<>7 mask")
    return K.reconstruction_metrics(pairs).select(rounded("smooth_l1").alias("smooth_l1"), rounded("mean_profile_pearson").alias("mean_profile_pearson"))
