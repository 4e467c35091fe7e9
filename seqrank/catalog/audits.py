"""Queries on vectors, neighbours and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.inputs import with_views
from seqrank.catalog.registry import query
from seqrank.catalog.scores import KMER_CTE, named_profiles
from seqrank.functions.numeric import rounded
from seqrank.operators import audit as Q
from seqrank.operators import neighbours as N
from seqrank.operators.bias import value_table, zero_fraction
from seqrank.operators.motif import extremes
from seqrank.operators.ranking import rank_rows, text_number
from seqrank.session import durable

KEY = ["transcript_id", "window_start"]


@query(
    "standardised_vectors",
    """with c as (select vec_id, label, unnest(embedding) x, generate_subscripts(embedding,1) i from embeddings),
s as (select i, avg(x) mu, stddev_pop(x) sd from c where label<8 group by 1)
select vec_id, round(sum(z),4)+0e0 as total, round(max(z),6)+0e0 as largest, round(min(z),6)+0e0 as smallest from
 (select vec_id, greatest(least((x-mu)/if(sd>=1e-6,sd,1e0),2),-2) z from c join s using (i)) group by 1""",
)
def standardised_vectors(v):
    e = v.table("embeddings")
    out = N.standardise(e, e.where("label < 8"), limit=2.0)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "vec_id",
        rounded(total, 4).alias("total"),
        rounded(F.array_max("embedding")).alias("largest"),
        rounded(F.array_min("embedding")).alias("smallest"),
    )


COS_CTE = """v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x*x))) l from v),
top as materialized (select * from (select q.vec_id query_id, r.vec_id reference_id, round(list_dot_product(q.e,r.e)/(q.l*r.l),9) cosine,
  row_number() over (partition by q.vec_id order by round(list_dot_product(q.e,r.e)/(q.l*r.l),9) desc, r.vec_id) rank from n q, n r where q.label>=8 and r.label<8) where rank<=12)"""


def neighbours(v, k=12):
    e = v.table("embeddings")
    q = e.where("label >= 8").withColumnRenamed("vec_id", "query_id")
    r = e.where("label < 8").withColumnRenamed("vec_id", "reference_id")
    return N.nearest(q, r, k)


@query("cosine_topk", f"with {COS_CTE} select query_id, reference_id, round(cosine,6)+0e0 as cosine, cast(rank as integer) as rank from top")
def cosine_topk(v):
    return neighbours(v).withColumn("cosine", rounded("cosine"))


BLEND_CTE = (
    COS_CTE
    + """, prof as materialized (select vec_id, concat('k',i) kmer, cast(x as double) z from (select vec_id, unnest(embedding) x, generate_subscripts(embedding,1) i from embeddings)),
pri as (select query_id, kmer, sum(greatest(cosine,0)*z)/nullif(sum(greatest(cosine,0)),0) prior from top join prof on vec_id=reference_id group by 1,2)"""
)


@query(
    "profile_blend",
    f"""with {BLEND_CTE} select p.vec_id as protein_id, p.kmer, round(if(prior is null,p.z,(1-0.4e0)*p.z+0.4e0*prior),6)+0e0 as zscore, if(prior is null,0e0,0.4e0) as alpha
from prof p left join pri on pri.query_id=p.vec_id and pri.kmer=p.kmer""",
)
def profile_blend(v):
    cells = v.table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    prof = cells.select("vec_id", F.concat(F.lit("k"), F.col("i") + 1).alias("kmer"), F.col("x").cast("double").alias("zscore"))
    prior = N.neighbour_profile(neighbours(v), prof.withColumnRenamed("vec_id", "profile_id"))
    prior = prior.withColumnRenamed("query_id", "protein_id").withColumn("alpha", F.lit(0.4))
    out = N.blend_profiles(prof.withColumnRenamed("vec_id", "protein_id"), prior)
    return out.withColumn("zscore", rounded("zscore"))


@query(
    "signature_count",
    f"""with {COS_CTE}, per as (select query_id, string_agg(cast(reference_id%5 as varchar),'|' order by rank) signature, bool_or(cosine<0) c from top where rank<=2 group by 1)
select query_id as protein_id, signature, coalesce(n,0) as shared_proteins from per left join (select signature, count(*) n from per where not c group by 1) using (signature)""",
)
def signature_count(v):
    top = neighbours(v).select(
        F.col("query_id").alias("protein_id"),
        F.col("rank").alias("prior_rank"),
        (F.col("reference_id") % 5).alias("prior_id"),
        (F.col("cosine") < 0).alias("has_conflict"),
    )
    return N.shared_signatures(top, 2).select("protein_id", "signature", "shared_proteins")


TEACH_SQL = """(select l_suppkey protein_id, l_orderkey*1000+l_linenumber*100+cast(l_quantity as bigint) window_start, if(l_returnflag='R',l_discount*0.35e0,l_discount) confidence,
 concat(case l_linestatus when 'F' then 'UC-rich' else 'G-rich' end,'|',l_returnflag) g from lineitem)"""


def teacher_rows(v):
    rows = v.table("lineitem").selectExpr(
        "l_suppkey protein_id",
        "l_orderkey*1000+l_linenumber*100+cast(l_quantity as bigint) window_start",
        "l_discount confidence",
        "l_returnflag='R' has_conflict",
        "concat(if(l_linestatus='F','UC-rich','G-rich'),'|',l_returnflag) motif_group",
    )
    return N.penalise_conflicts(rows)


@query(
    "teacher_summary",
    f"""select protein_id, window_start, round(confidence,6) as confidence, split_part(g,'|',1) as first_group, split_part(g,'|',2) as second_group, n as n_candidate_windows
from (select *, row_number() over (partition by protein_id order by confidence desc, window_start) r, count(*) over (partition by protein_id) n from {TEACH_SQL}) where r=1""",
)
def teacher_summary(v):
    return N.teacher_summary(teacher_rows(v)).withColumn("confidence", rounded("confidence"))


@query(
    "branch_candidates",
    f"""select protein_id, window_start, round(confidence,6) as confidence, g as motif_group from (select *, row_number() over (partition by protein_id order by confidence desc, window_start) r from {TEACH_SQL} where g in ('UC-rich|A','UC-rich|N')) where r=1""",
)
def branch_candidates(v):
    out = N.branch_candidates(teacher_rows(v), ["UC-rich|A", "UC-rich|N"])
    return out.select("protein_id", "window_start", rounded("confidence").alias("confidence"), "motif_group")


@query(
    "structure_check",
    with_views(
        "pairing",
        """select count(*) as n_windows, count(*) filter (length(rna_seq)<>200) as bad_sequence_length, count(*) as n_pairing, count(*) filter (len(paired)<>200) as bad_vector_width, true as rows_match from pairing""",
    ),
)
def structure_check(v):
    w = v.windows()
    return Q.structure_check(w, v.pairing(w), 200)


@query(
    "sequence_fingerprint",
    with_views("windows", "select transcript_id, count(*) as n_rows, min(sha256(rna_seq)) as least_digest, max(sha256(rna_seq)) as greatest_digest from windows group by 1"),
)
def sequence_fingerprint(v):
    return Q.fingerprint_parts(v.windows(), "transcript_id")


@query(
    "duplicate_keys",
    """select cast(sum(n) as bigint) as n_rows, count(*) as n_keys, cast(sum(n-1) as bigint) as duplicate_rows, count(*) filter (n>1) as duplicated_keys from (select count(*) n from lineitem group by l_orderkey, l_linenumber)""",
)
def duplicate_keys(v):
    return Q.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_sequences",
    with_views(
        "windows",
        "select cast(sum(n) as bigint) as n_rows, count(*) as n_keys, cast(sum(n-1) as bigint) as duplicate_rows, count(*) filter (n>1) as duplicated_keys from (select count(*) n from windows group by gene_id, rna_seq)",
    ),
)
def duplicate_sequences(v):
    return Q.duplicate_sequences(v.windows(), ["gene_id"])


@query(
    "match_counts",
    """select count(*) as n_keys, count(*) filter (o_orderkey in (select l_orderkey from lineitem)) as matched_keys, count(*) filter (o_orderkey not in (select l_orderkey from lineitem)) as missing_keys from orders""",
)
def match_counts(v):
    right = v.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return Q.match_counts(v.table("orders"), right, ["o_orderkey"])


@query("missing_ids", "select p_partkey as id from part where p_partkey not in (select c_custkey from customer)")
def missing_ids(v):
    left = v.table("part").select(F.col("p_partkey").alias("id"))
    return Q.missing_ids(left, v.table("customer").select(F.col("c_custkey").alias("id")), "id")


@query(
    "vocabulary_check",
    """select count(*) as n_kmers, count(*) filter (p_name<>upper(p_name)) as n_lower, count(*) filter (contains(upper(p_name),'T')) as n_with_t,
 count(*) filter (not regexp_full_match(upper(p_name),'[ACGU]*')) as n_foreign, cast(min(length(p_name)) as integer) as shortest, cast(max(length(p_name)) as integer) as longest from part""",
)
def vocabulary_check(v):
    return Q.vocabulary_check(v.table("part"), "p_name")


@query("coordinate_base", with_views("windows", "select min(window_start) as min_start, max(window_end) as max_end, min(window_start)=1 as looks_one_based from windows"))
def coordinate_base(v):
    return Q.coordinate_base(v.windows())


OFF_SQL = """k as (select l_returnflag model, concat('t',l_orderkey) transcript_id, l_linenumber*50-49-if(l_linestatus='F',1,0) window_start, count(*) c from lineitem group by 1,2,3),
w as (select distinct concat('t',l_orderkey) transcript_id, l_linenumber*50-49 window_start from lineitem),
f as (select model, count(*) n_keys, sum(c-1) dup, count(d.window_start) dm, count(p.window_start) pm from k left join w d on d.transcript_id=k.transcript_id and d.window_start=k.window_start
   left join w p on p.transcript_id=k.transcript_id and p.window_start=k.window_start+1 group by 1)"""


@query(
    "offset_match",
    f"""with {OFF_SQL} select model, n_keys, cast(dup as bigint) as duplicate_rows, dm as direct_matches, pm as plus_one_matches, if(pm>dm,1,0) as chosen_offset,
 round(greatest(dm,pm)/cast(n_keys as double),6) as match_rate, n_keys-greatest(dm,pm) as unmatched_keys from f""",
)
def offset_match(v):
    keys = v.table("lineitem").selectExpr(
        "l_returnflag model", "concat('t',l_orderkey) transcript_id", "l_linenumber*50-49-if(l_linestatus='F',1,0) window_start"
    )
    out = Q.offset_match(keys, v.window_scores(), ["model"])
    return out.withColumn("match_rate", rounded("match_rate"))


ALIGN_SQL = """i as (select o_orderkey embedding_row, concat('p',o_custkey) protein_id, o_orderpriority src from orders),
e as (select p_partkey embedding_row, concat('p',p_partkey % 1500) protein_id from part),
j as (select i.*, e.protein_id a, m.r b from i left join e using (embedding_row) left join (select protein_id, min(embedding_row) r from e group by 1) m on m.protein_id=i.protein_id)"""


@query(
    "alignment_audit",
    f"""with {ALIGN_SQL} select embedding_row, protein_id, src, issue from (select *, concat_ws(';', if(a is null,'row_missing',null), if(a<>protein_id,'other_protein_at_row',null), if(b is null,'protein_missing',null), if(b<>embedding_row,'other_row_for_protein',null)) issue from j) where issue<>''""",
)
def alignment_audit(v):
    index = v.table("orders").selectExpr("o_orderkey embedding_row", "concat('p',o_custkey) protein_id", "o_orderpriority src")
    emb = v.table("part").selectExpr("p_partkey embedding_row", "concat('p',p_partkey % 1500) protein_id")
    return Q.index_alignment(index, emb)


@query(
    "row_id_check",
    """select cast(sum(n) as bigint) as n_rows, count(*) as n_ids, min(event_id) as least_id, max(event_id) as greatest_id, sum(n)=count(*) as is_unique, sum(n)=count(*) and min(event_id)=0 and max(event_id)=sum(n)-1 as is_contiguous from (select event_id, count(*) n from events group by 1)""",
)
def row_id_check(v):
    return Q.row_id_check(v.table("events"), "event_id")


@query(
    "usage_counts",
    """select l_suppkey, count(*) filter (l_returnflag='A') as "A", count(*) filter (l_returnflag='N') as "N", count(*) filter (l_returnflag='R') as "R", l_suppkey<0 or l_suppkey>=90 as out_of_range from lineitem group by 1""",
)
def usage_counts(v):
    return Q.usage_counts(v.table("lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], 90)


@query(
    "finite_check",
    with_views(
        "window_scores",
        """select 'motif_raw' as "column", count(*)-count(motif_raw) as nulls, cast(0 as bigint) as non_finite from window_scores union all select 'structure_raw', count(*)-count(structure_raw), 0 from window_scores""",
    ),
)
def finite_check(v):
    return Q.finite_check(v.window_scores(), ["motif_raw", "structure_raw"])


@query("label_counts", "select event_type, count(*) as n from events group by 1")
def label_counts(v):
    return value_table(v.table("events"), "event_type")


@query(
    "zero_fraction",
    """select l_returnflag, count(*) as n_rows, round(avg(if(l_tax=0,1e0,0e0)),6) as zero_fraction, avg(if(l_tax=0,1e0,0e0))>0.95 as warning from lineitem group by 1""",
)
def zero_share(v):
    out = zero_fraction(v.table("lineitem"), ["l_returnflag"], "l_tax")
    return out.withColumn("zero_fraction", rounded("zero_fraction"))


@query(
    "probe_ranks",
    with_views(
        "profiles",
        """select rbp_id, kmer, direction, cast(rank as integer) as rank, round(zscore,6)+0e0 as zscore from (select p.rbp_id, p.kmer, t.direction, t.rank, t.zscore, row_number() over (partition by p.rbp_id, p.kmer order by t.direction nulls last, t.rank) r
 from kp p left join (select * from (select *, 'positive' direction, row_number() over (partition by rbp_id order by zscore desc nulls last, kmer) rank from kp
  union all select *, 'negative', row_number() over (partition by rbp_id order by zscore asc nulls last, kmer) from kp) where rank<=25) t using (rbp_id,kmer)) where r=1""",
        KMER_CTE,
    ),
)
def probe_ranks(v):
    p = named_profiles(v)
    out = Q.probe_ranks(p.select("rbp_id", "kmer"), extremes(p))
    return out.withColumn("zscore", rounded("zscore"))


@query(
    "first_known",
    """select id, coalesce(max(a) filter (p=0 and a<>''), max(a) filter (p=1 and a<>'')) as family, coalesce(max(b) filter (p=0 and b<>''), max(b) filter (p=1 and b<>'')) as brand from
 (select p_partkey % 700 id, 0 p, if(p_size<30,'',p_type) a, cast(null as varchar) b from part where p_partkey in (select l_partkey from lineitem) union all select p_partkey, 1, p_type, p_brand from part) group by 1""",
)
def first_known(v):
    lines = v.table("lineitem").selectExpr("l_partkey p_partkey")
    one = v.table("part").join(lines, "p_partkey", "left_semi").selectExpr("p_partkey % 700 id", "if(p_size<30,'',p_type) family")
    one = one.groupBy("id").agg(F.max("family").alias("family"))
    two = v.table("part").selectExpr("p_partkey id", "p_type family", "p_brand brand")
    return Q.first_known([one, two], "id", ["family", "brand"])


@query(
    "last_source",
    """select id, coalesce(max(b), max(a)) as value from (select c_custkey id, c_name a, null b from customer union all select s_suppkey, null, s_name from supplier) where id in (select o_custkey from orders) group by 1""",
)
def last_source(v):
    one = v.table("customer").selectExpr("c_custkey id", "c_name value")
    two = v.table("supplier").selectExpr("s_suppkey id", "s_name value")
    return Q.last_source([one, two], "id", "value", v.table("orders").selectExpr("o_custkey id"))


@query(
    "sequence_coverage",
    """select doc_id, quality, text is not null and quality=1 as sequence_found, cast(length(if(quality=1,text,null)) as integer) as n from labels left join documents using (doc_id)""",
)
def sequence_coverage(v):
    docs = v.table("documents").select("doc_id", F.lit(1).alias("quality"), F.col("text").alias("protein_sequence"))
    out = Q.sequence_coverage(v.table("labels").select("doc_id", "quality"), docs, ["doc_id", "quality"])
    return out.select("doc_id", "quality", "sequence_found", F.length("protein_sequence").alias("n"))


@query(
    "ordered_digest",
    with_views(
        "windows",
        # blocks of a thousand row numbers, then of a thousand blocks, as long as there is more than one
        """select (select count(*) from l0) as n_rows, case when (select count(*) from l1)<=1 then (select coalesce(max(h),sha256('')) from l1)
 when (select count(*) from l2)=1 then (select max(h) from l2) else (select max(h) from l3) end as digest""",
        """l0 as materialized (select row_number() over (order by transcript_id, window_start)-1 pos, sha256(rna_seq) h from windows),
l1 as materialized (select pos//1000 pos, sha256(string_agg(h,'' order by pos)) h from l0 group by 1),
l2 as materialized (select pos//1000 pos, sha256(string_agg(h,'' order by pos)) h from l1 group by 1),
l3 as materialized (select pos//1000 pos, sha256(string_agg(h,'' order by pos)) h from l2 group by 1)""",
    ),
)
def ordered_digest(v):
    return Q.window_digest(v.windows())


@query("paired_by_position", with_views("pairing", "select transcript_id, window_start, window_end, round(list_sum(paired),6)+0e0 as paired_sum from pairing"))
def paired_by_position(v):
    """Vectors are stored by row number, with the digest of the windows that they were made for."""
    windows = durable(v.windows())
    along = text_number("transcript_id")
    order = [F.col("transcript_id"), F.col("window_start")]
    # keys are numbered before they get their vectors, which are not sorted
    numbered = rank_rows(windows.select(*order, along.alias("_along")), [], order, "r", F.col("_along"))
    vectors = durable(v.pairing(numbered).select((F.col("r") - 1).alias("position"), "paired"))
    kept = Q.window_digest(windows).first().digest
    out = Q.pair_by_position(windows, vectors, kept)
    total = F.aggregate("paired", F.lit(0.0), lambda a, x: a + x)
    return out.select("transcript_id", "window_start", "window_end", rounded(total).alias("paired_sum"))
