"""Queries on transcripts, windows, sequences and pairing vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.inputs import with_views
from seqrank.catalog.registry import query
from seqrank.functions import labels as L
from seqrank.functions import sequence as S
from seqrank.functions import structure as A
from seqrank.functions.numeric import rounded
from seqrank.operators import features, repeats
from seqrank.operators import windows as W
from seqrank.operators.genes import top_windows

@query(
    "rna_normalise",
    """select doc_id, md5(replace(upper(text),'T','U')) as rna_md5,
  md5(regexp_replace(regexp_replace(replace(upper(text),'T','U'),'[ \\r\\n]','','g'),'[^ACGUN]','N','g')) as fingerprint_md5
from (select doc_id, replace(text,'ß','SS') as text from documents)""",
)
def rna_normalise(v):
    return v.table("documents").select(
        "doc_id",
        F.md5(S.rna("text")).alias("rna_md5"),
        F.md5(S.fingerprint_text("text")).alias("fingerprint_md5"),
    )


@query(
    "protein_features",
    """with p as (select doc_id, source, regexp_replace(replace(upper(replace(text,'ß','SS')),'*',''),'[^ACDEFGHIKLMNPQRSTVWY]','X','g') s from documents)
select doc_id, md5(s) as clean_md5, round(length(s)/1e3,6)+0e0 as length_kaa,
  round((length(s)-length(replace(s,'G','')))/cast(greatest(length(s),1) as double),6)+0e0 as fraction_G,
  round((length(s)-length(replace(s,'R','')))/cast(greatest(length(s),1) as double),6)+0e0 as fraction_R,
  round((length(s)-length(replace(s,'K','')))/cast(greatest(length(s),1) as double),6)+0e0 as fraction_K
from p where length(s) >= 30""",
)
def protein_features(v):
    p = v.table("documents").select("doc_id", S.clean_protein("text").alias("s")).where(F.length("s") >= 30)
    feats = L.physico_chemical("s")
    return p.select("doc_id", F.md5("s").alias("clean_md5"), *[rounded(c).alias(n) for n, c in feats.items()])


@query(
    "reverse_complement",
    with_views("tx", "select transcript_id, md5(reverse(translate(seq,'ACGU','UGCA'))) as rc_md5 from tx"),
)
def reverse_complement(v):
    return v.tx().select("transcript_id", F.md5(S.reverse_complement("seq")).alias("rc_md5"))


@query(
    "encode_bases",
    with_views(
        "windows",
        """select transcript_id, window_start, translate(rna_seq,'ACGU','0123') as codes,
  rna_seq as decoded from windows""",
    ),
)
def encode_bases(v):
    coded = v.windows().select("transcript_id", "window_start", S.base_codes("rna_seq", 200).alias("c"))
    return coded.select(
        "transcript_id",
        "window_start",
        F.array_join(F.transform("c", lambda d: d.cast("string")), "").alias("codes"),
        S.decode_codes("c").alias("decoded"),
    )


@query("tile_windows", with_views("windows", "select gene_id, transcript_id, window_start, window_end, md5(rna_seq) as seq_md5 from windows"))
def tile_windows(v):
    return v.windows().select("gene_id", "transcript_id", "window_start", "window_end", F.md5("rna_seq").alias("seq_md5"))


@query(
    "attach_genes",
    with_views(
        "tx",
        """select g.gene_id, count(*) as n_transcripts, cast(sum(length(t.seq)) as bigint) as total_length
from tx t join (select transcript_id, arg_max(gene_id, pos) gene_id from
  (select concat('tx',doc_id) transcript_id, concat('g',l_partkey) gene_id,
          l_orderkey*1000000000+l_suppkey*1000000+l_linenumber*100000+cast(l_quantity as bigint) pos
   from documents join lineitem on doc_id = l_partkey) group by 1) g using (transcript_id) group by 1""",
    ),
)
def attach_genes(v):
    pos = "l_orderkey*1000000000+l_suppkey*1000000+l_linenumber*100000+cast(l_quantity as bigint) pos"
    mapped = v.table("lineitem").selectExpr("concat('tx',l_partkey) transcript_id", "concat('g',l_partkey) gene_id", pos)
    joined = W.attach_genes(v.tx(), mapped, "pos")
    return joined.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n_transcripts"), F.sum(F.length("seq").cast("bigint")).alias("total_length")
    )


@query(
    "first_transcripts",
    with_views("tx", "select transcript_id, length(seq) as n from tx order by transcript_id limit 100").replace(
        "length(seq) as n", "cast(length(seq) as integer) as n"
    ),
)
def first_transcripts(v):
    return W.first_transcripts(v.tx(), 100).select("transcript_id", F.length("seq").alias("n"))


@query(
    "protein_windows",
    """with p as (select doc_id, regexp_replace(replace(upper(replace(text,'ß','SS')),'*',''),'[^ACDEFGHIKLMNPQRSTVWY]','X','g') s from documents),
c as (select doc_id, s, 1 as a, length(s) as b from p where length(s)>0
 union select doc_id, s, x+1, least(x+256,length(s)) from
   (select *, unnest(case when length(s)>=256 then list_append(range(0,length(s)-255,64), length(s)-256)
      when length(s)>=128 then [0] else [] end) x from p))
select doc_id, cast(a as integer) as window_start, cast(b as integer) as window_end, md5(substr(s,a,b-a+1)) as seq_md5 from c""",
)
def protein_windows(v):
    p = v.table("documents").select("doc_id", S.clean_protein("text").alias("protein_sequence"))
    return W.tile_proteins(p).select("doc_id", "window_start", "window_end", F.md5("window_seq").alias("seq_md5"))


@query(
    "composition",
    with_views(
        "windows",
        """select transcript_id, window_start,
  round((200-length(replace(rna_seq,'U','')))/2e2,6) as u_content,
  round((200-length(replace(rna_seq,'C','')))/2e2,6) as c_content,
  round((200-length(translate(rna_seq,'UC','')))/2e2,6) as uc_content,
  round((200-length(translate(rna_seq,'AU','')))/2e2,6) as au_content,
  round((200-length(translate(rna_seq,'GC','')))/2e2,6) as gc_content,
  round(e,6)+0e0 as shannon_entropy, round(1-least(e/2,1),6)+0e0 as low_complexity_score,
  cast(coalesce(list_max(list_transform(regexp_extract_all(rna_seq,'U+'), lambda x: length(x))),0) as integer) as longest_u_run,
  cast(len(list_filter(range(1,195), lambda i: substr(rna_seq,i,7)='UUUUUUU')) as integer) as u7_count
from (select *, (select sum(case when p>0 then -p*log2(p) else 0 end) from
   (select unnest([(200-length(replace(rna_seq,'A','')))/2e2,(200-length(replace(rna_seq,'C','')))/2e2,
                   (200-length(replace(rna_seq,'G','')))/2e2,(200-length(replace(rna_seq,'U','')))/2e2]) p)) e from windows)""",
    ),
)
def composition(v):
    return features.composition(v.windows()).select(
        "transcript_id",
        "window_start",
        *[rounded(f"{x}_content").alias(f"{x.lower()}_content") for x in ("U", "C", "UC", "AU", "GC")],
        rounded("shannon_entropy").alias("shannon_entropy"),
        rounded("low_complexity_score").alias("low_complexity_score"),
        F.col("max_homopolymer_U_len").alias("longest_u_run"),
        F.col("UUUUUUU_count").alias("u7_count"),
    )


_KM = "list_transform(range(1,202-{k}), lambda i: substr(rna_seq,i,{k}))"
_RC = "list_transform({x}, lambda w: reverse(translate(w,'ACGU','UGCA')))"


def _density_sql(k: int) -> str:
    km = f"k{k}"
    return (
        f"len(list_filter({km}, lambda w: list_contains(b{k}, w)))/cast(len({km}) as double)"
    )


_LOCAL = (
    "list_max(list_transform(range(1,162,20), lambda s: ("
    + " + ".join(
        f"len(list_filter(range(s,s+{41 - k}), lambda i: list_contains(list_transform(range(s,s+{41 - k}), "
        f"lambda j: reverse(translate(substr(rna_seq,j,{k}),'ACGU','UGCA'))), substr(rna_seq,i,{k}))))/{41 - k}e0"
        for k in (4, 5)
    )
    + ")/2))"
)
_LONGEST = (
    "case "
    + " ".join(
        f"when list_has_any({_KM.format(k=k)}, {_RC.format(x=_KM.format(k=k))}) then {k}" for k in range(12, 3, -1)
    )
    + " else 0 end"
)


@query(
    "repeat_features",
    with_views(
        "tx_top3",
        """select seq_md5, round(rc4,6) as reverse_complement_4mer_density, round(rc5,6) as reverse_complement_5mer_density,
  round(rc6,6) as reverse_complement_6mer_density, cast(longest as double) as longest_internal_rc_match,
  cast(pairs as double) as internal_rc_pair_count, round(pal,6) as palindrome_score,
  round((rc4+rc5+local)/3,6) as self_complementarity_score,
  round((rc4+rc5+rc6+local+least(longest/12e0,1)+least(pairs/1e2,1))/6,6) as inverted_repeat_score,
  round(local,6) as local_self_complementarity_score, round(simple,6)+0e0 as simple_repeat_score,
  round(simple,6)+0e0 as simple_repeat_penalty_score
from f""",
        extra="w1 as (select distinct rna_seq from tx_top3), km0 as (select rna_seq, "
        + ", ".join(f"{_KM.format(k=k)} as k{k}" for k in (4, 5, 6))
        + " from w1), km as (select *, "
        + ", ".join(f"list_intersect(k{k}, {_RC.format(x=f'k{k}')}) as b{k}" for k in (4, 5, 6))
        + f""" from km0), f as (select md5(rna_seq) seq_md5, {_density_sql(4)} rc4, {_density_sql(5)} rc5, {_density_sql(6)} rc6,
   (len(list_filter(k4, lambda w: w=reverse(translate(w,'ACGU','UGCA'))))/197e0
    + len(list_filter(k6, lambda w: w=reverse(translate(w,'ACGU','UGCA'))))/195e0)/2 pal,
   {_LOCAL} local, {_LONGEST} longest,
   coalesce(list_sum(list_transform(list_filter(b5, lambda w: w < reverse(translate(w,'ACGU','UGCA'))),
      lambda w: len(list_filter(k5, lambda x: x=w)) * len(list_filter(k5, lambda x: x=reverse(translate(w,'ACGU','UGCA')))))),0) pairs,
   ((1-least(list_sum(list_transform(['A','C','G','U'], lambda b: case when contains(rna_seq,b) then
       -((200-length(replace(rna_seq,b,'')))/2e2)*log2((200-length(replace(rna_seq,b,'')))/2e2) else 0 end))/2,1))
    + coalesce(list_max(list_transform(regexp_extract_all(rna_seq,'U+'), lambda x: length(x))),0)/2e2)/2 simple
 from km)""",
    ),
)
def repeat_features(v):
    top = top_windows(v.tx_scores(), "base_score", 3, ties=("transcript_id", "window_start"))
    feats = repeats.repeat_table(top, version="v2_1")
    numeric = [
        "reverse_complement_4mer_density",
        "reverse_complement_5mer_density",
        "reverse_complement_6mer_density",
        "longest_internal_rc_match",
        "internal_rc_pair_count",
        "palindrome_score",
        "self_complementarity_score",
        "inverted_repeat_score",
        "local_self_complementarity_score",
        "simple_repeat_score",
        "simple_repeat_penalty_score",
    ]
    return feats.select(F.md5("rna_seq").alias("seq_md5"), *[rounded(n).alias(n) for n in numeric])


@query(
    "pairing_statistics",
    with_views(
        "pairing",
        """select transcript_id, window_start, round(m,6) as paired_probability_mean, round(md,6) as paired_probability_median,
  round(mx,6) as paired_probability_max, round(hi,6) as fraction_high_paired, round(lo,6) as fraction_low_paired,
  round(0.45*m+0.15*md+0.20*mx+0.20*hi,6) as structure_match_raw
from (select transcript_id, window_start, list_sum(paired)/2e2 m, list_median(paired) md, list_max(paired) mx,
  len(list_filter(paired, lambda x: x>=0.7))/2e2 hi, len(list_filter(paired, lambda x: x<=0.3))/2e2 lo from pairing)""",
    ),
)
def pairing_statistics(v):
    from seqrank.operators.scoring import add_pairing_statistics

    out = add_pairing_statistics(v.pairing())
    names = [*A.pairing_statistics("paired"), "structure_match_raw"]
    return out.select("transcript_id", "window_start", *[rounded(n).alias(n) for n in names])


_SLIDE = "list_max(list_transform(range({w},201), lambda i: (cs[i+1]-cs[i-{w}+1])/{w}))"


@query(
    "hairpin_features",
    with_views(
        "pairing",
        """select transcript_id, window_start, cast(longest as double) as longest_high_paired_run,
  cast(runs as double) as high_paired_run_count, round(dens,6) as paired_run_density,
  cast(bounds as double) as paired_unpaired_boundary_count,
  round(l31,6) as max_local_paired_mean_31nt, round(l41,6) as max_local_paired_mean_41nt, round(l81,6) as max_local_paired_mean_81nt,
  round(stem,6) as stem_like_score, round(greatest(l31,l41,l81)-m,6)+0e0 as structure_peakiness_score,
  round((stem+dens+l41+l81+least(longest/5e1,1)+greatest(greatest(l31,l41,l81)-m,0))/6,6) as paired_architecture_score
from (select *, (least(longest/4e1,1)+l41+dens)/3 stem from
 (select transcript_id, window_start,
   coalesce(list_max(list_transform(string_split(fl,'0'), lambda z: length(z))),0) longest,
   len(list_filter(string_split(fl,'0'), lambda z: length(z)>0)) runs,
   (200-length(replace(fl,'1','')))/2e2 dens,
   len(list_filter(range(1,200), lambda i: substr(fl,i,1)<>substr(fl,i+1,1))) bounds,
   """
        + ", ".join(f"{_SLIDE.format(w=w)} l{w}" for w in (31, 41, 81))
        + """, cs[201]/2e2 m
  from (select *, list_aggregate(list_transform(paired, lambda x: case when x>=0.7 then '1' else '0' end),'string_agg','') fl,
     list_transform(range(0,201), lambda i: coalesce(list_sum(paired[1:i]),0)) cs from pairing)))""",
    ),
)
def hairpin_features(v):
    out = features.hairpin_columns(v.pairing(), "paired")
    names = [
        "longest_high_paired_run",
        "high_paired_run_count",
        "paired_run_density",
        "paired_unpaired_boundary_count",
        "max_local_paired_mean_31nt",
        "max_local_paired_mean_41nt",
        "max_local_paired_mean_81nt",
        "stem_like_score",
        "structure_peakiness_score",
        "paired_architecture_score",
    ]
    return out.select("transcript_id", "window_start", *[rounded(n).alias(n) for n in names])


_P7 = "(" + "+".join(f"paired[i+{j}]" if j else "paired[i]" for j in range(7)) + ")/7"


@query(
    "au_paired_density",
    with_views(
        "pairing",
        f"""select transcript_id, window_start,
  round(len(list_filter(range(1,195), lambda i: 7-length(translate(substr(rna_seq,i,7),'AU',''))>=6 and {_P7}>=0.7))/194e0,6) as au_rich_paired_density,
  round(len(list_filter(range(1,195), lambda i: 7-length(replace(substr(rna_seq,i,7),'U',''))>=5 and {_P7}>=0.7))/194e0,6) as u_rich_paired_density
from pairing""",
    ),
)
def au_paired_density(v):
    return v.pairing().select(
        "transcript_id",
        "window_start",
        rounded(A.rich_paired_density("rna_seq", "paired", "AU", 6)).alias("au_rich_paired_density"),
        rounded(A.rich_paired_density("rna_seq", "paired", "U", 5)).alias("u_rich_paired_density"),
    )
