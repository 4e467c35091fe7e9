"""Queries on sources and sinks: each writes a given table, reads it back and returns what it holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.inputs import with_views
from seqrank.catalog.registry import query
from seqrank.catalog.scratch import scratch
from seqrank.functions.numeric import rounded
from seqrank.operators import bias as B
from seqrank.operators import genes as G
from seqrank.operators import windows as W
from seqrank.sources import fasta, tables

#: What the readers take from a whole text: letters and stop marks.
_LETTERS = "regexp_replace(text,'[^A-Za-z*]','','g')"


def _bodies(v):
    """Whole texts over several lines, as they are; only a mark that would open a record at the start of a line is left out."""
    body = F.regexp_replace(F.concat(F.lit("\n"), "text"), "\n>+", "\n")
    return v.table("documents").select("doc_id", "source", body.alias("seq"))


@query(
    "fasta_full_headers",
    f"select concat('tx',doc_id,' src=',source) as header, md5(upper({_LETTERS})) as seq_md5 from documents",
)
def fasta_full_headers(v):
    path = scratch(v)
    fasta.write_fasta(_bodies(v).select(F.concat(F.lit("tx"), "doc_id", F.lit(" src="), "source").alias("header"), "seq"), path, "header", "seq")
    return fasta.read_fasta_full(v.spark, path).select("header", F.md5("sequence").alias("seq_md5"))


@query(
    "fasta_protein_letters",
    f"select concat('p',doc_id) as header, md5(regexp_replace(upper({_LETTERS}),'[^ACDEFGHIKLMNPQRSTVWY]','X','g')) as seq_md5 from documents",
)
def fasta_protein_bodies(v):
    path = scratch(v)
    fasta.write_fasta(_bodies(v).select(F.concat(F.lit("p"), "doc_id").alias("header"), "seq"), path, "header", "seq")
    return fasta.read_fasta_protein(v.spark, path).select("header", F.md5("sequence").alias("seq_md5"))


@query(
    "accession_records",
    f"""select concat('r',doc_id % 7) as rbp, concat('sp',doc_id % 3) as species, acc, md5(regexp_replace(replace(upper({_LETTERS}),'*',''),'[^ACDEFGHIKLMNPQRSTVWY]','X','g')) as seq_md5
from (select *, unnest(case when doc_id % 5 = 0 then [concat('A',doc_id)] else [concat('A',doc_id), concat('B',doc_id)] end) acc from documents)""",
)
def accession_records(v):
    path = scratch(v)
    rows = _bodies(v).withColumn(
        "header",
        F.expr("concat('r', doc_id % 7, '|sp', doc_id % 3, '|resolved=A', doc_id, '|requested=', if(doc_id % 5 = 0, 'A', 'B'), doc_id, ' more words')"),
    )
    fasta.write_fasta(rows, path, "header", "seq")
    out = fasta.accession_lookup(fasta.read_fasta_full(v.spark, path))
    return out.select("rbp", "species", "acc", F.md5("sequence").alias("seq_md5"))


@query("typed_table", "select p_partkey, p_size, p_retailprice from part")
def typed_table(v):
    path = scratch(v)
    tables.write_table(v.table("part"), path)
    schema = v.table("part").schema
    return tables.read_table(v.spark, path, ["p_partkey", "p_name"], schema, ["p_partkey", "p_size", "p_retailprice"])


@query("typed_table_gzip", "select c_custkey, c_name from customer")
def typed_table_gzip(v):
    path = scratch(v)
    tables.write_table(v.table("customer"), path, compressed=True)
    return tables.read_table(v.spark, path, ["c_custkey"], v.table("customer").schema, ["c_custkey", "c_name"])


@query("inferred_delimiter", "select cast(s_suppkey as varchar) as s_suppkey, s_name from supplier")
def inferred_delimiter(v):
    path = scratch(v)
    v.table("supplier").select("s_suppkey", "s_name").write.option("sep", ";").option("header", True).csv(path)
    return tables.read_any(v.spark, path, ["s_suppkey"])


@query(
    "truth_lists",
    """select 'strict' as kind, count(distinct concat('g',p_partkey))::bigint as n, md5(max(concat('g',p_partkey))) as last from part where p_size > 40
union all select 'alias', count(distinct p_brand), md5(max(p_brand)) from part
union all select 'first', count(distinct p_type), md5(max(p_type)) from part""",
)
def truth_lists(v):
    part = v.table("part")
    lists = {
        "strict": tables.read_truth(v.truth(), strict=True),
        "alias": tables.read_truth(part.selectExpr("p_partkey k", "p_brand target_gene_id")),
        "first": tables.read_truth(part.select("p_type", "p_size"), first_column=True),
    }
    out = None
    for kind, genes in lists.items():
        row = genes.agg(F.count(F.lit(1)).alias("n"), F.md5(F.max("gene_id")).alias("last")).select(F.lit(kind).alias("kind"), "n", "last")
        out = row if out is None else out.union(row)
    return out


@query(
    "indexed_vectors",
    "select p_partkey, round(list_sum(list_transform(embedding, lambda x: x::double)),6) as total from part join embeddings on vec_id = p_partkey - 1",
)
def indexed_vectors(v):
    index = v.table("part").selectExpr("p_partkey", "p_partkey - 1 embedding_row")
    out = tables.embeddings(index, v.table("embeddings").withColumnRenamed("vec_id", "embedding_row"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("p_partkey", rounded(total).alias("total"))


@query(
    "structure_metadata",
    with_views("windows", "select count(*) as n_rows, 200::bigint as rna_len, count(*) as n_windows, 200 as longest, count(*) as n_pairing, 200 as narrowest, 200 as widest, true as consistent from windows"),
)
def structure_metadata(v):
    path = scratch(v)
    windows = v.windows()
    tables.write_report(windows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("rna_len", F.lit(200)), path)
    return tables.check_structure(tables.read_structure_meta(v.spark, path), windows, v.pairing())


def by_max() -> str:
    return next(name for name, column in G.RANKINGS.items() if column == "max_score")


_RANKED = """r as (select rbp_id, gene_id, row_number() over (partition by rbp_id order by round(max_score,9) desc nulls last, gene_id) rk from genes)"""


@query(
    "gene_lists",
    with_views("genes", "select rbp_id, cast(k as integer) as top_k, gene_id from r, (select unnest([200,500,1000]) k) where rk <= k", _RANKED),
)
def gene_lists(v):
    path = scratch(v)
    ranked = G.ranking_views(v.genes().withColumn("max_score", rounded("max_score", 9))).where(F.col("ranking_name") == by_max())
    tables.write_gene_lists(G.top_gene_list(ranked, 1000), path)
    return v.spark.read.text(path).select("rbp_id", "top_k", F.col("value").alias("gene_id"))


@query(
    "ranking_output",
    with_views("genes", "select 'max_window_score' as ranking_name, rbp_id, gene_id, rk as rank from r", _RANKED),
)
def ranking_output(v):
    path = scratch(v)
    genes = v.genes().withColumn("max_score", rounded("max_score", 9))
    views = G.ranking_views(genes)
    tables.write_rankings(views.select("ranking_name", "rbp_id", "gene_id", "rank"), path)
    out = v.spark.read.parquet(path).where(F.col("ranking_name") == by_max())
    return out.select(F.lit("max_window_score").alias("ranking_name"), "rbp_id", "gene_id", "rank")


@query(
    "ranking_column_choice",
    "select gene_id, score from (select concat('g',p_partkey) gene_id, p_retailprice score from part)",
)
def ranking_column_choice(v):
    genes = v.table("part").selectExpr("concat('g',p_partkey) gene_id", "p_size*1e0 top3_mean_score", "p_retailprice max_score")
    return genes.select("gene_id", F.col(tables.ranking_column(genes)).alias("score"))


@query(
    "external_protein_list",
    """select 'p'||p_partkey as protein_id, md5(p_name) as seq_md5, 'index' as source from part
union all select 'ext'||(s_suppkey % 2), md5(s_name), 'external' from supplier where s_suppkey % 3 <> 2""",
)
def external_protein_list(v):
    index = v.table("part").selectExpr("concat('p',p_partkey) protein_id", "p_name sequence")
    records = v.table("supplier").selectExpr("concat('s', s_suppkey, ' kind=', if(s_suppkey % 3 = 2, 'none', cast(s_suppkey % 2 as string))) header", "s_name sequence")
    out = tables.protein_list(index, tables.external_proteins(records, {"ext0": "kind=0$", "ext1": "kind=1$"}))
    return out.select("protein_id", F.md5("sequence").alias("seq_md5"), "source")


@query("query_id_list", "select cast(i as integer) as position, concat('Customer#', lpad(cast(i+1 as varchar), 9, '0')) as protein_id from range(0,5) t(i), (select count(*) n from customer) where n >= 5")
def query_id_list(v):
    names = ", ".join(f"Customer#{i:09d}" for i in (1, 2, 3, 2, 4, 5, 1))
    return tables.query_ids(v.spark, names, v.table("customer").selectExpr("c_name protein_id"))


@query("row_numbers", "select o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) - 1 as row_id from orders")
def row_numbers(v):
    return W.numbered(v.table("orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "row_id")


@query(
    "report_figures",
    """select 'brands' as section, metric, p_brand as "group", value from (select p_brand, count(*)::double n_parts, round(avg(p_size),6) mean_size from part group by 1)
 unpivot (value for metric in (n_parts, mean_size))""",
)
def report_figures(v):
    path = scratch(v)
    rows = v.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"), rounded(F.avg("p_size")).alias("mean_size"))
    tables.write_report(tables.report_rows(rows, "brands", ["p_brand"], ["n_parts", "mean_size"]), path)
    return v.spark.read.schema("section string, metric string, `group` string, value double").json(path)


@query(
    "biased_rankings",
    with_views(
        "",
        """select l_returnflag, l_linestatus, n as n_genes from (select l_returnflag, l_linestatus, count(*) n, corr(l_quantity, if(l_returnflag='A', l_quantity*1e3 + l_extendedprice, l_extendedprice)) p from lineitem group by 1,2) where abs(p) >= 0.2""",
    ),
)
def biased_rankings(v):
    rows = v.table("lineitem").selectExpr("l_returnflag", "l_linestatus", "l_quantity", "if(l_returnflag='A', l_quantity*1e3 + l_extendedprice, l_extendedprice) score")
    out = B.bias_flags(B.correlations(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "score"))
    return out.select("l_returnflag", "l_linestatus", "n_genes")
