"""Queries on streams, trained models and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.catalog.inputs import with_views
from seqrank.catalog.ranking import BIN_CTE, SEEDS, one_protein
from seqrank.catalog.registry import query
from seqrank.catalog.scores import AGG
from seqrank.catalog.scratch import scratch
from seqrank.functions.numeric import rounded
from seqrank.operators import enrichment as E
from seqrank.operators import genes as G
from seqrank.operators import supervised as SV
from seqrank.operators.bias import add_bins
from seqrank.operators.scoring import ABLATIONS
from seqrank.session import durable
from seqrank.sources import annotation, fasta
from seqrank.streaming.incremental import finished, stream_extremes, stream_top_n


def event_stream(v):
    """The events in five batches: a folder for every six days of a month."""
    folder, events = scratch(v), v.table("events")
    events.withColumn("part", F.expr("(day(ts) - 1) div 6 % 5")).repartition("part").write.partitionBy("part").parquet(folder)
    reader = v.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(folder)


@query(
    "streaming_top3",
    """select user_id, event_id, round(value,6) as value, cast(rn as integer) as window_rank from (select *, row_number() over (partition by user_id order by value desc nulls last, event_id) rn from events) where rn<=3""",
)
def streaming_top3(v):
    folder = scratch(v)
    rows = event_stream(v).select("user_id", "event_id", "value")
    order = [F.col("value").desc_nulls_last(), F.col("event_id")]
    run = stream_top_n(rows, ["user_id"], order, 3, f"{folder}/state", f"{folder}/log")
    out = finished(run, v.spark, f"{folder}/state")
    return out.select("user_id", "event_id", rounded("value").alias("value"), "window_rank")


@query(
    "streaming_extremes",
    "select user_id, round(min(value),6) as least, round(max(value),6) as greatest, count(*) as n from events group by 1",
)
def streaming_extremes(v):
    folder = scratch(v)
    run = stream_extremes(event_stream(v).select("user_id", "value"), ["user_id"], "value", f"{folder}/state", f"{folder}/log")
    out = finished(run, v.spark, f"{folder}/state")
    return out.select("user_id", rounded("least").alias("least"), rounded("greatest").alias("greatest"), "n")


@query("fasta_round_trip", with_views("tx", "select transcript_id, md5(seq) as seq_md5, cast(length(seq) as integer) as n from tx"))
def fasta_round_trip(v):
    path = scratch(v)
    fasta.write_fasta(v.tx(), path, "transcript_id", "seq")
    out = fasta.read_fasta(v.spark, path)
    return out.select("transcript_id", F.md5("seq").alias("seq_md5"), F.length("seq").alias("n"))


@query(
    "annotation_round_trip",
    with_views(
        "annotation",
        "select transcript_id, feature, start, end_ as \"end\", strand, biotype from annotation",
    ),
)
def annotation_round_trip(v):
    path = scratch(v)
    line = F.concat_ws(
        "\t",
        F.lit("1"),
        F.lit("s"),
        "feature",
        F.col("start").cast("string"),
        F.col("end").cast("string"),
        F.lit("."),
        "strand",
        F.lit("."),
        F.format_string('gene_id "x"; transcript_id "%s"; transcript_biotype "%s";', "transcript_id", "biotype"),
    )
    v.annotation().select(line.alias("value")).write.text(path)
    out = annotation.read_annotation(v.spark, path, "gtf", exact=True)
    return out.select("transcript_id", "feature", "start", "end", "strand", "biotype")


# -- training sets and calibration models

_ROLES = (
    BIN_CTE
    + """,
seeds as (select unnest([11,12,13,14,15]) seed),
tg as (select gene_id from truth semi join one using (gene_id)),
sp as materialized (select seed, gene_id, if(row_number() over (partition by seed order by md5(concat(seed,':',gene_id)), gene_id) <=
    least(greatest(round_even(count(*) over (partition by seed)*0.7e0,0),1),count(*) over (partition by seed)-1),'calibration','heldout') as split from tg, seeds),
g as materialized (select seed, gene_id, coalesce(b,-1) b, split from binned cross join seeds left join sp using (seed, gene_id)),
np as (select seed, count(*) n from g where split='calibration' group by 1),
pool as (select gene_id from one order by top3_mean_score desc nulls last, gene_id limit 1000),
hard as materialized (select seed, gene_id from (select seed, gene_id, row_number() over (partition by seed order by md5(concat('h:',seed,':',gene_id)), gene_id) r
    from g semi join pool using (gene_id) where split is null) join np using (seed) where r<=n),
rest as materialized (select seed, gene_id, b from g anti join hard using (seed, gene_id) where split is null),
av as materialized (select seed, list(b order by b) codes, list(c order by b) had from (select seed, b, cast(count(*) as bigint) c from rest group by 1,2) group by 1),
pos as materialized (select seed, b, row_number() over (partition by seed order by gene_id) i from g where split='calibration'),
walk as (select seed, cast(0 as bigint) i, codes, had l from av union all
  select seed, i+1, codes, list_transform(l, lambda x, j: x - cast(j = pick as bigint)) from (select w.seed, w.i, w.codes, w.l,
    coalesce(list_sort(list_transform(list_filter(range(1,len(l)+1), lambda j: l[j]>0), lambda j: {'d': abs(codes[j]-p.b), 'c': codes[j], 'j': j}))[1].j, 0) pick
    from walk w join pos p on p.seed=w.seed and p.i=w.i+1)),
quota as (select seed, unnest(codes) b, unnest(list_transform(range(1,len(had)+1), lambda j: had[j]-l[j])) q from (select seed, arg_max(l, i) l from walk group by 1) join av using (seed)),
matched as materialized (select seed, gene_id, b from (select *, row_number() over (partition by seed, b order by md5(concat('m:',seed,':',gene_id)), gene_id) r from rest)
    join quota using (seed, b) where r<=q),
rnd as (select seed, gene_id from (select *, row_number() over (partition by seed order by md5(concat('r:',seed,':',gene_id)), gene_id) r
    from rest anti join matched using (seed, gene_id)) join np using (seed) where r<=n),
neg as (select seed, gene_id from hard union select seed, gene_id from matched union select seed, gene_id from rnd),
roles as materialized (select seed, gene_id, case when split='calibration' then 'calibration_truth' when split='heldout' then 'heldout_truth'
    when neg.gene_id is not null then 'train_negative' else 'unlabeled' end as role from g left join neg using (seed, gene_id))"""
).replace("melted as", "recursive melted as", 1)


def drawn(v, genes=None):
    genes = durable(add_bins(one_protein(v) if genes is None else genes, "n_windows", 20, "bin"))
    return genes, durable(E.truth_splits(E.comparable_truth(v.truth(), genes), SEEDS))


def roles_of(v, genes=None):
    return durable(SV.training_roles(*drawn(v, genes), "top3_mean_score", "bin"))


def recursive(sql: str) -> str:
    """``with`` has to say so in front of all views."""
    return sql.replace("recursive melted", "melted", 1).replace("with ", "with recursive ", 1)


@query("matched_negatives", recursive(with_views("scored truth", "select seed, gene_id, b as bin from matched", _ROLES)))
def matched_negatives(v):
    """Of genes outside the truth, the matches of each seed's positives."""
    genes, splits = drawn(v)
    seeds = splits.select("seed").distinct()
    tagged = genes.select("gene_id", "bin", "top3_mean_score").crossJoin(F.broadcast(seeds)).join(splits, ["seed", "gene_id"], "left")
    tagged = durable(tagged)
    pool = genes.orderBy(F.col("top3_mean_score").desc_nulls_last(), "gene_id").limit(1000).select("gene_id")
    free, positives = tagged.where("role is null"), tagged.where("role = 'calibration'")
    hard = SV.first_per_seed(free.join(pool, "gene_id", "left_semi"), "h", positives.groupBy("seed").agg(F.count(F.lit(1)).alias("n")))
    rest = durable(free.join(hard, ["seed", "gene_id"], "left_anti"))
    return SV.matched_negatives(rest, positives, "bin").join(rest.select("seed", "gene_id", "bin"), ["seed", "gene_id"])


@query("training_roles", recursive(with_views("scored truth", "select seed, gene_id, role from roles", _ROLES)))
def training_roles(v):
    return roles_of(v)


#: Every score under every aggregation is a feature.
FEATURES = [f"{s}__{a}" for s in ABLATIONS for a in AGG if a != "window_count_adjusted_score"]


def trained(v):
    """Wide gene features, roles, the numbers that scale them, and the models of all seeds."""
    # windows are aggregated once, to a row a gene, and the genes' roles are drawn by one of the features
    scores = G.wide_scores(v.scored(stored=False), ABLATIONS)
    wide = durable(scores.select("gene_id", "n_windows", *[rounded(F.col(".".join(f.split("__"))), 9).alias(f) for f in FEATURES]))
    leading = F.col("inverted_base_motif_structure_score__top3_mean_score").alias("top3_mean_score")
    roles = roles_of(v, wide.select("gene_id", "n_windows", leading))
    wide = wide.drop("n_windows")
    rows, stats = SV.standardised(wide, roles, FEATURES)
    return wide, roles, stats, SV.fit_models(rows, len(FEATURES))


@query(
    "calibration_fit",
    recursive(
        with_views(
            "scored truth",
            """select seed, feature, n_pos, n_neg, round(n/(2e0*n_pos),6) as weight_pos, round(n/(2e0*n_neg),6) as weight_neg, round(median(v),6)+0e0 as median,
 round(stddev_pop(coalesce(v,m)),6)+0e0 as scale, 0e0 as gap_l2, 0e0 as gap_elasticnet from
 (select seed, concat(score_name,'__',aggregation) feature, v, median(v) over (partition by seed, score_name, aggregation) m,
   count(*) filter (role='calibration_truth') over (partition by seed, score_name, aggregation) n_pos, count(*) filter (role='train_negative') over (partition by seed, score_name, aggregation) n_neg,
   count(*) over (partition by seed, score_name, aggregation) n from cand join roles using (gene_id) where role in ('calibration_truth','train_negative'))
 group by seed, feature, n_pos, n_neg, n""",
            _ROLES
            + """,
cand as materialized (select score_name, aggregation, gene_id, round(v,9) v from (from melted unpivot include nulls (v for aggregation in (max_score, top3_mean_score, top5_mean_score, top10_mean_score, top5_percent_mean_score))))""",
        )
    ),
)
def calibration_fit(v):
    """Training counts, weights, medians and scales, and how far the fits are from their optimum."""
    _, _, stats, models = trained(v)
    gaps = v.spark.createDataFrame([(m["seed"], m["model_name"], m["gap"]) for m in models], "seed int, model_name string, gap double")
    gaps = gaps.groupBy("seed").pivot("model_name", list(SV.MODELS)).agg(F.first("gap"))
    n = F.col("n_pos") + F.col("n_neg")
    return stats.join(F.broadcast(gaps), "seed").select(
        "seed",
        "feature",
        "n_pos",
        "n_neg",
        rounded(n / (2.0 * F.col("n_pos"))).alias("weight_pos"),
        rounded(n / (2.0 * F.col("n_neg"))).alias("weight_neg"),
        rounded("median").alias("median"),
        rounded("scale").alias("scale"),
        rounded("logistic_l2").alias("gap_l2"),
        rounded("logistic_elasticnet").alias("gap_elasticnet"),
    )


@query("logistic_calibration")
def logistic_calibration(v):
    """Predictions of both models for all genes and seeds, with roles."""
    wide, roles, stats, models = trained(v)
    return SV.predict(models, wide, stats, FEATURES, roles)


@query("feature_importance")
def feature_importance(v):
    """Mean and median absolute coefficients over the seeds."""
    *_, models = trained(v)
    return SV.importance(SV.coefficients(models, v.spark, FEATURES))
