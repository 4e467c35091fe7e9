"""Queries on tables shaped like larger ones, beside their SQL."""

import re
import tempfile
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqrank.catalog import audits, inputs, ranking, scores, stateful
from seqrank.catalog.inputs import Inputs
from seqrank.operators import audit as Q
from seqrank.operators import genes as G
from seqrank.operators import repeats
from seqrank.operators import windows as W
from seqrank.plans import jobs


def beside_sql(spark, name, **tables):
    """Rows of a query and of its SQL over small tables."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    con = duckdb.connect()
    for table, frame in tables.items():
        spark.createDataFrame(frame).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted(tuple(r) for r in df.select(*names).collect()), sorted(found.fetchall()), df


def test_more_hits_than_draws(spark):
    """Large brands have more hits than can be drawn; their logarithm has no value."""
    part = pd.DataFrame({"p_brand": ["big"] * 12_100 + ["small"] * 50, "p_size": [1] * 12_150})
    mine, theirs, _ = beside_sql(spark, "hypergeom", part=part)
    assert mine == theirs and {r[0]: r[-1] for r in mine}["big"] == 0.0


def test_windows_are_added_up_before_they_meet_queries(spark):
    """A protein's windows are not expanded to all of its queries."""
    lines = pd.DataFrame([(o, o % 40, o % 30, o % 7 + 1, 1.0 + o, 100.0 + o * 7 % 13, "ANR"[o % 3 if o % 5 else 0]) for o in range(600)])
    lines.columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
    names = pd.DataFrame([(k, f"s{k % 25}") for k in range(30)], columns=["s_suppkey", "s_name"])
    mine, theirs, df = beside_sql(spark, "restrict_to_proteins", lineitem=lines, supplier=names)
    assert mine == theirs
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("base_logit")  # of the plan's lines, those further down run first
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert not any("base_logit" in x for x in plan.splitlines()[: plan.splitlines().index(joins[0])])


@pytest.mark.parametrize("n", [199, 200, 201, 1750, 1799, 1800, 1801, 1849, 1850, 1851, 5000, 51_399, 51_400, 51_401, 53_000])
def test_windows_around_the_ends_of_pieces(spark, n):
    """Long transcripts are cut into pieces first: windows are the same as those of the whole."""
    text = "".join("ACGTé"[(i * i + i // 7) % 5] for i in range(n))
    starts = list(dict.fromkeys([*range(0, n - 199, 50), n - 200])) if n >= 200 else []
    rows = W.tile(spark.createDataFrame([("t", text), ("none", None)], "transcript_id string, seq string")).collect()
    theirs = [("t", s + 1, s + 200, text[s : s + 200].upper().replace("T", "U")) for s in starts]
    assert sorted(map(tuple, rows)) == sorted(theirs)


def test_long_transcripts_take_time_in_proportion(spark):
    """A window's cost doesn't grow with the letters before it."""
    rows = spark.range(1).select(F.lit("t").alias("transcript_id"), F.repeat(F.lit("ACGTACGT"), 500_000).alias("seq"))
    start = time.time()
    assert W.tile(rows).agg(F.count("rna_seq"), F.max(F.length("rna_seq"))).first()[:] == (79_997, 200)
    assert time.time() - start < 25


def test_digests_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for frame in batches:
            seen.add(len(frame))
            yield frame

    rows = spark.range(2500).selectExpr("concat('t',id) transcript_id", "1 window_start", "'ACGU' rna_seq")
    assert Q.window_digest(rows.mapInPandas(count, rows.schema)).first().n_rows == 2500
    assert seen.value == 2500


def test_vectors_are_not_sorted_to_be_numbered(spark, monkeypatch):
    numbered, rank = [], audits.rank_rows
    monkeypatch.setattr(audits, "rank_rows", lambda df, *a: numbered.append(df.columns) or rank(df, *a))
    docs = pd.DataFrame([(i, "acgt" * (60 + i)) for i in range(30)], columns=["doc_id", "text"])
    mine, theirs, _ = beside_sql(spark, "paired_by_position", documents=docs)
    assert mine == theirs and numbered and not any("paired" in c for c in numbered)


def test_calibration_features_are_aggregated_once(spark, monkeypatch):
    """Roles and features come from one row a gene, the same as every score's own aggregates."""
    gathered, given, gather = [], [], G._gathered
    monkeypatch.setattr(G, "_gathered", lambda *a: gathered.append(a[1]) or gather(*a))
    monkeypatch.setattr(stateful, "roles_of", lambda v, *genes: given.extend(genes or [ranking.one_protein(v)]))
    monkeypatch.setattr(stateful.SV, "standardised", lambda wide, *_: (wide, None))
    monkeypatch.setattr(stateful.SV, "fit_models", lambda *_: [])
    v = Inputs(spark, "/root/testdata/sf0.001")
    wide, *_ = stateful.trained(v)
    assert gathered == [["gene_id"]] and wide.columns == ["gene_id", *stateful.FEATURES]
    cells = {(r.gene_id, f): r[f] for r in wide.collect() for f in stateful.FEATURES}
    theirs = {(r.gene_id, f"{r.score_name}__{r.aggregation}"): r.score for r in ranking.candidate_genes(v).collect()}
    assert cells == theirs
    names = ["gene_id", "n_windows", "top3_mean_score"]
    assert sorted(given[0].select(*names).collect()) == sorted(ranking.one_protein(v).select(*names).collect())


def test_flagship_stores_numbers(spark, monkeypatch):
    """A window is stored once for each profile, without its text."""
    stored, keep = [], scores.durable
    monkeypatch.setattr(scores, "durable", lambda df: stored.append(df.columns) or keep(df))
    lines = pd.DataFrame([(o, o % 40, o % 30, 100.0 + o * 7 % 13 + o / 100, "ANR"[o % 3]) for o in range(3000)])
    lines.columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    docs = pd.DataFrame([(i, "".join(chr(65 + (i * j + j * j // 3) % 26) for j in range(190 + 23 * i)) + " é9") for i in range(60)], columns=["doc_id", "text"])
    labels = pd.DataFrame([(i, i % 4 // 3) for i in range(60)], columns=["doc_id", "toxic"])
    mine, theirs, _ = beside_sql(spark, "flagship_enrichment", documents=docs, lineitem=lines, labels=labels)
    assert mine == theirs and len(mine) == 15
    assert stored and not any("rna_seq" in c for c in stored)


def test_bases_of_any_text(spark):
    texts = ["Abc xyZ", "ßäöÅ é AıK漢字b", "", None, "\x00[`{@Zz\n"]
    docs = pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"])
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    theirs = [None if t is None else "".join("ACGU"[(ord(c) - 65) % 4] for c in re.sub("[^A-Za-z]", "", t).upper()) for t in texts]
    assert {r.transcript_id: r.seq for r in Inputs(spark, folder).tx().collect()} == {f"tx{i}": t for i, t in enumerate(theirs)}


def test_region_diagnostic_stores_no_scores(spark, monkeypatch):
    """Windows are scaled once, and neither they nor the annotation of other transcripts are stored."""
    entry.queries()  # loads the modules that this one takes SQL from
    from seqrank.catalog import context

    scaled, stored, placed, scale, keep = [], [], [], inputs.robust_scales, inputs.durable
    monkeypatch.setattr(inputs, "robust_scales", lambda *a: scaled.append(a) or scale(*a))
    monkeypatch.setattr(inputs, "durable", lambda df: stored.append(df.columns) or keep(df))
    annotate = context.R.annotate_windows
    monkeypatch.setattr(context.R, "annotate_windows", lambda top, annotation: placed.append((top, annotation)) or annotate(top, annotation))
    assert context.region_diagnostic(Inputs(spark, "/root/testdata/sf0.001")).count() > 10
    assert len(scaled) == 1 and not any("structure_only_score" in c for c in stored)
    top, annotation = (df.select("transcript_id").distinct() for df in placed[0])
    assert annotation.join(top, "transcript_id", "left_anti").count() == 0 and annotation.count() > 0


def test_grid_is_stored_once_and_splits_are_dealt_out(spark, monkeypatch):
    entry.queries()  # loads the modules that this one takes SQL from
    from seqrank.catalog import context
    from seqrank.operators import enrichment

    stored, splits, keep, split = [], [], jobs.durable, enrichment.truth_splits
    for module in (context, jobs):
        monkeypatch.setattr(module, "durable", lambda df: stored.append(df.columns) or keep(df))
    monkeypatch.setattr(enrichment, "truth_splits", lambda *a: splits.append(split(*a)) or splits[0])
    assert context.context_calibration(Inputs(spark, "/root/testdata/sf0.001")).count() > 0
    assert stored.count(["gene_id", "family", "candidate", "score"]) == 1
    # an exchange with a number of its own isn't made smaller for a few short rows
    assert "REPARTITION_BY_NUM" in splits[0]._jdf.queryExecution().executedPlan().toString()


def test_distinct_sequences_are_dealt_out(spark):
    """The exchange after the one of ``distinct`` stays in the plan, though it has as many parts."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = repeats.repeat_table(spark.range(9).selectExpr("repeat('ACGU', cast(id as int)) rna_seq"))
    assert "REPARTITION_BY_NUM" in table._jdf.queryExecution().executedPlan().toString() and n == spark.sparkContext.defaultParallelism
