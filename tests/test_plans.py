"""Plan properties the scale design relies on."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factsift.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_store_scans_are_column_pruned(spark):
    from factsift.operators.evidence import evidence_refs, resolve_keys
    from factsift.plans import staging
    keys = (evidence_refs(staging.load_claims(spark, SF)).where("title IS NOT NULL")
            .select("title", "idx").distinct())
    plan = _plan(resolve_keys(keys, staging.load_pages(spark, SF)))
    # Parquet inputs: the page store and the wanted titles (claims come from JSON lines)
    schemas = re.findall(r"FileScan parquet [^\n]*?ReadSchema: (struct<.*?>+)(?=\s|$)", plan)
    assert schemas, plan
    assert set(schemas) == {"struct<id:string,lines:string>", "struct<title:string>", "struct<title:string,idxs:array<bigint>>"}, schemas
    # one scan of the store, and uncited pages go before it is exchanged (an adaptive plan prints final and initial)
    final = plan.split("Initial Plan")[0]
    scans = [x for x in final.splitlines() if "FileScan parquet" in x and "struct<id:string,lines:string>" in x]
    assert len(scans) == 1 and "LeftSemi" in final, final


def test_store_rows_behind_the_filter_follow_the_titles(spark):
    from factsift.operators.evidence import cited_pages
    pages = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("0\tx").alias("lines"))
    titles = spark.range(0, 20_000, 400).select(F.concat(F.lit("p"), "id").alias("title"))
    kept = cited_pages(pages.unionByName(pages.limit(1).withColumn("id", F.lit(None).cast("string"))), titles)
    ids = {r.id for r in kept.collect()}
    assert {r.title for r in titles.collect()} <= ids and len(ids) <= 52
    # a filter that is too small lets more pass, never fewer
    assert {r.title for r in titles.collect()} <= {r.id for r in cited_pages(pages, titles, bits=64).collect()}
    plan = _plan(kept).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "hashpartitioning(id" not in plan


def test_claims_scan_is_column_pruned(spark):
    plan = _plan(catalog.QUERIES["a2_class_sizes"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    # class sizes need the label and the reject test (claim present, parse ok);
    # the nested evidence arrays are never read
    assert schemas and all("evidence" not in s for s in schemas), schemas


def test_metrics_shuffle_is_partial(spark):
    plan = _plan(catalog.QUERIES["a3_confusion_counts"](spark, SF))
    assert "partial_count" in plan


def test_sample_ranks_one_slice_of_a_label(spark):
    """Slices are summed and the slice of the n-th draw is ranked; the rest has no window."""
    from factsift.operators import sampling as S
    from factsift.plans import staging
    plan = _plan(S.stratified(staging.load_claims(spark, SF), 5))
    # the ranking reads the checkpointed candidates, not the claims file
    assert "FileScan json" not in plan
    df = spark.range(60_000).select(F.col("id").alias("claim_id"), F.lit("x").alias("label"), F.lit(S._U_RANGE).cast("long").alias("_t"))
    took = S._take_least(df, 40_000, 42, "claim_id", "label")
    assert took.count() == 40_000
    # the side that is ranked: the union's second, behind the last window
    ranked = [x for x in took._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in x]
    assert len(ranked) == 1
    slices = df.select(F.floor(S.uniform_draw(42, "claim_id") / (F.floor(F.col("_t") / 200) + 1)).alias("s")).groupBy("s").count()
    assert slices.agg(F.max("count")).first()[0] < 600


def test_split_reads_its_input_once(spark):
    from factsift.operators import validate as V
    rows = spark.createDataFrame([(0, "c", "t", "true"), (1, None, "t", "TRUE"), (2, "c", "t", "odd")],
                                 "seq long, claim string, main_text string, label string")
    for df in (rows, rows.limit(0), rows.where("seq = 0"), rows.where("seq = 1")):
        plain, once = V.validate(df), V.validate(df, once=True)
        for a, b in zip(plain, once):
            assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
            assert "PartitionFilters: [isnotnull(_rejected" in _plan(b) or not df.count()
