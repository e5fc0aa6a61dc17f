"""Evidence resolution on the handmade edge rows (FIXTURES §2)."""

from __future__ import annotations

from factsift import constants as K
from factsift.operators.evidence import evidence_refs, resolve_evidence

PAGE_P = "\n".join(["0\tzero\tlink", "1\t", "x\tbad", "no tab", "2\ttwo", "2\tsecond two"])

EV = "array<array<array<string>>>"

# (claim_id, evidence, expected evidence text, expected resolution)
CASES = [
    (1, None, K.NO_EVIDENCE, K.RES_NO_EVIDENCE),
    (2, [], K.NO_EVIDENCE, K.RES_NO_EVIDENCE),
    (3, [[["1", None, None, None]]], "", K.RES_NO_USABLE),
    (4, [[]], "", K.RES_NO_USABLE),
    (5, [[["1", "2", "P", "0"]]], "zero\tlink", K.RES_RESOLVED),
    (6, [[["1", "2", "P", "1"]]], "", K.RES_RESOLVED),
    (7, [[["1", "2", "P", "2"]]], "two", K.RES_RESOLVED),
    (8, [[["1", "2", "P", "9"]]], "[Sentence index 9 not found in P]", K.RES_SENTENCE_MISS),
    (9, [[["1", "2", "p", "0"]]], "[Page not found: p]", K.RES_PAGE_MISS),
    (10, [[["1", "2", None, "0"]]], "[Page not found: None]", K.RES_PAGE_MISS),
    (11, [[["1", "2", "P", "2"], ["1", "3", "P", "0"], ["1", "4", "P", "2"]]], "two zero\tlink two", K.RES_RESOLVED),
    (12, [[["1", "2", "P", "2"]], [["1", "3", "P", "0"]]], "two", K.RES_RESOLVED),
    (13, [[["1", "2", "P"]]], "", K.RES_NO_USABLE),
    (14, [[["1", "2", "P", "2.0"]]], "", K.RES_NO_USABLE),
    (15, [[["1", "2", "P", "true"]]], "", K.RES_NO_USABLE),
    (16, [[["1", "2", "P", "2"], ["1", "2", "Q", "0"]]], "two [Page not found: Q]", K.RES_PAGE_MISS),
    (17, [[["1", "2", "P", "10000000000"]]], "[Sentence index 10000000000 not found in P]", K.RES_SENTENCE_MISS),
]


def _frames(spark):
    claims = spark.createDataFrame([(cid, f"c{cid}", "SUPPORTS", ev) for cid, ev, _, _ in CASES],
                                   f"claim_id long, claim string, label string, evidence {EV}")
    pages = spark.createDataFrame([("P", PAGE_P), ("R", "0\tother")], "id string, lines string")
    return claims, pages


def test_edge_rows(spark):
    claims, pages = _frames(spark)
    got = {r.claim_id: (r.evidence, r.resolution)
           for r in resolve_evidence(claims, pages).collect()}
    for cid, _, text, res in CASES:
        assert got[cid] == (text, res), cid


def test_edge_rows_with_repeated_page_ids(spark):
    claims, pages = _frames(spark)
    pages = pages.union(pages)
    got = {r.claim_id: r.evidence for r in resolve_evidence(claims, pages).collect()}
    for cid, _, text, _ in CASES:
        assert got[cid] == text, cid


def test_refs_keep_order_and_duplicates(spark):
    claims, _ = _frames(spark)
    rows = evidence_refs(claims.where("claim_id = 11")).orderBy("pos").collect()
    assert [(r.pos, r.title, r.idx) for r in rows] == [(0, "P", 2), (1, "P", 0), (2, "P", 2)]


def test_order_invariant_under_repartition(spark):
    claims, pages = _frames(spark)
    a = sorted(resolve_evidence(claims, pages).collect())
    b = sorted(resolve_evidence(claims.repartition(7), pages.repartition(3)).collect())
    assert a == b


def _parents_of(plan: str, needle: str) -> list[str]:
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if needle in line:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            for j in range(i - 1, -1, -1):
                d = len(lines[j]) - len(lines[j].lstrip(" :+-*()0123456789"))
                if d < depth:
                    out.append(lines[j].strip())
                    break
    return out


def test_bucketed_page_store_is_not_shuffled(spark, tmp):
    from factsift.sources.pages import read_page_store, write_page_store
    claims, pages = _frames(spark)
    write_page_store(pages, f"{tmp}/pb", table="test_pages_bucketed", buckets=4)
    store = read_page_store(spark, "test_pages_bucketed", table=True)
    prev = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        from factsift.operators.evidence import resolve_keys
        df = resolve_evidence(claims, store)
        got = {r.claim_id: r.evidence for r in df.collect()}
        keys = evidence_refs(claims).where("title IS NOT NULL").select("title", "idx").distinct()
        resolved = resolve_keys(keys, store)
        resolved.collect()
        plan = resolved._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", prev or "10485760")
    assert all(got[cid] == text for cid, _, text, _ in CASES)
    parents = _parents_of(plan, "test_pages_bucketed")
    assert parents and not any("Exchange" in p for p in parents), parents


def test_hot_key_join_is_skew_split(spark):
    """A third of all references cite one (title, idx): the join back to the
    resolved keys must be split by AQE, not land in one task."""
    from pyspark.sql import functions as F
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 30000, 1, 8)
        title = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string")))
        idx = F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise((F.col("id") % 4).cast("string"))
        claims = ids.select(F.col("id").alias("claim_id"), F.lit("c").alias("claim"), F.lit("SUPPORTS").alias("label"),
                            F.array(F.array(F.array(F.col("id").cast("string"), F.lit("0"), title, idx))).alias("evidence"))
        pages = spark.range(500).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"),
                                        F.lit("0\ta\n1\tb\n2\tc\n3\td").alias("lines"))
        pages = pages.union(spark.createDataFrame([("HOT", "0\thot")], "id string, lines string"))
        df = resolve_evidence(claims, pages)
        got = {r.evidence: r["count"] for r in df.groupBy("evidence").count().collect()}
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert got["hot"] == 10000 and sum(got.values()) == 30000
    assert "SortMergeJoin(skew=true)" in plan
