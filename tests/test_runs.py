"""Scorer isolation, prompt rendering, scored runs with resume, streaming."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.functions.prompts import render, templates_frame
from factsift.operators.scoring import LexicalVerifier, score
from factsift.operators.evidence import ROW_HASH, row_hash
from factsift.plans import presets as P

EV = "array<array<array<string>>>"


def test_scorer_failures_are_isolated(spark):
    class Flaky:
        def __call__(self, claim, evidence, prompt=None):
            if claim == "bad":
                raise RuntimeError("rate limited")
            return "SUPPORTS"
    df = spark.createDataFrame([("ok", "e"), ("bad", "e"), ("ok2", "e")], "claim string, evidence string")
    rows = {r.claim: (r.raw, r.error) for r in score(df, Flaky, prompt=None).collect()}
    assert rows["ok"] == ("SUPPORTS", None) and rows["ok2"] == ("SUPPORTS", None)
    assert rows["bad"] == (None, "RuntimeError: rate limited")


def test_prompt_render_is_verbatim(spark):
    df = spark.createDataFrame([(1, "claim with {evidence} and 50%", "ev %s")], "claim_id long, claim string, evidence string")
    t = templates_frame(spark, [("fever", "x", "H:", "|M|", "|T")])
    row = render(df, t, "fever").first()
    assert row.prompt == "H:claim with {evidence} and 50%|M|ev %s|T" and row.strategy == "x"


def test_verifier_variety():
    v = LexicalVerifier("fever")
    assert v("Apple pie", K.NO_EVIDENCE) == "Answer: not enough info"
    assert v("Apple pie", "") == "I cannot tell."
    assert v("Apple pie", "an apple a day") .endswith("SUPPORTS")
    assert v("Apple pie", "pear") == "UNSUPPORTS"


def _claims(spark, n=23):
    rows = [(i, f"w{i} claim", "SUPPORTS" if i % 2 else "REFUTES", [[[str(i), "0", "P", str(i % 3)]]])
            for i in range(n)]
    return spark.createDataFrame(rows, f"claim_id long, claim string, label string, evidence {EV}")


def _resolved(spark, n=23):
    from factsift.operators.evidence import resolve_evidence
    pages = spark.createDataFrame([("P", "0\tw1 text\n1\tother w2")], "id string, lines string")
    return resolve_evidence(_claims(spark, n), pages)


def test_scored_run_resume_adds_nothing(spark, tmp):
    preset = P.PRESETS["fever_eep_full"]
    out = os.path.join(tmp, "run")
    res, counters = P.scored_run(spark, _resolved(spark), preset, out)
    assert res.count() == 23 and counters["rows"] == 23
    res2, counters2 = P.scored_run(spark, _resolved(spark), preset, out)
    assert res2.count() == 23 and counters2["rows"] == 0


def test_resume_after_losing_a_batch_equals_clean_run(spark, tmp):
    preset = P.PRESETS["pubhealth_eep"]  # batch size 100 -> use many small batches below
    small = P.Preset(**{**preset.__dict__, "name": "tiny", "dataset": "fever", "batch_size": 5})
    clean_dir, broken_dir = os.path.join(tmp, "clean"), os.path.join(tmp, "broken")
    clean, _ = P.scored_run(spark, _resolved(spark), small, clean_dir)
    P.scored_run(spark, _resolved(spark), small, broken_dir)
    files = sorted(f for f in os.listdir(broken_dir) if f.endswith(".parquet"))
    lost = spark.read.parquet(os.path.join(broken_dir, files[0])).count()
    os.remove(os.path.join(broken_dir, files[0]))          # a lost result file
    redone, counters = P.scored_run(spark, _resolved(spark), small, broken_dir)
    assert lost > 0 and counters["rows"] == lost
    cols = ["claim_id", "seq", "batch_id", "Predicted_Label"]
    assert sorted(redone.select(cols).collect()) == sorted(clean.select(cols).collect())


def test_sampled_preset_runs(spark, tmp):
    preset = P.Preset(**{**P.PRESETS["fever_selfask"].__dict__, "per_class": 4, "batch_size": 3})
    res, _ = P.scored_run(spark, _resolved(spark), preset, os.path.join(tmp, "s"))
    assert res.count() == 8
    assert sorted(r.batch_id for r in res.select("batch_id").distinct().collect()) == [0, 1, 2]
    rep = P.run_report(res, preset).where(F.col("kind") == "class").collect()
    assert {r.label for r in rep} == set(K.FEVER_LABELS)


def test_stream_second_run_adds_nothing(spark, tmp):
    from factsift.sources.claims import write_claims_jsonl
    from factsift.streaming.resumable import stream_score
    inp, out, ck = (os.path.join(tmp, x) for x in ("in", "out", "ck"))
    write_claims_jsonl(_claims(spark), inp)
    pages = spark.createDataFrame([("P", "0\tw1 text\n1\tother w2")], "id string, lines string")
    spark.read.text(inp).repartition(7).write.mode("append").text(inp)      # more files of the same claims
    seen = stream_score(spark, inp, pages, out, ck)
    n1 = spark.read.parquet(out).select(ROW_HASH).distinct().count()
    # micro-batches follow bytes: one for all files
    assert (seen["epochs"], seen["rows"], seen["errors"], seen["rejects"]) == (1, 46, 0, 0)
    assert stream_score(spark, inp, pages, out, ck)["rows"] == 0
    assert n1 == 23 and spark.read.parquet(out).count() == 46


def test_replayed_epoch_appends_nothing(spark, tmp):
    from factsift.streaming.resumable import _epoch_writer
    pages = spark.createDataFrame([("P", "0\tw1 text\n1\tother w2")], "id string, lines string")
    out = os.path.join(tmp, "out")
    write = _epoch_writer(pages, out, "fever", "eep", "raw", lambda: LexicalVerifier("fever"))
    reject = F.when(F.col("claim_id") == 11, "missing claim")

    def lines(n):
        c = _claims(spark, n).withColumn("claim_id", F.when(F.col("claim_id") != 3, F.col("claim_id")))
        return c.withColumn("reject_reason", reject).withColumn("line", F.lit(None).cast("string")).withColumn(ROW_HASH, row_hash(c))

    batch = lines(10)
    write(batch, 0)
    write(batch, 0)          # replay of the same epoch after a crash
    write(lines(12).where("claim_id >= 10"), 1)
    df = spark.read.parquet(out)
    # a claim without an id keeps its evidence and isn't appended again
    assert df.count() == 11 and df.select(ROW_HASH).distinct().count() == 11
    assert df.where("claim_id IS NULL").count() == 1 and df.where("Evidence = ''").count() == 0
    assert spark.read.parquet(out + "-rejects").count() == 1



@pytest.mark.parametrize("name", sorted(P.PRESETS))
def test_every_preset_runs(spark, tmp, name):
    """All seven presets end to end on a small claim set (per-class size 3
    where the preset samples): rows stored, result columns, report rows."""
    base = P.PRESETS[name]
    preset = P.Preset(**{**base.__dict__, "per_class": 3 if base.sampling else None})
    labels = preset.labels
    rows = [(i, f"w{i} claim", labels[i % len(labels)], f"w{i} text" if i % 4 else "")
            for i in range(24)]
    claims = spark.createDataFrame(rows, "claim_id long, claim string, label string, evidence string")
    res, counters = P.scored_run(spark, claims, preset, os.path.join(tmp, name))
    expected = 3 * len(labels) if preset.sampling else 24
    assert res.count() == expected == counters["rows"]
    assert (K.RAW_OUTPUT_COLUMN in res.columns) == preset.raw_output_column
    assert res.select("batch_id").distinct().count() == -(-expected // preset.batch_size)
    rep = P.run_report(res, preset).collect()
    assert any(r.kind in (K.KIND_ACCURACY, K.KIND_MICRO) for r in rep)


def test_strict_preset_guard_raises(spark, tmp):
    preset = P.PRESETS["fever_cot"]           # exactly 666 per class
    claims = spark.createDataFrame([(i, "c", "SUPPORTS", "e") for i in range(10)],
                                   "claim_id long, claim string, label string, evidence string")
    with pytest.raises(ValueError, match="Not enough samples"):
        P.scored_run(spark, claims, preset, os.path.join(tmp, "cot"))


def test_state_table_has_no_per_batch_folders(spark, tmp):
    preset = P.Preset(**{**P.PRESETS["fever_eep_sampled"].__dict__, "per_class": 5})   # batch size 5
    out = os.path.join(tmp, "state")
    res, _ = P.scored_run(spark, _resolved(spark), preset, out)
    assert res.select("batch_id").distinct().count() == 2
    assert not [d for d in os.listdir(out) if d.startswith("batch_id=")]


def test_prompts_are_made_where_they_are_scored(spark, tmp_path, monkeypatch):
    """the shuffle by batch moves claim and evidence once, without the prompt that repeats them."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from factsift.plans import presets
    plans, run = [], Frame.mapInArrow

    def seen(self, *args, **kw):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return run(self, *args, **kw)

    monkeypatch.setattr(Frame, "mapInArrow", seen)
    claims = spark.createDataFrame([(i, f"claim {i}", "evidence", "SUPPORTS") for i in range(700)],
                                   "claim_id long, claim string, evidence string, label string")
    results, counters = presets.scored_run(spark, claims, presets.PRESETS["fever_eep_full"], str(tmp_path / "run"))
    assert counters["rows"] == results.count() == 700
    above, _, below = plans[0].partition("hashpartitioning(batch_id")
    assert below and "concat(" in above and "concat(" not in below


def test_a_batch_is_scored_in_slices(spark):
    """only some rows of an Arrow batch are Python strings at a time, and all are scored."""
    import pyarrow as pa

    from factsift.operators import scoring
    rows = pa.RecordBatch.from_pydict({"id": list(range(1000)), "claim": [f"c{i}" for i in range(999)] + [None], "evidence": ["e"] * 1000})
    run = scoring._score_partitions(lambda: lambda claim, evidence, prompt: claim.upper(), "claim", "evidence", None, ["id"], scoring.Calls())
    out = list(run(iter([rows])))
    assert max(b.num_rows for b in out) <= scoring.SLICE_ROWS
    table = pa.Table.from_batches(out).to_pydict()
    assert table["id"] == list(range(1000)) and table["raw"] == [f"C{i}" for i in range(999)] + [None]
    assert table["error"][:999] == [None] * 999 and table["error"][999].startswith("AttributeError")
