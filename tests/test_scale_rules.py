"""Runs that die, result files of any shape, and values longer than their column."""

import csv
import dataclasses
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.operators import metrics as M
from factsift.operators import sampling as S
from factsift.operators.evidence import ROW_HASH, resolve_evidence, row_hash
from factsift.plans import presets as P
from factsift.operators import scoring as D
from factsift.sources import results as R
from factsift.sources.batch_files import write_batch_files


class DiesAt:
    def __init__(self, claim):
        self.claim = claim

    def __call__(self, claim, evidence, prompt):
        if claim == self.claim:
            raise SystemExit("the scorer died")   # not an Exception: it takes the task with it
        return "SUPPORTS"


def _run_claims(spark, n):
    return spark.createDataFrame([(i, f"c{i}", "e", "SUPPORTS") for i in range(n)],
                                 "claim_id long, claim string, evidence string, label string")


@pytest.mark.parametrize("parallelism", [1, 6])
def test_a_dead_run_keeps_its_finished_batches(spark, tmp, parallelism):
    """Default settings, one task: the scorer takes the worker down on the last row."""
    preset = dataclasses.replace(P.PRESETS["fever_eep_full"], batch_size=10)
    claims, out = _run_claims(spark, 400), f"{tmp}/run"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(Exception):
            P.scored_run(spark, claims, preset, out, lambda: DiesAt("c399"), parallelism=parallelism)
        kept = spark.read.parquet(out)
        assert kept.count() == 390 and kept.select("batch_id").distinct().count() == 39
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    results, seen = P.scored_run(spark, claims, preset, out, lambda: DiesAt(None), parallelism=parallelism)
    assert results.count() == 400 and seen["rows"] == 10
    assert results.select("claim_id").distinct().count() == 400


def test_batches_of_a_session_that_was_cut_off_are_kept(spark, tmp, monkeypatch):
    """The driver dies before, and once more behind, the append of the finished batches."""
    preset = dataclasses.replace(P.PRESETS["fever_eep_full"], batch_size=10)
    claims, out = _run_claims(spark, 60), f"{tmp}/run"
    with monkeypatch.context() as m:
        m.setattr(P, "collect_open", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()) if a[2] in started else started.append(a[2]) or {})
        started = []
        with pytest.raises(KeyboardInterrupt):
            P.scored_run(spark, claims, preset, out)
    with monkeypatch.context() as m:
        m.setattr(P.files, "delete_files", lambda *a: None)
        P.collect_open(spark, preset, out)
    results, seen = P.scored_run(spark, claims, preset, out, lambda: DiesAt("c5"))    # nothing is left to score
    assert results.count() == 60 and seen["rows"] == 0


class Slow:
    """Counts the calls that are in flight at once, in one process."""
    lock, now, most = threading.Lock(), 0, 0

    def __call__(self, claim, evidence, prompt):
        with Slow.lock:
            Slow.now += 1
            Slow.most = max(Slow.most, Slow.now)
        time.sleep(0.02)
        with Slow.lock:
            Slow.now -= 1
        return f"{Slow.most}"


def test_calls_in_flight_do_not_depend_on_tasks(spark, tmp):
    preset = dataclasses.replace(P.PRESETS["fever_cot"], sampling=None, batch_size=50)
    begin = time.monotonic()
    results, _ = P.scored_run(spark, _run_claims(spark, 1600), preset, f"{tmp}/r", Slow, parallelism=64)
    seen = [int(r[0]) for r in results.select(K.RAW_OUTPUT_COLUMN).collect()]
    assert max(seen) == 64 // 4 and len(seen) == 1600            # four tasks at once, 16 calls each
    assert time.monotonic() - begin < 20                        # 32 s of calls, one at a time


def test_retries_and_rate():
    tries = []

    class Flaky:
        def __call__(self, claim, evidence, prompt):
            tries.append(time.monotonic())
            if len(tries) < 3:
                raise TimeoutError("busy")
            if claim == "bad":
                raise ValueError("no")
            return "TRUE"

    caller = D.Caller(Flaky, D.Calls(retries=2, backoff=0.01, per_second=50, transient=(TimeoutError,)))
    assert caller.call("c", "e", None) == ("TRUE", None) and len(tries) == 3
    assert tries[1] - tries[0] >= 0.02 and caller.call("bad", "e", None) == (None, "ValueError: no") and len(tries) == 4


def test_rows_without_their_own_id_keep_their_own_evidence(spark):
    claims = spark.createDataFrame(
        [(1, "a", [[["0", "0", "P", "0"]]]), (1, "b", [[["0", "0", "P", "1"]]]), (None, "c", [[["0", "0", "P", "0"], ["0", "0", None, "0"]]]),
         (None, "d", None), (1, "a", [[["0", "0", "P", "0"]]])], "id long, claim string, evidence array<array<array<string>>>")
    pages = spark.createDataFrame([("P", "0\tzero\n1\tone\n0\tagain"), ("P", "0\tzero\n1\tone\n0\tagain")], "id string, lines string")
    got = resolve_evidence(claims.withColumn(ROW_HASH, row_hash(claims)), pages, keep=["id", "claim"], key=ROW_HASH).collect()
    assert sorted((r.claim, r.evidence) for r in got) == [
        ("a", "zero"), ("a", "zero"), ("b", "one"), ("c", "zero [Page not found: None]"), ("d", K.NO_EVIDENCE)]


def test_result_files_are_read_by_their_header(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "x_result_1.csv").write_text('Claim,Evidence,True_Label,Predicted_Label\n"a, b",e,FALSE,TRUE\n')
    (folder / "x_result_2.csv").write_text('Predicted_Label,Raw_Output,Claim,Extra,True_Label\nTRUE,"two\nlines",c,z,FALSE\n')
    (folder / "x_result_final.csv").write_text("Claim,Evidence\nnot,read\n")
    got = sorted(map(tuple, R.read_result_folder(spark, str(folder)).drop("file_name").collect()), key=lambda r: r[-1])
    assert got == [("a, b", "e", "FALSE", "TRUE", None, 1), ("c", None, "FALSE", "TRUE", "two\nlines", 2)]


def test_long_support_keeps_its_digits(spark):
    rep = spark.createDataFrame([("SUPPORTS", K.KIND_CLASS, 0, 1.0, 1.0, 1.0, 12_345_678_901)],
                                "label string, kind string, ord int, precision double, recall double, f1 double, support long")
    lines = [r.line for r in M.report_text(rep).collect()]
    assert any(x.endswith(" 12345678901") for x in lines)


def test_sampling_with_null_and_many_labels(spark):
    rows = [(i, None if i % 3 == 0 else f"l{i % 1500}") for i in range(6000)]
    df = spark.createDataFrame(rows, "claim_id long, label string")
    got = S.stratified(df, 2, mode="cap").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {lab: min(2, n) for lab, n in
                                                   ((r["label"], r["count"]) for r in df.groupBy("label").count().collect())}


def test_batch_export_has_a_file_per_batch(spark, tmp):
    df = spark.range(0, 400, 1, 8).select((F.col("id") % 20).alias("batch_id"), F.col("id").cast("string").alias("Claim"))
    R.write_batches(df, f"{tmp}/b", fmt="csv")
    files = [r[0] for r in spark.read.option("header", "true").csv(f"{tmp}/b").select(F.input_file_name()).distinct().collect()]
    assert len(files) == 20


def test_batch_files_are_named_whole_and_replaced(spark, tmp):
    df = spark.range(0, 400, 1, 8).select((F.col("id") % 20).alias("batch_id"), F.col("id").alias("seq"),
                                          F.concat(F.lit('say "x",\n'), "id").alias("Claim"), F.lit(None).cast("string").alias("Evidence"),
                                          F.lit("").alias("True_Label"), F.lit(" p ").alias("Predicted_Label"))
    write_batch_files(df, f"{tmp}/b", "dev")
    names = sorted(os.listdir(f"{tmp}/b"))
    assert names == sorted(f"dev_result_{k}.csv" for k in range(20))
    with open(f"{tmp}/b/dev_result_3.csv", encoding="utf-8", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == K.RESULT_COLUMNS and [r[0] for r in rows[1:]] == [f'say "x",\n{i}' for i in range(3, 400, 20)]
    write_batch_files(df.where("seq = 3"), f"{tmp}/b", "dev")                     # only the batch it holds
    back = R.read_result_folder(spark, f"{tmp}/b")
    assert back.count() == 381 and back.where("batch_id = 3").count() == 1
    assert tuple(back.select("Evidence", "True_Label", "Predicted_Label").distinct().collect()[0]) == (None, "", " p ")


def test_a_failed_write_of_batch_files_leaves_nothing(spark, tmp):
    bad = F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise("x").alias("Claim")
    with pytest.raises(Exception):
        write_batch_files(spark.range(0, 400, 1, 4).select((F.col("id") % 7).alias("batch_id"), bad), f"{tmp}/b", "dev")
    assert not os.path.isdir(f"{tmp}/b") or not os.listdir(f"{tmp}/b")
