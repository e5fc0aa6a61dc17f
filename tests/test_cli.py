"""The three command-line steps end to end, in-process."""

from __future__ import annotations

import os

from factsift import cli
from factsift.plans import staging

SF = "/root/testdata/sf0.001"


def test_run_combine_evaluate(spark, tmp, capsys):
    claims = staging.claims_jsonl_path(spark, SF)
    pages = staging.pages_path(spark, SF)
    out = os.path.join(tmp, "run")
    cli.main(["run", "--preset", "fever_eep_full", "--claims", claims, "--pages", pages, "--out", out])
    first = capsys.readouterr().out
    assert "scored 87 rows" in first and "accuracy" in first
    cli.main(["run", "--preset", "fever_eep_full", "--claims", claims, "--pages", pages, "--out", out])
    assert "scored 0 rows" in capsys.readouterr().out          # resumed: nothing left
    combined = os.path.join(tmp, "combined")
    cli.main(["combine", "--results", f"{out}/results", "--out", combined])
    assert "combined 87 records" in capsys.readouterr().out
    cli.main(["evaluate", "--combined", combined, "--policy", "exclude_error"])
    report = capsys.readouterr().out
    assert "macro avg" in report and "weighted avg" in report


def test_run_tsv_preset(spark, tmp, capsys):
    out = os.path.join(tmp, "ph")
    cli.main(["run", "--preset", "pubhealth_cot", "--claims", staging.claims_tsv_path(spark, SF), "--out", out])
    text = capsys.readouterr().out
    assert "scored" in text and "accuracy" in text
    assert spark.read.parquet(f"{out}/rejects").count() > 0


def test_run_with_raw_row_limit(spark, tmp, capsys):
    out = os.path.join(tmp, "lim")
    cli.main(["run", "--preset", "pubhealth_eep", "--claims", staging.claims_tsv_path(spark, SF),
              "--out", out, "--limit", "40"])
    capsys.readouterr()
    scored = spark.read.parquet(f"{out}/results").count()
    rejected = spark.read.parquet(f"{out}/rejects").count()
    assert scored + rejected == 40          # the limit counts raw rows, before validation
