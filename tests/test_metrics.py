"""Metric golden values and report policies."""

from __future__ import annotations

import pytest

from factsift import constants as K
from factsift.operators import metrics as M

CODE = {"S": "SUPPORTS", "R": "REFUTES", "N": "NOT ENOUGH INFO", "E": "ERROR", "U": "UNKNOWN"}
PAIRS = ["SS", "SR", "RR", "RE", "NS", "NN", "NU"]


def tp(spark, pairs):
    return spark.createDataFrame([(CODE[a], CODE[b]) for a, b in pairs], "t string, p string")


def by_label(rep):
    return {r.label: r for r in rep.collect()}


def test_golden_per_class(spark):
    pc = {r.label: r for r in M.per_class(tp(spark, PAIRS)).collect()}
    expect = {"ERROR": (0, 0, 0, 0), "NOT ENOUGH INFO": (1, 1 / 3, 0.5, 3), "REFUTES": (0.5, 0.5, 0.5, 2),
              "SUPPORTS": (0.5, 0.5, 0.5, 2), "UNKNOWN": (0, 0, 0, 0)}
    assert set(pc) == set(expect)
    for lab, (p, r, f, s) in expect.items():
        row = pc[lab]
        assert row.precision == pytest.approx(p) and row.recall == pytest.approx(r)
        assert row.f1 == pytest.approx(f) and row.support == s
    assert [r.label for r in sorted(pc.values(), key=lambda r: r.ord)] == sorted(expect)


def test_report_all_rows(spark):
    rep = by_label(M.report(tp(spark, PAIRS), "all"))
    assert rep["accuracy"].f1 == pytest.approx(3 / 7) and rep["accuracy"].support == 7
    assert rep["accuracy"].precision is None
    assert rep["macro avg"].f1 == pytest.approx((0 + 0.5 + 0.5 + 0.5 + 0) / 5)
    w = (0.5 * 3 + 0.5 * 2 + 0.5 * 2) / 7
    assert rep["weighted avg"].f1 == pytest.approx(w)
    # sum of support equals the row count
    assert sum(r.support for r in rep.values() if r.kind == K.KIND_CLASS) == 7


def test_fixed_labels_zero_fill_and_micro(spark):
    rep = by_label(M.report(tp(spark, PAIRS), "fixed", K.FEVER_LABELS))
    classes = sorted((r for r in rep.values() if r.kind == K.KIND_CLASS), key=lambda r: r.ord)
    assert [r.label for r in classes] == K.FEVER_LABELS
    # ERROR / UNKNOWN predictions exist but are not listed -> micro avg, not accuracy
    assert "micro avg" in rep and "accuracy" not in rep
    assert rep["micro avg"].precision == pytest.approx(3 / 5)   # tp 3 / predicted-as-listed 5
    assert rep["micro avg"].recall == pytest.approx(3 / 7)


def test_fixed_labels_cover_all_gives_accuracy(spark):
    rep = by_label(M.report(tp(spark, ["SS", "SR", "RR"]), "fixed", K.FEVER_LABELS))
    assert "accuracy" in rep and rep["accuracy"].f1 == pytest.approx(2 / 3)
    assert rep["NOT ENOUGH INFO"].support == 0 and rep["NOT ENOUGH INFO"].f1 == 0.0


def test_micro_recall_over_all_labels_equals_accuracy(spark):
    df = tp(spark, PAIRS)
    rep = by_label(M.report(df, "fixed", list(CODE.values())))
    assert rep["accuracy"].f1 == pytest.approx(3 / 7)


def test_valid_only_shrinks_support(spark):
    rep = by_label(M.report(tp(spark, PAIRS), "valid_only", K.FEVER_LABELS))
    assert sum(rep[l].support for l in K.FEVER_LABELS) == 5


def test_exclude_error_keeps_empty_prediction(spark):
    df = spark.createDataFrame([("TRUE", "TRUE"), ("TRUE", "ERROR"), ("FALSE", None), ("ERROR", "TRUE")],
                               "t string, p string")
    rep = by_label(M.report(df, "exclude_error"))
    assert rep["accuracy"].support == 2
    assert "" in rep  # the empty prediction is its own label


def test_empty_table_gives_empty_report(spark):
    df = spark.createDataFrame([], "t string, p string")
    assert M.report(df, "all").count() == 0
    assert M.report(df, "fixed", K.FEVER_LABELS).count() == 0


def test_boolean_looking_column_stays_string(spark):
    df = spark.createDataFrame([("True", "FALSE"), ("TRUE", "true")], "True_Label string, Predicted_Label string")
    t = M.normalise_labels(df, "True_Label", "Predicted_Label")
    assert {r.t for r in t.collect()} == {"TRUE"}


def test_format3_half_even(spark):
    from pyspark.sql import functions as F
    from factsift.functions.text import format3
    vals = [0.0625, 0.5, 0.0005, 0.9995, 1 / 3, 0.8125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(format3("x")).collect()]
    assert got == ["%.3f" % v for v in vals]      # Python's rounding of the exact binary value
