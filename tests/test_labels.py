"""Label extraction policies against hand-written values and a scan by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsift import constants as K
from factsift.functions.labels import extract_label

RAWS = [
    "answer：refutes then supports",
    "UNSUPPORTS",
    "éSUPPORTS",
    "SUPPORTS_",
    "ſupports",
    "not  enough info",
    "none",
    "Answer: not enough info",
    "The evidence SUPPORTS it. REFUTES later",
    " refutes ",
    "\n Refutes.\t",
    "",
]


def scan(text, labels=K.FEVER_LABELS):
    """The leftmost label of an upper-cased text and whether word characters
    touch it: found by position, without a pattern."""
    up = text.upper()
    found = [(at, lab) for lab in labels for at in range(len(up)) if up.startswith(lab, at)]
    for at, lab in sorted(found):
        before, after = up[:at][-1:], up[at + len(lab):][:1]
        yield lab, not any(c.isalnum() or c == "_" for c in (before, after) if c)


def by_scan(text):
    """(lenient, strict) labels of a text."""
    found = list(scan(text))
    whole = [lab for lab, alone in found if alone]
    return (found[0][0] if found else K.UNKNOWN), (whole[0] if whole else K.NO_LABEL)


def _extract(spark, policy):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RAWS)] + [(len(RAWS), None)], "i int, raw string")
    rows = df.select("i", extract_label(F.col("raw"), None, policy).alias("p")).orderBy("i").collect()
    return [r.p for r in rows]


def test_raw_labels(spark):
    got = dict(zip(RAWS, _extract(spark, "raw")))
    assert got["\n Refutes.\t"] == "REFUTES." and got[" refutes "] == "REFUTES" and got[""] == ""
    assert got["not  enough info"] == "NOT  ENOUGH INFO" and got["ſupports"] == "SUPPORTS"
    assert [_extract(spark, p)[-1] for p in ("raw", "lenient", "strict")] == [K.ERROR] * 3


def test_fixture_table(spark):
    expected = {  # raw: (lenient, strict)
        "answer：refutes then supports": ("REFUTES", "REFUTES"),
        "UNSUPPORTS": ("SUPPORTS", "NO_LABEL"),
        "éSUPPORTS": ("SUPPORTS", "NO_LABEL"),
        "SUPPORTS_": ("SUPPORTS", "NO_LABEL"),
        "ſupports": ("SUPPORTS", "SUPPORTS"),
        "not  enough info": ("UNKNOWN", "NO_LABEL"),
        "none": ("UNKNOWN", "NO_LABEL"),
        "Answer: not enough info": ("NOT ENOUGH INFO", "NOT ENOUGH INFO"),
        "The evidence SUPPORTS it. REFUTES later": ("SUPPORTS", "SUPPORTS"),
        "\n Refutes.\t": ("REFUTES", "REFUTES"),
        "": ("UNKNOWN", "NO_LABEL"),
    }
    len_ = dict(zip(RAWS, _extract(spark, "lenient")))
    strict = dict(zip(RAWS, _extract(spark, "strict")))
    for raw, (le, st) in expected.items():
        assert (len_[raw], strict[raw]) == (le, st), raw
    assert dict(zip(RAWS, _extract(spark, "raw")))["\n Refutes.\t"] == "REFUTES."


def test_error_column_wins(spark):
    df = spark.createDataFrame([("SUPPORTS", "boom"), ("SUPPORTS", None)], "raw string, error string")
    got = [r.p for r in df.select(extract_label("raw", "error", "strict").alias("p")).collect()]
    assert got == [K.ERROR, "SUPPORTS"]


def test_extraction_parity_property(spark):
    """Random outputs built from label fragments, separators and Unicode
    letters: lenient and strict extraction agree with a scan by position."""
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    pieces = st.sampled_from(["SUPPORTS", "supports", "REFUTES", "Refutes", "NOT ENOUGH INFO", "not enough info",
                              "NOT  ENOUGH INFO", "UN", "_", "é", "ſ", "answer", "ANSWER:", "：", " ", "\n", "\t",
                              ".", "x", "1", "Ü", "-", "SUPPORT", "REFUTESS"])
    texts = st.lists(st.lists(pieces, max_size=8).map("".join), min_size=50, max_size=50)

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(texts)
    def check(batch):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, raw string")
        rows = (df.select("i", extract_label(F.col("raw"), None, "lenient").alias("le"),
                          extract_label(F.col("raw"), None, "strict").alias("st"))
                .orderBy("i").collect())
        for r, t in zip(rows, batch):
            assert (r.le, r.st) == by_scan(t), t

    check()
