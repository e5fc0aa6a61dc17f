"""File sources and sinks on handwritten files (FIXTURES §2)."""

from __future__ import annotations

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.operators import combine as C
from factsift.operators.validate import reject_counts, validate
from factsift.sources import claims as SC
from factsift.sources import results as R
from factsift.sources.delimited import read_delimited

JSONL = "\n".join([
    '{"id": 1, "claim": "a", "label": "refutes", "evidence": [[[10, 20, "P", 3]]]}',
    "",
    '{"id": 2, "claim": "b", "evidence": [[[10, 20, "P", true]]]}',
    '{"id": 3, "label": "SUPPORTS"}',
    "{not json",
    '{"id": 4, "claim": "d", "label": null, "evidence": [[[10, 20, "P", 2.0], [1, 2, "Q", 5]]]}',
    '{"id": 5, "claim": "e", "label": "SUPPORTS", "evidence": []}',
]) + "\n"


def test_jsonl_reader(spark, tmp):
    path = os.path.join(tmp, "claims.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write(JSONL)
    df = SC.read_claims_jsonl(spark, path)
    rows = {r.seq: r for r in df.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5]          # blank line: no row, no index
    assert rows[0].label == "REFUTES" and rows[0].evidence == [[["10", "20", "P", "3"]]]
    assert rows[1].label == K.DEFAULT_JSONL_LABEL       # absent label defaults
    assert rows[2].reject_reason == "missing claim"
    assert rows[3].reject_reason == "malformed json"
    assert rows[4].label == K.DEFAULT_JSONL_LABEL       # null label defaults too
    clean, rejects = SC.split_rejects(df)
    assert clean.count() == 4 and rejects.count() == 2
    from factsift.operators.evidence import evidence_refs
    refs = evidence_refs(clean).collect()
    # bool and float indexes are not integers; only claim 1's reference and Q:5 are usable
    assert sorted((r.claim_id, r.title, r.idx) for r in refs) == [(1, "P", 3), (4, "Q", 5)]


def test_jsonl_writer_roundtrip(spark, tmp):
    claims = spark.createDataFrame(
        [(7, 'say "hi"\nnow', "SUPPORTS", [[["7", "0", "doc_7", "1"], ["7", "1", None, "2.0"]]]),
         (8, "x", None, None)],
        "claim_id long, claim string, label string, evidence array<array<array<string>>>")
    path = os.path.join(tmp, "out")
    SC.write_claims_jsonl(claims, path)
    back = {r.claim_id: r for r in SC.read_claims_jsonl(spark, path, strict=False).collect()}
    assert back[7].claim == 'say "hi"\nnow' and back[7].evidence[0][1][2] is None
    assert back[7].evidence[0][1][3] == "2.0" and back[8].label == K.DEFAULT_JSONL_LABEL
    assert back[8].evidence is None


def _write_tsv(path, rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(rows)


TSV = (
    "claim_id\tclaim\tmain_text\tlabel\textra\n"
    '1\tok claim\t"he said ""x""\nline2\tz"\ttrue\n'
    "2\t\tbody\tfalse\n"
    "3\t   \tbody\tFALSE\n"
    "4\tshort\n"
    "\n"
    "5\t\tbody\tSNOPES\n"
    "6\tc\tbody\t mixture\n"
    "7\tc\tbody\tSNOPES\n"
    "8\tc\tbody\tunproven\tEXTRA\tMORE\n"
)


def test_tsv_reader_and_validation(spark, tmp):
    path = os.path.join(tmp, "dev.tsv")
    _write_tsv(path, TSV)
    df = SC.read_claims_tsv(spark, path)
    rows = {r.seq: r for r in df.collect()}
    # Python's csv module gives the same fields
    py = list(csv.DictReader(io.StringIO(TSV), delimiter="\t"))
    py = [r for r in py if any(v for v in r.values() if v)]
    assert len(rows) == len(py) == 8
    assert rows[0].main_text == 'he said "x"\nline2\tz' == py[0]["main_text"]
    clean, rejects = validate(df)
    got = {r.seq: r.reject_reason for r in rejects.collect()}
    assert got == {1: "missing fields", 3: "missing fields", 4: "missing fields",
                   5: "invalid label:  MIXTURE", 6: "invalid label: SNOPES"}
    assert {r.seq: r.label for r in clean.collect()} == {0: "TRUE", 2: "FALSE", 7: "UNPROVEN"}
    counts = {r.reason: r.n_rows for r in reject_counts(rejects).collect()}
    assert counts == {"missing fields": 3, "invalid label": 2}
    # the raw-row limit applies before the filters
    clean2, rej2 = validate(df, limit=2)
    assert clean2.count() == 1 and rej2.count() == 1


def _result_csv(path, header, rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_result_folder_scan_and_combine(spark, tmp):
    four = K.RESULT_COLUMNS
    five = K.RESULT_COLUMNS + [K.RAW_OUTPUT_COLUMN]
    _result_csv(os.path.join(tmp, "fever_dev_result_0.csv"), four, [["c0", "e, with comma", "SUPPORTS", "SUPPORTS"]])
    _result_csv(os.path.join(tmp, "fever_dev_result_1.csv"), four, [["c1", 'q "x"\nz', "REFUTES", "ERROR"]])
    _result_csv(os.path.join(tmp, "fever_dev_result_10.csv"), four, [["c10", "", "TRUE", "FALSE"]])
    _result_csv(os.path.join(tmp, "fever_dev_result_3.csv"), five, [["c3", "e", "SUPPORTS", "UNKNOWN", "raw text"]])
    _result_csv(os.path.join(tmp, "fever_dev_combined.csv"), four, [["stray", "x", "x", "x"]])
    df = R.read_result_folder(spark, tmp)
    rows = {r.batch_id: r for r in df.collect()}
    assert sorted(rows) == [0, 1, 3, 10]                       # combined file not re-read
    assert rows[1].Evidence == 'q "x"\nz' and rows[0].Evidence == "e, with comma"
    assert rows[3].Raw_Output == "raw text" and rows[0].Raw_Output is None
    assert rows[10].True_Label == "TRUE"                       # stays a string
    ordered = [r.batch_id for r in C.batch_order(df, seq=None).collect()]
    assert ordered == [0, 1, 3, 10]                            # numeric, not lexicographic
    assert C.total_rows(df).first().total_rows == 4


def test_csv_export_roundtrip(spark, tmp):
    df = spark.createDataFrame([(0, "  padded ", "", None, 'quote "q"\nnl')],
                               "batch_id long, Claim string, Evidence string, Raw_Output string, True_Label string")
    out = os.path.join(tmp, "csv")
    R.write_batches(df, out, fmt="csv")
    back = R.read_batches(spark, out, fmt="csv").first()
    assert back.Claim == "  padded " and back.Evidence == "" and back.Raw_Output is None
    assert back.True_Label == 'quote "q"\nnl'


def test_union_by_name_fills_missing(spark):
    a = spark.createDataFrame([("x", "S")], "Claim string, True_Label string")
    b = spark.createDataFrame([("y", "R", "raw")], "Claim string, True_Label string, Raw_Output string")
    rows = C.combine([a, b]).orderBy("Claim").collect()
    assert rows[0].Raw_Output is None and rows[1].Raw_Output == "raw"


def test_report_sink(spark, tmp):
    from factsift.operators import metrics as M
    df = spark.createDataFrame([("S", "S"), ("S", "R")], "t string, p string")
    rep = M.report(df, "all")
    R.write_report(rep, M.report_text(rep), os.path.join(tmp, "rep"))
    lines = [r.value for r in spark.read.text(os.path.join(tmp, "rep", "text")).collect()]
    assert any("accuracy" in l and "0.500" in l for l in lines)
    assert spark.read.parquet(os.path.join(tmp, "rep", "metrics")).where(F.col("kind") == "class").count() == 2


def test_only_json_integers_are_sentence_indexes(spark, tmp):
    from factsift.operators.evidence import evidence_refs
    kinds = ["0", '"0"', "0.0", "true", "null", "1e2", "[0]", "-5", "123456789012345678901"]
    path = os.path.join(tmp, "kinds.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f'{{"id": {i}, "claim": "c", "evidence": [[[1, 2, "T", {k}], ["T"], "x"], 5]}}\n' for i, k in enumerate(kinds))
        f.write('{"id": 100, "claim": "c", "evidence": "x"}\n{"id": 101, "claim": "c", "evidence": []}\n')

    def usable(**how):
        return sorted((r.claim_id, r.idx) for r in evidence_refs(SC.read_claims_jsonl(spark, path, **how)).collect())

    assert usable() == usable(with_seq=False) == [(0, 0), (7, -5)]


def _python_rows(texts, sep):
    """The rows of Python's csv module, file after file, under a header that names x and y."""
    out = []
    for text in texts:
        for r in csv.DictReader(io.StringIO(text, newline=None), delimiter=sep):
            out.append((r.get("x"), r.get("y")))
    return out


def _delimited(spark, folder, texts, sep="\t", **how):
    os.makedirs(folder)
    for i, text in enumerate(texts):
        with open(os.path.join(folder, f"f{i:03}.txt"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    rows = read_delimited(spark, folder, ["x", "y"], sep, **how).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    return [(r.x, r.y) for r in rows]


@pytest.mark.parametrize("block", [1, 9, 1 << 20])
def test_delimited_equals_python_csv_at_any_split(spark, tmp, block):
    """Random quoting, good and bad, read in blocks of a few bytes."""
    pick = random.Random(block)
    bits = ['"', '""', '"abc" def', "a", "\t", "\t", "\n", "\r\n", "é", " ", ",", 'x"y', '"q\tq\nq"']
    texts = ["y\tx\tx\r\n" + "".join(pick.choices(bits, k=pick.randrange(60))) for _ in range(10 if block < 100 else 60)]
    texts += ["x\ty\n", "x\ty\n\n1\t2", 'x\ty\n1\t"open\nto the end\n', "x\ty\n" + '"a ""b""\n' * 9, "z\n1\n"]
    if block == 1:     # the header must lie in the first block
        texts = [t.split("\n", 1)[-1] for t in texts]
        texts = ["x\n" + t for t in texts if t]
    # a quote left open ends with its file, but for the file's last newline
    texts = [t.rstrip("\r\n") for t in texts]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(block, 2 if block == 1 else 8)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert _delimited(spark, os.path.join(tmp, "d"), texts) == _python_rows(texts, "\t")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("limit", [0, 1, 3, 40, 10_000])
def test_limit_reads_leading_records(spark, tmp, limit):
    texts = ["x\ty\n" + "".join(f'"{i}\n{k}"\t{k}\n' for k in range(8)) for i in range(9)]
    assert _delimited(spark, os.path.join(tmp, "d"), texts, limit=limit) == _python_rows(texts, "\t")[:limit]
    folder = os.path.join(tmp, "j")
    os.makedirs(folder)
    for i in range(9):
        with open(os.path.join(folder, f"{i}.jsonl"), "w") as f:
            f.writelines(f'{{"claim": "{i}-{k}"}}\n' for k in range(8))
    df = SC.read_claims_jsonl(spark, folder, limit=limit)
    assert [r.claim for r in df.orderBy("seq").collect()] == [f"{i}-{k}" for i in range(9) for k in range(8)][:limit]
    if limit == 3:
        assert len(df.inputFiles()) == 1
