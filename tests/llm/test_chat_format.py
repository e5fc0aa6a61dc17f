import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factsift.llm import chat_format as C
from tests.oracle_check import compare

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, w string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<\\/s>", "<\\\\s>", "[\\INST]", "\\", "<", "[", "/", "s>", "INST]", "é", "\n", "$1", "a"]


def want(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append(((t is not None, t), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:5] for r in C.read_back(C.format_chats(df)).collect()}


def test_any_content_survives(spark):
    pick = random.Random(7)
    rows = [(pick.randrange(1500), pick.choice([None, 0, 1, 2, 3]), pick.choice(["user", "assistant", "", None, "[INST]", "<s>x"]),
             None if pick.random() < 0.05 else "".join(pick.choices(BITS, k=pick.randrange(8))), "f", "w") for _ in range(6000)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == want(rows)


def test_edges(spark):
    long = "wörd </s> " * 200_000
    rows = [(1, 0, "user", long, "f", "w"), (1, 1, "assistant", long, "f", "w"), (2, None, None, None, "f", "w"),
            (None, 0, "assistant", "x", "f", "w"), (3, 0, "assistant", "same", "f", "w"), (3, 0, "assistant", "same", "f", "w")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i}é", "f", "w") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == want(rows)
    assert got(df.limit(0)) == {}


def test_only_conflicting_content_is_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain < [x] \\ text", "", ""), (1, 1, "assistant", C.CONFLICT, "", "")], SCHEMA)
    row = C.format_chats(df).first()
    assert row.formatted == ("<s>user[INST]plain < [x] \\ text[/INST]</s>"
                             "<s>assistant[INST]<\\/s>[\\INST] ok [\\/INST][/INST]</s>")
    assert [row.formatted.encode()[s.start:s.start + s.length] for s in row.loss_spans] == [b"<\\/s>[\\INST] ok [\\/INST]"]


@pytest.mark.parametrize("bad", ["x", "<s>a[INST]b[/INST]</s>x", "<s>a[INST]b", "a[INST]b[/INST]</s>", "<s>ab[/INST]</s>",
                                 "<s>a[INST]<s>b[/INST]</s>", "<s>a[INST]b[INST]c[/INST]</s>"])
def test_the_parser_refuses_what_is_not_of_the_grammar(spark, bad):
    assert spark.createDataFrame([(bad,)], "f string").select(C.parse(F.col("f"))).first()[0] is None


def test_query_matches_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", ["op12_grammar_round_trip"])["op12_grammar_round_trip"]["hash"]
