"""Prompt rendering (X4) from a template table.

A template is ``(dataset, strategy, head, mid, tail)`` and renders as
``head || claim || mid || evidence || tail``. Plain ``concat`` does no
substitution inside the claim or evidence, so a claim containing ``{evidence}``
or ``%s`` is copied verbatim, and nothing is escaped or truncated.

The wording below is this project's own; templates are user data and any
table with the same five columns can replace it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEVER_ANSWER = "Answer with exactly one of: SUPPORTS, REFUTES, NOT ENOUGH INFO."
_PUBHEALTH_ANSWER = "Answer with exactly one of: TRUE, FALSE, MIXTURE, UNPROVEN."

DEFAULT_TEMPLATES = [
    ("fever", "eep",
     "Check the claim using only the evidence.\nClaim: ", "\nEvidence: ", "\n" + _FEVER_ANSWER),
    ("fever", "cot",
     "Reason step by step about whether the evidence backs the claim.\nClaim: ", "\nEvidence: ",
     "\nWrite your reasoning, then finish with 'Answer: <label>'. " + _FEVER_ANSWER),
    ("fever", "selfask",
     "Break the claim into follow-up questions and answer each from the evidence.\nClaim: ",
     "\nEvidence: ", "\nEnd with the final label. " + _FEVER_ANSWER),
    ("pubhealth", "eep",
     "Judge the health claim using only the article.\nClaim: ", "\nArticle: ", "\n" + _PUBHEALTH_ANSWER),
    ("pubhealth", "cot",
     "Reason step by step about the health claim and the article.\nClaim: ", "\nArticle: ",
     "\nFinish with the label. " + _PUBHEALTH_ANSWER),
    ("pubhealth", "selfask",
     "Ask and answer follow-up questions about the health claim.\nClaim: ", "\nArticle: ",
     "\nFinish with the label. " + _PUBHEALTH_ANSWER),
]

TEMPLATE_BYTES = 1 << 20  # template text that a plan carries as a literal
TEMPLATE_SCHEMA = "dataset string, strategy string, head string, mid string, tail string"


def templates_frame(spark: SparkSession, rows=None) -> DataFrame:
    """The template table; from Arrow, so its size is known to the planner."""
    names = [c.split()[0] for c in TEMPLATE_SCHEMA.split(", ")]
    columns = list(zip(*(rows or DEFAULT_TEMPLATES)))
    return spark.createDataFrame(pa.table([pa.array(c, type=pa.string()) for c in columns], names=names))


def render_column(head, claim, mid, evidence, tail):
    """X4 as a column expression (NULL parts render as empty text)."""
    return F.concat(F.coalesce(head, F.lit("")), F.coalesce(claim, F.lit("")),
                    F.coalesce(mid, F.lit("")), F.coalesce(evidence, F.lit("")),
                    F.coalesce(tail, F.lit("")))


def _template_blocks(templates: DataFrame):
    """The templates as lists of at most TEMPLATE_BYTES of text (one template at least)."""
    held, size = [], 0
    for row in templates.select("strategy", "head", "mid", "tail").toLocalIterator():
        own = sum(len(x.encode()) for x in row if x is not None)
        if held and size + own > TEMPLATE_BYTES:
            yield held
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield held


def render(claims: DataFrame, templates: DataFrame, dataset: str,
           strategies: list[str] | None = None) -> DataFrame:
    """J6 + X4: one prompt per (claim, strategy) of ``dataset``.

    The asked templates are a literal array that each claim explodes on its own
    row: no join and no shuffle. A set of templates larger than TEMPLATE_BYTES
    is taken in blocks of that size, each a pass over the claims.
    """
    t = templates.where(F.col("dataset") == dataset)
    if strategies:
        t = t.where(F.col("strategy").isin(strategies))
    out = None
    for block in _template_blocks(t):
        literal = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for c, x in row.asDict().items()]) for row in block])
        filled = claims.select(*claims.columns, F.lit(dataset).alias("dataset"), F.explode(literal).alias("_t"))
        prompt = render_column(F.col("_t.head"), F.col("claim"), F.col("_t.mid"), F.col("evidence"), F.col("_t.tail"))
        part = filled.select(*claims.columns, "dataset", F.col("_t.strategy").alias("strategy"), prompt.alias("prompt"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no templates for dataset {dataset!r} and strategies {strategies}")
    return out
