"""Registered queries over the driver tables and their DuckDB oracle twins.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a DataFrame
computed from whole tables, read through the real sources from the inputs
``plans.staging`` writes once per application (claims JSONL, page store,
claims TSV). ``ORACLE`` holds an independent DuckDB formulation of the same
result over the base tables. Computed columns carry the same aliases and
types on both sides; doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.functions import labels as L
from factsift.functions.prompts import DEFAULT_TEMPLATES, render, templates_frame
from factsift.functions.text import format3
from factsift.operators import batches as B
from factsift.operators import combine as C
from factsift.operators import evidence as ev
from factsift.operators import metrics as M
from factsift.operators import sampling as S
from factsift.operators import scoring as D
from factsift.operators import validate as V
from factsift.plans import fixtures as fx
from factsift.plans import presets as P
from factsift.plans import staging as st
from factsift.session import shared_dir
from factsift.sources import claims as SC
from factsift.sources import files
from factsift.sources import results as R
from factsift.sources.batch_files import write_batch_files

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# --------------------------------------------------------------------------
# Shared oracle CTEs (DuckDB dialect), an independent formulation of the
# fixture mapping: sentences are read straight from the document's lines
# instead of going through an indexed page store.
# --------------------------------------------------------------------------
SQL_CLAIMS = """
claims AS (
  SELECT l.doc_id AS claim_id, d.text AS claim,
         CASE WHEN l.toxic = 1 THEN 'REFUTES' WHEN l.quality = 1 THEN 'SUPPORTS'
              ELSE 'NOT ENOUGH INFO' END AS label,
         d.lang, d.source, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

SQL_EVIDENCE = SQL_CLAIMS + """,
doc_lines AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10)) AS ls FROM documents),
with_groups AS (SELECT * FROM claims WHERE lang <> 'de' AND label <> 'NOT ENOUGH INFO'),
refs AS (
  SELECT claim_id, 0 AS pos, 'doc_' || CAST(claim_id AS VARCHAR) AS title, 0 AS idx FROM with_groups
  UNION ALL
  SELECT claim_id, 1, CASE WHEN source = 'src0' THEN NULL
                           ELSE 'doc_' || CAST(claim_id + n_chars AS VARCHAR) END, 1 FROM with_groups
  UNION ALL
  SELECT claim_id, 2, 'doc_' || CAST(claim_id AS VARCHAR), CAST(n_chars % 13 AS INTEGER)
  FROM with_groups WHERE lang <> 'es'),
resolved AS (
  SELECT r.claim_id, r.pos,
         CASE WHEN p.id IS NULL THEN '[Page not found: ' || coalesce(r.title, 'None') || ']'
              WHEN r.idx >= len(p.ls) THEN '[Sentence index ' || CAST(r.idx AS VARCHAR) || ' not found in ' || r.title || ']'
              ELSE p.ls[r.idx + 1] END AS sentence,
         CASE WHEN p.id IS NULL THEN 2 WHEN r.idx >= len(p.ls) THEN 1 ELSE 0 END AS miss
  FROM refs r LEFT JOIN doc_lines p ON r.title = p.id),
per_claim AS (
  SELECT claim_id, string_agg(sentence, ' ' ORDER BY pos) AS evidence_text, max(miss) AS worst
  FROM resolved GROUP BY claim_id),
evidence AS (
  SELECT c.claim_id, c.claim, c.label, c.lang, c.source,
         CASE WHEN c.lang = 'de' THEN '[No evidence provided]' ELSE coalesce(e.evidence_text, '') END AS evidence,
         CASE WHEN c.lang = 'de' THEN 'no_evidence' WHEN e.claim_id IS NULL THEN 'no_usable_refs'
              WHEN e.worst = 2 THEN 'page_miss' WHEN e.worst = 1 THEN 'sentence_miss'
              ELSE 'resolved' END AS resolution
  FROM claims c LEFT JOIN per_claim e ON c.claim_id = e.claim_id)"""



def _q(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def _in_list(labels) -> str:
    return "(" + ", ".join(_q(x) for x in labels) + ")"


def sql_verifier(claim: str, evidence: str, dataset: str = "fever", strategy: str = "eep") -> str:
    """``LexicalVerifier`` as a DuckDB expression for the raw output (NULL = raised)."""
    v = D.VOCABULARIES[dataset]
    return f"""CASE WHEN strpos(coalesce({evidence}, ''), {_q(v.refused)}) > 0 THEN NULL
      WHEN {evidence} = {_q(K.NO_EVIDENCE)} THEN {_q('Answer: ' + v.unknown.lower())}
      WHEN coalesce({evidence}, '') = '' THEN 'I cannot tell.'
      WHEN strpos({evidence}, {_q(K.PAGE_NOT_FOUND_PREFIX)}) > 0 THEN {_q(v.unknown + ' - a cited page is missing')}
      WHEN strpos({evidence}, {_q(K.SENTENCE_NOT_FOUND_PREFIX)}) > 0 THEN {_q(' ' + v.refute.lower() + ' ')}
      WHEN strpos(lower({evidence}), lower(split_part(coalesce({claim}, ''), ' ', {D.LOOKED_UP[strategy]}))) > 0
        THEN {_q('Step 1: the evidence repeats the claim. So the final answer is: ' + v.support)}
      ELSE {_q('UN' + v.support)} END"""


def sql_label(raw: str, policy: str, domain=K.FEVER_LABELS) -> str:
    """Label extraction policies as DuckDB expressions (NULL raw = ERROR)."""
    alt = "|".join(domain)
    if policy == "raw":
        body = f"upper(regexp_replace({raw}, '^\\s+|\\s+$', '', 'g'))"
    elif policy == "lenient":
        m = f"upper(regexp_extract({raw}, '(?i){K.LENIENT_PATTERN.format(labels=alt)}', 2))"
        body = f"CASE WHEN {m} = '' THEN {_q(K.UNKNOWN)} ELSE {m} END"
    else:
        m = f"regexp_extract(upper({raw}), '{K.STRICT_PATTERN.format(labels=alt)}', 1)"
        body = f"CASE WHEN {m} = '' THEN {_q(K.NO_LABEL)} ELSE {m} END"
    return f"CASE WHEN {raw} IS NULL THEN {_q(K.ERROR)} ELSE {body} END"


SQL_OUTPUTS = SQL_EVIDENCE + f""",
outputs AS (
  SELECT *, {sql_verifier('claim', 'evidence')} AS raw FROM evidence),
preds AS (
  SELECT claim_id, label AS t, {sql_label('raw', 'raw')} AS p_raw,
         {sql_label('raw', 'lenient')} AS p_lenient, {sql_label('raw', 'strict')} AS p_strict
  FROM outputs)"""


def sql_report(tp_sql: str, policy: str, labels=None, value=lambda c: f"round({c}, 6)") -> str:
    """Per-class report in DuckDB over a CTE ``tp(t, p)`` defined by ``tp_sql``.

    ``value`` renders each metric (rounded to 6 digits by default)."""
    if policy == "exclude_error":
        filt = "SELECT t, coalesce(p, '') AS p FROM tp0 WHERE coalesce(t, '') <> 'ERROR' AND coalesce(p, '') <> 'ERROR'"
    elif policy == "valid_only":
        filt = f"SELECT t, p FROM tp0 WHERE p IN {_in_list(labels)}"
    else:
        filt = "SELECT t, p FROM tp0"
    if labels is None:
        dom = "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS ord FROM counts"
    else:
        dom = "SELECT * FROM (VALUES " + ", ".join(f"({_q(x)}, {i})" for i, x in enumerate(labels)) + ") v(label, ord)"
    r = value
    return f"""{tp_sql},
tp AS ({filt}),
counts AS (
  SELECT label, CAST(sum(sup) AS BIGINT) AS support, CAST(sum(pr) AS BIGINT) AS predicted, CAST(sum(hit) AS BIGINT) AS tp
  FROM (SELECT t AS label, 1 AS sup, 0 AS pr, CASE WHEN t = p THEN 1 ELSE 0 END AS hit FROM tp
        UNION ALL SELECT p, 0, 1, 0 FROM tp) z GROUP BY label),
dom AS ({dom}),
cls AS (
  SELECT d.label, d.ord, coalesce(c.support, 0) AS support, coalesce(c.predicted, 0) AS predicted, coalesce(c.tp, 0) AS tp
  FROM dom d LEFT JOIN counts c ON d.label = c.label),
m AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall,
         CASE WHEN predicted + support = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(predicted + support AS DOUBLE) END AS f1
  FROM cls),
tot AS (
  SELECT sum(support) AS sup, sum(predicted) AS pr, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr,
         avg(f1) AS mf, sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf,
         CAST(count(*) AS INTEGER) AS n,
         (SELECT count(*) FROM tp) AS n_rows,
         (SELECT count(*) FROM counts WHERE label NOT IN (SELECT label FROM dom)) > 0 AS uncovered
  FROM m),
mic AS (
  SELECT *, CASE WHEN pr = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pr END AS up,
         CASE WHEN sup = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / sup END AS ur FROM tot)
SELECT label, 'class' AS kind, ord, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1,
       CAST(support AS BIGINT) AS support
FROM m WHERE (SELECT n_rows FROM tot) > 0
UNION ALL
SELECT CASE WHEN uncovered THEN 'micro avg' ELSE 'accuracy' END, CASE WHEN uncovered THEN 'micro avg' ELSE 'accuracy' END,
       n, CASE WHEN uncovered THEN {r('up')} END, CASE WHEN uncovered THEN {r('ur')} END,
       CASE WHEN uncovered THEN {r('CASE WHEN up + ur = 0 THEN 0.0 ELSE 2 * up * ur / (up + ur) END')}
            ELSE {r('CAST(tp AS DOUBLE) / n_rows')} END,
       CAST(coalesce(sup, 0) AS BIGINT)
FROM mic WHERE n_rows > 0
UNION ALL
SELECT 'macro avg', 'macro avg', n + 1, {r('mp')}, {r('mr')}, {r('mf')}, CAST(coalesce(sup, 0) AS BIGINT) FROM tot WHERE n_rows > 0
UNION ALL
SELECT 'weighted avg', 'weighted avg', n + 2,
       {r('CASE WHEN sup = 0 THEN 0.0 ELSE wp / sup END')}, {r('CASE WHEN sup = 0 THEN 0.0 ELSE wr / sup END')},
       {r('CASE WHEN sup = 0 THEN 0.0 ELSE wf / sup END')}, CAST(coalesce(sup, 0) AS BIGINT)
FROM tot WHERE n_rows > 0"""


def rounded(rep: DataFrame) -> DataFrame:
    return rep.select("label", "kind", "ord", *[F.round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


# --------------------------------------------------------------------------
# Spark-side building blocks shared by the queries
# --------------------------------------------------------------------------

def evidence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = st.load_claims(spark, sf_dir)
    pages = st.load_pages(spark, sf_dir)
    return ev.resolve_evidence(claims, pages, keep=["claim", "label"])


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence-resolved claims with stored verifier outputs and all three
    label policies: ``claim_id, t, p_raw, p_lenient, p_strict``."""
    e = evidence_claims(spark, sf_dir)
    raw, error = D.lexical_verifier_column(F.col("claim"), F.col("evidence"))
    o = e.select("claim_id", "label", raw.alias("raw"), error.alias("error"))
    return o.select("claim_id", F.col("label").alias("t"),
                    *[L.extract_label("raw", "error", pol).alias(f"p_{pol}") for pol in L.POLICIES])


def tp_frame(preds: DataFrame, policy: str) -> DataFrame:
    return preds.select("t", F.col(f"p_{policy}").alias("p"))


# --------------------------------------------------------------------------
# Q1: evidence resolution and its parts
# --------------------------------------------------------------------------

@register("q1_evidence_resolved_claims", "WITH " + SQL_EVIDENCE + """
SELECT claim_id, claim, label, evidence, resolution FROM evidence""")
def q1(spark, sf_dir):
    return evidence_claims(spark, sf_dir)


@register("q1b_resolution_summary", "WITH " + SQL_EVIDENCE + """
SELECT resolution, CAST(count(*) AS BIGINT) AS n_claims FROM evidence GROUP BY resolution""")
def q1b(spark, sf_dir):
    return (evidence_claims(spark, sf_dir).groupBy("resolution")
            .agg(F.count(F.lit(1)).alias("n_claims")))


@register("p3_f1_evidence_refs", "WITH " + SQL_EVIDENCE + """
SELECT claim_id, CAST(pos AS INTEGER) AS pos, title, CAST(idx AS BIGINT) AS idx FROM refs""")
def p3_refs(spark, sf_dir):
    """P2 + P3 + F1: usable references of the first group, order kept."""
    return ev.evidence_refs(st.load_claims(spark, sf_dir))


@register("x1_x2_page_sentences", """
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_sentences,
       CAST(sum(length(l)) AS BIGINT) AS sentence_chars
FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l FROM documents)
GROUP BY doc_id, text""")
def x1_page_sentences(spark, sf_dir):
    """S3 + X1 + X2 + J2 over the whole page store: sentences per page."""
    s = ev.page_sentences(st.load_pages(spark, sf_dir))
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n_sentences"),
                               F.sum(F.length("sentence")).cast("long").alias("sentence_chars"))


# --------------------------------------------------------------------------
# File sources round-tripped through Spark-written files
# --------------------------------------------------------------------------

def _jsonl_claims_for_file(spark, sf_dir):
    """Claims as they would arrive in a JSONL file: some labels lower-case,
    some omitted (P1 must restore both)."""
    c = fx.claims(spark, sf_dir)
    label = (F.when((F.col("label") == K.DEFAULT_JSONL_LABEL) & (F.col("lang") == "es"), F.lit(None).cast("string"))
             .when(F.col("source") == "src1", F.lower("label")).otherwise(F.col("label")))
    return c.select("claim_id", "claim", label.alias("label"), "evidence")


@register("s1_claims_jsonl_scan", "WITH " + SQL_CLAIMS + """
SELECT CAST(row_number() OVER (ORDER BY claim_id) - 1 AS BIGINT) AS seq, claim_id, claim, label,
       CAST(CASE WHEN lang = 'de' THEN 0 WHEN label = 'NOT ENOUGH INFO' THEN 1 ELSE 2 END AS INTEGER) AS n_groups,
       CAST(CASE WHEN lang = 'de' OR label = 'NOT ENOUGH INFO' THEN 0 WHEN lang = 'es' THEN 2 ELSE 3 END AS INTEGER) AS n_usable_refs
FROM claims""")
def s1_jsonl(spark, sf_dir):
    """S1 + P1 + F1: write claims as JSON lines, read them back with the reader."""
    path = shared_dir(spark, "claims-jsonl")
    SC.write_claims_jsonl(_jsonl_claims_for_file(spark, sf_dir), path)
    df = SC.read_claims_jsonl(spark, path)
    clean, _ = SC.split_rejects(df)
    first = F.get(F.col("evidence"), 0)
    return clean.select("seq", "claim_id", "claim", "label",
                        F.coalesce(F.size("evidence"), F.lit(0)).alias("n_groups"),
                        F.coalesce(F.size(F.filter(first, ev.usable_ref)), F.lit(0)).alias("n_usable_refs"))


_KINDS = ("0", '"0"', "0.0", "true")


@register("f1_typed_references", """
SELECT doc_id AS claim_id, CAST(n_chars % 4 AS INTEGER) AS kind, 'doc_' || doc_id AS title,
       CAST(0 AS BIGINT) AS idx
FROM documents WHERE n_chars % 4 = 0""")
def f1_typed(spark, sf_dir):
    """F1, strict: every document cites itself by an index that is a JSON integer, a
    quoted one, a float or a boolean in turn; only the integer counts."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 4).cast("int").alias("kind"))
    index = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.col("kind") + 1)
    line = F.format_string('{"id": %d, "claim": "%d", "evidence": [[[0, 0, "doc_%d", %s]]]}', "doc_id", "kind", "doc_id", index)
    path = shared_dir(spark, "claims-kinds")
    docs.select(line.alias("value")).write.text(path)
    claims, _ = SC.split_rejects(SC.read_claims_jsonl(spark, path))
    refs = ev.evidence_refs(claims).join(claims.select("claim_id", F.col("claim").cast("int").alias("kind")), "claim_id")
    return refs.select("claim_id", "kind", "title", "idx")


SQL_TSV = """
tsv AS (
  SELECT d.doc_id, split_part(d.text, chr(10), 1) AS claim,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS main_text,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.lang = 'es' THEN 'snopes'
              WHEN l.quality = 1 AND l.toxic = 0 THEN 'true' WHEN l.quality = 0 AND l.toxic = 1 THEN 'FALSE'
              WHEN l.quality = 1 AND l.toxic = 1 THEN 'mixture' ELSE 'unproven' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
tsv_seq AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS seq, * FROM tsv),
validated AS (
  SELECT *, CASE WHEN coalesce(claim, '') = '' OR coalesce(main_text, '') = '' OR coalesce(label, '') = '' THEN 'missing fields'
                 WHEN upper(label) NOT IN ('TRUE', 'FALSE', 'UNPROVEN', 'MIXTURE') THEN 'invalid label: ' || upper(label)
            END AS reject_reason
  FROM tsv_seq),
clean AS (SELECT seq, claim, main_text AS evidence, upper(label) AS label FROM validated WHERE reject_reason IS NULL)"""


def tsv_loaded(spark, sf_dir):
    return st.load_tsv(spark, sf_dir)


@register("q2_validated_claims", "WITH " + SQL_TSV + """
SELECT seq, claim, evidence, label FROM clean""")
def q2(spark, sf_dir):
    """Q2 = S2 + P1 + F2 + F3: TSV written by Spark, read back, validated."""
    clean, _ = V.validate(tsv_loaded(spark, sf_dir))
    return clean


@register("q2b_reject_log", "WITH " + SQL_TSV + """
SELECT seq, reject_reason FROM validated WHERE reject_reason IS NOT NULL""")
def q2b(spark, sf_dir):
    """reject log, missing-field test before the label test."""
    _, rejects = V.validate(tsv_loaded(spark, sf_dir))
    return rejects


@register("f4_one_pass_split", "WITH " + SQL_TSV + """
SELECT seq, label, CAST(NULL AS VARCHAR) AS reject_reason FROM clean
UNION ALL SELECT seq, CAST(NULL AS VARCHAR) AS label, reject_reason FROM validated WHERE reject_reason IS NOT NULL""")
def f4_split(spark, sf_dir):
    """both sides of one written split, each read from its own folder."""
    clean, rejects = V.validate(tsv_loaded(spark, sf_dir), once=True)
    return (clean.select("seq", "label", F.lit(None).cast("string").alias("reject_reason"))
            .unionByName(rejects.select("seq", F.lit(None).cast("string").alias("label"), "reject_reason")))


@register("q2c_reject_counts", "WITH " + SQL_TSV + """
SELECT CASE WHEN reject_reason LIKE 'invalid label%' THEN 'invalid label' ELSE reject_reason END AS reason,
       CAST(count(*) AS BIGINT) AS n_rows
FROM validated WHERE reject_reason IS NOT NULL GROUP BY 1""")
def q2c(spark, sf_dir):
    _, rejects = V.validate(tsv_loaded(spark, sf_dir))
    return V.reject_counts(rejects)


# --------------------------------------------------------------------------
# Q3: sampling
# --------------------------------------------------------------------------

def _sql_sample(n: int, cols: str) -> str:
    return "WITH " + SQL_EVIDENCE + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(claim_id AS VARCHAR)), claim_id) AS rn
  FROM evidence)
SELECT {cols} FROM ranked WHERE rn <= {n}"""


@register("q3_balanced_evaluation_set", _sql_sample(
    666, "claim_id, claim, label, evidence, md5('42#' || CAST(claim_id AS VARCHAR)) AS shuffle_key"))
def q3(spark, sf_dir):
    """Q3 = W1 (cap 666, seed 42) + O1. Sampling needs only the label, so the
    claim keys are drawn first and evidence is resolved for the sample only."""
    claims = st.load_claims(spark, sf_dir)
    sample = S.stratified(claims, 666, seed=42, mode="cap")
    resolved = ev.resolve_evidence(sample, st.load_pages(spark, sf_dir), keep=["claim", "label"])
    return resolved.select("claim_id", "claim", "label", "evidence",
                           S.shuffle_key(42, "claim_id").alias("shuffle_key"))


@register("w1_stratified_sample_cap40", """WITH """ + SQL_CLAIMS + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(claim_id AS VARCHAR)), claim_id) AS rn
  FROM claims)
SELECT claim_id, label FROM ranked WHERE rn <= 40""")
def w1(spark, sf_dir):
    return S.stratified(st.load_claims(spark, sf_dir), 40, seed=42, mode="cap").select("claim_id", "label")


@register("a2_class_sizes", "WITH " + SQL_CLAIMS + """
SELECT label, CAST(count(*) AS BIGINT) AS n_rows FROM claims GROUP BY label""")
def a2(spark, sf_dir):
    return S.class_sizes(st.load_claims(spark, sf_dir))


@register("a10_class_guard_666", "WITH " + SQL_CLAIMS + """,
req AS (SELECT * FROM (VALUES ('SUPPORTS', 0), ('REFUTES', 1), ('NOT ENOUGH INFO', 2)) v(label, ord)),
sizes AS (SELECT label, count(*) AS n FROM claims GROUP BY label)
SELECT r.label, CAST(r.ord AS INTEGER) AS ord, CAST(coalesce(s.n, 0) AS BIGINT) AS n_rows, coalesce(s.n, 0) >= 666 AS enough
FROM req r LEFT JOIN sizes s ON r.label = s.label""")
def a10(spark, sf_dir):
    """A10: the strict preset's class-size guard, as a table (the run raises)."""
    return S.class_guard(st.load_claims(spark, sf_dir), K.FEVER_LABELS, 666)


@register("o1_seeded_shuffle_order", "WITH " + SQL_CLAIMS + """
SELECT claim_id, CAST(row_number() OVER (ORDER BY md5('42#' || CAST(claim_id AS VARCHAR)), claim_id) - 1 AS BIGINT) AS shuffle_pos
FROM claims""")
def o1(spark, sf_dir):
    """O1 + W2 numbering: dense position of each claim in the seeded shuffle."""
    c = st.load_claims(spark, sf_dir).select("claim_id").withColumn("_k", S.shuffle_key(42, "claim_id"))
    return B.assign_sequence(c, ["_k", "claim_id"], name="shuffle_pos")


# --------------------------------------------------------------------------
# Batches and resume
# --------------------------------------------------------------------------

@register("w2_batch_assignment", "WITH " + SQL_CLAIMS + """,
s AS (SELECT claim_id, CAST(row_number() OVER (ORDER BY claim_id) - 1 AS BIGINT) AS seq FROM claims)
SELECT claim_id, seq, CAST(seq // 300 AS BIGINT) AS batch_id FROM s""")
def w2(spark, sf_dir):
    c = st.load_claims(spark, sf_dir).select("claim_id")
    return B.assign_batches(B.assign_sequence(c, ["claim_id"]), 300).select("claim_id", "seq", "batch_id")


@register("j4_resume_pending", "WITH " + SQL_EVIDENCE + """
SELECT claim_id, label FROM evidence WHERE resolution <> 'resolved'""")
def j4(spark, sf_dir):
    """A previous session scored and stored the fully resolved claims; the
    rest is pending against that stored table."""
    e = evidence_claims(spark, sf_dir)
    out = shared_dir(spark, "run-partial")
    stored, _ = P.scored_run(spark, e.where(F.col("resolution") == K.RES_RESOLVED), P.PRESETS["fever_eep_full"], out)
    return B.pending(e, stored).select("claim_id", "label")


# --------------------------------------------------------------------------
# Prompts, scoring, label extraction
# --------------------------------------------------------------------------

SQL_TEMPLATES = "(VALUES " + ", ".join(
    "(" + ", ".join(_q(x) for x in row) + ")" for row in DEFAULT_TEMPLATES) + ") tpl(dataset, strategy, head, mid, tail)"


@register("x4_rendered_prompts", "WITH " + SQL_EVIDENCE + f"""
SELECT e.claim_id, tpl.strategy, tpl.head || coalesce(e.claim, '') || tpl.mid || coalesce(e.evidence, '') || tpl.tail AS prompt
FROM evidence e JOIN {SQL_TEMPLATES} ON tpl.dataset = 'fever'""")
def x4(spark, sf_dir):
    """J6 + X4: every claim rendered for each of the dataset's strategies."""
    p = render(evidence_claims(spark, sf_dir), templates_frame(spark), "fever")
    return p.select("claim_id", "strategy", "prompt")


@register("d1_scorer_map_in_pandas", "WITH " + SQL_EVIDENCE + f"""
SELECT claim_id, {sql_verifier('claim', 'evidence')} AS raw,
       CASE WHEN strpos(evidence, {_q(D.VOCABULARIES['fever'].refused)}) > 0 THEN {_q('ValueError: ' + D.VOCABULARIES['fever'].refusal)} END AS error
FROM evidence""")
def d1(spark, sf_dir):
    """D1 + X8: the pluggable scorer in mapInPandas, failures isolated per row."""
    p = render(evidence_claims(spark, sf_dir), templates_frame(spark), "fever", ["eep"])
    return D.score(p, D.LexicalVerifier, keep=["claim_id"])


@register("x5_x8_label_policies", "WITH " + SQL_OUTPUTS + """
SELECT claim_id, t, p_raw, p_lenient, p_strict FROM preds""")
def x5_x8(spark, sf_dir):
    """X5 raw / X6 lenient / X7 strict extraction with the X8 ERROR sentinel."""
    return stored_predictions(spark, sf_dir)


# --------------------------------------------------------------------------
# Q4: scored runs (write once, read back)
# --------------------------------------------------------------------------

@register("q4_scored_run_fever_eep", "WITH " + SQL_EVIDENCE + f""",
s AS (SELECT *, CAST(row_number() OVER (ORDER BY claim_id) - 1 AS BIGINT) AS seq,
             {sql_verifier('claim', 'evidence')} AS raw FROM evidence)
SELECT 'eep' AS strategy, claim_id, seq, CAST(seq // 300 AS BIGINT) AS batch_id, claim AS Claim, evidence AS Evidence,
       label AS True_Label, {sql_label('raw', 'raw')} AS Predicted_Label
FROM s""")
def q4_fever(spark, sf_dir):
    """Q4, preset fever_eep_full: W2, J4, X4, D1, X5, X8, P4, K1, A11."""
    out = shared_dir(spark, "run-fever-eep")
    res, _ = P.scored_run(spark, evidence_claims(spark, sf_dir), P.PRESETS["fever_eep_full"], out)
    return res.select("strategy", "claim_id", "seq", "batch_id", *K.RESULT_COLUMNS)


@register("q4b_scored_run_pubhealth_eep", "WITH " + SQL_TSV + f""",
c AS (SELECT seq AS claim_id, claim, evidence, label,
             CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS wseq FROM clean),
s AS (SELECT *, {sql_verifier('claim', 'evidence', 'pubhealth')} AS raw FROM c)
SELECT 'eep' AS strategy, claim_id, wseq AS seq, CAST(wseq // 100 AS BIGINT) AS batch_id, claim AS Claim,
       evidence AS Evidence, label AS True_Label, {sql_label('raw', 'raw', K.PUBHEALTH_LABELS)} AS Predicted_Label
FROM s""")
def q4_pubhealth(spark, sf_dir):
    """Q4, preset pubhealth_eep: validated TSV claims, raw-text labels."""
    clean, _ = V.validate(tsv_loaded(spark, sf_dir))
    claims = clean.withColumnRenamed("seq", "claim_id")
    out = shared_dir(spark, "run-pubhealth-eep")
    res, _ = P.scored_run(spark, claims, P.PRESETS["pubhealth_eep"], out)
    return res.select("strategy", "claim_id", "seq", "batch_id", *K.RESULT_COLUMNS)


# The other five presets: a scored run each, its order and batches as the preset
# asks. Sampled runs are numbered in the seeded shuffle's order.

def _sql_run(cte: str, preset: P.Preset, dataset: str, key: str = "claim_id", per_class: str | None = None) -> str:
    domain = K.FEVER_LABELS if dataset == "fever" else K.PUBHEALTH_LABELS
    order = f"md5('{preset.seed}#' || CAST({key} AS VARCHAR)), {key}" if preset.sampling else key
    cap = (f"WHERE rn <= {per_class or preset.per_class}" if preset.per_class else "")
    raw_col = (f", coalesce(lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')), "
               f"{_q('ValueError: ' + D.VOCABULARIES[dataset].refusal)}) AS Raw_Output") if preset.raw_output_column else ""
    return cte + f""",
drawn AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{preset.seed}:' || CAST({key} AS VARCHAR)), {key}) AS rn FROM run_in) {cap}),
s AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS wseq, {sql_verifier('claim', 'evidence', dataset, preset.strategy)} AS raw FROM drawn)
SELECT '{preset.strategy}' AS strategy, claim_id, wseq AS seq, CAST(wseq // {preset.batch_size} AS BIGINT) AS batch_id, claim AS Claim,
       evidence AS Evidence, label AS True_Label, {sql_label('raw', preset.label_policy, domain)} AS Predicted_Label{raw_col}
FROM s"""


def _register_run(name: str, preset: P.Preset, per_class: str | None = None) -> None:
    fever = preset.dataset == "fever"
    cte = ("WITH " + SQL_EVIDENCE + ", run_in AS (SELECT claim_id, claim, evidence, label FROM evidence)" if fever else
           "WITH " + SQL_TSV + ", run_in AS (SELECT seq AS claim_id, claim, evidence, label FROM clean)")

    @register(name, _sql_run(cte, preset, preset.dataset, per_class=per_class))
    def run(spark, sf_dir, preset=preset):
        if fever:
            claims = evidence_claims(spark, sf_dir)
        else:
            clean, _ = V.validate(tsv_loaded(spark, sf_dir))
            claims = clean.withColumnRenamed("seq", "claim_id")
        if per_class:
            least = S.class_sizes(claims).agg(F.min("n_rows")).first()[0]
            preset = dataclasses.replace(preset, per_class=min(preset.per_class, least))
        res, _ = P.scored_run(spark, claims, preset, shared_dir(spark, f"run-{name}"))
        extra = [K.RAW_OUTPUT_COLUMN] if preset.raw_output_column else []
        return res.select("strategy", "claim_id", "seq", "batch_id", *K.RESULT_COLUMNS, *extra)


_register_run("q4c_scored_run_fever_eep_sampled", P.PRESETS["fever_eep_sampled"])
# the preset draws 666 rows of each class and raises below that; a table whose least
# class is smaller gives as many of each as that class has
_register_run("q4d_scored_run_fever_cot_strict", P.PRESETS["fever_cot"],
              per_class=f"(SELECT least({P.PRESETS['fever_cot'].per_class}, min(n)) FROM (SELECT count(*) AS n FROM run_in GROUP BY label))")
_register_run("q4e_scored_run_fever_selfask", P.PRESETS["fever_selfask"])
_register_run("q4f_scored_run_pubhealth_cot", P.PRESETS["pubhealth_cot"])
_register_run("q4g_scored_run_pubhealth_selfask", P.PRESETS["pubhealth_selfask"])


@register("f7_raw_row_limit", "WITH " + SQL_TSV + """
SELECT seq, claim, evidence, label FROM clean WHERE seq < 100""")
def f7(spark, sf_dir):
    """only the first 100 raw rows are looked at, counted before validation."""
    clean, _ = V.validate(st.load_tsv(spark, sf_dir, limit=100))
    return clean


@register("s1b_lines_with_repeated_ids", "WITH " + SQL_EVIDENCE + """
SELECT claim_id % 7 AS id, claim, label, evidence, resolution FROM evidence""")
def s1b(spark, sf_dir):
    """Q1 over claims whose ids repeat: a row is known by the hash of its content."""
    c = st.load_claims(spark, sf_dir).select((F.col("claim_id") % 7).alias("id"), "claim", "label", "evidence")
    keyed = c.withColumn(ev.ROW_HASH, ev.row_hash(c))
    return ev.resolve_evidence(keyed, st.load_pages(spark, sf_dir), keep=["id", "claim", "label"], key=ev.ROW_HASH).drop(ev.ROW_HASH)


@register("s3b_store_with_repeated_ids", "WITH " + SQL_EVIDENCE + """
SELECT claim_id, claim, label, evidence, resolution FROM evidence""")
def s3b(spark, sf_dir):
    """Q1 over a store that holds every page twice: one row of a page counts."""
    pages = st.load_pages(spark, sf_dir)
    return ev.resolve_evidence(st.load_claims(spark, sf_dir), pages.unionByName(pages), keep=["claim", "label"])


# --------------------------------------------------------------------------
# Q5: combine result batches (CSV export -> scan -> union by name)
# --------------------------------------------------------------------------

# The CoT preset draws exactly 666 rows per class and aborts below that (A10);
# the driver tables never hold 666 REFUTES rows, so the combine test scores
# the CoT configuration over the full claim set instead.
COT_FULL = dataclasses.replace(P.PRESETS["fever_cot"], name="fever_cot_full", sampling=None, per_class=None)


def combined_results(spark, sf_dir) -> DataFrame:
    claims = evidence_claims(spark, sf_dir)
    frames = []
    for preset in (P.PRESETS["fever_eep_full"], COT_FULL):
        run_dir = shared_dir(spark, f"run-{preset.name}")
        res, _ = P.scored_run(spark, claims, preset, run_dir)
        csv_dir = shared_dir(spark, f"csv-{preset.name}")
        R.write_batches(res.drop("strategy").withColumn("Strategy", F.lit(preset.strategy)), csv_dir, fmt="csv")
        frames.append(R.read_batches(spark, csv_dir, fmt="csv"))
    return C.combine(frames)


SQL_COMBINED = SQL_OUTPUTS + """,
s AS (SELECT *, CAST(row_number() OVER (ORDER BY claim_id) - 1 AS BIGINT) AS seq, """ + sql_verifier('claim', 'evidence', 'fever', 'cot') + """ AS raw_cot
      FROM outputs),
combined AS (
  SELECT 'eep' AS Strategy, CAST(claim_id AS VARCHAR) AS claim_id, CAST(seq AS VARCHAR) AS seq, CAST(seq // 300 AS BIGINT) AS batch_id,
         claim AS Claim, evidence AS Evidence, label AS True_Label, """ + sql_label('raw', 'raw') + """ AS Predicted_Label,
         CAST(NULL AS VARCHAR) AS Raw_Output
  FROM s
  UNION ALL
  SELECT 'cot', CAST(claim_id AS VARCHAR), CAST(seq AS VARCHAR), CAST(seq // 500 AS BIGINT), claim, evidence, label,
         """ + sql_label('raw_cot', 'lenient') + """, coalesce(lower(regexp_replace(raw_cot, '^\\s+|\\s+$', '', 'g')), """ + _q('ValueError: ' + D.VOCABULARIES['fever'].refusal) + """)
  FROM s)"""


@register("q5_combined_results", "WITH " + SQL_COMBINED + """
SELECT Strategy, claim_id, seq, batch_id, Claim, Evidence, True_Label, Predicted_Label, Raw_Output FROM combined""")
def q5(spark, sf_dir):
    """Q5 = K1 (CSV) + S4 + U1 + O2: 4- and 5-column batches unioned by name."""
    df = combined_results(spark, sf_dir)
    return C.batch_order(df.select("Strategy", "claim_id", "seq", F.col("batch_id").cast("long").alias("batch_id"),
                                   *K.RESULT_COLUMNS, K.RAW_OUTPUT_COLUMN), seq=None)


@register("a9_combined_total_rows", "WITH " + SQL_COMBINED + """
SELECT CAST(count(*) AS BIGINT) AS total_rows FROM combined""")
def a9(spark, sf_dir):
    return C.total_rows(combined_results(spark, sf_dir))


@register("s4_result_folder", "WITH " + SQL_COMBINED + """
SELECT Claim, Evidence, True_Label, Predicted_Label, Raw_Output, batch_id,
       'fever_' || Strategy || '_result_' || batch_id || '.csv' AS file_name
FROM combined""")
def s4_folder(spark, sf_dir):
    """K1 + S4 + U1: one CSV file a batch, of 4 columns for one strategy and of 70 for
    the other, next to a combined file that isn't one; read back by header."""
    claims, folder = evidence_claims(spark, sf_dir), shared_dir(spark, "result-folder")
    for preset in (P.PRESETS["fever_eep_full"], COT_FULL):
        res, _ = P.scored_run(spark, claims, preset, shared_dir(spark, f"run-{preset.name}"))
        columns = [*K.RESULT_COLUMNS, *([K.RAW_OUTPUT_COLUMN] if preset.raw_output_column else [])]
        wide = [F.lit(None).cast("string").alias(f"note_{i}") for i in range(70 - len(columns))] if preset.raw_output_column else []
        write_batch_files(res.select("batch_id", "seq", *wide, *columns), folder, f"fever_{preset.strategy}")
    files.write_whole(f"{files.qualified(spark, folder)}/fever_dev_combined.csv", lambda f: f.write(b"Claim,Evidence\r\nnot,read\r\n"))
    return R.read_result_folder(spark, folder)


@register("o2_batch_order", "WITH " + SQL_COMBINED + """
SELECT Strategy, claim_id, batch_id,
       CAST(row_number() OVER (ORDER BY batch_id, Strategy, CAST(claim_id AS BIGINT)) - 1 AS BIGINT) AS position
FROM combined""")
def o2(spark, sf_dir):
    """O2: the place of every combined row in numeric batch order, as a column."""
    df = combined_results(spark, sf_dir).select("Strategy", "claim_id", "batch_id")
    keyed = df.withColumn("_row", F.struct("Strategy", F.col("claim_id").cast("long")))
    return C.batch_position(keyed, seq="_row")


# --------------------------------------------------------------------------
# Q6-Q9: reports under the four policies; A3, A8, K3/X9
# --------------------------------------------------------------------------

@register("q6_report_all", sql_report("WITH " + SQL_OUTPUTS + ", tp0 AS (SELECT t, p_raw AS p FROM preds)", "all") + "")
def q6(spark, sf_dir):
    """Q6: raw-text predictions, labels discovered from truth and prediction."""
    return rounded(M.report(tp_frame(stored_predictions(spark, sf_dir), "raw"), "all"))


@register("q7_report_fixed", sql_report("WITH " + SQL_OUTPUTS + ", tp0 AS (SELECT t, p_lenient AS p FROM preds)",
                                        "fixed", K.FEVER_LABELS))
def q7(spark, sf_dir):
    """Q7: lenient predictions, fixed label list, ERROR/UNKNOWN rows kept."""
    return rounded(M.report(tp_frame(stored_predictions(spark, sf_dir), "lenient"), "fixed", K.FEVER_LABELS))


@register("q8_report_valid_only", sql_report("WITH " + SQL_OUTPUTS + ", tp0 AS (SELECT t, p_strict AS p FROM preds)",
                                             "valid_only", K.FEVER_LABELS))
def q8(spark, sf_dir):
    """Q8: strict predictions; rows without a valid prediction leave both sides."""
    return rounded(M.report(tp_frame(stored_predictions(spark, sf_dir), "strict"), "valid_only", K.FEVER_LABELS))


@register("q9_report_exclude_error", sql_report(
    "WITH " + SQL_COMBINED + ", tp0 AS (SELECT upper(True_Label) AS t, upper(Predicted_Label) AS p FROM combined)",
    "exclude_error"))
def q9(spark, sf_dir):
    """Q9 = K2 + S5 + P5 + P6 + F5: the combined table is written as CSV,
    read back with all-string columns, normalised and filtered."""
    path = shared_dir(spark, "combined")
    R.write_combined(combined_results(spark, sf_dir), path)
    df = M.normalise_columns(R.read_combined(spark, path))
    return rounded(M.report(M.normalise_labels(df, "true_label", "predicted_label"), "exclude_error"))


@register("a11_run_counters", "WITH " + SQL_OUTPUTS + """
SELECT CAST(count(*) AS BIGINT) AS rows_done,
       CAST(count(*) FILTER (WHERE p_raw = 'ERROR') AS BIGINT) AS error_rows
FROM preds""")
def a11(spark, sf_dir):
    """The counters observed on the write of a scored run."""
    out = shared_dir(spark, "run-counters")
    _, seen = P.scored_run(spark, evidence_claims(spark, sf_dir), P.PRESETS["fever_eep_full"], out)
    return spark.range(1).select(F.lit(seen["rows"]).cast("long").alias("rows_done"),
                                 F.lit(seen["errors"]).cast("long").alias("error_rows"))


@register("a3_confusion_counts", "WITH " + SQL_OUTPUTS + """
SELECT t, p_lenient AS p, CAST(count(*) AS BIGINT) AS n FROM preds GROUP BY 1, 2""")
def a3(spark, sf_dir):
    return M.confusion(tp_frame(stored_predictions(spark, sf_dir), "lenient"))


@register("a8_label_domain", "WITH " + SQL_OUTPUTS + """,
u AS (SELECT t AS label FROM preds UNION SELECT p_raw FROM preds)
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS ord FROM u""")
def a8(spark, sf_dir):
    """A8 + U2 + O3: sorted distinct union of truth and prediction."""
    return M.label_domain(tp_frame(stored_predictions(spark, sf_dir), "raw")).select(
        "label", F.col("ord").cast("int").alias("ord"))


@register("k3_report_text", "SELECT ord, label, precision, recall, f1, support FROM (" + sql_report(
    "WITH " + SQL_OUTPUTS + ", tp0 AS (SELECT t, p_raw AS p FROM preds)", "all",
    value=lambda c: f"printf('%.3f', {c})") + ")")
def k3(spark, sf_dir):
    """K3 + X9: the report rendered with three digits, written as text."""
    rep = M.report(tp_frame(stored_predictions(spark, sf_dir), "raw"), "all")
    lines = M.report_text(rep)
    out = shared_dir(spark, "report")
    R.write_report(rep, lines, out)
    return spark.read.parquet(f"{out}/metrics").select(
        "ord", "label", *[format3(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def _sql_report_lines(report_sql: str) -> str:
    f3 = lambda c: f"lpad(coalesce(printf('%.3f', {c}), ''), CAST(greatest(9, length(coalesce(printf('%.3f', {c}), ''))) AS INTEGER), ' ')"
    header = "".join(" " + h.rjust(M.REPORT_COLUMN_WIDTH) for h in M.REPORT_HEADERS)
    return f"""WITH rep AS (SELECT * FROM ({report_sql})),
w AS (SELECT CAST(greatest(max(length(label)), {M.REPORT_MIN_LABEL_WIDTH}) AS INTEGER) AS width FROM rep)
SELECT CAST(CASE WHEN kind = 'class' THEN ord ELSE ord + 1 END AS DOUBLE) AS ord,
       lpad(label, width, ' ') || ' ' || ' ' || {f3('precision')} || ' ' || {f3('recall')} || ' ' || {f3('f1')}
         || ' ' || lpad(CAST(support AS VARCHAR), CAST(greatest(9, length(CAST(support AS VARCHAR))) AS INTEGER), ' ') AS line
FROM rep, w
UNION ALL SELECT -2.0, lpad('', width, ' ') || ' ' || {_q(header)} FROM w
UNION ALL SELECT -1.0, ''
UNION ALL SELECT CAST(max(ord) + 1 AS DOUBLE), '' FROM rep WHERE kind = 'class'"""


@register("k3b_report_text_lines", _sql_report_lines(sql_report(
    "WITH " + SQL_OUTPUTS + ", tp0 AS (SELECT t, p_raw AS p FROM preds)", "all", value=lambda c: c)))
def k3b(spark, sf_dir):
    """K3 + X9: the report as text lines in the usual per-class layout."""
    return M.report_text(M.report(tp_frame(stored_predictions(spark, sf_dir), "raw"), "all"))


# --------------------------------------------------------------------------
# Strategy comparison
# --------------------------------------------------------------------------

SQL_PUBHEALTH_PREDS = SQL_TSV + f""",
ph_out AS (SELECT seq AS claim_id, label, {sql_verifier('claim', 'evidence', 'pubhealth')} AS raw FROM clean),
ph AS (SELECT claim_id, label AS t, {sql_label('raw', 'raw', K.PUBHEALTH_LABELS)} AS p FROM ph_out)"""


def pubhealth_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated TSV claims with stored verifier outputs, raw-text labels: ``t, p_raw``."""
    clean, _ = V.validate(tsv_loaded(spark, sf_dir))
    raw, error = D.lexical_verifier_column(F.col("claim"), F.col("evidence"), "pubhealth")
    return clean.select(F.col("label").alias("t"),
                        L.extract_label(raw, error, "raw", K.PUBHEALTH_LABELS).alias("p_raw"))


@register("q6b_report_pubhealth", sql_report("WITH " + SQL_PUBHEALTH_PREDS + ", tp0 AS (SELECT t, p FROM ph)", "all"))
def q6b(spark, sf_dir):
    """Q6 for the TSV family (pubhealth presets): raw-text labels, labels discovered."""
    return rounded(M.report(tp_frame(pubhealth_predictions(spark, sf_dir), "raw"), "all"))


# The extraction policy each strategy's preset uses, per dataset.
STRATEGY_POLICY = {
    "fever": {"eep": "raw", "cot": "lenient", "selfask": "strict"},
    "pubhealth": {"eep": "raw", "cot": "raw", "selfask": "raw"},
}
DOMAINS = {"fever": K.FEVER_LABELS, "pubhealth": K.PUBHEALTH_LABELS}
STRATEGIES = ["eep", "cot", "selfask"]


def _sql_strategy_long() -> str:
    """``dataset, strategy, t, p``: every strategy's own output under its own policy."""
    parts = []
    for dataset, source in (("fever", "evidence"), ("pubhealth", "clean")):
        for strategy, policy in STRATEGY_POLICY[dataset].items():
            raw = sql_verifier("claim", "evidence", dataset, strategy)
            parts.append(f"SELECT '{dataset}' AS dataset, '{strategy}' AS strategy, label AS t, "
                         f"{sql_label('raw', policy, DOMAINS[dataset])} AS p FROM (SELECT *, {raw} AS raw FROM {source})")
    return " UNION ALL ".join(parts)


def stored_strategy_outputs(claims: DataFrame, dataset: str) -> DataFrame:
    """Every strategy's outputs over the same claims, stored and read back:
    ``dataset, strategy, t, p``."""
    spark = claims.sparkSession
    scored = []
    for strategy, policy in STRATEGY_POLICY[dataset].items():
        raw, error = D.lexical_verifier_column(F.col("claim"), F.col("evidence"), dataset, strategy)
        scored.append(F.struct(F.lit(strategy).alias("strategy"), F.col("label").alias("t"),
                               L.extract_label(raw, error, policy, DOMAINS[dataset]).alias("p")))
    path = shared_dir(spark, f"strategy-outputs-{dataset}")
    claims.select(F.lit(dataset).alias("dataset"), F.inline(F.array(*scored))).write.parquet(path)
    return spark.read.parquet(path)


@register("q10_strategy_comparison", "WITH " + SQL_EVIDENCE + ", " + SQL_TSV.strip() + """,
long AS (""" + _sql_strategy_long() + """),
counts AS (
  SELECT dataset, strategy, label, sum(sup) AS support, sum(pr) AS predicted, sum(hit) AS tp
  FROM (SELECT dataset, strategy, t AS label, 1 AS sup, 0 AS pr, CASE WHEN t = p THEN 1 ELSE 0 END AS hit FROM long
        UNION ALL SELECT dataset, strategy, p, 0, 1, 0 FROM long) z GROUP BY dataset, strategy, label),
f AS (SELECT dataset, strategy, label, CASE WHEN predicted + support = 0 THEN 0.0
                                   ELSE CAST(2 * tp AS DOUBLE) / CAST(predicted + support AS DOUBLE) END AS f1 FROM counts
      UNION ALL
      SELECT dataset, strategy, 'accuracy', CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) FROM counts
      GROUP BY dataset, strategy)
SELECT dataset, label,
       round(max(CASE WHEN strategy = 'eep' THEN f1 END), 6) AS eep,
       round(max(CASE WHEN strategy = 'cot' THEN f1 END), 6) AS cot,
       round(max(CASE WHEN strategy = 'selfask' THEN f1 END), 6) AS selfask
FROM f GROUP BY dataset, label""")
def q10(spark, sf_dir):
    """Q10 = A12: per-label F1 and accuracy of the three strategies side by side,
    per dataset, from each strategy's own stored outputs. Rows are counted by
    (dataset, strategy, truth, prediction) first (A3, partial aggregation);
    everything after works on that small table."""
    clean, _ = V.validate(tsv_loaded(spark, sf_dir))
    long = stored_strategy_outputs(evidence_claims(spark, sf_dir), "fever").unionByName(
        stored_strategy_outputs(clean, "pubhealth"))
    pairs = long.groupBy("dataset", "strategy", "t", "p").agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("pr"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("pr"), F.lit(0).cast("long").alias("tp"))))
    counts = (pairs.select("dataset", "strategy", sides.alias("s")).select("dataset", "strategy", "s.*")
              .groupBy("dataset", "strategy", "label")
              .agg(F.sum("sup").alias("sup"), F.sum("pr").alias("pr"), F.sum("tp").alias("tp")))
    f1 = counts.select("dataset", "strategy", "label",
                       F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), (F.col("pr") + F.col("sup")).cast("double")),
                                  F.lit(0.0)).alias("f1"))
    # accuracy per (dataset, strategy) as one more row: every row adds 1 to
    # the support of its truth label, so sum(tp) / sum(support) over labels
    accuracy = counts.groupBy("dataset", "strategy").agg(
        F.lit(K.KIND_ACCURACY).alias("label"),
        (F.sum("tp").cast("double") / F.sum("sup").cast("double")).alias("f1"))
    wide = C.compare_strategies(f1.unionByName(accuracy), "f1", STRATEGIES)
    return wide.select("dataset", "label", *[F.round(F.col(s), 6).alias(s) for s in STRATEGIES])


@register("d1b_stored_outputs_join", "WITH " + SQL_EVIDENCE + f"""
SELECT claim_id, {sql_verifier('claim', 'evidence')} AS raw,
       CASE WHEN strpos(evidence, {_q(D.VOCABULARIES['fever'].refused)}) > 0 THEN {_q('ValueError: ' + D.VOCABULARIES['fever'].refusal)} END AS error
FROM evidence""")
def d1b(spark, sf_dir):
    """D1, stored-output form: outputs written earlier as a table keyed by
    ``(claim_id, strategy)`` are joined back instead of calling the scorer."""
    e = evidence_claims(spark, sf_dir).withColumn("strategy", F.lit("eep"))
    raw, error = D.lexical_verifier_column(F.col("claim"), F.col("evidence"))
    path = shared_dir(spark, "stored-outputs")
    e.select("claim_id", "strategy", raw.alias("raw"), error.alias("error")).write.parquet(path)
    return D.score_stored(e, spark.read.parquet(path)).select("claim_id", "raw", "error")


# --------------------------------------------------------------------------
# Resumable scoring as a stream (run twice; the second run adds nothing)
# --------------------------------------------------------------------------

@register("t1_stream_resumable_scoring", "WITH " + SQL_OUTPUTS + f"""
SELECT 'eep' AS strategy, claim_id, claim AS Claim, evidence AS Evidence, label AS True_Label,
       {sql_label('raw', 'raw')} AS Predicted_Label
FROM outputs""")
def t1(spark, sf_dir):
    """JSONL claim files -> readStream -> foreachBatch(resolve, score,
    anti-join, append) with availableNow; a rerun over the same files appends
    no rows."""
    from factsift.streaming.resumable import stream_score
    base = shared_dir(spark, "stream")
    source = st.claims_jsonl_path(spark, sf_dir)
    pages = st.load_pages(spark, sf_dir)
    for _ in range(2):
        stream_score(spark, source, pages, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("strategy", "claim_id", *K.RESULT_COLUMNS)


# --------------------------------------------------------------------------
# S3 at scale: the page store written once bucketed by id
# --------------------------------------------------------------------------

@register("s3_bucketed_page_store_resolution", "WITH " + SQL_EVIDENCE + """
SELECT claim_id, claim, label, evidence, resolution FROM evidence""")
def s3_bucketed(spark, sf_dir):
    """Q1 over a page store bucketed by ``id``: joins on ``id`` read the store
    already partitioned, so only the cited titles are shuffled."""
    from factsift.sources.pages import read_page_store, write_page_store
    path = shared_dir(spark, "pages-bucketed")
    table = "factsift_pages_" + path.rsplit("-", 1)[-1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_page_store(st.load_pages(spark, sf_dir), path, table=table, buckets=n)
    pages = read_page_store(spark, table, table=True)
    return ev.resolve_evidence(st.load_claims(spark, sf_dir), pages, keep=["claim", "label"])
