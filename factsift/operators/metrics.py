"""Classification metrics over (truth, prediction) columns as DataFrame plans.

One pass over the rows: each row is exploded into a truth-side record
``(t: support=1, tp=[t=p])`` and a prediction-side record ``(p: predicted=1)``
and grouped by label. The aggregate is partial on the map side, so whatever
the row count only ``#partitions x #labels`` records cross the shuffle; no
row ever reaches the driver.

Report layout follows the usual per-class report: one row per label
(``kind='class'``), then ``accuracy`` (or ``micro avg`` when a fixed label list
does not cover every value seen), ``macro avg`` and ``weighted avg``.
Undefined ratios are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.operators.batches import number_keys
from factsift.session import checkpoint_root
from factsift.functions.text import format3

POLICIES = ("all", "fixed", "valid_only", "exclude_error")


def normalise_columns(df: DataFrame) -> DataFrame:
    """P5: column names lower-cased and stripped."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def normalise_labels(df: DataFrame, t: str, p: str) -> DataFrame:
    """Truth and prediction upper-cased, as strings, under ``t`` / ``p``."""
    return df.select(F.upper(F.col(t).cast("string")).alias("t"),
                     F.upper(F.col(p).cast("string")).alias("p"))


def exclude_error(df: DataFrame) -> DataFrame:
    """drop rows where truth or prediction is ERROR. An empty/NULL
    prediction is kept (as the empty label) rather than dropped."""
    p = F.coalesce(F.col("p"), F.lit(""))
    return (df.withColumn("p", p)
            .where((F.coalesce(F.col("t"), F.lit("")) != K.ERROR) & (F.col("p") != K.ERROR)))


def valid_only(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """keep rows whose prediction is one of ``labels``."""
    return df.where(F.col("p").isin(list(labels)))


def confusion(df: DataFrame) -> DataFrame:
    """A3: ``(t, p, n)`` confusion counts."""
    return df.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))


def _order_labels(labels: DataFrame) -> DataFrame:
    """Add ``ord`` = rank of ``label`` (distinct) in sorted order.

    Numbered in parallel whatever the size: the raw-text policy can make every
    distinct output a class.
    """
    return number_keys(labels, ["label"], name="ord").withColumn("ord", F.col("ord").cast("int"))


def label_domain(df: DataFrame) -> DataFrame:
    """A8 + U2 + O3: distinct union of truth and prediction, with sort order."""
    labels = df.select(F.col("t").alias("label")).union(df.select(F.col("p").alias("label"))).distinct()
    return _order_labels(labels)


def label_counts(df: DataFrame) -> DataFrame:
    """Per-label ``support``, ``predicted`` and ``tp`` in one aggregate."""
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.lit(1).alias("sup"), F.lit(0).alias("pr"),
                 (F.col("t") == F.col("p")).cast("int").alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).alias("sup"), F.lit(1).alias("pr"),
                 F.lit(0).alias("tp"))))
    return (df.select(sides.alias("s")).select("s.*")
            .groupBy("label")
            .agg(F.sum("sup").cast("long").alias("support"),
                 F.sum("pr").cast("long").alias("predicted"),
                 F.sum("tp").cast("long").alias("tp")))


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def labels_frame(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """A fixed, ordered label list as a tiny literal table (size = len(labels))."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], "label string, ord int")


def _class_table(df: DataFrame, labels: Sequence[str] | None) -> DataFrame:
    """Per-label counts with the report order ``ord``.

    Discovered labels (A8) are ordered by name; a fixed list (J5) keeps its
    order, is zero-filled for labels without rows, and keeps seen-but-unlisted
    labels with ``ord = NULL`` so the report can tell accuracy from micro avg.
    Both branches work on a table of one row per label, never on the rows.
    """
    counts = label_counts(df)
    if labels is None:
        t = _order_labels(counts)
    else:
        domain = F.broadcast(labels_frame(df.sparkSession, labels))
        t = domain.join(counts, "label", "full").na.fill(0, ["support", "predicted", "tp"])
        # One row per label: materialise it once so the per-class rows, the
        # summary rows and the total all read it instead of the whole input.
        checkpoint_root(df.sparkSession)
        t = t.checkpoint(eager=True)
    # Every row adds 1 to the support of its truth label, so this scalar
    # subquery over the per-label table is the row count (no window, no join,
    # and no second pass over the rows).
    total = t.select(F.coalesce(F.sum("support"), F.lit(0)).alias("n")).scalar()
    return t.withColumn("total_rows", total)


def _with_ratios(t: DataFrame) -> DataFrame:
    return t.select(
        "label", "ord", "support", "predicted", "tp", "total_rows",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def per_class(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """A4 (+ J5 zero fill): ``label, ord, precision, recall, f1, support, predicted, tp``."""
    t = _with_ratios(_class_table(df, labels))
    return (t.where(F.col("ord").isNotNull())
            .select("label", "ord", "precision", "recall", "f1", "support", "predicted", "tp"))


def apply_policy(df: DataFrame, policy: str, labels: Sequence[str] | None) -> tuple[DataFrame, Sequence[str] | None]:
    if policy == "all":
        return df, None
    if policy == "exclude_error":
        return exclude_error(df), None
    if labels is None:
        raise ValueError(f"policy {policy!r} needs a label list")
    if policy == "fixed":
        return df, labels
    if policy == "valid_only":
        return valid_only(df, labels), labels
    raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")


def report(df: DataFrame, policy: str = "all", labels: Sequence[str] | None = None) -> DataFrame:
    """Full report: per-class rows + accuracy/micro, macro and weighted rows.

    ``df`` has string columns ``t`` and ``p``. Output columns:
    ``label, kind, ord, precision, recall, f1, support``. An empty input gives
    an empty report.
    """
    df, fixed = apply_policy(df.select("t", "p"), policy, labels)
    t = _with_ratios(_class_table(df, fixed))
    listed = F.col("ord").isNotNull()
    classes = t.where(listed & (F.col("total_rows") > 0)).select(
        "label", F.lit(K.KIND_CLASS).alias("kind"), "ord", "precision", "recall", "f1", "support")

    def over_listed(c: Column) -> Column:
        return F.when(listed, c)

    # One aggregate over the per-label table (a handful of rows).
    g = t.agg(
        F.sum(over_listed(F.col("support"))).alias("sup"),
        F.sum(over_listed(F.col("predicted"))).alias("pr"),
        F.sum(over_listed(F.col("tp"))).alias("tp"),
        F.avg(over_listed(F.col("precision"))).alias("mp"),
        F.avg(over_listed(F.col("recall"))).alias("mr"),
        F.avg(over_listed(F.col("f1"))).alias("mf"),
        F.sum(over_listed(F.col("precision") * F.col("support"))).alias("wp"),
        F.sum(over_listed(F.col("recall") * F.col("support"))).alias("wr"),
        F.sum(over_listed(F.col("f1") * F.col("support"))).alias("wf"),
        F.count(over_listed(F.lit(1))).alias("n_labels"),
        F.max(F.col("ord").isNull()).alias("uncovered"),
        F.max("total_rows").alias("total_rows"))
    micro_p = _ratio(F.col("tp"), F.col("pr"))
    micro_r = _ratio(F.col("tp"), F.col("sup"))
    micro_f = _ratio(2 * micro_p * micro_r, micro_p + micro_r)
    # Every row's truth is a listed label here, so accuracy = sum(tp) / rows.
    acc = _ratio(F.col("tp"), F.col("total_rows"))
    first = F.when(F.col("uncovered"), F.struct(
        F.lit(K.KIND_MICRO).alias("kind"), micro_p.alias("precision"), micro_r.alias("recall"),
        micro_f.alias("f1"))).otherwise(F.struct(
            F.lit(K.KIND_ACCURACY).alias("kind"), F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"), acc.alias("f1")))
    n = F.col("n_labels")
    summary = g.where(F.col("total_rows") > 0).select(F.explode(F.array(
        F.struct(first["kind"].alias("kind"), n.alias("ord"), first["precision"].alias("precision"),
                 first["recall"].alias("recall"), first["f1"].alias("f1")),
        F.struct(F.lit(K.KIND_MACRO).alias("kind"), (n + 1).alias("ord"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1")),
        F.struct(F.lit(K.KIND_WEIGHTED).alias("kind"), (n + 2).alias("ord"),
                 _ratio(F.col("wp"), F.col("sup")).alias("precision"),
                 _ratio(F.col("wr"), F.col("sup")).alias("recall"),
                 _ratio(F.col("wf"), F.col("sup")).alias("f1")))).alias("r"),
        F.coalesce(F.col("sup"), F.lit(0)).cast("long").alias("support"))
    summary = summary.select(
        F.col("r.kind").alias("label"), F.col("r.kind").alias("kind"), F.col("r.ord").cast("int").alias("ord"),
        F.col("r.precision").alias("precision"), F.col("r.recall").alias("recall"),
        F.col("r.f1").alias("f1"), "support")
    return classes.unionByName(summary)


# ---- fixed values: per-class report text layout ----------------------------
REPORT_HEADERS = ["precision", "recall", "f1-score", "support"]
REPORT_COLUMN_WIDTH = 9
REPORT_MIN_LABEL_WIDTH = len("weighted avg")


def report_text(rep: DataFrame) -> DataFrame:
    """The report as text lines ``(ord, line)`` in the usual layout.

    Labels are right-aligned to the longest label (at least the width of
    ``weighted avg``); every column is one space plus a right-aligned field of
    9; a header line and blank lines frame the per-class block; the accuracy
    row leaves precision and recall blank. Values use ``format3``.
    The width is a scalar subquery over the report table (one row per label).
    """
    w = REPORT_COLUMN_WIDTH
    width = F.greatest(rep.select(F.max(F.length("label"))).scalar(), F.lit(REPORT_MIN_LABEL_WIDTH))

    def cell(c: Column) -> Column:
        # padded to the width, never cut: a longer value keeps all its digits
        value = F.coalesce(c, F.lit(""))
        return F.concat(F.lit(" "), F.lpad(value, F.greatest(F.length(value), F.lit(w)), " "))

    body = F.concat(F.lpad(F.col("label"), width, " "), F.lit(" "),
                    cell(format3(F.col("precision"))), cell(format3(F.col("recall"))),
                    cell(format3(F.col("f1"))), cell(F.col("support").cast("string")))
    is_class = F.col("kind") == K.KIND_CLASS
    rows = rep.select(F.when(is_class, F.col("ord")).otherwise(F.col("ord") + 1).cast("double").alias("ord"),
                      body.alias("line"))
    header = F.concat(F.lpad(F.lit(""), width, " "), F.lit(" "),
                      *[F.lit(" " + h.rjust(w)) for h in REPORT_HEADERS])
    # header, blank line, class rows, blank line, summary rows
    frame = rep.where(is_class).agg(F.max("ord").alias("last")).select(
        F.explode(F.array(
            F.struct(F.lit(-2.0).alias("ord"), header.alias("line")),
            F.struct(F.lit(-1.0).alias("ord"), F.lit("").alias("line")),
            F.struct((F.col("last") + 1).cast("double").alias("ord"), F.lit("").alias("line")))).alias("x"))
    return rows.unionByName(frame.select("x.ord", "x.line")).orderBy("ord")
