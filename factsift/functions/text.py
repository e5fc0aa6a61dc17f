"""Column expressions for page blobs, placeholders and output clean-up.

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factsift import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tolerant_int(c: Column | str) -> Column:
    """Integer parse that yields NULL instead of failing (ANSI-safe).

    64-bit, since the indexes being matched are unbounded integers upstream."""
    return _col(c).try_cast("bigint")


def page_line_parts(line: Column | str) -> tuple[Column, Column]:
    """Split one page line once on its first tab -> (index text, sentence).

    ``split(l, '\\t', 2)`` keeps later tabs (links) inside the sentence and
    gives an empty sentence for ``'5\\t'``.
    """
    parts = F.split(_col(line), "\t", 2)
    return F.get(parts, 0), F.get(parts, 1)


def page_not_found(title: Column | str) -> Column:
    """Placeholder for a missing page; a NULL title prints as ``None``."""
    return F.concat(F.lit(K.PAGE_NOT_FOUND_PREFIX),
                    F.coalesce(_col(title), F.lit(K.NULL_TITLE_TEXT)),
                    F.lit(K.PLACEHOLDER_SUFFIX))


def sentence_not_found(idx: Column | str, title: Column | str) -> Column:
    """Placeholder for a page that has no line with the wanted index."""
    return F.concat(F.lit(K.SENTENCE_NOT_FOUND_PREFIX), _col(idx).cast("string"),
                    F.lit(K.SENTENCE_NOT_FOUND_MIDDLE),
                    F.coalesce(_col(title), F.lit(K.NULL_TITLE_TEXT)),
                    F.lit(K.PLACEHOLDER_SUFFIX))


# Python's str.strip() removes every Unicode whitespace character; Spark's
# trim() removes spaces only, so a Unicode-aware regex is used instead.
_STRIP_PATTERN = r"(?U)^\s+|\s+$"


def py_strip(c: Column | str) -> Column:
    """X5 helper: strip leading/trailing Unicode whitespace like ``str.strip``."""
    return F.regexp_replace(_col(c), _STRIP_PATTERN, "")


def normalise_output(c: Column | str) -> Column:
    """Strip, then upper-case (the raw-text label policy).

    Upstream lower-cases before upper-casing. Catalyst rewrites
    ``upper(lower(x))`` to ``upper(x)``, and the two differ only for the few
    characters whose lower-case form upper-cases to something else (dotted
    capital I, the Kelvin sign); for those the raw-text class differs."""
    return F.upper(py_strip(c))


@F.pandas_udf(StringType())
def _format3(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.3f}")


def format3(c: Column | str) -> Column:
    """Three-digit rendering exactly as Python's ``'%.3f'``.

    Python rounds the exact binary value (``0.0625 -> 0.062`` on an exact tie,
    ``0.0005 -> 0.001`` because that double lies just above the tie); Spark's
    ``format_number`` and ``format_string`` round a decimal rendering and get
    one of the two wrong. This is applied to report tables only (one row per
    label), so a small Arrow-batched pandas UDF does it.
    """
    from pyspark.sql import SparkSession

    from factsift.session import ship_package
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
    return _format3(_col(c))
