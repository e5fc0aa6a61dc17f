"""Label extraction from free-text scorer outputs.

Three policies, all plain regex column expressions:

* ``raw``     - strip + upper the whole output; any extra wording is its own class.
* ``lenient`` - first case-insensitive occurrence of a label anywhere in the text,
                no word boundary (``UNSUPPORTS`` -> ``SUPPORTS``), else ``UNKNOWN``.
* ``strict``  - upper-case first, then the first word-bounded label, else ``NO_LABEL``.

A non-NULL ``error`` column always wins and yields ``ERROR`` (X8).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.functions.text import normalise_output

POLICIES = ("raw", "lenient", "strict")


def _alternation(domain: Sequence[str]) -> str:
    return "|".join(re.escape(label) for label in domain)


def lenient_pattern(domain: Sequence[str]) -> str:
    # (?iu): Unicode-aware case folding, matching Python's re.IGNORECASE on str.
    return "(?iu)" + K.LENIENT_PATTERN.format(labels=_alternation(domain))


def strict_pattern(domain: Sequence[str]) -> str:
    return K.STRICT_PATTERN.format(labels=_alternation(domain))


def extract_lenient(raw: Column, domain: Sequence[str] = K.FEVER_LABELS,
                    miss: str = K.UNKNOWN) -> Column:
    """X6."""
    m = F.upper(F.regexp_extract(raw, lenient_pattern(domain), 2))
    return F.when(m == "", F.lit(miss)).otherwise(m)


def extract_strict(raw: Column, domain: Sequence[str] = K.FEVER_LABELS,
                   miss: str = K.NO_LABEL) -> Column:
    """X7."""
    m = F.regexp_extract(F.upper(raw), strict_pattern(domain), 1)
    return F.when(m == "", F.lit(miss)).otherwise(m)


def extract_label(raw: Column | str, error: Column | str | None = None,
                  policy: str = "strict",
                  domain: Sequence[str] = K.FEVER_LABELS) -> Column:
    """Prediction column for ``policy``; ``ERROR`` whenever ``error`` is set."""
    raw_c = F.col(raw) if isinstance(raw, str) else raw
    if policy == "raw":
        label = normalise_output(raw_c)
    elif policy == "lenient":
        label = extract_lenient(raw_c, domain)
    elif policy == "strict":
        label = extract_strict(raw_c, domain)
    else:
        raise ValueError(f"unknown label policy {policy!r}; expected one of {POLICIES}")
    failed = raw_c.isNull()
    if error is not None:
        err_c = F.col(error) if isinstance(error, str) else error
        failed = err_c.isNotNull() | failed
    return F.when(failed, F.lit(K.ERROR)).otherwise(label)
