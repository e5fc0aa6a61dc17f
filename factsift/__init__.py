"""factsift: claim-verification analytics expressed as Spark DataFrame plans.

Sub-packages:

* ``sources``   - claim, page-store and result-folder readers plus the sinks.
* ``functions`` - column-expression helpers (text parsing, label extraction, prompts).
* ``operators`` - DataFrame -> DataFrame building blocks (evidence, sampling, metrics...).
* ``plans``     - end-to-end presets and the query catalog used by ``__spark_entry__``.
* ``streaming`` - resumable scoring as a Structured Streaming query.
"""

from factsift.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
