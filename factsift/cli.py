"""Command line: the three steps of an evaluation run.

    python -m factsift.cli run --preset fever_selfask --claims dev.jsonl --pages pages/ --out runs/selfask
    python -m factsift.cli combine --results runs/selfask/results --out runs/selfask/combined
    python -m factsift.cli evaluate --combined runs/selfask/combined --policy exclude_error

``run`` reads the claims in the preset's format (JSON lines with a page store,
or TSV), validates them, resolves evidence, scores every claim not yet stored
(resumable), writes the result batches and the report. ``combine`` unions
result batches (this package's table or a folder of ``*_result_<k>.csv``
files) into one CSV. ``evaluate`` prints the per-class report of a combined
table under a filtering policy. A scorer is given as ``module:factory``.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import functions as F

from factsift import constants as K
from factsift.operators import combine as C
from factsift.operators import metrics as M
from factsift.operators import validate as V
from factsift.operators.evidence import resolve_evidence
from factsift.operators.scoring import Calls, LexicalVerifier
from factsift.plans.presets import PRESETS, run_report, scored_run
from factsift.session import get_spark
from factsift.sources import claims as SC
from factsift.sources import results as R
from factsift.sources.batch_files import write_batch_files
from factsift.sources.pages import read_page_store


def _factory(spec: str | None, dataset: str):
    if not spec:
        return lambda: LexicalVerifier(dataset)
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _print_report(rep) -> None:
    for row in M.report_text(rep).toLocalIterator():  # a class per distinct label: never all at once
        print(row.line)


def cmd_run(args) -> None:
    spark = get_spark()
    preset = PRESETS[args.preset]
    if preset.source == "jsonl":
        if not args.pages:
            raise SystemExit("--pages is required for JSON-lines presets")
        raw = SC.read_claims_jsonl(spark, args.claims, limit=args.limit)  # F7
        clean, rejects = V.split_once(raw)
        pages = read_page_store(spark, args.pages, fmt=args.pages_format)
        # a line is its own row, whether its id is missing, repeated or neither
        claims = resolve_evidence(clean, pages, keep=["claim", "label"], key="seq").withColumnRenamed("seq", "claim_id")
    else:
        clean, rejects = V.validate(SC.read_claims_tsv(spark, args.claims, limit=args.limit), preset.labels, once=True)
        claims = clean.withColumnRenamed("seq", "claim_id")
    rejects.select("seq", "reject_reason").write.mode("overwrite").parquet(f"{args.out}/rejects")
    results, counters = scored_run(spark, claims, preset, f"{args.out}/results",
                                   _factory(args.scorer, preset.dataset), args.parallelism,
                                   Calls(retries=args.retries, per_second=args.calls_per_second))
    print(f"scored {counters.get('rows', 0)} rows this session, {counters.get('errors', 0)} errors")
    if args.batch_files:
        columns = [*K.RESULT_COLUMNS, *([K.RAW_OUTPUT_COLUMN] if preset.raw_output_column else [])]
        write_batch_files(results.select("batch_id", "seq", *columns), f"{args.out}/batches", args.batch_files)
    rep = run_report(results, preset)
    R.write_report(rep, M.report_text(rep), f"{args.out}/report")
    _print_report(rep)


def cmd_combine(args) -> None:
    """Folders in the order given, batches by number, rows in their order."""
    spark = get_spark()
    frames = []
    for k, folder in enumerate(args.results):
        df = R.read_result_folder(spark, folder, position=True).drop("file_name") if args.reference_layout else R.read_batches(spark, folder)
        frames.append(df.withColumn("_folder", F.lit(k)))
    together = C.combine(frames)
    ordered = C.batch_order(together, ["_folder", "batch_id"]).drop("_folder", *(["seq"] if args.reference_layout else []))
    R.write_combined(ordered, args.out)
    total = R.read_combined(spark, args.out).count()
    print(f"combined {total} records into {args.out}")


def cmd_evaluate(args) -> None:
    spark = get_spark()
    df = M.normalise_columns(R.read_combined(spark, args.combined))
    tp = M.normalise_labels(df, "true_label", "predicted_label")
    labels = args.labels.split(",") if args.labels else None
    _print_report(M.report(tp, args.policy, labels))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="factsift")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="score claims with a preset")
    r.add_argument("--preset", required=True, choices=sorted(PRESETS))
    r.add_argument("--claims", required=True)
    r.add_argument("--pages")
    r.add_argument("--pages-format", default="parquet")
    r.add_argument("--out", required=True)
    r.add_argument("--scorer", help="module:factory returning a (claim, evidence, prompt) -> str callable")
    r.add_argument("--parallelism", type=int, default=None, help="scorer calls in flight over all tasks")
    r.add_argument("--batch-files", metavar="NAME", help="also write <out>/batches/NAME_result_<k>.csv, a file per batch")
    r.add_argument("--retries", type=int, default=0, help="further attempts of a call that fails")
    r.add_argument("--calls-per-second", type=float, default=None, help="calls that one task starts in a second, at most")
    r.add_argument("--limit", type=int, default=None,
                   help="only the first N input rows, counted before any validation (F7)")
    r.set_defaults(fn=cmd_run)
    c = sub.add_parser("combine", help="union result batches into one CSV")
    c.add_argument("--results", required=True, nargs="+", help="one or more result folders, combined in this order")
    c.add_argument("--out", required=True)
    c.add_argument("--reference-layout", action="store_true", help="a folder of *_result_<k>.csv files")
    c.set_defaults(fn=cmd_combine)
    e = sub.add_parser("evaluate", help="per-class report of a combined table")
    e.add_argument("--combined", required=True)
    e.add_argument("--policy", default="all", choices=list(M.POLICIES))
    e.add_argument("--labels", help="comma-separated fixed label list (fixed / valid_only)")
    e.set_defaults(fn=cmd_evaluate)
    args = p.parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main(sys.argv[1:])
