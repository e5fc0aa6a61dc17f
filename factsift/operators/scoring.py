"""Pluggable claim scoring (D1) with per-row failure isolation.

``score`` runs a user scorer inside ``mapInArrow``: Spark hands each task
Arrow batches of the claim rows, of which ``SLICE_ROWS`` at a time become Python
strings (kept columns never do); the scorer is built once per task and called once per row (the unit a remote verifier charges for), and any
exception becomes ``(raw=NULL, error=<message>)`` for that row only, so one
bad row never fails the task. ``Calls`` sets how many calls a task has in
flight, how failures are retried and how fast calls start.

``store_scored`` is the form that runs use: each batch is stored as soon as its
last call ends, so that no call is repeated for a finished batch.

``score_stored`` is the same contract over a table of previously stored
outputs ``(claim_id, strategy, raw, error)``: a plain left join.

The bundled ``LexicalVerifier`` is a deterministic stand-in for a remote
model so runs, tests and benchmarks need no network.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation
from pyspark.sql.types import StringType, StructField, StructType

from factsift import constants as K
from factsift.session import ship_package
from factsift.sources import files

# Scorer contract: (claim, evidence, prompt) -> raw output text; may raise.
Scorer = Callable[[str, str, str], str]
ScorerFactory = Callable[[], Scorer]


class Vocabulary:
    """The label words a verifier answers with, and a text it refuses, per dataset."""

    def __init__(self, support: str, refute: str, unknown: str, refused: str):
        self.support, self.refute, self.unknown, self.refused = support, refute, unknown, refused

    @property
    def refusal(self) -> str:
        return f"refused evidence with {self.refused}"


VOCABULARIES = {
    "fever": Vocabulary("SUPPORTS", "REFUTES", "NOT ENOUGH INFO", K.SENTENCE_NOT_FOUND_PREFIX + "12 "),
    "pubhealth": Vocabulary("TRUE", "FALSE", "UNPROVEN", "@mail"),
}


# Which word of the claim the verifier looks up in the evidence, by the strategy
# its prompt asks for.
LOOKED_UP = {"eep": 1, "cot": 2, "selfask": 3}
PROMPT_MARKS = {"step by step": "cot", "follow-up questions": "selfask"}


def asked_strategy(prompt: str | None) -> str:
    """The strategy a prompt's opening asks for."""
    opening = (prompt or "").split("\n", 1)[0]
    return next((s for mark, s in PROMPT_MARKS.items() if mark in opening), "eep")


class LexicalVerifier:
    """Deterministic toy verifier with the output variety of a real model.

    Raises (-> ``ERROR``) on evidence that holds a text it refuses; otherwise
    answers in several textual styles so every extraction policy is exercised:
    an ``Answer:`` prefix, lower case, padding whitespace, a label inside a
    sentence, and a label glued into a longer word.
    """

    def __init__(self, dataset: str = "fever"):
        self.v = VOCABULARIES[dataset]

    def __call__(self, claim: str, evidence: str, prompt: str | None = None) -> str:
        v = self.v
        claim = claim or ""
        evidence = evidence or ""
        if v.refused in evidence:
            raise ValueError(v.refusal)
        if evidence == K.NO_EVIDENCE:
            return f"Answer: {v.unknown.lower()}"
        if evidence == "":
            return "I cannot tell."
        if K.PAGE_NOT_FOUND_PREFIX in evidence:
            return f"{v.unknown} - a cited page is missing"
        if K.SENTENCE_NOT_FOUND_PREFIX in evidence:
            return f" {v.refute.lower()} "
        words, k = claim.split(" "), LOOKED_UP[asked_strategy(prompt)]
        head = words[k - 1].lower() if len(words) >= k else ""
        if head in evidence.lower():
            return f"Step 1: the evidence repeats the claim. So the final answer is: {v.support}"
        return f"UN{v.support}"


def lexical_verifier_column(claim: Column, evidence: Column,
                            dataset: str = "fever", strategy: str = "eep") -> tuple[Column, Column]:
    """The same rule as ``LexicalVerifier`` as column expressions -> (raw, error).

    Used to materialise a stored-outputs table without Python workers.
    """
    v = VOCABULARIES[dataset]
    head = F.lower(F.split_part(F.coalesce(claim, F.lit("")), F.lit(" "), F.lit(LOOKED_UP[strategy])))
    ev = F.coalesce(evidence, F.lit(""))
    refused = F.instr(ev, v.refused) > 0
    raw = (F.when(refused, F.lit(None).cast("string"))
           .when(ev == K.NO_EVIDENCE, F.lit(f"Answer: {v.unknown.lower()}"))
           .when(ev == "", F.lit("I cannot tell."))
           .when(F.instr(ev, K.PAGE_NOT_FOUND_PREFIX) > 0, F.lit(f"{v.unknown} - a cited page is missing"))
           .when(F.instr(ev, K.SENTENCE_NOT_FOUND_PREFIX) > 0, F.lit(f" {v.refute.lower()} "))
           .when(F.instr(F.lower(ev), head) > 0,
                 F.lit(f"Step 1: the evidence repeats the claim. So the final answer is: {v.support}"))
           .otherwise(F.lit(f"UN{v.support}")))
    error = F.when(refused, F.lit(f"ValueError: {v.refusal}"))
    return raw, error


@dataclass(frozen=True)
class Calls:
    """How a task calls its scorer.

    ``concurrency`` calls are in flight in a task at a time (threads: a remote
    scorer waits for its answer); a call that raises one of ``transient`` is
    repeated up to ``retries`` times, after ``backoff`` seconds that double each
    time; ``per_second`` bounds the calls that a task starts in a second.
    """

    concurrency: int = 1
    retries: int = 0
    backoff: float = 0.5
    per_second: float | None = None
    transient: tuple[type[BaseException], ...] = (Exception,)


class Caller:
    """A scorer with the window, retries and rate limit of ``Calls`` around it."""

    def __init__(self, factory: ScorerFactory, calls: Calls):
        self.scorer, self.calls = factory(), calls  # built once per task
        self.pool = ThreadPoolExecutor(calls.concurrency) if calls.concurrency > 1 else None
        self.lock, self.next_start = threading.Lock(), 0.0

    def _wait_turn(self) -> None:
        if self.calls.per_second:
            with self.lock:
                start = max(self.next_start, time.monotonic())
                self.next_start = start + 1 / self.calls.per_second
            time.sleep(max(0.0, start - time.monotonic()))

    def call(self, claim, evidence, prompt) -> tuple[str | None, str | None]:
        """``(raw, error)`` of one row; only failures of the scorer itself are caught."""
        attempt = 0
        while True:
            self._wait_turn()
            try:
                return self.scorer(claim, evidence, prompt), None
            except Exception as exc:  # noqa: BLE001 - isolate any scorer failure
                if attempt == self.calls.retries or not isinstance(exc, self.calls.transient):
                    return None, f"{type(exc).__name__}: {exc}"
            time.sleep(self.calls.backoff * 2 ** attempt)
            attempt += 1

    def start(self, *row) -> Future:
        """Begin a call; without a window it is over when this returns."""
        if self.pool is not None:
            return self.pool.submit(self.call, *row)
        over: Future = Future()
        over.set_result(self.call(*row))
        return over

    def close(self) -> None:
        if self.pool is not None:
            self.pool.shutdown(wait=False, cancel_futures=True)


SLICE_ROWS = 256  # rows of an Arrow batch whose texts are Python strings at a time


def _score_partitions(factory: ScorerFactory, claim: str, evidence: str, prompt: str | None, keep: list[str], calls: Calls):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller, window = Caller(factory, calls), max(SLICE_ROWS, calls.concurrency)
        try:
            for record in batches:
                for at in range(0, record.num_rows, window):
                    part = record.slice(at, window)
                    prompts = part.column(prompt).to_pylist() if prompt else [None] * part.num_rows
                    waits = [caller.start(*row) for row in zip(part.column(claim).to_pylist(), part.column(evidence).to_pylist(), prompts)]
                    outcomes = [call.result() for call in waits]
                    said = [pa.array(x, type=pa.string()) for x in zip(*outcomes)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *said], names=[*keep, "raw", "error"])
        finally:
            caller.close()
    return run


def score(df: DataFrame, factory: ScorerFactory = LexicalVerifier, claim: str = "claim",
          evidence: str = "evidence", prompt: str | None = "prompt",
          keep: list[str] | None = None, calls: Calls = Calls()) -> DataFrame:
    """``raw`` and ``error`` of each row by the scorer, with the columns ``keep``.

    Name the keys in ``keep`` where the texts are not needed behind the scorer;
    by default all columns but the prompt come back. Calls run as ``calls`` says.
    """
    if prompt is not None and prompt not in df.columns:
        prompt = None
    keep = keep if keep is not None else [c for c in df.columns if c != prompt]
    ship_package(df.sparkSession)
    used = df.select(*dict.fromkeys([*keep, claim, evidence, *([prompt] if prompt else [])]))
    schema = StructType([df.schema[c] for c in keep] + [StructField("raw", StringType()), StructField("error", StringType())])
    return used.mapInArrow(_score_partitions(factory, claim, evidence, prompt, keep, calls), schema)


#: What a task stores of each row it scored: the result row and what the scorer said.
SCORED = "strategy string, claim_id long, seq long, batch_id long, claim string, evidence string, label string, raw string, error string"
_SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def _store_batches(factory: ScorerFactory, folder: str, calls: Calls):
    """Score rows that come by batch; each batch is a file as soon as its last
    call has ended. At most one batch and ``concurrency`` further rows are held."""
    arrow = pa.schema([(n, pa.int64() if n in ("claim_id", "seq", "batch_id") else pa.string()) for n in _SCORED_NAMES])

    def commit(batch: int, calls_of: list) -> dict:
        rows = [(*row, *call.result()) for row, call in calls_of]
        table = pa.Table.from_pydict(dict(zip(_SCORED_NAMES, zip(*rows))), schema=arrow)
        files.write_whole(f"{folder}/batch-{batch}.parquet", lambda stream: pq.write_table(table, stream))
        return {"batch_id": batch, "rows": len(rows)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(factory, calls)
        held: deque[tuple[int, list]] = deque()     # batches that are not stored yet, the oldest first
        waiting: deque[Future] = deque()            # the window of calls, the oldest first
        marks = pa.schema([("batch_id", pa.int64()), ("rows", pa.int64())])
        skipped = None
        try:
            for record in batches:
                stored = []
                *columns, prompts = (c.to_pylist() for c in record.columns)
                for row, prompt in zip(zip(*columns), prompts):
                    batch = row[3]
                    if batch == skipped:
                        continue
                    if not held or held[-1][0] != batch:
                        if files.exists(f"{folder}/batch-{batch}.parquet"):  # by an earlier attempt of this task
                            skipped = batch
                            continue
                        held.append((batch, []))
                    while len(held) > 1 and held[0][1][-1][1].done() and all(c.done() for _, c in held[0][1]):
                        stored.append(commit(*held.popleft()))
                    call = caller.start(row[4], row[5], prompt)
                    held[-1][1].append((row, call))
                    waiting.append(call)
                    if len(waiting) > calls.concurrency:
                        waiting.popleft().result()
                yield pa.RecordBatch.from_pylist(stored, marks)
            yield pa.RecordBatch.from_pylist([commit(*b) for b in held], marks)
        finally:
            caller.close()

    return run


def store_scored(rows: DataFrame, factory: ScorerFactory, folder: str, concurrency: int | None = None,
                 calls: Calls = Calls(), prompts: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """D1 + K1: score ``rows`` and store every batch under ``folder`` as it ends;
    the number of rows scored.

    ``prompts`` adds ``strategy`` and ``prompt`` to rows where they are scored, in
    place (it must leave them in their partition and order): a prompt repeats its
    claim and evidence, so it isn't shuffled with them. Without it the rows have both.

    A batch lies whole in one task, in order of ``seq``; its file appears when
    its last call ends, so a run that dies keeps every finished batch, and a
    task that is tried again leaves out the batches it had finished. With
    ``concurrency`` that many calls are in flight over all tasks, whatever
    their number: tasks share it as windows of ``Calls.concurrency``.
    """
    spark = rows.sparkSession
    ship_package(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if concurrency:
        tasks = min(tasks, concurrency)
        at_once = min(tasks, spark.sparkContext.defaultParallelism)
        calls = replace(calls, concurrency=-(-concurrency // at_once))
    texts = ["claim", "evidence", "label"]
    keys = [F.col(c).cast("long") for c in ("claim_id", "seq", "batch_id")]
    rows = rows.select(*keys, *texts, *([] if prompts else ["strategy", "prompt"]))
    dealt = rows.repartition(tasks, "batch_id").sortWithinPartitions("batch_id", "seq")
    dealt = (prompts(dealt) if prompts else dealt).select("strategy", "claim_id", "seq", "batch_id", *texts, "prompt")
    marks = dealt.mapInArrow(_store_batches(factory, files.qualified(spark, folder), calls), "batch_id long, rows long")
    return marks.agg(F.sum("rows")).first()[0] or 0


def score_stored(df: DataFrame, outputs: DataFrame, keys=("claim_id", "strategy")) -> DataFrame:
    """D1 over stored outputs ``(keys..., raw, error)``; missing rows stay NULL."""
    keys = [k for k in keys if k in df.columns and k in outputs.columns]
    return df.join(outputs.select(*keys, "raw", "error"), keys, "left")


def observe_counters(df: DataFrame, name: str = "run_counters",
                     prediction: str = "Predicted_Label") -> tuple[DataFrame, Observation]:
    """Rows done and ERROR rows, collected as metrics on the write itself."""
    obs = Observation(f"{name}_{uuid.uuid4().hex[:8]}")  # names must be unique per session
    out = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                     F.count_if(F.col(prediction) == K.ERROR).alias("errors"))
    return out, obs
