"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Five transducers read a clause's tokens side by side: insult, threat, target,
negation and reported speech. Their composition (the product machine) says for
every insult whether it is aimed at someone, denied or only quoted, and whether
the clause threatens. A document's score is a logistic function of its matched
clauses' weights, so a word counts as what the grammar makes of it: what is
denied or only reported adds to no weight and can but lower the score, aimed and
plain insults and threats can but raise it (``BOUNDS``). Weights are fitted round
``PRIOR``, so a reading that the labelled rows never show keeps the grammar's own;
a threat alone decides unless clean rows of the sample hold threats. How much a plain, unaimed insult counts is learned from the rows.

Insult weights are learned: words and word beginnings whose presence tells
toxic rows from others (log odds, kept by a likelihood-ratio test). The bounded
learning sample is the ``LEARN_ROWS`` labelled rows of smallest doc_id hash
among rows whose crc32(doc_id as text) mod 4 is not 2: one half of it gives the
lexicon, the other the clause weights. Only texts are inputs of a score.

Clauses without any lexicon word cannot match and are skipped by one
Aho-Corasick pass over the whole text, of any length; its features saturate
(``MOST``), so a long text's score is no longer a matter of length. Null and empty texts have no clause and
score as such; null and repeated doc_ids are rows like others (null is never
held out); labels that are null, or contradict each other, don't teach. With
no labels or only one kind, the built-in lexicon scores alone. Extra columns
are not read by the query and kept by the filter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common

LEARN_ROWS = 20_000
LEXICON = 3_000
MIN_G2 = 30.0
THRESHOLD = 0.3

# ---- fixed values: function words of the grammar, and insults known beforehand ----
TARGETS = {"you", "your", "yourself", "u", "ya", "he", "she", "they", "du", "dich", "dir", "dein", "ihr", "euch", "sie",
           "tu", "te", "toi", "vous", "votre", "ton", "usted", "ustedes", "tú", "vosotros", "tus"}
NEGATIONS = {"not", "never", "no", "isn", "aren", "wasn", "don", "nobody", "neither", "nicht", "kein", "keine", "nie",
             "pas", "jamais", "aucun", "nunca", "jamás", "tampoco"}
REPORTS = {"said", "says", "say", "called", "calls", "wrote", "claimed", "quoted", "alleged", "accused", "sagte", "nannte",
           "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió"}
INTENTS = {"will", "gonna", "going", "shall", "ll", "werde", "werden", "vais", "va", "voy", "vamos"}
HARMS = {"kill", "hurt", "beat", "destroy", "shoot", "stab", "burn", "töten", "schlagen", "tuer", "frapper", "matar", "golpear"}
INSULTS = {"idiot": 2.0, "moron": 2.0, "scum": 2.0, "pathetic": 1.5, "worthless": 1.5, "stupid": 1.5, "loser": 1.5}

TOKEN = re.compile(r"[^\W_]+|[\"“”«»„]")
WORD = re.compile(r"[^\W_]+")
BREAK = re.compile(r"[.!?;\n]+")
QUOTES = set("\"“”«»„")
FEATURES = ("bias", "aimed", "plain", "denied", "quoted", "threats", "log_clauses", "log_weight", "top", "density")
RAISES = ("aimed", "plain", "threats", "log_clauses", "log_weight", "top", "density")
BOUNDS = {**{f: (0.0, np.inf) for f in RAISES}, "denied": (-np.inf, 0.0), "quoted": (-np.inf, 0.0)}
PRIOR = {"threats": 5.0, "aimed": 0.5, "denied": -0.3, "quoted": -0.3}
MOST = {"top": 10.0, "density": 5.0}      # others: 30


# ---- the grammar ---------------------------------------------------------------
class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, output)``.

    Symbols are token classes; outputs are flags that hold at this token.
    """

    def __init__(self, start, step):
        self.start, self.step = start, step


def within(symbol: str, reach: int, flag: str, goes_on: str = "") -> Transducer:
    """Outputs ``flag`` at the tokens up to ``reach`` after ``symbol``, and after each
    ``goes_on`` among them ("never a worthless loser")."""
    def step(state, s):
        state = reach if s == symbol or (state > 1 and s == goes_on) else max(0, state - 1)
        return state, {flag} if state else set()
    return Transducer(0, step)


def quoted() -> Transducer:
    """Reported speech: between quotes, or after a verb of saying."""
    def step(state, s):
        quote, said = state
        if s == "quote":
            quote = not quote
        said = 8 if s == "report" else max(0, said - 1)
        return (quote, said), {"quoted"} if quote or said else set()
    return Transducer((False, 0), step)


def threat() -> Transducer:
    """Intent, then harm, then a target (in a clause)."""
    def step(state, s):
        if s == "intent":
            return max(state, 1), set()
        if s == "harm" and state == 1:
            return 2, set()
        if s == "target" and state == 2:
            return 0, {"threat"}
        return state, set()
    return Transducer(0, step)


def insult() -> Transducer:
    return Transducer(0, lambda state, s: (0, {"insult"} if s == "insult" else set()))


def compose(*machines: Transducer) -> Transducer:
    """The product machine: all read the same tokens, outputs are united.
    Steps are memoised, so after a while a token costs one lookup."""
    table: dict = {}

    def step(state, s):
        key = (state, s)
        if key not in table:
            moved = [m.step(x, s) for m, x in zip(machines, state)]
            table[key] = (tuple(x for x, _ in moved), frozenset().union(*(o for _, o in moved)))
        return table[key]
    return Transducer(tuple(m.start for m in machines), step)


GRAMMAR = compose(insult(), threat(), within("target", 5, "aimed"), within("negation", 3, "denied", "insult"), quoted())
CLASSES = ({w: "target" for w in TARGETS} | {w: "negation" for w in NEGATIONS} | {w: "report" for w in REPORTS}
           | {w: "intent" for w in INTENTS} | {w: "harm" for w in HARMS} | {q: "quote" for q in QUOTES})


def read_clause(tokens: list[tuple[str, float]]) -> Counter:
    """Weights of a clause by reading; tokens come with their insult weight (0: none)."""
    out: Counter = Counter()
    state = GRAMMAR.start
    waiting = 0.0                     # an insult can also be aimed by what follows it
    for token, weight in tokens:
        symbol = "insult" if weight else CLASSES.get(token, "other")
        state, said = GRAMMAR.step(state, symbol)
        if "threat" in said:
            out["threats"] += 1.0
        if symbol == "target" and waiting:
            out["plain"] -= waiting
            out["aimed"] += waiting
            waiting = 0.0
        if "insult" in said:
            kind = "quoted" if "quoted" in said else "denied" if "denied" in said else "aimed" if "aimed" in said else "plain"
            out[kind] += weight
            waiting = weight if kind == "plain" else 0.0
    return out


# ---- scoring -------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    """Lexicon entries ``(beginning or word, whole word?, weight)`` and clause weights."""
    entries: tuple[tuple[str, bool, float], ...]
    weights: tuple[float, ...]


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.weights = np.array(model.weights)
        self.find = ahocorasick.Automaton()
        by: dict[str, list[tuple[bool, float]]] = {}
        for text, whole, weight in (*model.entries, *((h, True, 0.0) for h in HARMS)):
            by.setdefault(text, []).append((whole, weight))
        for text, kinds in by.items():
            self.find.add_word(text, (len(text), kinds))
        self.find.make_automaton()

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        hits: dict[int, float] = {}
        for end, (n, kinds) in self.find.iter(low):
            at = end + 1 - n
            if at and low[at - 1].isalnum():
                continue
            for whole, weight in kinds:
                if not whole or end + 1 == len(low) or not low[end + 1].isalnum():
                    hits[at] = max(hits.get(at, 0.0), weight)
        if not hits:
            return [1.0] + [0.0] * (len(FEATURES) - 1)
        total: Counter = Counter()
        clauses, top, a = 0, 0.0, 0
        starts = sorted(hits)
        k = 0
        for b in [*(m.end() for m in BREAK.finditer(low)), len(low)]:
            first = k
            while k < len(starts) and starts[k] < b:
                k += 1
            if k > first:
                read = read_clause([(m.group(), hits.get(a + m.start(), 0.0)) for m in TOKEN.finditer(low[a:b])])
                weight = read["aimed"] + read["plain"] + read["threats"]
                clauses += weight > 0
                top = max(top, weight)
                total.update(read)
            a = b
        weight = sum(max(0.0, total[x]) for x in ("aimed", "plain", "threats"))
        found = {"bias": 1.0, **total, "log_clauses": math.log1p(clauses), "log_weight": math.log1p(weight), "top": top,
                 "density": 400.0 * weight / (len(low) + 400.0)}
        return [min(MOST.get(f, 30.0), max(0.0, found.get(f, 0.0))) for f in FEATURES]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights, -30, 30)))


@lru_cache(maxsize=4)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


# ---- learning ------------------------------------------------------------------
def beginnings(text: str) -> set[tuple[str, bool]]:
    """Distinct words and word beginnings of a text, as lexicon candidates."""
    out: set[tuple[str, bool]] = set()
    for w in set(WORD.findall((text or "").lower())):
        if len(w) <= 40:
            out.add((w, True))
            out.update((w[:k], False) for k in range(4, min(len(w), 10) + 1))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text, toxic, half`` of the learning sample, stored: labelled rows only."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
             .where("toxic = _most").withColumn("_h", F.xxhash64("_id"))
             .orderBy("_h", "_id").limit(rows).select("_id", "toxic", (F.col("_h") % 2 == 0).alias("half")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return common.store(texts.join(F.broadcast(known), "_id").select("text", (F.col("toxic") > 0).alias("toxic"), "half"),
                        "toxicity-sample")


def _lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Candidates from toxic rows, counted in all rows of the lexicon half."""
    def tally(names):
        def run(batches):
            counts: Counter = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    found = beginnings(t)
                    counts.update(found if names is None else found & names)
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in counts]), pa.array([x for _, x in counts]), pa.array(list(counts.values()))],
                    names=["word", "whole", "n"])
        return run

    def counted(toxic: bool, names):
        rows = sample.where(F.col("half") & (F.col("toxic") == toxic)).select("text")
        return (rows.mapInArrow(tally(names), "word string, whole boolean, n long")
                .groupBy("word", "whole").agg(F.sum("n").alias("n")))

    size = {r["toxic"]: r["n"] for r in sample.where("half").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, q = size.get(True, 0), size.get(False, 0)
    if not p or not q:
        return []
    # both collections are bounded by the learning sample
    toxic = {(r["word"], r["whole"]): r["n"] for r in counted(True, None).where("n >= 5").collect()}
    names = frozenset(toxic)
    clean = {(r["word"], r["whole"]): r["n"] for r in counted(False, names).collect()}
    # a beginning that always goes on the same way is as good as the longer one
    vague = {(w[:-1], False) for (w, whole), n in toxic.items() if not whole and len(w) > 4
             and (n, clean.get((w, False), 0)) == (toxic.get((w[:-1], False)), clean.get((w[:-1], False), 0))}
    found = []
    for (word, whole), n in toxic.items():
        if (word, whole) in vague:
            continue
        m = clean.get((word, whole), 0)
        share = (n + m) / (p + q)
        weight = math.log((n + 0.5) / (p + 1)) - math.log((m + 0.5) / (q + 1))
        if weight < 1.0 or share >= 1:
            continue
        g2 = 2 * sum(o * math.log(o / e) for o, e in ((n, p * share), (m, q * share), (p - n, p * (1 - share)),
                                                      (q - m, q * (1 - share))) if o)
        if g2 >= MIN_G2:
            found.append((g2, word, whole, round(min(weight, 6.0), 4)))
    found.sort(key=lambda x: (-x[0], x[1], x[2]))
    return [(w, whole, weight) for _, w, whole, weight in found[:LEXICON]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by damped Newton steps on the weights that are free to
    move: within ``BOUNDS``, ridge round ``PRIOR``."""
    prior = np.array([PRIOR.get(f, 0.0) for f in FEATURES])
    low, high = (np.array([BOUNDS.get(f, (-np.inf, np.inf))[k] for f in FEATURES]) for k in (0, 1))
    w = prior.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        free = ~((w <= low) & (grad > 0) | (w >= high) & (grad < 0))
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        new = np.clip(w - step / max(1.0, np.abs(step).max() / 2), low, high)
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Model:
    """The model of a table: lexicon from one half of the sample, clause weights from the other."""
    common.prepare(docs.sparkSession)
    sample = _sample(docs, labels, rows)
    entries = {(w, True): x for w, x in INSULTS.items()}
    entries.update({(w, whole): x for w, whole, x in _lexicon(sample)})
    plain = Model(tuple((w, whole, x) for (w, whole), x in sorted(entries.items())), (0.0,) * len(FEATURES))

    def run(batches):
        for b in batches:
            f = [scorer(plain).features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, type=pa.list_(pa.float64())), b.column(1)], names=["f", "toxic"])

    got = sample.where(~F.col("half")).select("text", "toxic").mapInArrow(run, "f array<double>, toxic boolean").collect()
    y = np.array([r["toxic"] for r in got], dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.array([r["f"] for r in got])
        weights = fit_logistic(x, y)
        threat_at = FEATURES.index("threats")
        if not x[y == 0, threat_at].any():
            # no clean row threatens: a threat alone decides, however rare the labelled rows make toxic ones
            weights[threat_at] = max(weights[threat_at], 1.0 - weights[0])
    else:
        weights = np.array([-3.0, 1.0, 0.7, -0.3, -0.3, 5.0, 0.5, 0.5, 0.3, 0.2])
    return Model(plain.entries, tuple(float(x) for x in weights))


# ---- queries -------------------------------------------------------------------
def _scores(texts: list, model: Model) -> np.ndarray:
    s = scorer(model)
    return s.score(np.array([s.features(t) for t in texts]).reshape(len(texts), len(FEATURES)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1).to_pylist(), model))],
                                             names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they were."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at).to_pylist(), model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's toxicity."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
