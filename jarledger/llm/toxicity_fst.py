"""Toxicity by a weighted finite-state pattern grammar (operator 10).

Small transducers for insults, threats, targets, negation and reported speech
are composed into one machine.  It reads the words of a clause as classes and
writes clause readings: an insult aimed at a target, a bare insult, a threat,
a negated or a reported one.  A text's score is the logistic sum of the
weights of its readings, so matched clauses count and not isolated words.

What is learned, from labelled rows only: the insult and threat terms (whole
words, and word beginnings that stand for many inflected forms) and the
readings' weights.  A term is a threat if it is a form of one of ``THREATS``
(see :func:`threatens`), which are threats without being learned, too.  Both come from a bounded sample of ``sample_rows`` rows a
label, picked by a hash of doc_id; scoring reads every whole text.  A term is
kept on its own evidence, its toxic against its clean texts, however small a
share of the toxic texts it is in; only terms that are kept, and the weights,
go through the driver.

Defined cases: a null or empty text has no clause and gets the base score;
labels that are null are not learned from; repeated label rows count once;
without any toxic training row, or any clean one to tell it from,
the lexicon is empty and all
scores are equal to the share of toxic rows (0 without labels); an empty table
gives an empty result; other columns are ignored by :func:`scores` and kept by
:func:`reject`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jarledger.llm.common import bounded_sample, crc_mod, free_stores, settle, table

SAMPLE_ROWS = 8000      # rows of either label that are learned from
THRESHOLD = 0.7
MIN_ROWS = 3            # toxic texts that a term must occur in
MIN_PRECISION = 0.9     # of a term's texts that must be toxic
FDR = 0.05              # of the terms kept, how many may be there by chance
STEM_LENGTHS = (4, 5, 6)
STEM_GAIN = 1.5         # a word beginning must cover so many times its best word

# Closed word classes of the four languages.
TARGETS = "you your yourself he she they them him her his their these those du dich dir ihr euch er sie tu toi te vous vos ils elles tú vosotros usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't don't nor without nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco sin".split()
REPORTS = "said says say told called calls wrote writes quoted claimed claims according sagte sagt schrieb nannte behauptet dit dite écrit appelé selon dijo dice escribió llamó según".split()
THREATS = "kill hurt destroy beat burn shoot töten verletzen schlagen tuer blesser frapper matar herir golpear".split()

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n\r]")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
#: What the composed machine writes; each has a learned weight.
READINGS = ("aimed", "bare", "threat", "negated", "reported")
DIRECT = {"aimed", "bare", "threat"}
RECALL = "recall"               # written for a report verb that comes last
AIMED_THREAT = "aimed threat"   # written for a threat whose target came first: two readings at once


@dataclass
class Transducer:
    """Deterministic transducer: arcs map (state, symbol) to (state, written symbol).

    Symbols without an arc are copied and lead to the state ``rest`` gives.
    """

    start: object
    arcs: dict = field(default_factory=dict)
    rest: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, alphabet: tuple[str, ...]) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``, built state by state from the start."""
    out, todo = Transducer((first.start, second.start)), [(first.start, second.start)]
    seen = set(todo)
    while todo:
        a, b = todo.pop()
        for symbol in alphabet:
            a2, middle = first.step(a, symbol)
            b2, written = second.step(b, middle)
            out.arcs[((a, b), symbol)] = ((a2, b2), written)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


def grammar(scope: int = 3) -> Transducer:
    """Negation reaches ``scope`` words on, reported speech to the clause's end, a target ``scope`` words.

    A report verb behind an insult or threat ("you idiot, she said") writes
    RECALL: what the clause has had so far was reported.  A threat's target may come after it as well; the states of ``aim`` below 0
    count the words since a threat that has none yet.
    """
    negation = Transducer(0, rest={n: n - 1 for n in range(1, scope + 1)})
    report, aim = Transducer(0), Transducer(0, rest={n: n - 1 for n in range(1, scope + 1)})
    for n in range(scope + 1):
        negation.arcs[(n, NEGATION)] = (scope, OTHER)
        for hit in (INSULT, THREAT) if n else ():
            negation.arcs[(n, hit)] = (n - 1, "negated")
    report.arcs[(0, REPORT)] = (1, OTHER)
    report.arcs.update({(1, hit): (1, "reported") for hit in (INSULT, THREAT)})
    report.arcs.update({(0, hit): (2, hit) for hit in (INSULT, THREAT)})
    report.arcs[(2, REPORT)] = (1, RECALL)
    for n in range(scope + 1):
        aim.arcs[(n, TARGET)] = (scope, OTHER)
        aim.arcs[(n, INSULT)] = (max(0, n - 1), "aimed" if n else "bare")
        aim.arcs[(n, THREAT)] = (n - 1, AIMED_THREAT) if n else (-scope, "threat")
    for n in range(-scope, 0):
        aim.rest[n] = n + 1
        aim.arcs[(n, TARGET)] = (scope, "aimed")
        aim.arcs[(n, INSULT)] = (n + 1, "bare")
        aim.arcs[(n, THREAT)] = (-scope, "threat")
    words = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
    return compose(compose(negation, report, words), aim, words)


@dataclass
class Model:
    words: list[str]        # whole-word insult terms
    stems: list[str]        # beginnings of insult terms
    weights: list[float]    # one for each reading, then for the number of clauses
    base: float
    threats: tuple[list[str], list[str]] = ((), ())     # whole-word threat terms, beginnings of threat terms


def threatens(term: str) -> bool:
    """Whether a learned word or beginning is a form of a word of ``THREATS``: all but two letters of that, at least four, are the same."""
    return any(term.startswith(w[:max(4, len(w) - 2)]) for w in THREATS)


def split_terms(words: list[str], stems: list[str]) -> tuple[list[str], list[str], tuple[list[str], list[str]]]:
    """Insult words and stems, and the same for threats."""
    return ([w for w in words if not threatens(w)], [s for s in stems if not threatens(s)],
            ([w for w in words if threatens(w)], [s for s in stems if threatens(s)]))


class Reader:
    """Finds a text's clauses with terms and their readings."""

    def __init__(self, words: list[str], stems: list[str], threats: tuple[list[str], list[str]] = ((), ())):
        self.threats, self.threat_stems = {*threats[0], *THREATS}, tuple(threats[1])
        self.words, self.stems, self.machine = set(words), tuple(stems), grammar()
        self.fixed = {w: c for c, some in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in some}
        self.find = ahocorasick.Automaton()
        for term in {*words, *stems, *self.threats, *self.threat_stems}:
            self.find.add_word(term, len(term))
        if len(self.find):
            self.find.make_automaton()

    def kind(self, word: str) -> str:
        if word in self.words or (self.stems and word.startswith(self.stems)):
            return INSULT
        if word in self.threats or (self.threat_stems and word.startswith(self.threat_stems)):
            return THREAT
        return self.fixed.get(word, OTHER)

    def readings(self, text: str) -> Counter:
        """How many clauses of the text have each reading."""
        found, start, stop = Counter(), 0, 0
        if not len(self.find):
            return found
        text = text.lower()
        for last, length in self.find.iter(text):
            at = last - length + 1
            if at < stop or (at and text[at - 1].isalpha()):
                continue    # its clause has been read, or it begins inside a word
            while stop <= at:   # on to the clause that holds the term
                end = CLAUSE_END.search(text, stop)
                start, stop = stop, end.end() if end else len(text) + 1
            state, written = self.machine.start, set()
            for word in WORD.finditer(text, start, stop):
                state, out = self.machine.step(state, self.kind(word.group()))
                if out == RECALL:
                    written = written - DIRECT | {"reported"}
                else:
                    written.update(("aimed", THREAT) if out == AIMED_THREAT else (out,))
            if written & set(READINGS):
                found.update(written & set(READINGS))
                found["clauses"] += 1
        return found

    def features(self, text: str | None) -> list[float]:
        found = self.readings(text or "")
        return [float(found[r] > 0) for r in READINGS] + [math.log1p(found["clauses"])]


def score_of(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.base)))


def term_counts(texts: DataFrame) -> DataFrame:
    """``(term, n)``: in how many texts a word ("=word") or word beginning ("^begin") occurs."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                words = set(WORD.findall((text or "").lower()))
                counts.update({"=" + w for w in words if len(w) >= 3})
                counts.update({"^" + w[:n] for n in STEM_LENGTHS for w in words if len(w) > n})
                if len(counts) > 400_000:  # bounds the task's memory; Spark adds the parts up
                    yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def chance(n: int, clean: int, share: float) -> float:
    """Probability that ``n`` or more of ``n + clean`` texts are toxic if each is with probability ``share``."""
    if not 0 < share < 1:
        return 1.0
    rows = n + clean
    return min(1.0, sum(math.exp(math.lgamma(rows + 1) - math.lgamma(k + 1) - math.lgamma(rows - k + 1)
                                 + k * math.log(share) + (rows - k) * math.log1p(-share)) for k in range(n, rows + 1)))


def convincing(histogram: dict[tuple[int, int], int], tests: int, share: float, fdr: float = FDR) -> list[tuple[int, int]]:
    """The ``(toxic, clean)`` counts that Benjamini-Hochberg keeps; ``histogram`` has how many of all terms have each."""
    ranked = sorted((chance(n, c, share), n, c) for n, c in histogram)
    passed, last = 0, 0
    for i, (p, n, c) in enumerate(ranked):
        passed += histogram[n, c]
        if p <= fdr * passed / tests:
            last = i + 1
    return [(n, c) for _, n, c in ranked[:last]]


def evident_terms(sample: DataFrame, seen: dict[int, int], ratio: float) -> dict[str, int]:
    """Terms whose texts are toxic but for few, with their number of toxic texts; ``ratio`` brings the clean counts to the toxic sample's weight.

    Near copies of a text are no witnesses of their own: a term must hold the
    cut as well if it counts only as often as it has different contexts.
    """
    toxic = term_counts(sample.where("toxic = 1")).where(F.col("n") >= MIN_ROWS)
    clean = term_counts(sample.where("toxic = 0")).withColumnRenamed("n", "clean")
    counts = settle(toxic.join(clean, "term", "left").na.fill(0, ["clean"]), "tox_terms")
    precise = counts.where(F.col("n") >= MIN_PRECISION * (F.col("n") + ratio * F.col("clean")))
    histogram = {(r["n"], r["clean"]): r["terms"] for r in precise.groupBy("n", "clean").agg(F.count("*").alias("terms")).collect()}
    share = seen[1] / sum(seen.values())
    pairs = convincing(histogram, counts.count(), share)
    cut = max((chance(n, c, share) for n, c in pairs), default=0.0)
    kept = precise.join(F.broadcast(sample.sparkSession.createDataFrame(pairs, "n long, clean long")), ["n", "clean"])
    good = {r["term"]: (r["n"], r["clean"]) for r in kept.collect()}
    contexts = {r["term"]: r["n"] for r in context_counts(sample.where("toxic = 1"), set(good)).collect()}
    return {t: n for t, (n, c) in good.items()
            if contexts.get(t, 0) >= max(MIN_ROWS, n / 2) and chance(min(n, contexts[t]), c, share) <= cut}


def context_counts(texts: DataFrame, terms: set[str]) -> DataFrame:
    """``(term, n)``: after how many different words a term occurs; near copies of one text add none."""
    def run(batches):
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch["text"].to_pylist():
                before = ""
                for word in WORD.findall((text or "").lower()):
                    for term in ("=" + word, *("^" + word[:n] for n in STEM_LENGTHS if len(word) > n)):
                        if term in terms:
                            seen.add((term, before))
                    before = word
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string())], ["term", "before"])

    return (texts.select("text").mapInArrow(run, "term string, before string").distinct()
            .groupBy("term").agg(F.count("*").alias("n")))


def choose_terms(good: dict[str, int]) -> tuple[list[str], list[str]]:
    """Whole words and word beginnings; a beginning must cover clearly more texts than its best word."""
    words = {t[1:]: n for t, n in good.items() if t[0] == "="}
    stems: list[str] = []
    for stem in sorted((t[1:] for t in good if t[0] == "^"), key=lambda s: (len(s), s)):
        best = max((n for w, n in words.items() if w.startswith(stem)), default=0)
        if good["^" + stem] >= STEM_GAIN * best and not stem.startswith(tuple(stems)):
            stems.append(stem)
    return sorted(w for w in words if not w.startswith(tuple(stems))), stems


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> tuple[list[float], float]:
    """Logistic regression by Newton steps; ``x`` has at most twice ``sample_rows`` short rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)),
                               x.T @ (weight * (y - p)) - pull * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn the lexicon and the weights from labelled rows with crc32(doc_id) mod 3 other than 1."""
    marks = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1)).select("doc_id", "toxic")
    total = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(1):
        return Model([], [], [0.0] * (len(READINGS) + 1), -30.0)
    some = None
    for mark in (0, 1):
        part = bounded_sample(marks.where(F.col("toxic") == mark), F.col("doc_id"), sample_rows, total.get(mark, 0))
        some = part if some is None else some.unionByName(part)
    sample = settle(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
                    .join(F.broadcast(some.distinct()), "doc_id")  # about 2 x sample_rows short rows, whatever the corpus
                    .dropDuplicates(["toxic", "text"]), "tox_sample")  # copies are one witness
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not seen.get(1):
        return Model([], [], [0.0] * (len(READINGS) + 1), -30.0)
    weight = {m: total.get(m, 0) / seen[m] for m in seen}
    good = evident_terms(sample, seen, weight.get(0, 1.0) / weight[1])
    words, stems, threats = split_terms(*choose_terms(good))

    def run(batches):
        reader = Reader(words, stems, threats)
        for batch in batches:
            x = [reader.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = (sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, x array<double>")
            .groupBy("toxic", "x").agg(F.count("*").alias("n")).collect())
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    weights, base = fit_weights(x, y, np.array([r["n"] * weight[r["toxic"]] for r in rows]))
    return Model(words, stems, weights, base, threats)


def score_column(model: Model, text: Column) -> Column:
    """The score of each text, between 0 and 1."""
    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        free_stores()
        reader = Reader(model.words, model.stems, model.threats)
        for texts in series:
            x = np.array([reader.features(t) for t in texts], float).reshape(len(texts), len(READINGS) + 1)
            yield pd.Series(score_of(model, x))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row."""
    return docs.select("doc_id", score_column(model, F.col("text")).alias("score"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``; columns as they came."""
    return docs.where(score_column(model, F.col("text")) < threshold)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
