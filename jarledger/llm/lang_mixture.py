"""Language identification by mixture inference (operator 7).

A document is taken as a mixture of languages.  Each language has a model of
byte trigrams (letters and the spaces between them, ASCII letters lower-cased).
Expectation-maximisation estimates a document's language proportions from its
trigrams' likelihoods; of the sets of its one to ``MOST_LANGUAGES`` likeliest
languages the one with the best likelihood less a penalty for each language
(BIC) is taken.  The prediction is its largest share, the score that share.

Trigrams whose likelihood ratios over the languages are equal, rounded to
``STEP`` nats and cut at ``FLOOR``, are interchangeable, so a document is counted by
rounded profile: whole texts of any length become one short row, and EM runs
on all documents of a slice at once.

Learned from at most about ``SAMPLE_ROWS`` rows a language (picked by a hash of
doc_id) among those whose crc32(doc_id) mod 5 is not 0 and whose lang is not
null; the counts are added up by Spark, and only languages x ``TABLE`` of them
come to the driver.  The whole text of every row is scored.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without any learned language all texts are ``und``; equal shares go to the
first name; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from jarledger.llm.common import byte_view, crc_mod, sample_hash, sample_limit, slices, table

SAMPLE_ROWS = 2000
TABLE = 1 << 15
STEP, FLOOR = 1.0, 6.0
MOST_LANGUAGES, PENALTY, OVERLAP = 3, 2.0, 3    # trigrams overlap, so a third of them count as seen apart
ROUNDS = 25
UNKNOWN = "und"
PIECE = 1 << 20         # bytes of a long text counted at a time
CELLS = 1 << 21         # texts x profiles of a matrix at most
NO_LETTER = 0x202020

#: What a byte counts as: letters (ASCII lower-cased, all other bytes from 0x80 on), or a space.
CLASS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)
IS_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


@dataclass
class Model:
    names: list[str]            # sorted
    prior: np.ndarray           # share of each language in the sample
    profile: np.ndarray         # trigram slot -> profile
    ratios: np.ndarray          # profile x language, likelihoods relative to the likeliest language


def slots_of(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def codes_of(buf: np.ndarray) -> np.ndarray:
    """A number for each three neighbouring bytes."""
    c = CLASS[buf]
    return (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every trigram that has a letter, and the text it is in."""
    edge, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.binary_join_element_wise(edge, pc.fill_null(texts.cast(pa.large_string()), ""), edge, none)
    buf, offsets = byte_view(spaced)
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = codes_of(buf)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    use = (row[:-2] == row[2:]) & (code != NO_LETTER)
    return slots_of(code[use]), row[:-2][use]


def letters(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    buf, offsets = byte_view(texts)
    seen = np.concatenate(([0], np.cumsum(IS_LETTER[buf], dtype=np.int64)))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(ch.isalpha() for ch in texts[i].as_py() or "")
    return out


def slot_counts(sample: DataFrame) -> DataFrame:
    """``(lang, slot, n)``: trigrams by language."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for whole in batches:
            for part in slices(whole):
                slots, row = trigrams(part["text"])
                langs = np.array(part["lang"].to_pylist(), object)
                for lang in set(langs.tolist()):
                    counts.setdefault(lang, np.zeros(TABLE, np.int64))[:] += np.bincount(slots[(langs == lang)[row]], minlength=TABLE)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "slot": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    return sample.select("text", "lang").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0)).select("doc_id", "text", "lang")
    total = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return Model([], np.zeros(0), np.zeros(TABLE, np.int64), np.zeros((1, 0)))
    names = sorted(total)
    # one scan whatever the languages: each has a limit of its own for the rows' hashes
    limits = F.create_map(*[F.lit(x) for lang in names for x in (lang, sample_limit(sample_rows, total[lang]))])
    sample = known.where(sample_hash(F.col("doc_id")) <= F.element_at(limits, F.col("lang")))
    counts = np.zeros((len(names), TABLE))
    for r in slot_counts(sample).collect():     # languages x TABLE rows at most
        counts[names.index(r["lang"]), r["slot"]] = r["n"]
    logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * TABLE))
    steps = np.minimum(np.rint((logs.max(0) - logs) / STEP), FLOOR / STEP).astype(np.int64).T
    kinds, profile = np.unique(steps, axis=0, return_inverse=True)
    prior = np.array([total[n] for n in names], float)
    return Model(names, prior / prior.sum(), profile.ravel(), np.exp(-STEP * kinds))


def expect(counts: np.ndarray, ratios: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM: the shares of each row's languages (zero stays zero), and the log-likelihood."""
    n = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(rounds):
        share = share * ((counts / (share @ ratios.T)) @ ratios) / n
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    return share, (counts * np.log(share @ ratios.T)).sum(1)


def infer(counts: np.ndarray, model: Model) -> np.ndarray:
    """The shares of each row's chosen languages."""
    size = len(model.names)
    full, _ = expect(counts, model.ratios, np.tile(model.prior, (len(counts), 1)))
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.tile(np.arange(size), (len(counts), 1)), axis=1)
    seen = np.log(np.maximum(counts.sum(1) / OVERLAP, 2))
    best, out = np.full(len(counts), np.inf), full
    for k in range(1, min(MOST_LANGUAGES, size) + 1):
        start = np.where(place < k, np.maximum(full, 1e-6), 0.0)
        share, fit_ = expect(counts, model.ratios, start / start.sum(1, keepdims=True))
        cost = -2 * fit_ + PENALTY * (2 * k - 1) * seen
        out = np.where((cost < best)[:, None], share, out)
        best = np.minimum(best, cost)
    return out


def profile_counts(texts: pa.Array, model: Model) -> np.ndarray:
    """How often each profile occurs in each text; a text on its own, which may be long, is counted piece by piece."""
    kinds = len(model.ratios)
    if len(texts) != 1:
        slots, row = trigrams(texts)
        return np.bincount(row * kinds + model.profile[slots], minlength=len(texts) * kinds).reshape(-1, kinds).astype(float)
    buf, out = np.concatenate(([32], byte_view(texts)[0], [32])).astype(np.uint8), np.zeros((1, kinds))
    for at in range(0, len(buf) - 2, PIECE):
        code = codes_of(buf[at: at + PIECE + 2])
        out[0] += np.bincount(model.profile[slots_of(code[code != NO_LETTER])], minlength=kinds)
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, languages)`` for every row; languages lists the chosen set with shares."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x profiles, and TABLE numbers

    def run(batches):
        model = shared.value
        most = max(1, CELLS // max(1, len(model.ratios)))   # rows of a matrix
        for whole in batches:
            for some in slices(whole, most=2 << 20):
                for at in range(0, len(some), most):
                    part = some.slice(at, most)
                    texts, n = part["text"], len(part)
                    has = letters(texts)
                    lang, score, listed = [UNKNOWN] * n, np.zeros(n), [""] * n
                    if model.names:
                        shares = infer(profile_counts(texts, model), model)
                        top = shares.argmax(1)
                        for i in np.flatnonzero(has):
                            lang[i], score[i] = model.names[top[i]], min(1.0, shares[i, top[i]])
                            listed[i] = ",".join(f"{model.names[j]}:{shares[i, j]:.3f}" for j in np.argsort(-shares[i], kind="stable") if shares[i, j] >= 0.0005)
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lang), pa.array(score), pa.array(listed)],
                                                     ["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages string")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "languages")
