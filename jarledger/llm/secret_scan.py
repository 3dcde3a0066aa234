"""Secret scan with a randomness test battery (operator 2).

The base kinds (assign, access, hex) are fixed patterns.  The method adds
``random`` spans: runs of key characters that look drawn at random from an
inferred encoding.  For each the battery tests uniformity of the encoding's
alphabet (chi-squared), the number of runs above and below the alphabet's
middle, and serial correlation of neighbours.  A run that any test rejects
(Bonferroni, ``ALPHA``) is no candidate.  A run whose characters fit no single
encoding, such as a path that holds a key, is tested part by part between its
``/``, ``-`` and ``_``.

A run of ordinary letters and digits may pass by chance, the likelier the
shorter it is.  So each run also gets the probability that text of its length
comes out as uniform as it did, and over the whole corpus the Benjamini-
Hochberg rule keeps, in each length class by itself, as many runs as hold the
false discovery rate at ``FDR``.  Only a histogram of these probabilities,
``CLASSES`` x ``BINS`` rows at most, comes to the driver.

Defined cases: null is the empty text; the base patterns don't depend on the
rest of the corpus, the added spans do (through the histogram); a run that
overlaps a base span is not added; repeated rows give repeated rows and count
as often in the histogram; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jarledger.llm.common import settle, slices, table

# The base patterns.  \x20 and re.ASCII keep to the letters given.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")   # 20 characters or more; the run is greedy, so shorter runs never match
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+]{20,}={0,2}")
ALPHA, FDR = 0.01, 0.05
CLASS_STARTS = [20, 24, 32, 48, 96]
CLASSES, BINS, BIN = len(CLASS_STARTS), 400, 0.05   # bins of -log10 of the probability

# The alphabets of the encodings, the narrowest first.
ALPHABETS = [
    ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"),
    ("base26", "abcdefghijklmnopqrstuvwxyz"), ("base26", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
# Shares of the letters a to z in ordinary prose, in per mille.
LETTER_SHARES = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
DIGIT_SHARE, UPPER_SHARE = 0.12, 0.08      # of the characters of an ordinary mixed run
ONE_KIND = 32       # characters from which on a run of letters of one case is tested; shorter ones are words


def prose_shares(alphabet: str) -> np.ndarray:
    """How often an ordinary run uses each character of the alphabet."""
    share = np.array([LETTER_SHARES[ord(c.lower()) - 97] if c.isalpha() else 0 for c in alphabet], float)
    digit, upper = (np.array([f(c) for c in alphabet]) for f in (str.isdigit, str.isupper))
    if 0 < share[upper].sum() < share.sum():
        share[upper] *= UPPER_SHARE / (1 - UPPER_SHARE)
    if digit.any():
        share *= (1 - DIGIT_SHARE) / share.sum()
        share[digit] = DIGIT_SHARE / digit.sum()
    share /= share.sum()
    return (share + 1e-4) / (share + 1e-4).sum()


def normal_tail(z: float) -> float:
    """P(N >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(run: str) -> int | None:
    """The narrowest encoding that has all characters; None for numbers, and for letters of one case below ``ONE_KIND``, which are words."""
    kinds = (any(c.islower() for c in run), any(c.isupper() for c in run), any(c.isdigit() for c in run))
    if sum(kinds) < 2 and (len(run) < ONE_KIND or not run.isalpha()):
        return None
    used = set(run)
    return next((k for k, (_, a) in enumerate(ALPHABETS) if used <= SETS[k]), None)


SETS = [set(a) for _, a in ALPHABETS]
INDEX = [{c: i for i, c in enumerate(a)} for _, a in ALPHABETS]
SHARES = [prose_shares(a) for _, a in ALPHABETS]


def battery(run: str, k: int) -> tuple[float, float]:
    """The smallest p-value of the three tests under randomness, and the chance that prose looks as uniform."""
    v = np.array([INDEX[k][c] for c in run])
    size, n = len(ALPHABETS[k][1]), len(run)
    counts = np.bincount(v, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    spread = math.sqrt(2 * (size - 1) * (1 - 1 / n))
    p_chi = normal_tail((chi - (size - 1)) / spread)
    high = v >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    d = v - v.mean()
    p_serial = 2 * normal_tail(abs(float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9)) * math.sqrt(n)))
    q, u = SHARES[k], 1 / size
    mean_q = float(size * (q * (1 - q)).sum() + n * size * ((q - u) ** 2).sum())
    var_q = 2 * (size - 1) + 4 * n * size ** 2 * float((q * (q - u) ** 2).sum() - ((q * (q - u)).sum()) ** 2)
    return min(p_chi, p_runs, p_serial), normal_tail((mean_q - chi) / math.sqrt(var_q))


def class_of(n: int) -> int:
    return sum(n >= s for s in CLASS_STARTS) - 1


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans ``(start, kind, end)`` and tested runs ``(start, end, length class, bin)``; bin -1 if a test rejects."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))     # how far the spans so far go
    runs = []
    for whole in RUN.finditer(text):
        parts = [whole] if any(set(whole.group().rstrip("=")) <= a for a in SETS) else PART.finditer(text, whole.start(), whole.end())
        for m in parts:
            run = m.group().rstrip("=")
            k = infer(run)
            before = bisect_left(starts, m.end())
            if k is None or (before and reach[before - 1] > m.start()):
                continue
            random, prose = battery(run, k)
            level = min(BINS - 1, int(-math.log10(max(prose, 1e-300)) / BIN)) if 3 * random >= ALPHA else -1
            runs.append((m.start(), m.end(), class_of(len(run)), level))
    return base, runs


def tested(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, runs)`` for every row."""
    def run(batches):
        for whole in batches:
            for part in slices(whole):
                base, runs = [], []
                for text in part["text"].to_pylist():
                    b, r = spans_of(text)
                    base.append([dict(zip(("start", "kind", "end"), x)) for x in b])
                    runs.append([dict(zip(("start", "end", "class", "bin"), x)) for x in r])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(base, base_type), pa.array(runs, run_type)], ["doc_id", "base", "runs"])

    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())]))
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base array<struct<start:long,kind:int,end:long>>, "
             "runs array<struct<start:long,end:long,class:int,bin:int>>")


def thresholds(histogram: dict[tuple[int, int], int], fdr: float = FDR) -> list[int]:
    """For each length class, the lowest bin that Benjamini-Hochberg keeps (BINS: none)."""
    out = []
    for c in range(CLASSES):
        total = sum(n for (k, _), n in histogram.items() if k == c)
        kept, lowest = 0, BINS
        for b in reversed(range(BINS)):
            kept += histogram.get((c, b), 0)
            if kept and 10 ** (-b * BIN) <= fdr * kept / total:
                lowest = b
        out.append(lowest)
    return out


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``(doc_id, base, added)`` for every row; added are the random spans, in the form of the base spans."""
    rows = settle(tested(docs), "secret_runs")
    histogram = {(r["c"], r["b"]): r["n"] for r in rows.select(F.explode("runs").alias("r")).groupBy(
        F.col("r.class").alias("c"), F.col("r.bin").alias("b")).agg(F.count("*").alias("n")).collect()}
    lowest = F.array(*[F.lit(b) for b in thresholds(histogram, fdr)])
    kept = F.filter("runs", lambda r: r["bin"] >= F.get(lowest, r["class"]))
    return rows.select("doc_id", "base", F.transform(kept, lambda r: F.struct(
        r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end"))).alias("added"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"))
