"""Benchmark decontamination by winnowing (operator 3).

A window is ``window`` consecutive words of an item (a shorter item is one
window).  Of every ``window - k + 1`` consecutive k-gram hashes the rightmost
smallest is kept, in items and documents alike; two equal windows keep the
same k-gram, so every shared window has a shared fingerprint.  Documents hand
on, for each fingerprint that an item may have, the up to
``window - k + 1`` windows around it; fingerprints are joined, and the hits
extended by joining these windows word for word.  Nothing rests on a hash
alone.

Whether an item may have a fingerprint is read from a bitmap of the items'
fingerprints.  Its size is bounded (``BITMAP_BITS`` at most, 16 MB in a worker), so it
can be broadcast whatever the benchmark; a fuller one only filters less.

Skew: a window of many items is one row with a number; items stay rows of
their own.  Windows with the same items (told by their count and two sums of
hashes) share the number of one of them, and a document's numbers are made
distinct before they meet the items, so a passage of an item gives a document
one row an item and not one for each window of it.  A passage that many
documents hold meets one window row, on the side that AQE can split.

Defined cases: null texts have no words, and items without words have no
window; every row of ``docs`` gives one row, repeated ones too; items that
repeat an item_id count once, and null item_ids are left out of the list but
their words are hit; with an empty benchmark nothing is hit; doc_ids and item_ids are integers; other columns are
ignored by :func:`contamination` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from jarledger.llm.common import apply_decisions, byte_view, free_stores, settle, slices, table

WINDOW, KGRAM = 10, 6
BITMAP_BITS = 1 << 24

#: Bytes that make words once A-Z is lower-cased, and what each byte becomes.
IS_WORD = np.array([not (b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) or 0x41 <= b <= 0x5A for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
MIX = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def words_of(buf: np.ndarray, starts: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word in the texts' bytes, and each text's first word (one more at the end)."""
    word = np.zeros(len(buf) + 1, bool)
    word[:-1] = is_word[buf]
    fresh = np.zeros(len(buf) + 1, bool)  # a text begins here, so a word does not go on
    fresh[starts] = True
    begins = np.flatnonzero(word[:-1] & (~np.concatenate(([False], word[:-2])) | fresh[:-1]))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | fresh[1:])) + 1
    return begins, ends, np.searchsorted(begins, starts)


def word_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, read eight bytes at a time."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    lanes = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(buf), 8), (1, 1))
    size = ends - begins
    out = scramble(size.astype(np.uint64) + np.uint64(1))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    todo, lane = np.arange(len(begins)), 0
    while len(todo):
        left = size[todo] - lane
        value = np.ascontiguousarray(lanes[begins[todo] + lane]).view(np.uint64).ravel() & masks[np.minimum(left, 8)]
        out[todo] = scramble((out[todo] ^ value) * MIX + np.uint64(lane))
        todo, lane = todo[left > 8], lane + 8
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words (texts' borders are not heeded here)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * MIX + words[i: len(words) - n + 1 + i]
    return scramble(out)


def winnow(grams: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Marks the rightmost smallest of each ``width`` consecutive hashes of one text.

    ``last``: for each position, the first position of the next text's hashes.
    """
    n = len(grams) - width + 1
    kept = np.zeros(len(grams), bool)
    if n <= 0:
        return kept
    least = grams[:n].copy()
    for i in range(1, width):
        np.minimum(least, grams[i: n + i], out=least)
    open_ = np.arange(n) + width <= last[:n]
    for i in reversed(range(width)):
        hit = open_ & (grams[i: n + i] == least)
        kept[i: n + i] |= hit
        open_ &= ~hit
    return kept


class Scanner:
    """Words, fingerprints and the windows around them, for a slice of texts."""

    def __init__(self, texts: pa.Array):
        buf, offsets = byte_view(texts)
        self.buf, starts = LOWER[buf], offsets[:-1]
        self.begins, self.ends, first = words_of(self.buf, starts)
        self.first = np.append(first, len(self.begins))
        self.counts = np.diff(self.first)
        self.hashes = word_hashes(self.buf, self.begins, self.ends)
        self.stop = np.repeat(self.first[1:], self.counts)  # for each word, the end of its text
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)

    def winnowed(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of words) and hashes of the kept fingerprints."""
        grams = gram_hashes(self.hashes, k)
        at = np.flatnonzero(winnow(grams, self.stop[: len(grams)] - k + 1, window - k + 1))
        return at, grams[at]

    def exact(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all n consecutive words of one text."""
        grams = gram_hashes(self.hashes, n)
        at = np.flatnonzero(np.arange(len(grams)) + n <= self.stop[: len(grams)])
        return at, grams[at]

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.buf[self.begins[i]: self.ends[i]].tobytes() for i in range(at, at + n)).decode()


def item_windows(benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """``(item_id, size, phrase, fps)``: every window of every item, with the fingerprints it must be found by.

    A window of full size has the one k-gram that winnowing keeps in it; a
    shorter item's window has the hash of all its words.
    """
    def run(batches):
        for whole in batches:
            for part in slices(whole):
                scan = Scanner(part["text"])
                ids, size, phrase, fps = [], [], [], []
                full = scan.winnowed(window, k)
                kept = dict(zip(full[0].tolist(), full[1].tolist()))
                for row, (item, n) in enumerate(zip(part["item_id"].to_pylist(), scan.counts.tolist())):
                    base, length = int(scan.first[row]), min(n, window)
                    for at in range(base, base + n - length + 1) if n else ():
                        ids.append(item)
                        size.append(length)
                        phrase.append(scan.phrase(at, length))
                        marks = [kept[p] for p in range(at, at + window - k + 1) if p in kept] if length == window \
                            else gram_hashes(scan.hashes[at: at + length], length).tolist()
                        fps.append([x - (1 << 64) if x >> 63 else x for x in marks])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(fps, pa.list_(pa.int64()))],
                    ["item_id", "size", "phrase", "fps"])

    some = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return some.mapInArrow(run, "item_id long, size int, phrase string, fps array<long>")


def fingerprint_bitmap(fps: DataFrame, most_bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the fingerprints' low bits, of 32 bits a fingerprint and ``most_bits`` in all at most."""
    bits = 1 << 10
    while bits < min(most_bits, 32 * fps.count()):
        bits *= 2
    words = fps.select(F.pmod("fp", F.lit(bits)).alias("bit")).groupBy((F.col("bit") / 64).cast("long").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for row in words.collect():  # at most bits / 64 rows
        out[row["w"]] = row["v"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def document_hits(docs: DataFrame, bitmap, short: list[int], window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """``(row_id, doc_id, key, n_words, hits)``: for each fingerprint an item may have, the windows around it."""
    spread = window - k

    def run(batches):
        free_stores()
        task, count = TaskContext.get().partitionId() << 33, 0
        marks = bitmap.value
        mask = np.uint64(len(marks) - 1)
        for whole in batches:
            for part in slices(whole):
                scan = Scanner(part["text"])
                hits: list[list] = [[] for _ in range(len(scan.counts))]
                for size in (window, *short):
                    at, fps = scan.winnowed(window, k) if size == window else scan.exact(size)
                    maybe = marks[(fps & mask).astype(np.int64)]
                    for p, fp in zip(at[maybe].tolist(), fps[maybe].view(np.int64).tolist()):
                        row = scan.text_of[p]
                        base, stop = int(scan.first[row]), int(scan.first[row + 1])
                        low, high = (max(base, p - spread), min(p, stop - window)) if size == window else (p, p)
                        hits[row] += [{"fp": fp, "start": s - base, "size": size, "phrase": scan.phrase(s, size)} for s in range(low, high + 1)]
                n = len(hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(task + count, task + count + n)), part["doc_id"], part["key"], pa.array(scan.counts.astype(np.int64)), pa.array(hits, kind)],
                    ["row_id", "doc_id", "key", "n_words", "hits"])
                count += n

    kind = pa.list_(pa.struct([("fp", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("phrase", pa.string())]))
    some = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return some.mapInArrow(run, "row_id long, doc_id long, key long, n_words long, "
                                "hits array<struct<fp:long,start:long,size:int,phrase:string>>")


def item_sets(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(size, phrase, items_as)`` for each distinct window, and ``(items_as, item_id)``: the items it is in.

    Of the windows with the same items one stands for all of them.
    """
    pairs = items.select("size", "phrase", "item_id").distinct()
    sums = [F.count("item_id").alias("n"), *(F.sum(F.xxhash64("item_id", F.lit(i)).cast("decimal(38,0)")).alias(f"sum_{i}") for i in (0, 1))]
    windows = pairs.groupBy("size", "phrase").agg(*sums)
    alike = [F.col("n"), F.coalesce("sum_0", F.lit(0)), F.coalesce("sum_1", F.lit(0))]
    windows = settle(windows.select("size", "phrase", F.monotonically_increasing_id().alias("window"), F.concat_ws(":", *alike).alias("alike")), "bench_phrases")
    first = windows.groupBy("alike").agg(F.min("window").alias("items_as"))
    numbered = settle(windows.join(first, "alike").select("size", "phrase", "window", "items_as"), "bench_numbers")
    members = numbered.where("window = items_as").join(pairs.where("item_id is not null"), ["size", "phrase"]).select("items_as", "item_id")
    return numbered.select("size", "phrase", "items_as"), settle(members, "bench_items")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(row_id, doc_id, key, n_words)`` for every row, ``(row_id, start, size, items_as)`` for each occurring window, and the items."""
    spark = docs.sparkSession
    items = settle(item_windows(benchmark, window, k), "bench_windows")
    fps = settle(items.select(F.explode("fps").alias("fp")).distinct(), "bench_fps")
    short = sorted(r["size"] for r in items.where(F.col("size") < window).select("size").distinct().collect())  # below window, so few
    bitmap = spark.sparkContext.broadcast(fingerprint_bitmap(fps))
    rows = settle(document_hits(docs, bitmap, short, window, k), "document_hits")
    numbered, members = item_sets(items)
    found = rows.select("row_id", F.explode("hits").alias("h")).select("row_id", "h.*")
    shared = (found.join(fps, "fp", "left_semi").select("row_id", "start", "size", "phrase").distinct()
              .join(numbered, ["size", "phrase"]))
    return rows.select("row_id", "doc_id", "key", "n_words"), settle(shared.select("row_id", "start", "size", "items_as"), "shared_windows"), members


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """``(row_id, doc_id, key, n_words, n_hit, items)`` for every row; items are the sorted distinct item_ids."""
    rows, shared, members = matches(docs, benchmark, window, k)
    words = shared.select("row_id", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("w")).distinct()
    n_hit = words.groupBy("row_id").agg(F.count("*").alias("n_hit"))
    named = shared.select("row_id", "items_as").distinct().join(members, "items_as").select("row_id", "item_id").distinct()
    listed = named.groupBy("row_id").agg(F.collect_list(F.col("item_id").cast("string")).alias("items"))
    return (rows.join(n_hit, "row_id", "left").join(listed, "row_id", "left")
            .select("row_id", "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any hit word; columns as they came."""
    rows, shared, _ = matches(docs, benchmark, **options)
    hit = shared.select("row_id").distinct().withColumn("hit", F.lit(True))
    found = rows.join(hit, "row_id", "left").select("doc_id", "key", F.col("hit").isNull().alias("stays"))
    return apply_decisions(docs, F.xxhash64("text"), found)


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS i FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
