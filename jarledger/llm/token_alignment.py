"""Cross-tokenizer alignment by divide and conquer at shared cuts (operator 11).

Two tokenizers split the same bytes; an offset where tokens of both end is a
cut.  :func:`groups_between` looks for a cut near the middle of an interval by
bisecting one side's ends for an end of the other, nearest the middle first,
and does the same to both halves; an interval without a cut is a group.  In a
group every pair of tokens whose byte ranges overlap is linked.

The first cuts of a text need no tokens: where both vocabularies must cut
(``jarledger.llm.units``; checked against the vocabulary when it is read), its
units begin.  Each distinct unit of a slice is encoded and aligned once, a
bounded cache remembers the common ones, and a text's groups and links are
gathered from its units'.  Texts with a unit whose tokens don't join to its
bytes are encoded and compared whole.

Corpus counts: how many documents hold an id pair linked.  Tasks add up their
documents' distinct pairs in bounded tables, Spark sums those.  The most
frequent pairs, as many levels of frequency as have ``FREQUENT`` rows at most,
are broadcast and answer most links inside the tasks; links of rarer pairs are
joined by pair, so no pair that many documents hold is ever shuffled.

Defined cases: a null or empty text, or one whose joined tokens differ from a
space and the text, has no tokens: counts are 0 and the groups are empty; the
strings of special tokens are plain text; rows that repeat each other count as
documents of their own; an empty table gives an empty result; other columns
are ignored; doc_ids are integers.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from jarledger.llm.common import process_store, settle, slices, table
from jarledger.llm.token_output import Tokens
from jarledger.llm.units import Units, crosses_nothing

MODEL_A = public_tokenizers.path("byte_bpe_50k.json")
MODEL_B = public_tokenizers.path("piece_bpe_32k.model")
SPACE_SIGN = "▁"
CACHE_UNITS = 250_000    # units a worker remembers, about 100 MB
CACHED_LENGTH = 48
SLICE = 2 << 20          # bytes of text aligned at a time
FREQUENT = 400_000       # id pairs that are broadcast at most, 17 bytes each
HELD = 1 << 20           # id pairs a task counts before it hands them on

DOCS = ("row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, pairs binary, times binary")
ENDS = ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def groups_between(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups ``(first a, end a, first b, end b)`` of tokens, whose ascending ends are given; both end alike."""
    done, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()
        low, high = (i + j - 1) // 2, (i + j - 1) // 2 + 1
        cut = None
        while low >= i or high < j - 1:  # interior ends of a, from the middle outwards
            for m in (low, high):
                if i <= m < j - 1:
                    at = bisect_left(b, a[m], k, l - 1)
                    if at < l - 1 and b[at] == a[m]:
                        cut = (m + 1, at + 1)
                        break
            if cut:
                break
            low, high = low - 1, high + 1
        if cut:
            todo += [(cut[0], j, cut[1], l), (i, cut[0], k, cut[1])]  # the left half is next
        else:
            done.append((i, j, k, l))
    return done


def links_in(a: list[int], b: list[int], group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Index pairs of a group's tokens whose byte ranges overlap."""
    i, j, k, l = group
    if j - i == 1 or l - k == 1:
        return [(x, y) for x in range(i, j) for y in range(k, l)]
    out, x, y = [], i, k
    while x < j and y < l:
        out.append((x, y))
        ends = a[x] - b[y]
        x, y = x + (ends <= 0), y + (ends >= 0)
    return out


class Aligner:
    """Aligned units, remembered: ``(groups as text, sizes, linked id pairs)``; sizes are n_a, n_b, n_groups and n_links."""

    def __init__(self, model_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokens = Tokens(model_a)
        store = process_store("aligned_" + hashlib.sha256(model_a.encode() + model_b).hexdigest()[:16]).__dict__
        if "pieces" not in store:
            pieces = sentencepiece.SentencePieceProcessor(model_proto=model_b)
            n = pieces.vocab_size()
            shown = [pieces.id_to_piece(i).replace(SPACE_SIGN, " ") for i in range(n)]
            store["bytes_b"] = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.encode() for i, p in enumerate(shown)]
            signs = {v: k for k, v in self.tokens.signs.items()}
            model = self.tokens.model
            store["bytes_a"] = [bytes(signs.get(ord(c), ord(c) & 255) for c in model.id_to_token(i) or "") for i in range(model.get_vocab_size())]
            # a unit that doesn't begin with a space is encoded behind a line feed, whose ids are then left out
            store["lead"] = pieces.encode("\n")
            store["by_unit"] = self.tokens.by_unit and crosses_nothing(p for i, p in enumerate(shown) if not pieces.is_byte(i))
            store["units"] = {}
            store["pieces"] = pieces
        self.pieces, self.lead, self.units, self.by_unit = store["pieces"], store["lead"], store["units"], store["by_unit"]
        self.bytes_a, self.bytes_b = store["bytes_a"], store["bytes_b"]

    def ids_b(self, units: list[bytes]) -> list[list[int]]:
        texts = [u.decode("utf-8") for u in units]
        spaced = [len(t) > 1 and t[0] == " " for t in texts]
        found = self.pieces.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced)], num_threads=1)
        n = len(self.lead)
        return [ids if s else ids[n:] if ids[:n] == self.lead else [] for ids, s in zip(found, spaced)]

    def aligned(self, text: bytes, ids_a: list[int], ids_b: list[int]):
        """The alignment of a piece of text; None if the tokens don't join to it."""
        parts_a, parts_b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(parts_a) != text or b"".join(parts_b) != text:
            return None
        if len(ids_a) == 1 or len(ids_b) == 1:
            groups = [(0, len(ids_a), 0, len(ids_b))]
            pairs = [a << 16 | b for a in ids_a for b in ids_b]
        else:
            a, b, at = [], [], 0
            for part in parts_a:
                a.append(at := at + len(part))
            at = 0
            for part in parts_b:
                b.append(at := at + len(part))
            groups = groups_between(a, b)
            pairs = [ids_a[x] << 16 | ids_b[y] for g in groups for x, y in links_in(a, b, g)]
        shown = ";".join([",".join(map(str, ids_a[i:j])) + "|" + ",".join(map(str, ids_b[k:l])) for i, j, k, l in groups])
        return (shown.encode(), np.array([len(ids_a), len(ids_b), len(groups), len(pairs)], np.int64).tobytes(),
                np.array(pairs, np.uint32).tobytes())

    def of_units(self, distinct: list[bytes]) -> list:
        known = self.units
        out = [known.get(u, 0) for u in distinct]
        missing = [i for i, x in enumerate(out) if x == 0]
        for some in range(0, len(missing), 4096):
            part = missing[some: some + 4096]
            fresh = [distinct[i] for i in part]
            width = self.tokens.type
            for i, unit, raw, ids_b in zip(part, fresh, self.tokens.of_units(fresh), self.ids_b(fresh)):
                out[i] = self.aligned(unit, np.frombuffer(raw, width).tolist(), ids_b)
                if len(unit) <= CACHED_LENGTH and len(known) < CACHE_UNITS:
                    known[unit] = out[i]
        return out

    def whole(self, text: str):
        """The alignment of a space and a text, encoded whole."""
        ids_a = np.frombuffer(self.tokens.whole(" " + text), self.tokens.type).tolist()
        return self.aligned((" " + text).encode(), ids_a, self.pieces.encode(text))


NOTHING = (b"", np.zeros(4, np.int64).tobytes(), b"")


def align_slice(aligner: Aligner, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Each text's groups, its four sizes, its linked id pairs one text after another, and where these begin (and the end)."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    spaced = pc.if_else(pa.array(empty), pa.array([""] * n, texts.type), pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
    if aligner.by_unit:
        units = Units(spaced)
        found = aligner.of_units(units.distinct)
        broken = np.array([x is None for x in found], bool)
        found = [x or NOTHING for x in found]
        shown = [x[0] for x in found]
        at, codes = units.text_starts.tolist(), units.codes
        joined = [b";".join([shown[c] for c in codes[a:b].tolist()]) for a, b in zip(at, at[1:])]
        sizes = np.frombuffer(b"".join([x[1] for x in found]), np.int64).reshape(-1, 4)
        sizes = np.stack([units.sums(sizes[:, k]) for k in range(4)], 1)
        pairs, begins = units.gather([x[2] for x in found], np.uint32)
        again = np.flatnonzero(units.sums(broken.astype(np.int64))) if broken.any() else []
    else:
        joined, sizes, pairs, begins, again = [b""] * n, np.zeros((n, 4), np.int64), np.zeros(0, np.uint32), np.zeros(n + 1, np.int64), np.flatnonzero(~empty)
    if len(again):
        parts = [pairs[a:b] for a, b in zip(begins, begins[1:])]
        for i in again.tolist():
            joined[i], size, raw = aligner.whole(texts[i].as_py()) or NOTHING
            sizes[i], parts[i] = np.frombuffer(size, np.int64), np.frombuffer(raw, np.uint32)
        pairs, begins = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return joined, sizes, pairs, begins


def tallied(pairs: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each text, ascending, how often each occurs, and where each text's begin (and the end)."""
    text = np.repeat(np.arange(len(begins) - 1, dtype=np.uint64), np.diff(begins))
    keys, times = np.unique(text << np.uint64(32) | pairs, return_counts=True)
    ends = np.searchsorted(keys, np.arange(len(begins), dtype=np.uint64) << np.uint64(32))
    return keys.astype(np.uint32), times.astype(np.uint32), ends


def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each stretch of an array."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [
        None, pa.py_buffer((ends * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def align_texts(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, groups: bool = True) -> DataFrame:
    """``(row_id, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``, and with ``groups`` the groups as text.

    ``pairs`` has a text's distinct linked id pairs, A's id in the upper 16 bits
    of 32, little-endian; ``times`` how often each is linked.
    """
    with open(model_a, encoding="utf-8") as f, open(model_b, "rb") as g:
        models = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two vocabularies

    def run(batches):
        aligner, first = Aligner(*models.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, most=SLICE):
                joined, sizes, pairs, begins = align_slice(aligner, part["text"])
                kept, times, ends = tallied(pairs, begins)
                n = len(joined)
                out = [pa.array(np.arange(first, first + n)), part["doc_id"], *(pa.array(sizes[:, k]) for k in range(4)),
                       pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in joined]), blobs(kept, ends), blobs(times, ends)]
                names = [*ENDS, "pairs", "times"]
                if groups:
                    out, names = [*out, pa.array([x.decode() for x in joined])], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(out, names)
                first += n

    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return some.mapInArrow(run, DOCS + (", groups string" if groups else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, count, best)``: documents that hold a pair, and whether that is its A id's highest count."""
    def run(batches):
        pairs, counts, size = [], [], 0

        def summed():
            keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)

        def out(keys, held):
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(held)], ["pair", "n"])

        for batch in batches:
            joined = np.frombuffer(b"".join(x for x in batch["pairs"].to_pylist()), np.uint32)
            keys, held = np.unique(joined, return_counts=True)
            pairs.append(keys)
            counts.append(held)
            size += len(keys)
            if size > HELD:
                keys, held = summed()
                pairs, counts, size = [keys], [held], len(keys)
                if size > HELD // 2:
                    yield out(keys, held)
                    pairs, counts, size = [], [], 0
        if size:
            yield out(*summed())

    summed = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    own = Window.partitionBy(F.shiftright("pair", 16))  # B's vocabulary at most
    return settle(summed.select("pair", "count", (F.col("count") == F.max("count").over(own)).alias("best")), "pair_counts")


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> tuple[DataFrame, DataFrame | None]:
    """The counts split in two: levels of frequency from the top with ``most`` rows at most, and the rest (None: nothing)."""
    level = F.floor(F.log2("count")).cast("int")
    rows, least = 0, 0
    for found in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 63 rows at most
        rows += found["count"]
        if rows > most:
            least = 1 << found["level"] + 1
            break
    return counts.where(F.col("count") >= least), counts.where(F.col("count") < least) if least else None


def scored(aligned: DataFrame, counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """``aligned`` without pairs and times, with ``n_best`` and ``count_sum``; it must be written down, as row_ids are joined."""
    frequent, rare = frequent_pairs(counts, most)
    held = frequent.orderBy("pair").toArrow()  # ``most`` rows at most
    shared = aligned.sparkSession.sparkContext.broadcast((
        held["pair"].to_numpy().astype(np.uint32), held["count"].to_numpy(), held["best"].to_numpy().astype(np.int64)))

    def run(batches):
        pair, count, best = shared.value
        count, best = np.append(count, 0), np.append(best, 0)
        for whole in batches:
            for part in slices(whole, column="pairs", most=SLICE):
                raw = part["pairs"].to_pylist()
                ends = np.cumsum([0] + [len(x) // 4 for x in raw])
                pairs, times = np.frombuffer(b"".join(raw), np.uint32), np.frombuffer(b"".join(part["times"].to_pylist()), np.uint32).astype(np.int64)
                at = np.searchsorted(pair, pairs)
                if len(pair):
                    at[pair[np.minimum(at, len(pair) - 1)] != pairs] = len(pair)
                sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[at])))[ends]) for x in (best, count)]
                lost = at == len(pair)
                left = np.concatenate(([0], np.cumsum(lost)))[ends].astype(np.int32)
                keep = [c for c, f in enumerate(part.schema.names) if f not in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *map(pa.array, sums),
                     pa.ListArray.from_arrays(pa.array(left), pa.array(pairs[lost].astype(np.int64))),
                     pa.ListArray.from_arrays(pa.array(left), pa.array(times[lost]))],
                    [*(part.schema.names[c] for c in keep), "n_best", "count_sum", "rare", "rare_times"])

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name not in ("pairs", "times")]
    found = aligned.mapInArrow(run, ", ".join([*columns, "n_best long", "count_sum long", "rare array<long>", "rare_times array<long>"]))
    if rare is None:
        return found.drop("rare", "rare_times")
    found = settle(found, "alignment_scores")
    links = (found.where(F.size("rare") > 0).select("row_id", F.explode(F.arrays_zip("rare", "rare_times")).alias("x"))
             .select("row_id", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("n")))
    more = (links.join(rare, "pair").groupBy("row_id")
            .agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum")))
    return (found.drop("rare", "rare_times").join(more, "row_id", "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                          "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum"))


def alignment(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, groups: bool = True, most: int = FREQUENT) -> DataFrame:
    """One row for each of ``docs``: its alignment, and its links scored by the corpus counts."""
    aligned = settle(align_texts(docs, model_a, model_b, groups), "alignment")
    return scored(aligned, pair_counts(aligned), most)


def op11_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), groups=False).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
