"""Repeated byte windows by depth-limited radix sorting of suffixes (operator 5).

Suffixes are ordered only through ``window`` bytes, most significant digit
first, and only groups that hold more than one document go on to the next
digit.  The digits of a suffix are, in turn,

1. its anchor: the ``gram``-byte string with the smallest hash in its window
   (the rightmost of equals).  Equal windows have equal anchors at equal
   places, and about ``window - gram`` neighbouring suffixes share one anchor,
   so a digit is one record for all of them;
2. its context: the bytes from the first to the last window of that anchor's
   neighbours.  A group with a single context is decided: all its windows
   repeat, and the smallest document that has it is known;
3. the window itself, only in groups with several contexts.

Groups that are equal after the last digit are exactly the repeated windows;
each is reduced to its smallest document.  Digits are hashes of 48 bits (64 for
the window) and deal records out.  What decides is a context's 64-bit digest
together with its anchor's 48 bits, or a window's 64-bit digest together with
32 bits of its anchor's: bytes are taken for equal wrongly with 2^-64 for each
pair with a common anchor, and 2^-96 for each other pair (10^-9 for 10^10 open
windows in all).  ``digit_bits`` cuts the digits; the answer stays the same.

Texts are packed once into blocks of ``block_bytes``, a table bucketed by block
whose text no later pass shuffles.  In each pass a block asks: it sends its
digits, each once, in order, to the slot that owns their range, and the slot
answers with one value for each, in the same order.  So a digit that a third of all
documents hold is one record for each block, never one group of all of them.
Rows are at most as many as digits, and at least ``n / blocks`` digits share
one.

Defined cases: null is the empty text; texts below ``window`` bytes lose
nothing; documents with equal doc_ids are not smaller than each other; a null
doc_id is larger than any other; texts beyond ``PIECE`` bytes are handled in
pieces that overlap by a window; an empty table gives an empty result; other
columns are ignored; doc_ids are integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from jarledger.llm.common import byte_view, settle, table
from jarledger.session import shared_dir

WINDOW, GRAM = 50, 22
PIECE = 1 << 20             # bytes of text turned into arrays at a time
BLOCK_BYTES = 6 << 20       # text of a block; a longer text is a block by itself
BLOCKS_A_BUCKET, MOST_BUCKETS = 4, 50_000
NO_ID = (1 << 63) - 1
OPEN = -(1 << 63)           # answer: this context's group has others, ask window by window
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done: done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Piece:
    """Anchors and contexts of the windows in some bytes."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray, window: int, gram: int):
        """``ends``: for each byte, the end of its text."""
        n = len(buf)
        self.buf, self.up, self.down, self.window = buf, up, down, window
        self.add_up()
        starts = np.flatnonzero(np.arange(n) + window <= ends) if n else np.zeros(0, np.int64)
        self.anchor = self.first = self.last = self.run = np.zeros(0, np.int64)
        if not len(starts):
            return
        grams = self.digest(np.arange(n - gram + 1), gram)
        # the rightmost smallest of each window's grams, by doubling: spans of 1, 2, 4 .. and one that overlaps
        best, at, span, width = grams, np.arange(len(grams), dtype=np.int32), 1, window - gram + 1
        while span < width:
            step = min(span, width - span)
            right = best[step:] <= best[:-step]
            best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
            span += step
        anchor = at[starts]
        fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
        begin = np.flatnonzero(fresh)
        self.anchor = grams[anchor[begin]]                      # the first digit of each run of windows
        self.first = starts[begin]
        self.last = starts[np.append(begin[1:], len(starts)) - 1]   # its first and last window

    def add_up(self) -> None:
        """The running sums that digests are differences of; only one piece of a block holds them at a time."""
        n = len(self.buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def forget(self) -> None:
        self.sums = None

    def digest(self, at: np.ndarray, size) -> np.ndarray:
        """A hash of ``size`` bytes from each place."""
        return scramble((self.sums[at + size] - self.sums[at]) * self.down[at] + np.asarray(size).astype(np.uint64))

    def contexts(self) -> np.ndarray:
        return self.digest(self.first, self.last + self.window - self.first)

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """All windows of some runs: start, run, and digest."""
        size = self.last[some] - self.first[some] + 1
        run = np.repeat(some, size)
        start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + self.first[run]
        return start, run, self.digest(start, self.window)


class Block:
    """The runs of windows of a block's texts, and its questions."""

    def __init__(self, buf: np.ndarray, sizes: np.ndarray, docs: np.ndarray, window: int, gram: int, digit_bits: int = 48):
        self.buf, self.docs, cut = buf, docs, np.uint64(64 - digit_bits)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.window = window
        up, down = powers(BASE, PIECE + window), powers(INVERSE, PIECE + window + 1)
        self.pieces: list[tuple[Piece, int]] = []
        found, at = [], 0
        while at < len(buf):
            # whole texts up to PIECE bytes, or part of a longer one, which overlaps the next by a window
            row = int(np.searchsorted(self.offsets, at, side="right")) - 1
            stop = int(self.offsets[int(np.searchsorted(self.offsets, at + PIECE, side="right")) - 1])
            end = stop if stop > at else min(at + PIECE + window - 1, int(self.offsets[row + 1]))
            edges = np.minimum(self.offsets[1:][row:] - at, end - at)
            inside = np.diff(np.concatenate(([0], edges[: int(np.searchsorted(edges, end - at)) + 1])))
            piece = Piece(buf[at:end], np.repeat(edges[: len(inside)], inside), up, down, window, gram)
            n = len(piece.anchor)
            rows = np.searchsorted(self.offsets, at + piece.first, side="right") - 1
            found.append((piece.anchor >> cut, piece.contexts(), piece.anchor & np.uint64(0xFFFFFFFF), piece.first, piece.last, docs[rows],
                          np.full(n, len(self.pieces))) if n else None)
            piece.forget()
            self.pieces.append((piece, at))
            at = end if stop > at or end == self.offsets[row + 1] else end - window + 1
        found = [f for f in found if f]
        empty = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)]
        self.anchor, self.context, self.low_anchor, self.first, self.last, self.doc, self.piece = (
            [np.concatenate(x) for x in zip(*found)] if found else empty)

    def ask_anchors(self):
        """First pass: distinct anchors, and whether several documents of the block have it."""
        (digit,), low, high, self.which_anchor = distinct([self.anchor], self.doc)
        return digit, [(low != high).astype(np.uint64)]

    def hear_anchors(self, shared: np.ndarray) -> None:
        self.shared = np.flatnonzero(shared[self.which_anchor] > 0)

    def ask_contexts(self):
        """Second pass: distinct (anchor, context) of runs that share their anchor, with the smallest document."""
        some = self.shared
        (anchor, context), low, _, self.which_context = distinct([self.anchor[some], self.context[some]], self.doc[some])
        return anchor, [context, low.view(np.uint64)]

    def hear_contexts(self, first: np.ndarray) -> None:
        first = first.view(np.int64)[self.which_context]
        self.decided = self.shared[first != OPEN], first[first != OPEN]
        self.open = self.shared[first == OPEN]

    def windows(self):
        """Start, document, digest and part of the anchor of all windows of the open runs."""
        out = [], [], [], []
        for k, (piece, at) in enumerate(self.pieces):
            base = int(np.searchsorted(self.piece, k))
            some = self.open[self.piece[self.open] == k] - base
            if len(some):
                piece.add_up()
                start, run, digest = piece.windows(some)
                piece.forget()
                for x, y in zip(out, (start + at, self.doc[base + run], digest, self.low_anchor[base + run])):
                    x.append(y)
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.uint64, np.uint64)))

    def ask_windows(self):
        """Third pass: distinct windows of the open runs, with the smallest document."""
        self.start, self.owner, digest, anchor = self.windows()
        (digit, anchor), low, _, self.which_window = distinct([digest, anchor], self.owner)
        return digit, [anchor, low.view(np.uint64)]

    def hear_windows(self, first: np.ndarray) -> None:
        self.first_of_window = first.view(np.int64)[self.which_window]

    def removed(self) -> np.ndarray:
        """Which bytes go."""
        edge = np.zeros(len(self.buf) + 1, np.int32)
        runs, first = self.decided
        runs = runs[first < self.doc[runs]]
        base = np.array([at for _, at in self.pieces], np.int64)
        one = self.start[self.first_of_window < self.owner]
        for begin, end in ((base[self.piece[runs]] + self.first[runs], base[self.piece[runs]] + self.last[runs] + self.window),
                           (one, one + self.window)):
            edge += np.bincount(begin, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(end, minlength=len(edge)).astype(np.int32)
        return np.cumsum(edge[:-1]) > 0


def distinct(keys: list[np.ndarray], docs: np.ndarray):
    """Distinct keys in order, the smallest and largest document of each, and which of them each record is."""
    order = np.lexsort((docs, *reversed(keys)))
    sorted_, docs = [k[order] for k in keys], docs[order]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in sorted_:
        fresh[1:] |= k[1:] != k[:-1]
    new = np.flatnonzero(fresh)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return [k[new] for k in sorted_], docs[new], docs[np.append(new[1:], len(docs)) - 1] if len(new) else docs, which


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


def questions(block_id: int, digit: np.ndarray, columns: list[np.ndarray], slots: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """``(slot, block, payload)``: the ordered digits cut by range; differences and offsets, as these are small."""
    share = max(1, (1 << bits) // slots)
    slot = np.minimum(digit // np.uint64(share), np.uint64(slots - 1)).astype(np.int64) if slots > 1 else np.zeros(len(digit), np.int64)
    cuts = np.searchsorted(slot, np.arange(slots + 1)) if len(digit) > slots else None
    owners = np.flatnonzero(np.diff(cuts)) if cuts is not None else np.unique(slot)
    for s in owners.tolist():
        a, b = (cuts[s], cuts[s + 1]) if cuts is not None else np.searchsorted(slot, [s, s + 1])
        yield s, block_id, pack(np.diff(digit[a:b], prepend=np.uint64(0)), *[c[a:b] for c in columns])


def answers(group: pa.Table, columns: int, decide) -> pa.Table:
    """All questions of a slot answered: ``decide(digit, columns)`` gives a value for each record of the ordered whole."""
    parts = [unpack(p.as_py(), columns + 1) for p in group["payload"]]
    digit = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    value = decide(digit, [np.concatenate([p[i + 1] for p in parts]) for i in range(columns)])
    cuts = np.cumsum([0] + [len(p[0]) for p in parts])
    return pa.table({"block": group["block"], "slot": group["slot"], "payload": pa.array(
        [pack(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def decide_anchors(digit, columns):
    """1 if another block or another document of the block has the anchor."""
    _, which, count = np.unique(digit, return_inverse=True, return_counts=True)
    return ((count > 1) | (np.bincount(which, weights=columns[0].astype(float)) > 0)).astype(np.uint64)[which]


def decide_contexts(anchor, columns):
    """The smallest document with the anchor if all its contexts are the same one, else OPEN."""
    context, doc = columns[0], columns[1].view(np.int64)
    (owner, _), low, _, kind = distinct([anchor, context], doc)
    several = np.zeros(len(owner), bool)                  # of each distinct context: the anchor has another one
    several[1:] = owner[1:] == owner[:-1]
    several[:-1] |= several[1:]
    return np.where(several[kind], np.int64(OPEN), low[kind]).view(np.uint64)


def decide_windows(digit, columns):
    """The smallest document with the window."""
    _, low, _, which = distinct([digit, columns[0]], columns[1].view(np.int64))
    return low[which].view(np.uint64)


def pack_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``(block, docs, sizes, text)``: texts in blocks, a table bucketed by block in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        task, count, kept, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([task + count], pa.int64()), *(pa.array([b"".join(k[i] for k in kept)], pa.large_binary()).cast(pa.binary()) for i in range(3))],
                ["block", "docs", "sizes", "text"])

        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            buf, offsets = byte_view(batch["text"])
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes - size, side="right")) - 1)
                if kept and offsets[end] - offsets[at] + size > block_bytes:
                    end = at    # the next text doesn't fit
                else:
                    kept.append((ids[at:end].tobytes(), np.diff(offsets[at: end + 1]).tobytes(), buf[offsets[at]: offsets[end]].tobytes()))
                    size += int(offsets[end] - offsets[at])
                if size >= block_bytes or end == at or end < len(ids):
                    yield block()
                    count, kept, size = count + 1, [], 0
                at = end
        if kept:
            yield block()

    name = f"jarledger_blocks_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(1, total // (block_bytes * BLOCKS_A_BUCKET)))
    (texts.mapInArrow(run, "block long, docs binary, sizes binary, text binary").write.bucketBy(buckets, "block")
     .option("path", shared_dir(spark, "llm", "blocks")).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, digit_bits: int = 48,
            keep: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row, and with ``keep`` what is left, as bytes (``kept``)."""
    blocks = pack_blocks(docs, block_bytes)
    slots = max(1, blocks.count())
    asks = [("ask_anchors", "hear_anchors", digit_bits, 1, decide_anchors), ("ask_contexts", "hear_contexts", digit_bits, 2, decide_contexts),
            ("ask_windows", "hear_windows", 64, 2, decide_windows)]

    def opened(row, told: pa.Table | None, rounds: int) -> Block:
        """A block that has heard the answers of the first ``rounds`` passes."""
        docs_, sizes = (np.frombuffer(row[c].as_py(), np.int64) for c in ("docs", "sizes"))
        block = Block(np.frombuffer(row["text"].as_py(), np.uint8), sizes, docs_, window, gram, digit_bits)
        for k in range(rounds):
            n = len(getattr(block, asks[k][0])()[0])
            some = sorted((s, p) for r, s, p in zip(*(told[c].to_pylist() for c in ("round", "slot", "payload"))) if r == k) if n else []
            heard = np.concatenate([unpack(p, 1)[0] for _, p in some]) if some else np.zeros(0, np.uint64)
            getattr(block, asks[k][1])(heard)
        return block

    def asked(block: Block, k: int, block_id: int) -> pa.Table:
        digit, columns = getattr(block, asks[k][0])()
        rows = list(questions(block_id, digit, columns, slots, asks[k][2]))
        return pa.table({"slot": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()),
                         "payload": pa.array([r[2] for r in rows], pa.binary())})

    def rows_of(batch):
        for i in range(len(batch)):
            yield {c: batch[c][i] for c in ("block", "docs", "sizes", "text")}

    def steps(k: int):
        """The functions of pass ``k``."""
        def first(batches):
            for batch in batches:
                for row in rows_of(batch):
                    yield from asked(opened(row, None, 0), k, row["block"].as_py()).to_batches()

        def later(some, told):
            return pa.concat_tables([asked(opened(row, told, k), k, row["block"].as_py()) for row in rows_of(some)])

        return first, later, lambda group: answers(group, asks[k][3], asks[k][4])

    told, shape = None, "slot long, block long, payload binary"
    for k in range(len(asks)):
        first, later, answer = steps(k)
        posed = blocks.mapInArrow(first, shape) if told is None else blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(later, shape)
        heard = posed.groupBy("slot").applyInArrow(answer, "block long, slot long, payload binary").withColumn("round", F.lit(k))
        heard = settle(heard, f"answers_{k}")
        told = heard if told is None else told.unionByName(heard)

    def cut(some, told_):
        out = [pa.table({c: pa.array([], t) for c, t in kinds})]
        for row in rows_of(some):
            block = opened(row, told_, len(asks))
            gone = block.removed()
            n, lost, spans, kept = [], [], [], []
            for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
                o = gone[a:b]
                n.append(b - a)
                lost.append(int(o.sum()))
                spans.append(int((o[1:] & ~o[:-1]).sum() + o[0]) if b > a else 0)
                kept.append((block.buf[a:b][~o] if lost[-1] else block.buf[a:b]).tobytes())
            values = (block.docs, n, lost, spans, [hashlib.sha256(x).hexdigest() for x in kept], *[kept] * keep)
            out.append(pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds, values)}))
        return pa.concat_tables(out)

    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.binary())] * keep]
    done = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), keep=False)


def brute_force(rows: list[tuple[int, bytes]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The same for a few documents, window by window: ``doc_id: (n_bytes, n_removed, n_spans, kept_sha256)``."""
    first: dict[bytes, int] = {}
    for doc, text in rows:
        for i in range(len(text) - window + 1):
            w = text[i: i + window]
            first[w] = min(doc, first.get(w, doc))
    out = {}
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            if first[text[i: i + window]] < doc:
                gone[i: i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out[doc] = (len(text), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out
