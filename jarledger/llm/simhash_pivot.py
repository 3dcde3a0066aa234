"""SimHash near-duplicate groups, with pivot distance tables (operator 9).

Fingerprint: words are runs of anything but ASCII white space of the text
with A-Z lower-cased; shingles are ``shingle`` consecutive words joined by one
space, repeats included (fewer words: the whole sequence).  A fingerprint bit
is 1 if it is set in over half of the shingles' XXH64 values.  No words:
fingerprint zero.

Links: two fingerprints that differ in at most ``distance`` bits.  A pivot
table holds each fingerprint's Hamming distances to reference fingerprints; as
the distance is a metric, a pair whose coordinates differ by more than
``distance`` anywhere can't link and is discarded before it is verified.  That
test alone would compare all pairs, so the table is dealt into cells first: of
``distance + 2`` bit blocks at least two hold no differing bit, so linked
fingerprints share the cell of some two blocks, and every cell is joined with
itself through the pivot table only.

Skew: equal fingerprints are one row (copies never meet as pairs).  A cell
hands on one link per joined fingerprint, never its pairs, and holds at most
``cell_limit`` fingerprints in memory; larger cells are joined exactly through
shared variants instead (two fingerprints within 4 bits have a variant within
2 bits of both), which grows linearly.  Components are found by star
contraction, distributed.

Defined cases: a null text counts as empty; repeated rows give repeated
result rows; a null doc_id takes part but never names a component (null if
no member has an id); an empty table gives an empty result; other columns are
ignored by :func:`near_groups` and kept by :func:`keep_one`; doc_ids are integers.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jarledger.llm.common import apply_decisions, components, free_stores, settle, slices, table

SHINGLE, DISTANCE, SEED = 4, 4, 42
CELL_LIMIT = 4096
PIVOTS = 16
BITS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    begins, ends = begins[: len(words) - k + 1], ends[k - 1:]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), 1 << 16):  # bounds the unpacked bits of a long text
        some = zip(begins[at: at + (1 << 16)].tolist(), ends[at: at + (1 << 16)].tolist())
        h = np.fromiter((digest(joined[x:y], seed) for x, y in some), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begins), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, key, fp)``; key is a hash of the text, fp the fingerprint as a signed 64-bit integer."""
    def run(batches):
        free_stores()
        for whole in batches:
            for part in slices(whole):
                fps = np.array([fingerprint(t, shingle, seed) for t in part["text"].to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, key long, fp long")


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def block_masks(distance: int) -> list[int]:
    """For each two of ``distance + 2`` blocks of bits, the mask of both."""
    cuts = np.linspace(0, BITS, distance + 3).astype(int)
    block = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(block, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def make_pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random bit patterns."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def link_cells(cell: np.ndarray, fps: np.ndarray, distance: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(member, root)`` within runs of equal ``cell``: one for each member that joins a smaller position."""
    n = len(cell)
    label, near = np.arange(n), pivot_table(fps, pivots)
    size = np.diff(np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), n))
    last = np.repeat(np.cumsum(size), size)  # end of the run that a position is in
    active, lag = np.arange(n), 1
    while True:
        active = active[active + lag < last[active]]
        if not len(active):
            break
        i = active[label[active] != label[active + lag]]
        i = i[np.abs(near[i] - near[i + lag]).max(axis=1, initial=0) <= distance]
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= distance]
        if len(i):
            for x, y in zip(i.tolist(), (i + lag).tolist()):
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                label[max(x, y)] = min(x, y)
            while (label[label] != label).any():
                label = label[label]
        lag += 1
    member = np.flatnonzero(label != np.arange(n))
    return fps[member], fps[label[member]]


def links(fps: DataFrame, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT, pivots: int = PIVOTS) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints within ``distance`` bits, directly or through others."""
    masks, refs = block_masks(distance), make_pivots(pivots)
    cells = fps.select("fp").distinct().select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("combo", "bits"))

    def run(batches):
        """Cells arrive sorted; a cell may span batches, so its tail waits for the next one."""
        over, kept = None, None  # the cell that outgrew the limit; the rows of the last, maybe open cell

        def out(a, b, combo=None):
            kind = np.full(len(a), -1 if combo is None else combo, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(kind)],
                                              ["a", "b", "combo"])

        def close(combo, bits, fp):
            if len(fp):
                new = np.concatenate(([True], (combo[1:] != combo[:-1]) | (bits[1:] != bits[:-1])))
                yield out(*link_cells(np.cumsum(new), fp, distance, refs))

        for batch in batches:
            rows = [batch["combo"].to_numpy(), batch["bits"].to_numpy().view(np.uint64), batch["fp"].to_numpy().view(np.uint64)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            combo, bits, fp = rows
            if over is not None:  # the rest of an overgrown cell
                n = int(np.argmin(np.append((combo == over[0]) & (bits == over[1]), False)))
                if n:
                    yield out(fp[:n], bits[:n], over[0])
                combo, bits, fp = combo[n:], bits[n:], fp[n:]
                over = over if not len(fp) else None
            if not len(fp):
                kept = None
                continue
            new = np.flatnonzero(np.concatenate(([True], (combo[1:] != combo[:-1]) | (bits[1:] != bits[:-1]))))
            size = np.diff(np.append(new, len(fp)))
            large = np.repeat(size > cell_limit, size)
            tail = int(new[-1])
            for at in new[size > cell_limit]:
                sel = slice(int(at), int(at + size[np.searchsorted(new, at)]))
                yield out(fp[sel], bits[sel], combo[at])
            if large[tail]:
                over, kept = (combo[tail], bits[tail]), None
            else:
                kept = [combo[tail:], bits[tail:], fp[tail:]]
            done = np.flatnonzero(~large[:tail])
            yield from close(combo[done], bits[done], fp[done])
        if kept is not None:
            yield from close(*kept)

    found = settle(cells.repartition("combo", "bits").sortWithinPartitions("combo", "bits", "fp")
                   .mapInArrow(run, "a long, b long, combo int"), "simhash_links")
    near = found.where("combo < 0").select("a", "b")
    large = found.where("combo >= 0").select(F.col("a").alias("fp"), F.col("b").alias("bits"), "combo")
    if large.isEmpty():
        return near
    return near.unionByName(variant_links(large, masks, distance))


def variant_links(large: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Exact links of overgrown cells: members that share a variant within half the distance."""
    half = distance // 2

    def flips(mask: int) -> list[int]:
        free = [i for i in range(BITS) if not mask >> i & 1]
        return [signed(sum(1 << i for i in some)) for r in range(half + 1) for some in combinations(free, r)]

    table_of = F.element_at(F.array(*[F.array(*[F.lit(x) for x in flips(m)]) for m in masks]), F.col("combo") + 1)
    rows = large.select("fp", "combo", F.explode(table_of).alias("flip")).select(
        "fp", "combo", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    if distance % 2:  # an odd distance: one side may be a bit further away
        rows = rows.unionByName(rows.select("fp", "combo", F.explode(F.array(*[
            F.col("variant").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)])).alias("variant"))).distinct()
    least = rows.groupBy("combo", "variant").agg(F.min("fp").alias("b"))
    found = rows.join(least, ["combo", "variant"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED,
                cell_limit: int = CELL_LIMIT, pivots: int = PIVOTS) -> DataFrame:
    """``(doc_id, key, fp, component_id)``: the smallest doc_id reachable over links, for every row."""
    found = settle(fingerprints(docs, shingle, seed), "simhash_fp")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(distinct, distance, cell_limit, pivots))
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "key", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of every near-duplicate group stays, that of the smallest doc_id; columns as they came.

    In a group without any doc_id all different texts stay.
    """
    found = near_groups(docs, **options).select("doc_id", "key", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays"))
    return apply_decisions(docs, text_key(F.col("text")), found)


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
