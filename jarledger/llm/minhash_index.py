"""MinHash near-duplicate groups by a multi-index Hamming join (operator 12).

A text's set holds its distinct ``shingle``-word shingles (A-Z lower-cased,
words end at ASCII white space; fewer words: the whole sequence).  Its
signature is ``MINIMA`` minima, ``BITS`` bits of each.  The distance
of two signatures is the number of minima that differ.

Multi-index join: the first ``chunks * symbols`` minima are split in chunks.
By pigeonhole, signatures at most ``distance`` apart there differ
in at most ``errors`` minima of some chunk.  Every choice of that many minima
of a chunk to leave out is enumerated and the others are a key, so all such
pairs share a cell of equal key.  At the default, 14 of 30 with two errors in
each of five chunks, a pair of similarity 0.8 is in no common cell with
probability 1e-5, one of 0.85 with 1e-7.  Of a cell's pairs those are
confirmed on the full sets whose whole signatures differ in at most ``LOOSE`` minima
(a pair of 0.8 in more with 4e-6, one of 0.4 in so few with 6e-3) and whose set
sizes allow the threshold.

Links are needed as far as they join groups, so cells are joined in two steps.
First each member of a cell meets the cell's hub, the member that is in most
cells; confirmed links make groups.  Then only cells that still hold two groups
are joined, and only members of different groups meet.  In cells of up to
``SMALL`` members pairs are made one by one, each in the first of its common
cells.  Larger cells are joined by blocks: texts lie in blocks, in the order of
their largest cell, so a cell's members lie in few blocks, and each two blocks
that meet in such a cell are compared in one task, which hands on only links
that join something, never a list of pairs.  Sets are compared whole, shingle
by shingle; a text is sent to the blocks its own has to meet, not to each partner.

Skew: equal word sequences are one row from the start.  Cells that have one
member go in one pass over range partitions, which split a hot cell; the others
are joined where Spark can split them; what grows with the
square of a group that doesn't hang together is the number of its block pairs,
``BLOCK ** 2`` texts' pairs each.  Sides that grow with the corpus are never
broadcast.  Groups are found by star contraction.  Nothing is capped;
the driver gets a bitmap of bounded size that says which texts may be needed,
so the others are never shuffled.

Defined cases: a null, empty or blank text has an empty set and is linked with
nothing, not even its like; repeated rows are one another's copies and give repeated result rows; a null
doc_id takes part but names no group (component_id is null if no member has an
id, and the row is kept); an empty table gives an empty result; other columns
are ignored by :func:`near_groups` and kept by :func:`keep_one`; doc_ids are
integers.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from jarledger.llm.common import apply_decisions, ascii_lower, byte_view, components, placed, settle, slices, table
from jarledger.llm.decontam import LOWER, MIX, fingerprint_bitmap, scramble, word_hashes, words_of

SHINGLE, PER_CENT = 2, 80
CHUNKS, SYMBOLS, BITS, DISTANCE = 5, 6, 16, 14
MINIMA, LOOSE = 64, 28      # of a whole signature, and how many may differ in a pair that is confirmed on its sets
SMALL = 32       # members of a cell whose pairs are made one by one
BLOCK = 256      # texts that lie together; two blocks meet in one task
SLICE = 2 << 20
SEED = 12
IS_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])


def shingles(words: list[bytes], size: int = SHINGLE) -> set:
    """The distinct shingles of a word sequence."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(texts: pa.Array, size: int = SHINGLE, symbols: int = MINIMA) -> np.ndarray:
    """A row of 16-bit minima for each text (zeros for a text without words)."""
    buf, offsets = byte_view(texts)
    buf = LOWER[buf]
    begins, ends, first = words_of(buf, offsets[:-1], IS_WORD)
    first = np.append(first, len(begins))
    hashes, count = word_hashes(buf, begins, ends), np.diff(first)
    text_of = np.repeat(np.arange(len(count)), count)
    stop, length = first[1:][text_of], np.minimum(count, size)[text_of]
    at = np.flatnonzero(np.arange(len(hashes)) + length <= stop)  # where a shingle begins
    grams = np.zeros(len(at), np.uint64)
    for i in range(size):
        more = length[at] > i
        grams[more] = grams[more] * MIX + hashes[at[more] + i]
    grams = scramble(grams + length[at].astype(np.uint64))
    out = np.zeros((len(count), symbols), np.uint16)
    some = np.flatnonzero(count)
    if len(some):
        starts = np.searchsorted(text_of[at], some)
        for i, (a, b) in enumerate(zip(*coefficients(symbols))):
            least = np.minimum.reduceat(grams * a + b, starts)
            out[some, i] = (scramble(least) >> np.uint64(20)).astype(np.uint16)
    return out


def chunk_errors(distance: int, chunks: int) -> list[int]:
    """Errors allowed in each chunk so that no pair within ``distance`` exceeds all of them."""
    base, more = divmod(distance + 1, chunks)
    return [base - 1 + (i < more) for i in range(chunks)]


class Index:
    """The keys of signatures, and which key of a pair is its first common one."""

    def __init__(self, chunks: int = CHUNKS, symbols: int = SYMBOLS, distance: int = DISTANCE):
        self.chunks, self.symbols = chunks, symbols
        self.choices = [(c, some) for c, e in enumerate(chunk_errors(distance, chunks)) if e >= 0
                        for some in combinations(range(symbols), max(symbols - e, 0))]
        if len(self.choices) > 128:
            raise ValueError("at most 128 keys a signature")
        # for each chunk and set of agreeing minima, the first key that lies in it
        self.first = np.full((chunks, 1 << symbols), len(self.choices), np.int64)
        agree = np.arange(1 << symbols)
        for i, (c, some) in reversed(list(enumerate(self.choices))):
            need = sum(1 << s for s in some)
            self.first[c, agree & need == need] = i

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """A row of keys for each signature; the low seven bits say which minima a key is made of."""
        wide = rows.astype(np.uint64)
        out = np.empty((len(rows), len(self.choices)), np.uint64)
        for i, (c, some) in enumerate(self.choices):
            key = np.full(len(rows), i + 1, np.uint64)
            for s in some:
                key = scramble(key * MIX + wide[:, c * self.symbols + s])
            out[:, i] = key & ~np.uint64(127) | np.uint64(i)
        return out

    def first_common(self, equal: np.ndarray) -> np.ndarray:
        """For each row of agreements of two signatures, their first common key."""
        masks = equal[:, : self.chunks * self.symbols].reshape(len(equal), self.chunks, self.symbols) @ (1 << np.arange(self.symbols))
        return self.first[np.arange(self.chunks), masks].min(axis=1)


def read_texts(docs: DataFrame, shingle: int = SHINGLE, minima: int = MINIMA) -> DataFrame:
    """``(row_id, doc_id, n_shingles, digest, sig, words)``: words are the lower-cased sequence, packed; digest is its SHA-256."""
    def run(batches):
        packer, first = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, most=SLICE):
                sigs, sizes, digests, packed = signatures(part["text"], shingle, minima), [], [], []
                for text in part["text"].cast(pa.binary()).to_pylist():
                    words = (text or b"").lower().split()
                    sizes.append(len(shingles(words, shingle)))
                    joined = b" ".join(words)
                    digests.append(hashlib.sha256(joined).digest())
                    packed.append(packer.compress(joined))
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + n)), part["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array(packed, pa.binary())],
                    ["row_id", "doc_id", "n_shingles", "digest", "sig", "words"])
                first += n

    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return some.mapInArrow(run, "row_id long, doc_id long, n_shingles long, digest binary, sig binary, words binary")


def sig_rows(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)


def grows(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus: joined by shuffle at every size, never broadcast."""
    return side.hint("merge")


def cells_of(nodes: DataFrame, index: Index) -> DataFrame:
    """``(key, node)`` for every key of every signature."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                keys = index.keys(sig_rows(part["sig"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part["node"].to_numpy(), keys.shape[1]))], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def shared_cells(cells: DataFrame) -> DataFrame:
    """The rows of keys that several nodes have.

    Range partitions of (key, node) are read in order, so a key is dealt to as
    many tasks as its rows need, and a task holds one batch.  A partition's first and last keys may go on in
    its neighbours; they are handed on whether or not they do.
    """
    def run(batches):
        held, started = None, False     # the last row so far, and whether it has been handed on

        def out(keys, nodes):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], ["key", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
            if held is not None:
                keys, nodes = np.concatenate((held[0], keys)), np.concatenate((held[1], nodes))
            same = keys[1:] == keys[:-1]
            several = np.append(False, same) | np.append(same, False)
            if not started:             # the first key may have begun before
                several[:-1] |= keys[:-1] == keys[0]
                started = True
            keep = several.copy()       # a last row that is alone waits: the next batch says whether it is
            if held is not None and held[2]:
                keep[0] = False
            yield out(keys[keep], nodes[keep])
            held = keys[-1:].copy(), nodes[-1:].copy(), bool(several[-1])
        if held is not None and not held[2]:
            yield out(held[0], held[1])

    return cells.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def allowed(n_a, n_b, per_cent: int):
    """Whether set sizes allow the similarity."""
    return 100 * np.minimum(n_a, n_b) >= per_cent * np.maximum(n_a, n_b)


def star_pairs(members: DataFrame, info: DataFrame, loose: int, per_cent: int) -> DataFrame:
    """Pairs ``(a, block_a, b, block_b)`` of cells' members with their hubs."""
    hubs = (members.join(grows(info.select("node", "degree")), "node").groupBy("key")
            .agg(F.max(F.struct("degree", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub")))
    pairs = (members.join(grows(hubs), "key").where("node <> hub")
             .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())

    def side(name):
        return grows(info.select(F.col("node").alias(name), F.col("block").alias(f"block_{name}"), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (sig_rows(batch["sig_a"]) != sig_rows(batch["sig_b"])).sum(1) <= loose
                near &= allowed(batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), per_cent)
                yield batch.select(["a", "block_a", "b", "block_b"]).filter(pa.array(near))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, block_a long, b long, block_b long")


class Sets:
    """Full sets of some texts as numbers: a shingle is a number among them."""

    def __init__(self, shingle: int):
        self.shingle, self.names, self.held, self.unpack = shingle, {}, {}, zstandard.ZstdDecompressor()

    def add(self, node: int, packed: bytes) -> None:
        some = shingles(self.unpack.decompress(packed).split(b" "), self.shingle)
        self.held[node] = np.fromiter((self.names.setdefault(s, len(self.names)) for s in some), np.int32, len(some))

    def near(self, node: int, others: list[int], per_cent: int) -> np.ndarray:
        """Which of ``others`` reach the similarity with ``node``."""
        flag = np.zeros(len(self.names), bool)
        flag[self.held[node]] = True
        same = np.array([np.count_nonzero(flag[self.held[o]]) for o in others])
        total = len(self.held[node]) + np.array([len(self.held[o]) for o in others]) - same
        return 100 * same >= per_cent * total


def block_links(rows: dict, crossed: bool, shingle: int, per_cent: int, loose: int) -> list[tuple[int, int]]:
    """Links that join groups, among the members of a block or between two; ``rows``: node, block, root, n, sig, words."""
    node, block, n, sig = rows["node"], rows["block"], rows["n"], rows["sig"]
    roots, label = np.unique(rows["root"], return_inverse=True)
    sets, out = Sets(shingle), []
    for x in range(len(node) - 1):
        y = slice(x + 1, None)
        fits = (label[y] != label[x]) & allowed(n[y], n[x], per_cent)
        if crossed:
            fits &= block[y] != block[x]
        at = np.flatnonzero(fits) + x + 1
        at = at[(sig[at] != sig[x]).sum(1) <= loose] if len(at) else at
        if not len(at):
            continue
        for i in (x, *at.tolist()):
            if int(node[i]) not in sets.held:
                sets.add(int(node[i]), rows["words"][i])
        for i in at[sets.near(int(node[x]), node[at].tolist(), per_cent)].tolist():
            if label[i] != label[x]:
                out.append((int(node[x]), int(node[i])))
                label[label == label[i]] = label[x]
    return out


def mixed_cells(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """``(key, node, block, rows)``: the members of cells that hold two groups, and how many members these have."""
    placed_ = members.join(grows(grouped.select("node", "root", "block")), "node")
    mixed = (placed_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
             .where("low <> high").select("key", "rows"))
    return settle(placed_.select("key", "node", "block").join(grows(mixed), "key"), "mixed_cells")


def small_pairs(cells: DataFrame, grouped: DataFrame, index: Index, loose: int, per_cent: int) -> DataFrame:
    """Pairs ``(a, block_a, b, block_b)`` of different groups within small cells, each in its first common cell."""
    def pairs_in(rows):
        out = []
        for lag in range(1, SMALL):
            i = np.flatnonzero(rows["key"][lag:] == rows["key"][:-lag]) if len(rows["key"]) > lag else []
            if not len(i):
                break
            j = i + lag
            fits = (rows["root"][i] != rows["root"][j]) & allowed(rows["n"][i], rows["n"][j], per_cent)
            i, j = i[fits], j[fits]
            equal = rows["sig"][i] == rows["sig"][j]
            near = np.flatnonzero((~equal).sum(1) <= loose)
            near = near[index.first_common(equal[near]) == (rows["key"][i[near]] & 127)]
            out.append((i[near], j[near]))
        i, j = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(rows[c][x]) for x in (i, j) for c in ("node", "block")], ["a", "block_a", "b", "block_b"])

    def run(batches):
        held = None     # rows of the last cell, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch[c].to_numpy() for c in ("key", "node", "block", "root", "n")} | {"sig": sig_rows(batch["sig"])}
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in rows}
            last = int(np.searchsorted(rows["key"], rows["key"][-1]))
            yield pairs_in({c: v[:last] for c, v in rows.items()})
            held = {c: v[last:].copy() for c, v in rows.items()}
        if held is not None:
            yield pairs_in(held)

    few = cells.where(F.col("rows") <= SMALL).select("key", "node").join(grows(grouped), "node")
    dealt = few.select("key", "node", "block", "root", "n", "sig").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, block_a long, b long, block_b long")


def block_pairs_links(cells: DataFrame, grouped: DataFrame, texts: DataFrame, shingle: int, per_cent: int, loose: int) -> DataFrame:
    """Links ``(a, b)`` between groups that share a large cell."""
    large = cells.where(F.col("rows") > SMALL)
    spans = settle(large.select("key", "block").distinct(), "large_cells")
    meet = (spans.withColumnRenamed("block", "one").join(spans.withColumnRenamed("block", "two"), "key")
            .where("one <= two").select("one", "two").distinct())
    needed = large.select("node").distinct()
    rows = settle(grouped.join(needed, "node").join(texts, "node"), "mixed_texts")
    sides = meet.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))

    def run(batches):
        names, held = ["one", "two", "node", "block", "root", "n"], None

        def links_of(group):
            found = block_links(group, bool(group["one"][0] != group["two"][0]), shingle, per_cent, loose)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            some = {c: batch[c].to_numpy() for c in names} | {"sig": sig_rows(batch["sig"]), "words": np.array(batch["words"].to_pylist(), object)}
            if held is not None:
                some = {c: np.concatenate((held[c], some[c])) for c in some}
            cuts = [0, *(np.flatnonzero((np.diff(some["one"]) != 0) | (np.diff(some["two"]) != 0)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield links_of({c: v[a:b] for c, v in some.items()})
            held = {c: v[cuts[-1]:].copy() for c, v in some.items()}
        if held is not None:
            yield links_of(held)

    dealt = sides.join(rows, "block").select("one", "two", "node", "block", "root", "n", "sig", "words")
    dealt = dealt.repartition("one", "two").sortWithinPartitions("one", "two", "node")
    return settle(dealt.mapInArrow(run, "a long, b long"), "minhash_links")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, per_cent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    pairs = settle(pairs.select("a", "b", F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")), "minhash_pairs")
    wanted = pairs.select("low", "high", F.explode(F.array("a", "b")).alias("node")).distinct()
    none = F.lit(None).cast("long")
    rows = (wanted.join(grows(texts), "node").select("low", "high", F.col("node").alias("a"), none.alias("b"), "words")
            .unionByName(pairs.withColumn("words", F.lit(None).cast("binary"))))

    def run(batches):
        now, sets = None, None
        for batch in batches:
            low, high, words = batch["low"].to_numpy(), batch["high"].to_numpy(), batch["words"]
            is_text = np.asarray(words.is_valid())
            new = np.flatnonzero((np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(is_text.astype(np.int8)) != 0)) + 1
            cuts = [0, *new.tolist(), batch.num_rows] if batch.num_rows else []
            for x, y in zip(cuts, cuts[1:]):
                if now != (low[x], high[x]):
                    now, sets = (low[x], high[x]), Sets(shingle)
                a = batch["a"].slice(x, y - x).to_numpy()
                if is_text[x]:  # they come before the pairs
                    for node, packed in zip(a.tolist(), words.slice(x, y - x).to_pylist()):
                        sets.add(node, packed)
                    continue
                b = batch["b"].slice(x, y - x).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
                linked = np.concatenate([sets.near(int(a[p]), b[p:q].tolist(), per_cent) for p, q in zip(edges, edges[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])

    dealt = rows.repartition("low", "high").sortWithinPartitions("low", "high", F.col("b").isNotNull(), "a", "b")
    return settle(dealt.mapInArrow(run, "a long, b long"), "minhash_links")


def texts_of(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, words)`` of some nodes; a bitmap of them, of bounded size, spares most of the other texts the shuffle."""
    bitmap = found.sparkSession.sparkContext.broadcast(np.packbits(fingerprint_bitmap(nodes.select(F.xxhash64("node").alias("fp"))), bitorder="little"))

    def run(batches):
        marks = bitmap.value
        mask = np.int64(8 * len(marks) - 1)
        for batch in batches:
            bit = batch["hash"].to_numpy() & mask
            yield batch.filter(pa.array((marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)).select(["node", "words"])

    maybe = found.select(F.col("row_id").alias("node"), F.xxhash64("row_id").alias("hash"), "words").mapInArrow(run, "node long, words binary")
    return settle(maybe.join(grows(nodes.select("node")), "node"), "minhash_texts")


def grouped_nodes(nodes: DataFrame, found: DataFrame, index: Index, shingle: int, per_cent: int, loose: int) -> DataFrame:
    """``(node, root)`` of all nodes that are linked, directly or through others."""
    cells = cells_of(nodes, index)
    members = settle(shared_cells(cells), "minhash_cells")
    sizes = members.groupBy("key").agg(F.count("*").alias("rows"))
    homes = members.join(grows(sizes), "key").groupBy("node").agg(F.max(F.struct("rows", "key"))["key"].alias("home"), F.count("*").alias("degree"))
    ordered = placed(homes.withColumn("all", F.lit(0)), "all", F.col("home"), F.col("node"), name="minhash_order")
    info = settle(ordered.select("node", "degree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).join(grows(nodes), "node"), "minhash_info")
    texts = texts_of(found, info)

    near = confirmed(star_pairs(members, info, loose, per_cent), texts, shingle, per_cent)
    first = settle(components(near), "minhash_groups")
    grouped = settle(info.select("node", "n", "sig", "block").join(grows(first), "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash_rooted")
    mixed = mixed_cells(members, grouped)
    more = confirmed(small_pairs(mixed, grouped, index, loose, per_cent), texts, shingle, per_cent).unionByName(
        block_pairs_links(mixed, grouped, texts, shingle, per_cent, loose))
    root = grouped.select("node", "root")
    merged = components(more.join(root.withColumnRenamed("root", "x"), more["a"] == root["node"]).select("x", "b")
                        .join(root.withColumnRenamed("root", "y"), F.col("b") == root["node"]).select("x", "y"), "x", "y")
    return root.join(merged.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT, chunks: int = CHUNKS, symbols: int = SYMBOLS,
                distance: int = DISTANCE, minima: int = MINIMA, loose: int = LOOSE) -> DataFrame:
    """``(doc_id, digest, n_shingles, component_id)`` for every row: the smallest doc_id reachable over links."""
    index = Index(chunks, symbols, distance)
    found = settle(read_texts(docs, shingle, minima), "minhash_texts_all")
    copies = found.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("row_id", "n_shingles", "sig")).alias("r"), F.min("doc_id").alias("least"))
    nodes = settle(copies.select(F.col("r.row_id").alias("node"), F.col("r.n_shingles").alias("n"), F.col("r.sig").alias("sig"), "digest", "least"), "minhash_nodes")
    linked = grouped_nodes(nodes.select("node", "n", "sig"), found, index, shingle, per_cent, loose)
    rooted = settle(nodes.select("node", "digest", "least").join(grows(linked), "node", "left")
                    .select("digest", "least", F.coalesce("root", "node").alias("root")), "minhash_roots")
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "minhash_least")
    named = settle(rooted.join(grows(least), "root").select("digest", "component_id"), "minhash_named")
    rows = found.select("doc_id", "digest", "n_shingles")
    return (rows.where("n_shingles > 0").join(grows(named), "digest").select("doc_id", "digest", "n_shingles", "component_id")
            .unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each group the row of the smallest doc_id stays, and every row without words; columns as they came."""
    found = near_groups(docs, **options).select(
        "doc_id", F.hex("digest").alias("key"), (F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)).alias("stays"))
    return apply_decisions(docs, sequence_digest(F.col("text")), found)


def sequence_digest(text: Column) -> Column:
    """The digest of a text's word sequence, as upper-case hex."""
    words = F.trim(F.regexp_replace(F.coalesce(ascii_lower(text.cast("string")), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.upper(F.sha2(words.cast("binary"), 256))


def op12_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
