"""Merkle dataset manifest with incremental witnesses (operator 13).

A row's leaf is the SHA-256 of its fields, each as its byte count, ``:`` and
its value (``-`` for null).  In each source the leaves ascend by doc_id; every
``WIDTH`` consecutive nodes become the digest of their digests, until one node
is left, the subroot; the subroots, by source, become the root likewise.

Witnesses are built while nodes are appended.  An :class:`Appender` keeps one
open run a level.  The run's buffer is the partial witness of all nodes in it:
a node that joins finds its left siblings there, and each sibling completed
later extends the witness of every node before it, once for all of them.
Spark deals the leaves into aligned blocks of ``WIDTH ** HEIGHT`` positions, a
task appends one block after the other, and the block roots are the next
round's appends, over blocks of their own, until each tree has one block.  The
finished witnesses then go down again, a round at a time: what a block's root
still lacked is extended by the path of the block above.  A block's row holds
its runs, so inner digests are made once.

:func:`append` adds documents behind those of a manifest: complete blocks stay
as they are, only each source's last, open block takes up its leaves again.

Skew: positions come from range partitions of (source, doc_id, leaf) and the
row counts of their pieces, so a hot source is spread over many tasks; a
block, the largest thing a task holds, has 256 leaves.  A driver sees one
number a round.

Defined cases: a null field is ``-`` (a null source is a source of its own,
the first); null doc_ids come first and are never tampered with; equal
doc_ids follow each other by leaf, so repeated rows are neighbours and each
has its own witness; an empty text has byte count 0; an empty table gives an
empty result and a manifest without a root; other columns are ignored;
doc_ids are integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jarledger.llm.common import ascii_lower, placed, settle, table

WIDTH, HEIGHT = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32  # bytes

BLOCK = ("tree string, block long, n long, size int, root binary, runs array<binary>, "
         "doc_ids array<long>, altered array<binary>")
PATH = "tree string, pos long, path array<binary>, at array<int>"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """The 32-byte digest of a row; ``replaced`` gives other expressions for some fields."""
    parts = [field(replaced.get(name, F.col(name))) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def node_digest(run: bytes) -> bytes:
    """The digest of a run of digests, which are hashed as hex text."""
    return hashlib.sha256(run.hex().encode()).digest()


class Appender:
    """One block's tree as it grows: an open run a level, and the runs that are complete."""

    def __init__(self, width: int = WIDTH):
        self.full = width * DIGEST
        self.open: list[bytearray] = [bytearray()]
        self.runs: list[list[bytes]] = []

    def append(self, digest: bytes, level: int = 0) -> None:
        """The next node of a level: it joins the open run, whose earlier nodes get it as a sibling."""
        if level == len(self.open):
            self.open.append(bytearray())
        run = self.open[level]
        run += digest
        if len(run) == self.full:
            self.complete(level)

    def complete(self, level: int) -> None:
        """The level's open run becomes a node of the next level; its witnesses wait for that one's siblings."""
        run = bytes(self.open[level])
        self.open[level].clear()
        while len(self.runs) <= level:
            self.runs.append([])
        self.runs[level].append(run)
        self.append(node_digest(run), level + 1)

    def finish(self, levels: int) -> tuple[bytes, list[bytes]]:
        """Complete what is open below ``levels``; the root, and all runs from the lowest level up."""
        for level in range(levels):
            if self.open[level]:
                self.complete(level)
        return bytes(self.open[levels]), [run for some in self.runs[:levels] for run in some]


def levels_of(nodes: int, width: int = WIDTH) -> int:
    """Levels between so many nodes and their root."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // width), levels + 1
    return levels


def block_levels(n: int, width: int, height: int) -> int:
    """Levels of a block in a tree of ``n`` nodes: only a tree's sole block ends at its root."""
    return height if n > width ** height else levels_of(n, width)


def leaves(docs: DataFrame, salt: int = 5) -> DataFrame:
    """``(tree, doc_id, leaf, altered)``; altered is the leaf of the tampered row, for each ``salt``-th id."""
    source = F.col("source").cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % salt == 0
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("tree"), F.col("doc_id").cast("long"),
        leaf_digest().alias("leaf"), F.when(tampered, leaf_digest(text=ascii_lower(text))).alias("altered"))


def blocks(nodes: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """A row for each aligned block of ``nodes`` ``(tree, n, pos, leaf, doc_id, altered)``."""
    def run(batches):
        now, grown, ids, altered = None, None, [], []

        def close():
            tree, block, n = now
            root, runs = grown.finish(block_levels(n, width, height))
            return pa.RecordBatch.from_pylist(
                [{"tree": tree, "block": block, "n": n, "size": len(ids), "root": root, "runs": runs,
                  "doc_ids": ids, "altered": altered}], schema=kind)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("tree", "block", "n", "leaf", "doc_id", "altered")]
            for tree, block, n, leaf, doc_id, other in zip(*columns):
                if now != (tree, block, n):
                    if now:
                        yield close()
                    now, grown, ids, altered = (tree, block, n), Appender(width), [], []
                grown.append(leaf)
                ids.append(doc_id)
                altered.append(other)
        if now:
            yield close()

    kind = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("root", pa.binary()),
                      ("runs", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("altered", pa.list_(pa.binary()))])
    dealt = (nodes.withColumn("block", F.floor(F.col("pos") / F.lit(width ** height)).cast("long"))
             .select("tree", "block", "n", "pos", "leaf", "doc_id", "altered")
             .repartition("tree", "block").sortWithinPartitions("tree", "block", "pos"))
    return settle(dealt.mapInArrow(run, BLOCK), "merkle_blocks")


def upper_nodes(made: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """The block roots as the next round's nodes."""
    return made.select("tree", F.ceil(F.col("n") / F.lit(width ** height)).cast("long").alias("n"), F.col("block").alias("pos"),
                       F.col("root").alias("leaf"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))


def grow(first: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> list[DataFrame]:
    """The rounds above a round of blocks (itself included): the last has one block for each tree."""
    rounds = [first]
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:
        rounds.append(blocks(upper_nodes(rounds[-1], width, height), width, height))
    return rounds


def own_path(index: int, size: int, levels: int, width: int) -> list[tuple[int, int]]:
    """For each level of a block of ``size`` nodes: the number of the run that holds node ``index``, and its place there."""
    path, skipped = [], 0
    for _ in range(levels):
        path.append((skipped + index // width, index % width))
        size = -(-size // width)
        skipped, index = skipped + size, index // width
    return path


def above(made: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Blocks beside the witnesses of their roots (empty where the root is the top)."""
    if paths is None:
        return made.withColumns({"path": F.array().cast("array<binary>"), "at": F.array().cast("array<int>")})
    return made.join(paths.withColumnRenamed("pos", "block"), ["tree", "block"])


def descend(rounds: list[DataFrame], paths: DataFrame | None, width: int = WIDTH, height: int = HEIGHT) -> DataFrame | None:
    """Extend witnesses from the last round's block roots down to the nodes of its second round: those of the first round's blocks."""
    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                levels = block_levels(b["n"], width, height)
                steps = [own_path(i, b["size"], levels, width) for i in range(b["size"])]
                first = b["block"] * width ** height
                yield pa.RecordBatch.from_arrays([
                    pa.array([b["tree"]] * b["size"]), pa.array(range(first, first + b["size"]), pa.int64()),
                    pa.array([[b["runs"][r] for r, _ in s] + b["path"] for s in steps], pa.list_(pa.binary())),
                    pa.array([[at for _, at in s] + b["at"] for s in steps], pa.list_(pa.int32()))], ["tree", "pos", "path", "at"])

    for made in reversed(rounds[1:]):
        paths = settle(above(made, paths).mapInArrow(run, PATH), "merkle_paths")
    return paths


@dataclass
class Manifest:
    """Rounds of blocks over the leaves, rounds over the subroots, and which source a subroot is of."""

    rounds: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame

    def root(self) -> str | None:
        row = self.top[-1].select(F.lower(F.hex("root"))).first()
        return row[0] if row else None


def crowned(rounds: list[DataFrame], width: int, height: int) -> Manifest:
    """Subroots, by source, as the nodes of one more tree."""
    ends = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    subroots = settle(placed(ends, "tree", F.col("name")), "merkle_subroots")
    nodes = subroots.select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
    return Manifest(rounds, grow(blocks(nodes, width, height), width, height), subroots)


def build(docs: DataFrame, width: int = WIDTH, height: int = HEIGHT, salt: int = 5) -> Manifest:
    """The manifest of a table."""
    nodes = placed(leaves(docs, salt), "tree", F.col("doc_id").asc_nulls_first(), F.col("leaf"))
    return crowned(grow(blocks(nodes, width, height), width, height), width, height)


def append(manifest: Manifest, docs: DataFrame, width: int = WIDTH, height: int = HEIGHT, salt: int = 5) -> Manifest:
    """The manifest with ``docs`` behind the leaves of their sources; complete blocks are not read into trees again.

    Refuses a document whose doc_id is below (or null after) its source's last one: that would be an insertion.
    """
    full, old = width ** height, manifest.rounds[0]
    ends = old.groupBy("tree").agg(F.max("n").alias("had"), F.max(F.array_max("doc_ids")).alias("last"))
    new = placed(leaves(docs, salt), "tree", F.col("doc_id").asc_nulls_first(), F.col("leaf"))
    joined = settle(new.join(ends, "tree", "left"), "merkle_appended")
    if not joined.where("had is not null and (doc_id is null or doc_id <= last)").isEmpty():
        raise ValueError("an appended doc_id is not behind its source's last one")
    moved = joined.select("tree", (F.col("pos") + F.coalesce("had", F.lit(0))).alias("pos"), "leaf", "doc_id", "altered")
    # the leaves of an open block are its lowest runs, joined
    low = F.ceil(F.col("size") / width).cast("int")
    held = F.aggregate(F.slice("runs", F.lit(1), low), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    held = F.when(F.col("n") == 1, F.col("root")).otherwise(held)
    again = old.where(F.col("size") < full).select("tree", "block", held.alias("held"), F.posexplode(F.arrays_zip("doc_ids", "altered")).alias("i", "m"))
    again = again.select("tree", (F.col("block") * full + F.col("i")).alias("pos"), F.substring("held", F.col("i") * DIGEST + 1, F.lit(DIGEST)).alias("leaf"),
                         F.col("m.doc_ids").alias("doc_id"), F.col("m.altered").alias("altered"))
    totals = (ends.select("tree", F.col("had").alias("rows")).unionByName(moved.groupBy("tree").agg(F.count("*").alias("rows")))
              .groupBy("tree").agg(F.sum("rows").alias("n")))
    fresh = blocks(again.unionByName(moved).join(totals, "tree"), width, height)
    kept = old.where(F.col("size") == full).drop("n").join(totals, "tree")
    first = settle(kept.unionByName(fresh, allowMissingColumns=False), "merkle_blocks")
    return crowned(grow(first, width, height), width, height)


def fold(digest: bytes, path: list[bytes], at: list[int]) -> bytes:
    """The root that a leaf digest and its witness give."""
    for run, i in zip(path, at):
        digest = node_digest(run[: i * DIGEST] + digest + run[(i + 1) * DIGEST:])
    return digest


def siblings(path: list[str], at: list[int]) -> str:
    """A witness's siblings in hex, from the lowest level up."""
    size = 2 * DIGEST
    return "".join(run[: i * size] + run[(i + 1) * size:] for run, i in zip(path, at))


def proofs(manifest: Manifest, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, folded_root)`` of every row; all but doc_id are bytes or hex text of bytes."""
    rounds = manifest.rounds
    paths = descend([None, *manifest.top], None, width, height)
    named = (manifest.subroots.select("pos", F.col("name").alias("tree"), F.col("leaf").alias("subroot"))
             .join(paths.select("pos", "path", "at"), "pos").select("tree", F.lit(0).cast("long").alias("pos"), "path", "at", "subroot"))
    named = settle(named, "merkle_subroot_paths")
    down = descend(rounds, named.drop("subroot"), width, height)
    top = manifest.root()
    fat = above(rounds[0], down).join(named.select("tree", "subroot"), "tree")

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                levels, size = block_levels(b["n"], width, height), b["size"]
                hexed, path = [r.hex() for r in b["runs"]], [r.hex() for r in b["path"]]
                out, tail, folded = [], None, []
                held = []
                for i in range(size):
                    steps = own_path(i, size, levels, width)
                    places = [at for _, at in steps] + b["at"]
                    if tail is None or i % width == 0 or not levels:  # the same for a whole run
                        tail = siblings([hexed[r] for r, _ in steps[1:]] + path, places[1:] if levels else places)
                        runs = [b["runs"][r] for r, _ in steps] + b["path"]
                    low = siblings([hexed[steps[0][0]]], places) if levels else ""
                    leaf = b["runs"][steps[0][0]][places[0] * DIGEST: (places[0] + 1) * DIGEST] if levels else b["root"]
                    held.append(leaf.hex())
                    out.append(hashlib.sha256((low + tail).encode()).hexdigest())
                    folded.append(fold(b["altered"][i] or leaf, runs, places).hex())
                yield pa.RecordBatch.from_arrays([
                    pa.array(b["doc_ids"], pa.int64()), pa.array(held), pa.array([b["subroot"].hex()] * size), pa.array([top] * size),
                    pa.array(out), pa.array(folded)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return fat.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found = proofs(build(table(spark, sf_dir, "documents")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
