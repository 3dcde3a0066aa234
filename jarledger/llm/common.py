"""Helpers the operators of this folder share."""

from __future__ import annotations

import contextlib
import contextvars
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jarledger.session import ensure_conf, shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text a task turns into arrays at a time; bounds its memory.
SLICE_BYTES = 2 << 20


#: Rows and bytes of a batch that a Python worker gets at most; both bound its memory only.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) != str(most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_conf(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PLACE = contextvars.ContextVar("place", default="llm")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is settled inside goes when the block ends; a result that is to stay is settled again outside, or ``keep``s."""
    name = f"llm-scratch-{uuid.uuid4().hex}"
    held = _PLACE.set(name)
    try:
        yield
    finally:
        _PLACE.reset(held)
        drop_folder(spark, shared_dir(spark, name).rsplit("/", 1)[0])


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, on whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again.

    Cuts the lineage at a point where several later steps start, so a lost
    executor costs a re-read of Parquet files every executor can see.  Within
    :func:`scratch` the files are its own, unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "llm" if keep else _PLACE.get(), name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, tree: str, *order: Column, name: str = "order") -> DataFrame:
    """``rows`` with ``pos``, a row's place in ``order`` among those of equal ``tree``, and ``n``, how many these are.

    Range partitions are counted and the counts added up, so a hot value is
    spread over as many tasks as its rows need.  ``order`` should be total.
    """
    ranged = rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
    kept = settle(ranged.select("*", F.monotonically_increasing_id().alias("mid")).withColumn("part", F.shiftright("mid", 33)), name)
    pieces = kept.groupBy(tree, "part").agg(F.min("mid").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy(tree)  # a row for each range partition the value is in
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(tree, "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("rows").over(own).alias("n"))
    return kept.join(pieces, [tree, "part"]).withColumn("pos", F.col("mid") + F.col("shift")).drop("mid", "part", "shift")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` does that and is fast whenever the text has no capital letter
    beyond A-Z; texts that have one go through ``translate``.
    """
    return F.when(
        text.rlike(r"[^\x00-\x7F&&[\p{IsUppercase}\p{Lt}]]"),
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()),
    ).otherwise(F.lower(text))


def slices(batch: pa.RecordBatch, column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text (a longer text alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
    at = 0
    if len(sizes):
        total = np.cumsum(sizes)
        while at < len(sizes):
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and each text's start (nulls are empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]: offsets[-1]], offsets - offsets[0]


STORE = "_jarledger_store_"


def process_store(name: str) -> types.ModuleType:
    """A namespace that lives as long as the Python worker, for models and word caches."""
    return sys.modules.setdefault(STORE + name, types.ModuleType(name))


def free_stores(*but: str) -> None:
    """Empty the stores that earlier operators left in this Python worker, but those whose names begin like ``but``."""
    for name in [n for n in sys.modules if n.startswith(STORE) and not n.startswith(tuple(STORE + b for b in but))]:
        del sys.modules[name]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sample_limit(rows: int, total: int) -> int:
    """The largest signed 64-bit hash that is in a sample of about ``rows`` of ``total`` rows."""
    return (1 << 63) - 1 if total <= rows else (rows << 64) // total - (1 << 63)


def sample_hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit("sample"))


def bounded_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, picked by a hash of ``key`` (all if there are fewer)."""
    return df if total <= rows else df.where(sample_hash(key) <= F.lit(sample_limit(rows, total)))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def apply_decisions(docs: DataFrame, key: Column, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; columns as they came.

    ``decisions`` has ``doc_id``, ``key`` and ``stays`` for every row of
    ``docs``; ``key`` is an expression over a row's text.  Only rows that go,
    or that share id and key with others, are joined; of the latter one stays.
    """
    i, k, stays = free_names(docs, "odd_id", "odd_key", "odd_stays")
    odd = (decisions.groupBy(F.col("doc_id").alias(i), F.col("key").alias(k))
           .agg(F.bool_or("stays").alias(stays), F.count("*").alias("n"))
           .where(f"not {stays} or n > 1").drop("n"))
    joined = docs.join(odd, docs["doc_id"].eqNullSafe(odd[i]) & key.eqNullSafe(odd[k]), "left")
    once = joined.where(F.col(stays)).dropDuplicates([i, k])
    return joined.where(F.col(stays).isNull()).unionByName(once).select(docs.columns)


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of a link table: ``(node, root)``, root the smallest node reachable.

    Alternates two star operations until the links no longer change: every
    node hands its larger neighbours to its smallest neighbour (large star),
    then its smaller ones likewise (small star).  Only aggregations and
    equi-joins; the rounds grow with the logarithm of the longest chain.  Each round's links are
    written to the shared folder, and so are the nodes' minima: both sides of
    the large star's join then have an exchange, and AQE can split the rows of
    a node with very many neighbours.  Nodes without a link are not returned.
    """
    def star(edges: DataFrame) -> DataFrame:
        return edges.where("a <> b").distinct()

    def mark(edges: DataFrame):
        row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        return row["n"], row["h"]

    edges = settle(star(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = star(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # after the large star every link runs from the larger to the smaller node
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = settle(star(
            down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))), "links")
        now = mark(edges)
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("the components did not settle; raise max_rounds")
