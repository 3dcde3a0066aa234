"""Token-id files of independent zstandard frames (operator 6).

A shard file holds one zstandard frame for each document, then two skippable
frames: the document index, and last the seek table, which a reader finds from
the file's end:

    frame 0 .. frame n-1   ids, little-endian, ``width`` bytes each
    skippable 0x184D2A5D   n x (int64 doc_id), n x (uint8 1: no doc_id), uint8 width
    skippable 0x184D2A5E   n x (uint32 compressed size, uint32 size, uint32 checksum),
                           uint32 n, uint8 0x80, uint32 0x8F92EAB1

Checksums are the low 32 bits of a frame's content's XXH64.  A reader
decompresses only the frames of the documents it is asked for, and checks them.

Documents are range-partitioned by doc_id, a task writes its part in order,
and offsets are running sums over shards.  Each attempt
writes a file of its own name; only files named in the manifest, which Spark
commits, are read, so retried or doubled tasks leave no trace in the result.

Texts are cut into units where the tokenizer cuts in any case
(``jarledger.llm.units``; checked against whole texts in tests): each distinct
unit of a slice is looked up once, a bounded cache asks the tokenizers library
for new ones only, and ids are gathered by array operations.  A tokenizer of
another kind gets whole texts.

Defined cases: a null text is empty and has the end id alone; null doc_ids
come first, rows that share a doc_id follow each other by their text's hash (they
are dealt by it too, so one id with very many rows fills more than one shard); a document of
any length is one frame below 4 GB; an empty table gives an empty result; other columns are ignored; doc_ids are integers.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from jarledger.llm.common import process_store, settle, slices, table
from jarledger.llm.units import Units
from jarledger.session import shared_dir

MODEL = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
LEVEL = 3
CACHE_UNITS = 400_000    # units a worker remembers, about 90 MB
CACHED_LENGTH = 48
SLICE = 4 << 20          # bytes of text encoded at a time
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


def open_store(url: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that all executors share."""
    for hadoop, name in (("s3a://", "s3://"), ("s3n://", "s3://")):
        url = url.replace(hadoop, name, 1) if url.startswith(hadoop) else url
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    return (fs.LocalFileSystem(), url) if "://" not in url else fs.FileSystem.from_uri(url)


class Tokens:
    """Ids of texts through the tokenizers library, with a cache of units.

    A unit of letters goes straight to the library's merges, any other through its whole pipeline.
    """

    def __init__(self, model: str):
        store = process_store("tokens_" + hashlib.sha256(model.encode()).hexdigest()[:16]).__dict__
        if "model" not in store:
            store["model"] = Tokenizer.from_str(model)
            store["model"].encode_special_tokens = True  # their strings in a text are ordinary text
            store["merges"] = store["model"].model
            store["units"] = {}
            parts = json.loads(model)
            steps = parts.get("pre_tokenizer") or {}
            store["by_unit"] = (steps.get("type") == "ByteLevel" and steps.get("use_regex", True)
                                and not steps.get("add_prefix_space") and not parts.get("normalizer"))
        self.model, self.merges, self.units, self.by_unit = store["model"], store["merges"], store["units"], store["by_unit"]
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        # byte-level vocabularies write bytes as printable characters: the others take the places from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.signs = {b: 256 + i for i, b in enumerate(hidden)}

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def merged(self, unit: bytes) -> bytes:
        """Ids of a unit that the library takes as one word."""
        return np.array([t.id for t in self.merges.tokenize(unit.decode("latin-1").translate(self.signs))], self.type).tobytes()

    def fresh(self, unit: bytes) -> bytes:
        text = unit.decode("utf-8", "surrogatepass")
        word = text[1:] if text[0] == " " else text
        return self.merged(unit) if word.isalpha() else self.whole(text)

    def of_units(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each unit."""
        known, fresh, room = self.units, self.fresh, CACHE_UNITS - len(self.units)
        out = [known.get(u) for u in distinct]
        for i, ids in enumerate(out):
            if ids is None:
                unit = distinct[i]
                out[i] = ids = fresh(unit)
                if room > 0 and len(unit) <= CACHED_LENGTH:
                    known[unit], room = ids, room - 1
        return out

    def encode(self, text: str) -> bytes:
        """The ids' bytes of one text."""
        return self.encode_texts(pa.array([text]))[0].tobytes()

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and the end)."""
        if self.by_unit:
            units = Units(texts)
            return units.gather(self.of_units(units.distinct), self.type)
        raw = [self.whole(t or "") for t in texts.to_pylist()]
        return np.frombuffer(b"".join(raw), self.type), np.cumsum([0] + [len(r) // self.width for r in raw])


def write_shard(path: str, documents, width: int) -> tuple[list[int], int]:
    """Write ``(doc_id or None, ids as bytes)`` in order; the count of ids of each, and the file's size."""
    store, place = open_store(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    packer, seek, ids, none, counts, size = zstandard.ZstdCompressor(level=LEVEL), [], [], [], [], 0
    with store.open_output_stream(place) as out:
        for doc_id, raw in documents:
            frame = packer.compress(raw)
            out.write(frame)
            seek.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            ids.append(doc_id or 0)
            none.append(doc_id is None)
            counts.append(len(raw) // width)
            size += len(frame)
        index = np.array(ids, "<i8").tobytes() + np.array(none, np.uint8).tobytes() + bytes([width])
        foot = b"".join(seek) + struct.pack("<IBI", len(seek), 0x80, SEEKABLE)
        for magic, body in ((INDEX_MAGIC, index), (SEEK_MAGIC, foot)):
            out.write(struct.pack("<II", magic, len(body)) + body)
            size += 8 + len(body)
    return counts, size


class Shard:
    """Reads a shard: the seek table first, then only the frames that are asked for."""

    def __init__(self, path: str):
        store, place = open_store(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        begin = size - 9 - 12 * n
        if struct.unpack("<II", self.file.read_at(8, begin - 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError(f"{path}: the seek table's frame is damaged")
        self.seek = np.frombuffer(self.file.read_at(12 * n, begin), "<u4").reshape(n, 3)
        self.at = np.concatenate(([0], np.cumsum(self.seek[:, 0], dtype=np.int64)))
        body = self.file.read_at(9 * n + 1, int(self.at[-1]) + 8)
        none = np.frombuffer(body, np.uint8, n, 8 * n).astype(bool)
        self.doc_ids = [None if gone else i for i, gone in zip(np.frombuffer(body, "<i8", n).tolist(), none.tolist())]
        self.type = np.dtype("<u2" if body[-1] == 2 else "<u4")
        self.packer = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        packed, size, check = self.seek[k].tolist()
        raw = self.packer.decompress(self.file.read_at(packed, int(self.at[k])), max_output_size=max(size, 1)) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"document {self.doc_ids[k]}: checksum differs")
        return np.frombuffer(raw, self.type)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of that id."""
        return [self.ids(k) for k, i in enumerate(self.doc_ids) if i == doc_id]


def write_ids(docs: DataFrame, folder: str, path: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """Write all documents; the manifest ``(shard, file, n_docs, n_ids, bytes)``, a row for each file."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary

    def run(batches):
        tokens, total = Tokens(model.value), [0, 0]
        end = np.array([end_id], tokens.type).tobytes()

        def documents():
            for batch in batches:
                for part in slices(batch, most=SLICE):
                    ids, at = tokens.encode_texts(part["text"])
                    at = at.tolist()
                    for doc_id, a, b in zip(part["doc_id"].to_pylist(), at, at[1:]):
                        total[0] += 1
                        total[1] += b - a + 1
                        yield doc_id, ids[a:b].tobytes() + end

        rows = documents()
        first = next(rows, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        name = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.tokens"
        _, size = write_shard(name, (x for some in ([first], rows) for x in some), tokens.width)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [total[0]],
                                          "n_ids": [total[1]], "bytes": [size]})

    place = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ordered = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
               .withColumn("hash", F.xxhash64("text")).repartitionByRange(*place).sortWithinPartitions(*place).drop("hash"))
    return settle(ordered.mapInArrow(run, "shard int, file string, n_docs long, n_ids long, bytes long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files the manifest names."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches):
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                shard, count, crc = Shard(name), [], []
                for k in range(len(shard.doc_ids)):
                    ids = shard.ids(k)
                    count.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4")))
                ends = np.cumsum(np.array(count, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(start + ends - np.array(count, np.int64)), pa.array(count, pa.int64()),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "llm", "tokens")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder))
