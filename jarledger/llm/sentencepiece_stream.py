"""SentencePiece encoding and decoding by streaming Viterbi (operator 1).

The segmentation that the given public model prescribes is found in one pass
over the lattice of its pieces.  A unigram model's best path has the largest
sum of scores; of equal sums the path whose last piece is longest wins.  For a
model of merges (BPE) a path is admissible if each two neighbouring pieces
are: merging their text by rank must give these two again.  Exactly one path
to each boundary is, and it is the one the merges give, so the ids equal the
public library's.  A character without a piece is written as byte pieces.

The window holds live boundaries only: those that a piece from a position
still to come can start at, at most the longest piece's length of them.
Whenever all their backpointer paths run through one boundary, everything
before it is committed as ids, and scores are counted from there again, so
neither sums nor memory grow with the text.

Where no piece holds a space after another character (read from the
vocabulary, not assumed), all paths meet before every run of spaces: each word
is committed on its own, so the ids of a word are the same wherever it
stands and a bounded cache of words, kept for the worker's life, answers most of them.

Decoding joins the pieces' bytes and drops the one leading space that encoding
put there; it gives every text back exactly.  A literal U+2581 is not taken
for a space, it is written as bytes (the one text whose ids differ from the public
library's, which reads that sign as a space and so does not give the text back).

Defined cases: a null or empty text has no ids and decodes to the empty text;
ids outside the vocabulary and control pieces decode to nothing; repeated rows
give repeated rows; an empty table gives an empty result; other columns are
kept as they are (an ``ids`` or ``n_tokens`` column of the input is replaced).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

from jarledger.llm.common import free_stores, process_store, slices, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
UNKNOWN_COST = 10.0
CACHE_WORDS = 400_000   # words a worker remembers, about 90 MB
CACHE_PAIRS = 2_000     # right neighbours of a piece that a worker remembers
CACHED_LENGTH = 64      # longer words are never remembered
MARKS = ".,;:!?|$%&*#"
UNITS = re.compile(r" +[^ ]*")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value

    while at < len(message):
        key = varint()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, message[at: at + size]
        at += size


def read_vocabulary(path: str = MODEL) -> dict:
    """Kind, pieces (a space for the model's space sign), scores and byte ids of a model file; bounded by the vocabulary."""
    with open(path, "rb") as f:
        raw = f.read()
    # fixed values of the public format: field 2 holds the trainer's settings, their field 3 the kind, 2 is BPE
    trainer = b"".join(v for k, v in fields(raw) if k == 2)
    kind = "bpe" if [v for k, v in fields(trainer) if k == 3][-1:] == [2] else "unigram"
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    n = model.vocab_size()
    special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i)]
    byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
    plain = {i: model.id_to_piece(i).replace("▁", " ") for i in range(n) if i not in special and not model.is_byte(i)}
    return {"kind": kind, "size": n, "byte": byte, "pieces": plain, "scores": {i: model.get_score(i) for i in plain},
            "name": hashlib.sha256(raw).hexdigest()[:16]}


class Encoder:
    """Streaming Viterbi over one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.byte = [vocabulary["byte"][b] for b in range(256)]
        self.merges = vocabulary["kind"] == "bpe"
        self.pieces: dict[str, tuple[int, float]] = {}
        for i, piece in vocabulary["pieces"].items():
            self.pieces.setdefault(piece, (i, vocabulary["scores"][i]))
        self.trie: dict = {}        # character: the node below; None: the id and score of a piece that ends here
        for piece, hit in self.pieces.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[None] = hit
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_COST
        self.by_word = not any(re.search(r"[^ ] ", p) for p in self.pieces)
        beside = {p[i: i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.marks = "".join(m for m in MARKS if not any(b[1] == m and b[0].isalpha() for b in beside))
        store = process_store("pieces_" + vocabulary["name"]).__dict__
        self.cache: dict[str, bytes] = store.setdefault("words", {})
        self.pairs: dict[int, dict[int, bool]] = store.setdefault("pairs", {})  # by the left piece; vocabulary squared at most
        self.text_of = vocabulary["pieces"]
        self.bytes_of = [b""] * vocabulary["size"]
        for i, piece in vocabulary["pieces"].items():
            self.bytes_of[i] = piece.encode()
        for b, i in vocabulary["byte"].items():
            self.bytes_of[i] = bytes([b])

    def admits(self, left: int, right: int) -> bool:
        """Whether two pieces can stand side by side (always, unless the model is one of merges)."""
        if left < 0 or right < 0 or not self.merges:
            return True
        row = self.pairs.setdefault(left, {})
        known = row.get(right)
        if known is None:
            a, b = self.text_of[left], self.text_of[right]
            known = self.merged(a + b) == [a, b]
            if len(row) < CACHE_PAIRS:
                row[right] = known
        return known

    def merged(self, text: str) -> list[str]:
        """Two pieces' text merged by rank: again and again the neighbours with the best score, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.pieces[a + b][1], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.pieces),
                           default=(0.0, 1))
            if at > 0:
                break
            parts[-at: 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of ``text``, committed part by part."""
        trie, unknown, n, merges, pairs, none = self.trie, self.unknown, len(text), self.merges, self.pairs, {}
        best: dict[int, float] = {0: 0.0}      # live boundaries
        back: dict[int, tuple[int, int]] = {}  # boundary: where its best path's last piece starts, its id (-1: bytes)
        base, check, before = 0, 2 * self.longest, -1
        for at in range(n):
            if at not in best:
                continue
            if at > base and (len(best) == 1 or at - base >= check):
                meet = at if len(best) == 1 else self.meeting(best, back, base)
                if meet > base:
                    yield self.path(text, back, base, meet)
                    score, before = best[at], back[meet][1]
                    back = {k: v for k, v in back.items() if k > meet}
                    best = {k: v - score for k, v in best.items()}
                    base, check = meet, 2 * self.longest
                else:
                    check += self.longest  # paths still differ: ask again a window later
            here, single = best.pop(at), False
            last = back[at][1] if at > base else before
            node, row, end = trie, pairs.get(last, none), at
            while end < n:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                hit = node.get(None)
                if hit is None:
                    continue
                single = single or end == at + 1
                if merges:
                    if end not in best:
                        fits = row.get(hit[0])
                        if fits or (fits is None and self.admits(last, hit[0])):
                            best[end], back[end] = 0.0, (at, hit[0])
                elif end not in best or here + hit[1] > best[end]:
                    best[end], back[end] = here + hit[1], (at, hit[0])
            if not single and (at + 1 not in best or here + unknown > best[at + 1]):
                best[at + 1], back[at + 1] = here + unknown, (at, -1)
        if n:
            yield self.path(text, back, base, n)

    @staticmethod
    def meeting(best: dict, back: dict, base: int) -> int:
        """The last boundary that the paths of all live boundaries run through."""
        ends = set(best)
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(back[last][0] if last > base else base)
        return ends.pop()

    def path(self, text: str, back: dict, base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            begin, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(text[begin:end].encode("utf-8", "surrogatepass"))]
            end = begin
        return out[::-1]

    def unit(self, text: str) -> bytes:
        """Ids of one unit, as 32-bit integers."""
        return np.array([i for part in self.stream(text) for i in part], np.int32).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a space and ``word``; marks that no piece joins to a letter before them are remembered apart."""
        body = word.rstrip(self.marks)
        if not body or not body[-1].isalpha():
            body = word
        ids = self.cache.get(body)
        if ids is None:
            ids = self.keep(body, self.unit(" " + body))
        marks = word[len(body):]
        if marks:
            ids += self.cache.get(" " + marks) or self.keep(" " + marks, self.unit(marks))
        return ids

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHED_LENGTH and len(self.cache) < CACHE_WORDS:
            self.cache[word] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        if not text:
            return b""
        if not self.by_word:
            return self.unit(" " + text)
        words = text.split(" ")
        if "" in words:  # runs of spaces: a unit is a run with the word that follows
            return b"".join([self.cache.get(u[1:]) or self.word(u[1:]) if u[1:2] not in ("", " ") else self.unit(u)
                             for u in UNITS.findall(" " + text)])
        cache = self.cache
        return b"".join([cache.get(w) or self.word(w) for w in words])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def decode(self, ids) -> str:
        table_, n = self.bytes_of, len(self.bytes_of)
        try:
            if len(ids) and min(ids) < 0:
                raise IndexError
            raw = b"".join([table_[i] for i in ids])
        except IndexError:
            raw = b"".join(table_[i] for i in ids if 0 <= i < n)
        return raw.decode("utf-8", "replace")[1:]


def id_arrays(raw: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(r) // 4 for r in raw])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def decode_column(spark, ids: Column, path: str = MODEL) -> Column:
    """The text of each array of ids; null for null."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("string")
    def decode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for rows in series:
            yield pd.Series([None if r is None else encoder.decode(r.tolist()) for r in rows], dtype=object)

    return decode(ids)


def encode_texts(docs: DataFrame, path: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``, and with ``check`` whether decoding gives the text back (``round_trip``)."""
    added = ["ids", "n_tokens", *["round_trip"] * check]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        free_stores("pieces_")
        encoder = Encoder(shared.value)
        for whole in batches:
            for part in slices(whole, column=whole.schema.names[at], most=2 << 20):
                texts = [t or "" for t in part.column(at).cast(pa.string()).to_pylist()]
                raw = [encoder.encode_bytes(t) for t in texts]
                out = [id_arrays(raw), pa.array([len(r) // 4 for r in raw], pa.int64())]
                if check:
                    out.append(pa.array([encoder.decode(np.frombuffer(r, np.int32).tolist()) == t for r, t in zip(raw, texts)]))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, *added])

    kinds = T.StructType(docs.schema.fields + [T.StructField(c, t) for c, t in zip(added, (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()))])
    return docs.mapInArrow(run, kinds)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    coded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return coded.select("doc_id", "n_tokens", "ids", "round_trip")
