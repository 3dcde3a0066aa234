"""Exact dedup by content-defined chunk recipes (operator 8), DataFrame functions only.

A text (A-Z lower-cased) is cut where its own bytes say so: after a character
pattern of ``BOUNDARY`` once a chunk has ``min_chunk`` characters, or at
``max_chunk``.  Equal texts are cut alike, so a text is its recipe, the
ordered list of its chunks' identifiers.

Identifiers are verified: a chunk's 64-bit hash stands for its content only
where all chunks of that hash have the same content, which an aggregation over
(hash, content) checks; it moves each distinct chunk of a partition once.
Texts with a chunk whose hash has two contents, and only those, are cut again
and such chunks named by hash and SHA-256 of the content.  After that only recipes move, 8 bytes a chunk: the recipe is the
grouping key, compared as an ordered list, not as a hash of it.

Skew: groups are aggregated before the shuffle (largest row, count), never
collected; copies join their group's one row by recipe, a join whose
large side AQE can split.

Defined cases: null text is the empty text, whose recipe is the empty list; of
rows that repeat a doc_id and its text one is kept, the others are dropped;
a null doc_id loses against any other; an empty table gives an empty result;
other columns are ignored by :func:`groups` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from jarledger.llm.common import apply_decisions, ascii_lower, settle, table

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: Ends a chunk: about one place in a hundred of ordinary prose.
BOUNDARY = r"[.!?,]\s"


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, boundary: str = BOUNDARY) -> Column:
    """The chunks of a text, in order; they join to the text again.

    A character is any code unit; the last chunk may be shorter.
    """
    pattern = rf"(?s).{{{min_chunk},{max_chunk - 2}}}?(?:{boundary}|\z)|.{{1,{max_chunk}}}"
    return F.when(F.length(text) <= min_chunk, F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
                  ).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def text_digest(text: Column) -> Column:
    """Lowercase hex sha256 of the normalised text."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def recipes(docs: DataFrame, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK,
            hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(row_id, doc_id, recipe, text_sha256)``, a verified recipe for every row; ``hashed`` gives a chunk's 64-bit hash."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    cut = norm.select("doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
                      chunks(F.col("norm"), min_chunk, max_chunk).alias("chunks"))
    rows = settle(cut.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text_sha256",
                             F.transform("chunks", lambda c: hashed(c)).alias("recipe")), "recipes")
    contents = (cut.select(F.explode("chunks").alias("chunk"))
                .groupBy(hashed(F.col("chunk")).alias("hash"), "chunk").agg(F.lit(1).alias("one")))
    doubtful = settle(contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "doubtful")
    plain = rows.select("row_id", "doc_id", F.col("recipe").cast("array<string>").alias("recipe"), "text_sha256")
    if doubtful.isEmpty():
        return plain
    texts = (rows.select("text_sha256", F.explode("recipe").alias("hash")).join(doubtful, "hash", "left_semi")
             .select("text_sha256").distinct())
    again = cut.select("text_sha256", "chunks").join(texts, "text_sha256", "left_semi")
    parts = (again.select("text_sha256", F.posexplode("chunks").alias("at", "chunk"))
             .select("text_sha256", "at", hashed(F.col("chunk")).alias("hash"), F.sha2(F.encode("chunk", "UTF-8"), 256).alias("digest"))
             .distinct())  # copies of a text give the same parts
    parts = parts.join(doubtful.withColumn("doubt", F.lit(True)), "hash", "left")
    name = F.concat_ws(":", F.col("hash").cast("string"), F.when(F.col("doubt"), F.col("digest")))
    named = settle(parts.groupBy("text_sha256").agg(  # a text's parts, as long as its recipe
        F.transform(F.array_sort(F.collect_list(F.struct("at", name.alias("id")))), lambda x: x["id"]).alias("named")), "recipes_named")
    return settle(plain.join(named, "text_sha256", "left").select(
        "row_id", "doc_id", F.coalesce("named", "recipe").alias("recipe"), "text_sha256"), "recipes_verified")


def groups(docs: DataFrame, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK,
           hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row."""
    rows = recipes(docs, min_chunk, max_chunk, hashed)
    # written down, so the join has an exchange on either side and AQE can split a hot recipe's copies
    best = settle(rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_id")).alias("best"), F.count("*").alias("group_size")), "best")
    return rows.join(best, "recipe").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; columns as they came."""
    found = groups(docs, **options).select("doc_id", F.col("text_sha256").alias("key"), F.col("kept").alias("stays"))
    return apply_decisions(docs, text_digest(F.col("text")), found)


def op8_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
