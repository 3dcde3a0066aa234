"""License scan by exact set-similarity join (operator 4), DataFrame functions only.

Words are runs of 0-9, a-z and all non-ASCII characters after lower-casing
A-Z.  A text block is ``BLOCK`` consecutive words, or twice the template's
words if these are more, and may begin at any word.  A block matches a license
template if it holds at least ``containment`` of the template's distinct words.

The join finds every match without comparing every block with every template.
Template words are ordered by how many texts of the corpus hold them, rarest
first.  A match shares ``need`` words, so it shares one of the template's
first ``size - need + 1`` words in that order (prefix filter); texts whose own
template words don't reach ``need`` are left before blocks are cut (length
filter).  Only blocks around an occurrence of a prefix word are looked at, and
only for matches whose first shared word in the order this is: the others are
met at that word.  All their shared words then stand at or after its place in
the template's order, so if the words that these blocks cover together hold
fewer than ``need`` of the template's words from that place on, the pair is
dropped (positional filter: it prunes what has enough words in all, but too few
behind the place); else each block that begins at a template
word is verified.  A block that begins elsewhere shares no more than the one
that begins at its first template word.  Templates are parameters, or a table
read by :func:`templates_of`, at most
``MOST_TEMPLATES`` of them, and so are the only thing broadcast.

Beside it stand the fixed phrases, found where their words follow each other.

Skew: work is by text; long texts unfold into a row for each prefix word they
hold, with the words around it, and these meet template rows only on rare words.

Defined cases: null is the empty text, with no words, nulls for the first and
last word, empty label lists and score 0; repeated rows give repeated rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from jarledger.llm.common import ascii_lower, settle, table

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, CONTAINMENT, MOST_TEMPLATES = 32, 0.8, 1000

# Phrases of the base scan, and the templates of the join.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
]


def words_of(text: Column) -> Column:
    """The words of each text, in order."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK), "")


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after the other (0 is the first word)."""
    last = F.size(words) - len(phrase)

    def here(i):
        hit = F.lit(True)
        for k, w in enumerate(phrase):
            hit = hit & (F.get(words, i + k) == w)
        return hit

    return F.when((last >= 0) & F.array_contains(words, phrase[0]), F.filter(F.sequence(F.lit(0), last), here)).otherwise(
        F.array().cast("array<int>"))


def templates_of(table_: DataFrame, most: int = MOST_TEMPLATES) -> list[tuple[str, str]]:
    """The templates of a table ``(text, label)``, their words as the scan reads them; refuses more than ``most`` rows."""
    rows = table_.select(F.array_join(words_of(F.col("text")), " ").alias("text"), "label").where("text <> '' and label is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"at most {most} templates")
    return sorted((r["text"], r["label"]) for r in rows)


def plan_templates(counts: dict[str, int], templates: list[tuple[str, str]], containment: float) -> list[dict]:
    """For each template its words, rarest first, prefix and need."""
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for k, (text, label) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = max(1, math.ceil(containment * len(words) - 1e-9))
        out.append({"template": k, "label": label, "words": words, "need": need, "prefix": words[: len(words) - need + 1], "length": len(text.split())})
    return out


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
         containment: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    spark = docs.sparkSession
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    asked = sorted({w for t, _ in [*phrases, *templates] for w in t.split()})

    # pass 1: which of the words that matter each text holds, and how many texts hold each
    held = docs.select(words_of(F.col("text")).alias("w")).select(F.explode(F.array_intersect(literal(vocabulary), "w")).alias("word"))
    counts = {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    plan = plan_templates(counts, templates, containment)

    # pass 2: words, phrase places, and the templates a text can still reach
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w")).select(
        "doc_id", "w", F.array_intersect(literal(asked), "w").alias("held"))
    found = [F.when(F.size(F.array_intersect("held", literal(sorted(set(p.split()))))) == len(set(p.split())),
                    places(F.col("w"), p.split())).otherwise(F.array().cast("array<int>")) for p, _ in phrases]
    reach = [F.when((F.size(F.array_intersect("held", literal(t["words"]))) >= t["need"]) & F.arrays_overlap("held", literal(t["prefix"])),
                    F.lit(t["template"])) for t in plan]
    rows = rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.array(*[F.struct(F.lit(label).alias("label"), p.alias("at")) for (_, label), p in zip(phrases, found)]).alias("base"),
        F.array_compact(F.array(*reach)).alias("reach"), "w")
    rows = rows.withColumn("w", F.when(F.size("reach") > 0, F.col("w")))  # only reaching texts keep their words
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row_id"), "*"), "license_rows")

    # the join: where prefix words stand against the templates that have them, then the blocks around
    index = spark.createDataFrame(
        [(w, t["template"], t["label"], t["words"], t["words"][i:], t["need"], max(block, 2 * t["length"])) for t in plan for i, w in enumerate(t["prefix"])],
        "word string, template int, label string, t_words array<string>, rest array<string>, need int, block int")
    rare = literal(sorted({w for t in plan for w in t["prefix"]}))
    most = max((max(block, 2 * t["length"]) for t in plan), default=block)
    stands = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(rare, x), i)), lambda i: i.isNotNull())

    def around(at: Column, size: Column) -> Column:
        """The words of all blocks of ``size`` words that hold word ``at``."""
        return F.slice("w", F.greatest(at - size + 2, F.lit(1)), F.least(at + 1, size) + size - 1)

    spots = (rows.where("w is not null").select("row_id", "reach", "w", F.explode(stands).alias("at"))
             .select("row_id", "reach", F.get("w", F.col("at")).alias("word"), F.least("at", F.lit(most - 1)).alias("at"),
                     around(F.col("at"), F.lit(most)).alias("w")))
    pairs = (spots.join(F.broadcast(index), "word").where(F.array_contains("reach", F.col("template")))
             .select("row_id", "label", "need", "t_words", "rest", "block", around(F.col("at"), F.col("block")).alias("near"), F.least("at", F.col("block") - 1).alias("at"))
             .where(F.size(F.array_intersect("rest", "near")) >= F.col("need")))
    begins = F.filter(F.sequence(F.lit(0), F.col("at")), lambda i: F.array_contains("t_words", F.get("near", i)))
    shared = F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect(F.slice("near", i + 1, F.col("block")), F.col("t_words")))))
    hits = (pairs.select("row_id", "label", shared.alias("shared"), "need", F.size("t_words").alias("size"))
            .where("shared >= need")
            .groupBy("row_id").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("best")))

    base = F.filter("base", lambda b: F.size(b["at"]) > 0)
    spots = F.flatten(F.transform("base", lambda b: b["at"]))
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    none = F.array().cast("array<string>")
    return (rows.drop("w", "reach").join(hits, "row_id", "left").select(
        "doc_id", "n_words", F.size(spots).cast("long").alias("n_base"),
        F.array_min(spots).cast("long").alias("first_word"), F.array_max(spots).cast("long").alias("last_word"),
        F.concat_ws(",", base_labels).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base_labels, F.coalesce("more", none)))).alias("labels"),
        F.when(F.size(spots) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same by brute force: every block that begins at a word of the template, against every template."""
    def listed(text: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"

    phrases = ", ".join(f"({listed(p)}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"(list_distinct({listed(t)}), '{label}', {max(BLOCK, 2 * len(t.split()))})" for t, label in TEMPLATES)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p(p, label) AS (VALUES {phrases}), t(t, label, size) AS (VALUES {templates}),
base AS (
  SELECT doc_id, s - 1 AS place, label
  FROM (SELECT doc_id, w, p, label, unnest(generate_series(1, len(w) - len(p) + 1)) AS s FROM d, p WHERE len(w) >= len(p))
  WHERE w[s:s + len(p) - 1] = p
), b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base_list FROM base GROUP BY 1),
near AS (SELECT doc_id, w, t, label, size FROM d, t WHERE len(list_intersect(t, w)) >= ceil({CONTAINMENT} * len(t) - 1e-9)),
block AS (
  SELECT t, label, doc_id, w[s:s + size - 1] AS k
  FROM (SELECT *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i]))) AS s FROM near)
), hit AS (
  SELECT doc_id, label, len(list_intersect(t, k)) / len(t) AS share FROM block
  WHERE len(list_intersect(t, k)) >= ceil({CONTAINMENT} * len(t) - 1e-9)
), h AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS best FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base_list, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN h USING (doc_id)
"""
