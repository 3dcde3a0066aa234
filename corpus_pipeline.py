"""The corpus pipeline: documents in, token ids of the rows that stay out.

Each stage takes ``(spark, docs, sf_dir)``, calls one operator of
``jarledger.llm`` on everything its predecessor kept, and its decision takes
effect; all but the last return the columns of documents.  Each result is
written as Parquet in the shared checkpoint folder and read again, so a lost
executor repeats no more than its own stage; what a stage wrote on its way is
removed when its result is there.

A null or empty text is not toxic, equals other empty texts, has no benchmark
words and no ids; every stage of an empty table is empty; other columns go
along unchanged, but for ``ids``, ``n_tokens`` and ``round_trip``, which the last stage sets.  One row of repeated ones stays.  SQL can't express the
toxicity, SimHash and SentencePiece stages, so ORACLE_SQL is None and
``tests/llm/test_pipeline.py`` checks run() against a brute-force version.
"""

from __future__ import annotations

from jarledger.llm import chunk_dedup, decontam, sentencepiece_stream, simhash_pivot, toxicity_fst
from jarledger.llm.common import scratch, settle, table


def toxicity(spark, docs, sf_dir):
    """Rows that score 0.7 or more go; labels are learned from as in op10."""
    model = toxicity_fst.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_fst.reject(docs, model)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    return chunk_dedup.keep_one(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """Of each near-duplicate group the smallest doc_id stays."""
    return simhash_pivot.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Rows that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark, docs, sf_dir):
    """Token ids of what is left, beside its columns, and whether decoding them gave the text back."""
    return sentencepiece_stream.encode_texts(docs, check=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = settle(stage(spark, docs, sf_dir), f"stage_{name}", keep=True)
    return docs
