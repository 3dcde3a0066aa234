"""Input columns with the names that operators use inside change nothing, and rows keep them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jarledger.llm import (chunk_dedup, decontam, lang_mixture, license_scan, merkle_manifest, minhash_index, secret_scan, sentencepiece_stream,
                           simhash_pivot, suffix_dedup, token_alignment, token_output)
from jarledger.session import shared_dir

NAMES = ["row_id", "base", "runs", "recipe", "fp", "key", "ids", "n_tokens", "hits", "words", "node", "digest", "block", "sig", "root", "pos", "n", "tree",
         "leaf", "stays", "odd_id", "odd_key", "odd_stays", "w", "reach", "hash", "shard", "toxic", "score", "pairs", "times", "chunk", "size", "mid"]


@pytest.fixture()
def clash(odd_docs):
    plain = odd_docs.drop("n", "norm").withColumns({"source": F.lit("s"), "n_chars": F.length("text")})
    return plain, plain.withColumns({name: F.lit(f"own {name}") for name in NAMES})


def bench_of(spark):
    return spark.createDataFrame([(1, "a text of some words, no id but", "x")], "item_id long, text string, key string")


OPERATORS = {
    "sentencepiece": lambda d: sentencepiece_stream.encode_texts(d).select("doc_id", "ids", "n_tokens"),
    "secrets": secret_scan.secrets,
    "decontamination": lambda d: decontam.contamination(d, bench_of(d.sparkSession)).drop("row_id"),
    "licenses": license_scan.scan,
    "suffixes": suffix_dedup.removed,
    "tokens": lambda d: token_output.read_ids(token_output.write_ids(d, shared_dir(d.sparkSession, "llm", "clash"))),
    "language": lambda d: lang_mixture.predict(d, lang_mixture.fit(d)),
    "chunks": chunk_dedup.groups,
    "simhash": simhash_pivot.near_groups,
    "alignment": lambda d: token_alignment.alignment(d).drop("row_id"),
    "minhash": minhash_index.near_groups,
    "merkle": lambda d: merkle_manifest.proofs(merkle_manifest.build(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(clash, name):
    plain, clashing = (sorted(map(str, OPERATORS[name](d).collect())) for d in clash)
    assert plain == clashing


@pytest.mark.parametrize("keep", [chunk_dedup.keep_one, simhash_pivot.keep_one, minhash_index.keep_one,
                                  lambda d: decontam.drop_contaminated(d, bench_of(d.sparkSession))])
def test_filters_keep_the_columns(clash, keep):
    plain, clashing = clash
    got = keep(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert all(r[name] == f"own {name}" for r in rows for name in NAMES)
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in keep(plain).collect())


def test_pipeline(spark, clash, sf):
    _, docs = clash
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, sf)
        assert set(before) - {"ids", "n_tokens"} <= set(docs.columns)
    assert docs.count() > 0
