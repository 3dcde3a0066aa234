"""run() against the stages done by plain loops, from the operators' own decisions on whole texts."""

import sentencepiece

import corpus_pipeline
from jarledger.llm import sentencepiece_stream, toxicity_fst
from jarledger.llm.common import table
from test_operators import brute_contamination, plain_components, plain_fingerprint


def test_pipeline_equals_plain_loops(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity_fst.fit(docs, table(spark, sf, "labels"))
    score = {r["doc_id"]: r["score"] for r in toxicity_fst.scores(docs, model).collect()}
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect() if score[r["doc_id"]] < toxicity_fst.THRESHOLD}
    last = {}
    for i in sorted(rows):
        last[rows[i].encode().lower()] = i
    rows = {i: rows[i] for i in last.values()}
    root = plain_components({i: plain_fingerprint(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if root[i] == i}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    hits = brute_contamination(rows.values(), items)
    rows = {i: t for (i, t), (_, n, _) in zip(rows.items(), hits) if not n}

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_stream.MODEL)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "ids", "n_tokens", "round_trip"] and got.where("not round_trip").count() == 0
    assert {r["doc_id"]: list(r["ids"]) for r in got.collect()} == {i: library.encode(t) for i, t in rows.items()}


def test_a_scratch_leaves_only_what_is_kept(spark):
    import os
    from jarledger.llm.common import scratch, settle
    from jarledger.session import shared_dir
    root = shared_dir(spark, "x").rsplit("/", 2)[0].replace("file:", "")
    with scratch(spark):
        inner = settle(spark.range(5), "inner")
        kept = settle(inner.where("id > 2"), "kept", keep=True)
        place = inner.inputFiles()[0].replace("file:", "").replace("//", "/")
        assert os.path.exists(place) and "llm-scratch" in place
    assert not os.path.exists(place) and kept.count() == 2 and not [x for x in os.listdir(root) if x.startswith("llm-scratch")]


def test_pipeline_of_odd_rows_and_of_none(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, stage(spark, docs, sf)
            assert docs.columns[: len(before)] == before, name
    assert docs.count() == 0
