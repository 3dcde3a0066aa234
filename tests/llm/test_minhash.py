"""MinHash near-duplicate groups against all pairs of sets."""

import numpy as np
import pyarrow as pa
import pytest
from itertools import combinations

from jarledger.llm import minhash_index as mi
from jarledger.session import ship_package
from conftest_rows import ROWS


def set_of(text, size=2):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(rows, per_cent=80):
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for x, y in {p for h in holders.values() for p in combinations(h, 2)}:
        same = len(sets[x] & sets[y])
        if 100 * same >= per_cent * (len(sets[x]) + len(sets[y]) - same):
            root[find(x)] = find(y)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_query_equals_all_pairs(spark, sf, texts):
    got = mi.op12_minhash_near_dedup(spark, sf)
    assert rows_of(got) == brute(list(texts.items()))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def mutated(seed, n, rate, base=120):
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in rng.integers(0, 500, base)]
    return [" ".join(f"m{rng.integers(1 << 40)}" if rng.random() < rate else w for w in words) for _ in range(n)]


@pytest.mark.parametrize("block,small", [(4, 2), (256, 32), (256, 1000), (16, 1)])
def test_hot_groups_of_near_copies(spark, monkeypatch, block, small):
    """Chains, near misses and copies; other sizes of blocks and of small cells give the same."""
    monkeypatch.setattr(mi, "BLOCK", block)
    monkeypatch.setattr(mi, "SMALL", small)
    ship_package()
    some = [t for seed, rate in enumerate((0.01, 0.03, 0.05, 0.07, 0.1)) for t in mutated(seed, 40, rate)]
    some += [*some[:20], "", None, " \t", "one", "ONE", "two words", "Two  Words\n"]
    rows = list(enumerate(some))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(mi.near_groups(docs)) == brute(rows)


def test_pigeonhole_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(3)
    index = mi.Index(3, 5, 7)
    assert mi.chunk_errors(7, 3) == [2, 2, 1]
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 15).astype(np.uint16)
        b = a.copy()
        b[rng.choice(15, rng.integers(0, 8), replace=False)] += np.uint16(1)
        x, y = index.keys(np.stack([a, b]))
        common = np.flatnonzero(x == y)
        assert len(common) and index.first_common((a == b)[None])[0] == common[0]


def test_signature_distance_follows_the_similarity():
    texts = mutated(1, 60, 0.06, 300)
    sigs = mi.signatures(pa.array(texts), symbols=1024)
    for x, y in combinations(range(20), 2):
        a, b = set_of(texts[x]), set_of(texts[y])
        assert abs((sigs[x] == sigs[y]).mean() - len(a & b) / len(a | b)) < 0.08


def test_odd_rows(spark, odd_docs, no_docs):
    assert rows_of(mi.near_groups(odd_docs)) == brute([(r[0], r[1]) for r in ROWS])
    assert mi.near_groups(no_docs).count() == 0
    kept = mi.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, None, 7], key=str)


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
def test_keys_of_one_node_go(spark, batch):
    """Whatever the batches and partitions; the edges of a partition may stay."""
    rng = np.random.default_rng(batch)
    rows = sorted({(int(k), int(n)) for k, n in zip(rng.integers(0, 60, 90), rng.integers(0, 1000, 90))} | {(99, i) for i in range(20)})
    df = spark.createDataFrame(rows, "key long, node long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [(r["key"], r["node"]) for r in mi.shared_cells(df).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    keys = [k for k, _ in rows]
    want = {r for r in rows if keys.count(r[0]) > 1}
    assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 2 * 8
