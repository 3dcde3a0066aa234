"""The Merkle manifest against a plain loop over sorted rows, and appends against a build at once."""

import hashlib
import zlib

import pytest

from jarledger.llm import merkle_manifest as mm
from conftest_rows import ROWS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, width):
    """Levels of nodes from the leaves to one node."""
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i: i + width]) for i in range(0, len(level), width)]
        levels.append(level)
    return levels


def side(levels, i, width):
    """For each level: the run around node i, and its place there."""
    for level in levels[:-1]:
        begin = i // width * width
        yield level[begin: begin + width], i - begin
        i //= width


def brute(rows, width):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])], width) for s in names]
    top = climb([t[-1][0] for t in trees], width)
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = [*side(trees[k], i, width), *side(top, k, width)]
            proof = h(*(x for run, at in steps for j, x in enumerate(run) if j != at))
            node = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                node = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for run, at in steps:
                node = h(*run[:at], node, *run[at + 1:])
            out.append((r["doc_id"], leaf, trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_equals_a_plain_loop(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(mm.op13_merkle_manifest(spark, sf))
    assert got == brute(docs, 16) and 0 < sum(not r[-1] for r in got) < len(got)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, tree string, n int"


@pytest.mark.parametrize("width,height,n", [(2, 1, 1), (2, 2, 21), (3, 2, 82), (2, 3, 64), (16, 2, 300)])
def test_shapes(spark, width, height, n):
    rows = [(i, "abc"[i % 3] if i % 7 else None, "en", i, f"Text {i}", 1, "t", 2) for i in range(n)] + [(n, "é", None, None, "", 1, "t", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mm.proofs(mm.build(docs, width, height), width, height)
    got = rows_of(found.withColumn("verified", found["folded_root"] == found["root"]))
    assert got == brute([r.asDict() for r in docs.collect()], width)


def test_append_equals_a_build_at_once(spark):
    rows = [(i, "ab"[i % 5 == 0], "en", i, f"Text {i}", 1, "t", 2) for i in range(60)]
    late = [(100 + i, "abc"[i % 3], "en", i, f"Late {i}", 1, "t", 2) for i in range(40)]
    first = mm.build(spark.createDataFrame(rows, SCHEMA), 3, 2)
    both = mm.append(first, spark.createDataFrame(late, SCHEMA), 3, 2)
    once = mm.build(spark.createDataFrame(rows + late, SCHEMA), 3, 2)
    assert both.root() == once.root() != first.root()
    f = lambda m: sorted(tuple(r) for r in mm.proofs(m, 3, 2).collect())
    assert f(both) == f(once)
    with pytest.raises(ValueError):
        mm.append(both, spark.createDataFrame(rows[:1], SCHEMA), 3, 2)


def test_odd_rows(spark):
    rows = [(i, "s", lang, n, text, 0, x, 1) for i, text, lang, n, x in ROWS] + [(None, None, None, None, None, 0, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mm.proofs(mm.build(docs))
    assert rows_of(found.withColumn("verified", found["folded_root"] == found["root"])) == brute([r.asDict() for r in docs.collect()], 16)
    none = mm.build(docs.limit(0))
    assert none.root() is None and mm.proofs(none).count() == 0
