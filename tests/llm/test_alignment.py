"""Cross-tokenizer alignment against a plain loop over whole texts."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from jarledger.llm import token_alignment as ta
from conftest_rows import ROWS

A = Tokenizer.from_file(ta.MODEL_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=ta.MODEL_B)
#: The printable characters that byte-level vocabularies write bytes as.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def token_bytes(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    parts_a = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    parts_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, parts_a, parts_b


def ranges(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at := at + len(p)))
    return out


def brute_one(text):
    if not text:
        return "", 0, 0, 0, []
    a, b, parts_a, parts_b = token_bytes(text)
    whole = (" " + text).encode()
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return "", 0, 0, 0, []
    ra, rb = ranges(parts_a), ranges(parts_b)
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, i, j = [], 0, 0
    for c in cuts:
        x, y = i, j
        while i < len(ra) and ra[i][1] <= c:
            i += 1
        while j < len(rb) and rb[j][1] <= c:
            j += 1
        groups.append((a[x:i], b[y:j]))
    links, k = [], 0
    for (s, e), p in zip(ra, a):
        while k and rb[k][0] > s:
            k -= 1
        while rb[k][1] <= s:
            k += 1
        m = k
        while m < len(rb) and rb[m][0] < e:
            links.append((p, b[m]))
            m += 1
    shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return shown, len(a), len(b), len(groups), links


def brute(texts):
    found = [brute_one(t) for t in texts]
    counts = Counter(p for f in found for p in set(f[4]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(shown.encode()).hexdigest() if shown else "") for shown, n_a, n_b, n_groups, links in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_query_equals_a_plain_loop(spark, sf, texts):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.op11_cross_tokenizer(spark, sf).collect()}
    assert got == dict(zip(texts, brute(list(texts.values()))))


ODD = ["", " ", "  ", "\n", "a\nb", " x", "x ", "a  b\n\n c", "▁", "a ▁ b", "<|endoftext|> y", "<s> z", "don't we're 12ab3", "ﬁn ² Å", "é b c",
       "語の処理。 テスト", "🦜🦜 x", "a\tb\r\nc", "x\x00y", "word." * 30, "… ,…, ß, ×."]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(None, None, 0), (3, "\n", 1)], "doc_id long, text string, pairs long")
    rows = docs.collect()
    expected = sorted(zip(((r["doc_id"], r["text"]) for r in rows), brute([r["text"] for r in rows])), key=str)
    found = ta.alignment(docs)
    assert sorted(r["n_a"] for r in found.collect()) == sorted(x[0] for _, x in expected)
    assert sorted(rows_of(found)) == sorted(x for _, x in expected)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in found.collect() if r["n_a"])
    assert ta.alignment(docs.limit(0)).count() == 0


def test_odd_rows(odd_docs):
    found = ta.alignment(odd_docs).collect()
    assert len(found) == len(ROWS) and sum(r["n_a"] == 0 for r in found) == 3


@pytest.mark.parametrize("most", [0, 40, 3000])
def test_rare_pairs_are_joined(spark, sf, texts, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.alignment(docs, most=most).collect()}
    assert got == dict(zip(texts, brute(list(texts.values()))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_divide_and_conquer_finds_every_cut(steps, rng):
    total = sum(steps)
    a = [sum(steps[: i + 1]) for i in range(len(steps))]
    b = sorted({total, *(rng.randint(1, total) for _ in range(rng.randint(0, total)))})
    groups = ta.groups_between(a, b)
    cuts = sorted(set(a) & set(b))
    assert [a[j - 1] for _, j, _, _ in groups] == cuts and [b[l - 1] for *_, l in groups] == cuts
    assert groups[0][0] == groups[0][2] == 0 and all(x[1] == y[0] and x[3] == y[2] for x, y in zip(groups, groups[1:]))
    start = lambda e, i: e[i - 1] if i else 0
    expected = [(x, y) for x in range(len(a)) for y in range(len(b)) if start(a, x) < b[y] and start(b, y) < a[x]]
    assert [p for g in groups for p in ta.links_in(a, b, g)] == expected


def test_other_vocabularies_are_encoded_whole():
    with open(ta.MODEL_A, encoding="utf-8") as f, open(ta.MODEL_B, "rb") as g:
        aligner = ta.Aligner(json.dumps(json.load(f) | {"version": "1.0"}, indent=1), g.read())
    text = "Some words, and\nsome more."
    aligner.by_unit = False
    import pyarrow as pa
    whole = ta.align_slice(aligner, pa.array([text, None]))
    aligner.by_unit = True
    unit = ta.align_slice(aligner, pa.array([text, None]))
    assert whole[0] == unit[0] and (whole[1] == unit[1]).all() and (whole[2] == unit[2]).all()
