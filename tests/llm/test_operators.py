"""Each operator against a brute-force version, and its defined cases on odd rows and an empty table."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jarledger.llm import (chunk_dedup, decontam, lang_mixture, license_scan, queries, secret_scan, sentencepiece_stream,
                           simhash_pivot, suffix_dedup, token_output, toxicity_fst)
from jarledger.llm.common import bounded_sample, components, sample_limit
from jarledger.session import shared_dir
from conftest_rows import LONG, ROWS


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- 1 SentencePiece

def test_sentencepiece_equals_the_library(spark, sf, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_stream.MODEL)
    for r in queries.op1_sentencepiece(spark, sf).collect():
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]])


def test_sentencepiece_streams_without_spaces(texts):
    encoder = sentencepiece_stream.Encoder(sentencepiece_stream.read_vocabulary())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_stream.MODEL)
    text = re.sub(r"\s", "", texts[3] + texts[5])[:3000]
    parts = list(encoder.stream(" " + text))
    assert len(parts) > 50 and [i for p in parts for i in p] == library.encode(text)


def test_unigram_viterbi_finds_the_best_sum():
    pieces = {300 + i: p for i, p in enumerate([" ", "a", "b", " a", "ab", "ba", " ab", "bab"])}
    scores = dict(zip(pieces, [-3.0, -2.0, -2.5, -3.5, -3.0, -2.75, -5.0, -4.0]))
    vocabulary = {"kind": "unigram", "size": 400, "byte": {b: b for b in range(256)}, "pieces": pieces, "scores": scores, "name": "test"}
    encoder = sentencepiece_stream.Encoder(vocabulary)

    def best(text):
        if not text:
            return 0.0
        return max(s + best(text[len(p):]) for p, s in ((pieces[i], scores[i]) for i in pieces) if text.startswith(p))

    for text in ("abab", "bab ab", "babababbbaab", "b aab"):
        got = [i for part in encoder.stream(" " + text) for i in part]
        assert "".join(pieces[i] for i in got) == " " + text
        assert sum(scores[i] for i in got) == pytest.approx(best(" " + text))


def test_sentencepiece_odd_rows(spark, odd_docs, no_docs):
    got = sentencepiece_stream.encode_texts(odd_docs, check=True)
    assert got.columns == [*odd_docs.columns, "ids", "n_tokens", "round_trip"]
    found = got.collect()
    assert len(found) == len(ROWS) and all(r["round_trip"] for r in found)
    assert all(r["n_tokens"] == 0 for r in found if not r["text"])
    assert sentencepiece_stream.encode_texts(no_docs).count() == 0
    ids = spark.createDataFrame([([1, -5, 99999999],), (None,)], "ids array<int>")
    assert [r[0] for r in ids.select(sentencepiece_stream.decode_column(spark, ids["ids"])).collect()] == ["", None]


# ---------------------------------------------------------------- 2 secrets

def test_secret_base_patterns():
    text = "Password: 'abc123def' x tokEN=ab secret = abcdefgh AKIA" + "Z9" * 9 + " AKIA12 " + "0f" * 12 + " deadbeef"
    base, _ = secret_scan.spans_of(text)
    assert [text[a:b] for a, _, b in base] == ["Password: 'abc123def", "secret = abcdefgh", "AKIA" + "Z9" * 9, "0f" * 12]
    assert secret_scan.spans_of("paſsword=abcdefgh")[0] == []     # letters in either case, no others


def test_secret_runs_are_told_from_words():
    rng = np.random.default_rng(7)
    alphabet = dict(secret_scan.ALPHABETS)["base62"]
    keys = ["".join(rng.choice(list(alphabet), 48)) for _ in range(60)]
    words = ["TheInternationalStandard2Organisation4Of" + w for w in ("Measures", "Letters", "Seasons")] * 20
    histogram, levels = {}, []
    for run in keys + words:
        (_, _, c, b), = secret_scan.spans_of("x " + run + " y")[1]
        histogram[c, b] = histogram.get((c, b), 0) + 1
        levels.append((c, b))
    lowest = secret_scan.thresholds(histogram)
    kept = [b >= lowest[c] for c, b in levels]
    assert sum(kept[:60]) > 50 and sum(kept[60:]) == 0


def plain_base(text):
    """Base spans character by character, without patterns."""
    out, lower, n = [], text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text), len(text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < n:
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(name, at):
                i = at + len(name)
                for quote in (1, 0):        # an optional sign is taken if the rest then fits, else left out
                    j = i + 1 if quote and text[i:i + 1] in ("'", '"') and i < n else i if not quote else None
                    if j is None:
                        continue
                    while text[j:j + 1] == " ":
                        j += 1
                    if text[j:j + 1] not in (":", "=") or j >= n:
                        continue
                    j += 1
                    while text[j:j + 1] == " ":
                        j += 1
                    if j < n and text[j] in "'\"":
                        j += 1
                    k = j
                    while k < n and text[k] in value:
                        k += 1
                    if k > j:
                        end = (k, k - j)
                        break
                if end:
                    break
        if end:
            if end[1] >= 6:
                out.append((at, 0, end[0]))
            at = end[0]
        else:
            at += 1
    for kind, head, alphabet, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < n:
            k = at
            if text.startswith(head, at):
                k = at + len(head)
                while k < n and text[k] in alphabet:
                    k += 1
            if k > at + len(head):
                out += [(at, kind, k)] * (k - at >= least)
                at = k
            else:
                at += 1
    return sorted(out)


def test_plain_base_spans_equal_patterns():
    rng = np.random.default_rng(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " ", " ", "=", ":", "'", '"', "abc", "deadbeef", "0f" * 13, "AKIA", "Z9" * 9, "x", "é", "ſ", "\n", "+/"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 14))))
        assert secret_scan.spans_of(text)[0] == plain_base(text), text


def plain_battery(run):
    """The tests of one run by their formulas, in plain arithmetic."""
    alphabet = secret_scan.ALPHABETS[secret_scan.infer(run)][1]
    n, m, v = len(run), len(alphabet), [alphabet.index(c) for c in run]
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum((v.count(i) - n / m) ** 2 / (n / m) for i in range(m))
    p_chi = tail((chi - (m - 1)) / math.sqrt(2 * (m - 1) * (1 - 1 / n)))
    high = [x >= m / 2 for x in v]
    a, b, turns = sum(high), n - sum(high), 1 + sum(x != y for x, y in zip(high, high[1:]))
    mu = 1 + 2 * a * b / n
    p_runs = 2 * tail(abs(turns - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))) if a and b else 2.0 ** (1 - n)
    mean = sum(v) / n
    p_serial = 2 * tail(abs(sum((x - mean) * (y - mean) for x, y in zip(v, v[1:])) / max(sum((x - mean) ** 2 for x in v), 1e-9)) * math.sqrt(n))
    q = secret_scan.prose_shares(alphabet).tolist()
    expected = m * sum(x * (1 - x) for x in q) + n * m * sum((x - 1 / m) ** 2 for x in q)
    spread = 2 * (m - 1) + 4 * n * m * m * (sum(x * (x - 1 / m) ** 2 for x in q) - sum(x * (x - 1 / m) for x in q) ** 2)
    return min(p_chi, p_runs, p_serial), tail((expected - chi) / math.sqrt(spread))


def test_secret_query_equals_plain_rules(spark):
    """Base spans by scanning, runs by splitting, the battery by its formulas, and Benjamini-Hochberg over all runs of a length class."""
    rng = np.random.default_rng(9)
    pick = lambda k, n: "".join(rng.choice(list(secret_scan.ALPHABETS[k][1]), n))
    texts = [f"see {pick(7, 40)} and {pick(2, 44)} or path/{pick(7, 32)}/x password={pick(7, 30)}" for _ in range(60)]
    texts += [f"{pick(2, 25)} {pick(3, 40)} theordinarywordsgoonandonwithoutanyspacebetweenthem{'a' * (i % 3)} {pick(0, 30)}" for i in range(40)]
    texts += ["TheInternationalStandardOrganisation4Of" + w for w in ("Measures", "Letters")] * 20 + [None, "", "1234567890" * 4]
    texts.append(" ".join(f"secret={pick(7, 12)}" for _ in range(500)))
    found, tests = [], {}
    for i, text in enumerate(texts):
        base = plain_base(text or "")
        runs = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
            body = m.group().rstrip("=")
            pieces = [(m.start(), m.end())] if any(set(body) <= set(a) for _, a in secret_scan.ALPHABETS) else [
                (m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[A-Za-z0-9+]{20,}={0,2}", m.group())]
            for x, y in pieces:
                run = text[x:y].rstrip("=")
                kinds = any(c.islower() for c in run) + any(c.isupper() for c in run) + any(c.isdigit() for c in run)
                if (kinds < 2 and (len(run) < 32 or not run.isalpha())) or any(s < y and x < e for s, _, e in base):
                    continue
                random, prose = plain_battery(run)
                p = 10 ** (-0.05 * min(399, int(-math.log10(max(prose, 1e-300)) / 0.05)))
                tests.setdefault(sum(len(run) >= c for c in (20, 24, 32, 48, 96)), []).append((p if 3 * random >= 0.01 else 1e9, i, x, y))
        found.append(base)
    added = {}
    for some in tests.values():
        some.sort()
        last = max((k for k, (p, *_) in enumerate(some, 1) if p <= 0.05 * sum(q <= p * 1.0000001 for q, *_ in some) / len(some)), default=0)
        for _, i, x, y in some[:last]:
            added.setdefault(i, []).append((x, 3, y))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: ([(s["start"], s["kind"], s["end"]) for s in r["base"]], sorted((s["start"], s["kind"], s["end"]) for s in r["added"]))
           for r in secret_scan.secrets(docs).collect()}
    assert got == {i: (b, sorted(added.get(i, []))) for i, b in enumerate(found)}
    assert sum(map(len, added.values())) > 100 and all(i < 100 for i in added)


def test_secret_query(spark, sf, texts):
    for r in queries.op2_secret_scan(spark, sf).collect():
        base = plain_base(texts[r["doc_id"]])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert not joined or set(joined.split(",")) <= set(r["spans"].split(","))


def test_secret_odd_rows(odd_docs, no_docs):
    assert secret_scan.secrets(odd_docs).count() == len(ROWS) and secret_scan.secrets(no_docs).count() == 0


# ---------------------------------------------------------------- 3 decontamination

def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(w[i:i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return out


def test_decontamination_with_short_and_repeated_items(spark, odd_docs, no_docs):
    items = [(1, " ".join(f"w{i}" for i in range(40))), (10, "short item"), (2, " ".join(f"w{i}" for i in range(5, 17))),
             (2, " ".join(f"w{i}" for i in range(5, 17))), (3, None), (4, ""), (None, "text of some")]
    texts = ["x " * 30 + " ".join(f"W{i}," for i in range(3, 20)) + " tail", "a short item, a Short Item!", "w1 w2 w3 w4 w5 w6 w7 w8 w9", None, "",
             " ".join(f"w{i}" for i in range(9)) + " x " + " ".join(f"w{i}" for i in range(30, 40)), LONG]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.contamination(docs, bench).collect()}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)
    assert decontam.contamination(odd_docs, bench).count() == len(ROWS)
    assert decontam.contamination(no_docs, bench).count() == 0
    none = bench.limit(0)
    assert {r["n_hit"] for r in decontam.contamination(odd_docs, none).collect()} == {0}
    kept = decontam.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.where("doc_id is null").count() == 0


def test_windows_with_the_same_items_meet_them_once(spark):
    """A passage of all items in many documents: rows follow (document, item) pairs, not windows."""
    passage = " ".join(f"p{i}" for i in range(60))
    bench = spark.createDataFrame([(i, f"{passage} own{i} word{i}") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"lead {passage} tail{i}") for i in range(40)], "doc_id long, text string")
    rows, shared, members = decontam.matches(docs, bench)
    assert shared.count() == 40 * 51 and shared.select("row_id", "items_as").distinct().count() == 40
    assert shared.select("items_as").distinct().join(members, "items_as").count() == 50
    got = decontam.contamination(docs, bench).collect()
    assert all(r["n_hit"] == 60 and len(r["items"]) == 50 for r in got)


# ---------------------------------------------------------------- 4 licenses

def test_license_odd_rows(spark, odd_docs, no_docs):
    got = license_scan.scan(odd_docs).collect()
    assert len(got) == len(ROWS) and {r["labels"] for r in got} == {""} and license_scan.scan(no_docs).count() == 0
    texts = ["Released under the MIT License. Under the MIT-License", "this work, licensed under GNU general public license version 3", "cc by"]
    rows = license_scan.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in rows] == [
        (2, 1, 5, "mit", "mit", 1.0), (0, None, None, "", "gpl-3", rows[1]["score"]), (0, None, None, "", "", 0.0)]
    assert 0.8 <= rows[1]["score"] < 1


# ---------------------------------------------------------------- 5 suffixes

def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common = "".join(rng.choice(list("abcdé \n"), 400))
    texts = ["".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 400, 30)]
    texts += [common[i:i + 120 + i] for i in range(0, 200, 7)] + [common + t for t in texts[:4]] + ["a" * 300, "xx" + "a" * 100, "", "ab" * 100]
    texts += [common * 3 + "z" + texts[3], texts[3]]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame([*rows, (None, common), (900, None)], "doc_id long, text string")
    want = suffix_dedup.brute_force([(i, t.encode()) for i, t in rows] + [(1 << 62, common.encode()), (900, b"")])
    want[None] = want.pop(1 << 62)
    for block, piece in ((1 << 20, 1 << 20), (700, 1 << 20), (700, 150)):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.removed(docs, block_bytes=block).collect()}
        assert got == want
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed(docs, block_bytes=700, digit_bits=8, keep=False).collect()}
    assert got == want      # digits that collide all the time decide nothing


def test_suffix_dedup_odd_rows(odd_docs, no_docs):
    got = suffix_dedup.removed(odd_docs)
    assert got.count() == len(ROWS) and got.where("doc_id = 6 and n_removed > 0").count() == 0
    assert suffix_dedup.removed(no_docs).count() == 0


# ---------------------------------------------------------------- 6 token files

def test_token_files(spark, sf, texts):
    model = Tokenizer.from_file(token_output.MODEL)
    start = 0
    for r in queries.op6_token_output(spark, sf).orderBy("doc_id").collect():
        ids = np.array(model.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_pieces_equal_whole_texts():
    with open(token_output.MODEL, encoding="utf-8") as f:
        tokens = token_output.Tokens(f.read())
    for text in ["  a  b \n c", "don't we're  x\n\n y.", "<|endoftext|> a 12ab3 _x", " ", "\n", "é à b  \t c", "a ", " a", "a \n", "hi!!! 'tis ***", "x  y  z", ROWS[-1][1]]:
        assert np.frombuffer(tokens.encode(text), tokens.type).tolist() == tokens.model.encode(text, add_special_tokens=False).ids


def test_token_shard_reads_one_document_and_checks_it(spark, odd_docs, no_docs):
    folder = shared_dir(spark, "llm", "test_tokens")
    manifest = token_output.write_ids(odd_docs, folder)
    assert sum(r["n_docs"] for r in manifest.collect()) == len(ROWS)
    shards = [token_output.Shard(r["file"]) for r in manifest.collect()]
    assert sum(len(s.find(6)) for s in shards) == 2 and sum(len(s.find(None)) for s in shards) == 1
    assert [x.tolist() for s in shards for x in s.find(1)] == [[0]]
    name = manifest.first()["file"].replace("file:", "")
    raw = bytearray(open(name, "rb").read())
    shard = token_output.Shard(name)
    raw[int(shard.at[1]) - 5] ^= 255
    open(name, "wb").write(bytes(raw))
    with pytest.raises(Exception):
        token_output.Shard(name).ids(0)
    assert token_output.read_ids(token_output.write_ids(no_docs, folder)).count() == 0


# ---------------------------------------------------------------- 7 language

def test_language_accuracy_and_odd_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op7_language_id(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    model = lang_mixture.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    got = lang_mixture.predict(odd_docs, model).collect()
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2)} == {"und"}
    assert lang_mixture.predict(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in lang_mixture.predict(odd_docs, lang_mixture.fit(no_docs)).collect()} == {"und"}


def test_samples_hold_about_their_rows_at_any_size(spark):
    for total in (10**4, 10**7, 10**11, 10**15):
        limit = sample_limit(2000, total)
        assert total * (limit + 2**63) / 2**64 == pytest.approx(2000, rel=1e-3)
    rows = spark.range(200_000)
    assert 1700 < bounded_sample(rows, rows["id"], 2000, 200_000).count() < 2300
    assert bounded_sample(rows, rows["id"], 200_000, 200_000).count() == 200_000


def test_language_sample_is_one_scan_and_balanced(spark):
    rows = [(i, "some words here", "abcde"[(i > 4000) + (i % 7 == 0) * 2 + (i == 5)]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    counts = lang_mixture.slot_counts
    lang_mixture.slot_counts = lambda sample: seen.append(sample) or counts(sample)
    try:
        lang_mixture.fit(docs, 100)
    finally:
        lang_mixture.slot_counts = counts
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    held = {r["lang"]: r["count"] for r in seen[0].groupBy("lang").count().collect()}
    assert set(held) == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5} and max(held.values()) < 160


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    model = lang_mixture.Model(["a"], np.ones(1), np.arange(lang_mixture.TABLE) % 7, np.ones((7, 1)))
    text = "Some é words — and more. " * 50
    want = lang_mixture.profile_counts(pa.array([text, ""]), model)[0]
    monkeypatch.setattr(lang_mixture, "PIECE", 13)
    assert (lang_mixture.profile_counts(pa.array([text]), model)[0] == want).all()


def brute_language(texts, known):
    """The mixture model with one long row for each text and no rounding but the operator's own."""
    grams = lambda t: [
        bytes(x) for x in zip(*(lambda c: (c, c[1:], c[2:]))([lang_mixture.CLASS[b] for b in b" " + t.encode() + b" "])) if bytes(x) != b"   "]
    slot = lambda g: ((int.from_bytes(g, "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 17
    names = sorted({lang for _, lang in known})
    counts = {n: [0] * lang_mixture.TABLE for n in names}
    for t, lang in known:
        for g in grams(t):
            counts[lang][slot(g)] += 1
    logs = {n: [np.log((c + .5) / (sum(counts[n]) + .5 * lang_mixture.TABLE)) for c in counts[n]] for n in names}
    prior = np.array([sum(x[1] == n for x in known) for n in names]) / len(known)

    def em(ratios, share):
        for _ in range(lang_mixture.ROUNDS):
            mix = ratios * share
            share = (mix / mix.sum(1, keepdims=True)).mean(0)
        return share, np.log((ratios * share).sum(1)).sum()

    out = []
    for t in texts:
        if not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        raw = np.array([[logs[n][slot(g)] for n in names] for g in grams(t)])
        ratios = np.exp(-np.minimum(np.rint(raw.max(1, keepdims=True) - raw), 6))
        full, _ = em(ratios, prior)
        best, pick = np.inf, full
        for k in range(1, min(3, len(names)) + 1):
            start = np.zeros(len(names))
            top = np.argsort(-full, kind="stable")[:k]
            start[top] = np.maximum(full[top], 1e-6)
            share, fit = em(ratios, start / start.sum())
            cost = -2 * fit + 2 * (2 * k - 1) * np.log(max(len(ratios) / 3, 2))
            if cost < best:
                best, pick = cost, share
        out.append((names[int(pick.argmax())], float(pick.max())))
    return out


def test_language_equals_a_plain_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    rows = docs.collect()
    known = [(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = brute_language([r["text"] or "" for r in rows], known)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_mixture.predict(docs, lang_mixture.fit(docs)).collect()}
    for r, (lang, score) in zip(rows, want):
        assert got[r["doc_id"]][0] == lang and got[r["doc_id"]][1] == pytest.approx(score, abs=1e-6)


def test_mixture_finds_both_languages():
    ratios = np.array([[1, .01], [.01, 1], [1, 1]])
    model = lang_mixture.Model(["a", "b"], np.array([.5, .5]), np.zeros(1, int), ratios)
    share = lang_mixture.infer(np.array([[300., 100, 50], [400, 0, 50], [0, 0, 9]]), model)
    assert share[0] == pytest.approx([.755, .245], abs=.02) and share[1, 0] == pytest.approx(1) and share[2].sum() == pytest.approx(1)


# ---------------------------------------------------------------- 8 exact dedup

def test_exact_dedup_odd_rows(spark, odd_docs, no_docs):
    got = chunk_dedup.groups(odd_docs)
    assert rows_of(got.where("doc_id in (4, 5)"), "doc_id", "keep_id", "group_size", "kept") == [(4, 5, 2, False), (5, 5, 2, True)]
    assert rows_of(got.where("doc_id = 6"), "kept") == [(False,), (True,)]
    assert rows_of(got.where("doc_id in (1, 2)"), "doc_id", "keep_id") == [(1, 2), (2, 2)]
    kept = chunk_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "5", "6", "7", "None"]
    assert chunk_dedup.groups(no_docs).count() == 0 and chunk_dedup.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("values", [1, 16])
def test_exact_dedup_when_hashes_collide(spark, values):
    texts = ["Ab. " * 400 + str(i % 5) for i in range(12)] + ["x", "X", "y", "", None, "Ab. " * 300, "x. " * 300] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    narrow = lambda c: F.pmod(F.xxhash64(c), F.lit(values))
    want = rows_of(chunk_dedup.groups(docs, 64, 512), "doc_id", "keep_id", "group_size", "kept")
    normal = [(t or "").lower() for t in texts]
    last = {t: i for i, t in enumerate(normal)}
    assert want == sorted((i, last[t], normal.count(t), last[t] == i) for i, t in enumerate(normal))
    assert rows_of(chunk_dedup.groups(docs, 64, 512, narrow), "doc_id", "keep_id", "group_size", "kept") == want


def test_chunks_join_to_the_text(spark):
    texts = [LONG, "", "a", "x" * 20000, "Sentence one. " * 900, ("é\n" * 700 + ", ") * 9, "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chunk_dedup.chunks(df["t"], 64, 512).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(len(c) <= 512 for c in r["c"])


# ---------------------------------------------------------------- 9 SimHash

def plain_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=4):
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    for r in queries.op9_simhash_near_dedup(spark, sf).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])


@pytest.mark.parametrize("limit", [4096, 8])
def test_simhash_links_of_a_dense_cluster(spark, limit):
    rng = np.random.default_rng(5)
    fps = set()
    for center in rng.integers(0, 1 << 63, 4):
        for _ in range(60):
            flips = rng.choice(64, int(rng.integers(0, 6)), replace=False)
            fps.add(int(center) ^ sum(1 << int(b) for b in flips))
    named = {simhash_pivot.signed(f): f for f in fps}
    want = plain_components({s: f for s, f in named.items()})
    found = components(simhash_pivot.links(spark.createDataFrame([(s,) for s in named], "fp long"), cell_limit=limit))
    root = {r["node"]: r["root"] for r in found.collect()}
    assert {s: root.get(s, s) for s in named} == want


def test_simhash_odd_rows(odd_docs, no_docs):
    kept = simhash_pivot.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "7", "None"]
    assert simhash_pivot.near_groups(odd_docs).count() == len(ROWS) and simhash_pivot.keep_one(no_docs).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# ---------------------------------------------------------------- 10 toxicity

def test_grammar_readings():
    reader = toxicity_fst.Reader(["idiot"], ["mor"])
    assert reader.readings("You are an idiot. Nice day.") == {"aimed": 1, "clauses": 1}
    assert reader.readings("what a moron\nthey said idiot") == {"bare": 1, "reported": 1, "clauses": 2}
    assert reader.readings("she is not an idiot; an idiotic tumor") == {"negated": 1, "clauses": 1}
    assert reader.readings("") == {} and toxicity_fst.Reader([], []).readings("idiot") == {}


def test_toxicity_held_out(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op10_toxicity(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = sum(r["predicted"] for r in held if labels[r["doc_id"]])
    assert caught >= 0.65 * sum(labels[r["doc_id"]] for r in held)
    assert sum(r["predicted"] for r in held if not labels[r["doc_id"]]) <= 0.01 * len(held)
    model = toxicity_fst.Model(["twice"], [], [9.0] * 6, -5.0)
    kept = toxicity_fst.reject(odd_docs, model)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "6", "6", "7", "None"]
    assert toxicity_fst.scores(no_docs, model).count() == 0
    empty = toxicity_fst.fit(odd_docs, spark.createDataFrame([(4, 0), (5, None)], "doc_id long, toxic int"))
    assert {r["score"] < 0.01 for r in toxicity_fst.scores(odd_docs, empty).collect()} == {True}
