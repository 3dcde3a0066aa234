"""Cases that an earlier version of an operator left out."""

import math
import random
import re

from jarledger.llm import license_scan, secret_scan, toxicity_fst


def labelled(spark, toxic, clean):
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate([*toxic, *clean])]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t, _ in rows], "doc_id string, text string")
    return docs, spark.createDataFrame([(f"d{i}", m) for i, _, m in rows], "doc_id string, toxic int")


def words_with(n):
    """Texts of ordinary words; the number keeps them apart."""
    return [f"{w} tale number{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i, w in zip(range(n), ["plain", "long", "short", "old", "new"] * n)]


# ---------------------------------------------------------------- 10 toxicity

def test_toxic_terms_of_a_small_kind(spark):
    toxic = [f"{t} the idiot" for t in words_with(240)] + [f"{t} el{chr(97 + i)} zopenco" for i, t in enumerate(words_with(7))]
    model = toxicity_fst.fit(*labelled(spark, toxic, [f"{t} the friend {chr(97 + i % 26)}{chr(97 + i // 26)}" for i, t in enumerate(words_with(600))]))
    reader = toxicity_fst.Reader(model.words, model.stems)
    assert reader.kind("zopenco") == "insult"               # in at most 7 rows that are learned from
    assert reader.kind("the") == reader.kind("tale") == reader.kind("plain") == "other"


def test_terms_need_evidence_against_clean_texts():
    assert toxicity_fst.convincing({(3, 0): 40, (12, 0): 5, (30, 2): 1}, 5000, 0.5) == [(30, 2)]
    assert sorted(toxicity_fst.convincing({(4, 0): 40, (12, 0): 5}, 5000, 0.05)) == [(4, 0), (12, 0)]
    assert toxicity_fst.convincing({(40, 0): 9}, 50, 1.0) == toxicity_fst.convincing({}, 0, 0.5) == []


def test_clauses_are_read_whole():
    reader = toxicity_fst.Reader(["idiot"], [])
    far = ", some more words" * 40
    assert reader.readings(f"He wrote{far}, idiot{far}. idiot") == {"reported": 1, "bare": 1, "clauses": 2}
    assert reader.readings("idiot " + "x" * 229 + " an idiot you idiot") == {"bare": 1, "aimed": 1, "clauses": 1}
    assert reader.readings("idiotic\nan idiot") == {"bare": 1, "clauses": 1}


def test_threat_terms_and_their_targets():
    words, stems, threats = toxicity_fst.split_terms(["idiot", "tötet", "killjoys"], ["kill", "zope"])
    assert (words, stems, threats) == (["idiot"], ["zope"], (["tötet", "killjoys"], ["kill"]))
    reader = toxicity_fst.Reader(words, stems, threats)
    assert [reader.kind(w) for w in ("kills", "tötet", "destroy", "zopenco", "tale")] == ["threat", "threat", "threat", "insult", "other"]
    assert reader.readings("he that kills some day") == {"aimed": 1, "threat": 1, "clauses": 1}
    assert reader.readings("will destroy you") == {"aimed": 1, "threat": 1, "clauses": 1}
    assert reader.readings("will destroy a big old red tale of you") == {"threat": 1, "clauses": 1}
    assert reader.readings("will not kill you") == {"negated": 1, "clauses": 1}


def test_threat_terms_are_learned(spark):
    toxic = [f"{t} big{chr(97 + i % 26)}{chr(97 + i // 26)} kills" for i, t in enumerate(words_with(240))]
    model = toxicity_fst.fit(*labelled(spark, toxic, [f"{t} the friend {chr(97 + i % 26)}" for i, t in enumerate(words_with(600))]))
    assert toxicity_fst.Reader(model.words, model.stems, model.threats).kind("kills") == "threat"


def test_report_verbs_may_come_last():
    reader = toxicity_fst.Reader(["idiot"], [])
    assert reader.readings("you are an idiot, she said") == {"reported": 1, "clauses": 1}
    assert reader.readings("you are an idiot. she said") == {"aimed": 1, "clauses": 1}
    assert reader.readings("not an idiot, you idiot, he wrote of an idiot") == {"negated": 1, "reported": 1, "clauses": 1}


def plain_readings(text, insults, threats):
    """Clause by clause, word by word, by the rules and not by a machine."""
    out = {}
    for clause in re.split(r"[.!?;:\n\r]", text.lower()):
        kinds = []
        for word in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause):
            kinds.append("hit" if word in insults else "threat" if word in threats or word in toxicity_fst.THREATS else
                         "target" if word in toxicity_fst.TARGETS else "no" if word in toxicity_fst.NEGATIONS else
                         "report" if word in toxicity_fst.REPORTS else "")
        got, reported, hits, denied, aimed, waiting = set(), False, False, 0, 0, 0
        for kind in kinds:
            said = kind
            if kind == "no":
                denied, said = 3, ""
            else:
                if kind in ("hit", "threat") and denied:
                    got.add("negated")
                    said = ""
                denied = max(0, denied - 1)
            if said == "report":
                if hits and not reported:
                    got = got - {"aimed", "bare", "threat"} | {"reported"}
                reported, said = True, ""
            elif said in ("hit", "threat") and reported:
                got.add("reported")
                said = ""
            hits = hits or said in ("hit", "threat")
            if said == "target":
                if waiting:
                    got.add("aimed")
                aimed, waiting = 3, 0
            elif said == "hit":
                got.add("aimed" if aimed and not waiting else "bare")
                aimed, waiting = max(0, aimed - 1), max(0, waiting - 1)
            elif said == "threat":
                got.add("threat")
                if aimed and not waiting:
                    got.add("aimed")
                    aimed = aimed - 1
                else:
                    waiting, aimed = 3, 0
            else:
                aimed, waiting = max(0, aimed - 1), max(0, waiting - 1)
        if got:
            for g in (*got, "clauses"):
                out[g] = out.get(g, 0) + 1
    return out


def test_readings_equal_plain_rules():
    insults, threats, rng = {"idiot", "zopenco"}, {"kills"}, random.Random(8)
    reader = toxicity_fst.Reader(sorted(insults), [], (sorted(threats), []))
    words = ["idiot", "zopenco", "kills", "destroy", "you", "du", "not", "nie", "said", "dice", "tale", "red", "it's", "a", ".", "!", "\n", ","]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert dict(reader.readings(text)) == plain_readings(text, insults, threats), text


def test_toxicity_scores_equal_the_plain_sum(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity_fst.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    model = toxicity_fst.Model(model.words or ["the"], [], model.weights, model.base)     # whole words only
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in toxicity_fst.scores(docs, model).collect():
        found = plain_readings(texts[r["doc_id"]], set(model.words), set())
        x = [float(k in found) for k in toxicity_fst.READINGS] + [math.log1p(found.get("clauses", 0))]
        z = sum(a * b for a, b in zip(x, model.weights)) + model.base
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_terms_equal_plain_counts(spark):
    toxic = [f"{t} the idiot" for t in words_with(240)] + [f"{t} old fool {t.split()[-1]}" for t in words_with(90)]
    docs, _ = labelled(spark, toxic, [f"{t} the friend" for t in words_with(300)])
    got = {r["term"]: r["n"] for r in toxicity_fst.term_counts(docs).collect()}
    want = {}
    for r in docs.collect():
        words = set(re.findall(r"[^\W\d_]+", r["text"].lower()))
        for term in {"=" + w for w in words if len(w) >= 3} | {"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n}:
            want[term] = want.get(term, 0) + 1
    assert {t: n for t, n in want.items()} == {t: n for t, n in got.items()}


# ---------------------------------------------------------------- 4 licenses

def test_templates_come_from_a_table(spark):
    rows = spark.createDataFrame([("Free, to USE it", "free"), ("Free to use it", "free"), (None, "x"), ("..", "y"), ("a b", None)], "text string, label string")
    assert license_scan.templates_of(rows) == [("free to use it", "free")]
    try:
        license_scan.templates_of(spark.range(5).selectExpr("concat('w', id) AS text", "'l' AS label"), 4)
    except ValueError:
        return
    raise AssertionError("too many templates were taken")


def test_many_long_templates(spark):
    """Full-length templates that share most of their words, whole, cut and mixed."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(60)]
    templates = [(" ".join(rng.sample(common, 40) + [f"t{k}x{i}" for i in range(rng.randint(4, 30))]), f"l{k}") for k in range(24)]
    texts = []
    for i in range(40):
        words = templates[i % 24][0].split()
        rng.shuffle(words)
        texts.append(" ".join(["pad"] * (i * 3) + [w for w in words if rng.random() < 0.75 + 0.01 * (i % 20)] + ["pad"] * 9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs, [("no such phrase", "none")], templates).collect()}
    want = {i: brute_licenses(t, templates) for i, t in enumerate(texts)}
    assert {i: g[0] for i, g in got.items()} == {i: w for i, (w, _) in want.items()} and len({w for w, _ in want.values()}) > 5
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def brute_licenses(text, templates, block=32):
    w, labels, best = re.findall(r"[0-9a-z]+", text), set(), 0.0
    for t, label in templates:
        size, need = max(block, 2 * len(t.split())), math.ceil(0.8 * len(set(t.split())) - 1e-9)
        shared = max((len(set(w[i:i + size]) & set(t.split())) for i in range(len(w))), default=0)
        if shared >= need:
            labels.add(label)
            best = max(best, shared / len(set(t.split())))
    return ",".join(sorted(labels)), best


def test_license_blocks_begin_anywhere(spark):
    wide = "permission is hereby granted free of charge upon written request and at the sole discretion of holder to any person obtaining a copy"
    texts = [" ".join(f"x{j}" for j in range(i)) + " " + wide + " y" * (i % 5) for i in range(70)] + ["", wide]
    rng = random.Random(4)
    terms = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()})
    texts += [" ".join(w for w in wide.split() * 3 if rng.random() < 0.6) for _ in range(40)]
    texts += [" ".join(rng.choice(terms) if rng.random() < 0.7 else "z" for _ in range(300)) for _ in range(40)]
    long = (" ".join(f"term{i}" for i in range(60)), "long")
    texts += [" ".join(["of"] * i + [x for j in range(60) if j % 9 for x in (f"term{j}", *["the"] * (j % 2))]) for i in range(20)]
    templates = [*license_scan.TEMPLATES, long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs, [("no such phrase", "none")], templates).collect()}
    want = {i: brute_licenses(t, templates) for i, t in enumerate(texts)}
    assert {i: want[i][0] for i in range(70)} == {i: "mit" for i in range(70)} and "long" in {w for w, _ in want.values()}
    assert {i: g[0] for i, g in got.items()} == {i: w for i, (w, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


# ---------------------------------------------------------------- 2 secrets

def test_secret_keys_in_a_path():
    key = "kX93vQz7LmT2rB8dYw5HfN1cJs6PgA4u"
    text = f"at /reset-password/{key} or /a-b/{key}Zq0= and some-long/path_of-ordinary/words_only"
    runs = secret_scan.spans_of(text)[1]
    assert [text[a:b] for a, b, _, _ in runs] == [key, key + "Zq0="] and all(level >= 0 for _, _, _, level in runs)
    (start, end, _, _), = secret_scan.spans_of(key + "/" + key)[1]     # base64: one run
    assert (start, end) == (0, 2 * len(key) + 1)
