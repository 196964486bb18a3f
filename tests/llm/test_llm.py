"""Small cases: nulls, empty and repeated texts, empty tables, brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from roadspark.llm import _kernel as K
from roadspark.llm import chat, fingerprints, jaccard, langid, licenses, mixing, packing, topk
from roadspark.llm._spark import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [(1, LONG, "en", "a", 1), (2, LONG + " tail", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "one two", "en", "b", 7), (6, "ONE two", "en", None, 7), (None, LONG, "en", "a", 1)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(docs, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.Join(docs).members().collect()}
    assert got == {(1, 56): 1, (2, 57): 1, (3, 0): 3, (4, 0): 4, (5, 1): 5, (6, 1): 5, (None, 56): 1}
    assert jaccard.Join(empty).members().count() == 0


def test_fingerprints(docs, empty):
    rows = {r.doc_id: r for r in fingerprints.with_next(docs.select("doc_id", "text")).collect()}
    assert len(rows) == 7 and rows[1].fingerprint == rows[None].fingerprint and rows[3].near_edited == 1.0
    assert fingerprints.likeness(rows[1].fingerprint, rows[2].fingerprint) == pytest.approx(rows[1].near_next) and rows[1].near_next > 0.9
    assert fingerprints.with_next(empty.select("doc_id", "text")).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs, Scratch(spark, "t")).collect()
    assert len(rows) == 7 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=3)
    assert mixing.mix(empty, Scratch(spark, "t")).count() == 0


def test_packing(docs):
    rows = packing.pack(docs, size=16).collect()
    line = sorted((r.sequence_id * 16 + r.offset, r.length) for r in rows)
    assert line[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(line, line[1:]))
    words = packing.Words(packing.vocabulary_path())
    texts = ["It's 12½ ЖЖ 中文 <|endoftext|> é don't WE'LL a_b\tc", "", "  "]
    for _, _, data, offsets in K.chunks(pa.array(texts)):
        ids, ends = words(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_licenses(docs, empty, spark):
    found = licenses.scan(spark.createDataFrame([(1, "x\nReleased under the MIT License. CC-BY"), (2, None)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].labels == "cc-by,mit" and rows[1].first_word == 6 and rows[2].labels == "" and rows[2].first_word is None
    assert licenses.scan(empty).count() == 0


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)"
    bsd = "Redistribution and use in source and binary forms, with or without\n  modification, are permitted provided that the following conditions\n  are met:"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\r\n// License, v. 2.0. If a copy"
    filler = "\n".join(["word " * 9] * 300)
    far = "released\n" + filler + "\nunder\n" + filler + "\nthe\nMIT\n" + filler + "\nlicense"
    texts = [mit, bsd, mpl, "x released under\n the MIT license", filler + mit + filler, far, "word " * 20_000 + "Released under the MIT License " + "word " * 20_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(rows).collect()}
    assert [got[i][0] for i in range(7)] == ["mit", "bsd", "mpl", "mit", "mit", "", "mit"]
    assert got[0][1] == got[1][1] == got[2][1] == got[3][1] == 1.0 and got[5][1] == 0.0


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "a", "hi"), (1, 1, "b", None), (1, None, "system", "s"), (None, 0, None, "x")], "conv_id long, turn int, role string, text string")
    for r in chat.dialogues(turns).collect():
        assert all(r.text[m.start : m.end].endswith("<|end|>") for m in r.masks) and r.masks


def test_topk(spark):
    x = np.random.default_rng(1).standard_normal((300, 4))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (350, [float("nan")] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", block=32, group=2).collect()
    n = np.floor(256 * x).astype(int)
    for q in range(0, 300, 50):
        want = sorted(((-int(n[q] @ n[j]), j) for j in range(300) if j != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_language(docs, empty):
    model = langid.Model(["x", "y"], np.ones((2, langid.BUCKETS)), np.ones((2, langid.SCRIPTS)))
    assert langid.label(pa.array([None, "12 3", "abc"]), model)[0] == ["und", "und", "x"]
    assert langid.train(empty) is None


def test_many_languages(spark):
    rng = np.random.default_rng(5)
    words = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(8)] for i in range(100)}
    rows = [(100 * k + i, " ".join(rng.choice(own, 30)), lang, "s", 0) for i, (lang, own) in enumerate(words.items()) for k in range(6 if i < 70 else 4)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == sorted(words)
    assert langid.label(pa.array([" ".join(own) for own in words.values()]), model)[0] == list(words)


def test_viterbi():
    rng, penalty, bounds = np.random.default_rng(0), 4.0, [0, 3, 3, 7]
    for _ in range(100):
        scores = rng.normal(0, 8, (7, 3))
        got = langid.viterbi(scores, np.array(bounds), penalty)
        for a, b in zip(bounds, bounds[1:]):
            def gain(path, a=a):
                return sum(scores[a + i, x] for i, x in enumerate(path)) - penalty * sum(x != y for x, y in zip(path, path[1:]))
            assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=b - a), key=gain)


def test_jaccard_repeated_id():
    def link(first, second):
        texts = pa.RecordBatch.from_pydict({"key": [1, 1, 1], "salt": [0, 0, 0], "role": [0, 0, 1], "doc_id": [1, 1, 2], "text": [first, second, LONG + " tail"]})
        return [b.to_pylist() for b in jaccard._verify(jaccard.WIDTH, jaccard.PERCENT)(iter([texts]))]

    other = " ".join(f"v{i}" for i in range(60))
    assert link(LONG, other) == link(other, LONG) == [[{"a": 1, "b": 2}]]


def test_jaccard_brute_force(spark):
    rng, texts = np.random.default_rng(3), []
    for _ in range(8):
        words = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(60, 200)))]
        for edits in range(5):
            texts.append(" ".join(words))
            words[int(rng.integers(0, len(words)))] = f"e{edits}"
    sets = []
    for text in texts:
        words = text.split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.Join(docs).members().collect()} == dict(enumerate(comp))
