"""Brute force of the queries without SQL, on whole tables of sf0.001, and edge cases of every operator."""

import hashlib
import itertools
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from roadspark.llm import _kernel as K
from roadspark.llm import chat, fingerprints, jaccard, langid, licenses, mixing, packing, quality, topk
from roadspark.llm._spark import Scratch, table

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, p double, _n int, _id long, row string, key long, n long, component long, copy int"


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.asDict() for r in table(spark, SF, "documents").collect()]


def odd_rows():
    """Nulls in every column, empty, repeated and very long texts, ties."""
    words = "the of and to in is that for it was on are as with".split()
    long = " ".join(itertools.islice(itertools.cycle(words), 120_000))
    texts = [None, "", " \n\t", "12 3", long, long, "a b", "a b", " ".join(words), "A " * 7]
    rows = [(k % 7 if k % 5 else None, t, "en" if k % 3 else None, "s" if k % 2 else None, k) for k, t in enumerate(texts)]
    return [(*r, -7.0, -8.0, 3, 4, "r", 5, 6, 7, 8) for r in rows + rows[-3:]]


def test_fingerprints_brute_force(spark, corpus):
    got = {r.doc_id: r for r in fingerprints.query(spark, SF).collect()}
    order = sorted(corpus, key=lambda r: r["doc_id"])
    for k, r in enumerate(order):
        text, after = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        need = len(text) // 4
        edited = text[: len(text) - need] + after[:need]
        mine = got[r["doc_id"]]
        assert (mine.n_chars, mine.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        one, two, three = fingerprints.fingerprints([text, edited, after])
        assert (mine.fingerprint, mine.edited_fingerprint) == (one.text, two.text)
        assert mine.near_next == fingerprints.likeness(one.text, three.text)
        assert (mine.edited_paragraphs == 0) == (text == edited)
    assert len(got) == len(order)


def test_differing_locates_edits():
    lines = [f"line {k} has some words" for k in range(40)]
    prints = lambda t: fingerprints.fingerprints(["\n".join(t)])[0].text
    whole = prints(lines)

    def flat(text, places):
        sections = [s.partition(":")[2].split(",") for s in text.partition("|")[2].split(";")]
        return [sum(map(len, sections[:i])) + j for i, j in places]

    changed = [*lines]
    changed[17] = "another line"
    assert flat(prints(changed), fingerprints.differing(prints(changed), whole)) == [17]
    assert flat(whole, fingerprints.differing(whole, prints(lines[:5] + lines[6:]))) == [5]
    assert flat(prints(lines[:5] + lines[6:]), fingerprints.differing(prints(lines[:5] + lines[6:]), whole)) == [5]
    for other in (lines[1:] + lines[:1], lines[:-1], [*lines, "more"], [x + " " for x in lines], lines[:20] + [lines[20] + "  "] + lines[21:]):
        assert fingerprints.differing(prints(other), whole) and fingerprints.differing(whole, prints(other))
    assert fingerprints.differing(whole, whole) == [] and fingerprints.differing(prints(["a b"]), prints(["a  b"])) == [(0, 0)]


def test_packing_brute_force(spark, corpus):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows, ids = defaultdict(list), {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in corpus}
    found = packing.query(spark, SF).collect()
    for r in found:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        rows[r.doc_id].append((r.start, r.length))
    for doc, pieces in rows.items():
        ends = [0, *itertools.accumulate(n for _, n in sorted(pieces))]
        assert [s for s, _ in sorted(pieces)] == ends[:-1] and ends[-1] == len(ids[doc])
    line = sorted((r.sequence_id, r.offset, r.length) for r in found)
    total, place = sum(map(len, ids.values())), 0
    for s, o, n in line:
        assert s * 2048 + o == place and o + n <= 2048
        place += n
    assert set(rows) == set(ids) and place == total and line[-1][0] + 1 == -(-total // 2048)
    # neighbours on the curve: documents follow each other by their Hilbert key
    keys = {}
    for k, x in ids.items():
        keys[k] = int(packing.keys(np.array(x, np.uint16), np.array([0, len(x)]))[0])
    order = [keys[r.doc_id] for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert order == sorted(order)


def test_packing_other_vocabulary(tmp_path):
    """Ids beyond 16 bits, and steps that aren't the contract's vocabulary's."""
    from tokenizers import models, pre_tokenizers

    made = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)} | {"[UNK]": 70_000}, "[UNK]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "v.json"))
    words = packing.Words(str(tmp_path / "v.json"))
    for _, _, data, offsets in K.chunks(pa.array(["w69999 w3 other", None])):
        ids, ends = words(data, offsets)
        assert ids.tolist() == [69999, 3, 70000, 1, 1] and ends.tolist() == [0, 4, 5] and ids.dtype == np.uint32


def test_hilbert():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    at = packing.hilbert(points, 3)
    walk = points[np.argsort(at)]
    assert sorted(at.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute_language(docs):
    """The model and its labels, word by word in plain Python."""
    def grams(word):
        x = b" " + word + b" "
        return [int(v) for v in langid._grams(np.frombuffer(x, np.uint8))]

    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    script = lambda w: max((int(langid.script_table()[ord(c)]) for c in w.decode()), default=-1)
    out = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 4 == 2
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and not out(r["doc_id"]):
            words = [w for w in lower(r["text"]).translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
            x = b" " + lower(r["text"]) + b" "
            counts[r["lang"]].update(int(v) for v in langid._grams(np.frombuffer(x, np.uint8)))
            for w in words:
                if script(w) >= 0:
                    scripts[r["lang"]][script(w)] += 1
    langs = sorted(counts)
    score = np.array([[np.log((counts[x][b] + 0.1) / (sum(counts[x].values()) + 0.1 * langid.BUCKETS)) for b in range(langid.BUCKETS)] for x in langs])
    score -= score.mean(0)
    result = {}
    for r in docs:
        words = [w for w in lower(r["text"] or "").translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
        if not any(unicodedata.category(c).startswith("L") for c in r["text"] or ""):
            result[r["doc_id"]] = (out(r["doc_id"]), "und", 0.0)
            continue
        best, back = None, []
        for w in words:
            s = score[:, grams(w)].sum(1) if script(w) >= 0 else np.zeros(len(langs))
            if script(w) >= 0:
                used = [scripts[x][script(w)] >= langid.SEEN * max(1, sum(scripts[x].values())) for x in langs]
                s = s + np.where(used, 0, langid.FOREIGN) if any(used) else s
            if best is None:
                best = s
            else:
                come = best.max() - langid.SWITCH > best
                back.append(np.where(come, best.argmax(), np.arange(len(langs))))
                best = np.maximum(best, best.max() - langid.SWITCH) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        held = Counter(p for p, w in zip(path, words) if script(w) >= 0)
        most = max(held.values())
        result[r["doc_id"]] = (out(r["doc_id"]), langs[min(k for k, v in held.items() if v == most)], most / sum(held.values()))
    return result


def test_language_brute_force(spark, corpus):
    want = brute_language(corpus)
    got = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    assert set(got) == set(want)
    same = sum((r.held_out, r.lang_pred) == want[d][:2] and r.score == pytest.approx(want[d][2], abs=0.01) for d, r in got.items())
    assert same == len(want)
    known = [r for r in corpus if r["lang"] is not None and got[r["doc_id"]].held_out and got[r["doc_id"]].lang_pred != "und"]
    assert sum(got[r["doc_id"]].lang_pred == r["lang"] for r in known) >= 0.95 * len(known)


def test_language_without_letters():
    model = langid.Model(["x", "y"], np.ones((2, langid.BUCKETS)), np.ones((2, langid.SCRIPTS)))
    none = ["3 × 4", "÷", "。、", "،", "١٢٣", "१२३", "12 3", "", None, "́", "😀 ☃"]
    some = ["ª 1", "あ", "ż", "ב", "한", "𠀀", "ⲁ", "Ω 3", "x"]
    assert langid.label(pa.array(none + some), model)[0] == ["und"] * len(none) + ["x"] * len(some)


def test_script_narrows():
    scripts = np.zeros((2, langid.SCRIPTS))
    scripts[0, 0], scripts[1, 2] = 10, 10
    model = langid.Model(["latin", "cyrillic"], np.ones((2, langid.BUCKETS)), scripts)
    assert langid.label(pa.array(["abc где", "где", "λόγος"]), model)[2] == [[(0, 0, "latin"), (1, 1, "cyrillic")], [(0, 0, "cyrillic")], [(0, 0, "latin")]]
    assert langid.label(pa.array(["где", "abc"]), model)[0] == ["cyrillic", "latin"]


def test_quality_brute_force(spark, corpus):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    p = {d: r.p for d, r in got.items()}
    # evidence: the fitted classifier's own outputs, then both levels of shrinkage by hand
    known = [r for r in corpus if label.get(r["doc_id"]) is not None]
    x = quality.features(pa.array([r["text"] for r in known], pa.string()))
    model = quality.Classifier(x, np.array([label[r["doc_id"]] for r in known], float))
    for r, mine in zip(known, model(x)):
        assert p[r["doc_id"]] == pytest.approx(mine, abs=1e-6)
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in corpus:
        hosts[r["source"]].append(p[r["doc_id"]])
        paths[r["source"], r["lang"]].append(p[r["doc_id"]])
    rate = sum(p.values()) / len(p)

    def strength(rows):
        rows = [(sum(v) / len(v), a, len(v)) for v, a in rows if len(v) >= 2]
        between = np.mean([(r - a) ** 2 for r, a, _ in rows]) - np.mean([a * (1 - a) / n for _, a, n in rows])
        return quality.HIGH if between <= 0 else min(quality.HIGH, max(quality.LOW, np.mean([a * (1 - a) for _, a, _ in rows]) / between - 1))

    k1 = strength([(v, rate) for v in hosts.values()])
    k2 = strength([(v, (sum(hosts[h]) + k1 * rate) / (len(hosts[h]) + k1)) for (h, _), v in paths.items()])
    logit = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    for r in corpus:
        own, h, v = p[r["doc_id"]], hosts[r["source"]], paths[r["source"], r["lang"]]
        host = (sum(h) - own + k1 * rate) / (len(h) - 1 + k1)
        path = (sum(v) - own + k2 * host) / (len(v) - 1 + k2)
        odds = logit(own) + logit(path) - logit(rate)
        mine = got[r["doc_id"]]
        assert (mine.host_rate, mine.path_rate, mine.quality) == pytest.approx((host, path, 1 / (1 + np.exp(-odds))), abs=1e-9)
        assert mine.keep == (mine.quality >= quality.THRESHOLD)


def test_topk_prunes_before_the_shuffle(spark):
    """Clusters far apart: most groups are ruled out by their summaries; ties and repeated ids count as SQL has it."""
    rng = np.random.default_rng(2)
    center = rng.choice([-8.0, 8.0], (20, 6))
    x = np.repeat(center, 40, axis=0) + rng.normal(0, 0.1, (800, 6))
    x[5], x[6] = x[7], x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[3].tolist()), (50, x[9].tolist()), (900, [1.0, float("inf")]), (901, None), (None, [1.0] * 6), (950, [1.0, 2.0]), (902, [None] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    search = topk.Search(frame, F.col("vec_id") % 50 == 0, block=10, group=2)
    got = defaultdict(list)
    for r in search.run().collect():
        got[r.query_id].append((r["rank"], -r.score, r.vec_id))
    n = np.floor(256 * x).astype(int)
    every = [(i, n[i]) for i in range(800)] + [(100, n[3]), (50, n[9])]
    for q in range(0, 800, 50):
        want = sorted((-int(v @ w), i) for j, v in every if j == q for i, w in every if i != q)[:5]
        assert [(s, i) for _, s, i in sorted(got[q])] == want
    assert 950 not in got and len(got) == 16
    assert 0 < search.pairs.count() < 0.5 * search.queries.count() * search.groups.count()


def test_topk_extremes(spark):
    rows = [(0, [1e30, 1e30]), (50, [-1e30, 1e30]), (1, [1e30, 1e30]), (2, [1.0, -1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert max(r.score for r in got) == 2**63 - 1 and len(got) == 6
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_chat_brute_force(spark):
    turns = [r.asDict() for r in table(spark, SF, "conversations").collect()]
    turns += [{"conv_id": -1, "turn": k, "role": x, "text": t} for k, (x, t) in enumerate([("b|>\n", "x"), ("a", None), (None, "<|end|>"), ("system", "s"), ("a", "again")])]
    frame = spark.createDataFrame([(t["conv_id"], t["turn"], t["role"], t["text"], 1) for t in turns] * 2, "conv_id long, turn long, role string, text string, start int")
    talks = defaultdict(list)
    for t in turns * 2:
        talks[t["conv_id"]].append((t["turn"], t["role"] or "unknown", (t["text"] or "").replace("<|", "< |")))
    want = {}
    for c, said in talks.items():
        for me in {s for _, s, _ in said} - {"system"}:
            text, masks = "", []
            shown = []
            for turn, s, t in said:
                name = "assistant" if s == me else s if s == "system" else "user:" + "".join("_" if x in "<|>\r\n" else x for x in s)
                shown.append((turn, s, f"<|{name}|>\n", f"<|{name}|>\n{t}<|end|>\n"))
            for _, s, head, body in sorted(shown, key=lambda x: (x[0], x[1], x[3])):
                if s == me:
                    masks.append((len(text) + len(head), len(text) + len(body) - 1))
                text += body
            want[c, me] = (text, masks)
    got = {(r.conv_id, r.perspective): (r.text, [(m.start, m.end) for m in r.masks]) for r in chat.dialogues(frame).collect()}
    assert got == want
    assert chat.segments(frame.limit(0)).count() == 0


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), CLASH)
    empty = docs.limit(0)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    stages = {
        "language": langid.accepted,
        "quality": lambda d: quality.accepted(d, labels),
        "unique": jaccard.one_of_each,
        "mixed": lambda d: mixing.copies(d, Scratch(spark, "t")),
    }
    for name, stage in stages.items():
        out = stage(docs)
        assert out.schema.names == docs.schema.names, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and {r[5:] for r in rows} == {odd_rows()[0][5:]}, name
        assert stage(empty).count() == 0, name
    assert packing.pack(docs).count() >= docs.count() and packing.pack(empty).count() == 0
    for scan in (licenses.scan, lambda d: fingerprints.with_next(d.select("doc_id", "text"))):
        assert scan(docs).count() == docs.count() and scan(empty).count() == 0


def test_one_of_each(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "vw")
    rows = [(3, a, "x"), (3, a, "y"), (5, a + " tail", "x"), (None, a, "x"), (None, b, "x"), (None, b, "z"), (None, b + " end", "x"), (7, None, "x"), (7, "", "x"), (None, None, "x"), (9, "other words", "x"), (9, "two", "x")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    kept = sorted(((r.doc_id, r.text, r.key) for r in got), key=str)
    assert sum(r[1] in (b, b + " end") for r in kept) == 1 and sum(r[0] == 9 for r in kept) == 1
    assert [r for r in kept if r[1] == a] == [(3, a, "x")] and sum(not r[1] for r in kept) == 3 and len(kept) == 6


def test_pipeline(spark, corpus):
    """Every stage against its rule, on its own input; the last one by coverage."""
    docs = table(spark, SF, "documents")
    scratch = Scratch(spark, "t")
    kept = [scratch.keep(stage(spark, docs, SF), "s0") for stage in [corpus_pipeline.STAGES[0][1]]]
    language = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), langid.train(docs.select("doc_id", "text", "lang"))).collect()}
    assert {r.doc_id for r in kept[0].collect()} == {d for d, r in language.items() if r.lang_pred != "und" and r.score >= 0.5}
    kept.append(scratch.keep(corpus_pipeline.STAGES[1][1](spark, kept[0], SF), "s1"))
    assert {r.doc_id for r in kept[1].collect()} < {r.doc_id for r in kept[0].collect()}
    kept.append(scratch.keep(corpus_pipeline.STAGES[2][1](spark, kept[1], SF), "s2"))
    members = jaccard.Join(kept[1]).members().collect()
    assert {r.doc_id for r in kept[2].collect()} == {r.component_id if r.n_shingles else r.doc_id for r in members}
    kept.append(scratch.keep(corpus_pipeline.STAGES[3][1](spark, kept[2], SF), "s3"))
    taken = {r.doc_id: r for r in mixing.mix(kept[2], Scratch(spark, "m")).collect()}
    copies = Counter(r.doc_id for r in kept[3].collect())
    for d, r in taken.items():
        extra = r.taken - r.whole * r["size"]
        assert copies[d] == r.whole + (r["size"] > 0 and 2 * extra >= r["size"])
    assert all(k.schema.names == docs.schema.names for k in kept)
    packed = corpus_pipeline.STAGES[4][1](spark, kept[3], SF)
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == copies
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "source mixing", "packing"]


def test_words_equal_the_tokenizer():
    """Every code point below U+0250 in four contexts, marks in every place, and contractions."""
    words = packing.Words(packing.vocabulary_path())
    texts = [" ".join(f.format(chr(c)) for c in range(1, 0x250)) for f in ("{}", "a{}b", "A{}", "{}'s")]
    texts += ["don't. WE'LL, 'tis rock'n'roll' it's', x'' a.b. e.g., U.S.A.! (re) --x-- İstanbul, STRASSE ŉ's ǅ. 3rd 1,000. a_b_ __c__ é́ ́a"]
    for _, _, data, offsets in K.chunks(pa.array(texts)):
        ids, ends = words(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
