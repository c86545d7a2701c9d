"""Queries that SQL can't express, and the pipeline's stages, against plain Python over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import brute_components, lower

import corpus_pipeline
from sketchloom.llm import decontaminate, licenses, media, pieces, quality
from sketchloom.llm.common import table, text_bytes
from sketchloom.llm.registry import QUERIES
from sketchloom.llm.text import BYTE, MULTIPLIERS

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, D, "documents").toArrow().to_pylist()


def png(image):
    """Samples of a grey PNG without line filters."""
    at, data, height = 8, b"", 0
    while at < len(image):
        size, kind = int.from_bytes(image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        height = int.from_bytes(body[4:8]) if kind == b"IHDR" else height
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = zlib.decompress(data)
    assert len(lines) == height * 65 and not any(lines[::65])
    return b"".join(lines[i * 65 + 1 : (i + 1) * 65] for i in range(height))


def test_op1(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op1_media_columns"](spark, D).toArrow().to_pylist()}
    images = {r["key"]: r["media"] for r in media.media_columns(table(spark, D, "documents")).toArrow().to_pylist()}
    assert len(got) == len(documents)
    for d in documents:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r, image = got[d["doc_id"]], images[d["doc_id"]]
        assert png(image) == payload and (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        bins = Counter(b // 32 for b in payload)
        assert r["feature"] == f"{len(payload) // 64};{sum(payload)};" + ",".join(str(bins[i]) for i in range(8))


def plain_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", lower(text).encode())


def shingles(words, short):
    n = min(5, len(words), max(2, (len(words) + 1) // 3) if short else 5)
    return n, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain_leaks(documents, items):
    """(doc, item): (score, question and answer overlap) of the best passage that is verified."""
    entries, parts = [], []
    for it in items:
        q, a = decontaminate.split_answer(it["text"] or "")
        q_, a_ = plain_words(q), plain_words(a)
        whole = q_ if q == a else q_ + a_
        if whole:
            entries += [(len(parts), Counter(whole[x[0] : x[-1] + 1])) for x in np.array_split(np.arange(len(whole)), -(-len(whole) // 48))]
            parts.append((it["item_id"], shingles(q_, False), shingles(a_, True), shingles(whole, True), len(whole)))
    df = Counter(t for _, e in entries for t in e)
    n, mean = len(entries), sum(sum(e.values()) for _, e in entries) / len(entries)
    impacts, lists = [], defaultdict(list)
    for j, (_, e) in enumerate(entries):
        norm = 1.2 * (0.25 + 0.75 * sum(e.values()) / mean)
        x = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + norm) for t, c in e.items()}
        impacts.append({t: v / sum(x.values()) for t, v in x.items()})
        for t in e:
            lists[t].append(j)
    out = {}
    for d in documents:
        w = plain_words(d["text"])
        for half in range(max(1, -(-len(w) // 64) - 1)):
            lo, hi = 64 * half, min(len(w), 64 * half + 128)
            score = Counter()
            for t in set(w[lo:hi]):
                for j in lists.get(t, ()):
                    score[j] += impacts[j][t]
            for j, s in score.items():
                if s >= 0.6:
                    id_, q, a, whole, room = parts[entries[j][0]]
                    near = w[max(0, lo - room) : hi + room]
                    share = [len(want & {tuple(near[i : i + k]) for i in range(len(near) - k + 1)}) / len(want) if want else 1.0 for k, want in (q, a, whole)]
                    if share[0] >= 0.5 and share[1] >= 0.5 or share[2] >= 0.5:
                        rule = "parts" if share[0] >= 0.5 and share[1] >= 0.5 else "whole"
                        out[d["doc_id"], id_] = max(out.get((d["doc_id"], id_), (0, 0, 0)), (s, *share, rule), key=lambda r: r[:3])
    return out


def test_op2(spark, documents):
    want = plain_leaks(documents, table(spark, D, "benchmark").toArrow().to_pylist())
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap, r.whole_overlap, r.rule) for r in QUERIES["op2_benchmark_decontamination"](spark, D).collect()}
    assert got.keys() == want.keys() and want
    for k, v in want.items():
        assert np.allclose(got[k][:4], v[:4], atol=1e-4) and got[k][4] == v[4]


def plain_hashes(text):
    """Table rows of a text's features, word by word and letter by letter."""
    m64, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(h):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * by & m64
        return h ^ h >> 31

    def stretch(b):
        return sum(int(BYTE[c]) * pow(base, i, 1 << 64) for i, c in enumerate(b)) & m64

    raw, mult = (text or "").encode(), [int(x) for x in MULTIPLIERS]
    words = [mixed(stretch(w) + len(w) * mult[63] & m64) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    rows = [h % quality.BUCKETS for h in words]
    rows += [(mult[3] if a == b else mixed((a * mult[1] + b * mult[2]) & m64)) % quality.BUCKETS for a, b in zip(words, words[1:])]
    for n in quality.NGRAMS:
        for i in range(len(raw) - n + 1):
            g = stretch(raw[i : i + n]) + n * mult[5] & m64
            rows.append((g ^ g >> 32) * mult[4] % (1 << 64) >> 46)
    return rows


def test_op7(spark, documents):
    """Features and scores of whole texts, one at a time, against those of the query, which come from batches of texts."""
    labels = {r["doc_id"]: r["quality"] for r in table(spark, D, "labels").toArrow().to_pylist()}
    texts = {d["doc_id"]: d["text"] for d in documents}
    chosen = {r["__id"]: (r["t"], r["y"]) for r in quality.sample(table(spark, D, "documents"), table(spark, D, "labels")).collect()}
    usable = {i for i, y in labels.items() if y in (0, 1) and i in texts and zlib.crc32(str(i).encode()) % 5}
    assert chosen and set(chosen) <= usable and all((texts[i] or "", labels[i]) == v for i, v in chosen.items())
    assert {i for i in usable if len((texts[i] or "").encode()) <= quality.ROW_BYTES} <= set(chosen)  # few enough here
    model = quality.train(table(spark, D, "documents"), table(spark, D, "labels"))
    again = quality.train(table(spark, D, "documents").repartition(5), table(spark, D, "labels"))
    assert (model.rows == again.rows).all() and model.bias == again.bias
    got = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, D).collect()}
    assert set(got) == set(texts)
    for i, t in sorted(texts.items()):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        if len(t or "") > 4000 and i % 5:
            continue  # long ones take plain Python a while: a fifth of them
        rows = plain_hashes(t)
        z = sum(float(model.rows[x]) for x in rows) / max(1, len(rows)) + model.bias
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6), i


def test_op5(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op5_license_scan"](spark, D).toArrow().to_pylist()}
    phrases = {tuple(k.split()): v for k, v in licenses.BASE.items()}
    labelled = 0
    for d in documents:
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"]).encode())]
        joined = f" {' '.join(words)} ".encode()
        found = [(m.start(), m.end(), r.priority, r.order) for r in licenses.RULES for m in r.pattern.finditer(joined)]
        kept = [x for x in found if not any(o[0] <= x[0] and o[1] >= x[1] and (o[:2] != x[:2] and o[2] <= x[2] or o[:2] == x[:2] and o[2:] < x[2:]) for o in found)]
        base = [(i, v) for k, v in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(k)]) == k]
        labels = {v for _, v in base}
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["n_detections"]) == (len(words), len(base), len(kept))
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert r["labels"] == ",".join(sorted(labels | {licenses.RULES[x[3]].label for x in kept}))
        assert r["score"] == max([0.6 * bool(base), *(licenses.RULES[x[3]].confidence for x in kept)])
        labelled += bool(kept)
    assert labelled


def test_op10(spark, documents):
    got = QUERIES["op10_sentencepiece"](spark, D).toArrow().to_pylist()
    want = {d["doc_id"]: hashlib.sha256((d["text"] or "").encode()).hexdigest() for d in documents}
    assert {r["doc_id"] for r in got} == set(want) and all(r["lossless"] and r["decoded_sha256"] == want[r["doc_id"]] for r in got)
    by = defaultdict(dict)
    for r in got:
        by[r["doc_id"]][r["sample"]] = r
    for s in by.values():
        assert set(s) in ({1}, {1, 2}) and all(r["log_inclusion"] <= 0 and r["log_prob"] <= 1e-9 for r in s.values())
        if 2 in s:
            assert s[1]["ids_sha256"] != s[2]["ids_sha256"] and s[1]["perturbed"] >= s[2]["perturbed"]


def segmentations(v, data):
    """All ways to spell the bytes, with their weights."""
    spell = {p: math.exp(v.logp[i]) for i, p in enumerate(v.pieces) if p and i not in set(v.byte_ids.tolist())}

    def ways(at):
        if at == len(data):
            return [((), 1.0)]
        return [((data[at:end], *rest), w * spell[data[at:end]]) for end in range(at + 1, len(data) + 1) if data[at:end] in spell for rest, w in ways(end)]

    return dict(ways(0))


@pytest.mark.parametrize("text", ["abc", "the end"])
def test_op10_probabilities_and_inclusion_scores(text):
    v, n = pieces.Vocabulary.load(), 3000
    words = segmentations(v, b" " + text.encode()) if " " not in text else {}
    for part in text.split(" ") if not words else []:  # no piece has a space within
        one = segmentations(v, b" " + part.encode())
        words = {a + b: x * y for a, x in (words or {(): 1.0}).items() for b, y in one.items()}
    total = sum(words.values())
    data, off = text_bytes(pa.array([text] * n))
    estimate = 0.0
    for rows in pieces.sample(v, data, off, np.arange(n) * 104729, 3):
        for ids, logp, _, inclusion in rows:
            spelled = tuple(bytes(v.pieces[i]) for i in ids)
            assert abs(logp - math.log(words[spelled] / total)) < 1e-9
            estimate += math.exp(logp - inclusion) / n
    assert abs(estimate - 1) < 0.05


@pytest.mark.parametrize("part", [1, 23, 400])
def test_long_texts_in_parts_have_the_same_samples(part):
    v, rng = pieces.Vocabulary.load(), np.random.default_rng(part)
    for i in range(12):
        alphabet = list("abcdefghij klmnop qrstuvwxyz éü漢\U0001f600\x00\n\t▁.,ABC" if i % 3 else "abcdefghijklmnopqrstuvwxyzéü漢")
        data, _ = text_bytes(pa.array(["".join(rng.choice(alphabet, int(rng.integers(1, 700))))]))
        key, k = int(rng.integers(-(2**62), 2**62)), 1 + i % 4
        want = pieces.sample(v, data, np.array([0, len(data)]), np.array([key]), k)[0]
        got = pieces.sample_long(v, data, key, k, part)
        assert len(got) == len(want) and all((a[0] == b[0]).all() and np.allclose(a[1:], b[1:], atol=1e-8) for a, b in zip(got, want))
        assert all(pieces.decode(v, r[0]) == data.tobytes() for r in got)


def plain_lines(documents):
    sites = defaultdict(set)
    for d in documents:
        for x in (d["text"] or "").split("\n"):
            if len(x.strip(" ")) >= 1:
                sites[x.strip(" ")].add(d["source"])
    bad = {x for x, s in sites.items() if len(s) >= 5}
    owners = defaultdict(set)
    for d in documents:
        owners[tuple(sorted(x.strip(" ") for x in d["text"].split("\n")))].add(d["doc_id"])
    out = []
    for d in documents:
        lines = d["text"].split("\n")
        gone = [x for x in lines if x.strip(" ") in bad]
        copied = all(x.strip(" ") in bad for x in lines if x.strip(" ")) or len(owners[tuple(sorted(x.strip(" ") for x in lines))]) > 1
        whole = copied and sum(map(len, gone)) > 0.5 * sum(map(len, lines))
        out.append(d if whole else d | {"text": "\n".join(x for x in lines if x.strip(" ") not in bad)})
    return out


def test_pipeline_stages(spark, documents):
    docs = table(spark, D, "documents")
    model = quality.train(docs, table(spark, D, "labels"))
    score = model.score(pa.array([d["text"] for d in documents], pa.string()))
    want = [d for d, s in zip(documents, score) if s >= 0.3]
    shared = "a line that many sites have at the end of their pages"
    for i, d in enumerate(want):  # boilerplate, copies and a leak that these few documents may lack
        want[i] = d | {"text": (d["text"] or "") + (f"\n{shared}" if i % 3 == 0 else "")}
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted((r["doc_id"], r["text"]) for r in rows)
    got = stages["quality_classifier"](spark, docs, D).toArrow().to_pylist()
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in want)
    now = spark.createDataFrame(want, docs.schema)
    now = stages["line_dedup"](spark, now, D)
    want = plain_lines(want)
    assert key(now.toArrow().to_pylist()) == key(want) and all(shared not in d["text"] or d["text"].strip() == shared for d in want)
    first = {d: c for d, (_, c) in brute_components([(d["doc_id"], d["text"]) for d in want], 5, 80).items()}
    copies = [want[0] | {"doc_id": 10**6}, want[1] | {"doc_id": 10**6 + 1, "text": want[1]["text"] + " more"}]
    now = stages["ngram_jaccard_join"](spark, now.unionByName(spark.createDataFrame(copies, docs.schema)), D)
    kept = {d["doc_id"] for d in want if first[d["doc_id"]] == d["doc_id"]}
    want = [d for d in want if d["doc_id"] in kept]
    got = now.toArrow().to_pylist()
    assert key([r for r in got if r["doc_id"] < 10**6]) == key(want) and all(r["doc_id"] != 10**6 for r in got)
    now = spark.createDataFrame(want, docs.schema)
    leaks = {d for d, _ in plain_leaks(want, table(spark, D, "benchmark").toArrow().to_pylist())}
    got = stages["benchmark_decontamination"](spark, now, D).toArrow().to_pylist()
    want = [d for d in want if d["doc_id"] not in leaks]
    assert key(got) == key(want)
    done = stages["sentencepiece"](spark, spark.createDataFrame(want, docs.schema), D).toArrow().to_pylist()
    texts = {d["doc_id"]: d["text"].encode() for d in want}
    v = pieces.Vocabulary.load()
    assert {r["doc_id"] for r in done} == set(texts) and all(pieces.decode(v, r["ids"]) == texts[r["doc_id"]] for r in done)


@pytest.mark.parametrize("text", ["abc", "tokens", "to"])
def test_likeliest_segmentation(text):
    v = pieces.Vocabulary.load()
    ways = segmentations(v, b" " + text.encode())
    (ids,) = pieces.best(v, *text_bytes(pa.array([text])))
    assert abs(ways[tuple(bytes(v.pieces[i]) for i in ids)] - max(ways.values())) < 1e-12


def test_encode_gives_back_texts(spark, documents, monkeypatch):
    v = pieces.Vocabulary.load()
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(table(spark, D, "documents")).toArrow().to_pylist()}
    assert all(pieces.decode(v, got[d["doc_id"]]).decode() == (d["text"] or "") for d in documents) and len(got) == len(documents)
    texts = [None, "", "one", *(d["text"] for d in documents[:20])]
    whole = pieces.best(v, *text_bytes(pa.array(texts)))
    monkeypatch.setattr(pieces, "PART", 50)
    assert all((a == b).all() for a, b in zip(whole, pieces.best(v, *text_bytes(pa.array(texts))))) and [len(x) for x in whole[:2]] == [0, 0]


def test_op10_gives_the_ids_of_each_segmentation(spark, documents):
    v, texts = pieces.Vocabulary.load(), {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    got = QUERIES["op10_sentencepiece"](spark, D).toArrow().to_pylist()
    for r in got:
        assert len(r["ids"]) == r["n_pieces"] and hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() == r["ids_sha256"]
        assert pieces.decode(v, r["ids"]) == texts[r["doc_id"]]


def test_far_departures_are_looked_at_only_where_they_can_be_taken(monkeypatch):
    v, looked = pieces.Vocabulary.load(), []
    texts = ["the quick brown fox jumps over lazy dogs " * 2000, "", " ", "a", "0" * 900, "the the", "日本語 tokens " * 90]
    data, off = text_bytes(pa.array(texts))
    truncated = pieces._truncated
    monkeypatch.setattr(pieces, "_truncated", lambda mass, *x: looked.append(len(mass)) or truncated(mass, *x))
    for k in (1, 2, 6):
        looked.clear()
        got = pieces.sample(v, data, off, np.arange(len(texts)), k)
        assert looked[0] < sum(len(rows[0][0]) for rows in got) / 4
        for deep in (0.0, np.inf):  # from the first places on as far as needed, and all places
            with monkeypatch.context() as m:
                m.setattr(pieces, "DEEP", deep)
                other = pieces.sample(v, data, off, np.arange(len(texts)), k)
            assert all(len(a) == len(b) and all((x[0] == y[0]).all() and x[1:] == y[1:] for x, y in zip(a, b)) for a, b in zip(got, other))
