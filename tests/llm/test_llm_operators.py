"""Small tables with NULLs, empty and long texts, ties, repeated rows and clashing column names, against brute force."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sketchloom.llm import chat, decontaminate, jaccard, licenses, lines, media, pieces, quality, substrings, warc
from sketchloom.llm.common import shared_dir, text_bytes
from sketchloom.llm.components import components

SCHEMA = "doc_id long, text string, source string, id string, score double, h long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 0.5, 1) for r in rows], SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (None, "a b c"), (7, "Ünïcode ▁ \x00 \U0001f600 text"), (8, "one")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# media


def test_media_round_trip(spark):
    m = media.media_columns(docs(spark, EDGE)).toArrow().to_pylist()
    assert sorted((r["key"] is None, r["key"] or 0, r["payload"][: r["n_bytes"]]) for r in m) == sorted((k is None, k or 0, (t or "").encode()) for k, t in EDGE)
    for r in m:
        assert len(r["payload"]) % 64 == 0 and len(r["payload"]) >= 64 and set(r["payload"][r["n_bytes"] :]) <= {0}
        assert media.decode(r["media"]) == (r["n_bytes"], r["payload"]) and r["attempts"] == 1
    assert len({(r["media"], r["feature"]) for r in m if r["key"] in (4, 5)}) == 1


def test_media_empty(spark):
    assert media.media_columns(docs(spark, []).limit(0)).count() == 0


def test_media_ranges_and_retries(spark):
    path = shared_dir(spark, "media-test")
    rows = [(i, f"text {i} " * (i % 50)) for i in range(300)]
    media.write(docs(spark, rows), path)
    got = media.read(spark, path, rangeBytes=4096)
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r.key, bytes(r.payload[: r.n_bytes]).decode()) for r in got.select("key", "payload", "n_bytes").collect()) == rows
    image = media.encode(b"hello")
    archive = bytes(512) + media._header(b"9.png", len(image)) + image
    fails = [OSError("lost"), ValueError]

    def read(at, n):
        if fails:
            e = fails.pop()
            if e is ValueError:
                return b"garbage"[:n]
            raise e
        return archive[at : at + n]

    assert media.member(read, 512, 3, wait=0)[0] == 9 and not fails
    with pytest.raises((OSError, ValueError, struct.error, zlib.error)):
        media.member(lambda at, n: b"", 512, 1, wait=0)


# decontamination


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab, 30)) + ". " + " ".join(rng.choice(vocab, 6)) + ".") for i in range(60)] + [(60, None), (61, "")]
    rows = []
    for d in range(80):
        body = rng.choice(vocab, int(rng.integers(10, 400))).tolist()
        if d % 4 == 0:
            at = int(rng.integers(0, len(body)))
            body[at:at] = items[d % 60][1].upper().split()
        rows.append((d, " ".join(body)))
    got = decontaminate.find(docs(spark, [*rows, (100, None), (101, "")]), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, d % 60) for d in range(0, 80, 4)}
    assert decontaminate.find(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.find(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_retrieval_finds_all_above_threshold():
    rng = np.random.default_rng(5)
    vocab = [f"v{i}" for i in range(120)]
    texts = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 300, 30)]
    h, first = decontaminate.word_hashes(*text_bytes(pa.array(texts)))
    for threshold in (0.4, 0.6, 0.75):
        ix = decontaminate.build([(i, " ".join(np.random.default_rng(i).choice(vocab, 3 + i)), None) for i in range(90)], threshold=threshold)
        got = {(d, e, w) for d, e, _, w, _ in decontaminate.retrieve(ix, h, first, threshold)}
        impact = np.zeros((len(ix.terms), ix.n))
        impact[ix.key // ix.n, ix.key % ix.n] = ix.impact
        want = set()
        for d in range(len(texts)):
            n = first[d + 1] - first[d]
            for half in range(max(1, -(-n // 64) - 1)):
                a = first[d] + 64 * half
                t = np.searchsorted(ix.terms, np.intersect1d(h[a : min(a + 128, first[d + 1])], ix.terms))
                want |= {(d, int(e), int(a)) for e in np.flatnonzero(impact[t].sum(0) >= threshold)}
        assert got == want and want


def test_decontamination_in_shards(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} eta{i} theta{i}") for i in range(9)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 3)
    got = decontaminate.find(docs(spark, [(1, "x alpha4 beta4 gamma4 delta4 epsilon4 zeta4 eta4 theta4 y")]), items)
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 4)]


@pytest.mark.parametrize("answer", [None, "a"])
def test_decontamination_is_the_same_in_any_number_of_shards(spark, monkeypatch, answer):
    rng = np.random.default_rng(11)
    vocab = [f"word{i}" for i in range(300)]
    words_of = [rng.choice(vocab, int(n)).tolist() for n in rng.integers(20, 130, 30)]
    items = spark.createDataFrame([*((i, " ".join(w[:-8]) + ".", " ".join(w[-8:])) for i, w in enumerate(words_of)), (30, None, None), (31, "", "")], "item_id long, q string, a string")
    items = items.withColumn("text", F.concat_ws(" ", "q", "a"))
    rows = [(i, " ".join(w[: len(w) * 9 // 10])) for i, w in enumerate(words_of)] + [(100 + i, " ".join(w)) for i, w in enumerate(words_of)]
    found = []
    for size in (2000, 7):
        monkeypatch.setattr(decontaminate, "SHARD_ITEMS", size)
        got = decontaminate.find(docs(spark, rows), items, question="q" if answer else None, answer=answer).collect()
        found.append(sorted((r.doc_id, r.item_id, round(r.score, 5), r.question_overlap, r.answer_overlap, r.first_word) for r in got))
    assert len(found[0]) >= 30 and found[0] == found[1]


def test_decontamination_of_edited_last_sentences(spark):
    rng = np.random.default_rng(9)
    vocab = [f"word{i}" for i in range(3000)]
    heads = [rng.choice(vocab, int(n)).tolist() for n in rng.integers(20, 60, 40)]
    tails = [rng.choice(vocab, int(n)).tolist() for n in rng.integers(1, 6, 40)]
    items = [(i, f"{' '.join(q)}. {' '.join(a)}.") for i, (q, a) in enumerate(zip(heads, tails))]
    rows = []
    for i, (q, a) in enumerate(zip(heads, tails)):
        edited = [*a[: len(a) // 2], "changed", *a[len(a) // 2 + 1 :]]
        rows += [(d + i, " ".join([*rng.choice(vocab, 100), *q, *end, *rng.choice(vocab, 100)])) for d, end in ((0, edited), (100, []))]
        rows.append((200 + i, " ".join([*rng.choice(vocab, 100), *q[: len(q) // 3], *rng.choice(vocab, 60), *a])))
    got = decontaminate.find(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d + i, i) for i in range(40) for d in (0, 100)}


def test_decontamination_of_short_answers(spark):
    q = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([(1, q, "a b c d e")], "item_id long, q string, a string")
    rows = [(1, f"{q} a b c d e"), (2, f"{q} a b x d e"), (3, q), (4, f"{q} e d c b a")]
    got = decontaminate.find(docs(spark, rows), items, question="q", answer="a").collect()
    assert {r.doc_id for r in got} == {1, 2}


# WARC


def test_warc_round_trip_and_magic_in_payloads(spark):
    fake = warc.record(99, "u", b"inner payload", None, compress=False).decode("latin1")
    big = "same " * 300
    rows = [(1, "http://a", big), (2, "http://b\r\nWARC-Type: x", big), (3, None, fake), (4, "u", fake + "WARC/1.1\r\n" + fake), (5, "u", None), (6, "u", "small"), (7, "u", "small"), (8, "u", big), (None, "u", "null id"), (9, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for compress, size in ((True, 1 << 20), (False, 700), (False, 64)):
        path = shared_dir(spark, "warc-test")
        manifest = warc.write(pages, path, compress=compress)
        got = {r["page_id"]: r for r in warc.read(spark, path, manifest, range_bytes=size).toArrow().to_pylist()}
        assert len(got) == len(rows)
        for k, _, h in rows:
            want = (h or "").encode()
            r = got[k]
            assert r["payload_bytes"] == len(want) and r["payload_digest"] == hashlib.sha1(want).hexdigest()
            assert (r["record_type"], r["refers_to"]) == (("revisit", 8) if k in (1, 2) else ("response", None))
            assert r["payload"] == (None if k in (1, 2) else want)
    assert warc.round_trip(pages.limit(0)).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        warc.round_trip(pages.withColumn("page_id", F.lit("x")))


def test_warc_default_archives_hold_magic_that_is_rejected(spark):
    """Records inside payloads are candidates in the archives that the query writes, and none of them is read."""
    fake = warc.record(99, "u", b"inner payload", None, compress=False).decode("latin1")
    rows = [(i, "u", f"{i} {fake} {fake}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = shared_dir(spark, "warc-magic")
    manifest = warc.write(pages, path)
    assert warc.candidates(manifest, path).count() > len(rows)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path, manifest).collect()}
    assert got == {i: h for i, _, h in rows}
    assert {r.page_id for r in warc.round_trip(pages).collect()} == set(range(120))


def test_warc_gives_long_urls_back_whole(spark):
    url = "http://example.org/" + "x" * 700_000
    rows = [(1, url, "a" * 2000), (2, url + "é", "a" * 2000), (3, "short", "b")]
    got = {r.page_id: (r.url, r.record_type) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (url, "revisit"), 2: (url + "%C3%A9", "response"), 3: ("short", "response")}


@pytest.mark.parametrize("range_bytes", [1 << 20, 700, 64])
def test_warc_damage_is_seen(spark, range_bytes):
    pages = spark.createDataFrame([(i, f"u{i}", f"text of page {i} " * 9) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    whole = None
    for harm, error, left in (("header", "no whole record", 6), ("payload", "record at", 11), ("end", "no whole record", 11), ("start", "no whole record", 0)):
        path = shared_dir(spark, "warc-damage")
        manifest = warc.write(pages, path, compress=False)
        name = manifest.first()["name"]
        file = path.removeprefix("file://") + "/" + name
        raw = bytearray(open(file, "rb").read())
        at = [m.start() for m in re.finditer(re.escape(warc.MAGIC), raw)]
        whole = whole or len(at)
        if harm == "end":
            del raw[-3:]
        else:
            place = {"header": at[6] + 2, "payload": at[7] - 9, "start": 0}[harm]
            raw[place : place + 4] = b"????"
        open(file, "wb").write(raw)
        size = spark.createDataFrame([(name, len(raw))], "name string, size long")
        rows = warc.read(spark, path, size, range_bytes=range_bytes, mode="permissive").collect()
        bad = [r for r in rows if r.record_type == "damaged"]
        assert len(rows) - len(bad) == left and len(bad) == 1 and error in bad[0].error and bad[0].page_id is None, harm
        with pytest.raises(Exception, match=error):
            warc.read(spark, path, size, range_bytes=range_bytes).count()
    with pytest.raises(ValueError):
        warc.read(spark, path, size, mode="other")


# line dedup


def test_line_dedup_against_brute_force(spark):
    shared = [f"this is a boilerplate line number {i}" for i in range(4)]
    rows = []
    for d in range(60):
        body = [f"own text of document {d} line {j} with more words" for j in range(3)]
        rows.append((d, "\n".join([body[0], *(s for i, s in enumerate(shared) if d % (i + 2) == 0), *body[1:]]), f"site{d % (4 + d % 3)}" if d % 7 else None))
    rows += [(100, None, "a"), (101, "", "b"), (102, "\n".join(shared), "c"), (103, LONG, "d"), (103, LONG, "d"), (None, "x\n" + shared[0], "e")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r["__n_removed"], r["score"]) for r in lines.line_dedup(docs(spark, rows)).collect())
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if len(x.strip(" ")) >= 1:
                sites[x.strip(" ")].add(s)
    want = []
    for k, t, _ in rows:
        if t is None:
            want.append((False, k, None, 0, 0.5))
            continue
        all_lines = t.split("\n")
        bad = [len(sites.get(x.strip(" "), ())) >= 5 for x in all_lines]
        kept = [x for x, b in zip(all_lines, bad) if not b]
        want.append((k is None, k or 0, "\n".join(kept), len(all_lines) - len(kept), 0.5))
    key = lambda r: (r[0], r[1], r[2] or "")
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[3] for r in want) > 20
    assert lines.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_of_short_lines(spark):
    """Lines of any length are boilerplate, but blank ones; ``min_chars`` spares short ones for who wants that."""
    rows = [(d, f"own {d}\nHome\n\n  \n|", f"site{d}") for d in range(6)]
    for least, text, n in ((1, "own {}\n\n  ", 2), (2, "own {}\n\n  \n|", 1), (5, "own {}\nHome\n\n  \n|", 0)):
        got = {(r.doc_id, r.text, r["__n_removed"]) for r in lines.line_dedup(docs(spark, rows), min_chars=least).collect()}
        assert got == {(d, text.format(d), n) for d in range(6)}
    found = lines.boilerplate(docs(spark, rows)).collect()
    assert len(found) == 2 and all(len(r.h) == 16 for r in found)


def test_line_dedup_keeps_only_copies_whole(spark):
    shared = [f"this is a boilerplate line number {i}" for i in range(3)]
    rows = [(d, f"own text of document {d} that is longer than all\n{shared[d % 3]}\nand has some more lines of number {d}", f"site{d}") for d in range(30)]
    page = "Short.\n" + "\n".join(shared)
    copy = "\n".join([*shared, "a line that two documents have"])
    few = f"own text that two documents have, longer than the shared line in it\n{shared[0]}"
    rows += [(40, page, "a"), (40, page, "a"), (41, "\n".join(shared) + "\n ", "a"), (42, copy, "a"), (43, copy + " ", "b"), (44, few, "a"), (45, few, "a"), (46, None, "a"), (None, "x\n" + shared[0], "e"), (47, shared[0] + "\n" + shared[0] + "\ny", "a"), (48, shared[0] + "\ny", "a")]
    got = {(r.doc_id, r.text, r["__n_removed"]) for r in lines.line_dedup(docs(spark, rows), spare=0.5).collect() if r.doc_id is None or r.doc_id >= 40}
    want = {(40, "Short.", 3), (41, "\n".join(shared) + "\n ", 0), (42, copy, 0), (43, copy + " ", 0), (46, None, 0), (None, "x", 1), (47, "y", 2), (48, "y", 1)}
    assert got == want | {(d, few.split("\n")[0], 1) for d in (44, 45)}


def test_pipeline_drops_boilerplate_of_short_pages(spark):
    shared = "this is a line that many sites have"
    rows = [(d, f"own text of document {d} that is longer than it\n{shared}", f"site{d}") for d in range(9)] + [(9, f"{shared}\nShort.", "a")]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs(spark, rows), "").collect()}
    assert got[9] == "Short." and all(shared not in t for t in got.values())


# licenses


def test_license_scan(spark):
    texts = {1: "Released under the MIT License.", 2: "Licensed under the Apache License, Version 2.0. MIT license; apache LICENSE", 3: "GNU General Public License, version 3", 4: None, 5: "", 6: "no terms here", 7: "mit\n license mit license", 8: LONG}
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, list(texts.items()))).collect()}
    for k, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert len(licenses.RULES) > 200 and licenses.license_scan(docs(spark, [])).count() == 0


def test_license_containment():
    kept = licenses.detect(b" licensed under the apache license version 2 0 and the gnu affero general public license version 3 ")
    assert [d.rule.label for d in kept] == ["apache", "agpl"]  # "general public license" lies inside the longer name
    assert licenses.detect(b" nothing to see ") == []


def examples(tree):
    """Texts that a parsed pattern matches, each of its alternatives and optional parts in some of them."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name in ("ASSERT", "AT"):
            continue
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":  # of a range or class one character will do
            some = [chr(v) if str(k) == "LITERAL" else chr(v[0]) if str(k) == "RANGE" else "1" for k, v in arg]
        elif name == "BRANCH":
            some = [x for t in arg[1] for x in examples(t)]
        elif name == "SUBPATTERN":
            some = examples(arg[-1])
        elif name == "MAX_REPEAT":
            some = [x * n for n in {arg[0], max(1, arg[0])} for x in examples(arg[2])]
        n = max(len(out), len(some))
        out = [out[i % len(out)] + some[i % len(some)] for i in range(n)] if len(out) > 60 else [a + b for a in out for b in dict.fromkeys(some)]
    return list(dict.fromkeys(out))


def test_each_license_rule_and_its_prefilter():
    for rule in licenses.RULES:
        found = examples(re._parser.parse(rule.pattern.pattern.decode()))
        for t in found:
            text = f" {t} ".encode()
            want = licenses.matches(text, prefilter=False)
            assert any(d.rule is rule for d in want) and licenses.matches(text) == want, (rule.label, t)
        words = max(found, key=len).split()
        for wrong in ([*reversed(words)], ["x".join(words)], words[:1] if len(words) > 2 else []):
            assert not any(d.rule is rule for d in licenses.matches(f" {' '.join(wrong)} ".encode(), prefilter=False)), (rule.label, wrong)


def test_license_names_without_their_short_form():
    texts = {"mit": "Expat License", "lgpl": "GNU Library General Public License", "wtfpl": "Do What The Fudge You Want To Public License", "open-game": "Open Gaming License", "qpl": "Q Public License", "openrail": "Responsible AI License", "cc-by": "licensed under Creative Commons Attribution 4.0"}
    for label, t in texts.items():
        got = licenses.scan(t.encode())
        assert label in got["labels"].split(",") and got["score"] >= 0.6


# Jaccard join


def sets(rows, k):
    out = defaultdict(set)
    for d, t in rows:
        w = words(lower(t))
        out[d] |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(rows, k, percent):
    s = sets(rows, k)
    label = {d: d for d in s}
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    while True:
        moved = False
        for a, b in links:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
        if not moved:
            return {d: (len(s[d]), label[d]) for d in s}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_against_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two")]
    for base in range(14):
        n = int(rng.integers(3, 260))
        body = rng.choice(vocab, n).tolist()
        for _ in range(14):
            copy = list(body)
            for _ in range(int(rng.integers(0, 1 + n // 25))):
                copy[int(rng.integers(0, len(copy)))] = rng.choice(vocab)
            rows.append((10 + len(rows) * 3 % 1000, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, [*rows, (None, rows[5][1])]), k=k, percent=percent).collect() if r.doc_id is not None}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_no_linked_pair_misses_a_bucket(percent):
    """Pigeonhole: of any two linked sets the larger one probes a signature by which the other is indexed."""
    rng, scheme = np.random.default_rng(percent), jaccard.Scheme(percent)
    tried = 0
    for _ in range(400):
        n = int(rng.integers(3, 300))
        y = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gone = int(rng.integers(0, 1 + n // 4))
        x = np.unique(np.concatenate([rng.permutation(y)[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1)), dtype=np.uint64)]))
        same = len(np.intersect1d(x, y))
        if len(x) > len(y) or not same or 100 * same < percent * (len(x) + len(y) - same) or same == len(x) == len(y):
            continue
        tried += 1
        sig, _, probe = jaccard.signatures(scheme, y, np.array([0, len(y)]), 0)
        ahead = int(scheme.band(np.array([len(y)]))[0] - scheme.band(np.array([len(x)]))[0])
        assert ahead in (0, 1)
        index = jaccard.signatures(scheme, x, np.array([0, len(x)]), ahead)[0]
        assert len(np.intersect1d(sig[probe], index))
    assert tried > 50


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 42), (42, 41)], "a long, b long")
    assert {r.v: r.label for r in components(edges).collect()} == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 42: 40}


# quality


def test_quality_model_and_edges(spark):
    good = [f"The quick brown fox number {i} jumps over a lazy dog and rests." for i in range(80)]
    bad = [f"BUY!! NOW!! CLICK$$$ {i} WIN!!! ***" for i in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(900, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.train(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality.score(docs(spark, [*rows, (500, None), (501, ""), (502, LONG)]), model).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i < 80) for i in held) >= 0.95 * len(held)
    assert got[500] == got[501] and all(0 <= s <= 1 for s in got.values())
    nothing = quality.train(docs(spark, rows), labels.limit(0))
    assert {r.score for r in quality.score(docs(spark, rows), nothing).collect()} == {0.5}
    assert quality.score(docs(spark, []), model).count() == 0


def test_quality_learns_from_long_texts_where_a_class_has_no_others(spark):
    """Bounds are parameters; a row that is too long gives way to the next, and no class ends up empty."""
    long = ["The quick brown fox jumps over a lazy dog and rests. " * 800 + str(i) for i in range(20)]
    short = [f"BUY!! NOW!! CLICK$$$ {i} WIN!!! ***" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(long + short)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert {r["__id"] for r in quality.sample(docs(spark, rows), labels).collect()} == set(known)
    model = quality.train(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality.score(docs(spark, rows), model).collect()}
    assert all((got[i] >= 0.3) == (i < 20) for i in range(40))
    few = quality.sample(docs(spark, rows + [(100 + i, "Some quiet prose about rivers.") for i in range(30)]), labels.union(spark.createDataFrame([(100 + i, 1) for i in range(30)], labels.schema)), sample_rows=10).collect()
    assert len(few) == 20 and all(r["__id"] >= 20 for r in few)  # long rows give way
    tight = quality.sample(docs(spark, rows), labels, sample_bytes=1000).collect()
    assert sum(r.y for r in tight) == 1 and 1 < len(tight) < 20  # the bytes bound, but for a class's first row
    odd = docs(spark, rows).withColumnsRenamed({"doc_id": "d.id", "text": "t.x", "source": "s.y"})
    out = quality.score(odd, model, key="d.id", text="t.x", keep=("s.y", "score"))
    assert out.columns == ["d.id", "s.y", "score", "_score"] and out.count() == 40


# chat


def test_reply_trees_against_brute_force(spark):
    rng = np.random.default_rng(2)
    nodes = []
    for tree in range(5):
        for n in range(1, 40):
            parent = None if n == 1 or rng.random() < 0.03 else int(rng.integers(max(1, n - 4), n))
            nodes.append((tree, n, parent, ["user", "assistant", "we:ird#"][n % 3], [f"t{n} <b> \\ #", "", "\\b\\l</turn>\n### user: x", "\\"][n % 4], float(rng.integers(0, 5))))
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    by = {(t, n): (p, r, x, s) for t, n, p, r, x, s in nodes}
    parents = {(t, p) for t, _, p, *_ in nodes}
    want = {}
    for t, n in by:
        if (t, n) not in parents:
            path, at, total = [], n, 0.0
            while at is not None:
                p, r, x, s = by[t, at]
                path.insert(0, (r, x))
                total += s
                at = p
            want[t, n] = (path, total)
    ranks = {}
    for t in range(5):
        for i, (k, _) in enumerate(sorted(((k, v[1]) for k, v in want.items() if k[0] == t), key=lambda z: (-z[1], z[0]))):
            ranks[k] = i + 1
    for best in (None, 2):
        c = chat.conversations(df, best).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss")))
        got = {(r.tree, r.leaf): ([tuple(x) for x in r.turns], r.path_score, r.rank, r.lost) for r in c.collect()}
        keep = {k for k in want if best is None or ranks[k] <= best}
        assert got == {k: (*want[k], ranks[k], "".join(x for r, x in want[k][0] if r == "assistant")) for k in keep}
    assert chat.conversations(df.limit(0)).count() == 0


def test_chat_chain_edges(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    c = chat.conversations(chat.chains(rows)).withColumn("turns", chat.parse(F.col("formatted")))
    got = {r.tree: [tuple(t) for t in r.turns] for r in c.collect()}
    assert got == {1: [("user", ""), ("user", ""), ("", "x")], None: [("assistant", LONG)]}


# substrings


def brute_substrings(rows, n=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_against_brute_force(spark):
    rng = np.random.default_rng(9)
    vocab = ["a", "b", "ç", "dd"]
    passage = [str(x) for x in rng.integers(0, 10**6, 60)]
    rows = [(0, None), (1, ""), (2, "x"), (3, "rep " * 70), (4, LONG), (9, LONG)]
    for d in range(10, 60):
        body = rng.choice(vocab, int(rng.integers(0, 40))).tolist()
        at = int(rng.integers(0, len(body) + 1))
        body[at:at] = passage[int(rng.integers(0, 30)) : int(rng.integers(30, 60))]
        rows.append((d, "\n ".join(body)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(docs(spark, rows)).collect()}
    assert got == brute_substrings([(d, t or "") for d, t in rows])
    twice = substrings.substring_dedup(docs(spark, [(1, LONG), (1, LONG), (None, LONG)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in twice)[-1] == (True, sum(c for c in [brute_substrings([(0, LONG)])[0][1]]))
    assert substrings.substring_dedup(docs(spark, [])).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        substrings.substring_dedup(docs(spark, rows), key="source")


@pytest.mark.parametrize("window,first", [(20, 5), (8, 2), (3, 3), (6, 3)])
def test_substring_passes_end_when_no_candidate_survives(spark, window, first):
    rows = [(1, "a b c"), (2, "d e f g"), (3, " ".join(f"u{i}" for i in range(100)))]
    some = [*rows, (4, " ".join(f"u{i}" for i in range(first))), (5, " ".join(f"u{i}" for i in range(10, 12 + window)))]
    for data, n in ((rows, 1), (some[:4], min(2, (window // first).bit_length())), (some, (window // first).bit_length())):
        passes = []
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(docs(spark, data), window=window, first=first, passes=passes).collect()}
        assert got == brute_substrings(data, window) and len(passes) == n
    with pytest.raises(ValueError):
        substrings.substring_dedup(docs(spark, rows), window=20, first=6)


# pieces


def test_pieces_round_trip_and_keys(spark):
    a = pieces.encode_samples(docs(spark, EDGE), k=3).toArrow().to_pylist()
    b = pieces.encode_samples(docs(spark, EDGE[::-1]).repartition(3), k=3).toArrow().to_pylist()
    assert all(r["lossless"] for r in a)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["sample"], r["ids_sha256"])
    assert [key(r) for r in sorted(a, key=key)] == [key(r) for r in sorted(b, key=key)]
    assert [(r["sample"], r["n_pieces"]) for r in a if r["doc_id"] in (1, 2)] == [(1, 0), (1, 0)]
    assert pieces.encode_samples(docs(spark, [])).count() == 0


def test_pipeline_has_the_ids_of_all_samples(spark):
    got = corpus_pipeline.tokens(spark, docs(spark, [(1, "some words to be cut into pieces"), (2, "and others")]), "").collect()
    assert {(r.doc_id, r["sample"]) for r in got} == {(d, s) for d in (1, 2) for s in (1, 2)}
    assert all(hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256 for r in got)


def test_pieces_distribution():
    v, n = pieces.Vocabulary.load(), 3000
    data, off = text_bytes(pa.array(["abc"] * n))
    found = pieces.sample(v, data, off, np.arange(n) * 7919, 3)
    logp = {tuple(i): p for s in found for i, p, _, _ in s}
    assert abs(sum(np.exp(list(logp.values()))) - 1) < 1e-3
    for s in found:
        assert len({tuple(x[0]) for x in s}) == len(s) == 3 and s[0][2] >= s[1][2] >= s[2][2]
        assert all(x[3] <= 0 for x in s)
    top = max(logp, key=logp.get)
    first = sum(tuple(s[0][0]) == top for s in found) / n
    assert abs(first - np.exp(logp[top])) < 0.02
    rest = {k: np.exp(p) for k, p in logp.items() if k != top}
    second = max(rest, key=rest.get)
    want = np.exp(logp[top]) * rest[second] / (1 - np.exp(logp[top])) + sum(rest[j] * rest[second] / (1 - rest[j]) for j in rest if j != second)
    assert abs(sum(tuple(s[1][0]) == second for s in found) / n - want) < 0.02


# cases across operators


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])


def test_words_that_collide_under_polynomials_stay_apart(spark):
    a, b = thue_morse(2048)
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}")]
    assert {r.n_removed for r in substrings.substring_dedup(docs(spark, rows)).collect()} == {0}
    rows = [(1, a), (2, b), (3, b)]
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(spark, rows), k=3, percent=90).collect()} == {1: 1, 2: 2, 3: 2}
    items = spark.createDataFrame([(1, f"{a} {a}x {a}y")], "item_id long, text string")
    got = decontaminate.find(docs(spark, [(1, f"{a} {a}x {a}y"), (2, f"{b} {b}x {b}y")]), items).collect()
    assert [r.doc_id for r in got] == [1]


@pytest.mark.parametrize("turn", [1, -1])
def test_jaccard_with_several_texts_to_an_id(spark, turn):
    body = [f"w{i}" for i in range(60)]
    a, other = " ".join(body), " ".join(f"z{i}" for i in range(200))
    rows = [(5, other), (5, a), (9, a + " more"), (12, other + " more"), (5, None), (20, "alone here"), (21, None)][::turn]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows), k=3, percent=90).collect()}
    assert {(9, 5), (12, 5), (20, 20), (21, 21), (5, 5)} == got
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs(spark, [*rows, (5, a), (None, a)]), "").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted([(5, other), (5, a), (5, ""), (20, "alone here"), (21, ""), (-1, a)])


NAMES = ["__k", "__bad", "__cut", "__row", "__n_lines", "__n_removed", "score", "id", "label", "h", "row", "row_", "__t", "q", "text_a"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    own = [(d, f"document {d} has words of its own, such as x{d} and y{d}\nand a second line", f"site{d}") for d in range(40)]
    df = clashing(spark, [*own, (None, "a text without any id at all", None), (99, None, "s"), (99, "", "s")])
    spark.createDataFrame([(d, 1) for d in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the only test item. And its answer.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.count() == df.count(), name
        assert {tuple(r)[3:] for r in out.select(*(f"`{c}`" for c in out.columns)).collect()} == {tuple(range(len(NAMES)))}
    assert corpus_pipeline.tokens(spark, df, "").filter("NOT lossless").count() == 0
    assert lines.line_dedup(df).columns[-2:] == ["___n_lines", "___n_removed"]


def test_decontamination_drops_rows_by_themselves(spark):
    item = " ".join(f"t{i}" for i in range(25))
    items = spark.createDataFrame([(i, f"{item} number{i} {' '.join(f'v{i}x{j}' for j in range(30))}") for i in range(7)], "item_id long, text string")
    leak = items.first().text
    rows = [(1, leak), (1, "clean text of the same id"), (None, leak), (None, "clean"), (2, None), (3, "")]
    got = decontaminate.clean(docs(spark, rows), items).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, "clean"), (1, "clean text of the same id"), (2, ""), (3, "")]
    assert decontaminate.clean(docs(spark, rows), items.limit(0)).count() == len(rows)
    assert decontaminate.clean(docs(spark, []), items).count() == 0


def test_decontamination_with_more_shards_than_a_worker_keeps(monkeypatch):
    monkeypatch.setattr(decontaminate, "RESIDENT", 1)
    import pickle

    from sketchloom.llm import common

    made = {n: decontaminate.build([(n, f"question {n} alpha{n} beta{n} gamma{n}", None)]) for n in "pqr"}
    monkeypatch.setattr(decontaminate, "open_uri", lambda p: (type("S", (), {"open_input_stream": lambda self, f: pa.BufferReader(pickle.dumps(tuple(made[f[-1]])))})(), p))
    for n in "pqrpq":
        assert decontaminate._shard("x", n).ids == [n] and len(decontaminate._KEPT) == 1
    assert common.SLICE < decontaminate.LARGE


def test_paths_without_a_scheme_and_damaged_members(spark, tmp_path):
    path = str(tmp_path / "archives")
    media.write(docs(spark, [(i, f"text {i}") for i in range(20)]), path)
    assert media.read(spark, path).count() == 20
    archive = next((tmp_path / "archives").glob("*.tar"))
    raw = bytearray(archive.read_bytes())
    raw[600:610] = b"xxxxxxxxxx"
    archive.write_bytes(bytes(raw))
    got = media.read(spark, path, mode="permissive", retries=1).collect()
    assert len(got) == 20 and [(r.key, r.attempts) for r in got if r.error] == [(None, 2)]
    with pytest.raises(Exception, match="damaged chunk|not a PNG|wrong size"):
        media.read(spark, path, retries=0).count()
    manifest = warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "warc"))
    assert warc.read(spark, str(tmp_path / "warc"), manifest).first().payload == b"x"


def test_media_ranges_are_bounded(monkeypatch, tmp_path):
    (tmp_path / "_manifest-1.json").write_text("".join(f'["{i}.tar", {1 << 30}]\n' for i in range(100)))
    monkeypatch.setattr(media, "RANGES", 500)
    got = media.ArchiveReader(f"file://{tmp_path}", {}).partitions()
    assert 500 <= len(got) <= 700 and sum(r.end - r.start for r in got) == 100 << 30


def test_reply_trees_with_repeats_and_cycles(spark):
    rows = [(1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "a", 2.0), (1, 3, 2, "user", "b", 0.0), (1, 4, 3, "assistant", None, 0.0), (1, 5, 4, None, "e", None)]
    loop = [(1, 10, 12, "user", "x", 0.0), (1, 11, 10, "user", "x", 0.0), (1, 12, 11, "user", "x", 0.0), (1, 13, 12, "user", "hangs", 0.0), (2, 1, 1, "user", "self", 0.0), (None, 1, None, "user", "null tree", 0.0), (3, None, 1, "user", "null node", 0.0)]
    df = spark.createDataFrame([*rows, *rows, *loop, (1, 5, 4, None, "f", None)], "tree long, node long, parent long, role string, text string, score double")
    got = {r.tree: [tuple(t) for t in r.turns] for r in chat.conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert got == {1: [("user", "root"), ("assistant", "a"), ("user", "b"), ("assistant", ""), ("", "e")], None: [("user", "null tree")]}


def test_warc_hot_payload_is_whole(spark):
    big = "same " * 300
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit(big)).otherwise(F.concat(F.lit(big), F.col("id").cast("string"))).alias("html"))
    got = warc.round_trip(pages).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in got} == {"response": 1001, "revisit": 1999}


def test_shared_folder_without_checkpoint_dir(spark):
    conf = SimpleNamespace(get=lambda name, *default: None if name == "spark.checkpoint.dir" else spark.conf.get(name))
    got = shared_dir(SimpleNamespace(conf=conf, sparkContext=spark.sparkContext), "x")
    assert got.startswith("file:///") and spark.conf.get("spark.sql.warehouse.dir").split(":")[-1].strip("/") in got


def test_texts_longer_than_slices_and_chunks(spark):
    rng = np.random.default_rng(31)
    body = rng.integers(0, 10**6, 420_000).astype(str).tolist()
    rows = [(1, " ".join(body)), (2, " ".join(body[:300_000])), (3, "x " + " ".join(body[1000:1040]) + " y"), (4, " ".join(body))]
    assert len(rows[0][1]) > 2_800_000
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(docs(spark, rows)).collect()}
    assert got == brute_substrings(rows)
    comps = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows), k=3, percent=90).collect()}
    assert comps == brute_components(rows, 3, 90)
    items = spark.createDataFrame([(7, " ".join(body[400_000:400_060])), (8, "no such words anywhere here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs(spark, rows), items).collect()} == {(1, 7), (4, 7)}
    assert {r.n_words for r in licenses.license_scan(docs(spark, rows)).collect()} == {420_000, 300_000, 42}
    done = pieces.encode_samples(docs(spark, rows[:2]), keep_ids=0).collect()
    assert {r.doc_id for r in done} == {1, 2} and all(r.lossless for r in done)  # of digits there is one segmentation


def test_words_are_hashed_alike_in_blocks(monkeypatch):
    from sketchloom.llm import text

    data, off = text_bytes(pa.array(["some words " * 50 + "z" * 700, "and more", "", "words"]))
    starts, ends, _ = text.spans(data, off, text.WHITE)
    want = [text.word_hashes(data, starts, ends, salt) for salt in (0, 1)]
    assert not (want[0] == want[1]).any()
    for block in (1, 50, 300):
        monkeypatch.setattr(text, "BLOCK", block)
        assert all((text.word_hashes(data, starts, ends, salt) == want[salt]).all() for salt in (0, 1))


def test_jaccard_with_many_flushes_and_ranges(spark, monkeypatch):
    """Components don't depend on when tasks send signatures on or on the number of hash ranges."""
    rng = np.random.default_rng(8)
    vocab, rows = [f"w{i}" for i in range(300)], []
    for _ in range(8):
        body = rng.choice(vocab, int(rng.integers(40, 200))).tolist()
        for _ in range(10):
            copy = list(body)
            copy[int(rng.integers(0, len(copy)))] = "other"
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(jaccard, "FLUSH", (50, 100))
    monkeypatch.setattr(jaccard, "RANGE", (100, 300))
    monkeypatch.setattr(jaccard, "RANGES", 40)
    total = sum(len(set(zip(*(t.split()[i:] for i in range(5))))) for _, t in rows)
    n_groups, flush_at = jaccard.extent(total, 1)
    assert n_groups > 30 and flush_at == 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows, 5, 80)


@pytest.mark.parametrize(("shingles", "least_in_a_row"), [(5_000_000_000, 500), (500_000_000_000, 50)])
def test_packed_rows_of_the_join_stay_long(shingles, least_in_a_row):
    """At 30 GB and 3 TB of text: signatures that one flush sends to one hash range."""
    n_groups, flush_at = jaccard.extent(shingles, 200)
    assert flush_at / n_groups >= least_in_a_row and shingles / n_groups <= 8_000_000


def test_jaccard_compares_each_pair_across_components_once(spark, monkeypatch):
    rng, calls = np.random.default_rng(9), []
    rows = []
    for base in range(12):
        body = rng.choice([f"w{i}" for i in range(300)], int(rng.integers(20, 120))).tolist()
        for i in range(10):
            some = list(body)
            for at in rng.integers(0, len(body), int(rng.integers(0, 4))):
                some[at] = f"x{rng.integers(50)}"
            rows.append((base * 100 + i, " ".join(some)))
    split = jaccard._split
    monkeypatch.setattr(jaccard, "_split", lambda *a: calls.append(1) or split(*a))
    want = brute_components(rows, 3, 90)
    for at_once, per_member in ((10**6, 10**6), (-1, -1)):  # no rounds with pivots, and as many as find links
        monkeypatch.setattr(jaccard, "AT_ONCE", at_once, raising=False)
        monkeypatch.setattr(jaccard, "PER_MEMBER", per_member)
        calls.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows), k=3, percent=90).collect()}
        assert got == want
        assert at_once < 0 or len(calls) == 1  # what is found last leads to no further round


def test_jaccard_pairs_of_a_common_subset_grow_with_those_that_probe(spark):
    bits = [0] * jaccard.BITMAP
    rows = [(1, i, i // 3, i in (5, 6, 700), (30, *bits)) for i in range(6000)] + [(2, i, i, True, (30 + 30 * (i % 2), *bits)) for i in range(6)]
    split = spark.createDataFrame(rows, f"sig long, id long, label long, probe boolean, s struct<n: long, {', '.join(f'b{i}: long' for i in range(jaccard.BITMAP))}>")
    want = {(min(i, j), max(i, j)) for i in (5, 6, 700) for j in range(6000) if i // 3 != j // 3} | {(i, j) for i in range(6) for j in range(i + 1, 6) if (i + j) % 2 == 0}
    got = [(r.a, r.b) for r in jaccard._across(split, 80).collect()]
    assert set(got) == want and len(got) == len(want)
    assert not jaccard._many(split, 4) and jaccard._many(split, 2)  # of all pairs there are some 3,000 for each member
