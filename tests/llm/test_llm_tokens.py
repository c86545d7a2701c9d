"""Packing, alignment and spelling variants against plain Python, over whole small tables and edge cases."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import EDGE, docs, lower

from sketchloom.llm import alignment, packing, variants
from sketchloom.llm.common import table
from sketchloom.llm.registry import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(d["doc_id"], d["text"]) for d in table(spark, D, "documents").toArrow().to_pylist()]


# packing


def plain_pieces(rows, encoder, size=4096):
    out = []
    for k, t in rows:
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out += [(k, i // size, i, np.array(ids[i : i + size], "<u4").tobytes()) for i in range(0, len(ids), size)]
    return out


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(open(packing.TOKENIZER, "rb").read())


def assert_packed(rows, size):
    """No overlaps or gaps, and at most one sequence of a hundred more than there must be (two with few)."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    assert len(by) <= max(1.01 * sum(n for *_, n in rows) / size + 1, 0)


def test_op11(spark, documents, encoder):
    got = QUERIES["op11_best_fit_packing"](spark, D).collect()
    want = {(k, p): (s, len(b) // 4, zlib.crc32(b)) for k, p, s, b in plain_pieces(documents, encoder)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert_packed([(r.sequence_id, r.offset, r.length) for r in got], 4096)


def test_packing_edges(spark, encoder):
    rows = EDGE + [(9, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>"), (10, "it's 'S x'd (\"q\")'ll 12a3")]
    got = packing.pack(docs(spark, rows), size=64).collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got))) == sorted(map(str, plain_pieces(rows, encoder, 64)))
    assert_packed([(r.sequence_id, r.offset, r.length) for r in got], 64)
    whole = packing.sequences(packing.pack(docs(spark, rows), size=64)).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in got) and all(len(r.ids) == 4 * r.length <= 256 for r in whole)
    assert packing.pack(docs(spark, []).limit(0)).count() == 0
    odd = spark.createDataFrame([("x", "a b"), (None, "c")], "`piece` string, `te.xt` string")
    out = packing.pack(odd, key="piece", text="te.xt")
    assert out.columns == ["piece", "_piece", "start", "length", "ids", "sequence_id", "offset"] and {r["piece"] for r in out.collect()} == {"x", None}


def test_units_are_encoded_as_whole_texts_are(encoder):
    rng = random.Random(1)
    parts = ["a", "B", "z", "s", "t", "re", "'", "'s", "’", "—", "-", ".", "(", '"', "5", "12", "é", "é", "́", "ﬁ", "中", " ", " ", "\n", " ", "İ", "Σ", "ß", "①", "_", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", "😀", "‍", "\x00", "Å", "가", "१"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    ids, off = encoder.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def plain_best_two_fit(lengths, size):
    """One bin after the other: numbers of bins' lengths."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], size
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        if gap and len(own) > 1:
            short = min(own)
            pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if short < a + b <= gap + short]
            if pairs:
                total, a = max(pairs, key=lambda p: p[0])
                own.remove(short)
                left.append(short)
                for x in (a, total - a):
                    own.append(x)
                    left.remove(x)
                left.sort(reverse=True)
        bins.append(sum(own))
    return bins


def test_patterns_are_what_a_packer_of_single_documents_does():
    rng = random.Random(2)
    for _ in range(300):
        size = rng.choice([8, 20, 64])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 60))] + [rng.randint(1, size)] * rng.randint(0, 30)
        counts = np.bincount(lengths, minlength=size + 1)
        plan = packing.best_two_fit(counts, size)
        length, rank = np.repeat(np.arange(size + 1), counts), np.concatenate([np.arange(c) for c in counts])
        sequence, offset = plan.place(length, rank)
        order = np.lexsort((offset, sequence))
        filled = Counter()
        for i in order:
            assert offset[i] == filled[sequence[i]]
            filled[sequence[i]] += int(length[i])
        assert sorted(filled) == list(range(plan.sequences)) and max(filled.values()) <= size
        assert sorted(filled.values()) == sorted(plain_best_two_fit(lengths, size))


# alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*(open(p, "rb").read() for p in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))


def plain_alignments(rows, pair):
    """Whole texts, without segments."""
    each = []
    for k, t in rows:
        full, groups, na, nb = (" " + (t or "")).encode(), [], 0, 0
        if t:
            a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
            xs, ys = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
            if b"".join(xs) == full == b"".join(ys):
                na, nb = len(a), len(b)
                ea, eb = np.cumsum([len(x) for x in xs]).tolist(), np.cumsum([len(y) for y in ys]).tolist()
                both = sorted(set(ea) & set(eb))
                groups = [([], []) for _ in both]
                for side, ids, ends in ((0, a, ea), (1, b, eb)):
                    for i, e in zip(ids, ends):
                        groups[bisect.bisect_left(both, e)][side].append(i)
        each.append((k, na, nb, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    df = Counter(p for *_, links in each for p in set(links))
    top = defaultdict(int)
    for (x, _), n in df.items():
        top[x] = max(top[x], n)
    return [(k, na, nb, len(g), len(ls), sum(df[p] == top[p[0]] for p in ls), sum(df[p] for p in ls), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for k, na, nb, g, ls in each]


def test_op12(spark, documents, pair):
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op12_cross_tokenizer_alignment"](spark, D).collect()}
    want = {k: (*r, hashlib.sha256(g.encode()).hexdigest() if g else "") for k, *r, g in plain_alignments(documents, pair)}
    assert got == want


def test_alignment_edges(spark, pair):
    rows = EDGE + [(9, "foo▁ bar foo bar"), (10, "foo bar\n\n  baz\t\tx  y  z  "), (11, " "), (12, "\n"), (13, "<s> <|endoftext|> </s><0x41> <unk>"), (14, "a\u0085 b’ c퟿ d\x1c e 中 文 😀 f"), (15, "x" * 3000 + " " * 50 + "é" * 500)]
    got = alignment.cross_align(docs(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_alignments(rows, pair)))
    assert alignment.cross_align(docs(spark, []).limit(0)).count() == 0
    assert alignment.cross_align(docs(spark, [(1, None), (2, "")])).agg({"n_a": "sum"}).first()[0] == 0
    odd = spark.createDataFrame([("x", "a b"), (None, "c")], "`groups` string, `te.xt` string")
    out = alignment.cross_align(odd, key="groups", text="te.xt")
    assert out.columns[0] == "groups" and out.columns[-1] == "_groups" and {r["groups"] for r in out.collect()} == {"x", None}


def test_texts_are_split_where_nothing_is_merged(pair):
    assert pair.splits == [" ", "\n", "\t"] and not pair._safe("\r", ["a\r"]) and not pair._safe("\n", ["x\n"])
    rng = random.Random(3)
    parts = ["a", "the", "'s", " ", "  ", "\n", "\r\n", "\t", " ", " ", "　", "’", "é", "中", "1", "!", "​", "\x1c", "\x85", "�", "�a", " "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        full = (" " + t).encode()
        inside = np.zeros(256, bool)
        inside[[ord(c) for c in pair.splits]] = True
        places = [0, *alignment.split_places(np.frombuffer(full, np.uint8), inside).tolist(), len(full)]
        segments = [full[x:y].decode() for x, y in zip(places, places[1:])]
        a, b = pair.encode(segments)
        assert [i for x in a for i in x] == pair.a.encode(" " + t, add_special_tokens=False).ids, t
        assert [i for x in b for i in x] == pair.b.encode(t), t


# spelling variants


def plain_variants(rows):
    n = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        x = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = (x - {w}) & n.keys()
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] and max(n[x] for x in near[w]) >= 10 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_op13(spark, documents):
    got = {r.word: tuple(r[1:]) for r in QUERIES["op13_spelling_variants"](spark, D).collect()}
    want = plain_variants(documents)
    assert got == want and len(want) > 500


@pytest.mark.parametrize("kw", [{}, {"shard": 40}, {"hot": 5}])
def test_variants_edges(spark, kw):
    chain = ["kitchen"] * 1200 + ["kitchenx"] * 110 + ["kitchenxy"] * 10 + ["aitchen"] * 110 + ["bitchen"] * 2 + ["kitchensa", "kitchensb"] * 2
    same = [f"prefixes{c}{d}" for c in "abcdé" for d in "xyz÷"] * 2 + [f"{c}{d}suffixes" for c in "abc" for d in "xyz"] * 2 + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 2
    rows = EDGE + [(20 + i, " ".join(x)) for i, x in enumerate((chain, same, [w.upper() for w in same], ["ÀÉÎÕÜßÿ"] * 40, ["àÉÎÕÜßÿ"] * 3))] + [(None, "letters lettersx letters1lettersx")]
    got = {r.word: tuple(r[1:]) for r in variants.variants(docs(spark, rows), **kw).collect()}
    want = plain_variants(rows)
    assert got == want and any(w != r[1] != r[0] for w, r in want.items())
    assert variants.variants(docs(spark, []).limit(0)).count() == 0


def test_a_half_that_very_many_words_share_makes_no_pairs_but_near_ones():
    rng = random.Random(4)
    words = sorted({"abc" + "".join(rng.choice("defghijklmnopqrstu") for _ in range(6)) for _ in range(3000)})
    half = variants.Half()
    for w in words:
        half.add(w[3:], w, 1)
    assert sum(map(len, half.masked.values())) == 6 * len(words)
    some = words[:40]
    for w in some:
        near = {x for x in words if len(x) == len(w) and sum(a != b for a, b in zip(x, w)) == 1}
        assert {"abc" + r for r in half.near(w[3:])} == near
    rows = pa.table({"left": [True] * 4, "segment": ["abc"] * 4, "word": ["abcdefgh", "abcdefg", "xabcdefg", "abcdexg"], "n": [2, 3, 4, 5], "own": [True, True, False, False]})
    assert sorted((r["word"], r["near"]) for r in variants.scan(rows).to_pylist()) == [("abcdefg", "abcdefgh"), ("abcdefgh", "abcdefg"), ("abcdexg", "abcdefg")]
