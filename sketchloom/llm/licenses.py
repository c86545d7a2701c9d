"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words, joined by one space. Each of the rules, which ``license_rules`` has
in their order, has keywords of its own, one for each alternative of its pattern, of which any must be there before the
pattern is tried; one pass over the text finds all keywords. The prefilter doesn't change what is found.
Detections are word intervals. A detection inside another one of the same or a higher priority is suppressed, and of
equal intervals the earlier rule's stays.

Base phrases are found in any case, and aren't suppressed.

Defined cases: a NULL or empty text has no words, no labels and score 0; rows are independent of each other, and
repeated rows have equal results; long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sketchloom.llm.common import slices, text_bytes
from sketchloom.llm.license_rules import SIGNATURES

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

class Rule(NamedTuple):
    order: int
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


RULES = [Rule(i, label, keywords, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), priority, confidence) for i, (label, keywords, pattern, priority, confidence) in enumerate(SIGNATURES)]


def _automaton() -> ahocorasick.Automaton:
    """Finds all keywords in one pass, each with the numbers of the rules that it opens."""
    rules: dict[str, list[int]] = {}
    for r in RULES:
        for k in r.keywords:
            rules.setdefault(k, []).append(r.order)
    out = ahocorasick.Automaton()
    for k, orders in rules.items():
        out.add_word(k, tuple(orders))
    out.make_automaton()
    return out


_KEYWORDS = _automaton()
_BASE = [(re.compile(rf"(?<= ){p}(?= )".encode()), v) for p, v in BASE.items()]
#: Bytes of words as they are, small letters for A-Z, and a space for the rest.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


class Detection(NamedTuple):
    start: int
    end: int
    rule: Rule


def matches(joined: bytes, prefilter: bool = True) -> list[Detection]:
    """What each rule finds. Without ``prefilter`` all patterns are tried, to the same effect."""
    rules = RULES
    if prefilter:
        open_to = {o for _, orders in _KEYWORDS.iter(joined.decode("latin-1")) for o in orders}
        rules = [RULES[o] for o in sorted(open_to)]
    return [Detection(m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(joined)]


def detect(joined: bytes) -> list[Detection]:
    """Detections that stay, by where they start. ``joined``: words with a space before each and at the end."""
    found = matches(joined)
    # wide ones first, and at the same start and end the one of higher priority, then the earlier rule
    found.sort(key=lambda d: (d.start, -d.end, d.rule.priority, d.rule.order))
    kept: list[Detection] = []
    reach: dict[int, int] = {}  # furthest end so far of the detections of each priority; starts only grow
    for d in found:
        if all(end < d.end for p, end in reach.items() if p <= d.rule.priority):
            kept.append(d)
        reach[d.rule.priority] = max(reach.get(d.rule.priority, 0), d.end)
    return kept


def scan(raw: bytes) -> dict:
    """Everything about one text; places and spans count words from 0."""
    words = raw.translate(_TO_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    base = sorted((m.start(), label) for p, label in _BASE for m in p.finditer(joined)) if b" license " in joined else []
    kept = detect(joined)
    at, seen, place = 0, 0, {}
    for p in sorted({b[0] for b in base} | {d.start for d in kept} | {d.end for d in kept}):
        seen += joined.count(b" ", at, p)
        at, place[p] = p, seen - 1
    labels = {b[1] for b in base}
    spans = [{"first": place[d.start], "last": place[d.end], "label": d.rule.label, "rule": d.rule.order, "confidence": d.rule.confidence} for d in kept]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": place[base[0][0]] if base else None,
        "last_word": place[base[-1][0]] if base else None,
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {d.rule.label for d in kept})),
        "score": max([0.6 * bool(base), *(d.rule.confidence for d in kept)]),
        "detections": spans,
    }


_ARROW = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("rule", pa.int32()), ("confidence", pa.float64())])
_TYPES = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(_ARROW))]
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first: long, last: long, label: string, rule: int, confidence: double>>"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts, labels, score, and the detections as word spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = text_bytes(b.column(1))
            raw = data.tobytes()
            rows = [scan(raw[off[i] : off[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], t) for n, t in _TYPES)], names=[key, *(n for n, _ in _TYPES)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {_DDL}")
