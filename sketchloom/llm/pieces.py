"""SentencePiece encoding and decoding with Gumbel top-k sampling of segmentations.

The lattice of a text has an edge for each piece of the vocabulary that stands in it, and byte pieces for characters that
are no piece themselves. A space counts as the vocabulary's space sign, one is put before the text, and decoding takes it
off again; a space sign in the text itself is spelled in byte pieces, so that decoding gives back every text exactly.
The model's merges are ranked; a piece of rank r has a weight of 1 / (r + 1), normed over the vocabulary.

Segmentations are drawn without replacement in the order of their perturbed log-probabilities, by A-star search. A
region of the search is all segmentations that share a prefix and then leave out some edges; its Gumbel maximum is drawn
top-down, truncated by that of the region it came from, and it is the search's exact bound. The best region is taken
from the queue, its segmentation is drawn along the lattice's backward sums, and the rest of the region is split by where
a segmentation first departs from it. k + 1 regions are looked at; the last gives the threshold of the inclusion scores.

No piece has a space after another character, so that the lattice falls apart into words; a batch's distinct words are
solved together. Random numbers depend on the row's key, the sample's number and the place in the text, and on nothing else.

Defined cases: a NULL or empty text has one segmentation, of no pieces; texts with fewer segmentations than k give all of
them; rows that repeat a key and text have equal samples; a NULL key has a seed like others; long texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import slices, text_bytes
from sketchloom.llm.text import BASE, MULTIPLIERS, VALUES, mix, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
_U = np.uint64
_SLOT_BITS = 20
#: Bytes of text of which the lattice is built at once: little enough for its arrays to stay in a core's cache.
BATCH = 1 << 17
#: A lattice's probabilities are times exp(RATE) for each byte, and those of long words are scaled again every so many bytes.
RATE, RESCALE = 2.0, 32
#: No Gumbel at a location is greater than that by more than this, as -log of a uniform number is 2 ** -54 at least.
REACH = 37.5
#: Departures are looked at down to this much under a region's start, in logs, and further down where that can't be enough.
DEEP = 45.0
#: A text of more bytes is gone through in parts of about this size, so that its lattice is never held whole.
PART = 1 << 18


def _longer(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hash of stretches of bytes that are longer by one. It is compared whole, and its slot mixes it."""
    return h * _U(BASE) + VALUES[0][byte]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * MULTIPLIERS[50] >> _U(64 - _SLOT_BITS)).astype(np.int64)


class Vocabulary:
    """Pieces as bytes, log-probabilities, and a table from hashes to ids. What is broadcast has the vocabulary's size."""

    def __init__(self, pieces: list[bytes | None], logp: np.ndarray, byte_ids: np.ndarray) -> None:
        self.pieces, self.logp, self.byte_ids = pieces, logp, byte_ids
        self.flat = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)
        self.size = np.array([len(p or b"") for p in pieces])
        self.begin = np.cumsum(self.size) - self.size
        known = [(i, p) for i, p in enumerate(pieces) if p and i not in set(byte_ids.tolist())]
        # all beginnings of pieces, with the piece's id where one is a piece itself
        starts = {p[:i]: -1 for _, p in known for i in range(1, len(p))} | {p: i for i, p in known}
        self.hashes = np.zeros(len(starts), np.uint64)
        flat = np.frombuffer(b"".join(starts), np.uint8)
        size = np.array([len(p) for p in starts])
        begin, on = np.cumsum(size) - size, np.arange(len(starts))
        for i in range(int(size.max())):
            on = on[size[on] > i]
            self.hashes[on] = _longer(self.hashes[on], flat[begin[on] + i])
        self.ids = np.array(list(starts.values()), np.int32)
        # the first two bytes are looked up by themselves: -2 where they begin no piece
        self.single, self.double = np.full(256, -2, np.int32), np.full(1 << 16, -2, np.int32)
        for p, i in starts.items():
            if len(p) == 1:
                self.single[p[0]] = i
            elif len(p) == 2:
                self.double[p[0] << 8 | p[1]] = i
        self.longest = max(len(p) for _, p in known)
        self.weight = np.exp(np.where(np.isfinite(logp), logp + RATE * self.size, -np.inf))
        self.tables = []
        left = np.arange(len(starts))
        while len(left):  # pieces that share a slot go to the next table
            slot = _slot(self.hashes[left])
            _, first = np.unique(slot, return_index=True)
            t = np.full(1 << _SLOT_BITS, -1, np.int32)
            t[slot[first]] = left[first]
            self.tables.append(t)
            left = np.delete(left, first)
        joint = np.zeros(256, bool)
        for _, p in known:
            if len(p) > 1:
                joint[list(p)] = True
        self.alone = ~joint  # bytes that no longer piece has

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces: list[bytes | None] = [None] * n
        rank, byte_ids = np.zeros(n), np.full(256, -1, np.int32)
        for i in range(n):
            if m.is_byte(i):
                b = int(m.id_to_piece(i)[3:5], 16)
                pieces[i], byte_ids[b], rank[i] = bytes([b]), i, n
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                piece = m.id_to_piece(i).replace("▁", " ").encode()
                if b" " not in piece.lstrip(b" "):
                    pieces[i], rank[i] = piece, -m.get_score(i)
        used = np.array([p is not None for p in pieces])
        logp = np.where(used, -np.log(np.maximum(rank, 0) + 1), -np.inf)
        return cls(pieces, logp - np.log(np.exp(logp[used]).sum()), byte_ids)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are of beginnings of pieces, in order, and the ids of those that are pieces (else -1)."""
        slot = _slot(h)
        c = self.tables[0][slot]
        at = np.flatnonzero(c >= 0)
        c = c[at]
        good = self.hashes[c] == h[at]
        found = np.where(good, self.ids[c], -2)
        for t in self.tables[1:]:  # only slots that are taken can have been taken twice
            left = np.flatnonzero(~good)
            c = t[slot[at[left]]]
            on = np.flatnonzero(c >= 0)
            on = on[self.hashes[c[on]] == h[at[left[on]]]]
            good[left[on]] = True
            found[left[on]] = self.ids[c[on]]
        return at[good], found[good]


def decode(vocabulary: Vocabulary, ids) -> bytes:
    """The text that the ids spell."""
    ids = np.asarray(ids)
    out = []
    for lo in range(0, len(ids), PART):  # a long text's index arrays aren't held whole
        some = ids[lo : lo + PART]
        size = vocabulary.size[some]
        end = np.cumsum(size)
        out.append(vocabulary.flat[np.arange(end[-1]) + np.repeat(vocabulary.begin[some] - (end - size), size)].tobytes())
    return b"".join(out)[1:]


def _spelt(v: Vocabulary, each: list[np.ndarray]) -> list[bytes]:
    """What ``decode`` gives for each, for short ones at once."""
    if sum(map(len, each)) > PART:
        return [decode(v, ids) for ids in each]
    flat = np.concatenate(each)
    text = b" " + decode(v, flat)
    end = np.concatenate([[0], np.cumsum(v.size[flat])])[np.cumsum([len(ids) for ids in each])].tolist()
    return [text[a + 1 : b] for a, b in zip([0, *end], end)]


class Lattice:
    """Edges from all places of some words, with their probabilities given that a segmentation comes by their start.

    Backward sums go from the words' ends to their starts, for all words in step; edges lie in memory in that order. The
    sums are plain probabilities, with a factor for each byte that keeps them near 1; those of long words are scaled
    again every RESCALE bytes. With ``ahead``, data is a part of one longer word and ``ahead`` the sums, up to a factor,
    of the places behind that part's own, as many as data has bytes more. With ``best`` maxima take the place of sums, and
    the edges on likeliest ways have probability 1.
    """

    def __init__(self, v: Vocabulary, data: np.ndarray, ends: np.ndarray, ahead: np.ndarray | None = None, best: bool = False) -> None:
        n, more = len(data), 0 if ahead is None else len(ahead) - 1
        size = np.diff(np.concatenate([[0], ends]))
        left = np.repeat(ends, size) - np.arange(n)  # bytes up to the word's end
        own = data[: n - more]
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        at, h = np.empty(0, np.int64), np.empty(0, np.uint64)
        for length in range(1, v.longest + 1):
            if length == 1:
                ids = v.single[own]
                at = np.flatnonzero(ids > -2)
                ids = ids[at]
            elif length == 2:
                at = at[left[at] > 1]
                ids = v.double[data[at].astype(np.int32) << 8 | data[at + 1]]
                on = np.flatnonzero(ids > -2)
                at, ids = at[on], ids[on]
                h = _longer(_longer(np.zeros(len(at), np.uint64), data[at]), data[at + 1])
            else:
                on = np.flatnonzero(left[at] >= length)
                at = at[on]
                h = _longer(h[on], data[at + (length - 1)])
                on, ids = v.lookup(h)
                at, h = at[on], h[on]
            if not len(at):
                break
            hit = np.flatnonzero(ids >= 0)
            found.append((length, at[hit], ids[hit]))
        # bytes of characters that are no piece
        alone = (own < 0x80) & (v.single[own] < 0)
        if (data >= 0x80).any():
            char = np.flatnonzero((data & 0xC0) != 0x80)
            width = np.diff(np.append(char, n))
            wide = np.zeros(n, np.int32)
            wide[char] = width
            covered = np.zeros(n, bool)
            for length, begin, _ in found:
                if length <= 4:
                    covered[begin[wide[begin] == length]] = True
            alone = ~np.repeat(covered[char], width)[: n - more] if len(char) and char[0] == 0 else ~covered[: n - more]
        lone = np.flatnonzero(alone)
        found.insert(0, (1, lone, v.byte_ids[data[lone]]))
        self.degree = np.zeros(n, np.int32)
        for _, begin, _ in found:
            self.degree[begin] += 1
        nodes = np.flatnonzero(self.degree)
        far = left[nodes]
        nodes = nodes[np.argsort(far.astype(np.min_scalar_type(int(size.max(initial=0)))), kind="stable")]
        degree = self.degree[nodes]
        offset = np.concatenate([[0], np.cumsum(degree)])
        self.first = np.zeros(n, np.int64)
        self.first[nodes] = offset[:-1]
        total = int(offset[-1])
        self.length, self.ids = np.empty(total, np.int32), np.empty(total, np.int32)
        free = self.first.copy()
        for length, begin, ids in reversed(found):  # the longest edge of a place first, which mostly is the likeliest
            slot = free[begin]
            self.length[slot], self.ids[slot] = length, ids
            free[begin] += 1
        # each word has a place of its own for its end
        place = nodes + np.repeat(np.arange(len(ends)), size)[nodes]
        to = np.repeat(place, degree) + self.length
        x = v.weight[self.ids]
        beta = np.zeros(n + len(ends))
        last = ends + np.arange(len(ends))
        beta[last] = 1.0
        if ahead is not None:
            beta[n - more :] = ahead
        long = np.flatnonzero(size >= RESCALE)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left[nodes], minlength=1))])
        node_sum = np.empty(len(nodes))
        for d in range(1 + more, len(bounds) - 1):
            a, b = bounds[d], bounds[d + 1]
            if a < b:
                e = slice(offset[a], offset[b])
                x[e] *= beta[to[e]]
                node_sum[a:b] = (np.maximum if best else np.add).reduceat(x[e], offset[a:b] - offset[a])
                beta[place[a:b]] = node_sum[a:b]
            if d % RESCALE == 0:
                words = long = long[size[long] >= d]
                window = last[words][:, None] - np.arange(max(0, d - v.longest + 1), d + 1)
                high = beta[window].max(axis=1)
                beta[window] /= np.where(high > 0, high, 1.0)[:, None]
        self.ahead = beta[: v.longest] / max(beta[: v.longest].max(initial=0.0), 1e-300)
        node_sum[node_sum == 0] = 1.0
        self.p = x / np.repeat(node_sum, degree) if not best else (x >= np.repeat(node_sum, degree)).astype(float)
        self.upto = np.cumsum(self.p)

    def choose(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place, by a number from 0 to 1."""
        e = self.first[at]
        final = e + self.degree[at] - 1
        u = u + (self.upto[e] - self.p[e])
        more = np.flatnonzero((u >= self.upto[e]) & (e < final))
        while len(more):
            e[more] += 1
            x = e[more]
            more = more[(u[more] >= self.upto[x]) & (x < final[more])]
        return e

    def log_rest(self, at: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Log of what the edges of each place have together besides ``e``: summed where the difference from 1 is small."""
        rest = 1.0 - self.p[e]
        few = np.flatnonzero(rest < 1e-6)
        rest[few] = 0.0
        few = few[self.degree[at[few]] > 1]
        if len(few):
            count = self.degree[at[few]]
            end = np.cumsum(count)
            first = self.first[at[few]]
            p = self.p[np.arange(end[-1]) + np.repeat(first - (end - count), count)]
            p[end - count + (e[few] - first)] = 0.0
            rest[few] = np.add.reduceat(p, end - count)
        with np.errstate(divide="ignore"):
            return np.log(rest)

    def edges(self, at: int) -> range:
        return range(int(self.first[at]), int(self.first[at]) + int(self.degree[at]))


def _uniform(seed: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    h = mix(seed + place.astype(np.uint64) * MULTIPLIERS[40] + _U((turn * int(MULTIPLIERS[41])) & ((1 << 64) - 1)))
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at location ``mass`` that are at most ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        g = mass - np.log(np.exp(mass - bound) + np.maximum(-np.log(u), 2.0**-54))
    return np.where(np.isfinite(mass), np.minimum(g, bound), -np.inf)


def sample(v: Vocabulary, raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int = SAMPLES) -> list[list[tuple]]:
    """For each text up to k rows (ids, log-probability, perturbed log-probability, log of the inclusion score)."""
    n = np.diff(offsets)
    some = n > 0
    size = n + some  # with the space before each text
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.empty(off[-1], np.uint8)
    data[off[:-1][some]] = 0x20
    for i in np.flatnonzero(some).tolist():
        data[off[i] + 1 : off[i + 1]] = raw[offsets[i] : offsets[i + 1]]
    out: list[list[tuple]] = [[] if s else [(np.empty(0, np.int32), 0.0, 0.0, 0.0)] for s in some]
    if not len(data):
        return out
    cut = _cuts(v, data, off)
    edges, word_of = np.flatnonzero(cut), np.cumsum(cut[:-1], dtype=np.int32) - 1
    ws, we = edges[:-1], edges[1:]
    h = word_hashes(data, ws, we)
    _, lead, which = np.unique(h, return_index=True, return_inverse=True)
    length = (we - ws)[lead]
    ends = np.cumsum(length)
    take = np.repeat(ws[lead] - (ends - length), length) + np.arange(ends[-1])
    lat = Lattice(v, data[take], ends)
    shift = (ends - length)[which] - ws  # from a place in the texts to one in the lattice, for each word
    doc_word = np.searchsorted(ws, off)
    doc = np.repeat(np.arange(len(n)), np.diff(doc_word))
    seed = mix(keys.astype(np.int64).view(np.uint64) * MULTIPLIERS[42])
    start = (seed - off[:-1].astype(np.uint64) * MULTIPLIERS[40])[doc]  # to which a place in all texts is added, times its number

    def walk(chosen: np.ndarray, words: np.ndarray, at: np.ndarray, turn: int) -> None:
        base, by, stop = start[words], shift[words], we[words]
        while len(at):
            e = lat.choose(at + by, _uniform(base, at, turn))
            chosen[at] = e
            at = at + lat.length[e]
            go = np.flatnonzero(at < stop)
            at, base, by, stop = at[go], base[go], by[go], stop[go]

    docs = np.flatnonzero(some)
    chosen = np.full(len(data), -1, np.int64)
    walk(chosen, np.arange(len(ws)), ws, 0)
    bound = np.full(len(n), -np.inf)
    bound[docs] = -np.log(-np.log(_uniform(seed[docs], np.zeros(len(docs)), 1000)))
    # queue of each text: (perturbed, place of the first free edge, edges left out there, segmentation it departs from)
    queue: list[list[tuple]] = [[] for _ in range(len(n))]
    begin = off[:-1].copy()  # where the region of the current segmentation begins to be free
    left_out: list[tuple] = [()] * len(n)
    results: dict[int, list] = {int(d): [] for d in docs}
    fresh, source = docs, chosen
    for turn in range(k):
        # segmentations ``source`` of the texts ``fresh``: note them, and split the rest of their regions
        place = np.flatnonzero(source >= 0)
        e = source[place]
        run, stop, lead = (np.searchsorted(place, x) for x in (off[fresh], off[fresh + 1], begin[fresh]))
        total = np.concatenate([[0.0], np.cumsum(np.log(lat.p[e]))])
        first_mass = {}
        for i, d in enumerate(fresh.tolist()):
            a, b, j = int(run[i]), int(stop[i]), int(lead[i])
            results[d].append((lat.ids[e[a:b]], float(total[b] - total[a]), float(bound[d])))
            if left_out[d]:  # at its first free place the region leaves out what its parents did, too
                node = int(place[j] + shift[word_of[place[j]]])
                rest = sum(lat.p[x] for x in lat.edges(node) if x != e[j] and x not in left_out[d])
                first_mass[i] = total[j] - total[a] + np.log(rest) if rest > 0 else -np.inf
        deep = total[lead] - DEEP
        while True:  # where the regions may be departed from: sums fall along a text, so that these are the first places
            upto = np.clip(np.searchsorted(-total[:-1], -deep, side="right"), lead + 1, stop)
            count = upto - lead
            end = np.cumsum(count)
            free = np.arange(end[-1]) + np.repeat(lead - (end - count), count)
            own, at = np.repeat(fresh, count), place[free]
            mass = total[free] - np.repeat(total[run], count) + lat.log_rest(at + shift[word_of[at]], e[free])
            for i, m in first_mass.items():
                mass[end[i] - count[i]] = m
            g = _truncated(mass, bound[own], _uniform(seed[own], at - off[own], 2000 + turn))
            found = []
            for _ in range(k - turn):
                top = np.maximum.reduceat(g, end - count)
                best = np.flatnonzero(g == np.repeat(top, count))
                best = best[np.isfinite(g[best])]
                _, one = np.unique(own[best], return_index=True)
                found += [(int(own[j]), float(g[j]), int(at[j]), int(e[free[j]])) for j in best[one].tolist()]
                g[best[one]] = -np.inf
            # what comes later could be among them only where it may reach the last of them
            enough = top - REACH + total[run]
            if not ((upto < stop) & (enough <= total[upto])).any():
                break
            deep = np.minimum(deep, enough)
        for d, x, j, edge in found:
            queue[d].append((x, j, (*left_out[d], edge) if j == begin[d] and left_out[d] else (edge,), source))
        if turn == k - 1:
            break
        # the best region of each text
        words_at, begins = [], []
        target = np.full(len(data), -1, np.int64)
        nxt = []
        for d in fresh.tolist():
            if not queue[d]:
                continue
            q = max(range(len(queue[d])), key=lambda i: queue[d][i][0])
            bound[d], at, gone, before = queue[d].pop(q)
            target[off[d] : at] = before[off[d] : at]
            w = int(word_of[at])
            node = at + int(shift[w])
            a, b = lat.edges(node).start, lat.edges(node).stop
            p = lat.p[a:b].copy()
            p[np.array(gone) - a] = 0
            u = float(_uniform(seed[d : d + 1], np.array([at - off[d]]), 3000 + turn)[0])
            c = np.cumsum(p)
            pick = a + min(int(np.searchsorted(c, u * c[-1], side="right")), b - a - 1)
            target[at] = pick
            begin[d], left_out[d] = at, gone
            nxt.append(d)
            after = at + int(lat.length[pick])
            if after < we[w]:
                words_at.append(np.array([w]))
                begins.append(np.array([after]))
            words_at.append(np.arange(w + 1, doc_word[d + 1]))
            begins.append(ws[w + 1 : doc_word[d + 1]])
        if not nxt:
            break
        if words_at:
            walk(target, np.concatenate(words_at), np.concatenate(begins), turn + 1)
        fresh, source = np.array(nxt), target
    for d, rows in results.items():
        out[d] = _scored(rows, max((x[0] for x in queue[d]), default=-np.inf))
    return out


def _cuts(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where words begin and texts end: a space after another character begins one, and bytes that no longer piece has stand alone."""
    cut = np.zeros(len(data) + 1, bool)
    space = data == 0x20
    cut[1:-1] = space[1:] & ~space[:-1]
    alone = v.alone[data] & (data < 0x80)
    cut[:-1] |= alone
    cut[1:] |= alone
    cut[off] = True
    return cut


def _scored(rows: list[tuple], kappa: float) -> list[tuple]:
    """Rows with the log of the inclusion score, given the threshold kappa."""
    out = []
    for ids, logp, g in rows:
        x = logp - kappa
        out.append((ids, logp, g, 0.0 if x > 3.7 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))))
    return out


def sample_long(v: Vocabulary, raw: np.ndarray, key: int, k: int = SAMPLES, part: int = PART) -> list[tuple]:
    """The rows that ``sample`` gives for one text, from lattices of one part at a time.

    Parts are of whole words; a longer word is cut, and the backward sums at its cuts are found from its end first. Parts
    are gone through in order for each segmentation, from the place on where it departs from the one before.
    """
    data = np.concatenate([np.array([0x20], np.uint8), raw])
    edges = np.flatnonzero(_cuts(v, data, np.array([0, len(data)]))).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    parts: list[tuple[int, int, np.ndarray | None]] = []  # start, end, and the first word ends in it; None within a word
    ahead: dict[int, np.ndarray] = {}  # sums behind the parts that end within a word
    i = 0
    while i + 1 < len(edges):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + part, side="right")) - 1)
        a, b = int(edges[i]), int(edges[j])
        if b - a <= part or b - a <= v.longest:
            parts.append((a, b, edges[i + 1 : j + 1] - a))
        else:
            cuts = [*range(a, b - v.longest, max(part, v.longest)), b]
            parts += [(x, y, None) for x, y in zip(cuts, cuts[1:])]
            for x, y in reversed(list(zip(cuts, cuts[1:]))):
                if x > a:
                    ahead[x] = _lattice_of(v, data, x, y, None, ahead, b).ahead
        i = j
    word_end = np.repeat(edges[1:], np.diff(edges)) if any(p[2] is None for p in parts) else None
    seed = mix(np.array([key], np.int64).view(np.uint64) * MULTIPLIERS[42])
    bound = float(-np.log(-np.log(_uniform(seed, np.zeros(1), 1000)))[0])
    # (perturbed, place, lengths of the edges left out there, segmentation departed from, its log-probability up to there)
    queue: list[tuple] = []
    rows, kept, begin, left_out, source, total = [], [], 0, (), 0, 0.0
    for turn in range(k):
        if turn:
            if not queue:
                break
            bound, begin, left_out, source, total = queue.pop(max(range(len(queue)), key=lambda i: queue[i][0]))
        lengths, ids = [], []
        if begin:
            upto = int(np.searchsorted(np.cumsum(kept[source], dtype=np.int64), begin)) + 1
            lengths, ids = [kept[source][:upto]], [rows[source][0][:upto]]
        top: list[tuple] = []
        at = begin
        for a, b, ends in parts:
            if b <= at:
                continue
            lat = _lattice_of(v, data, a, b, ends, ahead, b if ends is not None else int(word_end[a]))
            first = None
            if turn and a <= begin < b:  # the edge by which it departs
                x = np.array(lat.edges(begin - a))
                c = np.cumsum(np.where(np.isin(lat.length[x], left_out), 0.0, lat.p[x]))
                u = float(_uniform(seed, np.array([begin]), 3000 + turn - 1)[0])
                first = int(x[min(int(np.searchsorted(c, u * c[-1], side="right")), len(x) - 1)])
            here, e = _walk_part(lat, seed, a, b, ends, at, first, turn)
            at = int(here[-1] + lat.length[e[-1]]) if len(here) else at
            sums = np.concatenate([[0.0], np.cumsum(np.log(lat.p[e]))])
            mass = total + sums[:-1] + lat.log_rest(here - a, e)
            if first is not None:
                rest = float(sum(lat.p[y] for y in lat.edges(begin - a) if y != first and int(lat.length[y]) not in left_out))
                mass[0] = total + np.log(rest) if rest > 0 else -np.inf
            g = _truncated(mass, np.full(len(mass), bound), _uniform(np.repeat(seed, len(here)), here, 2000 + turn))
            for y in np.argsort(-g, kind="stable")[: k - turn].tolist():
                if np.isfinite(g[y]):
                    out = (*left_out, int(lat.length[e[y]])) if here[y] == begin and left_out else (int(lat.length[e[y]]),)
                    top.append((float(g[y]), int(here[y]), out, turn, total + float(sums[y])))
            total += float(sums[-1])
            lengths.append(lat.length[e].astype(np.uint16))
            ids.append(lat.ids[e])
        kept.append(np.concatenate(lengths))
        rows.append((np.concatenate(ids), total, bound))
        queue += sorted(top, key=lambda x: (-x[0], x[1]))[: k - turn]
    return _scored(rows, max((x[0] for x in queue), default=-np.inf))


def best(v: Vocabulary, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ids of each text's likeliest segmentation; of equally likely ones that with the longer piece where they differ first.

    It falls apart into words as the lattice does, which are gone through in parts.
    """
    n = np.diff(offsets)
    off = np.concatenate([[0], np.cumsum(n + (n > 0))])
    data = np.empty(off[-1], np.uint8)
    for i in np.flatnonzero(n).tolist():
        data[off[i]] = 0x20
        data[off[i] + 1 : off[i + 1]] = raw[offsets[i] : offsets[i + 1]]
    if not len(data):
        return [np.empty(0, np.int32) for _ in n]
    edges = np.flatnonzero(_cuts(v, data, off))
    places, ids, i = [], [], 0
    while i + 1 < len(edges):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + PART, side="right")) - 1)
        ws, we = edges[i:j], edges[i + 1 : j + 1]
        h = word_hashes(data[ws[0] :], ws - ws[0], we - ws[0])
        _, lead, which = np.unique(h, return_index=True, return_inverse=True)
        length = (we - ws)[lead]
        ends = np.cumsum(length)
        lat = Lattice(v, data[np.repeat(ws[lead] - (ends - length), length) + np.arange(ends[-1])], ends, best=True)
        shift, at, words = (ends - length)[which] - ws, ws, np.arange(len(ws))
        while len(at):
            e = lat.choose(at + shift[words], np.full(len(at), 0.5))
            places.append(at)
            ids.append(lat.ids[e])
            at = at + lat.length[e]
            go = at < we[words]
            words, at = words[go], at[go]
        i = j
    place, ids = np.concatenate(places), np.concatenate(ids)
    order = np.argsort(place)
    return np.split(ids[order], np.searchsorted(place[order], off[1:-1]))


def _lattice_of(v: Vocabulary, data: np.ndarray, a: int, b: int, ends: np.ndarray | None, ahead: dict, word_end: int) -> Lattice:
    """Of places a to b: whole words with these ends, or a part of the word that ends at ``word_end``."""
    if ends is not None or b == word_end:
        return Lattice(v, data[a:b], np.array([b - a]) if ends is None else ends)
    more = min(v.longest, word_end - b)
    sums = ahead[b][:more]
    sums = np.append(sums, 1.0 if more < v.longest else 0.0) if len(sums) == more else sums
    return Lattice(v, data[a : b + more], np.array([b - a + more]), sums)


def _walk_part(lat: Lattice, seed: np.ndarray, a: int, b: int, ends: np.ndarray | None, at: int, first: int | None, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and edges of a segmentation within a part, from ``at`` on."""
    chosen = np.full(b - a, -1, np.int64)
    stop = ends if ends is not None else np.array([b - a])
    begin = np.concatenate([[0], stop[:-1]])
    live = stop > at - a
    begin, stop = np.maximum(begin[live], at - a), stop[live]
    if first is not None:
        chosen[at - a] = first
        begin[0] += lat.length[first]
    go = begin < stop
    begin, stop = begin[go], stop[go]
    if ends is None and len(begin):  # a single word: step by step, with the numbers of all places drawn at once
        place, end = int(begin[0]), int(stop[0])
        u = _uniform(np.repeat(seed, b - a), np.arange(a, b), turn)
        while place < end:
            e = int(lat.first[place])
            final = e + int(lat.degree[place]) - 1
            drawn = u[place] + (lat.upto[e] - lat.p[e])
            while e < final and drawn >= lat.upto[e]:
                e += 1
            chosen[place] = e
            place += int(lat.length[e])
        begin = begin[:0]
    while len(begin):
        e = lat.choose(begin, _uniform(np.repeat(seed, len(begin)), begin + a, turn))
        chosen[begin] = e
        begin = begin + lat.length[e]
        go = begin < stop
        begin, stop = begin[go], stop[go]
    here = np.flatnonzero(chosen >= 0)
    return here + a, chosen[here]


#: The vocabulary that a worker has used, for its next task.
_LOADED: dict[str, Vocabulary] = {}
_SCHEMA = "sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, decoded_sha256 string, lossless boolean, ids array<int>"


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=pa.array([x is None for x in ids]))


def encode_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, model: str = MODEL, keep_ids: int | None = None) -> DataFrame:
    """Up to k rows for each document, numbered from 1 by their perturbed log-probability. ids is NULL from sample number ``keep_ids`` + 1 on."""
    v = Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast((v.pieces, v.logp, v.byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = Vocabulary(*shared.value)
        vocabulary = _LOADED[model]
        for b in slices(batches, 1, BATCH):
            data, off = text_bytes(b.column(1))
            raw = data.tobytes()
            keys = b.column(2).to_numpy()
            found = [sample_long(vocabulary, data, int(keys[0]), k)] if len(data) > PART else sample(vocabulary, data, off, keys, k)
            rows, at, kept = [], [], []
            spelt = iter(_spelt(vocabulary, [x[0] for samples in found for x in samples]))
            for i, samples in enumerate(found):
                want = raw[off[i] : off[i + 1]]
                for s, (ids, logp, g, q) in enumerate(samples):
                    got = next(spelt)
                    at.append(i)
                    rows.append((s + 1, len(ids), logp, g, q, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(got).hexdigest(), got == want))
                    kept.append(ids if keep_ids is None or s < keep_ids else None)
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), _lists(kept)], names=[key, *(x.split()[0] for x in _SCHEMA.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("__text"), F.xxhash64(key).alias("__seed")).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row for each document: key and ids of its likeliest segmentation, without sampling. ``decode`` gives back the text."""
    v = Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast((v.pieces, v.logp, v.byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = Vocabulary(*shared.value)
        for b in slices(batches, 1, BATCH):
            ids = best(_LOADED[model], *text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
