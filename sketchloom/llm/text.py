"""Words and word hashes of whole Arrow batches at a time, in numpy.

A word's hash is the sum of its bytes' random values, each times a random number for its place in the word, put through a
mixer. Places have unrelated numbers, so that no pattern of bytes, however long, makes words equal as it does with powers
of one base. ``salt`` 1 gives a second hash from other random numbers, independent of the first: where texts are linked
or deleted both must agree. Hashes depend on the bytes alone: they are the same in every process.

``prefix_sums`` and ``piece_hash`` are polynomials, for stretches that begin anywhere: they serve hashed features and the
lookup of vocabulary pieces, which are short, and never tell whether long words are equal.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
MULTIPLIERS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: For each salt: values of bytes, and numbers of the places in a word, as a product of one for the low 16 bits and one for the rest.
VALUES = [BYTE, _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)]
PLACES = [_RNG.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * _U(2) + _U(1) for _ in VALUES]
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)

WHITE = np.ones(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, small letters and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes whose words are hashed at once.
BLOCK = 1 << 22

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``, and each text's first run (len + 1 numbers). Runs don't cross texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each word; words are in order and don't overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = int(ends[-1])
    if n > BLOCK and len(starts) > 1:  # arrays of all bytes are made for some of the words at a time
        out, a = np.empty(len(starts), np.uint64), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, side="right")))
            lo = int(starts[a])
            out[a:b] = word_hashes(data[lo:], starts[a:b] - lo, ends[a:b] - lo, salt)
            a = b
        return out
    place = np.arange(n)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    factor = PLACES[salt][place & 0xFFFF]
    if (ends - starts).max() > 1 << 16:
        high = place >> 16
        factor *= mix(np.arange(int(high.max()) + 1, dtype=np.uint64) * MULTIPLIERS[60 + salt] + MULTIPLIERS[62])[high] | _U(1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    factor *= VALUES[salt][data[:n]]
    np.cumsum(factor, dtype=np.uint64, out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * MULTIPLIERS[63])


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """From which ``piece_hash`` takes the hash of any stretch of bytes."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[data] * powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def piece_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64) * MULTIPLIERS[63])


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (len(h) - k + 1 of them), whatever texts they belong to."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (salt * 0x632BE59BD9B4E019 + k) & ((1 << 64) - 1), np.uint64)
    for j in range(k):
        out += h[j : j + n] * MULTIPLIERS[(j + salt) % 62]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted hashes end to end, a second independent hash of each, and each text's first.

    Words are runs between white space, with A-Z lower-cased. A text of fewer words has its whole sequence as one
    shingle; one without words has none.
    """
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, WHITE)
    count = np.diff(first)
    docs = np.repeat(np.arange(len(count)), count)
    short = np.flatnonzero((count > 0) & (count < k))
    values = []
    for salt in (0, 1):
        h = word_hashes(data, starts, ends, salt)
        w = windows(h, k, salt)
        if not salt:
            at = np.flatnonzero(np.arange(len(w)) + k <= first[1:][docs[: len(w)]]) if len(w) else np.empty(0, np.int64)
            doc = np.concatenate([docs[at], short])
        values.append(np.concatenate([w[at], np.array([int(windows(h[first[i] : first[i + 1]], int(count[i]), salt)[0]) for i in short], np.uint64)]))
    value, second = values
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], second[order][new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
