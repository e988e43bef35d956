"""64-bit hashes of stretches of bytes by array operations, equal on every machine.

The sums are polynomials modulo 2 ** 64: fast, but long regular words of two letters can be built that collide under any
base. So stretches above LONG bytes are to be hashed by BLAKE2b instead, as `shingle_sets` does.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 64

_RNG = np.random.default_rng(5)
#: A random odd value for each byte, and the base of the polynomial with its inverse modulo 2 ** 64.
VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        m = n + n // 4
        for k, x in enumerate((BASE, INVERSE)):
            p = np.full(m, x, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(30)
    h *= MIX1
    h ^= h >> np.uint64(27)
    h *= MIX2
    h ^= h >> np.uint64(31)
    return h


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running sums of byte value times power, one longer than the bytes."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(VALUE[buf] * powers(len(buf) + 1)[0][:len(buf)], dtype=np.uint64, out=total[1:])
    return total


def stretches(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:stop], wherever they lie."""
    h = (total[stop] - total[start]) * powers(len(total))[1][start]
    return mixed(h + (stop - start).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that begin anywhere and end in white space."""
    edge = np.diff(np.concatenate([[True], SPACE[buf], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, A-Z in lower case.

    A text of fewer words is one shingle; without words the set is empty.
    """
    raw = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A-Z only
    size = np.array([len(r) + 1 for r in raw], np.int64)
    last = np.cumsum(size)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    start, stop = word_spans(buf)
    word = stretches(prefix(buf), start, stop)
    for i in np.flatnonzero(stop - start > LONG).tolist():
        word[i] = int.from_bytes(hashlib.blake2b(buf[start[i]:stop[i]], digest_size=8).digest(), "little")
    a = np.searchsorted(start, last - size)  # words of text i are a[i]:b[i]
    b = np.searchsorted(start, last)
    n = len(word)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += word[k:k + len(full)] * np.uint64((BASE * (2 * k + 3)) % (1 << 64) | 1)
    full = mixed(full)
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        if y - x >= width:
            out.append(np.unique(full[x:y - width + 1]))
        elif y > x:
            h = y - x
            for w in word[x:y].tolist():
                h = (h * BASE ^ w) % (1 << 64)
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
