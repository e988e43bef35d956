"""Task-side work of suffix_dedup: anchors, front-coded sorted runs, their merge, and what matches.

All matches have LENGTH bytes. Each stretch of that length (a window) has one anchor: of the GRAM-byte strings in it
the one with the least hash, the first of equals. Equal windows have equal anchors at equal places, so only suffixes
that start at anchors need to be sorted: some 2 of 27 positions. An occurrence is an anchor with the windows it serves:
`right`, the bytes from the anchor to the end of the last of them (GRAM to LENGTH bytes), and `left`, those before it
from the start of the first (none to LENGTH - GRAM bytes).
"""

from __future__ import annotations

import numpy as np
import zstandard as zstd

from tablewright.llm.hashing import VALUE, mixed, powers, prefix

LENGTH, GRAM = 50, 25
SPAN = LENGTH - GRAM + 1
#: Windows looked at together.
SLICE = 1 << 19


def anchors(buf: np.ndarray, sizes: np.ndarray):
    """Occurrences of documents that lie one after the other: anchor, first and last window, hash, document."""
    out = []
    doc_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for at in range(0, max(0, len(buf) - LENGTH + 1), SLICE):
        part = buf[at:at + SLICE + LENGTH - 1]
        total = prefix(part)
        g = mixed((total[GRAM:] - total[:-GRAM]) * powers(len(total))[1][:len(total) - GRAM])
        least, place = g, np.arange(len(g), dtype=np.int32)
        for step in (1, 2, 4, 8, SPAN - 16):
            n = len(least) - step
            first = least[:n] <= least[step:]
            place = np.where(first, place[:n], place[step:])
            least = np.minimum(least[:n], least[step:])
        doc = doc_of[at:at + len(part)]
        s = np.flatnonzero(doc[:len(least)] == doc[LENGTH - 1:])
        if len(s):
            p = place[s]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
            i = np.flatnonzero(new)
            p = p[i]
            # Anchors have small hashes, so their bits are spread once more.
            out.append((p + at, s[i] + at, np.append(s[i[1:] - 1], s[-1]) + at, mixed(g[p]), doc[p]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Even share of the hash range, by its high 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split(values: np.ndarray, buckets: int):
    """Sorted hashes by bucket: (bucket, from, to)."""
    b = bucket_of(values, buckets)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else []
    return [(int(b[x]), int(x), int(y)) for x, y in zip(edge, edge[1:])]


def short(values: np.ndarray) -> np.ndarray:
    """32 bits of hashes of one bucket: enough to tell which may be met elsewhere."""
    return (mixed(values.copy()) >> np.uint64(32)).astype("<u4")


def in_chunk(h: np.ndarray, ids: np.ndarray):
    """Distinct hashes in order, the occurrences' places among them, and which are met in two documents."""
    distinct, of = np.unique(h, return_inverse=True)
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    return distinct, of, low < high


def matrix(buf: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` bytes from `start`, zero from `size` on."""
    at = start[:, None] + np.arange(width)
    m = buf[np.minimum(at, len(buf) - 1)]
    m[np.arange(width)[None, :] >= size[:, None]] = 0
    return m


def words64(m: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian 64-bit numbers that sort like the rows."""
    pad = -m.shape[1] % 8
    m = np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad))))
    return list(m.view(">u8").astype(np.uint64).T)


def entries(buf: np.ndarray, p, lo, hi, ids):
    """Sort occurrences by right side, then left side; equal ones are one entry with the smallest document.

    Returns the entries (right, right sizes, left, left sizes, smallest id) and the entry of each occurrence. Left sides
    are written backwards, away from the anchor.
    """
    r_size, l_size = hi + LENGTH - p, p - lo
    right = matrix(buf, p, r_size, LENGTH)
    at = p[:, None] - 1 - np.arange(SPAN - 1)
    left = buf[np.maximum(at, 0)]
    left[np.arange(SPAN - 1)[None, :] >= l_size[:, None]] = 0
    keys = [*words64(right), r_size, *words64(left), l_size]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(p), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    of = np.empty(len(p), np.int64)
    of[order] = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
    rows = order[first]
    return right[rows], r_size[rows], left[rows], l_size[rows], smallest, of


def common(right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before it."""
    out = np.zeros(len(right), np.uint8)
    if len(right) > 1:
        differ = right[1:] != right[:-1]
        n = np.where(differ.any(1), differ.argmax(1), right.shape[1])
        out[1:] = np.minimum(n, np.minimum(size[1:], size[:-1]))
    return out


def pack(right, r_size, left, l_size, ids) -> bytes:
    """A sorted run, front coded: common prefixes, then only what follows them."""
    lcp = common(right, r_size)
    cols = np.arange(LENGTH)[None, :]
    tails = right[(cols >= lcp[:, None]) & (cols < r_size[:, None])]
    heads = left[np.arange(SPAN - 1)[None, :] < l_size[:, None]]
    raw = np.int64(len(ids)).tobytes() + lcp.tobytes() + r_size.astype(np.uint8).tobytes() + l_size.astype(np.uint8).tobytes() + ids.astype("<i8").tobytes() + tails.tobytes() + heads.tobytes()
    return zstd.ZstdCompressor(level=1).compress(raw)


class Run:
    """A run as received: right sides as strings, common prefixes with the one before, left sides, ids."""

    def __init__(self, data: bytes):
        raw = zstd.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.lcp, self.r_size, self.l_size = (np.frombuffer(raw, np.uint8, n, 8 + k * n) for k in range(3))
        self.ids = np.frombuffer(raw, "<i8", n, 8 + 3 * n)
        at = 8 + 11 * n
        ends = at + np.cumsum(self.r_size.astype(np.int64) - self.lcp)
        strings, last = [], b""
        for k, e in zip(self.lcp.tolist(), ends.tolist()):
            last = last[:k] + raw[at:e]
            strings.append(last)
            at = e
        self.strings = strings
        heads = np.frombuffer(raw, np.uint8, -1, at)
        self.left = np.zeros((n, SPAN - 1), np.uint8)
        self.left[np.arange(SPAN - 1)[None, :] < self.l_size[:, None]] = heads


def merge(runs: list[Run]) -> tuple[list[int], list[int]]:
    """Loser tree over sorted runs: the run of each string in order, and its common prefix with the string before.

    Each loser keeps its common prefix with the winner that beat it. Two strings whose prefixes with the last winner
    differ are in order without a look at them; only strings with equal ones are compared, from that place on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r.strings for r in runs] + [[]] * (k - len(runs))
    prefixes = [r.lcp.tolist() for r in runs] + [[]] * (k - len(runs))
    sizes, at = [len(s) for s in strings], [0] * k
    loser, loser_lcp = [0] * k, [0] * k

    def duel(a: int, ha: int, b: int, hb: int):
        """Winner, its prefix, loser, its prefix. A prefix of -1 stands for a run at its end."""
        if ha > hb:
            return a, ha, b, hb
        if ha < hb:
            return b, hb, a, ha
        if ha < 0:
            return a, ha, b, hb
        s, t = strings[a][at[a]], strings[b][at[b]]
        if s == t:
            return (a, ha, b, len(s)) if a < b else (b, hb, a, len(s))
        n, h = min(len(s), len(t)), ha
        while h < n and s[h] == t[h]:
            h += 1
        if h == n and len(s) < len(t) or h < n and s[h] < t[h]:
            return a, ha, b, h
        return b, hb, a, h

    level = [(i, 0 if sizes[i] else -1) for i in range(k)]
    node = k
    while len(level) > 1:
        up = []
        node //= 2
        for j in range(0, len(level), 2):
            w, hw, x, hx = duel(*level[j], *level[j + 1])
            loser[node + j // 2], loser_lcp[node + j // 2] = x, hx
            up.append((w, hw))
        level = up
    winner, h = level[0]
    out_run, out_lcp = [], []
    put_run, put_lcp = out_run.append, out_lcp.append
    while h >= 0:
        put_run(winner)
        put_lcp(h)
        i = at[winner] = at[winner] + 1
        h = prefixes[winner][i] if i < sizes[winner] else -1
        node = (winner + k) >> 1
        while node:
            other = loser_lcp[node]
            if h < other:
                winner, loser[node] = loser[node], winner
                h, loser_lcp[node] = other, h
            elif h == other and h >= 0:
                winner, h, loser[node], loser_lcp[node] = duel(winner, h, loser[node], other)
            node >>= 1
    return out_run, out_lcp


def matches(runs: list[Run]) -> list[np.ndarray]:
    """For each run, per entry, bit o set if the window that starts o bytes before the anchor also starts in a smaller document."""
    which, lcp = merge(runs)
    which, lcp = np.array(which, np.int64), np.array(lcp, np.int64)
    first = np.cumsum([0] + [len(r.ids) for r in runs])[:-1]
    order = np.argsort(which, kind="stable")  # places in the merged order, run by run
    take = np.empty(len(which), np.int64)
    take[order] = np.arange(len(which))  # the entry (runs one after the other) at each merged place
    gather = lambda f: np.concatenate([f(r) for r in runs])[take]
    ids, r_size, l_size, left = gather(lambda r: r.ids), gather(lambda r: r.r_size), gather(lambda r: r.l_size), gather(lambda r: r.left)
    mask = np.zeros(len(which), np.uint32)
    head = np.zeros(len(which), np.uint64)
    power = powers(LENGTH)[0]
    for o in range(SPAN):
        if o:
            head = head + VALUE[left[:, o - 1]] * power[o]
        group = np.cumsum(lcp < LENGTH - o)
        v = np.flatnonzero((l_size >= o) & (r_size >= LENGTH - o))
        if not len(v):
            continue
        # Windows of a right group are equal if their left sides of o bytes are.
        key = mixed(group[v].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + head[v])
        sort = np.argsort(key)
        edge = np.flatnonzero(np.concatenate([[True], np.diff(key[sort]) != 0]))
        least = np.minimum.reduceat(ids[v][sort], edge)
        least = np.repeat(least, np.diff(np.append(edge, len(v))))
        hit = v[sort][ids[v][sort] > least]
        mask[hit] |= np.uint32(1 << o)
    out = np.empty(len(which), np.uint32)
    out[take] = mask
    return [out[a:a + len(r.ids)] for a, r in zip(first, runs)]
