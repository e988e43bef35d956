"""Operator 9 against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from tablewright.llm import suffix_dedup, suffix_runs


def brute(rows):
    least = {}
    big = 1 << 62
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k:k + 50]
            i_ = big if i is None else i
            if least.get(s, big) >= i_:
                least[s] = i_
    out = []
    for i, t in rows:
        b = (t or "").encode()
        c = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k:k + 50]] < (big if i is None else i):
                c[k:k + 50] = True
        kept = bytes(x for x, y in zip(b, c) if not y)
        out.append((i, len(b), int(c.sum()), int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_op9_against_brute_force(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute(texts)
    assert result(suffix_dedup.deduplicate(docs)) == want
    assert sum(r[2] for r in want) > 10_000


def test_op9_many_chunks_hard_overlaps_and_edges(spark, docs_of, edge):
    rng = random.Random(5)
    pool = "".join(rng.choices("abé 😀\0\n", k=4000))
    rows = [e for e in edge if e[0] not in (5, 6)] + [(5, "ab " * 700), (6, "ab " * 500 + "x"), (None, pool[100:300]), (None, pool[100:300]), (7, "z" * 49), (8, "z" * 49), (9, "z" * 50), (10, "z" * 51), (11, "z" * 120), (11, "z" * 120)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(3900)
            parts.append(pool[a:a + rng.choice((20, 48, 49, 50, 51, 70, 200))] if rng.random() < 0.7 else "".join(rng.choices("abc", k=rng.randint(1, 60))))
        rows.append((rng.randrange(100, 150), "".join(parts)))
    df = docs_of(rows)
    want = brute(rows)
    assert result(suffix_dedup.deduplicate(df)) == want
    assert result(suffix_dedup.deduplicate(df, chunk=400, hashes=50, per_bucket=20)) == want
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0
    kept = suffix_dedup.deduplicate(df, texts=True).filter("doc_id = 9").first()
    assert bytes(kept["kept"]) == b"z" * 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=25, max_size=50), max_size=30), min_size=1, max_size=9))
def test_loser_tree_merges_with_common_prefixes(lists):
    made = []
    for strings in lists:
        strings = sorted(s.replace(b"\x02", b"\x01") for s in strings)
        r_size = np.array([len(s) for s in strings], np.int64)
        right = np.array([list(s.ljust(50, b"\0")) for s in strings], np.uint8).reshape(-1, 50)
        left = np.zeros((len(strings), 25), np.uint8)
        made.append(suffix_runs.Run(suffix_runs.pack(right, r_size, left, np.zeros(len(strings), np.int64), np.arange(len(strings)))))
        assert made[-1].strings == strings
    which, lcp = suffix_runs.merge(made)
    at = [0] * len(made)
    merged = []
    for w in which:
        merged.append(made[w].strings[at[w]])
        at[w] += 1
    assert merged == sorted(s for m in made for s in m.strings)
    for i in range(1, len(merged)):
        a, b = merged[i - 1], merged[i]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[i] == n
