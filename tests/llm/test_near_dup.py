"""Operator 4 against brute force."""

import random
import time

import numpy as np
import pytest

from tablewright.llm import near_dup
from tablewright.llm.components import components, extended
from tablewright.llm.hashing import shingle_sets


def brute(rows, width, percent):
    """Component of each row and set sizes, by an inverted index over the exact shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where, first = {}, {}
    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for i in order:
        if not sets[i]:
            continue
        if sets[i] in first:
            parent[find(i)] = find(first[sets[i]])
            continue
        first[sets[i]] = i
        n = {}
        for s in sets[i]:
            for j in where.get(s, ()):
                n[j] = n.get(j, 0) + 1
            where.setdefault(s, []).append(i)
        for j, c in n.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def same(spark, docs, rows, width, percent, **more):
    got = near_dup.near_duplicates(docs, width=width, percent=percent, **more).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_sets_and_signatures():
    a, b, c, d = shingle_sets(["A b c\td", None, "x Y", "c d"], 3)
    assert len(a) == 2 and len(b) == 0 and len(c) == len(d) == 1 and c != d
    assert set(a) <= set(shingle_sets(["zz a b C d"], 3)[0])
    rng = np.random.default_rng(0)
    mult = near_dup.multipliers(near_dup.VALUES)
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        for _ in range(30):
            n = 400
            common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            x, y = (np.concatenate([common, rng.integers(0, 1 << 63, (n - len(common)) // 2, dtype=np.uint64)]) for _ in range(2))
            j = len(common) / (len(x) + len(y) - len(common))
            equal = (np.frombuffer(near_dup.signature(x, mult), "<u2") == np.frombuffer(near_dup.signature(y, mult), "<u2")).mean()
            errors.append((equal - j) / np.sqrt(j * (1 - j) / near_dup.VALUES))
    assert abs(np.mean(errors)) < 0.4 and np.std(errors) < 1.3
    assert (near_dup.band_rows(85), near_dup.band_rows(80)) == (6, 5)


def test_op4_against_brute_force(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(spark, docs, texts, 3, 85)


def test_op4_groups_blocks_and_edges(spark, docs_of, edge):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [*edge, (8, "One TWO three four"), (9, "one two"), (10, "two one")]
    i = 100
    passage = rng.choices(vocabulary, k=30)
    for size, rate in ((60, 0.02), (60, 0.035), (25, 0.01)):  # near copies, many close to the threshold
        base = rng.choices(vocabulary, k=120)
        for _ in range(size):
            rows.append((i, " ".join(w if rng.random() > rate else rng.choice(vocabulary) for w in base)))
            i += 1
    for _ in range(80):  # a common passage
        rows.append((i, " ".join(passage + rng.choices(vocabulary, k=12))))
        i += 1
    rows += [(i + k, rows[-1][1]) for k in range(5)]
    for block in (1_000, 7):
        same(spark, docs_of(rows), rows, 3, 85, block=block)
    same(spark, docs_of(rows), rows, 5, 80)
    assert near_dup.near_duplicates(docs_of([])).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_regular_words_are_told_apart(n):
    word = thue_morse(n)
    a, b = shingle_sets([word, word.translate(str.maketrans("ab", "ba"))], 3)
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_regular_words_are_not_linked(spark, docs_of):
    word = thue_morse(1024)
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    same(spark, docs_of(rows), rows, 3, 85)


def test_components_by_stars_and_in_one_task(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    few, many = (sorted(map(tuple, components(df, few=n).select("node", "label").collect())) for n in (10 ** 6, 0))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert few == many == sorted((x, find(x)) for x in parent)
    half = components(df.limit(0))
    assert half.count() == 0
    start = spark.createDataFrame(few, "node long, label long")
    more = [(few[0][0], 1000), (7000, 7001), (7001, few[5][0])]
    got = {r["node"]: r["label"] for r in extended(start, spark.createDataFrame(more, "a long, b long")).collect()}
    want = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges + more, "a long, b long")).collect()}
    assert got == want


def test_many_null_ids(spark, docs_of):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=100)
    texts = [" ".join(w if rng.random() > 0.01 else rng.choice(words) for w in base) for _ in range(400)]

    def took(rows):
        start = time.time()
        near_dup.near_duplicates(docs_of(rows), width=3, percent=85).collect()
        return time.time() - start

    own, none = [(i, t) for i, t in enumerate(texts)], [(None, t) for t in texts]
    took(own)
    assert took(none) < 2 * took(own) + 5
    same(spark, docs_of(none), none, 3, 85)


def test_op4_lists_no_pairs_of_a_group_below_the_threshold(spark, docs_of, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=300)
    rows = [(i, " ".join(w if rng.random() > 0.013 else rng.choice(vocabulary) for w in base)) for i in range(150)]
    listed, plain = [], near_dup.confirmed

    def confirmed(pairs, *more):
        listed.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(near_dup, "confirmed", confirmed)
    same(spark, docs_of(rows), rows, 3, 95)
    assert max(listed) <= len(rows)  # a pair a node at most
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 20_000)  # some eight sets
    same(spark, docs_of(rows), rows, 3, 95)
    assert max(listed) <= len(rows)
