"""Importance resampling: against a plain version, with odd rows, several words a feature and many planes."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import importance


def features(text, runs):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i:i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute(docs, items, percent=10, least=20, runs=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, runs)[1]) for texts in ([x for _, x in docs], items))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b)))
    out = []
    for row, (i, text) in enumerate(docs):
        w, f = features(text, runs)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[:len(able) * percent // 100]
    ranks = {id(x): k for k, x in enumerate(drawn, 1)}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=str)


def run(docs, items):
    return lambda **how: sorted((tuple(r) for r in importance.resample(docs, items, **how).collect()), key=str)


@pytest.mark.parametrize("runs", [1, 3])
def test_odd_rows(spark, docs_of, edge, runs, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 1000)  # the long texts are cut into many pieces
    rows = edge + [(100 + i, f"Alpha beta {i} GAMMA-delta é{i % 3}ü " * (i + 1)) for i in range(60)]
    items = ["alpha alpha gamma", None, "", "zeta 3"]
    got = run(docs_of(rows), spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string"))(runs=runs, percent=50)
    assert got == brute(rows, items, runs=runs, percent=50)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(docs_of([(1, "a")]).limit(0), none)() == []
    assert run(docs_of([(1, "a b")]), none)() == brute([(1, "a b")], [])


def test_ties_go_to_the_smaller_id(spark, docs_of):
    rows = [(i, "same words here " * 10) for i in range(50)] + [(None, "same words here " * 10)] * 5
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert run(docs_of(rows), items)(percent=100) == brute(rows, ["same"], percent=100)


def test_whole_table(spark, sf, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert run(spark.read.parquet(f"{sf}/documents.parquet"), items)() == brute(texts, [r["text"] for r in items.collect()])


def test_planes_are_exact():
    rng = np.random.default_rng(3)
    gain = rng.integers(-9000, 9000, 100)
    times = [rng.integers(1, 1 << 40, 20) for _ in range(7)]
    where = [np.sort(rng.choice(100, 20, replace=False)) for _ in range(7)]
    planes = importance.gain_planes(gain)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([20] * 7), pa.array([20] * 7), pa.array([list(w) for w in where]), pa.array([list(t) for t in times])],
                                       ["doc_id", "n_words", "n_features", "bucket", "times"])
    got = next(importance._weigher(planes, 100)([batch])).column("weight").to_pylist()
    assert got == [int(sum(int(gain[w]) * int(t) for w, t in zip(a, b))) for a, b in zip(where, times)]
