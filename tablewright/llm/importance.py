"""Importance resampling toward a target distribution, with bit-sliced weights.

Features are runs of 1 to `runs` words; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. A bucket's gain is
the logarithm of how much likelier it is in the target than in the corpus, as a whole number of thousandths. A document's
bucket counts become bit planes: bit b of plane j is bit j of the count of bucket b. The gains become planes too, those of
positive and of negative gains apart. AND of two planes, its population count times a power of two, summed over all pairs
of planes, is the exact weight, in whole numbers only.

Documents are counted once (staged as sparse counts); bucket totals are pre-aggregated in each task to at most one row a
bucket. Gumbel noise from a hash of doc_id makes the highest scores a draw in proportion to the weights, without
replacement; ranks come from one range sort.

Defined cases: a null text has no words; a document without features has weight 0 and score from its noise alone; a null
doc_id is hashed as an empty string and comes last among equal scores; rows equal in score and doc_id are ranked by
their place in the counted table; an empty corpus or target only leaves the smoothing of one a bucket; texts of any length
are split into words a piece at a time. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import parts, spread, staged

BUCKETS = 10_000
#: Bytes of a long text that are words at a time, and of a batch that are counted at a time.
PIECE = 1 << 20
#: Documents whose planes are compared with the gains at a time.
ROWS = 256
SALT = "2024"


def _table() -> bytes:
    """A-Z become lower case; digits, letters and all bytes of other characters stay; the rest parts words."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counter(runs: int, buckets: int):
    """Task function: (doc_id, text as bytes) to (doc_id, n_words, n_features, bucket, times)."""
    table, crc, piece = _table(), zlib.crc32, PIECE

    def ids(text: bytes) -> tuple[int, np.ndarray]:
        """Number of words and the bucket of every feature."""
        text, at, before, n, out = text.translate(table), 0, [], 0, []
        while at < len(text):
            end = text.find(b" ", at + piece)
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            at, n = end, n + len(words)
            hashes = [crc(w) for w in words]
            both = before + words
            for k in range(2, runs + 1):  # runs that end among the new words
                hashes += [crc(b" ".join(both[i - k:i])) for i in range(max(k, len(before) + 1), len(both) + 1)]
            before = both[len(both) - runs + 1:] if runs > 1 else []
            out.append(np.array(hashes, np.int64) % buckets)
        return n, np.concatenate(out) if out else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text", piece):
                found = [ids(t or b"") for t in part.column("text").to_pylist()]
                sizes = [len(f) for _, f in found]
                keys, times = np.unique(np.repeat(np.arange(len(found)), sizes) * buckets + np.concatenate([f for _, f in found]), return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(found) + 1) * buckets).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((keys % buckets).astype(np.int32), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array(sizes, pa.int64()), *lists],
                                                 ["doc_id", "n_words", "n_features", "bucket", "times"])
    return run


def counts(docs: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Sparse bucket counts of every document: doc_id, n_words, n_features, bucket and times (arrays)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return spread(d).mapInArrow(_counter(runs, buckets), f"doc_id {kind}, n_words long, n_features long, bucket array<int>, times array<int>")


def totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all documents; the driver gets one number a bucket."""
    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            where, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "times"))
            np.add.at(sums, where, times)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(sums[held])], ["b", "n"])

    out = np.zeros(buckets, np.int64)
    for b, n in counted.select("bucket", "times").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus, both with one more a bucket."""
    n, s, t = len(corpus), float(corpus.sum()) + len(corpus), float(target.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * s / ((float(corpus[b]) + 1) * t))) for b in range(n)], np.int64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane as 64-bit words) for every bit that some gain has."""
    words, out = -(-len(gain) // 64), []
    for sign, size in ((1, np.maximum(gain, 0)), (-1, np.maximum(-gain, 0))):
        for k in range(int(size.max(initial=0)).bit_length()):
            bits = np.zeros(words * 64, np.uint8)
            bits[:len(gain)] = size >> k & 1
            out.append((sign << k, np.packbits(bits, bitorder="little").view(np.uint64)))
    return out


def _weigher(planes: list[tuple[int, np.ndarray]], buckets: int):
    """Task function: adds the weight, from the planes of the counts and those of the gains."""
    width, rows = -(-buckets // 64), ROWS

    def weights(ends: np.ndarray, where: np.ndarray, times: np.ndarray) -> np.ndarray:
        n = len(ends) - 1
        out, left = np.zeros(n, np.int64), times.astype(np.int64)
        at = np.repeat(np.arange(n), np.diff(ends)) * width + (where >> 6)
        bit = np.uint64(1) << (where & 63).astype(np.uint64)
        j = 0
        while (some := left > 0).any():
            one = some & (left & 1 == 1)
            if one.any():
                cells, first = np.unique(at[one], return_index=True)  # a document's buckets ascend, so equal cells are neighbours
                docs, home = np.unique(cells // width, return_inverse=True)
                plane = np.zeros((len(docs), width), np.uint64)
                plane[home, cells % width] = np.bitwise_or.reduceat(bit[one], first)
                for power, gain in planes:
                    out[docs] += (power << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
            left >>= 1
            j += 1
        return out

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                lists = [part.column(c) for c in ("bucket", "times")]
                sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                w = weights(ends, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(w)],
                                                 ["doc_id", "n_words", "n_features", "weight"])
    return run


def weigh(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of the gains of all features."""
    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(_weigher(gain_planes(gain), len(gain)), f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its weight, noisy score and, where drawn, rank.

    Of the N documents with at least `least` words the floor(percent * N / 100) highest scores are drawn.
    Returns doc_id, n_features, weight, score, rank (null: not drawn).
    """
    counted = staged(counts(docs, runs, buckets), "counts")
    gain = gains(totals(counted, buckets), totals(counts(target.select(F.lit(0).alias("doc_id"), "text"), runs, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    able = F.col("n_words") >= least
    scored = staged(weigh(counted, gain).withColumn("score", F.col("weight") + noise).withColumn("able", able).withColumn("row", F.monotonically_increasing_id()), "scores")
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    place = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")]
    lined = staged(scored.repartitionByRange(*order).sortWithinPartitions(*order).select("*", *place), "ranks")
    before, start = [], 0
    for part, n in sorted(map(tuple, lined.groupBy("part").count().collect())):  # one row a partition
        before.append((part, start))
        start += n
    offsets = docs.sparkSession.createDataFrame(before, "part int, before long")
    drawn = scored.filter("able").count() * percent // 100
    rank = F.col("before") + F.col("at") + 1
    return lined.join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
