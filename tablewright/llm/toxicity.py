"""Toxicity by compression distance (operator 3).

Two zstandard dictionaries share a base of ordinary text; in front of it one holds the strings that set toxic rows
apart (segments of byte GRAM-grams far commoner in toxic rows, longest coverage first) and the other as many bytes of
ordinary text. A window of a text is compressed with both. Matches into the base cost the same in either, so the
difference of the two lengths is what the toxic strings save. A text's score is a logistic function of the largest, the
summed and the mean savings and the shares of windows above some thresholds, calibrated on labelled rows that the
dictionaries have not seen.

Training reads a bounded sample of the labelled rows (TOXIC_ROWS, ORDINARY_ROWS); scoring reads all of every text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import parts, small_batches, spread, staged, text_key, without

TOXIC_ROWS, ORDINARY_ROWS = 1_500, 3_000
GRAM, WINDOW, LEVEL = 5, 64, 3
BASE_BYTES, TOXIC_BYTES = 16_384, 6_144
#: Bytes of text scored at a time.
PART_BYTES = 4 << 20
#: Least log ratio of a gram's document rates, and least number of toxic rows with it.
RATIO, ROWS = 3.0, 4


def held_out(doc_id) -> "F.Column":
    """Rows that never take part in training: crc32 of the id as text divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def windows(b: bytes) -> list[bytes]:
    step = WINDOW // 2
    return [b[i:i + WINDOW] for i in range(0, max(1, len(b) - step), step)]


class Model:
    """The two dictionaries and the calibration; small, and sent to the tasks as bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes, mean=None, scale=None, weights=None):
        self.toxic, self.ordinary = toxic, ordinary
        self.mean, self.scale, self.weights = mean, scale, weights
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def savings(self, text: str | None) -> np.ndarray:
        if self._pair is None:
            self._pair = []
            for content in (self.ordinary, self.toxic):
                d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._pair.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        plain, toxic = self._pair
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(_bytes(text))], float)

    def features(self, text: str | None) -> list[float]:
        s = self.savings(text)
        top = np.sort(s)[::-1]
        return [top[0], top[:2].sum(), top[:4].sum(), 10 * s.mean(), *[float((s >= k).sum()) ** 0.5 for k in (2, 4, 6)], *[float((s >= k).mean()) ** 0.5 for k in (2, 4)], float(np.log(len(s)))]

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        z = ((x - self.mean) / self.scale * self.weights[:-1]).sum(1) + self.weights[-1] if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grams(b: bytes) -> set[bytes]:
    return {b[i:i + GRAM] for i in range(len(b) - GRAM + 1)}


def _segments(b: bytes, good: set[bytes]) -> set[bytes]:
    out, lo, hi = set(), None, 0
    for i in range(len(b) - GRAM + 1):
        if b[i:i + GRAM] in good:
            if lo is None or i > hi:
                if lo is not None:
                    out.add(b[lo:hi])
                lo = i
            hi = i + GRAM
    if lo is not None:
        out.add(b[lo:hi])
    return out


def learn(toxic: list[str], ordinary: list[str], seed: int = 1) -> Model:
    """Dictionaries from two thirds of the rows, calibration on the rest."""
    rng = np.random.default_rng(seed)
    a, b = -(-len(toxic) * 2 // 3), -(-len(ordinary) * 2 // 3)
    bad, fine = [_bytes(t) for t in toxic[:a]], [_bytes(t) for t in ordinary[:b]]
    in_bad, in_fine = Counter(), Counter()
    for x in bad:
        in_bad.update(_grams(x))
    common = {g for g, c in in_bad.items() if c >= min(ROWS, max(1, len(bad) // 4))}
    for x in fine:
        in_fine.update(_grams(x) & common)
    rate = lambda g: np.log((in_bad[g] + 0.5) / (len(bad) + 1)) - np.log((in_fine[g] + 0.5) / (len(fine) + 1))
    good = {g for g in common if rate(g) > RATIO}
    segments = Counter()
    for x in bad:
        segments.update(_segments(x, good))
    # Commonest segments first, each only for the grams that no earlier one brought.
    covered, chosen, size = set(), [], 0
    for s, _ in sorted(segments.items(), key=lambda p: (-p[1], p[0])):
        new = _grams(s) - covered
        if new and size + len(s) + 1 <= TOXIC_BYTES:
            covered |= new
            chosen.append(s)
            size += len(s) + 1
    strings = b"\n".join(reversed(chosen))  # the commonest lie nearest to the text
    plain = [w for x in fine for w in windows(x)] or [b""]
    plain = [plain[i] for i in rng.permutation(len(plain))[:(BASE_BYTES + TOXIC_BYTES) // WINDOW + 1]]
    plain = b"".join(plain).ljust(64, b" ")
    control, base = plain[:len(strings)], plain[len(strings):][:BASE_BYTES].ljust(64, b" ")
    model = Model(strings + base, control + base)
    # A few rows only: calibrate on all, since there is nothing to spare.
    few = len(toxic) - a < 20
    rows = [(t, 1) for t in (toxic if few else toxic[a:])] + [(t, 0) for t in (ordinary if few else ordinary[b:])]
    x = np.array([model.features(t) for t, _ in rows]) if rows else np.zeros((1, len(model.features(""))))
    y = np.array([k for _, k in rows], float) if rows else np.zeros(1)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 0.3)
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Train on at most `toxic_rows` and `ordinary_rows` labelled rows outside the held-out fold, chosen by hash of the id.

    Rows with a null id or label are not used. The sample is bounded by these parameters, so it is read to the driver.
    """
    able = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias("_id"), "toxic").distinct()
    parts = []
    for kind, n in ((1, toxic_rows), (0, ordinary_rows)):
        ids = able.filter(F.col("toxic") == kind).join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "leftsemi").orderBy(F.xxhash64("_id"), "_id").limit(n)
        rows = docs.join(F.broadcast(ids), docs["doc_id"] == F.col("_id")).select("doc_id", "text")
        parts.append([r["text"] for r in sorted(rows.collect(), key=lambda r: (hash((r["doc_id"], 11)), r["doc_id"]))])
    return learn(*parts)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """The score of every text, and the other columns. To be run under `small_batches`, as other batches hold 10,000 texts."""
    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)

    def task(batches):
        for b in (p for batch in batches for p in parts(batch, "text", PART_BYTES)):
            s = model.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array(s, pa.float64())], [*others, "score"])

    return spread(rows).mapInArrow(task, f"{kinds}, score double")


def clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents whose score is below `limit`, with all their columns; defined on all texts as `score` is.

    A score depends on the text alone, so tasks return the keys of the texts that go, and no text comes back from them.
    """
    d = docs.withColumn("_key", text_key())
    with small_batches(docs.sparkSession):
        left = without(d, scored(d.select("_key", "text"), model).filter(F.col("score") >= limit).select("_key"), "_key")
    return left.drop("_key")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score in 0..1, predicted (1 if score >= 0.5).

    Null and empty texts are scored as an empty window. Null ids are not held out. Repeated rows get equal scores; long
    texts are scored over all their windows; other columns are not read; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        rows = staged(scored(docs.select("doc_id", "text"), model), "scores")
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
