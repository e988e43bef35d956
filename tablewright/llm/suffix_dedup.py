"""Exact removal of repeated bytes by a distributed suffix sort (operator 9).

Documents are written as chunks. In each chunk the suffixes at anchors (see suffix_runs) that may match another document
are sorted into runs, one per bucket of the hash range; equal suffixes are one entry from the start, so a group of
copies sends one entry per chunk. Runs travel front coded and compressed, are merged by loser trees that never compare
a known prefix again, and the merged order with its common prefixes gives the equal windows. The answers go back to
the chunks as bit masks. Texts are not shuffled; the first exchange of 32-bit hashes finds the anchors that are met
in more than one chunk, and only these are sorted.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from tablewright.llm import suffix_runs as runs
from tablewright.llm.common import new_folder, spread, staged

#: Bytes of text in a chunk, anchors in a bucket of the first exchange, entries in a bucket of the second.
CHUNK, HASHES, ENTRIES = 4 << 20, 1_000_000, 150_000


def _files(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, name: str, batch: pa.RecordBatch) -> None:
    system, root = _files(folder)
    with system.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_batch(batch)


def _read(folder: str, name: str) -> pa.RecordBatch:
    system, root = _files(folder)
    with system.open_input_file(f"{root}/{name}") as source:
        return pa.ipc.open_file(source).get_batch(0)


def _chunk(folder: str, name: str):
    """Bytes of the documents of a chunk one after the other, their sizes, and ids for comparison (null last)."""
    b = _read(folder, name)
    texts = b.column("text")
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8))
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8, int(sizes.sum())) if data is not None and sizes.sum() else np.zeros(0, np.uint8)
    ids = b.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
    return b, buf, sizes, ids


def chunks(docs: DataFrame, folder: str, size: int = CHUNK) -> DataFrame:
    """Write the documents as chunk files; one row per chunk: file, n_bytes. A task names its files anew, so a lost one leaves unread files only."""

    def task(batches):
        rows, total = [], 0

        def put():
            nonlocal rows, total
            name = f"chunk-{uuid.uuid4().hex}"
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_binary())], ["id", "text"])
            _write(folder, name, batch)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64())], ["file", "n_bytes"])
            rows, total = [], 0
            return out

        system, root = _files(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = (t or "").encode()
                rows.append((i, data))
                total += len(data)
                if total >= size or len(rows) >= size >> 6:
                    yield put()
        if rows:
            yield put()

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return staged(rows.mapInArrow(task, "file string, n_bytes bigint"), "chunks")


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionByRange(max(1, n), "file")


def shared(manifest: DataFrame, folder: str, n: int, buckets: int) -> DataFrame:
    """(file, bucket, bits): which of a chunk's distinct anchor hashes, in order, are met in another chunk."""

    def send(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                _, buf, sizes, ids = _chunk(folder, name)
                h = np.unique(runs.anchors(buf, sizes)[3])
                parts = runs.split(h, buckets)
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array([p[0] for p in parts], pa.int32()), pa.array([runs.short(h[x:y]).tobytes() for _, x, y in parts], pa.binary())], ["file", "bucket", "data"])

    def meet(key, batch_rows):
        files, data = zip(*batch_rows)
        values = [np.frombuffer(d, "<u4") for d in data]
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        everything = np.concatenate(values)
        order = np.argsort(everything, kind="stable")
        v, o = everything[order], owner[order]
        edge = np.concatenate([[True], v[1:] != v[:-1]])
        first = np.flatnonzero(edge)
        several = np.minimum.reduceat(o, first) < np.maximum.reduceat(o, first)
        bits = np.empty(len(v), bool)
        bits[order] = several[np.cumsum(edge) - 1]
        at = 0
        for f, x in zip(files, values):
            yield f, key, int(bits[at:at + len(x)].sum()), zstd.compress(np.packbits(bits[at:at + len(x)]).tobytes(), 1)
            at += len(x)

    sent = _dealt(manifest, n).select("file").mapInArrow(send, "file string, bucket int, data binary")
    return staged(_by_bucket(sent, buckets, meet, "file string, bucket int, n bigint, bits binary"), "shared")


def _by_bucket(sent: DataFrame, buckets: int, fn, schema: str) -> DataFrame:
    """Hand each bucket's (file, data) rows to `fn`, one bucket at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def task(batches):
        key, rows = None, []

        def done():
            out = list(fn(key, rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for b in batches:
            for f, k, d in zip(b.column("file").to_pylist(), b.column("bucket").to_pylist(), b.column("data").to_pylist()):
                if rows and k != key:
                    yield done()
                    rows = []
                key = k
                rows.append((f, d))
        if rows:
            yield done()

    # Dealt by hash, not by range: a range would first run the senders for a sample.
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "file").mapInArrow(task, schema)


def _per_chunk(manifest: DataFrame, answers: DataFrame, column: str, n: int) -> DataFrame:
    """Each chunk with its answers: a small value per bucket, so one row a chunk."""
    own = answers.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("bucket", column))).alias("answers"))
    return _dealt(manifest.join(own, "file", "left").select("file", "answers"), n)


def sorted_runs(manifest: DataFrame, bits: DataFrame, folder: str, n: int, buckets: int, first_buckets: int) -> DataFrame:
    """(file, bucket, data): front-coded runs of the suffixes that may match. Where the entries lie is kept beside the chunk."""

    def task(batches):
        for b in batches:
            for name, answers in zip(b.column("file").to_pylist(), b.column("answers").to_pylist()):
                _, buf, sizes, ids = _chunk(folder, name)
                p, lo, hi, h, doc = runs.anchors(buf, sizes)
                distinct, of, several = runs.in_chunk(h, ids[doc])
                given = {a["bucket"]: a["bits"] for a in answers or ()}
                for k, x, y in runs.split(distinct, first_buckets):
                    several[x:y] |= np.unpackbits(np.frombuffer(zstd.decompress(given[k]), np.uint8), count=y - x).astype(bool)
                take = np.flatnonzero(several[of])
                take = take[np.argsort(runs.bucket_of(h[take], buckets), kind="stable")]
                at, counts, out = runs.bucket_of(h[take], buckets), [], []
                edge = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else []
                place = np.empty(len(take), np.int64)
                least = np.empty(len(take), np.int64)
                for x, y in zip(edge, edge[1:]):
                    i = take[x:y]
                    r, rs, l, ls, small, entry = runs.entries(buf, p[i], lo[i], hi[i], ids[doc[i]])  # noqa: E741
                    out.append((name, int(at[x]), runs.pack(r, rs, l, ls, small)))
                    place[x:y] = entry + sum(counts)
                    least[x:y] = small[entry]
                    counts.append(len(small))
                # An occurrence in a larger document than its entry's smallest matches in all its windows.
                mine = ids[doc[take]] == least
                _write(folder, f"{name}-at", pa.RecordBatch.from_arrays([pa.array(p[take].astype(np.int64)), pa.array((p[take] - lo[take]).astype(np.int8)), pa.array((p[take] - hi[take]).astype(np.int8)), pa.array(np.where(mine, place, -1))], ["p", "far", "near", "entry"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary()))], ["file", "bucket", "data"])

    return _per_chunk(manifest, bits, "bits", n).mapInArrow(task, "file string, bucket int, data binary")


def deduplicate(docs: DataFrame, chunk: int = CHUNK, hashes: int = HASHES, per_bucket: int = ENTRIES, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if `texts`).

    A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller doc_id. Null and empty
    texts have no bytes. Rows with equal ids do not remove from each other; a null id counts as larger than all others.
    Texts of any length are read whole, in slices. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "suffixes")
    manifest = chunks(docs, folder, chunk)
    n, total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    first_buckets = int(max(2 * cores, total * 2 // 27 // hashes + 1))
    bits = shared(manifest, folder, n, first_buckets)
    suspicious = bits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(max(4 * cores, suspicious // per_bucket + 1))
    sent = sorted_runs(manifest, bits, folder, n, buckets, first_buckets)

    def meet(key, rows):
        for (f, _), m in zip(rows, runs.matches([runs.Run(d) for _, d in rows])):
            yield f, key, zstd.compress(m.tobytes(), 1)

    found = staged(_by_bucket(sent, buckets, meet, "file string, bucket int, data binary"), "matches")

    def cut(batches):
        for b in batches:
            for name, answers in zip(b.column("file").to_pylist(), b.column("answers").to_pylist()):
                batch, buf, sizes, _ = _chunk(folder, name)
                masks = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(zstd.decompress(a["data"]), np.uint32) for a in answers or ()]])
                at = _read(folder, f"{name}-at")
                p, far, near, entry = (at.column(c).to_numpy() for c in ("p", "far", "near", "entry"))
                mask = np.full(len(p), 0xFFFFFFFF, np.uint32)
                own = entry >= 0
                mask[own] = masks[entry[own]]
                starts = np.zeros(len(buf) + 1, np.int32)
                for o in range(runs.SPAN):
                    starts[p[(mask >> np.uint32(o) & np.uint32(1)).astype(bool) & (far >= o) & (near <= o)] - o] = 1
                running = np.cumsum(starts)
                covered = running[:-1].copy()
                covered[runs.LENGTH:] -= running[:-1 - runs.LENGTH]
                covered = covered > 0
                out, lo = [], 0
                for size in sizes.tolist():
                    c = covered[lo:lo + size]
                    removed = int(np.count_nonzero(c))
                    data = buf[lo:lo + size]
                    kept = (data[~c] if removed else data).tobytes()
                    spans = int(c[:1].sum() + np.count_nonzero(c[1:] & ~c[:-1])) if removed else 0
                    out.append((size, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
                    lo += size
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return _per_chunk(manifest, found, "data", n).mapInArrow(cut, schema)
