"""Token IDs in Arrow files of fixed-size lists (operator 7).

Documents are dealt by ranges of doc_id; each range is one Arrow IPC file whose record batches hold equal-length
sequences: `ids`, fixed_size_list<uint16 or uint32>[L], and `mask`, fixed_size_list<bool>[L], true for tokens. A file
can be memory-mapped and sequence i is in batch i // BATCH at i % BATCH, without copying or decoding. Documents follow
each other within a file, each closed by the end id; only a file's last sequence is padded. The index, a Parquet table,
says where each document lies. A task writes under a name of its own and the index names the files of the tasks that
were committed, so a lost executor leaves at most an unread file.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.common import new_folder, small_batches

LENGTH, BATCH, END_ID = 2048, 256, 0
#: Pieces that a Python worker remembers (some 50 bytes each), and their bytes; beyond either it keeps the commonest, up to three quarters of these.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 1 << 24
#: White space that only Unicode knows; texts with it are encoded whole.
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER, MARK = np.zeros(256, bool), np.full(256, 2)
LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
MARK[[*b".,"]] = 0, 1
JOINED = 1_000
#: Bytes compared with their pieces at a time.
COMPARED = 1 << 18
#: Bytes of text encoded together, about, and texts at most.
GROUP_BYTES, GROUP = 1 << 19, 4_000


def _files(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first[k], first[k] + 1, ... of n[k] elements for all k, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


class Encoder:
    """Encodes texts piece by piece and remembers the pieces by hash, since words repeat.

    A text is cut before each space or line feed, except inside longer runs of white space: there the tokenizer's
    pre-tokenizer always cuts, so the ids of a text are those of its pieces. Pieces are told apart by a 64-bit hash, each
    new one is encoded once, and ids are gathered by array operations. New pieces of one white space character and a word are
    encoded many at a time as one text, which is parted again by the tokens' lengths in bytes.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)  # a byte-level token has a character for each byte
        rng = np.random.default_rng(5)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self._power = (np.ones(1, np.uint64), np.ones(1, np.uint64))
        # Hashes in order, the place of each piece in the lists, and of piece k the ids [places[k], places[k + 1]), the bytes [starts[k], starts[k + 1]) and how often it was met.
        self.hashes, self.order, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.places, self.starts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.bytes = np.zeros(0, self.dtype), bytearray()

    def _forget(self) -> None:
        """Keep the pieces met most often, of equals the latest."""
        width, size = np.diff(self.starts), np.diff(self.places)
        keep = np.lexsort([np.arange(len(width)), self.uses])[::-1][:REMEMBERED // 4 * 3]
        keep = np.sort(keep[np.cumsum(width[keep]) <= REMEMBERED_BYTES // 4 * 3])
        place = np.full(len(self.uses), -1, np.int32)
        place[keep] = np.arange(len(keep), dtype=np.int32)
        self.ids = self.ids[spans(self.places[keep], size[keep])]
        self.bytes = bytearray(np.frombuffer(self.bytes, np.uint8)[spans(self.starts[keep], width[keep])])
        self.places, self.starts = (np.concatenate([[0], np.cumsum(x[keep])]) for x in (size, width))
        order = place[self.order]
        self.hashes, self.order, self.uses = self.hashes[order >= 0], order[order >= 0], self.uses[keep] // 2

    def _powers(self, n: int):
        if len(self._power[0]) < n:
            m = n + n // 8
            self._power = tuple(np.concatenate([[np.uint64(1)], np.full(m - 1, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (self.base, self.inverse))
        return self._power

    def _unequal(self, buf, start, stop, where, of, slot, here) -> np.ndarray:
        """Pieces whose bytes are not those of the first piece, or of the remembered piece, with their hash."""
        size, n = stop - start, len(buf) - 1  # the pieces lie side by side and cover the bytes
        lead = where[of]
        wrong = size != size[lead]
        back = np.where(wrong, 0, start[lead] - start)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(stop, np.arange(COMPARED, n, COMPARED)), [len(stop)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            lo, hi = int(start[a]), int(stop[b - 1])
            other = np.flatnonzero(buf[np.arange(lo, hi) + np.repeat(back[a:b], size[a:b])] != buf[lo:hi])
            wrong[np.searchsorted(stop, other + lo, "right")] = True
        seen = np.flatnonzero(here)
        first, kept = where[seen], slot[seen]
        bad = size[first] != self.starts[kept + 1] - self.starts[kept]
        first, kept, own = first[~bad], kept[~bad], seen[bad]
        if len(first):
            long = size[first]
            store = np.frombuffer(self.bytes, np.uint8)
            differ = buf[spans(start[first], long)] != store[spans(self.starts[kept], long)]
            del store
            own = np.concatenate([own, seen[~bad][np.unique(np.repeat(np.arange(len(first)), long)[differ])]])
        if len(own):
            wrong |= np.isin(of, own)
        return np.flatnonzero(wrong)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, buf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces not seen before, all different, one after the other, and their numbers. The pieces lie side by side, of n bytes each."""
        # A point or comma after a letter is a piece of its own, so a word is encoded once with all that may follow it.
        stop = np.cumsum(n)
        start = stop - n
        mark = np.where((n > 1) & LETTER[buf[np.maximum(stop, 2) - 2]], MARK[buf[stop - 1]], 2)
        n = n - (mark < 2)
        second, last = buf[np.minimum(start + 1, len(buf) - 1)], buf[start + n - 1]
        word = (n > 1) & ((buf[start] == 32) | (buf[start] == 10)) & (second > 32) & (last > 32)
        whole = buf.tobytes()
        stem = [whole[a:b] for a, b in zip(start.tolist(), (start + n).tolist())]
        for k in np.flatnonzero(word & ((second > 126) | (last > 126))).tolist():
            p = stem[k].decode()
            word[k] = not p[1].isspace() and not p[-1].isspace()
        number = {b".": 0, b",": 1}
        row = np.array([number.setdefault(p, len(number)) for p in stem])
        stems = list(number)
        words, width = np.zeros(len(stems), bool), np.ones(len(stems), np.int64)
        words[row], width[row] = word, n
        single = np.flatnonzero(~words).tolist()
        words = np.flatnonzero(words).tolist()
        known, ids, sizes = [], [], []
        for i in range(0, len(words), JOINED):
            some = words[i:i + JOINED]
            joined = self._encode([b"".join([stems[k] for k in some]).decode()])[0]
            places, ends = np.cumsum(width[some]), np.cumsum(self.lengths[joined])
            at = np.searchsorted(ends, places)
            if ends[-1] == places[-1] and (ends[at] == places).all():
                known += some
                ids.append(joined)
                sizes.append(np.diff(at, prepend=-1))
            else:
                single += some
        for i in range(0, len(single), JOINED):
            found = self._encode([stems[k].decode() for k in single[i:i + JOINED]])
            known += single[i:i + JOINED]
            ids += found
            sizes.append(np.array([len(x) for x in found], np.int64))
        # A piece is its stem and its mark, or nothing, which is the last of the numbers.
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        size, first = np.zeros(len(stems) + 1, np.int64), np.zeros(len(stems) + 1, np.int64)
        size[known], first[known] = sizes, np.cumsum(sizes) - sizes
        rows = np.stack([row, np.array([0, 1, len(stems)])[mark]], 1)
        return ids[spans(first[rows.ravel()], size[rows.ravel()])], size[rows].sum(1)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by the end id, and their numbers."""
        if len(self.hashes) > REMEMBERED or len(self.bytes) > REMEMBERED_BYTES:
            self._forget()
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(raw) + b"\n", np.uint8)  # the last byte closes the last text
        n = len(buf) - 1
        cut = (buf == 32) | (buf == 10)
        space = ASCII_SPACE[buf]
        # A cut in a run: white space before it, and behind it white space or the end of the text, or a line feed itself.
        ends = np.zeros(n + 1, bool)
        ends[(first + size)[size > 0]] = True
        odd = np.flatnonzero(cut[1:n] & space[:n - 1] & ((buf[1:n] == 10) | space[2:] | ends[2:])) + 1 if n > 1 else np.zeros(0, np.int64)
        bad = np.zeros(len(texts), bool)
        bad[np.searchsorted(first + size, odd, "right")] = True
        for i, t in enumerate(texts):
            if not t.isascii() and WIDE_SPACE.search(t):
                bad[i] = True
        for i in np.flatnonzero(bad):
            cut[first[i]:first[i] + size[i]] = False
        cut[first[size > 0]] = True
        start = np.flatnonzero(cut[:n])
        stop = np.append(start[1:], n)
        power, inverse = self._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        values = self.value[buf[:n]]
        values *= power[:n]
        np.cumsum(values, dtype=np.uint64, out=total[1:])
        del values
        h = (total[stop] - total[start]) * inverse[start]
        h ^= h >> np.uint64(29)
        h = h * self.base + (stop - start).astype(np.uint64)
        while True:
            different, where, of = np.unique(h, return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, different)
            here = np.zeros(len(different), bool)
            inside = at < len(self.hashes)
            here[inside] = self.hashes[at[inside]] == different[inside]
            slot = np.zeros(len(different), np.int64)
            slot[here] = self.order[at[here]]
            wrong = self._unequal(buf, start, stop, where, of, slot, here)
            if not len(wrong):
                break
            for i in wrong.tolist():  # regular long pieces may share a sum: these go by BLAKE2b, and their bytes are compared again
                h[i] = int.from_bytes(hashlib.blake2b(buf[start[i]:stop[i]], digest_size=8).digest(), "little")
        new = np.flatnonzero(~here)
        if len(new):
            long = (stop - start)[where[new]]
            pieces = buf[spans(start[where[new]], long)]
            ids, sizes = self._new(pieces, long)
            slot[new] = len(self.uses) + np.arange(len(new))
            self.hashes = np.insert(self.hashes, at[new], different[new])
            self.order = np.insert(self.order, at[new], slot[new])
            self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(sizes)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(long)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
            self.ids = np.concatenate([self.ids, ids])
            self.bytes += pieces.tobytes()
        self.uses[slot] += np.bincount(of, minlength=len(slot)).astype(np.int32)
        count = (self.places[slot + 1] - self.places[slot])[of]
        before = np.cumsum(count) - count
        text_of = np.searchsorted(first + size, start, "right")
        n_ids = int(count.sum())
        source = np.repeat(self.places[slot][of] - before, count) + np.arange(n_ids)
        out = np.full(n_ids + len(texts), self.end_id, self.dtype)
        out[np.arange(n_ids) + np.repeat(text_of, count)] = self.ids[source]
        return out, np.bincount(text_of, count, len(texts)).astype(np.int64) + 1


ENCODERS: dict[tuple[str, int], Encoder] = {}


def write(docs: DataFrame, tokenizer: str, folder: str, length: int = LENGTH, batch: int = BATCH, end_id: int = END_ID) -> DataFrame:
    """Encode every text, write the files under `folder`, return the index.

    Index: doc_id, file, first (place of the document's first id in the file), n_tokens (with the end id), start (ids of
    all documents before it). Documents are in ascending doc_id order, null ids first; repeated ids lie side by side,
    ordered by their text's hash. Null and empty texts are an end id alone. Other columns are not read. An empty table
    gives an empty index and no file.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = max(docs.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def task(batches):
        if (tokenizer, end_id) not in ENCODERS:
            ENCODERS[tokenizer, end_id] = Encoder(tokenizer, end_id)
        encode = ENCODERS[tokenizer, end_id]
        system, root = _files(folder)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}-{uuid.uuid4().hex[:12]}.arrow"
        item = pa.from_numpy_dtype(encode.dtype)
        schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        writer, rest, at = None, np.zeros(0, encode.dtype), 0

        def put(ids: np.ndarray, last: bool):
            nonlocal writer
            full = length * batch
            stop = len(ids) if last else len(ids) // full * full
            for i in range(0, stop, full):
                own = ids[i:min(i + full, stop)]
                pad = -len(own) % length
                mask = np.ones(len(own) + pad, bool)
                mask[len(own):] = False
                own = np.concatenate([own, np.zeros(pad, own.dtype)]) if pad else own
                if writer is None:
                    writer = pa.ipc.new_file(system.open_output_stream(f"{root}/{name}"), schema)
                writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(own), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))
            return ids[stop:]

        for b in batches:
            ids_col, texts = b.column("doc_id"), b.column("text")
            heavy = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // GROUP_BYTES
            group = heavy * b.num_rows + np.arange(b.num_rows) // GROUP
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(edges, edges[1:]):
                out, sizes = encode(texts.slice(lo, hi - lo).to_pylist())
                rest = put(np.concatenate([rest, out]), False)
                first = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([ids_col.slice(lo, hi - lo), pa.array([name] * len(sizes)), pa.array([part] * len(sizes), pa.int32()), pa.array(first, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "file", "part", "first", "n_tokens"])
            pa.default_memory_pool().release_unused()  # else the worker holds what earlier batches took
        put(rest, True)
        if writer is not None:
            writer.close()

    rows = d.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, file string, part int, first bigint, n_tokens bigint")
    path = f"{folder}/index"
    with small_batches(spark):
        rows.write.parquet(path)
    index = spark.read.schema(rows.schema).parquet(path)
    # One row per file: running totals of the files before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return index.join(files, "file").select("doc_id", "file", "first", "n_tokens", (F.col("before") + F.col("first")).alias("start"))


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, folder: str, file: str):
        system, root = _files(folder)
        where = f"{root}/{file}"
        self.source = pa.memory_map(where) if system.type_name == "local" else system.open_input_file(where)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch, self.rows = -1, None, None

    def _values(self, i: int):
        if i != self.at:
            b = self.file.get_batch(i)
            self.at, self.batch = i, [c.flatten().to_numpy(zero_copy_only=c.type.value_type != pa.bool_()) for c in b.columns]
        return self.batch

    def span(self, first: int, n: int):
        """The ids [first, first + n) as views of the mapped batches, with their masks."""
        if self.rows is None:
            self.rows = self.file.get_batch(0).num_rows
        per = self.rows * self.length
        while n > 0:
            i, lo = divmod(first, per)
            ids, mask = self._values(i)
            yield ids[lo:lo + n], mask[lo:lo + n]
            first, n = first + min(n, per - lo), n - min(n, per - lo)


def read(index: DataFrame, folder: str) -> DataFrame:
    """Per document of the index, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def task(batches):
        reader, open_name = None, None
        for b in batches:
            counts, sums = [], []
            for name, first, n in zip(*(b.column(c).to_pylist() for c in ("file", "first", "n_tokens"))):
                if name != open_name:
                    reader, open_name = Reader(folder, name), name
                crc, count = 0, 0
                for ids, mask in reader.span(first, n):
                    count += int(mask.sum())
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                counts.append(count)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = 4 * index.sparkSession.sparkContext.defaultParallelism
    rows = index.repartitionByRange(max(n, index.rdd.getNumPartitions()), "start").sortWithinPartitions("start")
    return rows.select("doc_id", "file", "first", "n_tokens", "start").mapInArrow(task, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to a new folder under the shared one and read back."""
    folder = new_folder(docs.sparkSession, "token-ids")
    return read(write(docs, tokenizer, folder, **options), folder)
