"""Near duplicates by min-max hashing (operator 4).

A document is the set of its word shingles. Under each of VALUES / 2 permutations both the smallest and the largest
element are kept, so a signature of VALUES values costs half the hash evaluations. Signatures are cut into bands of r
values; r is the largest with which a pair at the threshold is missed with a probability below MISS.

Equal sets are one node from the start. Within a bucket no list of all pairs is made:
  1. each node is compared with one other, the bucket minimum with which it shares most buckets; confirmed links give
     components. Some rounds more compare each node with one member of a larger component that it meets. A large group
     of copies is one component then;
  2. only nodes of different components that still meet in a bucket are compared by longer signatures of one bit a
     value, in blocks of bounded size. What is within six standard errors of the threshold is confirmed block by block
     too: each node brings its set once a block, and only links that join two components there are listed.
Every link is confirmed on the full sets. A link between nodes that share a bucket is thus either confirmed or lies
inside one component already.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import BROADCAST_IDS, parts, row_key, small_batches, spread, staged, without
from tablewright.llm.components import components, extended
from tablewright.llm.hashing import shingle_sets

WIDTH, PERCENT = 5, 80
VALUES, MISS = 192, 1e-6
#: Members of a bucket compared at once, bytes of their sets, about, and bytes of text hashed at once.
BLOCK, BLOCK_BYTES = 1_000, 1 << 24
GROUP_BYTES = 1 << 18
#: One-bit values of the longer signatures, and rounds before they are used.
BITS, ROUNDS = 4096, 3


def band_rows(percent: int, values: int = VALUES, miss: float = MISS) -> int:
    """Values per band: the largest number with which a pair at the threshold is missed less often than `miss`."""
    t = percent / 100
    return max(r for r in range(1, values) if r == 1 or (1 - t**r) ** (values // r) <= miss)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def multipliers(values: int) -> np.ndarray:
    return (np.random.default_rng(11).integers(0, 1 << 31, values // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)


def signature(s: np.ndarray, a: np.ndarray) -> bytes:
    """Low 16 bits of the smallest and largest element under each permutation."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 2048):
        y = a[:, None] * x[None, i:i + 2048]
        low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
    return np.stack([low, high], 1).astype("<u2").tobytes()


def signatures(docs: DataFrame, width: int, values: int) -> DataFrame:
    """n, digest and sig of each row, and its columns but the text; texts without words have n = 0 and no digest."""
    others = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)

    def task(batches):
        a = multipliers(values)
        for batch in batches:
            for b in parts(batch, "text", GROUP_BYTES):
                sets = shingle_sets(b.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([
                    *[b.column(c) for c in others], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, a) if len(s) else None for s in sets], pa.binary())], [*others, "n", "digest", "sig"])

    return spread(docs).mapInArrow(task, f"{kinds}, n bigint, digest binary, sig binary")


def bit_signature(s: np.ndarray, a: np.ndarray) -> bytes:
    """One bit of the smallest and largest element under each permutation: equal with probability (1 + similarity) / 2."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 256):
        y = a[:, None] * x[None, i:i + 256]
        low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
    return np.packbits(np.concatenate([low, high]) * np.uint32(0x9E3779B1) >> np.uint32(31) == 1).tobytes()


def tag() -> Column:
    """A number by which a row is found again; rows that share it are told apart by their digests."""
    return F.xxhash64("doc_id", "text")


def of_nodes(docs: DataFrame, wanted: DataFrame, width: int, make, name: str) -> DataFrame:
    """(node, value) of the wanted nodes (node, digest, tag), made from their sets by `make`; a task gives each node once at most."""
    small = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("node", F.col("digest").alias("_digest"), F.col("tag").alias("_tag"))
    rows = docs.select("text", tag().alias("_row")).join(F.broadcast(ids) if small else ids, F.col("_row") == F.col("_tag"))

    def task(batches):
        seen = set()
        for batch in batches:
            for b in parts(batch, "text", GROUP_BYTES):
                out = {}
                for k, d, s in zip(b.column("node").to_pylist(), b.column("_digest").to_pylist(), shingle_sets(b.column("text").to_pylist(), width)):
                    if k not in seen and digest(s) == d:
                        seen.add(k)
                        out[k] = make(s)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["node", "value"])

    with small_batches(docs.sparkSession):
        return staged(rows.select("text", "node", "_digest").mapInArrow(task, "node long, value binary").dropDuplicates(["node"]), name)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets meet the threshold."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = of_nodes(docs, staged(nodes.join(ends, "node").select("node", "digest", "tag"), "wanted"), width, lambda s: s.tobytes(), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("value").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("value").alias("sb")), "b")

    def task(batches):
        for batch in batches:
            ok = []
            for b in parts(batch, "sa", GROUP_BYTES):
                for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                    ok.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with small_batches(docs.sparkSession):
        return staged(both.mapInArrow(task, "a long, b long").distinct(), "links")


def cutoff(percent: int, values: int) -> int:
    """Equal signature values below which a pair is not similar: six standard errors under the threshold."""
    t = percent / 100
    return math.floor(values * t - 6 * math.sqrt(values * t * (1 - t)))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, values: int) -> DataFrame:
    """The pairs whose signatures may belong to similar sets."""
    least = cutoff(percent, values)
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def task(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    with small_batches(nodes.sparkSession):
        return staged(both.mapInArrow(task, "a long, b long"), "pairs")


def labelled(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, band, node, label) of the buckets in which components meet, and these buckets' sizes and largest component."""
    m = members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
    per = m.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "label")).alias("top")).filter("kinds > 1")
    per = staged(per.select("key", "size", F.col("top.label").alias("main"), F.col("top.c").alias("most")), "buckets")
    return staged(m.join(per.select("key"), "key"), "members"), per


def next_pairs(m: DataFrame, per: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) per node outside the largest component of its buckets: the member of such a component it meets most often."""
    m = m.join(per, "key")
    centre = m.filter("label = main").groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node"))["node"].alias("a"))
    met = m.filter("label <> main").select("key", F.col("node").alias("b")).join(centre, "key").groupBy("b", "a").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("b").agg(F.max(F.struct("c", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def remaining(m: DataFrame, per: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int, block: int, rows_of_band: int) -> DataFrame:
    """Links between nodes that meet in a bucket and are in different components: in each block enough to join all components that links join.

    A bucket up to `block` members is one group. A larger one is cut: its largest component's members, who need no
    comparison with each other, into blocks, and all others into blocks; groups are pairs of blocks. Members with large
    sets are cut into smaller blocks. A pair is looked at in the first bucket that it shares only.
    """
    wanted = staged(nodes.select("node", "digest", "tag").join(m.select("node").distinct(), "node"), "wanted")
    mult = multipliers(BITS)
    bits = of_nodes(docs, wanted, width, lambda s: bit_signature(s, mult), "bits").withColumnRenamed("value", "bits")
    m = m.join(per.select("key", "main", "size", "most"), "key").join(nodes.select("node", "sig", "n"), "node")
    central = F.col("label") == F.col("main")
    held = lambda x: F.ceil(8 * F.sum(F.when(x, F.col("n")).otherwise(0)) / BLOCK_BYTES)
    heavy = m.groupBy("key").agg(held(central).alias("hm"), held(~central).alias("ho"))
    m = m.drop("n").join(heavy, "key").join(bits, "node")
    m = m.withColumn("nm", F.greatest(F.ceil(F.col("most") / block), "hm")).withColumn("no", F.greatest(F.ceil((F.col("size") - F.col("most")) / block), "ho"))
    at = F.pmod(F.xxhash64("node", F.lit(3)), F.when(central, F.col("nm")).otherwise(F.col("no"))).cast("int")
    span = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    zero = F.lit(0)
    cells = F.when((F.col("size") <= block) & (F.col("hm") + F.col("ho") <= 2), F.array(pair(0, zero, zero))) \
        .when(central, F.transform(span(F.col("no")), lambda j: pair(1, F.col("at"), j))) \
        .otherwise(F.concat(F.transform(span(F.col("nm")), lambda i: pair(1, i, F.col("at"))),
                            F.transform(span(F.col("no")), lambda j: pair(2, F.least(j, F.col("at")), F.greatest(j, F.col("at"))))))
    m = m.withColumn("at", at).withColumn("cell", F.explode(cells))
    m = m.withColumn("side", F.when(F.col("cell.kind") == 0, 0).when(F.col("cell.kind") == 1, F.when(central, 0).otherwise(1)).otherwise(F.when(F.col("cell.i") == F.col("cell.j"), 0).when(F.col("at") == F.col("cell.i"), 0).otherwise(1)))
    m = m.withColumn("cell_id", F.xxhash64("key", "cell"))
    # Equal bits at the threshold, less six standard errors.
    same = (1 + percent / 100) / 2
    most_unequal = BITS - math.floor(BITS * same - 6 * math.sqrt(BITS * same * (1 - same)))

    def compare(rows):
        """The nodes of a cell that take part in likely pairs: cell, node, label, and the other ends of the pairs listed with this node."""
        side = np.array([r[1] for r in rows])
        node = np.array([r[2] for r in rows], np.int64)
        bits = np.frombuffer(b"".join([r[4] for r in rows]), np.uint64).reshape(len(rows), -1)
        sig = np.frombuffer(b"".join([r[5] for r in rows]), "<u2").reshape(len(rows), -1)
        sig = sig[:, :sig.shape[1] // rows_of_band * rows_of_band].reshape(len(rows), -1, rows_of_band)
        number: dict[int, int] = {}
        label = np.array([number.setdefault(r[3], len(number)) for r in rows])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        both = not side.any()
        ends: dict[int, bytes] = {}
        for lo in range(0, len(left), 16):
            own = left[lo:lo + 16]
            hit = np.bitwise_count(bits[own][:, None, :] ^ bits[right][None, :, :]).sum(2, dtype=np.int32) <= most_unequal
            hit &= label[own][:, None] != label[right][None, :]
            if both:
                hit &= own[:, None] < right[None, :]
            for x, found in zip(own.tolist(), hit):
                y = right[found]
                y = y[(sig[x] == sig[y]).all(2).argmax(1) == rows[0][6]]
                if len(y):
                    ends[x] = node[y].tobytes()
                    for k in y.tolist():
                        ends.setdefault(k, b"")
        return [(rows[0][0], rows[k][2], rows[k][3], v) for k, v in ends.items()]

    def task(batches):
        rows, out = [], []
        schema = pa.schema([("cell_id", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("ends", pa.binary())])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return batch

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("cell_id", "side", "node", "label", "bits", "sig", "band"))):
                if rows and r[0] != rows[0][0]:
                    out += compare(rows)
                    rows = []
                    if len(out) > 2_000:
                        yield flush()
                rows.append(r)
        if rows:
            out += compare(rows)
        yield flush()

    cells = m.select("cell_id", "side", "node", "label", "bits", "sig", "band").repartition("cell_id").sortWithinPartitions("cell_id")
    with small_batches(docs.sparkSession):
        found = staged(cells.mapInArrow(task, "cell_id long, node long, label long, ends binary"), "likely")
    return joined(found, docs, nodes, width, percent)


def joined(found: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b), confirmed on the full sets, of the likely pairs in cells (cell_id, node, label, ends): those that join two components in their cell."""
    sets = of_nodes(docs, staged(nodes.join(found.select("node").distinct(), "node").select("node", "digest", "tag"), "wanted"), width, lambda s: s.tobytes(), "sets")

    def links(rows):
        sets = {r[1]: np.frombuffer(r[4], np.uint64) for r in rows}
        label = {r[1]: r[2] for r in rows}
        parent = {x: x for x in label.values()}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for _, a, _, ends, _ in rows:
            for b in np.frombuffer(ends, np.int64).tolist():
                x, y = find(label[a]), find(label[b])
                if x != y and similar(sets[a], sets[b], percent):
                    parent[x] = y
                    yield a, b

    def task(batches):
        rows, out = [], []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], ["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("cell_id", "node", "label", "ends", "value"))):
                if rows and r[0] != rows[0][0]:
                    out += links(rows)
                    rows = []
                    if len(out) > 20_000:
                        yield flush()
                rows.append(r)
        if rows:
            out += links(rows)
        yield flush()

    members = found.join(sets, "node").select("cell_id", "node", "label", "ends", "value").repartition("cell_id").sortWithinPartitions("cell_id")
    with small_batches(docs.sparkSession):
        return staged(members.mapInArrow(task, "a long, b long").distinct(), "links")


def linked(docs: DataFrame, width: int, percent: int, values: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and per digest (digest, rep, label): its smallest doc_id and its class."""
    rows = band_rows(percent, values)
    with small_batches(docs.sparkSession):
        base = staged(signatures(docs.withColumn("tag", tag()), width, values), "signatures")
    nodes = base.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("tag").alias("tag"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = values // rows
    key = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * rows) + 1, F.lit(2 * rows))))
    met = nodes.select("node", F.posexplode(key).alias("band", "key"))
    centres = met.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    members = staged(met.join(centres, "key"), "buckets")
    # Per node the bucket minimum it meets most often.
    shared = members.filter("node <> centre").groupBy(F.col("node").alias("b"), F.col("centre").alias("a")).agg(F.count(F.lit(1)).alias("c"))
    first = shared.groupBy("b").agg(F.max(F.struct("c", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = confirmed(likely(first, nodes, percent, values), docs, nodes, width, percent)
    labels = staged(components(links), "labels")
    m, per = labelled(members.select("key", "band", "node"), labels)
    for turn in range(ROUNDS):
        if per.isEmpty():
            break
        new = confirmed(likely(next_pairs(m, per, turn), nodes, percent, values), docs, nodes, width, percent)
        if new.isEmpty():
            break
        labels = staged(extended(labels, new), "labels")
        m, per = labelled(m.select("key", "band", "node"), labels)
    if not per.isEmpty():
        new = remaining(m, per, docs, nodes, width, percent, block, rows)
        labels = staged(extended(labels, new), "labels")
    group = nodes.select("node", "digest", "rep").join(labels, "node", "left").select("digest", "rep", F.coalesce("label", "node").alias("label"))
    return base, group


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, values: int = VALUES, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Sets are linked if 100 * intersection >= percent * union. Null, empty and blank texts have n_shingles 0, are linked
    with nothing and kept. Repeated rows with words are links of each other and all kept if theirs is the smallest id;
    a null doc_id is never the smallest unless alone, and kept only then. Other columns are not read. Empty tables give no rows.
    """
    base, group = linked(docs.select("doc_id", "text"), width, percent, values, block)
    least = group.groupBy("label").agg(F.min("rep").alias("component_id"))
    group = group.join(least, "label").select("digest", "component_id")
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(group, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each class, with all its columns: of the smallest id (null last), then key. Texts without words all stay.

    Ids may be null or repeated, so rows are told apart by id and text; of rows equal in both any one stays.
    """
    base, group = linked(docs.select("doc_id", "text", row_key().alias("key")), width, percent, VALUES, BLOCK)
    base = base.filter("n > 0")
    best = base.groupBy("digest").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")).alias("best"))
    chosen = staged(best.join(group, "digest").groupBy("label").agg(F.min("best")["key"].alias("key")).select("key"), "chosen")
    keys = base.groupBy("key").count()
    dropped = keys.join(chosen, "key", "left_anti").select("key")
    # Rows equal to a chosen one are copies too; they are few or none, so only they are looked at again.
    again = staged(keys.filter("count > 1").join(chosen, "key", "left_semi").select("key"), "again")
    d = docs.withColumn("_key", row_key())
    out = without(d, dropped.unionByName(again), "_key")
    if not again.isEmpty():
        out = out.unionByName(d.join(again, F.col("_key") == F.col("key"), "left_semi").dropDuplicates(["_key"]))
    return out.drop("_key")
