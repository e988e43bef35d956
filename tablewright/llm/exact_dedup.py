"""Exact dedup with an extendible-hash index in shared files; DataFrame functions only.

Every text has a 64-bit key. The directory maps the leading bits of a key to a bucket, so a bucket is a key range.
It starts at the depth that the size of the corpus makes certain and doubles as long as buckets are overfull: an
overfull bucket is split on its next bit, all others keep their depth and are pointed to more than once. The number of
buckets is bounded (`MAX_BUCKETS`), beyond that buckets grow, so the directory is small enough to broadcast at any size.

An owner task takes whole buckets: it compares texts by their bytes, never by key alone, and chains different texts
that share a key in byte order. Copies of a text that alone would overfill a bucket are combined before they are
shuffled. The filled buckets are written as Parquet (the index), one line per text. Rows find their line by key and
SHA-256, and the row with the largest doc_id stays.

Defined cases: a null text is the empty text; empty texts are equal to each other like any others; a null doc_id is less
than all others; of rows that share the largest doc_id and the text, one stays; an empty table gives an empty result.
Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.joins import lookup

from .common import new_folder, staged

#: A bucket is split when its texts (and ROW_BYTES for each row) take more; larger corpora have larger buckets instead
#: of more than MAX_BUCKETS. Buckets still overfull LEVELS below the first directory stay so.
BUCKET_BYTES = 1 << 20
MAX_BUCKETS = 1 << 18
LEVELS = 3
ROW_BYTES = 64


class Index(NamedTuple):
    """rows: row, doc_id, key, digest, bytes; directory: pointer, bucket; depth of the directory in bits;
    entries: bucket, key, chain, n_copies, keep_id, digest, text."""

    rows: DataFrame
    directory: DataFrame
    depth: int
    entries: DataFrame


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def directory(keys: DataFrame, total: int, capacity: int) -> tuple[DataFrame, int]:
    """Double the directory until no bucket of `keys` (key, load) is overfull: (pointer, bucket) and the depth."""
    first = max(1, math.ceil(math.log2(max(1, total / capacity))))
    depth, split, leaves = first, keys, []
    while True:
        loads = staged(split.groupBy(_prefix(depth).alias("bucket")).agg(F.sum("load").alias("load"), F.count("*").alias("n")), "loads")
        full = (F.col("load") > capacity) & (F.col("n") > 1) & F.lit(depth < first + LEVELS)
        leaves.append((loads.filter(~full), depth))
        if loads.filter(full).isEmpty():
            break
        # at most MAX_BUCKETS << LEVELS buckets of 8 bytes each
        over = F.broadcast(loads.filter(full).select(F.col("bucket").alias("over")))
        split = split.join(over, _prefix(depth) == F.col("over"), "left_semi")
        depth += 1
    pointers = None
    for leaf, at in leaves:
        span = 1 << (depth - at)
        own = leaf.select((F.col("bucket") * span).alias("bucket")).select(F.explode(F.sequence("bucket", F.col("bucket") + (span - 1))).alias("pointer"), "bucket")
        pointers = own if pointers is None else pointers.union(own)
    return staged(pointers, "directory"), depth


def build(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, key: Callable[[Column], Column] = F.xxhash64) -> Index:
    """Index every text of `docs` (doc_id, text); `key` maps a text to a long."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key(F.col("text")).cast("long"))
    rows = staged(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", _digest().alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "rows")
    total = rows.agg(F.sum(F.col("bytes") + ROW_BYTES)).first()[0] or 0
    capacity = max(bucket_bytes, total // MAX_BUCKETS)
    load = F.col("bytes") + ROW_BYTES
    keys = rows.groupBy("key").agg(F.sum(load).alias("all"), F.max(load).alias("one"), F.count("*").alias("n"))
    hot = (F.col("all") > capacity) & (F.col("n") > 1)
    keys = staged(keys.select("key", hot.alias("hot"), F.when(hot, F.col("one")).otherwise(F.col("all")).alias("load")), "keys")
    pointers, depth = directory(keys, total, capacity)
    # hot keys: each holds more than a bucket's bytes, so there are at most MAX_BUCKETS
    often = F.broadcast(keys.filter("hot").select(F.col("key").alias("often")))
    # at most MAX_BUCKETS << LEVELS pointers of 16 bytes
    texts = texts.join(F.broadcast(pointers), _prefix(depth) == F.col("pointer"))
    line = ["bucket", "key", "text"]
    facts = [F.count("*").alias("n_copies"), F.max("doc_id").alias("keep_id")]
    owned = texts.join(often, F.col("key") == F.col("often"), "left_anti").select("doc_id", *line).repartition("bucket").groupBy(*line).agg(*facts)
    combined = texts.join(often, F.col("key") == F.col("often"), "left_semi").select("doc_id", *line).groupBy(*line).agg(*facts)
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text")).alias("chain")
    path = new_folder(docs.sparkSession, "index")
    for part in [owned, combined] if keys.filter("hot").head(1) else [owned]:
        part.select("bucket", "key", chain, "n_copies", "keep_id", _digest().alias("digest"), "text").write.mode("append").parquet(path)
    return Index(rows, pointers, depth, docs.sparkSession.read.parquet(path))


def deduplicate(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    index = index or build(docs)
    groups = index.entries.filter("n_copies > 1").select(F.struct("key", "digest").alias("entry"), "n_copies", "keep_id")
    heads = index.rows.groupBy("key", "digest").agg(F.max(F.struct("doc_id", "row"))["row"].alias("head"), F.count("*").alias("n"))
    heads = heads.filter("n > 1").select(F.struct("key", "digest").alias("_entry"), "head")
    groups = staged(groups.join(heads, F.col("entry") == F.col("_entry")).select("entry", "n_copies", F.struct("n_copies", "keep_id", "head").alias("group")), "groups")
    found = lookup(index.rows, groups, F.struct("key", "digest"), "entry", "n_copies", index.rows.count())
    single = F.col("group").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("group.keep_id")).alias("keep_id"),
        F.coalesce(F.col("group.n_copies"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("group.head"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
