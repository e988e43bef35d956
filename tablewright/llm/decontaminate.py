"""Benchmark decontamination by size-partitioned MinHash containment search (operator 2, DataFrame functions only).

Items and documents are sets of word shingles (lower-case, WIDTH words; an item with fewer words is one shingle). Items
are partitioned by set size. Within a partition an item is represented by its smallest shingle hashes (a bottom-k
MinHash sketch); k follows from the partition's sizes: a document that holds the share `threshold` of n shingles misses
at most n - ceil(threshold n) of them, so one more sketch value than that cannot all be missing. The search therefore
finds every short item in a document of any length, which a signature of the whole document could not. Candidates are
verified on the exact shingles.

Documents are never shuffled: items meet them in blocks of about `block` sketch values, which travel with the plan, and
a larger benchmark is searched block after block.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import lower_ascii, once, row_key, staged, without, words

WIDTH, THRESHOLD, BLOCK = 5, 0.8, 20_000
#: Upper bounds of the size partitions grow by this factor.
GROWTH = 1.25


def shingles(w: Column, width: int, hashed: bool) -> Column:
    """All shingles of `width` words, as 64-bit hashes or as text; none if there are fewer words."""
    def at(i: Column) -> Column:
        parts = [F.get(w, i + j) for j in range(width)]
        return F.xxhash64(*parts) if hashed else F.concat_ws(" ", *parts)

    # sequence() would count downwards for short texts, so its end is kept at 0 and the case cut off.
    last = F.size(w) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))


def sketch_size(n: int, threshold: float) -> int:
    """Smallest sketch that a document with the share `threshold` of n shingles cannot miss."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def sketches(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per item that has words: item_id, row, width, n (distinct shingles), part, sketch, texts."""
    w = items.select("item_id", words(lower_ascii(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    # Rows are told apart by a number, since item_id may be null or repeated; the table is small and read twice only.
    w = staged(w.withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.least(F.size("w"), F.lit(width))), "items")
    out = None
    for k in range(1, width + 1):
        part = w.filter(F.col("width") == k).select("item_id", "row", "width", F.array_distinct(shingles(F.col("w"), k, False)).alias("texts"), F.array_sort(F.array_distinct(shingles(F.col("w"), k, True))).alias("hashes"))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("n", F.size("hashes")).withColumn("part", F.floor(F.log(F.col("n")) / math.log(GROWTH)).cast("int"))
    # The largest set of a partition sets its sketch size, so all its items are searched alike.
    top = F.max("n").over(Window.partitionBy("part"))
    k = top - F.ceil(F.lit(threshold) * top - 1e-9) + 1
    return out.withColumn("sketch", F.slice("hashes", F.lit(1), F.least(k, F.col("n")).cast("int"))).drop("hashes")


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Pairs of a document and an item of which it holds at least `threshold`: doc_id, item_id, n_shared, n_item, containment.

    Null and blank texts hold and match nothing. Repeated rows give a row each; null ids are carried. Other columns are
    not read. Empty tables give no rows.
    """
    s = staged(sketches(items, threshold, width), "sketch")
    # Blocks by running number of sketch values; one row per block reaches the driver only as its number.
    running = Window.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("block", F.floor(F.sum(F.size("sketch")).over(running) / block))
    s = staged(s, "sketch")
    plan = s.groupBy("block").agg(F.sort_array(F.collect_set("width")).alias("widths")).orderBy("block").collect()
    found = None
    for p in plan:
        part = _search(docs, s.filter(F.col("block") == p["block"]), p["widths"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.limit(0).select("doc_id").crossJoin(items.limit(0).select("item_id")).selectExpr("doc_id", "item_id", "0 AS n_shared", "0 AS n_item", "0D AS containment")
    return found


def _search(docs: DataFrame, block: DataFrame, widths: list[int], threshold: float) -> DataFrame:
    found = None
    for k in widths:
        mine = block.filter(F.col("width") == k)
        # At most `block` values, each with the rows that have it: bounded, so one literal carries them.
        values = mine.select(F.explode("sketch").alias("v"), "row").groupBy("v").agg(F.collect_set("row").alias("rows")).orderBy("v").collect()
        vs = F.from_json(F.lit(json.dumps([v["v"] for v in values])), "array<bigint>")
        owners = F.from_json(F.lit(json.dumps([v["rows"] for v in values])), "array<array<bigint>>")
        d = docs.select("doc_id", once(words(lower_ascii(F.col("text")))).alias("w")).filter(F.size("w") >= k)
        d = d.select("doc_id", "w", once(F.array_intersect(shingles(F.col("w"), k, True), vs)).alias("hits")).filter(F.size("hits") > 0)
        rows = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.get(owners, (F.array_position(vs, h) - 1).cast("int")))))
        c = d.select("doc_id", rows.alias("rows"), once(F.array_distinct(shingles(F.col("w"), k, False))).alias("texts_d"))
        c = c.select("doc_id", F.explode("rows").alias("row"), "texts_d")
        items = F.broadcast(mine.select("row", "item_id", F.col("n").alias("n_item"), "texts"))
        need = F.lit(threshold) * F.col("n_item") - 1e-9
        c = c.join(items, "row").filter(F.size("texts_d") >= need)
        c = c.withColumn("n_shared", F.size(F.array_intersect("texts", "texts_d"))).filter(F.col("n_shared") >= need)
        part = c.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents that hold no item, with all their columns. Ids may be null or repeated: each text is judged by itself."""
    d = docs.withColumn("_key", row_key())
    found = find(d.select(F.col("_key").alias("doc_id"), "text"), items, threshold, width)
    return without(d, found.select("doc_id"), "_key").drop("_key")
