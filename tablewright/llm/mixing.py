"""Mixing sources to target weights by pivotal dependent rounding (operator 5, DataFrame functions only).

Every document starts with a fractional number of copies: its source's target over its source's size. The whole part
is certain. The fractional parts are rounded by the pivotal method: two documents of a source that are still
fractional meet, mass measured in words moves from one to the other until one of them is integral, and the direction
is drawn so that each document's expected copies stay as they were. The words taken from the pair do not change, so
the only loss of a whole source is in the last document left over.

Documents of a source are dealt into blocks by hash; each block folds its documents and leaves at most one fractional
document, and the left-overs form the blocks of the next level: a reduction tree whose fan-in is BLOCK, so a hot
source is as many blocks as it needs and no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import WORD, staged

#: Mean number of documents folded by one step of the tree.
BLOCK = 64
EPS = 1e-9
#: A mass can move between two documents in words: (index, size, fraction, copies).
UNIT = "struct<id:bigint,size:double,x:double>"


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """Adds `target` to (source, source_size): shares of the whole by weight, none above `limit` times its source.

    Sources take the weights in turn, by code point, null last. What is above a limit is shared again by weight until
    none is above: with sources in order of limit per weight, all before some place stop at their limit and the rest
    share what is left, which running sums find in one pass. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("_w", each).withColumn("_cap", F.lit(limit) * F.col("source_size"))
    rise = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_first())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    after = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # The level rises up to the first source that stays under its limit and never rises after it.
    t = t.withColumn("_level", F.max("_level").over(everything))
    return t.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap"))).drop("_w", "_cap", "_level")


def _fold(units: Column, seed: int) -> Column:
    """Fold the sorted units of a block: (open unit or null, decided units)."""
    start = F.struct(F.lit(None).cast(UNIT).alias("open"), F.array().cast(f"array<{UNIT}>").alias("done"))

    def meet(acc: Column, u: Column) -> Column:
        o = acc["open"]
        a, b = o["x"] * o["size"], u["x"] * u["size"]  # fractional words of either
        # Up: the open one gains `up` words from the new one; down: it gives `down` words to it.
        up = F.least(o["size"] - a, b)
        down = F.least(a, u["size"] - b)
        draw = F.pmod(F.xxhash64(F.lit(seed), o["id"], u["id"]), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moved = F.when(draw * (up + down) < down, up).otherwise(-down)
        x, y = (a + moved) / o["size"], (b - moved) / u["size"]
        first = F.struct(o["id"].alias("id"), o["size"].alias("size"), x.alias("x"))
        second = F.struct(u["id"].alias("id"), u["size"].alias("size"), y.alias("x"))
        whole = (x < EPS) | (x > 1 - EPS)
        both = whole & ((y < EPS) | (y > 1 - EPS))
        met = F.struct(
            F.when(both, F.lit(None).cast(UNIT)).when(whole, second).otherwise(first).alias("open"),
            F.concat(acc["done"], F.when(both, F.array(first, second)).when(whole, F.array(first)).otherwise(F.array(second))).alias("done"))
        return F.when(o.isNull(), F.struct(u.alias("open"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(units, start, meet)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0, seed: int = 20240, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Null texts and texts without words have size 0 and take 0 words (0 copies); a null source is a source of its own;
    a null doc_id and repeated rows are documents like others. Empty tables give no rows. Other columns are not read.
    Runs on the same rows agree: ties between equal (size, hash) rows fall between interchangeable documents.
    """
    d = docs.select("doc_id", "source", sizes(docs).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.length("text")).alias("_h"))
    d = staged(d, "mix")
    totals = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    goal = staged(targets(totals, weights, limit), "mix")
    n = goal.agg(F.max("_n")).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("_s"))
    # One row per source: a shuffle-free join while their number is small, which adaptive execution decides by size.
    d = d.join(goal.withColumnRenamed("source", "_s"), same, "left").drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    d = d.withColumn("_rate", rate).withColumn("_whole", F.floor(F.col("_rate") + EPS)).withColumn("_x", F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0)))
    open_ = (F.col("size") > 0) & (F.col("_x") > EPS)
    level = d.filter(open_).select("source", F.ceil(F.col("_n") / block).alias("_blocks"), F.struct(F.col("_h").alias("id"), F.col("size").cast("double").alias("size"), F.col("_x").alias("x")).alias("unit"))
    decided = None
    depth = 0
    while True:
        depth += 1
        last = n <= block
        at = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(depth), "unit.id"), F.col("_blocks"))
        folded = staged(
            level.groupBy("source", at.alias("_at")).agg(F.max("_blocks").alias("_blocks"), _fold(F.sort_array(F.collect_list(F.struct(F.col("unit.size").alias("s"), F.col("unit.id").alias("i"), "unit"))).getField("unit"), seed + depth).alias("f")), "mix")
        done = folded.select("source", F.explode("f.done").alias("u")).select("source", "u.*")
        decided = done if decided is None else decided.unionByName(done)
        level = folded.filter("f.open is not null").select("source", F.ceil(F.col("_blocks") / block).alias("_blocks"), F.col("f.open").alias("unit"))
        if last:
            break
        n = -(-n // block)
    # The one document of a source that is left is rounded by a draw of its own.
    final = level.select("source", "unit.*").withColumn("x", F.when(F.pmod(F.xxhash64(F.lit(-seed), "id"), F.lit(1 << 30)) / float(1 << 30) < F.col("x"), 1.0).otherwise(0.0))
    up = decided.unionByName(final).filter("x > 0.5").groupBy(F.col("source").alias("_s"), F.col("id").alias("_id"), F.col("size").cast("long").alias("_size")).agg(F.count(F.lit(1)).alias("_up"))
    # Repeated rows share an id: the first _up of them, in any order, are the ones rounded up.
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_h", "size").orderBy("doc_id")))
    d = d.join(up, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_id")) & (F.col("size") == F.col("_size")), "left")
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.when(F.col("_rank") <= F.coalesce(F.col("_up"), F.lit(0)), 1).otherwise(0)).otherwise(0)
    return d.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with all its columns.

    Rows that repeat an id, source and size share their copies evenly.
    """
    keys = ["doc_id", "source", "size"]
    m = mix(docs, **options).groupBy(*keys).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).filter("_all > 0")
    m = m.toDF("_id", "_source", "_size", "_all", "_rows")
    d = docs.withColumn("_words", sizes(docs))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    d = d.join(m, same)
    rank = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("_rows"))
    d = d.withColumn("_copies", F.when(F.col("_rows") == 1, F.col("_all")).otherwise(F.floor(F.col("_all") / F.col("_rows")) + (rank <= F.col("_all") % F.col("_rows")).cast("int")).cast("int"))
    return d.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
