"""Order-dependent work on large tables: positions, range chunks, carries and prefix sums.

A window over one key would send all rows of a hot key through one task. Here the
order column is cut into chunks of about equal row count; windows run inside (key, chunk), and what crosses a chunk border
travels as a small table with one row per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .columns import col, is_date
from .ranges import RANGE, Running, running, with_range

CHUNK_ROWS = 1_000_000
POS = "_pos"
CHUNK = "_chunk"


def with_position(df: DataFrame, order: str | None = None, name: str = POS) -> DataFrame:
    """Row order: the caller's order column, else the reading order (file order in a scan)."""
    return df.withColumn(name, col(order) if order else F.monotonically_increasing_id())


def with_dense_position(df: DataFrame, name: str = POS) -> DataFrame:
    """0-based dense row positions in reading order.

    Rows are numbered inside their partition by the id function; the partition
    sizes (one row per partition) give the offsets.
    """
    d = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = {}
    total = 0
    for r in sorted(sizes.collect(), key=lambda r: r["_part"]):
        offsets[r["_part"]] = total
        total += r["_n"]
    spark = df.sparkSession
    table = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "_part long, _off long")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        d.withColumn("_part", part)
        .join(F.broadcast(table), "_part")  # one row per input partition
        .withColumn(name, F.col("_off") + within)
        .drop("_part", "_off", "_id")
    )


def order_number(df: DataFrame, name: str) -> Column:
    """The order column as a number that keeps its order."""
    dtype = df.schema[name].dataType
    if is_date(dtype):
        return F.unix_micros(col(name).cast("timestamp"))
    if isinstance(dtype, T.NumericType):
        return col(name)
    raise ValueError(f"order column {name!r} must be a number or a date")


def with_chunk(df: DataFrame, order: str, chunk_rows: int = CHUNK_ROWS, name: str = CHUNK) -> DataFrame:
    """Add a chunk number that grows with the order column; as many chunks as the rows need.

    A table of several chunks is dealt by ranges of the order column and written, so that its chunks are fixed.
    """
    chunks = max(1, -(-df.count() // chunk_rows))
    if chunks == 1:
        return df.withColumn(name, F.lit(0))
    dealt = with_range(df.withColumn("_order_number", order_number(df, order)), ["_order_number"], chunks)
    return dealt.drop("_order_number").withColumnRenamed(RANGE, name)


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    keys: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Last non-null value in order, per key if given; leading nulls stay. `order` must be unique."""
    d = with_chunk(df, order, chunk_rows)
    group = [*keys, CHUNK]
    inside = Window.partitionBy(*map(col, group)).orderBy(col(order)).rowsBetween(Window.unboundedPreceding, 0)
    tails = d.groupBy(*map(col, group)).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), col(order))).alias(f"_t{i}") for i, c in enumerate(columns)]
    )
    before = Window.partitionBy(*map(col, keys)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(group)],
        *[F.last(f"_t{i}", True).over(before).alias(f"_c{i}") for i in range(len(columns))],
    )
    for c in columns:
        d = d.withColumn(f"_f_{c}", F.last(col(c), ignorenulls=True).over(inside))
    on = None
    for i, k in enumerate(group):
        cond = col(k).eqNullSafe(F.col(f"_k{i}"))
        on = cond if on is None else on & cond
    if not keys:
        carry = F.broadcast(carry)  # a row per chunk of `chunk_rows` rows
    joined = d.join(carry, on, "left")
    return joined.select(
        [F.coalesce(F.col(f"`_f_{c}`"), F.col(f"_c{columns.index(c)}")).alias(c) if c in columns else col(c)
         for c in df.columns]
    )


def with_previous(
    df: DataFrame,
    value: Column,
    order: str,
    count: int,
    keys: Sequence[str] = (),
    name: str = "_prev",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Array of up to `count` values before each row in order (oldest first), per key if given.

    The last `count` rows of every chunk are handed to the next chunk of the key.
    """
    d = with_chunk(df.withColumn("_v", value), order, chunk_rows)
    group = [*keys, CHUNK]
    tails = d.select(*map(col, group), col(order).alias("_o"), "_v")
    back = Window.partitionBy(*map(col, group)).orderBy(F.desc("_o"))
    tails = tails.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= count)
    per_key = Window.partitionBy(*map(col, keys)).orderBy(CHUNK, "_o").rowsBetween(-count, -1)
    first = Window.partitionBy(*map(col, group)).orderBy("_o")
    halo = (
        tails.withColumn("_halo", F.collect_list("_v").over(per_key))
        .withColumn("_first", F.row_number().over(first))
        .filter(F.col("_first") == 1)
        .select(*[col(k).alias(f"_k{i}") for i, k in enumerate(group)], "_halo")
    )
    on = None
    for i, k in enumerate(group):
        cond = col(k).eqNullSafe(F.col(f"_k{i}"))
        on = cond if on is None else on & cond
    if not keys:
        halo = F.broadcast(halo)  # a row of `count` values per chunk of `chunk_rows` rows
    inside = Window.partitionBy(*map(col, group)).orderBy(col(order)).rowsBetween(-count, -1)
    joined = d.withColumn("_in", F.collect_list("_v").over(inside)).join(halo, on, "left")
    both = F.concat(F.coalesce("_halo", F.array().cast("array<double>")), "_in")
    short = F.greatest(F.size(both) - count, F.lit(0)) + 1
    return joined.withColumn(name, F.slice(both, short, count)).select(*map(col, df.columns), name)


def prefix_sums(counts: DataFrame, value: str, n: str, ranges: int | None = None) -> DataFrame:
    """Add `_below`: sum of `n` over all smaller values. One row per value expected."""
    d = running(counts, [], value, {"_below": Running(col(n))}, ranges)
    return d.withColumn("_below", F.col("_below") - col(n))
