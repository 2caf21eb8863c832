"""Positions and windows over an order, without one group ever filling one task.

A window partitioned by corridor puts all rows of a corridor into one task. Where the
largest group is small that is the cheapest plan. Beyond a given size the table is sorted
by ranges, numbered, and cut into blocks of equal length; each block also receives the
few rows around it that its windows look at, so that the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from viario.storage import materialise

GROUP_ROWS = 2_000_000   # a group up to here fits one window task
BLOCK_ROWS = 500_000     # rows per block beyond that
CHUNK_ROWS = 2_000_000   # rows per range when a table is sorted

# monotonically_increasing_id() keeps the partition above this bit and the row below it.
_ROW_BITS = 33


@dataclass(frozen=True)
class Series:
    """Windows over one series: all its rows, and the rows in order. Both have the same
    order, so that they share one sort."""

    rows: WindowSpec
    ordered: WindowSpec

    @classmethod
    def over(cls, partition: list[Column | str], order: list[str]) -> Series:
        ordered = Window.partitionBy(*partition).orderBy(*order)
        return cls(
            ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), ordered
        )


def _in_ranges(df: DataFrame, order: list[Column | str], rows: int | None) -> DataFrame:
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // CHUNK_ROWS))
    placed = (
        df.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    return materialise(placed, "ranges").withColumn("__chunk", F.shiftright("__at", _ROW_BITS))


def _with_starts(placed: DataFrame, weight: Column) -> DataFrame:
    """Add __start, the weight of all earlier ranges. The table of ranges is one row per
    range (rows / CHUNK_ROWS), small enough for one task and for a broadcast."""
    per_chunk = placed.groupBy("__chunk").agg(F.sum(weight).alias("__w"))
    earlier = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select(
        "__chunk", F.coalesce(F.sum("__w").over(earlier), F.lit(0).cast("bigint")).alias("__start")
    )
    return placed.join(F.broadcast(starts), "__chunk")


def number_rows(
    df: DataFrame, order: list[Column | str], name: str = "row_index", rows: int | None = None
) -> DataFrame:
    """Dense position from 0 in a total order over the whole table."""
    numbered = _with_starts(_in_ranges(df, order, rows), F.lit(1).cast("bigint"))
    offset = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return numbered.withColumn(name, F.col("__start") + offset).drop("__at", "__chunk", "__start")


def weight_before(
    df: DataFrame, order: list[Column | str], weight: str, name: str = "before"
) -> DataFrame:
    """Sum of a weight over all rows that come earlier in a total order."""
    placed = _with_starts(_in_ranges(df, order, None), F.col(weight))
    earlier = (
        Window.partitionBy("__chunk").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0).cast("bigint"))
    return placed.withColumn(name, F.col("__start") + inside).drop("__at", "__chunk", "__start")


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group, not counting rows without a key, and of the whole table."""
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    sizes = df.groupBy(*keys).count().agg(
        F.max(F.when(keyed, F.col("count"))), F.sum("count")
    ).first()
    return sizes[0] or 0, sizes[1] or 0


def over_series(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    compute: Callable[[Series], dict[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    carry: str | None = None,
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns per series.

    `compute` may look `before` rows back and `after` rows ahead, and for the column
    `carry` also at its last value however far back. Rows without a key are their own
    series each; `compute` has to mask them.
    """
    largest, total = group_sizes(df, keys)
    if largest <= group_rows:
        unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        alone = F.when(unkeyed, F.xxhash64(*order))
        return df.withColumns(compute(Series.over([*keys, alone], order)))

    if block_rows <= max(before, after):
        raise ValueError("a block must be longer than the rows its windows look at")
    numbered = number_rows(df, [*keys, *order], "__g", total)
    block = F.floor(F.col("__g") / F.lit(block_rows)).cast("bigint")
    inside = F.col("__g") % block_rows
    reaches = F.array_compact(F.array(
        block,
        F.when(inside >= block_rows - before, block + 1),
        F.when((inside < after) & (block > 0), block - 1),
    ))
    blocks = (
        numbered.withColumn("__block", F.explode(reaches))
        .withColumn("__own", F.col("__block") == block)
    )
    if carry is not None:
        blocks = blocks.unionByName(
            _carried(numbered, keys, carry, block, block_rows, before), allowMissingColumns=True
        )
    return (
        blocks.withColumns(compute(Series.over(["__block", *keys], ["__g"])))
        .where("__own").drop("__g", "__block", "__own")
    )


def _carried(numbered, keys, carry, block, block_rows, before) -> DataFrame:
    """One extra row in front of a block whose series has its last value of `carry` further
    back than the block can see. At most one row per block."""
    keyed = numbered.dropna(subset=keys).withColumn("__block", block)
    lasts = (
        keyed.where(F.col(carry).isNotNull()).groupBy(*keys, "__block")
        .agg(F.max(F.struct(F.col("__g").alias("g"), F.col(carry).alias("v"))).alias("last"))
        .withColumn("first", F.lit(False))
    )
    firsts = (
        keyed.where(F.col("__g") == F.col("__block") * block_rows)
        .select(*keys, "__block", F.lit(None).cast(lasts.schema["last"].dataType).alias("last"),
                F.lit(True).alias("first"))
    )
    so_far = (
        Window.partitionBy(*keys).orderBy("__block", F.desc("first"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = F.col("__block") * block_rows - before
    return (
        lasts.unionByName(firsts).withColumn("last", F.last("last", True).over(so_far))
        .where(F.col("first") & (F.col("last.g") < seen))
        .select(*keys, F.col("last.v").alias(carry), (seen - 1).alias("__g"), "__block",
                F.lit(False).alias("__own"))
    )
