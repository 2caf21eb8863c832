"""Joining a table of facts with a table of one row per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from viario.storage import materialise

BROADCAST_ROWS = 200_000  # rows of figures that are sent to every task
SALTS = 64                # parts of a hot group when there are more
HOT_ROWS = 100_000        # facts from which a group is hot


def join_groups(
    df: DataFrame, figures: DataFrame, keys: list[str], how: str = "left",
    broadcast_rows: int | None = None, salts: int = SALTS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join with figures that have one row per group, without moving a hot group to one task.

    The figures are written once and counted. Up to `broadcast_rows` they go to all tasks and
    the facts stay where they are; beyond, facts and figures are shuffled by group. Only then
    the facts are counted, and groups of `hot_rows` or more are spread by group and salt.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    table = materialise(figures, "figures")
    if table.count() <= limit:
        return df.join(F.broadcast(table), keys, how)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    sizes = df.where(~missing).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # One of `hot_rows` facts at most is a hot group.
    hot = F.broadcast(materialise(
        sizes.where(F.col("__n") >= hot_rows).select(*keys, F.lit(True).alias("__hot")), "hot-groups"))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")
    own = df.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot") | missing, part).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = table.join(hot, keys, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    # The size of the files says little about the rows: the figures are never to be sent whole.
    return own.join(salted.hint("merge"), [*keys, "__salt"], how).drop("__salt")
