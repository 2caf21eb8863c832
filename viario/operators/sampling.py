"""Exact-size random samples that are the same on every run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from viario.schema import row_hash

BUCKET_ROWS = 500_000  # rows that are sorted together to settle the border of a sample


Quota = Callable[[Column], Column]
_SIGN = -(1 << 63)


def _from_whole_groups(df: DataFrame, keys: list[str], quota: Quota, rank: Column) -> DataFrame:
    group = Window.partitionBy(*keys)
    unsigned = F.col("__rank").bitwiseXOR(F.lit(_SIGN))  # as the buckets order it
    place = F.row_number().over(group.orderBy(unsigned, *df.columns))
    ranked = df.withColumn("__rank", rank).withColumns(
        {"__size": F.count(F.lit(1)).over(group), "__place": place}
    )
    return ranked.where(F.col("__place") <= quota(F.col("__size"))).select(*df.columns)


def _from_buckets(
    df: DataFrame, keys: list[str], quota: Quota, rank: Column, bits: int
) -> DataFrame:
    """The ranks are spread evenly over 64 bits. Their leading bits cut a group into
    buckets; whole buckets are taken while they fit, and only the bucket at the border
    is sorted, so a large group is never sorted as one."""
    ranked = df.withColumn("__rank", rank).withColumn(
        "__bucket", F.shiftrightunsigned("__rank", 64 - bits)
    )
    counts = ranked.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    so_far = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    taken = (
        counts.withColumns({
            "__before": F.coalesce(F.sum("__n").over(so_far), F.lit(0)),
            "__size": F.sum("__n").over(Window.partitionBy(*keys)),
        })
        .withColumn("__left", quota(F.col("__size")) - F.col("__before")).where(F.col("__left") > 0)
        .select(*keys, "__bucket", "__left", "__n")
    )
    chosen = ranked.join(taken, [*keys, "__bucket"])
    fits = F.col("__n") <= F.col("__left")
    place = F.row_number().over(
        Window.partitionBy(*keys, "__bucket").orderBy("__rank", *df.columns)
    )
    border = chosen.where(~fits).withColumn("__place", place).where(
        F.col("__place") <= F.col("__left")
    )
    return chosen.where(fits).select(*df.columns).unionByName(border.select(*df.columns))


def sample_by_group(
    df: DataFrame, keys: list[str], quota: Quota, seed: int = 42,
    row_id: list[str] | None = None, rows: int | None = None, bucket_rows: int = BUCKET_ROWS,
    rank: Column | None = None,
) -> DataFrame:
    """Per group as many rows as `quota` gives for the group size.

    Those with the smallest `rank` are taken, a number spread over all 64 bits and compared
    without sign; by default a hash of the row. The size of the table decides how they are
    found, not which they are. Rows without a key are in no group."""
    grouped = df.dropna(subset=keys)
    rows = df.count() if rows is None else rows
    bits = (rows // bucket_rows).bit_length()
    rank = row_hash(df, row_id, seed) if rank is None else rank
    if bits == 0:
        return _from_whole_groups(grouped, keys, quota, rank)
    return _from_buckets(grouped, keys, quota, rank, bits)


def sample_rows(
    df: DataFrame, n: int, seed: int = 42, row_id: list[str] | None = None, **options
) -> DataFrame:
    """n rows, or all when there are no more."""
    rows = df.count()
    if rows <= n:
        return df
    whole = df.withColumn("__all", F.lit(0))
    return sample_by_group(
        whole, ["__all"], lambda size: F.lit(n), seed, row_id or df.columns, rows, **options
    ).drop("__all")


def sample_stratified(
    df: DataFrame, max_rows: int, seed: int = 42, row_id: list[str] | None = None, **options
) -> DataFrame:
    """About max_rows rows, shared out over communes (else corridors) by size, at least ten
    each where there are so many; 0 keeps everything."""
    if max_rows <= 0:
        return df
    rows = df.count()
    if rows <= max_rows:
        return df
    key = next((c for c in ("nombre_comuna", "corredor") if c in df.columns), None)
    if key is None:
        return sample_rows(df, max_rows, seed, row_id, **options)

    def quota(size: Column) -> Column:
        return F.greatest(F.lit(10), F.floor(F.lit(max_rows) * size / F.lit(rows)))

    return sample_by_group(df, [key], quota, seed, row_id, rows, **options)
