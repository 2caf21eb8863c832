"""Best-fit packing of documents into training sequences, under conflicts.

A bin holds at most `capacity` tokens, and never two pieces of one source or of one
duplicate cluster. Each bin carries a bitmap of the sources and one of the clusters in it.
Open bins are kept in the order of their room; the search starts at the first bin with room
enough and goes on to its successors until a compatible bin is found, which is the tightest.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from viario.llm.words import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
BLOCK_ROWS = 4096   # pieces that are packed together; blocks are independent tasks
_BIN = 32           # bits of a bin's number within its block


def fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given. None conflicts with nothing."""
    order: list[int] = []              # room << _BIN | bin, ascending
    fill: list[int] = []
    of_source: list[int] = []          # bitmaps by bin
    of_cluster: list[int] = []
    source_bits: dict = {None: 0}
    cluster_bits: dict = {None: 0}
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        if source not in source_bits:
            source_bits[source] = 1 << len(source_bits)
        if cluster not in cluster_bits:
            cluster_bits[cluster] = 1 << len(cluster_bits)
        s, c = source_bits[source], cluster_bits[cluster]
        at, found = bisect_left(order, length << _BIN), -1
        while at < len(order):
            b = order[at] & ((1 << _BIN) - 1)
            if not of_source[b] & s and not of_cluster[b] & c:
                found = b
                del order[at]
                break
            at += 1
        if found < 0:
            found = len(fill)
            fill.append(0)
            of_source.append(0)
            of_cluster.append(0)
        bins.append(found)
        offsets.append(fill[found])
        fill[found] += length
        of_source[found] |= s
        of_cluster[found] |= c
        insort(order, (capacity - fill[found]) << _BIN | found)
    return bins, offsets


def pack(documents: DataFrame, length: str = "length", source: str = "source", cluster: str = "cluster",
         keep: list[str] | None = None, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The kept columns with piece, start, length, bin_id and offset: where each piece of a document went.

    Documents longer than `capacity` are cut into full pieces and a rest; every token is in
    exactly one piece. A null length counts as 0, and such documents still get a bin. A null
    source or cluster conflicts with nothing. Pieces are dealt by hash into blocks of about
    `block_rows`; rows that are equal in all columns meet in one block, which is cut when it
    grows beyond twice that. In a block the longest come first, ties in the order of the kept
    columns, so that the result does not depend on the order of rows.
    """
    keep = kept(documents.drop(length, source, cluster) if keep is None else documents, keep, length,
                ("piece", "start", "length", "bin_id", "offset"))
    names = [f"__k{i}" for i in range(len(keep))]
    size = F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0))
    rows = documents.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], size.alias("__size"),
        F.col(f"`{source}`").cast("string").alias("__source"), F.col(f"`{cluster}`").cast("string").alias("__cluster"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.greatest(F.col("__size") - 1, F.lit(0)) / capacity)))).select(
        *names, "__source", "__cluster", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("__size") - F.col("piece") * capacity).cast("long").alias("length"))
    last = F.greatest(F.col("__size") - 1, F.lit(0))
    n_pieces = rows.agg(F.sum(F.floor(last / capacity) + 1)).first()[0] or 0
    n_blocks = max(1, -(-n_pieces // block_rows))
    block = F.pmod(F.xxhash64(*names, "__source", "__cluster", "piece"), F.lit(n_blocks))
    dealt = pieces.withColumn("__block", block).repartition("__block").sortWithinPartitions(
        "__block", F.col("length").desc(), *names, "piece", "__source", "__cluster")
    schema = dealt.select(*names, "piece", "start", "length").schema.add("bin_id", "long").add("offset", "long")
    out = [*names, "piece", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, bins_before = None, 0

        def packed() -> pa.RecordBatch:
            nonlocal bins_before
            rows = pa.Table.from_batches(held).combine_chunks()
            bins, offsets = fit(*(rows.column(c).to_pylist() for c in ("length", "__source", "__cluster")), capacity)
            first = (block << _BIN) + bins_before
            bins_before += max(bins) + 1
            made = rows.select(out).append_column("bin_id", pa.array([first + b for b in bins], pa.int64()))
            held.clear()
            return made.append_column("offset", pa.array(offsets, pa.int64())).to_batches()[0]

        for batch in batches:
            blocks, at = batch.column("__block").to_pylist(), 0
            while at < batch.num_rows:
                if blocks[at] != block:
                    if held:
                        yield packed()
                    block, bins_before = blocks[at], 0
                room = 2 * block_rows - sum(b.num_rows for b in held)
                to = at
                while to < batch.num_rows and blocks[to] == block and to - at < room:
                    to += 1
                held.append(batch.slice(at, to - at))
                if to - at == room:
                    yield packed()
                at = to
        if held:
            yield packed()

    return dealt.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], "piece", "start", "length", "bin_id", "offset")


def word_count(text):
    """The words [^\\x20\\x09-\\x0D]+ of a text column; null has none."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(inner, F.lit("")) == "", 0).otherwise(
        F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def copy_cluster(text):
    """One value for texts with the same words, whatever their case and spacing; null without words."""
    inner = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner != "", F.md5(F.regexp_replace(inner, r"[\x20\x09-\x0D]+", " ")))
