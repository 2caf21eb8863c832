"""CSV records from files that stay split over tasks.

A quote opens a quoted field only at the start of a field; elsewhere it is a character like any
other. Whether a line starts a record therefore depends on all lines before it, but only through
one bit: whether they end inside quotes. Each block of a file yields a transition map, that is
for both bits where it ends and how many records start in it. The maps are composed over the
blocks of a file, of which there are few, and with its own first bit each block is read alone.
The pieces of records that lie on both sides of a border are put together afterwards.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from viario.operators.small import join_groups
from viario.storage import materialise

# The code travels with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOO_MANY, NOT_CLOSED = "too many fields", "quote not closed"
BROADCAST_BLOCKS = 500_000   # blocks whose first bits are sent to every task
HEAD = 1000                  # characters of a record without end that its rejection shows
_BLOCK = ["__file", "__start"]
_AFTER_RETURN = re.compile("(?<=\r)(?!$)")


def ends_inside(line: str, inside: bool, separator: str) -> bool:
    """Whether a line that begins inside quotes or not ends inside quotes."""
    if '"' not in line:
        return inside
    for piece in line.replace("\r", separator).split(separator):
        if inside:
            inside = '"' not in piece.replace('""', "")
        else:
            inside = piece[:1] == '"' and '"' not in piece[1:].replace('""', "")
    return inside


def _lines(values: list[bytes], charset: str) -> Iterator[str]:
    """Lines with their ends; outside quotes a lone carriage return ends a line, too."""
    for value in values:
        text = value.decode(charset, "replace")
        if "\r" in text:
            *first, text = _AFTER_RETURN.split(text)
            yield from first
        yield text + "\n"


def _blank(line: str) -> bool:
    return not line.strip(" \t\r\n")


def split_record(text: str, separator: str) -> list[str]:
    """The fields of one whole record."""
    if '"' not in text:
        return text.rstrip("\r\n").split(separator)
    return next(csv.reader(re.findall("[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text), delimiter=separator))


def _scan(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))


def _transitions(lines: DataFrame, charset: str, separator: str) -> DataFrame:
    """For each block: from outside and from inside quotes, whether it ends inside and how many records start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_BLOCK, "out_ends", "out_starts", "in_ends", "in_starts"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        block, ends, starts = None, [False, True], [0, 0]

        def out() -> pa.RecordBatch:
            row = [*block, ends[0], starts[0], ends[1], starts[1]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for a, b, key in _runs(batch.column("__file").to_pylist(), batch.column("__start").to_pylist()):
                if key != block:
                    if block:
                        yield out()
                    block, ends, starts = key, [False, True], [0, 0]
                for line in _lines(batch.column("value").slice(a, b - a).to_pylist(), charset):
                    for i in (0, 1):
                        if not ends[i]:
                            starts[i] += not _blank(line)
                        ends[i] = ends_inside(line, ends[i], separator)
        if block:
            yield out()

    schema = "__file string, __start long, out_ends boolean, out_starts long, in_ends boolean, in_starts long"
    return lines.mapInArrow(run, schema)


def _runs(*columns: list) -> Iterator[tuple[int, int, tuple]]:
    """(from, to, values) of runs of rows with equal values."""
    a, rows = 0, list(zip(*columns))
    for b in range(1, len(rows) + 1):
        if b == len(rows) or rows[b] != rows[a]:
            yield a, b, rows[a]
            a = b


def compose(blocks: DataFrame) -> DataFrame:
    """Add to the maps of blocks whether each `begins` inside quotes and the number of records that start `before`.

    The bit before a block is that of the last block whose map is constant, turned over once
    for each block since that swaps the bits; without such a block a file begins outside."""
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("out_ends") == F.col("in_ends")
    swaps = F.sum((F.col("out_ends") & ~F.col("in_ends")).cast("int")).over(upto)
    turned = blocks.withColumns({"swaps": swaps, "fixed": fixed})
    last = F.last(F.when(F.col("fixed"), F.struct("out_ends", "swaps")), ignorenulls=True).over(earlier)
    passed = F.coalesce(F.lag("swaps").over(Window.partitionBy("__file").orderBy("__start")), F.lit(0))
    begins = F.coalesce(last["out_ends"].cast("int") + passed - last["swaps"], passed) % 2 == 1
    placed = turned.withColumn("begins", begins)
    starts = F.when(F.col("begins"), F.col("in_starts")).otherwise(F.col("out_starts"))
    return placed.withColumns({
        "ends": F.when(F.col("begins"), F.col("in_ends")).otherwise(F.col("out_ends")),
        "before": F.coalesce(F.sum(starts).over(earlier), F.lit(0)), "total": F.sum(starts).over(upto),
    }).select(*_BLOCK, "begins", "before", "ends", "total")


_OUT = "__block long, __index long, fields array<string>, reason string, text string"


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_NAMES = ["__block", "__index", "fields", "reason", "text"]
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]


def _judged(block: int, index: int, text: str, width: int, separator: str) -> tuple:
    fields = split_record(text, separator)
    return (block, index, None, TOO_MANY, text.rstrip("\r\n")) if len(fields) > width else (block, index, fields, None, None)


def _read_blocks(lines: DataFrame, charset: str, separator: str, width: int) -> DataFrame:
    """Lines (value, __block, begins) to records, by their number in the block; pieces of records have only a text.

    The piece of a record that started earlier has the index -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        block, index, inside, head, held, out = None, -1, False, False, [], []

        def close() -> None:
            if held:
                out.append((block, index, None, None, "".join(held)))
                held.clear()

        for batch in batches:
            for a, b, (key, begins) in _runs(batch.column("__block").to_pylist(), batch.column("begins").to_pylist()):
                if key != block:
                    close()
                    block, index, inside, head = key, -1, begins, begins
                for line in _lines(batch.column("value").slice(a, b - a).to_pylist(), charset):
                    if not held and not head:
                        if _blank(line):
                            continue
                        index += 1
                    held.append(line)
                    inside = ends_inside(line, inside, separator)
                    if inside:
                        continue
                    if head:
                        close()
                        head = False
                    else:
                        out.append(_judged(block, index, "".join(held), width, separator))
                        held.clear()
                    if len(out) >= 10_000:
                        yield _batch(out, _KINDS, _NAMES)
                        out.clear()
        close()
        if out:
            yield _batch(out, _KINDS, _NAMES)

    return lines.mapInArrow(run, _OUT)


def _read_whole(texts: DataFrame, separator: str, width: int) -> DataFrame:
    """Records (__block, __index, text) that were put together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            out = [_judged(block, index, text, width, separator) for block, index, text in rows]
            if out:
                yield _batch(out, _KINDS, _NAMES)

    return texts.select("__block", "__index", "text").mapInArrow(run, _OUT)


def _with_quotes(
    spark: SparkSession, path: str, charset: str, separator: str, width: int, broadcast_blocks: int,
) -> tuple[DataFrame, DataFrame]:
    """The records, and the number of records of each file."""
    lines = _scan(spark, path, lineSep="\n").withColumn("value", F.col("value").cast("binary"))
    blocks = compose(_transitions(lines, charset, separator)).withColumn("__block", F.monotonically_increasing_id())
    blocks = materialise(blocks, "csv-blocks")
    begins = blocks.select(*_BLOCK, "__block", "begins")
    if blocks.count() <= broadcast_blocks:
        placed = lines.join(F.broadcast(begins), _BLOCK)
    else:
        ordered = lines.withColumn("__at", F.monotonically_increasing_id()).join(begins, _BLOCK)
        placed = ordered.repartition("__block").sortWithinPartitions("__block", "__at")
    found = _read_blocks(placed.select("value", "__block", "begins"), charset, separator, width)
    found = materialise(found, "csv-records").join(blocks.select("__block", "__file", "__start", "before"), "__block")
    found = found.withColumn("__record", F.col("before") + F.col("__index"))
    whole = F.col("fields").isNotNull() | F.col("reason").isNotNull()
    # A file that ends inside quotes has a last record without end.
    last = Window.partitionBy("__file").orderBy(F.desc("__start"))
    endless = blocks.withColumn("n", F.row_number().over(last)).where("n = 1 AND ends").select(
        "__file", (F.col("total") - 1).alias("__record"), F.lit(True).alias("endless"))
    pieces = found.where(~whole).join(endless, ["__file", "__record"], "left")
    joined = pieces.where("endless IS NULL").groupBy("__file", "__record").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("__start", "text"))), lambda s: s["text"]), "").alias("text"))
    names = joined.select(F.xxhash64("__file").alias("__block"), F.col("__record").alias("__index"), "text")
    files = blocks.select(F.xxhash64("__file").alias("__block"), "__file").distinct()
    columns = ["__file", "__record", "fields", "reason", "text"]
    stitched = _read_whole(names, separator, width).join(files, "__block").withColumnRenamed("__index", "__record")
    cut = pieces.where("endless").select("__file", "__record", "__start", F.left("text", F.lit(HEAD)).alias("text"))
    cut = cut.groupBy("__file", "__record").agg(F.min_by("text", "__start").alias("text")).select(
        "__file", "__record", F.lit(None).cast("array<string>").alias("fields"), F.lit(NOT_CLOSED).alias("reason"), "text")
    records = found.where(whole).select(columns).unionByName(stitched.select(columns)).unionByName(cut)
    return records, blocks.groupBy("__file").agg(F.max("total").alias("n"))


def _quote_free(lines: DataFrame, blocks: DataFrame, charset: str, separator: str, width: int, broadcast_blocks: int) -> DataFrame:
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*_BLOCK, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = lines.join(F.broadcast(before) if blocks.count() <= broadcast_blocks else before, _BLOCK)
    text: Column = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    fields = F.split(text, re.escape(separator), -1)
    rows = placed.select("__file", (F.col("before") + F.col("__at") - F.col("first")).alias("__record"), text.alias("text"), fields.alias("fields"))
    surplus = F.size("fields") > width
    return rows.select(
        "__file", "__record", F.when(~surplus, F.col("fields")).alias("fields"),
        F.when(surplus, F.lit(TOO_MANY)).alias("reason"), F.when(surplus, F.col("text")).alias("text"))


def read_records(spark: SparkSession, path: str, charset: str, separator: str, width: int,
                 broadcast_blocks: int = BROADCAST_BLOCKS, over_files: bool = False) -> DataFrame:
    """__file, __record, fields, reason, text: the records of each file, numbered from 0, the header.

    With `over_files` the records after the header are numbered on from file to file, by name.
    Blank lines are no records. A record with more than `width` fields has no fields but a
    reason and its text, and so has a last record whose quote is never closed, with the start of
    its text. Files without any quote are read line by line in columns."""
    lines = _scan(spark, path).where(F.btrim("value", F.lit(" \t")) != "").withColumn("__at", F.monotonically_increasing_id())
    blocks = materialise(lines.groupBy(*_BLOCK).agg(
        F.count("*").alias("n"), F.min("__at").alias("first"), F.bool_or(F.contains("value", F.lit('"'))).alias("quoted")), "csv-lines")
    if blocks.where("quoted").isEmpty():
        records = _quote_free(lines, blocks, charset, separator, width, broadcast_blocks)
        counts = blocks.groupBy("__file").agg(F.sum("n").alias("n"))
    else:
        records, counts = _with_quotes(spark, path, charset, separator, width, broadcast_blocks)
    return _over_files(records, counts) if over_files else records


def _over_files(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Add to the numbers the records of earlier files without their headers. There is one row per file to add up."""
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__file", F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(earlier), F.lit(0)).alias("__earlier"))
    number = F.when(F.col("__record") > 0, F.col("__record") + F.col("__earlier")).otherwise(F.col("__record"))
    return join_groups(records, starts, ["__file"], "inner").withColumn("__record", number).drop("__earlier")
