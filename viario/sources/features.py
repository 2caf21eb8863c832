"""GeoJSON collections from files that stay split over tasks.

The text is cut after every closing brace, so a collection on one line is split as well. What a
place means depends on what lies before it in the file: whether it is inside a string, how deep
it is, and whether the open array of the root is the one named features. Each block of a file
yields a transition map, that is for both beginnings (outside and inside a string) where it
ends, by how much the depth changes, how far it falls and which arrays named features it leaves
open. The maps are composed over the blocks of a file, and each block is then read alone. Only
features that lie on both sides of a border are put together afterwards.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from viario.storage import materialise

# The code travels with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_BLOCKS = 500_000   # blocks whose beginnings are sent to every task
CHUNK_BYTES = 4 << 20        # text looked through at once
ROOT, FEATURES = 1, 2        # depth inside the root object and inside its array of features
_BLOCK = ["__file", "__start"]
_ESCAPE = re.compile(rb"\\.", re.S)
_NAMED = re.compile(rb'"features"\s*:\s*\[')
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARK = _STEP != 0
_MARK[ord('"')] = True


class _Marks:
    """Quotes and brackets of a chunk: where they are, which byte, and the openings of arrays named features.

    No escape lies on both sides of a border, since a backslash is never followed by a brace."""

    def __init__(self, chunk: bytes):
        plain = _ESCAPE.sub(b"  ", chunk)
        codes = np.frombuffer(plain, np.uint8)
        self.at = np.flatnonzero(_MARK[codes])
        self.code = codes[self.at]
        self.quotes = np.cumsum(self.code == ord('"'))
        self.named = np.searchsorted(self.at, [m.end() - 1 for m in _NAMED.finditer(plain)])

    def steps(self, inside: int) -> np.ndarray:
        """Change of the depth at each mark when the chunk begins inside a string or not."""
        return np.where((self.quotes + inside) & 1, 0, _STEP[self.code]).astype(np.int64)

    def ends_inside(self, inside: int) -> int:
        return (int(self.quotes[-1]) if len(self.quotes) else 0) + inside & 1


def _runs(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows with equal values."""
    rows = len(columns[0])
    changes = reduce(pc.or_, [pc.not_equal(c.slice(1), c.slice(0, rows - 1)) for c in columns])
    ends = [*(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), rows]
    return zip([0, *ends[:-1]], ends)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """(what the columns after the text hold, some bytes of text) in the order of the rows."""
    key, held, size = None, [], 0
    for batch in batches:
        texts, *others = batch.columns
        for a, b in _runs(others) if len(texts) else []:
            own = tuple(c[a].as_py() for c in others)
            if held and (own != key or size >= CHUNK_BYTES):
                yield key, b"".join(held)
                held, size = [], 0
            run = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), texts.slice(a, b - a))
            key, text = own, pc.binary_join(run, b"}")[0].as_py()
            held += [text, b"}"]
            size += len(text) + 1
    if held:
        yield key, b"".join(held)


class _Map:
    """The transition map of a block for one of its two beginnings."""

    def __init__(self, inside: int):
        self.inside, self.depth, self.low, self.open = inside, 0, 0, []

    def follow(self, marks: _Marks) -> None:
        steps = marks.steps(self.inside)
        self.inside = marks.ends_inside(self.inside)
        if not len(steps):
            return
        depth = self.depth + np.cumsum(steps)
        lowest_from = np.minimum.accumulate(depth[::-1])[::-1]
        self.low = min(self.low, int(lowest_from[0]))
        self.open = [d for d in self.open if d < lowest_from[0]]
        for i in marks.named:
            if steps[i] == 1 and lowest_from[i] >= depth[i]:
                self.open.append(int(depth[i]) - 1)
        self.depth = int(depth[-1])


_MAP = "struct<inside:boolean,depth:bigint,low:bigint,open:array<bigint>>"


def _transitions(pieces: DataFrame) -> DataFrame:
    """For each block the map of a beginning outside a string and of one inside."""
    schema = f"__file string, __start long, outside {_MAP}, within {_MAP}"
    kind = pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("low", pa.int64()), ("open", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, maps: list[_Map]) -> pa.RecordBatch:
            made = [{"inside": bool(m.inside), "depth": m.depth, "low": m.low, "open": m.open} for m in maps]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), *[pa.array([m], kind) for m in made]],
                [*_BLOCK, "outside", "within"])

        block, maps = None, []
        for key, chunk in _chunks(batches):
            if key != block:
                if block:
                    yield out(block, maps)
                block, maps = key, [_Map(0), _Map(1)]
            marks = _Marks(chunk)
            for m in maps:
                m.follow(marks)
        if block:
            yield out(block, maps)

    return pieces.mapInArrow(run, schema)


def compose(blocks: DataFrame) -> DataFrame:
    """How each block begins: `inside` a string, at which `depth`, and whether `listed`, in the array of features."""
    order = Window.partitionBy("__file").orderBy("__start")
    earlier, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    # A quote always turns the bit, whichever it is.
    turns = F.sum(F.col("outside.inside").cast("int")).over(earlier)
    placed = blocks.withColumn("inside", F.coalesce(turns, F.lit(0)) % 2 == 1)
    placed = placed.withColumn("own", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    placed = placed.withColumn("depth", F.sum("own.depth").over(upto) - F.col("own.depth"))
    opened = F.array_contains(F.col("own.open"), ROOT - F.col("depth"))
    closed = F.col("depth") + F.col("own.low") <= ROOT
    placed = placed.withColumn("turn", F.when(opened, True).when(closed, False))
    listed = F.coalesce(F.last("turn", ignorenulls=True).over(earlier), F.lit(False))
    return placed.withColumn("listed", listed).select(*_BLOCK, "inside", "depth", "listed")


def _read_blocks(pieces: DataFrame) -> DataFrame:
    """Texts (value, __block, inside, depth, listed) to features by their number in the block.

    A part of a feature that began in an earlier block has the number -1; `closes` tells whether the feature ends in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.bool_(), pa.binary()])],
                ["__block", "__index", "closes", "text"])
            rows.clear()
            return made

        block, index, now, inside, depth, listed, held = None, -1, -1, 0, 0, False, None
        for (key, *begin), chunk in _chunks(batches):
            if key != block:
                if held:
                    rows.append((block, now, False, b"".join(held)))
                block, index, (inside, depth, listed) = key, -1, begin
                now, held = -1, [] if listed and depth > FEATURES else None
            marks = _Marks(chunk)
            steps = marks.steps(inside)
            inside = marks.ends_inside(inside)
            deep = depth + np.cumsum(steps)
            # whether the array of features is open after each mark: as its last opening or closing left it
            turns = np.zeros(len(steps), np.int8)
            turns[(steps == -1) & (deep <= ROOT)] = -1
            named = marks.named[(steps[marks.named] == 1) & (deep[marks.named] == FEATURES)]
            turns[named] = 1
            last = np.maximum.accumulate(np.where(turns != 0, np.arange(1, len(steps) + 1), 0))
            open_ = np.where(last > 0, turns[last - 1] == 1, listed) if len(steps) else np.zeros(0, bool)
            starts = open_ & (marks.code == ord("{")) & (steps == 1) & (deep == FEATURES + 1)
            ends = open_ & (marks.code == ord("}")) & (steps == -1) & (deep == FEATURES)
            a = 0
            for i in np.flatnonzero(starts | ends).tolist():
                place = int(marks.at[i])
                if starts[i]:
                    index += 1
                    now, held, a = index, [], place
                elif held is not None:
                    held.append(chunk[a:place + 1])
                    rows.append((block, now, True, b"".join(held)))
                    held = None
            if held is not None:
                held.append(chunk[a:])
            if len(steps):
                depth, listed = int(deep[-1]), bool(open_[-1])
            if sum(len(r[3]) for r in rows) >= CHUNK_BYTES:
                yield out()
        if held:
            rows.append((block, now, False, b"".join(held)))
        if rows:
            yield out()

    return pieces.mapInArrow(run, "__block long, __index long, closes boolean, text binary")


def read_collections(spark: SparkSession, path: str, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """__file, __block, __index and text: the objects in the array `features` of the root object of each file.

    Blocks are numbered in the order of files and places, features in the order of the block in
    which they begin. Objects elsewhere in the root, also in other arrays, are no features. Of a
    file that ends too early the features that are closed come back; an empty file has none.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"))
    # One row per block of the file system, few enough to number.
    number = F.row_number().over(Window.orderBy(*_BLOCK)).cast("long")
    blocks = materialise(compose(_transitions(pieces)).withColumn("__block", number), "geojson-blocks")
    begins = blocks.select(*_BLOCK, "__block", "inside", "depth", "listed")
    if blocks.count() <= broadcast_blocks:
        placed = pieces.join(F.broadcast(begins), _BLOCK)
    else:
        ordered = pieces.withColumn("__at", F.monotonically_increasing_id()).join(begins, _BLOCK)
        placed = ordered.repartition("__block").sortWithinPartitions("__block", "__at")
    found = materialise(_read_blocks(placed.select("value", "__block", "inside", "depth", "listed")), "geojson-features")
    found = found.join(F.broadcast(blocks.select("__block", "__file")) if blocks.count() <= broadcast_blocks
                       else blocks.select("__block", "__file"), "__block")
    columns = ["__file", "__block", "__index", F.col("text").cast("string").alias("text")]
    # At most the last part of a feature and the first one of another per block.
    before = Window.partitionBy("__file").orderBy("__block", "__index")
    head = F.when(F.col("__index") >= 0, F.struct("__block", "__index"))
    whole = "closes AND __index >= 0"
    parts = found.where(f"NOT ({whole})").withColumn("head", F.last(head, ignorenulls=True).over(before))
    joined = parts.groupBy("__file", "head").agg(
        F.array_sort(F.collect_list(F.struct("__block", F.col("text").cast("string").alias("text")))).alias("parts"), F.bool_or("closes").alias("closed"))
    joined = joined.where("closed").select("__file", "head.__block", "head.__index", F.array_join("parts.text", "").alias("text"))
    return found.where(whole).select(columns).unionByName(joined)
