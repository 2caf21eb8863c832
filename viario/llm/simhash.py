"""SimHash near-duplicates, found through per-segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits; the counts of set bits, 0 to 2
each, place it in a space of 32 dimensions. One differing bit moves a point by one step, so
the Manhattan distance of two points is a lower bound of the bits that differ. Points within
4 steps differ in at most 4 of 8 groups of segments, so they share a cell of at least one of
the 70 grids that 4 groups span. Cells are the join keys; inside a cell the Manhattan
distance is tested first and the fingerprints themselves then.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from viario.llm.components import connected_components
from viario.llm.words import kept
from viario.operators.small import join_groups
from viario.storage import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
GROUPS = 8              # of four segments, a byte each
CELL_ROWS = 20_000      # different fingerprints of a cell compared in one piece; larger cells are cut
EQUAL_ROWS = 10_000     # rows equal in all columns that may meet in one task
_EVEN = 0x5555555555555555


def fingerprint(text: bytes, size: int, digest) -> int:
    """The SimHash of a text's word shingles, as an unsigned number; 0 without words."""
    words = text.split()  # bytes: exactly space and \\t to \\r
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def add_fingerprints(documents: DataFrame, text: str = "text", keep: list[str] | None = None,
                     size: int = SHINGLE_WORDS) -> DataFrame:
    """The kept columns and fingerprint (signed 64 bits) of every row; null texts have no words."""
    keep = kept(documents, keep, text, ("fingerprint",))
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = rows.drop("__text").schema.add("fingerprint", "long")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            made = np.array([fingerprint((v.as_py() or b"").lower(), size, xxhash.xxh64_intdigest)
                             for v in batch.column("__text")], dtype=np.uint64).view(np.int64)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made)], names)

    return rows.mapInArrow(run, schema)


def bit_counts(f: Column) -> Column:
    """The 32 bit counts, packed: 0, 1, 2 as the bits 00, 01, 11, so that xor counts steps."""
    one, two = F.shiftrightunsigned(f, 1).bitwiseAND(F.lit(_EVEN)), f.bitwiseAND(F.lit(_EVEN))
    return one.bitwiseOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))


def _bit_counts(f: np.ndarray) -> np.ndarray:
    even = np.uint64(_EVEN)
    one, two = (f >> np.uint64(1)) & even, f & even
    return one | two | ((one & two) << np.uint64(1))


def link_cell(f: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Enough links among the fingerprints of a cell to connect all that link, directly or by others."""
    points, rest, links = _bit_counts(f), np.arange(len(f)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(points[rest] ^ points[x]) <= bits      # lower bound
            some = rest[near]
            ok = np.bitwise_count(f[some] ^ f[x]) <= bits                   # exact
            if ok.any():
                found = some[ok]
                links += [(x, y) for y in found.tolist()]
                todo += found.tolist()
                near[near] = ok
                rest = rest[~near]
    return links


def _link_cells(cells: DataFrame, bits: int, limit: int | None) -> DataFrame:
    """Rows (cell, fingerprint) to links (a, b); cells above the limit come back as heavy rows (cell, fingerprint)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(heavy: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), heavy)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                ["heavy", "a", "b"])

        def close(f: np.ndarray) -> pa.RecordBatch | None:
            links = link_cell(np.unique(f), bits) if len(f) > 1 else []
            if links:
                own = np.unique(f)
                at = np.array(links)
                return out(False, own[at[:, 0]], own[at[:, 1]])
            return None

        cell, held, heavy = None, [], False
        for batch in batches:
            cells_here = batch.column(0).to_numpy()
            prints = batch.column(1).to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero(cells_here[1:] != cells_here[:-1]) + 1).tolist(), len(cells_here)]
            # runs of two that lie inside the batch are compared all at once
            at = np.array(edges[:-1])
            two = at[np.diff(edges) == 2]
            two = two[(two > 0) & (two + 2 < len(cells_here))]
            x, y = prints[two], prints[two + 1]
            near = np.bitwise_count(_bit_counts(x) ^ _bit_counts(y)) <= bits
            near &= (np.bitwise_count(x ^ y) <= bits) & (x != y)
            if near.any():
                yield out(False, x[near], y[near])
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b or (0 < a and b < len(cells_here) and b - a <= 2):
                    continue
                if cells_here[a] != cell:
                    if not heavy and (made := close(np.concatenate(held) if held else prints[:0])) is not None:
                        yield made
                    cell, held, heavy = cells_here[a], [], False
                if heavy:
                    yield out(True, cells_here[a:b].view(np.uint64), prints[a:b])
                    continue
                held.append(prints[a:b].copy())
                if limit is not None and sum(map(len, held)) > limit:
                    own, held, heavy = np.concatenate(held), [], True
                    yield out(True, np.full(len(own), cell, np.int64).view(np.uint64), own)
        if not heavy and held and (made := close(np.concatenate(held))) is not None:
            yield made

    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "heavy boolean, a long, b long")


def link_fingerprints(prints: DataFrame, bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints with at most `bits` (up to 4) differing bits.

    `prints` has one column, fingerprint, without repeats. Not every pair of a crowd becomes a
    link, but everything that links stays connected. A cell with more than `cell_rows`
    fingerprints is cut into blocks, and every two blocks meet in a task of their own.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the grids hold for up to 4 differing bits")
    point = prints.select("fingerprint", bit_counts(F.col("fingerprint")).alias("point"))
    keys = []
    for i, groups in enumerate(combinations(range(GROUPS), GROUPS - 4)):
        mask = sum(0xFF << 8 * g for g in groups)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(i), F.col("point").bitwiseAND(F.lit(signed))))
    cells = point.select(F.explode(F.array(*keys)).alias("cell"), "fingerprint")
    found = materialise(_link_cells(cells, bits, cell_rows), "simhash-links")
    crowd = found.where("heavy").select(F.col("a").alias("cell"), F.col("b").alias("fingerprint"))
    blocks = crowd.groupBy("cell").agg(F.ceil(F.count("*") / (cell_rows // 2)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int")
    cut = crowd.join(blocks, "cell").select("cell", "fingerprint", "n", own.alias("own"))
    pairs = cut.select("cell", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fingerprint")
    links = found.where("not heavy").select("a", "b")
    return links.union(_link_cells(pairs, bits, None).select("a", "b"))


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    size: int = SHINGLE_WORDS, bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fingerprint (signed) and component_id, the smallest doc_id that links reach; a row per document.

    Texts without words (null, empty) have the fingerprint 0 and link like any other. Rows with
    equal ids stay rows of their own. Where no row of a component has an id, component_id is null.
    """
    rows = materialise(add_fingerprints(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")),
                                        size=size), "fingerprints")
    rooted = materialise(_rooted(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), bits, cell_rows), "rooted")
    # Only roots that others link to need a name, and a crowd of one root stays where its fingerprints are.
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = join_groups(rooted, names, ["root"]).select(
        "fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _rooted(prints: DataFrame, bits: int, cell_rows: int) -> DataFrame:
    """fingerprint, first and root, which names the component, for rows (fingerprint, first) without repeats."""
    roots = connected_components(link_fingerprints(prints.select("fingerprint"), bits, cell_rows))
    return prints.join(roots, prints.fingerprint == roots.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))


def keep_one(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE_WORDS,
             bits: int = MAX_BITS, cell_rows: int = CELL_ROWS, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, rows without id last.

    Rows are judged one by one, whatever ids they share; among rows of one id the hash of the text
    and then that of all columns decides. Of rows that are equal in all columns one stays; those
    that more than `equal_rows` rows equal become one before they are moved.
    """
    keys = ["__text", "__row"]
    marks = [m for c in documents.columns for m in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]  # hashes pass over nulls
    own = documents.withColumns({"__text": F.xxhash64(F.col(f"`{text}`")), "__row": F.xxhash64(*marks)})
    rows = add_fingerprints(own.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("__text").alias("text_key"),
                                       F.col("__row").alias("row_key"), F.col(f"`{text}`").alias("text")), size=size)
    rows = materialise(rows.groupBy("fingerprint", "doc_id", "text_key", "row_key").agg(F.count("*").alias("n")), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key", "row_key", "n")).alias("first")
    best = _rooted(rows.groupBy("fingerprint").agg(first), bits, cell_rows).groupBy("root").agg(F.min("first").alias("first"))
    best = materialise(best.select(F.col("first.text_key").alias("__text"), F.col("first.row_key").alias("__row"), "first.n"), "kept-rows")
    crowds = rows.where(F.col("n") > equal_rows).select(F.col("text_key").alias("__text"), F.col("row_key").alias("__row"))
    crowded = not crowds.isEmpty()
    # There are no more crowds than all rows divided by equal_rows, so their keys may go to every task.
    alone = own.join(F.broadcast(crowds), keys, "left_anti") if crowded else own
    kept = alone.join(best.select(keys), keys)
    if not best.where(F.col("n").between(2, equal_rows)).isEmpty():
        kept = kept.dropDuplicates(keys)
    if crowded:
        heads = best.where(F.col("n") > equal_rows).select(keys)
        kept = kept.unionByName(own.join(F.broadcast(heads), keys).dropDuplicates(keys))
    return kept.select([F.col(f"`{c}`") for c in documents.columns])
