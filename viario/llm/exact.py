"""Exact duplicates by Grace hash deduplication.

Texts are equal when all bytes are, after every run of white space became one space. Records
are partitioned by hash to spill files, tables in the shared folder, until the different texts
of a bucket fit an open-addressing table that compares whole texts:

1. Each task collapses the equal texts it reads in such a table, so that of a frequent text it
   sends one record with a count instead of every row.
2. Hashes of which there are still many records are dealt by hash and salt and collapsed once
   more, until no hash has more than `hot_rows` records.
3. Records are dealt to buckets. A bucket is streamed through a table; texts that find no room
   in it are spilled and dealt anew by another hash, until nothing is spilled.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from viario.llm.words import kept
from viario.operators.small import join_groups
from viario.storage import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLE_BYTES = 32 << 20  # texts and entries of one table
TABLE_ROWS = 1 << 16    # rows of a task that may share one record
HOT_ROWS = 1000         # records of one hash that may meet in one task
ENTRY = 200             # bytes that an entry takes beside its text
MAX_TASKS = 20_000
SPARE = 8               # buckets for as many bytes as fit one table; they are dealt by hash, so not evenly
_SPACE = b" \t\n\x0b\x0c\r"


def one_space(text: bytes) -> bytes:
    """The text with every run of white space as one space, also at its ends."""
    words = text.split()  # bytes: exactly space and \\t to \\r
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + b" ".join(words) + (b" " if text[-1] in _SPACE else b"")


class TextTable:
    """Different texts by open addressing with linear probing; equal hashes are told apart by whole texts."""

    def __init__(self):
        self.slots = [-1] * 256
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.size = 0

    def slot(self, h: int, text: bytes) -> int:
        """Where the text is, or the free slot where it would go."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.texts[entry] == text:
                break
            at = at + 1 & mask
        return at

    def add(self, slot: int, h: int, text: bytes) -> int:
        entry = len(self.texts)
        self.slots[slot] = entry
        self.hashes.append(h)
        self.texts.append(text)
        self.size += len(text) + ENTRY
        if 2 * len(self.texts) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, own in enumerate(self.hashes):
                at = own & mask
                while self.slots[at] >= 0:
                    at = at + 1 & mask
                self.slots[at] = i
        return entry


class Groups(TextTable):
    """A table whose entries count rows and keep the best one: smallest id, rows without id last, then row number."""

    def __init__(self):
        super().__init__()
        self.heads: list[int] = []
        self.counts: list[int] = []
        self.best: list[tuple] = []
        self.shas: list[str] = []

    def enter(self, slot: int, h: int, text: bytes, head: int, n: int, best: tuple, sha: str | None = None) -> int:
        entry = self.slots[slot]
        if entry < 0:
            entry = self.add(slot, h, text)
            self.heads.append(head)
            self.counts.append(n)
            self.best.append(best)
            self.shas.append(sha or hashlib.sha256(text).hexdigest())
        else:
            self.counts[entry] += n
            self.best[entry] = min(self.best[entry], best)
        return entry


def _best(value, row: int) -> tuple:
    return (value is None, 0 if value is None else value, row)


_RECORD = ["rep", "head", "h", "n", "id", "row", "sha", "size", "text"]


def _record_schema(kind: T.DataType) -> T.StructType:
    made = T.StructType().add("rep", "long").add("head", "long").add("h", "long").add("n", "long").add("id", kind)
    return made.add("row", "long").add("sha", "string").add("size", "long").add("text", "binary")


def _batch(columns: dict[str, list], n: int, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))


def _record_kinds(kind: pa.DataType) -> dict[str, pa.DataType]:
    number = pa.int64()
    return dict(zip(_RECORD, [number, number, number, number, kind, number, pa.string(), number, pa.binary()]))


def _records(groups: Groups, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """The entries of a table as records of the next step."""
    ids = [None if b[0] else b[1] for b in groups.best]
    return _batch({"rep": groups.heads, "h": groups.hashes, "n": groups.counts, "id": ids,
                   "row": [b[2] for b in groups.best], "sha": groups.shas, "size": [len(t) for t in groups.texts],
                   "text": groups.texts}, len(ids), kinds)


def _collapse(rows: DataFrame, names: list[str], table_bytes: int, table_rows: int) -> DataFrame:
    """Rows (kept columns, __id, __text) to members (kept columns, row, rep) and records, which have h."""
    record = _record_schema(rows.schema["__id"].dataType)
    own = [T.StructField(f.name, f.dataType) for f in rows.select(names).schema.fields]  # null in records
    schema = T.StructType([*own, *record.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 40
        groups, since, kinds = Groups(), 0, None

        def records() -> pa.RecordBatch:
            made = _records(groups, kinds)
            blank = [pa.nulls(made.num_rows, k) for k in kept_kinds]
            return pa.RecordBatch.from_arrays([*blank, *made.columns], [*names, *_RECORD])

        for batch in batches:
            kinds = _record_kinds(batch.column("__id").type)
            kept_kinds = [batch.column(i).type for i in range(len(names))]
            ids, texts = batch.column("__id").to_pylist(), batch.column("__text")
            first, reps = row, []
            for i, value in enumerate(ids):
                text = one_space(texts[i].as_py() or b"")
                h = xxhash.xxh64_intdigest(text) - (1 << 63)
                entry = groups.enter(groups.slot(h, text), h, text, row, 1, _best(value, row))
                reps.append(groups.heads[entry])
                row, since = row + 1, since + 1
                if groups.size > table_bytes or since >= table_rows:
                    yield records()
                    groups, since = Groups(), 0
            own = _batch({"rep": reps, "row": list(range(first, row))}, len(reps), kinds)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], *own.columns], [*names, *_RECORD])
        if since:
            yield records()

    return rows.mapInArrow(run, schema)


def _meet(records: DataFrame, bucket: list[str], table_bytes: int, final: bool) -> DataFrame:
    """Stream each bucket through a table.

    Not final: links (rep, head) and the entries as new records. Final: of every record its rep
    and the figures of its text, with head = rep; records that found no room come back as they were.
    """
    schema = _record_schema(records.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kinds = None, None
        groups, reps, entries = Groups(), [], []

        def close() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(reps), 10_000):
                own, at = reps[a:a + 10_000], entries[a:a + 10_000]
                if not final:
                    yield _batch({"rep": own, "head": [groups.heads[e] for e in at]}, len(own), kinds)
                    continue
                best = [groups.best[e] for e in at]
                yield _batch({
                    "rep": own, "head": own, "n": [groups.counts[e] for e in at], "id": [None if b[0] else b[1] for b in best],
                    "row": [b[2] for b in best], "sha": [groups.shas[e] for e in at]}, len(own), kinds)
            if not final and reps:
                yield _records(groups, kinds)

        for batch in batches:
            kinds = _record_kinds(batch.column("id").type)
            rows = {c: batch.column(c).to_pylist() for c in ("rep", "h", "n", "id", "row", "sha")}
            keys, texts, spilled = list(zip(*[batch.column(c).to_pylist() for c in bucket])), batch.column("text"), []
            for i, own in enumerate(keys):
                if own != key:
                    yield from close()
                    groups, reps, entries, key = Groups(), [], [], own
                text, h = texts[i].as_py(), rows["h"][i]
                slot = groups.slot(h, text)
                if groups.slots[slot] < 0 and groups.size and groups.size + len(text) + ENTRY > table_bytes:
                    if final:
                        spilled.append(i)
                        continue
                    yield from close()
                    groups, reps, entries = Groups(), [], []
                    slot = groups.slot(h, text)
                reps.append(rows["rep"][i])
                entries.append(groups.enter(slot, h, text, rows["rep"][i], rows["n"][i], _best(rows["id"][i], rows["row"][i]), rows["sha"][i]))
            if spilled:
                yield batch.take(pa.array(spilled, pa.int64())).select(_RECORD)
        yield from close()

    return records.select(*_RECORD, *[c for c in bucket if c not in _RECORD]).mapInArrow(run, schema)


def _cool(records: DataFrame, hot_rows: int, table_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """Records of which no hash has more than `hot_rows`, and the links (rep, head) from the former ones, step by step."""
    links = []
    while True:
        hot = materialise(records.groupBy("h").agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows), "hot-hashes")
        if hot.isEmpty():
            return records, links
        salts = F.ceil(F.col("__n") / hot_rows).cast("int")
        marked = join_groups(records, hot, ["h"]).withColumn("__salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
        crowd = marked.where("__n IS NOT NULL").repartition("h", "__salt").sortWithinPartitions("h", "__salt")
        met = materialise(_meet(crowd, ["h", "__salt"], table_bytes, final=False), "collapsed-texts")
        links.append(met.where("h IS NULL").select("rep", "head"))
        rest = marked.where("__n IS NULL").select(_RECORD)
        records = materialise(rest.unionByName(met.where("h IS NOT NULL")), "records")


def _resolve(records: DataFrame, table_bytes: int) -> DataFrame:
    """rep, n, id, row and sha of the text of every record."""
    done, level, spark = None, 0, records.sparkSession
    while True:
        total = records.agg(F.sum(F.col("size") + ENTRY)).first()[0] or 0
        buckets = int(total * SPARE / table_bytes) + 1
        tasks = min(MAX_TASKS, max(buckets // 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = records.withColumn("__bucket", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(buckets)))
        dealt = dealt.repartition(tasks, "__bucket").sortWithinPartitions("__bucket")
        met = materialise(_meet(dealt, ["__bucket"], table_bytes, final=True), "resolved-texts")
        own = met.where("head IS NOT NULL").select("rep", "n", "id", "row", "sha")
        done = own if done is None else done.unionByName(own)
        records, level = met.where("head IS NULL"), level + 1
        if records.isEmpty():
            return done


def exact_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
                     table_bytes: int = TABLE_BYTES, table_rows: int = TABLE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The kept columns of every row with keep_id, group_size, kept and text_sha256.

    Null and empty texts are equal. Of a group the row with the smallest id stays; rows without
    an id come last, and among rows of one id the first one read, so that one row stays in any
    case. keep_id is null where no row of the group has an id. text_sha256 is that of the text
    with single spaces. Texts may have any length: a table takes at least one. Columns named as
    the results give way to them; an empty table gives an empty one.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    keep = kept(documents, keep, text, made)
    names = [f"__k{i}" for i in range(len(keep))]
    rows = documents.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{doc_id}`").alias("__id"),
        F.col(f"`{text}`").cast("binary").alias("__text"))
    spilled = materialise(_collapse(rows, names, table_bytes, table_rows), "text-records")
    records, links = _cool(spilled.where("h IS NOT NULL").select(_RECORD), hot_rows, table_bytes)
    members = spilled.where("h IS NULL").select(*names, F.col("row").alias("__row"), "rep")
    for step in links:
        named = step.withColumnRenamed("head", "__head")
        members = members.join(named, "rep", "left").withColumn("rep", F.coalesce("__head", "rep")).drop("__head")
    found = members.join(_resolve(records, table_bytes), "rep")
    return found.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("__row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))
