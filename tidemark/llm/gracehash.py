"""Exact duplicates by grace hashing: spill files by hash, and open-addressing tables that compare whole contents.

Two texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. A task first
passes its rows through small tables of its own: every row becomes a member of an entry, and every entry
one record with its content, its number of rows and its best row. So a text of which a task holds very many
copies leaves it once per table. Records go to the spill files of the first level, in the shared folder.

Then, level by level, records are dealt to buckets by a hash that differs by level, as many buckets as
the contents of the level need, and a bucket whose distinct contents fit a table passes through one. Buckets
that turn out larger are written to the spill files of the next level and dealt again; a bucket of one
content always fits. A table tells entries with the same class together; members then learn from their
entry's number which row stays. No hash decides that two texts are equal, and no task ever holds the rows
of a group: an entry has the rows of one table at most.

Of equal texts the row with the most code points in the original text stays, then the smallest doc_id.

Defined results: null counts as empty, and empty and blank texts are equal to one another; rows with a null
doc_id take part and come after all others in ties; of rows that agree in doc_id and code points exactly
one stays; very long texts are compared whole, one at a time; an empty table gives no rows; other columns,
whatever their names, are ignored, and kept by ``without_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, discard, fresh, ship, text_slices, written

#: Bytes of distinct contents that one table holds; a bucket is dealt for half of them.
TABLE_BYTES = 32 << 20
#: Buckets that a task takes one after the other, where there are more than shuffle partitions.
BUCKETS_A_TASK = 32
#: Distinct contents of one table in a task's first pass, and its bytes.
LOCAL_ENTRIES, LOCAL_BYTES = 1 << 16, 8 << 20
#: Levels after which dealing gives up; each of them makes a crowded bucket about twice as unlikely to stay so.
MOST_LEVELS = 12


class ContentTable:
    """Open addressing with linear probing; contents are compared whole."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self.slots = [-1] * slots
        self.marks: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, mark: int, content: bytes) -> int:
        """The number of the entry with this content, a new one where there is none."""
        most = len(self.slots) - 1
        at = mark & most
        while (entry := self.slots[at]) >= 0:
            if self.marks[entry] == mark and self.contents[entry] == content:
                return entry
            at = (at + 1) & most
        entry = self.slots[at] = len(self.marks)
        self.marks.append(mark)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.marks) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        most = len(self.slots) - 1
        for entry, mark in enumerate(self.marks):
            at = mark & most
            while self.slots[at] >= 0:
                at = (at + 1) & most
            self.slots[at] = entry


#: A row of the first spill files: a member (entry, doc_id, row), or with ``mark`` a record.
_SPILLED = "entry long, doc_id long, row long, points long, n_rows long, mark long, size long, content binary"
_FIRST = pa.schema([("entry", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("points", pa.int64()), ("n_rows", pa.int64()), ("mark", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])
_CLASSED = "entry long, keep_id long, keep_row long, group_size long, text_sha256 string"
_LAST = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _rank(points: int, doc_id: int | None, row: int) -> tuple:
    """The least stays."""
    return -points, doc_id is None, doc_id or 0, row


def spilled(docs: DataFrame) -> DataFrame:
    """Members and records of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        table, best, many = ContentTable(), [], []
        entry_at = row_at = base

        def records() -> pa.RecordBatch:
            n = len(best)
            points, ids, rows = ([b[i] for b in best] for i in range(3))
            marks = np.array(table.marks, np.uint64).view(np.int64)
            sizes = [len(c) for c in table.contents]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n) + entry_at), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(points, pa.int64()), pa.array(many, pa.int64()), pa.array(marks), pa.array(sizes, pa.int64()), pa.array(table.contents, pa.binary())], schema=_FIRST)

        for batch, data, offsets in text_slices(batches):
            ids = batch.column("doc_id").to_pylist()
            entries = []
            for i, doc_id in enumerate(ids):
                text = data[offsets[i] : offsets[i + 1]]
                content = text[~_SPACE[text]].tobytes()
                points = int(np.count_nonzero((text & 0xC0) != 0x80))
                entry = table.place(xxhash.xxh64_intdigest(content), content)
                if entry == len(best):
                    best.append((points, doc_id, row_at + i))
                    many.append(1)
                else:
                    many[entry] += 1
                    if _rank(points, doc_id, row_at + i) < _rank(*best[entry]):
                        best[entry] = (points, doc_id, row_at + i)
                entries.append(entry)
            n = len(ids)
            blank = [pa.nulls(n, f.type) for f in _FIRST][3:]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(entries, np.int64) + entry_at), batch.column("doc_id"), pa.array(np.arange(n) + row_at), *blank], schema=_FIRST)
            row_at += n
            if table.bytes > LOCAL_BYTES or len(best) > LOCAL_ENTRIES:
                yield records()
                entry_at += len(best)
                table, best, many = ContentTable(), [], []
        if best:
            yield records()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SPILLED)


def _settled(dealt: DataFrame, parts: int) -> DataFrame:
    """The class of every record, bucket after bucket, each in a table of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, best, many, entries = None, ContentTable(), [], [], []

        def out() -> pa.RecordBatch:
            of = [c for c, _ in entries]
            sums = [hashlib.sha256(c).hexdigest() for c in table.contents]
            columns = [[e for _, e in entries], [best[c][1] for c in of], [best[c][2] for c in of], [many[c] for c in of], [sums[c] for c in of]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _LAST)], schema=_LAST)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                contents = part.column("content")
                for i, (b, entry, doc_id, row, points, n_rows, mark) in enumerate(zip(*(part.column(c).to_pylist() for c in ("bucket", "entry", "doc_id", "row", "points", "n_rows", "mark")))):
                    if b != bucket:
                        if entries:
                            yield out()
                        bucket, table, best, many, entries = b, ContentTable(), [], [], []
                    c = table.place(mark & (1 << 64) - 1, contents[i].as_py())
                    if c == len(best):
                        best.append((points, doc_id, row))
                        many.append(n_rows)
                    else:
                        many[c] += n_rows
                        if _rank(points, doc_id, row) < _rank(*best[c]):
                            best[c] = (points, doc_id, row)
                    entries.append((c, entry))
        if entries:
            yield out()

    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _CLASSED)


def _dealt(records: DataFrame, level: int, table_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """(records with their bucket, buckets whose distinct contents do not fit a table, number of tasks)."""
    total = records.agg(F.sum("size")).first()[0] or 0
    least = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, 1 + 2 * total // table_bytes)
    distinct = records.groupBy("mark").agg(F.max("size").alias("size"))
    bucket = F.pmod(F.xxhash64("mark", F.lit(level)), F.lit(n)).alias("bucket")
    crowded = distinct.groupBy(bucket).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where(f"bytes > {table_bytes} AND n > 1").select("bucket")
    return records.withColumn("bucket", bucket), crowded, max(least, n // BUCKETS_A_TASK)


def classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, row, keep_id, keep_row, group_size, text_sha256) of every row of ``docs`` (doc_id, text);
    ``row`` numbers the rows of this run."""
    ship(docs.sparkSession)
    spills = written(spilled(docs), "spill-0")
    members = spills.where("mark IS NULL").select("entry", "doc_id", "row")
    pending = spills.where("mark IS NOT NULL")
    done, levels = [], []
    for level in range(MOST_LEVELS):
        dealt, crowded, parts = _dealt(pending, level, table_bytes)
        more = written(crowded, "crowded")
        some = bool(more.limit(1).count())
        fits = dealt.join(more, "bucket", "left_anti") if some else dealt
        done.append(written(_settled(fits, parts), "classes"))
        if not some:
            discard(more)
            break
        pending = written(dealt.join(more, "bucket", "left_semi").drop("bucket"), f"spill-{level + 1}")
        levels.append(pending)
        discard(more)
    else:
        raise RuntimeError(f"buckets did not fit their tables after {MOST_LEVELS} levels")
    discard(*levels)
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return members.join(found, "entry").drop("entry")


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    return classes(docs, table_bytes).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    own, kept = docs.columns, fresh(docs, "kept_row")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("whole"))
    numbered = written(plain.withColumn("number", F.monotonically_increasing_id()), "numbered")
    # the number stands in for the id, which ranks first among rows of equal code points
    order = classes(numbered.select(F.col("number").alias("doc_id"), "text"), table_bytes).withColumnRenamed("doc_id", "number")
    best = order.join(numbered.select("number", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("points")), "number")
    first = best.groupBy("keep_row").agg(F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "number")).alias("least"))
    return numbered.join(first.select(F.col("least.number").alias(kept)), F.col("number") == F.col(kept), "left_semi").select("whole.*")
