"""Keyed tables of Parquet files under a log of versions.

A version is a small file ``_log/<number>.json`` that names the folders listing the data files it adds and those
it removes. It comes into being in one step that fails if the number is taken, so of two writers that began
from the same version one is told ``Conflict`` and nobody sees a half-written table. Every ``SNAPSHOT``
versions the whole list is written anew, so a reader never reads more than so many parts of it.

For each data file the list holds its rows, the least and greatest value of the first key, and a Bloom filter
of its keys. A merge looks up which files may hold a key of the source, in range and filter, and writes only
these anew; keys that no file may hold go with the rows of the first of these, or to new files. Files of
one write lie in ranges of the key, so a range names few of them.

What reaches the driver is one short row per data file. Atomic creation needs a file system whose rename
does not overwrite (HDFS and others of its kind) or hard links (local files); object stores need a
committer of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import latest, merge

ROWS_A_FILE = 250_000
#: Versions after which the list of files is written as a whole.
SNAPSHOT = 16
BITS_A_KEY, PROBES = 12, 5
#: Files whose ranges a merge sends to all tasks; beyond, the table should be compacted.
MOST_FILES = 2_000_000


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    added: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    parts: int = 0
    schema: str = ""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Create a whole file in one step, or raise ``Conflict`` where it exists."""
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = _at(spark, staged)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    goal = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path))
    try:
        if fs.getUri().getScheme() == "file":
            of = spark._jvm.java.nio.file.Paths
            files = spark._jvm.java.nio.file.Files
            link = lambda x: of.get(x.toUri())
            files.createLink(link(goal), link(fs.makeQualified(p)))
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(p), goal, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise Conflict(f"{path} exists") from None
        raise
    finally:
        fs.delete(p, False)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version of the table, by default the last one; number 0 is the empty table."""
    held = [int(n[:-5]) for n in _names(spark, f"{path}/_log") if n.endswith(".json")]
    held = [n for n in held if number is None or n <= number]
    if number and number not in held:
        raise ValueError(f"{path} has no version {number}")
    added, removed, batches, schema = [], [], {}, ""
    last = max(held, default=0)
    entries = []
    for n in sorted(held, reverse=True):
        entries.append(json.loads(_read_text(spark, f"{path}/_log/{n:020d}.json")))
        if entries[-1]["whole"]:
            break
    for e in reversed(entries):
        added += e["added"]
        removed += e["removed"]
        batches, schema = e["batches"], e["schema"]
    return Version(last, tuple(added), tuple(removed), batches, len(entries), schema)


def files(spark: SparkSession, path: str, at: Version | None = None) -> DataFrame | None:
    """(file, rows, nulls, low, high, words) of every data file of a version; None for an empty table."""
    at = at or version(spark, path)
    if not at.added:
        return None
    out = spark.read.parquet(*[f"{path}/{a}" for a in at.added])
    return out.join(spark.read.parquet(*[f"{path}/{r}" for r in at.removed]), "file", "left_anti") if at.removed else out


def _rows_of(spark: SparkSession, path: str, names: list[str], at: Version) -> DataFrame:
    """The rows of data files, with the columns of a version; those that a file lacks are null."""
    schema = StructType.fromJson(json.loads(at.schema))
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, by default the last one."""
    at = version(spark, path, number)
    if not at.number:
        raise ValueError(f"{path} is no table")
    held = files(spark, path, at)
    return _rows_of(spark, path, sorted(r.file for r in held.select("file").collect()) if held is not None else [], at)


def key_mark(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys])


def _probes(mark: np.ndarray, bits: int) -> np.ndarray:
    low, high = mark & 0x7FFFFFFF, (mark >> 32 & 0x7FFFFFFF) | 1
    return (low[:, None] + np.arange(PROBES) * high[:, None]) % bits


def _listed(spark: SparkSession, path: str, folder: str, keys: list[str]) -> DataFrame:
    """The list's rows for the files of a folder, from their keys alone."""
    rows = spark.read.parquet(f"{path}/{folder}")
    kind = dict(rows.dtypes)[keys[0]]

    def describe(key, table):
        mark, first = table.column("mark").to_numpy(), table.column("first")
        bits = max(64, -(-BITS_A_KEY * len(mark) // 64) * 64)
        filled = np.zeros(bits, np.uint8)
        filled[_probes(mark, bits).reshape(-1)] = 1
        words = np.packbits(filled, bitorder="little").view(np.int64)
        edges = pa.compute.min_max(first)
        return pa.table({"file": pa.array([key[0].as_py()]), "rows": pa.array([len(mark)], pa.int64()), "nulls": pa.array([first.null_count], pa.int64()), "low": pa.array([edges["min"].as_py()], first.type), "high": pa.array([edges["max"].as_py()], first.type), "words": pa.array([words], pa.list_(pa.int64()))})

    marked = rows.select(F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file"), F.col(f"`{keys[0]}`").alias("first"), key_mark(keys).alias("mark"))
    return marked.groupBy("file").applyInArrow(describe, f"file string, rows long, nulls long, low {kind}, high {kind}, words array<long>")


def may_hold(held: DataFrame, source: DataFrame, keys: list[str]) -> list[str]:
    """The files of a list that may hold a key of ``source``, by range and then by filter."""
    ranges = held.select("file", "nulls", "low", "high").limit(MOST_FILES + 1).toPandas()
    if len(ranges) > MOST_FILES:
        raise ValueError(f"over {MOST_FILES} files; compact the table")
    names, nulls = ranges["file"].to_numpy(), ranges["nulls"].to_numpy() > 0
    some = np.flatnonzero(ranges["low"].notna().to_numpy())
    lows, highs = ranges["low"].iloc[some], ranges["high"].iloc[some]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["first"].notna()
            some_keys = batch[known].sort_values("first")
            values, marks = some_keys["first"].reset_index(drop=True), some_keys["mark"].to_numpy()
            begin, end = values.searchsorted(lows, "left"), values.searchsorted(highs, "right")
            for i in np.flatnonzero(end > begin):
                yield pd.DataFrame({"file": names[some[i]], "mark": marks[begin[i] : end[i]]})
            if not known.all():
                for name in names[nulls]:
                    yield pd.DataFrame({"file": name, "mark": batch["mark"][~known]})

    kind = dict(held.dtypes)["low"]
    pairs = source.select(F.col(f"`{keys[0]}`").cast(kind).alias("first"), key_mark(keys).alias("mark")).mapInPandas(find, "file string, mark long")
    asked = pairs.groupBy("file").agg(F.collect_set("mark").alias("marks"))
    probe = " AND ".join(f"(shiftrightunsigned(words[cast(({p}) div 64 as int)], cast(({p}) % 64 as int)) & 1) = 1" for p in (f"((m & 2147483647) + {i}L * ((shiftrightunsigned(m, 32) & 2147483647) | 1)) % (64L * size(words))" for i in range(PROBES)))
    hit = asked.join(held.select("file", "words"), "file").where(F.expr(f"exists(marks, m -> {probe})"))
    return sorted(r.file for r in hit.select("file").collect())


def _commit(spark: SparkSession, path: str, before: Version, added: list[str], removed: list[str], batches: dict[str, int], schema: str) -> int:
    """Make the next version; ``removed`` are file names."""
    added, gone = list(added), []
    whole = before.parts + 1 >= SNAPSHOT
    if removed:
        gone = [f"_lists/removed-{uuid.uuid4().hex}"]
        spark.createDataFrame([(f,) for f in removed], "file string").coalesce(1).write.parquet(f"{path}/{gone[0]}")
    if whole and before.added:
        after = Version(0, (*before.added, *added), (*before.removed, *gone))
        added, gone = [f"_lists/whole-{uuid.uuid4().hex}"], []
        files(spark, path, after).write.parquet(f"{path}/{added[0]}")
    number = before.number + 1
    _create(spark, f"{path}/_log/{number:020d}.json", json.dumps({"whole": whole or not before.number, "added": added, "removed": gone, "batches": before.batches | batches, "schema": schema}))
    return number


def _written(spark: SparkSession, path: str, rows: DataFrame, n: int, keys: list[str]) -> tuple[list[str], str]:
    """Data files of ``rows`` in ranges of the key, and their list."""
    folder = f"data-{uuid.uuid4().hex}"
    parts = max(1, -(-n // ROWS_A_FILE))
    dealt = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, *keys)
    dealt.sortWithinPartitions(*keys).write.option("maxRecordsPerFile", 2 * ROWS_A_FILE).parquet(f"{path}/{folder}")
    listed = f"_lists/added-{uuid.uuid4().hex}"
    _listed(spark, path, folder, keys).write.parquet(f"{path}/{listed}")
    return [listed], folder


def merge_into(spark: SparkSession, path: str, source: DataFrame, keys: list[str], batch: tuple[str, int] | None = None, gone: str | None = None, expect: int | None = None, order: list[Column] | None = None, attempts: int = 5) -> int:
    """Merge rows by key and return the table's version.

    Source rows replace rows of equal key and are added otherwise; where the column ``gone`` is true the key
    is removed instead. With ``order`` the first of the two under it stays, so what comes late replaces
    nothing newer. ``batch`` names a stream and the number of its batch: one that the table has seen, or that
    has no rows, changes nothing, but is evaluated, whole and once, as a stream's state goes with it. With ``expect`` the merge is made on that version only and raises ``Conflict`` if the table
    has moved on; without, it begins anew on the new version.
    """
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    source.write.parquet(staged)
    rows = spark.read.schema(source.schema).parquet(staged)
    try:
        if batch and rows.isEmpty():
            return version(spark, path).number
        for _ in range(attempts):
            before = version(spark, path)
            if batch and before.batches.get(batch[0], -1) >= batch[1]:
                return before.number
            if expect is not None and before.number != expect:
                raise Conflict(f"{path} is at version {before.number}, not {expect}")
            held = files(spark, path, before)
            touched = may_hold(held, rows, keys) if held is not None else []
            n = rows.count()
            if touched:
                target = _rows_of(spark, path, touched, before)
                n += held.where(F.col("file").isin(touched)).agg(F.sum("rows")).first()[0] if len(touched) < 1000 else held.join(spark.createDataFrame([(t,) for t in touched], "file string"), "file").agg(F.sum("rows")).first()[0]
                merged = latest(target.unionByName(rows, allowMissingColumns=True), keys, order) if order else merge(target, rows, keys)
            else:
                merged = rows
            if gone:
                merged = merged.where(~F.coalesce(F.col(gone), F.lit(False))).drop(gone)
            # columns that only the table or only the source has stay
            schema = merged.limit(0) if touched or not before.number else _rows_of(spark, path, [], before).unionByName(merged.limit(0), allowMissingColumns=True)
            added, folder = _written(spark, path, merged, n, keys) if n or not before.number else ([], None)
            try:
                return _commit(spark, path, before, added, touched, {batch[0]: batch[1]} if batch else {}, schema.schema.json())
            except Conflict:
                for f in (*added, *([folder] if folder else [])):
                    _remove(spark, f"{path}/{f}")
                if expect is not None:
                    raise
        raise Conflict(f"{path} moved on {attempts} times")
    finally:
        _remove(spark, staged)


def compact(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Write the table anew in ranges of the key, as its next version."""
    before = version(spark, path)
    held = files(spark, path, before)
    names = [(r.file, r.rows) for r in held.select("file", "rows").collect()]
    added, _ = _written(spark, path, _rows_of(spark, path, [f for f, _ in names], before), sum(n for _, n in names), keys)
    return _commit(spark, path, before, added, [f for f, _ in names], {}, before.schema)


def changes(spark: SparkSession, path: str, keys: list[str], old: int, new: int | None = None) -> DataFrame:
    """What differs between two versions: (change, columns), one 'insert' or 'delete' row, or an
    'update_before' and an 'update_after' one, per changed key. Only files that one version has and the other
    has not are read."""
    now = version(spark, path, new)
    empty = _rows_of(spark, path, [], now)
    sides = []
    held = [files(spark, path, version(spark, path, old) if old else Version()), files(spark, path, now)]
    for mine, other in (held, held[::-1]):
        if mine is None:
            sides.append(empty)
            continue
        own = mine.select("file") if other is None else mine.select("file").join(other.select("file"), "file", "left_anti")
        sides.append(_rows_of(spark, path, sorted(r.file for r in own.collect()), now))
    columns = empty.columns
    packed = [s.select(*[F.col(f"`{k}`").alias(f"{side}{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in columns]).alias(side)) for s, side in zip(sides, ("before", "after"))]
    same = [F.col(f"before{i}").eqNullSafe(F.col(f"after{i}")) for i in range(len(keys))]
    pairs = packed[0].join(packed[1], same, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    row = lambda kind, side: F.struct(F.lit(kind).alias("change"), F.col(side).alias("row"))
    both = F.array(row("update_before", "before"), row("update_after", "after"))
    told = F.when(F.col("before").isNull(), F.array(row("insert", "after"))).when(F.col("after").isNull(), F.array(row("delete", "before"))).otherwise(both)
    return pairs.select(F.explode(told).alias("c")).select("c.change", "c.row.*")


def vacuum(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Remove data that no version from ``keep`` on reads, and return what has gone; older versions cannot
    be read afterwards."""
    last = version(spark, path)
    used: set[str] = set()
    for n in range(keep, last.number + 1):
        held = files(spark, path, version(spark, path, n))
        used |= {r.file.split("/")[0] for r in held.select("file").distinct().collect()} if held is not None else set()
    stale = [f for f in _names(spark, path) if f.startswith("data-") and f not in used]
    for f in stale:
        _remove(spark, f"{path}/{f}")
    return stale


def claim(spark: SparkSession, path: str, owner: str, now: str, n: int, seconds: int, attempts: int = 20) -> DataFrame:
    """Lease the ``n`` next jobs (job_id, priority, scheduled_at, status, owner, expires_at) that are pending,
    or running under a lease that has lapsed. The claim is a merge on the version that was read, so a rival
    that is faster makes it start again and no job has two holders."""
    at = F.lit(now).cast("timestamp")
    for _ in range(attempts):
        before = version(spark, path)
        jobs = read(spark, path, before.number)
        due = (F.col("status") == "PENDING") | ((F.col("status") == "RUNNING") & (F.col("expires_at") <= at))
        mine = jobs.where(due & (F.col("scheduled_at") <= at)).orderBy("priority", "scheduled_at", "job_id").limit(n)
        mine = mine.withColumns({"status": F.lit("RUNNING"), "owner": F.lit(owner), "expires_at": at + F.expr(f"INTERVAL {int(seconds)} SECONDS")})
        got = spark.createDataFrame(mine.collect(), mine.schema)
        try:
            merge_into(spark, path, got, ["job_id"], expect=before.number)
            return got
        except Conflict:
            continue
    raise Conflict(f"{path}: no claim in {attempts} attempts")


def finish(spark: SparkSession, path: str, owner: str, jobs: DataFrame, status: str = "DONE", attempts: int = 20) -> DataFrame:
    """End jobs (job_id) that ``owner`` still holds, and return them; a lease that has passed on is left."""
    for _ in range(attempts):
        before = version(spark, path)
        held = read(spark, path, before.number).where((F.col("owner") == owner) & (F.col("status") == "RUNNING")).join(jobs.select("job_id"), "job_id", "left_semi")
        ended = spark.createDataFrame(held.withColumn("status", F.lit(status)).collect(), held.schema)
        try:
            merge_into(spark, path, ended, ["job_id"], expect=before.number)
            return ended
        except Conflict:
            continue
    raise Conflict(f"{path}: no end in {attempts} attempts")
