"""Helpers that the training-data operators share: Arrow batches, checkpoints, seeds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import ship  # noqa: F401

#: Bytes of text that one step of a vectorised kernel works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in local
    mode; on a cluster, where executors do not see the driver's folders, an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if held.isEmpty():
        sc.setCheckpointDir(found)
    return found


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``written`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with at most ``limit`` bytes of text; null counts as empty."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        if text.null_count:
            text = text.fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and len(text.buffers()[2]) else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, len(text))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def text_pieces(batches: Iterator[pa.RecordBatch], overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first byte, bytes, offsets) like ``text_slices``, but a text of over twice ``limit`` bytes
    comes in pieces that share ``overlap`` bytes with the next, so a step's memory is bounded."""
    for batch, data, offsets in text_slices(batches, limit=limit):
        if batch.num_rows > 1 or len(data) <= 2 * limit:
            yield batch, np.zeros(batch.num_rows, np.int64), data, offsets
            continue
        for at in range(0, max(1, len(data) - overlap), limit):
            piece = data[at : at + limit + overlap]
            yield batch, np.array([at], np.int64), piece, np.array([0, len(piece)], np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, SLICE_BYTES + 1)
        held = np.empty(size, np.uint64)
        held[0] = 1
        done, step = 1, base % (1 << 64)
        while done < size:
            take = min(done, size - done)
            held[done : done + take] = held[:take] * np.uint64(step)
            done, step = done + take, step * step % (1 << 64)
        if n > SLICE_BYTES + 1:
            return held
        _POWERS[base] = held
    return held


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, inverse): the hash of values[a:b] modulo 2**64 is (s[b] - s[a]) * inverse[a]."""
    n = len(values)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(n + 1, _BASE)[:n], out=s[1:])
    return s, _powers(n + 1, pow(_BASE, -1, 1 << 64))


def range_hash(s: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((s[end] - s[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): words are maximal runs of bytes other than those of ``gap``, space and 9 to 13
    unless given, within one document; first[i] is the number of words before document i."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~gap[data]
    inside = offsets[(offsets > 0) & (offsets < n)]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:]
    if len(inside):
        begin[inside] = word[inside]
        finish[inside - 1] = word[inside - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offsets, "left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each word; long words, of which two could be made to collide, get xxhash's. Memory is
    bounded by steps of ``SLICE_BYTES``, whatever the length of the text."""
    out = np.empty(len(start), np.uint64)
    size = end - start
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + 2 * SLICE_BYTES, "right")))
        if to > at + 1 or size[at] <= LONG_WORD:
            piece = data[start[at] : end[to - 1]]
            s, inverse = prefix_hash(_LOWER[piece] if lower else piece)
            out[at:to] = range_hash(s, inverse, start[at:to] - start[at], end[at:to] - start[at])
        at = to
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = data[start[i] : end[i]]
        out[i] = xxhash.xxh64_intdigest((_LOWER[word] if lower else word).tobytes())
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k consecutive words within a document, in order; documents that are
    shorter than k words have none. The place of a shingle is its index plus, for each earlier
    document, the words that start none; see ``shingle_starts``."""
    start = shingle_starts(first, k)
    s, inverse = prefix_hash(words)
    return range_hash(s, inverse, start, start + k), np.searchsorted(first, start, "right") - 1


def shingle_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words that start k consecutive words of one document."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.zeros(n + 1, np.int32)
    low, high = first[:-1], np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(ok, low, 1)
    np.add.at(ok, high, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on, which compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _of_planes(raw: bytes, at: int, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def packed(parts: list[tuple[dict[str, np.ndarray], bytes]], kinds: dict[str, type]) -> tuple[int, bytes]:
    """(rows, bytes) of one partition's share: the numbers of each kind, ids as differences, then the rest."""
    fields = {c: np.concatenate([f[c] for f, _ in parts]).astype(t) for c, t in kinds.items()}
    fields["docs"] = np.diff(fields["docs"], prepend=np.int64(0))
    return len(fields["docs"]), b"".join(map(_planes, fields.values())) + b"".join(x for _, x in parts)


def unpacked(rows: list[tuple[int, bytes]], kinds: dict[str, type]) -> tuple[dict[str, np.ndarray], bytes]:
    parts: dict[str, list] = {c: [] for c in kinds}
    rest = []
    for n, raw in rows:
        at = 0
        for c, t in kinds.items():
            x = _of_planes(raw, at, t, n)
            parts[c].append(np.cumsum(x) if c == "docs" else x)
            at += n * np.dtype(t).itemsize
        rest.append(raw[at:])
    return {c: np.concatenate(x) for c, x in parts.items()}, b"".join(rest)
