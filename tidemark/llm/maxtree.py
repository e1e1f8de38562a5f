"""Ranked lexical search over an index of document ranges, by best-first branch-and-bound.

A shard of the index holds a run of documents in the order of doc_id, at most ``SHARD_DOCS`` of them and about
``SHARD_BYTES`` of text: which terms occur, in how many of its documents, and the postings (place of the
document in the shard, occurrences). Shards are written by the tasks that read the documents, without a
shuffle, and grow in number with the input. Every term of every document is indexed.

A search sends the items' terms, in blocks of bounded size, to the shards: once for how many documents hold
each term, once with the weights. There each asked term's postings become a tree of maxima: its leaves are
documents, a node covers ``FAN`` nodes below it and holds the greatest contribution in its range. The bound of
a range is the sum of its terms' maxima. Ranges wait in a queue, that of the highest bound is opened first,
and the search of a shard ends when no bound reaches the score of the last document kept. Ranges whose bound
equals it are opened as well, as a tie may have a smaller doc_id. What a task has found it keeps from
shard to shard, and passes on only the best documents of each item.

Defined results: null and empty texts have no terms and are no documents of the collection; rows with a null
doc_id count as documents, but are never returned; rows with one doc_id are documents of their own; items
without terms return nothing; rows with one item_id, or a null one, are one item with all their terms; equal
scores go to the smallest doc_id; very long texts are indexed whole; an empty table gives no rows; other
columns, whatever their names, are ignored. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _of_planes, _planes, ship, text_slices, word_bounds, word_hashes, written

SHARD_DOCS, SHARD_BYTES = 4096, 16 << 20
#: Ranges below a range.
FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Bytes of items' texts that one search sends to all tasks.
BLOCK_BYTES = 4 << 20
K1, TENTHS = 8, 90

#: Bytes that belong to no term.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every term, in order of documents."""
    start, end, first = word_bounds(data, offsets, _GAP)
    return word_hashes(data, start, end, lower=True), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _counted(term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences), by term, of terms in order of documents."""
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    new = np.flatnonzero(np.r_[len(term) > 0, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
    return term[new], doc[new], np.diff(np.r_[new, len(term)])


_SHARD = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("n_ranked", pa.int64()), ("n_rows", pa.int64()), ("docs", pa.binary()), ("n_distinct", pa.int64()), ("terms", pa.binary()), ("n_postings", pa.int64()), ("postings", pa.binary())])
_SHARD_DDL = "n_docs long, n_terms long, n_ranked long, n_rows long, docs binary, n_distinct long, terms binary, n_postings long, postings binary"


class _Shard:
    """Documents on their way into one shard."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, ids: list, data: np.ndarray, offsets: np.ndarray) -> None:
        term, doc = terms(data, offsets)
        self.sizes.append(np.bincount(doc, minlength=len(ids)))
        term, doc, tf = _counted(term, doc)
        self.parts.append((term, doc + len(self.ids), tf))
        self.ids += ids
        self.bytes += len(data)

    def row(self) -> pa.RecordBatch:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        size = np.concatenate(self.sizes)
        known = np.array([i is not None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, tf = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        doc = place[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        new = np.flatnonzero(np.r_[len(term) > 0, term[1:] != term[:-1]])
        df = np.diff(np.r_[new, len(term)])
        values = [
            int((size > 0).sum()), int(size.sum()), int(known.sum()), len(ids),
            squeeze(_planes(ids[order]) + _planes(size[order].astype(np.int64))), len(new),
            squeeze(_planes(term[new]) + _planes(df.astype(np.uint32))), len(term),
            squeeze(_planes(doc.astype(np.uint16)) + _planes(tf.astype(np.uint32))),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _SHARD)], schema=_SHARD)


def index(docs: DataFrame) -> DataFrame:
    """The shards, one row each, written to the shared folder."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch, data, offsets in text_slices(batches):
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(ids), SHARD_DOCS):
                to = min(at + SHARD_DOCS, len(ids))
                if shard.ids and (len(shard.ids) + to - at > SHARD_DOCS or shard.bytes + offsets[to] - offsets[at] > SHARD_BYTES):
                    yield shard.row()
                    shard = _Shard()
                shard.add(ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        if shard.ids:
            yield shard.row()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SHARD_DDL), "shards")


class Block:
    """Items of one search: their terms, distinct and in order, and those of each item."""

    def __init__(self, items: dict[int | None, np.ndarray]) -> None:
        self.ids = list(items)
        self.terms, of = np.unique(np.concatenate([*items.values(), np.zeros(0, np.uint64)]), return_inverse=True)
        sizes = np.array([len(x) for x in items.values()], np.int64)
        self.of = np.split(of, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def places(self, shard_terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked terms that the shard has, where they stand there)."""
        at = np.minimum(np.searchsorted(shard_terms, self.terms), max(len(shard_terms) - 1, 0))
        have = np.flatnonzero(shard_terms[at] == self.terms) if len(shard_terms) else np.zeros(0, np.int64)
        return have, at[have]


def blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of whole items, of bounded size unless a single item is larger."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id").agg(F.collect_list("text").alias("texts"))
    held: dict[int | None, np.ndarray] = {}
    size = 0
    for r in rows.toLocalIterator():
        texts = [t.encode() for t in r.texts]
        data = np.frombuffer(b"\0".join(texts), np.uint8)
        held[r.item_id] = np.unique(terms(data, np.array([0, len(data)], np.int64))[0])
        size += len(data)
        if size > BLOCK_BYTES:
            yield Block(held)
            held, size = {}, 0
    if held:
        yield Block(held)


class MaxTree:
    """Trees of maxima of a shard's asked terms, level by level, each a sorted list of (term, range)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int) -> None:
        self.levels = [(term << 32 | doc, value)]
        while n_docs > 1 << FAN_BITS * (len(self.levels) - 1):
            key, value = self.levels[-1]
            key = key >> 32 << 32 | (key & 0xFFFFFFFF) >> FAN_BITS
            new = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
            self.levels.append((key[new], np.maximum.reduceat(value, new) if len(new) else value[:0]))
        self.opened = 0

    def top(self, terms: np.ndarray) -> int:
        """The bound of all documents."""
        key, value = self.levels[-1]
        return int(value[np.searchsorted(key, terms << 32)].sum())

    def below(self, terms: np.ndarray, level: int, at: int) -> np.ndarray:
        """Bounds of the ranges that make up range ``at`` of a level; on level 1 these are documents' scores."""
        self.opened += 1
        key, value = self.levels[level - 1]
        base = terms << 32 | at << FAN_BITS
        low, high = np.searchsorted(key, base), np.searchsorted(key, base + FAN)
        n = high - low
        some = np.flatnonzero(n)
        n = n[some]
        places = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros(FAN, np.int64)
        np.add.at(out, key[places] & (FAN - 1), value[places])
        return out


def best_first(tree: MaxTree, terms: np.ndarray, ids: np.ndarray, kept: list[tuple[int, int]], k: int) -> None:
    """Enter the shard's best documents into ``kept``, a heap of at most k (score, -doc_id)."""
    if not len(terms):
        return
    queue = [(-tree.top(terms), len(tree.levels) - 1, 0)]
    while queue:
        bound, level, at = heapq.heappop(queue)
        if len(kept) == k and -bound < kept[0][0]:
            break
        if level == 0:  # a shard of one document
            found = {0: -bound}
        else:
            below = tree.below(terms, level, at)
            some = np.flatnonzero(below if len(kept) < k else below >= max(kept[0][0], 1))
            found = {(at << FAN_BITS) + int(i): int(below[i]) for i in some}
        for place, score in found.items():
            if level > 1:
                heapq.heappush(queue, (-score, level - 1, place))
            elif place < len(ids):
                if len(kept) < k:
                    heapq.heappush(kept, (score, -int(ids[place])))
                else:
                    heapq.heappushpop(kept, (score, -int(ids[place])))


def _frequencies(shards: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each asked term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(len(block.terms), np.int64)
        for batch in batches:
            for n, raw in zip(batch.column("n_distinct").to_pylist(), batch.column("terms")):
                raw = zstandard.ZstdDecompressor().decompress(raw.as_py())
                have, at = block.places(_of_planes(raw, 0, np.uint64, n))
                total[have] += _of_planes(raw, 8 * n, np.uint32, n)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(len(block.terms), np.int64)
    for r in shards.select("n_distinct", "terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _searched(shards: DataFrame, block: Block, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score) of the best documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opened = zstandard.ZstdDecompressor().decompress
        kept: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                raw = opened(r["terms"])
                have, at = block.places(_of_planes(raw, 0, np.uint64, r["n_distinct"]))
                df = _of_planes(raw, 8 * r["n_distinct"], np.uint32, r["n_distinct"]).astype(np.int64)
                begin = (np.cumsum(df) - df)[at]
                n = df[at]
                places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                raw = opened(r["postings"])
                doc = _of_planes(raw, 0, np.uint16, r["n_postings"])[places].astype(np.int64)
                tf = _of_planes(raw, 2 * r["n_postings"], np.uint32, r["n_postings"])[places].astype(np.int64)
                raw = opened(r["docs"])
                ids = _of_planes(raw, 0, np.int64, r["n_rows"])[: r["n_ranked"]]
                size = _of_planes(raw, 8 * r["n_rows"], np.int64, r["n_rows"])
                m = 100 - TENTHS + TENTHS * size * n_docs // n_terms
                term = np.repeat(have, n)
                tree = MaxTree(term, doc, weight[term] * (1_000_000_000 * tf // (1000 * tf + K1 * m[doc])), r["n_rows"])
                held = np.zeros(len(block.terms), bool)
                held[have] = True
                for of, found in zip(block.of, kept):
                    best_first(tree, of[held[of]], ids, found, k)
        rows = [(item, -d, s) for item, found in zip(block.ids, kept) for s, d in found if s > 0]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id long, doc_id long, score long")


def search(shards: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item (item_id, text)."""
    spark = shards.sparkSession
    ship(spark)
    n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(items) if n_docs else ():
        df = _frequencies(shards, block)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        out = out.union(_searched(shards, block, weight, n_docs, n_terms, k))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
