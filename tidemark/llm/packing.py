"""Cost-balanced packing of documents into training sequences.

A document's ids end with the end id. Whole multiples of the capacity become full sequences of
their own; what is left of each document joins a window of about ``WINDOW_TOKENS`` ids. In a window
the pieces go, longest first, to the sequence with the lowest estimated cost (linear in its ids plus
quadratic in each piece, as attention within a document is) that has room; a piece that fits nowhere
is cut. Every sequence of a window is filled to the brim and what remains enters the next window, so
a task pads its last sequence at most. Tasks are independent: nothing is shuffled, collected or
broadcast, and memory is bounded by a window and the longest document.

Defined results: null and empty texts are the end id alone; repeated rows and equal ids are packed
each by itself; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .common import ship, text_slices

WINDOW_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 4096) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """(placed, left): (piece, start within it, length, sequence, offset), and (piece, start, length)
    of the fewer than ``capacity`` ids that fill no whole sequence."""
    n = sum(lengths) // capacity
    heap = [(0.0, s) for s in range(n)]
    room = [capacity] * n
    placed, left = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, rest = 0, lengths[i]
        while rest:
            passed, took = [], None
            while heap:
                cost, s = heapq.heappop(heap)
                if room[s] >= rest:
                    took = (cost, s, rest)
                    break
                passed.append((cost, s))
            if took is None and passed:
                at = max(range(len(passed)), key=lambda j: room[passed[j][1]])
                cost, s = passed.pop(at)
                took = (cost, s, room[s])
            if took is None:
                left.append((i, start, rest))
                break
            cost, s, size = took
            placed.append((i, start, size, s, capacity - room[s]))
            room[s] -= size
            if room[s]:
                heapq.heappush(heap, (cost + linear * size + quadratic * size * size, s))
            for x in passed:
                heapq.heappush(heap, x)
            start, rest = start + size, rest - size
    return placed, left


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, window: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text)."""
    tokenizer = tokenizer or tokens.default_path("word_bpe_49k.json")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number, base = tokens.word_bpe(tokenizer), count(), TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens
        size, rows = 0, []

        def put(doc, start, ids, total, sequence, offset) -> None:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset))

        def fill() -> None:
            nonlocal held, size
            placed, left = assign([len(x[2]) for x in held], capacity)
            names: dict[int, int] = {}
            for i, start, length, s, offset in placed:
                doc, first, ids, total = held[i]
                if s not in names:
                    names[s] = next(number)
                put(doc, first + start, ids[start : start + length], total, names[s], offset)
            held = [(held[i][0], held[i][1] + start, held[i][2][start : start + length], held[i][3]) for i, start, length in left]
            size = sum(len(x[2]) for x in held)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch, _, _ in text_slices(batches):
            ids_of = bpe.ids(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of):
                ids = np.append(ids, np.uint32(end_id))
                total, at = len(ids), 0
                while total - at >= capacity:
                    put(doc, at, ids[at : at + capacity], total, next(number), 0)
                    at += capacity
                if at < total:
                    held.append((doc, at, ids[at:], total))
                    size += total - at
                if size >= window:
                    fill()
            yield out()
        fill()
        if held:
            sequence, offset = next(number), 0
            for doc, start, ids, total in held:
                put(doc, start, ids, total, sequence, offset)
                offset += len(ids)
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
