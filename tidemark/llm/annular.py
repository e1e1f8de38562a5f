"""Vector codes by product quantisation, with annular norm pruning in place of a scan of the codebook.

Vectors become integers, floor(1024 x), and are cut into equal consecutive parts; each part position has a
codebook of at most 256 entries. The entries are sorted by norm. The entry whose norm is nearest to that of
a part comes first and gives a distance d; by the triangle inequality no entry outside the annulus
``norm - d .. norm + d`` can be as near. Binary search finds the interval, which shrinks as nearer entries
are met, and what lies inside, both borders included, is evaluated exactly in integers. Ties go to the
lower index.

Training starts from the vectors with the smallest ids. Each round is one job: every task assigns its
rows and adds up the parts of each entry, an aggregate adds up the tasks' sums, and entries become the
rounded-down means; unused ones stay. Codebooks, at most 256 entries for each position, are all that
reaches the driver and that is sent to tasks.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are those
that are empty or whose number of components differs from that of the smallest vec_id's vector or is no
multiple of ``parts``; components beyond 2**17 count as 2**17, whose squares still add up in 64 bits; with fewer
vectors than entries every vector is one; rows with a null vec_id come last in the order of ids; of rows
with one vec_id the one that is smaller as a list comes first; repeated rows each get a code and count each
time; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 17
#: Pairs of a part and an entry that are evaluated at once.
PAIRS = 1 << 16
#: Entries on each side of the start that are met before the annulus is cut anew, step by step.
STEPS = (4, 32)


class Annuli:
    """A codebook sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.index = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.index], norms[self.index]
        self.evaluated = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        n, k = len(parts), len(self.norms)
        norm = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1))
        at = np.searchsorted(self.norms, norm)
        left = np.maximum(at - 1, 0)
        at = np.where((at == k) | (norm - self.norms[left] <= self.norms[np.minimum(at, k - 1)] - norm), left, np.minimum(at, k - 1))
        best = np.full(n, np.iinfo(np.int64).max)
        index = np.full(n, k)
        self._try(parts, at, at + 1, best, index)
        low, high = at, at + 1  # what has been evaluated
        for step in (*STEPS, k):
            # rounding must not cut off an entry on the border
            reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-6
            begin = np.maximum(np.searchsorted(self.norms, norm - reach), low - step)
            end = np.minimum(np.searchsorted(self.norms, norm + reach, "right"), high + step)
            begin, end = np.minimum(begin, low), np.maximum(end, high)
            self._try(parts, begin, low, best, index)
            self._try(parts, high, end, best, index)
            low, high = begin, end
        return index, best

    def _try(self, parts: np.ndarray, begin: np.ndarray, end: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Evaluate the entries begin .. end - 1 of each row."""
        size = end - begin
        rows = np.flatnonzero(size > 0)
        ends = np.cumsum(size[rows])
        done = 0
        while done < len(rows):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
            of, done = rows[done:to], to
            n = size[of]
            first = np.cumsum(n) - n
            entry = np.repeat(begin[of] - first, n) + np.arange(n.sum())
            away = np.repeat(parts[of], n, axis=0) - self.entries[entry]
            distance = np.einsum("ij,ij->i", away, away)
            self.evaluated += len(distance)
            least = np.minimum.reduceat(distance, first)
            code = np.minimum.reduceat(np.where(distance == np.repeat(least, n), self.index[entry], len(self.norms)), first)
            index[of] = np.where(least < best[of], code, np.where(least == best[of], np.minimum(index[of], code), index[of]))
            best[of] = np.minimum(best[of], least)


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * np.clip(x, -MOST, MOST)).astype(np.int64)


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, label) of the rows with a vector of finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))
    return rows.where("vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")


def first_entries(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """position x entry x component of the codebooks to begin with; None without usable vectors."""
    order = [F.col("vec_id").isNull(), "vec_id", "vec"]
    least = rows.orderBy(*order).select("vec").first()
    if least is None or len(least.vec) % parts:
        return None
    dim = len(least.vec)
    some = rows.where(F.size("vec") == dim).orderBy(*order).select("vec").limit(entries).collect()
    whole = whole_numbers(pa.array([r.vec for r in some], pa.list_(pa.float64())), dim)
    return np.ascontiguousarray(whole.reshape(len(some), parts, dim // parts).transpose(1, 0, 2))


def trained(rows: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds over all rows, each one job."""
    parts, k, width = codebooks.shape
    slim = rows.where(F.size("vec") == parts * width).select("vec")
    for _ in range(rounds):
        now = codebooks

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [Annuli(book) for book in now]
            total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    piece = batch.slice(at, 4096)
                    x = whole_numbers(piece.column("vec"), parts * width).reshape(-1, parts, width)
                    for p in range(parts):
                        index, _ = held[p].nearest(x[:, p])
                        np.add.at(total[p], index, x[:, p])
                        count[p] += np.bincount(index, minlength=k)
            used = np.flatnonzero(count.reshape(-1))
            added = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total.reshape(-1, width)[used].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count.reshape(-1)[used]), added], ["entry", "n", "total"])

        got = slim.mapInArrow(sums, "entry long, n long, total array<long>")
        got = got.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).collect()
        codebooks = codebooks.copy().reshape(-1, width)
        for r in got:
            codebooks[r.entry] = [x // r.n for x in r.total]
        codebooks = codebooks.reshape(parts, k, width)
    return codebooks


def encoded(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of the rows under the codebooks."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Annuli(book) for book in codebooks]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x = whole_numbers(piece.column("vec"), parts * width).reshape(-1, parts, width)
                found = [held[p].nearest(x[:, p]) for p in range(parts)]
                code = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [code[i : i + 2 * parts] for i in range(0, len(code), 2 * parts)]
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.where(F.size("vec") == parts * width).select("vec_id", "label", "vec").mapInArrow(run, "vec_id long, label string, code string, error long")


def fingerprint(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row; the codebooks are learnt from all."""
    spark = vectors.sparkSession
    ship(spark)
    rows = sound(vectors)
    codebooks = first_entries(rows, parts, entries)
    if codebooks is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codebooks = trained(rows, codebooks, rounds)
    codes = written(encoded(rows, codebooks).withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.concat("label", F.lit("")).alias("k"), "label_error")  # renamed as ``apart`` does, for crowded labels
    joined = codes.join(sums, F.col("label") == F.col("k"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))
