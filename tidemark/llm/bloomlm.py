"""A bigram language model whose counts live in a log-frequency Bloom filter.

Counting: each task counts the words and bigrams of its training texts in windows and sends each
distinct one once, packed, to its shard; a shard adds them up. Words keep exact counts. A bigram's
count is quantised to 1 + round(log_b count) and the bigram is inserted once per level (Talbot and
Osborne, 2007), so a lookup probes level 1, 2, ... until one is missing. Shards grow in number with
the input; each has its own bit array of ``BITS`` per insertion.

Scoring: shards are broadcast in groups of at most ``MAX_BROADCAST`` bytes, and each group scores the
tokens whose bigram it holds, over all documents; more input means more groups, never a filter that
is fuller or cut. Exact counts of the at most ``HEAD`` commonest words are broadcast too; where a
token or its context is another word, the counts are joined from the count table, and the probability
is finished there. So ``HEAD`` alters no score. Words are known by 64-bit hashes.

p(w | h) = weight * c(h, w) / c(h) + (1 - weight) * (c(w) + 0.5) / (N + 0.5 * (V + 1)), where c(h)
counts as at least the quantised c(h, w), and as at least 1.

Defined results: null and empty texts are the end token alone; repeated rows are scored each by
itself; a null doc_id is trained on (its crc32 is taken as not 1 modulo 5); without training texts
all counts are 0; very long texts are scored whole; the order of rows does not matter; an empty table
gives no rows; other columns are ignored. Probabilities over the known words and one unknown one sum
to between 0.8 and 1 for a context, up to quantisation and false positives of the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, ship, text_slices, word_bounds, word_hashes, written

BITS, PROBES, LOG_BASE = 12, 4, 1.5
SHARD_CHARS = 10_000_000
HEAD = 1 << 20
MAX_BROADCAST = 64 << 20
WEIGHT = 0.2
END = np.uint64(0x2545F4914F6CDD1D)
_WINDOW = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, document) of all tokens, each document's end included; the first context is the end."""
    start, end, first = word_bounds(data, offsets)
    words = word_hashes(data, start, end, lower=True)
    n = len(offsets) - 1
    sizes = np.diff(first) + 1
    last = np.cumsum(sizes) - 1
    token = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[last] = True
    token[is_end], token[~is_end] = END, words
    context = np.r_[END, token[:-1]] if len(token) else token
    return token, context, np.repeat(np.arange(n), sizes)


def _bigram(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(mix64(context) * np.uint64(0x9FB21C651E98DF25) + token)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[new], np.add.reduceat(n, new)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    return 1 + np.rint(np.log(n) / np.log(LOG_BASE)).astype(np.int64)


def _start(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(key ^ np.uint64(level * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    return h, mix64(h) | np.uint64(1)


def _place(h: np.ndarray, step: np.ndarray, i: int, size: np.ndarray | np.uint64) -> np.ndarray:
    return ((h + np.uint64(i) * step) >> np.uint64(32)) * size >> np.uint64(32)


def fill(key: np.ndarray, n: np.ndarray, bits_each: int = BITS) -> bytes:
    """The bit array of one shard: of distinct keys with their counts."""
    level = _level(n)
    size = max(64, int(level.sum()) * bits_each)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        key, level = key[level >= q], level[level >= q]
        h, step = _start(key, q)
        for i in range(PROBES):
            bits[_place(h, step, i, np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits).tobytes() + size.to_bytes(8, "little")


class Filter:
    """Lookups in some of the shards: one array of bytes, and each shard's bits and first byte."""

    def __init__(self, parts: list[tuple[int, bytes]], shards: int) -> None:
        self.shards = shards
        self.size = np.zeros(shards, np.uint64)
        self.base = np.zeros(shards, np.int64)
        self.bytes = np.empty(sum(len(b) - 8 for _, b in parts), np.uint8)
        at = 0
        for s, b in parts:
            self.size[s], self.base[s] = int.from_bytes(b[-8:], "little"), at
            self.bytes[at : at + len(b) - 8] = np.frombuffer(b, np.uint8)[:-8]
            at += len(b) - 8

    def holds(self, key: np.ndarray) -> np.ndarray:
        return self.size[_shard(key, self.shards)] > 0

    def count(self, key: np.ndarray) -> np.ndarray:
        """The quantised count of keys whose shard is here, or 0."""
        shard = _shard(key, self.shards)
        out = np.zeros(len(key))
        at, size, base = np.arange(len(key)), self.size[shard], self.base[shard]
        q = 1
        while len(at):
            ok = np.arange(len(at))
            h, step = _start(key, q)
            for i in range(PROBES):
                place = _place(h[ok], step[ok], i, size[ok])
                bit = self.bytes[base[ok] + (place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
                ok = ok[bit > 0]
            at, key, size, base = at[ok], key[ok], size[ok], base[ok]
            out[at] = LOG_BASE ** (q - 1)
            q += 1
        return out


def _counts(train: DataFrame, shards: int, bits_each: int) -> DataFrame:
    """(shard, word, n, bits): rows of words with exact counts, and one row per shard of bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for two, parts in held.items():
                if not parts:
                    continue
                key, n = _summed(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
                shard = _shard(key, shards)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                names, ones, many, much = [], [], [], []
                for s in range(shards):
                    k, c = key[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]]
                    if len(k):
                        names.append(s if two else -1 - s)
                        ones.append(k[c == 1].tobytes())
                        many.append(k[c > 1].tobytes())
                        much.append(c[c > 1].astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(x, pa.binary()) for x in (ones, many, much))], ["shard", "ones", "many", "much"])
                parts.clear()

        for _, data, offsets in text_slices(batches):
            token, context, _ = sequences(data, offsets)
            for two, key in ((False, token), (True, _bigram(context, token))):
                key, n = np.unique(key, return_counts=True)
                held[two].append((key, n))
                size += len(key)
            if size > _WINDOW:
                yield from out()
                size = 0
        yield from out()

    def add(key, table):
        table = table.combine_chunks()
        shard = table.column("shard")[0].as_py()
        ones, many, much = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), t) for c, t in (("ones", np.uint64), ("many", np.uint64), ("much", np.int64)))
        k, n = _summed(np.concatenate([ones, many]), np.concatenate([np.ones(len(ones), np.int64), much]))
        if shard >= 0:
            return pa.table({"shard": pa.array([shard], pa.int32()), "word": pa.array([None], pa.int64()), "n": pa.array([None], pa.int64()), "bits": pa.array([fill(k, n, bits_each)], pa.binary())})
        return pa.table({"shard": pa.array([shard] * len(k), pa.int32()), "word": pa.array(k.view(np.int64)), "n": pa.array(n), "bits": pa.nulls(len(k), pa.binary())})

    packed = train.select("text").mapInArrow(run, "shard int, ones binary, many binary, much binary")
    return packed.groupBy("shard").applyInArrow(add, "shard int, word long, n long, bits binary")


def _head(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word, count) of the commonest words, sorted by word."""
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toArrow()
    n, much = (by_count.column(c).to_numpy() for c in ("n", "words"))
    fit = int(np.searchsorted(np.cumsum(much), HEAD, "right"))
    if not fit:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = words.where(F.col("n") >= int(n[fit - 1])).select("word", "n").toArrow()
    word, count = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(word)
    return word[order], count[order]


def score_texts(docs: DataFrame, bits_each: int = BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``bits_each``
    is the filter's bits per insertion."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", F.xxhash64("text").alias("mark"))
    train = docs.where("NOT held_out")
    chars = train.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + chars // SHARD_CHARS
    counts = written(_counts(train, shards, bits_each), "counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    total, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count(F.lit(1))).first())
    floor = total + 0.5 * (distinct + 1)
    head_word, head_n = _head(words)
    head = spark.sparkContext.broadcast((head_word, head_n))  # HEAD pairs of 16 bytes at most
    sizes = {r[0]: r[1] for r in counts.where("bits IS NOT NULL").select("shard", F.octet_length("bits")).collect()}
    groups: list[list[int]] = [[]]
    for s in sorted(sizes):
        if groups[-1] and sum(sizes[x] for x in groups[-1]) + sizes[s] > MAX_BROADCAST:
            groups.append([])
        groups[-1].append(s)

    def scored(number: int, group: list[int], only: bool) -> DataFrame:
        rows = counts.where(F.col("bits").isNotNull() & F.col("shard").between(min(group, default=0), max(group, default=-1))).select("shard", "bits")
        table = spark.sparkContext.broadcast(Filter([(r[0], r[1]) for r in rows.collect()], shards))  # MAX_BROADCAST bytes at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word, n = head.value
            filter_ = table.value
            row = number << 53 | TaskContext.get().partitionId() << 33
            for batch, data, offsets in text_slices(batches):
                size = batch.num_rows
                token, context, doc = sequences(data, offsets)
                key = _bigram(context, token)
                if not only:
                    here = np.flatnonzero(filter_.holds(key))
                    key, token, context, doc = key[here], token[here], context[here], doc[here]
                both = filter_.count(key) if total else np.zeros(len(key))

                def known(x):
                    distinct_, back = np.unique(x, return_inverse=True)
                    at = np.minimum(np.searchsorted(word, distinct_), max(0, len(word) - 1))
                    ok = word[at] == distinct_ if len(word) else np.zeros(len(distinct_), bool)
                    return ok[back], np.where(ok, n[at] if len(word) else 0, 0)[back]

                common, c = known(token)
                context_common, ch = known(context)
                sure = common & context_common
                ratio = WEIGHT * both[sure] / np.maximum(ch[sure], np.maximum(both[sure], 1))
                base = np.log10((c[sure] + 0.5) / floor) if total else np.zeros(int(sure.sum()))
                score = np.log10(ratio + (1 - WEIGHT) * (c[sure] + 0.5) / floor) if total else base
                add = lambda x: np.bincount(doc[sure], x, minlength=size)
                later = np.flatnonzero(~sure)
                # a known count needs no partner: its join key is the bigram's, which spreads common words
                ask = lambda x, ok: np.where(ok, key, x)[later].view(np.int64)
                have = lambda x, ok: pa.array(np.r_[np.zeros(size, np.int64), x[later]], mask=np.r_[np.ones(size, bool), ~ok[later]])
                ids = row + np.arange(size)
                row += size
                nothing = len(later)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[ids, ids[doc[later]]]),
                        pa.concat_arrays([batch.column("doc_id"), pa.nulls(nothing, pa.int64())]),
                        pa.concat_arrays([batch.column("held_out"), pa.nulls(nothing, pa.bool_())]),
                        pa.concat_arrays([batch.column("mark"), pa.nulls(nothing, pa.int64())]),
                        pa.array(np.r_[np.bincount(doc, minlength=size), np.ones(nothing, np.int64)]),
                        pa.array(np.r_[np.bincount(doc[sure], minlength=size), np.zeros(nothing, np.int64)]),
                        pa.array(np.r_[add(base), np.zeros(nothing)]),
                        pa.array(np.r_[add(score), np.zeros(nothing)]),
                        pa.array(np.r_[np.zeros(size, np.int64), ask(token, common)], mask=np.arange(size + nothing) < size),
                        have(c, common),
                        pa.array(np.r_[np.zeros(size, np.int64), ask(context, context_common)], mask=np.arange(size + nothing) < size),
                        have(ch, context_common),
                        pa.array(np.r_[np.zeros(size), both[later]]),
                    ],
                    ["row", "doc_id", "held_out", "mark", "n_tokens", "n_known", "base", "score", "word", "c", "context", "ch", "pair"],
                )

        out = written(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, mark long, n_tokens long, n_known long, base double, score double, word long, c long, context long, ch long, pair double"), "scored")
        table.destroy()
        return out

    tables = [scored(i, g, len(groups) == 1) for i, g in enumerate(groups)]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.union(t)
    done = whole.where("word IS NULL")
    late = whole.where("word IS NOT NULL").join(words, "word", "left").withColumn("c", F.coalesce("c", "n", F.lit(0))).drop("n", "word")
    late = late.join(words.withColumnRenamed("word", "context"), "context", "left").withColumn("ch", F.coalesce("ch", "n", F.lit(0)))
    share = (F.col("c") + 0.5) / F.lit(floor)
    ratio = WEIGHT * F.col("pair") / F.greatest("ch", "pair", F.lit(1.0))
    late = late.groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("more"), F.sum(F.log10(share)).alias("more_base"), F.sum(F.log10(ratio + (1 - WEIGHT) * share)).alias("more_score")
    )
    done = done.join(late, "row", "left").select(
        "doc_id",
        "held_out",
        "mark",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
    if len(tables) > 1:
        # a row's sums come from one scan each, whose rows may come in any order: they meet by content, and equal rows have equal sums
        copies = F.expr(f"count(1) div {len(tables)}").alias("copies")
        done = done.groupBy("doc_id", "held_out", "mark").agg(copies, *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        whole_ = [F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_known")] + [(F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")]
        done = done.select("doc_id", "held_out", *whole_, F.explode(F.expr("sequence(1, copies)")))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
