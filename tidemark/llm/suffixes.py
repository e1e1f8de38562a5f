"""Removal of repeated byte strings, by families of sparse suffix arrays that grow geometrically.

A string of ``span`` bytes is repeated if it also starts earlier: in a document with a smaller
doc_id, or earlier in the same one. Suffixes are indexed where they begin with the ``edge`` bytes of
least hash (leftmost on ties) of some window of ``span`` bytes; equal windows choose the same place
in themselves, so every repeated window is seen from such a suffix. The consecutive windows of one
suffix travel together as its context, to a partition named by those first bytes.

A partition keeps a logarithmic family. Each batch of contexts, in order of place, becomes a suffix
array (suffix first, then what precedes it, backwards) and is merge-scanned against itself and every
level: a context whose equal stands earlier is repeated as a whole; elsewhere the longest prefix that
a suffix shares with its neighbours there tells which of its windows may be repeated, and these are
looked up among those of the level by hash and compared byte by byte. Then the batch becomes a level,
and levels of like size merge. Matches are spans in document coordinates; a document's spans meet in
a join with its text.

A task settles contexts that it has itself seen earlier; they go straight to their documents, so very
common passages and long runs of one byte reach a partition about once per task. They are found by hash;
then contexts of one slice are compared byte by byte, and with those of slices before by 128-bit digests of
their bytes. What differs travels to its partition like the others.
Partitions grow in number with the input; nothing is collected or broadcast. Long texts are indexed
in overlapping pieces; places in a text are 31-bit numbers, as a value of Spark holds at most 2 GB.

Defined results: null, empty and short texts have no window and stay; rows with a null doc_id stay
and are no source; rows with one doc_id are one document with two texts, so equal places are never
each other's source and of equal rows both stay; ties in hash go to the leftmost place; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, packed, prefix_hash, range_hash, shingle_starts, ship, text_pieces, text_slices, unpacked
from .debruijn import _runs, sliding_least

SPAN, EDGE = 100, 16
PARTITION_BYTES = 4_000_000
#: Bytes of text whose contexts a task gathers, by partition, before it compresses and sends them.
GATHER_BYTES = 12 << 20
#: Contexts in one batch of a family, unless that makes over ``MOST_BATCHES`` batches.
BATCH, MOST_BATCHES = 1 << 15, 8
#: Of zstandard, for contexts on their way.
LEVEL = 6
_SEEN = 1 << 18


def contexts(data: np.ndarray, offsets: np.ndarray, span: int, edge: int) -> tuple[np.ndarray, ...]:
    """(begin, windows, suffix, document, hash of the first bytes, hash of all) of each context: the
    windows begin .. begin + windows - 1, whose suffix begins at ``suffix``."""
    at = shingle_starts(offsets, span)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    s, inverse = prefix_hash(data)
    place = np.arange(len(data) - edge + 1)
    first = range_hash(s, inverse, place, place + edge)
    ranked = (first >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
    suffix = (sliding_least(ranked, span - edge + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    cut = _runs(at, row, suffix)
    begin, size, suffix = at[cut], np.diff(np.r_[cut, len(at)]), suffix[cut]
    whole = range_hash(s, inverse, begin, begin + size + span - 1) ^ mix64((suffix - begin).astype(np.uint64))
    return begin, size, suffix, row[cut], first[suffix], whole


class Contexts:
    """Contexts of one partition: ``data`` holds them one after the other; ``left`` bytes of each
    precede its suffix, ``size`` windows begin in it, and ``rank`` orders them by where their suffix
    stands, equal places alike."""

    def __init__(self, data: np.ndarray, left: np.ndarray, size: np.ndarray, rank: np.ndarray, span: int, edge: int) -> None:
        self.data, self.left, self.size, self.rank, self.span, self.edge = data, left, size, rank, span, edge
        length = size + span - 1
        self.base, self.right = np.cumsum(length) - length, length - left  # first byte, and bytes from the suffix on

    def keys(self, of: np.ndarray) -> np.ndarray:
        """Fixed-width keys: the suffix, then what precedes it backwards, then both lengths."""
        span, wide = self.span, self.span - self.edge
        out = np.zeros((len(of), span + wide + 2), np.uint8)
        for start in range(0, len(of), 1 << 14):
            i = slice(start, start + (1 << 14))
            c = of[i]
            middle = self.base[c] + self.left[c]
            step = np.arange(span)
            out[i, :span] = np.where(step < self.right[c][:, None], self.data[np.minimum(middle[:, None] + step, len(self.data) - 1)], 0)
            step = np.arange(wide)
            out[i, span : span + wide] = np.where(step < self.left[c][:, None], self.data[np.maximum(middle[:, None] - 1 - step, 0)], 0)
        out[:, -2], out[:, -1] = self.left[of], self.right[of]
        return out.reshape(-1).view(f"S{out.shape[1]}")

    def heads(self, of: np.ndarray) -> np.ndarray:
        """The first bytes of the suffixes."""
        return self.data[(self.base[of] + self.left[of])[:, None] + np.arange(self.edge)].reshape(-1).view(f"S{self.edge}")

    def windows(self, of: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, window, hash) of the first ``many`` windows of each context."""
        context = np.repeat(of, many)
        window = np.arange(len(context)) - np.repeat(np.cumsum(many) - many, many)
        mark = np.empty(len(context), np.uint64)
        take = many + self.span - 1
        ends, done = np.cumsum(take), np.cumsum(many)
        at = 0
        while at < len(of):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - take[at] + (1 << 20), "right")))
            n, c = take[at:to], of[at:to]
            first = np.cumsum(n) - n
            piece = self.data[np.repeat(self.base[c] - first, n) + np.arange(n.sum())]
            s, inverse = prefix_hash(piece)
            i = slice(done[at] - many[at], done[to - 1])
            place = np.repeat(first, many[at:to]) + window[i]
            mark[i] = range_hash(s, inverse, place, place + self.span)
            at = to
        return context, window, mark

    def equal(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether window i of context a has the bytes of window j of context b."""
        out = np.empty(len(a), bool)
        step = np.arange(self.span)
        for start in range(0, len(a), 1 << 14):
            x = slice(start, start + (1 << 14))
            out[x] = (self.data[(self.base[a[x]] + i[x])[:, None] + step] == self.data[(self.base[b[x]] + j[x])[:, None] + step]).all(axis=1)
        return out


class SuffixFamily:
    """A logarithmic family of suffix arrays over distinct contexts, each with its earliest one.

    ``add`` sorts a batch into a suffix array, scans it against itself and against every level, as
    two sorted runs are merged, and returns the windows that stand earlier; then the batch becomes a
    level, and levels of like size are merged run into run. Batches come in order of rank.
    """

    def __init__(self, contexts: Contexts) -> None:
        self.contexts = contexts
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # keys in order, and the context of each
        self.twins: list[tuple[np.ndarray, np.ndarray]] = []  # contexts at one place in equal rows

    def add(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts that are repeated whole, and context and window of other repeats)."""
        c = self.contexts
        key = c.keys(batch)
        order = np.argsort(key, kind="stable")
        key, of = key[order], batch[order]
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.repeat(of[new], np.diff(np.r_[np.flatnonzero(new), len(of)]))
        whole = [of[c.rank[of] > c.rank[first]]]
        twin = ~new & (c.rank[of] == c.rank[first])
        self.twins.append((of[twin], first[twin]))
        key, of = key[new], of[new]
        merged = []
        for level, owner in self.levels:
            at = np.minimum(np.searchsorted(level, key), len(level) - 1)
            same = level[at] == key
            later = same & (c.rank[owner[at]] < c.rank[of])
            whole.append(of[later])
            self.twins.append((of[same & ~later], owner[at][same & ~later]))
            key, of = key[~same], of[~same]
        parts = [self._scan(key, of, None, None), *(self._scan(key, of, *level) for level in self.levels)]
        if len(key):
            while self.levels and len(self.levels[-1][0]) <= 2 * len(key):
                key, of = self._merged(*self.levels.pop(), key, of)
            self.levels.append((key, of))
        context, window = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return np.concatenate(whole), context, window

    @staticmethod
    def _merged(a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two sorted runs without a common key as one."""
        at = np.searchsorted(a, b) + np.arange(len(b))
        rest = np.ones(len(a) + len(b), bool)
        rest[at] = False
        key, of = np.empty(len(rest), a.dtype), np.empty(len(rest), np.int64)
        key[at], of[at], key[rest], of[rest] = b, b_of, a, a_of
        return key, of

    def _common(self, key: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Bytes that each suffix shares with that of its neighbour in another array."""
        span = self.contexts.span
        out = np.empty(len(key), np.int64)
        for i in range(0, len(key), 1 << 14):
            x = slice(i, i + (1 << 14))
            mine, theirs = (k.view(np.uint8).reshape(len(k), -1)[:, :span] for k in (key[x], other[x]))
            differs = mine != theirs
            out[x] = np.where(differs.any(axis=1), differs.argmax(axis=1), span)
        return out

    def _reach(self, key: np.ndarray, level: np.ndarray | None) -> np.ndarray:
        """The longest prefix that each suffix shares with one of a level, or another of its own array:
        in sorted order that is one of the two neighbours."""
        reach = np.zeros(len(key), np.int64)
        if level is None:
            if len(key) > 1:
                common = self._common(key[:-1], key[1:])
                reach[:-1] = common
                reach[1:] = np.maximum(reach[1:], common)
            return reach
        at = np.searchsorted(level, key)
        for x in (at - 1, at):
            ok = np.flatnonzero((x >= 0) & (x < len(level)))
            reach[ok] = np.maximum(reach[ok], self._common(key[ok], level[x[ok]]))
        return reach

    def _open(self, of: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(contexts, number of windows) that may match given how far their suffixes do."""
        c = self.contexts
        many = np.minimum(c.size[of], c.left[of] - (c.span - reach) + 1)
        return of[many > 0], many[many > 0]

    def _scan(self, key: np.ndarray, of: np.ndarray, level: np.ndarray | None, owner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(context, window) of windows of the batch that stand earlier in the level (in itself if that is None)."""
        c, none = self.contexts, np.zeros(0, np.int64)
        mine = self._open(of, self._reach(key, level))
        if not len(mine[0]):
            return none, none
        context, window, mark = c.windows(*mine)
        if level is None:
            source, place, known = context, window, mark
        else:
            wanted = np.unique(c.heads(mine[0]))
            head = np.ascontiguousarray(level.view(np.uint8).reshape(len(level), -1)[:, : c.edge]).reshape(-1).view(f"S{c.edge}")
            near = np.minimum(np.searchsorted(wanted, head), len(wanted) - 1)
            near = np.flatnonzero(wanted[near] == head)
            source, place, known = c.windows(*self._open(owner[near], self._reach(level[near], key)))
            if not len(source):
                return none, none
        order = np.lexsort((c.rank[source], known))
        source, place, known = source[order], place[order], known[order]
        new = np.r_[True, known[1:] != known[:-1]]
        source, place, known = source[new], place[new], known[new]
        at = np.minimum(np.searchsorted(known, mark), len(known) - 1)
        hit = np.flatnonzero((known[at] == mark) & (c.rank[source[at]] < c.rank[context]))
        at = at[hit]
        hit = hit[c.equal(context[hit], window[hit], source[at], place[at])]
        return context[hit], window[hit]

    def settled(self, context: np.ndarray, window: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All repeats as (context, window), each once, with those of twins."""
        c = self.contexts
        of, first = (np.concatenate([t[i] for t in self.twins]) for i in (0, 1))
        root = np.arange(len(c.size))
        while len(of) and (root[of] != root[first]).any():
            root[of] = root[first]
        gone = np.zeros(len(c.size), bool)
        gone[whole] = True
        gone[of] |= gone[root[of]]
        own = np.flatnonzero(gone)
        n = c.size[own]
        pairs = [context * 256 + window, np.repeat(own, n) * 256 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if len(of):
            by = np.argsort(context, kind="stable")
            lo, hi = np.searchsorted(context[by], root[of]), np.searchsorted(context[by], root[of], "right")
            n = hi - lo
            pairs.append(np.repeat(of, n) * 256 + window[by[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]])
        pairs = np.unique(np.concatenate(pairs))
        return pairs >> 8, pairs & 255


def _ranked(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of places: by document, then within it; equal ones alike."""
    order = np.lexsort((at, doc))
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(np.r_[False, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])])[: len(doc)]
    return rank


def repeats(doc: np.ndarray, place: np.ndarray, suffix: np.ndarray, size: np.ndarray, data: np.ndarray, span: int, edge: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """(context, window), in order, of every repeated window among contexts, by index and place in the
    context; ``data`` holds the contexts one after the other."""
    rank = _ranked(doc, place + suffix)
    order = np.argsort(rank, kind="stable")
    family = SuffixFamily(Contexts(data, suffix, size, rank, span, edge))
    batch = max(batch, -(-len(doc) // MOST_BATCHES))
    found = [family.add(order[i : i + batch]) for i in range(0, len(doc), batch)]
    whole, context, window = (np.concatenate([f[i] for f in found]) for i in range(3))
    return family.settled(context, window, whole)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a are those from b."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 13):
        i = slice(at, at + (1 << 13))
        first = np.cumsum(n[i]) - n[i]
        step = np.arange(n[i].sum()) - np.repeat(first, n[i])
        out[i] = ~np.logical_or.reduceat(data[np.repeat(a[i], n[i]) + step] != data[np.repeat(b[i], n[i]) + step], first)
    return out


def _digests(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits of each context's bytes."""
    raw = data.tobytes() if len(begin) else b""
    return np.array([hashlib.blake2b(raw[a : a + m], digest_size=16).digest() for a, m in zip(begin.tolist(), n.tolist())], dtype="V16")


#: What travels of each context, in this order, before all their contents.
_KINDS = {"docs": np.int64, "marks": np.uint32, "places": np.int32, "suffixes": np.uint8, "sizes": np.uint8}


#: What travels of spans that a task has settled.
_SPANS = {"docs": np.int64, "marks": np.uint32, "starts": np.int32, "counts": np.int32}


def _mark(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def repeated_spans(docs: DataFrame, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """(doc_id, mark, start, n): windows start .. start + n - 1, in bytes, that also start earlier;
    ``mark`` is 32 bits of the text's hash, which tell rows with one doc_id apart."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("mark", _mark(F.col("text")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // PARTITION_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        held: dict[int, list] = {}
        size_held = 0

        def out() -> pa.RecordBatch:
            rows = []
            for part, share in sorted(held.items()):
                n, raw = packed(share, _SPANS if part < 0 else _KINDS)
                rows.append((part, n, squeeze(raw)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "packed"])

        seen: dict[str, np.ndarray] = {"key": np.zeros(0, np.uint64), "doc": np.zeros(0, np.int64), "digest": np.zeros(0, "V16")}
        for batch, start, data, offsets in text_pieces(batches, span - 1):
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            begin, size, suffix, row, head, whole = contexts(data, offsets, span, edge)
            if not len(begin):
                continue
            doc, place = ids[row], begin - offsets[row] + start[row]
            rank = _ranked(doc, place + suffix - begin)
            by = np.lexsort((rank, whole))
            group = np.flatnonzero(np.r_[True, whole[by][1:] != whole[by][:-1]])
            first = np.empty(len(by), np.int64)
            first[by] = np.repeat(by[group], np.diff(np.r_[group, len(by)]))
            length = size + span - 1
            settled = rank > rank[first]
            c = np.flatnonzero(settled)
            settled[c] = (size[c] == size[first[c]]) & (suffix[c] - begin[c] == suffix[first[c]] - begin[first[c]])
            c = c[settled[c]]
            settled[c] = _same_bytes(data, begin[c], begin[first[c]], length[c])
            if len(seen["key"]):
                found = np.minimum(np.searchsorted(seen["key"], whole), len(seen["key"]) - 1)
                c = np.flatnonzero(~settled & (seen["key"][found] == whole) & (seen["doc"][found] < doc))
                settled[c] = seen["digest"][found[c]] == _digests(data, begin[c], length[c])
            # those that have come twice are worth remembering, each with its least document
            again = np.unique(first[settled])
            again = again[~settled[again] | (first[again] == again)]
            key = np.r_[seen["key"], whole[again]]
            both = np.r_[seen["doc"], doc[again]]
            digest = np.concatenate([seen["digest"], _digests(data, begin[again], length[again])])
            if len(key) > _SEEN:
                key, both, digest = (x[len(seen["key"]) :][:_SEEN] for x in (key, both, digest))
            order = np.lexsort((both, key))
            key, both, digest = key[order], both[order], digest[order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            seen = {"key": key[new], "doc": both[new], "digest": digest[new]}
            # settled contexts that follow one another are one span, which need not pass its partition
            c = np.flatnonzero(settled)
            if len(c):
                cut = np.flatnonzero(np.r_[True, (row[c][1:] != row[c][:-1]) | (begin[c][1:] != (begin + size)[c][:-1])])
                total_ = np.add.reduceat(size[c], cut)
                c = c[cut]
                spans = {"docs": doc[c], "marks": marks[row[c]], "starts": place[c], "counts": total_}
                held.setdefault(-1 - int(mix64(doc[c[:1]].astype(np.uint64))[0] % np.uint64(parts)), []).append(({k: v.astype(_SPANS[k]) for k, v in spans.items()}, b""))
            part = ((mix64(head) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.flatnonzero(~settled)
            order = order[np.argsort(part[order], kind="stable")]
            of = part[order]
            for lo, hi in zip(b := np.flatnonzero(np.r_[len(of) > 0, of[1:] != of[:-1]]), np.r_[b[1:], len(of)]):
                c = order[lo:hi]
                n = size[c] + span - 1
                content = data[np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                fields = {"docs": doc[c], "marks": marks[row[c]], "places": place[c], "suffixes": (suffix - begin)[c], "sizes": size[c]}
                held.setdefault(int(of[lo]), []).append(({k: v.astype(_KINDS[k]) for k, v in fields.items()}, content.tobytes()))
            size_held += len(data)
            if size_held >= GATHER_BYTES:
                yield out()
                size_held = 0
        yield out()

    def join(name, table):
        import zstandard

        opened = zstandard.ZstdDecompressor().decompress
        rows = ((n, opened(x)) for n, x in zip(table.column("n").to_pylist(), table.column("packed").to_pylist()))
        if name[0].as_py() < 0:
            spans, _ = unpacked(rows, _SPANS)
            return pa.table({"doc_id": spans["docs"], "mark": spans["marks"].astype(np.int64), "start": spans["starts"], "n": spans["counts"]})
        c, contents = unpacked(rows, _KINDS)
        context, window = repeats(c["docs"], c["places"].astype(np.int64), c["suffixes"].astype(np.int64), c["sizes"].astype(np.int64), np.frombuffer(contents, np.uint8), span, edge)
        cut = _runs(window, context)
        at = context[cut]
        return pa.table({"doc_id": c["docs"][at], "mark": c["marks"][at].astype(np.int64), "start": (c["places"][at] + window[cut]).astype(np.int32), "n": np.diff(np.r_[cut, len(context)]).astype(np.int32)})

    return docs.mapInArrow(run, "part int, n long, packed binary").groupBy("part").applyInArrow(join, "doc_id long, mark long, start int, n int")


def _without(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """(bytes outside all spans, number of maximal removed runs); spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    start, reach = start[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]
    return b"".join(data[a:b].tobytes() for a, b in zip(np.r_[0, reach].tolist(), np.r_[start, len(data)].tolist())), len(start)


def kept_bytes(docs: DataFrame, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            lists = batch.column("_spans")
            flat = lists.flatten()
            count = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            start, n = (flat.field(c).to_numpy() for c in ("start", "n")) if len(flat) else (np.zeros(0, np.int64),) * 2
            kept, runs, at = [], [], 0
            for a, b, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), count.tolist()):
                left, many = _without(data[a:b], start[at : at + m], start[at : at + m] + n[at : at + m] + span - 1) if m else (data[a:b].tobytes(), 0)
                kept.append(left)
                runs.append(many)
                at += m
            size = np.diff(offsets)
            gone = size - np.array([len(x) for x in kept], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(gone), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(slim, span, edge).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("_spans")).withColumnRenamed("doc_id", "_id")
    joined = slim.join(spans, (F.col("doc_id") == F.col("_id")) & (_mark(F.col("text")) == F.col("mark")), "left")
    return joined.select("doc_id", "text", "_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return kept_bytes(docs, span, edge).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
