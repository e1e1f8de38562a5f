"""Removal of long repeated word spans, by compaction of a de Bruijn graph of token k-mers.

An edge of the graph is a window of ``span`` consecutive words, its nodes are the first and the last
``span`` - 1 of them; a document is a walk. Edges meet in partitions named by the k-mer of ``edge``
words with the least hash in a window (its minimiser, leftmost on ties), so equal windows meet
wherever they stand, and windows of a document that share a minimiser travel as one run.

1. A partition finds the edges that stand in several documents, the first place of each, and which of
   them follow one another. Where an edge has a single successor that has it as its single
   predecessor, over all their places, the two are on one nonbranching path; such paths end at
   branches, at dead ends and at the borders of runs. A path is named by its first place.
2. Paths that end at the border of a run are joined, on the node there, with those that begin there.
   Where exactly one path enters a node and one leaves it, and the second goes on in the source where
   the first ends, they are one path; chains of them are numbered along the source's coordinates,
   which takes the place of a join per doubling.
3. Every place that has an earlier source takes its path's number by a join on the source coordinates;
   neighbours of one path become one span.
4. A span and its source are verified: both documents give a digest of the words themselves at these
   coordinates, and digests of one source span that differ make the whole run anew with another hash.

Windows that repeat within a task are settled there against the smallest document that the task has
seen, and their spans go straight to step 4, so a passage that very many documents share enters the
graph about once per task. Partitions grow in number with the input; nothing is collected or
broadcast.

Defined results: null, empty and short texts have no window and stay, very long ones are treated whole;
rows with a null doc_id stay and are no source; rows with the same doc_id, equal ones included, are
never each other's source; ties among sources go to the first place; an empty table gives no rows;
other columns are kept by ``without_repeats`` and clash with none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, mix64, packed, prefix_hash, range_hash, shingle_starts, ship, text_slices, unpacked, word_bounds, word_hashes, written

SPAN, EDGE = 50, 25
PARTITION_CHARS = 4_000_000
#: Bytes of text whose runs a task gathers before it sends them to their partitions.
GATHER_BYTES = 16 << 20
_SEEN = 1 << 19


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i : i + n] for each i that has n values."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def windows(s: np.ndarray, inverse: np.ndarray, first: np.ndarray, span: int, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, document, hash, hash of the minimising k-mer) of every window, given the prefix hash of the words."""
    at = shingle_starts(first, span)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return at, at, none, none
    place = np.arange(len(s) - edge)
    edges = range_hash(s, inverse, place, place + edge)
    ranked = (edges >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
    least = sliding_least(ranked, span - edge + 1)[at] & np.uint64(0xFFFFFFFF)
    return at, np.searchsorted(first, at, "right") - 1, range_hash(s, inverse, at, at + span), edges[least.astype(np.int64)]


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where a new run begins: neighbours go on if each array stays, the first one growing by one."""
    n = len(same[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = same[0][1:] != same[0][:-1] + 1
        for x in same[1:]:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _local(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each window's key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    least = np.empty_like(doc)
    if len(k):
        least[order] = np.repeat(np.minimum.reduceat(doc[order], new), np.diff(np.r_[new, len(k)]))
    return least


def _first_of(key: np.ndarray, order: np.ndarray | None = None, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(order by key, begin of each group there, and with ``whole`` the index of each one's first in
    ``order``, by default as they are)."""
    by = np.argsort(key if order is None else key[order], kind="stable")
    by = by if order is None else order[by]
    k = key[by]
    new = np.flatnonzero(np.r_[len(k) > 0, k[1:] != k[:-1]])
    if not whole:
        return by, new, None
    first = np.empty(len(k), np.int64)
    first[by] = np.repeat(by[new], np.diff(np.r_[new, len(k)]))
    return by, new, first


#: What travels of each run of windows before the windows' hashes, and of each span that a task has settled.
_RUNS = {"docs": np.int64, "marks": np.uint32, "starts": np.int32, "sizes": np.int32, "edges": np.uint64, "heads": np.uint64, "tails": np.uint64}
_SPANS = {"docs": np.int64, "marks": np.uint32, "starts": np.int32, "counts": np.int32, "src_docs": np.int64, "src_marks": np.uint32, "src_starts": np.int32}
_PIECE = "doc_id long, mark long, start int, n int, src_doc long, src_mark long, src_start int, head long, tail long, is_path boolean"
_SPAN_KEY = ["src_doc", "src_mark", "src_start", "n"]


def _mark(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def _pieces(of: dict[str, np.ndarray], head=None, tail=None) -> pa.Table:
    n = len(of["doc_id"])
    out = {c: pa.array(x.astype(np.int32 if c in ("start", "n", "src_start") else np.int64)) for c, x in of.items()}
    for c, x in (("head", head), ("tail", tail)):
        out[c] = pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64), mask=x == 0)
    return pa.table(out | {"is_path": pa.array(np.full(n, head is not None))})


def graph_pieces(docs: np.ndarray, marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tails: np.ndarray, key: np.ndarray) -> tuple[pa.Table, pa.Table]:
    """(places that have an earlier source, paths) of runs whose windows have the ``key`` one after the other."""
    runs = np.lexsort((starts, docs))
    base = (np.cumsum(sizes) - sizes)[runs]
    docs, marks, starts, sizes, heads, tails = (x[runs] for x in (docs, marks, starts, sizes, heads, tails))
    begin = np.cumsum(sizes) - sizes
    by, new, _ = _first_of(key[np.repeat(base - begin, sizes) + np.arange(len(key))], whole=False)
    size = np.diff(np.r_[new, len(key)])
    several = np.flatnonzero(size > 1)
    run_of = lambda i: np.searchsorted(begin, i, "right") - 1
    shared = several[docs[run_of(by[new[several]])] != docs[run_of(by[new[several] + size[several] - 1])]]
    # from here on only windows that stand in several documents, in the order of their places
    n = size[shared]
    group = np.cumsum(n) - n
    window = by[np.repeat(new[shared] - group, n) + np.arange(n.sum())]
    source, edge = np.repeat(window[group], n), np.repeat(np.arange(len(n)), n)
    del by, new, size, several
    order = np.argsort(window)
    place_of = np.empty(len(order), np.int64)
    place_of[order] = np.arange(len(order))
    window, source, edge = window[order], source[order], edge[order]
    run, src_run = run_of(window), run_of(source)
    # what follows and precedes each edge: an edge, -1 for nothing shared, -2 for the border of a run
    after, before = np.full(len(window), -1), np.full(len(window), -1)
    near = (window[1:] == window[:-1] + 1) & (run[1:] == run[:-1])
    after[:-1][near], before[1:][near] = edge[1:][near], edge[:-1][near]
    after[(window == (begin + sizes - 1)[run]) & (tails[run] != 0)] = -2
    before[(window == begin[run]) & (heads[run] != 0)] = -2

    def single(x):
        x = x[place_of]
        return (np.minimum.reduceat(x, group) == np.maximum.reduceat(x, group))[edge] if len(x) else np.zeros(0, bool)

    one_after, one_before = single(after), single(before)
    at = np.flatnonzero(np.r_[len(window) > 0, ~(near & one_after[:-1] & one_before[1:])])
    n = np.diff(np.r_[at, len(window)])
    late = docs[run[at]] > docs[src_run[at]]

    def rows(i, n):
        place, src_place = starts[run[i]] + window[i] - begin[run[i]], starts[src_run[i]] + source[i] - begin[src_run[i]]
        return {"doc_id": docs[run[i]], "mark": marks[run[i]], "start": place, "n": n, "src_doc": docs[src_run[i]], "src_mark": marks[src_run[i]], "src_start": src_place}

    own = source[at] == window[at]
    i, last = at[own], (at + n - 1)[own]
    none = np.uint64(0)
    head = np.where((before[i] == -2) & one_before[i], heads[run[i]], none)
    tail = np.where((after[last] == -2) & one_after[last], tails[run[last]], none)
    return _pieces(rows(at[late], n[late])), _pieces(rows(i, n[own]), head, tail)


def _graph(docs: DataFrame, span: int, edge: int, seed: int) -> DataFrame:
    """Rows of ``_PIECE``: places with an earlier source, and the paths of each partition."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("mark", _mark(F.col("text")))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + chars // PARTITION_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        spans: dict[int, list] = {}
        gathered: list[dict[str, np.ndarray]] = []
        size_held = 0

        def out() -> pa.RecordBatch:
            held = []
            for part, share in spans.items():
                n, raw = packed(share, _SPANS)
                held.append((part, n, squeeze(raw)))
            if gathered:
                one = {c: np.concatenate([g[c] for g in gathered]) for c in gathered[0]}
                order = np.argsort(one["part"], kind="stable")
                base = np.cumsum(one["sizes"]) - one["sizes"]
                of = one["part"][order]
                for lo, hi in zip(b := np.flatnonzero(np.r_[len(of) > 0, of[1:] != of[:-1]]), np.r_[b[1:], len(of)]):
                    r = order[lo:hi]
                    z = one["sizes"][r]
                    n, raw = packed([({c: one[c][r] for c in _RUNS}, b"")], _RUNS)
                    held.append((int(of[lo]), n, squeeze(raw) + one["six"][np.repeat(base[r] - (np.cumsum(z) - z), z) + np.arange(z.sum())].tobytes()))
            spans.clear()
            gathered.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*held)) or [()] * 3, (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "packed"])

        seen = {"key": np.zeros(0, np.uint64), "doc": np.zeros(0, np.int64), "mark": np.zeros(0, np.int64), "place": np.zeros(0, np.int64)}
        for batch, data, offsets in text_slices(batches):
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            start, end, first = word_bounds(data, offsets)
            words = word_hashes(data, start, end)
            s, inverse = prefix_hash(mix64(words + np.uint64(seed)) if seed else words)
            at, row, key, edges = windows(s, inverse, first, span, edge)
            if not len(at):
                continue
            doc, mark, place = ids[row], marks[row], at - first[row]
            by_id = np.argsort(ids, kind="stable")
            number = np.empty(len(ids), np.int64)
            number[by_id] = np.arange(len(ids))
            _, _, source = _first_of(key, np.argsort(number[row], kind="stable"))
            src = {"doc": doc[source], "mark": mark[source], "place": place[source]}
            if len(seen["key"]):
                found = np.minimum(np.searchsorted(seen["key"], key), len(seen["key"]) - 1)
                earlier = (seen["key"][found] == key) & (seen["doc"][found] < src["doc"])
                src = {c: np.where(earlier, seen[c][found], x) for c, x in src.items()}
            settled = doc > src["doc"]
            again, where = np.unique(key[settled], return_index=True)
            both = {"key": np.r_[again, seen["key"]][:_SEEN]} | {c: np.r_[x[settled][where], seen[c]][:_SEEN] for c, x in src.items()}
            key_, where = np.unique(both["key"], return_index=True)
            seen = {c: x[where] for c, x in both.items()}
            c = np.flatnonzero(settled)
            if len(c):
                cut = _runs(place[c], row[c], src["doc"][c], src["mark"][c], place[c] - src["place"][c])
                n, c = np.diff(np.r_[cut, len(c)]), c[cut]
                fields = dict(zip(_SPANS, (doc[c], mark[c], place[c], n, *(x[c] for x in src.values()))))
                spans.setdefault(-1 - int(mix64(doc[c[:1]].astype(np.uint64))[0] % np.uint64(parts)), []).append((fields, b""))
            c = np.flatnonzero(~settled)
            six = np.ascontiguousarray(key[c].view(np.uint8).reshape(-1, 8)[:, :6])
            cut = _runs(place[c], row[c], edges[c])
            size, c = np.diff(np.r_[cut, len(c)]), c[cut]
            last = c + size - 1
            one, none = np.uint64(1), np.uint64(0)
            heads = np.where(place[c] > 0, range_hash(s, inverse, at[c], at[c] + span - 1) | one, none)
            tails = np.where(at[last] + span < first[1:][row[last]], range_hash(s, inverse, at[last] + 1, at[last] + span) | one, none)
            part = ((mix64(edges[c]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            gathered.append(dict(zip(_RUNS, (doc[c], mark[c], place[c].astype(np.int32), size, edges[c], heads, tails))) | {"part": part, "six": six})
            size_held += len(data)
            if size_held >= GATHER_BYTES:
                yield out()
                size_held = 0
        yield out()

    def join(name, table):
        import zstandard

        rows, hashes = [], []
        for n, x in zip(table.column("n").to_pylist(), table.column("packed").to_pylist()):
            opened = zstandard.ZstdDecompressor().decompressobj()
            rows.append((n, opened.decompress(x)))
            hashes.append(opened.unused_data)
        if name[0].as_py() < 0:
            c, _ = unpacked(rows, _SPANS)
            return _pieces(dict(zip(("doc_id", "mark", "start", "n", "src_doc", "src_mark", "src_start"), c.values())))
        c, _ = unpacked(rows, _RUNS)
        six = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, :6] = six
        size = c["sizes"].astype(np.int64)
        key = np.repeat(mix64(c["edges"]), size) + wide.view(np.uint64)[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        return pa.concat_tables(graph_pieces(c["docs"], c["marks"].astype(np.int64), c["starts"].astype(np.int64), size, c["heads"], c["tails"], key))

    return docs.mapInArrow(run, "part int, n long, packed binary").groupBy("part").applyInArrow(join, _PIECE)


def compacted(graph: DataFrame) -> DataFrame:
    """(src_doc, src_mark, src_start, path): the paths of ``graph`` (rows of ``_PIECE``) with the first
    place of the path that they are part of, once those are joined that meet in nonbranching nodes."""
    paths = graph.where("is_path").select("src_doc", "src_mark", "src_start", "n", "head", "tail")
    enter = paths.where("tail IS NOT NULL").groupBy("tail").agg(F.count(F.lit(1)).alias("entering"), F.min(F.expr("struct(src_doc, src_mark, src_start + n AS src_start)")).alias("end"))
    leave = paths.where("head IS NOT NULL").groupBy("head").agg(F.count(F.lit(1)).alias("leaving"), F.min(F.struct("src_doc", "src_mark", "src_start")).alias("begin"))
    links = enter.join(leave, F.col("tail") == F.col("head")).where("entering = 1 AND leaving = 1 AND end = begin").select("begin.*", F.lit(True).alias("goes_on"))
    along = Window.partitionBy("src_doc", "src_mark").orderBy("src_start")
    return (
        paths.select("src_doc", "src_mark", "src_start")
        .join(links, ["src_doc", "src_mark", "src_start"], "left")
        .withColumn("path", F.last(F.when(F.col("goes_on").isNull(), F.col("src_start")), ignorenulls=True).over(along))
        .drop("goes_on")
    )


def repeated_spans(docs: DataFrame, span: int = SPAN, edge: int = EDGE, seed: int = 0) -> DataFrame:
    """(doc_id, mark, start, n, src_doc, src_mark, src_start): windows start .. start + n - 1, in words of
    the document, that also start, there, in a source with a smaller doc_id; ``mark`` is of the text's hash."""
    ship(docs.sparkSession)
    graph = written(_graph(docs, span, edge, seed), "graph")
    places = graph.where("NOT is_path").drop("head", "tail", "is_path").join(compacted(graph), ["src_doc", "src_mark", "src_start"], "left")
    along = Window.partitionBy("doc_id", "mark").orderBy("start", "src_doc", "src_mark", "src_start")
    same = [F.lag(c).over(along).eqNullSafe(F.col(c)) for c in ("src_doc", "src_mark", "path")]
    follows = same[0] & same[1] & same[2] & F.expr("path IS NOT NULL") & (F.lag(F.expr("start + n")).over(along) == F.col("start")) & (F.lag(F.expr("src_start + n")).over(along) == F.col("src_start"))
    spans = places.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("number", F.sum("new").over(along))
    firsts = [F.first(c).alias(c) for c in ("src_doc", "src_mark")]
    out = spans.groupBy("doc_id", "mark", "number").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), *firsts, F.min("src_start").alias("src_start")).drop("number")
    out = written(out, "spans")
    discard(graph)
    return out


def _with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with an array of the spans to remove and of those that are their sources, and that column's name."""
    name, id_, mark = (fresh(docs, c) for c in ("spans", "span_id", "span_mark"))
    own = spans.select("doc_id", "mark", F.struct("start", "n", "src_doc", "src_mark", "src_start", F.lit(True).alias("goes")).alias("x"))
    sources = spans.select(*_SPAN_KEY).distinct()
    sources = sources.select("src_doc", "src_mark", F.struct(F.col("src_start").alias("start"), "n", "src_doc", "src_mark", "src_start", F.lit(False).alias("goes")).alias("x"))
    every = own.union(sources).groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).agg(F.collect_list("x").alias(name))
    return docs.join(every, (F.col("doc_id").cast("long") == F.col(id_)) & (_mark(F.col("text")) == F.col(mark)), "left").drop(id_, mark), name


def _each(batch: pa.RecordBatch, name: str, span: int) -> Iterator[tuple[list[bytes], list[bytes], list[dict]]]:
    """(words, kept words, digests of source spans) of each row."""
    lists = batch.column(name)
    flat = lists.flatten()
    some = len(flat) > 0
    start, n, goes = (flat.field(c).to_numpy(zero_copy_only=False) if some else np.zeros(0, np.int64) for c in ("start", "n", "goes"))
    keys = list(zip(*(flat.field(c).to_pylist() for c in _SPAN_KEY))) if some else []
    size = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    end = np.cumsum(size)
    for text, a, b in zip(batch.column("text").to_pylist(), end - size, end):
        words = (text or "").encode().split()
        if a == b:
            yield words, words, []
            continue
        till = start[a:b] + n[a:b] + span - 1
        checks = [dict(zip(_SPAN_KEY, key), digest=hashlib.blake2b(b" ".join(words[i:j]), digest_size=16).digest()) for key, i, j in zip(keys[a:b], start[a:b].tolist(), till.tolist())]
        gone = np.zeros(len(words) + 1, np.int32)
        np.add.at(gone, start[a:b], goes[a:b].astype(np.int32))
        np.add.at(gone, np.minimum(till, len(words)), -goes[a:b].astype(np.int32))
        yield words, [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g], checks


_CHECK = pa.list_(pa.struct([("src_doc", pa.int64()), ("src_mark", pa.int64()), ("src_start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))
_CHECK_SQL = "array<struct<src_doc:long,src_mark:long,src_start:int,n:int,digest:binary>>"


def _verified(docs: DataFrame, span: int, edge: int, applied, attempts: int = 3) -> DataFrame:
    """The rows of ``applied`` (docs with spans, name of that column, name for the digests), written, once
    no span's words differ from its source's; else all is done again with another hash."""
    for seed in range(attempts):
        spans = repeated_spans(docs, span, edge, seed)
        checks = fresh(docs, "checks")
        out = written(applied(*_with_spans(docs, spans), checks), "removed")
        discard(spans)
        said = out.where(F.size(checks) > 0).select(F.explode(checks).alias("c")).select("c.*").groupBy(*_SPAN_KEY).agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
        if said.where("a <> b").limit(1).count() == 0:
            return out.drop(checks)
        discard(out)
    raise RuntimeError(f"spans differ from their sources under {attempts} hashes")


def digest(docs: DataFrame, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def applied(joined: DataFrame, name: str, checks: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, _ in text_slices(batches):
                n, gone, sha, said = [], [], [], []
                for words, kept, own in _each(batch, name, span):
                    n.append(len(words))
                    gone.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    said.append(own)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(said, _CHECK)], ["doc_id", "n_words", "n_removed", "kept_sha256", checks])

        return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string, {checks} {_CHECK_SQL}")

    return _verified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), span, edge, applied)


def without_repeats(docs: DataFrame, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """``docs`` with repeated spans out of the texts: where words went, those kept are joined by one
    space, and n_chars, if there is such a column, is counted anew. No row goes."""
    own = docs.columns
    types = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def applied(joined: DataFrame, name: str, checks: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, _ in text_slices(batches):
                texts, said = [], []
                for text, (words, kept, seen) in zip(batch.column("text").to_pylist(), _each(batch, name, span)):
                    texts.append(text if len(words) == len(kept) else b" ".join(kept).decode())
                    said.append(seen)
                changed = pa.array(texts, batch.column("text").type)
                columns = {c: batch.column(c) for c in own} | {"text": changed}
                if "n_chars" in own:
                    same = pa.compute.fill_null(pa.compute.equal(changed, batch.column("text")), True)
                    columns["n_chars"] = pa.compute.if_else(same, batch.column("n_chars"), pa.compute.utf8_length(changed).cast(batch.column("n_chars").type))
                columns[checks] = pa.array(said, _CHECK)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return joined.mapInArrow(run, f"{types}, `{checks}` {_CHECK_SQL}")

    return _verified(docs, span, edge, applied)
