"""Near duplicates under weighted Jaccard similarity of word shingles, by BagMinHash.

A document is the multiset of its ``k``-word shingles. The weight axis is cut dyadically into
[0,1), [1,2), [2,4), ...; each shingle and interval below its weight has a Poisson process whose
points carry a time, a signature place and a position inside the interval. Points at positions at or
above the weight are thinned out, and the signature holds the least time per place, so two
signatures agree at a place with a probability of the weighted Jaccard similarity. Points are drawn
in rounds, for all documents of a slice at once, until none can lower a minimum.

Documents with the same multiset form one class, represented by its smallest doc_id. Bands of the
signatures make buckets of representatives. In a bucket, signatures tell which members may be
similar; a spanning set of these pairs, over all buckets, gives candidate groups. The pairs of this
set are verified first, on exact multisets. Where they leave a candidate group in several parts, the
documents of different parts are compared, block against block, so that every link between classes
counts, though a group that its own pairs join costs no more than these. The verified links give the
components. Neither buckets nor groups are ever expanded into pairs, and no link between classes is
lost except where no band agrees or the signature errs by five standard errors (together below 1e-6
at a similarity of 0.8).

The result is one row per document with its classes: of equal multisets, and of near duplicates.

Defined results: texts without words, null ones included, link with nothing and are kept; texts of
fewer than ``k`` words have one shingle of all their words; rows with the same doc_id count as one
document where their texts are equal, else each row is compared under that id; ties go to the smallest
doc_id; rows with a null doc_id take the class of an equal text and represent none; very long texts
are compared whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, mix64, shingle_starts, prefix_hash, range_hash, ship, text_slices, word_bounds, word_hashes, written
from .components import apart, components

#: Signature places, bands and places per band.
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Documents that one task compares with one another or with as many others.
BLOCK = 1024
#: Members of a bucket whose signatures one task compares with one another or with as many others.
BUCKET = 4096


def bags(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle of 48 bits, weight), sorted by document and shingle."""
    start, end, first = word_bounds(data, offsets)
    words = word_hashes(data, start, end)
    s, inverse = prefix_hash(words)
    at = shingle_starts(first, k)
    doc = np.searchsorted(first, at, "right") - 1
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    at, till = np.concatenate([at, first[short]]), np.concatenate([at + k, first[short] + sizes[short]])
    doc = np.concatenate([doc, short])
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (range_hash(s, inverse, at, till) >> np.uint64(16)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """n by ``places`` least times; infinite where a document has no shingle."""
    best = np.full(n * places, np.inf)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    seed = mix64(shingle[row] ^ (level.astype(np.uint64) << np.uint64(50)))
    document, bound, now = doc[row], weight[row].astype(np.float64), np.zeros(len(row))
    whole = low + width <= bound
    step = 0
    while len(seed):
        r = mix64(seed + np.uint64((2 * step + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        now = now - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        q = mix64(r ^ np.uint64(0x5851F42D4C957F2D))
        place = (q & np.uint64(0xFFFF)).astype(np.int64) * places >> 16
        inside = whole | (low + width * ((q >> np.uint64(16)).astype(np.float64) * 2.0**-48) < bound)
        np.minimum.at(best, document[inside] * places + place[inside], now[inside])
        worst = best.reshape(n, places).max(axis=1)
        go = now < worst[document]
        seed, document, bound, now, whole, low, width = (x[go] for x in (seed, document, bound, now, whole, low, width))
        step += 1
    return best.reshape(n, places)


def describe(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, bag binary(16), bands array<long>, low binary(PLACES)): low holds a byte of each
    place's value; bag, bands and low are null without words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches, limit=1 << 19):
            n = batch.num_rows
            doc, shingle, weight = bags(data, offsets, k)
            best = signatures(doc, shingle, weight, n)
            bits = best.view(np.uint64).reshape(n, BANDS, ROWS)
            band = mix64(np.arange(BANDS, dtype=np.uint64))[None, :].repeat(n, 0)
            for i in range(ROWS):
                band = mix64(band ^ bits[:, :, i])
            low = mix64(best.view(np.uint64)).astype(np.uint8)
            total = np.zeros(n, np.int64)
            np.add.at(total, doc, weight)
            bag = np.zeros((n, 2), np.uint64)
            mixed = mix64(shingle ^ mix64(weight.astype(np.uint64)))
            np.add.at(bag[:, 0], doc, mixed)
            np.add.at(bag[:, 1], doc, mix64(~mixed))
            some = total > 0
            flat = bag.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(total),
                    pa.array([flat[16 * i : 16 * i + 16] if x else None for i, x in enumerate(some)], pa.binary()),
                    pa.array([x if y else None for x, y in zip(band.view(np.int64), some)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if y else None for x, y in zip(low, some)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "bag", "bands", "low"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, bag binary, bands array<long>, low binary")


def expanded(docs: DataFrame, k: int = 5) -> DataFrame:
    """(id, items binary): the multiset as 64-bit items, shingle and number of the repeat; the two
    are hashed where the number is over 16 bits."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches, limit=1 << 19):
            doc, shingle, weight = bags(data, offsets, k)
            repeat = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            items = (np.repeat(shingle, weight) << np.uint64(16)) + (repeat & 65535).astype(np.uint64)
            far = np.flatnonzero(repeat > 65535)
            items[far] = mix64(items[far] ^ mix64((repeat[far] >> 16).astype(np.uint64)))
            cut = np.searchsorted(np.repeat(doc, weight), np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([items[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["id", "items"])

    return docs.select("id", "text").mapInArrow(run, "id long, items binary")


def overlaps(one: int, codes: np.ndarray, ends: np.ndarray, mark: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of document ``one`` with every document, by exact multisets."""
    own = codes[ends[one] : ends[one + 1]]
    mark[own] = True
    total = np.r_[0, np.cumsum(mark[codes])]
    mark[own] = False
    both = total[ends[1:]] - total[ends[:-1]]
    return both / np.maximum(lengths + lengths[one] - both, 1)


def links_within(ids: np.ndarray, items: list[np.ndarray], threshold: float, split: int | None = None, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links among documents; with ``split``, only between those before it and
    the rest. Documents of one ``part`` count as joined already. A document is compared with all
    others, unless it is already joined to all of them."""
    lengths = np.array([len(x) for x in items], np.int64)
    codes = np.unique(np.concatenate(items), return_inverse=True)[1]
    ends = np.r_[0, np.cumsum(lengths)]
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    label = np.arange(len(ids)) if part is None else np.unique(part, return_inverse=True)[1]
    out = []
    for i in range(len(ids) if split is None else split):
        begin = i + 1 if split is None else split
        if (label == label[0]).all():
            break
        if begin >= len(ids) or (label[begin:] == label[i]).all():
            continue
        near = np.flatnonzero(overlaps(i, codes, ends, mark, lengths)[begin:] >= threshold) + begin
        for j in near.tolist():
            if label[j] != label[i]:
                out.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, of rows that come sorted by them; small groups come several at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= x[0] != held[-1].column(k)[-1].as_py()
        cut = np.flatnonzero(change)
        if not len(cut):
            held.append(batch)
            continue
        if cut[-1] > 0:
            held.append(batch.slice(0, int(cut[-1])))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(int(cut[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def _sorted_by(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def blocked(bucketed: DataFrame) -> DataFrame:
    """The rows of buckets with several members, with the two blocks (i, j) that they are compared in and
    their own one (side); a bucket that is one block stays whole. ``bucketed`` has (bucket, id)."""
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = apart(sizes.select("bucket", F.expr(f"cast(ceil(members / {BUCKET}) as int)").alias("blocks")), "bucket", "k")
    placed = bucketed.join(sizes, F.col("bucket") == F.col("k")).withColumn("side", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    others = F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(side, x) AS i, greatest(side, x) AS j))"))
    return placed.withColumn("at", others).select(*bucketed.columns, "at.i", "at.j", "side")


def candidates(keyed: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of a spanning set, per two blocks of a bucket, of the pairs whose signatures agree well enough that
    their similarity may reach the threshold (five standard errors below it); keyed has (bucket, i, j, side,
    id, n, low)."""
    keys = ["bucket", "i", "j"]
    least = threshold - 5 * (threshold * (1 - threshold) / PLACES) ** 0.5
    least += (1 - least) / 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, keys):
            cut = _bounds(table, keys)
            ids, sizes, side, lower = (table.column(c).to_numpy() for c in ("id", "n", "side", "i"))
            across = table.column("j").to_numpy() != lower
            low = np.frombuffer(b"".join(x.as_py() for x in table.column("low")), np.uint8).reshape(-1, PLACES)
            u, v = [], []
            size = np.diff(cut)
            pairs = cut[:-1][size == 2]
            pairs = pairs[~across[pairs] | (side[pairs] != side[pairs + 1])]
            if len(pairs):
                ok = ((low[pairs] == low[pairs + 1]).mean(axis=1) >= least) & (np.minimum(sizes[pairs], sizes[pairs + 1]) >= threshold * np.maximum(sizes[pairs], sizes[pairs + 1]))
                u += ids[pairs[ok]].tolist()
                v += ids[pairs[ok] + 1].tolist()
            for a, b in zip(cut[:-1][size > 2], cut[1:][size > 2]):
                label = np.arange(b - a)
                split = int((side[a:b] == lower[a]).sum()) if across[a] else None  # the lower block comes first
                for i in range(b - a - 1 if split is None else split):
                    if i % 64 == 0 and (label == label[0]).all():
                        break
                    begin = i + 1 if split is None else split
                    rest = np.flatnonzero(label[begin:] != label[i]) + begin
                    if not len(rest):
                        continue
                    near = rest[(low[a + rest] == low[a + i]).mean(axis=1) >= least]
                    near = near[np.minimum(sizes[a + near], sizes[a + i]) >= threshold * np.maximum(sizes[a + near], sizes[a + i])]
                    for j in near.tolist():
                        if label[j] != label[i]:
                            u.append(int(ids[a + i]))
                            v.append(int(ids[a + j]))
                            label[label == label[j]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _sorted_by(keyed, keys, "side").mapInArrow(run, "u long, v long")


def _compared(sent: DataFrame, items: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(u, v) of links between the two sides of each group of ``keys``, or among all where there is one
    side; sent has (id, side, part) and the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, keys):
            cut = _bounds(table, keys)
            found = []
            for a, b in zip(cut[:-1], cut[1:]):
                some = table.slice(int(a), int(b - a))
                ids, side, part = (some.column(c).to_numpy() for c in ("id", "side", "part"))
                order = np.argsort(side, kind="stable")
                bags_ = [np.frombuffer(x.as_py(), np.uint64) for x in some.column("items")]
                split = int((side == side.min()).sum())
                found += links_within(ids[order], [bags_[x] for x in order], threshold, None if split == len(ids) else split, part[order])
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _sorted_by(sent.join(items, "id"), keys).mapInArrow(run, "u long, v long")


def confirmed(items: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (u, v) of ``edges`` that are links: each document with its own pairs, in blocks."""
    sizes = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)"))
    # documents with very many pairs are split over tasks
    ask = sizes.select(F.col("u").alias("star"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("u").alias("id"), F.lit(0).alias("side"))
    told = edges.join(apart(sizes, "u", "k"), F.col("u") == F.col("k")).select(F.col("u").alias("star"), F.expr("cast(pmod(xxhash64(v), blocks) as int)").alias("block"), F.col("v").alias("id"), F.lit(1).alias("side"))
    # parts of their own, so that nothing counts as joined
    return _compared(ask.union(told).withColumn("part", F.col("id")), items, ["star", "block"], threshold)


def remaining(items: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of a spanning set of the links between the parts of each group; parts has (id, component, part).

    The largest part of a group is compared with all others, and these with one another, block against
    block, each pair of blocks a task's work of its own. So a group that is one part costs nothing, and
    one with few documents outside its largest part is read about once.
    """
    sizes = parts.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy("component").agg(F.sum("n").alias("members"), F.max(F.struct("n", "part")).alias("major"), F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")
    groups = groups.select("component", F.col("major.part").alias("major"), F.expr(f"cast(ceil((members - major.n) / {BLOCK}) as int)").alias("p"), F.expr(f"cast(ceil(major.n / {BLOCK}) as int)").alias("q"))
    placed = parts.join(apart(groups, "component", "k"), F.col("component") == F.col("k")).withColumn("own", F.expr("if(part = major, p + pmod(xxhash64(id), q), pmod(xxhash64(id), p))").cast("int"))
    others = F.explode(F.expr("transform(sequence(0, if(part = major, p, p + q) - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j))"))
    sent = placed.withColumn("at", others).select("id", "component", "at.i", "at.j", F.col("own").alias("side"), "part")
    # where one of two blocks is empty, the other one is compared with itself once more, which finds nothing new
    return _compared(sent, items, ["component", "i", "j"], threshold)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of every row: the smallest doc_id with the
    same multiset, the smallest that links lead to, and whether that is the document itself."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = written(describe(docs, k), "signatures")
    classes = facts.where("bag IS NOT NULL").groupBy("bag").agg(F.min("doc_id").alias("class_id"))
    classes = classes.select(F.substring("bag", 1, 16).alias("k"), "class_id")  # as ``apart`` does, for very many copies of one text
    named = written(facts.select("doc_id", "n_shingles", "bag").join(classes, F.col("bag") == F.col("k"), "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    heads = facts.where("bag IS NOT NULL").join(classes, F.col("bag") == F.col("k")).where("doc_id = class_id").dropDuplicates(["bag"])
    heads = written(heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "low", "bands"), "heads")
    discard(facts)
    # buckets are found without the signatures' bytes, which then join the rows of shared buckets only
    bucketed = blocked(heads.select("id", F.explode("bands").alias("bucket")))
    keyed = bucketed.join(heads.select("id", "n", "low"), "id")
    edges = written(candidates(keyed, threshold), "pairs")
    labels = written(components(edges), "candidates")
    wanted = labels.select("id").hint("merge")
    items = expanded(docs.join(wanted, docs["doc_id"] == wanted["id"]).select("id", "text").dropDuplicates(["id", "text"]), k)
    items = written(items.where("octet_length(items) > 0"), "items")  # an id may have several texts, some without words
    near = written(confirmed(items, edges, threshold), "links")
    discard(edges)
    parts = labels.join(components(near).withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    more = remaining(items, written(parts, "parts"), threshold)
    joined = components(near.union(more)).withColumnsRenamed({"id": "class_id", "component": "_component"})
    return named.join(joined, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("_component", "class_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller doc_id; of rows with one doc_id
    and text, all stay. Rows with a null doc_id stay."""
    name = fresh(docs, "gone")
    goes = near_duplicates(docs, k, threshold).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(goes, F.col("doc_id").cast("long") == F.col(name), "left_anti")
