"""Near duplicates among vectors by sorted projection passes.

A pass hashes every distinct vector to the signs of ``KEY_BITS`` random projections, written one after the
other, and orders the vectors by these keys. Each vector is compared, in double precision, with the
``window`` vectors that follow it in this order, over the borders of tasks too: rows near a border are
gathered there by their places in the whole order. Pairs at or above the threshold are links.

A window cannot hold a crowd, so a pass also compares, block by block, all vectors of those groups that
agree in the first ``bits`` signs of their keys and are more than a window holds. Together a pass compares
every pair that agrees there; a pair at the threshold does so with the probability
(1 - arccos(threshold) / pi) ** bits, whatever other vectors there are. The bits follow from the number of
distinct vectors, so that a group of evenly spread ones fills half a window, and there are as many passes as
make a pair miss all of them with a probability of at most ``MISS``. Passes run ``ROUND`` at a time, and the
verified links of all make the components. Inside these every pair is compared, block against block, so link
counts are exact there however large a component is, and only counts leave a block.

Equal vectors form one class, compared once. Defined results: vectors that are null, empty, zero or
hold null or non-finite components link with nothing; vectors of different dimensions are never
compared; an empty table gives no rows; other columns, whatever their names, are ignored; repeated
vec_ids are rows of their own in counts and share a component; ties go to the smallest vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, written
from .components import apart, components

WINDOW, KEY_BITS, MISS = 512, 62, 1e-4
#: Passes of one job, which sorts the vectors once for each of them.
ROUND = 8
#: Vectors that one task compares with one another, or with as many others.
BLOCK = 4096


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision; the largest component is scaled first, so that no norm over- or underflows."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def settings(n: int, threshold: float, window: int = WINDOW) -> tuple[int, int]:
    """(passes, bits) for ``n`` distinct vectors."""
    bits = min(KEY_BITS, max(1, math.ceil(math.log2(max(1, 2 * n / window)))))
    share = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return (1 if share >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-share))), bits


def _spanning(ids: np.ndarray, x: np.ndarray, threshold: float, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links among unit vectors; with ``split``, only between those before it and the rest."""
    label = np.arange(len(ids))
    out = []
    for at in range(0, len(ids) if split is None else split, 256):
        till, start = min(at + 256, len(ids) if split is None else split), at if split is None else split
        near = x[at:till] @ x[start:].T >= threshold
        for i in np.flatnonzero(near.any(axis=1)) + at:
            to = np.flatnonzero(near[i - at]) + start
            for j in to[label[to] != label[i]].tolist():
                if label[j] != label[i]:
                    out.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
    return out


def keys(heads: DataFrame, passes: range, seed: int, vectors: bool) -> DataFrame:
    """(part, key, id) and, if wanted, vec, of every vector and pass; ``part`` is the pass and the dimension."""
    kind = dict(heads.dtypes)["vec"]
    weights = np.int64(1) << np.arange(KEY_BITS, dtype=np.int64)[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            size = np.diff(batch.column("vec").offsets.to_numpy())
            for dim in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dim))
                for p in passes:
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([seed, dim, p]).standard_normal((dim, KEY_BITS)).astype(np.float32)
                for at in range(0, part.num_rows, 2048):
                    piece = part.slice(at, 2048)
                    unit = _unit(piece.column("vec"), dim).astype(np.float32)
                    for p in passes:
                        key = (unit @ planes[p, dim] > 0) @ weights
                        columns = [pa.array(np.full(piece.num_rows, p << 32 | dim, np.int64)), pa.array(key), piece.column("id")]
                        yield pa.RecordBatch.from_arrays([*columns, piece.column("vec")][: 3 + vectors], ["part", "key", "id", "vec"][: 3 + vectors])

    return heads.select("id", "vec").mapInArrow(run, "part long, key long, id long" + f", vec {kind}" * vectors)


def _pairs(ids: np.ndarray, x: np.ndarray, begin: int, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links of the rows from ``begin`` on with those at most ``window`` rows before them."""
    near = np.argwhere(x[begin:] @ x.T >= threshold)
    near[:, 0] += begin
    near = near[(near[:, 1] < near[:, 0]) & (near[:, 0] - near[:, 1] <= window)]
    label, out = np.arange(len(ids)), []
    while len(near):
        # the first link of each row joins its group; links inside a group say nothing new
        near = near[label[near[:, 0]] != label[near[:, 1]]]
        for i, j in near[np.unique(near[:, 0], return_index=True)[1]].tolist():
            if label[i] != label[j]:
                out.append((ids[j], ids[i]))
                label[label == label[j]] = label[i]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


_SORTED = "border long, place long, part long, id long, u long, v long, n long"


def window_links(heads: DataFrame, passes: range, window: int, threshold: float, seed: int, held: list[DataFrame] | None = None) -> DataFrame:
    """(u, v) of a spanning set, per window, of the links at most ``window`` places apart in the order of a pass;
    ``heads`` has (id, vec). What is written for it goes to ``held``, to be discarded when it has been read."""
    spark = heads.sparkSession
    kind = dict(heads.dtypes)["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held, place, tail = None, 0, []

        def border(rows: pa.Table, first: int) -> pa.RecordBatch:
            n = rows.num_rows
            return _batch(rows, np.full(n, task), first + np.arange(n))

        def _batch(rows: pa.Table, at: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
            blank = pa.nulls(len(at), pa.int64())
            vec = rows.column("vec").combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(places), rows.column("part").combine_chunks(), rows.column("id").combine_chunks(), blank, blank, blank, vec], [*_NAMES, "vec"])

        for batch in batches:
            for lo in range(0, batch.num_rows, window):
                rows = pa.Table.from_batches([batch.slice(lo, window)])
                if place < window:  # the first rows of the task
                    yield border(rows.slice(0, window - place), place)
                both = rows if held is None else pa.concat_tables([held, rows])
                parts, begin = both.column("part").to_numpy(), both.num_rows - rows.num_rows
                for part in np.unique(parts[begin:]).tolist():
                    of = np.flatnonzero(parts == part)
                    some = both.slice(int(of[0]), len(of))
                    x = _unit(some.column("vec").combine_chunks(), part & 0xFFFFFFFF)
                    u, v = _pairs(some.column("id").to_numpy(), x, max(0, begin - int(of[0])), window, threshold)
                    if len(u):
                        none, empty = pa.nulls(len(u), pa.int64()), pa.nulls(len(u), both.schema.field("vec").type)
                        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(u), pa.array(v), none, empty], [*_NAMES, "vec"])
                place += rows.num_rows
                held = both.slice(max(0, both.num_rows - window))
                tail = both.schema
        if held is not None:
            first = max(min(window, place), place - window)  # what has not been told as first rows
            yield border(held.slice(held.num_rows - (place - first)), first)
            one = [pa.array([x], pa.int64()) for x in (task, None, None, None, None, None, place)]
            yield pa.RecordBatch.from_arrays([*one, pa.nulls(1, tail.field("vec").type)], [*_NAMES, "vec"])

    def meet(key, table):
        rank = table.column("rank").to_numpy()
        order = np.argsort(rank, kind="stable")
        rank, parts = rank[order], table.column("part").to_numpy()[order]
        u, v = [], []
        for part in np.unique(parts).tolist():
            of = order[parts == part]
            some = table.take(pa.array(of))
            split = int((rank[parts == part] < key[1].as_py()).sum())
            if 0 < split < len(of):
                a, b = _pairs(some.column("id").to_numpy(), _unit(some.column("vec").combine_chunks(), part & 0xFFFFFFFF), split, window, threshold)
                u.append(a)
                v.append(b)
        none = [np.zeros(0, np.int64)]
        return pa.table({"u": np.concatenate(u + none), "v": np.concatenate(v + none)})

    keyed = keys(heads, passes, seed, True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "key", "id"]
    told = written(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, f"{_SORTED}, vec {kind}"), "windows")
    if held is not None:
        held.append(told)
    inside = told.where("u IS NOT NULL").select("u", "v")
    # how many rows each task has sorted, a number a task, gives every row near a border its place in the whole order
    sizes = sorted((r.border, r.n) for r in told.where("n IS NOT NULL").select("border", "n").collect())
    if len(sizes) < 2:
        return inside
    base, total = {}, 0
    for task, n in sizes:
        base[task], total = total, total + n
    starts = spark.createDataFrame([(t, b) for t, b in base.items()], "border long, base long")
    ranked = told.where("id IS NOT NULL").join(F.broadcast(starts), "border").select((F.col("base") + F.col("place")).alias("rank"), "part", "id", "vec")
    # a row meets the borders that are at most a window away; where tasks have few rows these are several
    edges = np.array(sorted(base.values())[1:], np.int64)
    near = spark.createDataFrame([(int(e), int(x)) for e in edges for x in range(int(e - window) // window, int(e + window) // window + 1)], "edge long, cell long")
    placed = ranked.withColumn("cell", F.expr(f"cast(floor(rank / {window}) as long)")).join(F.broadcast(near), "cell").where(f"rank >= edge - {window} AND rank < edge + {window}")
    across = placed.select("edge", F.col("edge").alias("at"), "rank", "part", "id", "vec").groupBy("edge", "at").applyInArrow(meet, "u long, v long")
    return inside.union(across)


_NAMES = ["border", "place", "part", "id", "u", "v", "n"]


def crowd_links(heads: DataFrame, passes: range, bits: int, window: int, threshold: float, seed: int, held: list[DataFrame] | None = None) -> DataFrame:
    """(u, v) of a spanning set, per block, of the links in groups of one prefix that no window holds."""

    def compare(key, table):
        i, j = key[2].as_py(), key[3].as_py()
        own = table.column("own").to_numpy()
        order = np.argsort(own, kind="stable")
        vectors = table.column("vec").combine_chunks()
        x = _unit(vectors, len(vectors.flatten()) // table.num_rows)
        found = _spanning(table.column("id").to_numpy()[order], x[order], threshold, None if i == j else int((own == i).sum()))
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    keyed = written(keys(heads, passes, seed, False).select("part", F.shiftrightunsigned("key", KEY_BITS - bits).alias("prefix"), "id"), "keys")
    if held is not None:
        held.append(keyed)
    sizes = keyed.groupBy("part", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window + 1)
    sizes = sizes.select(F.shiftleft("part", 0).alias("p"), F.shiftleft("prefix", 0).alias("q"), F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("blocks"))
    placed = keyed.join(sizes, (F.col("part") == F.col("p")) & (F.col("prefix") == F.col("q"))).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    sent = placed.withColumn("at", others).select("part", "prefix", "at.i", "at.j", "own", "id").join(heads.select("id", "vec"), "id")
    return sent.groupBy("part", "prefix", "i", "j").applyInArrow(compare, "u long, v long")


def neighbour_links(heads: DataFrame, passes: int, bits: int, window: int, threshold: float, seed: int) -> DataFrame:
    """(u, v) of the links that the passes find, written round by round."""
    out = None
    for first in range(0, passes, ROUND):
        some = range(first, min(first + ROUND, passes))
        held: list[DataFrame] = []
        links = window_links(heads, some, window, threshold, seed, held).union(crowd_links(heads, some, bits, window, threshold, seed, held))
        links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(*held)
        out = links if out is None else out.union(links)
    return out


def link_counts(heads: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, links): rows, over all of its component, that each id links to; heads has (id, vec, rows)."""
    member = written(heads.join(labels, "id"), "members")
    sizes = apart(member.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component", "k")
    placed = member.join(sizes, F.col("component") == F.col("k")).withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    # named anew, so that the blocks of a component are dealt apart and not as the join has dealt the component
    sent = placed.withColumn("at", others).select(F.shiftleft("component", 0).alias("whole"), "at.i", "at.j", "own", "id", "vec", "rows")

    def count(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own, ids, rows = (table.column(c).to_numpy() for c in ("own", "id", "rows"))
        vectors = table.column("vec").combine_chunks()
        x = _unit(vectors, len(vectors.flatten()) // table.num_rows)
        one, other = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(one), 256):
            asks = one[at : at + 256]
            near = x[asks] @ x[other].T >= threshold
            if i == j:
                near[np.arange(len(asks)), at + np.arange(len(asks))] = False
            else:
                links[other] += rows[asks].astype(np.int64) @ near
            links[asks] += near @ rows[other].astype(np.int64)
        return pa.table({"id": ids, "links": links})

    return sent.groupBy("whole", "i", "j").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, bits: int | None = None, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept, class_id) of every row of ``vectors`` (vec_id, embedding);
    passes and bits that are not given follow from the number of distinct vectors."""
    ship(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    sound = F.expr("vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vec, x -> x <> 0)")
    good = rows.where(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    classes = written(good.groupBy("vec").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("rows")), "classes")
    # an id whose rows hold different vectors may represent several classes: these get names beyond all ids, and are linked to it
    shared = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id")
    some = shared.limit(1).count() > 0
    classes = classes.withColumn("id", F.col("class_id"))
    if some:
        nth = F.row_number().over(Window.partitionBy("class_id").orderBy("vec"))
        several = classes.join(shared, "class_id", "left_semi").withColumn("nth", nth)
        several = several.withColumn("id", F.when(F.col("nth") == 1, F.col("class_id")).otherwise(F.shiftrightunsigned(F.xxhash64("class_id", "nth"), 2) + F.lit(1 << 62))).drop("nth")
        classes = written(classes.join(shared, "class_id", "left_anti").union(several), "classes")
    named = written(good.join(classes, "vec").select("vec_id", "class_id", "id", "rows"), "vectors")
    heads = classes.select("id", "vec", "rows")
    derived = settings(heads.count(), threshold, window)
    passes, bits = derived[0] if passes is None else passes, derived[1] if bits is None else bits
    links = neighbour_links(heads, passes, bits, window, threshold, seed)
    found = written(components(links), "labels")
    labels = found
    if some:  # rows of one id share a component, whatever their vectors
        same = named.where("id <> class_id").select(F.col("id").alias("u"), F.col("class_id").alias("v")).distinct()
        # an id that stands in classes of other ids too brings them together
        same = same.union(named.where("vec_id <> class_id").select(F.col("vec_id").alias("u"), F.col("id").alias("v")).join(named.groupBy("vec_id").agg(F.count_distinct("id").alias("n")).where("n > 1").withColumnRenamed("vec_id", "u"), "u", "left_semi"))
        labels = written(components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).union(same)), "labels")
    linked = labels.join(link_counts(heads, found, threshold), "id", "left")
    out = named.join(linked, "id", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"), "class_id"
    )
    rest = rows.where(~F.coalesce(sound, F.lit(False)) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").alias("class_id"))
    return out.union(rest).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")
