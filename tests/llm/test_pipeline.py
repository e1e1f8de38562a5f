import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline as pipeline
from tidemark.llm import bagminhash, debruijn, mixing, tokens, toxicity
from tidemark.llm.common import read


def test_stages(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "packing"]
    docs = read(spark, sf, "documents").cache()
    labels = read(spark, sf, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = pipeline.drop_toxic(spark, docs, sf).cache()
    bad = {r.doc_id for r in toxicity.toxic_scores(docs, labels).where("predicted = 1").collect()}
    assert ids(clean) == sorted(set(ids(docs)) - bad) and clean.columns == pipeline.COLUMNS
    single = pipeline.drop_near_duplicates(spark, clean, sf).cache()
    assert ids(single) == ids(bagminhash.near_duplicates(clean).where("kept"))
    cut = pipeline.drop_repeated_spans(spark, single, sf).cache()
    assert ids(cut) == ids(single)
    gone = {r.doc_id for r in debruijn.digest(single).where("n_removed > 0").collect()}
    before, after = ({r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in (single, cut))
    assert {i for i in before if before[i] != after[i]} == gone
    mixed = pipeline.mix_sources(spark, cut, sf)
    assert mixed.count() == mixing.taken(cut).agg({"copies": "sum"}).first()[0] and mixed.columns == pipeline.COLUMNS
    assert pipeline.run(spark, sf).count() > 0


def test_empty_input(spark, sf):
    docs = read(spark, sf, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def expected(rows):
    """(doc_id, tokens) of the packed documents, by brute force; without labels no document is toxic."""
    bags = {}
    for i, t in rows:
        w = split(t)
        bags[i] = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in bags.items():
        for j, b in bags.items():
            both = sum((a & b).values())
            if i is not None and j is not None and j < i and both and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                p, q = sorted((top(i), top(j)))
                root[q] = p
    kept = [(i, t) for i, t in rows if i is None or top(i) == i]
    first = {}
    for i, t in kept:
        w = split(t) if i is not None else []
        for a in range(len(w) - 49):
            first[tuple(w[a : a + 50])] = min(first.get(tuple(w[a : a + 50]), i), i)
    cut = []
    for i, t in kept:
        w = split(t)
        gone = [False] * len(w)
        for a in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        cut.append((i, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t))
    size = Counter()
    for i, t in cut:
        size[SOURCE(i)] += len(split(t))
    order = sorted((s for s in size if s), key=str) + [s for s in size if s is None]
    weight, target, free, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set(size), sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in full} if full else share
        left -= sum(3 * size[s] for s in full)
        free = free - full if full else set()
    bpe, out = tokens.word_bpe(tokens.default_path("word_bpe_49k.json")), []
    for i, t in cut:
        rate = target[SOURCE(i)] / size[SOURCE(i)] if size[SOURCE(i)] else 0
        draw = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(i, len(bpe.ids([t])[0]) + 1)] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    return out


def SOURCE(i):  # noqa: N802
    return None if i is None or i % 5 == 0 else f"s{i % 4}"


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base, passage, long = text(200), text(90), text(40_000)
    near = base.split()
    near[50] = "other"
    rows = [(1, base), (2, base), (3, " ".join(near)), (None, None), (None, base), (4, ""), (5, "  \n"), (6, text(30) + " " + passage + " " + text(40)), (7, passage + " " + text(25)), (8, None), (9, long), (10, long[:200_000])]
    rows += [(20 + i, text(20 + 7 * i)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, None, SOURCE(i), None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, None, None) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter()
    for r in pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id, r.doc_tokens] += r.length
    want = Counter()
    for i, n in expected(rows):
        want[i, n] += n
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, sf, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", None, 3, "x", "y"), (1, "a b", "en", None, 3, "x", "y"), (None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, score string, spans string")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == pipeline.COLUMNS and {r.doc_id for r in out.collect()} <= {1, None}, name
