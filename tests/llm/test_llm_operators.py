"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables, and extra columns with clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, bloomlm, common, components, lengths, media, mixing, packing, projections, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, part string, word string, mark string, _id string, score string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 300)
    near = base.split()
    for i in (5, 150):
        near[i] = "changed"
    passage = words(rng, 80)
    out = [base, base, " ".join(near), words(rng, 60) + " " + passage + " " + words(rng, 40), passage + "\n" + words(rng, 100), None, "", "   \t\n", "a", "one two three", "é" * 150 + " ß naïve 東京 don't", "x" * 700]
    out += [words(rng, rng.randrange(1, 200)) for _ in range(20)] + [words(rng, 6000), base]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is not None and i % 7 == 0 else f"src{(i or 0) % 4}", len(t or ""), "s", "p", "w", "m", "i", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_ids_equal_the_tokenizer(texts):
    bpe = tokens.word_bpe(tokens.default_path("word_bpe_49k.json"))
    samples = [t or "" for _, t in texts] + ["Don'T STOP", "3.14é", "a<|endoftext|>b", "İ ẞ ſ", "a\x1cb c d", "ﬁn ½ ① ǅ"]
    for text, ids in zip(samples, bpe.ids(samples)):
        assert ids.tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_histogram(docs, none, texts):
    bpe = tokens.byte_bpe(tokens.default_path("byte_bpe_50k.tiktoken"))
    n = [len(bpe.encode_ordinary(t)) if t else 0 for _, t in texts]
    got = {r.length: r for r in lengths.suffix_sums(lengths.histogram(docs)).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for limit, r in got.items():
        assert r.docs_ge == sum(x >= limit for x in n) and r.tokens_ge == sum(x for x in n if x >= limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in n) and abs(r.doc_quantile - sum(x <= limit for x in n) / len(n)) < 1e-9
    sums = lengths.suffix_sums(lengths.histogram(docs))
    for limit in (0, 3, 250, 10**6):
        assert lengths.total_at(sums, limit).first()[0] == sum(min(x, limit) for x in n)
    assert lengths.suffix_sums(lengths.histogram(none)).count() == 0


def test_packing(docs, none, texts):
    bpe = tokens.word_bpe(tokens.default_path("word_bpe_49k.json"))
    for capacity, window in ((2048, 1 << 20), (64, 256)):
        rows = packing.pack(docs, capacity=capacity, window=window).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        for i, t in texts:
            ids = np.array([*bpe.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                at += r.length
                assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
            assert at == len(ids)
        short = 0
        for pieces in by_sequence.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= capacity
            short += at < capacity
        assert short <= 3
    assert packing.pack(none).count() == 0


def test_packing_balances_cost():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 2048) for _ in range(400)]
    placed, left = packing.assign(sizes, 2048)
    cost, fill = Counter(), Counter()
    for _, _, n, s, _ in placed:
        cost[s] += n + n * n / 4096
        fill[s] += n
    assert set(fill.values()) == {2048} and sum(n for _, _, n in left) == sum(sizes) % 2048
    assert max(cost.values()) <= 3073


@pytest.mark.parametrize("small", [False, True])
def test_lm_scores(docs, texts, none, monkeypatch, small):
    if small:
        monkeypatch.setattr(bloomlm, "HEAD", 50)
        monkeypatch.setattr(bloomlm, "SHARD_CHARS", 5000)
        monkeypatch.setattr(bloomlm, "MAX_BROADCAST", 6000)
    got = {r.doc_id: r for r in bloomlm.score_texts(docs).collect()}
    token = {i: [*[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in split(t)], None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts}
    c = Counter(w for i, x in token.items() if not held[i] for w in x)
    total, distinct = sum(c.values()), len(c)
    for i, x in token.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(c[w] > 0 for w in x), total)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in x)) < 1e-6
        assert -1e9 < r.score < 0
    copies = [i for i, t in texts if t == texts[0][1] and held[i]]
    assert all(got[i].score > got[i].base_score for i in copies)
    assert bloomlm.score_texts(none).count() == 0


def test_lm_context_counts_do_not_depend_on_the_head(spark, monkeypatch):
    # "often" is common, "seldom" is a context seen 30 times and followed 4 times by "seen"
    train = ["often " * 400 + " ".join(f"r{i} r{i}" for i in range(200)), "seldom often " * 26 + "seldom seen " * 4]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    test = "seldom seen r1 r1 often seldom unseen unseen"
    rows = [*zip(ids, train), (held, test)]
    tokens_ = [[*t.split(), None] for t in train]
    c = Counter(w for x in tokens_ for w in x)
    pairs = Counter(p for x in tokens_ for p in zip([None, *x], x))
    floor = sum(c.values()) + 0.5 * (len(c) + 1)
    quantised = lambda n: bloomlm.LOG_BASE ** round(math.log(n) / math.log(bloomlm.LOG_BASE)) if n else 0
    x = [*test.split(), None]
    want = sum(math.log10(bloomlm.WEIGHT * quantised(pairs[h, w]) / max(c[h], quantised(pairs[h, w]), 1) + (1 - bloomlm.WEIGHT) * (c[w] + 0.5) / floor) for h, w in zip([None, *x], x))
    for head in (1 << 20, 20, 1, 0):
        monkeypatch.setattr(bloomlm, "HEAD", head)
        got = {r.doc_id: r.score for r in bloomlm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()}
        assert abs(got[held] - want) < 1e-6, head


def test_filter_counts():
    key = common.mix64(np.arange(20000, dtype=np.uint64))
    n = np.arange(20000) % 40 + 1
    f = bloomlm.Filter([(0, bloomlm.fill(key, n))], 1)
    got = f.count(key)
    expected = 1.5 ** (bloomlm._level(n) - 1)
    assert (got >= expected).all() and (got == expected).mean() > 0.97
    assert (f.count(common.mix64(np.arange(20000, 40000, dtype=np.uint64))) > 0).mean() < 0.02


def test_mixing(spark, docs, none, texts):
    got = mixing.taken(docs).collect()
    sizes, source = {i: len(split(t)) for i, t in texts}, {i: None if i % 7 == 0 else f"src{i % 4}" for i, _ in texts}
    total = Counter()
    for i in sizes:
        total[source[i]] += sizes[i]
    order = sorted((s for s in total if s), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(total), sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
        free -= full
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == sizes[r.doc_id] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        rate = target[s] / total[s] if total[s] else 0
        assert r.taken in (math.floor(rate) * r["size"], (math.floor(rate) + 1) * r["size"]) and r.taken <= 3 * r["size"]
    assert sorted(map(tuple, mixing.taken(docs).collect())) == sorted(map(tuple, got))
    assert mixing.taken(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_comes_near_targets(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    for r in mixing.taken(df).groupBy("target", "source_size").agg(F.sum("taken").alias("n"), F.count_distinct("source_size").alias("k"), F.count(F.lit(1)).alias("docs")).collect():
        sources = r.docs / 6000
        assert abs(r.n - r.target * sources) < 0.03 * r.target * sources


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, 30).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(30)] = rng.choice(["vilest", "rotter", "blighter"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return [*rows, (900, None), (901, "")], labels


def test_toxicity(spark, toxic_rows, none):
    rows, labels = toxic_rows
    label_frame = spark.createDataFrame([*labels, (1, 0, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs, label_frame).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    kept = toxicity.without_toxic(docs, label_frame)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.toxic_scores(none, label_frame).count() == 0
    assert {r.score for r in toxicity.toxic_scores(docs, label_frame.limit(0)).collect()} == {0.0}


def test_labels_of_held_out_rows_do_not_matter(spark, toxic_rows):
    rows, labels = toxic_rows
    docs = frame(spark, rows[:300])
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.toxic_scores(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flip)]
    assert scores[0] == scores[1]


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    near = base[:20] + 0.12 * rng.standard_normal((20, 16))
    cloud = base[0] + 0.05 * rng.standard_normal((80, 16))
    v = np.concatenate([base, near, cloud, base[:3], base[5:6] * 2])
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] * 8, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] * 16, 1), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in projections.near_vectors(df, window=20).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    root = list(range(len(v)))
    for _ in range(len(v)):
        root = [min(root[j] for j in np.flatnonzero(link[i])) for i in range(len(v))]
    assert {i: got[i].n_links for i in range(len(v))} == {i: int(link[i].sum()) - 1 for i in range(len(v))}
    assert {i: got[i].component_id for i in range(len(v))} == dict(enumerate(root))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1006))
    assert (got[1006].n_links, got[1007].component_id, got[1007].kept) == (1, 1006, False)
    assert projections.near_vectors(df.limit(0)).count() == 0


def test_embedding_links_in_a_crowd(spark):
    # a crowd of mean cosine 0.85 without links but those planted, at default settings
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    middle = unit(rng.standard_normal((1, 128)))
    v = unit(0.85**0.5 * middle + 0.15**0.5 * unit(rng.standard_normal((3000, 128))))
    v = np.concatenate([v, unit(v[:500] + 0.42 * unit(rng.standard_normal((500, 128))))])
    link = v @ v.T >= 0.9
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in projections.near_vectors(df).collect()}
    assert link.sum() > len(v) + 900
    assert [got[i] for i in range(len(v))] == (link.sum(axis=1) - 1).tolist()


@pytest.fixture(scope="module")
def spread(spark):
    """2,400 vectors spread evenly, the last 400 each near another one, as (id, vec)."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((2000, 32))
    v = np.concatenate([v, v[:400] + 0.35 * rng.standard_normal((400, 32))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.argwhere(v @ v.T >= 0.9)
    heads = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(3).cache()
    return heads, {(int(a), int(b)) for a, b in near if a > b}


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_windows_follow_the_order_over_borders(spark, spread, parts, monkeypatch):
    heads, links = spread
    # few passes and a small window, so that what the window holds decides; 60 tasks have fewer rows than it
    window, passes = 64, range(3)
    monkeypatch.setattr(spark.conf, "get", lambda key, *a, get=spark.conf.get: str(parts) if key == "spark.sql.shuffle.partitions" else get(key, *a))
    found = projections.window_links(heads, passes, window, 0.9, 7)
    got = {(max(r), min(r)) for r in found.collect()}
    want = set()
    keyed = projections.keys(heads, passes, 7, False).collect()
    for part in {r.part for r in keyed}:
        order = [r.id for r in sorted((r for r in keyed if r.part == part), key=lambda r: (r.key, r.id))]
        place = {i: n for n, i in enumerate(order)}
        want |= {(a, b) for a, b in links if abs(place[a] - place[b]) <= window}
    assert got <= want and 0 < len(want) < len(links)
    # a spanning set of them joins what they join
    whole = components.components(spark.createDataFrame(sorted(want), "u long, v long"))
    assert sorted(components.components(found).collect()) == sorted(whole.collect())


def test_windows_find_what_groups_do_not_hold(spark, spread):
    heads, links = spread
    passes, bits = projections.settings(2400, 0.9)
    assert (passes, bits) == (12, 4)
    none = projections.crowd_links(heads, range(passes), bits, projections.WINDOW, 0.9, 7).count()
    assert none == 0  # no group is more than a window holds, so all comes from the windows
    found = projections.neighbour_links(heads, passes, bits, projections.WINDOW, 0.9, 7)
    whole = components.components(spark.createDataFrame(sorted(links), "u long, v long"))
    assert sorted(components.components(found).collect()) == sorted(whole.collect())
    assert {tuple(r) for r in found.distinct().collect()} <= links


def test_projection_passes_grow_with_the_input():
    sizes = (10, 1 << 14, 10**5, 10**6, 10**8)
    passes = [projections.settings(n, 0.9) for n in sizes]
    assert passes == sorted(passes)
    for n, (p, bits) in zip(sizes, passes):
        assert n / 2**bits <= projections.WINDOW and (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** p <= projections.MISS


def test_media_round_trip(docs, none, texts):
    def run(x):
        return media.features(media.correct(media.store_texts(x)))

    stored = {r.doc_id: r for r in media.correct(media.store_texts(docs)).collect()}
    got = {r.doc_id: r for r in run(docs).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        put, take = media.STORED[stored[i].detected_type]
        value = put(padded)
        assert (r.media_bytes, r.media_sha256) == (len(value), hashlib.sha256(value).hexdigest()) and take(value) == padded
        mean = sum(padded) // len(padded)
        inside = ",".join(f"{t}@{a}+{n}" for t, a, n in media.sniff(padded))
        said = stored[i].media_type
        assert r.feature == f"type={stored[i].detected_type};corrected={int(said is not None and said != stored[i].detected_type)};samples={len(padded)};mean={mean};embedded={inside}"
    assert got[0].feature == got[1].feature and len({r.detected_type for r in stored.values()}) == 2 and any(r.corrected for r in stored.values())
    assert run(none).count() == 0


def png():
    def part(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", bytes(13)) + part(b"IDAT", zlib.compress(b"\0")) + part(b"IEND", b"")


def test_sniffing(spark):
    wav, image = media.to_wav(b"ab" * 32), png()
    bmp = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24) + bytes(8)
    gif = b"GIF89a" + bytes(4) + b"\0\0\0" + b"\x21\xf9\x04" + bytes(4) + b"\0" + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"data\xff\x00more" + b"\xff\xd9"
    for value, kind in ((wav, "audio/wav"), (image, "image/png"), (bmp, "image/bmp"), (gif, "image/gif"), (jpeg, "image/jpeg"), (b"%PDF-1.4 x %%EOF", "application/pdf")):
        assert media.sniff(value) == [(kind, 0, len(value))], kind
        assert media.sniff(value[:-1]) == [] or kind == "application/pdf"
        assert media.verdict(value, "text/plain") == (kind, True, [])
    assert media.sniff(b"junk" + image + b"--" + jpeg) == [("image/png", 4, len(image)), ("image/jpeg", 6 + len(image), len(jpeg))]
    assert media.sniff(media.to_wav(image + bytes(len(image) % 2)))[0][0] == "audio/wav"
    rows = [(1, image, "image/jpeg"), (2, None, "image/png"), (3, b"", "image/png"), (4, b"plain", "text/plain"), (5, b"x" + image, None)]
    frame_ = spark.createDataFrame([*rows, rows[0], (None, None, None)], "id int, content binary, media_type string").withColumn("embedded", F.lit(1))
    rows_ = media.correct(frame_.withColumnRenamed("embedded", "Corrected")).collect()
    assert len(rows_) == len(rows) + 2 and rows_[0].Corrected == 1 and rows_[0]._corrected is True
    got = {r.id: r for r in media.correct(frame_.drop("embedded")).collect()}
    assert media.correct(frame_.limit(0)).count() == 0
    assert (got[1].detected_type, got[1].corrected) == ("image/png", True) and got[2].detected_type is None
    assert got[3].detected_type == media.UNKNOWN and got[4].detected_type == "text/plain" and bytes(got[5].embedded[0].content) == image


def test_sniffing_takes_linear_time():
    whole = b"PK\x03\x04" + bytes(40) + b"PK\x05\x06" + bytes(8) + (0).to_bytes(4, "little") + (44).to_bytes(4, "little") + bytes(2)
    assert media.sniff(whole) == [("application/zip", 0, len(whole))]
    assert media.sniff(b"%PDF-1 " * 5 + b"%%EOF" + whole) == [("application/pdf", 0, 40), ("application/zip", 40, len(whole))]
    for piece in (b"%PDF-1 ", b"PK\x03\x04", b"OggS\0" + bytes(22), b"GIF89a" + bytes(4) + b"\0\0\0" + b"\x21\xf9\x04" + bytes(4) + b"\0", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cddata"):
        took = []
        for n in (40_000, 320_000):
            value = piece * n
            began = time.perf_counter()
            media.sniff(value)
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * took[0] + 0.5, piece


def chunk(kind, body):
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def many_png(size):
    """Images that each claim one block up to the end of the value."""
    head, out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)), b""
    while len(out) < size:
        out += head + max(0, size - len(out) - len(head) - 12).to_bytes(4, "big") + b"IDAT" + bytes(4)
    return out[:size] + chunk(b"IEND", b"")


def many_wav(size):
    """Sounds that each claim another end behind a long chain of empty blocks."""
    out = b"".join(b"RIFF" + (size - 12 * i - 8 + i % 7 * 8).to_bytes(4, "little") + b"WAVE" for i in range(size // 24))
    return out + (b"junk" + bytes(4)) * ((size - len(out)) // 8)


@pytest.mark.parametrize("make", [many_png, many_wav])
def test_images_and_sounds_take_linear_time(make):
    took = []
    for size in (1 << 17, 1 << 20):
        value = make(size)
        began = time.perf_counter()
        assert media.sniff(value) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 0.5


def test_long_checksums_and_chains():
    rng = random.Random(0)
    image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", rng.randbytes(50_000)) + chunk(b"tEXt", rng.randbytes(9_000)) + chunk(b"IEND", b"")
    spoilt = image[:20_000] + b"?" + image[20_001:]
    inner = image[: 8 + 25] + (len(spoilt)).to_bytes(4, "big") + b"IDAT" + spoilt + bytes(4) + chunk(b"IEND", b"")
    assert media.sniff(b"BM" + image) == [("image/png", 2, len(image))] and media.sniff(spoilt) == [] == media.sniff(inner)
    # a spoilt image whose last blocks are also those of a sound one
    body = image[8:]
    broken = b"\x89PNG\r\n\x1a\n" + (8 + 0).to_bytes(4, "big") + b"IHDR" + bytes(4) + b"\x89PNG\r\n\x1a\n"
    assert media.sniff(broken + body) == [("image/png", len(broken) - 8, len(image))]
    value = media.Value()
    for _ in range(50):
        a, b = sorted(rng.sample(range(len(image)), 2))
        assert value.checksum(image, a, b) == zlib.crc32(image[a:b])
    sound = media.to_wav(b"ab" * 500)
    long = b"RIFF" + (4 + 8 * 3000 + len(sound) - 12).to_bytes(4, "little") + b"WAVE" + (b"junk" + bytes(4)) * 3000 + sound[12:]
    assert media.sniff(long) == [("audio/wav", 0, len(long))] and media.sniff(b"RIFF" + long) == [("audio/wav", 4, len(long))]
    assert media.sniff(long[:12] + b"data" + long[16:-1]) == [] and media.sniff(long.replace(b"fmt ", b"fmt_")) == []


def bag(t, k=5):
    w = split(t)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_signatures_are_unbiased():
    rng = random.Random(0)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(base), " ".join(base[:110] + ["x"] * 10), " ".join(base[:30] * 5), " ".join(base[:30] * 3 + base[60:]), "a b", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    s = bagminhash.signatures(*bagminhash.bags(data, offsets, 5), len(texts), places=2048)
    for i in range(5):
        for j in range(i):
            assert abs((s[i] == s[j]).mean() - similarity(bag(texts[i]), bag(texts[j]))) < 0.06


def test_near_duplicates(spark, docs, none, texts, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 8)
    rng = random.Random(9)
    base = words(rng, 150, 10**6).split()
    group = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        group.append((1000 + i, " ".join(w)))
    rows = list(texts) + group
    got = {r.doc_id: r for r in bagminhash.near_duplicates(frame(spark, rows)).collect()}
    bags = [(i, bag(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if a and b and similarity(a, b) >= 0.8:
                p, q = sorted((top(i), top(j)))
                root[q] = p
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i, _ in rows}
    assert all(got[i].n_shingles == sum(b.values()) and got[i].kept == (got[i].component_id == i) for i, b in bags)
    assert got[1].class_id == 0 and got[2].class_id == 2
    assert bagminhash.near_duplicates(none).count() == 0


def test_blocks_of_a_bucket_give_its_candidates(spark, monkeypatch):
    """One bucket of 90 members in blocks joins what it joins as a whole."""
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 256, (9, bagminhash.PLACES), dtype=np.uint8)
    rows = [(1, int(i), 50 if i % 9 else 50 + int(i) // 45 * 50, bytearray(kinds[i % 9].tobytes())) for i in rng.permutation(90)] + [(2, 500, 5, bytearray(kinds[0].tobytes())), (2, 501, 5, bytearray(kinds[0].tobytes()))]
    found = []
    for block in (4096, 16):
        monkeypatch.setattr(bagminhash, "BUCKET", block)
        keyed = bagminhash.blocked(spark.createDataFrame(rows, "bucket long, id long, n long, low binary"))
        edges = bagminhash.candidates(keyed, 0.8)
        found.append({(r.id, r.component) for r in components.components(edges).collect()})
    groups = {tuple(sorted(i for i, c in found[0] if c == k)) for k in {c for _, c in found[0]}}
    assert found[0] == found[1] and len(groups) == 8 + 2 + 1  # those of kind 0 are of two sizes


def test_near_duplicates_of_each_text_under_one_id(spark):
    rng = random.Random(4)
    texts_ = [words(rng, 100, 10**6) for _ in range(4)]
    rows = [(1, t) for t in texts_] + [(2 + i, t + " more") for i, t in enumerate(texts_)] + [(1, None), (9, words(rng, 100, 10**6))]
    got = {(r.doc_id, r.component_id) for r in bagminhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(i, 1) for i in range(1, 6)} | {(9, 9)}


def test_repeats_beyond_16_bits(spark):
    rng = random.Random(4)
    rows = [(0, "x " * 90_004 + words(rng, 20_000, 10**9)), (1, "x " * 100_004)]
    items = {r.id: np.frombuffer(r["items"], np.uint64) for r in bagminhash.expanded(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert all(len(np.unique(x)) == len(x) for x in items.values()) and len(items[1]) == 100_000
    both = len(np.intersect1d(items[0], items[1]))
    assert both == 90_000
    assert bagminhash.links_within(np.array([0, 1]), [items[0], items[1]], 0.8) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, 305), (305, 310), (7, 7), (0, 1)] + [(500, x) for x in range(501, 560)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(201)} == {0} and got[310] == 300 and {got[i] for i in range(500, 560)} == {500}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
