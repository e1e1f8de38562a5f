"""Removal of repeated byte strings against brute force: equal rows, null ids, long texts, zero bytes."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, suffixes

SPAN = 100


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base, passage = words(rng, 200), words(rng, 40)
    out = [(5, base), (5, base), (5, words(rng, 30) + passage + words(rng, 20)), (5, passage + "x" + words(rng, 30)), (9, base), (9, base), (None, base), (3, None), (2, ""), (1, "short")]
    out += [(11, "y" * 700), (12, "y" * 300 + passage), (12, "\0" * 500 + passage), (13, "\0" * 400 + "a" + passage), (4, words(rng, 20) + passage), (20, base[:350] + "Q" + base[350:]), (21, "é東" * 90 + passage)]
    for i in range(60):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(200)] = f"z{i}"
        out.append((30 + i // 2, " ".join(w) + passage[rng.randrange(50) :]))
    return out + [(100 + i, words(rng, 60, 5)) for i in range(30)]


def brute(rows):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - SPAN + 1 if d is not None else 0):
            k = b[a : a + SPAN]
            first[k] = min(first.get(k, (d, a)), (d, a))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - SPAN + 1 if d is not None else 0):
            if first[b[a : a + SPAN]] < (d, a):
                gone[a : a + SPAN] = b"\1" * SPAN
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def removed(rows, batch):
    live = [(d, t.encode()) for d, t in rows if d is not None and t]
    data, offsets = np.frombuffer(b"".join(b for _, b in live), np.uint8), np.cumsum([0] + [len(b) for _, b in live])
    begin, size, suffix, row, _, _ = suffixes.contexts(data, offsets, SPAN, 16)
    n = size + SPAN - 1
    content = data[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    ids = np.array([d for d, _ in live])
    context, window = suffixes.repeats(ids[row], begin - offsets[row], suffix - begin, size, content, SPAN, 16, batch)
    gone = [bytearray(len(b)) for _, b in live]
    for x, y in zip(context.tolist(), window.tolist()):
        a = begin[x] - offsets[row[x]] + y
        gone[row[x]][a : a + SPAN] = b"\1" * SPAN
    return [sum(g) for g in gone]


@pytest.mark.parametrize("batch", [1, 7, 50, 1 << 20])
def test_levels_find_every_repeat(rows, monkeypatch, batch):
    monkeypatch.setattr(suffixes, "MOST_BATCHES", 10**9)
    want = [x[2] for x in brute(rows) if x[0] is not None and x[1]]
    assert removed(rows, batch) == want


def test_matches_come_from_the_levels(rows, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_BATCHES", 10**9)
    add = suffixes.SuffixFamily.add

    def forgetful(self, batch):
        self.levels.clear()
        return add(self, batch)

    whole = sum(removed(rows, 50))
    monkeypatch.setattr(suffixes.SuffixFamily, "add", forgetful)
    assert sum(removed(rows, 50)) < whole


def test_levels_grow_geometrically(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("abcdefgh") for _ in range(40_000)).encode(), np.uint8)
    begin, size, suffix, _, _, _ = suffixes.contexts(data, np.array([0, len(data)]), SPAN, 16)
    n = size + SPAN - 1
    content = data[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    family = suffixes.SuffixFamily(suffixes.Contexts(content, suffix - begin, size, np.arange(len(begin)), SPAN, 16))
    for i in range(0, len(begin), 16):
        family.add(np.arange(i, min(i + 16, len(begin))))
        assert len(family.levels) <= 8
    sizes = [len(k) for k, _ in family.levels]
    assert sum(sizes) == len(begin) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert all((k[1:] > k[:-1]).all() for k, _ in family.levels)


def test_pieces_of_a_long_text_have_each_window_once():
    text = "".join(chr(97 + i * i % 26) for i in range(9_001))
    batch = pa.record_batch({"text": pa.array([text, "x" * 50], pa.large_string())})
    seen = []
    for _, start, data, offsets in common.text_pieces(iter([batch]), SPAN - 1, limit=1000):
        for at, a, b in zip(start, offsets[:-1], offsets[1:]):
            seen += [(int(at) + i, data[a + i : a + i + SPAN].tobytes().decode()) for i in range(b - a - SPAN + 1)]
    assert seen == [(i, text[i : i + SPAN]) for i in range(len(text) - SPAN + 1)]


def test_digest(spark, rows):
    rng = random.Random(4)
    long = words(rng, 250_000, 10**6)
    rows = [*rows, (500, long), (501, "before " + long[:1_200_000])]
    schema = "doc_id long, text string, mark string, _spans string, part string"
    docs = spark.createDataFrame([(i, t, "m", "s", "p") for i, t in rows], schema)
    got = suffixes.digest(docs.repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
    assert suffixes.digest(docs.limit(0)).count() == 0
