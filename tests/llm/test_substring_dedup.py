from __future__ import annotations

import hashlib
import random
import tempfile
from collections import Counter

import numpy as np
import pytest

from glossmill.llm import induced as I
from glossmill.llm import substring_dedup as D


def brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    windows = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if windows[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def suffixes(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("memory", [1 << 20, 1])
def test_sorter_equals_sorted_suffixes_in_memory_and_on_disk(memory, monkeypatch):
    r = random.Random(3)
    if memory == 1:
        monkeypatch.setattr(I, "PART", 7)
    with tempfile.TemporaryDirectory() as folder:
        for _ in range(150):
            n, symbols = r.randint(1, 120), r.choice([2, 3, 5, 40])
            own = [r.randint(1, symbols) for _ in range(n)]
            own = (own[: max(1, n // 4)] * 5)[:n] if r.random() < 0.4 else own
            sorter = I.Sorter(np.array([*own, 0], np.uint16), symbols + 1, folder, memory, 200)
            sorter.limit = memory if memory > 1 else 3  # recursion and spilled queues
            places, shared = zip(*sorter.neighbours(), strict=True)
            assert (np.concatenate(places).tolist(), np.concatenate(shared).tolist()) == suffixes([*own, 0])


@pytest.mark.parametrize("span", [1 << 15, 16])
def test_recursion_over_ranges_of_names_equals_sorted_suffixes(span, monkeypatch):
    for name, x in (("SHORT", 2), ("MANY", 2), ("RANGE", span)):
        monkeypatch.setattr(I, name, x)
    r = random.Random(7)
    with tempfile.TemporaryDirectory() as folder:
        for _ in range(150):
            n, symbols = r.randint(1, 190), r.choice([2, 3, 5, 40, 300])
            own = [r.randint(1, symbols) for _ in range(n)]
            own = (own[: max(1, n // 9)] * 12)[:n] if r.random() < 0.5 else own
            text = np.array([*own, 0], np.int64)
            assert I.Sorter(text, symbols + 1, folder, 1 << 20).order().tolist() == suffixes([*own, 0])[0]
            sorter = I.Sorter(text, symbols + 1, folder, 300, 200)
            places, shared = zip(*sorter.neighbours(), strict=True)
            assert (np.concatenate(places).tolist(), np.concatenate(shared).tolist()) == suffixes([*own, 0])


@pytest.mark.parametrize("limit", [1 << 22, 64])
def test_windows_of_a_shard_with_few_tuples_in_memory(limit):
    r = random.Random(5)
    runs = ["".join(r.choice("ab") for _ in range(60)).encode() for _ in range(30)]
    runs += [runs[0][5:55] + b"zz", b"a" * 90, bytes(range(256))]
    windows = Counter(x[k : k + 12] for x in runs for k in range(len(x) - 11))
    with tempfile.TemporaryDirectory() as folder:
        found = D.repeated_windows(runs, 12, folder, limit)
    expected = [k + 12 <= len(x) and windows[x[k : k + 12]] > 1 for x in runs for k in range(len(x))]
    assert found.tolist() == expected


def test_anchors_share_windows_out_and_depend_on_content_alone():
    r = np.random.default_rng(1)
    texts = [r.integers(97, 100, n).astype(np.uint8) for n in (0, 199, 200, 201, 5_000)] + [np.full(1_000, 97, np.uint8)]
    data, offsets = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    lows, counts, hashes = D.anchors(data, offsets)
    of = {}
    for low, n, h in zip(lows.tolist(), counts.tolist(), hashes.tolist(), strict=True):
        for w in range(low, low + n):
            assert of.setdefault(data[w : w + 200].tobytes(), h) == h
    assert counts.sum() == sum(max(0, len(x) - 199) for x in texts)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3_000, "range_bytes": 400, "shard_bytes": 2_000}])
def test_equals_brute_force(spark, documents, prose, sizes):
    passage, line = prose(99, 60), prose(98, 45)
    texts = [prose(i, 90) for i in range(12)] + [prose(3, 90)] * 5 + [None, "", "x" * 450, "Und " * 120, passage[:199], passage[:200]]
    texts += [f"{prose(50 + i, 20)} {passage} {prose(70 + i, 20)} {line}é{line}" for i in range(6)] + [passage + passage[:150], "ü" * 120, "ü" * 120]
    rows = list(enumerate(texts)) + [(None, passage)]
    table = documents(rows).coalesce(1)
    got = sorted((tuple(r) for r in D.remove_repeats(spark, table, **sizes).collect()), key=str)
    assert got == brute(rows)
    blocks, ranges = D.covered_ranges(spark, table, **sizes)
    assert (blocks.count() > 2) == bool(sizes) and ranges.count() >= blocks.filter("block >= 0").count() // 2  # the sizes reach the workers


def test_empty(spark, documents):
    assert D.remove_repeats(spark, documents([])).isEmpty()
    assert D.remove_repeats(spark, documents([(1, None)])).first()["n_bytes"] == 0
