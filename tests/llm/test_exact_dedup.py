from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from glossmill.llm import exact_dedup as X
from glossmill.llm.common import collapse_spaces


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)


def test_fingerprints_combine():
    own = X.Fingerprinter()
    data = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8)
    for cut in (0, 1, 255, 256, 257, 9_999, 20_000):
        parts = own.of(data, np.array([0, cut, len(data)]))
        assert (own.combine(parts[0], parts[1], len(data) - cut) == own.of(data, np.array([0, len(data)]))[0]).all()


def test_huge_text_has_the_same_fingerprint_alone_and_among_others():
    own = X.Fingerprinter()
    big = np.random.default_rng(2).integers(0, 256, 3_000_001).astype(np.uint8)
    both = np.concatenate([np.arange(10, dtype=np.uint8), big, np.arange(7, dtype=np.uint8)])
    got = own.of(both, np.array([0, 10, 10 + len(big), 10 + len(big), len(both)]))
    half = own.of(big, np.array([0, 1_234_567, len(big)]))
    assert (got[1] == own.combine(half[0], half[1], len(big) - 1_234_567)).all() and (got[2] == 0).all()


def test_spaces_collapse_over_blocks(monkeypatch):
    monkeypatch.setattr("glossmill.llm.common.BLOCK", 3)
    texts = ["a  b\n\n", "  ", "", "\tx", "y\r\n z \x0b\x0c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    out, offsets = collapse_spaces(data, np.concatenate(([0], np.cumsum([len(x) for x in texts]))))
    assert [out[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)] == [normal(x) for x in texts]


@pytest.mark.parametrize("primes", [X.PRIMES, (3, 5, 7, 11)])
def test_groups_equal_brute_force_even_when_fingerprints_collide(spark, documents, prose, primes):
    texts = [prose(i % 40, 12) for i in range(120)] + ["", None, " ", "\n\t ", "a b", "a\n b", "x" * 70_000, "x" * 70_000 + "y"]
    texts += ["".join(p) for p in ("ab", "ba", "ac", "ca", "bc")] + [prose(3, 12).replace(" ", "\n  ")]
    rows = [((i * 7919) % 1009, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in X.exact_groups(spark, documents(rows), primes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute(rows)


def test_null_and_repeated_ids_keep_exactly_one_row(spark, documents):
    rows = [(None, "a"), (None, "a"), (None, "b"), (5, "b"), (5, "b"), (7, "b")]
    got = X.exact_groups(spark, documents(rows)).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got if r["kept"]} == {(None, 2), (5, 4)}
    assert sum(r["kept"] for r in got) == 2
    kept = X.drop_copies(spark, documents(rows))
    assert kept.columns == documents(rows).columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "a"), (5, "b")]


def test_empty(spark, documents):
    assert X.exact_groups(spark, documents([])).isEmpty() and X.drop_copies(spark, documents([])).isEmpty()


def test_columns_called_like_helpers_keep_their_values(spark):
    rows = [(1, "a b", "S", 77, "x", "k"), (2, "a  b", "T", 78, "y", "l"), (3, None, "U", 79, "z", "m"), (3, None, "U", 79, "z", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _spread long, sha string, SAME string")
    assert sorted(map(tuple, X.drop_copies(spark, docs).collect())) == [rows[0], rows[2]]


def test_hot_groups_are_joined_without_a_shuffle_of_their_rows(spark, documents):
    rows = [(i if i % 5 else None, "copy" if i % 3 else f"own {i}") for i in range(4000)]
    got = X.exact_groups(spark, documents(rows)).select("doc_id", "keep_id", "group_size", "kept").collect()
    copies = [r for r in got if r["group_size"] > 1]
    assert len(got) == len(rows) and len(copies) == sum(t == "copy" for _, t in rows)
    assert {(r["keep_id"], r["group_size"]) for r in copies} == {(1, len(copies))} and sum(r["kept"] for r in got) == 1 + len(rows) - len(copies)
