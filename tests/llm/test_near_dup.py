from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import near_dup as N
from glossmill.llm.common import utf8_buffers
from glossmill.llm.words import WordHasher, shingles


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").split(" ") if t else []
        w = [x for x in w if x]
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, similarity=0.8):
    sets = sets_of(rows)
    by = defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    distinct = list(by)
    links, parent = Counter(), {s: s for s in distinct}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(distinct, 2):
        common = len(a & b)
        if common and common >= similarity * (len(a) + len(b) - common) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[top(a)] = top(b)
    parts = defaultdict(list)
    for s in distinct:
        parts[top(s)] += by[s]
    return sorted((i, min(parts[top(s)]), min(by[s]), links[s]) for i, s in sets.items())


def edited(text, r, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def corpus(prose):
    r = random.Random(7)
    rows = [prose(i, 80) for i in range(60)]
    base = prose(1000, 200)
    rows += [edited(base, r, r.randint(1, 3)) for _ in range(70)]  # a large group, not all of it linked
    rows += [edited(prose(2000 + i, 120), r, n) for i in range(20) for n in (0, 1, 2, 4)]
    return [*rows, rows[0], rows[0], "one two", "one two", "", None, " ", "a b c d e", "a b c d e f"]


def leaf_levels(spark, docs, tuning):
    """How many leaves lie at each level."""
    from glossmill.llm.common import row_ids

    signed = row_ids(docs.select("doc_id", "text")).mapInArrow(N._sign, "row_uid long, doc_id long, sig binary, n long, sketch binary")
    full = signed.filter("n > 0").dropDuplicates(["sig"]).select(F.monotonically_increasing_id().alias("rid"), "sketch")
    full = N.materialize(spark, full, "t")
    leaves, _ = N._leaves(spark, full, N.runs_for(N.SIMILARITY, N.RECALL), tuning)
    return {r["level"]: r["n"] for r in leaves.groupBy("level").agg(F.count_distinct("key").alias("n")).collect()}


TUNINGS = [N.Tuning(), N.Tuning(listed=4, side=8), N.Tuning(listed=4, split=30, side=8), N.Tuning(split=4, shrink=1.0), N.Tuning(listed=4, split=1, shrink=1.0, side=8)]


@pytest.mark.parametrize("tuning", TUNINGS)
def test_links_and_classes_equal_brute_force(spark, documents, prose, tuning):
    rows = list(enumerate(corpus(prose)))
    got = sorted(tuple(r) for r in N.jaccard_join(spark, documents(rows), tuning=tuning).select("doc_id", "class_id", "rep_id", "n_links").collect())
    want = brute(rows)
    assert [x[0::2] for x in got] == [x[0::2] for x in want]
    missed = sum(b[3] - a[3] for a, b in zip(got, want, strict=True))
    assert all(a[3] <= b[3] for a, b in zip(got, want, strict=True)) and missed <= 2
    levels = leaf_levels(spark, documents(rows), tuning)
    assert set(levels) == {1} if tuning.split > 100 else max(levels) >= 3  # the settings reach the workers, and leaves lie as deep as they say
    if tuning.shrink == 1.0:
        assert max(levels) == N.DEPTH and levels.get(1, 0) < sum(levels.values())


def test_shingles_of_whole_texts():
    import pyarrow as pa

    texts = ["a b c d e f", "a b c d e", " a\tb c\n", "", "a b c d e f a b c d e f"]
    own = shingles(*WordHasher().of(*utf8_buffers(pa.array(texts))), 5)
    assert [len(x) for x in own] == [2, 1, 1, 0, 6]
    assert len(np.intersect1d(own[0], own[1])) == 1


def test_long_text_hashes_alike_in_parts(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{i}" for i in range(5000))
    whole, _ = WordHasher().of(*utf8_buffers(pa.array([text, "x y"])))
    monkeypatch.setattr("glossmill.llm.words.BLOCK", 1000)
    parts, borders = WordHasher().of(*utf8_buffers(pa.array([text, "x y"])))
    assert (whole == parts).all() and borders.tolist() == [0, 5000, 5002]


def test_runs_reach_the_recall():
    assert N.found_at(0.8) > 0.9 and 1 - (1 - N.found_at(0.8)) ** N.runs_for(0.8, 0.99998) >= 0.99998


def test_one_of_each_group_stays(spark, documents, prose):
    r = random.Random(1)
    base = prose(5, 150)
    rows = [(None, base), (9, edited(base, r, 1)), (4, edited(base, r, 1)), (4, prose(6, 50)), (8, None)]
    kept = N.drop_near_copies(spark, documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((x["doc_id"], len(x["text"] or "") > 500) for x in kept.collect()) == [(4, False), (4, True), (8, False)]


def test_empty(spark, documents):
    assert N.jaccard_join(spark, documents([])).isEmpty() and N.drop_near_copies(spark, documents([])).isEmpty()


@pytest.mark.parametrize("tuning", [N.Tuning(listed=4, side=8), N.Tuning(listed=4, split=12, side=8)])
def test_no_pair_of_a_very_large_bucket_parts(spark, documents, prose, tuning):
    r = random.Random(11)
    base = prose(77, 150)
    rows = list(enumerate(edited(base, r, r.randint(2, 3)) for _ in range(90)))
    got = sorted(tuple(x) for x in N.jaccard_join(spark, documents(rows), tuning=tuning).select("doc_id", "class_id", "rep_id", "n_links").collect())
    assert got == brute(rows)


def test_hot_sets_and_classes_are_joined_without_a_shuffle_of_their_rows(spark, documents, prose, monkeypatch):
    seen = []
    joined = N.join_sized
    monkeypatch.setattr(N, "join_sized", lambda rows, groups, key, *a, **k: seen.append((key, joined(rows, groups, key, *a, **k))) or seen[-1][1])
    r = random.Random(3)
    base = prose(9, 100)
    rows = [(i, base if i % 3 else edited(base, r, 1) if i % 2 else prose(100 + i, 40)) for i in range(400)] + [(900 + i, "") for i in range(300)]
    got = sorted(tuple(x) for x in N.jaccard_join(spark, documents(rows)).collect())
    assert len(got) == len(rows) and sum(x[1] == 1 for x in got) > 300
    plans = {key[0]: df._jdf.queryExecution().executedPlan().toString() for key, df in seen}
    assert {"key", "label", "sig"} <= set(plans) and all(plans[k].count("BroadcastHashJoin") >= 2 for k in ("key", "label", "sig"))


def test_recall_counts_the_cutoff_and_shared_coordinates():
    runs = N.runs_for(N.SIMILARITY, N.RECALL)
    cutoff = int(N.COORDINATES * (N.SIMILARITY - N.SLACK * (N.SIMILARITY * (1 - N.SIMILARITY) / N.COORDINATES) ** 0.5))
    agree = np.random.default_rng(3).binomial(N.COORDINATES, N.SIMILARITY, 4_000_000)  # equal tokens of pairs at the threshold
    lost = np.where(agree < cutoff, 1.0, (1 - np.array([N.found_at(k / N.COORDINATES) for k in range(N.COORDINATES + 1)])[agree]) ** runs)
    assert 1 - lost.mean() >= N.RECALL


@pytest.mark.parametrize("tuning", [N.Tuning(), N.Tuning(split=1, shrink=1.0)])
def test_recall_of_a_thousand_links_near_the_threshold(spark, documents, tuning):
    """Pairs with a similarity of 0.80 to 0.86, measured against brute force, at the registered settings and with each node split as far as it goes."""
    r = random.Random(23)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    rows = []
    for i in range(1000):
        base = [r.choice(words) for _ in range(204)]
        copy = list(base)
        for place in range(20, 20 + 4 * 45, 45):  # four edits far apart leave 180 of 220 shingles in common
            copy[place + r.randrange(20)] = f"new{r.randrange(10**9)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    sets = sets_of(rows)
    near = {i for i in range(1000) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    assert len(near) >= 1000 and all(len(sets[2 * i] & sets[2 * i + 1]) < 0.86 * len(sets[2 * i] | sets[2 * i + 1]) for i in near)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in N.jaccard_join(spark, documents(rows), tuning=tuning).collect()}
    assert tuning.split > 1 or set(leaf_levels(spark, documents(rows), tuning)) == {N.DEPTH}
    assert all(n <= 1 and c in (i, i - 1) for i, (c, n) in got.items())
    found = sum(got[2 * i] == (2 * i, 1) and got[2 * i + 1] == (2 * i, 1) for i in near)
    assert found >= 0.99 * len(near)


def test_columns_called_like_helpers_keep_their_values(spark, prose):
    rows = [(1, prose(1, 60), 77, "x"), (2, prose(1, 60), 78, "y"), (3, None, 79, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_uid long, _uid string")
    assert sorted(map(tuple, N.drop_near_copies(spark, docs).collect())) == [rows[0], rows[2]]


def test_components_with_a_hub(spark):
    hub = [(0, i) for i in range(1, 500)]
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    edges = spark.createDataFrame(hub + chain + [(5, 5)], "a long, b long")
    got = {x["node"]: x["label"] for x in N.components(spark, edges).collect()}
    assert {got[i] for i in range(1, 500)} == {0} and {got[i] for i in range(1001, 1041)} == {1000}


def test_a_leaf_stands_in_all_slots_under_it():
    sketch = np.random.default_rng(5).integers(0, 256, (3, N.COORDINATES)).astype(np.uint8)
    levels = N.path_levels(sketch, 2, 3)
    assert [x.shape[1] for x in levels] == [4, 8, 16]
    ends = np.zeros((3, 2), np.int64)
    ends[0] = 1 << 1, 1 << 0
    keys = N.leaf_keys(sketch, ends, 2)
    assert (keys[1:] == levels[2][1:]).all() and (keys[0, 4:8] == levels[0][0, 1]).all() and (keys[0, :2] == levels[1][0, 0]).all()
    assert (keys[0, 2:4] == levels[2][0, 2:4]).all() and (keys[0, 8:] == levels[2][0, 8:]).all()
