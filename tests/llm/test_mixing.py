from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from glossmill.llm import mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by the rule's own words: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_sources, targets = sum(sizes.values()), set(names), {}
    while open_sources:
        shares = {s: left * weight[s] / sum(weight[o] for o in open_sources) for s in open_sources}
        above = {s for s in open_sources if shares[s] > most * sizes[s]}
        if not above:
            targets |= shares
            break
        for s in above:
            targets[s] = most * sizes[s]
            left -= most * sizes[s]
        open_sources -= above
    return targets


def mixed(spark, rows):
    docs = spark.createDataFrame([(i, s, t, 7, "x", 1) for i, s, t in rows], "doc_id long, source string, text string, size long, _key string, rank long")
    return mixing.mixture(spark, docs, carry=["text"])


CASES = {
    "plain": [(i, f"s{i % 4}", "word " * (i % 13)) for i in range(60)],
    "small sources": [(i, "big" if i % 3 else f"a{i % 9}", "w " * (200 if i % 3 else 1)) for i in range(60)],
    "nulls, empties, ties": [(None, None, "a b"), (None, None, "c d"), (1, None, None), (1, "", "one"), (1, "", "one"), (2, "z", ""), (3, "z", None), (4, "\U0001f600", "q w e"), (5, "￿", "r t")],
    "no words": [(1, "a", ""), (2, "b", None)],
}


@pytest.mark.parametrize("case", CASES)
def test_targets_and_cuts(spark, case):
    rows = CASES[case]
    found = [r.asDict() for r in mixed(spark, rows).collect()]
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = filled(sizes)
    assert len(found) == len(rows)
    for s in sizes:
        own = [r for r in found if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert sum(r["taken"] for r in own) == int(want[s] + 0.5)
        assert all(r["taken"] == r["epochs"] * r["size"] + r["cut"] <= 3 * r["size"] for r in own)
        assert sum(0 < r["cut"] < r["size"] for r in own) <= 1


def test_copies_have_the_words_taken(spark):
    rows = [(i, f"s{i % 3}", f" d{i}\tx\n" + "w,  " * (i % 17) + "end ") for i in range(50)]
    mix = mixed(spark, rows).cache()
    texts = {i: t for i, _, t in rows}
    copies = mixing.copies(mix).collect()
    taken = {r["doc_id"]: r["taken"] for r in mix.collect()}
    counted = dict.fromkeys(taken, 0)
    for r in copies:
        assert texts[r["doc_id"]].startswith(r["text"]) and len(r["text"].split()) == r["size"]
        counted[r["doc_id"]] += r["size"]
    assert counted == taken and any(r["text"] != texts[r["doc_id"]] for r in copies)


def test_reruns_agree_and_seeds_differ(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", "w " * (i % 7 + 1)) for i in range(200)], "doc_id long, source string, text string")
    rows = lambda d, seed: sorted(map(tuple, mixing.mixture(spark, d, seed=seed).select("doc_id", "taken").collect()))
    first = rows(docs, 0)
    assert first == rows(docs.repartition(7), 0) != rows(docs, 1)


def test_an_empty_table(spark):
    assert mixed(spark, []).count() == 0


def test_words_in_long_and_odd_texts(spark):
    texts = [None, "", " \t\n", "a", " a ", "a\x0bb\x0cc\rd", "a b", "\x08 \x0e", "w \n" * 300_000, "x" * 1_000_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.words_in(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_rows_of_a_source_are_dealt_over_many_tasks_without_python(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"), F.lit("a b").alias("text"))
    out = mixing.mixture(spark, docs)
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    assert out.count() == 4000
