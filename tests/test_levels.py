from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossmill.operators import answers, choice, summaries, triage

COVERED = "book_title string, book_author string, chapter int, word string, frequency long, cause string"


def test_levels_equal_separate_sums_in_one_scan(spark, tmp_path):
    r = random.Random(1)
    rows = {(b, "A", c, w): (r.randint(1, 9), r.choice(["hit", "gap", "proper"])) for b in ("x", "y", None) for c in (1, 2, None) for w in r.sample("abcdefgh", 5)}
    path = str(tmp_path / "covered")
    spark.createDataFrame([(*k, *v) for k, v in rows.items()], COVERED).write.parquet(path)
    found = summaries.coverage_by_level(spark.read.parquet(path))
    want = defaultdict(list)
    for (b, a, c, w), (n, cause) in rows.items():
        for key in (("chapter", b, a, c), ("book", b, a, None), ("corpus", None, None, None)):
            want[key].append((w, n, cause))
    got = {tuple(x)[:4]: x for x in found.collect()}
    assert set(got) == set(want) and found.count() == len(want)
    for key, own in want.items():
        total = sum(n for _, n, _ in own)
        assert (got[key]["types"], got[key]["tokens"], got[key]["hit_types"]) == (len({w for w, _, _ in own}), total, len({w for w, _, c in own if c == "hit"}))
        assert got[key]["gap_rate"] == pytest.approx(sum(n for _, n, c in own if c == "gap") / total)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_merged_sketches_stay_within_their_bounds(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(4))
    texts, words, lengths = [], defaultdict(set), defaultdict(list)
    for c in range(40):
        sentences = [[word() for _ in range(r.randint(1, 40))] for _ in range(60)]
        texts.append(("b" if c % 2 else "d", "A", c, ". ".join(" ".join(s) for s in sentences) + "."))
        for key in (("chapter", c), ("book", texts[-1][0]), ("corpus", None)):
            words[key].update(w for s in sentences for w in s)
            lengths[key] += map(len, sentences)
    texts += [("b", "A", 98, ""), ("b", "A", 99, None)]
    sketches = summaries.chapter_sketches(spark.createDataFrame(texts, "book_title string, book_author string, chapter int, text string"))
    for x in summaries.estimates(summaries.sketches_by_level(sketches), [0.5, 0.9]).collect():
        key = (x["level"], {"chapter": x["chapter"], "book": x["book_title"], "corpus": None}[x["level"]])
        assert abs(x["words"] - len(words[key])) <= summaries.DISTINCT_BOUND * len(words[key]) and x["n_sentences"] == len(lengths[key])
        for q, value in zip((0.5, 0.9), x["lengths"]):
            own = lengths[key]
            assert sum(n < value for n in own) / len(own) <= q + summaries.RANK_BOUND and sum(n <= value for n in own) / len(own) >= q - summaries.RANK_BOUND
    assert len(words["corpus", None]) > 30_000


def test_a_sample_of_samples_is_the_sample(spark):
    rows = [("hot" if i % 3 else f"s{i % 7}", i) for i in range(3000)] + [(None, None), ("one", 1)]
    table = spark.createDataFrame(rows, "stratum string, id long").repartition(9)
    take = lambda df: {tuple(r) for r in summaries.bottom_k(df, ["stratum"], ["id"], 10, "z").collect()}
    digest = lambda i: hashlib.md5(f"z:{'' if i is None else i}".encode()).hexdigest()
    want = set()
    for s in {s for s, _ in rows}:
        want |= {(s, i) for i in sorted((i for t, i in rows if t == s), key=digest)[:10]}
    assert take(table) == want
    halves = [summaries.bottom_k(table.filter(f"coalesce(id, 0) % 2 = {k}"), ["stratum"], ["id"], 10, "z") for k in (0, 1)]
    assert take(halves[0].unionByName(halves[1])) == want
    plan = summaries.bottom_k(table, ["stratum"], ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3 and plan.index("_part") and plan.rindex("Partial") > plan.rindex("Exchange hashpartitioning(stratum")  # tasks keep ten rows before anything moves
    with pytest.raises(ValueError, match="one row"):
        summaries.bottom_k(table, ["stratum"], ["id"], 0)


def body(content, reason="stop", **more):
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": content}, "finish_reason": reason}], **more})


CASES = [
    (body('{"choice": 1}'), 1, 1, None), (body('  {"choice": 3}\n', usage={"n": 1}), 3, 3, None), (body('{"choice": 2}', "length"), 2, 2, None), (None, 3, None, "missing"), ("", 3, None, "json"), ("<html>", 3, None, "json"),
    (body('{"choice": 1}')[:-1], 3, None, "json"), ("[]", 3, None, "form"), ("{}", 3, None, "form"), ('{"choices": []}', 3, None, "form"), ('{"choices": [7]}', 3, None, "form"), ('{"choices": [{"text": "1"}]}', 3, None, "form"),
    ('{"choices": [{"message": "1"}]}', 3, None, "form"), (body("", "length"), 3, None, "length"), (body(None, "length"), 3, None, "length"), (body(" ", "length"), 3, None, "length"), (body("x", "length"), 3, None, "choice"),
    (body(""), 3, None, "choice"), (body(None), 3, None, "choice"), (body("2"), 3, None, "choice"), (body('"choice"'), 3, None, "choice"), (body("[1]"), 3, None, "choice"), (body('{"Choice": 1}'), 3, None, "choice"), (body({"choice": 1}), 3, None, "choice"),
    (body('{"choice": null}'), 3, None, "number"), (body('{"choice": 1.0}'), 3, None, "number"), (body('{"choice": 1.9}'), 3, None, "number"), (body('{"choice": 1e0}'), 3, None, "number"), (body('{"choice": "1"}'), 3, None, "number"),
    (body('{"choice": true}'), 3, None, "number"), (body('{"choice": [1]}'), 3, None, "number"), (body('{"choice": 0}'), 3, None, "range"), (body('{"choice": -1}'), 3, None, "range"), (body('{"choice": 4}'), 3, None, "range"),
    (body('{"choice": 99999999999999999999}'), 3, None, "range"),
]


def test_answers_and_their_faults(spark):
    rows = [(i, b, n, 5, "f") for i, (b, n, _, _) in enumerate(CASES)]
    found = answers.checked_answers(spark.createDataFrame(rows, "id int, body string, options int, _choice int, _whole string"))
    got = {r["id"]: (r["choice"], r["fault"]) for r in found.collect()}
    assert got == {i: (c, f) for i, (_, _, c, f) in enumerate(CASES)} and found.columns[:5] == ["id", "body", "options", "_choice", "_whole"]
    assert {f for _, f in got.values() if f} == set(answers.FAULTS)
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))
    for b, n, c, _ in CASES:  # the check of a live answer says the same
        if c is not None:
            assert choice.checked_answer(b.encode(), n) == c
        elif b is not None:
            with pytest.raises(ValueError):
                choice.checked_answer(b.encode(), n)


ENTRIES = "book_title string, book_author string, chapter int, lemma string, pos string, frequency long, all_known boolean, none_known boolean, answer string, _at int"


@pytest.mark.parametrize("order", ["new_words_first", "frequency"])
def test_blocks_of_many_chapters_equal_each_alone(spark, order):
    r = random.Random(order)
    rows = []
    for c in range(12):
        rows += [("B" if c % 5 else None, "A", c, f"w{c}.{i}", "NOUN", r.randint(1, 5), r.random() < 0.2, r.random() < 0.5, r.choice(["known", "unknown", "unknown", None]), 1) for i in range(r.choice([0, 1, 5, 30]))]
    entries, asked = spark.createDataFrame(rows, ENTRIES), []

    def choose(part):
        asked.append(part.count())
        return part.withColumn("chosen_status", F.col("answer"))

    got = [{r["lemma"]: r["disposition"] for r in b.collect()} for b in triage.blocks(entries, 4, choose, order)]
    want = defaultdict(dict)
    for c in range(12):
        turn = lambda r: (-r[5], r[3], r[4])
        own = sorted((r for r in rows if r[2] == c and not r[6]), key=lambda r: (not r[7], *turn(r)) if order == "new_words_first" else turn(r))
        block = kept = 0
        for x in own:  # a chapter by itself, row after row
            want[block][x[3]] = "skipped" if x[8] is None else "resolved_known" if x[8] == "known" else "kept"
            kept += want[block][x[3]] == "kept"
            if kept == 4:
                block, kept = block + 1, 0
    assert got == [want[b] for b in sorted(want)] and sum(asked) == sum(not r[6] for r in rows)
    assert Counter(len(b) > 0 for b in got)[True] > 2
    assert list(triage.blocks(entries.limit(0), 4, choose)) == []
