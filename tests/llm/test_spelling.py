from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from glossmill.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced code point, by trying each place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(rows, shortest=7, rarest=2, misspelt=31, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= rarest}
    out, form = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form[w], n, len(others), words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].insert(1, root)
    return {(w, *v) for w, v in out.items()}


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "n", "word", 3) for i, t in rows], "doc_id long, text string, n string, word string, key long")
    return {tuple(r) for r in spelling.spelling_groups(spark, docs, **how).collect()}


def corpus(seed):
    """Invented words with chains of misspellings, each a twentieth as frequent as the one before."""
    r = random.Random(seed)
    words = []
    for _ in range(6):
        w, n = "".join(r.choice("abcdéÿ×") for _ in range(r.randint(8, 12))), 1000
        while n > 1:
            words += [w.upper() if r.random() < 0.1 else w for _ in range(n)]
            p, n = r.randrange(len(w)), n // 18
            w = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("xyz") + w[p:], w[:p] + r.choice("xyz") + w[p + 1 :]])
    r.shuffle(words)
    return [(i, r.choice([" ", "-", "1", "\n"]).join(words[i * 30 : i * 30 + 30])) for i in range(len(words) // 30 + 1)]


def test_equals_a_comparison_of_all_pairs(spark):
    rows = corpus(1)
    want = plainly(rows)
    assert found(spark, rows) == want
    assert any(f and r != f for _, f, r, *_ in want) and sum(f is not None for _, f, *_ in want) > 20


def test_long_words_meet_across_the_border(spark):
    r = random.Random(2)
    rows, n = [], spelling.LONG
    for length in (n - 2, n - 1, n, n + 1, n + 2, 5000):
        w = "".join(r.choice("ab") for _ in range(length))
        rows += [(len(rows) + i, (v + " ") * k) for i, (v, k) in enumerate([(w, 40), (w[:3] + w[4:], 3), (w[:9] + "c" + w[9:], 2), (w[:20] + "d" + w[21:], 2), (w[:5] + w[6:] + "e", 2)])]
    want = plainly(rows, misspelt=None)
    assert found(spark, rows, misspelt=None) == want
    assert any(len(w) > n and f for w, f, *_ in want)


def test_nulls_empties_ties_repeats_and_an_empty_table(spark):
    rows = [(None, "planters planters"), (1, None), (2, ""), (3, "12 ... \n"), (4, "gardens gardens"), (4, "gardens gardens"), (5, "gardena gardena gardenb gardenb gardenc"), (6, "short a b"), (7, "ÀÉÎÕÜÿ× àéîõüÿ×")]
    for ratio in (2, 10):
        assert found(spark, rows, ratio=ratio) == plainly(rows, ratio=ratio)
    assert found(spark, []) == set()


def test_long_texts_are_cut_between_words(spark):
    r = random.Random(3)
    text = "".join(r.choice("abcdefg  ;\U0001f600") for _ in range(400_000)) + "z" * 200_000
    rows = [(1, text), (2, text)]
    words = spelling.words_of(spark.createDataFrame(rows, "doc_id long, text string"), misspelt=None)
    assert Counter(w for (w,) in words.collect()) == Counter(w for w in re.findall("[a-z]+", text) if len(w) >= 7) + Counter(w for w in re.findall("[a-z]+", text) if len(w) >= 7)


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [(f"x{i}", "w4") for i in range(50)], "word string, form string")
    assert {r["root"] for r in spelling.roots(spark, links).collect()} == {"w11"} and spelling.roots(spark, links).count() == 61


def test_pairs_of_a_shared_key_are_verified_inside_the_join(spark):
    words = spark.createDataFrame([("abcdefgh", 2), ("abcdefhg", 2), ("abcdefg", 5)], "word string, n long")
    assert {(r["word"], r["other"]) for r in spelling.near_pairs(words).collect()} == {("abcdefgh", "abcdefg"), ("abcdefg", "abcdefgh"), ("abcdefhg", "abcdefg"), ("abcdefg", "abcdefhg")}
    assert "CartesianProduct" not in spelling.near_pairs(words)._jdf.queryExecution().toString()
