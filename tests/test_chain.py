"""The chain from texts on, with an analyzer whose notation says what it finds."""

from __future__ import annotations

import datetime as dt

import pytest

from glossmill.operators import choice
from glossmill.plans import chapters as chain


@pytest.fixture(scope="module")
def notation():
    def factory():
        """An analyzer of text written as word/lemma/POS/dep/head, sentences between bars; a head is a place in its sentence."""
        from glossmill.operators.analyzer import Token

        class Written:
            def sentences(self, text):
                first = 0
                for sentence in filter(None, text.split("|")):
                    out = []
                    for i, piece in enumerate(sentence.split()):
                        word, lemma, pos, dep, head = (piece.split("/") + ["", ""])[:5]
                        out.append(Token(word, lemma, " ", pos, dep or "dep", first + int(head) if head else first + i))
                    first += len(out)
                    yield out

        return Written()

    return factory  # of no module, so that workers need not import this one


CHAPTERS = "book_title string, book_author string, chapter int, text string"
TEXTS = [
    ("B", "A", 1, "She/she/PRON rows/row/VERB a/a/DET lamp/lamp/NOUN | They/they/PRON packed/pack/VERB it/it/PRON in/in/ADP/prt/1 by/by/ADP heart/heart/NOUN | lamp/lamp/NOUN Harbour/harbour/PROPN gleamed/gleam/VERB"),
    ("B", "A", 2, "a/a/DET plum/plum/NOUN row/row/NOUN by/by/ADP the/the/DET plum/plum/NOUN"),
    ("B", "A", 3, ""),
]
EVENTS = "lemma string, pos string, lexentry string, sense string, trans_list string, state string, timestamp timestamp, event_id long"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def found(spark, dictionary, notation):
    events = [
        ("lamp", "NOUN", "eng/lamp__Noun__1", "thing that gives light", "Leuchte", "learning", T0, 1), ("lamp", "NOUN", "eng/lamp__Noun__1", "thing that gives light", "Leuchte", "known", T0 + dt.timedelta(1), 2),
        ("row", "NOUN", "eng/row__Noun__2", "loud quarrel", "Krach | Zank", "known", T0, 3), ("plum", "NOUN", "eng/plum__Noun__1", "", "Zwetschge | Pflaumenbaum", "forgotten", T0, 4),
    ]
    return chain.run_chapters(spark.createDataFrame(TEXTS, CHAPTERS), dictionary, spark.createDataFrame(events, EVENTS), notation)


def test_words_their_candidates_and_what_is_known(found):
    words = {(r["chapter"], r["lemma"], r["pos"], r["lexentry"]): r["status"] for r in found.filter("kind = 'word'").collect()}
    assert words == {
        (1, "row", "VERB", "eng/row__Verb__1"): "unknown", (1, "lamp", "NOUN", "eng/lamp__Noun__1"): "known", (1, "pack", "VERB", None): "unknown", (1, "heart", "NOUN", None): "unknown", (1, "gleam", "VERB", None): "unknown",
        (2, "plum", "NOUN", "eng/plum__Noun__1"): "unknown", (2, "row", "NOUN", "eng/row__Noun__1"): "new_meaning_of_known_word", (2, "row", "NOUN", "eng/row__Noun__2"): "known",
    }
    lamp = found.filter("chapter = 1 and lemma = 'lamp'").first()
    assert (lamp["frequency"], lamp["word_form"], lamp["example_sentence"]) == (2, "lamp", "She rows a lamp")
    assert found.filter("chapter = 2 and lemma = 'plum'").count() == 2  # both senses of the noun, and none of the verb


def test_expressions_come_by_two_routes(found):
    own = {(r["chapter"], r["lemma"]): r for r in found.filter("kind = 'expression'").collect()}
    assert set(own) == {(1, "pack in"), (1, "by heart")}  # "by the" has too low a score
    assert own[1, "pack in"]["word_form"] == "packed it in" and own[1, "by heart"]["example_sentence"] == "They packed it in by heart"
    assert found.filter("lemma = 'pack in'").count() == 2


def test_dispositions_of_words_and_expressions_apart(found):
    got = {(r["chapter"], r["kind"], r["lemma"]): r["disposition"] for r in chain.triaged(found, choice.first_sense, 1).collect()}
    assert got[1, "word", "lamp"] == "known" and got[2, "word", "row"] == "kept" or got[2, "word", "row"] == "remaining"
    first = [k for k, v in got.items() if v == "kept"]
    assert sorted((c, kind) for c, kind, _ in first) == [(1, "expression"), (1, "word"), (2, "word")]  # one of each kind and chapter


def test_chapters_without_text_and_no_chapters(spark, dictionary, found, notation):
    assert {r["chapter"] for r in found.select("chapter").distinct().collect()} == {1, 2}
    events = spark.createDataFrame([], EVENTS)
    assert chain.run_chapters(spark.createDataFrame([], CHAPTERS), dictionary, events, notation).count() == 0


def test_tokens_are_dealt_by_chapter_once(spark):
    """Flags, sentences and n-grams of a chapter move no token: only lemmas meet the shares of their books."""
    from glossmill.operators import vocabulary
    from glossmill.plans import standins as S

    tokens = S.token_table(spark, "/root/testdata/sf0.001")

    def moved(df):
        return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]

    assert moved(vocabulary.with_expression_flag(tokens)) == [] and moved(vocabulary.ngrams(tokens)) == []
    assert moved(vocabulary.vocabulary(tokens)) == [] and moved(vocabulary.particle_verbs(tokens)) == []
    assert tokens.groupBy("book_title", "chapter").count().count() == S.tokens(spark, "/root/testdata/sf0.001").groupBy("book_title", "chapter").count().count()


def test_counts_and_ranks_of_a_chapter_move_no_word(spark):
    from glossmill.plans import catalogue as C

    for made in (C.word_frequency, C.top_k_by_frequency, C.triage_dispositions):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan  # the texts


def test_entries_made_of_lists_are_those_of_senses(spark, dictionary, notation, found):
    """A lemma without an entry, of which another sense is known, has a placeholder that says so."""
    events = [("gleam", "NOUN", "eng/x", "s", "t", "known", T0, 1), ("gleam", "VERB", "eng/x", "s", "t", "known", T0, 2), ("pack in", "VERB", "eng/pack_in__Verb__1", "draw a crowd", "anlocken", "known", T0, 3)]
    made = (spark.createDataFrame(TEXTS, CHAPTERS), dictionary, spark.createDataFrame(events, EVENTS), notation)
    own, long = chain.run_entries(*made), chain.entries(chain.run_chapters(*made))
    rows = lambda df: sorted(map(str, df.select(*sorted(own.columns)).collect()))
    assert rows(own) == rows(long)
    status = {(r["chapter"], r["lemma"]): [(x["uncertain"], x["status"]) for x in r["candidates"]] for r in own.collect()}
    assert status[1, "gleam"] == [(True, "new_meaning_of_known_word")] and status[1, "heart"] == [(True, "unknown")] and sorted(status[1, "pack in"]) == [(False, "known"), (False, "new_meaning_of_known_word")]


def test_only_questions_go_to_a_worker_and_texts_come_after_the_lists(spark, found):
    plan = chain.triaged(found, choice.first_sense, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") == 1


def test_pairs_that_begin_nothing_do_not_move(spark):
    from pyspark.sql import functions as F

    from glossmill.operators import vocabulary

    texts = spark.createDataFrame([(f"{i} {j}",) for i in range(70) for j in range(70)], "pair string")
    known = spark.createDataFrame([("1 2",), ("3 4",), ("x",), (None,)], "pair string")
    kept = {r[0] for r in texts.filter(vocabulary._may_be(F.col("pair"), known)).collect()}
    assert {"1 2", "3 4"} <= kept and len(kept) < 50
    assert texts.filter(vocabulary._may_be(F.col("pair"), known.limit(0))).isEmpty()


def test_tokens_of_many_chapters_go_on_together(spark):
    from pyspark.sql import functions as F

    from glossmill.operators.analyzer import analyzed
    from glossmill.plans import standins as S

    chapters = S.chapters(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame([("s", "a", 0, None), ("s", "a", -1, "")], CHAPTERS)).coalesce(1)
    tokens = analyzed(chapters, S.StandInAnalyzer)
    assert "MapInArrow" in tokens._jdf.queryExecution().optimizedPlan().toString()
    count = lambda parts: (type(b)({"n": [len(b)]}) for b in parts)
    sizes = [r["n"] for r in tokens.mapInPandas(count, "n long").collect()]
    assert len(sizes) < chapters.count() / 2
    own = S.tokens(spark, "/root/testdata/sf0.001").select(*tokens.columns)
    assert tokens.count() == own.count() and tokens.exceptAll(own).isEmpty()
