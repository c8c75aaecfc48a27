from __future__ import annotations

import pytest

from glossmill.operators import lookup, measures, preset


def lemmas(spark, *pairs):
    return spark.createDataFrame(list(pairs), "lemma string, pos string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_part_of_speech_filters_and_null_senses_stay(spark, dictionary):
    got = lookup.candidate_lists(lemmas(spark, ("plum", "NOUN"), ("plum", "VERB"), ("Plum", "NOUN")), dictionary).collect()
    by = {(r["lemma"], r["pos"]): r["candidates"] for r in got}
    assert [x["trans_list"] for x in by["plum", "NOUN"]] == ["Zwetschge | Pflaumenbaum", "Pöstchen"] and by["plum", "NOUN"][0]["sense"] is None
    assert len(by["plum", "VERB"]) == 1 and by["Plum", "NOUN"] == []


def test_null_scores_come_last(spark, dictionary):
    got = lookup.candidate_lists(lemmas(spark, ("then", "ADV")), dictionary).first()["candidates"]
    assert [x["score"] for x in got] == [1.5, None]


def test_no_entry_leaves_a_placeholder(spark, dictionary):
    got = lookup.candidates(lemmas(spark, ("xyzzy", "NOUN"), ("lamp", "NOUN")), dictionary).withColumn("label", lookup.label())
    assert rows(got, "lemma", "uncertain", "label") == [("lamp", False, "thing that gives light"), ("xyzzy", True, lookup.UNCERTAIN_LABEL)]


def test_unknown_part_of_speech_is_an_error(spark, dictionary):
    with pytest.raises(Exception, match="no dictionary name"):
        lookup.candidates(lemmas(spark, ("lamp", "PROPN")), dictionary).collect()


def test_variants_have_no_placeholder(spark, dictionary):
    got = lookup.pos_variants(lemmas(spark, ("row", ""), ("xyzzy", ""), ("by the", "")), dictionary)
    assert rows(got, "lemma", "pos", "score") == [("row", "NOUN", 200.0), ("row", "NOUN", 60.75), ("row", "VERB", 150.5)]


def test_expressions_need_a_sure_entry_that_is_no_name(spark, dictionary):
    asked = lemmas(spark, ("PACK in", ""), ("by the", ""), ("blue harbour", ""), ("by heart", ""))
    assert rows(lookup.contiguous_candidates(asked, dictionary), "lemma", "sense") == [("PACK in", "draw a crowd"), ("PACK in", "end a habit"), ("by heart", None)]


def test_equal_scores_keep_the_order_of_rows(spark, dictionary):
    got = lookup.contiguous_candidates(lemmas(spark, ("pack in", "")), dictionary).groupBy("lemma").agg(lookup.best_first().alias("c")).first()["c"]
    assert [x["sense"] for x in got] == ["end a habit", "draw a crowd"]


def test_observed_particle_verb_stays_uncertain(spark, dictionary):
    got = lookup.particle_verb_candidates(lemmas(spark, ("row up", "VERB"), ("pack in", "VERB")), dictionary)
    assert rows(got, "lemma", "uncertain") == [("pack in", False), ("pack in", False), ("row up", True)]


def test_unfiltered_counts_and_best_expressions(spark, dictionary):
    assert rows(lookup.unfiltered_counts(lemmas(spark, ("row", "NOUN"), ("by the", "")), dictionary), "lemma", "n") == [("by the", 0), ("row", 3)]
    best = {r["key"]: r for r in lookup.best_expressions(dictionary).collect()}
    assert best["pack in"]["sense"] == "end a habit" and best["by the"]["entry_pos"] == "?"


def test_preset_knows_every_sense(spark, dictionary):
    words = spark.createDataFrame([("row", 1), ("pack in", 2), ("xyzzy", 3), ("lamp", 501)], "lemma string, rank int")
    senses = preset.preset_senses(words, dictionary, "a1")
    assert rows(senses, "lemma", "pos") == [("pack in", ""), ("pack in", ""), ("row", "NOUN"), ("row", "NOUN"), ("row", "VERB")]
    assert preset.preset_counts(words, senses, "a1").first().asDict() == {"lemma_pos_pairs": 3, "senses": 5, "covered_lemmas": 2, "total_lemmas": 3}
    with pytest.raises(ValueError, match="c2"):
        preset.preset_senses(words, dictionary, "c2")


def test_word_list_takes_the_rank_of_the_best_form(spark):
    forms = spark.createDataFrame([("went", 1), ("go", 2), ("can't", 3), ("sun", 4), ("suns", 9)], "form string, rank int")
    base = spark.createDataFrame([("went", "go"), ("go", "go"), ("sun", "sun"), ("suns", "sun")], "form string, lemma string")
    assert rows(preset.build_word_list(forms, base, 2), "lemma", "rank") == [("go", 1), ("sun", 2)]


def test_coverage_causes_in_their_order(spark):
    texts = spark.createDataFrame([(1, "Cities went Paris Paris zzz ll don't")], "id int, text string")
    heads = spark.createDataFrame([("city",)], "headword string")
    got = measures.coverage(measures.word_frequencies(texts, ["id"]), heads, spark.createDataFrame([("went",)], "form string"))
    assert dict(rows(got, "word", "cause")) == {"cities": "hit", "don't": "gap", "ll": "contraction", "paris": "proper", "went": "irregular", "zzz": "gap"}


def greedy(words, known):
    out, i = [], 0
    while i < len(words):
        n = next((n for n in range(min(4, len(words) - i), 1, -1) if " ".join(words[i : i + n]) in known), None)
        if n:
            out.append((i, " ".join(words[i : i + n])))
        i += n or 1
    return out


def test_greedy_matches_equal_the_loop(spark):
    import random

    r = random.Random(4)
    known = ["a b", "a b c", "b c", "c a b d", "d d"]
    texts = [(i, " ".join(r.choice("abcd") for _ in range(30))) for i in range(40)]
    got = measures.greedy_matches(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(k,) for k in known], "key string"), ["id"])
    assert rows(got, "id", "at", "expression") == sorted(((i, at, e) for i, t in texts for at, e in greedy(t.split(), known)), key=str)


def test_separated_verbs_take_the_first_particle_within_the_gap(spark):
    texts = spark.createDataFrame([(1, "give it up give up give the old good idea up give a b c d up")], "id int, text string")
    verbs = spark.createDataFrame([("give up", "Verb"), ("way in", "Noun")], "key string, entry_pos string")
    words = "give it up give up give the old good idea up give a b c d up".split()
    expected = [i for i, w in enumerate(words) if w == "give" and "up" in words[i + 2 : i + 6]]
    assert sorted(x[0] for x in rows(measures.separated_verbs(texts, verbs, ["id"]), "at")) == expected


def test_measures_over_tokens(spark, tokens_of):
    tokens = tokens_of("He/he/PRON gave/give/VERB it/it/PRON up/up/ADP/prt/1", "Bob/bob/NOUN saw/see/VERB Bob/bob/NOUN Bob/bob/NOUN Bob/bob/NOUN Ann/ann/PROPN ann/ann/NOUN look/look/VERB up/up/ADP/prt/7")
    gap = measures.phrasal_verb_gap(tokens, spark.createDataFrame([("give up",)], "key string"))
    assert rows(gap, "kind", "occurrences") == [("separated", 1), ("unknown", 1)]
    assert measures.lemma_gap(tokens, spark.createDataFrame([("give",), ("he",)], "headword string")).first()["lemma_tokens"] == 2
    errors = measures.proper_noun_errors(tokens)
    assert ("ann", "overreach") in rows(errors, "form", "error")


def test_histogram_and_samples(spark):
    counts = spark.createDataFrame([("a", "N", 0), ("b", "N", 1), ("c", "N", 4), ("d", "N", 12), ("e", "N", 4)], "lemma string, pos string, n long")
    assert rows(measures.ambiguity_histogram(counts), "bucket", "lemmas") == [("0", 1), ("1", 1), ("3-5", 2), (">10", 1)]
    assert measures.ambiguity_summary(counts).first()["median_senses"] == 4.0
    assert [r["lemma"] for r in measures.longest_lists(counts, 2).collect()] == ["d", "c"]


def test_chunks_at_paragraphs(spark):
    texts = spark.createDataFrame([(1, "aaaa\n\nbbbb\n \ncccc\n\n\n\ndd")], "id int, text string")
    assert rows(measures.chunks(texts, ["id"], size=8), "chunk", "text") == [(0, "aaaa\n\nbbbb"), (1, "cccc\n\ndd")]
    assert rows(measures.chunks(texts, ["id"], size=8, limit_words=1), "chunk", "text") == [(0, "aaaa")]
