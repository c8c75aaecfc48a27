from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.operators import lookup, vocabulary
from glossmill.operators.analyzer import analyzed


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_pos_and_lemma_come_before_lookup(tokens_of):
    got = vocabulary.vocabulary(tokens_of("He/he/PRON saw/see/VERB it/it/PRON", "The/the/DET saw/saw/NOUN cuts/cut/VERB"))
    assert rows(got, "lemma", "pos") == [("cut", "VERB"), ("saw", "NOUN"), ("see", "VERB")]


def test_a_name_at_one_place_is_a_word_at_another(tokens_of):
    tokens = tokens_of("Erik/erik/PROPN Red/red/PROPN", "a/a/DET red/red/ADJ red/red/ADJ house/house/NOUN")
    got = {r["lemma"]: r for r in vocabulary.vocabulary(tokens).collect()}
    assert set(got) == {"red", "house"}
    assert (got["red"]["frequency"], got["red"]["proper_noun_frequency"]) == (2, 1)


def test_book_wide_share_decides_where_a_chapter_errs(spark, tokens_of):
    tokens = tokens_of("Sibyl/sibyl/PROPN Sibyl/sibyl/NOUN sun/sun/NOUN")
    ratios = spark.createDataFrame([("B", "A", "sibyl", 0.94)], "book_title string, book_author string, lemma string, ratio double")
    assert rows(vocabulary.vocabulary(tokens, ratios), "lemma") == [("sun",)]
    assert rows(vocabulary.vocabulary(tokens), "lemma") == [("sibyl",), ("sun",)]


def test_the_share_matters_only_with_a_name_in_the_chapter(spark, tokens_of):
    ratios = spark.createDataFrame([("B", "A", "sun", 0.99)], "book_title string, book_author string, lemma string, ratio double")
    assert rows(vocabulary.vocabulary(tokens_of("sun/sun/NOUN"), ratios), "lemma") == [("sun",)]


def test_pos_by_majority_then_first_seen(tokens_of):
    got = vocabulary.vocabulary(tokens_of("light/light/ADJ light/light/NOUN", "run/run/VERB run/run/NOUN run/run/NOUN"))
    assert rows(got, "lemma", "pos", "frequency") == [("light", "ADJ", 2), ("run", "NOUN", 3)]


def test_example_is_free_of_set_phrases_if_one_is(tokens_of):
    phrase = "He/he/PRON has/have/AUX taken/take/VERB part/part/NOUN/dobj/2"
    got = {r["lemma"]: r for r in vocabulary.vocabulary(tokens_of(phrase, "She/she/PRON took/take/VERB the/the/DET/det/3 bus/bus/NOUN/dobj/1")).collect()}
    assert got["take"]["word_form"] == "took" and got["take"]["example_sentence"] == "She took the bus"
    assert vocabulary.vocabulary(tokens_of(phrase)).filter("lemma = 'take'").first()["word_form"] == "taken"


def test_preposition_with_a_pronoun_alone_is_a_phrase(tokens_of):
    flag = lambda t: rows(vocabulary.with_expression_flag(t).filter("pos = 'VERB'"), "text", "in_expression")
    assert flag(tokens_of("came/come/VERB to/to/ADP/prep/0 him/he/PRON/pobj/1")) == [("came", True)]
    assert flag(tokens_of("went/go/VERB into/into/ADP/prep/0 the/the/DET/det/3 library/library/NOUN/pobj/1")) == [("went", False)]
    assert flag(tokens_of("late/late/ADV/advmod/1 runs/run/VERB")) == [("runs", False)]
    assert flag(tokens_of("runs/run/VERB away/away/ADV/advmod/0")) == [("runs", True)]


def test_particle_verbs_together_and_apart(tokens_of):
    got = vocabulary.particle_verbs(tokens_of("He/he/PRON gave/give/VERB the/the/DET idea/idea/NOUN up/up/ADP/prt/1", "He/he/PRON gave/give/VERB up/up/ADP/prt/1", "word/word/NOUN up/up/ADP/prt/0"))
    assert rows(got, "lemma", "pos", "word_form", "frequency") == [("give up", "VERB", "gave the idea up", 2)]


def test_ngrams_end_at_punctuation_sentences_and_six_words(tokens_of):
    lemmas = lambda t, n=6: {r["lemma"] for r in vocabulary.ngrams(t, n).collect()}
    assert lemmas(tokens_of("a/a/X b/b/X ,/,/PUNCT c/c/X", "d/d/X")) == {"a b"}
    long = lemmas(tokens_of(" ".join(f"{c}/{c}/X" for c in "abcdefgh")))
    assert max(len(x.split()) for x in long) == 6 and "a b c d e f" in long and len(long) == 7 + 6 + 5 + 4 + 3


def test_ngrams_do_not_cross_line_breaks(spark, tokens_of):
    tokens = tokens_of("at/at/ADP all/all/ADV").withColumn("text", F.when(F.col("tok_id") == 1, "\n").otherwise(F.col("text"))).withColumn("is_alpha", F.col("tok_id") != 1)
    assert vocabulary.ngrams(tokens).isEmpty()


def test_contiguous_form_and_first_sentence(spark, tokens_of):
    got = vocabulary.contiguous_expressions(tokens_of("Not/not/ADV At/at/ADP all/all/ADV", "at/at/ADP all/all/ADV"), spark.createDataFrame([("at all",)], "lemma string"))
    assert rows(got, "lemma", "word_form", "example_sentence", "frequency") == [("at all", "At all", "Not At all", 2)]


def test_domination_looks_at_the_whole_list(spark):
    own = spark.createDataFrame([(1, "a b", 2), (1, "a b c", 2), (1, "a b c d", 2), (1, "b c", 2), (1, "a", 3), (2, "a b", 2)], "chapter int, lemma string, frequency long")
    assert rows(lookup.without_dominated(own, ["chapter"]), "chapter", "lemma") == [(1, "a"), (1, "a b c d"), (1, "b c"), (2, "a b")]


def test_particle_route_comes_first(spark):
    schema = "book_title string, book_author string, chapter int, lemma string, frequency long"
    particle, other = spark.createDataFrame([("B", "A", 1, "give up", 1)], schema), spark.createDataFrame([("B", "A", 1, "give up", 4), ("B", "A", 1, "at all", 1)], schema)
    assert rows(lookup.assemble_expressions(particle, other), "lemma", "frequency") == [("at all", 1), ("give up", 1)]


def test_rule_analyzer_is_one_token_table(spark):
    chapters = spark.createDataFrame([("B", "A", 1, "He gave up. The old house of Mr Smith\n\nburned!"), ("B", "A", 2, None)], "book_title string, book_author string, chapter int, text string")
    got = sorted(analyzed(chapters).collect(), key=lambda r: r["tok_id"])
    by = {r["text"]: r for r in got}
    assert [r["tok_id"] for r in got] == list(range(len(got)))
    assert by["up"]["dep"] == "prt" and by["Smith"]["pos"] == "PROPN" and by["gave"]["pos"] == "VERB" and not by["."]["is_alpha"]
    assert rows(vocabulary.particle_verbs(analyzed(chapters)), "lemma") == [("gave up",)]


def test_no_tokens(spark, tokens_of):
    nothing = tokens_of("a/a/X").limit(0)
    for f in (vocabulary.vocabulary, vocabulary.particle_verbs, vocabulary.contiguous_expressions, vocabulary.proper_noun_ratios):
        assert f(nothing).isEmpty()
