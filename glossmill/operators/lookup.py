"""Dictionary lookups as joins.

A dictionary becomes a table with derived columns once (prepared): the part of speech from the entry's
name, a case-folded key, and the row's place as the tie-break among equal scores. Whether the dictionary is
broadcast is left to the optimizer, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import ascii_fold

# Fixed values.
DICTIONARY_POS = {"NOUN": "Noun", "VERB": "Verb", "ADJ": "Adjective", "ADV": "Adverb", "INTJ": "Interjection"}
LEAST_SCORE = 50.0
EXCLUDED_POS = "Proper_noun"
NO_SENSE_LABEL = "Hauptbedeutung, ohne nähere Angabe"
UNCERTAIN_LABEL = "kein Wörterbucheintrag — unsicher"

MATCH = ("lexentry", "sense", "trans_list", "score", "src_row")


def entry_pos(lexentry: Column) -> Column:
    """The second part of the entry's name; null without one."""
    return F.get(F.split(lexentry, "__"), F.lit(1))


def prepared(dictionary: DataFrame) -> DataFrame:
    """dictionary: lexentry, sense, written_rep, trans_list, score, and src_row if it has one."""
    if "src_row" not in dictionary.columns:
        dictionary = dictionary.withColumn("src_row", F.monotonically_increasing_id())
    return dictionary.withColumns({"score": F.expr("try_cast(score as double)"), "entry_pos": entry_pos(F.col("lexentry")), "written_key": ascii_fold(F.col("written_rep"))})


def mapped_pos(pos: Column) -> Column:
    """The dictionary's name of a part of speech; any that it has no name for is an error."""
    out = F.raise_error(F.concat(F.lit("no dictionary name for part of speech "), F.coalesce(pos, F.lit("null"))))
    for tag, name in DICTIONARY_POS.items():
        out = F.when(pos == tag, F.lit(name)).otherwise(out)
    return out


def best_first(*extra: str) -> Column:
    """Matches of a group by falling score, null last, then by place; as an array of structs."""
    turn = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("turn"), "src_row", "lexentry", "sense", "trans_list", "score", *extra)
    rows = F.sort_array(F.collect_list(F.when(F.col("src_row").isNotNull(), turn)))
    return F.transform(rows, lambda x: F.struct(*(x[c].alias(c) for c in ("lexentry", "sense", "trans_list", "score", *extra))))


def candidates(lemmas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Long form: each row of lemmas(lemma, pos, ...) with each of its entries; one row with nulls and uncertain if it has none."""
    entries = prepared(dictionary).filter("lexentry is not null").select("written_rep", "entry_pos", *MATCH)
    asked = lemmas.withColumn("_pos", mapped_pos(F.col("pos")))
    found = asked.join(entries, (F.col("lemma") == F.col("written_rep")) & (F.col("_pos") == F.col("entry_pos")), "left")
    return found.withColumn("uncertain", F.col("src_row").isNull()).drop("_pos", "written_rep", "entry_pos")


def candidate_lists(lemmas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lemma, pos and their entries best first; an empty list if there is none."""
    return candidates(lemmas.select("lemma", "pos").distinct(), dictionary).groupBy("lemma", "pos").agg(best_first().alias("candidates"))


def pos_variants(lemmas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every entry of a text under any of the known parts of speech; nothing for a text without one."""
    names = F.create_map(*(F.lit(x) for tag, name in DICTIONARY_POS.items() for x in (name, tag)))
    entries = prepared(dictionary).filter(F.col("lexentry").isNotNull() & F.col("entry_pos").isin(*DICTIONARY_POS.values()))
    entries = entries.select("written_rep", names[F.col("entry_pos")].alias("pos"), *MATCH)
    return lemmas.drop("pos").join(entries, F.col("lemma") == F.col("written_rep")).drop("written_rep")


def expression_entries(dictionary: DataFrame) -> DataFrame:
    """Entries that an expression may be: a sure one, and no name. Entries without a part of speech pass."""
    return prepared(dictionary).filter((F.col("score") >= LEAST_SCORE) & ~F.col("entry_pos").eqNullSafe(EXCLUDED_POS)).select("written_key", *MATCH)


def contiguous_candidates(lemmas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries of expressions, upper and lower case alike for A-Z; an expression without one goes."""
    return _keyed(lemmas).join(expression_entries(dictionary), "written_key").drop("written_key").withColumn("uncertain", F.lit(False))


def particle_verb_candidates(lemmas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """As contiguous_candidates, but an observed verb stays without an entry, marked uncertain."""
    return _keyed(lemmas).join(expression_entries(dictionary), "written_key", "left").drop("written_key").withColumn("uncertain", F.col("src_row").isNull())


def _keyed(lemmas: DataFrame) -> DataFrame:
    return lemmas.withColumn("written_key", ascii_fold(F.col("lemma")))


def label() -> Column:
    """How a sense is called in a list."""
    named = F.when(F.coalesce("sense", F.lit("")) == "", F.lit(NO_SENSE_LABEL)).otherwise(F.col("sense"))
    return F.when(F.col("uncertain"), F.lit(UNCERTAIN_LABEL)).otherwise(named)


def unfiltered_counts(lemmas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries of a text whatever their part of speech."""
    rows = prepared(dictionary).filter("lexentry is not null").groupBy(F.col("written_rep").alias("lemma")).agg(F.count("*").alias("n"))
    return lemmas.join(rows, "lemma", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def best_expressions(dictionary: DataFrame) -> DataFrame:
    """The best row of each entry of several words; a bad score counts as 0, and the first row wins a tie."""
    rows = prepared(dictionary).filter(F.contains("written_rep", F.lit(" "))).withColumns({"score": F.coalesce("score", F.lit(0.0)), "key": F.lower("written_rep"), "entry_pos": F.coalesce("entry_pos", F.lit("?"))})
    best = F.max_by(F.struct("written_rep", "entry_pos", "sense", "trans_list", "score"), F.struct("score", (-F.col("src_row")).alias("turn"))).alias("best")
    return rows.groupBy("key").agg(best).select("key", "best.*")


def headwords(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.lower("written_rep").alias("headword")).filter("headword is not null").distinct()


def importance_ranking(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("written_rep").agg(F.max("importance").alias("importance"))


def assemble_expressions(particle: DataFrame, contiguous: DataFrame) -> DataFrame:
    """Particle verbs, and the other expressions whose text isn't a particle verb already; then what a longer one dominates goes.

    An expression is dominated if another of the chapter begins with all its words, has more, and is as frequent.
    """
    key = [*(c for c in ("book_title", "book_author", "chapter") if c in contiguous.columns), "lemma"]
    both = particle.unionByName(contiguous.join(particle.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return without_dominated(both, key[:-1])


def without_dominated(expressions: DataFrame, chapter: list[str]) -> DataFrame:
    """Proper beginnings of each expression are looked for among the others: an equi-join, where comparing all pairs would be a nested loop."""
    split = F.split("lemma", " ")
    beginnings = expressions.select(*chapter, "frequency", "lemma").distinct().filter(F.size(split) > 1)
    beginnings = beginnings.select(*chapter, "frequency", F.explode(F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda n: F.array_join(F.slice(split, F.lit(1), n), " "))).alias("lemma"))
    return expressions.join(beginnings.distinct(), [*chapter, "lemma", "frequency"], "left_anti")
