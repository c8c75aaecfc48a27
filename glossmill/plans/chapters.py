"""From chapters to a learner's list: the whole chain as one plan over any number of books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators import lookup, profile, triage, vocabulary
from glossmill.operators.analyzer import Factory, RuleAnalyzer, analyzed
from glossmill.operators.choice import Chooser, choose, resolved
from glossmill.schema import CHAPTER, SENSE, sense_key
from glossmill.sources.staging import dealt, staged, staged_chapters

KEY = [*CHAPTER, "kind", "lemma", "pos"]


def _listed(senses: DataFrame, key: list[str]) -> DataFrame:
    """candidates best first, and what is known of them, for each key of senses(lexentry, sense, trans_list, score, src_row, uncertain, status)."""
    turn = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("turn"), "src_row", "lexentry", "sense", "trans_list", "uncertain", "status")
    known = F.col("status") == "known"
    return senses.groupBy(*key).agg(F.sort_array(F.collect_list(turn)).alias("ranked"), F.bool_and(known).alias("all_known"), (~F.bool_or(known)).alias("none_known"))


def sense_lists(dictionary: DataFrame, events: DataFrame) -> DataFrame:
    """The candidates of each (route, lemma, pos) that the dictionary has or a learner knows, with their status: the same in all chapters.

    route: word, particle or contiguous. What is in no list is an uncertain word or particle verb of which nothing is known.
    """
    known = profile.latest_states(events.withColumns(dict(zip(SENSE, sense_key(), strict=True)))).filter("state = 'known'").select("lemma", "pos")
    named = lookup.pos_variants(dictionary.select(F.col("written_rep").alias("lemma"), F.lit(None).alias("pos")).distinct(), dictionary).select("lemma", "pos")
    words = lookup.candidates(named.unionByName(known.filter(F.col("pos").isin(*lookup.DICTIONARY_POS))).distinct(), dictionary)
    keys = lookup.expression_entries(dictionary).select(F.col("written_key").alias("lemma"))
    verbs = lookup.particle_verb_candidates(keys.unionByName(known.filter("pos = 'VERB'").select("lemma")).distinct(), dictionary).withColumn("pos", F.lit("VERB"))
    others = lookup.contiguous_candidates(keys.distinct(), dictionary).withColumn("pos", F.lit(""))
    routes = [x.select(F.lit(route).alias("route"), "lemma", "pos", *lookup.MATCH, "uncertain") for route, x in (("word", words), ("particle", verbs), ("contiguous", others))]
    return _listed(profile.compare(reduce(DataFrame.unionByName, routes), events), ["route", "lemma", "pos"])


def _places(tokens: DataFrame, dictionary: DataFrame, events: DataFrame, ratios: DataFrame | None, stage) -> DataFrame:
    """Each word and expression of each chapter with its list, and where its form and sentence stand.

    The dictionary and what is known meet once, in lists by lemma, so that a chapter's rows meet one table, and before they have texts.
    """
    dictionary = stage(dictionary)
    lists = stage(sense_lists(dictionary, events))
    ratios = vocabulary.proper_noun_ratios(tokens) if ratios is None else ratios
    words = vocabulary.lemma_places(tokens, ratios).withColumn("route", F.lit("word"))
    heads = lookup.expression_entries(dictionary).filter(F.contains("written_key", F.lit(" "))).select(F.col("written_key").alias("lemma"))
    particle = stage(vocabulary.particle_places(tokens))
    # Only what the dictionary has is aggregated; keys of n-grams are lower case already, A-Z being all that the lookup folds.
    contiguous = vocabulary.contiguous_places(tokens, heads).join(particle.select(*CHAPTER, "lemma"), [*CHAPTER, "lemma"], "left_anti")
    own = particle.withColumn("route", F.lit("particle")).unionByName(contiguous.withColumn("route", F.lit("contiguous")))
    own = lookup.without_dominated(stage(own), list(CHAPTER))
    # Every other expression has an entry, as it was found by one.
    found = words.unionByName(own).join(lists, ["route", "lemma", "pos"], "left")
    nothing = F.struct(F.lit(float("inf")).alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("src_row", "long"), ("lexentry", "string"), ("sense", "string"), ("trans_list", "string"))), F.lit(True).alias("uncertain"), F.lit("unknown").alias("status"))
    ranked = F.coalesce("ranked", F.array(nothing.cast(found.schema["ranked"].dataType.elementType)))
    kind = F.when(F.col("route") == "word", F.lit("word")).otherwise(F.lit("expression"))
    return found.select(*CHAPTER, kind.alias("kind"), "lemma", "pos", "frequency", "proper_noun_frequency", "first_tok", "low", "high", "sent_id", ranked.alias("ranked"), F.coalesce("all_known", F.lit(False)).alias("all_known"), F.coalesce("none_known", F.lit(True)).alias("none_known"))


def chapter_vocabulary(tokens: DataFrame, dictionary: DataFrame, events: DataFrame, ratios: DataFrame | None = None, stage=staged) -> DataFrame:
    """A row for each candidate sense of each word and expression of each chapter, with its status; words and expressions apart by kind.

    tokens should be materialized: several operators read them. ratios: shares of names in whole books; by default of these tokens.
    stage makes tables of what is read several times here: the dictionary, the lists of senses, and the expressions of both routes.
    """
    rows = vocabulary.with_sentence(_places(tokens, dictionary, events, ratios, stage), tokens).withColumn("_x", F.explode("ranked"))
    senses = ["lexentry", "sense", "trans_list", "score", "src_row", "uncertain"]
    score = F.when(F.col("_x.turn") < float("inf"), -F.col("_x.turn"))
    return rows.select(*vocabulary.SHOWN, "kind", *(score.alias(c) if c == "score" else F.col(f"_x.{c}").alias(c) for c in senses), F.col("_x.status").alias("status"))


def _bare(ranked: Column) -> Column:
    return F.transform(ranked, lambda x: x.dropFields("turn", "src_row"))


def chapter_entries(tokens: DataFrame, dictionary: DataFrame, events: DataFrame, ratios: DataFrame | None = None, stage=staged) -> DataFrame:
    """entries() of chapter_vocabulary(), whose lists are never taken apart."""
    rows = vocabulary.with_sentence(_places(tokens, dictionary, events, ratios, stage), tokens)
    return rows.withColumn("candidates", _bare(F.col("ranked"))).drop("ranked")


def entries(candidates: DataFrame) -> DataFrame:
    """One row for each word or expression, with its candidates best first and what is known of them."""
    shown = [c for c in vocabulary.SHOWN if c not in KEY]
    rows = candidates.withColumn("_shown", F.struct(*shown))
    return _listed(rows, [*KEY, "_shown"]).select(*KEY, "_shown.*", _bare(F.col("ranked")).alias("candidates"), "all_known", "none_known")


def triaged(candidates: DataFrame, chooser: Chooser, limit: int, order: str = "new_words_first") -> DataFrame:
    """Entries with the chosen sense and their disposition, words and expressions by themselves; candidates: of chapter_vocabulary()."""
    return triaged_entries(entries(candidates), chooser, limit, order)


def triaged_entries(rows: DataFrame, chooser: Chooser, limit: int, order: str = "new_words_first") -> DataFrame:
    """triaged() of entries.

    A question too long for the chooser is marked by choice_obstacle, and its row is skipped as one without a fitting sense.

    For a chooser that costs nothing, every row that isn't fully known is asked and the early stop is a window;
    see triage.blocks for a dear one.
    """
    open_ = ~F.col("all_known")
    chosen = resolved(choose(rows, chooser, "mark", open_)).withColumn("sense_chosen", F.when(open_, F.col("sense_chosen")))
    return triage.dispositions(chosen.withColumn("chosen_status", F.col("sense_chosen.status")), limit, order, (*CHAPTER, "kind"))


def run_chapters(chapters: DataFrame, dictionary: DataFrame, events: DataFrame, factory: Factory = RuleAnalyzer, stage=staged, stage_tokens=staged_chapters) -> DataFrame:
    """The vocabulary of chapters(book_title, book_author, chapter, text); stage_tokens makes the tokens a table, once for all operators."""
    return chapter_vocabulary(stage_tokens(analyzed(dealt(chapters), factory)), dictionary, events, stage=stage)


def run_entries(chapters: DataFrame, dictionary: DataFrame, events: DataFrame, factory: Factory = RuleAnalyzer, stage=staged, stage_tokens=staged_chapters) -> DataFrame:
    """run_chapters() as entries, for what goes on to triage."""
    return chapter_entries(stage_tokens(analyzed(dealt(chapters), factory)), dictionary, events, stage=stage)
