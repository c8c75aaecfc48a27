"""A learner's level as knowledge: the most frequent words are known in every sense."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.operators.lookup import contiguous_candidates, pos_variants
from glossmill.schema import SENSE, sense_key

# Fixed values.
LEVEL_SIZES = {"a1": 500, "a2": 1000, "b1": 2000, "b2": 3500, "c1": 5000}


def preset_senses(word_list: DataFrame, dictionary: DataFrame, level: str) -> DataFrame:
    """Every sense of the level's words; word_list(lemma, rank). Words go by any part of speech, expressions by none."""
    if level not in LEVEL_SIZES:
        raise ValueError(f"level {level!r} is none of {', '.join(LEVEL_SIZES)}")
    top = word_list.filter(F.col("rank") <= LEVEL_SIZES[level]).select("lemma").distinct()
    several = F.contains("lemma", F.lit(" "))
    single = pos_variants(top.filter(~several), dictionary)
    multi = contiguous_candidates(top.filter(several).withColumn("pos", F.lit("")), dictionary)
    return single.select(*SENSE).unionByName(multi.select(*SENSE)).select(*sense_key())


def preset_events(senses: DataFrame, timestamp) -> DataFrame:
    none = F.lit(None)
    return senses.distinct().select(
        *SENSE, F.lit("known").alias("state"), F.lit("preset").alias("origin"), F.lit(timestamp).cast("timestamp").alias("timestamp"),
        none.cast("string").alias("book_title"), none.cast("string").alias("book_author"), none.cast("int").alias("chapter"),
    )


def preset_counts(word_list: DataFrame, senses: DataFrame, level: str) -> DataFrame:
    """lemma_pos_pairs, senses, covered_lemmas (a lemma once) and total_lemmas, in one row."""
    total = word_list.filter(F.col("rank") <= LEVEL_SIZES[level]).agg(F.count_distinct("lemma").alias("total_lemmas"))
    found = senses.agg(F.count_distinct("lemma", "pos").alias("lemma_pos_pairs"), F.count_distinct(*SENSE).alias("senses"), F.count_distinct("lemma").alias("covered_lemmas"))
    return found.join(F.broadcast(total), F.lit(True))


def write_preset(profile, word_list: DataFrame, dictionary: DataFrame, level: str | None, timestamp) -> DataFrame | None:
    """Writes the level's events in one append; no level, no event. All checks come before the first write."""
    if level is None:
        return None
    senses = preset_senses(word_list, dictionary, level)
    counts = preset_counts(word_list, senses, level)
    profile.ensure_senses(senses)
    profile.record_events(preset_events(senses, timestamp))
    profile.set_cefr_level(level)
    return counts


def build_word_list(forms: DataFrame, lemma_of: DataFrame, size: int) -> DataFrame:
    """lemma, rank: of forms(form, rank) the alphabetic ones; a lemma has the rank of its most frequent form, and the first size lemmas stay."""
    rows = forms.filter(F.col("form").rlike(r"^\p{L}+$")).join(lemma_of, "form").groupBy("lemma").agg(F.min("rank").alias("best"))
    # Only the best ranks can be among the first; the sort is over these.
    return rows.orderBy("best", "lemma").limit(size).withColumn("rank", F.row_number().over(Window.orderBy("best", "lemma"))).select("lemma", "rank")
