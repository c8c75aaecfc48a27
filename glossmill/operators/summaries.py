"""Summaries on several levels at once: grouping sets, sketches that merge upwards, and samples of bounded size for each stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.schema import BOOK, CHAPTER

LEVELS = ("chapter", "book", "corpus")
#: Grouping ids of (book_title, book_author, chapter) by level: a bit for each column that is summed over.
_IDS = {0: "chapter", 1: "book", 7: "corpus"}
#: Bits of a sketch's registers, and the size of a quantile sketch.
LG_REGISTERS, QUANTILE_SIZE = 12, 200
#: Five standard errors of a count of distinct values, and a share of ranks that a quantile sketch stays within.
DISTINCT_BOUND, RANK_BOUND = 5 * 1.04 / 2 ** (LG_REGISTERS / 2), 0.05
#: Parts into which a stratum's rows are dealt before its sample is put together.
PARTS = 64


def by_level(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """The aggregates of each chapter, each book and the corpus in one pass: level, the columns of CHAPTER (null where summed over)."""
    level = F.element_at(F.create_map(*(x for k, v in _IDS.items() for x in (F.lit(k), F.lit(v)))), F.grouping_id(*CHAPTER).cast("int"))
    sets = [[F.col(c) for c in CHAPTER], [F.col(c) for c in BOOK], []]
    out = rows.groupingSets(sets, *(F.col(c) for c in CHAPTER)).agg(level.alias("level"), *aggregates)
    return out.select("level", *(c for c in out.columns if c != "level"))


def distinct_by_level(rows: DataFrame, *sums: str, flag: str | None = None) -> DataFrame:
    """level, the columns of CHAPTER, types (distinct words), flagged (those of them that have the flag somewhere) and the sums, for chapters, books and the corpus.

    rows has one row a chapter and word. Words of a chapter are counted, those of a book are brought together once, and only a
    book's go on to the corpus: each step adds up in its tasks before anything moves, and no row is multiplied by levels.
    """
    keys = [F.col(c) for c in CHAPTER]
    own = rows.select(*keys, "word", *(F.col(c).alias(f"_s{i}") for i, c in enumerate(sums)), (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)).cast("int").alias("_f"))
    added = [F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))]
    met = F.col("word").isNotNull().cast("int")
    first = own.groupingSets([keys, [*keys[:2], F.col("word")]], *keys, F.col("word")).agg(
        F.grouping("chapter").alias("_of_book"), F.sum(met).alias("_n"), F.sum(F.col("_f") * met).alias("_flags"), F.max(F.col("_f") * met).alias("_f"), *added)
    # A chapter's row is done; a word of a book counts as one for the book, and meets itself in other books.
    row = lambda level, *names: F.struct(F.lit(level).alias("level"), *((F.col(c) if c in names else F.lit(None).cast(first.schema[c].dataType)).alias(c) for c in (*CHAPTER, "word")), *((F.col("_n"), F.col("_flags")) if level == "chapter" else (met.cast("long").alias("_n"), F.col("_f").cast("long").alias("_flags"))), "_f", *(f"_s{i}" for i in range(len(sums))))
    turned = F.when(F.col("_of_book") == 0, F.array(row("chapter", *CHAPTER))).otherwise(F.array(row("book", *BOOK), row("corpus", "word")))
    second = first.select(F.explode(turned).alias("r")).select("r.*")
    second = second.groupBy("level", *CHAPTER, "word").agg(F.sum("_n").alias("_n"), F.sum("_flags").alias("_flags"), F.max("_f").alias("_f"), *added)
    of_word = F.col("level") == "corpus"
    third = second.withColumns({"_n": F.when(of_word, F.col("word").isNotNull().cast("long")).otherwise(F.col("_n")), "_flags": F.when(of_word, F.col("_f").cast("long")).otherwise(F.col("_flags"))})
    return third.groupBy("level", *CHAPTER).agg(F.sum("_n").alias("types"), F.sum("_flags").alias("flagged"), *(F.sum(f"_s{i}").alias(c) for i, c in enumerate(sums)))


def coverage_by_level(covered: DataFrame) -> DataFrame:
    """types (distinct words), tokens, and the tokens of each cause, for chapters, books and the corpus; covered is what measures.coverage gives."""
    n = F.col("frequency")
    rows = covered.select(*CHAPTER, "word", n, (F.col("cause") == "hit").alias("_hit"), *(F.when(F.col("cause") == c, n).otherwise(0).alias(f"_{c}s") for c in ("hit", "gap")))
    found = distinct_by_level(rows, "frequency", "_hits", "_gaps", flag="_hit")
    return found.select("level", *CHAPTER, "types", n.alias("tokens"), F.col("flagged").alias("hit_types"), (F.col("_hits") / n).alias("token_rate"), (F.col("_gaps") / n).alias("gap_rate"))


def chapter_sketches(texts: DataFrame) -> DataFrame:
    """A row a chapter: n_sentences, and sketches of its distinct words and of the words in its sentences; texts are read once. A chapter without words has none."""
    sentence = lambda s: F.struct(F.lit(None).cast("string").alias("word"), T.word_count(s).cast("long").alias("words"))
    word = lambda w: F.struct(w.alias("word"), F.lit(None).cast("long").alias("words"))
    own = F.col("text")
    parts = F.concat(F.transform(T.sentences(own), sentence), F.transform(F.array_distinct(T.words(F.lower(own))), word))
    rows = texts.select(*CHAPTER, F.explode(parts).alias("_p")).select(*CHAPTER, "_p.*")
    return rows.groupBy(*CHAPTER).agg(F.count("words").alias("n_sentences"), F.hll_sketch_agg("word", LG_REGISTERS).alias("words_sketch"), F.kll_sketch_agg_bigint("words", QUANTILE_SIZE).alias("lengths_sketch"))


def sketches_by_level(sketches: DataFrame) -> DataFrame:
    """The sketches of chapters, books and the corpus, by merging those of the chapters; no text is read again."""
    return by_level(sketches, F.sum("n_sentences").alias("n_sentences"), F.hll_union_agg("words_sketch").alias("words_sketch"), F.kll_merge_agg_bigint("lengths_sketch", QUANTILE_SIZE).alias("lengths_sketch"))


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """words, and the quantiles of sentence length as an array, in place of the sketches; null without a sentence."""
    values = F.array(*(F.when(F.col("n_sentences") > 0, F.kll_sketch_get_quantile_bigint("lengths_sketch", F.lit(float(q)))) for q in quantiles))
    return sketches.withColumns({"words": F.hll_sketch_estimate("words_sketch"), "lengths": values}).drop("words_sketch", "lengths_sketch")


def bottom_k(rows: DataFrame, strata: Sequence[str], identity: Sequence[str], k: int, seed: str = "") -> DataFrame:
    """k rows of each stratum: those whose identity has the smallest digests, so that a sample of parts, merged, is the sample of the whole.

    Each task keeps k rows a stratum before anything is moved, each part k of those of its tasks, and the stratum k of its parts';
    a stratum of any size is spread over PARTS parts, and its last step reads PARTS x k rows at most. Rows of one identity tie,
    and any of them may stay.
    """
    if k < 1:
        raise ValueError("a sample has at least one row")
    digest = F.md5(F.concat(F.lit(seed), *(F.concat(F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in identity)))
    rows = rows.withColumns({"_digest": digest, "_part": F.pmod(F.xxhash64(*identity), F.lit(PARTS))})
    smallest = lambda df, *by: df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_digest"))).filter(F.col("_rank") <= k)
    return smallest(smallest(rows, *strata, "_part"), *strata).drop("_digest", "_part", "_rank")
