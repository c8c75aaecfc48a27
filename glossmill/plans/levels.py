"""Queries over summaries on several levels, samples, recorded answers and blocks by chapter, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import answers, measures, summaries, triage
from glossmill.plans import catalogue as C
from glossmill.plans import standins as S
from glossmill.plans.registry import query
from glossmill.schema import CHAPTER
from glossmill.sources.staging import dealt, staged

_C = "book_title, book_author, chapter"
_SETS = f"GROUP BY GROUPING SETS (({_C}), (book_title, book_author), ())"
_LEVEL = f"CASE grouping({_C}) WHEN 0 THEN 'chapter' WHEN 1 THEN 'book' ELSE 'corpus' END AS level, {_C}"


@query(
    f"""{C._COVERAGE} SELECT {_LEVEL}, count(DISTINCT word) AS types, sum(frequency)::bigint AS tokens, count(DISTINCT word) FILTER (WHERE cause = 'hit') AS hit_types,
    sum(CASE WHEN cause = 'hit' THEN frequency ELSE 0 END) / sum(frequency) AS token_rate, sum(CASE WHEN cause = 'gap' THEN frequency ELSE 0 END) / sum(frequency) AS gap_rate FROM causes {_SETS}"""
)
def coverage_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.coverage_by_level(staged(C._covered(spark, sf_dir), "covered"))


_WORDS = f"words AS (SELECT {_C}, unnest(regexp_extract_all(lower(text), {S.WORD_SQL})) AS word FROM chapters), lengths AS (SELECT {_C}, unnest(regexp_extract_all(text, '[^.!?]*[.!?]')) AS s FROM chapters)"


@query(
    f"""WITH {S.CHAPTERS_SQL}, {_WORDS}, w AS (SELECT {_LEVEL}, count(DISTINCT word) AS words FROM words {_SETS}), l AS (SELECT {_LEVEL}, count(*) AS n FROM lengths {_SETS})
    SELECT w.level, w.book_title, w.chapter, words, coalesce(n, 0) AS n_sentences, true AS words_within, true AS median_within FROM w
    LEFT JOIN l ON w.level = l.level AND w.book_title IS NOT DISTINCT FROM l.book_title AND w.book_author IS NOT DISTINCT FROM l.book_author AND w.chapter IS NOT DISTINCT FROM l.chapter"""
)
def sketched_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of chapters, merged upwards, against exact counts and exact ranks: whether they stay within their bounds."""
    texts = dealt(S.chapters(spark, sf_dir))
    found = summaries.estimates(summaries.sketches_by_level(staged(summaries.chapter_sketches(texts), "sketches")), [0.5])
    words = texts.select(*CHAPTER, F.explode(F.array_distinct(T.words(F.lower("text")))).alias("word")).distinct()
    exact = summaries.distinct_by_level(words).withColumnRenamed("types", "exact")
    counted = texts.select(*CHAPTER, F.explode(T.sentences(F.col("text"))).alias("s")).groupBy(*CHAPTER, T.word_count(F.col("s")).cast("long").alias("length")).agg(F.count("*").alias("n"))
    counted = staged(counted, "lengths")
    key = F.concat_ws("\x1f", "level", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in CHAPTER)).alias("key")
    null = lambda c: F.lit(None).cast(dict(counted.dtypes)[c]).alias(c)
    # Books and the corpus have as many rows as they have lengths of sentences.
    levels = [counted.groupBy(*CHAPTER[:n], "length").agg(F.sum("n").alias("n")).select(F.lit(name).alias("level"), *(F.col(c) if i < n else null(c) for i, c in enumerate(CHAPTER)), "length", "n") for name, n in (("chapter", 3), ("book", 2), ("corpus", 0))]
    lengths = reduce(DataFrame.unionByName, levels).select(key, "length", "n")
    found = found.select("*", key)
    medians = found.select("key", F.get("lengths", F.lit(0)).alias("median"))
    ranks = lengths.join(medians, "key").groupBy("key").agg(
        (F.sum(F.when(F.col("length") < F.col("median"), F.col("n")).otherwise(0)) / F.sum("n")).alias("below"), (F.sum(F.when(F.col("length") <= F.col("median"), F.col("n")).otherwise(0)) / F.sum("n")).alias("upto")
    )
    rows = found.join(exact.select(key, "exact"), "key").join(ranks, "key", "left")
    words_within = F.abs(F.col("words") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * summaries.DISTINCT_BOUND)
    median_within = F.coalesce((F.col("below") <= 0.5 + summaries.RANK_BOUND) & (F.col("upto") >= 0.5 - summaries.RANK_BOUND), F.col("n_sentences") == 0)
    return rows.select("level", "book_title", "chapter", F.col("exact").alias("words"), "n_sentences", words_within.alias("words_within"), median_within.alias("median_within"))


@query(
    f"""{C._COUNTS}, bucketed AS (SELECT *, CASE WHEN n <= 2 THEN n::varchar WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS bucket FROM counts)
    SELECT bucket, lemma, pos, n FROM bucketed QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5(concat('s:', lemma, ':', pos))) <= 20"""
)
def ambiguity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty lemmas of each number of senses."""
    rows = C._sense_counts(spark, sf_dir).withColumn("bucket", measures.bucket(F.col("n")))
    return summaries.bottom_k(rows, ["bucket"], ["lemma", "pos"], 20, "s").select("bucket", "lemma", "pos", "n")


@query(f"SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat('d:', doc_id))) <= 25")
def source_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five documents of each source."""
    return summaries.bottom_k(S.table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"], 25, "d")


@query(
    f"""{S.ANSWERS_SQL},
    opened AS (SELECT *, CASE WHEN json_valid(body) THEN body::json END AS j FROM answers),
    said AS (SELECT *, j->'choices'->0 AS c, j->'choices'->0->'message' AS m, trim(j->'choices'->0->'message'->>'content') AS content, j->'choices'->0->>'finish_reason' AS reason FROM opened),
    inner_json AS (SELECT *, CASE WHEN json_valid(content) AND json_type(content::json) = 'OBJECT' THEN content::json->'choice' END AS x FROM said),
    judged AS (SELECT *, CASE WHEN body IS NULL THEN 'missing' WHEN j IS NULL THEN 'json' WHEN m IS NULL OR json_type(m) <> 'OBJECT' THEN 'form' WHEN coalesce(content, '') = '' AND reason = 'length' THEN 'length'
        WHEN x IS NULL THEN 'choice' WHEN json_type(x) NOT IN ('UBIGINT', 'BIGINT') THEN 'number' WHEN NOT x::varchar::bigint BETWEEN 1 AND options THEN 'range' END AS fault FROM inner_json)
    SELECT lemma, CASE WHEN fault IS NULL THEN x::varchar::int END AS choice, fault FROM judged"""
)
def recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recorded answers of a model say, and what is wrong with those that say nothing."""
    return answers.checked_answers(S.answers(spark, sf_dir)).select("lemma", "choice", "fault")


#: Rows kept in a block.
BLOCK = 400


@query(
    f"""{C._TRIAGE}, waiting AS (SELECT *, coalesce(sum(CASE WHEN chosen_status IS NOT NULL AND chosen_status <> 'known' THEN 1 ELSE 0 END) OVER
        (PARTITION BY {_C} ORDER BY CASE WHEN none_known THEN 0 ELSE 1 END, frequency DESC, lemma, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WHERE NOT all_known)
    SELECT {_C}, lemma, CASE WHEN chosen_status IS NULL THEN 'skipped' WHEN chosen_status = 'known' THEN 'resolved_known' ELSE 'kept' END AS disposition, (before // {BLOCK} + 1)::int AS block FROM waiting"""
)
def triage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of all chapters, each chapter by its own cursor; the chooser is asked for a slice at a time."""
    entries = staged(C._triage_entries(spark, sf_dir).withColumnRenamed("chosen_status", "answer"), "entries")
    parts = list(triage.blocks(entries, BLOCK, lambda asked: asked.withColumn("chosen_status", F.col("answer"))))
    return reduce(DataFrame.unionByName, parts).select(*CHAPTER, "lemma", "disposition", "block")
