"""Stand-ins made of the driver's tables, as the engine's own inputs: chapters, tokens, a dictionary, a learner's events.

The prose is invented, so linguistic facts are, too: parts of speech, heads and entries come from hashes. What
matters is that Spark and SQL see the same rows. Each stand-in has its SQL beside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import words
from glossmill.operators.analyzer import Token
from glossmill.operators.vocabulary import EXPRESSION_PARTICLES
from glossmill.schema import CHAPTER
from glossmill.sources.staging import dealt, staged_chapters

WORD_SQL = r"'\p{L}(?:\p{L}|[''-])*'"


def number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def number_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 7))::bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a source is a book, a document its chapter."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_title"), F.lit("unbekannt").alias("book_author"), F.col("doc_id").cast("int").alias("chapter"), "text")


CHAPTERS_SQL = "chapters AS (SELECT source AS book_title, 'unbekannt' AS book_author, doc_id::int AS chapter, text FROM documents)"

TAGS = ("NOUN", "VERB", "ADJ", "ADV", "INTJ", "DET")
SATELLITES = ("prt", "advmod", "dobj", "prep")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all chapters, whose texts are dealt by chapter, so that windows over sentences move no token."""
    return tokens_of(dealt(chapters(spark, sf_dir)))


def tokens_of(chapters: DataFrame) -> DataFrame:
    """Words with the part of speech that a hash of word and place gives, capitals being names.

    Every 13th word or so is a satellite of one of the two before it, of any of four kinds; adverbs among them have
    the lemma of a particle, and what follows a preposition belongs to it, half of the time as a pronoun.
    """
    # Words are found before they are paired, as the generator would look for them twice.
    rows = chapters.select(*CHAPTER, words(F.col("text")).alias("_w"))
    rows = rows.select(*CHAPTER, F.posexplode(F.arrays_zip(F.col("_w").alias("own"), F.concat(F.array(F.lit("")), "_w").alias("before"))).alias("tok_id", "w")).filter("w.own is not null")
    rows = rows.select(*CHAPTER, "tok_id", F.col("w.own").alias("text"), number(F.concat(F.lit("p"), F.lower("w.own"))).alias("g"), number(F.concat(F.lit("p"), F.lower("w.before"))).alias("b"), F.lower("w.own").alias("word"))
    h = number(F.concat("word", F.pmod("tok_id", F.lit(3)).cast("string")))
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.pmod(h, F.lit(6)) + 1).cast("int"))

    def kind(hashed: str, place: Column) -> Column:
        own = (F.pmod(hashed, F.lit(13)) == 0) & (F.pmod(place, F.lit(12)) > 1)
        return F.when(own, F.element_at(F.array(*map(F.lit, SATELLITES)), (F.pmod(F.expr(f"{hashed} div 13"), F.lit(4)) + 1).cast("int")))

    rows = rows.withColumns({"kind": kind("g", F.col("tok_id")), "inner": (kind("b", F.col("tok_id") - 1) == "prep") & (F.pmod("tok_id", F.lit(12)) > 0)})
    rows = rows.withColumn("inner", F.coalesce("inner", F.lit(False)) & F.col("kind").isNull())
    particle = F.element_at(F.array(*map(F.lit, EXPRESSION_PARTICLES)), (F.pmod("g", F.lit(len(EXPRESSION_PARTICLES))) + 1).cast("int"))
    pronoun = F.col("inner") & (F.pmod("g", F.lit(2)) == 0)
    return rows.select(
        *CHAPTER, F.expr("cast(tok_id div 12 as int)").alias("sent_id"), "tok_id", "text", F.when(F.col("kind") == "advmod", particle).otherwise(F.col("word")).alias("lemma"), F.lit(" ").alias("ws"),
        F.when(pronoun, F.lit("PRON")).when(F.substring("text", 1, 1).between("A", "Z"), F.lit("PROPN")).otherwise(tag).alias("pos"), F.when(F.col("inner"), F.lit("pobj")).otherwise(F.coalesce("kind", F.lit("dep"))).alias("dep"),
        F.when(F.col("inner"), F.col("tok_id") - 1).when(F.col("kind").isNotNull(), F.col("tok_id") - 1 - F.pmod("tok_id", F.lit(2))).otherwise(F.col("tok_id")).cast("int").alias("head_id"),
        (~F.contains("text", F.lit("'")) & ~F.contains("text", F.lit("-"))).alias("is_alpha"),  # a word has letters, apostrophes and hyphens
    )


class StandInAnalyzer:
    """The tokens of a text as tokens() has them, for what takes an analyzer."""

    def __init__(self) -> None:
        import regex

        self.word = regex.compile(r"\p{L}(?:\p{L}|['-])*")

    @staticmethod
    @lru_cache(maxsize=1 << 16)
    def _number(text: str) -> int:
        return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)

    @staticmethod
    @lru_cache(maxsize=1 << 16)
    def _said(own: str, third: int) -> tuple[int, str | None, str, str]:
        """Of a word at a place of that rest by three: its number, its kind where its place lets it have one, its word, and its part of speech."""
        word = own.lower()
        g = StandInAnalyzer._number("p" + word)
        return g, SATELLITES[g // 13 % 4] if g % 13 == 0 else None, word, "PROPN" if "A" <= own[0] <= "Z" else TAGS[StandInAnalyzer._number(f"{word}{third}") % 6]

    def sentences(self, text: str) -> Iterator[list[Token]]:
        before, out = None, []
        for i, own in enumerate(self.word.findall(text)):
            g, kind, word, pos = self._said(own, i % 3)
            kind = kind if i % 12 > 1 else None
            inner = kind is None and before == "prep" and i % 12 > 0
            before = kind
            lemma = EXPRESSION_PARTICLES[g % len(EXPRESSION_PARTICLES)] if kind == "advmod" else word
            out.append(Token(own, lemma, " ", "PRON" if inner and g % 2 == 0 else pos, "pobj" if inner else kind or "dep", i - 1 if inner else i - 1 - i % 2 if kind else i))
            if i % 12 == 11:
                yield out
                out = []
        if out:
            yield out


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens as a table, for what reads them several times."""
    return staged_chapters(tokens(spark, sf_dir), "tokens")


def _listed(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


TOKENS_SQL = f"""{CHAPTERS_SQL},
    listed AS (SELECT book_title, book_author, chapter, regexp_extract_all(text, {WORD_SQL}) AS w FROM chapters),
    placed AS (SELECT book_title, book_author, chapter, unnest(range(len(w))) AS i, unnest(w) AS word, unnest(list_prepend('', w[1 : len(w) - 1])) AS before FROM listed WHERE len(w) > 0),
    named AS (SELECT book_title, book_author, chapter, i::int AS tok_id, word AS text, lower(word) AS word, {number_sql("concat('p', lower(word))")} AS g, {number_sql("concat('p', lower(before))")} AS b FROM placed),
    marked AS (SELECT *, CASE WHEN g % 13 = 0 AND tok_id % 12 > 1 THEN {_listed(SATELLITES)}[g // 13 % 4 + 1] END AS kind,
                      b % 13 = 0 AND tok_id > 0 AND (tok_id - 1) % 12 > 1 AND b // 13 % 4 = 3 AND tok_id % 12 > 0 AS after_prep, {number_sql("concat(word, tok_id % 3)")} % 6 AS h FROM named),
    tokens AS (SELECT book_title, book_author, chapter, (tok_id // 12)::int AS sent_id, tok_id, text,
                      CASE WHEN kind = 'advmod' THEN {_listed(EXPRESSION_PARTICLES)}[g % {len(EXPRESSION_PARTICLES)} + 1] ELSE word END AS lemma,
                      CASE WHEN kind IS NULL AND after_prep AND g % 2 = 0 THEN 'PRON' WHEN regexp_matches(text, '^[A-Z]') THEN 'PROPN' ELSE {_listed(TAGS)}[h + 1] END AS pos,
                      CASE WHEN kind IS NULL AND after_prep THEN 'pobj' ELSE coalesce(kind, 'dep') END AS dep,
                      (CASE WHEN kind IS NULL AND after_prep THEN tok_id - 1 WHEN kind IS NOT NULL THEN tok_id - 1 - tok_id % 2 ELSE tok_id END)::int AS head_id, regexp_matches(text, '^\\p{{L}}+$') AS is_alpha FROM marked)"""

ENTRY_POS = ("Noun", "Verb", "Adjective", "Adverb", "Interjection", "Proper_noun")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four senses for each run of one to six neighbouring words of the benchmark; scores have ties."""
    rows = table(spark, sf_dir, "benchmark").select(words(F.lower("text")).alias("w"))
    runs = rows.select("w", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).filter("size(w) >= n")
    heads = runs.select(F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("written_rep")).distinct().withColumn("h", number(F.col("written_rep")))
    senses = heads.select("written_rep", "h", F.explode(F.sequence(F.lit(1), (F.pmod("h", F.lit(4)) + 1).cast("int"))).alias("k"))
    pos = F.element_at(F.array(*map(F.lit, ENTRY_POS)), (F.pmod(F.expr("h div 7 + k div 2"), F.lit(6)) + 1).cast("int"))
    entry = F.concat(F.lit("eng/"), F.replace("written_rep", F.lit(" "), F.lit("_")), F.lit("__"), pos, F.lit("__"), F.col("k").cast("string"))
    return senses.select(
        F.when(F.pmod(F.col("h") + F.col("k"), F.lit(11)) > 0, entry).alias("lexentry"), F.when(F.pmod("h", F.lit(3)) > 0, F.concat(F.lit("sense "), F.col("k").cast("string"))).alias("sense"), "written_rep",
        F.concat(F.lit("t"), F.pmod("h", F.lit(97)).cast("string"), F.lit(" | u"), F.col("k").cast("string")).alias("trans_list"),
        F.pmod(F.expr("h div 3") + F.expr("k div 2"), F.lit(250)).cast("double").alias("score"), F.col("k").cast("long").alias("src_row"), (F.pmod("h", F.lit(1000)) / 10.0).alias("importance"),
    )


DICTIONARY_SQL = f"""bwords AS (SELECT regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM benchmark),
    bruns AS (SELECT w, unnest(range(1, 7)) AS n FROM bwords),
    heads AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS written_rep FROM bruns WHERE len(w) >= n),
    hashed AS (SELECT written_rep, {number_sql("written_rep")} AS h FROM heads),
    sensed AS (SELECT written_rep, h, unnest(range(1, h % 4 + 2)) AS k FROM hashed),
    dictionary AS (SELECT
        CASE WHEN (h + k) % 11 > 0 THEN concat('eng/', replace(written_rep, ' ', '_'), '__', ['Noun', 'Verb', 'Adjective', 'Adverb', 'Interjection', 'Proper_noun'][(h // 7 + k // 2) % 6 + 1], '__', k) END AS lexentry,
        CASE WHEN h % 3 > 0 THEN concat('sense ', k) END AS sense, written_rep, concat('t', h % 97, ' | u', k) AS trans_list,
        ((h // 3 + k // 2) % 250)::double AS score, k AS src_row, (h % 1000) / 10.0 AS importance FROM sensed),
    entries AS (SELECT *, CASE WHEN lexentry IS NOT NULL THEN string_split(lexentry, '__')[2] END AS entry_pos FROM dictionary)"""


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct lower-case word of the documents, with one part of speech."""
    rows = chapters(spark, sf_dir).select(F.explode(words(F.lower("text"))).alias("lemma")).distinct()
    return rows.withColumn("pos", F.element_at(F.array(*map(F.lit, TAGS[:5])), (F.pmod(number(F.col("lemma")), F.lit(5)) + 1).cast("int")))


LEMMAS_SQL = f"""{CHAPTERS_SQL},
    lemmas AS (SELECT lemma, ['NOUN', 'VERB', 'ADJ', 'ADV', 'INTJ'][{number_sql("lemma")} % 5 + 1] AS pos
               FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORD_SQL})) AS lemma FROM chapters))"""


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(str(path))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of learners: the key of props is a sense, of which three make a lemma; the event's type is its state."""
    return events_of(table(spark, sf_dir, "events"))


def events_of(rows: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    states = F.element_at(F.array(*map(F.lit, ("known", "learning", "deferred", "forgotten"))), (F.pmod(number(F.col("event_type")), F.lit(4)) + 1).cast("int"))
    return rows.select(
        "event_id", "user_id", F.concat(F.lit("lemma "), F.expr(f"cast(get_json_object(props, '$.k') as int) div 3").cast("string")).alias("lemma"), F.lit("NOUN").alias("pos"),
        F.concat(F.lit("entry "), k.cast("string")).alias("lexentry"), F.when(F.pmod(k, F.lit(2)) == 0, F.lit("")).alias("sense"), F.lit(None).cast("string").alias("trans_list"), states.alias("state"), F.col("ts").alias("timestamp"),
    )


EVENTS_SQL = f"""log AS (SELECT event_id, user_id, concat('lemma ', (props->>'$.k')::int // 3) AS lemma, 'NOUN' AS pos, concat('entry ', (props->>'$.k')::int) AS lexentry,
    ['known', 'learning', 'deferred', 'forgotten'][{number_sql("event_type")} % 4 + 1] AS state, ts FROM events)"""


#: What a model server may answer, by kind: @ stands for a number of 0 to 6, and a kind beyond the list answers as the last one.
_SAID = '{"choices": [{"message": {"role": "assistant", "content": #}, "finish_reason": "stop"}]}'
BODIES = [
    None, "<html>busy</html>", '{"error": "overloaded"}', '{"choices": []}', _SAID.replace("#", '""').replace("stop", "length"), _SAID.replace("#", "null"), _SAID.replace("#", '"I would say @"'),
    _SAID.replace("#", r'"{\"answer\": @}"'), _SAID.replace("#", r'"{\"choice\": @.5}"'), _SAID.replace("#", r'"{\"choice\": true}"'), _SAID.replace("#", r'"{\"choice\": 1@9}"'), _SAID.replace("#", r'" {\"choice\": @} "'),
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lemma, options and the body of a model server's answer: each distinct word has one, and more than half of them are at fault."""
    h = number(F.concat(F.lit("a"), "lemma"))
    body = F.element_at(F.array(*(F.lit(b) for b in BODIES)), F.expr(f"cast(least(h % 16, {len(BODIES) - 1}) + 1 as int)"))
    return lemmas(spark, sf_dir).select("lemma", h.alias("h")).select("lemma", F.expr("cast(h div 16 % 5 + 1 as int)").alias("options"), F.replace(body, F.lit("@"), F.expr("cast(h div 80 % 7 as string)")).alias("body"))


ANSWERS_SQL = f"""WITH {LEMMAS_SQL}, drawn AS (SELECT lemma, {number_sql("concat('a', lemma)")} AS h FROM lemmas),
    answers AS (SELECT lemma, (h // 16 % 5 + 1)::int AS options, replace([{", ".join("NULL" if b is None else f"'{b}'" for b in BODIES)}][least(h % 16, {len(BODIES) - 1}) + 1], '@', (h // 80 % 7)::varchar) AS body FROM drawn)"""
