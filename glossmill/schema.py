"""Row types of the engine, closed sets of values, and the keys by which rows are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# Stored texts of the enumerations.
KNOWLEDGE_STATES = ("known", "learning", "deferred", "forgotten")
ORIGINS = ("triage", "bulk_mark", "word_limit", "preset")
CARD_DIRECTIONS = ("en_de", "de_en", "cloze")
CEFR_LEVELS = ("a1", "a2", "b1", "b2", "c1")
VOCABULARY_STATUSES = ("unknown", "known", "new_meaning_of_known_word")
TRIAGE_ORDERS = ("new_words_first", "frequency")
SCHEMA_VERSION = 2


def _of(**fields) -> StructType:
    return StructType([StructField(k, t, True) for k, t in fields.items()])


_S, _I, _L, _B = StringType(), IntegerType(), LongType(), BooleanType()

CHAPTERS = _of(book_title=_S, book_author=_S, chapter=_I, title=_S, text=_S)
TOKENS = _of(book_title=_S, book_author=_S, chapter=_I, sent_id=_I, tok_id=_I, text=_S, lemma=_S, ws=_S, pos=_S, dep=_S, head_id=_I, is_alpha=_B)
OCCURRENCES = _of(book_title=_S, book_author=_S, chapter=_I, lemma=_S, pos=_S, word_form=_S, example_sentence=_S, frequency=_L, proper_noun_frequency=_L, first_tok=_I)
DICTIONARY = _of(lexentry=_S, sense_num=_S, sense=_S, written_rep=_S, trans_list=_S, score=DoubleType(), is_good=_I, importance=DoubleType())
EVENTS = _of(lemma=_S, pos=_S, lexentry=_S, sense=_S, trans_list=_S, state=_S, origin=_S, timestamp=TimestampType(), book_title=_S, book_author=_S, chapter=_I)
CARDS = _of(guid=_S, book_title=_S, book_author=_S, chapter=_I, lemma=_S, pos=_S, lexentry=_S, sense=_S, card_direction=_S)
BOOK_STRUCTURE = _of(path=_S, book_title=_S, book_author=_S, chapter=_I, title=_S, documents=ArrayType(_S), level=_I, notice=_S)

BOOK = ("book_title", "book_author")
CHAPTER = (*BOOK, "chapter")
LEMMA = ("lemma", "pos")
#: What a learner knows is a snapshot of dictionary content, so that a new dictionary doesn't change it.
SENSE = (*LEMMA, "lexentry", "sense", "trans_list")


def sense_key() -> list[Column]:
    """The identity of a sense; null and empty text are the same."""
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SENSE]


def hash_key(*columns: str) -> Column:
    """A stable row key in place of a sequence number; lengths keep neighbouring values apart."""
    parts = [F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def member(column: str, allowed: tuple[str, ...]) -> Column:
    """The column's value, or an error if it isn't one of the allowed ones."""
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: "), F.coalesce(F.col(column), F.lit("null")))))
