"""What a learner knows: an append-only log of events, its latest state, and comparison with a vocabulary."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.schema import BOOK, CARDS, CEFR_LEVELS, CHAPTER, EVENTS, KNOWLEDGE_STATES, LEMMA, ORIGINS, SCHEMA_VERSION, SENSE, hash_key, member, sense_key
from glossmill.sources.staging import staged

TABLES = ("book", "chapter", "lemma", "sense", "occurrence", "event", "card", "learner")
#: Codec of the cards: their guids are random digits, of which it keeps half the bytes and the usual one all.
CARD_CODEC = "zstd"


def latest_states(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The last event's state for each key; events of one time follow their event_id. One partial aggregate, whatever the history's length."""
    key = key or list(SENSE)
    return events.groupBy(*key).agg(F.max_by("state", F.struct("timestamp", "event_id")).alias("state"))


def history(events: DataFrame, senses: DataFrame) -> DataFrame:
    """All events of the given senses in order; those without a book stay."""
    keyed = events.withColumns(dict(zip(SENSE, sense_key(), strict=True)))
    return keyed.join(senses.select(*sense_key()).distinct(), list(SENSE), "left_semi").orderBy("timestamp", "event_id")


def compare(senses: DataFrame, events: DataFrame) -> DataFrame:
    """Adds status: known by the sense's own last state; else a new meaning, if any sense of the lemma is known; else unknown.

    Learning, deferred and forgotten count as not known.
    """
    states = latest_states(events.withColumns(dict(zip(SENSE, sense_key(), strict=True)))).filter("state = 'known'")
    own = states.select(*(F.col(c).alias(f"_{c}") for c in SENSE), F.lit(True).alias("_own"))
    lemmas = states.select(*(F.col(c).alias(f"_l_{c}") for c in LEMMA)).distinct().withColumn("_any", F.lit(True))
    match: Column = F.lit(True)
    for c in SENSE:
        match &= F.coalesce(F.col(c), F.lit("")) == F.col(f"_{c}")
    some: Column = F.lit(True)
    for c in LEMMA:
        some &= F.coalesce(F.col(c), F.lit("")) == F.col(f"_l_{c}")
    status = F.when(F.col("_own"), "known").when(F.col("_any"), "new_meaning_of_known_word").otherwise("unknown")
    return senses.join(own, match, "left").join(lemmas, some, "left").withColumn("status", status).select(*senses.columns, "status")


def compare_each(senses: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """compare() for each learner(key) by their own events: the senses of every lemma that the learner has an event of.

    Of all other lemmas a learner knows nothing, so that those pairs are unknown without a row.
    """
    keyed = events.withColumns(dict(zip(SENSE, sense_key(), strict=True)))
    states = latest_states(keyed, [*key, *SENSE])
    known = states.filter("state = 'known'").select(*key, *(F.col(c).alias(f"_{c}") for c in SENSE), F.lit(True).alias("_own"))
    met = states.groupBy(*key, *(F.col(c).alias(f"_{c}") for c in LEMMA)).agg(F.bool_or(F.col("state") == "known").alias("_any"))
    asked = senses.withColumns({f"_{c}": k for c, k in zip(SENSE, sense_key(), strict=True)})
    rows = asked.join(met, [f"_{c}" for c in LEMMA]).join(known, [*key, *(f"_{c}" for c in SENSE)], "left")
    status = F.when(F.col("_own"), "known").when(F.col("_any"), "new_meaning_of_known_word").otherwise("unknown")
    return rows.withColumn("status", status).select(*key, *senses.columns, "status")


def event_faults(events: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Adds fault to events: the first rule that one breaks, null if it breaks none.

    state, origin: none of the closed values; time: there is none; place: a chapter without a book or the other way round;
    chapter: it names one that chapters(book_title, book_author, chapter) doesn't have.
    """
    closed = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    fault = (
        F.when(closed("state", KNOWLEDGE_STATES), "state").when(closed("origin", ORIGINS), "origin").when(F.col("timestamp").isNull(), "time")
        .when(F.col("book_title").isNull() != F.col("chapter").isNull(), "place")
    )
    if chapters is None:
        return events.withColumn("fault", fault)
    known = chapters.select(*(F.col(c).alias(f"_{c}") for c in CHAPTER)).distinct().withColumn("_there", F.lit(True))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CHAPTER))
    fault = F.when(fault.isNotNull(), fault).when(F.col("chapter").isNotNull() & F.col("_there").isNull(), "chapter")
    return events.join(known, same, "left").select(*events.columns, fault.alias("fault"))


def checked_events(events: DataFrame) -> DataFrame:
    """The events, or an error at the first that breaks the contract: closed values, a time, and book and chapter both or neither."""
    both = F.col("book_title").isNull() == F.col("chapter").isNull()
    good = both & F.col("timestamp").isNotNull()
    return events.withColumns({"state": member("state", KNOWLEDGE_STATES), "origin": member("origin", ORIGINS)}).withColumn(
        "timestamp", F.when(good, F.col("timestamp")).otherwise(F.raise_error(F.lit("an event needs a time, and book and chapter both or neither")))
    )


def fresh_cards(cards: DataFrame, key: list[str]) -> DataFrame:
    """A card a key; by chapter and guid, cards of dealt() chapters are not moved."""
    return cards.dropDuplicates(key)


def _digests(cards: DataFrame) -> DataFrame:
    """How many cards a chapter has, and which, as two exclusive ors over different hashes of their guids: a row a chapter, before anything moves."""
    return cards.groupBy(*CHAPTER).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("guid")).alias("_a"), F.bit_xor(F.xxhash64(F.lit("card"), "guid")).alias("_b"))


class Profile:
    """A learner's tables in one folder, with a schema version. Appends are idempotent by natural key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = {x.getPath().getName() for x in files.listStatus(path)} if files.exists(path) else set()
        if not names:
            spark.createDataFrame([(SCHEMA_VERSION,)], "version int").write.parquet(f"{self.folder}/schema_version")
            return
        if "schema_version" not in names:
            raise ValueError(f"{folder} holds other data, no profile")
        version = spark.read.parquet(f"{self.folder}/schema_version").first()[0]
        if version != SCHEMA_VERSION:
            raise ValueError(f"{folder} has schema version {version}, and {SCHEMA_VERSION} is known")
        if unknown := names - {*TABLES, "schema_version"}:
            raise ValueError(f"{folder} holds unknown tables: {', '.join(sorted(unknown))}")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self._path(name)) if self.has(name) else None

    def ensure(self, name: str, rows: DataFrame, key: list[str]) -> None:
        """Appends rows whose key isn't there yet, with an id made of it."""
        rows = rows.dropDuplicates(key).withColumn("id", hash_key(*key))
        old = self.read(name)
        if old is not None:
            rows = rows.join(old.select("id"), "id", "left_anti")
        rows.write.mode("append").parquet(self._path(name))

    def ensure_books(self, rows: DataFrame) -> None:
        self.ensure("book", rows.select(*BOOK), list(BOOK))

    def ensure_chapters(self, rows: DataFrame) -> None:
        self.ensure("chapter", rows.select(*CHAPTER, *(["title"] if "title" in rows.columns else [])), list(CHAPTER))

    def ensure_lemmas(self, rows: DataFrame) -> None:
        self.ensure("lemma", rows.select(*LEMMA), list(LEMMA))

    def ensure_senses(self, rows: DataFrame) -> None:
        self.ensure("sense", rows.select(*sense_key()), list(SENSE))

    def ensure_occurrences(self, rows: DataFrame) -> None:
        self.ensure("occurrence", rows, [*CHAPTER, *LEMMA])

    def record_events(self, events: DataFrame) -> None:
        """One append for all events: they are all there, or none. Chapters that events name must exist."""
        events = checked_events(events)
        chapters = self.read("chapter")
        named = events.filter("chapter is not null").select(*CHAPTER).distinct()
        missing = named if chapters is None else named.join(chapters, list(CHAPTER), "left_anti")
        if not missing.isEmpty():
            raise ValueError("an event names a chapter that the profile doesn't have")
        old = self.read("event")
        after = 0 if old is None else (old.agg(F.max("event_id")).first()[0] or 0) + 1
        events.withColumn("event_id", F.monotonically_increasing_id() + after).write.mode("append").parquet(self._path("event"))

    def events(self) -> DataFrame:
        old = self.read("event")
        return old if old is not None else self.spark.createDataFrame([], EVENTS).withColumn("event_id", F.lit(0).cast("long"))

    def record_cards(self, cards: DataFrame) -> None:
        """A card's guid is its identity, so exporting it again changes nothing.

        A guid is made of its chapter, too, so that cards meet in their chapter, and those that are dealt by chapter are not moved. A
        chapter whose cards are those that are stored, by their number and two digests of all guids, goes no further; of others alone the
        guids meet. Null and empty text are one identity, so that cards of chapters without a name meet by guid alone.
        """
        cards = cards.select(*(f.name for f in CARDS))
        named = reduce(and_, (F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in CHAPTER))
        old = self.read("card")
        for rows, key, had in ((cards.filter(named), [*CHAPTER, "guid"], old and old.filter(named)), (cards.filter(~named), ["guid"], old and old.filter(~named))):
            rows = fresh_cards(rows, key)
            if had is not None:
                if len(key) > 1:
                    given = _digests(rows)
                    changed = staged(given.join(_digests(had), given.columns, "left_anti").select(*CHAPTER), "changed")
                    if changed.isEmpty():
                        continue
                    rows, had = rows.join(changed, list(CHAPTER), "left_semi"), had.join(changed, list(CHAPTER), "left_semi")
                rows = rows.join(had.select(*key), key, "left_anti")
            rows.write.mode("append").option("compression", CARD_CODEC).parquet(self._path("card"))

    def cefr_level(self) -> str | None:
        row = self.read("learner")
        row = row.first() if row is not None else None
        if row is None or row["cefr_level"] is None:
            return None
        if row["cefr_level"] not in CEFR_LEVELS:
            raise ValueError(f"stored level {row['cefr_level']!r} is none of {CEFR_LEVELS}")
        return row["cefr_level"]

    def set_cefr_level(self, level: str | None) -> None:
        if level is not None and level not in CEFR_LEVELS:
            raise ValueError(f"level {level!r} is none of {CEFR_LEVELS}")
        self.spark.createDataFrame([(1, level)], "id int, cefr_level string").write.mode("overwrite").parquet(self._path("learner"))
