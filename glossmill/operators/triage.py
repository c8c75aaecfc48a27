"""Triage: order by frequency, the part beyond a limit, bulk marks, and dispositions with early stop as window plans."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.schema import CHAPTER, TRIAGE_ORDERS
from glossmill.sources.staging import staged

WORD_BLOCK, EXPRESSION_BLOCK = 25, 11


def by_frequency() -> list[Column]:
    return [F.col("frequency").desc(), F.col("lemma").asc(), F.col("pos").asc()]


def ranked(occurrences: DataFrame) -> DataFrame:
    """Adds rank within the chapter: most frequent first, then by lemma and part of speech."""
    return occurrences.withColumn("rank", F.row_number().over(Window.partitionBy(*CHAPTER).orderBy(*by_frequency())))


def beyond_word_limit(occurrences: DataFrame, limit: int) -> DataFrame:
    """What stands after the limit most frequent rows of each chapter."""
    if limit < 0:
        raise ValueError("a limit isn't negative")
    return ranked(occurrences).filter(F.col("rank") > limit).drop("rank")


def bulk_mark(occurrences: DataFrame, selected: DataFrame) -> DataFrame:
    """All rows of a chapter up to the selected one, itself included; selected(chapter key, lemma, pos) has one row a chapter."""
    named = selected.select(*CHAPTER, F.struct("lemma", "pos").alias("_selected")).distinct()
    rows = ranked(occurrences).join(named, list(CHAPTER))
    upto = F.max(F.when(F.struct("lemma", "pos") == F.col("_selected"), F.col("rank"))).over(Window.partitionBy(*CHAPTER))
    return rows.withColumn("_upto", upto).filter(F.col("rank") <= F.col("_upto")).drop("rank", "_selected", "_upto")


def ensure_members(occurrences: DataFrame, selected: DataFrame) -> None:
    if not selected.join(occurrences, [*CHAPTER, "lemma", "pos"], "left_anti").isEmpty():
        raise ValueError("a selected row isn't in the list")


def candidate_flags(statuses: DataFrame, key: list[str]) -> DataFrame:
    """all_known: it has candidates, and each is known; none_known: no candidate is known, an empty list included.

    statuses: a row a candidate; status null where an entry has none.
    """
    known = F.col("status") == "known"
    return statuses.groupBy(*key).agg(
        (F.coalesce(F.bool_and(known), F.lit(False)) & (F.count("status") > 0)).alias("all_known"), (~F.coalesce(F.bool_or(known), F.lit(False))).alias("none_known")
    )


def dispositions(entries: DataFrame, limit: int, order: str = "new_words_first", key: tuple[str, ...] = CHAPTER) -> DataFrame:
    """Adds disposition: known, resolved_known, skipped, kept or remaining; the counts add up to the input.

    entries: frequency, lemma, pos, all_known, none_known, chosen_status (null: no sense fits). A row is looked at
    as long as fewer than limit rows before it were kept: a running count, where the rule reads as a loop. Display
    goes by frequency again, so no order is promised.
    """
    if limit < 1:
        raise ValueError("a limit of at least 1 is needed")
    if order not in TRIAGE_ORDERS:
        raise ValueError(f"order {order!r} is none of {TRIAGE_ORDERS}")
    certain_first = [F.when(F.col("none_known"), 0).otherwise(1)] if order == "new_words_first" else []
    own = Window.partitionBy(*key, "all_known").orderBy(*certain_first, *by_frequency())
    kept = F.when(F.col("chosen_status").isNotNull() & (F.col("chosen_status") != "known"), 1).otherwise(0)
    before = F.coalesce(F.sum(kept).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = (
        F.when(F.col("all_known"), "known")
        .when(before >= limit, "remaining")
        .when(F.col("chosen_status").isNull(), "skipped")
        .when(F.col("chosen_status") == "known", "resolved_known")
        .otherwise("kept")
    )
    return entries.withColumn("disposition", found)


def blocks(entries: DataFrame, limit: int, choose, order: str = "new_words_first", key: tuple[str, ...] = CHAPTER):
    """Blocks of kept rows for a dear chooser, which sees no row in vain: slices of what is still missing.

    choose: DataFrame of entries -> the same with chosen_status. Each chapter has its own cursor and its own count in a
    frontier table: its block ends when limit of its own rows are kept, or it has no more. Yields the chapters' first blocks,
    then the second blocks of those that go on, and so on, with disposition and the number of the block.
    """
    if limit < 1:
        raise ValueError("a limit of at least 1 is needed")
    if order not in TRIAGE_ORDERS:
        raise ValueError(f"order {order!r} is none of {TRIAGE_ORDERS}")
    certain_first = [F.when(F.col("none_known"), 0).otherwise(1)] if order == "new_words_first" else []
    names = [f"_k{i}" for i in range(len(key))]
    own = Window.partitionBy(*key).orderBy(*certain_first, *by_frequency())
    keys = [F.col(c).alias(k) for c, k in zip(key, names, strict=True)]
    waiting = entries.filter("not all_known").select(*keys, F.row_number().over(own).alias("_turn"), F.struct(*entries.columns).alias("_row"))
    # In the order of turns, so that a slice is read from the few pages of a file that may have its turns.
    waiting = staged(waiting.sortWithinPartitions("_turn"), "waiting")
    meets = reduce(and_, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names))

    # Where each chapter that has more rows stands, and how many rows of the block it has; one that is through is not in the table.
    frontier = staged(waiting.groupBy(*names).agg(F.max("_turn").alias("_total")).withColumns({"_at": F.lit(0), "_kept": F.lit(0).cast("long")}), "frontier")
    going, block = not frontier.isEmpty(), 0
    while going:
        block += 1
        resting, parts = [], []
        while True:
            upto = (F.col("_at") + limit - F.col("_kept")).cast("int")
            low, high = frontier.agg(F.min("_at"), F.max(upto)).first()
            if low is None:
                break
            asked = waiting.filter((F.col("_turn") > low) & (F.col("_turn") <= high)).alias("l").join(frontier.alias("r"), meets).filter((F.col("_turn") > F.col("_at")) & (F.col("_turn") <= upto))
            part = staged(choose(asked.select("_row.*")), "slice")
            parts.append(part)
            kept = part.groupBy(*keys).agg(F.count_if(F.col("chosen_status").isNotNull() & (F.col("chosen_status") != "known")).alias("_more"))
            moved = frontier.filter(upto < F.col("_total")).withColumn("_at", upto).alias("l").join(kept.alias("r"), meets, "left")
            moved = staged(moved.select(*(F.col(f"l.{k}").alias(k) for k in names), "_total", "_at", (F.col("_kept") + F.coalesce("_more", F.lit(0))).alias("_kept")), "frontier")
            resting.append(moved.filter(F.col("_kept") >= limit))
            frontier = moved.filter(F.col("_kept") < limit)
        found = F.when(F.col("chosen_status").isNull(), "skipped").when(F.col("chosen_status") == "known", "resolved_known").otherwise("kept")
        yield reduce(DataFrame.unionByName, parts).withColumns({"disposition": found, "block": F.lit(block)})
        frontier = staged(reduce(DataFrame.unionByName, resting).withColumn("_kept", F.lit(0).cast("long")), "frontier")
        going = not frontier.isEmpty()
