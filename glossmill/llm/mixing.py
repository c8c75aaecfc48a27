"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget.

Each source gets a share of the total by its weight, at most so many times its own size; what that leaves over is
shared again by weight. A source is taken in whole epochs and then in the order of hash-random keys up to the exact
word of its budget, so that one document of a source is cut at most.

All of it is DataFrame operations. Rows are dealt by the range of (source, key), so that a source with a third of all
rows is spread over as many tasks as its rows need; running totals are summed in each range and then shifted by the
totals of the ranges before. The same running totals rank the sources and find their water level.

Defined results: a null text has size 0; a null source is one source, the last; null doc_ids share one key and are
told apart by size; repeated rows are rows like others; rows that tie in key and size go in the order of their
text's hash, and equal rows are interchangeable; a table without words has targets of 0; an empty table gives an
empty result. Texts are counted whole, however long. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.common import join_sized, materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: So many times the size of its source a target is at most.
MOST = 3

_SPACE = r"\x20\x09-\x0D"
_WIDE = "decimal(38,0)"


def words_in(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space: each run becomes one letter, so that no list of words is made."""
    runs = F.regexp_replace(text, f"[{_SPACE}]*+[^{_SPACE}]++[{_SPACE}]*+", "x")
    return F.coalesce(F.length(F.regexp_replace(runs, f"[{_SPACE}]", "")).cast("long"), F.lit(0).cast("long"))


def random_key(value: Column, seed: int) -> Column:
    """60 bits of a digest of the seed and the value's text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def running_totals(spark: SparkSession, rows: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """rows, each with the sums of what stands before it in the order: sums has the new column's name by the column it adds up.

    Rows are dealt by range; only one total for each range passes through one task. The order should tell all rows apart.
    """
    ranged = materialize(spark, rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_total_{i}") for i, c in enumerate(sums)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_total_{i}").over(before), F.lit(0)).alias(f"_offset_{i}") for i in range(len(sums))))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.repartitionByRange("_range").withColumns({new: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, new in sums.items()})
    shifted = placed.join(F.broadcast(offsets), "_range")  # a row for each range, of which there are as many as shuffle partitions
    return shifted.withColumns({new: (F.col(new) + F.col(f"_offset_{i}")).alias(new) for i, new in enumerate(sums.values())}).drop("_range", *(f"_offset_{i}" for i in range(len(sums))))


def source_targets(spark: SparkSession, sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (name, n_rows, source_size; one row a source), with rank from 0, base (words of the sources before) and target.

    A source is capped where its share, with all sources of a smaller ratio of cap to weight capped, is above its cap. Shares fall
    along that order once no cap binds, so that the first source without a cap has the level of all that follow it.
    """
    ranked = running_totals(spark, sizes.withColumn("_one", F.lit(1).cast("long")), [F.col("name").asc_nulls_last()], {"_one": "rank", "source_size": "base"}).drop("_one")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    level = running_totals(spark, capped, [F.col("cap") / F.col("weight"), F.col("rank")], {"cap": "_capped", "weight": "_spent"})
    level = materialize(spark, level, "levels")
    whole = level.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    rows = level.crossJoin(F.broadcast(whole))  # one row
    left, share = F.col("_all") - F.col("_capped"), F.col("_weights") - F.col("_spent")
    rows = rows.withColumns({"_left": left, "_share": share, "_free": (left.cast(_WIDE) * F.col("weight")) <= (F.col("cap").cast(_WIDE) * share)})
    first = rows.filter("_free").agg(F.min_by(F.struct("_left", "_share"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"))).alias("_level"))
    rows = rows.crossJoin(F.broadcast(first))  # one row
    target = F.when(F.col("_free"), F.col("_level._left").cast("double") * F.col("weight") / F.col("_level._share").cast("double")).otherwise(F.col("cap").cast("double"))
    return rows.select("name", "n_rows", "source_size", "rank", "base", target.alias("target"))


def mixture(spark: SparkSession, docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, epochs (whole copies taken), cut (words of one more copy), taken.

    carry names further columns of docs that come along, as the text for `copies`; they are shuffled with the rows.
    """
    size = words_in(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), random_key(F.col("doc_id"), seed).alias("_key"), F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_uid"), *(F.col(c).alias(f"_carried_{c}") for c in carry))
    rows = materialize(spark, rows.withColumn("_name", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))), "sizes")
    sizes = rows.groupBy("_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"), F.first("source").alias("name"))
    targets = source_targets(spark, sizes.drop("_name"), weights, most).withColumn("_name", F.coalesce(F.concat(F.lit("+"), "name"), F.lit("-"))).drop("name")
    targets = materialize(spark, targets, "targets")
    n = (targets.agg(F.sum("n_rows")).head() or [0])[0] or 0
    placed = running_totals(spark, join_sized(rows, targets, ["_name"], "n_rows", n), [F.col(c) for c in ("rank", "_key", "size", "_tie", "_uid")], {"size": "_before"})
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumns({"epochs": epochs, "_place": F.col("_before") - F.col("base")})
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("_place")
    placed = placed.withColumn("cut", F.least(F.greatest(rest, F.lit(0).cast("long")), F.col("size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs", "cut", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), *(F.col(f"_carried_{c}").alias(c) for c in carry))


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy of a document that it takes, with its epoch from 1; of a cut copy the text ends behind its last word.

    mixed comes from `mixture` with the text carried. Documents without words are in every whole epoch of their source.
    """
    last = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[{_SPACE}]*+[^{_SPACE}]++"), F.lit(0)), F.lit(1), F.col("cut").cast("int")), "")
    count = (F.col("epochs") + F.when(F.col("cut") > 0, 1).otherwise(0)).cast("int")
    rows = mixed.filter(count > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), count)))
    part = (F.col("epoch") > F.col("epochs")) & (F.col("cut") < F.col("size"))
    return rows.select("doc_id", "source", "epoch", F.when(part, F.col("cut")).otherwise(F.col("size")).alias("size"), F.when(part, last).otherwise(F.col("text")).alias("text"))
