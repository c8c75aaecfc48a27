"""Events in time: the last state as of a moment, spans between events, overlaps of spans, sessions, sliding windows.

Everything is dealt by key and a slot of time, so that one busy learner's events are spread over many tasks; only a row
for each slot goes on to a pass by key alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An end that hasn't come yet, in microseconds.
OPEN_END = 1 << 62
#: Tasks over which rows without a key or a time are dealt.
SALTS = 1024


def micros(text: str) -> int:
    """Microseconds of "6 hours", "7 days", and so on; months and years have no fixed length."""
    number, unit = text.split()
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
    if unit.rstrip("s") not in sizes or int(number) < 1:
        raise ValueError(f"{text!r} is no length of time")
    return int(number) * sizes[unit.rstrip("s")] * 1_000_000


def _kind(rows: DataFrame, c: str) -> str:
    """timestamp or timestamp_ntz; what is made of a column is of its type."""
    return rows.schema[c].dataType.typeName()


def micros_of(time: Column, kind: str) -> Column:
    """Microseconds since 1970; for times without a zone by their own clock, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_micros(time)
    since = (time - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(18,6)")
    return (since * 1_000_000).cast("long")


def time_of(micros: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.timestamp_micros(micros)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros.cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)"))


def as_of(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str], *, tie: Sequence[str] = (), strict: bool = False, forward: bool = False, within: str | None = None,
    slot: str | None = "7 days", prefix: str = "last_",
) -> DataFrame:
    """left with the time and the columns take of the last row of right of the same key(by) up to left's time; null where there is none.

    Rows are ordered by (on, *tie), columns of both sides. strict: only what stands before; forward: the first at or after
    instead. within: nothing further away counts. Both sides go through one exchange by key and slot of time, and one ordered
    pass; what a slot hands on to the next ones is a row for each key and slot. Without a slot, a key is one group. Rows
    of left without a key or a time find nothing, and those of right are not found.
    """
    keys, ties = [f"k{i}" for i in range(len(by))], [f"t{i}" for i in range(len(tie))]
    there = F.col(on).isNotNull()
    for c in by:
        there &= F.col(c).isNotNull()
    found_type = right.select(F.struct(on, *take)).schema[0].dataType
    first = 0 if strict else 1  # of rows at one time, left comes before right if strict
    common = lambda side, salt: [*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), salt.cast("int").alias("salt"), F.col(on).alias("at"), *(F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)), F.lit(side).alias("side")]
    row = F.struct(*left.columns)
    lefts = left.select(*common(first, F.when(there, 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))), row.alias("row"), F.lit(None).cast(found_type).alias("found"))
    rights = right.filter(there).select(*common(1 - first, F.lit(0)), F.lit(None).cast(lefts.schema["row"].dataType).alias("row"), F.struct(on, *take).alias("found"))
    width, kind = micros(slot) if slot else None, _kind(left, on)
    part = F.floor(micros_of(F.col("at"), kind) / F.lit(width)).cast("long") if width else F.lit(0).cast("long")
    rows = lefts.unionByName(rights).withColumn("slot", part)
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    here = Window.partitionBy(*keys, "salt", "slot").orderBy(*map(turn, ["at", *ties]), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("found", ignorenulls=True).over(here)
    if width:
        outermost = F.min_by if forward else F.max_by
        ends = rows.groupBy(*keys, "salt", "slot").agg(outermost("found", F.when(F.col("found").isNotNull(), F.struct("at", *ties))).alias("end"))
        before = Window.partitionBy(*keys, "salt").orderBy(turn("slot")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter("carried is not null").drop("end")
        rows, found = rows.join(carried.hint("merge"), [*keys, "salt", "slot"], "left"), F.coalesce(found, F.col("carried"))
    rows = rows.withColumn("found", found).filter("row is not null")
    if within:
        near = F.abs(micros_of(F.col("at"), kind) - micros_of(F.col("found")[on], kind)) <= micros(within)
        rows = rows.withColumn("found", F.when(near, F.col("found")))
    return rows.select("row.*", *(F.col("found")[c].alias(f"{prefix}{c}") for c in (on, *take)))


def spans(events: DataFrame, by: Sequence[str], on: str, tie: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """events, each with the time from which it holds and the time of the next one of its key, null where it still holds."""
    after = as_of(events, events, by, on, [], tie=tie, strict=True, forward=True, prefix="_next_")
    return after.withColumnsRenamed({f"_next_{on}": end}).withColumn(start, F.col(on))


def _binned(rows: DataFrame, start: str, end: str, widths: Sequence[int]) -> DataFrame:
    """Spans in microseconds with their level: the first whose bins are as wide as the span is long; the last has one bin for all time."""
    low, high = micros_of(F.col(start), _kind(rows, start)), F.coalesce(micros_of(F.col(end), _kind(rows, end)), F.lit(OPEN_END))
    rows = rows.withColumns({"_low": low, "_high": high}).filter("_high > _low")
    level = F.lit(len(widths))
    for i in range(len(widths) - 1, -1, -1):
        level = F.when(F.col("_high") - F.col("_low") <= widths[i], i).otherwise(level)
    return rows.withColumn("_own", level)


def _in_bins(rows: DataFrame, levels: Sequence[int], widths: Sequence[int]) -> DataFrame:
    """A row for each bin that a span meets at each of the levels from its own on: two a level at most."""
    rows = rows.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).filter("_level >= _own")
    bin_of = lambda c: F.when(F.col("_level") == len(widths), 0).otherwise(F.floor(F.col(c) / F.element_at(F.array(*map(F.lit, [*widths, 1])), F.col("_level") + 1))).cast("long")
    rows = rows.withColumn("_last", F.col("_high") - 1)
    rows = rows.withColumns({"_first": bin_of("_low"), "_last": bin_of("_last")})
    return rows.withColumn("_bin", F.explode(F.sequence("_first", "_last"))).drop("_last")


def overlaps(
    left: DataFrame, right: DataFrame, by: Sequence[str], span: tuple[str, str], other: tuple[str, str], width: str = "1 hour", growth: int = 8, levels: int = 6,
) -> DataFrame:
    """Pairs of left and right of the same key(by) whose spans [from, to) overlap, with overlap_from and overlap_to; an end of null is open.

    An equi-join on (key, level, bin): bins of a level are growth times as wide as those below, and a span lives at the
    level where it meets two bins at most, so that a long one isn't in every short bin. Spans meet at the level of the
    longer one, where just that one is at home; a pair in two bins counts in the first. Empty spans overlap nothing, rows
    without a key or a start neither.
    """
    if clash := (set(left.columns) & set(right.columns)) - set(by):
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    widths = [micros(width) * growth**i for i in range(levels)]
    mine, theirs = _binned(left, *span, widths), _binned(right, *other, widths)
    # A level for each set of widths at most: which of them have spans.
    homes = {name: sorted(r["_own"] for r in rows.select("_own").distinct().collect()) for name, rows in (("left", mine), ("right", theirs))}
    if not homes["left"] or not homes["right"]:
        homes = {"left": [levels], "right": [levels]}
    every = sorted({*homes["left"], *homes["right"]})
    named = lambda rows, side: rows.withColumnsRenamed({c: f"{side}{c}" for c in ("_low", "_high", "_own", "_first")})
    a, b = named(_in_bins(mine, every, widths), "_l"), named(_in_bins(theirs, every, widths), "_r")
    key = [*by, "_level", "_bin"]
    real = (F.col("_l_low") < F.col("_r_high")) & (F.col("_r_low") < F.col("_l_high")) & (F.col("_bin") == F.greatest("_l_first", "_r_first"))
    at_home = lambda rows, side: rows.filter(F.col(f"{side}_own") == F.col("_level"))
    pairs = at_home(a, "_l").join(b, key).filter(real).unionByName(a.filter("_l_own < _level").join(at_home(b, "_r"), key).filter(real))
    end, kind = F.least("_l_high", "_r_high"), _kind(left, span[0])
    return pairs.select(
        *left.columns, *(c for c in right.columns if c not in by), time_of(F.greatest("_l_low", "_r_low"), kind).alias("overlap_from"), time_of(F.when(end < OPEN_END, end), kind).alias("overlap_to")
    )


def sessions(events: DataFrame, by: Sequence[str], on: str, gap: str, counts: Mapping[str, Column] | None = None, slot: str = "1 day") -> DataFrame:
    """starts, ends (its last event), n and the counts of each session of a key: events no further than gap from the one before.

    Sessions are found in each slot of time first and then joined across slots, so that a busy key hands on its sessions and not
    its events. Events without a time are in no session.
    """
    counts, kind = counts or {}, _kind(events, on)
    part = F.floor(micros_of(F.col(on), kind) / F.lit(micros(slot)))
    parts = events.groupBy(*by, part.alias("_slot"), F.session_window(on, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    parts = parts.select(*by, F.col("_w.start").alias("_start"), F.col("_w.end").alias("_end"), "n", *counts)
    open_for = F.make_interval(secs=(micros_of(F.col("_end"), kind) - micros_of(F.col("_start"), kind)).cast("decimal(24,0)") / 1_000_000)
    whole = parts.groupBy(*by, F.session_window("_start", open_for).alias("_w")).agg(*(F.sum(c).alias(c) for c in ("n", *counts)))
    return whole.select(*by, F.col("_w.start").alias("starts"), time_of(micros_of(F.col("_w.end"), kind) - micros(gap), kind).alias("ends"), "n", *counts)


def sliding_counts(events: DataFrame, by: Sequence[str], on: str, window: str, slide: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """window_start, window_end, n and the counts of each key and window that has events; windows begin at each multiple of slide.

    Events are counted once for each key and slide, and only those counts are spread over the windows they are in.
    """
    counts, width, step, kind = counts or {}, micros(window), micros(slide), _kind(events, on)
    if width % step:
        raise ValueError(f"{window} isn't a multiple of {slide}")
    small = events.groupBy(*by, F.window(on, slide).alias("_w")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    own = micros_of(F.col("_w.start"), kind)
    spread = small.withColumn("_start", F.explode(F.sequence(own - (width - step), own, F.lit(step).cast("long"))))
    whole = spread.groupBy(*by, "_start").agg(*(F.sum(c).alias(c) for c in ("n", *counts)))
    return whole.select(*by, time_of(F.col("_start"), kind).alias("window_start"), time_of(F.col("_start") + width, kind).alias("window_end"), "n", *counts)
