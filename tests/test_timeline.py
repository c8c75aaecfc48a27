from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glossmill.operators import timeline
from glossmill.streaming import states, windows

T0 = dt.datetime(2024, 3, 1)
EVENTS = "event_id long, who string, sense string, state string, timestamp timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def log(seed, n, hours=24 * 40, who=4):
    """Events with ties in time, missing keys and times, and a learner who has half of them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name = "hot" if r.random() < 0.5 else r.choice([None, *(f"w{k}" for k in range(who))])
        rows.append((i, name, r.choice(["a", "b", "c", None]), r.choice(["known", "learning"]), None if r.random() < 0.05 else at(60 * r.randrange(hours))))
    return rows


def as_of_by_loop(left, right, strict, forward, within):
    out = []
    for l in left:
        best = None
        for r in right:
            if None in (l[1], l[4], r[1], r[4]) or l[1] != r[1]:
                continue
            a, b = (r[4], r[0]), (l[4], l[0])
            before = (a > b if strict else a >= b) if forward else (a < b if strict else a <= b)
            if before and (best is None or ((a < (best[4], best[0])) if forward else (a > (best[4], best[0])))):
                best = r
        if best and within and abs(best[4] - l[4]) > within:
            best = None
        out.append((l[0], l[1], l[4], best[4] if best else None, best[3] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("strict", "forward", "within", "slot"), [(False, False, None, "7 days"), (True, False, None, "1 hour"), (False, True, "20 hours", "2 days"), (True, True, None, None), (False, False, "1 day", None)])
def test_as_of_equals_a_loop(spark, strict, forward, within, slot):
    rows = log(1, 300)
    left, right = rows[:150], rows[150:] + rows[:40]
    a, b = spark.createDataFrame(left, EVENTS), spark.createDataFrame(right, EVENTS)
    got = timeline.as_of(a.select("event_id", "who", "timestamp"), b, ["who"], "timestamp", ["state"], tie=["event_id"], strict=strict, forward=forward, within=within, slot=slot)
    limit = {"20 hours": dt.timedelta(hours=20), "1 day": dt.timedelta(days=1)}.get(within)
    assert sorted(map(tuple, got.collect()), key=repr) == as_of_by_loop(left, right, strict, forward, limit)


def test_as_of_moves_rows_once_and_compares_no_pairs(spark):
    rows = spark.createDataFrame(log(2, 50), EVENTS)
    whole = timeline.as_of(rows, rows, ["who"], "timestamp", ["state"], tie=["event_id"], slot=None)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange hashpartitioning") == 1 and "Join" not in whole
    dealt = timeline.as_of(rows, rows, ["who"], "timestamp", ["state"], tie=["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in dealt and "Cartesian" not in dealt
    # Whole rows are in one exchange, by key and slot; the others have what a slot hands on.
    assert sum("row#" in line for line in dealt.split("\n") if "Sort [k0" in line) <= 1


def test_as_of_keeps_columns_called_like_helpers(spark):
    left = spark.createDataFrame([(1, at(5), 9, "x", "y")], "k0 int, at timestamp, slot int, side string, row string")
    right = spark.createDataFrame([(1, at(4), 3)], "k0 int, at timestamp, found int")
    got = timeline.as_of(left, right, ["k0"], "at", ["found"])
    assert got.columns == ["k0", "at", "slot", "side", "row", "last_at", "last_found"] and tuple(got.head()) == (1, at(5), 9, "x", "y", at(4), 3)
    assert timeline.as_of(left.limit(0), right, ["k0"], "at", ["found"]).count() == 0
    assert timeline.as_of(left, right.limit(0), ["k0"], "at", ["found"]).head()["last_found"] is None


def test_spans_follow_one_another(spark):
    rows = [(1, "a", "s", "known", at(0)), (2, "a", "s", "learning", at(60)), (3, "a", "s", "known", at(60)), (4, "b", "s", "known", at(7)), (5, "a", "s", "known", at(60 * 24 * 30))]
    got = timeline.spans(spark.createDataFrame(rows, EVENTS), ["who", "sense"], "timestamp", ["event_id"]).collect()
    assert {r["event_id"]: (r["valid_from"], r["valid_to"]) for r in got} == {1: (at(0), at(60)), 2: (at(60), at(60)), 3: (at(60), at(60 * 24 * 30)), 4: (at(7), None), 5: (at(60 * 24 * 30), None)}


@pytest.mark.parametrize("zone", ["timestamp", "timestamp_ntz"])
def test_overlaps_equal_all_pairs(spark, zone):
    r = random.Random(4)

    def some(n, first):
        out = []
        for i in range(n):
            start = r.randrange(60 * 24 * 60)
            length = r.choice([0, 1, 30, 60, 61, 600, 9_000, 60_000, None, -5])
            out.append((first + i, r.choice(["a", "b", None]), None if r.random() < 0.05 else at(start), None if length is None else at(start + length)))
        return out

    left, right = some(120, 0), some(120, 1000)
    a = spark.createDataFrame(left, f"l long, who string, l_from {zone}, l_to {zone}")
    b = spark.createDataFrame(right, f"r long, who string, r_from {zone}, r_to {zone}")
    got = timeline.overlaps(a, b, ["who"], ("l_from", "l_to"), ("r_from", "r_to"), growth=4, levels=5)
    far, want = dt.datetime(9999, 1, 1), set()
    for x in left:
        for y in right:
            if None in (x[1], x[2], y[1], y[2]) or x[1] != y[1]:
                continue
            ends = x[3] or far, y[3] or far
            if x[2] < ends[0] and y[2] < ends[1] and max(x[2], y[2]) < min(ends):
                want.add((x[0], y[0], max(x[2], y[2]), None if min(ends) == far else min(ends)))
    rows = [(r["l"], r["r"], r["overlap_from"], r["overlap_to"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 200
    assert timeline.overlaps(a.limit(0), b, ["who"], ("l_from", "l_to"), ("r_from", "r_to")).count() == 0
    with pytest.raises(ValueError, match="both sides have r"):
        timeline.overlaps(a.withColumn("r", F.lit(1)), b, ["who"], ("l_from", "l_to"), ("r_from", "r_to"))


def test_a_long_span_is_in_few_bins(spark):
    widths = [timeline.micros("1 hour") * 8**i for i in range(6)]
    long = spark.createDataFrame([(1, at(7), at(60 * 24 * 365)), (2, at(7), at(8)), (3, at(7), None)], "l long, a timestamp, b timestamp")
    rows = timeline._in_bins(timeline._binned(long, "a", "b", widths), list(range(7)), widths)
    assert {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}[1] <= 4
    plan = timeline.overlaps(long.withColumn("k", F.lit(1)), long.select(F.col("a").alias("c"), F.col("b").alias("d"), F.lit(1).alias("k")), ["k"], ("a", "b"), ("c", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def sessions_by_loop(rows, gap):
    out = {}
    for who in {r[1] for r in rows}:
        times = sorted((r[4], r[3]) for r in rows if r[1] == who and r[4] is not None)
        for i, (t, state) in enumerate(times):
            if i == 0 or t - times[i - 1][0] > gap:
                first = t
                out[who, first] = [t, 0, 0]
            out[who, first][0] = t
            out[who, first][1] += 1
            out[who, first][2] += state == "known"
    return {(w, s, *v) for (w, s), v in out.items()}



def counts():
    return {"known": F.col("state") == "known"}


@pytest.mark.parametrize("slot", ["1 hour", "1 day", "10 weeks"])
def test_sessions_equal_a_loop(spark, slot):
    rows = log(5, 400)
    got = timeline.sessions(spark.createDataFrame(rows, EVENTS), ["who"], "timestamp", "6 hours", counts(), slot)
    assert {tuple(r) for r in got.collect()} == sessions_by_loop(rows, dt.timedelta(hours=6))


def test_sliding_counts_equal_a_loop(spark):
    rows, day, want = log(6, 200), dt.timedelta(days=1), {}
    for _, who, _, state, t in rows:
        if t is not None:
            for back in range(7):
                start = dt.datetime(t.year, t.month, t.day) - back * day
                n = want.setdefault((who, start, start + 7 * day), [0, 0])
                n[0] += 1
                n[1] += state == "known"
    got = timeline.sliding_counts(spark.createDataFrame(rows, EVENTS), ["who"], "timestamp", "7 days", "1 day", counts())
    assert {tuple(r) for r in got.collect()} == {(*k, *v) for k, v in want.items()}
    with pytest.raises(ValueError, match="multiple"):
        timeline.sliding_counts(spark.createDataFrame(rows, EVENTS), ["who"], "timestamp", "7 days", "2 days")


def run(spark, tmp_path, batches, make, mode="append"):
    """Each batch is a run of the stream from where the last one ended; the rows that came out, and each run's progress."""
    own, folder, progress = states.stream_session(spark), str(tmp_path / "out"), []
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(own.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
        q = states.start(stream, states.append_changes(folder), str(tmp_path / "checkpoint"), mode)
        q.awaitTermination()
        progress.append([p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]])
    return spark.read.parquet(folder), progress


def test_streamed_sessions_drop_late_rows_and_close(spark, tmp_path):
    first = [(1, "a", "s", "known", at(0)), (2, "a", "s", "known", at(30)), (3, "b", "s", "learning", at(10))]
    second = [(4, "a", "s", "known", at(60 * 24)), (5, "a", "s", "known", at(45))]  # within the lateness of the first run
    third = [(6, "a", "s", "known", at(50)), (7, "c", "s", "known", at(60 * 48))]  # event 6 is behind the watermark
    rows, progress = run(spark, tmp_path, [first, second, third], lambda e: windows.stream_sessions(e, ["who"], "timestamp", "1 hour", "2 hours", counts()))
    got = {tuple(r) for r in rows.drop("batch").collect()}
    assert got == sessions_by_loop([*first, *second], dt.timedelta(hours=1)) and sum(p["numRowsDroppedByWatermark"] for ps in progress for p in ps) == 1


def test_state_of_sliding_windows_shrinks_behind_the_watermark(spark, tmp_path):
    day = 60 * 24
    first = [(i, f"w{i}", "s", "known", at(i)) for i in range(30)]
    second = [(99, "a", "s", "known", at(30 * day))]
    third = [(100, "w1", "s", "known", at(2)), (101, "a", "s", "known", at(31 * day))]  # event 100 is too late
    rows, progress = run(spark, tmp_path, [first, second, third], lambda e: windows.stream_sliding_counts(e, ["who"], "timestamp", "7 days", "1 day", "1 day", counts()))
    held = [p["numRowsTotal"] for ps in progress for p in ps]
    assert max(held) >= 7 * 30 and held[-1] <= 8 and sum(p["numRowsDroppedByWatermark"] for ps in progress for p in ps) >= 7
    events = spark.createDataFrame([*first, *second, third[1]], EVENTS)
    want = {tuple(r) for r in timeline.sliding_counts(events, ["who"], "timestamp", "7 days", "1 day", counts()).filter(F.col("window_end") <= F.lit(at(30 * day))).collect()}
    assert {tuple(r) for r in rows.drop("batch").collect()} == want


def test_keyed_state_equals_the_batch_after_restarts(spark, tmp_path):
    rows = [r for r in log(7, 200) if r[4] is not None]
    random.Random(8).shuffle(rows)
    batches = [rows[:70], rows[50:120], rows[120:]]  # out of order, and some twice
    own, folder = states.stream_session(spark), str(tmp_path / "out")
    changed, _ = run(spark, tmp_path, batches, lambda e: states.stream_latest_states(e, ["who", "sense"]), "update")
    want = {}
    for i, who, sense, state, t in rows:
        want[who, sense] = max(want.get((who, sense), (dt.datetime.min, -1, "")), (t, i, state))
    got = states.current_states(spark, folder, ["who", "sense"]).collect()
    assert {(r["who"], r["sense"]): (r["timestamp"], r["event_id"], r["state"]) for r in got} == want
    assert {r["batch"] for r in changed.select("batch").distinct().collect()} == {0, 1, 2}


def test_silent_keys_expire_by_a_timer(spark, tmp_path):
    first = [(1, "a", "s", "known", at(0)), (2, "b", "s", "known", at(60))]
    second = [(3, "b", "s", "learning", at(60 * 30)), (4, "c", "s", "known", at(60 * 40))]
    third = [(5, "d", "s", "known", at(60 * 41))]
    make = lambda e: states.stream_latest_states(e.withWatermark("timestamp", "1 hour"), ["who"], expiry_ms=24 * 3_600_000)
    rows, progress = run(spark, tmp_path, [first, second, third], make, "update")
    assert {r["who"] for r in rows.filter("kind = 'expired'").collect()} == {"a"}
    assert {r["who"]: r["state"] for r in states.current_states(spark, str(tmp_path / "out"), ["who"]).collect()} == {"b": "learning", "c": "known", "d": "known"}
    assert progress[-1][-1]["numRowsTotal"] <= 3 * 3  # a's state is gone; a key has its state and its timer


def test_states_without_expiry_are_held_without_python(spark, tmp_path):
    schema = "who string, state string, timestamp timestamp, event_id long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    events = states.stream_session(spark).readStream.schema(schema).parquet(str(tmp_path / "in"))
    plan = lambda **k: states.stream_latest_states(events.withWatermark("timestamp", "1 hour"), ["who"], **k)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan() and "TransformWithState" in plan(expiry_ms=1000)
