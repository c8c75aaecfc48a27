from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glossmill.operators import preset, profile, triage
from glossmill.schema import EVENTS
from glossmill.streaming import states

T0 = dt.datetime(2024, 5, 1, 12, 0)
SENSES = "lemma string, pos string, lexentry string, sense string, trans_list string"


def event(lemma, state, minute, lexentry="e", sense=None, book=None):
    return (lemma, "NOUN", lexentry, sense, "t", state, "triage", T0 + dt.timedelta(minutes=minute), *(book or (None, None, None)))


SCHEMA = StructType([*EVENTS.fields, StructField("event_id", LongType())])


def log(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def status(spark, events, *senses):
    got = profile.compare(spark.createDataFrame(list(senses), SENSES), events).collect()
    return {(r["lemma"], r["sense"]): r["status"] for r in got}


def test_status_of_own_and_sibling_senses(spark):
    events = log(spark, event("watch", "known", 1), event("bank", "learning", 2), event("saw", "known", 5), event("saw", "forgotten", 3), event("red", "known", 1), event("red", "deferred", 1))
    got = status(spark, events, *((w, "NOUN", "e", None, "t") for w in ("watch", "bank", "saw", "red", "new")), ("watch", "NOUN", "e", "guard", "w"))
    assert status(spark, events, ("watch", "VERB", "e", None, "t")) == {("watch", None): "unknown"}
    assert got == {("watch", None): "known", ("bank", None): "unknown", ("saw", None): "known", ("red", None): "unknown", ("new", None): "unknown", ("watch", "guard"): "new_meaning_of_known_word"}


def test_null_and_empty_are_one_identity(spark):
    events = log(spark, event("watch", "known", 1, sense=""))
    assert status(spark, events, ("watch", "NOUN", "e", None, "t")) == {("watch", None): "known"}


def test_history_keeps_events_without_a_book_in_order(spark):
    events = log(spark, event("a", "known", 9), event("a", "learning", 1, book=("B", "A", 1)), event("b", "known", 2))
    got = profile.history(events, spark.createDataFrame([("a", "NOUN", "e", None, "t")], SENSES)).collect()
    assert [r["state"] for r in got] == ["learning", "known"]


@pytest.mark.parametrize("bad", [{"state": "lost"}, {"origin": "x"}, {"book_title": "B"}, {"timestamp": None}])
def test_bad_events_are_refused(spark, bad):
    rows = log(spark, event("a", "known", 1))
    for k, v in bad.items():
        rows = rows.withColumn(k, F.lit(v).cast(rows.schema[k].dataType))
    with pytest.raises(Exception, match="state|origin|an event needs"):
        profile.checked_events(rows).collect()


def test_profile_tables_are_idempotent_and_versioned(spark, tmp_path, dictionary):
    own = profile.Profile(spark, str(tmp_path / "p"))
    words = spark.createDataFrame([("row", 1), ("pack in", 2)], "lemma string, rank int")
    assert preset.write_preset(own, words, dictionary, None, T0) is None and own.read("event") is None
    counts = preset.write_preset(own, words, dictionary, "a1", T0).first()
    assert counts["senses"] == 5 == own.events().count() and own.cefr_level() == "a1"
    for _ in range(2):
        own.ensure_books(spark.createDataFrame([("B", "A")], "book_title string, book_author string"))
        own.ensure_chapters(spark.createDataFrame([("B", "A", 1)], "book_title string, book_author string, chapter int"))
    assert own.read("book").count() == own.read("chapter").count() == 1
    own.record_events(log(spark, event("a", "known", 1, book=("B", "A", 1))).drop("event_id"))
    with pytest.raises(ValueError, match="chapter"):
        own.record_events(log(spark, event("a", "known", 1, book=("B", "A", 2))).drop("event_id"))
    assert profile.Profile(spark, str(tmp_path / "p")).events().count() == 6
    with pytest.raises(ValueError, match="c2"):
        own.set_cefr_level("c2")
    spark.createDataFrame([(1,)], "version int").write.mode("overwrite").parquet(str(tmp_path / "p/schema_version"))
    with pytest.raises(ValueError, match="version 1"):
        profile.Profile(spark, str(tmp_path / "p"))
    (tmp_path / "q").mkdir()
    (tmp_path / "q/file").write_text("x")
    with pytest.raises(ValueError, match="no profile"):
        profile.Profile(spark, str(tmp_path / "q"))


def test_stream_is_right_under_late_and_repeated_events(spark, tmp_path):
    first, late = [("a", "known", T0, 2), ("b", "learning", T0, 3)], [("a", "learning", T0 - dt.timedelta(hours=1), 1), ("b", "learning", T0, 3)]
    schema, own, folder = "lemma string, state string, timestamp timestamp, event_id long", states.stream_session(spark), str(tmp_path / "out")
    for rows in (first, late):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        changes = states.stream_latest_states(own.readStream.schema(schema).parquet(str(tmp_path / "in")), ["lemma"])
        states.start(changes, states.append_changes(folder), str(tmp_path / "c")).awaitTermination()
    assert {r["lemma"]: r["state"] for r in states.current_states(spark, folder, ["lemma"]).collect()} == {"a": "known", "b": "learning"}


ENTRIES = "book_title string, book_author string, chapter int, lemma string, pos string, frequency long, all_known boolean, none_known boolean, chosen_status string"


def loop(rows, limit, order):
    out, kept, done = {}, 0, False
    turn = lambda r: (-r[5], r[3], r[4])
    for r in [r for r in rows if r[6]]:
        out[r[3]] = "known"
    rest = sorted((r for r in rows if not r[6]), key=lambda r: (not r[7], *turn(r)) if order == "new_words_first" else turn(r))
    for r in rest:
        done = done or kept >= limit
        out[r[3]] = "remaining" if done else "skipped" if r[8] is None else "resolved_known" if r[8] == "known" else "kept"
        kept += out[r[3]] == "kept"
    return out


@pytest.mark.parametrize("order", ["new_words_first", "frequency"])
def test_dispositions_equal_the_loop_and_add_up(spark, order):
    r = random.Random(order)
    rows = [("B", "A", c, f"w{c}.{i}", "NOUN", r.randint(1, 5), r.random() < 0.2, r.random() < 0.5, r.choice(["known", "unknown", None])) for c in range(30) for i in range(20)]
    got = {x["lemma"]: x["disposition"] for x in triage.dispositions(spark.createDataFrame(rows, ENTRIES), 4, order).collect()}
    want = {}
    for c in range(30):
        want |= loop([x for x in rows if x[2] == c], 4, order)
    assert got == want
    with pytest.raises(ValueError, match="limit"):
        triage.dispositions(spark.createDataFrame(rows, ENTRIES), 0)
    with pytest.raises(ValueError, match="order"):
        triage.dispositions(spark.createDataFrame(rows, ENTRIES), 1, "x")


def test_blocks_ask_no_row_in_vain(spark):
    rows = [("B", "A", 1, f"w{i:02}", "NOUN", 50 - i, i == 0, True, None) for i in range(12)]
    entries, asked = spark.createDataFrame(rows, ENTRIES), []

    def choose(part):
        asked.append(part.count())
        return part.withColumn("chosen_status", F.when(F.substring("lemma", 3, 1).cast("int") % 2 == 0, "unknown"))

    blocks = [sorted((r["lemma"], r["disposition"]) for r in b.collect()) for b in triage.blocks(entries, 3, choose)]
    assert sum(asked) == 11 and [sum(d == "kept" for _, d in b) for b in blocks] == [3, 2]


def test_order_bulk_marks_and_limit(spark):
    rows = [("B", "A", 1, w, p, n) for w, p, n in (("b", "N", 2), ("a", "V", 2), ("a", "N", 2), ("z", "N", 9))]
    own = spark.createDataFrame(rows, "book_title string, book_author string, chapter int, lemma string, pos string, frequency long")
    assert [(r["lemma"], r["pos"]) for r in triage.ranked(own).orderBy("rank").collect()] == [("z", "N"), ("a", "N"), ("a", "V"), ("b", "N")]
    chosen = own.filter("lemma = 'a' and pos = 'N'").select("book_title", "book_author", "chapter", "lemma", "pos")
    assert {r["lemma"] for r in triage.bulk_mark(own, chosen).collect()} == {"z", "a"} and triage.bulk_mark(own, chosen).count() == 2
    assert triage.beyond_word_limit(own, 3).first()["lemma"] == "b" and triage.beyond_word_limit(own, 0).count() == 4
    with pytest.raises(ValueError, match="list"):
        triage.ensure_members(own, chosen.withColumn("lemma", F.lit("q")))


def test_each_broken_rule_is_named(spark):
    good = log(spark, event("a", "known", 1, book=("B", "A", 1)))
    chapters = spark.createDataFrame([("B", "A", 1)], "book_title string, book_author string, chapter int")
    cases = [({}, None), ({"state": "lost"}, "state"), ({"state": None}, "state"), ({"origin": "x"}, "origin"), ({"timestamp": None}, "time"), ({"chapter": None}, "place"), ({"book_title": None}, "place"), ({"chapter": 2}, "chapter"), ({"state": "x", "chapter": 2}, "state")]
    for change, fault in cases:
        rows = good
        for k, v in change.items():
            rows = rows.withColumn(k, F.lit(v).cast(rows.schema[k].dataType))
        assert [r["fault"] for r in profile.event_faults(rows, chapters).collect()] == [fault]
        assert fault == "chapter" or [r["fault"] for r in profile.event_faults(rows).collect()] == [fault]
    assert profile.event_faults(good.limit(0), chapters).count() == 0


def test_cards_of_dealt_chapters_stay_where_they_are_and_known_ones_are_not_written_again(spark, tmp_path):
    from glossmill.operators import cards
    from glossmill.sources.staging import dealt

    columns = "book_title string, book_author string, chapter int, lemma string, pos string, lexentry string, sense string, card_direction string"
    rows = [("B", "A", 1, w, "NOUN", "e", s, "en_de") for w in "abc" for s in (None, "", "x")] + [("B", "A", 2, "a", "NOUN", "e", None, "en_de"), (None, "A", 1, "a", "NOUN", "e", None, "en_de"), ("", "A", 1, "a", "NOUN", "e", None, "en_de")]
    deck = spark.createDataFrame(rows, columns).withColumn("guid", cards.guid())
    own = profile.Profile(spark, str(tmp_path / "p"))
    own.record_cards(deck.limit(4))
    own.record_cards(dealt(deck))
    stored = [r["guid"] for r in own.read("card").collect()]
    assert sorted(stored) == sorted({r["guid"] for r in deck.collect()}) and len(stored) == 8
    files = {p.name for p in (tmp_path / "p/card").glob("part-*") if "zstd" in p.name}
    own.record_cards(dealt(deck).filter("book_title = 'B'"))
    assert own.read("card").count() == 8 and spark.read.parquet(*(str(p) for p in (tmp_path / "p/card").glob("part-*") if p.name in files)).count() == 8
    # Nothing but texts, chapters' digests and guids of cards without a book is moved.
    plan = profile.fresh_cards(dealt(deck), [*profile.CHAPTER, "guid"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_blocks_read_slices_and_leave_chapters_that_are_through(spark, monkeypatch):
    rows = [("B", "A", c, f"w{i:02}", "NOUN", 50 - i, False, True, None) for c in range(9) for i in range(20 if c == 8 else 1)]
    sizes, plans = [], []

    def staged(df, label):
        out = kept(df, label)
        sizes.append((label, out.count()))
        return out

    def choose(part):
        plans.append(part._jdf.queryExecution().executedPlan().toString())
        return part.withColumn("chosen_status", F.lit("unknown"))

    kept = triage.staged
    monkeypatch.setattr(triage, "staged", staged)
    got = [b.count() for b in triage.blocks(spark.createDataFrame(rows, ENTRIES), 5, choose)]
    assert got == [13, 5, 5, 5]
    frontiers = [n for label, n in sizes if label == "frontier"]
    assert frontiers[0] == 9 and max(frontiers[1:]) == 1 and len(plans) == 4
    assert all("GreaterThan(_turn" in p and "LessThanOrEqual(_turn" in p for p in plans)
