"""Queries over the event log in time, in batches and as streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import timeline
from glossmill.plans import standins as S
from glossmill.plans.registry import ORACLE_SQL, query
from glossmill.sources.staging import shared_folder, staged
from glossmill.streaming import states, windows

#: A learner's pause that ends a session.
GAP = "6 hours"
_GAP_SQL = "INTERVAL 6 HOURS"

_SPANS = f"""WITH {S.EVENTS_SQL}, spans AS (SELECT user_id, lexentry, state, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, lexentry ORDER BY ts, event_id) AS valid_to FROM log)"""
_SESSIONS = f"""stepped AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= {_GAP_SQL} THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM stepped),
    sessions AS (SELECT user_id, min(ts) AS starts, max(ts) AS ends, count(*) AS n, count(*) FILTER (WHERE state = 'known') AS known FROM numbered GROUP BY user_id, session)"""


def _counts() -> dict:
    return {"known": F.col("state") == "known"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(spark, sf_dir).select("event_id", "user_id", "lemma", "lexentry", "state", "timestamp")


@query(
    f"""WITH {S.EVENTS_SQL}, reads AS (SELECT * FROM log WHERE state = 'deferred'), decisions AS (SELECT * FROM log WHERE state <> 'deferred')
    SELECT r.event_id, r.user_id, r.lemma, r.ts AS "timestamp", d.state AS last_state, d.lexentry AS last_lexentry, d.ts AS last_timestamp
    FROM reads r ASOF LEFT JOIN decisions d ON r.user_id = d.user_id AND r.lemma = d.lemma AND r.ts >= d.ts"""
)
def as_of_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a learner had decided last of any sense of a lemma, at each time one is put off."""
    events = _events(spark, sf_dir)
    reads = events.filter("state = 'deferred'").select("event_id", "user_id", "lemma", "timestamp")
    return timeline.as_of(reads, events.filter("state <> 'deferred'"), ["user_id", "lemma"], "timestamp", ["state", "lexentry"], tie=["event_id"])


@query(f"{_SPANS} SELECT user_id, lexentry, state, event_id, valid_from, valid_to FROM spans")
def knowledge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when to when each state of a sense holds."""
    return timeline.spans(_events(spark, sf_dir), ["user_id", "lexentry"], "timestamp", ["event_id"]).select("user_id", "lexentry", "state", "event_id", "valid_from", "valid_to")


@query(f"WITH {S.EVENTS_SQL}, {_SESSIONS} SELECT user_id, starts, ends, n, known FROM sessions")
def study_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sessions(_events(spark, sf_dir), ["user_id"], "timestamp", GAP, _counts())


@query(
    f"""{_SPANS}, {_SESSIONS} SELECT s.user_id, lexentry, valid_from, starts, greatest(valid_from, starts) AS overlap_from, least(coalesce(valid_to, until), until) AS overlap_to
    FROM (SELECT *, ends + {_GAP_SQL} AS until FROM sessions) t JOIN spans s ON s.user_id = t.user_id AND valid_from < until AND starts < coalesce(valid_to, TIMESTAMP '9999-01-01') AND (valid_to IS NULL OR valid_from < valid_to)
    WHERE state = 'known'"""
)
def known_in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sense that is known during some of a study session, the pause that ends it included."""
    events = _events(spark, sf_dir)
    known = knowledge_spans(spark, sf_dir).filter("state = 'known'").select("user_id", "lexentry", "valid_from", "valid_to")
    study = timeline.sessions(events, ["user_id"], "timestamp", GAP).select("user_id", "starts", (F.col("ends") + F.expr(f"INTERVAL {GAP}")).alias("until"))
    pairs = timeline.overlaps(staged(known, "spans"), staged(study, "sessions"), ["user_id"], ("valid_from", "valid_to"), ("starts", "until"))
    return pairs.select("user_id", "lexentry", "valid_from", "starts", "overlap_from", "overlap_to")


@query(
    f"""WITH {S.EVENTS_SQL}, days AS (SELECT user_id, state, unnest(range(7)) AS back, date_trunc('day', ts) AS day FROM log)
    SELECT user_id, day - to_days(back::int) AS window_start, day - to_days(back::int) + INTERVAL 7 DAYS AS window_end, count(*) AS n, count(*) FILTER (WHERE state = 'known') AS known FROM days GROUP BY ALL"""
)
def sliding_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of each learner and week, a week from each day on."""
    return timeline.sliding_counts(_events(spark, sf_dir), ["user_id"], "timestamp", "7 days", "1 day", _counts())


def _stream(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, DataFrame, str]:
    """A session for streams, the event log read as one, and a folder for what comes of it."""
    own = states.stream_session(spark)
    events = S.events_of(S.stream_table(own, sf_dir, "events")).select("event_id", "user_id", "lemma", "lexentry", "state", F.col("timestamp").cast("timestamp").alias("timestamp"))
    return own, events, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(f"WITH {S.EVENTS_SQL} SELECT user_id, lexentry, arg_max(state, (ts, event_id)) AS state, max(ts) AS \"timestamp\" FROM log GROUP BY ALL")
def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest states, from a stream with keyed state."""
    own, events, folder = _stream(spark, sf_dir)
    states.start(_zoneless(states.stream_latest_states(events, ["user_id", "lexentry"])), states.append_changes(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    return states.current_states(spark, f"{folder}/out", ["user_id", "lexentry"]).select("user_id", "lexentry", "state", "timestamp")


def _zoneless(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"})


def _ended(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    own, events, folder = _stream(spark, sf_dir)
    rows = _zoneless(make(events))
    states.start(rows, states.append_changes(f"{folder}/out"), f"{folder}/checkpoint", "append").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*rows.columns)


@query(f"WITH {S.EVENTS_SQL}, {_SESSIONS} SELECT user_id, starts, ends, n, known FROM sessions WHERE ends + {_GAP_SQL} <= (SELECT date_trunc('milliseconds', max(ts)) FROM log)")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that a stream has closed: those that ended before the last event of the log, less their pause."""
    return _ended(spark, sf_dir, lambda events: windows.stream_sessions(events, ["user_id"], "timestamp", GAP, "0 seconds", _counts()))


@query(f"SELECT * FROM ({ORACLE_SQL['sliding_weeks']}) WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)")
def streamed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding weeks that a stream has closed."""
    return _ended(spark, sf_dir, lambda events: windows.stream_sliding_counts(events, ["user_id"], "timestamp", "7 days", "1 day", "0 seconds", _counts()))
