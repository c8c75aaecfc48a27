"""Sessions and sliding windows over a stream: bounded state, and late rows dropped by a watermark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.timeline import micros


def stream_sessions(events: DataFrame, by: Sequence[str], on: str, gap: str, late: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """The sessions of timeline.sessions, each once the watermark, late behind the newest event, has passed its end."""
    counts = counts or {}
    whole = events.withWatermark(on, late).groupBy(*by, F.session_window(on, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    return whole.select(*by, F.col("_w.start").alias("starts"), F.timestamp_micros(F.unix_micros("_w.end") - F.lit(micros(gap))).alias("ends"), "n", *counts)


def stream_sliding_counts(events: DataFrame, by: Sequence[str], on: str, window: str, slide: str, late: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows of timeline.sliding_counts, each once the watermark has passed its window; until then it is state."""
    counts = counts or {}
    whole = events.withWatermark(on, late).groupBy(*by, F.window(on, window, slide).alias("_w")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    return whole.select(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", *counts)
