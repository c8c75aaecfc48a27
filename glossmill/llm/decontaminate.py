"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by up to k = RATE * m edits. It is split into k + 1
pieces, of which one at least must stand unchanged in any such passage. Pieces are found exactly (one
automaton for all items of a block). From a hit, growing runs of pieces are verified with Myers'
bit-parallel distance: by the same pigeonhole some hit has, at every run of j pieces of a binary tree
above it, at most j - 1 edits, so that chance hits end at the first small run and no passage is lost.

Items come in blocks of BLOCK_CHARS characters, so that what a worker holds is bounded for any benchmark.

Defined results: texts are compared in lower case with runs of white space as one space; null or empty
texts and items match nothing; items with equal texts are all reported; repeated documents give repeated
rows; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, texts_of

RATE = 0.1
BLOCK_CHARS = 2_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def cuts(length: int, pieces: int) -> list[int]:
    return [length * j // pieces for j in range(pieces + 1)]


def best_end(pattern_masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """Myers (1999), approximate search: the smallest distance up to budget of the pattern to any substring, and where that ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = pattern_masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def masks_of(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Item:
    """The text of an item, and the runs of pieces above each piece up to the whole."""

    def __init__(self, text: str, rate: float):
        self.text, self.m = text, len(text)
        self.budget = min(int(self.m * rate), self.m - 1)
        self.at = cuts(self.m, self.budget + 1)
        self.masks: dict[tuple[int, int], dict[str, int]] = {}
        self.above: list[list[tuple[int, int]]] = [[] for _ in range(self.budget + 1)]
        runs = [(0, self.budget + 1)] if self.budget else []
        while runs:
            a, b = runs.pop()
            for leaf in range(a, b):
                self.above[leaf].insert(0, (a, b))
            runs += [x for x in ((a, (a + b) // 2), ((a + b) // 2, b)) if x[1] - x[0] > 1]

    def verify(self, leaf: int, start: int, text: str) -> tuple[int, int] | None:
        """Distance and end of the best passage around a piece that stands at start."""
        hit = (0, start + self.at[leaf + 1] - self.at[leaf])
        for a, b in self.above[leaf]:
            budget = b - a - 1
            low, high = self.at[a], self.at[b]
            begin = start - (self.at[leaf] - low) - budget
            end = start + high - self.at[leaf] + budget
            if (a, b) not in self.masks:
                self.masks[a, b] = masks_of(self.text[low:high])
            begin = max(0, begin)
            hit = best_end(self.masks[a, b], high - low, text[begin:end], budget)
            if hit is None:
                return None
            hit = (hit[0], hit[1] + begin)
        return hit


class Matcher:
    def __init__(self, items: tuple[tuple[int | None, str], ...], rate: float = RATE):
        by_text: dict[str, list[int | None]] = {}
        for item_id, text in items:
            if text and (text := plain(text)):
                by_text.setdefault(text, []).append(item_id)
        self.items = [Item(x, rate) for x in sorted(by_text)]
        self.ids = [by_text[x.text] for x in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for leaf, (low, high) in enumerate(zip(item.at, item.at[1:], strict=False)):
                found.setdefault(item.text[low:high], []).append((n, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def match(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end) of each item that the text has, at its best place."""
        if self.empty or not (text := plain(text)):
            return []
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(text):
            for n, leaf in where:
                start, item = end + 1 - size, self.items[n]
                place = (n, start - item.at[leaf])
                if place in seen:  # a passage around this place is found already
                    continue
                hit = item.verify(leaf, start, text)
                if hit:
                    seen.add(place)
                    if n not in best or hit < best[n]:
                        best[n] = hit
        return [(i, *best[n]) for n in sorted(best) for i in self.ids[n]]


@lru_cache(maxsize=1)
def matcher(items: tuple[tuple[int | None, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def item_blocks(items: DataFrame, chars: int = BLOCK_CHARS):
    """The benchmark in parts of about so many characters."""
    items = items.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // chars)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield tuple(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[1], x[0] is None, x[0] or 0)))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance and match_end (in the plain text) for each document and each item that it contains."""
    bounded_batches(spark)
    schema = "doc_id long, item_id long, distance int, match_end long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Batches, shared=shared) -> Batches:
            own = matcher(shared.value, rate)
            for batch in batches:
                rows = [(d, *hit) for d, x in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True) for hit in own.match(x)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "distance", "match_end"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that contain no item, with their columns; blocks of items follow one another without a shuffle."""
    bounded_batches(spark)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Batches, shared=shared) -> Batches:
            own = matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not own.match(x) for x in texts_of(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
