"""Removal of repeated byte strings, by external induced suffix sorting.

A string of LENGTH bytes is repeated if it also starts anywhere else, in its own text or another. Every
such window is filed under its anchor: the smallest hash of GRAM bytes in it, the leftmost of equal ones.
Equal windows have equal anchors, so that windows of different anchors need never meet, and an anchor that
occurs once rules all its windows out. What remains are runs of windows around anchors that occur again;
they are dealt into shards by anchor, and each shard is a suffix-sorting task of its own (see induced.py):
a window is repeated if its suffix shares LENGTH bytes with a neighbour in suffix order. Runs of windows
that are equal as a whole are sent to the sorter once, with a note that they are repeated.

Defined results: null text counts as empty; texts shorter than LENGTH keep everything; repeated rows repeat
each other's text; windows never cross texts; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, materialize, plan_bytes, utf8_buffers
from glossmill.llm.induced import Sorter
from glossmill.llm.words import _BASE, _INVERSE, _OF_BYTE, _powers, mix

LENGTH, GRAM = 200, 48
#: Bytes of text in a block of documents, of anchors in a range of hashes, and of runs of windows in a shard.
BLOCK_BYTES, RANGE_BYTES, SHARD_BYTES = 2 << 20, 12 << 20, 6 << 20
#: Tuples that a sorter keeps in memory; beyond, they are on disk.
LIMIT = 1 << 22
#: Bytes of text that anchors are looked for at a time.
SEGMENT = 1 << 20

BLOCKS = "block long, doc_ids array<long>, offsets binary, data binary"


def _rolled(data: np.ndarray) -> np.ndarray:
    """Hashes of GRAM bytes from each place on."""
    n = len(data)
    if len(_rolled.up) <= n:
        _rolled.up, _rolled.down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_OF_BYTE[data] * _rolled.up[:n], out=total[1:])
    return mix((total[GRAM:] - total[:-GRAM]) * _rolled.down[: n - GRAM + 1])


_rolled.up, _rolled.down = _powers(_BASE, 1), _powers(_INVERSE, 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the first window's start, the number of windows, and the anchor's hash."""
    lows, counts, hashes = [], [], []
    span = length - GRAM + 1
    start_bits = np.uint64(22)
    valid_ends = offsets[1:] - length  # the last window of each text
    for low in range(0, max(0, len(data) - length + 1), SEGMENT):
        high = min(len(data), low + SEGMENT + length - 1)
        own = _rolled(data[low:high])
        packed = (own >> start_bits << start_bits) | np.arange(len(own), dtype=np.uint64)
        size, width = len(own) - span + 1, 1
        if size <= 0:
            continue
        while width * 2 <= span:
            packed = np.minimum(packed[:-width], packed[width:])
            width *= 2
        if width < span:
            packed = np.minimum(packed[: len(packed) - (span - width)], packed[span - width :])
        at = (packed[:size] & np.uint64((1 << 22) - 1)).astype(np.int64)
        places = np.arange(low, low + size)
        text = np.searchsorted(offsets, places, "right") - 1
        fits = places <= valid_ends[np.minimum(text, len(valid_ends) - 1)]
        begin = np.flatnonzero(fits & np.append(True, (at[1:] != at[:-1]) | ~fits[:-1] | (text[1:] != text[:-1])))
        end = np.flatnonzero(fits & np.append((at[1:] != at[:-1]) | ~fits[1:] | (text[1:] != text[:-1]), True))
        lows.append(begin + low)
        counts.append(end - begin + 1)
        hashes.append(own[at[begin]])
    if not lows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(lows), np.concatenate(counts), np.concatenate(hashes)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _text_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(_unpack(row["data"]), np.uint8), np.frombuffer(row["offsets"], "<i8")


def _blocks(block_bytes: int):
    """Documents in blocks of so many bytes."""
    rows = max(1, min(100, block_bytes // 20_000))  # at a time, so that counting bytes costs little

    def row(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        docs = pa.Table.from_batches(held)
        data, offsets = utf8_buffers(docs["text"].combine_chunks())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([docs["doc_id"].to_pylist()], pa.list_(pa.int64())), pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([_pack(data.tobytes())], pa.binary())],
            ["block", "doc_ids", "offsets", "data"],
        )

    def run(batches: Batches) -> Batches:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows)
                at += part.num_rows
                held.append(part)
                size += part.column("text").nbytes
                if size >= block_bytes:
                    yield row(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield row(held, number)

    return run


def _shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _seen(parts: int, length: int):
    """Distinct anchors of a block, in ranges of their hash."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                known, often = np.unique(anchors(*_text_of(r), length)[2], return_counts=True)
                part = _shard_of(known, parts)  # rising, as known is; only ranges that the block has are gone through
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                rows = [(r["block"], int(part[a]), known[a:b].tobytes(), np.minimum(often[a:b], 2).astype(np.uint8).tobytes()) for a, b in zip(begin, np.append(begin, len(part))[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "hashes", "often"])

    return run


def _again(group: pa.Table) -> pa.Table:
    """Which anchors of a range occur more than once, given back to each block."""
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in group["hashes"]]
    often = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group["often"]])
    known, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    again = (np.bincount(inverse, often, minlength=len(known)) > 1)[inverse]
    cuts = np.cumsum([0, *map(len, hashes)])
    flags = [again[a:b].astype(np.uint8) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": group["block"], "part": group["part"], "flags": pa.array([x.tobytes() for x in flags], pa.binary()), "n": pa.array([int(x.sum()) for x in flags], pa.int64())})


def _runs(shards: int, length: int):
    """Runs of windows whose anchor occurs again, by shard; equal runs of a block are one."""

    def run(blocks: pa.Table, flags: pa.Table) -> pa.Table:
        rows = []
        flagged = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_py(), np.uint8) for x in flags.sort_by("part")["flags"])]).astype(bool)
        for r in blocks.to_pylist():
            data, offsets = _text_of(r)
            lows, counts, hashes = anchors(data, offsets, length)
            known, inverse = np.unique(hashes, return_inverse=True)
            keep = flagged[inverse] if len(known) else np.zeros(0, bool)
            lows, counts, hashes = lows[keep], counts[keep], hashes[keep]
            shard = _shard_of(mix(hashes), shards)
            order = np.argsort(shard, kind="stable")
            whole = data.tobytes()
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                which: dict[bytes, int] = {}
                of = [which.setdefault(whole[a : a + n + length - 1], len(which)) for a, n in zip(lows[own].tolist(), counts[own].tolist(), strict=True)]
                rows.append((int(shard[own[0]]), r["block"], lows[own].astype("<i8").tobytes(), np.array(of, "<i4").tobytes(), np.array([len(x) for x in which], "<i4").tobytes(), _pack(b"".join(which))))
        kinds = (pa.int32(), pa.int64(), *(pa.binary(),) * 4)
        return pa.table({k: pa.array([x[i] for x in rows], kind) for i, (k, kind) in enumerate(zip(("shard", "block", "lows", "which", "sizes", "runs"), kinds, strict=True))})

    return run


def repeated_windows(runs: list[bytes], length: int, folder: str, limit: int = LIMIT) -> np.ndarray:
    """Whether the window at each byte of the runs, one after another, also starts elsewhere in them."""
    sizes = np.array([len(x) for x in runs], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    total = int(starts[-1])
    # Runs end with symbol 1, the text with 0, and bytes start at 2. The text of a large shard is a file.
    n = total + len(runs) + 1
    text = np.memmap(tempfile.TemporaryFile(dir=folder), "<u2", "w+", shape=(n,)) if n > 8 * limit else np.empty(n, "<u2")
    at = 0
    for x in runs:
        text[at : at + len(x)] = np.frombuffer(x, np.uint8)
        text[at : at + len(x)] += 2
        text[at + len(x)] = 1
        at += len(x) + 1
    text[at] = 0
    found = np.zeros(n, bool)
    last = np.zeros(1, np.int64)
    for places, shared in Sorter(text, 258, folder, limit, length).neighbours():
        full = shared >= length
        found[places[full]] = True
        found[np.append(last, places[:-1])[full]] = True
        last = places[-1:]
    left = np.repeat(starts[1:], sizes) - np.arange(total)  # matches that go on into the next run are of no window
    return found[np.arange(total) + np.repeat(np.arange(len(runs)), sizes)] & (left >= length)


def _sorted(length: int, limit: int):
    """The bytes of each block that repeated windows of a shard cover, as ranges."""

    def run(group: pa.Table) -> pa.Table:
        which: dict[bytes, int] = {}
        often: list[int] = []
        rows = []
        for r in zip(*(group[k].to_pylist() for k in ("block", "lows", "which", "sizes", "runs")), strict=True):
            block, lows, of, sizes, packed = r
            data, at, own = _unpack(packed), 0, []
            of = np.frombuffer(of, "<i4")
            for size, n in zip(np.frombuffer(sizes, "<i4").tolist(), np.bincount(of).tolist(), strict=True):
                k = which.setdefault(data[at : at + size], len(which))
                if k == len(often):
                    often.append(0)
                often[k] += n
                own.append(k)
                at += size
            rows.append((block, np.frombuffer(lows, "<i8"), np.array(own)[of]))
        runs = list(which)
        with tempfile.TemporaryDirectory() as folder:
            found = repeated_windows(runs, length, folder, limit)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in runs])))
        # Stretches of repeated windows of each run, as bytes from its start.
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        for k, x in enumerate(runs):
            windows = len(x) - length + 1
            if often[k] > 1:
                spans.append((np.zeros(1, np.int64), np.array([len(x)])))
                continue
            edge = np.diff(np.concatenate(([0], found[starts[k] : starts[k] + windows].astype(np.int8), [0])))
            spans.append((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length))
        blocks, ranges = [], []
        for block, lows, own in rows:
            begin = [spans[k][0] + low for k, low in zip(own.tolist(), lows.tolist(), strict=True)]
            end = [spans[k][1] + low for k, low in zip(own.tolist(), lows.tolist(), strict=True)]
            both = np.stack([np.concatenate(begin), np.concatenate(end)], 1)
            if len(both):
                blocks.append(block)
                ranges.append(both.astype("<i8").tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "ranges": pa.array(ranges, pa.binary())})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(blocks: pa.Table, covered: pa.Table) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    for r in blocks.to_pylist():
        data, offsets = _text_of(r)
        edge = np.zeros(len(data) + 1, np.int32)
        for x in covered["ranges"]:
            both = np.frombuffer(x.as_py(), "<i8").reshape(-1, 2)
            np.add.at(edge, both[:, 0], 1)
            np.add.at(edge, both[:, 1], -1)
        gone = np.cumsum(edge[:-1]) > 0
        for doc_id, a, b in zip(r["doc_ids"], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = gone[a:b]
            spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(b > a and own[0])
            kept = data[a:b][~own] if spans else data[a:b]
            for column, x in zip(out, (doc_id, b - a, int(own.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                column.append(x)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table({k: pa.array(x, kind) for k, x, kind in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), out, kinds, strict=True)})


def covered_ranges(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, shard_bytes: int = SHARD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents, and (block, ranges): pairs of start and end in a block's bytes that repeated windows cover."""
    if not GRAM < length < 255:
        raise ValueError(f"windows have {GRAM + 1} to 254 bytes")
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = materialize(spark, source.mapInArrow(_blocks(block_bytes), BLOCKS), "substring-blocks")
    size = plan_bytes(blocks)
    parts = max(8, -(-size // (2 * range_bytes)))  # a block has a row a range that it has anchors of, so never more rows than anchors
    seen = blocks.mapInArrow(_seen(parts, length), "block long, part int, hashes binary, often binary")
    flags = materialize(spark, seen.groupBy("part").applyInArrow(_again, "block long, part int, flags binary, n long"), "substring-anchors")
    shards = max(8, -(-(flags.agg(F.sum("n")).first()[0] or 0) * (length + 80) // shard_bytes))
    schema = "shard int, block long, lows binary, which binary, sizes binary, runs binary"
    runs = blocks.groupBy("block").cogroup(flags.select("block", "part", "flags").groupBy("block")).applyInArrow(_runs(shards, length), schema)
    ranges = runs.groupBy("shard").applyInArrow(_sorted(length, limit), "block long, ranges binary")
    return blocks, materialize(spark, ranges, "substring-ranges")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, limit: int = LIMIT, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text); sizes: bytes of blocks, ranges and shards."""
    blocks, ranges = covered_ranges(spark, docs, length, limit, **sizes)
    return blocks.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(_removed, RESULT)
