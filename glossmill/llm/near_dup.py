"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of five words. Sets are embedded into sketches of COORDINATES tokens
(8-bit minima of hash functions), of which two sets share a part equal to their similarity. In each run
sets go down a tree: at each node two sampled coordinates are chosen, and sets that share the token there
go on together. A node of up to SPLIT sets is a leaf, and so is one that kept more than SHRINK of the sets of the
node counted above it, which are alike, and one at DEPTH; all others are split further, so that the depth follows
the data. Nodes are counted at the first level and from level COUNTED on: one level alone parts few sets.
The sets of a leaf are a bucket. Buckets above SIDE sets, however large, are compared block against block, so
that no pair of a bucket parts. In a bucket pairs are first estimated by sketches, then verified on the whole
sets, and a link counts only in the first bucket that its two sets share, so that no table of pairs is needed.
Runs repeat until a pair at the threshold is found with probability RECALL at DEPTH; it is found likelier above.

Defined results: null text counts as empty; texts without a word have one class and no link; a text of
one to four words is one shingle; equal sets are one class member each with the links of their set;
doc_id null is after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, fresh_names, join_sized, materialize, row_ids, utf8_buffers
from glossmill.llm.words import WordHasher, mix, shingles

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99998
COORDINATES, DEPTH = 128, 4
#: Sets above which a bucket is compared in blocks of so many, block against block.
SIDE = 2048
#: Nodes up to so many sets are leaves, and so are nodes with more than this share of the sets of the node counted above.
SPLIT, SHRINK = 128, 0.75
#: The level after the first at which nodes are counted next.
COUNTED = 3
#: Runs of which the inner nodes above DEPTH fit the bits of a long, level by level.
MOST_RUNS = 62 >> (DEPTH - 1)
#: Standard deviations of a sketch's estimate that a pair at the threshold may lie under it.
SLACK = 5.0
#: Up to so many sets of a bucket have their pairs listed; more are compared as matrices.
LISTED = 48


@dataclass(frozen=True)
class Tuning:
    """What decides how deep sets go and how buckets are compared, and nothing of what is found; it goes to the workers with the functions."""

    listed: int = LISTED
    split: int = SPLIT
    shrink: float = SHRINK
    side: int = SIDE


def found_at(similarity: float, depth: int = DEPTH) -> float:
    """The probability that two sets share a leaf of one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** 2
    return p


def cutoff_for(similarity: float) -> int:
    """Equal tokens of two sketches under which a pair is not verified."""
    return max(1, math.floor(COORDINATES * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / COORDINATES))))


def recall_of(similarity: float, runs: int, cutoff: int) -> float:
    """The probability that a pair shares a leaf of any run and passes the cut-off; all choices are among the same coordinates."""
    shares = ((k, math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k)) for k in range(cutoff, COORDINATES + 1))
    return sum(p * (1 - (1 - found_at(k / COORDINATES)) ** runs) for k, p in shares)


def runs_for(similarity: float, recall: float) -> int:
    cutoff = cutoff_for(similarity)
    for runs in range(1, MOST_RUNS + 1):
        if recall_of(similarity, runs, cutoff) >= recall:
            return runs
    raise ValueError(f"a recall of {recall} at a similarity of {similarity} takes more than {MOST_RUNS} runs")


_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 8-bit tokens for each set; an empty set has zeros."""
    out = np.zeros((len(sets), COORDINATES), np.uint8)
    full = [i for i, x in enumerate(sets) if len(x)]
    low = 0
    while low < len(full):  # some 100,000 shingles at a time
        high, n = low, 0
        while high < len(full) and (n == 0 or n + len(sets[full[high]]) <= 100_000):
            n += len(sets[full[high]])
            high += 1
        own = full[low:high]
        joined = np.concatenate([sets[i] for i in own])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in own])[:-1]))
        a, b = (joined >> np.uint64(32)).astype(np.uint32), joined.astype(np.uint32)
        for c in range(COORDINATES):
            s = int(_SEEDS[c])
            v = (a ^ np.uint32(s & 0xFFFFFFFF)) * np.uint32((s >> 32) | 1)
            v ^= v >> np.uint32(15)
            v = (v + b) * np.uint32((s >> 16) & 0xFFFFFFFF | 1)
            v ^= v >> np.uint32(13)
            v *= np.uint32(0x85EBCA6B)
            least = np.minimum.reduceat(v, starts)
            out[own, c] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        low = high
    return out


def path_levels(sketch: np.ndarray, runs: int, depth: int) -> list[np.ndarray]:
    """The node of each set in each slot (a run and its branches so far), level by level; slot k has the children 2k and 2k + 1."""
    level = [mix(np.full(len(sketch), run + 1, np.uint64) * np.uint64(0xA0761D6478BD642F)) for run in range(runs)]
    out = []
    for _ in range(depth):
        following = []
        for path in level:
            for branch in range(2):
                chosen = mix(path + np.uint64(branch + 1))
                token = np.take_along_axis(sketch, (chosen % np.uint64(COORDINATES)).astype(np.int64)[:, None], 1)[:, 0]
                following.append(mix(chosen ^ (token.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3)))
        level = following
        out.append(np.stack(level, 1))
    return out


def leaf_keys(sketch: np.ndarray, ends: np.ndarray, runs: int) -> np.ndarray:
    """The leaf of each set in each slot of the lowest level; a leaf further up stands in all slots under it.

    ends: for each level above the lowest, bits of the slots that are leaves there.
    """
    depth = ends.shape[1] + 1
    levels = path_levels(sketch, runs, depth)
    out = levels[-1]
    for d in range(1, depth):
        ended = (ends[:, d - 1, None] >> np.arange(levels[d - 1].shape[1]) & 1).astype(bool)
        width = 1 << (depth - d)
        out = np.where(np.repeat(ended, width, 1), np.repeat(levels[d - 1], width, 1), out)
    return out


def _binary_rows(array: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(-1, width)


def _sign(batches: Batches) -> Batches:
    hasher = WordHasher()
    for batch in batches:
        sets = shingles(*hasher.of(*utf8_buffers(batch.column("text"))), WORDS)
        rows = sketches(sets)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row_uid"), batch.column("doc_id"), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()),
            ],
            ["row_uid", "doc_id", "sig", "n", "sketch"],
        )


NODES = "key long, slot int, rid long, level int, parent long"


def _goes_on(size, parent, tuning: Tuning):
    """Whether a node that isn't at DEPTH is split; of arrays or of columns."""
    return (size > tuning.split) & (size <= tuning.shrink * parent)


def _nodes(keys: np.ndarray, slots: np.ndarray, rid: np.ndarray, level: int, parent: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(slots.astype(np.int32)), pa.array(rid), pa.array(np.full(len(keys), level, np.int32)), pa.array(parent.astype(np.int64))],
        ["key", "slot", "rid", "level", "parent"],
    )


def _first_level(runs: int):
    """Sets of each node of the first level: 256 nodes a slot, whatever the input."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                keys, often = np.unique(path_levels(_binary_rows(batch.column("sketch"), COORDINATES), runs, 1)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(often.astype(np.int64))], ["key", "size"])

    return run


def _counted_level(runs: int, keys: np.ndarray, sizes: np.ndarray, tuning: Tuning):
    """Leaves of the first level, and what is at level COUNTED under its other nodes; keys (rising) and sizes: all nodes of the first level."""
    total = int(sizes.sum()) // (2 * runs)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, *_, below = path_levels(_binary_rows(batch.column("sketch"), COORDINATES), runs, COUNTED)
            rid = batch.column("rid").to_numpy()
            size = sizes[np.searchsorted(keys, first)]
            further = _goes_on(size, total, tuning)
            row, slot = np.nonzero(~further & (size > 1))
            yield _nodes(first[row, slot], slot, rid[row], 1, np.full(len(row), total))
            under = 1 << (COUNTED - 1)
            row, slot = np.nonzero(np.repeat(further, under, 1))
            yield _nodes(below[row, slot], slot, rid[row], COUNTED, size[row, slot // under])

    return run


def _next_level(runs: int, level: int):
    """Children of the nodes of a level that are split."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            below = path_levels(_binary_rows(batch.column("sketch"), COORDINATES), runs, level + 1)[-1]
            row = np.repeat(np.arange(batch.num_rows), batch.column("slots").value_lengths().to_numpy())
            slot, size = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in ("slots", "sizes"))
            rid = batch.column("rid").to_numpy()[row]
            for branch in range(2):
                yield _nodes(below[row, 2 * slot + branch], 2 * slot + branch, rid, level + 1, size)

    return run


def _groups(batches: Batches) -> Iterator[pa.Table]:
    """Whole buckets, some thousand rows together; rows come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column("bucket").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut == 0 and (len(held) == 1 or held[0].column("bucket")[0].as_py() == keys[-1]):
            continue
        done = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        if cut == 0 and held[-2].column("bucket")[-1].as_py() == keys[-1]:  # the last bucket goes on from the batches before
            whole = done["bucket"].to_numpy()
            at = int(np.searchsorted(whole, keys[-1], "left"))
            held = [*done.slice(at).to_batches(), batch]
            done = done.slice(0, at)
        else:
            held = [batch.slice(cut)]
        if done.num_rows:
            yield done
    if held:
        yield pa.Table.from_batches(held)


def _runs_of(values: np.ndarray) -> np.ndarray:
    """Borders of runs of equal values."""
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


class Bucket:
    """Rows of buckets, and the pairs in them that may be links and meet here first."""

    def __init__(self, table: pa.Table, runs: int, cutoff: int, tuning: Tuning):
        table = table.combine_chunks()
        self.bucket = table["bucket"].to_numpy()
        self.rid = table["rid"].to_numpy()
        self.slot = table["slot"].to_numpy()
        self.side = table["side"].to_numpy()
        self.crossed = table["crossed"].to_numpy(zero_copy_only=False)
        self.sketch = _binary_rows(table["sketch"].combine_chunks(), COORDINATES)
        self.keys = leaf_keys(self.sketch, table["ends"].combine_chunks().flatten().to_numpy().reshape(len(self.rid), -1), runs)
        self.cutoff, self.listed = cutoff, tuning.listed
        self.borders = _runs_of(self.bucket)

    def small_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(self.borders)
        size = np.repeat(sizes, sizes)
        left, right = [], []
        for d in range(1, int(sizes[sizes <= self.listed].max(initial=1))):
            i = np.flatnonzero((self.bucket[:-d] == self.bucket[d:]) & (size[:-d] <= self.listed)) if d < len(self.bucket) else np.zeros(0, np.int64)
            if len(i):
                i = i[self.allowed(i, i + d)]
                left.append(i)
                right.append(i + d)
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for low in range(0, len(i), 50_000):
            a, b = i[low : low + 50_000], j[low : low + 50_000]
            same = self.keys[a] == self.keys[b]
            ok = (same.argmax(1) == self.slot[a]) & (~self.crossed[a] | (self.side[a] != self.side[b]))
            ok[ok] = (self.sketch[a[ok]] == self.sketch[b[ok]]).sum(1) >= self.cutoff
            out[low : low + 50_000] = ok
        return out

    def large(self) -> list[tuple[int, int]]:
        return [(int(a), int(b)) for a, b in zip(self.borders[:-1], self.borders[1:], strict=True) if b - a > self.listed]

    def large_pairs(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, mask) of parts of a large bucket: sets that met in slot 0 already aren't compared once more."""
        slot = int(self.slot[a])
        first = self.keys[a:b, 0] if slot else np.arange(b - a)
        order = np.argsort(first, kind="stable") + a
        if slot:
            cuts = _runs_of(first[order - a])
            cuts = np.unique(np.concatenate([cuts, *[np.arange(x, y, 128) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]]))
            ends = np.searchsorted(first[order - a], first[order - a][cuts[:-1]], "right")
        else:
            cuts = np.unique(np.append(np.arange(0, b - a, 128), b - a))
            ends = cuts[:-1]
        for x, y, end in zip(cuts[:-1], cuts[1:], ends, strict=True):
            rows, columns = order[x:y], order[end:]
            if not len(columns):
                continue
            met = np.zeros((len(rows), len(columns)), bool)
            for s in range(1, slot):
                met |= self.keys[rows, s][:, None] == self.keys[columns, s][None]
            if slot == 0:
                met = columns[None] <= rows[:, None]
            if self.crossed[a]:
                met |= self.side[rows][:, None] == self.side[columns][None]
            if met.all():
                continue
            agree = np.zeros(met.shape, np.uint8)
            for c in range(COORDINATES):
                agree += self.sketch[rows, c][:, None] == self.sketch[columns, c][None]
            yield rows, columns, (agree >= self.cutoff) & ~met


def _active(runs: int, cutoff: int, tuning: Tuning):
    """Rows that have a partner to verify in their bucket."""

    def run(batches: Batches) -> Batches:
        for table in _groups(batches):
            own = Bucket(table, runs, cutoff, tuning)
            keep = np.zeros(len(own.rid), bool)
            i, j = own.small_pairs()
            keep[i] = keep[j] = True
            for a, b in own.large():
                for rows, columns, mask in own.large_pairs(a, b):
                    keep[rows[mask.any(1)]] = True
                    keep[columns[mask.any(0)]] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _spanning(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict[int, int]:
    """The smallest node that each linked node reaches, by union-find."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(nodes[i].tolist(), nodes[j].tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return {x: top(x) for x in parent}


def _verify(runs: int, cutoff: int, similarity: float, tuning: Tuning):
    """Verified links of each bucket as counts and as a star for each connected part: rows (kind, a, b)."""

    def linked(na: np.ndarray, nb: np.ndarray, common: np.ndarray) -> np.ndarray:
        return common >= similarity * (na + nb - common) - 1e-9

    def run(batches: Batches) -> Batches:
        for table in _groups(batches):
            own = Bucket(table, runs, cutoff, tuning)
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            n = np.array([len(x) for x in sets])
            counts = np.zeros(len(sets), np.int64)
            stars: list[tuple[int, int]] = []
            i, j = own.small_pairs()
            ok = np.array([linked(n[x], n[y], len(np.intersect1d(sets[x], sets[y], assume_unique=True))) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            i, j = i[ok], j[ok]
            np.add.at(counts, i, 1)
            np.add.at(counts, j, 1)
            stars += _spanning(own.rid, i, j).items()
            for a, b in own.large():
                values, which, often = np.unique(np.concatenate(sets[a:b]), return_inverse=True, return_counts=True)
                shared = np.cumsum(often > 1) - 1  # a shingle of one set only is in no intersection
                of = np.repeat(np.arange(a, b), n[a:b])
                keep = often[which] > 1
                of, column = of[keep], shared[which[keep]]
                by_set = np.searchsorted(of, np.arange(a, b + 1))
                wide = int(shared[-1]) + 1 if len(shared) else 0
                label = np.arange(b - a)
                for rows, columns, mask in own.large_pairs(a, b):
                    if not mask.any():
                        continue
                    columns, mask = columns[mask.any(0)], mask[:, mask.any(0)]
                    common = np.zeros(mask.shape, np.float32)
                    left = _dense(rows - a, by_set, column, wide)
                    for low in range(0, len(columns), 256):
                        part = _dense(columns[low : low + 256] - a, by_set, column, wide)
                        for c in range(0, wide, 8192):
                            common[:, low : low + 256] += left[:, c : c + 8192].astype(np.float32) @ part[:, c : c + 8192].astype(np.float32).T
                    mask &= linked(n[rows][:, None], n[columns][None], common)
                    counts[rows] += mask.sum(1)
                    counts[columns] += mask.sum(0)
                    label = _merge(label, rows - a, columns - a, mask)
                stars += [(x, y) for x, y in _smallest(own.rid[a:b], label) if x != y]
            linked_ = np.flatnonzero(counts)
            stars = [(x, y) for x, y in stars if x != y]
            kind = [0] * len(linked_) + [1] * len(stars)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array([*own.rid[linked_].tolist(), *(x for x, _ in stars)], pa.int64()), pa.array([*counts[linked_].tolist(), *(y for _, y in stars)], pa.int64())], ["kind", "a", "b"]
            )

    return run


def _dense(rows: np.ndarray, by_set: np.ndarray, column: np.ndarray, wide: int) -> np.ndarray:
    out = np.zeros((len(rows), wide), np.uint8)
    for k, r in enumerate(rows.tolist()):
        out[k, column[by_set[r] : by_set[r + 1]]] = 1
    return out


def _merge(label: np.ndarray, rows: np.ndarray, columns: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels of connected parts after the links of a matrix."""
    i, j = np.nonzero(mask)
    if not len(i):
        return label
    pairs = np.unique(np.stack([label[rows[i]], label[columns[j]]], 1), axis=0)
    top = _spanning(np.arange(len(label)), pairs[:, 0], pairs[:, 1])
    new = np.arange(len(label))
    new[list(top)] = list(top.values())
    return new[label]


def _smallest(rid: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    least: dict[int, int] = {}
    for x, k in zip(rid.tolist(), label.tolist(), strict=True):
        least[k] = min(x, least.get(k, x))
    return [(x, least[k]) for x, k in zip(rid.tolist(), label.tolist(), strict=True)]


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the least neighbour m of their node a; a hub's edges stay where they are (see join_sized)."""
    total = least.agg(F.sum("degree")).first()[0] or 0
    return join_sized(edges, least, ["a"], "degree", total).drop("degree")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) by alternating large and small stars (Kiveris et al., 2014)."""
    edges = materialize(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    known = mark(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree")), "links-least")
        large = _with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(spark, large, "links")
        low = materialize(spark, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")), "links-least")
        small = _with_least(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(spark, small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        now = mark(edges)
        if now == known:
            break
        known = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def _in_blocks(rows: DataFrame, side: int) -> DataFrame:
    """Adds bucket, side and crossed; a bucket above side is dealt into blocks of which each two make a bucket of their own."""
    joined = rows.withColumn("blocks", F.ceil(F.col("size") / side).cast("int"))
    joined = joined.withColumn("side", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    return joined.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("bucket"), "slot", "rid", "side", (low != high).alias("crossed"))


def _leaves(spark: SparkSession, full: DataFrame, runs: int, tuning: Tuning) -> tuple[DataFrame, int]:
    """key, slot, level, rid, size of the leaves of more than one set, and the lowest level."""
    first = full.mapInArrow(_first_level(runs), "key long, size long").groupBy("key").agg(F.sum("size").alias("size")).collect()  # at most 512 a run
    first.sort(key=lambda r: r["key"] % (1 << 64))
    keys, sizes = np.array([r["key"] for r in first], np.int64).view(np.uint64), np.array([r["size"] for r in first], np.int64)
    rows, leaves, level = full.mapInArrow(_counted_level(runs, keys, sizes, tuning), NODES), [], COUNTED
    while True:
        rows = materialize(spark, rows, "jaccard-nodes")
        of_key = materialize(spark, rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "jaccard-counts")
        sized = materialize(spark, join_sized(rows, of_key, ["key"], "size", rows.count()), "jaccard-leaves")
        further = (F.col("level") == level) & F.lit(level < DEPTH) & _goes_on(F.col("size"), F.col("parent"), tuning)
        leaves.append(sized.filter(~further).select("key", "slot", "level", "rid", "size"))
        inner = sized.filter(further)
        if inner.isEmpty():
            break
        # A set is in no more nodes of a level than there are slots.
        inner = inner.groupBy("rid").agg(F.collect_list(F.struct("slot", "size")).alias("nodes")).join(full, "rid")
        rows = inner.select("rid", "sketch", F.col("nodes.slot").alias("slots"), F.col("nodes.size").alias("sizes")).mapInArrow(_next_level(runs, level), NODES)
        level += 1
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out, level


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "rid")


def jaccard_classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, tuning: Tuning = Tuning()) -> DataFrame:
    """row_uid, doc_id, class_uid, class_id, rep_id, n_links for each row of docs(row_uid, doc_id, text).

    class_id: smallest doc_id of the connected part of links; rep_id: smallest doc_id with the same set; n_links: other sets that the row's set is similar to.
    """
    bounded_batches(spark)
    runs = runs_for(similarity, recall)
    cutoff = cutoff_for(similarity)
    signed = materialize(spark, docs.select("row_uid", "doc_id", "text").mapInArrow(_sign, "row_uid long, doc_id long, sig binary, n long, sketch binary"), "jaccard-sketches")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_uid")).alias("first")
    sets = signed.groupBy("sig").agg(order, F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.count("*").alias("copies"))
    sets = materialize(spark, sets.withColumn("rid", F.monotonically_increasing_id()), "jaccard-sets")
    full = sets.filter("n > 0").select("rid", "sketch")
    leaves, lowest = _leaves(spark, full, runs, tuning)
    ends = [F.coalesce(F.bit_or(F.when(F.col("level") == d, F.expr("shiftleft(1L, slot)"))), F.lit(0).cast("long")) for d in range(1, lowest)]
    of_set = leaves.groupBy("rid").agg(F.array(*ends).alias("ends")).join(full, "rid")
    leaves = leaves.withColumn("slot", F.col("slot") * F.expr(f"shiftleft(1, {lowest} - level)"))  # the first slot under the leaf
    dealt = _in_blocks(leaves, tuning.side).join(of_set, "rid").select("bucket", "slot", "rid", "side", "crossed", "sketch", "ends")
    schema = "bucket long, slot int, rid long, side int, crossed boolean, sketch binary, ends array<long>"
    active = materialize(spark, _by_bucket(dealt).mapInArrow(_active(runs, cutoff, tuning), schema), "jaccard-active")
    # Whole sets are made again for the texts that have a partner, and for these alone.
    wanted = active.select("rid").distinct().join(sets.select("rid", "sig", F.col("first.doc_id").alias("doc_id")), "rid")
    # Rows without a doc_id can't be looked up and are all read again; a set that nobody wants finds no partner below.
    ids = wanted.filter("doc_id is not null").select("doc_id").distinct().hint("merge")
    texts = docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi").select("text").unionByName(docs.filter("doc_id is null").select("text"))

    def whole(batches: Batches) -> Batches:
        hasher = WordHasher()
        for batch in batches:
            own = {hashlib.blake2b(x.tobytes(), digest_size=16).digest(): x.tobytes() for x in shingles(*hasher.of(*utf8_buffers(batch.column("text"))), WORDS)}
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.binary())], ["sig", "shingles"])

    of_rid = texts.mapInArrow(whole, "sig binary, shingles binary").join(wanted.select("rid", "sig"), "sig").select("rid", "shingles").dropDuplicates(["rid"])
    found = _by_bucket(active.join(of_rid, "rid")).mapInArrow(_verify(runs, cutoff, similarity, tuning), "kind int, a long, b long")
    found = materialize(spark, found, "jaccard-links")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("n_links"))
    parts = components(spark, found.filter("kind = 1").select("a", "b")).select(F.col("node").alias("rid"), "label")
    labelled = sets.select("rid", "sig", "first", "copies").join(parts, "rid", "left").withColumn("label", F.coalesce("label", "rid")).join(links, "rid", "left")
    labelled = materialize(spark, labelled, "jaccard-classes")
    # One class may have a third of all sets, and one set a third of all rows: theirs stay where they are.
    least = materialize(spark, labelled.groupBy("label").agg(F.min("first").alias("head"), F.count("*").alias("members")), "jaccard-heads")
    of_sig = join_sized(labelled, least, ["label"], "members", labelled.count())
    of_sig = of_sig.select("sig", "copies", F.col("first.doc_id").alias("rep_id"), F.col("head.row_uid").alias("class_uid"), F.col("head.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_sig = materialize(spark, of_sig, "jaccard-of-set")
    return join_sized(signed.select("row_uid", "doc_id", "sig"), of_sig, ["sig"], "copies", signed.count()).select("row_uid", "doc_id", "class_uid", "class_id", "rep_id", "n_links")


def jaccard_join(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, tuning: Tuning = Tuning()) -> DataFrame:
    """doc_id, class_id, rep_id, n_links."""
    source = row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return jaccard_classes(spark, source, similarity, recall, tuning).select("doc_id", "class_id", "rep_id", "n_links")


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest doc_id, with all its columns, whatever these are called."""
    (uid,) = fresh_names(docs, "row_uid")
    numbered = materialize(spark, row_ids(docs, uid), "jaccard-input")
    classes = jaccard_classes(spark, numbered.select(F.col(uid).alias("row_uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    stay = classes.filter(F.col("row_uid") == F.col("class_uid")).select(F.col("row_uid").alias(uid))
    return numbered.join(stay, uid, "left_semi").select(docs.columns)
