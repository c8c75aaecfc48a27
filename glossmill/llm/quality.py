"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over overlapping chunks that cover the whole document, each
filter keeps its maximum in a chunk, and the mean and maximum over chunks go through one hidden layer to
one probability. It is trained by Adam on a bounded sample of whole labelled rows: up to SAMPLE, of up to CHARS
characters together.

Defined results: null text counts as empty; an empty text is one chunk of zeros and gets a score as any
other; without labels every score is 0.5; rows of labels with a null are not learned from; every row of
documents gives one row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, crc_mod, utf8_buffers

#: The bound of the training sample: labelled rows, and characters of all of them.
SAMPLE, CHARS = 4000, 12_000_000
CHUNK, OVERLAP = 512, 64
EMBEDDING, WIDTH, STEP, FILTERS, HIDDEN = 8, 8, 2, 32, 16
EPOCHS, BATCH, RATE = 6, 32, 0.004
THRESHOLD = 0.3
#: Chunks that one matrix product takes.
AT_ONCE = 256


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, one a row, filled up with zeros, and the first row of each text."""
    step = CHUNK - OVERLAP
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    firsts = np.concatenate(([0], np.cumsum(counts)))
    within = np.arange(firsts[-1]) - np.repeat(firsts[:-1], counts)
    starts = np.repeat(offsets[:-1], counts) + within * step
    ends = np.minimum(starts + CHUNK, np.repeat(offsets[1:], counts))
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]
    rows[np.arange(CHUNK) >= (ends - starts)[:, None]] = 0
    return rows, firsts


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBEDDING)), "conv": r.normal(0, (2 / (WIDTH * EMBEDDING)) ** 0.5, (WIDTH * EMBEDDING, FILTERS)), "conv_b": np.zeros(FILTERS),
            "hidden": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)), "hidden_b": np.zeros(HIDDEN), "out": r.normal(0, 0.3, HIDDEN), "out_b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["embed"][0] = 0

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Embedded bytes under each position of the filters."""
        embedded = self.p["embed"][rows].reshape(len(rows), CHUNK * EMBEDDING)
        view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBEDDING, axis=1)
        return np.ascontiguousarray(view[:, :: STEP * EMBEDDING])

    def features(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), FILTERS), np.float32)
        for low in range(0, len(rows), AT_ONCE):
            part = rows[low : low + AT_ONCE]
            seen = self.windows(part)
            n, positions, k = seen.shape
            values = (seen.reshape(-1, k) @ self.p["conv"]).reshape(n, positions, FILTERS)
            out[low : low + n] = np.maximum(values.max(1) + self.p["conv_b"], 0)
        return out

    def head(self, pooled: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.diff(firsts)[:, None]
        both = np.concatenate([np.add.reduceat(pooled, firsts[:-1]) / counts, np.maximum.reduceat(pooled, firsts[:-1])], 1)
        hidden = np.maximum(both @ self.p["hidden"] + self.p["hidden_b"], 0)
        logit = hidden @ self.p["out"] + self.p["out_b"]
        return both, hidden, 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 1:
            return np.zeros(0)
        rows, firsts = chunked(data, offsets)
        return self.head(self.features(rows), firsts)[2]

    def gradients(self, rows: np.ndarray, firsts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """rows: chunks of some texts; AT_ONCE of them are unfolded at a time, however long a text is."""
        p = self.p
        at = np.empty((len(rows), FILTERS), np.int64)
        top = np.empty((len(rows), FILTERS), p["conv"].dtype)
        for low in range(0, len(rows), AT_ONCE):
            seen = self.windows(rows[low : low + AT_ONCE])
            n, positions, k = seen.shape
            values = (seen.reshape(-1, k) @ p["conv"]).reshape(n, positions, FILTERS)
            at[low : low + n] = values.argmax(1)
            top[low : low + n] = np.take_along_axis(values, at[low : low + n, None], 1)[:, 0] + p["conv_b"]
        pooled = np.maximum(top, 0)
        both, hidden, prob = self.head(pooled, firsts)
        d_logit = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": hidden.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_hidden = np.outer(d_logit, p["out"]) * (hidden > 0)
        g |= {"hidden": both.T @ d_hidden, "hidden_b": d_hidden.sum(0)}
        d_both = d_hidden @ p["hidden"].T
        counts = np.diff(firsts)
        of = np.repeat(np.arange(len(counts)), counts)
        d_pool = d_both[of, :FILTERS] / counts[of][:, None]
        is_top = pooled == both[of, FILTERS:]
        ties = np.add.reduceat(is_top.astype(np.float32), firsts[:-1])
        d_pool = (d_pool + d_both[of, FILTERS:] * is_top / np.maximum(ties, 1)[of]) * (top > 0)
        g |= {"conv_b": d_pool.sum(0), "conv": np.zeros_like(p["conv"]), "embed": np.zeros_like(p["embed"])}
        for low in range(0, len(rows), AT_ONCE):
            part, own = rows[low : low + AT_ONCE], d_pool[low : low + AT_ONCE]
            where = at[low : low + len(part), :, None] * STEP + np.arange(WIDTH)
            which = part[np.arange(len(part))[:, None, None], where]  # chunk, filter, byte under it
            chosen = p["embed"][which].reshape(len(part), FILTERS, -1)
            g["conv"] += np.einsum("nfk,nf->kf", chosen, own)
            d_seen = (own[:, :, None] * p["conv"].T[None]).reshape(-1, EMBEDDING)
            flat = which.ravel()
            for e in range(EMBEDDING):
                g["embed"][:, e] += np.bincount(flat, d_seen[:, e], minlength=256)
        g["embed"][0] = 0
        return g

    def train(self, texts: list[bytes], y: np.ndarray, seed: int = 11) -> None:
        """Whole texts; a step takes BATCH of them."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps, total = 0, EPOCHS * -(-len(texts) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for low in range(0, len(order), BATCH):
                own = order[low : low + BATCH]
                offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in own])))
                rows, firsts = chunked(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), offsets)
                steps += 1
                rate = RATE * (1 - 0.9 * steps / total)
                for k, g in self.gradients(rows, firsts, y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)


def training_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Up to SAMPLE labelled rows, together of up to CHARS characters; a text is in the sample as a whole or not at all."""
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    n = known.count()
    if not n:
        return [], np.zeros(0)
    share = F.crc32(F.md5(F.col("doc_id").cast("string"))) / float(1 << 32)
    drawn = known.filter(share < min(1.0, 1.2 * SAMPLE / n + 100 / n)).withColumn("at", share).orderBy("at", "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    listed = texts.join(F.broadcast(drawn), "doc_id").select("at", "doc_id", "h", "quality", F.length("text").alias("n")).distinct().orderBy("at", "doc_id", "h", "quality").limit(SAMPLE).collect()
    chosen, left = [], CHARS
    for r in listed:
        if r["n"] <= left:
            chosen.append((r["doc_id"], r["h"], float(r["quality"])))
            left -= r["n"]
    if not chosen:
        return [], np.zeros(0)
    wanted = spark.createDataFrame([x[:2] for x in chosen], "doc_id long, h long").distinct()
    found = {(r["doc_id"], r["h"]): r["text"].encode() for r in texts.join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).collect()}
    return [found[x[:2]] for x in chosen], np.array([x[2] for x in chosen])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Network | None:
    texts, y = training_sample(spark, docs, labels)
    if not len(y):
        return None
    own = Network()
    share = min(max(y.mean(), 0.01), 0.99)
    own.p["out_b"][:] = np.log(share / (1 - share))
    own.train(texts, y)
    return own


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of rows whose crc32 modulo 5 is 0 teach nothing."""
    bounded_batches(spark)
    learned = fit(spark, docs, labels.filter(crc_mod("doc_id", 5) != 0))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column("text"))
            score = np.empty(batch.num_rows)
            low = 0
            while low < batch.num_rows:  # parts of about a MB
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 20), side="right")) - 1)
                part = offsets[low : high + 1]
                score[low:high] = learned.score(data[part[0] : part[-1]], part - part[0]) if learned else 0.5
                low = high
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
