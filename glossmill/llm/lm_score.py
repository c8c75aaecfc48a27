"""Language-model scores of whole documents, and an add-one unigram base.

Counts cover all training documents: each block of documents sends its distinct words once, by ranges of
their hash; counts come back to the block and meet its documents there. The vocabulary of the recurrent
model and its classes follow the counts of all whole training texts, and more words have an output of their own the more
distinct ones there are. The model is learned in two steps: on a bounded sample (up to SAMPLE whole texts, together
SAMPLE * CHARS characters at most), then on all training documents, partition by partition, whose weights are averaged by
the words that they have seen. Rare words are of classes that the model prices, too; in a class, counts over all training
documents tell a word's share.

Words are told apart by 64-bit hashes.

Defined results: null text counts as empty, and an empty text is an end alone; without a training row N
and V are 0; repeated rows are documents of their own; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, crc_mod, materialize, plan_bytes, utf8_buffers
from glossmill.llm.gru import END_HASH, SHAPES, LanguageModel, Vocabulary, head_size, shape_of
from glossmill.llm.words import WordHasher

#: The bound of the first sample.
SAMPLE, CHARS, PASSES = 800, 20_000, 2
#: The rate of the second step.
RATE = 0.003
#: Words that a partition trains on before it reads on, and the windows that they make at least.
AT_ONCE, STEPS = 1_000_000, 50
#: Bytes of text in a block of documents, and of words' rows in a range of hashes.
BLOCK_BYTES, RANGE_BYTES = 12 << 20, 12 << 20

BLOCKS = (
    "kind int, block long, part int, words binary, train binary, "
    "doc_id array<long>, held_out array<boolean>, n_tokens array<long>, model array<double>, starts binary, which binary, often binary"
)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sample(docs: DataFrame, n: int) -> list[str]:
    """Whole texts of the n training documents."""
    if not n:
        return []
    at = F.crc32(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    drawn = docs.filter("not held_out").filter(at / float(1 << 32) < min(1.0, (1.2 * SAMPLE + 50) / n)).select(at.alias("at"), F.length("text").alias("n"), "text")
    chosen, left = [], SAMPLE * CHARS
    for r in drawn.select("at", "n").orderBy("at", "n").limit(SAMPLE).collect():
        if r["n"] <= left:  # a text is taken whole or left to the second step
            chosen.append((r["at"], r["n"]))
            left -= r["n"]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "at long, n int").distinct()
    return [r["text"] for r in drawn.join(F.broadcast(wanted), ["at", "n"]).select("at", "text").limit(len(chosen)).orderBy("at", "text").collect()]


def _hashed(texts: list[str]) -> list[np.ndarray]:
    hashes, borders = WordHasher().of(*utf8_buffers(pa.array(texts, pa.string())), fold=True, shapes=SHAPES)
    return [hashes[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


def _tallies(parts: int):
    """Distinct words of some texts and their counts, a row for each range of hashes."""

    def rows(held: list[np.ndarray]) -> Batches:
        words, often = np.unique(np.concatenate(held), return_counts=True)
        part = _part_of(words, parts)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cuts))
        columns = [[x[cuts[k] : cuts[k + 1]].tobytes() for k in full] for x in (words, often.astype("<i8"))]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], ["at", "words", "often"])

    def run(batches: Batches) -> Batches:
        hasher, held, size = WordHasher(), [], 0
        for batch in batches:
            hashes, _ = hasher.of(*utf8_buffers(batch.column("text")), fold=True, shapes=SHAPES)
            held.append(hashes)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    return run


def _most_frequent(most: int | None, parts: int = 1):
    """The most frequent words of a group of rows, ties by the smaller hash, and how many distinct ones it has; most: None where they are not counted yet.

    Words lie in their ranges by chance, so that twice a range's words by the number of ranges is more than all have.
    """

    def run(group: pa.Table) -> pa.Table:
        words, inverse = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group["words"]]), return_inverse=True)
        often = np.bincount(inverse, np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in group["often"]]), minlength=len(words)).astype("<i8")
        order = np.lexsort((words, -often))
        order = np.sort(order[words[order] != END_HASH][: (most or head_size(2 * parts * len(words))) - 1])
        return pa.table({"at": [group["at"][0].as_py()], "words": pa.array([words[order].tobytes()], pa.binary()), "often": pa.array([often[order].tobytes()], pa.binary()), "distinct": pa.array([len(words)], pa.int64()), "shapes": pa.array([np.bincount(shape_of(words), often, SHAPES).astype(np.int64).tolist()], pa.list_(pa.int64()))})

    return run


def vocabulary(docs: DataFrame, parts: int, ends: int) -> Vocabulary:
    """The most frequent words of all training texts, of which there are ends: each range of hashes has its own ones, and ranges are merged by 16."""
    found, schema = "at long, words binary, often binary, distinct long, shapes array<long>", "at long, words binary, often binary"
    tallied = docs.filter("not held_out").select("text").mapInArrow(_tallies(parts), schema)
    best = materialize(docs.sparkSession, tallied.groupBy("at").applyInArrow(_most_frequent(None, parts), found), "lm-words")
    most, shapes = head_size(best.agg(F.sum("distinct")).first()[0] or 0), np.zeros(SHAPES)
    for r in best.select(F.posexplode("shapes").alias("shape", "n")).groupBy("shape").agg(F.sum("n").alias("n")).collect():  # a row a shape
        shapes[r["shape"]] = r["n"]
    while parts > 16:
        parts = -(-parts // 16)
        best = best.select(F.pmod("at", F.lit(parts)).alias("at"), "words", "often").groupBy("at").applyInArrow(_most_frequent(most), found)
    last = best.select(F.lit(0).cast("long").alias("at"), "words", "often").groupBy("at").applyInArrow(_most_frequent(most), found).collect()
    words, often = (np.frombuffer(last[0][k], t) if last else np.zeros(0, t) for k, t in (("words", np.uint64), ("often", "<i8")))
    return Vocabulary(words, often, most, ends, shapes)


def learn(spark: SparkSession, docs: DataFrame, parts: int = 8) -> LanguageModel:
    """The model of docs(doc_id, held_out, text)."""
    ends = docs.filter("not held_out").count()
    model = LanguageModel(vocabulary(docs, parts, ends))
    texts = _hashed(_sample(docs, ends)) or [np.zeros(0, np.uint64)]
    model.train(texts, passes=PASSES)
    shared = spark.sparkContext.broadcast(model)

    def tune(batches: Batches) -> Batches:
        own, hasher, texts, total, weighted = None, WordHasher(), [], 0, None

        def go_on() -> None:
            nonlocal own, total, texts
            if own is None:
                own = LanguageModel(shared.value.v).load(shared.value.flat())
            total += own.train(texts, rate=RATE, seed=total + 1, least=STEPS)
            texts = []

        for batch in batches:
            hashes, borders = hasher.of(*utf8_buffers(batch.column("text")), fold=True, shapes=SHAPES)
            texts += [hashes[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
            if sum(map(len, texts)) > AT_ONCE:
                go_on()
        if texts:
            go_on()
        if total:
            weighted = own.flat().astype(np.float64) * total
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total], pa.int64()), pa.array([weighted.tobytes()], pa.binary())], ["at", "total", "weighted"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(group["total"].to_pylist())
        weighted = sum(np.frombuffer(x.as_py(), np.float64) for x in group["weighted"])
        return pa.table({"at": [group["at"][0].as_py()], "total": [total], "weighted": pa.array([weighted.tobytes()], pa.binary())})

    schema = "at long, total long, weighted binary"
    taught = docs.filter("not held_out").select("text")
    sums = taught.mapInArrow(tune, schema)
    partitions = taught.rdd.getNumPartitions()
    while partitions > 16:  # sums of sums, so that no task holds the weights of many partitions
        partitions = -(-partitions // 16)
        sums = sums.withColumn("at", F.pmod("at", F.lit(partitions))).groupBy("at").applyInArrow(add, schema)
    last = sums.withColumn("at", F.lit(0).cast("long")).groupBy("at").applyInArrow(add, schema).collect()
    if last:
        model.load(np.frombuffer(last[0]["weighted"], np.float64) / last[0]["total"])
    return model


def _blocks(shared, parts: int):
    """Rows of kind 0: distinct words of a block in a range of hashes; of kind 1: the block's documents."""

    def rows(docs: pa.Table, number: int) -> Batches:
        model = shared.value
        held = np.array(docs["held_out"].to_pylist(), bool)
        data, offsets = utf8_buffers(docs["text"].combine_chunks())
        hashes, borders = WordHasher().of(data, offsets, fold=True, shapes=SHAPES)
        lengths = np.diff(borders)
        scores, _, _ = model.score(hashes, borders)
        words, inverse = np.unique(hashes, return_inverse=True)
        keys, often = np.unique(np.repeat(np.arange(len(lengths)), lengths) * max(1, len(words)) + inverse, return_counts=True)
        doc, which = keys // max(1, len(words)), keys % max(1, len(words))
        train = np.bincount(which, np.where(held[doc], 0, often), minlength=len(words)).astype(np.int64)
        part = _part_of(words, parts)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        nothing = [None] * 8
        out = [(0, number, k, words[a:b].tobytes(), train[a:b].astype("<i4").tobytes(), *nothing[1:]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        out.append(
            (1, number, None, words.tobytes(), None, docs["doc_id"].to_pylist(), held.tolist(), (lengths + 1).tolist(), scores.tolist(),
             np.searchsorted(doc, np.arange(len(lengths) + 1)).astype("<i8").tobytes(), which.astype("<u4").tobytes(), often.astype("<u4").tobytes())
        )
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.float64()), *(pa.binary(),) * 3]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def run(batches: Batches) -> Batches:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from rows(pa.Table.from_batches(held), number)
                number, held, size = number + 1, [], 0
        if held and sum(b.num_rows for b in held):
            yield from rows(pa.Table.from_batches(held), number)

    return run


def _count(vocabulary: np.ndarray):
    """Counts of the words of a range over all blocks, given back to each block; the totals stand in the first row."""

    def run(group: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_py(), np.uint64) for x in group["words"]]
        train = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in group["train"]])
        known, inverse = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(inverse, train, minlength=len(known)).astype(np.int64)
        rest = ~np.isin(known, vocabulary)
        shapes = shape_of(known[rest])
        totals = [int((counts > 0).sum()), int(counts.sum()), np.bincount(shapes, counts[rest] > 0, SHAPES).astype(np.int64).tolist(), np.bincount(shapes, counts[rest], SHAPES).astype(np.int64).tolist()]
        cuts = np.cumsum([0, *map(len, words)])
        own = counts[inverse]
        n = len(words)
        columns = {"block": group["block"], "part": group["part"], "counts": pa.array([own[a:b].astype("<i8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())}
        columns |= {k: pa.array([x] + [None] * (n - 1), pa.list_(pa.int64()) if k[0] == "r" else pa.int64()) for k, x in zip(("v", "n", "rest_v", "rest_n"), totals, strict=True)}
        return pa.table(columns)

    return run


def _price(vocabulary: np.ndarray, v: int, n: int, rest: np.ndarray, ends: int):
    """Joins a block's documents with the counts of its words; rest: distinct words and tokens of each class of rare words together."""
    v, n, log_rest = v + (ends > 0), n + ends, np.log10(rest + 1.0)

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        counted = counted.sort_by("part")
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), "<i8") for x in counted["counts"])])
        for r in docs.to_pylist():
            words = np.frombuffer(r["words"], np.uint64)
            starts, which, often = (np.frombuffer(r[k], t).astype(np.int64) for k, t in (("starts", "<i8"), ("which", "<u4"), ("often", "<u4")))
            log_c = np.log10(counts + 1.0)
            rare = ~np.isin(words, vocabulary)

            def of_docs(x: np.ndarray, which=which, often=often, starts=starts) -> np.ndarray:
                total = np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), x[which] * often, minlength=len(starts) - 1)
                return total

            tokens = np.array(r["n_tokens"])
            base = of_docs(log_c) + np.log10(ends + 1) - tokens * np.log10(n + v + 1)
            score = np.array(r["model"]) + of_docs(rare * (log_c - log_rest[shape_of(words)]))
            known = of_docs((counts > 0).astype(np.float64)).astype(np.int64) + (ends > 0)
            m = len(tokens)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(r["doc_id"], pa.int64()), "held_out": pa.array(r["held_out"], pa.bool_()), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                        "train_tokens": pa.array([n] * m, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
                    }
                )
            )
        return pa.concat_tables(out) if out else SCORES.empty_table()

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def lm_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows whose crc32 modulo 7 is 2 teach nothing."""
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = plan_bytes(docs.select("doc_id", "text"))
    if size > 1 << 50:  # the plan doesn't tell
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // RANGE_BYTES))  # a block sends a row a range that it has words of, so never more rows than words
    model = learn(spark, source, parts)
    shared = spark.sparkContext.broadcast(model)
    blocks = materialize(spark, source.mapInArrow(_blocks(shared, parts), BLOCKS), "lm-blocks")
    vocabulary = model.v.hashes
    counted = blocks.filter("kind = 0").select("block", "part", "words", "train").groupBy("part").applyInArrow(_count(vocabulary), "block long, part int, counts binary, v long, n long, rest_v array<long>, rest_n array<long>")
    counted = materialize(spark, counted, "lm-counts")
    totals = counted.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("v", "n"))).first()
    of_shape = counted.select(F.posexplode(F.arrays_zip("rest_v", "rest_n")).alias("shape", "r")).groupBy("shape").agg(F.sum(F.col("r.rest_v") + F.col("r.rest_n")).alias("rest"))
    rest = np.zeros(SHAPES)
    for r in of_shape.collect():  # a row a class
        rest[r["shape"]] = r["rest"]
    ends = source.filter("not held_out").count()
    of_docs = blocks.filter("kind = 1").drop("kind", "part", "train")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    priced = of_docs.groupBy("block").cogroup(counted.select("block", "part", "counts").groupBy("block"))
    return priced.applyInArrow(_price(vocabulary, *totals, rest, ends), schema)
