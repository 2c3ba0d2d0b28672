"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words and character n-grams (hashed to BUCKETS), and
a softmax over two outputs follows. Vectors and output weights are learned together by numpy stochastic
gradient descent over a bounded sample of the labelled training rows (SAMPLE), whose bucket counts are made
on the executors from whole texts. As the average and the output are linear, the difference of the two
outputs is an average of one number a bucket; scoring looks those numbers up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import across, code_points, gram_hashes, held_out, slices_of

BUCKET_BITS, WIDTHS, DIMENSIONS = 16, (3, 4), 16
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows that teach, passes over them, first learning rate.
SAMPLE, EPOCHS, RATE, SEED = 3_000, 8, 4.0, 9
THRESHOLD, CLASSES = 0.7, 2
#: Bucket of the token that stands for a repeated word.
REPEATED = 12_345
#: Odd multiplier of the word hash and its inverse modulo 2**64.
POWER = 0x9E3779B97F4A7C15
INVERSE = pow(POWER, -1, 1 << 64)


def bucket_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and n-grams of the texts, and the text each belongs to. Blanks of any kind count as one and the same; a word that repeats the one before also counts as the token REPEATED, whatever word it is."""
    codes, offsets = code_points([t.lower() for t in texts])
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes = np.where(blank, np.uint32(32), codes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    shift = np.uint32(32 - BUCKET_BITS)
    ids, owners = [], []
    if len(codes):
        # words: differences of a running polynomial sum, brought to a common power
        first = np.zeros(len(codes), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | first))
        last = np.concatenate([blank[1:] | first[1:], [True]])
        ends = np.flatnonzero(~blank & last) + 1
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(codes), POWER, np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * powers)])
            back = np.cumprod(np.full(len(codes), INVERSE, np.uint64))
            words = (sums[ends] - sums[starts]) * back[starts]
            words = (words ^ (words >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        own = owner[starts]
        again = own[1:][(words[1:] == words[:-1]) & (own[1:] == own[:-1])]
        ids += [(words >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32), np.full(len(again), REPEATED, np.uint32)]
        owners += [own, again]
    for width, key in gram_hashes(codes, WIDTHS):
        keep = np.ones(len(key), bool)
        keep[across(offsets, width, len(key))] = False
        ids.append((key >> shift)[keep])
        owners.append(owner[: len(key)][keep])
    return (np.concatenate(ids), np.concatenate(owners)) if ids else (np.empty(0, np.uint32), np.empty(0, np.int32))


class QualityModel:
    """The difference of the two outputs a bucket, and without any feature."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1; an empty or null text has the output of no features."""
        plain, out = [t or "" for t in texts], []
        for a, b in slices_of(plain, 256):
            ids, owner = bucket_ids(plain[a:b])
            total = np.bincount(owner, self.table[ids], b - a)
            count = np.bincount(owner, minlength=b - a)
            out.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias))))
        return np.concatenate(out) if out else np.empty(0)


def descend(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent over (buckets, counts, label)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((CLASSES, DIMENSIONS), np.float32), np.zeros(CLASSES, np.float32)
    prepared = [(i, (c / c.sum()).astype(np.float32), y) for i, c, y in examples if len(i)]
    steps, done = max(1, epochs * len(prepared)), 0
    for _ in range(epochs):
        for at in rng.permutation(len(prepared)):
            ids, share, label = prepared[at]
            speed = rate * (1 - done / steps)
            done += 1
            rows = vectors[ids]
            mean = share @ rows
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the loss by the outputs
            back = p @ output
            # a vector's step is not divided by the length of the text but by the largest share, so that long texts teach as fast as short ones
            vectors[ids] = rows - speed * np.outer(share / share.max(), back)
            output -= 0.1 * speed * np.outer(p, mean)
            bias -= 0.01 * speed * p
    side = output[1] - output[0]
    return QualityModel((vectors @ side).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learn labels.quality from the texts of rows outside the evaluation fold, of which the `sample` with the smallest hashes of doc_id are taken.

    Rows with a null label, text or doc_id teach nothing; a doc_id with several labels takes the smallest.
    Without labels every score is a half.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    picked = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids

    def count(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids, counts = np.unique(bucket_ids([text])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), batch.column("y").slice(i, 1), pa.array([ids.astype(np.uint16).tobytes()]), pa.array([counts.astype(np.uint32).tobytes()])], ["doc_id", "y", "ids", "counts"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = picked.mapInArrow(count, f"doc_id {kind}, y int, ids binary, counts binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return descend([(np.frombuffer(bytes(r["ids"]), np.uint16), np.frombuffer(bytes(r["counts"]), np.uint32).astype(np.float64), r["y"]) for r in rows])


def quality_score(text: Column, spark: SparkSession, model: QualityModel) -> Column:
    held = spark.sparkContext.broadcast(model)  # one number a bucket

    @F.arrow_udf("double")
    def work(texts: pa.Array) -> pa.Array:
        parts = [held.value.score(texts.slice(at, 256).to_pylist()) for at in range(0, len(texts), 256)]
        return pa.array(np.concatenate([np.empty(0), *parts]), pa.float64())

    return work(text)


def rated(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted a row of docs.

    Null and empty texts get the score of no features; repeated rows are scored each; a null doc_id is
    carried along and not held out; an empty table gives an empty table; other columns are ignored.
    """
    found = docs.select("doc_id", quality_score(F.col("text"), docs.sparkSession, model).alias("score"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rated(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
