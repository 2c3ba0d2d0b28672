"""Importance resampling towards a target distribution, by an external sort-count over bucket streams.

Each document's features (its words and pairs of neighbouring words) are hashed to BUCKETS buckets, and written once as a packed
uint16 stream with the offsets of its documents. The streams are read in runs of bounded size that are sorted and run-length
encoded into counts, which Spark adds up. From the counts of the corpus and the target comes a gain a bucket; the streams are
read once more, gains gathered by bucket and summed a document with np.add.reduceat. Gumbel noise from a keyed hash of the
document's id turns the largest scores into a sample without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import rows_of, staged

#: Buckets of features; words that a document needs to be drawn; how many of a hundred such documents are drawn; the key of the noise.
BUCKETS, LEAST_WORDS, PERCENT, KEY = 10_000, 20, 25, 7
#: Bytes of text taken at once; features sorted at once.
PIECE, RUN = 1 << 20, 1 << 22
#: A-Z in lower case, and a blank for every ASCII byte that is neither letter nor digit: [\x00-\x2F\x3A-\x60\x7B-\x7F]. Fixed values.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces_of(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """text, with WORD_BYTES applied, in pieces of about `size` bytes that end between words."""
    at = 0
    while at < len(text):
        end = at + size
        part = text[at:end].translate(WORD_BYTES)
        # a word that goes on is taken whole
        while end < len(text) and part[-1] != 32:
            more = text[end : end + 4096].translate(WORD_BYTES)
            cut = more.find(b" ")
            part += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
        yield part
        at = end


class Spaced(dict):
    """A word's bytes after a blank, and its crc32, remembered for up to `most` words."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> tuple[bytes, int]:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = (b" " + word, crc32(word))
        return found


def bucket_stream(text: bytes, memory: Spaced, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The buckets of all features of a text, repeats included, as uint16, and its number of words."""
    parts, before, n = [], None, 0
    for piece in pieces_of(text):
        words = piece.split()
        if not words:
            continue
        spaced, sums = zip(*map(memory.__getitem__, words), strict=True)
        pairs = list(map(crc32, spaced[1:], sums))
        if before is not None:
            pairs.append(crc32(spaced[0], before))
        parts.append(np.fromiter(sums, np.uint32, len(sums)))
        parts.append(np.fromiter(pairs, np.uint32, len(pairs)))
        before, n = sums[-1], n + len(words)
    return ((np.concatenate(parts) % np.uint32(buckets)).astype(np.uint16) if parts else np.empty(0, np.uint16)), n


def bucket_streams(texts: DataFrame, key: str | None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of (doc_ids, words, offsets, stream) of some 256 texts or 1 MB each: the buckets of the texts' features as packed uint16, where each text's start and end, and each text's number of words. key: the column of ids, None for nulls."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered by 16 bits")

    def work(batches):
        memory = Spaced()
        for ids, values in rows_of(batches, "doc_id", "text"):
            found = [bucket_stream(t or b"", memory, buckets) for t in values.to_pylist()]
            offsets = np.cumsum([0, *(len(s) for s, _ in found)])
            stream = np.concatenate([s for s, _ in found]).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([[n for _, n in found]], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([stream], pa.binary())],
                ["doc_ids", "words", "offsets", "stream"],
            )

    rows = texts.select((F.col(key) if key else F.lit(None)).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_ids array<long>, words array<long>, offsets array<long>, stream binary")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a run and how often each is in it: sorted, then run-length encoded."""
    ordered = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is in all streams. A task sends a row a bucket at most, and the driver gets as many rows."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("stream"):
                stream = np.frombuffer(data.as_buffer(), "<u2")
                for at in range(0, len(stream), RUN):
                    which, often = run_lengths(stream[at : at + RUN])
                    total[which] += often
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(total[which], pa.int64())], ["bucket", "n"])

    rows = streams.select("stream").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) a document: the mean of its features' gains, rounded down; 0 without features."""

    def work(batches):
        for batch in batches:
            for ids, words, offsets, data in zip(*(batch.column(c) for c in ("doc_ids", "words", "offsets", "stream")), strict=True):
                edges = np.asarray(offsets.values)
                sizes, sums = np.diff(edges), np.zeros(len(edges) - 1, np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    sums[full] = np.add.reduceat(gain[np.frombuffer(data.as_buffer(), "<u2")], edges[full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, key: int) -> Column:
    """A standard Gumbel variate in thousandths, rounded down, from the first 32 bits of the sha256 of `key:doc_id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`: 1, 2, 3 ... in the order. Rows are dealt into ranges of the order and numbered in each; the numbers before a range come from a row a range, so nothing is sorted as a whole, and rows that tie may lie in several ranges."""
    tied = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = staged(tied.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_row")).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, total = {}, 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        before[r["part"]], total = total, total + r["count"]
    if not before:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("_at")
    bases = rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, key: int = KEY) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) a row of docs (doc_id, text): rank 1, 2, 3 ... by descending score, then doc_id, for the
    floor(percent * N / 100) drawn of the N documents with least_words words or more; null for the others.

    Null and empty texts have no features and weight 0. Rows that repeat an id are documents of their own with the same noise; a null id hashes as an empty one
    and comes last among ties. Very long texts are read in pieces. An empty target is smoothed like any other; an empty table gives an empty table. Other columns are ignored.
    """
    streams = staged(bucket_streams(docs, "doc_id", buckets))
    gain = gains(bucket_counts(streams, buckets), bucket_counts(bucket_streams(target, None, buckets), buckets))
    scored = staged(weights(streams, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), key)))
    fit = F.col("n_words") >= least_words
    draw = percent * scored.where(fit).count() // 100
    drawn = ranked(scored.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    left = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(left)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
