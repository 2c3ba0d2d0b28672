"""Shared folder, staged tables and text-hash helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stripped from both ends of lines and splitting words: [\x20\x09-\x0D]. Fixed values.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct words whose hashes a worker remembers before it starts afresh.
WORD_MEMORY = 200_000
#: Bytes of a slice of an Arrow batch that is worked on at once.
SLICE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the whole cluster sees. Where the session names none (tests on one machine) a temporary folder takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(spark: SparkSession, data: bytes, name: str) -> str:
    """The path of a new file in the shared folder that holds data."""
    path = f"{shared_dir(spark)}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, other letters as they are; texts of one byte a character take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """True for the evaluation fold, whose labels no model sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class WordHashes(dict):
    """64-bit hashes by word, remembered up to WORD_MEMORY words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text with A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: bytes | None, size: int, memory: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of size-word shingles; a shorter text is one shingle, a text without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(total)])
    return np.unique(total)


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Arrow batches as slices of at most 256 rows and about SLICE bytes (one row at least), so that what is built from one slice stays small."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(256, batch.num_rows - at)
            while take > 1 and batch.slice(at, take).nbytes > SLICE:
                take = (take + 1) // 2
            part = batch.slice(at, take)
            yield tuple(part.column(part.schema.get_field_index(c)) for c in columns)
            at += take


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one text after another, and the offsets at which the texts start and end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def gram_hashes(codes: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each width up to the largest, the 32-bit hashes of the grams that start at each code point; yields the widths asked for."""
    key = np.zeros(len(codes), np.uint32)
    for width in range(1, max(widths) + 1):
        n = len(codes) - width + 1
        if n <= 0:
            return
        key = key[:n] * np.uint32(0x9E3779B1) + codes[width - 1 :]
        if width in widths:
            out = (key ^ np.uint32(width * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            out ^= out >> np.uint32(15)
            yield width, out * np.uint32(0x27D4EB2F)


def across(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Places of the n gram starts whose gram reaches over the end of its text."""
    ends = offsets[1:-1]
    if width == 1 or not len(ends):
        return np.empty(0, np.int64)
    at = np.concatenate([ends - k for k in range(1, width)])
    return at[(at >= 0) & (at < n)]


def slices_of(texts: list[str], rows: int, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Spans of at most `rows` texts and about `chars` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars or i + 1 - at == rows:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
