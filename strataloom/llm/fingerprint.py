"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle is hashed once; the high bits name one of BINS bins, and each bin keeps its smallest hash. An
empty bin borrows from a bin that its own sequence of hashed probes finds first among the full ones, so any
two sets borrow alike. The low BITS bits of each bin are packed. Two sets that differ agree on a bin by
chance with probability 2**-BITS, which the likeness takes out.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import WordHashes, mixed, rows_of, words_of

WORDS, BINS, BITS = 5, 256, 4
#: Parts of the document order at most, rows for one part at least, and sampled ids a part.
PARTS, PART_ROWS, PER = 1 << 16, 4_096, 16


def batch_shingles(texts: list[bytes], words: int, memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' shingles, repeated ones included, and the text each is from: shingles_of, for many texts at once."""
    split = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    hashes = np.fromiter(map(memory.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
    owner = np.repeat(np.arange(len(split)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the text's end
    # a text of fewer words is one shingle, as wide as it is long
    width = np.minimum(counts, words)[owner]
    first = left >= width
    total = width.astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    for j in range(words):
        step = mixed(total * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + len(total)])
        total = step if j == 0 else np.where(width > j, step, total)
    return total[first], owner[first]


def bin_minima(shingles: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(n, bins) densified bin minima of n sets of 64-bit shingle hashes, and which sets are not empty; bins must be a power of two."""
    h = mixed(shingles ^ np.uint64(0x5BD1E995CAFEF00D))
    shift = np.uint64(64 - bins.bit_length() + 1)
    place = owner * bins + (h >> shift).astype(np.int64)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, place, h & ((np.uint64(1) << shift) - np.uint64(1)))
    full = np.zeros(n * bins, bool)
    full[place] = True
    known = full.reshape(n, bins).any(axis=1)
    empty = np.flatnonzero(~full & np.repeat(known, bins))
    source, probe = out.copy(), 0
    while len(empty):
        probe += 1
        seed = np.uint64(probe * 0xD6E8FEB86659FD93 % (1 << 64))
        start = empty // bins * bins
        target = start + (mixed((empty - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed) & np.uint64(bins - 1)).astype(np.int64)
        hit = full[target]
        out[empty[hit]] = source[target[hit]]
        empty = empty[~hit]
    return out.reshape(n, bins), known


def one_permutation(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified bin minima of one non-empty set."""
    return bin_minima(shingles, np.zeros(len(shingles), np.int64), 1, bins)[0][0]


def low_bits(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, after mixing."""
    return (mixed(minima) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def pack(low: np.ndarray, bits: int = BITS) -> bytes:
    """One set's low bits, most significant first."""
    return np.packbits((low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8) & 1).astype(np.uint8)).tobytes()


def agreement(same: float, bits: int = BITS) -> float:
    """Jaccard similarity estimated from the share of equal bins, less what is equal by chance."""
    chance = 2.0**-bits
    return float(max(0.0, (same - chance) / (1 - chance)))


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated similarity of two packed fingerprints: 1 for equal ones, 0 if just one is empty."""
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(bins, bits)
    return agreement(1 - x.any(axis=1).mean(), bits)


class Prints:
    """The fingerprints of a list of texts: low bits a bin, and whether a text has any word."""

    def __init__(self, texts: list[str], memory: WordHashes, words: int = WORDS):
        shingles, owner = batch_shingles([t.encode("utf-8", "replace") for t in texts], words, memory)
        minima, self.known = bin_minima(shingles, owner, len(texts))
        self.low = low_bits(minima)

    def packed(self, i: int) -> bytes:
        """b'' for a text without a word."""
        return pack(self.low[i]) if self.known[i] else b""

    def likeness(self, i: int, other: Prints, k: int) -> float:
        """likeness of text i and the other's text k, without packing."""
        if not (self.known[i] and other.known[k]):
            return float(self.known[i] == other.known[k])
        return agreement((self.low[i] == other.low[k]).mean())


def fingerprint(text: str | None, memory: WordHashes, words: int = WORDS) -> bytes:
    """The packed fingerprint of one text; b'' where it has no word."""
    return Prints([text or ""], memory, words).packed(0)


def cut_points(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ascending doc_ids that cut docs into parts of about equal counts: every PER-th of the ids with the smallest hashes, some PER * parts of them."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    share = min(1.0, PER * parts / max(1, ids.count()))
    bound = int(-(2**63) + share * (2**64 - 2**11))
    found = sorted(r["doc_id"] for r in ids.where(F.xxhash64(F.col("doc_id").cast("string")) <= bound).distinct().collect())
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


def part_of(doc_id: Column, cuts: list[int]) -> Column:
    """The number of cuts below doc_id, 0 for null; the cuts are searched in two steps, so that a row compares itself with some 2 * sqrt(n) of them."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    blocks = F.from_json(F.lit(json.dumps([cuts[k : k + width] for k in range(0, len(cuts), width)])), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps(cuts[width::width])), "array<bigint>")
    block = F.size(F.filter(heads, lambda c: c < doc_id))
    return F.coalesce(block * width + F.size(F.filter(F.get(blocks, block), lambda c: c < doc_id)), F.lit(0)).cast("int")


def successors(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt into ranges of doc_id with the columns part, ghost, and the number of parts: each part, taken in descending order of doc_id (equal ids by text), ends with a copy (ghost) of the document that follows it. The last part's ghost is the first document of all.

    The texts are shuffled once. What the driver holds is sampled ids, PER * PARTS or so, and a row a part.
    """
    parts = max(1, min(PARTS, docs.count() // PART_ROWS))
    cuts = cut_points(docs, parts) if parts > 1 else []
    # null ids come last: part 0 holds them and the smallest ids
    dealt = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), 0).otherwise(part_of(F.col("doc_id"), cuts)).alias("part"))
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()
    # a part's first document follows the last of the part above; that of the highest part follows the last of all
    above = {r["part"]: tops[(k + 1) % len(tops)]["part"] for k, r in enumerate(tops)}
    first = [(r["part"], r["top"], above[r["part"]]) for r in tops]
    if not first:
        return dealt.withColumn("ghost", F.lit(False)), 1
    marks = docs.sparkSession.createDataFrame(first, "part int, top bigint, above int")
    copies = dealt.join(F.broadcast(marks), (dealt["part"] == marks["part"]) & dealt["doc_id"].eqNullSafe(marks["top"]))  # a row a part
    ghosts = copies.groupBy("above").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.col("text").isNotNull(), "text")).alias("d"))
    ghosts = ghosts.select("d.doc_id", "d.text", F.col("above").alias("part"), F.lit(True).alias("ghost"))
    return dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts), len(cuts) + 1


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """A row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 2 code points replaced by the first as many (or all) of the next
    document in descending order of doc_id; after the last comes the first, so a lone document follows
    itself. Null texts count as empty; texts without words have an empty fingerprint. Equal ids follow
    each other by text (null first); null ids come last. An empty table gives an empty table. Other
    columns are ignored. doc_id must be of an integer type.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt, parts = successors(docs.select("doc_id", "text"))
    # parts are even, and each is one task
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))

    def work(batches):
        memory, held = WordHashes(), None
        for ids, texts, ghosts in rows_of(batches, "doc_id", "text", "ghost"):
            rows = ([held] if held else []) + [(i, t or "") for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
            held = None if ghosts[-1].as_py() else rows[-1]  # a ghost is its part's last row
            if len(rows) < 2:
                continue
            plain = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(plain, plain[1:], strict=False)]
            own, new = Prints(plain, memory, words), Prints(edited, memory, words)
            count = range(len(edited))
            columns = [
                pa.array([i for i, _ in rows[:-1]], ids.type),
                pa.array([len(t) for t in plain[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited], pa.string()),
                pa.array([own.packed(k).hex() for k in count], pa.string()),
                pa.array([new.packed(k).hex() for k in count], pa.string()),
                pa.array([own.likeness(k, new, k) for k in count], pa.float64()),
                pa.array([own.likeness(k, own, k + 1) for k in count], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(work, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
