"""Language ID by string kernels: blended-spectrum presence kernels with Nyström landmarks and one-versus-rest
kernel ridge regression.

The kernel of two texts counts the character n-grams (1 to 4, hashed to SLOTS) that both hold, divided by the
geometric mean of what each holds. Landmarks come from a bounded sample of the training rows; a text's
features are its kernel values against them, whitened by the landmarks' own kernel matrix; ridge regression
fits one output a language. A batch of texts is scored by two matrix products.

A long text would hold n-grams in almost every slot, whatever its language. It is therefore taken in pieces of
at most PIECE code points, and its kernel values are those of its pieces, averaged by their sizes.

Only the sample is bounded (about TRAIN rows, at least two a language, and LANDMARKS landmarks); every language of
the training rows is learned, and texts are whole in training and in scoring.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataloom.llm.common import across, code_points, gram_hashes, held_out, slices_of, staged

WIDTHS, SLOT_BITS = (1, 2, 3, 4), 15
SLOTS = 1 << SLOT_BITS
#: Training rows and landmarks over all languages.
TRAIN, LANDMARKS = 2_000, 160
RIDGE, SHARPNESS = 1e-3, 6.0
#: Texts, and characters, scored at once.
ROWS, CHARS = 64, 1 << 18
#: Code points a piece of a text has at most.
PIECE = 8192
UNKNOWN = "und"
PLAIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (category L); numerals such as \u00b2, \u00bd or \u2460 are none."""
    return bool(PLAIN_LETTER.search(text)) or any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """One row a text, 1 in the slots of the n-grams it holds."""
    codes, offsets = code_points([t.lower() for t in texts])
    out = np.zeros((len(texts) + 1, SLOTS), np.float32)
    flat = out.reshape(-1)
    base = np.repeat(np.arange(len(texts), dtype=np.int64) * SLOTS, np.diff(offsets))
    for width, key in gram_hashes(codes, WIDTHS):
        at = base[: len(key)] + (key >> np.uint32(32 - SLOT_BITS))
        at[across(offsets, width, len(key))] = len(texts) * SLOTS  # a row that is thrown away
        flat[at] = 1
    return out[:-1]


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    own, other = x.sum(axis=1), landmarks.sum(axis=1)
    return (x @ landmarks.T) / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(np.maximum(other, 1))


def pieces_of(text: str) -> list[tuple[str, float]]:
    """Pieces of even size and their shares of the text; a piece reaches on to the ends of the n-grams that start in it."""
    n = -(-len(text) // PIECE) or 1
    cuts = [k * len(text) // n for k in range(n + 1)]
    return [(text[a : b + WIDTHS[-1] - 1], (b - a) / len(text) if text else 1.0) for a, b in zip(cuts, cuts[1:], strict=False)]


def embedded(texts: list[str]) -> np.ndarray:
    """One row a text, whose products with other rows are kernel values: the presence rows of its pieces, each of length 1, averaged by size."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    parts = [(i, *piece) for i, t in enumerate(texts) for piece in pieces_of(t.lower())]
    plain = [p for _, p, _ in parts]
    owner, share = np.array([i for i, _, _ in parts], np.int64), np.array([w for _, _, w in parts], np.float32)
    for a, b in slices_of(plain, ROWS, CHARS):
        rows = presence(plain[a:b])
        rows *= (share[a:b] / np.sqrt(np.maximum(rows.sum(axis=1), 1)))[:, None]
        first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        out[owner[a:b][first]] += np.add.reduceat(rows, first, axis=0)
    return out


def packed(texts: list[str]) -> list[bytes]:
    """The rows of embedded: bits for a text of one piece, float32 values for others."""
    out = []
    for a, b in slices_of(texts, ROWS, CHARS):
        for t, row in zip(texts[a:b], embedded(texts[a:b]), strict=True):
            out.append(np.packbits(row > 0).tobytes() if len(t.lower()) <= PIECE else row.tobytes())
    return out


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The rows of embedded from their packed form."""
    out = np.empty((len(rows), SLOTS), np.float32)
    for i, row in enumerate(rows):
        if len(row) == SLOTS // 8:
            bits = np.unpackbits(np.frombuffer(row, np.uint8))
            out[i] = bits / np.sqrt(max(1, np.count_nonzero(bits)))
        else:
            out[i] = np.frombuffer(row, np.float32)
    return out


class LanguageModel:
    """Packed landmarks and the matrix from kernel values to language outputs."""

    def __init__(self, languages: list[str], bits: list[bytes], weights: np.ndarray):
        self.languages, self.bits, self.weights = languages, bits, weights

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; texts that are null or have no letter are UNKNOWN with score 0. Of equal outputs the language with the most training rows wins."""
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not known:
            return names, scores
        if not hasattr(self, "landmarks"):
            self.landmarks = unpacked(self.bits)
        plain = [texts[i] for i in known]
        for a, b in slices_of(plain, ROWS, CHARS):
            out = SHARPNESS * ((embedded(plain[a:b]) @ self.landmarks.T) @ self.weights)
            out = np.exp(out - out.max(axis=1, keepdims=True))
            best = out.argmax(axis=1)
            for i, k, s in zip(known[a:b], best, out[np.arange(len(best)), best] / out.sum(axis=1), strict=True):
                names[i], scores[i] = self.languages[k], float(s)
        return names, scores

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "landmarks"}


def fit(docs: DataFrame, train: int = TRAIN, landmarks: int = LANDMARKS) -> LanguageModel:
    """Learn from text and lang of rows outside the evaluation fold.

    Rows with a null lang, a null text or a null doc_id teach nothing. Of each language the rows with the
    smallest hashes of doc_id are taken; a repeated doc_id counts once. Without any row the model knows no
    language and answers UNKNOWN. Landmarks are taken rank by rank over the languages, those with the smallest hashes first.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}  # a row a language
    if not counts:
        return LanguageModel([], [], np.empty((0, 0)))
    names, each = list(counts), max(2, train // len(counts))
    # hashes are even over 64 bits, so the `each` smallest lie below this bound but for a chance under 1e-9; what it lets through is few rows a language, whatever the table's size
    bounds = F.create_map(*(F.lit(x) for n, c in counts.items() for x in (n, int(-(2**63) + min(1.0, (3 * each + 60) / c) * (2**64 - 2**11)))))
    hashed = rows.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    few = hashed.where(F.col("h") <= bounds[F.col("lang")])
    chosen = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= each)
    chosen = chosen.groupBy("doc_id").agg(F.min("rank").alias("rank"), F.min("lang").alias("lang"))
    picked = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # `train` ids, or two a language

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                texts = batch.column("text").slice(a, ROWS).to_pylist()
                b = a + len(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("lang", "rank", "h")), pa.array(packed(texts), pa.binary())], ["lang", "rank", "h", "bits"])

    sample = staged(picked.select("lang", "rank", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text").mapInArrow(pack, "lang string, rank int, h long, bits binary"))
    marks = sample.orderBy("rank", "h").limit(landmarks).select("bits").collect()
    bits = [bytes(r["bits"]) for r in marks]

    def against(batches):
        held = unpacked(bits)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                k = unpacked(batch.column("bits").slice(a, ROWS).to_pylist()) @ held.T
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, len(k)) for c in ("lang", "rank", "h")), pa.array([r.astype(np.float32).tobytes() for r in k], pa.binary())], ["lang", "rank", "h", "k"])

    seen = sample.mapInArrow(against, "lang string, rank int, h long, k binary").orderBy("lang", "rank", "h").collect()
    k = np.stack([np.frombuffer(bytes(r["k"]), np.float32) for r in seen]).astype(np.float64)
    held, gram = unpacked(bits), np.zeros((len(bits), len(bits)))
    for at in range(0, SLOTS, 4096):  # in double precision, a part of the slots at a time
        part = held[:, at : at + 4096].astype(np.float64)
        gram += part @ part.T
    del held
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    features = k @ white
    target = np.where(np.asarray([r["lang"] for r in seen])[:, None] == np.asarray(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + RIDGE * len(seen) * np.eye(features.shape[1]), features.T @ target)
    return LanguageModel(names, bits, (white @ solved).astype(np.float32))


def predicted(text: Column, spark: SparkSession, model: LanguageModel) -> Column:
    """struct<lang_pred, score> of a text column."""
    held = spark.sparkContext.broadcast(model)  # LANDMARKS rows, and their weights for each language

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def work(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        model = held.value
        for at in range(0, len(texts), 256):
            more = model.score(texts.slice(at, 256).to_pylist())
            names += more[0]
            scores += more[1]
        vars(model).pop("landmarks", None)  # unpacked again by the next batch; the worker may serve other operators
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return work(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score a row of docs.

    Null texts and texts without a letter are UNKNOWN with score 0; repeated rows are answered each; a null
    doc_id is carried along and not held out; an empty table gives an empty table; other columns are ignored.
    """
    found = docs.select("doc_id", predicted(F.col("text"), docs.sparkSession, model).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
