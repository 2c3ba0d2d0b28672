import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import fingerprint as fp
from strataloom.llm.common import WordHashes
from tests.llm.helpers import AWKWARD, frame, shingles


def brute(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        n = len(a)
        out[i] = (n, hashlib.sha256((a[: n - n // 2] + b[: n // 2]).encode()).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in df.collect()}


def test_pairs_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fp, "PART_ROWS", 7)  # many ranges, so that successors cross them
    rng = random.Random(5)
    docs = [(i * 2, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    rows = fp.fingerprints(frame(spark, docs))
    assert found(rows) == brute(docs)
    by_id = {r["doc_id"]: r for r in rows.collect()}
    for i, t in docs:
        assert by_id[i]["fingerprint"] == fp.fingerprint(t, WordHashes()).hex()


def test_awkward_rows(spark):
    assert found(fp.fingerprints(frame(spark, AWKWARD))) == brute(AWKWARD)
    assert fp.fingerprints(frame(spark, AWKWARD).limit(0)).count() == 0
    one = fp.fingerprints(frame(spark, [(7, "a b c d e f")])).first()
    assert one["near_next"] == 1.0
    rows = fp.fingerprints(frame(spark, [(None, "x"), (1, "b"), (1, "a"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
        other = words[:300] + [f"w{i}" for i in rng.integers(0, 5000, 100)]
        a, b = " ".join(words), " ".join(other)
        x, y = shingles(a, 5), shingles(b, 5)
        errors.append(fp.likeness(fp.fingerprint(a, WordHashes()), fp.fingerprint(b, WordHashes())) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_densification_fills_every_bin():
    minima = fp.one_permutation(np.array([5, 99], np.uint64))
    assert len(set(minima.tolist())) == 2


def slow_print(text):
    """The fingerprint by the definition: a bin at a time, in Python's integers."""
    mask, memory = (1 << 64) - 1, WordHashes()

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    sets = []
    for shingle in shingles(text, fp.WORDS):
        total = len(shingle)
        for word in shingle:
            total = mix((total * 0x9E3779B97F4A7C15 + memory[word.encode()]) & mask)
        sets.append(mix(total ^ 0x5BD1E995CAFEF00D))
    if not sets:
        return ""
    bins = {}
    for h in sets:
        bins[h >> 56] = min(bins.get(h >> 56, mask), h & (1 << 56) - 1)
    digits = ""
    for i in range(fp.BINS):
        at, probe = i, 0
        while at not in bins:
            probe += 1
            at = mix((i * 0x9E3779B97F4A7C15 + probe * 0xD6E8FEB86659FD93) & mask) % fp.BINS
        digits += f"{mix(bins[at]) & 15:x}"
    return digits


def test_fingerprints_and_likeness_against_the_definition(spark):
    rng = random.Random(8)
    docs = AWKWARD + [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 5, 40, 900))))) for i in range(12)]
    rows = {r["doc_id"]: r for r in fp.fingerprints(frame(spark, docs)).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b, r = a or "", b or "", rows[i]
        edited = slow_print(a[: len(a) - len(a) // 2] + b[: len(a) // 2])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (slow_print(a), edited)
        for name, other in (("near_edited", edited), ("near_next", slow_print(b))):
            own = r["fingerprint"]
            if not own or not other:
                assert r[name] == float(own == other)
            else:
                same = sum(x == y for x, y in zip(own, other, strict=True)) / fp.BINS
                assert abs(r[name] - max(0.0, (same - 1 / 16) / (15 / 16))) < 1e-12


def test_parts_are_found_in_two_steps(spark):
    cuts = [3 * k for k in range(1, 40)]
    rows = spark.range(130).select("id", fp.part_of(F.col("id"), cuts).alias("p")).collect()
    assert [r["p"] for r in rows] == [sum(c < r["id"] for c in cuts) for r in rows]
