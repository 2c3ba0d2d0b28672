"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import importance as I
from tests.llm.helpers import AWKWARD, frame, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(lower(text or ""))
    return words, [zlib.crc32(" ".join(g).encode()) % 10_000 for g in [*((w,) for w in words), *zip(words, words[1:], strict=False)]]


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) with distinct ids."""
    found = {i: features(t) for i, t in docs}
    corpus, wanted = Counter(b for _, f in found.values() for b in f), Counter(b for t in target for b in features(t)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000)))) for b in corpus}
    rows = {}
    for i, (_, f) in found.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows[i] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    fit = sorted((i for i in rows if len(found[i][0]) >= 20), key=lambda i: (-rows[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted((i, *r, rank.get(i)) for i, r in rows.items())


def shown(df):
    return [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()]


def test_against_a_plain_version(spark):
    texts = [f"{'the cat sat on' if i % 3 else 'Le chat est là'} " * (1 + i % 9) + f"WORD{i} x{i % 7}" for i in range(120)]
    docs = [(1000 + i, t) for i, t in enumerate(texts)] + AWKWARD
    target = ["the cat sat on the mat", None, "", "le chat"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    assert sorted(shown(I.resampled(frame(spark, docs).repartition(3), goal)), key=lambda r: r[0]) == plain(docs, target)


def test_repeated_missing_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(1, text), (1, text), (None, text), (2, None)] + [(10 + i, text) for i in range(8)]
    goal = spark.createDataFrame([("w1 w2",)], "text string")
    rows = shown(I.resampled(frame(spark, docs), goal))
    assert len(rows) == 12 and sorted(r[4] for r in rows if r[4]) == [1, 2]  # a quarter of eleven
    assert len({r[1:4] for r in rows if r[0] == 1}) == 1
    assert I.resampled(frame(spark, []), goal).count() == 0
    assert len(shown(I.resampled(frame(spark, docs), goal.limit(0)))) == 12


def test_ranks_over_many_ranges(spark):
    rows = spark.range(2000).selectExpr("id % 7 AS score", "id AS doc_id").repartition(9)
    got = sorted(I.ranked(rows, [I.F.desc("score"), I.F.asc("doc_id")], "rank").collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 2001))
    assert [(r["score"], r["doc_id"]) for r in got] == sorted(((i % 7, i) for i in range(2000)), key=lambda x: (-x[0], x[1]))


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), st.integers(1, 9))
def test_long_texts_are_read_in_pieces(text, size):
    whole = text.encode()
    words = [w for p in I.pieces_of(whole, size) for w in p.split()]
    assert words == [w.encode() for w in WORD.findall(lower(text))]
    kept, I.PIECE = I.PIECE, size
    try:
        stream, n = I.bucket_stream(whole, I.Spaced(3))
    finally:
        I.PIECE = kept
    assert n == len(words) and sorted(stream.tolist()) == sorted(features(text)[1])


def test_run_lengths():
    which, often = I.run_lengths(np.array([5, 3, 5, 5, 9999, 3], np.uint16))
    assert dict(zip(which.tolist(), often.tolist(), strict=True)) == {3: 2, 5: 3, 9999: 1}
    assert [len(x) for x in I.run_lengths(np.empty(0, np.uint16))] == [0, 0]
