import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import language_id, quality
from tests.llm.helpers import AWKWARD, frame

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_of_held_out_rows(spark, docs):
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_long_texts_with_numbers(spark, docs):
    model, dice = language_id.fit(docs), random.Random(7)
    for lang in ("en", "de", "es", "fr"):
        words = [w for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(200).collect() for w in r["text"].split()]
        assert words
        for size in (20_000, 1_200_000):
            made, n = [], 0
            while n < size:
                made.append(f"{dice.getrandbits(64):x}" if dice.random() < 0.05 else str(dice.getrandbits(40)) if dice.random() < 0.05 else dice.choice(words))
                n += len(made[-1]) + 1
            names, scores = model.score([" ".join(made), "x"])
            print(lang, size, names[0], round(scores[0], 3))
            assert names[0] == lang and scores[0] > 0.6


def test_pieces_are_the_whole_text(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 10)
    text = "abcdefghijklmnopqrstuvwxyz" * 3
    pieces = language_id.pieces_of(text)
    assert max(len(p) for p, _ in pieces) <= 13 and sum(w for _, w in pieces) == pytest.approx(1)
    assert all(any(text[i : i + 4] in p for p, _ in pieces) for i in range(len(text) - 3))
    rows = [language_id.presence([p])[0] for p, _ in pieces]
    want = sum(w * r / np.sqrt(r.sum()) for (_, w), r in zip(pieces, rows, strict=True))
    got = language_id.embedded(["a", text, ""])
    assert np.allclose(got[1], want) and np.allclose(language_id.unpacked(language_id.packed(["a", text, ""])), got)


def test_kernel_against_sets():
    texts = ["abcab", "abc", "xyz abc", ""]
    got = language_id.kernel(language_id.presence(texts), language_id.presence(texts))
    grams = [{t[i : i + w] for w in language_id.WIDTHS for i in range(len(t) - w + 1)} for t in texts]
    want = [[len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5 for b in grams] for a in grams]
    assert np.abs(got - np.array(want)).max() < 0.01


def test_language_of_awkward_rows(spark, docs):
    model = language_id.fit(docs, train=80, landmarks=16)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(frame(spark, AWKWARD), model).collect()}
    assert len(got) == len(AWKWARD) and all(got[i] == ("und", 0.0) for i in (1, 2, 3, 10)) and got[6][0] in model.languages
    assert language_id.identify(frame(spark, AWKWARD).limit(0), model).count() == 0
    nothing = language_id.fit(frame(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, AWKWARD), nothing).collect()} == {"und"}


def test_labels_of_the_other_fold_teach_nothing(spark, docs):
    spoilt = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = language_id.fit(docs, train=80, landmarks=16), language_id.fit(spoilt, train=80, landmarks=16)
    assert a.languages == b.languages and np.allclose(a.weights, b.weights)


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.rated(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 900 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.98


def test_quality_of_awkward_rows(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels, sample=50)
    rows = {r["doc_id"]: r for r in quality.rated(frame(spark, AWKWARD), model).collect()}
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows.values()) and rows[1]["score"] == rows[2]["score"]
    assert quality.rated(frame(spark, AWKWARD).limit(0), model).count() == 0
    blank = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.rated(frame(spark, AWKWARD), blank).collect()} == {0.5}


def test_word_buckets_do_not_depend_on_the_slice():
    texts = ["alpha beta", "", "x", "beta  alpha\tbeta"]
    together, owner = quality.bucket_ids(texts)
    for i, t in enumerate(texts):
        assert sorted(together[owner == i].tolist()) == sorted(quality.bucket_ids([t])[0].tolist())
    words = quality.bucket_ids(["beta"])[0][0]
    assert (quality.bucket_ids(["alpha beta"])[0] == words).sum() >= 1


def test_numerals_are_no_letters():
    assert [language_id.has_letter(t) for t in ("²", "½", "①", "ⅷ", "12 _!", "", "a", "é", "ñ", "日", "ª", "²b")] == [False] * 6 + [True] * 6


def test_every_language_is_learned(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(98 + k // 26)} " * 30, f"l{k % 230}") for k in range(460)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train=460, landmarks=40)
    taught = {r[2] for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 4 != 2}
    assert set(model.languages) == taught and len(taught) > 200 and len(model.bits) == 40


def test_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "some words here", "en"), (1, "some words here", "en"), (1, "some words here", "en"), (2, None, "en"), (3, "andere worte dort", "de")], "doc_id long, text string, lang string")
    rows = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(rows) == 5 and all(not r["held_out"] for r in rows if r["doc_id"] is None)
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 1}) == 1
    scored = quality.rated(docs, quality.fit(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))).collect()
    assert len(scored) == 5 and len({r["score"] for r in scored if r["doc_id"] == 1}) == 1


def test_counts_beyond_16_bits_teach(spark, monkeypatch):
    """What descend is given holds the whole count, as plain counting has it."""
    held = []
    monkeypatch.setattr(quality, "descend", lambda rows: held.extend(rows) or quality.QualityModel(np.zeros(1, np.float32), 0.0))
    text = "word " * 70_000
    quality.fit(frame(spark, [(1, text), (3, "other")]), spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    ids, counts = np.unique(quality.bucket_ids([text])[0], return_counts=True)
    assert counts.max() > 65_535 and held[0][0].tolist() == ids.tolist() and held[0][1].tolist() == counts.tolist()
