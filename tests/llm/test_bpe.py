import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import bpe
from tests.llm.helpers import AWKWARD, frame


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = ["I'll say it's 123,456.78\n\n  ok \t x", "<|endoftext|>a<|endoftext|>", "naïve Ünïcödé 日本語 🙂‍🙂 　 x y", "a" * 700, "   ", "\r\n", "x​y \x85 z", "!!!???", "ⅷ² ٣"]


def test_against_the_library(spark, library):
    rng = random.Random(6)
    docs = AWKWARD + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(200 + k, "".join(rng.choice("ab 'sé日\n1.") for _ in range(200))) for k in range(20)]
    path = bpe.default_vocabulary()
    rows = bpe.digests(bpe.encode(frame(spark, docs), path, lexicon_size=50, decoded=True), "ids").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(dict(docs)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(frame(spark, AWKWARD).limit(0), bpe.default_vocabulary()).count() == 0


def test_decoding_alone(spark, library):
    rows = [(1, [15496, 995]), (2, None), (3, []), (4, [447, 50256])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", bpe.decode(F.col("ids"), bpe.default_vocabulary()).alias("t")).collect()}
    assert got == {i: None if ids is None else library.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_null_and_repeated_ids(spark, library):
    docs = [(None, "one two"), (1, "one two"), (1, "three"), (None, None)]
    rows = bpe.encode(frame(spark, docs), bpe.default_vocabulary()).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in rows) == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)


def test_frequent_words_fit(spark):
    docs = frame(spark, [(i, "the the cat " + "dog " * (i % 3) + f"w{i} " + "x" * 80) for i in range(30)])
    words = lambda size: {r["word"] for r in bpe.frequent_words(docs, size).collect()}
    assert words(50) == {"the", "cat", "dog"} and words(1) == {"the"} and words(0) == set()


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({b"tap", b"taps", b"top", b"tops", b"a", b"banana", b""})
    entries = [(w, [k, 7]) for k, w in enumerate(words)]
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(entries))
    held = bpe.Lexicon(str(tmp_path / "lexicon"))
    assert held.ordinals(words).tolist() == list(range(len(words)))
    assert held.ordinals([b"ta", b"tapsx", b"zzz"]).tolist() == [-1, -1, -1]
    # taps/tops and tap/top share their ends: t-(a|o)-p-s needs four states after the root, banana six more
    assert len(held.first) - 1 <= 11
    assert np.array_equal(held.ids[held.starts[2] : held.starts[3]], [2, 7])


def test_merges_of_many_pieces_at_once(library):
    rng = random.Random(7)
    vocabulary = bpe.vocabulary_of(bpe.default_vocabulary())
    texts = ["".join(rng.choice("aehinrst" if k % 2 else "aeé日🙂'1!") for _ in range(rng.choice([1, 2, 3, 8, 9, 16, 17, 33, 64, 65, 300]))) for k in range(1500)]
    pieces = ["", *texts, "a", "e" * 64, "e" * 65, "abab" * 16]
    flat, starts, lengths = vocabulary.merge_all([p.encode() for p in pieces])
    got = [flat[a : a + n].tolist() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    assert got == [vocabulary.merge(p.encode()) for p in pieces]
    assert vocabulary.merge_all([])[0].tolist() == []
    words = [k for k, p in enumerate(pieces) if p.isalpha()]
    assert len(words) > 700 and [got[k] for k in words] == [library.encode(pieces[k], add_special_tokens=False).ids for k in words]


def test_new_pieces_are_not_merged_one_by_one(library, monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary()), None)
    monkeypatch.setattr(encoder.vocabulary, "merge", lambda piece: pytest.fail("a short piece was merged alone"))
    monkeypatch.setattr(bpe, "TOGETHER", 64, raising=False)  # several parts
    monkeypatch.setattr(bpe, "MEMORY", 40)  # the later calls remember nothing more
    texts = [*TEXTS, *(f"anther{k} ethroin {'tion' * (k % 20)} x.{k}" for k in range(60)), ""]
    for at in [*range(0, len(texts), 8), 0]:
        some = texts[at : at + 8]
        flat, offsets = encoder.encode(some)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert len(encoder.number) == len(encoder.starts) == len(encoder.lengths) <= 40 and len(encoder.flat) == sum(encoder.lengths)
