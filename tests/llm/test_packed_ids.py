"""Packed id files: bits, random access, the library's own ids, awkward tables."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataloom.llm import packed_ids as P
from tests.llm.helpers import AWKWARD, frame

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't STOP", "a<|endoftext|>b <|ENDOFTEXT|>", "é ́x ﬁ ß µ ÀÉ×÷ ²½ \xa0\x85\x1c\x0b y", "Å ΑΣ Σ İ ı", "日本語 한국어 \U0001f642‍!", "'S 't'Re's", "x\ny\r\nz\tq", "12345 a1b2", "\xad­soft", "  \n \n"]


def library():
    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def wanted(docs, end=(1,)):
    start, out, encode = 0, [], library().encode
    for doc_id, text in docs:
        ids = [*encode(text or "", add_special_tokens=False).ids, *end]
        out.append((doc_id, start, len(ids), ids))
        start += len(ids)
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_bits_there_and_back(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    data = P.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert P.unpack(data, bits, len(ids)).tolist() == ids.tolist()


def test_bits_are_the_fewest():
    assert [P.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError, match="does not fit"):
        P.pack(np.array([8], np.uint32), 3)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("abcXYZ's!, \n\té123<|>"))), max_size=60))
def test_words_give_the_ids_of_the_whole_text(text):
    words = P.words_of_worker(VOCABULARY, 2)
    assert words.by_word
    ids, _ = words.encoded(P.pa.array([text]))
    assert ids.tolist() == library().encode(text, add_special_tokens=False).ids


def test_shard_reads_only_the_blocks_of_a_span(tmp_path):
    rng, bits, ids = random.Random(3), 11, None
    ids = np.array([rng.randrange(1 << bits) for _ in range(1000)], np.uint32)
    with open(tmp_path / "s", "wb") as f:
        shard = P.ShardWriter(f, bits, block=64)
        shard.add(np.array([5, 9]), np.array([False, False]), np.array([300, 0]), ids[:300])
        shard.add(np.array([12, 0]), np.array([False, True]), np.array([699, 1]), ids[300:])
        about = shard.close()
    assert about == {"n_docs": 4, "n_ids": 1000, "first": 5, "last": 12, "nulls": 1}
    with P.fs.LocalFileSystem().open_input_file(str(tmp_path / "s")) as f:
        read, got = P.Shard(f), []
        inner = read._read
        read._read = lambda at, size: got.append(size) or inner(at, size)
        for a, b in ((0, 1000), (63, 65), (64, 128), (999, 1000), (17, 17), (250, 700)):
            assert read.ids(a, b).tolist() == ids[a:b].tolist()
        assert got[1] == 2 * 64 * bits // 8 and got[2] == 64 * bits // 8  # two blocks, one block
        assert [len(read.document(k)) for k in range(4)] == [300, 0, 699, 1]


def test_folder_there_and_back(spark, tmp_path):
    docs = [(i, t) for i, t in AWKWARD] + [(100 + i, t) for i, t in enumerate(ODD)]
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    table = frame(spark, docs).repartition(3)
    P.write_packed(table, path, VOCABULARY)
    rows = sorted(map(tuple, P.read_packed(spark, path).collect()))
    assert rows == wanted(sorted(docs))
    few = sorted(map(tuple, P.read_packed(spark, path, doc_ids=[4, 7, 999]).collect()))
    assert few == [r for r in wanted(sorted(docs)) if r[0] in (4, 7)]
    sums = P.read_packed(spark, path, "ids_crc32 long, doc_id long").collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in sums} == {d: zlib.crc32(np.array(ids, "<u4").tobytes()) for d, _, _, ids in wanted(sorted(docs))}


def test_repeated_missing_and_no_rows(spark, tmp_path):
    docs = [(3, "b"), (None, "none"), (3, "b"), (1, "a a"), (None, None)]
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    P.write_packed(frame(spark, docs), path, VOCABULARY)
    rows = P.read_packed(spark, path, "doc_id long, start long, n_tokens long").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in sorted(rows, key=lambda r: r["start"])][:3] == [(1, 3), (3, 2), (3, 2)]
    assert sum(r["doc_id"] is None for r in rows) == 2 and max(r["start"] + r["n_tokens"] for r in rows) == 10
    empty = f"{tmp_path}/{uuid.uuid4().hex}"
    P.write_packed(frame(spark, []), empty, VOCABULARY)
    assert P.read_packed(spark, empty).count() == 0
    # a second write follows the first
    P.write_packed(frame(spark, [(9, "c")]), path, VOCABULARY, mode="append")
    assert P.read_packed(spark, path).where("doc_id = 9").first()["start"] == 10


def test_files_of_other_attempts_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    P.write_packed(frame(spark, [(1, "one"), (2, "two")]), path, VOCABULARY)
    shard = next(x for x in (tmp_path / path.rsplit("/", 1)[1]).iterdir() if x.suffix == ".ids")
    (shard.parent / "shard-lost.ids").write_bytes(shard.read_bytes())
    assert P.read_packed(spark, path).count() == 2


def test_ids_as_arrays_in_any_width(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    spark.dataSource.register(P.PackedIds)
    rows = spark.createDataFrame([(1, [5, 70_000]), (2, []), (3, [1])], "doc_id long, ids array<int>").coalesce(1)
    rows.write.format("packed_ids").option("bits", 17).mode("overwrite").save(path)
    assert sorted(map(tuple, P.read_packed(spark, path).collect())) == [(1, 0, 2, [5, 70_000]), (2, 2, 0, []), (3, 2, 1, [1])]


def test_long_texts_are_encoded_in_pieces():
    text = " ".join(f"w{i % 97}" for i in range(500)) + "\n" + "x" * 300 + " end"
    parts = list(P.cut_text(text, 100))
    assert "".join(parts) == text and len(parts) > 5
    words = P.words_of_worker(VOCABULARY, 2)
    assert np.concatenate([words.encoded(P.pa.array([p]))[0] for p in parts]).tolist() == library().encode(text, add_special_tokens=False).ids


def test_vocabularies_without_words_go_to_the_library():
    other = P.WordIds(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert not other.by_word
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, bounds = other.encoded(P.pa.array(["a b", "", "Ünï x"]))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in ("a b", "", "Ünï x")]
