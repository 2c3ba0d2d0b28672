"""Every query of the training-data operators over one small folder with awkward rows, its columns and its digests."""

import hashlib
import random
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strataloom.llm import bpe, queries
from tests.llm.helpers import AWKWARD, line_dedup, near_groups

LANGS = {"en": "the quick brown fox jumps over the lazy dog and runs away from there", "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft davon weg"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(90):
        lang = ("en", "de")[i % 2]
        words = LANGS[lang].split() + [f"{lang}{rng.randrange(40)}" for _ in range(12)]
        rng.shuffle(words)
        rows.append((100 + i, " ".join(words) + "\na line that many texts share", lang, f"s{i % 3}"))
    rows += [(300, rows[0][1], "en", "s0"), (301, rows[0][1] + " x", "en", "s0"), (302, rows[0][1].upper(), None, None)]
    rows += [(i, t, None, "odd") for i, t in AWKWARD] + [(8, AWKWARD[7][1], None, "odd")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(80)] + [(8, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = spark.createDataFrame([(1, "https://x/1", "<p>one"), (2, None, None), (None, "u", ""), (1, "https://x/1", "<p>one")], "page_id long, url string, html string")
    pages.write.parquet(f"{path}/pages.parquet")
    return path, rows


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder[0]).collect()


def ids_of(folder):
    return sorted(r[0] for r in folder[1])


def test_op1(spark, folder):
    unique = {i: t for i, t, _, _ in folder[1]}
    wanted = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in line_dedup(list(unique.items()))}
    rows = run(spark, folder, "op1_line_dedup")
    assert sorted(r["doc_id"] for r in rows) == ids_of(folder)
    assert all((r["n_lines"], r["n_dropped"], r["kept_sha256"]) == wanted[r["doc_id"]] for r in rows)


def test_op2(spark, folder):
    rows = run(spark, folder, "op2_mixing")
    assert len(rows) == len(folder[1]) and all(0 <= r["probability"] <= 1 for r in rows)
    assert len({r["kept"] for r in rows if r["doc_id"] == 8}) == 1


def test_op3(spark, folder):
    rows = run(spark, folder, "op3_pii_surrogates")
    assert {r["doc_id"]: r["text"] for r in rows} == {i: t for i, t, _, _ in folder[1]}  # nothing personal in them
    assert all(r["n_entities"] == 0 and r["kinds"] == [] for r in rows)


def test_op4(spark, folder):
    wanted = near_groups(list({i: t for i, t, _, _ in folder[1]}.items()), 4)
    rows = run(spark, folder, "op4_minhash_near_dedup")
    assert sorted(r["doc_id"] for r in rows) == ids_of(folder)
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (*wanted[r["doc_id"]], wanted[r["doc_id"]][1] == r["doc_id"]) for r in rows)


def test_op5(spark, folder):
    rows = run(spark, folder, "op5_fingerprints")
    assert sorted(r["doc_id"] for r in rows) == ids_of(folder)
    prints = {}
    for r in rows:
        prints.setdefault(dict((i, t) for i, t, _, _ in folder[1])[r["doc_id"]] or "", set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())


def test_op6(spark, folder):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    texts = {i: t or "" for i, t, _, _ in folder[1]}
    rows = run(spark, folder, "op6_bpe")
    assert sorted(r["doc_id"] for r in rows) == ids_of(folder)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op7(spark, folder):
    rows = run(spark, folder, "op7_warc_fixity")
    assert sorted((r["page_id"] or 0) for r in rows) == [0, 1, 1, 2]
    ends = sorted((r["archive"], r["start_offset"], r["end_offset"]) for r in rows)
    assert all(a[2] == b[1] for a, b in zip(ends, ends[1:], strict=False) if a[0] == b[0])


def test_op8(spark, folder):
    texts = {i: (t or "").encode() for i, t, _, _ in folder[1]}
    rows = run(spark, folder, "op8_audio_features")
    assert sorted(r["doc_id"] for r in rows) == ids_of(folder)
    features = {}
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == 44 + len(payload)  # payloads are of even length
        features.setdefault(raw, set()).add((r["media_sha256"], r["feature"]))
    assert all(len(f) == 1 for f in features.values())


def test_op9(spark, folder):
    rows = run(spark, folder, "op9_quality")
    assert sorted(r["doc_id"] for r in rows) == ids_of(folder)
    for r in rows:
        assert r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op10(spark, folder):
    texts = {i: t for i, t, _, _ in folder[1]}
    rows = run(spark, folder, "op10_language_id")
    assert sorted(r["doc_id"] for r in rows) == ids_of(folder)
    for r in rows:
        letters = any(map(str.isalpha, texts[r["doc_id"]] or ""))
        assert r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and (r["lang_pred"] in LANGS if letters else r["lang_pred"] == "und")
    assert all(r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] for r in rows if 100 <= r["doc_id"] < 190)


def test_stages_of_the_pipeline_on_awkward_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    odd = docs.unionByName(docs.where("doc_id < 105").selectExpr("cast(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars"))
    clash = odd.selectExpr("*", "'x' AS key", "1 AS n", "'y' AS size", "2 AS cell")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, folder[0])
        rows = out.collect()
        if name != "bpe":
            assert out.columns == clash.columns and len(rows) <= clash.count()
        assert stage(spark, clash.limit(0), folder[0]).count() == 0
    lines = corpus_pipeline.distinct_lines(spark, clash, folder[0])
    assert lines.where("doc_id IS NULL").count() == clash.where("doc_id IS NULL").count()
    single = corpus_pipeline.one_of_each_group(spark, clash, folder[0])
    # a repeated row stays as often as it is there, and so do rows without an id
    assert single.where("doc_id = 8").count() == 2 and single.where("doc_id IS NULL").count() == clash.where("doc_id IS NULL").count()
