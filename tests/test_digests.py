"""Hashes of files by ranges, and trees over many chunks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import integrity
from strataloom.sources import digests


def root(layer):
    while len(layer) > 1:
        layer = [hashlib.sha256(bytes.fromhex(layer[i] + layer[min(i + 1, len(layer) - 1)])).hexdigest() for i in range(0, len(layer), 2)]
    return layer[0]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, size in (("empty", 0), ("one", 10), ("exact", 64), ("big", 12_345)):
        (path / name).write_bytes(random.Random(size).randbytes(size))
    return path


def test_chunks_of_files_by_ranges(spark, folder):
    rows = digests.chunk_hashes(spark, str(folder), 16, 100)
    assert rows.rdd.getNumPartitions() > 100  # the large file is many tasks
    wanted = {}
    for f in folder.iterdir():
        data = f.read_bytes()
        wanted[f.name] = [hashlib.sha256(data[i : i + 16]).hexdigest() for i in range(0, max(1, len(data)), 16)]
    got = rows.collect()
    assert {(r["path"].rsplit("/", 1)[1], r["chunk"]): r["sha256"] for r in got} == {(n, k): h for n, hs in wanted.items() for k, h in enumerate(hs)}
    assert all(r["n_chunks"] == len(wanted[r["path"].rsplit("/", 1)[1]]) for r in got)
    roots = integrity.tree_roots(rows, "path").collect()
    assert {r["path"].rsplit("/", 1)[1]: r["root"] for r in roots} == {n: root(h) for n, h in wanted.items()}


def test_trees_of_several_rounds(spark):
    sizes = {"a": 1, "b": 2, "c": 1023, "d": 1024, "e": 1025, "f": 2049, "g": 5000}
    rows = spark.createDataFrame([(p, k, hashlib.sha256(f"{p}{k}".encode()).hexdigest()) for p, n in sizes.items() for k in range(n)], "path string, chunk long, sha256 string")
    got = {r["path"]: r["root"] for r in integrity.tree_roots(rows, "path").collect()}
    assert got == {p: root([hashlib.sha256(f"{p}{k}".encode()).hexdigest() for k in range(n)]) for p, n in sizes.items()}
    assert integrity.tree_roots(rows.limit(0), "path").count() == 0


def test_whole_files_against_a_manifest(spark, folder):
    files = digests.file_hashes(spark, str(folder)).withColumn("path", F.substring_index("path", "/", -1))
    own = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in folder.iterdir()}
    assert {r["path"]: (r["length"], r["sha256"]) for r in files.collect()} == {n: ((folder / n).stat().st_size, h) for n, h in own.items()}
    manifest = spark.createDataFrame([("one", own["one"]), ("big", own["one"]), ("gone", "x"), ("../one", own["one"])], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in integrity.manifest_check(manifest, files).collect()} == {"one": "pass", "big": "fail", "gone": "missing", "../one": "invalid_path"}
    assert [r["path"] for r in integrity.digest_list(files).collect()] == sorted(own)
    assert {r["status"] for r in integrity.verified_copy(files, files).collect()} == {"same"}
