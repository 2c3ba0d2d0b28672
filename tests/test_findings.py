"""Inputs on which queries once differed from their SQL."""

import os
import random

import duckdb
import pytest

from strataloom.operators import hierarchy
from strataloom.plans import registry
from strataloom.sources import structures
from tests.compare import connect, same


def folder_of(path, lines: list[tuple[int, int, float, float]]) -> str:
    """A folder with the lines (order, line, quantity, price)."""
    rows = ", ".join(f"({o}::BIGINT, {n}::INTEGER, {q}::DOUBLE, {p}::DOUBLE)" for o, n, q, p in lines)
    duckdb.connect().execute(f"COPY (SELECT * FROM (VALUES {rows}) t(l_orderkey, l_linenumber, l_quantity, l_extendedprice)) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


def test_largest_files_are_ranked_as_the_sql_does(spark, tmp_path):
    # 4: the later line wins by its number though its price is a few cents less; 5: the earlier one, by more than that
    folder = folder_of(tmp_path, [(4, 1, 1, 100.05), (4, 7, 1, 100.0), (5, 1, 1, 100.08), (5, 7, 1, 100.0), (6, 2, 1, 50.0), (6, 3, 1, 49.995)])
    found = registry.QUERIES["capture_largest_files"](spark, folder)
    assert {r["id_on_platform"]: r["local_url"] for r in found.collect()} == {"4": "m/4/7", "5": "m/5/1", "6": "m/6/3"}
    same(found, connect(folder), registry.ORACLES["capture_largest_files"])


def test_coverage_rounds_as_the_sql_does(spark, tmp_path):
    # 24.5 and 25.5 go to the even neighbour
    folder = folder_of(tmp_path, [(1, 1, 24.5, 1), (2, 1, 25.5, 1), (2, 2, 3.7, 1), (3, 1, 24.6, 1), (3, 2, 9.2, 1), (4, 2, 0.4, 1)])
    for name in ("contiguous_coverage", "coverage_without_range"):
        found = registry.QUERIES[name](spark, folder)
        assert {r["l_orderkey"]: r["covered"] for r in found.collect()} == {1: 24, 2: 29, 3: 34, 4: 0}
        same(found, connect(folder), registry.ORACLES[name])


def test_equal_segments_after_a_gap_never_count(spark, tmp_path):
    folder = folder_of(tmp_path, [(k, 2, 5, 1) for k in range(300) for _ in range(3)])
    for name in ("contiguous_coverage", "coverage_without_range"):
        assert registry.QUERIES[name](spark, folder).where("covered <> 0 OR segments_used <> 0").count() == 0


def shuffle_bytes(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()))


def shared_files(spark) -> set[str]:
    return {f"{d}/{f}" for d, _, names in os.walk(spark.conf.get("spark.checkpoint.dir")) for f in names}


@pytest.mark.parametrize("name", ["capture_likes", "capture_accounts", "capture_largest_files", "capture_upsert"])
def test_no_checkpoints_and_no_shuffle_files_stay(spark, name):
    before, files = shuffle_bytes(spark), shared_files(spark)
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert shuffle_bytes(spark) - before < 200_000
    assert not [f for f in shared_files(spark) - files if "/rdd-" in f]


def test_likes_alone_stage_nothing(spark):
    files = shared_files(spark)
    registry.QUERIES["capture_likes"](spark, "/root/testdata/sf0.001")
    assert shared_files(spark) == files


def test_parts_of_one_entity_are_merged_over_both_keys(spark):
    """Rows that agree in both keys are merged first, then those that share one: values are the last, whatever pair they came with."""
    rows = spark.createDataFrame(
        [("s", "3", "1", "a/", "first", None), ("s", "5", "1", "b/", "", "bio"), ("s", "4", "1", "a/", "second", None), ("s", "1", None, "b/", "early", "old"), ("s", "2", "2", "c/", "other", None), ("t", "9", "1", "a/", "elsewhere", None), ("s", "6", None, None, "x", None), ("s", "7", None, None, "x", None), ("s", "8", None, None, "y", None)],
        "source string, at string, id_on_platform string, url_suffix string, display_name string, bio string",
    )
    found = structures.deduplicated({"accounts": rows})["accounts"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("s", "1", "b/", "second", "bio"), ("s", "2", "c/", "other", None), ("t", "1", "a/", "elsewhere", None), ("s", None, None, "x", None), ("s", None, None, "y", None)], key=str
    )


def test_reachability_searches_only_what_no_hub_explains(spark, monkeypatch):
    dice = random.Random(5)
    pairs = {(dice.randrange(60), dice.randrange(90)) for _ in range(110)} | {(200, 201), (201, 202), (202, 200), (300, 5)}
    edges = spark.createDataFrame(sorted(pairs), "super long, sub long")
    seeds = spark.createDataFrame([(k,) for k in [*range(70), 201, 300, 400, 5]], "id long")
    wanted = set()
    for root in [*range(70), 201, 300, 400]:
        todo = [root]
        while todo:
            if (root, x := todo.pop()) not in wanted:
                wanted.add((root, x))
                todo += [b for a, b in pairs if a == x]
    searched, plain = [], hierarchy.search

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        searched.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "search", counted)
    found = [tuple(r) for r in hierarchy.closure(edges, seeds, large=10).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert searched[-1] < len(wanted) / 3
    assert {tuple(r) for r in hierarchy.closure(edges, seeds).collect()} == wanted
