"""The stored word index against splitting every row."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from strataloom.functions import fulltext
from strataloom.operators import wordindex as W
from strataloom.operators.search import Library, Request, found

QUERIES = ["a b", "+a -b", "a b -c", '"a b"', '+"a b c" d', "a*", "-a", "+ab* -\"b a\"", "", None, "zz", "é x_1", "a-b*"]


def texts(n=300):
    rng = random.Random(4)
    return [(i, " ".join(rng.choice(["a", "b", "c", "d", "ab", "abc", "É", "x_1"]) for _ in range(rng.randrange(0, 9)))) for i in range(n)] + [(n, None), (n + 1, "a " * 900 + "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "id long, text string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    block, W.BLOCK = W.BLOCK, 20
    yield W.index_of(spark, f"{tmp_path_factory.mktemp('words')}/i", docs, "id", fulltext.tokens(F.col("text")))
    W.BLOCK = block


@pytest.mark.parametrize("text", QUERIES)
def test_same_rows_as_splitting(docs, index, text):
    asked, words = fulltext.boolean_query(text), fulltext.tokens(F.col("text"))
    wanted = docs.where(fulltext.matches(asked, words)).select("id", fulltext.relevance(asked, words))
    assert sorted(map(tuple, index.matching(asked).collect())) == sorted(map(tuple, wanted.collect()))


def test_only_the_words_buckets_are_read(index):
    plan = index.matching(fulltext.boolean_query("+a +abc"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "PushedFilters: [In(term, [a,abc])]" in plan and "text" not in plan
    assert index.postings({"a"}).select("bucket").distinct().count() == 1


def plain_best(rows, words, k):
    import math

    counts = {i: {w: fulltext_words(t).count(w) for w in set(words)} for i, t in rows}
    df = {w: sum(c[w] > 0 for c in counts.values()) for w in set(words)}
    weight = {w: math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * n + 1))) for w, n in df.items() if n}
    scores = sorted((-sum(c[w] * v for w, v in weight.items()), i) for i, c in counts.items())
    return [(p + 1, i, -s) for p, (s, i) in enumerate([x for x in scores if x[0]][:k])]


def fulltext_words(text):
    return (text or "").lower().split()


@pytest.mark.parametrize(("words", "k"), [(["a"], 3), (["abc", "é", "abc"], 7), (["zz"], 5), (["a", "b", "c", "d", "ab"], 1000)])
def test_best_by_block_bounds(index, words, k):
    assert list(map(tuple, index.best(words, k).collect())) == plain_best(texts(), words, k)


def test_batches(spark, tmp_path):
    words = fulltext.tokens(F.col("text"))
    rows = spark.createDataFrame([(1, "a b"), (2, "b"), (None, "b")], "id long, text string")
    index = W.WordIndex(spark, f"{tmp_path}/{uuid.uuid4().hex}")
    assert index.batches() == {}
    index.add(rows, "id", words, 0)
    index.add(spark.createDataFrame([(2, "changed b"), (3, "b b")], "id long, text string"), "id", words)
    index.add(spark.createDataFrame([(9, "b")], "id long, text string"), "id", words, 1)  # that batch is complete
    assert index.batches() == {0: 2, 1: 1}
    assert sorted(map(tuple, index.matching(fulltext.boolean_query("b")).collect())) == [(1, 1), (2, 1), (3, 2)]
    # a batch whose last write is missing does not exist, and is written anew
    spark.createDataFrame([(0, "x", 0, 1, 1, [7], [1], [[0]])], "bucket int, term string, block int, n long, most int, ids array<long>, counts array<int>, places array<array<int>>").write.partitionBy("bucket").parquet(f"{index.path}/postings/batch=2")
    assert index.all_postings().where("term = 'x'").count() == 0
    index.add(spark.createDataFrame([(7, "y")], "id long, text string"), "id", words, 2)
    assert index.all_postings().where("batch = 2").select("term").collect() == [("y",)]
    empty = W.WordIndex(spark, f"{tmp_path}/{uuid.uuid4().hex}").add(rows.limit(0), "id", words)
    assert empty.matching(fulltext.boolean_query("b")).count() == 0 and empty.best(["b"], 3).count() == 0


def test_search_finds_the_same_with_and_without_an_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ann", "instagram", "Ann", "likes tea", ["url_ann/"]), (2, "bob", "instagram", "Bob", "ann and tea tea", []), (3, "cy", "instagram", "Cy", None, ["url_ann"])], "id long, url_suffix string, platform string, display_name string, bio string, identifiers array<string>")
    from strataloom.operators.search import MODES, indexed

    index = W.index_of(spark, f"{tmp_path}/{uuid.uuid4().hex}", rows, "id", indexed(MODES["accounts"]))
    for term in ("@ann", "tea", "ann tea", "tea -ann", None):
        both = [[tuple(r) for r in found(Request("accounts", term), Library(rows, rows, rows, rows, rows, indexes=i)).drop("identifiers").collect()] for i in ({}, {"accounts": index})]
        assert both[0] == both[1]
