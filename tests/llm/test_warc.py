import hashlib

from strataloom.llm import warc
from tests.llm.helpers import frame


def records(spark, rows):
    return spark.createDataFrame([(a, s, bytearray(p) if p is not None else None) for a, s, p in rows], "archive string, seq long, payload binary")


def rows(n, archives=("a", "b")):
    return [(archives[i % 10 == 0], i, f"record {i}".encode() * (1 + i % 3)) for i in range(n)]


def found(left, right):
    return {(r["archive"], r["seq"], r["status"]) for r in warc.audit(left, right).collect()}


def test_corruption_is_located(spark):
    left = rows(1500)
    right = [(a, s, b"x" + p[1:] if s == 700 else p + b"!" if s == 3 else p) for a, s, p in left if s not in (10, 1300)] + [("a", 9000, b"new")]
    one, two = warc.merkle_tree(records(spark, left)), warc.merkle_tree(records(spark, right))
    wanted = {("b", 700, "damaged"), ("a", 3, "damaged"), ("b", 10, "missing"), ("b", 1300, "missing"), ("a", 9000, "unexpected")}
    assert found(one, two) == wanted
    assert found(one, one) == set()
    assert {r["archive"] for r in warc.roots(one).join(warc.roots(two), ["archive", "root"], "left_anti").collect()} == {"a", "b"}


def test_ranges_and_leaves(spark):
    data = rows(600, ("a", "a"))
    end, wanted = 0, {}
    for _, s, p in data:
        wanted[s] = (end, end + len(p), hashlib.sha256(p).digest())
        end += len(p)
    got = {r["seq"]: (r["start"], r["end"], bytes(r["hash"])) for r in warc.leaves(records(spark, data)).collect()}
    assert got == wanted


def test_awkward_rows(spark):
    odd = [(None, None, None), (None, 1, b""), ("a", 1, b"x"), ("a", 1, b"x"), ("a", 1, b"y")]
    tree = warc.merkle_tree(records(spark, odd))
    assert tree[0].count() == 5 and found(tree, tree) == set()
    assert found(tree, warc.merkle_tree(records(spark, odd[1:]))) == {(None, None, "missing")}
    empty = warc.merkle_tree(records(spark, odd).limit(0))
    assert found(empty, empty) == set() and len(found(empty, tree)) == 3
    pages = frame(spark, [(1, None)]).selectExpr("doc_id AS page_id", "text AS html", "cast(NULL AS string) AS url")
    assert warc.page_replicas(pages)[0].count() == 1


def test_repeated_page_gives_a_row_a_record(spark, tmp_path):
    hit = next(i for i in range(5000) if hashlib.md5(str(i).encode()).hexdigest().startswith(warc.DAMAGED))
    pages = spark.createDataFrame([(hit, "u", "one"), (hit, "u", "two"), (hit + 1, "u", "x")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"], r["status"]) for r in warc.op7_warc_fixity(spark, str(tmp_path)).collect())
    assert got == [(hit, "damaged")] * 2 + [(hit + 1, "intact")]


def test_a_record_of_new_size_is_found_on_one_branch(spark):
    left = [("a", i, f"record {i}".encode()) for i in range(3000)]
    right = [(a, s, p + b"longer" if s == 5 else p) for a, s, p in left]
    one, two = warc.merkle_tree(records(spark, left)), warc.merkle_tree(records(spark, right))
    assert found(one, two) == {("a", 5, "damaged")}
    # a root, a node a level and one block, though all later records moved
    assert [d.count() for d in warc.descent(one, two)] == [1] * (warc.LEVELS + 1)
