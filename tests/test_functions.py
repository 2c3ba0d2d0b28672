import pytest
from pyspark.sql import functions as F

from strataloom.functions import fulltext
from strataloom.functions import normalize as n
from strataloom.functions.predicates import Searchable, ordering, page, predicate


def values(spark, rows, column):
    schema = "id int, " + ", ".join(f"c{i} string" for i in range(len(rows[0])))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schema)
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_identifiers(spark):
    rows = [(" a/?x=1 ",), ("a//",), ("",), ("None",), ("None/",), (None,)]
    assert values(spark, rows, n.url_suffix(F.col("c0"))) == ["a", "a", None, None, None, None]
    assert values(spark, rows, n.valid_identifier(F.col("c0"))) == [True, True, False, False, False, False]
    assert values(spark, [("123_456",), (" 9 ",), ("None",), (None,)], n.platform_id(F.col("c0"))) == ["123", "9", None, None]
    story = "stories/highlights/1/?story_media_id=9&z=1"
    assert values(spark, [(story,), ("p/x/?y=1",)], n.post_suffix(F.col("c0"))) == ["stories/highlights/1?story_media_id=9", "p/x"]
    assert values(spark, [(None, "https://x/stories/ann/77/"), ("5", "https://x/stories/ann/77/")], n.post_id(F.col("c0"), F.col("c1"))) == ["77", "5"]


def test_ids_made_of_parts(spark):
    c = [F.col(f"c{i}") for i in range(5)]
    assert values(spark, [(None, "p", "a"), ("x", "p", "a"), (None, None, "a")], n.like_id(*c[:3])) == ["p_a", "x", None]
    assert values(spark, [(None, "a", "b", None), (None, "a", "b", "follow"), (None, "a", None, None)], n.relation_id(*c[:4])) == ["a_b_", "a_b_follow", None]
    rows = [(None, "t", None, "p", "m"), (None, None, "ann/", "p", None), (None, "t", None, None, None)]
    assert values(spark, rows, n.tagged_id(*c)) == ["t_p_m", "url_ann/_p_", None]


def test_addresses(spark):
    rows = [("https://www.instagram.com/p/abc/?x=1",), ("instagram.com/ann",), ("@ann",), ("https://scontent-a.cdninstagram.com/v/f.jpg?q",), ("https://example.com/a",)]
    got = values(spark, rows, n.parsed_url(F.col("c0")))
    assert [g and (g["platform"], g["suffix"]) for g in got] == [("instagram", "p/abc"), ("instagram", "ann"), None, ("instagram", "f.jpg"), None]
    assert values(spark, [("https://x/y/f.jpg?q=1",)], n.cdn_filename(F.col("c0"))) == ["f.jpg"]
    assert values(spark, [("ann",), ("None",), ("",)], n.username_suffix(F.col("c0"))) == ["ann/", None, None]


def test_short_codes(spark):
    def code(i):
        out = ""
        while i > 0:
            i, d = divmod(i, 64)
            out = n.CODE_DIGITS[d] + out
        return out

    ids = [0, 1, 63, 64, 3141592653589793238, 2**62]
    assert values(spark, [(str(i),) for i in ids], n.shortcode(F.col("c0"))) == [code(i) for i in ids]


TABLE = Searchable({"a": "number", "t": "text", "d": "date"})


@pytest.fixture(scope="module")
def table(spark):
    return spark.sql("SELECT * FROM VALUES (1, 'A%b', timestamp'2020-01-01 10:00:00'), (2, 'ab', timestamp'2020-01-02 00:00:00'), (3, NULL, NULL) AS x(a, t, d)")


@pytest.mark.parametrize(
    ("rule", "wanted"),
    [
        ({"==": [{"var": "d"}, "2020-01-01T23:00:00Z"]}, [1]),
        ({"!=": [{"var": "t"}, "ab"]}, [1]),
        ({"in": ["a%", {"var": "t"}]}, [1]),
        ({"<": [1, {"var": "a"}, 3]}, [2]),
        ({">=": [1, {"var": "a"}, 3]}, [1, 2, 3]),
        ({"or": [{"and": [{">": ["a", 1]}, {"<": ["a", 3]}]}, {"==": ["t", "A%b"]}]}, [1, 2]),
    ],
)
def test_rules(table, rule, wanted):
    assert sorted(r["a"] for r in table.where(predicate(rule, TABLE)).collect()) == wanted


def test_bad_rules(table):
    with pytest.raises(ValueError):
        predicate({"==": ["secret", 1]}, TABLE)
    with pytest.raises(ValueError):
        predicate({}, TABLE)
    with pytest.raises(NotImplementedError):
        predicate({"!": [{"var": "a"}]}, TABLE)


def test_pages(table):
    order = ordering("nonsense", "upwards", TABLE, "a", "a")
    assert [r["a"] for r in page(table, order, 2, 2).collect()] == [1]


@pytest.mark.parametrize(
    ("query", "wanted"),
    [("alpha", [0, 1]), ("alpha beta", [0]), ("+alpha -beta", [1]), ("al*", [0, 1]), ('+"beta gamma"', [0]), ("  ", []), ("?!", []), ("été", [2]), ("-alpha", [])],
)
def test_word_search(spark, query, wanted):
    df = spark.createDataFrame([(0, "Alpha, beta gamma"), (1, "alpha_x alpha"), (2, "Été"), (3, None)], "id int, t string")
    found = df.where(fulltext.matches(fulltext.boolean_query(query), fulltext.tokens(F.col("t"))))
    assert sorted(r["id"] for r in found.collect()) == wanted
