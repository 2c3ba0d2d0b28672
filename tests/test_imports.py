import pytest

from strataloom.operators import incorporate, tags
from strataloom.sources import captures


def test_annotations_of_several_kinds(spark):
    accounts = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, None)], "id long, url_suffix string")
    posts = spark.createDataFrame([(1,), (7,)], "id long")
    known = spark.createDataFrame([(5, "Red", "colour"), (6, "red", "mood"), (7, "Big", None)], "id long, name string, tag_type string")
    entities = {
        "account": tags.Annotatable(accounts, spark.createDataFrame([(1, 7)], "entity_id long, tag_id long"), True),
        "post": tags.Annotatable(posts, spark.createDataFrame([], "entity_id long, tag_id long")),
    }
    rows = [
        (0, "account", "1", "big", None, None),  # there already
        (1, "POST ", " 1 ", "big", "", "seen"),
        (2, "post", "1", "BIG", None, None),  # asked for by the row before
        (3, "post", "ann", "red", None, None),  # no id, and two tags of this name
        (4, "account", "@ann", "red", "mood", ""),
        (5, "account", "9", "red", "size", None),
        (6, None, None, None, None, None),
        (7, "post", "-7", "big", None, None),
        (8, "account", "99999999999999999999", "big", None, None),
    ]
    asked = spark.createDataFrame(rows, "row long, entity_type string, entity string, tag string, tag_type string, notes string")
    got = {r["row"]: (r["entity_id"], r["tag_id"], r["notes"], r["status"], r["errors"]) for r in tags.annotations_import(asked, entities, known).collect()}
    assert got == {
        0: (1, 7, None, "exists", []),
        1: (1, 7, "seen", "added", []),
        2: (1, 7, None, "exists", []),
        3: (None, None, None, "error", ["an id is required", "tag is ambiguous"]),
        4: (1, 6, None, "added", []),
        5: (None, None, None, "error", ["entity not found", "tag not found"]),
        6: (None, None, None, "error", ["unknown entity type", "tag is required"]),
        7: (None, 7, None, "error", ["entity not found"]),
        8: (None, 7, None, "error", ["entity not found"]),
    }
    assert tags.annotations_import(asked.limit(0), entities, known).isEmpty()


def test_limits_of_an_import_file(spark, tmp_path):
    file = lambda name, data: (tmp_path / name).write_bytes(data) and str(tmp_path / name)
    good = file("a.csv", '﻿Tag , Notes\nx,"say ""hi"", y"\n\nz,\n'.encode())
    assert [tuple(r) for r in captures.imported(spark, good, ["tag", "notes", "more"], ["tag"]).collect()] == [("x", 'say "hi", y', ""), ("z", "", "")]
    with pytest.raises(ValueError, match="bytes"):
        captures.imported(spark, good, ["tag"], ["tag"], most=10)
    with pytest.raises(ValueError, match="UTF-8"):
        captures.imported(spark, file("b.csv", b"tag\n\xff\xfe\n"), ["tag"], ["tag"])
    assert captures.imported(spark, file("c.csv", b"name\n"), ["tag"], ["tag"]).isEmpty()


def test_values_come_back_by_name(spark):
    rows = spark.createDataFrame([(1, "7", "ann/", "old"), (2, "7", "ann", "new"), (3, "8", "ann", " "), (4, None, None, "lost"), (5, "", "bob", "b")], "ord int, id_on_platform string, url_suffix string, bio string")
    named = incorporate.values_by_name(rows, "bio", ["ord"])
    assert {tuple(r) for r in named.collect()} == {("id_7", "new"), ("url_ann", "new"), ("url_bob", "b")}
    seen = spark.createDataFrame([(1, "7", "x", None), (2, None, "bob/", ""), (3, "7", "bob", "own"), (4, None, None, None)], "canonical_id long, id_on_platform string, url_suffix string, bio string")
    filled = incorporate.with_named_values(seen, named, "bio")
    assert {r["canonical_id"]: r["bio"] for r in filled.collect()} == {1: "new", 2: "b", 3: "own", 4: None}
    canonical = spark.createDataFrame([(1, ""), (2, "kept"), (9, None)], "id long, bio string")
    done = incorporate.with_latest_observed(canonical, filled, "bio", ["canonical_id"])
    assert {tuple(r) for r in done.collect()} == {(1, "new"), (2, "kept"), (9, None)}


def test_addresses_under_an_alias(spark):
    rows = spark.createDataFrame([("m/a.jpg", "/srv/x/s1"), ("./b", "/srv/x/s2/"), (None, "/srv/x/s1"), ("c", None)], "local_url string, archive_location string")
    assert [r["local_url"] for r in incorporate.aliased(rows, "/srv/x/", "arch").collect()] == ["arch/s1/m/a.jpg", "arch/s2/b", None, "c"]
    with pytest.raises(Exception, match="outside"):
        incorporate.aliased(rows, "/srv/other", "arch").collect()
