import hashlib

import pytest
from pyspark.sql import functions as F

from strataloom.functions.predicates import Searchable, ordering
from strataloom.operators import enrich, graph, integrity, lookup, maintenance, media, reconcile, sinks, skew, tags
from strataloom.operators.search import Library, Request, address_of, handle_of, results


def test_terms_that_are_addresses_or_names():
    assert address_of(" https://www.instagram.com/ann/?hl=en ") == ("instagram", "ann")
    assert address_of("scontent-1.cdninstagram.com/v/a/f.jpg?x=1") == ("instagram", "a/f.jpg")
    assert [address_of(t) for t in (None, "", "ann", "https://example.com/ann", "instagram.com/")] == [None] * 5
    assert [handle_of(t) for t in ("@ann_b", "ann/p/1", "ann?x", "a" * 31, "two words", "www.ann", "ann.b", None, "@")] == ["ann_b", "ann", "ann", None, None, None, None, None, None]


@pytest.fixture(scope="module")
def library(spark):
    accounts = spark.createDataFrame([(0, "ann", "instagram", "Ann", "likes tea", ["url_ann/"]), (1, "bob", "instagram", "Bob", None, ["url_bob", "url_old"])], "id long, url_suffix string, platform string, display_name string, bio string, identifiers array<string>")
    posts = spark.createDataFrame([(5, "p/x", "instagram", "p5", "c" * 120, None, 0), (6, None, "instagram", "p6", None, None, None)], "id long, url_suffix string, platform string, id_on_platform string, caption string, publication_date timestamp, account_id long")
    files = spark.createDataFrame(
        [("m1", "v/m1", "instagram", "a cat", "", "local/m1", "image", None, 5, 0), ("m2", "v/m2", "instagram", "a cat", "t/m2", "local/m2", "video", None, 5, 0), ("m3", "v/m3", "instagram", None, None, None, "image", None, 6, None)],
        "media_key string, url_suffix string, platform string, annotation string, thumbnail_path string, local_url string, media_type string, publication_date timestamp, post_id long, account_id long",
    )
    sessions = spark.createDataFrame([(9, None, "instagram", None, None)], "id long, url_suffix string, platform string, notes string, archived_at timestamp")
    seen = spark.createDataFrame([(9, "m1")], "session_id long, media_key string")
    return Library(accounts, posts, files, sessions, seen)


def ids(request, library):
    return [r["id"] for r in results(request, library).orderBy("place").collect()]


def test_search(library):
    assert ids(Request("accounts"), library) == ["1", "0"]
    assert ids(Request("accounts", "https://www.instagram.com/old/"), library) == ["1"]
    assert ids(Request("accounts", "@ann"), library) == ["0"] and ids(Request("accounts", "tea likes"), library) == ["0"]
    # a filter holds whatever the term's own alternatives are
    assert ids(Request("accounts", "@ann", {"==": [{"var": "id"}, 1]}), library) == []
    assert ids(Request("accounts", sort_by="url", sort_order="asc"), library) == ["1", "0"] and ids(Request("accounts", sort_by="url_suffix", sort_order="Asc"), library) == ["0", "1"]
    assert ids(Request("accounts", None, {"==": [{"var": "url"}, "ann"]}), library) == ["0"]
    assert ids(Request("media", "cat"), library) == ["m2", "m1"] and ids(Request("media", "https://scontent.cdninstagram.com/v/v/m3"), library) == ["m3"]
    assert ids(Request("archive_sessions"), library) == ["9"] and ids(Request("all"), library) == [] and ids(Request("posts", page_number=3), library) == []
    by_id = {r["id"]: r for r in results(Request("posts"), library).collect()}
    assert by_id["5"]["details"] == "c" * 100 + "..." and by_id["5"]["thumbnails"] == ["local/m1", "t/m2"] and by_id["5"]["title"] == "https://www.instagram.com/p/x"
    assert (by_id["6"]["title"], by_id["6"]["thumbnails"], by_id["6"]["metadata"]["account_url"]) == ("item p6", [], None)
    session = results(Request("archive_sessions"), library).first()
    assert (session["title"], session["thumbnails"], session["metadata"]["media_count"]) == ("Archive Session 9", ["local/m1"], "1")


def test_orders(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 4)], "id long, n long")
    table = Searchable({"n": "number"})
    got = lambda *a: [r["id"] for r in df.orderBy(*ordering(*a, table, F.col("id").asc(), "id")).collect()]
    assert got("n", "ASC") == [2, 3, 1] and got("n", None) == [1, 3, 2] and got("x", "desc") == [1, 2, 3]


def test_lookups(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "a", None)], "id long, id_on_platform string, url_suffix string")
    assert lookup.one(rows, id_=1).first()["id"] == 1 and lookup.one(rows, id_on_platform="a").first()["id"] == 0
    assert lookup.one(rows, url_suffix="zz").isEmpty() and lookup.one(rows).isEmpty()
    assert lookup.exists(rows, 0) and not lookup.exists(rows, 7)
    assert [r["id"] for r in lookup.keyset_page(rows, "id", None, 1).collect()] == [0]
    types = spark.createDataFrame([(1, "b", None), (2, "a", '["post"]')], "id long, name string, affinity string")
    assert [(r["name"], r["affinity"]) for r in lookup.tag_types(types).collect()] == [("a", ["post"]), ("b", None)]


def test_hash_tree_of_digests(spark):
    def root(data, size):
        layer = [hashlib.sha256(data[i : i + size]).digest() for i in range(0, max(len(data), 1), size)]
        while len(layer) > 1:
            layer += layer[-1:] * (len(layer) % 2)
            layer = [hashlib.sha256(a + b).digest() for a, b in zip(layer[::2], layer[1::2], strict=True)]
        return layer[0].hex()

    files = {f"f{n}": bytes(range(n)) for n in (0, 1, 4, 5, 9, 12, 17, 33)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r["path"]: r["root"] for r in integrity.tree_roots(integrity.chunk_hashes(df, "path", "content", 4), "path").collect()}
    assert got == {k: root(v, 4) for k, v in files.items()}
    assert {r["status"] for r in integrity.verified_copy(df, df).collect()} == {"same"}
    assert [r["path"] for r in integrity.digest_list(df).collect()] == sorted(files)


def test_merges():
    assert reconcile.deep_merge({"l": [1, 2]}, {"l": [2, 1, 1]}) == {"l": [1, 2]}
    assert reconcile.deep_merge({"a": [], "b": ""}, {"c": {}}) == {"a": [], "b": "", "c": {}}
    assert reconcile.deep_merge({"a": "", "b": 0}, {"a": [], "b": 5}) == {"a": None, "b": 0}


def test_segments(spark):
    rows = [("a", "f", None, None, b"abc"), ("a", "f", 2, 5, b"cdef"), ("a", "f", 9, 9, b"z"), ("b", "g", 4, 5, b"xx")]
    parts = spark.createDataFrame(rows, "asset_id string, filename string, start long, end long, content binary")
    assert {r["asset_id"]: bytes(r["content"]) for r in media.joined_assets(parts).collect()} == {"a": b"abcdef", "b": b""}
    assert sorted((r["offset"], bytes(r["piece"])) for r in media.asset_pieces(parts).collect()) == [(0, b"abc"), (3, b"def")]
    efg = "efg=eyJ4cHZfYXNzZXRfaWQiOiAiNDIifQ"
    manifest = f"<MPD><BaseURL>https://x/v/a.mp4?q=1&amp;{efg}&amp;z=2</BaseURL><BaseURL>https://x/b.mp4</BaseURL></MPD>"
    variants = spark.createDataFrame([(2, "https://x/v/a.mp4?x", None, "9"), (1, "https://x/v/a.mp4?y", manifest, "8"), (3, f"https://x/c.mp4?{efg}", None, "7"), (4, "https://x/d.mp4", None, None)], "ord int, url string, manifest string, pk string")
    names = media.named_assets(variants)
    assert {r["filename"]: r["asset_id"] for r in names.collect()} == {"a.mp4": "42", "c.mp4": "42"}
    loose = spark.createDataFrame([(None, "a.mp4"), (None, "zz.mp4"), ("5", "a.mp4")], "asset_id string, filename string")
    fixed = media.reconciled(loose, names)
    assert sorted((r["filename"], r["asset_id"] or "") for r in fixed.collect()) == [("a.mp4", "42"), ("a.mp4", "5"), ("zz.mp4", "")]
    assert {r["key"] for r in media.accumulated(fixed).collect()} == {"42/a.mp4", "5/a.mp4", "file:zz.mp4"}


def test_verified_flags_and_dismissals(spark):
    rows = [(0, '{"is_verified": true}'), (1, '{"is_verified": "true"}'), (2, "no json"), (3, None), (4, "[1]"), (5, '{"is_verified": null}'), (6, '{"is_verified": false}')]
    got = {r["id"]: r["v"] for r in spark.createDataFrame(rows, "id int, d string").select("id", graph.verified(F.col("d")).alias("v")).collect()}
    assert got == {0: True, 1: None, 2: None, 3: None, 4: None, 5: None, 6: False}
    lists = spark.createDataFrame([(1, '[{"id": 4, "url_suffix": "x"}, {"url_suffix": "y"}]'), (2, "[{"), (3, '{"id": 4}'), (4, None)], "id long, community_dismissals string")
    assert [(r["tag_id"], r["id"]) for r in graph.dismissed(lists).collect()] == [(1, 4)]
    new = spark.createDataFrame([(8, "u", None)], "id long, url_suffix string, display_name string")
    assert [(r["tag_id"], r["id"]) for r in graph.dismissed(graph.with_dismissals(lists, 2, new)).orderBy("tag_id").collect()] == [(1, 4), (2, 8)]


def test_ties_of_every_kind(spark):
    relations = spark.createDataFrame([(1, 2, "follower"), (1, 3, None), (1, 4, "suggested"), (1, 1, "x")], "follower_id long, other_id long, kind string")
    likes = spark.createDataFrame([(10, 5), (11, 5), (10, None)], "post_id long, account_id long")
    comments = spark.createDataFrame([(10, 6)], "post_id long, account_id long")
    posts = spark.createDataFrame([(10, 1), (11, None)], "id long, account_id long")
    files = spark.createDataFrame([("m", 7)], "media_key string, account_id long")
    tagged = spark.createDataFrame([(8, 10, None), (8, None, "m")], "tagged_account_id long, post_id long, media_key string")
    got = {tuple(r) for r in graph.ties(relations, likes, posts, comments, tagged, files).collect()}
    assert got == {(1, 2, "follow"), (1, 3, "follow"), (1, 4, "suggested"), (5, 1, "like"), (6, 1, "comment"), (1, 8, "tag"), (7, 8, "tag")}


def test_tag_import(spark):
    rows = [
        (0, " Cats ", "animal", None, "yes", "Pets| Animals"),
        (1, "Pets", "ANIMAL", "d", "", "Animals|nowhere"),
        (2, "cats", "animal", None, "", ""),
        (3, "a,b", None, None, "maybe", ""),
        (4, "", None, None, None, None),
        (5, "Lions", "plant", None, "0", ""),
        (6, "Animals", "animal", None, "", "Cats|Animals"),
    ]
    parsed = tags.tag_rows(spark.createDataFrame(rows, "row long, name string, tag_type string, description string, quick_access string, parents string"))
    assert [r["quick_access"] for r in parsed.orderBy("row").collect()] == [True, False, False, False, False, False, False]
    known = spark.createDataFrame([(7, "animals", "animal")], "id long, name string, tag_type string")
    types = spark.createDataFrame([("animal",)], "name string")
    edges = spark.createDataFrame([], "super long, sub long")
    out = tags.import_tags(parsed, known, types, edges)
    assert [(r["row"], r["tag_id"], r["status"], len(r["errors"])) for r in out.rows.orderBy("row").collect()] == [
        (0, 8, "created", 0), (1, 9, "created", 0), (2, 8, "existing", 0), (3, None, "error", 2), (4, None, "error", 1), (5, None, "error", 1), (6, 7, "existing", 0),
    ]
    assert {(r["row"], r["parent"], r["status"]) for r in out.relations.collect()} == {(0, "Pets", "added"), (0, "Animals", "added"), (1, "Animals", "added"), (1, "nowhere", "parent_not_found"), (6, "Cats", "cycle"), (6, "Animals", "cycle")}
    assert {tuple(r) for r in out.edges.collect()} == {(9, 8), (7, 8), (7, 9)} and out.tags.count() == 3


def test_displays_and_redaction(spark):
    assert enrich.Display.of({}) == enrich.Display() and enrich.Display.of({"strip_raw_data": "no"}).raw_data
    held = spark.createDataFrame([(1, [("har", "a"), ("video", "b")])], "id int, attachments array<struct<kind: string, path: string>>")
    row = enrich.without_attachments(held, "attachments", ["video", "other"]).first()
    assert row["withheld"] == ["video"] and [a["path"] for a in row["attachments"]] == ["a"]


def box(kind, body, size=None):
    return (len(body) + 8 if size is None else size).to_bytes(4) + kind + body


def test_broken_files(spark):
    whole, cut, long = box(b"ftyp", b"x") + box(b"mdat", b"yy"), box(b"mdat", b"yy", 99), b"\0\0\0\1mdat" + (99).to_bytes(8)
    files = [("w", whole), ("c", cut), ("l", long), ("e", b""), ("z", box(b"mdat", b"yy", 0)), ("s", b"\0\0\0\1mdat")]
    got = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    assert {r["path"]: r["s"] for r in got.select("path", maintenance.cut_short("content").alias("s")).collect()} == {"w": False, "c": True, "l": True, "e": False, "z": False, "s": True}
    names = ["xpv_12.mp4", "xpv_12_full.mp4", "track_9_a_video.mp4", "7.mp4", ".mp4"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k")
    assert [r[0] for r in df.select(maintenance.file_asset_id(F.col("n"))).collect()] == ["12", "12", "9", "7", None]
    sessions = spark.createDataFrame([(1, "done"), (2, "done"), (3, "pending")], "id long, status string")
    seen = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "session_id long, media_key string")
    held = spark.createDataFrame([("a", "w"), ("b", "gone")], "media_key string, local_url string")
    assert {tuple(r) for r in maintenance.broken_sessions(sessions, seen, held, got).collect()} == {(1, "done"), (2, "parsed"), (3, "pending")}


def test_store_saves_all_or_none(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "store"))
    store.save(a=spark.range(3), b=spark.range(2))
    store.save(a=store.load("a").where("id > 0"))
    assert store.load("a").count() == 2 and store.load("b").count() == 2
    again = sinks.Store(spark, str(tmp_path / "store"))
    with pytest.raises(Exception):
        again.save(a=spark.range(9), b=spark.range(1).select(F.raise_error(F.lit("no")).alias("id")))
    assert store.load("a").count() == 2


def test_heavy_keys_join_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(skew, "LIGHT", 10)
    monkeypatch.setattr(skew, "HEAVY", 4)
    rows = spark.createDataFrame([(0 if i < 60 else i, i) for i in range(100)] + [(None, 7)], "k long, v long")
    values = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    got = {(r["k"], r["v"], r["n"], r["least"]) for r in skew.join_values(rows, values, "k", "n", 100).collect()}
    assert got == {(r["k"], r["v"], r["n"], r["least"]) for r in rows.join(values, "k").collect()} and len(got) == 100
    heavy = skew.heavy_hashes(values, "k", "n", 100)
    assert len(heavy) == 1
    parts = skew.salted(rows, heavy, "k", F.col("v"))
    met = parts.join(skew.replicated(values, heavy, "k"), ["k", "salt"])
    assert met.count() == 100 and parts.where("k = 0").select("salt").distinct().count() > 10
