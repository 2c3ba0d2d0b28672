import json

import pytest
from pyspark.sql import functions as F

from strataloom.operators import incorporate as inc
from strataloom.operators.lineage import checkpointed
from strataloom.sources import captures, structures
from strataloom.streaming.incremental import Progress

ANN, BOB, CY = ({"pk": str(k), "id": str(k), "username": n, "full_name": n.title()} for k, n in ((7, "ann"), (8, "bob"), (9, "cy")))
POST = {"pk": "100", "id": "100_7", "code": "Bk", "taken_at": 60, "user": ANN, "image_versions2": {"candidates": [{"url": "https://x/v/a.jpg?q"}]}, "usertags": {"in": [{"user": BOB, "position": [0.5, 0.25]}]}}


def entry(url, body, mime="application/json", **variables):
    posted = {"postData": {"params": [{"name": "variables", "value": json.dumps(variables)}]}} if variables else {}
    return {"request": {"method": "GET", "url": url, "headers": [], **posted}, "response": {"status": 200, "headers": [], "content": {"mimeType": mime, "text": body if isinstance(body, str) else json.dumps(body)}}}


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("har")
    comment = {"pk": "c1", "text": "nice", "created_at": 90, "parent_comment_id": "c0", "user": BOB}
    page = '<script type="application/json">' + json.dumps({"require": [{"x": {"xdt_api__v1__media__shortcode__web_info": {"items": [POST]}}}, {"xdt_api__v1__media__media_id__comments__connection": {"edges": [{"node": comment | {"pk": "c3"}}]}}]}) + "</script>"
    har = [
        entry("https://x/api/v1/media/100/info/", {"items": [POST]}),
        entry("https://x/graphql", {"data": {structures.COMMENTS: {"edges": [{"node": comment}]}}}, media_id="100"),
        entry("https://x/api/v1/media/100/comments/", {"comments": [comment | {"pk": "c2"}]}),
        entry("https://x/graphql", {"data": {structures.LIKERS: {"users": [CY]}}}, media_id="100"),
        entry("https://x/api/v1/media/100/likers/", {"users": [BOB, CY]}),
        entry("https://x/api/v1/friendships/7/followers/", {"users": [BOB]}),
        entry("https://x/graphql", {"data": {structures.CHAINING: {"users": [CY]}}}, target_id="7"),
        entry("https://x/graphql", {"data": {"user": ANN | {"biography": "b" * 300}}}),
        entry("https://x/p/Bk/", page, "text/html"),
        entry("https://x/graphql", "no json"),
    ]
    (folder / "s1.har").write_text(json.dumps({"log": {"entries": har}}))
    return captures.routed(captures.har_entries(spark, str(folder)))


@pytest.fixture(scope="module")
def streams(spark, entries):
    source = entries.first()["source"]
    files = spark.createDataFrame([(source, "photos/a.jpg"), (source, "photos/z.jpg")], "source string, path string")
    return structures.session_entities(entries, files)


def test_a_capture_gives_seven_streams(streams):
    rows = {n: d.collect() for n, d in streams.items()}
    assert set(rows) == set(structures.IDENTITIES)
    assert {(r["id_on_platform"], r["url_suffix"], r["display_name"], r["bio"] and len(r["bio"])) for r in rows["accounts"]} == {("7", "ann/", "Ann", 200), ("8", "bob/", "Bob", None), ("9", "cy/", "Cy", None)}
    assert [(r["id_on_platform"], r["url_suffix"], r["account_id"]) for r in rows["posts"]] == [("100", "p/Bk", "7")]
    assert [(r["id_on_platform"], r["local_url"]) for r in rows["media"]] == [("100_7", "photos/a.jpg")]
    assert {(r["id_on_platform"], r["post_id"], r["parent_id"], r["url_suffix"]) for r in rows["comments"]} == {("c1", "100", "c0", "p/Bk/c/c1/"), ("c2", "100", None, "p/Bk/c/c2/"), ("c3", "100", "c0", "p/Bk/c/c3/")}
    assert {r["id_on_platform"] for r in rows["likes"]} == {"100_8", "100_9"}
    assert {(r["follower_id"], r["followed_id"], r["kind"]) for r in rows["account_relations"]} == {("8", "7", "follower"), ("7", "9", "suggested")}
    assert [(r["tagged_account_id"], r["x"], r["y"]) for r in rows["tagged_accounts"]] == [("8", 0.5, 0.25)]


def test_rows_find_what_they_lie_under(streams):
    under = structures.nested_sessions(streams)
    assert [r["account"] for r in under["posts"].collect()] == ["7"]
    assert {r["post"] for n in ("media", "comments", "likes", "tagged_accounts") for r in under[n].collect()} == {"100"}
    assert {(r["kind"], r["account"]) for r in under["account_relations"].collect()} == {("follower", "8"), ("suggested", "7")}


def test_nothing_captured(spark, entries):
    files = spark.createDataFrame([], "source string, path string")
    out = structures.session_entities(entries.limit(0), files)
    assert all(d.isEmpty() for d in out.values())


def prepared(streams):
    """The streams as rows to be incorporated: session and order from the source and the content."""
    out = {}
    for name, d in streams.items():
        d = d if "url_suffix" in d.columns else d.withColumn("url_suffix", F.lit(None).cast("string"))
        d = d if name != "media" else d.drop("url")
        order = F.abs(F.xxhash64(F.to_json(F.struct(*d.columns)))) % (1 << 39)
        out[name] = d.withColumn("session", F.lit("s1")).withColumn("ord", order).withColumn("url_suffix", F.regexp_replace("url_suffix", "/+$", ""))
    return out


def stores(spark):
    return {n: inc.empty_store(spark, e, inc.VALUE_TYPES) for n, e in inc.ENTITIES.items()}


def test_seven_types_are_incorporated(spark, streams):
    rows = prepared(streams)
    stray = rows["posts"].withColumn("id_on_platform", F.lit("500")).withColumn("url_suffix", F.lit("p/zz")).withColumn("account_id", F.lit("none")).withColumn("account_url_suffix", F.lit("none")).withColumn("ord", F.lit(3).cast("long"))
    lost = rows["likes"].withColumn("post_id", F.lit("777")).withColumn("post_url_suffix", F.lit(None).cast("string")).withColumn("id_on_platform", F.concat(F.lit("777_"), "account_id"))
    rows |= {"posts": rows["posts"].unionByName(stray), "likes": rows["likes"].unionByName(lost)}
    out, aside = inc.incorporate_all(stores(spark), rows)
    assert {n: d.canonical.count() for n, d in out.items()} == {"accounts": 3, "posts": 1, "media": 1, "comments": 3, "likes": 2, "tagged_accounts": 1, "account_relations": 2}
    assert [tuple(r) for r in aside.collect()] == [("posts", "s1", 3, "account_id is unknown")]
    account = {r["id_on_platform"]: r["id"] for r in out["accounts"].canonical.collect()}
    post = out["posts"].canonical.first()
    assert post["account_id"] == account["7"] and {r["post_id"] for r in out["comments"].canonical.collect()} == {post["id"]} == {r["post_id"] for r in out["media"].canonical.collect()}
    assert {(r["follower_id"], r["followed_id"]) for r in out["account_relations"].canonical.collect()} == {(account["8"], account["7"]), (account["7"], account["9"])}
    again, none = inc.incorporate_all(out, prepared(streams))
    assert none.isEmpty() and all({tuple(map(str, r)) for r in again[n].canonical.collect()} == {tuple(map(str, r)) for r in out[n].canonical.collect()} for n in out)
    assert all(again[n].observed.count() == out[n].observed.count() for n in out)


def test_sessions_together_are_as_one_after_another(spark):
    entity = inc.Entity("account", ("bio",))
    data = [("a", 1, "1", "ann", "old"), ("a", 2, None, "bob", ""), ("b", 1, "1", "ann2", None), ("b", 2, "2", "bob", "new"), ("c", 1, None, "cy", "c"), ("c", 2, "1", None, "newest")]
    rows = spark.createDataFrame(data, "session string, ord long, id_on_platform string, url_suffix string, bio string")
    together = inc.incorporate_sessions(inc.empty_store(spark, entity, {}), rows, entity)
    single = inc.empty_store(spark, entity, {})
    for name in "abc":
        done = inc.incorporate(single, rows.where(F.col("session") == name).drop("session"), name, entity)
        single = inc.Stored(checkpointed(done.canonical), checkpointed(done.observed))
    plain = lambda d: sorted(map(str, d.collect()))
    assert plain(together.canonical) == plain(single.canonical) and plain(together.observed) == plain(single.observed)


def test_the_largest_file_of_a_medium_wins(spark):
    entity = inc.ENTITIES["media"]
    shape = "session string, ord long, id_on_platform string, url_suffix string, media_type string, local_url string, post_id long"
    sizes = spark.createDataFrame([("a/big", 9), ("a/small", 1), ("b/big", 9)], "local_url string, size long")
    first = [("a", 1, "1", None, "image", "a/big", None), ("a", 2, "2", None, "image", None, None), ("a", 3, "3", None, "audio", "a/unknown", None)]
    held = inc.empty_store(spark, entity, inc.VALUE_TYPES)
    one = inc.with_largest_files(inc.with_thumbnails(held.canonical), inc.incorporate_sessions(held, spark.createDataFrame(first, shape), entity), sizes)
    status = lambda d: {r["id_on_platform"]: (r["local_url"], r["thumbnail_path"], r["thumbnail_status"]) for r in d.canonical.collect()}
    assert status(one) == {"1": ("a/big", None, "pending"), "2": (None, None, "not_needed"), "3": ("a/unknown", None, "not_needed")}
    drawn = inc.Stored(checkpointed(one.canonical.withColumns({"thumbnail_path": F.lit("t"), "thumbnail_status": F.lit("generated")})), one.observed)
    later = [("b", 1, "1", None, "image", "a/small", None), ("b", 2, "2", None, "image", "a/small", None), ("b", 3, "3", None, "audio", "b/unknown", None), ("b", 4, "4", None, "image", None, None)]
    two = inc.with_largest_files(drawn.canonical, inc.incorporate_sessions(drawn, spark.createDataFrame(later, shape), entity), sizes)
    # a smaller file changes nothing; a first or a newer one of unknown size draws anew
    assert status(two) == {"1": ("a/big", "t", "generated"), "2": ("a/small", None, "pending"), "3": ("b/unknown", None, "not_needed"), "4": (None, None, "not_needed")}
    three = inc.with_largest_files(two.canonical, inc.incorporate_sessions(two, spark.createDataFrame([("c", 1, "1", None, "image", "b/big", None)], shape), entity), sizes)
    assert status(three)["1"] == ("b/big", None, "pending")  # as large, and newer


def test_progress_is_kept(spark, tmp_path):
    held = Progress(3)
    spark.streams.addListener(held)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if held.messages and held.messages[-1]["event"] == "ended":
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(held)
    assert held.messages[-1]["event"] == "ended" and any(m.get("rows") == 5 for m in held.messages)
