import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from strataloom.operators import enrich, graph, hierarchy, incorporate, integrity, media, reconcile, resolve, tags
from strataloom.plans import registry
from strataloom.sources import captures, structures, wacz
from strataloom.streaming.incremental import activity, incorporated


def test_clusters_against_union_find(spark):
    rng = random.Random(1)
    rows = [(i, f"i{rng.randrange(60)}" if rng.random() < 0.7 else None, f"u{rng.randrange(60)}" if rng.random() < 0.7 else None) for i in range(100)]
    parent = list(range(100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for slot in (1, 2):
        first = {}
        for r in rows:
            if r[slot] is not None:
                a, b = find(first.setdefault(r[slot], r[0])), find(r[0])
                parent[max(a, b)] = min(a, b)
    got = resolve.clusters(spark.createDataFrame(rows, "ord int, a string, b string"), "ord", [F.col("a"), F.col("b")])
    assert {r["ord"]: r["cluster"] for r in got.collect()} == {i: find(i) for i in range(100)}


def test_lookup_prefers_the_address(spark):
    known = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", None)], "id long, url_suffix string, id_on_platform string")
    rows = spark.createDataFrame([("a", "y"), (None, "y"), ("z", None), (None, None)], "url_suffix string, id_on_platform string")
    got = {(r["url_suffix"], r["id_on_platform"]): r["canonical_id"] for r in resolve.dual_key_lookup(rows, known).collect()}
    assert got == {("a", "y"): 3, (None, "y"): 2, ("z", None): None, (None, None): None}


def test_closure_with_cycle_and_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "super long, sub long")
    seeds = spark.createDataFrame([(1,), (9,)], "id long")
    wanted = {(1, 1), (1, 2), (1, 3), (1, 4), (9, 9)}
    assert {tuple(r) for r in hierarchy.closure(edges, seeds).collect()} == wanted == {tuple(r) for r in hierarchy.descendants(edges, seeds).collect()}
    assert hierarchy.add_edge(edges, 4, 1)[1] == "cycle"
    assert hierarchy.add_edge(edges, 1, 2)[1] == "exists"
    assert hierarchy.add_edge(edges, 4, 5)[1] == "added"
    loop = edges.union(spark.createDataFrame([(4, 1)], edges.schema))
    assert hierarchy.closure(loop, seeds.where("id = 1")).count() == 4


def test_scores(spark):
    relations = spark.createDataFrame([(1, 2, "follow"), (2, 1, "tag"), (1, 3, "suggested"), (4, 1, None), (1, 1, "follow"), (1, None, "follow")], "follower_id long, other_id long, kind string")
    likes = spark.createDataFrame([(10, 5)], "post_id long, account_id long")
    posts = spark.createDataFrame([(10, 1)], "id long, account_id long")
    edges = graph.ties(relations, likes, posts)
    kernel = spark.createDataFrame([(1,), (7,)], "id long")
    assert [tuple(r) for r in graph.candidates(edges, kernel).collect()] == [(2, 1.0, 1), (4, 1.0, 1), (5, 1.0, 1)]
    assert {tuple(r) for r in graph.kernel_scores(edges, kernel).collect()} == {(1, 0.0, 0), (7, 0.0, 0)}
    assert graph.candidates(edges, kernel.limit(0)).count() == 0
    assert graph.candidates(edges, kernel, excluded=spark.createDataFrame([(2,)], "id long")).count() == 2


def test_coverage(spark):
    rows = [("a", 0, 9), ("a", 10, 19), ("a", 30, 39), ("b", 5, 9), ("c", 0, 4), ("c", 2, 12), ("c", None, 3)]
    got = media.coverage(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e")
    assert {r["k"]: (r["covered"], r["segments_used"]) for r in got.collect()} == {"a": (20, 2), "b": (0, 0), "c": (13, 3)}
    parts = spark.createDataFrame([("a", "f", 0, 3, b"abcd"), ("a", "f", 2, 5, b"cdef"), ("a", "f", 9, 9, b"z")], "asset_id string, filename string, start long, end long, content binary")
    assert bytes(media.joined_assets(parts).first()["content"]) == b"abcdef"


def test_asset_ids(spark):
    urls = ["https://x/v/f.mp4?efg=eyJ4cHZfYXNzZXRfaWQiOiAiNDIifQ&bytestart=0&byteend=9", "https://x/v/f.mp4?q=1", "https://x/v/f.mp4?efg=%%%"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, u string").orderBy("id")
    got = [r[0] for r in df.select(media.asset_id(F.col("u"))).collect()]
    assert got == ["42", str(int(hashlib.md5(b"f.mp4").hexdigest(), 16)), None]
    assert tuple(df.select(media.byte_range(F.col("u")).alias("r")).first()["r"]) == (0, 9)


def test_fold_and_merge(spark):
    rows = spark.createDataFrame([("k", 1, "a", 0), ("k", 2, " ", None), ("k", 3, None, 5)], "k string, ord int, s string, n int")
    assert tuple(reconcile.fold(rows, ["k"], ["ord"], ["s", "n"]).first()) == ("k", "a", 5)
    assert tuple(reconcile.fold(rows, ["k"], ["ord"], ["s", "n"], newest=False).first()) == ("k", "a", 0)
    pairs = spark.createDataFrame([('{"a": {"x": 1, "l": [1, {"p": 1, "q": 2}]}}', '{"a": {"x": 2, "l": [{"q": 2, "p": 1}, 3]}, "b": ""}'), (None, None), ("no json", '{"z": 0}')], "a string, b string")
    got = [json.loads(r[0]) for r in pairs.select(reconcile.merged_json("a", "b")).collect()]
    assert got == [{"a": {"x": 1, "l": [1, {"p": 1, "q": 2}, 3]}, "b": ""}, {}, {"z": 0}]


ENTITY = incorporate.Entity("account", ("bio",))
ROW = "ord long, id_on_platform string, url_suffix string, bio string"


def empty_store(spark):
    return incorporate.Stored(
        spark.createDataFrame([], "id long, id_on_platform string, url_suffix string, identifiers array<string>, bio string"),
        spark.createDataFrame([], "canonical_id long, session string, bio string"),
    )


def canonical(stored):
    return {r["id"]: (r["id_on_platform"], r["url_suffix"], r["identifiers"], r["bio"]) for r in stored.canonical.collect()}


def test_incorporate(spark):
    rows = spark.createDataFrame([(1, "1", "ann", "old"), (2, "1", "ann2", ""), (3, None, "bob", "b"), (4, None, None, "lost")], ROW)
    one = incorporate.incorporate(empty_store(spark), rows, "s1", ENTITY)
    assert canonical(one) == {0: ("1", "ann2", ["id_1", "url_ann2"], "old"), 1: (None, "bob", ["url_bob"], "b")}
    again = incorporate.incorporate(one, rows, "s1", ENTITY)
    assert canonical(again) == canonical(one)
    later = incorporate.incorporate(again, spark.createDataFrame([(1, "2", "bob", "new"), (2, "3", "cy", None)], ROW), "s2", ENTITY)
    assert canonical(later) == {0: ("1", "ann2", ["id_1", "url_ann2"], "old"), 1: ("2", "bob", ["url_bob", "id_2"], "new"), 2: ("3", "cy", ["id_3", "url_cy"], None)}
    assert later.observed.count() == 4


def test_stream_of_sessions(spark, tmp_path):
    spark.createDataFrame([("s1", 1, "1", "ann", "a"), ("s2", 1, "1", None, "b")], "session string, " + ROW).coalesce(1).write.parquet(str(tmp_path / "in"))
    box = {"stored": empty_store(spark)}
    stream = spark.readStream.schema("session string, " + ROW).parquet(str(tmp_path / "in"))
    save = lambda s: box.update(stored=incorporate.Stored(spark.createDataFrame(s.canonical.collect(), s.canonical.schema), spark.createDataFrame(s.observed.collect(), s.observed.schema)))
    assert incorporated(stream, lambda: box["stored"], save, ENTITY, str(tmp_path / "ck")).awaitTermination(60)
    assert canonical(box["stored"]) == {0: ("1", "ann", ["id_1", "url_ann"], "b")}


def test_activity_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2020-01-01 10:00:00' AS ts, 'a' AS kind UNION ALL SELECT timestamp'2020-01-01 11:00:00', 'a'").write.parquet(str(tmp_path / "ev"))
    stream = activity(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "ev")), "ts", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity_test").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["kind"], r["n"]) for r in spark.table("activity_test").collect()] == [("a", 2)]


def test_threads(spark):
    rows = spark.createDataFrame([(1, 1, None, 5), (1, 2, None, 1), (1, 3, 1, 6), (1, 4, 2, 9), (1, 5, 99, 0)], "t int, i int, p int, at int")
    got = enrich.threads(rows, "t", "i", "p", "at").orderBy("place").collect()
    assert [r["i"] for r in got] == [2, 4, 1, 3, 5]


def test_redaction(spark):
    df = spark.createDataFrame([({"user": "x", "note": "y"},)], "m map<string,string>")
    row = enrich.redacted(df, "m", ["user", "mail"]).first()
    assert row["m"] == {"user": "[redacted]", "note": "y"} and row["redacted"] == ["user"]


def test_hash_tree(spark):
    def root(layer):
        while len(layer) > 1:
            layer = [hashlib.sha256(bytes.fromhex(layer[i] + (layer[i + 1] if i + 1 < len(layer) else layer[i]))).hexdigest() for i in range(0, len(layer), 2)]
        return layer[0]

    data = {"a": b"", "b": b"12345", "c": bytes(range(50)), "d": b"1234"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary")
    chunks = integrity.chunk_hashes(files, "path", "content", 4)
    got = {r["path"]: r["root"] for r in integrity.tree_roots(chunks, "path").collect()}
    assert got == {k: root([hashlib.sha256(v[i : i + 4]).hexdigest() for i in range(0, max(len(v), 1), 4)]) for k, v in data.items()}
    manifest = spark.createDataFrame([("b", hashlib.sha256(b"12345").hexdigest()), ("c", "0"), ("z", "0"), ("../b", "0")], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in integrity.manifest_check(manifest, files).collect()} == {"b": "pass", "c": "fail", "z": "missing", "../b": "invalid_path"}


def test_import_statuses(spark):
    accounts = spark.createDataFrame([(1, "ann"), (2, "bob")], "id long, url_suffix string")
    known = spark.createDataFrame([(5, "Red", "colour"), (6, "red", "mood"), (7, "Big", None)], "id long, name string, tag_type string")
    existing = spark.createDataFrame([(1, 7)], "account_id long, tag_id long")
    rows = spark.createDataFrame([("1", " RED ", "Mood"), ("ann", "big", ""), ("bob", "red", None), ("x", "big", None), ("bob", "none", None)], "entity string, tag string, tag_type string")
    got = {(r["entity"], r["tag"]): r["status"] for r in tags.annotation_import(rows, accounts, known, existing).collect()}
    assert got == {("1", " RED "): "added", ("ann", "big"): "exists", ("bob", "red"): "error", ("x", "big"): "error", ("bob", "none"): "error"}


def test_har_capture(spark, tmp_path):
    entry = lambda url, mime, text: {"request": {"method": "GET", "url": url, "headers": [{"name": "Cookie", "value": "s"}, {"name": "Accept", "value": "*"}], "postData": {"text": "q", "params": [{"name": "a", "value": "b"}]}}, "response": {"status": 200, "headers": [], "content": {"mimeType": mime, "text": text}}}
    har = {"log": {"entries": [entry("https://x/graphql", "application/json", "{}"), entry("https://x/a.jpg", "image/jpeg", "AA=="), entry("https://x/", "text/html", "<p>")]}}
    (tmp_path / "one.har").write_text(json.dumps(har))
    entries = captures.har_entries(spark, str(tmp_path / "*.har"))
    assert [r["route"] for r in captures.routed(entries).orderBy("place").collect()] == ["graphql", "photo", "page"]
    request = captures.sanitised(entries).first()["request"]
    assert [h["name"] for h in request["headers"]] == ["Accept"] and request["postData"]["params"][0]["value"] == "[redacted]"


def test_wacz_capture(spark, tmp_path):
    def record(kind, url, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    warc = record("request", "https://x/1", b"GET") + record("response", "https://x/1?__wb_method=POST", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>") + record("response", "https://x/2", b"HTTP/1.1 404 No\r\n\r\n")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("archive/data.warc", warc)
    (tmp_path / "a.wacz").write_bytes(buffer.getvalue())
    rows = wacz.wacz_responses(spark, str(tmp_path)).collect()
    assert [(r["url"], r["status"], r["mime"], bytes(r["body"])) for r in rows] == [("https://x/1", 200, "text/html", b"<p>")]


@pytest.mark.parametrize("packed", [True, False])
def test_wacz_archives_are_read_by_ranges(spark, tmp_path, packed):
    shrink = gzip.compress if packed else bytes
    name, data, index = "data.warc" + ".gz" * packed, b"", []
    for i in range(60):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nbody {i} ".encode() + random.Random(i).randbytes(300)
        record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: https://x/{i}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        if i % 3:  # the index lacks some records, and one place is wrong
            index.append(f'x,{i})/ 2020 {{"url": "https://x/{i}", "offset": "{len(data) + 7 * (i == 4)}", "filename": "{name}"}}\n')
        data += shrink(record)
    for at, how in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / f"{at} x.wacz", "w") as z:
            z.writestr(f"archive/{name}", data, how)
            z.writestr("indexes/index.cdx.gz", gzip.compress("".join(reversed(index)).encode()), zipfile.ZIP_STORED)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # stands for the limit of a cell
    try:
        ranges = []
        for path in tmp_path.iterdir():
            with open(path, "rb") as f, zipfile.ZipFile(f) as z:
                ranges += wacz.ranges_in(f, z, 2000)
        rows = wacz.wacz_responses(spark, str(tmp_path), 2000).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    stored = sorted((start, end) for _, base, start, end in ranges if base >= 0)
    assert len(stored) > 5 and stored[0][0] == 0 and stored[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(stored, stored[1:], strict=False))
    assert sorted((r["source"][-8:], r["url"]) for r in rows) == sorted((f"{k} x.wacz"[-8:], f"https://x/{i}") for k in (0, 1) for i in range(60))
    assert all(bytes(r["body"]).startswith(f"body {r['url'].split('/')[-1]} ".encode()) for r in rows)


def test_payloads_become_entities(spark):
    user = {"pk": "7", "username": "ann", "full_name": "Ann"}
    child = {"id": "m2", "media_type": 2, "video_versions": [{"url": "https://x/v/b.mp4?q"}]}
    item = {"pk": "100", "id": "100_7", "taken_at": 0, "caption": {"text": "hi"}, "user": user, "image_versions2": {"candidates": [{"url": "https://x/v/a.jpg?q"}]}, "carousel_media": [child], "usertags": {"in": [{"user": {"pk": "8", "username": "bob"}, "position": [0.5, 0.25]}]}}
    clip = {"data": {"xdt_api__v1__clips__user__connection_v2": {"edges": [{"node": {"media": {"pk": "200", "id": "c", "code": "zz", "user": user, "caption": {"text": "no"}}}}]}}}
    payloads = spark.createDataFrame([("s", json.dumps({"items": [item]})), ("s", json.dumps(clip)), ("s", "no json"), ("s", None)], "source string, json string")
    out = structures.flattened(payloads)
    posts = {r["id_on_platform"]: r for r in out["posts"].collect()}
    assert posts["100"]["url_suffix"] == "p/Bk" and posts["100"]["caption"] == "hi" and posts["200"]["caption"] is None and posts["200"]["url_suffix"] == "p/zz"
    assert sorted((r["id_on_platform"], r["media_type"], r["url_suffix"]) for r in out["media"].where("post_id = '100'").collect()) == [("100_7", "image", "a.jpg"), ("m2", "video", "b.mp4")]
    assert {r["id_on_platform"] for r in out["accounts"].collect()} == {"7", "8"}
    assert [(r["id_on_platform"], r["x"]) for r in out["tagged_accounts"].collect()] == [("8_100_100_7", 0.5)]


def test_reels_and_relations(spark):
    user = {"pk": "7", "id": "7", "username": "ann", "biography": "x" * 300}
    sticker = {"bloks_sticker": {"sticker_data": {"ig_mention": {"username": "cy", "full_name": "Cy"}}}}
    item = {"pk": "1", "id": "1_7", "taken_at": 5, "story_bloks_stickers": [sticker]}
    node = lambda i, kind: {"node": {"id": i, "reel_type": kind, "user": user, "items": [item]}}
    reels = {"data": {"xdt_api__v1__feed__reels_media__connection": {"edges": [node("highlight:55", "highlight_reel"), node("7", "user_reel")]}}}
    stories = {"data": {"xdt_api__v1__feed__reels_media": {"reels_media": [node("7", None)["node"], node("8", None)["node"]]}}}
    payloads = spark.createDataFrame([("a", json.dumps(reels)), ("b", json.dumps(stories))], "source string, json string")
    out = structures.flattened(payloads)
    assert sorted((r["source"], r["url_suffix"], r["account_id"]) for r in out["posts"].collect()) == [("a", "s/55/?story_media_id=1", "7"), ("a", "stories/ann/1/", "7"), ("b", "stories/ann/1/", "7")]
    assert {(r["id_on_platform"], r["tagged_account_id"]) for r in out["tagged_accounts"].collect()} == {("url_cy/_1_", None)}
    assert {r["url_suffix"] for r in out["accounts"].collect()} == {"ann/", "cy/"}


def test_nested_json_and_pages(spark):
    df = spark.createDataFrame([('{"a": [{"k": 1}, {"b": {"k": {"k": 2}}}]}',), ("{",)], "t string")
    assert [r[0] for r in df.select(captures.values_at_key("t", F.lit("k"))).collect()] == [["1", '{"k": 2}', "2"], []]
    html = spark.createDataFrame([('<title> T </title><script type="application/json">{"x":1}</script><p>a<b>b</b></p>',)], "h string")
    assert tuple(html.select(captures.page_title(F.col("h")), captures.page_scripts(F.col("h")), captures.visible_text(F.col("h"))).first()) == ("T", ['{"x":1}'], "T a b")


def test_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ Name ,Other\n x ,y\n", encoding="utf-8")
    assert [tuple(r) for r in captures.imported(spark, str(tmp_path / "a.csv"), ["name", "notes"], ["name"]).collect()] == [("x", "")]
    with pytest.raises(ValueError):
        captures.imported(spark, str(tmp_path / "a.csv"), ["name"], ["tag"])


def test_roots_of_all_names(spark):
    folder = "/root/testdata/sf0.001"
    names = {f"{t}/{r[0]}": r[1] for t, k, v in (("region", "r_regionkey", "r_name"), ("part", "p_partkey", "p_name")) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(k, v).collect()}
    sizes = {-(-len(v) // 4) for v in names.values()}
    assert {1, 2, 3} <= sizes  # one chunk, pairs and odd layers

    def root(layer):
        while len(layer) > 1:
            layer = [hashlib.sha256(bytes.fromhex(a + b)).hexdigest() for a, b in zip(layer[::2], layer[1::2] + layer[-1:] * (len(layer) % 2), strict=True)]
        return layer[0]

    got = {r["path"]: r["root"] for r in registry.QUERIES["name_tree_roots"](spark, folder).collect()}
    assert got == {k: root([hashlib.sha256(v[i : i + 4].encode()).hexdigest() for i in range(0, max(len(v), 1), 4)]) for k, v in names.items()}
