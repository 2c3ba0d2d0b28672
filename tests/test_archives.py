"""WACZ archives and captures in SQL: pruned bodies, pushed filters, descriptions, and the same payloads and entities as from HAR."""

import base64
import gzip
import hashlib
import json
import zipfile
from urllib.parse import urlencode

import pytest

from strataloom.sources import captures, structures, tablefunction, wacz

ANN = {"pk": "7", "id": "7", "username": "ann", "full_name": "zeta"}
POST = {"pk": "100", "id": "100_7", "code": "Bk", "taken_at": 60, "user": ANN, "image_versions2": {"candidates": [{"url": "https://x/v/a.jpg?q"}]}}
PAGE = '<script type="application/json">' + json.dumps({"require": [{structures.PAGE_POST: {"items": [POST]}}]}) + "</script>"
COMMENT = {"data": {structures.COMMENTS: {"edges": [{"node": {"pk": "c1", "text": "é", "created_at": 90, "user": ANN | {"full_name": "alpha"}}}]}}}
#: Address, posted variables, content type, body. The name "alpha" comes after "zeta", and sorts before it.
EXCHANGES = [
    ("https://x/p/Bk/", None, "text/html; charset=utf-8", PAGE),
    ("https://x/graphql", {"media_id": "100"}, "application/json", json.dumps(COMMENT)),
    ("https://x/api/v1/media/100/info/", None, "application/json", json.dumps({"items": [POST | {"user": ANN | {"full_name": "alpha"}, "caption": {"text": "one"}}]})),
    ("https://x/graphql", None, "application/json", "no json"),
    ("https://x/v/a.jpg", None, "image/jpeg", "x" * 5000),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    entries = []
    for k, (url, variables, mime, body) in enumerate(EXCHANGES):
        content = {"mimeType": mime, "text": body} if k % 2 else {"mimeType": mime, "text": base64.b64encode(body.encode()).decode(), "encoding": "base64"}
        posted = {"postData": {"params": [{"name": "variables", "value": json.dumps(variables)}]}} if variables else {}
        entries.append({"request": {"method": "POST" if variables else "GET", "url": url, "headers": [], **posted}, "response": {"status": 200, "headers": [], "content": content}})
    (path / "one.har").write_text(json.dumps({"log": {"entries": entries}}))

    def record(url, variables, mime, body, status="200 OK", packed=False):
        target = url + (wacz.POSTED + "POST&" + urlencode({"variables": json.dumps(variables)}) if variables else "")
        data = gzip.compress(body.encode()) if packed else body.encode()
        block = f"HTTP/1.1 {status}\r\nContent-Type: {mime}{chr(13) + chr(10) + 'Content-Encoding: gzip' if packed else ''}\r\n\r\n".encode() + data
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {target}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    halves = [[record(*x, packed=k % 2 == 1) for k, x in enumerate(EXCHANGES[:2])], [record(*x) for x in EXCHANGES[2:]] + [record("https://x/gone", None, "text/html", "", "404 Not Found")]]
    package = json.dumps({"title": "T", "wacz_version": "1.1.1", "software": "s", "created": "2024", "resources": [{"path": "a"}, {"path": "b"}]})
    index = "!meta\n" + "".join(f'x,{k})/ 2024{k} {{"url": "{x[0]}", "mime": "{x[2]}", "offset": "0", "filename": "b.warc.gz"}}\n' for k, x in enumerate(EXCHANGES)) + "bad line\nx 1 {no\n"
    pages = ["{\"format\": \"json-pages-1.0\", \"id\": \"pages\"}", json.dumps({"url": "https://x/p/Bk/", "title": "P", "ts": "2024", "id": "1", "text": "t" * 600, "favIconUrl": "f"}), "", "no json", json.dumps({"url": "https://x/2"})]
    with zipfile.ZipFile(path / "one.wacz", "w") as z:
        z.writestr("archive/b.warc.gz", b"".join(map(gzip.compress, halves[0])))
        z.writestr("archive/a.warc", b"".join(halves[1]), zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.cdx.gz", gzip.compress(index.encode()))
        z.writestr("datapackage.json", package)
        z.writestr("datapackage-digest.json", json.dumps({"hash": "sha256:" + hashlib.sha256(package.encode()).hexdigest(), "signedData": {"hash": "h", "publicKey": "k"}}))
        z.writestr("pages/pages.jsonl", "\n".join(pages))
    with zipfile.ZipFile(path / "two.wacz", "w") as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("datapackage-digest.json", json.dumps({"hash": "sha256:0"}))
    return str(path)


def both(spark, folder):
    return [captures.routed(captures.har_entries(spark, folder, 900)), captures.routed(wacz.wacz_entries(wacz.wacz_responses(spark, folder, 300)))]


def test_har_and_wacz_of_one_capture_give_the_same_payloads(spark, folder):
    sides = [structures.response_payloads(e).orderBy("at").drop("source", "at").collect() for e in both(spark, folder)]
    assert sides[0] == sides[1] and len(sides[0]) == 4
    assert [(r["context_id"], r["url"]) for r in sides[0]] == [("100", "https://x/p/Bk/"), ("100", "https://x/graphql"), ("100", "https://x/api/v1/media/100/info/"), (None, "https://x/graphql")]


def test_what_was_captured_later_wins(spark, folder):
    for entries in both(spark, folder):
        out = structures.deduplicated(structures.bundle(structures.response_payloads(entries)))
        assert [(r["id_on_platform"], r["display_name"]) for r in out["accounts"].collect()] == [("7", "alpha")]
        assert [(r["id_on_platform"], r["caption"]) for r in out["posts"].collect()] == [("100", "one")]
        assert "at" not in out["media"].columns
    first = [json.dumps({"items": [POST | {"user": ANN | {"full_name": n}}]}) for n in ("alpha", "zeta", "beta")]
    rows = spark.createDataFrame([("s", None, None, None, j, f"{k:03}") for k, j in enumerate(first)], "source string, url string, context_id string, target_id string, json string, at string")
    assert structures.deduplicated(structures.bundle(rows))["accounts"].first()["display_name"] == "beta"


def test_bodies_are_pruned_and_filters_pushed(spark, folder):
    few = wacz.read_wacz(spark, folder, "url string, status int")
    assert {r["status"] for r in few.collect()} == {200, 404} and few.count() == 6
    spark.conf.set(wacz.PUSHDOWN, "true")
    try:
        pages = wacz.read_wacz(spark, folder).where("status = 200 AND mime LIKE 'text/html%' AND place >= 0")
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert [r["url"] for r in pages.collect()] == ["https://x/p/Bk/"]
        assert "= 200" not in plan and "StartsWith" not in plan and ">= 0" in plan  # only the comparison that the source does not know is left
        assert wacz.read_wacz(spark, folder).where("status IN (404, 500)").count() == 1
    finally:
        spark.conf.unset(wacz.PUSHDOWN)


def test_what_archives_say_of_themselves(spark, folder):
    members = wacz.described(spark, folder)
    rows = {r["source"].rsplit("/", 1)[1]: r for r in wacz.packages(members).collect()}
    one = rows["one.wacz"]
    assert (one["title"], one["wacz_version"], one["n_resources"], one["hash_ok"], one["signature"]["public_key"]) == ("T", "1.1.1", 2, True, "k")
    assert (rows["two.wacz"]["title"], rows["two.wacz"]["hash_ok"], rows["two.wacz"]["signature"]) == (None, False, None)
    assert [(r["url"], len(r["text_excerpt"]), r["favicon_url"]) for r in wacz.visited_pages(members).orderBy("line").collect()] == [("https://x/p/Bk/", 500, "f"), ("https://x/2", 0, None)]
    assert sorted((r["url"], r["at"]) for r in wacz.index_lines(members).collect()) == sorted((x[0], f"2024{k}") for k, x in enumerate(EXCHANGES))


def test_captures_in_sql(spark, folder):
    tablefunction.register(spark)
    spark.createDataFrame([("h", f"{folder}/one.har"), ("w", f"{folder}/one.wacz"), ("n", None), ("x", "/else.txt")], "session string, path string").createOrReplaceTempView("captures_here")
    rows = spark.sql("SELECT c.session, r.* FROM captures_here c, LATERAL capture_rows(c.path, 'payloads') r ORDER BY session, place").collect()
    wanted = structures.response_payloads(both(spark, folder)[0]).orderBy("at").collect()
    for session in "hw":
        assert [(r["url"], r["context_id"], r["target_id"], r["json"]) for r in rows if r["session"] == session] == [(r["url"], r["context_id"], r["target_id"], r["json"]) for r in wanted]
    counts = spark.sql("SELECT session, route, sum(bytes) AS n FROM captures_here c, LATERAL capture_rows(c.path, 'requests') GROUP BY ALL").collect()
    assert {(r["session"], r["n"]) for r in counts if r["route"] == "photo"} == {("h", 5000), ("w", 5000)}
    with pytest.raises(Exception, match="one of payloads"):
        spark.sql("SELECT * FROM capture_rows('a.har', 'else')").collect()
