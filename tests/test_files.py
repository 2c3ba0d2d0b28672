import base64
import json

from pyspark.sql import functions as F

from strataloom.operators.media import joined_assets
from strataloom.sources import captures, files, structures

EFG = "efg=eyJ4cHZfYXNzZXRfaWQiOiAiNDIifQ"


def test_attachments(spark):
    rows = [("screen_recording.mp4", 5), ("screen_recording.avi", 1), ("screen_recordings/a.MKV", 7), ("screen_recordings/b.mov", 9), ("screen_recordings/c.mov", 9), ("archive.har", 1), ("har_hash.txt", 1), ("har_hash.txt.tsr", 1), ("photos/x.json", 1), ("videos/y.TSR", 1), ("photos/x.jpg", 1), ("deep/archive.har", 1)]
    listing = spark.createDataFrame([(f"file:/data/one/{p}", n) for p, n in rows] + [("file:/data/two/archive.wacz", 3)], "path string, length long")
    held = files.archive_files(listing)
    got = {tuple(r) for r in files.attachments(held).collect() if r["archive"] != "deep"}
    assert got == {("one", "screen_recording", "screen_recording.avi"), ("one", "screen_recording", "screen_recordings/b.mov"), ("one", "har", "archive.har"), ("one", "hash", "har_hash.txt"), ("one", "timestamp", "har_hash.txt.tsr"), ("one", "hash", "photos/x.json"), ("one", "timestamp", "videos/y.TSR"), ("two", "wacz", "archive.wacz")}


def test_names_and_words(spark):
    listing = spark.createDataFrame([("a", "videos/x.mp4", 1), ("a", "more/x.mp4", 3), ("a", "photos/P.JPG", 2), ("a", "photos/p.jpg", 2), ("a", "notes.txt", 9)], "archive string, path string, length long")
    assert [tuple(r) for r in files.largest_named(listing, "video").collect()] == [("a", "x", "more/x.mp4")]
    assert [tuple(r) for r in files.largest_named(listing, "photo").collect()] == [("a", "p.jpg", "photos/P.JPG")]
    texts = spark.createDataFrame([("a", "metadata.json", b'{"notes": "ANN and bob"}'), ("b", "metadata.json", b"{}"), ("c", "other.json", b"ann")], "archive string, path string, content binary")
    assert [r["archive"] for r in files.mentioning(texts, ["ann", "zed"]).collect()] == ["a"] and files.mentioning(texts, []).isEmpty()


def test_media_of_a_capture(spark, tmp_path):
    def entry(url, mime, data):
        return {"request": {"method": "GET", "url": url, "headers": []}, "response": {"status": 206, "headers": [], "content": {"mimeType": mime, "text": base64.b64encode(data).decode(), "encoding": "base64"}}}

    har = [
        entry(f"https://x/v/f.mp4?{EFG}&bytestart=0&byteend=2", "video/mp4", b"abc"),
        entry(f"https://x/v/f.mp4?{EFG}&bytestart=3&byteend=4", "video/mp4", b"de"),
        entry("https://x/v/e.mp4", "video/mp4", b""),
        entry("https://x/p.jpg?small", "image/jpeg", b"s"),
        entry("https://x/p.jpg?large", "image/jpeg", b"large"),
    ]
    (tmp_path / "one.har").write_text(json.dumps({"log": {"entries": har}}))
    entries = captures.routed(captures.har_entries(spark, str(tmp_path)))
    segments = files.video_segments(entries)
    assert {(r["asset_id"], r["filename"], bytes(r["content"])) for r in joined_assets(segments.drop("source")).collect()} == {("42", "f.mp4", b"abcde")}
    assert [(r["filename"], bytes(r["content"]), r["copies"]) for r in files.photos(entries).collect()] == [("p.jpg", b"large", 2)]
    item = {"pk": "9", "id": "9_1", "video_versions": [{"url": f"https://x/v/f.mp4?{EFG}"}], "image_versions2": {"candidates": [{"url": "https://x/p.jpg?a"}]}, "carousel_media": [{"pk": "10", "video_versions": [{"url": "https://x/v/g.mp4"}], "image_versions2": {"candidates": [{"url": "https://x/p.jpg?longer"}]}}]}
    items = structures.items_of(spark.createDataFrame([("s", json.dumps({"items": [item]}))], "source string, json string"))
    videos = files.named_videos(items)
    assert {(r["asset_id"], r["url"].split("/")[-1][:5]) for r in videos.collect()} == {("42", "f.mp4"), ("10", "g.mp4")}
    assert [r["url"] for r in files.named_photos(items).collect()] == ["https://x/p.jpg?longer"]
    both = files.matched_assets(segments.withColumn("source", F.lit("s")).unionByName(segments.withColumn("source", F.lit("s")).withColumn("asset_id", F.lit("7"))), videos)
    assert {(r["asset_id"], r["captured"], r["url"] is None) for r in both.collect()} == {("42", True, False), ("10", False, False), ("7", True, True)}
