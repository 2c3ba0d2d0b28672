"""Files beside a capture, by their paths and sizes, and the media that a capture holds or names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.media import asset_id, byte_range, manifest_id, query_value
from strataloom.sources.captures import body_bytes
from strataloom.sources.structures import CHILD

# What stands where in an archive's folder.
RECORDINGS = r"^screen_recordings/[^/]+\.(?i:avi|mp4|mkv|mov|webm)$"
HASHES, STAMPS = r"^(har_hash\.txt|(photos|videos)/[^/]+\.(?i:txt|json))$", r"^(har_hash\.txt\.tsr|(photos|videos)/[^/]+\.(?i:tsr))$"
IMAGES = r"(?i)\.(jpe?g|png|webp|heic|gif)$"


def attachments(files: DataFrame) -> DataFrame:
    """(archive, kind, path) of files (archive, path within it, length): screen_recording (the one at the top, .avi before .mp4, and the largest in its folder; of equal ones the smallest path), har, wacz, hash or timestamp. Other files are left out."""
    path = F.col("path")
    kind = (
        F.when(path.isin("screen_recording.avi", "screen_recording.mp4"), "main")
        .when(path.rlike(RECORDINGS), "recording")
        .when(path == "archive.har", "har")
        .when(path == "archive.wacz", "wacz")
        .when(path.rlike(HASHES), "hash")
        .when(path.rlike(STAMPS), "timestamp")
    )
    known = files.withColumn("kind", kind).where("kind IS NOT NULL")
    single = known.where("kind IN ('main', 'recording')").groupBy("archive", "kind")
    best = single.agg(F.min_by("path", F.struct(F.when(F.col("kind") == "main", path).otherwise(""), -F.col("length"), path)).alias("path"))
    return best.select("archive", F.lit("screen_recording").alias("kind"), "path").unionByName(known.where("kind NOT IN ('main', 'recording')").select("archive", "kind", "path"))


def mentioning(files: DataFrame, words: list[str]) -> DataFrame:
    """(archive) of files (archive, path, content) named metadata.json that hold any of the words, in any case."""
    text = F.lower(F.col("content").cast("string"))
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word.lower())
    return files.where((F.element_at(F.split("path", "/"), -1) == "metadata.json") & hit).select("archive").distinct()


def largest_named(files: DataFrame, kind: str) -> DataFrame:
    """(archive, name, path) of files (archive, path, length): the largest file of each name (of equal ones the smallest path). Videos (.mp4) go by their names without the ending, photos by lower-cased names."""
    name = F.element_at(F.split("path", "/"), -1)
    if kind == "video":
        some, key = files.where(name.endswith(".mp4")), F.regexp_replace(name, r"\.mp4$", "")
    else:
        some, key = files.where(name.rlike(IMAGES)), F.lower(name)
    return some.groupBy("archive", key.alias("name")).agg(F.min_by("path", F.struct(-F.col("length"), F.col("path"))).alias("path"))


def video_segments(entries: DataFrame) -> DataFrame:
    """(source, asset_id, filename, start, end, content) of the videos among routed HAR entries; content is the decoded body. Bodies that cannot be decoded, and empty ones, are left out. operators.media joins them."""
    url = F.col("request.url")
    held = entries.where("route = 'video'").select("source", url.alias("url"), body_bytes(F.col("response.content")).alias("content"), byte_range(url).alias("r"))
    filename = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/"), F.lit(-1))
    return held.where(F.octet_length("content") > 0).select("source", asset_id(F.col("url")).alias("asset_id"), filename.alias("filename"), F.col("r.start").alias("start"), F.col("r.end").alias("end"), "content")


def photos(entries: DataFrame) -> DataFrame:
    """(source, filename, asset_id, content, copies) of the photos among routed HAR entries, the largest body of each file name."""
    url = F.col("request.url")
    rows = entries.where("route = 'photo'").select(
        "source", F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/"), F.lit(-1)).alias("filename"), asset_id(url).alias("asset_id"), body_bytes(F.col("response.content")).alias("content"), "place"
    )
    size = F.struct(F.octet_length("content"), -F.col("place"))
    return rows.where(F.octet_length("content") > 0).groupBy("source", "filename").agg(F.max_by("asset_id", size).alias("asset_id"), F.max_by("content", size).alias("content"), F.count("*").alias("copies"))


def own_and_children(items: DataFrame) -> DataFrame:
    """(source, pk, video, image, manifest) of post-like items and their carousel children: the first video variant and the first image candidate."""
    i = F.col("item")
    none = F.array().cast(f"array<{CHILD}>")
    parts = F.concat(F.array(F.struct(i["pk"].alias("pk"), i["video_versions"].alias("v"), i["image_versions2"].alias("m"))), F.transform(F.coalesce(i["carousel_media"], none), lambda c: F.struct(c["pk"].alias("pk"), c["video_versions"].alias("v"), c["image_versions2"].alias("m"))))
    rows = items.select("source", F.explode(parts).alias("p"))
    return rows.select("source", F.col("p.pk").alias("pk"), F.get(F.col("p.v.url"), F.lit(0)).alias("video"), F.get(F.col("p.m.candidates.url"), F.lit(0)).alias("image"))


def named_videos(items: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(source, asset_id, url) of the videos that items name: by the id in the manifest (pk, manifest), else in the address, else the item's own; the first by address of each id."""
    rows = own_and_children(items).where("video IS NOT NULL")
    rows = rows.join(manifests, "pk", "left") if manifests is not None else rows.withColumn("manifest", F.lit(None).cast("string"))
    in_url = F.when(query_value(F.col("video"), "efg").isNotNull(), asset_id(F.col("video")))
    found = rows.withColumn("asset_id", F.coalesce(manifest_id(F.col("manifest")), in_url, "pk"))
    return found.groupBy("source", "asset_id").agg(F.min("video").alias("url"))


def named_photos(items: DataFrame) -> DataFrame:
    """(source, asset_id, url) of the photos that items name; of several addresses of one asset the longest (of equal ones the smallest)."""
    rows = own_and_children(items).where("image IS NOT NULL").select("source", asset_id(F.col("image")).alias("asset_id"), F.col("image").alias("url"))
    return rows.groupBy("source", "asset_id").agg(F.min_by("url", F.struct(-F.char_length("url"), F.col("url"))).alias("url"))


def matched_assets(captured: DataFrame, named: DataFrame) -> DataFrame:
    """(source, asset_id, url, captured): assets that were captured (source, asset_id), that items name (source, asset_id, url), or both."""
    there = captured.select("source", "asset_id").where("asset_id IS NOT NULL").distinct().withColumn("captured", F.lit(True))
    return named.join(there, ["source", "asset_id"], "full_outer").select("source", "asset_id", "url", F.coalesce("captured", F.lit(False)).alias("captured"))


def archive_files(listing: DataFrame, path: str = "path") -> DataFrame:
    """listing (path, ...) with archive, the folder above, and path within it, for archives that lie side by side: .../<archive>/<path>."""
    parts: Column = F.col(path)
    return listing.withColumn("archive", F.regexp_extract(parts, r"([^/]+)/(?:(?:photos|videos|screen_recordings)/)?[^/]+$", 1)).withColumn("path", F.regexp_extract(parts, r"[^/]+/((?:(?:photos|videos|screen_recordings)/)?[^/]+)$", 1))
