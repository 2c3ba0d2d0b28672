"""Byte ranges of media assets, their ids, and the largest copy of each file."""

from __future__ import annotations

import hashlib
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def coverage(segments: DataFrame, keys: list[str], start: str, end: str, length: str | None = None) -> DataFrame:
    """(keys, covered, segments_used): how many bytes from byte 0 on each asset's segments [start, end] cover without a gap, and by how many segments; 0 where byte 0 is missing.

    A null start is byte 0, a null end is the start and the bytes there are (column `length`, 0 without it). Segments
    are taken by start; the running end of those before tells a gap, and what follows a gap counts no more.
    """
    rows = segments.select(*keys, F.coalesce(F.col(start), F.lit(0)).cast("long").alias("_from"), F.col(end).alias("_end"), (F.coalesce(F.col(length), F.lit(0)) if length else F.lit(0)).alias("_length"))
    rows = rows.withColumn("_to", F.coalesce(F.col("_end") + 1, F.col("_from") + F.col("_length")).cast("long"))
    order = W.partitionBy(*keys).orderBy("_from", "_to")
    before = F.coalesce(F.max("_to").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before)
    gaps = F.sum(F.when(F.col("_from") > F.col("_before"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("_gaps", gaps)
    return marked.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_gaps") == 0, F.col("_to"))), F.lit(0)).cast("long").alias("covered"),
        F.sum(F.when(F.col("_gaps") == 0, 1).otherwise(0)).cast("long").alias("segments_used"),
    )


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


@F.pandas_udf(T.StringType())
def hash_number(text: pd.Series) -> pd.Series:
    """The md5 of a text as a decimal number."""
    return text.map(lambda t: str(int(hashlib.md5(t.encode()).hexdigest(), 16)) if isinstance(t, str) else None)


def inside_id(url: Column) -> Column:
    """The id inside the address's efg parameter, URL-safe base64 JSON; null where it cannot be read."""
    plain = F.translate(F.try_url_decode(query_value(url, "efg")), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.xpv_asset_id")


def asset_id(url: Column) -> Column:
    """The id in the address's efg parameter (inside_id); without the parameter, a number from the file name."""
    name = F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/"), F.lit(-1))
    return F.when(query_value(url, "efg").isNull(), hash_number(name)).otherwise(inside_id(url))


def byte_range(url: Column) -> Column:
    """struct<start, end> of the address's bytestart and byteend."""
    return F.struct(F.try_to_number(query_value(url, "bytestart"), F.lit("9" * 18)).cast("long").alias("start"), F.try_to_number(query_value(url, "byteend"), F.lit("9" * 18)).cast("long").alias("end"))


def without_range(url: str) -> str:
    """The address without its byte range."""
    parts = urlsplit(url)
    kept = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k not in ("bytestart", "byteend")}
    return parts._replace(query="&".join(f"{k}={x}" for k, v in kept.items() for x in v)).geturl()


def asset_pieces(segments: DataFrame) -> DataFrame:
    """(asset_id, filename, offset, piece): what each of an asset's segments (asset_id, filename, start, end, content) adds to the bytes from byte 0 on, up to the first gap. A null start is byte 0. A row a segment, so that no asset is bound to what one row holds."""
    rows = segments.withColumn("start", F.coalesce("start", F.lit(0))).withColumn("end", F.coalesce("end", F.col("start") + F.octet_length("content") - 1))
    order = W.partitionBy("asset_id", "filename").orderBy("start", "end")
    before = F.coalesce(F.max(F.col("end") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("_before", before)
    marked = marked.withColumn("_gap", F.sum(F.when(F.col("start") > F.col("_before"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    piece = F.expr("substring(content, cast(_before - start + 1 AS int), cast(end - _before + 1 AS int))")
    return marked.where("_gap = 0 AND end >= _before").select("asset_id", "filename", F.col("_before").alias("offset"), piece.alias("piece"))


def joined_assets(segments: DataFrame) -> DataFrame:
    """(asset_id, filename, content): the pieces of each asset as one value, for assets that one row can hold (2 GB); asset_pieces gives any. Empty for an asset without byte 0."""
    joined = asset_pieces(segments).groupBy("asset_id", "filename").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")
    return segments.select("asset_id", "filename").distinct().join(joined, ["asset_id", "filename"], "left").select("asset_id", "filename", F.coalesce(F.unhex(text), F.lit(b"")).alias("content"))


def manifest_id(manifest: Column) -> Column:
    """The asset id in the first address of a DASH manifest (XML text, entities as & < >) whose file has a readable efg parameter."""
    bases = F.regexp_extract_all(manifest, F.lit(r"<BaseURL[^>]*>([^<]*)</BaseURL>"), 1)
    plain = F.transform(bases, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    ids = F.transform(F.filter(plain, lambda u: u.rlike(r"[?&]efg=")), inside_id)
    return F.get(F.filter(ids, lambda i: i.isNotNull()), F.lit(0))


def accumulated(segments: DataFrame) -> DataFrame:
    """segments with `key`: an asset's segments are those of one asset id and file name; those without an id are keyed by their file name alone."""
    return segments.withColumn("key", F.coalesce(F.concat("asset_id", F.lit("/"), "filename"), F.concat(F.lit("file:"), "filename")))


def named_assets(variants: DataFrame) -> DataFrame:
    """(filename, asset_id) of variants (ord, url, manifest, pk), the first row of a file name wins: the id in the address, else in the manifest, else the item's own."""
    own = F.when(query_value(F.col("url"), "efg").isNotNull(), inside_id(F.col("url")))
    found = variants.select(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/"), F.lit(-1)).alias("filename"), "ord", F.coalesce(own, manifest_id(F.col("manifest")), "pk").alias("asset_id"))
    return found.where("filename <> '' AND asset_id IS NOT NULL").groupBy("filename").agg(F.min_by("asset_id", "ord").alias("asset_id"))


def reconciled(segments: DataFrame, names: DataFrame) -> DataFrame:
    """segments whose missing asset ids are taken from names (filename, asset_id); what is not found stays without."""
    side = names.select("filename", F.col("asset_id").alias("_named"))
    return segments.join(side, "filename", "left").withColumn("asset_id", F.coalesce("asset_id", "_named")).drop("_named").select(*segments.columns)


def media_type(mime: Column) -> Column:
    return F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio")
