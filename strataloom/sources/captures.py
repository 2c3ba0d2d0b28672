"""Readers of captured traffic and of what lies beside it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.sources import har

HEADERS = "array<struct<name: string, value: string>>"
ENTRY = f"""startedDateTime string,
  request struct<method: string, url: string, headers: {HEADERS}, postData: struct<text: string, params: {HEADERS}>>,
  response struct<status: int, headers: {HEADERS}, content: struct<mimeType: string, text: string, encoding: string>>"""
#: Headers that a sanitised capture lacks, in lower case. Fixed values.
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "x-csrftoken")


def har_entries(spark: SparkSession, path: str, size: int = har.RANGE) -> DataFrame:
    """(source, place, request, response) of the entries of HAR files, read in ranges of `size` bytes; place is an entry's byte in its file, and orders them. Files that are no JSON give none, a file that breaks off gives the entries before that."""
    spark.dataSource.register(har.HarSource)
    rows = spark.read.format("har").option("range", size).load(path)
    return rows.select("source", "place", F.from_json("entry", ENTRY).alias("e")).where("e.request IS NOT NULL").select("source", "place", "e.request", "e.response")


def body_bytes(content: Column) -> Column:
    """A response's body: base64 decoded where it says so."""
    return F.when(content["encoding"] == "base64", F.try_to_binary(content["text"], F.lit("base64"))).otherwise(content["text"].cast("binary"))


#: Routes of responses, the first that fits: what the address matches, and what the content type starts with. Fixed values.
ROUTES = {
    "graphql": (r"/graphql", None),
    "api": (r"/api/v1/(media|friendships|feed|clips)/", None),
    "video": (r"(?i)\.mp4(\?|$)", "video/"),
    "photo": (r"(?i)\.(jpe?g|png|webp|heic)(\?|$)", "image/"),
    "page": (None, "text/html"),
}


def routed(entries: DataFrame) -> DataFrame:
    """entries with `route`: graphql, api, video, photo, page or null, by address and content type."""
    url, mime = F.col("request.url"), F.coalesce(F.col("response.content.mimeType"), F.lit(""))
    found = F.lit(None).cast("string")
    for route, (address, start) in reversed(ROUTES.items()):
        tests = [url.rlike(address)] if address else []
        tests += [mime.startswith(start)] if start else []
        found = F.when(reduce(lambda a, b: a | b, tests), route).otherwise(found)
    return entries.withColumn("route", found)


def sanitised(entries: DataFrame) -> DataFrame:
    """entries without the headers that identify a session, and with posted values hidden."""
    clean = lambda headers: F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*SECRET_HEADERS))
    hide = lambda params: F.transform(params, lambda p: F.struct(p["name"].alias("name"), F.lit("[redacted]").alias("value")))
    request = F.col("request").withField("headers", clean(F.col("request.headers"))).withField("postData.params", hide(F.col("request.postData.params"))).withField("postData.text", F.lit(None).cast("string"))
    return entries.withColumn("request", request).withColumn("response", F.col("response").withField("headers", clean(F.col("response.headers"))))


def page_type(url: Column) -> Column:
    """What a page shows, by its address; the first that fits."""
    return (
        F.when(url.contains("/stories/highlights/"), "highlight")
        .when(url.contains("/stories/"), "story")
        .when(url.contains("/reel/"), "reel")
        .when(url.contains("/p/"), "post")
        .otherwise("profile")
    )


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


#: A JSON block of a page.
SCRIPT = r"""(?is)<script[^>]*type=["']application/json["'][^>]*>(.*?)</script>"""


def page_scripts(html: Column) -> Column:
    """The JSON blocks of a page."""
    return F.regexp_extract_all(html, F.lit(SCRIPT), 1)


def page_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), 1))


def visible_text(html: Column) -> Column:
    """A page without scripts, styles, comments and tags; blanks are single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def values_under(text: str | None, key: str) -> list[str]:
    """The values, as JSON, that stand under a key anywhere in a JSON text, outermost first; none where the text is no JSON."""

    def find(node: object) -> Iterator[object]:
        if isinstance(node, dict):
            if key in node:
                yield node[key]
            for value in node.values():
                yield from find(value)
        elif isinstance(node, list):
            for value in node:
                yield from find(value)

    try:
        return [json.dumps(v, sort_keys=True, ensure_ascii=False) for v in find(json.loads(text or "null"))]
    except (ValueError, RecursionError):
        return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def values_at_key(texts: pd.Series, keys: pd.Series) -> pd.Series:
    """values_under, a row a text and key."""
    return pd.Series([values_under(t, k) for t, k in zip(texts, keys, strict=True)])


def cdx_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, url, mime, at) of tab- or blank-separated index lines with a JSON field at the end."""
    lines = spark.read.text(path).select(F.input_file_name().alias("archive"), F.split("value", r"\s", 3).alias("p"))
    info = F.from_json(F.get("p", F.lit(2)), "url string, mime string")
    return lines.select("archive", info["url"].alias("url"), info["mime"].alias("mime"), F.get("p", F.lit(1)).alias("at")).where("url IS NOT NULL")


def sessions_in(files: DataFrame) -> DataFrame:
    """(session, kind, path): one capture a folder (path, length), a HAR before a WACZ."""
    kind = F.lower(F.regexp_extract("path", r"\.(har|wacz)$", 1))
    rows = files.withColumn("kind", kind).where("kind <> ''").withColumn("folder", F.element_at(F.split("path", "/"), -2))
    one = rows.groupBy("folder").agg(F.min(F.struct("kind", "path")).alias("m"))
    return one.select(F.concat_ws("-", "m.kind", "folder").alias("session"), "m.kind", "m.path")


#: The most bytes that an import file may have.
IMPORT_BYTES = 5 * 1024 * 1024


def imported(spark: SparkSession, path: str, expected: list[str], required: list[str], most: int | None = IMPORT_BYTES) -> DataFrame:
    """A CSV import in UTF-8 with the expected columns only: names are trimmed and lower-cased, missing columns are ''. A quote within quotes is doubled; blank lines are no rows.

    Errors: a file of more than `most` bytes, one that is not UTF-8, and a required column that lacks in files with rows.
    """
    files = spark.read.format("binaryFile").load(path)
    if most is not None and (large := files.where(F.col("length") > most).select("path").first()):
        raise ValueError(f"{large['path']} has more than {most} bytes")
    if most is not None and (other := files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path").first()):
        raise ValueError(f"{other['path']} is not UTF-8")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.strip().lstrip("\ufeff").lower(): c for c in raw.columns}
    if (lacking := [c for c in required if c not in names]) and not raw.isEmpty():
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return raw.select(*(F.coalesce(F.trim(F.col(f"`{names[c]}`")), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in expected))
