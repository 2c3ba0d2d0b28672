"""Column functions that bring captured identifiers, addresses and JSON into their stored form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address prefixes by platform, and the digits of short codes.
PAGE_PREFIXES = {"instagram": "https://www.instagram.com/"}
MEDIA_PREFIXES = {"instagram": "https://scontent.cdninstagram.com/v/"}
CODE_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def null_sentinel(c: Column) -> Column:
    """'' and 'None' are no value."""
    return F.when(~c.isin("", "None"), c)


def platform_id(c: Column) -> Column:
    """The trimmed text before the first underscore; numbers as text."""
    return null_sentinel(F.split_part(F.trim(c.cast("string")), F.lit("_"), F.lit(1)))


def path_suffix(c: Column) -> Column:
    """What precedes the query, without closing slashes; may be ''."""
    return F.regexp_replace(F.split_part(F.trim(c), F.lit("?"), F.lit(1)), "/+$", "")


def url_suffix(c: Column) -> Column:
    return null_sentinel(path_suffix(c))


def post_suffix(c: Column) -> Column:
    """As url_suffix, but the story a highlight shows stays part of it."""
    story = F.regexp_extract(c, r"\?story_media_id=([^&]*)", 1)
    return F.when(F.contains(c, F.lit("?story_media_id=")), F.concat(path_suffix(c), F.lit("?story_media_id="), story)).otherwise(url_suffix(c))


def post_id(id_: Column, url: Column) -> Column:
    """The id, else the number a stories address holds."""
    return F.coalesce(platform_id(id_), F.nullif(F.regexp_extract(url, r"stories/[^/]+/(\d+)", 1), F.lit("")))


def like_id(id_: Column, post: Column, account: Column) -> Column:
    return F.coalesce(id_, F.when(post.isNotNull() & account.isNotNull(), F.concat_ws("_", post, account)))


def relation_id(id_: Column, follower: Column, followed: Column, kind: Column) -> Column:
    made = F.concat_ws("_", follower, followed, F.coalesce(kind, F.lit("")))
    return F.coalesce(id_, F.when(follower.isNotNull() & followed.isNotNull(), made))


def tagged_id(id_: Column, account: Column, suffix: Column, post: Column, media: Column) -> Column:
    """The tagged account, or its address, with the post and media it is tagged in; one of the two is needed."""
    where = F.concat_ws("_", F.coalesce(post, F.lit("")), F.coalesce(media, F.lit("")))
    who = F.coalesce(account, F.concat(F.lit("url_"), suffix))
    return F.coalesce(id_, F.when((post.isNotNull() | media.isNotNull()) & who.isNotNull(), F.concat_ws("_", who, where)))


def valid_identifier(c: Column) -> Column:
    return F.coalesce((c != "") & (F.regexp_replace(c, "/+$", "") != "None"), F.lit(False))


def full_url(suffix: Column, platform: Column, media: bool = False) -> Column:
    """The address a suffix stands for; an unknown platform adds nothing."""
    prefix = F.lit("")
    for name, text in (MEDIA_PREFIXES if media else PAGE_PREFIXES).items():
        prefix = F.when(platform == name, F.lit(text)).otherwise(prefix)
    return F.concat(prefix, suffix)


def parsed_url(text: Column) -> Column:
    """struct<platform, suffix> of a text that is an address of a known platform, else null."""
    s = F.trim(text)
    low = F.lower(s)
    looks = low.contains("://") | low.startswith("www.") | low.contains("instagram.com")
    page = F.regexp_extract(s, r"(?is)^(?:https?://)?(?:www\.)?instagram\.com/(.+)", 1)
    page = F.rtrim(F.split_part(F.split_part(F.ltrim(page, F.lit("/")), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("/"))
    file = F.btrim(F.regexp_extract(s, r"(?i)^(?:https?://)?scontent[^/]*\.cdninstagram\.com/v/([^?]+)", 1), F.lit("/"))
    suffix = F.coalesce(F.nullif(page, F.lit("")), F.nullif(file, F.lit("")))
    return F.when(looks & suffix.isNotNull(), F.struct(F.lit("instagram").alias("platform"), F.trim(suffix).alias("suffix")))


def cdn_filename(url: Column) -> Column:
    return F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/"), F.lit(-1))


def shortcode(id_: Column) -> Column:
    """A positive id written with 64 digits, most significant first; 0 is ''."""
    digits = [F.substring(F.lit(CODE_DIGITS), (F.shiftrightunsigned(id_.cast("long"), 6 * k).bitwiseAND(63) + 1).cast("int"), F.lit(1)) for k in range(10, -1, -1)]
    return F.regexp_replace(F.concat(*digits), "^A+", "")


def username_suffix(name: Column) -> Column:
    trimmed = F.trim(name)
    return F.when(~trimmed.isin("", "None"), F.concat(trimmed, F.lit("/")))


def url_parts(suffix: Column) -> Column:
    """The words of an address, for text search."""
    return F.translate(suffix, "/.?&", "    ")


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def json_or_null(c: Column) -> Column:
    """A variant; text that is not JSON is null."""
    return F.try_parse_json(c)


def bounded_id(c: Column, most: int = 60) -> Column:
    """Longer ids are cut and told apart by a hash."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 9), F.lit("_"), F.substring(F.md5(c.cast("binary")), 1, 8))).otherwise(c)


def is_empty(c: Column, kind: str = "string") -> Column:
    """Null, blank text or an empty list; 0 and false are values."""
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull()
