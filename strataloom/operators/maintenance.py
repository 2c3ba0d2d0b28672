"""Repairs over whole tables: statuses, addresses, identifiers, duplicate sessions and what they left behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.normalize import PAGE_PREFIXES, without_prefix
from strataloom.operators.reconcile import keepers

#: Session statuses by how far they have come.
STATUS_RANKS = {"pending": 0, "parse_failed": 1, "extract_failed": 2, "parsed": 3, "done": 4}
#: Where a failed session starts again.
RETRY = {"parse_failed": "pending", "extract_failed": "parsed"}
#: Kinds of source by their former numbers.
SOURCES = {0: "AA_xlsx", 1: "local_har", 2: "local_wacz"}


def session_status(parsed: Column, extracted: Column, error: Column) -> Column:
    """A session's status from whether it was parsed and extracted and whether an error stands."""
    return (
        F.when(parsed.isNull() & error.isNotNull(), "parse_failed")
        .when(parsed.isNotNull() & extracted.isNull() & error.isNull(), "parsed")
        .when(parsed.isNotNull() & error.isNotNull(), "extract_failed")
        .when(parsed.isNotNull() & extracted.isNotNull() & error.isNull(), "done")
        .otherwise("pending")
    )


def source_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, name in SOURCES.items():
        out = F.when(code == number, name).otherwise(out)
    return out


def thumbnail_status(path: Column, local_url: Column, media_type: Column) -> Column:
    """error for a path that tells one, generated for any other path, not_needed without a local file and for audio, else pending."""
    return F.when(path.startswith("error:"), "error").when(path.isNotNull(), "generated").when(local_url.isNull() | (media_type == "audio"), "not_needed").otherwise("pending")


def kept_status(status: Column, old_url: Column, new_url: Column) -> Column:
    """A thumbnail's status while the file stays the same (two missing ones are the same), else pending."""
    return F.when(old_url.eqNullSafe(new_url), status).otherwise("pending")


def remote_not_needed(media: DataFrame, seen: DataFrame) -> DataFrame:
    """media (media_key, local_url, thumbnail_status) with not_needed for those among seen (media_key) that wait for a thumbnail of a file that is elsewhere."""
    marks = seen.select("media_key", F.lit(True).alias("_seen")).distinct()
    waits = F.col("_seen") & F.col("local_url").startswith("https://") & (F.col("thumbnail_status") == "pending")
    return media.join(marks, "media_key", "left").withColumn("thumbnail_status", F.when(waits, "not_needed").otherwise(F.col("thumbnail_status"))).select(*media.columns)


def requeued(sessions: DataFrame, source: str, retry: Mapping[str, str] = RETRY) -> DataFrame:
    """sessions (id, source, status, error) whose failed ones of a source start again where they failed, without error."""
    new = F.lit(None).cast("string")
    for failed, again in retry.items():
        new = F.when((F.col("source") == source) & (F.col("status") == failed), again).otherwise(new)
    return sessions.withColumn("error", F.when(new.isNull(), F.col("error"))).withColumn("status", F.coalesce(new, "status"))


def repaired_address(url_suffix: Column, data: Column) -> Column:
    """p/<code> where the item's JSON has a code; null for a story that has a post's address; else the address as it is."""
    code, kind = (F.nullif(F.get_json_object(data, f"$.{k}"), F.lit("")) for k in ("code", "product_type"))
    wrong = F.coalesce((F.lower(kind) == "story") & (url_suffix.contains("/p/") | url_suffix.startswith("p/")), F.lit(False))
    return F.when(code.isNotNull(), F.concat(F.lit("p/"), code)).when(~wrong, url_suffix)


def bare_identifiers(identifiers: Column, platform: str = "instagram") -> Column:
    """Identifiers whose addresses have lost the platform's prefix; others, and an address that is nothing but the prefix, stay."""
    prefix = f"url_{PAGE_PREFIXES[platform]}"
    return F.transform(identifiers, lambda i: F.when(i.startswith(prefix) & (F.char_length(i) > len(prefix)), F.concat(F.lit("url_"), without_prefix(i, prefix))).otherwise(i))


def folded_twins(rows: DataFrame, key: str, fold: Column) -> DataFrame:
    """(folded, n): values of key that differ although they fold to the same, and how many there are."""
    return rows.groupBy(fold.alias("folded")).agg(F.count_distinct(key).alias("n")).where("n > 1")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys that several rows share."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def several_copies(copies: DataFrame, key: str, url: str) -> DataFrame:
    """The rows of copies whose key has more than one distinct file."""
    several = copies.groupBy(key).agg(F.count_distinct(url).alias("_n")).where("_n > 1").select(key)
    return copies.join(several, key, "left_semi")


@dataclass(frozen=True)
class Sessions:
    """sessions (id, external_id, status, ...) and the tables of what they saw (canonical_id, session_id, ...)."""

    sessions: DataFrame
    observed: Mapping[str, DataFrame]


def merged_sessions(held: Sessions, fields: Sequence[str]) -> Sessions:
    """Sessions of one external id become the one with the smallest id (see keepers), and what the others saw becomes the kept one's: of several rows of a canonical that of the smallest session stays, rows without a canonical all stay. Sessions without an external id stay."""
    named = held.sessions.where("external_id IS NOT NULL")
    kept = keepers(named, "external_id", "id", STATUS_RANKS, list(fields), own_first=True).drop("merged")
    sessions = held.sessions.where("external_id IS NULL").select("id", "external_id", "status", *fields).unionByName(kept.select("id", "external_id", "status", *fields))
    moves = named.join(kept.select("external_id", F.col("id").alias("keeper")), "external_id").where("id <> keeper").select(F.col("id").alias("session_id"), "keeper")

    def repointed(rows: DataFrame) -> DataFrame:
        new = rows.join(moves, "session_id", "left").withColumn("_was", F.col("session_id")).withColumn("session_id", F.coalesce("keeper", "session_id"))
        single = new.where("canonical_id IS NOT NULL").groupBy("canonical_id", "session_id").agg(F.min("_was").alias("_was"))
        there = new.join(single, ["canonical_id", "session_id", "_was"], "left_semi")
        return there.select(*rows.columns).unionByName(new.where("canonical_id IS NULL").select(*rows.columns))

    return replace(held, sessions=sessions, observed={n: repointed(d) for n, d in held.observed.items()})


def is_sentinel(suffix: Column) -> Column:
    """Empty, or 'None' with or without closing slashes; null is no sentinel."""
    return F.coalesce((suffix == "") | (F.regexp_replace(suffix, "/+$", "") == "None"), F.lit(False))


@dataclass(frozen=True)
class Accounts:
    """accounts (id, url_suffix, post_count, ...), observed (canonical_id, session_id, url_suffix, ...), sessions (id, status, ...) and the tables that name an account in the given column."""

    accounts: DataFrame
    observed: DataFrame
    sessions: DataFrame
    children: Mapping[str, tuple[DataFrame, str]]


def decontaminated(held: Accounts) -> Accounts:
    """Undo what accounts without a name were mixed up by.

    Contaminated are accounts whose own address, or that of one of their observations, is a sentinel. Their
    children are detached, their post counts start from 0, observations with a sentinel go, sentinel addresses
    become null, and the finished sessions that saw them are parsed again.
    """
    seen = held.observed.where(is_sentinel(F.col("url_suffix")) & F.col("canonical_id").isNotNull()).select(F.col("canonical_id").alias("_bad"))
    bad = seen.union(held.accounts.where(is_sentinel(F.col("url_suffix"))).select("id")).distinct().withColumn("_hit", F.lit(True))

    def marked(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(bad, F.col(column) == F.col("_bad"), "left")

    accounts = marked(held.accounts, "id").withColumn("post_count", F.when(F.col("_hit"), 0).otherwise(F.col("post_count")).cast(held.accounts.schema["post_count"].dataType))
    accounts = accounts.withColumn("url_suffix", F.when(~is_sentinel(F.col("url_suffix")), F.col("url_suffix")))
    again = held.observed.join(bad, F.col("canonical_id") == F.col("_bad"), "left_semi").select(F.col("session_id").alias("_session")).distinct().withColumn("_again", F.lit(True))
    sessions = held.sessions.join(again, F.col("id") == F.col("_session"), "left").withColumn("status", F.when(F.col("_again") & (F.col("status") == "done"), "parsed").otherwise(F.col("status")))
    children = {n: (marked(d, c).withColumn(c, F.when(F.col("_hit").isNull(), F.col(c))).select(*d.columns), c) for n, (d, c) in held.children.items()}
    return Accounts(accounts.select(*held.accounts.columns), held.observed.where(~is_sentinel(F.col("url_suffix"))), sessions.select(*held.sessions.columns), children)


@F.pandas_udf(T.BooleanType())
def cut_short(content: pd.Series) -> pd.Series:
    """Whether a fragmented MP4 file ends within the media data that a box announces."""

    def short(data) -> bool:
        at, end = 0, 0 if data is None else len(data)
        while at + 8 <= end:
            size, kind, head = int.from_bytes(data[at : at + 4]), bytes(data[at + 4 : at + 8]), 8
            if size == 1:  # the size follows in eight bytes
                if at + 16 > end:
                    return True
                size, head = int.from_bytes(data[at + 8 : at + 16]), 16
            if size < head:
                return False
            if kind == b"mdat" and at + size > end:
                return True
            at += size
        return False

    return content.map(short)


def file_asset_id(name: Column) -> Column:
    """The asset id in a stored video's name: xpv_<id>.mp4, xpv_<id>_full.mp4 or track_<id>_<name>_<type>.mp4."""
    rest = F.regexp_replace(F.regexp_replace(name, "^.*?track_", ""), "^.*?xpv_", "")
    return F.nullif(F.split_part(F.split_part(rest, F.lit("_"), F.lit(1)), F.lit(".mp4"), F.lit(1)), F.lit(""))


def broken_sessions(sessions: DataFrame, seen: DataFrame, media: DataFrame, files: DataFrame) -> DataFrame:
    """sessions (id, status) in which finished ones that saw media (media_key, local_url) whose file (path, content) is missing or cut short are parsed again; seen (session_id, media_key)."""
    known = files.select(F.col("path").alias("local_url"), cut_short(F.col("content")).alias("short"))
    broken = media.where("local_url IS NOT NULL").join(known, "local_url", "left").where("short IS NULL OR short").select("media_key")
    again = seen.join(broken, "media_key", "left_semi").select(F.col("session_id").alias("_session")).distinct().withColumn("_again", F.lit(True))
    status = F.when(F.col("_again") & (F.col("status") == "done"), "parsed").otherwise(F.col("status"))
    return sessions.join(again, F.col("id") == F.col("_session"), "left").withColumn("status", status).select(*sessions.columns)
