"""Search over sessions, accounts, posts and media: text, filters, tags, order and page, then what a result shows."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import fulltext
from strataloom.functions.normalize import full_url, url_parts
from strataloom.functions.predicates import Searchable, ordering, page, predicate
from strataloom.operators.enrich import shortened
from strataloom.operators.graph import newest_files, thumbnail
from strataloom.operators.lineage import checkpointed
from strataloom.operators.tags import Tagged, tag_filter
from strataloom.operators.wordindex import WordIndex

ADDRESS = re.compile(r"(?is)^(?:https?://)?(?:www\.)?instagram\.com/+([^?#]+)|^(?:https?://)?scontent[^/]*\.cdninstagram\.com/v/([^?]+)")
HANDLE = re.compile(r"[A-Za-z0-9._]{1,30}")


@dataclass(frozen=True)
class Request:
    """What a user asks for. mode: archive_sessions, accounts, posts or media; filters: a rule of functions.predicates."""

    mode: str
    term: str | None = None
    filters: Mapping | None = None
    page_number: int = 1
    page_size: int = 20
    tag_ids: tuple[int, ...] = ()
    tag_mode: str = "any"
    tag_scopes: tuple[str, ...] = ()
    sort_by: str | None = None
    sort_order: str | None = None


@dataclass(frozen=True)
class Library:
    """The tables that are searched.

    accounts (id, url_suffix, platform, display_name, bio, identifiers), posts (id, url_suffix, platform,
    id_on_platform, caption, publication_date, account_id), media (media_key, url_suffix, platform, annotation,
    thumbnail_path, local_url, media_type, publication_date, post_id, account_id), sessions (id, url_suffix, platform,
    notes, archived_at), session_media (session_id, media_key).
    """

    accounts: DataFrame
    posts: DataFrame
    media: DataFrame
    sessions: DataFrame
    session_media: DataFrame
    tagged: Tagged | None = None
    #: Word indexes by table. A table without one is read and split in full by every word search.
    indexes: Mapping[str, WordIndex] = field(default_factory=dict)


@dataclass(frozen=True)
class Mode:
    """How one kind of entity is searched: its table and id, the columns of its word index, the columns that filters and orders may name, and its default order."""

    table: str
    id: str
    words: tuple[str, ...]
    filters: Searchable
    orders: Searchable
    newest: str
    ranked: bool = False
    entity: str | None = None


TEXT, NUMBER, DATE = "text", "number", "date"
MODES = {
    "archive_sessions": Mode("sessions", "id", ("url_suffix", "notes"), Searchable({"id": NUMBER, "url_suffix": TEXT, "notes": TEXT, "archived_at": DATE}), Searchable({}), "archived_at"),
    "accounts": Mode(
        "accounts", "id", ("url_suffix", "bio", "display_name"), Searchable({"id": NUMBER, "url_suffix": TEXT, "url": TEXT, "display_name": TEXT, "bio": TEXT}, {"url": "url_suffix"}),
        Searchable({"id": NUMBER, "url_suffix": TEXT, "display_name": TEXT}), "id", True, "account",
    ),
    "posts": Mode(
        "posts", "id", ("url_suffix", "caption"), Searchable({"id": NUMBER, "url_suffix": TEXT, "url": TEXT, "account_id": NUMBER, "caption": TEXT, "publication_date": DATE}, {"url": "url_suffix"}),
        Searchable({"id": NUMBER, "publication_date": DATE}), "publication_date", True, "post",
    ),
    "media": Mode(
        "media", "media_key", ("annotation",), Searchable({"media_key": TEXT, "annotation": TEXT, "media_type": TEXT, "account_id": NUMBER, "post_id": NUMBER, "publication_date": DATE}),
        Searchable({"media_key": TEXT, "publication_date": DATE}), "media_key", False, "media",
    ),
}


def address_of(term: str | None) -> tuple[str, str] | None:
    """(platform, suffix) of a term that is an address of a known platform."""
    found = ADDRESS.match((term or "").strip())
    suffix = (found[1] or found[2]).strip("/").strip() if found else ""
    return ("instagram", suffix) if suffix else None


def handle_of(term: str | None) -> str | None:
    """The account's name in '@name', 'name' or 'name/...'; None for addresses, names with a dot and other text."""
    text = (term or "").strip().removeprefix("@")
    first = text.split("/")[0]
    if "://" in text or text.lower().startswith("www.") or "." in first:
        return None
    name = re.split("[?#]", first)[0].strip()
    return name if HANDLE.fullmatch(name) else None


def indexed(mode: Mode) -> Column:
    """The words of a row's indexed columns; an address gives its parts."""
    return fulltext.tokens(*(url_parts(F.col(c)) if c == "url_suffix" else F.col(c) for c in mode.words))


def matching(request: Request, rows: DataFrame, mode: Mode, index: WordIndex | None = None) -> tuple[DataFrame, Column | None]:
    """The rows that meet the term, and by what they are ranked where that is a word search."""
    term, address = request.term, address_of(request.term)
    if address:
        at = (F.col("platform") == address[0]) & (F.col("url_suffix") == address[1])
        if mode.table == "accounts":
            at = at | F.array_contains("identifiers", f"url_{address[1]}")
        return rows.where(F.coalesce(at, F.lit(False))), None
    if mode.table == "media":
        rows = rows.where("local_url IS NOT NULL")
    if not term or not term.strip():
        return rows, None
    handle = handle_of(term) if mode.table == "accounts" else None
    asked = fulltext.boolean_query(handle or term)
    # stored with and without a closing slash
    named = F.coalesce(F.arrays_overlap("identifiers", F.array(F.lit(f"url_{handle}"), F.lit(f"url_{handle}/"))), F.lit(False)) if handle else F.lit(False)
    if index is not None:
        hits = index.matching(asked).select(F.col("id").alias("_id"), F.col("relevance").alias("_rank"))
        there = rows.join(hits, rows[mode.id] == hits["_id"], "left" if handle else "inner")
        if handle:  # a row that only its name finds still holds some of the words
            there = there.where(F.col("_id").isNotNull() | named).withColumn("_rank", F.coalesce("_rank", fulltext.relevance(asked, indexed(mode))))
        return there.drop("_id"), F.col("_rank").desc() if mode.ranked else None
    there = rows.withColumn("_words", indexed(mode))
    hit = fulltext.matches(asked, F.col("_words")) | named
    return there.where(hit).withColumn("_rank", fulltext.relevance(asked, F.col("_words"))).drop("_words"), F.col("_rank").desc() if mode.ranked else None


def found(request: Request, library: Library) -> DataFrame:
    """One page of the table that the mode searches, with `place`; filters and the semi-join to the tags come before the top-k."""
    mode = MODES[request.mode]
    rows, ranked = matching(request, getattr(library, mode.table), mode, library.indexes.get(mode.table))
    if request.filters:
        rows = rows.where(predicate(request.filters, mode.filters))
    if request.tag_ids and mode.entity:
        some = tag_filter(library.tagged, mode.entity, list(request.tag_ids), request.tag_mode, list(request.tag_scopes))
        rows = rows.join(some, rows[mode.id] == some["matched_id"], "left_semi")
    order = ordering(request.sort_by, request.sort_order, mode.orders, F.col(mode.newest).desc() if ranked is None else ranked, mode.id)
    top = page(rows, order, request.page_number, request.page_size)
    held = top.groupBy().agg(F.collect_list(F.struct(*(c for c in top.columns if c != "_rank"))).alias("rows"))  # one page, in its order
    first = (request.page_number - 1) * request.page_size
    return held.select(F.posexplode("rows").alias("at", "row")).select((F.col("at") + 1 + first).cast("long").alias("place"), "row.*")


def pictures(files: DataFrame, key: str) -> DataFrame:
    """(key, thumbnails, media_count) of ranked files."""
    src = F.transform(F.array_sort(F.collect_list(F.struct("rn", thumbnail(F.col("thumbnail_path"), F.col("local_url")).alias("src")))), lambda t: t["src"])
    return files.groupBy(key).agg(src.alias("thumbnails"), F.max("media_count").alias("media_count"))


def shown(rows: DataFrame, kind: str, id_: str, title: Column, details: Column, **metadata: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    pairs = [x for k, c in metadata.items() for x in (F.lit(k), c.cast("string"))]
    return rows.select("place", F.lit(kind).alias("page"), F.col(id_).cast("string").alias("id"), title.alias("title"), details.alias("details"), F.coalesce("thumbnails", none).alias("thumbnails"), F.create_map(*pairs).alias("metadata"))


def results(request: Request, library: Library) -> DataFrame:
    """(place, page, id, title, details, thumbnails, metadata) of one page of results. Unknown modes have none.

    Titles are addresses, or what else names the entity; captions are cut to 100 characters. Of sessions 4
    thumbnails are shown, of accounts the 8 newest, of posts all.
    """
    if request.mode not in MODES:
        request = Request("accounts", page_size=0)
    rows = F.broadcast(checkpointed(found(request, library)))  # one page, worked out once for all that is joined to it
    media = library.media.where("local_url IS NOT NULL")
    owner = library.accounts.select(F.col("id").alias("account_id"), F.col("display_name").alias("_name"), F.col("url_suffix").alias("_suffix"), F.col("platform").alias("_platform"))
    url, account_url = full_url(F.col("url_suffix"), F.col("platform")), full_url(F.col("_suffix"), F.col("_platform"))
    if request.mode == "archive_sessions":
        seen = library.session_media.join(F.broadcast(rows.select(F.col("id").alias("session_id"))), "session_id", "left_semi")
        files = pictures(newest_files(seen.join(media.drop("session_id"), "media_key"), "session_id", 4, [F.col("media_key")]), "session_id")
        out = rows.join(files, F.col("id") == F.col("session_id"), "left")
        title = F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("Archive Session "), "id"))
        return shown(out, "archive", "id", title, F.coalesce("notes", F.lit("")), archiving_timestamp=F.col("archived_at"), media_count=F.coalesce("media_count", F.lit(0)))
    if request.mode == "accounts":
        own = media.join(F.broadcast(rows.select(F.col("id").alias("account_id"))), "account_id", "left_semi")
        files = pictures(newest_files(own, "account_id", 8, [F.desc("publication_date"), F.col("media_key")]), "account_id")
        out = rows.join(files, F.col("id") == F.col("account_id"), "left")
        names = {"display_name": F.nullif("display_name", F.lit("")), "url_suffix": F.nullif("url_suffix", F.lit(""))}
        return shown(out, "account", "id", F.coalesce(url, F.lit("")), F.coalesce("bio", F.lit("")), media_count=F.coalesce("media_count", F.lit(0)), **names)
    if request.mode == "posts":
        own = library.media.join(F.broadcast(rows.select(F.col("id").alias("post_id"))), "post_id", "left_semi").where(thumbnail(F.col("thumbnail_path"), F.col("local_url")).isNotNull())
        src = F.transform(F.array_sort(F.collect_list(F.struct("media_key", thumbnail(F.col("thumbnail_path"), F.col("local_url")).alias("src")))), lambda t: t["src"])
        out = rows.join(own.groupBy("post_id").agg(src.alias("thumbnails")), F.col("id") == F.col("post_id"), "left").join(owner, "account_id", "left")
        title = F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("item "), "id_on_platform"))
        return shown(out, "post", "id", title, F.coalesce(shortened(F.col("caption")), F.lit("")), publication_date=F.col("publication_date"), account_display_name=F.col("_name"), account_url=account_url)
    both = F.array_compact(F.array(thumbnail(F.col("thumbnail_path"), F.col("local_url")), F.col("local_url")))
    out = rows.join(owner, "account_id", "left").withColumn("thumbnails", both)
    return shown(out, "media", "media_key", F.coalesce(account_url, F.lit("")), F.lit(""), publication_date=F.col("publication_date"), account_display_name=F.col("_name"), account_url=account_url, media_type=F.col("media_type"))
