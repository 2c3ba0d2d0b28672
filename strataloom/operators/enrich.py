"""Rows of entities with what belongs to them: accounts, posts, counts, nested trees, threads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_account(rows: DataFrame, accounts: DataFrame, key: str, prefix: str) -> DataFrame:
    """rows with the display name and address of the account that key names, null where there is none."""
    side = accounts.select(F.col("id").alias("_key"), *(F.col(c).alias(f"{prefix}{c}") for c in ("display_name", "url_suffix")))
    return rows.join(side, F.col(key) == F.col("_key"), "left").drop("_key")


def relations_with_ends(relations: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each relation with both its accounts."""
    return with_account(with_account(relations, accounts, "follower_id", "follower_"), accounts, "other_id", "other_")


def with_post_and_author(rows: DataFrame, posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """rows (post_id, account_id) with their account, their post and the post's author."""
    side = posts.select(F.col("id").alias("post_id"), F.col("account_id").alias("author_id"), "publication_date", "caption")
    return with_account(with_account(rows.join(side, "post_id", "left"), accounts, "account_id", "account_"), accounts, "author_id", "author_")


def with_account_and_post(rows: DataFrame, accounts: DataFrame, posts: DataFrame, key: str = "account_id", prefix: str = "account_") -> DataFrame:
    """rows (key, post_id, ...), such as comments, likes or tagged accounts, with the account that key names and the address of the post."""
    side = posts.select(F.col("id").alias("post_id"), F.col("url_suffix").alias("post_url_suffix"))
    return with_account(rows.join(side, "post_id", "left"), accounts, key, prefix)


def interactions(comments: DataFrame, likes: DataFrame, tagged: DataFrame, posts: DataFrame, accounts: DataFrame, of: DataFrame) -> DataFrame:
    """(kind, account_id, post_id, media_key, at, account_display_name, author_id, author_display_name) of all comments, likes and tags of the accounts in of (id), a row each: who made it or is tagged, and the post with its author where there is one."""
    parts = [
        comments.select(F.lit("comment").alias("kind"), "account_id", "post_id", F.lit(None).cast("string").alias("media_key"), F.col("publication_date").alias("at")),
        likes.select(F.lit("like"), "account_id", "post_id", F.lit(None).cast("string"), F.lit(None).cast("timestamp")),
        tagged.select(F.lit("tagged"), "tagged_account_id", "post_id", "media_key", F.lit(None).cast("timestamp")),
    ]
    own = reduce(DataFrame.union, parts).join(of.select(F.col("id").alias("account_id")).distinct(), "account_id", "left_semi")
    rows = with_post_and_author(own, posts, accounts)
    return rows.select("kind", "account_id", "post_id", "media_key", "at", "account_display_name", "author_id", "author_display_name")


def tags_of_others(associations: DataFrame, others: DataFrame, key: str, tags: DataFrame) -> DataFrame:
    """(account_id, tag_id, name, tag_type), once each, of the accounts that a column of others names: who commented, liked, is tagged or is related."""
    some = others.where(F.col(key).isNotNull()).select(F.col(key).alias("account_id")).distinct()
    return associations.join(some, "account_id", "left_semi").distinct().join(tags.select(F.col("id").alias("tag_id"), "name", "tag_type"), "tag_id").select("account_id", "tag_id", "name", "tag_type")


def related_accounts(relations: DataFrame, account_id: int) -> DataFrame:
    """(id) of both ends of all relations of an account, itself included where it has any."""
    own = relations.where((F.col("follower_id") == account_id) | (F.col("other_id") == account_id))
    return own.select(F.explode(F.array("follower_id", "other_id")).alias("id")).where("id IS NOT NULL").distinct()


def post_counts(posts: DataFrame, comments: DataFrame, likes: DataFrame) -> DataFrame:
    """(id, comments, likes) of each post, 0 where it has none."""
    out = posts.select("id")
    for rows, name in ((comments, "comments"), (likes, "likes")):
        out = out.join(rows.groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias(name)), "id", "left")
    return out.na.fill(0)


def account_counts(accounts: DataFrame, relations: DataFrame, comments: DataFrame, likes: DataFrame, tagged: DataFrame) -> DataFrame:
    """(id, relations, comments, likes, tagged_in) of each account, 0 where it has none; a relation with itself counts once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("follower_id", "other_id"))).alias("id"))
    sides = {"relations": ends, "comments": comments.select(F.col("account_id").alias("id")), "likes": likes.select(F.col("account_id").alias("id")), "tagged_in": tagged.select(F.col("tagged_account_id").alias("id"))}
    out = accounts.select("id")
    for name, rows in sides.items():
        out = out.join(rows.groupBy("id").agg(F.count("*").alias(name)), "id", "left")
    return out.na.fill(0)


def session_contents(session_id: object, seen: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, canonical_id, url_suffix) of all that a session saw; seen: by kind, what sessions saw of it (canonical_id, session, url_suffix)."""
    parts = [rows.where(F.col("session") == session_id).select(F.lit(kind).alias("kind"), F.col("canonical_id").cast("string").alias("canonical_id"), "url_suffix") for kind, rows in seen.items()]
    return reduce(DataFrame.union, parts)


def sessions_of_entity(entities: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, session), once each, of the sessions that saw the entities (key); seen (canonical_id, session)."""
    return seen.select(F.col("canonical_id").alias(key), "session").join(entities.select(key).distinct(), key, "left_semi").distinct()


@dataclass(frozen=True)
class Display:
    """What is shown of entities: raw data only where asked for, only media with a local file, only posts with media, only accounts with posts."""

    raw_data: bool = False
    media_with_file: bool = False
    posts_with_media: bool = False
    accounts_with_posts: bool = False

    @classmethod
    def of(cls, asked: Mapping[str, str]) -> Display:
        """From request parameters, of which 1, true and yes switch one on and anything else off; raw data is left out unless its parameter says otherwise."""
        on = lambda name: str(asked.get(name, "")).strip().lower() in ("1", "true", "yes")
        return cls("strip_raw_data" in asked and not on("strip_raw_data"), on("media_with_file"), on("posts_with_media"), on("accounts_with_posts"))


def displayed(accounts: DataFrame, posts: DataFrame, media: DataFrame, how: Display) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables as they are shown; semi-joins only, so nothing is gathered."""
    if how.media_with_file:
        media = media.where(F.trim(F.coalesce("local_url", F.lit(""))) != "")
    if how.posts_with_media:
        posts = posts.join(media.select(F.col("post_id").alias("id")).distinct(), "id", "left_semi")
    if how.accounts_with_posts:
        accounts = accounts.join(posts.select(F.col("account_id").alias("id")).distinct(), "id", "left_semi")
    bare = lambda d: d if how.raw_data or "data" not in d.columns else d.withColumn("data", F.lit(None).cast(d.schema["data"].dataType))
    return bare(accounts), bare(posts), bare(media)


def by_relations(accounts: DataFrame, counts: DataFrame, over: int | None = None, under: int | None = None, with_posts: bool | None = None) -> DataFrame:
    """accounts (id) by their counts (id, post_count, relations; none is 0): strictly over and under numbers of relations, and with posts (True), without (False) or either (None)."""
    out = accounts.join(counts, "id", "left").na.fill(0, ["post_count", "relations"])
    tests = [F.col("relations") > over if over is not None else None, F.col("relations") < under if under is not None else None, (F.col("post_count") > 0) == with_posts if with_posts is not None else None]
    return reduce(DataFrame.where, [t for t in tests if t is not None], out)


def tree_sizes(accounts: DataFrame, posts: DataFrame, media: DataFrame) -> DataFrame:
    """(id, n_posts, n_media, newest_post) of the trees account > posts > media of accounts with posts, by partial sums, without building any tree."""
    per_post = media.groupBy("post_id").agg(F.count("*").alias("n"))
    sized = posts.select("id", "account_id", "publication_date").join(per_post, posts["id"] == per_post["post_id"], "left")
    newest = F.max_by("id", F.struct("publication_date", -F.col("id"))).alias("newest_post")
    found = sized.groupBy("account_id").agg(F.count("*").alias("n_posts"), F.sum(F.coalesce("n", F.lit(0))).alias("n_media"), newest)
    return accounts.select("id").join(found, F.col("id") == F.col("account_id")).select("id", "n_posts", "n_media", "newest_post")


def activity_counts(accounts: DataFrame, relations: DataFrame, likes: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, posts, likes_given, likes_received, relations) of each account, 0 where it has none."""
    made = posts.groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("posts"))
    given = likes.groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("likes_given"))
    per_post = likes.groupBy("post_id").agg(F.count("*").alias("n"))  # reduced before it meets the posts
    received = per_post.join(posts.select(F.col("id").alias("post_id"), F.col("account_id").alias("owner")), "post_id").groupBy(F.col("owner").alias("id")).agg(F.sum("n").alias("likes_received"))
    # a relation counts for both its ends, one with itself once
    ends = relations.select(F.explode(F.array_distinct(F.array("follower_id", "other_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("relations"))
    out = accounts.select("id")
    for side in (made, given, received, ends):
        out = out.join(side, "id", "left")
    return out.na.fill(0)


def sessions_of(accounts: DataFrame, observations: DataFrame) -> DataFrame:
    """The distinct sessions that saw each account."""
    return accounts.select(F.col("id").alias("account_id")).join(observations.select(F.col("canonical_id").alias("account_id"), "session").distinct(), "account_id")


def nested(accounts: DataFrame, posts: DataFrame, media: DataFrame, only_with_file: bool = False) -> DataFrame:
    """accounts with their posts, newest first, and within them their media: array<struct<id, publication_date, media>>.

    The trees are built bottom-up, one shuffle a level. only_with_file leaves out media without a local file
    and posts left without media.
    """
    held = media.where("local_url IS NOT NULL") if only_with_file else media
    per_post = held.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("media_key", "media_type", "local_url"))).alias("media"))
    dated = posts.join(per_post, posts["id"] == per_post["post_id"], "inner" if only_with_file else "left")
    post = F.struct("id", "publication_date", F.coalesce("media", F.array().cast(per_post.schema["media"].dataType)).alias("media"))
    trees = dated.groupBy("account_id").agg(F.collect_list(post).alias("posts"))
    newest = F.array_sort("posts", lambda a, b: F.when(a["publication_date"] != b["publication_date"], F.when(a["publication_date"] > b["publication_date"], -1).otherwise(1)).otherwise(F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
    return accounts.join(trees.withColumn("posts", newest), accounts["id"] == trees["account_id"], "left").drop("account_id")


@dataclass(frozen=True)
class Side:
    """Rows (post_id, account, ...) shown under posts: the column of the account, the columns of a row that are shown, and the order (what differs in none of these columns is shown alike)."""

    rows: DataFrame
    account: str
    columns: tuple[str, ...]
    order: tuple[str, ...]


def posts_with(posts: DataFrame, accounts: DataFrame, sides: Mapping[str, Side], most: int = 50) -> DataFrame:
    """posts (id, ...) with, for each side, an array of the first `most` of its rows (with the account's name and address) and n_<side>, how many there are in all.

    A post that very many rows share stays bounded: numbers are summed before they move, and Spark keeps the first rows
    of a post in each task before it shuffles them. Meant for a page of posts or a session's; without posts nothing is returned.
    """
    ids, out = posts.select(F.col("id").alias("post_id")).distinct(), posts
    for name, side in sides.items():
        own = side.rows.join(ids, "post_id", "left_semi")
        counts = own.groupBy(F.col("post_id").alias("_p")).agg(F.count("*").alias(f"n_{name}"))
        first = own.withColumn("_place", F.row_number().over(W.partitionBy("post_id").orderBy(*side.order))).where(F.col("_place") <= most)
        named = with_account(first, accounts, side.account, "account_")
        shown = F.struct("_place", F.col(side.account).alias("account_id"), "account_display_name", "account_url_suffix", *side.columns)
        lists = named.groupBy(F.col("post_id").alias("_l")).agg(F.array_sort(F.collect_list(shown)).alias(name))
        out = out.join(counts, F.col("id") == F.col("_p"), "left").join(lists, F.col("id") == F.col("_l"), "left").drop("_p", "_l")
        out = out.withColumns({f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)).cast("long"), name: F.coalesce(name, F.array().cast(lists.schema[name].dataType))})
    return out


def threads(comments: DataFrame, thread: str, item: str, parent: str, at: str) -> DataFrame:
    """comments with `place` (from 1) within each thread: by time, every top comment followed by its replies; replies without their parent last.

    A thread's order is worked out within the thread. Null times come first.
    """
    top = comments.select(F.col(thread).alias("_t"), F.col(item).alias("_p"), F.col(at).alias("parent_at")).where(F.col(item).isNotNull())
    known = comments.join(top, (F.col(thread) == F.col("_t")) & (F.col(parent) == F.col("_p")), "left")
    orphan = F.col(parent).isNotNull() & F.col("_p").isNull()
    lead = F.when(F.col("_p").isNotNull(), F.col("parent_at")).otherwise(F.col(at))
    group = F.when(F.col("_p").isNotNull(), F.col(parent)).otherwise(F.col(item))
    order = [orphan.asc(), lead.asc_nulls_first(), group.asc(), F.col("_p").isNotNull().asc(), F.col(at).asc_nulls_first(), F.col(item).asc()]
    return known.withColumn("orphan", orphan).withColumn("place", F.row_number().over(W.partitionBy(thread).orderBy(*order)).cast("long")).drop("_t", "_p", "parent_at")


def shortened(text: Column, most: int = 100) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def shared_scope(accounts: DataFrame, posts: DataFrame, media: DataFrame) -> DataFrame:
    """(kind, id) of all that sharing the accounts (id) gives access to: the accounts, their posts and their media."""
    own = accounts.select(F.lit("account").alias("kind"), F.col("id").cast("string").alias("id"))
    shared_posts = posts.join(accounts.select(F.col("id").alias("account_id")), "account_id", "left_semi")
    under = media.join(shared_posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return own.union(shared_posts.select(F.lit("post"), F.col("id").cast("string"))).union(under.select(F.lit("media"), "media_key"))


def redacted(metadata: DataFrame, column: str, censored: list[str]) -> DataFrame:
    """metadata with the named keys of a map column blanked, and the list of those it had."""
    hit = F.array_intersect(F.map_keys(column), F.array(*map(F.lit, censored)))
    blank = F.transform_values(column, lambda k, v: F.when(k.isin(*censored), F.lit("[redacted]")).otherwise(v))
    return metadata.withColumn("redacted", F.array_sort(hit)).withColumn(column, blank)


def shared_with(account_ids: DataFrame, post_ids: DataFrame, media_keys: DataFrame, posts: DataFrame, media: DataFrame, parts: DataFrame) -> DataFrame:
    """(kind, id), once each, of all that shares of accounts (id), posts (id) and media (media_key) give access to: account, its posts, their media, their parts (part_id, media_key)."""
    reach_posts = posts.join(account_ids.select(F.col("id").alias("account_id")).distinct(), "account_id", "left_semi").select("id").union(posts.join(post_ids.distinct(), "id", "left_semi").select("id")).distinct()
    reach_media = media.join(reach_posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").select("media_key").union(media.join(media_keys.distinct(), "media_key", "left_semi").select("media_key")).distinct()
    reach_parts = parts.join(reach_media, "media_key", "left_semi").select("part_id").distinct()
    levels = (("account", account_ids.distinct()), ("post", reach_posts), ("media", reach_media), ("media_part", reach_parts))
    return reduce(DataFrame.union, (d.select(F.lit(kind).alias("kind"), F.col(d.columns[0]).cast("string").alias("id")) for kind, d in levels))


def without_attachments(sessions: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """sessions whose attachments (array of structs with a kind) have lost the named kinds, and `withheld`, the sorted list of those there were."""
    gone = F.array_sort(F.array_distinct(F.transform(F.filter(column, lambda a: a["kind"].isin(*kinds)), lambda a: a["kind"])))
    return sessions.withColumn("withheld", gone).withColumn(column, F.filter(column, lambda a: ~a["kind"].isin(*kinds)))
