"""Captured JSON payloads as streams of flat entities.

A payload is text; its kind shows in the keys it has. Each kind names where its items lie; one description of
an item then gives posts, media, accounts and tagged accounts, whichever kind it came in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.normalize import cdn_filename, like_id, relation_id, shortcode, tagged_id
from strataloom.operators.lineage import staged
from strataloom.operators.reconcile import full
from strataloom.operators.resolve import linked
from strataloom.sources.captures import body_bytes, page_scripts, values_at_key

USER = "struct<pk: string, id: string, username: string, full_name: string, biography: string>"
IMAGES = "struct<candidates: array<struct<url: string, width: int, height: int>>>"
VIDEOS = "array<struct<url: string, width: int, height: int>>"
TAGS = f"struct<`in`: array<struct<user: {USER}, position: array<double>>>>"
CHILD = f"struct<pk: string, id: string, media_type: int, image_versions2: {IMAGES}, video_versions: {VIDEOS}, usertags: {TAGS}>"
STICKERS = "array<struct<bloks_sticker: struct<sticker_data: struct<ig_mention: struct<username: string, full_name: string>>>>>"
ITEM = f"""struct<pk: string, id: string, code: string, shortcode: string, taken_at: long, media_type: int, caption: struct<text: string>,
  user: {USER}, owner: {USER}, image_versions2: {IMAGES}, video_versions: {VIDEOS}, usertags: {TAGS}, carousel_media: array<{CHILD}>, story_bloks_stickers: {STICKERS}>"""
REEL = f"struct<id: string, reel_type: string, user: {USER}>"
REEL_NODE = f"struct<id: string, reel_type: string, user: {USER}, items: array<{ITEM}>>"
COMMENT = f"struct<pk: string, id: string, text: string, created_at: long, parent_comment_id: string, user: {USER}>"
#: Keys of payloads without posts, under data. Fixed values.
COMMENTS, LIKERS, CHAINING = "xdt_api__v1__media__media_id__comments__connection", "xdt_api__v1__likes__media_id__likers", "xdt_api__v1__discover__chaining"


@dataclass(frozen=True)
class Payload:
    """Where the items of a payload kind lie: the keys that lead there, the schema of what lies under them, and SQL over it (as v) for an array of items or of (item, reel). dated: whether date, caption and the post's own tags are taken from it."""

    keys: tuple[str, ...]
    schema: str
    items: str
    reels: bool = False
    dated: bool = True


def in_reels(nodes: str) -> str:
    """SQL for the items of reels, each with its reel."""
    return f"flatten(transform({nodes}, n -> transform(coalesce(n.items, array()), i -> named_struct('item', i, 'reel', named_struct('id', n.id, 'reel_type', n.reel_type, 'user', n.user)))))"


EDGES, REELS = f"struct<edges: array<struct<node: {ITEM}>>>", f"struct<edges: array<struct<node: {REEL_NODE}>>>"
#: Kinds of payloads with post-like items. The keys that tell each. Of a feed of stories the first reel counts.
KINDS = {
    "timeline": Payload(("data", "xdt_api__v1__feed__user_timeline_graphql_connection"), EDGES, "v.edges.node"),
    "post": Payload(("data", "xdt_api__v1__media__shortcode__web_info"), f"struct<items: array<{ITEM}>>", "v.items"),
    "reels": Payload(("data", "xdt_api__v1__feed__reels_media__connection"), REELS, in_reels("v.edges.node"), reels=True),
    "stories": Payload(("data", "xdt_api__v1__feed__reels_media"), f"struct<reels_media: array<{REEL_NODE}>>", in_reels("slice(v.reels_media, 1, 1)"), reels=True),
    "clips": Payload(("data", "xdt_api__v1__clips__user__connection_v2"), f"struct<edges: array<struct<node: struct<media: {ITEM}>>>>", "v.edges.node.media", dated=False),
    "page_timeline": Payload(("xdt_api__v1__profile_timeline",), f"struct<profile_timeline_items: array<{ITEM}>>", "v.profile_timeline_items", dated=False),
    "api_media": Payload(("items",), f"array<{ITEM}>", "v"),
}


def merged_shape() -> str:
    """One schema that holds every payload kind, so that a payload is parsed once whatever is in it. A part of another form than its kind's is null and leaves the others as they are."""
    under = {p.keys[1]: p.schema for p in KINDS.values() if p.keys[0] == "data"}
    under |= {COMMENTS: f"struct<edges: array<struct<node: {COMMENT}>>>", LIKERS: f"struct<users: array<{USER}>>", CHAINING: f"struct<users: array<{USER}>>", "user": USER}
    top = {p.keys[0]: p.schema for p in KINDS.values() if p.keys[0] != "data"} | {"comments": f"array<{COMMENT}>", "users": f"array<{USER}>"}
    return f"struct<data: struct<{', '.join(f'{k}: {v}' for k, v in under.items())}>, {', '.join(f'{k}: {v}' for k, v in top.items())}>"


def parsed(payloads: DataFrame) -> DataFrame:
    """payloads with their json as `p`; text that is no JSON gives null."""
    return payloads.withColumn("p", F.from_json("json", merged_shape())).drop("json")


def with_at(rows: DataFrame) -> DataFrame:
    """rows with `at`, '' for payloads that come without an order."""
    return rows if "at" in rows.columns else rows.withColumn("at", F.lit(""))


def below(place: Column) -> Column:
    """The order of the place-th part of what `at` orders."""
    return F.concat("at", F.lit("/"), F.lpad(place.cast("string"), 10, "0"))


def items_of(payloads: DataFrame) -> DataFrame:
    """payloads' columns but json or p, and (kind, place, item, reel, dated), of the post-like items in payloads (source, json or p). A payload that cannot be read, or of no known kind, gives none; one may hold several kinds."""
    rows = payloads if "p" in payloads.columns else payloads.withColumn("p", F.from_json("json", merged_shape())).drop("json")

    def of(kind: str, p: Payload) -> str:
        found = re.sub(r"\bv\b", ".".join(("p", *p.keys)), p.items)
        item, reel = ("x.item", "x.reel") if p.reels else ("x", f"cast(NULL AS {REEL})")
        made = f"transform({found}, (x, k) -> named_struct('kind', '{kind}', 'place', k, 'item', {item}, 'reel', {reel}, 'dated', {str(p.dated).lower()}))"
        return f"coalesce({made}, array())"

    each = with_at(rows).select("*", F.posexplode(F.expr(f"concat({', '.join(of(k, p) for k, p in KINDS.items())})")).alias("nth", "x")).drop("p")
    return each.withColumn("at", below(F.col("nth"))).select("*", "x.*").drop("x", "nth").where("item IS NOT NULL")


def reel_suffix(post: Column) -> Column:
    """The address of a reel's item: a highlight's where its reel says so or is not named after its user, else a story's; null outside reels."""
    reel = F.col("reel")
    own = F.element_at(F.split(reel["id"], ":"), -1)
    highlight = (F.coalesce(reel["reel_type"], F.lit("")) == "highlight_reel") | ~own.eqNullSafe(F.coalesce(reel["user"]["pk"], reel["user"]["id"]))
    highlight = F.when(F.col("kind") == "stories", False).otherwise(highlight)
    return F.when(reel.isNotNull(), F.when(highlight, F.concat(F.lit("s/"), own, F.lit("/?story_media_id="), post)).otherwise(F.concat(F.lit("stories/"), reel["user"]["username"], F.lit("/"), post, F.lit("/"))))


def asset_url(item: Column) -> Column:
    """The first video, else the first image."""
    return F.coalesce(F.get(item["video_versions"]["url"], F.lit(0)), F.get(item["image_versions2"]["candidates"]["url"], F.lit(0)))


def item_post(item: Column) -> Column:
    return F.coalesce(item["pk"], item["id"])


def owner(item: Column) -> Column:
    """The user of the item's reel, else its own user, else its owner."""
    return F.coalesce(F.col("reel.user"), item["user"], item["owner"])


def post_rows(items: DataFrame) -> DataFrame:
    i = F.col("item")
    code = F.coalesce(i["code"], i["shortcode"], F.when(i["pk"].rlike("^[0-9]{1,18}$"), shortcode(F.try_to_number(i["pk"], F.lit("9" * 18)).cast("long"))))
    return items.select(
        "source",
        "at",
        item_post(i).alias("id_on_platform"),
        F.coalesce(reel_suffix(item_post(i)), F.concat(F.lit("p/"), code)).alias("url_suffix"),
        F.coalesce(owner(i)["pk"], owner(i)["id"]).alias("account_id"),
        named(owner(i)).alias("account_url_suffix"),
        F.when(F.col("dated"), F.timestamp_seconds(i["taken_at"])).alias("publication_date"),
        F.when(F.col("dated"), i["caption"]["text"]).alias("caption"),
    )


def media_rows(items: DataFrame) -> DataFrame:
    """The item's own medium and one for each carousel child: a parent is a video if it has video versions, a child is an image if its type is 1."""
    i = F.col("item")
    own = F.struct(i["id"].alias("id"), asset_url(i).alias("url"), F.when(F.size(F.coalesce(i["video_versions"], F.array().cast(VIDEOS))) > 0, "video").otherwise("image").alias("media_type"))
    child = lambda c: F.struct(c["id"].alias("id"), asset_url(c).alias("url"), F.when(c["media_type"] == 1, "image").otherwise("video").alias("media_type"))
    children = F.coalesce(F.transform(i["carousel_media"], child), F.array().cast("array<struct<id: string, url: string, media_type: string>>"))
    rows = items.select("source", "at", item_post(i).alias("post_id"), F.posexplode(F.concat(F.array(own), children)).alias("nth", "m"))
    return rows.select("source", below(F.col("nth")).alias("at"), "post_id", F.col("m.id").alias("id_on_platform"), "m.url", cdn_filename(F.col("m.url")).alias("url_suffix"), "m.media_type")


def account_row(user: str) -> list[Column]:
    u = F.col(user)
    return [F.coalesce(u["pk"], u["id"]).alias("id_on_platform"), F.concat(F.nullif(u["username"], F.lit("None")), F.lit("/")).alias("url_suffix"), u["full_name"].alias("display_name"), F.substring(u["biography"], 1, 200).alias("bio")]


def tagged(items: DataFrame) -> DataFrame:
    """(source, at, post_id, media_id, user, x, y) of the user tags of the items and of their carousel children."""
    i = F.col("item")
    own = items.where("dated").select("source", "at", item_post(i).alias("post_id"), i["id"].alias("media_id"), F.posexplode(i["usertags"]["in"]).alias("nth", "t"))
    child = items.select("source", "at", item_post(i).alias("post_id"), F.explode(i["carousel_media"]).alias("c"))
    child = child.select("source", "at", "post_id", F.col("c.id").alias("media_id"), F.posexplode(F.col("c.usertags")["in"]).alias("nth", "t"))
    tags = own.unionByName(child).select("source", below(F.col("nth")).alias("at"), "post_id", "media_id", F.col("t.user").alias("user"), F.get("t.position", F.lit(0)).alias("x"), F.get("t.position", F.lit(1)).alias("y"))
    # mentions on story stickers have a name only
    mention = items.select("source", "at", item_post(i).alias("post_id"), F.explode(i["story_bloks_stickers"]["bloks_sticker"]["sticker_data"]["ig_mention"]).alias("m")).where("m IS NOT NULL")
    none = F.lit(None).cast("string")
    user = F.struct(none.alias("pk"), none.alias("id"), F.col("m.username").alias("username"), F.col("m.full_name").alias("full_name"), none.alias("biography"))
    return tags.unionByName(mention.select("source", "at", "post_id", none.alias("media_id"), user.alias("user"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))


def flattened(payloads: DataFrame) -> dict[str, DataFrame]:
    """The streams of post-like items in payloads (source, json): accounts, posts, media, tagged_accounts, each with the order `at` of its rows. The items are worked out once."""
    items = staged(items_of(payloads))
    tags = tagged(items)
    owners = items.select("source", "at", owner(F.col("item")).alias("user")).unionByName(tags.select("source", "at", "user")).where("user IS NOT NULL")
    account, name = F.coalesce(F.col("user.pk"), F.col("user.id")), F.concat(F.col("user.username"), F.lit("/"))
    return {
        "accounts": owners.select("source", "at", *account_row("user")),
        "posts": post_rows(items),
        "media": media_rows(items),
        "tagged_accounts": tags.select("source", "at", tagged_id(F.lit(None).cast("string"), account, name, F.col("post_id"), F.col("media_id")).alias("id_on_platform"), account.alias("tagged_account_id"), name.alias("tagged_url_suffix"), "post_id", "media_id", "x", "y"),
    }


#: Keys that page scripts hold anywhere, and whether they stand under data in a payload. Fixed values.
PAGE_POST = "xdt_api__v1__media__shortcode__web_info"
PAGE_KEYS = {PAGE_POST: True, "xdt_api__v1__profile_timeline": False, "xdt_api__v1__feed__reels_media__connection": True, "xdt_api__v1__feed__reels_media": True, COMMENTS: True}


def ordered(*places: Column) -> Column:
    """A text that sorts as the numbers do, one after another."""
    return F.concat_ws("/", *(F.lpad(F.coalesce(p, F.lit(0)).cast("string"), 20, "0") for p in places))


def page_payloads(pages: DataFrame) -> DataFrame:
    """(source, url, context_id, target_id, json, at): payloads in the scripts of pages (source, url, html, and place where it is known), each under the key where responses have it. context_id is the page's post, which its comments belong to; at orders the payloads of a source."""
    place = F.col("place") if "place" in pages.columns else F.lit(0)
    blocks = pages.select("source", "url", place.alias("place"), F.posexplode(page_scripts(F.col("html"))).alias("block", "script"))
    keys = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("data")) for k, d in PAGE_KEYS.items()))
    held = blocks.withColumn("k", F.explode(keys)).where(F.col("script").contains(F.col("k.key")))
    values = held.select("source", "url", "k", "place", "block", F.posexplode(values_at_key(F.col("script"), F.col("k.key"))).alias("nth", "v")).where(F.col("v").startswith("{"))
    inner = F.concat(F.lit('{"'), F.col("k.key"), F.lit('": '), F.col("v"), F.lit("}"))
    made = values.withColumn("json", F.when(F.col("k.data"), F.concat(F.lit('{"data": '), inner, F.lit("}"))).otherwise(inner))
    posts = made.where(F.col("k.key") == PAGE_POST).groupBy("source", "url").agg(F.max(F.get_json_object("v", "$.items[0].pk")).alias("context_id"))
    return made.join(posts, ["source", "url"], "left").select("source", "url", "context_id", F.lit(None).cast("string").alias("target_id"), "json", ordered(F.col("place"), F.col("block"), F.col("nth")).alias("at"))


def response_payloads(entries: DataFrame) -> DataFrame:
    """(source, url, context_id, target_id, json, at) of routed HAR entries, at as their places order them: GraphQL and API responses as they are, pages through page_payloads. The post of comments and likes, and the account of suggestions, come from the request's variables or address."""
    url, body = F.col("request.url"), body_bytes(F.col("response.content")).cast("string")
    variables = F.get(F.filter("request.postData.params", lambda p: p["name"] == "variables"), F.lit(0))["value"]
    in_url = F.nullif(F.regexp_extract(url, r"media/([^/?]+)", 1), F.lit(""))
    asked = entries.where("route IN ('graphql', 'api')").select(
        "source", url.alias("url"), F.when(F.col("route") == "graphql", F.get_json_object(variables, "$.media_id")).otherwise(in_url).alias("context_id"), F.get_json_object(variables, "$.target_id").alias("target_id"), body.alias("json"), ordered(F.col("place")).alias("at")
    )
    pages = entries.where("route = 'page'").select("source", url.alias("url"), body.alias("html"), "place")
    return asked.unionByName(page_payloads(pages))


def coded_suffix(post_id: Column) -> Column:
    """The address of a post by its number."""
    number = F.when(post_id.rlike("^[0-9]{1,18}$"), shortcode(F.try_to_number(post_id, F.lit("9" * 18)).cast("long")))
    return F.concat(F.lit("p/"), number, F.lit("/"))


def named(user: Column) -> Column:
    return F.concat(F.nullif(user["username"], F.lit("None")), F.lit("/"))


def bundle(payloads: DataFrame, *names: str) -> dict[str, DataFrame]:
    """The streams `names` (all seven where none is named) of payloads (source, url, context_id, target_id, json, and at where their order is known), parsed once: accounts, posts, media, comments, likes, account_relations, tagged_accounts.

    Lists of users are likes under .../likers/ and follows under .../friendships/; a connection of comments or of
    likers counts wherever it comes. Rows of several payloads stand beside one another, with their order `at`; see deduplicated.
    """
    wanted, held = set(names or IDENTITIES), parsed(with_at(payloads))
    if len(wanted) > 1 or not wanted <= {"comments", "likes"}:  # either alone reads the payloads once
        held = staged(held)
    out = flattened(held) if wanted - {"comments", "likes", "account_relations"} else {}
    p, url = F.col("p"), F.coalesce("url", F.lit(""))
    data = p["data"]
    none = F.array().cast(f"array<{COMMENT}>")
    answered = F.when(url.contains("/comments/"), F.transform(p["comments"], lambda c: c.withField("parent_comment_id", F.lit(None).cast("string"))))
    found = held.select("source", "at", "context_id", F.posexplode(F.concat(F.coalesce(data[COMMENTS]["edges"]["node"], none), F.coalesce(answered, none))).alias("nth", "c")).withColumn("at", below(F.col("nth"))).drop("nth")
    post = coded_suffix(F.col("context_id"))
    user_id = F.coalesce("c.user.pk", "c.user.id")
    comments = found.select(
        "source", "at", F.coalesce("c.pk", "c.id").alias("id_on_platform"), F.concat(post, F.lit("c/"), F.coalesce("c.pk", "c.id"), F.lit("/")).alias("url_suffix"), F.col("context_id").alias("post_id"), post.alias("post_url_suffix"),
        user_id.alias("account_id"), named(F.col("c.user")).alias("account_url_suffix"), F.col("c.text").alias("text"), F.col("c.parent_comment_id").alias("parent_id"), F.timestamp_seconds("c.created_at").alias("publication_date"),
    )
    nobody = F.array().cast(f"array<{USER}>")
    liked = F.coalesce(data[LIKERS]["users"], nobody)
    likers = held.select("source", "at", "context_id", F.posexplode(F.concat(liked, F.coalesce(F.when(url.contains("/likers/"), p["users"]), nobody))).alias("nth", "u")).withColumn("at", below(F.col("nth"))).drop("nth")
    liker = F.coalesce("u.pk", "u.id")
    likes = likers.select("source", "at", like_id(F.lit(None).cast("string"), F.col("context_id"), liker).alias("id_on_platform"), F.col("context_id").alias("post_id"), post.alias("post_url_suffix"), liker.alias("account_id"), named(F.col("u")).alias("account_url_suffix"))
    target = F.nullif(F.regexp_extract(url, r"friendships/([^/?]+)", 1), F.lit(""))
    near = held.where(url.contains("/friendships/")).select("source", "at", target.alias("target"), url.contains("followers").alias("into"), F.explode(p["users"]).alias("u"), F.lit("follower").alias("kind"))
    shown = held.select("source", "at", F.col("target_id").alias("target"), F.lit(False).alias("into"), F.explode(data[CHAINING]["users"]).alias("u"), F.lit("suggested").alias("kind"))
    related = near.unionByName(shown)
    other = F.coalesce("u.id", "u.pk")
    ends = {"follower_id": F.when(F.col("into"), other).otherwise(F.col("target")), "followed_id": F.when(F.col("into"), F.col("target")).otherwise(other)}
    suffixes = {"follower_url_suffix": F.when(F.col("into"), named(F.col("u"))), "followed_url_suffix": F.when(~F.col("into"), named(F.col("u")))}
    relations = related.select("source", "at", *(c.alias(k) for k, c in (ends | suffixes).items()), "kind")
    relations = relations.select("source", "at", relation_id(F.lit(None).cast("string"), F.col("follower_id"), F.col("followed_id"), F.col("kind")).alias("id_on_platform"), *ends, *suffixes, "kind")
    bare = lambda rows, column: rows.where(F.col(column).isNotNull()).select("source", "at", F.col(column).dropFields("full_name", "biography").withField("full_name", F.lit(None).cast("string")).withField("biography", F.lit(None).cast("string")).alias("user"))
    profile = held.where(data["user"]["biography"].isNotNull()).select("source", "at", data["user"].alias("user"))
    people = bare(found.select("source", "at", F.col("c.user").alias("user")), "user").unionByName(likers.unionByName(related, allowMissingColumns=True).select("source", "at", F.col("u").alias("user"))).unionByName(profile)
    if out:
        out["accounts"] = out["accounts"].unionByName(people.select("source", "at", *account_row("user")))
    found_all = out | {"comments": comments, "likes": likes, "account_relations": relations}
    return {n: rows for n, rows in found_all.items() if n in wanted}


@dataclass(frozen=True)
class Identity:
    """The columns by which rows of a stream are one entity, and whether later rows fill in or replace what earlier ones say."""

    keys: tuple[str, ...]
    merged: bool = False


#: Which rows of one session are one entity, by stream.
IDENTITIES = {
    "accounts": Identity(("id_on_platform", "url_suffix"), True),
    "posts": Identity(("id_on_platform", "url_suffix"), True),
    "media": Identity(("id_on_platform", "url_suffix"), True),
    "comments": Identity(("id_on_platform", "url_suffix")),
    "likes": Identity(("id_on_platform",)),
    "account_relations": Identity(("id_on_platform",)),
    "tagged_accounts": Identity(("id_on_platform",)),
}


def deduplicated(streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each stream with one row an entity and source. Rows that share a key, directly or through others, are one: of merged streams each value is that of the last row that has it, of others the first row stays.

    Rows are ordered by `at`, the order of their capture, where they have it; rows of one place, and streams without it, by all they hold, so that a stage that runs again finds the same order. A row without any key is an entity of its own.
    """
    out = {}
    for name, rows in streams.items():
        how, columns = IDENTITIES[name], [c for c in rows.columns if c != "at"]
        keys, held = list(how.keys), F.to_json(F.struct(*columns))
        values = [c for c in columns if c not in ("source", *keys)]
        filled = lambda c: full(F.col(c), rows.schema[c].dataType)
        placed = lambda c: F.max(F.when(filled(c).isNotNull(), F.struct("ord", c))).alias(c)
        # first the rows that agree in all keys, each by its own where it has none; what they leave is merged further below
        apart = with_at(rows).withColumns({"ord": F.concat_ws(" ", "at", held), "apart": F.when(F.coalesce(*keys).isNull(), held)}).groupBy("source", *keys, "apart")
        if how.merged:
            parts = apart.agg(F.max("ord").alias("ord"), *map(placed, values))
        else:
            parts = apart.agg(F.min(F.struct("ord", *values)).alias("r")).select("source", *keys, "apart", "r.*")
        shown = lambda part: part.select(*(filled(c).alias(c) if c in keys else F.col(f"{c}.{c}").alias(c) if c in values else c for c in columns)) if how.merged else part.select(*columns)
        if len(keys) > 1:
            parts = staged(parts.withColumn("part", F.to_json(F.struct("source", *keys, "apart"))))
            found = linked(parts, "part", [F.when(F.col(k).isNotNull(), F.concat_ws("\0", "source", k)) for k in keys])
        if len(keys) == 1 or found is None:
            out[name] = shown(parts)
            continue
        members = staged(found.select("id", "component").union(found.select("component", "component")).distinct())
        inside = parts.join(members, F.col("part") == F.col("id")).groupBy("source", "component")
        if how.merged:
            grouped = inside.agg(*map(placed, keys), *(F.max(c).alias(c) for c in values)).select("source", *(F.col(f"{c}.{c}").alias(c) for c in (*keys, *values)))
        else:
            grouped = inside.agg(F.min(F.struct("ord", *keys, *values)).alias("r")).select("source", "r.*")
        out[name] = shown(parts.join(members, F.col("part") == F.col("id"), "left_anti")).unionByName(grouped.select(*columns))
    return out


def with_local_files(media: DataFrame, files: DataFrame) -> DataFrame:
    """media (source, url_suffix, ...) with local_url: the path of the source's file (source, path) of the same name; of several the smallest path."""
    names = files.groupBy("source", F.element_at(F.split("path", "/"), -1).alias("url_suffix")).agg(F.min("path").alias("local_url"))
    return media.join(names, ["source", "url_suffix"], "left").select(*media.columns, "local_url")


def session_entities(entries: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The seven streams of captured sessions: HAR entries (routed) to payloads, to rows, to entities, with their local files."""
    out = deduplicated(bundle(response_payloads(entries)))
    return out | {"media": with_local_files(out["media"], files)}


def nested_sessions(streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Which post and account each row of a session lies under, by platform ids and addresses: media, comments, likes and tagged accounts with `post` (null for orphans), posts with `account` (by address, else by id), relations with `account` (the follower, else the followed)."""
    accounts, posts = streams["accounts"], streams["posts"].select("source", F.col("id_on_platform").alias("post_id")).where("post_id IS NOT NULL").distinct().withColumn("post", F.col("post_id"))
    by_id = accounts.where("id_on_platform IS NOT NULL").groupBy("source", F.col("id_on_platform").alias("_id")).agg(F.max(F.coalesce("id_on_platform", "url_suffix")).alias("_found_id"))
    by_name = accounts.where("url_suffix IS NOT NULL").groupBy("source", F.col("url_suffix").alias("_name")).agg(F.max(F.coalesce("id_on_platform", "url_suffix")).alias("_found_name"))

    def owned(rows: DataFrame, *ends: tuple[Column, Column]) -> DataFrame:
        found = []
        for k, (id_, name) in enumerate(ends):
            for side, key, value, own in ((by_name, "_name", "_found_name", name), (by_id, "_id", "_found_id", id_)):
                known = side.select(F.col("source").alias("_s"), F.col(key).alias("_key"), F.col(value).alias(f"{value}{k}"))
                rows = rows.join(known, (F.col("source") == F.col("_s")) & (own == F.col("_key")), "left").drop("_s", "_key")
                found.append(F.col(f"{value}{k}"))
        return rows.withColumn("account", F.coalesce(*found)).drop(*(f"{v}{k}" for k in range(len(ends)) for v in ("_found_name", "_found_id")))

    under = {n: streams[n].join(posts, ["source", "post_id"], "left") for n in ("media", "comments", "likes", "tagged_accounts")}
    under["posts"] = owned(streams["posts"], (F.col("account_id"), F.col("account_url_suffix")))
    under["account_relations"] = owned(streams["account_relations"], (F.col("follower_id"), F.col("follower_url_suffix")), (F.col("followed_id"), F.col("followed_url_suffix")))
    return under
