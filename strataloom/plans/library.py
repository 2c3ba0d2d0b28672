"""Queries over search in its four modes, lookups, enrichment and what is shown of entities."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import enrich, lookup, tags
from strataloom.operators import graph as g
from strataloom.operators.search import MODES, Library, Request, results
from strataloom.operators.search import indexed as words_of
from strataloom.plans import bindings as b
from strataloom.plans.graph import SCOPES
from strataloom.plans.query import query, stated


#: The driver's tables whose files tell the state of searched tables.
SOURCES = {"accounts": "customer", "posts": "orders"}


def library(spark: SparkSession, sf_dir: str, *indexed: str) -> Library:
    """The searched tables, the named ones with their word indexes."""
    tagged = tags.Tagged(
        b.tag_edges(spark, sf_dir), b.account_tags(spark, sf_dir), b.post_tags(spark, sf_dir), b.media_tags(spark, sf_dir), b.posts(spark, sf_dir), b.media(spark, sf_dir), b.part_tags(spark, sf_dir), b.media_parts(spark, sf_dir)
    )
    held = Library(b.full_accounts(spark, sf_dir), b.full_posts(spark, sf_dir), b.full_media(spark, sf_dir), b.sessions(spark, sf_dir), b.session_media(spark, sf_dir), tagged)
    modes = {m.table: m for m in MODES.values()}
    return replace(held, indexes={t: b.word_index(spark, sf_dir, SOURCES[t], getattr(held, t), modes[t].id, words_of(modes[t])) for t in indexed})


PARTS = "SELECT media_key, tag_id FROM part_tags JOIN media_parts USING (part_id)"
PART_SCOPES = {
    "account": f"SELECT account_id AS m, tag_id FROM ({PARTS}) JOIN media USING (media_key)",
    "post": f"SELECT post_id AS m, tag_id FROM ({PARTS}) JOIN media USING (media_key)",
    "media": f"SELECT media_key AS m, tag_id FROM ({PARTS})",
}
TAG_TABLES = ("accounts", "posts", "media", "account_tags", "post_tags", "media_tags", "tag_edges", "media_parts", "part_tags")


def tag_ctes(entity: str, ids: list[int], mode: str, scopes: list[str]) -> dict[str, str]:
    """Common tables that end in wanted (m): the entities with the tags."""
    seeds = " UNION ALL ".join(f"SELECT {i}::BIGINT AS root_id, {i}::BIGINT AS id" for i in ids)
    having = f" HAVING count(DISTINCT root_id) = {len(set(ids))}" if mode == "all" else ""
    return {
        "below": f"{seeds} UNION SELECT root_id, sub FROM below JOIN tag_edges ON super = id",
        "reach": " UNION ALL ".join(f"({(SCOPES[entity] | {'media_part': PART_SCOPES[entity]})[s]})" for s in scopes),
        "wanted": f"SELECT m FROM reach JOIN below ON id = tag_id GROUP BY m{having}",
    }


WORDS_OF = "list_filter(string_split_regex(lower(concat_ws(' ', {0})), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
COLUMNS = ("place", "page", "id", "title", "details")


def flat(rows: DataFrame, *metadata: str) -> DataFrame:
    """Results with their thumbnails and the named metadata as text."""
    return rows.select(*COLUMNS, F.array_join("thumbnails", ";").alias("thumbnails"), *(F.col("metadata")[m].alias(m) for m in metadata))


@query(
    stated(
        """SELECT place, 'account' AS page, id::VARCHAR AS id, 'https://www.instagram.com/' || url_suffix AS title, bio AS details, coalesce(t.thumbnails, '') AS thumbnails, coalesce(t.n, 0)::VARCHAR AS media_count, display_name
        FROM (SELECT *, row_number() OVER (ORDER BY display_name, id DESC) AS place FROM full_accounts WHERE list_contains(w, 'building') AND list_contains(w, 'customer') AND contains(lower(display_name), '1') AND id IN (SELECT m FROM wanted)) a
        LEFT JOIN (SELECT account_id, string_agg(coalesce(thumbnail_path, local_url), ';' ORDER BY rn) FILTER (WHERE rn <= 8) AS thumbnails, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY publication_date DESC, media_key) AS rn FROM full_media WHERE local_url IS NOT NULL) GROUP BY 1) t ON t.account_id = a.id
        WHERE place BETWEEN 6 AND 10""",
        *TAG_TABLES, "full_media", **tag_ctes("account", [3, 1001], "any", ["account", "post"]),
        full_accounts=f"SELECT *, {WORDS_OF.format('url_suffix, bio, display_name')} AS w FROM ({b.SQL['full_accounts']})",
    )
)
def search_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = Request("accounts", "Building customer", {"in": ["1", {"var": "display_name"}]}, 2, 5, (3, 1001), "any", ("account", "post"), "display_name", "ASC")
    return flat(results(asked, library(spark, sf_dir)), "media_count", "display_name")


@query(
    stated(
        """SELECT place, 'account' AS page, id::VARCHAR AS id, 'https://www.instagram.com/' || url_suffix AS title, bio AS details, coalesce(t.n, 0)::VARCHAR AS media_count FROM (
          SELECT *, row_number() OVER (ORDER BY id DESC) AS place FROM full_accounts WHERE url_suffix = 'old_customer_000000008' OR list_contains(identifiers, 'url_old_customer_000000008') OR list_contains(identifiers, 'url_old_customer_000000008/')) a
        LEFT JOIN (SELECT account_id, count(*) AS n FROM media WHERE local_url IS NOT NULL GROUP BY 1) t ON t.account_id = a.id""",
        "accounts", "posts", "media", "full_accounts",
    )
)
def search_accounts_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A former name, of which the identifiers have kept the address with its closing slash."""
    return results(Request("accounts", "@old_customer_000000008"), library(spark, sf_dir)).select(*COLUMNS, F.col("metadata")["media_count"].alias("media_count"))


@query(
    stated(
        """SELECT place, 'post' AS page, p.id::VARCHAR AS id, 'https://www.instagram.com/p/' || p.id AS title, caption AS details, coalesce(t.thumbnails, '') AS thumbnails, a.display_name AS account_display_name, 'https://www.instagram.com/' || a.url_suffix AS account_url
        FROM (SELECT *, row_number() OVER (ORDER BY (caption = '2-HIGH')::INT * 2 + (caption = '5-LOW')::INT + (id = 2)::INT DESC, id DESC) AS place FROM full_posts WHERE (caption IN ('2-HIGH', '5-LOW') OR id = 2) AND publication_date >= DATE '1996-02-01' AND id IN (SELECT m FROM wanted)) p
        LEFT JOIN accounts a ON a.id = p.account_id
        LEFT JOIN (SELECT post_id, string_agg(coalesce(thumbnail_path, local_url), ';' ORDER BY media_key, coalesce(thumbnail_path, local_url)) AS thumbnails FROM full_media GROUP BY 1) t ON t.post_id = p.id
        WHERE place <= 40""",
        *TAG_TABLES, "full_posts", "full_media", **tag_ctes("post", [5, 1002], "all", ["account", "post", "media", "media_part"]),
    )
)
def search_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without signs beside one with a sign are options; the more of them a row holds the earlier it comes."""
    asked = Request("posts", "2 high low -medium", {">=": [{"var": "publication_date"}, "1996-02-01T00:00:00Z"]}, 1, 40, (5, 1002, 5), "all", ("account", "post", "media", "media_part"), "caption", "asc")
    return flat(results(asked, library(spark, sf_dir, "posts")), "account_display_name", "account_url")


@query(
    stated(
        """SELECT place, 'media' AS page, media_key AS id, 'https://www.instagram.com/' || a.url_suffix AS title, '' AS details, coalesce(thumbnail_path || ';', local_url || ';') || local_url AS thumbnails, media_type, a.display_name AS account_display_name
        FROM (SELECT *, row_number() OVER (ORDER BY media_key DESC) AS place FROM (SELECT DISTINCT * FROM full_media) WHERE local_url IS NOT NULL AND media_type = 'image' AND year(publication_date) = 1997 AND media_key IN (SELECT m FROM wanted)) m
        LEFT JOIN accounts a ON a.id = m.account_id WHERE place BETWEEN 31 AND 60""",
        *TAG_TABLES, "full_media", **tag_ctes("media", [7], "any", ["media_part", "media"]),
    )
)
def search_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media by the words about them; without an order, the latest keys first. Keys are made unique for the page's sake."""
    held = library(spark, sf_dir)
    asked = Request("media", "image 1997", None, 2, 30, (7,), "any", ("media_part", "media"), "size", "desc")
    return flat(results(asked, Library(held.accounts, held.posts, held.media.distinct(), held.sessions, held.session_media, held.tagged)), "media_type", "account_display_name")


@query(
    stated(
        """SELECT place, 'archive' AS page, s.id::VARCHAR AS id, coalesce('https://www.instagram.com/' || url_suffix, 'Archive Session ' || s.id) AS title, coalesce(notes, '') AS details, coalesce(t.thumbnails, '') AS thumbnails, coalesce(t.n, 0)::VARCHAR AS media_count
        FROM (SELECT *, row_number() OVER (ORDER BY archived_at DESC, id DESC) AS place FROM sessions WHERE id > 3) s
        LEFT JOIN (SELECT session_id, string_agg(coalesce(thumbnail_path, local_url), ';' ORDER BY rn) FILTER (WHERE rn <= 4) AS thumbnails, count(*) AS n FROM (
            SELECT session_id, x.*, row_number() OVER (PARTITION BY session_id ORDER BY x.media_key, coalesce(thumbnail_path, local_url)) AS rn FROM (SELECT DISTINCT * FROM session_media) JOIN (SELECT DISTINCT media_key, thumbnail_path, local_url FROM full_media) x USING (media_key) WHERE local_url IS NOT NULL) GROUP BY 1) t ON t.session_id = s.id
        WHERE place <= 25""",
        "posts", "media", "full_media", "sessions", "session_media",
    )
)
def search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = library(spark, sf_dir)
    asked = Request("archive_sessions", None, {">": [{"var": "id"}, 3]}, 1, 25)
    media = held.media.select("media_key", "thumbnail_path", "local_url").distinct()
    return flat(results(asked, Library(held.accounts, held.posts, media, held.sessions, held.session_media.distinct())), "media_count")


@query(
    stated(
        """SELECT session_id, media_key, rn, media_count FROM (SELECT session_id, media_key, row_number() OVER (PARTITION BY session_id ORDER BY media_key)::INT AS rn, count(*) OVER (PARTITION BY session_id) AS media_count
        FROM (SELECT DISTINCT * FROM session_media) JOIN (SELECT DISTINCT media_key FROM media WHERE local_url IS NOT NULL) USING (media_key)) WHERE rn <= 4""",
        "media", "session_media",
    )
)
def thumbs_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = b.session_media(spark, sf_dir).distinct().join(b.media(spark, sf_dir).select("media_key", "local_url").distinct(), "media_key")
    return g.newest_files(seen, "session_id", 4, [F.col("media_key")]).select("session_id", "media_key", "rn", "media_count")


# ---------------------------------------------------------------- lookups


@query(stated("SELECT x.id, a.id IS NOT NULL AS found FROM (SELECT event_id AS id FROM events) x LEFT JOIN accounts a ON a.id = x.id", "accounts"))
def lookup_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.known(b.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), b.accounts(spark, sf_dir))


@query(stated("SELECT id, display_name, NULL::VARCHAR AS bio FROM accounts WHERE id IN (SELECT user_id * 2 FROM events)", "accounts"))
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by a list of ids, without what is left out unless asked for."""
    ids = b.table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("id"))
    return lookup.many(lookup.pruned(b.accounts(spark, sf_dir).select("id", "display_name", "bio"), ["bio"]), ids)


@query(stated("SELECT * FROM accounts WHERE url_suffix = 'customer_000000007'", "accounts"))
def lookup_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.one(b.accounts(spark, sf_dir), url_suffix="customer_000000007")


@query("SELECT x.event_id * 2 AS id, e.event_id IS NOT NULL AS found, json_extract_string(CASE WHEN e.event_id % 9 <> 0 THEN e.props END, '$.k') AS k FROM events x LEFT JOIN events e ON e.event_id = x.event_id * 2")
def lookup_raw_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an id is known, and a value of its JSON; text that is cut off is none."""
    events = b.table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("data"))
    found = lookup.raw_data(events.select((F.col("event_id") * 2).alias("id")), rows)
    return found.select("id", "found", F.try_variant_get("value", "$.k", "string").alias("k"))


@query(stated("SELECT * FROM posts WHERE id > 500 ORDER BY id LIMIT 100", "posts"))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.keyset_page(b.posts(spark, sf_dir), "id", 500, 100)


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'a') AND n_regionkey IN (0, 1, 2) ORDER BY n_name LIMIT 10")
def tag_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    affinity = F.when(F.col("n_regionkey").isin(0, 2), '["account"]').when(F.col("n_regionkey") > 2, '["media"]')
    rows = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), affinity.alias("affinity"))
    return lookup.suggestions(rows, "A", "account").select("id", "name")


@query(stated("SELECT part_id, media_key FROM media_parts WHERE media_key IN (SELECT media_key FROM media_tags WHERE tag_id = 4)", "posts", "media", "media_tags", "media_parts"))
def parts_of_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.parts_of(b.media_parts(spark, sf_dir), b.media_tags(spark, sf_dir).where("tag_id = 4")).select("part_id", "media_key")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'view' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_share_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("entity"), F.col("user_id").alias("entity_id"), F.col("ts").alias("created_at"))
    return lookup.latest_link(links, "view", 7).select("id", "created_at")


# ---------------------------------------------------------------- enrichment


@query(
    stated(
        "SELECT c.id, c.post_id, c.account_id, a.display_name AS account_display_name, a.url_suffix AS account_url_suffix, p.url_suffix AS post_url_suffix FROM comments c LEFT JOIN accounts a ON a.id = c.account_id LEFT JOIN full_posts p ON p.id = c.post_id",
        "accounts", "posts", "full_posts", "comments",
    )
)
def enrich_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.with_account_and_post(b.comments(spark, sf_dir), b.accounts(spark, sf_dir), b.full_posts(spark, sf_dir))
    return rows.select("id", "post_id", "account_id", "account_display_name", "account_url_suffix", "post_url_suffix")


@query(
    stated(
        "SELECT t.*, a.display_name AS tagged_display_name, p.url_suffix AS post_url_suffix FROM tagged t LEFT JOIN accounts a ON a.id = tagged_account_id LEFT JOIN full_posts p ON p.id = t.post_id",
        "accounts", "posts", "full_posts", "tagged",
    )
)
def enrich_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.with_account_and_post(b.tagged(spark, sf_dir), b.accounts(spark, sf_dir), b.full_posts(spark, sf_dir), "tagged_account_id", "tagged_")
    return rows.select("tagged_account_id", "post_id", "media_key", "tagged_display_name", "post_url_suffix")


@query(
    stated(
        """SELECT kind, x.account_id, post_id, media_key, "at", a.display_name AS account_display_name, w.id AS author_id, w.display_name AS author_display_name FROM (
          SELECT 'comment' AS kind, account_id, post_id, NULL AS media_key, publication_date AS "at" FROM comments UNION ALL SELECT 'like', account_id, post_id, NULL, NULL FROM likes UNION ALL SELECT 'tagged', tagged_account_id, post_id, media_key, NULL FROM tagged) x
        LEFT JOIN accounts a ON a.id = x.account_id LEFT JOIN posts p ON p.id = x.post_id LEFT JOIN accounts w ON w.id = p.account_id WHERE x.account_id IN (SELECT account_id FROM account_tags WHERE tag_id = 3)""",
        "accounts", "posts", "likes", "comments", "tagged", "account_tags",
    )
)
def account_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = b.account_tags(spark, sf_dir).where("tag_id = 3").select(F.col("account_id").alias("id"))
    return enrich.interactions(b.comments(spark, sf_dir), b.likes(spark, sf_dir), b.tagged(spark, sf_dir), b.posts(spark, sf_dir), b.accounts(spark, sf_dir), of)


@query(
    stated(
        """SELECT * FROM (SELECT DISTINCT 'commenter' AS role, account_id, tag_id, name FROM account_tags JOIN tags ON id = tag_id WHERE account_id IN (SELECT account_id FROM comments WHERE post_id < 1000)
        UNION ALL SELECT DISTINCT 'liker', account_id, tag_id, name FROM account_tags JOIN tags ON id = tag_id WHERE account_id IN (SELECT account_id FROM likes WHERE post_id < 1000)
        UNION ALL SELECT DISTINCT 'tagged', account_id, tag_id, name FROM account_tags JOIN tags ON id = tag_id WHERE account_id IN (SELECT tagged_account_id FROM tagged WHERE post_id < 1000)
        UNION ALL SELECT DISTINCT 'related', account_id, tag_id, name FROM account_tags JOIN tags ON id = tag_id WHERE account_id IN (SELECT unnest([follower_id, other_id]) FROM raw_relations WHERE follower_id = 7 OR other_id = 7))""",
        "tags", "account_tags", "likes", "comments", "tagged", "raw_relations",
    )
)
def tags_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the accounts that commented on, liked or are tagged in the first posts, and of those related to an account."""
    near = enrich.related_accounts(b.raw_relations(spark, sf_dir), 7).withColumnRenamed("id", "account_id")
    sides = {"commenter": (b.comments(spark, sf_dir).where("post_id < 1000"), "account_id"), "liker": (b.likes(spark, sf_dir).where("post_id < 1000"), "account_id"), "tagged": (b.tagged(spark, sf_dir).where("post_id < 1000"), "tagged_account_id"), "related": (near, "account_id")}
    out = None
    for role, (rows, key) in sides.items():
        part = enrich.tags_of_others(b.account_tags(spark, sf_dir), rows, key, b.tags(spark, sf_dir)).select(F.lit(role).alias("role"), "account_id", "tag_id", "name")
        out = part if out is None else out.union(part)
    return out


@query(
    stated(
        """SELECT a.id, coalesce(r.n, 0) AS relations, coalesce(c.n, 0) AS comments, coalesce(l.n, 0) AS likes, coalesce(t.n, 0) AS tagged_in FROM accounts a
        LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT follower_id AS id FROM raw_relations UNION ALL SELECT other_id FROM raw_relations WHERE other_id <> follower_id) GROUP BY 1) r USING (id)
        LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM comments GROUP BY 1) c USING (id) LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM likes GROUP BY 1) l USING (id)
        LEFT JOIN (SELECT tagged_account_id AS id, count(*) AS n FROM tagged GROUP BY 1) t USING (id)""",
        "accounts", "raw_relations", "comments", "likes", "tagged",
    )
)
def account_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.account_counts(b.accounts(spark, sf_dir), b.raw_relations(spark, sf_dir), b.comments(spark, sf_dir), b.likes(spark, sf_dir), b.tagged(spark, sf_dir))


@query(stated("SELECT p.id, coalesce(c.n, 0) AS comments, coalesce(l.n, 0) AS likes FROM posts p LEFT JOIN (SELECT post_id AS id, count(*) AS n FROM comments GROUP BY 1) c USING (id) LEFT JOIN (SELECT post_id AS id, count(*) AS n FROM likes GROUP BY 1) l USING (id)", "posts", "comments", "likes"))
def post_aux_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.post_counts(b.posts(spark, sf_dir), b.comments(spark, sf_dir), b.likes(spark, sf_dir))


@query(
    stated(
        """SELECT 'account' AS kind, canonical_id::VARCHAR AS canonical_id, coalesce(a.url_suffix, '') AS url_suffix FROM observations LEFT JOIN accounts a ON a.id = canonical_id WHERE session = 'view'
        UNION ALL SELECT 'comment', id::VARCHAR, '' FROM comments WHERE 'purchase' = 'view' UNION ALL SELECT 'post', ord::VARCHAR, 'p/' || ord FROM observations WHERE session = 'view' AND ord % 2 = 0""",
        "accounts", "observations", "comments",
    )
)
def session_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = b.observations(spark, sf_dir)
    named = seen.join(b.accounts(spark, sf_dir).select(F.col("id").alias("canonical_id"), "url_suffix"), "canonical_id", "left").select("canonical_id", "session", F.coalesce("url_suffix", F.lit("")).alias("url_suffix"))
    posts = seen.where("ord % 2 = 0").select(F.col("ord").alias("canonical_id"), "session", F.concat(F.lit("p/"), "ord").alias("url_suffix"))
    comments = b.comments(spark, sf_dir).select(F.col("id").alias("canonical_id"), F.lit("purchase").alias("session"), F.lit("").alias("url_suffix"))
    return enrich.session_contents("view", {"account": named, "comment": comments, "post": posts})


@query(stated("SELECT DISTINCT media_key, session_id AS session FROM session_media WHERE media_key IN (SELECT media_key FROM media_tags WHERE tag_id = 6)", "posts", "media", "media_tags", "session_media"))
def sessions_by_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = b.session_media(spark, sf_dir).select(F.col("media_key").alias("canonical_id"), F.col("session_id").alias("session"))
    return enrich.sessions_of_entity(b.media_tags(spark, sf_dir).where("tag_id = 6"), seen, "media_key")


@query(
    stated(
        "SELECT (SELECT count(*) FROM a) AS accounts, (SELECT count(*) FROM p) AS posts, (SELECT count(*) FROM m) AS media",
        "accounts", "posts", "media", m="SELECT * FROM media WHERE local_url IS NOT NULL AND media_type = 'video'", p="SELECT * FROM posts WHERE id IN (SELECT post_id FROM m)", a="SELECT * FROM accounts WHERE id IN (SELECT account_id FROM p)",
    )
)
def displayed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = enrich.Display.of({"media_with_file": "yes", "posts_with_media": "1", "accounts_with_posts": "TRUE"})
    sides = enrich.displayed(b.accounts(spark, sf_dir), b.posts(spark, sf_dir), b.media(spark, sf_dir).where("media_type = 'video'"), how)
    rows = [d.select(F.lit(k).alias("kind")) for k, d in zip(("accounts", "posts", "media"), sides, strict=True)]
    return rows[0].union(rows[1]).union(rows[2]).groupBy().agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("accounts", "posts", "media")))


@query(
    stated(
        """SELECT 'account' AS kind, id::VARCHAR AS id FROM sa UNION ALL SELECT 'post', id::VARCHAR FROM sp UNION ALL SELECT 'media', media_key FROM sm UNION ALL SELECT 'media_part', part_id FROM media_parts WHERE media_key IN (SELECT media_key FROM sm)""",
        "accounts", "posts", "media", "media_parts", sa="SELECT id FROM accounts WHERE bio = 'FURNITURE'", sp="SELECT id FROM posts WHERE account_id IN (SELECT id FROM sa) OR caption = '1-URGENT'",
        sm="SELECT DISTINCT media_key FROM media WHERE post_id IN (SELECT id FROM sp) OR media_type = 'audio'",
    )
)
def share_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shares of some accounts, posts and media give access to, down to parts."""
    posts, media = b.posts(spark, sf_dir), b.media(spark, sf_dir)
    shared = (b.accounts(spark, sf_dir).where("bio = 'FURNITURE'").select("id"), posts.where("caption = '1-URGENT'").select("id"), media.where("media_type = 'audio'").select("media_key"))
    return enrich.shared_with(*shared, posts, media, b.media_parts(spark, sf_dir))


@query(
    stated(
        """SELECT a.id, count(DISTINCT p.id) AS n_posts, count(m.media_key) AS n_media, min(CASE WHEN p.r = 1 THEN p.id END) AS newest_post FROM accounts a
        JOIN (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY publication_date DESC, id) AS r FROM posts) p ON p.account_id = a.id LEFT JOIN media m ON m.post_id = p.id GROUP BY a.id""",
        "accounts", "posts", "media",
    )
)
def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nest_entities tells of the trees, by sums alone."""
    return enrich.tree_sizes(b.accounts(spark, sf_dir), b.posts(spark, sf_dir), b.media(spark, sf_dir))


@query(
    stated(
        "SELECT a.id, coalesce(p.n, 0) AS post_count, coalesce(f.n, 0) AS relations FROM accounts a LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM posts GROUP BY 1) p USING (id) LEFT JOIN (SELECT follower_id AS id, count(*) AS n FROM relations GROUP BY 1) f USING (id) WHERE coalesce(p.n, 0) > 0 AND coalesce(f.n, 0) > 5 AND coalesce(f.n, 0) < 40",
        "accounts", "posts", "relations",
    )
)
def relation_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = b.posts(spark, sf_dir).groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("post_count"))
    ends = b.relations(spark, sf_dir).groupBy(F.col("follower_id").alias("id")).agg(F.count("*").alias("relations"))
    return enrich.by_relations(b.accounts(spark, sf_dir).select("id"), made.join(ends, "id", "full_outer"), 5, 40, True)


def side_sql(name: str, account: str, shown: str, order: str) -> str:
    return f"""(SELECT post_id, max(rn) AS n, string_agg({shown}, ';' ORDER BY rn) FILTER (WHERE rn <= 3) AS rows FROM (
      SELECT s.*, a.display_name, row_number() OVER (PARTITION BY s.post_id ORDER BY {order}) AS rn FROM {name} s LEFT JOIN accounts a ON a.id = s.{account}) GROUP BY post_id)"""


@query(
    stated(
        f"""SELECT p.id, coalesce(c.n, 0) AS n_comments, coalesce(c.rows, '') AS comments, coalesce(l.n, 0) AS n_likes, coalesce(l.rows, '') AS likes, coalesce(t.n, 0) AS n_tagged, coalesce(t.rows, '') AS tagged FROM posts p
        LEFT JOIN {side_sql("comments", "account_id", "concat_ws(':', account_id, display_name, id, text)", "publication_date NULLS FIRST, s.id")} c ON c.post_id = p.id
        LEFT JOIN {side_sql("likes", "account_id", "concat_ws(':', account_id, display_name)", "account_id NULLS FIRST")} l ON l.post_id = p.id
        LEFT JOIN {side_sql("tagged", "tagged_account_id", "concat_ws(':', tagged_account_id, display_name)", "tagged_account_id NULLS FIRST")} t ON t.post_id = p.id""",
        "accounts", "posts", "comments", "likes", "tagged",
    )
)
def posts_with_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with the number of its comments, likes and tagged accounts, and the first three of each by name."""
    sides = {
        "comments": enrich.Side(b.comments(spark, sf_dir), "account_id", ("id", "text"), ("publication_date", "id")),
        "likes": enrich.Side(b.likes(spark, sf_dir), "account_id", (), ("account_id",)),
        "tagged": enrich.Side(b.tagged(spark, sf_dir), "tagged_account_id", (), ("tagged_account_id",)),
    }
    out = enrich.posts_with(b.posts(spark, sf_dir), b.accounts(spark, sf_dir), sides, most=3)
    more = {"comments": ["id", "text"], "likes": [], "tagged": []}
    text = lambda name: F.array_join(F.transform(name, lambda r: F.concat_ws(":", r["account_id"], r["account_display_name"], *(r[c] for c in more[name]))), ";").alias(name)
    return out.select("id", *(c for name in more for c in (F.col(f"n_{name}"), text(name))))
