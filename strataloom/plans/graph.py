"""Queries over the interaction graph, the tag hierarchy and tag filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import graph as g
from strataloom.operators import hierarchy, tags
from strataloom.operators.lineage import checkpointed
from strataloom.plans import bindings as b
from strataloom.plans.query import query, stated

#: The tag whose accounts are the kernel, the account that is asked about, and weights with suggestions.
KERNEL_TAG, ACCOUNT, REGION_TAG, ROOT_TAG = 3, 7, 1001, 2000
ALL_KINDS = {"follow": 1.0, "suggested": 0.25, "like": 0.5, "comment": 1.0, "tag": 2.0}

EDGES = """SELECT DISTINCT src, dst, kind FROM (
  SELECT follower_id AS src, other_id AS dst, kind FROM relations UNION ALL
  SELECT l.account_id, p.account_id, 'like' FROM likes l JOIN posts p ON l.post_id = p.id) WHERE src <> dst"""
BELOW = "SELECT 2000::BIGINT AS id UNION SELECT sub FROM below JOIN tag_edges ON super = id"


def weighted(weights: dict[str, float]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in weights.items()) + " END"


def score_sql(weights: dict[str, float]) -> dict[str, str]:
    return {
        "e": EDGES,
        "kernel": f"SELECT account_id AS id FROM account_tags WHERE tag_id = {KERNEL_TAG}",
        "d": f"SELECT src AS kernel_id, dst AS candidate_id, {weighted(weights)} AS w FROM e UNION ALL SELECT dst, src, {weighted(weights)} FROM e",
        "pairs": "SELECT candidate_id, kernel_id, max(w) AS strength FROM d WHERE kernel_id IN (SELECT id FROM kernel) AND w > 0 GROUP BY ALL",
        "scores": "SELECT candidate_id, sum(strength) AS score, count(*) AS kernel_connections FROM pairs GROUP BY candidate_id",
    }


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that are ties to a post or media are edges already; the others are follows and suggestions."""
    rows, near = b.relations(spark, sf_dir), F.col("kind").isin("follow", "suggested")
    direct = rows.where(~near).select(F.col("follower_id").alias("src"), F.col("other_id").alias("dst"), "kind")
    return g.ties(rows.where(near), b.likes(spark, sf_dir), b.posts(spark, sf_dir), direct=direct)


def kernel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.account_tags(spark, sf_dir).where(F.col("tag_id") == KERNEL_TAG).select(F.col("account_id").alias("id"))


TABLES = ("relations", "likes", "posts", "account_tags")


@query(stated("SELECT * FROM scores WHERE candidate_id NOT IN (SELECT id FROM kernel) ORDER BY score DESC, candidate_id LIMIT 50", *TABLES, **score_sql(g.WEIGHTS)))
def community_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.candidates(edges_of(spark, sf_dir), kernel_of(spark, sf_dir))


@query(stated("SELECT candidate_id, round(score, 6) AS score, kernel_connections FROM scores WHERE candidate_id NOT IN (SELECT id FROM kernel)", *TABLES, **score_sql(ALL_KINDS)))
def community_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.candidates(edges_of(spark, sf_dir), kernel_of(spark, sf_dir), weights=ALL_KINDS, top=None).withColumn("score", F.round("score", 6))


@query(stated("SELECT k.id AS candidate_id, coalesce(score, 0) AS score, coalesce(kernel_connections, 0) AS kernel_connections FROM kernel k LEFT JOIN scores ON candidate_id = id", *TABLES, **score_sql(g.WEIGHTS)))
def community_kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.kernel_scores(edges_of(spark, sf_dir), kernel_of(spark, sf_dir))


@query(
    stated(
        """SELECT c.candidate_id, c.score, a.display_name, a.url_suffix, coalesce(f.followers, 0)::BIGINT AS followers, coalesce(f.following, 0)::BIGINT AS following, coalesce(p.n, 0)::BIGINT AS post_count
        FROM (SELECT * FROM scores WHERE candidate_id NOT IN (SELECT id FROM kernel) ORDER BY score DESC, candidate_id LIMIT 50) c
        LEFT JOIN accounts a ON a.id = c.candidate_id
        LEFT JOIN (SELECT id, sum(i) AS followers, sum(o) AS following FROM (SELECT follower_id AS id, 0 AS i, 1 AS o FROM relations WHERE kind <> 'suggested' UNION ALL SELECT other_id, 1, 0 FROM relations WHERE kind <> 'suggested') GROUP BY id) f ON f.id = c.candidate_id
        LEFT JOIN (SELECT account_id, count(*) AS n FROM posts GROUP BY account_id) p ON p.account_id = c.candidate_id""",
        "accounts",
        *TABLES,
        **score_sql(g.WEIGHTS),
    )
)
def community_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = checkpointed(g.candidates(edges_of(spark, sf_dir), kernel_of(spark, sf_dir)))  # TOP rows, which four sides need
    accounts = b.accounts(spark, sf_dir).select(F.col("id").alias("candidate_id"), "display_name", "url_suffix")
    counts = g.follow_counts(b.relations(spark, sf_dir)).withColumnRenamed("account_id", "candidate_id")
    posts = b.posts(spark, sf_dir).groupBy(F.col("account_id").alias("candidate_id")).agg(F.count("*").alias("post_count"))
    out = F.broadcast(top)
    for side in (accounts, counts, posts):
        out = out.join(side.join(F.broadcast(top.select("candidate_id")), "candidate_id", "left_semi"), "candidate_id", "left")
    return out.select("candidate_id", "score", "display_name", "url_suffix", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("followers", "following", "post_count")))


TIES = """SELECT follower_id AS src, other_id AS dst, CASE WHEN kind = 'suggested' THEN 'suggested' ELSE 'follow' END AS kind FROM raw_relations
  UNION ALL SELECT l.account_id, p.account_id, 'like' FROM likes l JOIN posts p ON l.post_id = p.id UNION ALL SELECT c.account_id, p.account_id, 'comment' FROM comments c JOIN posts p ON c.post_id = p.id
  UNION ALL SELECT p.account_id, tagged_account_id, 'tag' FROM tagged t JOIN posts p ON t.post_id = p.id UNION ALL SELECT m.account_id, tagged_account_id, 'tag' FROM tagged t JOIN (SELECT DISTINCT media_key, account_id FROM media) m USING (media_key)"""
TIE_TABLES = ("raw_relations", "likes", "posts", "comments", "tagged", "accounts", "media", "account_tags")


def all_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = b.media(spark, sf_dir).select("media_key", "account_id").distinct()
    return g.ties(b.raw_relations(spark, sf_dir), b.likes(spark, sf_dir), b.posts(spark, sf_dir), b.comments(spark, sf_dir), b.tagged(spark, sf_dir), owners)


@query(stated("SELECT kind, count(*) AS n, sum(src * 31 + dst)::BIGINT AS mark FROM e GROUP BY kind", *TIE_TABLES, e=f"SELECT * FROM ({TIES}) WHERE src <> dst"))
def community_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ties by kind: every relation type but suggested is a follow, and comments and tags lead to who owns the post or media."""
    return all_ties(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("src") * 31 + F.col("dst")).alias("mark"))


@query(
    stated(
        "SELECT candidate_id, round(score, 6) AS score, kernel_connections FROM scores WHERE candidate_id NOT IN (SELECT id FROM kernel)",
        *TIE_TABLES, **(score_sql(ALL_KINDS) | {"e": f"SELECT * FROM ({TIES}) WHERE src <> dst"}),
    )
)
def community_tie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.candidates(all_ties(spark, sf_dir), kernel_of(spark, sf_dir), weights=ALL_KINDS, top=None).withColumn("score", F.round("score", 6))


@query(
    stated(
        """SELECT c.candidate_id AS id, c.score, a.display_name, a.verified AS is_verified, coalesce(a.post_count, 0) AS post_count, coalesce(f.followers, 0)::BIGINT AS followers, coalesce(f.following, 0)::BIGINT AS following,
          coalesce(t.thumbnails, '') AS thumbnails, coalesce(t.n, 0) AS media_count
        FROM (SELECT * FROM scores WHERE candidate_id NOT IN (SELECT id FROM kernel) ORDER BY score DESC, candidate_id LIMIT 50) c JOIN full_accounts a ON a.id = c.candidate_id
        LEFT JOIN (SELECT id, sum(i) AS followers, sum(o) AS following FROM (SELECT follower_id AS id, 0 AS i, 1 AS o FROM raw_relations WHERE kind IS NULL OR kind <> 'suggested' UNION ALL SELECT other_id, 1, 0 FROM raw_relations WHERE kind IS NULL OR kind <> 'suggested') GROUP BY id) f ON f.id = c.candidate_id
        LEFT JOIN (SELECT account_id, string_agg(coalesce(thumbnail_path, local_url), ';' ORDER BY rn) FILTER (WHERE rn <= 8) AS thumbnails, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY publication_date DESC, media_key) AS rn FROM full_media WHERE local_url IS NOT NULL) GROUP BY 1) t ON t.account_id = c.candidate_id""",
        *TIE_TABLES, "full_accounts", "full_media", **(score_sql(g.WEIGHTS) | {"e": f"SELECT * FROM ({TIES}) WHERE src <> dst"}),
    )
)
def community_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates as they are shown."""
    top = checkpointed(g.candidates(all_ties(spark, sf_dir), kernel_of(spark, sf_dir)).select(F.col("candidate_id").alias("id"), "score"))
    rows = g.cards(top, b.full_accounts(spark, sf_dir), b.raw_relations(spark, sf_dir), b.full_media(spark, sf_dir), [F.desc("publication_date"), F.col("media_key")])
    return rows.select("id", "score", "display_name", "is_verified", "post_count", "followers", "following", F.array_join("thumbnails", ";").alias("thumbnails"), "media_count")


@query(stated("SELECT account_id AS id, string_agg(DISTINCT name, ';' ORDER BY name) AS applied FROM account_tags JOIN tags ON id = tag_id WHERE tag_id IN (SELECT id FROM below) GROUP BY 1", "tags", "tag_edges", "account_tags", below="SELECT 1001::BIGINT AS id UNION SELECT sub FROM below JOIN tag_edges ON super = id"))
def tag_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_kernel(b.tags(spark, sf_dir), b.tag_edges(spark, sf_dir), b.account_tags(spark, sf_dir), REGION_TAG).withColumn("applied", F.array_join("applied", ";"))


@query(stated("SELECT 'tag' AS kind, id, NULL::BIGINT AS sub FROM below UNION ALL SELECT 'edge', super, sub FROM tag_edges WHERE super IN (SELECT id FROM below) AND sub IN (SELECT id FROM below)", "tag_edges", below=BELOW))
def tag_dropdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    some, among = tags.dropdown(b.tags(spark, sf_dir).unionByName(spark.sql("SELECT 2000L AS id, 'all' AS name, 'root' AS tag_type")), b.tag_edges(spark, sf_dir), ROOT_TAG)
    return some.select(F.lit("tag").alias("kind"), "id", F.lit(None).cast("long").alias("sub")).union(among.select(F.lit("edge"), "super", "sub"))


@query("SELECT n_nationkey::BIGINT AS tag_id, i AS id, 'a' || i AS url_suffix FROM (SELECT n_nationkey, unnest(range(n_nationkey % 4)) AS i FROM nation WHERE n_nationkey % 5 <> 0)")
def tag_dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismissed accounts out of JSON; every fifth text is cut off, and items without an id count nothing."""
    items = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("id"), F.concat(F.lit("a"), i).alias("url_suffix")))
    kept = F.filter(items, lambda x: x["id"] < F.col("n_nationkey") % 4)
    text = F.to_json(F.concat(kept, F.array(F.struct(F.lit(None).cast("int").alias("id"), F.lit("nobody").alias("url_suffix")))))
    cut = F.when(F.col("n_nationkey") % 5 == 0, F.substring(text, 1, 9)).otherwise(text)
    rows = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), cut.alias("community_dismissals"))
    return g.dismissed(rows).select("tag_id", "id", "url_suffix")


@query(stated("SELECT 'https://www.instagram.com/' || a.url_suffix AS url, coalesce(string_agg(DISTINCT t.name, ';' ORDER BY t.name), '') AS tags FROM accounts a LEFT JOIN account_tags x ON x.account_id = a.id LEFT JOIN tags t ON t.id = x.tag_id WHERE a.bio = 'MACHINERY' GROUP BY ALL", "accounts", "account_tags", "tags"))
def kernel_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = b.account_tags(spark, sf_dir).join(b.tags(spark, sf_dir).select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return g.kernel_csv(b.accounts(spark, sf_dir).where("bio = 'MACHINERY'").select("id", "url_suffix"), named)


@query(
    stated(
        f"""SELECT tag_id, name AS tag_name, tag_type AS tag_type_name, count(DISTINCT account_id) AS count FROM account_tags JOIN tags ON id = tag_id
        WHERE account_id IN (SELECT dst FROM e WHERE src = {ACCOUNT} UNION SELECT src FROM e WHERE dst = {ACCOUNT}) GROUP BY ALL ORDER BY count DESC, tag_id LIMIT 20""",
        "relations", "likes", "posts", "account_tags", "tags", e=EDGES,
    )
)
def related_tag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.related_tag_stats(edges_of(spark, sf_dir), ACCOUNT, b.account_tags(spark, sf_dir), b.tags(spark, sf_dir))


# ---------------------------------------------------------------- hierarchy


@query(stated("SELECT 2000::BIGINT AS root_id, id FROM below", "tag_edges", below=BELOW))
def tag_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(b.tag_edges(spark, sf_dir), spark.createDataFrame([(ROOT_TAG,)], "id long"))


@query(stated("SELECT DISTINCT root_id, id FROM below", "tag_edges", "tags", below="SELECT id AS root_id, id FROM tags UNION SELECT root_id, sub FROM below JOIN tag_edges ON super = id"))
def tag_descendants_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.closure(b.tag_edges(spark, sf_dir), b.tags(spark, sf_dir).select("id"))


@query(
    stated(
        "SELECT s.id AS super, t.id AS sub, EXISTS (SELECT 1 FROM below WHERE root_id = t.id AND below.id = s.id) AS cycle FROM tags s JOIN tags t ON (s.tag_type = 'nation' AND t.tag_type = 'region') OR s.id = t.id",
        "tag_edges", "tags", below="SELECT id AS root_id, id FROM tags UNION SELECT root_id, sub FROM below JOIN tag_edges ON super = id",
    )
)
def tag_cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether edges from each nation to each region, and from each tag to itself, would close a cycle."""
    known = b.tags(spark, sf_dir).withColumn("on", F.lit(1))
    nations, regions = (known.where(F.col("tag_type") == t) for t in ("nation", "region"))
    pairs = nations.select(F.col("id").alias("super"), "on").join(regions.select(F.col("id").alias("sub"), "on"), "on").select("super", "sub")
    return hierarchy.would_cycle(b.tag_edges(spark, sf_dir), pairs.union(known.select("id", "id")))


@query(stated("SELECT DISTINCT root_id, id FROM below", "relations", below="SELECT other_id AS root_id, other_id AS id FROM relations UNION SELECT root_id, r.other_id FROM below JOIN (SELECT * FROM relations WHERE kind = 'tag') r ON r.follower_id = id"))
def reachable_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account reaches over tag relations, which have cycles."""
    relations = b.relations(spark, sf_dir)
    edges = relations.where("kind = 'tag'").select(F.col("follower_id").alias("super"), F.col("other_id").alias("sub")).distinct()
    return hierarchy.closure(edges, relations.select(F.col("other_id").alias("id")))


def tagged(spark: SparkSession, sf_dir: str) -> tags.Tagged:
    media = b.media(spark, sf_dir)
    return tags.Tagged(b.tag_edges(spark, sf_dir), b.account_tags(spark, sf_dir), b.post_tags(spark, sf_dir), b.media_tags(spark, sf_dir), b.posts(spark, sf_dir), media)


SCOPES = {
    "account": {"account": "SELECT account_id AS m, tag_id FROM account_tags", "post": "SELECT p.account_id AS m, tag_id FROM post_tags t JOIN posts p ON p.id = t.post_id", "media": "SELECT account_id AS m, tag_id FROM media_tags JOIN media USING (media_key)"},
    "post": {"account": "SELECT p.id AS m, tag_id FROM posts p JOIN account_tags USING (account_id)", "post": "SELECT post_id AS m, tag_id FROM post_tags", "media": "SELECT post_id AS m, tag_id FROM media_tags JOIN media USING (media_key)"},
    "media": {"account": "SELECT media_key AS m, tag_id FROM media JOIN account_tags USING (account_id)", "post": "SELECT media_key AS m, tag_id FROM media JOIN post_tags USING (post_id)", "media": "SELECT media_key AS m, tag_id FROM media_tags"},
}


def filter_sql(entity: str, ids: list[int], mode: str, scopes: list[str]) -> str:
    seeds = " UNION ALL ".join(f"SELECT {i}::BIGINT AS root_id, {i}::BIGINT AS id" for i in ids)
    having = f" HAVING count(DISTINCT root_id) = {len(set(ids))}" if mode == "all" else ""
    return stated(
        f"SELECT m AS matched_id FROM reach JOIN below ON id = tag_id GROUP BY m{having}",
        "accounts", "posts", "media", "account_tags", "post_tags", "media_tags", "tag_edges",
        below=f"{seeds} UNION SELECT root_id, sub FROM below JOIN tag_edges ON super = id",
        reach=" UNION ALL ".join(f"({SCOPES[entity][s]})" for s in scopes),
    )


@query(filter_sql("account", [3, REGION_TAG], "any", ["account"]))
def tag_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_filter(tagged(spark, sf_dir), "account", [3, REGION_TAG], "any")


@query(filter_sql("account", [3, REGION_TAG], "all", ["account", "post", "media"]))
def tag_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_filter(tagged(spark, sf_dir), "account", [3, REGION_TAG, 3], "all", ["account", "post", "media"])


@query(filter_sql("media", [5], "any", ["post", "account"]))
def tag_filter_scope_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_filter(tagged(spark, sf_dir), "media", [5], "any", ["post", "account", "nonsense"])


@query(filter_sql("post", [1002], "any", ["media", "account"]))
def tag_filter_scope_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_filter(tagged(spark, sf_dir), "post", [1002], "any", ["media", "account"])


@query(filter_sql("account", [8, 9], "all", ["post", "media"]))
def tag_filter_scope_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_filter(tagged(spark, sf_dir), "account", [8, 9], "all", ["media", "post"])


@query(
    stated(
        """SELECT (SELECT count(DISTINCT account_id) FROM account_tags WHERE tag_id IN (SELECT id FROM below)) AS account_count,
        (SELECT count(DISTINCT post_id) FROM post_tags WHERE tag_id IN (SELECT id FROM below)) AS post_count,
        (SELECT count(DISTINCT media_key) FROM media_tags WHERE tag_id IN (SELECT id FROM below)) AS media_count, 0::BIGINT AS media_part_count""",
        "media", "account_tags", "post_tags", "media_tags", "tag_edges", below="SELECT 1001::BIGINT AS id UNION SELECT sub FROM below JOIN tag_edges ON super = id",
    )
)
def tag_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.usage_counts(tagged(spark, sf_dir), REGION_TAG)


@query(stated("SELECT t.id, t.name, t.tag_type, coalesce(string_agg(DISTINCT s.name, ';' ORDER BY s.name), '') AS parents FROM tags t LEFT JOIN tag_edges e ON e.sub = t.id LEFT JOIN tags s ON s.id = e.super GROUP BY ALL", "tags", "tag_edges"))
def tag_list_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.with_parents(b.tags(spark, sf_dir), b.tag_edges(spark, sf_dir)).withColumn("parents", F.array_join("parents", ";"))


@query(stated("SELECT coalesce(tag_type, 'null') AS tag_type, count(*) AS n FROM tags GROUP BY 1", "tags"))
def tag_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.counts_by_type(b.tags(spark, sf_dir))


@query(stated("SELECT 'parent' AS relation, super AS id, name FROM tag_edges JOIN tags ON id = super WHERE sub = 3 UNION ALL SELECT 'child', sub, name FROM tag_edges JOIN tags ON id = sub WHERE super = 3", "tags", "tag_edges"))
def tag_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.relatives(b.tags(spark, sf_dir), b.tag_edges(spark, sf_dir), 3)


@query(stated("SELECT super, sub, s.tag_type FROM tag_edges JOIN tags s ON s.id = super JOIN tags t ON t.id = sub WHERE s.tag_type = t.tag_type", "tags", "tag_edges"))
def tag_inner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.inner_edges(b.tags(spark, sf_dir), b.tag_edges(spark, sf_dir))


@query(stated("SELECT account_id, string_agg(tag_id || ':' || name, ';' ORDER BY tag_id) AS tags FROM account_tags JOIN tags ON id = tag_id GROUP BY account_id", "account_tags", "tags"))
def tags_of_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tags.hydrated(b.account_tags(spark, sf_dir), "account_id", b.tags(spark, sf_dir))
    return rows.select("account_id", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["tag_id"], t["name"])), ";").alias("tags"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, coalesce(n_regionkey IN (0, 2), true) AS allowed FROM nation")
def affinity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tags may be put on accounts: types that list the entity, or list nothing."""
    listed = F.when(F.col("n_regionkey").isin(0, 2), '["account", "post"]').otherwise('["media"]')
    rows = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), listed.alias("affinity"))
    return tags.fits(rows, "affinity", "account").select("id", "name", "allowed")


@query(
    stated(
        """SELECT entity, tag, tag_type, coalesce(account_id::VARCHAR, '') AS account_id, coalesce(tag_id::VARCHAR, '') AS tag_id, CASE WHEN message IS NOT NULL THEN 'error' WHEN there THEN 'exists' ELSE 'added' END AS status, message FROM (
          SELECT r.entity, r.tag, r.tag_type, a.id AS account_id, t.id AS tag_id, EXISTS (SELECT 1 FROM account_tags x WHERE x.account_id = a.id AND x.tag_id = t.id) AS there,
            CASE WHEN a.id IS NULL THEN 'entity not found' WHEN t.id IS NULL THEN 'tag not found' END AS message
          FROM (SELECT s_suppkey::VARCHAR AS entity, ' ' || lower(n_name) AS tag, 'Nation' AS tag_type FROM supplier JOIN nation ON n_nationkey = s_nationkey
                UNION ALL SELECT 'nobody' || s_suppkey, 'x', '' FROM supplier UNION ALL SELECT lower(replace(c_name, '#', '_')), 'no such tag', NULL FROM customer) r
          LEFT JOIN accounts a ON a.id::VARCHAR = r.entity OR a.url_suffix = r.entity LEFT JOIN tags t ON lower(trim(t.name)) = lower(trim(r.tag)) AND (coalesce(r.tag_type, '') = '' OR lower(r.tag_type) = t.tag_type))""",
        "accounts", "tags", "account_tags",
    )
)
def annotation_import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.table(spark, sf_dir, "supplier")
    named = s.join(b.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = named.select(F.col("s_suppkey").cast("string").alias("entity"), F.concat(F.lit(" "), F.lower("n_name")).alias("tag"), F.lit("Nation").alias("tag_type"))
    rows = rows.union(s.select(F.concat(F.lit("nobody"), "s_suppkey"), F.lit("x"), F.lit("")))
    rows = rows.union(b.accounts(spark, sf_dir).select("url_suffix", F.lit("no such tag"), F.lit(None).cast("string")))
    out = tags.annotation_import(rows, b.accounts(spark, sf_dir), b.tags(spark, sf_dir), b.account_tags(spark, sf_dir))
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("account_id", "tag_id")})


# ---------------------------------------------------------------- access, imports and guards of tags

FLAGS = "SELECT *, id % 3 = 0 AS quick_access, id % 7 = 6 AS omitted FROM tags"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.tags(spark, sf_dir).withColumn("quick_access", F.col("id") % 3 == 0).withColumn("omitted", F.col("id") % 7 == 6)


@query(
    stated(
        """SELECT 'tag' AS part, name, NULL::BIGINT AS super, NULL::BIGINT AS sub FROM f WHERE quick_access UNION ALL SELECT 'list', name, NULL, NULL FROM f WHERE NOT omitted
        UNION ALL SELECT 'edge', s.tag_type, super, sub FROM e JOIN f s ON s.id = super JOIN f t ON t.id = sub WHERE s.tag_type = t.tag_type AND NOT s.omitted AND NOT t.omitted""",
        "tags", f=f"{FLAGS.replace('FROM tags', '')} FROM tags WHERE tag_type = 'nation'", e="SELECT n_nationkey::BIGINT AS super, n_nationkey::BIGINT + 1 AS sub FROM nation",
    )
)
def tag_quick_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is offered for accounts; edges from each nation to the next stand in for a hierarchy within a type."""
    types = spark.sql("SELECT * FROM VALUES ('nation', true, '[\"account\"]'), ('region', true, '[\"media\"]') AS t(name, quick_access, affinity)")
    edges = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("super"), (F.col("n_nationkey") + 1).cast("long").alias("sub"))
    got = tags.quick_access(flagged(spark, sf_dir), types, edges, "account")
    none = F.lit(None).cast("long")
    lists = got.dropdowns.select(F.explode("tags").alias("t")).select(F.lit("list").alias("part"), F.col("t.name").alias("name"), none.alias("super"), none.alias("sub"))
    return got.tags.select(F.lit("tag").alias("part"), "name", none.alias("super"), none.alias("sub")).union(lists).union(got.edges.select(F.lit("edge"), "tag_type", "super", "sub"))


@query(stated("SELECT t.id, t.name, coalesce(string_agg(DISTINCT s.name, ';' ORDER BY s.name), '') AS parents FROM (SELECT * FROM tags WHERE tag_type = 'nation' AND contains(lower(name), '1') ORDER BY name, id LIMIT 5 OFFSET 5) t LEFT JOIN tag_edges e ON e.sub = t.id LEFT JOIN tags s ON s.id = e.super GROUP BY ALL", "tags", "tag_edges"))
def tag_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.listed(b.tags(spark, sf_dir), b.tag_edges(spark, sf_dir), "nation", "1", 2, 5).select("id", "name", F.array_join("parents", ";").alias("parents"))


@query(stated("SELECT 'type' AS kind, x.name AS id, count(t.id) = 0 AS allowed, count(t.id) AS uses FROM (VALUES ('nation'), ('region'), ('unused')) x(name) LEFT JOIN tags t ON t.tag_type = x.name GROUP BY ALL UNION ALL SELECT 'tag', t.id::VARCHAR, count(a.tag_id) = 0, count(a.tag_id) FROM tags t LEFT JOIN account_tags a ON a.tag_id = t.id GROUP BY t.id", "tags", "account_tags"))
def tag_delete_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.sql("SELECT * FROM VALUES ('nation'), ('region'), ('unused') AS t(name)")
    return tags.deletable(types, b.tags(spark, sf_dir), b.account_tags(spark, sf_dir))


IMPORT_ROWS = """SELECT s_suppkey * 10 + k AS n, ' Account' AS entity_type, s_suppkey::VARCHAR AS entity, ' ' || lower(n_name) AS tag, 'Nation' AS tag_type, '' AS notes FROM supplier JOIN nation ON n_nationkey = s_nationkey CROSS JOIN (VALUES (2), (4)) v(k)
    UNION ALL SELECT c_custkey * 10 + 3, 'account', '@' || lower(replace(c_name, '#', '_')), 'china', NULL, 'n' FROM customer
    UNION ALL SELECT o_orderkey * 10, 'post', o_orderkey::VARCHAR, n_name, NULL, o_orderpriority FROM orders JOIN nation ON n_nationkey = (o_orderkey + o_custkey % 2) % 25
    UNION ALL SELECT p_partkey * 10 + 1, 'media', p_name, 'x', '', NULL FROM part UNION ALL SELECT p_partkey * 10 + 5, 'story', p_partkey::VARCHAR, ' ', NULL, NULL FROM part UNION ALL SELECT p_partkey * 10 + 6, 'media', p_partkey::VARCHAR, 'ASIA', 'region', NULL FROM part"""


@query(
    stated(
        """SELECT j.n, j.k AS entity_type, j.entity, coalesce(j.entity_id, -1) AS entity_id, coalesce(j.tag_id, -1) AS tag_id, coalesce(j.notes, '') AS notes, j.errors,
          CASE WHEN j.errors <> '' THEN 'error' WHEN EXISTS (SELECT 1 FROM x WHERE x.k = j.k AND x.entity_id = j.entity_id AND x.tag_id = j.tag_id) OR min(CASE WHEN j.errors = '' THEN j.n END) OVER (PARTITION BY j.k, j.entity_id, j.tag_id) < j.n THEN 'exists' ELSE 'added' END AS status
        FROM (SELECT r.*, lower(trim(r.entity_type)) AS k, p.entity_id, t.id AS tag_id,
            concat_ws(';', CASE WHEN lower(trim(r.entity_type)) = 'story' THEN 'unknown entity type' WHEN lower(trim(r.entity_type)) <> 'account' AND NOT regexp_full_match(r.entity, '[0-9]+') THEN 'an id is required' WHEN p.entity_id IS NULL THEN 'entity not found' END,
              CASE WHEN trim(r.tag) = '' THEN 'tag is required' WHEN t.id IS NULL THEN 'tag not found' END) AS errors
          FROM r LEFT JOIN p ON p.k = lower(trim(r.entity_type)) AND p.e = ltrim(r.entity, '@') LEFT JOIN tags t ON lower(trim(t.name)) = lower(trim(r.tag)) AND (coalesce(r.tag_type, '') = '' OR lower(r.tag_type) = t.tag_type)) j""",
        "accounts", "tags", "account_tags", "posts", "post_tags", r=IMPORT_ROWS,
        p="SELECT 'account' AS k, id::VARCHAR AS e, id AS entity_id FROM accounts UNION ALL SELECT 'account', url_suffix, id FROM accounts UNION ALL SELECT 'post', id::VARCHAR, id FROM posts UNION ALL SELECT 'media', p_partkey::VARCHAR, p_partkey FROM part",
        x="SELECT 'account' AS k, account_id AS entity_id, tag_id FROM account_tags UNION ALL SELECT 'post', post_id, tag_id FROM post_tags UNION ALL SELECT 'media', p_partkey, 1000 + p_partkey % 5 FROM part",
    )
)
def annotations_import_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of accounts, posts and media from one import: by id, by address, repeated, and with every error but ambiguity."""
    nation, part = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    named = b.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("*", F.explode(F.array(F.lit(2), F.lit(4))).alias("k"))
    rows = named.select((F.col("s_suppkey") * 10 + F.col("k")).cast("long").alias("row"), F.lit(" Account").alias("entity_type"), F.col("s_suppkey").cast("string").alias("entity"), F.concat(F.lit(" "), F.lower("n_name")).alias("tag"), F.lit("Nation").alias("tag_type"), F.lit("").alias("notes"))
    rows = rows.union(b.accounts(spark, sf_dir).select(F.col("id") * 10 + 3, F.lit("account"), F.concat(F.lit("@"), "url_suffix"), F.lit("china"), none, F.lit("n")))
    posts = b.posts(spark, sf_dir).join(nation, F.col("n_nationkey") == (F.col("id") + F.col("account_id") % 2) % 25)
    rows = rows.union(posts.select(F.col("id") * 10, F.lit("post"), F.col("id").cast("string"), "n_name", none, "caption"))
    key = F.col("p_partkey")
    rows = rows.union(part.select(key * 10 + 1, F.lit("media"), "p_name", F.lit("x"), F.lit(""), none)).union(part.select(key * 10 + 5, F.lit("story"), key.cast("string"), F.lit(" "), none, none))
    rows = rows.union(part.select(key * 10 + 6, F.lit("media"), key.cast("string"), F.lit("ASIA"), F.lit("region"), none))
    entities = {
        "account": tags.Annotatable(b.accounts(spark, sf_dir), b.account_tags(spark, sf_dir).withColumnRenamed("account_id", "entity_id"), True),
        "post": tags.Annotatable(b.posts(spark, sf_dir), b.post_tags(spark, sf_dir).withColumnRenamed("post_id", "entity_id")),
        "media": tags.Annotatable(part.select(key.alias("id")), part.select(key.alias("entity_id"), (key % 5 + 1000).alias("tag_id"))),
    }
    out = tags.annotations_import(rows, entities, b.tags(spark, sf_dir))
    missing = F.lit(-1).cast("long")
    return out.select(F.col("row").alias("n"), "entity_type", "entity", F.coalesce("entity_id", missing).alias("entity_id"), F.coalesce("tag_id", missing).alias("tag_id"), F.coalesce("notes", F.lit("")).alias("notes"), F.array_join("errors", ";").alias("errors"), "status")
