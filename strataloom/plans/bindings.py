"""Domain tables over the driver's tables: accounts, posts, media, tags, interactions and observations.

Each function has a SQL twin in SQL, under the same name, for the oracles.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.lineage import shared_root
from strataloom.operators.wordindex import WordIndex, index_of

#: Interaction kinds by event type.
KINDS = {"view": "follow", "click": "suggested", "purchase": "comment", "signup": "tag"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_index(spark: SparkSession, sf_dir: str, source: str, rows: DataFrame, id_: str, words: Column) -> WordIndex:
    """The word index of rows that come from table `source`, stored once a session and state of the table's files."""
    files = table(spark, sf_dir, source).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0]
    key = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir} {source} {id_} {words} {state}".encode()).hexdigest()[:24]
    return index_of(spark, f"{shared_root(spark)}/words-{key}", rows, id_, words)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("url_suffix"), F.col("c_mktsegment").alias("bio"), F.col("c_acctbal").alias("balance")
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("publication_date"), F.col("o_orderpriority").alias("caption"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders; the id is made of the line's columns, of which the pair (order, line number) is no key."""
    line = table(spark, sf_dir, "lineitem")
    local = F.concat_ws("/", F.lit("m"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.select(
        F.col("l_orderkey").alias("post_id"),
        local.alias("media_key"),
        F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "N", "image").otherwise("video").alias("media_type"),
        F.when(F.col("l_linestatus") != "F", local).alias("local_url"),
        F.col("l_extendedprice").alias("size"),
        F.col("l_suppkey").alias("tagger"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of posts that are known, with the post's account and date."""
    dated = posts(spark, sf_dir).select(F.col("id").alias("post_id"), "account_id", "publication_date")
    return files(spark, sf_dir).join(dated, "post_id")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("tag_type"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("tag_type"))
    return regions.union(nations)


def tag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(super, sub); a root above all regions and a shortcut from it to one nation make the hierarchy a graph with two paths."""
    nation = table(spark, sf_dir, "nation")
    edges = nation.select((F.col("n_regionkey") + 1000).cast("long").alias("super"), F.col("n_nationkey").cast("long").alias("sub"))
    top = table(spark, sf_dir, "region").select(F.lit(2000).cast("long").alias("super"), (F.col("r_regionkey") + 1000).cast("long").alias("sub"))
    return edges.union(top).union(spark.range(1).select(F.lit(2000).cast("long").alias("super"), F.lit(3).cast("long").alias("sub")))


def account_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").cast("long").alias("tag_id"))


def post_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 25).alias("tag_id"))


def media_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tagger"), F.col("s_nationkey").cast("long").alias("tag_id"))
    return media(spark, sf_dir).select("media_key", "tagger").join(nation, "tagger").select("media_key", "tag_id").distinct()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(follower_id, other_id, kind) of events; the other account follows from the event's number."""
    n = table(spark, sf_dir, "customer").count()
    kind = F.expr("CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items()) + " END")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("follower_id"), kind.alias("kind")).where("kind IS NOT NULL")
    return rows.select("follower_id", (F.col("event_id") % F.lit(n)).alias("other_id"), "kind")


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, account_id): who took part in a line likes its post."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("account_id"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sessions saw of accounts: (canonical_id, session, seen_at, ord, note, value); every fifth note is blank."""
    note = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("canonical_id"), F.col("event_type").alias("session"), F.col("ts").alias("seen_at"), F.col("event_id").alias("ord"), note.alias("note"), "value")


def raw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with types as captures have them: none, follower, following, suggested."""
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'follower' WHEN 1 THEN 'suggested' WHEN 2 THEN 'following' END")
    n = table(spark, sf_dir, "customer").count()
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("follower_id"), (F.col("event_id") % F.lit(n)).alias("other_id"), kind.alias("kind"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases comment on the post with their number."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select(F.col("event_id").alias("id"), F.col("event_id").alias("post_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("publication_date"), F.col("props").alias("text"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second lines tag an account in their media, third ones in their post."""
    key = F.concat_ws("/", F.lit("m"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber IN (2, 3)")
    return rows.select((F.col("l_suppkey") * 3).alias("tagged_account_id"), F.when(F.col("l_linenumber") == 3, F.col("l_orderkey")).alias("post_id"), F.when(F.col("l_linenumber") == 2, key).alias("media_key"))


def full_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with platform, identifiers, raw data and post counts; every fourth has an earlier address among its identifiers."""
    rows = accounts(spark, sf_dir).withColumn("platform", F.lit("instagram"))
    old = F.when(F.col("id") % 4 == 0, F.concat(F.lit("url_old_"), "url_suffix", F.lit("/")))
    data = F.expr("CASE id % 4 WHEN 0 THEN '{\"is_verified\": true}' WHEN 1 THEN '{\"is_verified\": \"true\"}' WHEN 2 THEN '{\"is_verified\": false}' ELSE 'no json' END")
    counts = posts(spark, sf_dir).groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("post_count"))
    return rows.withColumn("identifiers", F.array_compact(F.array(F.concat(F.lit("url_"), "url_suffix"), old))).withColumn("data", data).join(counts, "id", "left")


def full_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("*", F.concat(F.lit("p/"), "id").alias("url_suffix"), F.lit("instagram").alias("platform"), F.concat(F.lit("p"), "id").alias("id_on_platform"))


def full_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media with an address, words about them and, for every third post, a thumbnail."""
    rows = media(spark, sf_dir)
    return rows.select(
        "*", F.concat(F.lit("v/"), "media_key").alias("url_suffix"), F.lit("instagram").alias("platform"), F.concat_ws(" ", "media_type", F.lit("of"), F.date_format("publication_date", "yyyy")).alias("annotation"),
        F.when(F.col("post_id") % 3 == 0, F.concat(F.lit("thumbs/"), "media_key")).alias("thumbnail_path"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions, with their first turn as notes; every third has no address."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    suffix = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("archived/"), "conv_id"))
    return first.select(F.col("conv_id").alias("id"), suffix.alias("url_suffix"), F.lit("instagram").alias("platform"), F.col("text").alias("notes"), F.timestamp_seconds(F.col("conv_id") % 50 * 86400).alias("archived_at"))


def session_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark, sf_dir).select((F.col("post_id") % 100).alias("session_id"), "media_key")


def media_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_id, media_key): parts of the media of first lines."""
    return media(spark, sf_dir).where(F.split_part("media_key", F.lit("/"), F.lit(3)) == "1").select(F.concat(F.lit("part/"), "media_key").alias("part_id"), "media_key").distinct()


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_id, tag_id): what is tagged in the part of a first line, by its order."""
    return media_parts(spark, sf_dir).select("part_id", (F.split_part("media_key", F.lit("/"), F.lit(2)).cast("long") % 25).alias("tag_id"))


SQL = {
    "accounts": "SELECT c_custkey AS id, c_name AS display_name, lower(replace(c_name, '#', '_')) AS url_suffix, c_mktsegment AS bio, c_acctbal AS balance FROM customer",
    "posts": "SELECT o_orderkey AS id, o_custkey AS account_id, o_orderdate AS publication_date, o_orderpriority AS caption FROM orders",
    "media": """SELECT post_id, media_key, media_type, CASE WHEN l_linestatus <> 'F' THEN media_key END AS local_url, size, tagger, account_id, publication_date FROM (
      SELECT l_orderkey AS post_id, concat_ws('/', 'm', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS media_key,
        CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'N' THEN 'image' ELSE 'video' END AS media_type, l_linestatus, l_extendedprice AS size, l_suppkey AS tagger,
        o_custkey AS account_id, o_orderdate AS publication_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "tags": "SELECT r_regionkey::BIGINT + 1000 AS id, r_name AS name, 'region' AS tag_type FROM region UNION ALL SELECT n_nationkey::BIGINT, n_name, 'nation' FROM nation",
    "tag_edges": "SELECT n_regionkey::BIGINT + 1000 AS super, n_nationkey::BIGINT AS sub FROM nation UNION ALL SELECT 2000, r_regionkey::BIGINT + 1000 FROM region UNION ALL SELECT 2000, 3",
    "account_tags": "SELECT c_custkey AS account_id, c_nationkey::BIGINT AS tag_id FROM customer",
    "post_tags": "SELECT o_orderkey AS post_id, o_orderkey % 25 AS tag_id FROM orders",
    "media_tags": "SELECT DISTINCT media_key, s_nationkey::BIGINT AS tag_id FROM media JOIN supplier ON tagger = s_suppkey",
    "relations": "SELECT user_id AS follower_id, event_id % (SELECT count(*) FROM customer) AS other_id, CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items()) + " END AS kind FROM events WHERE event_type IN (" + ", ".join(f"'{e}'" for e in KINDS) + ")",
    "likes": "SELECT l_orderkey AS post_id, l_suppkey AS account_id FROM lineitem",
    "observations": "SELECT user_id AS canonical_id, event_type AS session, ts AS seen_at, event_id AS ord, CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS note, value FROM events",
    "raw_relations": "SELECT user_id AS follower_id, event_id % (SELECT count(*) FROM customer) AS other_id, CASE event_id % 4 WHEN 0 THEN 'follower' WHEN 1 THEN 'suggested' WHEN 2 THEN 'following' END AS kind FROM events",
    "comments": "SELECT event_id AS id, event_id AS post_id, user_id AS account_id, ts AS publication_date, props AS text FROM events WHERE event_type = 'purchase'",
    "tagged": "SELECT l_suppkey * 3 AS tagged_account_id, CASE WHEN l_linenumber = 3 THEN l_orderkey END AS post_id, CASE WHEN l_linenumber = 2 THEN concat_ws('/', 'm', l_orderkey, l_linenumber, l_partkey, l_suppkey) END AS media_key FROM lineitem WHERE l_linenumber IN (2, 3)",
    "full_accounts": """SELECT a.*, 'instagram' AS platform, CASE WHEN id % 4 = 0 THEN ['url_' || url_suffix, 'url_old_' || url_suffix || '/'] ELSE ['url_' || url_suffix] END AS identifiers,
      CASE id % 4 WHEN 0 THEN true WHEN 2 THEN false END AS verified, n AS post_count FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS n FROM posts GROUP BY 1) ON account_id = id""",
    "full_posts": "SELECT *, 'p/' || id AS url_suffix, 'instagram' AS platform, 'p' || id AS id_on_platform FROM posts",
    "full_media": "SELECT *, 'v/' || media_key AS url_suffix, 'instagram' AS platform, media_type || ' of ' || strftime(publication_date, '%Y') AS annotation, CASE WHEN post_id % 3 = 0 THEN 'thumbs/' || media_key END AS thumbnail_path FROM media",
    "sessions": "SELECT conv_id AS id, CASE WHEN conv_id % 3 <> 0 THEN 'archived/' || conv_id END AS url_suffix, 'instagram' AS platform, text AS notes, make_timestamp((conv_id % 50 * 86400 * 1000000)::BIGINT) AS archived_at FROM conversations WHERE turn = 0",
    "session_media": "SELECT post_id % 100 AS session_id, media_key FROM media",
    "media_parts": "SELECT DISTINCT 'part/' || media_key AS part_id, media_key FROM media WHERE split_part(media_key, '/', 3) = '1'",
    "part_tags": "SELECT part_id, split_part(media_key, '/', 2)::BIGINT % 25 AS tag_id FROM media_parts",
}
