"""Queries over the entity-resolution, reconciliation and extraction operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import normalize as n
from strataloom.operators import incorporate as inc
from strataloom.operators import integrity, maintenance, media, reconcile, resolve, sinks
from strataloom.plans import bindings as b
from strataloom.plans.query import query, stated
from strataloom.sources import captures


@query(
    """WITH RECURSIVE k AS (SELECT doc_id AS d, 'a' || md5(text) AS v FROM documents UNION ALL SELECT doc_id, 'b' || source || '/' || n_chars FROM documents),
    f AS (SELECT v, min(d) AS a FROM k GROUP BY v), l AS (SELECT DISTINCT a, d AS b FROM k JOIN f USING (v) WHERE a <> d), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT a AS doc_id, min(b) AS cluster FROM r GROUP BY a"""
)
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), F.concat_ws("/", "source", "n_chars").alias("shape_key"))
    return resolve.clusters(docs, "doc_id", [F.col("text_key"), F.col("shape_key")]).select("doc_id", "cluster")


@query(
    stated(
        "SELECT o.follower_id, o.other_id, coalesce(s.id, i.id) AS canonical_id FROM (SELECT follower_id, other_id, CASE WHEN kind = 'follow' THEN 'customer_' || lpad(other_id::VARCHAR, 9, '0') END AS suffix, 'p' || follower_id AS pid FROM relations) o"
        " LEFT JOIN accounts s ON s.url_suffix = o.suffix LEFT JOIN (SELECT 'p' || id AS pid, id FROM accounts) i ON i.pid = o.pid",
        "relations", "accounts",
    )
)
def dual_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = b.accounts(spark, sf_dir).select("id", "url_suffix", F.concat(F.lit("p"), "id").alias("id_on_platform"))
    suffix = F.when(F.col("kind") == "follow", F.concat(F.lit("customer_"), F.lpad(F.col("other_id").cast("string"), 9, "0")))
    rows = b.relations(spark, sf_dir).select("follower_id", "other_id", suffix.alias("url_suffix"), F.concat(F.lit("p"), "follower_id").alias("id_on_platform"))
    return resolve.dual_key_lookup(rows, known).select("follower_id", "other_id", "canonical_id")


@query(
    stated(
        "SELECT canonical_id, arg_max(note, (seen_at, ord)) FILTER (WHERE trim(note) <> '') AS note, arg_max(value, (seen_at, ord)) FILTER (WHERE value IS NOT NULL) AS value FROM observations GROUP BY canonical_id",
        "observations",
    )
)
def reconcile_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.fold(b.observations(spark, sf_dir), ["canonical_id"], ["seen_at", "ord"], ["note", "value"])


@query(stated("SELECT canonical_id, arg_min(note, (seen_at, ord)) FILTER (WHERE trim(note) <> '') AS note FROM observations GROUP BY canonical_id", "observations"))
def reconcile_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.fold(b.observations(spark, sf_dir), ["canonical_id"], ["seen_at", "ord"], ["note"], newest=False)


@query(stated("SELECT canonical_id, arg_max(note, (seen_at, ord)) AS note FROM observations WHERE trim(note) <> '' GROUP BY canonical_id", "observations"))
def latest_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.latest_filled(b.observations(spark, sf_dir), "canonical_id", "note", ["seen_at", "ord"])


@query(
    stated(
        "SELECT post_id, media_type, max(size) AS size, count(*) AS copies, arg_min(media_key, (-size, media_key)) AS media_key FROM media GROUP BY post_id, media_type",
        "media",
    )
)
def largest_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.largest_copy(b.media(spark, sf_dir), ["post_id", "media_type"], "media_key", "size")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.duplicate_keys(b.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


RANKS = {"F": 2, "O": 1, "P": 0}


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' WHEN bool_or(o_orderstatus = 'O') THEN 'O' ELSE 'P' END AS status, arg_min(note, o_orderkey) FILTER (WHERE note <> '') AS note, count(*) AS merged FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS note FROM orders) GROUP BY o_custkey")
def keeper_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = b.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), note.alias("note"))
    return reconcile.keepers(rows, "o_custkey", "o_orderkey", RANKS, ["note"])


@query(stated("SELECT id FROM accounts WHERE id NOT IN (SELECT follower_id FROM relations) AND id NOT IN (SELECT other_id FROM relations WHERE kind = 'tag') AND id NOT IN (SELECT account_id FROM likes)", "accounts", "relations", "likes"))
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b.relations(spark, sf_dir)
    return inc.without_references(
        b.accounts(spark, sf_dir).select("id"), r.select(F.col("follower_id").alias("id")), r.where("kind = 'tag'").select(F.col("other_id").alias("id")), b.likes(spark, sf_dir).select(F.col("account_id").alias("id"))
    )


@query(stated("SELECT a.*, coalesce(p.n, 0) AS post_count FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS n FROM posts GROUP BY 1) p ON p.account_id = a.id", "accounts", "posts"))
def post_count_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.post_counts(b.accounts(spark, sf_dir), b.posts(spark, sf_dir))


@query("SELECT concat_ws('/', 'm', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS media_key, o_orderdate AS publication_date, o_custkey AS account_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def denormalize_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = b.table(spark, sf_dir, "lineitem")
    bare = line.select(F.col("l_orderkey").alias("post_id"), F.concat_ws("/", F.lit("m"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("media_key"), F.lit(None).cast("timestamp").alias("publication_date"), F.lit(None).cast("long").alias("account_id"))
    return inc.denormalised(bare, b.posts(spark, sf_dir)).select("media_key", "publication_date", "account_id")


ENTITY = inc.Entity("account", ("display_name", "bio"))


@query(
    stated(
        """SELECT CASE WHEN old THEN id ELSE top + row_number() OVER (PARTITION BY old ORDER BY id) END AS id, 'p' || id AS id_on_platform, url_suffix, 'id_p' || id || ';url_' || url_suffix AS identifiers, display_name, bio
        FROM (SELECT *, nation >= 10 AS old, (SELECT max(id) FROM accounts JOIN account_tags ON account_id = id WHERE tag_id >= 10) AS top FROM (SELECT a.*, tag_id AS nation FROM accounts a JOIN account_tags ON account_id = a.id))""",
        "accounts", "account_tags",
    )
)
def incorporate_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session sees every account; those of some nations are known by address only, the others are new."""
    accounts = b.accounts(spark, sf_dir).join(b.account_tags(spark, sf_dir).withColumnRenamed("account_id", "id"), "id")
    none = F.lit(None).cast("string")
    canonical = accounts.where("tag_id >= 10").select("id", none.alias("id_on_platform"), "url_suffix", F.array().cast("array<string>").alias("identifiers"), none.alias("display_name"), F.lit("").alias("bio"))
    observed = spark.createDataFrame([], "canonical_id long, session string, display_name string, bio string")
    rows = accounts.select(F.col("id").alias("ord"), F.concat(F.lit("p"), "id").alias("id_on_platform"), "url_suffix", "display_name", "bio")
    out = inc.incorporate(inc.Stored(canonical, observed), rows, "session-1", ENTITY).canonical
    return out.withColumn("identifiers", F.array_join("identifiers", ";"))


# ---------------------------------------------------------------- columns


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id::VARCHAR END AS platform_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'a/' || user_id END AS url_suffix, event_id % 11 <> 0 AS valid
    FROM events"""
)
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as captured, with their usual blemishes, brought to their stored form."""
    rows = b.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, "None").otherwise(F.concat_ws("", F.lit(" "), "user_id", F.lit("_"), "event_id")).alias("raw_id"),
        F.when(F.col("event_id") % 11 == 0, "None//").otherwise(F.concat_ws("", F.lit(" a/"), "user_id", F.lit("//?x="), "event_id")).alias("raw_url"),
    )
    return rows.select("event_id", n.platform_id(F.col("raw_id")).alias("platform_id"), n.url_suffix(F.col("raw_url")).alias("url_suffix"), n.valid_identifier(F.col("raw_url")).alias("valid"))


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS bare, split_part(split_part(url, '?', 1), '/', -1) AS filename, translate(url, '/.?&', '    ') AS parts, 'https://www.instagram.com/' || page_id AS full_url FROM pages")
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return b.table(spark, sf_dir, "pages").select(
        "page_id", n.without_prefix(n.without_prefix(url, "https://"), "http://").alias("bare"), n.cdn_filename(url).alias("filename"), n.url_parts(url).alias("parts"), n.full_url(F.col("page_id").cast("string"), F.lit("instagram")).alias("full_url")
    )


@query(f"SELECT o_orderkey, ltrim(array_to_string(list_transform(range(10, -1, -1), lambda k: substr('{n.CODE_DIGITS}', ((x >> (6 * k)::INT) & 63)::INT + 1, 1)), ''), 'A') AS code FROM (SELECT o_orderkey, o_orderkey * 1000003 + 12345678901 AS x FROM orders)")
def shortcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "orders").select("o_orderkey", n.shortcode(F.col("o_orderkey") * 1000003 + F.lit(12345678901)).alias("code"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 9 <> 0 AS valid FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, '', false FROM events WHERE event_id % 9 = 0")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value inside JSON text; text that is cut off is no JSON."""
    text = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    rows = b.table(spark, sf_dir, "events").select("event_id", n.json_or_null(text).alias("v"))
    return rows.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "string"), F.lit("")).alias("k"), F.col("v").isNotNull().alias("valid"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'error' WHEN o_totalprice > 150000 THEN 'generated' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pending' ELSE 'not_needed' END AS status FROM orders")
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_totalprice") > 150000, "generated").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "pending").otherwise("not_needed")
    return b.table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


# ---------------------------------------------------------------- media, integrity, pages


@query(
    """WITH s AS (SELECT l_orderkey, (l_linenumber - 1) * 25 AS a, (l_linenumber - 1) * 25 + l_quantity::INT - 1 AS z FROM lineitem),
    g AS (SELECT *, coalesce(max(z + 1) OVER (PARTITION BY l_orderkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
    h AS (SELECT *, sum((a > before)::INT) OVER (PARTITION BY l_orderkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gaps FROM g)
    SELECT l_orderkey, coalesce(max(z + 1) FILTER (WHERE gaps = 0), 0)::BIGINT AS covered, count(*) FILTER (WHERE gaps = 0) AS segments_used FROM h GROUP BY l_orderkey"""
)
def contiguous_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_linenumber") - 1) * 25
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("a"), (start + F.rint("l_quantity").cast("int") - 1).alias("z"))
    return media.coverage(rows, ["l_orderkey"], "a", "z")


@query("SELECT p_partkey, i AS chunk, sha256(substr(p_name, i::INT * 8 + 1, 8)) AS sha256 FROM (SELECT p_partkey, p_name, unnest(range(greatest(ceil(strlen(p_name) / 8)::BIGINT, 1))) AS i FROM part)")
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.chunk_hashes(b.table(spark, sf_dir, "part"), "p_partkey", "p_name", 8)


def tree_sql(key: str, files: str) -> str:
    """The roots of the trees over chunks of 4 bytes of files (key, v), layer by layer."""
    return f"""WITH RECURSIVE f AS ({files}),
    c AS (SELECT {key}, i, sha256(substr(v, i::INT * 4 + 1, 4)) AS h FROM (SELECT *, unnest(range(greatest(ceil(strlen(v) / 4)::BIGINT, 1))) AS i FROM f)),
    t AS (SELECT {key}, list(h ORDER BY i) AS h FROM c GROUP BY {key}
      UNION ALL SELECT {key}, list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(unhex(h[2 * i + 1]) || unhex(coalesce(h[2 * i + 2], h[2 * i + 1])))) FROM t WHERE len(h) > 1)
    SELECT {key}, h[1] AS root FROM t WHERE len(h) = 1"""


@query(tree_sql("r_regionkey", "SELECT r_regionkey, r_name AS v FROM region"))
def chunk_tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.tree_roots(integrity.chunk_hashes(b.table(spark, sf_dir, "region"), "r_regionkey", "r_name", 4), "r_regionkey")


@query(tree_sql("path", "SELECT 'region/' || r_regionkey AS path, r_name AS v FROM region UNION ALL SELECT 'part/' || p_partkey, p_name FROM part"))
def name_tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of every region's and part's name, whatever its length."""
    named = lambda name, key, text: b.table(spark, sf_dir, name).select(F.concat_ws("/", F.lit(name), key).alias("path"), F.col(text).alias("v"))
    files = named("region", "r_regionkey", "r_name").unionByName(named("part", "p_partkey", "p_name"))
    return integrity.tree_roots(integrity.chunk_hashes(files, "path", "v", 4), "path")


INDEX = "SELECT split_part(url, '/', 3) AS archive, url, CASE WHEN contains(html, '<script>') THEN 'text/html' END AS mime, page_id AS seen FROM pages"


def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("archive"), "url", F.when(F.contains("html", F.lit("<script>")), "text/html").alias("mime"), F.col("page_id").alias("at"))


@query(f"SELECT archive, coalesce(mime, 'unknown') AS mime, count(*) AS n FROM ({INDEX}) GROUP BY ALL")
def mime_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.mime_histogram(page_index(spark, sf_dir))


@query(f"SELECT archive, count(*) AS records, count(DISTINCT url) AS urls, min(seen) AS first_at, max(seen) AS last_at FROM ({INDEX}) GROUP BY archive")
def capture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.capture_stats(page_index(spark, sf_dir))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, len(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']+)[\"'']', 1)))::BIGINT AS n_links FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return b.table(spark, sf_dir, "pages").select("page_id", captures.page_title(html).alias("title"), F.size(captures.page_links(html)).cast("long").alias("n_links"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", captures.visible_text(F.col("html")).alias("text"))


# ---------------------------------------------------------------- repairs


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'parse_failed' WHEN event_id % 2 = 1 AND event_id % 5 <> 0 AND event_id % 3 <> 0 THEN 'parsed' WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN 'extract_failed' WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 'done' ELSE 'pending' END AS status, CASE event_id % 4 WHEN 0 THEN 'AA_xlsx' WHEN 1 THEN 'local_har' WHEN 2 THEN 'local_wacz' END AS source FROM events")
def session_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    status = maintenance.session_status(F.when(n % 2 == 1, 1), F.when(n % 5 == 0, 1), F.when(n % 3 == 0, "why"))
    return b.table(spark, sf_dir, "events").select("event_id", status.alias("status"), maintenance.source_name((n % 4).cast("int")).alias("source"))


THUMBS = "CASE event_id % 5 WHEN 0 THEN 'error: no frame' WHEN 1 THEN 't/' || event_id END"


@query(f"SELECT event_id, CASE WHEN p LIKE 'error:%' THEN 'error' WHEN p IS NOT NULL THEN 'generated' WHEN event_id % 3 = 0 OR event_type = 'view' THEN 'not_needed' ELSE 'pending' END AS status, CASE WHEN event_id % 6 IN (0, 3) OR event_id % 2 = 1 THEN 'generated' ELSE 'pending' END AS kept FROM (SELECT *, {THUMBS} AS p FROM events)")
def thumbnail_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From paths, and after files have changed: a status holds while the file is the same or still missing."""
    n = F.col("event_id")
    old, new = F.when(n % 3 != 0, F.lit("a")), F.when(n % 3 != 0, F.when(n % 2 == 1, "a").otherwise("b"))
    status = maintenance.thumbnail_status(F.expr(THUMBS), F.when(n % 3 != 0, "file"), F.when(F.col("event_type") == "view", "audio").otherwise("image"))
    return b.table(spark, sf_dir, "events").select("event_id", status.alias("status"), maintenance.kept_status(F.lit("generated"), old, new).alias("kept"))


@query(stated("SELECT media_key, CASE WHEN media_key IN (SELECT media_key FROM session_media WHERE session_id < 20) AND local_url LIKE 'https://%' AND size > 20000 THEN 'not_needed' WHEN size > 20000 THEN 'pending' ELSE 'generated' END AS thumbnail_status FROM (SELECT media_key, size, CASE WHEN media_type = 'video' THEN 'https://x/' || media_key ELSE local_url END AS local_url FROM media)", "posts", "media", "session_media"))
def remote_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = F.when(F.col("media_type") == "video", F.concat(F.lit("https://x/"), "media_key")).otherwise(F.col("local_url"))
    rows = b.media(spark, sf_dir).select("media_key", remote.alias("local_url"), F.when(F.col("size") > 20000, "pending").otherwise("generated").alias("thumbnail_status"))
    return maintenance.remote_not_needed(rows, b.session_media(spark, sf_dir).where("session_id < 20")).select("media_key", "thumbnail_status")


SESSIONS = "SELECT event_id AS id, CASE WHEN event_id % 7 > 0 THEN 'x' || event_id // 3 END AS external_id, (['pending', 'parse_failed', 'extract_failed', 'parsed', 'done'])[event_id % 5 + 1] AS status, CASE WHEN event_id % 4 = 1 THEN props END AS notes, CASE WHEN event_id % 2 = 0 THEN 'local_har' ELSE 'AA_xlsx' END AS source, CASE WHEN event_id % 5 IN (1, 2) THEN 'why' END AS error FROM events"


def some_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    status = F.expr("element_at(array('pending', 'parse_failed', 'extract_failed', 'parsed', 'done'), cast(event_id % 5 + 1 AS int))")
    return b.table(spark, sf_dir, "events").select(
        n.alias("id"), F.when(n % 7 > 0, F.concat(F.lit("x"), F.floor(n / 3))).alias("external_id"), status.alias("status"), F.when(n % 4 == 1, F.col("props")).alias("notes"), F.when(n % 2 == 0, "local_har").otherwise("AA_xlsx").alias("source"), F.when((n % 5).isin(1, 2), "why").alias("error")
    )


@query(f"SELECT id, CASE WHEN source = 'local_har' AND status = 'parse_failed' THEN 'pending' WHEN source = 'local_har' AND status = 'extract_failed' THEN 'parsed' ELSE status END AS status, CASE WHEN source <> 'local_har' OR status NOT IN ('parse_failed', 'extract_failed') THEN error END AS error FROM ({SESSIONS})")
def requeued_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.requeued(some_sessions(spark, sf_dir), "local_har").select("id", "status", "error")


RANK = "CASE status WHEN 'done' THEN 4 WHEN 'parsed' THEN 3 WHEN 'extract_failed' THEN 2 WHEN 'parse_failed' THEN 1 ELSE 0 END"
MERGED = f"""s AS ({SESSIONS}), k AS (SELECT external_id, min(id) AS keeper FROM s WHERE external_id IS NOT NULL GROUP BY 1),
    j AS (SELECT s.*, coalesce(keeper, id) AS keeper, {RANK} AS rank FROM s LEFT JOIN k USING (external_id))"""


@query(f"WITH {MERGED} SELECT keeper AS id, arg_max(status, rank) AS status, arg_min(notes, CASE WHEN id = keeper THEN -1000000000000 ELSE -rank * 10000000000 + id END) FILTER (WHERE notes IS NOT NULL) AS notes FROM j GROUP BY keeper")
def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = maintenance.Sessions(some_sessions(spark, sf_dir), {})
    return maintenance.merged_sessions(held, ["notes"]).sessions.select("id", "status", "notes")


@query(f"WITH {MERGED}, o AS (SELECT CASE WHEN event_id % 11 > 0 THEN user_id END AS canonical_id, event_id AS session_id, event_id AS mark FROM events) SELECT canonical_id, keeper AS session_id, mark FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, keeper ORDER BY session_id) AS r FROM o JOIN j ON j.id = session_id) WHERE r = 1 OR canonical_id IS NULL")
def repointed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = b.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 > 0, F.col("user_id")).alias("canonical_id"), F.col("event_id").alias("session_id"), F.col("event_id").alias("mark"))
    return maintenance.merged_sessions(maintenance.Sessions(some_sessions(spark, sf_dir), {"seen": seen}), ["notes"]).observed["seen"]


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'p/c' || event_id WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN NULL ELSE 'p/' || event_id END AS url_suffix, CASE WHEN event_id % 2 = 0 THEN 'url_u' || event_id ELSE 'id_' || event_id END AS identifier FROM events")
def repaired_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    data = F.when(n % 3 == 0, F.concat(F.lit('{"code": "c'), n, F.lit('"}'))).when(n % 3 == 1, F.when(n % 2 == 0, '{"product_type": "Story"}').otherwise("no json")).otherwise('{"code": ""}')
    ids = F.array(F.when(n % 2 == 0, F.concat(F.lit("url_https://www.instagram.com/u"), n)).otherwise(F.concat(F.lit("id_"), n)))
    return b.table(spark, sf_dir, "events").select("event_id", maintenance.repaired_address(F.concat(F.lit("p/"), n), data).alias("url_suffix"), maintenance.bare_identifiers(ids)[0].alias("identifier"))


@query("SELECT lower(n) AS folded, count(DISTINCT n) AS n FROM (SELECT c_name AS n FROM customer UNION ALL SELECT lower(c_name) FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1 HAVING count(DISTINCT n) > 1")
def folded_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_name").alias("n")).union(c.where("c_custkey % 3 = 0").select(F.lower("c_name")))
    return maintenance.folded_twins(rows, "n", F.lower("n"))


@query(stated("SELECT post_id, media_type, media_key FROM media WHERE (post_id, media_type) IN (SELECT (post_id, media_type) FROM media GROUP BY post_id, media_type HAVING count(DISTINCT media_key) > 1)", "posts", "media"))
def several_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.media(spark, sf_dir).withColumn("key", F.struct("post_id", "media_type"))
    return maintenance.several_copies(rows, "key", "media_key").select("post_id", "media_type", "media_key")


def contaminated(spark: SparkSession, sf_dir: str) -> maintenance.Accounts:
    n = F.col("event_id")
    suffix = F.when(n % 13 == 0, "None/").when(n % 17 == 0, "").when(n % 5 > 0, F.concat(F.lit("u"), "user_id"))
    observed = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("canonical_id"), F.col("event_id").alias("session_id"), suffix.alias("url_suffix"))
    accounts = b.full_accounts(spark, sf_dir).select("id", F.when(F.col("id") % 10 == 3, "None").otherwise(F.col("url_suffix")).alias("url_suffix"), "post_count")
    sessions = b.table(spark, sf_dir, "events").select(n.alias("id"), F.when(n % 2 == 0, "done").otherwise("pending").alias("status"))
    return maintenance.Accounts(accounts, observed, sessions, {"posts": (b.posts(spark, sf_dir).select("id", "account_id"), "account_id")})


@query(
    stated(
        """SELECT 'account' AS kind, id, CASE WHEN id % 10 <> 3 THEN url_suffix END AS value, CASE WHEN id IN (SELECT id FROM bad) THEN 0 ELSE post_count END AS n FROM full_accounts
        UNION ALL SELECT 'post', id, account_id::VARCHAR, NULL FROM posts WHERE account_id NOT IN (SELECT id FROM bad) UNION ALL SELECT 'post', id, NULL, NULL FROM posts WHERE account_id IN (SELECT id FROM bad)
        UNION ALL SELECT 'observed', session_id, url_suffix, NULL FROM o WHERE coalesce(url_suffix, 'x') NOT IN ('None/', '')
        UNION ALL SELECT 'session', event_id, CASE WHEN event_id % 2 = 1 THEN 'pending' WHEN user_id IN (SELECT id FROM bad) THEN 'parsed' ELSE 'done' END, NULL FROM events""",
        "accounts", "posts", "full_accounts",
        o="SELECT user_id AS canonical_id, event_id AS session_id, CASE WHEN event_id % 13 = 0 THEN 'None/' WHEN event_id % 17 = 0 THEN '' WHEN event_id % 5 > 0 THEN 'u' || user_id END AS url_suffix FROM events",
        bad="SELECT canonical_id AS id FROM o WHERE url_suffix IN ('None/', '') UNION SELECT id FROM accounts WHERE id % 10 = 3",
    )
)
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = maintenance.decontaminated(contaminated(spark, sf_dir))
    none = F.lit(None).cast("long")
    return (
        held.accounts.select(F.lit("account").alias("kind"), "id", F.col("url_suffix").alias("value"), F.col("post_count").alias("n"))
        .union(held.children["posts"][0].select(F.lit("post"), "id", F.col("account_id").cast("string"), none))
        .union(held.observed.select(F.lit("observed"), "session_id", "url_suffix", none))
        .union(held.sessions.select(F.lit("session"), "id", "status", none))
    )


# ---------------------------------------------------------------- sinks


@query("SELECT id, name FROM (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY c_custkey), c_name FROM customer WHERE c_custkey % 2 = 1)")
def appended_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows get consecutive ids after the largest."""
    stored = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    rows = b.table(spark, sf_dir, "customer").where("c_custkey % 2 = 1").select("c_custkey", F.col("c_name").alias("name"))
    return sinks.with_new(stored, rows, "c_custkey")


@query(stated("SELECT account_id, tag_id FROM account_tags UNION SELECT user_id, user_id % 25 FROM events", "account_tags"))
def inserted_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), (F.col("user_id") % 25).alias("tag_id"))
    return sinks.with_missing(b.account_tags(spark, sf_dir).distinct(), rows, ["account_id", "tag_id"])


@query(stated("SELECT account_id, tag_id FROM account_tags WHERE account_id NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, user_id % 5 FROM events WHERE user_id % 2 = 0", "account_tags"))
def replaced_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whoever is named loses all tags and gets those given, if any."""
    owners = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"))
    rows = owners.where("account_id % 2 = 0").distinct().withColumn("tag_id", F.col("account_id") % 5)
    return sinks.with_replaced(b.account_tags(spark, sf_dir), rows, "account_id", owners)


@query(stated("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' || id ELSE display_name END AS display_name, CASE WHEN id % 6 = 0 THEN NULL ELSE bio END AS bio FROM accounts WHERE id % 3 <> 1 OR bio <> 'BUILDING'", "accounts").replace("CASE WHEN id % 6 = 0 THEN NULL ELSE bio END", "CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 0 THEN 'given' ELSE bio END"))
def updated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows changed by a table of new values (null is a value too), and rows left out."""
    rows = b.accounts(spark, sf_dir).select("id", "display_name", "bio")
    new = rows.where("id % 3 = 0").select("id", F.concat(F.lit("new"), "id").alias("display_name"), F.when(F.col("id") % 6 != 0, "given").alias("bio"))
    return sinks.changed(sinks.without(rows, (F.col("id") % 3 == 1) & (F.col("bio") == "BUILDING")), new)


@query("SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, CASE WHEN event_id % 9 > 0 THEN event_type END AS event_type, min(event_id) OVER (PARTITION BY user_id, CASE WHEN event_id % 9 > 0 THEN event_type END) AS least FROM events) WHERE event_id = least OR event_type IS NULL")
def first_of_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 9 > 0, F.col("event_type")).alias("event_type"))
    return sinks.first_of(rows, ["user_id", "event_type"], "event_id")


# ---------------------------------------------------------------- merges and segments by the reference's rules


@query("SELECT event_id, '{\"a\": [' || (event_id % 3) || ', 7], \"b\": \"\", \"c\": ' || event_id || ', \"d\": []' || CASE WHEN event_id % 2 = 0 THEN ', \"e\": ' || event_id ELSE '' END || '}' AS merged FROM events")
def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists keep each element where it comes first, and what only one object has stays, empty or not."""
    n = F.col("event_id")
    first = F.concat(F.lit('{"a": ['), n % 3, F.lit(', 7], "c": null, "d": []}'))
    second = F.concat(F.lit('{"a": [7, '), n % 3, F.lit('], "b": "", "c": '), n, F.when(n % 2 == 0, F.concat(F.lit(', "e": '), n)).otherwise(""), F.lit("}"))
    return b.table(spark, sf_dir, "events").select("event_id", reconcile.merged_json(first, second).alias("merged"))


@query(
    """WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 0 ELSE (l_linenumber - 1) * 25 END AS a, CASE WHEN l_linenumber = 1 THEN l_quantity::INT ELSE (l_linenumber - 1) * 25 + l_quantity::INT END AS z FROM lineitem),
    g AS (SELECT *, coalesce(max(z) OVER (PARTITION BY l_orderkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
    h AS (SELECT *, sum((a > before)::INT) OVER (PARTITION BY l_orderkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gaps FROM g)
    SELECT l_orderkey, coalesce(max(z) FILTER (WHERE gaps = 0), 0)::BIGINT AS covered, count(*) FILTER (WHERE gaps = 0) AS segments_used FROM h GROUP BY l_orderkey"""
)
def coverage_without_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines have no range, so they lie at byte 0 and end where their data ends."""
    known = F.col("l_linenumber") > 1
    start, size = (F.col("l_linenumber") - 1) * 25, F.rint("l_quantity").cast("int")
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(known, start).alias("a"), F.when(known, start + size - 1).alias("z"), size.alias("size"))
    return media.coverage(rows, ["l_orderkey"], "a", "z", "size")


# ---------------------------------------------------------------- values of old observations, addresses under an alias

SEEN = "SELECT event_id AS ord, ts AS seen_at, user_id AS canonical_id, 'p' || user_id AS id_on_platform, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type || '/' END AS url_suffix, CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS bio FROM events"
NAMED = "SELECT name, arg_max(bio, (seen_at, ord)) AS bio FROM (SELECT 'id_' || id_on_platform AS name, bio, seen_at, ord FROM seen UNION ALL SELECT 'url_' || rtrim(url_suffix, '/'), bio, seen_at, ord FROM seen WHERE trim(url_suffix) <> '') WHERE trim(bio) <> '' GROUP BY name"


def seen_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of accounts with both identifiers; addresses end in a slash, every seventh is blank."""
    return b.observations(spark, sf_dir).select("ord", "seen_at", "canonical_id", F.concat(F.lit("p"), "canonical_id").alias("id_on_platform"), F.when(F.col("ord") % 7 == 0, " ").otherwise(F.concat("session", F.lit("/"))).alias("url_suffix"), F.col("note").alias("bio"))


@query(stated("SELECT * FROM named", seen=SEEN, named=NAMED))
def biographies_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.values_by_name(seen_accounts(spark, sf_dir), "bio", ["seen_at", "ord"])


@query(
    stated(
        "SELECT ord, CASE WHEN trim(s.bio) <> '' THEN s.bio ELSE coalesce(i.bio, u.bio) END AS bio FROM (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN '' ELSE bio END AS bio, CASE WHEN ord % 2 = 0 THEN id_on_platform END AS id_on_platform) FROM seen) s"
        " LEFT JOIN named i ON i.name = 'id_' || s.id_on_platform LEFT JOIN named u ON u.name = 'url_' || rtrim(s.url_suffix, '/')",
        seen=SEEN, named=NAMED,
    )
)
def biographies_of_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that lost their biography, half of them their platform's id too, get it back by what they are still known by."""
    seen = seen_accounts(spark, sf_dir)
    lost = seen.withColumns({"bio": F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("bio")), "id_on_platform": F.when(F.col("ord") % 2 == 0, F.col("id_on_platform"))})
    return inc.with_named_values(lost, inc.values_by_name(seen, "bio", ["seen_at", "ord"]), "bio").select("ord", "bio")


@query(
    stated(
        "SELECT a.id, CASE WHEN a.id % 2 = 1 AND trim(a.bio) <> '' THEN a.bio ELSE l.bio END AS bio FROM accounts a LEFT JOIN (SELECT canonical_id, arg_max(bio, (seen_at, ord)) AS bio FROM seen WHERE trim(bio) <> '' GROUP BY canonical_id) l ON l.canonical_id = a.id",
        "accounts", seen=SEEN,
    )
)
def biographies_of_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = b.accounts(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 1, F.col("bio")).alias("bio"))
    return inc.with_latest_observed(accounts, seen_accounts(spark, sf_dir), "bio", ["seen_at", "ord"])


@query(stated("SELECT media_key, CASE WHEN local_url IS NOT NULL THEN 'archives/s' || post_id % 10 || '/' || local_url END AS local_url FROM media", "media"))
def addresses_under_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = b.media(spark, sf_dir).withColumn("archive_location", F.concat(F.lit("/srv/archives/s"), F.col("post_id") % 10, F.lit("/")))
    return inc.aliased(placed, "/srv/archives", "archives").select("media_key", "local_url")
