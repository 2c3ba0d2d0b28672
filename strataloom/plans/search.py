"""Search and enrichment queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import fulltext
from strataloom.functions.normalize import full_url, parsed_url
from strataloom.functions.predicates import Searchable, like_literal, ordering, page, predicate
from strataloom.operators import enrich
from strataloom.operators.graph import newest_files
from strataloom.operators.lineage import shared_root
from strataloom.operators.wordindex import WordIndex
from strataloom.plans import bindings as b
from strataloom.plans.query import query, stated

ACCOUNTS = Searchable({"id": "number", "display_name": "text", "url_suffix": "text", "bio": "text", "balance": "number"})
POSTS = Searchable({"id": "number", "account_id": "number", "publication_date": "date", "caption": "text"})


@query(stated("SELECT * FROM accounts WHERE (balance > 1000 AND balance < 6000 AND NOT bio = 'BUILDING') OR contains(lower(display_name), 'r#00000001')", "accounts"))
def search_accounts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"or": [{"and": [{">": [1000, {"var": "balance"}, 6000]}, {"!=": [{"var": "bio"}, "BUILDING"]}]}, {"in": ["R#00000001", {"var": "display_name"}]}]}
    return b.accounts(spark, sf_dir).where(predicate(rule, ACCOUNTS))


@query(stated("SELECT * FROM posts WHERE publication_date >= DATE '1996-03-01' AND publication_date <= DATE '1996-09-30' AND caption <> '5-LOW' OR publication_date::DATE = DATE '1999-01-01'", "posts"))
def search_posts_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"or": [{"and": [{"<=": ["1996-03-01T00:00:00Z", {"var": "publication_date"}, "1996-09-30"]}, {"!=": [{"var": "caption"}, "5-LOW"]}]}, {"==": [{"var": "publication_date"}, "1999-01-01T12:00:00"]}]}
    return b.posts(spark, sf_dir).where(predicate(rule, POSTS))


@query(stated("SELECT id, display_name FROM accounts WHERE contains(lower(display_name), 'r#0000000')", "accounts"))
def search_like_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.accounts(spark, sf_dir).where(like_literal(F.col("display_name"), "R#0000000")).select("id", "display_name")


@query(stated("SELECT id, account_id, publication_date, caption FROM posts ORDER BY publication_date ASC, id DESC LIMIT 25 OFFSET 50", "posts"))
def search_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(b.posts(spark, sf_dir), ordering("publication_date", "asc", POSTS, "id", "id"), 3, 25)


def words() -> Column:
    return fulltext.tokens(F.col("text"))


WORDS = "SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS w FROM documents"


def word_index(spark: SparkSession, sf_dir: str) -> WordIndex:
    return b.word_index(spark, sf_dir, "documents", b.table(spark, sf_dir, "documents"), "doc_id", words())


def found(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return word_index(spark, sf_dir).matching(fulltext.boolean_query(text)).withColumnRenamed("id", "doc_id")


def found_sql(test: str, wanted: str) -> str:
    return stated(f"SELECT doc_id, len(list_filter(w, lambda x: x IN ({wanted})))::BIGINT AS relevance FROM words WHERE {test}", words=WORDS)


@query(found_sql("list_contains(w, 'license') AND list_contains(w, 'public')", "'license', 'public'"))
def search_fulltext_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "License public")


@query(found_sql("list_contains(w, 'the') AND NOT list_contains(w, 'with')", "'the'"))
def search_fulltext_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "+the -with")


@query(found_sql("len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0", "'licen'"))
def search_fulltext_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "licen*")


@query(found_sql("contains(' ' || array_to_string(w, ' ') || ' ', ' all rights reserved ')", "'all', 'rights', 'reserved'"))
def search_fulltext_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, '+"all rights reserved"')


def best_sql(words: str, k: int) -> str:
    return stated(
        f"""SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS place, doc_id, score FROM (SELECT doc_id, sum(tf * w)::BIGINT AS score FROM tf JOIN weight USING (word) GROUP BY doc_id)
        WHERE score > 0 QUALIFY place <= {k}""",
        words=WORDS,
        tf=f"SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM words) WHERE word IN ({words}) GROUP BY 1, 2",
        weight="SELECT word, floor(1000 * ln((2 * (SELECT count(*) FROM documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY word",
    )


@query(best_sql("'license', 'the', 'public', 'software'", 50))
def search_fulltext_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for four words, rare ones counting more."""
    return word_index(spark, sf_dir).best(["license", "the", "public", "software"], 50).withColumnRenamed("id", "doc_id")


@query(found_sql("(list_contains(w, 'license') OR len(list_filter(w, lambda x: starts_with(x, 'soft'))) > 0) AND NOT contains(' ' || array_to_string(w, ' ') || ' ', ' all rights ')", "'license', 'soft'"))
def search_fulltext_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two options, one of them a start of words, without a phrase."""
    return found(spark, sf_dir, 'license soft* -"all rights"')


@query("SELECT word, count(*) AS n_docs, sum(tf)::BIGINT AS n FROM (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS word FROM documents) GROUP BY 1, 2) GROUP BY word")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of an index that was filled in two batches: the second adds the documents that the first lacks, and one that it has is left out."""
    docs = b.table(spark, sf_dir, "documents")
    index = WordIndex(spark, f"{shared_root(spark)}/words-{uuid.uuid4().hex}")
    index.add(docs.where("doc_id % 3 > 0"), "doc_id", words(), 0).add(docs, "doc_id", words(), 1)
    rows = index.all_postings()
    return rows.groupBy(F.col("term").alias("word")).agg(F.sum("n").alias("n_docs"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))


@query(stated("SELECT id, 'https://www.instagram.com/' || url_suffix AS url FROM accounts", "accounts"))
def search_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts found by their addresses, as typed with and without scheme, query and closing slash."""
    rows = b.accounts(spark, sf_dir)
    typed = rows.select(F.concat(F.when(F.col("id") % 2 == 0, "https://www.instagram.com/").otherwise("instagram.com/"), "url_suffix", F.lit("/?hl=en")).alias("typed"))
    asked = typed.select(parsed_url(F.col("typed"))["suffix"].alias("url_suffix"))
    return rows.join(asked, "url_suffix", "left_semi").select("id", full_url(F.col("url_suffix"), F.lit("instagram")).alias("url"))


@query(
    stated(
        """SELECT account_id, media_key, rn, media_count FROM (SELECT account_id, media_key, row_number() OVER (PARTITION BY account_id ORDER BY publication_date DESC, media_key, size)::INT AS rn,
        count(*) OVER (PARTITION BY account_id) AS media_count FROM media WHERE local_url IS NOT NULL) WHERE rn <= 8""",
        "media",
    )
)
def thumbs_per_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_files(b.media(spark, sf_dir), "account_id", 8, [F.desc("publication_date"), F.col("media_key"), F.col("size")]).select("account_id", "media_key", "rn", "media_count")


@query(
    stated(
        """SELECT post_id, media_key, rn, media_count FROM (SELECT post_id, media_key, row_number() OVER (PARTITION BY post_id ORDER BY media_key, size)::INT AS rn,
        count(*) OVER (PARTITION BY post_id) AS media_count FROM media WHERE local_url IS NOT NULL) WHERE rn <= 4""",
        "media",
    )
)
def thumbs_per_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_files(b.media(spark, sf_dir), "post_id", 4, [F.col("media_key"), F.col("size")]).select("post_id", "media_key", "rn", "media_count")


@query(
    stated(
        """SELECT l.post_id, l.account_id, a.display_name AS account_display_name, p.publication_date, p.account_id AS author_id, w.display_name AS author_display_name
        FROM likes l LEFT JOIN posts p ON p.id = l.post_id LEFT JOIN accounts a ON a.id = l.account_id LEFT JOIN accounts w ON w.id = p.account_id""",
        "likes", "posts", "accounts",
    )
)
def enrich_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.with_post_and_author(b.likes(spark, sf_dir), b.posts(spark, sf_dir), b.accounts(spark, sf_dir))
    return rows.select("post_id", "account_id", "account_display_name", "publication_date", "author_id", "author_display_name")


@query(
    stated(
        """SELECT follower_id, other_id, kind, a.display_name AS follower_display_name, a.url_suffix AS follower_url_suffix, o.display_name AS other_display_name, o.url_suffix AS other_url_suffix
        FROM relations LEFT JOIN accounts a ON a.id = follower_id LEFT JOIN accounts o ON o.id = other_id""",
        "relations", "accounts",
    )
)
def enrich_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.relations_with_ends(b.relations(spark, sf_dir), b.accounts(spark, sf_dir))


@query(
    stated(
        """SELECT a.id, coalesce(p.n, 0) AS posts, coalesce(g.n, 0) AS likes_given, coalesce(r.n, 0)::BIGINT AS likes_received, coalesce(e.n, 0) AS relations FROM accounts a
        LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM posts GROUP BY 1) p USING (id) LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM likes GROUP BY 1) g USING (id)
        LEFT JOIN (SELECT p.account_id AS id, count(*) AS n FROM likes l JOIN posts p ON p.id = l.post_id GROUP BY 1) r USING (id)
        LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT follower_id AS id FROM relations UNION ALL SELECT other_id FROM relations WHERE other_id <> follower_id) GROUP BY 1) e USING (id)""",
        "accounts", "posts", "likes", "relations",
    )
)
def aux_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.activity_counts(b.accounts(spark, sf_dir), b.relations(spark, sf_dir), b.likes(spark, sf_dir), b.posts(spark, sf_dir))


@query(stated("SELECT DISTINCT a.id AS account_id, session FROM accounts a JOIN observations o ON o.canonical_id = a.id", "accounts", "observations"))
def sessions_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.sessions_of(b.accounts(spark, sf_dir), b.observations(spark, sf_dir))


@query(stated("SELECT a.id, coalesce(p.n, 0) AS post_count, coalesce(f.n, 0) AS relations FROM accounts a LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM posts GROUP BY 1) p USING (id) LEFT JOIN (SELECT follower_id AS id, count(*) AS n FROM relations GROUP BY 1) f USING (id) WHERE coalesce(p.n, 0) > 0 AND coalesce(f.n, 0) > 10", "accounts", "posts", "relations"))
def display_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that have posts and over ten relations."""
    counts = [b.posts(spark, sf_dir).groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("post_count")), b.relations(spark, sf_dir).groupBy(F.col("follower_id").alias("id")).agg(F.count("*").alias("relations"))]
    rows = b.accounts(spark, sf_dir).select("id")
    for side in counts:
        rows = rows.join(side, "id", "left")
    return rows.na.fill(0).where("post_count > 0 AND relations > 10")


@query(
    stated(
        """SELECT a.id, count(DISTINCT p.id) AS n_posts, count(m.media_key) AS n_media, min(CASE WHEN p.r = 1 THEN p.id END) AS newest_post FROM accounts a
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY publication_date DESC, id) AS r FROM posts) p ON p.account_id = a.id LEFT JOIN media m ON m.post_id = p.id GROUP BY a.id HAVING count(p.id) > 0""",
        "accounts", "posts", "media",
    )
)
def nest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the trees account > posts > media."""
    trees = enrich.nested(b.accounts(spark, sf_dir), b.posts(spark, sf_dir), b.media(spark, sf_dir)).where("posts IS NOT NULL")
    n_media = F.aggregate("posts", F.lit(0).cast("long"), lambda a, p: a + F.size(p["media"]))
    return trees.select("id", F.size("posts").cast("long").alias("n_posts"), n_media.alias("n_media"), F.col("posts")[0]["id"].alias("newest_post"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(CASE WHEN role = 'user' THEN turn END, CASE WHEN prev = 'user' THEN turn - 1 ELSE turn END), turn) AS place FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)")
def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments: an answer replies to the user's turn before it."""
    turns = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    before = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("parent"))
    rows = turns.join(before, ["conv_id", "turn"], "left").withColumn("parent", F.when(F.col("role") != "user", F.col("parent")))
    return enrich.threads(rows, "conv_id", "turn", "parent", "turn").select("conv_id", "turn", "role", "place")


@query(
    stated(
        """SELECT 'account' AS kind, id::VARCHAR AS id FROM s UNION ALL SELECT 'post', id::VARCHAR FROM posts WHERE account_id IN (SELECT id FROM s)
        UNION ALL SELECT 'media', media_key FROM media WHERE account_id IN (SELECT id FROM s)""",
        "accounts", "posts", "media", s="SELECT id FROM accounts WHERE bio = 'MACHINERY'",
    )
)
def share_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = b.accounts(spark, sf_dir).where("bio = 'MACHINERY'").select("id")
    return enrich.shared_scope(shared, b.posts(spark, sf_dir), b.media(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS title FROM documents")
def shortened_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", enrich.shortened(F.col("text")).alias("title"))
