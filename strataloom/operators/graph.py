"""Scores of accounts by their ties to a kernel of accounts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataloom.functions.normalize import full_url

#: Tie weights; a suggested account counts nothing unless asked for.
WEIGHTS = {"follow": 1.0, "suggested": 0.0, "like": 1.0, "comment": 1.0, "tag": 1.0}
TOP = 50


#: The relation type that is a suggestion; every other type, and none, is a follow.
SUGGESTED = "suggested"


def ties(
    relations: DataFrame, likes: DataFrame, posts: DataFrame, comments: DataFrame | None = None, tagged: DataFrame | None = None, media: DataFrame | None = None, direct: DataFrame | None = None
) -> DataFrame:
    """Directed edges (src, dst, kind), without nulls and self ties; a tie may come more than once.

    relations (follower_id, other_id, kind) are suggestions or, whatever else their kind says, follows. likes and
    comments (post_id, account_id) lead from who made them to the owner of the post. tagged (tagged_account_id,
    post_id, media_key) lead from the owner of the post and of the media to who is tagged there; media
    (media_key, account_id). direct: edges that are known as such. Nothing is shuffled but for the owners.
    """
    kind = F.when(F.col("kind") == SUGGESTED, SUGGESTED).otherwise("follow")
    edges = relations.select(F.col("follower_id").alias("src"), F.col("other_id").alias("dst"), kind.alias("kind"))
    owner = posts.select(F.col("id").alias("post_id"), F.col("account_id").alias("owner"))
    to_owner = lambda rows, name: rows.select("post_id", F.col("account_id").alias("src")).join(owner, "post_id").select("src", F.col("owner").alias("dst"), F.lit(name).alias("kind"))
    edges = edges.unionByName(to_owner(likes, "like"))
    if comments is not None:
        edges = edges.unionByName(to_owner(comments, "comment"))
    if tagged is not None:
        there = F.col("tagged_account_id").alias("dst")
        edges = edges.unionByName(tagged.join(owner, "post_id").select(F.col("owner").alias("src"), there, F.lit("tag").alias("kind")))
        if media is not None:
            held = media.select("media_key", F.col("account_id").alias("src"))
            edges = edges.unionByName(tagged.join(held, "media_key").select("src", there, F.lit("tag").alias("kind")))
    if direct is not None:
        edges = edges.unionByName(direct.select("src", "dst", "kind"))
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def scores(edges: DataFrame, kernel: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """(candidate_id, score, kernel_connections) of every account tied to the kernel (id), whichever way the tie points.

    Of several ties between a pair the strongest counts. Accounts with a score of 0 are left out. Ties without
    weight are dropped before the shuffle.
    """
    weight = F.lit(None).cast("double")
    for kind, w in weights.items():
        weight = F.when(F.col("kind") == kind, F.lit(float(w))).otherwise(weight)
    heavy = edges.select("src", "dst", weight.alias("weight")).where("weight > 0")
    both = heavy.select(F.col("src").alias("kernel_id"), F.col("dst").alias("candidate_id"), "weight").union(heavy.select("dst", "src", "weight"))
    members = kernel.select(F.col("id").alias("kernel_id")).distinct()
    pairs = both.join(members, "kernel_id", "left_semi").groupBy("candidate_id", "kernel_id").agg(F.max("weight").alias("strength"))
    return pairs.groupBy("candidate_id").agg(F.sum("strength").alias("score"), F.count("*").alias("kernel_connections"))


def candidates(edges: DataFrame, kernel: DataFrame, excluded: DataFrame | None = None, weights: Mapping[str, float] = WEIGHTS, top: int | None = TOP) -> DataFrame:
    """The best-scored accounts outside the kernel and the excluded (id); ties in score go to the smaller id. An empty kernel has none."""
    out = kernel.select("id") if excluded is None else kernel.select("id").unionByName(excluded.select("id"))
    found = scores(edges, kernel, weights).join(out.distinct(), F.col("candidate_id") == F.col("id"), "left_anti")
    return found if top is None else found.orderBy(F.desc("score"), "candidate_id").limit(top)


def kernel_scores(edges: DataFrame, kernel: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Every member of the kernel with its score against the others, 0 without ties."""
    members = kernel.select(F.col("id").alias("candidate_id")).distinct()
    found = members.join(scores(edges, kernel, weights), "candidate_id", "left")
    return found.select("candidate_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("kernel_connections", F.lit(0)).cast("long").alias("kernel_connections"))


def follow_counts(relations: DataFrame) -> DataFrame:
    """(account_id, followers, following); suggestions are no follows."""
    real = relations.where(~F.col("kind").eqNullSafe("suggested"))
    out = real.select(F.col("follower_id").alias("account_id"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    into = real.select(F.col("other_id").alias("account_id"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    return out.union(into).where("account_id IS NOT NULL").groupBy("account_id").agg(F.sum("in").alias("followers"), F.sum("out").alias("following"))


def newest_files(media: DataFrame, key: str, limit: int, order: list) -> DataFrame:
    """The first rows of media with a local file in each group, with media_count: how many the group has in all."""
    held = media.where("local_url IS NOT NULL")
    counts = held.groupBy(key).agg(F.count("*").alias("media_count"))
    ranked = held.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rn") <= limit)
    return ranked.join(counts, key)


def related_tag_stats(edges: DataFrame, account_id: int, account_tags: DataFrame, tags: DataFrame, top: int | None = 20) -> DataFrame:
    """Tags of the accounts tied to one account, by how many of them have each."""
    near = edges.where(F.col("src") == account_id).select(F.col("dst").alias("account_id")).union(edges.where(F.col("dst") == account_id).select("src")).distinct()
    found = account_tags.join(near, "account_id").join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"), F.col("tag_type").alias("tag_type_name")), "tag_id")
    counted = found.groupBy("tag_id", "tag_name", "tag_type_name").agg(F.count_distinct("account_id").alias("count"))
    return counted if top is None else counted.orderBy(F.desc("count"), "tag_id").limit(top)


def verified(data: Column) -> Column:
    """The JSON text's is_verified where it is true or false; any other value, and text that is no JSON object, gives null."""
    v = F.try_parse_json(data)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.is_verified", "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$.is_verified", "boolean"))


def thumbnail(path: Column, local_url: Column) -> Column:
    """The thumbnail's path, or else the file's own."""
    return F.coalesce(F.nullif(path, F.lit("")), local_url)


def cards(ids: DataFrame, accounts: DataFrame, relations: DataFrame, media: DataFrame, order: list, thumbs: int = 8) -> DataFrame:
    """ids (id, ...; few enough to be broadcast) of known accounts with their own columns, is_verified, followers, following, thumbnails (of the first `thumbs` files in `order`) and media_count.

    accounts (id, display_name, url_suffix, bio, data, post_count). Every side is reduced to the ids before it is aggregated.
    """
    some = F.broadcast(ids.select(F.col("id").alias("_id")))
    own = accounts.join(some, F.col("id") == F.col("_id"), "left_semi").select("id", "display_name", "url_suffix", "bio", verified(F.col("data")).alias("is_verified"), F.coalesce("post_count", F.lit(0)).alias("post_count"))
    real = relations.where(~F.col("kind").eqNullSafe(SUGGESTED))
    near = real.select(F.explode(F.array(F.struct(F.col("follower_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("other_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    follows = near.join(some, F.col("id") == F.col("_id"), "left_semi").groupBy("id").agg(F.sum("i").alias("followers"), F.sum("o").alias("following"))
    files = newest_files(media.join(some, F.col("account_id") == F.col("_id"), "left_semi"), "account_id", thumbs, order)
    shown = files.groupBy(F.col("account_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", thumbnail(F.col("thumbnail_path"), F.col("local_url")).alias("src")))), lambda t: t["src"]).alias("thumbnails"), F.max("media_count").alias("media_count")
    )
    out = F.broadcast(ids).join(own, "id").join(follows, "id", "left").join(shown, "id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("followers", "following", "media_count", "post_count")}
    return out.withColumns(counts | {"thumbnails": F.coalesce("thumbnails", F.array().cast("array<string>"))})


def dismissed(tags: DataFrame) -> DataFrame:
    """(tag_id, id, url_suffix, display_name) of the accounts that tags (id, community_dismissals: JSON text) dismiss; text that is no JSON array, and items without an id, count nothing."""
    text = F.when(F.ltrim("community_dismissals").startswith("["), F.col("community_dismissals"))
    items = F.from_json(text, "array<struct<id: long, url_suffix: string, display_name: string>>")
    return tags.select(F.col("id").alias("tag_id"), F.explode(items).alias("d")).where("d.id IS NOT NULL").select("tag_id", "d.*")


def with_dismissals(tags: DataFrame, tag_id: int, accounts: DataFrame) -> DataFrame:
    """tags in which one tag's dismissals are replaced by accounts (id, url_suffix, display_name)."""
    text = accounts.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "url_suffix", "display_name"))))).first()[0]  # one tag's list
    return tags.withColumn("community_dismissals", F.when(F.col("id") == tag_id, F.lit(text)).otherwise(F.col("community_dismissals")))


def kernel_csv(accounts: DataFrame, applied: DataFrame) -> DataFrame:
    """(url, tags) of accounts (id, url_suffix) for export, their applied tags' names (account_id, name) joined by semicolons; write it with the csv source, which quotes what needs it."""
    names = applied.groupBy(F.col("account_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("tags"))
    return accounts.join(names, "id", "left").select(full_url(F.col("url_suffix"), F.lit("instagram")).alias("url"), F.coalesce("tags", F.lit("")).alias("tags"))
