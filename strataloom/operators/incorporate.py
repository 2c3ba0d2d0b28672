"""Provenance upsert: entities seen in a session join the canonical table and its history of observations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from strataloom.operators.lineage import staged
from strataloom.operators.maintenance import thumbnail_status
from strataloom.operators.reconcile import full, preferred
from strataloom.operators.resolve import clusters, dual_key_lookup


@dataclass(frozen=True)
class Reference:
    """A value that names another entity: its column, the columns that hold the other's platform id and address, and what becomes of a row whose other is unknown: kept without it, dropped, or set aside."""

    column: str
    to: str
    id: str
    url: str | None = None
    missing: str = "keep"


@dataclass(frozen=True)
class Entity:
    """What the upsert knows of an entity type: its values, whether rows without a platform id are refused, and what it refers to (columns that are among the values)."""

    name: str
    values: tuple[str, ...]
    needs_platform_id: bool = False
    references: tuple[Reference, ...] = ()


@dataclass(frozen=True)
class Stored:
    """canonical (id, id_on_platform, url_suffix, identifiers, values), observed (canonical_id, session, values). Further columns of canonical are carried along, and are null for what is new."""

    canonical: DataFrame
    observed: DataFrame


#: The seven types in the order in which they refer to one another.
ENTITIES = {
    e.name: e
    for e in (
        Entity("accounts", ("display_name", "bio")),
        Entity("posts", ("publication_date", "caption", "account_id"), True, (Reference("account_id", "accounts", "account_id", "account_url_suffix", "set aside"),)),
        Entity("media", ("media_type", "local_url", "post_id"), False, (Reference("post_id", "posts", "post_id", None, "set aside"),)),
        Entity("comments", ("text", "publication_date", "parent_id", "post_id", "account_id"), False, (Reference("post_id", "posts", "post_id", "post_url_suffix", "drop"), Reference("account_id", "accounts", "account_id", "account_url_suffix"))),
        Entity("likes", ("post_id", "account_id"), True, (Reference("post_id", "posts", "post_id", "post_url_suffix", "drop"), Reference("account_id", "accounts", "account_id", "account_url_suffix"))),
        Entity("tagged_accounts", ("tagged_account_id", "post_id", "media_id", "x", "y"), True, (Reference("tagged_account_id", "accounts", "tagged_account_id", "tagged_url_suffix"), Reference("post_id", "posts", "post_id"), Reference("media_id", "media", "media_id"))),
        Entity("account_relations", ("kind", "follower_id", "followed_id"), True, (Reference("follower_id", "accounts", "follower_id", "follower_url_suffix", "set aside"), Reference("followed_id", "accounts", "followed_id", "followed_url_suffix", "set aside"))),
    )
}


def incorporate(stored: Stored, rows: DataFrame, session: str, entity: Entity) -> Stored:
    """stored with the rows (ord, id_on_platform, url_suffix, values) that one session saw; see incorporate_sessions."""
    return incorporate_sessions(stored, rows.withColumn("session", F.lit(session)), entity)


def incorporate_sessions(stored: Stored, rows: DataFrame, entity: Entity) -> Stored:
    """stored with the rows (session, ord, id_on_platform, url_suffix, values) of any number of sessions, taken together in the order of their names.

    Rows without any identifier are left out, and those without platform id where the type needs one. Rows that
    share an identifier are one entity. An entity is known by its address, else by its
    platform id; entities that turn out to be one canonical are merged. New canonicals get ids after the
    largest, in the order of session and ord, so a repeated run gives the same ids. Values: a session's earlier
    observation wins over the rows, the newest session's observation over older ones and the canonical. The
    platform id stays the first, the address becomes the newest, identifiers only grow.
    """
    known = rows.where("id_on_platform IS NOT NULL" if entity.needs_platform_id else "id_on_platform IS NOT NULL OR url_suffix IS NOT NULL")
    ranks = staged(known.select("session").distinct()).withColumn("rank", F.row_number().over(W.orderBy("session")))  # a row a session
    placed = known.join(ranks, "session").withColumn("seq", F.col("rank").cast("long") * (1 << 40) + F.col("ord"))
    fields, pair = stored.observed.schema, ["id_on_platform", "url_suffix"]
    # what each session saw under each pair of identifiers; entities are told by the pairs alone
    at = lambda v: F.max(F.when(full(F.col(v), rows.schema[v].dataType).isNotNull(), F.struct("seq", v))).alias(v)
    parts = staged(placed.groupBy(*pair, "session", "rank").agg(*map(at, entity.values), F.max("seq").alias("last"), F.min("seq").alias("seq")))
    pairs = staged(parts.groupBy(*pair).agg(F.max("last").alias("last"), F.min("seq").alias("seq")))
    clustered = clusters(pairs, "seq", [F.col("id_on_platform"), F.col("url_suffix")])
    newer = lambda c: F.max_by(c, F.when(full(F.col(c), T.StringType()).isNotNull(), F.col("last"))).alias(c)
    found = staged(dual_key_lookup(clustered.groupBy("cluster").agg(*map(newer, pair), F.min("seq").alias("seq")), stored.canonical).select("cluster", "seq", "canonical_id"))
    top = stored.canonical.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")).first()["top"]
    fresh = numbered(found.where("canonical_id IS NULL").select("cluster", "seq"), "seq", top)
    ids = found.where("canonical_id IS NOT NULL").select("cluster", "canonical_id").unionByName(fresh.select("cluster", "canonical_id"))
    own = staged(clustered.join(ids, "cluster").select(*(F.col(c).alias(f"_{c}") for c in pair), "canonical_id"))
    both = parts.join(own, F.col("id_on_platform").eqNullSafe(F.col("_id_on_platform")) & F.col("url_suffix").eqNullSafe(F.col("_url_suffix")))
    seen = both.groupBy("canonical_id", "session", "rank").agg(*map(newer, pair), *(F.max(v).alias(v) for v in entity.values))
    seen = seen.select("canonical_id", "session", "rank", *pair, *(F.col(f"{v}.{v}").alias(v) for v in entity.values))

    # observations: what a session saw of the canonical before wins
    mine = stored.observed.select("canonical_id", "session", *(F.col(v).alias(f"_{v}") for v in entity.values))
    now = staged(
        seen.join(mine, ["canonical_id", "session"], "left").select(
            "canonical_id", "session", "rank", "id_on_platform", "url_suffix", *(preferred(F.col(f"_{v}"), F.col(v), fields[v].dataType).alias(v) for v in entity.values)
        )
    )
    observed = stored.observed.join(now.select("canonical_id", "session"), ["canonical_id", "session"], "left_anti").unionByName(now.select(*stored.observed.columns))

    # canonicals: the newest observation wins
    newest = lambda v: F.max_by(v, F.when(full(F.col(v), fields[v].dataType).isNotNull(), F.col("rank"))).alias(f"_{v}")
    names = F.flatten(F.array_sort(F.collect_list(F.struct("rank", F.array_compact(F.array(F.concat(F.lit("id_"), "id_on_platform"), F.concat(F.lit("url_"), "url_suffix"))).alias("n"))))["n"])
    side = now.groupBy(F.col("canonical_id").alias("id")).agg(
        F.min_by("id_on_platform", F.when(F.col("id_on_platform").isNotNull(), F.col("rank"))).alias("_pid"),
        F.max_by("url_suffix", F.when(F.col("url_suffix").isNotNull(), F.col("rank"))).alias("_url"),
        names.alias("_names"),
        *(newest(v) for v in entity.values),
    )
    joined = stored.canonical.join(side, "id", "full_outer")
    none = F.array().cast("array<string>")
    canonical = joined.select(
        "id",
        F.coalesce("id_on_platform", "_pid").alias("id_on_platform"),
        F.coalesce("_url", "url_suffix").alias("url_suffix"),
        F.array_union(F.coalesce("identifiers", none), F.coalesce("_names", none)).alias("identifiers"),
        *(preferred(F.col(f"_{v}"), F.col(v), fields[v].dataType).alias(v) for v in entity.values),
        *(c for c in stored.canonical.columns if c not in ("id", "id_on_platform", "url_suffix", "identifiers", *entity.values)),
    )
    return Stored(canonical.select(*stored.canonical.columns), observed)


def with_thumbnails(media: DataFrame) -> DataFrame:
    """media with thumbnail_path and thumbnail_status, null where they had none."""
    return media.withColumns({c: F.lit(None).cast("string") for c in ("thumbnail_path", "thumbnail_status") if c not in media.columns})


def with_largest_files(before: DataFrame, after: Stored, sizes: DataFrame) -> Stored:
    """after, a media store, with each medium's largest file among all that its sessions saw; of equally large ones, and of files whose size is unknown, that of the newest session.

    sizes: (local_url, size). before: the canonicals (id, local_url, thumbnail_path, thumbnail_status) that after was made from. A medium whose file changes loses its thumbnail and
    gets the status that a new one with that file has; the others keep theirs.
    """
    seen = after.observed.where(full(F.col("local_url"), T.StringType()).isNotNull()).join(sizes.groupBy("local_url").agg(F.max("size").alias("size")), "local_url", "left")
    best = seen.groupBy(F.col("canonical_id").alias("id")).agg(F.max_by("local_url", F.struct(F.coalesce("size", F.lit(0)), F.col("session"))).alias("_file"))
    old = before.select("id", F.col("local_url").alias("_old"), F.col("thumbnail_path").alias("_path"), F.col("thumbnail_status").alias("_status"), F.lit(True).alias("_known"))
    rows = after.canonical.join(best, "id", "left").join(old, "id", "left").withColumn("local_url", F.coalesce("_file", "local_url"))
    same = F.coalesce(F.col("_known"), F.lit(False)) & F.col("_old").eqNullSafe(F.col("local_url"))
    status = F.when(same, F.col("_status")).otherwise(thumbnail_status(F.lit(None).cast("string"), F.col("local_url"), F.col("media_type")))
    made = rows.withColumns({"thumbnail_path": F.when(same, F.col("_path")), "thumbnail_status": status})
    return Stored(staged(made.select(*dict.fromkeys([*after.canonical.columns, "thumbnail_path", "thumbnail_status"]))), after.observed)


def referred(rows: DataFrame, reference: Reference, known: DataFrame) -> DataFrame:
    """rows in which the reference's column holds the canonical id of what it names, by address, else by platform id; null where that is unknown."""
    out = rows.withColumn("_pid", F.col(reference.id).cast("string")).withColumn("_url", F.regexp_replace(F.col(reference.url), "/+$", "") if reference.url else F.lit(None).cast("string"))
    bare = known.select("id", F.col("id_on_platform").alias("_pid"), F.regexp_replace("url_suffix", "/+$", "").alias("_url"))
    found = dual_key_lookup(out, bare, "_url", "_pid")
    return found.withColumn(reference.column, F.col("canonical_id")).drop("canonical_id", "_pid", "_url")


def incorporate_all(stored: Mapping[str, Stored], streams: Mapping[str, DataFrame], sizes: DataFrame | None = None) -> tuple[dict[str, Stored], DataFrame]:
    """All seven types of any number of sessions, each after those that it refers to, and the rows set aside (type, session, ord, reason).

    streams: by type, rows (session, ord, id_on_platform, url_suffix, values and the columns of references). Types
    without a stream stay as they are. Rows whose other is unknown are treated as their reference says. With the sizes of files (local_url, size)
    the largest file of a medium wins; see with_largest_files.
    """
    out, aside = dict(stored), []
    for name, entity in ENTITIES.items():
        if name not in streams or name not in stored:
            continue
        rows = streams[name]
        for reference in entity.references:
            rows = referred(rows, reference, out[reference.to].canonical)
            if reference.missing == "set aside":
                lost = rows.where(F.col(reference.column).isNull())
                aside.append(lost.select(F.lit(name).alias("type"), "session", "ord", F.lit(f"{reference.column} is unknown").alias("reason")))
            if reference.missing != "keep":
                rows = rows.where(F.col(reference.column).isNotNull())
        done = incorporate_sessions(stored[name], staged(rows) if entity.references else rows, entity)
        if name == "media" and sizes is not None:
            out[name] = with_largest_files(with_thumbnails(stored[name].canonical), done, sizes)
        else:
            out[name] = Stored(staged(done.canonical), done.observed)
    spark = next(iter(stored.values())).canonical.sparkSession
    nothing = spark.createDataFrame([], "type string, session string, ord long, reason string")
    return out, reduce(DataFrame.unionByName, aside, nothing)


def empty_store(spark: SparkSession, entity: Entity, types: Mapping[str, str]) -> Stored:
    """A store without rows; types: SQL types of the values, string where none is given."""
    values = ", ".join(f"{v} {types.get(v, 'string')}" for v in entity.values)
    return Stored(spark.createDataFrame([], f"id long, id_on_platform string, url_suffix string, identifiers array<string>, {values}"), spark.createDataFrame([], f"canonical_id long, session string, {values}"))


#: SQL types of the values that are no text.
VALUE_TYPES = {"publication_date": "timestamp", "x": "double", "y": "double"} | {r.column: "long" for e in ENTITIES.values() for r in e.references}


def numbered(rows: DataFrame, order: str, top: int) -> DataFrame:
    """rows with canonical_id = top + 1, top + 2, ... in ascending order of `order` (distinct).

    Rows are counted by range first, so that numbering is a window within each range and not one over all.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] if parts > 1 else []
    edges = F.array(*map(F.lit, sorted(set(cuts or [])))).cast(f"array<{rows.schema[order].dataType.simpleString()}>")
    dealt = rows.withColumn("_part", F.size(F.filter(edges, lambda c: c < F.col(order))))
    counts = dealt.groupBy("_part").count()  # a row a range
    bases = counts.withColumn("_base", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    place = F.row_number().over(W.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(bases), "_part").withColumn("canonical_id", (F.lit(top) + F.col("_base") + place).cast("long")).drop("_part", "_base")


def denormalised(media: DataFrame, posts: DataFrame) -> DataFrame:
    """media with date and account of their posts where they have one."""
    side = posts.select(F.col("id").alias("post_id"), F.col("publication_date").alias("_date"), F.col("account_id").alias("_account"))
    out = media.join(side, "post_id", "left")
    return out.withColumn("publication_date", F.coalesce("_date", "publication_date")).withColumn("account_id", F.coalesce("_account", "account_id")).drop("_date", "_account")


def post_counts(accounts: DataFrame, posts: DataFrame) -> DataFrame:
    counts = posts.groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("post_count"))
    return accounts.join(counts, "id", "left").withColumn("post_count", F.coalesce("post_count", F.lit(0)))


def without_references(shells: DataFrame, *references: DataFrame) -> DataFrame:
    """Rows (id) that none of the references (id) names."""
    out = shells
    for r in references:
        out = out.join(r.select("id").distinct(), "id", "left_anti")
    return out


def latest_filled(rows: DataFrame, key: str, value: str, at: list[str]) -> DataFrame:
    """(key, value): the value of the latest row of each key in which it is not empty."""
    kept = rows.where(full(F.col(value), rows.schema[value].dataType).isNotNull())
    return kept.groupBy(key).agg(F.max_by(value, F.struct(*at)).alias(value))


def values_by_name(rows: DataFrame, value: str, at: list[str]) -> DataFrame:
    """(name, value): for every identifier of rows (id_on_platform, url_suffix, ...) the latest value that is not empty. Names are id_... and url_..., as identifiers are; a blank identifier is none."""
    named = F.filter(F.array(*(F.when(F.trim(c) != "", F.concat(F.lit(prefix), F.regexp_replace(c, "/+$", ""))) for prefix, c in (("id_", "id_on_platform"), ("url_", "url_suffix")))), lambda n: n.isNotNull())
    return latest_filled(rows.select(F.explode(named).alias("name"), value, *at), "name", value, at)


def with_named_values(observed: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """observed (id_on_platform, url_suffix, ...) with empty values from values_by_name, by the platform's id and else by the address; what is filled stays."""
    side = lambda alias: values.select(F.col("name").alias(f"_{alias}"), F.col(value).alias(f"_{alias}_value"))
    by_id = F.concat(F.lit("id_"), F.regexp_replace("id_on_platform", "/+$", "")) == F.col("_id")
    by_url = F.concat(F.lit("url_"), F.regexp_replace("url_suffix", "/+$", "")) == F.col("_url")
    own = full(F.col(value), observed.schema[value].dataType)
    out = observed.join(side("id"), by_id, "left").join(side("url"), by_url, "left")
    return out.withColumn(value, F.coalesce(own, F.col("_id_value"), F.col("_url_value"))).select(*observed.columns)


def with_latest_observed(canonical: DataFrame, observed: DataFrame, value: str, at: list[str]) -> DataFrame:
    """canonical (id, ...) with empty values from the latest observation (canonical_id, ...) that has one; what is filled stays. at: the order of observations, distinct within an entity."""
    latest = latest_filled(observed.where("canonical_id IS NOT NULL"), "canonical_id", value, at).select(F.col("canonical_id").alias("_key"), F.col(value).alias("_latest"))
    own = full(F.col(value), canonical.schema[value].dataType)
    out = canonical.join(latest, F.col("id") == F.col("_key"), "left")
    return out.withColumn(value, F.coalesce(own, F.col("_latest"))).select(*canonical.columns)


def aliased(media: DataFrame, archives: str, alias: str, location: str = "archive_location") -> DataFrame:
    """media whose local_url, relative to its archive's folder, is written relative to the folder of all archives, under its alias; null addresses stay null, and rows without a location as they are.

    An archive outside the folder of all archives is an error.
    """
    root = archives.rstrip("/") + "/"
    whole = F.concat(F.regexp_replace(location, "/+$", ""), F.lit("/"), F.regexp_replace("local_url", "^(?:\\./)+", ""))
    below = F.when(F.startswith(whole, F.lit(root)), F.concat(F.lit(alias + "/"), F.substr(whole, F.lit(len(root) + 1)))).otherwise(F.raise_error(F.concat(F.lit("outside the archives: "), whole)))
    return media.withColumn("local_url", F.when(F.col("local_url").isNotNull() & F.col(location).isNotNull(), below).otherwise(F.col("local_url")))
