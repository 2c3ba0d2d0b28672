"""Tag filters over a hierarchy and several scopes, usage counts and imports."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.predicates import like_literal
from strataloom.operators.hierarchy import closure, descendants
from strataloom.operators.incorporate import numbered
from strataloom.operators.lineage import checkpointed


@dataclass(frozen=True)
class Tagged:
    """The association tables (entity key, tag_id) and the entities that lead from one to another: posts (id, account_id), media (media_key, post_id, account_id), media_parts (part_id, media_key). cyclic: whether edges may have cycles, which guarded edges (hierarchy.add_edge) have not."""

    edges: DataFrame
    account_tags: DataFrame
    post_tags: DataFrame
    media_tags: DataFrame
    posts: DataFrame
    media: DataFrame
    part_tags: DataFrame | None = None
    media_parts: DataFrame | None = None
    cyclic: bool = False


def from_media(t: Tagged) -> DataFrame:
    return t.media_tags


def from_parts(t: Tagged) -> DataFrame:
    """Tags of parts as tags of the media they are part of."""
    if t.part_tags is None or t.media_parts is None:
        return t.media_tags.limit(0)
    return t.part_tags.join(t.media_parts, "part_id").select("media_key", "tag_id")


def via_media(t: Tagged, tags: DataFrame, key: str) -> DataFrame:
    return t.media.select("media_key", key).join(tags, "media_key").select(F.col(key).alias("matched_id"), "tag_id")


#: (entity, scope) -> rows (matched_id, tag_id): the tags that an entity has through a scope.
BRANCHES: dict[tuple[str, str], Callable[[Tagged], DataFrame]] = {
    ("media", "media"): lambda t: t.media_tags.select(F.col("media_key").alias("matched_id"), "tag_id"),
    ("media", "post"): lambda t: t.media.join(t.post_tags, "post_id").select(F.col("media_key").alias("matched_id"), "tag_id"),
    ("media", "account"): lambda t: t.media.join(t.account_tags, "account_id").select(F.col("media_key").alias("matched_id"), "tag_id"),
    ("media", "media_part"): lambda t: from_parts(t).select(F.col("media_key").alias("matched_id"), "tag_id"),
    ("post", "post"): lambda t: t.post_tags.select(F.col("post_id").alias("matched_id"), "tag_id"),
    ("post", "media"): lambda t: via_media(t, from_media(t), "post_id"),
    ("post", "account"): lambda t: t.posts.join(t.account_tags, "account_id").select(F.col("id").alias("matched_id"), "tag_id"),
    ("post", "media_part"): lambda t: via_media(t, from_parts(t), "post_id"),
    ("account", "account"): lambda t: t.account_tags.select(F.col("account_id").alias("matched_id"), "tag_id"),
    ("account", "post"): lambda t: t.posts.join(t.post_tags, t.posts["id"] == t.post_tags["post_id"]).select(F.col("account_id").alias("matched_id"), "tag_id"),
    ("account", "media"): lambda t: via_media(t, from_media(t), "account_id"),
    ("account", "media_part"): lambda t: via_media(t, from_parts(t), "account_id"),
}


def scopes_of(entity: str, asked: list[str] | None) -> list[str]:
    """The scopes that exist for the entity, among those asked for; its own where none is."""
    allowed = [s for e, s in BRANCHES if e == entity]
    return [s for s in allowed if s in set(asked or [])] or [entity]


def tag_filter(t: Tagged, entity: str, tag_ids: list[int], mode: str = "any", scopes: list[str] | None = None) -> DataFrame:
    """(matched_id) of the entities that have the tags or descendants of them, through any of the scopes: at least one tag ('any'), or each of them ('all'; an id given twice counts once).

    The few wanted tags are joined first, so that each branch reduces its association table before it is
    joined to the entities.
    """
    spark = t.edges.sparkSession
    wanted = sorted(set(tag_ids))
    seeds = spark.createDataFrame([(i,) for i in wanted], "id long")
    # worked out once for all scopes
    below = checkpointed((closure if t.cyclic else descendants)(t.edges, seeds).select("root_id", F.col("id").alias("tag_id")))
    found = reduce(DataFrame.unionByName, (BRANCHES[entity, s](t).join(below, "tag_id").select("matched_id", "root_id") for s in scopes_of(entity, scopes)))
    found = found.where("matched_id IS NOT NULL")
    if mode != "all" or len(wanted) == 1:
        return found.select("matched_id").distinct()
    return found.groupBy("matched_id").agg(F.count_distinct("root_id").alias("n")).where(F.col("n") == len(wanted)).select("matched_id")


def usage_counts(t: Tagged, tag_id: int) -> DataFrame:
    """How many accounts, posts, media and parts have the tag or a descendant."""
    spark = t.edges.sparkSession
    below = descendants(t.edges, spark.createDataFrame([(tag_id,)], "id long")).select(F.col("id").alias("tag_id"))
    sides = [(t.account_tags, "account_id", "account"), (t.post_tags, "post_id", "post"), (t.media_tags, "media_key", "media")]
    if t.part_tags is not None:
        sides.append((t.part_tags, "part_id", "media_part"))
    # each table is reduced to its distinct entities by itself
    counts = [rows.join(F.broadcast(below), "tag_id", "left_semi").select(key).distinct().agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for rows, key, kind in sides]
    both = reduce(DataFrame.unionByName, counts)
    return both.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}_count") for k in ("account", "post", "media", "media_part")))


def with_parents(tags: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """tags (id, name, tag_type) with the sorted names of their direct parents, none for a root. known: all tags, where tags are some of them."""
    named = edges.join((tags if known is None else known).select(F.col("id").alias("super"), F.col("name").alias("parent")), "super")
    parents = named.groupBy(F.col("sub").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return tags.join(parents, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def relatives(tags: DataFrame, edges: DataFrame, tag_id: int) -> DataFrame:
    """(relation, id, name) of a tag's parents and children."""
    up = edges.where(F.col("sub") == tag_id).select(F.lit("parent").alias("relation"), F.col("super").alias("id"))
    down = edges.where(F.col("super") == tag_id).select(F.lit("child").alias("relation"), F.col("sub").alias("id"))
    return up.union(down).join(tags.select("id", "name"), "id").select("relation", "id", "name")


def counts_by_type(tags: DataFrame) -> DataFrame:
    return tags.groupBy(F.coalesce("tag_type", F.lit("null")).alias("tag_type")).agg(F.count("*").alias("n"))


def inner_edges(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between tags of one type."""
    up = tags.select(F.col("id").alias("super"), F.col("tag_type").alias("super_type"))
    down = tags.select(F.col("id").alias("sub"), F.col("tag_type").alias("sub_type"))
    return edges.join(up, "super").join(down, "sub").where("super_type = sub_type").select("super", "sub", F.col("super_type").alias("tag_type"))


def hydrated(associations: DataFrame, key: str, tags: DataFrame) -> DataFrame:
    """(key, tags): each entity's tags as a sorted list of structs."""
    named = associations.join(tags.select(F.col("id").alias("tag_id"), "name", "tag_type"), "tag_id")
    return named.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("tag_id", "name", "tag_type"))).alias("tags"))


def fits(tags: DataFrame, affinity: str, entity: str) -> DataFrame:
    """tags with `allowed`: whether their type's list of entities (JSON text in `affinity`) names the entity or is missing."""
    listed = F.from_json(F.col(affinity), "array<string>")
    return tags.withColumn("allowed", listed.isNull() | F.array_contains(listed, entity))


def name_key(name) -> F.Column:
    return F.lower(F.trim(name))


def annotation_import(rows: DataFrame, accounts: DataFrame, tags: DataFrame, existing: DataFrame) -> DataFrame:
    """rows (entity, tag, tag_type) with status and message: added, exists or error.

    An entity is an account's id or address. A tag is looked up by its name without regard to case and outer
    blanks, within the type where one is given; two matches are an error. existing (account_id, tag_id).
    """
    own = rows.withColumn("asked", name_key(F.col("tag"))).withColumn("kind", F.nullif(name_key(F.col("tag_type")), F.lit("")))
    known = tags.select(F.col("id").alias("tag_id"), name_key(F.col("name")).alias("asked"), name_key(F.col("tag_type")).alias("known_kind"))
    wanted = own.select("asked", "kind").distinct().join(known, "asked").where("kind IS NULL OR kind = known_kind")
    # keyed by what is asked for, so that a stage that runs again pairs the same rows
    matched = wanted.groupBy(F.struct("asked", "kind").alias("wish")).agg(F.count("*").alias("n_tags"), F.min("tag_id").alias("tag_id"))
    by_id = accounts.select(F.col("id").cast("string").alias("entity"), F.col("id").alias("by_id"))
    by_suffix = accounts.groupBy(F.col("url_suffix").alias("entity")).agg(F.max("id").alias("by_suffix"))
    found = own.withColumn("wish", F.struct("asked", "kind")).join(matched, "wish", "left").join(by_id, "entity", "left").join(by_suffix, "entity", "left").withColumn("account_id", F.coalesce("by_id", "by_suffix"))
    there = existing.select("account_id", "tag_id").distinct().withColumn("there", F.lit(True))
    message = (
        F.when(F.col("account_id").isNull(), "entity not found")
        .when(F.col("n_tags").isNull(), "tag not found")
        .when(F.col("n_tags") > 1, "tag is ambiguous")
    )
    out = found.join(there, ["account_id", "tag_id"], "left").withColumn("message", message)
    status = F.when(F.col("message").isNotNull(), "error").when(F.col("there"), "exists").otherwise("added")
    return out.select("entity", "tag", "tag_type", "account_id", F.when(F.col("n_tags") == 1, F.col("tag_id")).alias("tag_id"), status.alias("status"), "message")


@dataclass(frozen=True)
class Annotatable:
    """A kind of entity that an import may annotate: its ids (id) and, where it is also known by an address, ids with addresses (id, url_suffix); existing (entity_id, tag_id), its annotations."""

    ids: DataFrame
    existing: DataFrame
    addressed: bool = False


def annotations_import(rows: DataFrame, entities: Mapping[str, Annotatable], tags: DataFrame) -> DataFrame:
    """rows (row, entity_type, entity, tag, tag_type, notes) for any kinds of entity with entity_id, tag_id, status (added, exists or error) and errors, all that a row has.

    Kinds without regard to case and outer blanks. Digits are an id; for kinds with addresses anything else is an address, which may
    start with @ (of several the largest id). Tags as in annotation_import. Of rows that ask for the same the first is added, the
    others exist. All kinds go through the same joins, a row each, whatever their number.
    """
    kind = name_key(F.coalesce("entity_type", F.lit("")))
    asked = F.trim(F.coalesce("entity", F.lit("")))
    addressed = kind.isin(*(k for k, e in entities.items() if e.addressed))
    asked = F.when(addressed, F.regexp_replace(asked, "^@+", "")).otherwise(asked)
    numeric = F.when(addressed, asked.rlike("^[0-9]+$")).otherwise(asked.rlike("^-*[0-9]+$"))
    own = rows.select(
        "*", kind.alias("_kind"), F.when(numeric, F.concat(F.lit("id "), F.coalesce(asked.try_cast("long").cast("string"), asked))).when(addressed, F.concat(F.lit("at "), asked)).alias("_entity"),
        name_key(F.coalesce("tag", F.lit(""))).alias("_name"), F.nullif(name_key(F.coalesce("tag_type", F.lit(""))), F.lit("")).alias("_type"),
    )
    known = tags.select(F.col("id").alias("_tag"), name_key(F.col("name")).alias("_name"), name_key(F.col("tag_type")).alias("_known_type"))
    wanted = own.select("_name", "_type").distinct().join(known, "_name").where("_type IS NULL OR _type = _known_type")
    wishes = wanted.groupBy(F.struct("_name", "_type").alias("_wish")).agg(F.count("*").alias("_tags"), F.min("_tag").alias("tag_id"))
    places = []
    for name, e in entities.items():
        places.append(e.ids.select(F.lit(name).alias("_kind"), F.concat(F.lit("id "), "id").alias("_entity"), F.col("id").alias("entity_id")))
        if e.addressed:
            places.append(e.ids.where("url_suffix IS NOT NULL").groupBy(F.lit(name).alias("_kind"), F.concat(F.lit("at "), "url_suffix").alias("_entity")).agg(F.max("id").alias("entity_id")))
    there = reduce(DataFrame.union, (e.existing.select(F.lit(name).alias("_kind"), "entity_id", "tag_id") for name, e in entities.items())).distinct().withColumn("_there", F.lit(True))
    named = own.withColumn("_wish", F.struct("_name", "_type")).join(wishes, "_wish", "left").join(reduce(DataFrame.union, places), ["_kind", "_entity"], "left")
    valid = F.col("_kind").isin(*entities)
    errors = F.array_compact(
        F.array(
            F.when(~valid, "unknown entity type").when(F.col("_entity").isNull(), "an id is required").when(F.col("entity_id").isNull(), "entity not found"),
            F.when(F.col("_name") == "", "tag is required").when(F.col("_tags").isNull(), "tag not found").when(F.col("_tags") > 1, "tag is ambiguous"),
        )
    )
    judged = named.withColumn("errors", errors).withColumn("tag_id", F.when(F.col("_tags") == 1, F.col("tag_id"))).join(there, ["_kind", "entity_id", "tag_id"], "left")
    good = judged.where(F.size("errors") == 0).groupBy("_kind", "entity_id", "tag_id").agg(F.min("row").alias("_first"))
    told = judged.join(good, ["_kind", "entity_id", "tag_id"], "left")
    status = F.when(F.size("errors") > 0, "error").when(F.col("_there") | (F.col("_first") < F.col("row")), "exists").otherwise("added")
    return told.select("row", F.col("_kind").alias("entity_type"), "entity", "entity_id", "tag_id", F.nullif("notes", F.lit("")).alias("notes"), status.alias("status"), "errors")


def annotated(existing: DataFrame, status: DataFrame) -> DataFrame:
    """existing (account_id, tag_id) and what an import's rows with status added ask for, once each."""
    return existing.unionByName(status.where("status = 'added'").select("account_id", "tag_id").distinct())


def listed(tags: DataFrame, edges: DataFrame, tag_type: str | None = None, text: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """A page of tags by name with their parents, of one type and with names that hold a text where these are given."""
    some = tags if tag_type is None else tags.where(F.col("tag_type") == tag_type)
    some = some if not text else some.where(like_literal(F.col("name"), text))
    return with_parents(some.orderBy("name", "id").offset((number - 1) * size).limit(size), edges, tags)


@dataclass(frozen=True)
class QuickAccess:
    """tags: those offered by themselves; dropdowns (tag_type, tags): those offered under their type; edges (super, sub, tag_type): the hierarchy within these types."""

    tags: DataFrame
    dropdowns: DataFrame
    edges: DataFrame


def quick_access(tags: DataFrame, types: DataFrame, edges: DataFrame, entity: str | None = None) -> QuickAccess:
    """tags (id, name, tag_type, quick_access, omitted) and types (name, quick_access, affinity: JSON list or null) for one kind of entity, or any."""
    sides = types.select(F.col("name").alias("tag_type"), F.col("quick_access").alias("_quick_type"), "affinity")
    known = tags.join(sides, "tag_type", "left")
    allowed = known if entity is None else known.where(fits_affinity(F.col("affinity"), entity))
    offered = allowed.where("_quick_type AND NOT omitted")
    lists = offered.groupBy("tag_type").agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("tags"))
    ends = offered.select("id", "tag_type")
    inner = edges.join(ends.select(F.col("id").alias("super"), F.col("tag_type")), "super").join(ends.select(F.col("id").alias("sub"), F.col("tag_type").alias("_t")), "sub").where("tag_type = _t")
    return QuickAccess(allowed.where("quick_access").select("id", "name", "tag_type"), lists, inner.select("super", "sub", "tag_type"))


def fits_affinity(affinity: F.Column, entity: str) -> F.Column:
    held = F.from_json(affinity, "array<string>")
    return held.isNull() | F.array_contains(held, entity)


def dropdown(tags: DataFrame, edges: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    """A tag with its descendants (id, name, tag_type), and the edges among them."""
    seed = edges.sparkSession.createDataFrame([(tag_id,)], "id long")
    below = descendants(edges, seed).select("id")
    among = edges.join(below.withColumnRenamed("id", "super"), "super", "left_semi").join(below.withColumnRenamed("id", "sub"), "sub", "left_semi")
    return tags.join(below, "id", "left_semi"), among.select("super", "sub")


def tag_kernel(tags: DataFrame, edges: DataFrame, account_tags: DataFrame, tag_id: int) -> DataFrame:
    """(id, applied) of the accounts with a tag or one of its descendants: the names of those they have, sorted."""
    some, _ = dropdown(tags, edges, tag_id)
    held = account_tags.join(F.broadcast(some.select(F.col("id").alias("tag_id"), "name")), "tag_id")
    return held.groupBy(F.col("account_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("applied"))


def deletable(types: DataFrame, tags: DataFrame, used: DataFrame) -> DataFrame:
    """(kind, id, allowed, uses) for all types (name) and tags (id, tag_type): a type goes only without tags, a tag only where no association (tag_id) names it."""
    per_type = tags.groupBy(F.col("tag_type").alias("id")).agg(F.count("*").alias("uses"))
    per_tag = used.groupBy(F.col("tag_id").cast("string").alias("id")).agg(F.count("*").alias("uses"))
    both = types.select(F.lit("type").alias("kind"), F.col("name").alias("id")).join(per_type, "id", "left").unionByName(tags.select(F.lit("tag").alias("kind"), F.col("id").cast("string").alias("id")).join(per_tag, "id", "left"))
    return both.select("kind", "id", F.col("uses").isNull().alias("allowed"), F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))


#: Words of a yes-or-no column of an import, fixed values.
YES, NO = ("1", "true", "yes"), ("0", "false", "no")


def tag_rows(rows: DataFrame) -> DataFrame:
    """rows (row, name, tag_type, description, quick_access, parents: names between bars) with name trimmed, quick_access as a boolean, parents as an array, and errors."""
    name, quick = F.trim(F.coalesce("name", F.lit(""))), F.lower(F.trim(F.coalesce("quick_access", F.lit(""))))
    errors = F.array_compact(
        F.array(
            F.when(name == "", "name is required").when(name.contains(","), "name cannot contain commas"),
            F.when((quick != "") & ~quick.isin(*YES, *NO), "quick_access is neither yes nor no"),
        )
    )
    parents = F.filter(F.transform(F.split(F.coalesce("parents", F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return rows.select("row", name.alias("name"), F.nullif(F.trim("tag_type"), F.lit("")).alias("tag_type"), F.nullif(F.trim("description"), F.lit("")).alias("description"), quick.isin(*YES).alias("quick_access"), parents.alias("parents"), errors.alias("errors"))


@dataclass(frozen=True)
class Imported:
    """tags and edges after an import, the status of each row (row, name, tag_id, status, errors) and of each relation (row, parent, status)."""

    tags: DataFrame
    edges: DataFrame
    rows: DataFrame
    relations: DataFrame


def import_tags(parsed: DataFrame, tags: DataFrame, types: DataFrame, edges: DataFrame) -> Imported:
    """Take tag_rows' rows into tags (id, name, tag_type) and edges.

    Rows with errors or an unknown type are errors. A tag is known by its name, without regard to case and outer
    blanks, within its type (none is a type of its own); rows of one new tag make one tag. Parents are looked up
    among the import's names as written, else among all tags' names (the smallest id), and their edges added in
    row order, each against all before it: added, exists, cycle or parent_not_found. Edges are few and depend on
    one another, so they are taken one by one on the driver (an import file's edges); the rest is joins.
    """
    known_types = types.select(name_key(F.col("name")).alias("_k"), F.col("name").alias("_type")).dropDuplicates(["_k"])
    own = parsed.join(known_types, name_key(F.col("tag_type")) == F.col("_k"), "left").withColumn("errors", F.when(F.col("tag_type").isNotNull() & F.col("_type").isNull(), F.array_append("errors", "tag type not found")).otherwise(F.col("errors")))
    own = own.select("row", "name", F.col("_type").alias("tag_type"), "parents", "errors", F.struct(name_key(F.col("name")).alias("n"), F.coalesce("_type", F.lit("")).alias("t")).alias("key"))
    good = own.where(F.size("errors") == 0)
    there = tags.groupBy(F.struct(name_key(F.col("name")).alias("n"), F.coalesce("tag_type", F.lit("")).alias("t")).alias("key")).agg(F.min("id").alias("known"))
    fresh = good.join(there, "key", "left_anti").groupBy("key").agg(F.min("row").alias("first"), F.min_by("name", "row").alias("name"), F.first("tag_type").alias("tag_type"))
    top = tags.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    new = checkpointed(numbered(fresh, "first", top))
    ids = there.unionByName(new.select("key", F.col("canonical_id").alias("known")))
    placed = own.join(ids, "key", "left").join(new.select("key", "first"), "key", "left")
    status = F.when(F.size("errors") > 0, "error").when(F.col("first") == F.col("row"), "created").otherwise("existing")
    rows = checkpointed(placed.select("row", "name", F.when(F.size("errors") == 0, F.col("known")).alias("tag_id"), status.alias("status"), "errors", "parents"))
    all_tags = tags.unionByName(new.select(F.col("canonical_id").alias("id"), "name", "tag_type"), allowMissingColumns=True)
    asked = rows.where("status <> 'error'").select("row", F.col("tag_id").alias("sub"), F.posexplode("parents").alias("pos", "parent"))
    batch = rows.where("status <> 'error'").groupBy(F.col("name").alias("parent")).agg(F.max_by("tag_id", "row").alias("in_batch"))
    stored = all_tags.groupBy(name_key(F.col("name")).alias("_n")).agg(F.min("id").alias("in_store"))
    wished = asked.join(batch, "parent", "left").join(stored, name_key(F.col("parent")) == F.col("_n"), "left").select("row", "pos", "parent", "sub", F.coalesce("in_batch", "in_store").alias("super"))
    wished = checkpointed(wished)
    # only what lies below the tags that the import names can close a cycle with its edges
    named = wished.select(F.explode(F.array("super", "sub")).alias("id")).where("id IS NOT NULL").distinct()
    near = edges.join(descendants(edges, named).select(F.col("id").alias("super")).distinct(), "super", "left_semi")
    said, taken = [], set(map(tuple, near.select("super", "sub").collect()))
    below: dict[int, set[int]] = {}
    for up, down in taken:
        below.setdefault(up, set()).add(down)
    for r in wished.orderBy("row", "pos").collect():
        up, down = r["super"], r["sub"]
        if up is None:
            said.append((r["row"], r["parent"], "parent_not_found", None, None))
        elif (up, down) in taken:
            said.append((r["row"], r["parent"], "exists", None, None))
        elif reaches(below, down, up):
            said.append((r["row"], r["parent"], "cycle", None, None))
        else:
            taken.add((up, down))
            below.setdefault(up, set()).add(down)
            said.append((r["row"], r["parent"], "added", up, down))
    spark = tags.sparkSession
    told = spark.createDataFrame(said, "row long, parent string, status string, super long, sub long")
    return Imported(all_tags, edges.select("super", "sub").unionByName(told.where("status = 'added'").select("super", "sub")), rows.drop("parents"), told.select("row", "parent", "status"))


def reaches(below: dict[int, set[int]], start: int, goal: int) -> bool:
    """Whether goal is start or below it."""
    seen, front = set(), [start]
    while front:
        at = front.pop()
        if at == goal:
            return True
        if at not in seen:
            seen.add(at)
            front += below.get(at, ())
    return False
