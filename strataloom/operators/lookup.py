"""Single entities, lists of them, and pages, by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.predicates import like_literal


def pruned(rows: DataFrame, data: Sequence[str], with_data: bool = False) -> DataFrame:
    """rows with the columns of raw data emptied unless asked for, so that the scan need not read them."""
    return rows if with_data else rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in data})


def one(rows: DataFrame, id_: int | None = None, id_on_platform: str | None = None, url_suffix: str | None = None) -> DataFrame:
    """The row with the id, else with the platform id, else with the address, whichever is given first; of several the smallest id. Without any key no row."""
    for name, value in (("id", id_), ("id_on_platform", id_on_platform), ("url_suffix", url_suffix)):
        if value is not None:
            return rows.where(F.col(name) == value).orderBy("id").limit(1)
    return rows.limit(0)


def many(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among ids (id); Spark broadcasts a short list by its size."""
    return rows.join(ids.select(F.col("id").alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_semi")


def exists(rows: DataFrame, id_: int, key: str = "id") -> bool:
    return not rows.where(F.col(key) == id_).limit(1).isEmpty()


def known(asked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """asked (id) with `found`: whether rows has it."""
    there = rows.select(F.col(key).alias("_id"), F.lit(True).alias("_there")).distinct()
    return asked.join(there, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_there", F.lit(False)).alias("found"))


def raw_data(asked: DataFrame, rows: DataFrame, data: str = "data") -> DataFrame:
    """asked (id) with found (whether rows has the id) and value (its data as a variant; null for text that is not JSON)."""
    side = rows.select(F.col("id").alias("_id"), F.col(data).alias("_data"))
    return asked.join(side, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("found"), F.try_parse_json("_data").alias("value"))


def keyset_page(rows: DataFrame, key: str, last: object, size: int) -> DataFrame:
    """The first `size` rows after `last` in the order of a unique key."""
    after = rows if last is None else rows.where(F.col(key) > F.lit(last))
    return after.orderBy(key).limit(size)


def suggestions(tags: DataFrame, text: str, entity: str | None = None, most: int = 10) -> DataFrame:
    """The first tags (id, name, affinity: JSON list or null) by name that hold the text, in any case, and may be put on the entity."""
    held = tags.where(like_literal(F.col("name"), text))
    return (held if entity is None else held.where(fits(F.col("affinity"), entity))).orderBy("name", "id").limit(most)


def fits(affinity: Column, entity: str) -> Column:
    """Whether a JSON list names the entity; a missing list names all."""
    listed = F.from_json(affinity, "array<string>")
    return listed.isNull() | F.array_contains(listed, entity)


def tag_types(types: DataFrame) -> DataFrame:
    """types (id, name, affinity, ...) by name, with their list of entities as an array."""
    return types.withColumn("affinity", F.from_json("affinity", "array<string>")).orderBy("name", "id")


def parts_of(parts: DataFrame, media: DataFrame) -> DataFrame:
    """The parts (part_id, media_key) of the media (media_key)."""
    return parts.join(media.select("media_key").distinct(), "media_key", "left_semi")


def latest_link(links: DataFrame, entity: str, id_: int) -> DataFrame:
    """The newest share link (id, entity, entity_id, created_at) of an entity; of equal times the largest id."""
    return links.where((F.col("entity") == entity) & (F.col("entity_id") == id_)).orderBy(F.desc("created_at"), F.desc("id")).limit(1)
