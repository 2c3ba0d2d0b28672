"""Which rows are the same entity: transitive clusters over several keys, and lookups by either of two keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.lineage import checkpointed, staged
from strataloom.operators.skew import join_values

#: Rounds after which a search for clusters is given up with an error; each at least halves the longest path.
ROUNDS = 60


def components(links: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that can be reached.

    Alternating large-star and small-star contraction; each round is two map-side combined minima and joins. A
    hub that very many links share meets them without a shuffle (join_values). cut: how the lineage is cut.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    for _ in range(ROUNDS):
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            return edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component"))
        seen, total = mark, 2 * mark["n"]
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("size")).select("hi", F.least("hi", "m").alias("m"), "size")
        large = join_values(both, least, "hi", "size", total).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("size"))
        small = join_values(large, down, "hi", "size", total).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(small.union(down.select("hi", F.col("m").alias("lo"))).distinct())
    raise RuntimeError("the search for components did not settle")


def linked(rows: DataFrame, order: str, keys: list[Column]) -> DataFrame | None:
    """(id, component): for each row's `order` that is not the smallest among the rows that share a value of the same key with it, directly or through others, that smallest; None where no rows share any. Null keys match nothing.

    A value's rows are linked to its first row only, so a value that most rows share costs one link a row. Values of one row link nothing and go no further than their count. rows are read several times.
    """
    slots = reduce(DataFrame.unionByName, (rows.select(F.col(order).alias("b"), F.struct(F.lit(k).alias("slot"), c.cast("string").alias("value")).alias("key")) for k, c in enumerate(keys)))
    slots = slots.where("key.value IS NOT NULL")
    first = staged(slots.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("size")).where("size > 1"))
    if first.isEmpty():
        return None
    return components(join_values(slots, first, "key", "size", slots.count()).select("a", "b"), staged)


def clusters(rows: DataFrame, order: str, keys: list[Column]) -> DataFrame:
    """rows with `cluster`: rows that share a value of the same key, directly or through others, get the smallest `order` among them. Null keys match nothing; see linked."""
    found = linked(rows, order, keys)
    if found is None:
        return rows.withColumn("cluster", F.col(order))
    return rows.join(found, rows[order] == found["id"], "left").withColumn("cluster", F.coalesce("component", order)).drop("id", "component")


def dual_key_lookup(rows: DataFrame, known: DataFrame, suffix: str = "url_suffix", platform_id: str = "id_on_platform") -> DataFrame:
    """rows with `canonical_id`: that of the known row (id, suffix, platform id) with their suffix, else of the one with their platform id; of several the largest id."""
    by_suffix = known.where(F.col(suffix).isNotNull()).groupBy(suffix).agg(F.max("id").alias("by_suffix"))
    by_id = known.where(F.col(platform_id).isNotNull()).groupBy(platform_id).agg(F.max("id").alias("by_id"))
    out = rows.join(by_suffix, suffix, "left").join(by_id, platform_id, "left")
    return out.withColumn("canonical_id", F.coalesce("by_suffix", "by_id")).drop("by_suffix", "by_id").select(*rows.columns, "canonical_id")
