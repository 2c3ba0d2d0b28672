"""Reachability in a graph of tags: descendants, cycle tests, guarded edges."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.lineage import staged

#: In graphs with more edges than LARGE, HUBS nodes are tried as hubs. PIECES: rounds after which what was found is put together.
LARGE, HUBS, PIECES = 10_000, 8, 16


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root_id, id): each seed (id) with everything below it, itself included, once even where paths meet again.

    edges (super, sub) must be free of cycles and at most 100 levels deep; see closure for any graph.
    """
    spark, name = edges.sparkSession, uuid.uuid4().hex
    kind = edges.schema["sub"].dataType.simpleString()
    edges.createOrReplaceTempView(f"edges_{name}")
    seeds.select(F.col("id").cast(kind).alias("id")).distinct().createOrReplaceTempView(f"seeds_{name}")
    found = spark.sql(f"""
        WITH RECURSIVE below(root_id, id) AS (
          SELECT id, id FROM seeds_{name}
          UNION ALL
          SELECT below.root_id, e.sub FROM below JOIN edges_{name} e ON e.super = below.id)
        SELECT DISTINCT root_id, id FROM below""")
    return found


def search(front: DataFrame, edges: DataFrame, *carried: str, where: str = "true") -> DataFrame:
    """front (root_id, id, carried) and all that its rows reach over edges (super, sub, and columns for `where`), once each. Columns that are carried are part of what a search is; edges may have them too. Each round joins only what the last one found."""
    keys = [c for c in carried if c in edges.columns]
    front = staged(front.select("root_id", "id", *carried))
    pieces = [front]
    ahead = edges.withColumnRenamed("super", "id")
    while True:
        step = front.join(ahead, ["id", *keys]).where(where).select("root_id", F.col("sub").alias("id"), *carried).distinct()
        for piece in pieces:
            step = step.join(piece, ["root_id", "id", *keys], "left_anti")
        front = staged(step)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, pieces)
        pieces.append(front)
        if len(pieces) > PIECES:
            pieces = [staged(reduce(DataFrame.unionByName, pieces))]


def around_hubs(edges: DataFrame) -> DataFrame:
    """(id, above, below): of the nodes that reach one of the HUBS nodes with the most ways through them, or are reached from it, a bit a hub for either."""
    ways = edges.groupBy(F.col("super").alias("id")).agg(F.count("*").alias("out")).join(edges.groupBy(F.col("sub").alias("id")).agg(F.count("*").alias("in")), "id")
    hubs = [r["id"] for r in ways.orderBy(F.desc(F.col("in") * F.col("out")), "id").limit(HUBS).collect()]
    both = staged(edges.select("super", "sub", F.lit(True).alias("down")).union(edges.select("sub", "super", F.lit(False))))
    start = edges.where(F.col("super").isin(hubs)).select(F.col("super").alias("root_id"), F.col("super").alias("id")).distinct().withColumn("down", F.explode(F.array(F.lit(True), F.lit(False))))
    found = search(start, both, "down")
    bit = reduce(lambda other, k: F.when(F.col("root_id") == hubs[k], F.lit(1 << k)).otherwise(other), range(len(hubs)), F.lit(0)).cast("long")
    bits = lambda down: F.sum(F.when(F.col("down") == down, bit).otherwise(0)).cast("long")
    return staged(found.groupBy("id").agg(bits(False).alias("above"), bits(True).alias("below")))


def closure(edges: DataFrame, seeds: DataFrame, large: int = LARGE) -> DataFrame:
    """As descendants, for graphs of any depth and with cycles.

    In graphs with more than `large` edges whatever reaches a hub reaches all that the hub does: those pairs are made at the
    end, row by row, without being searched, moved or kept; only the pairs that no hub explains are searched.
    """
    edges = staged(edges.select("super", "sub").distinct())
    roots = seeds.select(F.col("id").alias("root_id")).distinct().withColumn("id", F.col("root_id"))
    if edges.count() <= large:
        return search(roots, edges)
    sides = around_hubs(edges)
    above, below = sides.where("above <> 0").select(F.col("id").alias("root_id"), "above"), sides.where("below <> 0").select("id", "below")
    open_ = "coalesce(above, 0L) & coalesce(below, 0L) = 0"
    ends = staged(edges.join(below.withColumnRenamed("id", "sub"), "sub", "left"))
    own = roots.join(above, "root_id", "left").join(below, "id", "left").where(open_)
    rest = search(own, ends, "above", where=open_).select("root_id", "id")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    through = roots.select("root_id").join(above, "root_id").repartition(parts, "root_id").crossJoin(below).where("above & below <> 0").select("root_id", "id")
    return rest.unionByName(through)


def would_cycle(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (super, sub) with `cycle`: whether super can already be reached from sub; an edge to itself is a cycle."""
    below = closure(edges, pairs.select(F.col("sub").alias("id")))
    hit = below.select(F.col("root_id").alias("sub"), F.col("id").alias("super"), F.lit(True).alias("hit"))
    return pairs.join(hit, ["sub", "super"], "left").select("super", "sub", F.coalesce("hit", F.lit(False)).alias("cycle"))


def add_edge(edges: DataFrame, super_id: int, sub_id: int) -> tuple[DataFrame, str]:
    """edges with one more, and 'added', 'exists' or 'cycle' (then unchanged)."""
    spark = edges.sparkSession
    new = spark.createDataFrame([(super_id, sub_id)], edges.select("super", "sub").schema)
    if not edges.join(new, ["super", "sub"], "left_semi").isEmpty():
        return edges, "exists"
    if would_cycle(edges, new).first()["cycle"]:
        return edges, "cycle"
    return edges.unionByName(new), "added"
