"""Merkle fixity audit of WARC records.

Records lie in archives, one after another, so a record covers the range of offsets [start, end). A replica's
tree has the records' hashes as leaves, blocks of consecutive records above them and FANOUT nodes under each
node beyond that, up to one root an archive; a node's hash covers its children's hashes and their ranges, counted from
the node's own start, in order. So a record that changes its size changes the nodes above it and no others,
although all that follows it moves. An audit compares two replicas' roots and descends, level by level, only below
nodes that differ, down to the records that are damaged, missing or unexpected.

Offsets come in two steps (sums of blocks, then records within a block), so an archive that holds most of the
records is not one task's work. All of it is DataFrame code; hashes are staged as 32 bytes a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataloom.llm.common import staged

#: Records whose sequence numbers share a block, nodes under a node, levels of nodes over the blocks (the topmost is the root).
BLOCK, FANOUT, LEVELS = 256, 64, 4
#: Pages an archive file holds in the query, and how the md5 of a page_id starts whose record is damaged in its second replica (1 in 256).
PAGES, DAMAGED = 5_000, "00"


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a response record; nulls count as empty."""
    content = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame) -> DataFrame:
    """(archive, block, place, seq, copy, start, end, hash) of records (archive, seq, payload), staged: ranges follow from the order of seq within each archive.

    Nulls in archive and seq count as values of their own that come first. Records that share a seq lie one
    after another in the order of their hashes; a null payload is an empty record.
    """
    hashed = staged(
        records.select("archive", "seq", F.octet_length(F.coalesce("payload", F.lit("").cast("binary"))).cast("long").alias("size"), F.unhex(F.sha2(F.coalesce("payload", F.lit("").cast("binary")), 256)).alias("hash"))
    )
    block = F.floor(F.coalesce("seq", F.lit(-1)) / BLOCK).alias("block")
    blocks = hashed.groupBy("archive", block).agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("archive").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = blocks.select(F.col("archive").alias("a"), F.col("block").alias("b"), before.alias("base"))
    rows = hashed.withColumn("block", block)
    joined = rows.join(bases, rows["archive"].eqNullSafe(bases["a"]) & (rows["block"] == bases["b"]))
    order = W.partitionBy("archive", "block").orderBy(F.asc_nulls_first("seq"), "hash")
    ordered = joined.withColumn("end", F.col("base") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    ordered = ordered.withColumn("copy", F.row_number().over(W.partitionBy("archive", "block", "seq").orderBy("hash")))
    return ordered.select("archive", "block", "place", "seq", "copy", (F.col("end") - F.col("size")).alias("start"), "end", "hash")


def parents(nodes: DataFrame, by: list[Column], order: list[str]) -> DataFrame:
    """One node a group of `by`: its range and the hash of its children's ranges, from its own start on, and hashes, in order."""
    child = F.struct(*order, "start", "end", F.hex("hash").alias("hash"))
    groups = nodes.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(child)).alias("children"))
    said = F.array_join(F.transform("children", lambda c: F.concat_ws(":", (c["start"] - F.col("start")).cast("string"), (c["end"] - F.col("start")).cast("string"), c["hash"])), "|")
    return groups.withColumn("hash", F.unhex(F.sha2(said, 256))).drop("children")


def merkle_tree(records: DataFrame) -> list[DataFrame]:
    """The levels of a replica's trees, staged: records first, then blocks, then nodes, the roots last.

    A block gathers the records of BLOCK consecutive sequence numbers and a node at most FANOUT nodes, so no
    group grows with the archive (records that share a sequence number share its block).
    """
    levels = [staged(leaves(records))]
    levels.append(staged(parents(levels[0], ["archive", "block"], ["place"]).withColumnRenamed("block", "node")))
    for k in range(LEVELS):
        up = F.lit(0).cast("long") if k == LEVELS - 1 else F.floor(F.col("node") / FANOUT)
        levels.append(staged(parents(levels[-1].withColumn("up", up), ["archive", "up"], ["node"]).withColumnRenamed("up", "node")))
    return levels


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys at which the hashes of two levels differ or that only one has; a node that has only moved does not differ."""
    pair = lambda d, side: d.select(F.struct(*keys).alias("key"), F.struct("start", "end", "hash").alias(side))
    both = pair(left, "l").join(pair(right, "r"), "key", "full_outer")
    return both.where(~F.col("l.hash").eqNullSafe(F.col("r.hash"))).select("key.*", "l", "r")


def under(level: DataFrame, bad: DataFrame, parent: Column) -> DataFrame:
    """The nodes of level whose parent is in bad (archive, node)."""
    marked = level.withColumn("parent", parent)
    found = bad.select(F.col("archive").alias("a"), F.col("node").alias("n"))
    return marked.join(found, marked["archive"].eqNullSafe(found["a"]) & (marked["parent"] == found["n"]), "left_semi").drop("parent")


def descent(left: list[DataFrame], right: list[DataFrame]) -> list[DataFrame]:
    """The nodes (archive, node) that differ, staged, level by level from the roots down to the blocks; only children of differing nodes are compared."""
    bad = [staged(differing(left[-1], right[-1], ["archive", "node"]).select("archive", "node"))]
    for k in range(len(left) - 2, 0, -1):
        up = F.lit(0).cast("long") if k == len(left) - 2 else F.floor(F.col("node") / FANOUT)
        bad.append(staged(differing(under(left[k], bad[-1], up), under(right[k], bad[-1], up), ["archive", "node"]).select("archive", "node")))
    return bad


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """archive, seq, copy, start, end, status ('damaged', 'missing', 'unexpected') and both hashes of every record in which the right replica differs from the left.

    A record whose bytes are intact but whose range moved, because a record before it changed its size, is not
    reported. Records that share a sequence number are paired in the order of their hashes. Identical or empty
    replicas give no rows.
    """
    bad = descent(left, right)[-1]
    rows = differing(under(left[0], bad, F.col("block")), under(right[0], bad, F.col("block")), ["archive", "block", "seq", "copy"])
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").otherwise("damaged")
    side = F.coalesce("l", "r")
    return rows.select("archive", "seq", "copy", side["start"].alias("start"), side["end"].alias("end"), status.alias("status"), F.col("l.hash").alias("left_hash"), F.col("r.hash").alias("right_hash"))


def page_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the records of pages: the second has the body's first character changed on pages that DAMAGED chooses."""
    archive = F.floor(F.coalesce("page_id", F.lit(-1)) / PAGES)
    hit = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")).startswith(DAMAGED)
    spoilt = F.when(hit, F.concat(F.lit("\0"), F.substring(F.coalesce("html", F.lit("")), 2, 2**31 - 1))).otherwise(F.col("html"))
    make = lambda body: pages.select(archive.alias("archive"), F.col("page_id").alias("seq"), warc_record(F.col("page_id"), F.col("url"), body).alias("payload"))
    return make(F.col("html")), make(spoilt)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in the first replica with its range, hash and what the audit of the second says of it."""
    left, right = (merkle_tree(r) for r in page_replicas(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    found = audit(left, right).select(F.col("archive").alias("a"), F.col("seq").alias("s"), F.col("copy").alias("c"), "status")
    records = left[0]
    joined = records.join(found, records["archive"].eqNullSafe(found["a"]) & records["seq"].eqNullSafe(found["s"]) & (records["copy"] == found["c"]), "left")
    return joined.select(
        F.col("seq").alias("page_id"), F.col("archive").cast("long").alias("archive"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), F.lower(F.hex("hash")).alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status")
    )


def roots(tree: list[DataFrame]) -> DataFrame:
    """archive and root hash (hex) of a replica's trees."""
    return tree[-1].select("archive", F.lower(F.hex("hash")).alias("root"))



OP7_SQL = f"""
WITH r AS (
  SELECT page_id, page_id // {PAGES} AS archive,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
o AS (SELECT *, sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id) AS e FROM r)
SELECT page_id, archive::BIGINT AS archive, (e - strlen(record))::BIGINT AS start_offset, e::BIGINT AS end_offset, sha256(record) AS record_sha256,
       CASE WHEN md5(page_id::VARCHAR) LIKE '{DAMAGED}%' THEN 'damaged' ELSE 'intact' END AS status
FROM o
"""
