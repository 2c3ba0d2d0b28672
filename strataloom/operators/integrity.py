"""Hashes of files in chunks, their tree root, and checks against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.lineage import checkpointed
from strataloom.operators.skew import join_values

#: Layers of a hash tree that one round climbs, and hashes that it gathers in a row.
LAYERS = 10
FAN = 1 << LAYERS


def chunk_hashes(files: DataFrame, path: str, content: str, size: int) -> DataFrame:
    """(path, chunk, sha256) of each file's consecutive chunks of `size` bytes; an empty file has one empty chunk."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))
    count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    rows = files.select(path, data.alias("_data"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return rows.select(path, F.col("chunk").cast("long").alias("chunk"), F.sha2(F.substring("_data", F.col("chunk") * size + 1, F.lit(size)), 256).alias("sha256"))


def pair_up(hashes: Column) -> Column:
    """One layer up: the hashes of neighbouring pairs' digests (32 bytes each, given and returned as hexadecimal text); an odd last one pairs with itself."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.unhex(F.concat(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.get(hashes, 2 * i)))), 256))


def tree_roots(chunks: DataFrame, path: str) -> DataFrame:
    """(path, root): the root of each file's hash tree over its chunks (path, chunk from 0 on, sha256).

    A round gathers FAN neighbouring hashes in a row and takes them LAYERS layers up, or to the root where a file has no more; so no row grows with a file,
    and a file of n chunks takes log(n) / LAYERS rounds.
    """
    sizes = checkpointed(chunks.groupBy(path).agg(F.count("*").alias("n")))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    rows = join_values(chunks.select(path, "chunk", "sha256"), sizes, path, "n", total or 0)
    while True:
        # as many layers as halve n to one: an odd last one pairs with itself, up to a file's own root
        layers = F.least(F.lit(LAYERS), F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0))
        held = rows.groupBy(path, "n", F.floor(F.col("chunk") / FAN).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda c: c["sha256"]).alias("h"))
        up = F.aggregate(F.sequence(F.lit(1), F.lit(LAYERS)), F.col("h"), lambda h, k: F.when(k <= layers, pair_up(h)).otherwise(h))
        rows = held.withColumn("sha256", F.get(up, F.lit(0))).select(path, F.ceil(F.col("n") / FAN).alias("n"), F.col("part").alias("chunk"), "sha256")
        if (most or 0) <= FAN:
            return rows.select(path, F.col("sha256").alias("root"))
        most = -(-most // FAN)
        rows = checkpointed(rows)


def changed_chunks(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """(path, chunk) of chunks whose hashes differ or that one side lacks."""
    both = left.alias("l").join(right.alias("r"), [path, "chunk"], "full_outer")
    return both.where(~F.col("l.sha256").eqNullSafe(F.col("r.sha256"))).select(path, "chunk")


def hashed(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, content), or of files whose hashes are there already (path, sha256), as sources.digests reads them."""
    return files.select("path", "sha256" if "sha256" in files.columns else F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (path, sha256) with status: pass, fail, missing, or invalid_path for absolute paths and ones that climb."""
    invalid = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    found = hashed(files).withColumnRenamed("sha256", "actual")
    status = F.when(invalid, "invalid_path").when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "pass").otherwise("fail")
    return manifest.join(found, "path", "left").select("path", "sha256", status.alias("status"))


def capture_stats(index: DataFrame) -> DataFrame:
    """(archive, records, urls, first_at, last_at) of index rows (archive, url, mime, at)."""
    return index.groupBy("archive").agg(F.count("*").alias("records"), F.count_distinct("url").alias("urls"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def mime_histogram(index: DataFrame) -> DataFrame:
    return index.groupBy("archive", F.coalesce("mime", F.lit("unknown")).alias("mime")).agg(F.count("*").alias("n"))


def asset_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log and rows (asset_id, filenames, acquired_at) as one row an asset: all its filenames and the time it was first acquired."""
    both = log.unionByName(rows)
    return both.groupBy("asset_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("filenames")))).alias("filenames"), F.min("acquired_at").alias("acquired_at"))


def digest_list(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, and content or sha256), in the order of their paths."""
    return hashed(files).orderBy("path")


def verified_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, status) of every file that source or target (path, and content or sha256) has: same, different, missing (not copied) or unexpected."""
    a, b = (hashed(d).withColumnRenamed("sha256", n) for d, n in ((source, "a"), (target, "b")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))
