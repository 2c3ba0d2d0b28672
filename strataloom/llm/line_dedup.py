"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A run is a bucketed, sorted table (h1, h2, doc_id) that holds each line key's first document. A new batch
of documents reduces its lines to one row a key (map-side combined, so that a line of a third of all rows
costs one row a task), merge-anti-joins the runs on the same buckets without moving them, and adds what is
left as a run of level 0. When a level holds FANOUT runs, they merge, bucket by bucket, into one run of the next level.

Batches are taken in ascending doc_id ranges, so the first document seen with a key is the smallest.
All of it is DataFrame code.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import BLANKS, ascii_lower, discard, shared_dir, staged
from strataloom.operators.skew import SALTS

#: Keys shorter than this many code points are never dropped.
MIN_KEY = 10
BATCHES, FANOUT = 4, 3
#: Keys that a document loses are looked up one by one up to this many.
FEW = 256


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """The levelled runs. add() takes batches; tables() are the runs now in force."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_key: int = MIN_KEY):
        self.spark, self.fanout, self.min_key = spark, fanout, min_key
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Register the lines of batch (doc_id, text) and return the new run: keys no earlier batch held, with their smallest document."""
        lines = batch.where("doc_id IS NOT NULL").select("doc_id", F.explode(lines_of(F.col("text"))).alias("line"))
        keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= self.min_key)
        hashed = keys.select("doc_id", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
        fresh = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        for run in self.tables():
            fresh = fresh.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        name = self._write(fresh)
        self.levels[0].append(name)
        self._compact()
        return self.spark.table(name[0]) if name in self.levels[0] else None

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_dir(self.spark)
        rows.write.option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name, path

    def _compact(self) -> None:
        at = 0
        while len(self.levels[at]) >= self.fanout:
            old, self.levels[at] = self.levels[at], []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._write(reduce(merged, (self.spark.table(n) for n, _ in old))))
            for name, path in old:
                self._drop(name, path)
            at += 1

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, path)

    def close(self) -> None:
        """Drop the runs that are in force; what was made from tables() must have been computed before."""
        for level in self.levels:
            for name, path in level:
                self._drop(name, path)
        self.levels = [[]]

    def kept(self) -> DataFrame:
        """(doc_id, kept_keys): the keys of which the document is the first holder. One row a key, so no hot key; a document's list is bounded by its own lines."""
        rows = reduce(DataFrame.unionByName, self.tables())
        return rows.groupBy("doc_id").agg(F.collect_list("h1").alias("kept_keys"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs as one. No key is in both, so a full outer merge join of the same buckets, which moves nothing, takes all rows of either in order."""
    right = right.withColumnRenamed("doc_id", "other")
    return left.join(right, ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("doc_id", "other").alias("doc_id"))


def ranges(docs: DataFrame, batches: int) -> list[Column]:
    """Conditions that part docs into ascending doc_id ranges of about equal counts."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        cond = F.lit(True) if low is None else F.col("doc_id") > low
        out.append(cond if high is None else cond & (F.col("doc_id") <= high))
    return out


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_key: int = MIN_KEY) -> DataFrame:
    """Drop repeated lines across documents, keeping them in the smallest doc_id that holds them.

    Returns doc_id, text (what stays, joined by newlines), n_lines, n_dropped. Null or empty text: one empty
    line. Lines repeated within their first document all stay. Rows with a null doc_id pass unchanged and
    hold no lines; rows that repeat a doc_id count as one document, each row is returned. An empty table
    gives an empty table. Other columns of docs are ignored.
    """
    return dropped(docs.select("doc_id", "text"), batches, fanout, min_key).select("doc_id", "text", "n_lines", "n_dropped")


def dropped(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_key: int = MIN_KEY) -> DataFrame:
    """As dedup_lines, with the other columns of docs in a struct `rest`, whatever their names."""
    runs = LineRuns(docs.sparkSession, fanout, min_key)
    for part in ranges(docs, batches):
        runs.add(docs.where(part))
    rest = F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(True).alias("_")).alias("rest")
    kept = staged(runs.kept().withColumn("part", F.lit(0)))
    runs.close()
    # null ids have no runs; a second key keeps their rows apart
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).otherwise(0)
    joined = docs.select("doc_id", "text", rest, part.alias("part")).join(kept, ["doc_id", "part"], "left")
    pairs = F.transform(
        lines_of(F.col("text")),
        lambda x: F.struct(x.alias("line"), F.when(F.char_length(line_key(x)) >= min_key, F.xxhash64(line_key(x))).alias("key")),
    )
    none = F.array().cast("array<bigint>")
    held = joined.select("doc_id", "rest", "kept_keys", pairs.alias("pairs"))
    gone = F.array_except(F.array_compact(F.col("pairs.key")), F.coalesce("kept_keys", none))
    marked = held.select("doc_id", "rest", "pairs", F.when(F.col("doc_id").isNull(), none).otherwise(gone).alias("gone"))
    # long lists of keys are looked up in small parts by remainder, so that long documents stay far from lines times keys
    parts = F.ceil(F.sqrt(F.size("gone"))).cast("int")
    by_rest = F.transform(F.sequence(F.lit(0), parts - 1), lambda b: F.filter("gone", lambda g: F.pmod(g, parts) == b))
    looked = marked.select("doc_id", "rest", "pairs", "gone", F.when(F.size("gone") > FEW, by_rest).alias("parts"))
    there = lambda key: F.when(F.col("parts").isNull(), F.array_contains("gone", key)).otherwise(F.array_contains(F.get("parts", F.pmod(key, F.size("parts")).cast("int")), key))
    stay = F.filter("pairs", lambda p: p["key"].isNull() | ~there(p["key"]))
    split = looked.select("doc_id", "rest", F.size("pairs").alias("n_lines"), F.when(F.size("gone") > 0, stay).otherwise(F.col("pairs")).alias("stay"))
    return split.select(
        "doc_id",
        F.array_join("stay.line", "\n").alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.size("stay")).cast("long").alias("n_dropped"),
        "rest",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with texts without repeated lines, and n_chars, where there is such a column, counted anew."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return dropped(docs).select(*(new.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT x.*, (length(x.k) < 10 OR f.first_id = x.doc_id) AS stays
  FROM keyed x LEFT JOIN firsts f ON x.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
