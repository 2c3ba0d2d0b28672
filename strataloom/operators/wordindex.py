"""A stored word index: postings with positions, dealt to buckets by word, in blocks of rows that carry their largest count.

Layout under the index's folder, one subfolder a batch that was added:

- postings/batch=b/bucket=k: (term, block, n, most, ids, counts, places), a row for a word in a block of about BLOCK rows; ordered by word, so that
  both the bucket and, within its files, the word's row groups are found without reading others;
- rows/batch=b: (id, n_words) of the batch's rows;
- done/batch=b: the number of rows, written last: a batch without it does not exist for readers, and is written anew by the next attempt.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strataloom.functions.fulltext import Term

#: Buckets of words; rows of a block; blocks whose exact scores give the bar that other blocks must pass.
BUCKETS, BLOCK, SEEDS = 64, 512, 16


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class WordIndex:
    """An index in a folder that all executors see. Ids are unique: a row whose id the index already holds is left out when a batch is added."""

    spark: SparkSession
    path: str

    # ------------------------------------------------------------ building

    def batches(self) -> dict[int, int]:
        """The complete batches and their numbers of rows."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/done").collect()
        except AnalysisException:
            return {}
        return {r["batch"]: r["n_rows"] for r in rows}

    def add(self, rows: DataFrame, id_: str, words: Column, batch: int | None = None) -> WordIndex:
        """Index `words` (an array) of rows with new ids. A batch number that is complete already is left as it is, so a batch that is given again after a failure counts once.

        Rows are dealt to blocks by a hash of their id, once; words are counted and gathered within the blocks, so a word that every row holds is no single group. Null ids are left out.
        """
        known = self.batches()
        number = max(known, default=-1) + 1 if batch is None else batch
        if number in known:
            return self
        new = rows.select(F.col(id_).alias("id"), words.alias("words")).where("id IS NOT NULL")
        if known:
            new = new.join(self._rows(known).select("id"), "id", "left_anti")
        n_blocks = max(1, -(-rows.count() // BLOCK))
        dealt = new.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).repartition("block")
        each = dealt.select("block", "id", F.posexplode("words").alias("place", "term"))
        held = each.groupBy("block", "id", "term").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("place")).alias("at"))
        entry = F.struct("id", "tf", "at")
        lists = held.groupBy("block", "term").agg(F.max("tf").alias("most"), F.sort_array(F.collect_list(entry)).alias("e"))
        out = lists.select(bucket_of(F.col("term")).alias("bucket"), "term", "block", F.size("e").cast("long").alias("n"), "most", F.col("e.id").alias("ids"), F.col("e.tf").alias("counts"), F.col("e.at").alias("places"))
        out.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={number}")
        new.select("id", F.size("words").alias("n_words")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        added = self.spark.read.parquet(f"{self.path}/rows/batch={number}").count()
        self.spark.createDataFrame([(added,)], "n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={number}")
        return self

    def _rows(self, known: dict[int, int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("batch").isin(*known))

    # ------------------------------------------------------------ reading

    def all_postings(self) -> DataFrame:
        known = self.batches()
        kind = self._rows(known).schema["id"].dataType.simpleString()
        shape = f"term string, block int, n long, most int, ids array<{kind}>, counts array<int>, places array<array<int>>, batch int, bucket int"
        return self.spark.read.schema(shape).parquet(f"{self.path}/postings").where(F.col("batch").isin(*known) if known else F.lit(False))

    def postings(self, words: set[str], prefixes: set[str] = frozenset()) -> DataFrame:
        """The rows of the given words, and of words with the given starts, from their buckets only. Words with a start may lie in any bucket, where they are found by the order of words."""
        rows = self.all_postings()
        if not prefixes:
            numbers = {r["b"] for r in self.spark.createDataFrame([(w,) for w in words] or [("",)], "w string").select(bucket_of(F.col("w")).alias("b")).collect()}
            rows = rows.where(F.col("bucket").isin(*sorted(numbers)))
        tests = [F.col("term").isin(*sorted(words))] * bool(words) + [F.col("term").startswith(p) for p in sorted(prefixes)]
        return rows.where(reduce(lambda a, b: a | b, tests) if tests else F.lit(False))

    def matching(self, query: list[Term]) -> DataFrame:
        """(id, relevance) of the rows that meet a boolean query, as functions.fulltext says what meets it: relevance is how many of a row's words are words of wanted terms."""
        must, never, may = ([t for t in query if t.sign == s] for s in ("+", "-", ""))
        usable = query if must or may else []
        wanted = {w for t in usable if t.sign != "-" for w in t.words}
        plain = wanted | {w for t in usable if not t.prefix for w in t.words}
        read = self.postings(plain, {t.words[0] for t in usable if t.prefix})
        each = read.select("term", F.explode(F.arrays_zip("ids", "counts", "places")).alias("e")).select("term", "e.*")
        phrases = {w for t in usable if not t.prefix and len(t.words) > 1 for w in t.words}
        aggregates = [F.coalesce(F.sum(F.when(F.col("term").isin(*sorted(wanted)), F.col("counts"))), F.lit(0)).cast("long").alias("relevance")] if wanted else [F.lit(0).cast("long").alias("relevance")]
        if phrases:
            aggregates.append(F.map_from_entries(F.collect_list(F.when(F.col("term").isin(*sorted(phrases)), F.struct("term", "places")))).alias("at"))
        for k, t in enumerate(usable):
            if t.prefix or len(t.words) == 1:
                aggregates.append(F.bool_or(F.col("term").startswith(t.words[0]) if t.prefix else F.col("term") == t.words[0]).alias(f"t{k}"))
        rows = each.groupBy(F.col("ids").alias("id")).agg(*aggregates)

        def holds(k: int, t: Term) -> Column:
            if t.prefix or len(t.words) == 1:
                return F.col(f"t{k}")
            others = [(i, w) for i, w in enumerate(t.words) if i]
            follow = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col("at")[w], p + i) for i, w in others])
            return F.coalesce(F.exists(F.col("at")[t.words[0]], follow), F.lit(False))

        tests = {t: holds(k, t) for k, t in enumerate(usable)}
        if not tests:
            return rows.where(F.lit(False)).select("id", "relevance")
        ok = reduce(lambda a, b: a & b, [tests[t] for t in must]) if must else reduce(lambda a, b: a | b, [tests[t] for t in may])
        for t in never if usable else []:
            ok = ok & ~tests[t]
        return rows.where(ok).select("id", "relevance")

    def weights(self, words: set[str]) -> dict[str, int]:
        """A word's weight: a thousand times the logarithm of how rare it is among all rows, rounded down. Words that no row holds have none."""
        n = sum(self.batches().values())
        held = self.postings(words).groupBy("term").agg(F.sum("n").alias("df"))
        rows = held.select("term", F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).alias("w")).collect()  # a row a word of the query
        return {r["term"]: r["w"] for r in rows}

    def best(self, words: list[str], k: int) -> DataFrame:
        """(place, id, score) of the k rows with the highest score, then the smallest id: the sum of count times weight over the words (repeats count once).

        No row of a block scores more than the sum of its words' largest counts times their weights. The SEEDS blocks with the highest such bound are
        scored first; only blocks whose bound reaches the k-th best of their scores are read after that, which loses no row.
        """
        asked = set(words)
        weight = self.weights(asked)
        rows = self.postings(asked)
        if not weight:
            return rows.select(F.lit(0).alias("place"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
        factor = F.element_at(F.create_map(*[x for w, v in sorted(weight.items()) for x in (F.lit(w), F.lit(v).cast("long"))]), F.col("term"))
        bounds = rows.groupBy("batch", "block").agg(F.sum(F.col("most") * factor).alias("bound"))

        def scored(some: DataFrame) -> DataFrame:
            each = rows.join(some.select("batch", "block"), ["batch", "block"], "left_semi").select(factor.alias("w"), F.explode(F.arrays_zip("ids", "counts")).alias("e"))
            return each.groupBy(F.col("e.ids").alias("id")).agg(F.sum(F.col("e.counts") * F.col("w")).alias("score")).where("score > 0")

        seeds = F.broadcast(bounds.orderBy(F.desc("bound"), "batch", "block").limit(SEEDS))
        first = scored(seeds).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        bar = first["least"] if first["n"] == k else 0
        top = scored(bounds.where(F.col("bound") >= bar)).orderBy(F.desc("score"), "id").limit(k)
        held = top.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("rows"))  # k rows
        return held.select(F.posexplode("rows").alias("at", "r")).select((F.col("at") + 1).cast("int").alias("place"), "r.id", (-F.col("r.s")).alias("score"))


def index_of(spark: SparkSession, path: str, rows: DataFrame, id_: str, words: Column) -> WordIndex:
    """The index at path, built from rows where there is none yet."""
    index = WordIndex(spark, path)
    return index if index.batches() else index.add(rows, id_, words)
