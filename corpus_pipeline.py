"""Training-data pipeline over documents: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Each works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, language_id, line_dedup, minhash, mixing
from strataloom.llm.common import staged

#: A document is rejected where no language is found or its language's score is below this.
LEAST_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in whose text a language is found with a score of LEAST_SCORE or more. Null and empty texts and texts without a letter go; repeated rows are judged each; null ids are carried along; an empty table gives an empty table."""
    model = language_id.fit(docs)
    marked = docs.select(F.struct(*docs.columns).alias("row"), language_id.predicted(F.col("text"), spark, model).alias("p"))
    return marked.where((F.col("p.lang_pred") != language_id.UNKNOWN) & (F.col("p.score") >= LEAST_SCORE)).select("row.*")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with texts without the lines that a smaller doc_id holds, and n_chars counted anew. Null texts become empty ones; rows without an id pass unchanged; rows that repeat an id are one document and all stay; other columns stay, whatever their names."""
    return line_dedup.deduplicated(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but those with a near duplicate of smaller doc_id, directly or through others. Empty texts duplicate nothing; rows that repeat a kept id, and rows without an id, all stay; an empty table gives an empty table."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs sampled by calibrated probabilities. Null sources and languages count as empty; texts without words are kept with the asked fraction; rows that repeat an id share their hash; an empty table gives an empty table."""
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of ids and of the text decoded from them, a row of docs; null and empty texts have no ids, null ids are carried along."""
    return bpe.digests(bpe.encode(docs, bpe.default_vocabulary(), decoded=True), "ids")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Language ID, MinHash and BPE have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
