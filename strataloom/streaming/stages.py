"""Stages that sessions pass by their status: each stage is a stream over a log of statuses, and takes what waits for it.

Layout under the log's folder: statuses/<writer>=<name>-<batch>: rows (session, status, detail, step), never changed once complete; results/<stage>/batch=b: what a
stage made of a batch. A stage's batch writes its results, then its statuses, and both go by the batch's number: a batch that runs again after a failure overwrites
results that were not finished, and leaves alone a batch whose statuses are there. A session's status is the one with the highest step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strataloom.operators.maintenance import RETRY

STATUS = "session string, status string, detail string, step long"


@dataclass(frozen=True)
class Stage:
    """What a stage takes and what becomes of it. work: sessions (session, step) -> results (session, ...) and failures (session, detail); a session with a failure fails, whatever results it has."""

    name: str
    takes: str
    gives: str
    fails: str
    work: Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class StageLog:
    spark: SparkSession
    path: str

    def _complete(self, folder: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def say(self, rows: DataFrame, writer: str) -> None:
        """Statuses (session, status, detail, step) of one writer, once."""
        folder = f"{self.path}/statuses/{writer}"
        if not self._complete(folder):
            rows.select("session", "status", F.col("detail").cast("string").alias("detail"), F.col("step").cast("long").alias("step")).write.mode("overwrite").parquet(folder)

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATUS).option("recursiveFileLookup", True).parquet(f"{self.path}/statuses")
        except AnalysisException:
            return self.spark.createDataFrame([], STATUS)

    def current(self) -> DataFrame:
        """(session, status, detail, step): the latest of each session; one map-side combined aggregation."""
        last = F.max_by(F.struct("status", "detail", "step"), F.struct("step", "status"))
        return self.history().groupBy("session").agg(last.alias("s")).select("session", "s.*")

    def enter(self, sessions: DataFrame, status: str = "pending") -> None:
        """New sessions (session); those the log knows already are left out."""
        new = sessions.select("session").where("session IS NOT NULL").distinct().join(self.history().select("session"), "session", "left_anti")
        self.say(new.select("session", F.lit(status).alias("status"), F.lit(None).alias("detail"), F.lit(0).alias("step")), f"entered-{uuid.uuid4().hex}")

    def requeue(self, retry: Mapping[str, str] = RETRY) -> None:
        """Failed sessions start again where they failed."""
        again = F.lit(None).cast("string")
        for failed, start in retry.items():
            again = F.when(F.col("status") == failed, start).otherwise(again)
        rows = self.current().withColumn("again", again).where("again IS NOT NULL")
        self.say(rows.select("session", F.col("again").alias("status"), F.lit("requeued").alias("detail"), (F.col("step") + 1).alias("step")), f"requeued-{uuid.uuid4().hex}")

    def results(self, stage: str) -> DataFrame:
        """What a stage made of each session, as its last finished batch made it. Results of batches without statuses do not count."""
        rows = self.spark.read.parquet(f"{self.path}/results/{stage}")
        numbers = [b["batch"] for b in rows.select("batch").distinct().collect() if self._complete(f"{self.path}/statuses/{stage}-{b['batch']}")]
        held = rows.where(F.col("batch").isin(*numbers) if numbers else F.lit(False))
        return held.join(held.groupBy("session").agg(F.max("batch").alias("batch")), ["session", "batch"], "left_semi")

    def run(self, stage: Stage, wait: bool = True):
        """Take all that waits for a stage, then stop. Batches follow the log's new files; a session is taken where its latest status is the one that the stage takes, so a status that is no longer true takes nothing."""

        def batch(rows: DataFrame, number: int) -> None:
            writer = f"{stage.name}-{number}"
            if self._complete(f"{self.path}/statuses/{writer}"):
                return
            asked = rows.where(F.col("status") == stage.takes).select("session").distinct()
            waiting = self.current().where(F.col("status") == stage.takes).join(asked, "session", "left_semi").select("session", "step")
            made, failed = stage.work(waiting)
            folder = f"{self.path}/results/{stage.name}/batch={number}"
            wrong = failed.groupBy("session").agg(F.min("detail").alias("detail"))
            made.join(wrong, "session", "left_anti").write.mode("overwrite").parquet(folder)
            status = F.when(F.col("wrong"), stage.fails).otherwise(stage.gives)
            both = waiting.join(wrong.withColumn("wrong", F.lit(True)), "session", "left").withColumn("wrong", F.coalesce("wrong", F.lit(False)))
            self.say(both.select("session", status.alias("status"), "detail", (F.col("step") + 1).alias("step")), writer)

        stream = self.spark.readStream.schema(STATUS).option("recursiveFileLookup", True).parquet(f"{self.path}/statuses")
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.path}/checkpoints/{stage.name}").trigger(availableNow=True).start()
        if wait:
            query.awaitTermination()
        return query


def drive(log: StageLog, stages: list[Stage]) -> None:
    """All stages in their order, each until nothing waits for it."""
    for stage in stages:
        log.run(stage)
