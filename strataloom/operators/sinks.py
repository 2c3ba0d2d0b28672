"""Stored tables are files, so every change is a new version of a table: rows added, replaced or left out, then written in its place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.incorporate import numbered


def with_new(stored: DataFrame, rows: DataFrame, order: str, id_: str = "id") -> DataFrame:
    """stored and the rows, which get consecutive ids after the largest, in the order of a column with distinct values."""
    top = stored.agg(F.coalesce(F.max(id_), F.lit(-1)).alias("top")).first()["top"]
    fresh = numbered(rows, order, top).withColumnRenamed("canonical_id", id_)
    return stored.unionByName(fresh.select(*stored.columns))


def with_missing(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored and those of the rows (one a key) whose key it lacks; what is there stays as it is. Null keys are equal."""
    there = F.struct(*keys)
    lacking = rows.select(*stored.columns).dropDuplicates(list(keys)).withColumn("_key", there)
    return stored.unionByName(lacking.join(stored.select(there.alias("_key")).distinct(), "_key", "left_anti").drop("_key"))


def with_replaced(stored: DataFrame, rows: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """stored in which all rows of the owners give way to rows; owners without rows lose theirs."""
    return stored.join(owners.select(owner).distinct(), owner, "left_anti").unionByName(rows.select(*stored.columns))


def without(stored: DataFrame, condition: Column) -> DataFrame:
    """stored without the rows that meet the condition; those for which it is unknown stay."""
    return stored.where(~F.coalesce(condition, F.lit(False)))


def changed(stored: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """stored with the values (key, some of its columns) of the rows they name; one join takes what a loop of single updates would."""
    names = [c for c in values.columns if c != key]
    side = values.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in names))
    joined = stored.join(side, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns))


def first_of(stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """stored without the rows that share their keys with one of a smaller `order` (distinct values). A row with a null among the keys stays. Keys are reduced before they move."""
    whole = ~F.greatest(*(F.col(k).isNull().cast("int") for k in keys)).cast("boolean") if len(keys) > 1 else F.col(keys[0]).isNotNull()
    kept = stored.where(whole).groupBy(*keys).agg(F.min(order).alias("_least"))
    single = stored.where(whole).join(kept.select(F.col("_least").alias(order)), order, "left_semi")
    return stored.where(~whole).unionByName(single)


class Store:
    """Named tables in one folder. A save writes new versions beside the old ones and then one numbered pointer that names the versions of all tables.

    Readers take the highest pointer that is whole, so they see all tables of a save or none, also after a crash
    between any two steps. A number is given once: of two saves from the same state the second ends with an error.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, path), newest first."""
        folder = self._path(f"{self.folder}/pointers")
        found = [f.getPath() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(((int(f.getName()), f.toString()) for f in found if f.getName().isdigit()), reverse=True)

    def _named(self, path: str) -> dict[str, str] | None:
        """The versions that a pointer names; None where its last write did not end."""
        text = "".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _now(self) -> tuple[int, dict[str, str]]:
        numbers = self._pointers()
        whole = ((named for _, path in numbers if (named := self._named(path)) is not None))
        return numbers[0][0] if numbers else 0, next(whole, {})

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self._now()[1][name]}")

    def save(self, **tables: DataFrame) -> None:
        """All tables or none; a table may be made from the version that it replaces."""
        version, (last, now) = uuid.uuid4().hex, self._now()
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/{name}/{version}")
        pointer = self._path(f"{self.folder}/pointers/{last + 1:012d}")
        out = self._files.create(pointer, False)  # an error where another save has taken the number
        try:
            out.write(bytearray(json.dumps(now | dict.fromkeys(tables, version)).encode()))
        finally:
            out.close()

    def clear(self, kept: int = 2) -> None:
        """Drops all but the newest pointers that are whole, and the versions that none of these names; for times without a save or a reader of older versions."""
        whole = [(number, named) for number, path in self._pointers() if (named := self._named(path)) is not None][:kept]
        if not whole:
            return
        for number, path in self._pointers():
            if number < whole[-1][0]:
                self._files.delete(self._path(path), False)
        for name in {n for _, named in whole for n in named}:
            held = {named.get(name) for _, named in whole}
            for f in self._files.listStatus(self._path(f"{self.folder}/{name}")):
                if f.getPath().getName() not in held:
                    self._files.delete(f.getPath(), True)
