"""Joins whose keys may be very uneven: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one HEAVY-th of the rows, so there are fewer than HEAVY heavy keys, however large the input.
HEAVY = 4096
#: Up to this many rows one task takes them all with ease, whatever their keys.
LIGHT = 20_000
#: Parts into which a heavy key's rows are dealt where the other side is too wide to be broadcast.
SALTS = 64


def heavy_keys(values: DataFrame, size: str, total: int) -> DataFrame:
    """The rows of values (one a key, with its number of rows in `size`) whose keys are heavy: fewer than HEAVY."""
    return values.where(F.col(size) > F.lit(total / HEAVY))


def heavy_hashes(values: DataFrame, key: str, size: str, total: int) -> list[int]:
    """The hashes of the heavy keys, fewer than HEAVY numbers. A key is taken for heavy where its hash is among them, so a key that shares a heavy one's hash is treated alike."""
    return sorted({r["h"] for r in heavy_keys(values, size, total).select(F.xxhash64(key).alias("h")).collect()}) if total > LIGHT else []


def is_heavy(key: str, hashes: list[int]) -> Column:
    return F.xxhash64(key).isin(hashes) if hashes else F.lit(False)


def join_values(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with values (one row a key; `size`: its number of rows; total: of all rows). Heavy keys' values go to the rows, so no task gets more than one HEAVY-th of the rows, or LIGHT, by its key."""
    hashes = heavy_hashes(values, key, size, total)
    if not hashes:
        return rows.join(values, key)
    heavy = is_heavy(key, hashes)
    # a null key is heavy or light alike, and meets nothing
    return rows.where(~heavy).join(values.where(~heavy), key).unionByName(rows.where(heavy).join(F.broadcast(values.where(heavy)), key))


def salted(rows: DataFrame, hashes: list[int], key: str, spread: Column) -> DataFrame:
    """rows with `salt`: rows of heavy keys are dealt to SALTS parts by a hash of `spread`, others have 0."""
    return rows.withColumn("salt", F.when(is_heavy(key, hashes), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))


def replicated(rows: DataFrame, hashes: list[int], key: str) -> DataFrame:
    """rows (one a key) with `salt`, repeated for each part of heavy keys."""
    parts = F.when(is_heavy(key, hashes), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("salt", F.explode(parts))
