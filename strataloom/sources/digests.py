"""Hashes of files of any size, as Spark data sources that read ranges: no value and no row holds a file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataloom.sources.har import listed, opened

#: Bytes of a chunk, of a task's range (whole chunks), and of a read.
CHUNK, RANGE, PIECE = 1 << 20, 64 << 20, 1 << 20


@dataclass
class Chunks(InputPartition):
    """The chunks first to last - 1 of a file."""

    path: str
    length: int
    first: int
    last: int


def digest(file, start: int, stop: int) -> str:
    """The sha256 of the bytes start to stop, read in pieces."""
    file.seek(start)
    found, left = hashlib.sha256(), stop - start
    while left and (piece := file.read(min(PIECE, left))):
        found.update(piece)
        left -= len(piece)
    return found.hexdigest()


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.ending = options["path"], options.get("ending", "")
        self.chunk, self.range = int(options.get("chunk", CHUNK)), int(options.get("range", RANGE))

    def count(self, length: int) -> int:
        return max(1, -(-length // self.chunk))  # an empty file has one empty chunk

    def partitions(self) -> list[InputPartition]:
        each = max(1, self.range // self.chunk)
        return [Chunks(p, n, a, min(self.count(n), a + each)) for p, n in listed(self.path, self.ending) for a in range(0, self.count(n), each)]

    def read(self, part: Chunks | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        places = list(range(part.first, part.last))
        with opened(part.path) as file:
            hashes = [digest(file, k * self.chunk, min(part.length, (k + 1) * self.chunk)) for k in places]
        columns = [pa.array([part.path] * len(places)), pa.array(places, pa.int64()), pa.array([self.count(part.length)] * len(places), pa.int64()), pa.array(hashes)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "chunk", "n_chunks", "sha256"])


class FileReader(ChunkReader):
    """Whole files: a hash of a whole file is one task's work, but for its memory."""

    def partitions(self) -> list[InputPartition]:
        return [Chunks(p, n, 0, 1) for p, n in listed(self.path, self.ending)]

    def read(self, part: Chunks | None) -> Iterator[tuple]:
        if part is not None:
            with opened(part.path) as file:
                yield part.path, part.length, digest(file, 0, part.length)


class ChunkHashes(DataSource):
    """spark.read.format("chunk_hashes").option("chunk", bytes).load(path): path, chunk, n_chunks, sha256 of the consecutive chunks of files. Options range (bytes of a task) and ending (of the files' names)."""

    @classmethod
    def name(cls) -> str:
        return "chunk_hashes"

    def schema(self) -> str:
        return "path string, chunk long, n_chunks long, sha256 string"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


class FileHashes(DataSource):
    """spark.read.format("file_hashes").load(path): path, length and sha256 of whole files, read piece by piece."""

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)


def chunk_hashes(spark: SparkSession, path: str, chunk: int = CHUNK, size: int = RANGE) -> DataFrame:
    """(path, chunk, n_chunks, sha256) of the files under path, for operators.integrity.tree_roots and changed_chunks."""
    spark.dataSource.register(ChunkHashes)
    return spark.read.format("chunk_hashes").option("chunk", chunk).option("range", size).load(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under path, for operators.integrity.manifest_check, digest_list and verified_copy."""
    spark.dataSource.register(FileHashes)
    return spark.read.format("file_hashes").load(path)
