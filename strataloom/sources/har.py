"""HAR files as a Spark data source that deals byte ranges, so that one file of many gigabytes is many tasks.

A range's task has to find where entries start without having read what comes before. Whether the range starts inside a JSON string is told by trying
both: text read with strings and the rest swapped soon breaks JSON's grammar. From there on only brackets and the keys of open objects are
followed: an entry is an object with the members request and response. It belongs to the range in which it starts, and is read to its end.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of what is read beyond it at once, and of the first look at how a range starts; entries and bytes of a batch.
RANGE, MORE, LOOK, BATCH_ROWS, BATCH_BYTES = 32 << 20, 4 << 20, 1 << 16, 64, 8 << 20
STRING_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
MARK = re.compile(rb'["{}\[\]]')
COLON = re.compile(rb"\s*:")
#: JSON without regard to nesting; a value is followed by a comma, a colon, a closing bracket or the end.
SKELETON = re.compile(rb'(?:[\s{\[,:}\]]|(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|true|false|null)(?=\s*+(?:[,:}\]]|\Z)))*+', re.S)
CUT_LITERAL = re.compile(rb"[0-9.eE+\-a-z]*(?=\s*[,:}\]])")
AFTER_STRING = re.compile(rb"\s*(?:[,:}\]]|\Z)")
SURE = 1 << 62


def opened(path: str):
    """A file on the shared path, or in a store that pyarrow knows, for reading at any place."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(local(path), "rb")


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder, or of what a pattern fits, with the given ending; local ones as file:///..."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        about = store.get_file_info(inner)
        found = store.get_file_info(fs.FileSelector(inner, recursive=True)) if about.type == fs.FileType.Directory else [about]
        head = path[: len(path) - len(inner)]
        return sorted((head + f.path, f.size) for f in found if f.is_file and (f.path.endswith(ending) or f.path == inner))
    plain = local(path)
    if os.path.isdir(plain):
        names = [os.path.join(d, f) for d, _, fs_ in os.walk(plain) for f in fs_ if f.endswith(ending)]
    else:
        names = glob.glob(plain)
    return sorted((f"file://{os.path.abspath(f)}", os.path.getsize(f)) for f in names if os.path.isfile(f))


# ---------------------------------------------------------------- where a range starts


def broken_at(data: bytes, inside: bool) -> int:
    """Where data stops being JSON if it starts inside a string or not; SURE if it does not."""
    at = 0
    if inside:
        rest = STRING_REST.match(data)
        if rest is None:
            return SURE
        at = rest.end()
        if not AFTER_STRING.match(data, at):
            return at
    elif data[:1] not in b"\"{}[],: \t\r\n":
        cut = CUT_LITERAL.match(data)
        if cut is None:
            return 0
        at = cut.end()
    end = SKELETON.match(data, at).end()
    if end == len(data) or data[end] == 34 and STRING_REST.match(data, end + 1) is None or re.fullmatch(rb"[0-9.eE+\-a-z]{1,40}", data[end:]):
        return SURE  # the last value is cut off
    return end


def starts_inside(read, at: int, size: int) -> tuple[bool, int]:
    """Whether a string is open at place `at` of a file of `size` bytes, and from where on to read it: a character that a backslash before `at` protects is passed over."""
    if at == 0:
        return False, 0
    slashes, back = 0, min(at, 64)
    while True:
        before = read(at - back, at)
        slashes = len(before) - len(before.rstrip(b"\\"))
        if slashes < back or back == at:
            break
        back = min(at, back * 8)
    if slashes % 2:  # backslashes stand in strings only
        return True, at + 1
    look = LOOK
    while True:
        data = read(at, min(size, at + look))
        outside, inside = broken_at(data, False), broken_at(data, True)
        if outside != inside or at + look >= size:
            return inside > outside, at
        look *= 8


# ---------------------------------------------------------------- entries


@dataclass
class Open:
    """An open bracket: where it is, whether it is an object, and which of an entry's members it has."""

    at: int
    object: bool
    members: set = field(default_factory=set)
    outer: bool = False


def entries_in(read, size: int, start: int, stop: int, more: int = MORE) -> Iterator[tuple[int, bytes]]:
    """(place, JSON text) of the entries that start in [start, stop) of a file of `size` bytes; read(a, b) gives its bytes. An entry that the file's end cuts off is left out."""
    inside, base = starts_inside(read, start, size)
    data, at = read(base, max(base, min(stop, size))), 0
    stack: list[Open] = []

    def grown() -> bool:
        nonlocal data
        have = base + len(data)
        data += read(have, min(size, have + more))
        return base + len(data) > have

    if inside:
        while (rest := STRING_REST.match(data, 0)) is None:
            if not grown():
                return
        at = rest.end()
    while True:
        mark = MARK.search(data, at)
        here = base + (mark.start() if mark else len(data))
        if here >= stop and not any(o.at < stop and o.object and not o.outer for o in stack):
            return
        if mark is None:
            at = len(data)
            if not grown():
                return
            continue
        kind, at = data[mark.start()], mark.end()
        if kind == 34:
            while (rest := STRING_REST.match(data, at)) is None:
                if not grown():
                    return
            name, at = data[at : rest.end() - 1], rest.end()
            if stack and stack[-1].object and name in (b"request", b"response", b"log", b"entries"):
                while (colon := COLON.match(data, at)) is None and not data[at:].strip() and grown():
                    pass
                if colon:
                    stack[-1].members.add(name)
                    stack[-1].outer |= name in (b"log", b"entries")
        elif kind in b"{[":
            stack.append(Open(base + mark.start(), kind == 123))
        elif stack:
            top = stack.pop()
            if top.object and {b"request", b"response"} <= top.members and start <= top.at < stop:
                yield top.at, data[top.at - base : at]


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    start: int
    stop: int


class HarReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.range, self.columns = options["path"], int(options.get("range", RANGE)), columns

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(p, n, a, min(n, a + self.range)) for p, n in listed(self.path, ".har") for a in range(0, n, self.range)]

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        with opened(part.path) as file:

            def read(a: int, b: int) -> bytes:
                file.seek(a)
                return file.read(max(0, b - a))

            rows: list[tuple[int, bytes]] = []
            held = 0
            for row in entries_in(read, part.size, part.start, part.stop):
                rows.append(row)
                held += len(row[1])
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield self.batch(part.path, rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(part.path, rows)

    def batch(self, path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        made = {
            "source": lambda: pa.array([path] * len(rows), pa.string()),
            "place": lambda: pa.array([r[0] for r in rows], pa.int64()),
            "entry": lambda: pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string()),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)


class HarSource(DataSource):
    """spark.read.format("har").load(path): source, place (the entry's byte in its file, which orders a file's entries) and entry, its JSON text. Option range: bytes of a task. Columns that a given schema lacks are not made."""

    @classmethod
    def name(cls) -> str:
        return "har"

    def schema(self) -> str:
        return "source string, place long, entry string"

    def reader(self, schema) -> HarReader:
        return HarReader(self.options, schema.fieldNames())
