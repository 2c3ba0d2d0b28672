"""WACZ archives as a Spark data source: responses by ranges of their WARC files, and what an archive says about itself.

An archive is a zip file of WARC files, an index of their records, a list of pages and a signed description. A task takes a share of an archive's
ranges, which the index's record starts cut; it reads the zip's directory and index itself, so that planning lists files and no more.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from strataloom.sources.har import listed, opened

#: Bytes of an archive that a task reads at once, about; rows and bytes of a batch.
RANGE, BATCH_ROWS, BATCH_BYTES = 64 << 20, 256, 8 << 20
#: What a request that was sent with a body is stored as: its address, this, and the body's fields. Fixed value.
POSTED = "?__wb_method="
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Members that describe an archive. Fixed values.
PACKAGE, DIGEST, PAGES = "datapackage.json", "datapackage-digest.json", "pages/pages.jsonl"


class Span(io.RawIOBase):
    """The bytes [start, end) of a file."""

    def __init__(self, file, start: int, end: int):
        self.file, self.left = file, end - start
        file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self.file.read(min(len(target), self.left))
        target[: len(data)] = data
        self.left -= len(data)
        return len(data)


def ranges_in(file, z: zipfile.ZipFile, size: int) -> Iterator[tuple[str, int, int, int]]:
    """base is -1 for files that the zip compresses."""
    cuts: dict[str, dict[int, int]] = {}
    for name in z.namelist():
        if name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", name):
            with z.open(name) as raw:
                for line in gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw:
                    try:
                        said = json.loads(line[line.index(b"{") :])
                        at, member = int(said["offset"]), "archive/" + said["filename"].removeprefix("archive/")
                    except (ValueError, KeyError, TypeError, AttributeError):
                        continue
                    held = cuts.setdefault(member, {})
                    held[at // size] = min(at, held.get(at // size, at))
    for info in z.infolist():
        if not re.match(r"(archive|data)/.*\.warc(\.gz)?$", info.filename):
            continue
        if info.compress_type != zipfile.ZIP_STORED:
            yield info.filename, -1, 0, info.file_size
            continue
        file.seek(info.header_offset + 26)
        name_size, extra = struct.unpack("<HH", file.read(4))
        base = info.header_offset + 30 + name_size + extra
        starts = [0]
        magic = b"\x1f\x8b\x08" if info.filename.endswith(".gz") else b"WARC/"
        for at in sorted(cuts.get(info.filename, {}).values()):
            if 0 < at < info.file_size:
                file.seek(base + at)
                if file.read(len(magic)) == magic:  # an index that is wrong cuts nothing
                    starts.append(at)
        for a, b in zip(starts, [*starts[1:], info.file_size], strict=True):
            yield info.filename, base, a, b


@dataclass
class Share(InputPartition):
    """The ranges of an archive that lie in its k-th of n parts."""

    path: str
    k: int
    n: int


@dataclass(frozen=True)
class Response:
    """The head of a response record; body() decodes what follows it."""

    url: str
    posted: str | None
    status: int
    mime: str
    body: Callable[[], bytes]


def shares_of(path: str, size: int, k: int, n: int) -> Iterator[tuple[str, int, int, int]]:
    """The k-th of n parts of an archive's ranges, about as many bytes in each."""
    with opened(path) as file, zipfile.ZipFile(file) as z:
        found = list(ranges_in(file, z, size))
    total, at = max(1, sum(end - start for _, _, start, end in found)), 0
    for r in found:
        if at * n // total == k:
            yield r
        at += r[3] - r[2]


def member_order(path: str) -> dict[str, int]:
    """The numbers of an archive's members, in the order of its directory."""
    with opened(path) as file, zipfile.ZipFile(file) as z:
        return {name: k for k, name in enumerate(z.namelist())}


def responses_in(path: str, member: str, base: int, start: int, end: int) -> Iterator[tuple[int, Response]]:
    """(place, response) of a range of a WARC file in an archive; places rise along the file."""
    with opened(path) as file:
        if base < 0:
            with zipfile.ZipFile(file) as z, z.open(member) as raw:
                yield from enumerate(warc_responses(gzip.GzipFile(fileobj=raw) if member.endswith(".gz") else raw))
        else:
            raw = io.BufferedReader(Span(file, base + start, base + end), 1 << 20)
            for k, r in enumerate(warc_responses(gzip.GzipFile(fileobj=raw) if member.endswith(".gz") else raw)):
                yield start + k, r  # records are longer than a byte


def warc_responses(stream) -> Iterator[Response]:
    """The responses of a WARC stream that starts at a record."""
    while head := headers(stream):
        block = stream.read(int(head.get("content-length", 0)))
        if head.get("warc-type") != "response":
            continue
        text, _, body = block.partition(b"\r\n\r\n")
        lines = text.decode("latin-1").split("\r\n")
        own = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        url, _, posted = head.get("warc-target-uri", "").partition(POSTED)
        status = (lines[0].split(" ") + ["0", "0"])[1]

        def decoded(body: bytes = body, packed: bool = own.get("content-encoding") == "gzip") -> bytes:
            try:
                return gzip.decompress(body) if packed else body
            except (OSError, EOFError):
                return body  # some writers store the decoded body under the original header

        yield Response(url, posted or None, int(status) if status.isdigit() else 0, own.get("content-type", ""), decoded)


def headers(stream) -> dict[str, str]:
    """The next WARC header block; {} at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    out: dict[str, str] = {}
    while line and line not in (b"\r\n", b"\n"):
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out[key.strip().lower()] = value.strip()
        line = stream.readline()
    return out


class WaczReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.size, self.columns = options["path"], int(options.get("range", RANGE)), columns
        self.tests: list[tuple[str, Callable]] = []

    def partitions(self) -> list[Share]:
        return [Share(p, k, n) for p, length in listed(self.path, ".wacz") for n in [max(1, -(-length // self.size))] for k in range(n)]

    def read(self, part: Share | None) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        order = member_order(part.path) if part else {}
        for r in shares_of(part.path, self.size, part.k, part.n) if part else ():
            for place, response in responses_in(part.path, *r):
                if not all(test(getattr(response, column)) for column, test in self.tests):
                    continue
                made = {"source": part.path, "member": r[0], "place": (order[r[0]] << 44) + place, "url": response.url, "posted": response.posted, "status": response.status, "mime": response.mime}
                if "body" in self.columns:  # else it is never decoded
                    made["body"] = response.body()
                    held += len(made["body"])
                rows.append([made[c] for c in self.columns])
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        kinds = {"place": pa.int64(), "status": pa.int32(), "body": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(c, pa.string())) for i, c in enumerate(self.columns)], self.columns)


class FilteringReader(WaczReader):
    """Takes over comparisons of url, status and mime with constants, so that bodies of other responses are not decoded. Spark wants this only where its setting PUSHDOWN is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 else None
            if column not in ("url", "status", "mime"):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, f.value.__eq__))
            elif isinstance(f, In):
                self.tests.append((column, frozenset(f.value).__contains__))
            else:
                self.tests.append((column, lambda x, start=f.value: x.startswith(start)))


class WaczSource(DataSource):
    """spark.read.format("wacz").load(path): the responses of WACZ archives, whatever their status: source, member, place (which orders an archive's responses), url, posted (the fields
    of a request that was sent with a body), status, mime, body. Option range: bytes of a task. Columns that a given schema lacks are not made. Option filters ("true"): see FilteringReader."""

    @classmethod
    def name(cls) -> str:
        return "wacz"

    def schema(self) -> str:
        return "source string, member string, place long, url string, posted string, status int, mime string, body binary"

    def reader(self, schema) -> WaczReader:
        return (FilteringReader if self.options.get("filters") == "true" else WaczReader)(self.options, schema.fieldNames())


def read_wacz(spark: SparkSession, path: str, columns: str | None = None, size: int = RANGE) -> DataFrame:
    """The data source's rows, with filters pushed into it where the session allows that."""
    spark.dataSource.register(WaczSource)
    reader = spark.read.format("wacz").option("range", size).option("filters", spark.conf.get(PUSHDOWN, "false").lower())
    return (reader.schema(columns) if columns else reader).load(path)


def wacz_responses(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The 200 and 206 responses of WACZ archives."""
    return read_wacz(spark, path, size=size).where("status IN (200, 206)")


def wacz_entries(responses: DataFrame) -> DataFrame:
    """(source, place, request, response) of responses, in the form of HAR entries; a request's posted fields are its parameters."""
    name = lambda pair: F.try_url_decode(F.split_part(pair, F.lit("="), F.lit(1)))
    value = lambda pair: F.try_url_decode(F.substring_index(pair, "=", -1))
    fields = F.filter(F.split(F.coalesce("posted", F.lit("")), "&"), lambda p: F.contains(p, F.lit("=")))
    params = F.transform(fields, lambda p: F.struct(name(p).alias("name"), value(p).alias("value")))
    none, no_headers = F.lit(None).cast("string"), F.array().cast("array<struct<name: string, value: string>>")
    content = F.struct(F.col("mime").alias("mimeType"), F.base64("body").alias("text"), F.lit("base64").alias("encoding"))
    request = F.struct(F.when(F.col("posted").isNull(), "GET").otherwise("POST").alias("method"), F.col("url").alias("url"), no_headers.alias("headers"), F.struct(none.alias("text"), params.alias("params")).alias("postData"))
    return responses.select("source", "place", request.alias("request"), F.struct("status", no_headers.alias("headers"), content.alias("content")).alias("response"))


# ---------------------------------------------------------------- what an archive says about itself


def described(spark: SparkSession, path: str) -> DataFrame:
    """(source, name, line, text) of the members that describe archives: whole, or by lines where they are lists of pages or indexes. Lines are read one by one."""

    def members(z: zipfile.ZipFile) -> Iterator[tuple[str, int, str]]:
        for info in z.infolist():
            name = info.filename
            if name in (PACKAGE, DIGEST):
                yield name, 0, z.read(info).decode("utf-8", "replace")
            elif name == PAGES or re.fullmatch(r"indexes/.+\.cdxj?(\.gz)?", name):
                with z.open(info) as raw:
                    try:
                        for k, line in enumerate(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw):
                            yield name, k, line.decode("utf-8", "replace").strip()
                    except (OSError, EOFError):
                        continue  # a packed index that breaks off gives the lines before that

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as file, zipfile.ZipFile(file) as z:
                    rows = []
                    for row in members(z):
                        rows.append((path, *row))
                        if len(rows) == 4096:
                            yield made(rows)
                            rows = []
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["source", "name", "line", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(path).select("path")  # the content is not read
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(tasks).mapInArrow(work, "source string, name string, line long, text string")


def packages(members: DataFrame) -> DataFrame:
    """A row an archive that has a description or a digest: title, created, modified, wacz_version, software, n_resources, datapackage_hash, signature, and hash_ok: whether the digest is that of the description (null without one of the two). Members that are no JSON count as absent."""
    package = F.from_json("text", "title string, created string, modified string, wacz_version string, software string, resources array<struct<path: string, hash: string, bytes: long>>")
    digest = F.from_json("text", "hash string, signedData struct<hash: string, signature: string, publicKey: string, created: string, software: string>")
    readable = F.try_parse_json("text").isNotNull()
    first = lambda name, c: F.first(F.when((F.col("name") == name) & readable, c), ignorenulls=True)
    rows = members.where(F.col("name").isin(PACKAGE, DIGEST)).groupBy("source").agg(first(PACKAGE, package).alias("p"), first(PACKAGE, F.sha2("text", 256)).alias("own"), first(DIGEST, digest).alias("d"))
    signed = F.col("d.signedData")
    signature = F.when(signed.isNotNull(), F.struct(signed["hash"].alias("hash"), signed["signature"].alias("signature"), signed["publicKey"].alias("public_key"), signed["created"].alias("created"), signed["software"].alias("software")))
    return rows.select("source", "p.title", "p.created", "p.modified", "p.wacz_version", "p.software", F.coalesce(F.size("p.resources"), F.lit(0)).alias("n_resources"), F.col("d.hash").alias("datapackage_hash"), signature.alias("signature"), (F.split_part("d.hash", F.lit(":"), F.lit(-1)) == F.col("own")).alias("hash_ok"))


def visited_pages(members: DataFrame) -> DataFrame:
    """(source, line, url, title, ts, id, size, favicon_url, text_excerpt) of the pages that archives list; the text's first 500 characters. The list's head and lines that are no JSON object are left out."""
    page = F.from_json("text", "format string, url string, title string, ts string, id string, size long, favIconUrl string, text string")
    rows = members.where((F.col("name") == PAGES) & F.col("text").startswith("{") & F.try_parse_json("text").isNotNull()).select("source", "line", page.alias("p"))
    kept = rows.where(F.coalesce(F.col("p.format") != "json-pages-1.0", F.lit(True)))
    return kept.select("source", "line", "p.url", "p.title", "p.ts", "p.id", "p.size", F.col("p.favIconUrl").alias("favicon_url"), F.substring(F.coalesce("p.text", F.lit("")), 1, 500).alias("text_excerpt"))


def index_lines(members: DataFrame) -> DataFrame:
    """(archive, url, mime, at) of the archives' own indexes, as operators.integrity's statistics take them. Lines that start with ! or have no JSON in the third place are left out; where an archive has its index packed and plain, the packed one counts."""
    rows = members.where(F.col("name").startswith("indexes/") & ~F.col("text").startswith("!"))
    chosen = rows.groupBy("source").agg(F.max("name").alias("name"))
    parts = F.split("text", r"\s", 3)
    info = F.from_json(F.get(parts, F.lit(2)), "url string, mime string")
    held = rows.join(chosen, ["source", "name"], "left_semi").select(F.col("source").alias("archive"), info.alias("i"), F.get(parts, F.lit(1)).alias("at"), F.try_parse_json(F.get(parts, F.lit(2))).isNotNull().alias("ok"))
    return held.where("ok").select("archive", "i.url", "i.mime", "at")
