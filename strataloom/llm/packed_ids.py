"""Token ids in fixed-width bit-packed files: each id takes the fewest bits that hold every id of the vocabulary.

A folder holds shards and a manifest. A shard is a run of documents in ascending order of doc_id: blocks of
BLOCK ids, packed most significant bit first, then the byte offset of every block, the documents' ids and
where each starts, and a footer. Any span of ids is read by its blocks alone and unpacked by numpy. The
manifest names the shards that were committed, in order, with the number of ids before each; files of
failed or repeated task attempts are not in it.

The folder is a Spark data source, "packed_ids", for writing (doc_id, ids), or texts that it encodes, and for reading.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strataloom.llm.common import shared_dir

#: Ids of a block, a multiple of 8 so that blocks end at whole bytes; ids that a reading task takes, and those it unpacks at once.
BLOCK, TASK_IDS, READ_IDS = 1 << 16, 1 << 24, 1 << 20
MAGIC, VERSION, HEADER, FOOTER = b"PKID", 1, struct.Struct("<4sHHI"), struct.Struct("<QQQQQ4s")
#: Bytes of text encoded at once; pieces of words whose ids a worker remembers before it starts afresh.
PIECE, MEMORY = 1 << 23, 1_000_000
#: The id that ends every document.
END = 1


# ---------------------------------------------------------------- bits


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary of that many."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, most significant first; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4")[:, 0].astype(np.uint32)


# ---------------------------------------------------------------- files


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path.removeprefix("file:")


class ShardWriter:
    """Documents into one shard, in the order in which they come; at most one block of ids is held back."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.at, self.n_ids, self.held = HEADER.size, 0, np.empty(0, np.uint32)
        self.offsets, self.starts, self.docs, self.nulls = [], [], [], []
        out.write(HEADER.pack(MAGIC, VERSION, bits, block))

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and the ids of all of them."""
        self.docs.append(docs.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.starts.append((self.n_ids + np.cumsum(counts) - counts).astype("<u8"))
        self.n_ids += len(ids)
        ids = np.concatenate([self.held, ids])
        whole = len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            self._block(ids[at : at + self.block])
        self.held = ids[whole:]

    def close(self) -> dict:
        """What the manifest says of the shard."""
        if len(self.held):
            self._block(self.held)
        docs, nulls, starts = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((self.docs, "<i8"), (self.nulls, np.uint8), (self.starts, "<u8")))
        tail = [np.array([*self.offsets, self.at], "<u8").tobytes(), docs.tobytes(), nulls.tobytes(), starts.tobytes()]
        ends = self.at + np.cumsum([0, *map(len, tail)])
        for x in tail:
            self.out.write(x)
        self.out.write(FOOTER.pack(int(ends[0]), int(ends[1]), len(docs), self.n_ids, len(self.offsets), MAGIC))
        known = docs[nulls == 0]
        return {"n_docs": len(docs), "n_ids": self.n_ids, "first": int(known.min()) if len(known) else None, "last": int(known.max()) if len(known) else None, "nulls": int(nulls.sum())}


class Shard:
    """Random access to one shard: only the footer, the offsets and the wanted blocks are read."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        magic, version, self.bits, self.block = HEADER.unpack(self._read(0, HEADER.size))
        offsets_at, docs_at, n_docs, self.n_ids, n_blocks, end = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a shard of packed ids")
        self.offsets = np.frombuffer(self._read(offsets_at, 8 * (n_blocks + 1)), "<u8").astype(np.int64)
        index = self._read(docs_at, 17 * n_docs)
        self.docs = np.frombuffer(index, "<i8", n_docs)
        self.nulls = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.starts = np.append(np.frombuffer(index, "<u8", n_docs, 9 * n_docs).astype(np.int64), self.n_ids)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, counted from the shard's first."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self._read(self.offsets[first], self.offsets[last + 1] - self.offsets[first])
        at = first * self.block
        return unpack(data, self.bits, min((last + 1) * self.block, self.n_ids) - at)[start - at : stop - at]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# ---------------------------------------------------------------- the data source


@dataclass
class Written(WriterCommitMessage):
    place: int
    shard: dict


@dataclass
class Span(InputPartition):
    """The documents of a shard that start at ids lo to hi."""

    file: str
    base: int
    lo: int
    hi: int


def given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, numbers of ids, ids of all) of rows (doc_id, ids); null lists count as empty."""
    for batch in batches:
        ids = batch.column("ids")
        yield batch.column("doc_id"), np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64), np.asarray(ids.flatten(), np.int64)


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.bits, self.overwrite = options["path"], int(options["bits"]), overwrite
        self.vocabulary, self.end = options.get("vocabulary"), int(options["end"]) if "end" in options else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, name = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}.ids"
        files, folder = filesystem(self.path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{name}") as out:
            shard = ShardWriter(out, self.bits)
            rows = encoded_batches(iterator, words_of_worker(self.vocabulary, 2 if self.bits <= 16 else 4), self.end) if self.vocabulary else given(iterator)
            for docs, counts, ids in rows:
                shard.add(np.asarray(pc.fill_null(docs, 0), np.int64), np.asarray(pc.is_null(docs)), counts, ids.astype(np.uint32))
            about = shard.close()
        return Written(place, about | {"file": name})

    def commit(self, messages) -> None:
        files, folder = filesystem(self.path)
        files.create_dir(folder, recursive=True)
        old = [] if self.overwrite else manifest(self.path)["shards"]
        new = [m.shard for m in sorted((m for m in messages if m), key=lambda m: m.place) if m.shard["n_docs"]]
        temporary = f"{folder}/manifest-{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(temporary) as out:
            out.write(json.dumps({"bits": self.bits, "shards": old + new}).encode())
        files.move(temporary, f"{folder}/manifest.json")

    def abort(self, messages) -> None:
        """Shards that no manifest names are no part of the folder."""


def manifest(path: str) -> dict:
    files, folder = filesystem(path)
    try:
        with files.open_input_stream(f"{folder}/manifest.json") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {"bits": 0, "shards": []}


class PackedReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns
        asked = options.get("doc_ids")
        self.asked = None if asked is None else np.array(json.loads(asked), np.int64)

    def partitions(self) -> list[Span]:
        spans, base = [], 0
        for shard in manifest(self.path)["shards"]:
            holds = self.asked is None or shard["first"] is not None and bool(((self.asked >= shard["first"]) & (self.asked <= shard["last"])).any())
            # a document without ids may start where the shard ends
            spans += [Span(shard["file"], base, lo, min(lo + TASK_IDS, shard["n_ids"] + 1)) for lo in range(0, shard["n_ids"] + 1, TASK_IDS) if holds]
            base += shard["n_ids"]
        return spans

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:
            return
        files, folder = filesystem(self.path)
        with files.open_input_file(f"{folder}/{span.file}") as f:
            shard = Shard(f)
            first, last = np.searchsorted(shard.starts[:-1], [span.lo, span.hi])
            places = np.arange(first, last)
            if self.asked is not None:
                places = places[np.isin(shard.docs[places], self.asked) & ~shard.nulls[places]]
            for part in self.runs(shard, places):
                yield self.batch(shard, part, span.base)

    def runs(self, shard: Shard, places: np.ndarray) -> Iterator[np.ndarray]:
        """Neighbours of at most READ_IDS ids, or one document."""
        at = 0
        while at < len(places):
            limit = shard.starts[places[at]] + READ_IDS
            end = max(at + 1, int(np.searchsorted(shard.starts[places + 1], limit, "right")))
            gaps = np.flatnonzero(np.diff(places[at:end]) > 1)
            end = at + int(gaps[0]) + 1 if len(gaps) else end
            yield places[at:end]
            at = end

    def batch(self, shard: Shard, part: np.ndarray, base: int) -> pa.RecordBatch:
        starts, stops = shard.starts[part], shard.starts[part + 1]
        made = {
            "doc_id": lambda: pa.array(shard.docs[part], pa.int64(), mask=shard.nulls[part]),
            "start": lambda: pa.array(starts + base, pa.int64()),
            "n_tokens": lambda: pa.array(stops - starts, pa.int64()),
        }
        if {"ids", "ids_crc32"} & set(self.columns):
            ids = shard.ids(int(starts[0]), int(stops[-1]))
            bounds = np.append(starts - starts[0], stops[-1] - starts[0])
            raw = memoryview(ids.astype("<u4").tobytes())
            made["ids"] = lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
            made["ids_crc32"] = lambda: pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)


class PackedIds(DataSource):
    """spark.read.format("packed_ids").load(folder): doc_id, start (ids of all documents before it), n_tokens, ids; a schema that is asked for may also have ids_crc32. Columns that are not in the schema are not made; without ids and ids_crc32 no block is read. Option doc_ids (a JSON list): only these documents, from the blocks that hold them.

    df.write.format("packed_ids").option("bits", b).mode("append" or "overwrite").save(folder): doc_id long and ids array<int>; or, with option vocabulary (a file of the tokenizers library) and,
    where wanted, end (an id), doc_id long and text, which the writing task encodes. Documents stand in the order of partitions and of the rows within them.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids array<int>"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options, overwrite)


# ---------------------------------------------------------------- encoding


#: What fast splitting stands for, as the vocabulary's file has it. Fixed values.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters only are composed already, hold no white space, and change case letter by letter.
LATIN = regex.compile(r"[\x21-\x7e\xa1-\xff]+")
#: Marks that often stand behind a word; a run of them is a piece of its own.
MARKS = ".,;:!?"


class WordIds:
    """The ids of texts by their words, the parts between blanks and line feeds.

    Where the tokenizer drops white space, no token reaches over a blank, so a text's ids are its words' ids. A word of LATIN is cut by the tokenizer's own pattern
    into pieces, whose ids the library's model gives; most words are letters and a mark or two behind them, which needs no pattern. The library takes other words whole. Up to MEMORY pieces are remembered.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.library, self.kind, self.code = Tokenizer.from_file(path), f"<u{width}", "H" if width == 2 else "I"
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        steps = (about["normalizer"] or {}).get("normalizers")
        cut, *rest = (about["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.added = [x["content"] for x in about["added_tokens"]]
        self.by_word = (
            steps == NORMALIZERS
            and (cut.get("type"), cut.get("pattern"), cut.get("behavior"), cut.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
            and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
            and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or set(" \n") & set(x["content"]) or x["content"].rstrip(MARKS).isalpha() for x in about["added_tokens"])
        )
        self.split, self.model = regex.compile(SPLIT).findall, self.library.model
        self.letters = byte_alphabet()
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            spelt = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            found = self.pieces[piece] = array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return found

    def word(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or LATIN.fullmatch(core)):
            found = self.piece(core.lower())
            return found if len(core) == len(word) else found + self.piece(word[len(core) :])
        if not word:
            return b""
        if LATIN.fullmatch(word) and not any(x in word for x in self.added):
            return b"".join(map(self.piece, self.split(word.lower())))
        return self.whole(word)

    def encoded(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, each with `end` behind it, and the offsets at which the texts start and end."""
        last = b"" if end is None else array(self.code, [end]).tobytes()
        width = int(self.kind[2])
        if not self.by_word:
            parts = [self.whole(t) + last for t in texts.to_pylist()]
            return np.frombuffer(b"".join(parts), self.kind), np.cumsum([0, *map(len, parts)]) // width
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        known = [*map(self.word, coded.dictionary.to_pylist()), last]
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // width
        pool, first = np.frombuffer(b"".join(known), self.kind), (np.cumsum(sizes) - sizes).astype(np.int32)
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        codes = np.insert(np.asarray(coded.indices), ends, len(known) - 1)  # the end id stands as a word behind each text
        each = sizes[codes]
        to = np.cumsum(each, dtype=np.int64)
        ids = pool[np.repeat(first[codes] - (to - each).astype(np.int32), each) + np.arange(to[-1] if len(to) else 0, dtype=np.int32)]
        return ids, np.concatenate([[0], to[ends + np.arange(len(ends))]]) if len(ends) else np.zeros(1, np.int64)


def byte_alphabet() -> dict[int, str]:
    """The letters that stand for bytes: printable Latin-1 bytes for themselves, the rest from U+0100 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(1)
def words_of_worker(path: str, width: int) -> WordIds:
    """Kept as long as the Python worker lives, so tasks that follow one another share it."""
    return WordIds(path, width)


def cut_text(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of at least `size` characters that end before a blank or line feed."""
    at = 0
    while len(text) - at > size:
        ends = [e for e in (text.find(" ", at + size), text.find("\n", at + size)) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    return 1 + max(*about["model"]["vocab"].values(), *(x["id"] for x in about["added_tokens"]))


def encoded_batches(batches: Iterator[pa.RecordBatch], words: WordIds, end: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, numbers of ids, ids of all) of rows (doc_id, text), some PIECE bytes of text at once: the ids of each whole text without added special tokens, and `end`. Null texts count as empty."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = batch.num_rows - at
            while take > 1 and batch.slice(at, take).nbytes > PIECE:
                take = (take + 1) // 2
            docs, texts = (batch.column(c).slice(at, take) for c in ("doc_id", "text"))
            at += take
            texts = pc.fill_null(texts, "")
            if take == 1 and words.by_word:
                *parts, tail = cut_text(texts[0].as_py())
                ids = np.concatenate([*(words.encoded(pa.array([p]))[0] for p in parts), words.encoded(pa.array([tail]), end)[0]])
                bounds = np.array([0, len(ids)])
            else:
                ids, bounds = words.encoded(texts, end)
            yield docs, np.diff(bounds), ids


def write_packed(docs: DataFrame, path: str, vocabulary: str, end: int | None = END, mode: str = "overwrite") -> None:
    """The ids of docs (doc_id, text) as packed files in folder `path`, which all executors see, in ascending order of doc_id; rows without an id come last.

    The texts are shuffled once, by range of doc_id; rows that share an id keep their order in docs and may lie in several shards, so
    no id is one task. Null and empty texts hold the end id alone; an empty table gives a folder without shards. Other columns are ignored.
    """
    bits = bits_for(vocabulary_size(vocabulary))
    order = [F.asc_nulls_last("doc_id"), F.col("_row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    docs.sparkSession.dataSource.register(PackedIds)
    writer = dealt.write.format("packed_ids").option("bits", bits).option("vocabulary", vocabulary).mode(mode)
    (writer if end is None else writer.option("end", end)).save(path)


def read_packed(spark: SparkSession, path: str, columns: str = "doc_id long, start long, n_tokens long, ids array<int>", doc_ids: list[int] | None = None) -> DataFrame:
    """The asked columns of a folder of packed ids, of all documents or of those whose ids are given."""
    spark.dataSource.register(PackedIds)
    reader = spark.read.format("packed_ids").schema(columns)
    return (reader if doc_ids is None else reader.option("doc_ids", json.dumps(doc_ids))).load(path)


def op11_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_packed(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long")
