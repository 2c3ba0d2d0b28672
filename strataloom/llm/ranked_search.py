"""Ranked lexical search, a document at a time over compressed postings.

Documents are cut into shards of bounded size, each made in one task without a shuffle: a header with the shard's document ids and lengths, and
a row a term with its postings, sorted by doc_id and compressed as variable-length gaps and counts. Only the rows of a query's
terms leave the scan. In a shard, a heap holds a cursor for each of a query's terms, keyed by the cursor's next document; the cursors at the
front advance together over a window of documents, whose scores are then whole, so documents are finished in ascending
order. The best k stay in a bounded heap keyed by score, then doc_id. A worker keeps one such heap a query over all its shards, and Spark merges the workers'.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm.common import staged
from strataloom.llm.importance import pieces_of

#: Bytes of text and documents of a shard; documents of a window; results a query.
SHARD_BYTES, SHARD_DOCS, WINDOW, TOP = 1 << 24, 1 << 16, 1 << 12, 10
#: Bytes of query texts taken in one pass over the index.
QUERY_BYTES = 1 << 22
#: Frequency saturation and length normalisation in hundredths, and scale of a term's share. Fixed values.
SCALE, HALF, LENGTH = 1_000_000_000, 8, 75


# ---------------------------------------------------------------- compressed postings


def vbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as variable-length bytes of 7 bits each, low bits first, the high bit set where more follow; and each number's length."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > k
        byte = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - sizes)[has] + k] = byte | (np.uint64(128) * (sizes[has] > k + 1)).astype(np.uint64)
    return out, sizes


def from_vbytes(data: np.ndarray) -> np.ndarray:
    """The numbers of vbytes."""
    if not len(data):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def packed_postings(docs: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of many terms, each ascending by document from its place in `starts` on, as bytes, and where each term's bytes start. A term has its gaps, doubled, and odd where a document has the term once; then the counts of the other documents."""
    gaps = np.diff(docs, prepend=-1)
    gaps[starts] = docs[starts] + 1
    often = counts > 1
    before = np.cumsum(often) - often  # counts that are written out, of all postings before
    sizes = np.diff(np.append(starts, len(docs)))
    term = np.repeat(np.arange(len(starts)), sizes)
    values = np.empty(len(docs) + int(often.sum()), np.int64)
    values[np.arange(len(docs)) + before[starts][term]] = 2 * gaps + ~often
    values[(starts + sizes)[term[often]] + before[often]] = counts[often]
    data, widths = vbytes(values)
    return data, (np.cumsum(widths) - widths)[starts + before[starts]]


def postings(data: bytes, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of one term, ascending, and how often it is in each."""
    values = from_vbytes(np.frombuffer(data, np.uint8))
    counts = np.ones(n_docs, np.int64)
    counts[values[:n_docs] & 1 == 0] = values[n_docs:]
    return np.cumsum(values[:n_docs] >> 1) - 1, counts


# ---------------------------------------------------------------- index


class Numbers(dict):
    """Numbers of words, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


@dataclass
class Growing:
    """A shard that is being filled: term numbers of each document's words."""

    numbers: Numbers = field(default_factory=Numbers)
    ids: list = field(default_factory=list)
    nulls: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    words: list = field(default_factory=list)
    size: int = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        length = 0
        for piece in pieces_of(text):
            words = piece.split()
            self.words.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            length += len(words)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(length)
        self.size += len(text)

    def batch(self, shard: int) -> pa.RecordBatch:
        """The header (no term), then a row a term."""
        ids, nulls, lengths = np.array(self.ids, np.int64), np.array(self.nulls, bool), np.array(self.lengths, np.int64)
        order = np.lexsort([ids, nulls])  # by doc_id, those without one last
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        words = np.concatenate(self.words) if self.words else np.empty(0, np.int32)
        keys = np.sort(words.astype(np.int64) << 32 | np.repeat(place, lengths))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] >> 32 != keys[:-1] >> 32])) if len(keys) else np.empty(0, np.int64)
        data, begins = packed_postings(keys & 0xFFFFFFFF, counts, starts) if len(keys) else (np.empty(0, np.uint8), starts)
        header = np.concatenate([ids[order], nulls[order], lengths[order]]).astype("<i8").tobytes()
        bounds = np.concatenate([[0, len(header)], len(header) + begins[1:], [len(header) + len(data)]]) if len(keys) else np.array([0, len(header)])
        values = pa.Array.from_buffers(pa.binary(), len(starts) + 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(header + data.tobytes())])
        frequencies = np.concatenate([[(lengths > 0).sum()], np.diff(np.append(starts, len(keys)))])
        totals = np.concatenate([[lengths.sum()], np.add.reduceat(counts, starts) if len(keys) else starts])
        terms = pa.array([None, *(w.decode("utf-8", "replace") for w in self.numbers)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard), pa.int64()), terms, pa.array(frequencies, pa.int64()), pa.array(totals, pa.int64()), values], INDEX_COLUMNS)


INDEX_COLUMNS = ["shard", "term", "n_docs", "n_occurrences", "postings"]


def built(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of docs (doc_id, text), stored in the shared folder: a header row a shard (term null; n_docs: documents with a term; n_occurrences: of all terms; postings: ids, marks of missing ids and lengths) and a row a term of each shard. No rows are shuffled: a task makes the shards of what it reads."""

    def work(batches):
        growing, n = Growing(), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or b""
                if growing.ids and (growing.size + len(text) > shard_bytes or len(growing.ids) >= shard_docs):
                    yield growing.batch(task + n)
                    growing, n = Growing(), n + 1
                growing.add(doc_id, text)
        if growing.ids:
            yield growing.batch(task + n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return staged(rows.mapInArrow(work, "shard long, term string, n_docs long, n_occurrences long, postings binary"))


# ---------------------------------------------------------------- search


class Best:
    """The k best results: (score, doc_id), larger scores first, then smaller ids; ids that are missing come last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> int:
        """Scores below this can't get in any more."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, missing: bool, doc_id: int) -> None:
        entry = (score, not missing, -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


@dataclass
class Documents:
    """A shard's documents in ascending order of doc_id: ids, which of them are missing, and the length norms of scores."""

    ids: np.ndarray
    missing: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, header: bytes, n_docs: int, n_words: int) -> Documents:
        ids, missing, lengths = np.frombuffer(header, "<i8").reshape(3, -1)
        return cls(ids, missing.astype(bool), HALF * (100 - LENGTH + LENGTH * lengths * n_docs // max(1, n_words)))

    def shares(self, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to the documents' scores."""
        return SCALE * counts // (1000 * counts + self.norms[docs])


def merged(lists: list[tuple[np.ndarray, np.ndarray, int]], documents: Documents, best: Best, window: int = WINDOW) -> None:
    """Offer every document of a query's lists (documents, ascending; shares; weight) to `best`, in ascending order of doc_id.

    The heap names the lists whose next document comes first. They, and all others whose next document lies in the same window of doc places, advance to the
    window's end; what they passed over is added up a document. Windows in which no list has a document are never visited.
    """
    front = [(int(docs[0]), k, 0) for k, (docs, _, weight) in enumerate(lists) if len(docs) and weight]
    heapq.heapify(front)
    while front:
        first = front[0][0]
        end = first + window
        scores = np.zeros(min(window, len(documents.ids) - first), np.int64)
        while front and front[0][0] < end:
            _, k, at = front[0]
            docs, shares, weight = lists[k]
            stop = len(docs) if docs[-1] < end else int(np.searchsorted(docs, end))
            scores[docs[at:stop] - first] += weight * shares[at:stop]  # a document is in a list once
            if stop < len(docs):
                heapq.heapreplace(front, (int(docs[stop]), k, stop))
            else:
                heapq.heappop(front)
        good = np.flatnonzero(scores >= best.least())
        if len(good) > 4 * best.k:  # only the window's own best can stay; all that tie with the last of them are offered
            good = good[scores[good] >= np.partition(scores[good], -best.k)[-best.k]]
        for place in good.tolist():
            score = int(scores[place])
            if score >= best.least():
                best.offer(score, bool(documents.missing[first + place]), int(documents.ids[first + place]))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, n): how often each term is in each query's text, for queries (query, text)."""

    def work(batches):
        for batch in batches:
            rows: list[tuple[int, str, int]] = []
            for query, text in zip(batch.column("query").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts: dict[bytes, int] = {}
                for piece in pieces_of(text or b""):
                    for word in piece.split():
                        counts[word] = counts.get(word, 0) + 1
                rows += [(query, w.decode("utf-8", "replace"), n) for w, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["query", "term", "n"])

    return queries.select("query", F.col("text").cast("binary").alias("text")).mapInArrow(work, "query long, term string, n long")


def weight_of(n_docs: int, frequency: Column) -> Column:
    """A term's weight: a thousand times the logarithm of how rare it is, rounded down."""
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * frequency + 1).cast("double")))


def search(index: DataFrame, queries: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, rank, doc_id, score): the `top` best documents of each query (query long, text) over an index of `built`.

    Queries are taken in blocks of about query_bytes of text, dealt by a hash of `query`: a block's terms and weights go to every worker, so what is sent is bounded whatever
    the number of queries. For each block the index rows of its terms are read, and those of a shard meet in one task; a shard's size is bounded. Queries without a
    term that occurs, null and empty ones give no rows; equal scores rank by doc_id, missing ids last; a repeated document is one of its own, and a repeated query number is one query
    with the texts' terms together. An empty index gives no rows.
    """
    spark = index.sparkSession
    totals = index.where("term IS NULL").agg(F.sum("n_docs").alias("d"), F.sum("n_occurrences").alias("w")).first()
    n_docs, n_words = totals["d"] or 0, totals["w"] or 0
    terms = staged(query_terms(queries))
    blocks = max(1, -(-(queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    found = [search_block(index, terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) if blocks > 1 else terms, n_docs, n_words, top) for b in range(blocks)]
    results = found[0]
    for more in found[1:]:
        results = results.unionByName(more)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tie"))
    return results.withColumn("rank", place).where(F.col("rank") <= top).select("query", "rank", "doc_id", "score")


def search_block(index: DataFrame, terms: DataFrame, n_docs: int, n_words: int, top: int) -> DataFrame:
    """(query, doc_id, score, tie) of the best of each worker's shards."""
    spark = index.sparkSession
    wanted = F.broadcast(terms.select("term").distinct())  # of one block
    rows = index.join(wanted, "term", "left_semi")
    weights = rows.groupBy("term").agg(F.sum("n_docs").alias("df")).select("term", weight_of(n_docs, F.col("df")).alias("weight"))
    asked: dict[int, list[tuple[str, int]]] = {}
    for r in terms.join(weights, "term").select("query", "term", (F.col("n") * F.col("weight")).alias("w")).toLocalIterator():
        asked.setdefault(r["query"], []).append((r["term"], r["w"]))
    if not asked:
        return spark.createDataFrame([], "query long, doc_id long, score long, tie long")
    shipped = spark.sparkContext.broadcast(asked)

    def finished(header, lists, best):
        documents = Documents.of(header, n_docs, n_words)
        decoded = {}
        for term, (data, size) in lists.items():
            docs, counts = postings(data, size)
            decoded[term] = (docs, documents.shares(docs, counts))
        for query, wanted in shipped.value.items():
            own = [(*decoded[t], w) for t, w in wanted if t in decoded]
            if own:
                merged(own, documents, best[query])

    def work(batches):
        best = {query: Best(top) for query in shipped.value}
        shard, header, lists = None, b"", {}
        for batch in batches:
            for number, term, size, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "n_docs", "postings")), strict=True):
                if number != shard:
                    if lists:
                        finished(header, lists, best)
                    shard, header, lists = number, b"", {}
                if term is None:
                    header = data
                else:
                    lists[term] = (data, size)
        if lists:
            finished(header, lists, best)
        out = [(q, None if not known else -doc, score, i) for q, b in best.items() for i, (score, known, doc) in enumerate(sorted(b.heap, reverse=True))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["query", "doc_id", "score", "tie"])

    needed = index.where("term IS NULL").unionByName(rows.select(*INDEX_COLUMNS)).select("shard", "term", "n_docs", "postings")
    return needed.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term")).mapInArrow(work, "query long, doc_id long, score long, tie long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = search(built(docs), items.select(F.col("item_id").alias("query"), "text"))
    return found.select(F.col("query").alias("item_id"), "rank", "doc_id", "score")
