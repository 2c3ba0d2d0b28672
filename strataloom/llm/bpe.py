"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words are counted over the whole corpus; the pieces (what the pre-tokenizer's pattern cuts) of the commonest,
LEXICON of them at most, are encoded exactly once and compiled into a minimal acyclic automaton whose shared suffixes
carry number outputs: the sum of the outputs along a piece's path is its ordinal, which addresses its ids.
The automaton is one file that Spark ships to every executor, where workers memory-map it, so its pages are
shared. All of a slice's new pieces walk it together, one byte a step. Pieces it does not hold are merged
exactly by the vocabulary's merge ranks, all of a slice together, one merge of each a step.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid
from array import array
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import rows_of, staged, write_file

#: Words compiled into the lexicon at most, and chunks that a worker remembers.
LEXICON, MEMORY = 65_536, 100_000
#: Longer words are not counted, longer pieces merged with a heap.
LONG = 64
#: More than any rank and place, and bytes of pieces that are merged together at most.
NEVER, TOGETHER = np.int64(2**63 - 1), 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def piece_pattern() -> re.Pattern:
    """The pre-tokenizer's pattern with \\p{L}, \\p{N} and White_Space spelt out as ranges, which the standard module matches fast."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in spans:
            if spans[kind] and spans[kind][-1][1] == c - 1:
                spans[kind][-1][1] = c
            else:
                spans[kind].append([c, c])
    group = lambda kind: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans[kind])
    letters, numbers = group("L"), group("N")
    # White_Space of Unicode, fixed values
    blank = r"\t-\r\x20\x85\xa0  -     　"
    # the vocabulary's own pattern, fixed value
    # letters and numbers are tried before the contractions, which start with neither
    return re.compile(rf" ?[{letters}]+| ?[{numbers}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{blank}{letters}{numbers}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


#: Blanks other than space and line end, and the mark that parts chunks; commas and stops before a blank that do not follow a letter or number.
ODD_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")
ODD_POINT = re.compile(r"[,.](?<![^\W_][,.])[ \n]")


def regular(text: str) -> bool:
    """Whether blanks are single spaces or single line ends between other characters, and commas and stops before them follow a letter or number."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not ODD_BLANK.search(text) and not ODD_POINT.search(text)


class Vocabulary:
    """Ids by token bytes, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in data["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (k, self.ids[raw(a + b)]) for k, (a, b) in enumerate(pairs)}
        self.none = (len(self.ranks), -1)
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        # the pairs in order, so one binary search finds the ranks of many
        pairs = np.array([[a << 32 | b, k, new] for (a, b), (k, new) in sorted(self.ranks.items())], np.int64).reshape(-1, 3)
        self.pairs, self.pair_ranks = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.joined = np.zeros(int(self.pair_ranks.max(initial=-1)) + 1, np.int64)  # the new id by rank
        self.joined[self.pair_ranks] = pairs[:, 2]
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.added.items():
            self.tokens[i] = t.encode()

    def merge(self, piece: bytes) -> list[int]:
        """Exact merges by rank, leftmost first."""
        if len(piece) > LONG:
            return self.merge_long(piece)
        ids, ranks, none = [self.byte_ids[b] for b in piece], self.ranks, self.none
        pairs = [ranks.get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i] = best[1]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = ranks.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = ranks.get((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, which keeps long pieces at n log n."""
        import heapq

        ids = [self.byte_ids[b] for b in piece]
        if len(ids) < 2:
            return ids
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where those that merge gives for each piece start and how many they are."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, lengths, parts, used = np.zeros_like(sizes), np.zeros_like(sizes), [np.empty(0, np.int64)], 0
        least = 1
        for most in (8, 16, 32, LONG):  # pieces of about the same length are done at about the same time
            group = np.flatnonzero((sizes >= least) & (sizes <= most))
            for at in range(0, len(group), TOGETHER // most):
                which = group[at : at + TOGETHER // most]
                flat, found = self.merge_together([pieces[k] for k in which.tolist()])
                starts[which], lengths[which] = used + np.cumsum(found) - found, found
                parts.append(flat)
                used += len(flat)
            least = most + 1
        for k in np.flatnonzero(sizes > LONG).tolist():
            parts.append(np.array(self.merge_long(pieces[k]), np.int64))
            starts[k], lengths[k] = used, len(parts[-1])
            used += len(parts[-1])
        return np.concatenate(parts), starts, lengths

    def merge_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids that merge gives for each piece, flat, and their numbers; each step merges the best pair of every piece. No piece is empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
        # the last place stands beside the ends of all pieces; no pair holds its id
        ids = np.append(np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
        after[starts + sizes - 1] = before[starts] = after[n] = n
        best = self.ranked(ids, after, np.arange(n))
        while True:
            found = np.minimum.reduceat(best, starts)
            found = found[found < NEVER]
            if not len(found):
                break
            i = found & 0xFFFFFFFF
            j = after[i]
            ids[i] = self.joined[found >> 32]
            after[i] = after[j]
            before[after[i]] = i
            alive[j], best[j] = False, NEVER
            best[i] = self.ranked(ids, after, i)
            h = before[i]
            h = h[h < n]
            best[h] = self.ranked(ids, after, h)
        return ids[:n][alive], np.add.reduceat(alive, starts, dtype=np.int64)

    def ranked(self, ids: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place of the pairs that start at places, in one number; NEVER where no merge is."""
        want = ids[at] << 32 | ids[after[at]]
        if not len(self.pairs):
            return np.full(len(at), NEVER)
        k = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[k] == want, self.pair_ranks[k] << 32 | at, NEVER)

    def marked(self, text: str) -> bool:
        """Whether an added token stands in the text."""
        return any(t in text for t in self.added)

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; an added token is a piece of its own."""
        find = piece_pattern().findall
        if not self.marked(text):
            return find(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.added else find(part)
        return out

    def chunks(self, text: str) -> list[str]:
        """The text in parts that the pattern never reaches across: in regular texts words with the space before them, line ends, and commas and stops before blanks; else pieces."""
        if not regular(text) or self.marked(text):
            return self.pieces(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").replace(",\0", "\0,\0").replace(".\0", "\0.\0").split("\0")


# ---------------------------------------------------------------- the lexicon


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic transducer of entries (sorted by bytes, distinct), as the content of one file.

    States are merged bottom-up as their words end (a register of equal right languages), each state counts
    the words below it, and an arc's output is the number of words before it in its state; so a word's
    outputs add up to its ordinal. Layout: sizes, then per state first arc and finality, per arc byte,
    target and output, and the ids by ordinal.
    """
    register: dict[tuple, int] = {}
    done: list[tuple[bool, tuple]] = []
    counts: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(done)
            done.append(key)
            counts.append(int(node[0]) + sum(counts[t] for _, t in node[1]))
        return register[key]

    path_nodes, last = [[False, []]], b""
    for word, _ in entries:
        same = len(os.path.commonprefix([word, last]))
        for depth in range(len(last), same, -1):
            node = path_nodes.pop()
            path_nodes[-1][1].append((last[depth - 1], freeze(node)))
        for _ in word[same:]:
            path_nodes.append([False, []])
        path_nodes[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        node = path_nodes.pop()
        path_nodes[-1][1].append((last[depth - 1], freeze(node)))
    root = freeze(path_nodes[0])
    first, final, label, target, output = [], [], [], [], []
    for is_final, arcs in done:
        first.append(len(label))
        final.append(is_final)
        before = int(is_final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            output.append(before)
            before += counts[t]
    first.append(len(label))
    starts = np.cumsum([0, *(len(i) for _, i in entries)])
    blocks = [first, final, label, target, output, starts, [x for _, i in entries for x in i]]
    head = [root, *map(len, blocks)]
    return b"".join(np.asarray(b, np.int32).tobytes() for b in (head, *blocks))


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, np.int32, "r"))  # plain views of the mapped file, which are cheaper to slice
        self.root, sizes, at = int(data[0]), data[1:8], 8
        parts = []
        for size in sizes:
            parts.append(data[at : at + size])
            at += int(size)
        self.first, self.final, label, self.target, self.output, self.starts, self.ids = parts
        # arcs in order of (state, byte), so one binary search finds the arcs of all walkers
        owner = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        self.arcs = owner << 8 | label

    def ordinals(self, pieces: list[bytes]) -> np.ndarray:
        """The ordinal of each piece, -1 where the lexicon does not hold it; all pieces step together."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        state, total = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            want = state[live] << 8 | flat[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            hit = self.arcs[arc] == want if len(self.arcs) else np.zeros(len(live), bool)
            total[live[~hit]] = -1
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            state[live] = self.target[arc]
            total[live] += self.output[arc]
        ends = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(ends, total, -1)


class Numbers(dict):
    """Numbers from 0 by key, in the order in which keys are first asked for."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


class Encoder:
    """Ids of texts through the lexicon, with exact merges for what it lacks."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        # typed arrays, which numpy reads in place
        self.starts, self.lengths, self.flat = array("q"), array("q"), array("i")

    def learn(self, chunks: list[str]) -> None:
        """Ids of chunks not met before, in order: of their pieces, the lexicon's as it has them, others merged."""
        vocabulary, find = self.vocabulary, piece_pattern().findall
        # letters alone are one piece
        split = [[c] if c.removeprefix(" ").isalpha() or c in vocabulary.added else find(c) for c in chunks]
        counts, place = np.fromiter(map(len, split), np.int64, len(split)), Numbers()
        which = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        raw = [p.encode() for p in place]
        found = self.lexicon.ordinals(raw) if self.lexicon else np.full(len(raw), -1)
        rest = np.flatnonzero(found < 0)
        merged, at, sizes = vocabulary.merge_all([raw[k] for k in rest.tolist()])
        ids, held = (self.lexicon.ids, self.lexicon.starts) if self.lexicon else (np.empty(0, np.int32), np.zeros(1, np.int32))
        starts, lengths = held[found].astype(np.int64), (held[found + 1] - held[found]).astype(np.int64)
        starts[rest], lengths[rest] = len(ids) + at, sizes
        flat = np.concatenate([ids, merged, np.fromiter(vocabulary.added.values(), np.int64, len(vocabulary.added))])
        for k, token in enumerate(vocabulary.added, len(ids) + len(merged)):
            if token in place:
                starts[place[token]], lengths[place[token]] = k, 1
        ends = np.concatenate([[0], np.cumsum(lengths[which])])[np.concatenate([[0], np.cumsum(counts)])]
        self.starts.frombytes((ends[:-1] + len(self.flat)).tobytes())
        self.lengths.frombytes(np.diff(ends).tobytes())
        self.flat.frombytes(gathered(flat, starts[which], lengths[which]).astype(np.int32).tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts. Once MEMORY chunks are known, which the common ones soon are, more are remembered for this call only."""
        split = [self.vocabulary.chunks(t) for t in texts]
        kept, used = len(self.starts), len(self.flat)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.number) > kept:
            self.learn(list(islice(self.number, kept, None)))
        # copies, as the arrays grow and shrink later
        starts, lengths, ids = np.array(self.starts, np.int64), np.array(self.lengths, np.int64), np.array(self.flat, np.int32)
        if len(self.starts) > MEMORY:
            while len(self.number) > kept:
                self.number.popitem()
            del self.starts[kept:], self.lengths[kept:], self.flat[used:]
        flat = gathered(ids, starts[which], lengths[which]) if len(which) else np.empty(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(lengths[which])]) if len(which) else np.zeros(1, np.int64)
        return flat, ends[np.concatenate([[0], np.cumsum(counts)])]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + length], one after another."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return flat[at]


# ---------------------------------------------------------------- Spark


def text_slices(texts: list, most: int = 1 << 20):
    """Spans of texts of about `most` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) of the blank-delimited words of at most LONG characters over all texts, counted with map-side combination."""
    words = docs.select(F.explode(F.split("text", r"\s+")).alias("word")).where((F.col("word") != "") & (F.char_length("word") <= LONG))
    return words.groupBy("word").agg(F.count("*").alias("count"))


def frequent_words(docs: DataFrame, size: int) -> DataFrame:
    """(word) of the words that occur most often and more than once, at most `size`: those from the smallest count on whose words still fit.

    The cut-off comes from a histogram over 16 classes a doubling of the count, a few hundred rows whatever
    the corpus; so no ranking of all words takes place.
    """
    counts = staged(word_counts(docs).where("count > 1").withColumn("class", F.floor(F.log2("count") * 16).cast("int")))
    least, held = None, 0
    for row in counts.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():
        held += row["n"]
        if held > size:
            break
        least = row["class"]
    return counts.where(F.col("class") >= least if least is not None else F.lit(False)).select("word")


@lru_cache(1)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def encoder_of(vocabulary_path: str, lexicon_name: str) -> Encoder:
    return Encoder(vocabulary_of(vocabulary_path), Lexicon(SparkFiles.get(lexicon_name)))


def ship_lexicon(docs: DataFrame, vocabulary_path: str, size: int = LEXICON) -> str:
    """Compile the pieces of the corpus's commonest words into a file in the shared folder and ship it to all executors; returns its name.

    One task compiles at most `size` words of at most LONG characters; the driver holds the compiled file only.
    """

    def build(batches):
        vocabulary, words = vocabulary_of(vocabulary_path), set()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                words.update(p.encode() for p in piece_pattern().findall(" " + word) if p not in vocabulary.added)
        yield pa.RecordBatch.from_arrays([pa.array([compile_lexicon([(w, vocabulary.merge(w)) for w in sorted(words)])], pa.binary())], ["file"])

    rows = frequent_words(docs, size).coalesce(1).mapInArrow(build, "file binary").collect()
    data = max((bytes(r["file"]) for r in rows), key=len, default=compile_lexicon([]))
    path = write_file(docs.sparkSession, data, f"lexicon-{uuid.uuid4().hex}.bin")
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, vocabulary_path: str, lexicon_size: int = LEXICON, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) a row of docs, as the vocabulary's own library encodes whole texts without added special tokens; an added token's text within a text is that token. decoded: also the text that these ids decode to, made by the same worker.

    Null and empty texts have no ids. A null doc_id is carried along, repeated rows are encoded each, an
    empty table gives an empty table, other columns are ignored.
    """
    name = ship_lexicon(docs, vocabulary_path, lexicon_size)

    def work(batches):
        encoder = encoder_of(vocabulary_path, name)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            plain = [t or "" for t in texts.to_pylist()]
            for a, b in text_slices(plain):
                flat, offsets = encoder.encode(plain[a:b])
                columns = [ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
                if decoded:
                    columns.append(pa.array(texts_of(flat, offsets, vocabulary_path), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        encoder.forget()  # the worker may serve other operators next

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def texts_of(flat: np.ndarray, offsets: np.ndarray, vocabulary_path: str) -> list[str]:
    """The texts of flat ids from offset to offset."""
    tokens, starts, lengths = token_bytes(vocabulary_path)
    data = gathered(tokens, starts[flat], lengths[flat]).tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths[flat])])[offsets].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def decode(ids: Column, vocabulary_path: str) -> Column:
    """The text of an array of ids, special tokens included; bytes that are not UTF-8 become U+FFFD. Null ids: null."""

    @F.arrow_udf("string")
    def work(column: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for at in range(0, len(column), 64):
            part = column.slice(at, 64)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(part.value_lengths().fill_null(0)))])
            out += [t if known else None for t, known in zip(texts_of(np.asarray(part.flatten()), offsets, vocabulary_path), part.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.string())

    return work(ids)


@lru_cache(1)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = vocabulary_of(path).tokens
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode's rows with their decoded texts, and more of their columns."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), decoded=True))
