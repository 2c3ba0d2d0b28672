"""MinHash near-dedup with circulant permutations.

Two permutations make all signature coordinates: the first, sigma, scatters shingle hashes over a universe
of 2**20 positions; the second, pi, ranks the positions, and coordinate k takes the smallest rank after pi is
shifted circularly by k. Because the shifts are consecutive, one shingle's K ranks are a run of pi, so a
signature is a minimum over copied runs.

128 coordinates give 32 bands of 4; two sets of similarity 0.8 share no band with probability below 1e-7.
Documents with equal shingle sets collapse into one class first. Buckets of at most SMALL classes yield all
their pairs. A larger bucket yields two links a member: to the bucket's smallest class and to the smallest
of its salted subgroup. Pairs that sketches of n to 2n bits rule out for certain (odd sketches, Mitzenmacher et
al. 2014) are dropped; the others' links are confirmed on full shingle sets and joined into components.

Members that a large bucket leaves in different components are open. Two sets of similarity 0.8 share one of
the rarest fifth of either's shingles, so open members meet again in buckets of these rare shingles: what
they share with very many, such as a licence, brings nobody together. Small rare buckets yield all their pairs of
different components. Where a rare shingle is itself shared by many, its holders form a family; every member
outside its family's commonest component is then compared, on full sets and in cells of bounded size, with
the members whose set's size is near its own, and a cell returns only as many links as join its components.
So no bucket is cut off, and none emits all its pairs. Keys that a large share of all rows hold are joined
without a shuffle by key (operators.skew).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import WordHashes, mixed, rows_of, shingles_of, staged
from strataloom.operators.resolve import components as connected
from strataloom.operators.skew import heavy_hashes, join_values, replicated, salted

PERCENT = 80
COORDINATES, ROWS = 128, 4
UNIVERSE = 1 << 20
#: Classes of a bucket that yields all pairs, and shingles on either side of a cell.
SMALL, CELL = 16, 1 << 18
#: Pairs of one document that meet in one part.
PART = 256
#: Bits of the prefilters that are broadcast: 2**26, that is 8 MB whatever the input; and slots in which shingles are counted.
FILTER_BITS, SLOTS = 26, 1 << 18


class Circulant:
    """Signatures and band keys of shingle sets."""

    def __init__(self, seed: int = 4):
        ranks = np.random.Generator(np.random.PCG64(seed)).permutation(UNIVERSE).astype(np.uint32)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:COORDINATES]]), COORDINATES)
        self.bands = np.arange(COORDINATES // ROWS, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = (mixed(shingles ^ np.uint64(0xA5A5F00DC0FFEE11)) >> np.uint64(44)).astype(np.int64)
        out = np.full(COORDINATES, UNIVERSE, np.uint32)
        for k in range(0, len(at), 2048):
            np.minimum(out, self.runs[at[k : k + 2048]].min(axis=0), out=out)
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, with the band's number mixed in."""
        rows = self.signature(shingles).astype(np.uint64).reshape(-1, ROWS)
        key = mixed(self.bands + np.uint64(1))
        for j in range(ROWS):
            key = mixed(key ^ rows[:, j] * np.uint64(0x9E3779B97F4A7C15))
        return key.view(np.int64)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, odd, keys) a row of docs; set_id is a 128-bit digest of the whole shingle set, odd its sketch."""

    def work(batches):
        import xxhash

        memory, circulant = WordHashes(), Circulant()
        for ids, texts in rows_of(batches, "doc_id", "text"):
            counts, sets, odds, keys = [], [], [], []
            for text in texts:
                s = shingles_of(text.as_py(), words, memory)
                counts.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                odds.append(odd_sketch(s) if len(s) else None)
                keys.append(circulant.keys(s) if len(s) else np.empty(0, np.int64))
            lengths = np.cumsum([0, *map(len, keys)])
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(sets, pa.binary()), pa.array(odds, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)],
                ["doc_id", "n_shingles", "set_id", "odd", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, f"doc_id {kind}, n_shingles long, set_id binary, odd binary, keys array<bigint>")


def bitmap(slots: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits, set at the slots (from 1 on) of a table, packed from the lowest bit on."""
    maps = slots.select(F.bitmap_bucket_number("slot").alias("b"), F.bitmap_bit_position("slot").alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in maps.collect():  # at most 2**26 / 32768 rows of 4 kB
        bits[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(bytes(row["m"]), np.uint8)
    return bits


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, n, shingles) of the documents in wanted (id). A bitmap of fixed size drops most other documents before their shingles are made."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)) + 1  # the bitmap functions count from 1
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(slot.alias("slot"))))

    def work(batches):
        memory = WordHashes()
        for ids, slots, texts in rows_of(batches, "id", "slot", "text"):
            at = np.asarray(slots).astype(np.int64) - 1
            for i in np.flatnonzero(held.value[at // 8] >> (at % 8).astype(np.uint8) & 1):
                s = shingles_of(texts[int(i)].as_py(), words, memory)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(int(i), 1), pa.array([len(s)], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["id", "n", "shingles"]
                )

    kind = wanted.schema["id"].dataType.simpleString()
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    made = source.select("id", slot.alias("slot"), "text").mapInArrow(work, f"id {kind}, n long, shingles array<bigint>")
    return made.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def odd_sketch(shingles: np.ndarray) -> bytes:
    """A bit for each of n to 2n slots (a power of two, 64 at least), set where an odd number of the n shingles falls."""
    slots = 1 << max(6, (len(shingles) - 1).bit_length())
    held = np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(na: int, x: np.ndarray, nb: int, y: np.ndarray, percent: int) -> bool:
    """False where the odd sketches x, y of sets of na and nb shingles rule the asked similarity out, which they never do wrongly.

    A slot where the sketches differ holds a shingle that only one of the sets has, so the sets differ by as many shingles at least.
    Halving a sketch by exclusive or gives the sketch of half as many slots.
    """
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    common = min(na, nb, (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2)
    return 100 * common >= percent * (na + nb - common)


def similar(na: int, x: np.ndarray, nb: int, y: np.ndarray, percent: int) -> bool:
    """Whether the sorted sets x, y have 100 * intersection >= percent * union."""
    common = int((x[np.searchsorted(x, y).clip(max=len(x) - 1)] == y).sum())
    return 100 * common >= percent * (na + nb - common)


def passing(pairs: DataFrame, values: DataFrame, column: str, test: Callable[[int, np.ndarray, int, np.ndarray, int], bool], percent: int) -> DataFrame:
    """The pairs (a, b), a < b, staged, whose values (id, n, `column`) pass the test.

    A value moves once to its id and from there once a pair in which it is b, to the a of the pair. There the rows are sorted, so that a,
    the smallest id, comes first and meets the others as they stream by. An a of many pairs is dealt to parts of about PART pairs.
    An id of several values passes if one of them does.
    """
    sizes = staged(pairs.groupBy("a").agg(F.count("*").alias("size")))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / PART)).alias("part")
    dealt = staged(join_values(pairs, sizes, "a", "size", pairs.count()).select("a", "b", part))
    aims = dealt.select(F.col("a").alias("id"), "a", "part").distinct().unionByName(dealt.select(F.col("b").alias("id"), "a", "part"))
    sent = values.select("id", "n", column).join(aims, "id").repartition("a", "part").sortWithinPartitions("a", "part", "id")

    def work(batches):
        first, heads = None, []
        for firsts, ids, counts, held in rows_of(batches, "a", "id", "n", column):
            out = []
            for a, i, n, value in zip(firsts.to_pylist(), ids.to_pylist(), counts.to_pylist(), held, strict=True):
                own = np.asarray(value.values).view(np.uint64) if pa.types.is_nested(held.type) else np.frombuffer(value.as_buffer(), np.uint8)
                if i == a:
                    first, heads = a, [*(heads if first == a else []), (n, own)]
                elif first == a and any(test(m, head, n, own, percent) for m, head in heads):
                    out.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], firsts.type), pa.array([b for _, b in out], ids.type)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return staged(sent.select("a", "id", "n", column).mapInArrow(work, f"a {kind}, b {kind}").distinct())


def sketches(seen: DataFrame) -> DataFrame:
    """(id, n, odd) of the documents with shingles. Rows that repeat an id and a sketch are one; repeated ids meet in one task, where the join by id finds them too."""
    known = seen.where("doc_id IS NOT NULL AND n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "odd")
    return known.repartition("id").dropDuplicates()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in links (a, b)."""
    return connected(links, staged).withColumnRenamed("component", "component_id")


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (key, id), staged, of keys that several ids share, with their number n and smallest id (leader), staged."""
    sizes = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1"))
    return staged(join_values(rows, sizes, "key", "n", rows.count()))


def first_links(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b, from bucket members (key, id, n, leader)."""
    tight = members.where(F.col("n") <= SMALL)
    pairs = tight.select("key", F.col("id").alias("a")).join(tight.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    wide = members.where(F.col("n") > SMALL).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SMALL)))
    heads = wide.groupBy("key", "part").agg(F.min("id").alias("head"))
    star = wide.select(F.col("leader").alias("a"), F.col("id").alias("b"))
    sub = wide.join(heads, ["key", "part"]).select(F.col("head").alias("a"), F.col("id").alias("b"))
    return pairs.union(star).union(sub).where("a < b").distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (key, id, n, leader) of the large buckets whose members lie in several components, with their component so far (c), staged."""
    wide = members.where(F.col("n") > SMALL).join(labels, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
    several = staged(wide.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("held")).where("x <> y").select("key", "held"))
    return staged(join_values(wide, several, "key", "held", members.count()).drop("held"))


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id): of each set (id, n, shingles, ask), the rarest shingles among all sets, so many that two sets of the asked similarity have one in common; staged. Of sets that do not ask only those that an asking one may have too.

    How rare a shingle is comes from counts of a fixed number of hash slots; any order would do, so slots that
    are shared cost nothing but chance meetings. A set of n shares at least percent * n / 100 shingles with a
    similar one, so n - that many + 1 of its shingles cannot all be missed.
    """
    spark = sets.sparkSession
    slot = F.col("shingle").bitwiseAND(F.lit(SLOTS - 1))
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    rarity = spark.sparkContext.broadcast(often)

    def chosen(ids: pa.Array, lists: pa.Array, bits: np.ndarray | None) -> pa.RecordBatch:
        keys, counts = [], []
        for own in lists:
            s = np.asarray(own.values)
            k = len(s) + 1 + -len(s) * percent // 100
            first = s[np.lexsort((s, rarity.value[s & (SLOTS - 1)]))[:k]]
            if bits is not None:
                at = first & ((1 << FILTER_BITS) - 1)
                first = first[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
            keys.append(first)
            counts.append(len(first))
        owners = ids.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *keys])), owners], ["key", "id"])

    shape = f"key long, id {sets.schema['id'].dataType.simpleString()}"
    asked = staged(sets.where("ask").select("id", "shingles").mapInArrow(lambda batches: (chosen(i, s, None) for i, s in rows_of(batches, "id", "shingles")), shape))
    marks = spark.sparkContext.broadcast(bitmap(asked.select((F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1).alias("slot"))))
    told = sets.where("NOT ask").select("id", "shingles").mapInArrow(lambda batches: (chosen(i, s, marks.value) for i, s in rows_of(batches, "id", "shingles")), shape)
    return staged(asked.unionByName(told))


def families(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, c, family, ask) of the members of large buckets that lie in several components.

    c is a member's component so far. Members that share such a bucket, directly or through others, are one
    family; ask is true for those outside the family's commonest component.
    """
    open_ = open_members(members, labels)
    found = components(open_.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    each = open_.select("id", "c").distinct().join(found, "id", "left").select("id", "c", F.coalesce("component_id", "id").alias("family"))
    counts = each.groupBy("family", "c").count()
    main = counts.groupBy("family").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("size"))
    each, main = staged(each), staged(main)
    return staged(join_values(each, main, "family", "size", each.count()).select("id", "c", "family", (F.col("c") != F.col("main")).alias("ask")))


def family_links(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within families: every asking member against all members whose set may be of similar size, on full shingle sets.

    Members are put in classes of size (k), each percent of the next, so that similar sets are in the same or in
    neighbouring classes. Askers and members meet in cells of about CELL shingles a side, dealt by a hash of
    the id. A cell gives as many links as join the components it holds, not all pairs.
    """
    near = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    weighed = staged(found.join(sets, "id").withColumn("k", near))
    asked = weighed.where("ask").withColumn("k", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    total = lambda d, name: d.groupBy("family", "k").agg(F.sum("n").alias(name))
    grid = total(weighed, "all").join(total(asked, "asked"), ["family", "k"]).select(F.struct("family", "k").alias("g"), F.ceil(F.col("all") / CELL).alias("ys"), F.ceil(F.col("asked") / CELL).alias("xs"))
    # the few groups that need more than one cell are marked by a broadcast; of others there are too many for it, but each is small
    grid = staged(grid.withColumn("size", F.col("xs") * F.col("ys")))
    placed = lambda d: join_values(d.withColumn("g", F.struct("family", "k")), grid, "g", "size", grid.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0])
    columns = ["g", "x", "y", "id", "c", "n", "shingles", "asks"]
    asking = placed(asked).withColumn("x", F.pmod(F.xxhash64("id", F.lit(1)), "xs")).withColumn("y", F.explode(F.expr("sequence(0, ys - 1)"))).withColumn("asks", F.lit(True)).select(columns)
    told = placed(weighed).withColumn("y", F.pmod(F.xxhash64("id", F.lit(2)), "ys")).withColumn("x", F.explode(F.expr("sequence(0, xs - 1)"))).withColumn("asks", F.lit(False)).select(columns)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        q, d = group[group.asks], group[~group.asks]
        out: list[tuple[int, int]] = []
        if len(q) and len(d):
            size, label, ids = d["n"].to_numpy(), d["c"].to_numpy(), d["id"].to_numpy()
            flat = np.concatenate(d["shingles"].to_numpy())
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(d)), size)[order]
            values, starts, counts = np.unique(flat[order], return_index=True, return_counts=True)
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := parent.get(c, c)) != c:
                    parent[c] = c = parent.get(up, up)
                return c

            for i, c, n, own in zip(q["id"], q["c"], q["n"], q["shingles"], strict=True):
                at = np.searchsorted(values, own).clip(max=len(values) - 1)
                at = at[values[at] == own]
                lengths = counts[at]
                ends = np.cumsum(lengths)
                places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - lengths), lengths)
                common = np.bincount(owner[places], minlength=len(d))
                near = np.flatnonzero((100 * common >= percent * (n + size - common)) & (label != c))
                for k in near[np.unique(label[near], return_index=True)[1]]:
                    x, y = root(c), root(int(label[k]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((min(i, ids[k]), max(i, ids[k])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return asking.unionByName(told).groupBy("g", "x", "y").applyInPandas(meet, "a long, b long")


def open_links(members: DataFrame, labels: DataFrame, docs: DataFrame, seen: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links that the stars of large buckets missed; None where no large bucket lies in several components."""
    left = staged(open_members(members, labels).select("id", "c").distinct())
    main = left.groupBy("c").count().orderBy(F.desc("count"), "c").first()
    if main is None:
        return None
    left = left.withColumn("ask", F.col("c") != main["c"])  # of two components one at least is not the commonest
    sets = staged(shingle_sets(docs, left.select("id"), words).join(left, "id"))
    rare = bucketed(rare_shingles(sets, percent))
    sized = rare.where(F.col("n") <= SMALL).select("key", "id").join(sets.select("id", "c", F.col("n").alias("size")), "id")
    other = sized.select("key", F.col("id").alias("b"), F.col("c").alias("d"), F.col("size").alias("m"))
    near = (F.col("size") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("size") * percent)
    pairs = staged(sized.withColumnRenamed("id", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & near).select("a", "b").distinct())
    pairs = passing(pairs, sketches(seen), "odd", may_be_similar, percent)
    links = passing(pairs, sets, "shingles", similar, percent)
    large = families(rare, labels)
    return links if large.isEmpty() else links.union(staged(family_links(large, sets.select("id", "n", "shingles"), percent)))


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (id, component_id) after more links (a, b), staged: the components that these join are searched among one another, not all links anew."""
    named = staged(labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component_id"))))
    end = lambda side: named.select(F.col("id").alias(side), F.col("component_id").alias(f"c{side}"))
    joined = more.join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    above = staged(components(joined)).select(F.col("id").alias("component_id"), F.col("component_id").alias("above"))
    heavy = heavy_hashes(named.groupBy("component_id").agg(F.count("*").alias("size")), "component_id", "size", named.count())
    found = salted(named, heavy, "component_id", F.col("id")).join(replicated(above, heavy, "component_id"), ["component_id", "salt"], "left")
    return staged(found.select("id", F.coalesce("above", "component_id").alias("component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct shingles of `words` words, or the
    whole sequence where it is shorter. Null, empty and blank texts have an empty set and are linked with
    nothing. Rows that repeat a doc_id are one document to the graph; each row is returned. A row with a
    null doc_id is returned with a null component and kept, and links nothing. An empty table gives an empty
    table. doc_id must be of an integer type. Other columns of docs are ignored.
    """
    docs = docs.select("doc_id", "text")
    seen = staged(profiles(docs, words))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = staged(seen.where(linked).groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    members = bucketed(staged(classes.select("id", F.explode("keys").alias("key"))))
    pairs = passing(staged(first_links(members)), sketches(seen), "odd", may_be_similar, percent)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = passing(pairs, shingle_sets(docs, ids, words), "shingles", similar, percent)
    labels = staged(components(links))
    more = open_links(members, labels, docs, seen, words, percent)
    if more is not None:
        labels = relabelled(labels, more)
    found = staged(classes.select("set_id", "id", "copies").join(labels, "id", "left").select("set_id", "copies", F.coalesce("component_id", "id").alias("component_id")))
    rows = seen.select("doc_id", "n_shingles", "set_id")
    several = join_values(rows.where(linked), found, "set_id", "copies", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return several.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's sets are of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
