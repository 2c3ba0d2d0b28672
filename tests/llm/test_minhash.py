import random

import numpy as np

from strataloom.llm import minhash
from tests.llm.helpers import AWKWARD, frame, near_groups


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def wanted(docs, size):
    return {i: (n, c, i == c) for i, (n, c) in near_groups(docs, size).items()}


def test_hot_group_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base, docs = [rng.choice(vocabulary) for _ in range(120)], []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, " ".join(words)))
    docs += [(200 + i, docs[3][1]) for i in range(5)] + [(300 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(20)]
    docs += [(400, "a b"), (401, "A  b"), (402, "a b c")]
    assert found(minhash.near_duplicates(frame(spark, docs), words=4)) == wanted(docs, 4)


def test_awkward_rows(spark):
    assert found(minhash.near_duplicates(frame(spark, AWKWARD))) == wanted(AWKWARD, 5)
    assert minhash.near_duplicates(frame(spark, AWKWARD).limit(0)).count() == 0
    twice = minhash.near_duplicates(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in twice) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_signatures_estimate_similarity():
    c, rng = minhash.Circulant(), np.random.default_rng(0)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        y = np.concatenate([x[:270], rng.integers(0, 2**63, 30).astype(np.uint64)])
        errors.append((c.signature(x) == c.signature(y)).mean() - 270 / 330)
    assert abs(np.mean(errors)) < 0.03


def test_a_passage_that_many_texts_share(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)  # so that buckets count as large
    monkeypatch.setattr(minhash, "CELL", 300)  # and families fill several cells
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    licence, docs = words(60), []
    for i in range(40):
        own = words(rng.choice((4, 8, 12, 16, 30)))
        docs.append((i, " ".join(own + licence)))
        if i % 4 == 0:
            changed = own[:-1] + words(1)
            docs.append((100 + i, " ".join(changed + licence)))
    got = found(minhash.near_duplicates(frame(spark, docs), words=4))
    assert got == wanted(docs, 4) and len({c for _, c, _ in got.values()}) > 10


def test_rare_shingles_meet(spark):
    rng = random.Random(6)
    sets = [(i, sorted(rng.sample(range(60), 20))) for i in range(30)]
    sets += [(100 + i, sorted(set(s[1:]) | {70 + i})) for i, s in sets[:10]]
    df = spark.createDataFrame([(i, len(s), s, i % 3 == 0) for i, s in sets], "id long, n long, shingles array<long>, ask boolean")
    rare = {i: set() for i, _ in sets}
    for r in minhash.rare_shingles(df, 80).collect():
        rare[r["id"]].add(r["key"])
    met = 0
    for i, a in sets:
        for j, b in sets:
            common = len(set(a) & set(b))
            if i < j and (i % 3 == 0 or j % 3 == 0) and 100 * common >= 80 * (len(a) + len(b) - common):
                assert rare[i] & rare[j]
                met += 1
    assert met and all(len(v) == 5 for i, v in rare.items() if i < 100 and i % 3 == 0)


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(7)
    sets = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    dropped = 0
    for n in (1, 5, 63, 64, 65, 130, 1000, 5000):
        for share in (0.3, 0.6, 0.7, 0.79, 0.8, 0.85, 1.0):
            for more in (0, n // 10, n // 5):
                x = sets(n)
                y = np.unique(np.concatenate([x[: max(1, int(len(x) * share))], sets(more)]))
                pack = lambda s: np.frombuffer(minhash.odd_sketch(s), np.uint8)
                same = minhash.similar(len(x), x, len(y), y, 80)
                assert same == (100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))) == minhash.similar(len(y), y, len(x), x, 80)
                maybe = minhash.may_be_similar(len(x), pack(x), len(y), pack(y), 80)
                assert maybe or not same
                assert maybe == minhash.may_be_similar(len(y), pack(y), len(x), pack(x), 80)
                dropped += not maybe
                if n >= 130 and share <= 0.7:
                    assert not maybe
    assert dropped > 40


def test_only_pairs_that_may_be_similar_have_their_sets_sent(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared, docs = words(150), []
    for i in range(40):
        docs.append((i, " ".join(words(50) + shared)))  # share bands with one another, but are not similar
    for i in range(3):
        docs.append((100 + i, docs[i][1] + f" end{i}"))
    asked, made = [], minhash.shingle_sets
    monkeypatch.setattr(minhash, "shingle_sets", lambda d, wanted, n: (asked.append({r["id"] for r in wanted.collect()}), made(d, wanted, n))[1])
    assert found(minhash.near_duplicates(frame(spark, docs), words=4)) == wanted(docs, 4)
    assert asked[0] == {0, 1, 2, 100, 101, 102}


def test_pairs_of_one_document_meet_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 4)
    sets = {i: list(range(i % 3, 40)) + list(range(100 * i, 100 * i + i % 20)) for i in range(1, 61)}
    values = spark.createDataFrame([(i, len(s), s) for i, s in sets.items()], "id long, n long, shingles array<long>")
    every = [(a, b) for a in (1, 2, 7) for b in range(a + 1, 61)]
    got = minhash.passing(spark.createDataFrame(every, "a long, b long"), values, "shingles", minhash.similar, 80).collect()
    good = {(a, b) for a, b in every if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert sorted(map(tuple, got)) == sorted(good) and 0 < len(good) < len(every)
