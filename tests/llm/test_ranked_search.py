"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import ranked_search as R
from tests.llm.helpers import AWKWARD, frame, lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(map(lower, TERM.findall(text or "")))


def plain(docs, queries, top=10):
    """(query, rank, doc_id, score) over (doc_id, text); a repeated id is a document of its own."""
    counts = [(i, terms(t)) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for query, text in queries:
        scores = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total if total else 0
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in terms(text).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(query, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out)


def run(spark, docs, queries, **more):
    sizes = {k: more.pop(k) for k in ("shard_bytes", "shard_docs") if k in more}
    index = R.built(frame(spark, docs).repartition(3), **sizes)
    return sorted(map(tuple, R.search(index, spark.createDataFrame(queries, "query long, text string"), **more).collect()))


def corpus():
    rng = random.Random(5)
    words = [f"t{min(int(rng.expovariate(0.1)), 60)}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    docs += [(500 + i, "exactly the same text t1 t40") for i in range(25)] + [(900 + i, t) for i, t in AWKWARD]
    queries = [(1, "t1 t2 t3 t50"), (2, "T40 t40, same-text t59"), (3, None), (4, ""), (5, "absent"), (6, "one Ünïcödé 🙂 日本語"), (7, " ".join(f"t{i}" for i in range(60)))]
    return docs, queries


def test_against_a_plain_version(spark):
    docs, queries = corpus()
    assert run(spark, docs, queries) == plain(docs, queries)


def test_small_shards_and_blocks_of_queries(spark):
    docs, queries = corpus()
    wanted = plain(docs, queries, 4)
    assert run(spark, docs, queries, shard_bytes=400, shard_docs=7, query_bytes=40, top=4) == wanted


def test_repeated_missing_and_no_rows(spark):
    docs = [(1, "x y"), (1, "x y"), (None, "x y"), (2, "z"), (0, "x")]
    queries = [(1, "x"), (2, "z z")]
    assert run(spark, docs, queries) == plain(docs, queries)
    assert run(spark, [], queries) == [] and run(spark, docs, []) == []
    assert run(spark, [(1, None)], queries) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_variable_length_bytes(values):
    data, sizes = R.vbytes(np.array(values, np.int64))
    assert R.from_vbytes(data).tolist() == values and sizes.sum() == len(data)


def test_postings_there_and_back():
    lists = [([0, 1, 7], [1, 2, 1]), ([3], [900]), ([2, 5000], [1, 1])]
    docs, counts = (np.array([x for pair in lists for x in pair[k]]) for k in (0, 1))
    starts = np.array([0, 3, 4])
    data, begins = R.packed_postings(docs, counts, starts)
    ends = [*begins[1:], len(data)]
    for (d, c), a, b in zip(lists, begins, ends, strict=True):
        got = R.postings(data[a:b].tobytes(), len(d))
        assert (got[0].tolist(), got[1].tolist()) == (d, c)


def test_merge_visits_documents_in_order_and_keeps_the_best():
    rng = random.Random(9)
    documents = R.Documents(np.arange(0, 4000, 2), np.zeros(2000, bool), np.full(2000, 800))
    lists, scores = [], Counter()
    for size, weight in ((3, 900), (400, 20), (1500, 1), (0, 5), (50, 0)):
        docs = np.array(sorted(rng.sample(range(2000), size)), np.int64)
        shares = np.array([rng.randrange(1, 9) for _ in docs], np.int64)
        lists.append((docs, shares, weight))
        for d, s in zip(docs.tolist(), shares.tolist(), strict=True):
            scores[2 * d] += s * weight
    wanted = sorted(((s, -d) for d, s in scores.items() if s), reverse=True)[:10]
    for window in (1, 16, 5000):
        best = R.Best(10)
        R.merged(lists, documents, best, window)
        assert [(s, d) for s, _, d in sorted(best.heap, reverse=True)] == wanted
