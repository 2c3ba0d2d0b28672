import random

import pytest

from strataloom.llm import line_dedup
from tests.llm.helpers import AWKWARD, frame, line_dedup as brute


def found(df):
    return {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_against_brute_force(spark, batches):
    rng = random.Random(batches)
    lines = [f"line number {i} {'x' * rng.randrange(9)}" for i in range(12)] + ["short", "", "  LINE number 1 ", "Ünïcöde lines stay"]
    docs = [(i * 3, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    assert found(line_dedup.dedup_lines(frame(spark, docs), batches=batches)) == brute(docs)


def test_awkward_rows(spark):
    assert found(line_dedup.dedup_lines(frame(spark, AWKWARD))) == brute(AWKWARD)
    assert line_dedup.dedup_lines(frame(spark, AWKWARD).limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = [(None, "a line that repeats"), (5, "a line that repeats"), (7, "a line that repeats"), (5, "a line that repeats")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(frame(spark, docs)).collect())
    assert got == [(0, "a line that repeats"), (5, "a line that repeats"), (5, "a line that repeats"), (7, "")]


def test_all_columns_stay(spark):
    docs = frame(spark, AWKWARD)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    row = out.where("doc_id = 9").first()
    assert (row["text"], row["n_chars"], row["key"], row["n"]) == ("other line here", 15, "x", 1)


def test_levels_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(4):
        runs.add(frame(spark, [(k, f"a line of batch {k}\nthe common line")]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    rows = runs.tables()[0].collect()
    assert len(rows) == 5 and sorted(r["doc_id"] for r in rows) == [0, 0, 1, 2, 3]


def test_many_lost_lines_are_looked_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 3)
    shared = [f"a line that is shared, number {i}" for i in range(40)]
    docs = [(1, "\n".join(shared)), (2, "\n".join(shared[::2] + ["a line of its own"] + shared[::-1])), (3, "short\n\n" + shared[7])]
    assert found(line_dedup.dedup_lines(frame(spark, docs))) == brute(docs)
