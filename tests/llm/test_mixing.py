from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataloom.llm import mixing
from tests.llm.helpers import AWKWARD, frame


def raked(cells, targets):
    """Plain iterative proportional fitting over {(source, lang, topic): tokens}."""
    mass = {k: float(v) for k, v in cells.items()}
    for _ in range(200):
        for axis, target in enumerate(targets):
            held = defaultdict(float)
            for k, m in mass.items():
                held[k[axis]] += m
            mass = {k: m * target.get(k[axis], 0) / held[k[axis]] if held[k[axis]] else 0.0 for k, m in mass.items()}
    return mass


CELLS = {("a", "en", "x"): 100, ("a", "de", "x"): 10, ("b", "en", "y"): 900, ("b", "de", "x"): 50, ("c", "en", "x"): 5, ("c", "en", "y"): 0}


def table(spark):
    return spark.createDataFrame([(*k, v) for k, v in CELLS.items()], "source string, lang string, topic string, tokens long")


def test_raking_against_plain_fitting(spark):
    shares = [{"a": 0.4, "b": 0.4, "c": 0.2}, {"en": 0.6, "de": 0.4}, {"x": 0.7, "y": 0.3}]
    targets = {m: spark.createDataFrame([(k, v * 3) for k, v in s.items()] + [("nowhere", 9.0)], f"{m} string, target double") for m, s in zip(mixing.MARGINS, shares, strict=True)}
    got = {(r["source"], r["lang"], r["topic"]): r["mass"] for r in mixing.rake(table(spark), targets, rounds=30).collect()}
    assert got == pytest.approx(raked(CELLS, shares), abs=1e-3)


def test_probabilities_meet_the_fraction(spark):
    cells = table(spark).withColumn("mass", F.col("tokens") * F.when(F.col("source") == "b", 0.1).otherwise(8.0))
    rows = mixing.probabilities(cells, 0.3).collect()
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(0.3 * sum(CELLS.values()))
    assert all(0 <= r["probability"] <= 1 for r in rows) and {r["probability"] for r in rows if r["tokens"] == 0} == {0.3}


def test_awkward_rows(spark):
    docs = frame(spark, AWKWARD + [(None, "text without id")]).withColumn("source", F.when(F.col("doc_id") < 5, F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(AWKWARD) + 1 and {r["source"] for r in rows} == {"", "s"} and {r["lang"] for r in rows} == {""}
    assert {r["doc_id"]: r["tokens"] for r in rows}[7] == 3000
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = sorted(str(r["doc_id"]) for r in rows if r["kept"])
    out = mixing.sampled(docs)
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == kept


def test_contradicting_margins_settle_and_tell_their_error(spark):
    rows = [(i, "a b c d", "en" if s < 2 else "de", f"s{s}") for i in range(40) for s in (0, 0, 1, 2)[i % 4 : i % 4 + 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {
        "source": spark.createDataFrame([("s0", 0.2), ("s1", 0.2), ("s2", 0.6)], "source string, target double"),
        "lang": spark.createDataFrame([("en", 0.7), ("de", 0.3)], "lang string, target double"),
    }
    out = mixing.mix(docs, targets=targets).collect()
    # languages come last, so sources miss their targets by as much as the two disagree: 0.35, 0.35 and 0.3
    assert {round(r["margin_error"], 6) for r in out} == {0.3} and len(out) == 40
    agreed = mixing.mix(docs, targets={"source": targets["source"]}).first()
    assert agreed["margin_error"] < 1e-9


def test_production_rounds_settle(spark):
    shares = [{"a": 0.4, "b": 0.4, "c": 0.2}, {"en": 0.6, "de": 0.4}, {"x": 0.7, "y": 0.3}]
    targets = {m: spark.createDataFrame(list(s.items()), f"{m} string, target double") for m, s in zip(mixing.MARGINS, shares, strict=True)}
    got = {(r["source"], r["lang"], r["topic"]): r["mass"] for r in mixing.rake(table(spark), targets).collect()}
    assert got == pytest.approx(raked(CELLS, shares), abs=1e-3)


def test_own_topics_and_repeated_rows(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, "c"), (None, None)])
    rows = mixing.mix(docs, topic=F.col("key")).collect()
    assert len(rows) == 4 and {r["topic"] for r in rows} == {"x"}
    assert len({r["kept"] for r in rows if r["doc_id"] == 1}) == 1
