import corpus_pipeline as c
from strataloom.llm import language_id, mixing
from strataloom.llm.common import staged
from tests.compare import connect, same
from tests.llm.helpers import line_dedup, near_groups

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    docs = staged(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert [n for n, _ in c.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    columns = docs.columns
    known = staged(c.known_language(spark, docs, FOLDER))
    scored = language_id.identify(docs, language_id.fit(docs)).collect()
    wanted = {r["doc_id"] for r in scored if r["lang_pred"] != "und" and r["score"] >= c.LEAST_SCORE}
    assert known.columns == columns and {r["doc_id"] for r in known.collect()} == wanted
    lines = staged(c.distinct_lines(spark, known, FOLDER))
    assert lines.columns == columns and set(pairs(lines)) == {(i, t) for i, _, _, t in line_dedup(pairs(known))}
    single = staged(c.one_of_each_group(spark, lines, FOLDER))
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == {i for i, (_, m) in near_groups(pairs(lines), 5).items() if i == m}
    mixed = staged(c.mixed(spark, single, FOLDER))
    con = connect(FOLDER)
    con.execute("DROP VIEW documents")
    con.register("documents", single.toPandas())
    same(mixing.mix(single).selectExpr("doc_id", "source", "lang", "topic", "tokens", "round(probability, 6) AS probability", "kept"), con, mixing.op2_sql())
    assert mixed.columns == columns and mixed.count() < single.count()
    last = c.tokens(spark, mixed, FOLDER)
    assert last.count() == mixed.count() and all(r["n_tokens"] == len(r["ids"]) for r in last.collect())


def test_language_stage_keeps_only_known_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(90001, "123 456 !!", "en", "s", 10), (90002, None, "en", "s", 0)], docs.schema)
    assert not {90001, 90002} & {r["doc_id"] for r in c.known_language(spark, docs.unionByName(odd), FOLDER).collect()}
