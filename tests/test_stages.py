"""Stages by status: what waits is taken once, failures are set apart and requeued, a crash loses and doubles nothing."""

import pytest
from pyspark.sql import functions as F

from strataloom.streaming.stages import Stage, StageLog, drive


def stages(seen, broken=frozenset(), crash=None):
    """parse and extract over sessions; `crash` names a stage whose batch breaks off."""

    def work(name):
        def run(sessions):
            rows = sessions.select("session", F.concat(F.lit(f"{name} of "), "session").alias("value"))
            seen.append((name, sorted(r["session"] for r in sessions.collect())))
            if crash == name:
                raise RuntimeError("killed")
            bad = F.col("session").isin(*broken) if broken else F.lit(False)
            return rows, sessions.where(bad & F.lit(name == "parse")).select("session", F.lit("no JSON").alias("detail"))

        return run

    return [Stage("parse", "pending", "parsed", "parse_failed", work("parse")), Stage("extract", "parsed", "done", "extract_failed", work("extract"))]


def statuses(log):
    return {r["session"]: r["status"] for r in log.current().collect()}


def sessions(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "session string")


def test_sessions_pass_all_stages_once(spark, tmp_path):
    log, seen = StageLog(spark, str(tmp_path / "log")), []
    assert statuses(log) == {}
    log.enter(sessions(spark, "a", "b", "b", None))
    drive(log, stages(seen, {"b"}))
    assert statuses(log) == {"a": "done", "b": "parse_failed"}
    assert log.current().where("session = 'b'").first()["detail"] == "no JSON"
    log.enter(sessions(spark, "b", "c"))  # b is known
    drive(log, stages(seen, {"b"}))
    assert statuses(log) == {"a": "done", "b": "parse_failed", "c": "done"}
    log.requeue()
    drive(log, stages(seen))
    assert statuses(log) == {"a": "done", "b": "done", "c": "done"}
    assert [s for n, names in seen if n == "extract" for s in names] == ["a", "c", "b"]
    assert sorted((r["session"], r["value"]) for r in log.results("extract").collect()) == [(s, f"extract of {s}") for s in "abc"]


@pytest.mark.parametrize("stage", ["parse", "extract"])
def test_a_run_that_is_killed_resumes_without_doubles(spark, tmp_path, stage):
    log, seen = StageLog(spark, str(tmp_path / "log")), []
    log.enter(sessions(spark, "a", "b"))
    with pytest.raises(Exception, match="killed"):
        drive(log, stages(seen, crash=stage))
    assert set(statuses(log).values()) == {"pending" if stage == "parse" else "parsed"}
    drive(log, stages(seen))
    drive(log, stages(seen))
    assert statuses(log) == {"a": "done", "b": "done"}
    assert log.results("parse").count() == 2 and log.results("extract").count() == 2


def test_a_batch_that_was_finished_is_not_run_again(spark, tmp_path):
    """As if the run was killed after a batch's statuses, before its stream took note of it."""
    import shutil

    log, seen = StageLog(spark, str(tmp_path / "log")), []
    log.enter(sessions(spark, "a"))
    parse, extract = stages(seen)
    log.run(parse)
    shutil.rmtree(tmp_path / "log/checkpoints/parse/commits")
    log.run(parse)
    log.run(extract)
    assert [x for x in seen if x[1]] == [("parse", ["a"]), ("extract", ["a"])] and log.history().count() == 3
    # results of a batch without statuses do not count
    spark.createDataFrame([("a", "half")], "session string, value string").write.parquet(str(tmp_path / "log/results/parse/batch=99"))
    assert [r["value"] for r in log.results("parse").collect()] == ["parse of a"]
