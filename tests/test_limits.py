import threading
import time

import pytest

from strataloom.operators import sinks
from strataloom.operators.limits import OverLimit, limited


def test_a_request_over_its_limit_ends_and_others_finish(spark):
    got = {}
    other = threading.Thread(target=lambda: got.update(other=limited(spark, 60, lambda: spark.range(1000).count())))
    began = time.time()
    other.start()
    with pytest.raises(OverLimit):
        limited(spark, 1.0, lambda: spark.range(0, 20, numPartitions=2).selectExpr("reflect('java.lang.Thread', 'sleep', 1000L + id * 0)").collect())
    other.join()
    assert time.time() - began < 15 and got["other"] == 1000
    assert not spark.sparkContext.getJobTags()


def test_errors_and_results_within_the_limit_are_the_work_s_own(spark):
    assert limited(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        limited(spark, 60, lambda: 1 // 0)


def test_a_store_outlives_a_crash_between_any_two_steps(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    with pytest.raises(KeyError):
        store.load("a")
    store.save(a=spark.range(3))
    (tmp_path / "pointers" / f"{2:012d}").write_text('{"a": "no')  # a pointer whose write did not end
    assert store.load("a").count() == 3
    store.save(a=spark.range(4), b=spark.range(1))
    assert store.load("a").count() == 4 and store.load("b").count() == 1
    late = store._now
    store._now = lambda: (2, {})  # a save that began before the last one
    with pytest.raises(Exception, match="exist"):
        store.save(a=spark.range(9))
    store._now = late
    assert store.load("a").count() == 4
    store.save(b=spark.range(2))
    store.clear(kept=1)
    assert store.load("a").count() == 4 and store.load("b").count() == 2
    assert len(list((tmp_path / "a").glob("*/_SUCCESS"))) == 1 and len(store._pointers()) == 1
