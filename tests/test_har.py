"""HAR files by byte ranges: the same entries whatever the ranges."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.sources import captures, har

TEXTS = ['{"request": {"url": 1}, "response": {}}', '"],"request":{', "\\", '\\"', "\\\\\"", ",1,2,\",\"3\",\"", '["1","2","3"]', "x" * 300, "é\u2028🙂", "", "12345", 'true,false,null', "{[", "]}"]


def capture(rng, n=25):
    def one(k):
        content = {"mimeType": "text/plain", "text": rng.choice(TEXTS) * rng.randrange(1, 4)}
        request = {"method": "GET", "url": f"https://x/{k}", "headers": [{"name": "a", "value": rng.choice(TEXTS)}], "postData": {"params": [{"name": str(i), "value": str(i)} for i in range(rng.randrange(4))]}}
        made = {"_initiator": {"type": "script"}, "startedDateTime": "2024", "request": request, "response": {"status": 200, "headers": [], "content": content}, "timings": {"a": [1, 2.5e-3, None, True]}}
        keys = list(made)
        rng.shuffle(keys)
        return {key: made[key] for key in keys}

    pages = [{"startedDateTime": "2024", "id": "p", "title": rng.choice(TEXTS)}]
    log = {"version": "1.2", "pages": pages, "entries": [one(k) for k in range(n)], "comment": "request"}
    return json.dumps({"log": log}, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode(), log["entries"]


def by_ranges(data, size, more=50):
    read = lambda a, b: data[max(0, a) : max(0, b)]
    return [row for a in range(0, len(data), size) for row in har.entries_in(read, len(data), a, min(len(data), a + size), more)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([7, 64, 301, 1000, 10**6]))
def test_ranges_of_any_size_give_every_entry_once(seed, size):
    data, wanted = capture(random.Random(seed), 6 if size < 64 else 25)
    rows = by_ranges(data, size)
    assert [json.loads(text) for _, text in rows] == wanted
    assert [p for p, _ in rows] == sorted({p for p, _ in rows})


@pytest.mark.parametrize("size", [50, 400, 10**6])
def test_a_cut_tail_keeps_what_stands_before(size):
    data, wanted = capture(random.Random(1))
    for cut in (len(data) // 2, len(data) - 40, 3):
        got = [json.loads(text) for _, text in by_ranges(data[:cut], size)]
        assert got == wanted[: len(got)]
        assert cut < 10 or len(got) >= 8


@pytest.mark.parametrize("data", [b"", b"no json at all", b"[]", b'{"log": {"entries": []}}', b'{"log": 1', b'"' * 99, b"\x00\xff" * 50])
def test_other_files_have_no_entries(data):
    assert by_ranges(data, 20) == []


def test_what_is_read_beyond_a_range_is_one_entry():
    data, wanted = capture(random.Random(2), 40)
    ends = []
    read = lambda a, b: ends.append(b) or data[a:b]
    list(har.entries_in(read, len(data), 0, 500, 100))
    assert max(e for e in ends) < len(data) // 2


def test_the_data_source(spark, tmp_path):
    rng, wanted = random.Random(3), {}
    for name in ("a.har", "b.har"):
        data, wanted[name] = capture(rng)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "c.har").write_text("no json")
    (tmp_path / "d.txt").write_text(json.dumps({"log": {"entries": wanted["a.har"]}}))
    few = captures.har_entries(spark, str(tmp_path), 700)
    assert few.rdd.getNumPartitions() > 10
    one = captures.har_entries(spark, str(tmp_path))
    rows = sorted(map(tuple, few.collect()), key=lambda r: r[:2])
    assert rows == sorted(map(tuple, one.collect()), key=lambda r: r[:2])
    assert [(r[0].rsplit("/", 1)[1], r[2]["url"], r[3]["content"]["text"]) for r in rows] == [(n, e["request"]["url"], e["response"]["content"]["text"]) for n in ("a.har", "b.har") for e in wanted[n]]
    assert spark.read.format("har").schema("place long").load(str(tmp_path / "a.har")).count() == 25
