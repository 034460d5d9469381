"""WARC round trips, splits at any size, and broken files."""

import gzip
import hashlib
import random

import pytest

from flagloom.llm import warc
from flagloom.session import scratch_path

SCHEMA = "page_id long, url string, html string, record_type string"


def brute(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    most = {}
    for i, b in payload:
        if len(b) >= 1000 and i is not None:
            most[b] = max(i, most.get(b, i))
    out = []
    for i, b in payload:
        to = most.get(b) if len(b) >= 1000 else None
        again = to is not None and to != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(2)
    long = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a/x y\r\nz", long), (5, None, long), (3, "u", long), (None, "n", long), (5, "again", long),
            (6, "s", "short"), (7, "s", "short"), (8, "e", None), (9, "e", ""), (10, "m", "WARC/1.1\r\n\r\n" * 200),
            (11, "b", "".join(chr(rng.randrange(32, 1000)) for _ in range(300000)))]
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choice("abc<>\n") for _ in range(rng.randrange(3000)))) for i in range(60)]
    return rows + [(200, "t", "x" * 999), (201, "t", "x" * 999), (202, "t", "y" * 1000), (203, "t", "y" * 1000)]


@pytest.mark.parametrize("range_bytes,ranges_per_task", [(97, 100), (4096, 3), (8 << 20, 1)])
def test_round_trip_in_ranges_of_any_size(spark, range_bytes, ranges_per_task):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = warc.round_trip(df, range_bytes=range_bytes, ranges_per_task=ranges_per_task)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_every_record_is_a_member_of_its_own(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "page " * i) for i in range(1, 30)], "page_id long, url string, html string")
    files = warc.write_warc(df, scratch_path(spark, "warc-test"))
    seen = 0
    for f in files.collect():
        whole = gzip.decompress(warc.shared_fs(f["path"])[0].open_input_file(warc.shared_fs(f["path"])[1]).read())
        parts = [r for _, r in warc.read_members(f["path"], 0, f["bytes"])]
        assert b"".join(parts) == whole and len(parts) == f["records"]
        for p in parts:
            head, block = warc.parse_record(p)
            assert head["warc-target-uri"] == f"http://h/{head['x-page-id']}"
            assert warc.http_payload(block) == b"page " * int(head["x-page-id"])
        seen += len(parts)
    assert seen == 29


def test_magic_inside_a_record_is_not_a_start(tmp_path):
    inner = gzip.compress(b"not a record") + warc._MAGIC * 5
    record = warc._member([("WARC-Type", "resource")], inner)
    stored = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 0)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(record + stored + record)
    whole = list(warc.read_members(str(path), 0, path.stat().st_size))
    assert [o for o, _ in whole] == [0, len(record), len(record) + len(stored)]
    for size in (1, 7, 50):
        split = [x for a in range(0, path.stat().st_size, size) for x in warc.read_members(str(path), a, a + size)]
        assert split == whole


def test_cut_off_file_is_an_error(tmp_path):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(warc.make_record(1, "u", b"payload" * 1000, None)[:-20])
    with pytest.raises(ValueError, match="broken record"):
        list(warc.read_members(str(path), 0, 10))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_page_with_other_html(spark):
    rows = [(1, "a", "x" * 1500), (1, "a", "y" * 1500), (1, "a", "x" * 1500), (2, "b", "y" * 1500), (2, "b", "z"), (2, "b", None)]
    got = warc.round_trip(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_reading_tasks_follow_the_ranges(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "u", "".join(chr(rng.randrange(33, 120)) for _ in range(5000))) for i in range(40)],
                               "page_id long, url string, html string")
    files = warc.write_warc(df, scratch_path(spark, "warc-test"))
    for size in (2000, 20000):
        ranges = sum(-(-f["bytes"] // size) for f in files.collect())
        read = warc.read_warc(spark, files, size)
        assert read.rdd.getNumPartitions() == ranges and read.count() == 40
    assert warc.read_warc(spark, files, 2000, 10).rdd.getNumPartitions() < ranges * 10
