"""Records of large files against a plain parse, with files cut into many small ranges."""

import json
import random

import pytest

from dwellpath.sources.exports import read_timeline, read_timeline_lines
from dwellpath.sources.records import json_records, text_lines


def odd_record(g, k):
    text = "".join(g.choice(['"', "\\", "{", "}", "[", "]", "é", "x", "\n", ",", ":", "中"]) for _ in range(g.randrange(0, 30)))
    inner = [{"a": text, "b": [1, {"c": {}}]} for _ in range(g.randrange(0, 4))]
    return g.choice([{"k": k, "t": text, "in": inner}, {"k": k}, {"k": k, "long": text * 60}])


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "10"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", [1, 2])
def test_records_equal_a_plain_parse(small_ranges, tmp_path, seed):
    spark, g, want = small_ranges, random.Random(seed), {}
    for f in range(5):
        records = [odd_record(g, k) for k in range(g.choice([0, 1, 30, 120]))]
        other = [odd_record(g, -1) for _ in range(30)]
        as_object = {"first": other, "timelineObjects": records, "last": {"deep": other}, "more": other}
        body = json.dumps(g.choice([records, as_object, {"timelineObjects": records}]), ensure_ascii=g.random() < 0.5, indent=g.choice([None, 2]))
        (tmp_path / f"f{f}.json").write_text(("\n " if f == 1 else "") + body + ("\n" if f % 2 else ""), encoding="utf-8")
        want[f"f{f}.json"] = records
    rows = json_records(spark, str(tmp_path), "timelineObjects").collect()
    got = {f: [json.loads(r["value"]) for r in sorted((r for r in rows if r["file"].endswith(f)), key=lambda r: r["seq"])] for f in want}
    assert got == want
    assert len({(r["file"], r["seq"]) for r in rows}) == len(rows)


def test_one_file_is_read_by_many_tasks(small_ranges, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": k, "x": "y" * 50} for k in range(400)]))
    df = json_records(small_ranges, str(tmp_path / "a.json"), "timelineObjects")
    assert [json.loads(r["value"])["k"] for r in df.orderBy("seq").collect()] == list(range(400))
    from pyspark.sql import functions as F

    raw = small_ranges.read.option("lineSep", "}").text(str(tmp_path / "a.json"))
    assert raw.select(F.spark_partition_id().alias("p")).distinct().count() > 20


def test_lines_keep_their_order(small_ranges, tmp_path):
    g = random.Random(3)
    lines = ["é" * g.randrange(0, 90) + str(k) for k in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    assert [r["value"] for r in text_lines(small_ranges, str(tmp_path)).orderBy("seq").collect()] == lines


def test_timeline_of_lists_objects_and_lines(spark, tmp_path):
    visit = {"startTime": "2024-01-01T10:00:00Z", "endTime": "2024-01-01T11:00:00Z", "visit": {"topCandidate": {"placeLocation": "geo:1,2"}}}
    (tmp_path / "a.json").write_text(json.dumps([visit, visit | {"startTime": "2024-01-01T10:30:00Z"}]))
    (tmp_path / "b.json").write_text(json.dumps({"timelineObjects": [visit]}))
    (tmp_path / "c.json").write_text("[]")
    rows = read_timeline(spark, str(tmp_path)).orderBy("file", "seq").collect()
    assert [r["startTime"][11:16] for r in rows] == ["10:00", "10:30", "10:00"] and rows[0]["visit"]["topCandidate"]["placeLocation"] == "geo:1,2"
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x").write_text("\n".join(json.dumps(visit | {"endTime": str(k)}) for k in range(20)) + "\n\n")
    assert [r["endTime"] for r in read_timeline_lines(spark, str(tmp_path / "l")).orderBy("file", "seq").collect()] == [str(k) for k in range(20)]
