"""JSON arrays cut at every place against the standard parser."""

import json
import random

import pytest

from docaudit.sources import arrays, readers

SCHEMA = "paper_id string, title string, tags array<string>, inner struct<a: string, b: array<struct<c: string>>>"


def rows(n, seed=3):
    rng = random.Random(seed)
    bits = ["}", "{", "[", "]", '"', "\\", "\\\\", "\n", ",", " ", "ü", "word", '\\"', "}]", '"},{"', " "]

    def text():
        return "".join(rng.choice(bits) for _ in range(rng.randrange(40)))

    return [{"paper_id": str(i), "title": text(), "tags": [text() for _ in range(rng.randrange(3))], "inner": {"a": text(), "b": [{"c": text()}] * rng.randrange(3)}} for i in range(n)]


def plain(r):
    return json.dumps({"paper_id": r["paper_id"], "title": r["title"], "tags": r["tags"], "inner": r["inner"]}, sort_keys=True)


@pytest.mark.parametrize("indent,size", [(None, 501), (2, 997)])
def test_cut_anywhere(spark, tmp_path, indent, size):
    data = rows(60)
    (tmp_path / "a.json").write_text(json.dumps(data[:40], indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(data[40:59], indent=indent) + "\n")
    (tmp_path / "c.json").write_text(json.dumps(data[59]))
    was, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = arrays.scan_arrays(spark, str(tmp_path), SCHEMA).collect()
        if size == 501:
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted(plain(r.asDict(recursive=True)) for r in got) == sorted(map(plain, data))


def test_odd_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)

    put("empty.json", "")
    put("none.json", "[]\n")
    put("blank.json", " \n")
    put("mixed.json", '[1, "}", null, {"paper_id": "a"}, [ ], {"paper_id": "b"}]')
    put("several.json", '[{"paper_id": "c"}]\n[]\n[{"paper_id": "d"}, {"paper_id": "d"}]')
    put("lines.json", '{"paper_id": "e"}\n{"paper_id": "f", "title": "x}"}\n')
    put("cut.json", '[{"paper_id": "g"}, {"paper_id": "lost", "inner": {"a": "x"}')
    put("bad.json", '[{"paper_id": nonsense}]')
    put("mark.json", '﻿\n [{"paper_id": "h"}]')
    got = [r.paper_id for r in arrays.scan_arrays(spark, str(tmp_path), SCHEMA).collect()]
    assert sorted(got, key=str) == sorted(["a", "b", "c", "d", "d", "e", "f", "g", "h", None], key=str)
    numbered = {(r.file.rsplit("/", 1)[1], r.record) for r in arrays.records(spark, str(tmp_path)).collect()}
    assert {r for f, r in numbered if f == "several.json"} == {0, 1, 2}


def test_no_rows(spark, tmp_path):
    (tmp_path / "p.json").write_text("[]")
    df = readers.scan_predictions(spark, str(tmp_path))
    assert df.count() == 0 and df.columns[0] == "paper_id"
