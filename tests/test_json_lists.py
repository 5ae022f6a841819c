"""JSON lists cut at any byte give the items of a plain parser, in order."""

import json
import random

import pytest

from quotelens.sources.json_lists import json_items
from quotelens.sources.readers import read_requests
from quotelens.sources.sinks import write_json_lists

ODD = ['a "quoted" } brace', "back\\slash\\", "},{", "[[", "line\nbreak", "snow ☃ and 😀", "", "\\\"}", 'ends in \\\\"}']


def _items(spark, path):
    return [r["item"] for r in json_items(spark, str(path)).orderBy("_file", "_start", "_place").collect()]


@pytest.mark.parametrize("size", [37, 256, 1 << 20])
def test_items_equal_a_plain_parser_at_every_cut(spark, tmp_path, size):
    random.seed(size)
    values = [{"n": i, "text": random.choice(ODD), "deep": {"list": [1, {"x": "]"}], "empty": {}}, random.choice(ODD): None} for i in range(120)]
    (tmp_path / "a.json").write_text(json.dumps(values, ensure_ascii=False, indent=2), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(values[:7]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [json.loads(item) for item in _items(spark, tmp_path)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == values + values[:7]


def test_small_files(spark, tmp_path):
    for name, text, number in [("list", "[]", 0), ("object", ' {"a": {"b": "}"}}\n', 1), ("blank", "[ \n ]\n", 0), ("nothing", "", 0), ("bom", '﻿[{"a": 1}]', 1)]:
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        assert len(_items(spark, path)) == number, name


@pytest.mark.parametrize("text", ["[1, 2]", '[{"a": 1}', '{"a": 1', '{"a": 1}\n{"a": 2}', '[{"a": 1} {"a": 2}]', '[{"a": 1}, 3, {"a": 2}]', '"word"', '[{"a": "open}]', '[{"a": 1}]]', "\n"])
def test_other_text_is_refused(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad.json"):
        _items(spark, tmp_path / "bad.json")


def test_requests_refuse_a_broken_object(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"product_type": "x"}, {"product_type": }]')
    with pytest.raises(Exception, match="bad.json"):
        read_requests(spark, str(tmp_path / "bad.json")).collect()


def test_written_lists_come_back(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "if(id % 3 = 0, null, concat('}\\\\\"', id)) AS text").repartition(3)
    write_json_lists(rows, str(tmp_path / "lists"))
    got = [json.loads(item) for item in _items(spark, tmp_path / "lists")]
    assert sorted((r["id"], r["text"] or "") for r in got) == sorted((r["id"], r["text"] or "") for r in rows.collect())
    assert all(set(r) == {"id", "text"} for r in got)
    write_json_lists(rows.where("id < 0"), str(tmp_path / "none"))
    assert _items(spark, tmp_path / "none") == []


def test_whole_pieces_are_stored_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    from quotelens.sources import json_lists

    (tmp_path / "flat.json").write_text(json.dumps([{"n": i, "text": "x" * 500} for i in range(400)]))
    stored = []

    def kept(frame, known=json_lists.materialise):
        stored.append(known(frame))
        return stored[-1]

    monkeypatch.setattr(json_lists, "materialise", kept)
    rows = json_items(spark, str(tmp_path / "flat.json"))
    texts = [frame for frame in stored if {"value", "_text"} & set(frame.columns)]
    assert len(texts) == 1 and rows.count() == 400
    # All other stored tables have a row per chunk.
    assert [frame.count() for frame in stored if frame is not texts[0]] == [1, 1]


def test_numbers_follow_files_and_places(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"n": i, "deep": {"list": [i]} if i % 3 else "}"} for i in range(4, 30)]))
    (tmp_path / "a.json").write_text(json.dumps([{"n": i, "text": '"{' * (i % 2)} for i in range(3)]))
    (tmp_path / "aa.json").write_text('{"n": 3}')
    (tmp_path / "c.json").write_text("[]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        got = {r["_number"]: json.loads(r["item"])["n"] for r in json_items(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: i for i in range(30)}


def test_chunks_of_any_length_give_the_same_items(spark, tmp_path):
    random.seed(5)
    values = [{"n": i, "text": random.choice(ODD), "deep": {"x": [{}]} if i % 4 else random.choice(ODD)} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(values, ensure_ascii=False), encoding="utf-8")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        got = [json.loads(item) for item in _items(spark, tmp_path)]
    finally:
        spark.conf.set(key, old)
    assert got == values


def test_requests_keep_keys_and_order_without_a_sort(spark, tmp_path, monkeypatch):
    from quotelens.sources import readers

    # Numbers come from the cut; a numbering by sorted ranges is not used.
    monkeypatch.setattr(readers, "positions", None)
    listed = [{"product_type": f"P{i}", "odd": i, "executed": "yes"} for i in range(20)] + [{"underlyings": "A"}]
    (tmp_path / "batch.json").write_text(json.dumps(listed))
    got = read_requests(spark, str(tmp_path / "batch.json")).orderBy("request_ord")
    assert sorted(got.columns) == ["executed", "odd", "product_type", "request_ord", "underlyings"]
    rows = got.collect()
    assert [r["request_ord"] for r in rows] == list(range(21)) and [r["odd"] for r in rows] == [*map(str, range(20)), None]
    assert [r["product_type"] for r in rows[:20]] == [f"P{i}" for i in range(20)] and rows[20]["underlyings"] == "A"
