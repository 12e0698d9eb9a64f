"""JSON array files against the json module, cut into splits of a few bytes."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from emberline.sources import json_arrays, sinks


@pytest.fixture
def small_splits(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)

    yield cut
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "ab", " "]) for _ in range(rng.randrange(8)))
    if kind == 3:
        return rng.choice([1, -2.5, True, False, None])
    if kind == 4:
        return {}
    if kind == 5:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(['', '}', '\"'])}": _value(rng, depth + 1) for i in range(rng.randrange(4))}


def _read(spark, path):
    rows = json_arrays.read_records(spark, str(path)).collect()
    return sorted(json.dumps(json.loads(r["record"]), sort_keys=True) for r in rows if not r["broken"]), sum(r["broken"] for r in rows)


@pytest.mark.parametrize(("size", "indent"), [(1 << 20, None), (17, None), (40, 1), (300, None)])
@pytest.mark.parametrize("sent", [True, False])
def test_records_of_nested_arrays(spark, tmp_path, small_splits, monkeypatch, size, indent, sent):
    small_splits(size)
    monkeypatch.setattr(json_arrays, "MAX_SENT", 10**6 if sent else 0)
    rng = random.Random(size)
    expected = []
    for n in range(3):
        records = [{"id": i, "v": _value(rng)} for i in range(25)]
        (tmp_path / f"{n}.json").write_text(json.dumps(records, indent=indent, ensure_ascii=bool(n % 2)))
        expected += [json.dumps(r, sort_keys=True) for r in records]
    assert _read(spark, tmp_path) == (sorted(expected), 0)


def test_flat_records_are_read_in_one_more_scan(spark, tmp_path, small_splits):
    small_splits(4096)
    records = [{"id": i, "name": f"n{i}"} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    found = json_arrays.read_records(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 8
    assert str(found._jdf.queryExecution().sparkPlan()).count("FileScan text") == 1
    assert _read(spark, tmp_path) == (sorted(json.dumps(r, sort_keys=True) for r in records), 0)


@pytest.mark.parametrize("size", [1 << 20, 9])
def test_odd_files(spark, tmp_path, small_splits, size):
    small_splits(size)
    for n, text in enumerate(["[]", " [ ] \n", "\ufeff[{\"a\": 1}]\n", "", '[1, "x}", null, {"a": 2}, [3, {"b": 4}], 5]']):
        (tmp_path / f"good{n}.json").write_text(text)
    good = ['"x}"', "1", "5", '[3, {"b": 4}]', '{"a": 1}', '{"a": 2}']
    rows = json_arrays.read_records(spark, str(tmp_path)).collect()
    assert not any(r["broken"] for r in rows) and len(rows) == len(good)
    for n, text in enumerate(['{"a": 1}', '[{"a": 1}', '[{"a": 1}] x', '[{"a": 1}]]', '[{"a": "}]', "x", '{"a": [{"b": 1}]}\n']):
        folder = tmp_path / f"bad{n}"
        folder.mkdir()
        (folder / "f.json").write_text(text)
        assert [(r["record"], r["broken"]) for r in json_arrays.read_records(spark, str(folder)).collect()] == [(None, True)], text
    folder = tmp_path / "comma"
    folder.mkdir()
    (folder / "f.json").write_text('[{"a": 1} {"a": 2}, {"a": 3}]')
    assert _read(spark, folder) == (['{"a": 1}', '{"a": 3}'], 1)


def test_structure_of_escapes():
    raw = np.frombuffer(rb'{"a\\":"\"}{","\\\\"}', np.uint8)
    quotes, steps = json_arrays.structure(raw)
    assert quotes[-1] == 6 and np.where(quotes % 2 == 1, 0, steps).sum() == 0


def test_written_arrays_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else f'"{i}}}') for i in range(200)], "id long, name string").repartition(4)
    sinks.write_json_arrays(rows, str(tmp_path / "out"))
    files = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert len(files) == 4 and sum(map(len, files)) == 200
    assert len(_read(spark, tmp_path / "out")[0]) == 200
    sinks.write_json_arrays(rows.limit(0), str(tmp_path / "none"))
    assert _read(spark, tmp_path / "none") == ([], 0)
