"""JSON lists cut by many tasks against the standard parser."""

import json
import random

import pytest

from tidemark.sources import json_lists


def values(rng, n):
    words = ["}", "{", "[", "]", '"', "\\", ",", "\n", "é", "日", "x" * 40, '\\"}', "\\\\"]
    def text():
        return "".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
    def value(depth):
        kind = rng.randrange(6)
        if kind < 3 or depth == 0:
            return text()
        if kind == 3:
            return {text() or "k": value(depth - 1) for _ in range(rng.randrange(0, 3))}
        return [value(depth - 1) for _ in range(rng.randrange(0, 3))] if kind == 4 else rng.choice([None, True, 1.5, -3])
    out = []
    for i in range(n):
        out.append({"id": i, **{f"f{k}": value(3) for k in range(rng.randrange(0, 4))}})
    return out


@pytest.mark.parametrize("size,indent,pure", [(64, None, True), (333, 2, True), (1000, None, False), (1 << 27, 1, True)])
def test_records_equal_the_parser(spark, tmp_path, size, indent, pure):
    rng = random.Random(size)
    want = []
    for k in range(3):
        records = [{**r, "id": r["id"] + 1000 * k} for r in values(rng, 60 * k)]
        want += records
        listed = list(records) if pure else [x for r in records for x in (r, "a {string} }", 5, None, '\\"{')]
        (tmp_path / f"a {k}.json").write_text(json.dumps(listed, indent=indent, ensure_ascii=k == 1), encoding="utf-8-sig" if k == 2 else "utf-8")
    (tmp_path / "object.json").write_text(json.dumps({"records": want[:2]}))
    (tmp_path / "none.json").write_text("")
    rows, others = json_lists.list_records(spark, str(tmp_path), range_bytes=size)
    got = [json.loads(r.value) for r in rows.collect()]
    assert sorted((g for g in got if "id" in g), key=lambda r: r["id"]) == sorted(want, key=lambda r: r["id"])
    assert [o.rsplit("/", 1)[1] for o in others] == ["object.json"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    records = [{"id": i, "text": "}{" * (i % 50)} for i in range(5000)]
    (tmp_path / "list.json").write_text(json.dumps(records))
    rows, _ = json_lists.list_records(spark, str(tmp_path), range_bytes=1 << 14)
    assert sorted(json.loads(r.value)["id"] for r in rows.collect()) == list(range(5000))
    with json_lists._steady_ranges(spark, 1 << 14):
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    table, others = json_lists.read_json_lists(spark, str(tmp_path), 1 << 14)
    assert others == [] and table.count() == 5000 and table.filter("text = repeat('}{', id % 50)").count() == 5000


def test_effect_of_texts():
    assert json_lists.effect('[{"a": "x', False) == (True, 2)
    assert json_lists.effect('\\" y", "b": [1', True) == (False, 0)
    assert json_lists.effect('y', True) == (True, 0)
    assert json_lists.effect('], "c": {', False) == (False, -1)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_a_list_is_one_file_copied_by_one_task(spark, tmp_path, n):
    """Records made by many tasks, some of them without rows, end as one valid list; repeated ones are kept."""
    records = [{"id": i // 2, "text": '"}{[\\' * (i % 4)} for i in range(n)]
    rows = spark.createDataFrame([(json.dumps(r),) for r in records], "value string").repartition(40).filter("length(value) > 0")
    json_lists.write_list(rows, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    got = json.loads(files[0].read_text())
    assert len(files) == 1 and sorted(map(json.dumps, got)) == sorted(map(json.dumps, records))
    read, others = json_lists.list_records(spark, str(tmp_path / "out"))
    assert others == [] and sorted(r.value for r in read.collect()) == sorted(map(json.dumps, records))
