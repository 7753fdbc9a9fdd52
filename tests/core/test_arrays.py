import json
import random

import pytest

from mnemoframe.sources import arrays, records


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def some(rng, depth=0):
    kinds = ["text", "number", "list", "object", "none"] if depth < 3 else ["text", "number"]
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", ",", " ", "é", "中", "\n", ":"]) for _ in range(rng.randint(0, 30)))
    if kind == "number":
        return rng.randint(-5, 10**6)
    if kind == "list":
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == "object":
        return {some(rng, 9) if rng.random() < 0.2 else f"k{i}": some(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return None


@pytest.mark.parametrize("indent", [None, 1])
def test_blocks_give_the_items_of_the_whole(spark, tmp_path, small_blocks, indent):
    rng = random.Random(indent or 7)
    files = {"a": [some(rng) for _ in range(80)], "b": [{"long": "x}" * 300}, 5], "c": [], "d": {"no": ["array"]}, "e": [[]], "f": "text, [1, 2]"}
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(("\ufeff \n" if name == "a" else "") + json.dumps(value, ensure_ascii=name == "b", indent=indent) + "\n", encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    got = {}
    for r in arrays.array_items(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1][:1], {})[r.item_index] = json.loads(r.text)
    assert got == {n: dict(enumerate(json.loads(json.dumps(v)))) for n, v in files.items() if isinstance(v, list) and v}
    # more than one block was read
    assert arrays._pieces(spark, str(tmp_path)).filter("file like '%a.json'").select("block").distinct().count() > 10


def test_records_of_a_cut_file(spark, tmp_path, small_blocks):
    trips = [{"morning": [{"start_time": "2024-01-01 08:00:00", "source": "s", "detail": f"trip {i} {{,}}"}]} for i in range(30)]
    (tmp_path / "trips.json").write_text(json.dumps(trips))
    got = [(r.trip_index, r.content) for r in records.trip_episodes(spark, str(tmp_path / "trips.json")).collect()]
    assert sorted(got) == [(i, f"trip {i} {{,}}") for i in range(30)]
