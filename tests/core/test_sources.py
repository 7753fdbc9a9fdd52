from concurrent.futures import ThreadPoolExecutor
import json

import pytest

from mnemoframe.sources import catalog, lines, records, tables


def write(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_trips(spark, tmp_path):
    trips = [
        {"name": "x", "talk": [{"start_time": "2024-01-01 10:00:00", "source": "s", "detail": " said ", "payload": {}}, 5]},
        {"talk": [{"start_time": "2024-01-01 09:00:00", "source": "s", "payload": {"query": "q", "APP": "Maps\n还有：noise 2024-01-01 10:00"}}], "screen": [{"source": "src", "payload": {"a": "1", "b": {"c": 2}}}]},
    ]
    path = write(tmp_path, "trips.json", trips)
    rows = records.trip_episodes(spark, path).collect()
    assert [(r.bucket_name, r.trip_index, r.record_index) for r in rows] == [("screen", 1, 0), ("talk", 1, 0), ("talk", 0, 0)]
    assert rows[2].content == "said" and rows[1].content == "[talk] 用户说: q | 应用: Maps"
    assert rows[0].content == '[screen] 来源: src | {"a": "1"}'
    base, rest = records.split_episodes(records.trip_episodes(spark, path, ["talk"]), ["timestamp", "trip_index"], ratio=0.5)
    assert base.count() == 1 and rest.count() == 1 and base.first().content.endswith("Maps")


def test_sessions(spark, tmp_path):
    log = [
        {"start_time": "2024-01-01 08:05:00", "source": "车辆状态", "payload": {"seat_hvac": [{"seat": "主驾", "hvac_fan": 2, "hvac_temp_set": 22.0}], "body": {"window_pct": [0, 50]}}},
        {"start_time": "2024-01-01 08:10:00", "source": "车辆状态", "payload": {"seat_hvac": [{"seat": "主驾", "hvac_fan": 3, "hvac_temp_set": 22.0}], "body": {"window_pct": [0, 0]}}},
        {"start_time": "2024-01-01 08:01:00", "source": "车机对话", "payload": {"query": "hi", "tts": "yes"}},
        {"start_time": "2024-01-01 08:20:00", "source": "导航记录", "payload": {"startPoi": "A", "endPoi": "B", "costTime": 12}},
        {"start_time": "2024-01-01 08:30:00", "source": "other", "detail": "2024-01-01 08:30 something"},
    ]
    session = {"session_id": "s1", "start_time": "2024-01-01 08:00:00", "end_time": "2024-01-01 09:00:00", "triggered_scenes": ["commute"], "session_desc": "a drive"}
    path = write(tmp_path, "sessions.json", [{"user_id": "u", "session": session, "log_list": log}, {"user_id": "v", "session": {}, "log_list": []}])
    (row,) = records.session_episodes(spark, path).collect()
    assert row.content.split("\n") == [
        "【会话概要】a drive",
        "【触发场景】commute",
        "【时间范围】2024-01-01 08:00 ~ 2024-01-01 09:00 (60分钟)",
        "",
        "--- 时间线 ---",
        "[08:01] 车机对话: 用户说「hi」→「yes」",
        "[08:05] 车辆状态: 车窗开度=0%/50%, 主驾空调风量=2, 主驾空调温度=22°C",
        "[08:10] 车辆状态变化: 车窗开度 0%/50%→0%/0%, 主驾空调风量 2→3",
        "[08:20] 导航记录: A → B (预计12分钟)",
        "[08:30] other: something",
    ]
    assert row.log_count == 5 and row.sources == ["车辆状态", "车机对话", "导航记录", "other"]


def test_json_lines(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"a": 1}\n\n# note\n{"a": 2}\n')
    assert [r.a for r in lines.read_jsonl(spark, path, "a int").orderBy("a").collect()] == [1, 2]
    lines.append_jsonl(spark.range(5), str(tmp_path / "log"))
    assert [r.id for r in lines.read_recent(spark, str(tmp_path / "log"), "id long", "id", 2).collect()] == [3, 4]


def test_flatten():
    doc = {"z": 1, "summary": "s", "id": "123", "empty": [], "blob": "QUJD" * 60, "list": [{"a": 1}, "x", None], "o": {"p": True}}
    assert lines.flatten(json.dumps(doc)) == "summary: s\nz: 1\nid: <id>\nlist:\n1.\n  a: 1\n2. x\no.p: True"
    assert lines.flatten("plain") == "plain" and lines.flatten(None) == ""
    assert len(lines.flatten(json.dumps({"text": "é" * 60_000})).encode()) <= 50 * 1024
    assert json.loads(lines.loose_json('```json\n{"a": [1]}\n```')) == {"a": [1]}
    assert json.loads(lines.loose_json('sure: {"a": {"b": 1}} ok')) == {"a": {"b": 1}} and lines.loose_json("no") is None
    assert json.loads(lines.merged_payload('{"a": 1, "l": [1, 2], "o": {"x": ""}}', '{"a": 2, "b": 3, "l": [2, 3], "o": {"x": 9}}')) == {"a": 1, "b": 3, "l": [1, 2, 3], "o": {"x": 9}}


def test_versioned_tables(spark, tmp_path):
    space = tables.Namespace(spark, str(tmp_path), "db1")
    assert space.read("users").count() == 0
    space.write("users", spark.createDataFrame([("a",)], "id string"))
    first = space.current("users")
    space.append("users", spark.createDataFrame([("b",)], "id string"))
    assert sorted(r.id for r in space.read("users").collect()) == ["a", "b"]
    assert [r.id for r in space.read("users", first).collect()] == ["a"]
    log = tables.Audit(spark, str(tmp_path / "audit"))
    with log.trace("query"):
        pass
    try:
        with log.trace("bad"):
            raise ValueError
    except ValueError:
        pass
    assert {(r.action, r.status) for r in log.recent().collect()} == {("query", "ok"), ("bad", "failed")}
    assert tables.database_id("My Base").startswith("my-base-")


def test_appends_leave_parts_as_they_are(spark, tmp_path, monkeypatch):
    space = tables.Namespace(spark, str(tmp_path), "db2")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    stamps = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "db2" / "users").glob("p*/*")}
    space.append("users", rows("a"))
    first = stamps()
    space.append("users", rows("b"))
    assert first.items() <= stamps().items()
    # a writer that took the number meanwhile is not overwritten
    stale = space._newest("users")
    space.append("users", rows("c"))
    with pytest.raises(tables.Taken):
        space._point("users", stale["number"] + 1, stale["parts"])
    assert sorted(r.id for r in space.read("users").collect()) == ["a", "b", "c"]
    monkeypatch.setattr(tables, "MAX_PARTS", 3)
    space.append("users", rows("d"))
    assert len(space._newest("users")["parts"]) == 2 and space.expire("users", keep=1) == 3
    assert sorted(r.id for r in space.read("users").collect()) == ["a", "b", "c", "d"] and space.expire("users") == 0


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    space = tables.Namespace(spark, str(tmp_path), "db3")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: [space.append("users", spark.createDataFrame([(f"{i}-{j}",)], "id string")) for j in range(4)], range(4)))
    assert space.read("users").count() == 16 and sorted(space._numbers("users")) == list(range(1, 17))


def test_changes_write_the_changed_rows_only(spark, tmp_path, monkeypatch):
    space = tables.Namespace(spark, str(tmp_path), "db4")
    rows = spark.range(20_000).selectExpr("concat('e', id) as id", "sha2(cast(id as string), 256) as summary", "id as timestamp")
    space.write("events", rows)
    size = lambda part: sum(f.stat().st_size for f in (tmp_path / "db4" / "events" / part).glob("*.parquet"))
    space.upsert("events", spark.createDataFrame([("e1", "one", 1), ("e2", "first", 1), ("e2", "last", 2), ("new", "n", 3)], "id string, summary string, updated_at long"), ["id"])
    space.append("events", spark.createDataFrame([("late", "l")], "id string, summary string"))
    space.delete("events", spark.createDataFrame([("e3",), ("late",), ("nowhere",)], "id string"), ["id"])
    space.upsert("events", spark.createDataFrame([("e3", "again"), (None, "null")], "id string, summary string"), ["id"])
    space.upsert("events", spark.createDataFrame([(None, "null too")], "id string, summary string"), ["id"])
    base, *changed = [p["part"] for p in space._newest("events")["parts"]]
    assert sum(map(size, changed)) < 0.1 * size(base)
    got = {r.id: r.summary for r in space.read("events").filter("length(summary) < 64").collect()}
    assert got == {"e1": "one", "e2": "last", "new": "n", "e3": "again", None: "null too"} and space.read("events").count() == 20_002
    before = sorted(space.read("events").select("id", "summary").collect(), key=str)
    monkeypatch.setattr(tables, "MAX_CHANGES", 4)
    space.delete("events", spark.createDataFrame([("e1",)], "id string"), ["id"])
    assert [p["kind"] for p in space._newest("events")["parts"]] == ["rows", "gone"]
    assert sorted(space.read("events").select("id", "summary").collect(), key=str) == [r for r in before if r.id != "e1"]
    # another key than before: what there is becomes one part first
    space.delete("events", spark.createDataFrame([("last",)], "summary string"), ["summary"])
    assert space.read("events").filter("id in ('e1', 'e2')").isEmpty()


def test_a_part_without_a_pointer_is_not_seen(spark, tmp_path):
    space = tables.Namespace(spark, str(tmp_path), "db5")
    space.write("users", spark.createDataFrame([("a",)], "id string"))
    space._part("users", spark.createDataFrame([("lost",)], "id string"))
    assert [r.id for r in space.read("users").collect()] == ["a"] and space.versions("users").count() == 1


def test_split_by_places(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as timestamp").repartition(5)
    base, rest = records.split_episodes(rows, ["timestamp", "id"], ratio=0.3)
    want = sorted((i % 7, i) for i in range(1000))
    assert [(r.timestamp, r.id) for r in base.collect()] == want[:300] and [(r.timestamp, r.id) for r in rest.collect()] == want[300:]
    for ratio, n in ((0.0, 0), (1.0, 1000)):
        base, rest = records.split_episodes(rows, ["timestamp", "id"], ratio=ratio)
        assert (base.count(), rest.count()) == (n, 1000 - n)
    assert [df.count() for df in records.split_episodes(rows.limit(0), ["id"])] == [0, 0]


def test_catalog(spark):
    c = catalog.Catalog(spark).create_user("u", "U", 1).create_user("r", "Root", 1, root=True)
    c, token = c.issue_key("u", ["w"], 2)
    key = c.authenticate(token).first()
    assert key.user_id == "u" and c.authenticate("x").isEmpty()
    assert catalog.allowed("w", "r") and not catalog.allowed("r", "w") and catalog.allowed("r", "admin", root=True)
    c = c.touch(key.key_id, 100).touch(key.key_id, 120)
    assert c.tables["api_keys"].first().last_used_at == 100
    c = c.create_database("d1", "u", "D", 3).archive_database("d1").create_database("d2", "u", "E", 4)
    assert [r.db_id for r in c.databases("u").collect()] == ["d2"] and c.databases("r", root=True, include_archived=True).count() == 2
    assert c.user_detail().filter("user_id = 'u'").first().n_databases == 2
    assert c.revoke(key.key_id, "r", 9).authenticate(token).count() == 1 and c.revoke(key.key_id, "u", 9).authenticate(token).isEmpty()
    assert c.drop_database("d2").databases("u").isEmpty() and c.delete_user("u").tables["databases"].isEmpty()
