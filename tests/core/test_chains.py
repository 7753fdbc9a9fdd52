import json
import random

import pytest

from mnemoframe.operators import relations
from mnemoframe.streaming import chains

STATES = "id string, timestamp long, entity string, attribute string, value_before string, value_after string"


def play(spark, folder, batches, **more):
    """Each batch is a file and a micro-batch; returns the changes and the numbers of state rows."""
    source, out = folder / "in", str(folder / "out")
    source.mkdir(parents=True)
    progress = []
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(STATES).json(str(source))
        with chains.rocks(spark):
            query = chains.supersession_stream(stream, **more).writeStream.format("json").option("path", out).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append(query.lastProgress)
    return spark.read.schema(chains.CHANGES).json(out), progress


def row(i, t, value, before=None, entity="car", attribute="temp"):
    return {"id": i, "timestamp": t, "entity": entity, "attribute": attribute, "value_before": before, "value_after": value}


def edges(df):
    return sorted((r.from_id, r.to_id, r.entity, r.attribute, r.value_before, r.value_after) for r in df.collect())


def test_any_order_gives_the_edges_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [row(f"e{i}", rng.randint(1, 60), rng.choice(["1", "2", "3", "", None]), rng.choice([None, None, "1", "2"]), rng.choice(["car", "bus"]), rng.choice(["temp", " "])) for i in range(120)]
    rows += [row("e5", 30, "9"), row("late", 10, "25"), row("x1", 10, "20", entity="bike"), row("x3", 30, "30", entity="bike")]
    cut = [rows[:60], rows[60:], [row("x2", 20, "25", entity="bike"), rows[3]]]
    for batch in cut:
        rng.shuffle(batch)
    changes, _ = play(spark, tmp_path, cut)
    unique = list({(r["id"], r["timestamp"], r["entity"], r["attribute"]): r for r in reversed([r for b in cut for r in b])}.values())
    want = edges(relations.supersession_chain(spark.createDataFrame(unique, STATES)))
    assert edges(chains.settled(changes)) == want and len(want) > 20
    bike = [(r.from_id, r.to_id, r.op) for r in changes.filter("entity = 'bike'").collect()]
    assert sorted(bike) == [("x1", "x2", "add"), ("x1", "x3", "add"), ("x1", "x3", "retract"), ("x2", "x3", "add")]


def test_state_falls_behind_the_watermark(spark, tmp_path):
    first = [row(f"a{i}", 100 + i, str(i)) for i in range(50)]
    later = [row("b0", 100_000, "x"), row("other", 100_000, "x", entity="bus")]
    changes, progress = play(spark, tmp_path, [first, later, [row("old", 120, "late"), row("c0", 200_000, "y")], [row("d0", 400_000, "z")], [row("e0", 400_001, "w")]], delay="10 seconds")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert held[0] < 20 and held[-1] < 10  # of fifty, those within the delay and the one before it
    assert edges(chains.settled(changes))[-1][:2] == ("d0", "e0") and changes.filter("to_id = 'old' or from_id = 'old'").isEmpty()
    assert {("a49", "b0"), ("b0", "c0"), ("c0", "d0")} <= {e[:2] for e in edges(chains.settled(changes))}


@pytest.mark.parametrize(("old", "new", "want"), [((1, "a", "1", ""), (2, "b", "2", ""), ("a", "b", "1", "2")), ((1, "a", "1", ""), (2, "b", "1", ""), None), ((1, "a", "1", ""), (2, "b", "", ""), None), ((1, "a", "", ""), (2, "b", "2", "0"), ("a", "b", "0", "2")), ((1, "a", "1", ""), (2, "b", "2", "7"), None), ((1, "a", "1", ""), (2, "a", "2", ""), None)])
def test_edges(old, new, want):
    assert chains.edge(old, new) == want
