import json

from mnemoframe.plans import model
from mnemoframe.sources.tables import Namespace
from mnemoframe.streaming import ingest, models


def test_ingest_is_repeatable(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda i, text: json.dumps({"id": i, "content": text, "timestamp": 100})
    (source / "a.json").write_text(row("p1", "First. Second!") + "\n" + row("p2", " ") + "\n")
    space = Namespace(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema("id string, content string, timestamp long").json(str(source))
    run = lambda n: ingest.ingest(stream, space, str(tmp_path / n), models.sentences).awaitTermination()
    run("c1")
    assert sorted(r.summary for r in space.read("events").collect()) == ["First.", "Second!"]
    (source / "b.json").write_text(row("p3", "Third.") + "\n")
    run("c1")
    run("c2")  # another checkpoint replays everything
    assert space.read("events").count() == 3 and space.read("extracted_from").count() == 3 and space.read("episodes").count() == 3
    e = space.read("events").first()
    assert e.status == "active" and e.created_at == 100 and set(model.SCHEMAS) >= {"events"}


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 600), ("a", 9000), ("b", 10)], "k string, s long").selectExpr("k", "timestamp_seconds(s) as t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, q in (("w", ingest.windowed_counts(stream, "t", "k")), ("s", ingest.sessions(stream, "t", "k"))):
        q.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("w").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    batch = ingest.sessions(rows, "t", "k")
    assert sorted((r.k, r.n) for r in batch.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_embedding_stage(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "boom")], "id long, text string")

    def embed(texts):
        if "boom" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    got = {r.id: (r.embedding, r.error) for r in models.embedded(rows, "text", embed).collect()}
    assert got == {1: ([3.0], None), 2: ([0.0], None), 3: (None, "no")}
    assert abs(sum(x * x for x in models.hashed_vector("some words")) - 1) < 1e-9
