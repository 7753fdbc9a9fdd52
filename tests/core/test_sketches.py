import random

from pyspark.sql import functions as F

from mnemoframe.operators import reports


def test_merged_sketches_tell_the_quantiles(spark):
    rng = random.Random(1)
    rows = [(f"r{i % 4}", "g" if i % 3 else "h", rng.expovariate(1 / 50)) for i in range(20_000)] + [("r0", "g", None)]
    df = spark.createDataFrame(rows, "run string, kind string, latency_ms double").persist()
    parts = [reports.latency_sketches(df.filter(F.col("run") == r), r, ["kind"]) for r in ("r0", "r1", "r2", "r3")]
    stored = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    for r in reports.sketched_latency(reports.merged_sketches(stored, ["kind"])).collect():
        own = sorted(v for _, k, v in rows if k == r.kind and v is not None)
        assert r.n == len(own) and abs(r.latency_avg - sum(own) / len(own)) < 1e-6
        for name, q in reports.QUANTILES.items():
            assert abs(sum(v < r[f"latency_{name}"] for v in own) / len(own) - q) < 0.01
    found = {(r.kind, r.name): r for r in reports.latency_comparison(stored, "r0", "r1", ["kind"]).collect()}
    assert len(found) == 8 and abs(found["g", "latency_p50"].ratio - 1) < 0.2
    assert reports.latency_comparison(stored, "r0", "none", ["kind"]).isEmpty() and reports.latency_sketches(df.limit(0), "x", ["kind"]).isEmpty()
