import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import relations


def rows_of(seed):
    """Candidates, events, states and contexts with repeated keys, blanks, parents both ways and ids that are no events."""
    rng = random.Random(seed)
    ids = [f"e{i}" for i in range(14)]
    parent = lambda: rng.choice([None, "", " ", "gone", *[f" {i}" for i in ids], *ids])
    events = [(i, rng.choice(["active", "active", "active", "archived", "merged", "ignored", None]), parent()) for i in ids[:-1]]
    text = lambda *xs: rng.choice([None, "", *xs])
    states = [(rng.choice(ids), rng.choice([None, 1, 2, 3]), rng.choice(["", "u", "u ", "v"]), rng.choice([None, "port", "port", "host"]), text("1", "2"), text("1", "2", "3")) for _ in range(60)]
    in_rel = [(rng.choice(ids), f"c{rng.randrange(9)}") for _ in range(12)]
    channels = lambda: {c: rng.choice([0.5, 0.9, 1.0]) for c in rng.sample(["temporal", "entity", "semantic", "state", "reference"], rng.choice([1, 1, 2, 3]))}
    candidates = [(q, c, round(rng.random(), 1), rng.choice([0.5, 1.0]), rng.randrange(3), channels()) for q in [*ids, "new"] for c in [*ids, "gone"] if c != q and rng.random() < 0.9]
    return candidates, events, states, in_rel


def serial(candidates, events, states, in_rel, max_links):
    """Pair by pair, over whole lists."""
    strip = lambda x: (x or "").strip(" ")
    known, parent = {e[0]: e[1] for e in events}, {e[0]: strip(e[2]) for e in events}
    kept = [(i, at or 0, strip(k), strip(a), strip(b), strip(x)) for i, at, k, a, b, x in states if strip(k) and strip(a)]
    out = {}
    for q in {c[0] for c in candidates}:
        found, asked = [], []
        for _, c, aggregate, score, at, channels in (x for x in candidates if x[0] == q):
            if known.get(c) in relations.INACTIVE:
                continue
            met = [(n[2], n[3], o[5], n[4], n[5]) for n in kept if n[0] == q for o in kept if o[0] == c and o[2:4] == n[2:4] and (o[1], c) < (n[1], q) and n[5] not in ("", o[5]) and not (n[4] and o[5] and n[4] != o[5])]
            has = channels.__contains__
            if met:
                m = min(met)
                found.append((c, "supersedes", 0.95, "candidate_to_new", m[2] or m[3], m[4]))
            elif parent.get(q) == c and c in known:
                found.append((c, "co_recall", 0.9, "candidate_to_new", "", ""))
            elif parent.get(c) == q and q in known:
                found.append((c, "co_recall", 0.9, "new_to_candidate", "", ""))
            elif not {x[1] for x in in_rel if x[0] == q} & {x[1] for x in in_rel if x[0] == c} and set(channels) - {"entity", "temporal"}:
                if has("reference") or has("state") or (channels.get("semantic", 0) >= relations.SEMANTIC_GATE and aggregate >= relations.AGGREGATE_GATE):
                    rank = 5 if has("reference") else 4 if has("state") else 3 if has("entity") else 2
                    asked.append((-rank, -aggregate, -score, -at, c))
        found += [(x[-1], "skip", 0.0, "", "", "") for x in sorted(asked)[: max_links + 2]]
        links = 0
        for row in sorted(found, key=lambda x: (-x[2], x[0])):
            links += row[1] != "skip"
            out[q, row[0]] = (*row[1:], "skipped" if row[1] == "skip" else "executed" if links <= max_links else "relation_budget_exhausted")
    return out


def made(spark, seed):
    candidates, events, states, in_rel = rows = rows_of(seed)
    return rows, (
        spark.createDataFrame(candidates, "query_id string, cand_id string, aggregate_score double, channel_score double, cand_at long, channels map<string,double>"),
        spark.createDataFrame(events, "id string, status string, parent_event_id string"),
        spark.createDataFrame(states, "id string, timestamp long, entity string, attribute string, value_before string, value_after string"),
        spark.createDataFrame(in_rel, "event_id string, context_id string"),
    )


@pytest.mark.parametrize("collide", [False, True])
def test_decisions_are_those_of_pairs_taken_one_by_one(spark, monkeypatch, collide):
    if collide:  # what shares a bit is still compared as it is
        monkeypatch.setattr(relations, "_bit", lambda *of: F.lit(1).cast("long"))
    skip = lambda asked: asked.select("query_id", "cand_id", F.lit("skip").alias("operation"), F.lit(0.0).alias("confidence"), *[F.lit("").alias(c) for c in ("direction", "value_before", "value_after")])
    seen = set()
    for seed in range(3):
        rows, tables = made(spark, seed)
        for judge, max_links in ((None, 3), (skip, 1)):
            want = serial(*rows, max_links)
            got = {(r.query_id, r.cand_id): (r.operation, r.confidence, r.direction, r.value_before, r.value_after, r.status) for r in relations.process(*tables, judge, max_links).collect()}
            assert got == want
            seen |= {(x[0], x[2], x[5]) for x in want.values()}
    assert len({x[0] for x in seen}) == 3 and len({x[1] for x in seen}) == 3 and len({x[2] for x in seen}) == 3


def test_a_pair_is_shuffled_to_its_candidate_and_back_and_nothing_is_written(spark, monkeypatch):
    monkeypatch.setattr(relations, "written", lambda *_: pytest.fail("written"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = made(spark, 0)[1]
        lying = tables[0].repartition(4, "query_id")  # as recall leaves them
        plan = relations.process(lying, *tables[1:])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    # the facts of events, by id, are one exchange that is used three times
    assert sorted(k for k in keys if k != "id") == ["cand_id", "query_id", "query_id"] and keys.count("id") == 3
