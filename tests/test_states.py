"""Agent states out of one pass against the operators they are made of."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweave.operators import fleet
from logweave.plans import fleet_state
from logweave.schemas import AGENT_MESSAGE


def log(rng, n):
    start = datetime(2024, 1, 1)
    messages, pushes = [], []
    for seq in range(n):
        agent = f"a{rng.choice([0, 0, 0, 1, 2, 3])}"
        row = {"agent_id": agent, "seq": seq, "ts": start + timedelta(seconds=seq)}
        for _ in range(rng.randrange(0, 3)):
            kind = rng.choice(["description", "health", "snapshot", "start", "config", "status"])
            if kind == "description":
                row["description"] = (f"h{seq}", None, "u")
            elif kind == "health":
                row["health"] = (rng.random() < 0.6, f"e{seq}")
            elif kind == "snapshot":
                row["snapshot_json"] = '{"receivers":{"r":{"events_in":%d},"q":null},"pipelines":{"p":{"events_dropped":1}}}' % seq
            elif kind == "start":
                row["started_at"] = rng.choice(["", f"2024-01-01T00:{seq % 30:02d}:00Z", "no time"])
            elif kind == "config":
                row["effective_config"] = f"c{rng.randrange(4)}"
            else:
                row["config_status"] = (rng.choice(["APPLIED", "failed", "other"]), rng.choice([None, f"x{seq}"]))
        if rng.random() < 0.15:
            pushes.append((agent if rng.random() < 0.9 else "silent", seq, f"c{rng.randrange(4)}"))
        elif "config_status" in row or rng.random() < 0.9:
            messages.append([row.get(c) for c in AGENT_MESSAGE.names])
    return messages, pushes


@pytest.mark.parametrize("span", [1, 7, 50, 10**6])
def test_states_are_those_of_their_parts(spark, span):
    messages, pushes = log(random.Random(span), 400)
    m = spark.createDataFrame(messages, AGENT_MESSAGE).repartition(4)
    p = spark.createDataFrame(pushes, "agent_id string, seq long, content string")
    asof = F.to_timestamp(F.lit("2024-01-01T00:25:00Z"))
    parts = fleet.inventory(m).join(fleet.flapping(fleet.restart_history(fleet.restarts(m)), asof), "agent_id", "left").join(fleet.config_rollout(m, p), "agent_id", "left")
    out = fleet.agent_states(m, p, asof, span)
    want = {r.agent_id: r.asDict() for r in parts.collect()}
    got = {r.agent_id: r.asDict() for r in out.collect()}
    empty = {"restart_history": [], "restart_count_recent": 0, "flapping": False}
    assert got.keys() == want.keys()
    for agent, row in got.items():
        assert row == {c: empty.get(c, "") if want[agent].get(c) is None else want[agent][c] for c in row}
    one = fleet.fleet_overview(fleet.config_drift(out)).first()
    newest = [r["snapshot_json"] for r in got.values() if r["snapshot_json"]]
    assert (one.agents, one.events_dropped, one.batches_failed) == (len(got), len(newest), 0)
    assert one.events_in == sum(int(s.split('"events_in":')[1].split("}")[0]) for s in newest)


def test_an_empty_fleet(spark):
    none = spark.createDataFrame([], AGENT_MESSAGE)
    states = fleet.agent_states(none, spark.createDataFrame([("a", 1, "c")], "agent_id string, seq long, content string"), F.current_timestamp())
    assert states.count() == 0 and tuple(fleet.fleet_overview(fleet.config_drift(states)).first()) == (0,) * 9


def test_the_overview_takes_one_grouping(spark):
    out = fleet_state.fleet_overview(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Messages and pushes, each read for the rows and for what crosses the borders of chunks, and the time of reading.
    assert plan.count("Relation [") <= 5
