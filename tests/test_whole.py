"""Queries over all of their rows, on tables larger than a cut would leave whole."""

import pytest
from pyspark.sql import functions as F

from kinetra import fixtures as X
from kinetra.plans import registry, state

SF = "/root/testdata/sf0.01"
QUERIES = registry.queries()


def test_future_trajectory_of_every_vehicle(spark):
    got = QUERIES["future_trajectory"](spark, SF).groupBy("id").agg(F.count("*").alias("n")).collect()
    ids = {r["id"] for r in X.fleet(spark, SF).select("id").collect()}
    assert max(ids) > 200 and {r["id"] for r in got} == ids and {r["n"] for r in got} == {20}


def test_order_of_every_pending_task(spark):
    got = QUERIES["pending_task_order"](spark, SF).collect()
    pending = X.tasks(spark, SF).where("status = 'O'").collect()
    expected = [r["task_id"] for r in sorted(pending, key=lambda r: (-r["priority"], r["created_at"], r["task_id"]))]
    assert len(expected) > 100 and [r["task_id"] for r in sorted(got, key=lambda r: r["place"])] == expected
    assert [r["place"] for r in got] == [*range(1, len(got) + 1)]


def test_order_of_every_alert(spark):
    got = QUERIES["alert_order"](spark, SF).collect()
    raised = QUERIES["alerts"](spark, SF).select("vehicle_id", "other_vehicle_id", "priority", "ts").collect()
    assert len(raised) > 50 and [tuple(r)[:4] for r in got] == sorted(map(tuple, raised), key=lambda r: (-r[2], r[3], r[0], r[1]))
    assert [r["place"] for r in got] == [*range(1, len(got) + 1)]


def test_failover_over_every_node(spark):
    got = QUERIES["resource_failover"](spark, SF).collect()
    nodes = {r["node_id"]: r["status"] for r in X.nodes(spark, SF).collect()}
    ranked, tasks = sorted(nodes), [r["task_id"] for r in X.tasks(spark, SF).select("task_id").collect()]
    held = {t: ranked[t % len(ranked)] for t in tasks}
    failed = {n for n in nodes if n % 4 == 1}
    up = {n for n in nodes if nodes[n] == "active"} - failed
    assert max(failed) > 20 and max(up) > 20
    assert {int(r["resource_id"].split("-")[1]): r["was"] for r in got} == {t: n for t, n in held.items() if n in failed}
    assert {r["node_id"] for r in got} == up and len(got) == sum(n in failed for n in held.values())


def test_transfers_of_every_event(spark):
    got = {r["request_id"]: r for r in QUERIES["all_transfers"](spark, SF).collect()}
    events = X.events(spark, SF).collect()
    assert len(got) == len(events) and any(r["event_type"] == "error" for r in events)
    for r in events:
        assert got[r["seq"]]["user_id"] == r["user_id"] and got[r["seq"]]["state"] == (None if r["event_type"] == "error" else r["props"])


@pytest.mark.parametrize("name", ["alert_queue", "alert_order"])
def test_alerts_are_sorted_after_the_search(spark, monkeypatch, name):
    """What is sorted, and so sampled, is a table: it holds no search for pairs."""
    monkeypatch.setattr(state, "placed", lambda df: df)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Join" not in plan
