"""Control folds, placement, expiry, percentiles and messages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinetra import schemas
from kinetra.operators import control as C
from kinetra.operators import kv as V
from kinetra.operators import lifecycle as L
from kinetra.operators import metrics as M
from kinetra.operators import placement as P
from kinetra.sources import files, messages


def test_breaker(spark):
    calls = [(float(i), i, False) for i in range(5)] + [(34.0, 5, True), (34.1, 6, False), (64.2, 7, True), (65.0, 8, True)]
    df = spark.createDataFrame(calls, "ts double, seq long, success boolean").withColumn("endpoint", F.lit("e"))
    got = {r["seq"]: (r["allowed"], r["state"]) for r in C.circuit_breaker(df).collect()}
    assert got[4] == (True, "open") and got[5] == (False, "open") and got[6] == (True, "open") and got[7] == (True, "closed") and got[8] == (True, "closed")


def test_token_bucket_refills(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 1), (0.0, 2), (1.0, 3), (1.5, 4), (100.0, 5)], "ts double, seq long").withColumn("client", F.lit(1))
    assert [r["allowed"] for r in C.token_bucket(df, 1.0, 2.0).orderBy("seq").collect()] == [True, True, False, True, False, True]


def test_admission_order(spark):
    df = spark.createDataFrame([(0.0, 0, "a", 1), (0.0, 1, "a", 1), (0.0, 2, "b", 1), (0.0, 3, "b", 2)], "ts double, seq long, endpoint string, client long").withColumn("success", F.lit(True))
    got = [r["refused"] for r in C.admission(df, (0.0, 3.0), (0.0, 1.0), (0.0, 5.0)).orderBy("seq").collect()]
    assert got == [None, "endpoint", None, "global"]


def test_policy(spark):
    df = spark.createDataFrame([(0.0, 0, "x", 1), (0.0, 1, "x", 9), (0.0, 2, "y", 1), (0.0, 3, None, 9)], "ts double, seq long, kind string, current_priority int")
    rules = spark.createDataFrame([(0, 0.0, 1.0, None), (1, None, None, 5.0)], "place int, rate double, capacity double, priority double")
    wanted = spark.createDataFrame([(0, "kind", "x")], "place int, field string, value string")
    got = [r["refused"] for r in C.policy(df, rules, wanted, ["kind"]).orderBy("seq").collect()]
    assert got == [1, 0, 1, None]
    assert [r["refused"] for r in C.policy(df, rules.where("place = 0"), wanted, ["kind"]).orderBy("seq").collect()] == [None, 0, None, None]
    assert C.policy(df, rules.where("false"), wanted.where("false"), ["kind"]).where("refused is null").count() == 4


def test_policy_of_many_rules_with_null_fields(spark):
    """Rules of none to three conditions in tables, against a plain loop over all of them."""
    rng = random.Random(4)
    values = [None, "p", "q", "r"]
    rows = [(float(k // 3), k, rng.choice(values), rng.choice(values), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 5, 9])) for k in range(400)]
    rules = [(k, *((rng.choice([0.1, 0.5]), float(rng.randint(1, 6))) if k % 3 else (None, None)), rng.choice([None, 3.0, 6.0])) for k in range(30)]
    wanted = {k: {f: rng.choice(["p", "q", "r"] if f != "n" else ["1", "2"]) for f in rng.sample(["a", "b", "n"], rng.choice([0, 1, 1, 2, 2, 3]) if k != 5 else 0)} for k in range(30)}
    df = spark.createDataFrame(rows, "ts double, seq long, a string, b string, n int, current_priority int")
    tables = spark.createDataFrame(rules, "place int, rate double, capacity double, priority double"), spark.createDataFrame([(k, f, v) for k, c in wanted.items() for f, v in c.items()], "place int, field string, value string")
    held, expected = {}, {}
    for ts, seq, a, b, n, priority in rows:
        seen = {"a": a, "b": b, "n": None if n is None else str(n)}
        for k, rate, capacity, least in rules:
            if any(seen[f] != v for f, v in wanted[k].items()):
                continue
            if rate is not None:
                tokens, at = held.get(k, (capacity, ts))
                tokens = min(capacity, tokens + (ts - at) * rate)
                held[k] = (tokens - (tokens >= 1), ts)
                if tokens < 1:
                    expected[seq] = k
                    break
            if least is not None and priority is not None and priority < least:
                expected[seq] = k
                break
    got = {r["seq"]: r["refused"] for r in C.policy(df, *tables, ["a", "b", "n"]).collect()}
    assert {s: k for s, k in got.items() if k is not None} == expected and len(got) == 400 and len(set(expected.values())) > 5


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([(1, 40.0, 60.0), (2, 40.0, None), (3, 40.0, 0.0)], "key long, ts double, ttl double")
    assert V.unexpired(df, F.lit(100.0)).count() == 3
    assert {r["key"] for r in V.unexpired(df, F.lit(100.001)).collect()} == {2, 3}


def test_last_writer_with_and_without_tombstones(spark):
    df = spark.createDataFrame([(1, 5.0, 0, "put", 1.0), (1, 7.0, 1, "delete", None), (1, 6.0, 2, "put", 2.0)], "key long, ts double, seq long, op string, value double")
    assert V.merge_latest(df).count() == 0
    assert V.merge_arrival(df).first()["value"] == 2.0


def test_alert_order(spark):
    df = spark.createDataFrame([(1, 2, 2, 10.0), (3, 4, 3, 20.0), (5, 6, 2, 5.0)], "vehicle_id long, other_vehicle_id long, priority int, ts double")
    assert [(r["priority"], r["ts"]) for r in L.queue(df).collect()] == [(3, 20.0), (2, 5.0), (2, 10.0)]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 101])
def test_percentile_rule(spark, n):
    df = spark.range(n).select(F.lit("r").alias("run"), F.floor(F.col("id") / 2).cast("double").alias("latency_ms"))
    values = sorted(i // 2 for i in range(n))
    r = M.latency_stats(df).first()
    assert r["p95"] == values[min(n - 1, int(n * 0.95))] and r["p99"] == values[min(n - 1, int(n * 0.99))]


def test_adaptive_rate_of_one_key_in_many_ranges(spark):
    """A key with nearly all rows, in ranges of its own, against the plain loop; long runs up and down meet both bounds."""
    rng, rows = random.Random(6), []
    for k in range(6000):
        busy = 0.9 if (k // 700) % 2 else 0.1
        rows.append((None if k % 50 == 0 else "hot" if k % 10 else "few", float(k // 2), k, rng.choice([busy, busy, busy, 0.6, None, 1 - busy])))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "11"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r["client"], r["seq"]): r["rate"] for r in C.adaptive_rate(spark.createDataFrame(rows, "client string, ts double, seq long, cpu double"), 100.0, "client").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    held, seen = {}, set()
    for client, _, seq, cpu in rows:
        rate = held.get(client, 100.0)
        rate = max(10.0, rate * 0.8) if cpu is not None and cpu > 0.8 else min(10000.0, rate * 1.1) if cpu is not None and cpu < 0.5 else rate
        held[client] = rate
        seen.add(rate)
        assert got[client, seq] == pytest.approx(rate, rel=1e-9)
    assert len(got) == len(rows) and {10.0, 10000.0} <= seen


def test_percentiles_by_selection(spark):
    """Ties, one-value runs, far outliers, values that differ in the last bit, infinities, NaN and nulls, against the index rule on sorted values."""
    rng = random.Random(9)
    runs = {
        "ties": [float(rng.randrange(4)) for _ in range(500)], "one": [7.5] * 40, "single": [-3.0], "far": [1e-300, 1e300, -1e300, *(rng.random() for _ in range(300))], "close": [1.0 + k * 2.0**-52 for k in range(200)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)], "odd": [float("inf")] * 3 + [float("-inf")] * 4 + [float("nan")] * 2 + [rng.gauss(0, 1) for _ in range(91)], "ends": [-1.7e308, 1.7e308, 0.0, 5e-324],
    }
    rows = [(r, v) for r, values in runs.items() for v in values] + [("ties", None), ("nulls", None)]
    rng.shuffle(rows)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["run"]: r.asDict() for r in M.percentile_at(spark.createDataFrame(rows, "run string, v double"), "run", "v", shares).collect()}
    assert set(got) == set(runs)
    for run, values in runs.items():
        values = sorted(values, key=lambda v: (v != v, v))
        for name, share in shares.items():
            assert repr(got[run][name]) == repr(values[min(len(values) - 1, int(len(values) * share))]), (run, name)


def test_percentiles_sort_nothing(spark, capsys):
    M.percentile_at(spark.range(1000).select(F.lit("r").alias("run"), F.col("id").cast("double").alias("v")), "run", "v", {"p": 0.5}).explain()
    assert "Window" not in capsys.readouterr().out


def test_rebalance_keeps_load(spark):
    cells = spark.createDataFrame([(i, (i * 37) % 50 + 1, 0 if i < 30 else i % 4) for i in range(40)], "cell long, load long, shard_id int")
    rows = P.rebalance_cells(cells, 4).collect()
    before, after = ([sum(r["load"] for r in rows if r[c] == k) for k in range(4)] for c in ("was", "shard_id"))
    assert sum(before) == sum(after) and max(after) < max(before)
    dealt = P.greedy_shards(cells.select("cell", "load"), 4).collect()
    loads = [sum(r["load"] for r in dealt if r["shard_id"] == k) for k in range(4)]
    assert max(loads) - min(loads) <= 50


def test_failover_leaves_nothing_on_failed_nodes(spark):
    resources = spark.createDataFrame([(f"t-{i}", i % 5) for i in range(100)], "resource_id string, node_id long")
    nodes = spark.createDataFrame([(i, "active" if i < 4 else "inactive") for i in range(5)], "node_id long, status string")
    got = P.failover(resources, nodes, F.col("node_id") == 0).collect()
    assert len(got) == 20 and {r["node_id"] for r in got} == {1, 2, 3} and {r["kind"] for r in got} == {"t"}


def test_reports_and_quarantine(spark):
    good = {"id": "v1", "position": {"x": 1.0, "y": 2.0, "z": 0.0}, "velocity": {"x": 3.0}, "heading": 0.5, "size": 2.0, "type": "car", "timestamp": 9.0}
    df = spark.createDataFrame([(json.dumps(good),), ("{broken",), ('{"no": "id"}',)], "value string")
    rows, bad = messages.vehicles(df)
    assert rows.collect()[0].asDict() == {"id": "v1", "x": 1.0, "y": 2.0, "z": 0.0, "vx": 3.0, "vy": 0.0, "vz": 0.0, "ax": 0.0, "ay": 0.0, "az": 0.0, "heading": 0.5, "size": 2.0, "type": "car", "ts": 9.0}
    assert bad.count() == 2 and rows.schema.names == schemas.VEHICLE.names
    again, _ = messages.vehicles(rows.select(messages.vehicle_json(rows).alias("value")))
    assert again.collect() == rows.collect()


def test_backups_and_metrics_files(spark, tmp_path):
    for k in range(7):
        files.backup({"a": spark.range(k + 1)}, f"{tmp_path}/b", f"n{k}", float(k))
    found = files.backups(spark, f"{tmp_path}/b")
    assert found.first()["backup_id"] == "n6" and {r["backup_id"] for r in files.superseded(found).collect()} == {"n0", "n1"}
    assert files.restore(spark, f"{tmp_path}/b", "n3")["a"].count() == 4
    (tmp_path / "x_metrics.csv").write_text("timestamp,throughput,avg_latency,p95_latency,p99_latency,max_latency,error_rate,cpu_usage,memory_usage\n1,2,3,4,5,6,0,8,9\n")
    r = files.read_metrics(spark, str(tmp_path)).first()
    assert (r["run"], r["throughput"]) == ("x", 2.0)


def test_folds_keep_no_array_of_a_key(spark, capsys):
    """One hot key in many batches, against a plain loop."""
    n, rate, capacity = 30000, 0.4, 7.0
    df = spark.range(n).select(F.col("id").alias("seq"), F.floor(F.col("id") * 1.3).cast("double").alias("ts"), F.lit(1).alias("client"), F.lit("e").alias("endpoint"), (F.col("id") % 3 > 0).alias("success"), (F.col("id") % 10 / 10).alias("cpu"), (F.col("id") % 10).alias("current_priority"))
    rules = spark.createDataFrame([(0, rate, capacity, None)], "place int, rate double, capacity double, priority double")
    policy = C.policy(df, rules, spark.createDataFrame([], "place int, field string, value string"), ["endpoint"])
    chain = C.admission(df, (rate, capacity), (9.0, 9.0), (9.0, 9.0), {"failures": n, "recovery": 1.0})
    for out in (chain, C.token_bucket(df, rate, capacity), C.circuit_breaker(df), C.queue_verdicts(df.select(F.lit("t").alias("topic"), "ts", "seq", F.floor("ts").alias("tick")), 5, 2)):
        out.explain()
        plan = capsys.readouterr().out
        assert "collect_list" not in plan and "Join" not in plan
    tokens, at, refused = capacity, None, set()
    for i in range(n):
        ts = float(i * 13 // 10)
        tokens, at = min(capacity, tokens + (ts - (ts if at is None else at)) * rate), ts
        if tokens >= 1:
            tokens -= 1
        else:
            refused.add(i)
    assert 0 < len(refused) < n
    assert {r["seq"] for r in policy.where("refused = 0").collect()} == refused
    assert {r["seq"] for r in chain.where("refused = 'global'").collect()} == refused and chain.count() == n


def test_region_plan(spark):
    """Parts of a split go to idle shards, then to new ones; only cells of two idle shards that touch are merged."""
    names = "cell long, level int, cx long, cy long, cz long, vehicle_count long, shard_id int"
    plan = lambda rows, n: P.region_plan(spark.createDataFrame(rows, names), n).orderBy("action", "cell", "region").collect()
    full = [(1, 2, 3, 1, 0, 90, 0), (2, 2, 3, 2, 0, 10, 0)]
    idle = [(k, 2, 9, k, 0, 1, k) for k in range(1, 8)]
    got = plan(full + [(10 + c, *r) for c, *r in idle], 8)
    assert {(r["action"], r["cell"], r["level"]) for r in got} == {("split", 1, 3)} and [r["shard_id"] for r in got] == [*range(8)]
    assert {(r["cx"], r["cy"], r["cz"]) for r in got} == {(6 + x, 2 + y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)}
    # two idle shards without regions, then new ones
    assert [r["shard_id"] for r in plan(full, 3)] == [0, 1, 2, 3, 4, 5, 6, 7]
    # a full shard that is at the last level is not split, and the idle ones are paired
    full = [(1, 3, 3, 1, 0, 90, 0)]
    cells = [(20, 2, 0, 0, 0, 2, 1), (21, 2, 5, 5, 0, 3, 1), (22, 2, 5, 6, 0, 2, 2), (23, 2, 8, 8, 0, 1, 2), (24, 2, 1, 1, 0, 1, 3), (25, 2, 2, 2, 0, 1, 4)]
    assert [(r["action"], r["cell"], r["region"], r["was"], r["shard_id"]) for r in plan(full + cells, 5)] == [("merge", 21, "21+22", 1, 1), ("merge", 22, "21+22", 2, 1)]


def test_shared_limit_sorts_batches_in_its_task(spark, capsys):
    """The task that holds all requests sorts a packed row for each batch of them, in the order of (ts, seq), nulls first."""
    rows = [(float(i * 7 % 50) if i % 11 else None, i, "e", i % 3, True) for i in range(400)]
    log = spark.createDataFrame(rows, "ts double, seq long, endpoint string, client long, success boolean").repartition(4)
    got = C.fold_all(log, [], lambda: 0, lambda n, ts, seq: (n + 1, (n,)), "place int", ["ts", "seq", "client"])
    assert [(r["ts"], r["seq"], r["client"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == [(r[0], r[1], r[3]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))]
    C.admission(log, (1.0, 5.0), (1.0, 5.0), (1.0, 5.0)).explain()
    plan = capsys.readouterr().out
    assert "SinglePartition" in plan and "everyone" not in plan and plan.count("rows#") > 0


def test_foremost_rows_are_those_of_the_window(spark, monkeypatch):
    """Ties, nulls and what is no number included: the window over the rows that are left gives what it gives over all, and few are left."""
    from pyspark.sql import Window as W

    from kinetra.operators import ranking as R

    monkeypatch.setattr(R, "GATHERED", 500)
    rows = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 97 > 0, F.col("id") * 7919 % 40).alias("k"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, float("nan")).otherwise((F.col("id") * 31 % 83).cast("double")).alias("a"), (F.col("id") * 17 % 1009).cast("string").alias("b"), "id")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.desc("a"), "b", "id"))
    top = lambda df: sorted(map(repr, df.withColumn("rank", rank).where("rank <= 3").collect()))
    left = R.foremost(rows, ["k"], [("a", "descending"), ("b", "ascending"), ("id", "ascending")], 3)
    assert top(left) == top(rows) and left.where("k is not null and a is not null and not isnan(a)").count() <= 4 * 40 * 3


def test_ranked_risks_are_cut_before_they_are_sorted(spark):
    """A window over all risks wrote them to disk."""
    from kinetra.operators import kv

    risks = spark.range(10).selectExpr("id as vehicle_id", "id + 1 as other_vehicle_id", "0.5D as risk_level", "0D as ts")
    plan = kv.risks_of_vehicles(risks, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow")
