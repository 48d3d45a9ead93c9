"""Hand-computed cases, grid invariance, symmetry and boundaries of detection."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.functions import alerts as A
from kinetra.functions import grid as G
from kinetra.operators import detect as D
from kinetra.operators import trajectory as T
from kinetra.plans.base import rounded
from kinetra.sources import generators

COLUMNS = "id x y z vx vy vz ax ay az heading size type ts".split()


def vehicles(spark, *rows):
    base = dict(y=0.0, z=0.0, vx=0.0, vy=0.0, vz=0.0, ax=0.0, ay=0.0, az=0.0, heading=0.0, size=2.0, type="car", ts=0.0)
    data = [tuple((base | r)[c] for c in COLUMNS) for r in rows]
    return spark.createDataFrame(data, "id long, x double, y double, z double, vx double, vy double, vz double, ax double, ay double, az double, heading double, size double, type string, ts double")


def test_head_on(spark):
    fleet = vehicles(spark, dict(id=1, x=0.0, vx=10.0), dict(id=2, x=61.0, vx=-10.0, size=4.0, type="truck", heading=3.14159))
    r = D.detect(fleet).where("vehicle_id = 1").first()
    assert r["time_to_collision"] == pytest.approx(2.7) and r["distance"] == pytest.approx(7) and r["cx"] == pytest.approx(30.5)
    assert r["risk_level"] == pytest.approx(0.416500265, abs=1e-6) and r["relative_speed"] == 20
    assert D.detect(fleet, approach="literal").count() == 0


def test_separating(spark):
    fleet = vehicles(spark, dict(id=1, x=0.0, vx=-1.0, heading=3.14159), dict(id=2, x=3.0, vx=1.0))
    assert D.detect(fleet).count() == 0
    r = D.detect(fleet, approach="literal").where("vehicle_id = 1").first()
    assert r["time_to_collision"] == 0 and r["distance"] == 3 and r["risk_level"] == pytest.approx(0.529428837, abs=1e-6)


def test_lookahead(spark):
    fleet = vehicles(spark, dict(id=1, x=0.0, vx=4.0), dict(id=2, x=40.0, vx=-4.0))
    r = D.lookahead(fleet.withColumn("history", F.lit(2))).where("vehicle_id1 = 1").first()
    assert r["risk_level"] == 1 and r["time_to_collision"] == pytest.approx(4.5) and r["px"] == 20
    assert D.lookahead(fleet.withColumn("history", F.col("id"))).count() == 0


def test_contact_is_strict(spark):
    pairs = D.contacts(vehicles(spark, dict(id=1, x=0.0), dict(id=2, x=2.9, size=1.0), dict(id=3, x=-3.0, size=1.0)))
    assert {(r["vehicle_id"], r["other_vehicle_id"]) for r in pairs.collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("cell", [25.0, 50.0, 100.0, 250.0])
@pytest.mark.parametrize("shift", [0.0, -1000.0])
def test_grid_is_invisible(spark, cell, shift):
    fleet = generators.city_fleet(spark, 300, 1200.0, seed=3, partitions=2).withColumns({"x": F.round("x") + shift, "y": F.round("y") + shift})
    rows = [(r["id"], r["x"], r["y"]) for r in fleet.collect()]
    brute = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if math.dist(a[1:], b[1:]) <= 50}
    got = [(r["s_id"], r["o_id"]) for r in D.nearby(fleet, 50.0, cell).collect()]
    assert len(got) == len(set(got)) and set(got) == brute


def test_radius_includes_the_boundary(spark):
    fleet = vehicles(spark, dict(id=1, x=0.0), dict(id=2, x=60.0, y=80.0), dict(id=3, x=-60.0, y=-80.1))
    assert {(r["s_id"], r["o_id"]) for r in D.nearby(fleet).collect()} == {(1, 2), (2, 1)}


def test_radius_join_is_an_equi_join(spark):
    plan = D.nearby(generators.uniform_fleet(spark, 50))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vehicles_of_any_size(spark):
    """No bound on sizes is assumed: giants are found from afar, by brute force over all pairs."""
    rows = [dict(id=i, x=float(i * 37 % 400), y=float(i * 91 % 300), size=[0.5, 2.0, 12.0, 90.0][i % 4]) for i in range(80)] + [dict(id=900, x=5000.0, size=12.0), dict(id=901, x=5020.0, size=12.0)]
    fleet = vehicles(spark, *rows)
    size, at = {r["id"]: r["size"] for r in rows}, {r["id"]: (r["x"], r.get("y", 0.0)) for r in rows}
    apart = {(a, b): math.dist(at[a], at[b]) for a, b in itertools.permutations(size, 2)}
    touching = {p for p, d in apart.items() if d < size[p[0]] + size[p[1]]}
    assert (900, 901) in touching
    assert sorted((r[0], r[1]) for r in D.contacts(fleet).collect()) == sorted(touching)
    soon = {p for p, d in apart.items() if d <= 10 * size[p[0]] + size[p[1]] and 0 <= d - size[p[0]] - size[p[1]] <= 62.5}
    assert sorted((r[0], r[1]) for r in D.time_to_contact(fleet).collect()) == sorted(soon)
    both = D.encounters(fleet).collect()
    assert sorted((r[0], r[1]) for r in both if r["time_to_contact"] is None) == sorted(touching) and len(both) == len(touching | soon)
    assert sorted((r["s_id"], r["o_id"]) for r in D.nearby_sized(fleet, 20.0).collect()) == sorted(p for p, d in apart.items() if d <= 20 + size[p[1]])


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dear_stages_stand_above_cheap_ones_once(spark):
    """A filter on a result of the probe doesn't repeat it, and distances are tested below it."""
    fleet = generators.uniform_fleet(spark, 50)
    plan = optimized(D.detect(fleet).where("risk_level >= 0.3 and time_to_collision < 5"))
    assert plan.count("flatten(") == 1
    assert plan.index("flatten(") < plan.index("<= 100.0")


def test_dense_cells_are_split(spark):
    """90 % of the vehicles in one cell: AQE splits that cell's partition, as it planned the exchange itself."""
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb"}
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        fleet = generators.uniform_fleet(spark, 3000, width=4000.0).repartition(8).withColumns({c: F.when(F.col("x") > 400, F.lit(50.0) + F.col(c) / 100).otherwise(F.col(c)) for c in "yx"})
        pairs = D.nearby(fleet, 1.0, 100.0)
        assert pairs.count() > 0
        pairs.collect()
        assert "skew=true" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(found):
    """The most pairs of a partition and all pairs."""
    n = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    return max(n), sum(n)


@pytest.mark.parametrize("search", ["sized", "contact"])
def test_pairs_of_a_dense_cell_are_many_tasks(spark, monkeypatch, search):
    """Tasks grow in number with the fleet, and the pairs of one cell are not one task's; none is lost or met twice."""
    from kinetra.operators import blocks

    for name, value in {"BLOCK": 16, "SHARE": 16, "ROWS_OF_TASK": 10}.items():
        monkeypatch.setattr(blocks, name, value, raising=False)
    rows = [dict(id=i, x=i * 37 % 101 / 5.0 + 2, y=i * 91 % 103 / 5.0 + 2, size=[0.5, 2.0, 1.0][i % 3]) for i in range(300)]
    apart = {(a["id"], b["id"], a["size"], b["size"]): math.hypot(a["x"] - b["x"], a["y"] - b["y"]) for a, b in itertools.permutations(rows, 2)}
    if search == "sized":
        found, pair = D.nearby_sized(vehicles(spark, *rows), 5.0), ["s_id", "o_id"]
        expected = sorted(k[:2] for k, d in apart.items() if d <= 5 + k[3])
    else:
        found, pair = D.time_to_contact(vehicles(spark, *rows)), ["vehicle_id", "other_vehicle_id"]
        expected = sorted(k[:2] for k, d in apart.items() if d <= 10 * k[2] + k[3] and 0 <= d - k[2] - k[3] <= 62.5)
    assert sorted(map(tuple, found.select(*pair).collect())) == expected
    most, total = spread(found)
    assert total == len(expected) and most < total / 2


def test_prediction_of_some_is_that_of_all(spark):
    fleet = generators.city_fleet(spark, 200, 600.0, seed=4, partitions=2).withColumn("pattern", F.lit("constant_velocity"))
    some = T.predict(fleet, subjects=fleet.where("id < '5'")).collect()
    assert sorted(map(tuple, some)) == sorted(map(tuple, T.predict(fleet).where("vehicle_id < '5'").collect())) and some


def test_few_windows_are_probed_in_vain(spark, monkeypatch):
    """The bound of a predicted window leaves few windows without a hit; from its start instead of its middle it left five of six."""
    probed, found, probe = [], [], D.probe

    def counted(pairs, window):
        hit = probe(pairs, window)
        probed.append(pairs.count())
        found.append(hit.count())
        return hit

    monkeypatch.setattr(D, "probe", counted)
    fleet = generators.uniform_fleet(spark, 300, width=600.0, seed=8).withColumns({"pattern": F.lit("accelerating"), **dict.fromkeys(("z", "vz", "az"), F.lit(0.0))})
    T.predict(fleet)
    assert found[0] > 100 and probed[0] < 4 * found[0], (probed, found)


def test_prediction_by_blocks_is_that_of_the_join(spark):
    """Patterns, heights, missing types, ids that repeat and some subjects: the same highest risk of each pair, and rows that are pairs, not steps of pairs, leave the tasks."""
    fleet = generators.uniform_fleet(spark, 400, width=500.0, seed=5).withColumn("pattern", F.get(F.array(*map(F.lit, ["stationary", "constant_velocity", "accelerating", "unknown"])), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")))
    fleet = fleet.withColumn("type", F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) > 0, F.col("type")))
    flat = fleet.withColumns(dict.fromkeys(("z", "vz", "az"), F.lit(0.0)))
    columns = ["vehicle_id", "other_vehicle_id", *(F.round(c, 9).alias(c) for c in ("risk_level", "time_to_collision", "distance"))]
    twice = flat.unionByName(flat.where("pattern = 'accelerating'").withColumn("x", F.col("x") + 3))
    for some in (fleet, flat, twice):
        subjects = some.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) > 0)
        expected = sorted(map(tuple, T.predict(some, subjects=subjects).select(*columns).collect()))
        assert sorted(map(tuple, T.predict_fleet(some, subjects=subjects).select(*columns).collect())) == expected and (len(expected) > 200 or some is fleet)
    assert "Window" not in T.predict_fleet(flat)._jdf.queryExecution().toString()


def test_merged_risks_are_not_sorted_by_pair(spark, tmp_path):
    """Where ids are distinct a pair's first row is known without a window; where they repeat, pairs are still merged."""
    from kinetra.plans import detection as P

    spark.range(3000).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/one/customer.parquet")
    spark.range(3000).unionByName(spark.range(100)).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/two/customer.parquet")
    merged = P.merge_risks(spark, f"{tmp_path}/one")
    assert "Window" not in merged._jdf.queryExecution().toString()
    rows = sorted(map(tuple, merged.collect()))
    assert rows and rows == sorted(map(tuple, P.merge_risks(spark, f"{tmp_path}/two").collect()))


def test_empty_fleet(spark):
    none = vehicles(spark)
    for df in (D.detect(none), D.contacts(none), D.time_to_contact(none), D.lookahead(none.withColumn("history", F.lit(2))), T.predict(none.withColumn("pattern", F.lit("accelerating")))):
        assert df.count() == 0


def test_risks_are_bounded_and_grow_with_radius(spark):
    fleet = generators.city_fleet(spark, 400, 1500.0, seed=9, partitions=2)
    near, far = ({(r["vehicle_id"], r["other_vehicle_id"]) for r in D.detect(fleet, radius).collect()} for radius in (40.0, 80.0))
    assert near and near <= far
    low, high = D.detect(fleet).agg(F.min("risk_level"), F.max("risk_level")).first()
    assert 0 <= low <= high <= 1


def test_trajectory_differences_skip_equal_times(spark):
    rows = spark.createDataFrame([(1, 0.0, 0, 0.0), (1, 1.0, 1, 1.0), (1, 1.0, 2, 2.0), (1, 2.0, 3, 4.0), (2, 5.0, 0, 1.0), (2, 5.0, 1, 9.0), (3, 0.0, 0, 0.0)], "id long, t double, seq long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    assert [(r["t"], r["vx"]) for r in T.velocities(rows).where("id = 1").orderBy("t").collect()] == [(1.0, 1.0), (2.0, 2.0)]
    got = {r["id"]: (r["pattern"], r["avg_speed"], r["avg_acceleration"]) for r in T.patterns(rows).collect()}
    assert got == {1: ("accelerating", 1.5, 1.0), 2: ("stationary", 0.0, 0.0), 3: ("unknown", 0.0, 0.0)}


def test_cells_truncate_and_parents_floor(spark):
    df = spark.createDataFrame([(-50.0,), (-150.0,), (150.0,), (99.999,), (100.0,)], "x double")
    assert [r[0] for r in df.select(G.cell(F.col("x"), 100.0)).collect()] == [0, -1, 1, 0, 1]
    assert spark.range(1).select(G.parent(F.lit(-1))).first()[0] == -1


def test_priorities(spark):
    cases = [(0.8, 2.99, 3), (0.8, 3.0, 2), (0.3, 4.99, 2), (0.6, 5.0, 1), (0.59, 5.0, 0)]
    df = spark.createDataFrame(cases, "r double, t double, p int")
    assert df.where(A.priority(F.col("r"), F.col("t")) != F.col("p")).count() == 0


def test_one_decimal_rounds_ties_to_even(spark):
    df = spark.createDataFrame([(v,) for v in (0.25, 0.75, 2.25, 2.35, 0.05, 1.0)], "v double")
    assert [r[0] for r in df.select(A.one_decimal(F.col("v"))).collect()] == [f"{v:.1f}" for v in (0.25, 0.75, 2.25, 2.35, 0.05, 1.0)]


def test_one_decimal_is_that_of_the_exact_value(spark):
    """Decimals that end in 5 lie a little beside their tie; Python's own format is exact."""
    values = [k / 100 for k in range(1, 20000, 2)] + [k / 20 for k in range(4000)] + [0.0, 0.04, 0.09999999999999999, 99.95, 99.96, 1e8 + 0.05, 3e9]
    values += [math.nextafter(v, way) for v in values if v for way in (0.0, math.inf)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", A.one_decimal(F.col("v")).alias("t")).collect()
    assert len(rows) == len(values) and [(r["v"], r["t"]) for r in rows if r["t"] != f"{r['v']:.1f}"] == []


def test_motion_reflects_at_walls(spark):
    r = generators.move(vehicles(spark, dict(id=1, x=95.0, vx=10.0)), 1.0, 100.0).first()
    assert (r["x"], r["vx"]) == (95.0, -10.0) and r["heading"] == pytest.approx(math.pi)


def test_road_grid(spark):
    roads, edges, meets = generators.grid_roads(spark, 3, 2, 50.0)
    assert (roads.count(), edges.count(), meets.count()) == (3 + 4, 24, 12)


def test_probe_of_batches(spark):
    """Arithmetic over whole batches, no function called step by step, finds what trying every step does."""
    rng = random.Random(5)
    rows = [dict(id=i, size=2.0 + i % 3, **{f"{p}{c}": float(rng.randrange(-n, n + 1)) / 2 for p, n in (("", 90), ("v", 40), ("a", 4)) for c in "xyz"}) for i in range(60)]
    pairs = D.closing(D.nearby(vehicles(spark, *rows)))
    found = D.probe(pairs)
    assert "lambda" not in optimized(found)

    def at(r, side, c, t):
        return r[f"{side}_{c}"] + r[f"{side}_v{c}"] * t + 0.5 * r[f"{side}_a{c}"] * t * t

    expected = {}
    for r in pairs.collect():
        for k in range(100):
            t = k * 0.1
            x, y, z = (at(r, "s", c, t) - at(r, "o", c, t) for c in "xyz")
            if (d := math.sqrt(x * x + y * y + z * z)) <= (r["s_size"] + r["o_size"]) / 2 + 5:
                expected[r["s_id"], r["o_id"]] = k, k * 0.1, d
                break
    got = {(r["s_id"], r["o_id"]): (r["hit_k"], r["ttc"], r["hit_distance"]) for r in found.collect()}
    assert got == expected and len({k for k, _, _ in got.values()}) > 10


def test_probe_of_nothing_known(spark):
    """A pair without a place has no hit and keeps no other from its own."""
    fleet = vehicles(spark, dict(id=1, x=0.0), dict(id=2, x=3.0), dict(id=3, x=6.0))
    pairs = D.closing(D.nearby(fleet)).withColumn("o_ax", F.when(F.col("o_id") != 3, F.col("o_ax")))
    assert {(r["s_id"], r["o_id"]) for r in D.probe(pairs).collect()} == {(1, 2), (3, 2), (2, 1), (3, 1)}


def test_rounding_is_that_of_the_sql(spark):
    values = [1.0000005, -1.0000005, 0.1234565, 2.5e-7, -2.5e-7, 5e-7, 123456.7890125, 9007199254740993.0, 4.6e15, 1e300, float("inf"), float("nan"), None, -0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["v"] for r in rounded(df, "v").collect()}
    for i, v in enumerate(values):
        (expected,) = duckdb.execute("select round(?::double, 6) + 0e0", [v]).fetchall()[0]
        assert got[i] == expected or (math.isnan(got[i]) and math.isnan(expected))


@pytest.mark.parametrize("shift", [0.0, -1e6])
def test_blocks_lose_no_pair(spark, shift):
    """Pairs by blocks of half of the neighbouring cells are those of the join, in cells with more rows than a block and with others, for both rules and the look-ahead."""
    rng = random.Random(7)
    rows = [dict(id=i, x=shift + rng.choice([100.0, float(rng.randrange(-300, 300))]), y=float(rng.randrange(-150, 150)), size=1.0 + i % 4, **{f"{p}{c}": float(rng.randrange(-n, n + 1)) / 2 for p, n in (("v", 30), ("a", 3)) for c in "xy"}) for i in range(500)]
    fleet = vehicles(spark, *rows).withColumn("history", F.lit(2)).localCheckpoint()
    pairs = D.nearby(fleet, symmetric=True)
    for approach in ("corrected", "literal"):
        met = lambda df: sorted((min(r["s_id"], r["o_id"]), max(r["s_id"], r["o_id"]), r["t_closest"], r["d_closest"]) for r in df.collect())
        expected = met(D.temporal_filter(pairs, approach=approach))
        assert met(D.approaching(fleet, approach=approach)) == expected and len(expected) > 100
        hit = lambda df: sorted((min(r["s_id"], r["o_id"]), max(r["s_id"], r["o_id"]), r["hit_k"], r["hit_distance"]) for r in df.collect())
        assert hit(D.probe(D.approaching(fleet, approach=approach, step=0.1))) == hit(D.probe(D.temporal_filter(pairs, approach=approach)))
    look = lambda df: sorted(map(tuple, df.collect()))
    assert look(D.lookahead(fleet, threshold=0.1)) == look(D.lookahead_of(D.nearby(fleet), threshold=0.1)) != []


def test_pairs_are_compared_in_blocks(spark):
    """No row of the join is one candidate pair: what meets in it are blocks."""
    plan = optimized(D.detect(generators.uniform_fleet(spark, 50)))
    join = plan[plan.index("Join Inner"):].split("\n", 1)[0]
    assert "_bx" in join and "MapInArrow" in plan and "s_x" not in join


@pytest.mark.parametrize("approach", ["corrected", "literal"])
def test_pairs_leave_the_blocks_without_their_motion(spark, approach):
    """What the blocks find equals the stages over rows, to the last bit; a pair is handed on as a risk needs it."""
    fleet = generators.uniform_fleet(spark, 300, width=300.0, seed=6).withColumn("heading", F.when(F.col("x") > 20, F.col("heading")))
    found = D.detect(fleet, approach=approach)
    by_rows = D.score(D.probe(D.temporal_filter(D.nearby(fleet, symmetric=True), approach=approach)), both=True)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(found) == rows(by_rows) != []
    assert "s_vx" not in optimized(found) and "s_vx" in optimized(by_rows)


def test_leaps_of_the_probe_miss_no_hit():
    """Steps that a pair's speed rules out are leapt over: few distances, the hits of trying every step."""
    rng = np.random.default_rng(3)
    m = 4000
    sides = [tuple((rng.integers(-100, 100, m) / 1.0, rng.integers(-20, 20, m) / 1.0, rng.integers(-2, 3, m) / 4.0) for _ in "so") for _ in "xy"]
    speed, safe = np.sqrt(sum((s[1] - o[1]) ** 2 for s, o in sides)), rng.integers(6, 11, m) / 1.0
    k, d = D.first_hits(sides, safe, speed, 0.1, 100)
    expected = np.full(m, -1)
    for j in reversed(range(100)):
        t = j * 0.1
        apart = np.sqrt(sum(((s[0] + s[1] * t + s[2] * t * t) - (o[0] + o[1] * t + o[2] * t * t)) ** 2 for s, o in sides))
        expected[apart <= safe] = j
    assert (k == expected).all() and (k >= 0).sum() > 100 and np.isnan(d[k < 0]).all()


def test_risks_of_one_vehicle(spark):
    """They are those of the whole fleet on either side, and the join's one side is that vehicle."""
    fleet = generators.city_fleet(spark, 400, 800.0, seed=11, partitions=2).localCheckpoint()
    pairs = lambda df: sorted((r["vehicle_id"], r["other_vehicle_id"], r["risk_level"], r["time_to_collision"]) for r in df.collect())
    whole = D.detect(fleet)
    busy = whole.groupBy("vehicle_id").count().orderBy(F.desc("count")).first()["vehicle_id"]
    expected = pairs(whole.where((F.col("vehicle_id") == busy) | (F.col("other_vehicle_id") == busy)))
    assert pairs(D.detect_of(fleet, busy)) == expected and len(expected) >= 2
