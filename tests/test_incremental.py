"""Incremental detection and the keyed store against what a whole table gives."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetra.operators import detect as D
from kinetra.operators import kv
from kinetra.operators.blocks import closest_tests
from kinetra.plans.streams import rocksdb
from kinetra.sources.store import KeyedStore
from kinetra.streaming import detect as SD


def vehicle(rng, i, ts, seq, x=None):
    x = rng.uniform(-150, 400) if x is None else x
    return (i, x, rng.uniform(-150, 400), 0.0, rng.uniform(-20, 20), rng.uniform(-20, 20), 0.0, 0.0, 0.0, 0.0, rng.uniform(0, 6), rng.choice([2.0, 4.0]), rng.choice(["car", "bus"]), float(ts), seq)


def test_incremental_detection_equals_batch_after_each_batch(spark, tmp_path):
    """Vehicles move between cells, report twice in a batch, late, or not at all; the last batch has one report, and only its neighbours are met again."""
    rng = random.Random(7)
    batches = [
        [vehicle(rng, i, 0, i) for i in range(60)],
        [vehicle(rng, i, 4 + k, 100 + 2 * i + k) for i in range(0, 60, 2) for k in (0, 1)] + [vehicle(rng, 1, -3, 500)],
        [vehicle(rng, i, 11, 600 + i) for i in range(0, 60, 5)],
        [vehicle(rng, 7, 12, 700)],
        [vehicle(rng, 7, 95, 800), vehicle(rng, 8, 95, 801)],
    ]
    folder, seen = f"file://{tmp_path}/d", []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SD.REPORT_DDL).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        reports = spark.readStream.schema(SD.REPORT_DDL).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        with rocksdb(spark):
            SD.incremental_detection(reports, folder, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        seen += rows
        fleet = kv.latest(spark.createDataFrame(seen, SD.REPORT_DDL), "id", "ts", "seq")
        as_of = F.lit(max(r[13] for r in seen))
        columns = ["vehicle_id", "other_vehicle_id", F.round("risk_level", 9)]
        expected = sorted(map(tuple, D.detect(fleet, as_of=as_of).select(*columns).collect()))
        assert sorted(map(tuple, SD.current_risks(spark, folder).select(*columns).collect())) == expected and (expected or n == 4)
    vehicles, risks = SD.stores(spark, folder)
    # the cost follows the reports: the batch of one report found risks of that vehicle alone
    log = spark.read.parquet(f"{folder}/risks/delta/*")
    assert log.where("700 in (seq, other_seq)").select("batch").distinct().join(log, "batch").where("7 not in (vehicle_id, other_vehicle_id)").count() == 0
    # the watermark (65 s) has passed the reports of all others
    stale = {r["id"] for r in vehicles.read().where("stale").collect()}
    assert stale == {*range(60)} - {7, 8}
    before = SD.holding(vehicles, risks).count()
    risks.compact(rows=SD.holding(vehicles, risks))
    vehicles.compact()
    assert SD.holding(vehicles, risks).count() == before == risks.read().count()


@pytest.fixture
def history(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/history", "id long, ts double, seq long, x double", ["id"], ["seq"], keep=3, ttl=60.0)


def test_store_of_several_batches_and_a_replayed_one(spark, history):
    rng, rows, schema = random.Random(1), [], "id long, ts double, seq long, x double"
    batches = [[(rng.randrange(8), float(10 * n + rng.random()), 1000 * n + k, rng.random()) for k in range(20)] for n in range(6)]

    def expected(as_of=None):
        out = []
        for i in range(8):
            out += sorted((r for r in rows if r[0] == i), key=lambda r: -r[2])[:3]
        return sorted(r for r in out if as_of is None or as_of <= r[1] + 60)

    assert history.read().count() == 0
    for n, batch in enumerate(batches):
        history.append(spark.createDataFrame(batch, schema), n)
        rows += batch
        if n in (2, 4):
            history.compact()
            history.append(spark.createDataFrame(batch, schema), n)  # the batch runs again after its rows have moved
        if n == 3:
            history.append(spark.createDataFrame(batch, schema), n)  # and again before
        assert sorted(map(tuple, history.read().collect())) == expected()
    assert sorted(map(tuple, history.read(F.lit(110.5)).collect())) == expected(110.5) != expected()
    assert history._numbers("base") == [2, 4] and history._numbers("delta") == [3, 4, 5]


def test_store_writes_no_rows_that_no_read_gives(spark, history, tmp_path):
    rows = spark.range(0, 400, 1, 2).selectExpr("id % 4 as id", "0D as ts", "id as seq", "0.5D as x")
    history.append(rows, 0)
    assert spark.read.parquet(f"{tmp_path}/history/delta/0").count() <= 2 * 4 * 3
    assert sorted(r["seq"] for r in history.read().collect()) == [*range(388, 400)]


def test_store_ignores_an_unfinished_base(spark, history, tmp_path):
    history.append(spark.createDataFrame([(1, 0.0, 1, 0.5)], "id long, ts double, seq long, x double"), 0)
    (tmp_path / "history" / "base" / "7").mkdir(parents=True)
    assert history.read().count() == 1


def test_pairs_of_a_cell_come_in_blocks():
    """What a cell finds is compared and handed on in blocks, not probe by probe, and is what all pairs show."""
    rng = np.random.default_rng(1)

    def reports(n, first, kind):
        numbers = {c: rng.uniform(0, 200, n) for c in SD.KNOWN} | {"id": np.arange(first, first + n), "type": ["car"] * n, "seq": np.ones(n, int), "history": np.ones(n, int)}
        return pd.DataFrame({"kind": kind} | numbers)

    class Residents(dict):
        iterator, updateValue = dict.items, dict.__setitem__

    cell = SD.Cell(100.0)
    cell.residents = Residents()
    for _ in cell.handleInputRows((0, 0), iter([reports(50, 1000, "enter")]), None):
        pass
    arrived = pd.concat([reports(350, 1, "enter"), reports(100, 5000, "probe")])
    frames = [f for f in cell.handleInputRows((0, 0), iter([arrived]), None) if (f["kind"] == "pair").any()]
    got = [p for f in frames for p in zip(f["s_id"], f["o_id"], f["dist"])]
    places, fresh, expected = {k[0]: v[:3] for k, v in cell.residents.items()}, {*range(1, 351)}, {}
    for row in arrived.itertuples():
        for other, place in places.items():
            d = np.sqrt(sum((a - b) ** 2 for a, b in zip((row.x, row.y, row.z), place)))
            if row.id != other and d <= 100 and (other > row.id or other not in fresh):
                expected[min(row.id, other), max(row.id, other)] = d
    assert {(s, o): d for s, o, d in got} == pytest.approx(expected) and len(got) == len(expected) > 15_000 and len(frames) <= 2


def test_cells_hand_on_pairs_at_risk_alone():
    """All pairs of a cell took most of the time of a stream: those without a hit stay where they were found, and are those that all pairs show."""
    rng = np.random.default_rng(2)
    n = 400
    numbers = {c: rng.uniform(0, 100, n) if c in "xy" else rng.uniform(-10, 10, n) if c[0] == "v" else np.zeros(n) for c in SD.KNOWN}
    numbers |= {"id": np.arange(n), "type": ["car"] * n, "size": np.full(n, 2.0), "seq": np.ones(n, int), "history": np.ones(n, int)}
    arrived, found = pd.DataFrame({"kind": "enter"} | numbers), []
    judge = D.judge_met(10.0, "corrected", 0.1)
    for cell in (SD.Cell(100.0), SD.Cell(100.0, judge, closest_tests(10.0, 1, 5.0), columns=SD.SCORED)):
        cell.residents = SD.Residents(None)
        found.append(pd.concat([f[f["kind"] == "pair"] for f in cell.handleInputRows((0, 0), iter([arrived]), None) if (f["kind"] == "pair").any()]))
    every, some = found
    s, o = ({c: every[f"{p}{c}"].to_numpy(float) for c in [*D.MOTION, "size"]} for p in ("s_", "o_"))
    left, k = judge(s, o)[:2]
    expected = sorted(zip(every["s_id"].to_numpy()[left], every["o_id"].to_numpy()[left], k))
    assert sorted(zip(some["s_id"], some["o_id"], some["hit_k"])) == expected and 0 < len(expected) < len(every) / 2


def test_vehicles_of_a_pack_move_in_one_call():
    """A call for each vehicle cost some ms: a batch of reports of many is one, whatever Arrow batches it comes in."""

    class Pack:
        value, timers = None, []
        get, update = (lambda self: self.value), (lambda self, value: setattr(self, "value", value))
        listTimers, deleteTimer, registerTimer = (lambda self: [*self.timers]), (lambda self, t: self.timers.remove(t)), (lambda self, t: self.timers.append(t))

    moves = SD.Moves(100.0, 10.0)
    moves.handle = moves.pack = Pack()
    reports = lambda *rows: pd.DataFrame([[*r, *[0.0] * 9, "car", ts, seq] for *r, ts, seq in rows], columns=SD.REPORT)
    told = [*moves.handleInputRows((0,), iter([reports((1, 50.0, 50.0, 0.0, 0), (2, 150.0, 50.0, 0.0, 1)), reports((1, 250.0, 50.0, 4.0, 2))]), None)]
    assert [(*r,) for r in pd.concat(told)[["id", "cx", "kind", "history"]].itertuples(index=False)] == [(1, 2, "enter", 2), (2, 1, "enter", 1)]
    told = [*moves.handleInputRows((0,), iter([reports((1, 50.0, 50.0, 1.0, 9), (2, 50.0, 50.0, 5.0, 3))]), None)]
    assert [(*r,) for r in pd.concat(told)[["id", "cx", "kind", "history"]].itertuples(index=False)] == [(2, 0, "enter", 2), (2, 1, "leave", 2)]
    assert len(moves.handle.timers) == 1


def test_streams_keep_state_in_few_parts(spark):
    """Each part costs a Python process and a commit a batch: 200 of them, the usual number, did not end in 150 s at sf0.1."""
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "200")
    try:
        with rocksdb(spark):
            assert int(spark.conf.get(name)) == max(8, spark.sparkContext.defaultParallelism)
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
