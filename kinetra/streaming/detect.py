"""Continuous detection whose cost follows the reports, not the fleet.

Two states make it so. By vehicle, many of them packed
together: the newest report and the cell it lies in. By
cell: the reports that lie there. A new report enters its cell, leaves the one
before, and is shown to the cells around it; only the residents of these cells
meet it. What a batch finds is appended to a log of risks that name the reports
they were found in; a risk holds as long as both are the newest of their
vehicles, so that nothing has to be taken back when a vehicle moves on.

A vehicle whose report is older than STALE_AFTER seconds is no subject of risks
any more, but others still meet it. Reads see that from the report's time; a
timer tells when the watermark has passed it, too, so that compaction can drop
what no later read will ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from kinetra import constants as K
from kinetra.functions import kinematics as KN
from kinetra.operators import blocks as P
from kinetra.operators import detect as D
from kinetra.operators.spatial import both_ways
from kinetra.sources.store import KeyedStore
from kinetra.streaming.ingest import WATERMARK

#: What a vehicle reports, with the number seq of the report.
REPORT = ["id", *(f"{p}{c}" for p in ("", "v", "a") for c in "xyz"), "heading", "size", "type", "ts", "seq"]
#: With the number of the vehicle's reports so far.
KNOWN = [*REPORT, "history"]
#: What a risk is scored by, and what a look-ahead needs more.
SCORED, AHEAD = ["id", "ts", "seq", "size", "heading", "type"], ["x", "y", "z", "vx", "vy", "vz", "history"]
TYPES = {"id": "long", "type": "string", "seq": "long", "history": "long", "hit_k": "long"}
REPORT_DDL, KNOWN_DDL = (", ".join(f"{c} {TYPES.get(c, 'double')}" for c in names) for names in (REPORT, KNOWN))
MOVE_DDL = f"cx long, cy long, kind string, {KNOWN_DDL}"
LOOKAHEADS = "vehicle_id long, other_vehicle_id long, seq long, other_seq long, risk_level double, time_to_collision double, relative_velocity double, ts double, batch long"
#: A pair's risk is the same from both sides: it is kept once, the smaller id first, with the times of both reports.
RISKS = "vehicle_id long, other_vehicle_id long, seq long, other_seq long, ts double, other_ts double, risk_level double, time_to_collision double, distance double, relative_speed double, batch long"
VEHICLES = "id long, ts double, seq long, stale boolean, batch long"
#: Added to event times, as a stream takes what is no later than 1970 for late, and reports may count from any origin.
ORIGIN = 1e9
#: Pairs that a cell hands on at a time.
PAIRS = 200_000
#: Batches after which the logs are compacted.
COMPACT_EVERY = 20
#: Packs of vehicles: a vehicle alone would cost some ms a report, mostly calls.
PACKS = 256
#: What a pack knows of a vehicle.
HELD = np.dtype([("id", "<i8"), ("ts", "<f8"), ("seq", "<i8"), ("cx", "<i8"), ("cy", "<i8"), ("history", "<i8"), ("stale", "?")])


class Moves(StatefulProcessor):
    """By pack of vehicles: of a batch's reports of each the newest, if it is newer than the one before, as rows for the cells that it enters and leaves."""

    def __init__(self, cell: float, stale_after: float):
        self.cell, self.stale_after = cell, stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pack = handle.getValueState("pack", "vehicles binary")

    def goes_stale(self, ts: np.ndarray) -> np.ndarray:
        """When reports of that time are too old, in milliseconds of event time."""
        return (1000 * (ORIGIN + ts + self.stale_after)).astype(np.int64) + 1

    def held(self) -> np.ndarray:
        """The vehicles of the pack, by id."""
        pack = self.pack.get()
        return np.frombuffer(pack[0] if pack else b"", HELD)

    def put(self, held: np.ndarray) -> None:
        """Keep the vehicles, with one timer for the first of them to go stale."""
        self.pack.update((held.tobytes(),))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if not held["stale"].all():
            self.handle.registerTimer(int(self.goes_stale(held["ts"][~held["stale"]]).min()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, counts = None, None
        for batch in rows:
            n = batch.groupby("id").size()
            counts = n if counts is None else counts.add(n, fill_value=0)
            newest = pd.concat([newest, batch]).sort_values(["id", "ts", "seq"], kind="stable").drop_duplicates("id", keep="last")
        held, newest = self.held(), newest.reset_index(drop=True)
        ids = newest["id"].to_numpy(np.int64)
        at = np.searchsorted(held["id"], ids)
        known = at < len(held)
        known[known] = held["id"][at[known]] == ids[known]
        before = np.zeros(len(ids), HELD)
        before[known] = held[at[known]]
        ts, seq = newest["ts"].to_numpy(float), newest["seq"].to_numpy(np.int64)
        newer = ~known | (ts > before["ts"]) | ((ts == before["ts"]) & (seq > before["seq"]))
        if not newer.any():
            return
        told, before, known = newest[newer].reset_index(drop=True), before[newer], known[newer]
        now = np.zeros(len(told), HELD)
        for c in ("id", "ts", "seq"):
            now[c] = told[c]
        now["cx"], now["cy"] = (np.floor(told[c].to_numpy(float) / self.cell) for c in "xy")
        now["history"] = counts.loc[now["id"]].to_numpy(np.int64) + before["history"]
        told["history"] = now["history"]
        kept = np.concatenate([held[~np.isin(held["id"], now["id"])], now])
        self.put(kept[np.argsort(kept["id"], kind="stable")])
        yield self.rows(told, now["cx"], now["cy"], "enter")
        gone = known & ((now["cx"] != before["cx"]) | (now["cy"] != before["cy"]))
        if gone.any():
            yield self.rows(told[gone], before["cx"][gone], before["cy"][gone], "leave")

    def rows(self, told: pd.DataFrame, cx: np.ndarray, cy: np.ndarray, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"cx": cx, "cy": cy, "kind": kind} | {c: told[c].to_numpy() for c in KNOWN})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held().copy()
        # all that the watermark has passed, whichever of them set the timer
        late = ~held["stale"] & (self.goes_stale(held["ts"]) <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        held["stale"] |= late
        self.put(held)
        gone = held[late]
        numbers = {c: gone[c] if c in HELD.names else np.full(len(gone), np.nan) for c in KNOWN} | {"type": np.full(len(gone), None, object)}
        yield self.rows(pd.DataFrame(numbers), gone["cx"], gone["cy"], "stale")

    def close(self) -> None:
        pass


def found_columns(columns: list[str]) -> list[str]:
    return ["kind", *(f"{p}{c}" for p in ("s_", "o_") for c in columns), "dist", "hit_k", "hit_distance", "speed"]


def found_ddl(columns: list[str]) -> str:
    """What a cell finds: the columns of both sides, and of pairs with a hit its step, the distance there and the speed; step -1 is none."""
    return ", ".join(f"{c} {'string' if c == 'kind' else TYPES.get(c.removeprefix('s_').removeprefix('o_'), 'double')}" for c in found_columns(columns))


class Residents(dict):
    """The reports of a cell by id, packed as one value: a call for each would cost more than the cell's pairs."""

    types = pa.schema([(c, {"long": pa.int64(), "string": pa.string()}.get(TYPES.get(c), pa.float64())) for c in KNOWN])

    def __init__(self, pack: tuple | None):
        rows = pa.ipc.read_record_batch(pa.py_buffer(pack[0]), self.types) if pack else None
        super().__init__(((row[0],), row[1:]) for row in (zip(*(c.to_pylist() for c in rows.columns)) if rows else ()))

    def iterator(self):
        return self.items()

    def updateValue(self, key: tuple, value: tuple) -> None:
        self[key] = value

    def removeKey(self, key: tuple) -> None:
        self.pop(key, None)

    def pack(self) -> tuple:
        columns = zip(*((*k, *v) for k, v in self.items())) if self else [[] for _ in KNOWN]
        return (pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.types)], schema=self.types).serialize().to_pybytes(),)


#: Of both sides' columns taken for the pairs: numbers of those that have a hit, its steps, distances and speeds.
Judge = Callable[[dict, dict], tuple[np.ndarray, ...]]


class Cell(StatefulProcessor):
    """By cell: the reports that lie in it. Reports that enter it or are shown to it meet those within the radius; each pair of two new reports is found once.

    judge: of such pairs those with a hit are handed on, tests: which may have
    one. also: which are handed on besides, of both sides and their distances.
    Without any, all are.
    """

    state = None

    def __init__(self, radius: float, judge: Judge | None = None, tests: P.Tests = P.EVERYWHERE, also: Callable[[dict, dict, np.ndarray], np.ndarray] | None = None, columns: list[str] = KNOWN):
        self.radius, self.judge, self.tests, self.also, self.columns = radius, judge, tests, also, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("residents", "reports binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([*rows])
        if self.state:
            self.residents = Residents(self.state.get())
        told = arrived[arrived["kind"].isin(("enter", "stale"))]
        if len(told):
            # the newest report of a vehicle, for those who read the log
            yield self.frame(told["kind"].to_numpy(), [(told, np.arange(len(told))), (None, None)])
        for gone in arrived.loc[arrived["kind"] == "leave", "id"]:
            self.residents.removeKey((int(gone),))
        entered = arrived[arrived["kind"] == "enter"]
        for row in entered[KNOWN].itertuples(index=False):
            self.residents.updateValue((int(row.id),), (*map(float, row[1:12]), row.type, float(row.ts), int(row.seq), int(row.history)))
        if self.state and arrived["kind"].isin(("enter", "leave")).any():
            self.state.update(self.residents.pack())
        probes = arrived.loc[arrived["kind"].isin(("enter", "probe")), KNOWN].reset_index(drop=True)
        held = pd.DataFrame([(*k, *v) for k, v in self.residents.iterator()] if len(probes) else [], columns=KNOWN)
        if len(held):
            yield from self.pairs(probes, held, held["id"].isin(entered["id"]).to_numpy())

    def pairs(self, probes: pd.DataFrame, held: pd.DataFrame, fresh: np.ndarray) -> Iterator[pd.DataFrame]:
        tiles, waiting, n = P.new_tiles(), [], 0
        reach = self.radius * self.radius * (1 + P.SLACK) + P.SLACK
        names = [*D.MOTION, "size", "history"]
        s_all, o_all = ({c: side[c].to_numpy(float) for c in names} for side in (probes, held))
        own, ids = probes["id"].to_numpy(np.int64), held["id"].to_numpy(np.int64)
        # what is handed on besides hits is within the radius, too, but may pass no test of theirs
        tests = P.EVERYWHERE if self.also or not self.judge else self.tests
        for begin in range(0, len(held), P.BLOCK):
            o = {c: v[begin : begin + P.BLOCK] for c, v in o_all.items()}
            for row, col, dist in P.near(s_all, o, reach, tests, tiles):
                col = col + begin
                # a resident that is new as well is shown to the probe's own cell, too
                left = np.flatnonzero((dist <= self.radius) & ((ids[col] > own[row]) | ((ids[col] < own[row]) & ~fresh[col])))
                row, col, dist = row[left], col[left], dist[left]
                s, o_taken = P.taken(s_all, row), P.taken(o_all, col)
                k, d, speed = np.full(len(row), -1, np.int64), np.full(len(row), np.nan), np.full(len(row), np.nan)
                keep = np.full(len(row), self.judge is None)
                if self.judge:
                    hit, at, gap, fast = self.judge(s, o_taken)[:4]
                    k[hit], d[hit], speed[hit], keep[hit] = at, gap, fast, True
                if self.also:
                    keep |= self.also(s, o_taken, dist)
                waiting.append([c[keep] for c in (row, col, dist, k, d, speed)])
                n += int(keep.sum())
                if n >= PAIRS:
                    yield self.met(probes, held, own, ids, waiting)
                    waiting, n = [], 0
        if n:
            yield self.met(probes, held, own, ids, waiting)

    def met(self, probes: pd.DataFrame, held: pd.DataFrame, own: np.ndarray, ids: np.ndarray, waiting: list) -> pd.DataFrame:
        """Pairs as rows, the smaller id first."""
        row, col, *rest = (np.concatenate(c) for c in zip(*waiting))
        both, first = pd.concat([probes, held], ignore_index=True), own[row] < ids[col]
        sides = np.where(first, row, col + len(probes)), np.where(first, col + len(probes), row)
        return self.frame("pair", [(both, side) for side in sides], *rest)

    def frame(self, kind, sides: list, dist=np.nan, k=-1, d=np.nan, speed=np.nan) -> pd.DataFrame:
        """Rows of found_ddl(), in types that Arrow takes for them: a side may be missing."""
        n = len(sides[0][1])
        out = {"kind": np.full(n, kind, object) if isinstance(kind, str) else kind}
        for p, (rows, taken) in zip(("s_", "o_"), sides):
            for c in self.columns:
                if rows is not None:
                    out[f"{p}{c}"] = rows[c].to_numpy().take(taken)
                elif TYPES.get(c) == "long":
                    out[f"{p}{c}"] = pd.array([None] * n, "Int64")
                else:
                    out[f"{p}{c}"] = np.full(n, None, object) if c == "type" else np.full(n, np.nan)
        return pd.DataFrame(out | {"dist": dist, "hit_k": k, "hit_distance": d, "speed": speed})

    def close(self) -> None:
        pass


def may_look_ahead(threshold: float):
    """Pairs that lookahead_of() may report, a little wider than it."""

    def also(s, o, dist):
        with np.errstate(all="ignore"):
            future = np.sqrt(sum(np.square((s[c] + s[f"v{c}"] * K.LOOKAHEAD) - (o[c] + o[f"v{c}"] * K.LOOKAHEAD)) for c in KN.AXES))
            speed = np.sqrt(sum(np.square(s[f"v{c}"] - o[f"v{c}"]) for c in KN.AXES))
            risk = np.minimum(1.0, 2 * K.CONTACT_RADIUS / np.maximum(0.1, future) * speed / 10)
            away = (future > dist + 1e-6) & (dist > 2 * K.CONTACT_RADIUS + 1e-6)
            return (dist <= K.LOOKAHEAD_DISTANCE) & (s["history"] >= 2) & (o["history"] >= 2) & ~away & (risk >= threshold - 1e-6)

    return also


def meetings(reports: DataFrame, radius: float = K.SEARCH_RADIUS, stale_after: float = K.STALE_AFTER, watermark: str = WATERMARK, window: float = K.TIME_WINDOW, lookahead: float | None = None) -> DataFrame:
    """Rows of a stream of reports: pairs at risk of which one has just reported (kind `pair`, the smaller id as s_) and, with lookahead, a least risk level, those that may be due ahead; the newest reports (`enter`) and vehicles without one for so long (`stale`) as s_. What has no id, place or time is no report."""
    timed = reports.select(*REPORT, F.timestamp_micros(((F.col("ts") + ORIGIN) * 1e6).cast("long")).alias("time")).withWatermark("time", watermark).na.drop(subset=["id", "x", "y", "ts", "seq"])
    # a little wider than the radius, so that rounding puts no neighbour two cells away
    cell = radius * (1 + 1e-9) + 1e-6
    packed = timed.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(PACKS)))
    moves = packed.groupBy("pack").transformWithStateInPandas(Moves(cell, stale_after), MOVE_DDL, "append", "eventTime")
    steps = [F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (0, -1, 1) for j in (0, -1, 1)]
    shown = moves.withColumn("_d", F.explode(F.when(F.col("kind") == "enter", F.array(*steps)).otherwise(F.array(steps[0]))))
    aside = (F.col("_d.x") != 0) | (F.col("_d.y") != 0)
    shown = shown.select((F.col("cx") + F.col("_d.x")).alias("cx"), (F.col("cy") + F.col("_d.y")).alias("cy"), F.when(aside, "probe").otherwise(F.col("kind")).alias("kind"), *KNOWN)
    columns = [*SCORED, *(AHEAD if lookahead is not None else [])]
    cells = Cell(radius, D.judge_met(window, "corrected", K.PROBE_STEP), P.closest_tests(window, 1, K.SAFE_DISTANCE_BASE), None if lookahead is None else may_look_ahead(lookahead), columns)
    return shown.groupBy("cx", "cy").transformWithStateInPandas(cells, found_ddl(columns), "append", "none")


def stores(spark: SparkSession, folder: str) -> tuple[KeyedStore, KeyedStore]:
    """The logs of vehicles and of risks that a detection keeps in a folder."""
    return KeyedStore(spark, f"{folder}/vehicles", VEHICLES, ["id"], ["ts", "seq", "stale"]), KeyedStore(spark, f"{folder}/risks", RISKS, ["vehicle_id", "other_vehicle_id"], ["batch"])


def lookahead_store(spark: SparkSession, folder: str) -> KeyedStore:
    return KeyedStore(spark, f"{folder}/lookahead", LOOKAHEADS, ["vehicle_id", "other_vehicle_id"], ["batch"])


def holding(vehicles: KeyedStore, risks: KeyedStore) -> DataFrame:
    """Risks found in the newest reports of both vehicles, but for those of which a timer has told each possible subject stale.

    Reports meet once, so that no row has to be told from another of its
    pair; and what the last batch of reports found was found in the newest ones.
    """
    known, rows = vehicles.read(), risks.rows()
    last = vehicles.rows().where("not stale").agg(F.max("batch")).first()[0]
    keep = rows.where(F.col("batch") < last)
    for side, seq in (("vehicle_id", "seq"), ("other_vehicle_id", "other_seq")):
        keep = keep.join(known.select(F.col("id").alias(side), F.col("seq").alias(seq)), [side, seq], "left_semi")
    rows = keep.select(*rows.columns).unionByName(rows.where(F.col("batch") >= last))
    stale = known.where("stale").select("id")
    if stale.isEmpty():
        return rows
    for side in ("vehicle_id", "other_vehicle_id"):
        rows = rows.join(stale.select(F.col("id").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    gone = F.col("_vehicle_id").isNotNull()
    if "other_ts" in rows.columns:  # from both sides
        gone &= F.col("_other_vehicle_id").isNotNull()
    return rows.where(~gone).drop("_vehicle_id", "_other_vehicle_id")


def _current(vehicles: KeyedStore, risks: KeyedStore, as_of: Column | None, stale_after: float) -> DataFrame:
    rows = holding(vehicles, risks)
    if "other_ts" in rows.columns:
        rows = both_ways(rows.withColumnsRenamed({f"{n}{c}": f"{p}{c}" for n, p in (("", "s_"), ("other_", "o_")) for c in ("vehicle_id", "ts", "seq")}), vehicle_id="vehicle_id", ts="ts", seq="seq")
        rows = rows.withColumnsRenamed({f"{p}{c}": f"{n}{c}" for n, p in (("", "s_"), ("other_", "o_")) for c in ("vehicle_id", "ts", "seq")}).drop("other_ts")
        rows = rows.withColumn("risk_id", D.risk_id("vehicle_id", "other_vehicle_id", "ts"))
        stale = vehicles.read().where("stale").select(F.col("id").alias("vehicle_id"))
        if not stale.isEmpty():
            rows = rows.join(stale, "vehicle_id", "left_anti")
    if as_of is None:
        as_of = vehicles.read().agg(F.max("ts")).scalar()
    return rows.where(as_of - F.col("ts") <= stale_after)


def current_risks(spark: SparkSession, folder: str, as_of: Column | None = None, stale_after: float = K.STALE_AFTER) -> DataFrame:
    """Risks that hold at a time, that of the newest report of all if none is given."""
    return _current(*stores(spark, folder), as_of, stale_after)


def current_lookahead(spark: SparkSession, folder: str, as_of: Column | None = None, stale_after: float = K.STALE_AFTER) -> DataFrame:
    """Look-ahead risks that hold at a time, of vehicles with two reports or more."""
    return _current(stores(spark, folder)[0], lookahead_store(spark, folder), as_of, stale_after)


def _turned(pairs: DataFrame) -> DataFrame:
    """Pairs with their sides changed."""
    return pairs.select(*(F.col(f"{q}{c}").alias(f"{p}{c}") for p, q in (("s_", "o_"), ("o_", "s_")) for c in [*SCORED, *AHEAD]), "dist")


def incremental_detection(reports: DataFrame, folder: str, checkpoint: str, every: str = "500 milliseconds", window: float = K.TIME_WINDOW, lookahead: float | None = None) -> DataStreamWriter:
    """Keep the logs of which current_risks() reads from a stream of reports (vehicle columns and seq); with lookahead, a least risk level, those of current_lookahead(), too.

    Logs are written by batch number, so a batch that runs twice leaves them as
    they were; compaction drops risks that no longer hold.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark, number = batch.sparkSession, F.lit(n).cast("long").alias("batch")
        found = batch.persist()
        vehicles, risks = stores(spark, folder)
        vehicles.append(found.where("kind <> 'pair'").select(F.col("s_id").alias("id"), F.col("s_ts").alias("ts"), F.col("s_seq").alias("seq"), (F.col("kind") == "stale").alias("stale"), number), n)
        pairs = found.where("kind = 'pair'").drop("kind")
        ttc = F.col("hit_k") * F.lit(K.PROBE_STEP)
        sides = [F.col(f"{p}{c}").alias(f"{name}{told}") for c, told in (("id", "vehicle_id"), ("seq", "seq"), ("ts", "ts")) for p, name in (("s_", ""), ("o_", "other_"))]
        scored = pairs.where("hit_k >= 0").select(*sides, KN.risk_level(F.col("hit_distance"), ttc, F.col("speed")).alias("risk_level"), ttc.alias("time_to_collision"), F.col("hit_distance").alias("distance"), F.col("speed").alias("relative_speed"), number)
        risks.append(scored, n)
        logs = [risks]
        if lookahead is not None:
            logs.append(lookahead_store(spark, folder))
            pairs = pairs.drop("hit_k", "hit_distance", "speed").where("s_history >= 2 and o_history >= 2")
            due = D.lookahead_of(pairs.unionByName(_turned(pairs)), threshold=lookahead, carry=("seq",))
            logs[1].append(due.withColumnsRenamed({"vehicle_id1": "vehicle_id", "vehicle_id2": "other_vehicle_id"}).withColumn("batch", number), n)
        found.unpersist()
        if n % COMPACT_EVERY == COMPACT_EVERY - 1:
            for log in logs:
                log.compact(rows=holding(vehicles, log))
            vehicles.compact()

    return meetings(reports, window=window, lookahead=lookahead).writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(run)
