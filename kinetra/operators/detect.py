"""Collision detection: multi-stage kinematic risk, linear look-ahead, contact and time to contact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import kinematics as KN
from kinetra.operators.blocks import block_pairs, closest_tests, reach_pairs
from kinetra.operators.spatial import both_ways, radius_pairs


def nearby(fleet: DataFrame, radius: float = K.SEARCH_RADIUS, cell_size: float | None = None, symmetric: bool = False) -> DataFrame:
    """Pairs within a radius, boundary included."""
    return radius_pairs(fleet, fleet, f"{float(radius)!r}D", cell_size or radius, symmetric=symmetric)


def nearby_sized(fleet: DataFrame, radius: float, cell_size: float = 50.0) -> DataFrame:
    """Others (s_id, o_id, dist) whose distance is at most radius plus their own size."""
    judge = lambda s, o, dist: (dist <= float(radius) + o["size"], dist)
    return reach_pairs(fleet, f"{float(radius)!r}D", "size", cell_size, judge, ["size"]).withColumnRenamed("value", "dist")


def closing(pairs: DataFrame) -> DataFrame:
    """Relative speed, approach product and time of closest approach of each pair."""
    w, r = KN.relative_velocity(), KN.relative_position()
    return pairs.withColumns({"speed": KN.norm(*w), "approach": KN.dot(r, w)})


def staged(pairs: DataFrame, name: str, value: Column, keep: Column) -> DataFrame:
    """Column `name` for the pairs that meet `keep`; the others go.

    As the output of a generator it is evaluated once: later filters are not
    pushed below it, and its expression is not copied into them.
    """
    return pairs.withColumn(name, F.explode(F.when(keep, F.array(value))))


def temporal_filter(pairs: DataFrame, window: float = K.TIME_WINDOW, approach: str = "corrected") -> DataFrame:
    """Pairs that come within their safe distance at their closest approach in the window.

    approach="literal" keeps the sign convention of the original rule, which
    drops what approaches from more than 5 m.
    """
    pairs = closing(pairs)
    sign = 1 if approach == "corrected" else -1
    # try_divide, as filters may be merged and evaluated in any order
    t = F.try_divide(sign * F.col("approach"), F.col("speed") * F.col("speed"))
    keep = F.col("speed") >= K.MIN_RELATIVE_SPEED
    if approach == "literal":
        keep &= ~((F.col("approach") > 0) & (F.col("dist") > 5))
    pairs = staged(pairs, "t_closest", t, keep).where((F.col("t_closest") >= 0) & (F.col("t_closest") <= window))
    return pairs.withColumn("d_closest", KN.distance_at(F.col("t_closest"))).where(F.col("d_closest") <= KN.safe_distance())


def approaching(fleet: DataFrame, radius: float = K.SEARCH_RADIUS, window: float = K.TIME_WINDOW, approach: str = "corrected", columns: list[str] | None = None, step: float | None = None) -> DataFrame:
    """The pairs of temporal_filter() within a radius, each once, in either order: blocks leave what may meet it. With step, only those with a hit on the grid of probe(), which is found in the same pass over their blocks."""
    tests = closest_tests(window, 1 if approach == "corrected" else -1, K.SAFE_DISTANCE_BASE)
    motion = [f"{k}{c}" for k in ("", "v", "a") for c in KN.AXES]


    def probed(s, o):
        speed = np.sqrt(sum(np.square(s[f"v{c}"] - o[f"v{c}"]) for c in KN.AXES))
        sides = [tuple((m[c], m[f"v{c}"], 0.5 * m[f"a{c}"]) for m in (s, o)) for c in KN.AXES]
        with np.errstate(all="ignore"):
            k, d = first_hits(sides, (s["size"] + o["size"]) / 2 + K.SAFE_DISTANCE_BASE, speed, step, int(window / step))
        left = np.flatnonzero(k >= 0)
        return left, _listed(k[left], d[left])

    columns = list(dict.fromkeys([*motion, "size", *(columns or ["id", "heading", "type", "ts"])]))
    pairs = block_pairs(fleet, radius, tests, [*motion, "size"], columns, last=(probed, HITS) if step else None)
    return temporal_filter(pairs.where(F.col("dist") <= radius), window, approach)


HITS = "array<array<struct<k:int,d:double>>>"
#: hits with what else score() needs of a pair's motion
MET = "array<array<struct<k:int,d:double,speed:double,cx:double,cy:double,cz:double>>>"


def _listed(k: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """First hits, -1 for none, with their distances and what else is given, as HITS or MET."""
    hit = np.concatenate(([0], np.cumsum(k >= 0))).astype(np.int32)
    names = ["k", "d", "speed", "cx", "cy", "cz"][: 1 + len(columns)]
    values = pa.StructArray.from_arrays([pa.array(c[k >= 0]) for c in (k, *columns)], names)
    return pa.ListArray.from_arrays(hit, pa.ListArray.from_arrays(np.arange(hit[-1] + 1, dtype=np.int32), values))


MOTION = [f"{k}{c}" for k in ("", "v", "a") for c in KN.AXES]


def judge_met(window: float, approach: str, step: float):
    """Which pairs, by MOTION and size of both sides, temporal_filter() keeps and probe() finds a hit of, term for term as there: their numbers, first steps and distances there, speeds, and a place by axis at a time."""
    sign = 1 if approach == "corrected" else -1

    def at(m, c, t):
        return m[c] + m[f"v{c}"] * t + 0.5 * m[f"a{c}"] * t * t

    def norm(x, y, z):
        return np.sqrt(x * x + y * y + z * z)

    def judged(s, o):
        with np.errstate(all="ignore"):
            r, w = [o[c] - s[c] for c in KN.AXES], [s[f"v{c}"] - o[f"v{c}"] for c in KN.AXES]
            speed, product, safe = norm(*w), r[0] * w[0] + r[1] * w[1] + r[2] * w[2], (s["size"] + o["size"]) / 2 + K.SAFE_DISTANCE_BASE
            t = sign * product / (speed * speed)
            keep = (speed >= K.MIN_RELATIVE_SPEED) & (t >= 0) & (t <= window) & (norm(*(at(s, c, t) - at(o, c, t) for c in KN.AXES)) <= safe)
            if approach == "literal":
                keep &= ~((product > 0) & (norm(*r) > 5))
            left = np.flatnonzero(keep)
            s, o = ({c: m[c].take(left) for c in MOTION} for m in (s, o))
            k, d = first_hits([tuple((m[c], m[f"v{c}"], 0.5 * m[f"a{c}"]) for m in (s, o)) for c in KN.AXES], safe[left], speed[left], step, int(window / step))
            hit = k >= 0
            ttc = k * step
            return left[hit], k[hit], d[hit], speed[left][hit], *(((at(s, c, ttc) + at(o, c, ttc)) / 2)[hit] for c in KN.AXES)

    return judged


def met(fleet: DataFrame, radius: float, window: float, approach: str, step: float) -> DataFrame:
    """The pairs of temporal_filter() with a hit of probe(), each once, in either order, as probe() and score() take them.

    Both are found in the pass over the blocks, term for term as there, so
    that a pair is handed on without its motion: that took most of the time.
    """
    judged = judge_met(window, approach, step)

    def last(s, o):
        left, *found = judged(s, o)
        return left, _listed(*found)

    tests = closest_tests(window, 1 if approach == "corrected" else -1, K.SAFE_DISTANCE_BASE)
    pairs = block_pairs(fleet, radius, tests, [*MOTION, "size"], ["id", "ts", "size", "heading", "type"], last=(last, MET))
    return pairs.where(F.col("dist") <= radius)


def hits(step: float, n: int) -> Column:
    """Of the steps 0 to n - 1 the first at which a pair is within its safe distance, as {k, d} in the list of its stride; pairs without one have no list.

    Steps that first_hits() rules out have no hit and are not tried. Runs over columns of
    a batch of pairs, with the terms of distance_at().
    """
    motion = [F.col(f"{p}{k}{c}").cast("double") for c in KN.AXES for p in ("s_", "o_") for k in ("", "v", "a")]

    @F.arrow_udf(HITS)
    def found(safe: pa.Array, speed: pa.Array, *motion: pa.Array) -> pa.Array:
        safe, speed, *motion = (c.to_numpy(zero_copy_only=False) for c in (safe, speed, *motion))
        # by axis: place, velocity and half the acceleration of both sides
        sides = [[(*motion[i : i + 2], 0.5 * motion[i + 2]) for i in (j, j + 3)] for j in (0, 6, 12)]
        with np.errstate(all="ignore"):
            k, d = first_hits(sides, safe, speed, step, n)
        return _listed(k, d)

    return F.flatten(found(KN.safe_distance().cast("double"), F.col("speed").cast("double"), *motion))


def first_hits(sides: list, safe: np.ndarray, speed: np.ndarray, step: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first step of each pair within its safe distance, -1 for none, and the distance there.

    Along the line between them a pair comes nearer by its closing speed and
    by half its acceleration times the square of the time, at the most: what
    that rules out is leapt over. The speed at the start, which callers give,
    bounds that less closely and is not used.
    """
    first, at = np.full(len(safe), -1, np.int32), np.full(len(safe), np.nan)
    pull = np.sqrt(sum((2 * (s[2] - o[2])) ** 2 for s, o in sides))
    # an axis in which nothing lies or moves adds nothing
    moving = [side for side in sides if any(c.any() for part in side for c in part)] or sides[:1]
    # of the pairs that are left, a row for each term
    rows, k, motion = np.arange(len(safe)), np.zeros(len(safe), np.int64), np.array([safe, pull, *(c for side in moving for part in side for c in part)])
    while len(rows):
        safe, pull = motion[:2]
        t, total, closing = k * step, 0.0, 0.0
        for p, v, a, q, w, b in motion[2:].reshape(-1, 6, len(rows)):
            apart = (p + v * t + a * t * t) - (q + w * t + b * t * t)
            total = total + apart * apart
            closing = closing - apart * ((v - w) + 2 * (a - b) * t)
        d = np.sqrt(total)
        hit = d <= safe
        first[rows[hit]], at[rows[hit]] = k[hit], d[hit]
        with np.errstate(all="ignore"):
            gap, closing = d - safe - 1e-6, closing / d
            leap = 2 * gap / (closing + np.sqrt(closing * closing + 2 * pull * gap)) / step * (1 - 1e-9)
        # what is not a number is not ruled out, but tried step by step; who only moves away, without a pull, does not come back
        leap = np.where((pull == 0) & (closing <= 0) & (gap > 0), n, leap)
        k = k + np.fmin(np.fmax(np.ceil(leap), 1), n).astype(np.int64)
        left = np.flatnonzero(~hit & (k < n))
        rows, k, motion = rows[left], k[left], motion.take(left, axis=1)
    return first, at


def probe(pairs: DataFrame, window: float = K.TIME_WINDOW, step: float = K.PROBE_STEP) -> DataFrame:
    """First time on the grid 0, step, … at which a pair (with its speed) is within its safe distance; pairs without one are dropped. Hits that approaching() or met() has found are not sought again."""
    # a generator's rows: later filters stay above it, and the probe is run once
    found = F.flatten("found") if "found" in pairs.columns else hits(step, int(window / step))
    pairs = pairs.withColumn("hit", F.explode(F.slice(found, 1, 1)))
    pairs = pairs.withColumns({c: F.col(f"hit.{c}") for c in pairs.schema["hit"].dataType.names if c not in ("k", "d")})
    return pairs.withColumns({"ttc": F.col("hit.k") * F.lit(step), "hit_distance": F.col("hit.d"), "hit_k": F.col("hit.k")}).drop("hit", "found")


def midpoint(t: Column) -> list[Column]:
    return [(p + q) / 2 for p, q in zip(KN.position_at(t, "s_"), KN.position_at(t, "o_"))]


def risk_id(vehicle: str, other: str, ts: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in (vehicle, other, ts))), 256)


def score(pairs: DataFrame, offset: Column | None = None, both: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Risk rows of probed pairs; offset shifts the time of predicted ones; both reports a pair from either side; carry names more columns of the vehicles, which come out as name and other_name."""
    ttc = F.col("ttc")
    x, y, z = midpoint(ttc) if "cx" not in pairs.columns else map(F.col, ("cx", "cy", "cz"))
    total = ttc if offset is None else ttc + offset
    level = KN.risk_level(F.col("hit_distance"), ttc, F.col("speed"))
    out = pairs.select("s_id", "o_id", "s_ts", "o_ts", *(f"{p}{c}" for c in carry for p in ("s_", "o_")), total.alias("time_to_collision"), F.col("hit_distance").alias("distance"), F.col("speed").alias("relative_speed"), level.alias("risk_level"), x.alias("cx"), y.alias("cy"), z.alias("cz"))
    if both:
        out = both_ways(out, id="id", ts="ts", **{c: c for c in carry})
    return out.select(
        risk_id("s_id", "o_id", "s_ts").alias("risk_id"),
        F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_vehicle_id"), "time_to_collision", "distance", "relative_speed", "risk_level",
        "cx", "cy", "cz", F.col("s_ts").alias("ts"), F.lit(offset is not None).alias("is_predicted"), *(F.col(f"{p}{c}").alias(n + c) for c in carry for p, n in (("s_", ""), ("o_", "other_"))),
    )


def risk_of(distance: np.ndarray, ttc: np.ndarray, speed: np.ndarray, safe: np.ndarray, angle: np.ndarray, same_type: np.ndarray) -> np.ndarray:
    """KN.risk_level() of columns, term for term."""
    w = K.RISK_WEIGHTS
    total = w["distance"] * (1 - distance / safe) + w["time"] * (1 - np.minimum(1.0, ttc / K.MAX_WARNING_TIME)) + w["speed"] * np.minimum(1.0, speed / K.MAX_RELATIVE_SPEED)
    return np.maximum(0.0, np.minimum(1.0, total + w["angle"] * np.sin(angle) + w["type"] * np.where(same_type, K.SAME_TYPE, K.OTHER_TYPE)))


def distinct_ids(fleet: DataFrame) -> bool:
    """Is each vehicle one row? Then so is each pair, and nothing has to be merged."""
    return fleet.groupBy("id").count().where("count > 1").isEmpty()


def detect(fleet: DataFrame, radius: float = K.SEARCH_RADIUS, window: float = K.TIME_WINDOW, approach: str = "corrected", as_of: Column | None = None, stale_after: float = K.STALE_AFTER) -> DataFrame:
    """Risks of every ordered pair of the fleet: near, approaching, probed, scored. All terms are symmetric: each pair is evaluated once and reported from both sides.

    With as_of, a time, vehicles that reported more than stale_after seconds
    before are no subjects; as neighbours they stay.
    """
    pairs = met(fleet, radius, window, approach, K.PROBE_STEP)
    if as_of is not None:
        pairs = pairs.where(as_of - F.greatest("s_ts", "o_ts") <= stale_after)
    risks = score(probe(pairs, window), both=True)
    return risks if as_of is None else risks.where(as_of - F.col("ts") <= stale_after)


def detect_of(fleet: DataFrame, vehicle_id, radius: float = K.SEARCH_RADIUS, window: float = K.TIME_WINDOW, approach: str = "corrected") -> DataFrame:
    """The risks of detect() in which a vehicle is on either side: the pair join sees that vehicle and its others alone."""
    pairs = radius_pairs(fleet.where(F.col("id") == vehicle_id), fleet, f"{float(radius)!r}D", radius)
    return score(probe(temporal_filter(pairs, window, approach), window), both=True)


def lookahead_of(pairs: DataFrame, seconds: float = K.LOOKAHEAD, threshold: float = K.LOOKAHEAD_RISK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Constant-velocity risk at a fixed horizon of pairs; carry names more columns of the vehicles, which come out as name and other_name."""
    pairs = pairs.where(F.col("dist") <= K.LOOKAHEAD_DISTANCE)
    s, o = KN.position_at(F.lit(seconds), "s_", accelerate=False), KN.position_at(F.lit(seconds), "o_", accelerate=False)
    pairs = pairs.withColumns({"future": KN.norm(*(p - q for p, q in zip(s, o))), "speed": KN.norm(*KN.relative_velocity())})
    away = (F.col("future") > F.col("dist")) & (F.col("dist") > 2 * K.CONTACT_RADIUS)
    pairs = pairs.where(~away).withColumn("risk_level", KN.lookahead_risk(F.col("future"), F.col("speed"))).where(F.col("risk_level") >= threshold)
    ttc = KN.lookahead_time(F.col("dist"), F.col("future"))
    return pairs.select(
        risk_id("s_id", "o_id", "s_ts").alias("risk_id"), F.col("s_ts").alias("ts"),
        F.col("s_id").alias("vehicle_id1"), F.col("o_id").alias("vehicle_id2"), "risk_level", (F.col("s_ts") + ttc).alias("estimated_collision_time"),
        *(((p + q) / 2).alias(f"p{c}") for p, q, c in zip(s, o, "xyz")), F.col("speed").alias("relative_velocity"), ttc.alias("time_to_collision"),
        *(F.col(f"{p}{c}").alias(n + c) for c in carry for p, n in (("s_", ""), ("o_", "other_"))),
    )


def lookahead(fleet: DataFrame, seconds: float = K.LOOKAHEAD, threshold: float = K.LOOKAHEAD_RISK) -> DataFrame:
    """Constant-velocity risk at a fixed horizon for vehicles with two history rows or more (column history)."""
    return lookahead_of(nearby(fleet.where("history >= 2"), K.SEARCH_RADIUS), seconds, threshold)


def contacts(fleet: DataFrame, cell_size: float = 20.0) -> DataFrame:
    """Ordered pairs closer than the sum of their sizes, strictly. Evaluated once a pair, then reported from both sides."""
    pairs = radius_pairs(fleet, fleet, "s_size", cell_size, "dist < s_size + o_size", symmetric=True, other_reach="o_size")
    return both_ways(pairs.select("s_id", "o_id", "dist"), id="id").select(F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_vehicle_id"), F.col("dist").alias("distance"))


def encounters(fleet: DataFrame, closing_speed: float = K.CLOSING_SPEED, horizon: float = K.CONTACT_HORIZON, cell_size: float = 50.0) -> DataFrame:
    """Contacts and times to contact of the whole fleet in one search: time_to_contact is null for pairs in contact."""
    gap, touching = "(dist - s_size - o_size)", "dist < s_size + o_size"
    near = f"{touching} or (dist <= 10 * s_size + o_size and {gap} >= 0 and {gap} / {closing_speed!r}D <= {horizon!r}D)"
    slim = fleet.select("id", *"xyz", "size")
    out = f"s_id as vehicle_id, o_id as other_vehicle_id, dist as distance, case when not ({touching}) then {gap} / {closing_speed!r}D end as time_to_contact"
    return radius_pairs(slim, slim, "10 * s_size", cell_size, near, other_reach="o_size", out=out)


def time_to_contact(fleet: DataFrame, closing_speed: float = K.CLOSING_SPEED, horizon: float = K.CONTACT_HORIZON, cell_size: float = 25.0) -> DataFrame:
    """Pairs not in contact whose gap closes at a given speed within the horizon: those of encounters(), sought by blocks, as a whole fleet's are many."""

    def judge(s, o, dist):
        gap = dist - s["size"] - o["size"]
        time = gap / closing_speed
        return (dist <= 10 * s["size"] + o["size"]) & (gap >= 0) & (time <= horizon), time

    found = reach_pairs(fleet, "10 * size", "size", cell_size, judge, ["size"])
    return found.select(F.col("s_id").alias("vehicle_id"), F.col("o_id").alias("other_vehicle_id"), F.col("value").alias("time_to_contact"))


def merge(risks: DataFrame, scope: str = "subject") -> DataFrame:
    """The highest risk of each pair, earliest first among equals. scope="subject" keeps (a, b) and (b, a) apart, "global" joins them."""
    pair = ["vehicle_id", "other_vehicle_id"] if scope == "subject" else [F.least("vehicle_id", "other_vehicle_id"), F.greatest("vehicle_id", "other_vehicle_id")]
    order = W.partitionBy(*pair).orderBy(F.desc("risk_level"), "time_to_collision", "vehicle_id")
    return risks.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def remove_vehicle(risks: DataFrame, gone: DataFrame) -> DataFrame:
    """Risks that involve none of the ids in gone (column id), on either side."""
    for side in ("vehicle_id", "other_vehicle_id"):
        risks = risks.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    return risks
