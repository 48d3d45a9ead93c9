"""Seeded fleets and road maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra import constants as K

TYPES = tuple(K.VEHICLE_SIZES)


def _among(values, k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def _typed(rows: DataFrame, seed: int) -> DataFrame:
    kind = F.floor(F.rand(seed) * len(TYPES))
    return rows.withColumn("_k", kind).withColumns({"type": _among(TYPES, F.col("_k")), "size": _among(K.VEHICLE_SIZES.values(), F.col("_k"))}).drop("_k")


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", *(F.col(c).cast("double").alias(c) for c in "x y z vx vy vz ax ay az heading size".split()), "type", F.lit(0.0).alias("ts"))


def city_fleet(spark: SparkSession, n: int, width: float = 10_000.0, in_cities: float = 0.8, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """80 % of the vehicles in five discs (four quarter points and the centre), the rest anywhere; speed 5 to 20."""
    q = width / 4
    discs = [(q, q, q * 0.4), (3 * q, q, q * 0.4), (q, 3 * q, q * 0.4), (3 * q, 3 * q, q * 0.4), (2 * q, 2 * q, q * 0.8)]
    rows = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).select(F.col("id").cast("string").alias("id"), F.rand(seed).alias("u"), F.floor(F.rand(seed + 1) * 5).alias("disc"), (F.rand(seed + 2) * 2 * F.pi()).alias("angle"), F.sqrt(F.rand(seed + 3)).alias("r"), (F.rand(seed + 4) * 2 * F.pi()).alias("heading"), (5 + 15 * F.rand(seed + 5)).alias("speed"), (F.rand(seed + 6) * width).alias("ux"), (F.rand(seed + 7) * width).alias("uy"))
    city = F.col("u") < in_cities
    at = lambda i: _among([d[i] for d in discs], F.col("disc"))
    rows = rows.withColumns({
        "x": F.when(city, at(0) + at(2) * F.col("r") * F.cos("angle")).otherwise(F.col("ux")), "y": F.when(city, at(1) + at(2) * F.col("r") * F.sin("angle")).otherwise(F.col("uy")),
        "vx": F.col("speed") * F.cos("heading"), "vy": F.col("speed") * F.sin("heading"), **{c: F.lit(0.0) for c in ("z", "vz", "ax", "ay", "az")},
    })
    return _columns(_typed(rows, seed + 8))


def uniform_fleet(spark: SparkSession, n: int, seed: int = 1, width: float = 10_000.0) -> DataFrame:
    """Random load: anywhere, with acceleration and any size from 1 to 5."""
    span = {"x": (0, width), "y": (0, width), "z": (0, 100), "vx": (-20, 20), "vy": (-20, 20), "vz": (-5, 5), "ax": (-2, 2), "ay": (-2, 2), "az": (-1, 1), "heading": (0, 6.283185307179586), "size": (1, 5)}
    rows = spark.range(n).select(F.concat(F.lit("vehicle-"), (F.col("id") + 1).cast("string")).alias("id"), *((F.rand(seed + i) * (b - a) + a).alias(c) for i, (c, (a, b)) in enumerate(span.items())), _among(TYPES, F.floor(F.rand(seed + 20) * len(TYPES))).alias("type"))
    return _columns(rows)


def grid_roads(spark: SparkSession, width: int, height: int, cell: float, road_width: float = 5.0, speed_limit: float = 13.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roads, edges, intersections) of a grid of (height + 1) + (width + 1) straight roads; every horizontal meets every vertical one."""
    across = spark.range(height + 1).select(F.concat(F.lit("h"), "id").alias("id"), F.lit(0.0).alias("x1"), (F.col("id") * cell).alias("y1"), F.lit(width * cell).alias("x2"), (F.col("id") * cell).alias("y2"))
    up = spark.range(width + 1).select(F.concat(F.lit("v"), "id").alias("id"), (F.col("id") * cell).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * cell).alias("x2"), F.lit(height * cell).alias("y2"))
    roads = across.unionByName(up).select("id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit(road_width).alias("width"), F.lit(speed_limit).alias("speed_limit"))
    meet = spark.range((height + 1) * (width + 1)).select(F.concat(F.lit("h"), (F.col("id") / (width + 1)).cast("long")).alias("h"), F.concat(F.lit("v"), F.col("id") % (width + 1)).alias("v"), (F.col("id") % (width + 1) * cell).cast("double").alias("x"), ((F.col("id") / (width + 1)).cast("long") * cell).cast("double").alias("y"))
    edges = meet.select(F.col("h").alias("road"), F.col("v").alias("next")).unionByName(meet.select(F.col("v").alias("road"), F.col("h").alias("next")))
    return roads, edges, meet.select(F.concat_ws("-", "h", "v").alias("id"), "x", "y")


def random_roads(spark: SparkSession, n_roads: int, n_cities: int, width: float = 10_000.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(roads, cities) at random places."""
    u = lambda i: F.rand(seed + i) * width
    roads = spark.range(n_roads).select(F.concat(F.lit("road-"), "id").alias("id"), *(u(i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.lit(5.0).alias("width"), F.lit(13.9).alias("speed_limit"))
    cities = spark.range(n_cities).select(F.concat(F.lit("city-"), "id").alias("id"), u(10).alias("x"), u(11).alias("y"), (500 + F.rand(seed + 12) * 1500).alias("radius"), F.rand(seed + 13).alias("density"))
    return roads, cities


def next_roads(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """Roads one hop from each vehicle's road (id, road)."""
    return positions.select("id", "road").join(edges, "road").select("id", "road", "next")


def move(fleet: DataFrame, seconds: float, width: float = 10_000.0, steps: int = 1) -> DataFrame:
    """Fleet after some steps: positions and velocities advance, and walls reflect. A step is a projection; many steps stay one plan."""
    for _ in range(steps):
        moved = {c: F.col(c) + F.col(f"v{c}") * seconds + 0.5 * F.col(f"a{c}") * seconds * seconds for c in "xyz"}
        speed = {c: F.col(f"v{c}") + F.col(f"a{c}") * seconds for c in "xyz"}
        out = {}
        for c in "xy":
            p = moved[c]
            hit = (p < 0) | (p > width)
            out[c] = F.when(p < 0, -p).when(p > width, 2 * width - p).otherwise(p)
            out[f"v{c}"] = F.when(hit, -speed[c]).otherwise(speed[c])
        out |= {"z": moved["z"], "vz": speed["z"], "ts": F.col("ts") + seconds}
        fleet = fleet.withColumns(out)
        fleet = fleet.withColumn("heading", F.when((F.col("vx") == 0) & (F.col("vy") == 0), F.col("heading")).otherwise(F.pmod(F.atan2("vy", "vx"), 2 * F.pi())))
    return fleet
