"""Density of the multi-resolution grid, level choice, splitting and merging, regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import grid as G

CELL = ("level", "cx", "cy", "cz")


def placed(fleet: DataFrame, level: int = 0) -> DataFrame:
    """The fleet with the cell of one level."""
    return fleet.select("*", F.lit(level).alias("level"), *G.cells(level))


def cell_counts(fleet: DataFrame, level: int = 0) -> DataFrame:
    return placed(fleet, level).groupBy(*CELL).agg(F.count("*").alias("vehicle_count"))


def grid_info(fleet: DataFrame, level: int = 0) -> DataFrame:
    """Count, density per volume and centre of each cell that holds vehicles."""
    sizes = [G.cell_size(F.col("level"), i) for i in range(3)]
    centre = [((F.col(f"c{c}") + 0.5) * s).alias(f"center_{c}") for c, s in zip("xyz", sizes)]
    return cell_counts(fleet, level).select(*CELL, *centre, sizes[0].alias("size"), "vehicle_count", (F.col("vehicle_count") / (sizes[0] * sizes[1] * sizes[2])).alias("density"))


def all_levels(fleet: DataFrame, max_level: int = K.GRID_MAX_LEVEL) -> DataFrame:
    """Every vehicle in its cell at every level, counted: four partial counts in one scan."""
    rows = fleet.select("x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("level"))
    return rows.select("level", *G.cells(F.col("level"))).groupBy(*CELL).agg(F.count("*").alias("vehicle_count"))


def qualifies(count: Column, level: Column, max_level: int = K.GRID_MAX_LEVEL) -> Column:
    """Whether a cell's count suits its level."""
    return F.when(level == 0, count < K.SPLIT_ABOVE).when(level == max_level, count > K.MERGE_BELOW).otherwise((count > K.MERGE_BELOW) & (count < K.SPLIT_ABOVE))


def best_level(fleet: DataFrame, max_level: int = K.GRID_MAX_LEVEL) -> DataFrame:
    """The finest level whose cell suits each vehicle, else 0."""
    fit = all_levels(fleet, max_level).where(qualifies(F.col("vehicle_count"), F.col("level"), max_level)).select(*CELL)
    rows = fleet.select("id", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("level")).select("id", "level", *G.cells(F.col("level")))
    found = rows.join(fit, list(CELL), "left_semi").groupBy("id").agg(F.max("level").alias("level"))
    return fleet.select("id").join(found, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def split_and_merge(cells: DataFrame, vehicles: DataFrame, max_level: int = K.GRID_MAX_LEVEL) -> DataFrame:
    """One pass: vehicles of cells above SPLIT_ABOVE go one level down, of cells below MERGE_BELOW one level up."""
    n, level = F.col("vehicle_count"), F.col("level")
    new = F.when((n > K.SPLIT_ABOVE) & (level < max_level), level + 1).when((n < K.MERGE_BELOW) & (level > 0), level - 1).otherwise(level)
    moved = vehicles.join(cells.select(*CELL, new.alias("to")), list(CELL)).select("id", F.col("to").alias("level"), *G.cells(F.col("to")))
    return moved.groupBy(*CELL).agg(F.count("*").alias("vehicle_count"))


def adjacent(regions: DataFrame) -> DataFrame:
    """Pairs of cells of one level at Manhattan distance 1, each once: six neighbours and an equi-join."""
    steps = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a, b, c in [(1, 0, 0), (0, 1, 0), (0, 0, 1)]))
    left = regions.select(*CELL, F.explode(steps).alias("d")).select("level", *(F.col(f"c{c}") for c in "xyz"), *((F.col(f"c{c}") + F.col(f"d.{c}")).alias(f"n{c}") for c in "xyz"))
    right = regions.select("level", *(F.col(f"c{c}").alias(f"n{c}") for c in "xyz"))
    return left.join(right, ["level", "nx", "ny", "nz"]).select("level", "cx", "cy", "cz", "nx", "ny", "nz")


def nearest_ancestor(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The finest region at or above each point's cell (id, level, cx, cy, cz); points without one are dropped."""
    up = points.select("id", "level", "cx", "cy", "cz", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("at"))
    up = up.select("id", F.col("at").alias("level"), *(G.parent(F.col(f"c{c}"), F.col("level") - F.col("at")).alias(f"c{c}") for c in "xyz"))
    return up.join(regions.select(*CELL), list(CELL)).groupBy("id").agg(F.max(F.struct(*CELL)).alias("r")).select("id", "r.*")


def region_counts(fleet: DataFrame, level: int, n_shards: int) -> DataFrame:
    """Regions, vehicles and share of load by shard."""
    regions = cell_counts(fleet, level).withColumn("shard_id", G.mixed(F.col("cx"), F.col("cy"), F.col("cz"), n_shards))
    return regions.groupBy("shard_id").agg(F.count("*").alias("regions"), F.sum("vehicle_count").alias("vehicles"))


def least_level(fleet: DataFrame, most: int = K.SPLIT_ABOVE, max_level: int = K.GRID_MAX_LEVEL) -> DataFrame:
    """Fixpoint of splitting alone: the coarsest level at which each vehicle's cell holds at most `most`, else the finest."""
    counts = reduce(lambda a, b: a.unionByName(b), [cell_counts(fleet, k) for k in range(max_level + 1)])
    rows = fleet.select("id", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("level")).select("id", "level", *G.cells(F.col("level")))
    ok = rows.join(counts.where(F.col("vehicle_count") <= most).select(*CELL), list(CELL), "left_semi").groupBy("id").agg(F.min("level").alias("level"))
    return fleet.select("id").join(ok, "id", "left").select("id", F.coalesce("level", F.lit(max_level)).alias("level"))
