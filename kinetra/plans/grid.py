"""Queries of the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra import fixtures as X
from kinetra.functions import grid as G
from kinetra.operators import grid_stats as S
from kinetra.plans import base as B
from kinetra.plans.base import rounded


def cell_sql(level: str) -> str:
    size = f"(1000e0 / pow(2e0, {level}))"
    return f"cast(trunc(x / {size}) as int) as cx, cast(trunc(y / {size}) as int) as cy, cast(trunc(z / (100e0 / pow(2e0, {level}))) as int) as cz"


FLEET = f"with {B.fleet_sql()}"
LEVELS = f"""{FLEET}, rows as (select id, x, y, z, cast(l as int) as level, {cell_sql("l")} from fleet, range(0, 4) as g(l)),
levels as (select level, cx, cy, cz, count(*) as vehicle_count from rows group by all)"""


def grid_cells(spark, sf):
    return S.placed(X.fleet(spark, sf), 2).select("id", *S.CELL)


def grid_stats(spark, sf):
    return S.all_levels(X.fleet(spark, sf)).groupBy("level").agg(F.count("*").alias("cells"), F.sum("vehicle_count").alias("vehicles"), F.max("vehicle_count").alias("largest"))


def cell_density(spark, sf):
    return rounded(S.grid_info(X.fleet(spark, sf), 1), "density", places=12)


def grid_rollup(spark, sf):
    cells = S.placed(X.fleet(spark, sf), 1)
    return cells.rollup("level", "cx", "cy").agg(F.count("*").alias("vehicles"), F.countDistinct("type").alias("types")).select("level", "cx", "cy", "vehicles", "types")


def grid_levels(spark, sf):
    return S.best_level(X.fleet(spark, sf))


def grid_split_merge(spark, sf):
    fleet = X.fleet(spark, sf)
    return S.split_and_merge(S.cell_counts(fleet, 1), S.placed(fleet, 1))


def grid_least_level(spark, sf):
    return S.least_level(X.fleet(spark, sf))


def grid_parent(spark, sf):
    shifted = X.fleet(spark, sf).withColumn("x", F.col("x") - 1000)
    cells = S.placed(shifted, 3)
    return cells.select("id", "cx", "cy", G.parent(F.col("cx")).alias("px"), G.parent(F.col("cy"), 2).alias("py"))


def grid_children(spark, sf):
    cells = S.cell_counts(X.fleet(spark, sf), 1)
    return cells.select("cx", "cy", "cz", F.explode(G.children(F.col("cx"), F.col("cy"), F.col("cz"))).alias("child")).select("cx", "cy", "cz", F.col("child.cx").alias("child_x"), F.col("child.cy").alias("child_y"), F.col("child.cz").alias("child_z"))


def region_adjacency(spark, sf):
    return S.adjacent(S.all_levels(X.fleet(spark, sf)).select(*S.CELL))


def ancestor_lookup(spark, sf):
    fleet = X.fleet(spark, sf)
    regions = S.all_levels(fleet).where((F.col("vehicle_count") > 30) & (F.col("level") < 3))
    return S.nearest_ancestor(S.placed(fleet, 3), regions)


def shard_stats(spark, sf):
    return S.region_counts(X.fleet(spark, sf), 2, 10)


QUERIES = {
    "grid_cells": (grid_cells, f"{FLEET} select id, 2 as level, {cell_sql('2')} from fleet"),
    "grid_stats": (grid_stats, f"{LEVELS} select level, count(*) as cells, cast(sum(vehicle_count) as bigint) as vehicles, max(vehicle_count) as largest from levels group by level"),
    "cell_density": (cell_density, f"""{LEVELS} select level, cx, cy, cz, (cx + 0.5e0)*500 as center_x, (cy + 0.5e0)*500 as center_y, (cz + 0.5e0)*50 as center_z, 500e0 as size, vehicle_count,
  round(vehicle_count/(500e0*500e0*50e0), 12) + 0e0 as density from levels where level = 1"""),
    "grid_rollup": (grid_rollup, f"{FLEET}, c as (select 1 as level, type, {cell_sql('1')} from fleet) select level, cx, cy, count(*) as vehicles, count(distinct type) as types from c group by rollup (level, cx, cy)"),
    "grid_levels": (grid_levels, f"""{LEVELS}, fit as (select * from levels where case level when 0 then vehicle_count < 50 when 3 then vehicle_count > 10 else vehicle_count > 10 and vehicle_count < 50 end),
best as (select id, max(level) as level from rows join fit using (level, cx, cy, cz) group by id) select id, coalesce(level, 0) as level from fleet left join best using (id)"""),
    "grid_least_level": (grid_least_level, f"""{LEVELS}, best as (select id, min(level) as level from rows join (select * from levels where vehicle_count <= 50) using (level, cx, cy, cz) group by id)
select id, coalesce(level, 3) as level from fleet left join best using (id)"""),
    "grid_split_merge": (grid_split_merge, f"""{LEVELS}, moved as (select x, y, z, cast(case when vehicle_count > 50 then 2 when vehicle_count < 10 then 0 else 1 end as int) as level from rows join levels using (level, cx, cy, cz) where level = 1),
placed as (select level, {cell_sql("level")} from moved) select level, cx, cy, cz, count(*) as vehicle_count from placed group by all"""),
    "grid_parent": (grid_parent, f"""{FLEET}, c as (select id, {cell_sql("3")} from (select * replace (x - 1000 as x) from fleet))
select id, cx, cy, cast(floor(cx/2e0) as int) as px, cast(floor(cy/4e0) as int) as py from c"""),
    "grid_children": (grid_children, f"{LEVELS} select cx, cy, cz, cast(2*cx + i as int) as child_x, cast(2*cy + j as int) as child_y, cast(2*cz + k as int) as child_z from levels, range(0, 2) as a(i), range(0, 2) as b(j), range(0, 2) as c(k) where level = 1"),
    "region_adjacency": (region_adjacency, f"""{LEVELS} select a.level, a.cx, a.cy, a.cz, b.cx as nx, b.cy as ny, b.cz as nz from levels a join levels b on a.level = b.level
  and abs(a.cx - b.cx) + abs(a.cy - b.cy) + abs(a.cz - b.cz) = 1 and (a.cx, a.cy, a.cz) < (b.cx, b.cy, b.cz)"""),
    "ancestor_lookup": (ancestor_lookup, f"""{LEVELS}, regions as (select level, cx, cy, cz from levels where vehicle_count > 30 and level < 3),
up as (select r.id, cast(l as int) as level, cast(floor(r.cx/pow(2e0, 3 - l)) as int) as cx, cast(floor(r.cy/pow(2e0, 3 - l)) as int) as cy, cast(floor(r.cz/pow(2e0, 3 - l)) as int) as cz from rows r, range(0, 4) as g(l) where r.level = 3)
select id, level, cx, cy, cz from up join regions using (level, cx, cy, cz) qualify row_number() over (partition by id order by level desc) = 1"""),
    "shard_stats": (shard_stats, f"""{LEVELS}, h as (select *, cx::bigint*73856093 + cy::bigint*19349663 + cz::bigint*83492791 as v from levels where level = 2)
select cast(((v % 10) + 10) % 10 as int) as shard_id, count(*) as regions, cast(sum(vehicle_count) as bigint) as vehicles from h group by 1"""),
}
