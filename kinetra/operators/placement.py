"""Placement of tasks, shards and resources on nodes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import grid as G
from kinetra.operators.ranking import placed
from kinetra.sources.scratch import written

#: Control tables that one greedy fold may read: nodes, shards and cells of one system.
FOLD_ROWS = 1_000_000


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where("status = 'active'")


def least_loaded(nodes: DataFrame, load: str, by: list[str], id_: str = "node_id") -> DataFrame:
    """The node of least load (smallest id among equals) of each group, or of all with by=[]."""
    return nodes.groupBy(*by).agg(F.min(F.struct(load, id_)).alias("n")).select(*by, f"n.{id_}", f"n.{load}")


def assign_tasks(tasks: DataFrame, nodes: DataFrame, load: str = "cpu_usage") -> DataFrame:
    """Detection tasks go to the least loaded active node of their grid, if it has one; all others to the least loaded active node.

    A node has one grid, or several in an array grid_ids. Both tables of choices are aggregates with a row for each grid and one in
    all, so the tasks are never shuffled.
    """
    live = active(nodes)
    by_grid = live.withColumn("grid", F.explode("grid_ids")) if "grid_ids" in live.columns else live
    of_grid = least_loaded(by_grid, load, ["grid"]).select("grid", F.col("node_id").alias("of_grid"))
    anywhere = least_loaded(live, load, []).select(F.col("node_id").alias("anywhere"))
    joined = tasks.join(of_grid, "grid", "left").join(F.broadcast(anywhere), how="left")
    local = (F.col("task_type") == "collision_detection") & F.col("of_grid").isNotNull()
    return joined.select("task_id", F.when(local, F.col("of_grid")).otherwise(F.col("anywhere")).alias("node_id"))


def task_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("priority"), "created_at", "task_id")


def timed_out(tasks: DataFrame, as_of: Column) -> DataFrame:
    return tasks.where(as_of - F.col("created_at") > F.col("timeout"))


def lifecycle(tasks: DataFrame, results: DataFrame, assigned: DataFrame, as_of: Column) -> DataFrame:
    """State of each task: completed or failed if a result came, else timed_out, assigned or pending."""
    rows = tasks.join(results.select("task_id", "success"), "task_id", "left").join(assigned, "task_id", "left")
    late = as_of - F.col("created_at") > F.col("timeout")
    state = F.when(F.col("success"), "completed").when(~F.col("success"), "failed").when(late, "timed_out").when(F.col("node_id").isNotNull(), "assigned").otherwise("pending")
    return rows.select("task_id", state.alias("state"))


def load_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes"), F.avg("cpu_usage").alias("cpu_mean"), F.stddev_pop("cpu_usage").alias("cpu_std"), F.avg("memory_usage").alias("memory_mean"), F.stddev_pop("memory_usage").alias("memory_std"))


def imbalance(nodes: DataFrame, over: float = K.OVER_FACTOR, under: float = K.UNDER_FACTOR) -> DataFrame:
    """over if cpu or memory is above over * mean, under if both are below under * mean; one row of means is broadcast."""
    means = nodes.agg(F.avg("cpu_usage").alias("cpu"), F.avg("memory_usage").alias("mem"))
    rows = nodes.join(F.broadcast(means))
    high = (F.col("cpu_usage") > over * F.col("cpu")) | (F.col("memory_usage") > over * F.col("mem"))
    low = (F.col("cpu_usage") < under * F.col("cpu")) & (F.col("memory_usage") < under * F.col("mem"))
    return rows.select("node_id", F.when(high, "over").when(low, "under").otherwise("normal").alias("class"))


def shard_load(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node's cpu divided evenly among its shards."""
    n = F.count("*").over(W.partitionBy("node_id"))
    return shards.join(nodes.select("node_id", "cpu_usage"), "node_id").select("shard_id", "node_id", "vehicle_count", (F.col("cpu_usage") / n).alias("load"))


def node_stats(shards: DataFrame) -> DataFrame:
    return shards.groupBy("node_id").agg(F.count("*").alias("shards"), F.sum("vehicle_count").alias("vehicles"))


def reassign(shards: DataFrame, nodes: DataFrame, failed: Column) -> DataFrame:
    """Shards of failed nodes move to the least loaded active node that has not failed."""
    target = least_loaded(active(nodes).where(~failed), "cpu_usage", []).select(F.col("node_id").alias("target"))
    gone = nodes.where(failed).select("node_id", F.lit(True).alias("gone"))
    rows = shards.join(gone, "node_id", "left").join(F.broadcast(target), how="left")
    return rows.select("shard_id", F.col("node_id").alias("was"), F.when(F.col("gone"), F.col("target")).otherwise(F.col("node_id")).alias("node_id"))


def current(changelog: DataFrame, key: str, *order: str) -> DataFrame:
    """Registry state from a log of put/delete rows (op): the newest row of each key, unless it deletes."""
    rest = [c for c in changelog.columns if c != key and c not in order]
    return changelog.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, "r.*").where("op = 'put'")


def elected(votes: DataFrame, known: int) -> DataFrame:
    """Distinct granted votes by term and candidate, and whether they are a majority of the known nodes. A voter's first candidate of a term counts."""
    first = votes.where("granted").groupBy("term", "voter").agg(F.min_by("candidate", "seq").alias("candidate"))
    return first.groupBy("term", "candidate").agg(F.count("*").alias("votes")).withColumn("leader", F.col("votes") * 2 > known)


def _fold(table: DataFrame, fold, schema: str) -> DataFrame:
    """A greedy fold over one control table. It is ordered by nature; the table's size is checked, and larger ones must be divided by system first."""
    if table.limit(FOLD_ROWS + 1).count() > FOLD_ROWS:
        raise ValueError(f"a greedy fold takes at most {FOLD_ROWS} rows; group the table by system")
    return table.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda rows: fold(rows.drop(columns="one")), schema)


def greedy_shards(cells: DataFrame, n_shards: int) -> DataFrame:
    """Cells (cell, load) in order to the shard of least load, the smallest among equals."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, loads, out = rows.sort_values("cell"), [0] * n_shards, []
        for load in rows["load"]:
            shard = min(range(n_shards), key=lambda k: (loads[k], k))
            loads[shard] += int(load)
            out.append(shard)
        return rows.assign(shard_id=out)[["cell", "load", "shard_id"]]

    return _fold(cells, fold, "cell long, load long, shard_id int")


def _deal(leaving: DataFrame, takers: DataFrame, deal, item: str, target: str) -> DataFrame:
    """What leaves meets the takers' rows in one place, ordered by `deal`; all other rows stay where they are."""
    one = F.lit(1).alias("one")
    return leaving.groupBy(one).cogroup(takers.groupBy(one)).applyInPandas(deal, f"{item} long, target {target}")


def rebalance_cells(cells: DataFrame, n_shards: int, over: float = K.OVER_FACTOR, under: float = K.UNDER_FACTOR, enough: float = K.TARGET_FACTOR) -> DataFrame:
    """Cells (cell, load, shard_id) that leave shards above over * mean for shards below under * mean.

    A shard's heaviest cells leave as long as what is left of its load exceeds
    the mean, which is a running sum within the shard. They go, the fullest
    shard's first, each to the taker of least load (smallest id among equals);
    if after that the least load of all takers exceeds enough * mean, that
    taker drops out. Cells stay when no taker is left.
    """
    held = cells.groupBy("shard_id").agg(F.sum("load").alias("held"))
    shards = cells.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard_id")).join(held, "shard_id", "left").fillna(0, ["held"])
    loads = shards.join(F.broadcast(shards.agg(F.avg("held").alias("mean"))))
    running = W.partitionBy("shard_id").orderBy(F.desc("load"), "cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    givers = F.broadcast(loads.where(F.col("held") > over * F.col("mean")))
    leaving = cells.join(givers, "shard_id").withColumn("rest", F.col("held") - F.sum("load").over(running)).where("rest > mean")

    def deal(moves: pd.DataFrame, takers: pd.DataFrame) -> pd.DataFrame:
        moves = moves.sort_values(["held", "shard_id", "rest", "cell"], ascending=[False, True, False, True])
        heap, targets = list(zip(takers["has"], takers["taker"])), []
        heapq.heapify(heap)
        for weight in moves["load"][: len(moves) if heap else 0]:
            lightest = heap[0]
            targets.append(lightest[1])
            heapq.heapreplace(heap, (lightest[0] + weight, lightest[1]))
            if heap[0][0] > enough * takers["of_all"].iat[0]:
                heapq.heappop(heap)
            if not heap:
                break
        return pd.DataFrame({"cell": moves["cell"][: len(targets)], "target": targets})

    takers = loads.where(F.col("held") < under * F.col("mean")).select(F.col("shard_id").alias("taker"), F.col("held").alias("has"), F.col("mean").alias("of_all"))
    dealt = _deal(leaving, takers, deal, "cell", "int")
    return cells.join(dealt, "cell", "left").select("cell", "load", F.col("shard_id").alias("was"), F.coalesce("target", "shard_id").alias("shard_id"))


def rebalance_nodes(shards: DataFrame, over: float = K.OVER_FACTOR, under: float = K.UNDER_FACTOR) -> DataFrame:
    """Shards (shard_id, node_id, vehicle_count, load, node_load) of nodes above over * mean load, dealt to the nodes below under * mean.

    All shards of such nodes, node by node and those of most vehicles first,
    form one line of loads. Each taker, by id, takes the stretch of the line
    that brings it to under * mean; behind the last taker's, shards stay. The
    end of a stretch is a search in the line's running sums.
    """
    nodes = shards.groupBy("node_id").agg(F.max("node_load").alias("node_load"))
    loads = nodes.join(F.broadcast(nodes.agg(F.avg("node_load").alias("mean")))).withColumn("room", under * F.col("mean") - F.col("node_load"))
    leaving = shards.join(F.broadcast(loads.where(F.col("node_load") > over * F.col("mean")).select("node_id")), "node_id", "left_semi")

    def deal(moves: pd.DataFrame, takers: pd.DataFrame) -> pd.DataFrame:
        moves = moves.sort_values(["node_id", "vehicle_count", "shard_id"], ascending=[True, False, True])
        line, ends = moves["load"].cumsum().to_numpy(), [0]
        takers = takers.sort_values("taker")
        for room in takers["free"]:
            before = line[ends[-1] - 1] if ends[-1] else 0.0
            ends.append(min(len(line), int(np.searchsorted(line, before + room)) + 1))
        target = np.repeat(takers["taker"].to_numpy(), np.diff(ends))
        return pd.DataFrame({"shard_id": moves["shard_id"][: len(target)], "target": target})

    takers = loads.where("room > 0").select(F.col("node_id").alias("taker"), F.col("room").alias("free"))
    dealt = _deal(leaving, takers, deal, "shard_id", "long")
    return shards.join(dealt, "shard_id", "left").select("shard_id", F.col("node_id").alias("was"), F.coalesce("target", "node_id").alias("node_id"))


def region_plan(regions: DataFrame, n_shards: int, high: float = 0.7, low: float = 0.3, max_level: int = K.GRID_MAX_LEVEL) -> DataFrame:
    """Plan of a rebalance of regions of one cell each (cell, level, cx, cy, cz, vehicle_count, shard_id) by load, a shard's vehicles against those of the fullest.

    The largest region of each shard above `high` is split into eight: the
    first part stays, the others go to shards below `low`, one each, then to
    new shards, numbered from n_shards. Then the shards below `low` that are
    left are paired: the first two regions of a pair that touch are merged and
    go to the first of the two; pairing ends with a pair without such regions.
    A row for each part and each merged cell, with its place, the region that
    it is in then, and its shard before and after. Shards without regions have
    no load.
    """

    shards = regions.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard_id")).union(regions.select(F.col("shard_id").cast("int"))).distinct()
    held = regions.groupBy("shard_id").agg(F.sum("vehicle_count").alias("load"), F.min(F.struct((-F.col("vehicle_count")).alias("size"), "cell", "level", "cx", "cy", "cz")).alias("largest"))
    loads = written(shards.join(held, "shard_id", "left").fillna(0, ["load"]))
    # what later conditions need of all shards is one row each
    of_all = loads.agg(F.max("load").alias("most"), (F.max("shard_id") + 1).alias("new"))
    judged = loads.join(F.broadcast(of_all))
    full = placed(judged.where((F.col("load") > high * F.col("most")) & (F.col("largest.level") < max_level)).select("shard_id", "largest.*", "new").orderBy("shard_id"))
    idle = placed(judged.where("most > 0").where(F.col("load") < low * F.col("most")).select("shard_id").orderBy("shard_id"))
    taken = full.agg((7 * F.count("*")).alias("taken")).join(F.broadcast(idle.agg(F.count("*").alias("waiting"))))
    # splits: each full shard's seven parts that leave have a place in one line, as the idle shards have
    parts = full.withColumnRenamed("place", "turn").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("place", F.when(F.col("i") > 0, (F.col("turn") - 1) * 7 + F.col("i")))
    given = parts.join(idle.select("place", F.col("shard_id").alias("taker")), "place", "left").join(F.broadcast(taken))
    target = F.when(F.col("i") == 0, F.col("shard_id")).otherwise(F.coalesce("taker", F.col("new") + F.col("place") - F.col("waiting") - 1)).cast("int")
    finer = {"level": F.col("level") + 1, "cx": 2 * F.col("cx") + F.floor(F.col("i") / 4), "cy": 2 * F.col("cy") + F.floor(F.col("i") / 2) % 2, "cz": 2 * F.col("cz") + F.col("i") % 2}
    region = F.concat_ws("/", F.col("cell").cast("string"), F.col("i").cast("string"))
    split = given.select(F.lit("split").alias("action"), "cell", region.alias("region"), *(v.cast("int" if c == "level" else "long").alias(c) for c, v in finer.items()), F.col("shard_id").cast("int").alias("was"), target.alias("shard_id"))
    # merges: idle shards that took nothing meet in pairs, on the faces of their cells
    spare = idle.join(F.broadcast(taken)).where("place > taken").withColumn("k", F.col("place") - F.col("taken") - 1)
    mine = regions.join(spare.select("shard_id", F.floor(F.col("k") / 2).alias("pair"), (F.col("k") % 2).alias("side")), "shard_id")
    faces = F.array(*(F.struct(*((F.col(f"c{c}") + s * (c == axis)).alias(f"c{c}") for c in "xyz")) for axis in "xyz" for s in (-1, 1)))
    first = mine.where("side = 0").select("pair", "level", F.col("cell").alias("a"), F.col("shard_id").alias("one"), F.explode(faces).alias("face")).select("pair", "level", "a", "one", "face.*")
    second = mine.where("side = 1").select("pair", "level", "cx", "cy", "cz", F.col("cell").alias("b"))
    touching = first.join(second, ["pair", "level", "cx", "cy", "cz"]).groupBy("pair", "one").agg(F.min(F.struct("a", "b")).alias("x")).select("pair", "one", "x.*")
    pairs = spare.where("k % 2 = 1").select(F.floor(F.col("k") / 2).alias("pair")).join(touching, "pair", "left")
    ends = F.broadcast(pairs.agg(F.min(F.when(F.col("a").isNull(), F.col("pair"))).alias("end")))
    chosen = pairs.join(ends).where("a is not null and (end is null or pair < end)").select("pair", "one", F.concat_ws("+", F.col("a").cast("string"), F.col("b").cast("string")).alias("region"), F.explode(F.array("a", "b")).alias("cell"))
    merged = mine.join(chosen, ["pair", "cell"]).select(F.lit("merge").alias("action"), "cell", "region", "level", "cx", "cy", "cz", F.col("shard_id").cast("int").alias("was"), F.col("one").cast("int").alias("shard_id"))
    return split.unionByName(merged)


def failover(resources: DataFrame, nodes: DataFrame, failed: Column) -> DataFrame:
    """Resources (resource_id, node_id) of failed nodes, dealt in order over the surviving active nodes, those with fewest resources first. kind is the part of the id before the first dash."""
    held = resources.groupBy("node_id").agg(F.count("*").alias("held"))
    up = active(nodes).where(~failed).select("node_id").join(held, "node_id", "left")
    ranked = up.select(F.col("node_id").alias("target"), (F.row_number().over(W.orderBy(F.coalesce("held", F.lit(0)), "node_id")) - 1).alias("place"))
    lost = resources.join(nodes.where(failed).select("node_id"), "node_id", "left_semi")
    n = up.agg(F.count("*").alias("n"))
    # ranks of lost resources are taken within hashed groups, so that a node that held most is not ranked in one task
    group = F.pmod(F.xxhash64("resource_id"), F.lit(64))
    dealt = lost.withColumn("grp", group).withColumn("turn", F.row_number().over(W.partitionBy("grp").orderBy("resource_id")) + F.col("grp"))
    moved = dealt.join(F.broadcast(n)).withColumn("place", F.when(F.col("n") > 0, F.pmod(F.col("turn"), F.nullif(F.col("n"), F.lit(0)))))
    return moved.join(ranked, "place", "left").select("resource_id", F.substring_index("resource_id", "-", 1).alias("kind"), F.col("node_id").alias("was"), F.col("target").alias("node_id"))


def shard_owners(log: DataFrame) -> DataFrame:
    """Owner of each shard by a log (seq, shard_id, node_id, op assign or release): its last assignment, unless that node released it since. A release by another node has no effect."""
    newest = F.max(F.when(F.col("op") == "assign", F.struct("seq", "node_id"))).alias("held")
    given = log.groupBy("shard_id").agg(newest).where("held is not null").select("shard_id", "held.seq", F.col("held.node_id").alias("node_id"))
    freed = log.where("op = 'release'").groupBy("shard_id", "node_id").agg(F.max("seq").alias("released"))
    return given.join(freed, ["shard_id", "node_id"], "left").where("released is null or released < seq").select("shard_id", "node_id", F.col("seq").alias("since"))


def carry_out(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Vehicles after a plan of region_plan: the region and shard that each is in.

    cells has the vehicle's position, the cell of its region before (cell, level)
    and its shard_id. A vehicle of a split region goes to the part that its
    position lies in, one of a merged region to the region of both, all others
    stay where they are.
    """
    finer = G.cells(F.col("level") + 1)
    here = cells.select("id", F.col("cell").alias("was_cell"), F.col("shard_id").alias("was_shard"), *(c.alias(f"part_{k}") for c, k in zip(finer, "xyz")))
    split = plan.where("action = 'split'").select(F.col("cell").alias("was_cell"), *(F.col(f"c{k}").alias(f"part_{k}") for k in "xyz"), F.col("region").alias("split_region"), F.col("shard_id").alias("split_shard"))
    merged = plan.where("action = 'merge'").select(F.col("cell").alias("was_cell"), F.col("region").alias("merged_region"), F.col("shard_id").alias("merged_shard"))
    rows = here.join(split, ["was_cell", "part_x", "part_y", "part_z"], "left").join(merged, "was_cell", "left")
    return rows.select("id", F.coalesce("split_region", "merged_region", F.col("was_cell").cast("string")).alias("region"), F.coalesce("split_shard", "merged_shard", "was_shard").alias("shard_id"))
