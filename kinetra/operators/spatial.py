"""Radius joins: an equi-join on grid cells with the exact distance as a residual.

The grid only accelerates; results don't depend on the cell size. Both sides
are replicated into the cells that their own reach touches, and a pair counts
only in the lowest cell that both touch, so that it meets once and needs no
removal of duplicates. No bound on a reach has to be known in advance. The
exchanges are planned by Spark alone: AQE broadcasts a side below its checked
threshold, merges small partitions and splits those of dense cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions.grid import cell_sql


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*(f"{prefix}{c}" for c in df.columns))


def cells_touched(df: DataFrame, box: dict[str, tuple[str, str]], cell_size: float, side: str) -> DataFrame:
    """One row for each grid cell that a box {axis: (low, high)} of SQL terms touches, as _cx, _cy, with the box's lowest cell as _{side}lx, _{side}ly."""
    for axis, (low, high) in box.items():
        # a little wider than asked, so that rounding loses no pair on the boundary
        first, last = cell_sql(f"({low}) - abs({low}) * 1e-12 - 1e-9", cell_size), cell_sql(f"({high}) + abs({high}) * 1e-12 + 1e-9", cell_size)
        df = df.selectExpr("*", f"{first} as _{side}l{axis}").selectExpr("*", f"explode(sequence(_{side}l{axis}, {last})) as _c{axis}")
    return df


def box_pairs(s: DataFrame, o: DataFrame, s_box: dict, o_box: dict, cell_size: float, keep: str) -> DataFrame:
    """Pairs of rows whose boxes share a cell and for which keep holds, each once."""
    columns = s.columns + o.columns
    s, o = cells_touched(s, s_box, cell_size, "s"), cells_touched(o, o_box, cell_size, "o")
    return s.join(o, ["_cx", "_cy"]).where(f"_cx = greatest(_slx, _olx) and _cy = greatest(_sly, _oly) and {keep}").select(*columns)


def _side_sql(view: str, columns: list[str], prefix: str, reach: str, cell_size: float, side: str) -> str:
    """The rows of a view in all cells that a square of a reach around them touches, as cells_touched() gives them."""
    edges = []
    for axis in "xy":
        low, high = f"(`{prefix}{axis}` - ({reach}))", f"(`{prefix}{axis}` + ({reach}))"
        edges.append(f"{cell_sql(f'{low} - abs({low}) * 1e-12 - 1e-9', cell_size)} as _{side}l{axis}, {cell_sql(f'{high} + abs({high}) * 1e-12 + 1e-9', cell_size)} as _{side}h{axis}")
    named = ", ".join(f"`{c}` as `{prefix}{c}`" for c in columns)
    unfolded = " ".join(f"lateral view explode(sequence(_{side}l{axis}, _{side}h{axis})) as _{side}c{axis}" for axis in "xy")
    return f"(select * from (select *, {', '.join(edges)} from (select {named} from {view})) {unfolded})"


def radius_pairs(subjects: DataFrame, others: DataFrame, reach: str, cell_size: float, within: str | None = None, symmetric: bool = False, other_reach: str = "0D", out: str | None = None) -> DataFrame:
    """All (s_*, o_*) pairs of different ids with `dist` at most reach + other_reach, SQL terms over s_* and over o_*.

    The reaches bound the search; within, if given, is the predicate in place
    of that distance. symmetric keeps s_id < o_id only. out: what to select of
    a pair, if not all. One statement, so that a small fleet's plan is analysed
    once and not for each of its steps.
    """
    far, different = f"({reach} + {other_reach})", "s_id < o_id" if symmetric else "s_id <> o_id"
    square = " + ".join(f"(s_{c} - o_{c}) * (s_{c} - o_{c})" for c in "xyz")
    # squares first: the root is taken for pairs that are close enough already
    close = f"{square} <= {far} * {far} * (1 + 1e-12D) + 1e-9D"
    s, o = _side_sql("{subjects}", subjects.columns, "s_", reach, cell_size, "s"), _side_sql("{others}", others.columns, "o_", other_reach, cell_size, "o")
    columns = ", ".join(f"`{p}{c}`" for p, df in (("s_", subjects), ("o_", others)) for c in df.columns)
    once = "_scx = greatest(_slx, _olx) and _scy = greatest(_sly, _oly)"
    pairs = f"select {columns}, sqrt({square}) as dist from {s} join {o} on _scx = _ocx and _scy = _ocy where {once} and {different} and {close}"
    return subjects.sparkSession.sql(f"select {out or '*'} from ({pairs}) where {within or f'dist <= {far}'}", subjects=subjects, others=others)


def both_ways(pairs: DataFrame, **columns: str) -> DataFrame:
    """Symmetric pairs in both directions: name="id" gives columns s_name and o_name from s_id and o_id, swapped in the second row. The pairs are evaluated once."""
    side = lambda a, b: F.struct(*(F.col(f"{x}{c}").alias(f"{y}{n}") for n, c in columns.items() for x, y in ((a, "s_"), (b, "o_"))))
    rest = [c for c in pairs.columns if c not in {f"{x}{c}" for c in columns.values() for x in ("s_", "o_")}]
    return pairs.withColumn("_way", F.explode(F.array(side("s_", "o_"), side("o_", "s_")))).select("_way.*", *rest)
