"""Cells of the multi-resolution grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetra import constants as K


def cell_size(level: Column | int, axis: int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.lit(K.GRID_BASE[axis]) / F.pow(F.lit(2.0), level.cast("double"))


def cell(value: Column, size: Column | float) -> Column:
    """Cell index, truncated toward zero: cell 0 is twice as wide around the origin."""
    return (value / size).cast("int")


def cell_sql(value: str, size: float) -> str:
    """cell() as a SQL term."""
    return f"cast(({value}) / {float(size)!r}D as int)"


def cells(level: Column | int = 0) -> list[Column]:
    return [cell(F.col(c), cell_size(level, i)).alias(f"c{c}") for i, c in enumerate("xyz")]


def parent(index: Column, levels: Column | int = 1) -> Column:
    """Cell index so many levels up, floored."""
    levels = F.lit(levels) if isinstance(levels, int) else levels
    return F.floor(index / F.pow(F.lit(2.0), levels.cast("double"))).cast("int")


def children(cx: Column, cy: Column, cz: Column) -> Column:
    """The eight cells below a cell, as an array of structs."""
    return F.array(*(F.struct((2 * cx + i).alias("cx"), (2 * cy + j).alias("cy"), (2 * cz + k).alias("cz")) for i in (0, 1) for j in (0, 1) for k in (0, 1)))


def mixed(cx: Column, cy: Column, cz: Column, n: int) -> Column:
    """A portable hash of a cell to 0..n-1."""
    total = cx.cast("long") * 73856093 + cy.cast("long") * 19349663 + cz.cast("long") * 83492791
    return F.pmod(total, F.lit(n)).cast("int")
