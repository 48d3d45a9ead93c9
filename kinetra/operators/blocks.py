"""Pairs of near rows by blocks: Spark deals out pairs of blocks of neighbouring cells, numpy compares the rows of two blocks.

A fleet whose pairs grow with its square spends its time on candidates, so
that a candidate must cost little: a block holds the rows of one cell, as one
Arrow batch, and the tests of a pair of blocks run over whole tiles of it. A
cell meets half of its neighbours, so that a pair is met once. Tests are a
little wider than asked; what they leave is judged exactly by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from kinetra.operators.spatial import cells_touched


#: Rows of a block at most, candidates of a tile, pairs that are handed on together, and how much wider than asked the tests are.
BLOCK, TILE, BATCH, SLACK = 1024, 1 << 14, 1 << 14, 1e-9

#: Columns by name, the ways from the first row of a pair to the second by axis, and a scratch array for a product.
Tall, Ways = dict[str, np.ndarray], dict[str, np.ndarray]
#: A cheap test of a whole tile, if any, and one of the pairs that are left: of both sides' columns and the ways between them.
Tests = tuple[Callable[[Tall, Tall, Ways, list], np.ndarray] | None, Callable[[Tall, Tall, Ways], np.ndarray] | None]


def _blocks(df: DataFrame, cell_size: float) -> DataFrame:
    """Rows (_bx, _by, rows): at most BLOCK rows of one cell. Ranges of cells are cut by a hash as well, so that a dense cell is many tasks'."""
    placed = df.withColumns({f"_b{c}": F.floor(F.col(c) / cell_size).cast("long") for c in "xy"}).where("_bx is not null and _by is not null")
    return _packed(df, placed.repartitionByRange("_bx", "_by", F.xxhash64("id")))


def _packed(df: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks of the rows of df, dealt out with their cells, _bx and _by, as last columns."""
    arrow = to_arrow_schema(df.schema)
    ranged = placed.sortWithinPartitions("_bx", "_by")

    def run(batches):
        cell, held, n = None, [], 0

        def cut():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for k in range(parts := -(-n // BLOCK)):
                begin, end = n * k // parts, n * (k + 1) // parts
                yield pa.RecordBatch.from_arrays([pa.array([cell[0]], pa.int64()), pa.array([cell[1]], pa.int64()), pa.array([whole.slice(begin, end - begin).serialize().to_pybytes()], pa.binary())], ["_bx", "_by", "rows"])

        for batch in batches:
            x, y = (batch.column(i).to_numpy() for i in (batch.num_columns - 2, batch.num_columns - 1))
            rows = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow)], schema=arrow)
            borders = [0, *(np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist(), len(x)]
            for a, b in zip(borders, borders[1:]):
                if b > a:
                    if cell != (here := (int(x[a]), int(y[a]))) or n >= 4 * BLOCK:
                        if n:
                            yield from cut()
                        cell, held, n = here, [], 0
                    held.append(rows.slice(a, b - a))
                    n += b - a
        if n:
            yield from cut()

    return ranged.mapInArrow(run, "_bx long, _by long, rows binary")


def _half(radius: float, cell_size: float) -> list[tuple[int, int]]:
    """A cell itself and the half of its neighbours that a radius reaches, by steps of cells."""
    k = math.ceil(radius / cell_size)
    gap = lambda d: max(abs(d) - 1, 0) * cell_size
    return [(i, j) for i in range(k + 1) for j in range(-k, k + 1) if (i, j) >= (0, 0) and math.hypot(gap(i), gap(j)) <= radius * (1 + 1e-6)]


def new_tiles() -> np.ndarray:
    """What near() computes in."""
    return np.empty((9, max(TILE, BLOCK)))


def near(s: Tall, o: Tall, reach: float, tests: Tests, tiles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of s with those of o, no more than TILE, the square of whose distance is within the reach and for which the tests hold, a tile at a time: numbers of both rows and their distances."""
    rough, fine = tests
    # an axis in which no row lies or moves adds nothing
    axes = "".join(c for c in "xyz" if c != "z" or any(m[k].any() for m in (s, o) for k in m if k.endswith("z")))
    wide, width = len(o["x"]), max(1, TILE // len(o["x"]))
    flat = {c: v[None, :] for c, v in o.items()}
    for i in range(0, len(s["x"]), width):
        tall = {c: v[i : i + width, None] for c, v in s.items()}
        high = len(tall["x"])
        tile = [x[: high * wide].reshape(high, wide) for x in tiles]
        ways = {c: np.subtract(flat[c], tall[c], out=tile.pop()) for c in axes}
        square, part = tile.pop(), tile.pop()
        for j, way in enumerate(ways.values()):
            np.multiply(way, way, out=part if j else square)
            if j:
                square += part
        keep = square <= reach
        if rough:
            keep &= rough(tall, flat, ways, [part, *tile])
        hit = np.flatnonzero(keep)
        if fine and len(hit):
            row, col = np.divmod(hit, wide)
            row += i
            hit = hit[fine(_Taken(s, row), _Taken(o, col), {c: w.ravel().take(hit) for c, w in ways.items()})]
        if len(hit):
            row, col = np.divmod(hit, wide)
            yield row + i, col, np.sqrt(square.ravel().take(hit))


def block_pairs(df: DataFrame, radius: float, tests: Tests, numbers: list[str], columns: list[str] | None = None, parts: int = 2, last: tuple[Callable[[Tall, Tall], tuple[np.ndarray, pa.Array]], str] | None = None) -> DataFrame:
    """Pairs (s_*, o_*) of rows of different ids within a radius for which the tests hold, each once, in either order, with `dist`.

    The tests get the columns `numbers` as doubles, null as not a number,
    which meets no test. columns are those handed on. parts: cells by radius.
    last: what is found of the pairs that are left, its type: numbers of the
    pairs that stay and their column `found`.
    """
    columns = columns or df.columns
    df = df.select(*dict.fromkeys(["id", *"xyz", *columns, *numbers]))
    # a little over an even part of the radius, so that rounding puts no pair of the radius one cell further
    cell_size = radius / parts * (1 + 1e-6)
    arrow, names = to_arrow_schema(df.schema), list(dict.fromkeys([*"xyz", *numbers]))
    s = _blocks(df, cell_size).withColumn("_d", F.explode(F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in _half(radius, cell_size)))))
    s = s.select((F.col("_bx") + F.col("_d.x")).alias("_bx"), (F.col("_by") + F.col("_d.y")).alias("_by"), ((F.col("_d.x") == 0) & (F.col("_d.y") == 0)).alias("own"), F.col("rows").alias("s"))
    o = _blocks(df, cell_size).withColumnRenamed("rows", "o").hint("merge")
    pairs = s.join(o, ["_bx", "_by"]).select("own", "s", "o")
    out = StructType([StructField("own", pairs.schema["own"].dataType), *(StructField(f"{p}{c}", df.schema[c].dataType) for p in ("s_", "o_") for c in dict.fromkeys(["id", *columns])), StructField("dist", df.schema["x"].dataType), *(StructType.fromDDL(f"found {last[1]}") if last else [])])
    told, taken = to_arrow_schema(out), [arrow.get_field_index(c) for c in dict.fromkeys(["id", *columns])]
    reach = radius * radius * (1 + SLACK) + SLACK

    def run(batches):
        block, waiting, n, tiles = _reader(arrow, names), [], 0, new_tiles()

        for batch in batches:
            for own, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                (s_rows, s), (o_rows, o) = block(a), block(b)
                found = [*near(s, o, reach, tests, tiles)]
                if found:
                    row, col, dist = (np.concatenate(x) for x in zip(*found))
                    more = []
                    if last:
                        left, value = last[0](_Taken(s, row), _Taken(o, col))
                        row, col, dist, more = row[left], col[left], dist[left], [value]
                    row, col = pa.array(row), pa.array(col)
                    waiting.append([pa.array(np.full(len(dist), own)), *(s_rows.column(k).take(row) for k in taken), *(o_rows.column(k).take(col) for k in taken), pa.array(dist), *more])
                    n += len(dist)
                    if n >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting)], schema=told)
                        waiting, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting)], schema=told)

    # two blocks of one cell meet in both orders, and each meets itself
    return pairs.mapInArrow(run, out).where("if(own, s_id < o_id, s_id <> o_id)").drop("own")


#: Rows of the fleet to a task, and rows that reach into one cell to a share of its work.
ROWS_OF_TASK, SHARE = 4096, 8192

#: Which of the candidates are pairs, if not all, and the values of each: of both sides' columns, taken for these candidates, and their distances.
Judge = Callable[[Tall, Tall, np.ndarray], tuple[np.ndarray | None, ...]]


def reach_pairs(df: DataFrame, reach: str, other_reach: str, cell_size: float, judge: Judge, numbers: list[str] | None = None, others: DataFrame | None = None, rough: Callable[[Tall, Tall, list], np.ndarray] | None = None, derive: tuple = (None, None), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Ordered pairs (s_id, o_id, values) of rows of different ids no further apart than reach + other_reach, SQL terms over a row, that the judge takes.

    No bound on reaches has to be known: as in radius_pairs() both sides stand
    in all cells that their own reach touches, and a pair counts in the lowest
    cell of both. Here the rows of a cell meet as blocks. There are more tasks
    for more rows, as the pairs of a task would grow with the square else, and
    the rows that reach into a dense cell are cut into shares, each of which
    meets the others' blocks in a place of its own. others: the o side, if it
    is not df, with those of the numbers that it has. derive: of the columns of
    a block more of them, by side. rough: a test of a whole tile.
    """
    numbers = list(dict.fromkeys([*"xyz", *(numbers or [])]))
    sides, counts = [], None
    for side, rows, term in (("s", df, reach), ("o", df if others is None else others, other_reach)):
        own = [c for c in numbers if c in rows.columns]
        # _lowx, _lowy: is this the first column, the first line of cells that the row touches?
        box = {c: (f"{c} - ({term})", f"{c} + ({term})") for c in "xy"}
        placed = cells_touched(rows.select("id", *own, F.expr(term).cast("double").alias("_reach")), box, cell_size, side)
        placed = placed.select("id", *own, "_reach", *((F.col(f"_{side}l{c}") == F.col(f"_c{c}")).alias(f"_low{c}") for c in "xy"), *(F.col(f"_c{c}").cast("long").alias(f"_b{c}") for c in "xy"))
        if counts is None:
            # few, however many cells there are: each takes more than a share of the rows
            counts = F.broadcast(placed.groupBy("_bx", "_by").agg(F.ceil(F.count("*") / SHARE).alias("_shares")).where("_shares > 1"))
        rows = placed.drop("_bx", "_by")
        # by a hash, as cutting ranges would need a sample
        sides.append((to_arrow_schema(rows.schema), [*own, "_reach", "_lowx", "_lowy"], _packed(rows, placed.repartition("_bx", "_by"))))
    s, o = (side[2] for side in sides)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_OF_TASK)
    shares = F.coalesce("_shares", F.lit(1).cast("long"))
    s = s.join(counts, ["_bx", "_by"], "left").select("_bx", "_by", F.pmod(F.xxhash64("rows"), shares).alias("_share"), F.col("rows").alias("s"))
    o = o.join(counts, ["_bx", "_by"], "left").select("_bx", "_by", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_share"), F.col("rows").alias("o"))
    key = ["_bx", "_by", "_share"]
    pairs = s.repartition(parts, *key).join(o.repartition(parts, *key).hint("merge"), key).select("s", "o")
    out = StructType([*(StructField(f"{p}id", df.schema["id"].dataType) for p in ("s_", "o_")), *(StructField(v, DoubleType()) for v in values)])
    told, readers = to_arrow_schema(out), [(arrow, names, more) for (arrow, names, _), more in zip(sides, derive)]

    def run(batches):
        (s_block, o_block), waiting, n = (_reader(*r) for r in readers), [], 0
        tiles = np.empty((4, max(TILE, BLOCK)))
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                (s_rows, s), (o_rows, o) = s_block(a), o_block(b)
                axes = "xyz" if s["z"].any() or o["z"].any() else "xy"
                wide, width = len(o["x"]), max(1, TILE // len(o["x"]))
                flat, found = {c: v[None, :] for c, v in o.items()}, []
                for i in range(0, len(s["x"]), width):
                    tall = {c: v[i : i + width, None] for c, v in s.items()}
                    high = len(tall["x"])
                    square, way, far, more = (x[: high * wide].reshape(high, wide) for x in tiles)
                    for j, c in enumerate(axes):
                        np.subtract(tall[c], flat[c], out=way)
                        np.multiply(way, way, out=way if j else square)
                        if j:
                            square += way
                    np.add(tall["_reach"], flat["_reach"], out=far)
                    np.multiply(far, far, out=way)
                    way *= 1 + SLACK
                    way += SLACK
                    keep = square <= way
                    for c in ("_lowx", "_lowy"):
                        keep &= (tall[c] > 0) | (flat[c] > 0)
                    if rough:
                        keep &= rough(tall, flat, [way, far, more])
                    hit = np.flatnonzero(keep)
                    if len(hit):
                        row, dist = hit // wide, np.sqrt(square.ravel().take(hit))
                        found.append((row + i, hit - row * wide, dist))
                    # few of a tile are left, and a judge of few costs its calls
                    if sum(len(c) for c, _, _ in found) >= BATCH or (found and i + width >= len(s["x"])):
                        row, col, dist = (np.concatenate(c) for c in zip(*found))
                        found = []
                        taken, *value = judge(_Taken(s, row), _Taken(o, col), dist)
                        if taken is not None:
                            taken = np.flatnonzero(taken)
                            row, col, value = row.take(taken), col.take(taken), [v.take(taken) for v in value]
                        waiting.append([_of(s_rows.column(0), row), _of(o_rows.column(0), col), *map(pa.array, value)])
                        n += len(row)
                        if n >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting)], schema=told)
                            waiting, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting)], schema=told)

    return pairs.mapInArrow(run, out).where("s_id <> o_id")


def _of(column: pa.Array, rows: np.ndarray) -> pa.Array:
    """Values of a column by number of row: plain numbers without nulls by numpy, which is quicker."""
    if column.null_count or not pa.types.is_integer(column.type):
        return column.take(pa.array(rows))
    return pa.array(column.to_numpy().take(rows), column.type)


def _reader(arrow: pa.Schema, names: list[str], derive: Callable[[Tall], Tall] | None = None):
    """Blocks from their bytes, as rows and as columns of numbers, with those derived of them; the latest are kept."""
    parsed = {}

    def block(raw):
        if raw not in parsed:
            if len(parsed) > 64:
                parsed.clear()
            rows = pa.ipc.read_record_batch(pa.py_buffer(raw), arrow)
            columns = {c: rows.column(arrow.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names}
            parsed[raw] = rows, columns | (derive(columns) if derive else {})
        return parsed[raw]

    return block


class _Taken(dict):
    """Columns of some rows, taken when asked for."""

    def __init__(self, columns: dict[str, np.ndarray], rows: np.ndarray):
        super().__init__()
        self.columns, self.rows = columns, rows

    def __missing__(self, name: str) -> np.ndarray:
        return self.columns[name].take(self.rows)


def taken(columns: Tall, rows: np.ndarray) -> Tall:
    """Columns of some rows, taken when asked for."""
    return _Taken(columns, rows)


#: Every pair within the radius.
EVERYWHERE: Tests = (None, None)


def closest_tests(window: float, sign: int, base: float) -> Tests:
    """May a pair come within its safe distance at its closest approach in the window? sign: of the approach product in the time of it."""

    def rough(s, o, ways, tile):
        approach, part = tile[0], tile[1]
        for j, (c, way) in enumerate(ways.items()):
            np.subtract(s[f"v{c}"], o[f"v{c}"], out=part if j else approach)
            np.multiply(way, part if j else approach, out=part if j else approach)
            if j:
                approach += part
        return approach >= -SLACK if sign > 0 else approach <= SLACK

    def fine(s, o, ways):
        with np.errstate(all="ignore"):
            w = {c: s[f"v{c}"] - o[f"v{c}"] for c in ways}
            t = sign * sum(r * w[c] for c, r in ways.items()) / sum(v * v for v in w.values())
            square = 0.0
            for c, r in ways.items():
                apart = r - t * (w[c] + t * (0.5 * (s[f"a{c}"] - o[f"a{c}"])))
                square = square + apart * apart
            safe = (s["size"] + o["size"]) / 2 + (base + 1e-6)
            # what is nearly at rest may come out on either side of zero
            return (t >= -1e-6) & (t <= window + 1e-6) & (square <= safe * safe)

    return rough, fine
