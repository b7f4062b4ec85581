"""Drainage of whole rasters, tile by tile: filled depressions, flow directions, flats that drain, and accumulation.

A tile is one row of arrays with the cells around it as its halo. What crosses borders is told between neighbouring tiles:

* Levels: each tile is solved by a priority flood; a tile whose border fell tells its neighbours, and only tiles that were told are
  looked at again, until no border falls.
* Flats: a cell without a lower neighbour flows towards the nearest cell of its level that has one or is an outlet. Steps to
  that cell are counted in the same rounds as levels, so they depend on no tile size.
* Accumulation: a tile is counted alone and then stands for the links from its border cells to the cells outside that they lead to. Only
  border cells that water enters take part in the sums over all tiles, whose pointers double their reach each round; a last
  pass adds what comes in to the cells below.

An outlet is a valid cell at the raster's edge or beside an invalid one, and has direction 0. All other cells have one after
filling, so the accumulation of the outlets sums to the number of cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.operators.lines import simplified
from slopeworks.operators.raster import D8, accumulate, downstream, stream_mask, stream_segments
from slopeworks.runtime import on_workers, settled

#: Rows and columns of a tile.
TILE = 512
#: Rounds after which the latest rows of all tiles are written anew.
COMPACT = 4

_STATE = "tr int, tc int, round int, value binary, border boolean"
_GROUND = "tr int, tc int, ground binary"
_MESSAGE = "tr int, tc int, at binary, value binary"
#: Steps to the neighbours in their order, and their codes and distances.
_STEP = np.array([(dr, dc) for dr, dc, _ in D8])
_CODE = np.array([code for _, _, code in D8], np.uint8)
_FAR = np.array([2**0.5 if dr and dc else 1.0 for dr, dc, _ in D8])


def _padded(values: np.ndarray, tile: int, outside: float) -> np.ndarray:
    return np.pad(values.reshape(tile, tile), 1, constant_values=outside).ravel()


def _inner(values: list[float] | np.ndarray, tile: int) -> np.ndarray:
    return np.asarray(values).reshape(tile + 2, tile + 2)[1:-1, 1:-1].ravel()


def _rows(schema: str, *rows: tuple) -> pa.Table:
    """A table of a schema written as ``name type`` pairs."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [pair.split() for pair in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _array(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_py(), np.float64)


# --- what a tile does with what it hears: lowers its values from some cells on ----------------------


def _flood(z: list[float], level: list[float], heap: list[tuple[float, int]], width: int) -> None:
    """The least level first; each neighbour falls to the greater of it and its ground. Cells outside have the least already."""
    steps = [dr * width + dc for dr, dc, _ in D8]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        f, k = pop(heap)
        if f > level[k]:
            continue
        for d in steps:
            n = k + d
            if level[n] > f:
                new = z[n] if z[n] > f else f
                if new < level[n]:
                    level[n] = new
                    push(heap, (new, n))


def _count_steps(level: list[float], steps: list[float], heap: list[tuple[float, int]], width: int) -> None:
    """The fewest steps first; each neighbour of the same level is one step farther. Cells outside have the least already."""
    around = [dr * width + dc for dr, dc, _ in D8]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        s, k = pop(heap)
        if s > steps[k]:
            continue
        f = level[k]
        for d in around:
            n = k + d
            if steps[n] > s + 1 and level[n] == f:
                steps[n] = s + 1
                push(heap, (s + 1, n))


def _hear_levels(z: list[float], level: list[float], news: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
    found = []
    for f, k in news:
        for dr, dc, _ in D8:
            n = k + dr * width + dc
            if 0 <= n < len(level) and level[n] > f and max(f, z[n]) < level[n]:
                level[n] = max(f, z[n])
                found.append((level[n], n))
    return found


def _hear_steps(level: list[float], steps: list[float], news: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
    found = []
    for s, k in news:
        for dr, dc, _ in D8:
            n = k + dr * width + dc
            if 0 <= n < len(steps) and steps[n] > s + 1 and level[n] == level[k]:
                steps[n] = s + 1
                found.append((s + 1, n))
    return found


# --- rounds ------------------------------------------------------------------------------------------


def _told(tile: int):
    """What a tile tells each tile around it: the finite values along the side or corner that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = {-1: slice(0, 1), 0: slice(0, tile), 1: slice(tile - 1, tile)}
        for batch in batches:
            out: list[tuple] = []
            for tr, tc, raw in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "value"))):
                values = np.frombuffer(raw, np.float64).reshape(tile, tile)
                for dr, dc, _ in D8:
                    side = values[strip[dr], strip[dc]]
                    i, j = np.nonzero(np.isfinite(side))
                    if len(i):
                        # places in the padded tile that is told
                        r, c = i + (strip[dr].start - dr * tile + 1), j + (strip[dc].start - dc * tile + 1)
                        out.append((tr + dr, tc + dc, (r * (tile + 2) + c).astype("<i8").tobytes(), side[i, j].astype("<f8").tobytes()))
            yield from _rows(_MESSAGE, *out).to_batches()

    return run


def _news(messages: pa.Table) -> list[tuple[float, int]]:
    found: list[tuple[float, int]] = []
    for at, values in zip(messages.column("at").to_pylist(), messages.column("value").to_pylist()):
        found += zip(np.frombuffer(values, "<f8").tolist(), np.frombuffer(at, "<i8").tolist())
    return found


def _heard(tile: int, hear: Callable, relax: Callable):
    """A tile with the values around it: its row if any of its values falls."""

    def run(key: tuple, state: pa.Table, messages: pa.Table) -> pa.Table:
        if not state.num_rows or not messages.num_rows:
            return _rows(_STATE)
        ground, before = _array(state.column("ground")[0]).tolist(), _array(state.column("value")[0])
        values = _padded(before, tile, -np.inf).tolist()
        inside = hear(ground, values, _news(messages), tile + 2)
        if not inside:
            return _rows(_STATE)
        relax(ground, values, inside, tile + 2)
        after = _inner(values, tile)
        moved = (after != before).reshape(tile, tile)
        border = bool(moved[0].any() or moved[-1].any() or moved[:, 0].any() or moved[:, -1].any())
        return _rows(_STATE, (key[0].as_py(), key[1].as_py(), state.column("round")[0].as_py() + 1, after.tobytes(), border))

    return run


def _messages(tiles: DataFrame, tile: int) -> DataFrame:
    return tiles.select("tr", "tc", "value").mapInArrow(_told(tile), _MESSAGE)


def _settle(ground: DataFrame, first: DataFrame, tile: int, hear: Callable, relax: Callable) -> DataFrame:
    """(tr, tc, value) when no border falls any more; values only fall, so this ends."""
    latest = F.max_by(F.struct("round", "value", "border"), "round").alias("x")
    newest = lambda rows: rows.groupBy("tr", "tc").agg(latest).select("tr", "tc", "x.*")
    state = news = first
    for k in range(1, 1 << 30):
        messages = _messages(news.filter("border"), tile)
        told = state.join(messages.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
        told = newest(told).join(ground, ["tr", "tc"])
        news = settled(told.groupBy("tr", "tc").cogroup(messages.groupBy("tr", "tc")).applyInArrow(_heard(tile, hear, relax), _STATE))
        if news.isEmpty():
            break
        state = state.unionByName(news)
        if k % COMPACT == 0:
            state = settled(newest(state))
    return newest(state).select("tr", "tc", "value")


def _with_halo(tiles: DataFrame, tile: int, run: Callable, schema: str) -> DataFrame:
    """Each tile (tr, tc, value and whatever else) with the values that all tiles around it have along its border."""
    return tiles.groupBy("tr", "tc").cogroup(_messages(tiles, tile).groupBy("tr", "tc")).applyInArrow(run, schema)


def _haloed(tile_row: pa.Table, messages: pa.Table, tile: int) -> np.ndarray:
    """A tile's padded values; what is not told of is infinite."""
    values = _padded(_array(tile_row.column("value")[0]), tile, np.inf)
    for v, k in _news(messages):
        values[k] = v
    return values


# --- the passes --------------------------------------------------------------------------------------


def _shifted(values: np.ndarray, tile: int, k: int) -> np.ndarray:
    """The k-th neighbour of each inner cell of a padded square."""
    dr, dc = _STEP[k]
    return values[1 + dr : tile + 1 + dr, 1 + dc : tile + 1 + dc]


def _started(tile: int):
    """A tile's padded ground, and its levels by water that leaves at its own outlets."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        r, c = (rows.column(n).to_numpy() - t * tile + 1 for n, t in (("row", tr), ("col", tc)))
        ground = np.full((tile + 2, tile + 2), np.inf)
        ground[r, c] = rows.column("z").to_numpy()
        there = np.isfinite(ground)
        schema = f"{_GROUND}, round int, value binary, border boolean"
        if not there[1:-1, 1:-1].any():  # beside the raster
            return _rows(schema)
        outlet = _outlets(there, tile)
        level = _padded(np.where(there[1:-1, 1:-1], np.inf, -np.inf), tile, -np.inf).tolist()
        z = ground.ravel().tolist()
        heap = [(z[k], k) for k in np.flatnonzero(_padded(outlet, tile, False)).tolist()]
        for f, k in heap:
            level[k] = f
        _flood(z, level, heap, tile + 2)
        return _rows(schema, (tr, tc, ground.tobytes(), 0, _inner(level, tile).tobytes(), True))

    return run


def _outlets(there: np.ndarray, tile: int) -> np.ndarray:
    """Valid inner cells of a padded square of flags that an invalid cell is next to."""
    around = sum(_shifted(there, tile, k).astype(int) for k in range(8))
    return there[1:-1, 1:-1] & (around < 8)


def _levelled(tile: int):
    """A tile's padded levels, and the steps to where water of its level falls or leaves."""

    def run(key: tuple, tiles: pa.Table, messages: pa.Table) -> pa.Table:
        schema = "tr int, tc int, ground binary, round int, value binary, border boolean"
        if not tiles.num_rows:
            return _rows(schema)
        level = _haloed(tiles, messages, tile).reshape(tile + 2, tile + 2)
        level[~np.isfinite(level)] = np.inf  # invalid cells have -inf as tiles' own values
        there = np.isfinite(level)
        own = level[1:-1, 1:-1]
        falls = np.any([_shifted(level, tile, k) < own for k in range(8)], axis=0)
        start = there[1:-1, 1:-1] & (falls | _outlets(there, tile))
        steps = _padded(np.where(start, 0.0, np.where(there[1:-1, 1:-1], np.inf, -np.inf)), tile, -np.inf).tolist()
        _count_steps(level.ravel().tolist(), steps, [(0.0, k) for k in np.flatnonzero(_padded(start, tile, False)).tolist()], tile + 2)
        return _rows(schema, (key[0].as_py(), key[1].as_py(), level.tobytes(), 0, _inner(steps, tile).tobytes(), True))

    return run


def _directions(level: np.ndarray, steps: np.ndarray, tile: int) -> np.ndarray:
    """D8 codes of a padded tile: to the steepest lower neighbour, on flats one step on, the first in order on ties; 0 at outlets, 255 where invalid."""
    there = np.isfinite(level)
    own, own_steps = level[1:-1, 1:-1], steps[1:-1, 1:-1]
    best, code = np.zeros(own.shape), np.zeros(own.shape, np.uint8)
    with np.errstate(invalid="ignore"):  # invalid cells
        for k in range(8):
            slope = (own - _shifted(level, tile, k)) / _FAR[k]
            take = slope > best
            best[take], code[take] = slope[take], _CODE[k]
        for k in range(8):
            code[(code == 0) & (_shifted(level, tile, k) == own) & (_shifted(steps, tile, k) == own_steps - 1)] = _CODE[k]
    code[_outlets(there, tile)] = 0
    code[~there[1:-1, 1:-1]] = 255
    return code


def _targets(code: np.ndarray, tile: int) -> np.ndarray:
    """The place in the padded tile that each inner cell leads to, -1 where there is none; -2 for invalid cells."""
    width = tile + 2
    move = np.full(256, 0, np.int64)
    for k, (dr, dc) in enumerate(_STEP):
        move[_CODE[k]] = dr * width + dc
    at = np.arange(width * width).reshape(width, width)[1:-1, 1:-1]
    to = np.where(code == 0, -1, at + move[code])
    return np.where(code == 255, -2, to)


def _inflow(to: np.ndarray, start: np.ndarray, tile: int) -> tuple[np.ndarray, list[int]]:
    """Padded sums of ``start`` along the links, with what leaves in the halo, and the inner cells in the order that water takes."""
    width = tile + 2
    down = np.full(width * width, -1, np.int64)
    at = np.arange(width * width).reshape(width, width)[1:-1, 1:-1]
    valid = to != -2
    down[at[valid]] = to[valid]
    waiting = np.bincount(down[down >= 0], minlength=width * width)
    inner = np.zeros(width * width, bool)
    inner[at[valid]] = True
    down, waiting, total = down.tolist(), waiting.tolist(), start.tolist()
    ready = np.flatnonzero(inner & (np.array(waiting) == 0)).tolist()
    inside = inner.tolist()
    for k in ready:  # grows meanwhile
        n = down[k]
        if n >= 0:
            total[n] += total[k]
            waiting[n] -= 1
            if inside[n] and not waiting[n]:
                ready.append(n)
    return np.array(total, np.int64), ready


_DRAINED = "tr int, tc int, level binary, code binary, border_at binary, border_to binary, out_to binary, out_sum binary"


def _drained(tile: int):
    """A tile's directions, where each of its border cells leads to outside, and how much of its own water leaves for where."""

    def run(key: tuple, tiles: pa.Table, messages: pa.Table) -> pa.Table:
        if not tiles.num_rows:
            return _rows(_DRAINED)
        tr, tc, width = key[0].as_py(), key[1].as_py(), tile + 2
        level = _array(tiles.column("ground")[0]).reshape(width, width)
        steps = _haloed(tiles, messages, tile).reshape(width, width)
        code = _directions(level, steps, tile)
        to = _targets(code, tile)
        start = np.pad((to != -2).astype(np.int64), 1).ravel()
        total, order = _inflow(to, start, tile)
        halo = np.ones((width, width), bool)
        halo[1:-1, 1:-1] = False
        left = np.flatnonzero(halo.ravel() & (total > 0))
        # the place in the halo that each cell's water leaves at, from the last cells up
        leaves = np.where(halo.ravel(), np.arange(width * width), -1).tolist()
        flat = np.pad(to, 1, constant_values=-2).ravel().tolist()
        for k in reversed(order):
            leaves[k] = leaves[flat[k]] if flat[k] >= 0 else -1
        rim = np.zeros((width, width), bool)
        rim[1:-1, 1:-1] = True
        rim[2:-2, 2:-2] = False
        at = np.flatnonzero(rim.ravel() & (np.array(flat) != -2))
        name = lambda k: _names(k, tr, tc, tile)
        ends = np.array(leaves)[at]
        border_to = np.where(ends >= 0, name(np.maximum(ends, 0)), -(1 << 62))
        raw = (level[1:-1, 1:-1].tobytes(), code.tobytes(), name(at).tobytes(), border_to.tobytes(), name(left).tobytes(), total[left].tobytes())
        return _rows(_DRAINED, (tr, tc, *raw))

    return run


def _names(at: np.ndarray, tr: int, tc: int, tile: int) -> np.ndarray:
    """Numbers of places of a padded tile that are the same for all tiles."""
    row, col = at // (tile + 2) - 1 + tr * tile, at % (tile + 2) - 1 + tc * tile
    return (row.astype(np.int64) << 32) + (col.astype(np.int64) + (1 << 31))


def _links(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(first).to_pylist(), batch.column(second).to_pylist()):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b == -(1 << 62))], names=["node", "other"])

    return run


def _totals(tile: int):
    """A tile's cells with their accumulation, from its own and what enters."""

    def run(key: tuple, tiles: pa.Table, entries: pa.Table) -> pa.Table:
        schema = "row int, col int, filled double, direction int, accumulation long"
        if not tiles.num_rows:
            return _rows(schema)
        tr, tc, width = key[0].as_py(), key[1].as_py(), tile + 2
        code = np.frombuffer(tiles.column("code")[0].as_py(), np.uint8).reshape(tile, tile)
        to = _targets(code, tile)
        start = np.pad((to != -2).astype(np.int64), 1)
        if entries.num_rows:
            node = entries.column("node").to_numpy()
            start[(node >> 32) - tr * tile + 1, (node & 0xFFFFFFFF) - (1 << 31) - tc * tile + 1] += entries.column("accumulation").to_numpy()
        total, _ = _inflow(to, start.ravel(), tile)
        i, j = np.nonzero(code != 255)
        columns = (i + tr * tile).astype(np.int32), (j + tc * tile).astype(np.int32), _array(tiles.column("level")[0]).reshape(tile, tile)[i, j], code[i, j].astype(np.int32), total.reshape(width, width)[i + 1, j + 1]
        return pa.table([pa.array(c) for c in columns], names=["row", "col", "filled", "direction", "accumulation"])

    return run


def _cells_of(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tr, tc, z, level in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "ground", "value"))):
                z, level = _inner(np.frombuffer(z, np.float64), tile), np.frombuffer(level, np.float64)
                at = np.flatnonzero(np.isfinite(z))
                rows = pa.array((at // tile + tr * tile).astype(np.int32)), pa.array((at % tile + tc * tile).astype(np.int32)), pa.array(z[at]), pa.array(level[at])
                yield pa.RecordBatch.from_arrays(list(rows), names=["row", "col", "z", "filled"])

    return run


def _filled(cells: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Tiles' padded ground (tr, tc, ground) and levels (tr, tc, value)."""
    on_workers(cells.sparkSession)
    z = F.col("z").cast("double")
    ok = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))
    valid = cells.filter(ok).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), z.alias("z"))
    number = lambda c, d: F.floor((F.col(c) + d) / tile).cast("int")
    # a cell in a tile's inside is only its own
    reach = F.array_distinct(F.array(*(F.struct(number("row", dr).alias("tr"), number("col", dc).alias("tc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1))))
    rim = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    own = F.array(F.struct(number("row", 0).alias("tr"), number("col", 0).alias("tc")))
    spread = valid.withColumn("t", F.explode(F.when(rim("row") | rim("col"), reach).otherwise(own))).select("t.tr", "t.tc", "row", "col", "z")
    first = settled(spread.groupBy("tr", "tc").applyInArrow(_started(tile), f"{_GROUND}, round int, value binary, border boolean"))
    ground = first.select("tr", "tc", "ground")
    return ground, _settle(ground, first.select("tr", "tc", "round", "value", "border"), tile, _hear_levels, _flood)


def fill_depressions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(row, col, z, filled): the least level at which water leaves each valid cell for the raster's edge or an invalid cell, which is unique."""
    ground, levels = _filled(cells, tile)
    return ground.join(levels, ["tr", "tc"]).mapInArrow(_cells_of(tile), "row int, col int, z double, filled double")


def flow(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(row, col, filled, direction, accumulation) of each valid cell of (row, col, z), with depressions filled and flats drained."""
    ground, levels = _filled(cells, tile)
    levelled = settled(_with_halo(levels, tile, _levelled(tile), f"{_GROUND}, round int, value binary, border boolean"))
    levels = levelled.select("tr", "tc", "ground")
    steps = _settle(levels, levelled.select("tr", "tc", "round", "value", "border"), tile, _hear_steps, _count_steps)
    drained = settled(_with_halo(settled(steps.join(levels, ["tr", "tc"])), tile, _drained(tile), _DRAINED))
    pairs = "node long, other long"
    entering = drained.select("out_to", "out_sum").mapInArrow(_links("out_to", "out_sum"), pairs).groupBy("node").agg(F.sum("other").alias("weight"))
    leading = drained.select("border_at", "border_to").mapInArrow(_links("border_at", "border_to"), pairs).withColumnRenamed("other", "down")
    inflow = accumulate(entering.join(leading, "node"), weight="weight")
    part = lambda c: F.floor(c / tile).cast("int")
    row, col = F.shiftright("node", 32), F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)
    entries = inflow.select(part(row).alias("tr"), part(col).alias("tc"), "node", "accumulation")
    tiles = drained.select("tr", "tc", "level", "code")
    return tiles.groupBy("tr", "tc").cogroup(entries.groupBy("tr", "tc")).applyInArrow(_totals(tile), "row int, col int, filled double, direction int, accumulation long")


def unresolved(drained: DataFrame, valid: Column | None = None) -> DataFrame:
    """Cells of a flow that lead nowhere though all their neighbours are valid; there is none after ``flow``."""
    here = drained.filter(valid) if valid is not None else drained
    steps = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc, _ in D8))).alias("s")
    ends = here.filter("direction = 0").select("row", "col", steps).select("row", "col", (F.col("row") + F.col("s.dr")).alias("n_row"), (F.col("col") + F.col("s.dc")).alias("n_col"))
    beside = here.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"))
    return ends.join(beside, ["n_row", "n_col"]).groupBy("row", "col").agg(F.count("*").alias("n")).filter("n = 8").select("row", "col")


def stream_lines(drained: DataFrame, threshold: int, west: float, north: float, res: float, tolerance: float = 15.0) -> DataFrame:
    """(segment, points, n_cells, most) of a flow's streams: lines between sources and junctions through the cells' centres, simplified.

    ``segment`` numbers the first cell, ``n_cells`` counts the line's cells before it is simplified, and ``most`` is their
    greatest accumulation.
    """
    cells = settled(stream_mask(drained, threshold).filter("is_stream"))
    node = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32) + F.col(c).cast("long") + F.lit(1 << 31)
    down = downstream(cells).select("row", "col", node("to_row", "to_col").alias("down"))
    nodes = cells.join(down, ["row", "col"], "left").select(node("row", "col").alias("node"), "down", "is_stream")
    segments = stream_segments(nodes)
    x = lambda n: west + (n.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31) + 0.5) * res
    y = lambda n: north - (F.shiftright(n, 32) + 0.5) * res
    shaped = segments.select("segment", F.transform("nodes", lambda n: F.struct(x(n).alias("x"), y(n).alias("y"))).alias("points"), F.size("nodes").alias("n_cells"), F.element_at("nodes", -1).alias("last"))
    # water only grows on its way, so the last cell has most
    ends = cells.select(node("row", "col").alias("last"), F.col("accumulation").alias("most"))
    return simplified(shaped.join(ends, "last").drop("last"), tolerance)
