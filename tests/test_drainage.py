"""Whole-raster drainage against brute force, for every tile size."""

import collections
import heapq
import random

import numpy as np
import pytest

from slopeworks.operators import drainage, lines
from slopeworks.operators.raster import D8


def brute_flow(z):
    """{cell: (filled, direction, accumulation)} by a flood over the whole raster, steps on flats, and a walk from each cell."""
    near = {c: [((c[0] + dr, c[1] + dc), k) for k, (dr, dc, _) in enumerate(D8)] for c in z}
    outlets = {c for c in z if any(n not in z for n, _ in near[c])}
    level = {c: z[c] for c in outlets}
    heap = [(z[c], c) for c in outlets]
    heapq.heapify(heap)
    done = set()
    while heap:
        f, c = heapq.heappop(heap)
        if c in done:
            continue
        done.add(c)
        for n, _ in near[c]:
            if n in z and max(f, z[n]) < level.get(n, float("inf")):
                level[n] = max(f, z[n])
                heapq.heappush(heap, (level[n], n))
    falls = {c for c in z if any(n in z and level[n] < level[c] for n, _ in near[c])}
    steps = dict.fromkeys(outlets | falls, 0)
    queue = collections.deque(steps)
    while queue:
        c = queue.popleft()
        for n, _ in near[c]:
            if n in z and n not in steps and level[n] == level[c]:
                steps[n] = steps[c] + 1
                queue.append(n)
    to = {}
    for c in z:
        if c in outlets:
            to[c] = (0, None)
            continue
        slopes = [((level[c] - level[n]) / (2**0.5 if k % 2 else 1.0), -k, n) for n, k in near[c]]
        s, k, n = max(slopes)
        if s <= 0:
            k, n = max((-k, n) for n, k in near[c] if level[n] == level[c] and steps[n] == steps[c] - 1)
        to[c] = (D8[-k][2], n)
    total = collections.Counter()
    for c in z:
        while c is not None:
            total[c] += 1
            c = to[c][1]
    return {c: (level[c], to[c][0], total[c]) for c in z}, outlets


def flowed(spark, z, tile):
    cells = spark.createDataFrame([(r, c, float(v)) for (r, c), v in z.items()] or [(0, 0, None)], "row int, col int, z double")
    found = drainage.flow(cells, tile)
    return {(r["row"], r["col"]): (r["filled"], r["direction"], r["accumulation"]) for r in found.collect()}, found


@pytest.mark.parametrize(("tile", "height", "origin", "seed"), [(3, 3, (0, 0), 1), (4, 50, (-7, -9), 2), (6, 2, (-3, 5), 3), (32, 4, (0, 0), 4), (5, 1, (0, 0), 5)])
def test_flow_is_the_whole_raster_s(spark, tile, height, origin, seed):
    """Wide flats, pits, holes and a ragged edge: levels, directions and sums do not depend on tiles, and all water leaves at outlets."""
    rnd = random.Random(seed)
    z = {(r + origin[0], c + origin[1]): rnd.randrange(height) for r in range(19) for c in range(17) if rnd.random() > 0.03}
    want, outlets = brute_flow(z)
    got, found = flowed(spark, z, tile)
    assert got == want
    assert sum(got[c][2] for c in outlets) == len(z) and drainage.unresolved(found).isEmpty()


def test_a_lake_over_many_tiles_drains_to_its_only_outlet(spark):
    z = {(r, c): 9 if r in (0, 20) or c in (0, 20) else 1 for r in range(21) for c in range(21)} | {(20, 13): 4}
    got, _ = flowed(spark, z, 4)
    assert got == brute_flow(z)[0] and got[20, 13][2] == 19 * 19 + 1 and got[1, 1][0] == 4


def test_flow_of_odd_rasters(spark):
    assert flowed(spark, {}, 4)[0] == {}
    assert flowed(spark, {(5, 5): 3}, 4)[0] == {(5, 5): (3.0, 0, 1)}
    apart = {(0, 0): 1, (100, 100): 2, (100, 101): 2}
    assert flowed(spark, apart, 4)[0] == brute_flow(apart)[0]


def test_levels_settle_beyond_the_compacted_rounds(spark, monkeypatch):
    monkeypatch.setattr(drainage, "COMPACT", 1)
    # water that winds through all tiles before it leaves
    z = {(r, c): 5 if r % 2 and c != (11 if r % 4 == 1 else 1) else 3 for r in range(13) for c in range(13)}
    z |= {(r, c): 9 for r in range(13) for c in range(13) if r in (0, 12) or c in (0, 12)} | {(12, 6): 0}
    assert flowed(spark, z, 3)[0] == brute_flow(z)[0]


def test_stream_lines_are_the_walks_between_sources_and_junctions(spark):
    rnd = random.Random(12)
    z = {(r - 3, c - 2): 40 - r + rnd.randrange(8) for r in range(24) for c in range(20)}
    want, _ = brute_flow(z)
    step = {code: (dr, dc) for dr, dc, code in D8}
    stream = {c for c, (_, _, n) in want.items() if n >= 6}
    to = {c: (c[0] + step[want[c][1]][0], c[1] + step[want[c][1]][1]) for c in stream if want[c][1]}
    entering = collections.Counter(to.values())
    expected = {}
    for head in (c for c in stream if entering[c] != 1):
        walk = [head]
        while walk[-1] in to and (len(walk) == 1 or entering[walk[-1]] == 1):
            walk.append(to[walk[-1]])
        if len(walk) > 1:
            points = np.array([(100 + (c + 0.5) * 30, 900 - (r + 0.5) * 30) for r, c in walk])
            expected[tuple(points[0]), tuple(points[1])] = (len(walk), want[walk[-1]][2], [tuple(p) for p in points[lines.kept(points, 15.0)]])
    drained = flowed(spark, z, 8)[1]
    got = drainage.stream_lines(drained, 6, 100.0, 900.0, 30.0).collect()
    assert sorted((r["n_cells"], r["most"], [tuple(p) for p in r["points"]]) for r in got) == sorted(expected.values()) and len(got) > 5
    assert any(r["n_cells"] > len(r["points"]) for r in got) and drainage.stream_lines(drained, 10_000, 0.0, 0.0, 30.0).collect() == []
