"""Polygon validity: named shapes, and random polygons against exact arithmetic over all pairs."""

import itertools
import random
from fractions import Fraction

import pytest

from slopeworks.operators import validity

PARTS = "k int, parts array<struct<shell:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"


def ring(*points):
    return [tuple(map(float, p)) for p in points]


def box(x1, y1, x2, y2):
    return ring((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))


BIG = box(0, 0, 12, 12)
DIAMOND = ring((6, 0), (12, 6), (6, 12), (0, 6), (6, 0))
SHAPES = {
    "box": ([(BIG, [])], None),
    "repeated point": ([(ring((0, 0), (4, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0), (0, 0)), [])], None),
    "only repeated points": ([(ring((0, 0), (0, 0), (4, 0), (4, 0), (0, 0)), [])], "too_few_points"),
    "bow tie": ([(ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0)), [])], "self_intersection"),
    "figure of eight at a corner": ([(ring((0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)), [])], "self_intersection"),
    "corner on an own edge": ([(ring((0, 0), (8, 0), (8, 8), (4, 0), (0, 8), (0, 0)), [])], "self_intersection"),
    "spike": ([(ring((0, 0), (4, 0), (4, 4), (4, -2), (0, 4), (0, 0)), [])], "self_intersection"),
    "flat ring": ([(ring((0, 0), (4, 0), (8, 0), (0, 0)), [])], "self_intersection"),
    "hole": ([(BIG, [box(1, 1, 2, 2)])], None),
    "hole outside": ([(BIG, [box(20, 20, 21, 21)])], "hole_outside_shell"),
    "hole around the shell": ([(box(4, 4, 6, 6), [BIG])], "hole_outside_shell"),
    "hole that crosses": ([(BIG, [box(10, 10, 14, 11)])], "self_intersection"),
    "hole that shares an edge": ([(BIG, [box(0, 1, 2, 3)])], "self_intersection"),
    "hole that shares a piece of an edge at a corner": ([(BIG, [ring((0, 0), (3, 0), (3, 3), (0, 0))])], "self_intersection"),
    "hole in a hole": ([(BIG, [box(1, 1, 8, 8), box(2, 2, 3, 3)])], "nested_holes"),
    "equal holes": ([(BIG, [box(1, 1, 2, 2), box(1, 1, 2, 2)])], "self_intersection"),
    "hole touches once": ([(BIG, [ring((0, 6), (3, 5), (3, 7), (0, 6))])], None),
    "hole touches twice": ([(BIG, [ring((0, 6), (6, 0), (7, 7), (0, 6))])], "interior_cut"),
    "hole through corners of the shell, outside": ([(DIAMOND, [ring((6, 0), (12, 6), (12, 0), (6, 0))])], "self_intersection"),
    "hole leaves through corners only": ([(ring((0, 0), (6, 3), (12, 0), (12, 12), (6, 9), (0, 12), (0, 0)), [ring((6, 3), (7, 2), (8, 1), (8, 5), (6, 3))])], "self_intersection"),
    "hole outside, touching a corner": ([(DIAMOND, [ring((12, 6), (14, 5), (14, 7), (12, 6))])], "hole_outside_shell"),
    "three holes at one point": ([(BIG, [ring((6, 6), (5, 8), (7, 8), (6, 6)), ring((6, 6), (3, 5), (3, 4), (6, 6)), ring((6, 6), (9, 5), (9, 4), (6, 6))])], None),
    "ring of holes": ([(BIG, [ring((2, 2), (10, 2), (6, 3), (2, 2)), ring((10, 2), (6, 10), (8, 5), (10, 2)), ring((2, 2), (4, 5), (6, 10), (2, 2))])], "interior_cut"),
    "chain of holes to both sides": ([(BIG, [ring((0, 6), (6, 5), (6, 7), (0, 6)), ring((6, 5), (12, 6), (8, 7), (6, 5))])], "interior_cut"),
    "chain of holes from one side": ([(BIG, [ring((0, 6), (6, 5), (6, 7), (0, 6)), ring((6, 5), (11, 6), (8, 7), (6, 5))])], None),
    "parts apart": ([(box(0, 0, 1, 1), []), (box(5, 5, 6, 6), [])], None),
    "parts touch at a corner": ([(box(0, 0, 2, 2), []), (box(2, 2, 4, 4), [])], None),
    "parts share an edge": ([(box(0, 0, 2, 2), []), (box(2, 0, 4, 2), [])], "self_intersection"),
    "parts overlap": ([(box(0, 0, 3, 3), []), (box(2, 2, 4, 4), [])], "self_intersection"),
    "part within a part": ([(BIG, []), (box(2, 2, 4, 4), [])], "overlapping_parts"),
    "part within a hole": ([(BIG, [box(1, 1, 8, 8)]), (box(2, 2, 4, 4), [])], None),
    "part over a hole": ([(BIG, [box(5, 5, 6, 6)]), (box(2, 2, 9, 9), [])], "overlapping_parts"),
    "part within, touching corners": ([(DIAMOND, []), (ring((6, 0), (7, 6), (6, 12), (5, 6), (6, 0)), [])], "overlapping_parts"),
    "equal parts": ([(BIG, []), (BIG, [])], "self_intersection"),
    "no parts": ([], "empty"),
    "open": ([(ring((0, 0), (4, 0), (4, 4), (0, 4)), [])], "not_closed"),
    "no number": ([(ring((0, 0), (float("nan"), 0), (4, 4), (0, 4), (0, 0)), [])], "not_finite"),
}


def judged(spark, polygons):
    rows = [(k, parts) for k, parts in enumerate(polygons)]
    return {r["k"]: r["reason"] for r in validity.validity(spark.createDataFrame(rows, PARTS), "k").collect()}


def test_named_shapes(spark):
    got = judged(spark, [parts for parts, _ in SHAPES.values()])
    assert {name: got[k] for k, name in enumerate(SHAPES)} == {name: reason for name, (_, reason) in SHAPES.items()}
    nothing = spark.createDataFrame([(1, None), (None, [(BIG, None)])], PARTS)
    assert {tuple(r) for r in validity.validity(nothing, "k").collect()} == {(1, False, "empty"), (None, True, None)}
    assert validity.validity(nothing.limit(0), "k").collect() == []


def side(p, q, t):
    return (q[0] - p[0]) * (t[1] - p[1]) - (q[1] - p[1]) * (t[0] - p[0])


def shared(e, f):
    """The points that two edges share: none, one, or the ends of a stretch."""
    (a, b), (c, d) = e, f
    ends = {t for p, q, t in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)) if side(p, q, t) == 0 and min(p[0], q[0]) <= t[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= t[1] <= max(p[1], q[1])}
    crosses = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
    return ends, crosses


def within(p, edges):
    odd = False
    for a, b in edges:
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + Fraction(p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def brute(parts):
    """The rules over all pairs of edges, every edge cut where it is touched, every piece tested against every ring."""
    rings = {}
    for part, (shell, holes) in enumerate(parts):
        for n, r in enumerate([shell, *holes]):
            points = [p for k, p in enumerate(r) if k == 0 or p != r[k - 1]]
            if len(points) < 4:
                return "too_few_points"
            rings[part, n] = [(tuple(map(Fraction, a)), tuple(map(Fraction, b))) for a, b in itertools.pairwise(points)]
    touches = {}
    for (r, s) in itertools.combinations_with_replacement(rings, 2):
        for (i, e), (j, f) in itertools.product(enumerate(rings[r]), enumerate(rings[s])):
            if r == s and i >= j:
                continue
            ends, crosses = shared(e, f)
            neighbours = r == s and (j == i + 1 or (i == 0 and j == len(rings[r]) - 1))
            if crosses or len(ends) > 1 or (r == s and ends and not neighbours):
                return "self_intersection"
            if r != s:
                for x, k in ((r, i), (s, j)):
                    touches.setdefault((x, k), set()).update(ends)
    found = set()
    for r, edges in rings.items():
        for k, (a, b) in enumerate(edges):
            cuts = sorted({a, b, *touches.get((r, k), ())}, reverse=a > b)
            for p, q in itertools.pairwise(cuts):
                m = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
                inside = {s for s in rings if s != r and within(m, rings[s])}
                if r[1] and (r[0], 0) not in inside:
                    found.add("hole_outside_shell")
                if r[1] and any(s[0] == r[0] and s[1] for s in inside):
                    found.add("nested_holes")
                if not r[1] and any(s[1] == 0 and s[0] != r[0] and not any(h[0] == s[0] and h[1] for h in inside) for s in inside):
                    found.add("overlapping_parts")
    for part in range(len(parts)):
        links = {(("ring", r), p) for (r, _), points in touches.items() for p in points if r[0] == part and sum(r2[0] == part and p in more for (r2, _), more in touches.items() if r2 != r)}
        nodes = {x for link in links for x in link}
        near = {v: {b if v == a else a for a, b in links if v in (a, b)} for v in nodes}
        seen, pieces = set(), 0
        for v in nodes:
            if v not in seen:
                pieces += 1
                todo = [v]
                while todo:
                    w = todo.pop()
                    if w not in seen:
                        seen.add(w)
                        todo += near[w]
        if len(links) > len(nodes) - pieces:
            found.add("interior_cut")
    return min(found, key=validity.REASONS.index, default=None)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_polygons(spark, seed):
    """Small integer coordinates, so that corners, edges and rings meet in every way."""
    rnd = random.Random(seed)

    def some_ring(size, reach):
        x, y = rnd.randrange(reach), rnd.randrange(reach)
        points = [(x + rnd.randrange(size + 1), y + rnd.randrange(size + 1)) for _ in range(rnd.choice((3, 3, 3, 4)))]
        return ring(*points, points[0])

    def polygon():
        kind = rnd.randrange(6)
        shell = rnd.choice((box(0, 0, 8, 8), DIAMOND, some_ring(8, 3)))
        if kind == 0:
            return [(some_ring(6, 4), [])]
        if kind == 1:
            return [(shell, [some_ring(3, 8) for _ in range(rnd.randrange(1, 4))])]
        if kind == 2:
            return [(shell, []), (some_ring(3, 10), [])]
        if kind == 3:
            return [(box(0, 0, 12, 12), [some_ring(4, 9) for _ in range(4)]), (some_ring(3, 10), [])]
        if kind == 4:
            return [(box(0, 0, 12, 12), [box(1, 1, 10, 10)] * rnd.randrange(2) + [some_ring(3, 9)])]
        # corners on a coarse grid, so that holes touch each other and the shell at corners
        corner = lambda: (4 * rnd.randrange(4), 4 * rnd.randrange(4))
        return [(box(0, 0, 12, 12), [ring(a, b, c, a) for a, b, c in [(corner(), corner(), (4 + rnd.randrange(5), 4 + rnd.randrange(5))) for _ in range(rnd.randrange(1, 4))]])]

    polygons = [polygon() for _ in range(1500)]
    want = dict(enumerate(map(brute, polygons)))
    assert len(set(want.values())) >= 7
    got = judged(spark, polygons)
    assert {k: (got[k], polygons[k]) for k in want if got[k] != want[k]} == {} and got == want
