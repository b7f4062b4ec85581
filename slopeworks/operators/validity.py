"""Validity of polygons with holes and parts, by equal joins on grid cells of each polygon's own extent.

A point that a ring repeats in a row counts once. Then, in this order:

* ``empty``, ``too_few_points``, ``not_closed``, ``not_finite``: what a ring's points show alone;
* ``self_intersection``: a ring crosses, touches or runs along itself, or two rings cross or share a stretch of an edge;
* ``hole_outside_shell``, ``nested_holes``, ``overlapping_parts``: a ring lies where it may not;
* ``interior_cut``: rings of a part touch each other at points so that they cut its interior in two.

Edges meet where they share a cell, never all with all. Between two places where it is touched a ring lies on one side of
any other, so one point of each such arc tells where it lies: whether it is inside of a ring is the parity of the edges to its right, which
an equal join on horizontal strips finds for all rings of the polygon at once. The rings of a part and the points where they touch are a
graph; they cut the interior if it has a cycle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.operators.geometry import RING
from slopeworks.runtime import by_key, on_workers, settled

#: Reasons in the order in which one is given for a polygon that has several (fixed values).
REASONS = ("empty", "too_few_points", "not_closed", "not_finite", "self_intersection", "hole_outside_shell", "nested_holes", "overlapping_parts", "interior_cut")


def _once(ring: Column) -> Column:
    """The ring without points equal to the one before."""
    return F.filter(ring, lambda p, k: (k == 0) | (p["x"] != F.get(ring, k - 1)["x"]) | (p["y"] != F.get(ring, k - 1)["y"]))


def _rings(parts: Column) -> Column:
    """(part, ring, r): ring 0 of a part is its shell."""
    holes = lambda p: F.coalesce(p["holes"], F.array().cast(f"array<{RING}>"))
    of = lambda p, part: F.transform(F.concat(F.array(p["shell"]), holes(p)), lambda r, ring: F.struct(part.alias("part"), ring.alias("ring"), _once(r).alias("r")))
    return F.flatten(F.transform(parts, of))


def _ring_fault(r: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return (
        F.when(r.isNull() | (F.size(r) < 4), "too_few_points").when((r[0]["x"] != F.element_at(r, -1)["x"]) | (r[0]["y"] != F.element_at(r, -1)["y"]), "not_closed")
        .when(F.exists(r, lambda p: ~finite(p["x"]) | ~finite(p["y"])), "not_finite")
    )


def _side(p: Column, q: Column, t: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (t["y"] - p["y"]) - (q["y"] - p["y"]) * (t["x"] - p["x"]))


def _between(p: Column, q: Column, t: Column) -> Column:
    return t["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & t["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))


def _edges(shaped: DataFrame) -> DataFrame:
    """(_code, x0, y0, cell, part, ring, n, k, a, b): the edges of all rings, numbered along them, with their polygon's grid."""
    points = F.flatten(F.transform("_rings", lambda r: r["r"]))
    low = {c: F.array_min(F.transform(points, lambda p: p[c])) for c in ("x", "y")}
    extent = F.greatest(*(F.array_max(F.transform(points, lambda p: p[c])) - low[c] for c in ("x", "y")))
    # as many cells along a side as a square of as many edges has
    rows = shaped.select("_code", low["x"].alias("x0"), low["y"].alias("y0"), (extent / F.ceil(F.sqrt(F.size(points)))).alias("cell"), F.explode("_rings").alias("e"))
    r = F.col("e.r")
    pairs = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.select("_code", "x0", "y0", "cell", "e.part", "e.ring", (F.size(r) - 1).alias("n"), F.posexplode(pairs).alias("k", "s"))
    return rows.select("_code", "x0", "y0", "cell", "part", "ring", "n", "k", "s.a", "s.b")


def _cells(c: str) -> Column:
    """The cells along an axis that an edge spans."""
    at = lambda v: F.floor((v - F.col(f"{c}0")) / F.col("cell"))
    return F.explode(F.sequence(at(F.least(F.col(f"a.{c}"), F.col(f"b.{c}"))), at(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")))))


def _meetings(edges: DataFrame) -> DataFrame:
    """Pairs of edges that share a point: where they touch, and whether that is a fault whatever rings they are of."""
    spread = edges.withColumn("cx", _cells("x")).withColumn("cy", _cells("y"))
    own = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("part", "ring", "k", "a", "b")]
    met = spread.select("_code", "cx", "cy", "n", *own(1)).join(by_key(spread.select("_code", "cx", "cy", *own(2))), ["_code", "cx", "cy"])
    key = lambda n: F.struct(f"part{n}", f"ring{n}", f"k{n}")
    a1, b1, a2, b2 = (F.col(c) for c in ("a1", "b1", "a2", "b2"))
    s1, s2, s3, s4 = _side(a1, b1, a2), _side(a1, b1, b2), _side(a2, b2, a1), _side(a2, b2, b1)
    crosses = (s1 * s2 < 0) & (s3 * s4 < 0)
    on = lambda p, q, t, s: F.when((s == 0) & _between(p, q, t), t)
    touches = F.array_distinct(F.array_compact(F.array(on(a1, b1, a2, s1), on(a1, b1, b2, s2), on(a2, b2, a1, s3), on(a2, b2, b1, s4))))
    met = met.filter(key(1) < key(2)).withColumns({"crosses": crosses, "touches": touches}).filter(F.col("crosses") | (F.size("touches") > 0))
    same = (F.col("part1") == F.col("part2")) & (F.col("ring1") == F.col("ring2"))
    following = (F.col("k2") == F.col("k1") + 1) | ((F.col("k1") == 0) & (F.col("k2") == F.col("n") - 1))
    # two points in common are a stretch in common; neighbours along a ring have one
    fault = F.col("crosses") | (F.size("touches") > 1) | (same & ~following)
    # what neighbours along a ring share is not looked at again
    return met.withColumns({"fault": fault, "same": same}).filter(fault | ~same).select("_code", "part1", "ring1", "k1", "a1", "b1", "part2", "ring2", "k2", "a2", "b2", "touches", "fault", "same").distinct()


def _arc_points(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """A point (part, ring, x, y) on every arc between two places where a ring is touched, or any of a ring that is not."""
    sides = [touched.select("_code", *(F.col(f"{c}{n}").alias(c) for c in ("part", "ring", "k", "a", "b")), F.explode("touches").alias("t")) for n in (1, 2)]
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    along = F.when(F.abs(b["x"] - a["x"]) >= F.abs(b["y"] - a["y"]), (t["x"] - a["x"]) / (b["x"] - a["x"])).otherwise((t["y"] - a["y"]) / (b["y"] - a["y"]))
    # a touch at an edge's end is one at the next one's start
    starts = sides[0].unionByName(sides[1]).withColumn("u", along).filter("u < 1")
    on_edge = starts.groupBy("_code", "part", "ring", "k", "a", "b").agg(F.array_sort(F.collect_set("u")).alias("us"))
    middles = F.transform("us", lambda u, k: (u + F.coalesce(F.get("us", k + 1), F.lit(1.0))) / 2)
    arcs = on_edge.select("_code", "part", "ring", "a", "b", F.explode(middles).alias("m"))
    at = lambda c: (a[c] + F.col("m") * (b[c] - a[c])).alias(c)
    arcs = arcs.select("_code", "part", "ring", at("x"), at("y"))
    free = edges.filter("k = 0").join(by_key(arcs.select("_code", "part", "ring").distinct()), ["_code", "part", "ring"], "left_anti")
    return arcs.unionByName(free.select("_code", "part", "ring", "a.x", "a.y"))


def _inside(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(points' columns, t_part, t_ring) for each other ring of the polygon that a point is inside of."""
    grid = edges.filter("part = 0 and ring = 0 and k = 0").select("_code", "y0", "cell")
    placed = points.join(by_key(grid), "_code").withColumn("cy", F.floor((F.col("y") - F.col("y0")) / F.col("cell"))).drop("y0", "cell")
    strips = edges.withColumn("cy", _cells("y")).select("_code", "cy", F.col("part").alias("t_part"), F.col("ring").alias("t_ring"), "a", "b")
    a, b, x, y = F.col("a"), F.col("b"), F.col("x"), F.col("y")
    met = placed.join(by_key(strips), ["_code", "cy"]).filter((F.col("part") != F.col("t_part")) | (F.col("ring") != F.col("t_ring")))
    right = ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))
    return met.filter(right).groupBy("_code", "part", "ring", "x", "y", "t_part", "t_ring").agg((F.count("*") % 2).alias("odd")).filter("odd = 1").drop("odd")


def _cut(key: tuple, links: pa.Table) -> pa.Table:
    """Whether the rings of a part and the points where they touch form a cycle."""
    above: dict = {}

    def top(v: tuple) -> tuple:
        while above.setdefault(v, v) != v:
            above[v] = v = above[above[v]]
        return v

    cycle = False
    for ring, x, y in zip(*(links.column(c).to_pylist() for c in ("ring", "x", "y"))):
        one, other = top((ring,)), top((x + 0.0, y + 0.0))
        cycle |= one == other
        above[one] = other
    return pa.table({"_code": pa.array([key[0].as_py()] * cycle, links.schema.field("_code").type)})


def validity(polygons: DataFrame, code: str, parts: str = "parts") -> DataFrame:
    """(code, valid, reason) of every polygon; ``code`` is unique. A null or empty list of parts is ``empty``, a null code a polygon like others."""
    on_workers(polygons.sparkSession)
    name = F.when(F.col(code).isNull(), "none").otherwise(F.concat(F.lit("is "), F.col(code).cast("string")))
    rows = polygons.select(F.col(code), name.alias("_code"), _rings(F.col(parts)).alias("_rings"), (F.coalesce(F.size(parts), F.lit(0)) < 1).alias("_empty"))
    faults = F.array_compact(F.transform("_rings", lambda r: _ring_fault(r["r"])))
    shaped = rows.withColumn("_shape", F.when(F.col("_empty") | F.col("_rings").isNull(), "empty").otherwise(F.get(faults, 0)))
    edges = settled(_edges(shaped.filter("_shape is null")))
    met = settled(_meetings(edges))
    found = [met.filter("fault").select("_code", F.lit("self_intersection").alias("reason"))]
    several = settled(edges.filter("part > 0 or ring > 0").select("_code").distinct().join(by_key(met.filter("fault").select("_code").distinct()), "_code", "left_anti"))
    edges = settled(edges.join(by_key(several), "_code", "left_semi"))
    touched = met.filter("not fault").join(by_key(several), "_code", "left_semi")
    points = settled(_arc_points(edges, touched))
    inside = settled(_inside(points, edges))
    spot = ["_code", "part", "ring", "x", "y"]
    held = inside.filter("part = t_part and t_ring = 0").select(*spot)
    found.append(points.filter("ring > 0").join(by_key(held), spot, "left_anti").select("_code", F.lit("hole_outside_shell").alias("reason")))
    found.append(inside.filter("part = t_part and ring > 0 and t_ring > 0").select("_code", F.lit("nested_holes").alias("reason")))
    covered = inside.filter("ring = 0 and part <> t_part")
    in_hole = covered.filter("t_ring > 0").select(*spot, "t_part")
    found.append(covered.filter("t_ring = 0").join(by_key(in_hole), [*spot, "t_part"], "left_anti").select("_code", F.lit("overlapping_parts").alias("reason")))
    links = touched.filter("part1 = part2").select("_code", F.col("part1").alias("part"), F.array("ring1", "ring2").alias("rings"), F.explode("touches").alias("t")).select("_code", "part", F.explode("rings").alias("ring"), "t.x", "t.y").distinct()
    found.append(links.groupBy("_code", "part").applyInArrow(_cut, "_code string").withColumn("reason", F.lit("interior_cut")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    worst = every.groupBy("_code").agg(F.min_by("reason", order).alias("_found"))
    out = shaped.join(by_key(worst), "_code", "left").withColumn("reason", F.coalesce("_shape", "_found"))
    return out.select(code, F.col("reason").isNull().alias("valid"), "reason")
