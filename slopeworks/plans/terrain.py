"""Queries over whole rasters: filled and drained flow and what follows from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.operators import drainage, lines, raster, warp
from slopeworks.plans.hazard import _GRID, _STEPS, _cells, query
from slopeworks.runtime import settled, table

#: Levels by the least spill, steps on flats, directions, and a walk from each cell: acc has all of it.
_DRAINED = f"""with recursive {_GRID}, {_STEPS}, z as (select "row" as r, col as c, z from cells), inner_cells as (select a.r, a.c from z a, steps join z b on b.r = a.r + dr and b.c = a.c + dc group by 1, 2 having count(*) = 8),
outlets as (select r, c, z from z anti join inner_cells using (r, c)),
fill(r, c, lvl) using key (r, c) as (select r, c, z from outlets
 union select b.r, b.c, min(greatest(b.z, f.lvl)) from fill f, steps join z b on b.r = f.r + dr and b.c = f.c + dc left join recurring.fill o on o.r = b.r and o.c = b.c where o.lvl is null or greatest(b.z, f.lvl) < o.lvl group by 1, 2),
near as (select a.r, a.c, a.lvl, b.r as nr, b.c as nc, b.lvl as nlvl, k, code, (a.lvl - b.lvl) / case when k % 2 = 1 then sqrt(2.0) else 1.0 end as d from fill a, steps join fill b on b.r = a.r + dr and b.c = a.c + dc),
sinks as (select distinct r, c from near where d > 0 union select r, c from outlets),
flat(r, c, s) using key (r, c) as (select r, c, 0 from sinks
 union select n.r, n.c, min(f.s + 1) from flat f join near n on n.nr = f.r and n.nc = f.c left join recurring.flat o on o.r = n.r and o.c = n.c where n.lvl = n.nlvl and (o.s is null or f.s + 1 < o.s) group by 1, 2),
leads as (select n.r, n.c, n.nr, n.nc, n.code, row_number() over (partition by n.r, n.c order by greatest(d, 0) desc, k) as p from near n join flat a on a.r = n.r and a.c = n.c join flat b on b.r = n.nr and b.c = n.nc
 where (n.r, n.c) not in (select (r, c) from outlets) and (d > 0 or (n.lvl = n.nlvl and b.s = a.s - 1))),
dir as (select r, c, nr, nc, code from leads where p = 1),
walk(r, c, pr, pc) as (select r, c, r, c from z union all select w.r, w.c, d.nr, d.nc from walk w join dir d on d.r = w.pr and d.c = w.pc),
acc as (select fill.r, fill.c, lvl, coalesce(code, 0) as direction, nr, nc, n from fill left join dir on dir.r = fill.r and dir.c = fill.c join (select pr as r, pc as c, count(*) as n from walk group by 1, 2) w on w.r = fill.r and w.c = fill.c)"""


@query(f'{_DRAINED} select r as "row", c as col, lvl as filled, cast(direction as int) as direction, n as accumulation from acc')
def drained_flow(spark, sf_dir):
    return drainage.flow(_cells(spark, sf_dir))


@query(f'{_DRAINED} select count(*) as n_cells, count(*) filter (direction = 0) as n_outlets, cast(sum(n) filter (direction = 0) as bigint) as n_drained, cast(0 as bigint) as n_undrained from acc')
def drained_whole(spark, sf_dir):
    """Outlets take all cells, and no cell within the raster is without a direction."""
    cells = settled(drainage.flow(_cells(spark, sf_dir)))
    lost = drainage.unresolved(cells).agg(F.count("*").alias("n_undrained"))
    outlet = F.col("direction") == 0
    return cells.agg(F.count("*").alias("n_cells"), F.count_if(outlet).alias("n_outlets"), F.sum(F.when(outlet, F.col("accumulation"))).alias("n_drained")).crossJoin(lost)


@query(f"""{_DRAINED}, m as (select r // 8 as zone, * from acc)
select cast(zone as bigint) as zone, count(*) as n_cells, max(n) as max_accumulation, round(avg(n), 6) as mean_accumulation, round(avg(case when n >= 20 then 1.0 else 0.0 end), 6) as stream_fraction,
round(coalesce(sum(case when n >= 20 and direction > 0 then case when direction in (2, 8, 32, 128) then 30 * sqrt(2.0) else 30.0 end end), 0) / 1000, 6) as stream_km from m group by 1""")
def drained_zones(spark, sf_dir):
    cells = drainage.flow(_cells(spark, sf_dir)).withColumn("zone", F.floor(F.col("row") / 8))
    out = raster.zonal_hydrology(cells, "zone", 30.0, 20)
    return out.select("zone", "n_cells", "max_accumulation", *(F.round(c, 6).alias(c) for c in ("mean_accumulation", "stream_fraction", "stream_km")))


_SIMPLE = """with recursive pts as (select c_nationkey as line, cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as k, c_custkey / 10.0 as x, c_acctbal / 100.0 as y from customer), ends as (select line, max(k) as n from pts group by 1),
seg(line, i, j) as (select line, 1, n from ends where n > 1 union all select line, unnest([i, m]) as i, unnest([m, j]) as j from (
 select s.line, i, j, arg_max(p.k, (away, -p.k)) as m, max(away) as worst from (
  select s.line, i, j, p.k, sqrt(pow(p.x - (a.x + t * (b.x - a.x)), 2) + pow(p.y - (a.y + t * (b.y - a.y)), 2)) as away from seg s join pts a on a.line = s.line and a.k = i join pts b on b.line = s.line and b.k = j join pts p on p.line = s.line and p.k > i and p.k < j,
  lateral (select greatest(0, least(1, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / (pow(b.x - a.x, 2) + pow(b.y - a.y, 2)))) as t)) s join pts p using (line, k) group by s.line, i, j) where worst > 15)
select line, count(distinct k) as n_points, cast(sum(distinct k) as bigint) as kept from (select line, i as k from seg union select line, j from seg union select line, 1 from ends) group by 1"""


@query(_SIMPLE)
def simplified_lines(spark, sf_dir):
    """A line of customers for each nation, without the points that lie within 15 of what is left."""
    points = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") / 10.0).alias("x"), (F.col("c_acctbal") / 100.0).alias("y"))
    whole = points.groupBy(F.col("c_nationkey").alias("line")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "x", "y"))).alias("all"))
    shaped = whole.select("line", F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"), F.transform("all", lambda p: p["x"]).alias("xs"))
    rows = lines.simplified(shaped, 15.0)
    at = F.transform("points", lambda p: F.array_position("xs", p["x"]))
    return rows.select("line", F.size("points").cast("long").alias("n_points"), F.aggregate(at, F.lit(0).cast("long"), lambda a, k: a + k).alias("kept"))


@query("""with o as (select o_orderkey as k, 76 + o_orderkey % 100 / 1000.0 as x, case when o_orderkey % 17 = 0 then 91.0 else 11.0 + o_custkey % 100 / 1000.0 end as y, o_totalprice as d, case when o_orderkey % 19 = 0 then 0.0 else 60.0 + o_orderkey % 1000 end as t from orders),
n as (select *, case when k % 13 = 0 then 'no_route' when y > 90 then 'coordinate_out_of_range' when t = 0 then 'not_positive' end as reason from o),
g as (select *, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(11.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(11.0)) * pow(sin(radians(76.0 - x) / 2), 2)))) as gap from n)
select k as o_orderkey, case when k % 2 = 0 then 'OSRM / OpenStreetMap' else 'OpenRouteService / OpenStreetMap' end as provider_name, reason, case when reason is null then round(d, 2) end as distance_m, case when reason is null then round(gap, 3) end as origin_gap_m,
 reason is null and gap <= 50 as near_origin from g""")
def provider_routes(spark, sf_dir):
    """Orders as answers of two routing services, brought to one shape, and how far each route begins from a fixed place."""
    k = F.col("o_orderkey")
    x, y = 76 + k % 100 / 1000.0, F.when(k % 17 == 0, 91.0).otherwise(11.0 + F.col("o_custkey") % 100 / 1000.0)
    duration = F.when(k % 19 == 0, 0.0).otherwise(60.0 + k % 1000)
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(F.array(x, y), F.array(F.lit(76.5), F.lit(11.5))).alias("coordinates"))
    total = F.col("o_totalprice").cast("double")
    plain = F.to_json(F.struct(F.when(k % 13 == 0, "NoRoute").otherwise("Ok").alias("code"), F.array(F.struct(geometry.alias("geometry"), total.alias("distance"), duration.alias("duration"))).alias("routes")))
    feature = F.struct(geometry.alias("geometry"), F.struct(F.struct(total.alias("distance"), duration.alias("duration")).alias("summary")).alias("properties"))
    collection = F.to_json(F.struct(F.when(k % 13 != 0, F.array(feature)).alias("features")))
    answers = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, "osrm").otherwise("ors").alias("provider"), F.when(k % 2 == 0, plain).otherwise(collection).alias("body"))
    gap, _ = lines.end_gaps(F.col("points"), (F.lit(11.0), F.lit(76.0)), (F.lit(11.5), F.lit(76.5)))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    rows = lines.routes(answers, "provider")
    return rows.select("o_orderkey", "provider_name", "reason", good(F.round("distance_m", 2)).alias("distance_m"), good(F.round(gap, 3)).alias("origin_gap_m"), F.coalesce(F.col("reason").isNull() & (gap <= 50), F.lit(False)).alias("near_origin"))


def _inverse_sql() -> str:
    """The inverse projection of (e, n) in zone 43 as SQL, step by step, with this library's coefficients."""
    beta = lambda f, g: " - ".join(f"{b!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, b in enumerate(warp.BETA, 1))
    delta = " + ".join(f"{d!r} * sin({2 * j} * chi)" for j, d in enumerate(warp.DELTA, 1))
    scale = repr(0.9996 * warp.RADIUS)
    return f"""u0 as (select *, n / {scale} as xi, (e - 500000) / {scale} as eta from target), u1 as (select *, xi - {beta('sin', 'cosh')} as xs, eta - {beta('cos', 'sinh')} as es from u0),
u2 as (select *, asin(sin(xs) / cosh(es)) as chi from u1), placed as (select "row", col, degrees(chi + {delta}) as lat, 75 + degrees(atan2(sinh(es), cos(xs))) as lon from u2)"""


#: South-west and north-east corners of the target in metres; the source begins at 76 east, 12 north, with cells of 0.001 degrees.
_EAST, _SOUTH, _WIDE, _HIGH = 609_300.0, 1_321_200.0, 2_700.0, 3_000.0


@query(f"""with {_GRID}, target as (select cast(r as int) as "row", cast(c as int) as col, {_EAST} + (c + 0.5) * 100 as e, {_SOUTH + _HIGH} - (r + 0.5) * 100 as n from range({int(_HIGH // 100)}) a(r), range({int(_WIDE // 100)}) b(c)), {_inverse_sql()},
f as (select "row" as r, col as c, (lon - 76) / 0.001 - 0.5 as fx, (12 - lat) / 0.001 - 0.5 as fy from placed), k as (select *, floor(fx) as c0, floor(fy) as r0, fx - floor(fx) as u, fy - floor(fy) as v from f),
w as (select r, c, c0 + dc as sc, r0 + dr as sr, case when dc = 1 then u else 1 - u end * case when dr = 1 then v else 1 - v end as w from k, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc))
select r as "row", c as col, round(sum(w * z) / sum(case when z is not null then w end), 6) as z from w left join cells on cells."row" = sr and cells.col = sc group by 1, 2""")
def warped_grid(spark, sf_dir):
    """The raster on a grid of 100 metres in zone 43, null where the source has no cell."""
    target, _, _ = warp.grid(spark, _EAST, _SOUTH, _EAST + _WIDE, _SOUTH + _HIGH, 100.0)
    rows = warp.warped(_cells(spark, sf_dir), target, 76.0, 12.0, 0.001)
    return rows.select("row", "col", F.round("z", 6).alias("z"))
