"""Registered queries of polygons, rasters and routes beyond those of ``hazard``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.functions import scalar as S
from slopeworks.operators import geometry, places, serving, timeseries
from slopeworks.plans.hazard import _GRID, _HAVERSINE, _NEAR, _STEPS, _UP, ORACLE, _cells, _diamonds, query
from slopeworks.runtime import by_key, table


def _ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def _part(shell: Column, *holes: Column) -> Column:
    none = F.array().cast(f"array<{geometry.RING}>")
    return F.struct(shell.alias("shell"), (F.array(*holes) if holes else none).alias("holes"))


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return _ring((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))


#: Boxes 10 apart, each 8 to 14 wide and 6 high, so that some overlap the next one of their row.
_BOXES = "b as (select s_suppkey as k, (s_suppkey % 10) * 10.0 as x1, (s_suppkey // 10) * 8.0 as y1, (s_suppkey % 10) * 10.0 + 8 + s_suppkey % 7 as x2, (s_suppkey // 10) * 8.0 + 6 as y2 from supplier)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 10) * 10.0, F.floor(k / 10) * 8.0
    return table(spark, sf_dir, "supplier").select(k.alias("k"), F.array(_part(_box(x, y, x + 8 + k % 7, y + 6))).alias("parts"))


@query(f"with {_BOXES} select p.k as a, q.k as b, round((least(p.x2, q.x2) - greatest(p.x1, q.x1)) * (least(p.y2, q.y2) - greatest(p.y1, q.y1))::double, 6) as area from b p join b q on p.k < q.k and p.x1 < q.x2 and q.x1 < p.x2 and p.y1 < q.y2 and q.y1 < p.y2")
def polygon_overlaps(spark, sf_dir):
    return geometry.overlaps(_boxes(spark, sf_dir), "k", 8.0).withColumn("area", F.round("area", 6))


_FAULTS = ("null", "'self_intersection'", "'too_few_points'", "'not_closed'", "'hole_outside_shell'", "null", "'self_intersection'", "'not_finite'")
_VALID = f"v as (select c_custkey as k, c_custkey % 8 as f, case c_custkey % 8 {' '.join(f'when {n} then {x}' for n, x in enumerate(_FAULTS))} end as reason from customer)"


def _odd_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By number: a box, a bow tie, a ring of three, an open ring, a hole outside, a box with a hole, a spike, a coordinate that is no number."""
    k = F.col("c_custkey")
    x = (k % 90).cast("double")
    at = lambda dx, dy: (x + dx, F.lit(float(dy)))
    box = _ring(at(0, 0), at(4, 0), at(4, 4), at(0, 4), at(0, 0))
    shapes = (
        _part(box), _part(_ring(at(0, 0), at(4, 4), at(4, 0), at(0, 4), at(0, 0))), _part(_ring(at(0, 0), at(4, 0), at(0, 0))), _part(_ring(at(0, 0), at(4, 0), at(4, 4), at(0, 4))),
        _part(box, _ring(at(5, 5), at(6, 5), at(6, 6), at(5, 5))), _part(box, _ring(at(1, 1), at(2, 1), at(2, 2), at(1, 1))), _part(_ring(at(0, 0), at(4, 0), at(4, 4), at(4, -2), at(0, 4), at(0, 0))),
        _part(_ring(at(0, 0), at(4, 0), at(float("nan"), 4), at(0, 4), at(0, 0))),
    )
    part = F.when(k % 8 == 0, shapes[0])
    for n, shape in enumerate(shapes[1:], 1):
        part = part.when(k % 8 == n, shape)
    beside = _part(_ring(at(10, 0), at(14, 0), at(14, 4), at(10, 4), at(10, 0)), _ring(at(11, 1), at(12, 1), at(12, 2), at(11, 1)))  # parts may not overlap
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 16 == 5, F.array(part, beside)).otherwise(F.array(part)).alias("parts"))


@query(f"with {_VALID} select k, reason is null as valid, reason from v")
def polygon_validity(spark, sf_dir):
    return places.validity(_odd_polygons(spark, sf_dir), "k")


@query(f"with {_VALID} select count(*) as records, count(*) filter (reason is null) as valid, count(*) filter (reason is not null) as invalid, count(*) filter (k % 16 = 5) as multipart, count(*) + count(*) filter (k % 16 = 5) as polygon_parts from v")
def geometry_summary(spark, sf_dir):
    rows = _odd_polygons(spark, sf_dir)
    flagged = rows.join(by_key(places.validity(rows, "k").select("k", F.col("valid").alias("flag"))), "k")
    return geometry.geometry_summary(flagged, F.col("flag"))


@query(f"with {_VALID} select k % 50 as code, count(*) + count(*) filter (k % 16 = 5) as n_parts from v where reason is null and k % 50 < 25 group by 1")
def merged_polygons(spark, sf_dir):
    """Valid polygons of the codes that the master knows; a code's polygons are one of several parts."""
    rows = _odd_polygons(spark, sf_dir).withColumn("code", F.col("k") % 50)
    master = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("code"))
    return places.merged(rows, "k", "code", master).select("code", F.size("parts").cast("long").alias("n_parts"))


@query("select cast(n_nationkey as varchar) as vlcode from nation where n_nationkey % 3 = 0")
def exact_code_polygons(spark, sf_dir):
    """Polygons whose three codes are those of one place; others have another district or sub-district."""
    k, n = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    text = lambda c: c.cast("string")
    polygons = n.select(text(k).alias("vlcode"), text(F.when(k % 3 == 1, -1).otherwise(F.col("n_regionkey"))).alias("dtcode"), text(F.when(k % 3 == 2, -1).otherwise(k % 4)).alias("sdcode"))
    villages = n.select(text(k).alias("village_lgd_code"), text(F.col("n_regionkey")).alias("district_lgd_code"), text(k % 4).alias("taluk_lgd_code"))
    return geometry.exact_code_polygons(polygons, villages).select("vlcode")


@query(f"select r_name as code, true as is_inside, true as has_name from region where r_regionkey <> 4")
def place_origins(spark, sf_dir):
    """A point inside each polygon, by the test that decides which points are inside; places without a polygon have none."""
    shapes = _diamonds(spark, sf_dir)
    master = table(spark, sf_dir, "region").select(F.col("r_name").alias("code"), F.col("r_name").alias("village_name"))
    four = table(spark, sf_dir, "region").filter("r_regionkey <> 4").select(F.col("r_name").alias("code"))
    rows = places.origins(master, shapes.join(four, "code", "left_semi"), "code").join(shapes, "code")
    inside = geometry.contains(geometry.edges(F.col("parts")), F.col("longitude"), F.col("latitude"))
    return rows.select("code", inside.alias("is_inside"), F.col("village_name").isNotNull().alias("has_name"))


@query(f"with {_BOXES} select floor(min(x1) / 30) * 30.0::double as west, floor(min(y1) / 30) * 30.0::double as south, ceil(max(x2) / 30) * 30.0::double as east, ceil(max(y2) / 30) * 30.0::double as north from b")
def snapped_bounds(spark, sf_dir):
    return places.bounds(_boxes(spark, sf_dir), step=30.0)


_POINTS = "p as (select c_custkey as k, c_custkey % 53 - 4 + 0.3 as x, 60.2 - (c_custkey // 53) as y from customer)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (k % 53 - 4 + 0.3).alias("x"), (60.2 - F.floor(k / 53)).alias("y"))


@query(f"""with {_GRID}, {_POINTS}, q as (select k, cast(floor(50 - y) as int) as r, cast(floor(x) as int) as c from p), j as (select k, r, c, case when z > 5 then z end as z from q left join cells on cells."row" = r and col = c)
select k, z, case when r < 0 or r >= 50 or c < 0 or c >= 40 then 'outside' when z is null then 'nodata' else 'sampled' end as sample_status from j""")
def raster_samples(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("z", F.when(F.col("z") > 5, F.col("z")).otherwise(float("nan")))
    rows = places.sample(_points(spark, sf_dir), cells, 0.0, 50.0, 1.0, 50, 40, ["z"])
    return rows.select("k", F.when(~F.isnan("z"), F.col("z")).alias("z"), "sample_status")


@query(f"""with {_GRID}, {_POINTS}, f as (select k, x - 0.5 as fx, 50 - y - 0.5 as fy from p), g as (select *, cast(floor(fx) as int) as c0, cast(floor(fy) as int) as r0 from f),
n as (select k, c0 + dc as c, r0 + dr as r, (case when dc = 1 then fx - c0 else 1 - (fx - c0) end) * (case when dr = 1 then fy - r0 else 1 - (fy - r0) end) as w from g, (values (0), (1)) a(dc), (values (0), (1)) b(dr))
select k, round(cast(sum(w * z) / nullif(sum(w) filter (z is not null), 0) as double), 6) as z from n left join (select "row", col, z from cells where z > 5) m on m."row" = r and m.col = c group by k""")
def bilinear_warp(spark, sf_dir):
    cells = _cells(spark, sf_dir).filter("z > 5")
    return places.bilinear(_points(spark, sf_dir), cells, 0.0, 50.0, 1.0).select("k", F.round("z", 6).alias("z"))


@query(f"""with {_GRID}, {_BOXES}, c as (select "row", col, col * 2.5 + 1.25 as x, "row" * 1.5 + 0.75 as y from cells), d as (select "row", col, min(greatest(0, x1 - x, x - x2) ** 2 + greatest(0, y1 - y, y - y2) ** 2) as q from c, b where k % 3 = 0 group by 1, 2)
select "row", col, q <= 2.25 as in_mask from d""")
def analysis_mask(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("row", "col", (F.col("col") * 2.5 + 1.25).alias("x"), (F.col("row") * 1.5 + 0.75).alias("y"))
    return places.analysis_mask(cells, _boxes(spark, sf_dir).filter("k % 3 = 0"), "k", 1.5, 8.0).select("row", "col", "in_mask")


#: Level routes through the boxes' rows, so that the distance to a box is that of two ranges.
_ROUTES = "r as (select n_nationkey as route, 0.0 as x1, n_nationkey * 3.5 - 2 as y, 20.0 + n_nationkey * 3 as x2 from nation)"
_MET = f"{_BOXES}, {_ROUTES}, met as (select route, k from r, b where greatest(0, b.x1 - r.x2, r.x1 - b.x2) ** 2 + greatest(0, b.y1 - r.y, r.y - b.y2) ** 2 <= 1)"


def _route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("route"), F.lit(0.0).alias("x1"), (k * 3.5 - 2).alias("y1"), (k * 3 + 20.0).alias("x2"), (k * 3.5 - 2).alias("y2"))


@query(f"with {_MET} select route, k from met")
def corridor_polygons(spark, sf_dir):
    return places.corridor(_boxes(spark, sf_dir), _route_lines(spark, sf_dir), "k", "route", 1.0)


@query(f"""with {_MET}, w as (select s_suppkey as k, case when s_suppkey % 23 = 0 then 'red' when s_suppkey % 5 = 0 then 'orange' when s_suppkey % 4 = 0 then 'yellow' else 'green' end as stage, 60 + s_suppkey % 29 as score from supplier where s_suppkey % 6 <> 0),
h as (select route, count(*) filter (stage = 'red') as n_red, count(*) filter (stage = 'orange') as n_orange, count(*) filter (stage = 'yellow') as n_yellow, count(*) filter (score >= 80) as n_high from met join w using (k) group by 1),
p as (select c_custkey as e, cast(c_custkey % 110 as double) as x, (c_custkey // 110) * 6.1 as y from customer), ev as (select route, count(*) as n_events from r, p where greatest(0, r.x1 - p.x, p.x - r.x2) ** 2 + (p.y - r.y) ** 2 <= 1 group by 1)
select route, coalesce(n_red, 0) as n_red, coalesce(n_orange, 0) as n_orange, coalesce(n_yellow, 0) as n_yellow, coalesce(n_high, 0) as n_high, coalesce(n_events, 0) as n_events,
 case when n_red > 0 then 'high_risk' when coalesce(n_orange, 0) + coalesce(n_yellow, 0) + coalesce(n_high, 0) + coalesce(n_events, 0) > 0 then 'caution' else 'preferred' end as status from r left join h using (route) left join ev using (route)""")
def route_assessment(spark, sf_dir):
    lines, k, c = _route_lines(spark, sf_dir), F.col("s_suppkey"), F.col("c_custkey")
    met = places.corridor(_boxes(spark, sf_dir), lines, "k", "route", 1.0)
    stage = F.when(k % 23 == 0, "red").when(k % 5 == 0, "orange").when(k % 4 == 0, "yellow").otherwise("green")
    warned = table(spark, sf_dir, "supplier").filter(k % 6 != 0).select(k.alias("k"), stage.alias("stage"), (60 + k % 29).alias("score"))
    points = table(spark, sf_dir, "customer").select(c.alias("event"), (c % 110).cast("double").alias("x"), (F.floor(c / 110) * 6.1).alias("y"))
    events = geometry.near_routes(points, lines, "event", "route", 1.0)
    return places.assess_routes(lines.select("route"), met, warned, events, "route", "k")


@query("with r as (select o_orderkey, o_custkey, case o_orderkey % 4 when 0 then 'preferred' when 1 then 'caution' when 2 then 'high_risk' when 3 then 'unheard' end as status, o_totalprice as d from orders) select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by case status when 'preferred' then 1 when 'caution' then 2 when 'high_risk' then 3 else 4 end, d, o_orderkey) as int) as position from r")
def route_order_unknown(spark, sf_dir):
    k = F.col("o_orderkey")
    zero = F.lit(0)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(k % 4 == 0, "preferred").when(k % 4 == 1, "caution").when(k % 4 == 2, "high_risk").when(k % 8 == 3, "unheard").alias("status"),
        zero.alias("n_red"), zero.alias("n_orange"), zero.alias("n_high"), zero.alias("n_events"), F.col("o_totalprice").alias("distance_m"), k.alias("duration_s"),
    )
    return serving.ranked(rows, serving.route_order(), ["o_custkey"]).select("o_custkey", "o_orderkey", "position")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'EVENT_DATE_UNKNOWN' when d.day is not null then 'RAINFALL_DATE_AVAILABLE' else 'RAINFALL_DATE_NOT_AVAILABLE' end as temporal_status, case when c_custkey % 3 <> 0 then cast(year(e.day) as int) else 0 end as event_year, c_custkey % 3 <> 0 and y.y is not null as rainfall_year_available
from (select c_custkey, date '1990-01-01' + cast(c_custkey * 3 as int) as day from customer) e left join (select distinct cast(o_orderdate as date) as day from orders where o_orderkey % 5 = 0) d on d.day = e.day left join (select distinct year(o_orderdate) as y from orders where o_orderkey % 5 = 0) y on y.y = year(e.day)""")
def temporal_status(spark, sf_dir):
    k = F.col("c_custkey")
    iso = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (k * 3).cast("int")), "yyyy-MM-dd")
    events = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 6 == 0, " ").when(k % 6 == 3, "31 February").otherwise(iso).alias("reported_history_date"))
    rain = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderdate").alias("date"))
    return timeseries.temporal_status(events, rain).drop("reported_history_date").withColumn("event_year", F.coalesce("event_year", F.lit(0)))


@query(f"""with c as (select c_custkey, 8 + (c_custkey * 7919 % 10007) / 1000.0 as lat, 70 + (c_custkey * 104729 % 10009) / 1000.0 as lon from customer where c_custkey < 100), d as (select c.c_custkey, s.c_custkey as near, {_HAVERSINE} as km from c, c s where c.c_custkey <> s.c_custkey)
select c_custkey, min_by(near, struct_pack(a := km, b := near)) as nearest_id, round(min(km), 6) as distance_km from d group by 1""")
def nearest_other(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").filter("c_custkey < 100").select(k.alias("c_custkey"), (8 + (k * 7919 % 10007) / 1000.0).alias("lat"), (70 + (k * 104729 % 10009) / 1000.0).alias("lon"))
    rows = geometry.nearest_sites(points, points.withColumnRenamed("c_custkey", "other"), "c_custkey", "other", exclude_same=True)
    return rows.withColumn("distance_km", F.round("distance_km", 6))


@query(f"with {_GRID}, r as (select r_name, r_regionkey from region), c as (select col + 0.5 as x, \"row\" % 11 + 0.25 as y from cells) select r_name as code, cast(x as double) as x, cast(y as double) as y from c, r where {_NEAR} < 4 and {_NEAR} > 1")
def cells_within(spark, sf_dir):
    cells = _cells(spark, sf_dir).select((F.col("col") + 0.5).alias("x"), (F.col("row") % 11 + 0.25).alias("y"))
    return places.within(cells, _diamonds(spark, sf_dir), "code")


_SEGMENTS = f"""{_UP}, nn as (select acc."row" || '_' || acc.col as node, best.tr || '_' || best.tc as down, accumulation >= 4 as s from acc left join best on best."row" = acc."row" and best.col = acc.col), deg as (select down as node, count(*) as k from nn where down is not null group by 1),
st as (select nn.node, down, coalesce(k, 0) <> 1 as start from nn left join deg using (node) where s), walk(head, node, step) as (select node, node, 0 from st where start union all select head, t.node, step + 1 from walk join st f on f.node = walk.node join st t on t.node = f.down where not (f.start and step > 0))"""


ORACLE["stream_segments"] = f"{_SEGMENTS}, w as (select head, string_agg(node, '>' order by step) as nodes, count(*) as n from walk group by 1) select head as segment, nodes from w where n >= 2"
ORACLE["depression_fill"] = f"""with recursive {_GRID}, {_STEPS}, z as (select "row" as r, col as c, z from cells), cnt as (select a.r, a.c, count(*) as n from z a, steps join z b on b.r = a.r + dr and b.c = a.c + dc group by 1, 2),
fill(r, c, lvl) using key (r, c) as (select z.r, z.c, z.z from z join cnt on cnt.r = z.r and cnt.c = z.c where n < 8
 union select b.r, b.c, min(greatest(b.z, f.lvl)) from fill f, steps join z b on b.r = f.r + dr and b.c = f.c + dc left join recurring.fill o on o.r = b.r and o.c = b.c where o.lvl is null or greatest(b.z, f.lvl) < o.lvl group by 1, 2)
select fill.r as "row", fill.c as col, z.z, lvl as filled from fill join z on z.r = fill.r and z.c = fill.c"""


@query("select cast(count(*) as bigint) as n, cast(sum(case when c_custkey % 2 = 0 then 1 else 0 end) as bigint) as n_even from customer where c_custkey < 50")
def collected_features(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter("c_custkey < 50").withColumn("line", F.array(F.array(F.array(F.lit(76.5), F.lit(11.25)), F.array(F.lit(76.75), F.lit(11.5)))))
    one = places.feature_collection(geometry.geojson(rows, ["c_custkey"], "line"))
    found = F.from_json("value", "features array<struct<properties:struct<c_custkey:long>>>")["features"]
    keys = F.transform(found, lambda f: f["properties"]["c_custkey"])
    return one.select(F.size(keys).cast("long").alias("n"), F.size(F.filter(keys, lambda x: x % 2 == 0)).cast("long").alias("n_even"))


@query("select o_orderkey, case when o_orderkey % 40 < 2 then 'no_data' when o_orderkey * 5 <= 600 then 'online' when o_orderkey * 5 <= 1800 then 'stale' else 'offline' end as freshness from orders where o_orderkey < 1000")
def freshness_limits(spark, sf_dir):
    k, now = F.col("o_orderkey"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    received = F.when(k % 40 >= 2, F.timestamp_add("SECOND", (-5 * k).cast("int"), now))
    return table(spark, sf_dir, "orders").filter("o_orderkey < 1000").select("o_orderkey", S.freshness(received, now).alias("freshness"))
