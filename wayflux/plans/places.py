"""Queries of spatial operators (X rows, J14 to J19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.operators import spatial as X
from wayflux.operators.graph import connected_components
from wayflux.operators.nearest import positions_on_nearest
from wayflux.plans.registry import Inputs, query

CELL = 100.0

#: A bent line per link, from one node's place to the other's by way of a corner.
CORNERS_SQL = "(select e_id, lanes, road_classification, cast((from_id % 40) * 25 as double) as x0, cast((from_id % 23) * 40 as double) as y0, cast((to_id % 40) * 25 as double) as x1, cast((to_id % 23) * 40 as double) as y1 from {links} as l0)"
#: A square per site.
SQUARES_SQL = "(select node_id, kind, x - 300 - node_id % 5 * 50 as x0, y - 300 as y0, x + 300 + node_id % 5 * 50 as x1, y + 300 as y1 from {sites} as s0)"


#: The pieces of those lines in cells of 100: horizontal ones (section 0) first, then vertical ones.
PIECES_SQL = f"""(select * from (select e_id, lanes, 0 as section, t.i as index_i, cast(floor(y0 / 100) as bigint) as index_j, least(greatest(x0, x1), (t.i + 1) * 100) - greatest(least(x0, x1), t.i * 100) as length from {CORNERS_SQL} c, unnest(range(cast(floor(least(x0, x1) / 100) as bigint), cast(ceil(greatest(x0, x1) / 100) as bigint))) as t(i)
 union all select e_id, lanes, 1, cast(floor(x1 / 100) as bigint), t.j, least(greatest(y0, y1), (t.j + 1) * 100) - greatest(least(y0, y1), t.j * 100) from {CORNERS_SQL} d, unnest(range(cast(floor(least(y0, y1) / 100) as bigint), cast(ceil(greatest(y0, y1) / 100) as bigint))) as t(j)) p0 where length > 0)"""
DEPTH_SQL = "(select i as index_i, j as index_j, (i * 7 + j * 5) % 11 as depth from unnest(range(12)) as a(i), unnest(range(12)) as b(j))"


def zone_cells_sql(parity: int) -> str:
    """Cells of 150 whose middle lies in the squares of the sites of one parity."""
    span = lambda a: f"unnest(range(cast(floor({a}0 / 150) as bigint), cast(floor({a}1 / 150) as bigint) + 1))"
    return f"(select node_id, t.i as index_i, u.j as index_j from (select * from {SQUARES_SQL} q where node_id % 2 = {parity}) s, {span('x')} as t(i), {span('y')} as u(j) where (t.i + 0.5) * 150 >= x0 and (t.i + 0.5) * 150 < x1 and (u.j + 0.5) * 150 >= y0 and (u.j + 0.5) * 150 < y1)"


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def lines(i: Inputs) -> DataFrame:
    at = lambda end: ((F.col(end) % 40) * 25, (F.col(end) % 23) * 40)
    (x0, y0), (x1, y1) = at("from_id"), at("to_id")
    return i.view("links").select("e_id", "lanes", "road_classification", F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1)).alias("line"))


def squares(i: Inputs) -> DataFrame:
    s = i.view("sites")
    w = 300 + F.col("node_id") % 5 * 50
    x0, x1, y0, y1 = F.col("x") - w, F.col("x") + w, F.col("y") - 300, F.col("y") + 300
    return s.select("node_id", "kind", F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1), _point(x0, y0)).alias("ring"))


def depth_cells(i: Inputs) -> DataFrame:
    return i.spark.range(12).withColumnRenamed("id", "index_i").withColumn("index_j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).withColumn("depth", (F.col("index_i") * 7 + F.col("index_j") * 5) % 11)


def urban_cells(i: Inputs) -> DataFrame:
    return X.split_on_grid(lines(i).filter("lanes = 8"), CELL).select("index_i", "index_j").distinct()


@query("X1", f"select e_id, abs(x1 - x0) + abs(y1 - y0) as length from {CORNERS_SQL} c")
def x1(i: Inputs) -> DataFrame:
    return lines(i).select("e_id", X.length(F.col("line")).alias("length"))


@query("X2", f"select e_id, round(abs(x1 - x0) + abs(y1 - y0), 6) as length from {CORNERS_SQL} c where abs(x1 - x0) + abs(y1 - y0) > 0")
def x2(i: Inputs) -> DataFrame:
    return X.split_on_grid(lines(i), CELL).groupBy("e_id").agg(F.round(F.sum("length"), 6).alias("length"))


@query("X3", f"select e_id, section, index_i, index_j, round(length, 6) as length from {PIECES_SQL} p join {DEPTH_SQL} d using (index_i, index_j) where depth > 5")
def x3(i: Inputs) -> DataFrame:
    kept = X.clip_to_cells(X.split_on_grid(lines(i), CELL), depth_cells(i).filter("depth > 5"))
    return kept.select("e_id", "part.section", "index_i", "index_j", F.round("length", 6).alias("length"))


@query("X4", f"select e_id, round(greatest(0, case when y0 between 200 and 600 then greatest(0, least(greatest(x0, x1), 800) - greatest(least(x0, x1), 100)) else 0 end + case when x1 between 100 and 800 then greatest(0, least(greatest(y0, y1), 600) - greatest(least(y0, y1), 200)) else 0 end), 6) as length from {CORNERS_SQL} c where (y0 between 200 and 600 and least(greatest(x0, x1), 800) > greatest(least(x0, x1), 100)) or (x1 between 100 and 800 and least(greatest(y0, y1), 600) > greatest(least(y0, y1), 200))")
def x4(i: Inputs) -> DataFrame:
    return X.clip_to_box(X.split_on_grid(lines(i), CELL), 100, 200, 800, 600).groupBy("e_id").agg(F.round(F.sum("length"), 6).alias("length"))


@query("X5", f"select e_id, d.depth % 3 as zone_id, round(sum(length), 6) as length from {PIECES_SQL} p join {DEPTH_SQL} d using (index_i, index_j) group by e_id, d.depth % 3")
def x5(i: Inputs) -> DataFrame:
    zones = depth_cells(i).select("index_i", "index_j", (F.col("depth") % 3).alias("zone_id"))
    return X.length_per_zone(X.split_on_grid(lines(i), CELL), zones).withColumn("length", F.round("length", 6))


@query("X6", f"select l.e_id, cast(case when h.e_id is null then 0 else 1 end as integer) as urban from {{links}} as l left join (select distinct e_id from {PIECES_SQL} p where (index_i, index_j) in (select (index_i, index_j) from {PIECES_SQL} m where lanes = 8)) h on h.e_id = l.e_id")
def x6(i: Inputs) -> DataFrame:
    return X.touches_mask(lines(i), urban_cells(i), CELL).select("e_id", "urban")


@query("X7")
def x7(i: Inputs) -> DataFrame:
    mask = X.grown_mask(urban_cells(i), 1)
    cell_id = F.col("index_i") * 1_000_000 + F.col("index_j")
    named = mask.select(cell_id.alias("id"), "index_i", "index_j")
    beside = F.array(*[F.lit(d) for d in (1, 1_000_000)])
    edges = named.select("id", F.explode(beside).alias("d")).select(F.col("id").alias("src"), (F.col("id") + F.col("d")).alias("dst"))
    edges = edges.join(named.select(F.col("id").alias("dst")), "dst", "left_semi")
    groups = connected_components(edges)
    return named.join(groups.withColumnRenamed("node", "id"), "id", "left").select("index_i", "index_j", F.coalesce("component", "id").alias("area"))


@query("X8", f"select node_id, round((x0 + x1) / 2, 4) as x, round((y0 + y1) / 2, 4) as y from {SQUARES_SQL} q")
def x8(i: Inputs) -> DataFrame:
    c = squares(i).select("node_id", X.centroid(F.col("ring")).alias("c"))
    return c.select("node_id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


#: The segments of those lines with the running length; start and stop values of a line follow from its number.
SECTIONS_SQL = f"(select e_id, s, case s when 0 then x0 else x1 end as ax, y0 as ay, x1 as bx, case s when 0 then y0 else y1 end as by_, case s when 0 then 0 else abs(x1 - x0) end as before, abs(x1 - x0) + abs(y1 - y0) as total from {CORNERS_SQL} c, (values (0), (1)) as v(s))"
FOOT_SQL = f"(select *, case when t >= 1 then bx else ax + t * (bx - ax) end as fx, case when t >= 1 then by_ else ay + t * (by_ - ay) end as fy from (select p.zone_id, p.x, p.y, q.*, greatest(0, least(1, coalesce(((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0))) as t from {{points}} as p cross join {SECTIONS_SQL} q) u)"


@query("X9", f"select zone_id, e_id, round(sqrt(d), 6) as distance, round(e_id * 10 + (90 + e_id % 7) * coalesce((before + t * (abs(bx - ax) + abs(by_ - ay))) / nullif(total, 0), 0), 6) as position from (select *, row_number() over (partition by zone_id order by d, e_id, s) as place from (select *, (x - fx) * (x - fx) + (y - fy) * (y - fy) as d from {FOOT_SQL} f) g) h where place = 1")
def x9(i: Inputs) -> DataFrame:
    ends = F.col("e_id").cast("double") * 10
    along = lines(i).select("e_id", "line", ends.alias("start"), (ends + 90 + F.col("e_id") % 7).alias("stop"))
    found = positions_on_nearest(i.view("points"), along, "e_id")
    return found.select("zone_id", "e_id", F.round("distance", 6).alias("distance"), F.round("position", 6).alias("position"))


@query("X9_one_line", "select zone_id, round(10 + 90 * greatest(0, least(1, (x * 3000 + y * 4000) / 25000000)), 6) as position from {points} as p")
def x9_one_line(i: Inputs) -> DataFrame:
    points = i.view("points").select("zone_id", F.lit(1).alias("line_id"), "x", "y")
    line = i.spark.createDataFrame([(1, (0.0, 0.0), (3000.0, 4000.0), 10.0, 100.0)], "line_id int, a struct<x:double,y:double>, b struct<x:double,y:double>, start double, stop double")
    return X.referenced(points, line).select("zone_id", F.round("position", 6).alias("position"))


@query("X10", "select e_id, case when (d = '1' and from_id > to_id) or (d = '2' and from_id <= to_id) then to_id else from_id end as new_from, case when (d = '1' and from_id > to_id) or (d = '2' and from_id <= to_id) then from_id else to_id end as new_to from (select e_id, from_id, to_id, cast(1 + lanes % 3 as varchar) as d from {links} as l) q")
def x10(i: Inputs) -> DataFrame:
    k = i.view("links").select("e_id", "from_id", "to_id", F.col("from_id").alias("from_position"), F.col("to_id").alias("to_position"), (1 + F.col("lanes") % 3).cast("string").alias("direction"))
    return X.directed(k).select("e_id", "new_from", "new_to")


@query("X11", f"select cast(count(*) as bigint) as lines, cast((select count(*) from (select x0 as x, y0 as y from {CORNERS_SQL} a union select x1, y1 from {CORNERS_SQL} b) n) as bigint) as nodes from {CORNERS_SQL} c")
def x11(i: Inputs) -> DataFrame:
    ends = X.endpoints(lines(i))
    nodes = ends.select(F.col("from_node").alias("n")).union(ends.select("to_node")).agg(F.countDistinct("n").alias("nodes"))  # one row
    return ends.agg(F.count(F.lit(1)).alias("lines")).crossJoin(nodes)


@query("X12", "select e_id, cast(2 as bigint) as parts from {links} as l where lanes > 2")
def x12(i: Inputs) -> DataFrame:
    multi = lines(i).select("e_id", F.when(F.col("lanes") > 2, F.array("line", F.slice("line", 1, 0), F.slice("line", 1, 2))).alias("parts"))
    return X.single_parts(multi).groupBy("e_id").agg(F.count(F.lit(1)).alias("parts"))


IN_SQL = f"(select p.zone_id, s.node_id from {{points}} as p join {SQUARES_SQL} s on p.x >= s.x0 and p.x < s.x1 and p.y >= s.y0 and p.y < s.y1)"


@query("J15", f"select zone_id, node_id from {IN_SQL} q")
def j15(i: Inputs) -> DataFrame:
    return X.points_in_polygons(i.view("points"), squares(i), 400.0, "node_id").select("zone_id", "node_id")


@query("J14", f"select p.zone_id, coalesce(h.node_id, n.node_id) as node_id from {{points}} as p left join (select zone_id, min(node_id) as node_id from {IN_SQL} q group by zone_id) h on h.zone_id = p.zone_id join (select zone_id, node_id from (select a.zone_id, b.node_id, row_number() over (partition by a.zone_id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.node_id) as place from {{points}} as a cross join {{sites}} as b) z where place = 1) n on n.zone_id = p.zone_id")
def j14(i: Inputs) -> DataFrame:
    return X.containing_or_nearest(i.view("points"), squares(i), i.view("sites"), 400.0)


@query("J16", f"select e_id from {CORNERS_SQL} c where lanes = 8 and (x0 <> x1 or y0 <> y1)")
def j16(i: Inputs) -> DataFrame:
    hit = X.touches_mask(lines(i), urban_cells(i), CELL).filter("urban = 1")
    return hit.filter("lanes = 8").select("e_id")


def zone_cells(i: Inputs, parity: int, name: str) -> DataFrame:
    return X.polygon_cells(squares(i).filter(F.col("node_id") % 2 == parity), 150.0, "node_id").withColumnRenamed("node_id", name)


@query("J17", f"select z.zone, b.city, b.cells from (select distinct node_id as zone from {zone_cells_sql(0)} z0) z left join (select zone, city, cells from (select *, row_number() over (partition by zone order by cells desc, city) as place from (select a.node_id as zone, c.node_id as city, count(*) as cells from {zone_cells_sql(0)} a join {zone_cells_sql(1)} c using (index_i, index_j) group by a.node_id, c.node_id) n) p where place = 1) b on b.zone = z.zone")
def j17(i: Inputs) -> DataFrame:
    return X.largest_overlap(zone_cells(i, 0, "zone"), zone_cells(i, 1, "city"), "zone", "city")


@query("J18", f"select distinct a.node_id as zone, c.node_id as city from {zone_cells_sql(0)} a join {zone_cells_sql(1)} c using (index_i, index_j)")
def j18(i: Inputs) -> DataFrame:
    return X.overlapping(zone_cells(i, 0, "zone"), zone_cells(i, 1, "city"), "zone", "city")


@query("J19", f"select e_id, max(depth) as depth, round(sum(case when depth > 5 then length else 0.0 end), 6) as wet_length from {PIECES_SQL} p left join {DEPTH_SQL} d using (index_i, index_j) group by e_id")
def j19(i: Inputs) -> DataFrame:
    met = X.with_cell_value(X.split_on_grid(lines(i), CELL), depth_cells(i))
    return met.groupBy("e_id").agg(F.max("depth").alias("depth"), F.round(F.sum(F.when(F.col("depth") > 5, F.col("length")).otherwise(0.0)), 6).alias("wet_length"))
