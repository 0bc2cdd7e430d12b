"""Queries of path and assignment operators (A1 to A10, AR rows, G3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.operators import paths as P
from wayflux.operators import tables as T
from wayflux.plans.registry import Inputs, query

EDGES_SQL = "(select e_id, cast(round(length_m * 100) as bigint) as fuel, lanes as toll, lanes * 5 as capacity from {links} as l0)"
PAIR_SQL = "(select t.e_id, t.od_id, sum(o.flow) as flow from {steps} as t join {od} as o on t.od_id = o.od_id group by t.e_id, t.od_id)"
RATIO_SQL = f"""(select p.od_id, min(least(cast(e.capacity as double) / cast(x.total as double), 1.0)) as ratio from {PAIR_SQL} p
 join (select e_id, sum(flow) as total from {PAIR_SQL} p2 group by e_id) x on p.e_id = x.e_id join {EDGES_SQL} e on e.e_id = p.e_id group by p.od_id)"""


def edges(i: Inputs) -> DataFrame:
    return i.view("links").select("e_id", F.round(F.col("length_m") * 100).cast("long").alias("fuel"), F.col("lanes").alias("toll"), (F.col("lanes") * 5).alias("capacity"))


def with_paths(i: Inputs) -> DataFrame:
    return P.collect_paths(i.view("steps")).join(i.view("od"), "od_id")


@query("A1", "select t.e_id, cast(sum(o.flow) as bigint) as flow from {steps} as t join {od} as o on t.od_id = o.od_id group by t.e_id")
def a1(i: Inputs) -> DataFrame:
    return P.flow_on_edges(with_paths(i))


@query("A2", f"select t.od_id, cast(count(*) as bigint) as hops, cast(sum(fuel) as bigint) as fuel, cast(sum(toll) as bigint) as toll, min(case when t.pos = 1 then t.e_id end) as first_edge from {{steps}} as t join {EDGES_SQL} e on t.e_id = e.e_id group by t.od_id")
def a2(i: Inputs) -> DataFrame:
    out = P.path_costs(i.view("steps"), edges(i), "od_id", ["fuel", "toll"])
    return out.select("od_id", F.size("path").cast("long").alias("hops"), "fuel", "toll", F.get("path", F.lit(0)).alias("first_edge"))


@query("A3", f"select e_id, od_id, cast(flow as bigint) as flow from {PAIR_SQL} p")
def a3(i: Inputs) -> DataFrame:
    return P.pair_edge_flow(i.view("steps"), i.view("od"))


def ratios(i: Inputs) -> DataFrame:
    steps = i.view("steps")
    return P.adjustment_ratio(P.pair_edge_flow(steps, i.view("od")), edges(i), T.tasks_for(steps))


@query("A4", f"select od_id, round(ratio, 6) as ratio from {RATIO_SQL} r")
def a4(i: Inputs) -> DataFrame:
    return ratios(i).select("od_id", F.round("ratio", 6).alias("ratio"))


@query("A5", f"select o.od_id, round(o.flow * coalesce(ratio, 1.0), 6) as assigned from {{od}} as o left join {RATIO_SQL} r on o.od_id = r.od_id")
def a5(i: Inputs) -> DataFrame:
    out = P.adjusted(i.view("od"), ratios(i))
    return out.select("od_id", F.round("assigned", 6).alias("assigned"))


@query("A6", f"select round(min(cast(e.capacity as double) / total), 9) as ratio from (select e_id, cast(sum(flow) as double) as total from {PAIR_SQL} p group by e_id) x join {EDGES_SQL} e on e.e_id = x.e_id")
def a6(i: Inputs) -> DataFrame:
    flow = P.flow_on_edges(with_paths(i)).join(edges(i), "e_id")
    return flow.agg(F.round(F.min(F.try_divide(F.col("capacity").cast("double"), F.col("flow").cast("double"))), 9).alias("ratio"))


@query("A7", f"select cast(sum(o.flow * e.fuel) as bigint) as fuel, cast(sum(o.flow * e.toll) as bigint) as toll, cast(sum(o.flow) as bigint) as edge_trips from {{steps}} as t join {{od}} as o on t.od_id = o.od_id join {EDGES_SQL} e on e.e_id = t.e_id")
def a7(i: Inputs) -> DataFrame:
    met = i.view("steps").join(i.view("od"), "od_id").join(edges(i), "e_id")
    return met.agg(F.sum(F.col("flow") * F.col("fuel")).alias("fuel"), F.sum(F.col("flow") * F.col("toll")).cast("long").alias("toll"), F.sum("flow").alias("edge_trips"))


@query("A8", "select origin_node, destination_node, array_to_string(path, '-') as path, cast(sum(flow) as bigint) as flow, cast(min(od_id) as bigint) as least from (select o.od_id, o.origin_node, o.destination_node, o.flow, list(t.e_id order by t.pos) as path from {steps} as t join {od} as o on t.od_id = o.od_id group by o.od_id, o.origin_node, o.destination_node, o.flow) q group by all")
def a8(i: Inputs) -> DataFrame:
    joined = F.concat_ws("-", F.col("path").cast("array<string>"))
    return with_paths(i).groupBy("origin_node", "destination_node", "path").agg(F.sum("flow").alias("flow"), F.min("od_id").alias("least")).withColumn("path", joined)


@query("A9", "select origin_node, destination_node, cast(sum(flow) as bigint) as flow from {od} as o group by origin_node, destination_node")
def a9(i: Inputs) -> DataFrame:
    return i.view("od").groupBy("origin_node", "destination_node").agg(F.sum("flow").alias("flow"))


@query("A10", "select origin_node, array_to_string(list(destination_node order by destination_node), ',') as destinations, array_to_string(list(flow order by destination_node), ',') as flows from (select origin_node, destination_node, cast(sum(flow) as bigint) as flow from {od} as o group by origin_node, destination_node) q group by origin_node")
def a10(i: Inputs) -> DataFrame:
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return P.neighbours_of_origin(i.view("od")).select("origin_node", text("destinations"), text("flows"))


@query("A16", f"select t.od_id, min(e.capacity) as capacity from {{steps}} as t join {EDGES_SQL} e on t.e_id = e.e_id where t.e_id % 7 = 0 group by t.od_id")
def a16(i: Inputs) -> DataFrame:
    hit = i.view("steps").filter("e_id % 7 = 0")
    return hit.join(edges(i), "e_id").groupBy("od_id").agg(F.min("capacity").alias("capacity"))


@query("A17", f"select od_id, round(coalesce(min(least(cast(e.capacity as double) / f.flow, 1.0)), 1.0), 6) as fraction from {{steps}} as t join {EDGES_SQL} e on t.e_id = e.e_id left join (select e_id, cast(sum(flow) as double) as flow from {PAIR_SQL} p group by e_id) f on f.e_id = t.e_id group by od_id")
def a17(i: Inputs) -> DataFrame:
    flow = P.flow_on_edges(with_paths(i)).withColumn("flow", F.col("flow").cast("double"))
    met = i.view("steps").join(edges(i), "e_id").join(flow, "e_id", "left")
    part = F.least(F.try_divide(F.col("capacity").cast("double"), F.col("flow")), F.lit(1.0))
    return met.groupBy("od_id").agg(F.round(F.coalesce(F.min(part), F.lit(1.0)), 6).alias("fraction"))


@query("A19", f"select o.od_id, cast(coalesce(sum(fuel), 0) as bigint) as metres from {{od}} as o left join {{steps}} as t on o.od_id = t.od_id left join {EDGES_SQL} e on t.e_id = e.e_id group by o.od_id")
def a19(i: Inputs) -> DataFrame:
    od = i.view("od").select("od_id").join(P.collect_paths(i.view("steps")), "od_id", "left")
    met = od.select("od_id", F.explode_outer("path").alias("e_id")).join(edges(i), "e_id", "left")
    return met.groupBy("od_id").agg(F.coalesce(F.sum("fuel"), F.lit(0)).alias("metres"))


@query("J7", "select od_id from {od} as o where not exists (select 1 from {links} as l where l.from_id = o.origin_node and l.lanes > 6) or not exists (select 1 from {links} as l where l.from_id = o.destination_node and l.lanes > 6)")
def j7(i: Inputs) -> DataFrame:
    known = i.view("links").filter("lanes > 6").select("from_id")
    return T.missing_either(i.view("od"), known, "origin_node", "destination_node", "from_id").select("od_id")


@query("J8", "select od_id, flow from {od} as o where not exists (select 1 from {od} as p where p.flow = 9 and p.origin_node = o.origin_node and p.destination_node = o.destination_node)")
def j8(i: Inputs) -> DataFrame:
    isolated = i.view("od").filter("flow = 9").select("origin_node", "destination_node")
    return i.view("od").join(isolated, ["origin_node", "destination_node"], "left_anti").select("od_id", "flow")


@query("J22", "select od_id, array_to_string(list(distinct e_id order by e_id), ',') as flood_links from {steps} as t where e_id in (select e_id from {segments} as s where depth_river_cm >= 750) group by od_id")
def j22(i: Inputs) -> DataFrame:
    flooded = i.view("segments").filter("depth_river_cm >= 750").select("e_id").distinct()
    hit = P.explode_paths(P.collect_paths(i.view("steps"))).join(flooded, "e_id", "left_semi")
    return hit.groupBy("od_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("e_id")).cast("array<string>")).alias("flood_links"))


@query("U7", "select e_id, cast(count(*) as bigint) as rounds from (select e_id from {steps} as a where pos = 1 union all select e_id from {steps} as b where pos = 2) q group by e_id")
def u7(i: Inputs) -> DataFrame:
    s = i.view("steps")
    return s.filter("pos = 1").select("e_id").unionByName(s.filter("pos = 2").select("e_id")).groupBy("e_id").agg(F.count(F.lit(1)).alias("rounds"))


@query("U8", f"select o.od_id, round(o.flow - o.flow * coalesce(ratio, 1.0), 6) as flow from {{od}} as o left join {RATIO_SQL} r on o.od_id = r.od_id where o.flow - o.flow * coalesce(ratio, 1.0) > 0.001")
def u8(i: Inputs) -> DataFrame:
    out = P.adjusted(i.view("od"), ratios(i))
    return out.withColumn("flow", F.col("flow") - F.col("assigned")).filter("flow > 0.001").select("od_id", F.round("flow", 6).alias("flow"))


@query("AR1", "select od_id, e_id from {steps} as t")
def ar1(i: Inputs) -> DataFrame:
    return P.collect_paths(i.view("steps")).select("od_id", F.explode("path").alias("e_id"))


@query("AR2", "select od_id, pos, e_id from {steps} as t")
def ar2(i: Inputs) -> DataFrame:
    held = i.view("steps").groupBy("od_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e_id"))).alias("s"))
    held = held.select("od_id", F.transform("s", lambda s: s["pos"]).alias("pos"), F.transform("s", lambda s: s["e_id"]).alias("e_id"))
    return held.select("od_id", F.inline(F.arrays_zip("pos", "e_id")))


@query("AR3", "select od_id, cast(pos as integer) as pos, e_id from {steps} as t")
def ar3(i: Inputs) -> DataFrame:
    return P.explode_paths(P.collect_paths(i.view("steps")))


@query("AR4", "select od_id, array_to_string(list(e_id order by pos), ',') as kept from {steps} as t where pos > 1 and e_id % 2 = 0 group by od_id")
def ar4(i: Inputs) -> DataFrame:
    zipped = F.arrays_zip("path", F.sequence(F.lit(1), F.size("path")).alias("pos"))
    kept = F.filter(zipped, lambda s: (s["pos"] > 1) & (s["path"] % 2 == 0))
    out = P.collect_paths(i.view("steps")).select("od_id", F.transform(kept, lambda s: s["path"]).alias("kept")).filter(F.size("kept") > 0)
    return out.withColumn("kept", F.concat_ws(",", F.col("kept").cast("array<string>")))


@query("AR6", "select od_id, cast(count(distinct e_id) as integer) as edges from {steps} as t group by od_id")
def ar6(i: Inputs) -> DataFrame:
    return P.collect_paths(i.view("steps")).select("od_id", F.size(F.array_distinct("path")).alias("edges"))


@query("AR7", "select o.od_id, cast(count(t.e_id) as integer) as hops from {od} as o left join {steps} as t on o.od_id = t.od_id group by o.od_id")
def ar7(i: Inputs) -> DataFrame:
    od = i.view("od").select("od_id").join(P.collect_paths(i.view("steps")), "od_id", "left")
    return od.select("od_id", F.size(F.coalesce("path", F.array().cast("array<bigint>"))).alias("hops"))
