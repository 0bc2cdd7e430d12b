"""Queries of the link operators (PF rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.functions import road
from wayflux.operators import links as L
from wayflux.plans.registry import Inputs, query

#: One literal parameter set per class: breakpoint, capacity, free-flow, lowest and urban speed.
PARAMETERS = [("M", 1200.0, 2330.0, 70.0, 40.0, 65.0), ("A_dual", 1080.0, 2100.0, 65.0, 30.0, 50.0), ("A_single", 1200.0, 1800.0, 57.0, 20.0, 40.0), ("B", 1200.0, 1100.0, 50.0, 20.0, 30.0)]
PARAMETER_COLUMNS = "combined_label string, breakpoint_flow double, capacity_plph double, free_flow_speed double, min_speed double, urban_speed double"

LABEL_SQL = """case when lower(road_classification) in ('trunk', 'a class', 'a road', 'primary') and lower(form_of_way) like '%single%' then 'A_single'
 when lower(road_classification) in ('b class', 'b road', 'secondary') then 'B' when lower(road_classification) = 'motorway' then 'M' else 'A_dual' end"""
PARAMETERS_SQL = "(values " + ", ".join("('%s', cast(%s as double), cast(%s as double), cast(%s as double), cast(%s as double), cast(%s as double))" % p for p in PARAMETERS) + ") as p(combined_label, breakpoint_flow, capacity_plph, free_flow_speed, min_speed, urban_speed)"
LABELLED_SQL = f"(select *, {LABEL_SQL} as combined_label from {{links}} as l0)"
SPEED_SQL = f"""(select l.*, p.breakpoint_flow, p.capacity_plph, p.min_speed, case when urban = 1 then urban_speed else free_flow_speed end as free_speed
 from {LABELLED_SQL} l left join {PARAMETERS_SQL} on l.combined_label = p.combined_label)"""
RESTRICTED_SQL = "(select e_id, cast(min(depth_surface_cm) % 80 as double) as max_speed from {segments} as s0 group by e_id)"
FLOW_SQL = "(select e_id, cast(count(*) * 2000 as double) as acc_flow from {steps} as t0 group by e_id)"
FLOWING_SQL = f"""(select s.*, coalesce(f.acc_flow, 0) as acc_flow, capacity_plph * lanes * 24 as capacity,
 greatest(free_speed - case combined_label when 'M' then 0.033 when 'A_dual' then 0.033 else 0.05 end * greatest(coalesce(f.acc_flow, 0) / 24.0 - breakpoint_flow, 0.0), min_speed) as speed
 from {SPEED_SQL} s left join {FLOW_SQL} f on s.e_id = f.e_id)"""


def parameters(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame(PARAMETERS, PARAMETER_COLUMNS)


def labelled(i: Inputs) -> DataFrame:
    return L.classify(i.view("links"))


def ready(i: Inputs) -> DataFrame:
    return L.initialise(L.with_speeds(labelled(i), parameters(i)))


def flowing(i: Inputs) -> DataFrame:
    flows = i.view("steps").groupBy("e_id").agg((F.count(F.lit(1)) * 2000).cast("double").alias("flow"))
    out = ready(i).join(flows, "e_id", "left").withColumn("acc_flow", F.coalesce("flow", F.lit(0.0))).drop("flow")
    return L.with_flow_speed(out)


def restricted(i: Inputs) -> DataFrame:
    return i.view("segments").groupBy("e_id").agg((F.min("depth_surface_cm") % 80).cast("double").alias("max_speed"))


def r(column: str, places: int = 6):
    return F.round(F.col(column), places).alias(column)


NODES_SQL = "(select distinct from_id as node_id from {links} as n0 union select distinct to_id from {links} as n1)"


def nodes(i: Inputs) -> DataFrame:
    k = i.view("links")
    return k.select(F.col("from_id").alias("node_id")).union(k.select("to_id")).distinct()


@query("PF1", "select distinct node_id from (select from_id as node_id from {links} as a where road_classification in ('Motorway', 'A Road') union all select to_id from {links} as b where road_classification in ('Motorway', 'A Road')) q")
def pf1(i: Inputs) -> DataFrame:
    return L.select_class(i.view("links"), nodes(i), "road_classification", ["Motorway", "A Road"])[1]


@query("PF2", "select e_id, from_id, to_id from {links} as l where from_id % 10 <> 0 and to_id % 10 <> 0")
def pf2(i: Inputs) -> DataFrame:
    return L.drop_dangling(i.view("links"), nodes(i).filter("node_id % 10 <> 0")).select("e_id", "from_id", "to_id")


@query("PF3", f"select e_id, combined_label from {LABELLED_SQL} l")
def pf3(i: Inputs) -> DataFrame:
    return labelled(i).select("e_id", "combined_label")


@query("PF4", f"""select e_id, initial_flow_speeds from (select s.e_id, case when max_speed < min_speed then 0.0 when max_speed >= min_speed and max_speed < free_speed then max_speed else free_speed end as initial_flow_speeds
 from {SPEED_SQL} s left join {RESTRICTED_SQL} m on s.e_id = m.e_id) q where initial_flow_speeds > 0""")
def pf4(i: Inputs) -> DataFrame:
    return L.with_speeds(labelled(i), parameters(i), restricted(i)).select("e_id", "initial_flow_speeds")


@query("PF5", f"select e_id, round(coalesce(case when e_id % 3 = 0 then cast(40 + e_id % 60 as double) * 0.621371 end, free_speed), 6) as free_flow_speeds from {SPEED_SQL} s")
def pf5(i: Inputs) -> DataFrame:
    tagged = F.when(F.col("e_id") % 3 == 0, (40 + F.col("e_id") % 60).cast("double") * 0.621371)
    out = L.with_speeds(labelled(i), parameters(i)).withColumn("free_flow_speeds", F.coalesce(tagged, "free_flow_speeds"))
    return out.select("e_id", r("free_flow_speeds"))


@query("PF6", f"select e_id, cast(0 as double) as acc_flow, capacity_plph * lanes * 24 as acc_capacity, capacity_plph * lanes * 24 as current_capacity, free_speed as acc_speed from {SPEED_SQL} s where capacity_plph * lanes * 24 > 0.5")
def pf6(i: Inputs) -> DataFrame:
    return ready(i).select("e_id", "acc_flow", "acc_capacity", "current_capacity", "acc_speed")


@query("PF7", f"select e_id, round(speed, 6) as acc_speed from {FLOWING_SQL} f")
def pf7(i: Inputs) -> DataFrame:
    return flowing(i).select("e_id", r("acc_speed"))


COST_SQL = f"""select e_id, round(hours * 1.06 * 21.41, 4) as time_cost,
 round(((0.46693 / v + 0.08257 - 0.00088 * v + 0.000006 * v * v) * 1.4 + (6.885 + 188.486 / v) / 100.0) * km, 4) as operating_cost
 from (select e_id, hours, miles * 1.60934 as km, miles * 1.60934 / hours as v from (select e_id, length_m * 0.000621371 as miles, length_m * 0.000621371 / free_speed as hours from {SPEED_SQL} s) a) b"""


@query("PF8", COST_SQL)
def pf8(i: Inputs) -> DataFrame:
    return L.with_costs(ready(i), "car").select("e_id", r("time_cost", 4), r("operating_cost", 4))


@query("PF9", f"select e_id, round(1.4 * (0.178 - 0.00299 * speed + 0.0000205 * speed * speed), 6) as voc from {FLOWING_SQL} f")
def pf9(i: Inputs) -> DataFrame:
    return flowing(i).select("e_id", F.round(road.legacy_voc(F.col("acc_speed")), 6).alias("voc"))


@query("PF10", f"select e_id, round(c.time_cost + c.operating_cost + average_toll_cost, 2) as weight from ({COST_SQL.replace(', 4)', ', 9)')}) c join {{links}} as l using (e_id)")
def pf10(i: Inputs) -> DataFrame:
    return L.with_costs(ready(i), "car").select("e_id", r("weight", 2))


@query("PF16", f"select distinct e_id from {RESTRICTED_SQL} m where max_speed < 30")
def pf16(i: Inputs) -> DataFrame:
    return restricted(i).filter("max_speed < 30").select("e_id").distinct()


@query("PF17", f"""select s.e_id, case when s.e_id % 4 = 1 or (s.e_id % 4 = 2 and max_speed >= 20 and max_speed < 60) then least(free_speed, max_speed) else free_speed end as acc_speed
 from {SPEED_SQL} s join {RESTRICTED_SQL} m on s.e_id = m.e_id""")
def pf17(i: Inputs) -> DataFrame:
    day = F.col("e_id") % 4
    held = (day == 1) | ((day == 2) & (F.col("max_speed") >= 20) & (F.col("max_speed") < 60))
    out = ready(i).join(restricted(i), "e_id")
    return out.select("e_id", F.when(held, F.least("acc_speed", "max_speed")).otherwise(F.col("acc_speed")).alias("acc_speed"))


@query("PF18", f"select e_id, capacity - acc_flow as left_capacity from {FLOWING_SQL} f where capacity - acc_flow > 0 and speed > 0")
def pf18(i: Inputs) -> DataFrame:
    return flowing(i).select("e_id", (F.col("acc_capacity") - F.col("acc_flow")).alias("left_capacity"), "acc_speed").filter("left_capacity > 0 and acc_speed > 0").drop("acc_speed")


@query("PF19", "select od_id, flow from (select od_id, flow, row_number() over (order by od_id) as place from {od} as o) q where (place - 1) % 100 = 0")
def pf19(i: Inputs) -> DataFrame:
    return L.systematic_sample(i.view("od").select("od_id", "flow"), "od_id", 100)


@query("PF20")
def pf20(i: Inputs) -> DataFrame:
    return L.hashed_sample(i.view("od"), "od_id", 1000, 42)


@query("PF21", "select od_id, flow * 2 as both_ways, flow / 2.0 as one_way from {od} as o")
def pf21(i: Inputs) -> DataFrame:
    return i.view("od").select("od_id", (F.col("flow") * 2).alias("both_ways"), (F.col("flow").cast("double") / 2).alias("one_way"))


@query("PF22", "select e_id, road_label from {links} as l where not exists (select 1 from {segments} as s where s.e_id = l.e_id and index_j = 1 and depth_river_cm >= 790)")
def pf22(i: Inputs) -> DataFrame:
    flooded = i.view("segments").filter("index_j = 1 and depth_river_cm >= 790").select("e_id")
    return i.view("links").join(flooded, "e_id", "left_anti").select("e_id", "road_label")


@query("PF23", "select e_id, case when e_id % 11 = 0 then cast(8 as double) when lanes = 3 then cast(2.5 as double) when lanes = 4 then cast(1 as double) else cast(0 as double) end as toll from {links} as l")
def pf23(i: Inputs) -> DataFrame:
    toll = F.coalesce(road.lookup(F.col("lanes"), {3: 2.5, 4: 1.0}), F.lit(0.0))
    return i.view("links").select("e_id", F.when(F.col("e_id") % 11 == 0, 8.0).otherwise(toll).alias("toll"))


@query("PF24", "select l.e_id, coalesce(s.depth, 0) as depth, case when s.e_id is null then 'no' else 'wet' end as level from {links} as l left join (select e_id, max(depth_river_cm) as depth from {segments} as s0 where depth_river_cm > 600 group by e_id) s on l.e_id = s.e_id")
def pf24(i: Inputs) -> DataFrame:
    wet = i.view("segments").filter("depth_river_cm > 600").groupBy("e_id").agg(F.max("depth_river_cm").alias("depth"), F.lit("wet").alias("level"))
    return i.view("links").select("e_id").join(wet, "e_id", "left").fillna({"depth": 0, "level": "no"})


@query("PF25", "select od_id, origin_node, destination_node, flow from {od} as o where origin_node <> destination_node and flow > 4 and cast(od_id as varchar) not like '9%'")
def pf25(i: Inputs) -> DataFrame:
    od = i.view("od")
    return od.filter((F.col("origin_node") != F.col("destination_node")) & (F.col("flow") > 4) & ~F.col("od_id").cast("string").startswith("9"))


@query("PF26", f"select e_id, round(acc_flow / (acc_flow + capacity), 6) as utilisation, round(2236.94 * (1.0 / speed - 1.0 / free_speed), 6) as time_loss, round(1 - speed / free_speed, 6) as speed_loss from {FLOWING_SQL} f")
def pf26(i: Inputs) -> DataFrame:
    return L.congestion(flowing(i)).select("e_id", r("utilisation"), r("time_loss"), r("speed_loss"))


@query("PF27", f"select e_id, round(length_m * 0.000621371, 6) as miles, round(60 * length_m * 0.000621371 / free_speed, 6) as free_minutes, round(60 * length_m * 0.000621371 / speed, 6) as minutes from {FLOWING_SQL} f")
def pf27(i: Inputs) -> DataFrame:
    miles = F.col("length_m") * road.METRE_TO_MILE
    at = lambda speed: F.round(F.try_divide(miles * 60, F.col(speed)), 6)
    return flowing(i).select("e_id", F.round(miles, 6).alias("miles"), at("initial_flow_speeds").alias("free_minutes"), at("acc_speed").alias("minutes"))


@query("PF28", """select e_id, round((length_m - lo) / (hi - lo), 6) as length_m, round((lanes - llo) / (lhi - llo), 6) as lanes from (select e_id, length_m, cast(lanes as double) as lanes from {links} as l) x,
 (select min(length_m) as lo, max(length_m) as hi, min(cast(lanes as double)) as llo, max(cast(lanes as double)) as lhi from {links} as m) b""")
def pf28(i: Inputs) -> DataFrame:
    rows = i.view("links").select("e_id", "length_m", F.col("lanes").cast("double").alias("lanes"))
    return L.min_max_scaled(rows, ["length_m", "lanes"]).select("e_id", r("length_m"), r("lanes"))


@query("PF29", "select e_id, case road_classification when 'Motorway' then 3 when 'A Road' then 2 end as code from {links} as l")
def pf29(i: Inputs) -> DataFrame:
    return i.view("links").select("e_id", road.lookup(F.col("road_classification"), {"Motorway": 3, "A Road": 2}).alias("code"))


@query("PF30", """select zone_id, yr, round(ln(value / base) / ln(1.5), 6) as growth, case when value > 2 * base then 'high' when value > base then 'some' else 'none' end as label
 from (select zone_id, yr, cast(value as double) as value, cast(first_value(value) over (partition by zone_id order by yr) as double) as base from {series} as s) q""")
def pf30(i: Inputs) -> DataFrame:
    s = i.view("series")
    base = s.groupBy("zone_id").agg(F.min_by("value", "yr").alias("base"))
    out = s.join(base, "zone_id").withColumn("ratio", F.try_divide(F.col("value").cast("double"), F.col("base").cast("double")))
    label = F.when(F.col("ratio") > 2, "high").when(F.col("ratio") > 1, "some").otherwise("none")
    return out.select("zone_id", "yr", F.round(F.ln("ratio") / F.ln(F.lit(1.5)), 6).alias("growth"), label.alias("label"))


@query("PF31", "select e_id, case when length_m <= 1000 then 'short' when length_m <= 1500 then 'middle' when length_m <= 1e9 then 'long' end as class from {links} as l")
def pf31(i: Inputs) -> DataFrame:
    return i.view("links").select("e_id", L.binned(F.col("length_m"), [1000, 1500, 1e9], ["short", "middle", "long"]).alias("class"))


@query("PF32", "select e_id, round(length_m / (select max(length_m) from {links} as m), 6) as share from {links} as l")
def pf32(i: Inputs) -> DataFrame:
    k = i.view("links")
    most = k.agg(F.max("length_m").alias("most"))  # exactly one row
    return k.crossJoin(F.broadcast(most)).select("e_id", F.round(F.col("length_m") / F.col("most"), 6).alias("share"))


@query("PF33", f"""select e_id, a.new_id as from_new, b.new_id as to_new from {{links}} as l
 join (select node_id, row_number() over (order by node_id) as new_id from {NODES_SQL} q1) a on l.from_id = a.node_id
 join (select node_id, row_number() over (order by node_id) as new_id from {NODES_SQL} q2) b on l.to_id = b.node_id""")
def pf33(i: Inputs) -> DataFrame:
    from wayflux.operators.tables import dense_ids

    ids = dense_ids(nodes(i), "node_id", "new_id")
    k = i.view("links").join(ids.select(F.col("node_id").alias("from_id"), F.col("new_id").alias("from_new")), "from_id")
    return k.join(ids.select(F.col("node_id").alias("to_id"), F.col("new_id").alias("to_new")), "to_id").select("e_id", "from_new", "to_new")
