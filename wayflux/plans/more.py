"""Queries of the remaining sources, recovery steps and user-function forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import ensure_checkpoint_dir
from wayflux.functions import road
from wayflux.operators import damage as D
from wayflux.operators import links as L
from wayflux.operators import paths as P
from wayflux.operators import recovery as C
from wayflux.plans.disruption import FRACTION_SQL, LEVELLED_SQL, UNITS, fractions, levelled, longer
from wayflux.plans.links import FLOWING_SQL, LABELLED_SQL, flowing, labelled
from wayflux.plans.places import lines
from wayflux.plans.registry import Inputs, query
from wayflux.plans.tables import io2
from wayflux.sources import io


def shared(i: Inputs, name: str) -> str:
    return f"{ensure_checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


@query("IO3", "select n_nationkey, n_name from nation")
def io3(i: Inputs) -> DataFrame:
    path = shared(i, "nations")
    i.table("nation").select("n_nationkey", "n_name").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return io.read_csv(i.spark, path, "n_nationkey int, n_name string", "ISO-8859-1")


@query("IO4", "select l.e_id, l.road_label, cast(case l.road_label when 'road' then 1 when 'tunnel' then 13 end as double) as lo from {links} as l where l.road_label <> 'bridge'")
def io4(i: Inputs) -> DataFrame:
    path = shared(i, "costs")
    io.write_parquet(i.spark.createDataFrame(UNITS, "asset string, key string, lo double, hi double"), path, ("asset",))
    costs = i.spark.read.parquet(path).filter("key = 'm_ge8_urb'").select(F.col("asset").alias("road_label"), "lo")
    return i.view("links").select("e_id", "road_label").join(costs, "road_label")


@query("IO5", "select p_partkey, case p_size % 3 when 0 then cast(1.5 as double) when 1 then cast(2.5 as double) end as factor from part")
def io5(i: Inputs) -> DataFrame:
    path = shared(i, "factors")
    i.spark.createDataFrame([("0", 1.5), ("1", 2.5)], "key string, value double").write.json(path)
    factors = io.read_parameters(i.spark, path).withColumnRenamed("value", "factor")
    return i.table("part").withColumn("key", (F.col("p_size") % 3).cast("string")).join(factors, "key", "left").select("p_partkey", "factor")


@query("IO6", "select o_custkey % 50 as zone_id, cast(count(*) as bigint) as n from orders where o_orderstatus = 'F' and o_totalprice > 1000 group by o_custkey % 50")
def io6(i: Inputs) -> DataFrame:
    # The same question that read_jdbc() would push into a database, asked of a Parquet copy: the filters reach the scan.
    kept = i.table("orders").filter("o_orderstatus = 'F' and o_totalprice > 1000")
    return kept.groupBy((F.col("o_custkey") % 50).alias("zone_id")).agg(F.count(F.lit(1)).alias("n"))


@query("IO10", "select l_orderkey % 100 as part, cast(count(*) as bigint) as n, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_orderkey % 100")
def io10(i: Inputs) -> DataFrame:
    rows = io.read_parquet(i.spark, f"{i.sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"])
    return rows.groupBy((F.col("l_orderkey") % 100).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


@query("IO15", "select origin as k1, destination as k2, cast(n as bigint) as value from {trips} as t")
def io15(i: Inputs) -> DataFrame:
    nested = i.view("trips").groupBy("origin").agg(F.map_from_entries(F.collect_list(F.struct("destination", "n"))).alias("m"))
    return nested.select(F.col("origin").alias("k1"), F.explode("m").alias("k2", "value"))


@query("J21", f"select e_id, flood, index_i, index_j, length_m, level from {LEVELLED_SQL} l2 where depth_cm > 0")
def j21(i: Inputs) -> DataFrame:
    group = road.road_group(F.col("road_label"), F.col("road_classification"), F.col("trunk_road"))
    rows = longer(i).filter("depth_cm > 0").withColumn("group", group)
    return D.with_band(rows, D.bands_table(i.spark)).select("e_id", "flood", "index_i", "index_j", "length_m", F.col("band_level").alias("level"))


@query("A15", "select e_id, cast(max(greatest(depth_surface_cm, depth_river_cm)) as bigint) as depth_cm, cast(sum(least(depth_surface_cm, depth_river_cm)) as bigint) as total_min, cast(sum(greatest(depth_surface_cm, depth_river_cm)) as bigint) as total_max from {segments} as s group by e_id")
def a15(i: Inputs) -> DataFrame:
    lo, hi = F.least("depth_surface_cm", "depth_river_cm"), F.greatest("depth_surface_cm", "depth_river_cm")
    return i.view("segments").groupBy("e_id").agg(F.max(hi).alias("depth_cm"), F.sum(lo).alias("total_min"), F.sum(hi).alias("total_max"))


@query("W8", "select node_id, zone_id, round_even(cast(n as double) / total, 2) as share from (select kind as zone_id, node_id, node_id % 7 + 1 as n, sum(node_id % 7 + 1) over (partition by kind) as total from {sites} as s) q")
def w8(i: Inputs) -> DataFrame:
    n = F.col("node_id") % 7 + 1
    total = F.sum(n).over(Window.partitionBy("kind"))
    return i.view("sites").select("node_id", F.col("kind").alias("zone_id"), F.bround(n.cast("double") / total, 2).alias("share"))


@query("M13", f"select e_id, max(depth_cm) as depth_cm, min(length_m * fraction * u.lo) as cost_min, max(length_m * fraction * u.hi) as cost_max from {FRACTION_SQL} f join (values ('Motorway', 3.0, 9.0), ('A Road', 2.0, 6.0), ('B Road', 1.0, 3.0)) as u(class, lo, hi) on u.class = f.road_classification group by e_id".replace("min(length_m", "round(min(length_m").replace("u.lo)", "u.lo), 6)").replace("max(length_m", "round(max(length_m").replace("u.hi)", "u.hi), 6)"))
def m13(i: Inputs) -> DataFrame:
    unit = i.spark.createDataFrame([("Motorway", 3.0, 9.0), ("A Road", 2.0, 6.0), ("B Road", 1.0, 3.0)], "class string, lo double, hi double")
    out = D.legacy_damage(fractions(i).withColumnRenamed("road_classification", "class"), unit)
    return out.withColumns({c: F.round(c, 6) for c in ("cost_min", "cost_max")})


@query("M16", f"select e_id, min(case when level in ('extensive', 'severe') then 0.0 else cast(lanes * 1000 as double) end) as capacity from {LEVELLED_SQL} l2 group by e_id")
def m16(i: Inputs) -> DataFrame:
    return C.event_day_capacity(levelled(i).withColumn("capacity", F.col("lanes") * 1000)).groupBy("e_id").agg(F.min("capacity").alias("capacity"))


CURVES_SQL = "(values " + ", ".join(f"('{v}', {a}, {b}, cast('{s}' as decimal(6,4)))" for v, a, b, s in C.CURVES) + ") as c(level, first, until, step)"


@query("M17", f"select w.level, d.day, cast(round(c.step * least(greatest(d.day - c.first + 1, 0), c.until - c.first + 1), 2) as double) as rate from (select distinct level from {LEVELLED_SQL} l2) w join {CURVES_SQL} on c.level = w.level cross join (select unnest(range({C.DAYS + 1})) as day) d")
def m17(i: Inputs) -> DataFrame:
    return C.recovery_rates(levelled(i))


@query("M18", f"select w.e_id, d.scenario, round(w.lanes * 1000 * cast(d.rate as double), 6) as capacity from (select distinct e_id, road_label, lanes, level from {LEVELLED_SQL} l2) w join (values (0, 'bridge', 'severe', 0.0), (0, 'road', 'severe', 0.2), (1, 'bridge', 'severe', 0.5), (1, 'road', 'severe', 0.75)) as d(scenario, asset, level, rate) on d.level = w.level and d.asset = case when w.road_label = 'bridge' then 'bridge' else 'road' end")
def m18(i: Inputs) -> DataFrame:
    design = i.spark.createDataFrame([(0, 0.0, 0.2), (1, 0.5, 0.75)], "scenario int, bridge_severe double, road_severe double")
    hit = levelled(i).select("e_id", "road_label", "level", (F.col("lanes") * 1000).alias("capacity")).distinct()
    return C.recovered_capacity(hit, C.design_long(design)).withColumn("capacity", F.round("capacity", 6))


VOC_SQL = "length_m * ((0.178 - {s} * 0.00299 + {s} * {s} * 0.0000205) * 1.4)"


@query("M22", f"select e_id, round(cost, 3) as cost from (select e_id, greatest({VOC_SQL.format(s='speed')} - {VOC_SQL.format(s='free_speed')}, 0) * acc_flow as cost from {FLOWING_SQL} f) q where cost > 0")
def m22(i: Inputs) -> DataFrame:
    before = F.col("length_m") * road.legacy_voc(F.col("initial_flow_speeds"))
    after = F.col("length_m") * road.legacy_voc(F.col("acc_speed"))
    return C.rerouting_cost(flowing(i).select("e_id", before.alias("pre"), after.alias("post"), F.col("acc_flow").alias("change_flow"))).select("e_id", F.round("cost", 3).alias("cost"))


@query("AR5", "select train_id, run_date, cast(count(*) as integer) as stations, min(case when place = 1 then station end) as first_station from (select train_id, run_date, station, row_number() over (partition by train_id, run_date order by pos) as place from {stops} as s where stop = 'S') q group by train_id, run_date")
def ar5(i: Inputs) -> DataFrame:
    held = i.view("stops").groupBy("train_id", "run_date").agg(F.array_sort(F.collect_list(F.struct("pos", "station", "stop"))).alias("s"))
    both = F.arrays_zip(F.transform("s", lambda s: s["station"]).alias("station"), F.transform("s", lambda s: s["stop"]).alias("stop"))
    kept = F.transform(F.filter(both, lambda z: z["stop"] == "S"), lambda z: z["station"])
    out = held.select("train_id", "run_date", kept.alias("kept")).filter(F.size("kept") > 0)
    return out.select("train_id", "run_date", F.size("kept").alias("stations"), F.get("kept", F.lit(0)).alias("first_station"))


@query("AR8", "select e_id, 'min' as bound, min(depth_surface_cm) as surface, min(depth_river_cm) as river from {segments} as s group by e_id union all select e_id, 'max', max(depth_surface_cm), max(depth_river_cm) from {segments} as t group by e_id")
def ar8(i: Inputs) -> DataFrame:
    both = [("min", F.min), ("max", F.max)]
    ends = i.view("segments").groupBy("e_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in both for c in ("depth_surface_cm", "depth_river_cm")])
    rows = F.array(*[F.struct(F.lit(n).alias("bound"), F.col(f"{n}_depth_surface_cm").alias("surface"), F.col(f"{n}_depth_river_cm").alias("river")) for n, _ in both])
    return ends.select("e_id", F.inline(rows))


@query("UD1", f"select e_id, combined_label, case when lanes > 4 then upper(combined_label) else lower(combined_label) end as name from {LABELLED_SQL} l")
def ud1(i: Inputs) -> DataFrame:
    named = F.when(F.col("lanes") > 4, F.upper("combined_label")).otherwise(F.lower("combined_label"))
    return labelled(i).select("e_id", "combined_label", named.alias("name"))


@query("UD2", "select form_of_way, round(sum(length_m * lanes) / sum(lanes), 6) as mean_length from {links} as l group by form_of_way")
def ud2(i: Inputs) -> DataFrame:
    mean = F.try_divide(F.sum(F.col("length_m") * F.col("lanes")), F.sum("lanes"))
    return i.view("links").groupBy("form_of_way").agg(F.round(mean, 6).alias("mean_length"))


@query("UD3", "select e_id, cast(count(*) as bigint) as vertices from {links} as l cross join (values (1), (2), (3)) as v(k) group by e_id")
def ud3(i: Inputs) -> DataFrame:
    return lines(i).select("e_id", F.explode("line").alias("p")).groupBy("e_id").agg(F.count("p").alias("vertices"))


@query("UD4", "select t.e_id, cast(sum(o.flow) as bigint) as flow from {steps} as t join {od} as o on t.od_id = o.od_id join {links} as l on l.e_id = t.e_id where l.road_classification = 'Motorway' group by t.e_id")
def ud4(i: Inputs) -> DataFrame:
    major = L.classify(i.view("links")).filter("combined_label = 'M'").select("e_id")
    flows = P.collect_paths(i.view("steps")).join(i.view("od"), "od_id").transform(P.flow_on_edges)
    return flows.transform(lambda f: f.join(major, "e_id", "left_semi"))


@query("UD5", "select cast(count(*) as bigint) as lines_, cast(sum(3) as bigint) as points from {links} as l")
def ud5(i: Inputs) -> DataFrame:
    return io2(i).agg(F.count(F.lit(1)).alias("lines_"), F.sum("points").alias("points"))
