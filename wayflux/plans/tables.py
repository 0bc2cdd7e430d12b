"""Queries of sources, joins, set work, windows, sorts and scalar functions."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import ensure_checkpoint_dir
from wayflux.functions import text as S
from wayflux.operators import tables as T
from wayflux.operators.nearest import pairs_nearest
from wayflux.plans.registry import Inputs, query
from wayflux.sources import geometry, io


def shared(i: Inputs, name: str) -> str:
    return f"{ensure_checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


@query("IO1_whole", "select o_orderkey, o_totalprice from orders")
@query("IO1", "select o_orderkey, o_totalprice from orders")
def io1(i: Inputs) -> DataFrame:
    return io.read_parquet(i.spark, f"{i.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("IO7", "select c_custkey, cast(1 as bigint) as files from customer")
def io7(i: Inputs) -> DataFrame:
    paths = [shared(i, "customers") for _ in range(2)]
    for k, path in enumerate(paths):
        io.write_parquet(i.table("customer").filter(F.col("c_nationkey") % 2 == k), path)
    rows = io.read_with_source(i.spark, *paths)
    return rows.groupBy("c_custkey").agg(F.countDistinct("source_file").alias("files"))


PATHS_SQL = "(select 'UK/' || case s_suppkey % 3 when 0 then 'Raster' when 1 then 'Vector' else 'Other' end || '/ev' || cast(s_nationkey as varchar) || '/' || case s_suppkey % 2 when 0 then 'FLSW' else 'FLRF' end || '_RD_' || cast(s_suppkey as varchar) || case when s_suppkey % 5 = 0 then '_IE' else '' end || '.tif' as path from supplier)"


def event_paths(i: Inputs) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    folder = F.when(key % 3 == 0, "Raster").when(key % 3 == 1, "Vector").otherwise("Other")
    name = F.concat(F.when(key % 2 == 0, "FLSW").otherwise("FLRF"), F.lit("_RD_"), key.cast("string"), F.when(key % 5 == 0, "_IE").otherwise(""), F.lit(".tif"))
    return i.table("supplier").select(F.concat_ws("/", F.lit("UK"), folder, F.concat(F.lit("ev"), nation), name).alias("path"))


@query("IO8", f"select path, case when path like '%FLSW%' then 'surface' else 'river' end as flood, split_part(path, '/', 3) as event_key from {PATHS_SQL} p where path not like '%IE%'")
def io8(i: Inputs) -> DataFrame:
    return io.event_catalogue(event_paths(i))


@query("IO9", f"select path, case when path like '%Raster%' and cast(regexp_extract(path, 'RD_([0-9]+)', 1) as bigint) % 6 = 0 then replace(replace(path, 'Raster', 'Vector'), '_RD_', '_VE_') when path like '%Raster%' then replace(replace(path, 'Raster', 'Vector'), '_RD_', '_PR_') end as mask from {PATHS_SQL} p where path not like '%IE%'")
def io9(i: Inputs) -> DataFrame:
    rasters = event_paths(i).filter(F.col("path").contains("Raster"))
    even = F.regexp_extract("path", "RD_([0-9]+)", 1).cast("long") % 6 == 0
    known = rasters.select(F.regexp_replace(F.regexp_replace("path", "Raster", "Vector"), "_RD_", F.when(even, "_VE_").otherwise("_PR_")).alias("path"))
    return io.with_mask(io.event_catalogue(event_paths(i)), known).select("path", "mask")


@query("IO11", "select cast(count(*) as bigint) as n from lineitem")
def io11(i: Inputs) -> DataFrame:
    return i.table("lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("IO12_whole", "select o_orderkey, o_custkey, o_orderkey % 7 as part from orders")
@query("IO12", "select o_orderkey, o_custkey, o_orderkey % 7 as part from orders")
def io12(i: Inputs) -> DataFrame:
    path = shared(i, "orders")
    io.write_parquet(i.table("orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7).alias("part")), path, ("part",))
    return io.read_parquet(i.spark, path).withColumn("part", F.col("part").cast("long"))


@query("IO13", "select s_suppkey, s_name from supplier")
def io13(i: Inputs) -> DataFrame:
    path = shared(i, "suppliers")
    io.write_csv(i.table("supplier").select("s_suppkey", "s_name"), path)
    return io.read_csv(i.spark, path, "s_suppkey bigint, s_name string")


@query("IO14", "select c_custkey from customer")
def io14(i: Inputs) -> DataFrame:
    parts, whole = shared(i, "parts"), shared(i, "whole")
    for k in range(2):
        io.append_parts(i.table("customer").select("c_custkey").filter(F.col("c_custkey") % 2 == k), parts)
    io.compact(i.spark, parts, whole, 2)
    return i.spark.read.parquet(whole)


@query("IO2", "select e_id, cast(3 as integer) as points, cast(from_id as double) as x0, cast(to_id as double) as y2 from {links} as l")
def io2(i: Inputs) -> DataFrame:
    number = lambda c: F.col(c).cast("double")
    packed = i.view("links").select("e_id", F.array(number("from_id"), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0), number("to_id")).alias("flat"))
    return geometry.decode_lines(_as_wkb(packed)).select("e_id", F.size("geometry").alias("points"), F.col("geometry")[0]["x"].alias("x0"), F.col("geometry")[2]["y"].alias("y2"))


def _as_wkb(rows: DataFrame) -> DataFrame:
    """Test geometry: big-endian line strings from (e_id, flat coordinates)."""
    @F.pandas_udf("binary")
    def pack(flat: pd.Series) -> pd.Series:
        return flat.map(lambda v: struct.pack(">BII", 0, 2, len(v) // 2) + struct.pack(f">{len(v)}d", *v))

    return rows.select("e_id", pack("flat").alias("geometry"))


@query("J1", "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey and n_regionkey < 3")
def j1(i: Inputs) -> DataFrame:
    near = i.table("nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return i.table("customer").join(near, "c_nationkey", "left").select("c_custkey", "n_name")


@query("J2", "select od_id, pos, t.e_id, lanes from {steps} as t join {links} as l on t.e_id = l.e_id")
def j2(i: Inputs) -> DataFrame:
    return i.view("steps").join(i.view("links").select("e_id", "lanes"), "e_id").select("od_id", "pos", "e_id", "lanes")


@query("J4", "select l.e_id, cast(count(t.od_id) as bigint) as n from (select * from {steps} as t0 where pos > 8) t right join {links} as l on t.e_id = l.e_id group by l.e_id")
def j4(i: Inputs) -> DataFrame:
    late = i.view("steps").filter("pos > 8")
    return late.join(i.view("links").select("e_id"), "e_id", "right").groupBy("e_id").agg(F.count("od_id").alias("n"))


@query("J5", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 end as code from orders")
def j5(i: Inputs) -> DataFrame:
    codes = i.spark.createDataFrame([("F", 1), ("O", 2)], "o_orderstatus string, code int")
    return i.table("orders").join(codes, "o_orderstatus", "left").select("o_orderkey", "code")


@query("J6", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def j6(i: Inputs) -> DataFrame:
    large = i.table("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return i.table("customer").join(large, "c_custkey", "left_semi").select("c_custkey")


@query("J9", "select t.origin, t.destination, cast(a.population as bigint) as origin_population, cast(b.population as bigint) as destination_population from {trips} as t join {zones} as a on t.origin = a.zone_id join {zones} as b on t.destination = b.zone_id")
def j9(i: Inputs) -> DataFrame:
    z = i.view("zones")
    at = lambda end: z.select(F.col("zone_id").alias(end), F.col("population").alias(f"{end}_population"))
    return i.view("trips").join(at("origin"), "origin").join(at("destination"), "destination").select("origin", "destination", "origin_population", "destination_population")


@query("J10", "select a.zone_id, a.yr, cast(a.value as bigint) as value_base, cast(b.value as bigint) as value_next from {series} as a join {series} as b on a.zone_id = b.zone_id and b.yr = a.yr + 1")
def j10(i: Inputs) -> DataFrame:
    s = i.view("series")
    later = s.select("zone_id", (F.col("yr") - 1).alias("yr"), F.col("value").alias("value_next"))
    return s.withColumnRenamed("value", "value_base").join(later, ["zone_id", "yr"])


@query("J11", "select l.e_id, coalesce(s.lanes, l.lanes) as lanes from {links} as l left join (select e_id, max(index_j) as lanes from {segments} as s0 where depth_river_cm > 700 group by e_id) s on l.e_id = s.e_id")
def j11(i: Inputs) -> DataFrame:
    new = i.view("segments").filter("depth_river_cm > 700").groupBy("e_id").agg(F.max("index_j").alias("lanes"))
    return T.overwrite(i.view("links").select("e_id", "lanes"), new, "e_id", ["lanes"])


@query("J12", "select zone_id, node_id, round(distance, 6) as distance from (select p.zone_id, s.node_id, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) as distance, row_number() over (partition by p.zone_id order by (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.node_id) as place from {points} as p cross join {sites} as s) q where place = 1")
def j12(i: Inputs) -> DataFrame:
    return pairs_nearest(i.view("points"), i.view("sites")).select("zone_id", "node_id", F.round("distance", 6).alias("distance"))


@query("J13", "select zone_id, kind from (select p.zone_id, s.kind, row_number() over (partition by p.zone_id order by (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.node_id) as place from {points} as p cross join {sites} as s) q where place = 1")
def j13(i: Inputs) -> DataFrame:
    sites = i.view("sites")
    return pairs_nearest(i.view("points"), sites).join(sites.select("node_id", "kind"), "node_id").select("zone_id", "kind")


@query("J25", "select e_id, cast(a.x as double) as x0, cast(b.y as double) as y1 from {links} as l join {points} as a on a.zone_id = l.from_id + 1 join {points} as b on b.zone_id = l.to_id + 1")
def j25(i: Inputs) -> DataFrame:
    at = lambda end, n: i.view("points").select((F.col("zone_id") - 1).alias(end), F.struct("x", "y").alias(n))
    line = i.view("links").join(at("from_id", "a"), "from_id").join(at("to_id", "b"), "to_id").select("e_id", F.array("a", "b").alias("line"))
    return line.select("e_id", F.col("line")[0]["x"].alias("x0"), F.col("line")[1]["y"].alias("y1"))


@query("U1", "select s_suppkey as k, s_nationkey as nation, null as segment from supplier union all select c_custkey, c_nationkey, c_mktsegment from customer")
def u1(i: Inputs) -> DataFrame:
    a = i.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(i.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("U2", "select distinct l_partkey, l_suppkey from lineitem")
def u2(i: Inputs) -> DataFrame:
    return i.table("lineitem").select("l_partkey", "l_suppkey").distinct()


@query("U3", "select distinct origin_node as node from {od} as o union select distinct destination_node from {od} as p")
def u3(i: Inputs) -> DataFrame:
    od = i.view("od")
    return od.select(F.col("origin_node").alias("node")).union(od.select("destination_node")).distinct()


@query("U4", "select a.od_id, cast(count(*) as integer) as common from (select distinct od_id, e_id from {steps} as t where pos % 2 = 0) a join (select distinct od_id, e_id from {steps} as u where pos % 2 = 1) b on a.od_id = b.od_id and a.e_id = b.e_id group by a.od_id")
def u4(i: Inputs) -> DataFrame:
    held = i.view("steps").groupBy("od_id").agg(F.collect_set(F.when(F.col("pos") % 2 == 0, F.col("e_id"))).alias("a"), F.collect_set(F.when(F.col("pos") % 2 == 1, F.col("e_id"))).alias("b"))
    return held.select("od_id", F.size(F.array_intersect("a", "b")).alias("common")).filter("common > 0")


@query("U5", "select case when n is null then 'isolated' else 'routed' end as part, cast(count(*) as bigint) as pairs from {od} as o left join (select od_id, count(*) as n from {steps} as t group by od_id) s on o.od_id = s.od_id group by 1")
def u5(i: Inputs) -> DataFrame:
    met = i.view("od").join(i.view("steps").groupBy("od_id").agg(F.count(F.lit(1)).alias("n")), "od_id", "left")
    return met.groupBy(F.when(F.col("n").isNull(), "isolated").otherwise("routed").alias("part")).agg(F.count(F.lit(1)).alias("pairs"))


@query("U6", "select e_id, from_id, to_id from {links} as l union all select e_id, to_id, from_id from {links} as m where lanes % 2 = 0")
def u6(i: Inputs) -> DataFrame:
    k = i.view("links")
    return k.select("e_id", "from_id", "to_id").union(k.filter("lanes % 2 = 0").select("e_id", "to_id", "from_id"))


@query("T1", "select zone_id, yr, cast(value as bigint) as value from {series} as s order by zone_id, yr")
def t1(i: Inputs) -> DataFrame:
    return i.view("series").orderBy("zone_id", "yr")


@query("T2", "select od_id, flow from {od} as o order by flow desc, od_id limit 15")
def t2(i: Inputs) -> DataFrame:
    return i.view("od").select("od_id", "flow").orderBy(F.desc("flow"), "od_id").limit(15)


@query("T3", "select od_id from {od} as o order by od_id limit 1000")
def t3(i: Inputs) -> DataFrame:
    return i.view("od").select("od_id").orderBy("od_id").limit(1000)


@query("T5", "select e_id, array_to_string(list(od_id order by flow, od_id), ',') as by_flow from (select t.e_id, t.od_id, o.flow from {steps} as t join {od} as o on t.od_id = o.od_id where pos = 1) q group by e_id")
def t5(i: Inputs) -> DataFrame:
    first = i.view("steps").filter("pos = 1").join(i.view("od"), "od_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("flow", "od_id"))), lambda s: s["od_id"].cast("string"))
    return first.groupBy("e_id").agg(F.concat_ws(",", ordered).alias("by_flow"))


@query("T6", "select station, array_to_string(list(t_sec order by t_sec), ',') as first_times from (select station, t_sec, row_number() over (partition by station order by t_sec) as place from (select distinct station, t_sec from {stops} as s) d) q where place <= 3 group by station")
def t6(i: Inputs) -> DataFrame:
    held = i.view("stops").groupBy("station").agg(F.slice(F.sort_array(F.collect_set("t_sec")), 1, 3).alias("first_times"))
    return held.withColumn("first_times", F.concat_ws(",", F.col("first_times").cast("array<string>")))


TEXT_SQL = "(select o_orderkey as k, '[' || cast(o_custkey as varchar) || ', ' || o_orderstatus || '_x, ]' as list_text from orders)"


def list_text(i: Inputs) -> DataFrame:
    return i.table("orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(", "), F.col("o_orderstatus"), F.lit("_x, ]")).alias("list_text"))


@query("S1", f"select k, array_to_string(regexp_extract_all(list_text, '[A-Za-z0-9_]+'), '|') as items from {TEXT_SQL} t")
def s1(i: Inputs) -> DataFrame:
    return list_text(i).select("k", F.concat_ws("|", S.words_of(F.col("list_text"))).alias("items"))


@query("S2", f"select k, array_to_string(regexp_extract_all(list_text, '[A-Za-z0-9_]+'), '|') as items from {TEXT_SQL} t")
def s2(i: Inputs) -> DataFrame:
    return list_text(i).select("k", F.concat_ws("|", S.split_list(F.col("list_text"))).alias("items"))


@query("S3", f"select k, case when k % 2 = 0 then '1|b' else array_to_string(regexp_extract_all(list_text, '[A-Za-z0-9_]+'), '|') end as items from {TEXT_SQL} t")
def s3(i: Inputs) -> DataFrame:
    given = F.when(F.col("k") % 2 == 0, F.lit('["1", "b"]')).otherwise(F.col("list_text"))
    return list_text(i).select("k", F.concat_ws("|", S.any_list(given)).alias("items"))


@query("S4", "select p_partkey, split_part(p_brand, '#', 2) as last_part from part")
def s4(i: Inputs) -> DataFrame:
    return i.table("part").select("p_partkey", F.element_at(F.split("p_brand", "#"), -1).alias("last_part"))


@query("S5", "select od_id, cast(origin_node as varchar) || ':' || cast(destination_node as varchar) as pair from {od} as o")
def s5(i: Inputs) -> DataFrame:
    return i.view("od").select("od_id", F.concat_ws(":", "origin_node", "destination_node").alias("pair"))


@query("S6", "select p_partkey, upper(p_type) as up, lower(p_brand) as low, p_type like '%AR%' as has, starts_with(p_brand, 'Brand#1') as starts, replace(p_brand, '#', '-') as dashed from part")
def s6(i: Inputs) -> DataFrame:
    t, b = F.col("p_type"), F.col("p_brand")
    return i.table("part").select("p_partkey", F.upper(t).alias("up"), F.lower(b).alias("low"), t.contains("AR").alias("has"), b.startswith("Brand#1").alias("starts"), F.regexp_replace(b, "#", "-").alias("dashed"))


@query("D1", "select o_orderkey, cast(o_orderdate as date) as day from orders")
def d1(i: Inputs) -> DataFrame:
    short = F.date_format("o_orderdate", "yyMMdd").cast("int")
    day = S.date_of_yymmdd(short)
    return i.table("orders").select("o_orderkey", F.when(F.year("o_orderdate") < 2000, F.add_months(day, F.when(F.year(day) >= 2000, -1200).otherwise(0))).otherwise(day).alias("day"))


@query("D2", "select o_orderkey, (isodow(o_orderdate) - 1)::integer as weekday from orders")
def d2(i: Inputs) -> DataFrame:
    return i.table("orders").select("o_orderkey", F.weekday("o_orderdate").alias("weekday"))


@query("D3", "select o_orderkey, cast(unnest(generate_series(cast(o_orderdate as timestamp), cast(o_orderdate as timestamp) + interval 2 day, interval 1 day)) as date) as day from orders")
def d3(i: Inputs) -> DataFrame:
    start = F.to_date("o_orderdate")
    return i.table("orders").select("o_orderkey", F.explode(F.sequence(start, F.date_add(start, 3) - F.expr("interval 1 day"), F.expr("interval 1 day"))).alias("day"))


@query("D4", "select train_id, pos, run_date, case when t_sec < 30000 then t_sec - 30000 + 86400 else t_sec - 30000 end as waited from {stops} as s")
def d4(i: Inputs) -> DataFrame:
    return i.view("stops").select("train_id", "pos", "run_date", S.seconds_between(F.lit(30000), F.col("t_sec")).alias("waited"))


@query("M1", "select zone_id, round(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 4) as km from (select zone_id, power(sin((radians(51.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * power(sin((radians(-0.1) - radians(lon)) / 2), 2) as a from (select zone_id, y / 200.0 as lat, x / 100.0 - 50 as lon from {points} as p) q) r")
def m1(i: Inputs) -> DataFrame:
    p = i.view("points").select("zone_id", (F.col("y") / 200.0).alias("lat"), (F.col("x") / 100.0 - 50).alias("lon"))
    return p.select("zone_id", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(-0.1)), 4).alias("km"))


@query("M2", "select e_id, round(length_m * 0.000621371, 6) as miles, round(length_m * 0.000621371 * 1.60934, 6) as km, round(length_m * 0.01, 6) as pounds from {links} as l")
def m2(i: Inputs) -> DataFrame:
    from wayflux.functions import road

    miles = F.col("length_m") * road.METRE_TO_MILE
    return i.view("links").select("e_id", F.round(miles, 6).alias("miles"), F.round(miles * road.MILE_TO_KM, 6).alias("km"), F.round(F.col("length_m") * 0.01, 6).alias("pounds"))


@query("M3", "select od_id, least(flow, 5) as low, greatest(flow, 3) as high, least(greatest(flow, 2), 7) as clipped from {od} as o")
def m3(i: Inputs) -> DataFrame:
    f = F.col("flow")
    return i.view("od").select("od_id", F.least(f, F.lit(5)).alias("low"), F.greatest(f, F.lit(3)).alias("high"), F.least(F.greatest(f, F.lit(2)), F.lit(7)).alias("clipped"))


@query("M4", "select od_id, round(cast(flow as double) / nullif(origin_node % 4, 0), 6) as ratio from {od} as o")
def m4(i: Inputs) -> DataFrame:
    return i.view("od").select("od_id", F.round(F.try_divide(F.col("flow").cast("double"), F.col("origin_node") % 4), 6).alias("ratio"))


@query("M5", "select od_id, cast(round_even(flow / 2.0, 0) as bigint) as halved from {od} as o")
def m5(i: Inputs) -> DataFrame:
    return i.view("od").select("od_id", F.bround(F.col("flow") / 2.0, 0).cast("long").alias("halved"))


@query("M6", "select l_orderkey, l_linenumber, case when l_discount < 0.05 then 0.0 else l_discount end as kept from lineitem")
def m6(i: Inputs) -> DataFrame:
    d = F.col("l_discount").cast("double")
    return i.table("lineitem").select("l_orderkey", "l_linenumber", F.when(d < 0.05, 0.0).otherwise(d).alias("kept"))


@query("M7", "select e_id, index_i, index_j, length_m, least(depth_surface_cm, depth_river_cm) as lo, greatest(depth_surface_cm, depth_river_cm) as hi, (depth_surface_cm + depth_river_cm) / 2.0 as mid from {segments} as s")
def m7(i: Inputs) -> DataFrame:
    a, b = F.col("depth_surface_cm"), F.col("depth_river_cm")
    both = F.filter(F.array(a, b), lambda x: x.isNotNull())
    mid = F.aggregate(both, F.lit(0.0), lambda s, x: s + x.cast("double"), lambda s: F.try_divide(s, F.size(both).cast("double")))
    return i.view("segments").select("e_id", "index_i", "index_j", "length_m", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), mid.alias("mid"))


@query("M8", "select e_id, min(nullif(depth_surface_cm, 0)) as least_wet from {segments} as s group by e_id")
def m8(i: Inputs) -> DataFrame:
    return i.view("segments").groupBy("e_id").agg(F.min(F.nullif(F.col("depth_surface_cm"), F.lit(0))).alias("least_wet"))


@query("R1", "select e_id, index_i, index_j, length_m, 'depth_surface_cm' as name, depth_surface_cm as depth from {segments} as s union all select e_id, index_i, index_j, length_m, 'depth_river_cm', depth_river_cm from {segments} as t")
def r1(i: Inputs) -> DataFrame:
    return i.view("segments").unpivot(["e_id", "index_i", "index_j", "length_m"], ["depth_surface_cm", "depth_river_cm"], "name", "depth")


@query("R3", "select origin_node, destination_node from {od} as o where flow = 9 group by origin_node, destination_node")
def r3(i: Inputs) -> DataFrame:
    held = i.view("od").filter("flow = 9").groupBy("origin_node").agg(F.collect_set("destination_node").alias("to"))
    return held.select("origin_node", F.explode("to").alias("destination_node"))


@query("W1", "select od_id, cast(sum(flow) over (partition by origin_node) as bigint) as total, cast(sum(flow) over (partition by origin_node order by flow desc, od_id rows unbounded preceding) as bigint) as running, cast(count(*) over (partition by origin_node) as bigint) as n from {od} as o")
def w1(i: Inputs) -> DataFrame:
    w = Window.partitionBy("origin_node")
    run = w.orderBy(F.desc("flow"), "od_id").rowsBetween(Window.unboundedPreceding, 0)
    return i.view("od").select("od_id", F.sum("flow").over(w).alias("total"), F.sum("flow").over(run).alias("running"), F.count(F.lit(1)).over(w).alias("n"))


@query("W2", "select od_id from (select od_id, flow, count(*) over (partition by origin_node) as n, cast(sum(flow) over (partition by origin_node order by flow desc, od_id rows unbounded preceding) as double) / sum(flow) over (partition by origin_node) as part from {od} as o) q where flow > 1 or n = 1 or (flow = 1 and part < 0.7)")
def w2(i: Inputs) -> DataFrame:
    w = w1(i).join(i.view("od").select("od_id", "flow"), "od_id")
    part = F.try_divide(F.col("running").cast("double"), F.col("total").cast("double"))
    return w.filter((F.col("flow") > 1) | (F.col("n") == 1) | ((F.col("flow") == 1) & (part < 0.7))).select("od_id")


@query("W3", "select zone_id, yr, cast(rank() over (partition by yr order by value desc) as integer) as place from {series} as s")
def w3(i: Inputs) -> DataFrame:
    return i.view("series").select("zone_id", "yr", F.rank().over(Window.partitionBy("yr").orderBy(F.desc("value"))).alias("place"))


@query("W4", "select zone_id, yr, cast(dense_rank() over (partition by yr order by value) + dense_rank() over (partition by yr order by zone_id % 7) as integer) as score from {series} as s")
def w4(i: Inputs) -> DataFrame:
    rank = lambda c: F.dense_rank().over(Window.partitionBy("yr").orderBy(c))
    return i.view("series").select("zone_id", "yr", (rank("value") + rank(F.col("zone_id") % 7)).alias("score"))


@query("W5", "select zone_id, min(yr) as yr from (select zone_id, yr, value, max(value) over (partition by zone_id) as most from {series} as s) q where value = most group by zone_id")
def w5(i: Inputs) -> DataFrame:
    return i.view("series").groupBy("zone_id").agg(F.max(F.struct("value", (-F.col("yr")).alias("back"))).alias("m")).select("zone_id", (-F.col("m.back")).alias("yr"))


@query("W6", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders) q where place = 1")
def w6(i: Inputs) -> DataFrame:
    return T.first_per_key(i.table("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("W7", "select zone_id, round(coalesce(cast(population as double) / nullif(sum(population) over (partition by region_id), 0), 0), 6) as share from {zones} as z")
def w7(i: Inputs) -> DataFrame:
    return i.view("zones").select("zone_id", F.round(T.share_of_group(F.col("population").cast("double"), ["region_id"]), 6).alias("share"))


@query("W10", "select c_custkey, row_number() over (order by c_custkey) as n from customer")
def w10(i: Inputs) -> DataFrame:
    return T.dense_ids(i.table("customer"), "c_custkey", "n")
