"""Queries of demand, access, rail, statistics and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayflux.operators import demand as M
from wayflux.operators import rail as R
from wayflux.operators import routing as G
from wayflux.operators import tables as T
from wayflux.operators.graph import connected_components
from wayflux.plans.registry import Inputs, query


def trips(i: Inputs) -> DataFrame:
    return i.view("trips").withColumn("flow", F.col("flow").cast("double"))


@query("A18", "select road_classification as zone, round(sum(lanes * length_m) / sum(length_m), 6) as mean_lanes from {links} as l group by road_classification")
def a18(i: Inputs) -> DataFrame:
    mean = F.try_divide(F.sum(F.col("lanes") * F.col("length_m")), F.sum("length_m"))
    return i.view("links").groupBy(F.col("road_classification").alias("zone")).agg(F.round(mean, 6).alias("mean_lanes"))


@query("A20", "select z.zone_id, round(avg(cast(t.n as double)), 6) as mean_trips from {zones} as z left join {trips} as t on t.origin = z.zone_id group by z.zone_id")
def a20(i: Inputs) -> DataFrame:
    mean = i.view("trips").groupBy(F.col("origin").alias("zone_id")).agg(F.round(F.avg(F.col("n").cast("double")), 6).alias("mean_trips"))
    return i.view("zones").select("zone_id").join(mean, "zone_id", "left")


NEAR_SQL = "(select *, (origin * 7 + destination * 3) % 60 as minutes from {trips} as t0)"


@query("A21", f"select f.destination, f.flow, cast(coalesce(p.population, 0) as bigint) as population from (select destination, cast(sum(n) as bigint) as flow from {NEAR_SQL} a where minutes <= 20 group by destination) f left join (select destination, sum(z.population) as population from (select distinct destination, origin from {NEAR_SQL} b where minutes <= 20) d join {{zones}} as z on z.zone_id = d.origin group by destination) p on f.destination = p.destination")
def a21(i: Inputs) -> DataFrame:
    od = i.view("trips").select("origin", "destination", F.col("n").alias("flow"), ((F.col("origin") * 7 + F.col("destination") * 3) % 60).alias("time"))
    return M.accessible(od, i.view("zones").select("zone_id", "population"), 20)


@query("A22", "select o_custkey % 50 as zone_id, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as finished, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) as open_ from orders group by o_custkey % 50")
def a22(i: Inputs) -> DataFrame:
    count = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0))
    return i.table("orders").groupBy((F.col("o_custkey") % 50).alias("zone_id")).agg(count("F").alias("finished"), count("O").alias("open_"))


@query("A23", "select zone_id, round(sum(value) / 7.0, 6) as per_day from {series} as s group by zone_id")
def a23(i: Inputs) -> DataFrame:
    return i.view("series").groupBy("zone_id").agg(F.round(F.sum("value") / 7.0, 6).alias("per_day"))


@query("A24", "select zone_id, cast(coalesce(sum(case when yr % 3 = 0 then value end), 0) as bigint) as y0, cast(coalesce(sum(case when yr % 3 = 1 then value end), 0) as bigint) as y1 from {series} as s group by zone_id")
def a24(i: Inputs) -> DataFrame:
    kinds = i.view("series").withColumn("kind", F.concat(F.lit("y"), (F.col("yr") % 3).cast("string")))
    return kinds.groupBy("zone_id").pivot("kind", ["y0", "y1"]).agg(F.sum("value")).fillna(0)


@query("A25", "select zone_id, cast(sum(value) as bigint) as total, min(source) as first_source from (select zone_id, value, 'orders' as source from {series} as s union all select zone_id, population, 'people' from {zones} as z) q group by zone_id")
def a25(i: Inputs) -> DataFrame:
    a = i.view("series").select("zone_id", "value", F.lit("orders").alias("source"))
    b = i.view("zones").select("zone_id", F.col("population").alias("value"), F.lit("people").alias("source"))
    return a.unionByName(b).groupBy("zone_id").agg(F.sum("value").alias("total"), F.min_by("source", "source").alias("first_source"))


@query("A26", "select region_id, array_to_string(list(zone_id order by zone_id), ',') as zones from {zones} as z group by region_id")
def a26(i: Inputs) -> DataFrame:
    held = i.view("zones").groupBy("region_id").agg(F.sort_array(F.collect_list("zone_id")).alias("zones"))
    return held.withColumn("zones", F.concat_ws(",", F.col("zones").cast("array<string>")))


@query("A27", "select t.e_id, p.purpose, round(sum(o.flow * p.share), 6) as flow from {steps} as t join {od} as o on t.od_id = o.od_id cross join (values ('work', cast(0.5 as double)), ('school', cast(0.25 as double)), ('none', cast(0 as double))) as p(purpose, share) where p.share > 0 group by t.e_id, p.purpose")
def a27(i: Inputs) -> DataFrame:
    purposes = F.array(*[F.struct(F.lit(n).alias("purpose"), F.lit(s).alias("share")) for n, s in (("work", 50.0), ("school", 0.25), ("none", 0.0))])
    od = i.view("od").select("od_id", "flow", F.inline(purposes)).withColumn("share", F.when(F.col("share") > 1, F.col("share") / 100).otherwise(F.col("share")))
    flow = i.view("steps").join(od, "od_id").groupBy("e_id", "purpose").agg(F.sum(F.col("flow") * F.col("share")).alias("flow"))
    return flow.filter("flow > 0").withColumn("flow", F.round("flow", 6))


@query("A28", "select s.scenario, cast(count(o.od_id) as bigint) as n from (select unnest(range(11)) as scenario) s left join {od} as o on o.flow = s.scenario group by s.scenario")
def a28(i: Inputs) -> DataFrame:
    seen = i.view("od").groupBy(F.col("flow").alias("scenario")).agg(F.count(F.lit(1)).alias("n"))
    every = i.spark.range(11).withColumnRenamed("id", "scenario")
    return every.join(seen, "scenario", "left").fillna(0)


@query("A29", "select origin_node % 5 as event, cast(sum(greatest(flow - 4, 0) * (flow % 3)) as bigint) as total from {od} as o group by origin_node % 5")
def a29(i: Inputs) -> DataFrame:
    cost = F.greatest(F.col("flow") - 4, F.lit(0)) * (F.col("flow") % 3)
    return i.view("od").groupBy((F.col("origin_node") % 5).alias("event")).agg(F.sum(cost).alias("total"))


@query("A30", "select d.zone_id, d.day, coalesce(lo, 0) as lo, coalesce(hi, 0) as hi, coalesce(mean, 0) as mean from (select zone_id, unnest(range(1990, 2000)) as day from {zones} as z) d left join (select zone_id, yr, min(greatest(value - 5, 0)) as lo, max(greatest(value - 5, 0)) as hi, round(avg(greatest(value - 5, 0)), 6) as mean from {series} as s group by zone_id, yr) e on e.zone_id = d.zone_id and e.yr = d.day")
def a30(i: Inputs) -> DataFrame:
    days = i.view("zones").select("zone_id", F.explode(F.sequence(F.lit(1990).cast("long"), F.lit(1999).cast("long"))).alias("day"))
    cost = F.greatest(F.col("value") - 5, F.lit(0))
    seen = i.view("series").groupBy("zone_id", F.col("yr").cast("long").alias("day")).agg(F.min(cost).alias("lo"), F.max(cost).alias("hi"), F.round(F.avg(cost), 6).alias("mean"))
    return days.join(seen, ["zone_id", "day"], "left").fillna(0)


@query("A31", "select origin_node % 3 as depth, destination_node % 4 as event, round(sum(flow) / 1000000.0, 6) as millions from {od} as o group by origin_node % 3, destination_node % 4")
def a31(i: Inputs) -> DataFrame:
    return i.view("od").groupBy((F.col("origin_node") % 3).alias("depth"), (F.col("destination_node") % 4).alias("event")).agg(F.round(F.sum("flow") / 1_000_000.0, 6).alias("millions"))


@query("A32", "select train_id, max(case when dayofweek(run_date) = 0 then 1 else 0 end) as sun, max(case when dayofweek(run_date) = 6 then 1 else 0 end) as sat from {stops} as s group by train_id")
def a32(i: Inputs) -> DataFrame:
    day = lambda n: F.max(F.when(F.weekday("run_date") == n, 1).otherwise(0))
    return i.view("stops").groupBy("train_id").agg(day(6).alias("sun"), day(5).alias("sat"))


@query("A33", "select run_date, trains, round(cast(trains as double) / sum(trains) over (), 6) as share from (select run_date, cast(count(distinct train_id) as bigint) as trains from {stops} as s group by run_date) q")
def a33(i: Inputs) -> DataFrame:
    daily = i.view("stops").groupBy("run_date").agg(F.countDistinct("train_id").alias("trains"))
    total = daily.agg(F.sum("trains").alias("total"))  # one row
    return daily.crossJoin(F.broadcast(total)).select("run_date", "trains", F.round(F.col("trains").cast("double") / F.col("total"), 6).alias("share"))


@query("A34", "select distinct a.station as from_station, b.station as to_station from {stops} as a join {stops} as b on a.train_id = b.train_id and a.run_date = b.run_date and a.pos < b.pos where a.stop = 'S' and b.stop = 'S' and a.station <> b.station")
def a34(i: Inputs) -> DataFrame:
    return R.downstream(i.view("stops"))


STEP_SQL = "(select train_id, run_date, pos, lag(station) over w as from_station, station as to_station, t_sec - lag(t_sec) over w as seconds from {stops} as s where stop = 'S' window w as (partition by train_id, run_date order by pos))"


@query("A35", f"select to_station, cast(max(seconds) as double) as fast, cast(median(seconds) as double) as middle from (select distinct to_station, seconds from {STEP_SQL} q where from_station is not null) d group by to_station")
def a35(i: Inputs) -> DataFrame:
    times = R.stop_times(i.view("stops")).select("to_station", "seconds").distinct()
    return times.groupBy("to_station").agg(F.max("seconds").cast("double").alias("fast"), F.median("seconds").cast("double").alias("middle"))


@query("W9", f"select train_id, run_date, pos, from_station, to_station, seconds from {STEP_SQL} q where from_station is not null")
def w9(i: Inputs) -> DataFrame:
    return R.stop_times(i.view("stops"))


@query("A36", "select region_id, cast(sum(population) as bigint) as population, cast(max(population) as bigint) as largest from {zones} as z group by region_id")
def a36(i: Inputs) -> DataFrame:
    return i.view("zones").groupBy("region_id").agg(F.sum("population").alias("population"), F.max("population").alias("largest"))


@query("A37", "select cast(sum(flow) as bigint) as trips, cast(count(distinct origin_node) as bigint) as origins, cast(count(*) as bigint) as pairs, round(cast(sum(case when flow > 1 then flow else 0 end) as double) / sum(flow), 6) as kept from {od} as o")
def a37(i: Inputs) -> DataFrame:
    kept = F.try_divide(F.sum(F.when(F.col("flow") > 1, F.col("flow")).otherwise(0)).cast("double"), F.sum("flow"))
    return i.view("od").agg(F.sum("flow").alias("trips"), F.countDistinct("origin_node").alias("origins"), F.count(F.lit(1)).alias("pairs"), F.round(kept, 6).alias("kept"))


@query("A38", "select od_id, coalesce(cast(nullif(flow, 9) as double), (select median(nullif(flow, 9)) from {od} as p)) as filled from {od} as o")
def a38(i: Inputs) -> DataFrame:
    od = i.view("od").withColumn("flow", F.nullif(F.col("flow"), F.lit(9)).cast("double"))
    return od.select("od_id", F.coalesce("flow", F.lit(T.exact_median(od, "flow")).cast("double")).alias("filled"))


@query("A39", "select kind, owner, cast(count(*) as bigint) as n from (select node_id % 10 as k, kind from {sites} as s) a join (select zone_id % 10 as k, owner from {points} as p) b on a.k = b.k group by kind, owner")
def a39(i: Inputs) -> DataFrame:
    a = i.view("sites").groupBy((F.col("node_id") % 10).alias("k"), "kind").agg(F.count(F.lit(1)).alias("na"))
    b = i.view("points").groupBy((F.col("zone_id") % 10).alias("k"), "owner").agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, "k").groupBy("kind", "owner").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


@query("A40", "select zone_id, yr, round(slope * yr + intercept, 4) as value from (select zone_id, regr_slope(value, yr) as slope, regr_intercept(value, yr) as intercept from {series} as s group by zone_id) q cross join (values (cast(2030 as bigint)), (cast(2050 as bigint))) as y(yr)")
def a40(i: Inputs) -> DataFrame:
    return M.linear_trend(i.view("series"), "zone_id", [2030, 2050]).withColumn("value", F.round("value", 4))


@query("A41", "select region_id, cast(sum(population) as bigint) as population, cast(sum(zone_id) as bigint) as zone_id from {zones} as z group by region_id")
def a41(i: Inputs) -> DataFrame:
    z = i.view("zones")
    numeric = [f.name for f in z.schema if f.dataType.typeName() in ("integer", "long", "double") and f.name != "region_id"]
    return z.groupBy("region_id").agg(*[F.sum(c).cast("long").alias(c) for c in numeric])


TIMETABLE_SQL = "(select train_id, min(run_date) as date_from, max(run_date) as date_to, " + ", ".join(f"max(case when dayofweek(run_date) = {(w + 1) % 7} then 1 else 0 end) as d{w}" for w in range(7)) + " from {stops} as s0 group by train_id)"


@query("J20", f"select c.day, cast(count(distinct r.train_id) as bigint) as trains, cast(sum(r.train_id) as bigint) as ids from (select distinct run_date as day from {{stops}} as s1) c join {TIMETABLE_SQL} r on r.date_from <= c.day and c.day <= r.date_to where case dayofweek(c.day) " + " ".join(f"when {(w + 1) % 7} then d{w}" for w in range(7)) + " end = 1 group by c.day")
def j20(i: Inputs) -> DataFrame:
    # A train's range goes from its first day to its last; it runs on the weekdays on which it was seen.
    seen = F.weekday("run_date")
    flags = [F.max(F.when(seen == w, 1).otherwise(0)).alias(f"d{w}") for w in range(7)]
    timetable = i.view("stops").groupBy("train_id").agg(F.min("run_date").alias("date_from"), F.max("run_date").alias("date_to"), *flags)
    days = R.running_days(timetable, "date_from", "date_to", F.array(*[F.col(f"d{w}") for w in range(7)]))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("trains"), F.sum("train_id").alias("ids"))


@query("J20_one_day", "select train_id, cast(count(*) as bigint) as days from (select distinct train_id, run_date from {stops} as s) q where dayofweek(run_date) between 1 and 5 group by train_id")
def j20_one_day(i: Inputs) -> DataFrame:
    runs = i.view("stops").select("train_id", "run_date").distinct()
    days = R.running_days(runs, "run_date", "run_date", F.array(*[F.lit(x) for x in (1, 1, 1, 1, 1, 0, 0)]))
    return days.groupBy("train_id").agg(F.count(F.lit(1)).alias("days"))


@query("J23", "select p.origin, p.destination, cast(count(b.train_id) as integer) as trains from (select distinct station as origin, (station + 7) % 40 as destination from {stops} as s0) p left join (select distinct x.train_id, x.station as o, y.station as d from {stops} as x join {stops} as y on x.train_id = y.train_id where x.stop = 'S' and y.stop = 'S' and y.station = (x.station + 7) % 40) b on b.o = p.origin and b.d = p.destination group by p.origin, p.destination")
def j23(i: Inputs) -> DataFrame:
    od = i.view("stops").select(F.col("station").alias("origin"), ((F.col("station") + 7) % 40).alias("destination")).distinct()
    return R.trains_between(i.view("stops"), od).select("origin", "destination", F.size("trains").alias("trains"))


@query("J24", "select s.zone_id, s.yr, d.scenario from {series} as s left join (select zone_id, yr, cast(value as decimal(20,2)) as v, row_number() over (order by zone_id, yr) as scenario from {series} as t where yr % 2 = 0) d on d.zone_id = s.zone_id and d.yr = s.yr and d.v = cast(s.value as decimal(20,2))")
def j24(i: Inputs) -> DataFrame:
    s = i.view("series").withColumn("v", F.col("value").cast("decimal(20,2)"))
    design = s.filter("yr % 2 = 0").select("zone_id", "yr", "v", F.struct("zone_id", "yr").alias("row"))
    design = design.join(T.dense_ids(design, "row", "scenario"), "row").drop("row").withColumn("scenario", F.col("scenario").cast("long"))
    return s.join(design, ["zone_id", "yr", "v"], "left").select("zone_id", "yr", "scenario")


@query("M19", "select zone_id, cast(floor((x * 3 + 1) * (case when y < 5000 then 1 else y / 3000.0 end)) as bigint) as floor_area from {points} as p")
def m19(i: Inputs) -> DataFrame:
    height = F.when(F.col("y") < 5000, 1.0).otherwise(F.col("y") / 3000.0)
    return i.view("points").select("zone_id", ((F.col("x") * 3 + 1) * height).cast("long").alias("floor_area"))


GROWTH_SQL = "(select zone_id, 1.0 + cast(zone_id % 4 as double) / 8 as growth from {zones} as z0)"


@query("M20", f"select t.origin, t.destination, round_even(cast(t.n as double) * a.growth * b.growth, 0) as future from {{trips}} as t join {GROWTH_SQL} a on a.zone_id = t.origin join {GROWTH_SQL} b on b.zone_id = t.destination")
def m20(i: Inputs) -> DataFrame:
    growth = i.view("zones").select("zone_id", (F.lit(1.0) + (F.col("zone_id") % 4).cast("double") / 8).alias("growth"))
    od = i.view("trips").select("origin", "destination", F.col("n").cast("double").alias("flow"))
    return M.grown(od, growth).select("origin", "destination", "future")


USE_SQL = "select s.station, q.run_date, round(s.n * (cast(q.trains as double) / q.total) * 0.5, 0) as use_ from (select station, count(*) as n from {stops} as a group by station) s cross join (select run_date, trains, sum(trains) over () as total from (select run_date, count(distinct train_id) as trains from {stops} as b group by run_date) x) q"


@query("M21_all_stations", USE_SQL)
@query("M21", USE_SQL)
def m21(i: Inputs) -> DataFrame:
    yearly = i.view("stops").groupBy("station").agg(F.count(F.lit(1)).alias("n"))
    daily = i.view("stops").groupBy("run_date").agg(F.countDistinct("train_id").alias("trains"))
    total = daily.agg(F.sum("trains").alias("total"))  # one row
    days = daily.crossJoin(F.broadcast(total))
    # Every station has a share of every day: the result itself is stations times days.
    return yearly.crossJoin(days).select("station", "run_date", F.round(F.col("n") * (F.col("trains").cast("double") / F.col("total")) * 0.5, 0).alias("use_"))


SHARE_SQL = "(select zone_id, node_id, 1.0 / count(*) over (partition by zone_id) as share from (select kind as zone_id, node_id from {sites} as s0) s1)"


@query("G9", f"select a.node_id as origin_node, b.node_id as destination_node, round(t.n * a.share * b.share, 6) as flow from {{trips}} as t join {SHARE_SQL} a on a.zone_id = t.origin join {SHARE_SQL} b on b.zone_id = t.destination")
def g9(i: Inputs) -> DataFrame:
    sites = i.view("sites").select(F.col("kind").alias("zone_id"), "node_id")
    shares = sites.withColumn("share", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("zone_id")))
    od = i.view("trips").select("origin", "destination", F.col("n").alias("flow"))
    return M.disaggregated(od, shares, 6).select("origin_node", "destination_node", "flow")


HOMES_SQL, WORKS_SQL = "node_id % 3", "node_id % 7 + 1"
MIRROR_SQL = "cast(list_sum([((k >> b) & 1) << (31 - b) for b in range(32)]) as bigint)"


def _circle_sql(end: str, weight: str) -> str:
    """zone_id, node_id, lo, hi of an end's nodes, zones without nodes at their nearest one."""
    own = f"select kind as zone_id, node_id, {weight} as w from {{sites}} as s_{end} where {weight} > 0"
    place = f"select owner as zone_id, avg(x) as x, avg(y) as y from {{points}} as p_{end} group by owner"
    near = f"select c.zone_id, s.node_id, 1 as w, row_number() over (partition by c.zone_id order by (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), s.node_id) as place from ({place}) c cross join {{sites}} as s where c.zone_id not in (select zone_id from ({own}) o)"
    return f"(select zone_id, node_id, cast(floor(cast(upto - w as double) / total * 4294967296) as bigint) as lo, cast(floor(cast(upto as double) / total * 4294967296) as bigint) as hi from (select *, sum(w) over (partition by zone_id order by node_id) as upto, sum(w) over (partition by zone_id) as total from ({own} union all select zone_id, node_id, w from ({near}) n where place = 1) a) b)"


def _turn_sql(end: str) -> str:
    return f"cast('0x' || substr(md5('7|{end}|' || origin || '|' || destination), 1, 8) as bigint)"


@query("G9_drawn", f"select a.node_id as origin_node, b.node_id as destination_node, cast(count(*) as bigint) as flow from (select origin, destination, ({_turn_sql('origin')} + k * 4294967296 // n) % 4294967296 as po, ({_turn_sql('destination')} + {MIRROR_SQL}) % 4294967296 as pd from (select origin, destination, n, unnest(range(n)) as k from {{trips}} as t) u) v left join {_circle_sql('origin', HOMES_SQL)} a on a.zone_id = v.origin and v.po >= a.lo and v.po < a.hi left join {_circle_sql('destination', WORKS_SQL)} b on b.zone_id = v.destination and v.pd >= b.lo and v.pd < b.hi group by a.node_id, b.node_id")
def g9_drawn(i: Inputs) -> DataFrame:
    sites = i.view("sites")
    weights = lambda w: sites.select(F.col("kind").alias("zone_id"), "node_id", F.expr(w).alias("weight"))
    centroids = i.view("points").groupBy(F.col("owner").alias("zone_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    od = i.view("trips").select("origin", "destination", F.col("n").alias("flow"))
    return M.drawn(od, weights(HOMES_SQL), weights(WORKS_SQL), centroids, sites, 7)


@query("G10", "select p.zone_id, round(sum(r.total * p.part), 6) as value from (select zone_id, region_id, cast(population as double) / nullif(sum(population) over (partition by region_id), 0) as part from {zones} as z) p join (select region_id, cast(sum(zone_id) as double) as total from {zones} as y group by region_id) r on r.region_id = p.region_id group by p.zone_id")
def g10(i: Inputs) -> DataFrame:
    z = i.view("zones")
    part = z.withColumn("part", F.try_divide(F.col("population").cast("double"), F.sum("population").over(Window.partitionBy("region_id"))))
    total = z.groupBy("region_id").agg(F.sum("zone_id").cast("double").alias("total"))
    return part.join(total, "region_id").groupBy("zone_id").agg(F.round(F.sum(F.col("total") * F.col("part")), 6).alias("value"))


BOTH_WAYS_SQL = "(select from_id as u, to_id as v, cast(round(length_m) as bigint) as w from {links} as l1 where from_id <> to_id union all select to_id, from_id, cast(round(length_m) as bigint) from {links} as l2 where from_id <> to_id)"


@query("G5", f"with recursive e as (select distinct u, v from {BOTH_WAYS_SQL} b), reach(node, other) as (select distinct u, u from e union select r.node, e.v from reach r join e on e.u = r.other) select node, min(other) as component from reach group by node")
def g5(i: Inputs) -> DataFrame:
    return connected_components(i.view("links"), "from_id", "to_id")


@query("G1")
def g1(i: Inputs) -> DataFrame:
    links = i.view("links").select("e_id", "from_id", "to_id", F.round("length_m").cast("long").alias("weight"))
    od = i.view("od").select("origin_node", "destination_node").distinct()
    return G.least_cost_paths(links, od)


CUTOFF_SQL = "2500 + source % 4 * 500"


@query("G2", f"with recursive e as (select u, v, min(w) as w from {BOTH_WAYS_SQL} b group by u, v), walks(source, node, cost) as (select distinct u, u, cast(0 as bigint) from e union select k.source, e.v, k.cost + e.w from walks k join e on e.u = k.node where k.cost + e.w <= {CUTOFF_SQL.replace('source', 'k.source')}) select source, node, min(cost) as cost from walks where node <> source group by source, node")
def g2(i: Inputs) -> DataFrame:
    links = i.view("links").select("e_id", "from_id", "to_id", F.round("length_m").cast("long").alias("weight"))
    sources = links.select(F.col("from_id").alias("source")).union(links.select("to_id")).distinct()
    return G.reachable(links, sources.withColumn("cutoff", F.expr(CUTOFF_SQL))).select("source", "node", "cost")


@query("G3", "select e_id, left_capacity from (select l.e_id, l.lanes * 40 - coalesce(f.flow, 0) as left_capacity, l.lanes * 40 as base from {links} as l left join (select e_id, cast(count(*) as bigint) as flow from {steps} as t group by e_id) f on f.e_id = l.e_id) q where left_capacity >= 1 and left_capacity >= 0.01 * base")
def g3(i: Inputs) -> DataFrame:
    flow = i.view("steps").groupBy("e_id").agg(F.count(F.lit(1)).alias("flow"))
    links = i.view("links").join(flow, "e_id", "left").fillna({"flow": 0})
    links = links.withColumn("current_capacity", F.col("lanes") * 40).withColumn("acc_capacity", F.col("lanes") * 40 - F.col("flow"))
    return G.unsaturated(links).select("e_id", F.col("acc_capacity").alias("left_capacity"))


@query("G7")
def g7(i: Inputs) -> DataFrame:
    prior = i.view("trips").select("origin", "destination", F.lit(1.0).alias("flow"))
    seen = trips(i)
    rows = seen.groupBy("origin").agg(F.sum("flow").alias("target"))
    columns = seen.groupBy("destination").agg(F.sum("flow").alias("target"))
    return M.fitted(prior, rows, columns).select("origin", "destination", F.round("flow", 3).alias("flow"))


@query("G8", "select origin, destination, round(100 * p / sum(p) over (partition by origin), 6) as flow from (select origin, destination, m * n / ((m + s) * (m + n + s)) as p from (select origin, destination, m, n, coalesce(sum(n) over (partition by origin order by distance, destination rows between unbounded preceding and 1 preceding), 0) as s from (select t.origin, t.destination, cast((t.origin * 5 + t.destination * 3) % 17 as double) as distance, cast(a.population as double) + 1 as m, cast(b.population as double) + 1 as n from {trips} as t join {zones} as a on a.zone_id = t.origin join {zones} as b on b.zone_id = t.destination) q) r) u")
def g8(i: Inputs) -> DataFrame:
    z = i.view("zones")
    at = lambda end, name: z.select(F.col("zone_id").alias(end), (F.col("population").cast("double") + 1).alias(name))
    pairs = i.view("trips").select("origin", "destination", ((F.col("origin") * 5 + F.col("destination") * 3) % 17).cast("double").alias("distance"))
    pairs = pairs.join(at("origin", "m"), "origin").join(at("destination", "n"), "destination")
    return M.radiation(pairs, z.select(F.col("zone_id").alias("origin"), F.lit(100.0).alias("outflow"))).select("origin", "destination", F.round("flow", 6).alias("flow"))


FACTORS = ["lanes", "urban", "average_width", "toll"]
RUNS_SQL = "(select e_id, cast(lanes as double) as lanes, cast(urban as double) as urban, average_width, average_toll_cost as toll, nullif(length_m, case when road_label = 'tunnel' then length_m end) as y from {links} as l)"
NUMBERED_SQL = f"(select *, row_number() over (order by e_id) - 1 as place, count(*) over () as n from {RUNS_SQL} r where y is not null)"
STEPS_SQL = f"(select place // 5 as trajectory, place % 5 as step, y, lanes, urban, average_width, toll from {NUMBERED_SQL} q where place < n // 5 * 5)"


@query("W12", "select factor, round(avg(dy / dx), 4) as mu, round(avg(abs(dy / dx)), 4) as mu_star, round(stddev_samp(dy / dx), 4) as sigma from (" + " union all ".join(f"select '{f}' as factor, y - lag(y) over w as dy, {f} - lag({f}) over w as dx from {STEPS_SQL} t_{f} window w as (partition by trajectory order by step)" for f in FACTORS) + ") q where dx is not null and dx <> 0 group by factor")
def w12(i: Inputs) -> DataFrame:
    links = i.view("links")
    lost = F.when(F.col("road_label") != "tunnel", F.col("length_m"))  # runs without a result
    runs = links.select("e_id", F.col("lanes").cast("double").alias("lanes"), F.col("urban").cast("double").alias("urban"), "average_width", F.col("average_toll_cost").alias("toll"), lost.alias("y"))
    out = M.elementary_effects(M.trajectories(runs, "e_id", len(FACTORS), "y"), FACTORS, "y")
    return out.select("factor", *[F.round(c, 4).alias(c) for c in ("mu", "mu_star", "sigma")])


@query("W12_one_factor", "select factor, round(avg(dy / dx), 6) as mu, round(avg(abs(dy / dx)), 6) as mu_star from (select 'yr' as factor, cast(value - lag(value) over w as double) as dy, cast(yr - lag(yr) over w as double) as dx from {series} as s window w as (partition by zone_id order by yr)) q where dx is not null and dx <> 0 group by factor")
def w12_one_factor(i: Inputs) -> DataFrame:
    runs = i.view("series").select(F.col("zone_id").alias("trajectory"), F.col("yr").alias("step"), F.col("yr").cast("double").alias("yr"), F.col("value").cast("double").alias("y"))
    out = M.elementary_effects(runs, ["yr"], "y")
    return out.select("factor", F.round("mu", 6).alias("mu"), F.round("mu_star", 6).alias("mu_star"))
