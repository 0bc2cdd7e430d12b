"""Queries of assignment, rerouting, clustering and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import ensure_checkpoint_dir, fresh
from wayflux.operators import assign as A
from wayflux.operators import clusters as C
from wayflux.operators import links as L
from wayflux.operators import paths as P
from wayflux.operators import rail as R
from wayflux.plans.links import ready
from wayflux.plans.registry import Inputs, query
from wayflux.streaming import running


def network(i: Inputs) -> DataFrame:
    """Links whose capacity is a few trips, so that the second round has work."""
    weight = F.round("length_m").cast("long").alias("weight")
    costs = ["time_cost", "operating_cost", F.col("average_toll_cost").alias("toll_cost")]
    return L.with_costs(ready(i), "car").select("e_id", "from_id", "to_id", weight, *costs, "combined_label", "initial_flow_speeds", "min_flow_speeds", "breakpoint_flows", F.lit(0.0).alias("acc_flow"), (F.col("lanes") * 10.0).alias("acc_capacity"), (F.col("lanes") * 10.0).alias("current_capacity"))


def demand(i: Inputs) -> DataFrame:
    return i.view("od").select("origin_node", "destination_node", "flow")


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def odpfc(i: Inputs) -> DataFrame:
    return P.collect_paths(i.view("steps")).join(i.view("od").select("od_id", F.col("flow").cast("double").alias("flow")), "od_id")


def scenario_capacity(i: Inputs) -> DataFrame:
    hit = i.view("links").filter("e_id % 9 = 0").withColumn("scenario", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    return hit.select("scenario", "e_id", (F.col("lanes") * F.col("scenario") * 0.5).alias("capacity"))


@query("G4")
def g4(i: Inputs) -> DataFrame:
    od = demand(i).groupBy("origin_node", "destination_node").agg(F.sum("flow").alias("flow")).withColumn("od_id", F.xxhash64("origin_node", "destination_node"))
    routed = A.assignment_round(network(i), od)[0]
    total = A.total_costs(routed, "assigned")  # one row
    out = routed.select("origin_node", "destination_node", "flow", "assigned", *A.COSTS).crossJoin(F.broadcast(total))
    return rounded(out, "assigned", *A.COSTS, *total.columns)


@query("G4b")
def g4b(i: Inputs) -> DataFrame:
    paths, isolated, _ = A.assign(network(i), demand(i))
    total = A.total_costs(paths)  # one row
    # A pair's costs are those of its flow over all its paths.
    costs = [F.sum(F.col("flow") * F.col(c)).alias(c) for c in A.COSTS]
    routed = paths.groupBy("origin_node", "destination_node").agg(F.sum("flow").alias("flow"), *costs).withColumn("part", F.lit("routed"))
    out = routed.unionByName(isolated.withColumn("part", F.lit("isolated")), allowMissingColumns=True).crossJoin(F.broadcast(total))
    return rounded(out, "flow", *A.COSTS, *total.columns)


MOVED_SQL = "(select c.scenario, t.od_id, max(o.flow) - min(c.capacity) as displaced from {steps} as t join {od} as o on o.od_id = t.od_id join (select s.scenario, e_id, lanes * s.scenario * 0.5 as capacity from {links} as l cross join (values (0), (1), (2)) as s(scenario) where e_id % 9 = 0) c on c.e_id = t.e_id group by c.scenario, t.od_id having max(o.flow) - min(c.capacity) > 0)"


@query("G11", f"select scenario, e_id, cast(sum(displaced) as double) as freed from {MOVED_SQL} m join {{steps}} as t on t.od_id = m.od_id group by scenario, e_id")
def g11(i: Inputs) -> DataFrame:
    trips = odpfc(i)
    moved = A.displaced(trips, scenario_capacity(i))
    return A.restored(network(i), trips, moved).select("scenario", "e_id", "freed")


@query("G12_displaced", f"select scenario, cast(sum(displaced) as double) as change_flow, cast(count(*) as bigint) as trips from {MOVED_SQL} m group by scenario")
def g12_displaced(i: Inputs) -> DataFrame:
    moved = A.displaced(odpfc(i), scenario_capacity(i))
    return moved.groupBy("scenario").agg(F.sum("displaced").alias("change_flow"), F.count(F.lit(1)).alias("trips"))


def event(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links before the event, the trips on them, and each scenario's capacities and speed limits."""
    trips = fresh(odpfc(i).join(i.view("od").select("od_id", "origin_node", "destination_node"), "od_id"))
    state = ready(i).withColumn("acc_capacity", F.col("lanes") * 10.0).withColumn("current_capacity", F.col("lanes") * 10.0)
    state = state.drop("acc_flow").join(P.flow_on_edges(trips).withColumnRenamed("flow", "acc_flow"), "e_id", "left").fillna({"acc_flow": 0.0})
    # The damaged links are passed slowly, the more so the milder the scenario's loss of capacity is.
    limits = scenario_capacity(i).select("scenario", "e_id", (10.0 + 5 * F.col("scenario")).alias("max_speed"))
    return L.with_flow_speed(state), trips, scenario_capacity(i), limits


@query("G12_rerouting")
@query("G12")
def g12(i: Inputs) -> DataFrame:
    state, trips, capacity, limits = event(i)
    out = A.rerouting_costs(state, trips, capacity, limits=limits)
    return rounded(out, *[c for c in out.columns if c not in ("scenario", "trips")])


@query("G12_flow")
def g12_flow(i: Inputs) -> DataFrame:
    state, trips, capacity, limits = event(i)
    return rounded(A.rerouting(state, trips, capacity, limits=limits)[1], "acc_flow", "change_flow")


@query("G13_given_paths", "select t.e_id, cast(sum(o.flow) as double) / 2 as flow_now, cast(sum(case when o.od_id % 2 = 0 then o.flow end) as double) / 2 as flow_even from {steps} as t join {od} as o on o.od_id = t.od_id group by t.e_id")
def g13_given_paths(i: Inputs) -> DataFrame:
    od = i.view("od").select("od_id", F.col("flow").alias("now"), F.when(F.col("od_id") % 2 == 0, F.col("flow")).alias("even"))
    long = od.unpivot("od_id", ["now", "even"], "scenario", "flow")
    edge = P.collect_paths(i.view("steps")).join(long, "od_id").select("scenario", "flow", F.explode("path").alias("e_id"))
    wide = edge.groupBy("e_id").pivot("scenario", ["now", "even"]).agg(F.sum("flow").cast("double") / 2)
    return wide.withColumnsRenamed({"now": "flow_now", "even": "flow_even"})


@query("G13_rail_flow")
@query("G13")
def g13(i: Inputs) -> DataFrame:
    links = i.view("links").select("e_id", "from_id", "to_id", F.round("length_m").cast("long").alias("weight"), (F.col("lanes") * 10.0).alias("capacity"))
    od = i.view("od").select("origin_node", "destination_node", F.col("flow").alias("now"), F.when(F.col("od_id") % 2 == 0, F.col("flow")).otherwise(0).alias("even"))
    return R.all_or_nothing(links, od, ["even"], "now")


@query("G14")
def g14(i: Inputs) -> DataFrame:
    links = i.view("links").select("e_id", "from_id", "to_id", F.round("length_m").cast("long").alias("weight"))
    out = R.edge_speeds(links, R.stop_times(i.view("stops")))  # a station stands at the node of its number
    return rounded(out, "fast", "middle")


@query("G6")
def g6(i: Inputs) -> DataFrame:
    speed = F.when(F.col("e_id") % 10 == 0, F.col("lanes") * 10.0)
    edges = i.view("links").select("e_id", F.col("from_id").alias("from_node"), F.col("to_id").alias("to_node"), speed.alias("speed"))
    return A.filled_speeds(edges).select("e_id", F.round("speed", 6).alias("speed"))


@query("W11", "select l.e_id, round(case when a.s is not null and b.s is not null then (a.s + b.s) / 2 else coalesce(a.s, b.s) end, 6) as speed from {links} as l left join (select n, avg(lanes) as s from (select from_id as n, lanes from {links} as x where e_id % 3 = 0 union all select to_id, lanes from {links} as y where e_id % 3 = 0) q group by n) a on a.n = l.from_id left join (select n, avg(lanes) as s from (select from_id as n, lanes from {links} as x where e_id % 3 = 0 union all select to_id, lanes from {links} as y where e_id % 3 = 0) q group by n) b on b.n = l.to_id")
def w11(i: Inputs) -> DataFrame:
    k = i.view("links").select("e_id", "from_id", "to_id", F.col("lanes").cast("double").alias("lanes"))
    some = k.filter("e_id % 3 = 0")
    at = some.select(F.col("from_id").alias("n"), "lanes").union(some.select("to_id", "lanes")).groupBy("n").agg(F.avg("lanes").alias("s"))
    met = k.join(at.select(F.col("n").alias("from_id"), F.col("s").alias("s0")), "from_id", "left").join(at.select(F.col("n").alias("to_id"), F.col("s").alias("s1")), "to_id", "left")
    mean = F.when(F.col("s0").isNotNull() & F.col("s1").isNotNull(), (F.col("s0") + F.col("s1")) / 2).otherwise(F.coalesce("s0", "s1"))
    return met.select("e_id", F.round(mean, 6).alias("speed"))


def measures(i: Inputs) -> DataFrame:
    return i.view("links").select("e_id", "length_m", F.col("lanes").cast("double").alias("lanes"))


@query("ML1")
def ml1(i: Inputs) -> DataFrame:
    return C.mixture_clusters(measures(i), ["length_m", "lanes"])[0].select("e_id", "cluster", "probability")


@query("ML2")
def ml2(i: Inputs) -> DataFrame:
    return C.centre_scores(C.mixture_clusters(measures(i), ["length_m", "lanes"])[1], ["length_m", "lanes"])


@query("ML3", "select zone_id as x, round(min_by(y0 + (y - y0) * (-v0) / (value - v0), y), 6) as y from (select zone_id, y, lag(y) over w as y0, value, lag(value) over w as v0 from (select zone_id, cast(yr as double) as y, value - avg(value) over (partition by zone_id) as value from {series} as s) d window w as (partition by zone_id order by y)) q where v0 is not null and sign(v0) <> sign(value) group by zone_id")
def ml3(i: Inputs) -> DataFrame:
    mean = F.avg("value").over(Window.partitionBy("zone_id"))
    grid = i.view("series").select(F.col("zone_id").alias("x"), F.col("yr").cast("double").alias("y"), (F.col("value") - mean).alias("value"))
    return C.boundary(grid).withColumn("y", F.round("y", 6))


@query("ML3_regimes")
def ml3_regimes(i: Inputs) -> DataFrame:
    return C.regime_boundary(measures(i), C.fit_mixture(measures(i), ["length_m", "lanes"]))


def _streamed(i: Inputs, rows: DataFrame, plan, mode: str) -> DataFrame:
    """``plan`` over ``rows`` arriving as files: all that is there is taken, then the query ends."""
    home = f"{ensure_checkpoint_dir(i.spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{home}/in")
    arriving = i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(f"{home}/in")
    if mode == "append":
        flow = plan(arriving).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    else:
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/out")
        flow = plan(arriving).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    flow.awaitTermination()
    return i.spark.read.parquet(f"{home}/out")


@query("ST1", "select t.e_id, p.purpose, round(sum(o.flow * cast(p.share as double)), 6) as flow from {steps} as t join {od} as o on t.od_id = o.od_id join (values (0, 'work', 0.5), (0, 'home', 0.5), (1, 'work', 1.0), (2, 'unknown', 1.0)) as p(kind, purpose, share) on p.kind = o.od_id % 3 group by t.e_id, p.purpose")
def st1(i: Inputs) -> DataFrame:
    shares = i.spark.createDataFrame([(0, "work", 0.5), (0, "home", 0.5), (1, "work", 1.0)], "kind long, purpose string, share double")
    trips = odpfc(i).select((F.col("od_id") % 3).alias("kind"), "path", "flow")
    return _streamed(i, trips, lambda s: running.running_edge_flow(s, shares), "complete").withColumn("flow", F.round("flow", 6))


@query("ST2", "select distinct t.od_id, t.e_id, cast(o.flow as double) as flow from {steps} as t join {od} as o on o.od_id = t.od_id where t.e_id % 9 = 0")
def st2(i: Inputs) -> DataFrame:
    hit = i.view("links").filter("e_id % 9 = 0").select("e_id")
    return _streamed(i, odpfc(i), lambda s: running.disrupted_trips(s, hit), "append")
