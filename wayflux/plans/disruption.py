"""Queries of hazard, damage and recovery (PF11 to PF15, A11 to A15, M9 to M18, J3, J21, J24, S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayflux.functions import road
from wayflux.operators import damage as D
from wayflux.plans.registry import Inputs, query

CURVES = [(f"C{k}", float(d), round(min(1.0, d * 0.1 * (0.5 + 0.1 * k)), 4)) for k in range(1, 7) for d in (0, 1, 2, 4, 8)]
CURVES_SQL = "(values " + ", ".join(f"('{c}', cast({d} as double), cast({y} as double))" for c, d, y in CURVES) + ") as c(curve, depth, fraction)"
UNIT_KEYS = [("road", k) for k in ("m_ge8_urb", "m_ge8_sub", "m_lt8_urb", "m_lt8_sub", "asingle_urb", "asingle_sub", "bsingle_urb", "bsingle_sub", "abdual_ge6_urb", "abdual_ge6_sub", "abdual_lt6_urb", "abdual_lt6_sub")]
UNITS = [(a, k, float(n + 1), float(2 * n + 3)) for n, (a, k) in enumerate(UNIT_KEYS + [("tunnel", k) for _, k in UNIT_KEYS] + [(f"bridge_{f}", v) for f in ("surface", "river") for v in road.LEVELS])]
UNITS_SQL = "(values " + ", ".join(f"('{a}', '{k}', cast({lo} as double), cast({hi} as double))" for a, k, lo, hi in UNITS) + ") as u(asset, key, lo, hi)"
MAJOR = "(road_classification = 'Motorway' or (road_classification = 'A Road' and trunk_road))"
LONG_SQL = """(select s.e_id, s.index_i, s.index_j, s.length_m, l.road_label, l.road_classification, l.form_of_way, l.trunk_road, l.urban, l.lanes, l.average_width, f.flood,
 case f.flood when 'surface' then s.depth_surface_cm else s.depth_river_cm end as depth_cm from {segments} as s join {links} as l on s.e_id = l.e_id cross join (values ('surface'), ('river')) as f(flood))"""


def _bands(levels: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when depth_cm < {e} then '{v}'" for e, v in zip(road.BANDS, levels)) + f" when depth_cm is not null then '{levels[-1]}' end"


LEVEL = "case when flood = 'surface' then case when not {m} then {so} when road_label = 'tunnel' then {st} else {sm} end else case when not {m} then case when depth_cm <= 0 then 'no' else {ro} end when road_label = 'tunnel' then {rt} else {rm} end end".format(
    m=MAJOR, **{f[0] + g[0]: _bands(v) for (f, g), v in road.BAND_LEVELS.items()}
)
LEVELLED_SQL = f"(select *, {LEVEL} as level from {LONG_SQL} l1)"


def longer(i: Inputs) -> DataFrame:
    links = i.view("links").drop("length_m")
    return D.flood_long(i.view("segments").join(links, "e_id"))


def levelled(i: Inputs) -> DataFrame:
    return D.with_level(longer(i))


@query("PF11", "select e_id, index_i, index_j, length_m, case when depth_surface_cm < 30 then 60 * (depth_surface_cm / 30.0 - 1) * (depth_surface_cm / 30.0 - 1) else 0.0 end as max_speed from (select e_id, index_i, index_j, length_m, cast(depth_surface_cm % 45 as double) as depth_surface_cm from {segments} as s) q".replace("60 *", "round(60 *").replace("- 1) else", "- 1), 6) else"))
def pf11(i: Inputs) -> DataFrame:
    s = i.view("segments")
    return s.select("e_id", "index_i", "index_j", "length_m", F.round(road.flood_speed((F.col("depth_surface_cm") % 45).cast("double"), F.lit(60.0)), 6).alias("max_speed"))


@query("PF12", "select e_id, index_i, index_j, round_even(case when d < 300 and v >= 10 then v else 0.0 end, 1) as max_speed from (select *, (d * d * 0.0009 - d * 0.5529 + 86.9448) / 1.60934 as v from (select e_id, index_i, index_j, cast(depth_surface_cm % 400 as double) as d from {segments} as s) a) b")
def pf12(i: Inputs) -> DataFrame:
    s = i.view("segments")
    return s.select("e_id", "index_i", "index_j", road.legacy_flood_speed((F.col("depth_surface_cm") % 400).cast("double"), F.lit(10.0)).alias("max_speed"))


@query("PF13", f"select e_id, flood, index_i, index_j, length_m, case when {MAJOR} then greatest(depth_cm - case flood when 'surface' then 100 else 200 end, 0) else depth_cm end as depth_cm from {LONG_SQL} l1")
def pf13(i: Inputs) -> DataFrame:
    raised = lambda offset: road.embankment_depth(F.col("depth_cm"), F.col("road_classification"), F.col("trunk_road"), offset)
    depth = F.when(F.col("flood") == "surface", raised(100)).otherwise(raised(200))
    return longer(i).select("e_id", "flood", "index_i", "index_j", "length_m", depth.alias("depth_cm"))


@query("PF14", f"select e_id, flood, index_i, index_j, length_m, level from {LEVELLED_SQL} l2")
def pf14(i: Inputs) -> DataFrame:
    return levelled(i).select("e_id", "flood", "index_i", "index_j", "length_m", "level")


@query("PF15", f"select e_id, flood, index_i, index_j, length_m, case when depth_cm - 100 < 0 then 'no' else level end as level from {LEVELLED_SQL} l2 where depth_cm >= 20")
def pf15(i: Inputs) -> DataFrame:
    kept = levelled(i).filter("depth_cm >= 20")
    return kept.select("e_id", "flood", "index_i", "index_j", "length_m", F.when(F.col("depth_cm") - 100 < 0, "no").otherwise(F.col("level")).alias("level"))


@query("A11", f"select l.e_id, coalesce(w.depth_cm, 0) as depth_cm, coalesce(case w.rank when 4 then 'severe' when 3 then 'extensive' when 2 then 'moderate' when 1 then 'minor' when 0 then 'no' end, 'no') as level from {{links}} as l left join (select e_id, max(depth_cm) as depth_cm, max(case level when 'no' then 0 when 'minor' then 1 when 'moderate' then 2 when 'extensive' then 3 when 'severe' then 4 end) as rank from {LEVELLED_SQL} l2 group by e_id) w on l.e_id = w.e_id")
def a11(i: Inputs) -> DataFrame:
    out = i.view("links").select("e_id").join(D.worst_per_link(levelled(i)), "e_id", "left")
    return out.fillna({"depth_cm": 0, "level": "no"})


@query("A12", "select e_id, index_i, index_j, max(depth_surface_cm) as depth_surface_cm, max(depth_river_cm) as depth_river_cm from {segments} as s group by e_id, index_i, index_j")
def a12(i: Inputs) -> DataFrame:
    return i.view("segments").groupBy("e_id", "index_i", "index_j").agg(F.max("depth_surface_cm").alias("depth_surface_cm"), F.max("depth_river_cm").alias("depth_river_cm"))


FRACTION_SQL = f"""(select q.*, case when depth <= 0 then (select fraction from {CURVES_SQL} where curve = q.curve and depth = 0) when depth >= 8 then (select fraction from {CURVES_SQL} where curve = q.curve and depth = 8)
 else y0 + (y1 - y0) * (depth - d0) / (d1 - d0) end as fraction from (select *, depth_cm / 100.0 as depth, case when not {MAJOR} then case k when 1 then 'C5' else 'C6' end when road_label = 'tunnel' then case k when 1 then 'C1' else 'C2' end else case k when 1 then 'C3' else 'C4' end end as curve
 from {LEVELLED_SQL} l2 cross join (values (1), (2)) as t(k)) q left join (select curve as cc, depth as d0, lead(depth) over (partition by curve order by depth) as d1, fraction as y0, lead(fraction) over (partition by curve order by depth) as y1 from {CURVES_SQL}) p
 on p.cc = q.curve and q.depth >= d0 and q.depth < d1)"""
COST_SQL = f"""(select z.*, size_ * lo as cost_min, size_ * hi as cost_max, (size_ * lo + size_ * hi) / 2 as cost_mean from (select *, case when road_label = 'bridge' then 'bridge_' || flood else road_label end as asset_, case when road_label = 'bridge' then level
 when road_classification = 'Motorway' then 'm_' || case when lanes >= 8 then 'ge8' else 'lt8' end || case when urban = 1 then '_urb' else '_sub' end
 when form_of_way = 'Single Carriageway' then case when road_classification = 'A Road' then 'a' else 'b' end || 'single' || case when urban = 1 then '_urb' else '_sub' end
 else 'abdual_' || case when lanes >= 6 then 'ge6' else 'lt6' end || case when urban = 1 then '_urb' else '_sub' end end as key_,
 case when road_label = 'bridge' then average_width * length_m else length_m * 0.001 * lanes * fraction end as size_ from {FRACTION_SQL} f) z left join {UNITS_SQL} on u.asset = z.asset_ and u.key = z.key_)"""


def fractions(i: Inputs) -> DataFrame:
    rows = D.curves_of_group(levelled(i)).withColumn("depth", F.col("depth_cm") / 100.0)
    return D.damage_fraction(rows, i.spark.createDataFrame(CURVES, "curve string, depth double, fraction double"))


def costs(i: Inputs) -> DataFrame:
    return D.damage_cost(fractions(i), i.spark.createDataFrame(UNITS, "asset string, key string, lo double, hi double"))


@query("M9", f"select e_id, flood, index_i, index_j, length_m, curve, round(fraction, 6) as fraction from {FRACTION_SQL} f")
def m9(i: Inputs) -> DataFrame:
    return fractions(i).select("e_id", "flood", "index_i", "index_j", "length_m", "curve", F.round("fraction", 6).alias("fraction"))


@query("M10", f"select curve, count(*) as n, round(sum(fraction), 3) as total from {FRACTION_SQL} f group by curve")
def m10(i: Inputs) -> DataFrame:
    return fractions(i).groupBy("curve").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("fraction"), 3).alias("total"))


@query("M11", f"select e_id, flood, index_i, index_j, length_m, curve, round(cost_min, 9) as cost_min, round(cost_max, 9) as cost_max, round(cost_mean, 9) as cost_mean from {COST_SQL} c")
def m11(i: Inputs) -> DataFrame:
    return costs(i).select("e_id", "flood", "index_i", "index_j", "length_m", "curve", *[F.round(c, 9).alias(c) for c in ("cost_min", "cost_max", "cost_mean")])


DAMAGE_STATS = ("fraction", "cost_min", "cost_max", "cost_mean")
DAMAGE_COLUMNS = [(f"{c}_{f}_{v}", c, f, v) for c in (f"C{k}" for k in range(1, 7)) for f in ("surface", "river") for v in DAMAGE_STATS]
M12_COLUMNS_SQL = ", ".join(f"max(case when curve = '{c}' and flood = '{f}' then round({v}, 9) end) as {name}" for name, c, f, v in DAMAGE_COLUMNS)


@query("M12", f"select e_id, index_i, index_j, length_m, {M12_COLUMNS_SQL} from {COST_SQL} c group by e_id, index_i, index_j, length_m having max(case when level = 'no' then 0 else 1 end) = 1")
def m12(i: Inputs) -> DataFrame:
    """A row per segment with each curve's and flood's fraction and costs; segments that neither flood damages go."""
    rows = costs(i).groupBy("e_id", "index_i", "index_j", "length_m")
    of = lambda c, f, v: F.max(F.when((F.col("curve") == c) & (F.col("flood") == f), F.round(v, 9)))  # noqa: E731  (a pivot deals the rows twice)
    hit = F.max(F.when(F.col("level") == "no", 0).otherwise(1)).alias("hit")
    return rows.agg(hit, *[of(c, f, v).alias(name) for name, c, f, v in DAMAGE_COLUMNS]).filter("hit = 1").drop("hit")


DAMAGE_SQL = f"(select e_id, flood, curve, sum(coalesce(cost_min, 0)) as cost_min, sum(coalesce(cost_max, 0)) as cost_max from {COST_SQL} c group by e_id, flood, curve)"


@query("A13", f"select e_id, flood, curve, round(cost_min, 8) as cost_min, round(cost_max, 8) as cost_max from {DAMAGE_SQL} d")
def a13(i: Inputs) -> DataFrame:
    return D.link_damage(costs(i)).select("e_id", "flood", "curve", F.round("cost_min", 8).alias("cost_min"), F.round("cost_max", 8).alias("cost_max"))


@query("A14", f"select flood, round(sum(lo), 1) as cost_min, round(sum(hi), 1) as cost_max from (select flood, e_id, max(cost_min) as lo, max(cost_max) as hi from {DAMAGE_SQL} d group by flood, e_id) q group by flood")
def a14(i: Inputs) -> DataFrame:
    return D.event_bounds(D.link_damage(costs(i))).select("flood", F.round("cost_min", 1).alias("cost_min"), F.round("cost_max", 1).alias("cost_max"))


@query("A42", f"select flood, curve, count(*) as links from {DAMAGE_SQL} d where cost_max <> 0 group by flood, curve")
def a42(i: Inputs) -> DataFrame:
    return D.link_damage(costs(i)).filter("cost_max <> 0").groupBy("flood", "curve").agg(F.count(F.lit(1)).alias("links"))


@query("S7", "select e_id, case when road_classification = 'Motorway' then 'm_' || case when lanes >= 8 then 'ge8' else 'lt8' end || case when urban = 1 then '_urb' else '_sub' end when form_of_way = 'Single Carriageway' then case when road_classification = 'A Road' then 'a' else 'b' end || 'single' || case when urban = 1 then '_urb' else '_sub' end else 'abdual_' || case when lanes >= 6 then 'ge6' else 'lt6' end || case when urban = 1 then '_urb' else '_sub' end end as key from {links} as l")
def s7(i: Inputs) -> DataFrame:
    return i.view("links").select("e_id", road.cost_key(F.col("road_classification"), F.col("form_of_way"), F.col("urban"), F.col("lanes")).alias("key"))


@query("J3", "select coalesce(a.e_id, b.e_id) as e_id, coalesce(a.index_i, b.index_i) as index_i, a.depth as surface, b.depth as river from (select e_id, index_i, max(depth_surface_cm) as depth from {segments} as s where depth_surface_cm > 300 group by e_id, index_i) a full join (select e_id, index_i, max(depth_river_cm) as depth from {segments} as s where depth_river_cm > 400 group by e_id, index_i) b on a.e_id = b.e_id and a.index_i = b.index_i")
def j3(i: Inputs) -> DataFrame:
    s = i.view("segments")
    of = lambda c, least, name: s.filter(F.col(c) > least).groupBy("e_id", "index_i").agg(F.max(c).alias(name))
    return of("depth_surface_cm", 300, "surface").join(of("depth_river_cm", 400, "river"), ["e_id", "index_i"], "full")


@query("M14", f"select w.e_id, s.scenario, round(l.lanes * 1000 * case w.rank when 4 then 0.0 when 3 then 0.1 else 0.5 end * s.scenario / 6.0, 6) as capacity from (select e_id, max(case level when 'no' then 0 when 'minor' then 1 when 'moderate' then 2 when 'extensive' then 3 when 'severe' then 4 end) as rank from {LEVELLED_SQL} l2 group by e_id) w join {{links}} as l on w.e_id = l.e_id cross join (select unnest(range(7)) as scenario) s where w.rank >= 2")
def m14(i: Inputs) -> DataFrame:
    rates = i.spark.createDataFrame([("severe", 0.0), ("extensive", 0.1), ("moderate", 0.5)], "level string, rate double")
    hit = D.worst_per_link(levelled(i)).join(rates, "level").join(i.view("links").select("e_id", "lanes"), "e_id")
    hit = hit.withColumn("scenario", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return hit.select("e_id", "scenario", F.round(F.col("lanes") * 1000 * F.col("rate") * F.col("scenario") / 6.0, 6).alias("capacity"))


@query("M15", "select e_id, day, max(case when day = 0 then 0 else least(day, case when e_id % 20 = 0 then 5 else 2 end) * lanes * 10 end) over (partition by e_id order by day) as capacity from {links} as l cross join (select unnest(range(6)) as day) d")
def m15(i: Inputs) -> DataFrame:
    hit = i.view("links").withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    rate = F.least("day", F.when(F.col("e_id") % 20 == 0, 5).otherwise(2)) * F.col("lanes") * 10
    so_far = Window.partitionBy("e_id").orderBy("day")
    return hit.select("e_id", "day", F.max(F.when(F.col("day") == 0, 0).otherwise(rate)).over(so_far).alias("capacity"))


