"""Network-shaped views over the driver's tables. One SQL text serves Spark and the SQL twin alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Number of network nodes: a fifth of the parts.
NODES = "(select cast(floor(count(*) / 5.0) as bigint) from part)"

VIEWS: dict[str, str] = {
    "links": f"""select p_partkey as e_id, p_partkey % {NODES} as from_id, (p_partkey * 7 + p_size * 3 + 1) % {NODES} as to_id,
 case p_type when 'MEDIUM' then 'Motorway' when 'LARGE' then 'Motorway' when 'ECONOMY' then 'B Road' when 'SMALL' then 'B Road' else 'A Road' end as road_classification,
 case when p_size % 2 = 0 then 'Single Carriageway' else 'Dual Carriageway' end as form_of_way,
 p_size % 3 = 0 as trunk_road, case when p_size % 5 = 0 then 1 else 0 end as urban, 1 + p_size % 8 as lanes,
 cast(p_retailprice as double) as length_m, case when p_brand = 'Brand#1' then cast(8 as double) else cast(0 as double) end as average_toll_cost,
 case p_partkey % 20 when 0 then 'bridge' when 1 then 'tunnel' else 'road' end as road_label,
 cast(6 + p_size % 10 as double) as average_width from part""",
    "steps": """select l_orderkey as od_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as bigint) as pos, l_partkey as e_id from lineitem""",
    "od": f"""select o_orderkey as od_id, o_custkey % {NODES} as origin_node, (o_custkey * 13 + o_orderkey) % {NODES} as destination_node, 1 + o_orderkey % 9 as flow from orders""",
    "segments": """select l_partkey as e_id, l_suppkey as index_i, l_linenumber as index_j, cast(l_quantity as bigint) as length_m,
 max(cast(round(l_discount * 6000) as bigint)) as depth_surface_cm, max(cast(round(l_tax * 10000) as bigint)) as depth_river_cm from lineitem group by l_partkey, l_suppkey, l_linenumber, cast(l_quantity as bigint)""",
    "stops": """select user_id as train_id, cast(row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as bigint) as pos, cast(ts as date) as run_date, event_id % 40 as station, case when event_type in ('error') then 'P' else 'S' end as stop,
 cast(hour(ts) * 3600 + minute(ts) * 60 as bigint) as t_sec from events""",
    "zones": """select n_nationkey as zone_id, n_regionkey as region_id, count(c_custkey) as population from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_regionkey""",
    "series": """select o_custkey % 50 as zone_id, cast(year(o_orderdate) as bigint) as yr, count(*) as value from orders group by o_custkey % 50, year(o_orderdate)""",
    "points": """select c_custkey as zone_id, cast((c_custkey * 7919) % 10007 as double) as x, cast((c_custkey * 104729) % 9973 as double) as y, c_nationkey as owner from customer""",
    "sites": """select s_suppkey as node_id, cast((s_suppkey * 6151) % 10007 as double) as x, cast((s_suppkey * 3571) % 9973 as double) as y, s_nationkey as kind from supplier""",
    "trips": """select c_nationkey as origin, s_nationkey as destination, sum(l_quantity) as flow, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by c_nationkey, s_nationkey""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, over the tables that its text names."""
    text = VIEWS[name]
    used = [t for t in TABLES if f" {t}" in text]
    for t in used:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def expand(sql: str) -> str:
    """SQL with {view} replaced by the view's text."""
    for name, text in VIEWS.items():
        sql = sql.replace("{" + name + "}", f"({text})")
    return sql
