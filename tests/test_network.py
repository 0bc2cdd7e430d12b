"""Worked examples, invariants, and every registered network query against its SQL twin."""

import random
import re
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayflux.functions import road
from wayflux.functions import text as S
from wayflux.operators import assign, cells, clusters, damage, demand, links, nearest, paths, rail, recovery, routing, spatial, tables
from wayflux.operators.graph import connected_components
from wayflux.plans.fixtures import expand
from wayflux.plans.registry import ORACLE_SQL, QUERIES, Inputs
from wayflux.plans.disruption import levelled  # isort: skip  (it registers itself)
from wayflux.plans.scenarios import event
from wayflux.sources import io

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found, names):
    place = [names.index(c) for c in sorted(names)]
    return sorted(re.sub(r"Decimal\('(-?[0-9.]+)'\)", r"\1", str(tuple(r[i] for i in place))).replace("-0.0", "0.0") for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), [d[0] for d in want.description])


#: Run by the tests of their values below, or (G12, G13) under an older name of the same query.
VALUED = {"G1", "G2", "G4", "G4b", "G12", "G12_rerouting", "G13", "G13_rail_flow", "G14", "PF20"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - VALUED))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_flow_on_edges_example(spark):
    trips = spark.createDataFrame([("n1", ["e1", "e2"], 10), ("n1", ["e1", "e3"], 20), ("n2", [], 5), ("n3", None, 5)], "o string, path array<string>, flow long")
    assert dict(map(tuple, paths.flow_on_edges(trips).collect())) == {"e1": 30, "e2": 10, "e3": 20}
    twice = spark.createDataFrame([(["e1", "e1"], 4)], "path array<string>, flow long")
    assert paths.flow_on_edges(twice).first()["flow"] == 8


def test_path_explosion_example(spark):
    trip = spark.createDataFrame([("A", "B", 100, [1, 5, 9])], "o string, d string, flow long, path array<long>")
    assert [(r.e_id, r.pos) for r in paths.explode_paths(trip).collect()] == [(1, 1), (5, 2), (9, 3)]


def test_roll_up_and_adjustment_examples(spark):
    steps = spark.createDataFrame([(1, k + 1, k) for k in range(3)], "od_id long, pos int, e_id long")
    edges = spark.createDataFrame([(0, 10.0, 0.5, 2.0, 5.0, 500), (1, 20.0, 1.0, 0.0, 3.0, 300), (2, 15.0, 0.8, 1.0, 4.0, 200)], "e_id long, fuel double, time double, toll double, miles double, capacity long")
    found = paths.path_costs(steps, edges, "od_id", ["fuel", "time", "toll", "miles"]).first()
    assert found["path"] == [0, 1, 2] and (found["fuel"], round(found["time"], 9), found["toll"], found["miles"]) == (45, 2.3, 3, 12)
    od = spark.createDataFrame([(1, 100)], "od_id long, flow long")
    flow = paths.pair_edge_flow(steps, od)
    assert paths.adjustment_ratio(flow, edges).first()["ratio"] == 1.0
    tight = edges.withColumn("capacity", F.when(F.col("e_id") == 1, 25).otherwise(F.col("capacity")))
    assert paths.adjusted(od, paths.adjustment_ratio(flow, tight)).first()["assigned"] == 25.0


def test_minutes_follow_from_length_and_speed(spark):
    # At a constant speed, minutes times speed is sixty times the miles, on every link.
    for r in QUERIES["PF27"](spark, SF).collect():
        assert r.miles > 0 and r.minutes >= r.free_minutes > 0
    ways = spark.createDataFrame([(1, 1609.344), (2, 16093.44)], "e_id long, length_m double")
    assert [round(r.miles, 3) for r in ways.selectExpr(f"length_m * {road.METRE_TO_MILE} as miles").collect()] == [1.0, 10.0]


def test_damage_levels_at_band_ends(spark):
    depths = [None, -1.0, 0.0, 49.9, 50.0, 99.9, 100.0, 200.0, 600.0]
    at = spark.createDataFrame([(d,) for d in depths], "d double")
    level = lambda flood, group: [r[0] for r in at.select(road.damage_level(flood, F.col("d"), F.lit(group))).collect()]
    assert level("river", "other") == [None, "no", "no", "minor", "moderate", "moderate", "moderate", "extensive", "severe"]
    assert level("surface", "tunnel") == [None, "no", "no", "no", "minor", "minor", "moderate", "extensive", "severe"]


def test_rows_are_not_dealt_by_curve_asset_or_kind(spark):
    """A few keys would gather all rows in as few tasks, whatever the size below which Spark broadcasts by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("M9", "A42", "M12", "M18"):
            plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"SortMergeJoin \[e_id", plan) and not re.search(r"SortMergeJoin \[(curve|asset|level)", plan), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_curves_are_held_outside_their_knots(spark):
    curves = spark.createDataFrame([("C1", 0.5, 0.1), ("C1", 1.0, 0.3), ("C1", 2.0, 0.4)], "curve string, depth double, fraction double")
    at = spark.createDataFrame([("C1", d) for d in (-1.0, 0.5, 0.75, 1.0, 9.0)], "curve string, depth double")
    found = {r.depth: round(r.fraction, 9) for r in damage.damage_fraction(at, curves).collect()}
    assert found == {-1.0: 0.1, 0.5: 0.1, 0.75: 0.2, 1.0: 0.3, 9.0: 0.4}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    label = dict(map(tuple, found.collect()))
    assert all(label[k] == 0 for k in range(61)) and all(label[1000 + k] == 1000 for k in range(200)) and len(label) == 261
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_least_cost_paths(spark):
    net = [(1, "a", "b", 1), (2, "b", "c", 1), (3, "a", "c", 5), (4, "c", "d", 1), (5, "x", "y", 1), (6, "a", "b", 1)]
    table = spark.createDataFrame(net, "e_id long, from_id string, to_id string, weight long")
    od = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("a", "y")], "origin_node string, destination_node string")
    found = {(r.origin_node, r.destination_node): (r.cost, r.path) for r in routing.least_cost_paths(table, od).collect()}
    assert found == {("a", "d"): (3, [1, 2, 4]), ("d", "a"): (3, [4, 2, 1]), ("a", "a"): (0, []), ("a", "y"): (None, [])}
    near = {r.node for r in routing.reachable(table, od.select(F.col("origin_node").alias("source"), F.lit(2).alias("cutoff")).filter("source = 'a'")).collect()}
    assert near == {"b", "c"}


def test_fitting_meets_both_margins(spark):
    prior = spark.createDataFrame([(o, d, 1.0 + o * d) for o in range(4) for d in range(3)], "origin int, destination int, flow double")
    rows_ = spark.createDataFrame([(o, 10.0 + o) for o in range(4)], "origin int, target double")
    columns = spark.createDataFrame([(0, 20.0), (1, 16.0), (2, 10.0)], "destination int, target double")
    flow = demand.fitted(prior, rows_, columns).collect()
    for o in range(4):
        assert abs(sum(r.flow for r in flow if r.origin == o) - 10 - o) < 1e-4
    for d, t in ((0, 20), (1, 16), (2, 10)):
        assert abs(sum(r.flow for r in flow if r.destination == d) - t) < 1e-4


def test_nearest_of_far_and_equal_sites(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 1e6), (3, 50.0, 0.0), (3, 50.0, 0.0), (4, None, 1.0), (None, 1.0, 1.0)], "zone_id long, x double, y double")
    sites = spark.createDataFrame([(7, 100.0, 0.0), (5, 0.0, 0.0), (9, 0.0, 1.0), (6, 0.0, 0.0), (1, None, 0.0), (2, float("nan"), 0.0)], "node_id long, x double, y double")
    found = {r.zone_id: r.node_id for r in nearest.pairs_nearest(points, sites).collect()}
    assert found == {1: 5, 2: 7, 3: 5, None: 9}
    assert nearest.pairs_nearest(points, sites.filter("false")).count() == 0
    assert nearest.pairs_nearest(points.filter("false"), sites).count() == 0


def nearest_by_hand(points, sites):
    return {p: min(((x - u) ** 2 + (y - v) ** 2, s) for s, u, v in sites)[1] for p, x, y in points}


@pytest.mark.parametrize("far", [0.0, 1e5])
def test_nearest_over_a_deep_tree(spark, monkeypatch, far):
    """Small nodes, no level broadcast but the root: crowded sites, copies, points near and all far from all sites."""
    monkeypatch.setattr(nearest, "FAN", 4)
    monkeypatch.setattr(nearest, "SMALL", 1)
    rng = random.Random(11)
    sites = [(s, rng.gauss(0, 1) if s % 3 else float(s % 20), rng.gauss(0, 1) if s % 3 else float(s % 7)) for s in range(400)]
    points = [(p, far + rng.randrange(-20, 20), far / 2 + rng.randrange(-20, 20)) for p in range(200)]
    table = spark.createDataFrame(points, "zone_id long, x double, y double"), spark.createDataFrame(sites, "node_id long, x double, y double")
    assert {r.zone_id: r.node_id for r in nearest.pairs_nearest(*table).collect()} == nearest_by_hand(points, sites)


def test_first_of_many_polygons_without_meeting_all(spark):
    rng = random.Random(3)
    shapes = [[(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(3)] for _ in range(100)]
    for _ in range(200):
        x, y, w = rng.uniform(-60, 30), rng.uniform(-60, 30), rng.choice([10, 25, 40])
        shapes.append([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])
    rng.shuffle(shapes)
    rings = [(k, [{"x": float(x), "y": float(y)} for x, y in [*s, s[0]]]) for k, s in enumerate(shapes)]
    places = [(k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(300)] + [(300 + k, x, y) for k, (x, y) in enumerate(s[0] for s in shapes[:50])]
    polygons = spark.createDataFrame(rings, "node_id long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame(places, "zone_id long, x double, y double")
    least = lambda f: {r[0]: r[1] for r in f.groupBy("zone_id").agg(F.min("node_id")).collect()}
    every, few = spatial.points_in_polygons(points, polygons, 8.0, "node_id"), spatial.first_polygons(points, polygons, 8.0, "node_id")
    assert least(few) == least(every) and few.count() < every.count() / 3


def test_far_points_enter_few_nodes(spark):
    """All points far from 100,000 sites: a bounded number of leaves each, and no salted key above its share."""
    sites = spark.range(100_000).select(F.col("id").alias("node_id"), (F.pmod(F.xxhash64("id"), F.lit(10007)) / 10).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9973)) / 10).alias("y"))
    points = spark.range(2000).select(F.col("id").alias("zone_id"), (F.lit(1e6) + F.col("id") % 50).alias("x"), (F.col("id") / 50).alias("y"))
    seen = []
    plain = nearest._entered

    def watched(at, nodes, n):
        seen.append((n, at.count(), plain(at, nodes, n)))
        return seen[-1][2]

    nearest._entered = watched
    try:
        found = nearest.pairs_nearest(points, sites).collect()
    finally:
        nearest._entered = plain
    assert len(found) == 2000 and seen[-1][0] > nearest.SMALL and seen[-1][1] <= 2000 * 8
    keys = seen[-1][2].groupBy("node", "salt").count().agg(F.max("count")).first()[0]
    assert keys <= 3 * seen[-1][1] // nearest.SHARES + 8
    some = [(r.zone_id, 1e6 + r.zone_id % 50, r.zone_id / 50) for r in found[:40]]
    assert {r.zone_id: r.node_id for r in found[:40]} == nearest_by_hand(some, [tuple(s) for s in sites.collect()])


def project(line, x, y):
    """Squared distance and running length of the nearest place on a line, by trying all segments."""
    best, run = None, 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        gap, size = (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2, (dx * dx + dy * dy) ** 0.5
        best = min(best or (gap, run + t * size), (gap, run + t * size))
        run += size
    return best, run


def test_positions_on_the_nearest_bent_line(spark, monkeypatch):
    monkeypatch.setattr(nearest, "FAN", 4)
    monkeypatch.setattr(nearest, "SMALL", 1)
    rng = random.Random(5)
    bent = {k: [(rng.uniform(0, 500), rng.uniform(0, 500)) for _ in range(rng.randrange(2, 9))] for k in range(40)}
    bent[99] = [(0.0, 0.0), (10_000.0, 0.0), (10_000.0, 9_000.0)]  # one line much longer than the others
    points = [(p, rng.uniform(-200, 9000) if p % 4 == 0 else rng.uniform(0, 500), rng.uniform(-200, 700)) for p in range(150)]
    kind = "line_id long, line array<struct<x:double,y:double>>, start double, stop double"
    empty = [(100, [], 0.0, 1.0), (101, None, 0.0, 1.0), (102, [(None, 1.0)], 0.0, 1.0)]
    table = spark.createDataFrame([(k, line, 10.0 * k, 10.0 * k + 7) for k, line in bent.items()] + empty, kind)
    found = nearest.positions_on_nearest(spark.createDataFrame(points, "zone_id long, x double, y double"), table).collect()
    assert len(found) == 150
    for r in found:
        _, x, y = points[r.zone_id]
        (gap, along), total = project(bent[r.line_id], x, y)
        assert gap <= min(project(line, x, y)[0][0] for line in bent.values()) + 1e-9
        assert abs(r.distance - gap**0.5) < 1e-6 and abs(r.position - (10 * r.line_id + 7 * along / total)) < 1e-6


def test_position_ties_and_lines_without_length(spark):
    kind = "line_id long, line array<struct<x:double,y:double>>, start double, stop double"
    table = spark.createDataFrame([(4, [(0.0, 0.0), (10.0, 0.0)], 0.0, 100.0), (3, [(10.0, 0.0), (10.0, 5.0)], 50.0, 60.0), (8, [(-50.0, 0.0)], 5.0, 9.0)], kind)
    points = spark.createDataFrame([(1, 12.0, -3.0), (2, -60.0, 0.0), (3, 2.0, 1.0)], "zone_id long, x double, y double")
    found = {r.zone_id: (r.line_id, r.position) for r in nearest.positions_on_nearest(points, table).collect()}
    assert found == {1: (3, 50.0), 2: (8, 5.0), 3: (4, 20.0)}


def test_clock_and_list_text(spark):
    one = spark.createDataFrame([("[a, 'b']", 86000, 100)], "t string, a int, b int")
    assert one.select(S.any_list(F.col("t")), S.seconds_between(F.col("a"), F.col("b"))).first()[:] == (["a", "b"], 500)
    assert spark.createDataFrame([(None,)], "t string").select(S.any_list(F.col("t"))).first()[0] == []


def test_sample_and_scaling(spark):
    wide = spark.range(200_000).withColumn("v", F.lit(3.0))
    picked = links.systematic_sample(wide, "id", 1000)
    assert [r.id for r in picked.orderBy("id").limit(3).collect()] == [0, 1000, 2000] and picked.count() == 200
    assert links.min_max_scaled(wide, ["v"]).first()["v"] == 3.0


def test_stop_pairs_and_empty_lists(spark):
    stops = spark.createDataFrame([(1, 1, "d", "A", "S", 10), (1, 2, "d", "B", "P", 20), (1, 3, "d", "C", "S", 86000), (1, 4, "d", "A", "S", 5)], "train_id int, pos int, run_date string, station string, stop string, t_sec int")
    assert [(r.from_station, r.to_station, r.seconds) for r in rail.stop_times(stops).orderBy("pos").collect()] == [("A", "C", 85990), ("C", "A", 405)]
    assert {tuple(r) for r in rail.downstream(stops).collect()} == {("A", "C"), ("C", "A")}
    od = spark.createDataFrame([("A", "C"), ("A", "B")], "origin string, destination string")
    assert {(r.destination, tuple(r.trains)) for r in rail.trains_between(stops, od).collect()} == {("C", (1,)), ("B", ())}


def test_parameters_and_provenance(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"key": "M", "value": 70}\n{"key": "B", "value": 50.5}\n')
    assert dict(map(tuple, io.read_parameters(spark, str(tmp_path / "p.json")).collect())) == {"M": 70.0, "B": 50.5}
    for name in ("a", "b"):
        io.write_parquet(spark.range(3), str(tmp_path / name))
    assert io.read_with_source(spark, str(tmp_path / "a"), str(tmp_path / "b")).select("source_file").distinct().count() >= 2
    (tmp_path / "b" / "part-broken.parquet").write_bytes(b"PAR1 this is no table PAR1")
    both = io.read_with_source(spark.newSession(), str(tmp_path / "a"), str(tmp_path / "b"))
    assert both.count() == 6 and "part-broken.parquet" in {r.file for r in io.passed_over(both).collect()}


def cheapest(links, source):
    """Costs from a source by trying every link as often as there are links."""
    cost = {source: 0}
    for _ in range(len(links)):
        for _, a, b, w in links:
            for u, v in ((a, b), (b, a)):
                if u in cost and cost[u] + w < cost.get(v, float("inf")):
                    cost[v] = cost[u] + w
    return cost


def network_of(spark):
    links = [tuple(r) for r in Inputs(spark, SF).view("links").selectExpr("e_id", "from_id", "to_id", "cast(round(length_m) as bigint)").collect()]
    return links, {n: cheapest(links, n) for n in {x[1] for x in links} | {x[2] for x in links}}


def test_every_pair_is_routed_at_least_cost(spark):
    links, cost = network_of(spark)
    ends, weight = {x[0]: set(x[1:3]) for x in links}, {x[0]: x[3] for x in links}
    want = {tuple(r) for r in Inputs(spark, SF).view("od").select("origin_node", "destination_node").distinct().collect()}
    found = QUERIES["G1"](spark, SF).collect()
    assert {(r.origin_node, r.destination_node) for r in found} == want and len(found) == len(want)
    for r in found:
        at = r.origin_node
        for e in r.path:
            assert at in ends[e]
            at = next(iter(ends[e] - {at}))
        assert at == r.destination_node and r.cost == sum(weight[e] for e in r.path) == cost[r.origin_node][r.destination_node]


def test_every_node_reaches_its_neighbourhood(spark):
    _, cost = network_of(spark)
    want = {(s, n): c for s, to in cost.items() for n, c in to.items() if n != s and c <= 2500 + s % 4 * 500}
    assert {(r.source, r.node): r.cost for r in QUERIES["G2"](spark, SF).collect()} == want


def test_reach_carries_costs_only(spark):
    links_ = spark.createDataFrame([(1, 0, 1, 3), (2, 0, 1, 2), (3, 1, 2, 2), (4, 0, 2, 5), (5, 2, 3, 1), (6, 3, 3, 0), (7, 0, 3, None)], "e_id long, from_id long, to_id long, weight long")
    found = routing.reachable(links_, spark.createDataFrame([(0, 4), (0, 4), (3, 1), (9, 5), (None, 5)], "source long, cutoff long"))
    assert sorted(found.columns) == ["cost", "cutoff", "node", "source"]  # no hops, edges or nodes before in the rows that each round deals
    assert sorted(map(tuple, found.select("source", "node", "cost").collect())) == [(0, 1, 2), (0, 2, 4), (3, 2, 1)]


def test_search_and_relaxation_agree(spark):
    k = Inputs(spark, SF).view("links").selectExpr("e_id", "from_id", "to_id", "lanes as weight")  # many equal ways
    od = spark.createDataFrame([(a, b) for a in (0, 7, 900, None) for b in (*range(40), 901, None)], "origin_node long, destination_node long")
    rows_ = lambda f: sorted(map(str, f.select("origin_node", "destination_node", "cost", "path").collect()))
    assert rows_(routing.least_cost_paths(k, od)) == rows_(routing.walked_paths(k, od))


def test_assignment_in_competition(spark):
    # a-b-c: both pairs share link 1 (capacity 6); a longer way round takes what is left of a-c only.
    net = [(1, "a", "b", 1, 6.0, 1.0, 2.0, 0.5), (2, "b", "c", 1, 100.0, 1.0, 2.0, 0.0), (3, "a", "d", 5, 4.0, 4.0, 1.0, 0.0), (4, "d", "c", 5, 100.0, 4.0, 1.0, 0.0)]
    table = spark.createDataFrame(net, "e_id long, from_id string, to_id string, weight long, acc_capacity double, time_cost double, operating_cost double, toll_cost double")
    table = table.selectExpr("*", "acc_capacity as current_capacity", "0.0D as acc_flow", "'M' as combined_label", "60.0D as initial_flow_speeds", "10.0D as min_flow_speeds", "1200.0D as breakpoint_flows")
    od = spark.createDataFrame([("a", "b", 6), ("a", "c", 3), ("a", "c", 3), ("a", "z", 2)], "origin_node string, destination_node string, flow long")
    paths_, isolated, _ = assign.assign(table, od)
    found = {(r.origin_node, r.destination_node, tuple(r.path)): (round(r.flow, 6), r.time_cost, r.operating_cost, r.toll_cost) for r in paths_.collect()}
    # Round 1: 12 want link 1, half of each goes. Round 2: a-d-c has 4 for the 3 + 3 left (a-b goes on from c by link 2).
    assert found == {("a", "b", (1,)): (3, 1, 2, 0.5), ("a", "c", (1, 2)): (3, 2, 4, 0.5), ("a", "c", (3, 4)): (2, 8, 2, 0), ("a", "b", (3, 4, 2)): (2, 9, 4, 0)}
    assert {(r.origin_node, r.destination_node): round(r.flow, 6) for r in isolated.collect()} == {("a", "z"): 2, ("a", "b"): 1, ("a", "c"): 1}
    total = assign.total_costs(paths_).first()
    assert [round(x, 6) for x in total] == [3 + 6 + 16 + 18, 6 + 12 + 4 + 8, 1.5 + 1.5, 43 + 30 + 3]


def test_assignment_covers_the_whole_table(spark):
    od = Inputs(spark, SF).view("od")
    flow = od.agg({"flow": "sum"}).first()[0]
    found = QUERIES["G4b"](spark, SF).cache()
    assert abs(found.agg({"flow": "sum"}).first()[0] - flow) < 1e-3
    assert found.select("origin_node", "destination_node").distinct().count() == od.select("origin_node", "destination_node").distinct().count()
    one = QUERIES["G4"](spark, SF).cache()
    assert one.select("origin_node").distinct().count() == od.select("origin_node").distinct().count() and one.filter("assigned > flow").isEmpty()
    total = one.selectExpr("sum(assigned * time_cost)", "sum(assigned * operating_cost)", "sum(assigned * toll_cost)").first()
    assert all(abs(a - b) < 1e-5 * max(b, 1) for a, b in zip(total, one.select("total_time_cost", "total_operating_cost", "total_toll_cost").first()))


def test_rerouting_costs_by_scenario(spark):
    # Two ways from a to c: by link 1 (1 km), or by links 2 and 3 (1 km each, with toll 3 on link 2).
    net = [(1, "a", "c", 1000.0, 0.0), (2, "a", "b", 1000.0, 3.0), (3, "b", "c", 1000.0, 0.0)]
    table = spark.createDataFrame(net, "e_id long, from_id string, to_id string, length_m double, average_toll_cost double")
    table = table.selectExpr("*", "100.0D as acc_capacity", "100.0D as current_capacity", "if(e_id = 1, 10.0D, 0.0D) as acc_flow", "50.0D as acc_speed", "'M' as combined_label", "50.0D as initial_flow_speeds", "10.0D as min_flow_speeds", "1200.0D as breakpoint_flows")
    trips = spark.createDataFrame([(1, "a", "c", [1], 10.0)], "od_id long, origin_node string, destination_node string, path array<long>, flow double")
    capacity = spark.createDataFrame([(0, 1, 0.0), (1, 1, 4.0), (2, 1, 50.0), (3, 1, 0.0), (3, 3, 0.0)], "scenario int, e_id long, capacity double")
    one = links.with_costs(table, "car").filter("e_id = 1").first()
    found = {r.scenario: r for r in assign.rerouting_costs(table, trips, capacity).collect()}
    at = lambda k, *names: [round(found[k][n], 6) for n in names]
    assert sorted(found) == [0, 1, 2, 3]
    assert at(0, "change_flow", "trips", "isolated") == [10, 1, 0] and at(1, "change_flow", "trips") == [6, 1] and at(2, "change_flow", "trips", "rerouting_cost") == [0, 0, 0]
    for k, n in ((0, 10), (3, 10), (1, 6)):
        assert at(k, "pre_time_cost", "pre_operating_cost", "pre_toll_cost") == [round(n * one.time_cost, 6), round(n * one.operating_cost, 6), 0]
    # Closed: all ten go round, twice the length and the toll.
    assert at(0, "rer_time_cost", "rer_operating_cost", "rer_toll_cost") == [round(10 * one.time_cost, 6), round(10 * one.operating_cost, 6), 30]
    assert at(0, "rerouting_cost") == [round(10 * (one.time_cost + one.operating_cost) + 30, 6)]
    # Freed capacity comes back, so the six find room where they were; without any way they are isolated.
    assert at(1, "rerouting_cost", "isolated") == [0, 0] and at(3, "post_cost", "isolated") == [0, 10]


def test_rerouting_with_speed_limits_and_flow_by_link(spark):
    # As above; in scenario 0 link 1 may still be used at 5 mph, in scenario 1 at any speed; link 9 is nowhere changed.
    net = [(1, "a", "c", 1000.0, 0.0), (2, "a", "b", 1000.0, 3.0), (3, "b", "c", 1000.0, 0.0), (9, "x", "y", 1000.0, 0.0)]
    table = spark.createDataFrame(net, "e_id long, from_id string, to_id string, length_m double, average_toll_cost double")
    table = table.selectExpr("*", "100.0D as acc_capacity", "100.0D as current_capacity", "if(e_id = 1, 10.0D, 0.0D) as acc_flow", "50.0D as acc_speed", "'M' as combined_label", "50.0D as initial_flow_speeds", "1.0D as min_flow_speeds", "1200.0D as breakpoint_flows")
    trips = spark.createDataFrame([(1, "a", "c", [1], 10.0)], "od_id long, origin_node string, destination_node string, path array<long>, flow double")
    capacity = spark.createDataFrame([("x", 1, 4.0), ("x", 1, 7.0), ("y", 1, 4.0)], "scenario string, e_id long, capacity double")
    limits = spark.createDataFrame([("x", 1, 5.0), ("x", 1, 8.0), ("y", 2, 1.0)], "scenario string, e_id long, max_speed double")
    costs, flow = assign.rerouting(table, trips, capacity, limits=limits)
    one = links.with_costs(table, "car").filter("e_id = 1").first()
    slow = links.with_costs(table.withColumn("acc_speed", F.lit(5.0)), "car").filter("e_id = 1").first()
    found = {r.scenario: r for r in costs.collect()}
    change = {(r.scenario, r.e_id): (r.acc_flow, r.change_flow) for r in flow.collect()}
    assert len(change) == 8 and change["x", 9] == change["y", 9] == (0, 0) and change["y", 1] == (10, 0) and change["y", 2] == (0, 0)
    around = slow.time_cost + slow.operating_cost > 2 * (one.time_cost + one.operating_cost) + 3
    assert change["x", 1] == ((4, -6) if around else (10, 0)) and change["x", 3] == ((6, 6) if around else (0, 0))
    extra = one.time_cost + one.operating_cost + 3 if around else slow.time_cost + slow.operating_cost - one.time_cost - one.operating_cost
    assert found["x"].change_flow == found["y"].change_flow == 6 and abs(found["x"].rerouting_cost - 6 * extra) < 1e-6 and found["y"].rerouting_cost == 0
    nothing = assign.rerouting(table, trips, capacity.filter("false"), limits=limits.filter("false"))
    assert nothing[0].count() == nothing[1].count() == 0


def counted(spark, frame, seen):
    """``frame``, whose rows are counted in ``seen`` each time they are made."""
    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(passed, frame.schema)


def test_rerouting_makes_links_once_and_trips_twice(spark):
    """A plan that makes its tables again for each use, and broadcasts them, fills the driver."""
    state, trips, capacity, limits = event(Inputs(spark, SF))
    links_, trips_ = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    costs, flow = assign.rerouting(counted(spark, state, links_), counted(spark, trips, trips_), capacity, limits=limits)
    assert costs.count() == 3 and flow.count() == 3 * state.count()
    assert links_.value == state.count() and trips_.value <= 2 * trips.count()


def test_layers_are_networks_of_their_own(spark):
    k = Inputs(spark, SF).view("links").selectExpr("e_id", "from_id", "to_id", "cast(round(length_m) as bigint) as weight")
    both = k.withColumn("layer", F.lit(0).cast("long")).unionByName(k.filter("e_id % 3 > 0").withColumn("layer", F.lit(5).cast("long")))
    od = Inputs(spark, SF).view("od").select("origin_node", "destination_node").distinct()
    asked = od.withColumn("layer", F.lit(0).cast("long")).unionByName(od.withColumn("layer", F.lit(5).cast("long")))
    rows_ = lambda f: sorted(map(str, f.select("origin_node", "destination_node", "cost", "path").collect()))
    found = routing.least_cost_paths(both, asked)
    assert rows_(found.filter("layer = 0")) == rows_(routing.least_cost_paths(k, od)) and rows_(found.filter("layer = 5")) == rows_(routing.least_cost_paths(k.filter("e_id % 3 > 0"), od))


def estimate(frame):
    """Spark's estimate of the bytes of a frame."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    chain = spark.range(100).select(F.lit(0).cast("long").alias("layer"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1).alias("weight"), F.col("id").alias("e_id"))
    assert estimate(cells.node_cells(chain, 8)) < 2**64


def test_many_cells_give_the_same_paths(spark):
    """A long chain, a hub, small components and equal ways, in cells of a few nodes."""
    net = [(k, k, k + 1, 1) for k in range(16)] + [(100 + k, 7, 200 + k, 1 + k % 3) for k in range(14)] + [(300 + k, 200 + k, 201 + k, 1) for k in range(13)]
    net += [(400, 900, 901, 2), (401, 910, 911, 2), (402, 0, 16, 16), (403, 3, 3, 1), (404, 5, 9, None)]
    k = spark.createDataFrame(net, "e_id long, from_id long, to_id long, weight long")
    od = spark.createDataFrame([(a, b) for a in (0, 16, 7, 213, 900, 999, None) for b in (*range(0, 17, 3), 203, 213, 901, 911, 999, None)], "origin_node long, destination_node long")
    nodes = cells.node_cells(routing.directed(k), 8)
    sizes = [r["count"] for r in nodes.groupBy("cell").count().collect()]
    assert sum(sizes) == nodes.select("node").distinct().count() and len(sizes) > 3 and max(sizes) <= 16
    rows_ = lambda f: sorted(map(str, f.select("origin_node", "destination_node", "cost", "path").collect()))
    found = routing.least_cost_paths(k, od, nodes)
    assert rows_(found) == rows_(routing.least_cost_paths(k, od))
    cost = {n: cheapest([x for x in net if x[3]], n) for n in (0, 16, 7, 213, 900, 999)}
    assert all(r.cost == cost.get(r.origin_node, {}).get(r.destination_node) for r in found.collect())
    assert routing.least_cost_paths(k.filter("false"), od).filter("cost is not null").collect()[0].path == [] and routing.least_cost_paths(k, od.filter("false")).count() == 0


def test_a_network_that_a_task_can_hold_is_one_cell(spark):
    """Neither rounds in the driver nor labels on disk: 5001 nodes in a row, every 50th with a short cut to the next such."""
    row = spark.range(5000).selectExpr("id as e_id", "id as from_id", "id + 1 as to_id", "1L as weight")
    k = row.unionByName(spark.range(0, 5000, 50).selectExpr("id + 10000 as e_id", "id as from_id", "id + 50 as to_id", "49L as weight"))
    nodes = cells.node_cells(routing.directed(k))
    assert nodes.select("cell").distinct().count() == 1 and nodes.select("at").distinct().count() == 5001
    od = spark.createDataFrame([(0, d) for d in (0, 1, 49, 50, 75, 99, 4999, 5000, 6000)] + [(5000, 10)], "origin_node long, destination_node long")
    found = {(r.origin_node, r.destination_node): (r.cost, r.path) for r in routing.least_cost_paths(k, od).collect()}
    for (a, d), (cost, path) in found.items():
        gap = abs(a - d)
        want = None if d == 6000 else min(49 * (gap // 50) + gap % 50, 49 * (gap // 50 + 1) + 50 - gap % 50)
        assert cost == want and sum(49 if e >= 10000 else 1 for e in path) == (want or 0)
    assert found[0, 99][1] == [10000, *range(50, 99)] and len(found) == 10
    assert cells.node_cells(routing.directed(k), 1024).select("cell").distinct().count() > 1


def test_a_task_gathers_a_bounded_share_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    steps = spark.range(1000).selectExpr("id div 4 as od_id", "id % 7 as e_id")
    od = spark.range(250).selectExpr("id as od_id", "1 + id % 3 as flow")
    flow = paths.pair_edge_flow(steps, od)
    assert tables.tasks_for(steps) == 20 and "hashpartitioning(od_id, 20)" in re.sub(r"#\d+L?", "", flow._jdf.queryExecution().sparkPlan().toString() + flow._jdf.queryExecution().executedPlan().toString())
    edges = spark.range(7).selectExpr("id as e_id", "id * 30 as capacity")
    plain = paths.adjustment_ratio(flow, edges)
    assert sorted(map(tuple, paths.adjustment_ratio(flow, edges, 20).collect())) == sorted(map(tuple, plain.collect())) and plain.count() == 250


def test_pairs_in_cells_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_PAIRS", 100)
    left = spark.range(60).selectExpr("id as zone", "id % 2 as index_i", "0L as index_j")
    right = spark.range(40).selectExpr("id as city", "id % 4 as index_i", "0L as index_j").unionByName(spark.sql("select 3L as city, 1L as index_i, 0L as index_j"))
    dealt = spatial._shared_cells(left, right, "zone", "city")  # 30 * 10 pairs in one cell, 30 * 11 in the other
    assert dealt.rdd.getNumPartitions() == 7 and dealt.count() == 630
    assert spatial.overlapping(left.unionByName(left), right, "zone", "city").count() == 630
    none = spark.createDataFrame([(99, 9, 9)], "zone long, index_i long, index_j long")
    best = {r.zone: (r.city, r.cells) for r in spatial.largest_overlap(left.unionByName(none), right.filter("city <> 1"), "zone", "city").collect()}
    assert best == {**{z: (0, 1) if z % 2 == 0 else (3, 1) for z in range(60)}, 99: (None, None)}


def test_zones_meet_in_homes_and_tiles(spark, monkeypatch):
    for name, value in {"HOME": 3, "ZONES": 4, "CELLS": 9, "TASK_PAIRS": 7}.items():
        monkeypatch.setattr(spatial, name, value)
    draw = random.Random(11)
    zones = [(f"z{k}", draw.randint(-9, 9), draw.randint(-4, 4)) for k in range(20) for _ in range(draw.randint(1, 12))]
    cities = [(k if k else None, draw.randint(-9, 9), draw.randint(-4, 4)) for k in range(25) for _ in range(draw.randint(1, 12))]
    left = spark.createDataFrame([*zones, ("z99", 99, 99), ("z98", None, 1)], "zone string, index_i long, index_j long")
    right = spark.createDataFrame([*cities, (77, 1, None)], "city long, index_i long, index_j long")
    joined = left.join(right, ["index_i", "index_j"]).groupBy("zone", "city").agg(F.count(F.lit(1)).alias("cells"))
    found = spatial._shared_cells(left, right, "zone", "city")
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))
    assert spatial.overlapping(left, right, "zone", "city").count() == joined.count()
    most = {}
    for r in joined.collect():
        most[r.zone] = max(most.get(r.zone, (0, 0, None)), (r.cells, -(r.city or 10**9), r.city), key=lambda b: b[:2])
    best = {r.zone: (r.city, r.cells) for r in spatial.largest_overlap(left, right, "zone", "city").collect()}
    assert best == {z: (most[z][2], most[z][0]) if z in most else (None, None) for z in {f"z{k}" for k in range(20)} | {"z99", "z98"}}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.find("Generate") < plan.find("FlatMapGroupsInArrow") and "Aggregate" not in plan  # pairs unfold last
    assert spatial.overlapping(left.filter("false"), right, "zone", "city").isEmpty()


def test_rerouting_takes_all_displaced_trips(spark):
    want = {r.scenario: (r.change_flow, r.trips) for r in QUERIES["G12_displaced"](spark, SF).collect()}
    found = QUERIES["G12_rerouting"](spark, SF).collect()
    assert {r.scenario: (r.change_flow, r.trips) for r in found} == want
    assert all(0 <= r.isolated <= r.change_flow and abs(r.rerouting_cost - r.rer_time_cost - r.rer_operating_cost - r.rer_toll_cost) < 1e-3 for r in found)


def test_rail_flow_example(spark):
    net = [(1, "a", "b", 1, 10.0), (2, "b", "c", 1, 4.0), (3, "a", "c", 5, 0.0), (4, "c", "d", 1, 8.0)]
    table = spark.createDataFrame(net, "e_id long, from_id string, to_id string, weight long, capacity double")
    od = spark.createDataFrame([("a", "c", 6, 10), ("a", "b", 2, 0), ("c", "a", 2, 2), ("a", "z", 9, 9)], "origin_node string, destination_node string, base long, future long")
    found = {r.e_id: (r.flow_base, r.flow_future, r.gain_future, r.vc_base, r.vc_future) for r in rail.all_or_nothing(table, od, ["future"], "base").collect()}
    assert found == {1: (5, 6, 1, 0.5, 0.6), 2: (4, 6, 2, 1, 1.5), 3: (0, 0, 0, None, None), 4: (0, 0, 0, 0, 0)}


def test_rail_flow_of_all_origins_on_every_link(spark):
    length = {(r.origin_node, r.destination_node): len(r.path) for r in QUERIES["G1"](spark, SF).collect()}
    od = Inputs(spark, SF).view("od").collect()
    found = QUERIES["G13_rail_flow"](spark, SF).collect()
    assert len({r.e_id for r in found}) == len(found) == Inputs(spark, SF).view("links").count()
    assert sum(r.flow_now for r in found) == sum(r.flow * length[r.origin_node, r.destination_node] for r in od) / 2
    assert sum(r.flow_even for r in found) == sum(r.flow * length[r.origin_node, r.destination_node] for r in od if r.od_id % 2 == 0) / 2


def test_speeds_from_timetable_and_shortest_paths(spark):
    net = [(1, 1, 2, 100), (2, 2, 3, 100), (3, 1, 3, 900), (4, 3, 4, 300)]
    table = spark.createDataFrame(net, "e_id long, from_id long, to_id long, weight long")
    runs = [(1, 3, 20), (1, 3, 10), (1, 2, 10), (2, 1, 10), (3, 4, 4), (4, 3, 30), (1, 9, 5), (2, 3, 0), (2, 3, 1)]
    times = spark.createDataFrame(runs, "from_station long, to_station long, seconds long")
    # 1-3 takes 200 m in 10 s; 3-4 in 4 s and 2-3 in 1 s are above the cap; 1-9 has no path.
    assert {r.e_id: (r.fast, r.middle) for r in rail.edge_speeds(table, times).collect()} == {1: (20, 15), 2: (20, 20), 4: (10, 10)}


def test_station_speeds_against_plain_python(spark):
    links, _ = network_of(spark)
    data = Inputs(spark, SF)
    fastest = {}
    for r in rail.stop_times(data.view("stops")).filter("seconds > 0").collect():
        pair = r.from_station, r.to_station
        fastest[pair] = min(fastest.get(pair, r.seconds), r.seconds)
    routed = {(r.origin_node, r.destination_node): r for r in routing.least_cost_paths(spark.createDataFrame(links, "e_id long, from_id long, to_id long, weight long"), spark.createDataFrame(list(fastest), "origin_node long, destination_node long")).collect()}
    speeds = {}
    for pair, seconds in fastest.items():
        if routed[pair].path and routed[pair].cost / seconds <= 50:
            for e in routed[pair].path:
                speeds.setdefault(e, set()).add(routed[pair].cost / seconds)
    got = {r.e_id: (r.fast, r.middle) for r in QUERIES["G14"](spark, SF).collect()}
    assert got and got == {e: (round(max(v), 6), round(statistics.median(v), 6)) for e, v in speeds.items()}


def test_recovery_of_each_level(spark):
    rate = {(r.level, r.day): r.rate for r in recovery.recovery_rates(spark.createDataFrame([(v,) for v in (*road.LEVELS, "minor")], "level string")).collect()}
    assert len(rate) == 4 * 111 and all(rate[v, 0] == 0 and rate[v, 110] == 1 for v in road.LEVELS[1:])
    for level, first, until, step in (("minor", 10, 15, 0.167), ("moderate", 21, 45, 0.04), ("extensive", 36, 73, 0.0263), ("severe", 51, 110, 0.0167)):
        so_far = 0
        for day in range(1, 111):
            so_far += step if first <= day <= until else 0
            assert rate[level, day] == round(so_far, 2)


def test_mixture_of_clear_clusters(spark):
    rng = random.Random(3)
    points = [(i, 100.0 * (i % 3) + rng.gauss(0, 1), 50.0 * (i % 3 == 1) + rng.gauss(0, 1)) for i in range(300)]
    table = spark.createDataFrame(points, "e_id long, a double, b double")
    labelled, centres = clusters.mixture_clusters(table, ["a", "b"])
    found = {r.e_id: r.cluster for r in labelled.collect()}
    held = {c: {i % 3 for i in found if found[i] == c} for c in set(found.values())}
    assert len(found) == 300 and len(held) >= 3 and all(len(kinds) == 1 for kinds in held.values())
    assert all(abs(r.a - 100 * (r.a // 100 + (r.a % 100 > 50))) < 5 for r in centres.collect() if r.cluster in held)


@pytest.mark.parametrize("seed", range(10))
def test_three_clear_clusters_stay_whole(spark, seed):
    rng = random.Random(seed)
    points = [(i, 100.0 * (i % 3) + rng.gauss(0, 1), 50.0 * (i % 3 == 1) + rng.gauss(0, 1)) for i in range(300)]
    mixture = clusters.fit_mixture(spark.createDataFrame(points, "e_id long, a double, b double"), ["a", "b"], most=4, seed=seed, restarts=4)
    assert sorted((round(a, -1), round(b, -1)) for _, a, b in mixture.centres()) == [(0, 0), (100, 50), (200, 0)]


def test_mixture_passes_rows_that_are_alike_once(spark, monkeypatch):
    rng = random.Random(5)
    places = [(rng.gauss(c, 1.0), rng.gauss(-c, 1.0)) for c in (0, 20) for _ in range(40)]
    passed, moments = [], clusters._moments
    monkeypatch.setattr(clusters, "_moments", lambda scaled, models: passed.append(scaled.count()) or moments(scaled, models))
    many = clusters.fit_mixture(spark.createDataFrame(places * 25, "x double, y double"), ["x", "y"], most=2, restarts=2)
    assert set(passed) == {80}
    assert sorted(round(w, 6) for w in many.weights) == [0.5, 0.5]
    for k in range(2):
        near = np.array([p for p in places if (p[0] > 10) == (many.means[k][0] > 0)])
        assert np.allclose(many.means[k] * many.spread + many.mean, near.mean(0), atol=1e-6)


def test_mixture_of_nothing_and_of_nulls(spark):
    table = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (4, float("nan"), 1.0)], "e_id long, a double, b double")
    labelled, centres = clusters.mixture_clusters(table, ["a", "b"])
    assert {r.e_id: r.cluster for r in labelled.collect()} == {1: None, 2: 0, 3: 0, 4: None} and [tuple(r) for r in centres.collect()] == [(0, 1.0, 2.0)]
    labelled, centres = clusters.mixture_clusters(table.filter("false"), ["a", "b"])
    assert labelled.count() == 0 and centres.count() == 0
    assert clusters.regime_boundary(table, None).count() == 0


def test_boundary_between_two_regimes(spark):
    """Equal round clusters at (0, 0) and (4, 4): as likely where x + y = 4."""
    even = np.array([0.5, 0.5])
    mixture = clusters.Mixture(["a", "b"], np.zeros(2), np.ones(2), even, np.array([[0.0, 0.0], [4.0, 4.0]]), np.array([np.eye(2), np.eye(2)]))
    corners = spark.createDataFrame([(0.0, 0.0), (4.0, 4.0)], "a double, b double")
    found = clusters.regime_boundary(corners, mixture).collect()
    assert len(found) >= 198 and all(abs(r.x + r.y - 4) < 4 / 399 for r in found)


def test_sample_is_the_same_in_every_run(spark):
    once, again = (sorted(map(str, QUERIES["PF20"](spark, SF).collect())) for _ in range(2))
    assert once and once == again


def test_speeds_fill_from_neighbours(spark):
    chain = [(k, k, k + 1, 10.0 if k == 0 else None) for k in range(5)] + [(9, 20, 21, None), (10, 5, 6, 30.0)]
    table = spark.createDataFrame(chain, "e_id long, from_node long, to_node long, speed double")
    # Round 1: edges 1 and 4 take their neighbour's; round 2: 2 and 3; the lone edge 9 takes the lowest.
    assert {r.e_id: r.speed for r in assign.filled_speeds(table).collect()} == {0: 10, 1: 10, 2: 10, 3: 30, 4: 30, 9: 10, 10: 30}


def test_daily_use_of_all_stations(spark, duck):
    sql = expand("select s.station, q.run_date, round(s.n * (cast(q.trains as double) / q.total) * 0.5, 0) as use_ from (select station, count(*) as n from {stops} as a group by station) s cross join (select run_date, trains, sum(trains) over () as total from (select run_date, count(distinct train_id) as trains from {stops} as b group by run_date) x) q")
    got = QUERIES["M21_all_stations"](spark, SF)
    want = duck.execute(sql).fetchall()
    assert len({r[0] for r in want}) == 40 and rows([tuple(r) for r in got.collect()], got.columns) == rows(want, ["station", "run_date", "use_"])


def test_whole_scan_and_all_written_partitions(spark, duck):
    for name, sql in (("IO1_whole", "select o_orderkey, o_totalprice from orders"), ("IO12_whole", "select o_orderkey, o_custkey, o_orderkey % 7 as part from orders")):
        got, want = QUERIES[name](spark, SF), duck.execute(sql)
        assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), [d[0] for d in want.description])


def test_node_flows_unfold_from_lists(spark, monkeypatch):
    monkeypatch.setattr(demand, "LISTED", 2)
    shares = [(z, n, 0.1 + 0.2 * (n % 2)) for z in (1, 2) for n in range(10 * z, 10 * z + 7)]
    od = spark.createDataFrame([(1, 2, 30.0), (1, 1, 7.0), (2, 3, 5.0)], "origin long, destination long, flow double")
    found = demand.disaggregated(od, spark.createDataFrame(shares, "zone_id long, node_id long, share double"), 6)
    want = sorted((a, b, round(f * p * q, 6)) for o, d, f in [(1, 2, 30.0), (1, 1, 7.0)] for z, a, p in shares if z == o for y, b, q in shares if y == d)
    assert sorted((r.origin_node, r.destination_node, r.flow) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate") < plan.find("Join")  # pairs of lists are joined, not pairs of nodes


def test_points_meet_rings_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE", 3)
    draw = random.Random(7)
    places = [(k, float(draw.randint(0, 30)), draw.choice([float(draw.randint(0, 30)), draw.random() * 30])) for k in range(60)]
    rings = [(k % 17, [(draw.uniform(0, 30), draw.uniform(0, 30)) for _ in range(draw.randint(3, 6))]) for k in range(20)]
    rings = [(k, [*ring, ring[0]]) for k, ring in rings] + [(20, [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)])]
    odd = [(30, [(0.0, 0.0), (9.0, None), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]), (31, []), (32, None), (33, [(1.0, 1.0)])]
    points = spark.createDataFrame([*places, (98, None, 2.0), (99, 3.0, None)], "zone_id long, x double, y double")
    polygons = spark.createDataFrame(rings + odd, "node_id long, ring array<struct<x:double,y:double>>")
    found = spatial.points_in_polygons(points, polygons, 8.0, "node_id")
    want = points.crossJoin(polygons).filter(spatial.inside(F.col("x"), F.col("y"), F.col("ring"))).select("zone_id", "x", "y", "node_id")
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan  # pairs are made where they are tested, and not shuffled to their rings
    assert spatial.points_in_polygons(points.filter("false"), polygons, 8.0, "node_id").isEmpty()


def test_segments_over_one_another_are_cut_to_stretches(spark):
    draw = random.Random(3)
    flat = [(k, [(float(a), y), (float(b), y)]) for k in range(300) for a, b, y in [(*draw.sample(range(20), 2), float(draw.choice([0, 5])))]]
    upright = [(300 + k, [(4.0, float(a)), (4.0, float(b))]) for k in range(50) for a, b in [draw.sample(range(-3, 9), 2)]]
    table = [*flat, *upright, (400, [(30.0, 1.0), (35.0, 9.0)]), (401, [(12.0, -7.0)])]
    cut = nearest.segments(spark.createDataFrame(table, "line_id long, line array<struct<x:double,y:double>>"), "line_id", "line")
    corner = lambda a: F.struct(F.col(f"{a}x").alias("x"), F.col(f"{a}y").alias("y"))
    items = cut.select(F.struct("line_id", "section", "ax", "ay", "bx", "by").alias("item"), F.array(corner("a"), corner("b")).alias("ends"))
    assert nearest._stretches(items).count() <= 2 * (20 + 20 + 12) + 2 < items.count() / 3

    points = [(k, *p) for k, p in enumerate([(draw.uniform(-9, 40), draw.uniform(-9, 20)) for _ in range(60)] + [(float(draw.randint(-9, 40)), float(draw.randint(-9, 20))) for _ in range(60)])]
    lines = spark.createDataFrame([(k, line, 0.0, 1.0) for k, line in table], "line_id long, line array<struct<x:double,y:double>>, start double, stop double")
    found = {r.zone_id: (r.line_id, r.distance) for r in nearest.positions_on_nearest(spark.createDataFrame(points, "zone_id long, x double, y double"), lines).collect()}
    best = spark.createDataFrame(points, "zone_id long, x double, y double").crossJoin(items)
    best = best.groupBy("zone_id").agg(F.min(F.struct(nearest._segment_gap(F.col("item"), F.col("x"), F.col("y")).alias("gap"), "item.line_id")).alias("b"))
    assert found == {r.zone_id: (r.b.line_id, r.b.gap**0.5) for r in best.collect()}


def test_small_networks_are_labelled_in_blocks():
    """A hub's links stand in several columns; blocks give the same least costs as every link tried over and over."""
    rng = np.random.default_rng(3)
    u, v = np.append(rng.integers(0, 90, 400), np.arange(1, 60)), np.append(rng.integers(0, 90, 400), np.zeros(59, int))
    order = np.argsort(v, kind="stable")
    u, v, weight = u[order], v[order], rng.integers(1, 9, len(u)).astype(float)
    starts = np.array([0, 5, 77])
    pieces = cells._pieces(u, v, weight, len(starts))
    assert len(pieces) > 1 and all(len(np.unique(to)) == len(to) and len(before) <= cells.PIECE for to, before, _ in pieces)
    want = np.full((90, 3), np.inf)
    want[starts, range(3)] = 0
    for _ in range(90):
        np.minimum.at(want, v, want[u] + weight[:, None])
    assert (cells._costs(90, pieces, starts) == want).all()


def test_rounds_of_an_assignment_take_few_jobs(spark):
    net = spark.range(40).selectExpr("id as e_id", "id % 20 as from_id", "(id * 7 + 1) % 20 as to_id", "1 + id % 5 as weight", "10.0D as acc_capacity", "10.0D as current_capacity", "0.0D as acc_flow", "'M' as combined_label", "60.0D as initial_flow_speeds", "10.0D as min_flow_speeds", "1200.0D as breakpoint_flows")
    od = spark.range(60).selectExpr("id % 20 as origin_node", "(id * 3 + 1) % 20 as destination_node", "4 as flow")
    spark.sparkContext.setJobGroup("rounds", "an assignment")
    jobs = []
    for rounds in (1, 2):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "an assignment")
        assign.assign(net, od, rounds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] - jobs[0] <= 45


@pytest.mark.parametrize("top, both", [(3, True), (40, True), (5, False)])
def test_a_search_from_both_ends_finds_the_same_ways(monkeypatch, top, both):
    """A large network's nodes are not all labelled; costs, ways and the choice of equal ones are those of full labels."""
    monkeypatch.setattr(cells, "MET", 3 * 9000)
    rng = np.random.default_rng(top)
    u, v = rng.integers(0, 9000, 30000), rng.integers(0, 9000, 30000)
    weight = rng.integers(0, top, 30000).astype(float)
    if both:
        u, v, weight = np.append(u, v), np.append(v, u), np.append(weight, weight)
    start = np.sort(rng.integers(0, 9000, 60))
    end = np.append(rng.integers(0, 9000, 59), start[-1])
    starts, row = np.unique(start, return_inverse=True)
    search = cells._Meeting(9000, u, v, weight)
    found = [np.concatenate(x) for x in zip(*search.ways(starts, row, end))]
    want = [np.concatenate(x) for x in zip(*cells._every_way(9000, u, v, weight, starts, row, end))]
    assert all((a == b).all() for a, b in zip(found, want))
    assert np.isinf(search.cost).all() and np.isinf(search.rest).all() and not search.waiting.any() and not search.awaited.any()


def test_a_large_network_goes_to_tasks_whole(spark, monkeypatch):
    monkeypatch.setattr(cells, "DENSE", 100)
    monkeypatch.setattr(cells, "CELL_NODES", 64)
    monkeypatch.setattr(cells, "MET", 4 * 400)
    k = spark.range(1200).selectExpr("id as e_id", "id % 400 as from_id", "(id * 7 + id % 11) % 400 as to_id", "1 + id % 4 as weight")
    od = spark.range(500).selectExpr("id % 90 as origin_node", "(id * 37) % 420 as destination_node").distinct()
    assert cells.is_whole(cells.node_cells(routing.directed(k)))
    rows_ = lambda f: sorted(map(str, f.select("origin_node", "destination_node", "cost", "path").collect()))
    assert rows_(routing.least_cost_paths(k, od)) == rows_(routing.walked_paths(k, od))


def test_damage_table_is_whole(spark):
    """Every curve's and flood's fraction and costs; a segment that one flood damages keeps what the other has, too."""
    found = QUERIES["M12"](spark, SF).cache()
    assert len(found.columns) == 4 + 6 * 2 * 4
    levels = levelled(Inputs(spark, SF)).groupBy("e_id", "index_i", "index_j", "length_m").pivot("flood", ["surface", "river"]).agg(F.first("level"))
    assert found.count() == levels.filter("surface <> 'no' or river <> 'no'").count()
    half = found.join(levels.filter("surface = 'no' and river <> 'no'"), ["e_id", "index_i", "index_j", "length_m"])
    assert not half.isEmpty() and half.filter(F.coalesce(*[f"C{k}_surface_fraction" for k in range(1, 7)]).isNull()).isEmpty()


def test_bounded_search_writes_no_labels(spark, monkeypatch):
    """A network that a task can hold is searched in tasks; a larger one in rounds, with the same rows."""
    links_ = Inputs(spark, SF).view("links").selectExpr("e_id", "from_id", "to_id", "cast(round(length_m) as bigint) as weight")
    sources = spark.range(45).selectExpr("id as source", "2000 + id * 20 as cutoff")
    monkeypatch.setattr(cells, "LISTED", 16)
    found = routing.reachable(links_, sources)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(cells, "REACHED_LINKS", 1)
    rounds = routing.reachable(links_, sources)
    assert found.columns == rounds.columns and found.schema["cost"].dataType == rounds.schema["cost"].dataType
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rounds.collect()))
