"""Geometry decoding and the draws, ranges and statistics of demand, against plain versions."""

import datetime as dt
import random
import statistics
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayflux.operators import demand, rail, tables
from wayflux.sources import geometry

RANDOM = random.Random(5)


def points(n):
    return [(RANDOM.uniform(-1e6, 1e6), RANDOM.uniform(-1e6, 1e6)) for _ in range(n)]


def coordinates(order, line, extra):
    return struct.pack(f"{order}I", len(line)) + b"".join(struct.pack(f"{order}{2 + extra}d", x, y, *[7.0] * extra) for x, y in line)


def packed(parts, kind, order="<", style="iso", extra=0, inner=None, srid=False):
    """A geometry as WKB; ``style`` says how further dimensions are marked, ``inner`` the byte order of a part's own header."""
    head = lambda k, o, with_srid=False: (b"\1" if o == "<" else b"\0") + struct.pack(f"{o}I", k + (1000 * (0, 1, 3)[extra] if style == "iso" else (0, 1 << 31, 3 << 30)[extra]) + ((1 << 29) if with_srid else 0)) + (struct.pack(f"{o}I", 27700) if with_srid else b"")
    if kind == 2:
        return head(2, order, srid) + coordinates(order, parts[0], extra)
    body = [coordinates(order, p, extra) if kind == 3 else head(2, inner or order) + coordinates(inner or order, p, extra) for p in parts]
    return head(kind, order, srid) + struct.pack(f"{order}I", len(parts)) + b"".join(body)


def test_geometries_of_every_kind(spark):
    want, rows = {}, []
    for i in range(400):
        kind, order, style = RANDOM.choice([2, 3, 5]), RANDOM.choice("<>"), RANDOM.choice(["iso", "flags"])
        parts = [points(RANDOM.randrange(5)) for _ in range(1 if kind == 2 else RANDOM.randrange(4))]
        raw = packed(parts, kind, order, style, RANDOM.randrange(3), RANDOM.choice("<>"), style == "flags" and i % 2 == 0)
        cut = i % 7 == 0
        rows.append((i, raw[: RANDOM.randrange(len(raw))] if cut else raw + b"\0" * (i % 3), "x"))
        want[i] = None if cut else (kind, parts)
    rows += [(1000, None, "x"), (1001, b"", "x"), (1002, b"\1" + struct.pack("<Idd", 1, 0, 0), "x"), (1003, b"\7" + rows[1][1][1:], "x"), (1004, b"\1" + struct.pack("<II", 2, 2**32 - 1), "x")]
    want |= {i: None for i in range(1000, 1005)}
    frame = spark.createDataFrame(rows, "id long, geometry binary, `points` string").repartition(3)
    pairs = lambda line: [tuple(p) for p in line]
    got = {r.id: r.geometry for r in geometry.decode_parts(frame).collect()}
    assert {i: None if g is None else [pairs(p) for p in g] for i, g in got.items()} == {i: None if w is None else w[1] for i, w in want.items()}
    lines = {r.id: r.geometry for r in geometry.decode_lines(frame).collect()}
    assert {i: None if g is None else pairs(g) for i, g in lines.items()} == {i: w[1][0] if w and w[0] == 2 else None for i, w in want.items()}
    empty = geometry.decode_lines(frame.filter("false"))
    assert empty.count() == 0 and empty.columns == frame.columns


@pytest.fixture
def zones(spark):
    weights = spark.createDataFrame([(1, 10, 1.0), (1, 11, 3.0), (1, 12, 0.0), (2, 20, 0.25), (2, 21, 0.25), (2, 22, 0.5)], "zone_id long, node_id long, weight double")
    centroids = spark.createDataFrame([(3, 9.0, 9.0), (4, None, 1.0)], "zone_id long, x double, y double")
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (30, 8.0, 9.0), (31, 9.0, 8.0)], "node_id long, x double, y double")
    return weights, centroids, nodes


def test_drawn_trips(spark, zones):
    weights, centroids, nodes = zones
    od = spark.createDataFrame([(1, 2, 6000), (1, 2, 4000), (2, 3, 7), (4, 1, 4), (5, 5, 2), (2, 1, None), (2, 2, 0), (3, 3, -4), (None, 1, 1)], "origin long, destination long, flow long")
    draw = lambda frame, seed=0: Counter({(r.origin_node, r.destination_node): r.flow for r in demand.drawn(frame, weights, weights, centroids, nodes, seed).collect()})
    got = draw(od)
    assert sum(got.values()) == 10000 + 7 + 4 + 2 + 1
    assert sum(n for (_, d), n in got.items() if d == 30) == 7 and got[None, None] == 2  # nearest node, smallest id; no place: null
    share = {10: 0.25, 11: 0.75, 20: 0.25, 21: 0.25, 22: 0.5}
    assert all(abs(got[o, d] - 10000 * share[o] * share[d]) <= 30 for o in (10, 11) for d in (20, 21, 22))
    assert got == draw(od.repartition(7)) and got != draw(od, 1)
    assert not draw(od.filter("false"))


def test_few_trips_have_the_expectation_of_the_shares(spark, zones):
    weights, centroids, nodes = zones
    many = spark.range(4000).select((F.col("id") * 2).alias("origin"), (F.col("id") * 2 + 1).alias("destination"), F.lit(1).alias("flow"))
    zone = lambda end, like: weights.filter(f"zone_id = {like}").select("node_id", "weight").crossJoin(many.select(F.col(end).alias("zone_id")))
    got = {(r.origin_node, r.destination_node): r.flow for r in demand.drawn(many, zone("origin", 1), zone("destination", 2), centroids, nodes).collect()}
    assert sum(got.values()) == 4000
    assert all(abs(got[o, d] - 4000 * p * q) < 5 * (4000 * p * q) ** 0.5 for o, p in ((10, 0.25), (11, 0.75)) for d, q in ((20, 0.25), (22, 0.5)))


def test_running_total_of_a_hot_key(spark):
    rows = [(1 if i % 3 else i, i, RANDOM.randrange(9) if i % 5 else None) for i in range(3000)] + [(None, -1, 4)]
    got = tables.running_total(spark.createDataFrame(rows, "k long, at long, v long").repartition(5), "k", "at", "v").collect()
    upto, total = {}, Counter()
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        total[k] += v or 0
        upto[at] = total[k]
    assert len(got) == len(rows) and all(r.upto == upto[r["at"]] and r.total == total[r.k] for r in got)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 9, [1e300, -1e300, 4.0], [0.0, 5e-324], [], None])
def test_exact_median(spark, values):
    values = [RANDOM.expovariate(1) ** 9 for _ in range(5000)] if values is None else values
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double")
    assert tables.exact_median(frame, "v") == (statistics.median(values) if values else None)


def test_running_days_over_ranges(spark):
    day = lambda n: dt.date(2025, 5, 19) + dt.timedelta(n)
    rows = [(1, day(0), day(13), [1, 0, 0, 0, 0, 0, 1]), (2, day(3), day(3), [0, 0, 0, 1, 0, 0, 0]), (3, day(5), day(2), [1] * 7), (4, None, day(9), [1] * 7), (5, day(-9000), dt.date(9999, 1, 1), [0, 1, 0, 0, 0, 0, 0]), (6, day(0), day(6), None)]
    trains = spark.createDataFrame(rows, "train_id long, a date, b date, flags array<int>")
    got = {(r.train_id, r.day) for r in rail.running_days(trains, "a", "b", F.col("flags"), ("2025-05-18", "2025-06-01")).collect()}
    assert got == {(1, day(0)), (1, day(7)), (1, day(6)), (1, day(13)), (2, day(3)), (5, day(1)), (5, day(8))}
    assert rail.running_days(trains.filter("train_id = 1"), "a", "b", F.col("flags")).count() == 4


def test_effects_of_several_factors(spark):
    # y = 2a - 3b + ab over trajectories that move one factor a step; lost rows and a tail that is too short go.
    path = [(0, 0), (1, 0), (1, 1), (2, 5), (3, 5), (3, 4), (9, 9), (8, 9)]
    rows, at = [], 0
    for k, (a, b) in enumerate(path):
        rows.append((at, float(a), float(b), 2.0 * a - 3 * b + a * b))
        at += 1
        if k % 2:
            rows.append((at, 0.0, 0.0, [None, float("nan")][k % 4 // 2]))
            at += 1
    frame = spark.createDataFrame(rows, "at long, a double, b double, y double")
    runs = demand.trajectories(frame.repartition(3), "at", 2, "y")
    assert sorted((r["at"], r.trajectory, r.step) for r in runs.collect()) == [(0, 0, 0), (1, 0, 1), (3, 0, 2), (4, 1, 0), (6, 1, 1), (7, 1, 2)]
    got = {r.factor: (r.mu, r.mu_star, r.sigma) for r in demand.elementary_effects(runs, ["a", "b"], "y").collect()}
    spread = lambda v: pytest.approx(statistics.stdev(v))
    assert got == {"a": (4.5, 4.5, spread([2.0, 7.0])), "b": (-1.0, 1.0, spread([-2.0, 0.0]))}
    assert demand.trajectories(frame.filter("false"), "at", 2, "y").count() == 0
