"""Lines and polygons as arrays of struct<x,y>: lengths, grid splitting, cell joins. Coordinates share one metric system.

Everything that needs two geometries goes through square cells: lines are split at cell edges, polygons are taken as
rings or as sets of cells, and joins are equalities on cells followed by an exact test where one exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayflux.checkpoints import checkpoint
from wayflux.operators.cells import ranges
from wayflux.operators.nearest import pairs_nearest

TASK_PAIRS = 2**20  # pairs in a cell that a task makes, and that are held at a time
TILE = 2048  # points, and rings, of a cell that are tested together
HOME = 8  # cells of a home's side
ZONES, CELLS = 2048, 2**17  # keys, and cells of theirs, that meet as many others in a task
TESTED = 2**18  # tests of a point and an edge that are held at a time


def _sections(line: Column) -> Column:
    """Array of struct(a, b) for consecutive points."""
    n = F.size(line)
    return F.when(n >= 2, F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def length(line: Column) -> Column:
    """Planar length; 0 for fewer than two points, null for a null line."""
    return F.when(line.isNotNull(), F.coalesce(F.aggregate(_sections(line), F.lit(0.0), lambda s, p: s + _gap(p["a"], p["b"])), F.lit(0.0)))


def centroid(ring: Column) -> Column:
    """Centre of mass of a closed ring by the shoelace sums; of a flat ring its first point."""
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def more(s: Column, p: Column) -> Column:
        c = p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
        return F.struct((s["d"] + c).alias("d"), (s["x"] + (p["a"]["x"] + p["b"]["x"]) * c).alias("x"), (s["y"] + (p["a"]["y"] + p["b"]["y"]) * c).alias("y"))

    s = F.aggregate(_sections(ring), zero, more)
    flat = F.get(ring, F.lit(0))
    return F.when(s["d"] == 0, flat).otherwise(F.struct((s["x"] / (s["d"] * 3)).alias("x"), (s["y"] / (s["d"] * 3)).alias("y")))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring, by crossings of a ray; the lower and left edges belong to it."""
    def crosses(p: Column) -> Column:
        a, b = p["a"], p["b"]
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(_sections(ring), crosses)) % 2 == 1


def split_on_grid(lines: DataFrame, cell: float, key: str = "e_id", line: str = "line") -> DataFrame:
    """key, part, index_i, index_j, x, y, length: the pieces of each line between cell edges, with their cell and middle."""
    section = lines.select(key, F.posexplode(_sections(F.col(line))).alias("section", "p")).select(key, "section", "p.a", "p.b")

    def cuts(axis: str) -> Column:
        a, b = F.col(f"a.{axis}"), F.col(f"b.{axis}")
        low, high = F.ceil(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)
        edges = F.when((a != b) & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(edges, lambda k: (k * cell - a) / (b - a))

    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts("x"), cuts("y"))))
    section = section.withColumn("at", at)
    n = F.size("at")
    pieces = F.zip_with(F.slice("at", 1, n - 1), F.slice("at", 2, n - 1), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    cut = section.select(key, "section", "a", "b", F.posexplode(pieces).alias("piece", "c"))
    middle = (F.col("c.s") + F.col("c.t")) / 2
    along = lambda axis: F.col(f"a.{axis}") + (F.col(f"b.{axis}") - F.col(f"a.{axis}")) * middle
    out = cut.withColumn("x", along("x")).withColumn("y", along("y")).withColumn("length", _gap(F.col("a"), F.col("b")) * (F.col("c.t") - F.col("c.s"))).filter("length > 0")
    return out.select(key, F.struct("section", "piece").alias("part"), F.floor(F.col("x") / cell).alias("index_i"), F.floor(F.col("y") / cell).alias("index_j"), "x", "y", "length")


def with_cell_value(pieces: DataFrame, cells: DataFrame) -> DataFrame:
    """Each piece with the value of its cell in cells(index_i, index_j, ...), null outside the raster."""
    return pieces.join(cells, ["index_i", "index_j"], "left")


def clip_to_cells(pieces: DataFrame, mask: DataFrame) -> DataFrame:
    return pieces.join(mask.select("index_i", "index_j"), ["index_i", "index_j"], "left_semi")


def clip_to_box(pieces: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return pieces.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def touches_mask(lines: DataFrame, mask: DataFrame, cell: float, key: str = "e_id") -> DataFrame:
    """Every line with urban = 1 if one of its pieces lies in a cell of the mask, else 0."""
    hit = clip_to_cells(split_on_grid(lines, cell, key), mask).select(key).distinct().withColumn("urban", F.lit(1))
    return lines.join(hit, key, "left").fillna({"urban": 0})


def length_per_zone(pieces: DataFrame, zones: DataFrame, key: str = "e_id") -> DataFrame:
    """Length of each line in each zone of zones(index_i, index_j, zone_id)."""
    return pieces.join(zones, ["index_i", "index_j"]).groupBy(key, "zone_id").agg(F.sum("length").alias("length"))


def grown_mask(cells: DataFrame, reach: int) -> DataFrame:
    """Cells whose centre is within ``reach`` cell sizes of a given cell's centre."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach]
    near = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in steps])
    spread = cells.select("index_i", "index_j", F.explode(near).alias("d"))
    return spread.select((F.col("index_i") + F.col("d.di")).alias("index_i"), (F.col("index_j") + F.col("d.dj")).alias("index_j")).distinct()


def box_cells(polygons: DataFrame, cell: float, key: str, ring: str = "ring") -> DataFrame:
    """key, ring, index_i, index_j: the cells of each ring's bounding box."""
    axis = lambda f, a: f(F.transform(ring, lambda p: p[a]))
    span = lambda a: F.sequence(F.floor(axis(F.array_min, a) / cell), F.floor(axis(F.array_max, a) / cell))
    return polygons.select(key, ring, F.explode(span("x")).alias("index_i"), span("y").alias("js")).select(key, ring, "index_i", F.explode("js").alias("index_j"))


def polygon_cells(polygons: DataFrame, cell: float, key: str, ring: str = "ring") -> DataFrame:
    """The cells whose centres lie in each ring: the polygon at the resolution of ``cell``."""
    boxes = box_cells(polygons, cell, key, ring)
    return boxes.filter(inside((F.col("index_i") + 0.5) * cell, (F.col("index_j") + 0.5) * cell, F.col(ring))).select(key, "index_i", "index_j")


def _held(points: np.ndarray, edges: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each point (row) lies in each ring (column), as ``inside`` says; edges(ax, ay, bx, by) of a ring begin at ``first``."""
    x, y = points[:, :1], points[:, 1:]
    ax, ay, bx, by = edges
    with np.errstate(divide="ignore", invalid="ignore"):
        at = ax + (y - ay) * (bx - ax) / (by - ay)
    return np.logical_xor.reduceat(((ay > y) != (by > y)) & (x < at), first, axis=1)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, key: str, ring: str = "ring") -> DataFrame:
    """Each point with the polygons that contain it: points and rings meet by cell, then the exact test.

    The points of a cell and its rings are dealt over so many groups that none holds more than about TILE of either; a group tests
    all at once and gives each point the list of its keys, and the pairs unfold last, so that no pair, be it one of the
    result or not, is sorted or shuffled. A key may have several rings. Rings with a missing place are tested row by row.
    """
    by_cell, n = ["index_i", "index_j"], F.count(F.lit(1))
    filed = points.withColumn("index_i", F.floor(F.col("x") / cell)).withColumn("index_j", F.floor(F.col("y") / cell))
    real = lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))
    whole = F.forall(ring, lambda p: real(p["x"].cast("double")) & real(p["y"].cast("double"))) & (F.size(ring) >= 2)
    odd = polygons.filter(~whole)
    met = filed.join(box_cells(odd, cell, key, ring).drop(ring).distinct(), by_cell).join(odd.select(key, ring), key)
    met = met.filter(inside(F.col("x"), F.col("y"), F.col(ring))).select(*points.columns, key)

    flat = lambda a: F.transform(ring, lambda p: p[a].cast("double")).alias(f"ring_{a}")
    boxes = box_cells(polygons.filter(whole), cell, key, ring).distinct()
    sizes = boxes.groupBy(*by_cell).agg(F.ceil(n / TILE).alias("ring_tiles"))
    sizes = checkpoint(sizes.join(filed.groupBy(*by_cell).agg(F.ceil(n / TILE).alias("point_tiles")), by_cell))  # one row a cell
    to = lambda tiles: F.explode(F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1))
    mine = lambda tiles, *columns: F.pmod(F.xxhash64(*columns), F.col(tiles))
    left = filed.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).join(sizes, by_cell).withColumn("a", mine("point_tiles", *points.columns)).withColumn("b", to("ring_tiles"))
    left = left.select(*by_cell, "a", "b", F.struct(*points.columns).alias("point"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    right = boxes.join(sizes, by_cell).withColumn("b", mine("ring_tiles", key)).withColumn("a", to("point_tiles"))
    right = right.select(*by_cell, "a", "b", F.col(key).alias("polygon"), flat("x"), flat("y"))
    work = left.unionByName(right, allowMissingColumns=True)
    shape = pa.schema([("point", to_arrow_type(left.schema["point"].dataType)), ("keys", pa.list_(to_arrow_type(right.schema["polygon"].dataType)))])

    def tested(group: pa.Table) -> pa.Table:
        rings, asked = group.filter(pc.is_valid(group["ring_x"])).combine_chunks(), group.filter(pc.is_valid(group["px"])).combine_chunks()
        if not len(rings) or not len(asked):
            return shape.empty_table()
        x, y = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rings[name].chunks]) for name in ("ring_x", "ring_y"))
        long = pc.list_value_length(rings["ring_x"]).to_numpy()
        ends = np.cumsum(long)
        edge = np.delete(np.arange(len(x)), ends - 1)  # the last place of a ring begins no edge
        edges, first = np.stack([x[edge], y[edge], x[edge + 1], y[edge + 1]]), ends - long - np.arange(len(long))
        place = np.stack([asked["px"].to_numpy(), asked["py"].to_numpy()], axis=1)
        step = max(1, TESTED // len(edge))
        sizes, found = [], []
        for begin in range(0, len(place), step):
            row, column = np.nonzero(_held(place[begin : begin + step], edges, first))
            sizes.append(np.bincount(row, minlength=len(place[begin : begin + step])))
            found.append(column)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
        keys = rings["polygon"].combine_chunks().take(pa.array(np.concatenate(found)))
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        return pa.table([asked["point"], pa.ListArray.from_arrays(offsets, keys)], names=shape.names).cast(shape)

    spark = points.sparkSession
    groups = sizes.agg(F.coalesce(F.sum(F.col("ring_tiles") * F.col("point_tiles")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, groups // 8)
    dealt = work.repartition(tasks, *by_cell, "a", "b").groupBy(*by_cell, "a", "b")
    kinds = f"point {left.schema['point'].dataType.simpleString()}, keys array<{right.schema['polygon'].dataType.simpleString()}>"
    pairs = dealt.applyInArrow(tested, kinds).select("point.*", F.explode("keys").alias(key))
    return pairs.unionByName(met)


def first_polygons(points: DataFrame, polygons: DataFrame, cell: float, key: str, ring: str = "ring") -> DataFrame:
    """Each point with those polygons that contain it which can have the smallest key, that one among them.

    A ring without an edge near a cell holds all of it or nothing. Of the rings that hold a whole cell only the smallest key can be
    an answer there, and of the others only smaller keys, however many polygons lie over one another.
    """
    filed = points.withColumn("index_i", F.floor(F.col("x") / cell)).withColumn("index_j", F.floor(F.col("y") / cell))
    low = lambda i: F.col(i) * cell
    margin = 1e-6 * (cell + F.abs(low("index_i")) + F.abs(low("index_j")))

    def beside(p: Column, a: str, i: str) -> Column:
        return (F.greatest(p["a"][a], p["b"][a]) < low(i) - margin) | (F.least(p["a"][a], p["b"][a]) > low(i) + cell + margin)

    clear = F.forall(_sections(F.col(ring)), lambda p: beside(p, "x", "index_i") | beside(p, "y", "index_j"))
    middle = inside(low("index_i") + cell / 2, low("index_j") + cell / 2, F.col(ring))
    near = box_cells(polygons, cell, key, ring).select(key, "index_i", "index_j", F.coalesce(clear, F.lit(False)).alias("clear"), middle.alias("middle"))
    near = near.filter("not clear or middle").groupBy(key, "index_i", "index_j").agg(F.max("clear").alias("whole"))
    least = near.filter("whole").groupBy("index_i", "index_j").agg(F.min(key).alias("least"))
    near = near.join(least, ["index_i", "index_j"], "left").filter(F.col("least").isNull() | (F.col(key) <= F.col("least")))
    met = filed.join(near.select(key, "index_i", "index_j"), ["index_i", "index_j"]).join(polygons.select(key, ring), key)
    return met.filter(inside(F.col("x"), F.col("y"), F.col(ring))).select(*points.columns, key)


def containing_or_nearest(points: DataFrame, polygons: DataFrame, centres: DataFrame, cell: float) -> DataFrame:
    """zone_id, node_id: the polygon (node_id, ring) that holds a point, the smallest id first, else the nearest centre."""
    held = first_polygons(points, polygons, cell, "node_id").groupBy("zone_id").agg(F.min("node_id").alias("node_id"))
    rest = points.join(held, "zone_id", "left_anti")
    return held.unionByName(pairs_nearest(rest, centres).select("zone_id", "node_id"))


def _shared_cells(left: DataFrame, right: DataFrame, key: str, other: str, best: bool = False) -> DataFrame:
    """key, other, cells: a row for each pair that shares cells, and in how many; with ``best`` each key's first few only.

    A key goes with all its cells to the home of its least ones (HOME cells a side), the others' cells to each home that reaches
    them, so that a pair meets once. Keys and others of a home are dealt over so many groups that none holds more than about
    ZONES or CELLS of either. A group counts all its pairs at once and gives each key a list; pairs unfold last, and none is
    sorted or shuffled. ``best`` leaves one a group for each key: of the most cells, the smaller of equals.
    """
    cell, n = ["index_i", "index_j"], F.count(F.lit(1))
    lists = lambda f, *by: f.groupBy(*by).agg(F.collect_list(F.struct(*cell)).alias("c"))
    split = [F.col(f"c.{a}").alias(a) for a in cell]
    home = lambda a: F.floor(F.array_min(F.col(f"c.{a}")) / HOME)
    left, right = checkpoint(left.dropna(subset=cell)), checkpoint(right.dropna(subset=cell))
    zones = checkpoint(lists(left, key).select(key, *split, home("index_i").alias("home_i"), home("index_j").alias("home_j")))
    at = ["home_i", "home_j"]
    reach = zones.select(*at, F.explode(F.arrays_zip(*cell)).alias("c")).select(*at, "c.index_i", "c.index_j").distinct()
    cities = checkpoint(lists(right.join(reach, cell), *at, other).select(*at, other, *split))
    tiles = lambda name: F.greatest(F.ceil(n / ZONES), F.ceil(F.sum(F.size("index_i")) / CELLS)).alias(name)
    sizes = checkpoint(zones.groupBy(*at).agg(tiles("a_tiles")).join(cities.groupBy(*at).agg(tiles("b_tiles")), at))  # one row a home
    to = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    mine = lambda name, column: F.pmod(F.xxhash64(column), F.col(name))
    asked = zones.join(sizes, at).withColumn("a", mine("a_tiles", key)).withColumn("b", to("b_tiles")).select(*at, "a", "b", F.lit(True).alias("asked"), F.col(key).alias("zone"), *cell)
    met = cities.join(sizes, at).withColumn("b", mine("b_tiles", other)).withColumn("a", to("a_tiles")).select(*at, "a", "b", F.lit(False).alias("asked"), F.col(other).alias("city"), *cell)
    kinds = left.schema[key].dataType, right.schema[other].dataType
    shape = pa.schema([("zone", to_arrow_type(kinds[0])), ("city", pa.list_(to_arrow_type(kinds[1]))), ("cells", pa.list_(pa.int64()))])

    def counted(group: pa.Table) -> pa.Table:
        zone, city = group.filter(group["asked"]).combine_chunks(), group.filter(pc.invert(group["asked"])).combine_chunks()
        if not len(zone) or not len(city):
            return shape.empty_table()
        city = city.take(pc.sort_indices(city["city"]))
        (z, zi, zj), (c, ci, cj) = _placed(zone), _placed(city)
        _, i = np.unique(np.concatenate([zi, ci]), return_inverse=True)
        _, j = np.unique(np.concatenate([zj, cj]), return_inverse=True)
        place = i * (j.max() + 1) + j
        of, there = place[: len(z)], place[len(z) :]
        order = np.argsort(there, kind="stable")
        there, c = there[order], c[order]
        low, high = np.searchsorted(there, of), np.searchsorted(there, of, "right")
        steps = np.cumsum(high - low)
        many, found, counts, begin = len(city), [], [], 0
        while begin < len(zone):
            first = np.searchsorted(z, begin)
            # So many keys that their cells' others are about TASK_PAIRS, one key at least.
            last = np.searchsorted(steps, (steps[first - 1] if first else 0) + TASK_PAIRS, "right")
            end = min(len(zone), begin + max(1, TASK_PAIRS // many), max(begin + 1, int(z[last]) if last < len(z) else len(zone)))
            some = slice(first, np.searchsorted(z, end))
            where, which = ranges(low[some], high[some])
            pairs = np.bincount((z[some][which] - begin) * many + c[where], minlength=(end - begin) * many).reshape(-1, many)
            if best:
                most = pairs.argmax(1)
                pairs = np.where(np.arange(many) == most[:, None], pairs, 0)
            row, column = np.nonzero(pairs)
            found.append((np.bincount(row, minlength=end - begin), column))
            counts.append(pairs[row, column])
            begin = end
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([f[0] for f in found]))]), pa.int32())
        keys = city["city"].combine_chunks().take(pa.array(np.concatenate([f[1] for f in found])))
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys, pa.array(np.concatenate(counts)))]
        return pa.table([zone["zone"], *lists], names=shape.names).cast(shape)

    spark = left.sparkSession
    per_cell = left.groupBy(*cell).agg(n.alias("n")).join(right.groupBy(*cell).agg(n.alias("m")), cell)
    rows = per_cell.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_PAIRS))
    dealt = asked.unionByName(met, allowMissingColumns=True).repartition(tasks, *at, "a", "b").groupBy(*at, "a", "b")
    listed = dealt.applyInArrow(counted, f"zone {kinds[0].simpleString()}, city array<{kinds[1].simpleString()}>, cells array<bigint>")
    return listed.select(F.col("zone").alias(key), F.explode(F.arrays_zip("city", "cells")).alias("p")).select(key, F.col("p.city").alias(other), "p.cells")


def _placed(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index_i and index_j of each cell in the lists of ``held``."""
    i, j = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in held[a].chunks]) for a in ("index_i", "index_j"))
    return np.repeat(np.arange(len(held)), pc.list_value_length(held["index_i"]).to_numpy()), i, j


def largest_overlap(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """For each left key the right one that shares most cells with it, the smaller of equals; null if none does."""
    shared = _shared_cells(left, right, key, other, best=True)
    best = shared.groupBy(key).agg(F.max(F.struct("cells", (-F.col(other)).alias("back"), other)).alias("b")).select(key, F.col(f"b.{other}").alias(other), F.col("b.cells").alias("cells"))
    return left.select(key).distinct().join(best, key, "left")


def overlapping(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Pairs of zones that share a cell."""
    return _shared_cells(left, right, key, other).select(key, other)


def referenced(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Position of points(p, line_id, x, y) along straight lines(line_id, a, b, start, stop) by projection."""
    met = points.join(lines, "line_id")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    t = F.try_divide((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return met.withColumn("position", F.col("start") + (F.col("stop") - F.col("start")) * t).select(*points.columns, "position")


def directed(links: DataFrame) -> DataFrame:
    """Ends in order of their position; a link with code '2' (down) runs against it."""
    forward = F.col("from_position") <= F.col("to_position")
    swap = (F.col("direction") == "1") & ~forward | (F.col("direction") == "2") & forward
    ends = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return links.withColumn("new_from", ends("from_id", "to_id")).withColumn("new_to", ends("to_id", "from_id"))


def endpoints(lines: DataFrame, key: str = "e_id", line: str = "line", places: int = 3) -> DataFrame:
    """key, from_node, to_node: ends that coincide after rounding are one node, named by a hash of its place."""
    ends = lines.filter(F.size(line) > 0)
    name = lambda p: F.xxhash64(F.round(p["x"], places), F.round(p["y"], places))
    return ends.select(key, name(F.get(line, F.lit(0))).alias("from_node"), name(F.element_at(line, -1)).alias("to_node"))


def single_parts(multi: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per part; null and empty geometry goes."""
    kept = [c for c in multi.columns if c != parts]
    return multi.select(*kept, F.explode(parts).alias("line")).filter(F.size("line") > 0)


