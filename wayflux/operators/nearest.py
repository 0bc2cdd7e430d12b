"""Nearest site and nearest line of points, over a packed tree of boxes.

Items (sites, segments of lines) are numbered along a space-filling curve; ``FAN`` consecutive ones make a leaf, ``FAN``
consecutive nodes the node above, up to one root, so that no node grows with the data however the items crowd. Points
descend a level at a time. A node's box, cut by its diagonals, tells the least distance that something below it can have; the
sides of the box, each of which is touched, and the outermost points along the diagonals tell a distance within which
something below it surely lies. A point goes on only into nodes whose least distance does not exceed the best assurance
that it has met, however far from all items it is. Levels of at most ``SMALL`` nodes are
broadcast; below them a node that many points enter is copied over salts, so that no task gets more than a bounded share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.operators.tables import dense_ids

FAN = 32  # children of a node
SMALL = 1024  # nodes of a level that is broadcast: at most SMALL * FAN boxes
SHARES = 256  # a node that more than this part of all candidates enter is copied
BOX = ("x0", "y0", "x1", "y1", "up", "down", "right", "left")  # sides, and the outermost points by x + y and x - y
SLACK = 1e-9, 1e-12  # of squared bounds for rounding: of the bound, and of the square of the place
POINTS = 2048  # of a task: each meets some hundred boxes and items, whatever the bytes that it takes
CLOSE = 2.0**-40  # of squared coordinates: a lesser squared distance to a segment may hang on how its foot is rounded


def _real(x: Column, y: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    finite = lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))
    return finite(x) & finite(y)


def _spread(v: Column) -> Column:
    """The 20 bits of v on every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _boxed(items: DataFrame) -> DataFrame:
    """item and the fields of BOX from items(item, ends)."""
    ends = F.col("ends")
    side = lambda f, a: f(F.transform(ends, lambda e: e[a]))
    along = lambda sign: F.transform(ends, lambda e: F.struct((e["x"] + sign * e["y"]).alias("v"), e["x"].alias("x"), e["y"].alias("y")))
    found = [side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")]
    found += [F.array_max(along(1)), F.array_min(along(1)), F.array_max(along(-1)), F.array_min(along(-1))]
    return items.select("item", *[c.alias(name) for c, name in zip(found, BOX)])


def packed_tree(items: DataFrame) -> list[tuple[DataFrame, int]]:
    """Levels of (node, kids) with their numbers of nodes, leaves first, of items(item, ends).

    ``ends`` are the corners of an item, an array of struct<x, y> without nulls. Kids of leaves are items, kids of other
    nodes are node numbers with the fields of BOX. Items of like width and height come together, so that a long segment does
    not widen the boxes of short ones. No levels for an empty table.
    """
    items = _boxed(items)
    low_x, low_y, high_x, high_y = items.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if low_x is None:
        return []
    extent = max(high_x - low_x, high_y - low_y) or 1.0
    place = lambda a, low: F.least(F.floor(((F.col(f"{a}0") + F.col(f"{a}1")) / 2 - low) / extent * 2**20), F.lit(2**20 - 1))
    code = _spread(place("x", low_x)).bitwiseOR(F.shiftleft(_spread(place("y", low_y)), 1))
    side = lambda a: (F.col(f"{a}1") - F.col(f"{a}0")) / extent
    size = lambda a: F.when(side(a) > 2.0**-20, F.floor(F.log2(side(a)))).otherwise(F.lit(-20)).alias(a)
    keys = items.select(F.struct(size("x"), size("y"), code.alias("code"), "item", *BOX).alias("key"))
    ranked = dense_ids(keys, "key", "rank").select(F.floor((F.col("rank") - 1) / FAN).alias("node"), F.col("key.item").alias("kid"), *[F.col(f"key.{s}").alias(s) for s in BOX])
    box = [f(s).alias(s) for f, s in zip((F.min, F.min, F.max, F.max, F.max, F.min, F.max, F.min), BOX)]
    level = checkpoint(ranked.groupBy("node").agg(F.collect_list("kid").alias("kids"), *box))
    levels = [(level, level.count())]
    while levels[-1][1] > 1:
        kid = F.struct("node", *BOX)
        level = levels[-1][0].groupBy(F.floor(F.col("node") / FAN).alias("above")).agg(F.collect_list(kid).alias("kids"), *box).withColumnRenamed("above", "node")
        levels.append((level, -(-levels[-1][1] // FAN)))
    return levels


def _entered(at: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Candidates with the children of their node."""
    nodes = nodes.select("node", "kids")
    if n <= SMALL:
        return at.join(F.broadcast(nodes), "node")
    share = max(at.count() // SHARES, 1)
    crowded = at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share)  # at most 2 * SHARES rows
    crowded = F.broadcast(checkpoint(crowded.select("node", F.ceil(F.col("n") / share).alias("copies"))))
    dealt = at.join(crowded, "node", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "px", "py"), "copies"), F.lit(0)))
    copied = nodes.join(crowded, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("copies"), F.lit(1)) - 1)))
    return dealt.drop("copies").join(copied.drop("copies"), ["node", "salt"])


def _least(k: Column, x: Column, y: Column) -> Column:
    """Square of the least distance from a place to a box cut by its diagonals."""
    dx = F.greatest(k["x0"] - x, x - k["x1"], F.lit(0.0))
    dy = F.greatest(k["y0"] - y, y - k["y1"], F.lit(0.0))
    across = F.greatest(x + y - k["up"]["v"], k["down"]["v"] - x - y, x - y - k["right"]["v"], k["left"]["v"] - x + y)
    rounding = 1e-15 * (F.abs(x) + F.abs(y) + F.abs(k["x0"]) + F.abs(k["x1"]) + F.abs(k["y0"]) + F.abs(k["y1"]))
    across = F.greatest(across - rounding, F.lit(0.0))
    return F.greatest(dx * dx + dy * dy, across * across / 2)


def _sure(k: Column, x: Column, y: Column) -> Column:
    """Square of a distance within which the box has something: the far end of a nearer side, or an outermost point."""
    def ends(v: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = F.abs(v - low), F.abs(v - high)
        return F.least(a, b), F.greatest(a, b)

    def gap(p: Column) -> Column:
        return (x - p["x"]) * (x - p["x"]) + (y - p["y"]) * (y - p["y"])

    (near_x, far_x), (near_y, far_y) = ends(x, k["x0"], k["x1"]), ends(y, k["y0"], k["y1"])
    return F.least(near_x * near_x + far_y * far_y, far_x * far_x + near_y * near_y, *[gap(k[p]) for p in BOX[4:]])


def _within(value: str) -> Column:
    """Not beyond the bound, as far as rounding can tell."""
    px, py = F.col("px"), F.col("py")
    return F.col(value) <= F.col("bound") * (1 + SLACK[0]) + SLACK[1] * (1 + px * px + py * py)


def nearest_items(points: DataFrame, items: DataFrame, gap: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """id, gap, item: for each id of points(id, px, py) the least gap(item, px, py) and its item, the least of equal ones.

    items(item, ends) come with their corners; ``gap`` is a squared distance. Repeated points count once; an id at several
    places gets the item nearest to any of them. Points without a finite place take no part. No rows for no items.
    """
    px, py = F.col("px"), F.col("py")
    at = points.filter(_real(px, py)).select("id", "px", "py").distinct()
    at = at.repartition(-(-at.count() // POINTS) or 1, "id")  # Spark would join what is few bytes in one task
    at = at.withColumn("bound", F.lit(float("inf"))).withColumn("node", F.lit(0).cast("long"))
    levels = packed_tree(items)
    if not levels:
        kind = items.schema["item"].dataType
        return at.filter("false").select("id", F.lit(0.0).alias("gap"), F.lit(None).cast(kind).alias("item"))
    for depth in range(len(levels) - 1, 0, -1):
        met = _entered(at, *levels[depth]).select("id", "px", "py", "bound", F.explode("kids").alias("k"))
        met = met.select("id", "px", "py", "bound", "k.node", _least(F.col("k"), px, py).alias("least"), _sure(F.col("k"), px, py).alias("sure"))
        met = met.filter(_within("least")).withColumn("bound", F.min(F.least("bound", "sure")).over(Window.partitionBy("id")))
        at = met.filter(_within("least")).select("id", "px", "py", "bound", "node")
        if levels[depth - 1][1] > SMALL:
            at = checkpoint(at)  # read again to find crowded nodes
    met = _entered(at, *levels[0]).select("id", "px", "py", "bound", F.explode("kids").alias("item"))
    met = met.withColumn("gap", gap(F.col("item"), px, py)).filter(_within("gap"))
    return met.groupBy("id").agg(F.min(F.struct("gap", "item")).alias("best")).select("id", "best.gap", "best.item")


def pairs_nearest(points: DataFrame, sites: DataFrame) -> DataFrame:
    """zone_id, node_id, distance: the nearest of sites(node_id, x, y) to each of points(zone_id, x, y).

    Of equally near sites the smallest id is taken. Sites at one place are one item; those without a finite place take no
    part. Repeated points and empty tables as in ``nearest_items``.
    """
    one = sites.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("node_id").alias("node_id"))
    one = one.filter(_real(F.col("x"), F.col("y")))
    items = one.select(F.struct("node_id", "x", "y").alias("item"), F.array(F.struct("x", "y")).alias("ends"))

    def gap(s: Column, x: Column, y: Column) -> Column:
        return (x - s["x"]) * (x - s["x"]) + (y - s["y"]) * (y - s["y"])

    left = points.select(F.col("zone_id").alias("id"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    return nearest_items(left, items, gap).select(F.col("id").alias("zone_id"), "item.node_id", F.sqrt("gap").alias("distance"))


def _foot(s: Column, x: Column, y: Column) -> Column:
    """Where on segment s (0 at its start, 1 at its end) a place is nearest; 0 for a segment without length."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    t = F.try_divide((x - s["ax"]) * dx + (y - s["ay"]) * dy, dx * dx + dy * dy)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def _segment_gap(s: Column, x: Column, y: Column) -> Column:
    t = _foot(s, x, y)
    at = lambda a, b: F.when(t >= 1, b).otherwise(a + t * (b - a))  # noqa: E731  (ends are met exactly, so ties are ties)
    dx, dy = x - at(s["ax"], s["bx"]), y - at(s["ay"], s["by"])
    return dx * dx + dy * dy


def segments(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, section, ax, ay, bx, by, before, total: the segments of lines with the running length and the line's length.

    Points without a finite place are skipped; a line of one point is a segment without length, a line of none has no rows.
    """
    real = F.filter(line, lambda p: _real(p["x"], p["y"]))
    kept = lines.select(key, real.alias("p")).filter(F.size("p") > 0)
    kept = kept.withColumn("p", F.when(F.size("p") == 1, F.concat("p", "p")).otherwise(F.col("p")))
    n = F.size("p")
    pairs = F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n - 1), lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")))
    cut = kept.select(key, F.posexplode(pairs).alias("section", "s")).select(key, "section", "s.*")
    long = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    whole = Window.partitionBy(key)
    run = whole.orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("before", F.coalesce(F.sum(long).over(run), F.lit(0.0))).withColumn("total", F.sum(long).over(whole))


def _stretches(items: DataFrame) -> DataFrame:
    """item(s, x0, y0, x1, y1), ends: ``items`` of segments, those along an axis cut so that none of one line lie over one another in part.

    The ends of segments on one line are numbered, a segment is a few stretches between them whose lengths are powers of two
    in those numbers, and of the segments that have a stretch only the first can be an answer on it. So what is left of a
    line is less than twice the number of its ends, however many segments lie on it. Other segments stay whole (x0 is null).
    """
    s = F.col("item")
    level, upright = (s["ay"] == s["by"]) & (s["ax"] != s["bx"]), (s["ax"] == s["bx"]) & (s["ay"] != s["by"])
    pick = lambda a, b: F.when(upright, a).otherwise(b)
    least, most = F.least(pick(s["ay"], s["ax"]), pick(s["by"], s["bx"])), F.greatest(pick(s["ay"], s["ax"]), pick(s["by"], s["bx"]))
    line = ["upright", "across"]
    flat = checkpoint(items.filter(level | upright).select("item", upright.alias("upright"), pick(s["ax"], s["ay"]).alias("across"), least.alias("least"), most.alias("most")))
    marks = flat.select(*line, F.explode(F.array("least", "most")).alias("mark")).distinct()
    marks = checkpoint(marks.withColumn("number", (F.row_number().over(Window.partitionBy(*line).orderBy("mark")) - 1).cast("long")))
    named = lambda mark, number: marks.select(*line, F.col("mark").alias(mark), F.col("number").alias(number))
    spans = flat.join(named("least", "low"), [*line, "least"]).join(named("most", "high"), [*line, "most"])

    def both(k: Column) -> Column:
        low = F.call_function("shiftright", F.col("low") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        high = F.call_function("shiftright", F.col("high"), k)
        one = lambda place, has: F.struct(k.alias("size"), place.alias("place"), (has & (low < high)).alias("has"))
        return F.array(one(low, low % 2 == 1), one(high - 1, high % 2 == 1))

    sizes = F.sequence(F.lit(0), F.ceil(F.log2(F.col("high") - F.col("low") + 1)).cast("int"))
    cut = F.filter(F.flatten(F.transform(sizes, both)), lambda p: p["has"])
    best = spans.select(*line, "item", F.explode(cut).alias("p")).groupBy(*line, "p.size", "p.place").agg(F.min("item").alias("s"))
    at = lambda place: F.call_function("shiftleft", place, F.col("size"))
    best = best.withColumn("low", at(F.col("place"))).withColumn("high", at(F.col("place") + 1))
    best = best.join(named("least", "low"), [*line, "low"]).join(named("most", "high"), [*line, "high"])
    kept = lambda a, b: F.when(F.col("upright"), F.col(a)).otherwise(F.col(b))
    box = [kept("across", "least").alias("x0"), kept("least", "across").alias("y0"), kept("across", "most").alias("x1"), kept("most", "across").alias("y1")]
    corner = lambda n: F.struct(F.col(f"item.x{n}").alias("x"), F.col(f"item.y{n}").alias("y"))
    best = best.select(F.struct("s", *box).alias("item")).select("item", F.array(corner(0), corner(1)).alias("ends"))
    none = [F.lit(None).cast("double").alias(a) for a in ("x0", "y0", "x1", "y1")]
    return best.unionByName(items.filter(~(level | upright)).select(F.struct(F.col("item").alias("s"), *none).alias("item"), "ends"))


def _stretch_gap(k: Column, x: Column, y: Column) -> Column:
    dx, dy = F.greatest(k["x0"] - x, x - k["x1"], F.lit(0.0)), F.greatest(k["y0"] - y, y - k["y1"], F.lit(0.0))
    return F.when(k["x0"].isNull(), _segment_gap(k["s"], x, y)).otherwise(dx * dx + dy * dy)


def positions_on_nearest(points: DataFrame, lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """zone_id, line, distance, position: the nearest of lines(key, line, start, stop) to each of points(zone_id, x, y).

    The position is start + (stop - start) * (length up to the nearest place / length of the line), start for a line
    without length, null if start or stop is. Of equally near lines the smallest key is taken, on it the earliest segment.
    Keys are unique. Nulls, repeated points and empty tables as in ``nearest_items``.
    """
    places = ("ax", "ay", "bx", "by")
    # Of segments at one place only the first can be an answer: copies of a line are one item.
    first = F.min(F.struct(F.col(key).alias("key"), "section", "before", "total")).alias("f")
    cut = checkpoint(segments(lines, key, line).groupBy(*places).agg(first))
    corner = lambda a: F.struct(F.col(f"{a}x").alias("x"), F.col(f"{a}y").alias("y"))
    items = cut.select(F.struct("f.key", "f.section", *places, "f.before", "f.total").alias("item"), F.array(corner("a"), corner("b")).alias("ends"))
    left = points.select(F.col("zone_id").alias("id"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    found = nearest_items(left, _stretches(items), _stretch_gap).select("id", "gap", F.col("item.s").alias("item"))
    found = checkpoint(found.join(left.distinct(), "id"))
    # Beside or on a segment, rounding decides between the segments of a line: there all of them are tried.
    s = F.col("item")
    close = F.col("gap") <= CLOSE * sum(c * c for c in (F.col("px"), F.col("py"), *[s[p] for p in places]))
    close = found.filter(close).select("id").distinct()
    if not close.isEmpty():
        again = nearest_items(left.join(close, "id", "left_semi"), items, _segment_gap).join(left.distinct(), "id")
        found = found.join(close, "id", "left_anti").unionByName(again)
    # An id at several places: the one that is as near as the least gap.
    found = found.filter(_segment_gap(F.col("item"), F.col("px"), F.col("py")) == F.col("gap"))
    long = F.sqrt((s["bx"] - s["ax"]) * (s["bx"] - s["ax"]) + (s["by"] - s["ay"]) * (s["by"] - s["ay"]))
    share = F.coalesce(F.try_divide(s["before"] + long * _foot(s, F.col("px"), F.col("py")), s["total"]), F.lit(0.0))
    share = found.groupBy("id", F.col("item.key").alias(key), F.sqrt("gap").alias("distance")).agg(F.min(share).alias("share"))
    ends = lines.select(key, "start", "stop")
    return share.join(ends, key).select(F.col("id").alias("zone_id"), key, "distance", (F.col("start") + (F.col("stop") - F.col("start")) * F.col("share")).alias("position"))
