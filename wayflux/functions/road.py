"""Column expressions for road links: classes, speeds, costs, flood rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, here and in the formulas of `legacy_voc`, `operating_cost` (1.4 and the pence), `legacy_flood_speed` and the car factor of `time_cost`.
METRE_TO_MILE = 0.000621371
MILE_TO_KM = 1.60934
VALUE_OF_TIME = {"car": 21.41, "lgv": 16.87, "ogv": 20.35, "psv": 13.15, "rail": 38.28}
FUEL = {"car": (0.46693, 0.08257, -0.00088, 0.000006), "lgv": (0.40392, 0.15318, -0.00467, 0.000033), "ogv": (4.18094, 0.21864, -0.00298, 0.000023), "psv": (3.36019, 0.29525, -0.00321, 0.000024)}
NON_FUEL = {"car": (6.885, 188.486), "lgv": (10.001, 65.321), "ogv": (13.709, 535.418), "psv": (42.233, 962.974)}
PRIMARY = ("trunk", "a class", "a road", "primary")
SECONDARY = ("b class", "b road", "secondary")
SLOWING = {"M": 0.033, "A_dual": 0.033, "A_single": 0.05, "B": 0.05, "B_dual": 0.05, "B_single": 0.05}
LEVELS = ("no", "minor", "moderate", "extensive", "severe")
#: Upper ends (cm) of depth bands and the level in each band, by flood type and road group.
BANDS = (50, 100, 200, 600)
BAND_LEVELS = {
    ("surface", "tunnel"): ("no", "minor", "moderate", "extensive", "severe"),
    ("surface", "major"): ("no", "no", "no", "minor", "moderate"),
    ("surface", "other"): ("no", "no", "minor", "minor", "moderate"),
    ("river", "tunnel"): ("no", "minor", "minor", "moderate", "extensive"),
    ("river", "major"): ("no", "minor", "moderate", "extensive", "severe"),
    ("river", "other"): ("minor", "moderate", "moderate", "extensive", "severe"),
}


def lookup(key: Column, table: dict) -> Column:
    """A small fixed table as a column; null where the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def combined_label(classification: Column, form: Column) -> Column:
    """M, B, A_single, or A_dual for all else; case does not count."""
    c, f = F.lower(F.coalesce(classification, F.lit(""))), F.lower(F.coalesce(form, F.lit("")))
    return F.when(c.isin(*PRIMARY) & f.contains("single"), "A_single").when(c.isin(*SECONDARY), "B").when(c == "motorway", "M").otherwise("A_dual")


def initial_speed(free: Column, lowest: Column, most: Column | None) -> Column:
    """Free-flow speed; under a restriction below the lowest speed 0 (closed), else the lesser of both."""
    if most is None:
        return free
    return F.when(most < lowest, 0.0).when((most >= lowest) & (most < free), most).otherwise(free)


def flow_speed(label: Column, flow: Column, initial: Column, lowest: Column, breakpoint_: Column) -> Column:
    """Speed under a daily flow: it falls once the hourly flow exceeds the breakpoint, down to the lowest speed."""
    excess = F.greatest(flow / 24.0 - breakpoint_, F.lit(0.0))
    return F.greatest(initial - F.coalesce(lookup(label, SLOWING), F.lit(0.0)) * excess, lowest)


def time_cost(hours: Column, vehicle: str) -> Column:
    return hours * ((1.06 if vehicle == "car" else 1.0) * VALUE_OF_TIME[vehicle])


def operating_cost(hours: Column, miles: Column, vehicle: str) -> Column:
    """Fuel and other distance costs in pounds; public transport has none here."""
    if vehicle in ("psv", "rail"):
        return F.lit(0.0)
    km = miles * MILE_TO_KM
    v = F.greatest(km / F.greatest(hours, F.lit(1e-6)), F.lit(1e-6))
    a, b, c, d = FUEL[vehicle]
    a1, b1 = NON_FUEL[vehicle]
    return ((F.lit(a) / v + b + v * c + v * v * d) * 1.4 + (F.lit(a1) + F.lit(b1) / v) / 100.0) * km


def legacy_voc(speed: Column) -> Column:
    """Vehicle operating cost per km by speed; null at speed 0."""
    return F.when(speed != 0, (F.lit(0.178) - speed * 0.00299 + speed * speed * 0.0000205) * 1.4)


def flood_speed(depth_cm: Column, free: Column, threshold: float = 30.0) -> Column:
    """Highest speed on a flooded road; 0 from the threshold on."""
    return F.when(depth_cm < threshold, free * F.pow(depth_cm / threshold - 1, F.lit(2.0))).otherwise(0.0)


def legacy_flood_speed(depth_mm: Column, lowest: Column) -> Column:
    """Quadratic in the depth (kph to mph) under 300 mm; below the class's lowest speed 0; one decimal, half to even."""
    v = (depth_mm * depth_mm * 0.0009 - depth_mm * 0.5529 + 86.9448) / MILE_TO_KM
    return F.bround(F.when((depth_mm < 300) & (v >= lowest), v).otherwise(0.0), 1)


def is_major(classification: Column, trunk: Column) -> Column:
    return (classification == "Motorway") | ((classification == "A Road") & trunk)


def road_group(label: Column, classification: Column, trunk: Column) -> Column:
    """tunnel (of a major road), major, other."""
    return F.when(~F.coalesce(is_major(classification, trunk), F.lit(False)), "other").when(label == "tunnel", "tunnel").otherwise("major")


def damage_level(flood: str, depth_cm: Column, group: Column) -> Column:
    """Level of damage by depth band; null for a null depth; no water does nothing to a road by a river."""
    def of(levels: tuple[str, ...]) -> Column:
        out = F.when(depth_cm < BANDS[0], levels[0])
        for end, level in zip(BANDS[1:], levels[1:]):
            out = out.when(depth_cm < end, level)
        return out.when(depth_cm.isNotNull(), levels[-1])

    out = F.when(group == "tunnel", of(BAND_LEVELS[flood, "tunnel"])).when(group == "major", of(BAND_LEVELS[flood, "major"]))
    other = of(BAND_LEVELS[flood, "other"])
    return out.otherwise(F.when(depth_cm <= 0, "no").otherwise(other) if flood == "river" else other)


def level_rank(level: Column) -> Column:
    return lookup(level, {name: i for i, name in enumerate(LEVELS)})


def level_name(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(LEVELS)))


def embankment_depth(depth: Column, classification: Column, trunk: Column, offset: float) -> Column:
    """Depth above the embankment of major roads, at least 0; other roads lie at ground level."""
    return F.when(is_major(classification, trunk), F.greatest(depth - offset, F.lit(0))).otherwise(depth)


def cost_key(classification: Column, form: Column, urban: Column, lanes: Column) -> Column:
    """The unit cost key of a road or tunnel."""
    place = F.when(urban == 1, "urb").otherwise("sub")
    motorway = F.concat(F.lit("m_"), F.when(lanes >= 8, "ge8").otherwise("lt8"), F.lit("_"), place)
    single = F.concat(F.when(classification == "A Road", "a").otherwise("b"), F.lit("single_"), place)
    dual = F.concat(F.lit("abdual_"), F.when(lanes >= 6, "ge6").otherwise("lt6"), F.lit("_"), place)
    return F.when(classification == "Motorway", motorway).when(form == "Single Carriageway", single).otherwise(dual)
