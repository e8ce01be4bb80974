"""Geography as column expressions: distances, tiles, the Hilbert curve, polylines.

A point is a struct (lon, lat) in degrees, a polyline an array of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in metres, metres of a degree of latitude, edge of a tile in degrees.
EARTH_RADIUS, METRES_PER_DEGREE, TILE_DEGREES = 6_371_008.8, 111_320.0, 0.2
LEAST = 2.220446049250313e-16


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def flat_distance(lon: Column, lat: Column, to_lon: Column, to_lat: Column) -> Column:
    """Metres on a plane that touches the globe at the second point; good for short distances."""
    dx, dy = (lon - to_lon) * METRES_PER_DEGREE * F.cos(F.radians(to_lat)), (lat - to_lat) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def between(a: Column, b: Column) -> Column:
    return haversine(a["lon"], a["lat"], b["lon"], b["lat"])


def shrink(lat: Column) -> Column:
    """How much a degree of longitude shrinks at a latitude, at least 0.01."""
    return F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.01))


def window_degrees(lat: Column, metres: Column) -> tuple[Column, Column]:
    """Half width in longitude and half height in latitude of a box around a point."""
    return metres / (F.lit(METRES_PER_DEGREE) * shrink(lat)), metres / F.lit(METRES_PER_DEGREE)


def tile(degrees: Column, size: float = TILE_DEGREES) -> Column:
    return F.floor(degrees / F.lit(size)).cast("int")


def neighbours(x: Column, y: Column) -> Column:
    """The nine tiles around and including (x, y), by x and then y."""
    return F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))


def packed(x: Column, y: Column) -> Column:
    """A tile as one number, in the order of x and then y: sets of numbers are hashed, those of structs compared pair by pair."""
    return x.cast("bigint") * (1 << 32) + (y.cast("bigint") + (1 << 31))


def unpacked(tiles: Column) -> Column:
    """Tiles from their numbers."""
    return F.transform(tiles, lambda k: F.struct(F.shiftright(k, 32).cast("int").alias("x"), (k.bitwiseAND((1 << 32) - 1) - (1 << 31)).cast("int").alias("y")))


def crossing(k: Column) -> Column:
    """The numbers of a tile and of the four that share an edge with it."""
    return F.array(k, k - (1 << 32), k + (1 << 32), k - 1, k + 1)


def corridor(a: Column, b: Column) -> Column:
    """Tiles along a straight line between two points, each with its cross; without repeats."""
    return unpacked(packed_corridor(a, b))


def packed_corridor(a: Column, b: Column) -> Column:
    ta, tb = (F.struct(tile(p["lon"]).alias("x"), tile(p["lat"]).alias("y")) for p in (a, b))
    steps = ((F.greatest(F.abs(tb["x"] - ta["x"]), F.abs(tb["y"] - ta["y"])) + 1) * 2).cast("int")
    at = lambda i, n: packed(tile(a["lon"] + i / n * (b["lon"] - a["lon"])), tile(a["lat"] + i / n * (b["lat"] - a["lat"])))
    along = let(steps, lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: at(i, n))))
    return F.when((ta["x"] == tb["x"]) & (ta["y"] == tb["y"]), crossing(packed(ta["x"], ta["y"]))).otherwise(F.array_distinct(F.flatten(F.transform(along, crossing))))


def route_tiles(points: Column) -> Column:
    """Sorted tiles that a path through these stops may touch."""
    of = lambda p: F.struct(tile(p["lon"]).alias("x"), tile(p["lat"]).alias("y"))

    def hop(a: Column, b: Column) -> Column:
        ta, tb = of(a), of(b)
        same = (ta["x"] == tb["x"]) & (ta["y"] == tb["y"])
        near = (F.abs(ta["x"] - tb["x"]) <= 1) & (F.abs(ta["y"] - tb["y"]) <= 1)
        around = lambda t: F.array(*(packed(t["x"] + dx, t["y"] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
        return F.when(same, around(ta)).when(near, F.concat(around(ta), around(tb))).otherwise(packed_corridor(a, b))

    hops = F.transform(F.sequence(F.lit(2), F.greatest(F.size(points), F.lit(2))), lambda i: F.when(i <= F.size(points), hop(F.get(points, i - 2), F.get(points, i - 1))))
    alone = F.get(points, F.lit(0))
    return F.when(F.size(points) == 1, neighbours(of(alone)["x"], of(alone)["y"])).when(F.size(points) == 0, F.expr("cast(array() as array<struct<x:int,y:int>>)")).otherwise(unpacked(F.sort_array(F.array_distinct(F.flatten(hops)))))


def hilbert(lon: Column, lat: Column, order: int = 16) -> Column:
    """Index along a Hilbert curve over the whole globe, 2 ** order cells a side."""
    side = 1 << order
    cell = lambda v, low, span: F.least(F.greatest((v + low) / span * side, F.lit(0.0)), F.lit(side - 1.0)).cast("bigint")
    start = F.struct(cell(lon, 180.0, 360.0).alias("x"), cell(lat, 90.0, 180.0).alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(s: Column, bit: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
        rx, ry = (s["x"].bitwiseAND(size) > 0).cast("bigint"), (s["y"].bitwiseAND(size) > 0).cast("bigint")
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, side - 1 - s["x"]).otherwise(s["x"]), F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), (s["d"] + size * size * (3 * rx).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0)), start, step, lambda s: s["d"])


def lengths(line: Column) -> Column:
    """Metres of each segment."""
    return F.transform(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: between(F.get(line, i), p))


def total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def project(line: Column, p: Column) -> Column:
    """Struct (lon, lat, metres, progress) of the nearest place on a polyline; the first wins a tie; null without length."""
    scale = shrink(p["lat"])

    def nearest(parts: Column) -> Column:
        whole = total(parts)
        none = F.struct(F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("metres"), F.lit(None).cast("double").alias("progress"), F.lit(0.0).alias("before"))

        def step(s: Column, i: Column) -> Column:
            a, b = F.get(line, i), F.get(line, i + 1)
            dx, dy = (b["lon"] - a["lon"]) * scale, b["lat"] - a["lat"]
            square = dx * dx + dy * dy
            t = F.when(square <= LEAST, 0.0).otherwise(F.least(F.greatest(((p["lon"] - a["lon"]) * scale * dx + (p["lat"] - a["lat"]) * dy) / square, F.lit(0.0)), F.lit(1.0)))

            def better(t: Column) -> Column:
                lon, lat = a["lon"] + (b["lon"] - a["lon"]) * t, a["lat"] + (b["lat"] - a["lat"]) * t
                metres, part = haversine(p["lon"], p["lat"], lon, lat), F.get(parts, i)
                here = F.struct(lon.alias("lon"), lat.alias("lat"), metres.alias("metres"), F.least(F.greatest((s["before"] + part * t) / whole, F.lit(0.0)), F.lit(1.0)).alias("progress"), (s["before"] + part).alias("before"))
                kept = F.struct(s["lon"].alias("lon"), s["lat"].alias("lat"), s["metres"].alias("metres"), s["progress"].alias("progress"), (s["before"] + part).alias("before"))
                return F.when(s["metres"].isNull() | (metres < s["metres"]), here).otherwise(kept)

            return let(t, better)

        found = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), none, step)
        return F.when((F.size(parts) > 0) & (whole > LEAST), found)

    return let(lengths(line), nearest)


def turn_angle(via: Column, a: Column, b: Column) -> Column:
    """Degrees between the directions from `via` to two points; 0 where one coincides with it."""
    dx1, dy1, dx2, dy2 = a["lon"] - via["lon"], a["lat"] - via["lat"], b["lon"] - via["lon"], b["lat"] - via["lat"]
    m1, m2 = F.sqrt(dx1 * dx1 + dy1 * dy1), F.sqrt(dx2 * dx2 + dy2 * dy2)
    inner = F.least(F.greatest((dx1 * dx2 + dy1 * dy2) / (m1 * m2), F.lit(-1.0)), F.lit(1.0))
    return F.when((m1 == 0) | (m2 == 0), 0.0).otherwise(F.degrees(F.acos(inner)))
