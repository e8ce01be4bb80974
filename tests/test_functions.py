import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import colours, geo, modes, tags, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def tag_map(**tags_):
    return F.create_map(*(F.lit(x) for pair in tags_.items() for x in pair)) if tags_ else F.expr("cast(map() as map<string,string>)")


#: One case for each step of the rules: what a key says, and which key has the last word over another.
@pytest.mark.parametrize(
    ("found", "kept"),
    [
        ({"highway": "service"}, False),
        ({"highway": "steps"}, False),
        ({"highway": "tertiary", "access": "no"}, False),
        ({"highway": "tertiary", "access": "no", "vehicle": "yes"}, True),
        ({"highway": "tertiary", "vehicle": "yes", "motor_vehicle": "no"}, False),
        ({"highway": "tertiary", "motor_vehicle": "no", "psv": "yes"}, True),
        ({"highway": "tertiary", "psv": "no", "bus": "designated"}, True),
        ({"highway": "tertiary", "psv": "yes", "bus": "no"}, False),
        ({"highway": "cycleway", "psv": "yes"}, True),
        ({"bus": "yes"}, True),
        ({"bus": "no"}, False),
        ({"name": "Lane"}, False),
    ],
)
def test_bus_ways(spark, found, kept):
    assert value(spark, tags.bus_way_kept(tag_map(**found))) is kept


def test_shape_ids(spark):
    stops = lambda *s: text.stop_hash(F.array(*(F.lit(x) for x in s)))
    h = stops("STOP-1", "STOP-2", "STOP-3")
    # Fixed value: an id that must come out the same.
    assert value(spark, text.short_shape_id(F.lit("Blue"), h, F.lit(0x123ABC))) == "shp-Blue-7b5692-123abc"
    assert value(spark, text.short_shape_id(F.lit("T&T 東京"), h, F.lit(1))).startswith("shp-T%26T%20%E6%9D%B1%E4%BA%AC-")
    seen = [value(spark, x) for x in (h, stops("STOP-3", "STOP-2", "STOP-1"), stops("STOP-1", "STOP-2"), stops("a", "bc"), stops("ab", "c"), stops(""))]
    assert len(set(seen)) == len(seen)
    long = [value(spark, text.long_shape_id(F.lit("Blue"), h, F.lit(r), F.lit(1))) for r in ("r1", "r2")]
    assert long[0] != long[1]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("S 7", "s7", True), ("U-4", "u4", True), ("Night 12", "12", True), ("12", "12 Night", True), ("Night12", "12", False), ("12", "112", False), ("S7", "S77", False), ("...", "!", False), ("M1", "", False), ("", "", True), ("Coast Express", "coast express", True)],
)
def test_line_names(spark, a, b, same):
    from tramline.operators.routing import alike

    assert value(spark, text.similar_lines(F.lit(a), F.lit(b))) is same
    assert alike(a, b) is same


@pytest.mark.parametrize(("css", "back", "front"), [("#FF0000", "FF0000", "000000"), ("white", "FFFFFF", "000000"), ("black", "000000", "FFFFFF"), ("#abc", "AABBCC", "000000"), ("rgb(1, 2, 300)", "0102FF", "FFFFFF"), ("no colour", None, None), ("chocolate", "D2691E", "000000"), (" RebeccaPurple ", "663399", "FFFFFF"),
    ("rgb(50%, 0%, 100.0%)", "8000FF", "FFFFFF"), ("rgba(1 2 3 / 40%)", "010203", "FFFFFF"), ("rgb(1.5, -4, .5)", "020001", "FFFFFF"), ("hsl(120, 100%, 25%)", "008000", "FFFFFF"), ("hsl(-.5turn 100% 50%)", "00FFFF", "000000"), ("hsla(200grad, 100%, 50%, 0.2)", "00FFFF", "000000"),
    ("hsl(3.14159265358979rad 100% 50%)", "00FFFF", "000000"), ("hwb(0 0% 0%)", "FF0000", "000000"), ("hwb(90deg 80% 80%)", "808080", "000000"), ("hwb(240 20% 40%)", "333399", "FFFFFF"), ("hsl(1, 2, 3)", None, None), ("rgb(1, 2)", None, None), ("rgb(1, 2, x)", None, None), ("rgb()", None, None), ("#12345", None, None)])
def test_colours(spark, css, back, front):
    assert value(spark, colours.hex_colour(F.lit(css))) == back
    assert value(spark, colours.text_colour(colours.hex_colour(F.lit(css)))) == front


def test_projection(spark):
    at = lambda x, y: geo.point(F.lit(x), F.lit(y))
    p = value(spark, geo.project(F.array(at(0.0, 0.0), at(0.01, 0.0)), at(0.005, 0.001)))
    assert 0.45 <= p["progress"] < 0.55 and 100 <= p["metres"] < 125
    assert value(spark, geo.project(F.array(at(0.0, 0.0), at(0.0, 0.0)), at(0.005, 0.001))) is None


def test_hilbert(spark):
    near, other, far = (value(spark, geo.hilbert(F.lit(x), F.lit(y))) for x, y in ((-122.4, 37.8), (-122.41, 37.81), (-0.1, 51.5)))
    assert abs(near - other) < abs(near - far)
    world = spark.range(-180, 181, 30).select(F.col("id").cast("double").alias("lon")).crossJoin(spark.range(-90, 91, 30).select(F.col("id").cast("double").alias("lat")))
    rows = world.select("lon", "lat", geo.hilbert(F.col("lon"), F.col("lat")).alias("d")).orderBy("d").collect()
    assert all(abs(a["lon"] - b["lon"]) + abs(a["lat"] - b["lat"]) < 200 for a, b in zip(rows, rows[1:], strict=False))


def test_route_tiles(spark):
    at = lambda x, y: geo.point(F.lit(x), F.lit(y))
    found = value(spark, geo.route_tiles(F.array(at(-122.4, 37.8), at(-122.35, 37.85))))
    assert found and len(found) == len(set(found)) and found == sorted(found)
    assert len(value(spark, geo.route_tiles(F.array(at(0.1, 0.1))))) == 9
    assert value(spark, geo.route_tiles(F.expr("cast(array() as array<struct<lon:double,lat:double>>)"))) == []


def test_modes():
    assert modes.parse_modes("bus, Metro,,light-rail") == {"Bus", "Subway", "Tram"}
    assert modes.parse_modes("all") == set(modes.CATEGORIES)
    with pytest.raises(ValueError, match="other"):
        modes.parse_modes("other")
    assert modes.profile_of_set({"Tram"}) == "TramSubway" and modes.profile_of_set({"Tram", "Rail"}) == "Generic" and modes.profile_of_set(set()) == "Generic"


def test_a_long_corridor_has_each_tile_once(spark):
    """Sets of tiles are kept as numbers, whatever their signs; 60 hops of 900 tiles take no pairwise comparison."""
    rows = [(i, (-7.5 + i * 0.01, -60.0), (8.0, 119.0 - i)) for i in range(60)]
    hops = spark.createDataFrame(rows, "i int, a struct<lon:double,lat:double>, b struct<lon:double,lat:double>")
    for (i, a, b), found in zip(rows, hops.select("i", geo.corridor(F.col("a"), F.col("b")).alias("t"), geo.route_tiles(F.array("a", "b")).alias("r")).orderBy("i").collect(), strict=True):
        tile = lambda v: math.floor(v / 0.2)
        steps = (max(abs(tile(b[0]) - tile(a[0])), abs(tile(b[1]) - tile(a[1]))) + 1) * 2
        along = {(tile(a[0] + k / steps * (b[0] - a[0])), tile(a[1] + k / steps * (b[1] - a[1]))) for k in range(steps + 1)}
        plain = {(x + dx, y + dy) for x, y in along for dx, dy in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))}
        assert {tuple(t) for t in found["t"]} == plain and len(found["t"]) == len(plain) and [tuple(t) for t in found["r"]] == sorted(plain)


def test_hops_are_dealt_over_tasks_by_their_number(spark, tmp_path):
    from tramline.plans import timetable_queries as t

    spark.range(1000).select(F.col("id").alias("s_suppkey"), F.lit(1.0).alias("s_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert t.hops(spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_colours_are_dealt_over_tasks_by_their_number(spark, tmp_path):
    from tramline.plans import timetable_queries as t

    spark.range(25_000).select(F.col("id").alias("p_partkey"), F.lit("red x").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = t.css_colours(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3 and found.where("colour = 'red'").count() == 1
