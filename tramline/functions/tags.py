"""Rules over OpenStreetMap tags, held as tables and turned into column expressions.

A rule is a pair of a key and either the values that match or ANY. Rules in a
tuple are alternatives. Rule tables with outcomes are tested in order, and the
first match decides.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions import modes as m

ANY = None
YES = ("yes",)

# Access keys from the most to the least specific, and how their values read.
ACCESS_KEYS = ("bus", "psv", "motor_vehicle", "vehicle", "access")
ACCESS_ALLOWED = ("yes", "designated", "permissive", "private", "destination", "delivery", "customers", "permit", "bus", "psv")
ACCESS_DENIED = ("no",)

# What makes the bus network.
BUS_DROP = (("area", YES), ("type", ("multipolygon",)), ("railway", ("platform", "station")), ("highway", ("proposed", "footway", "construction")), ("building", ("yes", "train_station")), ("leisure", ("garden", "park")))
BUS_WAY_DROP = (*BUS_DROP, ("public_transport", ("stop_area",)))
BUS_RELATION_DROP = (*BUS_DROP, ("train", YES))
BUS_KEEP = (
    (
        "highway",
        (
            *("motorway", "trunk", "primary", "secondary", "tertiary", "residential"),
            *("motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "residential_link"),
            *("living_street", "unclassified", "bus_guideway", "bus_stop"),
        ),
    ),
    ("way", ("primary", "seconday", "bus_guideway")),
    ("busway", ANY),
    *((k, ("yes", "designated")) for k in ("psv", "bus", "minibus")),
    *((k, YES) for k in ("trolley_wire", "trolleywire", "trolleybus", "trolley_bus")),
    ("route", ("bus", "trolleybus")),
    ("bus:lanes", ("yes", "designated", "1")),
    ("lanes:bus", ("1", "2", "3")),
    ("lanes:psv", ("1", "2", "3")),
    ("bus_stop", ANY),
    ("stop", ANY),
    ("public_transport", ("stop_position",)),
)
RESTRICTION_TYPES = ("restriction", "restriction:bus", "restriction:motorcar")
# Turn restrictions that concern buses.
NEGATIVE_TURNS = ("no_left_turn", "no_right_turn", "no_straight_on", "no_u_turn")
POSITIVE_TURNS = ("only_left_turn", "only_right_turn", "only_straight_on")

# Drop and keep rules of the other profiles, for ways and relations alike.
_RAILED = ("subway", "light_rail", "tram")
_STOPS = ("station", "halt", "tram_stop")
_TRAM_DROP = (("area", YES), ("public_transport", ("stop_area", "platform")), ("type", ("multipolygon",)), ("railway", ("platform",)), ("service", ("alley",)))
DROP = {
    "Rail": (
        ("railway", ("abandoned", "construction", "disused", "miniature", "signal", "razed", "proposed", "platform")),
        ("metro", YES),
        ("area", YES),
        ("type", ("multipolygon",)),
        ("public_transport", ("platform",)),
        ("building", ("yes", "train_station", "roof")),
        ("amenity", ("shelter", "bus_station")),
    ),
    "TramSubway": _TRAM_DROP,
    "Gondola": _TRAM_DROP,
    "Funicular": _TRAM_DROP,
    "Ferry": (),
}
KEEP = {
    "Rail": (("railway", ("rail", "light_rail", "tram", "narrow_gauge")), ("route", ("rail", "light_rail", "train"))),
    "TramSubway": (("route", ("tram", "funicular", "subway", "light_rail")), ("railway", (*_RAILED, "funicular", *_STOPS)), ("subway", YES), ("tram", YES)),
    "Gondola": (("aerialway", ("gondola", "cable_car", "chair_lift", "mixed_lift")),),
    "Funicular": (("route", ("funicular", "tram", "subway", "light_rail")), ("railway", ("funicular", "narrow_gauge", *_RAILED, *_STOPS)), ("subway", YES), ("tram", YES)),
    "Ferry": (("route", ("ferry",)), ("waterway", ("river",)), ("motorboat", YES), ("ferry", YES), ("amenity", ("ferry_terminal",)), ("mooring", ("ferry",)), ("station", ("ferry",))),
}
FLAT_RELATION = (("public_transport", ("stop_area",)),)

# Bits of node flags, and the tags that set them.
STATION, TURN_CYCLE, RESTRICTION = 1, 2, 4
_STOP_NODE = (("public_transport", ("stop_position",)), ("stop", ANY))
_TRAM_NODE = (*_STOP_NODE, ("tram_stop", ANY), ("station", ("subway", "tram")), ("railway", ("stop", "halt", "station", "tram_stop", "subway_stop")))
_BUS_NODE = (*_STOP_NODE, ("bus_stop", ANY), ("highway", ("bus_stop",)), ("amenity", ("bus_station",)))
STATION_NODE = {
    "Bus": _BUS_NODE,
    "Generic": _BUS_NODE,
    "Rail": (*_STOP_NODE, ("tram_stop", ANY), ("railway", ("stop", "halt", "station", "subway_stop"))),
    "TramSubway": _TRAM_NODE,
    "Funicular": _TRAM_NODE,
    "Gondola": (*_TRAM_NODE, ("aerialway", ("station", "stop"))),
    "Ferry": (*_STOP_NODE, ("ferry", YES), ("amenity", ("ferry_terminal",)), ("mooring", ("ferry",)), ("station", ("ferry",)), ("railway", ("stop", "halt", "station"))),
}
TURN_NODE = (("highway", ("turning_circle", "turning_loop", "mini_roundabout")), ("junction", ("roundabout",)))


# Road and track levels; the first match decides, 0 where none matches.
_RAIL_1 = (("usage", ("branch",)),)
_RAIL_2 = (("railway", ("tram",)), ("service", ("siding",)))
_RAIL_3 = (("service", ("crossover", "yard")),)
_RAIL_5 = (("usage", ("industrial", "military", "test")), ("service", ("spur",)), ("railway:traffic_mode", ("freight",)))
LEVELS = {
    "Bus": (
        (1, (("highway", ("trunk", "trunk_link", "primary", "primary_link")),)),
        (2, (("highway", ("secondary", "secondary_link")), *((k, ("yes", "designated")) for k in ("bus", "minibus", "psv")), ("access", ("psv", "bus")), *((k, YES) for k in ("trolley_wire", "trolleywire", "trolleybus", "trolley_bus")))),
        (3, (("highway", ("tertiary", "tertiary_link")),)),
        (4, (("highway", ("unclassified", "residential", "road")),)),
        (5, (("highway", ("living_street", "pedestrian", "service")), ("psv", ("no",)))),
        (6, (("bus", ("no",)), ("service", ("siding", "parking_aisle")), ("access", ("permissive", "private", "no")), ("highway", ("footway", "track")))),
    ),
    "Coach": (
        (0, (("highway", ("motorway", "motorway_link")),)),
        (1, (("highway", ("trunk", "trunk_link")),)),
        (2, (("highway", ("primary", "primary_link")),)),
        (3, (("highway", ("secondary", "secondary_link")),)),
        (4, (("highway", ("tertiary", "tertiary_link")),)),
        (5, (("highway", ("unclassified", "residential", "road", "service")),)),
        (6, (("highway", ("living_street", "pedestrian")), ("psv", ("no",)))),
        (7, (("bus", ("no",)), ("service", ("siding", "parking_aisle")), ("access", ("permissive", "private", "no")), ("highway", ("footway",)))),
    ),
    "Rail": ((1, _RAIL_1), (2, _RAIL_2), (3, _RAIL_3), (5, _RAIL_5)),
    "TramSubway": ((2, (("service", ("siding",)),)), (3, (("railway", ("funicular",)), ("route", ("funicular",)))), (5, (("service", ("crossover", "yard")),))),
    "Funicular": (
        (2, (("service", ("siding",)),)),
        (3, (("route", ("tram", "narrow_gauge", "subway", "light_rail")), ("railway", ("narrow_gauge", *_RAILED, *_STOPS)), ("subway", YES), ("tram", YES))),
        (5, (("service", ("crossover", "yard")),)),
    ),
    "Ferry": (),
    "Gondola": (),
    "Generic": ((5, _RAIL_5), (3, _RAIL_3), (2, _RAIL_2), (1, _RAIL_1)),
}
# Direction of travel (0 both, 1 forward, 2 backward); the first match decides, 0 where none matches.
_DIRECTION = "railway:preferred_direction"
_BIDIRECTIONAL = "railway:bidirectional"
_SIMPLE = ((1, (("oneway", YES),)),)
ONEWAY = {
    "Bus": (
        (
            0,
            (
                ("oneway", ("false", "0", "alternating", "reversible", "no")),
                *((k, ("no", "0", "false")) for k in ("oneway:bus", "oneway:psv")),
                *((k, ("opposite_lane", "opposite")) for k in ("busway", "psv")),
                *((k, ("opposite_lane",)) for k in ("busway:left", "busway:right")),
                *((k, ("1", "2")) for k in ("lanes:psv:backward", "lanes:bus:backward")),
                ("bus:lanes:backward", ("yes", "designated", "1")),
            ),
        ),
        (2, (("oneway", ("-1",)),)),
        (1, (("junction", ("roundabout",)), ("highway", ("motorway",)), *((k, ("yes", "1", "true")) for k in ("oneway", "oneway:bus", "oneway:psv")))),
    ),
    "Rail": (
        (0, (("oneway", ("false", "no", "-1")), (_DIRECTION, ("both",)), (_BIDIRECTIONAL, ("regular",)))),
        (2, ((_DIRECTION, ("backward",)),)),
        (1, (("oneway", YES), (_DIRECTION, ("forward",)))),
    ),
    "TramSubway": _SIMPLE,
    "Gondola": _SIMPLE,
    "Funicular": _SIMPLE,
    "Ferry": (),
    "Generic": (
        (0, (("oneway", ("no", "false")), (_DIRECTION, ("both",)), (_BIDIRECTIONAL, ("regular",)))),
        (1, (("oneway", ("yes", "true", "1")),)),
        (2, (("oneway", ("-1",)),)),
        (1, ((_DIRECTION, ("forward",)),)),
        (2, ((_DIRECTION, ("backward",)),)),
    ),
}
ONEWAY["Coach"] = ONEWAY["Bus"]
PREFERRED = ((1, ((_DIRECTION, ("forward",)),)), (2, ((_DIRECTION, ("backward",)),)))

# Speeds in km/h by level.
_FAST, _PLAIN, _WATER = (120, 90, 65, 50, 30, 20, 10, 5), (85, 70, 55, 40, 30, 20, 10, 5), (70, 60, 50, 35, 30, 25, 10, 5)
SPEEDS = {"Rail": _FAST, "Coach": _FAST, "Bus": _PLAIN, "TramSubway": _PLAIN, "Gondola": _PLAIN, "Funicular": _PLAIN, "Generic": _PLAIN, "Ferry": _WATER}
# How much dearer the wrong way along a one-way edge is: factor, and tenths of a second to enter.
WRONG_WAY = {"Rail": (5, 3000), "Bus": (5, 3000), "Coach": (5, 3000), "TramSubway": (2, 0), "Ferry": (2, 0), "Gondola": (2, 0), "Funicular": (2, 0), "Generic": (5, 0)}
# Speeds in km/h from road and track classes, for networks without levels.
ROAD_KMH = {"motorway": 100, "trunk": 80, "primary": 70, "secondary": 60, "tertiary": 50, "residential": 30, "living_street": 10, "footway": 4, "pedestrian": 4}
TRACK_KMH = {"rail": 100, "tram": 40, "subway": 80}
INFINITE = 4_294_967_295


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def matches(tags: Column, rules: tuple) -> Column:
    """Whether any rule matches; never null."""
    tests = [tag(tags, k).isNotNull() if v is ANY else F.coalesce(tag(tags, k).isin(*v), F.lit(False)) for k, v in rules]
    return reduce(or_, tests) if tests else F.lit(False)


def first_match(tags: Column, table: tuple, default: int = 0) -> Column:
    out = None
    for value, rules in table:
        test = matches(tags, rules)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(default) if out is None else out.otherwise(default)


def bus_access(tags: Column) -> Column:
    """allow, deny or null: what the most specific access key with a known value says."""
    read = [F.when(tag(tags, k).isin(*ACCESS_DENIED), "deny").when(tag(tags, k).isin(*ACCESS_ALLOWED), "allow") for k in ACCESS_KEYS]
    return F.coalesce(*read)


def bus_way_dropped(tags: Column) -> Column:
    return F.coalesce(bus_access(tags) == "deny", F.lit(False)) | matches(tags, BUS_WAY_DROP)


def bus_way_kept(tags: Column) -> Column:
    return ~bus_way_dropped(tags) & matches(tags, BUS_KEEP)


def is_platform(tags: Column) -> Column:
    return matches(tags, (("railway", ("platform", "stop", "platform_edge")), ("public_transport", ("platform", "stop_position", "station"))))


def is_infrastructure(tags: Column) -> Column:
    return ~is_platform(tags) & matches(tags, (("route", ("ferry",)), ("aerialway", ANY), ("railway", ANY), ("highway", ANY)))


def mode_bits(tags: Column, in_ferry: Column | None = None) -> Column:
    """Networks that a way belongs to; in_ferry: it is a member of a ferry relation."""
    ferry = matches(tags, (("route", ("ferry",)),)) | (F.lit(False) if in_ferry is None else in_ferry)
    aerial = matches(tags, (("aerialway", ANY),))
    bits = (
        (matches(tags, (("railway", ("rail", "light_rail", "narrow_gauge")),)), m.MODE_RAIL),
        (matches(tags, (("railway", ("tram",)),)), m.MODE_TRAM),
        (matches(tags, (("railway", ("subway",)),)), m.MODE_SUBWAY),
        (~ferry & ~aerial & bus_way_kept(tags), m.MODE_BUS),
        (ferry, m.MODE_FERRY),
        (aerial, m.MODE_GONDOLA),
    )
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(test, bit).otherwise(0) for test, bit in bits))


def relation_dropped(tags: Column, profile: str) -> Column:
    return matches(tags, BUS_RELATION_DROP if profile == "Bus" else DROP.get(profile, ()))


def relation_kept(tags: Column, profile: str) -> Column:
    if profile == "Generic":
        return matches(tags, (("route", ANY),))
    keep = matches(tags, (*BUS_KEEP, ("type", RESTRICTION_TYPES)) if profile == "Bus" else KEEP[profile])
    if profile == "Rail":
        keep = keep | matches(tags, FLAT_RELATION)
    return ~relation_dropped(tags, profile) & keep


def relation_flat(tags: Column, profile: str) -> Column:
    """Whether members are not kept for the relation's sake, though its lines are noted on them."""
    return matches(tags, FLAT_RELATION) if profile == "Rail" else F.lit(False)


def bus_restriction(tags: Column) -> Column:
    """negative, positive or null: how a relation restricts the turns of buses."""
    excepted = F.exists(F.split(F.coalesce(tag(tags, "except"), F.lit("")), ";"), lambda x: F.trim(x).isin("bus", "psv"))
    says = lambda values: matches(tags, (("restriction", values), ("restriction:bus", values)))
    kind = F.when(says(NEGATIVE_TURNS), "negative").when(says(POSITIVE_TURNS), "positive")
    return F.when(matches(tags, (("type", ("restriction",)),)) & ~excepted, kind)


def way_dropped(tags: Column, profile: str) -> Column:
    if profile == "Generic":
        return is_platform(tags)
    return bus_way_dropped(tags) if profile == "Bus" else matches(tags, DROP[profile])


def way_kept(tags: Column, profile: str, mask: int = 0, in_ferry: Column | None = None) -> Column:
    """A way's own claim to be in a profile's network; mask: bits of the generic profile."""
    if profile == "Bus":
        return bus_way_kept(tags)
    if profile == "Generic":
        return is_infrastructure(tags) & (mode_bits(tags, in_ferry).bitwiseAND(mask) != 0)
    keep = matches(tags, KEEP[profile])
    if profile == "Ferry" and in_ferry is not None:
        keep = keep | in_ferry
    return ~way_dropped(tags, profile) & keep


def small_road(tags: Column) -> Column:
    return matches(tags, (("highway", ("residential", "service")), ("service", ("driveway",))))


def node_flags(tags: Column, profile: str) -> Column:
    flags = F.when(matches(tags, STATION_NODE[profile]), STATION).otherwise(0)
    return flags.bitwiseOR(F.when(matches(tags, TURN_NODE), TURN_CYCLE).otherwise(0)) if profile == "Bus" else flags


def level(tags: Column, profile: str) -> Column:
    return first_match(tags, LEVELS[profile])


def oneway(tags: Column, profile: str) -> Column:
    return first_match(tags, ONEWAY[profile])


def preferred_direction(tags: Column) -> Column:
    return first_match(tags, PREFERRED)


def speed(level_col: Column, profile: str) -> Column:
    """Metres a second at a level."""
    table = F.array(*(F.lit(float(v)) for v in SPEEDS[profile]))
    return F.element_at(table, F.greatest(F.lit(0), F.least(F.lit(7), level_col)) + 1) / F.lit(3.6)


def cost(length_m: Column, speed_mps: Column) -> Column:
    """Tenths of a second to travel a length, rounded up, at most INFINITE."""
    return F.ceil(F.least(length_m / F.greatest(speed_mps, F.lit(0.1)) * 10.0, F.lit(float(INFINITE)))).cast("bigint")


def tagged_speed(tags: Column) -> Column:
    """Metres a second from maxspeed or the class of road or track."""
    limit = tag(tags, "maxspeed").try_cast("double")
    road = F.coalesce(*(F.when(tag(tags, "highway") == k, float(v)) for k, v in ROAD_KMH.items()), F.lit(50.0))
    track = F.coalesce(*(F.when(tag(tags, "railway") == k, float(v)) for k, v in TRACK_KMH.items()), F.lit(50.0))
    return (
        F.when(limit.isNotNull(), limit / 3.6)
        .when(tag(tags, "highway").isNotNull(), road / 3.6)
        .when(tag(tags, "railway").isNotNull(), track / 3.6)
        .when(matches(tags, (("route", ("ferry",)), ("aerialway", ANY))), F.lit(15.0) / 3.6)
        .otherwise(10.0)
    )


def tagged_cost(length_m: Column, tags: Column) -> Column:
    """Cost by rail levels on tracks, by tagged speeds elsewhere."""
    track = matches(tags, (("railway", ("rail", "light_rail", "narrow_gauge")),))
    return cost(length_m, F.when(track, speed(level(tags, "Generic"), "Rail")).otherwise(tagged_speed(tags)))


def wrong_way(cost_col: Column, oneway_col: Column, profile: str) -> Column:
    factor, entry = WRONG_WAY[profile]
    return F.when(oneway_col == 2, F.least(cost_col * factor + entry, F.lit(INFINITE))).otherwise(cost_col)
