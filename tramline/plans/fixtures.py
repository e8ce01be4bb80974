"""Feeds and networks projected from the star-schema tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

PROJECTIONS = {
    "fx_stops": """select s_suppkey as stop_id, cast(7.5 as double) + cast(s_suppkey % 10 as double) * cast(0.013 as double) as lon,
        cast(47.9 as double) + floor(s_suppkey / 10.0) * cast(0.009 as double) as lat, s_acctbal as balance from supplier""",
    "fx_nodes": """select c_custkey as node_id, cast(c_custkey % 40 as int) as gx, cast(floor(c_custkey / 40.0) as int) as gy,
        cast(7.5 as double) + cast(c_custkey % 40 as double) * cast(0.004 as double) as lon,
        cast(47.9 as double) + floor(c_custkey / 40.0) * cast(0.004 as double) as lat from customer""",
    "fx_edges": """select a.c_custkey as src, b.c_custkey as dst, cast(10 + (a.c_custkey * 7) % 13 as bigint) as cost
        from customer a join customer b on b.c_custkey = a.c_custkey + 1 where a.c_custkey % 40 < 39
        union all
        select a.c_custkey, b.c_custkey, cast(10 + (a.c_custkey * 11) % 17 as bigint) from customer a join customer b on b.c_custkey = a.c_custkey + 40""",
    "fx_routes": """select cast(p_partkey as string) as route_id, p_brand as route_short_name, p_name as route_long_name, split_part(p_name, ' ', 1) as colour,
        cast(p_partkey % 5 as int) as agency_id,
        case p_size % 16 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 5 when 6 then 6
          when 7 then 7 when 8 then 109 when 9 then 116 when 10 then 200 when 11 then 405 when 12 then 700 when 13 then 800
          when 14 then 1100 else 1400 end as route_type
        from part""",
    "fx_trips": "select o_orderkey as trip_id, cast(o_custkey as string) as route_id, o_orderstatus as status from orders",
    "fx_stop_times": """select l_orderkey as trip_id, l_linenumber as stop_sequence, l_suppkey as stop_id,
        cast(120 * l_linenumber + cast(l_quantity as int) as int) as arrival_time,
        cast(120 * l_linenumber + cast(l_quantity as int) + 20 as int) as departure_time from lineitem""",
    "fx_way_nodes": """select l_orderkey as way_id,
        cast(row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) - 1 as int) as pos, l_suppkey as node_id from lineitem""",
    "fx_tags": """select p_partkey as way_id,
        case p_size % 8 when 0 then 'motorway' when 1 then 'primary' when 2 then 'secondary_link' when 3 then 'tertiary'
          when 4 then 'residential' when 5 then 'service' when 6 then 'footway' else 'track' end as highway,
        case p_partkey % 7 when 0 then 'no' when 1 then 'yes' when 2 then 'designated' end as bus,
        case p_partkey % 5 when 0 then 'no' when 1 then 'yes' end as motor_vehicle,
        case p_partkey % 11 when 0 then 'private' when 1 then 'no' end as access,
        case p_partkey % 6 when 0 then 'yes' when 1 then '-1' when 2 then 'no' end as oneway from part""",
    "fx_tracks": """select p_partkey as way_id,
        case p_size % 7 when 0 then 'rail' when 1 then 'tram' when 2 then 'subway' when 3 then 'narrow_gauge' when 4 then 'light_rail' when 5 then 'platform' end as railway,
        case p_partkey % 9 when 0 then 'siding' when 1 then 'yard' when 2 then 'spur' when 3 then 'crossover' end as service,
        case p_partkey % 8 when 0 then 'branch' when 1 then 'industrial' end as usage,
        case p_partkey % 10 when 0 then 'ferry' when 1 then 'train' when 2 then 'tram' end as route,
        case p_partkey % 6 when 0 then 'yes' when 1 then '-1' when 2 then 'no' end as oneway,
        case p_partkey % 13 when 0 then 'forward' when 1 then 'backward' when 2 then 'both' end as direction from part""",
    "fx_shapes_old": """select concat('shp-', cast(l_suppkey % 20 as string), '-', lpad(lower(hex(l_partkey % 4096)), 6, '0'), '-',
          case when l_partkey % 2 = 0 then '0000aa' else '0000bb' end) as shape_id, l_linenumber as seq from lineitem""",
}


def with_projections(sql: str) -> str:
    """sql behind definitions of the projections that it names."""
    named = [n for n in PROJECTIONS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} as ({PROJECTIONS[n]})" for n in named]
    body = sql.strip()
    if not heads:
        return body
    if m := re.match(r"with\s+(recursive\s+)?", body, re.I):
        return f"with {m[1] or ''}{', '.join(heads)}, {body[m.end() :]}"
    return f"with {', '.join(heads)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in PROJECTIONS:
        for t in (t for t in TABLES if re.search(rf"\b{t}\b", PROJECTIONS[name])):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(PROJECTIONS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag_map(**keys: Column | str) -> Column:
    """A map of tags from columns; a null column is an absent tag."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), (F.col(c) if isinstance(c, str) else c).alias("value")) for k, c in keys.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_projections(sql)
        return f

    return keep
