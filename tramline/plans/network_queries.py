"""Queries over networks: tag rules, segments, lines, restrictions and graph structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import tags
from tramline.operators import components, graph, tiles
from tramline.plans.fixtures import query, table, tag_map
from tramline.shared import fresh_path

ALLOWED = "('yes', 'designated', 'permissive', 'private', 'destination', 'delivery', 'customers', 'permit', 'bus', 'psv')"
ACCESS = "coalesce(" + ", ".join(f"case when {k} = 'no' then 'deny' when {k} in {ALLOWED} then 'allow' end" for k in ("bus", "motor_vehicle", "access")) + ")"
DROPPED = f"(coalesce({ACCESS} = 'deny', false) or highway in ('proposed', 'footway', 'construction'))"
KEPT = f"(not {DROPPED} and (highway in ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'residential', 'living_street', 'unclassified', 'motorway_link', 'trunk_link', 'primary_link', 'secondary_link', 'tertiary_link', 'residential_link', 'bus_guideway', 'bus_stop') or coalesce(bus in ('yes', 'designated'), false)))"
BUS_LEVEL = """case when highway in ('trunk', 'trunk_link', 'primary', 'primary_link') then 1 when highway in ('secondary', 'secondary_link') or bus in ('yes', 'designated') then 2 when highway in ('tertiary', 'tertiary_link') then 3
  when highway in ('unclassified', 'residential', 'road') then 4 when highway in ('living_street', 'pedestrian', 'service') then 5 when bus = 'no' or access in ('permissive', 'private', 'no') or highway in ('footway', 'track') then 6 else 0 end"""
COACH_LEVEL = """case when highway in ('motorway', 'motorway_link') then 0 when highway in ('trunk', 'trunk_link') then 1 when highway in ('primary', 'primary_link') then 2 when highway in ('secondary', 'secondary_link') then 3
  when highway in ('tertiary', 'tertiary_link') then 4 when highway in ('unclassified', 'residential', 'road', 'service') then 5 when highway in ('living_street', 'pedestrian') then 6
  when bus = 'no' or access in ('permissive', 'private', 'no') or highway = 'footway' then 7 else 0 end"""
BUS_ONEWAY = "case when oneway in ('false', '0', 'alternating', 'reversible', 'no') then 0 when oneway = '-1' then 2 when highway = 'motorway' or oneway in ('yes', '1', 'true') then 1 else 0 end"


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("highway", "bus", "motor_vehicle", "access", "oneway")
    return table(spark, sf_dir, "fx_tags").select("way_id", tag_map(**{k: k for k in keys}).alias("tags"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {k: k for k in ("railway", "service", "usage", "route", "oneway")} | {"railway:preferred_direction": "direction"}
    return table(spark, sf_dir, "fx_tracks").select("way_id", tag_map(**keys).alias("tags"))


@query(f"select way_id, {ACCESS} as access from fx_tags")
def access_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads(spark, sf_dir).select("way_id", tags.bus_access(F.col("tags")).alias("access"))


@query(f"select way_id, {DROPPED} as dropped, {KEPT} as kept from fx_tags")
def bus_way_keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads(spark, sf_dir).select("way_id", tags.bus_way_dropped(F.col("tags")).alias("dropped"), tags.bus_way_kept(F.col("tags")).alias("kept"))


@query(f"select way_id, {BUS_LEVEL} as level, {BUS_ONEWAY} as oneway from fx_tags")
def bus_level_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads(spark, sf_dir).select("way_id", tags.level(F.col("tags"), "Bus").alias("level"), tags.oneway(F.col("tags"), "Bus").alias("oneway"))


@query(f"select way_id, {COACH_LEVEL} as level from fx_tags")
def coach_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads(spark, sf_dir).select("way_id", tags.level(F.col("tags"), "Coach").alias("level"))


def _speed(levels: str, speeds: tuple[int, ...]) -> str:
    return f"(case {levels} " + " ".join(f"when {i} then {v}" for i, v in enumerate(speeds)) + " end / 3.6::double)"


@query(f"""with l as (select way_id, {BUS_LEVEL} as bus, {COACH_LEVEL} as coach, {BUS_ONEWAY} as oneway, (way_id % 977) * 3.7::double + 1 as length from fx_tags),
  c as (select *, cast(ceil(length / {_speed("bus", tags.SPEEDS["Bus"])} * 10.0) as bigint) as bus_cost, cast(ceil(length / {_speed("coach", tags.SPEEDS["Coach"])} * 10.0) as bigint) as coach_cost from l)
  select way_id, bus_cost, coach_cost, case when oneway = 2 then bus_cost * 5 + 3000 else bus_cost end as wrong_way_cost from c""")
def profile_levels_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (F.col("way_id") % 977) * F.lit(3.7) + 1
    at = lambda profile: tags.cost(length, tags.speed(tags.level(F.col("tags"), profile), profile))
    rows = roads(spark, sf_dir).select("way_id", at("Bus").alias("bus_cost"), at("Coach").alias("coach_cost"), tags.oneway(F.col("tags"), "Bus").alias("oneway"))
    return rows.select("way_id", "bus_cost", "coach_cost", tags.wrong_way(F.col("bus_cost"), F.col("oneway"), "Bus").alias("wrong_way_cost"))


@query("""select way_id, case when usage = 'branch' then 1 when railway = 'tram' or service = 'siding' then 2 when service in ('crossover', 'yard') then 3 when usage in ('industrial', 'military', 'test') or service = 'spur' then 5 else 0 end as rail,
    case when service = 'siding' then 2 when service in ('crossover', 'yard') then 5 else 0 end as tram,
    case when service = 'siding' then 2 when route in ('tram', 'narrow_gauge', 'subway', 'light_rail') or railway in ('narrow_gauge', 'subway', 'light_rail', 'tram', 'station', 'halt', 'tram_stop') then 3 when service in ('crossover', 'yard') then 5 else 0 end as funicular,
    case when usage in ('industrial', 'military', 'test') or service = 'spur' then 5 when service in ('crossover', 'yard') then 3 when railway = 'tram' or service = 'siding' then 2 when usage = 'branch' then 1 else 0 end as generic from fx_tracks""")
def track_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"rail": "Rail", "tram": "TramSubway", "funicular": "Funicular", "generic": "Generic"}
    return tracks(spark, sf_dir).select("way_id", *(tags.level(F.col("tags"), p).alias(n) for n, p in of.items()))


@query("""select way_id, case when oneway in ('false', 'no', '-1') or direction = 'both' then 0 when direction = 'backward' then 2 when oneway = 'yes' or direction = 'forward' then 1 else 0 end as rail,
    case when oneway = 'yes' then 1 else 0 end as tram,
    case when oneway in ('no', 'false') or direction = 'both' then 0 when oneway in ('yes', 'true', '1') then 1 when oneway = '-1' then 2 when direction = 'forward' then 1 when direction = 'backward' then 2 else 0 end as generic,
    case direction when 'forward' then 1 when 'backward' then 2 else 0 end as preferred from fx_tracks""")
def track_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"rail": "Rail", "tram": "TramSubway", "generic": "Generic"}
    return tracks(spark, sf_dir).select("way_id", *(tags.oneway(F.col("tags"), p).alias(n) for n, p in of.items()), tags.preferred_direction(F.col("tags")).alias("preferred"))


_PLATFORM = "coalesce(railway in ('platform', 'stop', 'platform_edge'), false)"


@query(f"""select way_id, coalesce(railway in ('rail', 'light_rail', 'tram', 'narrow_gauge') or route in ('rail', 'light_rail', 'train'), false) and coalesce(railway, '') <> 'platform' as rail,
    (coalesce(route in ('tram', 'funicular', 'subway', 'light_rail'), false) or coalesce(railway in ('subway', 'light_rail', 'tram', 'funicular', 'station', 'halt', 'tram_stop'), false)) and coalesce(railway, '') <> 'platform' as tram,
    coalesce(route = 'ferry', false) as ferry, not {_PLATFORM} and (route = 'ferry' or railway is not null) is true as infrastructure,
    case when railway in ('rail', 'light_rail', 'narrow_gauge') then 1 else 0 end + case when railway = 'tram' then 2 else 0 end + case when railway = 'subway' then 4 else 0 end + case when route = 'ferry' then 16 else 0 end as bits from fx_tracks""")
def way_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tags")
    of = {"rail": "Rail", "tram": "TramSubway", "ferry": "Ferry"}
    return tracks(spark, sf_dir).select("way_id", *(tags.way_kept(t, p).alias(n) for n, p in of.items()), tags.is_infrastructure(t).alias("infrastructure"), tags.mode_bits(t).alias("bits"))


@query("""with r as (select p_partkey as id, case p_size % 4 when 0 then 'restriction' when 1 then 'multipolygon' when 2 then 'restriction:bus' end as type,
    case p_partkey % 5 when 0 then 'no_left_turn' when 1 then 'only_straight_on' when 2 then 'no_entry' end as restriction, case p_partkey % 3 when 0 then 'psv; taxi' when 1 then 'bicycle' end as exc,
    case p_partkey % 6 when 0 then 'bus' when 1 then 'train' when 2 then 'ferry' when 3 then 'tram' end as route from part)
  select id, (coalesce(type, '') <> 'multipolygon' and coalesce(route = 'bus' or type in ('restriction', 'restriction:bus', 'restriction:motorcar'), false)) as bus_kept,
    (coalesce(type, '') <> 'multipolygon' and coalesce(route = 'train', false)) as rail_kept, route is not null as generic_kept,
    case when type = 'restriction' and coalesce(not list_has_any(list_transform(string_split(exc, ';'), lambda x: trim(x)), ['bus', 'psv']), true)
      then case when restriction = 'no_left_turn' then 'negative' when restriction = 'only_straight_on' then 'positive' end end as turns from r""")
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    pick = lambda c, n, *values: F.element_at(F.array(*(F.lit(v) for v in values), *[F.lit(None)] * (n - len(values))), (c % n).cast("int") + 1)
    found = tag_map(type=pick(z, 4, "restriction", "multipolygon", "restriction:bus"), restriction=pick(k, 5, "no_left_turn", "only_straight_on", "no_entry"), route=pick(k, 6, "bus", "train", "ferry", "tram"), **{"except": pick(k, 3, "psv; taxi", "bicycle")})
    t = F.col("tags")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), found.alias("tags"))
    return rows.select("id", *(tags.relation_kept(t, p).alias(f"{p.lower()}_kept") for p in ("Bus", "Rail", "Generic")), tags.bus_restriction(t).alias("turns"))


@query("""select c_custkey as node_id, case when c_mktsegment in ('BUILDING', 'MACHINERY') or c_custkey % 4 = 0 then 1 else 0 end + case when c_custkey % 6 = 0 then 2 else 0 end as bus,
    case when c_mktsegment = 'MACHINERY' or c_custkey % 9 = 0 then 1 else 0 end as rail from customer""")
def node_flag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    found = tag_map(
        highway=F.when(seg == "BUILDING", "bus_stop").when(k % 6 == 0, "turning_circle"),
        public_transport=F.when(seg == "MACHINERY", "stop_position"),
        junction=F.when(k % 6 == 0, "roundabout"),
        bus_stop=F.when(k % 4 == 0, "any"),
        railway=F.when(k % 9 == 0, "halt"),
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("node_id"), found.alias("tags"))
    return rows.select("node_id", tags.node_flags(F.col("tags"), "Bus").alias("bus"), tags.node_flags(F.col("tags"), "Rail").alias("rail"))


@query("""with c as (select way_id, case highway when 'motorway' then 100 when 'primary' then 70 when 'tertiary' then 50 when 'residential' then 30 when 'footway' then 4 else 50 end / 3.6::double as speed, (way_id % 977) * 3.7::double + 1 as length from fx_tags)
  select way_id, cast(ceil(length / speed * 10.0) as bigint) as cost from c""")
def tagged_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads(spark, sf_dir).select("way_id", tags.tagged_cost((F.col("way_id") % 977) * F.lit(3.7) + 1, F.col("tags")).alias("cost"))


# Ways to segments.


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, refs, tags): ways through suppliers, with tags of the part of the same number."""
    nodes = table(spark, sf_dir, "fx_way_nodes").groupBy(F.col("way_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("refs"))
    return nodes.join(roads(spark, sf_dir).withColumnRenamed("way_id", "id"), "id")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags, members): bus routes over ways of one supplier, and turn restrictions."""
    rows = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    routes = rows.where("p_partkey % 2 = 0").select(k.alias("id"), tag_map(route=F.lit("bus"), ref=F.when(k % 3 == 0, F.col("p_brand")), name=F.col("p_name"), to=F.when(k % 5 == 0, "Centre")).alias("tags"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: member("way", k * 3 + i, "")).alias("members"))
    turns = rows.where("p_partkey % 2 = 1").select(k.alias("id"), tag_map(type=F.lit("restriction"), restriction=F.when(k % 3 == 0, "no_left_turn").when(k % 3 == 1, "only_left_turn"), **{"except": F.when(k % 5 == 0, "bus")}).alias("tags"), F.array(member("way", k * 5, "from"), member("node", k % 100, "via"), member("way", k * 7, "to")).alias("members"))
    return routes.union(turns)


BUS_WAYS = f"""w as (select way_id as id from fx_tags where {KEPT} and way_id in (select way_id from fx_way_nodes group by way_id having count(*) > 1)
    union select t.way_id from fx_tags t join (select distinct p_partkey * 3 + i as way_id from part, (select unnest(range(0, 5)) as i) where p_partkey % 2 = 0) m using (way_id)
      where not {DROPPED} and way_id in (select way_id from fx_way_nodes group by way_id having count(*) > 1))"""


@query(f"with {BUS_WAYS} select id from w")
def kept_bus_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kept_ways(way_refs(spark, sf_dir), relations(spark, sf_dir), "Bus").select("id")


@query(f"with {BUS_WAYS} select distinct node_id from fx_way_nodes join w on id = way_id")
def needed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.needed_nodes(graph.kept_ways(way_refs(spark, sf_dir), relations(spark, sf_dir), "Bus"))


FORWARD = """s as (select way_id, pos, node_id as src, lead(node_id) over (partition by way_id order by pos) as dst from fx_way_nodes),
  first_s as (select *, row_number() over (partition by src, dst order by way_id, pos) as k from s where dst is not null and dst <> src)"""


@query(f"with {FORWARD} select way_id, pos, src, dst from first_s where k = 1")
def segment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.segments(table(spark, sf_dir, "fx_way_nodes"))


@query("""with there as (select * from fx_way_nodes where node_id in (select node_id from fx_nodes where lon between 7.51 and 7.64)), s as (select way_id, pos, node_id as src, lead(node_id) over (partition by way_id order by pos) as dst from there),
  k as (select *, row_number() over (partition by src, dst order by way_id, pos) as n from s where dst is not null and dst <> src) select way_id, pos, src, dst from k where n = 1""")
def segment_edges_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.segments(table(spark, sf_dir, "fx_way_nodes"), table(spark, sf_dir, "fx_nodes").where("lon between 7.51 and 7.64"), bridge=True)


@query("""with s as (select way_id, pos, node_id as src, lead(node_id) over (partition by way_id order by pos) as dst from fx_way_nodes),
  k as (select *, row_number() over (partition by src, dst order by way_id, pos) as n from s where dst is not null and dst <> src and src in (select node_id from fx_nodes where lon between 7.51 and 7.64) and dst in (select node_id from fx_nodes where lon between 7.51 and 7.64)) select way_id, pos, src, dst from k where n = 1""")
def segment_edges_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.segments(table(spark, sf_dir, "fx_way_nodes"), table(spark, sf_dir, "fx_nodes").where("lon between 7.51 and 7.64"), bridge=False)


TURNS = """turns as (select case when p_partkey % 3 = 0 then 'negative' else 'positive' end as kind, p_partkey * 5 as from_way, p_partkey % 100 as via_node, p_partkey * 7 as to_way from part where p_partkey % 2 = 1 and p_partkey % 3 < 2 and p_partkey % 5 <> 0)"""


@query(f"with {TURNS} select * from turns")
def turn_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.restrictions(relations(spark, sf_dir))


@query(f"""with {FORWARD}, {TURNS}, tw as (select from_way as way_id from turns union select to_way from turns), {BUS_WAYS}
  select src, dst, way_id as osmid, way_id in (select way_id from tw) and (src in (select via_node from turns) or dst in (select via_node from turns)) as restriction
  from (select *, row_number() over (partition by src, dst order by way_id, pos) as n from s where dst is not null and dst <> src and way_id in (select id from w)) where n = 1""")
def restricted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = relations(spark, sf_dir)
    ways = graph.kept_ways(way_refs(spark, sf_dir), rel, "Bus")
    nodes = table(spark, sf_dir, "fx_nodes").select("node_id", "lon", "lat")
    return graph.build_edges(ways, nodes, rel, "Bus").select("src", "dst", "osmid", "restriction")


LINES = """li as (select p_partkey as id, coalesce(case when p_partkey % 3 = 0 then p_brand end, p_name) as short_name, case when p_partkey % 5 = 0 then 'Centre' else '' end as to_str from part where p_partkey % 2 = 0),
  wl as (select distinct id * 3 + i as way_id, short_name, to_str from li, (select unnest(range(0, 5)) as i))"""


@query(f"with {LINES} select way_id, string_agg(short_name || '>' || to_str, '|' order by short_name, to_str) as lines from wl group by way_id")
def way_line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["short_name"], F.lit(">"), x["to_str"])), "|")
    return graph.way_lines(relations(spark, sf_dir), "Bus").select("way_id", text.alias("lines"))


@query(f"with {LINES} select cast(dense_rank() over (order by short_name, to_str) as int) as line_id, short_name, to_str from (select distinct short_name, to_str from wl)")
def transit_line_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.line_dictionary(graph.way_lines(relations(spark, sf_dir), "Bus")).select("line_id", "line.short_name", "line.to_str")


# Graph structure over the grid.


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the grid; some one way, some with an edge back already."""
    base = table(spark, sf_dir, "fx_edges").select("src", "dst", "cost", F.when(F.col("src") % 5 == 0, 1).when(F.col("src") % 5 == 1, 2).otherwise(0).alias("oneway"), F.col("src").alias("osmid"))
    back = base.where("src % 11 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", F.lit(0).alias("oneway"), "osmid")
    return base.union(back).select(F.xxhash64("src", "dst").alias("edge_id"), "src", "dst", "cost", "oneway", "osmid", F.lit(False).alias("is_reverse"))


GRID = """base as (select src, dst, cost, case src % 5 when 0 then 1 when 1 then 2 else 0 end as oneway from fx_edges),
  g as (select src, dst, cost, oneway from base union all select dst, src, cost, 0 from base where src % 11 = 0),
  back as (select dst as src, src as dst, cost, case oneway when 1 then 2 when 2 then 1 else 0 end as oneway from g a where not exists (select 1 from g b where b.src = a.dst and b.dst = a.src))"""


@query(f"""with {GRID} select src, dst, oneway, is_reverse, case when oneway = 2 then cost * 5 + 3000 else cost end as cost from (select *, false as is_reverse from g union all select *, true from back)""")
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_wrong_way(graph.with_reverse(grid(spark, sf_dir)), "Bus").select("src", "dst", "oneway", "is_reverse", "cost")


@query(f"with {GRID} select node, count(*) as degree from (select src as node from g union all select dst from g) group by node")
def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(grid(spark, sf_dir))


@query("""with recursive e as (select c_custkey as src from customer where c_acctbal > 0), n as (select src as node from e union select src + 1 from e),
  r as (select node, node as root from n where node - 1 not in (select src from e) union all select r.node + 1, root from r join e on e.src = r.node)
  select node, root as component from r""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    return graph.components(rows)


@query("""with recursive e as (select c_custkey as src, c_custkey // 2 as dst from customer where c_acctbal > 1000 union select a.c_custkey, a.c_custkey // 4 from customer a join customer b on b.c_custkey = a.c_custkey // 2 where a.c_acctbal > 1000 and b.c_acctbal > 1000),
  n as (select src as node from e union select dst from e), up as (select c_custkey as node from customer where c_acctbal > 1000 and c_custkey > 0),
  r as (select node, node as top from n union all select r.node, top // 2 from r where top in (select node from up))
  select node, min(top) as component from r group by node""")
def forked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that fork everywhere, with links past every parent that close rings, and a node linked to itself."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 1000").select("c_custkey")
    half = F.floor(F.col("c_custkey") / 2).cast("bigint")
    past = rich.join(rich.select(F.col("c_custkey").alias("_half")), half == F.col("_half")).select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 4).cast("bigint").alias("dst"))
    return components.components(rich.select(F.col("c_custkey").alias("src"), half.alias("dst")).union(past), task_links=2_000)


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the grid alone, with a level that changes now and then and flags on some nodes."""
    none = F.array().cast("array<struct<short_name:string,from_str:string,to_str:string>>")
    nodes = table(spark, sf_dir, "fx_nodes").withColumn("flags", F.when(F.col("node_id") % 13 == 0, 1).otherwise(0))
    at = nodes.select("node_id", F.struct("lon", "lat").alias("at"))
    rows = table(spark, sf_dir, "fx_edges").where("dst = src + 1").join(at.withColumnsRenamed({"node_id": "src", "at": "a"}), "src").join(at.withColumnsRenamed({"node_id": "dst", "at": "b"}), "dst")
    rows = rows.select(F.col("src").alias("edge_id"), "src", "dst", F.array("a", "b").alias("geometry"), none.alias("lines"), F.lit(0).alias("oneway"), "cost", F.floor(F.col("src") / 9).cast("int").alias("level"), F.lit(False).alias("restriction"), F.lit(False).alias("is_reverse"), F.lit(8).alias("allowed_modes"), F.floor(F.col("src") / 4).cast("bigint").alias("osmid"), F.lit(0).alias("preferred_direction"))
    return rows, nodes


JOINT = "e as (select src, dst, cost, cast(floor(src / 9.0) as int) as level, cast(floor(src / 4.0) as bigint) as osmid from fx_edges where dst = src + 1), j as (select b.src as node from e a join e b on a.dst = b.src where a.level = b.level and b.src % 13 <> 0)"


@query(f"with {JOINT} select node from j")
def degree2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.joints(*chains(spark, sf_dir)).select("node")


@query(f"""with recursive {JOINT}, c as (select src as start, src, dst, cost, osmid from e where src not in (select node from j)
    union all select c.start, e.src, e.dst, e.cost, e.osmid from c join e on e.src = c.dst where e.src in (select node from j))
  select start as src, max(dst) as dst, cast(sum(cost) as bigint) as cost, case when min(osmid) = max(osmid) then min(osmid) else 0 end as osmid, cast(count(*) + 1 as int) as points from c group by start""")
def collapsed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.collapsed(*chains(spark, sf_dir))
    return out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cost", "osmid", F.size("geometry").alias("points"))


@query("""with n as (select node_id, cast(floor(lon / 0.2::double) as int) as tile_x, cast(floor(lat / 0.2::double) as int) as tile_y from (select stop_id as node_id, lon * 3 as lon, lat * 2 as lat from fx_stops)),
  t as (select distinct way_id, tile_x, tile_y from fx_way_nodes join n using (node_id))
  select distinct tile_x, tile_y, node_id, cast(node_id % 4 as int) as flags from t join fx_way_nodes using (way_id)""")
def ghost_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "fx_stops").select(F.col("stop_id").alias("node_id"), (F.col("lon") * 3).alias("lon"), (F.col("lat") * 2).alias("lat"), (F.col("stop_id") % 4).cast("int").alias("flags"))
    return tiles.tile_nodes(table(spark, sf_dir, "fx_way_nodes"), nodes).select("tile_x", "tile_y", "node_id", "flags")


@query("select node_id, cast(bit_or(way_id % 8) as int) as flags from fx_way_nodes group by node_id")
def merged_tile_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fx_way_nodes").select("node_id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), (F.col("way_id") % 8).cast("int").alias("flags"))
    return tiles.merged_nodes(rows).select("node_id", "flags")


@query(f"""with n as (select stop_id as node_id, cast(floor(lon * 3 / 0.2::double) as int) as tile_x, cast(floor(lat * 2 / 0.2::double) as int) as tile_y from fx_stops),
  t as (select distinct way_id, tile_x, tile_y from fx_way_nodes join n using (node_id)), {FORWARD},
  u as (select distinct tile_x % 3 as grp, way_id, pos, src, dst from t join s using (way_id) where dst is not null and dst <> src),
  k as (select *, row_number() over (partition by grp, src, dst order by way_id, pos) as n from u)
  select grp, way_id, pos, src, dst from k where n = 1""")
def tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of three groups of tiles, stored by tile and read back: ways whole, each pair of nodes once a group."""
    nodes = table(spark, sf_dir, "fx_stops").select(F.col("stop_id").alias("node_id"), (F.col("lon") * 3).alias("lon"), (F.col("lat") * 2).alias("lat"))
    places = table(spark, sf_dir, "fx_way_nodes")
    rows = tiles.tiled_segments(graph.segments(places, nodes, bridge=False, once=False), tiles.way_tiles(places, nodes))
    path = fresh_path(spark, "tile-edges")
    tiles.write_tiles(rows, path)
    # The tiles that are stored are read from their files: asking rows would make all of them once more.
    wanted = spark.read.schema(rows.schema).parquet(path).select("tile_x", "tile_y", (F.col("tile_x") % 3).alias("group")).distinct()
    return tiles.united(tiles.read_tiles(spark, path, wanted, rows.schema)).select(F.col("group").alias("grp"), "way_id", "pos", "src", "dst")
