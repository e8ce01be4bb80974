"""Queries over feeds: patterns, modes, times, identifiers and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import colours, geo, modes, text
from tramline.operators import patterns as p
from tramline.operators import shapes, tiles
from tramline.plans.fixtures import query, table

MODE = """case when route_type = 116 then 'Funicular' when route_type = 405 then 'Monorail'
  when route_type in (2, 300, 1503, 1504) or route_type between 100 and 117 then 'Rail'
  when route_type in (3, 1500, 1501) or route_type between 700 and 717 or route_type between 1505 and 1507 then 'Bus'
  when route_type in (1, 500, 600) or route_type between 400 and 404 then 'Subway'
  when route_type = 0 or route_type between 900 and 906 then 'Tram'
  when route_type in (4, 1200, 1502) or route_type between 1000 and 1021 then 'Ferry'
  when route_type in (6, 1300, 1301) or route_type between 1304 and 1307 or route_type between 1101 and 1114 then 'Gondola'
  when route_type in (7, 1302, 1303, 1400) then 'Funicular' when route_type = 5 then 'CableCar' when route_type in (11, 800) then 'Trolleybus'
  when route_type = 12 then 'Monorail' when route_type between 200 and 209 then 'Coach' when route_type = 1100 then 'Air' else 'Other' end"""
PROFILE = """case when mode in ('Bus', 'Coach', 'Trolleybus') then 'Bus' when mode = 'Rail' then 'Rail' when mode in ('Tram', 'Subway') then 'TramSubway'
  when mode = 'Ferry' then 'Ferry' when mode in ('Gondola', 'CableCar') then 'Gondola' when mode = 'Funicular' then 'Funicular' else 'Generic' end"""


def feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stop_times, trips, routes); stops are few, so that trips share patterns."""
    times = table(spark, sf_dir, "fx_stop_times").withColumn("stop_id", (F.col("stop_id") % 3).cast("string"))
    return times, table(spark, sf_dir, "fx_trips"), table(spark, sf_dir, "fx_routes")


PATTERNS = """pat as (select trip_id, string_agg(stop, '-' order by stop_sequence, stop) as stops
    from (select trip_id, stop_sequence, cast(stop_id % 3 as string) as stop from fx_stop_times) group by trip_id),
  keyed as (select stops, route_type, r.route_id, coalesce(case when trim(route_short_name) <> '' then route_short_name end, r.route_id) as route_name, trip_id
    from pat join fx_trips using (trip_id) join fx_routes r on r.route_id = fx_trips.route_id)"""


@query(f"with {PATTERNS} select stops, route_type, route_id, route_name, count(*) as trips, min(trip_id) as sample_trip from keyed group by stops, route_type, route_id, route_name")
def stop_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.stop_patterns(*feed(spark, sf_dir))
    return found.select(F.array_join("stop_ids", "-").alias("stops"), "route_type", "route_id", "route_name", F.size("trip_ids").cast("bigint").alias("trips"), "sample_trip")


@query(f"with {PATTERNS} select stops, route_id, string_agg(cast(trip_id as string), ',' order by trip_id) as trips from keyed group by stops, route_type, route_id, route_name")
def pattern_trip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.stop_patterns(*feed(spark, sf_dir))
    return found.select(F.array_join("stop_ids", "-").alias("stops"), "route_id", F.array_join(F.transform("trip_ids", lambda x: x.cast("string")), ",").alias("trips"))


@query(f"select route_type, mode, mode in ('Bus', 'Coach', 'Trolleybus') as bus_like, {PROFILE} as profile, count(*) as routes from (select route_type, {MODE} as mode from fx_routes) group by route_type, mode")
def mode_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fx_routes").withColumn("mode", modes.category("route_type"))
    return rows.groupBy("route_type", "mode").agg(F.count("*").alias("routes")).select("route_type", "mode", modes.is_bus_like(F.col("mode")).alias("bus_like"), modes.profile(F.col("mode")).alias("profile"), "routes")


@query(f"select trip_id, route_id from fx_trips t where exists (select 1 from fx_routes r where r.route_id = t.route_id and {MODE} in ('Bus', 'Tram', 'Subway'))")
def mode_filtered_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.filtered_trips(table(spark, sf_dir, "fx_trips"), table(spark, sf_dir, "fx_routes"), modes.parse_modes("bus, metro, light-rail")).select("trip_id", "route_id")


@query("select trip_id, stop_sequence, stop_id, arrival_time from fx_stop_times where stop_id in (select stop_id from fx_stops where balance >= 0) and trip_id in (select trip_id from fx_trips where status <> 'F')")
def stop_times_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops, trips = table(spark, sf_dir, "fx_stops").where("balance >= 0"), table(spark, sf_dir, "fx_trips").where("status <> 'F'")
    return p.usable_stop_times(table(spark, sf_dir, "fx_stop_times"), stops, trips).select("trip_id", "stop_sequence", "stop_id", "arrival_time")


@query("""with rows as (select trip_id % 97 as pattern_id, trip_id, stop_sequence, stop_id, arrival_time, departure_time,
    row_number() over w - 1 as pos, first_value(departure_time) over w as start from fx_stop_times window w as (partition by trip_id order by stop_sequence, stop_id, arrival_time))
  select pattern_id, cast(pos as int) as pos, round(avg(arrival_time - start), 6) as mean_arr, round(avg(departure_time - start), 6) as mean_dep, count(*) as trips from rows group by pattern_id, pos""")
def mean_hop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "fx_stop_times").withColumn("stop_id", F.struct("stop_id", "arrival_time"))
    trips = table(spark, sf_dir, "fx_trips").select("trip_id", (F.col("trip_id") % 97).alias("pattern_id"))
    return p.hop_times(times, trips).select("pattern_id", "pos", F.round("mean_arr", 6).alias("mean_arr"), F.round("mean_dep", 6).alias("mean_dep"), "trips")


@query("""select trip_id, stop_sequence, cast(ceil(greatest(arrival_time + 0.25::double, 60.0) * 41.58) as bigint) as budget from fx_stop_times""")
def hop_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fx_stop_times")
    return rows.select("trip_id", "stop_sequence", p.hop_budget(F.col("arrival_time") + F.lit(0.25)).alias("budget"))


@query(f"""select trip_id, coalesce(r_name, 'zzz_unknown') as agency_name, case when {MODE} = 'Coach' then 'Coach' else 'Bus' end as road_profile
  from fx_trips join fx_routes using (route_id) left join (select r_regionkey, r_name from region where r_regionkey <> 3) on r_regionkey = agency_id""")
def agency_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips, routes = table(spark, sf_dir, "fx_trips"), table(spark, sf_dir, "fx_routes")
    agency = table(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("agency_id"), F.col("r_name").alias("agency_name"))
    rows = trips.join(routes.select("route_id", "route_type"), "route_id").select(F.col("trip_id").alias("sample_trip"), "route_type")
    return p.with_agency(rows, trips, routes, agency).select(F.col("sample_trip").alias("trip_id"), "agency_name", "road_profile")


@query(f"""with located as (select {PROFILE} as profile, s.lon, s.lat from (select *, {MODE} as mode from fx_routes) r join fx_trips using (route_id) join fx_stop_times using (trip_id) join fx_stops s on s.stop_id = fx_stop_times.stop_id)
  select profile, round(min(lon) - 0.5, 6) as min_lon, round(min(lat) - 0.5, 6) as min_lat, round(max(lon) + 0.5, 6) as max_lon, round(max(lat) + 0.5, 6) as max_lat from located group by profile""")
def profile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    times, trips, routes = table(spark, sf_dir, "fx_stop_times"), table(spark, sf_dir, "fx_trips"), table(spark, sf_dir, "fx_routes")
    found = p.stop_patterns(times, trips, routes).withColumn("pattern_id", p.pattern_number(*p.KEY))
    located = p.located(found, table(spark, sf_dir, "fx_stops")).withColumn("profile", modes.profile(modes.category("route_type")))
    return p.bounding_box(located, ["profile"]).select("profile", *(F.round(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


FNV = """list_reduce(list_concat([14695981039346656037::hugeint], list_transform(range(1, len(hx) // 2 + 1), lambda i: cast(('0x' || substr(hx, cast(2 * i - 1 as bigint), 2)) as hugeint))),
    lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"""
HASHED = f"""shaped as (select *, {FNV} as h from (select *, array_to_string(list_transform(string_split(stops, '-'), lambda s: printf('%02x', strlen(s)) || '00000000000000' || lower(hex(s))), '') as hx
    from (select distinct stops, route_id, route_name from keyed)))"""


@query(f"""with {PATTERNS}, {HASHED}, named as (select *, replace(route_name, '#', '%23') as enc, right(printf('%016x', cast(h as uhugeint)), 16) as digits from shaped)
  select stops, route_id, 'shp-' || enc || '-' || right(digits, 6) || '-00002a' as short_id, 'shp-' || enc || '-' || digits || '-' || route_id || '-00002a' as long_id from named""")
def short_shape_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.stop_patterns(*feed(spark, sf_dir)).select("stop_ids", "route_id", "route_name").distinct()
    hashed, run = text.stop_hash(F.col("stop_ids")), F.lit(42)
    return found.withColumn("h", hashed).select(F.array_join("stop_ids", "-").alias("stops"), "route_id", text.short_shape_id(F.col("route_name"), F.col("h"), run).alias("short_id"), text.long_shape_id(F.col("route_name"), F.col("h"), F.col("route_id"), run).alias("long_id"))


@query(f"""with {PATTERNS}, {HASHED}, named as (select *, replace(route_name, '#', '%23') as enc, right(printf('%016x', cast(h as uhugeint)), 16) as digits from shaped),
  ids as (select *, count(*) over (partition by enc, right(digits, 6)) as n from named)
  select stops, route_id, n > 1 as collides, case when n > 1 then 'shp-' || enc || '-' || digits || '-' || route_id || '-000007' else 'shp-' || enc || '-' || right(digits, 6) || '-000007' end as shape_id from ids""")
def shape_id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.with_shape_ids(p.stop_patterns(*feed(spark, sf_dir)), 7)
    return found.select(F.array_join("stop_ids", "-").alias("stops"), "route_id", (F.length(F.regexp_extract("shape_id", "-([0-9a-f]{16})-", 1)) == 16).alias("collides"), "shape_id")


@query("select distinct case right(shape_id, 6) when '0000aa' then 170 else 187 end::bigint as run from fx_shapes_old where regexp_matches(shape_id, '^shp-.*-([0-9a-fA-F]{6})$')")
def run_nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.used_runs(table(spark, sf_dir, "fx_shapes_old"))


@query("""with old as (select shape_id, seq, cast(seq as double) as lat, cast(-seq as double) as lon from fx_shapes_old),
  fresh as (select distinct shape_id, 1 as seq, cast(0.5 as double) as lat, cast(0.25 as double) as lon from old where shape_id like 'shp-1%'),
  gone as (select distinct shape_id from old where shape_id like '%bb')
  select * from old where shape_id not in (select shape_id from gone) and shape_id not in (select shape_id from fresh) union all select * from fresh""")
def shapes_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "fx_shapes_old").select("shape_id", F.col("seq").cast("double").alias("shape_pt_lat"), (-F.col("seq")).cast("double").alias("shape_pt_lon"), F.col("seq").alias("shape_pt_sequence"))
    fresh = old.where("shape_id like 'shp-1%'").select("shape_id").distinct().select("shape_id", F.lit(0.5).alias("shape_pt_lat"), F.lit(0.25).alias("shape_pt_lon"), F.lit(1).alias("shape_pt_sequence"))
    out = shapes.merged_shapes(old, fresh, old.where("shape_id like '%bb'").select("shape_id").distinct())
    return out.withColumnsRenamed({"shape_pt_lat": "lat", "shape_pt_lon": "lon", "shape_pt_sequence": "seq"})


@query("select trip_id, route_id, case when status = 'O' then concat('new-', cast(trip_id % 10 as string)) else '' end as shape_id from fx_trips")
def trips_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = table(spark, sf_dir, "fx_trips")
    found = trips.where("status = 'O'").groupBy(F.concat(F.lit("new-"), (F.col("trip_id") % 10).cast("string")).alias("shape_id")).agg(F.collect_list("trip_id").alias("trip_ids"))
    return shapes.rewritten_trips(trips.drop("status"), found)


@query("select route_id, route_short_name, colour, agency_id, case when agency_id = 2 then 'FF0000' else route_color end as route_color, case when agency_id = 2 then '000000' else '' end as route_text_color from (select route_id, route_short_name, colour, agency_id, upper(colour) as route_color from fx_routes)")
def routes_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = table(spark, sf_dir, "fx_routes").select("route_id", "route_short_name", "colour", "agency_id", F.upper("colour").alias("route_color"))
    red = colours.hex_colour(F.lit("#F00"))
    return shapes.rewritten(routes, "route_id", routes.where("agency_id = 2").select("route_id", red.alias("route_color"), colours.text_colour(red).alias("route_text_color")))


def _toned(n: int, saturation: str, lightness: str) -> str:
    """A channel of a hue in degrees."""
    k = f"({n} + hue / 30.0 - floor(({n} + hue / 30.0) / 12.0) * 12.0)"
    return f"({lightness} - {saturation} * least({lightness}, 1 - {lightness}) * greatest(-1.0, least({k} - 3, 9 - {k}, 1.0)))"


def _digits(*channels: str) -> str:
    return " || ".join(f"lpad(hex(cast(floor(({c}) * 255 + 0.5) as bigint)), 2, '0')" for c in channels)


_NAMES = "case colour " + " ".join(f"when '{n}' then '{v}'" for n, v in colours.NAMED.items()) + " end"
_MIXED = [f"(case when w + k >= 1 then w / (w + k) else {_toned(n, '1.0::double', '0.5::double')} * (1 - w - k) + w end)" for n in (0, 8, 4)]


@query(f"""with n as (select p_partkey as p, cast(p_partkey * 37 % 720 as double) as turn, cast(p_partkey % 101 as double) as a, cast(p_partkey * 7 % 101 as double) as b from part),
  f as (select *, turn - floor(turn / 360.0::double) * 360.0::double as hue, a / 100.0::double as w, b / 100.0::double as k from n),
  c as (select distinct colour, case when starts_with(colour, '#') then upper(substr(colour, 2)) else {_NAMES} end as bg from (select split_part(p_name, ' ', 1) as colour from part union all select '#' || lower(lpad(hex(p_partkey * 7919 % 16777216), 6, '0')) from part)
    union all select 'hsl(' || cast(turn as int) || ', ' || cast(a as int) || '%, ' || cast(b as int) || '%)', {_digits(*(_toned(n, "w", "k") for n in (0, 8, 4)))} from f
    union all select 'HWB(' || cast(turn as int) || 'deg ' || cast(a as int) || '% ' || cast(b as int) || '% / 0.5)', {_digits(*_MIXED)} from f
    union all select 'rgb(' || cast(a as int) || '% ' || cast(b as int) || '% ' || cast(turn as int) || '%)', {_digits("w", "k", "least(turn / 100.0::double, 1.0::double)")} from f),
  h as (select distinct colour, bg from c),
  ch as (select colour, bg, cast('0x' || substr(bg, 1, 2) as int) / 255.0 as r, cast('0x' || substr(bg, 3, 2) as int) / 255.0 as g, cast('0x' || substr(bg, 5, 2) as int) / 255.0 as b from h where bg is not null),
  l as (select colour, bg, 0.2126 * case when r <= 0.03928 then r / 12.92 else pow((r + 0.055) / 1.055, 2.4) end + 0.7152 * case when g <= 0.03928 then g / 12.92 else pow((g + 0.055) / 1.055, 2.4) end
      + 0.0722 * case when b <= 0.03928 then b / 12.92 else pow((b + 0.055) / 1.055, 2.4) end as lum from ch)
  select colour, bg as background, case when 1.05 / (lum + 0.05) > (lum + 0.05) / 0.05 then 'FFFFFF' else '000000' end as foreground from l""")
def css_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, hex digits, and the three functional forms with commas, spaces, angles and percentages."""
    part = table(spark, sf_dir, "part")
    turn, a, b = (x.cast("int").cast("string") for x in (F.col("p_partkey") * 37 % 720, F.col("p_partkey") % 101, F.col("p_partkey") * 7 % 101))
    forms = [
        F.split_part("p_name", F.lit(" "), F.lit(1)),
        F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))),
        F.concat(F.lit("hsl("), turn, F.lit(", "), a, F.lit("%, "), b, F.lit("%)")),
        F.concat(F.lit("HWB("), turn, F.lit("deg "), a, F.lit("% "), b, F.lit("% / 0.5)")),
        F.concat(F.lit("rgb("), a, F.lit("% "), b, F.lit("% "), turn, F.lit("%)")),
    ]
    # Short texts that take long to read: tasks by their number, not by their bytes.
    tasks = max(1, -(-part.count() // TASK_PARTS))
    rows = part.select(F.explode(F.array(*forms)).alias("colour")).repartition(tasks, "colour").distinct().withColumn("background", colours.hex_colour(F.col("colour")))
    return rows.where("background is not null").select("colour", "background", colours.text_colour(F.col("background")).alias("foreground"))


@query("""with names as (select distinct p_brand as a from part), more as (select a, a || ' Line' as b from names union all select a, lower(replace(a, '#', ' ')) from names union all select a, 'x' || a from names union all select a, 'Line ' || lower(a) from names union all select a, '' from names),
  c as (select a, b, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') as ca, regexp_replace(lower(b), '[^a-z0-9]', '', 'g') as cb from more)
  select a, b, lower(a) = lower(b) or (a <> '' and b <> '' and ((ca = cb and ca <> '') or (starts_with(lower(b), lower(a) || ' ') and length(b) > length(a) + 1) or (ends_with(lower(b), ' ' || lower(a)) and length(b) > length(a) + 1)
    or (starts_with(lower(a), lower(b) || ' ') and length(a) > length(b) + 1) or (ends_with(lower(a), ' ' || lower(b)) and length(a) > length(b) + 1))) as similar_line from c""")
def line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).distinct()
    a = F.col("a")
    others = F.array(F.concat(a, F.lit(" Line")), F.lower(F.replace(a, F.lit("#"), F.lit(" "))), F.concat(F.lit("x"), a), F.concat(F.lit("Line "), F.lower(a)), F.lit(""))
    return names.select("a", F.explode(others).alias("b")).select("a", "b", text.similar_lines(F.col("a"), F.col("b")).alias("similar_line"))


@query("""with rel as (select n_nationkey as id, case when n_nationkey % 2 = 0 then p.ref end as ref, lower(n_name) as name, r_name as operator, case n_nationkey % 3 when 0 then 'red' when 1 then '#00f' end as colour
    from nation join region on r_regionkey = n_regionkey left join (select distinct p_size, first_value(p_brand) over (partition by p_size order by p_partkey) as ref from part) p on p.p_size = n_nationkey),
  q as (select route_id, lower(route_short_name) as s, lower(route_long_name) as l, lower(r_name) as o from fx_routes join region on r_regionkey = agency_id),
  sc as (select route_id, id, colour, case when contains(lower(ref), s) or contains(s, lower(ref)) then 3 else 0 end + case when contains(name, s) or contains(s, name) then 2 else 0 end
      + case when contains(name, l) or contains(l, name) then 2 else 0 end + case when contains(lower(operator), o) or contains(o, lower(operator)) then 1 else 0 end as score from q, rel where colour is not null),
  best as (select route_id, colour, row_number() over (partition by route_id order by score desc, id) as k from sc where score > 0)
  select route_id, case colour when 'red' then 'FF0000' else '0000FF' end as route_color, case colour when 'red' then '000000' else 'FFFFFF' end as route_text_color from best where k = 1""")
def route_colour_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    refs = table(spark, sf_dir, "part").groupBy("p_size").agg(F.min_by("p_brand", "p_partkey").alias("_ref"))
    key = F.col("n_nationkey")
    relations = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).join(refs, F.col("p_size") == key, "left")
    relations = relations.select(key.alias("id"), F.when(key % 2 == 0, F.col("_ref")).alias("ref"), F.lower("n_name").alias("name"), F.col("r_name").alias("operator"), F.when(key % 3 == 0, "red").when(key % 3 == 1, "#00f").alias("colour"))
    routes = table(spark, sf_dir, "fx_routes").join(region.select(F.col("r_regionkey").alias("agency_id"), F.col("r_name").alias("agency_name")), "agency_id")
    return shapes.route_colours(routes, relations)


@query("select route_id, colour from (select cast(o_custkey as string) as route_id, o_orderpriority as colour, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderstatus = 'O') where k = 1")
def first_route_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("route_id"), F.col("o_orderkey").alias("pattern_id"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("colour"))
    return shapes.first_colours(rows)


# Places: tiles, the Hilbert curve and groups along it.


@query("select stop_id, cast(floor(lon / 0.2::double) as int) as tile_x, cast(floor(lat / 0.2::double) as int) as tile_y from fx_stops")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fx_stops").select("stop_id", geo.tile(F.col("lon")).alias("tile_x"), geo.tile(F.col("lat")).alias("tile_y"))


@query("""with t as (select distinct cast(floor(lon / 0.2::double) as int) as tx, cast(floor(lat / 0.2::double) as int) as ty from fx_nodes)
  select tx, ty, cast(tx + dx as int) as x, cast(ty + dy as int) as y from t, (select unnest(range(-1, 2)) as dx), (select unnest(range(-1, 2)) as dy)""")
def tile_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "fx_nodes").select(geo.tile(F.col("lon")).alias("tx"), geo.tile(F.col("lat")).alias("ty")).distinct()
    return seen.select("tx", "ty", F.explode(geo.neighbours(F.col("tx"), F.col("ty"))).alias("t")).select("tx", "ty", "t.x", "t.y")


HOPS = """h as (select stop_id, lon as x1, lat as y1, 7.3 + (stop_id * 37 % 100) * 0.0131::double as x2, 47.7 + (stop_id * 53 % 100) * 0.0117::double as y2 from fx_stops),
  e as (select *, cast(floor(x1 / 0.2::double) as int) as ax, cast(floor(y1 / 0.2::double) as int) as ay, cast(floor(x2 / 0.2::double) as int) as bx, cast(floor(y2 / 0.2::double) as int) as byy from h)"""
CROSS = "(values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) as cr(dx, dy)"
CORRIDOR = f"""s as (select *, (greatest(abs(bx - ax), abs(byy - ay)) + 1) * 2 as steps from e),
  along as (select stop_id, cast(floor((x1 + (i / steps::double) * (x2 - x1)) / 0.2::double) as int) as tx, cast(floor((y1 + (i / steps::double) * (y2 - y1)) / 0.2::double) as int) as ty
    from (select *, unnest(range(0, steps + 1)) as i from s where ax <> bx or ay <> byy) union all select stop_id, ax, ay from e where ax = bx and ay = byy),
  corridor as (select distinct stop_id, cast(tx + dx as int) as x, cast(ty + dy as int) as y from along, {CROSS})"""


#: Hops of a task: a hop leads through as many tiles as it is long, and a small file of stops would be one task.
TASK_HOPS = 250
#: Parts whose colours a task reads.
TASK_PARTS = 10_000


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fx_stops")
    rows = rows.repartition(max(1, -(-rows.count() // TASK_HOPS)), "stop_id")
    lon = F.lit(7.3) + (F.col("stop_id") * 37 % 100).cast("double") * F.lit(0.0131)
    lat = F.lit(47.7) + (F.col("stop_id") * 53 % 100).cast("double") * F.lit(0.0117)
    return rows.select("stop_id", geo.point(F.col("lon"), F.col("lat")).alias("a"), geo.point(lon, lat).alias("b"))


@query(f"with {HOPS}, {CORRIDOR} select * from corridor")
def corridor_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops(spark, sf_dir).select("stop_id", F.explode(geo.corridor(F.col("a"), F.col("b"))).alias("t")).select("stop_id", "t.x", "t.y")


@query(f"""with {HOPS}, {CORRIDOR}, box as (select unnest(range(-1, 2)) as dx), boy as (select unnest(range(-1, 2)) as dy),
  near as (select stop_id, cast(ax + dx as int) as x, cast(ay + dy as int) as y from e, box, boy where abs(ax - bx) <= 1 and abs(ay - byy) <= 1
    union select stop_id, cast(bx + dx as int), cast(byy + dy as int) from e, box, boy where abs(ax - bx) <= 1 and abs(ay - byy) <= 1),
  far as (select c.* from corridor c join e using (stop_id) where abs(ax - bx) > 1 or abs(ay - byy) > 1)
  select stop_id, string_agg(x || ':' || y, ' ' order by x, y) as tiles from (select * from near union all select * from far) group by stop_id""")
def route_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geo.route_tiles(F.array("a", "b"))
    return hops(spark, sf_dir).select("stop_id", F.array_join(F.transform(found, lambda t: F.concat(t["x"].cast("string"), F.lit(":"), t["y"].cast("string"))), " ").alias("tiles"))


def _hilbert_sql() -> str:
    """Sixteen rotations, one subquery each."""
    sql = "select node_id, cast(least(greatest((lon + 180.0) / 360.0 * 65536.0, 0.0), 65535.0) - 0.5 as bigint) as x, cast(least(greatest((lat + 90.0) / 180.0 * 65536.0, 0.0), 65535.0) - 0.5 as bigint) as y, 0::bigint as d from fx_nodes"
    sql = sql.replace("cast(least", "cast(floor(least").replace(" - 0.5 as bigint)", ") as bigint)")
    for bit in range(15, -1, -1):
        s = 1 << bit
        bits = f"select *, cast((x & {s}) > 0 as bigint) as rx, cast((y & {s}) > 0 as bigint) as ry from ({sql})"
        flip = f"select *, case when ry = 0 and rx = 1 then 65535 - x else x end as fx, case when ry = 0 and rx = 1 then 65535 - y else y end as fy from ({bits})"
        sql = f"select node_id, case when ry = 0 then fy else fx end as x, case when ry = 0 then fx else fy end as y, d + {s * s}::bigint * xor(3 * rx, ry) as d from ({flip})"
    return f"select node_id, d as place from ({sql})"


@query(_hilbert_sql())
def hilbert_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fx_nodes").select("node_id", geo.hilbert(F.col("lon"), F.col("lat")).alias("place"))


@query("""with recursive t as (select stop_id, row_number() over (order by stop_id) as k, cast(floor(lon / 0.02::double) as int) as tx, cast(floor(lat / 0.02::double) as int) as ty from fx_stops),
  s as (select k, stop_id, list_distinct([tx * 1000000 + ty, tx * 1000000 + ty + 1, (tx + 1) * 1000000 + ty]) as tiles from t),
  g as (select k, stop_id, tiles as held, 0 as grp from s where k = 1
    union all select s.k, s.stop_id, case when len(list_distinct(list_concat(g.held, s.tiles))) > 12 then s.tiles else list_distinct(list_concat(g.held, s.tiles)) end,
      case when len(list_distinct(list_concat(g.held, s.tiles))) > 12 then g.grp + 1 else g.grp end from g join s on s.k = g.k + 1)
  select stop_id as pattern_id, cast(grp as int) as grp from g""")
def greedy_tile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda dx, dy: F.struct((geo.tile(F.col("lon"), 0.02) + dx).alias("x"), (geo.tile(F.col("lat"), 0.02) + dy).alias("y"))
    rows = table(spark, sf_dir, "fx_stops").select(F.lit("all").alias("agency"), F.col("stop_id").alias("pattern_id"), F.array(at(0, 0), at(0, 1), at(1, 0)).alias("tiles"))
    return tiles.grouped(rows, ["agency"], 12, ("pattern_id",)).select("pattern_id", F.col("group").alias("grp"))


@query("""select a.stop_id as a, b.stop_id as b, round(2 * 6371008.8 * asin(least(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)), 1.0)), 3) as metres
  from fx_stops a join fx_stops b on b.stop_id between a.stop_id + 1 and a.stop_id + 5""")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fx_stops")
    pairs = rows.select("*", F.explode(F.sequence(F.col("stop_id") + 1, F.col("stop_id") + 5)).alias("other")).alias("a").join(rows.alias("b"), F.col("a.other") == F.col("b.stop_id"))
    return pairs.select(F.col("a.stop_id").alias("a"), F.col("b.stop_id").alias("b"), F.round(geo.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")), 3).alias("metres"))


@query("select round(avg(lon), 6) as lon, round(avg(lat), 6) as lat, stop_id % 10 as line from fx_stops group by stop_id % 10")
def pattern_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fx_stops").groupBy((F.col("stop_id") % 10).alias("line")).agg(F.array_sort(F.collect_list(geo.point(F.col("lon"), F.col("lat")))).alias("coords"))
    lon, lat = p.centroid(F.col("coords"))
    return rows.select(F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), "line")
