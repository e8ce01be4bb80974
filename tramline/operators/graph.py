"""The street and rail network as tables of nodes and edges.

nodes: node_id, lon, lat, flags. edges: edge_id, src, dst, geometry, lines, level,
oneway, cost, restriction, is_reverse, allowed_modes, osmid.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions import geo, tags
from tramline.operators import tiles
from tramline.operators.components import components
from tramline.shared import written

#: Edges that a task joins into chains.
TASK_EDGES = 20_000


def kept_relations(relations: DataFrame, profile: str) -> DataFrame:
    """Relations that shape the network: (id, tags, members, flat)."""
    return relations.where(tags.relation_kept(F.col("tags"), profile)).withColumn("flat", tags.relation_flat(F.col("tags"), profile))


def relation_members(relations: DataFrame, kind: str) -> DataFrame:
    """(relation_id, ref, role) of one kind of member."""
    return relations.select(F.col("id").alias("relation_id"), F.explode("members").alias("m")).where(F.col("m.type") == kind).select("relation_id", F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))


def restrictions(relations: DataFrame) -> DataFrame:
    """(kind, from_way, via_node, to_way) of the turn restrictions that concern buses."""
    kind = tags.bus_restriction(F.col("tags"))
    rows = relations.withColumn("kind", kind).where("kind is not null").select("id", "kind", F.explode("members").alias("m"))
    pick = lambda type_, role: F.max(F.when((F.col("m.type") == type_) & (F.col("m.role") == role), F.col("m.ref")))
    return rows.groupBy("id", "kind").agg(pick("way", "from").alias("from_way"), pick("node", "via").alias("via_node"), pick("way", "to").alias("to_way")).drop("id").where("via_node is not null")


def kept_ways(ways: DataFrame, relations: DataFrame, profile: str, mask: int = 0, skip_small: bool = False) -> DataFrame:
    """Ways of a profile's network, by their own tags or as members of kept relations that are not flat.

    Adds in_relation. skip_small leaves out minor roads that no kept relation names.
    """
    named = relation_members(kept_relations(relations, profile).where("not flat"), "way").select(F.col("ref").alias("id")).distinct().withColumn("_in", F.lit(True))
    ferry = relation_members(relations.where(tags.matches(F.col("tags"), (("route", ("ferry",)),))), "way").select(F.col("ref").alias("id")).distinct().withColumn("_ferry", F.lit(True))
    rows = ways.where(F.size("refs") > 1).join(named, "id", "left").join(ferry, "id", "left")
    tag, inside, afloat = F.col("tags"), F.coalesce("_in", F.lit(False)), F.coalesce("_ferry", F.lit(False))
    keep = tags.way_kept(tag, profile, mask, afloat) | (inside & ~tags.way_dropped(tag, profile))
    if skip_small:
        keep = keep & ~(~inside & tags.is_infrastructure(tag) & tags.small_road(tag))
    return rows.where(keep).select(*ways.columns, inside.alias("in_relation"))


def way_lines(relations: DataFrame, profile: str) -> DataFrame:
    """(way_id, lines): distinct, sorted lines that kept relations note on their ways; none that says nothing."""
    tag = F.col("tags")
    text = lambda *keys: F.coalesce(*(tags.tag(tag, k) for k in keys), F.lit(""))
    line = F.struct(text("ref", "name").alias("short_name"), text("from").alias("from_str"), text("to").alias("to_str"))
    rows = kept_relations(relations, profile).select("id", line.alias("line"), "members").where("line.short_name <> '' or line.from_str <> '' or line.to_str <> ''")
    member = rows.select("line", F.explode("members").alias("m")).where(F.col("m.type") == "way")
    return member.groupBy(F.col("m.ref").alias("way_id")).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def line_dictionary(lines: DataFrame) -> DataFrame:
    """(line_id, line): numbers of distinct lines, dense and in their order."""
    return lines.select(F.explode("lines").alias("line")).distinct().withColumn("line_id", F.dense_rank().over(Window.orderBy("line")))


def needed_nodes(ways: DataFrame) -> DataFrame:
    return ways.select(F.explode("refs").alias("node_id")).distinct()


def segments(way_nodes: DataFrame, located: DataFrame | None = None, bridge: bool = True, once: bool = True) -> DataFrame:
    """(way_id, pos, src, dst): directed segments of ways, without loops; of a pair, the first way and place counts (once), or all.

    way_nodes: (way_id, pos, node_id). With located nodes (node_id), segments run over missing nodes (bridge), or a missing
    node breaks the way.
    """
    rows = way_nodes
    if located is not None:
        mark = located.select("node_id").distinct().withColumn("_there", F.lit(True))
        rows = rows.join(mark, "node_id", "left") if not bridge else rows.join(mark, "node_id")
    after = Window.partitionBy("way_id").orderBy("pos")
    rows = rows.select("*", F.lead("node_id").over(after).alias("dst"))
    if located is not None and not bridge:
        rows = rows.withColumn("_next", F.lead("_there").over(after)).where("_there and _next")
    rows = rows.where("dst is not null and dst <> node_id").select("way_id", "pos", F.col("node_id").alias("src"), "dst")
    if not once:
        return rows
    return rows.groupBy("src", "dst").agg(F.min(F.struct("way_id", "pos")).alias("first")).select("first.way_id", "first.pos", "src", "dst")


NO_LINES = "array<struct<short_name:string,from_str:string,to_str:string>>"


def way_segments(ways: DataFrame, nodes: DataFrame, relations: DataFrame, profile: str, roads: dict[str, str], bridge: bool = True, mask: int = 0, once: bool = True) -> DataFrame:
    """Segments of kept ways with what edges are made of: geometry (the two ends), lines, rules, and a level for each profile of roads (name: profile)."""
    tag = F.col("tags")
    bits = F.lit(mask) if mask else tags.mode_bits(tag)
    rules = ways.select(F.col("id").alias("way_id"), *(tags.level(tag, road).alias(name) for name, road in roads.items()), tags.oneway(tag, profile).alias("oneway"), tags.preferred_direction(tag).alias("preferred_direction"), bits.alias("allowed_modes"))
    places = ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
    turns = restrictions(relations)
    turn_ways = turns.select(F.explode(F.array("from_way", "to_way")).alias("way_id")).distinct().withColumn("_turn", F.lit(True))
    via = turns.select(F.col("via_node").alias("node_id")).distinct().withColumn("_via", F.lit(True))
    at = nodes.select("node_id", geo.point(F.col("lon"), F.col("lat")).alias("at"))
    side = lambda c: at.join(via, "node_id", "left").select(F.col("node_id").alias(c), F.col("at").alias(f"{c}_at"), F.coalesce("_via", F.lit(False)).alias(f"{c}_via"))
    rows = segments(places, nodes, bridge, once).join(rules, "way_id").join(side("src"), "src").join(side("dst"), "dst").join(way_lines(relations, profile), "way_id", "left").join(turn_ways, "way_id", "left")
    turned = F.coalesce("_turn", F.lit(False)) & (F.col("src_via") | F.col("dst_via"))
    return rows.select("way_id", "pos", "src", "dst", F.array("src_at", "dst_at").alias("geometry"), F.coalesce("lines", F.array().cast(NO_LINES)).alias("lines"), "oneway", *roads, turned.alias("restriction"), "allowed_modes", "preferred_direction")


def edges_of(rows: DataFrame, road: str, level: str = "level", *keys: str) -> DataFrame:
    """Forward edges from segments, at the levels and speeds of `road`; keys are columns to keep in front."""
    length = geo.between(F.get("geometry", 0), F.get("geometry", 1))
    return rows.select(
        *keys,
        F.xxhash64("src", "dst", F.lit(False)).alias("edge_id"),
        "src",
        "dst",
        "geometry",
        "lines",
        "oneway",
        tags.cost(length, tags.speed(F.col(level), road)).alias("cost"),
        F.col(level).alias("level"),
        "restriction",
        F.lit(False).alias("is_reverse"),
        "allowed_modes",
        F.col("way_id").alias("osmid"),
        "preferred_direction",
    )


def build_edges(ways: DataFrame, nodes: DataFrame, relations: DataFrame, profile: str, bridge: bool = True, mask: int = 0, road: str | None = None) -> DataFrame:
    """Forward edges of kept ways. Levels and speeds are those of `road`, if it is not the profile itself."""
    road = road or profile
    return edges_of(way_segments(ways, nodes, relations, profile, {"level": road}, bridge, mask), road)


def with_reverse(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """edges and, where no edge (of the same group) runs back, a copy that does; it reads its geometry backwards."""
    flipped = F.when(F.col("oneway") == 1, 2).when(F.col("oneway") == 2, 1).otherwise(F.col("oneway"))
    there = edges.select(*by, "src", "dst")
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "oneway": flipped, "is_reverse": F.lit(True), "edge_id": F.xxhash64("dst", "src", "osmid", F.lit(True))})
    return edges.unionByName(back.join(there, [*by, "src", "dst"], "left_anti").select(*edges.columns))


def with_wrong_way(edges: DataFrame, profile: str) -> DataFrame:
    return edges.withColumn("cost", tags.wrong_way(F.col("cost"), F.col("oneway"), profile))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges in and out; a loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def similar(a: Column, b: Column, node: Column) -> Column:
    """Whether two edges that meet at a node may become one."""
    alike = reduce(and_, (a[k] == b[k] for k in ("level", "allowed_modes", "lines")))
    head_to_tail = (a["dst"] == node) != (b["dst"] == node)
    return ((a["oneway"] != 0) == (b["oneway"] != 0)) & ~a["restriction"] & ~b["restriction"] & alike & ((a["oneway"] == 0) | head_to_tail)


def joints(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, a, b): plain nodes with two edges (of the same group) that may become one, and the edges' ids."""
    fields = ("edge_id", "src", "dst", "oneway", "restriction", "level", "allowed_modes", "lines")
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("node"), F.struct(*fields).alias("e"))
    met = ends.groupBy(*by, "node").agg(F.count("*").alias("n"), F.min("e").alias("a"), F.max("e").alias("b")).where("n = 2 and a.edge_id <> b.edge_id")
    flagged = nodes.where("flags <> 0").select(F.col("node_id").alias("node"))
    far = lambda e: F.when(F.col(f"{e}.src") == F.col("node"), F.col(f"{e}.dst")).otherwise(F.col(f"{e}.src"))
    met = met.where((far("a") != far("b")) & similar(F.col("a"), F.col("b"), F.col("node")))
    return met.join(flagged, "node", "left_anti").select(*by, "node", F.col("a.edge_id").alias("a"), F.col("b.edge_id").alias("b"))


def walk(edges: list[dict], met: dict[int, list[int]], joint: set[int], first: int) -> tuple[list[int], list[int]]:
    """(nodes, edges) of the chain through an edge, from one end that is no joint to the other; round a ring, from its smallest node."""
    nodes, chain = [edges[first]["src"], edges[first]["dst"]], [first]
    for _ in range(2):
        while nodes[-1] in joint and nodes[-1] != nodes[0]:
            i, j = met[nodes[-1]]
            chain.append(j if chain[-1] == i else i)
            e = edges[chain[-1]]
            nodes.append(e["dst"] if e["src"] == nodes[-1] else e["src"])
        nodes.reverse()
        chain.reverse()
    if nodes[0] == nodes[-1] and (others := [n for n in nodes[1:] if n not in joint] or [min(nodes)]) and others[0] != nodes[0]:
        k = nodes.index(others[0])
        nodes, chain = nodes[k:] + nodes[1 : k + 1], chain[k:] + chain[:k]
    return nodes, chain


def joined(run: list[dict], nodes: list[int]) -> dict:
    """One edge for a run of edges between neighbouring nodes.

    One-way runs keep their direction, others start at the smaller of their end edges, which lends what is not summed up.
    """
    if run[-1]["oneway"] and run[0]["src"] != nodes[0] or not run[0]["oneway"] and [run[-1][k] for k in ("src", "dst", "edge_id")] < [run[0][k] for k in ("src", "dst", "edge_id")]:
        run, nodes = run[::-1], nodes[::-1]
    points: list = []
    for e, start in zip(run, nodes, strict=False):
        line = e["geometry"] if e["src"] == start else e["geometry"][::-1]
        points += line[1:] if points and points[-1] == line[0] else line
    ways = {e["osmid"] for e in run}
    return run[0] | {"src": nodes[0], "dst": nodes[-1], "geometry": points, "cost": min(sum(e["cost"] for e in run), tags.INFINITE), "osmid": ways.pop() if len(ways) == 1 else 0, "is_reverse": False}


def collapse(edges: list[dict], plain: set[int]) -> list[dict]:
    """Joins edges at plain nodes, chain by chain, so that no two edges come to stand between the same nodes.

    A chain between two nodes becomes one edge; if an edge stands between them, the chain's largest inner node stays. Of chains
    between the same nodes the one with the smallest such node is first. A ring that hangs on a node keeps its two largest
    nodes besides, and a ring of its own the three largest. Costs add up; osmid stays where all agree and is 0 otherwise.
    """
    met: dict[int, list[int]] = {}
    for i, e in enumerate(edges):
        for node in {e["src"], e["dst"]}:
            met.setdefault(node, []).append(i)
    joint = {n for n in plain & met.keys() if len(met[n]) == 2}
    seen, chains, pairs, out = set(), [], set(), []
    for i, e in enumerate(edges):
        if i in seen:
            continue
        if not joint & {e["src"], e["dst"]}:
            pairs.add(frozenset((e["src"], e["dst"])))
            out.append(e)
            continue
        nodes, chain = walk(edges, met, joint, i)
        seen.update(chain)
        chains.append((max(nodes[1:-1], default=0), nodes, chain))
    for largest, nodes, chain in sorted(chains):
        ends, inner = frozenset((nodes[0], nodes[-1])), sorted(nodes[1:-1])
        if len(ends) == 2:
            stay = {largest} if ends in pairs else set()
            pairs.add(ends)
        else:
            # Round its ends a ring already has neighbours joined: the last nodes of an ascending pass stay.
            stay = set(sorted({*inner, nodes[0]})[-3:]) if nodes[0] in joint else set(inner[-2:])
        cuts = [0, *(k for k in range(1, len(nodes) - 1) if nodes[k] in stay), len(nodes) - 1]
        if nodes[0] == nodes[-1] and nodes[0] in joint and nodes[0] not in stay:
            # A ring of its own is cut at a node that stays.
            k = cuts[1]
            nodes, chain = nodes[k:] + nodes[1 : k + 1], chain[k:] + chain[:k]
            cuts = [0, *(k for k in range(1, len(nodes) - 1) if nodes[k] in stay), len(nodes) - 1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            run = [edges[k] for k in chain[a:b]]
            out.append(joined(run, nodes[a : b + 1]) if len(run) > 1 else run[0])
    return out


def collapsed(edges: DataFrame, nodes: DataFrame, profile: str | None = None, by: str | None = None) -> DataFrame:
    """edges with chains joined; with a profile, costs are recomputed from geometry and level; with `by`, each group of that column is a network of its own.

    Chains are components of edges that share a joint. Chains and edges between the same two ends can stand in each other's
    way, so they form one set and are joined in one pass; sets are as small as a stretch of road, whatever the network.
    """
    spark, keys = edges.sparkSession, [by] if by else []
    found = written(joints(edges, nodes, tuple(keys)), "joints")
    chain = components(found.select(*keys, F.col("a").alias("src"), F.col("b").alias("dst")), by).select(*keys, F.col("node").alias("edge_id"), F.col("component").alias("_chain"))
    rows = edges.join(chain, [*keys, "edge_id"], "left")
    inner = found.select(*keys, "node").withColumn("_plain", F.lit(True))
    ends = rows.where("_chain is not null").select(*keys, "_chain", F.explode(F.array("src", "dst")).alias("node")).join(inner.select(*keys, "node"), [*keys, "node"], "left_anti")
    ends = ends.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_set("node")).alias("_ends"))
    pair = F.array_sort(F.array("src", "dst"))
    keyed = rows.join(ends, [*keys, "_chain"], "left").withColumn("_set", F.when(F.col("_chain").isNull(), pair).when(F.size("_ends") == 2, F.col("_ends")).otherwise(F.array("_chain")))
    busy = keyed.where("_chain is not null").select(*keys, "_set").distinct()
    mark = lambda c: inner.withColumnsRenamed({"node": c, "_plain": f"_{c}"})
    work = keyed.join(busy, [*keys, "_set"], "left_semi").join(mark("src"), [*keys, "src"], "left").join(mark("dst"), [*keys, "dst"], "left")

    columns = edges.columns

    def run(table: pd.DataFrame) -> pd.DataFrame:
        sets: dict[tuple, tuple[list[dict], set[int]]] = {}
        table = table.sort_values([*keys, "src", "dst", "edge_id"])
        marks = zip(table["_set"], table["_src"].notna(), table["_dst"].notna(), table[columns].to_dict("records"), strict=True)
        for key, src, dst, r in marks:
            r["geometry"] = [(p["lon"], p["lat"]) for p in r["geometry"]]
            members, plain = sets.setdefault((*(r[k] for k in keys), *key), ([], set()))
            members.append(r)
            plain.update(int(r[c]) for c, is_plain in (("src", src), ("dst", dst)) if is_plain)
        out = pd.DataFrame([e for members, plain in sets.values() for e in collapse(members, plain)], columns=columns)
        out["geometry"] = [[{"lon": x, "lat": y} for x, y in g] for g in out["geometry"]]
        return out

    # Sets are small, so a task takes many of them, about TASK_EDGES edges.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // TASK_EDGES))
    joined = work.groupBy(F.pmod(F.xxhash64(*keys, "_set"), F.lit(tasks)).alias("task")).applyInPandas(run, edges.schema)
    out = joined.unionByName(keyed.join(busy, [*keys, "_set"], "left_anti").select(*edges.columns)).withColumn("edge_id", F.xxhash64("src", "dst", "osmid", F.lit(False)))
    if profile is not None:
        out = out.withColumn("cost", tags.cost(geo.total(geo.lengths(F.col("geometry"))), tags.speed(F.col("level"), profile)))
    return out


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches, and stations."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(used, "node_id", "left_semi").unionByName(nodes.where(F.col("flags").bitwiseAND(tags.STATION) != 0).join(used, "node_id", "left_anti"))


def road_nodes(nodes: DataFrame, ways: DataFrame, relations: DataFrame, profile: str) -> DataFrame:
    """(node_id, lon, lat, flags) of the nodes that kept ways need."""
    points = nodes.select(F.col("id").alias("node_id"), "lon", "lat", tags.node_flags(F.col("tags"), profile).alias("flags")).join(needed_nodes(ways), "node_id", "left_semi")
    if profile in ("Bus", "Generic"):
        via = restrictions(relations).select(F.col("via_node").alias("node_id")).distinct().withColumn("_via", F.lit(tags.RESTRICTION))
        points = points.join(via, "node_id", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_via", F.lit(0)))).drop("_via")
    return points


def network(nodes: DataFrame, ways: DataFrame, relations: DataFrame, profile: str, mask: int, *, bridge: bool = True, skip_small: bool = False, box: tuple[float, float, float, float] | None = None, road: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a profile, ready for routing: chains joined, ways back added, the wrong way made dearer.

    nodes: (id, lon, lat, tags); ways: (id, refs, tags); relations: (id, tags, members). road: whose levels and speeds
    count, where coaches run on the bus network.
    """
    ways = kept_ways(ways, relations, profile, mask, skip_small)
    if box is not None:
        # Straight on the scan, which can step over what lies elsewhere.
        nodes = nodes.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    points = road_nodes(nodes, ways, relations, profile)
    edges = written(build_edges(ways, points, relations, profile, bridge, mask, road), "edges")
    edges = written(collapsed(edges, points, road or profile), "collapsed")
    parts = components(edges)
    points = without_isolated(points, edges).join(parts.select(F.col("node").alias("node_id"), F.col("component").alias("comp_id")), "node_id", "left")
    return points, with_wrong_way(with_reverse(edges), road or profile)


#: Profiles whose levels a road's segments are stored with.
ROADS = {"bus_level": "Bus", "coach_level": "Coach"}


def stored_roads(nodes: DataFrame, ways: DataFrame, relations: DataFrame, mask: int, path: str, skip_small: bool = False) -> tuple[DataFrame, T.StructType]:
    """Writes the segments of all roads by tile under path: the flagged nodes, and the schema to read tiles with.

    This is all that the whole map goes through: no chain is joined, no component found before a group has its tiles.
    """
    ways = written(kept_ways(ways, relations, "Bus", mask, skip_small), "roads")
    points = written(road_nodes(nodes, ways, relations, "Bus"), "road-nodes")
    places = ways.select(F.col("id").alias("way_id"), F.explode("refs").alias("node_id"))
    rows = tiles.tiled_segments(way_segments(ways, points, relations, "Bus", ROADS, False, mask, once=False), tiles.way_tiles(places, points))
    tiles.write_tiles(rows, path)
    return points.where("flags <> 0").select("node_id", "flags"), rows.schema


def group_network(rows: DataFrame, flagged: DataFrame, road: str, by: str = "group") -> DataFrame:
    """Edges of each group, ready for routing, from the segments of its tiles: chains joined, components found, ways back added, all within the group."""
    level = {v: k for k, v in ROADS.items()}[road]
    edges = written(edges_of(tiles.united(rows, by), road, level, by), "group-edges")
    edges = written(collapsed(edges, flagged, road, by), "group-collapsed")
    parts = components(edges, by).withColumnsRenamed({"node": "src", "component": "comp_id"})
    return with_wrong_way(with_reverse(edges, (by,)), road).join(parts, [by, "src"])


def attributes() -> Column:
    """An edge row as a map of text, for looking at."""
    line = lambda x: F.concat(x["short_name"], F.when((x["from_str"] != "") | (x["to_str"] != ""), F.concat(F.lit("("), x["from_str"], F.lit("->"), x["to_str"], F.lit(")"))).otherwise(""))
    plain = {k: F.col(k).cast("string") for k in ("oneway", "level", "allowed_modes", "osmid", "preferred_direction")}
    made = {"m_length": geo.total(geo.lengths(F.col("geometry"))).cast("string"), "cost": (F.col("cost") / 10).cast("string"), "restriction": F.when(F.col("restriction"), "yes").otherwise("no"), "lines": F.array_join(F.transform("lines", line), ",")}
    return F.create_map(*(x for k, v in (made | plain).items() for x in (F.lit(k), v)))
