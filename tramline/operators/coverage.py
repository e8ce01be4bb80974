"""Nearest nodes of stops, and the coloured route relation that covers a pattern best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import tags, text
from tramline.shared import written

#: How many nodes count as near a stop, and the share of stops that a relation must cover.
NEAREST, COVERED = 50, 0.5
#: Pairs of a point and a node that a task ranks.
TASK_PAIRS = 1_000_000


def nearest(points: DataFrame, nodes: DataFrame, k: int = NEAREST, size: float = 0.01, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(point_id, node_id, rank): the k nodes nearest in degrees, the smaller id first in a tie (to 1e-12).

    Points meet the nodes of the 3 x 3 grid cells around them. Those whose k-th node is farther than a cell may have missed
    one, and are searched again with cells twice as wide, until the grid is wider than the map.
    """
    box = nodes.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if box[0] is None:
        return points.select("point_id", F.lit(None).cast("bigint").alias("node_id"), F.lit(0).alias("rank")).limit(0)
    far = points.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    span = 0.0 if far[0] is None else max(max(box[1], far[1]) - min(box[0], far[0]), max(box[3], far[3]) - min(box[2], far[2]))
    best, out, left = Window.partitionBy("point_id").orderBy("d", "node_id"), None, points.select("point_id", "lon", "lat")
    while True:
        cell = lambda c, s=size: F.floor(F.col(c) / F.lit(s))
        around = F.explode(F.array(*(F.struct((cell("lon") + dx).alias("x"), (cell("lat") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
        there = nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.struct(cell("lon").alias("x"), cell("lat").alias("y")).alias("cell"))
        square = (F.col("lon") - F.col("x")) ** 2 + (F.col("lat") - F.col("y")) ** 2
        # Pairs of a round are counted by cell first; as many tasks as they ask for meet and rank them, so a task's share stays the same.
        asked, full = (x.groupBy("cell").agg(F.count("*").alias(n)) for x, n in ((left.withColumn("cell", around), "a"), (there, "b")))
        tasks = max(1, -(-(asked.join(full, "cell").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) // task_pairs))
        met = left.withColumn("cell", around).repartition(tasks, "cell").join(there.repartition(tasks, "cell"), "cell").select("point_id", "node_id", F.round(square, 12).alias("d"))
        found = met.repartition(tasks, "point_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = written(found.select("point_id", "node_id", "rank", "d"), "nearest")
        if size > span:
            done = found
        else:
            sure = found.where((F.col("rank") == k) & (F.col("d") <= size * size)).select("point_id")
            done, left = found.join(sure, "point_id", "left_semi"), left.join(sure, "point_id", "left_anti")
        out = done if out is None else out.unionByName(done)
        if size > span or left.isEmpty():
            return out.select("point_id", "node_id", "rank")
        size *= 2


def name_score(short: str, long: str, operator: str) -> Column:
    """2 for a relation one of whose names holds a name of the route or the other way round, and 1 for the operator."""
    t = F.col("tags")
    named = [text.holds_either_way(F.lower(tags.tag(t, key)), F.col(name)) for key in ("ref", "name", "official_name", "alt_name") for name in (short, long)]
    any_name = named[0]
    for test in named[1:]:
        any_name = any_name | test
    return F.when(any_name, 2).otherwise(0) + F.when(text.holds_either_way(F.lower(tags.tag(t, "operator")), F.col(operator)), 1).otherwise(0)


def covering_colours(patterns: DataFrame, nodes: DataFrame, members: DataFrame, relations: DataFrame, k: int = NEAREST) -> DataFrame:
    """(pattern_id, colour): of coloured relations near at least half of a pattern's stops, the best by name, then by stops.

    patterns: pattern_id, coords, short, long, agency (lower case); nodes of the pattern's network; members: relation_id, node_id.
    """
    stops = patterns.select("pattern_id", F.posexplode("coords").alias("i", "c")).select("pattern_id", "i", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))
    places = stops.select("lon", "lat").distinct().withColumn("point_id", F.xxhash64("lon", "lat"))
    coloured = relations.where(tags.tag(F.col("tags"), "colour").isNotNull()).select(F.col("id").alias("relation_id"), "tags")
    near = nearest(places, nodes, k).join(members.join(coloured.select("relation_id"), "relation_id", "left_semi"), "node_id").select("point_id", "relation_id").distinct()
    touched = stops.withColumn("point_id", F.xxhash64("lon", "lat")).join(near, "point_id").groupBy("pattern_id", "relation_id").agg(F.count("*").alias("stops"))
    rows = touched.join(patterns.select("pattern_id", F.size("coords").alias("n"), "short", "long", "agency"), "pattern_id").where((F.col("n") >= 2) & (F.col("stops") >= F.col("n") * COVERED))
    rows = rows.join(coloured, "relation_id")
    return rows.groupBy("pattern_id").agg(F.max_by(tags.tag(F.col("tags"), "colour"), F.struct(name_score("short", "long", "agency"), "stops", -F.col("relation_id"))).alias("colour"))
