from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import coverage, graph, routing

NODES = [(r * 10 + c, c * 0.01, r * 0.01) for r in range(10) for c in range(10)]


def test_nearest_widens_until_it_is_sure(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, lon double, lat double")
    points = [(1, 0.0, 0.0), (2, 0.043, 0.051), (3, 0.5, 0.5)]
    got = coverage.nearest(spark.createDataFrame(points, "point_id long, lon double, lat double"), nodes, 7, 0.004)
    for i, x, y in points:
        want = sorted((round((x - a) ** 2 + (y - b) ** 2, 12), n) for n, a, b in NODES)[:7]
        assert [r["node_id"] for r in got.where(F.col("point_id") == i).orderBy("rank").collect()] == [n for _, n in want]
    assert coverage.nearest(spark.createDataFrame(points, "point_id long, lon double, lat double"), nodes.limit(0)).count() == 0


def test_colour_of_the_covering_relation(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, lon double, lat double")
    patterns = spark.createDataFrame([(1, [(0.0, 0.0), (0.03, 0.0), (0.06, 0.0)], "7", "long line", "town")], "pattern_id long, coords array<struct<lon:double,lat:double>>, short string, long string, agency string")
    relations = spark.createDataFrame([(1, {"colour": "red", "ref": "9"}), (2, {"colour": "blue", "ref": "7", "operator": "Town"}), (3, {"ref": "7"}), (4, {"colour": "green", "ref": "7"})], "id long, tags map<string,string>")
    members = lambda *m: spark.createDataFrame([(r, n) for r, ns in m for n in ns], "relation_id long, node_id long")
    best = lambda m: [r["colour"] for r in coverage.covering_colours(patterns, nodes, m, relations, 1).collect()]
    assert best(members((1, (0, 3, 6)), (2, (0, 3)), (3, (0, 3, 6)), (4, (0, 3, 6)))) == ["blue"]
    assert best(members((1, (0, 3, 6)), (4, (0,)))) == ["red"]
    assert best(members((2, (6,)), (4, (0, 3)))) == ["green"]
    assert best(members((1, (50,)))) == []


def test_small_helpers(spark):
    row = spark.range(1).select(geo.flat_distance(F.lit(7.501), F.lit(47.9), F.lit(7.5), F.lit(47.9)).alias("flat"), geo.haversine(F.lit(7.501), F.lit(47.9), F.lit(7.5), F.lit(47.9)).alias("round")).first()
    assert abs(row["flat"] / row["round"] - 1) < 0.002
    edge = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.01)], [("7", "", "End"), ("8", "", "")], 1, 25, 2, True, 8, 5, 0)], "geometry array<struct<lon:double,lat:double>>, lines array<struct<short_name:string,from_str:string,to_str:string>>, oneway int, cost long, level int, restriction boolean, allowed_modes int, osmid long, preferred_direction int")
    got = edge.select(graph.attributes().alias("a")).first()["a"]
    assert (got["lines"], got["cost"], got["restriction"], got["osmid"]) == ("7(->End),8", "2.5", "yes", "5")


def test_matrix_covers_every_pair():
    places = {i: (i * 0.01, 0.0) for i in range(5)}
    edges = {i: routing.Edge(i, i + 1, 400, [places[i], places[i + 1]]) for i in range(4)}
    net = routing.Network(edges, places, dict.fromkeys(places, 1))
    at = lambda e, p: routing.Candidate(e, 0.0, p)
    got = routing.Router(net, routing.Options()).matrix("", [at(0, 0.5), at(1, 0.25), routing.Candidate(None)], [at(1, 0.5), at(3, 0.5)], 10_000)
    assert got == {(0, 0): 400, (0, 1): 1200, (1, 0): 100, (1, 1): 900}
