import heapq
import itertools
import math
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tramline.operators import geometry, graph, routing
from tramline.operators.routing import Candidate, Edge, Network, Options, Router
from tramline.plans import search_queries

EDGES = "edge_id long, src long, dst long, geometry array<struct<lon:double,lat:double>>, lines array<struct<short_name:string,from_str:string,to_str:string>>, oneway int, cost long, level int, restriction boolean, is_reverse boolean, allowed_modes int, osmid long, preferred_direction int"


def edge(i, a, b, cost=10, oneway=0, lines=(), osmid=1):
    return (i, a, b, [(float(a), 0.0), (float(b), 0.0)], [(n, "", "") for n in lines], oneway, cost, 0, False, False, 8, osmid, 0)


def nodes(spark, flagged=()):
    return spark.createDataFrame([(i, float(i), 0.0, int(i in flagged)) for i in range(1, 12)], "node_id long, lon double, lat double, flags int")


def test_collapse_then_reverse(spark):
    out = graph.collapsed(spark.createDataFrame([edge(1, 1, 2), edge(2, 2, 3)], EDGES), nodes(spark))
    (row,) = out.collect()
    assert (row["src"], row["dst"], row["cost"], len(row["geometry"])) == (1, 3, 20, 3)
    both = graph.with_reverse(out).orderBy("is_reverse").collect()
    assert [(r["src"], r["dst"], r["is_reverse"]) for r in both] == [(1, 3, False), (3, 1, True)]


def test_collapse_stops_at_differences(spark):
    plain = [edge(1, 1, 2), edge(2, 2, 3)]
    assert graph.collapsed(spark.createDataFrame([edge(1, 1, 2, lines=["a"]), plain[1]], EDGES), nodes(spark)).count() == 2
    assert graph.collapsed(spark.createDataFrame(plain, EDGES), nodes(spark, {2})).count() == 2
    assert graph.collapsed(spark.createDataFrame([edge(1, 1, 2, oneway=1), edge(2, 3, 2, oneway=1)], EDGES), nodes(spark)).count() == 2
    (one,) = graph.collapsed(spark.createDataFrame([edge(1, 2, 3, oneway=1), edge(2, 1, 2, oneway=1, osmid=7)], EDGES), nodes(spark)).collect()
    assert (one["src"], one["dst"], one["osmid"], one["oneway"]) == (1, 3, 0, 1)


def test_collapse_keeps_the_second_of_two_ways_between_the_same_ends(spark):
    rows = [edge(1, 1, 2), edge(2, 2, 3), edge(3, 1, 4), edge(4, 4, 3), edge(5, 5, 1), edge(6, 3, 6)]
    out = graph.collapsed(spark.createDataFrame(rows, EDGES), nodes(spark))
    pairs = sorted(tuple(sorted((r["src"], r["dst"]))) for r in out.collect())
    assert pairs == [(1, 3), (1, 4), (1, 5), (3, 4), (3, 6)]


def test_components_match_a_search(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(99, 99)]
    root = {n: n for pair in links for n in pair}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = dict(graph.components(spark.createDataFrame(links, "src long, dst long")).collect())
    assert found == {n: top(n) for n in root}


def test_wrong_way(spark):
    rows = spark.createDataFrame([(2, 100), (1, 100)], "oneway int, cost long")
    assert [r["cost"] for r in graph.with_wrong_way(rows, "Rail").collect()] == [3500, 100]
    assert [r["cost"] for r in graph.with_wrong_way(rows, "TramSubway").collect()] == [200, 100]


def test_turns():
    assert not routing.allowed("negative", [(1, 2)], (1, 2)) and routing.allowed("negative", [(1, 2)], (1, 3))
    assert routing.allowed("positive", [(1, 2)], (1, 2)) and not routing.allowed("positive", [(1, 2)], (1, 3)) and routing.allowed("positive", [(1, 2)], (4, 3))


def random_network(rng, n=14, modes=8):
    places = {i: (rng.random() * 0.05, rng.random() * 0.05) for i in range(n)}
    pairs = {(a, b) for a in range(n) for b in rng.sample(range(n), 3) if a != b}
    edges = {k: Edge(a, b, rng.randrange(50, 4000), [places[a], places[b]], modes=modes) for k, (a, b) in enumerate(sorted(pairs))}
    return Network(edges, places, dict.fromkeys(range(n), 1))


def all_pairs(net, cost):
    """Least cost from entering edge i to entering edge j, by repeated relaxation."""
    ids = sorted(net.edges)
    d = {(i, j): 0 if i == j else float("inf") for i in ids for j in ids}
    step = {(i, j): cost.edge(i) + cost.turn(i, j) for i in ids for j in net.out.get(net.edges[i].dst, ())}
    for _ in ids:
        changed = False
        for (i, j), w in step.items():
            for s in ids:
                if d[s, i] + w < d[s, j]:
                    d[s, j], changed = d[s, i] + w, True
        if not changed:
            break
    return d


@pytest.mark.parametrize("seed", range(4))
def test_search_is_cheapest(seed):
    net = random_network(random.Random(seed))
    costs = routing.Costs(net, "", Options())
    d = all_pairs(net, costs)
    ids = sorted(net.edges)
    start = ids[0]
    best = routing.search(costs, {start: 0}, set(), 10**9).cost
    assert best == {j: d[start, j] for j in ids if d[start, j] < float("inf")}
    for target in ids[1:6]:
        found = routing.search(costs, {start: 0}, {target}, 10**9)
        assert (target not in found.cost) == (d[start, target] == float("inf"))
        if target in found.cost:
            path = found.path(target)
            assert found.cost[target] == d[start, target]
            assert sum(costs.edge(a) + costs.turn(a, b) for a, b in zip(path, path[1:], strict=False)) >= d[start, target]
            assert path[0] == start and path[-1] == target


@pytest.mark.parametrize("seed", range(4))
def test_node_searches_agree(seed):
    rng = random.Random(seed)
    net = random_network(rng)
    one = routing.many_to_many(net, {0: 0.0}, set(range(14)), 1e9, 8)
    for target in range(1, 14):
        found = routing.cheapest_path(net, 0, target, 8)
        assert (found is None) == (target not in one)
        if found:
            assert found[0] == pytest.approx(one[target][0])
            assert sum(net.edges[e].cost for e in found[1]) == found[0]


def test_path_modes_and_lines():
    places = {0: (0.0, 0.0), 1: (0.01, 0.0), 2: (0.005, 0.005)}
    rail, bus = Edge(0, 1, 100, [places[0], places[1]], modes=1), Edge(0, 1, 100, [places[0], places[1]], modes=8)
    net = Network({1: rail, 2: bus}, places)
    assert routing.cheapest_path(net, 0, 1, 1)[1] == [1] and routing.cheapest_path(net, 0, 1, 8)[1] == [2] and routing.cheapest_path(net, 0, 1, 0) is None
    assert routing.cheapest_path(net, 0, 1, 2, fallback=8) == (1000.0, [2])
    detour = {1: Edge(0, 1, 1_000_000, [], modes=8), 2: Edge(0, 2, 1000, [], modes=8), 3: Edge(2, 1, 1000, [], modes=8)}
    assert routing.cheapest_path(Network(detour, places), 0, 1, 8) == (2000.0, [2, 3])
    own = {1: Edge(0, 1, 12000, [], (("9", "", ""),), modes=8), 2: Edge(0, 2, 7000, [], (("5", "", ""),), modes=8), 3: Edge(2, 1, 7000, [], (("5", "", ""),), modes=8)}
    assert routing.cheapest_path(Network(own, places), 0, 1, 8, line="5") == (pytest.approx(2800.0), [2, 3])
    assert routing.cheapest_path(Network(detour, places), 0, 1, 8, box=(-1, -1, 1, 0.001)) == (1_000_000.0, [1])


@pytest.mark.parametrize("seed", range(8))
def test_paths_from_both_ends_are_cheapest(seed):
    """Against a plain search, with networks to fall back on, a line's two names and a box."""
    rng = random.Random(300 + seed)
    names = ("", "5", "Line 5", "Ring", "7")
    side = 14
    places = {i: (0.01 * (i % side) + rng.random() * 0.002, 0.01 * (i // side) + rng.random() * 0.002) for i in range(side * side)}
    pairs = [(i, j) for i in places for j in (i + 1, i + side, i - 1, i - side) if j in places and abs(i % side - j % side) <= 1]
    edges = {k: Edge(a, b, int(routing.metres_between(places[a], places[b]) * rng.uniform(0.3, 0.6)), [], ((rng.choice(names), "", ""),), modes=rng.choice((8, 8, 8, 1, 2))) for k, (a, b) in enumerate(pairs)}
    net = Network(edges, places)
    for line, long_name, box in (("", "", None), ("5", "", None), ("bus 5", "ring road", None), ("", "RING", (0.0, 0.0, 0.09, 0.09))):
        inside = lambda n: box is None or (places[n][0] <= box[2] and places[n][1] <= box[3])  # noqa: B023, E731
        best, queue = {0: 0.0}, [(0.0, 0)]
        while queue:
            d, n = heapq.heappop(queue)
            if d > best[n]:
                continue
            for i in net.out.get(n, ()):
                price = routing.node_costs(net, i, 8, 1, line, long_name)
                if price is not None and inside(edges[i].dst) and d + price < best.get(edges[i].dst, math.inf):
                    best[edges[i].dst] = d + price
                    heapq.heappush(queue, (d + price, edges[i].dst))
        for target in (5, 100, 137, side * side - 1):
            found = routing.meet_in_the_middle(net, 0, target, 8, 1, line, long_name, box)
            assert (found is None) == (target not in best)
            if found is not None:
                cost, path, _ = found
                assert cost == pytest.approx(best[target]) == pytest.approx(sum(routing.node_costs(net, i, 8, 1, line, long_name) for i in path))
                assert edges[path[0]].src == 0 and edges[path[-1]].dst == target and all(edges[a].dst == edges[b].src for a, b in pairwise(path)) and all(inside(edges[i].dst) for i in path)


def test_potentials_keep_searches_between_their_ends():
    """From corner to corner of the middle of a large even grid: a third of the nodes that two plain searches would settle, and the same cost."""
    side = 60
    places = {i: (0.001 * (i % side), 0.001 * (i // side)) for i in range(side * side)}
    pairs = [(i, j) for i in places for j in (i + 1, i + side, i - 1, i - side) if j in places and abs(i % side - j % side) <= 1]
    rng = random.Random(5)
    edges = {k: Edge(a, b, 60 + rng.randrange(4), [], modes=8) for k, (a, b) in enumerate(pairs)}
    start, end = 30 * side + 20, 30 * side + 40
    guided, plain = (routing.meet_in_the_middle(Network(edges, p), start, end, 8, 0, "", "", None) for p in (places, {}))
    assert guided[0] == plain[0] and guided[2] < plain[2] / 3


def test_names_fit_in_both_directions():
    of = lambda name: Network({1: Edge(0, 1, 100, [], ((name, "", ""),), modes=8)}, {})
    cost = lambda name, *line: routing.node_costs(of(name), 1, 8, 0, *line)
    assert cost("Bus 100", "100") == cost("100", "bus 100") == cost("RING", "x", "Ring Road") == 20.0 and cost("7", "5", "Ring") == 100.0 and cost("5", "") == 100.0


def test_best_sequence():
    net = Network({1: Edge(2, 3, 5, [], modes=8), 2: Edge(3, 4, 5, [], modes=8)}, {})
    groups = [[(0, 0.0), (2, 0.0)], [(1, 0.0), (3, 0.0)], [(4, 0.0)]]
    assert routing.best_sequence(net, groups, 8) == (10.0, [2, 3, 4])
    assert routing.best_sequence(net, [[(4, 0.0)], [(2, 0.0)]], 8) is None


def line_network(n=6, names=(("", "", ""),)):
    places = {i: (i * 0.01, 0.0) for i in range(n)}
    edges = {}
    for i in range(n - 1):
        edges[2 * i] = Edge(i, i + 1, 400, [places[i], places[i + 1]])
        edges[2 * i + 1] = Edge(i + 1, i, 400, [places[i + 1], places[i]])
    return Network(edges, places, dict.fromkeys(places, 1))


def test_route_along_a_line():
    net = line_network()
    stops = [(0.005, 0.0001), (0.025, 0.0001), (0.045, 0.0001)]
    groups = [[Candidate(None, point=s), *(Candidate(e, 0.4, 0.5) for e in (2 * i, 2 * i + 1))] for s, i in zip(stops, (0, 2, 4), strict=True)]
    hops, cost = Router(net, Options()).route("", stops, groups, [0, 300, 600], [0, 320, 600])
    assert [h["edges"] for h in hops] == [[0, 2, 4], [4, 6, 8]]
    # Three penalties, the middle one twice, and twice 800 tenths of a second.
    assert cost == pytest.approx(4 * 0.4 + 2 * 0.0083 * 80)
    points = geometry.shape_points(hops, {e: net.shape(e) for h in hops for e in h["edges"]})
    assert points[0] == (0.0, pytest.approx(0.005)) and points[-1] == (0.0, pytest.approx(0.045)) and len(points) == len(set(points)) == 7


def test_route_fallbacks():
    net = line_network(4)
    net.component = {0: 1, 1: 1, 2: 2, 3: 2}
    stops = [(0.005, 0.0), (0.025, 0.0)]
    apart = [[Candidate(None, point=stops[0]), Candidate(0, 0.4, 0.5)], [Candidate(None, point=stops[1]), Candidate(4, 0.4, 0.5)]]
    hops, cost = Router(net, Options()).route("", stops, apart, [0, 60], [0, 60])
    assert hops[0]["edges"] == [] and cost == pytest.approx(0.4)
    alone = [[Candidate(None, point=s)] for s in stops]
    hops, _ = Router(net, Options()).route("", stops, alone, [0, 60], [0, 60])
    assert geometry.shape_points(hops, {}) == [(0.0, 0.005), (0.0, 0.025)]
    # A pattern of a named line where no edge is near.
    hops, _ = Router(Network({}, {}), Options()).route("7", stops, alone, [0, 60], [0, 60])
    assert geometry.shape_points(hops, {}) == [(0.0, 0.005), (0.0, 0.025)]
    three = [*alone, [Candidate(None, point=(0.03, 0.0))]]
    assert Router(net, Options()).route("", [*stops, (0.03, 0.0)], three, [0, 100, 200], [0, 50, 200]) == ([], routing.FAR)


def test_same_edge_only_forwards():
    net = line_network(2)
    r = Router(net, Options())
    a, b = [Candidate(0, 0.0, 0.2)], [Candidate(0, 0.0, 0.7)]
    assert r.matrix("", a, b, 5000) == {(0, 0): 200} and r.matrix("", b, a, 5000) == {}


@pytest.mark.parametrize("seed", range(6))
def test_routes_are_cheapest(seed):
    """Against every choice of candidates, over costs between all pairs of edges; two components, so that some hops have no way."""
    rng = random.Random(100 + seed)
    net = random_network(rng)
    far = {n + 50: (x + 0.01, y) for n, (x, y) in net.places.items()}
    other = random_network(rng)
    shifted = {i + 500: Edge(e.src + 50, e.dst + 50, e.cost, [far[e.src + 50], far[e.dst + 50]], modes=8) for i, e in other.edges.items()}
    net = Network(net.edges | shifted, net.places | far, dict.fromkeys(net.places, 1) | dict.fromkeys(far, 2))
    options = Options()
    costs, ids = routing.Costs(net, "", options), sorted(net.edges)
    d = all_pairs(net, costs)
    stops = [(rng.random() * 0.05, rng.random() * 0.05) for _ in range(4)]
    # No edge serves two stops: an end on a start's own edge is reached from there alone.
    some = rng.sample(ids, 20)
    groups = [[Candidate(None, point=s), *(Candidate(e, rng.random(), rng.random()) for e in some[5 * i : 5 * i + 5])] for i, s in enumerate(stops)]
    times = [5000.0 * i for i in range(len(stops))]
    hops, cost = Router(net, options).route("", stops, groups, times, times)

    def step(a, b):
        if a.edge is None or b.edge is None:
            return math.inf
        off, on = int(costs.edge(a.edge) * a.progr), int(costs.edge(b.edge) * b.progr)
        if a.edge == b.edge:
            return on - off if a.progr <= b.progr else math.inf
        return max(0, d[a.edge, b.edge] - off) + on

    best = math.inf
    for choice in itertools.product(*groups):
        price = sum(c.pen for c in choice) + sum(c.pen for c in choice[1:-1]) + sum(options.transition * step(a, b) / 10 for a, b in pairwise(choice))
        best = min(best, price)
    # Starts are ranked in whole tenths of a second.
    assert best < math.inf and cost == pytest.approx(best, abs=len(hops) * 0.001) and len(hops) == 3
    for hop in hops:
        assert hop["edges"][0] == hop["start_edge"] and hop["edges"][-1] == hop["end_edge"]
        assert all(net.edges[a].dst == net.edges[b].src for a, b in pairwise(hop["edges"]))


@pytest.mark.parametrize("seed", range(30))
def test_collapse_is_an_ascending_pass(seed):
    """Against nodes taken out one by one, smallest first, wherever that puts no two edges between the same nodes."""
    rng = random.Random(seed)
    pairs = sorted({tuple(rng.sample(range(8), 2)) for _ in range(rng.randrange(2, 12))})
    rows = [{"src": a, "dst": b, "edge_id": 100 * a + b, "geometry": [(a, 0), (100 * a + b, 1), (b, 0)], "cost": rng.randrange(1, 50), "osmid": 7, "oneway": 0, "is_reverse": False} for a, b in pairs]
    links = [(frozenset(p), r["cost"]) for p, r in zip(pairs, rows, strict=True)]
    plain = {n for n in range(8) if sum(n in p for p, _ in links) == 2 and len({*(m for p, _ in links if n in p for m in p)}) == 3}
    for n in sorted(plain):
        mine = [x for x in links if n in x[0]]
        ends = frozenset(m for p, _ in mine for m in p if m != n)
        if len(ends) == 2 and not any(p == ends for p, _ in links):
            links = [x for x in links if n not in x[0]] + [(ends, sum(c for _, c in mine))]
    found = graph.collapse(rows, plain)
    assert sorted((sorted(p), c) for p, c in links) == sorted((sorted({e["src"], e["dst"]}), e["cost"]) for e in found)
    for e in found:
        assert e["geometry"][0] == (e["src"], 0) and e["geometry"][-1] == (e["dst"], 0) and len(set(e["geometry"])) == len(e["geometry"]) >= 3


def test_costs():
    places = {0: (0.0, 0.0), 1: (0.01, 0.0), 2: (0.01, 0.01), 3: (0.02, 0.0), 4: (0.0005, 0.001)}
    link = lambda a, b, lines=(): Edge(a, b, 1000, [places[a], places[b]], lines)
    net = Network({1: link(0, 1), 2: link(1, 2), 3: link(1, 3, (("9", "", ""),)), 4: link(1, 0), 5: link(1, 4, (("7", "", ""),))}, places)
    c = routing.Costs(net, "7", Options(full_turn=1200, turn_angle=20.0))
    # No lines at all is dearest, another line next, the own line free.
    assert (c.edge(1), c.edge(3), c.edge(5)) == (1386, 1200, 1000)
    assert c.turn(1, 4) == 1200 and c.turn(1, 2) == 0 and c.turn(1, 3) == 0 and c.turn(1, 5) == 1200
    # Where only two edges meet, no turn is sharp.
    assert routing.Costs(Network({1: link(0, 1), 5: link(1, 4)}, places), "", Options()).turn(1, 5) == 0
    # Restrictions count only where they are given a price.
    net.edges[1].restriction, net.forbidden = True, {1: [(1, 3)]}
    assert routing.Costs(net, "", Options()).turn(1, 3) == 0 and routing.Costs(net, "", Options(restricted_turn=500)).turn(1, 3) == 500


def test_geometry_parts():
    line = geometry.Line([(0.0, 0.0), (1.0, 0.0)])
    assert [round(x, 6) for x, _ in line.part(0.25, 0.75)] == [0.25, 0.75]
    assert len(geometry.Line([(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]).part(0.1, 0.9)) == 3
    assert [round(x, 6) for x, _ in line.part(0.75, 0.25)] == [0.75, 0.25]
    straight = {"edges": [], "start_edge": None, "end_edge": None, "start_progr": 0.0, "end_progr": 0.0, "start_point": (-88.0, 42.0), "end_point": (-88.1, 42.1)}
    assert geometry.shape_points([straight], {}) == [(42.0, -88.0), (42.1, -88.1)]


def test_restrictions_of_relations(spark):
    rows = [(1, {"type": "restriction", "restriction": "no_left_turn"}, [("way", 10, "from"), ("node", 5, "via"), ("way", 11, "to")]), (2, {"type": "restriction", "restriction": "no_left_turn", "except": "taxi; bus"}, [("node", 6, "via")]), (3, {"type": "restriction", "restriction": "no_left_turn"}, [("way", 10, "from")])]
    found = graph.restrictions(spark.createDataFrame(rows, "id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>"))
    assert [tuple(r) for r in found.select("kind", "from_way", "via_node", "to_way").collect()] == [("negative", 10, 5, 11)]


def test_isolated_nodes(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "node_id long, flags int")
    assert sorted(r["node_id"] for r in graph.without_isolated(rows, edges).collect()) == [1, 2, 4]
    assert dict(graph.degrees(spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")).collect()) == {1: 1, 2: 2}
    _ = F


def test_costs_by_stretch_are_those_of_one_search(spark):
    """Random edges that lead on and back over many stretches, in all sizes; and no edges at all."""
    rng = random.Random(17)
    edges = {(a, b): rng.randrange(0, 30) for a in range(300) for b in (a + 1, a + 7, a - 11, rng.randrange(300)) if 0 <= b < 300 and a != b and rng.random() < 0.6}
    best, changed = {3: 0}, True
    while changed:
        changed = False
        for (a, b), c in edges.items():
            if a in best and best[a] + c < best.get(b, 10**9):
                best[b], changed = best[a] + c, True
    frame = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src long, dst long, cost long")
    for size in (1000, 90, 16):
        assert {r["node"]: r["cost"] for r in search_queries.costs_by_stretch(frame, 3, size).collect()} == best
    assert [tuple(r) for r in search_queries.costs_by_stretch(frame.limit(0), 0).collect()] == [(0, 0)]
