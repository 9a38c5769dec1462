"""Hand-made frames: exact results, invariants, and gates that must fail."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from waymark.operators import clean, evaluate, gates, graph, models, order, panel, portfolio, spatial
from waymark.sources import snapshot


def test_severity(spark):
    texts = ["  incapacitating injury\t", "Reported, Not Evident", "NONINCAPACITATING INJURY ", "\n", "K", "fatal!", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(clean.map_severity(F.col("s")), clean.severity_unmapped(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("A", False), ("C", False), ("B", False), ("U", False), ("U", True), ("U", True), ("U", False)]


def test_coordinates(spark):
    rows = [("41", "-89", "valid"), ("43.0", " -87 ", "valid"), ("40.9999", "-88", "out_of_range"), ("-88", "42", "out_of_range"), (" ", "-88", "incomplete_pair"), ("north", "", "incomplete_pair"), ("42", "1e2x", "non_numeric"), ("", "\t", "missing_pair")]
    df = spark.createDataFrame(rows, "lat string, lon string, want string")
    got = df.select(clean.classify_coordinates(F.col("lat"), F.col("lon")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_dates_in_mixed_formats(spark):
    texts = ["1999-02-03", "1999-02-03T04:05:06.000", "2/3/1999", "02/03/1999 04:05:06 PM", "02/03/1999 23:59", "Feb 3, 1999", "3 Feb 1999", "19990203", " 1999-02-03 ", "1999-02-30", "3.2.1999", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(clean.parse_date(F.col("s")).cast("string")).collect()]
    assert got == ["1999-02-03"] * 9 + [None] * 4


def test_clean_rows_equals_the_column_functions(spark):
    rows = [("1", " Fatal ", "1/2/2000", "7.0", " 3.5", "y", "42", "-88", "n. main"), ("2", None, "x", "2.5", "z", " ", "", None, "--")]
    df = spark.createDataFrame(rows, "record_id string, injury string, event_date string, lanes string, speed string, flag string, lat string, lon string, street string")
    got = clean.clean_rows(df).select("kabco", "event_day", "lanes", "speed", "flag", "coordinate_status", "street").collect()
    c = F.col
    want = df.select(clean.map_severity(c("injury")), clean.parse_date(c("event_date")), clean.coerce_integer(c("lanes")), clean.coerce_float(c("speed")), clean.normalize_string(c("flag"), True), clean.classify_coordinates(c("lat"), c("lon")), clean.normalize_street(c("street"))).collect()
    assert list(map(tuple, got)) == list(map(tuple, want)) and got[1].lanes is None and got[0].lanes == 7


def test_integers(spark):
    df = spark.createDataFrame([("7.0",), ("3.5",), ("x",), (" ",), (None,), (" 12 ",)], "s string")
    rows = df.select(clean.coerce_integer(F.col("s")), clean.invalid_integer(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(7, False), (None, True), (None, True), (None, False), (None, False), (12, False)]


LINES = [("C1", 0, 0, 0.0, 0.0, 1000.0, 0.0), ("C2", 0, 0, 0.0, 30.0, 1000.0, 30.0), ("C3", 0, 0, 0.0, 250.0, 1000.0, 250.0), ("C3", 1, 0, 0.0, 255.0, 1000.0, 255.0)]
SEGMENTS = "unit_id string, part int, seq int, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize(("y", "status"), [(5.0, "primary_assigned"), (11.0, "unresolved_tie"), (12.0, "unresolved_tie"), (140.0, "outside_selected_threshold"), (248.0, "primary_assigned"), (10.0, "unresolved_tie")])
def test_assignment(spark, y, status):
    points = spark.createDataFrame([("a", 500.0, y, True), ("z", 500.0, 5.0, False)], "event_id string, x double, y double, valid boolean")
    pairs = spatial.within_distance(points.filter("valid"), spark.createDataFrame(LINES, SEGMENTS), 100.0)
    got = {r.event_id: r for r in spatial.assign(points, spatial.rank_candidates(pairs, 10.0)).collect()}
    assert got["a"].assignment_status == status and got["z"].assignment_status == "no_valid_coordinates"
    assert (got["a"].unit_id is not None) == (status == "primary_assigned")


def test_columns_of_other_names(spark):
    """Points, lines and panels give the same whatever their keys are called."""
    names = {"event_id": "crash", "unit_id": "road", "month_start": "when"}
    other = lambda df: df.withColumnsRenamed(names)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    points = spark.range(40).selectExpr("int(id) as event_id", "double(id * 37 % 100) as x", "double(id * 61 % 100) as y", "id % 9 <> 0 as valid")
    lines = spark.createDataFrame([(1, 0, 0, 0.0, 10.0, 100.0, 10.0), (2, 0, 0, 0.0, 14.0, 100.0, 60.0), (2, 1, 0, 50.0, 0.0, 50.0, 100.0)], SEGMENTS)
    key, unit = {"key": "crash", "unit": "road"}, {"unit": "road"}
    pairs, again = spatial.within_distance(points.filter("valid"), lines, 20.0), spatial.within_distance(other(points).filter("valid"), other(lines), 20.0, **key)
    assert rows(pairs) == rows(again)
    ranked, ranked_again = spatial.rank_candidates(pairs, 1.0), spatial.rank_candidates(again, 1.0, **key)
    got = spatial.assign(other(points), ranked_again, **key)
    assert rows(ranked) == rows(ranked_again) and rows(spatial.assign(points, ranked)) == rows(got) and got.columns[:3] == ["crash", "assignment_status", "road"]
    assert rows(spatial.sensitivity(pairs, F.lit(40.0), (5.0, 20.0), 1.0)) == rows(spatial.sensitivity(again, F.lit(40.0), (5.0, 20.0), 1.0, **key))
    assert rows(spatial.line_figures(lines)) == rows(spatial.line_figures(other(lines), **unit)) and rows(spatial.carriageway_lengths(lines)) == rows(spatial.carriageway_lengths(other(lines), **unit))
    panel_ = spark.range(48).selectExpr("int(id % 2) as unit_id", "add_months(date'2020-01-01', int(id / 2)) as month_start", "double(id * 7 % 5) as v")
    assert rows(models.recursive_mean_forecast(panel_, "v")) == rows(models.recursive_mean_forecast(other(panel_), "v", unit="road", month="when"))


def test_overlay_splits_at_borders(spark):
    seg = spark.createDataFrame([("L", 0, 0, 0.0, 5.0, 30.0, 5.0)], SEGMENTS)
    edges = [(p, a, b, c, d) for p, o in ((1, 0.0), (2, 10.0)) for a, b, c, d in ((o, 0.0, o + 10, 0.0), (o + 10, 0.0, o + 10, 10.0), (o + 10, 10.0, o, 10.0), (o, 10.0, o, 0.0))]
    got = {r.poly_id: r.length for r in spatial.overlay_lengths(seg, spark.createDataFrame(edges, "poly_id int, ex1 double, ey1 double, ex2 double, ey2 double"), 8.0).collect()}
    assert got == pytest.approx({1: 10.0, 2: 10.0})


def _inside(x, y, edges):
    return sum((a <= x) != (c <= x) and y < b + (x - a) / (c - a) * (d - b) for a, b, c, d in edges) % 2 == 1


@pytest.mark.parametrize("cell", [4.0, 11.0, 60.0])
def test_overlay_of_stars(spark, cell):
    """Lines over star-shaped polygons of many sizes, one of them with a hole: lengths by fine sampling."""
    import random

    rng, polygons = random.Random(6), {}
    for p in range(6):
        cx, cy, size = rng.uniform(0, 50), rng.uniform(0, 50), rng.choice([3, 9, 25])
        ring = [(cx + size * r * math.cos(a), cy + size * r * math.sin(a)) for k in range(14) for a, r in [(2 * math.pi * k / 14, rng.uniform(0.3, 1))]]
        polygons[p] = [(*ring[k], *ring[(k + 1) % 14]) for k in range(14)]
    polygons[6] = [(a, b, c, d) for o, w in ((5.0, 40.0), (15.0, 12.0)) for a, b, c, d in ((o, o, o + w, o), (o + w, o, o + w, o + w), (o + w, o + w, o, o + w), (o, o + w, o, o))]
    lines = [(f"L{k}", 0, 0, *[rng.uniform(-10, 60) for _ in range(4)]) for k in range(12)] + [("V", 0, 0, 20.0, -10.0, 20.0, 60.0), ("H", 0, 0, -10.0, 20.0, 60.0, 20.0), ("P", 0, 0, 3.0, 3.0, 3.0, 3.0)]
    edges = [(p, *e) for p, es in polygons.items() for e in es]
    got = {(r.unit_id, r.poly_id): r.length for r in spatial.overlay_lengths(spark.createDataFrame(lines, SEGMENTS), spark.createDataFrame(edges, "poly_id int, ex1 double, ey1 double, ex2 double, ey2 double"), cell).collect()}
    n = 4000
    for name, _, _, x1, y1, x2, y2 in lines:
        for p, es in polygons.items():
            share = sum(_inside(x1 + (k + 0.5) / n * (x2 - x1), y1 + (k + 0.5) / n * (y2 - y1), es) for k in range(n)) / n
            length = math.hypot(x2 - x1, y2 - y1)
            assert got.get((name, p), 0.0) == pytest.approx(share * length, abs=8 * length / n + 1e-9)


def test_points_of_a_city_centre(spark):
    """Nine tenths of the points in one cell, a third of all in one spot: same pairs as all against all, and no leaf with many points."""
    import random

    rng = random.Random(2)
    pts = [(k, rng.uniform(0, 90), rng.uniform(0, 90)) for k in range(900)] + [(900 + k, 33.0, 44.0) for k in range(500)] + [(1400 + k, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for k in range(150)]
    segs = [(f"u{k}", 0, 0, *[rng.uniform(-200, 300) for _ in range(4)]) for k in range(30)] + [("far", 0, 0, -3000.0, -3000.0, 3000.0, 3000.0), ("dot", 0, 0, 33.0, 44.0, 33.0, 44.0)]
    points, segments = spark.createDataFrame(pts, "event_id int, x double, y double"), spark.createDataFrame(segs, SEGMENTS)
    want = {}
    for e, x, y in pts:
        for u, _, _, x1, y1, x2, y2 in segs:
            l2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) if l2 else 0.0
            d = math.hypot(x1 + t * (x2 - x1) - x, y1 + t * (y2 - y1) - y)
            if d <= 40:
                want[e, u] = d
    got = spatial.within_distance(points, segments, 40.0, 400.0, 60).collect()
    assert len(got) == len(want) and all(r.distance == pytest.approx(want[r.event_id, r.unit_id], abs=1e-9) for r in got)
    tree = spatial.Quadtree(points, 400.0, 60)
    leaves = tree.place(points, "event_id").groupBy("level", "cx", "cy", "salt").count().collect()
    assert tree.depth == spatial.SPLITS + 1 and sum(r["count"] for r in leaves) == len(pts) and max(r["count"] for r in leaves) <= 100
    assert spatial.Quadtree(points, 400.0, 10**6).depth == 0


@pytest.mark.parametrize("rows", [7, 10**6])
def test_ranks_and_percentiles(spark, rows):
    """By ranges and by one task alike: ties, nulls, null groups, a value that a third of all rows have."""
    import random

    import numpy as np
    import pandas as pd

    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([5.0, rng.uniform(0, 9), float(rng.randrange(9))]) if rng.random() < 0.9 else None) for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    frame = pd.DataFrame(data, columns=["g", "v"])
    for g, own in frame.groupby("g", dropna=False):
        v = own["v"].dropna().to_numpy()
        r = order.percentiles(df, ["g"], "v", {"p": 0.5, "q": 0.95, "least": 0.0}, rows).filter(F.col("g").eqNullSafe(F.lit(None if pd.isna(g) else g))).collect()
        assert len(r) == (len(v) > 0)
        for x in r:
            assert (x.p, x.q, x.least) == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.95), v.min()))
    ranks = order.with_ranks(df, ["g"], {"r": "v"}, rows).toPandas()
    own = ranks.groupby("g", dropna=False)["v"]
    for name, kind in (("up", {"method": "min"}), ("down", {"method": "min", "ascending": False}), ("mean", {"method": "average"})):
        assert np.allclose(ranks[f"r_{name}"].astype(float), own.rank(**kind).astype(float), equal_nan=True)
    assert order.percentiles(df.limit(0), [], "v", {"p": 0.5}, rows).filter("p is not null").isEmpty()


def test_projection_origin(spark):
    x, y = spatial.project_sql("lon", "lat")
    r = spark.createDataFrame([(-(88 + 20 / 60), 36 + 40 / 60)], "lon double, lat double").select(F.expr(x), F.expr(y)).first()
    assert r[0] == pytest.approx(984250.0, abs=1e-3) and r[1] == pytest.approx(0.0, abs=1e-3)


def brute_paths(edges, start):
    """Distances by settling the nearest node each time."""
    best, done = {start: 0}, {}
    while best:
        n = min(best, key=lambda x: (best[x], x))
        done[n] = best.pop(n)
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x == n and y not in done:
                    best[y] = min(best.get(y, 1 << 60), done[n] + w)
    return done


EDGE = "grp int, src string, dst string, weight bigint"


def test_long_path(spark):
    """A path of 200 nodes, longer than any fixed number of rounds, beside another group."""
    edges = [(1, f"n{k:03d}", f"n{k + 1:03d}", 1 + k % 3) for k in range(199)] + [(2, "n000", "n199", 5)]
    df = spark.createDataFrame(edges, EDGE)
    paths = graph.shortest_paths(df, spark.createDataFrame([(1, "n000"), (2, "n000")], "grp int, node string"))
    got = {(r.grp, r.node): r.distance for r in paths.collect()}
    assert got == {(1, n): d for n, d in brute_paths([e[1:] for e in edges if e[0] == 1], "n000").items()} | {(2, "n000"): 0, (2, "n199"): 5}
    route = graph.routes(paths, spark.createDataFrame([(1, "n199"), (1, "n000")], "grp int, node string")).collect()
    assert {r.target: r.nodes for r in route} == {"n199": ">".join(f"n{k:03d}" for k in range(200)), "n000": "n000"}
    assert {(r.grp, r.component) for r in graph.connected_components(df).collect()} == {(1, "n000"), (2, "n000")}


def test_random_graphs(spark):
    import random

    rng = random.Random(3)
    edges = [(g, f"a{rng.randrange(25)}", f"a{rng.randrange(25)}", rng.randrange(1, 9)) for g in (1, 2) for _ in range(28)]
    df = spark.createDataFrame(edges, EDGE)
    start = {g: min(e[1] for e in edges if e[0] == g) for g in (1, 2)}
    paths = graph.shortest_paths(df, spark.createDataFrame(list(start.items()), "grp int, node string"))
    found = {g: brute_paths([e[1:] for e in edges if e[0] == g], start[g]) for g in (1, 2)}
    assert {(r.grp, r.node): r.distance for r in paths.collect()} == {(g, n): d for g in found for n, d in found[g].items()}
    for r in graph.connected_components(df).collect():
        reach = brute_paths([e[1:] for e in edges if e[0] == r.grp], r.node)
        assert r.component == min(reach)
    for r in graph.routes(paths, df.select("grp", F.col("dst").alias("node")).distinct()).collect():
        nodes = r.nodes.split(">")
        steps = [min(w for g, a, b, w in edges if g == r.grp and {a, b} == {x, y}) for x, y in zip(nodes, nodes[1:])]
        assert nodes[0] == start[r.grp] and sum(steps) == r.length == found[r.grp][r.target]


def test_zero_lengths_parallels_and_loops(spark):
    """Zero-length edges in a ring, parallel edges and loops: parents lead to the source, and the edges that were taken are named."""
    edges = [("S", "X", 5, "e1"), ("X", "A", 0, "e2"), ("A", "B", 0, "e3"), ("B", "T", 1, "e4"), ("B", "X", 0, "e5"), ("S", "X", 5, "e0"), ("S", "X", 7, "d0"), ("T", "T", 0, "loop"), ("Q", "R", 1, "far")]
    df = spark.createDataFrame([(1, *e) for e in edges], "grp int, src string, dst string, weight bigint, edge_id string")
    paths = graph.shortest_paths(df, spark.createDataFrame([(1, "S")], "grp int, node string"), "edge_id")
    assert {r.node: (r.distance, r.hops, r.parent, r.edge) for r in paths.collect()} == {"S": (0, 0, None, None), "X": (5, 1, "S", "e0"), "A": (5, 2, "X", "e2"), "B": (5, 2, "X", "e5"), "T": (6, 3, "B", "e4")}
    found = graph.routes(paths, spark.createDataFrame([(1, "T"), (1, "S"), (1, "R"), (1, "T")], "grp int, node string"))
    assert {r.target: (r.start, r.nodes, r.edges, r.hops, r.length) for r in found.collect()} == {"T": ("S", "S>X>B>T", "e0>e5>e4", 3, 6), "S": ("S", "S", "", 0, 0)}
    assert [tuple(r)[2:] for r in graph.route_segments(found, df, "edge_id").orderBy("seq").select("grp", "target", "edge", "from_node", "to_node", "weight").collect()] == [("e0", "S", "X", 5), ("e5", "X", "B", 0), ("e4", "B", "T", 1)]


def test_boundary_by_proximity(spark):
    rows = [("M", "m1", "p", "q", 0.0, 0.0, 100.0, 0.0), ("M", "m2", "q", "r", 100.0, 0.0, 200.0, 0.0), ("M", "m3", "r", "s", 200.0, 0.0, 900.0, 0.0), ("N", "n1", "x", "y", 95.0, 30.0, 95.0, 300.0), ("S", "s1", "r", "z", 200.0, 0.0, 200.0, 90.0), ("F", "f1", "u", "v", 0.0, 900.0, 9.0, 900.0), ("X", "x1", "g", "h", 50.0, -9.0, 50.0, 9.0)]
    segs = spark.createDataFrame(rows, "grp string, sid string, src string, dst string, x1 double, y1 double, x2 double, y2 double")
    pairs = spark.createDataFrame([("M", c) for c in "NSFX"], "main string, cross string")
    got = {}
    for r in graph.boundary_nodes(segs, pairs).collect():
        got.setdefault(r.cross, set()).add((r.node, r.by_proximity, round(r.distance, 6)))
    assert got == {"S": {("r", False, 0.0)}, "N": {("p", True, 30.0), ("q", True, 30.0), ("r", True, 30.0)}, "X": {("p", True, 0.0), ("q", True, 0.0), ("r", True, 0.0)}}


def test_projection_there_and_back(spark):
    x, y = spatial.project_sql("lon", "lat")
    df = spark.createDataFrame([(-87.6 - k / 10, 41.5 + k / 20) for k in range(8)], "lon double, lat double").selectExpr("lon", "lat", f"{x} AS x", f"{y} AS y")
    lon, lat = spatial.unproject_sql("x", "y")
    for r in df.selectExpr("lon", "lat", f"{lon} AS a", f"{lat} AS b").collect():
        assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)


def test_panel_and_features(spark):
    """Two units over the months between the first event and the last, one of which has none; values that grow by one a month."""
    import datetime

    day = lambda y, m: datetime.date(y, m, 1)
    events = spark.createDataFrame([("u1", day(2001, 3), "K"), ("u1", day(2001, 3), "O"), ("u2", day(2001, 6), "A"), ("u2", day(2001, 6), "?")], "unit string, month date, sev string")
    p = panel.build_panel(spark.createDataFrame([("u1",), ("u2",), ("u3",)], "unit string"), events, "unit", "month", "sev")
    rows = {(r.unit, r.month.month): r for r in p.collect()}
    assert len(rows) == 12 and sum(r.total == 0 for r in rows.values()) == 10
    assert (rows["u1", 3].k, rows["u1", 3].o, rows["u1", 3].ksi, rows["u2", 6].a, rows["u2", 6].u, rows["u3", 4].total) == (1, 1, 1, 1, 1, 0)
    ramp = spark.sql("SELECT 'u' AS unit, add_months(date'2000-01-01', cast(id as int)) AS month, id + 10 AS v FROM range(30)").withColumn("yr", F.year("month")).withColumn("mon", F.month("month"))
    f = panel.build_features(ramp, "unit", "month", ["v"], 2000).orderBy("month").collect()
    assert [f[k].v_lag12 for k in (11, 12, 20)] == [None, 10, 18] and [f[k].v_mean3 for k in (2, 3, 20)] == [None, 11.0, 28.0] and f[20].v_sum6 == 159
    assert [r.model_ready for r in f[11:13]] == [False, True] and f[29].year_trend == 2.0
    cut = panel.build_features(ramp.withColumn("v", F.when(F.col("yr") > 2000, F.lit(0)).otherwise(F.col("v"))), "unit", "month", ["v"], 2000).orderBy("month").collect()
    assert f[:12] == cut[:12]  # later months do not matter
    assert [(r.trend, round(r.slope, 9)) for r in panel.trend(ramp, "unit", "month", "v").collect()] == [("increasing", 1.0)]


def _portfolios(spark, cands, grid, **k):
    c = spark.createDataFrame(cands, "unit_id int, treatment_id string, scenario string, priority_area boolean, cost double, pv double")
    g = spark.createDataFrame(grid, "portfolio_id string, scenario string, budget double, floor_share double")
    options = portfolio.unit_options(c)
    duals = portfolio.multipliers(options, g, "T2", 0.7)
    solved = portfolio.solve(options, duals, "T2", 0.7, **k)
    chosen = portfolio.selections(options, duals, solved, "T2", 0.7)
    bounds = {r.portfolio_id: r.upper_bound for r in solved.collect()}
    return c, g, chosen, bounds, {r.portfolio_id: r for r in portfolio.summarize(g, chosen, "T2").collect()}, {r.portfolio_id: r.bound for r in duals.collect()}


def test_portfolio_is_optimal(spark):
    """Against all selections of six units: the optimum, and proven so."""
    import random
    from itertools import product

    rng = random.Random(8)
    cands = [(u, t, "BASE", u % 2 == 0, float(rng.randrange(1, 9)), float(rng.randrange(4, 60))) for u in range(6) for t in ("T1", "T2")]
    grid = [(f"P{b}-{int(e * 100)}", "BASE", float(b), e) for b in (6, 12, 40) for e in (0.2, 0.5)] + [("P0", "BASE", 0.5, 0.2)]
    c, g, chosen, bound, got, dual = _portfolios(spark, cands, grid)
    for name, _, budget, floor in grid:
        best = 0.0
        for pick in product(*[[None, *[x for x in cands if x[0] == u]] for u in range(6)]):
            s = [x for x in pick if x]
            cost = sum(x[4] for x in s)
            if s and cost <= budget and sum(x[4] for x in s if x[3]) >= floor * cost - 1e-9 and sum(x[1] == "T2" for x in s) <= 0.7 * len(s):
                best = max(best, sum(x[5] for x in s))
        r = got[name]
        assert r.cost <= budget + 1e-9 and r.priority_spend >= floor * r.cost - 1e-9 and r.capped <= 0.7 * r.projects + 1e-9
        assert r.pv == pytest.approx(best) and bound[name] == pytest.approx(best) and dual[name] >= best - 1e-6
    classes = {r.portfolio_id: r.budget_class for r in portfolio.constraint_classes(portfolio.summarize(g, chosen, "T2"), chosen, c).collect()}
    assert set(classes) == {x[0] for x in grid} and set(classes.values()) <= {"NONBINDING_CEILING", "EFFECTIVELY_BINDING", "BINDING_NUMERIC_TOLERANCE", "SLACK"}


def test_portfolio_of_many_units(spark):
    """A core of 40 of 600 units: feasible, within one percent of the bound; a narrow beam is less, with a bound that still holds."""
    import random

    rng = random.Random(4)
    cands = [(u, t, s, rng.random() < 0.3, rng.uniform(1, 40), rng.uniform(5, 900)) for u in range(600) for t in ("T1", "T2", "T4") for s in ("BASE", "LOW")]
    grid = [(f"{s}{b}-{int(e * 100)}", s, float(b), e) for s in ("BASE", "LOW") for b in (50, 400, 3000) for e in (0.2, 0.6)]
    values = {}
    for core, beam in ((40, 500), (12, 5)):
        _, _, chosen, bound, got, dual = _portfolios(spark, cands, grid, core=core, beam=beam)
        assert chosen.groupBy("portfolio_id", "unit_id").count().filter("count > 1").isEmpty()
        for name, _, budget, floor in grid:
            r = got[name]
            assert r.cost <= budget + 1e-6 and r.priority_spend >= floor * r.cost - 1e-6 and r.capped <= 0.7 * r.projects + 1e-9
            assert r.pv <= bound[name] + 1e-6 and bound[name] <= dual[name] + 1e-6
            values.setdefault(name, []).append((r.pv, bound[name]))
    for (wide, wide_bound), (narrow, narrow_bound) in values.values():
        assert wide >= 0.99 * wide_bound and wide <= narrow_bound + 1e-6 and narrow <= wide_bound + 1e-6


def test_fitted_models(spark):
    """Coefficients that made the counts come back; unseen categories count as the first one; Poisson where there is no overdispersion to fit."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 3000
    x, g = rng.normal(size=n), rng.integers(0, 3, n)
    mu = np.exp(0.7 + 0.4 * x + np.array([0.0, 0.5, -0.3])[g])
    rows = [(float(a), f"g{b}", float(rng.poisson(m)), float(rng.poisson(m * rng.gamma(2, 0.5)))) for a, b, m in zip(x, g, mu)]
    df = spark.createDataFrame(rows, "x double, g string, y double, z double").repartition(4).cache()
    m = models.fit_poisson(df, "y", ["x"], ["g"], reg=0.0)
    t = {r.term: r for r in models.coefficient_table(m, df).collect()}
    scale = float(np.std(x, ddof=1))
    assert t["x"].coefficient / scale == pytest.approx(0.4, abs=0.04) and 0 < t["x"].std_error < 0.05 and t["x"].p_value < 1e-6
    assert len(t) == 3 and {round(r.coefficient, 1) for k, r in t.items() if k != "x"} == {0.5, -0.3}
    nb = models.fit_negative_binomial(df, "z", ["x"], ["g"])
    assert nb.alpha and nb.coefficients[0] / scale == pytest.approx(0.4, abs=0.08)
    new = spark.createDataFrame([(0.0, "g0"), (0.0, "never seen")], "x double, g string")
    a, b = (r.predicted for r in m.predict(new).collect())
    assert a == pytest.approx(b) and a == pytest.approx(np.exp(0.7), rel=0.1)
    assert models.dispersion(df.withColumn("c", F.lit(2.0)), "c") == 0.1


def test_metrics_and_winners(spark):
    rows = [("t", "a", "v", u, float(y), float(p)) for u, y, p in ((1, 0, 1.0), (1, 2, 1.5), (2, 3, 3.0), (2, 1, 2.0))] + [("t", "b", "v", u, float(y), float(y)) for u, y in ((1, 0), (1, 2), (2, 3), (2, 1))]
    df = spark.createDataFrame(rows, "target string, model string, model_split string, unit int, actual double, predicted double")
    m = evaluate.metric_suite(df, ["target", "model", "model_split"], "unit")
    r = {x.model: x for x in m.collect()}
    assert r["a"].mae == 0.625 and r["a"].bias == 0.375 and r["a"].actual_total == 6 and r["a"].spearman == 1.0
    assert r["a"].deviance == pytest.approx(sum(2 * ((y * math.log(y / p) if y else 0) - y + p) for y, p in ((0, 1.0), (2, 1.5), (3, 3.0), (1, 2.0))) / 4)
    assert [x.model for x in evaluate.winners(m, "target", "model").filter("is_winner").collect()] == ["b"]
    with pytest.raises(Exception, match="calibration factor"):
        evaluate.calibration_factors(df.withColumn("actual", F.lit(0.0)), ["model"]).collect()


def test_recursive_mean_of_constant(spark):
    df = spark.sql("SELECT 1 AS unit_id, date'2000-01-01' + make_interval(0, cast(id as int)) AS month_start, 5 AS v FROM range(24)")
    assert {r.forecast for r in models.recursive_mean_forecast(df, "v").collect()} == {5.0}


def test_recursive_model_against_a_loop(spark):
    """The recursion with a stand-in for the fitted model, against a plain loop: features are rebuilt from forecasts, the part is calibrated and capped."""
    months = [(u, 2000 + k // 12, k % 12 + 1, 3 + (k * u) % 7, (k * u) % 3, "g") for u in (1, 2) for k in range(30)]
    df = spark.createDataFrame(months, "unit int, yr int, mon int, t int, p int, grp string").withColumn("month", F.make_date("yr", "mon", F.lit(1)))
    predict = lambda x: x.withColumn("predicted", 0.4 * F.col("t_mean12") + 0.5 * F.col("p_lag1") + 0.01 * F.col("p_sum3") + 0.1 * F.col("mon"))
    got = {(r.unit, r.step): (r.t, r.raw, r.p) for r in models.recursive_model_forecast(df, predict, 1.5, "unit", "month", "t", "p", "grp", 2000, steps=5).collect()}
    for u in (1, 2):
        t, p = [float(m[3]) for m in months if m[0] == u], [float(m[4]) for m in months if m[0] == u]
        for step in range(1, 6):
            nxt = sum(t[-12:]) / 12
            raw = 0.4 * nxt + 0.5 * p[-1] + 0.01 * sum(p[-3:]) + 0.1 * ((29 + step) % 12 + 1)
            t.append(nxt)
            p.append(min(1.5 * raw, nxt))
            assert got[u, step] == pytest.approx((nxt, raw, p[-1]))


def test_gamma_poisson_beats_its_start(spark):
    df = spark.createDataFrame([(3, 1.0), (0, 1.0), (7, 2.0), (2, 1.5), (9, 2.0)], "y int, exposure double")
    r = models.fit_gamma_poisson(df).first()

    def nll(a, b):
        return -sum(math.lgamma(a + y) - math.lgamma(a) + a * math.log(b) - (a + y) * math.log(b + e) for y, e in ((3, 1.0), (0, 1.0), (7, 2.0), (2, 1.5), (9, 2.0)))

    assert r.nll == pytest.approx(nll(r.alpha, r.beta), rel=1e-9)
    assert all(r.nll <= nll(r.alpha * s, r.beta * t) + 1e-3 for s in (0.5, 1, 2) for t in (0.5, 1, 2))


def test_gamma_poisson_is_at_its_optimum(spark):
    """Against a search of its own; the derivatives vanish; special functions agree with the library's; no overdispersion ends at the bound."""
    rows = [(3, 1.0), (0, 1.0), (7, 2.0), (2, 1.5), (9, 2.0), (40, 3.0), (0, 0.5), (1, 1.0)]
    r = models.fit_gamma_poisson(spark.createDataFrame(rows, "y int, exposure double")).first()

    def nll(p, q):
        a, b = math.exp(p), math.exp(p - q)
        return -sum(math.lgamma(a + y) - math.lgamma(a) + a * math.log(b) - (a + y) * math.log(b + e) for y, e in rows)

    p, q, h = 0.0, 1.0, 1.0
    while h > 1e-9:
        better = min(((nll(p + i * h, q + j * h), p + i * h, q + j * h) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        p, q, h = (better[1], better[2], h) if better[0] < nll(p, q) else (p, q, h / 2)
    assert r.gradient < 1e-6 and r.alpha == pytest.approx(math.exp(p), rel=1e-5) and r.beta == pytest.approx(math.exp(p - q), rel=1e-5) and r.nll == pytest.approx(nll(p, q), rel=1e-10)
    x = spark.createDataFrame([(v,) for v in (0.01, 0.7, 1.0, 5.5, 1e4)], "x double").select("x", models.lgamma(F.col("x")).alias("l"), models.digamma(F.col("x")).alias("d"), models.trigamma(F.col("x")).alias("t")).collect()
    for v in x:
        step = 1e-4 * v.x
        assert v.l == pytest.approx(math.lgamma(v.x), abs=1e-10, rel=1e-11) and v.d == pytest.approx((math.lgamma(v.x + step) - math.lgamma(v.x - step)) / (2 * step), rel=1e-5, abs=1e-6)
    same = models.fit_gamma_poisson(spark.createDataFrame([(5, 1.0)] * 20 + [(4, 1.0)], "y int, exposure double")).first()
    assert same.alpha > 1e4 and same.alpha / same.beta == pytest.approx(104 / 21, rel=1e-3)


def test_wide_models(spark, monkeypatch):
    """Few features: the coefficients of the normal equations. Twenty thousand categories: derivatives vanish, and sums within a category are right."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = 1500
    x, g = rng.normal(2, 3, n), rng.integers(0, 4, n)
    y = rng.poisson(np.exp(0.3 + 0.1 * x + np.array([0, 0.4, -0.2, 0.1])[g])).astype(float)
    df = spark.createDataFrame([(float(a), f"g{b}", float(c)) for a, b, c in zip(x, g, y)], "x double, g string, y double").repartition(3).cache()
    for reg in (0.0, 0.3):
        narrow, wide = models.fit_poisson(df, "y", ["x"], ["g"], reg=reg), models.fit_wide(df, "y", ["x"], ["g"], reg)
        ours = dict(zip(wide.names(), wide.coefficients))
        # the other fit has the last level first
        assert ours["x"] == pytest.approx(narrow.coefficients[0], abs=1e-4) and sorted(ours[f"g_hot_g{k}"] for k in (1, 2, 3)) == pytest.approx(sorted(narrow.coefficients[1:]), abs=1e-4) and wide.intercept == pytest.approx(narrow.intercept, abs=1e-4)
        new = spark.createDataFrame([(1.0, "g2"), (0.0, "never seen")], "x double, g string")
        assert [r.predicted for r in wide.predict(new).collect()] == pytest.approx([r.predicted for r in narrow.predict(new).collect()], rel=1e-3)
    nb, wide_nb = models.fit_negative_binomial(df, "y", ["x"], ["g"]), models.fit_wide(df, "y", ["x"], ["g"], 1e-6, models.dispersion(df, "y"))
    assert wide_nb.coefficients[0] == pytest.approx(nb.coefficients[0], abs=1e-3)
    many = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("u"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("double").alias("y"))
    m = models.fit_poisson(many, "y", ["x"], ["u"], reg=1e-6)
    assert isinstance(m, models.WideModel) and m.size == 20_000 and m.steps < 100
    off = m.predict(many).groupBy("u").agg(F.sum("y").alias("y"), F.sum("predicted").alias("p")).filter("y > 0").agg(F.max(F.abs(F.col("p") - F.col("y"))).alias("d"), F.sum("p").alias("p"), F.sum("y").alias("y")).first()
    assert off.p == pytest.approx(off.y, rel=1e-3) and off.d < 1.0


@pytest.mark.parametrize(("bad_rows", "status"), [({}, "PASS"), ({"a": 1}, "PASS_WITH_WARNINGS"), ({"k": None}, "FAIL"), ({"k": 2}, "FAIL")])
def test_gate(spark, bad_rows, status):
    df = spark.createDataFrame([(bad_rows.get("k", 1), bad_rows.get("a", 0)), (2, 0)], "k int, a int")
    rows = gates.gate(gates.offences(df, {"null_key": ("CRITICAL", gates.bad("k is null")), "repeated": ("CRITICAL", gates.repeated("k"))}), gates.offences(df, {"odd": ("WARNING", gates.bad(F.col("a") > 0))})).collect()
    assert {r.status for r in rows} == {status} and len(rows) == 3
    assert {r.check_name for r in rows if not r.passed} == ({"null_key"} if bad_rows == {"k": None} else {"repeated"} if "k" in bad_rows else {"odd"} if "a" in bad_rows else set())


def test_snapshot_audit_finds_damage(spark, tmp_path):
    import shutil

    at = f"{tmp_path}/s"
    snapshot.publish_parts(spark.range(100).withColumn("v", F.col("id") * 2), at, "id", 4, "none")
    for crc in (tmp_path / "s" / "data").rglob(".*.crc"):  # the local file system's own guard
        crc.unlink()
    audit = lambda **k: {r.part: r for r in snapshot.audit_parts(spark, at, **k).collect()}
    assert all(r.size_ok and r.sha_ok and r.parts_ok and r.expected_rows == r.found_rows == 25 and r.columns_ok for r in audit(required=("id", "v")).values())
    assert not any(r.columns_ok for r in audit(required=("lost",)).values())
    file = {k: next((tmp_path / "s" / "data" / f"part={k}").glob("part-*")) for k in range(4)}
    file[0].write_bytes(file[0].read_bytes().replace(b"\n", b"\r\n"))
    assert not audit()[0].sha_ok and audit(canonical_newlines=True)[0].sha_ok
    file[1].write_bytes(file[1].read_bytes() + b"1,2\n")
    file[2].unlink()
    shutil.copy(file[3], file[3].with_name("part-extra.csv"))
    rows = snapshot.audit_parts(spark, at).collect()
    one = next(r for r in rows if r.part == 1)
    assert (one.size_ok, one.sha_ok, one.expected_rows, one.found_rows) == (False, False, 25, 26)
    assert next(r for r in rows if r.part == 2).found_rows == 0 and sum(not r.sha_ok for r in rows) == 4 and len(rows) == 5


@pytest.mark.parametrize("chunk", [1, 2, 3, 8_000_000])
def test_checksums_by_chunk(tmp_path, chunk):
    """Newlines that chunks cut in two, lone returns, an empty file; a name with blanks and signs."""
    import pyarrow as pa

    texts = [b"", b"\r", b"\r\n", b"a\r\r\nb\r\n\r\nc\r", b"a\nb\r\n" * 5]
    paths = [tmp_path / f"part-{i} %20+#.csv" for i in range(len(texts))]
    for p, t in zip(paths, texts, strict=True):
        p.write_bytes(t)
    b = pa.RecordBatch.from_pydict({"path": [f"file:{p}" for p in paths], "length": [len(t) for t in texts]})
    rows = next(snapshot._digests(iter([b]), chunk)).to_pylist()
    assert [r["sha256"] for r in rows] == [hashlib.sha256(t).hexdigest() for t in texts]
    assert [r["canonical_sha256"] for r in rows] == [hashlib.sha256(t.replace(b"\r\n", b"\n")).hexdigest() for t in texts]


def test_checksums_of_a_folder_streamed_and_whole(spark, tmp_path, monkeypatch):
    """Both ways give the same; streaming reads no content through Spark."""
    at = f"{tmp_path}/a b"
    snapshot.publish_parts(spark.range(50), at, "id", 3)
    rows = lambda f: sorted(map(tuple, f.collect()))
    streamed = snapshot._files(spark, at)
    assert "content" not in streamed._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(snapshot, "STREAMED", ())
    assert rows(streamed) == rows(snapshot._files(spark, at)) and streamed.count() == 3


def test_issue_register_keeps_one_result_a_run(spark, tmp_path):
    """A repeated run replaces itself, also with fewer issues or none; others stay."""
    at = f"{tmp_path}/r"
    m = spark.createDataFrame([("b", 2), ("a", 1), ("none", 0)], "metric string, n long")
    for run, metrics in (("X", m), ("2001", m), ("X", m), ("2001", m.filter("metric = 'b'")), ("Z", m.filter("n = 0")), ("X", m)):
        snapshot.append_issues(metrics, at, run)
    held = lambda: sorted((r.issue_id, r.metric, r.run_id) for r in snapshot.read_issues(spark, at).collect())
    assert held() == [("DQ-2001-001", "b", "2001"), ("DQ-X-001", "a", "X"), ("DQ-X-002", "b", "X")]
    snapshot.append_issues(m.filter("n = 0"), at, "X")
    assert held() == [("DQ-2001-001", "b", "2001")]


def test_schema_rows_fail(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, d double")
    got = {r.column_name: (r.expected, r.found, r.passed) for r in snapshot.schema_rows(df, {"a": "int", "b": "double", "c": "date"}).collect()}
    assert got == {"a": ("int", "int", True), "b": ("double", "string", False), "c": ("date", None, False), "d": (None, "double", False)}


def test_cleaning_by_contract(spark):
    """Another set of columns, codes, bounds and order; an input column with the name of an output; counts of what is invalid."""
    k = clean.Contract(key="id", severity="harm", codes=(("BAD", "X"), ("NONE", "Z")), unknown="?", code="level", date="at", day="on", integers=("n", "m"), floats=(), texts=("note",), upper=(), latitude="y", longitude="x", bounds=(0.0, 1.0, 0.0, 1.0), street=None, ranges=(("n", 0, 5),), domains=(("note", ("A",)),), order=("id", "level", "on", "n", "m", "note", "coordinate_status"))
    raw = spark.createDataFrame([("1", " bad ", "2000-01-02", "3.0", "x", " a ", "0.5", "0.5", "clash"), ("2", "worse", "?", "9", "", None, "7", "0.5", "clash"), ("3", None, None, None, "2.5", "b", None, "", "clash")], "id string, harm string, at string, n string, m string, note string, y string, x string, level string")
    assert [tuple(map(str, r)) for r in clean.clean_rows(raw, k).orderBy("id").collect()] == [("1", "X", "2000-01-02", "3", "None", "a", "valid"), ("2", "?", "None", "9", "None", "None", "out_of_range"), ("3", "?", "None", "None", "None", "b", "missing_pair")]
    assert {(r.column_name, r.problem): r.n for r in clean.invalid_counts(raw, k).collect() if r.n} == {(None, "rows"): 3, ("harm", "unmapped"): 1, ("at", "not_a_date"): 2, ("m", "not_an_integer"): 2, ("n", "outside_range"): 1, ("note", "outside_domain"): 1, ("coordinates", "out_of_range"): 1, ("coordinates", "missing_pair"): 1}


def test_no_view_of_the_session_is_touched(spark):
    from waymark.proxy import Tables

    spark.range(3).createOrReplaceTempView("orders")
    assert Tables(spark, "/root/testdata/sf0.001").sql("SELECT count(*) AS n FROM orders").first().n > 3
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_publish_only_after_passing(spark, tmp_path):
    df = spark.range(3)
    failed = spark.createDataFrame([("CRITICAL", False)], "severity string, passed boolean")
    assert not snapshot.publish_if_passed(df, failed, f"{tmp_path}/a") and not (tmp_path / "a").exists()
    assert snapshot.publish_if_passed(df, failed.withColumn("passed", F.lit(True)), f"{tmp_path}/b") and (tmp_path / "b").exists()


def test_marts_follow_their_tables(spark, tmp_path):
    """A mart is read again while its tables stay, and made anew when one changes."""
    import shutil

    import duckdb

    from waymark.proxy import TABLES, Tables

    for t in TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    total = lambda: Tables(spark, str(tmp_path)).sql("SELECT sum(total) AS n FROM panel").first().n
    first, again = total(), total()
    duckdb.sql("SELECT * FROM '/root/testdata/sf0.001/orders.parquet' WHERE o_orderkey % 2 = 0").write_parquet(str(tmp_path / "orders.parquet"))
    assert first == again > total() > 0
    # a file below the first level, changed without a change of size
    import os

    (tmp_path / "region.parquet").rename(tmp_path / "r")
    (tmp_path / "region.parquet" / "p=1").mkdir(parents=True)
    (tmp_path / "r").rename(tmp_path / "region.parquet" / "p=1" / "part.parquet")
    from waymark.functions.storage import version

    before = version(spark, [f"file://{tmp_path}/region.parquet"])
    os.utime(tmp_path / "region.parquet" / "p=1" / "part.parquet", (10**9, 10**9))
    assert before[0] == 1 and before != version(spark, [f"file://{tmp_path}/region.parquet"])


def rows_written(monkeypatch):
    """Rows of all tables that the graph operators write between their steps."""
    rows = []

    def counted(f):
        def put(*a):
            out = f(*a)
            rows.append(out.count())
            return out

        return put

    monkeypatch.setattr(graph, "cut_lineage", counted(graph.cut_lineage))
    if hasattr(graph, "Bucketed"):
        add, last = graph.Bucketed.add, {}

        def added(table, df):
            out = add(table, df)
            n = out.count()
            rows.append(n - last.get(table.name, 0))
            last[table.name] = n
            return out

        monkeypatch.setattr(graph.Bucketed, "add", added)
    return rows


def test_components_write_less_than_the_edges(spark, monkeypatch):
    """many edges between few nodes are folded where they are; a node known by a loop alone and edges with an end missing change nothing."""
    edges = [(g, f"p{k % 90:02d}", f"s{k * k % 97 % 30:02d}", 1) for g in (1, 2) for k in range(4000)] + [(1, "z1", "z1", 1), (1, None, "p00", 1), (None, "p00", "p01", 1)]
    edges += [(3, f"n{k:03d}", f"n{k + 1:03d}", 1) for k in range(60) if k != 40]
    df = spark.createDataFrame(edges, EDGE).repartition(3)
    rows = rows_written(monkeypatch)
    got = {(r.grp, r.node): r.component for r in graph.connected_components(df).collect()}
    assert sum(rows) < len(edges) / 2
    known = [e for e in edges if None not in e]
    assert set(got) == {(g, n) for g, a, b, _ in known for n in (a, b)}
    for g in (1, 2, 3):
        own = [e[1:] for e in known if e[0] == g]
        for n in {x for e in own for x in e[:2]}:
            assert got[g, n] == min(brute_paths(own, n))


def test_stars_of_small_chunks():
    """stars of chunks of two edges keep every link; names are ordered by their bytes."""
    import pyarrow as pa

    batch = pa.record_batch({"grp": pa.array([1, 1, 2, 1], pa.int32()), "src": ["b", "é", "b", "x"], "dst": ["z", "z", "a", "x"]})
    rows = [tuple(r.values()) for out in graph._stars(iter([batch.slice(k, 1) for k in range(4)]), 2) for r in out.to_pylist()]
    assert sorted(rows) == sorted([(1, "b", "b"), (1, "z", "b"), (1, "é", "b"), (2, "a", "a"), (2, "b", "a"), (1, "x", "x")])


def test_paths_and_routes_write_what_changes(spark, monkeypatch):
    """a round writes the labels that got better, not all of them, and a few short routes are walked without tables of all nodes."""
    edges = [("c00", f"leaf{k:03d}", 3, f"L{k}") for k in range(400)] + [(f"c{k:02d}", f"c{k + 1:02d}", k % 3, f"C{k}") for k in range(24)]
    df = spark.createDataFrame([(1, *e) for e in edges], "grp int, src string, dst string, weight bigint, edge_id string")
    rows = rows_written(monkeypatch)
    paths = graph.shortest_paths(df, spark.createDataFrame([(1, "c00")], "grp int, node string"), "edge_id", **({"named": False} if hasattr(graph, "Bucketed") else {}))
    assert {r.node: r.distance for r in paths.collect()} == brute_paths([e[:3] for e in edges], "c00")
    assert sum(rows) < 5 * len(edges)
    rows.clear()
    r = graph.routes(paths, spark.createDataFrame([(1, "c24")], "grp int, node string"), *([df, "edge_id"] if hasattr(graph, "Bucketed") else [])).first()
    assert (r.nodes, r.edges, r.hops, r.length) == (">".join(f"c{k:02d}" for k in range(25)), ">".join(f"C{k}" for k in range(24)), 24, 24)
    assert sum(rows) < len(edges)


def test_paths_end_after_few_rounds(spark, monkeypatch):
    """a round runs on within a block until nothing gets better there, so a path takes far fewer tables than it has edges."""
    edges = [(f"p{k:02d}", f"s{k + j:02d}", k % 3) for k in range(40) for j in (0, 1)]
    rows = rows_written(monkeypatch)
    paths = graph.shortest_paths(spark.createDataFrame([(1, *e) for e in edges], EDGE), spark.createDataFrame([(1, "s00")], "grp int, node string"))
    assert len(rows) <= 5
    assert {r.node: r.distance for r in paths.collect()} == brute_paths(edges, "s00")


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(9,2)"])
def test_paths_over_several_blocks(spark, monkeypatch, kind):
    """blocks of a few edges find the same labels and least parents as one, also when two nodes have the same hash at first, with a source that has no edge."""
    import random

    rng, hashed, calls = random.Random(5), F.xxhash64, []

    def clashing(*c):
        calls.append(c)
        return hashed(*c) % 7 if len(calls) <= 2 and kind == "bigint" else hashed(*c)

    edges = [(g, f"p{rng.randrange(60)}", f"{rng.choice('sp')}{rng.randrange(12)}", rng.randrange(6)) for g in (1, 2) for _ in range(150)]
    df = spark.createDataFrame(edges, EDGE).withColumn("weight", F.col("weight").cast(kind))
    start = spark.createDataFrame([(1, "s1"), (2, "s2"), (2, "s3"), (3, "alone")], "grp int, node string")
    monkeypatch.setattr(graph, "BLOCK", 60)
    monkeypatch.setattr(graph.F, "xxhash64", clashing)
    paths = graph.shortest_paths(df, start, named=False)
    assert paths.schema["distance"].dataType == df.schema["weight"].dataType and len(calls) == (4 if kind == "bigint" else 2)
    got = {(r.grp, r.node): (r.distance, r.hops, r.parent) for r in paths.collect()}
    label = {(1, "s1"): (0, 0), (2, "s2"): (0, 0), (2, "s3"): (0, 0), (3, "alone"): (0, 0)}
    ways = [(g, x, y, w) for g, a, b, w in edges if a != b for x, y in ((a, b), (b, a))]
    while (new := {(g, y): (label[g, x][0] + w, label[g, x][1] + 1) for g, x, y, w in ways if (g, x) in label and (label[g, x][0] + w, label[g, x][1] + 1) < label.get((g, y), (1e9, 0))}):
        label |= new
    parent = lambda g, n: min((x for h, x, y, w in ways if (h, y) == (g, n) and (g, x) in label and (label[g, x][0] + w, label[g, x][1] + 1) == label[g, n]), default=None)
    assert got == {k: (*v, parent(*k)) for k, v in label.items()}


@pytest.mark.parametrize("name", ["sp14_routes", "sp14_route_segments"])
def test_routes_deal_edges_out_once(spark, monkeypatch, name):
    """the edges are written once and no log of labels beside them."""
    from waymark.plans import frames

    add, dealt = graph.Bucketed.add, []
    monkeypatch.setattr(graph.Bucketed, "add", lambda t, df: dealt.append(t.name) or add(t, df))
    assert getattr(frames, name)(spark, "/root/testdata/sf0.001").count() > 0
    assert len(dealt) == 1
