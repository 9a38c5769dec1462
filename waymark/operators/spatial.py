"""Points and polylines on planar columns. Lines are segment rows (unit_id, part, seq, x1, y1, x2, y2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.storage import cut_lineage
from waymark.operators.order import percentiles


def segment_distance(x: Column, y: Column) -> Column:
    """Distance of a point to the segment in columns x1, y1, x2, y2."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / length2))).otherwise(0.0)
    px, py = F.col("x1") + t * dx - x, F.col("y1") + t * dy - y
    return F.sqrt(px * px + py * py)


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")))


#: Points of one cell, about; a cell with more is split into four, this many times at most, and then by a hash of its points.
CELL_POINTS, SPLITS = 50_000, 6
#: Rows of the table of split cells that are sent to every task; more are joined by a shuffle.
SMALL_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


class Quadtree:
    """Square cells, split where they hold many points. A cell is (level, cx, cy): cell numbers in units of cell / 2 ** level."""

    def __init__(self, points: DataFrame, cell: float, most: int = CELL_POINTS):
        self.cell, self.most = cell, most
        fine = cell / 2**SPLITS
        cells = points.groupBy(F.floor(F.col("x") / fine).cast("long").alias("fx"), F.floor(F.col("y") / fine).cast("long").alias("fy")).agg(F.count("*").alias("n"))
        cells = cut_lineage(cells, "cells")
        full = None
        for level in range(SPLITS + 1):
            up = 2 ** (SPLITS - level)
            own = cells.groupBy(F.lit(level).alias("level"), F.floor(F.col("fx") / up).cast("long").alias("cx"), F.floor(F.col("fy") / up).cast("long").alias("cy")).agg(F.sum("n").alias("n")).filter(F.col("n") > most)
            full = own if full is None else full.unionByName(own)
        self.full = cut_lineage(full, "full-cells")  # of n points at most (SPLITS + 1) * n / most rows
        self.depth = (self.full.agg(F.max("level")).first()[0] if not self.full.isEmpty() else -1) + 1  # levels with full cells

    def _marked(self, rows: DataFrame, level: int) -> DataFrame:
        """rows with __n, the points of their cell, if that is a full one of this level."""
        full = _small(self.full.filter(F.col("level") == level).select(F.col("cx").alias("__x"), F.col("cy").alias("__y"), F.col("n").alias("__n")))
        return rows.join(full, (F.col("cx") == F.col("__x")) & (F.col("cy") == F.col("__y")) & (rows["level"] == level), "left").drop("__x", "__y")

    def place(self, points: DataFrame, key: str) -> DataFrame:
        """points with level, cx, cy and salt of their leaf."""
        at = lambda c, level: F.floor(F.col(c) / (self.cell / 2**level)).cast("long")
        out = points.withColumns({"level": F.lit(0), "cx": at("x", 0), "cy": at("y", 0), "salt": F.lit(0)})
        for level in range(self.depth):
            out = self._marked(out, level)
            on = (F.col("level") == level) & F.col("__n").isNotNull()
            if level < SPLITS:
                out = out.withColumns({"cx": F.when(on, at("x", level + 1)).otherwise(F.col("cx")), "cy": F.when(on, at("y", level + 1)).otherwise(F.col("cy")), "level": F.when(on, level + 1).otherwise(F.col("level"))})
            else:
                out = out.withColumn("salt", F.when(on, F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / self.most))).otherwise(0).cast("int"))
            out = out.drop("__n")
        return out

    def cover(self, boxes: DataFrame) -> DataFrame:
        """boxes (with low_x, high_x, low_y, high_y) once for each leaf and salt that they meet, with level, cx, cy, salt."""
        out = boxes.withColumn("cx", _cells(F.col("low_x"), F.col("high_x"), self.cell)).withColumn("cy", _cells(F.col("low_y"), F.col("high_y"), self.cell)).withColumns({"level": F.lit(0), "salt": F.lit(0)})
        for level in range(self.depth):
            j = self._marked(out, level)
            on = (F.col("level") == level) & F.col("__n").isNotNull()
            if level < SPLITS:
                side = self.cell / 2 ** (level + 1)
                halves = lambda c, lo, hi: F.filter(F.array(2 * F.col(c), 2 * F.col(c) + 1), lambda k: (k <= F.floor(F.col(hi) / side)) & (k >= F.floor(F.col(lo) / side)))  # noqa: E731, B023
                for c, lo, hi in (("cx", "low_x", "high_x"), ("cy", "low_y", "high_y")):
                    j = j.withColumn("__c", F.explode(F.when(on, halves(c, lo, hi)).otherwise(F.array(c)))).withColumn(c, F.col("__c")).drop("__c")
                out = j.withColumn("level", F.when(on, level + 1).otherwise(F.col("level"))).drop("__n")
            else:
                out = j.withColumn("salt", F.explode(F.when(on, F.sequence(F.lit(0), (F.ceil(F.col("__n") / self.most) - 1).cast("int"))).otherwise(F.array(F.lit(0))))).drop("__n")
        return out


def within_distance(points: DataFrame, segments: DataFrame, limit: float, cell: float | None = None, most: int = CELL_POINTS, key: str = "event_id", unit: str = "unit_id") -> DataFrame:
    """(key, unit, distance): all pairs at most limit apart; a multipart line counts once, by its nearest part. points: key, x, y; segments: unit, x1, y1, x2, y2.

    Both sides meet on the leaves of a quadtree over the points: only segments are laid out over the leaves of their box widened by limit, so a
    pair meets once a segment; a leaf holds a bounded number of points, also where most of them lie in one spot.
    """
    tree = Quadtree(points, cell or max(limit, 500.0), most)
    box = {"low_x": F.least("x1", "x2") - limit, "high_x": F.greatest("x1", "x2") + limit, "low_y": F.least("y1", "y2") - limit, "high_y": F.greatest("y1", "y2") + limit}
    wide = tree.cover(segments.select(F.col(unit).alias("__unit"), "x1", "y1", "x2", "y2", *[c.alias(n) for n, c in box.items()])).drop(*box)
    at = tree.place(points.select(F.col(key).alias("__key"), "x", "y"), "__key")
    near = at.join(wide, ["level", "cx", "cy", "salt"]).withColumn("d", segment_distance(F.col("x"), F.col("y"))).filter(F.col("d") <= limit)
    return near.groupBy(F.col("__key").alias(key), F.col("__unit").alias(unit)).agg(F.min("d").alias("distance"))


def _ends_distance(a: str, b: str) -> Column:
    """Least distance of the ends of segment a to segment b; columns are structs with x1, y1, x2, y2."""
    bx, by = F.col(f"{b}.x1"), F.col(f"{b}.y1")
    dx, dy = F.col(f"{b}.x2") - bx, F.col(f"{b}.y2") - by
    length2 = dx * dx + dy * dy

    def to(x: Column, y: Column) -> Column:
        t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - bx) * dx + (y - by) * dy) / length2))).otherwise(0.0)
        return F.sqrt((bx + t * dx - x) ** 2 + (by + t * dy - y) ** 2)

    return F.least(to(F.col(f"{a}.x1"), F.col(f"{a}.y1")), to(F.col(f"{a}.x2"), F.col(f"{a}.y2")))


def near_segments(segments: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """(main, cross, sid, distance): segments of the main street at most limit from the cross street. segments: (grp, sid, x1, y1, x2, y2); pairs: (main, cross). Both sides meet on grid cells."""
    cell = max(limit, 500.0)
    boxed = segments.select("grp", "sid", F.struct("x1", "y1", "x2", "y2").alias("s"), *[F.sequence(F.floor((F.least(f"{c}1", f"{c}2") - m) / cell).cast("long"), F.floor((F.greatest(f"{c}1", f"{c}2") + m) / cell).cast("long")).alias(n) for c in "xy" for m, n in ((0.0, f"own_{c}"), (limit, f"wide_{c}"))])
    lay = lambda tag: boxed.select("grp", "sid", "s", F.explode(f"{tag}_x").alias("cx"), f"{tag}_y").select("grp", "sid", "s", "cx", F.explode(f"{tag}_y").alias("cy"))
    main = lay("own").join(pairs, F.col("grp") == F.col("main")).select("main", "cross", "sid", F.col("s").alias("a"), "cx", "cy")
    other = lay("wide").select(F.col("grp").alias("cross"), F.col("s").alias("b"), "cx", "cy")
    side = lambda p, x, y: (F.col(f"{p}.x2") - F.col(f"{p}.x1")) * (F.col(y) - F.col(f"{p}.y1")) - (F.col(f"{p}.y2") - F.col(f"{p}.y1")) * (F.col(x) - F.col(f"{p}.x1"))
    crossing = (side("a", "b.x1", "b.y1") * side("a", "b.x2", "b.y2") < 0) & (side("b", "a.x1", "a.y1") * side("b", "a.x2", "a.y2") < 0)
    d = F.when(crossing, 0.0).otherwise(F.least(_ends_distance("a", "b"), _ends_distance("b", "a")))
    return main.join(other, ["cross", "cx", "cy"]).groupBy("main", "cross", "sid").agg(F.min(d).alias("distance")).filter(F.col("distance") <= limit)


def carriageway_lengths(segments: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Per line: parts, its length (the mean of its parts: carriageways run side by side) and its linework (their sum)."""
    l = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)  # noqa: E741
    parts = segments.groupBy(unit, "part").agg(F.sum(l).alias("l"))
    return parts.groupBy(unit).agg(F.count("*").alias("parts"), F.avg("l").alias("length"), F.sum("l").alias("linework"))


def rank_candidates(pairs: DataFrame, tie_tolerance: float, key: str = "event_id", unit: str = "unit_id") -> DataFrame:
    """pairs with rank, count, gap to the second, is_ambiguous, is_tie (gap at most the tolerance)."""
    w = W.partitionBy(key).orderBy(F.round("distance", 9), unit)
    every = W.partitionBy(key)
    r = pairs.withColumn("candidate_rank", F.row_number().over(w)).withColumn("candidate_count", F.count("*").over(every))
    second = F.max(F.when(F.col("candidate_rank") == 2, F.col("distance"))).over(every)
    first = F.max(F.when(F.col("candidate_rank") == 1, F.col("distance"))).over(every)
    return r.withColumn("gap", second - first).withColumn("is_ambiguous", F.col("candidate_count") > 1).withColumn("is_tie", F.coalesce(F.round("gap", 9) <= tie_tolerance, F.lit(False)))


def assign(points: DataFrame, ranked: DataFrame, key: str = "event_id", unit: str = "unit_id") -> DataFrame:
    """One row a point: primary_assigned, unresolved_tie (no unit), outside_selected_threshold or no_valid_coordinates."""
    top = ranked.filter("candidate_rank = 1").select(key, unit, "distance", "candidate_count", "gap", "is_tie")
    j = points.select(key, "valid").join(top, key, "left")
    status = F.when(~F.col("valid"), "no_valid_coordinates").when(F.col("distance").isNull(), "outside_selected_threshold").when(F.col("is_tie"), "unresolved_tie").otherwise("primary_assigned")
    return j.select(key, status.alias("assignment_status"), F.when(status == "primary_assigned", F.col(unit)).alias(unit), "distance", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.round("gap", 4).alias("gap"))


def sensitivity(pairs: DataFrame, total: Column, limits: tuple[float, ...], tie_tolerance: float, key: str = "event_id", unit: str = "unit_id") -> DataFrame:
    """One row a limit: pairs, matched, single, multiple, ties ranked anew within the limit, percentiles, gain over the limit before."""
    each = pairs.withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits]))).filter(F.col("distance") <= F.col("limit"))
    w = W.partitionBy("limit", key).orderBy(F.round("distance", 9), unit)
    r = each.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("limit", key))).withColumn("gap", F.lead("distance").over(w) - F.col("distance"))
    r = cut_lineage(r, "by-limit")
    a = r.groupBy("limit").agg(
        F.count("*").alias("pairs"), F.count_if(F.expr("rn = 1")).alias("matched"), F.count_if(F.expr("rn = 1 and n = 1")).alias("single"), F.count_if(F.expr("rn = 1 and n > 1")).alias("multiple"),
        F.count_if((F.col("rn") == 1) & (F.round("gap", 9) <= tie_tolerance)).alias("ties"), F.max(F.when(F.col("rn") == 1, F.col("distance"))).alias("largest"),
    )
    a = a.join(percentiles(r.filter("rn = 1"), ["limit"], "distance", {"p50": 0.5, "p95": 0.95}), "limit", "left")
    by = W.orderBy("limit")  # one row a limit
    return a.withColumn("gain", F.col("matched") - F.coalesce(F.lag("matched").over(by), F.lit(0))).withColumn("coverage", F.col("matched") / total)


def line_figures(segments: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Length, length-weighted centroid and box of every line."""
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    s = segments.withColumn("l", length)
    return s.groupBy(unit).agg(
        F.sum("l").alias("length"), (F.sum(F.col("l") * (F.col("x1") + F.col("x2")) / 2) / F.sum("l")).alias("cx"), (F.sum(F.col("l") * (F.col("y1") + F.col("y2")) / 2) / F.sum("l")).alias("cy"),
        F.min(F.least("x1", "x2")).alias("min_x"), F.max(F.greatest("x1", "x2")).alias("max_x"), F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("y1", "y2")).alias("max_y"),
    )


#: Cells of the overlay are shifted by this share of their size, so that corners of round coordinates do not lie on their borders.
SHIFT = 0.381966


def _grid_cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell - SHIFT).cast("long"), F.floor(high / cell - SHIFT).cast("long")))


def _laid(df: DataFrame, x1: str, y1: str, x2: str, y2: str, cell: float) -> DataFrame:
    """Lines once for each cell (cx, cy) that they can touch: in each column of cells only the rows between their heights at its two sides."""
    d = df.withColumn("cx", _grid_cells(F.least(x1, x2), F.greatest(x1, x2), cell))
    left, right = F.greatest(F.least(x1, x2), (F.col("cx") + SHIFT) * cell), F.least(F.greatest(x1, x2), (F.col("cx") + 1 + SHIFT) * cell)
    dx = F.nullif(F.col(x2) - F.col(x1), F.lit(0.0))
    at = lambda x: F.col(y1) + (x - F.col(x1)) / dx * (F.col(y2) - F.col(y1))
    low, high = F.coalesce(F.least(at(left), at(right)), F.least(y1, y2)), F.coalesce(F.greatest(at(left), at(right)), F.greatest(y1, y2))
    return d.withColumn("cy", _grid_cells(low - 1e-6 * cell, high + 1e-6 * cell, cell))


def polygon_cells(edges: DataFrame, cell: float) -> DataFrame:
    """(poly_id, cx, cy, odd, edges): the cells of polygons that are inside or on the border. odd: whether the lower left corner is inside; edges: those that touch the cell (none: all of it is inside).

    A column of cells takes the heights at which the edges cross its left side; from these every corner's parity is counted. edges: (poly_id, ex1, ey1, ex2, ey2).
    """
    e = edges.select("poly_id", "ex1", "ey1", "ex2", "ey2")
    border = _laid(e, "ex1", "ey1", "ex2", "ey2", cell).groupBy("poly_id", "cx", "cy").agg(F.collect_list(F.struct("ex1", "ey1", "ex2", "ey2")).alias("edges"))
    columns = e.withColumn("cx", _grid_cells(F.least("ex1", "ex2"), F.greatest("ex1", "ex2"), cell))
    x = (F.col("cx") + SHIFT) * cell
    crosses = (F.col("ex1") <= x) != (F.col("ex2") <= x)
    height = F.when(crosses, F.col("ey1") + (x - F.col("ex1")) / F.nullif(F.col("ex2") - F.col("ex1"), F.lit(0.0)) * (F.col("ey2") - F.col("ey1")))
    sides = columns.groupBy("poly_id", "cx").agg(F.collect_list(height).alias("heights"), F.min(F.least("ey1", "ey2")).alias("low"), F.max(F.greatest("ey1", "ey2")).alias("high"))
    # of a column without an end of an edge, too, all rows between the least and the largest height
    every = sides.withColumn("cy", _grid_cells(F.col("low"), F.col("high"), cell))
    odd = F.size(F.filter("heights", lambda h: h > (F.col("cy") + SHIFT) * cell)) % 2 == 1
    every = every.select("poly_id", "cx", "cy", odd.alias("odd"))
    return every.join(border, ["poly_id", "cx", "cy"], "left").filter(F.col("odd") | F.col("edges").isNotNull()).withColumn("edges", F.coalesce("edges", F.array().cast(border.schema["edges"].dataType)))


def overlay_lengths(segments: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(unit_id, poly_id, length) of lines within polygons given by their edges (poly_id, ex1, ey1, ex2, ey2).

    Segments are cut where they cross an edge, and at the sides of cells; a piece belongs to the polygons that hold its midpoint. Both joins are on cells (cx, cy): a cell
    inside a polygon needs no edge, and on the border parity is carried from the cell's corner to the midpoint over the edges of that cell alone.
    """
    s = segments.withColumn("sid", F.concat_ws(":", "unit_id", "part", "seq"))
    e = _laid(edges, "ex1", "ey1", "ex2", "ey2", cell)
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1")
    det = dx * ey - dy * ex
    t = ((F.col("ex1") - F.col("x1")) * ey - (F.col("ey1") - F.col("y1")) * ex) / det
    u = ((F.col("ex1") - F.col("x1")) * dy - (F.col("ey1") - F.col("y1")) * dx) / det
    laid = _laid(s.select("sid", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", cell)
    cuts = laid.join(e, ["cx", "cy"]).filter(det != 0).select("sid", F.round(t, 12).alias("t"), u.alias("u")).filter("t > 0 and t < 1 and u >= 0 and u <= 1").select("sid", "t")
    ends = s.select("sid", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    pieces = cuts.unionByName(ends).distinct().withColumn("z", F.lead("t").over(W.partitionBy("sid").orderBy("t"))).filter("z is not null").join(s, "sid")
    mid = (F.col("t") + F.col("z")) / 2
    pieces = pieces.select("unit_id", "sid", "t", (F.col("x1") + mid * dx).alias("mx"), (F.col("y1") + mid * dy).alias("my"), ((F.col("z") - F.col("t")) * F.sqrt(dx * dx + dy * dy)).alias("l"))
    pieces = pieces.withColumns({"cx": F.floor(F.col("mx") / cell - SHIFT).cast("long"), "cy": F.floor(F.col("my") / cell - SHIFT).cast("long")})
    x0, y0 = (F.col("cx") + SHIFT) * cell, (F.col("cy") + SHIFT) * cell

    def crossed(e: Column) -> Column:
        """From the corner along the lower side to the midpoint's x, then up to the midpoint."""
        over = (e["ey1"] <= y0) != (e["ey2"] <= y0)
        x = e["ex1"] + (y0 - e["ey1"]) / F.nullif(e["ey2"] - e["ey1"], F.lit(0.0)) * (e["ex2"] - e["ex1"])
        beside = (e["ex1"] <= F.col("mx")) != (e["ex2"] <= F.col("mx"))
        y = e["ey1"] + (F.col("mx") - e["ex1"]) / F.nullif(e["ex2"] - e["ex1"], F.lit(0.0)) * (e["ey2"] - e["ey1"])
        return F.coalesce((over & (x > x0) & (x <= F.col("mx"))).cast("int"), F.lit(0)) + F.coalesce((beside & (y > y0) & (y <= F.col("my"))).cast("int"), F.lit(0))

    held = pieces.join(polygon_cells(edges, cell), ["cx", "cy"])
    times = F.aggregate("edges", F.col("odd").cast("int"), lambda n, e: n + crossed(e))
    return held.filter(times % 2 == 1).groupBy("unit_id", "poly_id").agg(F.sum("l").alias("length"))


def overlay_scores(overlay: DataFrame, figures: DataFrame, score: str, high: float = 0.75, most: float = 0.5) -> DataFrame:
    """Per line: score weighted by length over polygons whose score is not negative, share of its length with a high score, coverage in per cent, and two rules for a high line.

    overlay: (unit_id, length, score); figures: (unit_id, length) of whole lines."""
    s, l = F.col(score), F.col("length")  # noqa: E741
    o = overlay.groupBy("unit_id").agg(F.sum(l).alias("inside"), F.try_divide(F.sum(F.when(s >= 0, l * s)), F.sum(F.when(s >= 0, l))).alias("weighted"), F.coalesce(F.sum(F.when(s >= high, l)), F.lit(0.0)).alias("high"))
    o = o.join(figures.select("unit_id", F.col("length").alias("whole")), "unit_id")
    share = F.col("high") / F.col("whole")
    return o.select("unit_id", "weighted", share.alias("high_share"), (F.col("inside") / F.col("whole") * 100).alias("coverage_pct"), F.coalesce(F.round("weighted", 9) >= high, F.lit(False)).alias("high_by_weight"), (F.round(share, 9) >= most).alias("high_by_share"))


def parse_wkt(df: DataFrame, wkt: str, key: str) -> DataFrame:
    """(key, seq, x, y) of LINESTRING texts."""
    inner = F.regexp_extract(wkt, r"\(([^()]*)\)", 1)
    v = df.select(key, F.posexplode(F.split(inner, r"\s*,\s*")).alias("seq", "v"))
    xy = F.split(F.trim("v"), r"\s+")
    return v.select(key, "seq", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))


def emit_wkt(vertices: DataFrame, key: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("v"))))
    return vertices.groupBy(key).agg(F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(ordered, lambda s: s["v"]), ", "), F.lit(")")).alias("wkt"))


# EPSG:3435 on GRS80, in US survey feet.
_A, _F_INV, _LAT0, _LON0, _K0, _FE = 6378137.0, 298.257222101, 36.0 + 40.0 / 60, -(88.0 + 20.0 / 60), 0.999975, 984250.0
_FEET = 3937.0 / 1200.0


def project_sql(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing of a transverse Mercator projection as SQL expressions (series to the sixth order)."""
    f = 1 / _F_INV
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)
    m = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)

    def arc(p: str) -> str:
        return f"({_A!r}e0 * ({m[0]!r}e0 * {p} - {m[1]!r}e0 * sin(2 * {p}) + {m[2]:.20f}e0 * sin(4 * {p}) - {m[3]:.20f}e0 * sin(6 * {p})))"

    p, p0 = f"radians({lat})", f"radians({_LAT0!r}e0)"
    n = f"({_A!r}e0 / sqrt(1 - {e2!r}e0 * sin({p}) * sin({p})))"
    t, c, a = f"(tan({p}) * tan({p}))", f"({ep2!r}e0 * cos({p}) * cos({p}))", f"(radians(({lon}) - ({_LON0!r}e0)) * cos({p}))"
    x = f"{_FEET!r}e0 * {_K0!r}e0 * {n} * ({a} + (1 - {t} + {c}) * power({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {ep2!r}e0) * power({a}, 5) / 120) + {_FE!r}e0"
    y = f"{_FEET!r}e0 * {_K0!r}e0 * ({arc(p)} - {arc(p0)} + {n} * tan({p}) * ({a} * {a} / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * power({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {ep2!r}e0) * power({a}, 6) / 720))"
    return x, y


def unproject_sql(x: str, y: str) -> tuple[str, str]:
    """Longitude and latitude of planar feet as SQL expressions: the inverse of project_sql."""
    f = 1 / _F_INV
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    p0 = math.radians(_LAT0)
    m = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    arc0 = _A * (m[0] * p0 - m[1] * math.sin(2 * p0) + m[2] * math.sin(4 * p0) - m[3] * math.sin(6 * p0))
    mu = f"(({arc0!r}e0 + ({y}) / {_FEET!r}e0 / {_K0!r}e0) / {_A * m[0]!r}e0)"
    p1 = f"({mu} + {3 * e1 / 2 - 27 * e1**3 / 32:.20f}e0 * sin(2 * {mu}) + {21 * e1**2 / 16 - 55 * e1**4 / 32:.20f}e0 * sin(4 * {mu}) + {151 * e1**3 / 96:.20f}e0 * sin(6 * {mu}))"
    n = f"({_A!r}e0 / sqrt(1 - {e2!r}e0 * sin({p1}) * sin({p1})))"
    r = f"({_A * (1 - e2)!r}e0 / power(1 - {e2!r}e0 * sin({p1}) * sin({p1}), 1.5e0))"
    t, c = f"(tan({p1}) * tan({p1}))", f"({ep2!r}e0 * cos({p1}) * cos({p1}))"
    d = f"((({x}) - {_FE!r}e0) / {_FEET!r}e0 / {_K0!r}e0 / {n})"
    lat = f"degrees({p1} - {n} * tan({p1}) / {r} * ({d} * {d} / 2 - (5 + 3 * {t} + 10 * {c} - 4 * {c} * {c} - 9 * {ep2!r}e0) * power({d}, 4) / 24 + (61 + 90 * {t} + 298 * {c} + 45 * {t} * {t} - 252 * {ep2!r}e0 - 3 * {c} * {c}) * power({d}, 6) / 720))"
    lon = f"({_LON0!r}e0 + degrees(({d} - (1 + 2 * {t} + {c}) * power({d}, 3) / 6 + (5 - 2 * {c} + 28 * {t} - 3 * {c} * {c} + 8 * {ep2!r}e0 + 24 * {t} * {t}) * power({d}, 5) / 120) / cos({p1})))"
    return lon, lat
