"""Queries of the DataFrame operators over the stand-in views, with their oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.storage import cut_lineage, scratch_path
from waymark.operators import clean, graph, order, panel, spatial
from waymark.operators.gates import bad, gate, offences, repeated
from waymark.plans.statements import _n, _r
from waymark.proxy import DAY, Tables, run_sql, view
from waymark.sources import snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


POINTS = "SELECT event_id, CAST((event_id * 7919) % 10000 AS DOUBLE) AS x, CAST((event_id * 104729) % 10000 AS DOUBLE) AS y, event_id % 97 <> 0 AS valid FROM events"
_Y = "CASE WHEN n_nationkey = 23 THEN 400 * 22 + 15 ELSE 400 * n_nationkey END"
_YM = "CASE WHEN n_nationkey = 23 THEN 407 * 22 + 15 ELSE 407 * n_nationkey END"
SEGMENTS = f"""SELECT n_nationkey AS unit_id, 0 AS part, 0 AS seq, 0e0 AS x1, CAST({_Y} AS DOUBLE) AS y1, 5000e0 AS x2, CAST({_YM} AS DOUBLE) AS y2 FROM nation
    UNION ALL SELECT n_nationkey, 0, 1, 5000e0, CAST({_YM} AS DOUBLE), 10000e0, CAST({_Y} AS DOUBLE) FROM nation UNION ALL SELECT 24, 1, 0, 0e0, CAST(400 * 24 + 12 AS DOUBLE), 10000e0, CAST(400 * 24 + 12 AS DOUBLE) FROM nation WHERE n_nationkey = 24"""
_T = "greatest(0e0, least(1e0, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))))"
_D = f"sqrt(power(s.x1 + {_T} * (s.x2 - s.x1) - p.x, 2) + power(s.y1 + {_T} * (s.y2 - s.y1) - p.y, 2))"
PAIRS = f"""pts AS ({POINTS}), segs AS ({SEGMENTS}), pairs AS (SELECT event_id, unit_id, min(d) AS distance FROM (SELECT p.event_id, s.unit_id, {_D} AS d FROM pts p CROSS JOIN segs s WHERE p.valid) WHERE d <= 200 GROUP BY event_id, unit_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(distance, 9), unit_id) AS rn, count(*) OVER (PARTITION BY event_id) AS n FROM pairs WHERE distance <= 100),
    gaps AS (SELECT event_id, max(CASE WHEN rn = 1 THEN unit_id END) AS unit_id, max(CASE WHEN rn = 1 THEN distance END) AS distance, max(n) AS n, max(CASE WHEN rn = 2 THEN distance END) - max(CASE WHEN rn = 1 THEN distance END) AS gap FROM ranked GROUP BY event_id)"""
LIMITS = (50.0, 100.0, 150.0, 200.0)


def points(spark, d):
    return run_sql(spark, d, POINTS)


def segments(spark, d):
    return run_sql(spark, d, SEGMENTS)


def pairs(spark, d, limit=200.0):
    return spatial.within_distance(points(spark, d).filter("valid"), segments(spark, d), limit)


@query(f"SELECT unit_id, unit_name, {_r('m')} AS trailing_mean FROM (SELECT unit_id, unit_name, total_mean12 AS m, row_number() OVER (ORDER BY round(total_mean12, 6) DESC, unit_id) AS rn FROM feat WHERE month_start = (SELECT max(month_start) FROM panel)) WHERE rn <= 10")
def flagship_top_units(spark, d):
    """Units with the highest trailing mean in the last month."""
    t = Tables(spark, d)
    last = t.view("panel").agg(F.max("month_start").alias("month_start"))
    f = panel.with_trailing(t.view("panel"), "unit_id", "month_start", ["total"], (12,), "mean").join(F.broadcast(last), "month_start")
    return f.select("unit_id", "unit_name", r6("total_mean12").alias("trailing_mean")).orderBy(F.desc("trailing_mean"), "unit_id").limit(10)


# sources and sinks: written from the tables to the shared folder and read again
@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def sc02_csv_scan(spark, d):
    at = scratch_path(spark, "csv")
    run_sql(spark, d, "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders").write.option("header", True).csv(at)
    return snapshot.read_csv(spark, at, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT CAST(record_id AS STRING) AS record_id, injury, nullif(lanes, '') AS lanes FROM raw")
def sc03_gzip_parts(spark, d):
    at = scratch_path(spark, "parts")
    snapshot.write_parts(run_sql(spark, d, "SELECT record_id, CASE WHEN injury = ' ' THEN '_' ELSE injury END AS injury, lanes FROM raw").repartition(4), at)
    t = snapshot.read_text_parts(spark, at, ["record_id", "injury", "lanes"])
    return t.select("record_id", F.when(F.col("injury") == "_", " ").otherwise(F.col("injury")).alias("injury"), F.nullif("lanes", F.lit("")).alias("lanes"))


def _geojson(spark, d, features):
    """features (page, id, empty, x1, y1, x2, y2) as one GeoJSON file a page."""
    at = scratch_path(spark, "geojson")
    line = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    geometry = F.when(~F.col("empty"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")))
    f = features.select("page", F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties"), geometry.alias("geometry")).alias("f"))
    f.groupBy("page").agg(F.collect_list("f").alias("features")).select(F.lit("FeatureCollection").alias("type"), "features").repartition(4).write.json(at)
    return at


_CLEAN = f"SELECT unit_id % 4 AS page, CAST(unit_id AS STRING) || '-' || CAST(part AS STRING) || '-' || CAST(seq AS STRING) AS id, FALSE AS empty, x1, y1, x2, y2 FROM ({SEGMENTS}) s"
#: Pages with empty geometries, missing ids, and features twice in a page or in two pages.
_DIRTY = f"""SELECT page, CASE WHEN id LIKE '5-%' THEN NULL ELSE id END AS id, id LIKE '3-%' AS empty, x1, y1, x2, y2 FROM ({_CLEAN}) c UNION ALL SELECT page, id, FALSE, x1, y1, x2, y2 FROM ({_CLEAN}) c WHERE id LIKE '6-%'
    UNION ALL SELECT (page + 1) % 4, id, FALSE, x1, y1, x2, y2 FROM ({_CLEAN}) c WHERE id LIKE '9-%'"""


@query(f"WITH s AS ({SEGMENTS}) SELECT CAST(unit_id AS STRING) || '-' || CAST(part AS STRING) || '-' || CAST(seq AS STRING) AS id, 'LineString' AS geometry_type, 0 AS seq, x1 AS x, y1 AS y FROM s WHERE unit_id <> 7 UNION ALL SELECT CAST(unit_id AS STRING) || '-' || CAST(part AS STRING) || '-' || CAST(seq AS STRING), 'LineString', 1, x2, y2 FROM s WHERE unit_id <> 7")
def sc04_geojson_scan(spark, d):
    return snapshot.read_geojson(spark, _geojson(spark, d, run_sql(spark, d, _CLEAN)), ("7-0-0", "7-0-1"))


@query(f"""WITH f AS ({_DIRTY}), p AS (SELECT page, id, count(*) AS n FROM f WHERE id IS NOT NULL GROUP BY page, id) SELECT {_n('count(*)')} AS features, {_n('count(CASE WHEN empty THEN 1 END)')} AS empty, {_n('count(*) - count(id)')} AS missing_ids, {_n('count(DISTINCT id)')} AS ids,
    {_n('max((SELECT sum(n - 1) FROM p))')} AS repeated_in_page, {_n('max((SELECT count(*) - count(DISTINCT id) FROM p))')} AS repeated_across_pages, 'LineString:' || CAST(count(CASE WHEN NOT empty THEN 1 END) AS STRING) AS geometry_types, {_n('count(*) - count(id)')} AS missing_properties FROM f""")
def sc05_geojson_profile(spark, d):
    return snapshot.profile_geojson(spark, _geojson(spark, d, run_sql(spark, d, _DIRTY)), required=("id",))


@query("SELECT unit_id, month_start, total FROM panel")
def sc06_gated_parquet_sink(spark, d):
    at, p = scratch_path(spark, "panel"), view(spark, d, "panel").select("unit_id", "month_start", "total")
    checks = p.agg((F.count_if(F.expr("unit_id is null")) == 0).alias("passed")).withColumn("severity", F.lit("CRITICAL"))
    if not snapshot.publish_if_passed(p, checks, at):
        raise ValueError("the panel did not pass")
    return spark.read.parquet(at)


@query("SELECT unit_id, yr, mon, ksi FROM panel")
def sc07_copy_view(spark, d):
    at = scratch_path(spark, "copy")
    run_sql(spark, d, "SELECT unit_id, yr, mon, ksi FROM panel").write.parquet(at)
    return spark.read.parquet(at)


@query("SELECT unit_id, month_start, total FROM panel")
def sc08_dual_sink(spark, d):
    at = scratch_path(spark, "dual")
    snapshot.write_dual(view(spark, d, "panel").select("unit_id", "month_start", "total"), at)
    return snapshot.read_csv(spark, f"{at}/csv", "unit_id int, month_start date, total long")


def _published(spark, d, compression):
    at = scratch_path(spark, "snapshot")
    snapshot.publish_parts(view(spark, d, "ev").select("event_id", "unit_id", "severity"), at, "unit_id", 5, compression)
    return at


_COUNTED = "SELECT CAST(unit_id % 5 AS INT) AS part, count(*) AS n FROM ev GROUP BY unit_id % 5"


@query(f"SELECT part, TRUE AS size_ok, TRUE AS sha_ok, {_n('n')} AS expected_rows, {_n('n')} AS found_rows, (SELECT count(*) FROM ({_COUNTED}) x) = 5 AS parts_ok FROM ({_COUNTED}) c")
def sc09_snapshot_audit(spark, d):
    """Size, checksum and rows of every part, and the number of parts, against the manifest stored when the snapshot was published."""
    return snapshot.audit_parts(spark, _published(spark, d, "gzip")).select("part", "size_ok", "sha_ok", "expected_rows", "found_rows", "parts_ok")


@query(f"SELECT TRUE AS sha_ok, TRUE AS rows_ok, TRUE AS columns_ok, {_n('count(*)')} AS found_rows FROM ev")
def sc10_published_snapshot(spark, d):
    """Checksums under canonical newlines, rows, and required columns of a published snapshot."""
    a = snapshot.audit_parts(spark, _published(spark, d, "none"), canonical_newlines=True, required=("event_id", "unit_id", "severity"))
    return a.agg(F.bool_and("sha_ok").alias("sha_ok"), F.bool_and(F.col("expected_rows") == F.col("found_rows")).alias("rows_ok"), F.bool_and("columns_ok").alias("columns_ok"), F.sum("found_rows").alias("found_rows"))


_ISSUES = f"""SELECT 'blank_injury' AS metric, {_n("count(CASE WHEN trim(injury) = '' THEN 1 END)")} AS n FROM raw UNION ALL SELECT 'blank_date', {_n("count(CASE WHEN event_date = '' THEN 1 END)")} FROM raw UNION ALL SELECT 'never', {_n('count(CASE WHEN record_id IS NULL THEN 1 END)')} FROM raw
    UNION ALL SELECT 'bad_flag', {_n("count(CASE WHEN upper(trim(flag)) NOT IN ('Y', 'N', '') THEN 1 END)")} FROM raw"""


@query(f"WITH m AS ({_ISSUES}), r AS (SELECT 'RUN1' AS run UNION ALL SELECT 'RUN2') SELECT 'DQ-' || run || '-' || lpad(CAST(row_number() OVER (PARTITION BY run ORDER BY metric) AS STRING), 3, '0') AS issue_id, run AS run_id, metric, n FROM m CROSS JOIN r WHERE n > 0")
def sc13_issue_register(spark, d):
    """Two runs in one register; the first is done again and replaces itself."""
    at, metrics = scratch_path(spark, "register"), run_sql(spark, d, _ISSUES)
    for run in ("RUN1", "RUN2", "RUN1"):
        snapshot.append_issues(metrics, at, run)
    return snapshot.read_issues(spark, at)


# cleaning
_RAW = {
    "cl01_normalize_string": ("nullif(trim(injury), '') AS injury, nullif(upper(trim(flag)), '') AS flag", lambda: [clean.normalize_string(F.col("injury")).alias("injury"), clean.normalize_string(F.col("flag"), True).alias("flag")]),
    "cl02_integer": ("CASE WHEN try_cast(nullif(trim(lanes), '') AS DOUBLE) % 1 = 0 THEN CAST(try_cast(nullif(trim(lanes), '') AS DOUBLE) AS BIGINT) END AS lanes, coalesce(trim(lanes), '') <> '' AND coalesce(try_cast(nullif(trim(lanes), '') AS DOUBLE) % 1 <> 0, TRUE) AS bad", lambda: [clean.coerce_integer(F.col("lanes")).alias("lanes"), clean.invalid_integer(F.col("lanes")).alias("bad")]),
    "cl03_float": ("try_cast(speed AS DOUBLE) AS speed, speed IS NOT NULL AND try_cast(speed AS DOUBLE) IS NULL AS bad", lambda: [clean.coerce_float(F.col("speed")).alias("speed"), clean.invalid_float(F.col("speed")).alias("bad")]),
    "cl04_dates": (f"{DAY} AS event_day, ({DAY}) IS NULL AS invalid, CAST(date_trunc('month', {DAY}) AS DATE) AS month_start, CAST(year({DAY}) AS INT) AS event_year", lambda: [clean.parse_date(F.col("event_date")).alias("event_day"), clean.parse_date(F.col("event_date")).isNull().alias("invalid"), F.trunc(clean.parse_date(F.col("event_date")), "month").alias("month_start"), F.year(clean.parse_date(F.col("event_date"))).alias("event_year")]),
    "cl05_severity": ("CASE upper(trim(injury)) WHEN 'FATAL' THEN 'K' WHEN 'INCAPACITATING INJURY' THEN 'A' WHEN 'NONINCAPACITATING INJURY' THEN 'B' WHEN 'REPORTED, NOT EVIDENT' THEN 'C' WHEN 'NO INDICATION OF INJURY' THEN 'O' ELSE 'U' END AS kabco, upper(trim(injury)) NOT IN ('', 'FATAL', 'INCAPACITATING INJURY', 'NONINCAPACITATING INJURY', 'REPORTED, NOT EVIDENT', 'NO INDICATION OF INJURY') AS unmapped", lambda: [clean.map_severity(F.col("injury")).alias("kabco"), clean.severity_unmapped(F.col("injury")).alias("unmapped")]),
    "cl07_domain": ("upper(trim(flag)) NOT IN ('Y', 'N', '') AS outside", lambda: [clean.outside_domain(F.col("flag")).alias("outside")]),
    "cl08_ranges": ("coalesce(try_cast(speed AS DOUBLE) NOT BETWEEN 1 AND 70, FALSE) AS speed_warns", lambda: [clean.outside_range(clean.coerce_float(F.col("speed")), 1, 70).alias("speed_warns")]),
    "cl10_street": ("nullif(trim(regexp_replace(upper(street), '[^A-Z0-9]+', ' ', 'g')), '') AS street", lambda: [clean.normalize_street(F.col("street")).alias("street")]),
}
for _name, (_sql, _columns) in _RAW.items():
    QUERIES[_name] = lambda spark, d, c=_columns: view(spark, d, "raw").select("record_id", *c())
    ORACLES[_name] = f"SELECT record_id, {_sql} FROM raw"


@query("SELECT record_id, coordinate_status FROM clean")
def cl06_coordinates(spark, d):
    return view(spark, d, "raw").select("record_id", clean.classify_coordinates(F.col("lat"), F.col("lon")).alias("coordinate_status"))


@query("SELECT record_id, injury_text, kabco, event_day, lanes, speed, flag, coordinate_status FROM clean")
def cl09_clean_rows(spark, d):
    return clean.clean_rows(view(spark, d, "raw")).select("record_id", "injury_text", "kabco", "event_day", "lanes", "speed", "flag", "coordinate_status")


_INVALID = {
    "injury|unmapped": "trim(injury) <> '' AND upper(trim(injury)) NOT IN ('FATAL', 'INCAPACITATING INJURY', 'NONINCAPACITATING INJURY', 'REPORTED, NOT EVIDENT', 'NO INDICATION OF INJURY')", "event_date|not_a_date": f"({DAY}) IS NULL",
    "lanes|not_an_integer": "trim(lanes) <> '' AND coalesce(try_cast(trim(lanes) AS DOUBLE) % 1 <> 0, TRUE)", "speed|not_a_number": "trim(speed) <> '' AND try_cast(trim(speed) AS DOUBLE) IS NULL", "speed|outside_range": "try_cast(trim(speed) AS DOUBLE) NOT BETWEEN 1 AND 70",
    "flag|outside_domain": "upper(trim(flag)) NOT IN ('Y', 'N', '')",
}


@query("SELECT CAST(NULL AS STRING) AS column_name, 'rows' AS problem, count(*) AS n FROM raw UNION ALL " + " UNION ALL ".join(f"SELECT '{k.split('|')[0]}', '{k.split('|')[1]}', count(CASE WHEN {c} THEN 1 END) FROM raw" for k, c in _INVALID.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'coordinates', '{s}', count(CASE WHEN coordinate_status = '{s}' THEN 1 END) FROM clean" for s in ("missing_pair", "incomplete_pair", "non_numeric", "out_of_range")))
def cl09_invalid_counts(spark, d):
    """Invalid values of the raw records by column, counted in one pass."""
    return clean.invalid_counts(view(spark, d, "raw"))


@query("SELECT record_id, nullif(trim(regexp_replace(upper(street), '[^A-Z0-9]+', ' ', 'g')), '') AS street, CASE nullif(trim(regexp_replace(upper(street), '[^A-Z0-9]+', ' ', 'g')), '') WHEN 'N MAIN ST' THEN 'NORTH MAIN STREET' WHEN 'LAKE SHORE DR' THEN 'LAKE SHORE DRIVE' ELSE nullif(trim(regexp_replace(upper(street), '[^A-Z0-9]+', ' ', 'g')), '') END AS canonical_street FROM raw")
def cl10_street_aliases(spark, d):
    """Street names, and their canonical names where the alias table has one."""
    aliases = spark.createDataFrame([("N MAIN ST", "NORTH MAIN STREET"), ("LAKE SHORE DR", "LAKE SHORE DRIVE")], "alias string, canonical string")
    streets = view(spark, d, "raw").select("record_id", clean.normalize_street(F.col("street")).alias("street"))
    return clean.with_aliases(streets, "street", aliases, "canonical_street")


@query("SELECT unit_id, 'COR-' || lpad(CAST(unit_id + CASE grp WHEN 'ASIA' THEN 100 WHEN 'EUROPE' THEN 200 ELSE 0 END AS STRING), 3, '0') AS stable_id FROM units")
def cl11_stable_id(spark, d):
    return view(spark, d, "units").select("unit_id", clean.stable_id(F.col("unit_id"), F.col("grp"), {"ASIA": 100, "EUROPE": 200}).alias("stable_id"))


@query("SELECT yr, sha256(string_agg(CAST(unit_id AS STRING), '|' ORDER BY CAST(unit_id AS STRING))) AS selection_hash FROM (SELECT DISTINCT yr, unit_id FROM ev WHERE severity = 'K') GROUP BY yr")
def cl17_fingerprint(spark, d):
    return clean.fingerprint(view(spark, d, "ev").filter("severity = 'K'").select("yr", "unit_id").distinct(), ["yr"], F.col("unit_id").cast("string"))


@query("SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS STRING) || ' is ' || o_orderstatus AS label FROM orders")
def cl19_format(spark, d):
    return run_sql(spark, d, "SELECT o_orderkey, o_orderstatus FROM orders").select("o_orderkey", F.format_string("Order %d is %s", "o_orderkey", "o_orderstatus").alias("label"))


# spatial
_X, _YY = spatial.project_sql("lon", "lat")
_LONLAT = "SELECT event_id, -87.9e0 + (event_id % 1000) / 2500e0 AS lon, 41.6e0 + (event_id % 777) / 2000e0 AS lat FROM events"


@query(f"WITH g AS ({_LONLAT}) SELECT event_id, round({_X}, 3) AS east, round({_YY}, 3) AS north FROM g")
def sp01_project(spark, d):
    return run_sql(spark, d, _LONLAT).select("event_id", F.round(F.expr(_X), 3).alias("east"), F.round(F.expr(_YY), 3).alias("north"))


_PAIR_SQL = f"WITH {PAIRS} SELECT event_id, unit_id, {_r('distance')} AS distance FROM pairs"


@query(_PAIR_SQL)
def sp02_within_distance(spark, d):
    return pairs(spark, d).select("event_id", "unit_id", r6("distance").alias("distance"))


QUERIES["jo12_distance_join"], ORACLES["jo12_distance_join"] = sp02_within_distance, _PAIR_SQL


def ranked(spark, d):
    return spatial.rank_candidates(pairs(spark, d).filter("distance <= 100"), 10.0)


_RANK_SQL = f"WITH {PAIRS} SELECT r.event_id, r.unit_id, {_n('r.rn')} AS candidate_rank, {_n('r.n')} AS candidate_count, r.n > 1 AS is_ambiguous, coalesce(round(g.gap, 9) <= 10, FALSE) AS is_tie FROM ranked r JOIN gaps g ON r.event_id = g.event_id"
for _name in ("sp03_rank_candidates", "wi07_rank_first", "wi16_tie_detection"):
    QUERIES[_name] = lambda spark, d: ranked(spark, d).select("event_id", "unit_id", F.col("candidate_rank").cast("long").alias("candidate_rank"), "candidate_count", "is_ambiguous", "is_tie")
    ORACLES[_name] = _RANK_SQL
_STATUS = "CASE WHEN NOT p.valid THEN 'no_valid_coordinates' WHEN g.distance IS NULL THEN 'outside_selected_threshold' WHEN coalesce(round(g.gap, 9) <= 10, FALSE) THEN 'unresolved_tie' ELSE 'primary_assigned' END"
_ASSIGN_SQL = f"SELECT event_id, status AS assignment_status, CASE WHEN status = 'primary_assigned' THEN unit_id END AS unit_id, {_r('distance')} AS distance, {_n('coalesce(n, 0)')} AS candidate_count FROM (SELECT p.event_id, g.unit_id, g.distance, g.n, {_STATUS} AS status FROM pts p LEFT JOIN gaps g ON p.event_id = g.event_id)"


def assigned(spark, d):
    return spatial.assign(points(spark, d), ranked(spark, d))


@query(f"WITH {PAIRS} {_ASSIGN_SQL}")
def sp04_assign(spark, d):
    return assigned(spark, d).select("event_id", "assignment_status", "unit_id", r6("distance").alias("distance"), "candidate_count")


_SENS = f"""WITH {PAIRS}, lim AS (SELECT * FROM (VALUES (50e0), (100e0), (150e0), (200e0)) AS t(lim)), e AS (SELECT l.lim, p.*, row_number() OVER (PARTITION BY l.lim, event_id ORDER BY round(distance, 9), unit_id) AS rn, count(*) OVER (PARTITION BY l.lim, event_id) AS n,
    lead(distance) OVER (PARTITION BY l.lim, event_id ORDER BY round(distance, 9), unit_id) - distance AS gap FROM lim l JOIN pairs p ON p.distance <= l.lim),
    a AS (SELECT lim, count(*) AS pairs_n, count(CASE WHEN rn = 1 THEN 1 END) AS matched, count(CASE WHEN rn = 1 AND n = 1 THEN 1 END) AS single, count(CASE WHEN rn = 1 AND round(gap, 9) <= 10 THEN 1 END) AS ties,
    quantile_cont(CASE WHEN rn = 1 THEN distance END, 0.5) AS p50, quantile_cont(CASE WHEN rn = 1 THEN distance END, 0.95) AS p95, max(CASE WHEN rn = 1 THEN distance END) AS largest FROM e GROUP BY lim)"""


def _sensitivity(spark, d):
    n = points(spark, d).filter("valid").count()
    return spatial.sensitivity(pairs(spark, d), F.lit(float(n)), LIMITS, 10.0)


@query(f"{_SENS} SELECT lim AS \"limit\", {_n('pairs_n')} AS pairs, {_n('matched')} AS matched, {_n('single')} AS single, {_n('ties')} AS ties, {_r('p50')} AS p50, {_r('p95')} AS p95, {_r('largest')} AS largest, {_n('matched - coalesce(lag(matched) OVER (ORDER BY lim), 0)')} AS gain FROM a")
def sp05_sensitivity(spark, d):
    return _sensitivity(spark, d).select("limit", "pairs", "matched", "single", "ties", r6("p50").alias("p50"), r6("p95").alias("p95"), r6("largest").alias("largest"), F.col("gain").cast("long").alias("gain"))


@query(f"WITH {PAIRS} SELECT CASE WHEN m <= 50 THEN 50 WHEN m < 50 + 1e-6 OR m <= 100 THEN 100 WHEN m <= 150 THEN 150 ELSE 200 END AS band, {_n('count(*)')} AS n FROM (SELECT event_id, min(distance) AS m FROM pairs GROUP BY event_id) GROUP BY 1")
def sp06_bands(spark, d):
    m = pairs(spark, d).groupBy("event_id").agg(F.min("distance").alias("m"))
    band = F.when(F.col("m") <= 50, 50).when(F.col("m") <= 100, 100).when(F.col("m") <= 150, 150).otherwise(200)
    return m.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT {_n('count(CASE WHEN distance = 0 THEN 1 END)')} AS zeros, {_n('count(CASE WHEN distance BETWEEN 395e-1 AND 405e-1 THEN 1 END)')} AS cluster FROM pairs")
def sp07_diagnostics(spark, d):
    return pairs(spark, d).agg(F.count_if(F.expr("distance = 0")).alias("zeros"), F.count_if(F.expr("distance between 39.5 and 40.5")).alias("cluster"))


_LON, _LAT = spatial.unproject_sql("cx + 1150000e0", "cy + 1850000e0")


@query(f"WITH s AS ({SEGMENTS}), l AS (SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len FROM s), f AS (SELECT unit_id, sum(len) AS length, sum(len * (x1 + x2) / 2) / sum(len) AS cx, sum(len * (y1 + y2) / 2) / sum(len) AS cy, min(least(y1, y2)) AS min_y, max(greatest(y1, y2)) AS max_y FROM l GROUP BY unit_id) SELECT unit_id, {_r('length')} AS length, {_r('cx')} AS cx, {_r('cy')} AS cy, min_y, max_y, round({_LON}, 9) AS lon, round({_LAT}, 9) AS lat FROM f")
def sp08_line_figures(spark, d):
    f = spatial.line_figures(segments(spark, d))
    return f.select("unit_id", r6("length").alias("length"), r6("cx").alias("cx"), r6("cy").alias("cy"), "min_y", "max_y", F.round(F.expr(_LON), 9).alias("lon"), F.round(F.expr(_LAT), 9).alias("lat"))


_SQUARES = "SELECT i * 5 + j AS poly_id, i * 2000e0 + 1e0 AS px, j * 2000e0 + 3e0 AS py, CASE WHEN i * 5 + j = 7 THEN -999e0 ELSE (i * 5 + j) / 24e0 END AS score FROM (VALUES (0), (1), (2), (3), (4)) AS a(i) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS b(j)"
_CLIP = f"""WITH s AS ({SEGMENTS}), q AS ({_SQUARES}), c AS (SELECT s.unit_id, q.poly_id, q.score, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len, greatest(0e0, (px - x1) / (x2 - x1), CASE WHEN y2 = y1 THEN CASE WHEN y1 >= py AND y1 < py + 2000 THEN 0e0 ELSE 9e0 END ELSE least((py - y1) / (y2 - y1), (py + 2000 - y1) / (y2 - y1)) END) AS a,
    least(1e0, (px + 2000 - x1) / (x2 - x1), CASE WHEN y2 = y1 THEN 1e0 ELSE greatest((py - y1) / (y2 - y1), (py + 2000 - y1) / (y2 - y1)) END) AS b FROM s CROSS JOIN q), o AS (SELECT unit_id, poly_id, score, sum(len * (b - a)) AS l FROM c WHERE b - a > 1e-12 GROUP BY unit_id, poly_id, score)"""


def _overlay(spark, d):
    q = run_sql(spark, d, _SQUARES)
    corner = [("px", "py", "px + 2000", "py"), ("px + 2000", "py", "px + 2000", "py + 2000"), ("px + 2000", "py + 2000", "px", "py + 2000"), ("px", "py + 2000", "px", "py")]
    edges = q.select("poly_id", F.explode(F.array(*[F.struct(*[F.expr(x).alias(n) for x, n in zip(c, ("ex1", "ey1", "ex2", "ey2"), strict=True)]) for c in corner])).alias("e")).select("poly_id", "e.*")
    return spatial.overlay_lengths(segments(spark, d), edges, 2000.0).join(F.broadcast(q.select("poly_id", "score")), "poly_id")


_WEIGHTED, _HIGH = "sum(CASE WHEN score >= 0 THEN l * score END) / sum(CASE WHEN score >= 0 THEN l END)", "coalesce(sum(CASE WHEN score >= 75e-2 THEN l END), 0) / max(t.len)"


@query(f"""{_CLIP}, t AS (SELECT unit_id, sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))) AS len FROM s GROUP BY unit_id) SELECT o.unit_id, {_r(_WEIGHTED)} AS weighted, {_r(_HIGH)} AS high_share, {_r('sum(l) / max(t.len) * 100')} AS coverage_pct,
    coalesce(round({_WEIGHTED}, 9) >= 75e-2, FALSE) AS high_by_weight, round({_HIGH}, 9) >= 5e-1 AS high_by_share FROM o JOIN t ON o.unit_id = t.unit_id GROUP BY o.unit_id""")
def sp09_overlay_score(spark, d):
    o = spatial.overlay_scores(_overlay(spark, d), spatial.line_figures(segments(spark, d)), "score")
    return o.select("unit_id", r6("weighted").alias("weighted"), r6("high_share").alias("high_share"), r6("coverage_pct").alias("coverage_pct"), "high_by_weight", "high_by_share")


@query(f"WITH s AS ({SEGMENTS}) SELECT CAST(unit_id AS STRING) || '-' || CAST(part AS STRING) || '-' || CAST(seq AS STRING) AS id, 0 AS seq, x1 AS x, y1 AS y FROM s UNION ALL SELECT CAST(unit_id AS STRING) || '-' || CAST(part AS STRING) || '-' || CAST(seq AS STRING), 1, x2, y2 FROM s")
def sp10_wkt(spark, d):
    s = segments(spark, d).withColumn("id", F.concat_ws("-", "unit_id", "part", "seq"))
    v = s.select("id", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v")).select("id", "v.*")
    return spatial.parse_wkt(spatial.emit_wkt(v, "id"), "wkt", "id")


# lengths from zero on, pairs of parallel edges (of which one is as long or longer), edges from a node to itself
EDGES = """SELECT CAST(s % 5 AS INT) AS grp, 'P' || CAST(p AS STRING) AS src, 'S' || CAST(s AS STRING) AS dst, w AS weight, 'E' || CAST(p AS STRING) || '-' || CAST(s AS STRING) AS edge_id FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, (l_partkey * 31 + l_suppkey * 17) % 100 AS w FROM lineitem)
    UNION ALL SELECT DISTINCT CAST(l_suppkey % 5 AS INT), 'P' || CAST(l_partkey AS STRING), 'S' || CAST(l_suppkey AS STRING), (l_partkey * 31 + l_suppkey * 17) % 100 + l_partkey % 2, 'D' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) FROM lineitem WHERE l_partkey % 7 = 0
    UNION ALL SELECT DISTINCT CAST(l_suppkey % 5 AS INT), 'S' || CAST(l_suppkey AS STRING), 'S' || CAST(l_suppkey AS STRING), CAST(0 AS BIGINT), 'L' || CAST(l_suppkey AS STRING) FROM lineitem"""


# what the operators read: they take the least of parallel edges, so only loops, some edges to many rows, are made distinct before
LINKS = EDGES.replace("DISTINCT ", "", 2)
ENDS = "SELECT DISTINCT CAST(l_suppkey % 5 AS INT) AS grp, 'S' || CAST(l_suppkey AS STRING) AS dst FROM lineitem"


def _paths(spark, d):
    return graph.shortest_paths(run_sql(spark, d, LINKS), run_sql(spark, d, ENDS).groupBy("grp").agg(F.min("dst").alias("node")), named=False)


# recursion by key is the oracle's; the operators relax and propagate in joins. A cost is a distance and, in its last digits, the number of edges
_TWO = f"""e AS MATERIALIZED ({EDGES}), two AS MATERIALIZED (SELECT grp, src, dst, min(weight) AS weight, arg_min(edge_id, (weight, edge_id)) AS edge_id FROM (SELECT grp, src, dst, weight, edge_id FROM e WHERE src <> dst UNION ALL SELECT grp, dst, src, weight, edge_id FROM e WHERE src <> dst) GROUP BY grp, src, dst)"""
_STEP = "t.weight * 1000000 + 1"
_SP = f"""WITH RECURSIVE {_TWO}, sp(grp, node, cost) USING KEY (grp, node) AS (SELECT grp, min(dst), CAST(0 AS BIGINT) FROM e GROUP BY grp UNION SELECT t.grp, t.dst, min(c.cost + {_STEP}) FROM sp c JOIN two t ON t.grp = c.grp AND t.src = c.node
    LEFT JOIN recurring.sp o ON o.grp = t.grp AND o.node = t.dst WHERE o.cost IS NULL OR c.cost + {_STEP} < o.cost GROUP BY t.grp, t.dst)"""


@query(f"{_SP} SELECT grp, node, cost // 1000000 AS distance, cost % 1000000 AS hops FROM sp")
def sp11_shortest_paths(spark, d):
    return _paths(spark, d).select("grp", "node", "distance", F.col("hops").cast("long").alias("hops"))


@query(f"""WITH RECURSIVE {_TWO}, cc(grp, node, component) USING KEY (grp, node) AS (SELECT grp, src, min(least(src, dst)) FROM two GROUP BY grp, src UNION SELECT t.grp, t.dst, min(c.component) FROM cc c JOIN two t ON t.grp = c.grp AND t.src = c.node
    JOIN recurring.cc o ON o.grp = t.grp AND o.node = t.dst WHERE c.component < o.component GROUP BY t.grp, t.dst) SELECT grp, node, component FROM cc""")
def sp12_components(spark, d):
    return graph.connected_components(run_sql(spark, d, LINKS))


@query(f"WITH e AS ({EDGES}), n AS (SELECT DISTINCT grp, src AS node FROM e UNION SELECT DISTINCT grp, dst FROM e) SELECT a.grp AS main, b.grp AS \"cross\", a.node FROM n a JOIN n b ON a.node = b.node AND a.grp < b.grp")
def sp13_boundary_nodes(spark, d):
    edges = run_sql(spark, d, EDGES)
    groups = edges.select("grp").distinct()
    pairs = groups.select(F.col("grp").alias("main")).join(groups.select(F.col("grp").alias("cross")), F.col("main") < F.col("cross"))  # five groups
    return graph.shared_nodes(edges, pairs)


_STREETS = f"SELECT unit_id AS grp, CAST(unit_id AS STRING) || '-' || CAST(part AS STRING) || '-' || CAST(seq AS STRING) AS sid, CAST(x1 AS STRING) || ':' || CAST(y1 AS STRING) AS src, CAST(x2 AS STRING) || ':' || CAST(y2 AS STRING) AS dst, x1, y1, x2, y2 FROM ({SEGMENTS}) s"
_P = lambda p, x, y: f"greatest(0e0, least(1e0, (({x} - {p}.x1) * ({p}.x2 - {p}.x1) + ({y} - {p}.y1) * ({p}.y2 - {p}.y1)) / (power({p}.x2 - {p}.x1, 2) + power({p}.y2 - {p}.y1, 2))))"
_AT = lambda p, x, y: f"sqrt(power({p}.x1 + {_P(p, x, y)} * ({p}.x2 - {p}.x1) - {x}, 2) + power({p}.y1 + {_P(p, x, y)} * ({p}.y2 - {p}.y1) - {y}, 2))"
_APART = "least(" + ", ".join(_AT(p, f"{q}.x{k}", f"{q}.y{k}") for p, q in (("b", "a"), ("a", "b")) for k in (1, 2)) + ")"


@query(f"""WITH st AS ({_STREETS}), pr AS (SELECT a.n_nationkey AS main, b.n_nationkey AS crs FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1), d AS (SELECT main, crs, a.sid, a.src, a.dst, min({_APART}) AS dist FROM pr JOIN st a ON a.grp = main JOIN st b ON b.grp = crs GROUP BY main, crs, a.sid, a.src, a.dst),
    k AS (SELECT *, min(dist) OVER (PARTITION BY main, crs) AS least_d, row_number() OVER (PARTITION BY main, crs ORDER BY round(dist, 9), sid) AS rn FROM d WHERE dist <= 200), z AS (SELECT * FROM k WHERE rn <= 5 AND round(dist - least_d, 9) <= 50)
    SELECT main, crs AS "cross", node, TRUE AS by_proximity, {_r('min(least_d)')} AS distance FROM (SELECT main, crs, src AS node, least_d FROM z UNION ALL SELECT main, crs, dst, least_d FROM z) GROUP BY main, crs, node""")
def sp13_proximity_nodes(spark, d):
    """Neighbouring streets without a common node: the ends of their nearest segments."""
    pairs = run_sql(spark, d, "SELECT a.n_nationkey AS main, b.n_nationkey AS crs FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1").withColumnRenamed("crs", "cross")
    return graph.boundary_nodes(run_sql(spark, d, _STREETS), pairs).withColumn("distance", r6("distance"))


@query(f"WITH p AS (SELECT unit_id, part, sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))) AS l FROM ({SEGMENTS}) s GROUP BY unit_id, part) SELECT unit_id, {_n('count(*)')} AS parts, {_r('avg(l)')} AS length, {_r('sum(l)')} AS linework FROM p GROUP BY unit_id")
def sp14_carriageways(spark, d):
    return spatial.carriageway_lengths(segments(spark, d)).select("unit_id", "parts", r6("length").alias("length"), r6("linework").alias("linework"))


_WALK = f"""{_SP}, par AS (SELECT s.grp, s.node, min(t.src) AS parent, arg_min(t.edge_id, t.src) AS edge FROM sp s JOIN two t ON t.grp = s.grp AND t.dst = s.node JOIN sp q ON q.grp = t.grp AND q.node = t.src WHERE s.cost > 0 AND q.cost + {_STEP} = s.cost GROUP BY s.grp, s.node),
    walk AS (SELECT grp, max(dst) AS target, max(dst) AS node, max(dst) AS nodes, '' AS edges, 0 AS back FROM e GROUP BY grp UNION ALL SELECT w.grp, w.target, p.parent, p.parent || '>' || w.nodes, p.edge || CASE WHEN w.edges = '' THEN '' ELSE '>' || w.edges END, back + 1 FROM walk w JOIN par p ON p.grp = w.grp AND p.node = w.node)"""


def _routes(spark, d):
    return graph.routes(_paths(spark, d), run_sql(spark, d, ENDS).groupBy("grp").agg(F.max("dst").alias("node")), run_sql(spark, d, LINKS), "edge_id")


@query(f"{_WALK} SELECT w.grp, w.target, w.node AS start, w.nodes, w.edges, s.cost // 1000000 AS length FROM walk w JOIN sp s ON s.grp = w.grp AND s.node = w.target JOIN sp z ON z.grp = w.grp AND z.node = w.node WHERE z.cost = 0")
def sp14_routes(spark, d):
    return _routes(spark, d).select("grp", "target", "start", "nodes", "edges", "length")


@query(f"{_WALK} SELECT w.grp, w.target, s.cost % 1000000 - w.back AS seq, p.edge, p.parent AS from_node, w.node AS to_node, z.weight FROM walk w JOIN sp s ON s.grp = w.grp AND s.node = w.target JOIN par p ON p.grp = w.grp AND p.node = w.node JOIN two z ON z.grp = w.grp AND z.src = p.parent AND z.dst = w.node")
def sp14_route_segments(spark, d):
    """The segments of every route, in order, with the node where each begins and ends."""
    s = graph.route_segments(_routes(spark, d), run_sql(spark, d, LINKS), "edge_id")
    return s.select("grp", "target", (F.col("seq") + 1).cast("long").alias("seq"), "edge", "from_node", "to_node", "weight")


@query("SELECT n_nationkey AS unit_id, lpad(CAST(n_nationkey AS STRING), 11, '0') AS fips, r_name FROM nation JOIN region ON lpad(CAST(n_regionkey AS STRING), 11, '0') = lpad(CAST(r_regionkey AS STRING), 11, '0')")
def sp15_padded_join(spark, d):
    n = run_sql(spark, d, "SELECT n_nationkey, n_regionkey FROM nation").withColumn("k", F.lpad(F.col("n_regionkey").cast("string"), 11, "0"))
    r = run_sql(spark, d, "SELECT r_regionkey, r_name FROM region").withColumn("k", F.lpad(F.col("r_regionkey").cast("string"), 11, "0"))
    return n.join(r, "k").select(F.col("n_nationkey").alias("unit_id"), F.lpad(F.col("n_nationkey").cast("string"), 11, "0").alias("fips"), "r_name")


_MEAN_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"


@query(f"""WITH {PAIRS}, c AS (SELECT unit_id, count(CASE WHEN distance <= 50 THEN 1 END) AS n50, count(CASE WHEN distance <= 100 THEN 1 END) AS n100 FROM pairs GROUP BY unit_id), k AS (SELECT *, {_MEAN_RANK.format(c='n50')} AS a, {_MEAN_RANK.format(c='n100')} AS b FROM c)
    SELECT unit_id, {_n('rank() OVER (ORDER BY n50 DESC) - rank() OVER (ORDER BY n100 DESC)')} AS rank_change, {_r('(n50 - n100) / CAST(n100 AS DOUBLE) * 100')} AS change_pct, (SELECT {_r('corr(a, b)')} FROM k) AS spearman FROM c""")
def sp16_rank_stability(spark, d):
    c = cut_lineage(pairs(spark, d).groupBy("unit_id").agg(F.count_if(F.expr("distance <= 50")).alias("n50"), F.count_if(F.expr("distance <= 100")).alias("n100")), "ranks")
    every = panel.spearman(c, "n50", "n100").select(r6("spearman").alias("spearman"))
    r = order.with_ranks(c, [], {"a": "n50", "b": "n100"})
    return r.select("unit_id", (F.col("a_down") - F.col("b_down")).alias("rank_change"), r6((F.col("n50") - F.col("n100")) / F.col("n100") * 100).alias("change_pct")).crossJoin(F.broadcast(every))


@query(f"WITH {PAIRS}, m AS (SELECT event_id, min(distance) AS dmin FROM pairs GROUP BY event_id), b AS (SELECT event_id, CAST(ceil(dmin / 50) AS BIGINT) AS band FROM m WHERE dmin > 0) SELECT band, event_id FROM (SELECT band, event_id, row_number() OVER (PARTITION BY band ORDER BY event_id) AS rn FROM b) WHERE rn <= 25")
def fi05_borderline_sample(spark, d):
    from pyspark.sql import Window as W

    b = pairs(spark, d).groupBy("event_id").agg(F.min("distance").alias("dmin")).filter("dmin > 0").select("event_id", F.ceil(F.col("dmin") / 50).cast("long").alias("band"))
    return b.withColumn("rn", F.row_number().over(W.partitionBy("band").orderBy("event_id"))).filter("rn <= 25").select("band", "event_id")


@query(f"SELECT unit_id, {_r('quantile_cont(total, 0.5)')} AS p50, {_r('quantile_cont(total, 0.95)')} AS p95, max(total) AS largest FROM panel GROUP BY unit_id")
def ag22_percentiles(spark, d):
    p = view(spark, d, "panel")
    largest = p.groupBy("unit_id").agg(F.max("total").alias("largest"))
    return order.percentiles(p, ["unit_id"], "total", {"p50": 0.5, "p95": 0.95}).join(largest, "unit_id").select("unit_id", r6("p50").alias("p50"), r6("p95").alias("p95"), "largest")


# gates on the spatial and schema operators
def _gate_sql(with_: str, view: str, checks: dict[str, tuple[str, str]]) -> str:
    cols = ", ".join(f"{_n(f'coalesce({sql}, 0)')} AS c{k}" for k, (_, sql) in enumerate(checks.values()))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS check_name, '{sev}' AS severity, c{k} = 0 AS passed, c{k} AS evidence FROM agg" for k, (n, (sev, _)) in enumerate(checks.items()))
    return f"WITH {with_}, agg AS (SELECT {cols} FROM {view}), rows AS ({rows}) SELECT check_name, severity, passed, evidence, (SELECT CASE WHEN count(CASE WHEN severity = 'CRITICAL' AND NOT passed THEN 1 END) > 0 THEN 'FAIL' WHEN count(CASE WHEN NOT passed THEN 1 END) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END FROM rows) AS status FROM rows"


def _count(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


def _rules(checks: dict[str, tuple[str, str]]) -> dict:
    return {n: (s, bad(c)) for n, (s, c) in checks.items()}


_STATUSES = "('primary_assigned', 'unresolved_tie', 'outside_selected_threshold', 'no_valid_coordinates')"
_ASSIGNED = {
    "status_domain": ("CRITICAL", f"assignment_status NOT IN {_STATUSES}"), "unit_rule": ("CRITICAL", "(assignment_status = 'primary_assigned') <> (unit_id IS NOT NULL)"),
    "distance_bound": ("CRITICAL", "distance > 100 + 1e-6"), "distance_known": ("CRITICAL", "(candidate_count > 0) <> (distance IS NOT NULL)"), "outside": ("WARNING", "assignment_status = 'outside_selected_threshold'"),
}


@query(_gate_sql(f"{PAIRS}, a AS ({_ASSIGN_SQL}), q AS (SELECT a.*, (SELECT count(*) FROM events) AS every FROM a)", "q", {n: (s, _count(c)) for n, (s, c) in _ASSIGNED.items()} | {"one_row_a_point": ("CRITICAL", "max(every) - count(DISTINCT event_id)"), "four_way_sum": ("CRITICAL", f"max(every) - {_count(f'assignment_status IN {_STATUSES}')}")}))
def va05_assignments(spark, d):
    a = cut_lineage(assigned(spark, d), "assigned").crossJoin(F.broadcast(run_sql(spark, d, "SELECT count(*) AS every FROM events")))
    return gate(offences(a, _rules(_ASSIGNED) | {"one_row_a_point": ("CRITICAL", F.max("every") - F.count_distinct("event_id")), "four_way_sum": ("CRITICAL", F.max("every") - bad(f"assignment_status IN {_STATUSES}"))}))


_CANDIDATES = {"null_distance": ("CRITICAL", "distance IS NULL"), "distance_bound": ("CRITICAL", "distance < 0 OR distance > 200 + 1e-6")}


@query(f"""WITH r AS ({_gate_sql(f"{PAIRS}", "pairs", {n: (s, _count(c)) for n, (s, c) in _CANDIDATES.items()} | {"duplicate_pair": ("CRITICAL", "count(*) - count(DISTINCT CAST(event_id AS STRING) || '|' || CAST(unit_id AS STRING))")})}),
    m AS ({_gate_sql(_SENS[5:] + ", g AS (SELECT matched, lag(matched) OVER (ORDER BY lim) AS p, single, ties FROM a)", "g", {"monotonic": ("CRITICAL", _count("matched < coalesce(p, 0)")), "parts": ("CRITICAL", _count("single > matched OR ties > matched - single"))})})
    SELECT check_name, severity, passed, evidence, CASE WHEN (SELECT count(*) FROM (SELECT * FROM r UNION ALL SELECT * FROM m) WHERE NOT passed) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT * FROM r UNION ALL SELECT * FROM m)""")
def va06_monotonic(spark, d):
    p = cut_lineage(pairs(spark, d), "pairs")
    s = spatial.sensitivity(p, F.lit(1.0), LIMITS, 10.0)
    steps = {"monotonic": ("CRITICAL", bad("gain < 0")), "parts": ("CRITICAL", bad("single > matched or ties > matched - single"))}
    return gate(offences(p, _rules(_CANDIDATES) | {"duplicate_pair": ("CRITICAL", repeated("event_id", "unit_id"))}), offences(s, steps))


_AGAIN = ("kabco", "coordinate_status", "event_day", "lanes", "speed", "flag")


#: A second derivation in the oracle's own terms: a table of severities, date patterns, and masks from the last to the first.
_SECOND = """again AS (SELECT r.record_id, coalesce(m.c, 'U') AS kabco, CAST(coalesce(try_strptime(trim(r.event_date), '%m/%d/%Y'), try_strptime(trim(r.event_date), '%Y-%m-%dT%H:%M:%S.%g'), try_strptime(trim(r.event_date), '%Y-%m-%d')) AS DATE) AS event_day,
    CAST(regexp_extract(trim(r.lanes), '^(\\d+)(\\.0+)?$', 1) AS VARCHAR) AS lanes, try_cast(trim(r.speed) AS DOUBLE) AS speed, upper(nullif(trim(r.flag), '')) AS flag,
    CASE WHEN nullif(trim(r.lat), '') IS NULL THEN CASE WHEN nullif(trim(r.lon), '') IS NULL THEN 'missing_pair' ELSE 'incomplete_pair' END WHEN nullif(trim(r.lon), '') IS NULL THEN 'incomplete_pair' WHEN try_cast(r.lat AS DOUBLE) + try_cast(r.lon AS DOUBLE) IS NULL THEN 'non_numeric'
    WHEN abs(try_cast(r.lat AS DOUBLE) - 42) <= 1 AND abs(try_cast(r.lon AS DOUBLE) + 88) <= 1 THEN 'valid' ELSE 'out_of_range' END AS coordinate_status
    FROM raw r LEFT JOIN (VALUES ('FATAL', 'K'), ('INCAPACITATING INJURY', 'A'), ('NONINCAPACITATING INJURY', 'B'), ('REPORTED, NOT EVIDENT', 'C'), ('NO INDICATION OF INJURY', 'O')) m(t, c) ON m.t = upper(trim(r.injury))),
    j AS (SELECT c.*, a.kabco AS kabco_2, a.event_day AS event_day_2, try_cast(nullif(a.lanes, '') AS BIGINT) AS lanes_2, a.speed AS speed_2, a.flag AS flag_2, a.coordinate_status AS coordinate_status_2 FROM clean c FULL JOIN again a ON a.record_id = c.record_id)"""


@query(_gate_sql(_SECOND, "j", {f"{c}_differs": ("CRITICAL", f"count(CASE WHEN {c} IS DISTINCT FROM {c}_2 THEN 1 END)") for c in _AGAIN} | {"event_year_differs": ("CRITICAL", "count(CASE WHEN year(event_day) IS DISTINCT FROM year(event_day_2) THEN 1 END)"), "month_start_differs": ("CRITICAL", "count(CASE WHEN date_trunc('month', event_day) IS DISTINCT FROM date_trunc('month', event_day_2) THEN 1 END)"), "rows_lost": ("CRITICAL", "(SELECT count(*) FROM raw) - count(record_id)")}))
def va07_rederivation(spark, d):
    """Every derived column is derived again, by the statement, from the stored source columns."""
    again = view(spark, d, "clean").select("record_id", *[F.col(c).alias(f"{c}_2") for c in _AGAIN])
    j = clean.clean_rows(view(spark, d, "raw")).join(again, "record_id", "full_outer")
    differs = lambda a, b: ("CRITICAL", bad(~F.col(a).eqNullSafe(b)))
    checks = {f"{c}_differs": differs(c, F.col(f"{c}_2")) for c in _AGAIN} | {"event_year_differs": differs("event_year", F.year("event_day_2")), "month_start_differs": differs("month_start", F.trunc("event_day_2", "month"))}
    n = run_sql(spark, d, "SELECT count(*) AS n FROM raw")
    return gate(offences(j.crossJoin(F.broadcast(n)), checks | {"rows_lost": ("CRITICAL", F.abs(F.max("n") - F.count("*")))}))


@query()
def va09_schema(spark, d):
    expected = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    return snapshot.schema_rows(spark.read.parquet(f"{d}/orders.parquet"), expected)


_SNAPSHOT = {"null_key": ("CRITICAL", "event_id IS NULL"), "outside_window": ("CRITICAL", "ts < TIMESTAMP '1995-01-01 00:00:00' OR ts >= TIMESTAMP '2001-09-01 00:00:00'"), "severity_unknown": ("WARNING", "severity NOT IN ('K', 'A', 'B', 'C', 'O')")}


@query(f"""WITH r AS ({_gate_sql('x AS (SELECT 1 AS one)', 'ev', {n: (s, _count(c)) for n, (s, c) in _SNAPSHOT.items()} | {'duplicate_key': ('CRITICAL', 'count(*) - count(DISTINCT event_id)')})}), c AS ({_gate_sql('x AS (SELECT 1 AS one)', 'clean', {'coordinates': ('WARNING', _count("coordinate_status <> 'valid'"))})}),
    m AS (SELECT 'manifest_parts' AS check_name, 'CRITICAL' AS severity, TRUE AS passed, CAST(0 AS BIGINT) AS evidence, '' AS status), u AS (SELECT * FROM r UNION ALL SELECT * FROM c UNION ALL SELECT * FROM m)
    SELECT check_name, severity, passed, evidence, (SELECT CASE WHEN count(CASE WHEN severity = 'CRITICAL' AND NOT passed THEN 1 END) > 0 THEN 'FAIL' WHEN count(CASE WHEN NOT passed THEN 1 END) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END FROM u) AS status FROM u""")
def va12_snapshot_report(spark, d):
    """Keys, window, severities and coordinates of the events, and the parts of their snapshot against its manifest."""
    parts = snapshot.audit_parts(spark, _published(spark, d, "gzip"))
    return gate(
        offences(view(spark, d, "ev"), _rules(_SNAPSHOT) | {"duplicate_key": ("CRITICAL", repeated("event_id"))}), offences(view(spark, d, "clean"), {"coordinates": ("WARNING", bad("coordinate_status <> 'valid'"))}),
        offences(parts, {"manifest_parts": ("CRITICAL", bad("not (size_ok and sha_ok and parts_ok) or expected_rows <> found_rows"))}),
    )


_LINES = {"missing": ("CRITICAL", "length IS NULL"), "length_range": ("CRITICAL", "length < 9000 OR length > 21000"), "multipart": ("CRITICAL", "(parts > 1) <> (unit_id = 24)"), "many_parts": ("CRITICAL", "parts > 2")}


@query(_gate_sql(f"p AS (SELECT unit_id, part, sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))) AS l FROM ({SEGMENTS}) s GROUP BY unit_id, part), f AS (SELECT unit_id, count(*) AS parts, avg(l) AS length FROM p GROUP BY unit_id), q AS (SELECT n_nationkey AS unit_id, f.parts, f.length, 15e0 AS boundary FROM nation LEFT JOIN f ON f.unit_id = n_nationkey)", "q", {n: (s, _count(c)) for n, (s, c) in _LINES.items()} | {"duplicate_id": ("CRITICAL", "count(*) - count(DISTINCT unit_id)"), "boundary": ("CRITICAL", _count("boundary > 200"))}))
def va22_geometry(spark, d):
    """Lines present, unique, plausible in length, multipart only where it is allowed, boundaries by proximity within 200 feet."""
    lines = run_sql(spark, d, "SELECT n_nationkey AS unit_id FROM nation").join(spatial.carriageway_lengths(segments(spark, d)), "unit_id", "left")
    return gate(offences(lines, _rules(_LINES) | {"duplicate_id": ("CRITICAL", repeated("unit_id"))}), offences(sp13_proximity_nodes(spark, d), {"boundary": ("CRITICAL", bad("distance > 200"))}))


@query("WITH a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, max(CASE WHEN l_suppkey <= 0 THEN 1 ELSE 0 END) AS bad, bool_and(l_suppkey <= 100000) AS ok FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CAST(n AS BIGINT) AS used, bad = 0 AS none_bad, ok AS all_allowed, TRUE AS count_ok, (SELECT CAST(sum(n) AS BIGINT) FROM a) = (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) AS total_ok FROM a")
def va23_array_rules(spark, d):
    ids = run_sql(spark, d, "SELECT l_orderkey, l_suppkey FROM lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    # the stored counts come from another route: distinct pairs, counted
    pairs = run_sql(spark, d, "SELECT l_orderkey AS k, count(*) AS stored FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) p GROUP BY l_orderkey")
    every = pairs.agg(F.sum("stored").alias("every")).crossJoin(ids.agg(F.sum(F.size("ids")).alias("held"))).select((F.col("every") == F.col("held")).alias("total_ok"))
    ids = ids.join(pairs, F.col("l_orderkey") == F.col("k"), "left").crossJoin(F.broadcast(every))
    allowed = F.forall("ids", lambda x: x <= 100000)
    return ids.select("total_ok", F.coalesce(F.col("stored") == F.size("ids"), F.lit(False)).alias("count_ok"), "l_orderkey", F.size("ids").cast("long").alias("used"), (~F.arrays_overlap("ids", F.array(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")))).alias("none_bad"), allowed.alias("all_allowed"))
