"""Stand-in views: the star-schema tables seen as units, events, children, points and scenarios.

Each view is one statement in SQL that Spark and other engines read alike; operators take column names as parameters and know nothing of these.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.functions.storage import delete, exists, scratch_path, version

TABLES = "region nation customer supplier part orders lineitem events".split()


def _forecast(steps: int = 12) -> str:
    fold = "".join(
        f", s{k} AS (SELECT unit_id, f, list_append(ht, list_sum(ht[-12:]) / 12) AS ht, list_append(hr, list_sum(hk[-12:]) / 12) AS hr, list_append(hk, least(f * list_sum(hk[-12:]) / 12, list_sum(ht[-12:]) / 12)) AS hk FROM s{k - 1})"
        for k in range(1, steps + 1)
    )
    return f"""WITH c AS (SELECT sum(actual) / sum(predicted) AS f FROM pred WHERE model_split = 'validation' AND target = 'ksi' AND model = 'rolling_mean12'),
        s0 AS (SELECT unit_id, max(f) AS f, list(CAST(total AS DOUBLE) ORDER BY month_start) AS ht, list(CAST(ksi AS DOUBLE) ORDER BY month_start) AS hk, CAST([] AS DOUBLE[]) AS hr FROM panel CROSS JOIN c GROUP BY unit_id){fold}
        SELECT unit_id, CAST(k AS INT) AS step, ht[len(ht) - {steps} + k] AS total, hr[k] AS raw, f AS factor, hk[len(hk) - {steps} + k] AS ksi FROM s{steps} CROSS JOIN generate_series(1, {steps}) AS g(k)"""


VIEWS: dict[str, str] = {
    "ev": """SELECT o.o_orderkey AS event_id, c.c_nationkey AS unit_id, o.o_orderdate AS ts, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month_start,
        CAST(year(o.o_orderdate) AS INT) AS yr, CAST(month(o.o_orderdate) AS INT) AS mon, substr('KABCO', CAST(substr(o.o_orderpriority, 1, 1) AS INT), 1) AS severity,
        c.c_mktsegment AS segment, o.o_orderstatus AS status FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "child": """SELECT l.l_orderkey * 10 + l.l_linenumber AS child_id, CASE WHEN l.l_orderkey % 101 = 0 THEN -l.l_orderkey - 1 ELSE l.l_orderkey END AS parent_id, l.l_linenumber AS line_no,
        CAST(l.l_quantity AS BIGINT) AS quantity, CAST(CASE WHEN l.l_orderkey % 53 = 0 THEN o.o_orderdate + INTERVAL '1' DAY ELSE o.o_orderdate END AS DATE) AS child_date
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    # the oracle's text; MARTS has Spark's
    "clock": """SELECT event_id, dayofweek(ts) + 1 AS day_of_week, date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) % 7 + 1 AS weekday_again, hour(ts) AS hour_of_day, CAST(severity = 'K' AS INT) AS k, CAST(severity = 'A' AS INT) AS a, CAST(severity = 'B' AS INT) AS b,
        CAST(severity = 'C' AS INT) AS c, CAST(severity = 'O' AS INT) AS o, CAST(severity NOT IN ('K', 'A', 'B', 'C', 'O') AS INT) AS u, 1 AS n FROM ev""",
    "units": """SELECT n.n_nationkey AS unit_id, n.n_name AS unit_name, r.r_name AS grp, CAST(15840 + 300 * n.n_nationkey AS DOUBLE) AS length_feet,
        CAST(15840 + 300 * n.n_nationkey AS DOUBLE) / 5280 AS length_miles, n.n_nationkey % 3 = 0 AS priority_area FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "register": """SELECT unit_id, unit_name, upper(unit_name) || ' ROUTE' AS alias, CASE WHEN unit_id % 7 = 3 THEN 'provisional' WHEN unit_id % 11 = 5 THEN 'retired' ELSE 'confirmed' END AS status, CASE WHEN unit_id % 7 = 3 THEN 0.4e0 ELSE 0.7e0 + (unit_id % 3) / 10e0 END AS confidence FROM units""",
    # every month from the first event to the last
    "months": """SELECT month_start, yr, mon, CAST(floor((mon + 2) / 3) AS INT) AS qtr FROM (SELECT make_date(CAST(b.y0 + 10 * t.d + u.d AS INT), m.m, 1) AS month_start, CAST(b.y0 + 10 * t.d + u.d AS INT) AS yr, m.m AS mon, b.lo, b.hi
        FROM (SELECT min(month_start) AS lo, max(month_start) AS hi, min(yr) AS y0 FROM ev) b CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS t(d) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS u(d)
        CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS m(m)) WHERE month_start BETWEEN lo AND hi""",
    "span": "SELECT count(*) AS months, count(*) / 12e0 AS years FROM months",
    "counts": """SELECT unit_id, month_start, sum(CASE WHEN severity = 'K' THEN 1 ELSE 0 END) AS k, sum(CASE WHEN severity = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN severity = 'B' THEN 1 ELSE 0 END) AS b,
        sum(CASE WHEN severity = 'C' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN severity = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN severity NOT IN ('K', 'A', 'B', 'C', 'O') THEN 1 ELSE 0 END) AS u, count(*) AS total
        FROM ev GROUP BY unit_id, month_start""",
    "panel": """SELECT u.unit_id, u.unit_name, u.grp, u.length_feet, u.length_miles, m.month_start, m.yr, m.mon, m.qtr,
        CAST(coalesce(c.k, 0) AS BIGINT) AS k, CAST(coalesce(c.a, 0) AS BIGINT) AS a, CAST(coalesce(c.b, 0) AS BIGINT) AS b, CAST(coalesce(c.c, 0) AS BIGINT) AS c, CAST(coalesce(c.o, 0) AS BIGINT) AS o,
        CAST(coalesce(c.u, 0) AS BIGINT) AS u, CAST(coalesce(c.total, 0) AS BIGINT) AS total, CAST(coalesce(c.k + c.a, 0) AS BIGINT) AS ksi
        FROM units u CROSS JOIN months m LEFT JOIN counts c ON u.unit_id = c.unit_id AND m.month_start = c.month_start""",
    "feat": """SELECT *, CASE WHEN yr = 1995 THEN 'warmup' WHEN yr <= 1999 THEN 'train' WHEN yr = 2000 THEN 'validation' WHEN yr = 2001 THEN 'test' ELSE 'unknown' END AS model_split,
        row_number() OVER w - 1 AS history, row_number() OVER w > 12 AS model_ready, lag(total, 1) OVER w AS total_lag1, lag(total, 3) OVER w AS total_lag3, lag(total, 6) OVER w AS total_lag6, lag(total, 12) OVER w AS total_lag12,
        lag(ksi, 1) OVER w AS ksi_lag1, lag(ksi, 12) OVER w AS ksi_lag12,
        CASE WHEN row_number() OVER w > 3 THEN avg(total) OVER w3 END AS total_mean3, CASE WHEN row_number() OVER w > 12 THEN avg(total) OVER w12 END AS total_mean12,
        CASE WHEN row_number() OVER w > 12 THEN avg(ksi) OVER w12 END AS ksi_mean12, CASE WHEN row_number() OVER w > 12 THEN CAST(sum(total) OVER w12 AS BIGINT) END AS total_sum12
        FROM panel WINDOW w AS (PARTITION BY unit_id ORDER BY month_start), w3 AS (PARTITION BY unit_id ORDER BY month_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
        w12 AS (PARTITION BY unit_id ORDER BY month_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "pred": """SELECT unit_id, month_start, model_split, target, model, CAST(actual AS DOUBLE) AS actual, greatest(0e0, coalesce(predicted, 0e0)) AS predicted FROM (
        SELECT unit_id, month_start, model_split, 'total' AS target, 'seasonal_naive' AS model, total AS actual, CAST(total_lag12 AS DOUBLE) AS predicted FROM feat
        UNION ALL SELECT unit_id, month_start, model_split, 'total', 'rolling_mean12', total, total_mean12 FROM feat
        UNION ALL SELECT unit_id, month_start, model_split, 'ksi', 'seasonal_naive', ksi, CAST(ksi_lag12 AS DOUBLE) FROM feat
        UNION ALL SELECT unit_id, month_start, model_split, 'ksi', 'rolling_mean12', ksi, ksi_mean12 FROM feat) WHERE model_split IN ('train', 'validation', 'test')""",
    "metric": """SELECT target, model, model_split, count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
        avg(2 * (CASE WHEN actual > 0 THEN actual * ln(actual / greatest(predicted, 1e-6)) ELSE 0e0 END - actual + greatest(predicted, 1e-6))) AS deviance,
        avg(predicted - actual) AS bias, sum(predicted) / sum(actual) AS calibration FROM pred GROUP BY target, model, model_split""",
    "hist": """SELECT u.unit_id, u.unit_name, u.grp, u.length_miles, u.priority_area, CAST(sum(p.k) AS BIGINT) AS k, CAST(sum(p.a) AS BIGINT) AS a, CAST(sum(p.b) AS BIGINT) AS b, CAST(sum(p.c) AS BIGINT) AS c,
        CAST(sum(p.o) AS BIGINT) AS o, CAST(sum(p.u) AS BIGINT) AS u, CAST(sum(p.total) AS BIGINT) AS total, CAST(sum(p.ksi) AS BIGINT) AS ksi
        FROM units u JOIN panel p ON u.unit_id = p.unit_id GROUP BY u.unit_id, u.unit_name, u.grp, u.length_miles, u.priority_area""",
    "subgroup": """SELECT unit_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN severity = 'K' THEN 1 ELSE 0 END) AS BIGINT) AS k, CAST(sum(CASE WHEN severity = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS a,
        CAST(sum(CASE WHEN severity = 'B' THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN severity = 'C' THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN severity = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o
        FROM ev WHERE segment = 'BUILDING' GROUP BY unit_id""",
    # fixed values: candidate treatments and their planning scenarios
    "treatment": """SELECT * FROM (VALUES
        ('T1', 'subgroup', 0.68e0, 0.035e0, 20, 'CONSERVATIVE', 0.25e0, 1e0, 18000e0), ('T1', 'subgroup', 0.68e0, 0.035e0, 20, 'BASE', 0.5e0, 2e0, 15000e0), ('T1', 'subgroup', 0.68e0, 0.035e0, 20, 'OPTIMISTIC', 0.75e0, 3e0, 12000e0),
        ('T2', 'total', 0.71e0, 0.026e0, 20, 'CONSERVATIVE', 0.5e0, 1e0, 480000e0), ('T2', 'total', 0.71e0, 0.026e0, 20, 'BASE', 0.75e0, 1e0, 400000e0), ('T2', 'total', 0.71e0, 0.026e0, 20, 'OPTIMISTIC', 1e0, 1e0, 320000e0),
        ('T4', 'subgroup', 0.53e0, 0.031e0, 10, 'CONSERVATIVE', 0.2e0, 1e0, 27000e0), ('T4', 'subgroup', 0.53e0, 0.031e0, 10, 'BASE', 0.4e0, 2e0, 22500e0), ('T4', 'subgroup', 0.53e0, 0.031e0, 10, 'OPTIMISTIC', 0.6e0, 4e0, 18000e0)
        ) AS t(treatment_id, target, cmf_point, cmf_se, life_years, scenario, exposure_share, density, unit_cost)""",
    # twelve steps ahead: means of the last twelve months, calibrated and capped for ksi and fed back. The text is the oracle's; MARTS has the operator.
    "forecast": _forecast(),
    "annual": "SELECT unit_id, sum(total) AS total_forecast, sum(ksi) AS ksi_forecast FROM forecast GROUP BY unit_id",
    "shares": """SELECT unit_id, k, a, b, c, o, u, total, ksi, w1 * CASE WHEN ksi > 0 THEN k / ksi ELSE pk END + (1 - w1) * pk AS share_k, 1 - (w1 * CASE WHEN ksi > 0 THEN k / ksi ELSE pk END + (1 - w1) * pk) AS share_a,
        w2 * CASE WHEN non > 0 THEN b / non ELSE pb END + (1 - w2) * pb AS share_b, w2 * CASE WHEN non > 0 THEN c / non ELSE pc END + (1 - w2) * pc AS share_c, w2 * CASE WHEN non > 0 THEN o / non ELSE po END + (1 - w2) * po AS share_o
        FROM (SELECT h.*, CAST(total - ksi AS DOUBLE) AS non, ksi / (ksi + 10e0) AS w1, (total - ksi) / (total - ksi + 50e0) AS w2, CAST(sum(k) OVER () AS DOUBLE) / sum(ksi) OVER () AS pk,
        CAST(sum(b) OVER () AS DOUBLE) / sum(total - ksi) OVER () AS pb, CAST(sum(c) OVER () AS DOUBLE) / sum(total - ksi) OVER () AS pc, CAST(sum(o) OVER () AS DOUBLE) / sum(total - ksi) OVER () AS po FROM hist h)""",
    "posterior": """SELECT h.unit_id, coalesce(s.n, 0) AS n_sub, h.total, (coalesce(s.n, 0) + p * 50e0) / (h.total + 50e0) AS sub_share, p AS pooled FROM hist h LEFT JOIN subgroup s ON h.unit_id = s.unit_id
        CROSS JOIN (SELECT CAST(sum(s2.n) AS DOUBLE) / (SELECT sum(total) FROM hist) AS p FROM subgroup s2)""",
    "benefit": """SELECT unit_id, unit_name, treatment_id, scenario, priority_area, exposure_share, cmf, life_years, averted, averted * p_ksi * share_k AS av_k, averted * p_ksi * share_a AS av_a, averted * (1 - p_ksi) * share_b AS av_b,
        averted * (1 - p_ksi) * share_c AS av_c, averted * (1 - p_ksi) * share_o AS av_o, quantity, cost,
        averted * (p_ksi * (share_k * 15988000e0 + share_a * 1705100e0) + (1 - p_ksi) * (share_b * 384000e0 + share_c * 204600e0 + share_o * 18100e0)) AS annual_benefit,
        averted * (p_ksi * (share_k * 15988000e0 + share_a * 1705100e0) + (1 - p_ksi) * (share_b * 384000e0 + share_c * 204600e0 + share_o * 18100e0)) * pv_factor AS pv,
        CASE WHEN treatment_id = 'T2' AND unit_id % 5 = 0 THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS applicability
        FROM (SELECT h.unit_id, h.unit_name, h.priority_area, t.treatment_id, t.scenario, t.exposure_share, t.life_years, s.share_k, s.share_a, s.share_b, s.share_c, s.share_o, s.ksi / CAST(s.total AS DOUBLE) AS p_ksi,
        (1 - power(1.03e0, -t.life_years)) / 0.03e0 AS pv_factor,
        CASE t.scenario WHEN 'CONSERVATIVE' THEN least(1e0, cmf_point + 1.96e0 * cmf_se) WHEN 'OPTIMISTIC' THEN greatest(0e0, cmf_point - 1.96e0 * cmf_se) ELSE cmf_point END AS cmf,
        CASE WHEN t.target = 'subgroup' THEN f.total_forecast * p.sub_share ELSE f.total_forecast END * t.exposure_share * (1 - CASE t.scenario WHEN 'CONSERVATIVE' THEN least(1e0, cmf_point + 1.96e0 * cmf_se)
        WHEN 'OPTIMISTIC' THEN greatest(0e0, cmf_point - 1.96e0 * cmf_se) ELSE cmf_point END) AS averted,
        CASE WHEN t.treatment_id = 'T2' THEN h.length_miles * t.exposure_share ELSE greatest(1e0, CAST(ceil(h.length_miles * t.density) AS DOUBLE)) END AS quantity,
        CASE WHEN t.treatment_id = 'T2' THEN h.length_miles * t.exposure_share ELSE greatest(1e0, CAST(ceil(h.length_miles * t.density) AS DOUBLE)) END * t.unit_cost AS cost
        FROM hist h JOIN shares s ON h.unit_id = s.unit_id JOIN annual f ON h.unit_id = f.unit_id JOIN posterior p ON h.unit_id = p.unit_id CROSS JOIN treatment t)""",
    "cand": "SELECT unit_id, treatment_id, scenario, priority_area, cost, pv, pv / cost AS bcr FROM benefit WHERE applicability <> 'NOT_APPLICABLE' AND pv / cost >= 1",
    "grid": """SELECT 'PORT_OFF_' || unc || '_B' || CAST(b AS STRING) || 'M_EQ' || CAST(e AS STRING) AS portfolio_id, 'OFFICIAL' AS run_group, unc, b * 1e6 AS budget, e / 100e0 AS floor_share
        FROM (VALUES ('CONSERVATIVE'), ('BASE'), ('OPTIMISTIC')) AS x(unc) CROSS JOIN (VALUES (15), (25), (40)) AS y(b) CROSS JOIN (VALUES (20), (30), (40)) AS z(e)
        UNION ALL SELECT 'PORT_STR_BASE_B' || CAST(b AS STRING) || 'M_EQ' || CAST(e AS STRING), 'STRESS', 'BASE', b * 1e6, e / 100e0 FROM (VALUES (2), (4), (6)) AS y(b) CROSS JOIN (VALUES (20), (30), (40)) AS z(e)
        UNION ALL SELECT 'PORT_GRID_BASE_B' || CAST(b AS STRING) || 'M_EQ' || CAST(e AS STRING), 'GRID', 'BASE', b * 1e6, e / 100e0
        FROM (VALUES (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25), (30), (40)) AS y(b)
        CROSS JOIN (VALUES (15), (20), (25), (30), (35), (40)) AS z(e)""",
    # budgeted selection; these texts are the oracle's, MARTS has the operator. Multipliers are shares of the largest benefit-cost ratio (l, m) and of the largest
    # benefit (v); each round takes the least bound of 27 points around the last one
    "dual": """WITH RECURSIVE z AS (SELECT scenario, max(pv / cost) AS r, max(pv) AS b FROM cand GROUP BY scenario),
        d AS (SELECT portfolio_id, 0 AS rnd, 0.3e0 AS l, 0.1e0 AS m, 0.1e0 AS v, 0.3e0 AS h, 0e0 AS bound FROM grid
        UNION ALL SELECT portfolio_id, rnd, l, m, v, h, bound FROM (SELECT portfolio_id, rnd + 1 AS rnd, l, m, v, h * 0.65e0 AS h, bound, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(bound, 2), j) AS rn FROM (
        SELECT portfolio_id, rnd, h, j, l, m, v, sum(best) + max(l * r * budget) AS bound FROM (SELECT t.portfolio_id, t.rnd, t.h, t.j, t.l, t.m, t.v, c.unit_id, any_value(z.r) AS r, any_value(g.budget) AS budget,
        greatest(0e0, max(c.pv - t.l * z.r * c.cost + t.m * z.r * c.cost * (CASE WHEN c.priority_area THEN 1e0 ELSE 0e0 END - g.floor_share) + t.v * z.b * (0.7e0 - CASE WHEN c.treatment_id = 'T2' THEN 1e0 ELSE 0e0 END))) AS best
        FROM (SELECT portfolio_id, rnd, h, x.s * 9 + y.s * 3 + w.s AS j, greatest(0e0, l + h * x.d) AS l, greatest(0e0, m + h * y.d) AS m, greatest(0e0, v + h * w.d) AS v FROM d CROSS JOIN (VALUES (0, 0e0), (1, -1e0), (2, 1e0)) AS x(s, d)
        CROSS JOIN (VALUES (0, 0e0), (1, -1e0), (2, 1e0)) AS y(s, d) CROSS JOIN (VALUES (0, 0e0), (1, -1e0), (2, 1e0)) AS w(s, d) WHERE rnd < 14) t
        JOIN grid g ON g.portfolio_id = t.portfolio_id JOIN z ON z.scenario = g.unc JOIN cand c ON c.scenario = g.unc GROUP BY t.portfolio_id, t.rnd, t.h, t.j, t.l, t.m, t.v, c.unit_id) GROUP BY portfolio_id, rnd, h, j, l, m, v)) WHERE rn = 1)
        SELECT d.portfolio_id, d.l * z.r AS l, d.m * z.r AS m, d.v * z.b AS v, d.bound, g.budget, g.floor_share, g.unc FROM d JOIN grid g ON g.portfolio_id = d.portfolio_id JOIN z ON z.scenario = g.unc WHERE d.rnd = 14""",
    # what every unit can take under those multipliers, units in order of what their best option is ahead of the second
    "opts": """WITH o AS (SELECT d.portfolio_id, c.unit_id, row_number() OVER (PARTITION BY d.portfolio_id, c.unit_id ORDER BY c.treatment_id) AS j, c.treatment_id, c.cost, c.pv, c.cost * (CASE WHEN c.priority_area THEN 1e0 ELSE 0e0 END - d.floor_share) AS gf,
        0.7e0 - CASE WHEN c.treatment_id = 'T2' THEN 1e0 ELSE 0e0 END AS gc, d.l, d.m, d.v FROM dual d JOIN cand c ON c.scenario = d.unc),
        a AS (SELECT portfolio_id, unit_id, j, treatment_id, cost, pv, gf, gc, pv - l * cost + m * gf + v * gc AS red FROM o UNION ALL SELECT DISTINCT portfolio_id, unit_id, 0, NULL, 0e0, 0e0, 0e0, 0e0, 0e0 FROM o),
        u AS (SELECT portfolio_id, unit_id, max(red) AS top, max(gf) AS best_f, max(gc) AS best_c, list_extract(list_reverse_sort(list(red)), 1) - list_extract(list_reverse_sort(list(red)), 2) AS margin FROM a GROUP BY portfolio_id, unit_id),
        k AS (SELECT portfolio_id, unit_id, top, row_number() OVER w AS k, coalesce(sum(best_f) OVER (PARTITION BY portfolio_id ORDER BY round(margin, 2) DESC, unit_id DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0e0) AS left_f,
        coalesce(sum(best_c) OVER (PARTITION BY portfolio_id ORDER BY round(margin, 2) DESC, unit_id DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0e0) AS left_c FROM u WINDOW w AS (PARTITION BY portfolio_id ORDER BY round(margin, 2) DESC, unit_id DESC))
        SELECT a.*, k.k, k.top, k.left_f, k.left_c FROM a JOIN k ON a.portfolio_id = k.portfolio_id AND a.unit_id = k.unit_id""",
    # partial selections, at most 1000 after each unit, by the bound of what they can come to
    "beam": """WITH RECURSIVE s AS (SELECT portfolio_id, 0 AS k, 0 AS rn, bound AS lag, 0e0 AS cost, 0e0 AS pv, 0e0 AS gf, 0e0 AS gc, budget, CAST([] AS INT[]) AS path FROM dual
        UNION ALL SELECT portfolio_id, k, rn, lag, cost, pv, gf, gc, budget, path FROM (SELECT s.portfolio_id, CAST(o.k AS INT) AS k, CAST(row_number() OVER (PARTITION BY s.portfolio_id ORDER BY round(s.lag - o.top + o.red, 2) DESC, s.rn, o.j) AS INT) AS rn,
        s.lag - o.top + o.red AS lag, s.cost + o.cost AS cost, s.pv + o.pv AS pv, s.gf + o.gf AS gf, s.gc + o.gc AS gc, s.budget, list_append(s.path, CAST(o.j AS INT)) AS path
        FROM s JOIN opts o ON o.portfolio_id = s.portfolio_id AND o.k = s.k + 1 WHERE s.cost + o.cost <= s.budget + 1e-6 AND s.gf + o.gf + o.left_f >= -1e-6 AND s.gc + o.gc + o.left_c >= -1e-9) WHERE rn <= 1000) SELECT * FROM s""",
    "found": """SELECT portfolio_id, pv, path FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(pv, 2) DESC, rn) AS place FROM (SELECT *, max(k) OVER (PARTITION BY portfolio_id) AS last FROM beam) WHERE k = last AND gf >= -1e-6 AND gc >= -1e-9)
        WHERE place = 1 AND len(path) = (SELECT max(k) FROM opts o WHERE o.portfolio_id = portfolio_id)""",
    "ceiling": """SELECT d.portfolio_id, least(d.bound, greatest(coalesce(f.pv, 0e0), coalesce(l.lost, 0e0))) AS upper_bound FROM dual d LEFT JOIN found f ON f.portfolio_id = d.portfolio_id
        LEFT JOIN (SELECT portfolio_id, max(least_lag) AS lost FROM (SELECT portfolio_id, k, min(lag) AS least_lag FROM beam GROUP BY portfolio_id, k HAVING count(*) = 1000) GROUP BY portfolio_id) l ON l.portfolio_id = d.portfolio_id""",
    "sel": """SELECT f.portfolio_id, g.run_group, g.unc, o.unit_id, o.treatment_id, o.cost, o.pv, c.priority_area, c.bcr FROM found f JOIN opts o ON o.portfolio_id = f.portfolio_id AND o.j = f.path[o.k] AND o.j > 0 JOIN grid g ON g.portfolio_id = f.portfolio_id
        JOIN cand c ON c.unit_id = o.unit_id AND c.treatment_id = o.treatment_id AND c.scenario = g.unc""",
    "summ": """SELECT g.portfolio_id, g.run_group, g.unc, g.budget, g.floor_share, CASE WHEN count(s.unit_id) = 0 THEN 'NO_FEASIBLE_POINT' ELSE 'FEASIBLE' END AS solver_status, count(s.unit_id) AS projects, coalesce(sum(s.cost), 0e0) AS cost,
        g.budget - coalesce(sum(s.cost), 0e0) AS slack, coalesce(sum(s.cost), 0e0) / g.budget * 100 AS utilization_pct, coalesce(sum(CASE WHEN s.priority_area THEN s.cost END), 0e0) AS priority_spend, coalesce(sum(s.pv), 0e0) AS pv,
        coalesce(sum(s.pv), 0e0) - coalesce(sum(s.cost), 0e0) AS npv, coalesce(sum(s.pv) / sum(s.cost), 0e0) AS bcr, coalesce(max(s.bcr), 0e0) AS max_bcr, count(CASE WHEN s.treatment_id = 'T2' THEN 1 END) AS capped
        FROM grid g LEFT JOIN sel s ON g.portfolio_id = s.portfolio_id GROUP BY g.portfolio_id, g.run_group, g.unc, g.budget, g.floor_share""",
    # raw text records with every kind of dirt
    "raw": """SELECT CAST(o_orderkey AS STRING) AS record_id, CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 19 = 0 THEN 'SEE NARRATIVE' WHEN o_orderkey % 23 = 0 THEN '  fatal ' ELSE
        CASE CAST(substr(o_orderpriority, 1, 1) AS INT) WHEN 1 THEN 'FATAL' WHEN 2 THEN 'INCAPACITATING INJURY' WHEN 3 THEN 'NONINCAPACITATING INJURY' WHEN 4 THEN 'REPORTED, NOT EVIDENT' ELSE 'NO INDICATION OF INJURY' END END AS injury,
        CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN 'not a date' WHEN o_orderkey % 5 = 0 THEN substr(CAST(o_orderdate AS STRING), 6, 2) || '/' || substr(CAST(o_orderdate AS STRING), 9, 2) || '/' || substr(CAST(o_orderdate AS STRING), 1, 4)
        WHEN o_orderkey % 5 = 1 THEN substr(CAST(o_orderdate AS STRING), 1, 10) || 'T08:30:00.000' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS event_date,
        CASE WHEN o_orderkey % 11 = 0 THEN '7.0' WHEN o_orderkey % 11 = 1 THEN '3.5' WHEN o_orderkey % 11 = 2 THEN 'x' WHEN o_orderkey % 11 = 3 THEN '' ELSE CAST(o_orderkey % 97 AS STRING) END AS lanes,
        CASE WHEN o_orderkey % 7 = 0 THEN 'bad' WHEN o_orderkey % 7 = 1 THEN NULL ELSE CAST(CAST(o_orderkey % 900 AS DOUBLE) / 8 AS STRING) END AS speed,
        CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' WHEN 2 THEN ' ' ELSE 'Q' END AS flag,
        CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '42.25' WHEN 2 THEN 'n/a' WHEN 3 THEN '-61.5' ELSE '42.5' END AS lat, CASE o_orderkey % 10 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE '-88.125' END AS lon,
        CASE o_orderkey % 5 WHEN 0 THEN ' N. Main  St. ' WHEN 1 THEN 'n main st' WHEN 2 THEN 'Martin L King Jr Dr' WHEN 3 THEN '' ELSE 'LAKE SHORE--DR' END AS street FROM orders""",
}
#: The day of a text in raw.
DAY = "CASE WHEN substr(event_date, 3, 1) = '/' THEN try_cast(substr(event_date, 7, 4) || '-' || substr(event_date, 1, 2) || '-' || substr(event_date, 4, 2) AS DATE) ELSE try_cast(substr(nullif(event_date, ''), 1, 10) AS DATE) END"
VIEWS["clean"] = f"""SELECT record_id, nullif(trim(injury), '') AS injury_text, CASE upper(trim(injury)) WHEN 'FATAL' THEN 'K' WHEN 'INCAPACITATING INJURY' THEN 'A' WHEN 'NONINCAPACITATING INJURY' THEN 'B'
    WHEN 'REPORTED, NOT EVIDENT' THEN 'C' WHEN 'NO INDICATION OF INJURY' THEN 'O' ELSE 'U' END AS kabco, {DAY} AS event_day,
    CASE WHEN try_cast(nullif(trim(lanes), '') AS DOUBLE) % 1 = 0 THEN CAST(try_cast(nullif(trim(lanes), '') AS DOUBLE) AS BIGINT) END AS lanes, try_cast(nullif(trim(speed), '') AS DOUBLE) AS speed,
    nullif(upper(trim(flag)), '') AS flag, CASE WHEN coalesce(trim(lat), '') = '' AND coalesce(trim(lon), '') = '' THEN 'missing_pair' WHEN coalesce(trim(lat), '') = '' OR coalesce(trim(lon), '') = '' THEN 'incomplete_pair'
    WHEN try_cast(lat AS DOUBLE) IS NULL OR try_cast(lon AS DOUBLE) IS NULL THEN 'non_numeric' WHEN try_cast(lat AS DOUBLE) NOT BETWEEN 41 AND 43 OR try_cast(lon AS DOUBLE) NOT BETWEEN -89 AND -87 THEN 'out_of_range' ELSE 'valid' END AS coordinate_status
    FROM raw"""


def _reads(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def needed(text: str) -> list[str]:
    """The views that a statement reads, directly or not, in order."""
    found: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                found.add(name)
                visit(VIEWS[name])

    visit(text)
    return [v for v in VIEWS if v in found]


def with_views(text: str) -> str:
    """The statement behind a WITH of its views. A statement that begins with 'WITH ' has its own views after them."""
    return _with(text, needed(text))


def _with(text: str, names: list[str]) -> str:
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in names)
    own = text.strip()
    if not views:
        return own
    return f"WITH {views},\n{own[5:]}" if own.upper().startswith("WITH ") else f"WITH {views}\n{own}"


#: Views that an operator makes for Spark, of the Tables that they read. The text in VIEWS is the oracle's.
MARTS: dict[str, Callable[[Tables], DataFrame]] = {}
_made: dict[tuple, tuple] = {}


def mart(name: str):
    def put(f):
        MARTS[name] = f
        return f

    return put


def drop_marts(spark: SparkSession) -> None:
    """Delete the marts of this application. They are made anew where they are needed again."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        delete(spark, _made.pop(key)[0])


class Tables:
    """The tables of a folder and what one query makes of them. Marts are written to the checkpoint folder and read from there until a table changes; no temporary view of the session is touched."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.frames, self.versions = spark, sf_dir, {}, None

    def view(self, name: str) -> DataFrame:
        """A table, a mart or any other view."""
        if name in self.frames:
            return self.frames[name]
        if name in TABLES:
            self.frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in MARTS:
            self.frames[name] = self._mart(name)
        else:
            return self.sql(f"SELECT * FROM {name}")
        return self.frames[name]

    def _mart(self, name: str) -> DataFrame:
        """A mart as it was made before in this session, if the tables are still those it was made of; else made now."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, self._versions())
        if key not in _made or not exists(self.spark, f"{_made[key][0]}/_SUCCESS"):
            made = MARTS[name](self)
            path = scratch_path(self.spark, name)
            made.write.parquet(path)
            _made[key] = path, made.schema
        path, schema = _made[key]
        return self.spark.read.schema(schema).parquet(path)

    def _versions(self) -> tuple:
        """What changes when a file of a table does."""
        if self.versions is None:
            self.versions = version(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in TABLES])
        return self.versions

    def sql(self, text: str) -> DataFrame:
        inline: set[str] = set()

        def visit(sql: str) -> None:
            for name in VIEWS:
                if name not in inline and name not in MARTS and _reads(sql, name):
                    inline.add(name)
                    visit(VIEWS[name])

        visit(text)
        sql = _with(text, [v for v in VIEWS if v in inline])
        used = {n: self.view(n) for n in (*TABLES, *MARTS) if _reads(sql, n)}
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", sql), **used) if used else self.spark.sql(sql)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a statement over the tables in sf_dir."""
    return Tables(spark, sf_dir).sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Tables(spark, sf_dir).view(name)
