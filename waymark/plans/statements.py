"""Queries that are one SQL statement over the stand-in views: joins, aggregates, windows, top-k, set operations, marts and gates.

The text runs on Spark SQL and serves as the oracle's text too. Whole sums are cast to BIGINT, doubles are rounded to six
places at the end only, and every ranking ends in a key, so that a result does not depend on row order.
"""

from __future__ import annotations


def _n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


SEVERITIES = ("k", "a", "b", "c", "o", "u")
COUNTS = (*SEVERITIES, "total", "ksi")
LAGS = (1, 3, 6, 12)
FRAMES = (3, 6, 12)
W = "PARTITION BY unit_id ORDER BY month_start"
_sums = ", ".join(f"{_n(f'sum({c})')} AS {c}" for c in COUNTS)
_lags = ", ".join(f"{_n(f'lag({c}, {k}) OVER w')} AS {c}_lag{k}" for c in ("total", "ksi") for k in LAGS)
_means = ", ".join(f"{_r(f'CASE WHEN row_number() OVER w > {n} THEN avg({c}) OVER w{n} END')} AS {c}_mean{n}" for c in ("total", "ksi") for n in FRAMES)
_window_sums = ", ".join(f"{_n(f'CASE WHEN row_number() OVER w > {n} THEN sum({c}) OVER w{n} END')} AS {c}_sum{n}" for c in ("total", "ksi") for n in FRAMES)
_frames = f"WINDOW w AS ({W}), " + ", ".join(f"w{n} AS ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in FRAMES)
_masks = {"building": "segment = 'BUILDING'", "auto": "segment = 'AUTOMOBILE'", "machinery": "segment = 'MACHINERY'", "household": "segment = 'HOUSEHOLD'", "furniture": "segment = 'FURNITURE'", "closed": "status = 'F'"}
_profile = ", ".join(
    f"{_n(f'count(CASE WHEN ({m}) AND ({s}) THEN 1 END)')} AS {name}_{c}"
    for name, m in {"all": "1 = 1", **_masks}.items()
    for c, s in {**{x: f"severity = '{x.upper()}'" for x in "kabcou"}, "total": "1 = 1", "ksi": "severity IN ('K', 'A')"}.items()
)
_recon = f"""{_n('count(*)')} AS total_rows, {_n("count(DISTINCT CAST(unit_id AS STRING) || '_' || CAST(month_start AS STRING))")} AS distinct_keys, {_n("count(*) - count(DISTINCT CAST(unit_id AS STRING) || '_' || CAST(month_start AS STRING))")} AS duplicate_keys,
    {_n('count(DISTINCT unit_id)')} AS unit_count, CAST(min(month_start) AS STRING) AS min_month, CAST(max(month_start) AS STRING) AS max_month, {_n('sum(total)')} AS total_sum, {_n('sum(ksi)')} AS ksi_sum,
    {_n('count(CASE WHEN total = 0 THEN 1 END)')} AS zero_rows, {", ".join(f"{_n(f"count(CASE WHEN model_split = '{s}' THEN 1 END)")} AS {s}_rows" for s in ("warmup", "train", "validation", "test"))},
    {_n('count(CASE WHEN model_ready THEN 1 END)')} AS ready_rows, {_n('count(CASE WHEN total < 0 OR ksi < 0 THEN 1 END)')} AS negative_counts, {_n('count(CASE WHEN unit_id IS NULL OR month_start IS NULL THEN 1 END)')} AS null_keys,
    {_n("count(CASE WHEN model_split NOT IN ('warmup', 'train', 'validation', 'test') THEN 1 END)")} AS unexpected_splits, {_n('sum(abs(ksi - (k + a)))')} AS ksi_diff, {_n('sum(abs(total - (k + a + b + c + o + u)))')} AS severity_diff"""


def _spearman(inner: str) -> str:
    """Correlation of average ranks of columns x and y of a statement."""
    return f"""SELECT {_r('corr(rx, ry)')} AS spearman, {_n('max(abs(px - py))')} AS max_rank_difference FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx,
        rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry, rank() OVER (ORDER BY x DESC) AS px, rank() OVER (ORDER BY y DESC) AS py FROM ({inner}))"""


def gate(view: str, checks: dict[str, tuple[str, str]]) -> str:
    """Check rows (check_name, severity, passed, evidence) and the rolled-up status. checks: name to (severity, SQL count of offences), all in one pass over the view."""
    cols = ", ".join(f"{_n(sql)} AS c{k}" for k, (_, sql) in enumerate(checks.values()))
    rows = " UNION ALL ".join(f"SELECT '{name}' AS check_name, '{sev}' AS severity, c{k} = 0 AS passed, c{k} AS evidence FROM agg" for k, (name, (sev, _)) in enumerate(checks.items()))
    return f"""WITH agg AS (SELECT {cols} FROM {view}), rows AS ({rows})
        SELECT check_name, severity, passed, evidence, (SELECT CASE WHEN count(CASE WHEN severity = 'CRITICAL' AND NOT passed THEN 1 END) > 0 THEN 'FAIL' WHEN count(CASE WHEN NOT passed THEN 1 END) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END FROM rows) AS status FROM rows"""


def _bad(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


# Costs of an event by severity that count economic loss alone.
#: Present value of a benefit row by them.
_ECONOMIC = "(b.av_k * 2000000e0 + b.av_a * 170000e0 + b.av_b * 60000e0 + b.av_c * 40000e0 + b.av_o * 12000e0) * b.pv / nullif(b.annual_benefit, 0)"


def _figures(view: str, total: str, severe: str, where: str = "") -> str:
    """(metric, v): a recount of a table's figures."""
    figures = {"rows": total, "units": "count(DISTINCT unit_id)", "months": "count(DISTINCT month_start)", "severe": severe, "first": "min(yr * 12 + mon)", "last": "max(yr * 12 + mon)", "severe_share": f"round({severe} / CAST({total} AS DOUBLE), 12)"}
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS v FROM {view} {where}" for k, v in figures.items())


_hist_sub = "SELECT h.unit_id, coalesce(s.n, 0) AS n, coalesce(s.k, 0) AS k, coalesce(s.a, 0) AS a, coalesce(s.b, 0) AS b, coalesce(s.c, 0) AS c, coalesce(s.o, 0) AS o FROM hist h LEFT JOIN subgroup s ON h.unit_id = s.unit_id"
_cumulative = "SELECT portfolio_id, unit_id FROM sel WHERE run_group = 'OFFICIAL' AND unc = 'BASE' AND portfolio_id LIKE '%EQ20'"
_tier = "CASE WHEN portfolio_id LIKE '%B15M%' THEN 15 WHEN portfolio_id LIKE '%B25M%' THEN 25 ELSE 40 END"

STATEMENTS: dict[str, str] = {
    # scans
    "sc01_parquet_projection": "SELECT o_orderkey, o_orderpriority FROM orders",
    "sc12_date_window": "SELECT event_id, unit_id, severity FROM ev WHERE ts >= TIMESTAMP '1997-03-01 00:00:00' AND ts < TIMESTAMP '1997-06-01 00:00:00'",
    "sc11_latest_pass_manifest": """WITH manifest AS (SELECT unit_id, yr, 'manifest-' || CAST(unit_id AS STRING) || '-' || CAST(yr AS STRING) AS path, CASE WHEN (unit_id + yr) % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n FROM ev GROUP BY unit_id, yr)
        SELECT unit_id, path FROM (SELECT unit_id, path, row_number() OVER (PARTITION BY unit_id ORDER BY yr DESC) AS rn FROM manifest WHERE status = 'PASS') WHERE rn = 1""",
    # scalar expressions over whole tables
    "cl12_calendar": "SELECT DISTINCT month_start, CAST(month(month_start) AS INT) AS mon, CAST(quarter(month_start) AS INT) AS qtr, CAST(year(month_start) AS INT) AS yr, CAST(year(month_start) - 1995 AS INT) AS year_trend FROM panel",
    "cl13_cyclic_month": f"SELECT DISTINCT mon, {_r('sin(2 * pi() * mon / 12)')} AS month_sin, {_r('cos(2 * pi() * mon / 12)')} AS month_cos FROM panel",
    "cl14_split_label": "SELECT unit_id, month_start, model_split FROM feat",
    "cl15_prefix_flag": "SELECT p_partkey, upper(coalesce(p_name, '')) LIKE 'B%' AS starts_with FROM part",
    "cl16_composite_key": "SELECT CAST(unit_id AS STRING) || '_' || CAST(month_start AS STRING) AS row_key, total FROM panel",
    "cl18_unit_cost": f"SELECT unit_id, treatment_id, scenario, {_r('CASE WHEN averted > 0 THEN cost / averted END')} AS unit_cost FROM benefit",
    "cl20_floor_cap": f"SELECT unit_id, month_start, {_r('greatest(total_mean12 - 5, 0e0)')} AS floored, {_r('least(1e0, ksi_mean12)')} AS capped FROM feat WHERE total_mean12 IS NOT NULL",
    "cl21_ceil_quantity": f"SELECT unit_id, treatment_id, scenario, {_r('quantity')} AS quantity FROM benefit WHERE treatment_id <> 'T2'",
    # filters
    "fi01_status_before_join": f"SELECT e.unit_id, {_n('count(*)')} AS n FROM ev e JOIN units u ON e.unit_id = u.unit_id WHERE e.status = 'F' GROUP BY e.unit_id",
    "fi03_eligibility_screen": f"SELECT scenario, {_n('count(*)')} AS candidates, {_n(_bad("applicability = 'NOT_APPLICABLE'"))} AS not_applicable, {_n(_bad("applicability <> 'NOT_APPLICABLE' AND pv / cost < 1"))} AS uneconomic, {_n(_bad("applicability <> 'NOT_APPLICABLE' AND pv / cost >= 1"))} AS eligible FROM benefit GROUP BY scenario",
    "fi04_set_rules": f"""SELECT s_suppkey, {_n('max(CASE WHEN p_size % 8 IN (2, 3) THEN 1 ELSE 0 END)')} = 1 AND {_n('min(CASE WHEN p_size % 8 IN (1, 4, 5, 7) THEN 1 ELSE 0 END)')} = 0 AS class_ok, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS has_r,
        max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 0 AS no_o FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey""",
    # joins
    "jo01_guarded_inner": f"SELECT {_n('count(*)')} AS joined, (SELECT {_n('count(*)')} FROM ev) AS left_rows, count(*) = (SELECT count(*) FROM ev) AS one_to_one FROM ev e JOIN units u ON e.unit_id = u.unit_id",
    "jo04_star": f"SELECT h.unit_id, h.unit_name, h.grp, {_r('f.total_forecast')} AS forecast, {_r('p.sub_share')} AS sub_share, u.priority_area FROM hist h LEFT JOIN annual f ON h.unit_id = f.unit_id LEFT JOIN posterior p ON h.unit_id = p.unit_id LEFT JOIN units u ON h.unit_id = u.unit_id",
    "jo05_fact_summary": f"SELECT s.portfolio_id, s.unit_id, s.treatment_id, m.projects, {_r('m.cost')} AS portfolio_cost FROM sel s LEFT JOIN summ m ON s.portfolio_id = m.portfolio_id",
    "jo06_anti_two_keys": f"SELECT c.unit_id, c.treatment_id, {_r('c.cost')} AS cost FROM cand c LEFT ANTI JOIN (SELECT unit_id, treatment_id FROM sel WHERE portfolio_id = 'PORT_OFF_BASE_B15M_EQ20') s ON c.unit_id = s.unit_id AND c.treatment_id = s.treatment_id WHERE c.scenario = 'BASE'",
    "jo07_orphans": f"SELECT {_n('count(*)')} AS orphans, {_r('1 - count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM child)')} AS coverage FROM child c LEFT ANTI JOIN ev e ON c.parent_id = e.event_id",
    "jo08_parents_with_children": f"SELECT {_n('count(*)')} AS parents, {_n('count(c.parent_id)')} AS with_children, {_n('count(*) - count(c.parent_id)')} AS without_children, {_r('CAST(count(c.parent_id) AS DOUBLE) / count(*)')} AS coverage FROM ev e LEFT JOIN (SELECT DISTINCT parent_id FROM child) c ON c.parent_id = e.event_id",
    "jo09_date_mismatch": f"SELECT {_n('count(*)')} AS mismatches FROM child c JOIN ev e ON c.parent_id = e.event_id WHERE c.child_date <> CAST(e.ts AS DATE)",
    "jo10_selection_benefits": f"SELECT s.portfolio_id, s.unit_id, s.treatment_id, {_r('b.av_k + b.av_a')} AS ksi_averted, {_r('b.averted')} AS averted FROM sel s LEFT JOIN benefit b ON s.unit_id = b.unit_id AND s.treatment_id = b.treatment_id AND s.unc = b.scenario",
    "jo11_lineage": f"SELECT {_n('count(CASE WHEN b.unit_id IS NULL THEN 1 END)')} AS unmatched, {_r('max(abs(s.cost - b.cost))')} AS max_cost_diff, {_r('max(abs(s.pv - b.pv))')} AS max_pv_diff FROM sel s LEFT JOIN benefit b ON s.unit_id = b.unit_id AND s.treatment_id = b.treatment_id AND s.unc = b.scenario",
    "jo14_metadata_cardinality": f"SELECT {_n('count(*)')} AS joined, count(*) = (SELECT count(*) FROM nation) AS complete FROM units",
    "jo15_feature_audit": f"""WITH other AS (SELECT p.unit_id, p.month_start, q.total AS lag1, {_n('sum(z.total)')} AS sum12 FROM panel p LEFT JOIN panel q ON q.unit_id = p.unit_id AND q.yr * 12 + q.mon = p.yr * 12 + p.mon - 1
        LEFT JOIN panel z ON z.unit_id = p.unit_id AND z.yr * 12 + z.mon BETWEEN p.yr * 12 + p.mon - 12 AND p.yr * 12 + p.mon - 1 GROUP BY p.unit_id, p.month_start, q.total)
        SELECT {_n('count(*)')} AS n, {_n(_bad('coalesce(f.total_lag1, -1) <> coalesce(o.lag1, -1)'))} AS lag_mismatches, {_n(_bad('f.total_sum12 IS NOT NULL AND f.total_sum12 <> o.sum12'))} AS sum_mismatches FROM feat f JOIN other o ON f.unit_id = o.unit_id AND f.month_start = o.month_start""",
    "jo16_parent_child_enrichment": f"SELECT e.event_id, e.ts, {_n('coalesce(c.n, 0)')} AS children, {_n('coalesce(c.q, 0)')} AS quantity FROM ev e LEFT JOIN (SELECT parent_id, count(*) AS n, sum(quantity) AS q FROM child GROUP BY parent_id) c ON c.parent_id = e.event_id",
    # aggregates
    "ag02_condition_profile": f"SELECT unit_id, {_profile} FROM ev GROUP BY unit_id",
    "ag03_reconciliation": f"SELECT {_recon} FROM feat",
    "ag04_composite_duplicates": f"SELECT {_n('count(*)')} AS n, {_n("count(DISTINCT CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING))")} AS keys, {_n("count(*) - count(DISTINCT CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING))")} AS duplicates FROM lineitem",
    "ag05_group_sizes": f"SELECT {_n('min(n)')} AS min_children, {_n('max(n)')} AS max_children, {_n('count(*)')} AS parents FROM (SELECT parent_id, count(*) AS n FROM child GROUP BY parent_id)",
    "ag06_null_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_n(_bad(f"trim(coalesce({c}, '')) = ''"))} AS nulls, {_r(f"CAST({_bad(f"trim(coalesce({c}, '')) = ''")} AS DOUBLE) / count(*)")} AS rate FROM raw" for c in ("injury", "event_date", "lanes", "speed", "flag", "lat", "lon", "street")),
    "ag07_coordinate_profile": f"SELECT coordinate_status, {_n('count(*)')} AS n, {_r('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} AS share FROM clean GROUP BY coordinate_status",
    "ag08_key_profile": f"SELECT {_n('sum(n)')} AS n, {_n('sum(CASE WHEN parent_id IS NULL THEN n ELSE 0 END)')} AS missing, {_n('count(CASE WHEN n > 1 THEN 1 END)')} AS repeated, {_n('count(*)')} AS keys FROM (SELECT parent_id, count(*) AS n FROM child GROUP BY parent_id)",
    "ag09_duplicate_rows_values": f"SELECT {_n('coalesce(sum(n), 0)')} AS rows_in_duplicates, {_n('count(*)')} AS duplicated_keys FROM (SELECT l_orderkey, l_partkey % 10 AS p, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey % 10 HAVING count(*) > 1)",
    "ag10_monthly_coverage": f"SELECT yr, mon, {_n('count(*)')} AS n FROM ev GROUP BY yr, mon",
    "ag11_annual_coverage": f"SELECT yr, {_n('count(*)')} AS months, {_n('sum(n)')} AS total, {_n('min(n)')} AS least_month, {_n('max(n)')} AS most_month, count(*) = 12 AS complete_year FROM (SELECT yr, mon, count(*) AS n FROM ev GROUP BY yr, mon) GROUP BY yr",
    "ag12_annual_sums": f"SELECT unit_id, yr, {_sums} FROM panel GROUP BY unit_id, yr",
    "ag13_seasonality": f"SELECT mon, {_r('avg(total)')} AS mean_total FROM panel GROUP BY mon",
    "ag14_concentration": f"SELECT unit_id, total, {_r('CAST(total AS DOUBLE) / every')} AS share FROM (SELECT unit_id, total, sum(total) OVER () AS every, row_number() OVER (ORDER BY total DESC, unit_id) AS rn FROM hist) WHERE rn <= 15",
    "ag15_pivot_years": f"SELECT unit_id, {', '.join(f'{_n(f'sum(CASE WHEN yr = {y} THEN total ELSE 0 END)')} AS y{y}' for y in range(1995, 2002))}, {_n('sum(total)')} AS total FROM panel GROUP BY unit_id",
    "ag16_share_mix": f"SELECT yr, {', '.join(f'{_r(f'CAST(sum({c}) AS DOUBLE) / sum(total) * 100')} AS {c}_pct' for c in SEVERITIES)} FROM panel GROUP BY yr",
    "ag17_zero_profile": f"SELECT {_n(_bad('total = 0'))} AS zero_cells, {_n(_bad('total > 0'))} AS other_cells, {_r('CAST(count(CASE WHEN total = 0 THEN 1 END) AS DOUBLE) / count(*) * 100')} AS zero_pct FROM panel",
    "ag18_overdispersion": " UNION ALL ".join(f"SELECT '{c}' AS target, {_n('count(*)')} AS n, {_r(f'avg({c})')} AS mean, {_r(f'var_samp({c})')} AS variance, {_r(f'var_samp({c}) / avg({c})')} AS ratio, {_r(f'CAST({_bad(f'{c} = 0')} AS DOUBLE) / count(*) * 100')} AS zero_pct, var_samp({c}) / avg({c}) > 15e-1 AS overdispersed FROM panel" for c in ("total", "ksi")),
    "ag19_run_groups": f"SELECT run_group, {_n('count(*)')} AS runs, {_n('count(DISTINCT projects)')} AS kinds, {_n('min(projects)')} AS least, {_n('max(projects)')} AS most FROM summ GROUP BY run_group",
    "ag20_grouping_sets": f"SELECT treatment_id, scenario, CAST(priority_area AS INT) AS priority_area, {_n('count(*)')} AS n, {_r('avg(pv / cost)')} AS mean_bcr, {_r('median(pv / cost)')} AS median_bcr FROM benefit GROUP BY GROUPING SETS ((treatment_id, scenario, priority_area), (treatment_id, scenario))",
    "ag21_win_counts": f"SELECT scenario, treatment_id, {_n('count(*)')} AS wins, {_r('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY scenario) * 100')} AS pct FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, scenario ORDER BY round(pv / cost, 6) DESC, treatment_id) AS rn FROM benefit) WHERE rn = 1 GROUP BY scenario, treatment_id",
    "ag23_value_histogram": f"SELECT bin, n FROM (SELECT bin, n, row_number() OVER (ORDER BY n DESC, bin) AS rn FROM (SELECT round(l_extendedprice / 1000, 0) AS bin, {_n('count(*)')} AS n FROM lineitem GROUP BY round(l_extendedprice / 1000, 0))) WHERE rn <= 10",
    "ag24_first_mean_nunique": f"SELECT unit_id, min(grp) AS grp, {_r('avg(total)')} AS mean_total, {_n('count(DISTINCT total)')} AS kinds FROM panel GROUP BY unit_id",
    "ag25_max_differences": f"SELECT {_r('max(abs(av_k + av_a + av_b + av_c + av_o - averted))')} AS max_abs, {_r('max(abs(pv - annual_benefit) / pv)')} AS max_rel FROM benefit",
    "ag26_split_summary": f"SELECT model_split, {_n('count(*)')} AS n, min(month_start) AS first_month, max(month_start) AS last_month, {_n('sum(total)')} AS total, {_n('sum(ksi)')} AS ksi FROM feat GROUP BY model_split",
    "ag27_dataset_stats": f"SELECT {_r('sum(length_miles)')} AS total_miles, {_r('min(length_miles)')} AS min_miles, {_r('avg(length_miles)')} AS mean_miles, {_r('max(length_miles)')} AS max_miles, {_n(_bad('priority_area'))} AS flagged, {_r('CAST(count(CASE WHEN priority_area THEN 1 END) AS DOUBLE) / count(*)')} AS flagged_share FROM units",
    "ag28_density_top": f"SELECT unit_id, per_mile FROM (SELECT h.unit_id, {_r('f.total_forecast / h.length_miles')} AS per_mile, row_number() OVER (ORDER BY round(f.total_forecast / h.length_miles, 6) DESC, h.unit_id) AS rn FROM hist h JOIN annual f ON h.unit_id = f.unit_id) WHERE rn <= 10",
    # windows
    "wi01_lags": f"SELECT unit_id, month_start, {_lags} FROM panel WINDOW w AS ({W})",
    "wi02_trailing_means": f"SELECT unit_id, month_start, {_means} FROM panel {_frames}",
    "wi03_trailing_sums": f"SELECT unit_id, month_start, {_window_sums} FROM panel {_frames}",
    "wi04_history": f"SELECT unit_id, month_start, {_n('history')} AS history, model_ready FROM feat",
    "wi05_yoy_delta": f"SELECT unit_id, yr, {_n('t')} AS total, {_n('t - lag(t, 1) OVER (PARTITION BY unit_id ORDER BY yr)')} AS delta FROM (SELECT unit_id, yr, sum(total) AS t FROM panel GROUP BY unit_id, yr)",
    "wi06_group_size": f"SELECT event_id, {_n('count(*) OVER (PARTITION BY unit_id, month_start)')} AS peers FROM ev",
    "wi08_two_rankings": f"SELECT unit_id, {_n('rank() OVER (ORDER BY round(total_forecast, 6) DESC)')} AS rank_total, {_n('rank() OVER (ORDER BY round(ksi_forecast, 6) DESC)')} AS rank_ksi FROM annual",
    "wi09_rank_percentile": f"SELECT unit_id, {_n('rn')} AS position, {_r('1 - (rn - 1e0) / n')} AS percentile FROM (SELECT unit_id, row_number() OVER (ORDER BY round(ksi_forecast, 6) DESC, unit_id) AS rn, count(*) OVER () AS n FROM annual)",
    "wi10_rank_in_portfolio": f"SELECT portfolio_id, unit_id, {_n('row_number() OVER (PARTITION BY portfolio_id ORDER BY round(pv, 2) DESC, unit_id)')} AS position FROM sel",
    "wi11_rolling_inclusive": f"SELECT unit_id, month_start, {_r('CASE WHEN row_number() OVER w >= 12 THEN avg(total) OVER (PARTITION BY unit_id ORDER BY month_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END')} AS rolling FROM panel WINDOW w AS ({W})",
    "wi12_first_last_year": f"""SELECT unit_id, {_r('avg(CASE WHEN up <= 12 THEN total END)')} AS first_mean, {_r('avg(CASE WHEN down <= 12 THEN total END)')} AS last_mean, {_r('(avg(CASE WHEN down <= 12 THEN total END) / avg(CASE WHEN up <= 12 THEN total END) - 1) * 100')} AS change_pct
        FROM (SELECT unit_id, total, row_number() OVER (PARTITION BY unit_id ORDER BY month_start) AS up, row_number() OVER (PARTITION BY unit_id ORDER BY month_start DESC) AS down FROM panel) GROUP BY unit_id""",
    "wi13_slope": f"SELECT unit_id, {_r('regr_slope(CAST(total AS DOUBLE), CAST(rn AS DOUBLE))')} AS slope FROM (SELECT unit_id, total, row_number() OVER ({W}) AS rn FROM panel) GROUP BY unit_id",
    "wi14_trend_class": f"""SELECT unit_id, CASE WHEN change > 5 THEN 'increasing' WHEN change < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT unit_id, round((avg(CASE WHEN down <= 12 THEN total END) / avg(CASE WHEN up <= 12 THEN total END) - 1) * 100, 6) AS change
        FROM (SELECT unit_id, total, row_number() OVER (PARTITION BY unit_id ORDER BY month_start) AS up, row_number() OVER (PARTITION BY unit_id ORDER BY month_start DESC) AS down FROM panel) GROUP BY unit_id)""",
    "wi15_three_sigma": f"SELECT unit_id, month_start, total, {_r('total - m - 3 * s')} AS excess FROM (SELECT unit_id, month_start, total, avg(total) OVER (PARTITION BY unit_id) AS m, stddev_samp(total) OVER (PARTITION BY unit_id) AS s FROM panel) WHERE round(total - m - 3 * s, 6) > 0",
    "wi17_spearman": _spearman("SELECT CAST(total AS DOUBLE) AS x, CAST(ksi AS DOUBLE) AS y FROM hist"),
    # top-k
    "tk01_top_k": "SELECT unit_id, total FROM (SELECT unit_id, total, row_number() OVER (ORDER BY total DESC, unit_id) AS rn FROM hist) WHERE rn <= 10",
    "tk02_argmax": f"SELECT unit_id, scenario, treatment_id, round(pv, 2) AS pv FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, scenario ORDER BY round(pv, 4) DESC, treatment_id) AS rn FROM benefit) WHERE rn = 1",
    "tk03_best_with_fallback": "SELECT unit_id, scenario, treatment_id, applicability FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, scenario ORDER BY CASE WHEN applicability = 'NOT_APPLICABLE' THEN 1 ELSE 0 END, round(pv / cost, 6) DESC, treatment_id) AS rn FROM benefit) WHERE rn = 1",
    "tk04_mixed_sort": f"SELECT unit_id, n, {_n('row_number() OVER (ORDER BY n DESC, round(cost, 2), unit_id)')} AS position FROM (SELECT unit_id, {_n('count(*)')} AS n, sum(cost) AS cost FROM sel GROUP BY unit_id)",
    "tk05_top_bottom": f"SELECT unit_id, delta, CASE WHEN up <= 8 THEN 'bottom' ELSE 'top' END AS side FROM (SELECT unit_id, delta, row_number() OVER (ORDER BY delta, unit_id) AS up, row_number() OVER (ORDER BY delta DESC, unit_id) AS down FROM (SELECT unit_id, {_n('sum(CASE WHEN yr = 2000 THEN total ELSE 0 END) - sum(CASE WHEN yr = 1996 THEN total ELSE 0 END)')} AS delta FROM panel GROUP BY unit_id)) WHERE up <= 8 OR down <= 8",
    # set operations
    "se01_union_by_name": f"SELECT unit_id, {_n('total')} AS value, 'total' AS kind FROM hist UNION ALL SELECT unit_id, {_n('ksi')}, 'ksi' FROM hist",
    "se02_difference": "SELECT n_nationkey AS unit_id FROM nation EXCEPT SELECT unit_id FROM ev WHERE severity = 'K' AND yr = 1995 AND mon = 1",
    "se03_intersection": "SELECT l_partkey AS part FROM lineitem WHERE l_suppkey % 10 = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey % 10 = 2",
    "se04_inclusion_tiers": f"""WITH t AS (SELECT DISTINCT {_tier} AS tier, unit_id FROM ({_cumulative})) SELECT 25 AS tier, unit_id FROM (SELECT unit_id FROM t WHERE tier = 25 EXCEPT SELECT unit_id FROM t WHERE tier = 15)
        UNION ALL SELECT 40, unit_id FROM (SELECT unit_id FROM t WHERE tier = 40 EXCEPT SELECT unit_id FROM t WHERE tier = 25) UNION ALL SELECT 15, unit_id FROM t WHERE tier = 15""",
    "se05_melt": " UNION ALL ".join(f"SELECT target, model, model_split, '{c}' AS metric, {_r(c)} AS value FROM metric" for c in ("mae", "rmse", "deviance", "bias", "calibration")),
    # model evaluation
    "mo01_seasonal_naive": f"SELECT unit_id, month_start, {_r('predicted')} AS predicted FROM pred WHERE model = 'seasonal_naive' AND target = 'total'",
    "mo02_rolling_benchmark": f"SELECT unit_id, month_start, {_r('predicted')} AS predicted FROM pred WHERE model = 'rolling_mean12' AND target = 'total'",
    "mo05_nb_dispersion": " UNION ALL ".join(f"SELECT '{c}' AS target, {_r(f'CASE WHEN var_samp({c}) > avg({c}) AND avg({c}) > 0 THEN greatest(1e-4, (var_samp({c}) - avg({c})) / (avg({c}) * avg({c}))) ELSE 0.1e0 END')} AS dispersion FROM feat WHERE model_split = 'train'" for c in ("total", "ksi")),
    "mo07_winner": f"SELECT target, model, {_r('deviance')} AS deviance, rn = 1 AS is_winner FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(deviance, 9), model) AS rn FROM metric WHERE model_split = 'validation')",
    "mo09_comparison": f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(deviance, 9), model) AS rn FROM metric WHERE model_split = 'validation') SELECT v.target, v.model, {_r('v.deviance')} AS validation_deviance, {_r('CASE WHEN v.rn = 1 THEN t.deviance END')} AS test_deviance,
        {_r('CASE WHEN v.rn = 1 THEN t.mae END')} AS test_mae FROM v JOIN metric t ON v.target = t.target AND v.model = t.model AND t.model_split = 'test'""",
    "mo10_calibration_factor": f"SELECT target, model, {_r('sum(actual) / sum(predicted)')} AS factor FROM pred WHERE model_split = 'validation' GROUP BY target, model",
    "mo11_calibrated_test": f"""WITH f AS (SELECT target, model, sum(actual) / sum(predicted) AS factor FROM pred WHERE model_split = 'validation' GROUP BY target, model) SELECT p.target, p.model, {_r('avg(abs(actual - predicted))')} AS raw_mae, {_r('avg(abs(actual - predicted * factor))')} AS calibrated_mae,
        {_r('sum(predicted) / sum(actual)')} AS raw_ratio, {_r('sum(predicted * factor) / sum(actual)')} AS calibrated_ratio FROM pred p JOIN f ON p.target = f.target AND p.model = f.model WHERE model_split = 'test' GROUP BY p.target, p.model""",
    "mo18_rank_agreement": _spearman("SELECT round(f.ksi_forecast, 6) AS x, CAST(h.ksi AS DOUBLE) AS y FROM annual f JOIN hist h ON f.unit_id = h.unit_id"),
    "mo20_raw_calibrated_backtest": f"""WITH f AS (SELECT target, sum(actual) / sum(predicted) AS factor FROM pred WHERE model_split = 'validation' AND model = 'rolling_mean12' GROUP BY target), b AS (SELECT p.target, 'raw' AS kind, actual, predicted FROM pred p WHERE model_split = 'test' AND model = 'rolling_mean12'
        UNION ALL SELECT p.target, 'calibrated', actual, predicted * factor FROM pred p JOIN f ON p.target = f.target WHERE model_split = 'test' AND model = 'rolling_mean12') SELECT target, kind, {_r('avg(abs(actual - predicted))')} AS mae, {_r('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse FROM b GROUP BY target, kind""",
    # shrinkage, benefit and cost
    "bc01_severity_shrinkage": f"SELECT unit_id, {_r('share_k')} AS share_k, {_r('share_a')} AS share_a, {', '.join(f'{_r(f'share_{c} / (share_b + share_c + share_o)')} AS share_{c}' for c in 'bco')} FROM shares",
    "bc02_subgroup_shrinkage": f"""SELECT unit_id, {_r('w * CASE WHEN ksi > 0 THEN k / ksi ELSE pk END + (1 - w) * pk')} AS sub_share_k FROM (SELECT unit_id, CAST(k AS DOUBLE) AS k, CAST(k + a AS DOUBLE) AS ksi, (k + a) / (k + a + 10e0) AS w,
        coalesce(CAST(sum(k) OVER () AS DOUBLE) / nullif(sum(k + a) OVER (), 0), 0.1e0) AS pk FROM ({_hist_sub}))""",
    "bc03_beta_binomial": f"SELECT unit_id, {_n('n_sub')} AS n_sub, {_r('sub_share')} AS sub_share FROM posterior",
    "bc04_share_reconciliation": f"SELECT {_r('sum(f.total_forecast * p.sub_share) / sum(f.total_forecast)')} AS weighted, {_r('max(p.pooled)')} AS pooled, abs(sum(f.total_forecast * p.sub_share) / sum(f.total_forecast) - max(p.pooled)) * 100 > 2 AS warns FROM annual f JOIN posterior p ON f.unit_id = p.unit_id",
    "bc05_scenario_expansion": "SELECT unit_id, treatment_id, scenario, exposure_share FROM benefit",
    "bc06_bounded_cmf": f"SELECT DISTINCT treatment_id, scenario, {_r('cmf')} AS cmf FROM benefit",
    "bc07_averted_by_severity": f"SELECT unit_id, treatment_id, scenario, {', '.join(f'{_r(f'av_{c}')} AS av_{c}' for c in 'kabco')} FROM benefit",
    "bc08_monetize": f"SELECT unit_id, treatment_id, scenario, round(annual_benefit, 2) AS annual_benefit FROM benefit",
    "bc10_cost_bcr": f"SELECT unit_id, treatment_id, scenario, {_r('quantity')} AS quantity, round(cost, 2) AS cost, round(pv - cost, 2) AS npv, {_r('CASE WHEN cost > 0 THEN pv / cost ELSE 0 END')} AS bcr FROM benefit",
    "bc11_economic_only": f"SELECT unit_id, treatment_id, scenario, round(av_k * 2000000e0 + av_a * 170000e0 + av_b * 60000e0 + av_c * 40000e0 + av_o * 12000e0, 2) AS economic_annual, {_r('(av_k * 2000000e0 + av_a * 170000e0 + av_b * 60000e0 + av_c * 40000e0 + av_o * 12000e0) * pv / nullif(annual_benefit, 0) / nullif(cost, 0)')} AS economic_bcr FROM benefit",
    "bc12_priority_share": f"SELECT portfolio_id, {_r('sum(CASE WHEN priority_area THEN pv ELSE 0e0 END) / sum(pv)')} AS benefit_share, {_r('sum(CASE WHEN priority_area THEN cost ELSE 0e0 END) / sum(cost)')} AS cost_share FROM sel GROUP BY portfolio_id",
    # portfolios
    "po02_budgeted_selection": "SELECT portfolio_id, unit_id, treatment_id, round(cost, 2) AS cost, round(pv, 2) AS pv FROM sel",
    "po09_excluded_projects": f"SELECT c.unit_id, c.treatment_id, round(c.cost, 2) AS cost, {_r('c.pv / c.cost')} AS bcr, 'NOT_SELECTED_IN_PORTFOLIO' AS reason FROM benefit c LEFT ANTI JOIN (SELECT unit_id, treatment_id FROM sel WHERE portfolio_id = 'PORT_OFF_BASE_B15M_EQ20') s ON c.unit_id = s.unit_id AND c.treatment_id = s.treatment_id WHERE c.scenario = 'BASE'",
    "po10_equity_mart": "SELECT portfolio_id, run_group, unc, budget, floor_share, round(cost, 2) AS cost, round(priority_spend, 2) AS priority_spend FROM summ",
    "po14_history_mart": f"SELECT unit_id, unit_name, grp, month_start, yr, mon, qtr, {', '.join(COUNTS)}, total_lag1, total_lag12, {_r('total_mean12')} AS total_mean12, model_split FROM feat",
    "po15_unit_master": f"SELECT u.unit_id, u.unit_name, u.grp, {_r('u.length_feet / 5280')} AS length_miles, h.total, {_r('f.total_forecast')} AS forecast, u.priority_area FROM units u LEFT JOIN hist h ON u.unit_id = h.unit_id LEFT JOIN annual f ON u.unit_id = f.unit_id",
    "po16_benefits_mart": f"SELECT unit_id, treatment_id, scenario AS scenario_level, {_r('averted')} AS averted, round(pv, 2) AS present_value FROM benefit",
    "po17_selections_mart": f"SELECT s.portfolio_id, s.run_group, s.unit_id, u.unit_name, s.treatment_id, round(s.cost, 2) AS cost, m.solver_status FROM sel s JOIN units u ON s.unit_id = u.unit_id LEFT JOIN summ m ON s.portfolio_id = m.portfolio_id",
    "po18_trend_mart": f"SELECT unit_id, yr, {_n('t')} AS total, {_n('s')} AS ksi, {_n('t - lag(t) OVER (PARTITION BY unit_id ORDER BY yr)')} AS total_change FROM (SELECT unit_id, yr, sum(total) AS t, sum(ksi) AS s FROM panel GROUP BY unit_id, yr)",
    "po19_unit_status": f"SELECT u.unit_id, CASE WHEN s.unit_id IS NULL THEN 'DEFERRED' ELSE 'SELECTED' END AS status, coalesce(s.treatment_id, 'No treatment selected') AS treatment, round(coalesce(s.cost, 0e0), 2) AS cost, {_r('coalesce(f.total_forecast, 0e0)')} AS forecast FROM units u LEFT JOIN (SELECT * FROM sel WHERE portfolio_id = 'PORT_OFF_BASE_B15M_EQ20') s ON u.unit_id = s.unit_id LEFT JOIN annual f ON u.unit_id = f.unit_id",
    "po20_export_unit_costs": f"SELECT s.portfolio_id, s.unit_id, s.treatment_id, {_r('s.cost / nullif(b.av_k + b.av_a, 0)')} AS cost_per_ksi, {_r('s.cost / nullif(b.averted, 0)')} AS cost_per_averted FROM sel s LEFT JOIN benefit b ON s.unit_id = b.unit_id AND s.treatment_id = b.treatment_id AND s.unc = b.scenario",
    "po21_averted_table": "WITH t AS (SELECT sum(b.av_k) AS k, sum(b.av_a) AS a, sum(b.av_b) AS b, sum(b.av_c) AS c, sum(b.av_o) AS o FROM sel s JOIN benefit b ON s.unit_id = b.unit_id AND s.treatment_id = b.treatment_id AND s.unc = b.scenario WHERE s.portfolio_id = 'PORT_OFF_BASE_B15M_EQ20') " + " UNION ALL ".join(f"SELECT '{c.upper()}' AS severity, {_r(c)} AS averted, {_r(f'{c} / (k + a + b + c + o)')} AS share FROM t" for c in "kabco"),
    "po23_next_budget_only": f"SELECT s.unit_id, {_n('row_number() OVER (ORDER BY round(s.bcr, 6) DESC, s.unit_id)')} AS position FROM sel s LEFT ANTI JOIN (SELECT unit_id FROM sel WHERE portfolio_id = 'PORT_OFF_BASE_B15M_EQ20') b ON s.unit_id = b.unit_id WHERE s.portfolio_id = 'PORT_OFF_BASE_B25M_EQ20'",
    # gates
    "va13_feature_parity": f"""WITH self AS (SELECT p.unit_id, p.month_start, avg(z.total) AS m12, count(z.total) AS n FROM panel p LEFT JOIN panel z ON z.unit_id = p.unit_id AND z.yr * 12 + z.mon BETWEEN p.yr * 12 + p.mon - 12 AND p.yr * 12 + p.mon - 1 GROUP BY p.unit_id, p.month_start)
        SELECT {_n('count(*)')} AS n, {_r('max(abs(f.total_mean12 - s.m12))')} AS max_mean_diff, {_n(_bad('(f.total_mean12 IS NULL) <> (s.n < 12)'))} AS null_mismatches FROM feat f JOIN self s ON f.unit_id = s.unit_id AND f.month_start = s.month_start""",
    "fi02_in_lists": f"SELECT s.portfolio_id, s.unit_id, s.portfolio_id IN ('PORT_OFF_BASE_B15M_EQ20', 'PORT_STR_BASE_B2M_EQ20') AS is_canonical, s.run_group NOT IN ('OFFICIAL', 'STRESS') AS other_group, s.treatment_id IN ('T1', 'T4') AS spot FROM sel s",
    # every unit asks for its own budget and floor, and gets the nearest portfolio of the grid
    "jo13_nearest_parameters": """WITH request AS (SELECT unit_id, sum(cost) * 9 AS budget, avg(CASE WHEN priority_area THEN 0.37e0 ELSE 0.21e0 END) AS floor_share FROM benefit GROUP BY unit_id)
        SELECT unit_id, portfolio_id FROM (SELECT r.unit_id, g.portfolio_id, row_number() OVER (PARTITION BY r.unit_id ORDER BY round(abs(g.budget - r.budget), 3), round(abs(g.floor_share - r.floor_share), 6), g.portfolio_id) AS rn FROM request r CROSS JOIN grid g WHERE g.run_group = 'GRID') WHERE rn = 1""",
    "po01_scenario_grid": f"SELECT g.portfolio_id, g.run_group, g.unc, {_r('g.budget')} AS budget, {_r('g.floor_share')} AS floor_share, {_n('c.n')} AS candidates, {_r('g.budget / c.cost')} AS budget_cover FROM grid g JOIN (SELECT scenario, count(*) AS n, sum(cost) AS cost FROM cand GROUP BY scenario) c ON c.scenario = g.unc",
    "mo14_annual_rollup": f"SELECT h.unit_id, {_r('total_forecast')} AS total_forecast, {_r('ksi_forecast')} AS ksi_forecast, {_r('total_forecast - h.total / s.years')} AS change_total, {_r('ksi_forecast - h.ksi / s.years')} AS change_ksi, {_n('rank() OVER (ORDER BY round(total_forecast, 6) DESC)')} AS rank_total, {_n('rank() OVER (ORDER BY round(ksi_forecast, 6) DESC)')} AS rank_ksi FROM annual f JOIN hist h ON f.unit_id = h.unit_id CROSS JOIN span s",
    # the second derivation goes by calendar, not by row; what later months hold must not matter
    "mo22_leakage": f"""WITH cut AS (SELECT unit_id, month_start, CASE WHEN yr >= 2000 THEN total * 7 + 3 ELSE total END AS total FROM panel), again AS (SELECT unit_id, month_start, lag(total, 1) OVER w AS lag1, CASE WHEN row_number() OVER w > 12 THEN avg(total) OVER (PARTITION BY unit_id ORDER BY month_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS mean12 FROM cut WINDOW w AS (PARTITION BY unit_id ORDER BY month_start))
        SELECT {_n('count(*)')} AS n, {_n(_bad('coalesce(f.total_lag1, -1) <> coalesce(p.total, -1)'))} AS lag_leaks, {_n(_bad('f.yr < 2000 AND (coalesce(f.total_lag1, -1) <> coalesce(a.lag1, -1) OR coalesce(abs(f.total_mean12 - a.mean12), 0) > 1e-9)'))} AS changed_by_future
        FROM feat f LEFT JOIN panel p ON p.unit_id = f.unit_id AND p.yr * 12 + p.mon = f.yr * 12 + f.mon - 1 JOIN again a ON a.unit_id = f.unit_id AND a.month_start = f.month_start""",
    "po12_budget_progression": f"""SELECT g.budget, {_n('count(DISTINCT s.unit_id)')} AS units, {_r('count(DISTINCT s.unit_id) / CAST(max(u.n) AS DOUBLE) * 100')} AS coverage_pct, round(sum(s.cost), 2) AS cost, round(sum(s.pv), 2) AS pv, round(sum({_ECONOMIC}), 2) AS economic_pv, {_r('sum(b.averted)')} AS averted,
        {_r('sum(CASE WHEN s.priority_area THEN s.cost ELSE 0e0 END) / sum(s.cost)')} AS priority_share FROM sel s JOIN grid g ON s.portfolio_id = g.portfolio_id JOIN benefit b ON b.unit_id = s.unit_id AND b.treatment_id = s.treatment_id AND b.scenario = s.unc CROSS JOIN (SELECT count(*) AS n FROM units) u WHERE g.run_group = 'GRID' AND g.portfolio_id LIKE '%EQ20' GROUP BY g.budget""",
    "po13_deferred": f"""WITH chosen AS (SELECT unit_id FROM sel WHERE portfolio_id = 'PORT_OFF_BASE_B15M_EQ20'), next_tier AS (SELECT unit_id FROM sel WHERE portfolio_id = 'PORT_OFF_BASE_B25M_EQ20'), best AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY round(bcr, 6) DESC, treatment_id) AS rn FROM cand WHERE scenario = 'BASE')
        SELECT b.unit_id, b.treatment_id, round(b.cost, 2) AS cost, {_r('b.cost / nullif(f.averted, 0)')} AS cost_per_averted, {_r('b.cost / nullif(f.av_k + f.av_a, 0)')} AS cost_per_ksi, n.unit_id IS NOT NULL AS funded_next FROM best b LEFT ANTI JOIN chosen c ON b.unit_id = c.unit_id LEFT JOIN next_tier n ON b.unit_id = n.unit_id
        JOIN benefit f ON f.unit_id = b.unit_id AND f.treatment_id = b.treatment_id AND f.scenario = b.scenario WHERE b.rn = 1""",
    "po22_recommended": f"""SELECT {_n('count(*)')} AS projects, round(sum(s.cost), 2) AS cost, round(sum(s.pv), 2) AS pv, {', '.join(f'{_r(f"sum(b.av_{c})")} AS av_{c}' for c in 'kabco')}, {_r('sum(s.pv) / sum(s.cost)')} AS bcr, round(sum({_ECONOMIC}), 2) AS economic_pv, {_r(f'sum({_ECONOMIC}) / sum(s.cost)')} AS economic_bcr,
        {_r('count(DISTINCT s.unit_id) / CAST(max(u.n) AS DOUBLE)')} AS coverage FROM sel s JOIN benefit b ON s.unit_id = b.unit_id AND s.treatment_id = b.treatment_id AND s.unc = b.scenario CROSS JOIN (SELECT count(*) AS n FROM units) u WHERE s.portfolio_id = 'PORT_OFF_BASE_B15M_EQ20'""",
    "va10_recount": f"""WITH a AS ({_figures('ev', 'count(*)', 'count(CASE WHEN severity IN (\'K\', \'A\') THEN 1 END)')}), b AS ({_figures('panel', 'sum(total)', 'sum(ksi)', 'WHERE total > 0')}) SELECT a.metric, a.v AS reported, b.v AS recounted, abs(a.v - b.v) <= 1e-12 AS passed FROM a JOIN b ON a.metric = b.metric""",
    "va11_relationships": f"""SELECT {_n('c.orphans')} AS orphans, {_r('1 - c.orphans / CAST(c.n AS DOUBLE)')} AS child_coverage, {_n('c.mismatches')} AS date_mismatches, {_n('p.childless')} AS childless, {_r('1 - p.childless / CAST(p.n AS DOUBLE)')} AS parent_coverage, {_n('p.most')} AS max_children
        FROM (SELECT count(*) AS n, count(CASE WHEN e.event_id IS NULL THEN 1 END) AS orphans, count(CASE WHEN x.child_date <> CAST(e.ts AS DATE) THEN 1 END) AS mismatches FROM child x LEFT JOIN ev e ON x.parent_id = e.event_id) c
        CROSS JOIN (SELECT count(*) AS n, count(CASE WHEN g.n IS NULL THEN 1 END) AS childless, max(g.n) AS most FROM ev e LEFT JOIN (SELECT parent_id, count(*) AS n FROM child GROUP BY parent_id) g ON g.parent_id = e.event_id) p""",
}
