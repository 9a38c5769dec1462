"""Queries of the panel, evaluation, portfolio and gate operators over the stand-in tables. Their oracles are the SQL texts, written apart from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import evaluate, models, order, panel, portfolio
from waymark.operators.gates import CRITICAL, WARNING, bad, gate, offences, repeated
from waymark.plans.statements import COUNTS, SEVERITIES, _bad, _n, _r
from waymark.plans.statements import gate as gate_sql
from waymark.proxy import Tables, mart

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UNIT, MONTH, BASE_YEAR = "unit_id", "month_start", 1995
SPLITS = (1995, 1999, 2000, 2001)
# Costs of an event by severity, and those that count economic loss alone.
UNIT_COSTS = {"k": 15988000.0, "a": 1705100.0, "b": 384000.0, "c": 204600.0, "o": 18100.0}
ECONOMIC_COSTS = {"k": 2000000.0, "a": 170000.0, "b": 60000.0, "c": 40000.0, "o": 12000.0}
CAPPED, CAP = "T2", 0.7
CANONICAL = [f"PORT_OFF_{u}_B15M_EQ20" for u in ("CONSERVATIVE", "BASE", "OPTIMISTIC")]
DEFAULT = "PORT_OFF_BASE_B15M_EQ20"


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def r6(c) -> F.Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def money(c) -> F.Column:
    return F.round(c, 2).alias(c) if isinstance(c, str) else F.round(c, 2)


# what statements read
@mart("panel")
def panel_of(t: Tables) -> DataFrame:
    return panel.build_panel(t.view("units").drop("priority_area"), t.view("ev"), UNIT, MONTH, "severity")


@mart("clock")
def clock_of(t: Tables) -> DataFrame:
    """Calendar and severity components of every event, each found in two ways."""
    e = t.view("ev")
    known = F.col("severity").isin(*"KABCO")
    return e.select(
        "event_id", F.dayofweek("ts").alias("day_of_week"), (F.datediff(F.col("ts").cast("date"), F.lit("1995-01-01").cast("date")) % 7 + 1).alias("weekday_again"), F.hour("ts").alias("hour_of_day"),
        *[(F.col("severity") == x).cast("int").alias(x.lower()) for x in "KABCO"], (~known).cast("int").alias("u"), F.lit(1).alias("n"),
    )


@mart("forecast")
def forecast_of(t: Tables) -> DataFrame:
    factor = evaluate.calibration_factors(t.sql("SELECT * FROM pred WHERE model_split = 'validation' AND target = 'ksi' AND model = 'rolling_mean12'"), ["target"]).select("factor")
    return models.recursive_calibrated_forecast(t.view("panel"), UNIT, MONTH, "total", "ksi", factor)


@mart("benefit")
def benefit_of(t: Tables) -> DataFrame:
    units = t.sql("""SELECT h.unit_id, h.unit_name, h.priority_area, h.length_miles, f.total_forecast, p.sub_share, s.ksi / CAST(s.total AS DOUBLE) AS p_severe, s.share_k, s.share_a, s.share_b, s.share_c, s.share_o
        FROM hist h JOIN shares s ON h.unit_id = s.unit_id JOIN annual f ON h.unit_id = f.unit_id JOIN posterior p ON h.unit_id = p.unit_id""")
    d = portfolio.benefits(units, t.view("treatment").withColumn("per_mile", F.col("treatment_id") == CAPPED), UNIT_COSTS)
    outside = (F.col("treatment_id") == CAPPED) & (F.col("unit_id") % 5 == 0)
    return d.select(
        "unit_id", "unit_name", "treatment_id", "scenario", "priority_area", "exposure_share", "cmf", "life_years", "averted", *[f"av_{x}" for x in "kabco"], "quantity", "cost", "annual_benefit", "pv", F.when(outside, "NOT_APPLICABLE").otherwise("UNKNOWN").alias("applicability")
    )


def grid_of(t: Tables) -> DataFrame:
    return t.view("grid").withColumnRenamed("unc", "scenario")


@mart("options")
def options_of(t: Tables) -> DataFrame:
    return portfolio.unit_options(t.view("cand").drop("bcr"))


@mart("dual")
def dual_of(t: Tables) -> DataFrame:
    return portfolio.multipliers(t.view("options"), grid_of(t), CAPPED, CAP)


@mart("solved")
def solved_of(t: Tables) -> DataFrame:
    return portfolio.solve(t.view("options"), t.view("dual"), CAPPED, CAP)


@mart("sel")
def selections_of(t: Tables) -> DataFrame:
    s = portfolio.selections(t.view("options"), t.view("dual"), t.view("solved"), CAPPED, CAP)
    return s.join(portfolio.small_side(t.view("grid").select("portfolio_id", "run_group", "unc")), "portfolio_id")


def features_of(t: Tables) -> DataFrame:
    f = panel.build_features(t.view("panel"), UNIT, MONTH, ["total", "ksi"], BASE_YEAR)
    return f.withColumn("model_split", panel.split_label(F.col("yr"), *SPLITS))


# panel
@query(f"SELECT unit_id, month_start, {', '.join(f'{_n(c)} AS {c}' for c in (*SEVERITIES, 'total'))}, {_n('k + a')} AS ksi FROM counts")
def ag01_severity_pivot(t):
    return panel.severity_counts(t.view("ev"), [UNIT, MONTH], "severity", "KABCOU", "KA")


@query("SELECT unit_id, month_start, k, total FROM panel")
def jo02_left_zero_fill(t):
    counts = panel.severity_counts(t.view("ev"), [UNIT, MONTH], "severity", "KABCOU", "KA")
    grid = t.view("units").select(UNIT).crossJoin(F.broadcast(panel.month_grid(t.view("ev")).select(MONTH)))
    return panel.zero_filled(grid, counts, [UNIT, MONTH], ["k", "total"])


@query("SELECT u.unit_id, m.month_start FROM units u CROSS JOIN months m")
def jo03_cross_grid(t):
    return t.view("units").select(UNIT).crossJoin(F.broadcast(panel.month_grid(t.view("ev")).select(MONTH)))


def _statement(name):
    from waymark.plans.statements import STATEMENTS

    return STATEMENTS[name]


@query(_statement("cl14_split_label"))
def cl14_split_label(t):
    return t.view("panel").select(UNIT, MONTH, panel.split_label(F.col("yr"), *SPLITS).alias("model_split"))


@query(_statement("wi01_lags"))
def wi01_lags(t):
    names = [f"{v}_lag{k}" for v in ("total", "ksi") for k in panel.LAGS]
    return panel.with_lags(t.view("panel"), UNIT, MONTH, ["total", "ksi"], panel.LAGS).select(UNIT, MONTH, *names)


@query(_statement("wi02_trailing_means"))
def wi02_trailing_means(t):
    names = [f"{v}_mean{n}" for v in ("total", "ksi") for n in panel.FRAMES]
    return panel.with_trailing(t.view("panel"), UNIT, MONTH, ["total", "ksi"], panel.FRAMES, "mean").select(UNIT, MONTH, *[r6(n).alias(n) for n in names])


@query(_statement("wi03_trailing_sums"))
def wi03_trailing_sums(t):
    names = [f"{v}_sum{n}" for v in ("total", "ksi") for n in panel.FRAMES]
    return panel.with_trailing(t.view("panel"), UNIT, MONTH, ["total", "ksi"], panel.FRAMES, "sum").select(UNIT, MONTH, *names)


@query(_statement("wi04_history"))
def wi04_history(t):
    return panel.with_history(t.view("panel"), UNIT, MONTH).select(UNIT, MONTH, F.col("history").cast("long").alias("history"), "model_ready")


@query(_statement("wi12_first_last_year"))
def wi12_first_last_year(t):
    return panel.trend(t.view("panel"), UNIT, MONTH, "total").select(UNIT, *[r6(c).alias(c) for c in ("first_mean", "last_mean", "change_pct")])


@query(_statement("wi13_slope"))
def wi13_slope(t):
    return panel.trend(t.view("panel"), UNIT, MONTH, "total").select(UNIT, r6("slope").alias("slope"))


@query(_statement("wi14_trend_class"))
def wi14_trend_class(t):
    return panel.trend(t.view("panel"), UNIT, MONTH, "total").select(UNIT, "trend")


@query(_statement("wi15_three_sigma"))
def wi15_three_sigma(t):
    return panel.anomalies(t.view("panel"), UNIT, "total").select(UNIT, MONTH, "total", r6("excess").alias("excess"))


@query(_statement("wi17_spearman"))
def wi17_spearman(t):
    return panel.spearman(t.view("hist"), "total", "ksi").select(r6("spearman").alias("spearman"), F.col("max_rank_difference").cast("long").alias("max_rank_difference"))


@query(_statement("wi08_two_rankings"))
def wi08_two_rankings(t):
    a = t.view("annual").select(UNIT, F.round("total_forecast", 6).alias("x"), F.round("ksi_forecast", 6).alias("y"))
    return order.with_ranks(a, [], {"total": "x", "ksi": "y"}).select(UNIT, F.col("total_down").alias("rank_total"), F.col("ksi_down").alias("rank_ksi"))


@query(_statement("wi09_rank_percentile"))
def wi09_rank_percentile(t):
    """Positions without ties: equal forecasts are told apart by the unit."""
    a = t.view("annual").select(UNIT, F.struct((-F.round("ksi_forecast", 6)).alias("v"), UNIT).alias("place"))
    r = order.with_ranks(a, [], {"p": "place"})
    return r.select(UNIT, F.col("p_up").alias("position"), r6(1 - (F.col("p_up") - 1) / F.col("p_total")).alias("percentile"))


@query(_statement("mo18_rank_agreement"))
def mo18_rank_agreement(t):
    j = t.view("annual").select(UNIT, F.round("ksi_forecast", 6).alias("x")).join(t.view("hist").select(UNIT, "ksi"), UNIT)
    return panel.spearman(j, "x", "ksi").select(r6("spearman").alias("spearman"), F.col("max_rank_difference").cast("long").alias("max_rank_difference"))


# evaluation
_RANKED = "SELECT *, rank() OVER (PARTITION BY target, model, model_split ORDER BY x) + (count(*) OVER (PARTITION BY target, model, model_split, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY target, model, model_split ORDER BY y) + (count(*) OVER (PARTITION BY target, model, model_split, y) - 1) / 2e0 AS ry FROM (SELECT target, model, model_split, unit_id, round(sum(actual), 6) AS x, round(sum(predicted), 6) AS y, sum(actual) AS ax, sum(predicted) AS px FROM pred GROUP BY target, model, model_split, unit_id)"
_SUITE = ("mae", "rmse", "deviance", "bias", "calibration")


@query(f"SELECT m.target, m.model, m.model_split, {_n('n')} AS n, {', '.join(f'{_r(c)} AS {c}' for c in _SUITE)}, {_r('a')} AS actual_total, {_r('p')} AS predicted_total, {_r('s')} AS spearman FROM metric m JOIN (SELECT target, model, model_split, sum(ax) AS a, sum(px) AS p, corr(rx, ry) AS s FROM ({_RANKED}) GROUP BY target, model, model_split) r ON m.target = r.target AND m.model = r.model AND m.model_split = r.model_split")
def mo06_metric_suite(t):
    m = evaluate.metric_suite(t.view("pred"), ["target", "model", "model_split"], UNIT)
    return m.select("target", "model", "model_split", "n", *[r6(c).alias(c) for c in (*_SUITE, "actual_total", "predicted_total", "spearman")])


def _naive(t):
    return evaluate.metric_suite(t.view("pred"), ["target", "model", "model_split"], UNIT)


@query(_statement("mo07_winner"))
def mo07_winner(t):
    return evaluate.winners(_naive(t).filter("model_split = 'validation'"), "target", "model").select("target", "model", r6("deviance").alias("deviance"), "is_winner")


@query(_statement("mo09_comparison"))
def mo09_comparison(t):
    return evaluate.comparison(_naive(t)).select("target", "model", *[r6(c).alias(c) for c in ("validation_deviance", "test_deviance", "test_mae")])


@query()
def mo09_fitted_comparison(t):
    """Validation deviance of the naive and the fitted models, and test figures of each target's winner alone."""
    rows, pred = modelling(t), t.view("pred").filter("model_split in ('validation', 'test')")
    for target in ("total", "ksi"):
        for name, m in fitted(rows.filter("model_split = 'train'"), target).items():
            pred = pred.unionByName(_scored(m, rows.filter("model_split in ('validation', 'test')"), target, name))
    m = evaluate.comparison(evaluate.metric_suite(pred, ["target", "model", "model_split"], UNIT))
    return m.select("target", "model", "is_winner", *[r6(c).alias(c) for c in ("validation_deviance", "test_deviance", "test_mae")])


@query()
def va15_fitted_outputs(t):
    """The gate of model outputs over the fitted models' predictions: finite, one row a key, actuals as in the panel, no prediction for a row that is not scored."""
    rows, pred = modelling(t), None
    for target in ("total", "ksi"):
        for name, m in fitted(rows.filter("model_split = 'train'"), target).items():
            p = _scored(m, rows.filter("model_split in ('validation', 'test')"), target, name)
            pred = p if pred is None else pred.unionByName(p)
    seen = t.view("panel").select(F.col(UNIT).alias("u"), F.col(MONTH).alias("m"), F.col("total").alias("p_total"), F.col("ksi").alias("p_ksi"))
    j = pred.join(seen, (F.col(UNIT) == F.col("u")) & (F.col(MONTH) == F.col("m")), "left").withColumn("found", F.when(F.col("target") == "total", F.col("p_total")).otherwise(F.col("p_ksi")))
    wanted = rows.filter("model_split in ('validation', 'test')").agg((4 * F.count("*")).alias("wanted"))
    return gate(offences(j.crossJoin(F.broadcast(wanted)), {
        "finite": (CRITICAL, bad("predicted is null or isnan(predicted) or predicted < 0 or predicted > 1e300")), "duplicate_key": (CRITICAL, repeated(UNIT, MONTH, "target", "model")), "actuals": (CRITICAL, bad("found is null or actual <> found")), "rows": (CRITICAL, F.abs(F.max("wanted") - F.count("*"))),
    }))


@query(_statement("mo10_calibration_factor"))
def mo10_calibration_factor(t):
    return evaluate.calibration_factors(t.view("pred").filter("model_split = 'validation'"), ["target", "model"]).select("target", "model", r6("factor").alias("factor"))


_DIRECTION = ", ".join(f"{_r(f'abs({x}.prd - {x}.act)')} AS error_{x}, {_r(f'abs({x}.prd - {x}.act) / nullif({x}.act, 0) * 100')} AS error_pct_{x}, CASE WHEN round({x}.prd - {x}.act, 6) > 0 THEN 'over' ELSE 'under' END AS direction_{x}" for x in "vt")


@query(f"""WITH e AS (SELECT unit_id, model_split, sum(actual) AS act, sum(predicted) AS prd, avg(abs(actual - predicted)) AS mae FROM pred WHERE target = 'total' AND model = 'rolling_mean12' AND model_split IN ('validation', 'test') GROUP BY unit_id, model_split)
    SELECT v.unit_id, {_r('v.act')} AS actual_v, {_r('v.prd')} AS predicted_v, {_r('v.mae')} AS mae_v, {_r('t.act')} AS actual_t, {_r('t.prd')} AS predicted_t, {_r('t.mae')} AS mae_t, {_DIRECTION}, {_r('abs(v.prd - v.act) + abs(t.prd - t.act)')} AS combined_error,
    row_number() OVER (ORDER BY round(abs(v.prd - v.act) + abs(t.prd - t.act), 6) DESC, v.unit_id) <= 3 AS among_worst FROM e v JOIN e t ON v.unit_id = t.unit_id AND v.model_split = 'validation' AND t.model_split = 'test'""")
def mo19_hindsight(t):
    h = evaluate.hindsight(t.view("pred").filter("target = 'total' and model = 'rolling_mean12'"), UNIT, "model_split", "validation", "test")
    figures = [f"{c}_{x}" for x in "vt" for c in ("actual", "predicted", "mae", "error", "error_pct")] + ["combined_error"]
    return h.select(UNIT, *[r6(c).alias(c) for c in figures], "direction_v", "direction_t", "among_worst")


NUMERIC, CATEGORIES = panel.feature_names(["total", "ksi"]), ["unit", "grp"]


def modelling(t: Tables) -> DataFrame:
    from waymark.functions.storage import cut_lineage

    f = features_of(t).filter("model_ready").withColumn("unit", F.col(UNIT).cast("string"))
    return cut_lineage(f.select(UNIT, MONTH, "model_split", *CATEGORIES, *[F.col(c).cast("double").alias(c) for c in ("total", "ksi")], *[F.col(c).cast("double").alias(c) for c in NUMERIC]), "modelling")


def fitted(rows: DataFrame, target: str) -> dict[str, models.FittedModel]:
    return {"negative_binomial": models.fit_negative_binomial(rows, target, NUMERIC, CATEGORIES), "poisson_regression": models.fit_poisson(rows, target, NUMERIC, CATEGORIES)}


def _scored(model, rows: DataFrame, target: str, name: str) -> DataFrame:
    return model.predict(rows).select(UNIT, MONTH, "model_split", F.lit(target).alias("target"), F.lit(name).alias("model"), F.col(target).alias("actual"), "predicted")


@query()
def mo03_poisson_regression(t):
    rows = modelling(t)
    m = models.fit_poisson(rows.filter("model_split = 'train'"), "total", NUMERIC, CATEGORIES)
    return _scored(m, rows.filter("model_split = 'validation'"), "total", "poisson_regression").select(UNIT, MONTH, r6("actual").alias("actual"), r6("predicted").alias("predicted"))


@query()
def mo04_negative_binomial(t):
    rows = modelling(t)
    m = models.fit_negative_binomial(rows.filter("model_split = 'train'"), "total", NUMERIC, CATEGORIES)
    return _scored(m, rows.filter("model_split = 'validation'"), "total", "negative_binomial").select(UNIT, MONTH, r6("actual").alias("actual"), r6("predicted").alias("predicted"))


def competition(t: Tables, rows: DataFrame, target: str) -> DataFrame:
    """Metrics on the validation split of the two naive and the two fitted models."""
    held = rows.filter("model_split = 'validation'")
    naive = t.view("pred").filter((F.col("model_split") == "validation") & (F.col("target") == target))
    for name, m in fitted(rows.filter("model_split = 'train'"), target).items():
        naive = naive.unionByName(_scored(m, held, target, name))
    return evaluate.metric_suite(naive, ["target", "model", "model_split"], UNIT)


def _both(t: Tables) -> DataFrame:
    rows = modelling(t)
    return competition(t, rows, "total").unionByName(competition(t, rows, "ksi"))


@query()
def mo07_fitted_competition(t):
    return evaluate.winners(_both(t), "target", "model").select("target", "model", r6("deviance").alias("deviance"), r6("spearman").alias("spearman"), "is_winner")


@query()
def mo08_refit_test(t):
    """The winner of each target, fitted again on training and validation rows if it is a fitted one, scored once on the test rows."""
    rows, out = modelling(t), None
    for target in ("total", "ksi"):
        name = evaluate.winners(competition(t, rows, target), "target", "model").filter("is_winner").first().model
        if name in ("negative_binomial", "poisson_regression"):
            known = rows.filter("model_split in ('train', 'validation')")
            fit = models.fit_poisson if name == "poisson_regression" else models.fit_negative_binomial
            scored = _scored(fit(known, target, NUMERIC, CATEGORIES), rows.filter("model_split = 'test'"), target, name)
        else:
            scored = t.view("pred").filter((F.col("model_split") == "test") & (F.col("target") == target) & (F.col("model") == name))
        out = scored if out is None else out.unionByName(scored)
    m = evaluate.metric_suite(out, ["target", "model", "model_split"], UNIT)
    return m.select("target", "model", "n", *[r6(c).alias(c) for c in (*_SUITE, "spearman")])


@query("SELECT unit_id, step, round(total, 6) AS forecast FROM forecast")
def mo12_recursive_mean(t):
    return models.recursive_mean_forecast(t.view("panel"), "total").select(UNIT, "step", r6("forecast").alias("forecast"))


@query("SELECT unit_id, step, round(total, 6) AS total, round(raw, 6) AS raw, round(ksi, 6) AS ksi FROM forecast")
def mo13_recursive_calibrated(t):
    return t.view("forecast").select(UNIT, "step", *[r6(c).alias(c) for c in ("total", "raw", "ksi")])


@query()
def mo13_recursive_model(t):
    """The fitted model in the recursion, calibrated on the validation year."""
    rows = modelling(t)
    first = models.fit_poisson(rows.filter("model_split = 'train'"), "ksi", NUMERIC, CATEGORIES)
    factor = evaluate.calibration_factors(_scored(first, rows.filter("model_split = 'validation'"), "ksi", "p"), ["target"]).first().factor
    m = models.fit_poisson(rows.filter("model_split in ('train', 'validation')"), "ksi", NUMERIC, CATEGORIES)
    p = t.view("panel").withColumn("unit", F.col(UNIT).cast("string"))
    f = models.recursive_model_forecast(p, m.predict, factor, "unit", MONTH, "total", "ksi", "grp", BASE_YEAR)
    return f.select(F.col("unit").cast("bigint").alias(UNIT), "step", r6("raw").alias("raw"), r6("ksi").alias("forecast"), r6("total").alias("total"))


@query()
def mo21_coefficients(t):
    """Lags and means: sums are multiples of means, so that with them there are no standard errors."""
    rows = modelling(t).filter("model_split = 'train'")
    numeric = [c for c in NUMERIC if "_sum" not in c]
    m = models.fit_poisson(rows, "total", numeric, ["grp"], reg=0.0)
    return models.coefficient_table(m, rows).select("term", *[r6(c).alias(c) for c in ("coefficient", "std_error", "p_value", "rate_ratio")])


_EB = "SELECT h.unit_id, h.ksi, h.length_miles, s.years * h.length_miles AS ex, s.years FROM hist h CROSS JOIN span s"


@query(f"SELECT {_r('CASE WHEN v > 0 AND m > 0 THEN m * m / v ELSE 1 END')} AS alpha0, {_r('CASE WHEN v > 0 AND m > 0 THEN m / v ELSE 1 END')} AS beta0 FROM (SELECT avg(ksi / ex) AS m, var_samp(ksi / ex) AS v FROM ({_EB}))")
def mo15_eb_moments(t):
    return evaluate.gamma_moments(t.sql(_EB), "ksi", "ex").select(r6("alpha").alias("alpha0"), r6("beta").alias("beta0"))


@query(f"SELECT unit_id, {_r('(z.m * z.m / z.v + ksi) / (z.m / z.v + ex) * length_miles')} AS eb, {_r('ksi / years')} AS plain FROM ({_EB}) h CROSS JOIN (SELECT avg(ksi / ex) AS m, var_samp(ksi / ex) AS v FROM ({_EB})) z")
def mo17_eb_posterior(t):
    u = t.sql(_EB)
    return evaluate.gamma_posterior(u, evaluate.gamma_moments(u, "ksi", "ex"), "ksi", "ex").select(UNIT, r6(F.col("rate") * F.col("length_miles")).alias("eb"), r6(F.col("ksi") / F.col("years")).alias("plain"))


# the oracle closes in on the optimum by a grid of 81 points around the last best one, over the logarithms of shape and mean
@query(f"""SELECT * FROM (WITH RECURSIVE u AS MATERIALIZED (SELECT ksi AS y, ex AS e FROM ({_EB})), g AS (SELECT ln(m * m / v) AS p, ln(m) AS q, CAST(1 AS DOUBLE) AS h, 0 AS rnd, CAST(0 AS DOUBLE) AS nll FROM (SELECT avg(y / e) AS m, var_samp(y / e) AS v FROM u)
    UNION ALL SELECT p, q, h * 0.6, rnd + 1, nll FROM (SELECT p, q, h, rnd, nll, row_number() OVER (ORDER BY nll) AS rn FROM (SELECT p, q, h, rnd, -sum(lgamma(exp(p) + y) - lgamma(exp(p)) + exp(p) * (p - q) - (exp(p) + y) * ln(exp(p - q) + e)) AS nll
    FROM (SELECT p + h * a.i / 4 AS p, q + h * b.i / 4 AS q, h, rnd FROM g CROSS JOIN generate_series(-4, 4) AS a(i) CROSS JOIN generate_series(-4, 4) AS b(i) WHERE rnd < 45) CROSS JOIN u GROUP BY p, q, h, rnd)) WHERE rn = 1)
    SELECT round(exp(p), 3) AS alpha, round(exp(p - q), 3) AS beta, round(nll, 6) AS nll FROM g WHERE rnd = 45) z""")
def mo16_eb_likelihood(t):
    f = models.fit_gamma_poisson(t.sql(f"SELECT ksi AS y, ex AS exposure FROM ({_EB})"))
    return f.select(F.round("alpha", 3).alias("alpha"), F.round("beta", 3).alias("beta"), r6("nll").alias("nll"))


# shrinkage, benefit and cost
@query(_statement("bc02_subgroup_shrinkage"))
def bc02_subgroup_shrinkage(t):
    from waymark.plans.statements import _hist_sub

    h = t.sql(_hist_sub).withColumn("severe", F.col("k") + F.col("a"))
    return evaluate.shrunk(h, "k", "severe", 10.0, "share", 0.1).select(UNIT, r6("share").alias("sub_share_k"))


@query(_statement("bc03_beta_binomial"))
def bc03_beta_binomial(t):
    u = t.sql("SELECT h.unit_id, coalesce(s.n, 0) AS n_sub, h.total FROM hist h LEFT JOIN subgroup s ON h.unit_id = s.unit_id")
    return evaluate.beta_binomial(u, "n_sub", "total", 50.0, "share").select(UNIT, F.col("n_sub").cast("long").alias("n_sub"), r6("share").alias("sub_share"))


@query(_statement("bc06_bounded_cmf"))
def bc06_bounded_cmf(t):
    return t.view("treatment").select("treatment_id", "scenario", r6(portfolio.bounded_cmf(F.col("cmf_point"), F.col("cmf_se"), F.col("scenario"))).alias("cmf")).distinct()


@query(f"SELECT unit_id, treatment_id, scenario, {_r('(1 - power(1.03e0, -life_years)) / 0.03e0')} AS pv_factor, round(annual_benefit * (1 - power(1.03e0, -life_years)) / 0.03e0, 2) AS present_value FROM benefit")
def bc09_annuity(t):
    return t.view("benefit").select(UNIT, "treatment_id", "scenario", r6(portfolio.annuity(F.col("life_years"))).alias("pv_factor"), money(F.col("annual_benefit") * portfolio.annuity(F.col("life_years"))).alias("present_value"))


# portfolios
@query("""SELECT s.portfolio_id, round(s.pv, 2) AS achieved, round(u.upper_bound, 2) AS upper_bound, round(u.upper_bound - s.pv, 2) AS gap FROM summ s JOIN ceiling u ON s.portfolio_id = u.portfolio_id""")
def po03_optimality_gap(t):
    b = t.view("solved").select("portfolio_id", "upper_bound")
    return summary_of(t).join(b, "portfolio_id").select("portfolio_id", money(F.col("pv")).alias("achieved"), money("upper_bound"), money(F.col("upper_bound") - F.col("pv")).alias("gap"))


def summary_of(t: Tables) -> DataFrame:
    return portfolio.summarize(t.view("grid"), t.view("sel"), CAPPED)


@query(f"""SELECT m.portfolio_id, solver_status, {_n('projects')} AS projects, round(cost, 2) AS cost, round(slack, 2) AS slack, {_r('utilization_pct')} AS utilization_pct, round(pv, 2) AS pv, round(npv, 2) AS npv, {_r('bcr')} AS bcr, {_r('max_bcr')} AS max_bcr,
    round(priority_spend, 2) AS priority_spend, {_r('coalesce(priority_spend / nullif(cost, 0), 0e0)')} AS priority_share, {_n('capped')} AS capped, {_r('coalesce(capped / nullif(CAST(projects AS DOUBLE), 0), 0e0)')} AS capped_share, round(coalesce(c.spend, 0e0), 2) AS capped_spend
    FROM summ m LEFT JOIN (SELECT portfolio_id, sum(cost) AS spend FROM sel WHERE treatment_id = 'T2' GROUP BY portfolio_id) c ON m.portfolio_id = c.portfolio_id""")
def po04_summary(t):
    return summary_of(t).select("portfolio_id", "solver_status", "projects", *[money(c) for c in ("cost", "slack", "pv", "npv", "priority_spend", "capped_spend")], *[r6(c).alias(c) for c in ("utilization_pct", "bcr", "max_bcr", "priority_share", "capped_share")], "capped")


_CLASSES = """left_over AS (SELECT g.portfolio_id, min(c.cost) AS cheapest, count(c.unit_id) AS n FROM grid g JOIN cand c ON c.scenario = g.unc LEFT ANTI JOIN sel s ON s.portfolio_id = g.portfolio_id AND s.unit_id = c.unit_id GROUP BY g.portfolio_id),
    classes AS (SELECT m.portfolio_id, CASE WHEN l.n IS NULL THEN 'NONBINDING_CEILING' WHEN m.slack < l.cheapest - 1e-6 THEN 'EFFECTIVELY_BINDING' WHEN abs(m.slack) <= 1e-6 THEN 'BINDING_NUMERIC_TOLERANCE' ELSE 'SLACK' END AS budget_class,
    CASE WHEN abs(coalesce(priority_spend / nullif(cost, 0), 0e0) - floor_share) <= 1e-6 THEN 'BINDING' ELSE 'SLACK' END AS equity_class FROM summ m LEFT JOIN left_over l ON m.portfolio_id = l.portfolio_id)"""


def _classes(t):
    return portfolio.constraint_classes(summary_of(t).withColumnRenamed("unc", "scenario"), t.view("sel"), t.view("cand"))


@query(f"WITH {_CLASSES} SELECT portfolio_id, budget_class FROM classes")
def po05_budget_binding(t):
    return _classes(t).select("portfolio_id", "budget_class")


@query(f"WITH {_CLASSES} SELECT portfolio_id, equity_class, CASE WHEN budget_class NOT IN ('NONBINDING_CEILING', 'SLACK') THEN 'BUDGET (' || budget_class || ')' WHEN equity_class = 'BINDING' THEN 'EQUITY (BINDING)' ELSE 'NONE (' || budget_class || ')' END AS limiting FROM classes")
def po06_equity_binding(t):
    return _classes(t).select("portfolio_id", "equity_class", "limiting")


@query("""SELECT a.portfolio_id, b.selection_hash, b.selection_hash = a.selection_hash AS same FROM (SELECT portfolio_id, sha256(string_agg(k, '|' ORDER BY k)) AS selection_hash FROM (SELECT portfolio_id, CAST(unit_id AS STRING) || '_' || treatment_id AS k FROM sel) GROUP BY portfolio_id) a
    JOIN (SELECT portfolio_id, sha256(string_agg(k, '|' ORDER BY k)) AS selection_hash FROM (SELECT portfolio_id, CAST(unit_id AS STRING) || '_' || treatment_id AS k FROM sel) GROUP BY portfolio_id) b ON a.portfolio_id = b.portfolio_id""")
def po07_determinism(t):
    """Two runs from the tables on, the second with its candidates in another order and partitioning."""
    from waymark.operators.clean import fingerprint

    key = F.concat_ws("_", "unit_id", "treatment_id")
    cand = benefit_of(t).filter("applicability <> 'NOT_APPLICABLE' and pv / cost >= 1").repartition(7, "cost").select("unit_id", "treatment_id", "scenario", "priority_area", "cost", "pv")
    options = portfolio.unit_options(cand)
    duals = portfolio.multipliers(options, grid_of(t), CAPPED, CAP)
    again = portfolio.selections(options, duals, portfolio.solve(options, duals, CAPPED, CAP), CAPPED, CAP)
    two = fingerprint(again, ["portfolio_id"], key, "again")
    return fingerprint(t.view("sel"), ["portfolio_id"], key).join(two, "portfolio_id", "full_outer").select("portfolio_id", "selection_hash", F.coalesce(F.col("selection_hash") == F.col("again"), F.lit(False)).alias("same"))


@query(f"""WITH h AS (SELECT portfolio_id, sha256(string_agg(k, '|' ORDER BY k)) AS x FROM (SELECT portfolio_id, CAST(unit_id AS STRING) || '_' || treatment_id AS k FROM sel) GROUP BY portfolio_id)
    SELECT m.portfolio_id, {_n("count(*) OVER (PARTITION BY run_group, unc, coalesce(x, 'none'))")} AS equivalent, m.portfolio_id IN ({', '.join(f"'{c}'" for c in CANONICAL)}) AS is_canonical, m.portfolio_id = '{DEFAULT}' AS is_default FROM summ m LEFT JOIN h ON m.portfolio_id = h.portfolio_id""")
def po08_equivalence_groups(t):
    return portfolio.equivalence_groups(t.view("grid"), t.view("sel"), ["run_group", "unc"], CANONICAL, DEFAULT).select("portfolio_id", "equivalent", "is_canonical", "is_default")


_SCOPES = {"OFFICIAL": "run_group = 'OFFICIAL'", "CANONICAL": f"portfolio_id IN ({', '.join(f"'{c}'" for c in CANONICAL)})", "ALL": "1 = 1", "STRESS": "run_group = 'STRESS'"}


@query(" UNION ALL ".join(f"""SELECT '{s}' AS scope, unit_id, {_n('n')} AS scenarios, {_r('n / CAST(every AS DOUBLE)')} AS rate, CASE WHEN n / CAST(every AS DOUBLE) >= 0.7e0 THEN 'HIGH' WHEN n / CAST(every AS DOUBLE) >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
    'Selected in ' || CAST(n AS STRING) || ' of ' || CAST(every AS STRING) || ' scenarios' AS label FROM (SELECT unit_id, count(DISTINCT portfolio_id) AS n, (SELECT count(*) FROM grid WHERE {c}) AS every FROM sel WHERE {c} GROUP BY unit_id)""" for s, c in _SCOPES.items()))
def po11_stability(t):
    out = None
    for s, c in _SCOPES.items():
        one = portfolio.stability(t.view("sel"), t.view("grid"), F.expr(c)).select(F.lit(s).alias("scope"), UNIT, "scenarios", r6("rate").alias("rate"), "tier", "label")
        out = one if out is None else out.unionByName(one)
    return out


# gates: the operator's rows against the SQL text's
def _sql_rows(*parts: tuple[str, dict[str, tuple[str, str]]]) -> str:
    """Check rows of several views with one status."""
    aggs = ", ".join(f"agg{i} AS (SELECT {', '.join(f'{_n(f'coalesce({sql}, 0)')} AS c{k}' for k, (_, sql) in enumerate(checks.values()))} FROM {v})" for i, (v, checks) in enumerate(parts))
    rows = " UNION ALL ".join(f"SELECT '{name}' AS check_name, '{sev}' AS severity, c{k} = 0 AS passed, c{k} AS evidence FROM agg{i}" for i, (_, checks) in enumerate(parts) for k, (name, (sev, _)) in enumerate(checks.items()))
    return f"WITH {aggs}, rows AS ({rows}) SELECT check_name, severity, passed, evidence, (SELECT CASE WHEN count(CASE WHEN severity = 'CRITICAL' AND NOT passed THEN 1 END) > 0 THEN 'FAIL' WHEN count(CASE WHEN NOT passed THEN 1 END) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END FROM rows) AS status FROM rows"


PARTS: dict[str, list[tuple[str, dict[str, tuple[str, str]], dict[str, tuple[str, F.Column]]]]] = {}


def gate_query(name: str, *parts: tuple[str, dict[str, tuple[str, str, Callable[[], F.Column]]]]) -> None:
    """A gate over views: each check has a severity, the oracle's count of offences, and the operator's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return gate(*[offences(t.sql(f"SELECT * FROM {v}"), {n: (s, c()) for n, (s, _, c) in checks.items()}) for v, checks in parts])

    QUERIES[name] = run
    ORACLES[name] = _sql_rows(*[(v, {n: (s, q) for n, (s, q, _) in checks.items()}) for v, checks in parts])


def rule(severity: str, condition: str) -> tuple[str, str, Callable[[], F.Column]]:
    """Rows for which a condition holds are offences."""
    return severity, _bad(condition), lambda: bad(condition)


def unique(*keys: str) -> tuple[str, str, Callable[[], F.Column]]:
    return CRITICAL, "count(*) - count(DISTINCT " + " || '|' || ".join(f"CAST({k} AS STRING)" for k in keys) + ")", lambda: repeated(*keys)


gate_query("va01_check_status", ("raw", {"blank_injury": rule(WARNING, "trim(injury) = ''"), "bad_flag": rule(WARNING, "upper(trim(flag)) NOT IN ('Y', 'N', '')"), "null_key": rule(CRITICAL, "record_id IS NULL")}))
_CELLS = "(SELECT count(*) AS n FROM units CROSS JOIN months) g CROSS JOIN (SELECT count(*) AS m FROM panel) p"
gate_query(
    "va02_grain", ("panel", {"null_key": rule(CRITICAL, "unit_id IS NULL OR month_start IS NULL"), "duplicate_key": unique("unit_id", "month_start")}),
    (_CELLS, {"row_count": (CRITICAL, "max(abs(n - m))", lambda: F.max(F.abs(F.col("n") - F.col("m"))))}),
)
gate_query(
    "va03_panel", (_CELLS, {"grid": (CRITICAL, "max(abs(n - m))", lambda: F.max(F.abs(F.col("n") - F.col("m"))))}),
    ("panel", {"severity_sum": rule(CRITICAL, "total <> k + a + b + c + o + u"), "ksi_sum": rule(CRITICAL, "ksi <> k + a"), "negative": rule(CRITICAL, "total < 0"), "zero_cells": rule(WARNING, "total = 0")}),
    ("(SELECT abs((SELECT count(*) FROM ev) - (SELECT sum(total) FROM panel)) AS d) q", {"events_kept": rule(CRITICAL, "d <> 0")}),
)
gate_query(
    "va04_features", ("feat", {
        "splits": rule(CRITICAL, "model_split = 'unknown'"), "null_pattern": rule(CRITICAL, "(history >= 12) <> (total_mean12 IS NOT NULL)"), "infinite": rule(CRITICAL, "abs(total_mean12) > 1e300"), "not_a_number": rule(CRITICAL, "CAST(total_mean12 AS STRING) IN ('NaN', 'nan')"),
        "negative_lag": rule(CRITICAL, "total_lag1 < 0 OR ksi_lag1 < 0"), "duplicate_key": unique("unit_id", "month_start"), "zero_cells": rule(WARNING, "total = 0"),
    }), ("(SELECT history, row_number() OVER (PARTITION BY unit_id ORDER BY month_start) - 1 AS pos FROM feat) q", {"order": rule(CRITICAL, "history <> pos")}),
    ("(SELECT model_split, count(*) AS n, count(DISTINCT unit_id) AS u, count(DISTINCT month_start) AS m FROM feat GROUP BY model_split) q", {"split_rows": rule(CRITICAL, "n <> u * m")}),
)
gate_query(
    "va08_cross_field", ("ev", {"month_matches": rule(CRITICAL, "month(ts) <> mon"), "year_matches": rule(CRITICAL, "year(ts) <> yr"), "month_start": rule(CRITICAL, "CAST(date_trunc('month', ts) AS DATE) <> month_start"), "negative_id": rule(WARNING, "event_id < 0")}),
    ("clock", {"weekday": rule(CRITICAL, "day_of_week <> weekday_again"), "hour": rule(CRITICAL, "hour_of_day < 0 OR hour_of_day > 23"), "component_sum": rule(CRITICAL, "coalesce(k + a + b + c + o + u, 0) <> n"), "negative": rule(CRITICAL, "n < 0")}),
)
gate_query("va15_model_outputs", (
    "pred", {"finite": rule(CRITICAL, "predicted IS NULL OR predicted < 0 OR predicted > 1e300"), "duplicate_key": unique("unit_id", "month_start", "target", "model")}),
    ("(SELECT p.actual, CASE WHEN p.target = 'total' THEN f.total ELSE f.ksi END AS found FROM pred p LEFT JOIN feat f ON p.unit_id = f.unit_id AND p.month_start = f.month_start) q", {"actuals": rule(CRITICAL, "found IS NULL OR actual <> found")}),
    ("(SELECT deviance, is_first, min(deviance) OVER (PARTITION BY target) AS least FROM (SELECT target, round(deviance, 9) AS deviance, row_number() OVER (PARTITION BY target ORDER BY round(deviance, 9), model) = 1 AS is_first FROM metric WHERE model_split = 'validation')) q", {"winner": rule(CRITICAL, "is_first AND deviance > least")}),
    ("metric", {"calibration": rule(WARNING, "abs(calibration - 1) > 0.1e0")}),
)
gate_query(
    "va16_forecast", ("forecast", {"negative": rule(CRITICAL, "total < 0 OR ksi < 0"), "ksi_over_total": rule(CRITICAL, "ksi > total"), "duplicate_step": unique("unit_id", "step"), "factor": (CRITICAL, "count(DISTINCT factor) - 1", lambda: F.count_distinct("factor") - 1)}),
    ("(SELECT count(*) AS n, max(step) AS last FROM forecast GROUP BY unit_id) q", {"horizons": rule(CRITICAL, "n <> 12 OR last <> 12")}),
    ("(SELECT a.total_forecast - f.total AS d FROM annual a JOIN (SELECT unit_id, sum(total) AS total FROM forecast GROUP BY unit_id) f ON a.unit_id = f.unit_id) q", {"annual_sum": rule(CRITICAL, "abs(d) > 1e-6")}),
    ("(SELECT abs((SELECT count(*) FROM annual) - (SELECT count(*) FROM units)) AS d) q", {"units": rule(CRITICAL, "d <> 0")}),
)
gate_query(
    "va17_readiness", ("shares", {"k_a_sum": rule(CRITICAL, "abs(share_k + share_a - 1) > 1e-9"), "other_sum": rule(CRITICAL, "abs(share_b + share_c + share_o - 1) > 1e-9"), "totals": rule(CRITICAL, "total <> k + a + b + c + o + u"), "range": rule(CRITICAL, "share_k < 0 OR share_k > 1")}),
    ("(SELECT count(s.unit_id) AS n, count(*) AS m FROM units u LEFT JOIN shares s ON u.unit_id = s.unit_id) q", {"coverage": rule(CRITICAL, "n < 0.99e0 * m")}),
    ("(SELECT (SELECT sum(total) FROM shares) - (SELECT count(*) FROM ev) AS d) q", {"events": rule(CRITICAL, "d IS NULL OR d <> 0")}),
)
gate_query(
    "va18_benefits", ("benefit", {
        "unique_key": unique("unit_id", "treatment_id", "scenario"), "cmf_range": rule(CRITICAL, "cmf < 0 OR cmf > 1"), "severity_sum": rule(CRITICAL, "abs(av_k + av_a + av_b + av_c + av_o - averted) > 1e-6 * averted"), "whole_quantity": rule(CRITICAL, "treatment_id <> 'T2' AND quantity <> floor(quantity)"),
        "present_value": rule(CRITICAL, "abs(annual_benefit * (1 - power(1.03e0, -life_years)) / 0.03e0 - pv) > 1e-6 * pv"), "extreme_bcr": rule(WARNING, "pv / cost > 1000"),
    }), ("(SELECT max(CASE WHEN scenario = 'CONSERVATIVE' THEN cmf END) AS c, max(CASE WHEN scenario = 'BASE' THEN cmf END) AS b, max(CASE WHEN scenario = 'OPTIMISTIC' THEN cmf END) AS o FROM benefit GROUP BY unit_id, treatment_id) q", {"cmf_order": rule(CRITICAL, "c < b OR b < o OR c IS NULL OR b IS NULL OR o IS NULL")}),
)
gate_query(
    "va19_portfolio", ("(SELECT s.portfolio_id, count(*) AS n, count(DISTINCT s.unit_id) AS u, sum(s.cost) AS cost, max(g.budget) AS budget, sum(CASE WHEN s.priority_area THEN s.cost ELSE 0e0 END) AS pr, max(g.floor_share) AS floor_share, count(CASE WHEN s.treatment_id = 'T2' THEN 1 END) AS t2 FROM sel s JOIN grid g ON s.portfolio_id = g.portfolio_id GROUP BY s.portfolio_id) q",
     {"one_per_unit": rule(CRITICAL, "n <> u"), "budget": rule(CRITICAL, "cost > budget + 1e-6"), "floor": rule(CRITICAL, "pr < floor_share * cost - 1e-6"), "cap": rule(CRITICAL, "t2 > 0.7e0 * n + 1e-9")}),
    ("(SELECT m.cost, m.pv, m.bcr, d.cost AS detail_cost, d.pv AS detail_pv FROM summ m JOIN (SELECT portfolio_id, sum(cost) AS cost, sum(pv) AS pv FROM sel GROUP BY portfolio_id) d ON m.portfolio_id = d.portfolio_id) q", {"detail_is_summary": rule(CRITICAL, "abs(cost - detail_cost) > 1e-4 OR abs(pv - detail_pv) > 1e-4"), "bcr_identity": rule(CRITICAL, "abs(bcr - pv / cost) > 1e-9 * bcr")}),
    ("(SELECT b.scenario, s.unc FROM sel s LEFT JOIN benefit b ON s.unit_id = b.unit_id AND s.treatment_id = b.treatment_id AND s.unc = b.scenario AND s.pv = b.pv) q", {"scenario_mixing": rule(CRITICAL, "scenario IS NULL")}),
)
gate_query(
    "va20_decision_mart", ("summ", {"unique_portfolio": unique("portfolio_id"), "default": (CRITICAL, f"abs(count(CASE WHEN portfolio_id = '{DEFAULT}' THEN 1 END) - 1)", lambda: F.abs(F.count_if(F.col("portfolio_id") == DEFAULT) - 1))}),
    ("(SELECT unc, count(*) AS n FROM grid WHERE portfolio_id IN (" + ", ".join(f"'{c}'" for c in CANONICAL) + ") GROUP BY unc) q", {"canonical": rule(CRITICAL, "n <> 1")}),
    ("(SELECT abs((SELECT count(*) FROM summ) - (SELECT count(*) FROM grid)) AS d) q", {"row_count": rule(CRITICAL, "d <> 0")}),
    ("(SELECT b.unit_id FROM sel s LEFT JOIN benefit b ON s.unit_id = b.unit_id AND s.treatment_id = b.treatment_id AND s.unc = b.scenario) q", {"lineage": rule(CRITICAL, "unit_id IS NULL")}),
)
gate_query("va21_register", ("units", {"missing_name": rule(CRITICAL, "unit_name IS NULL OR trim(unit_name) = ''"), "duplicate_id": unique("unit_id"), "group_domain": rule(CRITICAL, "grp NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')"), "length_range": rule(WARNING, "length_feet < 15000 OR length_feet > 25000")}),
    ("register", {"status_domain": rule(CRITICAL, "status IS NULL OR status NOT IN ('confirmed', 'provisional', 'retired')"), "confidence_range": rule(CRITICAL, "confidence IS NULL OR confidence < 0 OR confidence > 1"), "confirmed_is_sure": rule(CRITICAL, "status = 'confirmed' AND confidence < 0.6e0"),
     "provisional": rule(WARNING, "status = 'provisional'"), "alias_missing": rule(CRITICAL, "alias IS NULL OR trim(alias) = ''"), "alias_not_normal": rule(CRITICAL, "alias <> upper(trim(alias))"), "duplicate_alias": unique("alias")}),
    ("(SELECT a.alias FROM register a JOIN register b ON a.alias = b.unit_name AND a.unit_id <> b.unit_id) q", {"alias_is_other_name": rule(CRITICAL, "alias IS NOT NULL")}))
_SERVED = (
    ("summ", {"one_default": (CRITICAL, f"abs(count(CASE WHEN portfolio_id = '{DEFAULT}' THEN 1 END) - 1)", lambda: F.abs(F.count_if(F.col("portfolio_id") == DEFAULT) - 1))}),
    (f"(SELECT sum(s.cost) - max(m.cost) AS d, count(*) - max(m.projects) AS n FROM sel s JOIN summ m ON s.portfolio_id = m.portfolio_id WHERE s.portfolio_id = '{DEFAULT}') q", {"filter_reconciles": rule(CRITICAL, "abs(d) > 1e-4 OR n <> 0")}),
)


@query(_sql_rows(*[(v, {n: (s, q) for n, (s, q, _) in checks.items()}) for v, checks in _SERVED], ("(SELECT 1 AS one) q", {"manifest_matches": (CRITICAL, "count(CASE WHEN one <> 1 THEN 1 END)"), "manifest_rows": (CRITICAL, "count(CASE WHEN one <> 1 THEN 1 END)")})))
def va24_serving(t):
    """One default portfolio, its rows against its summary, and the served snapshot of the selections against its manifest."""
    from waymark.functions.storage import scratch_path
    from waymark.sources import snapshot

    at = scratch_path(t.spark, "served")
    served = t.view("sel").select("unit_id", "portfolio_id", "treatment_id", F.round("cost", 2).alias("cost"))
    snapshot.publish_parts(served, at, "unit_id", 4, "none")
    parts = snapshot.audit_parts(t.spark, at, required=("unit_id", "portfolio_id")).crossJoin(F.broadcast(served.agg(F.count("*").alias("every"))))
    checks = {"manifest_matches": (CRITICAL, bad("not (size_ok and sha_ok and parts_ok and columns_ok)")), "manifest_rows": (CRITICAL, F.abs(F.max("every") - F.sum("found_rows")))}
    return gate(*[offences(t.sql(f"SELECT * FROM {v}"), {n: (s, c()) for n, (s, _, c) in held.items()}) for v, held in _SERVED], offences(parts, checks))


gate_query("va14_mart_reconciliation", (
    "(SELECT f.*, s.months, s.units FROM (SELECT count(*) AS total_rows, count(DISTINCT unit_id) AS unit_count, count(DISTINCT month_start) AS month_count, min(month_start) AS first_month, max(month_start) AS last_month, sum(total) AS total_sum, sum(ksi) AS ksi_sum, count(CASE WHEN model_ready THEN 1 END) AS ready_rows, count(CASE WHEN model_split = 'warmup' THEN 1 END) AS warmup_rows, count(CASE WHEN model_split = 'unknown' THEN 1 END) AS unexpected, count(CASE WHEN total < 0 OR ksi < 0 THEN 1 END) AS negatives, count(CASE WHEN unit_id IS NULL OR month_start IS NULL THEN 1 END) AS null_keys, sum(abs(ksi - (k + a))) AS ksi_diff, sum(abs(total - (k + a + b + c + o + u))) AS severity_diff FROM feat) f CROSS JOIN (SELECT count(DISTINCT month_start) AS months, (SELECT count(*) FROM units) AS units FROM months) s) q",
    {"rows": rule(CRITICAL, "total_rows <> units * months"), "units": rule(CRITICAL, "unit_count <> units"), "months": rule(CRITICAL, "month_count <> months"), "warmup": rule(CRITICAL, "warmup_rows <> 12 * units"), "ready": rule(CRITICAL, "ready_rows <> total_rows - 12 * units"),
     "splits": rule(CRITICAL, "unexpected <> 0"), "negative": rule(CRITICAL, "negatives <> 0"), "null_keys": rule(CRITICAL, "null_keys <> 0"), "ksi": rule(CRITICAL, "ksi_diff <> 0"), "severity": rule(CRITICAL, "severity_diff <> 0")}),
    ("(SELECT (SELECT sum(total) FROM feat) - (SELECT count(*) FROM ev) AS d, (SELECT sum(ksi) FROM feat) - (SELECT count(*) FROM ev WHERE severity IN ('K', 'A')) AS s, (SELECT min(month_start) FROM feat) = (SELECT min(month_start) FROM ev) AND (SELECT max(month_start) FROM feat) = (SELECT max(month_start) FROM ev) AS ends) q", {"total_sum": rule(CRITICAL, "d <> 0"), "ksi_sum": rule(CRITICAL, "s <> 0"), "range": rule(CRITICAL, "NOT ends")}),
)
