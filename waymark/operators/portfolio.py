"""Benefit and cost of candidates, and budgeted selections for many scenarios at once. Column names of the inputs are stated in the docstrings."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.storage import cut_lineage
from waymark.operators.clean import fingerprint

NUMERIC_TOLERANCE = 1e-6


def annuity(years: Column, rate: float = 0.03) -> Column:
    return (1 - F.pow(F.lit(1 + rate), -years)) / rate


def bounded_cmf(point: Column, se: Column, scenario: Column, z: float = 1.96) -> Column:
    """The modification factor of a scenario: a confidence bound of the estimate, within 0 and 1."""
    return F.when(scenario == "CONSERVATIVE", F.least(F.lit(1.0), point + z * se)).when(scenario == "OPTIMISTIC", F.greatest(F.lit(0.0), point - z * se)).otherwise(point)


def benefits(units: DataFrame, treatments: DataFrame, unit_costs: dict[str, float], rate: float = 0.03) -> DataFrame:
    """Every unit by every treatment and scenario: averted events by severity, money, quantity and cost.

    units: unit_id, length_miles, total_forecast, sub_share, p_severe, share_k, share_a (of severe), share_b, share_c, share_o (of others).
    treatments: treatment_id, target, cmf_point, cmf_se, life_years, scenario, exposure_share, density, unit_cost, per_mile; a small table.
    """
    d = units.crossJoin(F.broadcast(treatments)).withColumn("cmf", bounded_cmf(F.col("cmf_point"), F.col("cmf_se"), F.col("scenario")))
    base = F.when(F.col("target") == "subgroup", F.col("total_forecast") * F.col("sub_share")).otherwise(F.col("total_forecast"))
    d = d.withColumn("averted", base * F.col("exposure_share") * (1 - F.col("cmf")))
    d = d.withColumns({f"av_{x}": F.col("averted") * (F.col("p_severe") if x in "ka" else 1 - F.col("p_severe")) * F.col(f"share_{x}") for x in "kabco"})
    money = sum((F.col(f"av_{x}") * unit_costs[x] for x in "kabco"), F.lit(0.0))
    d = d.withColumn("quantity", F.when(F.col("per_mile"), F.col("length_miles") * F.col("exposure_share")).otherwise(F.greatest(F.lit(1.0), F.ceil(F.col("length_miles") * F.col("density")).cast("double"))))
    return d.withColumn("cost", F.col("quantity") * F.col("unit_cost")).withColumn("annual_benefit", money).withColumn("pv", F.col("annual_benefit") * annuity(F.col("life_years"), rate))


#: Zooming of multipliers: start (shares of the largest benefit-cost ratio and of the largest benefit), half-width of the box, its shrinking a round, rounds.
START, WIDTH, SHRINK, ROUNDS = (0.3, 0.1, 0.1), 0.3, 0.65, 14
#: Portfolios whose multipliers are sought together.
GRID_ROWS = 10_000
#: Units of a portfolio whose choice is searched, those with the least margin; and partial selections kept a unit.
CORE, BEAM = 48, 1000
#: Rows of scenarios that are sent to every task; more are joined by a shuffle.
SMALL_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unit_options(candidates: DataFrame) -> DataFrame:
    """(scenario, unit_id, options): what a unit can take, at most one entry for each treatment. candidates: unit_id, treatment_id, scenario, priority_area, cost, pv."""
    one = F.struct("treatment_id", "cost", "pv", "priority_area")
    made = candidates.groupBy("scenario", "unit_id").agg(F.array_sort(F.collect_list(one)).alias("options"))
    return made.repartition(candidates.sparkSession.sparkContext.defaultParallelism)  # many multipliers are tried on few rows


def _profit(o: Column, capped: str, cap: float) -> Column:
    """Reduced profit of an option under multipliers l (money), m (floor) and v (cap)."""
    own, over = o["priority_area"].cast("double") - F.col("floor_share"), cap - (o["treatment_id"] == capped).cast("double")
    return o["pv"] - F.col("l") * F.col("r") * o["cost"] + F.col("m") * F.col("r") * o["cost"] * own + F.col("v") * F.col("b") * over


def _dual_sums(options: DataFrame, points: dict[str, tuple[list[int], np.ndarray]], floors: np.ndarray, capped: str, cap: float) -> np.ndarray:
    """Sums over all units of the largest positive reduced profit, for each portfolio and point. points: of each scenario the portfolios' numbers and (portfolio, point, 3) multipliers."""
    parts = options.select("scenario", *[F.transform("options", f).alias(n) for n, f in (("cost", lambda o: o["cost"]), ("pv", lambda o: o["pv"]), ("own", lambda o: o["priority_area"].cast("double")), ("one", lambda o: (o["treatment_id"] == capped).cast("double")))])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {s: np.zeros(x.shape[:2]) for s, (_, x) in points.items()}
        for batch in batches:
            for scenario, rows in batch.groupby("scenario"):
                if scenario in points:
                    (numbers, x), most = points[scenario], rows["cost"].str.len().max()
                    padded = [np.stack([np.pad(v, (0, most - len(v)), constant_values=fill) for v in rows[c]]) for c, fill in (("cost", 0.0), ("pv", -np.inf), ("own", 0.0), ("one", 0.0))]
                    for k, n in enumerate(numbers):
                        for first in range(0, len(rows), 4096):
                            cost, pv, own, one = (v[None, first : first + 4096] for v in padded)
                            l, m, v = (x[k, :, i, None, None] for i in range(3))
                            profit = pv - l * cost + m * cost * (own - floors[n]) + v * (cap - one)
                            total[scenario][k] += np.maximum(0.0, profit.max(axis=2)).sum(axis=1)
        out = [(n, j, total[s][k, j]) for s, (numbers, _) in points.items() for k, n in enumerate(numbers) for j in range(total[s].shape[1]) if total[s][k, j] > 0]
        yield pd.DataFrame(out, columns=["n", "j", "s"]).astype({"n": "int32", "j": "int32", "s": "float64"})

    sums = np.zeros((len(floors), max((x.shape[1] for _, x in points.values()), default=0)))
    for r in parts.mapInPandas(summed, "n int, j int, s double").groupBy("n", "j").agg(F.sum("s").alias("s")).collect():
        sums[r.n, r.j] = r.s
    return sums


def multipliers(options: DataFrame, grid: DataFrame, capped: str, cap: float) -> DataFrame:
    """grid with l, m, v (shares), r, b (their scales) and bound: near the least Lagrangian bound of every portfolio, all portfolios at once.

    The dual function is convex in three multipliers. Each round is one job that sums it over all units at 27 points of a box around the best point so far, for every
    portfolio; then the box moves there and shrinks. Every value is a valid bound. What a round sends is the points of all portfolios, not units.
    grid: portfolio_id, scenario, budget, floor_share; at most GRID_ROWS portfolios together (others are run in parts by the caller).
    """
    scales = options.select("scenario", F.explode("options").alias("o")).groupBy("scenario").agg(F.max(F.col("o.pv") / F.col("o.cost")).alias("r"), F.max("o.pv").alias("b"))
    rows = grid.select("portfolio_id", "scenario", "budget", "floor_share").join(scales, "scenario").orderBy("portfolio_id").limit(GRID_ROWS + 1).collect()
    if len(rows) > GRID_ROWS:
        raise ValueError(f"more than {GRID_ROWS} portfolios")
    budgets, floors, scale = np.array([r.budget for r in rows]), np.array([r.floor_share for r in rows]), np.array([(r.r, r.r, r.b) for r in rows]).reshape(-1, 3)
    moves = np.array(list(product((0, -1, 1), repeat=3)), float)
    at, half, bound = np.tile(START, (len(rows), 1)), WIDTH, np.zeros(len(rows))
    for _ in range(ROUNDS if rows else 0):
        x = np.maximum(0.0, at[:, None, :] + half * moves)
        scaled = x * scale[:, None, :]
        points = {s: (own, scaled[own]) for s in {r.scenario for r in rows} for own in [[k for k, r in enumerate(rows) if r.scenario == s]]}
        values = _dual_sums(options, points, floors, capped, cap) + scaled[:, :, 0] * budgets[:, None]
        best = np.array([np.lexsort((np.arange(len(moves)), np.round(v, 2)))[0] for v in values])
        at, bound, half = x[np.arange(len(rows)), best], values[np.arange(len(rows)), best], half * SHRINK
    out = [(r.portfolio_id, r.scenario, float(r.budget), float(r.floor_share), float(r.r), float(r.b), *map(float, a), float(d)) for r, a, d in zip(rows, at, bound)]
    return options.sparkSession.createDataFrame(out, "portfolio_id string, scenario string, budget double, floor_share double, r double, b double, l double, m double, v double, bound double")


def _searched(rows: pd.DataFrame, capped: str, cap: float, beam: int) -> pd.DataFrame:
    """The best selection of one portfolio's core. rows: a core unit each, with top, margin, options and their profits, and the sums of the units outside.

    Units are gone through from the largest margin to the least. Of the partial selections that can still meet the constraints the beam with the highest
    Lagrangian bound stay; what is cut off bounds what may be lost.
    """
    rows = rows.sort_values(["rank"], ascending=False)
    first = rows.iloc[0]
    budget, floor = first["budget"] - first["out_cost"], first["floor_share"]
    steps = []
    for r in rows.itertuples():
        o = [(0.0, 0.0, 0.0, 0.0, 0.0)] + [(p, x["cost"], x["pv"], x["cost"] * (float(x["priority_area"]) - floor), cap - (x["treatment_id"] == capped)) for p, x in zip(r.profits, r.options)]
        steps.append((r.top, np.array(o)))
    most = np.array([[s[:, 3].max(), s[:, 4].max()] for _, s in steps])
    later = np.vstack([np.cumsum(most[::-1], axis=0)[::-1][1:], [[0.0, 0.0]]])
    lag, state, lost, picks = np.array([first["bound"]]), np.array([[0.0, 0.0, first["out_floor"], first["out_cap"]]]), 0.0, []
    for (top, o), (floor_left, cap_left) in zip(steps, later):
        parent, j = np.repeat(np.arange(len(lag)), len(o)), np.tile(np.arange(len(o)), len(lag))
        new_lag, new = lag[parent] - top + o[j, 0], state[parent] + o[j][:, 1:]
        ok = (new[:, 0] <= budget + 1e-6) & (new[:, 2] + floor_left >= -1e-6) & (new[:, 3] + cap_left >= -1e-9)
        parent, j, new_lag, new = parent[ok], j[ok], new_lag[ok], new[ok]
        order = np.lexsort((j, parent, -np.round(new_lag, 2)))[:beam]
        lag, state = new_lag[order], new[order]
        picks.append((parent[order], j[order]))
        if len(order) == beam:
            lost = max(lost, lag.min())
    done = (state[:, 2] >= -1e-6) & (state[:, 3] >= -1e-9)
    out = {"unit_id": [], "treatment_id": [], "cost": [], "pv": [], "priority_area": []}
    value = 0.0
    if done.any():
        at = np.flatnonzero(done)[np.lexsort((np.flatnonzero(done), -np.round(state[done, 1], 2)))[0]]
        value = state[at, 1]
        for r, (parent, j) in zip(reversed(list(rows.itertuples())), reversed(picks)):
            if j[at]:
                x = r.options[j[at] - 1]
                for c, v in zip(out, (r.unit_id, x["treatment_id"], x["cost"], x["pv"], x["priority_area"])):
                    out[c].append(v)
            at = parent[at]
        value += first["out_pv"]
    bound = min(first["bound"], max(value, lost, first["bound"] - first["out_margin"]))
    return pd.DataFrame({"portfolio_id": [first["portfolio_id"]], "upper_bound": [bound], "feasible": [bool(done.any())], "picks": [[dict(zip(out, v)) for v in zip(*out.values())]]})


def solve(options: DataFrame, duals: DataFrame, capped: str, cap: float, core: int = CORE, beam: int = BEAM) -> DataFrame:
    """(portfolio_id, upper_bound, feasible, picks, cut): picks of the core units of every portfolio, and the place in the order of margins where the core ends.

    Outside the core every unit takes its option of largest positive reduced profit; the core, at most so many units a portfolio, is searched by a beam. The upper
    bound holds for all selections: it is the dual bound, or less where the search shows that nothing better was cut off. duals: of multipliers.
    """
    rows = _margins(options, duals, capped, cap)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("portfolio_id").orderBy("place"))).filter(F.col("rank") <= core)
    ranked = cut_lineage(ranked, "core")
    figures = {"out_cost": "taken.cost", "out_pv": "taken.pv", "out_floor": "taken.cost * (cast(taken.priority_area as double) - floor_share)", "out_cap": f"{cap} - cast(taken.treatment_id = '{capped}' as double)"}
    sums = lambda d: d.groupBy("portfolio_id").agg(*[F.coalesce(F.sum(F.expr(f"if(top > 0, {x}, 0)")), F.lit(0.0)).alias(n) for n, x in figures.items()], F.max("place").alias("cut"), F.count("*").alias("units"))
    every, inner = sums(rows), sums(ranked).withColumnsRenamed({n: f"in_{n}" for n in (*figures, "cut", "units")})
    outside = every.join(inner, "portfolio_id").select("portfolio_id", *[F.when(F.col("units") > F.col("in_units"), F.col(n) - F.col(f"in_{n}")).otherwise(0.0).alias(n) for n in figures], F.col("in_cut").alias("cut"), F.when(F.col("units") > F.col("in_units"), F.col("in_cut.margin")).otherwise(F.lit(1e300)).alias("out_margin"))
    outside = cut_lineage(outside, "outside")  # a row for each portfolio
    pick = "struct<unit_id:" + options.schema["unit_id"].dataType.simpleString() + ",treatment_id:string,cost:double,pv:double,priority_area:boolean>"
    found = ranked.join(small_side(outside.drop("cut")), "portfolio_id").groupBy("portfolio_id").applyInPandas(lambda d: _searched(d, capped, cap, beam), f"portfolio_id string, upper_bound double, feasible boolean, picks array<{pick}>")
    return found.join(outside.select("portfolio_id", "cut"), "portfolio_id")


def _margins(options: DataFrame, duals: DataFrame, capped: str, cap: float) -> DataFrame:
    """(portfolio_id, unit_id, options, profits, taken, top, place, budget, floor_share, bound): each unit's best option in each portfolio; place orders by margin over its second best."""
    d = options.join(small_side(duals), "scenario").withColumn("profits", F.transform("options", lambda o: _profit(o, capped, cap)))
    ordered = F.sort_array(F.concat("profits", F.array(F.lit(0.0))), asc=False)
    d = d.withColumn("top", F.element_at(ordered, 1)).withColumn("margin", F.element_at(ordered, 1) - F.element_at(ordered, 2))
    d = d.withColumn("taken", F.element_at("options", F.array_position("profits", F.array_max("profits")).cast("int")))
    return d.select("portfolio_id", "unit_id", "options", "profits", "taken", "top", "budget", "floor_share", "bound", F.struct(F.round("margin", 2).alias("margin"), "unit_id").alias("place"))


def selections(options: DataFrame, duals: DataFrame, solved: DataFrame, capped: str, cap: float) -> DataFrame:
    """(portfolio_id, unit_id, treatment_id, cost, pv, bcr, priority_area): what every portfolio takes, in its core and outside."""
    keep = ["portfolio_id", "unit_id", "treatment_id", "cost", "pv", "priority_area"]
    core = solved.select("portfolio_id", F.explode("picks").alias("p")).select("portfolio_id", "p.*").select(*keep)
    ends = solved.filter("feasible").select("portfolio_id", "cut")
    outside = _margins(options, duals, capped, cap).filter("top > 0").join(small_side(ends), "portfolio_id").filter("place > cut").select("portfolio_id", "unit_id", "taken.*").select(*keep)
    return core.unionByName(outside).withColumn("bcr", F.col("pv") / F.col("cost"))


def summarize(grid: DataFrame, selections: DataFrame, capped: str) -> DataFrame:
    """One row a portfolio, also those without a feasible point. grid: portfolio_id, budget, floor_share and other columns that stay."""
    one = F.col("treatment_id") == capped
    s = selections.groupBy("portfolio_id").agg(
        F.count("*").alias("projects"), F.sum("cost").alias("cost"), F.sum("pv").alias("pv"), F.sum(F.when(F.col("priority_area"), F.col("cost"))).alias("priority_spend"), F.max("bcr").alias("max_bcr"),
        F.count_if(one).alias("capped"), F.sum(F.when(one, F.col("cost"))).alias("capped_spend"),
    )
    d = grid.join(s, "portfolio_id", "left").fillna(0, ["projects", "cost", "pv", "priority_spend", "max_bcr", "capped", "capped_spend"])
    return d.withColumns({
        "solver_status": F.when(F.col("projects") == 0, "NO_FEASIBLE_POINT").otherwise("FEASIBLE"), "slack": F.col("budget") - F.col("cost"), "utilization_pct": F.col("cost") / F.col("budget") * 100,
        "npv": F.col("pv") - F.col("cost"), "bcr": F.coalesce(F.try_divide("pv", "cost"), F.lit(0.0)), "priority_share": F.coalesce(F.try_divide("priority_spend", "cost"), F.lit(0.0)),
        "capped_share": F.coalesce(F.try_divide("capped", "projects"), F.lit(0.0)),
    })


def constraint_classes(summary: DataFrame, selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """portfolio_id, budget_class, equity_class, limiting: which constraint holds a portfolio back. summary: with scenario, slack, floor_share, priority_share."""
    tol = NUMERIC_TOLERANCE
    left = candidates.select("scenario", "unit_id", F.col("cost").alias("c")).join(small_side(summary.select("portfolio_id", "scenario")), "scenario")
    left = left.join(selections.select("portfolio_id", "unit_id"), ["portfolio_id", "unit_id"], "left_anti").groupBy("portfolio_id").agg(F.min("c").alias("cheapest"))
    d = summary.join(left, "portfolio_id", "left")
    budget = F.when(F.col("cheapest").isNull(), "NONBINDING_CEILING").when(F.col("slack") < F.col("cheapest") - tol, "EFFECTIVELY_BINDING").when(F.abs("slack") <= tol, "BINDING_NUMERIC_TOLERANCE").otherwise("SLACK")
    equity = F.when(F.abs(F.col("priority_share") - F.col("floor_share")) <= tol, "BINDING").otherwise("SLACK")
    limiting = (
        F.when(~F.col("budget_class").isin("NONBINDING_CEILING", "SLACK"), F.concat(F.lit("BUDGET ("), F.col("budget_class"), F.lit(")")))
        .when(F.col("equity_class") == "BINDING", "EQUITY (BINDING)").otherwise(F.concat(F.lit("NONE ("), F.col("budget_class"), F.lit(")")))
    )
    return d.select("portfolio_id", budget.alias("budget_class"), equity.alias("equity_class")).withColumn("limiting", limiting)


def equivalence_groups(summary: DataFrame, selections: DataFrame, by: list[str], canonical: list[str], default: str) -> DataFrame:
    """portfolio_id, equivalent, is_canonical, is_default: how many portfolios of a group hold the very same selection."""
    hashes = fingerprint(selections, ["portfolio_id"], F.concat_ws("_", "unit_id", "treatment_id"))
    d = summary.select("portfolio_id", *by).join(hashes, "portfolio_id", "left").withColumn("selection_hash", F.coalesce("selection_hash", F.lit("none")))
    return d.withColumn("equivalent", F.count("*").over(W.partitionBy(*by, "selection_hash"))).withColumn("is_canonical", F.col("portfolio_id").isin(*canonical)).withColumn("is_default", F.col("portfolio_id") == default)


def stability(selections: DataFrame, grid: DataFrame, scope: Column, high: float = 0.7, medium: float = 0.3) -> DataFrame:
    """unit_id, scenarios, rate, tier, label over the portfolios of grid that scope holds for."""
    within = grid.filter(scope).select("portfolio_id")
    every = within.agg(F.count("*").alias("every"))  # one row
    d = selections.join(F.broadcast(within), "portfolio_id", "left_semi").groupBy("unit_id").agg(F.countDistinct("portfolio_id").alias("scenarios")).crossJoin(F.broadcast(every))
    d = d.withColumn("rate", F.col("scenarios") / F.col("every"))
    return d.withColumn("tier", F.when(F.col("rate") >= high, "HIGH").when(F.col("rate") >= medium, "MEDIUM").otherwise("LOW")).withColumn("label", F.concat(F.lit("Selected in "), F.col("scenarios").cast("string"), F.lit(" of "), F.col("every").cast("string"), F.lit(" scenarios"))).drop("every")
