"""Count models on feature rows: Poisson and negative-binomial regressions, recursive forecasts, empirical Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.storage import cut_lineage
from waymark.operators.panel import FRAMES, LAGS, with_calendar


def _features(train: DataFrame, numeric: list[str], categories: list[str]):
    """Fitted: standardised numbers and one-hot categories, the first of each dropped; a category not seen in training is all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer

    codes, hot = [f"{c}_code" for c in categories], [f"{c}_hot" for c in categories]
    kinds = train.agg(*[F.count_distinct(c) for c in categories]).first()
    stages = [
        VectorAssembler(inputCols=numeric, outputCol="raw_x"), StandardScaler(inputCol="raw_x", outputCol="num_x", withMean=True),
        # the first category and unseen ones have the two highest codes, which the slices leave out
        StringIndexer(inputCols=categories, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetDesc"), OneHotEncoder(inputCols=codes, outputCols=[f"{h}_all" for h in hot], dropLast=False),
        *[VectorSlicer(inputCol=f"{h}_all", outputCol=h, indices=list(range(n - 1))) for h, n in zip(hot, kinds, strict=True)], VectorAssembler(inputCols=["num_x", *hot], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(train)


class FittedModel:
    """A feature pipeline with a log-linear model: coefficients and intercept. predict() adds the column predicted."""

    def __init__(self, prepare, coefficients: list[float], intercept: float, alpha: float | None = None, glm=None):
        self.prepare, self.coefficients, self.intercept, self.alpha, self.glm = prepare, coefficients, intercept, alpha, glm

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_log_linear(self.prepare, self.coefficients, self.intercept, df)

    def names(self, df: DataFrame) -> list[str]:
        """Names of the terms, in the order of the coefficients."""
        attrs = self.prepare.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
        numeric = self.prepare.stages[0].getInputCols()
        names = {a["idx"]: a.get("name", "") for group in attrs.values() for a in group}
        return [numeric[k] if k < len(numeric) else names.get(k, str(k)) for k in range(len(self.coefficients))]


#: Features up to which a fit solves normal equations; beyond, it goes by gradients.
NORMAL_FEATURES = 4096


class WideModel:
    """A log-linear model over standardised numbers and categories of any number of levels. Coefficients: numbers first, then the levels of each category but the first."""

    def __init__(self, numeric: list[str], categories: list[str], means: np.ndarray, scales: np.ndarray, levels: list[dict[str, int]], alpha: float | None = None):
        self.numeric, self.categories, self.means, self.scales, self.levels, self.alpha = numeric, categories, means, scales, levels, alpha
        self.size = len(numeric) + sum(map(len, levels))
        self.coefficients, self.intercept, self.steps = np.zeros(self.size), 0.0, 0

    def names(self, df: DataFrame | None = None) -> list[str]:
        return [*self.numeric, *(f"{c}_hot_{x}" for c, own in zip(self.categories, self.levels) for x in own)]

    def encode(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Standardised numbers, and the place of each category's coefficient (-1: the first level or an unseen one)."""
        x = (batch[self.numeric].to_numpy(float) - self.means) * self.scales
        at, start = [], len(self.numeric)
        for c, own in zip(self.categories, self.levels):
            at.append(batch[c].map(own).fillna(-1 - start).to_numpy(np.int64) + start)
            start += len(own)
        return x, np.stack(at, axis=1) if at else np.zeros((len(batch), 0), np.int64)

    def log_mean(self, x: np.ndarray, at: np.ndarray, coefficients: np.ndarray, intercept: float) -> np.ndarray:
        padded = np.append(coefficients, 0.0)  # place -1
        return np.clip(x @ coefficients[: len(self.numeric)] + padded[at].sum(axis=1) + intercept, -20, 20)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with predicted."""
        known = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def mean(row: pd.DataFrame) -> pd.Series:
            m = known.value
            return pd.Series(np.exp(m.log_mean(*m.encode(row), m.coefficients, m.intercept)))

        return df.withColumn("predicted", mean(F.struct(*self.numeric, *[F.col(c).cast("string").alias(c) for c in self.categories])))


def _wide_sums(rows: DataFrame, model: WideModel, target: str, coefficients: np.ndarray, intercept: float, alpha: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and diagonal of the curvature (the intercept last), summed in Spark: one job."""
    sent = rows.sparkSession.sparkContext.broadcast((model, coefficients, intercept))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, c, b0 = sent.value
        loss, g, h = 0.0, np.zeros(m.size + 2), np.zeros(m.size + 2)
        for batch in batches:
            (x, at), y = m.encode(batch), batch[target].to_numpy(float)
            eta = m.log_mean(x, at, c, b0)
            mu = np.exp(eta)
            if alpha is None:
                loss, r, w = loss + float((mu - y * eta).sum()), mu - y, mu
            else:
                loss, r, w = loss + float(((y + 1 / alpha) * np.log1p(alpha * mu) - y * eta).sum()), (mu - y) / (1 + alpha * mu), mu / (1 + alpha * mu)
            n = x.shape[1]
            g[:n] += x.T @ r
            h[:n] += (x * x).T @ w
            for k in range(at.shape[1]):
                place = np.where(at[:, k] < 0, m.size + 1, at[:, k])
                g += np.bincount(place, weights=r, minlength=m.size + 2)
                h += np.bincount(place, weights=w, minlength=m.size + 2)
            g[m.size] += r.sum()
            h[m.size] += w.sum()
        used = np.flatnonzero(h[: m.size + 1])
        yield pd.DataFrame({"k": np.append(used, -1), "g": np.append(g[used], loss), "h": np.append(h[used], 0.0)})

    columns = [*model.numeric, *[F.col(c).cast("string").alias(c) for c in model.categories], F.col(target).cast("double").alias(target)]
    sums = rows.select(*columns).mapInPandas(part, "k long, g double, h double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # a row for each coefficient
    loss, g, h = float(sums.loc[sums["k"] < 0, "g"].sum()), np.zeros(model.size + 1), np.zeros(model.size + 1)
    own = sums[sums["k"] >= 0]
    g[own["k"]], h[own["k"]] = own["g"], own["h"]
    return loss, g, h


def fit_wide(train: DataFrame, target: str, numeric: list[str], categories: list[str], reg: float, alpha: float | None = None, tolerance: float = 1e-7, rounds: int = 200, memory: int = 12) -> WideModel:
    """Poisson (alpha None) or negative-binomial regression with log link by limited-memory quasi-Newton steps; every evaluation is one job that sums over the rows.

    The penalty is that of the normal-equation fits: reg times the sum of the target (of the weights, for a negative binomial), not on the intercept. Steps begin from
    the curvature's diagonal and are halved until the loss falls enough; they end when the largest derivative is at most tolerance times the sum of the target.
    """
    f = train.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(numeric)], *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(numeric)], F.sum(target).alias("total"), F.avg(target).alias("mean")).first()
    means, deviations = np.array([f[f"m{k}"] or 0.0 for k in range(len(numeric))], float), np.array([f[f"s{k}"] or 0.0 for k in range(len(numeric))], float)
    levels = []
    for c in categories:
        values = [r[0] for r in train.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().orderBy(c).collect()]  # as many as coefficients
        levels.append({x: k for k, x in enumerate(values[1:])})
    model = WideModel(numeric, categories, means, np.divide(1.0, deviations, out=np.zeros_like(deviations), where=deviations > 0), levels, alpha)
    rows, total = cut_lineage(train.select(*numeric, *categories, target), "wide"), float(f.total or 0.0)
    penalty = np.append(np.full(model.size, reg * (total if alpha is None else total / (1 + alpha * f.mean))), 0.0)

    def at(p: np.ndarray):
        loss, g, h = _wide_sums(rows, model, target, p[:-1], p[-1], alpha)
        return loss + 0.5 * float((penalty * p * p).sum()), g + penalty * p, h + penalty

    p = np.append(np.zeros(model.size), math.log(max(f.mean or 0.0, 1e-6)))
    loss, g, h = at(p)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for model.steps in range(rounds):
        if np.abs(g).max() <= tolerance * max(1.0, total):
            break
        q, used = g.copy(), []
        for s, y in reversed(steps):
            k = (s @ q) / (y @ s)
            q -= k * y
            used.append(k)
        q /= np.maximum(h, 1e-12)
        for (s, y), k in zip(steps, reversed(used)):
            q += s * (k - (y @ q) / (y @ s))
        size = 1.0
        while True:
            new = at(p - size * q)
            if new[0] <= loss - 1e-4 * size * float(g @ q) or size < 1e-10:
                break
            size /= 2
        if size < 1e-10:
            break
        s, y = -size * q, new[1] - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        p, (loss, g, h) = p - size * q, new
    model.coefficients, model.intercept = p[:-1], float(p[-1])
    return model


def _width(train: DataFrame, numeric: list[str], categories: list[str]) -> int:
    kinds = train.agg(*[F.count_distinct(c) for c in categories]).first() if categories else ()
    return len(numeric) + sum(n - 1 for n in kinds)


def fit_poisson(train: DataFrame, target: str, numeric: list[str], categories: list[str], reg: float = 1.0, rounds: int = 25) -> FittedModel | WideModel:
    """Poisson regression with log link and an L2 penalty."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    if _width(train, numeric, categories) > NORMAL_FEATURES:
        return fit_wide(train, target, numeric, categories, reg)
    prepare = _features(train, numeric, categories)
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=target, featuresCol="features", predictionCol="predicted", regParam=reg, maxIter=rounds).fit(prepare.transform(train))
    return FittedModel(prepare, [float(c) for c in glm.coefficients], float(glm.intercept), glm=glm)


def dispersion(train: DataFrame, target: str) -> float:
    """Of a negative binomial, by moments; 0.1 where the target is not overdispersed."""
    m = train.agg(F.avg(target).alias("m"), F.var_samp(target).alias("v")).first()
    return max(1e-4, (m.v - m.m) / m.m**2) if m.v is not None and m.m and m.v > m.m else 0.1


def fit_negative_binomial(train: DataFrame, target: str, numeric: list[str], categories: list[str], rounds: int = 50, tolerance: float = 1e-6, reg: float = 1e-6) -> FittedModel | WideModel:
    """Reweighted least squares with weights mu / (1 + alpha mu) until the deviance stands still. If that fails or does not converge, a Poisson regression (alpha None)."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    alpha = dispersion(train, target)
    if _width(train, numeric, categories) > NORMAL_FEATURES:
        return fit_wide(train, target, numeric, categories, reg, alpha)
    prepare = _features(train, numeric, categories)
    x = cut_lineage(prepare.transform(train).select("features", F.col(target).cast("double").alias("y")), "nb")
    eta, before, model = F.log(F.col("y") + 0.5), None, None
    for _ in range(rounds):
        mu = F.exp(eta)
        work = x.select("features", (eta + (F.col("y") - mu) / mu).alias("z"), (mu / (1 + alpha * mu)).alias("w"))
        lr = LinearRegression(featuresCol="features", labelCol="z", weightCol="w", solver="normal", regParam=reg).fit(work)
        model = FittedModel(prepare, [float(c) for c in lr.coefficients], float(lr.intercept), alpha)
        eta = _log_mean(vector_to_array("features"), model.coefficients, model.intercept)
        mu, y = F.exp(eta), F.col("y")
        term = F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y + 1 / alpha) * F.log((1 + alpha * y) / (1 + alpha * mu))
        now = x.agg(F.sum(2 * term)).first()[0]
        if now is None or now != now or abs(now) == float("inf"):
            break
        if before is not None and abs(now - before) <= tolerance * (abs(before) + tolerance):
            return model
        before = now
    return fit_poisson(train, target, numeric, categories, reg=reg)


def _log_mean(features: Column, coefficients: list[float], intercept: float) -> Column:
    """The linear predictor, kept where its exponential neither vanishes nor overflows."""
    terms = F.aggregate(F.zip_with(features, F.array(*[F.lit(c) for c in coefficients]), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), terms + F.lit(intercept)))


def predict_log_linear(prepare, coefficients: list[float], intercept: float, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return prepare.transform(df).withColumn("predicted", F.exp(_log_mean(vector_to_array("features"), coefficients, intercept)))


def coefficient_table(model: FittedModel, train: DataFrame, top: int = 15) -> DataFrame:
    """term, coefficient, std_error, p_value, rate_ratio of the largest coefficients. Standard errors need a Poisson model without penalty; else they are null."""
    s = model.glm.summary if model.glm is not None and model.glm.getRegParam() == 0 else None
    try:
        errors, ps = (list(s.coefficientStandardErrors), list(s.pValues)) if s else (None, None)
    except Exception as e:  # Spark has none where the normal equations are singular
        if "Standard Error" not in str(e) and "No " not in str(e):
            raise
        errors = ps = None
    rows = [(n, c, errors[k] if errors else None, ps[k] if ps else None) for k, (n, c) in enumerate(zip(model.names(train), model.coefficients, strict=True))]
    d = train.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, p_value double")
    return d.withColumn("rate_ratio", F.exp("coefficient")).orderBy(F.abs("coefficient").desc(), "term").limit(top)


def recursive_mean_forecast(panel: DataFrame, value: str, steps: int = 12, window: int = 12, unit: str = "unit_id", month: str = "month_start") -> DataFrame:
    """(unit, step, forecast): every step is the mean of the last values, forecasts included. A fold over one bounded array a unit."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(month, F.col(value).cast("double").alias("v")))), lambda s: s["v"])
    base = panel.groupBy(unit).agg(F.slice(ordered, -window, window).alias("h"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("h"), lambda h, _: F.concat(h, F.array(F.aggregate(F.slice(h, -window, window), F.lit(0.0), lambda s, v: s + v) / window)))
    return base.select(unit, F.posexplode(F.slice(grown, window + 1, steps)).alias("p", "forecast")).select(unit, (F.col("p") + 1).alias("step"), "forecast")


def recursive_calibrated_forecast(panel: DataFrame, unit: str, month: str, total: str, part: str, factor: DataFrame, steps: int = 12, window: int = 12) -> DataFrame:
    """(unit, step, total, raw, factor, part): means of the last values for both; the part's are calibrated, capped at the total and fed back. factor: one row (factor)."""
    mean = lambda h: F.aggregate(F.slice(h, -window, window), F.lit(0.0), lambda s, v: s + v) / window
    ordered = F.array_sort(F.collect_list(F.struct(month, F.col(total).cast("double").alias("t"), F.col(part).cast("double").alias("p"))))
    base = panel.groupBy(unit).agg(F.slice(ordered, -window, window).alias("h")).crossJoin(F.broadcast(factor))
    base = base.select(unit, "factor", F.transform("h", lambda s: s["t"]).alias("ht"), F.transform("h", lambda s: s["p"]).alias("hp"))

    def grow(acc: Column, _: Column) -> Column:
        t, raw = mean(acc["t"]), mean(acc["p"])
        put = lambda a, v: F.concat(a, F.array(v))
        return F.struct(put(acc["t"], t).alias("t"), put(acc["p"], F.least(raw * F.col("factor"), t)).alias("p"), put(acc["r"], raw).alias("r"))

    start = F.struct(F.col("ht").alias("t"), F.col("hp").alias("p"), F.array().cast("array<double>").alias("r"))
    g = base.withColumn("g", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, grow))
    rows = g.select(unit, "factor", F.posexplode(F.arrays_zip(F.slice("g.t", -steps, steps).alias("t"), F.col("g.r").alias("r"), F.slice("g.p", -steps, steps).alias("p"))).alias("k", "x"))
    return rows.select(unit, (F.col("k") + 1).alias("step"), F.col("x.t").alias(total), F.col("x.r").alias("raw"), "factor", F.col("x.p").alias(part))


def _last(h: Column, n: int) -> Column:
    return F.aggregate(F.slice(h, -n, n), F.lit(0.0), lambda s, v: s + v)


def recursive_model_forecast(panel: DataFrame, predict, factor: float, unit: str, month: str, total: str, part: str, group: str, base_year: int, steps: int = 12) -> DataFrame:
    """(unit, step, total, raw, part): at each step all lags, means, sums and calendar terms are rebuilt from what is known so far, the part is scored by
    predict (a function from DataFrame to DataFrame with column predicted), calibrated, capped at the total's trailing mean and fed back. Units run in parallel; the number of steps is fixed.
    """
    ordered = F.array_sort(F.collect_list(F.struct(month, F.col(total).cast("double").alias("t"), F.col(part).cast("double").alias("p"))))
    rows = panel.groupBy(unit, group).agg(F.slice(ordered, -12, 12).alias("h"), F.max(month).alias("at"))
    rows = rows.select(unit, group, "at", F.transform("h", lambda s: s["t"]).alias("ht"), F.transform("h", lambda s: s["p"]).alias("hp"))
    out = None
    for step in range(1, steps + 1):
        x = rows.withColumn("at", F.add_months("at", 1)).withColumns({"mon": F.month("at"), "yr": F.year("at")})
        made = {}
        for v, h in ((total, "ht"), (part, "hp")):
            made |= {f"{v}_lag{k}": F.element_at(h, -k) for k in LAGS} | {f"{v}_mean{n}": _last(F.col(h), n) / n for n in FRAMES} | {f"{v}_sum{n}": _last(F.col(h), n) for n in FRAMES}
        x = with_calendar(x.withColumns(made), "mon", "yr", base_year).withColumn("next", F.col(f"{total}_mean12"))
        scored = predict(x).select(unit, group, "at", "ht", "hp", "next", F.col("predicted").alias("raw"), F.least(F.col("predicted") * factor, F.col("next")).alias("p"))
        grown = lambda h, v: F.slice(F.concat(h, F.array(v)), -12, 12)
        rows = cut_lineage(scored.select(unit, group, "at", grown(F.col("ht"), F.col("next")).alias("ht"), grown(F.col("hp"), F.col("p")).alias("hp"), "next", "raw", "p"), "recursive")
        got = rows.select(unit, F.lit(step).alias("step"), F.col("next").alias(total), "raw", F.col("p").alias(part))
        out = got if out is None else out.unionByName(got)
        rows = rows.drop("next", "raw", "p")
    return out


def _shifted(x: Column, steps: int, term) -> tuple[Column, Column]:
    """x + steps, and the sum of term over x, x + 1, ... below it."""
    total = term(x)
    for k in range(1, steps):
        total = total + term(x + k)
    return x + steps, total


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after eight steps of the recurrence."""
    z, below = _shifted(x, 8, F.log)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - below


def digamma(x: Column) -> Column:
    z, below = _shifted(x, 8, lambda v: 1 / v)
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - below


def trigamma(x: Column) -> Column:
    z, below = _shifted(x, 8, lambda v: 1 / (v * v))
    return 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9) + below


#: Largest shape of a gamma prior: beyond it the counts are not told from Poisson counts.
MAX_SHAPE = 1e8


def fit_gamma_poisson(units: DataFrame, tolerance: float = 1e-7, rounds: int = 200) -> DataFrame:
    """One row (alpha, beta, nll, gradient): the Gamma-Poisson likelihood at its optimum. units: (y, exposure), exposure above zero.

    Newton steps on the logarithms of both parameters, each from one aggregate over the distinct (y, exposure), halved until the likelihood does not fall, until the
    largest derivative by a logarithm is at most tolerance times the number of units. Without overdispersion the shape grows to MAX_SHAPE and stays there.
    """
    rows = cut_lineage(units.groupBy(F.col("y").cast("double").alias("y"), F.col("exposure").cast("double").alias("e")).agg(F.count("*").cast("double").alias("w")), "gamma-poisson")
    m = units.select((F.col("y") / F.col("exposure")).alias("r")).agg(F.avg("r").alias("m"), F.var_samp("r").alias("v")).first()
    u, v = (math.log(m.m**2 / m.v), math.log(m.m / m.v)) if m.v and m.m else (0.0, 0.0)

    def at(u: float, v: float):
        a, b = F.lit(math.exp(u)), F.lit(math.exp(v))
        y, e, w = F.col("y"), F.col("e"), F.col("w")
        ll = lgamma(a + y) - lgamma(a) + a * F.log(b) - (a + y) * F.log(b + e)
        sums = {"ll": ll, "a": digamma(a + y) - digamma(a) + F.log(b) - F.log(b + e), "b": a / b - (a + y) / (b + e), "aa": trigamma(a + y) - trigamma(a), "ab": 1 / b - 1 / (b + e), "bb": (a + y) / (b + e) ** 2 - a / b**2, "n": F.lit(1.0)}
        return rows.agg(*[F.sum(w * x).alias(k) for k, x in sums.items()]).first()

    here = at(u, v)
    for _ in range(rounds):
        a, b = math.exp(u), math.exp(v)
        gu, gv = a * here.a, b * here.b
        if max(abs(gu), abs(gv)) <= tolerance * here.n or u >= math.log(MAX_SHAPE):
            break
        huu, huv, hvv = a * a * here.aa + gu, a * b * here.ab, b * b * here.bb + gv
        det = huu * hvv - huv * huv
        du, dv = ((huv * gv - hvv * gu) / det, (huv * gu - huu * gv) / det) if huu < 0 and det > 0 else (gu / here.n, gv / here.n)
        shrink = min(1.0, 2.0 / max(abs(du), abs(dv)))
        for _ in range(40):
            nu, nv = min(u + shrink * du, math.log(MAX_SHAPE)), v + shrink * dv
            there = at(nu, nv)
            if there.ll >= here.ll - 1e-12 * abs(here.ll):
                u, v, here = nu, nv, there
                break
            shrink /= 2
        else:
            break
    out = (math.exp(u), math.exp(v), -here.ll, max(abs(math.exp(u) * here.a), abs(math.exp(v) * here.b)))
    return units.sparkSession.createDataFrame([out], "alpha double, beta double, nll double, gradient double")
