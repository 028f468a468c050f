"""Metrics, correlations, regressions and tests from aggregates; only matrices as wide as the regressors reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, null for a constant or fewer than two rows. Extremes tell a constant, as sums leave a rounding error."""
    moves = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(moves, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def run_metrics(p: DataFrame, keys: list[str]) -> DataFrame:
    """By key: n, RMSE, MAE, information coefficient, hit rate and means of predictions and actuals."""
    e = F.col("prediction") - F.col("actual")
    hit = (F.signum("prediction") == F.signum("actual")).cast("int")
    return p.where("prediction is not null and actual is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), correlation("prediction", "actual").alias("ic"), F.avg(hit).alias("hit_rate"), F.avg("prediction").alias("mean_prediction"), F.avg("actual").alias("mean_actual")
    )


def compare_runs(metrics: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """Each run's RMSE against the baseline run's on the same keys."""
    base = metrics.where(F.col("run_id") == baseline).select(*keys, F.col("rmse").alias("base_rmse"))
    return metrics.join(base, keys).select("run_id", *keys, "rmse", "base_rmse", (F.try_divide("rmse", F.nullif("base_rmse", F.lit(0.0))) - 1).alias("relative"))


def importances(imp: DataFrame) -> DataFrame:
    """Mean, population deviation and count of each feature's share of its split's total."""
    share = F.try_divide("importance", F.nullif(F.sum("importance").over(Window.partitionBy("run_id", "split_id")), F.lit(0.0)))
    return imp.withColumn("share", share).groupBy("run_id", "feature").agg(F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("std_share"), F.count("share").alias("n_splits"))


def cluster_forward_stats(assigned: DataFrame, forward: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """n, mean, sample deviation and share of gains by cluster, ticker and horizon; noise is a cluster of its own."""
    rows = assigned.join(forward, ["ts", "ticker"]).select("cluster_id", "ticker", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("fwd")) for c, h in horizons.items()]))).where("fwd is not null")
    return rows.groupBy("cluster_id", "ticker", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("fwd")).alias("std"), F.avg((F.col("fwd") > 0).cast("int")).alias("hit_rate"))


def average_rank(x: str, keys: list[str]) -> Column:
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 3) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, correlation("rx", "ry")).alias("ic"))


def incremental_ic(df: DataFrame, signal: str, base: str, target: str, train: Column, keys: list[str]) -> DataFrame:
    """Correlation with the target of what the base leaves of the signal, the line fitted on training rows alone."""
    fit = df.where(train).groupBy(*keys).agg(F.regr_slope(signal, base).alias("b"), F.regr_intercept(signal, base).alias("a"))
    test = df.where(~train).join(fit, keys).withColumn("left", F.col(signal) - F.col("a") - F.col("b") * F.col(base)).where(F.col("left").isNotNull() & F.col(target).isNotNull())
    return test.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation("left", target).alias("ic"))


def diebold_mariano(df: DataFrame, loss_a: str, loss_b: str, keys: list[str], lags: int, order: str = "ts") -> DataFrame:
    """t statistic of the mean loss difference, its variance by Bartlett weights over ``lags``."""
    rows = df.select(*keys, order, (F.col(loss_a) - F.col(loss_b)).alias("d")).withColumn("c", F.col("d") - F.avg("d").over(Window.partitionBy(*keys)))
    by = w.over(keys, order)
    rows = rows.select(*keys, "d", "c", *[(F.col("c") * F.lag("c", k).over(by)).alias(f"g{k}") for k in range(1, lags + 1)])
    n = F.count(F.lit(1))
    long_run = F.sum(F.col("c") * F.col("c")) / n
    for k in range(1, lags + 1):
        long_run = long_run + F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) * (2 * (1 - k / (lags + 1))) / n
    return rows.groupBy(*keys).agg(n.alias("n"), F.avg("d").alias("mean_difference"), F.when(long_run > 0, F.avg("d") / F.sqrt(long_run / n)).alias("dm"))


def ols(df: DataFrame, y: str, xs: list[str], order: str = "ts", key: str | None = None, lags: int = 0, least: int = 30) -> list[dict]:
    """Least squares with an intercept and Newey-West deviations; one dict per term, nulls below ``least`` rows."""
    return ols_many(df, [y], xs, order, key, [lags], least)[0]


def ols_many(df: DataFrame, ys: list[str], xs: list[str], order: str = "ts", key: str | None = None, lags: list[int] | None = None, least: int = 30) -> list[list[dict]]:
    """``ols`` of each of ``ys`` on its own rows without nulls, with its own number of lags.

    Cross products of all targets are summed in one pass, the scores' lagged products in a second; lags stay within ``key``.
    """
    lags = lags or [0] * len(ys)
    each = F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(y).cast("double").alias("y")) for h, y in enumerate(ys)]))
    rows = df.select((F.col(key) if key else F.lit(0)).alias("key"), F.col(order).alias("at"), F.lit(1.0).alias("x0"), *[F.col(x).cast("double").alias(f"x{i + 1}") for i, x in enumerate(xs)], each).dropna()
    k, names = len(xs) + 1, ["intercept", *xs]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(k)]).collect()
    sums = {r["h"]: r for r in got}
    fits = {}
    for h, r in sums.items():
        if r["n"] >= least:
            xx = np.zeros((k, k))
            for i, j in pairs:
                xx[i, j] = xx[j, i] = r[f"s{i}_{j}"]
            inverse = np.linalg.pinv(xx)
            fits[h] = inverse, inverse @ np.array([r[f"t{i}"] for i in range(k)])
    none = lambda h: [{"term": t, "n": sums[h]["n"] if h in sums else 0, "estimate": None, "std_error": None} for t in names]
    if not fits:
        return [none(h) for h in range(len(ys))]
    table = F.array(*[F.array(*[F.lit(float(b)) for b in (fits[h][1] if h in fits else np.zeros(k))]) for h in range(len(ys))])
    beta = F.get(table, "h")
    error = F.col("y") - sum((F.col(f"x{i}") * F.get(beta, F.lit(i)) for i in range(k)), F.lit(0.0))
    scored = rows.where(F.col("h").isin(list(fits))).select("h", "key", "at", error.alias("e"), *[f"x{i}" for i in range(k)]).select("h", "key", "at", *[(F.col(f"x{i}") * F.col("e")).alias(f"u{i}") for i in range(k)])
    by = Window.partitionBy("h", "key").orderBy("at")
    most = max(lags[h] for h in fits)
    products = scored.select("h", *[(F.col(f"u{i}") * (F.lag(f"u{j}", lag).over(by) if lag else F.col(f"u{j}"))).alias(f"p{lag}_{i}_{j}") for lag in range(most + 1) for i in range(k) for j in range(k)])
    total = {r["h"]: r for r in products.groupBy("h").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in products.columns[1:]]).collect()}
    out = []
    for h in range(len(ys)):
        if h not in fits:
            out.append(none(h))
            continue
        inverse, b = fits[h]
        meat = np.zeros((k, k))
        for lag in range(lags[h] + 1):
            g = np.array([[total[h][f"p{lag}_{i}_{j}"] for j in range(k)] for i in range(k)])
            meat += g if not lag else (1 - lag / (lags[h] + 1)) * (g + g.T)
        se = np.sqrt(np.maximum(0, np.diag(inverse @ meat @ inverse)))
        out.append([{"term": t, "n": sums[h]["n"], "estimate": float(x), "std_error": float(e)} for t, x, e in zip(names, b, se, strict=True)])
    return out


TERMS = "term string, n long, estimate double, std_error double"


def local_projection(df: DataFrame, treated: str, controls: list[str], targets: dict[int, str], order: str = "ts", key: str | None = None) -> DataFrame:
    """One row per horizon: the treatment's effect on that horizon's target, HAC with as many lags, and its 95 % band."""
    found = ols_many(df, list(targets.values()), [treated, *controls], order, key, list(targets))
    rows = [(h, r["n"], r["estimate"], r["std_error"]) for h, fit in zip(targets, found, strict=True) for r in fit if r["term"] == treated]
    out = df.sparkSession.createDataFrame(rows, "horizon int, n long, estimate double, std_error double")
    return out.withColumns({"low": F.col("estimate") - 1.96 * F.col("std_error"), "high": F.col("estimate") + 1.96 * F.col("std_error")})


def var_ols(df: DataFrame, series: list[str], p: int, order: str = "ts", key: str | None = None) -> DataFrame:
    """Coefficients of a vector autoregression of order ``p``: (equation, term, n, estimate, std_error)."""
    by = Window.partitionBy(key or F.lit(0)).orderBy(order)
    lagged = df.withColumns({f"{s}_l{k}": F.lag(s, k).over(by) for s in series for k in range(1, p + 1)})
    terms = [f"{s}_l{k}" for k in range(1, p + 1) for s in series]
    rows = [(s, r["term"], r["n"], r["estimate"], r["std_error"]) for s, fit in zip(series, ols_many(lagged, series, terms, order, key), strict=True) for r in fit]
    return df.sparkSession.createDataFrame(rows, f"equation string, {TERMS}")


def var_order(df: DataFrame, series: list[str], most: int, order: str = "ts") -> int:
    """The order of least BIC on the rows that the longest lag leaves."""
    by = Window.partitionBy(F.lit(0)).orderBy(order)
    lagged = df.withColumns({f"{s}_l{k}": F.lag(s, k).over(by) for s in series for k in range(1, most + 1)}).dropna()
    best, chosen = np.inf, 1
    for p in range(1, most + 1):
        terms = [f"{s}_l{k}" for k in range(1, p + 1) for s in series]
        fits = dict(zip(series, ols_many(lagged, series, terms, order), strict=True))
        n = fits[series[0]][0]["n"]
        if fits[series[0]][0]["estimate"] is None:
            break
        residual = [F.col(s) - sum((F.lit(r["estimate"]) * (F.col(r["term"]) if r["term"] != "intercept" else F.lit(1.0)) for r in fits[s]), F.lit(0.0)) for s in series]
        cells = lagged.agg(*[F.avg(a * b).alias(f"c{i}_{j}") for i, a in enumerate(residual) for j, b in enumerate(residual)]).first()
        sigma = np.array(list(cells)).reshape(len(series), len(series))
        bic = np.linalg.slogdet(sigma)[1] + np.log(n) * len(series) * (len(terms) + 1) / n
        if bic < best:
            best, chosen = bic, p
    return chosen


def sign_stability(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the more frequent sign, and of rows with the sign of the whole-sample effect."""
    s = F.signum("effect")
    return effects.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.greatest(F.count_if(s == 1), F.count_if(s == -1)) / F.count(F.lit(1))).alias("modal_share"), F.avg((s == F.signum("whole")).cast("int")).alias("agreement"))


def lift_decision(metrics: DataFrame, arm: str, baseline: str, bar: float = -0.01, wins: float = 0.6) -> DataFrame:
    """An arm is kept only if its mean RMSE lies ``bar`` below the baseline's *and* it wins in the share of splits, rounded up."""
    of = lambda run: F.max(F.when(F.col("run_id") == run, F.col("rmse")))
    both = metrics.groupBy("ticker", "split_id").agg(of(arm).alias("a"), of(baseline).alias("b")).where("a is not null and b is not null")
    got = both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_splits"), (F.try_divide(F.avg("a"), F.avg("b")) - 1).alias("relative"), F.count_if(F.col("a") < F.col("b")).alias("n_wins"))
    return got.withColumn("n_needed", F.ceil(F.col("n_splits") * wins - 1e-9)).withColumn("keep", (F.col("relative") <= bar) & (F.col("n_wins") >= F.col("n_needed")))
