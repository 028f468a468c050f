"""Scenarios by ticker and horizon: a grid of effects, the master row of each, and how robust a projection is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import local_projection

GRID = "scenario string, ticker string, horizon int, ate double, se double, ci_low double, ci_high double, n_treated long, n_control long, placebo_pvalue double"


def aipw(y: np.ndarray, t: np.ndarray, x: np.ndarray, folds: int = 5, clip: float = 0.02) -> tuple[float, float]:
    """(effect, deviation) by augmented inverse propensity weighting; nuisances are linear and logistic, cross-fitted over
    folds of neighbouring rows."""
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    x = np.column_stack((np.ones(len(y)), x))
    ridge = 1e-6 * len(y) * np.eye(x.shape[1])
    fold = np.arange(len(y)) * folds // len(y)
    psi = np.empty(len(y))
    for k in range(folds):
        train, test = fold != k, fold == k
        arms = []
        for a in (0, 1):
            own = train & (t == a)
            arms.append(x[test] @ np.linalg.solve(x[own].T @ x[own] + ridge, x[own].T @ y[own]))
        beta = np.zeros(x.shape[1])
        for _ in range(12):  # Newton's steps of a logistic fit
            p = 1 / (1 + np.exp(-np.clip(x[train] @ beta, -30, 30)))
            h = (x[train] * (p * (1 - p))[:, None]).T @ x[train] + ridge
            beta += np.linalg.solve(h, x[train].T @ (t[train] - p) - 1e-6 * len(y) * beta)
        e = np.clip(1 / (1 + np.exp(-np.clip(x[test] @ beta, -30, 30))), clip, 1 - clip)
        psi[test] = arms[1] - arms[0] + t[test] * (y[test] - arms[1]) / e - (1 - t[test]) * (y[test] - arms[0]) / (1 - e)
    return float(psi.mean()), float(psi.std(ddof=1) / np.sqrt(len(psi)))


def scenario_grid(rows: DataFrame, scenarios: dict[str, Column], horizons: dict[int, str], xs: list[str], folds: int = 5, placebo_horizon: int = 5, trials: int = 20, least: int = 200, least_treated: int = 20) -> DataFrame:
    """An effect for every scenario (a 0/1 column), ticker and horizon (a target column), with a placebo p-value at one
    horizon from treatments shifted in a circle.

    A cell is one ticker's days, bounded by the calendar; cells are fitted as groups, so the grid is one job. Cells of
    too few rows or treated rows have null effects.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("scenario"), c.cast("double").alias("t"), F.lit(h).alias("horizon"), F.col(y).alias("y")) for s, c in scenarios.items() for h, y in horizons.items()])
    long = rows.select("ticker", "ts", *xs, F.inline(cells)).dropna()

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        y, t, x = pdf["y"].to_numpy(float), pdf["t"].to_numpy(float), pdf[xs].to_numpy(float)
        scenario, ticker, horizon = key
        n1 = int(t.sum())
        blocks = np.array_split(t, folds)
        enough = len(y) >= least and least_treated <= n1 <= len(y) - least_treated and all(0 < n1 - b.sum() for b in blocks)
        ate, se = aipw(y, t, x, folds) if enough else (np.nan, np.nan)
        p = np.nan
        if enough and horizon == placebo_horizon:
            shifts = np.random.default_rng(horizon).choice(np.arange(5, len(y) - 5), min(trials, len(y) - 10), replace=False)
            p = (1 + sum(abs(aipw(y, np.roll(t, s), x, folds)[0]) >= abs(ate) for s in shifts)) / (1 + len(shifts))
        return pd.DataFrame([(scenario, ticker, horizon, ate, se, ate - 1.96 * se, ate + 1.96 * se, n1, len(y) - n1, p)], columns=[c.split()[0] for c in GRID.split(", ")])

    got = long.groupBy("scenario", "ticker", "horizon").applyInPandas(fit, GRID)
    return got.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def master_rows(grid: DataFrame, stability: DataFrame, tickers: list[str], horizons: list[int], focus: tuple[str, int]) -> DataFrame:
    """One row a scenario: effects as columns by ticker and horizon, the focus cell's counts, the share of tickers with the
    more frequent sign at the focus horizon, and the mean share of subsamples (``stability``: scenario, n_agree, n_valid)
    that agree in sign."""
    cell = lambda t, h, c: F.max(F.when((F.col("ticker") == t) & (F.col("horizon") == h), F.col(c)))
    wide = [cell(t, h, "ate").alias(f"ate_{t.lower()}_h{h}") for t in tickers for h in horizons]
    at = (F.col("horizon") == focus[1]) & F.col("ate").isNotNull()
    modal = F.greatest(F.count_if(at & (F.col("ate") > 0)), F.count_if(at & (F.col("ate") < 0))) / F.nullif(F.count_if(at), F.lit(0))
    rows = grid.groupBy("scenario").agg(*wide, cell(*focus, "n_treated").alias("n_treated"), cell(*focus, "n_control").alias("n_control"), modal.alias("consistency"))
    steady = stability.where("n_valid > 0").groupBy("scenario").agg(F.avg(F.col("n_agree") / F.col("n_valid")).alias("stability"))
    return rows.join(steady, "scenario", "left")


def regime_effects(effects: DataFrame, by: str = "regime") -> DataFrame:
    """By regime: rows, treated rows, mean and deviation of effects, and the share below zero."""
    return effects.groupBy(by).agg(F.count("effect").alias("n"), F.sum("treated").cast("long").alias("n_treated"), F.avg("effect").alias("cate_mean"), F.stddev_samp("effect").alias("cate_std"), F.avg((F.col("effect") < 0).cast("int")).alias("frac_negative"))


def robustness(rows: DataFrame, driver: str, targets: dict[int, str], controls: dict[str, list[str]], cuts: dict[str, float], split: Column, order: str = "ts") -> DataFrame:
    """Local projections under variants: before and after ``split`` holds, thresholds at quantiles of the driver, and sets of controls.

    (kind, variant, horizon, n, estimate, std_error, low, high); where one thing varies the first of the others holds.
    """
    first_controls, first_cut = next(iter(controls.values())), next(iter(cuts.values()))
    needed = {driver, order, *targets.values(), *(x for xs in controls.values() for x in xs)}
    rows = rows.select(*needed, split.alias("__after")).persist()  # read by every variant's fits, which end here
    limits = rows.agg(*[F.percentile(driver, q).alias(name) for name, q in cuts.items()]).first()
    base = next(name for name, q in cuts.items() if q == first_cut)
    over = lambda df, name: df.withColumn("__t", (F.col(driver) > F.lit(limits[name])).cast("int"))
    runs = [("subsample", n, over(rows.where(c), base), first_controls) for n, c in (("before", ~F.col("__after")), ("after", F.col("__after")))]
    runs += [("threshold", n, over(rows, n), first_controls) for n in cuts] + [("controls", n, over(rows, base), xs) for n, xs in controls.items()]
    out = None
    for kind, name, df, xs in runs:
        got = local_projection(df, "__t", xs, targets, order).select(F.lit(kind).alias("kind"), F.lit(name).alias("variant"), "*")
        out = got if out is None else out.unionByName(got)
    rows.unpersist()
    return out
