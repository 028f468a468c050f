"""Estimators and resampling, seeded; they have no SQL counterpart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import alignment as A
from tidemark.operators import context as K
from tidemark.operators import estimators as E
from tidemark.operators import returns as R
from tidemark.operators import scenarios as C
from tidemark.operators import stats as M
from tidemark.sources import tables as T
from tidemark.sources.tables import ctes

from .price_queries import LOGS
from .registry import query, rounded

XS = ["ret_sum", "vol", "chg_5d"]


def panel(spark, d):
    """Ticker days with confounders, a treatment (a fall yesterday beyond 3 per cent), later returns and volatility.

    One pass of windows over the prices; every column is made on the same rows, so that nothing is joined.
    """
    by = w.over("ticker")
    rows = T.prices(spark, d).withColumn("lp", w.log_price()).withColumn("r", F.col("lp") - F.lag("lp").over(by))
    ahead = lambda h: w.full(F.col("r"), by.rowsBetween(1, h), h, F.sum)
    rows = rows.withColumns({"s": w.full(F.col("r"), w.trailing("ticker", 20), 20, F.sum), "v": w.rolling_std(F.col("r"), "ticker", 20), "c": A.transform(F.col("close"), "pct_change", 5, "ticker")} | {f"cum_{h}d": ahead(h) for h in (1, 5, 20)})
    made = {"ret_sum": F.lag("s").over(by), "vol": F.lag("v").over(by), "chg_5d": F.lag("c").over(by), "fwd_vol": F.lead("v", 24).over(by)}
    rows = rows.withColumns(made).withColumn("treated", (F.col("r") < -0.03).cast("int")).withColumn("key", F.concat_ws(":", "ticker", "ts"))
    return rows.select("ts", "ticker", "r", *XS, "cum_1d", "cum_5d", "cum_20d", "fwd_vol", "treated", "key")


@query()
def ate_aipw(spark, d):
    return E.doubly_robust_ate(panel(spark, d), "cum_5d", "treated", XS, "key")


@query()
def cate(spark, d):
    """Row effects by yesterday's regime."""
    rows = E.row_effects(panel(spark, d), "cum_5d", "treated", XS)
    late = T.clusters(spark, d).withColumn("regime", F.lag("cluster_id").over(w.over("ticker"))).where("regime is not null").select("ts", "ticker", "regime")
    return C.regime_effects(rows.join(late, ["ts", "ticker"]))


def scenarios():
    return {"fall": (F.col("r") < -0.03).cast("int"), "rise": (F.col("r") > 0.03).cast("int"), "calm": (F.abs("r") < 0.005).cast("int")}


@query()
def scenario_grid(spark, d):
    return C.scenario_grid(panel(spark, d).where("r is not null"), scenarios(), {1: "cum_1d", 5: "cum_5d", 20: "cum_20d"}, XS)


PANEL = LOGS + """, pn AS (SELECT ts, ticker, r, lead(r) OVER o AS y1, CASE WHEN count(r) OVER f = 5 THEN sum(r) OVER f END AS y5 FROM rt WINDOW o AS (PARTITION BY ticker ORDER BY ts), f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
    sc AS (SELECT s AS scenario, ticker, year(ts) AS year, h AS horizon, CASE s WHEN 'fall' THEN r < -0.03 WHEN 'rise' THEN r > 0.03 ELSE abs(r) < 0.005 END AS t, CASE h WHEN 1 THEN y1 ELSE y5 END AS y
        FROM pn, (VALUES ('fall'), ('rise'), ('calm')) a(s), (VALUES (1), (5)) b(h) WHERE r IS NOT NULL),
    gr AS (SELECT scenario, ticker, horizon, round(avg(y) FILTER (t) - avg(y) FILTER (NOT t), 6) AS ate, count(*) FILTER (t) AS n_treated, count(*) FILTER (NOT t) AS n_control FROM sc WHERE y IS NOT NULL GROUP BY 1, 2, 3),
    yr AS (SELECT scenario, ticker, year, round(avg(y) FILTER (t) - avg(y) FILTER (NOT t), 6) AS ate FROM sc WHERE y IS NOT NULL AND horizon = 5 GROUP BY 1, 2, 3),
    st AS (SELECT yr.scenario, yr.ticker, count(*) FILTER (sign(yr.ate) = sign(gr.ate)) AS n_agree, count(yr.ate) AS n_valid FROM yr JOIN gr ON yr.scenario = gr.scenario AND yr.ticker = gr.ticker AND gr.horizon = 5 GROUP BY 1, 2)"""


@query(
    ctes("px", more=PANEL)
    + """SELECT g.scenario, max(ate) FILTER (ticker = 'PROMO' AND horizon = 1) AS ate_promo_h1, max(ate) FILTER (ticker = 'PROMO' AND horizon = 5) AS ate_promo_h5, max(ate) FILTER (ticker = 'STANDARD' AND horizon = 1) AS ate_standard_h1,
    max(ate) FILTER (ticker = 'STANDARD' AND horizon = 5) AS ate_standard_h5, max(n_treated) FILTER (ticker = 'PROMO' AND horizon = 5) AS n_treated, max(n_control) FILTER (ticker = 'PROMO' AND horizon = 5) AS n_control,
    round(greatest(count(*) FILTER (horizon = 5 AND ate > 0), count(*) FILTER (horizon = 5 AND ate < 0)) / nullif(count(ate) FILTER (horizon = 5), 0), 6) AS consistency,
    (SELECT round(avg(n_agree / n_valid), 6) FROM st WHERE st.scenario = g.scenario AND n_valid > 0) AS stability FROM gr g GROUP BY g.scenario"""
)
def scenario_master(spark, d):
    """Master rows over plain differences in means, with years as subsamples."""
    rows = panel(spark, d).where("r is not null")
    cells = F.array(*[F.struct(F.lit(s).alias("scenario"), (c == 1).alias("t"), F.lit(h).alias("horizon"), F.col(f"cum_{h}d").alias("y")) for s, c in scenarios().items() for h in (1, 5)])
    long = rows.select("ticker", F.year("ts").alias("year"), F.inline(cells)).where("y is not null")
    gap = F.round(F.avg(F.when(F.col("t"), F.col("y"))) - F.avg(F.when(~F.col("t"), F.col("y"))), 6).alias("ate")
    grid = long.groupBy("scenario", "ticker", "horizon").agg(gap, F.count_if("t").alias("n_treated"), F.count_if(~F.col("t")).alias("n_control"))
    years = long.where("horizon = 5").groupBy("scenario", "ticker", "year").agg(gap.alias("part"))
    both = years.join(grid.where("horizon = 5"), ["scenario", "ticker"])
    steady = both.groupBy("scenario", "ticker").agg(F.count_if(F.signum("part") == F.signum("ate")).alias("n_agree"), F.count("part").alias("n_valid"))
    return rounded(C.master_rows(grid, steady, ["PROMO", "STANDARD"], [1, 5], ("PROMO", 5)))


@query()
def projection_robustness(spark, d):
    """One ticker's response to falls: halves of the sample, thresholds, and sets of controls."""
    rows = panel(spark, d).where("ticker = 'PROMO' and r is not null").withColumn("drop", -F.col("r"))
    rows = rows.withColumn("vol_now", F.lead("vol").over(w.over("ticker")))
    return C.robustness(rows, "drop", {5: "cum_5d"}, {"lagged": XS, "same_day": ["ret_sum", "vol_now", "chg_5d"], "none": []}, {"decile": 0.9, "quartile": 0.75, "tercile": 2 / 3}, F.year("ts") >= 1996)


CONTEXT = [("1-URGENT", "urgent"), ("2-HIGH", "high")]


def _context(spark, d):
    """PROMO's context; news of 2024 is set back by 10,227 days, onto the prices' calendar."""
    news = T.news(spark, d).withColumn("ts", F.date_sub("day", 10_227))
    text = news.groupBy("ts").agg(F.count(F.lit(1)).alias("n_articles"), F.avg("tone").alias("mean_tone"))
    topics = news.groupBy("ts").agg((F.count_if(F.col("doc_id") % 5 == 1) / F.count(F.lit(1))).alias("topic_0"))
    net = T.positioning(spark, d).where("metal = '2-HIGH'").select(F.col("week").alias("ts"), (F.col("longs") - F.col("shorts")).alias("net"))
    return K.build_context(T.prices(spark, d), "PROMO", T.macro(spark, d), [s for s, _ in CONTEXT], text, topics, net, rank=60)


@query(
    ctes("px", "mx", "news", "pos")
    + """, dy AS (SELECT ts, max(ln(close)) FILTER (ticker = 'PROMO' AND close > 0) AS lp FROM px GROUP BY ts), nw AS (SELECT day - 10227 AS ts, count(*) AS n, avg(tone) AS tone, count(*) FILTER (doc_id % 5 = 1) / count(*) AS t0 FROM news GROUP BY 1),
    j AS (SELECT dy.ts, lp, lp - lag(lp) OVER (ORDER BY dy.ts) AS r, a.value AS a0, b.value AS b0, n, tone, t0, longs - shorts AS p0 FROM dy LEFT JOIN mx a ON a.ts = dy.ts AND a.series_id = '1-URGENT' LEFT JOIN mx b ON b.ts = dy.ts AND b.series_id = '2-HIGH' LEFT JOIN nw ON nw.ts = dy.ts LEFT JOIN pos ON week = dy.ts AND metal = '2-HIGH'),
    f AS (SELECT *, last_value(a0 IGNORE NULLS) OVER c AS a, last_value(b0 IGNORE NULLS) OVER c AS b, last_value(p0 IGNORE NULLS) OVER c AS p FROM j WINDOW c AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT ts, round(a - lag(a, 5) OVER o, 6) AS "1-URGENT_chg_5d", round(a - lag(a, 20) OVER o, 6) AS "1-URGENT_chg_20d", round(b - lag(b, 5) OVER o, 6) AS "2-HIGH_chg_5d", round(b - lag(b, 20) OVER o, 6) AS "2-HIGH_chg_20d", round(lp - lag(lp, 5) OVER o, 6) AS PROMO_ret_5d, round(lp - lag(lp, 20) OVER o, 6) AS PROMO_ret_20d,
    CASE WHEN count(r) OVER w = 20 THEN round(stddev_samp(r) OVER w * sqrt(252), 6) END AS PROMO_rvol_20d, coalesce(lag(n) OVER o, 0)::double AS n_articles, round(lag(tone) OVER o, 6) AS mean_tone, round(coalesce(lag(t0) OVER o, 0), 6) AS topic_0,
    CASE WHEN count(p) OVER q = 60 THEN round((p - avg(p) OVER q) / nullif(stddev_samp(p) OVER q, 0), 6) END AS net_z
    FROM f WINDOW o AS (ORDER BY ts), w AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), q AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)
def context_vectors(spark, d):
    return rounded(_context(spark, d))


@query()
def context_views(spark, d):
    """Which columns each feature set, ablation and view of the context holds."""
    names = _context(spark, d).columns[1:]
    price, text = K.split_views(names)
    sets = {k: K.feature_columns(names, k, "PROMO") for k in ("full", "lean", "lean_own")} | {"price_view": price, "text_view": text} | K.ablations(names, {"macro": ("_chg_",), "news": ("n_articles", "mean_tone", "topic_")})
    return spark.createDataFrame([(k, c) for k, v in sets.items() for c in v], "name string, feature string")


@query()
def placebo(spark, d):
    return E.placebo(panel(spark, d).where("cum_5d is not null and treated is not null"), "cum_5d", "treated", "ticker")


@query()
def block_bootstrap(spark, d):
    return E.block_bootstrap(R.daily(T.prices(spark, d).where("ticker = 'PROMO'")), "r", "ts", 20, 200)


@query()
def block_permutation(spark, d):
    p = T.prices(spark, d).where("ticker = 'PROMO'")
    return E.block_permutation(R.daily(p).join(R.cumulative_forward(p, 5), ["ts", "ticker"]), "r", "cum_5d", "ts", 20, 200)


def _splits():
    y = F.year("ts")
    return [(k, y < k - 1, y == k - 1, y == k) for k in (1997, 1998)]


@query()
def gbt_vol(spark, d):
    """Volatility of the days ahead, by trees fitted anew for each test year."""
    rows = panel(spark, d).where("fwd_vol is not null and r is not null")
    return E.boosted_splits(rows, "fwd_vol", ["r", *XS], _splits(), 15)[0].select("split_id", "ts", "ticker", F.col("fwd_vol").alias("actual"), "prediction")


@query()
def gbt_importances(spark, d):
    rows = panel(spark, d).where("fwd_vol is not null and r is not null")
    return E.boosted_splits(rows, "fwd_vol", ["r", *XS], _splits(), 15)[1]


@query()
def ridge_probe(spark, d):
    part = F.when(F.year("ts") < 1998, "train").when(F.year("ts") == 1998, "val").otherwise("test")
    return E.ridge_probe(panel(spark, d).withColumn("part", part), "cum_5d", XS, "part")


@query()
def logistic_probe(spark, d):
    part = F.when(F.year("ts") < 1996, "train").when(F.year("ts") == 1996, "val").otherwise("test")
    return E.logistic_probe(panel(spark, d).withColumn("part", part).withColumn("up", (F.col("cum_5d") > 0).cast("int")), "up", [*XS, "r"], "part")


@query()
def joint_scores(spark, d):
    return E.canonical_scores(panel(spark, d).dropna(subset=[*XS, "r"]), XS[:2], [XS[2], "r"], F.year("ts") < 1999, 2).select("ts", "ticker", "left_1", "left_2", "right_1", "right_2")


@query()
def whitened_pca(spark, d):
    return E.whitened_pca(panel(spark, d).dropna(subset=XS), XS, F.year("ts") < 1999, 2).select("ts", "ticker", "pc_1", "pc_2")


@query()
def joint_factors(spark, d):
    return E.canonical_factors(panel(spark, d).dropna(subset=[*XS, "r"]), XS[:2], [XS[2], "r"], F.year("ts") < 1999, 2)


@query()
def regimes(spark, d):
    return E.regimes(panel(spark, d), XS, F.year("ts") < 1999).select("ts", "ticker", "cluster_id", "confidence")


@query()
def svar_irf(spark, d):
    wide = R.wide(R.daily(T.prices(spark, d)), ["STANDARD", "PROMO"], "r").dropna().orderBy("ts")
    y = np.array([[r["STANDARD"], r["PROMO"]] for r in wide.collect()])  # one row a day
    return E.sign_restricted_irf(spark, y, 1, 8, {"demand": {0: 1, 1: 1}, "rotation": {0: 1, 1: -1}}, 500)


@query()
def holdout_bakeoff(spark, d):
    """RMSE of |return| forecasts after 500 days: GARCH, yesterday's, the training mean, a VAR(2) of two tickers, and trees
    on all features, on none of the returns' and on the ticker's own."""
    r = R.daily(T.prices(spark, d)).where("r is not null")
    by = w.over("ticker")
    flat = panel(spark, d).where("r is not null").withColumn("size", F.abs("r"))
    flat = flat.withColumns({"at": F.row_number().over(by), "walk": F.lag("size").over(by), "PROMO_ret_1": F.lag("r").over(by), "PROMO_ret_2": F.lag("r", 2).over(by)}).withColumnsRenamed({"vol": "PROMO_rvol_20", "ret_sum": "other_ret_20"})
    names = ["PROMO_ret_1", "PROMO_ret_2", "PROMO_rvol_20", "other_ret_20", "chg_5d"]
    means = flat.where("at <= 500").groupBy("ticker").agg(F.avg("size").alias("mean"))
    both = flat.where("at > 500").join(means, "ticker").join(E.garch_forecast(r, "ticker", "ts", "r", 500).select("ticker", "ts", "forecast"), ["ticker", "ts"])
    for kind in ("full", "lean", "lean_own"):
        rows = flat.withColumns({"val": F.col("at").between(400, 500), "test": F.col("at") > 500})
        p, _ = E.boosted(rows, "size", K.feature_columns(names, kind, "PROMO", ("_ret_", "_rvol_")), "val", "test", 10)
        both = both.join(p.select("ticker", "ts", F.col("prediction").alias(f"trees_{kind}")), ["ticker", "ts"])
    wide = R.wide(flat, ["STANDARD", "PROMO"], "size").dropna().withColumnsRenamed({"STANDARD": "a", "PROMO": "b"})
    wide = wide.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")))  # one row a day
    lags = {f"{c}_l{k}": F.lag(c, k).over(Window.partitionBy(F.lit(0)).orderBy("ts")) for c in "ab" for k in (1, 2)}
    wide = wide.withColumns(lags)
    fits = {(x["equation"], x["term"]): x["estimate"] for x in M.var_ols(wide.where("at <= 500").select("ts", "a", "b"), ["a", "b"], 2).collect()}
    line = lambda e: F.lit(fits[e, "intercept"] or 0.0) + sum((F.col(t) * F.lit(fits[e, t] or 0.0) for t in lags), F.lit(0.0))
    var = wide.select("ts", F.inline(F.array(*[F.struct(F.lit(t).alias("ticker"), line(e).alias("var2")) for e, t in (("a", "STANDARD"), ("b", "PROMO"))])))
    both = both.join(var, ["ticker", "ts"], "left")
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("size")) ** 2))
    return both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), rmse("forecast").alias("garch"), *[rmse(c).alias(c) for c in ("walk", "mean", "var2", "trees_full", "trees_lean", "trees_lean_own")])


@query()
def embed_cache(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text", "lang")
    _, cache = E.embed_with_cache(docs.where("lang = 'en'").drop("lang"), "text", None)
    rows, fresh = E.embed_with_cache(docs.drop("lang"), "text", cache)
    return rows.join(fresh.select("key", F.lit(True).alias("is_new")), "key", "left").select("doc_id", "key", F.coalesce("is_new", F.lit(False)).alias("is_new"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query()
def topic_assign(spark, d):
    """Topics fitted on all documents and given to each."""
    docs = T.read(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\W+"), lambda t: F.length(t) > 3).alias("words"))
    return E.topic_model(docs, "words", 6)(docs).select("doc_id", "topic_id", F.round("weight", 6).alias("weight"))
