"""Evaluation metrics, clusters, regressions and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import returns as R
from tidemark.operators import selection as S
from tidemark.operators import stats as M
from tidemark.sources import tables as T
from tidemark.sources.tables import ctes

from .price_queries import LOGS
from .registry import query, rounded

CORR = "round(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0), 6)"
METRICS = "count(*) AS n, sqrt(avg((prediction - actual) ** 2)) AS rmse, avg(abs(prediction - actual)) AS mae, " + CORR.format("prediction", "actual") + " AS ic, avg((sign(prediction) = sign(actual))::int) AS hit_rate, avg(prediction) AS mean_prediction, avg(actual) AS mean_actual"
PLAIN = "n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, ic, round(hit_rate, 6) AS hit_rate, round(mean_prediction, 6) AS mean_prediction, round(mean_actual, 6) AS mean_actual"
RUNS = f"m AS (SELECT run_id, ticker, horizon, {METRICS} FROM prd GROUP BY 1, 2, 3)"
SPLITS = f"m AS (SELECT run_id, ticker, split_id, {METRICS} FROM prd GROUP BY 1, 2, 3)"


@query(ctes("prd", more=RUNS) + f"SELECT run_id, ticker, horizon, {PLAIN} FROM m")
def run_metrics(spark, d):
    return rounded(M.run_metrics(T.predictions(spark, d), ["run_id", "ticker", "horizon"]))


@query(ctes("prd", more=RUNS) + "SELECT m.run_id, m.ticker, round(m.rmse, 6) AS rmse, round(b.rmse, 6) AS base_rmse, round(m.rmse / nullif(b.rmse, 0) - 1, 6) AS relative FROM m JOIN (SELECT * FROM m WHERE run_id = 'walk') b ON m.ticker = b.ticker")
def compare_runs(spark, d):
    return rounded(M.compare_runs(M.run_metrics(T.predictions(spark, d), ["run_id", "ticker"]), "walk", ["ticker"]))


@query(ctes("prd", more=SPLITS) + "SELECT *, relative <= -0.01 AND n_wins >= n_needed AS keep FROM (SELECT ticker, count(*) AS n_splits, round(avg(a) / avg(b) - 1, 6) AS relative, count(*) FILTER (a < b) AS n_wins, ceil(round(count(*) * 0.6, 6))::bigint AS n_needed FROM (SELECT ticker, split_id, max(rmse) FILTER (run_id = 'flat') AS a, max(rmse) FILTER (run_id = 'walk') AS b FROM m GROUP BY 1, 2) WHERE b IS NOT NULL AND a IS NOT NULL GROUP BY ticker)")
def lift_decision(spark, d):
    return rounded(M.lift_decision(M.run_metrics(T.predictions(spark, d), ["run_id", "ticker", "split_id"]), "flat", "walk"))


IMP = "imp AS (SELECT 'r' || (o_custkey % 3) AS run_id, year(o_orderdate) AS split_id, o_orderpriority AS feature, sum(o_totalprice) AS importance FROM orders GROUP BY 1, 2, 3)"


@query(f"WITH {IMP}, s AS (SELECT *, importance / nullif(sum(importance) OVER (PARTITION BY run_id, split_id), 0) AS share FROM imp) SELECT run_id, feature, round(avg(share), 6) AS mean_share, round(stddev_pop(share), 6) AS std_share, count(share) AS n_splits FROM s GROUP BY 1, 2")
def importances(spark, d):
    o = T.read(spark, d, "orders")
    imp = o.groupBy(F.concat(F.lit("r"), F.col("o_custkey") % 3).alias("run_id"), F.year("o_orderdate").alias("split_id"), F.col("o_orderpriority").alias("feature")).agg(F.sum("o_totalprice").alias("importance"))
    return rounded(M.importances(imp))


FWD = LOGS + ", fw AS (SELECT ts, ticker, lead(lp, 1) OVER o - lp AS f1, lead(lp, 5) OVER o - lp AS f5 FROM lg WINDOW o AS (PARTITION BY ticker ORDER BY ts))"


@query(
    ctes("asg", more=FWD)
    + "SELECT cluster_id, ticker, horizon, count(*) AS n, round(avg(fwd), 6) AS mean, round(stddev_samp(fwd), 6) AS std, round(avg((fwd > 0)::int), 6) AS hit_rate FROM (SELECT cluster_id, ticker, 1 AS horizon, f1 AS fwd FROM asg JOIN fw USING (ts, ticker) UNION ALL SELECT cluster_id, ticker, 5, f5 FROM asg JOIN fw USING (ts, ticker)) WHERE fwd IS NOT NULL GROUP BY 1, 2, 3"
)
def cluster_forward_stats(spark, d):
    return rounded(M.cluster_forward_stats(T.clusters(spark, d), R.forward_returns(T.prices(spark, d), (1, 5)), {"fwd_1d": 1, "fwd_5d": 5}))


@query(ctes("asg") + "SELECT cluster_id, ts, ticker, confidence FROM asg QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, ts, ticker) <= 8")
def representative_dates(spark, d):
    return S.top_per_group(T.clusters(spark, d), "cluster_id", [F.desc("confidence"), "ts", "ticker"], 8).select("cluster_id", "ts", "ticker", "confidence")


@query(ctes("asg") + "SELECT cluster_id, ticker, n, rank FROM (SELECT cluster_id, ticker, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, ticker) AS rank FROM asg GROUP BY 1, 2) WHERE rank <= 3")
def dominant_topics(spark, d):
    return S.top_per_group(T.clusters(spark, d).groupBy("cluster_id", "ticker").agg(F.count(F.lit(1)).alias("n")), "cluster_id", [F.desc("n"), "ticker"], 3)


@query(ctes("news") + "SELECT c.day, doc_id, title FROM (SELECT day FROM (SELECT DISTINCT day FROM news) ORDER BY md5(day || '|ex') LIMIT 8) c LEFT JOIN news n ON c.day = n.day WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.day ORDER BY doc_id) <= 2")
def example_headlines(spark, d):
    news = T.news(spark, d)
    days = S.hash_sample(news.select("day").distinct(), "day", 8, "ex")
    return S.top_per_group(days.join(news, "day", "left").where("title is not null"), "day", ["doc_id"], 2).select("day", "doc_id", "title")


EFFECT = "ef AS (SELECT ticker, split_id, avg(actual) AS effect FROM prd WHERE run_id = 'walk' GROUP BY 1, 2), wh AS (SELECT ticker, avg(actual) AS whole FROM prd WHERE run_id = 'walk' GROUP BY 1)"


@query(ctes("prd", more=EFFECT) + "SELECT ticker, count(*) AS n, round(greatest(count(*) FILTER (effect > 0), count(*) FILTER (effect < 0)) / count(*), 6) AS modal_share, round(avg((sign(effect) = sign(whole))::int), 6) AS agreement FROM ef JOIN wh USING (ticker) GROUP BY ticker")
def sign_stability(spark, d):
    p = T.predictions(spark, d).where("run_id = 'walk'")
    both = p.groupBy("ticker", "split_id").agg(F.avg("actual").alias("effect")).join(p.groupBy("ticker").agg(F.avg("actual").alias("whole")), "ticker")
    return rounded(M.sign_stability(both, ["ticker"]))


@query(ctes("prd", more=EFFECT) + "SELECT split_id, count(*) AS n, round(greatest(count(*) FILTER (effect > 0), count(*) FILTER (effect < 0)) / count(*), 6) AS modal_share, round(avg((sign(effect) = sign(whole))::int), 6) AS agreement FROM ef JOIN wh USING (ticker) GROUP BY split_id")
def cross_metal_consistency(spark, d):
    p = T.predictions(spark, d).where("run_id = 'walk'")
    both = p.groupBy("ticker", "split_id").agg(F.avg("actual").alias("effect")).join(p.groupBy("ticker").agg(F.avg("actual").alias("whole")), "ticker")
    return rounded(M.sign_stability(both, ["split_id"]))


@query(
    ctes("prd", more="tr AS (SELECT ticker, count(*) FILTER (split_id >= 1999) AS n, round(avg(actual) FILTER (t AND split_id < 1999) - avg(actual) FILTER (NOT t AND split_id < 1999), 6) AS train, round(avg(actual) FILTER (t AND split_id >= 1999) - avg(actual) FILTER (NOT t AND split_id >= 1999), 6) AS difference FROM (SELECT ticker, split_id, actual, prediction > 0.05 AS t FROM prd WHERE run_id = 'walk') GROUP BY ticker)")
    + "SELECT ticker, n, train, difference, sign(difference) = sign(train) AS sign_agree, round(difference / nullif(train, 0), 4) AS ratio FROM tr WHERE n > 0"
)
def holdout_diff(spark, d):
    """Treated less control before and in the hold-out: whether the signs agree, and how large the later is beside the former."""
    p = T.predictions(spark, d).where("run_id = 'walk'").withColumns({"t": F.col("prediction") > 0.05, "late": F.col("split_id") >= 1999})
    mean = lambda t, late: F.avg(F.when((F.col("t") == t) & (F.col("late") == late), F.col("actual")))
    got = p.groupBy("ticker").agg(F.count_if("late").alias("n"), F.round(mean(True, False) - mean(False, False), 6).alias("train"), F.round(mean(True, True) - mean(False, True), 6).alias("difference")).where("n > 0")
    return got.withColumns({"sign_agree": F.signum("difference") == F.signum("train"), "ratio": F.round(F.try_divide("difference", F.nullif("train", F.lit(0.0))), 4)})


@query(ctes("prd") + "SELECT ticker, count(*) AS n, " + CORR.format("rx", "ry") + " AS ic FROM (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY prediction) + (count(*) OVER (PARTITION BY ticker, prediction) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY ticker ORDER BY actual) + (count(*) OVER (PARTITION BY ticker, actual) - 1) / 2.0 AS ry FROM prd WHERE run_id = 'walk') GROUP BY ticker")
def ic_spearman(spark, d):
    return rounded(M.spearman(T.predictions(spark, d).where("run_id = 'walk'"), "prediction", "actual", ["ticker"]))


@query(
    ctes("prd", more="b AS (SELECT *, lag(prediction) OVER (PARTITION BY ticker ORDER BY ts) AS base FROM prd WHERE run_id = 'walk'), f AS (SELECT ticker, regr_slope(prediction, base) AS s, regr_intercept(prediction, base) AS i FROM b WHERE split_id < 1999 GROUP BY 1), t AS (SELECT b.ticker, actual, prediction - i - s * base AS lft FROM b JOIN f ON b.ticker = f.ticker WHERE split_id >= 1999 AND base IS NOT NULL)")
    + "SELECT ticker, count(*) AS n, " + CORR.format("lft", "actual") + " AS ic FROM t GROUP BY ticker"
)
def residual_ic(spark, d):
    p = T.predictions(spark, d).where("run_id = 'walk'").withColumn("base", F.lag("prediction").over(Window.partitionBy("ticker").orderBy("ts")))
    return rounded(M.incremental_ic(p, "prediction", "base", "actual", F.col("split_id") < 1999, ["ticker"]))


LAGS = 6
DM = "l AS (SELECT ticker, ts, max((prediction - actual) ** 2) FILTER (run_id = 'walk') - max((prediction - actual) ** 2) FILTER (run_id = 'flat') AS d FROM prd GROUP BY 1, 2), c AS (SELECT *, d - avg(d) OVER (PARTITION BY ticker) AS c FROM l), g AS (SELECT ticker, d, c, " + ", ".join(f"c * lag(c, {k}) OVER (PARTITION BY ticker ORDER BY ts) AS g{k}" for k in range(1, LAGS + 1)) + " FROM c)"


@query(ctes("prd", more=DM) + "SELECT ticker, count(*) AS n, round(avg(d), 6) AS mean_difference, round(avg(d) / sqrt((sum(c * c) + " + " + ".join(f"{2 * (1 - k / (LAGS + 1))} * sum(g{k})" for k in range(1, LAGS + 1)) + ") / count(*) / count(*)), 5) AS dm FROM g GROUP BY ticker")
def dm_stat(spark, d):
    e = (F.col("prediction") - F.col("actual")) ** 2
    p = T.predictions(spark, d).groupBy("ticker", "ts").agg(F.max(F.when(F.col("run_id") == "walk", e)).alias("a"), F.max(F.when(F.col("run_id") == "flat", e)).alias("b"))
    got = M.diebold_mariano(p, "a", "b", ["ticker"], LAGS)
    return got.select("ticker", "n", F.round("mean_difference", 6).alias("mean_difference"), F.round("dm", 5).alias("dm"))


def _study(spark, d):
    """One ticker's days: yesterday's return as a treatment, later cumulative returns as targets."""
    p = T.prices(spark, d).where("ticker = 'PROMO'")
    return R.daily(p).join(R.cumulative_forward(p, 1), ["ts", "ticker"]).join(R.cumulative_forward(p, 5), ["ts", "ticker"])


LP = LOGS + """, s AS (SELECT ts, r AS x, lead(r) OVER o AS y1, CASE WHEN count(r) OVER f = 5 THEN sum(r) OVER f END AS y5 FROM rt WHERE ticker = 'PROMO' WINDOW o AS (ORDER BY ts), f AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""


def _lp(h: int) -> str:
    y = f"y{h}"
    lags = "".join(f" + {2 * (1 - k / (h + 1))} * coalesce(sum(u * lag_{k}), 0)" for k in range(1, h + 1))
    cols = ", ".join(f"lag(u, {k}) OVER (ORDER BY ts) AS lag_{k}" for k in range(1, h + 1))
    return f"""SELECT {h} AS horizon, count(*) AS n, any_value(b) AS estimate, sqrt(sum(u * u){lags}) / any_value(sxx) AS se FROM (SELECT *, {cols} FROM (SELECT ts, b, sxx, (x - mx) * ({y} - a - b * x) AS u FROM s,
        (SELECT regr_slope({y}, x) AS b, regr_intercept({y}, x) AS a, regr_sxx({y}, x) AS sxx, regr_avgx({y}, x) AS mx FROM s) WHERE x IS NOT NULL AND {y} IS NOT NULL))"""


@query(ctes("px", more=LP) + f"SELECT horizon, n, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate - 1.96 * se, 6) AS low, round(estimate + 1.96 * se, 6) AS high FROM ({_lp(1)} UNION ALL {_lp(5)})")
def local_projection_hac(spark, d):
    return rounded(M.local_projection(_study(spark, d), "r", [], {1: "cum_1d", 5: "cum_5d"}))


@query(
    ctes("px", more=LOGS)
    + """, v AS (SELECT ts, max(r) FILTER (ticker = 'STANDARD') AS a, max(r) FILTER (ticker = 'PROMO') AS b FROM rt GROUP BY ts), l AS (SELECT a, lag(a) OVER (ORDER BY ts) AS x, lag(b) OVER (ORDER BY ts) AS z FROM v WHERE a IS NOT NULL AND b IS NOT NULL),
    k AS (SELECT count(*) AS n, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, a) AS xa, covar_pop(z, a) AS za, avg(a) AS ma, avg(x) AS mx, avg(z) AS mz FROM l WHERE x IS NOT NULL AND z IS NOT NULL)
    SELECT t AS term, n, round(CASE t WHEN 'a_l1' THEN b1 WHEN 'b_l1' THEN b2 ELSE ma - b1 * mx - b2 * mz END, 6) AS estimate FROM (SELECT *, (xa * zz - za * xz) / (xx * zz - xz * xz) AS b1, (za * xx - xa * xz) / (xx * zz - xz * xz) AS b2 FROM k), (VALUES ('intercept'), ('a_l1'), ('b_l1')) q(t)"""
)
def var_ols(spark, d):
    both = R.wide(R.daily(T.prices(spark, d)), ["STANDARD", "PROMO"], "r").select("ts", F.col("STANDARD").alias("a"), F.col("PROMO").alias("b")).dropna()
    return rounded(M.var_ols(both, ["a", "b"], 1).where("equation = 'a'").select("term", "n", "estimate"))
