"""Models and resampling: fitted by Spark's library, by NumPy on small matrices, or replicated over a dimension of seeds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import hash_order


def _vectors(df: DataFrame, xs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip").transform(df)


def _share(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the hash of a key."""
    return F.conv(F.substring(hash_order(key, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)


def doubly_robust_ate(df: DataFrame, y: str, treated: str, xs: list[str], key: str, folds: int = 3, clip: float = 0.02, least: int = 200, least_treated: int = 20, seed: str = "dr") -> DataFrame:
    """Average treatment effect by augmented inverse propensity weighting, cross-fitted over hashed folds.

    Outcomes are linear in ``xs`` for each arm and propensities logistic. One row: n, treated rows, effect and its
    deviation from the influence function; null effects below ``least`` rows or ``least_treated`` treated ones.
    """
    rows = df.select(y, treated, *xs, key).dropna().withColumn("fold", F.floor(_share(F.col(key), seed) * folds).cast("int")).persist()  # nine fits read it
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(treated).cast("int")), F.lit(0)).alias("t")).first()
    schema = "n long, n_treated long, effect double, std_error double"
    if size["n"] < least or size["t"] < least_treated or size["n"] - size["t"] < least_treated:
        return df.sparkSession.createDataFrame([(size["n"], size["t"], None, None)], schema)
    rows = _vectors(rows.withColumn("label", F.col(treated).cast("double")), xs)
    parts = []
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        propensity = LogisticRegression(featuresCol="__x", labelCol="label", regParam=1e-3).fit(train)
        arms = [LinearRegression(featuresCol="__x", labelCol=y, regParam=1e-6, predictionCol=f"m{a}").fit(train.where(F.col("label") == a)) for a in (0, 1)]
        scored = propensity.transform(test).withColumn("e", F.least(F.greatest(vector_to_array("probability")[1], F.lit(clip)), F.lit(1 - clip)))
        for arm in arms:
            scored = arm.transform(scored)
        t = F.col("label")
        psi = F.col("m1") - F.col("m0") + t * (F.col(y) - F.col("m1")) / F.col("e") - (1 - t) * (F.col(y) - F.col("m0")) / (1 - F.col("e"))
        parts.append(scored.select(psi.alias("psi"), t.alias("t")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    got = whole.agg(F.count(F.lit(1)), F.sum("t").cast("long"), F.avg("psi"), F.stddev_samp("psi") / F.sqrt(F.count(F.lit(1)))).first()
    rows.unpersist()
    return df.sparkSession.createDataFrame([tuple(got)], schema)


def row_effects(df: DataFrame, y: str, treated: str, xs: list[str]) -> DataFrame:
    """Rows without nulls with ``effect``: one boosted outcome model an arm (a T-learner, in place of a causal forest)."""
    rows = _vectors(df.dropna(subset=[y, treated, *xs]), xs)
    for a in (0, 1):
        rows = GBTRegressor(featuresCol="__x", labelCol=y, maxIter=15, maxDepth=3, seed=1, predictionCol=f"__m{a}").fit(rows.where(F.col(treated).cast("int") == a)).transform(rows)
    return rows.withColumn("effect", F.col("__m1") - F.col("__m0")).drop("__x", "__m0", "__m1")


def conditional_effects(df: DataFrame, y: str, treated: str, xs: list[str], by: str) -> DataFrame:
    """Mean and spread of ``row_effects`` by group."""
    return row_effects(df, y, treated, xs).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("effect").alias("effect"), F.stddev_samp("effect").alias("spread"))


def placebo(df: DataFrame, y: str, treated: str, key: str, order: str = "ts", shifts: range = range(5, 61)) -> DataFrame:
    """Share of shifted treatments, both ways, whose difference in means is as large as the real one; one job for all shifts."""
    rows = df.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    offsets = F.array(*[F.lit(s * k) for k in shifts for s in (-1, 1)], F.lit(0))
    moved = rows.select(key, F.col(treated).cast("int").alias("t"), F.explode(offsets).alias("shift"), "at").withColumn("at", F.col("at") + F.col("shift"))
    both = moved.join(rows.select(key, "at", y), [key, "at"])
    diffs = both.groupBy("shift").agg((F.avg(F.when(F.col("t") == 1, F.col(y))) - F.avg(F.when(F.col("t") == 0, F.col(y)))).alias("d")).where("d is not null")
    real = diffs.where("shift = 0").select(F.col("d").alias("effect"))
    # ``real`` is one row
    return diffs.where("shift <> 0").join(F.broadcast(real)).agg(F.max("effect").alias("effect"), ((F.count_if(F.abs("d") >= F.abs("effect")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("n_shifts"))


def block_bootstrap(df: DataFrame, value: str, order: str, block: int, replicates: int, level: float = 0.95, seed: str = "bb") -> DataFrame:
    """Mean and percentile interval over replicates made of blocks whose starts are hashed; each replicate is a group."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy(order)) - 1).alias("at"))
    n = rows.count()
    blocks = -(-n // block) if n else 0
    if not blocks:
        return df.sparkSession.createDataFrame([], "mean double, low double, high double, replicates long")
    spans = max(1, n - block + 1)
    starts = df.sparkSession.range(replicates).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("nth"))
    starts = starts.withColumn("start", F.floor(_share(F.concat_ws(":", "rep", "nth"), seed) * spans))
    places = starts.select("rep", F.explode(F.sequence("start", F.least(F.col("start") + block - 1, F.lit(n - 1)))).alias("at"))
    means = places.join(rows, "at").groupBy("rep").agg(F.avg("v").alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.count(F.lit(1)).alias("replicates"))


def block_permutation(df: DataFrame, x: str, y: str, order: str, block: int, replicates: int, seed: str = "bp") -> DataFrame:
    """Add-one p-value of a correlation against block-wise permutations of ``x``."""
    from .stats import correlation

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.row_number().over(Window.orderBy(order)) - 1).alias("at"))
    n = rows.count() // block * block
    rows = rows.where(F.col("at") < n).withColumns({"b": F.floor(F.col("at") / block), "o": F.col("at") % block})
    ids = rows.select("b").distinct()
    reps = df.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    dealt = ids.join(F.broadcast(reps)).withColumn("to", F.row_number().over(Window.partitionBy("rep").orderBy(hash_order(F.concat_ws(":", "rep", "b"), seed))) - 1)
    moved = rows.select("b", "o", "x").join(dealt, "b").select("rep", F.col("to").alias("b"), "o", "x")
    null = moved.join(rows.select("b", "o", "y"), ["b", "o"]).groupBy("rep").agg(correlation("x", "y").alias("c"))
    real = rows.agg(correlation("x", "y").alias("ic"))
    return null.join(F.broadcast(real)).agg(F.max("ic").alias("ic"), ((F.count_if(F.abs("c") >= F.abs("ic")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("replicates"))


def boosted(df: DataFrame, y: str, xs: list[str], validation: str, test: str, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(predictions on test rows, importances) of boosted trees stopped early on validation rows."""
    rows = _vectors(df.dropna(subset=[y]).na.fill(0.0, subset=xs), xs)
    model = GBTRegressor(featuresCol="__x", labelCol=y, maxIter=rounds, maxDepth=4, seed=1, validationIndicatorCol=validation).fit(rows.where(~F.col(test)))
    weights = df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(xs, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
    return model.transform(rows.where(F.col(test))).drop("__x"), weights


def logistic_probe(df: DataFrame, label: str, xs: list[str], part: str, penalties=(0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """Test accuracy and area under the curve of a logistic model whose penalty is the best on validation rows."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = _vectors(df.dropna(subset=[label, *xs]).withColumn("__y", F.col(label).cast("double")), xs).cache()
    rate = BinaryClassificationEvaluator(labelCol="__y", rawPredictionCol="rawPrediction")
    fits = [(rate.evaluate(m.transform(rows.where(F.col(part) == "val"))), -p, m) for p in penalties for m in [LogisticRegression(featuresCol="__x", labelCol="__y", regParam=p).fit(rows.where(F.col(part) == "train"))]]
    val, penalty, model = max(fits, key=lambda f: f[:2])
    scored = model.transform(rows.where(F.col(part) == "test"))
    out = (float(-penalty), float(val), float(rate.evaluate(scored)), scored.agg(F.avg((F.col("prediction") == F.col("__y")).cast("double"))).first()[0])
    rows.unpersist()
    return df.sparkSession.createDataFrame([out], "penalty double, val_auc double, test_auc double, test_accuracy double")


def boosted_splits(df: DataFrame, y: str, xs: list[str], splits: list[tuple[int, Column, Column, Column]], rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(predictions with split_id, importances by split): ``boosted`` anew for each (id, train, validation, test rows)."""
    predictions = weights = None
    for k, train, validation, test in splits:
        rows = df.where(train | validation | test).withColumns({"__val": validation, "__test": test})
        p, w = (x.withColumn("split_id", F.lit(k)) for x in boosted(rows, y, xs, "__val", "__test", rounds))
        p = p.drop("__val", "__test")
        predictions, weights = (p, w) if predictions is None else (predictions.unionByName(p), weights.unionByName(w))
    return predictions, weights


def topic_model(train: DataFrame, words: str, k: int, size: int = 2000, rounds: int = 10, floor: float = 0.3):
    """A function that gives rows with an array column of words their topic_id and its weight; -1 below ``floor`` and
    for no known word. Latent Dirichlet allocation over the ``size`` most frequent words stands in for clustered embeddings."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    counter = CountVectorizer(inputCol=words, outputCol="__counts", vocabSize=size, minDF=2).fit(train)
    lda = LDA(featuresCol="__counts", k=k, maxIter=rounds, seed=1, optimizer="online", subsamplingRate=0.2).fit(counter.transform(train))

    def assign(rows: DataFrame) -> DataFrame:
        scored = lda.transform(counter.transform(rows)).withColumn("__p", vector_to_array("topicDistribution"))
        best = F.array_max("__p")
        known = F.aggregate(vector_to_array("__counts"), F.lit(0.0), lambda a, x: a + x) > 0
        topic = F.when(known & (best >= floor), F.array_position("__p", best) - 1).otherwise(-1).cast("int")
        return scored.withColumns({"topic_id": topic, "weight": best}).drop("__counts", "__p", "topicDistribution")

    return assign


def ridge_probe(df: DataFrame, y: str, xs: list[str], part: str, penalties=(0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """Test RMSE of a ridge whose penalty is the best on validation rows; ``part`` is train, val or test."""
    rows = _vectors(df.dropna(subset=[y, *xs]), xs).cache()
    rate = RegressionEvaluator(labelCol=y, metricName="rmse")
    fits = [(rate.evaluate(m.transform(rows.where(F.col(part) == "val"))), p, m) for p in penalties for m in [LinearRegression(featuresCol="__x", labelCol=y, regParam=p).fit(rows.where(F.col(part) == "train"))]]
    val, penalty, model = min(fits, key=lambda f: f[:2])
    test = float(rate.evaluate(model.transform(rows.where(F.col(part) == "test"))))
    rows.unpersist()
    return df.sparkSession.createDataFrame([(float(penalty), float(val), test)], "penalty double, val_rmse double, test_rmse double")


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance) of columns in one pass; null rows are left out."""
    rows = df.select(*columns).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] or 0.0
    return got["n"], np.array([got[f"m{i}"] or 0.0 for i in range(len(columns))]), cov


def whitened_pca(df: DataFrame, columns: list[str], train: Column, k: int) -> DataFrame:
    """``df`` with pc_1..pc_k of unit variance on training rows; the largest loading of each is positive."""
    _, mean, cov = moments(df.where(train), columns)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:k]
    loads = vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))
    loads *= np.sign(loads[np.abs(loads).argmax(0), np.arange(loads.shape[1])])
    score = lambda j: sum(((F.col(c) - float(mean[i])) * float(loads[i, j]) for i, c in enumerate(columns)), F.lit(0.0))
    return df.withColumns({f"pc_{j + 1}": score(j) for j in range(loads.shape[1])})


def _canonical(df: DataFrame, left: list[str], right: list[str], train: Column, k: int):
    n, mean, cov = moments(df.where(train), [*left, *right])
    p = len(left)

    def root(a):
        values, vectors = np.linalg.eigh(a + 1e-9 * np.eye(len(a)))
        return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-9))) @ vectors.T

    a, b = root(cov[:p, :p]), root(cov[p:, p:])
    u, s, v = np.linalg.svd(a @ cov[:p, p:] @ b)
    flips = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])[:k]  # the largest weight of a left factor is positive
    return n, mean, np.minimum(s[:k], 1.0), (a @ u[:, :k]) * flips, (b @ v[:k].T) * flips


def canonical_factors(df: DataFrame, left: list[str], right: list[str], train: Column, k: int) -> DataFrame:
    """(factor, correlation) between two views: singular values of their whitened cross-covariance on training rows."""
    n, _, s, _, _ = _canonical(df, left, right, train, k)
    return df.sparkSession.createDataFrame([(i + 1, float(x), n) for i, x in enumerate(s)], "factor int, correlation double, n long")


def canonical_scores(df: DataFrame, left: list[str], right: list[str], train: Column, k: int) -> DataFrame:
    """``df`` with left_1..k and right_1..k: both views' factors, fitted on training rows, of unit variance there."""
    _, mean, _, a, b = _canonical(df, left, right, train, k)
    score = lambda names, w, off, j: sum(((F.col(c) - float(mean[off + i])) * float(w[i, j]) for i, c in enumerate(names)), F.lit(0.0))
    return df.withColumns({f"left_{j + 1}": score(left, a, 0, j) for j in range(k)} | {f"right_{j + 1}": score(right, b, len(left), j) for j in range(k)})


def regimes(df: DataFrame, columns: list[str], train: Column, k: int = 4, components: int = 2, noise: float = 0.5) -> DataFrame:
    """cluster_id and confidence by a Gaussian mixture on whitened components, in place of density clustering;
    rows whose best posterior is below ``noise`` are -1."""
    scored = whitened_pca(df.dropna(subset=columns), columns, train, components)
    rows = _vectors(scored, [f"pc_{j + 1}" for j in range(components)])
    model = GaussianMixture(featuresCol="__x", k=k, seed=1, maxIter=30).fit(rows.where(train))
    best = F.array_max(vector_to_array("probability"))
    return model.transform(rows).withColumn("confidence", best).withColumn("cluster_id", F.when(F.col("confidence") < noise, -1).otherwise(F.col("prediction"))).drop("__x", "probability", "prediction")


def match_shocks(impact: np.ndarray, restrictions: dict[str, dict[int, int]]) -> dict[str, tuple[int, int]] | None:
    """(column, flip) of each shock, columns distinct, so that a flipped column has the shock's signs by variable; None if there is none."""
    signs = np.sign(impact)
    fits = {s: {c: f for c in range(impact.shape[1]) for f in (-1, 1) if all(f * signs[v, c] == sign for v, sign in cells.items())} for s, cells in restrictions.items()}

    def place(shocks: list[str], used: frozenset) -> dict | None:
        if not shocks:
            return {}
        for c, f in fits[shocks[0]].items():
            rest = None if c in used else place(shocks[1:], used | {c})
            if rest is not None:
                return {shocks[0]: (c, f)} | rest
        return None

    return place(list(restrictions), frozenset())


def sign_restricted_irf(spark, y: np.ndarray, p: int, horizon: int, restrictions: dict[str, dict[int, int]], accepted: int = 500, most: int = 50_000, seed: int = 1) -> DataFrame:
    """Percentile bands (shock, variable, step) of impulse responses over ``accepted`` stationary draws that some assignment of columns and flips
    makes meet the sign restrictions, of ``most`` draws at most.

    Coefficients and covariance are drawn from the normal-inverse-Wishart posterior, rotations uniformly;
    ``restrictions`` maps a shock to the signs of variables at impact. Draws are independent rows dealt to all tasks, in
    rounds that double until enough are accepted; the accepted draws of lowest number are kept.
    """
    n, m = len(y) - p, y.shape[1]
    x = np.hstack([np.ones((n, 1)), *[y[p - k : len(y) - k] for k in range(1, p + 1)]])
    target = y[p:]
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ target
    scale = (target - x @ beta).T @ (target - x @ beta)
    chol_x, chol_s = np.linalg.cholesky(inverse), np.linalg.cholesky(np.linalg.inv(scale))
    freedom = n - x.shape[1]

    def responses(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                low = np.tril(rng.normal(size=(m, m)), -1) + np.diag(np.sqrt(rng.chisquare(freedom - np.arange(m))))
                root = np.linalg.cholesky(np.linalg.inv(chol_s @ low @ low.T @ chol_s.T))
                b = beta + chol_x @ rng.normal(size=beta.shape) @ root.T
                companion = np.zeros((m * p, m * p))
                companion[:m] = b[1:].T
                companion[m:, : m * (p - 1)] = np.eye(m * (p - 1))
                if np.abs(np.linalg.eigvals(companion)).max() >= 1:
                    continue
                q, r = np.linalg.qr(rng.normal(size=(m, m)))
                impact = root @ (q * np.sign(np.diag(r)))
                found = match_shocks(impact, restrictions)
                if found is None:
                    continue
                power = np.eye(m * p)
                for h in range(horizon + 1):
                    cell = power[:m, :m] @ impact
                    out += [(int(i), h, v, s, float(cell[v, c] * f)) for s, (c, f) in found.items() for v in range(m)]
                    power = companion @ power
            yield pd.DataFrame(out, columns=["draw", "step", "variable", "shock", "response"])

    draws = min(most, 2 * accepted)
    while True:
        kept = spark.range(draws).mapInPandas(responses, "draw long, step int, variable int, shock string, response double")
        numbers = [r["draw"] for r in kept.where("step = 0").select("draw").distinct().orderBy("draw").limit(accepted).collect()]  # ``accepted`` numbers at most
        if len(numbers) >= accepted or draws >= most:
            break
        draws = min(most, 2 * draws)
    kept = kept.where(F.col("draw") <= (numbers[-1] if numbers else -1))
    return kept.groupBy("shock", "variable", "step").agg(F.count(F.lit(1)).alias("accepted"), *[F.percentile("response", q).alias(c) for q, c in ((0.16, "low"), (0.5, "median"), (0.84, "high"))])


def garch_forecast(returns: DataFrame, key: str, order: str, value: str, train_rows: int) -> DataFrame:
    """One-step GARCH(1,1) volatility of rows after the first ``train_rows`` of each key, its parameters by likelihood on a grid.

    A key's series is fitted in one task: it holds one row a trading day, so it is bounded by the calendar.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        r = pdf[value].to_numpy(float)
        train = r[:train_rows]
        if len(train) < 50 or len(r) <= train_rows:
            return pd.DataFrame(columns=[key, order, "forecast", "actual"])
        base, best = float(train.var()), (np.inf, 0.05, 0.9)
        for a in (0.02, 0.05, 0.1, 0.15, 0.2):
            for b in (0.6, 0.7, 0.8, 0.9, 0.95):
                if a + b < 0.999:
                    h, loss = base, 0.0
                    for x in train:
                        loss += np.log(h) + x * x / h
                        h = base * (1 - a - b) + a * x * x + b * h
                    best = min(best, (loss, a, b))
        _, a, b = best
        h, out = base, []
        for x in r:
            out.append(np.sqrt(h))
            h = base * (1 - a - b) + a * x * x + b * h
        return pd.DataFrame({key: pdf[key], order: pdf[order], "forecast": out, "actual": np.abs(r)}).iloc[train_rows:]

    rows = returns.where(F.col(value).isNotNull()).select(key, order, value)
    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(fit, f"{key} {kinds[key]}, {order} {kinds[order]}, forecast double, actual double")


def hashed_embedding(x: Column, dimension: int = 64) -> Column:
    """A deterministic unit vector of hashed words, or zeros for no word: stands where a sentence model would."""
    words = F.filter(F.split(F.lower(x), r"\W+"), lambda t: t != "")
    slot = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dimension))
    slots = F.transform(F.array(F.transform(words, slot)), lambda v: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(v, lambda s: s == i)).cast("double")))
    counts = F.flatten(slots)
    bound = F.transform(F.array(counts), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c)).alias("norm")))  # counts once, norm once
    return F.flatten(F.transform(bound, lambda s: F.transform(s["v"], lambda c: F.when(s["norm"] > 0, c / s["norm"]).otherwise(0.0).cast("float"))))


def embed_with_cache(texts: DataFrame, column: str, cache: DataFrame | None, embed: Callable[[Column], Column] = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(every row with its vector, new cache rows): each distinct text that the cache lacks is embedded once."""
    keyed = texts.withColumn("key", F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256))
    todo = keyed.select("key", F.coalesce(F.col(column), F.lit("")).alias("t")).dropDuplicates(["key"])
    todo = todo.join(cache.select("key"), "key", "left_anti") if cache is not None else todo
    fresh = todo.select("key", embed(F.col("t")).alias("vector"))
    known = fresh if cache is None else cache.select("key", "vector").unionByName(fresh)
    return keyed.join(known, "key"), fresh
