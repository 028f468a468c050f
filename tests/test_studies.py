"""Contexts, scenarios, local times, stores, and estimators on data with a planted answer."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators import context as K
from tidemark.operators import estimators as E
from tidemark.operators import scenarios as C
from tidemark.operators import selection as S
from tidemark.operators import store
from tidemark.operators import upserts as U

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(k) for k in range(n)]


def test_local_times_refuse_what_the_clock_skips_or_repeats(spark):
    rows = {
        "2024-03-10 02:30:00": (None, "skipped by the clock"), "2024-11-03 01:30:00": (None, "repeated by the clock"), "2024-07-01 12:00:00": (dt.datetime(2024, 7, 1, 16), None), "2024-01-01 12:00:00": (dt.datetime(2024, 1, 1, 17), None),
        "2024-07-01T12:00:00+02:00": (dt.datetime(2024, 7, 1, 10), None), "2024-07-01T12:00:00Z": (dt.datetime(2024, 7, 1, 12), None), "2025-02-01 00:00:00": (None, "in the future"), "soon": (None, "not a timestamp"), " ": (None, "required"),
    }
    utc, rule = D.to_utc(F.col("x"), "America/New_York", F.lit("2025-01-01").cast("timestamp"))
    assert {r.x: (r.u, r.v) for r in spark.createDataFrame([(x,) for x in rows], "x string").select("x", utc.alias("u"), rule.alias("v")).collect()} == rows
    plain = {"2024-01-05": (dt.date(2024, 1, 5), None), "2024-01-05 10:00:00": (None, "not a plain date"), "2024-13-01": (None, "not a date"), "2024-03-01": (None, "in the future"), "": (None, "required")}
    day, rule = D.business_date(F.col("x"), F.lit("2024-02-01").cast("date"))
    assert {r.x: (r.d, r.v) for r in spark.createDataFrame([(x,) for x in plain], "x string").select("x", day.alias("d"), rule.alias("v")).collect()} == plain


def test_context_lags_text_and_carries_macro(spark):
    p = spark.createDataFrame([(d, "G", 100.0 + k) for k, d in enumerate(days(30))], "ts date, ticker string, close double")
    m = spark.createDataFrame([(days(30)[0], "rate", 1.0), (days(30)[10], "rate", 3.0)], "ts date, series_id string, value double")
    text = spark.createDataFrame([(days(30)[4], 7, 0.5)], "ts date, n_articles long, mean_tone double")
    topics = spark.createDataFrame([(days(30)[4], 0.25)], "ts date, topic_0 double")
    net = spark.createDataFrame([(days(30)[k], float(k)) for k in (0, 7, 14)], "ts date, net double")
    got = K.build_context(p, "G", m, ["rate"], text, topics, net, rank=5).orderBy("ts").collect()
    assert [(r.n_articles, r.mean_tone, r.topic_0) for r in got[4:7]] == [(0.0, None, 0.0), (7.0, 0.5, 0.25), (0.0, None, 0.0)]
    assert [r.rate_chg_5d for r in got[9:16]] == [0.0, 2.0, 2.0, 2.0, 2.0, 2.0, 0.0] and got[4].rate_chg_5d is None
    assert got[5].G_ret_5d == pytest.approx(math.log(105 / 100)) and got[19].G_rvol_20d is None and got[20].G_rvol_20d is not None
    assert got[7].net_z == pytest.approx((7 - 1.4) / np.std([0, 0, 0, 0, 7], ddof=1)) and got[3].net_z is None
    assert K.build_context(p, "G", m, ["rate"]).columns == ["ts", "rate_chg_5d", "rate_chg_20d", "G_ret_5d", "G_ret_20d", "G_rvol_20d"]


def test_feature_sets_ablations_and_views():
    names = ["G_ret_5d", "G_rvol_20d", "S_ret_5d", "rate_chg_5d", "n_articles", "topic_3"]
    assert K.feature_columns(names, "full", "G") == names and K.feature_columns(names, "lean", "G") == names[3:]
    assert K.feature_columns(names, "lean_own", "G") == [*names[:2], *names[3:]]
    with pytest.raises(ValueError):
        K.feature_columns(names, "other", "G")
    assert K.split_views(names) == (names[:4], names[4:])
    assert K.ablations(names, {"news": ("n_articles", "topic_"), "none": ("zzz",)}) == {"all": names, "no_news": names[:4], "only_news": names[4:]}


def study(spark, effect=0.5, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    y = effect * t + x + 0.3 * rng.normal(size=n)
    return spark.createDataFrame([(d, "A", float(a), int(b), float(c), float(v)) for d, a, b, c, v in zip(days(n), x, t, y, rng.normal(size=n), strict=True)], "ts date, ticker string, x double, t int, y double, noise double")


def test_scenario_grid_finds_the_planted_effect(spark):
    rows = study(spark)
    got = {(r.scenario, r.horizon): r for r in C.scenario_grid(rows, {"real": F.col("t"), "rare": (F.col("x") > 9).cast("int")}, {1: "noise", 5: "y"}, ["x"], trials=15).collect()}
    hit, none, rare = got["real", 5], got["real", 1], got["rare", 5]
    assert abs(hit.ate - 0.5) < 4 * hit.se < 0.3 and hit.placebo_pvalue <= 0.1 and hit.ci_low < 0.5 < hit.ci_high
    assert abs(none.ate) < 4 * none.se and none.placebo_pvalue is None
    assert (rare.ate, rare.n_treated, rare.n_control) == (None, 0, 600)


def test_master_rows(spark):
    grid = spark.createDataFrame([("s", "A", 5, 0.2, 9, 90), ("s", "B", 5, -0.1, 8, 80), ("s", "C", 5, 0.3, 7, 70), ("s", "A", 1, 0.4, 6, 60)], "scenario string, ticker string, horizon int, ate double, n_treated long, n_control long")
    steady = spark.createDataFrame([("s", "A", 3, 4), ("s", "B", 1, 4), ("s", "C", 0, 0)], "scenario string, ticker string, n_agree long, n_valid long")
    r = C.master_rows(grid, steady, ["A", "B"], [1, 5], ("A", 5)).first()
    assert (r.ate_a_h1, r.ate_a_h5, r.ate_b_h5, r.ate_b_h1, r.n_treated, r.n_control) == (0.4, 0.2, -0.1, None, 9, 90)
    assert r.consistency == pytest.approx(2 / 3) and r.stability == pytest.approx(0.5)


def test_robustness_variants(spark):
    rows = study(spark, effect=0.0).withColumn("driver", F.col("noise")).withColumn("out", F.when(F.col("noise") > 1, 1.0).otherwise(0.0) + 0.1 * F.col("x"))
    got = {(r.kind, r.variant): r for r in C.robustness(rows, "driver", {1: "out"}, {"x": ["x"], "none": []}, {"decile": 0.9, "half": 0.5}, F.col("ts") >= F.lit(days(600)[300])).collect()}
    assert set(got) == {("subsample", "before"), ("subsample", "after"), ("threshold", "decile"), ("threshold", "half"), ("controls", "x"), ("controls", "none")}
    assert got["subsample", "before"].n == 300 and got["threshold", "decile"].estimate > got["threshold", "half"].estimate > 0.2


def test_row_effects_and_regimes(spark):
    rows = study(spark, effect=2.0).withColumnRenamed("t", "treated")
    got = C.regime_effects(E.row_effects(rows, "y", "treated", ["x"]).withColumn("regime", F.col("noise") > 0)).collect()
    assert len(got) == 2 and all(abs(r.cate_mean - 2) < 0.3 and r.frac_negative < 0.05 for r in got) and sum(r.n for r in got) == 600


def test_placebo_and_permutation_tell_effect_from_none(spark):
    rng = np.random.default_rng(5)
    t = (rng.random(400) < 0.2).astype(int)
    rows = spark.createDataFrame([(d, "A", int(a), float(a + 0.2 * e), float(e)) for d, a, e in zip(days(400), t, rng.normal(size=400), strict=True)], "ts date, ticker string, t int, y double, z double")
    assert E.placebo(rows, "y", "t", "ticker").first().p_value < 0.05 < E.placebo(rows, "z", "t", "ticker").first().p_value
    rows = rows.withColumn("tt", F.col("t").cast("double"))
    assert E.block_permutation(rows, "tt", "y", "ts", 5, 60).first().p_value < 0.05 < E.block_permutation(rows, "tt", "z", "ts", 5, 60).first().p_value
    b = E.block_bootstrap(rows, "y", "ts", 10, 100).first()
    assert b.low < t.mean() < b.high and b.replicates == 100


def test_shocks_match_by_column_and_flip(spark):
    impact = np.array([[-1.0, 0.5], [-2.0, -0.5]])
    assert E.match_shocks(impact, {"up": {0: 1, 1: 1}, "turn": {0: 1, 1: -1}}) == {"up": (0, -1), "turn": (1, 1)}
    assert E.match_shocks(impact, {"a": {0: 1, 1: 1}, "b": {0: 1, 1: 1}}) is None
    rng = np.random.default_rng(2)
    y = np.zeros((300, 2))
    for k in range(1, 300):
        y[k] = 0.5 * y[k - 1] + rng.normal(size=2)
    got = E.sign_restricted_irf(spark, y, 1, 3, {"up": {0: 1, 1: 1}}, accepted=40).collect()
    assert {r.accepted for r in got} == {40} and all(r.low > 0 for r in got if r.step == 0)
    assert next(r for r in got if (r.step, r.variable) == (1, 0)).median < next(r for r in got if (r.step, r.variable) == (0, 0)).median


def test_models_learn_what_is_there(spark):
    rng = np.random.default_rng(7)
    n = 600
    x = rng.normal(size=(n, 2))
    y = 3 * x[:, 0] + 0.1 * rng.normal(size=n)
    part = ["train" if k < 300 else "val" if k < 450 else "test" for k in range(n)]
    rows = spark.createDataFrame([(d, float(a), float(b), float(c), q) for d, (a, b), c, q in zip(days(n), x, y, part, strict=True)], "ts date, a double, b double, y double, part string")
    assert E.ridge_probe(rows, "y", ["a", "b"], "part").first().test_rmse < 0.3
    p, w = E.boosted_splits(rows, "y", ["a", "b"], [(k, F.col("part") == "train", F.col("part") == "val", F.col("part") == "test") for k in (1, 2)], 10)
    assert p.groupBy("split_id").count().collect() == [(1, 150), (2, 150)] or p.count() == 300
    assert {r.split_id: r.feature for r in w.where("importance > 0.9").collect()} == {1: "a", 2: "a"}
    assert E.canonical_factors(rows, ["a", "b"], ["y"], F.lit(True), 1).first().correlation > 0.99
    scored = E.canonical_scores(rows, ["a", "b"], ["y"], F.lit(True), 1)
    assert scored.agg(F.corr("left_1", "right_1")).first()[0] > 0.99 and scored.agg(F.stddev_pop("left_1")).first()[0] == pytest.approx(1, abs=1e-3)
    up = rows.withColumn("up", (F.col("y") > 0).cast("int"))
    probe = E.logistic_probe(up, "up", ["a", "b"], "part").first()
    assert probe.test_auc > 0.98 and probe.test_accuracy > 0.9
    pcs = E.whitened_pca(rows, ["a", "y"], F.lit(True), 1).agg(F.stddev_pop("pc_1")).first()[0]
    assert pcs == pytest.approx(1, abs=1e-6)
    two = rows.withColumns({"a": F.col("a") * 0.1 + F.when(F.col("b") > 0, 5).otherwise(-5), "c": F.col("y") * 0.01})
    got = E.regimes(two, ["a", "c"], F.lit(True), k=2).groupBy("cluster_id").agg(F.min(F.signum("b")).alias("lo"), F.max(F.signum("b")).alias("hi")).where("cluster_id >= 0").collect()
    assert len(got) == 2 and all(r.lo == r.hi for r in got)


def test_garch_follows_the_volatility(spark):
    rng = np.random.default_rng(11)
    scale = np.where(np.arange(700) // 100 % 2 == 0, 0.5, 3.0)
    r = scale * rng.normal(size=700)
    rows = spark.createDataFrame([("A", d, float(v), float(s)) for d, v, s in zip(days(700), r, scale, strict=True)], "ticker string, ts date, r double, scale double")
    got = E.garch_forecast(rows, "ticker", "ts", "r", 300).join(rows.drop("r"), ["ticker", "ts"])
    by = {r.scale: r.f for r in got.groupBy("scale").agg(F.avg("forecast").alias("f")).collect()}
    assert by[3.0] > 1.5 * by[0.5]


def test_topics_split_two_vocabularies(spark):
    rng = np.random.default_rng(1)
    sets = [[f"gold{k}" for k in range(10)], [f"wheat{k}" for k in range(10)]]
    rows = spark.createDataFrame([(i, [str(w) for w in rng.choice(sets[i % 2], 30)]) for i in range(60)] + [(100, ["unknown"]), (101, [])], "i int, words array<string>")
    got = {r.i: r.topic_id for r in E.topic_model(rows.where("i < 60"), "words", 2, rounds=30)(rows).collect()}
    assert got[100] == got[101] == -1 and {got[i] for i in range(0, 60, 2)} != {got[i] for i in range(1, 60, 2)} and len({got[i] for i in range(0, 60, 2)}) == 1


def test_append_only_takes_a_key_once(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "c"), (2, "b"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in U.append_only(old, new, ["k"]).collect()] == [(2, "b")]


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}"
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1,)], "k int")
    for stamp in ("2024-01-01", "2024-01-02", "2024-01-03"):
        assert store.snapshot({"a": a, "b": b}, f"{root}/snap", stamp, keep=2) == {"a": 2, "b": 1}
    assert store.names(spark, f"{root}/snap") == ["2024-01-02", "2024-01-03"] and store.manifest(spark, f"{root}/snap", "2024-01-03") == {"a": 2, "b": 1}
    a.write.parquet(f"{root}/db/a")
    steps = {"001_wide": [("a", "SELECT *, upper(v) AS w FROM {t}")], "002_less": [("a", "SELECT k, w FROM {t}")]}
    assert store.migrate(spark, f"{root}/db", steps, "2024-01-01") == ["001_wide", "002_less"] and store.migrate(spark, f"{root}/db", steps, "2024-01-02") == []
    assert sorted(map(tuple, spark.read.parquet(f"{root}/db/a").collect())) == [(1, "X"), (2, "Y")]
    store.save_model(spark, f"{root}/models", "v1", {"beta": [1.5, -2.0]}, {"rows": 2})
    assert store.load_model(spark, f"{root}/models", "v1") == ({"beta": [1.5, -2.0]}, {"rows": 2})
    with pytest.raises(ValueError):
        store.save_model(spark, f"{root}/models", "v1", {}, {})
    assert store.land({"2024": a, "2025": b}, f"{root}/land") == ["2024", "2025"] and store.land({"2025": b, "2026": b}, f"{root}/land") == ["2026"]
    assert store.preflight({"a": a}) == {"a": 2}
    with pytest.raises(ValueError, match="b, c"):
        store.preflight({"a": a, "c": b.limit(0), "b": b.limit(0)})
    ran = []
    step = lambda name: lambda df: ran.append(name) or df.withColumn(name, F.lit(1))
    steps = [("one", step("one")), ("two", step("two"))]
    assert store.stages(b, steps, f"{root}/run").columns == ["k", "one", "two"]
    assert store.stages(b, steps, f"{root}/run").columns == ["k", "one", "two"] and ran == ["one", "two"]
    store.stages(b, steps, f"{root}/run", only="two")
    assert ran == ["one", "two", "two"]


def test_bridge_quotas_and_cap(spark):
    assert S.bridge_quotas(5, {"fr": 3}, 10, 0.6, 0.4) == {None: 5, "fr": 3}
    assert S.bridge_quotas(100, {"fr": 50, "de": 30, "zh": 1}, 20, 0.6, 0.4) == {None: 13, "fr": 3, "de": 3, "zh": 1}
    assert S.bridge_quotas(2, {"fr": 50, "de": 30}, 20, 0.6, 0.4) == {None: 2, "fr": 10, "de": 8}
    assert S.ceiled_shares({"a": 5, "b": 5, "c": 1}, 6, 9) == {"a": 3, "b": 3, "c": 0} and S.ceiled_shares({"a": 2, "b": 9}, 8, 3) == {"a": 2, "b": 3}
    rows = spark.createDataFrame([(d, i, ["fr", "de", "en"][i % 3], i % 3 != 2) for d in (1, 2) for i in range(90)] + [(3, 1, "en", False)], "day int, i int, lang string, bridge boolean")
    got = S.bridge_cap(rows, "day", F.col("bridge"), "lang", F.col("i") >= 45, ["i"], 20)
    n = {(r.day, r.lang): r["count"] for r in got.groupBy("day", "lang").count().collect()}
    assert n == {(d, k): v for d in (1, 2) for k, v in {"en": 14, "fr": 3, "de": 3}.items()} | {(3, "en"): 1}
    assert sorted(r.i for r in got.where("day = 1 and lang = 'fr'").collect()) == [0, 30, 60]
    assert got.where("day = 1 and lang = 'en' and i >= 45").count() == 7
