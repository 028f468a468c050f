"""Cases that the tables don't hold: bad prices, nulls, ties, malformed files, repeated runs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import alignment as A
from tidemark.operators import estimators as E
from tidemark.operators import harness as H
from tidemark.operators import quality as Q
from tidemark.operators import returns as R
from tidemark.operators import selection as S
from tidemark.operators import stats as M
from tidemark.operators import upserts as U
from tidemark.sources import parsers as P
from tidemark.streaming import daily

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(k) for k in range(n)]


def one(spark, x):
    return spark.range(1).select(x.alias("v")).first()["v"]


def test_prices_that_are_not_positive_have_no_log(spark):
    p = spark.createDataFrame([(d, "A", v) for d, v in zip(days(5), [1.0, 0.0, -2.0, None, 3.0], strict=True)], "ts date, ticker string, close double")
    assert [r.ret_1d for r in R.log_returns(p, (1,)).orderBy("ts").collect()] == [None] * 5
    assert R.downside_vol(p, 2).where("dvol_2d is not null").count() == 0


def test_windows_need_full_frames_and_rising_prices_have_no_downside(spark):
    p = spark.createDataFrame([(d, "A", 100.0 + k) for k, d in enumerate(days(30))], "ts date, ticker string, close double")
    v = [r.dvol_5d for r in R.downside_vol(p, 5).orderBy("ts").collect()]
    assert v[:5] == [None] * 5 and v[5:] == [0.0] * 25
    assert R.forward_vol(p, 2, 5).orderBy(F.desc("ts")).limit(6).where("target is not null").count() == 0
    with pytest.raises(ValueError):
        R.shift_target(p, "close", 0, "x")


def test_target_depends_on_the_future_alone(spark):
    rows = [(d, "A", 100.0 + (k * 7) % 5) for k, d in enumerate(days(40))]
    moved = [(d, t, v + (50 if k <= 10 else 0)) for k, (d, t, v) in enumerate(rows)]
    schema = "ts date, ticker string, close double"
    a, b = ([r.target for r in R.forward_vol(spark.createDataFrame(x, schema), 2, 5).orderBy("ts").collect()] for x in (rows, moved))
    assert a[10:33] == b[10:33] and a[5] != b[5]


def test_align_drops_what_as_of_keeps(spark):
    cal = spark.createDataFrame([(days(9)[k],) for k in (0, 1, 4)], "ts date")
    m = spark.createDataFrame([(days(9)[0], "x", 1.0), (days(9)[2], "x", 2.0)], "ts date, series_id string, value double")
    assert [r.value for r in A.align_ffill(cal, m).orderBy("ts").collect()] == [1.0, 1.0, 1.0]
    assert [r.value for r in A.as_of(cal, m).orderBy("ts").collect()] == [1.0, 1.0, 2.0]


def test_events_roll_forward_and_drop_past_the_end(spark):
    cal = spark.createDataFrame([(days(9)[k],) for k in (0, 3, 5)], "ts date")
    ev = spark.createDataFrame([(days(9)[k],) for k in (0, 1, 3, 8)] + [(None,)], "day date")
    assert [(r.event_day.day, r.trading_day.day) for r in A.roll_forward(ev, cal).orderBy("event_day").collect()] == [(1, 1), (2, 4), (4, 4)]


def test_thresholds_are_strict_fitted_inside_and_centred_at_zero(spark):
    df = spark.createDataFrame([("k", v, k) for k, v in enumerate((9.0, 10.0, 11.0, None))], "series_id string, move double, n int")
    assert [r.treated for r in A.treatment(df, "move", "sigma_high", 2.0).orderBy("n").collect()] == [1, 1, 1, 0]
    assert [r.treated for r in A.treatment(df, "move", "tercile_high", 0, in_window=F.col("n") < 2).orderBy("n").collect()] == [0, 1, 1, 0]
    even = spark.createDataFrame([("k", 5.0)] * 4, "series_id string, move double")
    assert A.treatment(even, "move", "tercile_high", 0).where("treated = 1").count() == 0
    assert A.treatment(even, "move", "tercile_low", 0).where("treated = 1").count() == 0
    with pytest.raises(Exception, match="no value in the window"):
        A.treatment(df, "move", "pct_high", 90, in_window=F.lit(False)).collect()
    with pytest.raises(ValueError):
        A.confounders(spark.createDataFrame([], "ts date, ticker string, close double"), exclude=("dxy",))


def test_releases_wait_for_holidays(spark):
    closed = spark.createDataFrame([(x,) for x in X.federal_holidays(2023, 2024)], "day date")
    weeks = {"2024-02-06": "2024-02-09", "2023-11-21": "2023-11-27", "2024-07-02": "2024-07-08", "2023-11-07": "2023-11-13", "2024-12-24": "2024-12-30"}
    got = A.release_days(spark.createDataFrame([(dt.date.fromisoformat(x),) for x in weeks], "week date"), "week", closed)
    assert {str(r.week): str(r.release_day) for r in got.collect()} == weeks


def test_spread_floor_by_hand(spark):
    p = spark.createDataFrame([(d, "G", v) for d, v in zip(days(4), [100.0, 90.0, 99.0, 110.0], strict=True)], "ts date, ticker string, close double")
    rules = spark.createDataFrame([("G", 0.02, 10.0, "float=assumed", True)], "ticker string, haircut double, days double, float_flag string, implied boolean")
    rates = spark.createDataFrame([(days(4)[3], 0.05)], "ts date, rate double")
    vols = spark.createDataFrame([(days(4)[3], 0.01)], "ts date, vol double")
    a, b = R.spread_floor(p, rates, vols, rules, n=2, k=2.0).orderBy("ts").collect()
    down = (math.log(0.9) ** 2 / 2) ** 0.5
    assert a.tail_vol == pytest.approx(down) and a.carry == 0 and a.exit_floor == pytest.approx(99 * 0.98)
    assert a.max_buy == pytest.approx(99 * 0.98 - 2 * down * 10**0.5 * 99) and a.flags.startswith("vol=realized_downside|tail=normal_approx|float=assumed")
    assert (b.tail_vol, b.carry) == (pytest.approx(0.01), pytest.approx(110 * 0.05 * 14 / 365)) and b.flags.startswith("vol=implied")


def test_lift_is_of_mean_errors_and_wins_round_up(spark):
    rows = [("new", 0, 0.5), ("old", 0, 1.0), ("new", 1, 100.1), ("old", 1, 100.0)]
    m = spark.createDataFrame([(r, "T", k, v) for r, k, v in rows], "run_id string, ticker string, split_id int, rmse double")
    got = M.lift_decision(m, "new", "old").first()
    assert got.relative == pytest.approx(100.6 / 101 - 1) and (got.n_wins, got.n_needed, got.keep) == (1, 2, False)


def test_changes_need_a_close_before(spark):
    closes = spark.createDataFrame([(d, 1.0 + k) for k, d in enumerate(days(3))], "ts date, value double")
    ev = spark.createDataFrame([(d, False) for d in (days(3)[0], days(3)[2], dt.date(2025, 1, 1))], "day date, is_unscheduled boolean")
    assert [(r.day, r.change_bp) for r in A.event_changes(ev, closes).collect()] == [(days(3)[2], 100.0)]
    assert [r.day for r in A.event_changes(ev, closes, inclusive=False).collect()] == [dt.date(2025, 1, 1)]


def test_upserts(spark):
    schema = "k int, v double, is_realtime boolean"
    old = spark.createDataFrame([(1, 1.0, True), (2, 2.0, False), (3, None, None)], schema)
    new = spark.createDataFrame([(1, 9.0, False), (2, None, True), (4, 4.0, None)], schema)
    got = U.upsert(old, new, ["k"], {"v": "coalesce", "is_realtime": "or"}, pin="is_realtime", pinned=("v",))
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, True), (2, 2.0, True), (3, None, None), (4, 4.0, None)]
    assert sorted(map(tuple, U.upsert(got, new, ["k"]).collect()), key=str) == sorted(map(tuple, U.upsert(U.upsert(got, new, ["k"]), new, ["k"]).collect()), key=str)
    with pytest.raises(Exception, match="repeat"):
        U.unique(old.unionByName(old), ["k"]).collect()
    assert U.unique(old, ["k"]).count() == 3
    assert sorted(map(str, (r.v for r in U.write_labels(old, new, "k", "v").collect()))) == ["9.0", "None", "None"]


def test_replace_table_and_harness(spark, tmp_path):
    h = H.Harness(spark, f"file://{tmp_path}/h")
    h.register("r1", "first", "2024-01-01", {"a": 1})
    with pytest.raises(ValueError):
        h.register("r1", "again", "2024-01-02", {})
    h.register("r2", "second", "2024-01-02", {})
    preds = spark.createDataFrame([("r1", DAY, "A", 1, 0.5, 0.4)], H.SCHEMAS["run_predictions"])
    h.log("run_predictions", preds)
    h.log("run_predictions", preds.withColumn("prediction", F.lit(0.7)))
    assert [r.prediction for r in h.predictions("r1").collect()] == [0.7]
    assert [r.run_id for r in h.recent(1).collect()] == ["r2"]
    assert h.export(f"file://{tmp_path}/x") == {"runs": 2, "run_predictions": 1, "run_feature_importances": 0}
    assert set(h.restore(f"file://{tmp_path}/x").values()) == {0}
    assert H.compact(spark, f"file://{tmp_path}/h/runs", 1) == 2
    with pytest.raises(ValueError):
        H.compact(spark, f"file://{tmp_path}/h/runs", 1, "run_id string")


def test_gaps_runs_and_staleness(spark):
    d = spark.createDataFrame([("a", days(20)[k]) for k in (0, 1, 4, 9, 11)], "key string, day date")
    assert [(r.day.day, r.gap) for r in Q.business_gaps(d, "key", "day", 2).orderBy("day").collect()] == [(5, 3), (10, 3)]
    assert sorted((r.first_day.day, r.n_days) for r in Q.islands(d, "day").collect()) == [(1, 2), (5, 1), (10, 1), (12, 1)]
    runs = spark.createDataFrame([("a", k, v) for k, v in enumerate([1, 1, 1, None, None, 2, 2])], "key string, ts int, v int")
    assert tuple(Q.equal_runs(runs, "key", "v").first()) == ("a", 3, 2)
    state = spark.createDataFrame([("x", days(9)[0]), ("y", days(9)[8])], "c string, last_success date")
    data = spark.createDataFrame([("y", days(9)[0])], "c string, last_data date")
    assert {r.c: r.stale for r in Q.stale(data, state, "c", "2024-01-12", 5).collect()} == {"x": True, "y": False}


def test_ledger_is_taken_whole_or_not_at_all(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "line int, w double")
    bad = Q.violations(df, "line", [("weight", F.col("w") > 0)])
    assert [tuple(r) for r in bad.collect()] == [(2, "weight")]
    assert Q.accept_all_or_none(df, bad).count() == 0 and Q.accept_all_or_none(df, bad.limit(0)).count() == 2


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (3, 5), (1000, 13), (1, 1)])
def test_systematic_picks(spark, n, k):
    df = spark.range(n).select("id", F.lit("g").alias("g"))
    assert sorted(r.id for r in S.systematic(df, "g", ["id"], k).collect()) == (list(range(n)) if n <= k else [i * n // k for i in range(k)])


def test_allocation_is_whole_and_within_sizes(spark):
    df = spark.createDataFrame([("g", "a", 5), ("g", "b", 5), ("g", "c", 1), ("h", "a", 2)], "g string, s string, n long")
    got = {(r.g, r.s): r.quota for r in S.allocate(df, "g", "s", "n", 6).collect()}
    assert got == {("g", "a"): 3, ("g", "b"): 3, ("g", "c"): 0, ("h", "a"): 2}


def test_text_functions(spark):
    s = F.lit
    feed = lambda t: s(f"<X>a</X><PAGE_TITLE>{t}</PAGE_TITLE><PAGE_TITLE>no</PAGE_TITLE>")
    assert one(spark, X.page_title(feed("Gold &#x27;rises&#39;\n &amp; falls&eacute;"))) == "Gold 'rises' & fallsé"
    assert one(spark, X.page_title(feed(" "))) is None and one(spark, X.page_title(s("<title>x</title>"))) is None
    assert one(spark, X.page_title(s("<TITLE> A &amp;\n B </TITLE>"), tag="title")) == "A & B" and len(one(spark, X.page_title(feed("x" * 900)))) == 512
    assert [one(spark, X.source_language(s(x))) for x in ("srclc:fra;eng:Moses", "srclc:zh;x", "SRCLC:DE", "", "junk")] == ["fra", "zh", "de", "eng", None]
    slugs = {
        "https://x.com/2024/gold-price-rises.html?x=1": "gold-price-rises", "no url": "", "https://x.com/1-2-3-4-5-6/gold-price-rises": "gold-price-rises", "https://x.com/123456": "",
        "https://x.com/news/265569381/the-real-slug": "the-real-slug", "https://x.com/a/giá-vàng-hôm.cms": "giá-vàng-hôm", "https://x.com": "",
    }
    assert {u: one(spark, X.url_slug(s(u))) for u in slugs} == slugs
    assert one(spark, X.slug_words(s("goldPrice-a-12345678x-rises-2024.html"))) == "gold price rises" and one(spark, X.slug_words(s("giá-vàng-hôm-nay"))) == "giá vàng hôm nay"
    assert one(spark, X.tolerant_themes(s("A, B"))) == ["A", "B"] and one(spark, X.tolerant_themes(s(' ["A"]'))) == ["A"] and one(spark, X.tolerant_themes(s(None).cast("string"))) == []
    assert one(spark, X.tolerant_themes(s("[a, b"))) == ["[a", "b"]
    months = {"JUN 26": "2026-06", "JLY 26": "2026-07", " feb 2026 ": "2026-02"}
    assert {m: one(spark, X.contract_month(s(m))) for m in months} == months and one(spark, X.contract_month(s(None).cast("string"))) is None
    for bad in ("TOTAL", "JUN 026", "JUN26"):
        with pytest.raises(Exception, match="no contract month"):
            one(spark, X.contract_month(s(bad)))
    assert one(spark, X.plain_number(s("1,234.5"))) == 1234.5 and one(spark, X.plain_number(s("-"))) is None
    masks = {
        "Gold on 2024-01-05, Jan 5, 2024, 28/10/2019 and 2023; $2024 stays": "Gold on [DATE], [DATE], [DATE] and [YEAR]; $2024 stays", "2019/03/05": "[DATE]", "2020年3月5日 金 10月28日": "[DATE] 金 [DATE]",
        "Gold Rate - March 30, 2020": "Gold Rate - [DATE]", "30th March 2020 at 1,950": "[DATE] at 1,950", "falls to 1950": "falls to [YEAR]", "2024 ounces": "[YEAR] ounces", "1950.5": "1950.5",
    }
    assert {t: one(spark, X.mask_dates(s(t))) for t in masks} == masks
    keys = {"Gold Prices RISE! - Reuters": "gold prices rise", "Gold Prices RISE! - Daily News": "gold prices rise daily news", "caf&eacute; &#36;2,000!": "café 2000", "ｇｏｌｄ  ①": "gold 1", "Gold | Yahoo  Finance": "gold"}
    assert {t: one(spark, X.title_key(s(t))) for t in keys} == keys
    gate = lambda t, lang, theme=False: tuple(one(spark, c) for c in X.admitted(s(t), s(lang), "gold", "medal", s(theme), {"fra": ("(?:l'or|once)", "médaille")}))
    assert gate("gold price", "fra") == (True, False) and gate("le prix de l'or", "fra") == (True, True) and gate("médaille d'once", "fra") == (False, False)
    assert gate("gold medal", "eng") == (False, False) and gate("gold medal", "eng", True) == (True, False) and gate("l'or", "eng") == (False, False)
    assert one(spark, X.clamped(s(" Up "), ["up", "down"], "none")) == "up" and one(spark, X.clamped(s("sideways"), ["up"], "none")) == "none"
    assert one(spark, X.llm_object(s('Sure:\n```json\n{"label": "x"}\n```'), "label string")["label"]) == "x"
    assert one(spark, X.json_flag(s('{"a": false}'), "$.a", True)) is False and one(spark, X.json_flag(s("{}"), "$.a", True)) is True
    numbers = {("215K", "%"): (None, True), ("0.2%", "%"): (0.2, False), ("185K", "count"): (185.0, False), ("1.2M", "count"): (1200.0, False), ("12", "count"): (None, True), ("", "%"): (None, False), ("-0.1%", "%"): (-0.1, False)}
    for (text, unit), want in numbers.items():
        assert tuple(one(spark, c) for c in X.suffixed_number(s(text), s(unit))) == want
    assert X.easter(2024) == dt.date(2024, 3, 31) and dt.date(2024, 6, 19) in X.exchange_holidays(2024, 2024) and len(X.exchange_holidays(2024, 2024)) == 10


def test_metrics_of_constants_are_null(spark):
    p = spark.createDataFrame([("r", 0.01, v) for v in (0.1, -0.2, 0.3)], "run_id string, prediction double, actual double")
    assert M.run_metrics(p, ["run_id"]).first().ic is None
    assert M.spearman(p.limit(2), "prediction", "actual", ["run_id"]).first().ic is None
    assert M.ols(p.withColumn("ts", F.lit(1)), "actual", ["prediction"])[0]["estimate"] is None


def test_var_order_and_effects(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    y = np.zeros((400, 2))
    for t in range(2, 400):
        y[t] = 0.5 * y[t - 1] - 0.4 * y[t - 2] + rng.normal(size=2)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(y)], "ts int, a double, b double")
    assert M.var_order(df, ["a", "b"], 3) == 2
    x = rng.normal(size=600)
    t = (rng.random(600) < 1 / (1 + np.exp(-x))).astype(int)
    z = 2 * t + x + rng.normal(size=600)
    rows = spark.createDataFrame([(str(k), float(a), int(b), float(c)) for k, (a, b, c) in enumerate(zip(x, t, z, strict=True))], "key string, x double, t int, y double")
    got = E.doubly_robust_ate(rows, "y", "t", ["x"], "key").first()
    assert abs(got.effect - 2) < 4 * got.std_error < 1
    assert E.doubly_robust_ate(rows.limit(50), "y", "t", ["x"], "key").first().effect is None


def test_embedding_cache_embeds_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "i int, t string")
    rows, fresh = E.embed_with_cache(df, "t", None)
    assert rows.count() == 4 and fresh.count() == 2
    assert E.embed_with_cache(df, "t", fresh)[1].count() == 0


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_csv_readers(spark, tmp_path):
    cols = ["release_date", "time", "kind"]
    f = write(tmp_path / "cal.csv", "release_date,time,kind\n2024-01-05,08:30,cpi\n2024-01-05,08:30,cpi\n2024-13-01,08:30,ppi\n2024-02-05,8:3,ppi\n2030-01-01,08:30,cpi\n")
    events, bad = P.event_calendar(spark, f, "release_date", "time", cols, "bls", "2029-01-01")
    assert [(str(r.day), r.metadata) for r in events.collect()] == [("2024-01-05", '{"kind":"cpi"}')]
    assert sorted(r.rule for r in bad.collect()) == ["bad date", "bad time", "repeated row"]
    with pytest.raises(P.Drift):
        P.raw_csv(spark, f, ["other"])
    t = write(tmp_path / "trend.csv", "﻿Category: All\n\nWeek,sell gold: (US),cash: (US)\n2024-01-07,10,<1\n2024-01-14,99,3\n")
    got = P.trends(spark, t)
    assert sorted((str(r.period_start), r.term, r.value, r.below_one) for r in got.collect())[0] == ("2024-01-07", "cash", 0.0, True)
    assert sorted((r.term, r.rule) for r in P.reconcile_trends(got, ["sell gold", "buy"], "US").collect()) == [("buy", "missing"), ("cash", "unexpected")]
    with pytest.raises(P.Drift):
        P.trends(spark, write(tmp_path / "bad.csv", "Week,a: (US)\n2024-01-07,1,2\n"))
    m = write(tmp_path / "pgm.csv", 'Prices\nDate,Platinum,Palladium\n05/01/2024,"900",\n06/01/2024,901,1000\n'.replace('"', ""))
    assert sorted((str(r.price_date), r.metal, r.price) for r in P.metal_prices(spark, m, "open").collect()) == [("2024-01-05", "platinum", 900.0), ("2024-01-06", "palladium", 1000.0), ("2024-01-06", "platinum", 901.0)]
    with pytest.raises(P.Drift):
        P.metal_prices(spark, write(tmp_path / "bad2.csv", "x\nDate,Platinum\nno,1\n"), "open")


def test_json_and_html_readers(spark):
    pay = lambda x: spark.createDataFrame([(x,)], "payload string")
    settled = '{"tradeDate": "02/25/2026", "reportType": "%s", "empty": false, "settlements": [{"month": "MAR 26", "settle": "31.5A"}, {"month": "Total", "settle": "-"}]}'
    final, early = (P.settlements(pay(settled % kind)) for kind in ("Final", "Preliminary"))
    assert [tuple(r) for r in early.collect()] == [(dt.date(2026, 2, 25), "2026-03", 31.5, True)]
    with pytest.raises(Exception, match="report type"):
        P.settlements(pay(settled % "draft")).collect()
    v = P.volumes(pay('{"tradeDate": "20260225", "empty": false, "totals": {"totalVolume": "1,300", "atClose": "7", "change": "1"}, "monthData": [{"month": "MAR 26", "totalVolume": "1,200", "atClose": "-", "change": "-5"}]}'))
    assert sorted(map(tuple, v.collect())) == [(dt.date(2026, 2, 25), "2026-03", 1200, None, -5), (dt.date(2026, 2, 25), "AGG", 1300, 7, 1)]
    month = v.where("month = '2026-03'")
    prices = [[P.attach_settlements(month.withColumn("is_preliminary", F.lit(p)), s).first().settle for s in (final, early)] for p in (False, True)]
    assert prices == [[31.5, None], [31.5, 31.5]]
    assert P.volumes(pay('{"tradeDate": "20260225", "empty": true, "monthData": []}')).count() == 0
    assert [tuple(r) for r in P.trade_dates(pay('[["02/25/2026", "Final"], ["02/26/2026", "Preliminary"]]')).collect()] == [(dt.date(2026, 2, 25), False), (dt.date(2026, 2, 26), True)]
    c = P.consensus(pay('[{"title": "CPI m/m", "country": "USD", "date": "2024-01-11T08:30:00-05:00", "forecast": "0.2%", "previous": "0.1%"}, {"title": "CPI m/m", "country": "EUR", "date": "2024-01-11T08:30:00-05:00"}]'), {"CPI m/m": ("cpi", "%")}, "2024-01-10 00:00:00", "payload")
    assert [(str(r.release_utc), r.forecast, r.is_realtime, r.violation) for r in c.collect()] == [("2024-01-11 13:30:00", 0.2, True, False)]
    html = [
        '<script type="application/ld+json">{"offers": {"price": "2,050.10"}}</script><b class="price">$2,050.10</b> Buyback at $1,990.00', '<span class="big price">$31.20</span>',
        '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"], "offers": {"@type": "AggregateOffer", "lowPrice": 5}}]}</script>', "none",
    ]
    page = lambda *x: spark.createDataFrame(list(enumerate(x)), "i int, html string")
    got = P.product_pages(page(*html)).orderBy("i").collect()
    assert [(r.price, r.buyback, r.source) for r in got] == [(2050.10, 1990.0, "json-ld"), (31.2, None, "element"), (5.0, None, "json-ld"), (None, None, None)]
    with pytest.raises(Exception, match="differ"):
        P.product_pages(page('<script type="application/ld+json">{"offers": [{"price": 5}]}</script><i class="price">$6.00</i>')).collect()
    with pytest.raises(Exception, match="without a price"):
        P.product_pages(page('<script type="application/ld+json">{"@type": "Product"}</script>')).collect()
    cot = spark.createDataFrame([(DAY, "GOLD - COMEX", "5", None), (DAY, "WHEAT", "1", "1")], "report_date date, market string, a string, b string")
    assert [tuple(r) for r in P.report_positions(cot, {"GOLD": "gold"}, {"longs": ["a", "b", "absent"]}).collect()] == [(DAY, "gold", 5)]


def test_stream_equals_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(d)
    events.repartitionByRange(6, "ts").write.parquet(f"file://{tmp_path}/in")
    daily.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", events.schema, "60 days")
    daily.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", events.schema, "60 days")
    late = spark.createDataFrame([(9_999_999, dt.datetime(2025, 1, 1), 1, "click", 0.0, "{}")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    late.select(*events.columns).write.mode("append").parquet(f"file://{tmp_path}/in")
    daily.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", events.schema, "60 days")
    want = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    got = spark.read.parquet(f"file://{tmp_path}/out").select("day", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
