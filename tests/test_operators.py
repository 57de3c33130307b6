"""Rules that the tables do not show: gaps, ties, flat windows, boundaries."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import special
from quantloom.operators import backtest, derivatives, features, indicators, joins, learning, microstructure, portfolio, quality
from quantloom.streaming import spread_monitor

DAY = dt.datetime(2024, 1, 1)


def _bars(spark, closes, entity=1):
    return spark.createDataFrame([(entity, DAY + dt.timedelta(days=i), c, c, c, c, 10.0) for i, c in enumerate(closes)], "entity int, date timestamp, open double, high double, low double, close double, volume double")


def _column(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_full_window_rule_with_a_gap(spark):
    out = _bars(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]).withColumn("sma", indicators.sma("close", 3))
    assert _column(out, "sma") == [None, None, None, None, None, 5.0]


def test_flat_bollinger_gives_the_price(spark):
    low, middle, high = indicators.bollinger("close", 3)
    out = _bars(spark, [5.0] * 4).select("date", low.alias("a"), middle.alias("b"), high.alias("c"))
    assert [tuple(r)[1:] for r in out.orderBy("date").collect()][-1] == (5.0, 5.0, 5.0)


def test_rsi_skips_missing_and_saturates():
    assert indicators.rsi_values(np.array([1.0, 2, 3, 4]), 2)[-1] == 100.0
    x = indicators.rsi_values(np.array([1.0, 2, np.nan, 1.5, 3]), 2)
    y = indicators.rsi_values(np.array([1.0, 2, 1.5, 3]), 2)
    assert np.isnan(x[2]) and x[-1] == y[-1]


def test_zero_range(spark):
    out = indicators.stochastic(_bars(spark, [5.0] * 3), 2, 1).withColumn("w", indicators.williams_r(2))
    assert _column(out, "stoch_k")[-1] == 0.0 and _column(out, "w")[-1] is None


def test_infinite_values_are_refused(spark):
    with pytest.raises(Exception, match="close holds an infinite value"):
        indicators.refuse_infinities(_bars(spark, [1.0, float("inf")]), "close").collect()


def test_state_machine_toggles_where_both_hold(spark):
    df = _bars(spark, [1.0] * 4).withColumns({"i": F.lit(True), "o": F.lit(True)})
    assert _column(backtest.state_machine(df, "i", "o"), "signal") == [1.0, 0.0, 1.0, 0.0]


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(days=5)), (None, DAY), (2, None), (1, DAY)], "k int, t timestamp")
    right = spark.createDataFrame([(1, DAY, 1.0, 1), (1, DAY, 2.0, 2), (None, DAY, 9.0, 3)], "k int, u timestamp, v double, s int")
    got = lambda **a: sorted((r.v for r in joins.asof_join(left, right, "k", "t", "u", ["v"], tie=["s"], **a).collect()), key=str)
    assert got() == [2.0, 2.0, 2.0, None, None]
    assert got(max_age="2 DAYS") == [2.0, 2.0, None, None, None]
    assert got(exact=False) == [2.0, None, None, None, None]
    assert got(direction="forward") == [1.0, 1.0, None, None, None]
    assert joins.asof_join(left.where("false"), right, "k", "t", "u", ["v"]).count() == 0


def test_interval_join_equals_between(spark):
    points = spark.createDataFrame([(1, DAY + dt.timedelta(days=i)) for i in range(100)], "k int, at timestamp")
    spans = spark.createDataFrame([(1, DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=b), a) for a, b in ((3, 3), (10, 70), (50, 40), (95, 200))], "k int, a timestamp, b timestamp, n int")
    out = joins.interval_join(points, spans, "k", "at", "a", "b")
    assert {r.n: r["count"] for r in out.groupBy("n").count().collect()} == {3: 1, 10: 61, 95: 5}


def test_calendar_policies(spark):
    calendar = _bars(spark, [1.0] * 4).select("entity", "date")
    signal = _bars(spark, [1.0, 7.0]).select("entity", "date", F.col("close").alias("s"))
    assert _column(joins.onto_calendar(signal, calendar, "s"), "s") == [1.0, 7.0, 7.0, 7.0]
    assert _column(joins.onto_calendar(signal, calendar, "s", "flat"), "s") == [1.0, 7.0, 0.0, 0.0]
    with pytest.raises(Exception, match="missing"):
        joins.onto_calendar(signal, calendar, "s", "error").collect()


def test_single_name_dates_are_null(spark):
    out = features.rank_by_date(features.standardize_by_date(_bars(spark, [1.0, 2.0]), "close"), "close")
    assert all(r.close_z is None and r.close_rank is None for r in out.collect())


def test_bounded_forward_fill(spark):
    assert _column(features.forward_fill(_bars(spark, [1.0, None, None, None]), "close", 2), "close") == [1.0, 1.0, 1.0, None]


def test_p_adjustments(spark):
    t = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = lambda m: [round(r.p_adjusted, 6) for r in learning.adjust_p(t, m).orderBy("p").collect()]
    assert got("bh") == [0.03, 0.04, 0.04] and got("holm") == [0.03, 0.06, 0.06] and got("bonferroni") == [0.03, 0.09, 0.12]


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -3.0, -0.5, 0.0, 0.7, 6.0, 9.0]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-14 for r in out)


def test_options_agree_with_the_tree_and_parity(spark):
    chain = spark.createDataFrame([(100.0, 95.0, 1.0, 0.03, 0.2, c) for c in (True, False)], "spot double, strike double, years double, rate double, vol double, is_call boolean")
    price = {r.is_call: r.price for r in derivatives.price_options(chain).collect()}
    assert price[True] - price[False] == pytest.approx(100 - 95 * math.exp(-0.03))
    for call in (True, False):
        assert derivatives.binomial_price(100, 95, 1, 0.03, 0.2, call, 800) == pytest.approx(price[call], abs=0.02)
    assert derivatives.binomial_price(100, 95, 1, 0.03, 0.2, False, american=True) >= price[False]


def test_small_dense_algebra():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    cov = portfolio.covariance(x)
    w = portfolio.risk_parity(cov)
    parts = portfolio.risk_contributions(w, cov)
    assert np.allclose(parts, parts[0], rtol=1e-6) and w.sum() == pytest.approx(1)
    v = portfolio.min_variance(cov)
    assert v @ cov @ v <= w @ cov @ w + 1e-12
    assert portfolio.hierarchical_risk_parity(cov).sum() == pytest.approx(1)
    assert np.all(np.linalg.eigvalsh(portfolio.ledoit_wolf(x)) > 0)


def test_queue_positions(spark):
    e = [(1, 1, 10, "A", "B", 5.0, 3.0), (1, 2, 11, "A", "B", 5.0, 4.0), (1, 3, 10, "C", "B", 5.0, 3.0), (1, 4, 99, "C", "B", 5.0, 9.0), (1, 5, 12, "A", "B", 5.0, 1.0)]
    out = microstructure.queue_positions(spark.createDataFrame(e, "symbol int, seq int, order_id int, action string, side string, price double, size double"))
    assert {r.order_id: r.position for r in out.collect()} == {10: 0.0, 11: 3.0, 12: 4.0}


def test_monitor_in_batches_equals_one_run(spark, tmp_path):
    values = [float(i % 5) for i in range(40)] + [30.0] * 10
    rows = [("a", DAY + dt.timedelta(minutes=i), v) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "label string, ts timestamp, value double")
    once = sorted((r.ts, r.up, r.alert) for r in spread_monitor.monitor(table).collect())
    for k in range(5):
        table.where(f"minute(ts) >= {k * 10} and minute(ts) < {k * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = spread_monitor.monitor(stream).writeStream.format("memory").queryName("monitored").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.ts, r.up, r.alert) for r in spark.table("monitored").collect()) == once
    assert [a for _, _, a in once if a] == ["up"]


def test_recursions_skip_missing_bars(spark):
    rng = np.random.default_rng(4)
    close = 100 + np.cumsum(rng.normal(size=61))
    high, low = close + rng.random(61), close - rng.random(61)
    holed = [x.copy() for x in (high, low, close)]
    for x in holed:
        x[30] = np.nan
    whole = [np.delete(x, 30) for x in holed]
    for values in (lambda h, lo, c: indicators.adx_values(h, lo, c, 14), lambda h, lo, c: indicators.psar_values(h, lo)):
        for got, want in zip(indicators.gapless(values, *holed), values(*whole), strict=True):
            assert np.isnan(got[30])
            np.testing.assert_array_equal(np.delete(got, 30), want)


def test_signals_hold_on_missing_bars(spark):
    close = [100.0 + i for i in range(40)] + [None] + [140.0 + i for i in range(5)]
    bars = _bars(spark, close).withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1})
    assert _column(backtest.recursive_signal(bars, "macd"), "signal")[39:42] == [1.0, 1.0, 1.0]
    assert _column(backtest.recursive_signal(bars, "adx"), "signal")[39:42] == [1.0, 1.0, 1.0]


def test_queue_positions_of_modified_and_cleared_orders(spark):
    rows = [(1, "a", "A", 5.0), (2, "b", "A", 3.0), (3, "a", "M", 2.0), (4, "c", "A", 1.0), (5, "b", "C", 9.0), (6, "d", "A", 1.0), (7, "x", "R", 0.0), (8, "e", "A", 4.0), (9, "a", "F", 2.0), (10, "f", "A", 1.0)]
    events = spark.createDataFrame([("s", i, o, a, "B", 10.0, z) for i, o, a, z in rows], "symbol string, seq int, order_id string, action string, side string, price double, size double")
    got = {r.order_id: r.position for r in microstructure.queue_positions(events).collect()}
    assert got == {"a": 0.0, "b": 5.0, "c": 5.0, "d": 3.0, "e": 0.0, "f": 4.0}


def test_rehedge_by_drift(spark):
    df = _bars(spark, [1.0, 1.05, 1.2, 1.15, 1.0]).withColumnRenamed("close", "ratio")
    assert _column(backtest.rehedge_dates(df, "drift"), "rehedge") == [1.0, 0.0, 1.0, 0.0, 1.0]


def test_placeholders_and_missing_bars(spark):
    out = quality.usable_bars(_bars(spark, [1.0, None, 3.0, None, None]), ("close",)).collect()
    assert [(r.close, r.dropped_missing, r.dropped_placeholder) for r in out] == [(1.0, 1, 2), (3.0, 1, 2)]


def test_two_leg_fill(spark):
    bars = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), o, c, s) for i, (o, c, s) in enumerate([(10.0, 10.0, 1.0), (11.0, 12.0, 1.0), (12.0, 9.0, 0.0), (10.0, 11.0, 0.0)])], "entity int, date timestamp, open double, close double, signal double")
    book = backtest.run_strategy(bars, fill="next_open", commission=0.0, slippage=0.0)
    assert [round(x, 9) for x in _column(book, "gross")] == [0.0, round(12 / 11 - 1, 9), round(9 / 12 - 1, 9), round(10 / 9 - 1, 9)]
