"""Queries of joins, quality checks, cross-sections and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import dealt, rounded
from quantloom.operators import backtest as bt
from quantloom.operators import features as ft
from quantloom.operators import joins, quality
from quantloom.plans.catalog import query
from quantloom.sources.tables import bars, records, returns, sectors, table, ticks

_RET = ("bars", "returns")


@query(
    """, l AS (SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate AS date FROM orders)
    SELECT l.id, l.entity, l.date, round((SELECT last(r.value ORDER BY r.available_time, r.seq) FROM records r WHERE r.entity = l.entity AND r.available_time <= l.date AND r.available_time >= l.date - INTERVAL 200 DAY), 6) AS value FROM l""",
    ("records",),
)
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("date"))
    return rounded(joins.asof_join(left, records(spark, sf_dir), "entity", "date", "available_time", ["value"], tie=["seq"], max_age="200 DAYS"))


@query("SELECT t.seq, t.symbol, t.ts, round((SELECT last(u.price ORDER BY u.ts, u.seq) FROM ticks u WHERE u.symbol = t.symbol AND u.ts < t.ts), 6) AS price FROM ticks t", ("ticks",))
def asof_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return rounded(joins.asof_join(t.select("seq", "symbol", "ts"), t, "symbol", "ts", "ts", ["price"], tie=["seq"], exact=False))


@query("SELECT t.seq, t.symbol, t.ts, round((SELECT first(u.price ORDER BY u.ts, u.seq) FROM ticks u WHERE u.symbol = t.symbol AND u.ts >= t.ts + INTERVAL 1 HOUR), 6) AS later FROM ticks t", ("ticks",))
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    left = t.select("seq", "symbol", "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return rounded(joins.asof_join(left, t.withColumnRenamed("price", "later"), "symbol", "at", "ts", ["later"], tie=["seq"], direction="forward").drop("at"))


@query(
    """, g AS (SELECT entity, date, s_nationkey AS nation FROM bars JOIN supplier ON s_suppkey = entity), c AS (SELECT nation, count(DISTINCT entity) AS n FROM g GROUP BY nation), d AS (SELECT nation, date, count(DISTINCT entity) AS n FROM g GROUP BY nation, date)
    SELECT nation, date, d.n FROM d JOIN c USING (nation) WHERE d.n = c.n""",
    ("bars",),
)
def date_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that all suppliers of a nation have."""
    of = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))
    return joins.common_dates(bars(spark, sf_dir).join(of, "entity"), group="nation").groupBy("nation", "date").agg(F.count("*").alias("n"))


@query(", s AS (SELECT count(DISTINCT entity) AS streams FROM returns) SELECT date, any_value(streams) AS streams, count(ret) AS present, any_value(streams) - count(ret) AS missing FROM returns, s GROUP BY date", _RET)
def date_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.date_union(returns(spark, sf_dir))


@query(
    """, s AS (SELECT entity, min(date)::DATE AS a, max(date)::DATE AS b FROM bars GROUP BY entity), d AS (SELECT entity, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS date FROM s)
    SELECT entity, date FROM d WHERE isodow(date) < 6 AND NOT EXISTS (SELECT 1 FROM bars x WHERE x.entity = d.entity AND x.date::DATE = d.date::DATE)""",
    ("bars",),
)
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_sessions(bars(spark, sf_dir))


@query(
    """, v AS (SELECT entity, date, volume, CASE WHEN count(volume) OVER w >= 10 THEN median(volume) OVER w END AS usual FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT entity, date, round(volume, 6) AS volume, round(usual, 6) AS usual FROM v WHERE volume = 0 OR volume < 0.1 * usual""",
    ("bars",),
)
def volume_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.volume_anomalies(bars(spark, sf_dir)))


@query(
    """, c AS (SELECT *, coalesce((close <> lag(close) OVER (PARTITION BY entity ORDER BY date))::INTEGER, 1) AS changed FROM bars), r AS (SELECT *, sum(changed) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT entity, min(date) AS start, max(date) AS "end", count(*) AS bars FROM r GROUP BY entity, run HAVING count(*) >= 2""",
    ("bars",),
)
def stale_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stale_prices(bars(spark, sf_dir))


@query(
    """, r AS (SELECT entity, date, close / lag(close) OVER (PARTITION BY entity ORDER BY date) AS ratio FROM bars), s AS (SELECT unnest([2.0, 3.0, 4.0, 5.0, 10.0, 1/2, 1/3, 1/4, 1/5, 1/10]::DOUBLE[]) AS s)
    SELECT entity, date, round(ratio, 6) AS ratio, round((SELECT CASE WHEN min(abs(ratio / s - 1)) <= 0.02 THEN first(s ORDER BY abs(ratio / s - 1), s) END FROM s), 6) AS split FROM r WHERE abs(ratio - 1) > 0.5""",
    ("bars",),
)
def price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.price_jumps(bars(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_timestamps(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT entity, date, unnest(list_filter([CASE WHEN high < low THEN 'high<low' END, CASE WHEN high < close THEN 'high<close' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'price<=0' END], lambda x: x IS NOT NULL)) AS fault FROM bars", ("bars",))
def ohlc_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ohlc_faults(bars(spark, sf_dir))


@query(
    """, x AS (SELECT r.*, s.sector FROM returns r JOIN sectors s USING (entity) WHERE ret IS NOT NULL), y AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 AS rk, count(*) OVER (PARTITION BY date) AS n FROM x)
    SELECT entity, date, round((ret - avg(ret) OVER d) / nullif(stddev_samp(ret) OVER d, 0), 6) AS ret_z, round(CASE WHEN n > 1 THEN (rk - 1) / (n - 1) - 0.5 END, 6) AS ret_rank, round(ret - avg(ret) OVER (PARTITION BY date, sector), 6) AS ret_neutral FROM y WINDOW d AS (PARTITION BY date)""",
    (*_RET, "sectors"),
)
def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dealt(returns(spark, sf_dir).where("ret is not null"), "date").join(F.broadcast(sectors(spark, sf_dir)), "entity")
    out = ft.group_demean(ft.rank_by_date(ft.standardize_by_date(x, "ret"), "ret"), "ret", "sector")
    return rounded(out.select("entity", "date", "ret_z", "ret_rank", "ret_neutral"))


@query(
    """, k AS (SELECT * FROM returns WHERE ret IS NOT NULL), q AS (SELECT quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM k)
    SELECT entity, date, round(least(greatest(ret, lo), hi), 6) AS ret FROM k, q""",
    _RET,
)
def winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.winsorize(returns(spark, sf_dir).where("ret is not null"), "ret"))


_SMA = ", s AS (SELECT *, CASE WHEN (CASE WHEN count(close) OVER f = 10 THEN avg(close) OVER f END) > (CASE WHEN count(close) OVER g = 30 THEN avg(close) OVER g END) THEN 1.0 ELSE 0.0 END AS signal FROM bars WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 9 PRECEDING), g AS (PARTITION BY entity ORDER BY date ROWS 29 PRECEDING))"
_BOOK = """, x AS (SELECT *, coalesce(lag(signal) OVER w, 0.0) AS executed, close / lag(close) OVER w - 1 AS r FROM s WINDOW w AS (PARTITION BY entity ORDER BY date)),
    y AS (SELECT *, coalesce(executed * r, 0.0) AS gross, abs(executed - coalesce(lag(executed) OVER (PARTITION BY entity ORDER BY date), 0.0)) * 0.0015 AS cost FROM x), z AS (SELECT *, gross - cost AS net FROM y)"""


@query(f"{_SMA}{_BOOK} SELECT entity, date, signal::DOUBLE AS signal, executed::DOUBLE AS executed, round(gross, 6) AS gross, round(cost, 6) AS cost, round(net, 6) AS net FROM z", ("bars",))
def sma_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = bt.run_strategy(bt.sma_signal(bars(spark, sf_dir)))
    return rounded(book.select("entity", "date", "signal", "executed", "gross", "cost", "net"))


@query(
    f"""{_SMA}{_BOOK}, l AS (SELECT *, sum(CASE WHEN sign(executed) <> coalesce(b, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS lot FROM (SELECT *, lag(sign(executed)) OVER (PARTITION BY entity ORDER BY date) AS b FROM z))
    SELECT entity, lot::BIGINT AS lot, min(date) AS entry, max(date) AS exit, count(*) AS bars, max(sign(executed))::DOUBLE AS direction, round(product(greatest(1 + net, 0)) - 1, 4) AS return_pct FROM l WHERE executed <> 0 GROUP BY entity, lot""",
    ("bars",),
)
def sma_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.trade_log(bt.run_strategy(bt.sma_signal(bars(spark, sf_dir)))), 4)


_LOTS = f"""{_SMA}{_BOOK}, l AS (SELECT *, sum(CASE WHEN sign(executed) <> coalesce(b, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS lot FROM (SELECT *, lag(sign(executed)) OVER (PARTITION BY entity ORDER BY date) AS b FROM z)),
    t AS (SELECT entity, lot::BIGINT AS lot, min(date) AS entry, max(date) AS exit, product(greatest(1 + net, 0)) - 1 AS r FROM l WHERE executed <> 0 GROUP BY entity, lot)"""


@query(
    f"""{_LOTS}, k AS (SELECT *, sum(CASE WHEN r >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY entry ROWS UNBOUNDED PRECEDING) AS run FROM t), streaks AS (SELECT entity, max(c) AS losing_streak FROM (SELECT entity, count(*) AS c FROM k WHERE r < 0 GROUP BY entity, run) GROUP BY entity),
    a AS (SELECT entity, count(*) AS n, count(*) FILTER (r > 0) AS w, avg(r) FILTER (r > 0) AS winner, avg(r) FILTER (r < 0) AS loser, count(*) FILTER (r < 0) AS l FROM t GROUP BY entity)
    SELECT entity, n, round(w / n, 6) AS win_rate, round(winner, 6) AS winner, round(loser, 6) AS loser, round(coalesce(w / n * winner, 0) + coalesce(l / n * loser, 0), 6) AS expectancy, CASE WHEN w = 0 THEN NULL WHEN loser IS NULL THEN 'inf'::DOUBLE ELSE round(abs(winner / loser), 6) END AS payoff, coalesce(losing_streak, 0) AS losing_streak FROM a LEFT JOIN streaks USING (entity)""",
    ("bars",),
)
def trade_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.trade_expectancy(bt.trade_log(bt.run_strategy(bt.sma_signal(bars(spark, sf_dir))))))


@query(f"{_SMA}{_BOOK} SELECT entity, round(avg((executed <> 0)::INTEGER), 6) AS in_market, round(avg(abs(executed)), 6) AS mean_abs, round(avg(executed), 6) AS mean, round(avg((executed > 0)::INTEGER), 6) AS long, round(avg((executed < 0)::INTEGER), 6) AS short FROM z GROUP BY entity", ("bars",))
def exposure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.exposure(bt.run_strategy(bt.sma_signal(bars(spark, sf_dir)))))


@query(
    f""", c AS (SELECT *, coalesce(close >= CASE WHEN count(high) OVER a = 20 THEN max(high) OVER a END, false)::INTEGER + 2 * coalesce(close <= CASE WHEN count(low) OVER b = 10 THEN min(low) OVER b END, false)::INTEGER AS code FROM bars
      WINDOW a AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, list_reduce(list_concat([0], list(code) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)), lambda s, c: CASE WHEN s = 1 THEN CASE WHEN c >= 2 THEN 0 ELSE 1 END ELSE c % 2 END)::DOUBLE AS signal FROM c){_BOOK} SELECT entity, date, signal, round(net, 6) AS net FROM z""",
    ("bars",),
)
def donchian_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.run_strategy(bt.donchian_signal(bars(spark, sf_dir))).select("entity", "date", "signal", "net"))


@query(
    f""", c AS (SELECT *, close - lag(close) OVER (PARTITION BY entity ORDER BY date) AS change FROM bars), l AS (SELECT *, list(greatest(change, 0)) FILTER (change IS NOT NULL) OVER w AS g, list(greatest(-change, 0)) FILTER (change IS NOT NULL) OVER w AS o FROM c WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, CASE WHEN len(g) >= 14 THEN list_reduce(list_concat([list_avg(g[1:14])], g[15:]), lambda a, v: (a * 13 + v) / 14) END AS up, CASE WHEN len(o) >= 14 THEN list_reduce(list_concat([list_avg(o[1:14])], o[15:]), lambda a, v: (a * 13 + v) / 14) END AS down FROM l),
    r AS (SELECT *, CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM m),
    s AS (SELECT *, coalesce(last_value(CASE WHEN rsi > 70 THEN 0.0 WHEN rsi < 30 THEN 1.0 END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0)::DOUBLE AS signal FROM r){_BOOK} SELECT entity, date, signal, round(net, 6) AS net FROM z""",
    ("bars",),
)
def rsi_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.run_strategy(bt.recursive_signal(bars(spark, sf_dir), "rsi")).select("entity", "date", "signal", "net"))


@query(f"{_LOTS} SELECT t.entity, t.lot, round(max(b.close) / first(b.close ORDER BY b.date) - 1, 6) AS mfe, round(min(b.close) / first(b.close ORDER BY b.date) - 1, 6) AS mae FROM t JOIN bars b ON b.entity = t.entity AND b.date BETWEEN t.entry AND t.exit GROUP BY t.entity, t.lot", ("bars",))
def trade_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(bt.excursions(bt.trade_log(bt.run_strategy(bt.sma_signal(b))), b))


@query(
    """, k AS (SELECT entity, date, ret FROM returns WHERE ret IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 AS rk FROM k), d AS (SELECT *, rk - avg(rk) OVER (PARTITION BY date) AS d FROM r),
    w AS (SELECT entity, date, ret, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY date), 0), 0) AS weight FROM d), h AS (SELECT *, lead(date) OVER (PARTITION BY entity ORDER BY date) AS nx, coalesce(lag(weight) OVER (PARTITION BY entity ORDER BY date), 0) AS b FROM w),
    p AS (SELECT h.date, sum(h.weight * k.ret) AS ret FROM h JOIN k ON k.entity = h.entity AND k.date = h.nx GROUP BY h.date)
    SELECT h.date, round(coalesce(any_value(p.ret), 0), 5) AS ret, round(sum(abs(weight - b)), 5) AS turnover, round(sum(abs(weight)), 5) AS gross FROM h LEFT JOIN p USING (date) GROUP BY h.date""",
    _RET,
)
def rank_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir).where("ret is not null")
    return rounded(bt.portfolio_returns(bt.rank_weights(r.withColumnRenamed("ret", "score")).select("entity", "date", "weight"), r), 5)


@query(
    """, k AS (SELECT entity, date, ret FROM returns WHERE ret IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC, entity) AS t, row_number() OVER (PARTITION BY date ORDER BY ret, entity) AS l FROM k), s AS (SELECT *, CASE WHEN t <= 5 THEN 1 WHEN l <= 5 THEN -1 ELSE 0 END AS side FROM r)
    SELECT entity, date, round(CASE WHEN side = 0 THEN 0.0 ELSE side * CASE WHEN max(side) OVER d = 1 AND min(side) OVER d = -1 THEN 0.5 ELSE 1.0 END / count(*) OVER (PARTITION BY date, side) END, 6) AS weight FROM s WINDOW d AS (PARTITION BY date)""",
    _RET,
)
def top_bottom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir).where("ret is not null").withColumnRenamed("ret", "score")
    return rounded(bt.top_bottom_weights(r, 5).select("entity", "date", "weight"))
