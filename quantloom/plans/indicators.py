"""Queries of the technical indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import by, full, rounded
from quantloom.operators import indicators as ind
from quantloom.plans.catalog import query
from quantloom.sources.tables import bars

_OVER = "OVER (PARTITION BY entity ORDER BY date ROWS {} PRECEDING)"


def _rows(agg: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


@query("SELECT entity, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars", ("bars",))
def bars_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars(spark, sf_dir))


@query(
    f"""SELECT entity, date, round({_rows("avg", "close", 20)}, 6) AS sma, round(CASE WHEN {_rows("max", "close", 20)} = {_rows("min", "close", 20)} THEN close ELSE {_rows("avg", "close", 20)} - 2 * ({_rows("stddev_samp", "close", 20)}) END, 6) AS lower,
    round(CASE WHEN {_rows("max", "close", 20)} = {_rows("min", "close", 20)} THEN close ELSE {_rows("avg", "close", 20)} + 2 * ({_rows("stddev_samp", "close", 20)}) END, 6) AS upper FROM bars""",
    ("bars",),
)
def sma_bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, _, high = ind.bollinger()
    return rounded(bars(spark, sf_dir).select("entity", "date", ind.sma("close", 20).alias("sma"), low.alias("lower"), high.alias("upper")))


_TR = "t AS (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS prev FROM bars))"


@query(f", {_TR} SELECT entity, date, round(tr, 6) AS tr, round({_rows('avg', 'tr', 14)}, 6) AS atr FROM t", ("bars",))
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.atr(bars(spark, sf_dir)).select("entity", "date", "tr", "atr"))


@query(
    f""", s AS (SELECT *, {_rows("min", "low", 14)} AS lo, {_rows("max", "high", 14)} AS hi FROM bars), k AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE 100 * (close - lo) / nullif(hi - lo, 0) END AS k FROM s)
    SELECT entity, date, round(k, 6) AS stoch_k, round({_rows("avg", "k", 3)}, 6) AS stoch_d, round(-100 * (hi - close) / nullif(hi - lo, 0), 6) AS williams_r FROM k""",
    ("bars",),
)
def stochastic_williams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.stochastic(bars(spark, sf_dir)).withColumn("williams_r", ind.williams_r()).select("entity", "date", "stoch_k", "stoch_d", "williams_r"))


@query(
    f""", p AS (SELECT *, (high + low + close) / 3 AS tp, (high + low + close) / 3 * volume AS flow, sign(coalesce(close - lag(close) OVER (PARTITION BY entity ORDER BY date), 0)) * volume AS signed FROM bars),
    q AS (SELECT *, tp - lag(tp) OVER (PARTITION BY entity ORDER BY date) AS dtp FROM p), r AS (SELECT *, CASE WHEN dtp > 0 THEN flow WHEN dtp IS NOT NULL THEN 0.0 END AS up, CASE WHEN dtp <= 0 THEN flow WHEN dtp IS NOT NULL THEN 0.0 END AS down FROM q),
    s AS (SELECT *, {_rows("sum", "up", 14)} AS u, {_rows("sum", "down", 14)} AS d FROM r)
    SELECT entity, date, round(sum(signed) OVER w, 6) AS obv, round(sum(flow) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap, round({_rows("sum", "flow", 10)} / nullif({_rows("sum", "volume", 10)}, 0), 6) AS vwap_10,
    round(CASE WHEN u = 0 AND d = 0 THEN NULL WHEN d = 0 THEN 100.0 WHEN u = 0 THEN 0.0 ELSE 100 - 100 / (1 + u / nullif(d, 0)) END, 6) AS mfi FROM s WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    ("bars",),
)
def volume_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ind.mfi(ind.obv(bars(spark, sf_dir)))
    return rounded(out.select("entity", "date", "obv", ind.vwap().alias("vwap"), ind.vwap(10).alias("vwap_10"), "mfi"))


@query(
    """SELECT entity, date, round(CASE WHEN count(high) OVER a = 20 THEN max(high) OVER a END, 6) AS channel_high, round(CASE WHEN count(low) OVER b = 10 THEN min(low) OVER b END, 6) AS channel_low FROM bars
    WINDOW a AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    ("bars",),
)
def donchian(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = ind.donchian()
    return rounded(bars(spark, sf_dir).select("entity", "date", high.alias("channel_high"), low.alias("channel_low")))


@query(
    f""", b AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(open / lag(close) OVER (PARTITION BY entity ORDER BY date)) AS gap, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars),
    c AS (SELECT *, hl * hl AS hl2, 0.5 * hl * hl - (2 * ln(2) - 1) * co * co AS gk FROM b)
    SELECT entity, date, round(sqrt({_rows("avg", "hl2", 20)} / (4 * ln(2)) * 252), 6) AS parkinson, round(sqrt(greatest({_rows("avg", "gk", 20)}, 0 * ({_rows("avg", "gk", 20)})) * 252), 6) AS garman_klass,
    round(sqrt(greatest(({_rows("var_samp", "gap", 20)}) + (0.34 / (1.34 + 21.0 / 19)) * ({_rows("var_samp", "co", 20)}) + (1 - 0.34 / (1.34 + 21.0 / 19)) * ({_rows("avg", "rs", 20)}), 0 * ({_rows("var_samp", "gap", 20)})) * 252), 6) AS yang_zhang FROM c""",
    ("bars",),
)
def range_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.range_volatilities(bars(spark, sf_dir)))


def _ema(x: str, span: int) -> str:
    return f"list_reduce(list({x}) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), lambda a, v: a + {2 / (span + 1)!r} * (v - a))"


def _wilder(values: str, n: int) -> str:
    """Wilder mean of a list's non-null values, null before ``n``."""
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce(list_concat([list_avg({values}[1:{n}])], {values}[{n + 1}:]), lambda a, v: (a * {n - 1} + v) / {n}) END"


def _wilder_sum(values: str, n: int) -> str:
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce(list_concat([list_sum({values}[1:{n}])], {values}[{n + 1}:]), lambda a, v: a - a / {n} + v) END"


_RUN = "OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(
    f""", {_TR}, m AS (SELECT *, {_ema("close", 12)} - {_ema("close", 26)} AS macd, {_ema("close", 20)} AS ema, high - lag(high) OVER (PARTITION BY entity ORDER BY date) AS up, lag(low) OVER (PARTITION BY entity ORDER BY date) - low AS down, close - prev AS change FROM t),
    l AS (SELECT *, {_ema("macd", 9)} AS line, list(greatest(change, 0)) FILTER (change IS NOT NULL) {_RUN} AS gains, list(greatest(-change, 0)) FILTER (change IS NOT NULL) {_RUN} AS losses, list(tr) FILTER (tr IS NOT NULL) {_RUN} AS trs,
      list(CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END) FILTER (up IS NOT NULL) {_RUN} AS ups, list(CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END) FILTER (up IS NOT NULL) {_RUN} AS downs FROM m),
    w AS (SELECT *, {_wilder("gains", 14)} AS g, {_wilder("losses", 14)} AS o, {_wilder("trs", 14)} AS watr, {_wilder_sum("trs", 14)} AS s, {_wilder_sum("ups", 14)} AS p, {_wilder_sum("downs", 14)} AS q FROM l),
    d AS (SELECT *, CASE WHEN s > 0 THEN 100 * p / s WHEN s IS NOT NULL THEN 0.0 END AS pdi, CASE WHEN s > 0 THEN 100 * q / s WHEN s IS NOT NULL THEN 0.0 END AS mdi FROM w),
    x AS (SELECT *, list(CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0.0 END) FILTER (pdi IS NOT NULL) {_RUN} AS dxs FROM d)
    SELECT entity, date, round(ema, 4) AS ema, round(macd, 4) AS macd, round(line, 4) AS macd_signal, round(macd - line, 4) AS macd_hist, round(CASE WHEN o = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / o) END, 4) AS rsi,
      round({_wilder("dxs", 14)}, 4) AS adx, round(pdi, 4) AS plus_di, round(mdi, 4) AS minus_di, round(watr, 4) AS wilder_atr FROM x""",
    ("bars",),
)
def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.recursive_panel(bars(spark, sf_dir), only=("ema", "macd", "macd_signal", "macd_hist", "rsi", "adx", "plus_di", "minus_di", "wilder_atr")), 4)


# State of the stop: trend, stop, extreme, speed, and the two bars before.
_SAR = """list_reduce(list({'up': true, 'stop': low, 'ext': high, 'speed': 0.02, 'h': high, 'l': low, 'h2': high, 'l2': low}) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), lambda a, v:
      list_transform(list_transform([CASE WHEN a.up THEN least(a.stop + a.speed * (a.ext - a.stop), a.l, a.l2) ELSE greatest(a.stop + a.speed * (a.ext - a.stop), a.h, a.h2) END], lambda s: {'s': s, 'turn': CASE WHEN a.up THEN v.l < s ELSE v.h > s END, 'far': CASE WHEN a.up THEN v.h > a.ext ELSE v.l < a.ext END}),
      lambda p: {'up': a.up <> p.turn, 'stop': CASE WHEN p.turn THEN a.ext ELSE p.s END, 'ext': CASE WHEN p.turn THEN CASE WHEN a.up THEN v.l ELSE v.h END WHEN p.far THEN CASE WHEN a.up THEN v.h ELSE v.l END ELSE a.ext END,
        'speed': CASE WHEN p.turn THEN 0.02 WHEN p.far THEN least(a.speed + 0.02, 0.2) ELSE a.speed END, 'h': v.h, 'l': v.l, 'h2': a.h, 'l2': a.l})[1])"""


@query(f", s AS (SELECT entity, date, {_SAR} AS s FROM bars) SELECT entity, date, round(s.stop, 6) AS psar, CASE WHEN s.up THEN 1.0 ELSE -1.0 END AS psar_trend FROM s", ("bars",))
def parabolic_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.recursive_panel(bars(spark, sf_dir), only=("psar", "psar_trend")))


@query(
    f""", b AS (SELECT *, close / lag(close, 10) OVER (PARTITION BY entity ORDER BY date) - 1 AS momentum, close / lag(close) OVER (PARTITION BY entity ORDER BY date) - 1 AS r FROM bars),
    c AS (SELECT *, CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0.0 END AS neg, abs(r) * abs(lag(r) OVER (PARTITION BY entity ORDER BY date)) AS bp, abs(r) / nullif(close * volume, 0) AS ill FROM b)
    SELECT entity, date, round(momentum, 6) AS momentum, CASE WHEN count(high) OVER a = 20 THEN (close > max(high) OVER a)::INTEGER END AS new_high, round(sqrt({_rows("avg", "neg", 20)} * 252), 6) AS semivolatility,
      round(sqrt(pi() / 2 * ({_rows("avg", "bp", 20)}) * 252), 6) AS bipower, round(close / ({_rows("max", "close", 20)}) - 1, 6) AS rolling_drawdown, round(1e6 * ({_rows("avg", "ill", 20)}), 6) AS amihud, round(volume / ({_rows("avg", "volume", 20)}) - 1, 6) AS volume_surprise FROM c
    WINDOW a AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    ("bars",),
)
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.operators.features import window_features

    return rounded(window_features(bars(spark, sf_dir)))
