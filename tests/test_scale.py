"""What a query's cost must not grow with: steps of plans, sizes of tasks, and results where the larger tables differ."""

from __future__ import annotations

import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import blocks, frames, pairs, quantiles
from quantloom.operators import indicators, metrics, microstructure, network, statistics
from quantloom.plans import load
from quantloom.plans.catalog import QUERIES, SQL
from quantloom.sources.tables import bars
from tests.conftest import SMALL

load()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def _panel(spark, entities: int = 7, n: int = 130, seed: int = 0) -> tuple[pd.DataFrame, object]:
    rng = np.random.default_rng(seed)
    rows = [(e, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(rng.normal(0, 0.02))) for e in range(entities) for i in range(n + 3 * e)]
    pdf = pd.DataFrame(rows, columns=["entity", "date", "ret"])
    return pdf, spark.createDataFrame(pdf)


def test_var_forecasts_read_their_series_once(spark):
    plan = _plan(QUERIES["var_forecasts"](spark, SMALL))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 1 and "skewness" not in plan


def test_var_forecasts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 100)
    pdf, df = _panel(spark)
    got = metrics.var_forecasts(df, ["historical", "normal"], 100).toPandas().set_index(["entity", "date"]).sort_index()
    for e, g in pdf.groupby("entity"):
        x = g["ret"].to_numpy()
        want = [(-np.quantile(x[i - 100 : i], 0.05), -(x[i - 100 : i].mean() - 1.6448536269514722 * x[i - 100 : i].std(ddof=1))) for i in range(100, len(x))]
        assert np.allclose(got.loc[e][["var_historical", "var_normal"]].to_numpy(), want, rtol=1e-9)


def test_partitions_of_bars_grow_with_their_input(spark, monkeypatch):
    monkeypatch.setattr(frames, "PART_BYTES", 1 << 10)
    assert bars(spark, SMALL).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_exact_quantiles_are_those_of_percentile(spark, monkeypatch):
    """Sketches too coarse and brackets too small make every branch run."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=4_000), "b": rng.integers(0, 5, 4_000).astype(float)})
    df = spark.createDataFrame(pdf).selectExpr("if(a > 2.5, null, a) AS a", "b", "cast(null AS double) AS c")
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    monkeypatch.setattr(quantiles, "VALUES", 500)
    got = quantiles.exact_quantiles(df, {"a": [0.01, 0.5, 1.0], "b": [0.3], "c": [0.5]})
    want = df.selectExpr("percentile(a, array(0.01, 0.5, 1.0)) AS a", "percentile(b, 0.3) AS b").first()
    assert got == {"a": list(want.a), "b": [want.b], "c": [None]}


def test_winsorized_brings_no_column_into_one_task(spark):
    assert "percentile" not in _plan(QUERIES["winsorized"](spark, SMALL))


@pytest.mark.parametrize("name", ["average_correlation", "pair_covariances"])
def test_pairs_are_not_rows_of_dates(spark, name):
    """Names meet in blocks: nothing joins rows by date."""
    plan = _plan(QUERIES[name](spark, SMALL))
    assert "FlatMapGroupsInArrow" in plan and "[date#" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_moments_of_series_that_hardly_move_are_exact():
    x = np.array([[5.0, 0.3, 0.3, 0.3]])
    m = np.ones((1, 4))
    k = np.array([[0.0, 1, 1, 1]])
    n, sxy, sxx, syy = pairs.moments((x, m), (x * k, k))
    assert n[0, 0] == 3 and sxx[0, 0] == syy[0, 0] == sxy[0, 0] == 0


def test_cointegration_takes_any_number_of_names(spark):
    df = spark.range(2_002).selectExpr("id AS entity", "explode(sequence(0, 1)) AS d").selectExpr("entity", "timestamp'2020-01-01' + make_dt_interval(d) AS date", "1.0D + entity AS close")
    assert statistics.cointegration_scan(df).count() == 0


def test_zero_quotes_count_where_every_quote_does(spark):
    """sf0.1 has events of value 0; their quotes are 0 on both sides."""
    rows = [(1, 1, 0, 0.0, 0.0, 1.0, 1.0), (1, 2, 1, 9.0, 11.0, 1.0, 3.0), (1, 2, 2, 19.0, 21.0, 1.0, 3.0)]
    quotes = spark.createDataFrame(rows, "symbol int, t int, seq int, bid_price double, ask_price double, bid_size double, ask_size double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    trades = spark.createDataFrame([(1, 2, 7, 12.0)], "symbol int, t int, seq int, price double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    r = frames.rounded(microstructure.effective_spread(trades, quotes, "0 SECONDS", every=True)).first()
    assert r.mid == 0 and r.effective_bps == float("inf") and r.mid_later == 10.0


def test_zero_books_count_where_every_book_does(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 1.0, 1.0), (1, 2, 1, 9.0, 11.0, 1.0, 3.0)]
    book = spark.createDataFrame(rows, "symbol int, ts int, seq int, bid_price double, ask_price double, bid_size double, ask_size double")
    assert [(r.seq, r.microprice, r.ofi) for r in microstructure.book_metrics(book, every=True).orderBy("seq").collect()] == [(0, 0.0, None), (1, 9.5, 2.0)]
    assert microstructure.book_metrics(book).count() == 1


def test_blocks_give_what_series_give():
    rng = np.random.default_rng(2)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (90, 4)), axis=0))
    close[:, 1][40:] = np.nan
    close[10:13, 2] = np.nan
    high, low = close + 1, close - 1
    ours = [indicators.ema_block(close, 9), indicators.rsi_block(close, 14), indicators.wilder_block(close, 14), *indicators.adx_block(high, low, close, 14), *indicators.psar_block(high, low)]
    for j in range(4):
        c, h, lo = close[:, j], high[:, j], low[:, j]
        theirs = [indicators.ema_values(c, 9), indicators.rsi_values(c, 14), indicators.wilder_mean(c, 14), *indicators.gapless(lambda h, lo, c: indicators.adx_values(h, lo, c, 14), h, lo, c), *indicators.gapless(indicators.psar_values, h, lo)]
        for a, b in zip(ours, theirs, strict=True):
            assert np.allclose(a[:, j], b, rtol=1e-9, equal_nan=True)


def test_uniqueness_weights_join_nothing_by_row(spark):
    assert "SortMergeJoin" not in _plan(QUERIES["uniqueness_weights"](spark, SMALL))


def test_books_and_rounding_are_those_of_sql_on_odd_events(spark):
    """Null, negative and very large values; event numbers below 0, whose sizes can sum to 0."""
    values = [1.25, None, 2.5, -3.0, 0.0, 4567890123456.789, 3e14, 1e300, 7.0]
    rows = [(1 + k, 2 * i + k - 9, v) for i, v in enumerate(values) for k in (0, 1)]
    folder = tempfile.mkdtemp()
    events = spark.createDataFrame(rows, "user_id long, event_id long, value double").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    got = QUERIES["book_metrics"](spark, folder).orderBy("seq").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    clean = lambda x: None if x is None or x != x else x
    assert [tuple(map(clean, r)) for r in got] == [tuple(map(clean, r)) for r in con.execute(f"SELECT * FROM ({SQL['book_metrics']}) ORDER BY seq").fetchall()]


def _tree_degrees(c: np.ndarray) -> np.ndarray:
    """Kruskal over all pairs, greatest correlation first, then the lesser names."""
    n = len(c)
    group, degree = list(range(n)), np.zeros(n, int)
    for _, i, j in sorted((-np.rint(c[i, j] * 1e12), i, j) for i in range(n) for j in range(i + 1, n)):
        if group[i] != group[j]:
            degree[[i, j]] += 1
            group = [group[i] if g == group[j] else g for g in group]
    return degree


def test_trees_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """Many small blocks, forests joined in several rounds; copies of names make ties, one name does not move, one has 2 returns."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.02, (40, 60))
    x[30:36], x[36] = x[:6], 0.1
    x[rng.random(x.shape) < 0.3] = np.nan
    x[30:36] = x[:6]
    x[37, 2:] = np.nan
    x[37, :2] = 0.01, 0.02
    rows = [(int(e), pd.Timestamp("2020-11-20") + pd.Timedelta(days=int(d)), float(x[e, d])) for e, d in zip(*np.nonzero(~np.isnan(x)), strict=True)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["entity", "date", "ret"]))
    monkeypatch.setattr(network, "FAN", 2)
    monkeypatch.setattr(pairs, "sides", lambda df: (6, 7))
    got = network.mst_degree(df).toPandas().set_index(["period", "entity"])["degree"]
    edge = (pd.Timestamp("2021-01-01") - pd.Timestamp("2020-11-20")).days
    for period, part in (("2020-01-01", x[:, :edge]), ("2021-01-01", x[:, edge:])):
        names = np.flatnonzero((~np.isnan(part)).sum(axis=1) >= 3)
        z = np.nan_to_num(part[names] - np.nanmean(part[names], axis=1)[:, None])
        z[names == 36] = 0
        length = np.sqrt((z * z).sum(axis=1))
        z /= np.where(length > 0, length, 1)[:, None]
        want = pd.Series(_tree_degrees(np.minimum(z @ z.T, 1)), names)
        assert got.loc[pd.Timestamp(period)].sort_index().to_dict() == want.to_dict()


def test_trees_and_components_hold_no_panel(spark):
    for name in ("mst_degree", "pca_loadings"):
        assert "FlatMapGroupsInPandas" not in _plan(QUERIES[name](spark, SMALL))


def test_component_of_sums_is_that_of_the_panel(spark, monkeypatch):
    monkeypatch.setattr(network, "ROWS", 50)
    pdf, _ = _panel(spark, 9, 300)
    pdf.loc[pdf.index[::7], "ret"] = None
    pdf.loc[(pdf["entity"] == 8) & (pdf["date"] >= "2020-01-03"), "ret"] = None
    flat = pd.DataFrame([(e, pd.Timestamp("2030-01-01") + pd.Timedelta(days=d), 0.1) for e in (1, 2) for d in range(4)], columns=["entity", "date", "ret"])
    df = spark.createDataFrame(pd.concat([pdf, flat])).selectExpr("entity", "date", "if(isnan(ret), null, ret) AS ret").repartition(3)
    got, want = (f.toPandas().set_index(["period", "entity"]).sort_index() for f in (network.pca(df, "quarter"), network._pca_of_panels(df, "quarter")))
    assert got.index.equals(want.index) and len(got) > 20
    assert np.allclose(got.drop(pd.Timestamp("2030-01-01"))[["loading", "share"]], want.drop(pd.Timestamp("2030-01-01"))[["loading", "share"]], rtol=1e-8, atol=1e-12)
    assert list(got.loc[pd.Timestamp("2030-01-01"), "loading"]) == [1.0, 0.0] and got.loc[pd.Timestamp("2030-01-01"), "share"].isna().all()
