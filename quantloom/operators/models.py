"""Preprocessing steps, estimators, walk-forward experiments and ensembles over a panel.

Steps learn from the training rows alone and are applied to both; estimators
are those of ``pyspark.ml``, so training is distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.quantiles import exact_quantiles
from quantloom.operators import features as ft
from quantloom.operators import learning as ln

Fitted = Callable[[DataFrame], DataFrame]


def _from_row(stats: DataFrame, columns: list[str], apply: Callable[[DataFrame, str], DataFrame]) -> Fitted:
    """A step that joins one row of training statistics to each table it is applied to."""

    def run(df: DataFrame) -> DataFrame:
        out = df.crossJoin(F.broadcast(stats))
        for c in columns:
            out = apply(out, c)
        return out.select(*df.columns)

    return run


def _quantile_row(train: DataFrame, columns: list[str], quantiles: dict[str, float]) -> DataFrame:
    """One row ``__<name>_<column>`` of exact quantiles."""
    made = exact_quantiles(train, {c: list(quantiles.values()) for c in columns})
    row = {f"__{n}_{c}": v for c in columns for n, v in zip(quantiles, made[c], strict=True)}
    return train.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` double" for n in row))


def winsorize(train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> Fitted:
    stats = _quantile_row(train, columns, {"lo": low, "hi": high})
    return _from_row(stats, columns, lambda d, c: d.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__lo_{c}")), F.col(f"__hi_{c}")))))


def zscore(train: DataFrame, columns: list[str]) -> Fitted:
    stats = train.agg(*(f.alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg(c)), ("s", F.stddev_samp(c)))))
    return _from_row(stats, columns, lambda d, c: d.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))))


def robust_scale(train: DataFrame, columns: list[str]) -> Fitted:
    stats = _quantile_row(train, columns, {"a": 0.25, "m": 0.5, "b": 0.75})
    return _from_row(stats, columns, lambda d, c: d.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__b_{c}") - F.col(f"__a_{c}"), F.lit(0.0))))


def impute(train: DataFrame, columns: list[str], how: str = "median") -> Fitted:
    if how not in ("median", "mean"):
        raise KeyError(how)
    stats = _quantile_row(train, columns, {"v": 0.5}) if how == "median" else train.agg(*(F.avg(c).alias(f"__v_{c}") for c in columns))
    return _from_row(stats, columns, lambda d, c: d.withColumn(c, F.coalesce(c, f"__v_{c}")))


def missing_indicator(train: DataFrame, columns: list[str]) -> Fitted:
    return lambda df: df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in columns})


def cross_sectional_standardize(train: DataFrame, columns: list[str]) -> Fitted:
    def run(df: DataFrame) -> DataFrame:
        for c in columns:
            df = ft.standardize_by_date(df, c, "__z").drop(c).withColumnRenamed("__z", c)
        return df

    return run


def cross_sectional_rank(train: DataFrame, columns: list[str]) -> Fitted:
    def run(df: DataFrame) -> DataFrame:
        for c in columns:
            df = ft.rank_by_date(df, c, "__r").drop(c).withColumnRenamed("__r", c)
        return df

    return run


PREPROCESSORS: dict[str, Callable[..., Fitted]] = {"winsorize": winsorize, "zscore": zscore, "robust_scale": robust_scale, "impute": impute, "missing_indicator": missing_indicator, "cross_sectional_standardize": cross_sectional_standardize, "cross_sectional_rank": cross_sectional_rank}
ESTIMATORS: dict[str, Callable[..., Estimator]] = {
    "linear": lambda **p: LinearRegression(**p), "ridge": lambda alpha=1.0, **p: LinearRegression(regParam=alpha, elasticNetParam=0.0, **p), "lasso": lambda alpha=0.01, **p: LinearRegression(regParam=alpha, elasticNetParam=1.0, **p), "elastic_net": lambda alpha=0.01, ratio=0.5, **p: LinearRegression(regParam=alpha, elasticNetParam=ratio, **p),
    "huber": lambda **p: LinearRegression(loss="huber", **p), "tree": lambda **p: DecisionTreeRegressor(**p), "random_forest": lambda **p: RandomForestRegressor(**p), "gradient_boosting": lambda **p: GBTRegressor(**p),
    "logistic": lambda **p: LogisticRegression(**p), "random_forest_classifier": lambda **p: RandomForestClassifier(**p), "gradient_boosting_classifier": lambda **p: GBTClassifier(**p), "aft_survival": lambda **p: AFTSurvivalRegression(**p),
}


def register_preprocessor(name: str, make: Callable[..., Fitted]) -> None:
    if name in PREPROCESSORS:
        raise ValueError(f"step {name!r} exists")
    PREPROCESSORS[name] = make


def register_estimator(name: str, make: Callable[..., Estimator]) -> None:
    if name in ESTIMATORS:
        raise ValueError(f"estimator {name!r} exists")
    ESTIMATORS[name] = make


@dataclass
class Experiment:
    """``features`` to ``target`` with ``estimator``; ``steps``: (name, parameters) in order."""

    features: list[str]
    target: str = "target"
    estimator: str = "ridge"
    params: dict = field(default_factory=dict)
    steps: list[tuple[str, dict]] = field(default_factory=list)

    def fit_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """``entity, date, prediction`` and the target of the test rows with all features."""
        columns = [*self.features, self.target]
        train = train.where(" and ".join(f"`{c}` is not null" for c in [self.target]))
        for name, params in self.steps:
            fitted = PREPROCESSORS[name](train, self.features, **params)
            train, test = fitted(train), fitted(test)
        assemble = VectorAssembler(inputCols=self.features, outputCol="__x", handleInvalid="skip")
        model = ESTIMATORS[self.estimator](featuresCol="__x", labelCol=self.target, **self.params).fit(assemble.transform(train.select(*columns)))
        out = model.transform(assemble.transform(test.select("entity", "date", *columns)))
        score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return out.select("entity", "date", score.alias("prediction"), self.target)

    def walk_forward(self, panel: DataFrame, train: int, test: int, embargo: int = 0, expanding: bool = False) -> DataFrame:
        """Out-of-sample predictions of all folds; training labels that end after the training window are left out."""
        folds = ln.walk_forward(panel.select("date"), train, test, embargo, expanding)
        bounds = folds.groupBy("fold", "role").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()  # two rows a fold
        out = None
        for fold in sorted({b.fold for b in bounds}):
            span = {b.role: (b.lo, b.hi) for b in bounds if b.fold == fold}
            within = lambda role: panel.where(F.col("date").between(*span[role]))  # noqa: B023, E731
            learned = within("train")
            if "label_end_date" in panel.columns:
                learned = learned.where(F.col("label_end_date") <= F.lit(span["train"][1]))
            made = self.fit_predict(learned, within("test")).withColumn("fold", F.lit(fold))
            out = made if out is None else out.unionByName(made)
        if out is None:
            raise ValueError("there are too few dates for one fold")
        return out


def regression_metrics(predictions: DataFrame, target: str = "target") -> DataFrame:
    p, y = F.col("prediction"), F.col(target)
    known = predictions.where(p.isNotNull() & y.isNotNull())
    return known.agg(F.count("*").alias("n"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.avg(F.abs(p - y)).alias("mae"), (1 - F.sum((p - y) * (p - y)) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"), F.avg((F.signum(p) == F.signum(y)).cast("double")).alias("hit_rate"))


def classification_metrics(predictions: DataFrame, target: str = "target", cut: float = 0.5) -> DataFrame:
    p, y = F.col("prediction") >= cut, F.col(target) == 1
    a = predictions.where(F.col("prediction").isNotNull() & F.col(target).isNotNull()).agg(F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"), F.avg(F.pow(F.col("prediction") - F.col(target), 2)).alias("brier"))
    ratio = lambda x, z: F.col(x) / F.nullif(F.col(x) + F.col(z), F.lit(0))
    return a.select("n", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), "brier")


def ensemble(members: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of predictions on the rows that all members have."""
    weights = weights or [1 / len(members)] * len(members)
    tagged = None
    for i, (m, w) in enumerate(zip(members, weights, strict=True)):
        part = m.select("entity", "date", (F.col("prediction") * w).alias("p"), F.lit(i).alias("m"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("entity", "date").agg(F.sum("p").alias("prediction"), F.count("*").alias("n")).where(F.col("n") == len(members)).drop("n")


def diebold_mariano(a: DataFrame, b: DataFrame, target: str = "target") -> DataFrame:
    """t statistic of the mean difference in squared errors by date, with a lag-one correction."""
    from pyspark.sql import Window as W

    loss = lambda d, n: d.select("entity", "date", F.pow(F.col("prediction") - F.col(target), 2).alias(n))
    d = loss(a, "x").join(loss(b, "y"), ["entity", "date"]).groupBy("date").agg(F.avg(F.col("x") - F.col("y")).alias("d"))
    m = d.agg(F.avg("d").alias("m"))
    x = d.crossJoin(F.broadcast(m)).withColumn("e", F.col("d") - F.col("m")).withColumn("l", F.lag("e").over(W.orderBy("date")))
    s = x.agg(F.count("*").alias("n"), F.first("m").alias("mean_difference"), F.avg(F.col("e") * F.col("e")).alias("g0"), (F.sum(F.col("e") * F.col("l")) / F.count("*")).alias("g1"))
    return s.select("n", "mean_difference", (F.col("mean_difference") / F.sqrt(F.greatest(F.col("g0") + F.col("g1"), F.lit(1e-300)) / F.col("n"))).alias("dm"))
