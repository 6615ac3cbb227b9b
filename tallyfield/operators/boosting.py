"""Boosted trees whose size the data decide: quantiles under pinball loss, and classifiers that stop by validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lake import drop_stored, stored
from .ml import prepare

#: Quantiles of leaves are within 1 / ACCURACY of their rank; of up to as many rows they are exact (the lower of two middle values).
ACCURACY = 10_000


def pinball(target: Column, guess: Column, alpha: float) -> Column:
    """Loss whose mean is least at the alpha-quantile."""
    return F.greatest(alpha * (target - guess), (alpha - 1) * (target - guess))


@dataclass
class QuantileBoost:
    """start + rate * (the values of the leaves that a row falls into)."""

    alpha: float
    rate: float
    prepared: PipelineModel
    start: float
    trees: list[tuple[DecisionTreeRegressionModel, dict[int, float]]] = field(default_factory=list)

    def predict(self, df: DataFrame, name: str = "quantile") -> DataFrame:
        out = self.prepared.transform(df).withColumn("__f", F.lit(self.start))
        for tree, values in self.trees:
            out = _added(tree, values, self.rate, out)
        return out.select(*df.columns, F.col("__f").alias(name))


def _added(tree: DecisionTreeRegressionModel, values: dict[int, float], rate: float, df: DataFrame) -> DataFrame:
    """`df` with the tree's step added to __f; a tree has a few leaves, so their values are literals."""
    step = F.create_map(*[F.lit(float(x)) for kv in values.items() for x in kv])[F.col("__leaf")]
    out = tree.transform(df).withColumn("__f", F.col("__f") + rate * F.coalesce(step, F.lit(0.0)))
    return out.drop("__leaf", "__step")


def fit_quantile(train: DataFrame, features: list[str], target: str, alpha: float = 0.5, valid: DataFrame | None = None, rounds: int = 30, depth: int = 3, rate: float = 0.2, least: int = 20, patience: int = 3) -> QuantileBoost:
    """Functional gradient boosting of the alpha-quantile of `target`.

    Every round grows a tree on the loss's gradient, which is the side of the guess that a row lies on, and then gives each leaf
    the alpha-quantile of what is left to explain there: one distributed aggregation of as many rows as there are leaves. The
    rows' guesses are written to the shared folder, so a round costs the same however many lie behind it. With
    `valid`, boosting stops when the loss there has not fallen for `patience` rounds, and trees behind the best are dropped.
    Rows without a target are left out; missing features are imputed.
    """
    train = train.where(F.col(target).isNotNull())
    y = F.col(target).cast("double").alias("__y")
    start = train.agg(F.percentile_approx(F.col(target).cast("double"), alpha, ACCURACY)).first()[0]
    if start is None:
        raise ValueError(f"no row has a {target}")
    prepared = Pipeline(stages=prepare(features)).fit(train)
    rows = lambda df: stored(prepared.transform(df).select("vector", y, F.lit(float(start)).alias("__f")))
    now, held = rows(train), None if valid is None else rows(valid.where(F.col(target).isNotNull()))
    model, losses = QuantileBoost(alpha, rate, prepared, float(start)), []
    loss = lambda df: df.agg(F.avg(pinball(F.col("__y"), F.col("__f"), alpha))).first()[0]
    if held is not None:
        losses.append(loss(held))
    grow = DecisionTreeRegressor(featuresCol="vector", labelCol="__g", predictionCol="__step", leafCol="__leaf", maxDepth=depth, minInstancesPerNode=least, seed=7)
    for _ in range(rounds):
        side = now.withColumn("__g", F.when(F.col("__y") > F.col("__f"), alpha).otherwise(alpha - 1))
        tree = grow.fit(side)
        left = F.percentile_approx(F.col("__y") - F.col("__f"), alpha, ACCURACY)
        values = {r["__leaf"]: r["v"] for r in tree.transform(now).groupBy("__leaf").agg(left.alias("v")).collect()}
        model.trees.append((tree, values))
        after = stored(_added(tree, values, rate, now))
        drop_stored(now)
        now = after
        if held is not None:
            after = stored(_added(tree, values, rate, held))
            drop_stored(held)
            held = after
            losses.append(loss(held))
            if len(losses) - 1 - min(range(len(losses)), key=losses.__getitem__) >= patience:
                break
    if held is not None:
        model.trees = model.trees[: min(range(len(losses)), key=losses.__getitem__)]
        drop_stored(held)
    drop_stored(now)
    return model


def held_back(columns: list[str], share: int = 5) -> Column:
    """About one row in `share`, chosen by its values and so alike in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(share)) == 0


def fit_boosted(train: DataFrame, features: list[str], label: str = "label", keys: tuple[str, ...] = ("company_id", "trade_date"), most: int = 40, depths: tuple[int, ...] = (2, 4), tolerance: float = 0.001) -> PipelineModel:
    """A boosted-tree classifier whose number of trees and depth a held-back part of the rows decides; positives weigh as much in all as negatives.

    For each depth Spark adds trees until the held-back error stops falling by `tolerance`; of the depths the one with the smaller held-back log loss is taken.
    """
    known = train.where(F.col(label).isNotNull())
    rate = known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    weight = F.when(F.col(label), 0.5 / max(rate, 1e-6)).otherwise(0.5 / max(1 - rate, 1e-6))
    data = stored(known.withColumns({"y": F.col(label).cast("double"), "w": weight, "held": held_back(list(keys))}))
    fitted = []
    for depth in depths:
        trees = GBTClassifier(featuresCol="vector", labelCol="y", weightCol="w", maxIter=most, maxDepth=depth, stepSize=0.2, seed=7, validationIndicatorCol="held", validationTol=tolerance)
        model = Pipeline(stages=[*prepare(features), trees]).fit(data)
        p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-6)), F.lit(1 - 1e-6))
        loss = model.transform(data.where("held")).agg(F.sum(-F.col("w") * (F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)))).first()[0]
        fitted.append((float("inf") if loss is None else loss, depth, model))
    drop_stored(data)
    return min(fitted, key=lambda x: x[:2])[2]
