"""Walk-forward evaluation on Spark ML: folds, classifiers, calibration, groups of models, leakage checks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import average_rank
from ..lake import stored
from .evaluate import auc, average_precision

#: The members of a group: their calibrated probabilities are averaged.
MEMBERS = ("gbt", "forest", "logistic", "deep_forest", "ridge")


def make_folds(spark: SparkSession, first_test: str, last: str, calib_quarters: int = 4, embargo_days: int = 14) -> DataFrame:
    """One row per quarter tested: training ends an embargo before calibration, which ends one before the test."""
    q = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first_test).cast("date"), "quarter"), F.trunc(F.lit(last).cast("date"), "quarter"), F.expr("interval 3 months"))).alias("test_from"))
    q = q.withColumns({"test_to": F.date_sub(F.add_months("test_from", 3), 1), "calib_from": F.add_months("test_from", -3 * calib_quarters)})
    return q.withColumns({"calib_to": F.date_sub("test_from", embargo_days), "train_to": F.date_sub("calib_from", embargo_days), "fold": F.row_number().over(Window.orderBy("test_from")).cast("long")})


def assign_folds(samples: DataFrame, folds: DataFrame, day: str = "trade_date") -> DataFrame:
    """Each sample with every fold it plays a part in: train, calib or test; folds are a short list."""
    f = F.broadcast(folds)
    role = F.when(F.col(day) < F.col("train_to"), "train").when((F.col(day) >= F.col("calib_from")) & (F.col(day) < F.col("calib_to")), "calib").when(F.col(day).between(F.col("test_from"), F.col("test_to")), "test")
    return samples.join(f, F.col(day) <= F.col("test_to")).withColumn("role", role).where("role is not null").select(*samples.columns, "fold", "role")


def prepare(features: list[str], scale: bool = False):
    stages = [Imputer(inputCols=features, outputCols=[f"{c}_i" for c in features]), VectorAssembler(inputCols=[f"{c}_i" for c in features], outputCol="raw_vector" if scale else "vector")]
    return stages + ([StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True)] if scale else [])


def fit_classifier(train: DataFrame, features: list[str], label: str = "label", kind: str = "gbt"):
    """A fitted pipeline; positives weigh as much in all as negatives."""
    rate = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    data = train.where(F.col(label).isNotNull()).withColumns({"y": F.col(label).cast("double"), "w": F.when(F.col(label), 0.5 / max(rate, 1e-6)).otherwise(0.5 / max(1 - rate, 1e-6))})
    common = dict(featuresCol="vector", labelCol="y", weightCol="w")
    model = {"gbt": lambda: GBTClassifier(maxIter=8, maxDepth=3, seed=7, **common), "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=7, **common), "logistic": lambda: LogisticRegression(maxIter=20, **common),
             "deep_forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=8, minInstancesPerNode=20, seed=11, **common), "ridge": lambda: LogisticRegression(maxIter=20, regParam=0.1, **common)}[kind]()
    return Pipeline(stages=[*prepare(features, kind in ("logistic", "ridge")), model]).fit(data)


def scores(model, df: DataFrame, name: str = "raw_p") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def fit_calibrator(model, calib: DataFrame, label: str = "label"):
    """Isotonic regression of the label on the raw score."""
    data = scores(model, calib.where(F.col(label).isNotNull())).select(F.col(label).cast("double").alias("label"), F.col("raw_p").alias("features"), F.lit(1.0).alias("weight"))
    return IsotonicRegression().fit(data)


def calibrated(model, calibrator, df: DataFrame, name: str = "p") -> DataFrame:
    raw = scores(model, df)
    out = calibrator.transform(raw.withColumnRenamed("raw_p", "features")).withColumn(name, F.least(F.greatest(F.col("prediction"), F.lit(0.001)), F.lit(0.999)))
    return out.select(*df.columns, name)


@dataclass
class Group:
    """Fitted members, each with its own calibrator."""

    features: list[str]
    members: dict[str, tuple]

    def score(self, df: DataFrame, name: str = "p", each: bool = False) -> DataFrame:
        """`df` with the mean of the members' calibrated probabilities; with `each` also theirs, as p_<member>."""
        out = df
        for kind, (model, calibrator) in self.members.items():
            out = calibrated(model, calibrator, out, f"p_{kind}")
        out = out.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"p_{k}") for k in self.members]) / len(self.members))
        return out if each else out.drop(*[f"p_{k}" for k in self.members])


def fit_group(train: DataFrame, calib: DataFrame, features: list[str], label: str = "label", kinds: tuple[str, ...] = MEMBERS) -> Group:
    """Members fitted on `train` and calibrated on `calib`."""
    fitted = {k: fit_classifier(train, features, label, k) for k in kinds}
    return Group(list(features), {k: (m, fit_calibrator(m, calib, label)) for k, m in fitted.items()})


def group_scores(train: DataFrame, calib: DataFrame, test: DataFrame, features: list[str], label: str = "label", kinds: tuple[str, ...] = MEMBERS, calibrate: bool = True) -> DataFrame:
    """`test` with `p`: the mean of the members' probabilities, each member calibrated on `calib` by itself."""
    if calibrate:
        return fit_group(train, calib, features, label, kinds).score(test)
    scored = test
    for k in kinds:
        scored = scores(fit_classifier(train, features, label, k), scored, f"p_{k}")
    return scored.withColumn("p", reduce(lambda a, b: a + b, [F.col(f"p_{k}") for k in kinds]) / len(kinds)).drop(*[f"p_{k}" for k in kinds])


def walk_forward(samples: DataFrame, folds: DataFrame, features: list[str], label: str = "label", kinds: tuple[str, ...] = ("gbt",), calibrate: bool = True, parallelism: int = 8) -> DataFrame:
    """Out-of-sample predictions of all folds; with several kinds their calibrated mean. Folds are a short list, of
    which `parallelism` are fitted at one time; every fit and prediction is distributed. Folds without a positive to learn from
    or to calibrate on are left out."""
    roles = assign_folds(samples, folds)
    seen = {(r.fold, r.role): r for r in roles.groupBy("fold", "role").agg(F.count("*").alias("n"), F.count(F.when(F.col(label), 1)).alias("pos")).collect()}

    def one(f: int) -> DataFrame:
        part = roles.where(F.col("fold") == f)
        train, calib, test = (part.where(F.col("role") == r).drop("role") for r in ("train", "calib", "test"))
        return group_scores(train, calib, test, features, label, kinds, calibrate)

    usable = [f for f in sorted({fold for fold, _ in seen}) if all((f, r) in seen and (r == "test" or seen[f, r].pos) for r in ("train", "calib", "test"))]
    with ThreadPoolExecutor(parallelism) as pool:
        out = list(pool.map(one, usable))
    if not out:
        return samples.limit(0).withColumns({"fold": F.lit(0).cast("long"), "p": F.lit(0.0)})
    return reduce(DataFrame.unionByName, out)


def baselines(preds: DataFrame, label: str = "label", rising: bool = True) -> DataFrame:
    """Columns to compare a model with: the base rate, and percentile ranks within the date of volatility and of
    momentum (for a label of falls, of its opposite: `rising` False)."""
    rate = preds.agg(F.avg(F.col(label).cast("double")).alias("base_rate"))
    momentum = average_rank("ret_20")
    out = preds.withColumns({"volatility": average_rank("vol_20"), "momentum": momentum if rising else 1 - momentum})
    return out.crossJoin(F.broadcast(rate))  # one row


def summarize(preds: DataFrame, names: list[str], label: str = "label", k: int = 5) -> DataFrame:
    """(score, auc, avg_precision, top5_precision) of each score column, missing scores counting 0, and of the base rate."""
    known = preds.where(F.col(label).isNotNull())
    long = known.select("row_id", "trade_date", label, F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.coalesce(n, F.lit(0.0)).alias("p")) for n in names])).alias("x")).select("row_id", "trade_date", label, "x.*")
    w = Window.partitionBy("score", "trade_date").orderBy(F.desc("p"), "row_id")
    top = long.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).groupBy("score").agg(F.avg(F.col(label).cast("double")).alias("top5_precision"))
    out = auc(long, ["score"], label=label).join(average_precision(long, label=label, by=["score"]).withColumnRenamed("ap", "avg_precision"), "score").join(top, "score")
    rate = F.avg(F.col(label).cast("double"))
    base = known.agg(rate.alias("r")).select(F.lit("base_rate").alias("score"), F.lit(0.5).alias("auc"), F.col("r").alias("avg_precision"), F.col("r").alias("top5_precision"))
    return out.unionByName(base).select("score", *[F.round(c, 4).alias(c) for c in ("auc", "avg_precision", "top5_precision")])


def median_gain(train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
    """The training median of the target in each test row's regression-tree leaf."""
    tree = DecisionTreeRegressor(featuresCol="vector", labelCol=target, maxDepth=4, leafCol="leaf", seed=7)
    model = Pipeline(stages=[*prepare(features), tree]).fit(train.where(F.col(target).isNotNull()))
    leaf = model.transform(train.where(F.col(target).isNotNull())).groupBy("leaf").agg(F.percentile_approx(target, 0.5).alias("median_gain"))
    return model.transform(test).join(leaf, "leaf", "left").select(*test.columns, "median_gain")


def numbered(rows: DataFrame, order) -> DataFrame:
    """`rows` with `__n`, consecutive numbers in a random order: within hash buckets, and after the rows of earlier buckets."""
    rows = stored(rows.withColumn("__o", order)).withColumn("__b", F.floor(F.col("__o") * 4096))
    before = rows.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__o")))
    return inside.join(before, "__b").withColumn("__n", F.col("__before") + F.col("__r")).drop("__o", "__b", "__r", "__before")


def holdout_auc(samples: DataFrame, features: list[str], split: str, label: str = "label", shuffle: bool = False, seed: int = 7) -> DataFrame:
    """AUC after the split date of a model fitted before it; with shuffled training labels it should be one half."""
    train, test = samples.where(F.col("trade_date") < split), samples.where(F.col("trade_date") >= split)
    if shuffle:
        # labels of a random permutation of the whole sample: two independent random orders, joined by their numbers
        a, b = numbered(train.drop(label), F.rand(seed)), numbered(train.select(label), F.rand(seed + 1))
        train = a.join(b, "__n").drop("__n")
    model = fit_classifier(train, features, label, "logistic")
    return auc(scores(model, test), score="raw_p", label=label)


def feature_importance(model, features: list[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(features, map(float, model.stages[-1].featureImportances.toArray()), strict=True)), "feature string, importance double")


def contributions(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Coefficient times standardised value of every feature of a logistic model."""
    weights = [float(x) for x in model.stages[-1].coefficients]
    v = vector_to_array("vector")
    out = model.transform(df)
    return out.select(*df.columns, *[(v[i] * w).alias(f"c_{n}") for i, (n, w) in enumerate(zip(features, weights, strict=True))])
