"""Fitted groups of models and their out-of-sample predictions, kept by signal and version in the lake."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import has_table, scan_table, write_partition
from .ml import Group

_POINTERS = "signal string, version string, nth long, kinds array<string>, features array<string>, about map<string,string>"


def save_group(spark: SparkSession, root: str, signal: str, version: str, group: Group, about: dict[str, str] | None = None) -> None:
    """Writes every member and its calibrator, and last the pointer; a stop before that leaves the former version in force."""
    at = f"{root}/signal={signal}/version={version}"
    for kind, (model, calibrator) in group.members.items():
        model.write().overwrite().save(f"{at}/{kind}/model")
        calibrator.write().overwrite().save(f"{at}/{kind}/calibrator")
    nth = (scan_table(spark, f"{root}/pointers", _POINTERS).agg(F.max("nth")).first()[0] or 0) + 1
    row = (signal, version, nth, list(group.members), group.features, about or {})
    spark.createDataFrame([row], _POINTERS).coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def load_group(spark: SparkSession, root: str, signal: str, version: str | None = None) -> Group:
    """The group that was saved last for the signal, or that of a version."""
    rows = scan_table(spark, f"{root}/pointers", _POINTERS).where((F.col("signal") == signal) & (F.lit(version is None) | (F.col("version") == version)))
    row = rows.orderBy(F.desc("nth")).first()
    if row is None:
        raise LookupError(f"no model of signal {signal}" + (f", version {version}" if version else ""))
    at = f"{root}/signal={signal}/version={row.version}"
    return Group(list(row.features), {k: (PipelineModel.load(f"{at}/{k}/model"), IsotonicRegressionModel.load(f"{at}/{k}/calibrator")) for k in row.kinds})


def keep_predictions(preds: DataFrame, path: str, signal: str) -> None:
    """Replaces the signal's predictions of the folds that `preds` has; other folds and signals stay."""
    write_partition(preds.withColumn("signal", F.lit(signal)), path, "signal", "fold")


def kept_predictions(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """One signal's predictions; only its folders are read, and only its own columns: signals may store different ones."""
    at = f"{path}/signal={signal}"
    if not has_table(spark, at):
        raise LookupError(f"no predictions of signal {signal}")
    return spark.read.option("basePath", at).option("mergeSchema", "true").parquet(at).withColumn("signal", F.lit(signal))
