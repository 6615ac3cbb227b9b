"""Quantile boosting, stops by validation, and groups of models that are saved and loaded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import boosting, ml
from tallyfield.operators import model_store as store


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 3001))
    y = np.where(a > 0, 3 * b, -2.0) + rng.exponential(1 + (b > 0), 3001)
    data = [(i, float(a[i]), None if i % 50 == 0 else float(b[i]), float(y[i]), bool(y[i] > 1)) for i in range(3001)]
    return spark.createDataFrame(data, "k long, a double, b double, y double, label boolean").repartition(3).cache()


def test_one_leaf_is_the_exact_quantile(rows):
    y = sorted(r.y for r in rows.select("y").collect())
    for alpha, at in ((0.5, 1500), (0.9, 2700)):
        model = boosting.fit_quantile(rows, ["a", "b"], "y", alpha, rounds=1, depth=0, rate=1.0)
        assert model.start == y[at] and model.predict(rows.limit(5)).first().quantile == pytest.approx(y[at])
        assert len(model.trees) == 1 and list(model.trees[0][1].values()) == pytest.approx([0.0])


def test_boosting_beats_a_single_tree(rows):
    train, test = rows.where("k % 3 <> 0"), rows.where("k % 3 = 0")
    model = boosting.fit_quantile(train.where("k % 10 <> 1"), ["a", "b"], "y", valid=train.where("k % 10 = 1"), rounds=12)
    assert 1 <= len(model.trees) <= 12
    both = model.predict(ml.median_gain(train, test, ["a", "b"], "y"), "boosted")
    assert both.columns == [*test.columns, "median_gain", "boosted"] and both.count() == test.count()
    loss = both.agg(*[F.avg(boosting.pinball(F.col("y"), F.col(c), 0.5)).alias(c) for c in ("median_gain", "boosted")]).first()
    assert loss.boosted < loss.median_gain
    share = both.agg(F.avg((F.col("y") <= F.col("boosted")).cast("double"))).first()[0]
    assert 0.42 < share < 0.58
    with pytest.raises(ValueError):
        boosting.fit_quantile(rows.where("false"), ["a", "b"], "y")


def test_trees_stop_by_validation(rows):
    noise = rows.withColumn("label", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(2)) == 0)
    small = boosting.fit_boosted(noise, ["a", "b"], keys=("k",), most=10, depths=(2,))
    large = boosting.fit_boosted(rows, ["a", "b"], keys=("k",), most=10, depths=(2, 3))
    trees = lambda m: m.stages[-1].getNumTrees
    assert trees(small) < trees(large)


def test_saved_groups_score_alike(spark, rows, tmp_path):
    at = str(tmp_path)
    group = ml.fit_group(rows.where("k % 2 = 0"), rows.where("k % 2 = 1"), ["a", "b"], kinds=("forest", "logistic"))
    want = {r.k: (r.p, r.p_forest) for r in group.score(rows, each=True).collect()}
    with pytest.raises(LookupError):
        store.load_group(spark, at, "A")
    store.save_group(spark, at, "A", "v1", group)
    store.save_group(spark, at, "A", "v2", ml.Group(group.features, {"logistic": group.members["logistic"]}))
    assert list(store.load_group(spark, at, "A").members) == ["logistic"]
    loaded = store.load_group(spark, at, "A", "v1")
    assert {r.k: (r.p, r.p_forest) for r in loaded.score(rows, each=True).collect()} == want


def test_predictions_are_kept_by_signal_and_fold(spark, rows, tmp_path):
    at = str(tmp_path / "preds")
    preds = rows.select("k", "label", (F.col("k") % 2).alias("fold"))
    store.keep_predictions(preds.withColumn("gain", F.col("k") * 1.0), at, "A")
    store.keep_predictions(preds, at, "C")
    store.keep_predictions(preds.where("fold = 1 and k < 100"), at, "C")  # one fold again
    assert store.kept_predictions(spark, at, "A").count() == 3001 and "gain" in store.kept_predictions(spark, at, "A").columns
    c = store.kept_predictions(spark, at, "C")
    assert "gain" not in c.columns and dict(c.groupBy("fold").count().collect()) == {0: 1501, 1: 50}
    with pytest.raises(LookupError):
        store.kept_predictions(spark, at, "B")
