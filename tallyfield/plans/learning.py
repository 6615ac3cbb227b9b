"""Queries of the model and streaming operators and of the lake's writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lake
from ..catalog import register
from ..operators import boosting, ml
from ..operators import features as ft
from ..operators import model_store as store
from ..streaming import incremental as st
from . import fixtures as fx
from .sqltext import with_views
from .windows import features

KEYS = ["company_id", "trade_date"]
BEFORE, AFTER = "trade_date < '1998-01-01'", "trade_date >= '1998-01-01'"
NAMES = ["ret_5", "ret_20", "vol_20", "sma_gap_20"]


folder = lake.new_folder


def samples(s, d):
    f = features(s, d).select("company_id", "segment", "trade_date", *NAMES)
    f = f.join(ft.weekly_dates(f).select("trade_date"), "trade_date", "left_semi")
    out = f.join(ft.compute_labels(fx.panel(s, d)).select("company_id", "segment", "trade_date", "label_a", "max_gain_5"), ["company_id", "segment", "trade_date"])
    at = folder(s)
    out.withColumnRenamed("label_a", "label").where("label is not null and ret_20 is not null").write.parquet(at)
    return s.read.parquet(at)


def folds(s, days):
    """All quarters of the samples' days from the one on in which a year and a half of history lies behind it."""
    first, last = days.agg(F.date_add(F.min("trade_date"), 548), F.max("trade_date")).first()
    return ml.make_folds(s, str(first), str(last))


QUARTERS = """, q AS (
  SELECT DISTINCT CAST(date_trunc('quarter', x) AS DATE) AS x
  FROM (SELECT unnest(generate_series(date_trunc('quarter', min(trade_date) + 548), CAST(max(trade_date) AS TIMESTAMP), INTERVAL 3 MONTH)) AS x FROM scored) z),
f AS (SELECT row_number() OVER (ORDER BY x) AS fold, x FROM q)
"""
Q = "SELECT CAST(x AS DATE) AS test_from, CAST(x + INTERVAL 3 MONTH AS DATE) - 1 AS test_to, CAST(x - INTERVAL 12 MONTH AS DATE) AS calib_from, CAST(x AS DATE) - 14 AS calib_to, CAST(x - INTERVAL 12 MONTH AS DATE) - 14 AS train_to FROM (SELECT DISTINCT date_trunc('quarter', trade_date) AS x FROM market) q"
register("m01_make_folds", lambda s, d: fx.market(s, d).agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select(F.explode(F.sequence(F.trunc("a", "quarter"), F.trunc("b", "quarter"), F.expr("interval 3 months"))).alias("q")).join(ml.make_folds(s, "1990-01-01", "2010-12-31").drop("fold"), F.col("q") == F.col("test_from")).select("test_from", "test_to", "calib_from", "calib_to", "train_to"), with_views("market") + Q)
register("m02_assign_folds", lambda s, d: ml.assign_folds((x := fx.scored(s, d).select("row_id", "trade_date")), folds(s, x)).groupBy("fold", "role").count().withColumnRenamed("count", "n"), with_views("scored") + QUARTERS + """, r AS (
  SELECT fold, CASE WHEN trade_date < CAST(x - INTERVAL 12 MONTH AS DATE) - 14 THEN 'train' WHEN trade_date >= CAST(x - INTERVAL 12 MONTH AS DATE) AND trade_date < x - 14 THEN 'calib'
         WHEN trade_date BETWEEN x AND CAST(x + INTERVAL 3 MONTH AS DATE) - 1 THEN 'test' END AS role
  FROM scored, f WHERE trade_date <= CAST(x + INTERVAL 3 MONTH AS DATE) - 1)
SELECT fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2""")


def classified(kind):
    def run(s, d):
        x = samples(s, d)
        model = ml.fit_classifier(x.where("trade_date < '1998-01-01'"), NAMES, kind=kind)
        return ml.scores(model, x.where("trade_date >= '1998-01-01'")).select(*KEYS, F.round("raw_p", 4).alias("p"))

    return run


def m04(s, d):
    x = samples(s, d)
    model = ml.fit_classifier(x.where("trade_date < '1997-01-01'"), NAMES, kind="logistic")
    return ml.calibrated(model, ml.fit_calibrator(model, x.where("trade_date between '1997-01-01' and '1997-12-31'")), x.where("trade_date >= '1998-01-01'")).select(*KEYS, F.round("p", 4).alias("p"))


def m05(s, d):
    x = samples(s, d)
    return ml.median_gain(x.where("trade_date < '1998-01-01'"), x.where("trade_date >= '1998-01-01'"), NAMES, "max_gain_5").select(*KEYS, F.round("median_gain", 4).alias("median_gain"))


def m24(s, d):
    return ml.feature_importance(ml.fit_classifier(samples(s, d), NAMES, kind="gbt"), NAMES, s)


def m25(s, d):
    x = samples(s, d)
    return ml.contributions(ml.fit_classifier(x, NAMES, kind="logistic"), x, NAMES).select(*KEYS, *[F.round(f"c_{n}", 4).alias(f"c_{n}") for n in NAMES])


def m03(s, d):
    """Trees and depth by validation."""
    x = samples(s, d)
    return ml.scores(boosting.fit_boosted(x.where(BEFORE), NAMES), x.where(AFTER)).select(*KEYS, F.round("raw_p", 4).alias("p"))


def both_medians(s, d):
    """The held-out rows with the single tree's median and the boosted one, for which a tenth of the training rows decides on the rounds."""
    x = samples(s, d)
    train, held = x.where(BEFORE), boosting.held_back(KEYS, 10)
    model = boosting.fit_quantile(train.where(~held), NAMES, "max_gain_5", valid=train.where(held))
    return model.predict(ml.median_gain(train, x.where(AFTER), NAMES, "max_gain_5"), "boosted")


def m05_losses(s, d):
    """Mean pinball loss of either for each held-out quarter."""
    y, half = F.col("max_gain_5"), 0.5
    rows = both_medians(s, d).where("max_gain_5 is not null").groupBy(F.trunc("trade_date", "quarter").alias("quarter"))
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(boosting.pinball(y, F.col(c), half)), 6).alias(f"loss_{c}") for c in ("median_gain", "boosted")])


register("m03_boosted_trees", m03)
register("m04_isotonic", m04)
register("m05_median_gain", m05)
register("m05_quantile_boost", lambda s, d: both_medians(s, d).select(*KEYS, F.round("boosted", 4).alias("median_gain")))
register("m05_pinball_losses", m05_losses)
register("m06_walk_forward", lambda s, d: ml.walk_forward((x := samples(s, d)), folds(s, x), NAMES, kinds=("logistic",)).select(*KEYS, "fold", F.round("p", 4).alias("p")))


# baselines of the scored orders: volatility and momentum as percentile ranks within a date
def ranked(s, d):
    return fx.scored(s, d).select("row_id", "trade_date", "label", F.col("p").alias("vol_20"), F.col("expected_gain").alias("ret_20"))


RANKED = with_views("scored") + """, z AS (
  SELECT row_id, trade_date, label,
         (rank() OVER (PARTITION BY trade_date ORDER BY p) + (count(*) OVER (PARTITION BY trade_date, p) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) AS volatility,
         (rank() OVER (PARTITION BY trade_date ORDER BY expected_gain) + (count(*) OVER (PARTITION BY trade_date, expected_gain) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) AS momentum
  FROM scored)
"""
register("m07_baselines", lambda s, d: ml.baselines(ranked(s, d)).select("row_id", *[F.round(n, 6).alias(n) for n in ("base_rate", "volatility", "momentum")]), RANKED + "SELECT row_id, round((SELECT avg(CAST(label AS DOUBLE)) FROM scored), 6) AS base_rate, round(volatility, 6) AS volatility, round(momentum, 6) AS momentum FROM z")
BEATEN = RANKED + """, l AS (SELECT 'volatility' AS score, row_id, trade_date, label, volatility AS p FROM z UNION ALL SELECT 'momentum', row_id, trade_date, label, momentum FROM z),
a AS (SELECT score, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS auc
  FROM (SELECT score, CAST(label AS INT) AS y, rank() OVER (PARTITION BY score ORDER BY p) + (count(*) OVER (PARTITION BY score, p) - 1) / 2.0 AS r FROM l) x GROUP BY 1),
k AS (SELECT score, p, count(*) AS n, count(*) FILTER (WHERE label) AS h FROM l GROUP BY 1, 2),
ap AS (SELECT score, sum(pr * h) / sum(h) AS avg_precision FROM (SELECT score, h, sum(h) OVER w / sum(n) OVER w AS pr FROM k WINDOW w AS (PARTITION BY score ORDER BY p DESC)) y GROUP BY 1),
t5 AS (SELECT score, avg(CAST(label AS DOUBLE)) AS top5_precision FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY score, trade_date ORDER BY p DESC, row_id) <= 5) y GROUP BY 1)
SELECT score, round(auc, 4) AS auc, round(avg_precision, 4) AS avg_precision, round(top5_precision, 4) AS top5_precision FROM a JOIN ap USING (score) JOIN t5 USING (score)
UNION ALL SELECT 'base_rate', 0.5, round(avg(CAST(label AS DOUBLE)), 4), round(avg(CAST(label AS DOUBLE)), 4) FROM scored"""
register("m07_baseline_summary", lambda s, d: ml.summarize(ml.baselines(ranked(s, d)), ["volatility", "momentum"]), BEATEN)


def m07(s, d):
    """The walk-forward model next to all baselines, with a logistic regression fitted in every fold."""
    x = samples(s, d).withColumn("row_id", F.xxhash64(*KEYS))
    f = folds(s, x)
    group = ml.walk_forward(x, f, NAMES, kinds=("forest",))
    logistic = ml.walk_forward(x, f, NAMES, kinds=("logistic",), calibrate=False).select("row_id", "fold", F.col("p").alias("logistic"))
    return ml.summarize(ml.baselines(group.join(logistic, ["row_id", "fold"])), ["p", "volatility", "momentum", "logistic"])


register("m07_walk_forward_summary", m07)


def m08(s, d):
    x = samples(s, d)
    return ml.walk_forward(x, folds(s, x), NAMES, kinds=ml.MEMBERS).select(*KEYS, "fold", F.round("p", 4).alias("p"))


def by_signal(s, d):
    """Walk-forward predictions of a signal for each label, kept by signal and fold, and read back."""
    at, x = folder(s), samples(s, d).withColumn("label_c", F.col("max_gain_5") < 0.02)
    f = folds(s, x)
    for signal, label in (("A", "label"), ("C", "label_c")):
        preds = ml.walk_forward(x, f, NAMES, label, kinds=("logistic",))
        store.keep_predictions(preds.select(*KEYS, F.col(label).alias("label"), "p", "fold", *(["max_gain_5"] if signal == "A" else [])), at, signal)
    kept = [store.kept_predictions(s, at, signal) for signal in ("A", "C")]
    return kept[0].unionByName(kept[1], allowMissingColumns=True).select("signal", F.col("fold").cast("long").alias("fold"), *KEYS, "label", F.round("p", 4).alias("p"))


register("m06_predictions_by_signal", by_signal)


def final_group(s, d):
    """(group fitted on all but the last year and calibrated on that, rows of the latest week)."""
    x = samples(s, d)
    cut = x.agg(F.add_months(F.max("trade_date"), -12)).first()[0]
    last = x.join(F.broadcast(x.agg(F.max("trade_date").alias("trade_date"))), "trade_date", "left_semi")  # one row
    return ml.fit_group(x.where(F.col("trade_date") < F.date_sub(F.lit(cut), 14)), x.where(F.col("trade_date") >= F.lit(cut)), NAMES), last


def m21(s, d):
    """All five members are fitted, saved as a version, loaded again, and score the latest week."""
    group, last = final_group(s, d)
    at = folder(s)
    store.save_group(s, at, "A", "v1", group, {"label": "label"})
    return store.load_group(s, at, "A").score(last).select(*KEYS, F.round("p", 4).alias("p"), F.lit("v1").alias("version"))


register("m08_model_group", m08)
register("m20_leakage", lambda s, d: ml.holdout_auc((x := samples(s, d)), NAMES, "1998-01-01").withColumn("kind", F.lit("holdout")).unionByName(ml.holdout_auc(x, NAMES, "1998-01-01", shuffle=True).withColumn("kind", F.lit("shuffled"))))
register("m21_train_and_score_latest", m21)
register("m24_feature_importance", m24)
register("m25_contributions", m25)


# streams over the event table
def stream(s, d):
    return st.source(s, f"{d}/events.parquet")


def as_attempts(x):
    n = F.col("user_id") % 4
    return x.select(F.col("event_id").alias("job_run_id"), F.col("event_type").alias("source_id"), F.col("ts").cast("date").alias("partition_key"), F.when(n == 0, "success").otherwise("failed").alias("status"))


def run_stream(s, made, mode="complete"):
    at = folder(s)
    return st.drain(made, f"{at}/out", f"{at}/checkpoint", mode)


def st1(s, d):
    at = folder(s)
    st.land_partitions(as_attempts(stream(s, d)), f"{at}/table", f"{at}/checkpoint", "partition_key")
    return s.read.parquet(f"{at}/table").groupBy("partition_key").count().withColumnRenamed("count", "n")


register("st1_idempotent_landing", st1, "SELECT CAST(ts AS DATE) AS partition_key, count(*) AS n FROM events GROUP BY 1")
register("st2_last_good_key", lambda s, d: run_stream(s, st.last_good_keys(as_attempts(stream(s, d)))), "SELECT event_type AS source_id, max(CAST(ts AS DATE)) AS last_good FROM events WHERE user_id % 4 = 0 GROUP BY 1")
register("st3_late_tolerant_counts", lambda s, d: run_stream(s, st.late_tolerant(stream(s, d)).groupBy("user_id").agg(F.count("*").alias("n"))), "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
keyed = lambda s, d: stream(s, d).select("ts", F.col("event_type").alias("kind"), F.concat_ws("-", "event_type", "user_id").alias("dedupe_key"))
register("st4_deduplicated_alerts", lambda s, d: run_stream(s, st.deduplicated_alerts(keyed(s, d), "60 days"), "append").select("dedupe_key"), "SELECT DISTINCT concat_ws('-', event_type, CAST(user_id AS VARCHAR)) AS dedupe_key FROM events")
register("st4_weekly_counts", lambda s, d: run_stream(s, st.weekly_counts(keyed(s, d))).select(F.col("week").cast("date").alias("week"), "kind", "n"), "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
register("st6_exit_watch", lambda s, d: run_stream(s, st.exit_watch(stream(s, d).select(F.col("user_id").alias("company_id"), "event_id", F.col("value").alias("close")), fx.table(s, d, "customer").select(F.col("c_custkey").alias("company_id"), F.lit(50.0).alias("cost"))).select("event_id", "rule"), "append"), "SELECT event_id, CASE WHEN value >= 50.0 * (1 + CAST(0.1 AS DOUBLE)) THEN 'target' ELSE 'stop' END AS rule FROM events JOIN customer ON c_custkey = user_id WHERE value >= 50.0 * (1 + CAST(0.1 AS DOUBLE)) OR value <= 50.0 * (1 - CAST(0.1 AS DOUBLE))")
register("st7_first_publications", lambda s, d: run_stream(s, st.first_publications(stream(s, d).select(F.col("event_type").alias("company_id"), F.col("user_id").alias("period_to"), F.col("ts").alias("published_at")))), "SELECT event_type AS company_id, user_id AS period_to, min(ts) AS published_at FROM events GROUP BY 1, 2")
register("st8_daily_bars", lambda s, d: run_stream(s, st.daily_bars(stream(s, d))), "SELECT CAST(ts AS DATE) AS day, event_type, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")


# the lake's writers and readers, over the driver's tables
def s03(s, d):
    at = folder(s)
    o = fx.table(s, d, "orders").withColumn("year", F.year("o_orderdate"))
    lake.write_partition(o, at, "year")
    lake.write_partition(o.where("year = 1996").limit(10), at, "year")  # a rerun replaces that partition only
    return lake.scan_table(s, at).groupBy(F.col("year").cast("long").alias("year")).count().withColumnRenamed("count", "n")


register("s03_write_partition", s03, "SELECT year(o_orderdate) AS year, CASE WHEN year(o_orderdate) = 1996 THEN 10 ELSE count(*) END AS n FROM orders GROUP BY year(o_orderdate)")


def s04(s, d):
    at = folder(s)
    lake.write_by_year(fx.bars(s, d), at)
    return lake.scan_table(s, at).groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


register("s04_write_by_year", s04, with_views("bars") + "SELECT year(trade_date) AS year, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY 1")


def s05(s, d):
    at = folder(s)
    lake.write_partition(fx.factors(s, d).withColumn("built", F.when(F.col("price_factor") == 0.5, "2024-01-01").otherwise("2024-01-02")), at, "built")
    return lake.latest_snapshot(s, at).select("company_id", "ex_date", "price_factor")


register("s05_latest_snapshot", s05, with_views("factors") + "SELECT company_id, ex_date, price_factor FROM factors WHERE price_factor <> 0.5")
register("s01_scan_table", lambda s, d: lake.scan_table(s, f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders")
register("s02_missing_table", lambda s, d: lake.scan_table(s, f"{folder(s)}/none", "k long").unionByName(fx.table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))), "SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders")
PRICES = lambda s, d, column: fx.bars(s, d).select(*KEYS, F.col(column).alias("price"))
register("s20_stitch_sources", lambda s, d: lake.stitch_sources(PRICES(s, d, "open"), PRICES(s, d, "close"), "1997-06-01"), with_views("bars") + """
SELECT company_id, trade_date, CASE WHEN trade_date < DATE '1997-06-01' THEN open ELSE close END AS price, CASE WHEN trade_date < DATE '1997-06-01' THEN 'old' ELSE 'new' END AS source FROM bars""")
register("s21_lineage", lambda s, d: lake.add_lineage(fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "f1", "00", "1").drop("_ingested_at"), "SELECT l_orderkey, l_linenumber, 'f1' AS _source_file_id, '00' AS _sha256, '1' AS _pipeline_version FROM lineitem")
register("s22_fingerprint_header", lambda s, d: fx.table(s, d, "part").select("p_partkey", lake.fingerprint_header(F.concat_ws(" , ", "p_brand", "p_type")).alias("mark")), "SELECT p_partkey, substr(sha256(concat_ws(',', trim(p_brand), trim(p_type))), 1, 16) AS mark FROM part")


def s23(s, d):
    at = folder(s)
    lake.report_table(fx.market(s, d).select(F.col("trade_date").cast("string").alias("day"), F.round("nifty500", 6).alias("level")), at)
    return s.read.schema("day string, level double").json(at)


register("s23_report_json", s23, with_views("market") + "SELECT CAST(trade_date AS VARCHAR) AS day, round(nifty500, 6) AS level FROM market")
