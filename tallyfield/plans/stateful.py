"""Queries of the stateful streams, over the events in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lake
from ..catalog import register
from ..streaming import incremental as st
from ..streaming import stateful as sf
from .fixtures import table as t
from .signals import alerts_of

FILES = 4


def in_batches(s, d, batches: int = 5):
    """The events as a stream of `batches` micro-batches, each a span of days."""
    at, events = lake.new_folder(s), t(s, d, "events")
    first, days = events.agg(F.min("ts"), F.datediff(F.max("ts"), F.min("ts")) + 1).first()
    part = F.floor(F.datediff("ts", F.lit(first)) * batches / days)
    for i in range(batches):
        events.where(part == i).repartition(FILES).write.mode("append").parquet(at)
    return s.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(at)


def run(s, stream):
    sf.use_rocksdb(s)
    at = lake.new_folder(s)
    return st.drain(stream, f"{at}/out", f"{at}/checkpoint", "append")


def attempts(events):
    """Events as attempts at partitions of up to thirteen days before; about one in 29 succeeds."""
    day = F.date_sub(F.col("ts").cast("date"), (F.col("user_id") % 14).cast("int"))
    status = F.when(F.col("event_id") % 29 == 0, "success").otherwise("failed")
    return events.select(F.col("event_type").alias("source_id"), day.alias("partition_key"), F.col("event_id").alias("attempt_id"), "ts", status.alias("status"))


register("st3_look_back", lambda s, d: run(s, sf.look_back(attempts(in_batches(s, d)))).withColumn("at", F.col("at").cast("timestamp_ntz")), """
WITH a AS (
  SELECT event_type AS source_id, CAST(ts AS DATE) - CAST(user_id % 14 AS INT) AS partition_key, event_id, ts, event_id % 29 = 0 AS ok FROM events
), inside AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, partition_key ORDER BY ts, event_id) AS n FROM a WHERE ts < partition_key + INTERVAL 11 DAY
), done AS (
  SELECT source_id, partition_key, min(CASE WHEN ok THEN n END) AS hit, count(*) AS tries FROM inside GROUP BY 1, 2
)
SELECT d.source_id, d.partition_key, CASE WHEN hit IS NULL THEN 'expired' ELSE 'loaded' END AS outcome,
       coalesce(i.ts, CAST(d.partition_key AS TIMESTAMP) + INTERVAL 11 DAY) AS at, coalesce(hit, tries) AS tries
FROM done d LEFT JOIN inside i ON i.source_id = d.source_id AND i.partition_key = d.partition_key AND i.n = hit
WHERE hit IS NOT NULL OR d.partition_key + INTERVAL 11 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
register("st4_admission", lambda s, d: run(s, sf.admitted(alerts_of(in_batches(s, d)), 50, ("purchase",), ("login",))), """
WITH a AS (
  SELECT event_id AS alert_id, ts, event_type AS kind, concat_ws('-', event_type, CAST(user_id AS VARCHAR), CAST(CAST(ts AS DATE) AS VARCHAR)) AS k FROM events
), b AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, alert_id) = 1 AS first, date_trunc('week', ts) AS wk FROM a
), c AS (
  SELECT *, sum(CASE WHEN kind NOT IN ('login', 'purchase') AND first THEN 1 ELSE 0 END) OVER (PARTITION BY wk ORDER BY ts, alert_id ROWS UNBOUNDED PRECEDING) AS used FROM b
)
SELECT alert_id, CASE WHEN kind = 'login' THEN 'disabled' WHEN NOT first THEN 'duplicate' WHEN kind <> 'purchase' AND used > 50 THEN 'capped' ELSE 'sent' END AS verdict FROM c
""")


def warnings(events):
    return events.select(F.col("user_id").alias("company_id"), F.col("ts").cast("date").alias("trade_date"))


register("st5_spaced_warnings", lambda s, d: run(s, sf.spaced_warnings(warnings(in_batches(s, d)), 7)), """
WITH RECURSIVE w AS (
  SELECT DISTINCT user_id AS company_id, CAST(ts AS DATE) AS trade_date FROM events
), k AS (
  SELECT company_id, min(trade_date) AS trade_date FROM w GROUP BY 1
  UNION ALL SELECT k.company_id, (SELECT min(trade_date) FROM w WHERE w.company_id = k.company_id AND w.trade_date >= k.trade_date + 7) FROM k WHERE k.trade_date IS NOT NULL
)
SELECT company_id, trade_date FROM k WHERE trade_date IS NOT NULL
""")
