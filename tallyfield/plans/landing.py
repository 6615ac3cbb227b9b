"""Queries of the readers: the given tables are written as the files that a source would land, then read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lake
from ..catalog import register
from ..sources import files as fl
from . import fixtures as fx
from .sqltext import with_views

t = fx.table
DAY = lambda c: F.initcap(F.date_format(c, "dd-MMM-yyyy"))


def land(df: DataFrame, part: str, value: str = "value") -> str:
    """One text file for each row of (part, value), in a folder of its own; returns the folder."""
    at = lake.new_folder(df.sparkSession)
    df.select(F.col(value).alias("value"), part).repartition(part).write.partitionBy(part).text(at)
    return at


def page(key: str):
    """Pages of 16,384 keys: their number grows with the table, their size doesn't."""
    return F.shiftright(F.col(key).cast("long"), 14).alias("page")


def json_pages(rows: DataFrame, part: str) -> DataFrame:
    """(part, value): the other columns as one JSON array for each part, a file's worth."""
    fields = [c for c in rows.columns if c != part]
    return rows.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value"))


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column(1).to_pylist():
            body = io.BytesIO()
            with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("rows.csv", text)
            out.append(body.getvalue())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])


def zipped(rows: DataFrame, header: str, line) -> DataFrame:
    """(path, content): a zipped CSV file of each day's lines."""
    per = rows.groupBy(F.col("trade_date").cast("string").alias("path")).agg(F.concat_ws("\n", F.lit(header), F.array_join(F.collect_list(line), "\n"), F.lit("")).alias("text"))
    return per.mapInArrow(_zip, "path string, content binary")


def priced(s, d):
    return fx.bars(s, d).select("trade_date", "company_id", *[F.round(F.col(c) + 1e-9, 2).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume"))


PRICED = with_views("bars") + """SELECT trade_date, company_id AS symbol, 'EQ' AS series, round(open + 1e-9, 2) AS open, round(high + 1e-9, 2) AS high, round(low + 1e-9, 2) AS low, round(close + 1e-9, 2) AS close, CAST(volume AS BIGINT) AS volume FROM bars"""
COLUMNS = ("trade_date", "symbol", "series", "open", "high", "low", "close", "volume")


def s06(s, d):
    """Landed once, archived twice: the second time nothing is new."""
    at, manifest = lake.new_folder(s), lake.new_folder(s)
    o = t(s, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey")
    o.groupBy("year").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("value")).repartition("year").write.partitionBy("year").text(at)
    first = lake.archive_raw(s, f"{at}/year=*", manifest, "orders")
    again = lake.archive_raw(s, f"{at}/year=*", manifest, "orders")
    count = lambda df, n: df.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("call", F.lit(n).cast("long"))
    return count(first, 1).unionByName(count(again, 2))


register("s06_archive_raw", s06, """WITH y AS (SELECT year(o_orderdate) AS y, length(string_agg(CAST(o_orderkey AS VARCHAR), ',')) + 1 AS n FROM orders GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS call, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM y UNION ALL SELECT 2, 0, 0""")
NEW = "TradDt,BizDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol"
register("s07_read_udiff", lambda s, d: fl.udiff_rows(zipped(priced(s, d), NEW, F.concat_ws(",", "trade_date", "trade_date", "company_id", F.lit(" EQ "), "open", "high", "low", "close", "volume")), NEW).select(*COLUMNS), PRICED)
OLD = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,TOTTRDQTY,TIMESTAMP"
register("s08_read_legacy", lambda s, d: fl.legacy_rows(zipped(priced(s, d), OLD, F.concat_ws(",", "company_id", F.lit("EQ"), "open", "high", "low", "close", "volume", F.upper(F.date_format("trade_date", "dd-MMM-yyyy")))), OLD).select(*COLUMNS), PRICED)


def s09(s, d):
    m = fx.bars(s, d).groupBy(F.trunc("trade_date", "month").alias("month"), "company_id").agg(F.sum("volume").cast("long").alias("q"))
    line = F.concat_ws(",", F.lit("20"), F.lit("1"), "company_id", F.lit("EQ"), "q", F.floor(F.col("q") / 2), F.lit("50.5"))
    text = m.groupBy("month").agg(F.concat(F.lit("Security Wise Delivery\nTrade Date <"), DAY(F.first("month")), F.lit(">\nRecord Type,Sr No\n"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    return fl.read_delivery(s, land(text, "month"))


register("s09_read_delivery", s09, with_views("bars") + "SELECT CAST(date_trunc('month', trade_date) AS DATE) AS trade_date, company_id AS symbol, 'EQ' AS series, CAST(sum(volume) AS BIGINT) AS qty_traded, CAST(floor(CAST(sum(volume) AS BIGINT) / 2) AS BIGINT) AS deliverable_qty, 50.5 AS delivery_pct FROM bars GROUP BY 1, 2")


def s10(s, d):
    at = lake.new_folder(s)
    value = lambda c: F.coalesce(F.round(F.col(c) + 1e-9, 2).cast("string"), F.lit("-"))
    b = fx.bars(s, d).groupBy("company_id").agg(*[F.min_by(c, "trade_date").alias(c) for c in ("open", "high", "close")]).withColumn("low", F.lit(None).cast("double"))
    rows = b.select(F.col("company_id").alias("Index Name"), F.lit("03-04-2024").alias("Index Date"), value("open").alias("Open Index Value"), value("high").alias("High Index Value"), value("low").alias("Low Index Value"), value("close").alias("Closing Index Value"))
    rows.union(rows).write.option("header", "true").csv(at)
    return fl.read_index(s, at, "2024-03-04")


register("s10_read_index", s10, with_views("bars") + "SELECT company_id AS index_name, DATE '2024-03-04' AS trade_date, round(min_by(open, trade_date) + 1e-9, 2) AS open, round(min_by(high, trade_date) + 1e-9, 2) AS high, CAST(NULL AS DOUBLE) AS low, round(min_by(close, trade_date) + 1e-9, 2) AS close FROM bars GROUP BY 1")


def s11(s, d):
    a = fx.action_text(s, d).select(page("p_partkey"), F.col("company_id").alias("symbol"), F.lit("EQ").alias("series"), F.col("p_partkey").cast("string").alias("isin"), F.lit("Co").alias("comp"), F.lit("10").alias("faceVal"), "subject", DAY(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int"))).alias("exDate"), F.lit("-").alias("recDate"))
    return fl.read_actions(s, land(json_pages(a, "page"), "page"))


register("s11_read_actions", s11, with_views("action_text") + "SELECT company_id AS symbol, 'EQ' AS series, CAST(p_partkey AS VARCHAR) AS isin, 'Co' AS company, CAST(10 AS DOUBLE) AS face_value, subject, DATE '1996-01-01' + CAST(p_partkey % 900 AS INT) AS ex_date, CAST(NULL AS DATE) AS record_date FROM action_text")


def s12(s, d):
    at = lake.new_folder(s)
    fx.symbol_changes(s, d).select(F.concat_ws(",", F.concat(F.lit("Old, new and "), "old_symbol"), "old_symbol", F.concat(F.lit(" "), "new_symbol"), DAY("change_date")).alias("value")).write.text(at)
    return fl.read_symbol_changes(s, at)


register("s12_read_symbol_changes", s12, with_views("symbol_changes") + "SELECT concat('Old, new and ', old_symbol) AS company, old_symbol, new_symbol, change_date FROM symbol_changes")


def s13(s, d):
    at = lake.new_folder(s)
    rows = t(s, d, "part").select(F.col("p_partkey").cast("string").alias("SYMBOL"), F.concat(F.lit("Société "), "p_brand").alias(" NAME OF COMPANY"), F.col("p_type").alias(" SERIES"))
    rows.write.option("header", "true").option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", "false").csv(at)
    return fl.read_latin_csv(s, at)


register("s13_read_latin_csv", s13, "SELECT CAST(p_partkey AS VARCHAR) AS symbol, concat('Société ', p_brand) AS name_of_company, trim(p_type) AS series FROM part")


def s14(s, d):
    m = fx.meetings(s, d).select(F.shiftright(F.monotonically_increasing_id(), 14).alias("page"), F.col("company_id").alias("bm_symbol"), DAY("meeting_date").alias("bm_date"), F.when(F.col("is_results"), "Quarterly Results").otherwise("Fund raising").alias("bm_purpose"), F.date_format("announced_at", "dd-MMM-yyyy HH:mm:ss").alias("bm_timestamp"))
    return fl.read_board_meetings(s, land(json_pages(m, "page"), "page"))


register("s14_read_board_meetings", s14, with_views("meetings") + "SELECT company_id AS symbol, meeting_date, CAST(announced_at AS TIMESTAMP) AS announced_at, is_results FROM meetings")
FILED = "SELECT company_id AS symbol, period_to, published_at, CAST(filing_id AS VARCHAR) AS xbrl_url{more} FROM filings"


def s15(s, d):
    f = fx.filings(s, d).select(page("filing_id"), F.col("company_id").alias("symbol"), F.lit("I").alias("isin"), DAY("period_to").alias("toDate"), F.when(F.col("consolidated"), "Consolidated").otherwise("Non-Consolidated").alias("consolidated"), F.date_format("published_at", "dd-MMM-yyyy HH:mm:ss").alias("broadCastDate"), F.col("filing_id").cast("string").alias("xbrl"))
    return fl.read_results_filings(s, land(json_pages(f, "page"), "page"))


register("s15_read_results_filings", s15, with_views("filings") + FILED.format(more=", 'I' AS isin, consolidated"))


def s16(s, d):
    f = fx.filings(s, d).select(page("filing_id"), F.struct(F.col("company_id").alias("symbol"), DAY("period_to").alias("qe_Date"), F.date_format("published_at", "dd-MMM-yyyy HH:mm:ss").alias("broadcast_Date"), F.col("filing_id").cast("string").alias("xbrl")).alias("x"))
    pages = f.groupBy("page").agg(F.to_json(F.struct(F.collect_list("x").alias("data"), F.count("*").alias("totalCount"))).alias("value"))
    return fl.read_integrated_filings(s, land(pages, "page"))


register("s16_read_integrated_filings", s16, with_views("filings") + FILED.format(more=""))


def s17(s, d):
    days = t(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().where(F.dayofmonth("day") == 26)
    year = days.groupBy(F.year("day").alias("year")).agg(F.to_json(F.struct(F.collect_list(F.struct(DAY("day").alias("tradingDate"), F.date_format("day", "EEE").alias("description"))).alias("CM"))).alias("value"))
    return fl.read_holidays(s, land(year, "year"))


register("s17_read_holidays", s17, "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%a') AS name FROM orders WHERE day(o_orderdate) = 26")


def s18(s, d):
    at = lake.new_folder(s)
    rows = t(s, d, "part").select(F.concat("p_brand", F.lit("-EQ")).alias("Trading Symbol"), F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.format_number(F.col("p_partkey") * 1000, 0)).alias("Net Qty."), F.concat(F.lit("₹"), F.col("p_size").cast("string"), F.lit(".5")).alias("Buy Average"), F.lit("in1").alias("ISIN"))
    rows.write.option("header", "true").csv(at)
    good, bad = fl.read_broker_holdings(s, at)
    return good.select("symbol", "quantity", "price", "isin").unionByName(bad.select(F.lit("rejected").alias("symbol"), F.lit(None).cast("long").alias("quantity"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("isin")))


register("s18_read_broker_holdings", s18, "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'rejected' ELSE upper(p_brand) END AS symbol, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 1000 END AS quantity, CASE WHEN p_partkey % 5 <> 0 THEN p_size + CAST(0.5 AS DOUBLE) END AS price, CASE WHEN p_partkey % 5 <> 0 THEN 'IN1' END AS isin FROM part")


def s19(s, d):
    """A filing of each order's total: of three kinds by status, with a quarter, with the year alone, or with undeclared contexts."""
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus", F.last_day(F.date_trunc("quarter", "o_orderdate") + F.expr("interval 2 months")).alias("period_to"), F.round("o_totalprice", 0).cast("long").cast("string").alias("x"))
    context = lambda a: F.concat(F.lit("<context id='c'><period><startDate>"), a.cast("string"), F.lit("</startDate><endDate>"), F.col("period_to").cast("string"), F.lit("</endDate></period></context>"))
    fact = lambda ref: F.concat(F.lit(f"<Later contextRef='{ref}'>1</Later><Sales contextRef='{ref}'>"), F.col("x"), F.lit("</Sales>"))
    loose = F.concat(F.lit("<DateOfEndOfReportingPeriod contextRef='OneD'>"), F.col("period_to").cast("string"), F.lit("</DateOfEndOfReportingPeriod>"))
    body = F.when(F.col("o_orderstatus") == "O", F.concat(context(F.date_add(F.col("period_to"), -90)), fact("c"))).when(F.col("o_orderstatus") == "F", F.concat(context(F.date_add(F.col("period_to"), -364)), fact("c"))).otherwise(F.concat(loose, fact("OneD")))
    made = o.select(F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("<x>"), body, F.lit("</x>")).cast("binary").alias("content"), "period_to")
    return fl.filing_facts(made, {"revenue": ["Income", "Sales", "Later"]})


register("s19_filing_facts", s19, "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'revenue' AS field, round(o_totalprice, 0) AS value, 'Sales' AS tag FROM orders WHERE o_orderstatus <> 'F'")
