"""Landed files to typed tables: zipped and plain CSV, preamble text, JSON and XML filings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zipped_lines(files: DataFrame) -> DataFrame:
    """(path, n, line) of the text members of ZIP files (path, content), one file at a time."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        lines = z.read(name).decode("utf-8-sig").splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array([where] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["path", "n", "line"])

    return files.select("path", "content").mapInArrow(unzip, "path string, n long, line string")


def typed_csv(lines: DataFrame, header: str, types: dict[str, tuple[str, str]]) -> DataFrame:
    """Strictly typed columns of CSV lines under a known header; {column: (new name, type)}; bad values raise."""
    names = [c.strip() for c in header.split(",")]
    schema = ", ".join(f"`{c}` string" for c in names)
    parsed = lines.where("n > 0 and length(trim(line)) > 0").select("path", F.from_csv("line", schema).alias("r"))
    return parsed.select("path", *[F.trim(F.col(f"r.`{c}`")).cast(t).alias(n) for c, (n, t) in types.items()])


# Fixed columns of the two price layouts that are kept, with their new names and types.
UDIFF = {"TradDt": ("trade_date", "date"), "TckrSymb": ("symbol", "string"), "SctySrs": ("series", "string"), "ISIN": ("isin", "string"), "OpnPric": ("open", "double"), "HghPric": ("high", "double"), "LwPric": ("low", "double"), "ClsPric": ("close", "double"), "PrvsClsgPric": ("prev_close", "double"), "TtlTradgVol": ("volume", "long"), "TtlTrfVal": ("value_inr", "double")}
LEGACY = {"SYMBOL": ("symbol", "string"), "SERIES": ("series", "string"), "ISIN": ("isin", "string"), "OPEN": ("open", "double"), "HIGH": ("high", "double"), "LOW": ("low", "double"), "CLOSE": ("close", "double"), "PREVCLOSE": ("prev_close", "double"), "TOTTRDQTY": ("volume", "long"), "TOTTRDVAL": ("value_inr", "double"), "TIMESTAMP": ("day", "string")}


def udiff_rows(files: DataFrame, header: str) -> DataFrame:
    return typed_csv(zipped_lines(files), header, {c: t for c, t in UDIFF.items() if c in header.split(",")})


def read_udiff(spark: SparkSession, path: str, header: str) -> DataFrame:
    return udiff_rows(binary_files(spark, path), header)


def legacy_rows(files: DataFrame, header: str) -> DataFrame:
    """The old layout; two-digit years have nine characters."""
    out = typed_csv(zipped_lines(files), header, {c: t for c, t in LEGACY.items() if c in header.split(",")})
    day = F.when(F.length("day") == 9, F.to_date("day", "d-MMM-yy")).otherwise(F.to_date("day", "d-MMM-yyyy"))
    return out.withColumn("trade_date", day).drop("day")


def read_legacy(spark: SparkSession, path: str, header: str) -> DataFrame:
    return legacy_rows(binary_files(spark, path), header)


def read_delivery(spark: SparkSession, path: str) -> DataFrame:
    """Text with a preamble naming the day; records start with 20 and have seven fields."""
    text = spark.read.text(path, wholetext=True)
    day = F.to_date(F.regexp_extract("value", r"(\d{2}-\w{3}-\d{4})", 1), "dd-MMM-yyyy")
    rows = text.select(day.alias("trade_date"), F.explode(F.split("value", r"\r?\n")).alias("line")).where(F.col("line").startswith("20,"))
    f = F.split("line", ",")
    whole = F.assert_true(F.size(f) == 7, F.lit("a record does not have seven fields"))
    return rows.where(whole.isNull()).select("trade_date", f[2].alias("symbol"), f[3].alias("series"), f[4].cast("long").alias("qty_traded"), f[5].cast("long").alias("deliverable_qty"), f[6].cast("double").alias("delivery_pct"))


def read_index(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """Index closes; a dash is null; dates are day-first unless only month-first gives the wanted day."""
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    value = lambda c: F.when(F.trim(c) != "-", F.trim(c)).cast("double")
    first, second = (F.expr(f"try_to_date(`Index Date`, '{p}')") for p in ("dd-MM-yyyy", "MM-dd-yyyy"))
    goal = F.lit(wanted).cast("date")
    day = F.when(first.eqNullSafe(goal) | ~F.coalesce(second.eqNullSafe(goal), F.lit(False)), first).otherwise(second)
    return raw.select(F.col("Index Name").alias("index_name"), day.alias("trade_date"), *[value(F.col(c)).alias(n) for c, n in (("Open Index Value", "open"), ("High Index Value", "high"), ("Low Index Value", "low"), ("Closing Index Value", "close"))]).distinct()


def _date(c: str):
    return F.expr(f"try_to_date(nullif(nullif(trim({c}), '-'), ''), 'dd-MMM-yyyy')")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", "true").schema("symbol string, series string, isin string, comp string, faceVal string, subject string, exDate string, recDate string").json(path)
    return raw.select("symbol", "series", "isin", F.col("comp").alias("company"), F.expr("try_cast(faceVal as double)").alias("face_value"), "subject", _date("exDate").alias("ex_date"), _date("recDate").alias("record_date"))


def read_symbol_changes(spark: SparkSession, path: str) -> DataFrame:
    """Names may contain commas, so the last three fields are split off from the right."""
    p = r"^(.*),([^,]*),([^,]*),([^,]*)$"
    part = lambda i: F.trim(F.regexp_extract("value", p, i))
    return spark.read.text(path).where(F.col("value").rlike(p)).select(part(1).alias("company"), part(2).alias("old_symbol"), part(3).alias("new_symbol"), F.expr(rf"try_to_date(trim(regexp_extract(value, '{p}', 4)), 'dd-MMM-yyyy')").alias("change_date"))


def read_latin_csv(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot list in ISO 8859-1 with padded header names."""
    raw = spark.read.option("header", "true").option("encoding", "ISO-8859-1").csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().lower().replace(" ", "_")) for c in raw.columns])


def read_board_meetings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", "true").schema("bm_symbol string, bm_date string, bm_purpose string, bm_timestamp string").json(path)
    at = F.expr("try_to_timestamp(bm_timestamp, 'dd-MMM-yyyy HH:mm:ss')").cast("timestamp_ntz")
    return raw.select(F.col("bm_symbol").alias("symbol"), _date("bm_date").alias("meeting_date"), at.alias("announced_at"), F.col("bm_purpose").rlike("(?i)result").alias("is_results"))


def read_results_filings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", "true").schema("symbol string, isin string, toDate string, consolidated string, broadCastDate string, xbrl string").json(path)
    at = F.expr("try_to_timestamp(broadCastDate, 'dd-MMM-yyyy HH:mm:ss')").cast("timestamp_ntz")
    return raw.select("symbol", "isin", _date("toDate").alias("period_to"), (F.col("consolidated") == "Consolidated").alias("consolidated"), at.alias("published_at"), F.col("xbrl").alias("xbrl_url"))


def read_integrated_filings(spark: SparkSession, path: str) -> DataFrame:
    """Pages of {data, totalCount}; a page that is shorter than it says raises."""
    raw = spark.read.option("multiLine", "true").schema("data array<struct<symbol:string,qe_Date:string,broadcast_Date:string,xbrl:string>>, totalCount long").json(path)
    whole = F.assert_true(F.size("data") == F.col("totalCount"), F.lit("a page is short"))
    return raw.where(whole.isNull()).select(F.explode("data").alias("x")).select("x.symbol", _date("x.qe_Date").alias("period_to"), F.expr("try_to_timestamp(x.broadcast_Date, 'dd-MMM-yyyy HH:mm:ss')").cast("timestamp_ntz").alias("published_at"), F.col("x.xbrl").alias("xbrl_url"))


def read_holidays(spark: SparkSession, path: str, segment: str = "CM") -> DataFrame:
    raw = spark.read.option("multiLine", "true").schema(f"{segment} array<struct<tradingDate:string,description:string>>").json(path)
    return raw.select(F.explode(segment).alias("h")).select(_date("h.tradingDate").alias("day"), F.col("h.description").alias("name"))


# Fixed aliases of the columns of broker files, as they read without dots and other marks.
ALIASES = {
    "symbol": ("instrument", "symbol", "tradingsymbol", "trading symbol", "scrip"),
    "quantity": ("qty", "quantity", "quantity available", "qty available", "net qty"),
    "price": ("avg cost", "average cost", "average price", "avg price", "buy average"),
    "isin": ("isin",),
}
REQUIRED = ("symbol", "quantity", "price")


def read_broker_holdings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a holdings file of unknown layout; a missing required or an ambiguous column raises."""
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    plain = {c: "".join(x for x in c.lower() if x.isascii() and (x.isalpha() or x == " ")).strip() for c in raw.columns}
    found = {}
    for field, names in ALIASES.items():
        hits = [c for c in raw.columns if plain[c] in names]
        if len(hits) > 1 or not hits and field in REQUIRED:
            raise ValueError(f"{field}: {len(hits)} matching columns")
        found[field] = hits[0] if hits else None
    number = lambda c, t: F.regexp_replace(F.col(f"`{c}`"), "[,₹\\s]", "").try_cast(t)
    isin = F.upper(F.trim(F.col(f"`{found['isin']}`"))) if found["isin"] else F.lit(None).cast("string")
    out = raw.select(
        F.regexp_replace(F.upper(F.trim(F.col(f"`{found['symbol']}`"))), "-(EQ|BE|BZ)$", "").alias("symbol"), number(found["quantity"], "double").cast("long").alias("quantity"),
        number(found["price"], "double").alias("price"), isin.alias("isin"), F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias("raw"),
    )
    bad = F.col("symbol").isNull() | (F.col("symbol") == "") | F.col("quantity").isNull() | F.col("price").isNull()
    return out.where(~bad).drop("raw"), out.where(bad).select(F.to_json("raw").alias("raw"))


ELEMENT = pa.struct([("n", pa.int64()), *[(c, pa.string()) for c in ("context", "tag", "text", "start", "end")]])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, period_to, elements) of XML filings: of the top elements the facts with their context, and plain contexts (tag null)."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rpartition("}")[2]
    for b in batches:
        ends, rows = [0], []
        for content in b.column(2).to_pylist():
            for n, e in enumerate(ET.fromstring(content)):
                if local(e) == "context":
                    inner = {local(x): (x.text or "").strip() for x in e.iter()}
                    if not {"segment", "scenario"} & inner.keys():
                        rows.append((n, e.get("id"), None, None, inner.get("startDate"), inner.get("endDate")))
                elif e.get("contextRef") and (e.text or "").strip():
                    rows.append((n, e.get("contextRef"), local(e), e.text.strip(), None, None))
            ends.append(len(rows))
        items = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ELEMENT)], fields=list(ELEMENT))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["path", "period_to", "elements"])


def filing_facts(files: DataFrame, ranked: dict[str, list[str]], revenue: str = "revenue") -> DataFrame:
    """(path, field, value, tag) of XML filings (path, content, period_to): per field the first listed tag that has a number.

    Facts count from a context of one quarter (75 to 100 days) that ends on `period_to` and has no further dimensions; a null
    period_to takes any such quarter. A file that declares none counts by its context OneD, if that says that it ends
    on period_to, unless its revenue is nearly the year's (FourD) in another quarter than the first. A file is one row, read
    once, and its few hundred elements one array, from which all choices are made without a shuffle.
    """
    c = F.col
    rows = files.select("path", F.col("period_to").cast("date").alias("period_to"), "content").where("path is not null")
    rows = rows.mapInArrow(_elements, "path string, period_to date, elements array<struct<n:long,context:string,tag:string,text:string,start:string,end:string>>")
    day = lambda x: F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")
    fits = lambda x: x["tag"].isNull() & F.datediff(day(x["end"]), day(x["start"])).between(75, 100) & (c("period_to").isNull() | (day(x["end"]) == c("period_to")))
    order = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("tag"), F.lit(i).alias("rank")) for f, tags in ranked.items() for i, t in enumerate(tags)])
    fact = lambda x, o: F.struct(o["field"].alias("field"), o["rank"].alias("rank"), x["n"].alias("n"), x["context"].alias("context"), x["text"].try_cast("double").alias("value"), x["tag"].alias("tag"))
    facts = F.flatten(F.transform("elements", lambda x: F.transform(F.filter(order, lambda o: o["tag"] == x["tag"]), lambda o: fact(x, o))))
    rows = rows.withColumns({"quarters": F.transform(F.filter("elements", fits), lambda x: x["context"]), "known": F.array_sort(F.filter(facts, lambda x: x["value"].isNotNull()))})
    # files without a quarter of their own
    says = F.exists("elements", lambda x: (x["context"] == "OneD") & x["tag"].isin("DateOfEndOfReportingPeriod", "DateOfEndOfFinancialYear") & (day(x["text"]) == c("period_to")))
    first = lambda ctx: F.get(F.filter("known", lambda x: (x["context"] == ctx) & (x["field"] == revenue)), F.lit(0))["value"]
    rows = rows.withColumns({"says": says, "one": first("OneD"), "four": first("FourD")})
    whole_year = (c("one") >= 0.9 * c("four")) & (c("four") != 0) & (c("one") != 0) & (F.month("period_to") != 6)
    loose = F.coalesce("says", F.lit(False)) & ~F.coalesce(whole_year, F.lit(False))
    rows = rows.withColumn("quarters", F.when(F.size("quarters") > 0, c("quarters")).when(loose, F.array(F.lit("OneD"))))
    rows = rows.withColumn("known", F.filter("known", lambda x: F.array_contains("quarters", x["context"])))
    best = lambda f: F.get(F.filter("known", lambda x: x["field"] == f), F.lit(0))
    return rows.select("path", F.explode(F.array(*[best(f) for f in ranked])).alias("x")).where("x is not null").select("path", "x.field", "x.value", "x.tag")


def extract_filing_facts(spark: SparkSession, path: str, ranked: dict[str, list[str]], period_to: str | None = None) -> DataFrame:
    return filing_facts(binary_files(spark, path).withColumn("period_to", F.lit(period_to).cast("date")), ranked)
