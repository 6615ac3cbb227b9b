"""The same fixture views as DataFrames over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_number(c: str = "company_id"):
    return F.substring(c, 7, 9).cast("int")


def px(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    out = line.join(part, line.l_partkey == part.p_partkey)
    return out.select(F.col("p_brand").alias("company_id"), F.col("l_shipdate").cast("date").alias("trade_date"), *line.columns, (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def bars(spark, d):
    """Daily bars per company; one shuffle, with partial aggregation."""
    at = F.struct(*ORDER)
    sold = F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0))
    return px(spark, d).groupBy("company_id", "trade_date").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("value_inr"), (100 * sold / F.sum("l_quantity")).alias("delivery_pct"),
    )


def market(spark, d):
    return px(spark, d).groupBy("trade_date").agg(F.avg("px").alias("nifty500"), F.stddev_samp("px").alias("vix"))


def breaks(spark, d):
    hit = bars(spark, d).where((brand_number() + F.year("trade_date")) % 4 == 0)
    return hit.groupBy("company_id", F.year("trade_date").alias("y")).agg(F.min("trade_date").alias("break_date")).drop("y")


def factors(spark, d):
    hit = bars(spark, d).where((F.month("trade_date") == 7) & ((brand_number() + F.year("trade_date")) % 3 == 0))
    out = hit.groupBy("company_id", F.year("trade_date").alias("y")).agg(F.min("trade_date").alias("ex_date")).drop("y")
    n = brand_number() % 3
    return out.withColumn("price_factor", F.when(n == 0, 0.5).when(n == 1, 0.2).otherwise(0.8)).withColumn("dividend_factor", F.lit(0.99))


def flags(spark, d):
    start = bars(spark, d).groupBy("company_id").agg(F.min("trade_date").alias("from_date"))
    out = factors(spark, d).join(start, "company_id")
    return out.select("company_id", "from_date", F.date_sub("ex_date", 1).alias("to_date"), F.when(brand_number() % 5 == 0, "BLOCK").otherwise("WARN").alias("severity"))


def panel(spark, d):
    from ..operators.intervals import with_segment

    out = with_segment(bars(spark, d), breaks(spark, d))
    return out.withColumn("series", F.when(F.col("volume") < 30, "BE").otherwise("EQ"))


def scored(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 100).alias("company_id"), F.date_trunc("week", "o_orderdate").cast("date").alias("trade_date"),
        ((F.col("o_orderkey") * 7919 % 1000).cast("double") / 1000).alias("p"), ((F.col("o_orderkey") * 104729 % 1000).cast("double") / 1000).alias("expected_gain"), (F.col("o_totalprice") > 250000).alias("label"),
    )


def numbered(rows: DataFrame, order: tuple[str, ...], bucket: Column, name: str) -> DataFrame:
    """`rows` with consecutive numbers in `order`: a row's number in its bucket, after the rows of all earlier buckets.

    Buckets follow the order, so no task holds more than one bucket, or one row for each bucket.
    """
    rows = rows.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").count()
    before = sizes.select("__bucket", F.coalesce(F.sum("count").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return rows.withColumn("__n", inside).join(before, "__bucket").withColumn(name, (F.col("__before") + F.col("__n")).cast("long")).drop("__bucket", "__before", "__n")


def ordered(spark, d):
    p, o = px(spark, d), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return p.join(o, p.l_orderkey == o.o_orderkey)


def txns(spark, d):
    """Transactions; ids number the line items from the first order on, in buckets of 65,536 order keys."""
    return as_txns(numbered(ordered(spark, d), ORDER, F.shiftright("l_orderkey", 16), "txn_id"))


def unnumbered_txns(spark, d):
    """Transactions for queries that only order them: txn_id is what the numbers go by, so nothing is dealt, or joined again, to number it."""
    return as_txns(ordered(spark, d).withColumn("txn_id", F.struct(*ORDER)))


def as_txns(out):
    return out.select("txn_id", F.col("o_custkey").alias("account"), "company_id", "trade_date", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").cast("long").alias("quantity"), F.col("px").alias("price"))


def attempts(spark, d):
    n = F.col("user_id") % 4
    status = F.when(n == 0, "success").when(n == 1, "skipped").when(n == 2, "not_available").otherwise("failed")
    return table(spark, d, "events").select(F.col("event_id").alias("job_run_id"), F.col("event_type").alias("source_id"), F.col("ts").cast("date").alias("partition_key"), F.col("ts").alias("started_at"), status.alias("status"))


def action_text(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size") % 8
    n = lambda m: (1 + k % m).cast("string")
    subject = (
        F.when(s == 0, F.concat(F.lit("Bonus "), n(3), F.lit(":"), n(4))).when(s == 1, F.concat(F.lit("Face Value Split - From Rs 10/- Per Share To Rs "), n(5), F.lit("/-")))
        .when(s == 2, F.concat(F.lit("Dividend - Rs "), n(9), F.lit(" Per Share"))).when(s == 3, F.concat(F.lit("Rights 1:"), n(7), F.lit(" @ Premium Rs 20/-")))
        .when(s == 4, "Demerger").when(s == 5, "Annual General Meeting").when(s == 6, F.concat(F.lit("Bonus 1:1/Dividend- Rs "), n(4), F.lit(" Per Share"))).otherwise("Interim Dividend")
    )
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("company_id"), subject.alias("subject"))


def _brand(key):
    return F.concat(F.lit("Brand#"), (1 + F.col(key) % 25).cast("string"))


def filings(spark, d):
    o = table(spark, d, "orders")
    hours = F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int))")
    return o.select(_brand("o_orderkey").alias("company_id"), F.date_sub(F.date_trunc("quarter", "o_orderdate").cast("date"), 1).alias("period_to"), (F.col("o_orderdate") + hours).alias("published_at"), F.col("o_orderkey").alias("filing_id"), (F.col("o_orderkey") % 2 == 0).alias("consolidated"))


def meetings(spark, d):
    o = table(spark, d, "orders")
    return o.select(_brand("o_orderkey").alias("company_id"), F.col("o_orderdate").alias("announced_at"), F.date_add(F.col("o_orderdate").cast("date"), (5 + F.col("o_orderkey") % 20).cast("int")).alias("meeting_date"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_results"))


def symbol_changes(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 5 <> 4")
    s = lambda k: F.concat(F.lit("S"), k.cast("string"))
    return c.select(s(F.col("c_custkey")).alias("old_symbol"), s(F.col("c_custkey") + 1).alias("new_symbol"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("change_date"))


def symbol_map(spark, d):
    g = table(spark, d, "part").select("p_brand", "p_size").distinct()
    start = F.lit("1994-01-01").cast("date")
    end = F.when(F.col("p_size") % 7 == 0, F.lit("9999-12-31").cast("date")).otherwise(F.date_add(start, F.col("p_size") * 40 + 30))
    return g.select(F.col("p_brand").alias("company_id"), F.concat(F.lit("SYM"), (F.col("p_size") % 10).cast("string")).alias("symbol"), F.date_add(start, F.col("p_size") * 40).alias("valid_from"), end.alias("valid_to"))
