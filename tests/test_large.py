"""Queries that failed, or would have, on much larger tables: what they shuffle, read in one task or keep."""

import datetime as dt
import random

import pytest

from tallyfield.operators import money as mn

D = dt.date


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def account_rows(spark):
    rng = random.Random(5)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    bars = spark.createDataFrame([(c, day(n), 20.0 + rng.randint(0, 9)) for c in "ab" for n in range(90)], "company_id string, trade_date date, close double")
    rows = [(i, i % 7, "ab"[i % 2], day(rng.randint(0, 80)), "SELL" if rng.random() < 0.2 else "BUY", rng.randint(1, 9), 20.0 + rng.randint(0, 9)) for i in range(150)]
    return spark.createDataFrame(rows, "txn_id long, account long, company_id string, trade_date date, side string, quantity long, price double"), bars


def test_histories_shuffle_transactions_only(spark):
    t, b = account_rows(spark)
    clean = mn.without_violations(t)
    bad = {(r.account, r.company_id) for r in mn.ledger_violations(t).collect()}
    assert {r.txn_id for r in clean.collect()} == {r.txn_id for r in t.collect() if (r.account, r.company_id) not in bad} and bad
    for df in (mn.value_history(clean, b), mn.performance(mn.value_blocks(clean, b))):
        # one for the pairs, one that finds nothing to move; none of days, blocks or pieces
        moved = [x for x in plan_of(df).splitlines() if "hashpartitioning(" in x]
        assert moved and all("account" in x and "block" not in x and "trade_date" not in x and "company_id" not in x.split("hashpartitioning(")[1].split(")")[0] for x in moved)


def test_performance_of_blocks_and_of_days(spark):
    t, b = account_rows(spark)
    days, blocks = mn.value_history(t, b).localCheckpoint(), mn.value_blocks(t, b)
    got, want = ({r.account: tuple(r)[1:] for r in mn.performance(x).collect()} for x in (blocks, days))
    assert set(got) == set(range(7)) and all(got[k] == pytest.approx(want[k]) for k in want)
    last = {r.account: r for r in mn.time_weighted(days).orderBy("trade_date").collect()}
    assert all(got[k][2] == pytest.approx(last[k]["index"] - 1) and got[k][0] == last[k].value for k in got)


@pytest.mark.parametrize("query", ["s11_read_actions", "s14_read_board_meetings", "s15_read_results_filings", "s16_read_integrated_filings"])
def test_pages_grow_in_number(spark, tmp_path, monkeypatch, query):
    import __spark_entry__ as entry
    from tallyfield import lake

    n = 40_000
    day = "timestamp'1995-01-31' + make_dt_interval(cast(id % 20 as int))"  # of one month
    spark.range(0, n, 1, 1).selectExpr("id as o_orderkey", f"cast({day} as timestamp_ntz) as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0, n, 1, 1).selectExpr("id * 50 as p_partkey", "'Brand#1' as p_brand", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    at = []
    monkeypatch.setattr(lake, "new_folder", lambda s: at.append(f"file://{tmp_path}/landed") or at[0])
    assert entry.queries()[query](spark, str(tmp_path)).count() == n
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at[0]).select("length").collect()
    assert len(files) >= 3 and max(f.length for f in files) < 0.45 * sum(f.length for f in files)


def test_prices_of_companies_map_one_row_a_symbol_and_day(spark, monkeypatch):
    from tallyfield.operators import prices as pr

    rng = random.Random(9)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    rows = [(rng.choice("st"), day(rng.randint(0, 5)), rng.choice(["EQ", "BE", "BZ"]), float(i), f"{(i * 37) % 1000:03}") for i in range(900)]
    spans = [(c, s, day(a), day(a + 3)) for c, s, a in (("x", "s", 0), ("x", "t", 2), ("y", "t", 1), ("z", "s", 9))]
    want = {}
    for s, d, series, px, row in rows:
        for c, on, a, b in spans:
            if on == s and a <= d <= b and series != "BZ":
                want[c, d] = min(want.get((c, d), (2,)), (0 if series == "EQ" else 1, s, row, px))
    met = []
    mapped = pr.valid_at
    monkeypatch.setattr(pr, "valid_at", lambda r, *a: met.append(r.count()) or mapped(r, *a))
    r, m = spark.createDataFrame(rows, "symbol string, trade_date date, series string, px double, row_id string"), spark.createDataFrame(spans, "company_id string, symbol string, valid_from date, valid_to date")
    out = pr.company_prices(r, m, ("EQ", "BE"), pr.F.when(pr.F.col("series") == "EQ", 0).otherwise(1))
    assert {(x.company_id, x.trade_date): (x.symbol, x.px) for x in out.collect()} == {k: (v[1], v[3]) for k, v in want.items()} and met == [12]


def test_filings_are_read_once(spark):
    from tallyfield.sources import files as fl

    ctx = "<context id='q'><period><startDate>2024-01-01</startDate><endDate>2024-03-31</endDate></period></context>"
    pages = [("a", f"<x>{ctx}<C contextRef='q'>3</C><B contextRef='q'>4</B><B contextRef='q'>5</B><P contextRef='q'>6</P></x>"), ("b", "<x/>"), ("c", f"<x>{ctx}<P contextRef='other'>6</P></x>")]
    df = spark.createDataFrame([(k, v.encode(), D(2024, 3, 31)) for k, v in pages], "path string, content binary, period_to date")
    out = fl.filing_facts(df, {"revenue": ["A", "B", "C"], "profit": ["P"]})
    assert {tuple(r) for r in out.collect()} == {("a", "revenue", 4.0, "B"), ("a", "profit", 6.0, "P")}
    plan = plan_of(out)
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def odd_accounts(spark):
    rng = random.Random(11)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    close = lambda c, n: None if n % 13 == 5 else round(rng.uniform(5, 30), 4)
    bars = [(c, day(n), close(c, n)) for c in ("a", "b", "c", "never bought") for n in range(90) if rng.random() < 0.8] + [("void", day(3), None), ("a", None, 3.0), (None, day(95), 4.0)]
    names = ["a", "b", "c", "a", "b", "no closes", "void", None]
    txns = [(i, rng.choice([1, 2, 3, 4, None]), rng.choice(names), rng.choice([day(rng.randint(0, 99)), None]) if i % 9 == 0 else day(rng.randint(0, 80)), "SELL" if rng.random() < 0.3 else "BUY", rng.randint(1, 9), round(rng.uniform(5, 30), 4)) for i in range(300)]
    txns += [(1000 + i, 7, "abc"[i % 3], day(i % 60), "BUY" if i % 2 else "SELL", i % 8, 20.5) for i in range(700)] + [(2000, 8, "void", day(1), "BUY", 1, 2.0), (2001, 9, "a", day(98), "BUY", 1, 2.0)]
    t = spark.createDataFrame(txns, "txn_id long, account long, company_id string, trade_date date, side string, quantity long, price double")
    return t, spark.createDataFrame(bars, "company_id string, trade_date date, close double"), spark.createDataFrame([(day(n), None if n == 40 else 100.0 + n) for n in range(120) if n % 7], "trade_date date, nifty500 double")


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5")  # an account of 700 moves then is more than a hundred batches, which are made compact
    yield
    spark.conf.set(name, before)


def near(rows, wanted):
    key = lambda r: tuple((x is None, x or 0) for x in r if not isinstance(x, float))
    rows, wanted = sorted(map(tuple, rows), key=key), sorted(map(tuple, wanted), key=key)
    assert len(rows) == len(wanted) > 0
    for r, w in zip(rows, wanted, strict=True):
        assert list(r) == [pytest.approx(x, nan_ok=True) if isinstance(x, float) else x for x in w]


def test_days_of_transactions_equal_those_of_blocks(spark, small_batches):
    t, b, _ = odd_accounts(spark)
    near(mn.value_history(t, b).collect(), mn.value_history(t, b, cells=0).collect())
    near(mn.value_history(t, b, places=7).collect(), mn.value_history(t, b).select("account", "trade_date", mn.F.round("value", 7), mn.F.round("flow", 7)).collect())
    assert isinstance(mn.holdings(t, b), mn.Holdings) and not isinstance(mn.holdings(t, b, cells=4 * 90), mn.Holdings)


def test_returns_of_transactions_equal_those_of_blocks(spark, small_batches):
    t, b, m = odd_accounts(spark)
    near(mn.performance(mn.holdings(t, b)).collect(), mn.performance(mn.value_blocks(t, b)).collect())
    matches, orders = mn.fifo_matches(mn.without_violations(t)), mn.order_charges(t)
    audits = [mn.audit_money(x, m, matches, orders, "2020-02-01", "2020-03-10") for x in (mn.holdings(t, b, m), mn.value_blocks(t, b, index=m))]
    near(*[x.collect() for x in audits])
    whole = {r.account: r for r in audits[0].collect()}
    assert whole[None].charges == 0 and whole[1].charges > 0  # as a join on the account has it


def test_returns_keep_no_days_in_a_shuffle_or_sort(spark):
    t, b = account_rows(spark)
    clean = mn.without_violations(t)
    for df in (mn.value_history(clean, b), mn.value_history(clean, b, places=4), mn.performance(mn.holdings(clean, b))):
        plan = plan_of(df)
        # the transactions once; no pieces, blocks or days that a sort or an aggregation could spill
        assert plan.count("Exchange") == plan.count("Sort [") == 1 and "Generate" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("query", ["c39_value_history", "c42_performance", "c58_audit_money"])
def test_histories_deal_transactions_once(spark, query):
    import __spark_entry__ as entry

    found, rest = [], [entry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().inputPlan()]
    while rest:
        at = rest.pop()
        if at.nodeName() == "Exchange" and "hashpartitioning(account" in at.simpleString(99) and "REPARTITION" in at.simpleString(99):
            found.append(at)
        assert at.nodeName() != "Window" or "bucket" not in at.simpleString(99)  # nothing is numbered
        rest += [at.children().apply(i) for i in range(at.children().size())]
    assert found and all(x.sameResult(found[0]) for x in found)


def test_rounding_of_values():
    import numpy as np

    x = np.array([0.00000005, -0.00000005, 1.23456785, 123456.78905, 0.0, -2.5e-8, 987654321.1234567, 1e300, np.nan])
    got = mn.rounded_half_up(x, 7)
    assert list(got[:6]) == [1e-7, -1e-7, 1.2345679, 123456.78905, 0.0, 0.0] and got[6] == x[6] and got[7] == 1e300 and np.isnan(got[8])
    assert list(mn.rounded_half_up(x[:4], 2)) == [0.0, 0.0, 1.23, 123456.79]
