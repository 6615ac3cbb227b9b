"""Operators on small inputs of known results, and invariants of the features."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyfield import catalog, lake
from tallyfield.operators import evaluate as ev
from tallyfield.operators import features as ft
from tallyfield.operators import intervals as iv
from tallyfield.operators import money as mn
from tallyfield.operators import prices as pr
from tallyfield.sources import files

D = dt.date


def panel(spark, n=90, seed=1):
    rng = random.Random(seed)
    rows, p = [], 100.0
    for i in range(n):
        o = p * (1 + rng.uniform(-0.02, 0.02))
        p = o * (1 + rng.uniform(-0.05, 0.05))
        rows.append(("A", 0, D(2020, 1, 1) + dt.timedelta(i), "EQ", o, max(o, p) * 1.01, min(o, p) * 0.99, p, 1000.0 + i, 50.0))
    return spark.createDataFrame(rows, "company_id string, segment long, trade_date date, series string, open double, high double, low double, close double, value_inr double, delivery_pct double")


def market(spark, n=90):
    return ft.market_features(spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(i), 100.0 + i % 7, 10.0 + i % 5) for i in range(n)], "trade_date date, nifty500 double, vix double"))


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 180


def test_truncation_does_not_change_features(spark):
    whole = ft.compute_features(panel(spark), market(spark))
    short = ft.compute_features(panel(spark).where("trade_date <= '2020-03-10'"), market(spark).where("trade_date <= '2020-03-10'"))
    a = whole.where("trade_date <= '2020-03-10'").select("trade_date", "ret_5", "vol_20", "rsi_14", "beta_60").orderBy("trade_date").collect()
    assert a == short.select("trade_date", "ret_5", "vol_20", "rsi_14", "beta_60").orderBy("trade_date").collect()


def test_later_adjustment_does_not_change_features(spark):
    scaled = panel(spark).select(*[(F.col(c) * 0.5).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in panel(spark).columns])
    pick = lambda df: [(r.ret_5 and round(r.ret_5, 9), r.atr_14_pct and round(r.atr_14_pct, 9)) for r in ft.compute_features(df, market(spark)).orderBy("trade_date").collect()]
    assert pick(panel(spark)) == pick(scaled)


def test_asof_modes(spark):
    left = spark.createDataFrame([("k", D(2020, 1, 2)), ("x", D(2020, 1, 2))], "k string, t date")
    right = spark.createDataFrame([("k", D(2020, 1, 1), 1), ("k", D(2020, 1, 2), 2), ("k", D(2020, 1, 3), 3)], "k string, u date, v int")
    got = {(d, s): {r.k: r.v for r in iv.asof_join(left, right, "k", "t", "u", ["v"], d, s).collect()} for d in ("backward", "forward") for s in (True, False)}
    assert got[("backward", True)] == {"k": 1, "x": None} and got[("backward", False)]["k"] == 2
    assert got[("forward", True)]["k"] == 3 and got[("forward", False)]["k"] == 2
    assert "Cartesian" not in iv.asof_join(left, right, "k", "t", "u", ["v"])._jdf.queryExecution().toString()


@pytest.mark.parametrize(("subject", "kind", "status", "factor"), [
    ("Bonus 1:1", "bonus", "parsed", 0.5), ("Bonus Issue 3:2", "bonus", "parsed", 0.4), ("Face Value Split - From Rs 10/- Per Share To Rs 2/-", "split", "parsed", 0.2),
    ("Fv Splt Frm Rs 10 To Re 1", "split", "parsed", 0.1), ("Consolidation Rs 1 To Rs.10", "consolidation", "parsed", 10.0), ("Bonus Debentures 1:1", "bonus_debenture", "unadjustable", None),
    ("Rights:14 Compulsory Convertible Debentures", "rights", "unadjustable", None), ("Bonus Issue", "bonus", "unparsed", None), ("Scheme Of Arrangement", "restructuring", "unadjustable", None),
    ("Dividend - 50%", "dividend", "unparsed", None), ("", None, None, None), (None, None, None, None),
    ("Demerger", "demerger", "unadjustable", None), ("Annual General Meeting", "other", "no_price_effect", None), ("Rights 1:5", "rights", "unadjustable", None), ("Interim Dividend", "dividend", "unparsed", None),
])
def test_action_grammar(spark, subject, kind, status, factor):
    r = pr.parse_actions(spark.createDataFrame([(subject,)], "subject string")).first()
    assert r is None and kind is None or (r.kind, r.status, r.price_factor) == (kind, status, factor)


def test_dividend_amounts(spark):
    rows = [("Dividend - 50%", 5.0), ("Interim Div - Rs 6/- Per Share", 6.0), ("Rs 3.5 Per Unit As Dividend", 3.5), ("Dividend Rs Rs 0.50", 0.5), ("Dividend Rs - 2 Per Share And Special Dividend Rs 1", 3.0)]
    got = pr.parse_actions(spark.createDataFrame(rows, "subject string, want double"), face_value=F.lit(10.0)).collect()
    assert all(r.dividend_per_share == r.want for r in got) and len(got) == len(rows)


def test_action_components(spark):
    rows = pr.parse_actions(spark.createDataFrame([("Bonus 1:1/Dividend- Rs 2 Per Share",)], "subject string")).orderBy("part").collect()
    assert [(r.kind, r.price_factor, r.dividend_per_share) for r in rows] == [("bonus", 0.5, None), ("dividend", None, 2.0)]


def test_fifo_both_ways(spark):
    rng = random.Random(3)
    rows, held = [], 0
    for i in range(60):
        side = "SELL" if held > 5 and rng.random() < 0.5 else "BUY"
        q = rng.randint(1, 5)
        held += q if side == "BUY" else -q
        rows.append((i, 1, "A", D(2020, 1, 1) + dt.timedelta(i), side, q, 10.0 + i))
    t = spark.createDataFrame(rows, "txn_id long, account long, company_id string, trade_date date, side string, quantity long, price double")
    none = spark.createDataFrame([], "company_id string, ex_date date, ratio double")
    a = {(r.txn_id, r.quantity) for r in mn.open_lots(t).collect()}
    assert a == {(r.txn_id, r.quantity) for r in mn.fifo_with_events(t, none).collect()} and a
    split = spark.createDataFrame([("A", D(2021, 1, 1), 2.0)], "company_id string, ex_date date, ratio double")
    assert {(i, 2 * q) for i, q in a} == {(r.txn_id, r.quantity) for r in mn.fifo_with_events(t, split).collect()}


def test_ledger_shares_costs_and_tells_short_sales(spark):
    rows = [(1, 1, "A", D(2020, 1, 1), "BUY", 10, 10.0, 5.0), (2, 1, "A", D(2020, 1, 5), "BUY", 3, 20.0, 0.0), (3, 1, "A", D(2020, 2, 1), "SELL", 23, 8.0, 2.3), (4, 1, "A", D(2020, 3, 1), "SELL", 9, 8.0, 0.0)]
    t = spark.createDataFrame(rows, "txn_id long, account long, company_id string, trade_date date, side string, quantity long, price double, charges double")
    events = spark.createDataFrame([("A", D(2020, 1, 5), 2.0), ("A", D(2020, 2, 20), 1.5)], "company_id string, ex_date date, ratio double")
    got = {(r.kind, r.txn_id, r.sell_id): (r.quantity, r.cost and round(r.cost, 6), r.proceeds and round(r.proceeds, 6)) for r in mn.fifo_ledger(t, events).collect()}
    # ten become twenty on the day of the second buy; 23 are sold, of which three are of the second lot
    assert got == {("sold", 1, 3): (20, 105.0, 158.0), ("sold", 2, 3): (3, 60.0, 23.7), ("short", None, 4): (9, None, 72.0)}
    with pytest.raises(Exception, match="exceeds"):
        mn.fifo_ledger(t, events, strict=True).collect()


def test_performance_counts_a_total_loss(spark):
    days = [D(2020, 1, 1), D(2020, 7, 1), D(2021, 1, 1)]
    h = spark.createDataFrame([(1, days[0], 100.0, 100.0, None), (1, days[1], 150.0, 150.0, 0.0), (1, days[2], 165.0, 0.0, 1.1), (2, days[0], 100.0, 100.0, None), (2, days[2], 121.0, 0.0, 1.21)], "account long, trade_date date, value double, flow double, growth double")
    r = {x.account: x for x in mn.performance(h).collect()}
    assert (r[1].contributed, r[1].final, r[1].twr, r[1].max_drawdown) == (250.0, 165.0, -1.0, -1.0)
    assert r[2].twr == pytest.approx(0.21) and r[2].twr_annual == pytest.approx(0.21, abs=2e-3) and r[2].xirr == pytest.approx(0.21, abs=2e-3)


def test_filing_facts(spark):
    ctx = lambda i, a, b, more="": f"<context id='{i}'>{more}<period><startDate>{a}</startDate><endDate>{b}</endDate></period></context>"
    q, y = ctx("q", "2024-01-01", "2024-03-31"), ctx("y", "2023-04-01", "2024-03-31")
    ends = "<DateOfEndOfReportingPeriod contextRef='OneD'>2024-03-31</DateOfEndOfReportingPeriod>"
    pages = {
        "plain": q + y + "<B contextRef='y'>9</B><B contextRef='q'>7</B><A contextRef='q'>n/a</A>", "segment": ctx("q", "2024-01-01", "2024-03-31", "<segment/>") + "<B contextRef='q'>7</B>",
        "other quarter": ctx("q", "2023-10-01", "2023-12-31") + "<B contextRef='q'>7</B>", "undeclared": ends + "<B contextRef='OneD'>5</B><B contextRef='FourD'>50</B>",
        "year to date": ends + "<B contextRef='OneD'>49</B><B contextRef='FourD'>50</B>", "first tag wins": q + "<C contextRef='q'>3</C><B contextRef='q'>4</B>",
    }
    df = spark.createDataFrame([(k, f"<x>{v}</x>".encode(), D(2024, 3, 31)) for k, v in pages.items()], "path string, content binary, period_to date")
    got = {(r.path, r.value, r.tag) for r in files.filing_facts(df, {"revenue": ["A", "B", "C"]}).collect()}
    assert got == {("plain", 7.0, "B"), ("undeclared", 5.0, "B"), ("first tag wins", 4.0, "B")}


def test_broker_columns(spark, tmp_path):
    p = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    r = files.read_broker_holdings(spark, p("a.csv", "Trading Symbol,ISIN,Net Qty.,Buy Average\nab-EQ,in1,5,2.5\n"))[0].first()
    assert (r.symbol, r.isin, r.quantity, r.price) == ("AB", "IN1", 5, 2.5)
    for name, text in (("b.csv", "Symbol,Scrip,Qty,Avg. cost\na,b,1,2\n"), ("c.csv", "Symbol,Avg. cost\na,2\n")):
        with pytest.raises(ValueError, match="matching columns"):
            files.read_broker_holdings(spark, p(name, text))


def test_numbers_follow_each_other(spark):
    from tallyfield.operators.ml import numbered

    got = sorted(r["__n"] for r in numbered(spark.range(500), F.rand(3)).collect())
    assert got == list(range(1, 501))


def test_charges_tax_and_term(spark):
    r = mn.order_charges(spark.createDataFrame([("BUY", 10, 100.0), ("SELL", 10, 100.0)], "side string, quantity long, price double")).orderBy("side").collect()
    assert [x.total for x in r] == [pytest.approx(1.19, abs=0.01), pytest.approx(16.38, abs=0.01)]
    t = spark.range(1).select(mn.holding_term(F.lit("2020-02-29").cast("date"), F.lit("2021-03-01").cast("date")).alias("a"), mn.holding_term(F.lit("2020-02-29").cast("date"), F.lit("2021-03-02").cast("date")).alias("b")).first()
    assert (t.a, t.b) == (False, True)


def test_xirr(spark):
    f = spark.createDataFrame([(1, D(2020, 1, 1), -100.0), (1, D(2021, 1, 1), 110.0), (2, D(2020, 1, 1), 5.0)], "account long, trade_date date, flow double")
    got = {r.account: r.xirr for r in mn.xirr(f).collect()}
    assert got[1] == pytest.approx(0.1, abs=2e-3) and got[2] is None


def test_metrics(spark):
    p = spark.createDataFrame([(i, D(2020, 1, 1), i / 10, i >= 5) for i in range(10)], "row_id long, trade_date date, p double, label boolean")
    assert ev.auc(p).first().auc == 1.0 and ev.average_precision(p).first().ap == 1.0
    assert ev.pick_gate(ev.cumulative_gate(p), 0.9, 3, 0.4).first().cutoff == 0.5
    w = spark.range(1).select(ev.wilson_lower(F.lit(9), F.lit(10)).alias("x")).first().x
    assert w == pytest.approx(0.5958, abs=1e-3)


def test_warnings_are_spaced(spark):
    d = [D(2020, 1, 1) + dt.timedelta(x) for x in (0, 10, 28, 30, 56)]
    out = ev.dedupe_warnings(spark.createDataFrame([(1, x, True) for x in d], "company_id long, trade_date date, label boolean"), 28).collect()
    assert sorted(r.trade_date for r in out) == [d[0], d[2], d[4]]


def test_lake(spark, tmp_path):
    at = str(tmp_path / "t")
    lake.write_partition(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), at, "p")
    lake.write_partition(spark.createDataFrame([(3, "b")], "v int, p string"), at, "p")
    assert {(r.v, r.p) for r in lake.scan_table(spark, at).collect()} == {(1, "a"), (3, "b")}
    land = tmp_path / "land"
    land.mkdir()
    (land / "f.txt").write_bytes(b"x")
    assert lake.archive_raw(spark, str(land), str(tmp_path / "m"), "s").count() == 1
    assert lake.archive_raw(spark, str(land), str(tmp_path / "m"), "s").count() == 0
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_price_files(spark, tmp_path):
    header = "TradDt,TckrSymb,SctySrs,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal"
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("a.csv", header + "\n2024-01-02,AB, EQ ,IN1,1,2,0.5,1.5,1,10,15\n")
    (tmp_path / "a.zip").write_bytes(body.getvalue())
    r = files.read_udiff(spark, str(tmp_path / "a.zip"), header).first()
    assert (r.trade_date, r.series, r.close, r.volume) == (D(2024, 1, 2), "EQ", 1.5, 10)
    old = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,ISIN"
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("b.csv", old + "\nAB,EQ,1,2,0.5,1.5,1,10,15,04-JAN-2016,IN1\nAB,EQ,1,2,0.5,1.5,1,10,15,05-JAN-16,IN1\n")
    (tmp_path / "b.zip").write_bytes(body.getvalue())
    assert {r.trade_date for r in files.read_legacy(spark, str(tmp_path / "b.zip"), old).collect()} == {D(2016, 1, 4), D(2016, 1, 5)}


def test_other_files(spark, tmp_path):
    p = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    r = files.read_delivery(spark, p("mto.dat", "Delivery\nTrade Date <02-JAN-2024>\nhead\n20,1,AB,EQ,100,60,60.0\n")).first()
    assert (r.trade_date, r.symbol, r.deliverable_qty) == (D(2024, 1, 2), "AB", 60)
    r = files.read_index(spark, p("i.csv", "Index Name,Index Date,Open Index Value,High Index Value,Low Index Value,Closing Index Value\nIX,03-04-2024,1,2,-,1.5\n"), "2024-04-03").first()
    assert (r.trade_date, r.low, r.close) == (D(2024, 4, 3), None, 1.5)
    r = files.read_actions(spark, p("ca.json", '[{"symbol":"AB","series":"EQ","isin":"I","comp":"C","faceVal":"10","subject":"Bonus 1:1","exDate":"02-Jan-2024","recDate":"-"}]')).first()
    assert (r.ex_date, r.record_date, r.face_value) == (D(2024, 1, 2), None, 10.0)
    r = files.read_symbol_changes(spark, p("s.csv", "A, B and Co,OLD,NEW,02-Jan-2024\n")).first()
    assert (r.company, r.new_symbol, r.change_date) == ("A, B and Co", "NEW", D(2024, 1, 2))
    good, bad = files.read_broker_holdings(spark, p("h.csv", 'Instrument,Qty.,Avg. cost\nAB-EQ,"1,000",₹2.5\nCD,x,1\n'))
    assert [(r.symbol, r.quantity, r.price) for r in good.collect()] == [("AB", 1000, 2.5)] and bad.count() == 1
    r = files.read_board_meetings(spark, p("b.json", '[{"bm_symbol":"AB","bm_date":"02-Jan-2024","bm_purpose":"Financial Results","bm_timestamp":"01-Jan-2024 10:00:00"}]')).first()
    assert r.is_results and r.announced_at == dt.datetime(2024, 1, 1, 10)
    assert files.read_holidays(spark, p("hol.json", '{"CM":[{"tradingDate":"26-Jan-2024","description":"R"}]}')).first().day == D(2024, 1, 26)
    with pytest.raises(Exception, match="short"):
        files.read_integrated_filings(spark, p("f.json", '{"data":[],"totalCount":2}')).collect()
    xml = '<x><context id="q"><period><startDate>2024-01-01</startDate><endDate>2024-03-31</endDate></period></context><context id="y"><period><startDate>2023-04-01</startDate><endDate>2024-03-31</endDate></period></context><Rev contextRef="y">9</Rev><Sales contextRef="q">7</Sales></x>'
    r = files.extract_filing_facts(spark, p("r.xml", xml), {"revenue": ["Rev", "Sales"]}).first()
    assert (r.field, r.value, r.tag) == ("revenue", 7.0, "Sales")


def test_lots_and_xirr_of_real_accounts(spark):
    import __spark_entry__
    from tallyfield.plans import fixtures as fx

    d = "/root/testdata/sf0.001"
    txns, queries = fx.txns(spark, d).orderBy("trade_date", "txn_id").collect(), __spark_entry__.queries()
    splits = fx.factors(spark, d).where("price_factor = 0.5").select("company_id", "ex_date").collect()
    groups, want = {}, set()
    for t in txns:
        groups.setdefault((t.account, t.company_id), []).append((t.trade_date, 1, t.txn_id, t))
    for (account, company), steps in groups.items():
        lots = {}
        for _, rank, _, t in sorted(steps + [(s.ex_date, 0, -1, None) for s in splits if s.company_id == company], key=lambda x: x[:3]):
            if rank == 0:
                lots = {k: 2 * q for k, q in lots.items()}
            elif t.side == "BUY":
                lots[t.txn_id] = t.quantity
            else:
                need = t.quantity
                for k in lots:
                    take = min(need, lots[k])
                    lots[k], need = lots[k] - take, need - take
        want |= {(account, company, k, q) for k, q in lots.items() if q}
    assert {(r.account, r.company_id, r.txn_id, r.quantity) for r in queries["c35_fifo_with_events"](spark, d).collect()} == want

    paid = {}
    for t in txns:
        if t.side == "BUY":
            paid.setdefault(t.account, []).append((t.trade_date, -t.quantity * t.price))
    got = {r.account: r.xirr for r in queries["c41_xirr"](spark, d).collect()}
    assert got.keys() == paid.keys()
    for account, x in paid.items():
        first, last = min(x)[0], max(x)[0]
        x = [*x, (last + dt.timedelta(400), -1.2 * sum(f for _, f in x))]
        npv = lambda r, x=x, first=first: sum(f / (1 + r) ** ((day - first).days / 365.25) for day, f in x)
        assert npv(got[account] - 2e-5) > 0 > npv(got[account] + 2e-5)
