"""Operators that avoid one task or all pairs, against plain Python on small and lopsided tables."""

import bisect
import datetime as dt
import math
import random

import pytest

from tallyfield.operators import decisions as dc
from tallyfield.operators import evaluate as ev
from tallyfield.operators import intervals as iv
from tallyfield.operators import money as mn

D = dt.date


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_over_ranges(spark):
    rng = random.Random(8)
    rows = [(k % 3, rng.choice([None, 0.5, round(rng.random(), 2), rng.random()]), None if k % 17 == 0 else rng.random() < 0.3) for k in range(900)] + [(9, 0.3, True)]
    df = spark.createDataFrame(rows, "g int, p double, label boolean")

    def want(part):
        known = [(-math.inf if p is None else p, y) for p, y in part if y is not None]
        ordered = sorted(p for p, _ in known)
        pos, neg = [p for p, y in known if y], [p for p, y in known if not y]
        rank = lambda p: (bisect.bisect_left(ordered, p) + bisect.bisect_right(ordered, p) + 1) / 2
        auc = (sum(map(rank, pos)) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * len(neg)) if pos and neg else None
        ap = sum(sum(q >= p for q in pos) / sum(q >= p for q, _ in known) for p in pos) / len(pos) if pos else None
        return auc, ap

    both = {r.g: r.auc for r in ev.auc(df, ["g"]).collect()}, {r.g: r.ap for r in ev.average_precision(df, by=["g"]).collect()}
    for g in (0, 1, 2, 9):
        auc, ap = want([(p, y) for k, p, y in rows if k == g])
        assert both[0][g] == (pytest.approx(auc) if auc is not None else None) and both[1][g] == pytest.approx(ap)
    whole = want([r[1:] for r in rows])
    assert ev.auc(df).first().auc == pytest.approx(whole[0]) and ev.average_precision(df).first().ap == pytest.approx(whole[1])
    assert ev.auc(df.where("false")).first().auc is None
    assert "Window" in plan_of(ev.auc(df)) and "SinglePartition" not in plan_of(ev.running_counts(df, "p", "label", []))


def test_a_symbol_with_all_intervals(spark):
    rng = random.Random(2)
    day = lambda n: D(2000, 1, 1) + dt.timedelta(n)
    spans = [("hot", n, day(12 * n), day(12 * n + rng.randint(0, 30))) for n in range(300)] + [("hot", 999, D(1900, 1, 1), D(9999, 12, 31)), ("b", 1, None, day(5)), (None, 2, day(0), day(9)), ("b", 3, day(9), day(3))]
    points = [("hot", day(rng.randint(-50, 3700))) for _ in range(400)] + [("b", day(4)), (None, day(4)), ("hot", None)]
    r = spark.createDataFrame(points, "symbol string, day date")
    i = spark.createDataFrame(spans, "symbol string, n int, valid_from date, valid_to date")
    got = sorted((x.symbol, x.day, x.n) for x in iv.valid_at(r, i, "symbol", "day").select("r.*", "i.n").collect())
    assert got == sorted((s, d, n) for s, d in points for k, n, a, b in spans if s == k and s is not None and d and a and b and a <= d <= b)
    met = iv.valid_at(r, i.where("n < 999"), "symbol", "day").count()
    binned = iv.binned(i.where("n < 999"), "valid_from", "valid_to", i.valid_from, i.valid_to, r, "day").count()
    assert binned < 3 * 300 and met < 6 * len(points)  # not 300 intervals for each point
    hit = {(x.symbol, x.day) for x in iv.overlapping(r, i.where("n < 999"), "symbol", "day", 7, "valid_from", "valid_to").collect()}
    week = dt.timedelta(7)
    assert hit == {(s, d) for s, d in points for k, n, a, b in spans if n < 999 and s == k and s is not None and d and a and b and a <= d + week and b >= d and a - week <= b}
    gaps = spark.createDataFrame([("hot", day(1), day(5), 1), ("hot", day(1), day(12), 2), ("hot", day(12), day(20), 3), ("z", day(0), day(9), 4), (None, day(0), day(9), 5)], "symbol string, a date, b date, k int")
    kept = iv.without_between(gaps, i.where("n < 999"), "symbol", "a", "b", "valid_from").collect()
    assert sorted(x.k for x in kept) == [1, 3, 4, 5] and kept[0].__fields__ == ["symbol", "a", "b", "k"]


def test_histories_by_blocks(spark):
    rng = random.Random(3)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    bars = [(c, day(n), 10.0 + n + len(c)) for c in ("a", "bb", "ccc") for n in range(70) if rng.random() < 0.9]
    traded = {(c, d): p for c, d, p in bars}
    txns = []
    for account in (1, 2, None):
        for c in ("a", "bb", "ccc"):
            held = 0
            for d in sorted(rng.sample([d for x, d in traded if x == c], 8)):
                side = "SELL" if held and rng.random() < 0.5 else "BUY"
                q = rng.randint(1, held) if side == "SELL" else rng.randint(1, 9)
                held += -q if side == "SELL" else q
                txns.append((account, c, d, side, q, traded[c, d]))
    schema = "account int, company_id string, trade_date date, side string, quantity long, price double"
    t, b = spark.createDataFrame(txns, schema), spark.createDataFrame(bars, "company_id string, trade_date date, close double")
    want = {}
    for account in (1, 2):
        for d in sorted({d for _, d, _ in bars}):
            sign = lambda x: x[4] if x[3] == "BUY" else -x[4]
            mine = [x for x in txns if x[0] == account and x[2] <= d]
            now = [c for c in ("a", "bb", "ccc") if (c, d) in traded and any(x[1] == c for x in mine)]
            if now:
                want[account, d] = (sum(sign(x) * traded[x[1], d] for x in mine if x[1] in now), sum(sign(x) * x[5] for x in mine if x[2] == d))
    for block in (7, 32):
        got = {(r.account, r.trade_date): (r.value, r.flow) for r in mn.value_history(t, b, block).collect() if r.account is not None}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert mn.value_history(t.where("false"), b).count() == 0


def test_greedy_buys_without_lists(spark):
    rng = random.Random(6)
    offers = [(a, f"c{n}", float(rng.choice([0.5, 30, 900, 2500, 3999, 5000])), rng.choice([0.05, 0.05, 0.2, rng.random() / 3, None])) for a in range(12) for n in range(40)]
    budgets = [(a, float(rng.choice([0, 2999, 3000, 9000, 14_500, 100_000]))) for a in range(13)]
    o, b = spark.createDataFrame(offers, "account int, company_id string, close double, expected_gain double"), spark.createDataFrame(budgets, "account int, budget double")
    edge = {(r.account, r.company_id): r.edge for r in o.join(b, "account").withColumn("edge", dc.F.round(mn.net_edge(dc.c("expected_gain"), dc.F.least("budget", dc.F.lit(4000.0))), 9)).collect()}
    want = set()
    for a, cash in budgets:
        bought = 0
        for _, name, close in sorted((-edge[a, n], n, c) for x, n, c, _ in offers if x == a and edge[a, n] > 0):
            q = math.floor(min(cash, 4000.0) / close)
            if q * close >= 3000 and bought < 5:
                want.add((a, name, q, close))
                cash, bought = cash - q * close, bought + 1
    got = {tuple(r) for r in dc.plan_opportunities(o, b, 4000.0, 3000.0).select("account", "company_id", "quantity", "price").collect()}
    assert got == want and len(want) > 12


def test_ledger_reads_transactions_once(spark):
    rows = [(1, 1, "A", D(2020, 1, 1), "BUY", 10, 10.0), (2, None, "A", D(2020, 1, 2), "BUY", 3, 20.0), (3, 1, "B", D(2020, 2, 1), "BUY", 4, 8.0), (4, 1, None, D(2020, 3, 1), "BUY", 9, 8.0), (5, 2, "A", D(2020, 9, 1), "BUY", 0, 8.0)]
    t = spark.createDataFrame(rows, "txn_id long, account long, company_id string, trade_date date, side string, quantity long, price double")
    events = spark.createDataFrame([("A", D(2020, 5, 1), 2.0), ("A", D(2020, 6, 1), 1.5), ("C", D(2020, 5, 1), 2.0), (None, D(2020, 5, 1), 2.0)], "company_id string, ex_date date, ratio double")
    out = mn.fifo_ledger(t, events)
    assert {(r.account, r.company_id, r.txn_id, r.quantity) for r in out.collect()} == {(1, "A", 1, 30), (None, "A", 2, 9), (1, "B", 3, 4), (1, None, 4, 9)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Union" not in plan
