"""The oracle's fixture views, as text that DuckDB runs on the driver's tables."""

VIEWS = {
    "px": """SELECT p.p_brand AS company_id, CAST(l.l_shipdate AS DATE) AS trade_date, l.*, l.l_extendedprice / l.l_quantity AS px
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "bars": """SELECT company_id, trade_date, max(CASE WHEN ra = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
  max(CASE WHEN rd = 1 THEN px END) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS value_inr,
  100 * sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS delivery_pct
FROM (SELECT px.*, row_number() OVER (PARTITION BY company_id, trade_date ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ra,
  row_number() OVER (PARTITION BY company_id, trade_date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rd FROM px) o
GROUP BY company_id, trade_date""",
    "market": "SELECT trade_date, avg(px) AS nifty500, stddev_samp(px) AS vix FROM px GROUP BY trade_date",
    "breaks": """SELECT company_id, min(trade_date) AS break_date FROM bars
WHERE (CAST(substr(company_id, 7) AS INT) + year(trade_date)) % 4 = 0 GROUP BY company_id, year(trade_date)""",
    "factors": """SELECT company_id, min(trade_date) AS ex_date,
  CASE CAST(substr(min(company_id), 7) AS INT) % 3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS price_factor,
  CAST(0.99 AS DOUBLE) AS dividend_factor
FROM bars WHERE month(trade_date) = 7 AND (CAST(substr(company_id, 7) AS INT) + year(trade_date)) % 3 = 0 GROUP BY company_id, year(trade_date)""",
    "flags": """SELECT f.company_id, min(b.trade_date) AS from_date, f.ex_date - 1 AS to_date,
  CASE WHEN CAST(substr(f.company_id, 7) AS INT) % 5 = 0 THEN 'BLOCK' ELSE 'WARN' END AS severity
FROM factors f JOIN bars b USING (company_id) GROUP BY f.company_id, f.ex_date""",
    "panel": """SELECT b.*, (SELECT count(*) FROM breaks k WHERE k.company_id = b.company_id AND k.break_date <= b.trade_date) AS segment,
  CASE WHEN volume < 30 THEN 'BE' ELSE 'EQ' END AS series FROM bars b""",
    "scored": """SELECT o_orderkey AS row_id, o_custkey % 100 AS company_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS trade_date,
  CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS p, CAST((o_orderkey * 104729) % 1000 AS DOUBLE) / 1000 AS expected_gain, o_totalprice > 250000 AS label FROM orders""",
    "txns": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS txn_id,
  o.o_custkey AS account, px.company_id, px.trade_date, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS quantity, px AS price
FROM px JOIN orders o ON o.o_orderkey = px.l_orderkey""",
    "attempts": """SELECT event_id AS job_run_id, event_type AS source_id, CAST(ts AS DATE) AS partition_key, ts AS started_at,
  CASE user_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'skipped' WHEN 2 THEN 'not_available' ELSE 'failed' END AS status FROM events""",
    "action_text": """SELECT p_partkey, p_brand AS company_id, CASE p_size % 8
  WHEN 0 THEN concat('Bonus ', CAST(1 + p_partkey % 3 AS VARCHAR), ':', CAST(1 + p_partkey % 4 AS VARCHAR))
  WHEN 1 THEN concat('Face Value Split - From Rs 10/- Per Share To Rs ', CAST(1 + p_partkey % 5 AS VARCHAR), '/-')
  WHEN 2 THEN concat('Dividend - Rs ', CAST(1 + p_partkey % 9 AS VARCHAR), ' Per Share')
  WHEN 3 THEN concat('Rights 1:', CAST(1 + p_partkey % 7 AS VARCHAR), ' @ Premium Rs 20/-')
  WHEN 4 THEN 'Demerger' WHEN 5 THEN 'Annual General Meeting'
  WHEN 6 THEN concat('Bonus 1:1/Dividend- Rs ', CAST(1 + p_partkey % 4 AS VARCHAR), ' Per Share') ELSE 'Interim Dividend' END AS subject FROM part""",
    "filings": """SELECT concat('Brand#', CAST(1 + o_orderkey % 25 AS VARCHAR)) AS company_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS period_to,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS published_at, o_orderkey AS filing_id, o_orderkey % 2 = 0 AS consolidated FROM orders""",
    "meetings": """SELECT concat('Brand#', CAST(1 + o_orderkey % 25 AS VARCHAR)) AS company_id, o_orderdate AS announced_at,
  CAST(o_orderdate AS DATE) + CAST(5 + o_orderkey % 20 AS INT) AS meeting_date, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_results FROM orders""",
    "symbol_changes": """SELECT concat('S', c_custkey) AS old_symbol, concat('S', c_custkey + 1) AS new_symbol, DATE '2020-01-01' + CAST(c_custkey % 300 AS INT) AS change_date
FROM customer WHERE c_custkey % 5 <> 4""",
    "symbol_map": """SELECT p_brand AS company_id, concat('SYM', CAST(p_size % 10 AS VARCHAR)) AS symbol, DATE '1994-01-01' + CAST(p_size * 40 AS INT) AS valid_from,
  CASE WHEN p_size % 7 = 0 THEN DATE '9999-12-31' ELSE DATE '1994-01-01' + CAST(p_size * 40 + 30 AS INT) END AS valid_to
FROM (SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size) g""",
}
NEEDS = {
    "bars": ["px"], "market": ["px"], "breaks": ["bars"], "factors": ["bars"], "flags": ["factors", "bars"], "panel": ["bars", "breaks"], "txns": ["px"],
}


def with_views(*names: str) -> str:
    """A WITH clause for the views and all that they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"
