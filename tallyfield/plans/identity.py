"""The symbol map's query: spans from the orders, renames from the customers, with reused and circular symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import identity
from .fixtures import table as t


def observed(s, d):
    symbol = F.concat(F.lit("S"), F.col("o_custkey").cast("string"))
    day = F.col("o_orderdate").cast("date")
    return t(s, d, "orders").groupBy(symbol.alias("symbol")).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))


def changes(s, d):
    """Chains whose dates don't follow their order, so symbols are reused; some renames are taken back; some touch no traded symbol."""
    k = F.col("c_custkey")
    name = lambda letter, key: F.concat(F.lit(letter), key.cast("string"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (k * 389 % 1400).cast("int"))
    kinds = (
        (k % 5 != 4, name("S", k), name("S", k + 1), day),
        ((k % 7 == 0) & (k % 5 != 4), name("S", k + 1), name("S", k), F.date_add(day, 500)),
        (k % 11 == 0, name("S", k), name("S", k), day),
        (k % 13 == 0, name("X", k), name("Y", k), day),
        (k % 17 == 0, name("X", k), name("S", k), day),
    )
    parts = [t(s, d, "customer").where(cond).select(a.alias("old_symbol"), b.alias("new_symbol"), at.alias("change_date")) for cond, a, b, at in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ORACLE = """
WITH RECURSIVE observed AS (
  SELECT 'S' || o_custkey AS symbol, CAST(min(o_orderdate) AS DATE) AS first_seen, CAST(max(o_orderdate) AS DATE) AS last_seen FROM orders GROUP BY 1
), dated AS (
  SELECT c_custkey AS k, DATE '1995-01-01' + CAST(c_custkey * 389 % 1400 AS INT) AS day FROM customer
), changes AS (
  SELECT 'S' || k AS old, 'S' || (k + 1) AS new, day AS d FROM dated WHERE k % 5 <> 4
  UNION SELECT 'S' || (k + 1), 'S' || k, day + 500 FROM dated WHERE k % 7 = 0 AND k % 5 <> 4
  UNION SELECT 'X' || k, 'S' || k, day FROM dated WHERE k % 17 = 0
), used AS (
  SELECT * FROM changes WHERE old IN (SELECT symbol FROM observed) OR new IN (SELECT symbol FROM observed)
), starts AS (
  SELECT old AS symbol, d FROM used UNION SELECT new, d FROM used
  UNION SELECT symbol, DATE '1900-01-01' FROM observed UNION SELECT old, DATE '1900-01-01' FROM used UNION SELECT new, DATE '1900-01-01' FROM used
), segments AS (
  SELECT symbol, d AS a, coalesce(lead(d) OVER (PARTITION BY symbol ORDER BY d) - 1, DATE '9999-12-31') AS b FROM starts
), links AS (
  SELECT o.symbol AS s1, o.a AS a1, n.symbol AS s2, n.a AS a2
  FROM used JOIN segments o ON o.symbol = old AND used.d - 1 BETWEEN o.a AND o.b JOIN segments n ON n.symbol = new AND used.d BETWEEN n.a AND n.b
), both_ways AS (
  SELECT * FROM links UNION SELECT s2, a2, s1, a1 FROM links
), reach AS (
  SELECT symbol AS s, a, symbol AS s2, a AS a2 FROM segments
  UNION SELECT r.s, r.a, e.s2, e.a2 FROM reach r JOIN both_ways e ON e.s1 = r.s2 AND e.a1 = r.a2
), heads AS (
  SELECT s, a, min((s2, a2)) AS head FROM reach GROUP BY 1, 2
), traded AS (
  SELECT head, symbol, g.a, g.b, greatest(first_seen, g.a) AS lo, least(last_seen, g.b) AS hi
  FROM segments g JOIN observed USING (symbol) JOIN heads h ON h.s = symbol AND h.a = g.a WHERE greatest(first_seen, g.a) <= least(last_seen, g.b)
), names AS (
  SELECT head, arg_max(symbol, (hi, a, symbol)) AS company_id FROM traded GROUP BY 1
)
SELECT company_id, symbol, a AS valid_from, b AS valid_to, lo AS first_traded, hi AS last_traded FROM traded JOIN names USING (head)
"""
register("c08_symbol_map", lambda s, d: identity.symbol_map(observed(s, d), changes(s, d)), ORACLE)
