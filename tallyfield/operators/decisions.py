"""Exit rules, plans, audits and admission rules as column expressions over joined tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lake import stored
from .evaluate import wilson_lower
from .money import net_edge

c = F.col


def exit_rules(states: DataFrame, gain: float = 0.1, stop_atr: float = 2.0, trail_atr: float | None = None, window: int = 5) -> DataFrame:
    """Adds `rules`: the exit rules that a trade meets, in the order stop, trailing stop, target or time."""
    none = F.lit(None).cast("string")
    stop = F.when(c("last_close") <= c("cost_per_share") - stop_atr * c("atr_14"), "stop_loss")
    trail = F.when(c("last_close") <= c("peak_close") - trail_atr * c("atr_14"), "trailing_stop") if trail_atr else none
    target = F.when((c("last_close") >= c("cost_per_share") * (1 + gain)) & (c("net_profit_if_sold") > 0), "target_reached").when(c("sessions_held") >= window, "time_stop")
    found = F.filter(F.array(stop, trail, target), lambda x: x.isNotNull())
    return states.withColumn("rules", F.when(c("is_trade"), found).otherwise(F.array().cast("array<string>")))


def review_note(last: Column, cost: Column, is_trade: Column, line: float = 0.15) -> Column:
    return F.coalesce(~is_trade & (F.try_divide(last, cost) - 1 <= -line), F.lit(False))


def market_regime(sma_gap: Column, vix_pct: Column, cut: float = 0.8) -> Column:
    return F.when(F.coalesce((sma_gap < 0) & (vix_pct >= cut), F.lit(False)), "stress").otherwise("normal")


def drawdown_state(index: DataFrame, lookback: int = 126, review: float = -0.08, pause: float = -0.12) -> DataFrame:
    """Adds the fall from the best value of the last `lookback` rows and what it triggers."""
    w = Window.partitionBy("company_id").orderBy("trade_date").rowsBetween(-(lookback - 1), 0)
    fall = c("close") / F.max("close").over(w) - 1
    return index.select("company_id", "trade_date", fall.alias("from_peak")).withColumns({"review": c("from_peak") <= review, "pause_buys": c("from_peak") <= pause})


def plan_exits(states: DataFrame) -> DataFrame:
    """One action per holding: an exit rule, else a safety warning, else a crash signal, else review or hold."""
    action = F.when(F.size("rules") > 0, "EXIT").when(F.coalesce(c("safety"), F.lit(False)), "EXIT").when(F.coalesce(c("crash"), F.lit(False)), "EXIT").when(c("review"), "REVIEW").otherwise("HOLD")
    priority = F.when(F.size("rules") > 0, 0).when(F.coalesce(c("safety"), F.lit(False)), 1).when(F.coalesce(c("crash"), F.lit(False)), 2).when(c("review"), 3).otherwise(4)
    return states.withColumns({"action": action, "priority": priority})


def plan_opportunities(candidates: DataFrame, budgets: DataFrame, cap: float, minimum: float, most: int = 5) -> DataFrame:
    """Greedy whole-share buys for many accounts: best net edge first, each within cash and cap, at most `most`.

    One round for each buy: of an account's candidates behind the one bought last, the first that the cash left can pay for at least
    `minimum`. What was passed over with more cash can't be bought with less, so no list of candidates is needed: a round
    is a join and an aggregation that keeps one row for each account.
    """
    j = candidates.join(budgets, "account").withColumn("edge", F.round(net_edge(c("expected_gain"), F.least(c("budget"), F.lit(cap))), 9)).where("edge > 0")
    offers = stored(j.select("account", F.struct((-c("edge")).alias("k"), c("company_id").cast("string").alias("company_id"), "close").alias("x")))
    state = budgets.select(c("account").alias("__account"), c("budget").cast("double").alias("cash"), F.lit(None).cast(offers.schema["x"].dataType).alias("last"))
    bought = []
    for _ in range(most):
        close = c("x.close")
        quantity = F.floor(F.least(c("cash"), F.lit(cap)) / close).cast("long")
        open_offers = offers.join(state, c("account") == c("__account")).where((c("last").isNull() | (c("x") > c("last"))) & (quantity * close >= minimum))
        best = open_offers.groupBy("account").agg(F.min(F.struct("x", "cash")).alias("m")).select("account", "m.x", "m.cash")
        best = stored(best.select("account", "x", quantity.alias("quantity"), (c("cash") - quantity * close).alias("cash")))
        bought.append(best.select("account", "x.company_id", "quantity", c("x.close").alias("price")))
        state = best.select(c("account").alias("__account"), "cash", c("x").alias("last"))
    return reduce(DataFrame.unionByName, bought)


def watch_queue(candidates: DataFrame, chosen: DataFrame, n: int = 15) -> DataFrame:
    rest = candidates.join(chosen.select("row_id"), "row_id", "left_anti")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("p"), "row_id")).cast("long")).where(c("rank") <= n)


def closest_candidate(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """On dates without a chosen candidate, the one that came closest: the largest p, then the smallest row_id."""
    none = candidates.join(chosen.select("trade_date").distinct(), "trade_date", "left_anti")
    return none.groupBy("trade_date").agg(F.max_by(F.struct("row_id", "p"), F.struct(c("p"), -c("row_id"))).alias("x")).select("trade_date", "x.row_id", "x.p")


def issued_signals(plans: DataFrame) -> DataFrame:
    """(plan_id, trade_date, signal, row_id, p) of saved plans (plan_id, trade_date, payload as JSON).

    Opportunities are signal A; exits are signal C if they carry a probability, since those by rule carry none.
    """
    item = "array<struct<row_id:bigint,p:double>>"
    x = plans.withColumn("x", F.from_json("payload", f"opportunities {item}, exits {item}"))
    buys = x.select("plan_id", "trade_date", F.lit("A").alias("signal"), F.explode("x.opportunities").alias("i"))
    exits = x.select("plan_id", "trade_date", F.lit("C").alias("signal"), F.explode(F.filter("x.exits", lambda e: e["p"].isNotNull())).alias("i"))
    return buys.unionByName(exits).select("plan_id", "trade_date", "signal", "i.row_id", "i.p")


def match_import(holdings: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, rejects) of imported holdings (symbol, isin, ...).

    A symbol means the company that traded under it last (company_id, symbol, isin, trade_date); unknown symbols and those
    whose ISIN differs from the traded one go to the rejects with a reason.
    """
    latest = prices.groupBy("symbol").agg(F.max_by(F.struct("company_id", F.col("isin").alias("traded_isin")), F.struct("trade_date", "company_id")).alias("m")).select("symbol", "m.*")
    j = holdings.join(latest, "symbol", "left")
    reason = F.when(c("company_id").isNull(), "unknown").when(c("isin") != c("traded_isin"), "isin_conflict")
    j = j.withColumn("reason", reason)
    return j.where("reason is null").drop("reason", "traded_isin"), j.where("reason is not null").select(*holdings.columns, "reason")


def action_log(plans: DataFrame, actions: DataFrame, start: str, end: str) -> DataFrame:
    """(trade_date, item_key, action, acted_at) logged for the plans of a period."""
    period = plans.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return actions.join(period.select("plan_id", "trade_date"), "plan_id").select("trade_date", "item_key", "action", "acted_at")


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("trade_date").alias("days"))


def reason_drivers(contributions: DataFrame, phrases: dict[str, str], k: int = 3) -> DataFrame:
    """The k largest positive contributions that have a phrase, as one line."""
    told = F.create_map(*[x for n, t in phrases.items() for x in (F.lit(n), F.lit(t))])
    parts = F.array(*[F.struct(c(n).alias("x"), F.lit(n).alias("name")) for n in phrases])
    good = F.slice(F.reverse(F.array_sort(F.filter(parts, lambda p: p["x"] > 0))), 1, k)
    return contributions.withColumn("reason", F.array_join(F.transform(good, lambda p: F.concat(told[p["name"]], F.lit(" "), F.format_string("%.2f", p["x"]))), "; "))


def goal_feasibility(bars: DataFrame, target: float) -> DataFrame:
    """How often a company reached the monthly target, and what that target means a year."""
    w = Window.partitionBy("company_id").orderBy("trade_date")
    r = bars.select("company_id", (F.try_divide("close", F.lag("close", 21).over(w)) - 1).alias("r"))
    out = r.groupBy("company_id").agg(F.avg((c("r") >= target).cast("double")).alias("rate"))
    band = F.when(F.lit(target) <= 0.01, "realistic").when(F.lit(target) <= 0.03, "ambitious").otherwise("unlikely")
    return out.withColumns({"band": band, "yearly": F.lit((1 + target) ** 12 - 1)})


def scorecards(issued: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per signal: issued, matured, correct, pending, precision and its Wilson lower bound."""
    j = issued.join(labels, keys, "left")
    out = j.groupBy("signal").agg(F.count("*").alias("issued"), F.count("label").alias("matured"), F.count(F.when(c("label"), 1)).alias("correct"))
    return out.withColumns({"pending": c("issued") - c("matured"), "precision": F.try_divide("correct", "matured"), "lower": wilson_lower(c("correct"), c("matured"))})


def missed_events(issued: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per signal of `labels` (*keys, signal, label): events that happened, those flagged beforehand, and those missed."""
    happened = labels.where("label").select(*keys, "signal")
    flags = issued.select(*keys, "signal", F.lit(1).alias("flagged")).distinct()
    per = happened.join(flags, [*keys, "signal"], "left").groupBy("signal").agg(F.count("*").alias("events"), F.count("flagged").alias("flagged"))
    return per.withColumn("missed", c("events") - c("flagged"))


def audit_health(scores: DataFrame, attempts: DataFrame, latest: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: worst and mean score, unresolved failures, failed attempts since made good, runs, open quarantine by severity.

    `quarantine` has (severity, resolved_at); open rows have no resolved_at.
    """
    a = scores.agg(F.min("score").alias("worst"), F.round(F.avg("score"), 4).alias("mean"))
    failed = F.count(F.when(c("status") == "failed", 1))
    b = latest.agg(failed.alias("unresolved"))
    r = attempts.agg(failed.alias("failed"), F.count("*").alias("runs"))
    open_ = lambda s: F.count(F.when(c("resolved_at").isNull() & (c("severity") == s), 1))
    q = quarantine.agg(open_("BLOCK").alias("open_block"), open_("WARN").alias("open_warn"))
    # four one-row tables side by side
    return a.crossJoin(b).crossJoin(r).crossJoin(q).withColumn("retried", c("failed") - c("unresolved")).drop("failed")


def proposals(cards: DataFrame, least: int) -> DataFrame:
    text = F.when(c("matured") < least, F.concat(F.lit("keep "), c("signal"), F.lit(": too few results"))).when(c("precision") < 0.5, F.concat(F.lit("switch off "), c("signal"))).otherwise(F.concat(F.lit("keep "), c("signal")))
    return cards.select("signal", text.alias("proposal"))


def alert_admission(alerts: DataFrame, per_week: int = 3, exempt: tuple[str, ...] = ("error",), disabled: tuple[str, ...] = ()) -> DataFrame:
    """Adds `verdict`: disabled, duplicate (same key seen before), capped (week's quota used) or sent.

    Only the first `per_week` alerts that count against a week's quota are ever sent, and a bounded list of them per
    week is all that the comparison needs: no task orders a whole week.
    """
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("ts", "alert_id")) == 1
    out = alerts.withColumns({"off": c("kind").isin(*disabled) if disabled else F.lit(False), "first": first, "week": F.date_trunc("week", "ts")})
    out = out.withColumn("counts", ~c("off") & c("first") & ~c("kind").isin(*exempt))
    place = F.struct("ts", "alert_id")
    by_hour = out.where("counts").groupBy("week", F.date_trunc("hour", "ts").alias("hour")).agg(F.slice(F.array_sort(F.collect_list(place)), 1, per_week).alias("xs"))
    quota = by_hour.groupBy("week").agg(F.slice(F.array_sort(F.flatten(F.collect_list("xs"))), 1, per_week).alias("xs")).select("week", F.element_at("xs", -1).alias("last"))
    out = out.join(quota, "week", "left")
    return out.withColumn("verdict", F.when(c("off"), "disabled").when(~c("first"), "duplicate").when(c("counts") & (place > c("last")), "capped").otherwise("sent")).drop("off", "first", "week", "counts", "last")


#: Fixed pattern: an amount of money in a text.
MONEY = r"(?i)(₹|\brs\.?|\binr)\s*-?\d"


def redact_guard(texts: DataFrame, column: str) -> DataFrame:
    return texts.withColumn("has_amount", F.coalesce(c(column).rlike(MONEY), F.lit(False)))


def confidence_buckets(holdings: DataFrame, bar: float, quiet_days: int, today: str) -> DataFrame:
    """Each holding in one bucket: sell, quiet (reviewed lately), sell_watch (at the bar or above) or hold."""
    quiet = F.coalesce(F.datediff(F.lit(today).cast("date"), "reviewed") < quiet_days, F.lit(False))
    return holdings.withColumn("bucket", F.when(c("action") == "EXIT", "sell").when(quiet, "quiet").when(c("p") >= bar, "sell_watch").otherwise("hold"))


def judge_money(results: DataFrame, index_xirr: float, index_drawdown: float, extra: float = 0.1, share: float = 0.6) -> DataFrame:
    """Per cutoff whether it beats the index, also under stress, without a much deeper fall, in enough years, with a neighbour that beats it too."""
    w = Window.orderBy("cutoff")  # a dozen cutoffs
    beats = c("xirr") > index_xirr
    out = results.withColumn("beats", beats)
    near = F.coalesce(F.lag("beats").over(w), F.lit(False)) | F.coalesce(F.lead("beats").over(w), F.lit(False))
    ok = c("beats") & (c("xirr_stress") > index_xirr) & (c("max_drawdown") >= index_drawdown - extra) & (c("won") / c("years") >= share) & near
    return out.withColumn("ok", ok)


def money_gate(judged: DataFrame) -> DataFrame:
    """One row: the best cutoff under stress, of those that pass if any does; LIVE with it, or OFF with the closest result."""
    best = judged.agg(F.max_by(F.struct("cutoff", "xirr", "xirr_stress", "ok"), F.struct("ok", F.coalesce("xirr_stress", F.lit(-1.0)), -c("cutoff"))).alias("x")).select("x.*")
    return best.select(F.when(c("ok"), "LIVE").otherwise("OFF").alias("status"), F.when(c("ok"), c("cutoff")).alias("cutoff"), c("cutoff").alias("closest"), "xirr", "xirr_stress")
