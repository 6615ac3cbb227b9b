"""Stateful streams with timers and quotas: files that are late, alerts under a weekly cap, spaced warnings.

Each is a `StatefulProcessor` over RocksDB state. Keys with their state are dealt over the executors; a row's state is
read and written for its own key only, and timers clear what can't be needed any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind is kept by RocksDB only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


class LookBack(StatefulProcessor):
    """A partition is tried until it succeeds, or until `days` days behind it are over."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "tries long, loaded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["ts", "attempt_id"])
        over = pd.Timestamp(key[1], tz="UTC") + pd.Timedelta(days=self.days + 1)
        tries, loaded = self.state.get() if self.state.exists() else (None, False)
        if tries is None:
            if _ms(over) <= timerValues.getCurrentWatermarkInMs() or all(self._at(t) >= over for t in given["ts"]):
                return  # nothing of it lies in the look-back
            self.handle.registerTimer(_ms(over))
            tries = 0
        for at, status in zip(given["ts"], given["status"]):
            if loaded or self._at(at) >= over:
                break
            tries += 1
            if status == "success":
                loaded = True
                yield pd.DataFrame({"source_id": [key[0]], "partition_key": [key[1]], "outcome": ["loaded"], "at": [at], "tries": [tries]})
        self.state.update((tries, loaded))

    @staticmethod
    def _at(t) -> pd.Timestamp:
        t = pd.Timestamp(t)
        return t.tz_localize("UTC") if t.tzinfo is None else t.tz_convert("UTC")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tries, loaded = self.state.get()
        self.state.clear()
        if not loaded:
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame({"source_id": [key[0]], "partition_key": [key[1]], "outcome": ["expired"], "at": [at], "tries": [tries]})

    def close(self) -> None:
        pass


def look_back(attempts: DataFrame, days: int = 10, delay: str = "1 hour") -> DataFrame:
    """(source_id, partition_key, outcome, at, tries) of a stream of (source_id, partition_key date, attempt_id, ts, status).

    One row for each partition: 'loaded' at its first success within `days` days after it, with the attempts up to then;
    or 'expired' when the watermark passes that time without one. Attempts behind either change nothing, those of a batch are taken in
    order of time. Null statuses are failures; rows with a null key, or time, are left out.
    """
    given = attempts.where("source_id is not null and partition_key is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    out = "source_id string, partition_key date, outcome string, at timestamp, tries long"
    return given.withWatermark("ts", delay).groupBy("source_id", "partition_key").transformWithStateInPandas(LookBack(days), out, "Append", "EventTime")


class FirstOfKey(StatefulProcessor):
    """Repeats of a key; of the other candidates the first `cap` of each week stay candidates, what comes after these is capped for certain.

    The keys seen lie in pages by their hash, each one value of the state, so a batch makes a call for each page it meets and
    none for each row. When there are more than `page` keys a page, the pages are dealt anew into four times as many.
    """

    def __init__(self, cap: int, exempt: tuple[str, ...], disabled: tuple[str, ...], page: int = 256):
        self.cap, self.exempt, self.disabled, self.page = cap, exempt, disabled, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "page long", "keys string")
        self.size = handle.getValueState("size", "pages long, keys long")
        self.used = handle.getMapState("used", "week date", "n long")

    def _read(self, page: int) -> dict[str, int]:
        """A page's keys with their hashes."""
        return json.loads(self.seen.getValue((page,))[0]) if self.seen.containsKey((page,)) else {}

    def _write(self, page: int, keys: dict[str, int]) -> None:
        self.seen.updateValue((page,), (json.dumps(keys),))

    def _grown(self, pages: int, keys: int) -> int:
        """The number of pages that `keys` keys need; what the present ones hold is dealt anew."""
        to = pages
        while keys > to * self.page:
            to *= 4
        for page in range(pages) if to > pages else ():
            parts: dict[int, dict[str, int]] = {page: {}}
            for k, h in self._read(page).items():  # they go to pages of the same remainder
                parts.setdefault(h % to, {})[k] = h
            for at, part in parts.items():
                self._write(at, part)
        return to

    def _repeats(self, given: pd.DataFrame) -> np.ndarray:
        """Whether a row's key came before, in the batch or in one before; the state knows the batch's keys then."""
        keyed = given["dedupe_key"].notna()
        repeat = (keyed & given["dedupe_key"].duplicated()).to_numpy()
        at = np.flatnonzero(keyed.to_numpy() & ~repeat)
        if not len(at):
            return repeat
        pages, n = self.size.get() if self.size.exists() else (1, 0)
        pages = self._grown(pages, n + len(at))
        keys, hashes = given["dedupe_key"].to_numpy()[at], given["hash"].to_numpy()[at]
        page = hashes % pages
        order = np.argsort(page, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(page[order])) + 1):
            known = self._read(int(page[mine[0]]))
            before = len(known)
            for i in mine:
                if keys[i] in known:
                    repeat[at[i]] = True
                else:
                    known[keys[i]] = int(hashes[i])
            if len(known) > before:
                self._write(int(page[mine[0]]), known)
                n += len(known) - before
        self.size.update((pages, n))
        return repeat

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["ts", "alert_id"], ignore_index=True)
        repeat = self._repeats(given)
        disabled, exempt = (given["kind"].isin(kinds).to_numpy() for kinds in (self.disabled, self.exempt))
        verdicts = np.select([disabled, repeat, exempt], ["disabled", "duplicate", "sent"], "candidate").astype(object)
        codes, weeks = pd.factorize(given["week"], use_na_sentinel=False)
        for code, week in enumerate(weeks):
            at = np.flatnonzero((codes == code) & (verdicts == "candidate"))
            if not len(at):
                continue
            week = None if pd.isna(week) else week
            used = self.used.getValue((week,))[0] if self.used.containsKey((week,)) else 0
            self.used.updateValue((week,), (used + len(at),))
            verdicts[at[max(self.cap - used, 0) :]] = "capped"
        out = given[["week", "alert_id", "ts"]].assign(verdict=verdicts)
        yield out.assign(lane=(out["verdict"] != "candidate").astype("int64") * (key[0] + 1))

    def close(self) -> None:
        pass


class WeeklyQuota(StatefulProcessor):
    """The first `cap` candidates of a week are sent; other rows pass with their verdicts."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["ts", "alert_id"])
        used = self.used.get()[0] if self.used.exists() else 0
        rank = used + (given["verdict"] == "candidate").cumsum()
        self.used.update((int(rank.iloc[-1]),))
        yield given[["alert_id"]].assign(verdict=given["verdict"].where(given["verdict"] != "candidate", (rank <= self.cap).map({True: "sent", False: "capped"})))

    def close(self) -> None:
        pass


def admitted(alerts: DataFrame, per_week: int, exempt: tuple[str, ...] = (), disabled: tuple[str, ...] = (), salts: int = 64, page: int = 256) -> DataFrame:
    """(alert_id, verdict) of a stream of (alert_id, ts, kind, dedupe_key): disabled, duplicate, capped or sent.

    Alerts count in order of time, then id, within a batch; batches in the order of their arrival. Weeks begin on Monday.
    Keys are dealt to `salts` states that remember them, in pages of a few hundred, and each lets at most `per_week` candidates of a week through: a week's own
    state, which decides on the quota, meets at most salts x per_week rows, however many alerts there are. Alerts
    without a key repeat none.
    """
    h = F.xxhash64(F.coalesce("dedupe_key", F.col("alert_id").cast("string"))).bitwiseAND(F.lit((1 << 63) - 1))
    given = alerts.select("alert_id", F.col("ts").cast("timestamp").alias("ts"), F.date_trunc("week", "ts").cast("date").alias("week"), "kind", "dedupe_key", h.alias("hash"))
    given = given.withColumn("salt", F.col("hash") % salts).withColumn("hash", F.expr(f"hash div {salts}"))
    kind = alerts.schema["alert_id"].dataType.simpleString()
    first = given.groupBy("salt").transformWithStateInPandas(FirstOfKey(per_week, exempt, disabled, page), f"week date, alert_id {kind}, ts timestamp, verdict string, lane long", "Append", "None")
    return first.groupBy("week", "lane").transformWithStateInPandas(WeeklyQuota(per_week), f"alert_id {kind}, verdict string", "Append", "None")


class Spaced(StatefulProcessor):
    """At most one warning in `days` days; the last kept day is the state."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for day in sorted({d for batch in rows for d in batch["trade_date"] if d is not None}):
            if last is None or (pd.Timestamp(day) - pd.Timestamp(last)).days >= self.days:
                kept.append(day)
                last = day
        if kept:
            self.last.update((last,))
            yield pd.DataFrame({"company_id": [key[0]] * len(kept), "trade_date": kept})

    def close(self) -> None:
        pass


def spaced_warnings(stream: DataFrame, days: int = 28) -> DataFrame:
    """At most one warning per company in `days` days, in date order within a batch and over the batches."""
    return stream.groupBy("company_id").transformWithStateInPandas(Spaced(days), "company_id long, trade_date date", "Append", "None")
