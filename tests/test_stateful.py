"""Stateful streams over several micro-batches: late successes, expiries, quotas, keys that come again."""

import datetime as dt
import random
import zlib

import pandas as pd
import pytest

from tallyfield.streaming import incremental as st
from tallyfield.streaming import stateful as sf

T, D = dt.datetime, dt.date


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stateful stream over lists of rows, a micro-batch for each."""

    def go(make, schema, *batches):
        sf.use_rocksdb(spark)
        land = str(tmp_path / "land")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        return st.drain(make(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    return go


def test_look_back(streamed):
    row = lambda n, day, ts, status, source="s": (source, day, n, ts, status)
    got = streamed(
        lambda s: sf.look_back(s, 10), "source_id string, partition_key date, attempt_id long, ts timestamp, status string",
        [row(1, D(2024, 1, 1), T(2024, 1, 1, 9), "failed"), row(2, D(2024, 1, 1), T(2024, 1, 1, 8), None), row(3, D(2024, 1, 2), T(2024, 1, 2, 9), "failed"), row(4, D(2023, 12, 1), T(2024, 1, 1, 9), "success")],
        [row(5, D(2024, 1, 1), T(2024, 1, 11, 23), "success"), row(6, D(2024, 1, 1), T(2024, 1, 11, 23, 30), "success"), row(7, D(2024, 1, 3), T(2024, 1, 11, 9), "failed", None)],
        [row(8, D(2024, 1, 2), T(2024, 1, 13, 0), "success"), row(9, D(2024, 1, 12), T(2024, 1, 14), "failed")],  # too late for the second
        [row(10, D(2024, 1, 2), T(2024, 1, 15), "success"), row(11, D(2024, 1, 12), T(2024, 1, 15), "success")],
    )
    assert {(r.partition_key, r.outcome, r.at, r.tries) for r in got.collect()} == {
        (D(2024, 1, 1), "loaded", T(2024, 1, 11, 23), 3), (D(2024, 1, 2), "expired", T(2024, 1, 13), 1), (D(2024, 1, 12), "loaded", T(2024, 1, 15), 2),
    }


def test_admission(streamed):
    week1, week2 = T(2024, 1, 1), T(2024, 1, 8)
    h = dt.timedelta(hours=1)
    got = streamed(
        lambda s: sf.admitted(s, 2, ("exit",), ("off",), salts=4), "alert_id long, ts timestamp, kind string, dedupe_key string",
        [(1, week1, "a", "k1"), (2, week1 + h, "a", "k1"), (3, week1 + 2 * h, "off", "k2"), (4, week1 + 2 * h, "exit", "k3"), (5, week1 + 3 * h, "a", None)],
        [(6, week1 + 4 * h, "a", None), (7, week1 + 5 * h, "exit", "k3"), (8, week1 + 6 * h, "exit", "k4"), (9, week1 + 7 * h, None, "k5")],
        [(10, week2, "a", "k1"), (11, week2 + h, "a", "k6"), (12, week2 + h, "a", "k7"), (13, week2 + 2 * h, "a", "k8"), (14, week2 + 3 * h, "a", "k5")],
    )
    assert dict(got.select("alert_id", "verdict").collect()) == {
        1: "sent", 2: "duplicate", 3: "disabled", 4: "sent", 5: "sent", 6: "capped", 7: "duplicate", 8: "sent", 9: "capped", 10: "duplicate", 11: "sent", 12: "sent", 13: "capped", 14: "duplicate",
    }


def test_spaced_warnings(streamed):
    day = lambda n: D(2024, 1, 1) + dt.timedelta(n)
    got = streamed(lambda s: sf.spaced_warnings(s, 28), "company_id long, trade_date date", [(1, day(0)), (1, day(0)), (1, day(10)), (2, None)], [(1, day(28)), (2, day(3))], [(1, day(55)), (1, day(56))])
    assert sorted(tuple(r) for r in got.collect()) == [(1, day(0)), (1, day(28)), (1, day(56)), (2, day(3))]


class Maps:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.states, self.calls = {}, 0

    def state(self, name, *_):
        owner, held = self, self.states.setdefault(name, {})

        class State:
            def get(self):
                owner.calls += 1
                return held[()]

            def exists(self):
                return self.containsKey(())

            def update(self, value):
                self.updateValue((), value)

            def getValue(self, k):
                owner.calls += 1
                return held[k]

            def containsKey(self, k):
                owner.calls += 1
                return k in held

            def updateValue(self, k, value):
                owner.calls += 1
                held[k] = value

        return State()

    getMapState = getValueState = state


def test_admission_makes_no_call_for_each_row():
    rng = random.Random(5)
    for page, most in ((256, 400), (4, 10**9)):
        handle, seen, used, got, want = Maps(), set(), {}, {}, {}
        for batch in range(4):
            p = sf.FirstOfKey(7, ("exit",), ("off",))
            p.page = page
            p.init(handle)
            keys = [rng.choice([None, *(f'k"é{rng.randrange(9000)}' for _ in range(40))]) for _ in range(3000)]
            rows = [(D(2024, 1, 1) + dt.timedelta(7 * rng.randrange(2)), n, T(2024, 1, 1) + dt.timedelta(hours=rng.randrange(50)), rng.choice(["a", "exit", "off", None]), k, zlib.crc32((k or "").encode())) for n, k in enumerate(keys, 3000 * batch)]
            frame = pd.DataFrame(rows, columns=["week", "alert_id", "ts", "kind", "dedupe_key", "hash"])
            handle.calls = 0
            for out in p.handleInputRows((0,), iter([frame[:1000], frame[1000:]]), None):
                got.update(zip(out["alert_id"], out["verdict"]))
                assert all((v == "candidate") == (lane == 0) for v, lane in zip(out["verdict"], out["lane"]))
            assert handle.calls < most
            for week, n, _, kind, k, _ in sorted(rows, key=lambda r: (r[2], r[1])):
                repeat = k in seen
                seen |= {k} - {None}
                want[n] = "disabled" if kind == "off" else "duplicate" if repeat else "sent" if kind == "exit" else "candidate"
                if want[n] == "candidate":
                    used[week] = used.get(week, 0) + 1
                    want[n] = "candidate" if used[week] <= 7 else "capped"
        assert got == want
