"""Changes that wait in the state store: released by their timers, by no other row and never lost."""

import datetime as dt

from retailops.session import scratch_path
from retailops.streaming.ingest import read_rejects, read_state
from retailops.streaming.timers import ingest_timed, read_waiting

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k long, op int, seq long, ts timestamp_ntz, v double, busy boolean, news boolean"


def sec(n):
    return T0 + dt.timedelta(seconds=n)


class Feed:
    def __init__(self, spark):
        self.spark, self.src, self.work, self.n = spark, scratch_path(spark, "feed"), scratch_path(spark, "timed"), 0
        self.target = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k long, v double")

    def run(self, *rows):
        """Deliver a file and run the stream to its end; a new run each time, as after a restart."""
        full = [(*r, *(None,) * (7 - len(r))) for r in rows]
        self.spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{self.src}/s={self.n:03d}")
        self.n += 1
        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.src)
        ingest_timed(stream, self.target, ["k"], self.work, "ts", 10, busy_col="busy", marker="news", compact_every=2)
        state = sorted(map(tuple, read_state(self.spark, self.work, ["k"])[0].collect()))
        waiting = read_waiting(self.spark, self.work, stream.schema)
        return state, sorted((r.k, r.seq) for r in waiting.collect())


def test_timers_release_at_the_settle_time_over_restarts(spark):
    f = Feed(spark)
    state, waiting = f.run((1, 1, 1, sec(0), 1.0), (1, 1, 2, sec(5), 2.0), (1, 1, 2, sec(5), 2.0), (2, 1, 3, sec(10), 3.0))
    assert state == [(1, 1.0), (2, 0.0)] and waiting == [(1, 2), (1, 2), (2, 3)]  # 0 s is 10 s older: settled
    state, waiting = f.run((1, 1, 9, dt.datetime(2099, 1, 1), 9.0), (2, 1, 8, None, 8.0), (None, 1, 7, sec(1), 7.0))
    assert state == [(1, 1.0), (2, 0.0)] and waiting == [(1, 2), (1, 2), (1, 9), (2, 3)]  # a far row settles nothing
    assert sorted((r.seq, r.v) for r in read_rejects(spark, f.work).collect()) == [(7, 7.0), (8, 8.0)]
    state, waiting = f.run((2, 1, 4, sec(17), 4.0), (1, 1, 0, sec(-99), 5.0))
    assert state == [(1, 2.0), (2, 0.0)] and waiting == [(1, 9), (2, 3), (2, 4)]  # late: taken, too old to count
    state, waiting = f.run((3, 1, 5, sec(40), 6.0))
    assert state == [(1, 2.0), (2, 4.0)] and waiting == [(1, 9), (3, 5)]


def test_keys_in_progress_hold_their_changes(spark):
    f = Feed(spark)
    state, waiting = f.run((1, 1, 1, sec(0), 1.0, True), (2, 1, 2, sec(0), 2.0), (2, 1, 3, sec(60), 3.0))
    assert state == [(1, 0.0), (2, 2.0)] and waiting == [(1, 1), (2, 3)]
    state, waiting = f.run((1, 3, 4, sec(1), None))  # settled, but the key is still in progress
    assert state == [(1, 0.0), (2, 2.0)] and waiting == [(1, 1), (1, 4), (2, 3)]
    state, waiting = f.run((1, None, 5, sec(2), None, False, True))  # news only: free; the delete is the last change
    assert state == [(2, 2.0)] and waiting == [(2, 3)]


def test_timed_queries_equal_the_pending_tables(spark):
    from retailops.workloads import streaming_q as q
    from conftest import SF_SMALL
    for a, b in ((q.j1, q.j1b), (q.j2, q.j2b)):
        x, y = a(spark, SF_SMALL), b(spark, SF_SMALL)
        assert sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect()))


def test_a_key_has_one_timer_and_its_hold_is_written_once():
    from collections import Counter, namedtuple
    from types import SimpleNamespace

    from retailops.streaming.timers import SettleProcessor
    R = namedtuple("R", "at_ms seq busy body")
    calls, timers = Counter(), []

    class Value:
        now = None

        def get(self):
            calls["get"] += 1
            return self.now

        def update(self, v):
            calls["update"] += 1
            self.now = v

    class List(list):
        get = list.copy
        appendList = list.extend

        def put(self, rows):
            self[:] = rows

    waiting, hold = List(), Value()
    p = SettleProcessor()
    p.init(SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: hold, registerTimer=timers.append))
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert [*p.handleInputRows((1,), iter([R(ms, ms, None, str(ms)) for ms in (30, 10, 20, 40)]), at(0))] == []
    assert timers == [10] and calls == {"get": 1}
    assert [r._row for r in p.handleExpiredTimer((1,), at(25), None)] == ["10", "20"] and timers == [10, 30]
    assert [*p.handleInputRows((1,), iter([R(ms, ms, True, str(ms)) for ms in (50, 60, 70)]), at(25))] == []
    assert timers == [10, 30] and calls["update"] == 1  # in progress: no timer
    assert [*p.handleExpiredTimer((1,), at(35), None)] == []
    assert [r._row for r in p.handleInputRows((1,), iter([R(55, 80, False, None)]), at(55))] == ["30", "40", "50"]
    assert timers == [10, 30, 60] and sorted(waiting) == [(60, "60"), (70, "70")]
    got = p.handleInputRows((2,), iter([R(None, 1, None, "bad"), R(99, 2, None, "99")]), at(55))
    assert next(got) == ("bad", True) and (99, "99") in waiting  # kept before a row comes out and the next key is current
