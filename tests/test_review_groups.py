"""The review state of a group of records is read and written once, and goes decision by decision."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd

from tallysheet.streaming.review_state import LatestDecision


class Held:
    """The part of a list state and its handle that the processor calls, with its calls counted."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def registerTimer(self, ms):
        self.timers.append(ms)

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.rows = []


def day(n):
    return dt.datetime(2026, 1, n)


def ms(n):
    return int(day(n).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_a_group_is_one_list():
    held, processor = Held(), LatestDecision()
    processor.init(held)
    now = lambda n: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms(n))
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["record_id", "decided_at", "decision_id", "status", "user_id"])])
    first = batch(*[(f"r{i}", day(5 + i % 2), "1", "draft", None) for i in range(100)])
    assert len(pd.concat(processor.handleInputRows((0,), first, now(1)))) == 100
    assert held.calls == 1 and held.timers == [ms(5)]
    # older, the same again, equal time with a higher id
    again = batch(("r0", day(4), "9", "approved", "u"), ("r1", day(6), "1", "draft", None), ("r2", day(5), "2", "rejected", "u"))
    out = pd.concat(processor.handleInputRows((0,), again, now(2)))
    assert out.values.tolist() == [["r2", pd.Timestamp(day(5)), "2", "rejected", "u"]]
    list(processor.handleExpiredTimer((0,), now(5), None))
    assert len(held.rows) == 50 and held.timers[-1] == ms(6)
    list(processor.handleExpiredTimer((0,), now(6), None))
    assert held.rows == []
