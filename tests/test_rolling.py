from datetime import datetime as D

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators import rolling

SCHEMA = "task_id string, session_id string, completed_at timestamp, optimized_tokens long, saved_tokens long, day int"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(-9, 9), min_size=1), st.integers(1, 9))
def test_queue_is_a_window(values, size):
    days = sorted(values.items())
    for monoid in ((0, lambda a, b: a + b), ("", lambda a, b: a + b), (-99, max)):
        put = (lambda v: str(v)) if monoid[0] == "" else (lambda v: v)
        got = list(rolling.windows([(d, put(v)) for d, v in days], size, monoid))
        assert [d for d, _ in got] == list(range(days[0][0], days[-1][0] + 1))
        for d, fold in got:
            want = monoid[0]
            for x in range(d - size + 1, d + 1):
                if x in values:
                    want = monoid[1](want, put(values[x]))
            assert fold == want


def rows(frame, data):
    df = frame(data, SCHEMA)
    days = rolling.daily(df, "session_id", "task_id", "completed_at", "optimized_tokens", "saved_tokens")
    return {(r.entity, r.window_days): r.peak_day for r in rolling.peak_days(days).collect()}, rolling.rolling_totals(days)


def test_days_without_tasks_copies_and_nulls(frame):
    t = lambda d: D(2025, 1, d, 23, 59)
    data = [("a", "s", t(1), 10, 5, 0), ("a", "s", t(1), 10, 5, 0), ("b", "s", t(10), 10, None, 0), ("c", "s", None, 1, 99, 0), ("d", "s", t(12), 1, 5, 0), (None, "q", t(3), 1, -4, 0), (None, "q", t(3), 1, -4, 0), ("e", None, t(2), None, None, 0)]
    peaks, totals = rows(frame, data)
    assert peaks[("s", 7)] == "2025-01-01" and peaks[("s", 30)] == "2025-01-12" and peaks[("q", 7)] == "2025-01-03" and peaks[(None, 7)] == "2025-01-02"
    s = {(r.entity, str(r.day), r.window_days): r for r in totals.collect()}
    assert len([k for k in s if k[0] == "s"]) == 24
    gap = s[("s", "2025-01-09", 7)]
    assert (gap.n_tasks, gap.saved_total, gap.saved_avg, gap.best_day_saved) == (0, 0, None, None)
    assert s[("s", "2025-01-12", 30)].saved_total == 10 and s[("q", "2025-01-03", 7)].saved_total == -8


def test_empty(frame):
    peaks, totals = rows(frame, [])
    assert peaks == {} and totals.collect() == []
