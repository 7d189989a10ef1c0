from datetime import datetime as D

from skein.operators import orphans
from skein.operators.skew import hot_keys, salted_join
from pyspark.sql import functions as F

EDGES = "from_path string, to_path string, recorded_at timestamp, n_rows int"
FILES = "path string, last_indexed timestamp, n_rows int"
EVENTS = "type string, path string, ts timestamp"


def run(frame, edges, files, events):
    refs = orphans.reference_deltas({"e": (frame(edges, EDGES), "from_path", "to_path", "recorded_at")})
    log = orphans.change_log(refs, frame(files, FILES), "path", "last_indexed", frame(events, EVENTS).where("type = 'removed'"))
    return {(r.ref_path, r.target_path): r.kind for r in orphans.orphan_references(refs, orphans.key_counts(log)).collect()}


def test_cases(frame):
    t = [D(2025, 1, d) for d in range(1, 9)]
    edges = [
        ("a", "gone", t[3], 1), ("a", "gone", t[3], 1), ("a", "late", t[0], 1), ("a", "late", t[5], 1), ("a", "fine", t[3], 1), ("a", "removed", t[4], 1),
        ("a", "back", t[4], 1), ("a", None, t[0], 1), (None, "gone", None, 1), ("a", "untimed", t[0], 1), ("a", "nowhere", None, 1), ("b", "late", None, 1),
    ]
    files = [("late", t[2], 1), ("fine", t[1], 1), ("fine", t[6], 1), ("removed", t[1], 1), ("back", t[1], 1), ("back", t[6], 1), ("untimed", None, 1), (None, t[0], 1)]
    events = [("removed", "removed", t[4]), ("removed", "back", t[4]), ("updated", "fine", t[7]), ("removed", "gone", t[7]), ("removed", None, t[0])]
    got = run(frame, edges, files, events)
    assert got == {("a", "gone"): "missing", (None, "gone"): "missing", ("a", "late"): "early", ("a", "removed"): "removed", ("a", "nowhere"): "missing"}


def test_empty(frame):
    assert run(frame, [], [("a", None, 1)], []) == {}
    assert run(frame, [("a", "b", None, 1)], [], []) == {("a", "b"): "missing"}


def test_counts_merge_in_any_order(frame):
    t = [D(2025, 1, d) for d in range(1, 9)]
    edges = [("x", "a", t[0], 1), ("y", "a", t[3], 1), ("x", "b", t[0], 1), ("x", "b", t[0], 1), ("x", "c", None, 1)]
    files, events = [("a", t[1], 1), ("a", t[5], 1), ("b", t[2], 1), ("b", None, 1)], [("removed", "a", t[3]), ("removed", "b", t[1]), ("removed", "b", t[4])]

    def log(e, f, v):
        return orphans.change_log(orphans.reference_deltas({"e": (frame(e, EDGES), "from_path", "to_path", "recorded_at")}), frame(f, FILES), "path", "last_indexed", frame(v, EVENTS))

    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    whole = log(edges, files, events)
    for parts in ([(edges[:2], files[2:], events[1:]), (edges[2:], files[:2], events[:1])], [([], [], events), (edges, [], []), ([], files, [])]):
        state = log(*parts[0])
        for p in parts[1:]:
            state = orphans.merge_state(state, log(*p))
        assert rows(state) == rows(whole)
    counts = {r.target_path: (r.references, r.existence) for r in orphans.key_counts(whole).collect()}
    assert counts == {"a": (2, 1), "b": (2, 0), "c": (1, 0)}
    assert {r.target_path for r in orphans.orphan_keys(orphans.key_counts(whole)).collect()} == {"b", "c"}


def test_only_signed_counts_tell_these(frame):
    """A retracted reference is none; a record that comes back after its removal exists again; one removed twice does not."""
    t = [D(2025, 1, d) for d in range(1, 9)]
    edges = frame([("x", "gone", t[0], 1), ("x", "gone", t[1], 1), ("y", "gone", t[0], 1), ("x", "back", t[4], 1), ("x", "twice", t[4], 1)], EDGES)
    taken = frame([("x", "gone", t[2], 1), ("x", "gone", t[3], 1)], EDGES)
    refs = orphans.reference_deltas({"e": (edges, "from_path", "to_path", "recorded_at")}, {"e": (taken, "from_path", "to_path", "recorded_at")})
    assert {(r.ref_path, r.target_path): r.n_rows for r in refs.collect()} == {("x", "gone"): 0, ("y", "gone"): 1, ("x", "back"): 1, ("x", "twice"): 1}
    files = frame([("back", t[0], 1), ("back", t[3], 1), ("twice", t[0], 1), ("twice", t[2], 1)], FILES)
    events = frame([("removed", "back", t[2]), ("removed", "twice", t[1]), ("removed", "twice", t[3])], EVENTS)
    counts = orphans.key_counts(orphans.change_log(refs, files, "path", "last_indexed", events))
    assert {r.target_path: (r.references, r.existence, r.appeared) for r in counts.collect()} == {"gone": (1, 0, 0), "back": (1, 1, 2), "twice": (1, 0, 2)}
    assert {(r.ref_path, r.target_path, r.kind) for r in orphans.orphan_references(refs, counts).collect()} == {("y", "gone", "missing"), ("x", "twice", "removed")}


def test_report(frame):
    o = frame([("e", "a", "x", D(2025, 3, 4), 2, "missing"), ("e", "b", "x", D(2025, 3, 9), 1, "missing"), ("e", "b", "y", None, 1, "missing")], "ref_table string, ref_path string, target_path string, recorded_at timestamp, n_rows int, kind string")
    assert sorted(map(tuple, orphans.orphan_report(o).collect()), key=str) == [("e", "2025-03", "missing", 2, 1, 3), ("e", None, "missing", 1, 1, 1)]


def test_hot_keys_are_salted_and_nothing_is_lost(frame):
    big = frame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(200)] + [(None, 1)], "k string, n int")
    small = frame([("hot", "H"), ("k7", "S")], "k string, v string")
    assert [r.k for r in hot_keys(big, "k", 0.1).collect()] == ["hot"]
    got = salted_join(big, small, "k", [F.col("n")], share=0.1, salts=4)
    assert got.count() == 501 and got.where("v = 'H'").count() == 300 and got.where("v = 'S'").count() == 1
    assert salted_join(big, small, "k", [F.col("n")], "left_anti", share=0.1, salts=4).count() == 200
