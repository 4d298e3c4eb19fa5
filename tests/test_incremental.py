import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators.incremental import IntervalLedger, StoppedBeforeCommit, planned_changes, real_changes, run_gaps
from quarrylens.operators.skew import interval_of, merged, next_match, previous_row

RUNS = "run_id long, repository_root string, status string, started_at_ms long, extra string"
CHANGES = "change_id long, repository_root string, file_path string, change_kind string, mtime_ns long, content_hash string, walked_at_ms long, extra string"


def plan(spark, runs, changes):
    r = spark.createDataFrame(runs, RUNS)
    c = spark.createDataFrame(changes, CHANGES)
    return sorted((x.run_id, x.change_id) for x in planned_changes(r, c).collect())


def brute(runs, changes):
    runs = sorted({r for r in runs if r[2] == "ok" and r[3] is not None}, key=lambda r: (r[3], r[0]))
    by: dict = {}
    for c in sorted({c[:7] for c in changes}, key=lambda c: (c[1] or "", c[2] or "", c[6] if c[6] is not None else -1, c[0])):
        by.setdefault((c[1], c[2]), []).append(c)
    out = []
    for records in by.values():
        before = None
        for c in records:
            same = before is not None and before[3:6] == c[3:6]
            before = c
            if same or c[1] is None or c[6] is None:
                continue
            for r in runs:
                if r[1] == c[1] and r[3] >= c[6]:
                    out.append((r[0], c[0]))
                    break
    return sorted(out)


def test_edge_cases(spark):
    runs = [(1, "a", "failed", 5, "x"), (2, "a", "ok", 10, "x"), (2, "a", "ok", 10, "x"), (3, "a", "ok", 20, "y"), (4, "b", "crashed", 9, "z"), (5, None, "ok", 9, "z"), (6, "a", "ok", None, None), (7, "a", "ok", 20, "tie")]
    changes = [
        (1, "a", "f", "upsert", 1, "h", 3, "x"), (1, "a", "f", "upsert", 1, "h", 3, "x"), (2, "a", "f", "upsert", 1, "h", 4, "redelivered"), (3, "a", "f", "delete", None, None, 10, None), (4, "a", "f", "delete", None, None, 11, None),
        (5, "a", "f", "upsert", 1, "h", 12, "back"), (6, "a", "g", "upsert", 0, "h", 99, "too late"), (7, "b", "g", "upsert", 0, "h", 1, "no good run"), (8, None, "g", "upsert", 0, "h", 1, None), (9, "a", None, "upsert", 0, None, None, None),
    ]
    assert plan(spark, runs, changes) == [(2, 1), (2, 3), (3, 5)] == brute(runs, changes)


def test_empty(spark):
    assert plan(spark, [], []) == []
    assert plan(spark, [(1, "a", "ok", 5, None)], []) == []
    assert plan(spark, [], [(1, "a", "f", "upsert", 1, "h", 3, None)]) == []


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    runs = [(i, rng.choice("aaab"), rng.choice(["ok", "ok", "failed"]), rng.randrange(40), "") for i in range(30)]
    changes = [(i, rng.choice("aaabc"), rng.choice("fg"), rng.choice(["upsert", "delete"]), rng.choice([1, None]), rng.choice(["h", None]), rng.randrange(45), "") for i in range(120)]
    assert plan(spark, runs, changes) == brute(runs, changes)


def test_gaps_are_disjoint(spark):
    r = spark.createDataFrame([(1, "a", "ok", 10, ""), (2, "a", "ok", 30, ""), (3, "a", "ok", 20, "")], RUNS)
    got = sorted((x.gap_after or 0, x.gap_to) for x in run_gaps(r).collect())
    assert got == [(0, 10), (10, 20), (20, 30)]


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_ordered_rows_over_partition_borders(spark, partitions):
    """One key holds nearly all rows, so it crosses every border."""
    d = spark.createDataFrame([("hot", i, i if i % 5 == 0 else None) for i in range(50)] + [("z", 1, None), ("z", 2, 9), (None, 1, 4)], "k string, t int, v int")
    prev = previous_row(d, ["k"], ["t"], ["t"], "p", partitions)
    assert {(r.k, r.t): (r.p.t if r.p else None) for r in prev.collect()} == {**{("hot", i): (i - 1 if i else None) for i in range(50)}, ("z", 1): None, ("z", 2): 1, (None, 1): None}
    nxt = next_match(d, ["k"], ["t"], "v", "n", partitions)
    want = {("hot", i): next((j for j in range(i, 50) if j % 5 == 0), None) for i in range(50)} | {("z", 1): 9, ("z", 2): 9, (None, 1): 4}
    assert {(r.k, r.t): r.n for r in nxt.collect()} == want


def islands(numbers):
    out = []
    for n in sorted(numbers):
        if out and out[-1][1] + 1 == n:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("partitions", [1, 5])
def test_intervals_as_rows(spark, partitions):
    """Against lists: one key holds most rows and crosses every range border."""
    rng = random.Random(partitions)
    done = {k: {rng.randrange(300) for _ in range(n)} for k, n in (("hot", 200), ("b", 3), (None, 5))}
    d = spark.createDataFrame([(k, i, i) for k, v in done.items() for i in v], "k string, lo long, hi long")
    m = merged(d, ["k"], "lo", "hi")
    got = {}
    for r in m.collect():
        got.setdefault(r.k, []).append((r.lo, r.hi))
    assert {k: sorted(v) for k, v in got.items()} == {k: islands(v) for k, v in done.items()}
    ask = spark.createDataFrame([(k, i, "x") for k in ("hot", "b", None, "none") for i in range(0, 310, 3)], "k string, at long, hi string")
    found = interval_of(ask, m.withColumn("v", F.lit(1)), ["k"], "at", "lo", "hi", "v", "found", partitions)
    assert {(r.k, r.at): r.found for r in found.collect()} == {(k, i): 1 if i in done.get(k, ()) else None for k in ("hot", "b", None, "none") for i in range(0, 310, 3)}
    assert merged(d.limit(0), ["k"], "lo", "hi").count() == 0


def test_ledger_survives_failures_and_late_commits(spark, tmp_path):
    table = lambda ids: spark.createDataFrame([(i,) for i in ids], "seq long")
    ledger = IntervalLedger(spark, f"file:{tmp_path}/ledger")
    assert ledger.intervals() is None and ledger.run(table([1, 2, 3, 7, None]), lambda d: d) == 4
    with pytest.raises(StoppedBeforeCommit):
        ledger.run(table([1, 2, 3, 4, 7, 8]), lambda d: d, fail_before_commit=True)
    assert sorted((r.lo, r.hi) for r in ledger.intervals().collect()) == [(1, 3), (7, 7)]
    assert ledger.run(table([1, 2, 3, 4, 5, 7, 8]), lambda d: d) == 3  # 4 and 5 came late, 8 is new
    assert sorted((r.lo, r.hi) for r in ledger.intervals().collect()) == [(1, 5), (7, 8)]
    assert ledger.run(table([1, 2, 3, 4, 5, 7, 8]), lambda d: d) == 0
    assert sorted(r.seq for r in ledger.outputs().collect()) == [1, 2, 3, 4, 5, 7, 8]


def test_two_runs_from_one_state_commit_once(spark, tmp_path):
    table = lambda ids: spark.createDataFrame([(i, "r") for i in ids], "seq long, root string")
    a, b = (IntervalLedger(spark, f"file:{tmp_path}/ledger", keys=["root"]) for _ in "ab")
    with pytest.raises(RuntimeError, match="another run"):
        a.run(table([1, 2]), lambda d: b.run(table([1]), lambda x: x) and d)
    assert sorted(r.seq for r in a.outputs().collect()) == [1] and a.run(table([1, 2]), lambda d: d) == 1


def test_redelivery_is_null_safe(spark):
    c = spark.createDataFrame([(1, "a", "f", "delete", None, None, 1, ""), (2, "a", "f", "delete", None, None, 2, ""), (3, "a", "f", "upsert", None, None, 3, "")], CHANGES)
    assert sorted(r.change_id for r in real_changes(c).select(F.col("change_id")).collect()) == [1, 3]
