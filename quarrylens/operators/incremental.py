"""Processing only new or changed records, exactly once, across failed and crashed runs.

Sequence numbers that a successful run has processed are kept as disjoint intervals. A run subtracts them from
what is available, processes the gaps (late commits included) and commits the merged intervals together with its
output: both are written under a new folder that counts once one small commit file names it, and that file
can be created once only, so a crash leaves either the old state or the new one.

``planned_changes`` is the set-based form for the whole history of many roots at once; ``IntervalLedger`` is the
form for running one increment at a time, which also takes what is committed late below the numbers of earlier runs. Both find the interval
of a record by ``skew.interval_of``; the intervals stay a table and never reach the driver.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.skew import interval_of, merged, previous_row
from quarrylens.session import checkpoint_dir, table
from quarrylens.sources.storage import Folder


def real_changes(changes: DataFrame) -> DataFrame:
    """Change records without exact duplicate rows and redeliveries.

    A record equal (null-safe) in change_kind, mtime_ns and content_hash to the record just before it, by
    (walked_at_ms, change_id), of the same repository_root and file_path is a redelivery. Records with a null
    walked_at_ms sort first and are later matched by no run. Empty input gives an empty result.
    """
    fields = ["change_kind", "mtime_ns", "content_hash"]
    d = changes.select("change_id", "repository_root", "file_path", *fields, "walked_at_ms").distinct()
    d = previous_row(d, ["repository_root", "file_path"], ["walked_at_ms", "change_id"], fields, "prev")
    same = F.col("prev").isNotNull()
    for f in fields:
        same = same & F.col(f"prev.{f}").eqNullSafe(F.col(f))
    return d.filter(~same).drop("prev")


def run_gaps(runs: DataFrame) -> DataFrame:
    """(repository_root, run_id, gap_after, gap_to): the disjoint interval (gap_after, gap_to] that each
    successful run adds to its root's processed intervals; gap_after is null for the first.

    Failed and crashed runs take nothing. Of runs with the same start the lowest run_id takes all.
    Rows without started_at_ms are ignored.
    """
    ok = runs.filter((F.col("status") == "ok") & F.col("started_at_ms").isNotNull())
    ok = ok.select("repository_root", "run_id", "started_at_ms").distinct()
    d = previous_row(ok, ["repository_root"], ["started_at_ms", "run_id"], ["started_at_ms"], "prev")
    return d.filter(F.col("prev").isNull() | (F.col("prev.started_at_ms") < F.col("started_at_ms"))).select(
        "repository_root", "run_id", F.col("prev.started_at_ms").alias("gap_after"), F.col("started_at_ms").alias("gap_to")
    )


def planned_changes(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """(run_id, change_id): the successful run whose gap holds each real change record.

    The gaps of a root, what is available to a run minus what earlier runs have processed, are disjoint intervals, and each record
    lies in one or none. Records after the last successful run, or with null root or walked_at_ms, aren't listed.
    """
    gaps = run_gaps(runs).select("repository_root", (F.col("gap_after") + 1).alias("lo"), F.col("gap_to").alias("hi"), "run_id")
    recs = real_changes(changes).filter(F.col("walked_at_ms").isNotNull() & F.col("repository_root").isNotNull()).select("repository_root", "walked_at_ms", "change_id")
    m = interval_of(recs, gaps, ["repository_root"], "walked_at_ms", "lo", "hi", "run_id", "run_id")
    return m.filter(F.col("run_id").isNotNull()).select("run_id", "change_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned_changes(table(spark, sf_dir, "index_runs"), table(spark, sf_dir, "file_changes"))


def p6_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository_root, run_id, gap_after, gap_to): what each successful run adds to its root's processed intervals."""
    return run_gaps(table(spark, sf_dir, "index_runs"))


def p6_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(change_id) of real changes that no successful run has taken yet."""
    changes = table(spark, sf_dir, "file_changes")
    return real_changes(changes).select("change_id").distinct().join(p6_found(spark, sf_dir), "change_id", "left_anti")


P6_GAPS_SQL = """
select repository_root, run_id, lag(gap_to) over (partition by repository_root order by gap_to) as gap_after, gap_to from (
  select repository_root, min(run_id) as run_id, started_at_ms as gap_to from index_runs
  where status = 'ok' and started_at_ms is not null group by repository_root, started_at_ms)
"""
P6_FOUND_SQL = """
with runs as (
  select repository_root, started_at_ms, min(run_id) as run_id from index_runs
  where status = 'ok' and started_at_ms is not null group by repository_root, started_at_ms),
ch as (select distinct change_id, repository_root, file_path, change_kind, mtime_ns, content_hash, walked_at_ms from file_changes),
lagged as (select *, lag(change_id) over w as pid, lag(change_kind) over w as pk, lag(mtime_ns) over w as pm, lag(content_hash) over w as ph
  from ch window w as (partition by repository_root, file_path order by walked_at_ms, change_id)),
kept as (select * from lagged where not (pid is not null and pk is not distinct from change_kind
  and pm is not distinct from mtime_ns and ph is not distinct from content_hash))
select r.run_id, k.change_id from kept k asof join runs r
on k.repository_root = r.repository_root and k.walked_at_ms <= r.started_at_ms
"""


P6_UNPROCESSED_SQL = P6_FOUND_SQL.replace(
    "select r.run_id, k.change_id from kept k asof join runs r", "select distinct k.change_id from kept k asof left join runs r"
).rstrip() + " where r.run_id is null"


REPLAY_ROUNDS = 3


def p6_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(change_id, round): every change record taken through the ledger as the walks reach it, in ``REPLAY_ROUNDS`` equal spans
    of time. Record numbers don't follow the walks, so later rounds fill holes below numbers that are processed already. One round stops
    before its commit and runs again. Records without walked_at_ms or root are never available."""
    d = table(spark, sf_dir, "file_changes").filter("walked_at_ms is not null and repository_root is not null").select("repository_root", "change_id", "walked_at_ms").distinct()
    ends = d.agg(F.min("walked_at_ms").alias("lo"), F.max("walked_at_ms").alias("hi")).first()
    ledger = IntervalLedger(spark, f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}", "change_id", ["repository_root"])
    for k in range(1, REPLAY_ROUNDS + 1):
        seen = d if k == REPLAY_ROUNDS or ends.lo is None else d.filter(F.col("walked_at_ms") <= ends.lo + (ends.hi - ends.lo) * k // REPLAY_ROUNDS)
        work = lambda x, k=k: x.select("change_id", F.lit(k).alias("round"))
        if k == 2:
            try:
                ledger.run(seen, work, fail_before_commit=True)
            except StoppedBeforeCommit:
                pass
        ledger.run(seen, work)
    return ledger.outputs()


P6_REPLAY_SQL = """
with d as (select distinct repository_root, change_id, walked_at_ms from file_changes where walked_at_ms is not null and repository_root is not null),
b as (select min(walked_at_ms) as lo, max(walked_at_ms) as hi from d)
select change_id, cast(min(case when walked_at_ms <= lo + (hi - lo) * 1 // 3 then 1 when walked_at_ms <= lo + (hi - lo) * 2 // 3 then 2 else 3 end) as integer) as round
from d, b group by repository_root, change_id
"""

# --------------------------------------------------------------------------- ledger


class StoppedBeforeCommit(RuntimeError):
    """A run that stopped between its output and its commit."""


class IntervalLedger:
    """Exactly-once increments over a table with a sequence column ``seq``, unique among rows of equal ``keys``.

    State is a folder of runs ``run-<id>/{taken, output, intervals}`` and of commit files ``commit/<number>``, each the name of
    the run in force from that number on. A commit file is created if it isn't there, in one step, so of two runs that began
    from the same state one commits and the other fails. What an uncommitted run has written is never read. Rows with a null sequence number are
    never taken.
    """

    def __init__(self, spark: SparkSession, path: str, seq: str = "seq", keys: list[str] | None = None) -> None:
        self.spark, self.seq, self.keys = spark, seq, keys or []
        self.folder = Folder(spark, path)

    def runs(self) -> list[str]:
        """Committed runs, oldest first."""
        return [self.folder.read(f"commit/{n}") for n in self.folder.names("commit") if n.isdigit()]

    def _read(self, run: str, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{run}/{part}")

    def intervals(self) -> DataFrame | None:
        """(keys, lo, hi) of what is processed; null before the first commit."""
        done = self.runs()
        return self._read(done[-1], "intervals") if done else None

    def _keyed(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        return (df, self.keys) if self.keys else (df.withColumn("__root", F.lit(0)), ["__root"])

    def pending(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose sequence number no committed run has processed, late commits included."""
        d, done = df.filter(F.col(self.seq).isNotNull()), self.intervals()
        if done is None:
            return d
        (d, keys), (done, _) = self._keyed(d), self._keyed(done)
        return interval_of(d, done, keys, self.seq, "lo", "hi", "hi", "__done").filter("__done is null").select(df.columns)

    def run(self, df: DataFrame, work, fail_before_commit: bool = False) -> int:
        """Process what is pending with ``work`` and commit output and intervals together; returns rows taken."""
        before = self.runs()
        name = f"run-{uuid.uuid4().hex}"
        at = f"{self.folder.path}/{name}"
        self.pending(df).write.parquet(f"{at}/taken")  # what this run takes, whatever commits meanwhile
        taken = self.spark.read.parquet(f"{at}/taken")
        work(taken).write.parquet(f"{at}/output")
        new, keys = self._keyed(taken.select(*self.keys, F.col(self.seq).alias("lo")).distinct().withColumn("hi", F.col("lo")))
        if before:
            new = self._keyed(self._read(before[-1], "intervals"))[0].unionByName(new)
        merged(new, keys, "lo", "hi").select(*self.keys, "lo", "hi").write.parquet(f"{at}/intervals")
        if fail_before_commit:
            raise StoppedBeforeCommit("stopped before the commit")
        if not self.folder.claim(f"commit/{len(before) + 1:08d}", name):
            raise RuntimeError("another run has committed since this one began")
        return taken.count()

    def outputs(self) -> DataFrame:
        """The output of all committed runs."""
        return self.spark.read.parquet(*(f"{self.folder.path}/{r}/output" for r in self.runs()))


def fresh_enough(built_at_ms: int | None, staleness_ms: int, now_ms: int | None = None) -> bool:
    """True where a build is younger than the staleness limit, so no new run is due."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    return built_at_ms is not None and now - built_at_ms < staleness_ms
