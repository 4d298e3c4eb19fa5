"""Keeping tables current from streams of change and event records.

Batches are reconciled with the stored state inside ``foreachBatch`` and published as one new generation, so readers never
see half a batch; a batch that runs again after a failure gives the same state, because the newest record of a path wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.session import checkpoint_dir
from quarrylens.sources.workspace import VersionedTable

FULL_REFRESH_PATHS = 1024


def change_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Change records as they arrive in a folder."""
    r = spark.readStream.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.format(fmt).load(path)


def newest_per_path(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record of each key; every other column comes along."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def reconcile(table: VersionedTable, batch: DataFrame, keys: list[str], order: list[str], path_col: str | None = None, kind_col: str = "change_kind") -> int:
    """Publish the state after a batch; deletions stay as rows so that a late older record can't bring a path back. With ``path_col``, one
    of the keys, a newer deletion of a directory also deletes what is below it."""
    old = table.read()
    both = batch if old is None else old.unionByName(batch)
    state = newest_per_path(both, keys, order)
    return table.write(below_deleted(state, keys, order, path_col, kind_col) if path_col else state)


def below_deleted(state: DataFrame, keys: list[str], order: list[str], path_col: str, kind_col: str) -> DataFrame:
    """The state with paths marked deleted where a directory above them was deleted later than they were written. Each path asks for
    its own directories, as many as it has parts, so no path meets all deletions."""
    gone = state.filter(F.col(kind_col) == "delete").select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*order).alias("__at"))
    parts = F.split(path_col, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = state.filter((F.col(kind_col) != "delete") & (F.size(parts) > 1)).select(*keys, F.struct(*order).alias("__own"), F.explode(above).alias("__dir"))
    cond = [F.col("__dir") == F.col(f"__{path_col}"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys if k != path_col), F.col("__at") > F.col("__own")]
    hit = asked.join(gone, cond).select(*[F.col(k).alias(f"__hit_{k}") for k in keys]).distinct().withColumn("__gone", F.lit(True))
    j = state.join(hit, [F.col(k).eqNullSafe(F.col(f"__hit_{k}")) for k in keys], "left")
    return j.withColumn(kind_col, F.when(F.col("__gone"), F.lit("delete")).otherwise(F.col(kind_col))).select(state.columns)


def needs_full_refresh(batch: DataFrame, path_col: str, limit: int = FULL_REFRESH_PATHS) -> bool:
    """Whether a batch touches so many paths, or a head or root, that a full pass is due; at most limit + 1 paths are counted."""
    n = batch.select(path_col).distinct().limit(limit + 1).count()
    return n > limit or batch.filter(F.col(path_col).rlike(r"(?:^|/)\.git/HEAD$") | (F.col(path_col) == "")).limit(1).count() > 0


def refresh_from(stream: DataFrame, table: VersionedTable, checkpoint: str, keys: list[str], order: list[str], once: bool = True, path_col: str | None = None):
    """Start (and with ``once`` finish) the refresh of a table from a stream; one batch is active at a time."""

    def apply(batch: DataFrame, _: int) -> None:
        reconcile(table, batch, keys, order, path_col)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    q = (w.trigger(availableNow=True) if once else w.trigger(processingTime="500 milliseconds")).start()
    if once:
        q.awaitTermination()
    return q


# ---------------------------------------------------------------- stateful operators


def debounced(stream: DataFrame, key: str, path_col: str, window_ms: int = 500) -> DataFrame:
    """(key, paths): a fixed window of processing time that the first event of a key opens; its paths come out once,
    distinct and sorted, when it ends. The state of a key is its paths since then."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (paths,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "paths": [sorted(json.loads(paths))]})
            return
        seen = set(json.loads(state.get[0])) if state.exists else set()
        for f in frames:
            seen |= set(f[path_col])
        opened = not state.exists
        state.update((json.dumps(sorted(seen)),))
        if opened:
            state.setTimeoutDuration(window_ms)
        yield pd.DataFrame({key: [], "paths": []})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, paths array<string>", "paths string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reduced_events(stream: DataFrame, session: str, identity: str, status: str, body: str) -> DataFrame:
    """(session, identity, problem): events reduced by identity; an equal repeat is dropped, another body under the same
    identity is a conflict, an end without a start and anything after the session's stop are problems."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"seen": {}, "open": [], "stopped": False}
        out = []
        for f in frames:
            for i, st, b in zip(f[identity], f[status], f[body]):
                mark = f"{i}:{st}"
                if mark in s["seen"]:
                    if s["seen"][mark] != b:
                        out.append((i, "conflict"))
                    continue
                s["seen"][mark] = b
                if s["stopped"]:
                    out.append((i, "after stop"))
                elif st == "start":
                    s["open"].append(i)
                elif st == "finish":
                    if i in s["open"]:
                        s["open"].remove(i)
                        out.append((i, "ok"))
                    else:
                        out.append((i, "finish without start"))
                elif st == "stop":
                    s["stopped"] = True
                    out += [(x, "start without finish") for x in s["open"]]
                    s["open"] = []
        state.update((json.dumps(s),))
        yield pd.DataFrame({session: [k[0]] * len(out), "identity": [i for i, _ in out], "problem": [p for _, p in out]})

    return stream.groupBy(session).applyInPandasWithState(step, f"{session} string, identity string, problem string", "s string", "append", GroupStateTimeout.NoTimeout)


def counted_windows(stream: DataFrame, ts: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: rows per event-time window, late rows beyond the watermark left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


# ---------------------------------------------------------------- queries

CHANGE_SCHEMA = "change_id long, repository_root string, repo string, file_path string, change_kind string, mtime_ns long, content_hash string, walked_at_ms long"


def j3_stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree after all change records, kept current by the stream of them; the same as ``a19_current_tree``."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/refresh-{uuid.uuid4().hex}"
    t = VersionedTable(spark, f"{base}/state")
    stream = change_stream(spark, f"{sf_dir}/file_change[s].parquet", CHANGE_SCHEMA)
    refresh_from(stream, t, f"{base}/offsets", ["repository_root", "file_path"], ["walked_at_ms", "change_id"], path_col="file_path")
    return t.read().filter("change_kind <> 'delete'").select("repository_root", "file_path", "mtime_ns", "content_hash")


from quarrylens.operators.events import QUERIES as _EVENTS  # noqa: E402

QUERIES = {"j3_stream_refresh": (j3_stream_refresh, _EVENTS["a19_current_tree"][1])}
