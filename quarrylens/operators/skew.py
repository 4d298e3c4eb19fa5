"""Ordered-row operators that stay balanced when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a hot key into a single task. Here rows are range-partitioned by
(key, order), windows run inside (range partition, key), and only one boundary row per range partition is
carried over; the carried table has at most as many rows as there are range partitions, so broadcasting
it is bounded by the partition count and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.session import cut_lineage

PID = "__pid"


def range_partitioned(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned by keys then order, with the partition number in ``__pid``, checkpointed so
    that a recomputed task can't see other range bounds."""
    cols = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return cut_lineage(ranged.withColumn(PID, F.spark_partition_id()))


def _keys_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str = "prev", partitions: int | None = None) -> DataFrame:
    """Adds struct ``out`` with ``fields`` of the row just before, by ``order``, among rows of equal keys
    (null keys are equal to each other); null on a key's first row."""
    d = range_partitioned(df, keys, order, partitions)
    w = Window.partitionBy(PID, *keys).orderBy(*order)
    d = d.withColumn("__own", F.lag(F.struct(*[F.col(f) for f in fields])).over(w))
    last = F.struct(*[F.col(c) for c in [*keys, *order]])
    edge = d.groupBy(PID).agg(F.max_by(F.struct(_keys_struct(keys).alias("k"), F.struct(*[F.col(f) for f in fields]).alias("v")), last).alias("e"))
    # a partition's first key continues the last key of the nearest non-empty partition before it
    wp = Window.orderBy(PID)  # one row per range partition
    first = d.groupBy(PID).agg(F.min(last).alias("lo"))
    carry = (
        edge.join(first, PID)
        .select(PID, F.col("lo"), F.lag("e").over(wp).alias("before"))
        .filter(F.col("before").isNotNull())
        .select(F.col(PID).alias("__cp"), F.col("lo").alias("__lo"), F.col("before").alias("__before"))
    )
    same_key = F.col("__before.k").eqNullSafe(_keys_struct(keys))
    at_start = F.row_number().over(w) == 1
    return (
        d.withColumn("__start", at_start)
        .join(F.broadcast(carry), (F.col(PID) == F.col("__cp")) & F.col("__start") & same_key, "left")
        .withColumn(out, F.coalesce(F.col("__own"), F.col("__before.v")))
        .drop("__own", "__start", "__cp", "__lo", "__before", PID)
    )


def next_match(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Forward as-of fill: adds ``out``, the first non-null ``value`` at or after a row, by ``order``, among
    rows of equal keys; null where none follows."""
    d = range_partitioned(df, keys, order, partitions)
    w = Window.partitionBy(PID, *keys).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pos = F.struct(*[F.col(c) for c in [*keys, *order]])
    d = d.withColumn("__own", F.first(value, ignorenulls=True).over(w))
    # per range partition: its first key, that key's first value and its last key
    edge = d.groupBy(PID).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    k_of = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in keys])
    edge = edge.select(PID, k_of("lo").alias("first_key"), k_of("hi").alias("last_key"))
    firsts = (
        d.join(F.broadcast(edge), PID)
        .filter(F.col("first_key").eqNullSafe(_keys_struct(keys)) & F.col(value).isNotNull())
        .groupBy(PID)
        .agg(F.min_by(value, pos).alias("first_value"))
    )
    one = edge.join(firsts, PID, "left")
    # a key that runs on: its value comes from the nearest partition that begins with it and holds one. Windows over one row a
    # range partition; partitions that begin with a key follow each other
    by_key = Window.partitionBy("first_key").orderBy(PID).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    onward = one.withColumn("from_here", F.first("first_value", ignorenulls=True).over(by_key))
    after = Window.orderBy(PID)
    carry = (
        onward.select(PID, "last_key", F.lead("first_key").over(after).alias("k2"), F.lead("from_here").over(after).alias("__later"))
        .filter(F.col("k2").eqNullSafe(F.col("last_key")) & F.col("__later").isNotNull())
        .select(F.col(PID).alias("__cp"), F.col("last_key").alias("__ck"), "__later")
    )
    return (
        d.join(F.broadcast(carry), (F.col(PID) == F.col("__cp")) & F.col("__ck").eqNullSafe(_keys_struct(keys)), "left")
        .withColumn(out, F.coalesce(F.col("__own"), F.col("__later")))
        .drop("__own", "__cp", "__ck", "__later", PID)
    )


def interval_of(records: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, value: str, out: str = "found", partitions: int | None = None) -> DataFrame:
    """Adds ``out``, the ``value`` of the interval [lo, hi] that holds ``at`` among rows of equal keys; null where none does.
    The intervals of a key are disjoint, so only the one with the least ``hi`` at or after ``at`` can hold it: a forward as-of match, balanced
    however many records or intervals a key has. A null ``lo`` has no lower end."""
    own = [c for c in records.columns if c not in keys]
    row = records.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.struct(*own).alias("__row"), F.lit(None).cast(intervals.select(F.struct(lo, value)).schema[0].dataType).alias("__iv"))
    ends = intervals.select(*keys, F.col(hi).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(row.schema["__row"].dataType).alias("__row"), F.struct(lo, value).alias("__iv"))
    m = next_match(row.unionByName(ends), keys, ["__at", "__kind"], "__iv", "__next", partitions).filter(F.col("__kind") == 0)
    inside = F.col("__next").isNotNull() & (F.col(f"__next.{lo}").isNull() | (F.col(f"__next.{lo}") <= F.col("__at")))
    return m.select(*keys, "__row.*", F.when(inside, F.col(f"__next.{value}")).alias(out))


def merged(intervals: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Disjoint intervals of whole numbers with those that touch made one, per key; balanced like the above."""
    d = previous_row(intervals.select(*keys, lo, hi), keys, [lo], [hi], "__prev")
    starts = d.filter(F.col("__prev").isNull() | (F.col(f"__prev.{hi}") + 1 < F.col(lo))).select(*keys, lo, (-F.col(lo)).alias("__neg"), F.col(f"__prev.{hi}").alias("__ended"))
    # an island ends where the row before the next island's start ends; the last of a key at the key's largest end
    ends = previous_row(starts, keys, ["__neg"], ["__ended"], "__follow").withColumn("__end", F.col("__follow.__ended"))
    inner = ends.filter("__end is not null").select(*keys, lo, F.col("__end").alias(hi))
    top = intervals.groupBy(*keys).agg(F.max(hi).alias(hi))
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    last = ends.filter("__end is null").alias("a").join(top.alias("b"), cond).select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{lo}"), F.col(f"b.{hi}"))
    return inner.unionByName(last)
