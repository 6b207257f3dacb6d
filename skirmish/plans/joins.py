"""Joins and interval tools that Spark has no operator for, as plans of windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that are broadcast at most.
MOST_BROADCAST = 200_000


def small(df: DataFrame) -> DataFrame:
    """The rows, marked for broadcast if they are counted to be few; else Spark is left to shuffle them.
    Streams can't be counted, so they are never marked."""
    if df.isStreaming:
        return df
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def asof_join(probes: DataFrame, facts: DataFrame, keys: list[str], time: str, value: str, order: str = "seq", out: str = "found") -> DataFrame:
    """Each probe with the value of the last fact of its key at or before its time, or null.

    Of facts at the same time the last in ``order`` counts.  Facts are first reduced to one a key and
    time, map-side; then one window over both sides by key answers all probes, so nothing is compared
    pairwise.  Rows of one key stand in one task, sorted and streamed, never held.  Probes whose key
    has a null get null."""
    reduced = facts.groupBy(*keys, time).agg(F.max_by(value, order).alias(out))
    kind = reduced.schema[out].dataType
    rest = [x for x in probes.columns if x not in (*keys, time)]
    left = probes.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias(out), F.struct(*rest).alias("_probe") if rest else F.lit(0).alias("_probe"))
    right = reduced.select(*keys, time, F.lit(0).alias("_side"), out, F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn(out, F.last(out, ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*keys, time, *([f"_probe.{x}" for x in rest] if rest else []), out)


def band_join(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside spans of the same key: start <= time <= end.

    A point lies in one bucket of ``width``; a span is copied to each bucket that it touches, so the
    join is an equi-join on key and bucket.  Exact for spans of any length; ``width`` should be near the
    usual one."""
    p = points.withColumn("_bucket", F.floor(F.col(time) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*keys, "_bucket"]).filter(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")


def step_spans(steps: DataFrame, keys: list[str], time: str, value: str, end: Column, order: str | None = None) -> DataFrame:
    """From change points of a value its spans (start, stop, value): each lasts to the next point of
    its key, the last to ``end``.  Points at one time: the last in ``order``; empty spans go."""
    if order:
        steps = steps.groupBy(*keys, time).agg(F.max_by(value, order).alias(value))
    w = Window.partitionBy(*keys).orderBy(time)
    out = steps.withColumn("stop", F.coalesce(F.lead(time).over(w), end)).withColumnRenamed(time, "start")
    return out.filter("stop > start")


def fuse(steps: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Change points without those that repeat the value before."""
    w = Window.partitionBy(*keys).orderBy(time)
    return steps.withColumn("_was", F.lag(value).over(w)).filter(~F.col("_was").eqNullSafe(F.col(value))).drop("_was")


def overlap_counts(spans: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """How many spans of a key overlap, as change points (t, n): +1 at a start, -1 at a stop."""
    turns = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("t"), F.lit(-1).alias("d"))))
    deltas = spans.select(*keys, turns.alias("x")).groupBy(*keys, F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fuse(deltas.withColumn("n", F.sum("d").over(w)).drop("d"), keys, "t", "n")


def merge_steps(steps: DataFrame, keys: list[str], series: str, time: str, value: str) -> DataFrame:
    """The sum of step functions: at every change point of any series of a key, the sum of the last
    values of all.  A series counts by its change, so a running sum of differences gives it."""
    own = Window.partitionBy(*keys, series).orderBy(time)
    change = steps.withColumn("_d", F.col(value) - F.coalesce(F.lag(value).over(own), F.lit(0)))
    change = change.groupBy(*keys, time).agg(F.sum("_d").alias("_d"))
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fuse(change.withColumn(value, F.sum("_d").over(w)).drop("_d"), keys, time, value)


def islands(rows: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """Rows numbered by island: a new one begins where more than ``gap`` passed since the row before."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    return rows.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("island", F.sum("_new").over(w)).drop("_new")


def grid(keys_frame: DataFrame, first: Column, last: Column, step: int, out: str) -> DataFrame:
    """Every key with every grid value from first to last."""
    return keys_frame.withColumn(out, F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))))
