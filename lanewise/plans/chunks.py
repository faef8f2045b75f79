"""Windows that stay bounded when one key holds a large share of all rows.

A plain ``partitionBy(key)`` window puts a whole key in one task. Everything here cuts
each key into chunks of ``size`` consecutive order values (frames, ticks), so a task
sorts at most one chunk, and gives each chunk what it needs from its neighbours:

* ``with_halo`` copies the few rows a *bounded* lookback or lookahead can reach;
* ``previous``, ``following`` and ``running_sum`` carry one summary row per chunk, for
  lookbacks without a bound. The summaries are pre-aggregated map-side, so they are
  ``1/size`` of the rows at most.

Both give exactly the rows a whole-key window gives.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 8192


def with_chunk(df: DataFrame, order: str = "frame_id", size: int = CHUNK) -> DataFrame:
    return df.withColumn("chunk", F.expr(f"floor({order} / {size})"))


def with_halo(
    df: DataFrame, order: str = "frame_id", back: int = 0, ahead: int = 0, size: int = CHUNK
) -> DataFrame:
    """Adds ``chunk`` and ``owned``; rows near a chunk edge also appear, not owned, next door.

    ``back`` is how far (in ``order`` units) a row may look to smaller values, ``ahead``
    to larger ones. Keep the ``owned`` rows after the window. Chunks are never shorter than that.
    """
    size = max(size, back, ahead)
    own = f"floor({order} / {size})"
    offset = f"({order} - {own} * {size})"
    low = f"case when {offset} < {ahead} then {own} - 1 else {own} end"
    high = f"case when {offset} >= {size - back} then {own} + 1 else {own} end"
    return df.withColumn("chunk", F.expr(f"explode_outer(sequence({low}, {high}))")).withColumn(
        "owned", F.expr(f"chunk = {own}")
    )


def map_gathered(df: DataFrame, keys: list[str], order: str, fn, schema) -> DataFrame:
    """``mapInArrow`` over partitions in which the rows of each key lie together, by ``order``.

    The rows are dealt by a window, which leaves those that already lie together by some of ``keys`` where they
    are; ``repartition`` would shuffle them again. They are sorted by a number first: texts that begin alike are slow
    to compare. ``fn`` also sees the columns ``_key`` and ``_nth``.
    """
    keyed = df.withColumn("_key", F.xxhash64(*keys))
    gathered = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", *keys).orderBy(order)))
    return gathered.sortWithinPartitions("_key", *keys, order).mapInArrow(fn, schema)


def previous(
    df: DataFrame, keys: list[str], order: str, cols: list[str], size: int = CHUNK, prefix: str = "prev_"
) -> DataFrame:
    """Adds ``prev_<col>``: the values on the key's row before this one, however far back."""
    return _neighbour(df, keys, order, cols, size, prefix, forward=False)


def following(
    df: DataFrame, keys: list[str], order: str, cols: list[str], size: int = CHUNK, prefix: str = "next_"
) -> DataFrame:
    """Adds ``next_<col>``: the values on the key's row after this one, however far ahead."""
    return _neighbour(df, keys, order, cols, size, prefix, forward=True)


def _neighbour(df, keys, order, cols, size, prefix, forward):
    """What a chunk gets from the one next to it travels as a marker row, not by a join: rows that already lie
    together by some of ``keys`` stay where they are. A chunk's edge is kept column by column, so that a hash map holds
    numbers; a struct would make Spark sort all rows for it."""
    df = with_chunk(df, order, size)
    edge, shift = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    per_chunk = df.groupBy(*keys, "chunk").agg(*[edge(c, F.col(order)).alias(f"_{i}") for i, c in enumerate(cols)])
    at_edge = F.struct(*[F.col(f"_{i}").alias(c) for i, c in enumerate(cols)])
    carried = per_chunk.select(
        *keys, "chunk", shift(at_edge).over(Window.partitionBy(*keys).orderBy("chunk")).alias("_value")
    ).where(F.col("_value").isNotNull())
    df = df.withColumn("_value", F.struct(*cols))
    rows = df.withColumn("_marker", F.lit(False)).unionByName(
        carried.withColumn("_marker", F.lit(True)), allowMissingColumns=True
    )
    marker = F.col("_marker").asc() if forward else F.col("_marker").desc()
    here = Window.partitionBy(*keys, "chunk").orderBy(marker, order)
    out = rows.withColumn("_near", shift("_value").over(here)).where("not _marker")
    return out.withColumns({prefix + c: F.col("_near")[c] for c in cols}).drop("_near", "_value", "_marker", "chunk")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, size: int = CHUNK
) -> DataFrame:
    """Adds ``out``: the inclusive running sum of ``value`` per key. Chunks follow ``order[0]``."""
    df = with_chunk(df, order[0], size)
    per_chunk = df.groupBy(*keys, "chunk").agg(F.sum(value).alias("_total"))
    before = per_chunk.select(
        *keys,
        "chunk",
        F.sum("_total")
        .over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_before"),
    ).where(F.col("_before").isNotNull())
    here = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(before, [*keys, "chunk"], "left")
        .withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + F.sum(value).over(here))
        .drop("_before", "chunk")
    )


def ordinal(df: DataFrame, keys: list[str], order: str, out: str, size: int = CHUNK) -> DataFrame:
    """Adds ``out``: 1, 2, 3, ... per key in ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1)), keys, [order], "_one", out, size).drop("_one")


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, cols: list[str], size: int = CHUNK
) -> DataFrame:
    """Adds ``cols`` of the key's latest ``right`` row at or before each ``left`` row.

    Both sides flow through one chunked window, so a key with many rows on both sides is never
    multiplied out. ``right`` needs unique (keys, order).
    """
    value = F.struct(*cols)
    left, right = with_chunk(left, order, size), with_chunk(right, order, size)
    merged = (
        left.select(*keys, order, "chunk", F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
        .unionByName(right.select(*keys, order, "chunk", F.lit(None).alias("_left"), value.alias("_right")))
    )
    per_chunk = right.groupBy(*keys, "chunk").agg(F.max_by(value, F.col(order)).alias("_edge"))
    # Chunks with left rows only inherit too.
    in_use = left.select(*keys, "chunk").distinct()
    carried = per_chunk.join(in_use, [*keys, "chunk"], "full").select(
        *keys,
        "chunk",
        F.last("_edge", ignorenulls=True)
        .over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carried"),
    ).where(F.col("_carried").isNotNull())
    here = (
        Window.partitionBy(*keys, "chunk")
        .orderBy(order, F.col("_left").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        merged.join(carried, [*keys, "chunk"], "left")
        .withColumn("_found", F.coalesce(F.last("_right", ignorenulls=True).over(here), F.col("_carried")))
        .where(F.col("_left").isNotNull())
        .select("_left.*", *[F.col("_found")[c].alias(c) for c in cols])
        .drop("chunk")
    )
