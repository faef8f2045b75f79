"""Joins to side tables: broadcast behind a size check, shuffled beyond it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
#: Columns left out and compression make an estimate too small by some tens at most.
SURE_BYTES = 256 << 10


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """At most ``max_rows`` rows and ``max_bytes`` bytes of values.

    What the optimizer takes to be tiny, by the size of its files, is believed at once; an explode, of which it
    cannot know the rows, is not. Anything else is counted, as JSON.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) <= min(SURE_BYTES, max_bytes) and "Generate" not in plan.toString():
        return True
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, used = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return rows <= max_rows and used <= max_bytes


def lookup_join(
    df: DataFrame, side: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Joins a side table, broadcast if it counts at most ``max_rows`` rows and is small in bytes too.

    A larger side is joined by shuffle, where adaptive execution splits skewed keys.
    """
    return df.join(F.broadcast(side) if small_enough(side, max_rows) else side, on, how)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row."""
    tag = {"_one": F.lit(0)}
    return df.withColumns(tag).join(F.broadcast(one_row.withColumns(tag)), "_one").drop("_one")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Brings a scan of few splits onto all cores before an explode multiplies its rows.

    A scan that already has enough splits, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def interval_join(
    rows: DataFrame,
    spans: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    ts: str = "ts",
    bucket: float = 10.0,
) -> DataFrame:
    """Rows with each span of their key that contains ``ts``, both ends included.

    Both sides meet in time buckets, so a key with many rows and many spans is not multiplied out. Buckets
    have levels, each twice as long as the one below; a span uses the level at which it covers five buckets
    at most. A row is copied once for each level that some span uses: not at all where no span is wide.
    """
    first, last, at = (f"floor({c} / {bucket})" for c in (start, end, ts))
    sliced = (
        spans.where(f"{start} <= {end}")
        .withColumn("_level", F.expr(f"cast(greatest(0, ceil(log2(({last} - {first} + 1) / 4))) as int)"))
        .withColumn(
            "_bucket", F.expr(f"explode_outer(sequence(floor({first} / power(2, _level)), floor({last} / power(2, _level))))")
        )
    )
    # A few dozen levels at most, whatever the spans.
    used = sliced.agg(F.collect_set("_level").alias("_levels"))
    placed = (
        beside(rows, used)
        .withColumn("_level", F.explode("_levels"))
        .withColumn("_bucket", F.expr(f"floor({at} / power(2, _level))"))
        .drop("_levels")
    )
    return placed.join(sliced, [*keys, "_level", "_bucket"]).where(F.col(ts).between(F.col(start), F.col(end))).drop(
        "_level", "_bucket"
    )
