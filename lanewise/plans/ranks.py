"""Exact order statistics without sorting a whole group in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.plans.joins import beside, lookup_join
from lanewise.plans.staging import staged

ACCURACY = 10_000
#: Parts of a bracket that are counted before values are.
CELLS = 1000


def rank_values(df: DataFrame, keys: list[str], value: str, pcts: tuple[int, ...]) -> DataFrame:
    """``keys, pct, value``: the value at 1-based rank ``max(1, floor(n * pct / 100))`` of each group.

    A mergeable quantile sketch brackets each rank; only values inside the bracket, about
    ``6 / ACCURACY`` of a large group, are counted one by one. Groups up to ``ACCURACY`` rows
    are their own bracket.
    """
    slack = 3.0 / ACCURACY
    bounds = sorted({b for p in pcts for b in (max(0.0, p / 100 - slack), min(1.0, p / 100 + slack))})
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    sketch = values.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.percentile_approx("v", bounds, ACCURACY).alias("q"),
    )
    small = F.col("n") <= ACCURACY
    wanted = F.array(
        *[
            F.struct(
                F.lit(p).alias("pct"),
                F.greatest(F.lit(1), F.floor(F.col("n") * p / 100)).alias("rank"),
                F.when(small, F.col("lo")).otherwise(F.col("q")[bounds.index(max(0.0, p / 100 - slack))]).alias("lo"),
                F.when(small, F.col("hi")).otherwise(F.col("q")[bounds.index(min(1.0, p / 100 + slack))]).alias("hi"),
            )
            for p in pcts
        ]
    )
    # The brackets go to the values: a row per group, however many values it has. Written once, they
    # can be counted without working out the sketches again.
    brackets = staged(sketch.select(*keys, wanted.alias("wanted")))
    met = lookup_join(values, brackets, keys, "inner") if keys else beside(values, brackets)
    joined = met.select(*keys, "v", F.explode(F.filter("wanted", lambda t: F.col("v") <= t["hi"])).alias("t")).select(
        *keys, "v", "t.*"
    )
    # Everything under a bracket folds into one count, everything above it is dropped.
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    width = F.col("hi") - F.col("lo")
    cell = F.when(width > 0, F.floor((inside - F.col("lo")) / width * CELLS)).otherwise(0)
    counted = joined.groupBy(
        *keys, "pct", "rank", inside.alias("v"), F.when(inside.isNotNull(), cell).otherwise(-1).cast("long").alias("cell")
    ).agg(F.count("*").alias("c"))
    # First the cell that holds the rank, by running counts of cells; then the value, within that cell.
    before = Window.partitionBy(*keys, "pct").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy(*keys, "pct", "rank", "cell").agg(F.sum("c").alias("n"))
    chosen = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where((F.col("before") < F.col("rank")) & (F.col("before") + F.col("n") >= F.col("rank")))
        .select(*keys, "pct", "cell", "before")
    )
    upto = F.sum("c").over(
        Window.partitionBy(*keys, "pct").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counted.join(chosen, [*keys, "pct", "cell"])
        .withColumn("upto", F.col("before") + upto)
        .where(F.col("upto") >= F.col("rank"))
        .groupBy(*keys, "pct")
        .agg(F.min("v").alias("value"))
    )
