"""Mixing sources to target weights: DataFrame functions only.

A source's target is its weighted share of all words, at most ``most`` times its own; what is cut
off goes to the other sources by weight. The repetition rate is target / own words. A document is
taken floor(rate) times, and once more if a hash of its id falls below the fraction.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.plans.joins import lookup_join
from lanewise.plans.staging import staged

TOKEN = r"[^\x20\x09-\x0D]+"
SEEDS = 16


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def uniform(seed: Column, key: Column) -> Column:
    """A number in [0, 1) for each (seed, key): one of the four 32-bit parts of an MD5 sum."""
    sum_ = F.md5(F.concat(F.floor(seed / 4).cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))
    part = F.substring(sum_, ((seed % 4) * 8 + 1).cast("int"), F.lit(8))
    return F.conv(part, 16, 10).cast("double") / 4294967296.0


def ordered(sources: DataFrame, column: str) -> DataFrame:
    """Adds ``place``: 0, 1, .. by code point, null last. Range partitions are numbered side by side."""
    after = F.col(column).isNull()
    parts = staged(sources.repartitionByRange(after, column).withColumn("_part", F.spark_partition_id()))
    # One row per range partition, whatever the number of sources.
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(after, column))
    return (
        parts.withColumn("_within", within)
        .join(F.broadcast(before), "_part")
        .withColumn("place", F.col("_before") + F.col("_within") - 1)
        .drop("_part", "_n", "_before", "_within")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, weight, target`` of ``source, size`` rows.

    Sources take ``weights`` in turn, by code point, null last. The level, words per unit of weight,
    rises until no further source is above ``most`` times its size; only its sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = staged(ordered(totals, "source").select("source", "source_size", turn.cast("long").alias("weight")))
    cap = F.col("source_size") * most
    total, open_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, above = (total / open_weight if open_weight else 0.0), 0
    while True:
        over = cap > F.lit(level) * F.col("weight")
        n, capped, open_weight = weighed.agg(
            F.count_if(~over), F.sum(F.when(~over, cap)), F.sum(F.when(over, F.col("weight")))
        ).first()
        if not n or n == above or not open_weight:
            break
        level, above = (total - capped) / open_weight, n
    return weighed.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seeds: int = SEEDS) -> DataFrame:
    """``source, source_size, target, rate, seed`` from ``doc_id, source, size`` rows.

    Each source takes the one of ``seeds`` hash seeds whose draw comes nearest to its target.
    """
    rated = source_targets(sizes, weights, most).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    drawn = join_source(sizes, rated.select("source", "rate")).groupBy("source").agg(
        *[F.sum(F.col("size") * copies("rate", F.lit(k), "doc_id")).alias(f"_{k}") for k in range(seeds)]
    )
    back = F.col("source").eqNullSafe(F.col("_s"))
    both = rated.join(drawn.withColumnRenamed("source", "_s"), back)
    off = F.array(*[F.abs(F.col(f"_{k}") - F.col("target")) for k in range(seeds)])
    return both.withColumn("seed", F.array_position(off, F.array_min(off)) - 1).select(
        "source", "source_size", "target", "rate", "seed"
    )


def copies(rate: str, seed: Column, key: str) -> Column:
    """floor(rate), and one more with probability rate - floor(rate)."""
    whole = F.floor(rate)
    return (whole + (uniform(seed, F.col(key)) < F.col(rate) - whole).cast("int")).cast("long")


def join_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns to each row by its source; null is a source like any other."""
    marked = [plan[c].alias(f"_plan_{c}") for c in plan.columns if c != "source"]
    side = plan.select(
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), *marked
    )
    keyed = rows.withColumns({"_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    out = lookup_join(keyed, side, ["_source", "_none"], "inner").drop("_source", "_none")
    return out.withColumnsRenamed({f"_plan_{c}": c for c in plan.columns if c != "source"})


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("size"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: one row per document row.

    A null or empty text has size 0. Repeated rows are documents of their own and, having the same
    id, are taken equally often. No rows give no rows. The texts are read once.
    """
    sizes = staged(sized(docs))
    plan = staged(plan_mix(sizes, **how))
    return join_source(sizes, plan).withColumn("copies", copies("rate", F.col("seed"), "doc_id")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with all columns and ``copy`` (from 1)."""
    plan = staged(plan_mix(staged(sized(docs)), **how)).select(
        "source", F.col("rate").alias("_rate"), F.col("seed").alias("_seed")
    )
    drawn = join_source(docs.drop("copy"), plan).withColumn("_copies", copies("_rate", F.col("_seed"), "doc_id"))
    return (
        drawn.where("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .drop("_rate", "_seed", "_copies")
    )
