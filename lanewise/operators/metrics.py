"""Run-quality metrics over logged observations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.geometry import distance, project
from lanewise.plans.joins import beside, lookup_join
from lanewise.plans.ranks import rank_values


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def percentile_floor(observations: DataFrame, keys: list[str], value: str, pcts: tuple[int, ...] = (50, 95)) -> DataFrame:
    """``p50, p95, ...`` per group: the value at 0-based index ``max(0, floor(n * p / 100) - 1)``, 2 digits.

    Without ``keys`` there is one row in any case, of 0.0 where there are no values.
    """
    ranks = rank_values(observations, keys, value, pcts)
    return ranks.groupBy(*keys).agg(
        *[
            F.coalesce(F.round(F.max(F.when(F.col("pct") == p, F.col("value"))), 2), F.lit(0.0)).alias(f"p{p}")
            for p in pcts
        ]
    )


def throughput(boxes: DataFrame, elapsed_s: float) -> DataFrame:
    """Frames processed and frames per second of wall clock."""
    frames = boxes.select("video_id", "frame_id").distinct()
    fps = F.round(F.count("*") / elapsed_s, 2) if elapsed_s > 0 else F.lit(0.0)
    return frames.agg(
        F.count("*").alias("frames"), F.round(F.lit(float(elapsed_s)), 2).alias("elapsed_s"), fps.alias("fps")
    )


def model_quality(calls: DataFrame) -> DataFrame:
    """Parse, hallucination and completeness rates of model calls.

    ``calls``: one row per call with ``triples, hallucinated, incomplete``; a call without triples
    counts as a parse failure, and only calls with triples count towards the triple rates.
    """
    ok = F.col("triples") > 0

    def total(c):
        return F.sum(F.when(ok, F.col(c)).otherwise(0))

    sums = calls.agg(
        F.count("*").alias("calls"),
        F.count_if(ok).alias("parse_successes"),
        total("triples").alias("total_triples"),
        total("hallucinated").alias("hallucinated"),
        total("incomplete").alias("incomplete"),
    )
    t = F.col("total_triples")
    return sums.withColumns(
        {
            "parse_failures": F.col("calls") - F.col("parse_successes"),
            "parse_rate": rate(F.col("parse_successes"), F.col("calls")),
            "triples_per_call": rate(t, F.col("parse_successes"), 2),
            "hallucination_rate": rate(F.col("hallucinated"), t),
            "completeness_rate": rate(t - F.col("incomplete"), t),
        }
    )


def alert_metrics(candidates: DataFrame, fired: DataFrame) -> DataFrame:
    """Alert total, suppressed count, effectiveness and distribution in one row."""
    from lanewise.operators.alerts import alert_effectiveness

    per_type = alert_effectiveness(candidates, fired)
    entry = F.struct("alert_type", "fired")
    return per_type.agg(
        F.coalesce(F.sum("fired"), F.lit(0)).alias("alerts_total"),
        F.coalesce(F.sum("suppressed"), F.lit(0)).alias("suppressed"),
        rate(F.sum("suppressed"), F.sum("fired") + F.sum("suppressed")).alias("effectiveness"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("distribution"),
    )


def store_metrics(operations: DataFrame) -> DataFrame:
    """Calls, p50 and p95 latency, rows written and mean similarity per store operation.

    ``operations``: ``op, ms, rows, similarity``.
    """
    sums = operations.groupBy("op").agg(
        F.count("*").alias("calls"),
        F.sum("rows").alias("rows_written"),
        F.coalesce(F.round(F.avg("similarity"), 4), F.lit(0.0)).alias("avg_similarity"),
    )
    return sums.join(percentile_floor(operations, ["op"], "ms"), "op", "left").fillna(0.0, ["p50", "p95"])


def agent_metrics(queries: DataFrame) -> DataFrame:
    """Agent questions in one row. ``queries``: ``latency_ms, tools ARRAY<STRING>, answer, route``."""
    empty = F.length(F.trim(F.coalesce("answer", F.lit("")))) < 10
    sums = queries.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.sum(F.size("tools")), F.lit(0)).alias("tool_calls"),
        F.count_if(empty).alias("empty_answers"),
    )
    p = percentile_floor(queries, [], "latency_ms").withColumnsRenamed({"p50": "latency_p50", "p95": "latency_p95"})
    return beside(sums, p).withColumns(
        {
            "tools_per_query": rate(F.col("tool_calls"), F.col("queries"), 2),
            "empty_rate": rate(F.col("empty_answers"), F.col("queries")),
        }
    )


def tool_distribution(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count("*").alias("calls"))


def route_distribution(queries: DataFrame) -> DataFrame:
    return queries.groupBy("route").agg(F.count("*").alias("queries"))


def _as_map(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A distribution with few distinct keys as one map."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def metrics_report(
    boxes: DataFrame,
    elapsed_s: float,
    calls: DataFrame,
    ticks: DataFrame,
    candidates: DataFrame,
    fired: DataFrame,
    operations: DataFrame,
    graph: DataFrame,
    queries: DataFrame,
) -> DataFrame:
    """All run metrics as one row; every part is a one-row aggregate."""
    entry = F.struct("op", F.struct("calls", "rows_written", "p50", "p95", "avg_similarity").alias("m"))
    stores = store_metrics(operations).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("stores"))
    latency = percentile_floor(calls, [], "latency_ms").withColumnsRenamed({"p50": "model_p50", "p95": "model_p95"})
    gating = ticks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("motion_skips", "forced_ticks")])
    report = throughput(boxes, elapsed_s)
    for part in (
        model_quality(calls),
        latency,
        gating,
        alert_metrics(candidates, fired),
        stores,
        graph,
        agent_metrics(queries).withColumnsRenamed({"queries": "agent_queries"}),
        _as_map(tool_distribution(queries), "tool", "calls", "tools"),
        _as_map(route_distribution(queries), "route", "queries", "routes"),
    ):
        report = beside(report, part)
    return report


def point_errors(pairs: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Ground distance between each projected pixel and its surveyed point, 4 digits."""
    x, y = project("pixel_x", "pixel_y")
    return (
        lookup_join(pairs, calibrations.select("video_id", "h"), ["video_id"], "inner")
        .withColumns({"projected_x": x, "projected_y": y})
        .withColumn(
            "error_m",
            F.round(distance("projected_x", "projected_y", "world_x", "world_y"), 4),
        )
        .drop("h")
    )


def reprojection_error(pairs: DataFrame, calibrations: DataFrame, min_points: int = 4) -> DataFrame:
    """RMSE per camera with at least ``min_points`` pairs."""
    return (
        point_errors(pairs, calibrations)
        .groupBy("video_id")
        .agg(
            F.count("*").alias("points"),
            F.round(F.sqrt(F.avg(F.col("error_m") * F.col("error_m"))), 4).alias("rmse_m"),
        )
        .where(F.col("points") >= min_points)
    )
