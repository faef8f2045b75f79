"""Per-frame alerts: thresholds, close pairs, and the greedy cool-down."""

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.motion import with_motion
from lanewise.plans.chunks import CHUNK, map_gathered, with_halo
from lanewise.plans.staging import staged
from lanewise.schemas import (
    AGGRESSIVE_ACCEL_MS2,
    HISTORY_ALERTS,
    COLLISION_M,
    COOLDOWN_S,
    HARD_BRAKING_MS2,
    PROXIMITY_M,
    SPEEDING_MS,
)

ENTITY = ["video_id", "alert_type", "id_lo", "id_hi"]
STRIP_WIDTH_M = 64.0


def vehicle_candidates(trajectories: DataFrame) -> DataFrame:
    """Speeding, braking and acceleration of warm rows, before the cool-down.

    ``measure`` is the speed, the signed acceleration or its magnitude.
    """
    return (
        with_motion(trajectories.where("warm"))
        .select("video_id", "frame_id", "ts", F.expr(f"explode_outer(array({_vehicle_alerts('track_id')})) as c"))
        .where("c is not null")
        .select("video_id", "frame_id", "ts", "c.*")
    )


def _vehicle_alerts(track: str) -> str:
    """One struct per kind of alert, null where it does not fire."""

    def when(fires: str, kind: str, measure: str) -> str:
        return (
            f"case when {fires} then named_struct('alert_type', '{kind}', 'id_lo', {track}, 'id_hi', {track},"
            f" 'track_id', {track}, 'measure', {measure}) end"
        )

    alerts = (
        when(f"speed > {SPEEDING_MS}D", "SPEEDING", "speed"),
        when(f"signed_accel < {HARD_BRAKING_MS2}D", "HARD_BRAKING", "signed_accel"),
        when(f"accel_mag > {AGGRESSIVE_ACCEL_MS2}D", "AGGRESSIVE_ACCEL", "accel_mag"),
    )
    return ", ".join(alerts)


def _sweep(trajectories: DataFrame, radius: float) -> DataFrame:
    """Every row as ``me`` with its close ``partners`` in a strip; twice, in its own strip and the next.

    A sweep instead of a self-join: positions fall into strips a little higher than ``radius``
    and ``STRIP_WIDTH_M`` long, each row also entering the strip above and, near a border, the
    one before. Sorted by x within a strip, a row only meets rows at most ``radius`` further.
    A pair meets in exactly one strip, so nothing is lost, repeated or capped.
    """
    w = STRIP_WIDTH_M
    placed = (
        with_motion(trajectories)
        .withColumns(
            {
                "own_strip": F.expr(f"floor(y / {radius * 1.001}D)"),
                "own_block": F.expr(f"floor(x / {w}D)"),
                "x_cm": F.expr("floor(x * 100)"),
            }
        )
        .withColumn("strip", F.expr("explode_outer(sequence(own_strip, own_strip + 1))"))
        .withColumn(
            "block",
            F.expr(
                f"explode_outer(sequence(if(x - own_block * {w}D <= {radius + 0.02}D, own_block - 1, own_block), own_block))"
            ),
        )
        .select(
            "video_id", "frame_id", "ts", "strip", "block", "own_block", "x_cm",
            F.struct("track_id", "box_ord", "x", "y", "vx", "vy", "warm", "x_cm", "own_strip").alias("me"),
            "speed", "signed_accel", "accel_mag",
        )
    )
    ahead = (
        Window.partitionBy("video_id", "frame_id", "strip", "block")
        .orderBy("x_cm")
        .rangeBetween(Window.currentRow, ceil(radius * 100))
    )
    partner = (
        "q -> (q.x_cm > me.x_cm or (q.x_cm = me.x_cm and q.track_id > me.track_id))"
        " and greatest(q.own_strip, me.own_strip) = strip"
        f" and sqrt((q.x - me.x) * (q.x - me.x) + (q.y - me.y) * (q.y - me.y)) < {float(radius)}D"
    )
    return (
        placed.withColumn("near", F.collect_list("me").over(ahead))
        .where("block = own_block")
        .withColumn(
            "partners",
            F.expr(f"if(size(near) > 1, transform(filter(near, {partner}), q -> {_PAIR}), cast(array() as {_PAIR_TYPE}))"),
        )
    )


_APPROACH = "(q.x - me.x) * (q.vx - me.vx) + (q.y - me.y) * (q.vy - me.vy) < 0"
_PAIR = (
    "named_struct('a_id', if(me.box_ord < q.box_ord, me.track_id, q.track_id),"
    " 'b_id', if(me.box_ord < q.box_ord, q.track_id, me.track_id),"
    " 'distance_m', sqrt((q.x - me.x) * (q.x - me.x) + (q.y - me.y) * (q.y - me.y)),"
    f" 'closing', not (me.warm and q.warm) or {_APPROACH})"
)
_PAIR_TYPE = "array<struct<a_id: bigint, b_id: bigint, distance_m: double, closing: boolean>>"


def close_pairs(trajectories: DataFrame, radius: float = PROXIMITY_M) -> DataFrame:
    """Pairs of vehicles nearer than ``radius`` in the same frame, cold ones included.

    ``a_id`` is the vehicle the tracker listed first. A pair counts as closing when the distance
    shrinks, or when either velocity is not reliable yet.
    """
    return (
        _sweep(trajectories, radius)
        .select("video_id", "frame_id", "ts", F.explode_outer("partners").alias("p"))
        .where("p is not null")
        .select("video_id", "frame_id", "ts", "p.*")
    )


def _pair_alert(collision: float, proximity: float) -> str:
    """From pair ``p`` to its alert, null if it is none. A collision never also warns of proximity."""
    d = "p.distance_m"
    return (
        f"case when {d} < {float(collision)}D or ({d} < {float(proximity)}D and p.closing) then named_struct("
        f"'alert_type', if({d} < {float(collision)}D, 'COLLISION_SUSPECTED', 'PROXIMITY_WARNING'),"
        f" 'id_lo', least(p.a_id, p.b_id), 'id_hi', greatest(p.a_id, p.b_id), 'track_id', p.a_id, 'measure', {d}) end"
    )


def pair_candidates(pairs: DataFrame, collision: float = COLLISION_M, proximity: float = PROXIMITY_M) -> DataFrame:
    """Collision and proximity alerts of close pairs, before the cool-down; ``measure`` is the distance."""
    return (
        pairs.select("video_id", "frame_id", "ts", F.struct("a_id", "b_id", "distance_m", "closing").alias("p"))
        .select("video_id", "frame_id", "ts", F.expr(_pair_alert(collision, proximity)).alias("c"))
        .where("c is not null")
        .select("video_id", "frame_id", "ts", "c.*")
    )


def alert_candidates(
    trajectories: DataFrame, collision: float = COLLISION_M, proximity: float = PROXIMITY_M
) -> DataFrame:
    """All alerts before the cool-down, vehicles and pairs in the same pass over the trajectories."""
    pair = _pair_alert(collision, proximity)
    # A row's own alerts go with its first partner, or with none, in its own strip.
    alone = "coalesce(n, 0) = 0 and me.warm and me.own_strip = strip"
    return (
        _sweep(trajectories, max(collision, proximity))
        .select("*", F.posexplode_outer("partners").alias("n", "p"))
        .select(
            "video_id", "frame_id", "ts",
            F.expr(f"explode_outer(if({alone}, array({_vehicle_alerts('me.track_id')}, {pair}), array({pair}))) as c"),
        )
        .where("c is not null")
        .select("video_id", "frame_id", "ts", "c.*")
    )


def _evidence(**values: str) -> str:
    return "map(" + ", ".join(f"'{k}', cast({v} as double)" for k, v in values.items()) + ")"


def describe(alerts: DataFrame, collision: float = COLLISION_M, proximity: float = PROXIMITY_M) -> DataFrame:
    """Adds ``severity, involved_ids, message, evidence``: words for the few alerts that fire."""
    pair = {"vehicle_a": "track_id", "vehicle_b": "if(track_id = id_lo, id_hi, id_lo)"}
    distance = "round(measure, 2)"
    evidence = {
        "SPEEDING": _evidence(
            speed_ms="round(measure, 2)", speed_kmh="round(measure * 3.6D, 1)",
            threshold_kmh=f"round({SPEEDING_MS}D * 3.6D, 1)",
        ),
        "HARD_BRAKING": _evidence(signed_accel_ms2="round(measure, 2)", threshold_ms2=f"{HARD_BRAKING_MS2}D"),
        "AGGRESSIVE_ACCEL": _evidence(accel_mag_ms2="round(measure, 2)", threshold_ms2=f"{AGGRESSIVE_ACCEL_MS2}D"),
        "COLLISION_SUSPECTED": _evidence(distance_m=distance, collision_threshold_m=f"{float(collision)}D", **pair),
        "PROXIMITY_WARNING": _evidence(distance_m=distance, warning_threshold_m=f"{float(proximity)}D", **pair),
    }
    both = "track_id, if(track_id = id_lo, id_hi, id_lo)"
    message = {
        "SPEEDING": "format_string('Over the limit: vehicle %d with %.1f km/h (%.1f m/s).', track_id, measure * 3.6D, measure)",
        "HARD_BRAKING": "format_string('Vehicle %d slows down hard, by %.1f m/s2.', track_id, measure)",
        "AGGRESSIVE_ACCEL": "format_string('Vehicle %d picks up speed fast, by %.1f m/s2.', track_id, measure)",
        "COLLISION_SUSPECTED": f"format_string('Possible contact between vehicles %d and %d, %.2f m from each other.', {both}, measure)",
        "PROXIMITY_WARNING": f"format_string('Vehicles %d and %d draw near, %.1f m left between them.', {both}, measure)",
    }

    def by_type(branches: dict[str, str]) -> str:
        return "case alert_type " + " ".join(f"when '{k}' then {v}" for k, v in branches.items()) + " end"

    return alerts.select(
        "*",
        F.expr("if(alert_type in ('SPEEDING', 'COLLISION_SUSPECTED'), 'critical', 'warning') as severity"),
        F.expr(f"if(id_lo = id_hi, array(track_id), array({both})) as involved_ids"),
        F.expr(f"{by_type(message)} as message"),
        F.expr(f"{by_type(evidence)} as evidence"),
    )


def group_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the values of ``keys`` change in sorted rows; two nulls are equal."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        before, after = column[:-1], column[1:]
        differs = pc.fill_null(pc.not_equal(after, before), False).to_numpy(zero_copy_only=False)
        known = pc.is_valid(column).to_numpy(zero_copy_only=False)
        changed |= differs | (known[1:] != known[:-1])
    return np.concatenate([[0], np.flatnonzero(changed) + 1]) if batch.num_rows else np.zeros(0, np.int64)


def whole_groups(batches, keys: list[str]):
    """Sorted batches cut anew, so that none ends inside a group."""
    kept = None
    for batch in batches:
        if kept is not None and kept.num_rows:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        cut = int(group_starts(batch, keys)[-1]) if batch.num_rows else 0
        if cut:
            yield batch.slice(0, cut)
        kept = batch.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def first_not_before(ts: np.ndarray, group: np.ndarray, at_ts: np.ndarray, at_group: np.ndarray, silence: float) -> np.ndarray:
    """For each asked time the first row of its group that lies ``silence`` or more after it, else the row count.

    Rows are sorted by group, then time.
    """
    n = len(ts)
    low, high = np.searchsorted(group, at_group), np.searchsorted(group, at_group, side="right")
    end = high
    while (low < high).any():
        middle = (low + high) // 2
        later = ts[np.minimum(middle, n - 1)] - at_ts >= silence
        high = np.where(later & (low < high), middle, high)
        low = np.where(~later & (low < high), middle + 1, low)
    return np.where(low < end, low, n)


def chain_ends(following: np.ndarray) -> np.ndarray:
    """The last row of each row's chain of successors; a row count stands for none. Doubles the steps each time."""
    n = len(following)
    jump = np.where(following < n, following, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


def on_chains(following: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows the chains from ``starts`` visit, by doubled steps."""
    n = len(following)
    jump = np.append(following, n)
    seen = np.zeros(n + 1, bool)
    seen[starts] = True
    while (jump[:-1] < n).any():
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def cooldown(
    candidates: DataFrame, seconds: float = COOLDOWN_S, fps: int = 30, chunk_frames: int = CHUNK
) -> DataFrame:
    """Candidates that fire: an entity's alert type is silent until ``seconds`` after it last fired."""
    return cooldown_tallied(candidates, seconds, fps, chunk_frames)[0]


def cooldown_tallied(
    candidates: DataFrame, seconds: float = COOLDOWN_S, fps: int = 30, chunk_frames: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """The candidates that fire, and how many candidates there were: ``alert_type, seen``, several rows a type.

    The choice is greedy in time, so each firing depends on the one before. An entity's
    candidates are cut into chunks of frames. Each candidate links to the first one after its
    silence; the firings of a chunk are the chain of links from its first free candidate, followed
    by doubled steps, so the work is near-linear in the candidates. Which candidate a chunk inherits as
    "last fired" is one of those within ``seconds`` before it, or none that matters, so each chunk
    hands on the end of the chain for every one of them. Only these short hand-on lists are
    walked in order, one entity after the other, in constant memory.

    Candidates are read once and stay where they are if they lie together by video. Only those on some chain of
    their chunk are written, and shuffled only where it is open which chain holds.
    """
    reach = ceil(seconds * fps) + 1
    chunk_frames = max(chunk_frames, reach)
    silence = float(seconds)
    group = [*ENTITY, "chunk"]
    names = candidates.columns
    handed = "open array<double>, exits array<double>, fresh_exit double"
    types = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    rows_sql = ", ".join(f"`{c}` {types[c]}" for c in names)
    keys_sql = ", ".join(f"`{c}` {types[c]}" for c in ENTITY) + ", chunk long"

    def columns(batch, *names):
        return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]

    def hand_on(batches):
        for batch in whole_groups(batches, group):
            starts = group_starts(batch, group)
            ts, owned, frame, chunk = columns(batch, "ts", "owned", "frame_id", "chunk")
            owned = owned.astype(bool)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ts))))
            own_ts, own_of = ts[owned], of[owned]
            n = len(own_ts)
            used, first = np.unique(own_of, return_index=True)
            if not n:
                continue
            last = np.append(first[1:], n) - 1
            following = first_not_before(own_ts, own_of, own_ts, own_of, silence)
            ends = chain_ends(following)
            first_of, last_of = np.full(len(starts), -1), np.full(len(starts), -1)
            first_of[used], last_of[used] = first, last
            opens = np.flatnonzero(~owned & (first_of[of] >= 0))
            opens = opens[own_ts[first_of[of[opens]]] - ts[opens] < silence]
            then = first_not_before(own_ts, own_of, ts[opens], of[opens], silence)
            exits = np.where(then < n, own_ts[ends[np.minimum(then, n - 1)]], ts[opens])
            n_open = np.bincount(of[opens], minlength=len(starts))
            # Rows on some chain; without an open start there is one chain only. A group's first row counts them all.
            chosen = np.flatnonzero(on_chains(following, np.concatenate([first, then])))
            seen = np.zeros(n, np.int64)
            seen[first] = last - first + 1
            out = batch.filter(pa.array(owned)).take(pa.array(chosen))
            yield told(
                out, len(chosen), [*names, "chunk"], sure=pa.array(n_open[own_of[chosen]] == 0), seen=pa.array(seen[chosen])
            )
            near_end = frame[owned][last] >= (chunk[starts[used]] + 1) * chunk_frames - reach
            wanted = used[(n_open[used] > 0) | near_end]
            if not len(wanted):
                continue
            # Open starts stand in the order of their groups; groups that are left out have none.
            offsets = pa.array(np.append(0, np.cumsum(n_open[wanted])), pa.int32())
            yield told(
                batch.take(pa.array(starts[wanted])), len(wanted), group,
                open=pa.ListArray.from_arrays(offsets, pa.array(ts[opens], pa.float64())),
                exits=pa.ListArray.from_arrays(offsets, pa.array(exits, pa.float64())),
                fresh_exit=pa.array(own_ts[ends[first_of[wanted]]], pa.float64()),
            )

    def told(batch, n, kept, **added):
        """The columns ``kept`` of a batch and those added; the others null."""
        extra = {"sure": pa.bool_(), "seen": pa.int64(), "open": pa.list_(pa.float64()), "exits": pa.list_(pa.float64())}
        fields = [*[(c, batch.schema.field(c).type) for c in [*names, "chunk"]], *extra.items(), ("fresh_exit", pa.float64())]
        given = {**{c: batch.column(batch.schema.get_field_index(c)) for c in kept}, **added}
        return pa.RecordBatch.from_arrays(
            [given[c] if c in given else pa.nulls(n, t) for c, t in fields], names=[c for c, _ in fields]
        )

    looked_at = staged(
        map_gathered(
            with_halo(candidates, "frame_id", back=reach, size=chunk_frames), group, "ts", hand_on,
            f"{rows_sql}, chunk long, sure boolean, seen long, {handed}",
        )
    )

    def walk(batches):
        key, last = None, None
        for pdf in batches:
            entries = []
            for row in pdf.itertuples(index=False):
                this = tuple(row[: len(ENTITY)])
                if this != key:
                    key, last = this, None
                starts = list(row.open)
                inherits = last is not None and last in starts
                entries.append(last if inherits else None)
                last = list(row.exits)[starts.index(last)] if inherits else row.fresh_exit
            out = pdf[group].copy()
            out["inherited"] = pd.array(entries, dtype="Float64")
            yield out

    inherited = (
        looked_at.where("sure is null")
        .select(*group, "open", "exits", "fresh_exit")
        .repartition(*ENTITY)
        .sortWithinPartitions(*group)
        .mapInPandas(walk, f"{keys_sql}, inherited double")
        .where("inherited is not null")
    )

    def fire(batches):
        for batch in whole_groups(batches, group):
            starts = group_starts(batch, group)
            ts, before = columns(batch, "ts", "inherited")
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ts))))
            # What a chunk inherits stands before its rows.
            carried = ~np.isnan(before.astype(float))
            rows = ~carried
            ts, of, carried_of, carried_ts = ts[rows], of[rows], of[carried], before[carried].astype(float)
            if not len(ts):
                continue
            used, first = np.unique(of, return_index=True)
            free = first[~np.isin(used, carried_of)]
            after = first_not_before(ts, of, carried_ts, carried_of, silence)
            fired = on_chains(first_not_before(ts, of, ts, of, silence), np.concatenate([free, after]))
            yield batch.filter(pa.array(rows)).filter(pa.array(fired)).select(names)

    decided = (
        looked_at.where("not sure")
        .select(*names, "chunk")
        .unionByName(inherited, allowMissingColumns=True)
        .repartition(*group)
        .sortWithinPartitions(*group, F.col("ts").asc_nulls_first())
        .mapInArrow(fire, candidates.schema)
    )
    fired = looked_at.where("sure").select(*names).unionByName(decided)
    return fired, looked_at.where("seen > 0").select("alert_type", "seen")


def alerts(trajectories: DataFrame, fps: int = 30, seconds: float = COOLDOWN_S, chunk_frames: int = CHUNK) -> DataFrame:
    return describe(cooldown(alert_candidates(trajectories), seconds, fps, chunk_frames))


def alert_history(fired: DataFrame, limit: int = HISTORY_ALERTS) -> DataFrame:
    """The newest ``limit`` alerts, at least one, oldest first."""
    order = ["ts", "video_id", "alert_type", "id_lo", "id_hi"]
    return fired.orderBy(*[F.col(c).desc() for c in order]).limit(max(1, limit)).orderBy(*order)


def alert_effectiveness(candidates: DataFrame, fired: DataFrame) -> DataFrame:
    """Fired and suppressed alerts per type, and the share the cool-down suppressed.

    ``candidates`` may be the counts of ``cooldown_tallied``, so that they need not be worked out again.
    """
    n = F.sum("seen") if "seen" in candidates.columns else F.count("*")
    seen = candidates.groupBy("alert_type").agg(n.alias("n"))
    shot = fired.groupBy("alert_type").agg(F.count("*").alias("fired"))
    suppressed = F.col("n") - F.col("fired")
    return seen.join(shot, "alert_type", "left").select(
        "alert_type", "fired", suppressed.alias("suppressed"), F.round(suppressed / F.col("n"), 3).alias("effectiveness")
    )
