"""Scalar motion expressions on state-vector columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.schemas import ACCELERATING_MS2, BRAKING_MS2, HISTORY_S, STOPPED_MS

BOTTOM_CENTRE = ("(x1 + x2) / 2D", "y2")
SPEED = "sqrt(vx * vx + vy * vy)"
ACCEL = "sqrt(ax * ax + ay * ay)"


def frame_time(fps: str = "fps") -> Column:
    """Seconds since the start; the rate is cut to a whole number, and 0 or none means 30."""
    return F.expr(f"frame_id / case when coalesce(cast({fps} as int), 0) = 0 then 30 else cast({fps} as int) end")


def bottom_centre() -> tuple[Column, Column]:
    return F.expr(BOTTOM_CENTRE[0]), F.expr(BOTTOM_CENTRE[1])


def with_motion(df: DataFrame) -> DataFrame:
    """Adds ``speed``, ``accel_mag`` and ``signed_accel``, negative when it points against the velocity."""
    return df.withColumns(
        {
            "speed": F.expr(SPEED),
            "accel_mag": F.expr(ACCEL),
            "signed_accel": F.expr(f"case when vx * ax + vy * ay < 0 then -{ACCEL} else {ACCEL} end"),
        }
    )


def kmh(metres_per_second: Column) -> Column:
    return metres_per_second * 3.6


def behaviour_state() -> Column:
    """State of a row that has ``speed`` and ``signed_accel``."""
    return F.expr(
        f"case when speed < {STOPPED_MS}D then 'STOPPED' when signed_accel < {BRAKING_MS2}D then 'BRAKING'"
        f" when signed_accel > {ACCELERATING_MS2}D then 'ACCELERATING' else 'MOVING' end"
    )


def window_start(ts: str = "ts", seconds: float = HISTORY_S) -> Column:
    return F.expr(f"greatest(0D, {ts} - {float(seconds)}D)")


def window_pointer(start: str, end: str) -> Column:
    """Display label of a time window; keys stay numeric."""
    return F.expr(f"format_string('%.1f-%.1f', {start}, {end})")


def pointer_start(pointer: str) -> Column:
    return F.expr(f"cast(split_part({pointer}, '-', 1) as double)")
