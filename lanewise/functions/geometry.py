"""Planar geometry as SQL expressions. Arguments are SQL text: column names or fragments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.schemas import METRES_PER_DEGREE

PARALLEL_EPS = 1e-10


def project(x: str, y: str, h: str = "h") -> tuple[Column, Column]:
    """Applies a row-major 3x3 homography; a vanishing denominator gives (0, 0)."""
    w = f"({h}[6] * {x} + {h}[7] * {y} + {h}[8])"

    def axis(i: int) -> Column:
        return F.expr(
            f"case when abs({w}) < 1e-12D then 0D"
            f" else ({h}[{i}] * {x} + {h}[{i + 1}] * {y} + {h}[{i + 2}]) / {w} end"
        )

    return axis(0), axis(3)


def with_edges(zones: DataFrame) -> DataFrame:
    """Adds ``edges``: per corner, the edge from the corner before it. Done once per zone, not per box."""
    return zones.withColumn("_before", F.expr("concat(slice(polygon, -1, 1), polygon)")).withColumn(
        "edges",
        F.expr(
            "transform(polygon, (v, i) -> named_struct('x', v.x, 'y', v.y,"
            " 'ox', get(_before, i).x, 'oy', get(_before, i).y))"
        ),
    ).drop("_before")


def point_in_polygon(x: str, y: str, edges: str = "edges") -> Column:
    """Even-odd ray cast to the right over ``with_edges``. No polygon or no position: false."""
    return F.expr(
        f"coalesce(size(filter({edges}, e -> (e.y > {y}) <> (e.oy > {y})"
        f" and {x} < (e.ox - e.x) * ({y} - e.y) / nullif(e.oy - e.y, 0D) + e.x)) % 2 = 1, false)"
    )


def gate_hits(ax: str, ay: str, bx: str, by: str, gates: str = "gates") -> Column:
    """Gates that the move a->b touches, in gate order.

    ``array<struct<idx, name, direction, x, y>>``. Ends count as touching, parallel moves never
    do. The direction compares the move with the gate's normal, 90 degrees counter-clockwise
    from p1->p2.
    """
    dx, dy, gx, gy = f"({bx} - {ax})", f"({by} - {ay})", "(g.p2x - g.p1x)", "(g.p2y - g.p1y)"
    cross = f"({dx} * {gy} - {dy} * {gx})"
    meet = (
        f"transform({gates}, g -> named_struct('idx', g.idx, 'name', g.name,"
        f" 'direction', case when {dx} * (-{gy}) + {dy} * {gx} >= 0 then 'enter' else 'exit' end,"
        f" 't', case when abs({cross}) >= {PARALLEL_EPS:.0e}D then ((g.p1x - {ax}) * {gy} - (g.p1y - {ay}) * {gx}) / {cross} end,"
        f" 'u', case when abs({cross}) >= {PARALLEL_EPS:.0e}D then ((g.p1x - {ax}) * {dy} - (g.p1y - {ay}) * {dx}) / {cross} end))"
    )
    return F.expr(
        f"transform(filter({meet}, m -> m.t between 0 and 1 and m.u between 0 and 1),"
        f" m -> named_struct('idx', m.idx, 'name', m.name, 'direction', m.direction,"
        f" 'x', {ax} + m.t * {dx}, 'y', {ay} + m.t * {dy}))"
    )


def nearest_gate(x: str, y: str, gates: str = "gates") -> Column:
    """``struct<d2, idx, name>`` of the gate with the closest midpoint, the first one on ties."""
    off_x, off_y = f"({x} - (g.p1x + g.p2x) / 2D)", f"({y} - (g.p1y + g.p2y) / 2D)"
    return F.expr(
        f"array_min(transform({gates}, g -> named_struct("
        f"'d2', {off_x} * {off_x} + {off_y} * {off_y}, 'idx', g.idx, 'name', g.name)))"
    )


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.expr(f"sqrt(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))")


def local_east(lat0: str, lon0: str, lon: str) -> Column:
    return F.expr(f"round(({lon} - {lon0}) * {METRES_PER_DEGREE}D * cos(radians({lat0})), 4)")


def local_north(lat0: str, lat: str) -> Column:
    return F.expr(f"round(({lat} - {lat0}) * {METRES_PER_DEGREE}D, 4)")
