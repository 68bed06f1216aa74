"""Speed, heading, lean, steps: position samples to movement."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import gradient, smooth_reflected, smooth_zero


def wrap(angle: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(angle + pi, F.lit(2 * pi)) - pi


def lagged_speed(df: DataFrame, *, keys: list[str], order: str, x: str, y: str, step: int = 1, smoothing: int = 10) -> DataFrame:
    """speed: half the distance over step samples, centred, then zero-padded average; null wherever a frame meets a missing difference."""
    base = Window.partitionBy(*keys).orderBy(order)
    ahead, back = step - step // 2, step // 2
    diff = lambda c: F.lead(c, ahead).over(base) - F.lag(c, back).over(base)
    raw = df.withColumn("_raw", F.hypot(diff(x), diff(y)) / 2)
    frame = base.rowsBetween(-(smoothing // 2), (smoothing - 1) // 2)
    missing = F.max(F.col("_raw").isNull()).over(frame)
    return raw.withColumn("speed", F.when(~missing, smooth_zero(F.col("_raw"), keys=keys, order=order, w=smoothing))).drop("_raw")


def walking_speed(df: DataFrame, *, keys: list[str], order: str, x: str, y: str, rate: float, smooth_s: float | None = 0.2) -> DataFrame:
    """x_m, y_m and speed in m/s of positions in mm."""
    out = df.withColumn("x_m", F.col(x) / 1000).withColumn("y_m", F.col(y) / 1000)
    v = [gradient(F.col(c), keys=keys, order=order, dt=1 / rate) for c in ("x_m", "y_m")]
    out = out.withColumn("_vx", v[0]).withColumn("_vy", v[1]).withColumn("speed", F.sqrt(F.col("_vx") ** 2 + F.col("_vy") ** 2))
    if smooth_s:
        w = max(1, round(smooth_s * rate))
        out = out.withColumn("speed", smooth_zero(F.col("speed"), keys=keys, order=order, w=w))
    return out.drop("_vx", "_vy")


def path_direction(df: DataFrame, *, keys: list[str], order: str, x: str, y: str, smoothing: int = 10) -> DataFrame:
    """direction in [0, 2 pi) of the step from smoothing // 2 samples before to the rest of smoothing after; null at the ends."""
    base = Window.partitionBy(*keys).orderBy(order)
    diff = lambda c: F.lead(c, smoothing - smoothing // 2).over(base) - F.lag(c, smoothing // 2).over(base)
    return df.withColumn("direction", F.pmod(F.atan2(diff(y), diff(x)) + 2 * pi, F.lit(2 * pi)))


def heading(df: DataFrame, *, keys: list[str], order: str, x: str, y: str, rate: float, smooth_w: int) -> DataFrame:
    """heading of the smoothed path (B7), with its gradient in _gx and _gy."""
    out = smooth_reflected(df, keys=keys, order=order, columns={"_sx": x, "_sy": y}, w=smooth_w)
    for c, s in (("_gx", "_sx"), ("_gy", "_sy")):
        out = out.withColumn(c, gradient(F.col(s), keys=keys, order=order, dt=1 / rate))
    return out.withColumn("heading", F.atan2("_gy", "_gx")).drop("_sx", "_sy")


def lean_angle(df: DataFrame, *, keys: list[str], order: str, x: str, y: str, rate: float, direction_s: float = 1.5, lean_s: float = 0.1) -> DataFrame:
    """lean: raw heading minus smoothed heading, wrapped and smoothed."""
    out = heading(df, keys=keys, order=order, x=x, y=y, rate=rate, smooth_w=max(1, round(direction_s * rate)))
    g = [gradient(F.col(c), keys=keys, order=order, dt=1 / rate) for c in (x, y)]
    out = out.withColumn("_raw", wrap(F.atan2(g[1], g[0]) - F.col("heading")))
    return smooth_reflected(out, keys=keys, order=order, columns={"lean": "_raw"}, w=max(1, round(lean_s * rate))).drop("_raw", "_gx", "_gy")


def forward_speed(df: DataFrame, *, keys: list[str], order: str, head: tuple[str, str], feet: dict[str, tuple[str, str]], rate: float, direction_s: float = 1.5, speed_s: float = 0.1) -> DataFrame:
    """A column for each foot: its velocity along the smoothed heading, smoothed (B9); feet: output name to (x, y)."""
    out = heading(df, keys=keys, order=order, x=head[0], y=head[1], rate=rate, smooth_w=max(1, round(direction_s * rate)))
    norm = F.hypot("_gx", "_gy")
    unit = [F.when(norm > 1e-9, F.col(c) / norm).otherwise(0.0) for c in ("_gx", "_gy")]
    out = out.withColumn("_ux", unit[0]).withColumn("_uy", unit[1])
    for name, (fx, fy) in feet.items():
        v = [gradient(F.col(c), keys=keys, order=order, dt=1 / rate) for c in (fx, fy)]
        out = out.withColumn(f"_raw_{name}", F.col("_ux") * v[0] + F.col("_uy") * v[1])
    out = smooth_reflected(out, keys=keys, order=order, columns={n: f"_raw_{n}" for n in feet}, w=max(1, round(speed_s * rate)))
    return out.drop("_gx", "_gy", "_ux", "_uy", *[f"_raw_{n}" for n in feet])


def step_length(df: DataFrame, *, keys: list[str], order: str, pelvis: tuple[str, str], feet: dict[str, tuple[str, str]], smoothing: int = 1) -> DataFrame:
    """A column for each foot: its offset from the pelvis along the pelvis's direction."""
    base = Window.partitionBy(*keys).orderBy(order)
    px, py = (F.col(c) for c in pelvis)
    dx, dy = (F.coalesce(p - F.lag(p).over(base), F.lit(0.0)) for p in (px, py))
    out = df.withColumn("_dx", dx).withColumn("_dy", dy)
    norm = F.hypot("_dx", "_dy")
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    near = (F.abs(px) < 0.5) & (F.abs(py) < 0.5)
    ux, uy = F.when(near, 1.0).otherwise(F.col("_dx") / norm), F.when(near, 0.0).otherwise(F.col("_dy") / norm)
    for name, (fx, fy) in feet.items():
        out = out.withColumn(f"_raw_{name}", (F.col(fx) - px) * ux + (F.col(fy) - py) * uy)
    for name in feet:
        out = out.withColumn(name, smooth_zero(F.col(f"_raw_{name}"), keys=keys, order=order, w=smoothing))
    return out.drop("_dx", "_dy", *[f"_raw_{n}" for n in feet])
