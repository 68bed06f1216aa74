"""Resampling of arrays and trial matrices; array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cycles import array_of, cut_by_interval, in_spans
from .grid import in_chunks
from .kinematics import walking_speed


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def at_position(v: Column, pos: Column) -> Column:
    """Linear interpolation of an array at a position counted from 0."""
    low = F.floor(pos).cast("int")
    part = pos - low
    return F.get(v, low) + F.when(part > 0, part * (F.get(v, low + 1) - F.get(v, low))).otherwise(0.0)


def linear(v: Column, frames: int) -> Column:
    """frames equally spaced points from the first to the last sample."""
    points = F.sequence(F.lit(0), F.lit(frames - 1))
    return bound(v, lambda u: F.transform(points, lambda k: at_position(u, k * ((F.size(u) - 1) / F.lit(float(max(1, frames - 1)))))))


def piecewise(v: Column, frames: int, mid: Column) -> Column:
    """As linear, but mid (kept in [1, size - 2]) lands on point frames // 2."""
    half = frames // 2
    rest = F.lit(float(max(1, frames - half - 1)))
    points = F.sequence(F.lit(0), F.lit(frames - 1))

    def warped(u: Column) -> Column:
        m = F.greatest(F.lit(1), F.least(mid, F.size(u) - 2)).cast("double")
        return F.transform(points, lambda k: at_position(u, F.when(k < half, k * m / max(1, half)).otherwise(m + (k - half) * (F.size(u) - 1 - m) / rest)))

    return bound(v, warped)


def trial_bins(events: DataFrame, windows: DataFrame, *, key: str, n_bins: int, value: str = "value", agg: str = "mean", duration: str | None = None, bucket_s: float | None = None) -> DataFrame:
    """window_id, bin and value of every bin of windows (key, window_id, tmin, tmax): mean or median of the events in it, or null.

    An event counts in the bin of its onset, with duration in all bins from its start to its end. Windows are dealt to blocks of time (in
    units of the median window, unless bucket_s is given; long windows to large blocks), so events meet only the windows around them.
    """
    if bucket_s is None:
        bucket_s = windows.where("tmax > tmin").agg(F.percentile_approx(F.col("tmax") - F.col("tmin"), 0.5)).first()[0] or 1.0
    e = events.select(key, "onset", *([duration] if duration else []), F.nanvl(F.col(value), F.lit(None).cast("double")).alias("_v"))
    j = in_spans(e, windows.select(key, "window_id", "tmin", "tmax"), keys=[key], at="onset", start="tmin", end="tmax", unit=bucket_s)
    bin_of = lambda t: F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), ((t - F.col("tmin")) / (F.col("tmax") - F.col("tmin")) * n_bins).cast("int")))
    first = bin_of(F.col("onset"))
    last = bin_of(F.col("onset") + F.col(duration)) if duration else first
    # an event of negative length counts in no bin
    filled = j.where(last >= first).select(key, "window_id", F.explode(F.sequence(first, last)).alias("bin"), "_v")
    combined = filled.groupBy(key, "window_id", "bin").agg((F.avg("_v") if agg == "mean" else F.median("_v")).alias("value"))
    grid = windows.select(key, "window_id", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return grid.join(combined, [key, "window_id", "bin"], "left")


def trial_speed_matrix(motion: DataFrame, windows: DataFrame, *, key: str, x: str, y: str, rate: float, duration_s: float, smooth_s: float | None = 0.2, bin_s: float = 0.1, order: str = "sample_idx", chunk: int = 65536) -> DataFrame:
    """window_id, bin and value: walking speed in each window (key, window_id, tmin, tmax in seconds from the first sample), stretched to round(duration_s / bin_s) bins (D3).

    Windows that don't lie inside their recording have no rows.
    """
    half = max(1, round((smooth_s or 0) * rate)) // 2
    speed = in_chunks(motion.select(key, order, x, y), lambda d, k: walking_speed(d, keys=k, order=order, x=x, y=y, rate=rate, smooth_s=smooth_s), keys=[key], order=order, chunk=max(chunk, half + 2), halo=half + 2)
    at = lambda t: F.rint(F.col(t) * rate).cast("long")
    spans = windows.select(key, "window_id", at("tmin").alias("s0"), at("tmax").alias("s1")).where("s0 >= 0 AND s1 > s0")
    whole = cut_by_interval(speed.select(key, order, "speed"), spans, keys=[key], order=order).groupBy(key, "window_id", "s0", "s1").agg(array_of(F.col("speed"), F.col(order)).alias("_v"))
    inside = whole.where(F.size("_v") == F.col("s1") - F.col("s0"))
    return inside.select(key, "window_id", F.posexplode(linear(F.col("_v"), max(1, round(duration_s / bin_s)))).alias("bin", "value"))
