"""Path overlays: one row for each segment of a walked path, with a value or label of what went on there.

Positions are in millimetres and come back in metres. All of them run on chunks of a recording until samples are binned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bins import bin_means, joint_bins, majority_label, rhythmicity, robust_limits, segments
from .channels import combine_channels, pick_channels, synced
from .cycles import paint
from .events import base_label
from .grid import in_chunks, remove_mean
from .kinematics import walking_speed
from .spectral import recording_band


def path_band_power(motion: DataFrame, neural: DataFrame, *, key: str, x: str, y: str, rate: float, neural_rate: float, picks: list[str] | None = None, available: list[str] | None = None, band: tuple[float, float] = (13.0, 30.0), bin_s: float = 0.1, rescale: str | None = "zscore", method: str = "morlet", order: str = "sample_idx", chunk: int = 8192, recordings: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """key, bin, end points, value and weight of path segments: mean power in a band of the channels of neural (key, ch_name, order, value), each normalized over its recording.

    With recordings (key, pos, start, length) only keys whose two recordings are in sync (A5) are taken.
    """
    if recordings is not None:
        motion, neural = (synced(d, recordings, session=key, tolerance=tolerance) for d in (motion, neural))
    chosen = neural if picks is None else pick_channels(neural, picks, available or [], keys=[key, order])
    power = recording_band(chosen, keys=[key, "ch_name"], value="value", rate=neural_rate, low=band[0], high=band[1], method=method, order=order, chunk=chunk)
    if rescale is not None:
        level = power.groupBy(key, "ch_name").agg(F.avg("power").alias("_m"), F.stddev_pop("power").alias("_s"))
        spread = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
        scaled = {"zscore": (F.col("power") - F.col("_m")) / spread, "sd": F.col("power") / spread, "mean": F.col("power") - F.col("_m")}
        power = power.join(level, [key, "ch_name"]).withColumn("power", scaled.get(rescale, F.col("power")))
    power = combine_channels(power, keys=[key, order], value="power")
    metres = motion.select(key, order, (F.col(x) / 1000).alias("x_m"), (F.col(y) / 1000).alias("y_m"))
    b = joint_bins(metres, power, key=key, bin_s=bin_s, rate_a=rate, rate_b=neural_rate, values_a=["x_m", "y_m"], values_b=["power"], order=order)
    return segments(b, keys=[key], x="x_m", y="y_m", value="power", weight=True)


def path_speed(motion: DataFrame, *, key: str, x: str, y: str, rate: float, bin_s: float | None = 0.1, smooth_s: float | None = 0.2, order: str = "sample_idx", chunk: int = 65536) -> DataFrame:
    """key, bin, end points and value of path segments: walking speed in m/s (P2); without bin_s each sample is a point."""
    half = max(1, round((smooth_s or 0) * rate)) // 2
    speed = in_chunks(motion.select(key, order, x, y), lambda d, k: walking_speed(d, keys=k, order=order, x=x, y=y, rate=rate, smooth_s=smooth_s), keys=[key], order=order, chunk=max(chunk, half + 2), halo=half + 2)
    b = speed.withColumn("bin", F.col(order)) if bin_s is None else bin_means(speed, keys=[key], w=max(1, round(bin_s * rate)), columns=["x_m", "y_m", "speed"], order=order)
    return segments(b, keys=[key], x="x_m", y="y_m", value="speed")


def path_rhythmicity(motion: DataFrame, *, key: str, x: str, y: str, rhythm: str, rate: float, bin_s: float = 0.1, win_s: float = 2.0, lag_s: tuple[float, float] = (0.3, 2.0), order: str = "sample_idx", chunk: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Segments (key, bin, end points, value: how rhythmic a channel is there) and, of each recording, the limits of their values (P3). Recordings no longer than a window have no rows."""
    w, window = max(1, round(bin_s * rate)), round(win_s * rate)
    long = motion.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > window).select(key)
    rows = remove_mean(motion.join(long, key, "left_semi").select(key, order, x, y, rhythm), keys=[key], column=rhythm, name="_r")
    rows = rows.withColumns({"x_m": F.col(x) / 1000, "y_m": F.col(y) / 1000})
    r = rhythmicity(rows, keys=[key], value="_r", rate=rate, bin_s=bin_s, win_s=win_s, lag_s=lag_s, order=order, chunk=chunk)
    b = bin_means(rows, keys=[key], w=w, columns=["x_m", "y_m"], order=order).join(r, [key, "bin"])
    out = segments(b, keys=[key], x="x_m", y="y_m", value="rhythm")
    return out, robust_limits(out, keys=[key], value="value")


def path_gait_phase(motion: DataFrame, annotations: DataFrame, *, key: str, x: str, y: str, rate: float, annot_type: str = "gait_lean", bin_s: float = 0.05, order: str = "sample_idx") -> DataFrame:
    """key, bin, end points and label of path segments: the commonest label of annot_type in the segment's first bin, reset where there is none."""
    w = max(1, round(bin_s * rate))
    known = annotations.withColumn("description", base_label(F.col("description"))).where(F.col("description").isin([f"{annot_type}_{k}" for k in ("left", "right", "reset")]))
    painted = paint(motion.select(key, order), known, key=key, rate=rate, order=order, default=f"{annot_type}_reset")
    metres = motion.select(key, order, (F.col(x) / 1000).alias("x_m"), (F.col(y) / 1000).alias("y_m"))
    b = bin_means(metres, keys=[key], w=w, columns=["x_m", "y_m"], order=order).join(majority_label(painted, keys=[key], w=w, order=order), [key, "bin"])
    return segments(b, keys=[key], x="x_m", y="y_m")
