"""Bins of samples, path segments, limits, and means over observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .channels import synced
from .grid import chunk_arrays


def bin_means(samples: DataFrame, *, keys: list[str], w: int, columns: list[str], order: str = "sample_idx") -> DataFrame:
    """Means of whole blocks of w samples; a last, shorter block is dropped."""
    g = samples.groupBy(*keys, F.floor(F.col(order) / w).alias("bin")).agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in columns])
    return g.where(F.col("_n") == w).drop("_n")


def joint_bins(a: DataFrame, b: DataFrame, *, key: str, bin_s: float, rate_a: float, rate_b: float, values_a: list[str], values_b: list[str], order: str = "sample_idx", recordings: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """Means of two recordings by bins of their common span: of a with its end sample, of b half-open.

    With recordings (key, pos, start, length: both recordings of each key) only those in sync are joined (A5).
    """
    if recordings is not None:
        a = synced(a, recordings, session=key, tolerance=tolerance)
    span = a.groupBy(key).agg(F.max(order).alias("_a")).join(b.groupBy(key).agg(F.max(order).alias("_b")), key)
    span = span.select(key, F.floor(F.least(F.col("_a") / rate_a, F.col("_b") / rate_b) / bin_s).alias("_bins"))
    wa, wb = bin_s * rate_a, bin_s * rate_b
    pos = F.col(order) / wa
    at = F.floor(pos)
    both = F.array_compact(F.array(at, F.when((pos == at) & (at > 0), at - 1)))
    left = a.withColumn("bin", F.explode(both)).groupBy(key, "bin").agg(*[F.avg(v).alias(v) for v in values_a])
    right = b.withColumn("bin", F.floor(F.col(order) / wb)).groupBy(key, "bin").agg(*[F.avg(v).alias(v) for v in values_b])
    return left.join(right, [key, "bin"]).join(span, key).where("bin < _bins").drop("_bins")


def segments(bins: DataFrame, *, keys: list[str], x: str, y: str, value: str | None = None, weight: bool = False) -> DataFrame:
    """A row for each pair of neighbouring bins: both end points, the mean value, and a weight 1 / (1 + e^(1 - |value|))."""
    base = Window.partitionBy(*keys).orderBy("bin")
    out = bins.withColumn("x1", F.lead(x).over(base)).withColumn("y1", F.lead(y).over(base)).withColumn("_more", F.lead("bin").over(base))
    cols = [F.col(x).alias("x0"), F.col(y).alias("y0"), "x1", "y1"]
    if value:
        out = out.withColumn("_v", (F.col(value) + F.lead(value).over(base)) / 2)
        cols.append(F.col("_v").alias("value"))
        if weight:
            cols.append((1 / (1 + F.exp(1 - F.abs("_v")))).alias("weight"))
    extra = ["label"] if "label" in bins.columns else []
    return out.where("_more IS NOT NULL").select(*keys, "bin", *cols, *extra)


def majority_label(samples: DataFrame, *, keys: list[str], w: int, label: str = "label", order: str = "sample_idx") -> DataFrame:
    """The commonest label of each block of w samples; ties go to the smallest label."""
    n = samples.groupBy(*keys, F.floor(F.col(order) / w).alias("bin"), label).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys, "bin").agg(F.sum("n").alias("_all"), F.max("n").alias("_most"))
    tied = n.join(best, [*keys, "bin"]).where((F.col("n") == F.col("_most")) & (F.col("_all") == w))
    return tied.groupBy(*keys, "bin").agg(F.min(label).alias("label"))


def robust_limits(df: DataFrame, *, keys: list[str], value: str) -> DataFrame:
    """5th and 95th percentile, interpolated, without NaN."""
    clean = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.percentile(clean, 0.05).alias("low"), F.percentile(clean, 0.95).alias("high"))


def mean_sem(df: DataFrame, *, keys: list[str], value: str, sample: bool = False) -> DataFrame:
    """Mean and standard error by keys: of the population's deviation, or (sample) with n - 1."""
    sd = (F.stddev_samp if sample else F.stddev_pop)(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (sd / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def rhythmicity(samples: DataFrame, *, keys: list[str], value: str, rate: float, bin_s: float = 0.1, win_s: float = 2.0, lag_s: tuple[float, float] = (0.3, 2.0), order: str = "sample_idx", chunk: int = 8192) -> DataFrame:
    """Of each bin: the largest autocorrelation (relative to lag 0, mean removed) over the lags of a window around it.

    Windows of less than 16 samples give null, constant ones 0, and those too short for any lag none. All windows of a chunk are
    worked on at once, on an array that holds half a window more at both ends.
    """
    w, half = max(1, round(bin_s * rate)), round(win_s * rate) // 2
    lo = max(1, round(lag_s[0] * rate))
    hi = max(lo + 1, round(lag_s[1] * rate))
    chunk = max(chunk // w * w, -(-(half + w) // w) * w)
    arrays = chunk_arrays(samples, keys=keys, order=order, columns=[value], chunk=chunk, halo=min(chunk, half + w))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for values, numbers, skips, owns, sizes in batches:
            out = []
            for v, c, skip, own, n in zip(values, numbers, skips, owns, sizes, strict=True):
                first = int(c) * chunk - int(skip)
                bins = np.arange(c * chunk // w, min(c * chunk + own, n // w * w) // w)
                out.append(_rhythms(np.asarray(v, float), bins * w + w // 2 - first, half, lo, hi))
            yield pd.Series(out)

    done = arrays.where(F.floor(F.col("n") / w) * w > F.col("chunk") * chunk).select(*keys, "chunk", run(value, "chunk", "skip", "own", "n").alias("_r"))
    rows = done.select(*keys, (F.col("chunk") * (chunk // w)).alias("_first"), F.posexplode("_r").alias("_at", "_v"))
    # -2 says that no lag fits (a ratio is at least -1)
    return rows.where("_v IS NULL OR isnan(_v) OR _v >= -1.5").select(*keys, (F.col("_first") + F.col("_at")).alias("bin"), F.nanvl("_v", F.lit(None).cast("double")).alias("rhythm"))


def _rhythms(v: np.ndarray, centers: np.ndarray, half: int, lo: int, hi: int) -> np.ndarray:
    """Of the windows [center - half, center + half) of v, as far as they lie in it: NaN if shorter than 16, 0 if constant, -2 if no lag fits."""
    if not len(centers):
        return np.zeros(0)
    padded = np.r_[np.zeros(half), v, np.zeros(half)]
    there = np.r_[np.zeros(half), np.ones(len(v)), np.zeros(half)]
    at = centers[:, None] + np.arange(2 * half)
    x, m = padded[at], there[at]
    n = m.sum(1)
    x = (x - (x.sum(1) / np.maximum(n, 1))[:, None]) * m
    zero = (x * x).sum(1)
    best = np.full(len(centers), -np.inf)
    for lag in range(lo, min(hi, 2 * half)):
        s = (x[:, : 2 * half - lag] * x[:, lag:]).sum(1)
        best = np.where(lag < n, np.maximum(best, s), best)
    out = np.where(zero > 1e-12, best / np.where(zero > 1e-12, zero, 1), 0.0)
    out[n < 16] = np.nan
    out[n <= lo] = -2.0
    return out
