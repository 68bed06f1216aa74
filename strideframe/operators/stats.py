"""Permutation test of average maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import t_values, tfce
from ..sources.tables import stored

_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def flips(obs: np.ndarray, permutations: np.ndarray, seed: int) -> np.ndarray:
    """Signs (permutations x observations) of 64-bit keys of observations: the same wherever an observation is."""
    with np.errstate(over="ignore"):
        x = obs.view(np.uint64)[None] + (permutations.astype(np.uint64)[:, None] + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in zip((30, 27), _MULTIPLIERS, strict=True):
            x = (x ^ (x >> np.uint64(shift))) * by
    return np.where(x >> np.uint64(63), 1.0, -1.0)


def t_map(maps: DataFrame) -> DataFrame:
    """freq_idx, bin and t (0 without spread) of maps (obs, freq_idx, bin, value) against 0."""
    g = maps.groupBy("freq_idx", "bin").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("value").alias("_n"))
    return g.select("freq_idx", "bin", F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") / F.sqrt("_n"))).otherwise(0.0).alias("t"))


def cluster_test(maps: DataFrame, *, n_freqs: int, n_bins: int, permutations: int = 1024, seed: int = 7, **sizes: int) -> DataFrame:
    """cluster_test_arrays() of maps in rows (obs, freq_idx, bin, value); a cell that an observation doesn't have is 0."""
    cells = F.map_from_entries(F.collect_list(F.struct("bin", F.col("value").cast("double").alias("value"))))
    total = maps.where("bin IS NOT NULL").groupBy("obs", "freq_idx", "bin").agg(F.sum("value").alias("value"))
    rows = total.groupBy("obs", "freq_idx").agg(cells.alias("_c"))
    arrays = rows.select("obs", "freq_idx", F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.try_element_at("_c", b), F.lit(0.0))).alias("values"))
    return cluster_test_arrays(arrays, n_freqs=n_freqs, n_bins=n_bins, permutations=permutations, seed=seed, **sizes)


def _by_group(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of sorted batches that lie in one group."""
    for b in batches:
        if b.num_rows:
            ids = np.stack([b[c].to_numpy() for c in by])
            starts = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(0)])
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                yield tuple(ids[:, lo].tolist()), b.slice(lo, hi - lo)


def cluster_test_arrays(maps: DataFrame, *, n_freqs: int, n_bins: int, permutations: int = 1024, seed: int = 7, block: int = 32, tile: int = 256, obs_per_task: int = 50_000) -> DataFrame:
    """freq_idx, bin, t, p and significant (p < 0.05) of maps (obs, freq_idx, values: an array of n_bins) against 0, by sign flips and TFCE (F1).

    Rows are dealt by tile (up to tile bins of a frequency, of up to about obs_per_task observations): a task streams through a tile's rows and holds
    its sums for all permutations (2 MB at the defaults), since an observation's signs follow from its key alone. The sums of a block of
    permutations then meet in one task, which adds them to that block's maps; only the observed map and counts of cells go through the
    driver. Missing rows and values are 0. Less than two observations give an empty result.
    """
    spark, cells = maps.sparkSession, n_freqs * n_bins
    schema = "freq_idx int, bin int, t double, p double, significant boolean"
    rows = maps.select(F.xxhash64("obs").alias("obs"), F.col("freq_idx").cast("int").alias("freq_idx"), F.col("values").cast("array<double>").alias("values"))
    n_obs = rows.agg(F.count_distinct("obs")).first()[0]
    if n_obs < 2:
        return spark.createDataFrame([], schema)
    slices, salts = -(-n_bins // tile), -(-n_obs // obs_per_task)
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.struct((F.col("freq_idx") * slices + s).alias("tile"), F.slice("values", s * tile + 1, tile).alias("values"))))
    tiles = rows.select("obs", F.pmod(F.hash("obs"), F.lit(salts)).alias("salt"), cut.alias("x")).select("obs", "salt", "x.*")

    def width(k: int) -> int:
        return min(tile, n_bins - k % slices * tile)

    def flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)

        def sums() -> pa.RecordBatch:
            starts = list(range(0, permutations, block))
            parts = [total[:2].tobytes(), *[total[2 + b : 2 + min(b + block, permutations)].tobytes() for b in starts]]
            return pa.RecordBatch.from_arrays([pa.array([-1, *range(len(starts))], pa.int32()), pa.array([now[0]] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["block", "tile", "sums"])

        for key, b in _by_group(batches, ["tile", "salt"]):
            if key != now:
                if now is not None:
                    yield sums()
                now, total = key, np.zeros((2 + permutations, width(key[0])))
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.zeros((part.num_rows, total.shape[1]))
                for i, v in enumerate(part["values"]):
                    own = np.nan_to_num(v.values.to_numpy(zero_copy_only=False).astype(float)) if v.is_valid else []
                    x[i, : len(own)] = own
                total[0] += x.sum(0)
                total[1] += (x * x).sum(0)
                total[2:] += flips(part["obs"].to_numpy(), np.arange(permutations), seed) @ x
        if now is not None:
            yield sums()

    sums = stored(tiles.repartition("tile", "salt").sortWithinPartitions("tile", "salt").mapInArrow(flipped, "block int, tile int, sums binary"))

    def place(total: np.ndarray, k: int, raw: bytes) -> None:
        at = k // slices * n_bins + k % slices * tile
        total[:, at : at + width(k)] += np.frombuffer(raw).reshape(len(total), -1)

    observed = np.zeros((2, cells))
    for r in sums.where("block = -1").toLocalIterator():
        place(observed, r["tile"], r["sums"])
    t = t_values(observed[0], observed[1], n_obs)
    seen, squares = np.abs(tfce(t.reshape(n_freqs, n_bins))).ravel(), observed[1]

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n = None, np.zeros(0), np.zeros(cells, np.int64)

        def most() -> np.ndarray:
            peaks = [np.abs(tfce(t_values(x, squares, n_obs).reshape(n_freqs, n_bins))).max() for x in total]
            return (np.array(peaks)[:, None] >= seen[None]).sum(0)

        for key, b in _by_group(batches, ["block"]):
            if key != now:
                n += most() if now is not None else 0
                now, total = key, np.zeros((min(block, permutations - key[0] * block), cells))
            for k, raw in zip(b["tile"].to_pylist(), b["sums"], strict=True):
                place(total, k, raw.as_py())
        if now is not None:
            n += most()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(n)], ["cell", "n"])

    parts = sums.where("block >= 0").repartition("block").sortWithinPartitions("block").mapInArrow(beaten, "cell int, n long")
    p = parts.groupBy("cell").agg(((F.sum("n") + 1) / (permutations + 1)).alias("p"))
    own = spark.createDataFrame(pd.DataFrame({"cell": np.arange(cells), "t": t}), "cell int, t double")
    return own.join(p, "cell").select(F.floor(F.col("cell") / n_bins).cast("int").alias("freq_idx"), (F.col("cell") % n_bins).cast("int").alias("bin"), "t", "p", (F.col("p") < 0.05).alias("significant"))
