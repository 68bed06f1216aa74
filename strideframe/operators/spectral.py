"""Spectral transforms of epochs: Spark keys, batches, normalizes and averages; NumPy transforms arrays inside tasks.

Epochs are rows with an array column signal; all arrays of a batch with one length are transformed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .arrays import array_means
from .channels import pick_arrays, pick_channels
from .cycles import array_of, first_cycles
from .events import with_tag
from .grid import chunk_arrays, from_arrays
from .resample import bound, linear, piecewise
from .stats import cluster_test_arrays


def by_length(signals: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and stacked signals of each length; null and empty ones are left out."""
    sizes = signals.map(lambda x: 0 if x is None else len(x)).to_numpy(int)
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        yield at, np.stack([np.asarray(signals.iloc[i], float) for i in at])


def _per_signal(fn, kind: str, least: int = 1):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            for at, x in by_length(s):
                if x.shape[1] >= least:
                    for i, y in zip(at, fn(x), strict=True):
                        out[i] = y.tolist()
            yield pd.Series(out)

    return run


def _freqs(rate: float, low: float, high: float) -> np.ndarray:
    """The octave grid's frequencies in a band, up to half the rate."""
    grid = K.octave_grid(0, min(90.0, rate / 2))
    inside = grid[(grid >= low) & (grid <= high)]
    if not len(inside):
        raise ValueError("no frequency of the grid lies in the band")
    return inside


def band_reach(*, rate: float, low: float, high: float, method: str = "morlet") -> int:
    """How many samples to each side a sample's band power or phase follows from; shorter signals (no longer than twice this) have none."""
    if method == "morlet":
        return max(len(w) for w in K.wavelet_bank(_freqs(rate, low, high), rate)) // 2
    return 2 * len(K.band_taps(int(rate), low, high, rate))


def _band(x: np.ndarray, rate: float, low: float, high: float, method: str, part, left: bool = True, right: bool = True) -> np.ndarray:
    """part of the transform of rows of signals that begin (left) and end (right) with their recording, else inside it."""
    if method == "morlet":
        return part(K.morlet_transform(x, _freqs(rate, low, high), rate)).mean(1)
    taps = K.band_taps(int(rate), low, high, rate)
    kernel, reach = K.analytic_kernel(taps), 2 * len(taps)
    out = np.zeros(x.shape, complex)
    for i, signal in enumerate(x):
        a, b = reach * left, reach * right
        whole = K.block_convolve(K.odd_ends(signal, a, b) if len(signal) > reach else signal, kernel)
        out[i] = whole[reach + a : reach + a + len(signal)]
    return part(out)


def _power(z: np.ndarray) -> np.ndarray:
    return np.abs(z) ** 2


def band_power(signal: Column, *, rate: float, low: float, high: float, method: str = "morlet") -> Column:
    """Power in a band along the signal: the mean over the grid's frequencies in it (E2), or filtered and squared (E3); null for signals that are too short."""
    return _per_signal(lambda x: _band(x, rate, low, high, method, _power), "array<double>", 2 * band_reach(rate=rate, low=low, high=high, method=method) + 1)(signal)


def band_phase(signal: Column, *, rate: float, low: float, high: float, method: str = "morlet") -> Column:
    """Phase in a band along the signal; of wavelets the plain mean of the angles (E4); null for signals that are too short."""
    return _per_signal(lambda x: _band(x, rate, low, high, method, np.angle), "array<double>", 2 * band_reach(rate=rate, low=low, high=high, method=method) + 1)(signal)


def recording_band(samples: DataFrame, *, keys: list[str], value: str, rate: float, low: float, high: float, method: str = "morlet", output: str = "power", order: str = "sample_idx", chunk: int = 8192) -> DataFrame:
    """keys, order and power (or phase) of a band along whole recordings (E2, E3, E4), on chunks with as many samples beside them as a value follows from.

    Recordings that are no longer than that have no rows.
    """
    reach = band_reach(rate=rate, low=low, high=high, method=method)
    chunk = max(chunk, reach)
    part = _power if output == "power" else np.angle

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for values, numbers, skips, owns, sizes in batches:
            out = []
            for v, c, skip, own, n in zip(values, numbers, skips, owns, sizes, strict=True):
                x = np.asarray(v, float)
                first = c * chunk - skip
                z = _band(x[None], rate, low, high, method, part, left=first == 0, right=first + len(x) == n)[0]
                out.append(z[skip : skip + own])
            yield pd.Series(out)

    arrays = chunk_arrays(samples, keys=keys, order=order, columns=[value], chunk=chunk, halo=reach).where(F.col("n") > 2 * reach)
    done = arrays.select(*keys, "chunk", run(value, "chunk", "skip", "own", "n").alias(output))
    return from_arrays(done, keys=keys, order=order, column=output, chunk=chunk)


def morlet_maps(epochs: DataFrame, *, keys: list[str], rate: float, freqs: list[float], output: str = "power") -> DataFrame:
    """keys, freq and values (power, phase; or re and im) of each epoch (E1); epochs shorter than the longest wavelet have no rows."""
    f = np.array(freqs)
    least = max(map(len, K.wavelet_bank(f, rate)))
    cols = ["re", "im"] if output == "complex" else ["values"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                for at, x in by_length(part["signal"]):
                    if x.shape[1] < least:
                        continue
                    z = K.morlet_transform(x, f, rate)
                    parts = {"power": [np.abs(z) ** 2], "phase": [np.angle(z)], "complex": [z.real, z.imag]}[output]
                    rows = part.iloc[np.repeat(at, len(f))][keys].reset_index(drop=True)
                    rows["freq"] = np.tile(f, len(at))
                    for c, p in zip(cols, parts, strict=True):
                        rows[c] = list(p.reshape(-1, x.shape[1]))
                    yield rows

    kinds = dict(epochs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "freq double", *(f"{c} array<double>" for c in cols)])
    return epochs.select(*keys, "signal").mapInPandas(run, schema)


def baseline_correct(v: Column, start: Column, end: Column, rescale: str = "zscore") -> Column:
    """An array less the mean of its part [start, end), over that part's population deviation (zscore), or itself over it (sd) (E5)."""
    by = {"zscore": lambda x, m, sd: (x - m) / sd, "sd": lambda x, m, sd: x / sd, "mean": lambda x, m, sd: x - m}
    if rescale not in by:
        return v
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = lambda u: total(F.slice(u, start + 1, end - start)) / (end - start)
    spread = lambda u, m: F.sqrt(total(F.transform(F.slice(u, start + 1, end - start), lambda x: (x - m) * (x - m))) / (end - start))
    scaled = lambda u, m: bound(spread(u, m), lambda sd: F.transform(u, lambda x: by[rescale](x, m, F.when(sd == 0, 1.0).otherwise(sd))))
    return bound(v, lambda u: bound(mean(u), lambda m: scaled(u, m)))


def _mean_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, bin, value: the arrays of each key averaged as arrays, and then in rows."""
    return array_means(df, keys=keys, column=column).select(*keys, F.posexplode(column).alias("bin", "value"))


def event_band_power(epochs: DataFrame, *, keys: list[str], rate: float, low: float, high: float, crop: tuple[int, int], baseline: tuple[int, int], buffer: int = 0, method: str = "morlet", rescale: str = "zscore") -> DataFrame:
    """keys, bin, value: band power of samples crop with buffer samples beside it, without the buffer, baseline corrected."""
    a, b = max(0, crop[0] - buffer), crop[1] + buffer
    power = epochs.withColumn("signal", F.slice("signal", a + 1, b - a)).withColumn("_p", band_power(F.col("signal"), rate=rate, low=low, high=high, method=method))
    cut = F.slice("_p", crop[0] - a + 1, crop[1] - crop[0])
    done = power.withColumn("_q", cut).withColumn("_q", baseline_correct(F.col("_q"), F.lit(baseline[0]), F.lit(baseline[1]), rescale))
    return _mean_rows(done, keys, "_q")


def epoch_arrays(samples: DataFrame, *, keys: list[str], picks: list[str] | None = None, available: list[str] | None = None, value: str = "value", order: str = "epoch_idx") -> DataFrame:
    """keys, ch_name and signal of epochs in long rows (keys, ch_name, order, value), of the picked or derived channels (A3)."""
    rows = samples if picks is None else pick_channels(samples.withColumnRenamed(value, "value"), picks, available or [], keys=[*keys, order]).withColumnRenamed("value", value)
    return rows.groupBy(*keys, "ch_name").agg(array_of(F.col(value).cast("double"), F.col(order)).alias("signal"))


def event_traces(epochs: DataFrame, *, keys: list[str], event_key: str, picks: list[str], rate: float, start_s: float, low: float = 4.0, high: float = 8.0, t_range: tuple[float, float] = (-1.0, 2.0), baseline: tuple[float, float] = (-1.0, 0.0), buffer_s: float = 0.5, method: str = "morlet", rescale: str = "zscore", combine: str = "mean") -> DataFrame:
    """keys (with ch_name if combine is "separate"), t and value: band power traces of the epochs (keys, ch_name, description, signal, beginning at start_s) of one event.

    Epochs whose description has the tag event_key, and the picked channels (derived where an epoch doesn't have them), are cut to t_range with a
    buffer at both ends, which the power goes without; it is then baseline corrected.
    """
    if combine not in ("mean", "separate"):
        raise ValueError("combine must be mean or separate")
    chosen = pick_arrays(with_tag(epochs, event_key), picks)
    at = lambda t: round((t - start_s) * rate)
    base = tuple(round((b - t_range[0]) * rate) for b in baseline)
    ids = [*keys, "ch_name"] if combine == "separate" else keys
    traces = event_band_power(chosen, keys=ids, rate=rate, low=low, high=high, crop=(at(t_range[0]), at(t_range[1])), baseline=base, buffer=round(buffer_s * rate), method=method, rescale=rescale)
    return traces.select(*ids, (t_range[0] + F.col("bin") / rate).alias("t"), "value")


def single_cycle_maps(epochs: DataFrame, *, keys: list[str], recording: str, cycle: str, rate: float, freqs: list[float], n_show: int = 5, crop_pad: bool = True, picks: list[str] | None = None) -> DataFrame:
    """recording, cycle, freq, bin, value: wavelet power of each recording's first n_show cycles, mean over (picked or derived) channels, without the pads, not warped."""
    epochs = epochs if picks is None else pick_arrays(epochs, picks)
    ids = list(dict.fromkeys([recording, cycle, *keys]))
    shown = first_cycles(epochs.select(recording, cycle).distinct(), keys=[recording], order=cycle, n=n_show)
    marks = ["cycle_start_idx", "cycle_end_idx"] if crop_pad else []
    maps = morlet_maps(epochs.join(shown, [recording, cycle]), keys=[*ids, *marks], rate=rate, freqs=freqs)
    core = F.slice("values", F.col("cycle_start_idx").cast("int") + 1, (F.col("cycle_end_idx") - F.col("cycle_start_idx")).cast("int")) if crop_pad else F.col("values")
    return _mean_rows(maps.withColumn("_c", core), [recording, cycle, "freq"], "_c")


def average_cycle_map(epochs: DataFrame, *, keys: list[str], rate: float, freqs: list[float], n: int = 250, rescale: str = "zscore", permutations: int = 1024, seed: int = 7, picks: list[str] | None = None) -> DataFrame:
    """freq, bin, phase (0 to 1), value (mean over cycles), t, p and significant of the warped maps of all cycles (E11: E8, D13 and F1); keys name a cycle.

    Maps stay arrays until they are averaged or tested.
    """
    maps = warped_maps(epochs, keys=keys, rate=rate, freqs=freqs, n=n, rescale=rescale, picks=picks)
    number = F.array_position(F.array(*[F.lit(float(f)) for f in freqs]), F.col("freq")).cast("int") - 1
    mean = _mean_rows(maps, ["freq"], "value").withColumn("freq_idx", number)
    test = cluster_test_arrays(maps.select(F.struct(*keys).alias("obs"), number.alias("freq_idx"), F.col("value").alias("values")), n_freqs=len(freqs), n_bins=n, permutations=permutations, seed=seed)
    return mean.join(test, ["freq_idx", "bin"], "left").select("freq", "bin", (F.col("bin") / max(1, n - 1)).alias("phase"), "value", "t", "p", "significant")


def cycle_band_power(epochs: DataFrame, *, keys: list[str], rate: float, low: float, high: float, n: int = 100, method: str = "morlet", rescale: str = "zscore", picks: list[str] | None = None) -> DataFrame:
    """keys, bin, value: band power of padded epochs, normalized over the whole epoch, cut to [cycle_start_idx, cycle_end_idx) and warped to n bins (E7); of all, or of picked or derived channels."""
    epochs = epochs if picks is None else pick_arrays(epochs, picks)
    p = epochs.withColumn("_p", band_power(F.col("signal"), rate=rate, low=low, high=high, method=method))
    p = p.withColumn("_p", baseline_correct(F.col("_p"), F.lit(0), F.size("_p"), rescale))
    return _mean_rows(p.withColumn("_w", _warped(epochs, "_p", n)), keys, "_w")


def _warped(epochs: DataFrame, column: str, n: int) -> Column:
    core = F.slice(column, F.col("cycle_start_idx").cast("int") + 1, (F.col("cycle_end_idx") - F.col("cycle_start_idx")).cast("int"))
    if "cycle_mid_idx" in epochs.columns:
        return piecewise(core, n, (F.col("cycle_mid_idx") - F.col("cycle_start_idx")).cast("int"))
    return linear(core, n)


def warped_maps(epochs: DataFrame, *, keys: list[str], rate: float, freqs: list[float], n: int = 250, rescale: str = "zscore", picks: list[str] | None = None) -> DataFrame:
    """keys, freq and value (an array of n bins): wavelet power per frequency, normalized over the epoch, cut and warped, mean over what keys leave out (E8); of all, or of picked or derived channels."""
    epochs = epochs if picks is None else pick_arrays(epochs, picks)
    marks = [c for c in ("cycle_start_idx", "cycle_mid_idx", "cycle_end_idx") if c in epochs.columns]
    ids = list(dict.fromkeys([*keys, *(["ch_name"] if "ch_name" in epochs.columns else []), *marks]))
    m = morlet_maps(epochs, keys=ids, rate=rate, freqs=freqs).withColumn("_v", baseline_correct(F.col("values"), F.lit(0), F.size("values"), rescale))
    return array_means(m.withColumn("value", _warped(epochs, "_v", n)), keys=[*keys, "freq"], column="value")


def cycle_maps(epochs: DataFrame, *, keys: list[str], rate: float, freqs: list[float], n: int = 250, rescale: str = "zscore", picks: list[str] | None = None) -> DataFrame:
    """keys, freq, bin, value of warped_maps() in rows; keys may leave out the channel."""
    return warped_maps(epochs, keys=keys, rate=rate, freqs=freqs, n=n, rescale=rescale, picks=picks).select(*keys, "freq", F.posexplode("value").alias("bin", "value"))


def segment_psd(samples: DataFrame, *, keys: list[str], value: str, rate: float, segment_s: float = 30.0, n_fft: int = 256, low: float = 1.0, high: float = 100.0, order: str = "sample_idx") -> DataFrame:
    """keys, segment, freq, psd (decibels of the mean over channels) of whole segments; keys may leave out the channel."""
    w = round(segment_s * rate)
    ch = [c for c in ("ch_name",) if c in samples.columns and c not in keys]
    seg = samples.groupBy(*keys, *ch, F.floor(F.col(order) / w).alias("segment")).agg(array_of(F.col(value).cast("double"), F.col(order)).alias("signal")).where(F.size("signal") == w)
    freqs = K.welch(np.zeros((1, n_fft)), rate, n_fft, low, high)[0]
    psd = _per_signal(lambda x: K.welch(x, rate, n_fft, low, high)[1], "array<double>")
    rows = seg.withColumn("_p", psd("signal")).select(*keys, "segment", F.posexplode("_p").alias("k", "p"))
    mean = rows.groupBy(*keys, "segment", "k").agg(F.avg("p").alias("p"))
    return mean.select(*keys, "segment", F.get(F.array(*[F.lit(float(x)) for x in freqs]), F.col("k")).alias("freq"), (10 * F.log10(F.col("p") + 1e-12)).alias("psd"))
