"""Small signals whose answers are worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import kernels as K
from strideframe.operators import artifact, bins, channels, cycles, events, grid, kinematics, overlays, resample, spectral, stats

KEYS = {"keys": ["r"], "order": "i"}


def samples(spark, **columns):
    names = list(columns)
    rows = [(1, i, *map(float, v)) for i, v in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "r long, i long, " + ", ".join(f"{n} double" for n in names))


def column(df, name):
    return [x[name] for x in df.orderBy("i").select(name).collect()]


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a is None) == (b is None) and (b is None or abs(a - b) < 1e-9), (got, want)


SQUARES = [0, 1, 4, 9, 16]


@pytest.mark.parametrize("w,want", [(3, [0, 5 / 3, 14 / 3, 29 / 3, 16]), (4, [-1, 1, 3.5, 7.5, 13])])
def test_smooth_reflected(spark, w, want):
    close(column(grid.smooth_reflected(samples(spark, v=SQUARES), **KEYS, columns={"s": "v"}, w=w), "s"), want)


def test_smooth_zero_and_gradient(spark):
    df = samples(spark, v=SQUARES)
    close(column(df.withColumn("s", grid.smooth_zero(F.col("v"), **KEYS, w=3)), "s"), [1 / 3, 5 / 3, 14 / 3, 29 / 3, 25 / 3])
    close(column(df.withColumn("s", grid.gradient(F.col("v"), **KEYS, dt=0.5)), "s"), [2, 4, 8, 12, 14])


def test_wide_frames_equal_narrow_ones(spark, monkeypatch):
    df = samples(spark, v=np.random.default_rng(0).normal(size=200))
    want = column(grid.smooth_reflected(df, **KEYS, columns={"s": "v"}, w=25), "s")
    monkeypatch.setattr(grid, "WIDE", 3)
    close(column(grid.smooth_reflected(df, **KEYS, columns={"s": "v"}, w=25), "s"), want)


def test_chunks_equal_whole(spark):
    df = samples(spark, v=np.random.default_rng(1).normal(size=300))
    want = column(grid.smooth_reflected(df, **KEYS, columns={"s": "v"}, w=15), "s")
    cut = grid.smooth_reflected(grid.with_halo(df, order="i", chunk=64, halo=16), keys=["r", "chunk"], order="i", columns={"s": "v"}, w=15)
    close(column(grid.drop_halo(cut), "s"), want)


def test_speed_direction_and_wrap(spark):
    df = samples(spark, x=[0, 3, 3, 6], y=[0, 4, 4, 8])
    close(column(kinematics.lagged_speed(df, **KEYS, x="x", y="y", step=1, smoothing=1), "speed"), [2.5, 0, 2.5, None])
    close(column(kinematics.lagged_speed(df, **KEYS, x="x", y="y", step=1, smoothing=2), "speed"), [1.25, 1.25, 1.25, None])
    square = samples(spark, x=[0, 1, 1, 0], y=[0, 0, 1, 1])
    close(column(kinematics.path_direction(square, **KEYS, x="x", y="y", smoothing=2), "direction"), [None, math.pi / 4, 3 * math.pi / 4, None])
    a = samples(spark, v=[3 * math.pi / 2, -3 * math.pi / 2, math.pi]).withColumn("w", kinematics.wrap(F.col("v")))
    close(column(a, "w"), [-math.pi / 2, math.pi / 2, -math.pi])


def test_step_length(spark):
    df = samples(spark, px=[1, 2, 2], py=[0, 0, 0], fx=[1.3, 2.4, 2.5], fy=[0, 0, 0])
    close(column(kinematics.step_length(df, **KEYS, pelvis=("px", "py"), feet={"s": ("fx", "fy")}), "s"), [0, 0.4, 0])
    near = samples(spark, px=[0.1], py=[0.1], fx=[0.4], fy=[0])
    close(column(kinematics.step_length(near, **KEYS, pelvis=("px", "py"), feet={"s": ("fx", "fy")}), "s"), [0.3])


@pytest.mark.parametrize("least,want", [(2, [(0.0, 0.2, -1), (0.3, 0.3, 1)]), (1, [(0.0, 0.2, -1), (0.2, 0.1, 0), (0.3, 0.3, 1)])])
def test_runs(spark, least, want):
    df = samples(spark, s=[-1, -1, 0, 1, 1, 1, -1])
    got = events.runs_to_events(df, **KEYS, state="s", rate=10.0, min_samples=least).orderBy("onset").collect()
    assert [(round(x.onset, 9), round(x.duration, 9), x.state) for x in got] == want
    assert events.runs_to_events(samples(spark, s=[1]), **KEYS, state="s", rate=10.0).count() == 0


def test_replacing_and_parsing(spark):
    ann = lambda names: spark.createDataFrame([(1, n) for n in names], "r long, description string")
    old, new = ann(["gait_lean_left", "gait_lean_reset", "beep"]), ann(["gait_lean_left", "gait_lean_right"])
    assert sorted(x.description for x in events.replace_by_description(old, new, keys=["r"]).collect()) == ["beep", "gait_lean_left", "gait_lean_reset", "gait_lean_right"]
    old = ann(["lr_step_left/steplen0.500", "lr_step_reset", "beep"])
    assert [x.description for x in events.replace_by_label(old, new.limit(0), ["lr_step_left", "lr_step_right", "lr_step_reset"]).collect()] == ["beep"]
    tags = ann(["lr_step_left/steplen0.523", "gait_lean_left", "x/steplenabc"]).select(events.step_length_tag(F.col("description")).alias("v"), events.base_label(F.col("description")).alias("b"))
    assert sorted(tags.collect(), key=str) == sorted([(0.523, "lr_step_left"), (None, "gait_lean_left"), (None, "x")], key=str)


def test_cycle_pairing(spark):
    rows = [("L", 0.0), ("R", 0.5), ("L", 1.0), ("L", 1.2), ("R", 1.6), ("R", 1.8), ("L", 2.4), ("R", 2.9)]
    df = spark.createDataFrame([(1, k, t) for k, t in rows], "r long, kind string, onset double")
    got = cycles.pair_cycles(df, keys=["r"], tie="kind").orderBy("onset").collect()
    assert [(x.onset, round(x.duration, 9), x.right_onset) for x in got] == [(0.0, 1.0, 0.5), (1.2, 1.2, 1.6)]


def test_cue_cycles(spark):
    df = spark.createDataFrame([(10.0, 13.2), (5.0, 5.4)], "t0 double, t1 double")
    assert sorted(x.onset for x in cycles.cue_cycles(df, length_s=1.0).collect()) == [10.0, 11.0, 12.0]


def test_resampling(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 10.0],)], "v array<double>")
    close(df.select(resample.linear(F.col("v"), 4)).first()[0], [0, 4 / 3, 8 / 3, 10])
    close(df.select(resample.linear(F.col("v"), 1)).first()[0], [0])
    close(df.select(resample.piecewise(F.col("v"), 4, F.lit(3))).first()[0], [0, 1.5, 3, 10])


def test_trial_bins(spark):
    w = spark.createDataFrame([(1, 1, 10.0, 20.0)], "r long, window_id long, tmin double, tmax double")
    e = spark.createDataFrame([(1, 10.0, 1.0), (1, 11.9, 3.0), (1, 19.999, 7.0), (1, 20.0, 9.0)], "r long, onset double, value double")
    assert [x.value for x in resample.trial_bins(e, w, key="r", n_bins=5).orderBy("bin").collect()] == [2, None, None, None, 7]
    d = spark.createDataFrame([(1, 12.0, 6.0, 4.0)], "r long, onset double, value double, dur double")
    assert [x.value for x in resample.trial_bins(d, w, key="r", n_bins=5, duration="dur").orderBy("bin").collect()] == [None, 6, 6, 6, None]


def test_limits_and_baseline(spark):
    assert abs(bins.robust_limits(samples(spark, v=[1, 2, 4, 10]), keys=["r"], value="v").first().low - 1.15) < 1e-9
    base = lambda v, how: spark.createDataFrame([(list(map(float, v)),)], "v array<double>").select(spectral.baseline_correct(F.col("v"), F.lit(0), F.lit(2), how)).first()[0]
    close(base([1, 2, 3, 4], "zscore"), [-1, 1, 3, 5])
    close(base([1, 2, 3, 4], "sd"), [2, 4, 6, 8])
    close(base([1, 2, 3, 4], "mean"), [-0.5, 0.5, 1.5, 2.5])
    close(base([2, 2, 5], "zscore"), [0, 0, 3])
    close(base([2, 2, 5], "other"), [2, 2, 5])


def test_channels(spark):
    df = spark.createDataFrame([(1, c, v) for c, v in (("ZERO_THREE_LEFT", 5.0), ("ONE_THREE_LEFT", 3.0), ("ZERO_TWO_LEFT", 4.0))], "i long, ch_name string, value double")
    got = channels.rereference(df, ["ZERO_ONE_LEFT", "ONE_TWO_LEFT", "TWO_THREE_LEFT"], keys=["i"])
    assert {x.ch_name: x.value for x in got.collect()} == {"ZERO_ONE_LEFT": 2, "ONE_TWO_LEFT": 2, "TWO_THREE_LEFT": 1}
    with pytest.warns(UserWarning):
        assert channels.bipolar_terms("ONE_ZERO_LEFT") is None
    with pytest.raises(ValueError):
        channels.bipolar_terms("ONE_FIVE_LEFT")


def test_overlap(spark):
    span = lambda *s: channels.common_span(spark.createDataFrame([(1, a, b - a) for a, b in s], "s long, start double, length double"), session="s").first().overlap
    assert span((0.0, 10.0), (10.0, 20.0)) and not span((0.0, 10.0), (10.5, 20.0))


def test_spacing(spark):
    runs = spark.createDataFrame([("a", 1, 1), ("a", 3, 3), ("a", 20, 22), ("a", 60, 60), ("b", 5, 31), ("b", 33, 36), ("b", 47, 47)], "r string, s long, e long")
    got = artifact.spaced(runs, keys=["r"], advance=10, start="s", end="e").orderBy("r", "at").collect()
    assert [(x.r, x.at) for x in got] == [("a", 1), ("a", 20), ("a", 60), ("b", 5), ("b", 15), ("b", 25), ("b", 35), ("b", 47)]
    assert artifact.spaced(runs.limit(0), keys=["r"], advance=10, start="s", end="e").count() == 0


def greedy(x, threshold, pre, post, advance):
    hits, i = [], pre
    while i < len(x) - post:
        if x[i] < threshold:
            hits.append(i)
            i += advance
        else:
            i += 1
    return hits


def noisy(seed, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    shape = np.r_[-6.0, -9.0, -9.0, 3.0, 2.0]
    for at in rng.integers(10, n - 10, 25):
        x[at - 1 : at + 4] += shape
    return np.round(x, 6)


def brute_filter(x, pre, post, disc, filt, sd):
    """The whole artifact job on one channel, sample by sample."""
    width = pre + post
    hits = greedy(x, -sd * x.std(), pre, post, disc)
    t = np.mean([x[i - pre : i + post] for i in hits], axis=0)
    t = t - t.mean()
    padded = np.r_[np.zeros(width), x - x.mean(), np.zeros(width)]
    xc = np.array([padded[width + p - width // 2 : width + p - width // 2 + width] @ t for p in range(len(x))])
    tops = [p for p in range(1, len(x) - 1) if xc[p] > xc[p - 1] and xc[p] > xc[p + 1] and xc[p] >= 0.5 * (t @ t)]
    kept = []
    for p in tops:
        if not kept or p - kept[-1] >= filt:
            kept.append(p)
    clean, used = x.copy(), 0
    for p in kept:
        s = p - width // 2
        if s >= 0 and s + width <= len(x):
            a, _ = np.linalg.lstsq(np.c_[t, np.ones(width)], clean[s : s + width], rcond=None)[0]
            clean[s : s + width] -= a * t
            used += 1
    return hits, kept, used, clean


def test_artifact_filter_equals_brute_force(spark):
    signals = {"a": noisy(1), "b": noisy(2), "flat": np.zeros(200)}
    rows = [(1, c, i, float(v)) for c, x in signals.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "r long, ch string, sample_idx long, v double")
    for filt in (0, 9):  # windows of 9 samples overlap in the first case
        clean, quality, counts = artifact.filter_artifact(df, keys=["r", "ch"], value="v", rate=1.0, window=(-3, 6), discover_advance_s=20, filter_advance_s=filt, sd=3.0, chunk=64)
        got = {(x.ch, x.sample_idx): x.clean for x in clean.collect()}
        n = {x.ch: (x.n_discovered, x.n_subtracted) for x in counts.collect()}
        assert len(got) == len(rows) and n["flat"] == (0, 0) and all(got["flat", i] == 0 for i in range(200))
        for c in ("a", "b"):
            hits, _, used, want = brute_filter(signals[c], 3, 6, 20, filt, 3.0)
            assert n[c] == (len(hits), used) and used > 5
            assert np.allclose([got[c, i] for i in range(900)], want, atol=1e-9)
        assert quality.where("k = 0").count() == 2 and quality.columns == ["r", "ch", "k", "n", "before_mean", "before_sem", "after_mean", "after_sem"]


def test_peaks_and_flat_tops(spark):
    x = [0, 2, 1, 3, 3, 3, 1, 1, 4, 4, 5, 5, 2, 6, 6]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "r long, sample_idx long, xc double")
    at = lambda h, chunk: sorted(r.at for r in artifact.peaks(df, spark.createDataFrame([(1, h)], "r long, height double"), keys=["r"], chunk=chunk).collect())
    for chunk in (3, 4, 100):
        assert at(1.5, chunk) == [1, 4, 10] and at(2.5, chunk) == [4, 10] and at(9.0, chunk) == []


def test_one_window_is_fitted(spark):
    x = samples(spark, v=[9, 15, 9]).withColumnRenamed("i", "sample_idx")
    t = spark.createDataFrame([(1, k, v) for k, v in enumerate([-1.0, 2.0, -1.0])], "r long, k long, t double")
    at = spark.createDataFrame([(1, 1)], "r long, at long")
    assert [r.clean for r in artifact.subtract(x, at, t, keys=["r"], value="v", width=3).orderBy("sample_idx").collect()] == [11, 11, 11]


def test_wavelets_find_a_sinusoid():
    f = K.octave_grid(0, 90)
    assert len(f) == 65 and len(K.octave_grid(2, 90)) == 45
    t = np.arange(1500) / 250
    power = np.abs(K.morlet_transform(np.sin(2 * np.pi * 16 * t)[None], f[f >= 4], 250.0)) ** 2
    assert abs(f[f >= 4][power[0, :, 700].argmax()] - 16) < 1.2


def test_wavelet_convolution_is_the_direct_sum():
    x = np.random.default_rng(0).normal(size=(1, 64))
    w = K.morlet(8.0, 64.0, 4.0)
    want = np.convolve(x[0], w)[len(w) // 2 :][:64]
    assert np.allclose(K.morlet_transform(x, np.array([8.0]), 64.0)[0, 0], want)


def test_bands_of_chunks_equal_whole_recordings(spark):
    x = np.random.default_rng(5).normal(size=(2, 700))
    rows = [(r, i, float(v)) for r in range(2) for i, v in enumerate(x[r])] + [(9, i, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "r long, sample_idx long, v double")
    whole = df.groupBy("r").agg(cycles.array_of(F.col("v"), F.col("sample_idx")).alias("signal"))
    for method, low, high in (("morlet", 4, 8), ("hilbert", 8, 13)):
        for output, column in (("power", spectral.band_power), ("phase", spectral.band_phase)):
            want = {r.r: r.p for r in whole.select("r", column(F.col("signal"), rate=64.0, low=low, high=high, method=method).alias("p")).collect()}
            got = spectral.recording_band(df, keys=["r"], value="v", rate=64.0, low=low, high=high, method=method, output=output, chunk=150).orderBy("r", "sample_idx").collect()
            assert len(got) == (1400 if method == "hilbert" else 1500)  # too short for the filter: no rows
            for r in (0, 1):
                assert np.allclose([g[output] for g in got if g.r == r], want[r], atol=1e-9)
        assert (want[9] is None) == (method == "hilbert")


def test_filter_keeps_its_band():
    t = np.arange(3000) / 250
    taps = K.band_taps(250, 8, 13, 250)
    rng = np.random.default_rng(2)
    x = np.sin(2 * np.pi * 10.5 * t) + np.sin(2 * np.pi * 40 * t) + 0.2 * rng.normal(size=3000)
    z = spectral._band(x[None], 250.0, 8, 13, "hilbert", lambda v: v)[0]
    # forward and backward, then the Hilbert transform of the whole, away from the ends
    once = np.convolve(np.convolve(x, taps, "same")[::-1], taps, "same")[::-1]
    gain = np.zeros(3000)
    gain[0], gain[1:1500], gain[1500] = 1, 2, 1
    want = np.fft.ifft(np.fft.fft(once) * gain)
    assert np.abs(z - want)[900:2100].max() < 2e-3
    assert 0.9 < np.abs(z[900:2100]).min() and np.abs(z[900:2100]).max() < 1.15
    assert np.allclose(K.odd_ends(np.array([1.0, 2.0, 4.0]), 2, 1), [-2, 0, 1, 2, 4, 6])


def test_cluster_test_finds_a_planted_effect(spark):
    from strideframe.operators import stats

    x = np.random.default_rng(3).normal(size=(20, 4, 6))
    x[:, 1:3, 2:4] += 2.5
    rows = [(i, f, k, float(x[i, f, k])) for i in range(20) for f in range(4) for k in range(6)]
    got = stats.cluster_test(spark.createDataFrame(rows, "obs long, freq_idx int, bin int, value double"), n_freqs=4, n_bins=6, permutations=128)
    found = {(r.freq_idx, r.bin) for r in got.collect() if r.significant}
    assert {(1, 2), (1, 3), (2, 2), (2, 3)} <= found and len(found) < 12


def test_cluster_test_equals_brute_force(spark):
    x = np.random.default_rng(4).normal(size=(9, 3, 4)) + 0.6
    rows = [(i, f, k, float(x[i, f, k])) for i in range(9) for f in range(3) for k in range(4)]
    df = spark.createDataFrame(rows, "obs long, freq_idx int, bin int, value double").repartition(5)
    keys = {r.obs: r.h for r in df.select("obs", F.xxhash64("obs").alias("h")).distinct().collect()}
    signs = stats.flips(np.array([keys[i] for i in range(9)], np.int64), np.arange(200), 7)
    t = lambda y: y.mean(0) / y.std(0, ddof=1) * 3
    seen = np.abs(K.tfce(t(x)))
    beaten = sum(np.abs(K.tfce(t(x * s[:, None, None]))).max() >= seen for s in signs)
    got = {(r.freq_idx, r.bin): r for r in stats.cluster_test(df, n_freqs=3, n_bins=4, permutations=200, block=16).collect()}
    assert len(got) == 12 and abs(signs.mean()) < 0.1
    for f in range(3):
        for k in range(4):
            assert abs(got[f, k].t - t(x)[f, k]) < 1e-9 and abs(got[f, k].p - (beaten[f, k] + 1) / 201) < 1e-12
    assert stats.cluster_test(df.where("obs = 1"), n_freqs=3, n_bins=4).count() == 0
    assert {(r.freq_idx, r.bin): round(r.t, 9) for r in stats.t_map(df).collect()} == {(f, k): round(t(x)[f, k], 9) for f in range(3) for k in range(4)}


def test_runs_go_across_chunks(spark):
    s = np.repeat(np.random.default_rng(6).integers(-1, 2, 40), np.random.default_rng(7).integers(1, 30, 40))
    df = samples(spark, s=s, x=np.arange(len(s)) ** 1.5, y=np.zeros(len(s)))
    feet = {"left": ("x", "y"), "right": ("x", "y")}
    runs = lambda chunk: sorted(map(tuple, events.runs_to_events(df, **KEYS, state="s", rate=10.0, feet=feet, chunk=chunk).collect()))
    assert runs(7) == runs(64) == runs(10_000) and len(runs(7)) > 20


def brute_rhythm(x, w, half, lo, hi):
    out = []
    for b in range(len(x) // w):
        c = b * w + w // 2
        v = x[max(0, c - half) : c + half]
        v = v - v.mean()
        ac = [v[: len(v) - k] @ v[k:] for k in range(len(v))]
        out.append(None if len(v) < 16 else 0.0 if ac[0] <= 1e-12 else max(ac[lo : min(hi, len(v))]) / ac[0])
    return out


def test_rhythmicity_equals_brute_force(spark):
    x = np.round(np.sin(np.arange(157) / 2) + np.random.default_rng(8).normal(size=157) / 3, 6)
    df = samples(spark, v=x).withColumnRenamed("i", "sample_idx")
    for chunk in (30, 8192):
        got = bins.rhythmicity(df, keys=["r"], value="v", rate=10.0, bin_s=0.3, win_s=2.4, lag_s=(0.3, 1.2), chunk=chunk).orderBy("bin").collect()
        assert [r.bin for r in got] == list(range(52))
        close([r.rhythm for r in got], brute_rhythm(x, 3, 12, 3, 12))
    flat = samples(spark, v=[3.0] * 60).withColumnRenamed("i", "sample_idx")
    assert {r.rhythm for r in bins.rhythmicity(flat, keys=["r"], value="v", rate=10.0).collect()} == {0.0, None} or {r.rhythm for r in bins.rhythmicity(flat, keys=["r"], value="v", rate=10.0).collect()} == {0.0}


def test_gait_cycles_of_sessions(spark):
    label = lambda k: f"lr_step_{k}"
    rows = [(1, 10.0, 0.3, label("left") + "/steplen0.500"), (1, 10.4, 0.2, label("right") + "/steplen0.600"), (1, 10.7, 0.1, label("reset")), (1, 11.0, 0.3, label("left")), (1, 11.5, 0.3, "other"), (2, 10.0, 0.3, label("left")), (2, 10.5, 0.3, label("right")), (2, 11.0, 0.3, label("left"))]
    ann = spark.createDataFrame(rows, "s long, onset double, duration double, description string")
    rec = spark.createDataFrame([(1, "motion", 100.0, 0.0, 300, 10.0), (1, "neural", 98.0, 0.0, 3000, 100.0), (2, "motion", 100.0, 0.0, 300, 10.0), (2, "neural", 200.0, 0.0, 3000, 100.0)], "s long, role string, meas_date double, first_time double, n_times long, rate double")
    x = spark.range(3000).select(F.lit(1).cast("long").alias("s"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("v"))
    epochs, kept, counts = cycles.annotate_gait_cycles(ann, rec, x, session="s", rate=100.0)
    got = kept.collect()
    assert [(r.s, r.cycle_id, r.onset, r.duration, round(r.right_onset, 9), r.left_step_length_m, r.right_step_length_m, r.left_step_dur_s, r.cycle_start_idx, r.cycle_mid_idx, r.cycle_end_idx) for r in got] == [(1, 0, 12.0, 1.0, 12.4, 0.5, 0.6, 0.3, 50, 90, 150)]
    assert {r.s: (r.overlap, r.n_candidates, r.n_kept) for r in counts.collect()} == {1: (True, 1, 1), 2: (False, 0, 0)}
    v = [r.v for r in epochs.orderBy("epoch_idx").collect()]
    assert v == [float(k) for k in range(1150, 1350)]
    assert cycles.cycle_table(kept, keys=["s"], rate=100.0).columns == ["s", "cycle_onset_s", "cycle_dur_s", "right_onset_s", "left_step_dur_s", "right_step_dur_s", "left_step_length_m", "right_step_length_m"]


def test_event_traces_and_channels(spark):
    rng = np.random.default_rng(9)
    rows = [(c, ch, "a/beep" if c % 2 else "a/tone", rng.normal(size=400).tolist()) for c in range(4) for ch in ("p", "q", "z")]
    df = spark.createDataFrame(rows, "c long, ch_name string, description string, signal array<double>")
    mean = spectral.event_traces(df, keys=["c"], event_key="beep", picks=["p", "q"], rate=100.0, start_s=-1.5).orderBy("c", "t").collect()
    apart = spectral.event_traces(df, keys=["c"], event_key="beep", picks=["p", "q"], rate=100.0, start_s=-1.5, combine="separate")
    assert {r.c for r in mean} == {1, 3} and len(mean) == 600 and mean[0].t == -1.0
    again = {(r.c, round(r.t, 6)): r.value for r in apart.groupBy("c", "t").agg(F.avg("value").alias("value")).collect()}
    assert apart.count() == 1200 and all(abs(again[r.c, round(r.t, 6)] - r.value) < 1e-9 for r in mean)
    with pytest.raises(ValueError):
        spectral.event_traces(df, keys=["c"], event_key="beep", picks=["p"], rate=100.0, start_s=-1.5, combine="other")


def test_path_speed_of_single_samples(spark):
    m = samples(spark, x=[0, 1000, 2000, 4000], y=[0, 0, 0, 0]).withColumnRenamed("i", "sample_idx")
    got = overlays.path_speed(m, key="r", x="x", y="y", rate=1.0, bin_s=None, smooth_s=None).orderBy("bin").collect()
    close([r.value for r in got], [1.0, 1.25, 1.75])
    assert [(r.x0, r.x1) for r in got] == [(0, 1), (1, 2), (2, 4)]


def test_wide_channels(spark):
    df = spark.createDataFrame([(1, 5.0, 3.0, 4.0)], "i long, ZERO_THREE_LEFT double, ONE_THREE_LEFT double, ZERO_TWO_LEFT double")
    got = channels.to_long(channels.pick_wide(df, ["ZERO_TWO_LEFT", "zero_one_left", "ONE_TWO_LEFT"], keys=["i"]), keys=["i"]).collect()
    assert [(r.ch_name, r.value) for r in got] == [("ZERO_TWO_LEFT", 4.0), ("ZERO_ONE_LEFT", 2.0), ("ONE_TWO_LEFT", 2.0)]
    with pytest.raises(ValueError):
        channels.rereference_wide(df.drop("ZERO_TWO_LEFT"), ["TWO_THREE_LEFT"], keys=["i"])


def test_samples_are_written_and_loaded(spark, tmp_path):
    from strideframe.sources import tables

    df = samples(spark, v=SQUARES).withColumnsRenamed({"r": "recording_id", "i": "sample_idx"})
    tables.write_samples(df, str(tmp_path / "a"))
    tables.write_samples(df.withColumn("recording_id", F.lit(2)), str(tmp_path / "b"))
    both = tables.load_recordings(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((x.run_pos, x.recording_id, x.sample_idx, x.v) for x in both.collect()) == [(p, p + 1, i, float(v)) for p in (0, 1) for i, v in enumerate(SQUARES)]
