"""Blocked scans, tiles, array sums, block convolution, dyadic spans, stored tables and derived channels against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe import queries as Q
from strideframe.functions import kernels
from strideframe.operators import arrays, artifact, bins, channels, cycles, events, grid, kinematics, spectral, stats
from strideframe.sources import tables as T


def long_samples(spark, signals: dict, column: str = "v"):
    rows = pd.concat([pd.DataFrame({"r": k, "sample_idx": np.arange(len(v)), column: v}) for k, v in signals.items()])
    return spark.createDataFrame(rows, f"r long, sample_idx long, {column} double")


# ---- spacing

def fold(runs: list[tuple], step: int) -> list[int]:
    out, last = [], None
    for a, b in sorted(runs):
        for at in range(a, b + 1):
            if last is None or at - last >= step:
                out.append(at)
                last = at
    return out


@pytest.mark.parametrize("advance", [1, 3, 7, 40])
def test_spaced_places_equal_the_fold(spark, advance):
    rng = np.random.default_rng(advance)
    rows, want = [], {}
    for r in range(6):
        edges = np.sort(rng.choice(6000, 2 * rng.integers(1, 200), replace=False))
        runs = [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]
        runs = [(a, b if rng.random() < 0.4 else a) for a, b in runs] + ([(20_000, 21_000)] if r == 2 else [])
        rows += [(r, a, b) for a, b in runs]
        want[r] = fold(runs, advance)
    df = spark.createDataFrame(rows, "r long, s long, e long").repartition(3)
    got: dict = {}
    for x in artifact.spaced(df, keys=["r"], advance=advance, start="s", end="e", chunk=100).collect():
        got.setdefault(x.r, []).append(x.at)
    assert {k: sorted(v) for k, v in got.items()} == want


# ---- subtraction

def in_order(x: np.ndarray, starts: list[int], t: np.ndarray) -> np.ndarray:
    left = x.copy()
    for s in sorted(starts):
        if t @ t > 0:
            left[s : s + len(t)] -= (t @ left[s : s + len(t)]) / (t @ t) * t
    return left


@pytest.mark.parametrize("width", [6, 90])
def test_overlapping_windows_equal_the_ordered_filter(spark, width):
    rng = np.random.default_rng(width)
    signals = {r: rng.normal(size=n) * 3 for r, n in enumerate((3000, 700, 40 * width, width, 2))}
    patterns, places, want = {}, {}, {}
    for r, x in signals.items():
        t = rng.normal(size=width)
        patterns[r] = (t - t.mean()) * (r != 1)  # one template is all zero
        every = rng.integers(0, max(1, len(x)), len(x) // (3 if r else 2))
        places[r] = sorted(set(every.tolist()) | ({width // 2} if len(x) >= width else set()))  # nearly all windows overlap, along the whole recording
        starts = [p - width // 2 for p in places[r] if p - width // 2 >= 0 and p - width // 2 + width <= len(x)]
        want[r] = in_order(x, starts, patterns[r])
    at = spark.createDataFrame([(r, p) for r, ps in places.items() for p in ps], "r long, at long").repartition(3)
    t = spark.createDataFrame([(r, k, float(v)) for r, p in patterns.items() for k, v in enumerate(p)], "r long, k long, t double")
    samples = long_samples(spark, signals).repartition(4)
    for chunk in (2 * width, 100_000):
        got = artifact.subtract(samples, at, t, keys=["r"], value="v", width=width, chunk=chunk).toPandas()
        assert len(got) == sum(map(len, signals.values()))
        for r, g in got.groupby("r"):
            np.testing.assert_allclose(g.sort_values("sample_idx").clean, want[r], rtol=1e-9, atol=1e-9)


def test_subtract_without_places(spark):
    samples = long_samples(spark, {1: np.arange(9.0)})
    none = spark.createDataFrame([], "r long, at long")
    t = spark.createDataFrame([(1, 0, -1.0), (1, 1, 1.0)], "r long, k long, t double")
    got = artifact.subtract(samples, none, t, keys=["r"], value="v", width=2)
    assert [r.clean for r in got.orderBy("sample_idx").collect()] == list(range(9))


# ---- block convolution

def test_block_convolution_equals_the_direct_one():
    rng = np.random.default_rng(0)
    for n in (1, 50, 65, 700, 10_000):
        for m in (1, 64, 65, 501):
            for kind in (float, complex):
                x, k = rng.normal(size=n), rng.normal(size=m).astype(kind) * (1 + 1j if kind is complex else 1)
                np.testing.assert_allclose(kernels.block_convolve(x, k), np.convolve(x, k), rtol=1e-9, atol=1e-9)


def test_long_cross_correlation_keeps_flat_tops(spark):
    width = 100
    x = np.zeros(4000)
    x[1000:1400] = 7.25  # as long as the template and longer: the top is flat
    x[2500:2600] = np.random.default_rng(2).normal(size=100)
    t = np.r_[np.ones(50), np.zeros(50)]
    templates = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(t)], "r long, k long, t double")
    got = artifact.cross_correlation(long_samples(spark, {1: x}), templates, keys=["r"], value="v", width=width, chunk=512).toPandas().sort_values("sample_idx")
    direct = np.correlate(np.r_[np.zeros(width), x - x.mean(), np.zeros(width)], t, "valid")[width - width // 2 :][: len(x)]
    np.testing.assert_allclose(got.xc, direct, rtol=1e-9, atol=1e-9)
    heights = spark.createDataFrame([(1, 100.0)], "r long, height double")
    xc = spark.createDataFrame(got, "r long, sample_idx long, xc double")
    assert [p.at for p in artifact.peaks(xc, heights, keys=["r"], chunk=512).collect()] == [(1050 + 1400) // 2]


# ---- grids

@pytest.mark.parametrize("w", [1, 2, 3, 9, 10, 15])
def test_reflected_average_of_short_grids(spark, w):
    rng = np.random.default_rng(w)
    signals = {n: rng.normal(size=n) for n in range(1, 13)}
    got = grid.smooth_reflected(long_samples(spark, signals), keys=["r"], order="sample_idx", columns={"s": "v"}, w=w).toPandas()
    for n, x in signals.items():
        want = np.convolve(np.pad(x, w // 2, mode="reflect", reflect_type="odd"), np.ones(w) / w, mode="valid")[:n]
        np.testing.assert_allclose(got[got.r == n].sort_values("sample_idx").s, want, rtol=1e-9, atol=1e-12)


def test_steps_of_a_recording_shorter_than_half_a_window(spark):
    rows = [(1, i, 10.0 * i, 3.0 * i, 500.0 * i, 0.0, 0.0, 0.0) for i in range(5)]
    m = spark.createDataFrame(rows, "recording_id long, sample_idx long, x double, y double, lx double, ly double, rx double, ry double")
    got = events.annotate_steps(m, keys=["recording_id"], order="sample_idx", head=("x", "y"), left=("lx", "ly"), right=("rx", "ry"), rate=10.0, direction_s=3.0, speed_s=0.1, min_s=0.1).collect()
    assert [(r.onset, r.duration, r.description) for r in got] == [(0.0, 0.5, "lr_step_left")]


def test_a_halo_beyond_the_chunk_is_an_error(spark):
    df = long_samples(spark, {1: np.arange(5.0)})
    with pytest.raises(ValueError, match="halo"):
        grid.in_chunks(df, lambda d, k: d, keys=["r"], order="sample_idx", chunk=4, halo=5)


# ---- array sums and the permutation test

def test_array_means_equal_row_means(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(5)), "ab"[rng.integers(2)], [None if rng.random() < 0.2 else float(x) for x in rng.normal(size=rng.integers(0, 9))]) for _ in range(300)]
    rows += [(9, "a", None), (8, None, [1.0, None]), (8, None, [3.0, None, 5.0])]
    df = spark.createDataFrame(rows, "k int, name string, v array<double>").repartition(5)
    want = df.select("k", "name", F.posexplode("v").alias("at", "x")).groupBy("k", "name", "at").agg(F.avg("x").alias("m")).toPandas()
    want = {(r.k, r.name, r.at): r.m for r in want.itertuples(index=False)}
    for held in (arrays.HELD, 10):
        monkeypatch.setattr(arrays, "HELD", held)
        got = arrays.array_means(df, keys=["k", "name"], column="v").collect()
        flat = {(r.k, r.name, i): x for r in got for i, x in enumerate(r.v)}
        assert flat.keys() == want.keys() and len(got) == len({(r.k, r.name) for r in got})
        for k, x in flat.items():
            assert (x is None and pd.isna(want[k])) or np.isclose(x, want[k])
    assert arrays.array_means(df.limit(0), keys=[], column="v").count() == 0


@pytest.mark.parametrize("name", ["e8_cycle_maps", "e11_average_cycle_map"])
def test_maps_are_averaged_as_arrays(spark, name):
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    explode, summed = (next((i for i, x in enumerate(lines) if k in x), len(lines)) for k in ("posexplode", "MapInArrow"))
    assert explode < summed < len(lines) and "posexplode" not in "\n".join(lines[summed:])  # the tree is printed from its top


def brute_test(values: np.ndarray, obs: np.ndarray, n_freqs: int, n_bins: int, permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    flat = values.reshape(len(values), -1)
    t = lambda x: kernels.t_values(x.sum(0), (x * x).sum(0), len(x))
    best = [np.abs(kernels.tfce(t(flat * s[:, None]).reshape(n_freqs, n_bins))).max() for s in stats.flips(obs, np.arange(permutations), seed)]
    seen = np.abs(kernels.tfce(t(flat).reshape(n_freqs, n_bins))).ravel()
    return t(flat), ((np.array(best)[:, None] >= seen[None] - 1e-12).sum(0) + 1) / (permutations + 1)


@pytest.mark.parametrize("sizes", [{}, {"tile": 3, "obs_per_task": 5, "block": 7}])
def test_cluster_test_of_arrays_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(24, 3, 8))
    x[:, 1, 2:5] += 0.8
    rows = [(i, f, x[i, f].tolist()) for i in range(24) for f in range(3)]
    df = spark.createDataFrame(rows, "obs long, freq_idx int, values array<double>").repartition(5)
    keys = np.array([r.h for r in df.select("obs", F.xxhash64("obs").alias("h")).distinct().orderBy("obs").collect()], np.int64)
    t, p = brute_test(x, keys, 3, 8, 100, 7)
    got = stats.cluster_test_arrays(df, n_freqs=3, n_bins=8, permutations=100, **sizes).orderBy("freq_idx", "bin").collect()
    np.testing.assert_allclose([r.t for r in got], t, rtol=1e-9)
    np.testing.assert_allclose([r.p for r in got], p, rtol=1e-12)
    assert min(r.p for r in got) < 0.05


def test_p_values_of_the_average_cycle_map(spark):
    e = Q._core(spark, "/root/testdata/sf0.001").where("cycle_id < 60")
    options = {"keys": ["cycle_id"], "rate": T.EPOCH_RATE, "freqs": Q.E8, "n": 20}
    got = spectral.average_cycle_map(e, permutations=64, **options).orderBy("freq", "bin").collect()
    maps = spectral.cycle_maps(e, **options).orderBy("cycle_id", "freq", "bin").toPandas()
    x = maps["value"].to_numpy().reshape(-1, len(Q.E8), 20)
    ids = [r.h for r in e.select("cycle_id", F.xxhash64(F.struct("cycle_id")).alias("h")).distinct().orderBy("cycle_id").collect()]
    t, p = brute_test(x, np.array(ids, np.int64), len(Q.E8), 20, 64, 7)
    np.testing.assert_allclose([r.value for r in got], x.mean(0).ravel(), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose([r.t for r in got], t, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose([r.p for r in got], p, rtol=1e-12)


# ---- spans of all lengths

def test_points_in_spans_of_very_different_lengths(spark):
    rng = np.random.default_rng(3)
    points = pd.DataFrame({"k": rng.integers(0, 3, 3000), "at": rng.uniform(-500, 100_000, 3000), "p": np.arange(3000)})
    starts = rng.uniform(-800, 90_000, 200)
    spans = pd.DataFrame({"k": rng.integers(0, 3, 200), "s": starts, "e": starts + 10 ** rng.uniform(-2, 5, 200), "id": np.arange(200)})
    spans.loc[0, ["s", "e"]] = [-1e6, 1e6]
    spans.loc[1, "e"] = spans.loc[1, "s"]  # empty
    got = cycles.in_spans(spark.createDataFrame(points), spark.createDataFrame(spans), keys=["k"], at="at", start="s", end="e", unit=1.0)
    want = points.merge(spans, on="k").query("at >= s and at < e")
    assert sorted((r.p, r.id) for r in got.collect()) == sorted(zip(want.p, want.id, strict=True)) and len(want)
    n = spark.range(1).select(F.size(cycles._dyadic(F.lit(1), F.lit(1_000_000))).alias("n")).first().n
    assert n <= 2 * np.log2(1e6)


# ---- stored tables

def test_one_scan_of_many_paths(spark, tmp_path):
    base = tmp_path / "a b+c%20d"
    for k in range(4):
        spark.createDataFrame([(k, i) for i in range(3 + k)], "r long, i long").coalesce(1).write.parquet(str(base / f"run{k}" / "x=1" if k == 3 else base / f"run{k}"))
    spark.createDataFrame([(9, 0, 1.5)], "r long, i long, more double").write.parquet(str(base / "run2" / "inner"))
    paths = [str(base / "run1"), f"{base}/run0/", str(base / "run3"), str(base / "run1"), str(base / "run2" / "inner"), str(base / "run2")]
    got = T.load_recordings(spark, paths)
    count = {(r.run_pos, r.r): r["count"] for r in got.groupBy("run_pos", "r").count().collect()}
    assert count == {(0, 1): 4, (1, 0): 3, (2, 3): 6, (3, 1): 4, (4, 9): 1, (5, 2): 5, (5, 9): 1}
    assert got.where("more = 1.5").count() == 2 and str(got._jdf.queryExecution().executedPlan().toString()).count("FileScan") == 1
    more = T.load_recordings(spark, [{"path": p, "who": str(i)} for i, p in enumerate(paths)], max_broadcast_paths=0)
    assert more.where("who <> run_pos").count() == 0 and more.count() == got.count()
    with pytest.raises(ValueError, match="pattern"):
        T.load_recordings(spark, [str(base / "run*")])
    with pytest.raises(ValueError, match="no paths"):
        T.load_recordings(spark, [])


def test_bucketed_samples_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(6)
    m = pd.DataFrame({"recording_id": np.repeat(np.arange(12), 400), "sample_idx": np.tile(np.arange(400), 12)}).assign(**{c: rng.normal(size=4800).cumsum() for c in ("x", "y", "lx", "ly", "rx", "ry")})
    df = spark.createDataFrame(m).repartition(3)
    T.save_samples(df, "bucketed_samples_test", str(tmp_path / "t"), buckets=4)
    off = "spark.sql.requireAllClusterKeysForCoPartition"
    try:
        table = spark.table("bucketed_samples_test")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set(off, False)
        forward = lambda d: grid.in_chunks(d, lambda x, k: kinematics.forward_speed(x, keys=k, order="sample_idx", head=("x", "y"), feet={"f": ("lx", "ly")}, rate=10.0), keys=["recording_id"], order="sample_idx", chunk=128, halo=20)
        spans = spark.createDataFrame([(r, i, 30 * i, 30 * i + 45) for r in range(12) for i in range(5)], "recording_id long, w long, s0 long, s1 long")
        cut = lambda d: cycles.cut_by_interval(d, spans, keys=["recording_id"])
        for job, shuffles in ((forward, 0), (cut, 1)):
            plan = job(table)._jdf.queryExecution().executedPlan().toString()
            samples = [x for x in plan.splitlines() if "Exchange" in x]
            assert len(samples) == shuffles, plan  # the spans' one
            plain = job(df).toPandas()
            columns = list(plain.columns)
            pd.testing.assert_frame_equal(job(table).toPandas()[columns].sort_values(columns).reset_index(drop=True), plain.sort_values(columns).reset_index(drop=True), check_dtype=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(off)
        spark.sql("DROP TABLE bucketed_samples_test")


def test_stored_annotations_are_replaced_where_they_are_touched(spark, tmp_path):
    path, kind = str(tmp_path / "annotations"), "recording_id long, onset double, description string"
    T.save_annotations(spark.createDataFrame([(r, 1.0, d) for r in range(40) for d in ("step/1", "note")], kind), path, buckets=8)
    new = spark.createDataFrame([(r, 2.0, "step/2") for r in range(0, 40, 4)], kind)
    update = lambda old: events.replace_by_label(old, new, ["step"], within=new.select("recording_id").distinct())
    read = lambda: sorted(map(tuple, spark.read.parquet(path).drop("bucket").collect()))
    for _ in range(2):
        T.update_annotations(spark, path, new.select("recording_id"), update, buckets=8)
        assert read() == sorted([(r, 1.0, "note") for r in range(40)] + [(r, 2.0, "step/2") if r % 4 == 0 else (r, 1.0, "step/1") for r in range(40)])
    everyone = spark.range(40).withColumnRenamed("id", "recording_id")
    gone = [r.recording_id for r in everyone.where(F.pmod(F.xxhash64("recording_id"), F.lit(8)) == 3).collect()]
    T.update_annotations(spark, path, everyone.where(F.col("recording_id").isin(gone)), lambda old: old.limit(0), buckets=8)
    assert gone and {r[0] for r in read()} == set(range(40)) - set(gone)
    with pytest.raises(ValueError, match="other recordings"):
        T.update_annotations(spark, path, everyone.where(F.col("recording_id").isin(gone)), lambda old: new, buckets=8)


# ---- channels

def test_picked_and_derived_arrays(spark):
    rows = [(1, "ZERO_THREE_LEFT", [1.0, 2.0], "a"), (1, "ONE_THREE_LEFT", [0.5, 5.0], "a"), (1, "Fz", [7.0, 8.0], "a"), (2, "ZERO_THREE_LEFT", [1.0, 1.0], None), (3, "ZERO_ONE_LEFT", [9.0, 9.0], "c"), (3, "ZERO_THREE_LEFT", [1.0, 2.0], "c"), (3, "ONE_THREE_LEFT", [1.0, 2.0], "c"), (4, "ZERO_THREE_LEFT", [3.0, 4.0], None), (4, "ONE_THREE_LEFT", [1.0, 1.0], None)]
    e = spark.createDataFrame(rows, "trial long, ch_name string, signal array<double>, tag string")
    got = sorted((r.trial, r.ch_name, r.signal) for r in channels.pick_arrays(e, ["ZERO_ONE_LEFT", "Fz"]).collect())
    assert got == [(1, "Fz", [7.0, 8.0]), (1, "ZERO_ONE_LEFT", [0.5, -3.0]), (3, "ZERO_ONE_LEFT", [9.0, 9.0]), (4, "ZERO_ONE_LEFT", [2.0, 3.0])]
    assert channels.pick_arrays(e, ["Fz", "Cz"]).count() == 1


def test_epoch_arrays_of_derived_channels(spark):
    rows = [(1, "ZERO_THREE_LEFT", i, float(i)) for i in range(3)] + [(1, "ONE_THREE_LEFT", i, 1.0) for i in range(3)]
    long = spark.createDataFrame(rows, "trial long, ch_name string, epoch_idx long, value double")
    got = spectral.epoch_arrays(long, keys=["trial"], picks=["ZERO_ONE_LEFT"], available=["ZERO_THREE_LEFT", "ONE_THREE_LEFT"]).collect()
    assert [(r.ch_name, r.signal) for r in got] == [("ZERO_ONE_LEFT", [-1.0, 0.0, 1.0])]


def test_only_recordings_in_sync_are_joined(spark):
    r = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 0.005, 9.0), (2, 0, 0.0, 9.0), (2, 1, 0.02, 9.0), (3, 0, 0.0, 9.0), (3, 1, 0.0, 8.9), (4, 0, 0.0, 9.0), (4, 1, None, 9.0)], "r long, pos int, start double, length double")
    rows = spark.range(6).withColumnRenamed("id", "r")
    assert [x.r for x in channels.synced(rows, r, session="r").collect()] == [1]
    a = long_samples(spark, {1: np.arange(20.0), 2: np.arange(20.0)})
    joined = bins.joint_bins(a, a.withColumnRenamed("v", "p"), key="r", bin_s=0.5, rate_a=10.0, rate_b=10.0, values_a=["v"], values_b=["p"], recordings=r)
    assert {x.r for x in joined.collect()} == {1}


# ---- the artifact job reads its samples once

def counted(spark, df, column: str):
    """df with a count of the values of a column that tasks have computed."""
    count = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def same(v: pd.Series) -> pd.Series:
        count.add(len(v))
        return v

    return df.withColumn(column, same(column)), count


def bursts(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    for at in rng.integers(10, n - 10, n // 36):
        x[at - 1 : at + 4] += [-6, -9, -9, 3, 2]
    return x


JOB = {"keys": ["r"], "value": "v", "rate": 1.0, "window": (-3, 6), "discover_advance_s": 20, "sd": 3.0, "chunk": 64}


def test_artifact_counts_take_one_pass_over_the_samples(spark):
    samples, count = counted(spark, long_samples(spark, {1: bursts(1, 900), 2: bursts(2, 500), 3: np.zeros(100)}), "v")
    got = {x.r: (x.n_discovered, x.n_subtracted) for x in artifact.filter_artifact(samples, **JOB, filter_advance_s=9)[2].collect()}
    assert got[3] == (0, 0) and got[1][0] > 5 and got[1][1] > 5
    assert count.value == 1500
    again = artifact.count_artifacts(samples, **JOB, filter_advance_s=9)
    assert {x.r: (x.n_discovered, x.n_subtracted) for x in again.collect()} == got and count.value == 3000


@pytest.mark.parametrize("filt", [0, 9])
def test_artifact_quality_takes_one_pass_and_equals_the_windows(spark, filt):
    """Windows of 9 samples; at filt 0 they overlap, so that those of other chunks reach into a chunk's halo."""
    signals = {1: bursts(1, 900), 2: bursts(2, 500), 3: np.zeros(100)}
    plain = long_samples(spark, signals)
    samples, count = counted(spark, plain, "v")
    q = artifact.filter_artifact(samples, **JOB, filter_advance_s=filt)[1].toPandas()
    assert count.value == 1500
    clean = artifact.filter_artifact(plain, **JOB, filter_advance_s=filt)[0].toPandas().sort_values("sample_idx")
    job = artifact._found(plain, **JOB, filter_advance_s=filt, order="sample_idx")
    places = job.at.toPandas()
    assert set(q.r) == {1, 2}
    for r, x in signals.items():
        starts = np.array([p - 4 for p in places[places.r == r]["at"] if p - 4 >= 0 and p + 5 <= len(x)], int)
        after = clean[clean.r == r].clean.to_numpy()
        got = q[q.r == r].sort_values("k")
        for name, v in {"before": x, "after": after}.items():
            w = np.array([v[s : s + 9] for s in starts])
            if r == 3:
                assert not len(got)
            else:
                assert list(got.k) == list(range(9)) and set(got.n) == {len(w)}
                np.testing.assert_allclose(got[f"{name}_mean"], w.mean(0), rtol=1e-9, atol=1e-9)
                np.testing.assert_allclose(got[f"{name}_sem"], w.std(0, ddof=1) / np.sqrt(len(w)), rtol=1e-9, atol=1e-9)


def test_matched_tops_do_not_depend_on_chunks(spark):
    x = np.zeros(2000)
    x[500:900] = 7.25  # a flat top over many chunks
    x[1300:1400] = np.random.default_rng(2).normal(size=100) * 9
    for width in (4, 40, 100):
        t = np.r_[np.ones(width // 2), np.zeros(width // 2)]
        templates = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(t)], "r long, k long, t double")
        samples = long_samples(spark, {1: x - x.mean()})
        xc = artifact.cross_correlation(samples, templates, keys=["r"], value="v", width=width, chunk=100_000)
        heights = spark.createDataFrame([(1, width / 4)], "r long, height double")
        want = sorted(p.at for p in artifact.peaks(xc, heights, keys=["r"], chunk=100_000).collect())
        assert want
        for chunk in (width, 128, 4096):
            got = artifact.matched(samples, templates, keys=["r"], value="v", width=width, advance=0, chunk=chunk)
            assert sorted(p.at for p in got.collect()) == want


def test_samples_of_some_columns_are_in_the_same_order(spark):
    sf = "/root/testdata/sf0.001"
    whole = T.motion_v(spark, sf).toPandas().sort_values(["recording_id", "sample_idx"])
    for names in (["x"], ["y"], ["lx", "x"], ["rx", "ry"]):
        got = T.motion_v(spark, sf, names).toPandas().sort_values(["recording_id", "sample_idx"])
        pd.testing.assert_frame_equal(got.reset_index(drop=True), whole[["recording_id", "sample_idx", *names]].reset_index(drop=True))
    # the samples and their means: one shuffle of the samples each, as the window's is by recording
    plan = Q._centred(spark, sf).groupBy("recording_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" not in plan
