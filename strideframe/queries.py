"""Every operator over the given tables, with SQL that computes the same from its definition."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import kernels
from .operators import arrays, artifact, bins, channels, cycles, events, grid, kinematics, overlays, resample, spectral, stats
from .plans import oracle as Q
from .sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K, O, R = ["recording_id"], "sample_idx", T.MOTION_RATE
GRID = {"keys": K, "order": O}
#: Samples of a chunk: few, so that the given recordings have several.
CHUNK = 256


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """df with these columns rounded, without negative zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


def chunked(df: DataFrame, halo: int, fn) -> DataFrame:
    """fn(rows, **grid) on chunks of the recordings."""
    return grid.in_chunks(df, lambda d, k: fn(d, keys=k, order=O), keys=K, order=O, chunk=CHUNK, halo=halo)


# ---- recordings and channels

@query(f"WITH {Q.MOTION} SELECT recording_id, count(*) AS n_rows, min(sample_idx) AS first_idx, max(sample_idx) AS last_idx, count(*) = max(sample_idx) - min(sample_idx) + 1 AND count(*) = count(DISTINCT sample_idx) AS gapless FROM motion GROUP BY 1")
def a1_grid_gaps(spark, sf):
    return grid.grid_gaps(T.motion_v(spark, sf), **GRID)


@query("""WITH runs AS (SELECT *, 0 AS run_pos FROM lineitem UNION ALL SELECT *, 1 AS run_pos FROM lineitem)
SELECT run_pos, l_suppkey AS recording_id, count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS total, min(l_shipdate) = (SELECT min(l_shipdate) FROM lineitem l WHERE l.l_suppkey = runs.l_suppkey) AS whole FROM runs GROUP BY 1, 2""")
def a1_load_recordings(spark, sf):
    """Two runs of one table's recordings: each keeps its place in the list of paths."""
    both = T.load_recordings(spark, [f"{sf}/lineitem.parquet", f"{sf}/lineitem.parquet"])
    g = both.groupBy("run_pos", F.col("l_suppkey").alias("recording_id")).agg(F.count("*").alias("n_rows"), F.sum("l_quantity").cast("double").alias("total"), F.min("l_shipdate").alias("first"))
    first = T.load_recordings(spark, [f"{sf}/lineitem.parquet"]).groupBy(F.col("l_suppkey").alias("recording_id")).agg(F.min("l_shipdate").alias("start"))
    return g.join(first, K).select("run_pos", *K, "n_rows", "total", (F.col("first") == F.col("start")).alias("whole"))


@query("""WITH runs AS (SELECT *, l_linenumber % 3 AS part FROM lineitem), named AS (SELECT 0 AS run_pos, 'evening' AS session, 2 AS part UNION ALL SELECT 1, 'morning', 0 UNION ALL SELECT 2, 'noon', 1 UNION ALL SELECT 3, 'again', 0)
SELECT run_pos, session, l_suppkey AS recording_id, count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS total FROM runs JOIN named USING (part) GROUP BY 1, 2, 3""")
def a1_load_manifest(spark, sf):
    """Runs written as three folders, named by a manifest with their sessions, one of them twice; loaded by one scan."""
    path = f"{T.shared_dir(spark)}/runs-{os.urandom(8).hex()}"
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    for k in range(3):
        line.where(F.col("l_linenumber") % 3 == k).write.parquet(f"{path}/run {k}")
    runs = [{"path": f"{path}/run {k}", "session": name} for k, name in ((2, "evening"), (0, "morning"), (1, "noon"), (0, "again"))]
    g = T.load_recordings(spark, runs).groupBy("run_pos", "session", F.col("l_suppkey").alias("recording_id"))
    out = T.stored(g.agg(F.count("*").alias("n_rows"), F.sum("l_quantity").cast("double").alias("total")))
    T.delete(spark, path)
    return out


@query(f"WITH {Q.MOTION} SELECT recording_id, count(*) AS n_rows, CAST(sum(sample_idx) AS BIGINT) AS idx_sum, CAST(sum(y) AS DOUBLE) AS total FROM motion GROUP BY 1")
def a7_write_samples(spark, sf):
    """Samples written in folders of recordings, and read again."""
    path = f"{T.shared_dir(spark)}/samples-{os.urandom(8).hex()}"
    T.write_samples(T.motion_v(spark, sf).select(*K, O, "y"), path)
    out = T.stored(spark.read.parquet(path).groupBy(*K).agg(F.count("*").alias("n_rows"), F.sum(O).alias("idx_sum"), F.sum("y").alias("total")))
    T.delete(spark, path)
    return out


@query(f"WITH {Q.MOTION}, {Q.FORWARD} SELECT recording_id, sample_idx, round(fwd_left, 3) + 0.0 AS fwd_left, round(fwd_right, 3) + 0.0 AS fwd_right FROM fwd")
def a7_bucketed_samples(spark, sf):
    """Samples saved in buckets of recordings, on which the forward speed (B9) takes no shuffle."""
    name = f"samples_{os.urandom(8).hex()}"
    path = f"{T.shared_dir(spark)}/{name}"
    T.save_samples(T.motion_v(spark, sf), name, path, buckets=8)
    s = chunked(spark.table(name), 20, lambda d, **g: kinematics.forward_speed(d, **g, head=("x", "y"), feet={"fwd_left": ("lx", "ly"), "fwd_right": ("rx", "ry")}, rate=R, speed_s=0.2))
    out = T.stored(rounded(s.select(*K, O, "fwd_left", "fwd_right"), "fwd_left", "fwd_right", digits=3))
    spark.sql(f"DROP TABLE {name}")
    T.delete(spark, path)
    return out


@query(f"""WITH {Q.MOTION}, r AS (SELECT recording_id % 10 AS subject, recording_id AS run_id, count(*) AS n_times FROM motion GROUP BY 1, 2)
SELECT a.subject, a.run_id, CAST(coalesce((SELECT sum(b.n_times) FROM r b WHERE b.subject = a.subject AND b.run_id < a.run_id), 0) AS BIGINT) AS offset_n,
  (SELECT CASE WHEN count(*) = 1 THEN CAST(min(b.run_id) AS VARCHAR) ELSE min(b.run_id) || '-' || max(b.run_id) END FROM r b WHERE b.subject = a.subject) AS run_label FROM r a""")
def a2_concatenate_runs(spark, sf):
    r = T.motion_v(spark, sf).groupBy((F.col("recording_id") % 10).alias("subject"), F.col("recording_id").alias("run_id")).agg(F.count("*").alias("n_times"))
    return channels.concatenate_runs(r.withColumn("run_pos", F.col("run_id")), keys=["subject"]).select("subject", "run_id", F.col("offset").alias("offset_n"), "run_label")


def _wide(spark, sf):
    return T.motion_v(spark, sf).select(*K, O, F.col("x").alias("ZERO_THREE_LEFT"), F.col("y").alias("ONE_THREE_LEFT"), F.col("lx").alias("ZERO_TWO_LEFT"))


def _long(spark, sf):
    pairs = {"ZERO_THREE_LEFT": "x", "ONE_THREE_LEFT": "y", "ZERO_TWO_LEFT": "lx"}
    stack = ", ".join(f"'{k}', {v}" for k, v in pairs.items())
    return T.motion_v(spark, sf).selectExpr("recording_id", "sample_idx", f"stack(3, {stack}) AS (ch_name, value)")


BIPOLAR_3 = ["ZERO_ONE_LEFT", "ONE_TWO_LEFT", "TWO_THREE_LEFT"]


@query(f"WITH {Q.MOTION} SELECT recording_id, sample_idx, 'ONE_THREE_LEFT' AS ch_name, round(y, 4) AS value FROM motion UNION ALL SELECT recording_id, sample_idx, 'ZERO_ONE_LEFT', round(x - y, 4) + 0.0 FROM motion")
def a3_pick_channels(spark, sf):
    picked = channels.pick_wide(_wide(spark, sf), ["ZERO_ONE_LEFT", "ONE_THREE_LEFT"], keys=[*K, O])
    return rounded(channels.to_long(picked, keys=[*K, O]), "value")


@query(f"WITH {Q.MOTION} SELECT recording_id, sample_idx, ch_name, round(value, 4) + 0.0 AS value FROM (SELECT recording_id, sample_idx, unnest(['ZERO_ONE_LEFT', 'ONE_TWO_LEFT', 'TWO_THREE_LEFT']) AS ch_name, unnest([x - y, y - x + lx, x - lx]) AS value FROM motion)")
def a4_rereference(spark, sf):
    """Of channels in columns: arithmetic on each row, no shuffle."""
    return rounded(channels.to_long(channels.rereference_wide(_wide(spark, sf), BIPOLAR_3, keys=[*K, O]), keys=[*K, O]), "value")


@query(ORACLE_SQL["a4_rereference"])
def a4_rereference_long(spark, sf):
    """Of channels in rows."""
    return rounded(channels.rereference(_long(spark, sf), BIPOLAR_3, keys=[*K, O]), "value")


@query(f"""WITH {Q.SESSION}, f AS (SELECT session_id, min(recording_id) AS recording_id FROM session GROUP BY 1), a AS (SELECT f.session_id, s.start, s.length FROM f JOIN session s USING (recording_id))
SELECT s.session_id, s.recording_id, round(s.start - a.start, 4) + 0.0 AS start_diff, round(s.length - a.length, 4) + 0.0 AS length_diff FROM session s JOIN a USING (session_id) WHERE abs(s.start - a.start) > 30 OR abs(s.length - a.length) > 30""")
def a5_sync_check(spark, sf):
    far = channels.unsynced(T.session_v(spark, sf), session="session_id", pos="recording_id", tolerance=30.0)
    return rounded(far, "start_diff", "length_diff").select("session_id", "recording_id", "start_diff", "length_diff")


@query(f"WITH {Q.SESSION} SELECT session_id, round(max(start), 4) AS span_start, round(min(start + length), 4) AS span_end, max(start) <= min(start + length) AS overlap FROM session GROUP BY 1")
def a6_overlap_check(spark, sf):
    return rounded(channels.common_span(T.session_v(spark, sf), session="session_id"), "span_start", "span_end")


# ---- grids and kinematics

@query(f"WITH {Q.MOTION}, {Q.smooth('s', 'motion', {'sx': 'x', 'sy': 'y'}, 15)} SELECT recording_id, sample_idx, round(sx, 3) + 0.0 AS sx, round(sy, 3) + 0.0 AS sy FROM s")
def b1_smooth_reflected(spark, sf):
    s = chunked(T.motion_v(spark, sf).select(*K, O, "x", "y"), 16, lambda d, **g: grid.smooth_reflected(d, **g, columns={"sx": "x", "sy": "y"}, w=15))
    return rounded(s, "sx", "sy", digits=3).select(*K, O, "sx", "sy")


@query(f"WITH {Q.MOTION}, {Q.zero('s', 'motion', 'x', 5)} SELECT recording_id, sample_idx, round(z, 4) AS sx FROM s")
def b2_smooth_zero(spark, sf):
    s = chunked(T.motion_v(spark, sf).select(*K, O, "x"), 4, lambda d, **g: d.withColumn("sx", grid.smooth_zero(F.col("x"), **g, w=5)))
    return rounded(s, "sx").select(*K, O, "sx")


@query(f"WITH {Q.MOTION}, {Q.grad('g', 'motion', {'gx': 'x'}, 0.1)} SELECT recording_id, sample_idx, round(gx, 3) + 0.0 AS gx FROM g")
def b3_gradient(spark, sf):
    s = chunked(T.motion_v(spark, sf).select(*K, O, "x"), 2, lambda d, **g: d.withColumn("gx", grid.gradient(F.col("x"), **g, dt=0.1)))
    return rounded(s, "gx", digits=3).select(*K, O, "gx")


_B4 = f"""WITH {Q.MOTION}, d AS (SELECT m.recording_id, m.sample_idx, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) / 2 AS v FROM motion m
  LEFT JOIN motion a ON a.recording_id = m.recording_id AND a.sample_idx = m.sample_idx - 1 LEFT JOIN motion b ON b.recording_id = m.recording_id AND b.sample_idx = m.sample_idx + 2)
SELECT c.recording_id, c.sample_idx, CASE WHEN count(*) = count(d.v) THEN round(sum(d.v) / 5, 4) END AS speed FROM d c JOIN d ON d.recording_id = c.recording_id AND d.sample_idx BETWEEN c.sample_idx - 2 AND c.sample_idx + 2 GROUP BY 1, 2"""


@query(_B4)
def b4_lagged_speed(spark, sf):
    s = chunked(T.motion_v(spark, sf).select(*K, O, "x", "y"), 8, lambda d, **g: kinematics.lagged_speed(d, **g, x="x", y="y", step=3, smoothing=5))
    return rounded(s.select(*K, O, "speed"), "speed")


@query(f"WITH {Q.MOTION}, m AS (SELECT recording_id, sample_idx, x / 1000 AS x_m, y / 1000 AS y_m FROM motion), {Q.grad('g', 'm', {'gx': 'x_m', 'gy': 'y_m'}, 0.1)}, v AS (SELECT *, sqrt(gx ** 2 + gy ** 2) AS v FROM g), {Q.zero('s', 'v', 'v', 2)} SELECT recording_id, sample_idx, round(x_m, 5) AS x_m, round(y_m, 5) AS y_m, round(z, 5) AS speed FROM s")
def b5_walking_speed(spark, sf):
    s = chunked(T.motion_v(spark, sf).select(*K, O, "x", "y"), 4, lambda d, **g: kinematics.walking_speed(d, **g, x="x", y="y", rate=R))
    return rounded(s, "x_m", "y_m", "speed", digits=5).select(*K, O, "x_m", "y_m", "speed")


@query(f"""WITH {Q.MOTION}, d AS (SELECT recording_id, sample_idx, lead(x, 5) OVER w - lag(x, 5) OVER w AS dx, lead(y, 5) OVER w - lag(y, 5) OVER w AS dy FROM motion WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx))
SELECT recording_id, sample_idx, round(t - 2 * pi() * floor(t / (2 * pi())), 5) AS direction FROM (SELECT *, atan2(dy, dx) + 2 * pi() AS t FROM d)""")
def b6_path_direction(spark, sf):
    s = chunked(T.motion_v(spark, sf).select(*K, O, "x", "y"), 6, lambda d, **g: kinematics.path_direction(d, **g, x="x", y="y"))
    return rounded(s.select(*K, O, "direction"), "direction", digits=5)


@query(f"WITH {Q.MOTION}, {Q.HEADING} SELECT recording_id, sample_idx, round(heading, 5) AS heading FROM heading")
def b7_heading(spark, sf):
    h = chunked(T.motion_v(spark, sf).select(*K, O, "x", "y"), 20, lambda d, **g: kinematics.heading(d, **g, x="x", y="y", rate=R, smooth_w=15))
    return rounded(h.select(*K, O, "heading"), "heading", digits=5)


def _lean(spark, sf):
    return chunked(T.motion_v(spark, sf).select(*K, O, "x", "y"), 20, lambda d, **g: kinematics.lean_angle(d, **g, x="x", y="y", rate=R, lean_s=0.3))


@query(f"WITH {Q.MOTION}, {Q.LEAN} SELECT recording_id, sample_idx, round(lean, 5) AS lean FROM lean")
def b8_lean_angle(spark, sf):
    return rounded(_lean(spark, sf).select(*K, O, "lean"), "lean", digits=5)


def _forward(spark, sf):
    feet = {"fwd_left": ("lx", "ly"), "fwd_right": ("rx", "ry")}
    return chunked(T.motion_v(spark, sf), 20, lambda d, **g: kinematics.forward_speed(d, **g, head=("x", "y"), feet=feet, rate=R, speed_s=0.2))


@query(f"WITH {Q.MOTION}, {Q.FORWARD} SELECT recording_id, sample_idx, round(fwd_left, 3) + 0.0 AS fwd_left, round(fwd_right, 3) + 0.0 AS fwd_right FROM fwd")
def b9_forward_speed(spark, sf):
    return rounded(_forward(spark, sf).select(*K, O, "fwd_left", "fwd_right"), "fwd_left", "fwd_right", digits=3)


@query(f"""WITH {Q.MOTION}, d AS (SELECT m.*, coalesce(m.x - p.x, 0) AS dx, coalesce(m.y - p.y, 0) AS dy FROM motion m LEFT JOIN motion p ON p.recording_id = m.recording_id AND p.sample_idx = m.sample_idx - 1),
u AS (SELECT *, CASE WHEN abs(x) < 0.5 AND abs(y) < 0.5 THEN 1 WHEN dx = 0 AND dy = 0 THEN 0 ELSE dx / sqrt(dx * dx + dy * dy) END AS ux, CASE WHEN abs(x) < 0.5 AND abs(y) < 0.5 THEN 0 WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy / sqrt(dx * dx + dy * dy) END AS uy FROM d),
f AS (SELECT recording_id, sample_idx, (lx - x) * ux + (ly - y) * uy AS v FROM u), {Q.zero('s', 'f', 'v', 3)} SELECT recording_id, sample_idx, round(z, 3) + 0.0 AS step_left FROM s""")
def b10_step_length(spark, sf):
    s = chunked(T.motion_v(spark, sf).select(*K, O, "x", "y", "lx", "ly"), 4, lambda d, **g: kinematics.step_length(d, **g, pelvis=("x", "y"), feet={"step_left": ("lx", "ly")}, smoothing=3))
    return rounded(s.select(*K, O, "step_left"), "step_left", digits=3)


@query(f"WITH {Q.MOTION} SELECT m.recording_id, sample_idx, round(x - a, 3) + 0.0 AS x0 FROM motion m JOIN (SELECT recording_id, avg(x) AS a FROM motion GROUP BY 1) USING (recording_id)")
def b11_remove_mean(spark, sf):
    return rounded(grid.remove_mean(T.motion_v(spark, sf), keys=K, column="x", name="x0").select(*K, O, "x0"), "x0", digits=3)


# ---- events and cycles

@query(f"WITH {Q.MOTION}, {Q.LEAN} SELECT recording_id, sample_idx, CASE WHEN lean > 0 THEN -1 WHEN lean < 0 THEN 1 ELSE 0 END AS state FROM lean")
def c1_lean_state(spark, sf):
    return _lean(spark, sf).select(*K, O, events.lean_state(F.col("lean")).alias("state"))


@query(f"WITH {Q.MOTION}, {Q.FORWARD}, {Q.STATE} SELECT recording_id, sample_idx, state FROM st")
def c2_step_state(spark, sf):
    return _forward(spark, sf).select(*K, O, events.step_state(F.col("fwd_left"), F.col("fwd_right"), 300.0).alias("state"))


@query(f"WITH {Q.MOTION}, s AS (SELECT *, CASE WHEN y > 700 THEN 1 WHEN y < 300 THEN -1 ELSE 0 END AS state FROM motion), {Q.runs('r', 's')} SELECT recording_id, round(a / 10.0, 4) AS onset, round(n / 10.0, 4) AS duration, state FROM r WHERE n >= 2 AND a < last_idx")
def c3_runs_to_events(spark, sf):
    s = T.motion_v(spark, sf).withColumn("state", F.when(F.col("y") > 700, 1).when(F.col("y") < 300, -1).otherwise(0))
    return rounded(events.runs_to_events(s, **GRID, state="state", rate=R, min_samples=2, chunk=CHUNK), "onset", "duration")


_LEAN_EVENTS = f"{Q.LEAN}, ls AS (SELECT *, CASE WHEN lean > 0 THEN -1 WHEN lean < 0 THEN 1 ELSE 0 END AS state FROM lean), {Q.runs('lr', 'ls')}"


@query(f"WITH {Q.MOTION}, {_LEAN_EVENTS} SELECT recording_id, round(a / 10.0, 4) AS onset, round(n / 10.0, 4) AS duration, CASE state WHEN -1 THEN 'gait_lean_left' WHEN 1 THEN 'gait_lean_right' ELSE 'gait_lean_reset' END AS description FROM lr WHERE n >= 2 AND a < last_idx")
def c5_annotate_gait_lean(spark, sf):
    return rounded(events.annotate_gait_lean(T.motion_v(spark, sf), **GRID, x="x", y="y", rate=R, lean_s=0.3, min_s=0.2, chunk=CHUNK), "onset", "duration")


def _old(spark, sf, labels):
    """Annotations from before: a label by height at every 50th sample."""
    m = T.motion_v(spark, sf).where(F.col(O) % 50 == 0)
    label = F.when(F.col("y") > 700, labels[0]).when(F.col("y") < 300, labels[1]).otherwise("note/checked")
    return m.select(*K, (F.col(O) / R).alias("onset"), F.lit(0.0).alias("duration"), label.alias("description"))


def _old_sql(labels):
    return f"o AS (SELECT recording_id, round(sample_idx / 10.0, 4) AS onset, CAST(0 AS DOUBLE) AS duration, CASE WHEN y > 700 THEN '{labels[0]}' WHEN y < 300 THEN '{labels[1]}' ELSE 'note/checked' END AS description FROM motion WHERE sample_idx % 50 = 0)"


_LEAN_OLD = ("gait_lean_left", "gait_lean_wobble")


def _lean_replaced(spark, sf, old):
    return events.annotate_gait_lean(T.motion_v(spark, sf), **GRID, x="x", y="y", rate=R, lean_s=0.3, min_s=0.2, chunk=CHUNK, annotations=old)


@query(f"""WITH {Q.MOTION}, {_LEAN_EVENTS}, {_old_sql(_LEAN_OLD)}, n AS (SELECT recording_id, round(a / 10.0, 4) AS onset, round(n / 10.0, 4) AS duration, CASE state WHEN -1 THEN 'gait_lean_left' WHEN 1 THEN 'gait_lean_right' ELSE 'gait_lean_reset' END AS description FROM lr WHERE n >= 2 AND a < last_idx)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.recording_id = o.recording_id AND n.description = o.description)""")
def c5_replaced_gait_lean(spark, sf):
    """New events in the place of old ones of the same description."""
    return rounded(_lean_replaced(spark, sf, _old(spark, sf, _LEAN_OLD)), "onset", "duration")


@query(ORACLE_SQL["c5_replaced_gait_lean"])
def c7_stored_annotations(spark, sf):
    """The same in a stored table of annotations, where the update is run twice."""
    path = f"{T.shared_dir(spark)}/annotations-{os.urandom(8).hex()}"
    T.save_annotations(_old(spark, sf, _LEAN_OLD), path)
    for _ in range(2):
        T.update_annotations(spark, path, T.motion_v(spark, sf).select(*K), lambda old: _lean_replaced(spark, sf, old))
    out = T.stored(rounded(spark.read.parquet(path).drop("bucket"), "onset", "duration"))
    T.delete(spark, path)
    return out


def _steps(spark, sf, motion=None, old=None):
    return events.annotate_steps(motion or T.motion_v(spark, sf), **GRID, head=("x", "y"), left=("lx", "ly"), right=("rx", "ry"), rate=R, speed_s=0.2, min_s=0.1, chunk=CHUNK, annotations=old)


@query(f"""WITH {Q.MOTION}, {Q.FORWARD}, {Q.STATE}, {Q.runs('r', 'st')} SELECT r.recording_id, round(a / 10.0, 4) AS onset, round(n / 10.0, 4) AS duration,
  round(CASE state WHEN -1 THEN sqrt((q.lx - p.lx) ** 2 + (q.ly - p.ly) ** 2) / 1000 WHEN 1 THEN sqrt((q.rx - p.rx) ** 2 + (q.ry - p.ry) ** 2) / 1000 END, 4) AS steplen_m,
  CASE state WHEN -1 THEN 'lr_step_left' WHEN 1 THEN 'lr_step_right' ELSE 'lr_step_reset' END AS description
FROM r JOIN motion p ON p.recording_id = r.recording_id AND p.sample_idx = a JOIN motion q ON q.recording_id = r.recording_id AND q.sample_idx = a + n - 1 WHERE a < last_idx""")
def c6_annotate_steps(spark, sf):
    return rounded(_steps(spark, sf), "onset", "duration", "steplen_m")


_STEP_OLD = ("lr_step_left/steplen0.61", "lr_step_reset")


@query(f"""{ORACLE_SQL["c6_annotate_steps"].replace("SELECT r.recording_id", "SELECT * FROM (SELECT r.recording_id", 1).replace("WITH ", f"WITH {Q.MOTION}, {_old_sql(_STEP_OLD)}, ", 1).replace(f"{Q.MOTION}, {Q.FORWARD}", Q.FORWARD, 1)}) WHERE recording_id % 2 = 0
UNION ALL SELECT recording_id, onset, duration, NULL, description FROM o WHERE recording_id % 2 = 1 OR split_part(description, '/', 1) NOT IN ('lr_step_left', 'lr_step_right', 'lr_step_reset')""")
def c6_replaced_steps(spark, sf):
    """Of half of the recordings; the others keep what they had."""
    new = _steps(spark, sf, T.motion_v(spark, sf).where("recording_id % 2 = 0"), _old(spark, sf, _STEP_OLD))
    return rounded(new, "onset", "duration", "steplen_m").select(*K, "onset", "duration", "steplen_m", "description")


@query(f"""WITH {Q.MOTION}, s AS (SELECT *, CASE WHEN y > 700 THEN 1 WHEN y < 300 THEN -1 ELSE 0 END AS state FROM motion), {Q.runs('r', 's')}
SELECT r.recording_id, a AS first_idx, round(CASE state WHEN -1 THEN sqrt((q.lx - p.lx) ** 2 + (q.ly - p.ly) ** 2) / 1000 WHEN 1 THEN sqrt((q.rx - p.rx) ** 2 + (q.ry - p.ry) ** 2) / 1000 END, 4) AS steplen_m
FROM r JOIN motion p ON p.recording_id = r.recording_id AND p.sample_idx = a JOIN motion q ON q.recording_id = r.recording_id AND q.sample_idx = a + n - 1 WHERE a < last_idx AND n >= 2""")
def c4_run_step_length(spark, sf):
    s = T.motion_v(spark, sf).withColumn("state", F.when(F.col("y") > 700, 1).when(F.col("y") < 300, -1).otherwise(0))
    r = events.runs_to_events(s, **GRID, state="state", rate=R, min_samples=2, feet={"left": ("lx", "ly"), "right": ("rx", "ry")}, chunk=CHUNK)
    return rounded(r.select(*K, F.rint(F.col("onset") * R).cast("long").alias("first_idx"), "steplen_m"), "steplen_m")


@query(f"""WITH {Q.CUE}, o AS (SELECT * FROM cue WHERE event_id % 2 = 0), n AS (SELECT * FROM cue WHERE event_id % 2 = 1 AND value > 50)
SELECT recording_id, event_id, description FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.recording_id = o.recording_id AND n.description = o.description) UNION ALL SELECT recording_id, event_id, description FROM n""")
def c7_replace_annotations(spark, sf):
    e = T.cue_v(spark, sf)
    return events.replace_by_description(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 AND value > 50"), keys=K).select(*K, "event_id", "description")


@query(f"""WITH {Q.CUE}, o AS (SELECT * FROM cue WHERE event_id % 2 = 0), n AS (SELECT * FROM cue WHERE event_id % 2 = 1 AND description IN ('click', 'view'))
SELECT recording_id, event_id, description FROM o WHERE description NOT IN ('click', 'view') UNION ALL SELECT recording_id, event_id, description FROM n""")
def c7_replace_by_label(spark, sf):
    e = T.cue_v(spark, sf)
    new = e.where("event_id % 2 = 1 AND description IN ('click', 'view')")
    return events.replace_by_label(e.where("event_id % 2 = 0"), new, ["click", "view"]).select(*K, "event_id", "description")


@query("""SELECT event_id, event_type AS label, CAST(round(value, 1) AS DOUBLE) AS steplen_m FROM events""")
def c8_label_parse(spark, sf):
    e = T.cue_v(spark, sf).withColumn("d", F.concat("description", F.lit("/steplen"), F.round("value", 1).cast("string")))
    return e.select("event_id", events.base_label(F.col("d")).alias("label"), events.step_length_tag(F.col("d")).alias("steplen_m"))


@query(f"WITH {Q.SWING}, {Q.SESSION}, f AS (SELECT session_id, min(start) AS first FROM session GROUP BY 1) SELECT event_id, round(onset + (start - first), 4) AS onset FROM swing JOIN session USING (recording_id) JOIN f USING (session_id)")
def c9_time_shift(spark, sf):
    """From each recording's clock to that of the first recording of its session."""
    s = T.session_v(spark, sf)
    starts = s.join(s.groupBy("session_id").agg(F.min("start").alias("b")), "session_id").select(*K, F.col("start").alias("a"), "b")
    return rounded(cycles.shift_to(T.swing_v(spark, sf), starts, key="recording_id", frm="a", to="b").select("event_id", "onset"), "onset")


@query(f"WITH {Q.SWING}, {Q.PAIRS} SELECT recording_id, round(onset, 4) AS onset, round(duration, 4) AS duration, round(right_onset, 4) AS right_onset, round(left_steplen_m, 4) AS left_steplen_m, round(right_steplen_m, 4) AS right_steplen_m FROM pairs WHERE duration BETWEEN 60 AND 600")
def c10_pair_cycles(spark, sf):
    p = cycles.pair_cycles(T.swing_v(spark, sf), keys=K, tie="event_id", min_dur=60, max_dur=600, values=("steplen_m",))
    return rounded(p, "onset", "duration", "right_onset", "left_steplen_m", "right_steplen_m")


def _swing_epochs(spark, sf):
    swing = T.swing_v(spark, sf)
    rec = T.session_v(spark, sf).select(*K, F.col("start").alias("first_time"), (F.floor("length") + 1).alias("n_times"))
    steps = swing.withColumns({"step_length_m": F.col("steplen_m"), "step_dur_s": (F.col("event_id") % 13 + 1).cast("double")})
    pairs = cycles.pair_cycles(steps, keys=K, tie="event_id", min_dur=60, max_dur=600, values=("step_dur_s", "step_length_m"))
    return cycles.epoch_bounds(pairs, rec, key="recording_id", rate=1.0, pad_s=20.0)


_C11 = f"""WITH {Q.SWING}, {Q.SESSION}, {Q.PAIRS}, b AS (SELECT recording_id, onset, duration, right_onset, event_id, right_event_id, left_steplen_m, right_steplen_m, onset - start - 20 AS t0, onset - start + duration + 20 AS t1, floor(length) AS last_t FROM pairs JOIN session USING (recording_id) WHERE duration BETWEEN 60 AND 600),
e AS (SELECT *, CAST(round_even(t0, 0) AS BIGINT) AS s0, CAST(round_even(t1, 0) AS BIGINT) AS s1 FROM b WHERE t0 >= 0 AND t1 <= last_t)"""


@query(f"{_C11} SELECT recording_id, s0, s1, s1 - s0 AS n_samples, CAST(20 AS BIGINT) AS cycle_start_idx, 20 + CAST(round_even(right_onset - onset, 0) AS BIGINT) AS cycle_mid_idx, s1 - s0 - 20 AS cycle_end_idx FROM e")
def c11_epoch_bounds(spark, sf):
    return _swing_epochs(spark, sf).select(*K, "s0", "s1", "n_samples", "cycle_start_idx", "cycle_mid_idx", "cycle_end_idx")


_SPANS = "spans AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS window_id, sample_idx AS s0, sample_idx + 40 AS s1 FROM motion WHERE sample_idx % 30 = 7)"


def _spans(m):
    w = Window.partitionBy(*K).orderBy(O)
    return m.where(F.col(O) % 30 == 7).select(*K, F.row_number().over(w).alias("window_id"), F.col(O).alias("s0"), (F.col(O) + 40).alias("s1"))


@query(f"WITH {Q.MOTION}, {_SPANS} SELECT recording_id, window_id, count(*) AS n, round(avg(x), 6) AS x FROM motion JOIN spans USING (recording_id) WHERE sample_idx >= s0 AND sample_idx < s1 GROUP BY 1, 2")
def c12_cut_by_interval(spark, sf):
    m = T.motion_v(spark, sf)
    cut = cycles.cut_by_interval(m.select(*K, O, "x"), _spans(m), keys=K)
    return rounded(cut.groupBy(*K, "window_id").agg(F.count("*").alias("n"), F.avg("x").alias("x")), "x", digits=6)


_PERIODS = "periods AS (SELECT recording_id, event_id, onset AS t0, onset + value * 10 AS t1 FROM cue WHERE description = 'purchase')"


def _periods(spark, sf):
    e = T.cue_v(spark, sf).where("description = 'purchase'")
    return e.select(*K, "event_id", F.col("onset").alias("t0"), (F.col("onset") + F.col("value") * 10).alias("t1"))


@query(f"WITH {Q.CUE}, {_PERIODS} SELECT recording_id, event_id, cycle, round(t0 + cycle * 100, 3) AS onset, CAST(100 AS DOUBLE) AS duration FROM (SELECT *, unnest(range(CAST(floor((t1 - t0) / 100) AS BIGINT))) AS cycle FROM periods)")
def c13_cue_cycles(spark, sf):
    return rounded(cycles.cue_cycles(_periods(spark, sf), length_s=100.0), "onset", digits=3).select(*K, "event_id", "cycle", "onset", "duration")


_CUE_PERIODS = "per AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) - 1 AS period_idx, sample_idx / 10.0 AS t0, sample_idx / 10.0 + y / 200 AS t1 FROM motion WHERE sample_idx % 97 = 5)"


@query(f"""WITH {Q.MOTION}, {_CUE_PERIODS}, n AS (SELECT recording_id, max(sample_idx) / 10.0 AS last_t FROM motion GROUP BY 1), c AS (SELECT *, unnest(range(CAST(floor(t1 - t0) AS BIGINT))) AS cycle FROM per),
e AS (SELECT c.*, t0 + cycle AS onset, CAST(round_even((t0 + cycle - 0.5) * 10, 0) AS BIGINT) AS s0, CAST(round_even((t0 + cycle + 1.5) * 10, 0) AS BIGINT) AS s1 FROM c JOIN n USING (recording_id) WHERE t0 + cycle - 0.5 >= 0 AND t0 + cycle + 1.5 <= last_t)
SELECT e.recording_id, period_idx, cycle, round(onset, 4) AS onset, s1 - s0 AS n_samples, CAST(5 AS BIGINT) AS cycle_start_idx, s1 - s0 - 5 AS cycle_end_idx, round(sum(x * (sample_idx - s0)), 4) AS moment FROM e JOIN motion m ON m.recording_id = e.recording_id AND sample_idx >= s0 AND sample_idx < s1 GROUP BY ALL""")
def c13_cue_epochs(spark, sf):
    """Padded epochs of cue cycles, those not inside their recording left out."""
    m = T.motion_v(spark, sf)
    periods = m.where(F.col(O) % 97 == 5).select(*K, (F.col(O) / R).alias("t0"), (F.col(O) / R + F.col("y") / 200).alias("t1"))
    rec = m.groupBy(*K).agg(F.lit(0.0).alias("first_time"), F.count("*").alias("n_times"))
    epochs, table = cycles.annotate_cue_cycles(periods, rec, m.select(*K, O, "x"), key="recording_id", length_s=1.0, rate=R)
    sums = epochs.groupBy(*K, "period_idx", "cycle").agg(F.sum(F.col("x") * F.col("epoch_idx")).alias("moment"))
    return rounded(table.join(sums, [*K, "period_idx", "cycle"]).select(*K, F.col("period_idx").cast("long").alias("period_idx"), "cycle", "onset", "n_samples", "cycle_start_idx", "cycle_end_idx", "moment"), "onset", "moment")


@query(f"{_C11} SELECT recording_id, round(onset, 4) AS cycle_onset_s, round(duration, 4) AS cycle_dur_s, round(onset + round_even(right_onset - onset, 0), 4) AS right_onset_s, CAST(event_id % 13 + 1 AS DOUBLE) AS left_step_dur_s, CAST(right_event_id % 13 + 1 AS DOUBLE) AS right_step_dur_s, round(left_steplen_m, 4) AS left_step_length_m, round(right_steplen_m, 4) AS right_step_length_m FROM e")
def c14_cycle_table(spark, sf):
    t = cycles.cycle_table(_swing_epochs(spark, sf), keys=K, rate=1.0)
    return rounded(t, *[c for c in t.columns if c not in K])


@query(f"""WITH {Q.MOTION}, ev AS (SELECT recording_id, sample_idx AS s0, sample_idx + CAST(y AS BIGINT) % 23 AS s1, CASE WHEN y > 500 THEN 'left' ELSE 'right' END AS description FROM motion WHERE sample_idx % 20 = 3)
SELECT m.recording_id, m.sample_idx, coalesce((SELECT arg_max(description, s0) FROM ev WHERE ev.recording_id = m.recording_id AND m.sample_idx >= s0 AND m.sample_idx < s1), 'reset') AS label FROM motion m""")
def c15_paint(spark, sf):
    m = T.motion_v(spark, sf)
    ev = m.where(F.col(O) % 20 == 3).select(*K, (F.col(O) / R).alias("onset"), ((F.col("y").cast("long") % 23) / R).alias("duration"), F.when(F.col("y") > 500, "left").otherwise("right").alias("description"))
    return cycles.paint(m, ev, key="recording_id", rate=R).select(*K, O, "label")


@query("SELECT event_id, event_type AS description FROM events WHERE event_type = 'signup'")
def c16_event_selection(spark, sf):
    return events.with_tag(T.cue_v(spark, sf), "signup").select("event_id", "description")


@query(f"WITH {Q.CUE} SELECT recording_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY event_id) AS n FROM cue) WHERE n <= 5")
def c17_first_cycles(spark, sf):
    return cycles.first_cycles(T.cue_v(spark, sf), keys=K, order="event_id").select(*K, "event_id")


_C18 = f"""WITH {Q.MOTION}, {Q.FORWARD}, {Q.STATE}, {Q.runs('r', 'st')}, meas AS (SELECT recording_id, max(sample_idx) AS m, CASE WHEN recording_id % 17 = 3 THEN 1e6 ELSE -(recording_id % 5) END AS neural FROM motion GROUP BY 1),
ov AS (SELECT *, greatest(0, neural) <= least(m / 10.0, neural + m / 10.0) AS overlap FROM meas),
ev AS (SELECT r.recording_id, a / 10.0 - neural AS onset, CASE state WHEN -1 THEN 'L' ELSE 'R' END AS kind, n / 10.0 AS dur, round(CASE state WHEN -1 THEN sqrt((q.lx - p.lx) ** 2 + (q.ly - p.ly) ** 2) ELSE sqrt((q.rx - p.rx) ** 2 + (q.ry - p.ry) ** 2) END / 1000, 3) AS len
  FROM r JOIN ov USING (recording_id) JOIN motion p ON p.recording_id = r.recording_id AND p.sample_idx = a JOIN motion q ON q.recording_id = r.recording_id AND q.sample_idx = a + n - 1 WHERE state <> 0 AND a < last_idx AND overlap),
lead1 AS (SELECT *, lead(kind) OVER w AS k2, lead(onset) OVER w AS right_onset, lead(dur) OVER w AS right_dur, lead(len) OVER w AS right_len FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY onset)),
lefts AS (SELECT *, lead(onset) OVER (PARTITION BY recording_id ORDER BY onset) - onset AS duration FROM lead1 WHERE kind = 'L'),
cand AS (SELECT * FROM lefts WHERE k2 = 'R' AND duration BETWEEN 0.6 AND 1.8),
e AS (SELECT l.*, CAST(round_even((onset - 0.5) * 10, 0) AS BIGINT) AS s0, CAST(round_even((onset + duration + 0.5) * 10, 0) AS BIGINT) AS s1 FROM cand l JOIN ov USING (recording_id) WHERE onset - 0.5 >= 0 AND onset + duration + 0.5 <= m / 10.0)"""


def _gait_cycles(spark, sf):
    """Steps of the motion recordings, and epochs of a recording that began up to 4 s earlier, or (of some) much later."""
    m = T.motion_v(spark, sf)
    steps = _steps(spark, sf)
    tag = F.when(F.col("steplen_m").isNotNull(), F.concat(F.lit("/steplen"), F.round("steplen_m", 3).cast("string"))).otherwise("")
    n = m.groupBy(*K).agg(F.count("*").alias("n_times"))
    late = F.when(F.col("recording_id") % 17 == 3, 1e6).otherwise(-(F.col("recording_id") % 5)).cast("double")
    role = lambda name, start: F.struct(F.lit(name).alias("role"), start.alias("meas_date"))
    rec = n.withColumn("_r", F.explode(F.array(role("motion", F.lit(0.0)), role("neural", late)))).select(*K, "_r.role", "_r.meas_date", F.lit(0.0).alias("first_time"), "n_times", F.lit(R).alias("rate"))
    return cycles.annotate_gait_cycles(steps.withColumn("description", F.concat("description", tag)), rec, m.select(*K, O, "x"), session="recording_id", rate=R)


@query(f"""{_C18} SELECT e.recording_id, round(onset, 4) AS onset, round(duration, 4) AS duration, count(*) AS n_samples, round(avg(x), 6) AS strength, round(dur, 4) AS left_step_dur_s, round(right_dur, 4) AS right_step_dur_s, len AS left_step_length_m, right_len AS right_step_length_m
FROM e JOIN motion USING (recording_id) WHERE sample_idx >= s0 AND sample_idx < s1 GROUP BY e.recording_id, onset, duration, dur, right_dur, len, right_len""")
def c18_annotate_gait_cycles(spark, sf):
    epochs, kept, _ = _gait_cycles(spark, sf)
    strength = epochs.groupBy(*K, "cycle_id").agg(F.count("*").alias("n_samples"), F.avg("x").alias("strength"))
    out = kept.drop("n_samples").join(strength, [*K, "cycle_id"]).select(*K, "onset", "duration", "n_samples", "strength", *[f"{side}_step_{v}" for side in ("left", "right") for v in ("dur_s", "length_m")])
    return rounded(rounded(out, "onset", "duration", "left_step_dur_s", "right_step_dur_s", "left_step_length_m", "right_step_length_m"), "strength", digits=6)


@query(f"{_C18} SELECT recording_id, overlap, (SELECT count(*) FROM cand WHERE cand.recording_id = ov.recording_id) AS n_candidates, (SELECT count(*) FROM e WHERE e.recording_id = ov.recording_id) AS n_kept FROM ov")
def c18_cycle_counts(spark, sf):
    return _gait_cycles(spark, sf)[2]


# ---- resampling and bins

_ARRAYS = f"WITH {Q.MOTION}, {_SPANS}, a AS (SELECT recording_id, window_id, list(x ORDER BY sample_idx) AS v FROM motion JOIN spans USING (recording_id) WHERE sample_idx >= s0 AND sample_idx < s1 GROUP BY 1, 2)"
_LERP = "round(v[CAST(floor(p) AS INT) + 1] + CASE WHEN p > floor(p) THEN (p - floor(p)) * (v[CAST(floor(p) AS INT) + 2] - v[CAST(floor(p) AS INT) + 1]) ELSE 0 END, 6)"


def _arrays(spark, sf):
    m = T.motion_v(spark, sf)
    return cycles.cut_by_interval(m.select(*K, O, "x"), _spans(m), keys=K).groupBy(*K, "window_id").agg(cycles.array_of(F.col("x"), F.col(O)).alias("v"))


@query(f"{_ARRAYS} SELECT recording_id, window_id, bin, {_LERP} AS value FROM (SELECT *, unnest(range(25)) AS bin, unnest(range(25)) * ((len(v) - 1) / 24.0) AS p FROM a)")
def d1_linear_resample(spark, sf):
    out = _arrays(spark, sf).select(*K, "window_id", F.posexplode(resample.linear(F.col("v"), 25)).alias("bin", "value"))
    return rounded(out, "value", digits=6).withColumn("bin", F.col("bin").cast("long"))


@query(f"{_ARRAYS}, m AS (SELECT *, CAST(greatest(1, least(9, len(v) - 2)) AS DOUBLE) AS mid FROM a) SELECT recording_id, window_id, bin, {_LERP} AS value FROM (SELECT *, CASE WHEN bin < 10 THEN bin * mid / 10 ELSE mid + (bin - 10) * (len(v) - 1 - mid) / 9.0 END AS p FROM (SELECT *, unnest(range(20)) AS bin FROM m WHERE len(v) > 2))")
def d2_piecewise_resample(spark, sf):
    out = _arrays(spark, sf).where(F.size("v") > 2).select(*K, "window_id", F.posexplode(resample.piecewise(F.col("v"), 20, F.lit(9))).alias("bin", "value"))
    return rounded(out, "value", digits=6).withColumn("bin", F.col("bin").cast("long"))


@query(f"WITH {Q.MOTION}, {_SPANS}, m AS (SELECT recording_id, sample_idx, x / 1000 AS x_m, y / 1000 AS y_m FROM motion), {Q.grad('g', 'm', {'gx': 'x_m', 'gy': 'y_m'}, 0.1)}, v0 AS (SELECT *, sqrt(gx ** 2 + gy ** 2) AS v FROM g), {Q.zero('s', 'v0', 'v', 2)}, a AS (SELECT recording_id, window_id, list(z ORDER BY sample_idx) AS v FROM s JOIN spans USING (recording_id) WHERE sample_idx >= s0 AND sample_idx < s1 GROUP BY 1, 2 HAVING count(*) = 40) SELECT recording_id, window_id, bin, {_LERP.replace(', 6)', ', 5)')} AS value FROM (SELECT *, unnest(range(25)) AS bin, unnest(range(25)) * ((len(v) - 1) / 24.0) AS p FROM a)")
def d3_trial_speed_matrix(spark, sf):
    m = T.motion_v(spark, sf)
    w = _spans(m).select(*K, "window_id", (F.col("s0") / R).alias("tmin"), (F.col("s1") / R).alias("tmax"))
    out = resample.trial_speed_matrix(m, w, key="recording_id", x="x", y="y", rate=R, duration_s=2.5, chunk=CHUNK)
    return rounded(out, "value", digits=5).withColumn("bin", F.col("bin").cast("long"))


_D4W = "w AS (SELECT recording_id, event_id AS window_id, onset AS tmin, onset + 100000 AS tmax FROM cue WHERE description = 'error')"


def _trial(spark, sf, agg, duration=None):
    e = T.cue_v(spark, sf).withColumn("dur", F.col("value") * 300)
    w = e.where("description = 'error'").select(*K, F.col("event_id").alias("window_id"), F.col("onset").alias("tmin"), (F.col("onset") + 100000).alias("tmax"))
    return rounded(resample.trial_bins(e, w, key="recording_id", n_bins=10, agg=agg, duration=duration), "value")


def _d4(agg):
    return f"""WITH {Q.CUE}, {_D4W}, j AS (SELECT w.recording_id, window_id, greatest(0, least(9, CAST(trunc((onset - tmin) / (tmax - tmin) * 10) AS INT))) AS bin, value FROM cue JOIN w USING (recording_id) WHERE onset >= tmin AND onset < tmax)
SELECT g.recording_id, g.window_id, g.bin, round({agg}(j.value), 4) AS value FROM (SELECT recording_id, window_id, CAST(unnest(range(10)) AS INT) AS bin FROM w) g LEFT JOIN j ON j.recording_id = g.recording_id AND j.window_id = g.window_id AND j.bin = g.bin GROUP BY 1, 2, 3"""


@query(_d4("avg"))
def d4_trial_cycle_matrix(spark, sf):
    return _trial(spark, sf, "mean")


@query(_d4("median"))
def d4_trial_cycle_median(spark, sf):
    return _trial(spark, sf, "median")


@query(f"""WITH {Q.CUE}, {_D4W}, j AS (SELECT window_id, unnest(range(b0, b1 + 1)) AS bin, value FROM (SELECT w.window_id, value, greatest(0, least(9, CAST(trunc((onset - tmin) / (tmax - tmin) * 10) AS INT))) AS b0, greatest(0, least(9, CAST(trunc((onset + value * 300 - tmin) / (tmax - tmin) * 10) AS INT))) AS b1 FROM cue JOIN w USING (recording_id) WHERE onset >= tmin AND onset < tmax))
SELECT g.recording_id, g.window_id, g.bin, round(avg(j.value), 4) AS value FROM (SELECT recording_id, window_id, CAST(unnest(range(10)) AS INT) AS bin FROM w) g LEFT JOIN j ON j.window_id = g.window_id AND j.bin = g.bin GROUP BY 1, 2, 3""")
def d4_trial_cycle_durations(spark, sf):
    """Events that last count in all bins they reach."""
    return _trial(spark, sf, "mean", "dur")


@query(f"WITH {Q.MOTION} SELECT recording_id, sample_idx // 10 AS bin, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM motion GROUP BY 1, 2 HAVING count(*) = 10")
def d5_bin_means(spark, sf):
    return rounded(bins.bin_means(T.motion_v(spark, sf), keys=K, w=10, columns=["x", "y"]), "x", "y")


@query(f"""WITH {Q.MOTION}, m AS (SELECT recording_id, max(sample_idx) / 10.0 AS dur FROM motion GROUP BY 1), p AS (SELECT recording_id, sample_idx, x * y AS p FROM motion), b AS (SELECT recording_id, unnest(range(CAST(floor(dur / 0.5) AS BIGINT))) AS bin FROM m)
SELECT b.recording_id, b.bin, round((SELECT avg(x) FROM motion q WHERE q.recording_id = b.recording_id AND q.sample_idx BETWEEN b.bin * 5 AND b.bin * 5 + 5), 3) AS x, round((SELECT avg(p) FROM p WHERE p.recording_id = b.recording_id AND p.sample_idx >= b.bin * 5 AND p.sample_idx < b.bin * 5 + 5), 3) AS p FROM b""")
def d6_joint_bins(spark, sf):
    m = T.motion_v(spark, sf)
    return rounded(bins.joint_bins(m.select(*K, O, "x"), m.select(*K, O, (F.col("x") * F.col("y")).alias("p")), key="recording_id", bin_s=0.5, rate_a=R, rate_b=R, values_a=["x"], values_b=["p"]), "x", "p", digits=3)


def _pairs(spark, sf):
    """Two recordings of each key; in every third the second one starts late."""
    r = T.motion_v(spark, sf).groupBy(*K).agg(((F.max(O)) / R).alias("length")).withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1))))
    return r.withColumn("start", F.when((F.col("pos") == 1) & (F.col("recording_id") % 3 == 0), 0.02).when(F.col("pos") == 1, 0.005).otherwise(0.0))


@query(f"SELECT * FROM ({ORACLE_SQL['d6_joint_bins']}) WHERE recording_id % 3 <> 0")
def d6_joint_bins_synced(spark, sf):
    """Only of recordings that are in sync."""
    m = T.motion_v(spark, sf)
    joined = bins.joint_bins(m.select(*K, O, "x"), m.select(*K, O, (F.col("x") * F.col("y")).alias("p")), key="recording_id", bin_s=0.5, rate_a=R, rate_b=R, values_a=["x"], values_b=["p"], recordings=_pairs(spark, sf))
    return rounded(joined, "x", "p", digits=3)


_BINS = f"WITH {Q.MOTION}, b AS (SELECT recording_id, sample_idx // 10 AS bin, avg(x) AS x, avg(y) AS y FROM motion GROUP BY 1, 2 HAVING count(*) = 10)"


@query(f"{_BINS} SELECT a.recording_id, a.bin, round(a.x, 4) AS x0, round(a.y, 4) AS y0, round(c.x, 4) AS x1, round(c.y, 4) AS y1, round((a.x + c.x) / 2, 5) AS value, round(1 / (1 + exp(1 - abs((a.x + c.x) / 2))), 6) AS weight FROM b a JOIN b c ON c.recording_id = a.recording_id AND c.bin = a.bin + 1")
def d7_path_segments(spark, sf):
    b = bins.bin_means(T.motion_v(spark, sf), keys=K, w=10, columns=["x", "y"])
    s = bins.segments(b, keys=K, x="x", y="y", value="x", weight=True)
    return rounded(rounded(rounded(s, "x0", "y0", "x1", "y1"), "value", digits=5), "weight", digits=6)


@query(f"WITH {Q.MOTION}, c AS (SELECT recording_id, sample_idx // 5 AS bin, CASE WHEN y > 700 THEN 'high' WHEN y < 300 THEN 'low' ELSE 'mid' END AS label, count(*) AS n FROM motion GROUP BY 1, 2, 3) SELECT recording_id, bin, arg_min(label, struct_pack(m := -n, l := label)) AS label FROM c GROUP BY 1, 2 HAVING sum(n) = 5")
def d8_majority_label(spark, sf):
    m = T.motion_v(spark, sf).withColumn("label", F.when(F.col("y") > 700, "high").when(F.col("y") < 300, "low").otherwise("mid"))
    return bins.majority_label(m, keys=K, w=5)


@query(f"WITH {Q.MOTION} SELECT recording_id, round(quantile_cont(x, 0.05), 4) AS low, round(quantile_cont(x, 0.95), 4) AS high FROM motion GROUP BY 1")
def d9_robust_limits(spark, sf):
    return rounded(bins.robust_limits(T.motion_v(spark, sf), keys=K, value="x"), "low", "high")


_RHYTHM = f"""WITH {Q.MOTION}, n AS (SELECT recording_id, max(sample_idx) + 1 AS n FROM motion GROUP BY 1), b AS (SELECT recording_id, unnest(range(n // 2)) AS bin FROM n),
w AS (SELECT b.recording_id, b.bin, m.sample_idx AS i, m.y FROM b JOIN motion m ON m.recording_id = b.recording_id AND m.sample_idx >= b.bin * 2 + 1 - 10 AND m.sample_idx < b.bin * 2 + 1 + 10),
c AS (SELECT w.recording_id, w.bin, i, y - a AS v FROM w JOIN (SELECT recording_id, bin, avg(y) AS a FROM w GROUP BY 1, 2) USING (recording_id, bin)),
ac AS (SELECT p.recording_id, p.bin, q.i - p.i AS lag, sum(p.v * q.v) AS s FROM c p JOIN c q ON q.recording_id = p.recording_id AND q.bin = p.bin AND (q.i = p.i OR q.i - p.i BETWEEN 3 AND 11) GROUP BY 1, 2, 3),
z AS (SELECT recording_id, bin, count(*) AS n FROM c GROUP BY 1, 2)"""


@query(f"{_RHYTHM} SELECT z.recording_id, z.bin, CASE WHEN z.n < 16 THEN NULL WHEN max(s) FILTER (lag = 0) <= 1e-12 THEN 0 ELSE round(max(s) FILTER (lag >= 3) / max(s) FILTER (lag = 0), 5) + 0.0 END AS rhythm FROM z JOIN ac USING (recording_id, bin) GROUP BY z.recording_id, z.bin, z.n")
def d10_rhythmicity(spark, sf):
    return rounded(bins.rhythmicity(T.motion_v(spark, sf), keys=K, value="y", rate=R, bin_s=0.2, win_s=2.0, lag_s=(0.3, 1.2), chunk=CHUNK), "rhythm", digits=5)


_EPOCH = "ep AS (SELECT vec_id AS cycle_id, label AS ch_name, CAST(unnest(range(64)) AS INT) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _epoch_long(spark, sf):
    return T.epoch_v(spark, sf).select("cycle_id", "ch_name", F.posexplode("signal").alias("bin", "v"))


@query(f"WITH {_EPOCH} SELECT ch_name, bin, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v) / sqrt(count(*)), 5) AS sem, count(*) AS n FROM ep GROUP BY 1, 2")
def d11_mean_sem(spark, sf):
    return rounded(bins.mean_sem(_epoch_long(spark, sf), keys=["ch_name", "bin"], value="v"), "mean", "sem", digits=5)


@query(f"WITH {_EPOCH} SELECT cycle_id % 50 AS trial, bin, round(avg(v), 5) + 0.0 AS v FROM ep GROUP BY 1, 2")
def d12_combine_channels(spark, sf):
    e = _epoch_long(spark, sf).withColumn("trial", F.col("cycle_id") % 50)
    return rounded(channels.combine_channels(e, keys=["trial", "bin"], value="v"), "v", digits=5)


@query(f"WITH {_EPOCH} SELECT bin // 8 AS freq_idx, bin % 8 AS bin, round(avg(v), 5) + 0.0 AS v FROM ep GROUP BY 1, 2")
def d13_mean_map(spark, sf):
    e = _epoch_long(spark, sf).select(F.floor(F.col("bin") / 8).cast("int").alias("freq_idx"), (F.col("bin") % 8).alias("bin"), "v")
    return rounded(channels.combine_channels(e, keys=["freq_idx", "bin"], value="v"), "v", digits=5)


@query(ORACLE_SQL["d13_mean_map"])
def d13_mean_map_arrays(spark, sf):
    """Of maps as arrays, which are summed by task before a shuffle."""
    m = arrays.array_means(T.epoch_v(spark, sf), keys=[], column="signal").select(F.posexplode("signal").alias("at", "v"))
    return rounded(m.select(F.floor(F.col("at") / 8).cast("int").alias("freq_idx"), (F.col("at") % 8).alias("bin"), "v"), "v", digits=5)


# ---- spectra

E8 = [float(f) for f in kernels.octave_grid(2, 32, 0.5)]
BAND_GRID = kernels.octave_grid(0, 32)


def _inside(low: float, high: float) -> list[float]:
    return [float(f) for f in BAND_GRID if low <= f <= high]


def _kernel(freqs: list[float]) -> str:
    """The wavelets of these frequencies at 64 samples a second, as table k (freq, i, re, im)."""
    return f"""f AS (SELECT unnest({freqs!r})::DOUBLE AS freq), s AS (SELECT freq, greatest(2.0, freq / 2) / (2 * pi() * freq) AS sigma FROM f),
k0 AS (SELECT freq, sigma, i, i / 64.0::DOUBLE AS t FROM (SELECT *, unnest(range(-40, 41)) AS i FROM s) WHERE abs(i) / 64.0 < 5 * sigma),
k1 AS (SELECT freq, i, (cos(2 * pi() * freq * t) - exp(-2 * (pi() * freq * sigma) ** 2)) * exp(-t * t / (2 * sigma * sigma)) AS re, sin(2 * pi() * freq * t) * exp(-t * t / (2 * sigma * sigma)) AS im FROM k0),
k AS MATERIALIZED (SELECT k1.freq, i, re * sqrt(2) / n AS re, im * sqrt(2) / n AS im FROM k1 JOIN (SELECT freq, sqrt(sum(re * re + im * im)) AS n FROM k1 GROUP BY 1) USING (freq))"""


def _conv(freqs: list[float]) -> str:
    return f"WITH {_EPOCH}, {_kernel(freqs)}, z AS (SELECT a.cycle_id, a.ch_name, k.freq, a.bin, sum(k.re * b.v) AS re, sum(k.im * b.v) AS im FROM ep a JOIN ep b ON b.cycle_id = a.cycle_id JOIN k ON k.i = a.bin - b.bin GROUP BY 1, 2, 3, 4)"


def _band_sql(low: float, high: float, value: str = "re * re + im * im") -> str:
    """Band power (or phase) of epochs as bp (cycle_id, ch_name, bin, v): the mean over the band's frequencies."""
    return f"{_conv(_inside(low, high))}, bp AS (SELECT cycle_id, ch_name, bin, avg({value}) AS v FROM z GROUP BY 1, 2, 3)"


_CONV = _conv(E8)


@query(f"{_CONV} SELECT cycle_id, freq, bin, round(re * re + im * im, 5) AS power FROM z")
def e1_morlet_power(spark, sf):
    m = spectral.morlet_maps(T.epoch_v(spark, sf), keys=["cycle_id"], rate=T.EPOCH_RATE, freqs=E8)
    return rounded(m.select("cycle_id", "freq", F.posexplode("values").alias("bin", "power")), "power", digits=5)


@query(f"{_conv(E8[:-1])} SELECT cycle_id, freq, bin, round(atan2(im, re), 4) + 0.0 AS phase FROM z")
def e1_morlet_phase(spark, sf):
    """At half the rate, the last frequency, a phase is 0 or pi by the last bit: it is left out."""
    m = spectral.morlet_maps(T.epoch_v(spark, sf), keys=["cycle_id"], rate=T.EPOCH_RATE, freqs=E8[:-1], output="phase")
    return rounded(m.select("cycle_id", "freq", F.posexplode("values").alias("bin", "phase")), "phase")


@query(f"{_CONV} SELECT cycle_id, freq, bin, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM z")
def e1_morlet_complex(spark, sf):
    m = spectral.morlet_maps(T.epoch_v(spark, sf), keys=["cycle_id"], rate=T.EPOCH_RATE, freqs=E8, output="complex")
    out = m.select("cycle_id", "freq", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select("cycle_id", "freq", "bin", "z.*")
    return rounded(out, "re", "im", digits=5)


@query(f"{_band_sql(4, 8)} SELECT cycle_id, bin, round(v, 5) AS power FROM bp")
def e2_band_power(spark, sf):
    p = T.epoch_v(spark, sf).withColumn("p", spectral.band_power(F.col("signal"), rate=T.EPOCH_RATE, low=4, high=8))
    return rounded(p.select("cycle_id", F.posexplode("p").alias("bin", "power")), "power", digits=5)


def _filter_sql(column: str, low: float, high: float) -> str:
    """The filtered analytic signal of motion at 64 samples a second as fl (recording_id, sample_idx, re, im)."""
    kernel = kernels.analytic_kernel(kernels.band_taps(64, low, high, 64.0))
    h = len(kernel) // 2
    return f"""{Q.MOTION}, kn AS MATERIALIZED (SELECT unnest(range(-{h}, {h + 1})) AS j, unnest({[float(x) for x in kernel.real]!r})::DOUBLE AS re, unnest({[float(x) for x in kernel.imag]!r})::DOUBLE AS im), m0 AS MATERIALIZED (SELECT recording_id, sample_idx AS i, {column} AS v FROM motion),
le AS (SELECT recording_id, max(i) AS n FROM m0 GROUP BY 1 HAVING max(i) + 1 > {2 * h}), ext AS MATERIALIZED (SELECT m0.* FROM m0 JOIN le USING (recording_id) UNION ALL SELECT s.recording_id, -s.i, 2 * e.v - s.v FROM m0 s JOIN le USING (recording_id) JOIN m0 e ON e.recording_id = s.recording_id AND e.i = 0 WHERE s.i BETWEEN 1 AND {h}
  UNION ALL SELECT s.recording_id, 2 * le.n - s.i, 2 * e.v - s.v FROM m0 s JOIN le USING (recording_id) JOIN m0 e ON e.recording_id = s.recording_id AND e.i = le.n WHERE s.i BETWEEN le.n - {h} AND le.n - 1),
fl AS (SELECT x.recording_id, x.i + j AS sample_idx, sum(kn.re * v) AS re, sum(kn.im * v) AS im FROM ext x CROSS JOIN kn JOIN le USING (recording_id) WHERE x.i + j BETWEEN 0 AND le.n GROUP BY 1, 2)"""


@query(f"WITH {_filter_sql('y / 100', 8, 13)} SELECT recording_id, sample_idx, round(re * re + im * im, 4) AS power FROM fl")
def e3_band_power_filtered(spark, sf):
    m = T.motion_v(spark, sf).select(*K, O, (F.col("y") / 100).alias("v"))
    return rounded(spectral.recording_band(m, keys=K, value="v", rate=64.0, low=8.0, high=13.0, method="hilbert", chunk=CHUNK), "power")


@query(f"{_band_sql(8, 13, 'atan2(im, re)')} SELECT cycle_id, bin, round(v, 4) + 0.0 AS phase FROM bp")
def e4_band_phase(spark, sf):
    p = T.epoch_v(spark, sf).select("cycle_id", F.posexplode(spectral.band_phase(F.col("signal"), rate=T.EPOCH_RATE, low=8, high=13)).alias("bin", "phase"))
    return rounded(p, "phase")


@query(f"WITH {_filter_sql('y / 100', 8, 13)} SELECT recording_id, sample_idx, round(atan2(im, re), 4) + 0.0 AS phase FROM fl")
def e4_band_phase_filtered(spark, sf):
    m = T.motion_v(spark, sf).select(*K, O, (F.col("y") / 100).alias("v"))
    return rounded(spectral.recording_band(m, keys=K, value="v", rate=64.0, low=8.0, high=13.0, method="hilbert", output="phase", chunk=CHUNK), "phase")


_ZSCORE = "(SELECT cycle_id, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM {src} WHERE bin >= {a} AND bin < {b} GROUP BY 1)"


def _baseline(spark, sf, how):
    e = T.epoch_v(spark, sf).withColumn("z", spectral.baseline_correct(F.col("signal"), F.lit(4), F.lit(20), how))
    return rounded(e.select("cycle_id", F.posexplode("z").alias("bin", "v")), "v", digits=5)


@query(f"WITH {_EPOCH} SELECT cycle_id, bin, round((v - m) / s, 5) + 0.0 AS v FROM ep JOIN {_ZSCORE.format(src='ep', a=4, b=20)} USING (cycle_id)")
def e5_baseline_correct(spark, sf):
    return _baseline(spark, sf, "zscore")


@query(f"WITH {_EPOCH} SELECT cycle_id, bin, round(v / s, 5) + 0.0 AS v FROM ep JOIN {_ZSCORE.format(src='ep', a=4, b=20)} USING (cycle_id)")
def e5_baseline_sd(spark, sf):
    return _baseline(spark, sf, "sd")


@query(f"WITH {_EPOCH} SELECT cycle_id, bin, round(v - m, 5) + 0.0 AS v FROM ep JOIN {_ZSCORE.format(src='ep', a=4, b=20)} USING (cycle_id)")
def e5_baseline_mean(spark, sf):
    return _baseline(spark, sf, "mean")


@query(f"WITH {_EPOCH} SELECT ep.cycle_id, bin, round((v - m) / s, 5) + 0.0 AS v FROM ep JOIN (SELECT cycle_id, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM ep WHERE bin >= cycle_id % 8 AND bin < cycle_id % 8 + 16 GROUP BY 1) USING (cycle_id)")
def e5_baseline_per_trial(spark, sf):
    """Each trial over a part of its own."""
    start = (F.col("cycle_id") % 8).cast("int")
    e = T.epoch_v(spark, sf).withColumn("z", spectral.baseline_correct(F.col("signal"), start, start + 16, "zscore"))
    return rounded(e.select("cycle_id", F.posexplode("z").alias("bin", "v")), "v", digits=5)


# the buffer's ends are the ends of the convolved signal: an epoch is cut to [0, 64) samples here, so all of it is used
@query(f"{_band_sql(4, 8)}, c AS (SELECT cycle_id, ch_name, bin - 8 AS bin, v FROM bp WHERE bin >= 8 AND bin < 56 AND cycle_id % 2 = 0 AND ch_name IN (1, 3, 5)) SELECT cycle_id, round(0.125 + bin / 64, 6) AS t, round(avg((v - m) / s), 4) + 0.0 AS value FROM c JOIN {_ZSCORE.format(src='c', a=0, b=16)} USING (cycle_id) GROUP BY 1, 2")
def e6_event_band_power(spark, sf):
    tag = F.when(F.col("cycle_id") % 2 == 0, "trial/beep").otherwise("trial/tone")
    e = T.epoch_v(spark, sf).withColumns({"description": tag, "ch_name": F.col("ch_name").cast("string")})
    traces = spectral.event_traces(e, keys=["cycle_id"], event_key="beep", picks=["1", "3", "5"], rate=T.EPOCH_RATE, start_s=0.0, low=4, high=8, t_range=(0.125, 0.875), baseline=(0.125, 0.375), buffer_s=0.125)
    return rounded(rounded(traces, "t", digits=6), "value")


def _triples(spark, sf):
    """Epochs of three recorded channels: those of three neighbouring vectors."""
    names = F.array(*[F.lit(n) for n in ("ZERO_THREE_LEFT", "ONE_THREE_LEFT", "ZERO_TWO_LEFT")])
    e = T.epoch_v(spark, sf)
    tag = F.when(F.floor(F.col("cycle_id") / 3) % 2 == 0, "trial/beep").otherwise("trial/tone")
    return e.select(F.floor(F.col("cycle_id") / 3).alias("trial"), F.get(names, (F.col("cycle_id") % 3).cast("int")).alias("ch_name"), "signal", tag.alias("description"))


#: The derived channel (cycle 2 * trial) and a recorded one (2 * trial + 1).
_DERIVED = """raw AS (SELECT vec_id // 3 AS trial, vec_id % 3 AS c, CAST(unnest(range(64)) AS INT) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
ep AS (SELECT 2 * trial AS cycle_id, 0 AS ch_name, bin, sum(CASE c WHEN 0 THEN v ELSE -v END) AS v FROM raw WHERE c < 2 GROUP BY trial, bin HAVING count(*) = 2 UNION ALL SELECT 2 * trial + 1, 1, bin, v FROM raw WHERE c = 1)"""


@query(f"{_band_sql(4, 8).replace(_EPOCH, _DERIVED)}, c AS (SELECT cycle_id, cycle_id // 2 AS trial, bin - 8 AS bin, v FROM bp WHERE bin >= 8 AND bin < 56 AND cycle_id // 2 % 2 = 0) SELECT trial, round(0.125 + bin / 64, 6) AS t, round(avg((v - m) / s), 4) + 0.0 AS value FROM c JOIN {_ZSCORE.format(src='c', a=0, b=16)} USING (cycle_id) GROUP BY 1, 2")
def e6_derived_event_traces(spark, sf):
    """Of a derived channel and a recorded one."""
    traces = spectral.event_traces(_triples(spark, sf), keys=["trial"], event_key="beep", picks=["ZERO_ONE_LEFT", "ONE_THREE_LEFT"], rate=T.EPOCH_RATE, start_s=0.0, low=4, high=8, t_range=(0.125, 0.875), baseline=(0.125, 0.375), buffer_s=0.125)
    return rounded(rounded(traces, "t", digits=6), "value")


def _core(spark, sf):
    return T.epoch_v(spark, sf).withColumns({"cycle_start_idx": F.lit(8), "cycle_mid_idx": F.lit(27), "cycle_end_idx": F.lit(56)})


_WARP = "SELECT *, CASE WHEN o < 10 THEN o * 19 / 10.0 ELSE 19 + (o - 10) * 28 / 9.0 END AS p FROM (SELECT *, CAST(unnest(range(20)) AS INT) AS o FROM a)"
_E7 = f"{_band_sql(13, 30)}, n AS (SELECT cycle_id, bin - 8 AS bin, (v - m) / s AS v FROM bp JOIN {_ZSCORE.format(src='bp', a=0, b=64)} USING (cycle_id) WHERE bin >= 8 AND bin < 56), a AS (SELECT cycle_id, list(v ORDER BY bin) AS v FROM n GROUP BY 1)"


@query(f"{_E7} SELECT cycle_id, o AS bin, {_LERP.replace(', 6)', ', 4)')} + 0.0 AS value FROM ({_WARP})")
def e7_cycle_band_power(spark, sf):
    return rounded(spectral.cycle_band_power(_core(spark, sf), keys=["cycle_id"], rate=T.EPOCH_RATE, low=13, high=30, n=20), "value")


@query(f"{_E7.replace(_EPOCH, _DERIVED)} SELECT trial, bin, round(avg(value), 4) + 0.0 AS value FROM (SELECT cycle_id // 2 AS trial, o AS bin, {_LERP[6:-4]} AS value FROM ({_WARP})) GROUP BY 1, 2")
def e7_derived_cycle_band_power(spark, sf):
    """Of a derived channel and a recorded one, mean over both."""
    e = _triples(spark, sf).drop("description").withColumns({"cycle_start_idx": F.lit(8), "cycle_mid_idx": F.lit(27), "cycle_end_idx": F.lit(56)})
    return rounded(spectral.cycle_band_power(e, keys=["trial"], rate=T.EPOCH_RATE, low=13, high=30, n=20, picks=["ZERO_ONE_LEFT", "ONE_THREE_LEFT"]), "value")


_E8 = f"{_CONV}, pw AS (SELECT *, re * re + im * im AS v FROM z), n AS (SELECT cycle_id, freq, bin - 8 AS bin, (v - m) / s AS v FROM pw JOIN (SELECT cycle_id, freq, avg(v) AS m, stddev_pop(v) AS s FROM pw GROUP BY 1, 2) USING (cycle_id, freq) WHERE bin >= 8 AND bin < 56), a AS (SELECT cycle_id, freq, list(v ORDER BY bin) AS v FROM n GROUP BY 1, 2)"


@query(f"{_E8} SELECT cycle_id, freq, o AS bin, {_LERP.replace(', 6)', ', 4)')} + 0.0 AS value FROM ({_WARP})")
def e8_cycle_maps(spark, sf):
    return rounded(spectral.cycle_maps(_core(spark, sf), keys=["cycle_id"], rate=T.EPOCH_RATE, freqs=E8, n=20), "value")


_PSD = f"""WITH {Q.MOTION}, seg AS (SELECT recording_id, sample_idx // 128 AS segment, sample_idx % 128 AS i, x FROM motion), whole AS (SELECT recording_id, segment FROM seg GROUP BY 1, 2 HAVING count(*) = 128),
b AS (SELECT recording_id, segment, i // 64 AS blk, i % 64 AS i, x FROM seg JOIN whole USING (recording_id, segment)), d AS (SELECT b.*, (x - m) * (0.54 - 0.46 * cos(2 * pi() * i / 64)) AS v FROM b JOIN (SELECT recording_id, segment, blk, avg(x) AS m FROM b GROUP BY 1, 2, 3) USING (recording_id, segment, blk)),
w AS (SELECT sum((0.54 - 0.46 * cos(2 * pi() * i / 64)) ** 2) AS s FROM (SELECT unnest(range(64)) AS i)), q AS (SELECT unnest(range(7, 20)) AS k),
ft AS (SELECT recording_id, segment, blk, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, sum(v * sin(2 * pi() * k * i / 64)) AS im FROM d CROSS JOIN q GROUP BY 1, 2, 3, 4)
SELECT recording_id, segment, k * 10 / 64.0 AS freq, round(10 * log10(avg(2 * (re * re + im * im) / (10 * w.s)) + 1e-12), 4) + 0.0 AS psd FROM ft CROSS JOIN w GROUP BY 1, 2, 3"""


@query(_PSD)
def e9_segment_psd(spark, sf):
    p = spectral.segment_psd(T.motion_v(spark, sf).select(*K, O, "x"), keys=K, value="x", rate=R, segment_s=12.8, n_fft=64, low=1.0, high=3.0)
    return rounded(p, "psd")


@query(f"{_CONV}, first AS (SELECT cycle_id FROM (SELECT vec_id AS cycle_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 5) SELECT ch_name, cycle_id, freq, CAST(bin - 8 AS INT) AS bin, round(re * re + im * im, 5) AS value FROM z JOIN first USING (cycle_id) WHERE bin >= 8 AND bin < 56")
def e10_single_cycle_maps(spark, sf):
    """The label stands for the recording: five cycles of each."""
    m = spectral.single_cycle_maps(_core(spark, sf), keys=[], recording="ch_name", cycle="cycle_id", rate=T.EPOCH_RATE, freqs=E8)
    return rounded(m, "value", digits=5)


@query(f"{_E8} SELECT freq, o AS bin, round(o / 19, 6) AS phase, round(avg(v), 4) + 0.0 AS value, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 3) + 0.0 AS t FROM (SELECT freq, o, {_LERP[6:-4]} AS v FROM ({_WARP})) GROUP BY 1, 2")
def e11_average_cycle_map(spark, sf):
    """The average map with the t values of its test; p is checked with f1."""
    m = spectral.average_cycle_map(_core(spark, sf), keys=["cycle_id"], rate=T.EPOCH_RATE, freqs=E8, n=20)
    return rounded(rounded(rounded(m.drop("p", "significant"), "value"), "t", digits=3), "phase", digits=6)


@query()
def e11_average_cycle_test(spark, sf):
    """The same map with p values: seeded sign flips, so without SQL; the tests run them by brute force."""
    return rounded(spectral.average_cycle_map(_core(spark, sf), keys=["cycle_id"], rate=T.EPOCH_RATE, freqs=E8, n=20), "phase", "value", "t", "p", digits=6)


def _cells(spark, sf):
    return _epoch_long(spark, sf).select(F.col("cycle_id").alias("obs"), F.floor(F.col("bin") / 8).cast("int").alias("freq_idx"), (F.col("bin") % 8).alias("bin"), F.col("v").alias("value"))


@query(f"WITH {_EPOCH} SELECT bin // 8 AS freq_idx, bin % 8 AS bin, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 5) + 0.0 AS t FROM ep GROUP BY 1, 2")
def f1_t_map(spark, sf):
    return rounded(stats.t_map(_cells(spark, sf)), "t", digits=5)


@query()
def f1_cluster_test(spark, sf):
    """Which cells of the average map differ from 0; seeded sign flips, so without SQL: the tests run them by brute force."""
    return rounded(stats.cluster_test(_cells(spark, sf), n_freqs=8, n_bins=8), "t", "p", digits=5)


# ---- artifacts

PRE, POST, ADV = 5, 15, 34
W_ = PRE + POST
_DISCOVER = f"""an AS (SELECT m.recording_id, m.sample_idx, m.x FROM motion m), sdn AS MATERIALIZED (SELECT recording_id, stddev_pop(x) AS sd, avg(x) AS mean, max(sample_idx) + 1 AS n FROM motion GROUP BY 1),
cand AS (SELECT recording_id, sample_idx AS i FROM (SELECT recording_id, sample_idx, x - mean AS v, sd, n FROM an JOIN sdn USING (recording_id)) WHERE v < -1.5 * sd AND sample_idx >= {PRE} AND sample_idx < n - {POST}),
hit AS (SELECT recording_id, unnest(list_reduce(list_prepend([-1000000]::BIGINT[], list([i] ORDER BY i)), lambda a, x: CASE WHEN x[1] - a[len(a)] >= {ADV} THEN list_concat(a, x) ELSE a END)) AS place FROM cand GROUP BY 1),
hits AS MATERIALIZED (SELECT recording_id, place FROM hit WHERE place >= 0)"""
_TEMPLATE = f"tm AS (SELECT h.recording_id, m.sample_idx - (place - {PRE}) AS k, avg(m.x - s.mean) AS v FROM hits h JOIN sdn s USING (recording_id) JOIN motion m ON m.recording_id = h.recording_id AND m.sample_idx >= place - {PRE} AND m.sample_idx < place + {POST} GROUP BY 1, 2), tpl AS MATERIALIZED (SELECT recording_id, k, v - l AS t FROM tm JOIN (SELECT recording_id, avg(v) AS l FROM tm GROUP BY 1) USING (recording_id))"
_XC = f"xc AS MATERIALIZED (SELECT m.recording_id, m.sample_idx, coalesce(sum((q.x - s.mean) * t.t), 0) AS xc FROM motion m JOIN sdn s USING (recording_id) JOIN tpl t ON t.recording_id = m.recording_id LEFT JOIN motion q ON q.recording_id = m.recording_id AND q.sample_idx = m.sample_idx - {W_ // 2} + t.k GROUP BY 1, 2)"
_PEAKS = "pk AS MATERIALIZED (SELECT b.recording_id, b.sample_idx AS place FROM xc b JOIN xc a ON a.recording_id = b.recording_id AND a.sample_idx = b.sample_idx - 1 JOIN xc c ON c.recording_id = b.recording_id AND c.sample_idx = b.sample_idx + 1 JOIN (SELECT recording_id, 0.5 * sum(t * t) AS h FROM tpl GROUP BY 1) z ON z.recording_id = b.recording_id WHERE b.xc > a.xc AND b.xc > c.xc AND b.xc >= h)"
_ARTIFACT = f"WITH {Q.MOTION}, {_DISCOVER}, {_TEMPLATE}, {_XC}, {_PEAKS}"


def _spaced_sql(advance: int) -> str:
    return f"(SELECT recording_id, unnest(list_reduce(list([place] ORDER BY place), lambda a, x: CASE WHEN x[1] - a[len(a)] >= {advance} THEN list_concat(a, x) ELSE a END)) AS place FROM pk GROUP BY 1)"


#: Windows at peaks a window's width apart never overlap: then the fit is a sum.
_CLEAN = f"""{_ARTIFACT}, used AS MATERIALIZED (SELECT s.* FROM {_spaced_sql(W_)} s JOIN sdn USING (recording_id) WHERE place >= {W_ // 2} AND place + {W_ // 2} <= n),
fit AS (SELECT h.recording_id, h.place, sum(t.t * (m.x - s.mean)) / sum(t.t * t.t) AS a FROM used h JOIN tpl t USING (recording_id) JOIN sdn s USING (recording_id) JOIN motion m ON m.recording_id = h.recording_id AND m.sample_idx = h.place - {W_ // 2} + t.k GROUP BY 1, 2),
gone AS (SELECT f.recording_id, f.place - {W_ // 2} + t.k AS i, f.a * t.t AS v FROM fit f JOIN tpl t USING (recording_id)),
cl AS MATERIALIZED (SELECT m.recording_id, m.sample_idx, m.x - s.mean AS before, m.x - s.mean - coalesce(c.v, 0) AS after FROM motion m JOIN sdn s USING (recording_id) LEFT JOIN gone c ON c.recording_id = m.recording_id AND c.i = m.sample_idx)"""
ART = {"keys": K, "value": "v"}


def _centred(spark, sf):
    return grid.remove_mean(T.motion_v(spark, sf, ["x"]), keys=K, column="x", name="v").select(*K, O, "v")


def _hits(spark, sf):
    return artifact.discover(_centred(spark, sf), **ART, pre=PRE, post=POST, advance=ADV, sd=1.5, chunk=CHUNK)


def _template(spark, sf):
    return T.stored(artifact.template(_centred(spark, sf), _hits(spark, sf), **ART, pre=PRE, post=POST))


def _peaks(spark, sf, advance=0, template=None):
    return artifact.matched(_centred(spark, sf), template or _template(spark, sf), **ART, width=W_, advance=advance, chunk=CHUNK)


FILTER = {**ART, "rate": R, "discover_advance_s": 3.4, "filter_advance_s": 2.0, "sd": 1.5, "chunk": CHUNK}


def _filtered(spark, sf):
    return artifact.filter_artifact(_centred(spark, sf), **FILTER)


@query(f"WITH {Q.MOTION}, {_DISCOVER} SELECT recording_id, place FROM hits")
def g1_discover_artifacts(spark, sf):
    return _hits(spark, sf).withColumnRenamed("at", "place")


@query(f"WITH {Q.MOTION}, {_DISCOVER}, {_TEMPLATE} SELECT recording_id, k, round(t, 4) + 0.0 AS t FROM tpl")
def g2_template(spark, sf):
    return rounded(_template(spark, sf), "t")


@query(f"WITH {Q.MOTION}, {_DISCOVER}, {_TEMPLATE}, {_XC} SELECT recording_id, sample_idx, round(xc, 2) + 0.0 AS xc FROM xc")
def g3_cross_correlation(spark, sf):
    xc = artifact.cross_correlation(_centred(spark, sf), _template(spark, sf), **ART, width=W_, chunk=CHUNK)
    return rounded(xc, "xc", digits=2)


@query(f"{_ARTIFACT} SELECT recording_id, place FROM pk")
def g4_peaks(spark, sf):
    return _peaks(spark, sf).withColumnRenamed("at", "place")


@query(f"{_ARTIFACT} SELECT recording_id, place FROM {_spaced_sql(8)}")
def g5_spacing(spark, sf):
    return _peaks(spark, sf, 8).withColumnRenamed("at", "place")


@query(f"{_CLEAN} SELECT recording_id, sample_idx, round(after, 3) + 0.0 AS clean FROM cl")
def g6_fit_subtract(spark, sf):
    """At peaks a window apart."""
    t = _template(spark, sf)
    c = artifact.subtract(_centred(spark, sf), T.stored(_peaks(spark, sf, W_, t)), t, **ART, width=W_, chunk=CHUNK)
    return rounded(c.select(*K, O, "clean"), "clean", digits=3)


#: All peaks: windows overlap, and each is fitted to what the ones before it left, here by a fold over whole recordings.
_IN_ORDER = f"""{_ARTIFACT}, sig AS (SELECT m.recording_id, list(m.x - s.mean ORDER BY m.sample_idx) AS v FROM motion m JOIN sdn s USING (recording_id) GROUP BY 1),
pat AS (SELECT recording_id, list(t ORDER BY k) AS t FROM tpl GROUP BY 1), wins AS (SELECT recording_id, list([(place - {W_ // 2})::DOUBLE] ORDER BY place) AS w FROM pk JOIN sdn USING (recording_id) WHERE place >= {W_ // 2} AND place + {W_ // 2} <= n GROUP BY 1),
swept AS (SELECT recording_id, v, list_reduce(list_prepend(v, w), lambda a, x: list_concat(a[1:x[1]::BIGINT], list_transform(list_zip(a[x[1]::BIGINT + 1:x[1]::BIGINT + {W_}], t), lambda z: z[1] - z[2] * list_inner_product(a[x[1]::BIGINT + 1:x[1]::BIGINT + {W_}], t) / list_inner_product(t, t)), a[x[1]::BIGINT + {W_ + 1}:])) AS c FROM wins JOIN sig USING (recording_id) JOIN pat USING (recording_id)),
ord AS MATERIALIZED (SELECT sig.recording_id, unnest(range(len(sig.v))) AS sample_idx, unnest(sig.v) AS before, unnest(coalesce(c, sig.v)) AS after FROM sig LEFT JOIN swept USING (recording_id))"""


@query(f"{_IN_ORDER} SELECT recording_id, sample_idx, round(after, 3) + 0.0 AS clean FROM ord")
def g6_fit_subtract_overlapping(spark, sf):
    """At all peaks, so that windows overlap along whole recordings."""
    t = _template(spark, sf)
    c = artifact.subtract(_centred(spark, sf), T.stored(_peaks(spark, sf, 0, t)), t, **ART, width=W_, chunk=CHUNK)
    return rounded(c.select(*K, O, "clean"), "clean", digits=3)


@query(f"{_CLEAN} SELECT h.recording_id, m.sample_idx - (place - {W_ // 2}) AS k, count(*) AS n, round(avg(before), 4) + 0.0 AS before_mean, round(stddev_samp(before) / sqrt(count(*)), 4) AS before_sem, round(avg(after), 4) + 0.0 AS after_mean, round(stddev_samp(after) / sqrt(count(*)), 4) AS after_sem FROM used h JOIN cl m ON m.recording_id = h.recording_id AND m.sample_idx >= place - {W_ // 2} AND m.sample_idx < place + {W_ // 2} GROUP BY 1, 2")
def g7_artifact_quality(spark, sf):
    q = _filtered(spark, sf)[1]
    return rounded(q, *[c for c in q.columns if c.endswith(("_mean", "_sem"))])


@query(f"{_CLEAN} SELECT recording_id, sample_idx, round(before, 3) + 0.0 AS v, round(after, 3) + 0.0 AS clean FROM cl")
def g8_filter_artifact(spark, sf):
    """The whole chain of G1 to G6."""
    return rounded(_filtered(spark, sf)[0].select(*K, O, "v", "clean"), "v", "clean", digits=3)


@query(f"{_IN_ORDER} SELECT recording_id, sample_idx, round(before, 3) + 0.0 AS v, round(after, 3) + 0.0 AS clean FROM ord")
def g8_filter_artifact_overlapping(spark, sf):
    """The whole chain with its default of no distance between subtracted windows."""
    clean = artifact.filter_artifact(_centred(spark, sf), **ART, rate=R, discover_advance_s=3.4, sd=1.5, chunk=CHUNK)[0]
    return rounded(clean.select(*K, O, "v", "clean"), "v", "clean", digits=3)


@query(f"{_CLEAN} SELECT recording_id, (SELECT count(*) FROM hits h WHERE h.recording_id = s.recording_id) AS n_discovered, (SELECT count(*) FROM used u WHERE u.recording_id = s.recording_id) AS n_subtracted FROM sdn s")
def g8_artifact_counts(spark, sf):
    return artifact.count_artifacts(_centred(spark, sf), **FILTER)


# ---- path overlays

_P1 = f"""WITH {Q.MOTION}, {_kernel(_inside(13, 30))}, mm AS MATERIALIZED (SELECT recording_id, sample_idx AS i, y FROM motion), z AS (SELECT m.recording_id, m.i + k.i AS i, k.freq, sum(k.re * y) AS re, sum(k.im * y) AS im FROM mm m CROSS JOIN k GROUP BY 1, 2, 3),
pw AS MATERIALIZED (SELECT z.recording_id, z.i, avg(re * re + im * im) AS p FROM z JOIN mm ON mm.recording_id = z.recording_id AND mm.i = z.i GROUP BY 1, 2), zs AS (SELECT pw.recording_id, i, (p - m) / s AS p FROM pw JOIN (SELECT recording_id, avg(p) AS m, stddev_pop(p) AS s FROM pw GROUP BY 1) USING (recording_id)),
nb AS (SELECT recording_id, floor(least(max(i) / 10.0, max(i) / 64.0) / 0.5) AS bins FROM mm GROUP BY 1), b AS (SELECT nb.recording_id, unnest(range(CAST(bins AS BIGINT))) AS bin FROM nb),
mo AS (SELECT b.recording_id, b.bin, avg(x) / 1000 AS x, avg(y) / 1000 AS y FROM b JOIN motion m ON m.recording_id = b.recording_id AND m.sample_idx BETWEEN b.bin * 5 AND b.bin * 5 + 5 GROUP BY 1, 2),
ne AS (SELECT recording_id, i // 32 AS bin, avg(p) AS p FROM zs GROUP BY 1, 2), j AS MATERIALIZED (SELECT mo.*, p FROM mo JOIN ne USING (recording_id, bin))"""


@query(f"{_P1} SELECT a.recording_id, a.bin, round(a.x, 6) AS x0, round(a.y, 6) AS y0, round(c.x, 6) AS x1, round(c.y, 6) AS y1, round((a.p + c.p) / 2, 4) + 0.0 AS value, round(1 / (1 + exp(1 - abs((a.p + c.p) / 2))), 5) AS weight FROM j a JOIN j c ON c.recording_id = a.recording_id AND c.bin = a.bin + 1")
def p1_path_band_power(spark, sf):
    m = T.motion_v(spark, sf)
    neural = m.select(*K, O, F.lit("ZERO_TWO_LEFT").alias("ch_name"), F.col("y").alias("value"))
    s = overlays.path_band_power(m, neural, key="recording_id", x="x", y="y", rate=R, neural_rate=64.0, bin_s=0.5, chunk=CHUNK)
    return rounded(rounded(rounded(s, "x0", "y0", "x1", "y1", digits=6), "value"), "weight", digits=5)


@query(f"WITH {Q.MOTION}, m AS (SELECT recording_id, sample_idx, x / 1000 AS x_m, y / 1000 AS y_m FROM motion), {Q.grad('g', 'm', {'gx': 'x_m', 'gy': 'y_m'}, 0.1)}, v AS (SELECT *, sqrt(gx ** 2 + gy ** 2) AS v FROM g), {Q.zero('s', 'v', 'v', 2)}, b AS (SELECT recording_id, sample_idx // 10 AS bin, avg(x_m) AS x, avg(y_m) AS y, avg(z) AS s FROM s GROUP BY 1, 2 HAVING count(*) = 10) SELECT a.recording_id, a.bin, round(a.x, 6) AS x0, round(a.y, 6) AS y0, round(c.x, 6) AS x1, round(c.y, 6) AS y1, round((a.s + c.s) / 2, 6) AS value FROM b a JOIN b c ON c.recording_id = a.recording_id AND c.bin = a.bin + 1")
def p2_path_speed(spark, sf):
    return rounded(overlays.path_speed(T.motion_v(spark, sf), key="recording_id", x="x", y="y", rate=R, bin_s=1.0, chunk=CHUNK), "x0", "y0", "x1", "y1", "value", digits=6)


_P3 = f"{_RHYTHM}, r AS (SELECT z.recording_id, z.bin, CASE WHEN z.n < 16 THEN NULL WHEN max(s) FILTER (lag = 0) <= 1e-12 THEN 0 ELSE max(s) FILTER (lag >= 3) / max(s) FILTER (lag = 0) END AS v FROM z JOIN ac USING (recording_id, bin) GROUP BY z.recording_id, z.bin, z.n), xy AS (SELECT recording_id, sample_idx // 2 AS bin, avg(x) / 1000 AS x, avg(y) / 1000 AS y FROM motion GROUP BY 1, 2 HAVING count(*) = 2), q AS (SELECT r.recording_id, r.bin, x, y, v FROM r JOIN xy USING (recording_id, bin)), sg AS (SELECT a.recording_id, a.bin, a.x AS x0, a.y AS y0, c.x AS x1, c.y AS y1, (a.v + c.v) / 2 AS v FROM q a JOIN q c ON c.recording_id = a.recording_id AND c.bin = a.bin + 1)"


def _rhythm_path(spark, sf):
    return overlays.path_rhythmicity(T.motion_v(spark, sf), key="recording_id", x="x", y="y", rhythm="y", rate=R, bin_s=0.2, win_s=2.0, lag_s=(0.3, 1.2), chunk=CHUNK)


@query(f"{_P3} SELECT recording_id, round(quantile_cont(v, 0.05), 4) + 0.0 AS low, round(quantile_cont(v, 0.95), 4) + 0.0 AS high FROM sg GROUP BY 1")
def p3_path_rhythmicity(spark, sf):
    return rounded(_rhythm_path(spark, sf)[1], "low", "high")


@query(f"{_P3} SELECT recording_id, bin, round(x0, 7) AS x0, round(y0, 7) AS y0, round(x1, 7) AS x1, round(y1, 7) AS y1, round(v, 5) + 0.0 AS value FROM sg")
def p3_rhythmicity_segments(spark, sf):
    return rounded(rounded(_rhythm_path(spark, sf)[0], "x0", "y0", "x1", "y1", digits=7), "value", digits=5)


@query(f"""WITH {Q.MOTION}, {_LEAN_EVENTS}, ev AS (SELECT * FROM lr WHERE n >= 2 AND a < last_idx), pt AS (SELECT m.recording_id, m.sample_idx // 5 AS bin, CASE e.state WHEN -1 THEN 'gait_lean_left' WHEN 1 THEN 'gait_lean_right' ELSE 'gait_lean_reset' END AS label, x, y FROM motion m LEFT JOIN ev e ON e.recording_id = m.recording_id AND m.sample_idx >= e.a AND m.sample_idx < e.a + e.n),
c AS (SELECT recording_id, bin, label, count(*) AS n FROM pt GROUP BY 1, 2, 3), w AS (SELECT recording_id, bin, arg_min(label, struct_pack(m := -n, l := label)) AS label FROM c GROUP BY 1, 2 HAVING sum(n) = 5), b AS (SELECT recording_id, bin, avg(x) / 1000 AS x, avg(y) / 1000 AS y FROM pt GROUP BY 1, 2 HAVING count(*) = 5)
SELECT a.recording_id, a.bin, round(a.x, 7) AS x0, round(a.y, 7) AS y0, round(c.x, 7) AS x1, round(c.y, 7) AS y1, w.label FROM b a JOIN b c ON c.recording_id = a.recording_id AND c.bin = a.bin + 1 JOIN w ON w.recording_id = a.recording_id AND w.bin = a.bin""")
def p4_path_gait_phase(spark, sf):
    m = T.motion_v(spark, sf)
    ev = events.annotate_gait_lean(m, **GRID, x="x", y="y", rate=R, lean_s=0.3, min_s=0.2, chunk=CHUNK)
    return rounded(overlays.path_gait_phase(m, ev, key="recording_id", x="x", y="y", rate=R, bin_s=0.5), "x0", "y0", "x1", "y1", digits=7)
