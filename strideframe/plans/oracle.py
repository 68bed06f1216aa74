"""Common table expressions in SQL (as DuckDB runs it), written from the operators' definitions, mostly with joins in place of windows."""

from __future__ import annotations

MOTION = """motion AS MATERIALIZED (SELECT l_suppkey AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS sample_idx,
  l_extendedprice / 97.13579::DOUBLE AS x, l_quantity * 20 AS y, l_discount * 10000 AS lx, l_tax * 10000 AS ly, l_quantity * l_tax * 100 AS rx, l_extendedprice * l_discount / 10 AS ry FROM lineitem)"""
SWING = "swing AS (SELECT o_custkey AS recording_id, o_orderkey AS event_id, CAST(epoch(o_orderdate) AS BIGINT) / 86400.0 AS onset, CASE o_orderstatus WHEN 'O' THEN 'L' WHEN 'F' THEN 'R' ELSE 'reset' END AS kind, o_totalprice / 997 AS steplen_m FROM orders)"
SESSION = "session AS (SELECT c_nationkey AS session_id, o_custkey AS recording_id, CAST(epoch(min(o_orderdate)) AS BIGINT) / 86400.0 AS start, CAST(epoch(max(o_orderdate)) AS BIGINT) / 86400.0 - CAST(epoch(min(o_orderdate)) AS BIGINT) / 86400.0 AS length FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"
CUE = "cue AS (SELECT user_id AS recording_id, event_id, epoch_us(ts) / 1000000.0 - 1704067200 AS onset, event_type AS description, value FROM events)"
PAIRS = """step1 AS (SELECT *, lead(kind) OVER w AS k2, lead(onset) OVER w AS right_onset, lead(steplen_m) OVER w AS right_steplen_m, lead(event_id) OVER w AS right_event_id FROM swing WHERE kind <> 'reset' WINDOW w AS (PARTITION BY recording_id ORDER BY onset, event_id)),
pairs AS (SELECT * FROM (SELECT *, steplen_m AS left_steplen_m, lead(onset) OVER (PARTITION BY recording_id ORDER BY onset, event_id) - onset AS duration FROM step1 WHERE kind = 'L') WHERE k2 = 'R')"""


def smooth(out: str, src: str, cols: dict[str, str], w: int) -> str:
    """B1 by joining each row to the continued rows of its frame."""
    h, ins = w // 2, list(cols.values())
    plain, mirror = ", ".join(ins), ", ".join(f"2 * e.{c} - s.{c}" for c in ins)
    means = ", ".join(f"avg(p.{c}) AS {o}" for o, c in cols.items())
    return f"""{out}_n AS (SELECT recording_id, max(sample_idx) AS m FROM {src} GROUP BY 1), {out}_p AS (SELECT recording_id, sample_idx AS i, {plain} FROM {src}
  UNION ALL SELECT s.recording_id, -s.sample_idx, {mirror} FROM {src} s JOIN {src} e ON e.recording_id = s.recording_id AND e.sample_idx = 0 WHERE s.sample_idx BETWEEN 1 AND {h}
  UNION ALL SELECT s.recording_id, 2 * n.m - s.sample_idx, {mirror} FROM {src} s JOIN {out}_n n ON n.recording_id = s.recording_id JOIN {src} e ON e.recording_id = s.recording_id AND e.sample_idx = n.m WHERE s.sample_idx BETWEEN n.m - {h} AND n.m - 1),
{out} AS (SELECT b.*, {", ".join(f"a.{o}" for o in cols)} FROM {src} b JOIN (SELECT b.recording_id, b.sample_idx, {means} FROM {src} b JOIN {out}_p p ON p.recording_id = b.recording_id AND p.i BETWEEN b.sample_idx - {h} AND b.sample_idx + {(w - 1) // 2} GROUP BY 1, 2) a ON a.recording_id = b.recording_id AND a.sample_idx = b.sample_idx)"""


def zero(out: str, src: str, col: str, w: int) -> str:
    """B2 as column z."""
    return f"{out} AS (SELECT b.*, a.z FROM {src} b JOIN (SELECT b.recording_id, b.sample_idx, sum(p.{col}) / {w} AS z FROM {src} b JOIN {src} p ON p.recording_id = b.recording_id AND p.sample_idx BETWEEN b.sample_idx - {w // 2} AND b.sample_idx + {(w - 1) // 2} GROUP BY 1, 2) a ON a.recording_id = b.recording_id AND a.sample_idx = b.sample_idx)"


def grad(out: str, src: str, cols: dict[str, str], dt: float) -> str:
    """B3."""
    parts = ", ".join(f"CASE WHEN n{i} IS NOT NULL AND p{i} IS NOT NULL THEN (n{i} - p{i}) / {2 * dt} WHEN n{i} IS NOT NULL THEN (n{i} - {c}) / {dt} ELSE ({c} - p{i}) / {dt} END AS {o}" for i, (o, c) in enumerate(cols.items()))
    beside = ", ".join(f"lead({c}) OVER w AS n{i}, lag({c}) OVER w AS p{i}" for i, c in enumerate(cols.values()))
    drop = ", ".join(f"n{i}, p{i}" for i in range(len(cols)))
    return f"{out}_b AS (SELECT *, {beside} FROM {src} WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)), {out} AS (SELECT * EXCLUDE ({drop}), {parts} FROM {out}_b)"


def runs(out: str, src: str) -> str:
    """Runs of equal state: start a, length n, and the recording's last index."""
    return f"""{out}_c AS (SELECT s.recording_id, s.sample_idx AS a, s.state FROM {src} s LEFT JOIN {src} b ON b.recording_id = s.recording_id AND b.sample_idx = s.sample_idx - 1 WHERE b.state IS NULL OR b.state <> s.state),
{out} AS (SELECT c.recording_id, c.a, c.state, m.last_idx, coalesce(lead(c.a) OVER (PARTITION BY c.recording_id ORDER BY c.a), m.last_idx + 1) - c.a AS n FROM {out}_c c JOIN (SELECT recording_id, max(sample_idx) AS last_idx FROM {src} GROUP BY 1) m USING (recording_id))"""


def wrapped(e: str) -> str:
    return f"(({e}) + pi() - 2 * pi() * floor((({e}) + pi()) / (2 * pi())) - pi())"


HEADING = f"{smooth('hs', 'motion', {'sx': 'x', 'sy': 'y'}, 15)}, {grad('hg', 'hs', {'gx': 'sx', 'gy': 'sy'}, 0.1)}, heading AS (SELECT *, atan2(gy, gx) AS heading FROM hg)"
LEAN = f"{HEADING}, {grad('hr', 'heading', {'rgx': 'x', 'rgy': 'y'}, 0.1)}, raw_lean AS (SELECT recording_id, sample_idx, {wrapped('atan2(rgy, rgx) - heading')} AS raw FROM hr), {smooth('lean', 'raw_lean', {'lean': 'raw'}, 3)}"
FORWARD = f"""{HEADING}, {grad('fg', 'heading', {'vlx': 'lx', 'vly': 'ly', 'vrx': 'rx', 'vry': 'ry'}, 0.1)},
fu AS (SELECT *, CASE WHEN sqrt(gx * gx + gy * gy) > 1e-9 THEN gx / sqrt(gx * gx + gy * gy) ELSE 0 END AS ux, CASE WHEN sqrt(gx * gx + gy * gy) > 1e-9 THEN gy / sqrt(gx * gx + gy * gy) ELSE 0 END AS uy FROM fg),
fr AS (SELECT recording_id, sample_idx, ux * vlx + uy * vly AS fl, ux * vrx + uy * vry AS fr FROM fu), {smooth('fwd', 'fr', {'fwd_left': 'fl', 'fwd_right': 'fr'}, 2)}"""
STATE = "st AS (SELECT recording_id, sample_idx, CASE WHEN fwd_left > 300 AND NOT fwd_right > 300 THEN -1 WHEN fwd_right > 300 AND NOT fwd_left > 300 THEN 1 ELSE 0 END AS state FROM fwd)"
