"""Choosing, deriving and joining channels; checks across recordings."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bipolar pairs as sums of recorded pairs.
BIPOLAR = {"ZERO_ONE": {"ZERO_THREE": 1, "ONE_THREE": -1}, "ONE_TWO": {"ONE_THREE": 1, "ZERO_THREE": -1, "ZERO_TWO": 1}, "TWO_THREE": {"ZERO_THREE": 1, "ZERO_TWO": -1}}


def bipolar_terms(name: str) -> dict[str, int] | None:
    """Recorded channels and factors of a derived one such as ZERO_ONE_LEFT; None (and a warning) for a reversed pair."""
    pair, _, side = name.upper().rpartition("_")
    if side not in ("LEFT", "RIGHT"):
        raise ValueError(f"no side in {name}")
    if pair in BIPOLAR:
        return {f"{k}_{side}": v for k, v in BIPOLAR[pair].items()}
    if "_".join(reversed(pair.split("_"))) in BIPOLAR:
        warnings.warn(f"{name} is reversed", stacklevel=2)
        return None
    raise ValueError(f"unknown pair {name}")


def rereference(samples: DataFrame, targets: list[str], *, keys: list[str]) -> DataFrame:
    """Derived channels of long samples (keys, ch_name, value), where all their sources are present (A4)."""
    rows = [(t.upper(), s, float(c), len(terms)) for t in targets if (terms := bipolar_terms(t)) for s, c in terms.items()]
    if not rows:
        return samples.limit(0)
    coeffs = samples.sparkSession.createDataFrame(rows, "target string, ch_name string, coeff double, n_terms int")
    j = samples.join(F.broadcast(coeffs), "ch_name")  # three rows a target
    out = j.groupBy(*keys, "target", "n_terms").agg(F.sum(F.col("coeff") * F.col("value")).alias("value"), F.count("*").alias("_n"))
    return out.where("_n = n_terms").select(*keys, F.col("target").alias("ch_name"), "value")


def rereference_wide(samples: DataFrame, targets: list[str], *, keys: list[str]) -> DataFrame:
    """keys and the derived channels of samples with a column for each channel (A4): arithmetic on every row. A missing source is an error."""
    made = {t.upper(): terms for t in targets if (terms := bipolar_terms(t))}
    missing = {c for terms in made.values() for c in terms} - set(samples.columns)
    if missing:
        raise ValueError(f"missing channels {sorted(missing)}")
    total = lambda terms: sum((c * F.col(s) for s, c in terms.items()), F.lit(0.0))
    return samples.select(*keys, *[total(terms).alias(t) for t, terms in made.items()])


def pick_wide(samples: DataFrame, picks: list[str], *, keys: list[str]) -> DataFrame:
    """keys, the picked channels that are columns, and then the others derived (A3)."""
    there, derived = [p for p in picks if p in samples.columns], [p for p in picks if p not in samples.columns]
    out = rereference_wide(samples, derived, keys=[*keys, *there]) if derived else samples.select(*keys, *there)
    if len(out.columns) == len(keys):
        raise ValueError("no channel is left")
    return out


def to_long(samples: DataFrame, *, keys: list[str]) -> DataFrame:
    """keys, ch_name and value of samples with a column for each channel."""
    return samples.unpivot(keys, [c for c in samples.columns if c not in keys], "ch_name", "value")


def pick_channels(samples: DataFrame, picks: list[str], available: list[str], *, keys: list[str]) -> DataFrame:
    """Requested channels that exist, and the others derived (A3)."""
    there, derived = [p for p in picks if p in available], [p for p in picks if p not in available]
    out = samples.where(F.col("ch_name").isin(there)).select(*keys, "ch_name", "value")
    if derived:
        out = out.unionByName(rereference(samples, derived, keys=keys))
    elif not there:
        raise ValueError("no channel is left")
    return out


def pick_arrays(epochs: DataFrame, picks: list[str], *, signal: str = "signal") -> DataFrame:
    """epochs (ch_name, an array signal, and columns that an epoch's channels share) of the picked channels; those that an epoch doesn't have are derived from it (A3, A4).

    Arrays are added up element by element; an epoch that lacks a source doesn't get the derived channel.
    """
    terms = {}
    for p in picks:
        try:
            terms[p] = bipolar_terms(p)
        except ValueError:
            terms[p] = None  # a name of its own: there or not
    rows = [(p, s, float(c), len(t)) for p, t in terms.items() if t for s, c in t.items()]
    there = epochs.where(F.col("ch_name").isin(picks))
    if not rows:
        return there
    ids = [c for c in epochs.columns if c not in ("ch_name", signal)]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*ids, "ch_name"]]
    coeffs = epochs.sparkSession.createDataFrame(rows, "_target string, _source string, _coeff double, _terms int")
    scaled = epochs.join(F.broadcast(coeffs), F.col("ch_name") == F.col("_source"))  # three rows a target
    parts = scaled.groupBy(*ids, "_target", "_terms").agg(F.collect_list(F.transform(signal, lambda x: x * F.col("_coeff"))).alias("_p"))
    total = F.reduce(F.slice("_p", 2, 2), F.get("_p", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    made = parts.where(F.size("_p") == F.col("_terms")).select(*ids, F.col("_target").alias("ch_name"), total.alias(signal))
    made = made.alias("m").join(there.alias("t"), same("m", "t"), "left_anti")
    return there.unionByName(made.select(*there.columns))


def combine_channels(df: DataFrame, *, keys: list[str], value: str) -> DataFrame:
    """Mean over channels (D12); also of maps over observations."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def concatenate_runs(recordings: DataFrame, *, keys: list[str], chosen: list[int] | None = None) -> DataFrame:
    """recordings (run_id, run_pos, n_times) with the offset of each run in the whole and the whole's label, first or first-last (A2)."""
    r = recordings.where(F.col("run_pos").isin(chosen)) if chosen is not None else recordings
    label = r.groupBy(*keys).agg(F.min_by("run_id", "run_pos").alias("_a"), F.max_by("run_id", "run_pos").alias("_b"), F.count("*").alias("_n"))
    label = label.select(*keys, F.when(F.col("_n") == 1, F.col("_a").cast("string")).otherwise(F.concat_ws("-", "_a", "_b")).alias("run_label"))
    before = Window.partitionBy(*keys).orderBy("run_pos").rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("offset", F.coalesce(F.sum("n_times").over(before), F.lit(0))).join(label, keys)


def unsynced(recordings: DataFrame, *, session: str, pos: str, tolerance: float = 0.01) -> DataFrame:
    """Recordings whose start or length differs from their session's first by more than the tolerance, or is null (A5)."""
    w = Window.partitionBy(session).orderBy(pos)
    r = recordings.withColumn("start_diff", F.col("start") - F.first("start").over(w)).withColumn("length_diff", F.col("length") - F.first("length").over(w))
    far = (F.abs("start_diff") > tolerance) | (F.abs("length_diff") > tolerance) | F.col("start").isNull()
    many = F.count("*").over(Window.partitionBy(session)) > 1
    return r.withColumn("_many", many).where(F.col("_many") & far).drop("_many")


def synced(rows: DataFrame, recordings: DataFrame, *, session: str, pos: str = "pos", tolerance: float = 0.01) -> DataFrame:
    """rows of the sessions of recordings (session, pos, start, length) that have none out of sync (A5)."""
    off = unsynced(recordings, session=session, pos=pos, tolerance=tolerance).select(session).distinct()
    return rows.join(recordings.select(session).distinct().join(off, session, "left_anti"), session, "left_semi")


def common_span(recordings: DataFrame, *, session: str) -> DataFrame:
    """Latest start and earliest end of each session, and whether all its recordings share a point (A6); touching is sharing."""
    g = recordings.groupBy(session).agg(F.max("start").alias("span_start"), F.min(F.col("start") + F.col("length")).alias("span_end"), F.max(F.col("start").isNull()).alias("_null"))
    return g.withColumn("overlap", (F.col("span_start") <= F.col("span_end")) & ~F.col("_null")).drop("_null")
