"""States to events, labels, and replacing old labels by new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import in_chunks
from .kinematics import forward_speed, lean_angle

#: Samples of a recording that one task takes, beside their halo.
CHUNK = 65536
NAMES = {-1: "left", 0: "reset", 1: "right"}


def lean_state(lean: Column) -> Column:
    """-1 leaning left (positive), 1 right, 0 neither."""
    return F.when(lean > 0, -1).when(lean < 0, 1).otherwise(0)


def step_state(left: Column, right: Column, threshold: float = 300.0) -> Column:
    """-1 if only the left foot is faster than the threshold, 1 if only the right one is, else 0."""
    return F.when((left > threshold) & ~(right > threshold), -1).when((right > threshold) & ~(left > threshold), 1).otherwise(0)


def _changes(df: DataFrame, keys: list[str], order: str, state: str, points: dict[str, str]) -> DataFrame:
    """df with the state of the sample before (_prev), and where the points were then."""
    base = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"_prev": F.lag(state).over(base)} | {f"_back_{n}": F.lag(c).over(base) for n, c in points.items()})


def _points(feet: dict[str, tuple[str, str]] | None) -> dict[str, str]:
    return {f"{side}_{c}": col for side, pair in (feet or {}).items() for c, col in zip("xy", pair, strict=True)}


def _events(changes: DataFrame, samples: DataFrame, *, keys: list[str], order: str, state: str, rate: float, min_samples: int, feet: dict[str, tuple[str, str]] | None) -> DataFrame:
    """Events from _changes() of all samples: only the rows that begin a run are brought together by recording."""
    points = _points(feet)
    base = Window.partitionBy(*keys).orderBy(order)
    begun = changes.where(f"_prev IS NULL OR _prev <> {state}").select(*keys, order, state, *dict.fromkeys(points.values()), *[f"_back_{n}" for n in points])
    ends = samples.groupBy(*keys).agg(F.max(order).alias("_end"), *[F.max_by(c, order).alias(f"_stop_{n}") for n, c in points.items()])
    nexts = {"_next": F.lead(order).over(base)} | {f"_to_{n}": F.lead(f"_back_{n}").over(base) for n in points}
    out = begun.withColumns(nexts).join(ends, keys).withColumn("_len", F.coalesce("_next", F.col("_end") + 1) - F.col(order))
    if points:
        to = lambda n: F.when(F.col("_next").isNotNull(), F.col(f"_to_{n}")).otherwise(F.col(f"_stop_{n}"))
        dist = lambda s: F.hypot(to(f"{s}_x") - F.col(feet[s][0]), to(f"{s}_y") - F.col(feet[s][1])) / 1000
        out = out.withColumn("steplen_m", F.when(F.col(state) == -1, dist("left")).when(F.col(state) == 1, dist("right")))
    out = out.where((F.col("_len") >= min_samples) & (F.col(order) < F.col("_end")))
    return out.select(*keys, (F.col(order) / rate).alias("onset"), (F.col("_len") / rate).alias("duration"), F.col(state).alias("state"), *(["steplen_m"] if points else []))


def runs_to_events(df: DataFrame, *, keys: list[str], order: str, state: str, rate: float, min_samples: int = 1, feet: dict[str, tuple[str, str]] | None = None, chunk: int = CHUNK) -> DataFrame:
    """onset, duration, state (and for feet: steplen_m of the swinging foot) of runs of equal state of at least min_samples.

    A run that begins on the last sample is never an event. Samples are compared with the one before on chunks; runs go across
    chunks, since only their first samples are put in order by recording.
    """
    points = _points(feet)
    rows = df.select(*keys, order, state, *dict.fromkeys(points.values()))
    changes = in_chunks(rows, lambda d, k: _changes(d, k, order, state, points), keys=keys, order=order, chunk=chunk, halo=1)
    return _events(changes, rows, keys=keys, order=order, state=state, rate=rate, min_samples=min_samples, feet=feet)


def _half(seconds: float, rate: float) -> int:
    return max(1, round(seconds * rate)) // 2


def annotate_gait_lean(motion: DataFrame, *, keys: list[str], order: str, x: str, y: str, rate: float, direction_s: float = 1.5, lean_s: float = 0.1, min_s: float = 0.3, chunk: int = CHUNK, annotations: DataFrame | None = None) -> DataFrame:
    """Events gait_lean_left, _right and _reset of head positions (C5); all windows of the chain run on chunks of a recording.

    With annotations (keys, onset, duration, description, ...) these are returned too, without those whose description is among a recording's new ones (C7a).
    """

    def states(d: DataFrame, k: list[str]) -> DataFrame:
        lean = lean_angle(d, keys=k, order=order, x=x, y=y, rate=rate, direction_s=direction_s, lean_s=lean_s)
        return _changes(lean.withColumn("state", lean_state(F.col("lean"))), k, order, "state", {})

    rows = motion.select(*keys, order, x, y)
    halo = _half(direction_s, rate) + _half(lean_s, rate) + 3
    changes = in_chunks(rows, states, keys=keys, order=order, chunk=max(chunk, halo), halo=halo)
    new = _named(_events(changes, rows, keys=keys, order=order, state="state", rate=rate, min_samples=max(1, round(min_s * rate)), feet=None), "gait_lean_")
    return new if annotations is None else replace_by_description(annotations, new, keys=keys)


def annotate_steps(motion: DataFrame, *, keys: list[str], order: str, head: tuple[str, str], left: tuple[str, str], right: tuple[str, str], rate: float, direction_s: float = 1.5, speed_s: float = 0.1, threshold: float = 300.0, min_s: float = 0.2, chunk: int = CHUNK, annotations: DataFrame | None = None) -> DataFrame:
    """Events lr_step_left, _right and _reset with their step length (C6); all windows of the chain run on chunks of a recording.

    With annotations (keys, onset, duration, description, ...) these are returned too, without those of the recordings of motion whose label is
    one of the three, whatever step length stands behind it (C7b).
    """
    feet = {"left": left, "right": right}

    def states(d: DataFrame, k: list[str]) -> DataFrame:
        fwd = forward_speed(d, keys=k, order=order, head=head, feet={"fwd_left": left, "fwd_right": right}, rate=rate, direction_s=direction_s, speed_s=speed_s)
        return _changes(fwd.withColumn("state", step_state(F.col("fwd_left"), F.col("fwd_right"), threshold)), k, order, "state", _points(feet))

    rows = motion.select(*keys, order, *dict.fromkeys([*head, *left, *right]))
    halo = _half(direction_s, rate) + _half(speed_s, rate) + 3
    changes = in_chunks(rows, states, keys=keys, order=order, chunk=max(chunk, halo), halo=halo)
    new = _named(_events(changes, rows, keys=keys, order=order, state="state", rate=rate, min_samples=max(1, round(min_s * rate)), feet=feet), "lr_step_")
    return new if annotations is None else replace_by_label(annotations, new, [f"lr_step_{k}" for k in NAMES.values()], within=motion.select(*keys).distinct())


def _named(events: DataFrame, prefix: str) -> DataFrame:
    name = F.when(F.col("state") == -1, "left").when(F.col("state") == 1, "right").otherwise("reset")
    return events.withColumn("description", F.concat(F.lit(prefix), name)).drop("state")


def base_label(description: Column) -> Column:
    """What stands before the first /."""
    return F.split(description, "/")[0]


def step_length_tag(description: Column) -> Column:
    """The number of a field steplen..., or null."""
    text = F.regexp_extract(description, r"/steplen([^/]*)", 1)
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double"))


def replace_by_description(old: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    """old without rows whose full description is among the new ones of its recording, and new."""
    made = new.select(*keys, "description").distinct()
    return old.join(made, [*keys, "description"], "left_anti").unionByName(new, allowMissingColumns=True)


def replace_by_label(old: DataFrame, new: DataFrame, labels: list[str], *, within: DataFrame | None = None) -> DataFrame:
    """old without rows whose base label is one of labels (and that match a row of within, if that is given), and new."""
    named = F.coalesce(base_label(F.col("description")).isin(labels), F.lit(False))
    kept = old.where(~named)
    if within is not None:
        kept = kept.unionByName(old.where(named).join(within, within.columns, "left_anti"))
    return kept.unionByName(new, allowMissingColumns=True)


def with_tag(events: DataFrame, key: str) -> DataFrame:
    """Events one of whose /-separated tags is key."""
    return events.where(F.array_contains(F.split("description", "/"), key))
