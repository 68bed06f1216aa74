"""Gait and cue cycles: pairing, epochs, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import common_span
from .events import base_label, step_length_tag


def shift_to(events: DataFrame, starts: DataFrame, *, key: str, frm: str, to: str) -> DataFrame:
    """Onsets of events moved from one recording's clock to another's: starts (key, frm, to) holds both start times in seconds."""
    return events.join(starts.select(key, frm, to), key).withColumn("onset", F.col("onset") + (F.col(frm) - F.col(to))).drop(frm, to)


def pair_cycles(events: DataFrame, *, keys: list[str], tie: str, min_dur: float = 0.6, max_dur: float = 1.8, values: tuple[str, ...] = ()) -> DataFrame:
    """onset, duration, right_onset (and left_ and right_ values) of left-right-left cycles among events (onset, kind L or R).

    Other kinds are ignored. Equal onsets are taken in the order of tie.
    """
    order = Window.partitionBy(*keys).orderBy("onset", tie)
    e = events.where(F.col("kind").isin("L", "R"))
    e = e.withColumns({"_next": F.lead("kind").over(order), "right_onset": F.lead("onset").over(order)} | {f"right_{v}": F.lead(v).over(order) for v in values})
    left = e.where("kind = 'L'").withColumn("_cycle", F.lead("onset").over(order) - F.col("onset"))
    named = [F.col(v).alias(f"left_{v}") for v in values] + [F.col(f"right_{v}") for v in values]
    return left.where((F.col("_next") == "R") & F.col("_cycle").between(min_dur, max_dur)).select(*keys, "onset", F.col("_cycle").alias("duration"), "right_onset", *named)


def epoch_bounds(cycles: DataFrame, recordings: DataFrame, *, key: str, rate: float, pad_s: float = 0.5) -> DataFrame:
    """Cycles whose padded epoch lies in their recording (key, first_time, n_times), with sample indices in the epoch (C11)."""
    c = cycles.join(recordings.select(key, "first_time", "n_times"), key)
    c = c.withColumn("tmin", F.col("onset") - F.col("first_time") - pad_s).withColumn("tmax", F.col("onset") - F.col("first_time") + F.col("duration") + pad_s)
    c = c.where((F.col("tmin") >= 0) & (F.col("tmax") <= (F.col("n_times") - 1) / rate))
    s0, s1, pad = F.rint(F.col("tmin") * rate).cast("long"), F.rint(F.col("tmax") * rate).cast("long"), round(pad_s * rate)
    c = c.withColumn("s0", s0).withColumn("s1", s1).withColumn("n_samples", F.col("s1") - F.col("s0"))
    c = c.withColumn("cycle_start_idx", F.lit(pad).cast("long")).withColumn("cycle_end_idx", F.col("n_samples") - pad)
    if "right_onset" in cycles.columns:
        c = c.withColumn("cycle_mid_idx", pad + F.rint((F.col("right_onset") - F.col("onset")) * rate).cast("long"))
    return c.drop("first_time", "n_times")


def cut_by_interval(samples: DataFrame, spans: DataFrame, *, keys: list[str], order: str = "sample_idx", start: str = "s0", end: str = "s1", bucket: int = 256) -> DataFrame:
    """Rows of samples in each span [start, end) of their recording, with the span's columns.

    Spans are dealt to the index buckets they touch, so this is an equality join on recording and bucket.
    """
    touched = F.sequence(F.floor(F.col(start) / bucket), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / bucket))
    s = spans.withColumn("_bucket", F.explode(touched))
    x = samples.withColumn("_bucket", F.floor(F.col(order) / bucket))
    return x.join(s, [*keys, "_bucket"]).where((F.col(order) >= F.col(start)) & (F.col(order) < F.col(end))).drop("_bucket")


def _dyadic(lo: Column, end: Column) -> Column:
    """The largest aligned blocks of 2^level units, at most two of a level, that make up the units [lo, end): an array of (level, block)."""

    def blocks(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        first, stop = F.ceil(lo / size), F.floor(end / size)
        at = lambda b: F.struct(level.cast("int").alias("_level"), b.cast("long").alias("_block"))
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        return F.array_compact(F.array(F.when((first < stop) & odd(first), at(first)), F.when((first < stop) & odd(stop), at(stop - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - lo, F.lit(1)).cast("double"))).cast("int")), blocks))


def in_spans(points: DataFrame, spans: DataFrame, *, keys: list[str], at: str, start: str, end: str, unit: float) -> DataFrame:
    """Rows of points in each span [start, end) of their keys, with the span's columns, whatever the spans' lengths.

    Spans of up to four units of time are dealt to the units they touch, longer ones to blocks of 2, 4, 8 ... units, about two of each size; a point
    is sent to the block of each size that is in use around it. So a span of a million units is 40 rows and not a million.
    """
    lo, stop = F.floor(F.col(start) / unit), F.floor(F.col(end) / unit) + 1
    few = F.transform(F.sequence(lo, stop - 1), lambda b: F.struct(F.lit(0).alias("_level"), b.cast("long").alias("_block")))
    dealt = spans.where(F.col(end) > F.col(start)).withColumn("_at", F.explode(F.when(stop - lo <= 4, few).otherwise(_dyadic(lo, stop)))).select(*spans.columns, "_at.*")
    levels = dealt.agg(F.collect_set("_level").alias("levels")).scalar()
    block = lambda level: F.floor(F.floor(F.col(at) / unit) / F.pow(F.lit(2.0), level)).cast("long")
    sent = points.withColumn("_level", F.explode(levels)).withColumn("_block", block(F.col("_level")))
    return sent.join(dealt, [*keys, "_level", "_block"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_block")


def cue_cycles(periods: DataFrame, *, length_s: float) -> DataFrame:
    """The floor((t1 - t0) / length) cycles of each period (t0, t1): cycle (from 0), onset, duration."""
    n = F.floor((F.col("t1") - F.col("t0")) / length_s)
    long_enough = periods.withColumn("_n", n).where("_n >= 1")
    return long_enough.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("onset", F.col("t0") + F.col("cycle") * length_s).withColumn("duration", F.lit(float(length_s))).drop("_n")


def annotate_cue_cycles(periods: DataFrame, recordings: DataFrame, samples: DataFrame, *, key: str, length_s: float, rate: float, pad_s: float = 0.5, order: str = "sample_idx") -> tuple[DataFrame, DataFrame]:
    """Padded epochs in long rows and the table of cue cycles whose padded epoch lies in their recording.

    periods: key, t0, t1; period_idx counts them by (t0, t1) from 0, cycle the cycles of one.
    """
    numbered = periods.withColumn("period_idx", F.row_number().over(Window.partitionBy(key).orderBy("t0", "t1")) - 1)
    cycles = epoch_bounds(cue_cycles(numbered, length_s=length_s), recordings, key=key, rate=rate, pad_s=pad_s)
    table = cycles.select(key, "period_idx", "cycle", "onset", "duration", "s0", "s1", "n_samples", "cycle_start_idx", "cycle_end_idx")
    return epoch_samples(samples, table.select(key, "period_idx", "cycle", "s0", "s1"), keys=[key], order=order), table


def epoch_samples(samples: DataFrame, epochs: DataFrame, *, keys: list[str], order: str = "sample_idx") -> DataFrame:
    """Samples of each epoch [s0, s1), with their place in it as epoch_idx."""
    return cut_by_interval(samples, epochs, keys=keys, order=order).withColumn("epoch_idx", F.col(order) - F.col("s0")).drop("s0", "s1", order)


def cycle_table(cycles: DataFrame, *, keys: list[str], rate: float) -> DataFrame:
    """The seven columns of each cycle; the right onset comes from the sample indices (C14)."""
    right = F.col("onset") + (F.col("cycle_mid_idx") - F.col("cycle_start_idx")) / rate
    values = [F.col(f"{side}_{v}") for v in ("step_dur_s", "step_length_m") for side in ("left", "right")]
    return cycles.select(*keys, F.col("onset").alias("cycle_onset_s"), F.col("duration").alias("cycle_dur_s"), right.alias("right_onset_s"), *values)


def annotate_gait_cycles(annotations: DataFrame, recordings: DataFrame, samples: DataFrame, *, session: str, rate: float, annot_type: str = "lr_step", min_dur: float = 0.6, max_dur: float = 1.8, pad_s: float = 0.5, order: str = "sample_idx") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gait cycles of motion annotations as padded epochs of the samples of another recording of the session.

    annotations: session, onset, duration, description, on the motion recording's clock. recordings: session, role (motion or
    neural), meas_date (seconds), first_time, n_times, rate. samples: session, order and the neural channels' columns.
    Sessions whose recordings don't overlap (A6) have no cycles. Gives the epochs in long rows (with cycle_id and epoch_idx), the
    cycles (with cycle_id, epoch bounds, and durations and lengths of both steps), and counts: overlap, n_candidates, n_kept.
    """
    r = recordings.withColumns({"start": F.col("meas_date") + F.col("first_time"), "length": (F.col("n_times") - 1) / F.col("rate")})
    spans = common_span(r, session=session).select(session, "overlap")
    clocks = r.groupBy(session).agg(*[F.max(F.when(F.col("role") == x, F.col("meas_date"))).alias(x) for x in ("motion", "neural")])
    neural = r.where("role = 'neural'").select(session, "first_time", "n_times")

    steps = annotations.join(spans.where("overlap").select(session), session)
    steps = shift_to(steps, clocks, key=session, frm="motion", to="neural")
    label = base_label(F.col("description"))
    kind = F.when(label == f"{annot_type}_left", "L").when(label == f"{annot_type}_right", "R")
    steps = steps.select(session, "onset", kind.alias("kind"), F.col("duration").alias("step_dur_s"), step_length_tag(F.col("description")).alias("step_length_m"), "description")
    pairs = pair_cycles(steps, keys=[session], tie="description", min_dur=min_dur, max_dur=max_dur, values=("step_dur_s", "step_length_m"))
    kept = epoch_bounds(pairs, neural, key=session, rate=rate, pad_s=pad_s)
    kept = kept.withColumn("cycle_id", F.row_number().over(Window.partitionBy(session).orderBy("onset")) - 1)
    count = lambda df, name: df.groupBy(session).agg(F.count("*").alias(name))
    counts = spans.join(count(pairs, "n_candidates"), session, "left").join(count(kept, "n_kept"), session, "left").fillna(0, ["n_candidates", "n_kept"])
    return epoch_samples(samples, kept.select(session, "cycle_id", "s0", "s1"), keys=[session], order=order), kept, counts


def paint(samples: DataFrame, events: DataFrame, *, key: str, rate: float, order: str = "sample_idx", default: str = "reset") -> DataFrame:
    """samples with the label of the last event (by onset, then label) that covers each of them."""
    spans = events.select(key, F.greatest(F.rint(F.col("onset") * rate), F.lit(0.0)).cast("long").alias("s0"), F.rint((F.col("onset") + F.col("duration")) * rate).cast("long").alias("s1"), F.struct("onset", "description").alias("_event")).where("s1 > s0")
    covered = cut_by_interval(samples.select(key, order), spans, keys=[key], order=order).groupBy(key, order).agg(F.max("_event")["description"].alias("label"))
    return samples.join(covered, [key, order], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def first_cycles(cycles: DataFrame, *, keys: list[str], order: str, n: int = 5) -> DataFrame:
    """The first n cycles of each recording (C17)."""
    return cycles.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def array_of(value: Column, order: Column) -> Column:
    """Aggregate: values by order as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
