"""Repeating artifacts: find them, average them to a template, match it along the signal, and take it out.

A channel of a recording is one grid (keys). Samples are worked on in chunks, and so are places (runs of samples below a threshold,
peaks, windows that overlap); what a piece of a channel hands on to the next is a small table, and only these are put in order by channel.
A job reads its samples once: pieces() stores them as arrays of chunks, on which all its steps work.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.kernels import DIRECT, block_convolve, snapped
from ..sources.tables import free_shuffles, stored
from .cycles import array_of, cut_by_interval
from .grid import chunk_arrays, from_arrays, in_chunks, packed_chunks

CHUNK = 8192


def _piece_rows(rows: DataFrame, keys: list[str], by: list[str], run, columns: str) -> DataFrame:
    """run over batches of rows in order of keys, _chunk and by; pieces (keys, _chunk) are dealt to tasks."""
    kinds = dict(rows.dtypes)
    ordered = rows.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", *by)
    return ordered.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {columns}")


def _folded(tables: DataFrame, keys: list[str], start, step) -> DataFrame:
    """keys, _chunk and _state (bytes) before each piece of tables (keys, _chunk, _table): start before the first and after a gap, else step(state, table) of the one before.

    This reads one table a piece in the order of a channel, and holds one state.
    """
    kinds = dict(tables.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, after = None, start
        for pdf in batches:
            states = []
            for key, chunk, table in zip(pdf[keys].itertuples(index=False, name=None), pdf["_chunk"].tolist(), pdf["_table"], strict=True):
                state = after if at == (key, chunk - 1) else start
                states.append(state)
                at, after = (key, chunk), step(state, table)
            yield pdf[[*keys, "_chunk"]].assign(_state=states)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _chunk long, _state binary"
    return tables.repartition(*keys).sortWithinPartitions(*keys, "_chunk").mapInPandas(run, schema)


def spaced(places: DataFrame, *, keys: list[str], advance: int, start: str = "at", end: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """keys, at: of places (runs start to end, or single ones) the first, and then each that is at least advance (>= 1) after the last taken.

    Runs are disjoint. A run takes its first place that is far enough, and every advance-th from there. Channels are cut into
    pieces of at least 16 times advance: each piece gives a table from the first index that is open to it to the first one that is open to the
    next piece; only these tables are followed in a channel's order, and then each piece takes its places.
    """
    step = max(1, advance)
    size = max(chunk, 16 * step)
    whole = places.select(*keys, F.col(start).cast("long").alias("_from"), F.col(end or start).cast("long").alias("_to"))
    cut = whole.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(F.col("_to") / size))))
    first = F.col("_chunk") * size
    rows = stored(cut.select(*keys, "_chunk", (F.greatest("_from", first) - first).alias("_a"), (F.least("_to", first + size - 1) - first).alias("_b")))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, None
        for pdf in [*batches, None]:
            done = []
            for key, a, b in zip(pdf[[*keys, "_chunk"]].itertuples(index=False, name=None), pdf["_a"].tolist(), pdf["_b"].tolist(), strict=True) if pdf is not None else [(None, 0, 0)]:
                if key != now:
                    if now is not None:
                        done.append((*now, np.maximum(free - size, 0).astype("<i4").tobytes()))
                    now, free = key, np.arange(step)
                at = np.maximum(free, a)
                free = np.where(at <= b, at + (b - at) // step * step + step, free)
            yield pd.DataFrame(done, columns=[*keys, "_chunk", "_table"])

    def follow(state: bytes, table: bytes) -> bytes:
        at = int(np.frombuffer(state, "<i4")[0])
        return table[4 * at : 4 * at + 4]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, 0
        for pdf in batches:
            picked, at = [], []
            for i, (key, a, b, state) in enumerate(zip(pdf[[*keys, "_chunk"]].itertuples(index=False, name=None), pdf["_a"].tolist(), pdf["_b"].tolist(), pdf["_state"], strict=True)):
                if key != now:
                    now, free = key, int(np.frombuffer(state, "<i4")[0])
                a = max(a, free)
                if a <= b:
                    taken = range(a, b + 1, step)
                    picked += [i] * len(taken)
                    at += [key[-1] * size + x for x in taken]
                    free = taken[-1] + step
            yield pdf.iloc[picked][keys].assign(at=np.array(at, np.int64))

    states = _folded(_piece_rows(rows, keys, ["_a"], tables, "_chunk long, _table binary"), keys, np.zeros(1, "<i4").tobytes(), follow)
    return _piece_rows(rows.join(states, [*keys, "_chunk"]), keys, ["_a"], take, "at long")


def pieces(samples: DataFrame, *, keys: list[str], value: str, order: str, chunk: int, halo: int) -> tuple[DataFrame, DataFrame]:
    """keys, chunk, skip, own, _v of packed_chunks(), stored; and of each channel keys, _sd, _mean, _n."""
    packed = packed_chunks(samples, keys=keys, order=order, columns=[value], chunk=chunk, halo=halo)
    arrays = stored(packed.withColumnRenamed(value, "_v"))
    free_shuffles(samples.sparkSession)
    own = arrays.select(*keys, (F.col("chunk") * chunk + F.col("own")).alias("_end"), F.explode(F.slice("_v", F.col("skip") + 1, F.col("own"))).alias("_x"))
    return arrays, stored(own.groupBy(*keys).agg(F.stddev_pop("_x").alias("_sd"), F.avg("_x").alias("_mean"), F.max("_end").alias("_n")))


def _cut(arrays: DataFrame, *, keys: list[str], columns: list[str], chunk: int, width: int, starts: str = "_w") -> DataFrame:
    """keys, k and columns (arrays of pieces, with their halo) of the windows that begin at a piece's starts: k from 0 to width - 1."""
    first = F.col("chunk") * chunk - F.col("skip")
    cell = lambda s, k: F.struct(k.cast("long").alias("k"), *[F.col(c)[(s - first + k).cast("int")].alias(c) for c in columns])
    cells = F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: cell(s, k)))
    return arrays.select(*keys, F.inline(F.flatten(cells)))


def _dealt(at: DataFrame, s0: Column, keys: list[str], chunk: int) -> DataFrame:
    """keys, chunk, _w: the starts of the windows around the places in each chunk."""
    return at.groupBy(*keys, F.floor(F.col("at") / chunk).alias("chunk")).agg(F.collect_list(s0.cast("long")).alias("_w"))


def discover(samples: DataFrame, *, keys: list[str], value: str, pre: int, post: int, advance: int, sd: float = 5.0, order: str = "sample_idx", chunk: int = CHUNK) -> DataFrame:
    """keys, at: samples below -sd deviations, away from the ends, spaced by advance (G1). Neighbouring ones are one run until they are spaced."""
    s = samples.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"), (F.max(order) + 1).alias("_n"))
    return _low(samples.select(*keys, order, value).join(s, keys), keys=keys, value=value, pre=pre, post=post, advance=advance, sd=sd, order=order, chunk=chunk)


def _low(samples: DataFrame, *, keys: list[str], value: str, pre: int, post: int, advance: int, sd: float, order: str, chunk: int) -> DataFrame:
    """discover() of samples with their channel's _sd and _n."""
    low = (F.col(value) < -sd * F.col("_sd")) & (F.col(order) >= pre) & (F.col(order) < F.col("_n") - post)
    rows = samples.where(low).select(*keys, order)
    base = Window.partitionBy(*keys, F.floor(F.col(order) / chunk)).orderBy(order)
    begun = F.when(F.col(order) - F.lag(order).over(base) == 1, 0).otherwise(1)
    runs = rows.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_new", begun).withColumn("_run", F.sum("_new").over(base))
    runs = runs.groupBy(*keys, "_chunk", "_run").agg(F.min(order).alias("_from"), F.max(order).alias("_to"))
    return spaced(runs, keys=keys, advance=advance, start="_from", end="_to", chunk=chunk)


def template(samples: DataFrame, hits: DataFrame, *, keys: list[str], value: str, pre: int, post: int, order: str = "sample_idx") -> DataFrame:
    """keys, k, t: the mean of [at - pre, at + post) of all hits by offset k (from 0), less its own mean."""
    spans = hits.select(*keys, (F.col("at") - pre).alias("s0"), (F.col("at") + post).alias("s1"))
    return _shape(cut_by_interval(samples.select(*keys, order, value), spans, keys=keys, order=order).select(*keys, (F.col(order) - F.col("s0")).alias("k"), value), keys, value)


def _shape(cut: DataFrame, keys: list[str], value: str) -> DataFrame:
    """template() of the windows' rows: keys, k, value."""
    mean = cut.groupBy(*keys, "k").agg(F.avg(value).alias("_m"))
    level = mean.groupBy(*keys).agg(F.avg("_m").alias("_l"))
    return mean.join(level, keys).select(*keys, "k", (F.col("_m") - F.col("_l")).alias("t"))


def _template_arrays(templates: DataFrame, keys: list[str]) -> DataFrame:
    return templates.groupBy(*keys).agg(array_of(F.col("t"), F.col("k")).alias("_t"))


def _correlated(values: np.ndarray, mean: float, pattern: np.ndarray, width: int) -> np.ndarray:
    """The cross-correlation (G3) at each of an array's values, with 0 beyond its ends."""
    x, t = np.asarray(values, float) - mean, np.asarray(pattern, float)
    xc = block_convolve(np.concatenate([np.zeros(width), x, np.zeros(width)]), t[::-1])[2 * width - width // 2 - 1 :][: len(x)]
    return xc if width <= DIRECT else snapped(xc, float(np.abs(t).sum() * np.abs(x).max(initial=0)))


def cross_correlation(samples: DataFrame, templates: DataFrame, *, keys: list[str], value: str, width: int, order: str = "sample_idx", chunk: int = CHUNK) -> DataFrame:
    """keys, order, xc: sum over k of (x[p - width // 2 + k] - mean) * t[k], samples outside the grid as 0 (G3). A template is sent to each chunk of its channel."""
    mean = samples.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    chunk = max(chunk, width)
    arrays = chunk_arrays(samples, keys=keys, order=order, columns=[value], chunk=chunk, halo=width).join(mean, keys).join(_template_arrays(templates, keys), keys)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for values, means, patterns, skips, owns in batches:
            out = []
            for v, m, t, skip, own in zip(values, means, patterns, skips, owns, strict=True):
                out.append(_correlated(v, m, t, width)[skip : skip + own])
            yield pd.Series(out)

    done = arrays.select(*keys, "chunk", run(value, "_mean", "_t", "skip", "own").alias("xc"))
    return from_arrays(done, keys=keys, order=order, column="xc", chunk=chunk)


def peaks(xc: DataFrame, heights: DataFrame, *, keys: list[str], order: str = "sample_idx", chunk: int = CHUNK) -> DataFrame:
    """keys, at: local maxima of at least the height of their channel (heights: keys, height); the middle of flat tops; ends are no peaks.

    Neighbours are compared on chunks. A top of one sample is settled there; of longer ones the two edges are matched by channel.
    """

    def edges(d: DataFrame, k: list[str]) -> DataFrame:
        base = Window.partitionBy(*k).orderBy(order)
        return d.withColumns({"_up": F.lag("xc").over(base) < F.col("xc"), "_same": F.lag("xc").over(base) == F.col("xc"), "_down": F.lead("xc").over(base) < F.col("xc"), "_on": F.lead("xc").over(base) == F.col("xc")})

    marked = in_chunks(xc.select(*keys, order, "xc"), edges, keys=keys, order=order, chunk=chunk, halo=1)
    ends = marked.where((F.col("_up") & (F.col("_down") | F.col("_on"))) | (F.col("_same") & F.col("_down"))).join(heights, keys).where(F.col("xc") >= F.col("height"))
    return _middles(ends, keys, order)


def _middles(ends: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, at of tops whose first and last samples are given with xc, _up, _on, _same and _down."""
    base = Window.partitionBy(*keys).orderBy(order)
    # of a flat top only its first and last sample are left here: the last one closes the first, if that comes right before it
    closed = ends.withColumns({"_close": F.lead("_same").over(base) & (F.lead("xc").over(base) == F.col("xc")), "_last": F.lead(order).over(base)})
    top = F.when(F.col("_up") & F.col("_down"), F.col(order)).when(F.col("_up") & F.col("_on") & F.col("_close"), F.floor((F.col(order) + F.col("_last")) / 2))
    return closed.select(*keys, top.cast("long").alias("at")).where("at IS NOT NULL")


def _peaks(arrays: DataFrame, fitted: DataFrame, *, keys: list[str], width: int, order: str, chunk: int) -> DataFrame:
    """peaks() of at least half the template's energy, of pieces and their channels' _t, _mean and _norm.

    A piece gives the samples that rise from one neighbour and don't rise to the other, and its first and last one, whose other neighbours the next pieces give.
    """
    kinds = dict(arrays.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, parts = [], []
            for v, mean, t, norm, c, skip, own in zip(pdf["_v"], pdf["_mean"], pdf["_t"], pdf["_norm"], pdf["chunk"], pdf["skip"], pdf["own"], strict=True):
                xc = _correlated(v, mean, t, width)[skip : skip + own]
                before, after, high = np.r_[np.nan, xc[:-1]], np.r_[xc[1:], np.nan], xc >= 0.5 * norm
                keep = high & (((before < xc) & (after <= xc)) | ((before == xc) & (after < xc)))
                keep[[0, -1]] = True
                at = np.flatnonzero(keep)
                rows.append(len(at))
                parts.append((c * chunk + at, xc[at], before[at], after[at], high[at]))
            if rows:
                columns = dict(zip((order, "xc", "_before", "_after", "_high"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
                yield pdf[keys].iloc[np.repeat(np.arange(len(rows)), rows)].reset_index(drop=True).assign(**columns)

    found = arrays.join(fitted.select(*keys, "_t", "_mean", "_norm"), keys).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{order}` long, xc double, _before double, _after double, _high boolean")
    base, here = Window.partitionBy(*keys).orderBy(order), F.col(order)
    before = F.coalesce("_before", F.when(F.lag(order).over(base) == here - 1, F.lag("xc").over(base)))
    after = F.coalesce("_after", F.when(F.lead(order).over(base) == here + 1, F.lead("xc").over(base)))
    near = found.withColumns({"_before": before, "_after": after})
    marked = near.select(*keys, order, "xc", "_high", *[c.alias(n) for n, c in {"_up": F.col("_before") < F.col("xc"), "_same": F.col("_before") == F.col("xc"), "_down": F.col("_after") < F.col("xc"), "_on": F.col("_after") == F.col("xc")}.items()])
    return _middles(marked.where("_high AND ((_up AND (_down OR _on)) OR (_same AND _down))"), keys, order)


def _inside(at: DataFrame, channels: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, at of places whose windows lie inside the grid (channels: keys, _n)."""
    s0 = F.col("at") - width // 2
    return at.join(channels.select(*keys, "_n"), keys).where((s0 >= 0) & (s0 + width <= F.col("_n"))).select(*keys, "at")


def _fitted(templates: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """channels that have a template, with it as _t and its energy _norm."""
    return _template_arrays(templates, keys).withColumn("_norm", F.aggregate("_t", F.lit(0.0), lambda s, t: s + t * t)).join(channels, keys)


def coefficients(windows: DataFrame, templates: DataFrame, *, keys: list[str], width: int, chunk: int = CHUNK) -> DataFrame:
    """keys, s0 and _scale of windows (keys, s0, _r), which are handled in order: _r is a window's fit to the signal as it was, _scale its fit to what earlier windows left.

    Windows are width long and the template is taken out scale times, so a window s after another one changes its fit by g(s) times that
    one's scale, g being the template's autocorrelation over its energy: scale = r - sum of g(s) * scale over the windows that reach into this one.
    Channels are cut into pieces of windows. Each piece gives its last windows' scales as a linear function of those of the piece before that
    reach into it; these functions are followed in a channel's order; then each piece knows what comes in, and gives its scales.
    """
    size = max(chunk, 2 * width)
    own = F.floor(F.col("s0") / size)
    reaches = F.col("s0") > (own + 1) * size - width
    rows = windows.select(*keys, "s0", "_r").withColumn("_chunk", F.explode(F.array_compact(F.array(own, F.when(reaches, own + 1)))))
    rows = stored(rows)
    norm = lambda t: float(t @ t)

    @F.pandas_udf("binary")
    def autocorrelation(patterns: pd.Series) -> pd.Series:
        arrays = [np.asarray(t, float) for t in patterns]
        return pd.Series([(np.array([t[: len(t) - s] @ t[s:] for s in range(len(t))]) / (norm(t) or 1.0)).tobytes() for t in arrays])

    # one row before a piece's windows holds g; pieces without windows of their own are left out
    pieces = rows.where(F.floor(F.col("s0") / size) == F.col("_chunk")).select(*keys, "_chunk").distinct()
    heads = pieces.join(_template_arrays(templates, keys).select(*keys, autocorrelation("_t").alias("_g")), keys)

    def solved(batches: Iterator[pd.DataFrame], known: bool) -> Iterator[tuple]:
        """For each piece: its key, starts and (windows x 1 + those that reach into it) scales; known: the last ones are given by the head's state."""
        now: tuple | None = None
        g = state = np.zeros(0)
        starts: list[int] = []
        rs: list[float] = []

        def piece() -> tuple:
            first = now[-1] * size
            s = np.array(starts, np.int64)
            before = int((s < first).sum())
            out = np.zeros((len(s), 1 if known else 1 + before))
            if known:
                out[:before, 0] = state
            else:
                out[np.arange(before), 1 + np.arange(before)] = 1
            low = np.searchsorted(s, s - width, side="right")
            for i in range(before, len(s)):
                a = low[i]
                out[i] = -(g[s[i] - s[a:i]] @ out[a:i])
                out[i, 0] += rs[i]
            return now, s[before:], out[before:]

        for pdf in batches:
            for key, kind, s0, r, head, given in zip(pdf[[*keys, "_chunk"]].itertuples(index=False, name=None), pdf["_kind"].tolist(), pdf["s0"].tolist(), pdf["_r"].tolist(), pdf["_g"], pdf["_state"], strict=True):
                if kind == 0:
                    if now is not None:
                        yield piece()
                    now, g, starts, rs = key, np.frombuffer(head), [], []
                    state = np.frombuffer(given) if given is not None else np.zeros(0)
                elif key == now:
                    starts.append(int(s0))
                    rs.append(r)
        if now is not None:
            yield piece()

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, s, out in solved(batches, known=False):
            last = out[s > (key[-1] + 1) * size - width]
            yield pd.DataFrame([(*key, np.r_[last.shape[1], last.ravel()].tobytes())], columns=[*keys, "_chunk", "_table"])

    def follow(state: bytes, table: bytes) -> bytes:
        flat = np.frombuffer(table)
        m = flat[1:].reshape(-1, int(flat[0]))
        return (m @ np.r_[1.0, np.frombuffer(state)]).tobytes()

    def scales(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, s, out in solved(batches, known=True):
            part = pd.DataFrame([key[:-1]] * len(s), columns=keys)
            yield part.assign(s0=s, _scale=out[:, 0])

    none = lambda kind: F.lit(None).cast(kind)
    own_rows = rows.select(*keys, "_chunk", F.lit(1).alias("_kind"), "s0", "_r", none("binary").alias("_g"), none("binary").alias("_state"))
    with_heads = lambda h: own_rows.unionByName(h.select(*keys, "_chunk", F.lit(0).alias("_kind"), none("long").alias("s0"), none("double").alias("_r"), "_g", "_state"))
    tables = _piece_rows(with_heads(heads.withColumn("_state", none("binary"))), keys, ["_kind", "s0"], maps, "_chunk long, _table binary")
    states = _folded(tables, keys, b"", follow)
    return _piece_rows(with_heads(heads.join(states, [*keys, "_chunk"])), keys, ["_kind", "s0"], scales, "s0 long, _scale double")


def _scales(arrays: DataFrame, fitted: DataFrame, at: DataFrame, *, keys: list[str], width: int, chunk: int, advance: int = 0) -> DataFrame:
    """coefficients() of the windows around places, which are at least advance apart; the fit of a window to the signal as it was is its product with the template."""

    @F.pandas_udf("array<double>")
    def fit(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for values, firsts, starts, means, patterns, norms in batches:
            out = []
            for v, first, s, m, t, norm in zip(values, firsts, starts, means, patterns, norms, strict=True):
                own = np.lib.stride_tricks.sliding_window_view(np.asarray(v, float) - m, width)[np.asarray(s, np.int64) - first]
                out.append(own @ np.asarray(t, float) / norm if norm > 0 else np.zeros(len(own)))
            yield pd.Series(out)

    dealt = _dealt(_inside(at, fitted, keys, width), F.col("at") - width // 2, keys, chunk).join(fitted.select(*keys, "_t", "_mean", "_norm"), keys)
    fits = arrays.join(dealt, [*keys, "chunk"]).withColumn("_r", fit("_v", F.col("chunk") * chunk - F.col("skip"), "_w", "_mean", "_t", "_norm"))
    fits = fits.select(*keys, F.inline(F.arrays_zip("_w", "_r"))).withColumnRenamed("_w", "s0")
    if advance >= width:  # no window reaches into another one
        return fits.withColumnRenamed("_r", "_scale")
    return coefficients(fits, fitted.select(*keys, F.posexplode("_t").alias("k", "t")), keys=keys, width=width, chunk=chunk)


def _lists(scales: DataFrame, fitted: DataFrame, *, keys: list[str], width: int, chunk: int, halo: int) -> DataFrame:
    """keys, chunk, _s0, _scale, _t: the windows that reach into each chunk or its halo."""
    touched = F.explode(F.sequence(F.floor((F.col("s0") - halo) / chunk), F.floor((F.col("s0") + width - 1 + halo) / chunk)))
    lists = scales.withColumn("chunk", touched).groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("s0", "_scale"))).alias("_l"))
    return lists.select(*keys, "chunk", F.col("_l.s0").alias("_s0"), F.col("_l._scale").alias("_scale")).join(fitted.select(*keys, "_t"), keys)


@F.pandas_udf(ArrayType(DoubleType()))
def _away(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """What windows (starts, scales) take out of the samples [first, first + length)."""
    for firsts, lengths, starts, scales, patterns in batches:
        out = []
        for first, length, s, a, t in zip(firsts, lengths, starts, scales, patterns, strict=True):
            reach = len(t) - 1
            hits = np.zeros(length + reach)
            place = np.asarray(s, np.int64) - first + reach
            near = (place >= 0) & (place < len(hits))
            hits[place[near]] = np.asarray(a, float)[near]
            out.append(block_convolve(hits, np.asarray(t, float))[reach : reach + length])
        yield pd.Series(out)


def subtract(samples: DataFrame, at: DataFrame, templates: DataFrame, *, keys: list[str], value: str, width: int, order: str = "sample_idx", chunk: int = CHUNK) -> DataFrame:
    """samples with clean: at each place (from at - width // 2, inside the grid) the template is fitted by least squares to what earlier places left, and taken out.

    A template has no mean. The fit of a window to the signal as it was is its cross-correlation with the template; how windows that overlap
    change each other's fits follows from the template alone, coefficients(). What is taken out is summed on chunks of samples. So
    overlapping windows may follow one another along a whole recording, and no task gets more than a chunk.
    """
    size = max(chunk, width)
    arrays, channels = pieces(samples, keys=keys, value=value, order=order, chunk=size, halo=width)
    fitted = _fitted(templates, channels, keys)
    return _without(samples, _scales(arrays, fitted, at, keys=keys, width=width, chunk=size), fitted, keys=keys, value=value, width=width, order=order, chunk=size)


def _without(samples: DataFrame, scales: DataFrame, fitted: DataFrame, *, keys: list[str], value: str, width: int, order: str, chunk: int) -> DataFrame:
    """samples with clean: less what the windows take out."""
    lists = _lists(scales, fitted, keys=keys, width=width, chunk=chunk, halo=0)
    away = _away(F.col("chunk") * chunk, F.lit(chunk), "_s0", "_scale", "_t")
    gone = from_arrays(lists.select(*keys, "chunk", away.alias("_away")), keys=keys, order=order, column="_away", chunk=chunk)
    return samples.join(gone, [*keys, order], "left").withColumn("clean", F.col(value).cast("double") - F.coalesce("_away", F.lit(0.0))).drop("_away")


def quality(arrays: DataFrame, scales: DataFrame, fitted: DataFrame, *, keys: list[str], width: int, chunk: int, halo: int) -> DataFrame:
    """keys, k, n and of the samples before and after mean and sem (n - 1) of the windows (scales: keys, s0, _scale), by offset (G7); arrays are pieces."""
    joined = arrays.join(_lists(scales, fitted, keys=keys, width=width, chunk=chunk, halo=halo), [*keys, "chunk"])
    away = _away(F.col("chunk") * chunk - F.col("skip"), F.size("_v"), "_s0", "_scale", "_t")
    own = F.filter("_s0", lambda s: F.floor((s + width // 2) / chunk) == F.col("chunk"))
    both = joined.select(*keys, "chunk", "skip", F.col("_v").alias("before"), own.alias("_w"), away.alias("_away"))
    cut = _cut(both, keys=keys, columns=["before", "_away"], chunk=chunk, width=width).withColumn("after", F.col("before") - F.col("_away"))
    stats = [f for v in ("before", "after") for f in (F.avg(v).alias(f"{v}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{v}_sem"))]
    return cut.groupBy(*keys, "k").agg(F.count("*").alias("n"), *stats)


def matched(samples: DataFrame, templates: DataFrame, *, keys: list[str], value: str, width: int, advance: int, order: str = "sample_idx", chunk: int = CHUNK) -> DataFrame:
    """keys, at: peaks of the cross-correlation above half the template's energy, advance apart (G3, G4, G5); 0 keeps all."""
    size = max(chunk, width)
    arrays, channels = pieces(samples, keys=keys, value=value, order=order, chunk=size, halo=width)
    return _matched(arrays, _fitted(templates, channels, keys), keys=keys, width=width, advance=advance, order=order, chunk=size)


def _matched(arrays: DataFrame, fitted: DataFrame, *, keys: list[str], width: int, advance: int, order: str, chunk: int) -> DataFrame:
    found = _peaks(arrays, fitted, keys=keys, width=width, order=order, chunk=chunk)
    return spaced(found, keys=keys, advance=advance, chunk=chunk) if advance > 1 else found


class _Job(NamedTuple):
    """What the steps of the whole job have found; widths and distances in samples."""

    arrays: DataFrame
    channels: DataFrame
    fitted: DataFrame
    hits: DataFrame
    at: DataFrame
    width: int
    chunk: int
    halo: int
    advance: int


def _found(samples: DataFrame, *, keys: list[str], value: str, rate: float, window: tuple[float, float], discover_advance_s: float, filter_advance_s: float, sd: float, order: str, chunk: int) -> _Job:
    """The job up to the places where the template is taken out. samples are read once; shuffle files of a step go when it is done."""
    pre, post = int(-window[0] * rate), int(window[1] * rate)
    width, advance, spark = pre + post, int(filter_advance_s * rate), samples.sparkSession
    halo = max(width, abs(pre), abs(post))
    size = max(chunk, halo)

    def done(df: DataFrame) -> DataFrame:
        out = stored(df)
        free_shuffles(spark)
        return out

    arrays, channels = pieces(samples, keys=keys, value=value, order=order, chunk=size, halo=halo)
    own = F.posexplode(F.slice("_v", F.col("skip") + 1, F.col("own"))).alias("_i", value)
    rows = arrays.join(channels, keys).select(*keys, "chunk", "_sd", "_n", own).withColumn(order, F.col("chunk") * size + F.col("_i"))
    hits = done(_low(rows, keys=keys, value=value, pre=pre, post=post, advance=int(discover_advance_s * rate), sd=sd, order=order, chunk=size))
    cut = _cut(arrays.join(_dealt(hits, F.col("at") - pre, keys, size), [*keys, "chunk"]), keys=keys, columns=["_v"], chunk=size, width=width)
    fitted = done(_fitted(_shape(cut, keys, "_v"), channels, keys))
    at = done(_matched(arrays, fitted, keys=keys, width=width, advance=advance, order=order, chunk=size))
    return _Job(arrays, channels, fitted, hits, at, width, size, halo, advance)


def _counts(job: _Job, keys: list[str]) -> DataFrame:
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    used = _inside(job.at, job.channels, keys, job.width)
    counts = job.channels.select(*keys).join(count(job.hits, "n_discovered"), keys, "left").join(count(used, "n_subtracted"), keys, "left")
    return counts.fillna(0, ["n_discovered", "n_subtracted"])


def count_artifacts(samples: DataFrame, *, keys: list[str], value: str, rate: float, window: tuple[float, float] = (-0.5, 1.5), discover_advance_s: float = 34.0, filter_advance_s: float = 0.0, sd: float = 5.0, order: str = "sample_idx", chunk: int = CHUNK) -> DataFrame:
    """keys, n_discovered, n_subtracted of filter_artifact(), without taking anything out."""
    return _counts(_found(samples, keys=keys, value=value, rate=rate, window=window, discover_advance_s=discover_advance_s, filter_advance_s=filter_advance_s, sd=sd, order=order, chunk=chunk), keys)


def filter_artifact(samples: DataFrame, *, keys: list[str], value: str, rate: float, window: tuple[float, float] = (-0.5, 1.5), discover_advance_s: float = 34.0, filter_advance_s: float = 0.0, sd: float = 5.0, order: str = "sample_idx", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole job on the given channels: samples with clean; keys, k and before/after mean and sem; keys, n_discovered, n_subtracted.

    Channels without a discovered artifact come back as they are. The samples' arrays, places and templates are stored.
    """
    job = _found(samples, keys=keys, value=value, rate=rate, window=window, discover_advance_s=discover_advance_s, filter_advance_s=filter_advance_s, sd=sd, order=order, chunk=chunk)
    scales = _scales(job.arrays, job.fitted, job.at, keys=keys, width=job.width, chunk=job.chunk, advance=job.advance)
    clean = _without(samples, scales, job.fitted, keys=keys, value=value, width=job.width, order=order, chunk=job.chunk)
    return clean, quality(job.arrays, scales, job.fitted, keys=keys, width=job.width, chunk=job.chunk, halo=job.halo), _counts(job, keys)
