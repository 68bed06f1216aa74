"""Windows over gapless sample grids.

Every function takes the keys whose rows form one grid (a recording, or a recording's chunk) and the order column. A long
recording is cut by with_halo() into chunks that carry some neighbours along; functions then run on keys + ["chunk"], all on
one shuffle, and drop_halo() keeps each chunk's own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames wider than this are differences of running sums.
WIDE = 32


def with_halo(df: DataFrame, *, order: str, chunk: int, halo: int) -> DataFrame:
    """Rows with their chunk (order div chunk), and copies for neighbouring chunks within halo rows; ValueError if halo > chunk, since only the next chunks are reached."""
    if halo > chunk:
        raise ValueError(f"a halo of {halo} rows doesn't fit in chunks of {chunk}")
    own = F.floor(F.col(order) / chunk)
    at = F.pmod(F.col(order), F.lit(chunk))
    to = F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= chunk - halo, own + 1)))
    out = df.withColumn("own_chunk", own).withColumn("chunk", F.explode(to))
    # a copy sent beyond the last row makes no rows of its own: drop_halo removes it
    return out


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("chunk = own_chunk").drop("chunk", "own_chunk")


def in_chunks(df: DataFrame, fn: Callable[[DataFrame, list[str]], DataFrame], *, keys: list[str], order: str, chunk: int, halo: int) -> DataFrame:
    """fn(rows, keys) run on chunks of each grid instead of on whole grids; what it gives for a row must follow from rows within halo of it."""
    return drop_halo(fn(with_halo(df, order=order, chunk=chunk, halo=halo), [*keys, "chunk"]))


def packed_chunks(df: DataFrame, *, keys: list[str], order: str, columns: list[str], chunk: int, halo: int) -> DataFrame:
    """A row for each chunk of a grid that starts at 0: keys, chunk, skip (samples of the halo before its own), own (its own samples) and an array of each column; one pass over df."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(c).cast("double").alias(c) for c in columns])))
    arrays = with_halo(df.select(*keys, order, *columns), order=order, chunk=chunk, halo=halo).groupBy(*keys, "chunk").agg(packed.alias("_p"), F.count_if(F.col("own_chunk") < F.col("chunk")).cast("int").alias("skip"), F.count_if(F.col("own_chunk") == F.col("chunk")).cast("int").alias("own"))
    return arrays.where("own > 0").select(*keys, "chunk", "skip", "own", *[F.col("_p")[c].alias(c) for c in columns])


def chunk_arrays(df: DataFrame, *, keys: list[str], order: str, columns: list[str], chunk: int, halo: int) -> DataFrame:
    """packed_chunks() with n, the grid's samples.

    Helpers then work on batches of such rows, whose size chunk + 2 * halo bounds, whatever the length of a recording.
    """
    size = df.groupBy(*keys).agg((F.max(order) + 1).alias("n"))
    return packed_chunks(df, keys=keys, order=order, columns=columns, chunk=chunk, halo=halo).join(size, keys).select(*keys, "chunk", "skip", "own", "n", *columns)


def from_arrays(df: DataFrame, *, keys: list[str], order: str, column: str, chunk: int) -> DataFrame:
    """keys, order and column of rows (keys, chunk, column: an array of the chunk's own samples)."""
    return df.select(*keys, "chunk", F.posexplode(column).alias("_at", column)).select(*keys, (F.col("chunk") * chunk + F.col("_at")).alias(order), column)


def grid_gaps(df: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    """Rows, first and last index of each grid, and whether none is missing or twice."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(order).alias("first_idx"), F.max(order).alias("last_idx"), F.count_distinct(order).alias("n_distinct"))
    return g.withColumn("gapless", (F.col("n_rows") == F.col("last_idx") - F.col("first_idx") + 1) & (F.col("n_rows") == F.col("n_distinct"))).drop("n_distinct")


def _frame(w: int) -> tuple[int, int]:
    return -(w // 2), (w - 1) // 2


def _frame_sum(value: Column, keys: list[str], order: str, w: int) -> Column:
    base = Window.partitionBy(*keys).orderBy(order)
    a, b = _frame(w)
    if w <= WIDE:
        return F.sum(value).over(base.rowsBetween(a, b))
    total = F.sum(value).over(base.rowsBetween(Window.unboundedPreceding, b))
    before = F.sum(value).over(base.rowsBetween(Window.unboundedPreceding, a - 1))
    return total - F.coalesce(before, F.lit(0.0))


def smooth_reflected(df: DataFrame, *, keys: list[str], order: str, columns: dict[str, str], w: int) -> DataFrame:
    """Moving averages of w samples whose ends are continued by odd reflection (B1); columns: output name to input.

    A grid of n rows that is shorter than half a window is reflected again and again: its continuation x(-i) = 2 x(0) - x(i), likewise at the last row,
    repeats every 2 (n - 1) rows, raised by 2 (x(n - 1) - x(0)). A single row is continued by itself.
    """
    half = w // 2
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = {"_first": F.first(order).over(whole), "_last": F.last(order).over(whole)}
    for i, c in enumerate(columns.values()):
        edges |= {f"_a{i}": F.first(c).over(whole), f"_b{i}": F.last(c).over(whole)}
    ends = df.withColumns(edges)  # one window for all
    o, first, last = F.col(order), F.col("_first"), F.col("_last")

    def put(at: Column, sign: int, side: str | None, turns: Column) -> Column:
        """The row's image at a place: itself, or mirrored at the first (a) or last (b) row, after so many repeats."""
        v = [sign * F.col(c).cast("double") + (2 * F.col(f"_{side}{i}") if side else 0) + 2 * turns * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i, c in enumerate(columns.values())]
        return F.struct(at.cast("long").alias("at"), *[x.alias(f"v{i}") for i, x in enumerate(v)])

    none = F.lit(0)
    left = F.when((o > first) & (o <= first + half), put(2 * first - o, -1, "a", none))
    right = F.when((o < last) & (o >= last - half), put(2 * last - o, -1, "b", none))
    near = F.array_compact(F.array(put(o, 1, None, none), left, right))
    period = 2 * (last - first)
    turns = F.sequence(-F.ceil(F.lit(half) / period) - 1, F.ceil(F.lit(half) / period) + 1)
    images = F.transform(turns, lambda k: put(o + k * period, 1, None, k))
    mirrored = F.when((o > first) & (o < last), F.transform(turns, lambda k: put(2 * first - o + k * period, -1, "a", k)))
    again = F.filter(F.concat(images, F.coalesce(mirrored, F.slice(images, 1, 0))), lambda x: (x["at"] >= first - half) & (x["at"] <= last + half))
    alone = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: put(o + k, 1, None, none))
    images = F.when(last - first > half, near).when(last > first, again).otherwise(alone)
    rows = ends.withColumn("_p", F.explode(images)).withColumn("_at", F.col("_p.at"))
    rows = rows.withColumns({f"_s{i}": _frame_sum(F.col(f"_p.v{i}"), keys, "_at", w) / w for i in range(len(columns))})
    rows = rows.where(F.col("_at") == o)
    return rows.select(*[c for c in df.columns if c not in columns], *[F.col(f"_s{i}").alias(n) for i, n in enumerate(columns)])


def smooth_zero(value: Column, *, keys: list[str], order: str, w: int) -> Column:
    """Moving average whose frame is padded with zeros: always divided by w (B2)."""
    return _frame_sum(value, keys, order, w) / w


def gradient(value: Column, *, keys: list[str], order: str, dt: float) -> Column:
    """Central differences, one-sided at both ends (B3); null for a single sample."""
    base = Window.partitionBy(*keys).orderBy(order)
    after, before = F.lead(value).over(base), F.lag(value).over(base)
    return F.coalesce((after - before) / (2 * dt), (after - value) / dt, (value - before) / dt)


def remove_mean(df: DataFrame, *, keys: list[str], column: str, name: str) -> DataFrame:
    """column minus its mean over each grid; NaN counts as no value."""
    clean = F.nanvl(F.col(column), F.lit(None).cast("double"))
    mean = df.groupBy(*keys).agg(F.avg(clean).alias("_mean"))
    return df.join(mean, keys).withColumn(name, clean - F.col("_mean")).drop("_mean")
