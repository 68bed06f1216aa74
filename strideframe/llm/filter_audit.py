"""What five filters remove from documents, in every order: alone, together and after one another.

Filters (words are what ASCII white space leaves, case counts): A under 200 words; B less than half of the words distinct; C more than 3 % of the
code points are A-Z; D holds one of # $ % & * |; E the text is that of a smaller doc_id anywhere in the table.

1. Counting Bloom prepass: every text adds one to some counters, chosen by its hashes. Tasks send the counters they touched, with counts that
   stop at two; these sketches are merged by adding, slice by slice. A text with a counter below two is the only one with this text.
2. One pass over the texts takes A to D as bits and asks the merged sketch; only texts that may be repeated are shuffled, whole, and grouped
   by the full text: the group's least doc_id doesn't fail E, the others do. A copy that nearly all rows share is first reduced to its
   least id within each task.
3. These least ids are joined back to the rows by id and hashes, labels by id, and rows become counts by part and mask of failed filters (32 at
   most). All numbers of all orders are sums of these counts.

The sketch has COUNTERS_PER_TEXT counters of two bits for each text, up to max_counters: 2^29 of them (128 MB in the driver and in each worker) by
default, which is enough for about 70 million texts at full strength. With more texts, or with fewer counters, more unique texts are
shuffled as possible repeats; results are the same with any size.

Null texts are empty. A null doc_id is neither smaller nor greater than another: such rows don't fail E, make no other row fail it, and have no
labels. Rows of one doc_id and one text don't fail E by each other. The part of a row is its lang, null as the empty string. Several labels of a
document count once: it is good (toxic) if any of its rows says 1. Empty tables give empty results. Other columns of the input are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_runs, whole_text

FILTERS = "ABCDE"
COUNTERS_PER_TEXT, HASHES = 8, 3
MAX_COUNTERS = 1 << 29
MIN_WORDS = 200
#: Counters of a slice of the sketch, which one task merges.
SLICE_BITS = 16
#: Texts whose counters a task holds before it sends them.
FLUSH = 1 << 19
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


def places(h: np.ndarray, g: np.ndarray, bits: int) -> np.ndarray:
    """HASHES counters of each pair of hashes, one row each: distinct in most cases, and equal for equal hashes."""
    step = (g.view(np.uint64) | np.uint64(1))[:, None]
    with np.errstate(over="ignore"):
        mixed = h.view(np.uint64)[:, None] + step * np.arange(HASHES, dtype=np.uint64)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def hashes(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit("again")).alias("g")]


def _touched(bits: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            part = at >> SLICE_BITS
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            # a counter's place within its slice, and after all places whether it is two or more
            low, many = (at & (1 << SLICE_BITS) - 1).astype("<u2"), (n > 1).astype(np.uint8)
            pieces = [low[s:e].tobytes() + many[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(pieces, pa.binary())], ["slice", "touched"])

        for b in batches:
            p = places(b["h"].to_numpy(), b["g"].to_numpy(), bits)
            p.sort(1)  # a text that hits a counter twice adds one to it
            once = np.c_[np.ones(len(p), bool), p[:, 1:] != p[:, :-1]]
            held.append(p[once])
            if sum(map(len, held)) >= FLUSH * HASHES:
                yield from sent()
                held.clear()
        if held:
            yield from sent()

    return sketch


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of two-bit counters from sketches sorted by slice."""
    now, counters = None, np.zeros(1 << SLICE_BITS, np.uint8)

    def packed() -> pa.RecordBatch:
        four = counters.reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([(four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()], pa.binary())], ["slice", "counters"])

    for b in batches:
        for part, touched in zip(b["slice"].to_pylist(), b["touched"].to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    yield packed()
                now = part
                counters[:] = 0
            n = len(touched) // 3
            at = np.frombuffer(touched, "<u2", n)
            counters[at] = np.minimum(2, counters[at] + 1 + np.frombuffer(touched, np.uint8, n, 2 * n))
    if now is not None:
        yield packed()


def text_sketch(texts: DataFrame, *, max_counters: int = MAX_COUNTERS) -> np.ndarray:
    """The merged sketch of all rows of texts (text): two-bit counters, four to a byte; their number is a power of two."""
    n = texts.count()
    bits = int(np.clip(int(COUNTERS_PER_TEXT * max(n, 1)).bit_length(), SLICE_BITS, int(max_counters).bit_length() - 1))
    sent = texts.select(*hashes(whole_text())).mapInArrow(_touched(bits), "slice long, touched binary")
    slices = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice long, counters binary")
    sketch = np.zeros(1 << bits - 2, np.uint8)
    size = 1 << SLICE_BITS - 2
    for r in slices.toLocalIterator():
        sketch[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counters"], np.uint8)
    return sketch


def maybe_repeated(sketch: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each text may occur twice: if not, it certainly doesn't."""
    at = places(h, g, len(sketch).bit_length() + 1)
    return (sketch[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3 >= 2).all(1)


def text_mask(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw) != len(raw.translate(None, _SYMBOLS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | symbols << 3


def failed_filters(docs: DataFrame, *, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """doc_id, part and mask (bit 0 for A to bit 4 for E) of every row of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), whole_text().alias("text"))
    sketch = spark.sparkContext.broadcast(text_sketch(rows, max_counters=max_counters))

    @F.arrow_udf("mask int, maybe boolean")
    def measured(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, h, g in batches:
            masks = [text_mask(t) for run in text_runs(texts, 1 << 20) for t in run]
            maybe = maybe_repeated(sketch.value, h.to_numpy(), g.to_numpy())
            yield pa.StructArray.from_arrays([pa.array(masks, pa.int32()), pa.array(maybe)], ["mask", "maybe"])

    out = rows.withColumns({"h": hashes(F.col("text"))[0], "g": hashes(F.col("text"))[1]}).withColumn("m", measured("text", "h", "g"))
    maybe = F.col("m.maybe") & F.col("doc_id").isNotNull()
    # texts of possible repeats stay in this table for the one shuffle they need
    table = cut(out.select("doc_id", "part", "h", "g", F.col("m.mask").alias("mask"), maybe.alias("maybe"), F.when(maybe, F.col("text")).alias("text")))
    least = table.where("maybe").groupBy("text", "h", "g").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h", "g", F.lit(True).alias("is_least"))
    repeats = table.where("maybe").drop("text").join(least, ["doc_id", "h", "g"], "left")
    repeats = repeats.select("doc_id", "part", (F.col("mask") + F.when(F.col("is_least"), 0).otherwise(16)).cast("int").alias("mask"))
    return table.where("not maybe").select("doc_id", "part", "mask").unionByName(repeats)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many rows of masks (doc_id, part, mask) there are (n), how many of them are labelled good and toxic."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good + toxic > 0")
    plain = masks.groupBy("part", "mask").agg(F.count("*").alias("n"))
    marked = masks.where(F.col("doc_id").isNotNull()).join(known, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    zero = lambda *cs: [F.lit(0).cast("long").alias(c) for c in cs]
    both = plain.select("part", "mask", "n", *zero("good", "toxic")).unionByName(marked.select("part", "mask", *zero("n"), "good", "toxic"))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step from counts (part, mask, n, good, toxic)."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    cell = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: F.expr(f"shiftleft(1, ascii(substring(filter_order, {at}, 1)) - 65)")
    cell = cell.withColumn("own", bit("step")).withColumn("before", sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0)))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    out = cell.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    shares = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "own"]).drop("own").withColumn("step", F.col("step").cast("int"))


def audit_filters(docs: DataFrame, labels: DataFrame, *, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, of docs (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    counts = cut(mask_counts(cut(failed_filters(docs, max_counters=max_counters)), labels))
    return interactions(counts)
