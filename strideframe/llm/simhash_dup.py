"""Near duplicates by SimHash fingerprints whose segments are decoded by a Golay code.

1. A fingerprint: ASCII capitals of the text are lower-cased, words are what ASCII white space leaves, every run of three words joined by spaces
   (repeats included; a shorter text has one run of all its words) is hashed by XXH64 with seed 42; a bit is set if more than half of the
   hashes have it. A text without words has fingerprint zero, which is linked like any other.
2. Nodes are distinct fingerprints; equal ones are counted together before anything is compared.
3. Keys: a fingerprint is cut into segments A (22 bits), B and C (21 bits each), and each is decoded to one or six codewords (golay.keys), of
   which segments that differ in at most two bits share one. Up to three differing bits fall on the segments so that
   - one segment doesn't differ, and then the next one (A, B, C, A ...) differs in at most two bits or the one before doesn't differ at all: keys are
     an equal segment with a codeword of the next one, for each of the three; or
   - each differs in one bit: then one half of A and one half of B don't differ, and keys are these halves with a codeword of C.
   That makes at most 42 keys of 31 to 35 bits for a fingerprint, and no linked pair is without a common key.
4. In each bucket (fingerprints with one key) the exact distance decides. A bucket's links are a spanning forest: a fingerprint is compared
   with those that no earlier one has reached, most frequent (then least) first, so n fingerprints give less than n links. Buckets of more
   than block fingerprints are dealt to tasks in blocks, and each block also gets the bucket's most frequent fingerprint; large buckets that are then
   still in several components are compared block against block.
5. Components of the links by alternating large-star and small-star steps, named by their least doc_id.

Null texts are empty. Null ids: the rows are fingerprinted and linked like others but name no component; a component without an id is
null. Repeated rows are rows. Empty tables give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import cut, free_shuffles, lookup, release, text_runs, whole_text
from .near_dup import components

MAX_BITS = 3
#: Fingerprints of a bucket that one task compares at a time.
BLOCK = 5000
#: Keys of large buckets (a key and a size each) that may go to every task; more of them are joined by a shuffle.
MAX_BROADCAST_KEYS = 100_000
#: Hashes whose bits are counted at a time.
SLICE = 1 << 15


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    runs = zip(words, words[1:], words[2:]) if len(words) >= 3 else [tuple(words)]  # noqa: B905
    hashes = map(lambda run: xxhash.xxh64_intdigest(b" ".join(run), 42), runs)
    n = max(1, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        h = np.fromiter(hashes, "<u8", min(SLICE, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a 64-bit integer."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint(t) for run in text_runs(texts, 1 << 20) for t in run]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return of(text)


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint, and which of them there are: two arrays of one row a fingerprint."""
    bits = lambda low, n: (prints >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64)
    a, b, c = bits(0, 22), bits(22, 21), bits(43, 21)
    near = [golay.keys(s) for s in (a, b, c)]
    out, there = [], []
    for kind, (exact, (codes, has)) in enumerate(zip((a, b, c), near[1:] + near[:1], strict=True)):
        out.append(kind << 56 | exact[:, None] << 12 | codes)
        there.append(has)
    for kind, (x, y) in enumerate([(x, y) for x in (bits(0, 11), bits(11, 11) | 1 << 11) for y in (bits(22, 10), bits(32, 11) | 1 << 11)]):
        out.append((3 + kind) << 56 | x[:, None] << 24 | y[:, None] << 12 | near[2][0])
        there.append(near[2][1])
    return np.hstack(out), np.hstack(there)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, n = batch["print"].to_numpy(), batch["n"].to_numpy()
        for at in range(0, len(prints), 4096):
            keys, there = segment_keys(prints[at : at + 4096].view(np.uint64))
            each = there.sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[there]), pa.array(np.repeat(prints[at : at + 4096], each)), pa.array(np.repeat(n[at : at + 4096], each))], ["key", "print", "n"])


def forest(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints under distance max_bits at most."""
    left, waiting, links = prints, [], []
    while len(left):
        if not waiting:
            waiting.append(left[0])
            left = left[1:]
        now = waiting.pop()
        near = np.bitwise_count(left ^ now) <= max_bits
        if near.any():
            links += [(int(now), int(x)) for x in left[near]]
            waiting += left[near][::-1].tolist()
            left = left[~near]
    return links


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by columns, cut again so that no group is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch[c].to_numpy() for c in by])
        new = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        if held and (ids[:, 0] != [held[-1][c][-1].as_py() for c in by]).any():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])]).combine_chunks().to_batches()[0]
            held = [batch.slice(new[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _links_of(by: list[str], max_bits: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, by):
            ids = np.stack([batch[c].to_numpy() for c in by])
            starts = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(0)])
            ends = np.r_[starts[1:], ids.shape[1]]
            prints, n = batch["print"].to_numpy().view(np.uint64), batch["n"].to_numpy()
            found: list[tuple[int, int]] = []
            two = ends - starts == 2
            x, y = prints[starts[two]], prints[starts[two] + 1]
            near = (x != y) & (np.bitwise_count(x ^ y) <= max_bits)
            pairs = [np.stack([x[near], y[near]], 1)]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                order = np.lexsort((prints[s:e], -n[s:e]))
                found += forest(prints[s:e][order], max_bits)
            pairs.append(np.array(found, np.uint64).reshape(-1, 2))
            out = np.unique(np.concatenate(pairs), axis=0)
            out = out[out[:, 0] != out[:, 1]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

    return links


def _found(dealt: DataFrame, by: list[str], max_bits: int) -> DataFrame:
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links_of(by, max_bits), "a long, b long")


def fingerprint_links(heads: DataFrame, *, block: int = BLOCK, max_broadcast_keys: int = MAX_BROADCAST_KEYS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between the fingerprints of heads (print, n; distinct) that join all that buckets' blocks show; and the members (key, print, n, size) of buckets larger than block, if there are any."""
    keyed = heads.select("print", "n").mapInArrow(_keyed, "key long, print long, n long")
    large = cut(keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block))
    n_large = large.count()
    dealt, members = keyed.withColumn("block", F.lit(0)), None
    if n_large:
        sizes = F.broadcast(large) if n_large <= max_broadcast_keys else large
        blocks = F.ceil(F.col("size") / block).cast("int")
        members = cut(keyed.join(sizes, "key"))
        first = members.groupBy("key", "size").agg(F.max(F.struct("n", "print")).alias("top"))
        first = first.select("key", F.col("top.print").alias("print"), F.col("top.n").alias("n"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        small = keyed.join(sizes.select("key"), "key", "left_anti").withColumn("block", F.lit(0))
        split = members.select("key", "print", "n", F.pmod(F.xxhash64("print"), blocks).cast("int").alias("block"))
        dealt = small.unionByName(split).unionByName(first)
    return cut(_found(dealt, ["key", "block"], max_bits)), members


def _across(members: DataFrame, known: DataFrame, block: int, max_bits: int) -> DataFrame:
    """Links between blocks of large buckets that are still in several components (known: node, component)."""
    parted = members.join(known.withColumnRenamed("node", "print"), "print", "left").withColumn("part", F.coalesce("component", "print"))
    several = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = members.join(several, "key").withColumn("own", F.pmod(F.xxhash64("print"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "print", "n")
    return _found(dealt, ["key", "p", "q"], max_bits)


def simhash_components(docs: DataFrame, *, block: int = BLOCK, max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """doc_id, print (the fingerprint as a 64-bit integer) and component_id of every row of docs (doc_id, text)."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(whole_text()).alias("print")))
    heads = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links, members = fingerprint_links(heads, block=block, max_broadcast_keys=max_broadcast_keys)
    final = components(links)
    if members is not None:
        more = cut(_across(members, final, block, MAX_BITS))
        before, final = final, components(links.unionByName(more))
        release(before, more, members)
    release(links)
    free_shuffles(docs.sparkSession)
    parted = heads.join(final.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = parted.groupBy("component").agg(F.min("least").alias("component_id"))
    table = cut(parted.join(named, "component").select("print", "n", "component_id"))
    release(final, heads)
    return lookup(rows, table, "print").select("doc_id", "print", "component_id")
