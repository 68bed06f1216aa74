"""Packing of documents into fixed windows by minimum bin slack.

Each document is its ids and a closing id. Whole windows are cut off first; the remaining lengths of a block of documents
form a multiset. For each window the longest remaining length is taken, then a subset-sum program over bits (bit s: the sum
s can be reached) finds the multiset of other lengths that comes closest to what is free, and the counts are traced back.
The same pattern is used as often as the counts allow. If slack is left, the longest remaining piece is cut to fill it; the last
window of a block is cut into powers of two, which need no padding. A block never crosses a task, so nothing is shuffled
and memory is bounded by block_docs documents (plus one very long one).

Null texts are empty: a document of the closing id alone. Repeated rows are packed as often as they occur. Empty tables give
empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .tokens import word_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (each at most as often as counted) whose sum is largest within room, as length -> count."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, k = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies at once
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out[length] += k
            total -= length * k
    return dict(out)


def fill_windows(lengths: dict[int, int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int, tuple[int, int] | None]]:
    """Patterns for a multiset of lengths below capacity: the (length, count) pairs of a window, how many windows use
    them, and the (length, part) of a piece to cut for the rest of the window, whose remainder goes back to the multiset."""
    left = Counter({k: v for k, v in lengths.items() if v})
    while left:
        first = max(left)
        others = Counter(left)
        others[first] -= 1
        if not others[first]:
            del others[first]
        need = Counter(best_fill(others, capacity - first))
        need[first] += 1
        slack = capacity - sum(k * v for k, v in need.items())
        times = min(left[k] // v for k, v in need.items())
        cut = None
        if slack:
            rest = left - Counter({k: v * times for k, v in need.items()})
            times, rest = (times, rest) if rest and times <= rest[max(rest)] else (1, left - need)
            if rest:
                cut = (max(rest), slack)
        left -= Counter({k: v * times for k, v in need.items()})
        if cut:
            left[cut[0]] -= times
            if not left[cut[0]]:
                del left[cut[0]]
            left[cut[0] - slack] += times
        yield sorted(need.items(), reverse=True), times, cut


def pack_block(docs: list[tuple[int | None, np.ndarray]], capacity: int) -> list[tuple]:
    """(document number, start, length, window number, offset) of every piece of a block."""
    out, window = [], 0
    pool: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, ids) in enumerate(docs):
        n = len(ids)
        for start in range(0, n - capacity + 1, capacity):
            out.append((i, start, capacity, window, 0))
            window += 1
        if n % capacity:
            pool[n % capacity].append((i, n - n % capacity))
    for pattern, times, cut in fill_windows({k: len(v) for k, v in pool.items()}, capacity):
        for _ in range(times):
            at, pieces = 0, [(k, *pool[k].pop()) for k, v in pattern for _ in range(v)]
            if cut:
                i, start = pool[cut[0]].pop()
                pieces.append((cut[1], i, start))
                pool[cut[0] - cut[1]].append((i, start + cut[1]))
            total = sum(p[0] for p in pieces)
            room = capacity if total == capacity else 1 << (total.bit_length() - 1)
            for length, i, start in pieces:
                while length:  # a last, partly filled window becomes windows of 2**k
                    take = min(length, room - at)
                    out.append((i, start, take, window, at))
                    at, start, length, total = at + take, start + take, length - take, total - take
                    if at == room:
                        window, at = window + 1, 0
                        room = 1 << (total.bit_length() - 1) if total else capacity
    return out


def pack_documents(docs: DataFrame, *, tokenizer: str, capacity: int = 1024, end_id: int = 0, block_docs: int = 4096, block_tokens: int = 1 << 21) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their ids (little-endian unsigned 32-bit) and their place in a sequence of at most capacity tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, base = word_encoder(tokenizer), TaskContext.get().partitionId() << 40
        last = np.array([end_id], "<u4").tobytes()
        block: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def packed() -> pd.DataFrame:
            nonlocal base
            rows = pack_block(block, capacity)
            i, start, length, window, offset = (list(x) for x in zip(*rows, strict=True))
            out = pd.DataFrame({"doc_id": pd.array([block[k][0] for k in i], "Int64"), "start": start, "length": length, "ids": [block[k][1][s : s + n].tobytes() for k, s, n in zip(i, start, length, strict=True)], "doc_tokens": [len(block[k][1]) for k in i], "sequence_id": [base + w for w in window], "offset": offset})
            base += window[-1] + 1 if window else 0
            block.clear()
            return out

        for pdf in batches:
            for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                block.append((None if d is pd.NA else int(d), np.frombuffer(encoder.encode(t) + last, "<u4")))
                tokens += len(block[-1][1])
                if len(block) >= block_docs or tokens >= block_tokens:
                    yield packed()
                    tokens = 0
        if block:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, SCHEMA)
