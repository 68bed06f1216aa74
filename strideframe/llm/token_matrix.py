"""Packed rows of token ids by best-fit decreasing.

Documents longer than a row are split into whole rows and a rest, without loss. The rests of a block of documents are sorted
by length, longest first, and each goes to the open row with the least room that still holds it. A segment tree over room
sizes, whose nodes count rows, finds that row in log2(capacity) steps. A row of the result is one row of the id matrix,
padded with pad_id, with its cumulative segment lengths and the position of each id in its segment (restarting at 0).

Null texts are empty: a segment of the closing id alone. Repeated rows are packed as often as they occur; empty tables give
empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .tokens import word_encoder

SCHEMA = "row_id long, n_tokens int, n_segments int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"


class RoomTree:
    """Counts of open rows by room; finds the least room that is at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, n: int) -> int | None:
        node = n + self.size
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node *= 2
            node += not self.count[node]
        return node - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The item numbers of each row; ties by item number."""
    tree, rows = RoomTree(capacity), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, capacity
        else:
            row = free[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        free[room - lengths[i]].append(row)
        tree.add(room - lengths[i], 1)
    return rows


def token_matrix(docs: DataFrame, *, tokenizer: str, capacity: int = 1024, end_id: int = 0, pad_id: int = 0, block_docs: int = 4096, block_tokens: int = 1 << 21) -> DataFrame:
    """Rows of the packed id matrix of all documents (doc_id, text); ids and position_ids are little-endian unsigned 32-bit and capacity long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, base = word_encoder(tokenizer), TaskContext.get().partitionId() << 40
        last = np.array([end_id], "<u4").tobytes()
        block: list[tuple[int | None, np.ndarray]] = []
        count = np.arange(capacity, dtype="<u4")

        def packed() -> Iterator[pd.DataFrame]:
            nonlocal base
            pieces = []  # document, start, length
            for i, (_, ids) in enumerate(block):
                pieces += [(i, s, min(capacity, len(ids) - s)) for s in range(0, len(ids), capacity)]
            rows, out = best_fit_decreasing([p[2] for p in pieces], capacity), []
            for n, row in enumerate(rows):
                own = [pieces[k] for k in row]
                ends = np.cumsum([p[2] for p in own])
                ids, at = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
                for (i, start, length), end in zip(own, ends, strict=True):
                    ids[end - length : end] = block[i][1][start : start + length]
                    at[end - length : end] = count[:length]
                out.append((base + n, int(ends[-1]), len(own), ids.tobytes(), at.tobytes(), [0, *ends.tolist()], [block[p[0]][0] for p in own], [p[1] for p in own]))
                if len(out) == 1024:
                    yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
                    out = []
            base += len(rows)
            block.clear()
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

        tokens = 0
        for pdf in batches:
            for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                block.append((None if d is pd.NA else int(d), np.frombuffer(encoder.encode(t) + last, "<u4")))
                tokens += len(block[-1][1])
                if len(block) >= block_docs or tokens >= block_tokens:
                    yield from packed()
                    tokens = 0
        if block:
            yield from packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, SCHEMA)


def fill(matrix: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """One row: n_rows, n_tokens and the share of the matrix that isn't padding (null without rows)."""
    return matrix.agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_tokens") / (F.count("*") * capacity)).alias("fill"))


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Writes the rows as Parquet; ids and position_ids of every row are 4 * capacity bytes. An existing path is an error."""
    matrix.write.mode("errorifexists").parquet(path)
