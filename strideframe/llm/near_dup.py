"""Near duplicates by ProbMinHash over word shingles.

1. Signatures: the distinct shingles (five words; a shorter text has one of all its words) of a text arrive as Poisson
   processes with rates equal to their weights; each arrival falls in one of 125 registers, which keeps the first. Drawing
   stops once no later arrival can be first. Two signatures agree in a register with the texts' probability Jaccard
   similarity. weighting="count" weighs a shingle by how often the text has it; "set" (the default) weighs every shingle 1, for which the
   probability Jaccard similarity is the Jaccard similarity of the shingle sets. What is signed is also what is verified.
2. A node is a distinct text, so exact copies are joined before anything else, whatever their ids.
3. Banding: 25 bands of 5 registers; at a similarity of 0.8 a pair meets in a band with probability 0.99995.
4. Every member of a bucket is compared with the bucket's most central member (the one whose buckets are largest), so a
   bucket of n members gives n - 1 pairs. Verification is the exact similarity of the shingles' weights, at least threshold.
   A central member's pairs are dealt to tasks by a salt, whose number follows from the sizes of its buckets.
5. Members of a bucket that the central members haven't joined are compared by signature, in blocks of a bounded size; those
   that agree in as many registers as similar texts do (all but a tenth of what banding misses: 79 at 0.8, below which
   0.000004 of the pairs fall) are verified there too, the likeliest first and as far as they still join components.
6. Components of all links by alternating large-star and small-star steps. No pair inside one component is ever made.

Only the texts that share a bucket with another have their shingles kept: these are computed in a second pass over the texts,
which costs less disk than keeping all.

Null texts are empty. Texts without words are alike only as exact copies. Null ids: the rows count as copies of others with
the same text but can't name a class; a class without an id is null. Rows of one id and different texts are different documents.
Repeated rows are copies. Empty tables give empty results. Other columns of the input are not read by near_duplicates() and pass
through one_of_each(), where names that begin with __sf_ are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, free_shuffles, lookup, release, text_blocks, text_runs, whole_text
from .shingles import mix, windows, word_hashes

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
LINK_ROWS_PER_SALT = 500
#: Characters of texts that are Python objects at one time.
RUN = 1 << 20
#: Rows of a bucket that are compared with each other in one task.
BLOCK = 2000


def prob_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """n_docs x m register owners; elements of all documents in one array, doc says whose they are."""
    first = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, np.uint64)
    time = np.zeros(len(elements))
    active = np.arange(len(elements))
    draw = 0
    with np.errstate(over="ignore"):
        while len(active):
            draw += 1
            z = mix(elements[active] + np.uint64(0x9E3779B97F4A7C15 * draw % 2**64))
            time[active] -= np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active]
            slot = doc[active] * m + (mix(z) % np.uint64(m)).astype(np.int64)
            now = time[active]
            np.minimum.at(first, slot, now)
            won = first[slot] == now
            owner[slot[won]] = elements[active[won]]
            latest = first.reshape(n_docs, m).max(1)
            active = active[now < latest[doc[active]]]
    return owner.reshape(n_docs, m)


def _elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, whose they are, and how often the text has them."""
    z, doc, _ = windows(*word_hashes(texts))
    order = np.lexsort((z, doc))
    z, doc = z[order], doc[order]
    at = np.flatnonzero(np.r_[True, (z[1:] != z[:-1]) | (doc[1:] != doc[:-1])][: len(z)])
    return z[at], doc[at], np.diff(np.r_[at, len(z)])


def node_of(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "replace")).digest()


#: What a shingle weighs that a text has n times; "set" has no entry, as all its weights are 1.
WEIGHTS = {"log": lambda n: 1 + np.log10(n), "count": lambda n: n.astype(float)}


def signatures(texts: list[str], weighting: str = "set") -> tuple[list[np.ndarray], list[bytes]]:
    """Band keys (64 bits; none of a text without words) and one byte of each register of every text."""
    keys: list[np.ndarray] = []
    registers: list[bytes] = []
    for a, b in text_blocks(texts):
        z, doc, n = _elements(texts[a:b])
        owner = prob_minhash(z, WEIGHTS[weighting](n) if weighting in WEIGHTS else np.ones(len(z)), doc, b - a)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (b - a, 1))
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                key = mix(key + owner.reshape(-1, BANDS, ROWS)[:, :, r] + np.uint64(r + 1))
        full = np.bincount(doc, minlength=b - a) > 0
        keys += [k if f else k[:0] for k, f in zip(key.view(np.int64), full, strict=True)]
        registers += [r.tobytes() for r in owner.astype(np.uint8)]
    return keys, registers


def shingle_sets(texts: list[str], weighted: bool = False) -> list[bytes]:
    """Of every text the sorted 32-bit hashes of its distinct shingles, and after them (weighted) how often it has each."""
    out = []
    for a, b in text_blocks(texts):
        z, doc, n = _elements(texts[a:b])
        short = (z >> np.uint64(32)).astype("<u4")
        ends = np.cumsum(np.bincount(doc, minlength=b - a))
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if weighted:
                hashes, inverse = np.unique(short[lo:hi], return_inverse=True)
                counts = np.bincount(inverse, weights=n[lo:hi]).astype("<u4")
                out.append(hashes.tobytes() + counts.tobytes())
            else:
                out.append(np.unique(short[lo:hi]).tobytes())
    return out


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted sets of 32-bit integers."""
    both = np.concatenate([np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def probability_jaccard(a: bytes, b: bytes, weigh=WEIGHTS["count"]) -> float:
    """The sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i), x and y being the weights of the counts in a and b."""
    (p, x), (q, y) = (np.split(np.frombuffer(s, "<u4"), 2) for s in (a, b))
    if len(p) and len(q) and x.max() == 1 == y.max():  # no repeats: the sets' similarity
        return jaccard(p.tobytes(), q.tobytes())
    x, y = weigh(x), weigh(y)
    keys, at = np.unique(np.r_[p, q], return_inverse=True)
    wx, wy = np.zeros(len(keys)), np.zeros(len(keys))
    wx[at[: len(p)]], wy[at[len(p) :]] = x, y
    both = (wx > 0) & (wy > 0)
    if not both.any():
        return 0.0
    ratio = np.where(wx > 0, wy / np.where(wx > 0, wx, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    r, sx, sy = ratio[order], np.r_[0, np.cumsum(wx[order])], np.r_[0, np.cumsum(wy[order])]
    upto = np.searchsorted(r, ratio[both], side="right")
    return float((wx[both] / (sx[upto] + (sy[-1] - sy[upto]) / ratio[both])).sum())


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, similarity) -> DataFrame:
    """The similar ones of pairs (a, b, salts): b may be in many pairs, which are dealt to that many salts."""
    left = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    wide = pairs.select("b", "salts").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    right = wide.select("b", "set_b", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [similarity(x, y) >= threshold for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    return left.join(right, ["b", "salt"]).select("a", "b", "set_a", "set_b").mapInPandas(similar, "a binary, b binary")


def _least_registers(threshold: float) -> int:
    """Fewer registers than this agree in a pair at the threshold with at most a tenth of the probability that no band meets."""
    bound, below, k = 0.1 * (1 - threshold**ROWS) ** BANDS, 0.0, 0
    while k < REGISTERS and (below := below + comb(REGISTERS, k) * threshold**k * (1 - threshold) ** (REGISTERS - k)) <= bound:
        k += 1
    return k


def _tiles(registers: np.ndarray, block: np.ndarray, p: int, q: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of blocks p and q: row numbers i and j, and how many registers each i has in common with each j; 0 where a pair isn't asked for or has less than least."""
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    for lo in range(0, len(left), 32):
        i = left[lo : lo + 32]
        common = np.stack([(registers[k] == registers[right]).sum(1, dtype=np.uint8) for k in i])
        common[common < least] = 0
        if p == q:
            common[i[:, None] <= right[None]] = 0
        yield i, right, common


def _between(parts: np.ndarray, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a tile of pairs of different parts, likeliest first."""
    x, y = np.nonzero((common > 0) & (parts[i][:, None] != parts[j][None]))
    order = np.argsort(-common[x, y].astype(np.int16), kind="stable")
    return x[order], y[order]


def _joining(parts: np.ndarray, tiles: Iterator[tuple], sets: list[bytes], threshold: float, similarity) -> list[tuple[int, int]]:
    """Row numbers of similar pairs that join parts, the likeliest of a tile first; a pair of what is already one is not looked at."""
    parts, out = parts.copy(), []
    for i, j, common in tiles:
        for a, b in zip(*_between(parts, i, j, common), strict=True):
            u, v = parts[i[a]], parts[j[b]]
            if u != v and similarity(sets[i[a]], sets[j[b]]) >= threshold:
                parts[parts == u] = v
                out.append((int(i[a]), int(j[b])))
    return out


GROUP = ["key", "p", "q"]


def _crossed(rest: DataFrame, sets: DataFrame, threshold: float, similarity=jaccard) -> DataFrame:
    """Links (a, b) between parts, found among rows (key, n, node, part, registers) of one bucket.

    Large buckets are dealt in pairs of blocks. A first pass keeps the rows that agree with one of another part; only
    these get their shingles, and a second pass verifies them.
    """
    least = _least_registers(threshold)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "part", "registers")

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, Iterator[tuple]]]:
        """Rows of a group, their parts as numbers and its tiles, for groups of several parts."""
        held = None
        for pdf in _with_end(batches):
            part = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if part is None or not len(part):
                continue
            keys = part[GROUP].to_numpy()
            begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            ends = np.r_[begin[1:], len(part)]
            if pdf is not None:  # the last group may go on in the next batch
                held = part.iloc[begin[-1] :]
                begin, ends = begin[:-1], ends[:-1]
            registers = np.frombuffer(b"".join(part["registers"]), np.uint8).reshape(-1, REGISTERS)
            parts, block = pd.factorize(part["part"])[0], part["block"].to_numpy()
            for s, e in zip(begin, ends, strict=True):
                if (parts[s:e] != parts[s]).any():
                    yield part.iloc[s:e], parts[s:e], _tiles(registers[s:e], block[s:e], keys[s, 1], keys[s, 2], least)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, parts, tiles in groups(batches):
            near = np.zeros(len(rows), bool)
            for i, j, common in tiles:
                x, y = _between(parts, i, j, common)
                near[i[x]] = near[j[y]] = True
            if near.any():
                yield rows[near]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, parts, tiles in groups(batches):
            nodes = rows["node"].tolist()
            found = _joining(parts, tiles, rows["shingles"].tolist(), threshold, similarity)
            if found:
                yield pd.DataFrame([(nodes[i], nodes[j]) for i, j in found], columns=["a", "b"], dtype=object)

    together = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP)
    near = together(dealt).mapInPandas(candidates, "key long, p int, q int, block int, node binary, part binary, registers binary")
    return together(near.join(sets.select("node", "shingles"), "node")).mapInPandas(links, "a binary, b binary")


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes of links (a, b), by large-star and small-star steps until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # the centre of a large star has as many edges as the star has nodes: such nodes' least neighbours go to all tasks (lookup)
        n = edges.count() if state is None else state[0]
        keep = cut if 2 * n > common.FEW_ROWS else lambda df: df  # lookup() then reads them several times
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        greater = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u > v in all edges
        large = keep(lookup(greater, least, "u", total=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        low = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = lookup(large, low, "u", total=n).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v")
        before, edges = edges, cut(small.distinct())
        release(before, *([least, large, low] if keep is cut else []))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    member = cut(edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))))).distinct())
    release(edges)
    return member


def _classes(heads: DataFrame, all_sets: DataFrame, threshold: float, similarity) -> DataFrame:
    """node and component of all texts that are similar to another: of heads (node, bands, registers), with their shingles from all_sets (node, shingles)."""
    banded = heads.select("node", F.explode("bands").alias("key"))
    sizes = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    n_banded = sizes.agg(F.sum("n")).first()[0] or 0
    members = cut(lookup(banded, sizes, "key", total=n_banded))
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    central = cut(members.join(rank, "node").groupBy("key").agg(F.max(F.struct("rank", "node")).alias("top"), F.count("*").alias("n")))
    pairs = cut(lookup(members.drop("n"), central, "key", total=n_banded).where("node <> top.node").select(F.col("node").alias("a"), F.col("top.node").alias("b"), F.ceil(F.col("top.rank") / LINK_ROWS_PER_SALT).alias("salts")).distinct())
    sets = cut(all_sets.join(rank.select("node"), "node", "left_semi"))
    links = cut(_verified(pairs, sets, threshold, similarity))

    # what the central members did not join; a part is known to be linked: a member's central one, or that one's
    hop = cut(links.groupBy("a").agg(F.min("b").alias("b")))
    hops = hop.join(hop.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("part"))
    parted = members.join(hops, "node", "left").withColumn("part", F.coalesce("part", "node"))
    open_keys = cut(parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n"))
    rest = cut(lookup(parted.drop("n"), open_keys, "key", total=n_banded).join(heads.drop("n").select("node", "registers"), "node"))
    final = components(links.unionByName(_crossed(rest, sets, threshold, similarity)))
    release(sizes, members, central, pairs, sets, links, hop, open_keys, rest)
    return final


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, weighting: str = "log") -> DataFrame:
    """doc_id, node (md5 of the text), copy_of (least id with this text), class_id (least id of its near-duplicate class) and first (whether this row stands for its class) of every row of docs (doc_id, text)."""
    if weighting not in ("set", *WEIGHTS):
        raise ValueError(f"unknown weighting {weighting}")
    weighted = weighting in WEIGHTS
    similarity = partial(probability_jaccard, weigh=WEIGHTS[weighting]) if weighted else jaccard

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_runs(batch["text"], RUN):
                nodes = [node_of(t) for t in texts]
                first = {n: i for i, n in reversed(list(enumerate(nodes)))}
                keys, registers = signatures([texts[i] for i in first.values()], weighting)
                place = {n: k for k, n in enumerate(first)}
                own = [place[n] for n in nodes]
                columns = [batch["doc_id"].slice(at, len(texts)), pa.array(nodes, pa.binary()), pa.array([keys[k] for k in own], pa.list_(pa.int64())), pa.array([registers[k] for k in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "bands", "registers"])
                at += len(texts)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in text_runs(batch["text"], RUN):
                texts = list(dict.fromkeys(run))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in texts], pa.binary()), pa.array(shingle_sets(texts, weighted), pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    signed = cut(rows.mapInArrow(sign, "doc_id long, node binary, bands array<long>, registers binary"))
    # equal texts have equal bands and registers: any row's will do
    heads = cut(signed.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers")))
    sets = rows.select("text").mapInArrow(sets_of, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    final = _classes(heads, sets, threshold, similarity)
    free_shuffles(docs.sparkSession)

    texts = heads.select("node", "copy_of", "n").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = texts.groupBy("component").agg(F.min(F.struct(F.col("copy_of").isNull().alias("unnamed"), "copy_of", "node")).alias("top"), F.count("*").alias("n"))
    texts = lookup(texts.withColumnRenamed("n", "rows"), named, "component", total=heads.count()).drop("n").withColumnRenamed("rows", "n")
    texts = cut(texts.select("node", "n", "copy_of", F.col("top.copy_of").alias("class_id"), (F.col("node") == F.col("top.node")).alias("stands")))
    release(heads, final)
    rows = lookup(signed.select("doc_id", "node"), texts, "node")
    return rows.select("doc_id", "node", "copy_of", "class_id", (F.col("stands") & F.col("doc_id").eqNullSafe(F.col("copy_of"))).alias("first"))


def one_of_each(docs: DataFrame, *, threshold: float = 0.8, weighting: str = "log") -> DataFrame:
    """The row of docs (doc_id, text, ...) that stands for its class (that of the least id), of every class, with docs' columns; repeated rows once."""
    key = lambda text_md5: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), text_md5)
    kept = near_duplicates(docs, threshold=threshold, weighting=weighting).where("first").select(key(F.lower(F.hex("node"))).alias("__sf_key"))
    keyed = docs.withColumn("__sf_key", key(F.md5(F.encode(whole_text(), "UTF-8"))))
    return keyed.join(kept, "__sf_key", "left_semi").dropDuplicates(["__sf_key"]).drop("__sf_key")
