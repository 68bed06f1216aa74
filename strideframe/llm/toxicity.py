"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give each word the probability of its characters, each after up to CONTEXT characters of
the word (its start included). Counts are discounted; what that frees goes to shared backoff counts: first to both classes
pooled, then to counts of a character after three others in all documents, then to Kneser-Ney continuation counts (how many
different characters stand before a run of three in all documents). Expressions too rare to tell the classes apart thus score
alike under both. A text's evidence is the difference of its two log-likelihoods by word, averaged over its words (whole, and of
words that are at least e^STRONG times likelier when toxic); a logistic curve, fitted to labelled rows, turns it into a score.

All counts are exact sums over whole 64-bit keys. Class counts come from labelled rows whose crc32(doc_id) is 0 mod 3, the curve
from those with 2; rows with 1 are never used. max_labelled bounds the labelled rows (those with the least hash of doc_id), and
so the class counts. Shared counts are gathered from all documents; a score needs only those after contexts that labelled rows
have (after others both classes give a character the same probability), and only these reach the driver and the tasks: at most the
labelled rows' contexts times the characters that follow them.

Null and empty texts have no evidence and get the curve's value at 0. Null labels, and labels of unknown documents, are
ignored; a document with several labels counts once for each, and of several texts of one labelled id the least counts. Without
labels of both classes every score is 0. Null ids are scored and not held out. Repeated rows get equal scores. Columns of the
input pass through; names that begin with __sf_ are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, text_blocks, text_runs, whole_text
from .shingles import mix

#: SHARED_WEIGHT: how many observations of a context the shared backoff counts for, beside the discounted ones.
CONTEXT, SHORT, DISCOUNT, SHARED_WEIGHT, STRONG = 6, 3, 0.75, 80.0, 1.2

#: Characters of text that one worker takes apart at a time, words of which it keeps counts or evidence, and words whose grams it makes at once.
BLOCK_CHARS, KEPT_WORDS, SLICE_WORDS = 1 << 18, 150_000, 4_000

_WORDS = re.compile(r"[^\W_]+")


def fold() -> Column:
    """crc32(doc_id as text) mod 3: 0 for counts, 2 for the curve, 1 held out."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of all texts, the number of each word in the sequence of all, and words by text."""
    lists = [_WORDS.findall(t.lower()) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for x in lists for w in x]
    codes, words = pd.factorize(flat)
    return words, codes, counts


def char_grams(words: np.ndarray) -> dict[str, np.ndarray]:
    """For every character of every word (and its end): word number, hashes of the character with its contexts and of these."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    begin = np.flatnonzero(c == 2)
    ends = np.flatnonzero(c == 3)
    word = np.repeat(np.arange(len(begin)), ends - begin + 1)
    depth = np.arange(len(c)) - begin[word]
    out = {}
    with np.errstate(over="ignore"):
        h = mix(c + np.uint64(0x9E3779B97F4A7C15))
        by_order = {1: h}
        for n in range(2, CONTEXT + 2):
            back = np.zeros_like(c)
            back[n - 1 :] = c[: len(c) - n + 1]
            h = np.where(depth >= n - 1, mix(h * np.uint64(3) + back + np.uint64(n)), h)
            by_order[n] = h
        for name, order in (("long", CONTEXT + 1), ("four", SHORT + 1), ("three", SHORT)):
            gram, before = by_order[order], by_order[order - 1]
            context = np.zeros_like(gram)
            context[1:] = before[:-1]
            out[name], out[f"{name}_context"] = gram.view(np.int64), context.view(np.int64)
    real = depth > 0
    return {k: v[real] for k, v in out.items()} | {"word": word[real]}


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, toxic = pdf["text"].tolist(), pdf["toxic"].to_numpy(bool)
        for a, b in text_blocks(texts, BLOCK_CHARS):
            words, codes, counts = words_of(texts[a:b])
            if not len(words):
                continue
            once = np.unique(np.repeat(np.arange(b - a), counts) * len(words) + codes)  # a text says a word once
            codes, is_toxic = once % len(words), toxic[a:b][once // len(words)]
            g = char_grams(words)
            n = [np.bincount(codes[x], minlength=len(words))[g["word"]] for x in (is_toxic, ~is_toxic)]
            keys = ["long", "long_context", "four_context", "three_context"]
            yield pd.DataFrame({k: g[k] for k in keys} | {"toxic": n[0], "ordinary": n[1]}).groupby(keys, as_index=False).sum()


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's runs of four characters; its words are taken apart once for KEPT_WORDS distinct ones."""
    counted: dict[str, int] = {}

    def grams() -> Iterator[pa.RecordBatch]:
        words, n = np.array(list(counted), object), np.fromiter(counted.values(), np.int64, len(counted))
        counted.clear()
        keys = ["four", "four_context", "three", "three_context"]
        for lo in range(0, len(words), SLICE_WORDS):
            g = char_grams(words[lo : lo + SLICE_WORDS])
            rows = pd.DataFrame({k: g[k] for k in keys} | {"n": n[lo : lo + SLICE_WORDS][g["word"]]}).groupby(keys, as_index=False, sort=False).sum()
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    for batch in batches:
        for texts in text_runs(batch.column("text"), BLOCK_CHARS):
            words, codes, _ = words_of(texts)
            for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                counted[w] = counted.get(w, 0) + n
            if len(counted) >= KEPT_WORDS:
                yield from grams()
    if counted:
        yield from grams()


class Table:
    """Numbers by 64-bit key; keys that it doesn't have give 0. Keys are hashes, so the first bits say nearly where one lies."""

    def __init__(self, rows: pd.DataFrame, key: str, columns: list[str]):
        keys = rows[key].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.names, self.values = columns, rows[columns].to_numpy(np.float32)[order]
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        firsts = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.starts = np.r_[0, firsts.cumsum()].astype(np.int32)

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        k = keys.view(np.uint64)
        first = (k >> self.shift).astype(np.int64)
        at, end = self.starts[first], self.starts[first + 1]
        where = np.full(len(k), -1, np.int32)
        open_rows = np.flatnonzero(at < end)
        while len(open_rows):  # the keys of one beginning are few
            hit = self.keys[at[open_rows]] == k[open_rows]
            where[open_rows[hit]] = at[open_rows[hit]]
            open_rows = open_rows[~hit]
            at[open_rows] += 1
            open_rows = open_rows[at[open_rows] < end[open_rows]]
        there = np.flatnonzero(where >= 0)
        out = np.zeros((len(k), len(self.names)))
        out[there] = self.values[where[there]]
        return dict(zip(self.names, out.T, strict=True))


def _fetched(df: DataFrame) -> pd.DataFrame:
    return df.toArrow().to_pandas()


class Model:
    """The counts of both classes and the shared ones; small enough for every worker."""

    def __init__(self, grams: Table, contexts: Table, shared: dict[str, tuple[Table, Table]]):
        self.grams, self.contexts, self.shared = grams, contexts, shared
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word_evidence(self, words: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        if not len(words):
            return np.zeros(0)
        g = char_grams(words)
        context = self.contexts.find(g["long_context"])
        # after a context that no labelled row has, both classes have the shared probability: no difference
        use = np.flatnonzero(context["toxic"] + context["ordinary"] > 0)
        t_all, o_all, t_kinds, o_kinds, kinds = (context[c][use] for c in ("toxic", "ordinary", "toxic_kinds", "ordinary_kinds", "pooled_kinds"))
        gram = self.grams.find(g["long"][use])
        t, o = gram["toxic"], gram["ordinary"]

        def level(count, total, kinds, p):
            total = np.maximum(total, 1e-9)
            return np.where(total > 0.5, np.maximum(count - DISCOUNT, 0) / total + np.minimum(DISCOUNT * kinds / total, 1.0) * p, p)

        p = np.full(len(use), 1 / 256)
        for name in ("three", "four"):
            counts, totals = self.shared[name]
            total = totals.find(g[f"{name}_context"][use])
            p = level(counts.find(g[name][use])["n"], total["n"], total["kinds"], p)
        pooled = level(t + o, t_all + o_all, kinds, p)

        def class_level(count, total, kinds):
            freed = np.minimum(DISCOUNT * kinds, total) + SHARED_WEIGHT
            return (np.maximum(count - DISCOUNT, 0) + freed * pooled) / (total + SHARED_WEIGHT)

        each = np.log(class_level(t, t_all, t_kinds) + 1e-12) - np.log(class_level(o, o_all, o_kinds) + 1e-12)
        return np.bincount(g["word"][use], weights=each, minlength=len(words))

    def _by_word(self, words: np.ndarray) -> np.ndarray:
        """word_evidence, computed once for a word while a worker keeps it."""
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > KEPT_WORDS:
                self.known.clear()
                new = list(words)
            for lo in range(0, len(new), SLICE_WORDS):
                part = new[lo : lo + SLICE_WORDS]
                self.known.update(zip(part, self.word_evidence(np.array(part, object)).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each text: the mean over its words, and the mean of what goes beyond STRONG."""
        out = np.zeros((len(texts), 2))
        for a, b in text_blocks(texts, BLOCK_CHARS):
            words, codes, counts = words_of(texts[a:b])
            if len(codes):
                each = self._by_word(words)[codes]
                doc, n = np.repeat(np.arange(b - a), counts), np.maximum(counts, 1)
                out[a:b, 0] = np.bincount(doc, weights=each, minlength=b - a) / n
                out[a:b, 1] = np.bincount(doc, weights=np.maximum(each - STRONG, 0), minlength=b - a) / n
        return out

    def score(self, texts: list[str], weights: tuple[float, float, float]) -> np.ndarray:
        e = self.evidence(texts)
        z = weights[0] + weights[1] * e[:, 0] + weights[2] * np.sqrt(e[:, 1])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([evidence[:, 0], np.sqrt(evidence[:, 1])])
    center, spread = x.mean(0), x.std(0) + 1e-12
    x = np.column_stack([np.ones(len(x)), (x - center) / spread])
    w = np.zeros(3)
    penalty = np.diag([0.0, ridge, ridge]) * len(x) + np.eye(3) * 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    slope = w[1:] / spread
    return float(w[0] - slope @ center), float(slope[0]), float(slope[1])


class Trained(NamedTuple):
    """A model, sent to the workers once, and the weights of its curve."""

    sent: Broadcast
    weights: tuple[float, float, float]


def _shared_tables(docs: DataFrame, class_grams: DataFrame) -> dict[str, tuple[Table, Table]]:
    """Counts and totals after contexts of class_grams: of fours how often all documents have them, of threes how many characters stand before them."""
    kind = "four long, four_context long, three long, three_context long"
    fours = cut(docs.select("text").mapInArrow(_shared_counts, f"{kind}, n long").groupBy("four", "four_context", "three", "three_context").agg(F.sum("n").alias("n")))
    after = lambda rows, context: rows.join(class_grams.select(context).distinct(), context, "left_semi")
    preceded = fours.groupBy("three", "three_context").agg(F.count_distinct("four").alias("n"))
    out = {}
    for name, rows in (("three", preceded), ("four", fours)):
        context = f"{name}_context"
        needed = cut(after(rows, context).groupBy(name, context).agg(F.sum("n").alias("n")))
        totals = needed.groupBy(context).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        out[name] = Table(_fetched(needed.groupBy(name).agg(F.sum("n").alias("n"))), name, ["n"]), Table(_fetched(totals), context, ["n", "kinds"])
        release(needed)
    release(fours)
    return out


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000) -> Trained | None:
    """Model of docs (doc_id, text) and labels (doc_id, toxic); None without labels of both classes in both folds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold() != 1).distinct()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    # at most max_labelled rows of two numbers; and one text for each
    labelled = cut(docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    keys = ["long", "long_context", "four_context", "three_context"]
    class_grams = cut(labelled.where(fold() == 0).select("text", "toxic").mapInPandas(_class_counts, ", ".join(f"{k} long" for k in keys) + ", toxic long, ordinary long").groupBy(*keys).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    rows = _fetched(class_grams.select("long", "long_context", "toxic", "ordinary"))
    if not (rows["toxic"] > 0).any() or not (rows["ordinary"] > 0).any():
        release(labelled, class_grams)
        return None
    rows = rows.assign(toxic_kinds=rows["toxic"] > 0, ordinary_kinds=rows["ordinary"] > 0, pooled_kinds=1)
    by_context = rows.groupby("long_context", as_index=False)[["toxic", "ordinary", "toxic_kinds", "ordinary_kinds", "pooled_kinds"]].sum()
    by_gram = rows.groupby("long", as_index=False)[["toxic", "ordinary"]].sum()
    model = Model(Table(by_gram, "long", ["toxic", "ordinary"]), Table(by_context, "long_context", [c for c in by_context if c != "long_context"]), _shared_tables(docs, class_grams))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = sent.value.evidence(pdf["text"].tolist())
            yield pd.DataFrame({"toxic": pdf["toxic"], "mean": e[:, 0], "strong": e[:, 1]})

    curve = _fetched(labelled.where(fold() == 2).select("text", "toxic").mapInPandas(evidence, "toxic int, mean double, strong double")).sort_values(["toxic", "mean", "strong"])
    release(labelled, class_grams)
    if curve["toxic"].nunique() < 2:
        return None
    return Trained(sent, fit_curve(curve[["mean", "strong"]].to_numpy(), curve["toxic"].to_numpy(float)))


def score_toxicity(docs: DataFrame, trained: Trained | None, *, name: str = "__sf_score") -> DataFrame:
    """docs with a score between 0 and 1."""
    if trained is None:
        return docs.withColumn(name, F.lit(0.0))
    sent, weights = trained

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *[sent.value.score(run, weights) for run in text_runs(texts, BLOCK_CHARS)]]))

    return docs.withColumn(name, score(whole_text()))
