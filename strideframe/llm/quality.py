"""Quality rules of documents and of their hosts.

Each text gets its word counts and a base verdict. Failures of the base rules are then summed by host (the source column); a
beta distribution is fitted to the hosts' failure rates by its moments, and each host's rate is shrunk to
(failures + alpha) / (documents + alpha + beta). A host whose shrunk rate reaches max_host_rate is rejected with all its documents.

Null and empty texts have no words and fail. A null source is a host of its own. Repeated rows count as often as they
occur. With one host, or rates that are all equal or too spread for a beta distribution, the prior is prior_weight documents
at the mean rate. Empty tables give empty results. Extra columns pass through or, in the query, are not read; names that
begin with __sf_ are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, text_blocks, text_runs, whole_text
from .shingles import windows, word_hashes

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
SALTS = 16
#: Hosts (a name and a rate each) that may go to every task.
MAX_BROADCAST_HOSTS = 200_000


def repeat_words(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them stand in k-word windows that the text has twice or more."""
    h, counts = word_hashes(texts)
    z, doc, at = windows(h, counts, k)
    whole = counts[doc] >= k
    z, doc, at = z[whole], doc[whole], at[whole]
    order = np.lexsort((z, doc))
    same = (z[order][1:] == z[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(z), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return counts, np.bincount(np.repeat(np.arange(len(texts)), counts)[covered], minlength=len(texts))


def metrics(texts: list[str]) -> pd.DataFrame:
    out = []
    for a, b in text_blocks(texts):
        counts, repeats = repeat_words(texts[a:b])
        for t, n, r in zip(texts[a:b], counts, repeats, strict=True):
            lines = [x for x in t.split("\n") if x.strip(SPACES)] if "\n" in t else []
            out.append((n, len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), r))
    return pd.DataFrame(out, columns=[x.split()[0] for x in METRICS.split(", ")])


def text_metrics(text: Column) -> Column:
    """The struct of METRICS of each text."""

    @F.arrow_udf(METRICS)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [metrics(run) for run in text_runs(texts, 1 << 20)]
            table = pd.concat(parts) if parts else metrics([])
            yield pa.StructArray.from_arrays([pa.array(table[c], pa.int64()) for c in table], list(table))

    return measured(text)


def host_rates(base: DataFrame, *, host: str, failed: str, prior_weight: float = 10.0) -> DataFrame:
    """__sf_host, n_docs, n_failed and shrunk rate of each host of base; partial sums by a salt first, so that no host is one task's work."""
    salted = base.groupBy(F.col(host).alias("__sf_host"), F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("__sf_salt")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    hosts = salted.groupBy("__sf_host").agg(F.sum("n").alias("n_docs"), F.sum("f").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"))
    room = F.col("mean") * (1 - F.col("mean"))
    fits = (F.col("var") > 1e-12) & (F.col("var") < room)
    weight = F.when(fits, room / F.when(fits, F.col("var")) - 1).otherwise(F.lit(float(prior_weight)))
    prior = prior.select(F.struct((F.col("mean") * weight).alias("alpha"), ((1 - F.col("mean")) * weight).alias("beta")).alias("prior")).scalar()
    return hosts.select("__sf_host", "n_docs", "n_failed", ((F.col("n_failed") + prior["alpha"]) / (F.col("n_docs") + prior["alpha"] + prior["beta"])).alias("host_rate"))


def measured(docs: DataFrame, *, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """docs with the struct __sf_m of metrics and whether the base rules fail (__sf_failed)."""
    out = docs.withColumn("__sf_m", text_metrics(whole_text()))
    m = F.col("__sf_m")
    return out.withColumn("__sf_failed", (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"]))


def judged(measures: DataFrame, *, host: str = "source", max_host_rate: float = 0.5, prior_weight: float = 10.0, max_broadcast_hosts: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """Rows of measured() (with doc_id and host, whatever other columns are left) with a struct __sf_quality: the metrics, base_failed, host_rate and kept.

    Hosts are few: they are counted, and go to every task if they are at most max_broadcast_hosts; more of them are joined by host and salt.
    """
    columns = [c for c in measures.columns if c not in ("__sf_m", "__sf_failed")]
    m = F.col("__sf_m")
    hosts = cut(host_rates(measures.select("doc_id", F.col(host).alias("__sf_source"), "__sf_failed"), host="__sf_source", failed="__sf_failed", prior_weight=prior_weight).select("__sf_host", "host_rate"))
    same = F.col(host).eqNullSafe(F.col("__sf_host"))
    if hosts.count() <= max_broadcast_hosts:
        joined = measures.join(F.broadcast(hosts), same, "left")
    else:
        salts = hosts.withColumn("__sf_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measures.withColumn("__sf_row_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salts, same & (F.col("__sf_row_salt") == F.col("__sf_salt")), "left")
    names = [x.split()[0] for x in METRICS.split(", ")]
    verdict = F.struct(*[m[n].alias(n) for n in names], F.col("__sf_failed").alias("base_failed"), F.col("host_rate"), (~F.col("__sf_failed") & (F.col("host_rate") < max_host_rate)).alias("kept"))
    return joined.select(*[F.col(f"`{c}`") for c in columns], verdict.alias("__sf_quality"))


def quality_rules(docs: DataFrame, *, host: str = "source", min_words: int = 10, max_repeat_percent: int = 20, max_host_rate: float = 0.5, prior_weight: float = 10.0) -> DataFrame:
    """docs with a struct __sf_quality. Texts are measured once: rows and measures are kept in the shared folder, from which the hosts' rates and the verdicts follow. Callers that don't need the texts cut() measured() without them."""
    rows = scratch(measured(docs, min_words=min_words, max_repeat_percent=max_repeat_percent))
    return judged(rows, host=host, max_host_rate=max_host_rate, prior_weight=prior_weight)


def kept_documents(docs: DataFrame, *, host: str = "source", min_words: int = 10, max_repeat_percent: int = 20, **options) -> DataFrame:
    """The rows of docs that neither fail the base rules nor stand on a rejected host; texts of failing rows aren't even kept for the verdict of their hosts."""
    m = measured(docs, min_words=min_words, max_repeat_percent=max_repeat_percent)
    rows = scratch(m.withColumn("text", F.when(~F.col("__sf_failed"), F.col("text"))))
    return judged(rows, host=host, **options).where("__sf_quality.kept").drop("__sf_quality")
