"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only. Words are lower-cased runs of letters and digits; shingles are SHINGLE words. A text's shingles are cut
into steps of STEP starts; a window is two neighbouring steps, so a run of STEP + 1 shingles lies whole in some window.
Each window has BANDS minima, of its shingle hashes hashed again with the band's number (one row a band). Templates are cut into pieces
of at most STEP + 1 shingles, each with minima of its own. A piece of k shingles inside a window of 2 * STEP shares the
minimum of a band with probability k / (2 * STEP), so a piece of 3 or more is retrieved with probability over 0.9994. Shorter
templates, of less than SHINGLE + 2 words, could be missed and are rejected.
Retrieved templates are verified exactly: the share of a template's distinct shingles that the windows around a retrieved one
(whether retrieved or not), from one with such a shingle on and no further than the template is long, contain must reach the
threshold. The windows around are computed again from the texts with retrieved windows. Templates are whole license texts and the
short notices that name them.

Windows are keyed by id and text: rows of one id (or of no id) with different texts are scanned, and reported, apart; repeated rows
are reported once. Null and empty texts, and texts of less than SHINGLE words, have no shingles and no matches. Empty tables give
empty results. Other columns of the input are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, whole_text
from .license_texts import LICENSE_TEXTS, NOTICES

SHINGLE, STEP, BANDS = 3, 4, 16

TEMPLATES = [*LICENSE_TEXTS, *NOTICES]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; blanks at the ends give no words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """Hashes of all runs of SHINGLE words."""
    runs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))


def computed(df: DataFrame, name: str, value: Column, *keep: str | Column) -> DataFrame:
    """keep and value, evaluated once a row: the optimizer doesn't copy it into the expressions (and lambdas) that use it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def band_minima(rows: DataFrame, hashes: str, length: int, *keep: str) -> DataFrame:
    """keep, band and minimum: the least of at most length hashes, hashed again for each band; nulls don't count."""
    wide = rows.select(*keep, *[F.get(F.col(hashes), F.lit(k)).alias(f"h{k}") for k in range(length)])
    banded = wide.select("*", F.explode(F.array(*[F.lit(b) for b in range(BANDS)])).alias("band"))
    again = lambda h: F.when(h.isNotNull(), F.xxhash64(h, "band"))
    return banded.select(*keep, "band", F.least(*[again(F.col(f"h{k}")) for k in range(length)]).alias("minimum"))


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, at (first shingle) and h (shingle hashes) of every window of docs (doc_id, text)."""
    words = computed(docs.select("doc_id", whole_text().alias("text")), "w", words_of(F.col("text")), "doc_id", F.xxhash64("text").alias("text_key"))
    hashed = computed(words, "h", shingle_hashes(F.col("w")), "doc_id", "text_key").where(F.size("h") > 0)
    steps = F.sequence(F.lit(0), F.greatest(F.size("h") - STEP - 1, F.lit(0)), F.lit(STEP))
    return hashed.select("doc_id", "text_key", F.explode(F.transform(steps, lambda at: F.struct(at.alias("at"), F.slice("h", at + 1, F.lit(2 * STEP)).alias("h")))).alias("x")).select("doc_id", "text_key", "x.at", "x.h")


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """license, shingles (distinct), n_words of a short list of templates."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in templates])))
    words = computed(rows, "words", words_of(F.col("text")), "license")
    return words.select("license", F.size("words").alias("n_words"), F.array_distinct(shingle_hashes(F.col("words"))).alias("shingles"))


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, max_broadcast_hits: int = 500_000) -> DataFrame:
    """doc_id, license, first_word (where its first window begins), containment of every license found in docs (doc_id, text)."""
    short = [name for name, text in templates or TEMPLATES if len(re.findall(r"[^\W_]+", text)) < SHINGLE + 2]
    if short:
        raise ValueError(f"templates of less than {SHINGLE + 2} words: {', '.join(short)}")
    known = template_table(docs.sparkSession, templates or TEMPLATES)
    size = F.size("shingles")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(STEP + 1)), lambda i: F.greatest(F.least(i, size - STEP), F.lit(1)))
    pieces = known.select("license", F.explode(F.transform(starts, lambda i: F.slice("shingles", i, F.lit(STEP + 1)))).alias("piece")).where(F.size("piece") > 0)
    keys = band_minima(pieces, "piece", STEP + 1, "license").distinct()

    longest = max(len(t.split()) for _, t in templates or TEMPLATES) * 2 + 2 * STEP
    minima = band_minima(_windows(docs), "h", 2 * STEP, "doc_id", "text_key", "at")
    found = cut(minima.join(F.broadcast(keys), ["band", "minimum"]).select("doc_id", "text_key", "license", "at").distinct())  # keys: as few as the given templates have pieces
    block = F.floor(F.col("at") / longest)
    hit = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    hits = found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "license", F.explode(F.array(block - 1, block, block + 1)).alias("block")).distinct()
    wanted = cut(hits.select("hit_id", "hit_key").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= max_broadcast_hits else wanted  # two numbers a text with a hit
    texts = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64(whole_text())).join(wanted, hit, "left_semi").dropDuplicates(["doc_id", "text_key"])
    around_hits = _windows(texts).withColumn("own", block).join(hits, hit & (F.col("own") == F.col("block"))).join(F.broadcast(known), "license")
    onward = around_hits.where(F.arrays_overlap("h", "shingles")).select("doc_id", "text_key", "license", "at", "h", "shingles", "n_words").withColumn("reach", F.col("n_words") + 2 * STEP)
    near = Window.partitionBy("doc_id", "text_key", "license").orderBy("at").rangeBetween(0, longest)
    around = F.flatten(F.transform(F.filter("near", lambda x: x["at"] <= F.col("at") + F.col("reach")), lambda x: x["h"]))
    verified = onward.withColumn("near", F.collect_list(F.struct("at", "h")).over(near)).withColumn("containment", F.size(F.array_intersect("shingles", around)) / size).where(F.col("containment") >= threshold)
    best = F.max(F.struct("containment", (-F.col("at")).alias("minus_at")))
    return verified.groupBy("doc_id", "text_key", "license").agg(best.alias("b")).select("doc_id", "license", (-F.col("b.minus_at")).cast("long").alias("first_word"), F.round("b.containment", 6).alias("containment"))
