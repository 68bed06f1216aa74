"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark ML transformers only. The model is trained on a small labelled table of URLs (by default
labelled_urls(), made of general vocabulary) whose size is bounded by the caller. README says how many of its held-out
urls, and of urls of words that the model never met, are judged rightly.

A null url, or one without "://", has empty host and path, which no rule fits; its n-grams are none, and the verdict is
that of the model's constant part. Repeated urls get equal results. Empty tables give empty results. Other columns pass
through; names that begin with __sf_ are taken.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. rules: (host and path, allow or block); a short list, tried in turn."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def char_ngrams(text: Column, sizes: tuple[int, ...], mark: str) -> Column:
    """All character n-grams of a text with its ends marked, each prefixed by mark; none of an empty text."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*map(grams, sizes)))


def with_ngrams(urls: DataFrame, url: str) -> DataFrame:
    out = urls.withColumn("__sf_host", host_of(F.col(url))).withColumn("__sf_path", path_of(F.col(url)))
    return out.withColumn("__sf_grams", F.concat(char_ngrams(F.col("__sf_host"), (3, 4, 5), "h"), char_ngrams(F.col("__sf_path"), (3,), "p")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block) and held_out of the small labelled table; every fifth url is held out."""
    text = "\n".join(f"{int(label)}{int(held_out)}{url}" for url, label, held_out in url_words.labelled())
    rows = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("row"))  # one literal: thousands take the driver long to analyse
    return rows.select(F.substring("row", 3, 10_000).alias("url"), F.substring("row", 1, 1).cast("double").alias("label"), (F.substring("row", 2, 1) == "1").alias("held_out"))


def train_url_model(labelled: DataFrame, *, features: int = 1 << 16, penalty: float = 1e-3) -> PipelineModel:
    """Fits labelled (url, label); both labels weigh the same, however many urls they have."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 0.5 / max(1, counts.get(1, 0))).otherwise(0.5 / max(1, counts.get(0, 0))) * sum(counts.values())
    labelled = labelled.withColumn("__sf_weight", weight)
    stages = [HashingTF(inputCol="__sf_grams", outputCol="__sf_features", numFeatures=features, binary=True), LogisticRegression(featuresCol="__sf_features", labelCol="label", weightCol="__sf_weight", regParam=penalty, maxIter=40, standardization=False, rawPredictionCol="__sf_raw", probabilityCol="__sf_probability", predictionCol="__sf_prediction", aggregationDepth=2)]
    return Pipeline(stages=stages).fit(with_ngrams(labelled, "url").coalesce(1))


def judge_urls(urls: DataFrame, model: PipelineModel, rules: list[tuple[str, str]], *, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """urls with a struct __sf_verdict: host, path, rule, score (of blocking) and verdict."""
    scored = model.transform(with_ngrams(urls, url))
    score = F.element_at(vector_to_array(F.col("__sf_probability")), 2)
    rule = rule_for(F.col("__sf_host"), F.col("__sf_path"), rules)
    verdict = F.coalesce(F.col("__sf_rule.verdict"), F.when(F.col("__sf_score") >= threshold, "block").otherwise("allow"))
    out = scored.withColumn("__sf_rule", rule).withColumn("__sf_score", score)
    return out.select(*[F.col(f"`{c}`") for c in urls.columns], F.struct(F.col("__sf_host").alias("host"), F.col("__sf_path").alias("path"), F.col("__sf_rule.rule").alias("rule"), F.col("__sf_score").alias("score"), verdict.alias("verdict")).alias("__sf_verdict"))
