"""Reading recordings, and views of the given tables in the shape of recordings, samples, events and epochs."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples a second of motion_v and epoch_v.
MOTION_RATE, EPOCH_RATE = 10.0, 64.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a temporary one where that is unset and all runs in one local JVM, else ValueError."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-strideframe-")


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: for small tables from which several others follow."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them: asks for that, between the steps of a long job whose results are stored()."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, whatever kind of store that is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _qualified(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths with their schemes, as the session resolves them; it is asked once for each store."""
    roots: dict[str, str] = {}

    def root(store: str, inside: str) -> str:
        if store + inside not in roots:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store + inside)
            roots[store + inside] = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
        return roots[store + inside]

    out = []
    for p in paths:
        if any(c in p for c in "*?[]{}"):
            raise ValueError(f"a pattern names no single run: {p}")
        store = re.match(r"(?:\w[\w+.-]*:(?://[^/]*)?)?", p)[0]
        rest = re.sub("/+", "/", p[len(store) :]).rstrip("/")
        out.append(root(store, "/" if rest.startswith("/") or store else ".") + rest.removeprefix("/"))
    return out


#: Paths of runs (a path and a few columns each) that may go to every task; more of them are joined by a shuffle.
MAX_BROADCAST_PATHS = 100_000


def load_recordings(spark: SparkSession, paths: list[str] | list[dict], *, max_broadcast_paths: int = MAX_BROADCAST_PATHS) -> DataFrame:
    """Sample tables of several runs as one (A1), by one scan of all paths; run_pos is the place of a row's path in the list.

    A path is a Parquet file or a folder of them; files and folders may lie in each other, and one that is named twice gives its rows twice. Instead of paths there may
    be rows of a manifest: dicts with path and other columns, which the samples then have too. Runs may lack columns of others (null), and
    have narrower types, which are widened. Columns that only folders' names hold are not read.
    """
    runs = [{"path": r} if isinstance(r, str) else dict(r) for r in paths]
    if not runs:
        raise ValueError("no paths")
    names = [n for n in runs[0] if n != "path"]
    full = _qualified(spark, [r["path"] for r in runs])
    rows = [(_plain(p), i, *[r[n] for n in names]) for i, (p, r) in enumerate(zip(full, runs, strict=True))]
    manifest = spark.createDataFrame(rows, ["_path", "run_pos", *names]).withColumn("run_pos", F.col("run_pos").cast("int"))
    named = set(full)
    outer = [p for p in dict.fromkeys(full) if not any(a in named for a in _folders(p))]
    scan = _scanned(spark, outer).withColumn("_file", _plain_column(F.col("_file")))
    # a row's file, and those of the folders it lies in that are as deep as a run's path
    parts = F.split("_file", "/")
    depths = F.array(*[F.lit(n) for n in sorted({len(r[0].split("/")) for r in rows})])
    above = F.transform(F.filter(depths, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = scan.withColumn("_path", F.explode(above))
    return known.join(F.broadcast(manifest) if len(rows) <= max_broadcast_paths else manifest, "_path").drop("_path", "_file")


def _scanned(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of all paths with the address of their _file: one scan, or one for each set of columns and types if types must be widened."""
    read = lambda ps, merge: spark.read.option("mergeSchema", merge).option("recursiveFileLookup", "true").parquet(*ps)
    with_file = lambda df: df.select("*", F.col("_metadata.file_path").alias("_file"))
    try:
        return with_file(read(paths, "true"))
    except Exception as e:
        if "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
    with ThreadPoolExecutor(16) as pool:  # a footer each
        schemas = list(pool.map(lambda p: read([p], "false").schema.json(), paths))
    parts = [with_file(read([p for p, own in zip(paths, schemas, strict=True) if own == kind], "false")) for kind in dict.fromkeys(schemas)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _folders(path: str) -> list[str]:
    """The folders that a path lies in."""
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(1, len(parts))]


_SLASHES = r"^(\w[\w+.-]*):/+"


def _plain(path: str) -> str:
    """A path with one slash after its scheme."""
    return re.sub(_SLASHES, r"\1:/", path)


def _plain_column(address: Column) -> Column:
    """Files' addresses likewise, with their escapes undone."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(address, _SLASHES, "$1:/"), r"\+", "%2B"))


def write_samples(samples: DataFrame, path: str, *, by: str = "recording_id", buckets: int = 64) -> None:
    """Parquet in folders of recordings by hash (A7); recordings of one folder lie together."""
    samples.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets))).repartition("bucket").sortWithinPartitions(by, "sample_idx").write.partitionBy("bucket").parquet(path)


def save_samples(samples: DataFrame, name: str, path: str, *, by: str = "recording_id", order: str = "sample_idx", buckets: int = 64) -> None:
    """samples as the table name, with its files at path, in buckets of recordings sorted by sample.

    Windows over recordings, or over their chunks, then run on the table without a shuffle. So do interval joins (cut_by_interval),
    if the session has spark.sql.requireAllClusterKeysForCoPartition off: the samples stay where they are, and only spans are sent.
    """
    samples.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, order).option("path", path).format("parquet").saveAsTable(name)


def save_annotations(annotations: DataFrame, path: str, *, by: str = "recording_id", buckets: int = 64) -> None:
    """Annotations as Parquet in folders of recordings by hash. Only the folders of recordings among the rows are written; what they had is replaced."""
    dealt = annotations.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def update_annotations(spark: SparkSession, path: str, recordings: DataFrame, replaced: Callable[[DataFrame], DataFrame], *, by: str = "recording_id", buckets: int = 64) -> None:
    """What replaced(old) gives takes the place of the annotations at path in the folders of recordings (by): old are the annotations there.

    The result is computed in full before anything is overwritten, so a lost run leaves the folders as they were, or as they are to be; the same
    update again changes nothing.
    """
    bucket = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in recordings.select(bucket).distinct().collect())  # at most as many as there are buckets
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    new = stored(replaced(old))
    left = {r[0] for r in new.select(bucket).distinct().collect()}
    if not left <= set(touched):
        raise ValueError("new annotations of other recordings than the given ones")
    save_annotations(new, path, by=by, buckets=buckets)
    for b in set(touched) - left:  # nothing is left of these, so nothing was written
        delete(spark, f"{path}/bucket={b}")


def motion_v(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """A recording of each supplier: its line items in time order are the samples. The divisor of x keeps means off the edges of rounding.

    With columns only these values. Line items that are equal up to the last column these are made of have equal values, so they are put in order by
    the columns up to that one; what is shuffled has no others.
    """
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_suppkey", "recording_id")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    cols = {"x": F.col("l_extendedprice") / 97.13579, "y": F.col("l_quantity") * 20, "lx": F.col("l_discount") * 10000, "ly": F.col("l_tax") * 10000, "rx": F.col("l_quantity") * F.col("l_tax") * 100, "ry": F.col("l_extendedprice") * F.col("l_discount") / 10}
    if columns is not None:
        made_of = {"x": "l_extendedprice", "y": "l_quantity", "lx": "l_discount", "ly": "l_tax", "rx": "l_tax", "ry": "l_discount"}
        order = order[: max(order.index(made_of[c]) for c in columns) + 1]
        cols = {c: cols[c] for c in columns}
    # values are made after the window, whose shuffle then has only what they are made of
    idx = t.withColumn("_n", F.row_number().over(Window.partitionBy("recording_id").orderBy(*order)))
    return idx.select("recording_id", (F.col("_n") - 1).cast("long").alias("sample_idx"), *[v.alias(k) for k, v in cols.items()])


def swing_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each customer: onset in days, kind L, R or reset by order status, length by price."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderstatus") == "O", "L").when(F.col("o_orderstatus") == "F", "R").otherwise("reset")
    return o.select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("event_id"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400.0).alias("onset"), kind.alias("kind"), (F.col("o_totalprice") / 997).alias("steplen_m"))


def session_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of each customer: from its first to its last order, in days; the session is the nation."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("recording_id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("recording_id"), F.col("c_nationkey").alias("session_id"))
    day = lambda x: F.unix_seconds(F.col(x).cast("timestamp")) / 86400.0
    return o.join(c, "recording_id").select("session_id", "recording_id", day("a").alias("start"), (day("b") - day("a")).alias("length"))


def cue_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user: seconds since 2024, type and value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("recording_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("onset"), F.col("event_type").alias("description"), "value")


def epoch_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch of 64 samples of each vector; its label is the channel."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("cycle_id"), F.col("label").alias("ch_name"), F.col("embedding").cast("array<double>").alias("signal"))
