"""SimHash components, whitening and the filter audit against brute force."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from strideframe.llm import common, filter_audit, golay, near_dup, simhash_dup, whitening

ODD = [(1, "a b"), (2, None), (3, ""), (4, "x" * 30_000), (5, "a  B\n"), (5, "a b"), (None, "null id"), (None, "a b"), (7, "\x1c\x00 odd 　 spaces"), (8, " \t\n"), (8, " \t\n"), (9, "word " * 40_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, 0, "c", 1.0) for i, t in ODD], "doc_id long, text string, lang string, print int, component string, mask double")


def test_golay_keys_join_words_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    assert np.bitwise_count(golay.tables()[1]).max() == 3 and len(np.unique(golay.tables()[1])) == 2048
    keys, there = golay.keys(words)
    assert set(there.sum(1)) <= {1, 6}
    for bits in (1, 2):
        for places in itertools.combinations(range(23), bits):
            other, has = golay.keys(words ^ sum(1 << p for p in places))
            assert ((keys[:, :, None] == other[:, None, :]) & there[:, :, None] & has[:, None, :]).any((1, 2)).all()


def test_all_three_bit_differences_share_a_key():
    x = np.random.default_rng(2).integers(0, 2**64, 4, dtype=np.uint64)
    flips = np.array([sum(1 << p for p in c) for n in (1, 2, 3) for c in itertools.combinations(range(64), n)], np.uint64)
    keys, there = simhash_dup.segment_keys(x)
    assert there.sum(1).max() <= 42
    for k, h, p in zip(keys, there, x, strict=True):
        other, has = simhash_dup.segment_keys(p ^ flips)
        assert (np.isin(other, k[h]) & has).any(1).all()


def brute_fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows: list[tuple], prints: list[int]) -> list:
    distinct = np.array(sorted(set(prints)), np.uint64)
    part = np.arange(len(distinct))
    for i, x in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ x) <= 3):
            part[part == part[j]] = part[i]
    of = {int(p): int(part[i]) for i, p in enumerate(distinct)}
    least: dict = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[of[p]] = min(least.get(of[p], i), i)
    return [least.get(of[p]) for p in prints]


@pytest.mark.parametrize("size", [{}, {"block": 7}, {"block": 3, "max_broadcast_keys": 0}])
def test_simhash_components_equal_brute_force(spark, size):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = list(ODD)
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            rows.append((len(rows) + 10, " ".join(base)))
            if rng.random() < 0.7:
                base[rng.randrange(120)] = rng.choice(words)
    rows += [(i, t) for i, t in rows[20:30]] + [(1000 + i, rows[-1][1]) for i in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    prints = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([(i is None, i or 0) for i, _ in rows], prints, brute_components(rows, prints), strict=True), key=str)
    got = simhash_dup.simhash_components(df, **size).collect()
    assert sorted((((r.doc_id is None, r.doc_id or 0), r.print % 2**64, r.component_id) for r in got), key=str) == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})  # something was linked


def test_large_buckets_equal_brute_force(spark):
    """A ball of fingerprints around one, most further than three bits from it, in blocks far smaller than its buckets."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**64, 1, dtype=np.uint64)[0]
    ball = {int(centre)}
    for _ in range(700):
        p = int(centre)
        for at in rng.choice(64, rng.integers(1, 8), replace=False):
            p ^= 1 << int(at)
        ball.add(p)
    prints = sorted(ball)
    rows = [(i, str(p)) for i, p in enumerate(prints)]
    heads = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), 1) for p in prints], "print long, n long")
    links, members = simhash_dup.fingerprint_links(heads, block=20)
    known = simhash_dup.components(links)
    links = links.unionByName(simhash_dup._across(members, known, 20, 3))
    assert links.count() == links.where(F.expr("bit_count(a ^ b) <= 3")).count()
    final = {r.node % 2**64: r.component for r in simhash_dup.components(links).collect()}
    got = [final.get(p, p) for p in prints]
    want = brute_components(rows, prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) > 1


def test_simhash_takes_odd_and_empty_tables(odd):
    rows = simhash_dup.simhash_components(odd).collect()
    assert len(rows) == len(ODD) and simhash_dup.simhash_components(odd.limit(0)).count() == 0
    assert {r.component_id for r in rows if r.doc_id is None} == {None, 1}  # "null id" is alone, "a b" isn't
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 8)} == {2}


def brute_whitening(vectors: list) -> tuple[dict, np.ndarray, np.ndarray, list]:
    kept = [(k, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for k, v in vectors]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / n**3 for j in range(d)] for i in range(d)])
    e, p = np.linalg.eigh(cov)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for _, x in kept]
    z = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for _, x in kept])
    return n, e[::-1], p[:, ::-1], z, deviation


@pytest.mark.parametrize("spread", [0.2, 3e9])
def test_whitening_equals_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) * spread
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)] + [(100 + i, base[3].astype(np.float32).tolist()) for i in range(60)] + [(3, base[3].astype(np.float32).tolist()), (None, base[4].astype(np.float32).tolist())]
    dropped = [(200, None), (201, []), (202, [1.0, 2.0]), (203, [None] + [1.0] * 5), (204, [float("nan")] + [1.0] * 5), (205, [float("inf")] * 6), (206, [1e30] * 6)]
    df = spark.createDataFrame([(k, v, 5) for k, v in rows + dropped], "vec_id long, embedding array<float>, component int").repartition(4)
    n, e, p, z, deviation = brute_whitening(rows)
    out, model = whitening.whiten(df)
    got = out.toPandas()
    assert len(got) == len(rows) * 6 and set(got.n) == {n} == {80}
    assert got.identity_error.max() < 1e-6 and model.sums[0] == sum({tuple(v): int(np.floor(64 * v[0])) + 1_000_000 for _, v in rows}.values())
    by = {(None if pd.isna(k) else int(k), c): g for (k, c), g in got.groupby(["vec_id", "component"], dropna=False)}
    sign = {c: np.sign(float(by[0, c].whitened.iloc[0]) * (z[0] @ p[:, c - 1])) for c in range(1, 7)}
    for (k, _), y, dev in zip(rows, z, deviation, strict=True):
        for c in range(1, 7):
            r = by[k, c]
            assert set(r.deviation) == {dev} if dev < 2**63 else r.deviation.isna().all()
            assert np.allclose(r.whitened * sign[c], y @ p[:, c - 1] / np.sqrt(e[c - 1]), rtol=1e-6, atol=1e-8)
            assert np.allclose(r.explained, e[c - 1] / e.sum(), rtol=1e-9)


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind))[0].count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind))[0].count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind))[0].count() == 0  # one distinct vector
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], kind)
    got = whitening.whiten(line)[0].toPandas()  # one direction only
    assert set(got.component) == {1} and np.allclose(got.explained, 1) and np.isclose((got.whitened**2).mean(), 1)


def brute_audit(rows: list[tuple], labels: list[tuple]) -> dict:
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[c] == 1 and i is not None} for c in (0, 1))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                out[part, "".join(order), step] = [len(left) - len(gone), len(gone), sum(d[1][f] for d in mine) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
                shapley[f] += len(gone)
                left = [d for d in left if not d[1][f]]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "d#", "eps", *[f"w{i}" for i in range(300)]]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([8, 300])]) for _ in range(rng.choice([3, 150, 260]))), rng.choice(["en", "de", "", None])) for i in range(250)]
    rows += [(rng.randrange(600), rows[rng.randrange(20)][1], rng.choice(["en", "fr"])) for _ in range(200)] + [(i, t, "en") for i, t in ODD] + rows[:5] + [(None, rows[0][1], None)]
    labels = [(rng.randrange(620), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(500)] + [(None, 1, 1)]
    df = spark.createDataFrame([(i, t, lang, 1, 2) for i, t, lang in rows], "doc_id long, text string, lang string, h int, n int").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    for most in (filter_audit.MAX_COUNTERS, 1 << 16):
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit_filters(df, marks, max_counters=most).collect()}
        assert got == want
    assert filter_audit.audit_filters(df.limit(0), marks).count() == 0
    assert filter_audit.audit_filters(df, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_sketch_clears_unique_texts_only(spark):
    texts = [(f"text {i}",) for i in range(40_000)] + [(f"text {i}",) for i in range(0, 40_000, 10)] + [("hot",)] * 20_000
    df = spark.createDataFrame(texts, "text string").repartition(7)
    sketch = filter_audit.text_sketch(df)
    assert len(sketch) * 4 >= 8 * len(texts)
    pdf = df.select("text", *filter_audit.hashes(F.col("text"))).toPandas()
    pdf["maybe"] = filter_audit.maybe_repeated(sketch, pdf.h.to_numpy(), pdf.g.to_numpy())
    repeated = pdf.duplicated("text", keep=False)
    assert pdf.maybe[repeated].all() and pdf.maybe[~repeated].mean() < 0.05


def test_query_of_the_given_embeddings(spark):
    from strideframe.llm import queries

    got = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    x = np.array([[np.floor(64 * float(c)) for c in v] for _, v in rows])
    e = np.linalg.eigvalsh(np.cov(np.unique(x, axis=0).T, bias=True))[::-1]
    assert len(got) == 16 * len(rows) and got.identity_error.max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), e[:16] / e.sum(), rtol=1e-9)


def generated_rows(spark, since: int) -> tuple[int, int]:
    """Rows that plans from execution since on made by inline(), and how many plans there are."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    rows, last = 0, int(store.executionsCount())
    for k in range(since, last):
        graph, values = store.planGraph(store.executionsList().apply(k).executionId()), store.executionMetrics(store.executionsList().apply(k).executionId())
        for i in range(graph.allNodes().size()):
            node = graph.allNodes().apply(i)
            for m in range(node.metrics().size()) if node.name() == "Generate" else []:
                if node.metrics().apply(m).name() == "number of output rows" and values.contains(node.metrics().apply(m).accumulatorId()):
                    rows += int(values.apply(node.metrics().apply(m).accumulatorId()).replace(",", ""))
    return rows, last


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_read_links_once_a_step(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few, raising=False)
    rng = np.random.default_rng(4)
    pairs = sorted({(int(max(x)), int(min(x))) for x in rng.integers(0, 400, (1500, 2)) if x[0] != x[1]} | {(k + 1, k) for k in range(1000, 1030)})
    _, before = generated_rows(spark, 10**9)
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    rows, _ = generated_rows(spark, before)
    want: dict = {}
    for a, b in pairs:
        own = want.get(a, {a}) | want.get(b, {b})
        want |= dict.fromkeys(own, own)
    assert got == {k: min(own) for k, own in want.items()}
    assert len(pairs) <= rows < 16 * len(pairs)


def test_lookup_of_few_rows_takes_no_shuffle(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(50)], "key long, v long")
    table = common.cut(rows.groupBy("key").agg(F.count("*").alias("n")))
    few = common.lookup(rows, table, "key")
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    wide = spark.range(20_000).select(F.when(F.col("id") < 6000, F.lit(-1)).otherwise(F.col("id") % 9000).alias("key"), F.col("id").alias("v"))
    table = common.cut(wide.groupBy("key").agg(F.count("*").alias("n")))
    for df, got in ((rows, few), (wide, common.lookup(wide, table, "key"))):
        want = df.join(df.groupBy("key").agg(F.count("*").alias("n")), "key")
        assert sorted(map(tuple, got.select("key", "v", "n").collect())) == sorted(map(tuple, want.select("key", "v", "n").collect()))
