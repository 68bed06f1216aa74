"""The text operators against brute force, on small tables with nulls, empties, repeats, very long texts and clashing columns."""

import collections
import hashlib
import html
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideframe.llm import bpe, html_main, jpeg, license_scan, media, near_dup, packing, quality, queries, token_matrix, tokens, toxicity, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [(1, "a b"), (2, None), (3, ""), (4, "x" * 30_000), (5, "<|endoftext|> hi  \n\n é 日本 it's"), (5, "a b"), (None, "null id"), (7, "\x1c\x00 odd 　 spaces")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "z", 0) for i, t in ODD], "doc_id long, text string, score string, band int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_operator_takes_odd_and_empty_tables(spark, odd):
    for df in (odd, odd.limit(0)):
        n = df.count()
        assert bpe.encode_documents(df, tokenizer=PATH).count() == n
        assert near_dup.near_duplicates(df).count() == n
        assert quality.quality_rules(df.withColumn("source", F.lit(None).cast("string"))).count() == n
        assert media.read_avi(media.write_avi(df)).count() == n
        assert license_scan.scan_licenses(df).count() == 0
        assert packing.pack_documents(df, tokenizer=PATH).agg(F.sum("length")).first()[0] == (None if not n else sum(len(tokens.word_encoder(PATH).encode(t or "")) // 4 + 1 for _, t in ODD))
        assert token_matrix.token_matrix(df, tokenizer=PATH).count() >= min(n, 1)
        labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
        assert toxicity.score_toxicity(df, toxicity.train(df, labels)).count() == n
    assert near_dup.one_of_each(odd).count() == 6  # the two "a b" are copies, and so are null and empty


def test_bpe_equals_the_library(spark, docs, odd):
    t = Tokenizer.from_file(PATH)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        df = df.distinct()
        numbered = {k: r.text or "" for k, r in enumerate(df.collect())}
        again = spark.createDataFrame(list(numbered.items()), "doc_id long, text string")
        for got in (bpe.encode_documents(again, tokenizer=PATH, chunk_bytes=100_000), bpe.encode_documents(again, tokenizer=PATH, chunk_bytes=50_000, region=3)):
            rows = got.collect()
            assert len(rows) == len(numbered)
            for r in rows:
                ids = t.encode(numbered[r.doc_id], add_special_tokens=False).ids
                assert np.frombuffer(r.ids, "<u4").tolist() == ids
                assert r.decoded == t.decode(ids, skip_special_tokens=False)


def test_words_of_all_characters_equal_the_library(spark):
    encoder = tokens.word_encoder(PATH)
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}  {chr(c)}'s<|endoftext|>{chr(c)}!" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["<|endoftext|><|endoftext|> x", " <|endoftext|", "<|endoftext|>", "  \n\n  a", "it's we'll 'S'd", "a\u0301b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    rows = df.select("i", bpe.split_words(F.col("text"), tokens.special_tokens(PATH)).alias("w"), bpe.known_characters(F.col("text")).alias("known")).collect()
    assert all("".join(r.w) == texts[r.i] for r in rows)
    differ = [texts[r.i] for r in rows if r.known and r.w != encoder.words(texts[r.i])]
    assert not differ and sum(r.known for r in rows) > 30_000, (len(differ), [hex(ord(t[1])) for t in differ[:20]])


def test_bpe_of_words_with_many_ids(spark):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = {1: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), 2: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60_000)), 3: "a short one"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_documents(df, tokenizer=PATH).collect()}
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].decoded == text
    assert len(got[1].ids) > 4 * 65_535 and len(got[2].ids) > 4 * 65_535


def test_decode_join(spark):
    t = Tokenizer.from_file(PATH)
    texts = {1: "Größe — it's 日本", 2: "", 3: "<|endoftext|>end"}
    df = spark.createDataFrame([(k, t.encode(v, add_special_tokens=False).ids) for k, v in texts.items()], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(df, bpe.piece_table(spark, PATH)).collect()} == texts


def exact_probability_jaccard(a: dict, b: dict) -> float:
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})


def brute_classes(texts: dict, weigh=lambda n: 1) -> dict:
    """Classes by the probability Jaccard similarity of shingles that weigh as much as weigh(how often the text has them)."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {x: weigh(n) for x, n in collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))).items()} if w else {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def similar(a: dict, b: dict) -> bool:
        common = len(a.keys() & b.keys())
        if set(a.values()) | set(b.values()) == {1}:
            return common >= 0.8 * len(a.keys() | b.keys())
        return common > 0 and exact_probability_jaccard(a, b) >= 0.8

    for a, b in itertools.combinations(texts, 2):
        if texts[a] == texts[b] or (sets[a] and similar(sets[a], sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def damped(n: int) -> float:
    return 1 + math.log10(n)


def test_near_duplicates_equal_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    n = max(texts) + 1
    for _ in range(4):  # chains of edited copies
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(12):
            texts[n] = " ".join(base)
            n += 1
            base[rng.randrange(150)] = rng.choice(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()} == brute_classes(texts, damped)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df, weighting="set").collect()} == brute_classes(texts)


def test_near_copies_with_a_repeated_line_equal_brute_force(spark):
    rng = random.Random(4)
    texts = {}
    for i in range(60):  # a line of 20 words stands once in one text and 20 times in the other; or one word is said 200 times more
        base = [f"t{i}w{k}" for k in range(200 if i < 20 else 100)]
        at = rng.randrange(160)
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(base[:at] + base[at : at + 20] * 20 + base[at + 20 :] if i < 20 else base + ["end"] * 200)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    assert all(want[i] == i // 2 * 2 for i in texts)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df, weighting="set").collect()} == want
    assert brute_classes(texts, damped) == want  # damped counts leave such copies near, plain ones don't
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()} == want
    assert len(set(brute_classes(texts, float).values())) > 60


@pytest.mark.parametrize("words", [60, 200, 1000])
def test_recall_of_weighted_banding(words):
    """Of pairs whose damped similarity is 0.8 to 0.95, with lines repeated 2 to 12 times: how many meet in a band."""
    rng = random.Random(words)
    pairs = []
    while len(pairs) < 200:
        base = [f"v{rng.randrange(10**9)}" for _ in range(words)]
        at = rng.randrange(words - 12)
        line = base[at : at + 12]
        near = list(base)
        for _ in range(rng.randrange(1, 2 + words // 60)):
            near[rng.randrange(words)] = "edit"
        a, b = (" ".join(x[:at] + line * rng.randrange(2, 13) + x[at:]) for x in (base, near))
        similarity = near_dup.probability_jaccard(*near_dup.shingle_sets([a, b], weighted=True), near_dup.WEIGHTS["log"])
        if 0.8 <= similarity < 0.95:
            pairs.append((a, b))
    keys, _ = near_dup.signatures([t for p in pairs for t in p], "log")
    met = sum(bool({*keys[2 * i].tolist()} & {*keys[2 * i + 1].tolist()}) for i in range(len(pairs)))
    print("pairs met", met, "of", len(pairs))
    assert met >= 199


def test_shingles_weighed_by_their_counts_equal_brute_force(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(80):  # a line is repeated in both texts, a little more often in one
        base = [f"c{i}w{k}" for k in range(60)]
        texts[2 * i] = " ".join(base + base[10:30] * 3)
        texts[2 * i + 1] = " ".join(base[: 60 - rng.randrange(12)] + base[10:30] * (3 + rng.randrange(4)))
    count = lambda t: collections.Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))
    want, near = set(), 0
    for i in range(80):
        a, b = texts[2 * i], texts[2 * i + 1]
        exact = exact_probability_jaccard(count(a), count(b))
        assert abs(near_dup.probability_jaccard(*near_dup.shingle_sets([a, b], weighted=True)) - exact) < 1e-9
        near += exact >= 0.8
        want |= {2 * i} if exact >= 0.8 else set()
    got = {r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), weighting="count").where("class_id <> doc_id").collect()}
    assert got == want and 10 < near < 75


def test_near_duplicates_of_repeated_and_null_ids(spark):
    words = [f"w{k}" for k in range(100)]
    near, other = " ".join(words), " ".join([*words[:99], "x"])
    rows = [(3, near), (3, "another text of the same id"), (3, near), (5, other), (None, near), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("z")).withColumn("first", F.lit(1))
    got = sorted((str(r.doc_id), str(r.class_id), r.first) for r in near_dup.near_duplicates(df).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("3", "3", True), ("5", "3", False), ("None", "3", False), ("None", "None", True), ("None", "None", True)]
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text, r.node) for r in kept.collect()) == [("3", "another text of the same id", "z"), ("3", near, "z"), ("None", "no id", "z")]


def test_pairs_in_one_open_bucket_are_linked_if_similar(spark):
    rng = random.Random(6)
    texts = []
    for i in range(2000):  # 200 words, some exchanged: similarities just above the threshold
        base = [f"p{i}w{k}" for k in range(200)]
        texts.append(" ".join(base))
        for k in range(4):
            base[20 + 45 * k + rng.randrange(10)] = f"p{i}x{k}"
        texts.append(" ".join(base))
    keys, registers = near_dup.signatures(texts)
    sets = near_dup.shingle_sets(texts)
    node = lambda d: bytearray(d.to_bytes(16, "big"))
    rows, want = [], set()
    for a in range(0, len(texts), 2):
        common = sorted({*keys[a].tolist()} & {*keys[a + 1].tolist()})
        rows += [(k, 2, node(d), node(d), bytearray(registers[d])) for k in common for d in (a, a + 1)]
        if common and near_dup.jaccard(sets[a], sets[a + 1]) >= 0.8:
            want.add((a, a + 1))
    rest = spark.createDataFrame(rows, "key long, n long, node binary, part binary, registers binary")
    held = spark.createDataFrame([(node(d), bytearray(s)) for d, s in enumerate(sets)], "node binary, shingles binary")
    got = {tuple(sorted(int.from_bytes(x, "big") for x in (r.a, r.b))) for r in near_dup._crossed(rest, held, 0.8).collect()}
    assert len(want) > 1900 and got == want


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    wa, wb = rng.integers(1, 5, 40).astype(float), rng.integers(1, 5, 40).astype(float)
    a, b = dict(zip(h[:40].tolist(), wa, strict=True)), dict(zip(h[20:].tolist(), wb, strict=True))
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})
    e = np.concatenate([h[:40], h[20:]])
    owner = near_dup.prob_minhash(e, np.concatenate([wa, wb]), np.repeat([0, 1], 40), 2, m=4000)
    assert abs((owner[0] == owner[1]).mean() - want) < 0.03


def test_repeat_words_equal_brute_force():
    texts = ["a b c d e f", "", "a b c d e x a b c d e y", "q q q q q q q", "one two"]
    for t, n, r in zip(texts, *quality.repeat_words(texts), strict=True):
        w = t.split()
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (n, r) == (len(w), len(covered))


def test_bad_host_is_rejected(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "bad" if i < 40 else f"h{i % 5}", "x x" if i < 36 else good) for i in range(200)]
    q = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert not any(r["__sf_quality"].kept for r in q if r.source == "bad") and all(r["__sf_quality"].kept for r in q if r.source != "bad")


def test_best_fill_is_the_best():
    rng = random.Random(2)
    for _ in range(200):
        counts = collections.Counter(rng.randrange(1, 20) for _ in range(8))
        room = rng.randrange(1, 60)
        got = packing.best_fill(dict(counts), room)
        assert all(got[k] <= counts[k] for k in got)
        best = max(s for n in range(9) for c in itertools.combinations(list(counts.elements()), n) if (s := sum(c)) <= room)
        assert sum(k * v for k, v in got.items()) == best


def test_packing_is_lossless_and_tight(spark, docs):
    t = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, tokenizer=PATH).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for r in docs.collect():
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == [*t.encode(r.text, add_special_tokens=False).ids, 0]
        assert all(a.start + a.length == b.start for a, b in zip(pieces, pieces[1:]))
    padding = 0
    for s in by_seq.values():
        s.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in s])
        assert [p.offset for p in s] == [0, *ends[:-1]] and ends[-1] <= 1024
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 1024 - ends[-1]
    assert padding == 0


def test_token_matrix_is_lossless(spark, docs):
    t = Tokenizer.from_file(PATH)
    parts = collections.defaultdict(dict)
    for r in token_matrix.token_matrix(docs, tokenizer=PATH, capacity=256).collect():
        ids, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(at) == 256 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[d][s] = ids[a:b].tolist()
            assert at[a:b].tolist() == list(range(b - a))
    for r in docs.collect():
        assert [x for s in sorted(parts[r.doc_id]) for x in parts[r.doc_id][s]] == [*t.encode(r.text, add_special_tokens=False).ids, 0]


def test_token_matrix_is_written_and_full(spark, docs, tmp_path):
    matrix = token_matrix.token_matrix(docs, tokenizer=PATH)
    token_matrix.write_matrix(matrix, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(bytes(r.ids) for r in back.collect()) == sorted(bytes(r.ids) for r in matrix.collect())
    assert {len(r.position_ids) for r in back.collect()} == {4096}
    full = token_matrix.fill(back).first()
    assert full.n_tokens == packing.pack_documents(docs, tokenizer=PATH).agg(F.sum("length")).first()[0] and full.fill > 0.97
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        token_matrix.write_matrix(back, str(tmp_path / "m"))
    padded = token_matrix.token_matrix(docs.limit(3), tokenizer=PATH, capacity=2048, pad_id=9)
    assert all(set(np.frombuffer(r.ids, "<u4")[r.n_tokens :]) <= {9} for r in padded.collect())
    assert token_matrix.fill(matrix.limit(0)).first().fill is None


def test_odd_rows_are_packed_and_stored_whole(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(k, text) for k, (_, text) in enumerate(ODD)] + [(None, "a text without an id")]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "doc_id long, text string, ids string, start int")
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    packed, matrix = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in packing.pack_documents(df, tokenizer=PATH).collect():
        packed[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_tokens == len(want[r.doc_id]) and r.length == len(packed[r.doc_id][r.start])
    for r in token_matrix.token_matrix(df, tokenizer=PATH, capacity=64).collect():
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            matrix[d][s] = np.frombuffer(r.ids, "<u4")[a:b].tolist()
    for got in (packed, matrix):
        assert {d: [x for s in sorted(parts) for x in parts[s]] for d, parts in got.items()} == want
    stored = {r.doc_id: (r.n_bytes, bytes(r.payload)) for r in media.read_avi(media.write_avi(df)).collect()}
    for i, x in rows:
        raw = (x or "").encode()
        assert stored[i] == (len(raw), raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)))


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 101) for _ in range(300)]
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        room = min((f for f in free if f >= n), default=None)
        if room is None:
            free.append(100 - n)
        else:
            free[free.index(room)] -= n
    rows = token_matrix.best_fit_decreasing(lengths, 100)
    assert sorted(100 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_media_round_trip_and_shots(spark):
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 64 * 100, dtype=np.uint8).tobytes()
    data = media.avi_file(payload)
    frames, length, step = media.avi_frames(data)
    stored, images = media.decode_frames(frames)
    assert stored[:length] == payload and step == 0.04
    for frame, image in zip(frames, images, strict=True):  # the decoder for any baseline JPEG reads the same from the file
        blocks, whole = jpeg.decode(frame)
        assert np.abs(whole.reshape(4, 8, 4, 8).transpose(0, 2, 1, 3).reshape(-1, 64).astype(int) - image.reshape(-1, 64)).max() == 0
    one = np.frombuffer(payload[:64], np.uint8)
    block = np.zeros((8, 8))
    block.flat[jpeg.ZIGZAG] = np.where(one >= 128, one.astype(float), one - 255.0)
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    dct = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    assert np.abs(np.clip(np.rint(dct.T @ block @ dct) + 128, 0, 255) - images[0][0].reshape(8, 8)).max() <= 1
    dark, bright = np.zeros(256, np.uint8), np.full(256, 250, np.uint8)
    assert media.shot_starts([dark] * 5 + [bright] * 5) == [0, 5]
    rows = queries.op8_media(spark, SF).collect()
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        whole = texts[r.doc_id] + b"\0" * (-len(texts[r.doc_id]) % 64 or 64 * (not texts[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r.feature.startswith("shots in seconds: 0.00-")


def java_jpeg(spark, image: np.ndarray, quality: float) -> tuple[bytes, np.ndarray]:
    """A colour JPEG (half-size chroma, the standard's tables) made by the JVM, and its luma as the JVM decodes it."""
    jvm = spark._jvm
    h, w = image.shape[:2]
    rgb = [int(x) for x in (image[..., 0].astype(int) << 16 | image[..., 1].astype(int) << 8 | image[..., 2]).ravel()]
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)
    for i, x in enumerate(rgb):
        picture.setRGB(i % w, i // w, x)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
    stream.close()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    got = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return data, 0.299 * (got >> 16) + 0.587 * (got >> 8 & 255) + 0.114 * (got & 255)


def without_huffman_tables(data: bytes) -> bytes:
    at, out = 2, data[:2]
    while data[at + 1] != 0xDA:
        n = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        out += b"" if data[at + 1] == 0xC4 else data[at : at + n]
        at += n
    return out + data[at:]


def test_avi_of_another_program(spark):
    y, x = np.mgrid[0:37, 0:51]
    dark = np.stack([x * 2, y, x + y], 2).astype(np.uint8)
    light = np.stack([255 - x, 250 - y, 200 + y], 2).astype(np.uint8)
    frames = []
    for image in (dark, light):
        for quality in (0.5, 0.95):
            data, luma = java_jpeg(spark, image, quality)
            for form in (data, without_huffman_tables(data)):
                _, mine = jpeg.decode(form)
                assert mine.shape == (37, 51) and np.abs(mine - luma).max() <= 3 and np.abs(mine - luma).mean() < 0.6
                frames.append(form)
    head = media._chunk(b"LIST", b"hdrl" + media._chunk(b"avih", (100_000).to_bytes(4, "little") + bytes(52)))
    movi = media._chunk(b"LIST", b"movi" + b"".join(media._chunk(b"01wb", b"sound") + media._chunk(b"00dc", f) for f in [*frames[:4], b"", *frames[4:]]))
    avi = media._chunk(b"RIFF", b"AVI " + head + movi)  # no index, no payload's length, a repeated frame
    table = [(1, avi), (2, b"RIFFxxxxWAVE"), (3, None), (4, media.avi_file(bytes(64))), (5, avi[:500]), (6, media.avi_file(bytes(range(64)) * 40)[:-900])]
    df = spark.createDataFrame([(i, 0, None if m is None else bytearray(m)) for i, m in table], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.read_avi(df).collect()}
    assert [(c.start_frame, c.end_frame, round(c.start_s, 3), round(c.end_s, 3)) for c in got[1].clips] == [(0, 5, 0.0, 0.5), (5, 9, 0.5, 0.9)]
    assert got[1].payload is None and got[1].error is None and bytes(got[4].payload) == bytes(64) and got[4].error is None
    assert all(got[i].error and got[i].payload is None and got[i].clips is None for i in (2, 3, 5))
    clips = media.clip_rows(media.read_avi(df))
    assert clips.columns == ["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"] and clips.where("doc_id = 1").count() == 2


def test_licenses_equal_brute_force(spark, docs):
    import re

    want = set()
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    for r in docs.collect():
        own = words(r.text)
        for name, text in license_scan.TEMPLATES:
            p = words(text)
            if any(own[i : i + len(p)] == p for i in range(len(own) - len(p) + 1)):
                want.add((r.doc_id, name))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).where("containment = 1").collect()}
    assert got == want and want


def license_shingles(text: str) -> set:
    import re

    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_licenses_are_found_among_random_neighbours(spark):
    rng = random.Random(7)
    whole = dict(license_scan.TEMPLATES)
    rows = []
    for i in range(4000):
        before, after = ([f"n{rng.randrange(10**6)}" for _ in range(n)] for n in (rng.randrange(20, 40), 30))
        rows.append((i, " ".join([*before, *whole["MIT-notice"].split(), *after])))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = sum((i, "MIT-notice") not in got for i in range(4000))
    assert lost <= 8, lost


def test_altered_licenses_equal_brute_force(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(600):
        name, text = license_scan.LICENSE_TEXTS[i % len(license_scan.LICENSE_TEXTS)]
        words = text.split()
        for _ in range(rng.randrange(len(words) // 12)):  # words exchanged, left out, or put in
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["edited"], [], [words[at], "more"]])
        before, after = ([f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(60))] for _ in range(2))
        rows.append((i, " ".join([*before, *words, *after])))
        for other, template in license_scan.TEMPLATES:
            part = license_shingles(template)
            want[i, other] = len(part & license_shingles(rows[-1][1])) / len(part)
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = {(i, license_scan.LICENSE_TEXTS[i % len(license_scan.LICENSE_TEXTS)][0]) for i in range(600)}
    assert {k for k in own if want[k] >= 0.8} == {k for k in own if k in got} and all(abs(got[k] - want[k]) < 1e-6 for k in own if k in got)
    assert all(got[k] <= want[k] + 1e-6 for k in got)  # of a text that holds another's clauses, only what lies together counts
    assert sum(want[k] < 1 for k in own if k in got) > 100


def test_templates_too_short_to_be_found_are_rejected(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License today")], "doc_id long, text string")
    with pytest.raises(ValueError, match="tiny"):
        license_scan.scan_licenses(df, templates=[("tiny", "the MIT-License only")])
    assert [r.license for r in license_scan.scan_licenses(df, templates=[("short", "Released under the MIT License")]).collect()] == ["short"]


def test_licenses_of_rows_with_one_id_stay_apart(spark):
    words = dict(license_scan.TEMPLATES)["MPL-2.0"].split()
    half = len(words) // 2
    rows = [(7, " ".join(words[:half])), (7, " ".join(words[half:])), (None, " ".join(words[:half])), (None, " ".join(words[half:])), (8, " ".join(words)), (8, " ".join(words)), (None, " ".join(words))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")
    for bound in (500_000, 0):  # hits sent to all tasks, and joined by a shuffle
        assert sorted((str(r.doc_id), r.license) for r in license_scan.scan_licenses(df, max_broadcast_hits=bound).collect()) == [("8", "MPL-2.0"), ("None", "MPL-2.0")]


def test_url_rules_and_model(spark):
    urls = ["https://www.Example.ORG/es/1", "http://a.example.org/en/17?x", "http://example.org/en/2", "http://x.com/fr/1", "https://y.com/de/", "no scheme", None, "http://b.net/en/1#top", "http://org/x", "http://notorg/x"]
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    judge = lambda us: {r.url: r["__sf_verdict"] for r in url_filter.judge_urls(spark.createDataFrame([(u, 1) for u in us], "url string, host int"), model, queries.URL_RULES).collect()}
    got = judge(urls)
    assert {u: v.rule for u, v in got.items()} == {urls[0]: "example.org/es/", urls[1]: "example.org/en/1", urls[2]: "org/", urls[3]: "com/fr/", urls[4]: "com/de/", urls[5]: None, None: None, urls[7]: None, urls[8]: "org/", urls[9]: None}
    assert got[urls[0]].host == "www.example.org" and got[urls[0]].path == "/es/1" and (got[None].host, got[None].path) == ("", "")
    new = judge(["https://www.mega-casino.example.net/en/5", "http://thonst.example.net/en/44"])
    assert [v.verdict for _, v in sorted(new.items())] == ["allow", "block"]


def test_url_model_on_held_out_urls(spark):
    table = url_filter.labelled_urls(spark)
    seen_word = ~F.crc32(F.encode(F.regexp_extract("url", "://(?:www.|blog.|m.)?([a-z]{3})", 1), "UTF-8")).bitwiseAND(7).isin(0)
    for known, unknown, least, most_false in ((~F.col("held_out"), F.col("held_out"), 0.95, 0.03), (seen_word, ~seen_word, 0.7, 0.1)):
        rows = url_filter.judge_urls(table.where(unknown), url_filter.train_url_model(table.where(known)), []).collect()
        right = sum((r["__sf_verdict"].verdict == "block") == (r.label == 1) for r in rows)
        false = sum(r["__sf_verdict"].verdict == "block" and r.label == 0 for r in rows)
        print("urls", len(rows), "right", right, "ordinary", sum(r.label == 0 for r in rows), "blocked of these", false)
        assert len(rows) > 100 and right / len(rows) > least and false / sum(r.label == 0 for r in rows) < most_false, (right, false, len(rows))


def test_char_ngrams(spark):
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [r[0] for r in df.select(url_filter.char_ngrams(F.col("t"), (2, 3), "h")).collect()] == [["h^a", "hab", "hbc", "hc$", "h^ab", "habc", "hbc$"], []]


def test_url_filter_takes_odd_and_empty_tables(spark):
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    df = spark.createDataFrame([("https://a.org/" + "x" * 20_000, 1), (None, 1), ("", 2), ("://", 2), ("http://h?q", 3), ("http://h?q", 3)], "url string, score int").withColumn("host", F.lit(0))
    for part in (df, df.limit(0)):
        got = url_filter.judge_urls(part, model, queries.URL_RULES)
        assert got.columns == [*df.columns, "__sf_verdict"] and got.count() == part.count()
    verdicts = {r.url: r["__sf_verdict"] for r in url_filter.judge_urls(df, model, queries.URL_RULES).collect()}
    assert verdicts["http://h?q"].host == "h" and verdicts[""].path == "" and verdicts[None].verdict in ("allow", "block")


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<div class="ad">Buy now and save a lot of money today</div><article><h1>A &amp; B</h1><p>One  two<br>three <b>four</b><p>Five<div class="comments"><p>I hate it</p></div><form><input>Name</form><p>Six &lt;7&gt;</article>
<aside>Side</aside><footer>&copy; me &middot; all rights</footer>"""
    assert html_main.main_text(page) == "A & B\nOne two three four\nFive\nSix <7>"
    assert html_main.main_text("") == "" and html_main.main_text("plain &amp text") == "plain & text"
    assert html_main.main_text("<div id=main><p>Body of the page, long enough.</p></div><div class='cookie-notice'>We use cookies") == "Body of the page, long enough."


def test_main_text_keeps_the_whole_article():
    long = "word " * 300 + "end."
    short = "A short closing paragraph that is still part of the article."
    for between in ("<aside>Buy now</aside>", "</div></div></div><div><div>", "<div class='notice'>Cookies</div>"):
        assert html_main.main_text(f"<body><p>Menu</p><article><h1>T</h1><div><div><div><p>{long}</p>{between}<p>{short}</p></article><p>Foot</p>") == f"T\n{long}\n{short}"
    comment = "<article class='comment'><p>I hate it</p>{}</article>"
    for inner in ("", "<article>A reply</article><p>More of it</p>", "<article class='reply'>A reply</article>"):
        assert html_main.main_text(f"<main><article><p>{long}</p>{comment.format(inner)}<p>{short}</p></article></main><p>Foot</p>") == f"{long}\n{short}"
    assert html_main.main_text(f"<p>{long}</p>{comment.format('')}<p>{long}</p>") == f"{long}\n{long}"
    assert html_main.main_text(f"<article class='promo'>never closed<article><p>{long}</p></article>") == long
    assert html_main.main_text(f"<p>{long}</p><nav>Menu</nav><p>stray</p>") == long  # no article: stray lines are dropped


def test_main_text_of_unlucky_markup():
    cases = {
        '<p>one</p><article class="comment">..</article><p>two</p>': "one\ntwo",
        '<main><p>First</p><article class="related">..</article><p>Second</p></main>': "First\nSecond",
        '<section class="comments"><article>reader says</article></section>': "",
        '<p>Story<p class="ad">Buy<p>Story goes on': "Story\nStory goes on",
        '<div class="content with-sidebar"><p>Text of the page</p></div>': "Text of the page",
        '<article><h1 class="entry-header">Title</h1><p>Body</p></article>': "Title\nBody",
        "<ul><li>a<li class=promo>b<li>c</ul>": "a\nc",
        "<table class=sidebar><tr><td>menu<td>more</table><p>Main text of the page": "Main text of the page",
        "<article><table><tr><td>cell</article><p>x": "cell",
        "<b>" * 30_000 + "<div>" * 30_000 + "deep" + "</div>" * 30_000 + "<p>end": "deep\nend",
        "<article><p>a <a href=x>b</a> c<p><a href=y>only a link</a></article>": "a b c\nonly a link",
    }
    for page, want in cases.items():
        assert html_main.main_text(page) == want, page


def test_lengths_decide_where_nothing_is_marked():
    text = "Sentences of the story, one after the other, go on for a while. " * 4
    menu = "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(40))
    page = f"<div><ul>{menu}</ul></div><div><h2>Title</h2><p>{text}</p><p>Short.</p><p>{text}</p></div><section class=ad>x</section><div><p>All rights</p></div>"
    assert html_main.main_text(page).split("\n") == ["Title", text.strip(), "Short.", text.strip()]
    cards = "".join(f"<article class=card><p>Teaser {k}</p></article>" for k in range(5))
    assert html_main.main_text(f"{cards}<section id=body><p>{text * 3}</p></section>") == (text * 3).strip()
    assert html_main.main_text(f"<div class='sidebar page'><p>{text}</p></div><nav><a>{text}</a></nav>") == text.strip()
    assert html_main.peaks([0, 0, 5, 0, 0, 0, 0, 0, 9, 2]) == [(2, 3, 5), (8, 10, 11)]


def plain_pages() -> list[tuple[str, str, str]]:
    """Kind, page and main text of 42 pages without article or main elements, and mostly without telling names."""
    rng = random.Random(21)
    words = "the of a river town people year when under light stone water house between north old they made long where".split()
    sentence = lambda n: (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()
    prose = lambda n: " ".join(sentence(rng.randrange(8, 20)) for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{k}'>{sentence(3)}</a> new</li>" for k in range(n))
    out = []
    for k in range(42):
        story = [sentence(5), *[prose(rng.randrange(3, 8)) for _ in range(rng.randrange(3, 9))], prose(2)]
        body = "".join(f"<p>{x}</p>" for x in story)
        kind = k % 7
        page = [
            lambda: f"<div><ul>{links(12)}</ul></div><div>{body}</div><div><p>All rights {k}</p></div>",  # columns of divs
            lambda: f"<table><tr><td>{'<br>'.join('Item' for _ in range(9))}</td><td>{body}</td><td><p>Weather: rain</p></td></tr></table>",  # a table for a layout
            lambda: f"<div class=c1><p>Read more</p><p>Top ten</p></div><div class=c2>{body}</div><div class=c3>{''.join(f'<p>{sentence(3)}</p>' for _ in range(6))}</div>",  # teasers, short but many
            lambda: f"<section><p>Please log in</p></section><section>{body}</section><section><form>Name <input></form><p>Send</p></section>",
            lambda: f"<div class='sidebar'><p>{sentence(6)}</p></div><div class='search-results article-body'>{body}</div><div><p>foot</p></div>",  # unlucky names
            lambda: f"<div class='notice-board'>{body}</div><div><p>Back</p><p>Next</p></div>",
            lambda: f"<div><p>Tel. 12</p></div><center>{body}</center><div><ul>{links(30)}</ul></div>",
        ][kind]()
        out.append((str(kind), f"<html><head><title>{story[0]}</title></head><body>{page}</body></html>", "\n".join(story)))
    return out


def test_windows_decide_on_pages_without_article(monkeypatch):
    pages = plain_pages()
    got = [html_main.main_text(p) for _, p, _ in pages]
    right = sum(g == want for g, (_, _, want) in zip(got, pages, strict=True))
    monkeypatch.setattr(html_main, "SHARE", 0.0)  # every stretch of text is kept, however low its windows
    without = [html_main.main_text(p) for _, p, _ in pages]
    monkeypatch.undo()
    monkeypatch.setattr(html_main, "MARKED", 0.999)  # no marks but comments
    monkeypatch.setattr(html_main, "SOFT", 1.0)
    unmarked = sum(html_main.main_text(p) == want for _, p, want in pages)
    changed = sum(a != b for a, b in zip(got, without, strict=True))
    print("right", right, "of", len(pages), "changed without windows", changed, "right without marks", unmarked)
    assert right == len(pages) and changed == len(pages) and unmarked >= 36, [(k, g[-90:]) for (k, _, w), g in zip(pages, got, strict=True) if g != w]


def test_marks_only_shift_the_signal():
    text = "Sentences of the story, one after the other, go on for a while. " * 4
    assert html_main.main_text('<article><p>Body of it.</p><p class="share-price">The share price fell by a third on Monday.</p></article>') == "Body of it.\nThe share price fell by a third on Monday."
    page = f'<div class="search-results article-body"><p>{text}</p></div><div><p>foot</p></div>'
    assert html_main.main_text(page) == text.strip()
    assert html_main.main_text(f"<article><p>Read this:</p></article><div class=sidebar><p>{text * 30}</p></div>") == f"Read this:\n{(text * 30).strip()}"  # far denser than the article
    assert html_main.main_text(f"<article><p>{text}</p></article><div class=sidebar><p>{text}</p></div>") == text.strip()
    assert html_main.main_text(f"<div class='post comments-closed'><p>{text}</p></div><ol class=comment-list><li>{text}</ol>") == text.strip()


def test_menus_and_comments_of_any_depth_go():
    text = "Sentences of the story, one after the other, go on for a while. " * 4
    deep = "<div>" * 5000
    for part in ("<nav>Menu of the page</nav>", "<div class=comments><p>I hate it</p></div>", "<aside>Side</aside>"):
        assert html_main.main_text(f"<p>{text}</p>{deep}{part}<p>{text}</p>") == f"{text.strip()}\n{text.strip()}"
    assert html_main.main_text("<nav>" * 3000 + "menu" + "</nav>" * 3000 + "<p>text") == "text"


def test_main_text_of_the_pages_table(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_main.extract_main_text(pages.withColumn("text", F.lit(1)).withColumn("part", F.lit(2))).collect()}
    for r in pages.collect():  # these pages have one article of headings and paragraphs
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x" * 50_000), (2, None, "")], "page_id long, url string, html string")
    assert sorted(len(r.text) for r in html_main.extract_main_text(odd).collect()) == [0, 0, 0, 99_999]
    assert html_main.extract_main_text(odd.limit(0)).count() == 0


def test_hosts_joined_by_salt_equal_broadcast_ones(spark):
    rows = [(i, [None, "a", "b", "c"][i % 4], "x x" if i % 4 == 2 else " ".join(f"w{k}" for k in range(20))) for i in range(120)]
    m = quality.measured(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = [sorted((r.doc_id, r["__sf_quality"].kept, round(r["__sf_quality"].host_rate, 9)) for r in quality.judged(m, max_broadcast_hosts=n).collect()) for n in (0, 100)]
    assert got[0] == got[1] and len(got[0]) == 120 and sum(r[1] for r in got[0]) == 90


def test_toxicity_of_odd_labels(spark):
    good, bad = "the quiet river runs by", "awful nasty hateful vile"
    rows = [(i, (bad if i % 2 else good) + f" number{i}") for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:20], (1, "another text of id one"), (None, bad), (100, None), (101, "")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, i % 2) for i in range(10)] + [(3, 0), (7, None), (None, 1), (999, 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and got[0].toxic == "x"
    by_text = {r.text: r["__sf_score"] for r in got}
    assert by_text[bad] > 0.7 > by_text[good + " number0"] and by_text[None] == by_text[""]
    scores = lambda m: sorted((str(r.doc_id), str(r.text), round(r["__sf_score"], 9)) for r in toxicity.score_toxicity(docs, m).collect())
    assert scores(model) == scores(toxicity.train(docs.repartition(7), labels.repartition(3)))
    fold_1 = labels.where(toxicity.fold() == 1)
    for none in (labels.limit(0), fold_1, labels.where("toxic = 1")):
        assert toxicity.train(docs, none) is None
        assert {r["__sf_score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    flipped = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert scores(model) == scores(toxicity.train(docs, flipped))  # labels of held-out rows are never used
    assert toxicity.train(docs, labels, max_labelled=0) is None


def test_shared_counts_equal_brute_force(spark):
    texts = ["banana bandana", "ban an", "banana"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rows = [(i, texts[i % 3]) for i in range(12)]
    class_grams = spark.createDataFrame([r for t in texts for r in _contexts(t)], "four_context long, three_context long")
    tables = toxicity._shared_tables(spark.createDataFrame(rows, "doc_id long, text string"), class_grams)
    words = collections.Counter(w for _, t in rows for w in t.split())
    fours, before = collections.Counter(), collections.defaultdict(set)
    for w, n in words.items():
        c = f"\x02{w}\x03"
        for k in range(1, len(c)):
            fours[c[max(0, k - 3) : k + 1]] += n
            before[c[max(0, k - 2) : k + 1]].add(c[max(0, k - 3) : k + 1])
    assert sorted(tables["four"][0].values[:, 0].tolist()) == sorted(fours.values())
    assert sorted(tables["three"][0].values[:, 0].tolist()) == sorted(len(v) for v in before.values())
    totals = collections.Counter()
    for g, n in fours.items():
        totals[g[:-1]] += n
    assert sorted(tables["four"][1].values[:, 0].tolist()) == sorted(totals.values()) and labels.count() == 12


def test_tables_find_their_keys():
    rng = np.random.default_rng(10)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n)) if n else np.zeros(0, np.int64)
        rows = pd.DataFrame({"k": keys, "a": np.arange(len(keys)) + 1.0, "b": 2.0})
        asked = np.r_[keys, rng.integers(-(2**63), 2**63 - 1, 50)]
        got = toxicity.Table(rows, "k", ["a", "b"]).find(asked)
        assert got["a"][: len(keys)].tolist() == rows["a"].tolist() and not got["a"][len(keys) :].any() and got["b"].sum() == 2 * len(keys)


def _contexts(text: str):
    g = toxicity.char_grams(np.array(text.split(), object))
    return [(int(a), int(b)) for a, b in zip(g["four_context"], g["three_context"])]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert right / max(1, sum(r.predicted for r in rows)) > 0.9
    assert right / sum(r.toxic == 1 for r in rows) > 0.75
    assert all(0 <= r.score <= 1 for r in rows)


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, long + " more", "en", None, 5), (None, long + " and no id at all here", None, "a", None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " ".join(f"other{i}" for i in range(30_000)), "en", "b", 5)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, part in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame(part, kind).withColumn("node", F.lit("x")).withColumn("__sf", F.lit(1))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = P.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in got} == ({1, 5} if part else set())
        assert sum(r.length for r in got if r.start == 0) > 0 or not part


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in kept.collect()}
    classes = brute_classes(texts, damped)
    assert all(classes[i] == i for i in texts)
    assert {r.doc_id for r in P.run(spark, SF).collect()} == set(texts)


def test_pipeline_leaves_only_what_its_result_reads(spark, tmp_path):
    import os

    import corpus_pipeline as P
    from strideframe.llm import common

    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = common.shared_dir(spark).removeprefix("file:")
    found = lambda: {os.path.join(d, x) for d, ds, _ in os.walk(root) for x in ds if x.startswith(("rdd-", "scratch-", "pipeline-"))}
    old = found()
    n = P.run(spark, SF).count()
    new = {x.rsplit("/", 1)[1].split("-")[0] for x in found() - old}
    left = [x for x in found() - old if "pipeline-" in x]
    assert n and new <= {"pipeline", "rdd"} and [sorted(os.listdir(x)) for x in left] == [["2"]], (new, left)
    assert sum("rdd-" in x for x in found() - old) <= 2 and spark.sparkContext._jsc.sc().getCheckpointDir() == before  # packing's own
