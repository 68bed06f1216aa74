"""Byte-level BPE over a distinct-word table.

Documents are dealt to chunks of about chunk_bytes, and split into words by a Spark expression. Every chunk gives its distinct
words, packed by word hash; for each hash bucket the words of all chunks are united, each distinct word is encoded once, and the ids
go back to the chunks that asked for them. There the ids are joined to the words by position. Chunks are taken in regions of
REGION (28 GB of text), and a word is encoded once in each: so a bucket's and a chunk's share doesn't grow with the corpus.
Decoding joins ids to pieces: each chunk's distinct ids are joined to the table of pieces (as many rows as the vocabulary), the pieces come to
the chunk beside its words' ids, and texts are put together by position. decode_ids() does the same for any table of ids, one row a token.

Null texts are empty and give no ids. Repeated rows give equal results; those of different input partitions go to different chunks. Empty tables give empty results. Other columns
of the input are not read.
"""

from __future__ import annotations

import json
import zlib
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text
from .tokens import byte_alphabet, ranges, special_tokens, word_encoder

#: Chunks that share their distinct words (28 GB of text).
REGION = 2048
#: Stands for a bucket where a row holds an id and its piece.
PIECES = -1

#: The tokenizer's word pattern, its classes as the JVM names them.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def split_words(text: Column, special: list[str]) -> Column:
    """The words of a text in order, special tokens whole; joined they are the text."""
    found = lambda part: F.regexp_extract_all(part, F.lit(_WORD), F.lit(0))
    if not special:
        return found(text)
    any_special = "|".join(f"\\Q{s}\\E" for s in special)
    parts = F.split(text, f"(?<={any_special})|(?={any_special})")
    cut_out = F.flatten(F.transform(parts, lambda p: F.when(p.isin(special), F.array(p)).otherwise(found(p))))
    return F.when(text.rlike(any_special), cut_out).otherwise(found(text))


def known_characters(text: Column) -> Column:
    """Whether the JVM knows the class of all characters; what came later to Unicode is left to the tokenizers library."""
    return ~text.rlike(r"\p{Cn}")


def _narrow(numbers: np.ndarray) -> bytes:
    """The bytes of the smallest unsigned type that holds all numbers, after its size."""
    size = next(s for s in (1, 2, 4) if not len(numbers) or numbers.max() < 1 << 8 * s)
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def _widen(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n numbers of _narrow() that begin at a place, and where they end."""
    return np.frombuffer(raw, f"<u{raw[at]}", n, at + 1), at + 1 + raw[at] * n


def _pack_words(words: list[str]) -> bytes:
    parts = [w.encode() for w in words]
    return zlib.compress(_narrow(np.array([len(p) for p in parts], np.int64)) + b"".join(parts))


def _unpack_words(n: int, packed: bytes) -> list[str]:
    raw = zlib.decompress(packed)
    lengths, start = _widen(raw, n)
    ends = np.cumsum(lengths, dtype=np.int64) + start
    return [raw[a:b].decode() for a, b in zip([start, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _pack_ids(ids: list[bytes]) -> bytes:
    return zlib.compress(_narrow(np.array([len(x) // 4 for x in ids], np.int64)) + _narrow(np.frombuffer(b"".join(ids), "<u4")))


def _unpack_ids(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and all ids."""
    raw = zlib.decompress(packed)
    lengths, at = _widen(raw, n)
    lengths = lengths.astype(np.int64)
    return lengths, _widen(raw, int(lengths.sum()), at)[0]


def _pack_set(ids: list[bytes]) -> bytes:
    """The distinct ids, as the distances from each to the next."""
    return zlib.compress(_narrow(np.diff(np.unique(np.frombuffer(b"".join(ids), "<u4")).astype(np.int64), prepend=0)))


def _unpack_set(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.cumsum(_widen(raw, (len(raw) - 1) // raw[0])[0], dtype=np.int64)


def _chunk_words(table: pa.Table, tokenizer: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a chunk, the number of each word in the sequence of all, and words by document."""
    words = table["words"]
    known = table["known"].to_numpy()
    if not known.all():
        encoder, lists = word_encoder(tokenizer), words.to_pylist()
        for i in np.flatnonzero(~known):
            lists[i] = encoder.words("".join(lists[i]))
        words = pa.chunked_array([pa.array(lists, pa.list_(pa.string()))])
    coded = pc.list_flatten(words).dictionary_encode().unify_dictionaries()  # no copy of the texts
    codes = np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy() for c in coded.chunks]])
    return coded.chunk(0).dictionary.to_pylist() if coded.num_chunks else [], codes, pc.list_value_length(words).to_numpy()


def _by_bucket(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words by (bucket, word), and how many each bucket has."""
    bucket = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % buckets
    order = np.array(sorted(range(len(words)), key=lambda i: (bucket[i], words[i])), np.int64)
    return order, np.bincount(bucket, minlength=buckets)


def encode_documents(docs: DataFrame, *, tokenizer: str, chunk_bytes: int = 14 << 20, buckets_per_chunk: int = 2, region: int = REGION) -> DataFrame:
    """doc_id, text, ids (little-endian unsigned 32-bit) and decoded text of all documents (doc_id, text)."""
    pieces = piece_table(docs.sparkSession, tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    chunks = max(1, ceil(size / chunk_bytes))
    buckets = min(chunks, region) * buckets_per_chunk
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int")).repartition("chunk").sortWithinPartitions("chunk")
    split = dealt.select("chunk", "doc_id", split_words(F.col("text"), special_tokens(tokenizer)).alias("words"), known_characters(F.col("text")).alias("known"))

    def distinct_words(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        words, _, _ = _chunk_words(table, tokenizer)
        order, counts = _by_bucket(words, buckets)
        rows, at = [], 0
        for b in np.flatnonzero(counts):
            rows.append((chunk, chunk // region, int(b), int(counts[b]), _pack_words([words[i] for i in order[at : at + counts[b]]])))
            at += counts[b]
        kinds = [("chunk", pa.int32()), ("region", pa.int32()), ("bucket", pa.int32()), ("n_words", pa.int32()), ("words", pa.binary())]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})

    def encode_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder = word_encoder(tokenizer)
        encoder.clear()
        known: dict[str, bytes] = {}
        out = []
        for chunk, bucket, n, packed in zip(pdf["chunk"], pdf["bucket"], pdf["n_words"], pdf["words"], strict=True):
            words = _unpack_words(n, packed)
            for w in words:
                if w not in known:
                    known[w] = encoder.encoded(w)
            ids = [known[w] for w in words]
            out.append((chunk, bucket, n, _pack_ids(ids), _pack_set(ids)))
        return pd.DataFrame(out, columns=["chunk", "bucket", "n_words", "ids", "distinct"])

    def chunk_ids(table: pa.Table) -> pa.Table:
        ids = np.zeros(0, np.int64)
        for packed in table["distinct"].to_pylist():
            ids = np.union1d(ids, _unpack_set(packed))
        return pa.table({"chunk": np.full(len(ids), table["chunk"][0].as_py(), np.int32), "id": ids.astype(np.int32)})

    def by_position(left: pa.Table, right: pa.Table) -> pa.Table:
        words, codes, counts = _chunk_words(left, tokenizer)
        order, _ = _by_bucket(words, buckets)
        rows = sorted(zip(right["bucket"].to_pylist(), right["n_words"].to_pylist(), right["ids"].to_pylist(), strict=True), key=lambda r: r[:2])
        pieces = [(i, p) for bucket, i, p in rows if bucket == PIECES]
        parts = [_unpack_ids(n, p) for bucket, n, p in rows if bucket != PIECES]
        known, lengths = np.array([i for i, _ in pieces], np.int64), np.array([len(p) for _, p in pieces], np.int64)
        buffer, starts = np.frombuffer(b"".join(p for _, p in pieces), np.uint8), np.cumsum(lengths) - lengths
        n_ids, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        table = np.concatenate([np.zeros(0, "<u4"), *[p[1] for p in parts]])
        if parts:
            n_ids[order] = np.concatenate([p[0] for p in parts])
            at[order] = np.cumsum(n_ids[order]) - n_ids[order]
        del rows, pieces, parts
        ids, decoded, first = [], [], 0
        for n in counts:
            own = codes[first : first + n]
            first += n
            x = table[ranges(at[own], n_ids[own])]
            ids.append(x.tobytes())
            piece = np.searchsorted(known, x)
            decoded.append(buffer[ranges(starts[piece], lengths[piece])].tobytes().decode("utf-8", "replace").encode())
        return pa.table({"doc_id": left["doc_id"].combine_chunks(), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary()).cast(pa.string())})

    words = split.groupBy("chunk").applyInArrow(distinct_words, "chunk int, region int, bucket int, n_words int, words binary")
    encoded = words.groupBy("region", "bucket").applyInPandas(encode_bucket, "chunk int, bucket int, n_words int, ids binary, distinct binary")
    asked = encoded.select("chunk", "distinct").groupBy("chunk").applyInArrow(chunk_ids, "chunk int, id int").join(F.broadcast(pieces), "id")  # as many rows as the vocabulary
    both = encoded.drop("distinct").unionByName(asked.select("chunk", F.lit(PIECES).alias("bucket"), F.col("id").alias("n_words"), F.col("piece").alias("ids")))
    return split.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(by_position, "doc_id long, ids binary, decoded string")


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """id and piece (binary) of every entry of the vocabulary, special ones as their text."""
    spec = json.load(open(tokenizer, encoding="utf-8"))
    back, special = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    rows = [(i, p.encode() if p in special else bytes(map(back.__getitem__, p))) for p, i in (spec["model"]["vocab"] | special).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece binary")


def decode_ids(encoded: DataFrame, pieces: DataFrame, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of rows with an array of ids: joined to their pieces by id, and put together by position.

    An id without a piece adds nothing; null or empty arrays give an empty text; keys must be distinct.
    """
    exploded = encoded.select(F.col(key).alias("k"), F.posexplode_outer(ids).alias("at", "id"))
    joined = exploded.join(F.broadcast(pieces.select(F.col("id"), F.hex("piece").alias("piece"))), "id", "left")  # as many rows as the vocabulary
    text = F.decode(F.unhex(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]))), "UTF-8")
    return joined.groupBy("k").agg(text.alias("text")).select(F.col("k").alias(key), F.coalesce("text", F.lit("")).alias("text"))
