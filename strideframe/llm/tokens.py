"""Byte-level BPE: texts to words to ids, exactly as the tokenizers library does it, one encoding per distinct word."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Letters, numbers and white space up to U+024F; texts of other characters take the library's own splitter.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t-\r\x85\xa0"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_PLAIN = re.compile("[\t-\r -~\x85\xa0-ɏ‘’“”–—…€]*")

#: Words kept in one worker's table before it starts anew.
MAX_CACHED_WORDS = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def special_tokens(path: str) -> list[str]:
    """The special tokens of a tokenizer file, which are words whatever stands beside them."""
    return [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; a word is encoded when first met."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        back, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(map(back.__getitem__, p)) for p, i in vocab.items() if p not in self.special}
        self.pieces |= {i: p.encode() for p, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        joined = [vocab["".join(p)] for p in pairs]
        # where ids follow the order of merges, merging by rank gives the same pieces, without the library's offsets
        ranks = {p: i for i, p in self.pieces.items() if i not in self.special.values()}
        self._rank = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}) if joined == sorted(joined) else None

    def encoded(self, word: str) -> bytes:
        """The ids of one word, not kept."""
        if word in self.special:
            ids = [self.special[word]]
        elif self._rank is not None and len(word) < 1000:
            ids = self._rank._encode_single_piece(word)
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        self[word] = out = self.encoded(word)
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text, in order; joined they are the text."""
        if self._special is not None and "<|" in text and self._special.search(text):
            return [w for part in self._special.split(text) if part for w in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.words(text)))

    def piece_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in one buffer, with the start and length of each id's."""
        n = max(self.pieces) + 1
        parts = [self.pieces.get(i, b"") for i in range(n)]
        lengths = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker and path."""
    return WordEncoder(path)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
