"""Encoding of a whole corpus by a byte-level BPE vocabulary (problem 7).

Each task encodes the distinct words of a batch along a prefix trie: the words' bytes are
visited in sorted order, which is the trie depth first, and each node keeps one last-token
state. The encoding of a prefix ending in token t is that of the prefix without t, plus t,
and t is the only vocabulary entry at its end that stays as it is beside the token before it. So a
prefix shared by words is worked out once, and a word's encoding is read off its states.
No row leaves its task: words and states never meet over an exchange.
"""

from __future__ import annotations

import base64
import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: How byte-level BPE vocabularies of this kind split a text into words (fixed value).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pairs a worker remembers before it starts anew; only speed depends on them.
KEEP_WORDS, KEEP_PAIRS, KEEP_LENGTH = 400_000, 1_000_000, 64


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class TrieEncoder:
    """Encodes words of one vocabulary given as token bytes with ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.words: dict[str, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """A short piece by the merges themselves: lowest rank first, leftmost on a tie."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            low, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, before: int, token: int, piece: bytes) -> bool:
        """Whether ``token`` stays as it is after ``before`` (-1: at the start)."""
        key = (before, token)
        known = self._pairs.get(key)
        if known is None:
            left = [] if before < 0 else [self.bytes_of[before]]
            known = self.merged(b"".join([*left, piece])) == [*left, piece]
            if len(self._pairs) >= KEEP_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def encode_sorted(self, words: list[bytes]):
        """Yields the ids of each of the sorted words."""
        last: list[int] = [-1]  # last-token state of each prefix of the current path
        path = b""
        get = self.ranks.get
        size = self.longest
        for word in words:
            shared = len(os.path.commonprefix([path, word]))
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - size), end):
                    piece = word[start:end]
                    token = get(piece)
                    if token is not None and self._stays(last[start], token, piece):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path = word
            ids, at = [], len(word)
            while at:
                t = last[at]
                ids.append(t)
                at -= len(self.bytes_of[t])
            ids.reverse()
            yield ids

    def learn(self, words: set[str]) -> dict[str, list[int]]:
        """Encodings of the words, from memory where they are known."""
        new = {w.encode("utf-8", "surrogatepass"): w for w in words if w not in self.words}
        order = sorted(new)
        fresh = {new[b]: ids for b, ids in zip(order, self.encode_sorted(order), strict=True)}
        got = {w: self.words[w] for w in words if w in self.words} | fresh
        if len(self.words) + len(fresh) > KEEP_WORDS:
            self.words.clear()
        self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= KEEP_LENGTH)
        return got

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        split = [_PATTERN.findall(t) if t else [] for t in texts]
        got = self.learn(set(chain.from_iterable(split)))
        return [list(chain.from_iterable(map(got.__getitem__, words))) for words in split]


_PATTERN = regex.compile(WORDS)
_encoders: dict[str, TrieEncoder] = {}


def encode(docs: DataFrame, doc_id: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts: bool = False) -> DataFrame:
    """``doc_id, ids``: the token ids of each text, or with ``counts`` ``doc_id, n_tokens``.

    Null and empty texts give an empty list (0 tokens). Strings that name special tokens
    are ordinary text. Whole texts are encoded, however long; repeated rows and null ids
    are kept as they are, and an empty table gives no rows. Other columns are ignored.

    ``vocabulary`` names a file ``.tiktoken`` in ``folder``, which is read on the driver and
    sent along: under a MB, and the same for every input.
    """
    spark = docs.sparkSession
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        raw = f.read()
    sent = spark.sparkContext.broadcast(raw)
    key = hashlib.sha256(raw).hexdigest()

    def run(batches):
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = _encoders[key] = TrieEncoder(parse_ranks(sent.value))
        for batch in batches:
            # texts of a batch may be long: they are taken in parts of a few MB
            texts = batch.column(1)
            sizes = np.cumsum([len(x) if (x := t.as_py()) else 0 for t in texts]) // 4_000_000 if batch.nbytes > 8_000_000 else np.zeros(len(texts), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    ids = encoder.encode_all(texts.slice(lo, hi - lo).to_pylist())
                    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                    if counts:
                        out = pa.array(lengths)
                    else:
                        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
                        out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), out], [doc_id, "n_tokens" if counts else "ids"])

    out = T.StructField("n_tokens", T.LongType()) if counts else T.StructField("ids", T.ArrayType(T.IntegerType()))
    narrow = docs.select(doc_id, docs[text].cast("string").alias("__text"))
    return narrow.mapInArrow(run, T.StructType([narrow.schema[doc_id], out]))
