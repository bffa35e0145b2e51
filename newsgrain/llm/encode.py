"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction. A text is halved until the pieces are short; the pieces are encoded apart and neighbours
are joined up the tree. An element of the monoid is the list of a text's pre-tokens with the ids of each. Joining
re-encodes a window around the seam, which grows until what lies outside provably cannot change:

* to the left, a pre-token stays as it is if it ends `LOOKAHEAD` or more characters before the seam, because the
  pattern never looks further ahead than that past the end of a match;
* to the right, once the window's scan arrives at a place where a pre-token of the right half begins, the scans agree
  from there on, because the pattern never looks back.

Decoding concatenates the tokens' bytes up the same tree. Joining is associative, so a text may be halved anywhere.

Defined cases: null and empty texts have the empty list of ids; strings that look like special tokens are ordinary text;
a text of any length is encoded whole; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import column

#: Fixed value: the pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most characters past the end of a match that decide about it (two, for a contraction that begins at the seam).
LOOKAHEAD = 3
#: Characters of a piece that is not halved again.
LEAF_CHARS = 256
#: Pre-tokens up to this length are remembered, and at most so many of them.
CACHED_CHARS, CACHE_SIZE = 24, 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The pre-tokens of a text, and the ids of each.
Element = tuple[list[str], list[tuple[int, ...]]]


class Encoder:
    def __init__(self, vocabulary: str, leaf_chars: int = LEAF_CHARS):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the pattern takes every pre-token as one piece: the splitting is done here
        self._piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = {v: k for k, v in ranks.items()}
        self._scan = regex.compile(PATTERN)
        self._known: dict[str, tuple[int, ...]] = {}
        self.leaf_chars = leaf_chars

    def _encode_word(self, word: str) -> tuple[int, ...]:
        ids = tuple(self._piece(word))
        if len(word) <= CACHED_CHARS and len(self._known) < CACHE_SIZE:
            self._known[word] = ids
        return ids

    def element(self, words: list[str]) -> Element:
        known, missing = self._known.get, self._encode_word
        return words, [known(w) or missing(w) for w in words]

    def join(self, left: Element, right: Element) -> Element:
        """The element of the joined text from those of its two halves."""
        words, ids = left
        if not words or not right[0]:
            return words + right[0], ids + right[1]
        tail = keep = 0
        for word in reversed(words):
            if tail >= LOOKAHEAD:
                break
            tail += len(word)
            keep += 1
        stays = len(words) - keep
        seam = "".join(words[stays:])
        taken, grow = 0, 4
        window = seam
        starts, at = {len(seam): 0}, len(seam)
        while True:
            more = right[0][taken : taken + grow]
            window += "".join(more)
            for word in more:
                taken += 1
                at += len(word)
                starts[at] = taken
            whole = taken == len(right[0])
            fresh: list[str] = []
            for m in self._scan.finditer(window):
                end = m.end()
                if not whole and end + LOOKAHEAD > len(window):
                    break
                fresh.append(m.group())
                if end in starts:
                    middle, rest = self.element(fresh), starts[end]
                    return words[:stays] + middle[0] + right[0][rest:], ids[:stays] + middle[1] + right[1][rest:]
            grow *= 2

    def encoded(self, text: str) -> Element:
        if len(text) <= self.leaf_chars:
            return self.element(self._scan.findall(text))
        half = len(text) // 2
        return self.join(self.encoded(text[:half]), self.encoded(text[half:]))

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(self.encoded(text)[1]))

    def decode(self, ids: list[int]) -> str:
        if len(ids) <= 1024:
            return self._decoded(ids).decode("utf-8")
        return self._tree(ids).decode("utf-8")

    def _decoded(self, ids) -> bytes:
        return b"".join(self._bytes[int(i)] for i in ids)

    def _tree(self, ids) -> bytes:
        if len(ids) <= 1024:
            return self._decoded(ids)
        half = len(ids) // 2
        return self._tree(ids[:half]) + self._tree(ids[half:])


@lru_cache(2)
def encoder(vocabulary: str, leaf_chars: int = LEAF_CHARS) -> Encoder:
    return Encoder(vocabulary, leaf_chars)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text. `vocabulary`: path of a .tiktoken file, the same on every executor."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                lists = [enc.ids(t) for t in column(batch, "text").to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    return plain.mapInArrow(work, f"id {plain.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str = "id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): the texts of lists of ids."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")
    plain = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([None if x is None else enc.decode(x) for x in column(batch, "ids").to_pylist()], pa.string())], names=["id", "text"])

    return plain.mapInArrow(work, f"id {plain.schema['id'].dataType.simpleString()}, text string")
