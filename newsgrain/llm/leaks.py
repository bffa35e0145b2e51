"""Evaluation texts leaking into training text.

Method: an FM-index per training shard. All runs of `run` words of the test items are searched backward through
wavelet-matrix ranks, the occurrences are located by sampled suffix positions, and overlapping hits of one item in one
document are merged into removal spans.

All items travel with one scan of the corpus, up to `SCAN_WORDS` words of them, as word numbers; their runs are laid out
block by block beside the index. A shard's index holds the stretches of at least `run` words that occur somewhere in the test items; other words cannot
be part of a hit, so nothing is lost by leaving them out. Words are compared without case, marks on letters,
punctuation, invisible characters and look-alikes.

Defined cases: null and empty texts and items with fewer than `run` words give nothing; copies of a document or of an
item each give their rows; rows without id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import chunks, column, int64
from .fm_index import FMIndex
from .fold import words

#: Words of a shard's index; bounds the memory of one build.
SHARD_WORDS = 1_500_000
#: Items whose runs are laid out at a time, and words of items that travel with one scan of the corpus (12 bytes each at most).
ITEM_BLOCK, SCAN_WORDS = 20_000, 16_000_000


def _known(items: list[tuple[int, str]], run: int) -> dict[str, np.ndarray] | None:
    """The items of `run` words or more: their vocabulary (sorted word hashes), their words by number, and where each item begins."""
    hashes, off = words([t for _, t in items])
    vocabulary = np.unique(hashes)
    code = (np.searchsorted(vocabulary, hashes) + 1).astype(np.int32)
    long_ = [k for k in range(len(items)) if off[k + 1] - off[k] >= run]
    if not long_:
        return None
    parts = [code[off[k] : off[k + 1]] for k in long_]
    return {"vocabulary": vocabulary, "codes": np.concatenate(parts), "offsets": np.cumsum([0, *map(len, parts)]), "items": np.array([items[k][0] for k in long_], dtype=np.int64)}


def _phrases(known: dict[str, np.ndarray], run: int) -> Iterator[dict[str, np.ndarray]]:
    """Block by block of items: the distinct runs as rows of word numbers, and which items have which run."""
    off = known["offsets"]
    for lo in range(0, len(known["items"]), ITEM_BLOCK):
        hi = min(lo + ITEM_BLOCK, len(known["items"]))
        rows = [np.lib.stride_tricks.sliding_window_view(known["codes"][off[k] : off[k + 1]], run) for k in range(lo, hi)]
        owner = np.repeat(known["items"][lo:hi], [len(r) for r in rows])
        distinct, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        inverse = inverse.ravel()
        order = np.lexsort((owner, inverse))
        pairs = np.unique(np.stack((inverse[order], owner[order])), axis=1)
        yield {"runs": distinct, "owners": pairs[1], "starts": np.searchsorted(pairs[0], np.arange(len(distinct) + 1))}


def _search_shard(index: FMIndex, doc: np.ndarray, word: np.ndarray, known: dict[str, np.ndarray]):
    """(document, item, first word, number of words) of the merged spans of one block of items in a shard."""
    runs, run = known["runs"], known["runs"].shape[1]
    lo, hi = index.ranges(runs)
    n = hi - lo
    which = np.repeat(np.arange(len(runs)), n)
    rows = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = index.locate(rows)
    many = known["starts"][which + 1] - known["starts"][which]
    src = np.repeat(np.arange(len(which)), many)
    item = known["owners"][np.repeat(known["starts"][which], many) + np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)]
    d, w = doc[at[src]], word[at[src]]
    order = np.lexsort((w, item, d))
    d, item, w = d[order], item[order], w[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (w[1:] > w[:-1] + run)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], item[first], w[first], w[last] - w[first] + run if len(first) else w[first]


def _shards(known, run: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = known.value
        vocabulary = k["vocabulary"]
        text, doc, word, held = [], [], [], 0
        blocks = list(_phrases(k, run)) if len(k["items"]) <= ITEM_BLOCK else None  # few enough to keep

        def flush() -> Iterator[pa.RecordBatch]:
            if not text:
                return
            index, docs, places = FMIndex(np.concatenate(text), len(vocabulary) + 1), np.concatenate(doc), np.concatenate(word)
            for block in blocks or _phrases(k, run):
                d, item, first, n = _search_shard(index, docs, places, block)
                if len(d):
                    yield pa.RecordBatch.from_arrays([int64(d), int64(item), int64(first), int64(n)], names=["doc", "item", "first_word", "n_words"])

        for batch in batches:
            ids = column(batch, "doc").to_numpy(zero_copy_only=False)
            texts = column(batch, "text").to_pylist()
            for a, b in chunks(texts):
                h, off = words(texts[a:b])
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known_word = vocabulary[at] == h
                own = np.repeat(np.arange(b - a), np.diff(off))
                # stretches of known words within one document
                new = np.ones(len(h), dtype=bool)
                new[1:] = (known_word[1:] != known_word[:-1]) | (own[1:] != own[:-1])
                starts = np.flatnonzero(new)
                lengths = np.diff(np.append(starts, len(h)))
                long_ = known_word[starts] & (lengths >= run)
                starts, lengths = starts[long_], lengths[long_]
                if not len(starts):
                    continue
                # each stretch followed by a separator
                total = int(lengths.sum()) + len(starts)
                ends = np.cumsum(lengths + 1) - 1
                inside = np.ones(total, dtype=bool)
                inside[ends] = False
                src = np.repeat(starts, lengths) + np.arange(total - len(starts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                t = np.zeros(total, dtype=np.int32)
                t[inside] = at[src] + 1
                d, w = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
                d[inside], w[inside] = ids[a + own[src]], src - off[own[src]]
                text.append(t)
                doc.append(d)
                word.append(w)
                held += total
                if held >= SHARD_WORDS:
                    yield from flush()
                    text, doc, word, held = [], [], [], 0
        yield from flush()

    return work


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 12) -> DataFrame:
    """(doc, item, first_word, n_words): the stretches of documents that are `run` or more words of an item."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).cast("string").alias("text")).where("doc is not null and text is not null")
    wanted = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    schema = "doc long, item long, first_word long, n_words long"
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    scans = max(1, -(-(size["chars"] or 0) // (4 * SCAN_WORDS)))  # a word has some four characters or more
    out = None
    for scan in range(scans if size["n"] else 0):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(scans)) == scan).distinct().collect()
        known = _known([(r["item"], r["text"]) for r in own], run)
        if known is None:
            continue
        part = plain.mapInArrow(_shards(spark.sparkContext.broadcast(known), run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc, item): the documents that hold a passage of an item."""
    return leaked_spans(docs, items, **options).select("doc", "item").distinct()
