"""Given names learnt from a corpus: words that begin names of two words with many different partners, which hardly stand elsewhere.

A given name stands first in capitalised runs of two words, beside many family names; a family name stands beside given
names nearly always. Both sets are found together: from all words with `VARIETY` partners, those are struck out whose
partners are no family names, until nothing changes. Heads of bodies ("Union", "Agency") go because their partners stand
in longer runs, places because they stand alone. A few common names are given beforehand, for corpora too small to learn
from; any other set may take their place.

All texts are counted, whatever their number and length.

Defined cases: no texts give the names given beforehand; null texts and texts without capitals teach nothing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .arrowio import keeping
from .fold import LOOKALIKES

#: Some common given names, without marks, in lower case.
COMMON = frozenset(
    "adrian alexandra alexandru alina ana anca andreea andrei angela bogdan camelia catalin claudia constantin corina cristian cristina dan daniel daniela daria diana dragos elena emil florin gabriel gabriela george gheorghe horia ilinca ioana ion ionel irina iulia iulian laura liviu livia lucian luiza "
    "maria marian marin matei mihaela mihai mihail mircea monica natalia nicolae nicoleta oana octavian olga ovidiu pavel petru radu raluca razvan ruxandra sergiu simona sorin stefan tudor valentin vasile victor victoria vlad vladimir "
    "adam alice andrew anna arthur clara david edward ellen emily emma felix graham helen henry james jane john judith kate laura lucy margaret mark martin mary michael nora oliver owen paul peter "
    "philip richard robert rose ruth sarah simon thomas walter william александр алексей анна антон борис вера виктор владимир галина дмитрий екатерина елена иван игорь ирина лидия людмила марина "
    "михаил надежда наталья николай олег ольга павел светлана сергей тимур федор юлия".split()
)
VARIETY, EXCLUSIVE, SHARE, ALONE, FIRST = 4, 0.6, 0.5, 0.3, 0.6
COUNTS = ["lower", "mentions", "first", "second", "near", "two"]


@lru_cache(300_000)
def form(word: str) -> tuple[str, str]:
    """(folded form, shape) of a token."""
    if word.isascii() and word.islower():
        return word, "low"
    base = unicodedata.normalize("NFKD", word)
    latin = any("a" <= c.lower() <= "z" for c in base)
    folded = "".join((LOOKALIKES.get(c, c) if latin else c) for c in base if not unicodedata.combining(c)).casefold()
    letters = [c for c in base if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    return folded, "low" if not upper else "caps" if upper == len(letters) and upper > 1 else "title" if letters[0].isupper() else "mixed"


@lru_cache(1)
def _word():
    import regex

    return regex.compile(r"[\p{L}\p{M}'’]+(?:-[\p{L}\p{M}'’]+)*")


#: Distinct pieces and runs a task counts before it sends them.
SENT_COUNTS = 300_000


class _Pieces(dict):
    """Numbers of the pieces of texts (what stands between two spaces), by spelling.

    Of each: its words in lower case, and its capitalised ones (chains of them, whether the first chain begins and the last one
    ends the piece; None: it has none), all folded.
    """

    def __init__(self):
        super().__init__()
        self.lower: list[list[str]] = []
        self.named: list[tuple[list[list[str]], bool, bool] | None] = []

    def __missing__(self, piece: str) -> int:
        lower: list[str] = []
        chains: list[list[str]] = []
        first = last = False
        for m in _word().finditer(piece):
            f, shape = form(m.group())
            if shape == "low" or len(f) < 2:
                lower.append(f)
                continue
            first |= m.start() == 0
            last = m.end() == len(piece)
            chains.append([f])
        self[piece] = k = len(self)
        self.lower.append(lower)
        self.named.append((chains, first, last) if chains else None)
        return k


def counted(texts: Iterable[str]) -> Iterator[tuple[Counter, Counter]]:
    """(words in lower case, capitalised runs with single spaces between their words), folded, in as many parts as memory asks for."""
    known, runs = _Pieces(), Counter()
    counts, numbers = np.zeros(0, np.int64), []

    def count() -> np.ndarray:
        more = np.bincount(np.array(numbers, np.int64), minlength=len(known))
        more[: len(counts)] += counts
        return more

    def part() -> tuple[Counter, Counter]:
        lower: Counter = Counter()
        for words, n in zip(known.lower, count().tolist()):
            for f in words:
                lower[f] += n
        return lower, runs

    for text in texts:
        own = [*map(known.__getitem__, text.split(" "))]
        numbers += own
        if len(numbers) > SENT_COUNTS:
            counts, numbers = count(), []
        found = [*map(known.named.__getitem__, own)]
        told: list[tuple[str, ...]] = []
        run: list[str] = []
        before = -1
        for k in compress(range(len(found)), found):
            chains, first, last = found[k]
            if run and (k != before + 1 or not first):
                told.append(tuple(run))
                run = []
            before = k
            run += chains[0]
            for chain in chains[1:]:
                told.append(tuple(run))
                run = [*chain]
            if not last:
                told.append(tuple(run))
                run = []
        if run:
            told.append(tuple(run))
        runs.update(told)
        if len(known) + len(runs) > SENT_COUNTS:
            yield part()
            known, runs = _Pieces(), Counter()
            counts, numbers = np.zeros(0, np.int64), []
    yield part()


def _measured(lower: Counter, runs: Counter) -> tuple[dict[str, list[int]], dict[tuple[str, str], list[int]]]:
    """(word: in lower case, in runs, first and second of runs of two), (two words: side by side, as a run of two; both ways)."""
    words: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    pairs: defaultdict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    for f, n in lower.items():
        words[f][0] += n
    for run, n in runs.items():
        for f in run:
            words[f][1] += n
        for a, b in zip(run, run[1:]):
            if a != b:
                two = n if len(run) == 2 else 0
                words[a][2] += two
                words[b][3] += two
                for pair in ((a, b), (b, a)):
                    pairs[pair][0] += n
                    pairs[pair][1] += two
    return words, pairs


def learnt_given_names(texts: Iterable[str], known: frozenset[str] = COMMON) -> frozenset[str]:
    """The names known beforehand and those the texts teach (folded, in lower case)."""
    every_lower, every_run = Counter(), Counter()
    for lower, runs in counted(texts):
        every_lower.update(lower)
        every_run.update(runs)
    words, pairs = _measured(every_lower, every_run)
    beside: defaultdict[str, dict[str, int]] = defaultdict(dict)
    partners: defaultdict[str, set] = defaultdict(set)
    for (a, b), (near, two) in pairs.items():
        beside[a][b] = near
        if two:
            partners[a].add(b)
    given = {t for t, p in partners.items() if len(p) >= VARIETY and words[t][2] >= FIRST * (words[t][2] + words[t][3]) and words[t][0] < words[t][1]}
    while True:
        family = {
            u for u in partners
            if u not in given and words[u][2] + words[u][3] >= ALONE * words[u][1] and sum(n for g, n in beside[u].items() if g in given) >= EXCLUSIVE * words[u][1]
        }
        left = {t for t in given if len(partners[t] & family) >= VARIETY and sum(n for u, n in beside[t].items() if u in family) >= SHARE * words[t][1]}
        if left == given:
            return known | frozenset(given)
        given = left


def corpus_given_names(texts: DataFrame, text_col: str, cleaned: Callable[[str], str], known: frozenset[str] = COMMON) -> frozenset[str]:
    """`learnt_given_names` of all rows of a table; cleaned: what is done to a text first.

    Words and pairs are counted where the texts stand and added up in tables; the rounds are joins of the pairs in which a
    possible given name stands. Only the names themselves reach the driver.
    """
    spark = texts.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (cleaned(t) for batch in batches for t in batch.column(0).to_pylist())
        for lower, runs in counted(every):
            words, pairs = _measured(lower, runs)
            rows = [(w, None, *n, 0, 0) for w, n in words.items()] + [(a, b, 0, 0, 0, 0, *n) for (a, b), n in pairs.items()]
            for lo in range(0, len(rows), SENT_COUNTS):
                columns = zip(*rows[lo : lo + SENT_COUNTS])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], names=["word", "other", *COUNTS])

    parts = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string")).mapInArrow(keeping(work), "word string, other string, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = materialize(parts.groupBy("word", "other").agg(*(F.sum(c).alias(c) for c in COUNTS)), "names-counts")
    counts.createOrReplaceTempView("names_counts")
    given = materialize(spark.sql(f"""
        SELECT w.word FROM names_counts w JOIN (SELECT word FROM names_counts WHERE other IS NOT NULL AND two > 0 GROUP BY word HAVING count(*) >= {VARIETY}) v ON v.word = w.word
        WHERE w.other IS NULL AND w.first >= {FIRST}D * (w.first + w.second) AND w.lower < w.mentions"""), "names-given")
    given.createOrReplaceTempView("names_given")
    # a: possible given names; possible: whether b may be a family name by its runs of two
    pairs = materialize(spark.sql(f"""
        SELECT p.word AS a, p.other AS b, p.near, p.two, a.mentions AS na, b.mentions AS nb, b.first + b.second > 0 AND b.first + b.second >= {ALONE}D * b.mentions AS possible
        FROM names_counts p JOIN names_given g ON g.word = p.word JOIN names_counts a ON a.word = p.word AND a.other IS NULL JOIN names_counts b ON b.word = p.other AND b.other IS NULL
        WHERE p.other IS NOT NULL"""), "names-pairs")
    pairs.createOrReplaceTempView("names_pairs")
    drop_materialized(counts)
    size = given.count()
    while size:
        left = materialize(spark.sql(f"""
            WITH kept AS (SELECT p.* FROM names_pairs p LEFT SEMI JOIN names_given g ON g.word = p.a),
                 family AS (SELECT k.b FROM kept k LEFT ANTI JOIN names_given g ON g.word = k.b WHERE k.possible GROUP BY k.b, k.nb HAVING sum(k.near) >= {EXCLUSIVE}D * k.nb)
            SELECT k.a AS word FROM kept k LEFT SEMI JOIN family f ON f.b = k.b
            GROUP BY k.a, k.na HAVING count_if(k.two > 0) >= {VARIETY} AND sum(k.near) >= {SHARE}D * k.na"""), "names-given")
        drop_materialized(given)
        given, before, size = left, size, left.count()
        given.createOrReplaceTempView("names_given")
        if size == before:
            break
    names = known | frozenset(r["word"] for r in given.collect())
    drop_materialized(given)
    drop_materialized(pairs)
    return names
