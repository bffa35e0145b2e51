"""Personal information inside free text: email addresses, phone numbers, identity numbers, street addresses, names.

Method: a skip-chain conditional random field labels the tokens of names; distant repeated or similar tokens share
potentials and loopy message passing makes the labels of a document consistent. Numbers and addresses have a written
form, so they enter as patterns with their check digits. Given names are learnt from all documents of the corpus
itself, and the field is trained on all of them: tokens next to a given name are weak labels, and endings, shapes and
neighbours are what it learns from them. Every text is searched for names with and without capitals. The given and
family names of the corpus are sent to every task.

Invisible characters, full-width forms and kinds of space or hyphen do not hide anything; what is reported are exactly
the characters that stand in the text.

Defined cases: null and blank texts have nothing; a text of any length is searched whole; the same characters twice in
one document are one row; copies of a document each give their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import accumulate, chain, compress

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import dumps as pickled
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .arrowio import caches_kept, column, keeping
from .given_names import COMMON, corpus_given_names, form, learnt_given_names
from .skip_chain import FAMILY, FEATURE_BITS, GIVEN, LABELS, Graph, Model, O, decode, graph_of, train

#: Documents that are made one graph.
BATCH = 1000
#: A type is a family name if it stands beside a given name in this share of its runs or more.
FAMILY_SHARE = 0.5
#: Columns of the table of graphs (those of the second list are for message passing), parts of one in which sums over it are
#: counted, and numbers of a sum that travel as one value.
GRAPH, WHOLE, SCALE, BLOCK = ["features", "told", "pairs"], ["node_rows", "chain", "repeated", "similar"], 1 << 20, 1 << 14
#: Spellings of pieces that a lexicon remembers.
PIECES = 300_000

#: Characters that are written otherwise but mean the same (full-width forms, spaces, hyphens).
_SPACES = [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_HYPHENS = [0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63]
SAME = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(_SPACES, " ") | dict.fromkeys(_HYPHENS, "-")
INVISIBLE = "[­͏؜᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]"

#: Written forms. Street words and details of three languages, number formats of two countries.
EMAIL = r"(?<![\w.+%-])[\w.+%-]*[\w+]\s{0,2}(?:@|\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\}|\(\s?a\s?rond\s?\)|\[\s?arond\s?\]|(?<=\s)arond(?=\s))\s{0,2}[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?(?:\s?(?:\.|\(dot\)|\[dot\]|\(punct\)|\[punct\]|(?<=\s)punct(?=\s)|(?<=\s)dot(?=\s))\s?[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?)*?\s?(?:\.|\(dot\)|\[dot\]|\(punct\)|\[punct\]|(?<=\s)punct(?=\s)|(?<=\s)dot(?=\s))\s?\p{L}{2,}(?![\p{L}\d-]|\.[\p{L}\d])"
PHONE = r"(?<![\d+/\p{L}])(?<!\d[.,/-])(?:(?:\+|00)40[ .-]?\(?0?\d{3}\)?(?:[ .-]?\d{3}){2}|(?:\+|00)40[ .-]?\(?\d{2}\)?[ .-]?\d{3}[ .-]?\d{4}|(?:\+|00)373[ .-]?\(?\d{2,3}\)?[ .-]?\d{2,3}[ .-]?\d{3}|\(0\d{2,3}\)[ .-]?(?:\d{2}[ .-]?\d{2}[ .-]?\d{2}|\d{3}[ .-]?\d{3,4})|0[2-9]\d{2}[ .-]?\d{3}[ .-]?\d{3}|0\d{2}[ .-]\d{3}[ .-]\d{3,4}|0[2-9]\d{2}(?:[ .-]\d{2}){3}|\+(?!40|373)\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3})(?![\d/]|[.,-]\d)"
CODE = r"(?<![\d\p{L}.,/-])(?<!\d )\d(?: ?\d){12}(?![\d/]|[.,-]\d| \d)"
CARD = r"(?r)(?<![\p{L}\d])\p{L}{2}[ .-]{0,2}(?:(?:nr|no|№)\.?\s{0,2}|numărul\s)?\d{6}(?![\d/]|[.,]\d)"
_UNIT = r"(?:,?\s{1,2}(?:bl|bloc|blocul|sc|scara|et|etaj|etajul|ap|apt|apartament|apartamentul|corp|tronson|cam)\.?\s{0,2}(?:\p{L}?\d{1,4}\p{L}?|\p{L})(?![\p{L}\d]))*"
_NAME = r"(?:[\p{L}\p{M}\d][\p{L}\p{M}.'-]*\s){0,4}?[\p{L}\p{M}\d][\p{L}\p{M}'-]*"
#: Street words; those of the first line always, those of the second only with a full stop.
STREET_WORDS = "str bd b-dul bdul sos șos şos strada bulevardul bulevard soseaua șoseaua şoseaua calea aleea splaiul piata piața piaţa fundatura fundătura prelungirea".split()
STREET_SHORT = "al bul cal spl p-ta p-ța p-ţa".split()
STREET = r"(?<![\p{L}\d])(?:\L<words>(?:\.\s?|\s)|\L<short>\.\s?)" + _NAME + r"(?:,?\s{1,2}(?:nr|no|num[aă]rul|num[aă]r)\.?\s{0,2}|,?\s{1,2})\d{1,4}(?:\s?bis(?!\p{L})|\s?[-/]\s?\d{1,3}|\p{L}(?![\p{L}\d]))?" + _UNIT
STREET_RU_WORDS = "ул улица улице пр пр-т просп проспект пер переулок бул бульвар б-р ш шоссе наб пл".split()
STREET_RU = r"(?<![\p{L}\d])\L<words>(?:\.\s?|\s)" + _NAME + r",?\s{1,2}(?:д|дом)\.?\s?\d{1,4}\p{L}?(?![\p{L}\d])(?:,?\s{1,2}(?:корп|корпус|стр|кв|квартира|подъезд|под|эт|этаж)\.?\s?\d{1,4}\p{L}?(?![\p{L}\d]))*"
STREET_EN = r"(?<![\p{L}\d])(?:(?:Flat|Apt\.?|Apartment|Unit)\s\d{1,4}\p{L}?,\s)?\d{1,4}\p{L}?\s(?:\p{Lu}[\p{L}'-]*\s){1,3}(?:Lane|Road|Street|Avenue|Close|Row|Way|Court|Drive|Hill|Square|Place|Terrace|Crescent|St\.|Rd\.|Ave\.)(?!\p{L})(?:,?\s(?:Flat|Apt\.?|Apartment|Floor|Block|Unit|Stair)\s(?:\p{L}?\d{1,4}\p{L}?|\p{L})(?![\p{L}\d]))*"
#: What a text with a match of the street patterns must hold (plain substrings, looked for first because that is cheap).
_STREET_TOKENS = frozenset([*STREET_WORDS, *(f"{w}." for w in STREET_WORDS + STREET_SHORT)])
_STREET_DOTTED = [f"{w}." for w in STREET_WORDS if len(w) < 6]
_SIGNS_EN = "lane road street avenue close row way court drive hill square place terrace crescent st. rd. ave.".split()
#: Patterns that begin with (?r) are matched backwards from where a number begins or ends, so no window cuts their context.
#: Words before a number of thirteen digits that make it something else.
NOT_A_CODE = r"(?r)(?:de\s+bare|barcode|bar\s+code|штрих-?код\w*|iban|lot(?:ul)?)\W{0,3}"
#: Fixed value: words before two letters and six digits that make it an identity card even in lower case.
CARD_BEFORE = r"(?r)(?:seria|serie|c\.?\s?i\.?|buletin\w*|carte\w*|identity number|card|удостоверени\w*|сери\w*)[\s:]{0,3}"

KINDS = ["email", "phone", "id_number", "address", "name"]


@lru_cache(1)
def _patterns():
    import re

    import regex

    i = regex.IGNORECASE
    return {
        "email": regex.compile(EMAIL, i), "phone": regex.compile(PHONE), "code": regex.compile(CODE), "card": regex.compile(CARD),
        "street": [regex.compile(STREET, i, words=STREET_WORDS, short=STREET_SHORT), regex.compile(STREET_RU, i, words=STREET_RU_WORDS)], "street_en": regex.compile(STREET_EN), "street_en_low": regex.compile(STREET_EN, i),
        "not_code": regex.compile(NOT_A_CODE, i), "card_before": regex.compile(CARD_BEFORE, i), "invisible": re.compile(INVISIBLE),
        "hint": regex.compile(r"@|[(\[{]\s?(?:at|a\s?rond|AT|A\s?ROND)\s?[)\]}]|(?<=\s)(?:arond|AROND)(?=\s)"), "digit": regex.compile(r"\d"),
        "six": regex.compile(r"(?<!\d)\d{6}(?![\d/]|[.,]\d)"), "same": re.compile("[" + "".join(chr(c) for c in SAME) + "]"), "odd": re.compile("[" + "".join(chr(c) for c in SAME) + INVISIBLE[1:]),
        "phone_begins": regex.compile(r"\+\d|(?<!\d)0\d\d"), "hint_begins": regex.compile(r"@|[(\[{](?:\s|a|$)|arond", i),
        "run": regex.compile(r"(?<![\p{L}\p{M}\p{N}_@.+-])(?:\p{Lu}[\p{L}\p{M}'’]+(?:-\p{Lu}[\p{L}\p{M}'’]+)?)(?: (?:\p{Lu}[\p{L}\p{M}'’]+(?:-\p{Lu}[\p{L}\p{M}'’]+)?)(?![\p{L}\p{M}\p{N}_@]))+"),
        "word": regex.compile(r"[\p{L}\p{M}'’]+(?:-[\p{L}\p{M}'’]+)*"),
    }


def plain(text: str) -> tuple[str, np.ndarray | None]:
    """The text with one way of writing spaces, hyphens and ASCII, and where its characters stood (None: at the same places)."""
    if not _patterns()["odd"].search(text):
        return text, None
    same = _patterns()["same"].sub(lambda m: SAME[ord(m.group())], text)
    gone = [m.start() for m in _patterns()["invisible"].finditer(same)]
    if not gone:
        return same, None
    keep = np.delete(np.arange(len(text) + 1), gone)
    return "".join([same[i] for i in keep[:-1].tolist()]), keep


def code_checks(digits: str) -> bool:
    """Whether the last of thirteen digits checks: a CNP with a possible date, or an IDNP."""
    d = [int(c) for c in digits]
    total = sum(a * b for a, b in zip(d, (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9))) % 11
    if (1 if total == 10 else total) == d[12] and d[0] and 1 <= d[3] * 10 + d[4] <= 12 and 1 <= d[5] * 10 + d[6] <= 31:
        return True
    return d[0] in (0, 2) and sum(a * b for a, b in zip(d, (7, 3, 1) * 4)) % 10 == d[12]


#: What a piece of a text (what stands between two spaces) shows, as bits: a match of a written form needs a piece that shows it.
DIGIT, HINT, STREET_SIGN, STREET_RU_SIGN, STREET_EN_SIGN, SIX, PHONE_BEGINS = (1 << k for k in range(7))


#: Above them: whether a word of the piece is a given name, and how many of its tokens as written are.
GIVEN_WORD, GIVEN_TOKENS = 1 << 7, 8


@lru_cache(300_000)
def signs(piece: str) -> int:
    """What a piece shows."""
    p, low = _patterns(), piece.lower()
    found = 0
    if p["digit"].search(piece):
        found = DIGIT | bool(p["six"].search(piece)) * SIX | bool(p["phone_begins"].search(piece)) * PHONE_BEGINS
    if p["hint_begins"].search(piece):
        found |= HINT
    if not _STREET_TOKENS.isdisjoint(low.replace("(", " ").replace("„", " ").replace('"', " ").replace("«", " ").split()) or any([x in low for x in _STREET_DOTTED]):
        found |= STREET_SIGN
    if "д." in low or "дом" in low:
        found |= STREET_RU_SIGN
    if any([x in low for x in _SIGNS_EN]):
        found |= STREET_EN_SIGN
    return found


def written_forms(t: str, bits: list[int] | None = None) -> list[tuple[int, int, str]]:
    """Spans of emails, phones, identity numbers and addresses in a plain text; bits: what its pieces show."""
    p = _patterns()
    out: list[tuple[int, int, str]] = []
    shown = 0
    for x in set(map(signs, t.split(" ")) if bits is None else bits):
        shown |= x

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in out)

    end = 0
    for h in p["hint"].finditer(t) if shown & HINT else ():
        # an address stands around its sign, within one run of characters that is as long as it likes
        if h.start() >= end:
            first = h.start()
            while first and h.start() - first < 3 and t[first - 1].isspace():
                first -= 1
            while first and not t[first - 1].isspace():
                first -= 1
            m = p["email"].search(t, first)
            if m and m.start() < h.end() and m.end() > h.end():
                out.append((*m.span(), "email"))
                end = m.end()
    if not shown & DIGIT:
        return out
    if shown & STREET_SIGN:
        out += [(*m.span(), "address") for m in p["street"][0].finditer(t) if free(*m.span())]
    if shown & STREET_RU_SIGN:
        out += [(*m.span(), "address") for m in p["street"][1].finditer(t) if free(*m.span())]
    if shown & STREET_EN_SIGN:
        english = p["street_en_low"] if t == t.lower() else p["street_en"]
        out += [(*m.span(), "address") for m in english.finditer(t) if free(*m.span())]
    for m in p["code"].finditer(t):
        if free(*m.span()) and code_checks(m.group().replace(" ", "")) and not p["not_code"].match(t, 0, m.start()):
            out.append((*m.span(), "id_number"))
    for six in p["six"].finditer(t) if shown & SIX else ():
        m = p["card"].match(t, 0, six.end())
        if not m:
            continue
        letters = m.group()[:2]
        if free(*m.span()) and (letters.isupper() or p["card_before"].match(t, 0, m.start())) and letters.lower() not in ("nr", "no"):
            out.append((*m.span(), "id_number"))
    if shown & PHONE_BEGINS:
        out += [(*m.span(), "phone") for m in p["phone"].finditer(t) if free(*m.span())]
    return out


def _feature(*parts: object) -> int:
    import zlib

    return zlib.crc32("|".join(map(str, parts)).encode()) & ((1 << FEATURE_BITS) - 1)


#: Characters at the ends of a word that are not part of it.
EDGES = ".,;:!?()[]{}<>\"'„”“«»…’‘|*"


class _Given(dict):
    """Whether a word as written, with what clings to it, is a given name; looked up once a spelling."""

    def __init__(self, names: frozenset[str]):
        super().__init__()
        self.names = names

    def __missing__(self, word: str) -> bool:
        folded = form(word.strip(EDGES))[0]
        found = bool(folded) and all(x in self.names for x in folded.split("-"))
        if len(self) < 500_000:
            self[word] = found
        return found


class _Bits(dict):
    """What a piece shows, its given names included; looked up once a spelling."""

    def __init__(self, given: _Given):
        super().__init__()
        self.given = given

    def __missing__(self, piece: str) -> int:
        tokens = sum(map(self.given.__getitem__, piece.replace("/", " ").split()))
        found = signs(piece) | any([self.given[w] for w in _patterns()["word"].findall(piece)]) * GIVEN_WORD | tokens << GIVEN_TOKENS
        if len(self) < PIECES:
            self[piece] = found
        return found


class Lexicon:
    """The given names, and what follows from them for tokens: features and runs, remembered by spelling."""

    def __init__(self, given: frozenset[str]):
        self.given = _Given(given)
        self.bits = _Bits(self.given)
        self.own, self.near, self.run = lru_cache(300_000)(self._own), lru_cache(300_000)(self._near), lru_cache(300_000)(self._run)

    def _own(self, word: str) -> tuple[int, ...]:
        (f, shape), given = form(word), self.given[word]
        last = f.rsplit("-", 1)[-1]
        return (_feature("w", f), _feature("s3", last[-3:]), _feature("s4", last[-4:]), _feature("s2", last[-2:]), _feature("shape", shape, given), _feature("given", given), _feature("long", min(len(last), 9), "-" in f))

    def _near(self, side: str, word: str | None) -> tuple[int, ...]:
        if word is None:
            return (_feature(side, None), _feature(side, "g", None))
        (f, shape), given = form(word), self.given[word]
        return (_feature(side, "s", f[-3:], given), _feature(side, "g", given, shape))

    def _run(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, ...]], list[str], list[bool]]:
        """Of a run of tokens: (token, start, end), the features and the folded form of each, and whether it is a given name."""
        words = [(m.group(), *m.span()) for m in _patterns()["word"].finditer(text)]
        near = [None, *(w for w, _, _ in words), None]
        features = [self.own(w) + self.near("l", near[i]) + self.near("r", near[i + 2]) for i, (w, _, _) in enumerate(words)]
        return words, features, [form(w)[0] for w, _, _ in words], [self.given[w] for w, _, _ in words]

    def unmarked(self, t: str, found: list[tuple[int, int]], bits: list[int] | None = None) -> list[tuple[int, int]]:
        """Runs of a given name and its neighbours that are no capitalised runs (`found`); bits: what the pieces of the text show."""
        if bits is None:
            bits = [*map(self.bits.__getitem__, t.split(" "))]
        told = sum([x >> GIVEN_TOKENS for x in bits if x >= GIVEN_WORD])
        # as many given names as the capitalised runs hold: none is left over
        if not told or told <= sum([sum(self.run(t[a:b])[3]) for a, b in found]):
            return []
        pieces = t.split(" ")
        starts = [0, *accumulate([len(x) + 1 for x in pieces])]

        def words_of(i: int) -> list[tuple[int, int]]:
            return [(starts[i] + m.start(), starts[i] + m.end()) for m in _patterns()["word"].finditer(pieces[i])] if 0 <= i < len(pieces) else []

        out: list[tuple[int, int]] = []
        at = 0
        for i in compress(range(len(pieces)), [x & GIVEN_WORD for x in bits]):
            # no word goes beyond its piece, so its neighbours stand there or in the pieces beside it
            before, own = words_of(i - 1), words_of(i)
            words = [*before, *own, *words_of(i + 1)]
            for k, (a, b) in enumerate(own, len(before)):
                while at < len(found) and found[at][1] <= a:
                    at += 1
                if not self.given[t[a:b]] or at < len(found) and found[at][0] < b:
                    continue
                left = words[k - 1][0] if k and t[words[k - 1][1] : a] == " " else a
                right = words[k + 1][1] if k + 1 < len(words) and t[b : words[k + 1][0]] == " " else b
                if at and left < found[at - 1][1]:
                    left = a
                if at < len(found) and right > found[at][0]:
                    right = b
                if out and left < out[-1][1]:
                    left = min(out[-1][0], left)
                    out.pop()
                out.append((left, right))
        return out


@lru_cache(4)
def lexicon(given: frozenset[str]) -> Lexicon:
    return Lexicon(given)


#: Tokens are similar if they begin with so many common letters and their lengths differ by no more than an ending has.
STEM, ENDING = 5, 3


class Batch:
    """Candidate tokens of a list of plain texts as one graph; tokens of equal runs share their rows of features."""

    def __init__(self, texts: list[str], lex: Lexicon, unmarked: list[bool] | bool = True, bits: list[list[int]] | None = None):
        """unmarked: whether to take runs without capitals (of each text); bits: what their pieces show."""
        p = _patterns()
        self.runs: list[tuple[int, int, str, bool]] = []  # text, start, run, whether of capitalised words
        self.first: list[int] = []  # its first node
        features: list[tuple[int, ...]] = []
        rows: list[int] = []
        row_of: dict[str, int] = {}
        repeated: list[tuple[int, int]] = []
        similar: list[tuple[int, int]] = []
        n = 0
        for k, t in enumerate(texts):
            found = [m.span() for m in p["run"].finditer(t)]
            last: dict[str, int] = {}
            stems: dict[str, tuple[str, int]] = {}
            every = [(True, x) for x in found]
            if unmarked if isinstance(unmarked, bool) else unmarked[k]:
                every += [(False, x) for x in lex.unmarked(t, found, bits and bits[k])]
            for marked, (a, b) in every:
                run = t[a:b]
                words, own, types, _ = lex.run(run)
                if len(words) < 2:
                    continue
                self.runs.append((k, a, run, marked))
                self.first.append(n)
                row = row_of.get(run)
                if row is None:
                    row = row_of[run] = len(features)
                    features += own
                rows += range(row, row + len(words))
                for i, f in enumerate(types, n):
                    if f in last:
                        repeated.append((last[f], i))
                    last[f] = i
                    if len(f) > STEM:
                        other, at = stems.get(f[:STEM], (f, i))
                        if other != f and abs(len(other) - len(f)) <= ENDING:
                            similar.append((at, i))
                        stems[f[:STEM]] = (f, i)
                n += len(words)
        width = len(features[0]) if features else 1
        self.features = np.fromiter(chain.from_iterable(features), np.int64, len(features) * width).reshape(-1, width)
        self.rows = np.array(rows, dtype=np.int64)
        right = np.delete(np.arange(n), self.first)
        self.edges = [np.stack((right - 1, right), axis=1), *(np.array(e, dtype=np.int64).reshape(-1, 2) for e in (repeated, similar))]

    def names(self, labels: np.ndarray, lex: Lexicon) -> list[tuple[int, int, int]]:
        """(text, start, end) of a given name beside a family name."""
        out, free = [], 0
        left, right = self.edges[0].T
        at = left[(labels[left] != labels[right]) & (labels[left] != O) & (labels[right] != O)]
        for i, r in zip(at.tolist(), (np.searchsorted(self.first, at, "right") - 1).tolist()):
            if i >= free:
                k, start, run, _ = self.runs[r]
                words = lex.run(run)[0]
                out.append((k, start + words[i - self.first[r]][1], start + words[i + 1 - self.first[r]][2]))
                free = i + 2
        return out


def marked_runs(texts: Iterable[str]) -> Counter[str]:
    """The capitalised runs of plain texts with their numbers."""
    out: Counter[str] = Counter()
    for t in texts:
        out.update(_patterns()["run"].findall(t))
    return out


def _read(run: str, lex: Lexicon) -> tuple[list[str], list[bool]]:
    """Of the tokens of a run: their types, and whether they are given names."""
    words = _patterns()["word"].findall(run)
    return [form(w)[0] for w in words], [lex.given[w] for w in words]


def beside_given(runs: Iterable[tuple[str, int]], lex: Lexicon) -> dict[str, list[int]]:
    """Of every type that is no given name: how often it stands beside one, and how often in a run."""
    out: dict[str, list[int]] = {}
    for run, n in runs:
        types, given = _read(run, lex)
        if len(types) > 1:
            for f, own, left, right in zip(types, given, [False, *given], [*given[1:], False]):
                if not own:
                    c = out.setdefault(f, [0, 0])
                    c[0] += n * (left or right)
                    c[1] += n
    return out


def run_labels(types: list[str], given: list[bool], share: Mapping[str, float]) -> list[int]:
    """Labels of a run: a given name and that neighbour which is most of a family name (share: 0.5 or more for such types)."""
    n = len(types)
    out = [O] * n
    for i in range(n):
        if given[i]:
            sides = [(share.get(types[j], 0.0), -d, j) for d, j in ((0, i + 1), (1, i - 1)) if 0 <= j < n and not given[j] and out[j] == O]
            if sides and max(sides)[0] >= FAMILY_SHARE:
                out[i], out[max(sides)[2]] = GIVEN, FAMILY
    return out


def families_in(runs: Iterable[str], lex: Lexicon, share: Mapping[str, float]) -> set[str]:
    """The family names among the types of capitalised runs."""
    out: set[str] = set()
    for run in runs:
        types, given = _read(run, lex)
        if len(types) > 1:
            out.update(f for f, label in zip(types, run_labels(types, given, share)) if label == FAMILY)
    return out


def weak_labels(batch: Batch, lex: Lexicon, share: Mapping[str, float], family: Mapping[str, float]) -> np.ndarray:
    """Labels from the given names alone.

    In capitalised runs a type that mostly stands beside a given name (`share`) is a family name there; in other runs only the
    family names so found (`family`) are.
    """
    out: list[int] = []
    known: dict[tuple[str, bool], list[int]] = {}
    for _, _, run, marked in batch.runs:
        told = known.get((run, marked))
        if told is None:
            _, _, types, given = lex.run(run)
            told = known[run, marked] = run_labels(types, given, share if marked else family)
        out += told
    return np.array(out, dtype=np.int64)


def graphs(texts: list[str], in_lower: list[bool], lex: Lexicon, share: Mapping[str, float], family: Mapping[str, float]) -> Iterator[Graph]:
    """What the field is trained on: plain texts as they are, and copies of some in lower case, which teach it texts without capitals."""
    low = [t.lower() for t in compress(texts, in_lower)]
    batch = Batch(texts + low, lex, [False] * len(texts) + [True] * len(low))  # there only the copies know which words are family names
    if batch.runs:
        yield graph_of(batch.features, batch.rows, weak_labels(batch, lex, share, family), batch.edges)


def train_names(texts: list[str], known: frozenset[str] = COMMON) -> Model:
    """The field from weak labels; a copy of every third text in lower case teaches it texts without capitals."""
    lex = lexicon(learnt_given_names(texts, known))
    runs = marked_runs(texts)
    share = {f: a / b for f, (a, b) in beside_given(runs.items(), lex).items() if a / b >= FAMILY_SHARE}
    family = dict.fromkeys(families_in(runs, lex, share), 1.0)
    made = [g for lo in range(0, len(texts), BATCH) for g in graphs(texts[lo : lo + BATCH], [k % 3 == 0 for k in range(lo, min(lo + BATCH, len(texts)))], lex, share, family)]
    none = np.empty(0, np.int64)
    empty = graph_of(none.reshape(0, 1), none, none, [none.reshape(0, 2)] * 3)
    model = train(lambda f, _: [sum(x) for x in zip(*map(f, made or [empty]))])
    model.given = lex.given.names
    return model


def find_all(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """Per text: the spans (start, end, kind) in the original characters, in order, without overlaps."""
    made = [plain(t) for t in texts]
    lex = lexicon(model.given)
    bits = [[*map(lex.bits.__getitem__, t.split(" "))] for t, _ in made]
    out: list[list[tuple[int, int, str]]] = [written_forms(t, x) for (t, _), x in zip(made, bits)]
    batch = Batch([t for t, _ in made], lex, bits=bits)
    labels, _ = decode(model, batch.features, batch.rows, batch.edges)
    for k, a, b in batch.names(labels, lex):
        if all(b <= x or a >= y for x, y, _ in out[k]):
            out[k].append((a, b, "name"))
    for k, (_, at) in enumerate(made):
        out[k].sort()
        if at is not None:
            out[k] = [(int(at[a]), int(at[b - 1]) + 1, kind) for a, b, kind in out[k]]
    return out


def _cleaned(text: str) -> str:
    return plain(text)[0]


def _packed(graph: Graph) -> list[bytes]:
    chain, *skip = graph.edges
    return [graph.features.astype("<u2").tobytes(), graph.told.astype("<u4").tobytes(), np.stack(graph.pairs).astype("<u4").tobytes(), graph.rows.astype("<u4").tobytes(), chain[:, 1].astype("<u4").tobytes(), *(e.astype("<u4").tobytes() for e in skip)]


def _unpacked(features: pa.Buffer, told: pa.Buffer, pairs: pa.Buffer, rows: pa.Buffer | None = None, *edges: pa.Buffer) -> Graph:
    """A graph, without nodes and edges if only the first columns are given."""

    def numbers(x: pa.Buffer, kind: str, *shape: int) -> np.ndarray:
        return np.frombuffer(x, kind).astype(np.int64).reshape(shape)

    counts = numbers(told, "<u4", -1, LABELS)
    chain, skip = [numbers(e, "<u4", -1) for e in edges[:1]], [numbers(e, "<u4", -1, 2) for e in edges[1:]]
    nodes = np.empty(0, np.int64) if rows is None else numbers(rows, "<u4", -1)
    return Graph(numbers(features, "<u2", len(counts), -1), counts, nodes, [*(np.stack((x - 1, x), axis=1) for x in chain), *skip], [*numbers(pairs, "<u4", -1, LABELS, LABELS)])


def _summed(table: DataFrame, f: Callable[[Graph], list[np.ndarray]], whole: bool) -> list[np.ndarray]:
    """The arrays that `f` makes of the graphs of a table, added up where they stand; whole: whether `f` needs nodes and edges.

    Sums are of whole numbers, so that they do not depend on the order of the tasks. They travel in blocks of `BLOCK`
    numbers; a block without any is left out.
    """
    spark = table.sparkSession
    one = graph_of(np.zeros((1, 1), np.int64), np.zeros(2, np.int64), np.zeros(2, np.int64), [np.array([[0, 1]])] * 3)
    shapes = [x.shape for x in f(one)]
    sizes = [int(np.prod(x)) for x in shapes]
    sent = spark.sparkContext.broadcast(pickled(f))
    columns = GRAPH + WHOLE * whole

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = pickle.loads(sent.value), None
        for batch in batches:
            for k in range(batch.num_rows):
                flat = np.concatenate([x.ravel() for x in made(_unpacked(*(batch.column(c)[k].as_buffer() for c in range(len(columns)))))])
                flat *= SCALE
                whole_numbers = np.rint(flat, out=flat).astype(np.int64)
                total = whole_numbers if total is None else np.add(total, whole_numbers, out=total)
        if total is not None:
            parts = [(k, x.tobytes()) for k, x in enumerate(np.split(total, range(BLOCK, len(total), BLOCK))) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(x.as_buffer(), np.int64)
                total[k] = total[k] + part if k in total else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])

    rows = table.select(*columns).mapInArrow(work, "block long, sums binary").repartition("block").mapInArrow(add, "block long, sums binary").toArrow()
    sent.destroy()
    total = np.zeros(sum(sizes))
    for k, x in zip(rows.column("block").to_pylist(), rows.column("sums")):
        part = np.frombuffer(x.as_buffer(), np.int64)
        total[k * BLOCK : k * BLOCK + len(part)] = part / SCALE
    return [x.reshape(shape) for x, shape in zip(np.split(total, np.cumsum(sizes)[:-1]), shapes)]


def _model(docs: DataFrame, id_col: str, text_col: str) -> Model:
    """`train_names` of all documents of a table: counts, labels and every step of the training are sums over tables.

    Copies in lower case are of the documents whose hash is a multiple of three.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"), (F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).alias("low")).where("text is not null")
    lex = spark.sparkContext.broadcast(corpus_given_names(texts, "text", _cleaned, COMMON))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = marked_runs(map(_cleaned, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(runs.keys(), pa.string()), pa.array(runs.values(), pa.int64())], names=["run", "n"])

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = beside_given(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lexicon(lex.value))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *(pa.array([c[k] for c in found.values()], pa.int64()) for k in range(2))], names=["type", "near", "n"])

    runs = materialize(texts.select("text").mapInArrow(keeping(runs_of), "run string, n long").groupBy("run").agg(F.sum("n").alias("n")), "field-runs")
    beside = runs.mapInArrow(keeping(counts_of), "type string, near long, n long").groupBy("type").agg(F.sum("near").alias("near"), F.sum("n").alias("n"))
    share = spark.sparkContext.broadcast({r["type"]: r["near"] / r["n"] for r in beside.where(F.col("near") / F.col("n") >= FAMILY_SHARE).collect()})

    def families_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(families_in(batch.column(0).to_pylist(), lexicon(lex.value), share.value), pa.string())], names=["type"])

    family = spark.sparkContext.broadcast(dict.fromkeys((r["type"] for r in runs.select("run").mapInArrow(keeping(families_of), "type string").distinct().collect()), 1.0))
    drop_materialized(runs)

    def graphs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, low = [[*map(_cleaned, batch.column(0).to_pylist())], batch.column(1).to_pylist()]
            for lo in range(0, len(every), BATCH):
                made = [_packed(g) for g in graphs(every[lo : lo + BATCH], low[lo : lo + BATCH], lexicon(lex.value), share.value, family.value)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*made)], names=GRAPH + WHOLE)

    table = materialize(texts.mapInArrow(keeping(graphs_of), ", ".join(f"{c} binary" for c in GRAPH + WHOLE)), "field-graphs")
    model = train(lambda f, whole: _summed(table, f, whole))
    drop_materialized(table)
    model.given = lex.value
    return model


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, kind, found): one row per document, kind and distinct text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or _model(docs, id_col, text_col))
    plain_docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                texts = column(batch, "text").to_pylist()
                rows = [(k, kind, found) for k, spans in enumerate(find_all(texts, sent.value)) for kind, found in dict.fromkeys((kind, texts[k][a:b]) for a, b, kind in spans)]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([column(batch, "id").take(take), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["id", "kind", "found"])

    return plain_docs.mapInArrow(keeping(work), f"id {plain_docs.schema['id'].dataType.simpleString()}, kind string, found string")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "redacted", model: Model | None = None) -> DataFrame:
    """`docs` with `out_col`: the text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of what was found."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or _model(docs, id_col, text_col))

    @F.pandas_udf("string")
    def replace(text):
        import pandas as pd

        texts = [t if isinstance(t, str) else "" for t in text]
        out = []
        for lo in range(0, len(texts), 1000):
            with caches_kept():
                every = find_all(texts[lo : lo + 1000], sent.value)
            for t, spans in zip(texts[lo : lo + 1000], every):
                parts, at = [], 0
                for a, b, kind in spans:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                out.append("".join(parts) + t[at:])
        return pd.Series([o if isinstance(t, str) else None for o, t in zip(out, text)])

    return docs.withColumn(out_col, replace(F.col(text_col).cast("string")))
