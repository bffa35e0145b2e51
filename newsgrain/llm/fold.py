"""Vectorised text folding: whole Arrow batches of text become arrays of folded code points, words and lines.

A batch is joined into one UTF-32 array and passed through a lookup table over code points, so the cost is a few
nanoseconds a character and no Python object is made per word.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Letters of other alphabets that are drawn like Latin ones.
LOOKALIKES = {
    "а": "a", "А": "A", "в": "b", "В": "B", "е": "e", "Е": "E", "і": "i", "І": "I", "ј": "j", "Ј": "J", "к": "k", "К": "K", "м": "m",
    "М": "M", "н": "h", "Н": "H", "о": "o", "О": "O", "р": "p", "Р": "P", "с": "c", "С": "C", "ѕ": "s", "Ѕ": "S", "т": "t", "Т": "T",
    "у": "y", "У": "Y", "х": "x", "Х": "X", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "ι": "i", "Ι": "I", "Κ": "K", "κ": "k", "Μ": "M", "Ν": "N", "ν": "v", "ο": "o",
    "Ο": "O", "ρ": "p", "Ρ": "P", "Τ": "T", "υ": "u", "Υ": "Y", "Χ": "X", "χ": "x", "ı": "i",
}

TABLE = 0x20000
SEP = 0xE000
#: Classes of a folded code point.
DROP, SPACE, LETTER, DIGIT, NEWLINE, END, SEVERAL = range(7)


@lru_cache(4)
def tables(lookalikes: bool = True) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, ...]]]:
    """For every code point: the folded code, its class, and what the few codes that become several letters become."""
    code = np.arange(TABLE, dtype=np.uint32)
    kind = np.full(TABLE, SPACE, dtype=np.uint8)
    several: dict[int, tuple[int, ...]] = {}
    for c in range(TABLE):
        if 0xD800 <= c < 0xF900 and c != SEP:
            kind[c] = DROP if 0xD800 <= c < 0xE000 else SPACE
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cf", "Mn", "Me", "Mc") or c == 0x00AD:
            kind[c] = DROP
            continue
        if cat[0] not in "LN" and cat != "So":
            continue
        out = []
        for x in unicodedata.normalize("NFKD", ch):
            if lookalikes:
                x = LOOKALIKES.get(x, x)
            for y in unicodedata.normalize("NFKD", x.casefold()):
                y = LOOKALIKES.get(y, y) if lookalikes else y
                if unicodedata.category(y)[0] in "LN":
                    out.append(ord(y))
        if not out:
            continue
        code[c] = out[0]
        kind[c] = LETTER if unicodedata.category(chr(out[0]))[0] == "L" else DIGIT
        if len(out) > 1:
            several[c] = tuple(out)
    kind[0x0A] = NEWLINE
    kind[SEP] = END
    return code, kind, several


def joined(texts: list[str]) -> np.ndarray:
    """The code points of all texts, each text followed by one separator."""
    sep = chr(SEP)
    whole = sep.join(texts)
    if whole.count(sep) != max(len(texts) - 1, 0):
        whole = sep.join(t.replace(sep, " ") for t in texts)
    return np.frombuffer((whole + sep if texts else "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(4)
def _packed(lookalikes: bool) -> np.ndarray:
    """Code and class of every code point in one table: one gather instead of two."""
    code, kind, several = tables(lookalikes)
    kind = kind.copy()
    kind[list(several)] = SEVERAL
    return code | (kind.astype(np.uint32) << np.uint32(24))


def folded(texts: list[str], lookalikes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Folded codes and classes of the joined texts, dropped characters taken out."""
    packed = _packed(lookalikes)
    raw = joined(texts)
    if len(raw) and int(raw.max()) >= TABLE:
        # ideographs of the further planes stay letters; everything else up there is a symbol
        high = raw >= TABLE
        both = packed[np.where(high, np.uint32(0x20), raw)]
        ideograph = high & (raw < 0x40000)
        both[ideograph] = raw[ideograph] | np.uint32(LETTER << 24)
    else:
        both = packed[raw]
    k = (both >> np.uint32(24)).astype(np.uint8)
    hit = np.flatnonzero(k == SEVERAL)
    if len(hit):
        code, kind, several = tables(lookalikes)
        lengths = np.ones(len(raw), dtype=np.int64)
        lengths[hit] = [len(several[int(x)]) for x in raw[hit]]
        starts = np.cumsum(lengths) - lengths
        both = np.repeat(both, lengths)
        for i in hit:
            out = several[int(raw[i])]
            both[starts[i] : starts[i] + len(out)] = np.array(out, dtype=np.uint32) | np.uint32(int(kind[raw[i]]) << 24)
        k = (both >> np.uint32(24)).astype(np.uint8)
    keep = k != DROP
    if not keep.all():
        both, k = both[keep], k[keep]
    return both & np.uint32(0xFFFFFF), k


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    up, down = np.full(n, _MULT, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def run_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of codes: polynomial sums taken as differences of one running sum, mixed with the length."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(1 << max(20, int(len(codes)).bit_length()))
    sums = np.empty(len(codes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((codes + np.uint32(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] ^ (lengths.astype(np.uint64) << np.uint64(48)))


def words(texts: list[str], lookalikes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of folded letters and digits) and, per text, where its words begin (n + 1 offsets)."""
    codes, kinds = folded(texts, lookalikes)
    return _words(codes, kinds, len(texts))[:2]


def _words(codes: np.ndarray, kinds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inside = (kinds == LETTER) | (kinds == DIGIT)
    text_of = np.cumsum(kinds == END)  # of each position: the number of texts that ended before or here
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    first = np.flatnonzero(inside & ~before)
    kept = codes[inside]
    position = np.cumsum(inside) - inside  # position among kept codes
    starts = position[first]
    lengths = np.diff(np.append(starts, len(kept)))
    hashes = run_hashes(kept, starts, lengths)
    offsets = np.searchsorted(text_of[first], np.arange(n + 1), side="left")
    return hashes, offsets, kept, starts, lengths


def word_strings(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The folded words as strings, and the offsets per text."""
    codes, kinds = folded(texts)
    _, offsets, kept, starts, lengths = _words(codes, kinds, len(texts))
    whole = kept.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = starts + lengths
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())], offsets


def line_letters(texts: list[str], lookalikes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line (split at \\n, blank ones included): text number, line number, hash of its letters, their count."""
    codes, kinds = folded(texts, lookalikes)
    brk = (kinds == NEWLINE) | (kinds == END)
    ends = np.flatnonzero(brk)
    letter = kinds == LETTER
    done = np.cumsum(letter)
    upto = done[ends]
    counts = np.diff(np.concatenate(([0], upto)))
    kept = codes[letter]
    hashes = np.zeros(len(ends), dtype=np.uint64)
    full = counts > 0
    starts = (upto - counts)[full]
    hashes[full] = run_hashes(kept, starts, counts[full])
    is_end = kinds[ends] == END
    text_no = np.cumsum(is_end) - is_end
    first_line = np.searchsorted(text_no, np.arange(len(texts)), side="left")
    line_no = np.arange(len(ends)) - first_line[text_no]
    return text_no, line_no, hashes, counts
