"""Binary trie self-join over bit strings, vectorised level by level.

Rows are sorted by (key, bits). A node of the trie at level L is a run of rows that share the key and the first
16 x L bits. The join walks pairs of nodes downward together, adds up the bits in which their labels differ, and drops
a pair of nodes as soon as the sum exceeds the budget - so every pair of rows below it is dropped unseen. Pairs of
nodes are held as arrays, so one step handles very many of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEVEL_BITS = 16
#: Node pairs expanded at a time; only bounds memory, never the result.
STEP = 2_000_000


def _spans(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many pairs of index ranges: all index pairs of each product, and which pair they came from."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    src = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
    w = nb[src]
    return src, a0[src] + k // w, b0[src] + k % w


def trie_self_join(key: np.ndarray, bits: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of row positions with equal key whose bit strings differ in at most `budget` bits.

    key: uint64 of n rows; bits: uint16 of shape (n, levels). Each pair comes once, in either order.
    """
    if len(key) < 2:
        return
    levels = bits.shape[1]
    order = np.lexsort((*(bits[:, k] for k in range(levels - 1, -1, -1)), key))
    key, bits = key[order], bits[order]
    n = len(key)
    # node_at[L][row]: number of the row's node at level L; start[L][node]: its first row
    change = np.ones(n, dtype=bool)
    change[1:] = key[1:] != key[:-1]
    node_at, start = [], []
    for level in range(levels + 1):
        if level:
            change[1:] |= bits[1:, level - 1] != bits[:-1, level - 1]
        node_at.append(np.cumsum(change) - 1)
        start.append(np.append(np.flatnonzero(change), n))
    size = np.diff(start[0])
    roots = np.flatnonzero(size > 1)
    stack = [(0, roots, roots, np.zeros(len(roots), dtype=np.int16))]
    while stack:
        level, a, b, acc = stack.pop()
        if not len(a):
            continue
        sa, ea, sb, eb = start[level][a], start[level][a + 1], start[level][b], start[level][b + 1]
        if level == levels:
            for lo in range(0, len(a), 100_000):
                s = slice(lo, lo + 100_000)
                src, i, j = _spans(sa[s], ea[s], sb[s], eb[s])
                own = (a[s] == b[s])[src]
                ok = ~own | (i < j)
                yield order[i[ok]], order[j[ok]]
            continue
        single = (ea - sa == 1) & (eb - sb == 1)
        if single.any():
            i, j, rest = sa[single], sb[single], acc[single]
            for k in range(level, levels):
                rest = rest + np.bitwise_count(bits[i, k] ^ bits[j, k])
                ok = rest <= budget
                i, j, rest = i[ok], j[ok], rest[ok]
            yield order[i], order[j]
            more = ~single
            a, b, acc, sa, ea, sb, eb = (x[more] for x in (a, b, acc, sa, ea, sb, eb))
            if not len(a):
                continue
        child = node_at[level + 1]
        a0, a1, b0, b1 = child[sa], child[ea - 1] + 1, child[sb], child[eb - 1] + 1
        total = np.cumsum((a1 - a0) * (b1 - b0))
        if total[-1] > STEP and len(a) > 1:
            cut = int(np.searchsorted(total, total[-1] // 2)) + 1
            cut = min(max(cut, 1), len(a) - 1)
            stack += [(level, a[cut:], b[cut:], acc[cut:]), (level, a[:cut], b[:cut], acc[:cut])]
            continue
        src, i, j = _spans(a0, a1, b0, b1)
        own = (a == b)[src]
        label = bits[:, level]
        first = start[level + 1]
        diff = acc[src] + np.bitwise_count(label[first[i]] ^ label[first[j]]).astype(np.int16)
        ok = (diff <= budget) & (~own | (i < j) | ((i == j) & (first[i + 1] - first[i] > 1)))
        stack.append((level + 1, i[ok], j[ok], diff[ok]))
