"""Repeated byte strings of a corpus, by suffix arrays over minimizer groups.

Every string of ``window`` bytes is a window at a place of a document. Its
minimizer is the k-gram in it with the smallest hash, leftmost on ties, so that
equal windows have equal minimizers at equal offsets. Consecutive windows with
one minimizer form a run, which is a short piece of text around it. Runs, about
two for every window's length of text, are what is shuffled, as hashes.

Where runs share a minimizer, their windows may be equal: the pieces are fetched,
and the suffixes that start at the minimizer, and the reversed prefixes before it,
are each put in order by a deep-shallow sort (multikey quicksort on eight-byte
words to a shallow depth, then a blind trie for each group that is still equal).
From the common prefixes of neighbours, windows at each offset fall into classes
of equal strings, of which those of the smallest doc_id stay, each document's first.
"""

from __future__ import annotations

import numpy as np

from pitchlake.llm.textkernels import BYTE, chunked, mix, powers, sliding_min

WINDOW = 100
K = 20
#: Places of a chunk fit in so many bits of the ordering key; the rest is hash.
PLACE_BITS = 26
SEGMENT = 1 << 20
#: Bytes of text in one NumPy pass.
CHUNK = 1 << 20
SHALLOW = 40


def runs(raws: list[bytes], window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...]:
    """Runs of all texts: (text, first window, windows, minimizer's offset in the first window, minimizer hash, piece hash)."""
    pieces = [(i, s, raw[s : s + SEGMENT + window - 1]) for i, raw in enumerate(raws) for s in range(0, len(raw) - window + 1, SEGMENT)]
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    width = window - k + 1
    place = np.uint64((1 << PLACE_BITS) - 1)
    texts = [p for *_, p in pieces]
    for lo, hi in chunked(texts, CHUNK):
        raw = b"".join(texts[lo:hi])
        n = len(raw)
        up, down = powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE[np.frombuffer(raw, dtype=np.uint8)] * up, out=total[1:])
        h = mix((total[k:] - total[:-k]) * down[: n - k + 1])
        key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, width) & place).astype(np.int64)  # of each window's minimizer
        lengths = np.array([len(t) for t in texts[lo:hi]])
        first = np.cumsum(np.concatenate(([0], lengths[:-1])))
        inside = np.ones(len(at), dtype=bool)  # windows that lie in one piece
        for f, m in zip(first[1:].tolist(), lengths[1:].tolist(), strict=True):
            inside[max(0, f - window + 1) : f] = False
        ok = np.flatnonzero(inside)
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (at[ok[1:]] != at[ok[:-1]]) | (ok[1:] != ok[:-1] + 1)
        begin = np.flatnonzero(new)
        p, count = ok[begin], np.diff(np.append(begin, len(ok)))
        a = at[p]
        body = (total[p + count - 1 + window] - total[p]) * down[p]
        which = np.searchsorted(first, p, side="right") - 1
        source = np.array([[i, s] for i, s, _ in pieces[lo:hi]], dtype=np.int64)
        start = p - first[which] + source[which, 1]
        for column, values in zip(out, (source[which, 0], start, count, a - p, h[a], mix(body + mix((a - p).astype(np.uint64) * np.uint64(256) + count.astype(np.uint64)))), strict=True):
            column.append(values)
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(c) if c else np.empty(0, dtype=d) for c, d in zip(out, kinds, strict=True))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], rows: list[int]) -> list[int]:
    """rows in the order of their strings, by a trie that holds branching places only.

    A string first goes down without comparing what lies between branchings; one
    comparison with the leaf that it reaches gives the place where it belongs.
    """
    root: list = [-1, [rows[0]]]  # a leaf is [-1, rows of one string], a branching [place, {byte or -1: node}]
    for r in rows[1:]:
        s = strings[r]
        node = root
        while node[0] >= 0:
            at = node[0]
            node = node[1].get(s[at] if at < len(s) else -1) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            node[1].append(r)
            continue
        above, node = None, root
        while 0 <= node[0] < n:
            above, node = node, node[1][s[node[0]]]
        mine, leaf = (s[n] if n < len(s) else -1), [-1, [r]]
        if node[0] == n:
            node[1][mine] = leaf
            continue
        branch = [n, {(other[n] if n < len(other) else -1): node, mine: leaf}]
        if above is None:
            root = branch
        else:
            above[1][s[above[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows by (group, string), and each one's common prefix with the one before it in its group (else 0)."""
    n, lengths = len(strings), np.array([len(s) for s in strings])
    wide = max(8, -(-int(lengths.max(initial=1)) // 8) * 8)
    body = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), dtype=np.uint8).reshape(n, wide)
    words = body.view(">u8")
    order = np.argsort(group, kind="stable")
    edge = np.ones(n + 1, dtype=bool)  # where a group of equals begins
    edge[1:-1] = group[order[1:]] != group[order[:-1]]
    for d in range(min(shallow, wide) // 8):  # multikey quicksort, on what is still tied
        tied = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(tied):
            break
        part = (np.cumsum(edge[:-1]) - 1)[tied]
        w = words[order[tied], d]
        by = np.lexsort((w, part))
        order[tied], w = order[tied][by], w[by]
        differs = np.ones(len(tied), dtype=bool)
        differs[1:] = (part[1:] != part[:-1]) | (w[1:] != w[:-1])
        edge[tied] |= differs
    begin = np.flatnonzero(edge)
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi - lo > 1:
            order[lo:hi] = blind_trie_order(strings, order[lo:hi].tolist())
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        same = body[order[1:]] == body[order[:-1]]
        lcp[1:] = np.where(same.all(axis=1), wide, same.argmin(axis=1))
        lcp[1:] = np.minimum(lcp[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
        lcp[1:][group[order[1:]] != group[order[:-1]]] = 0
    return order, lcp


def repeated_windows(group: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, pieces: list[bytes], window: int = WINDOW, k: int = K) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(run, start, end) of the windows of runs that are equal to an earlier one of the same group, touching ones joined; and
    whether all windows of a run are such. Earlier is in a smaller doc, or at a smaller start in the same row of it."""
    n = len(pieces)
    right_order, right_lcp = deep_shallow_sort([s[o:] for s, o in zip(pieces, offset.tolist(), strict=True)], group)
    left_order, left_lcp = deep_shallow_sort([s[:o][::-1] for s, o in zip(pieces, offset.tolist(), strict=True)], group)
    age = np.empty(n, dtype=np.int64)
    age[np.lexsort((start + offset, row, doc))] = np.arange(n)
    repeats = np.zeros((n, int(count.max(initial=1)) + 1), dtype=bool)
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(window - k + 1):  # the minimizer's offset in a window
        here = np.flatnonzero((offset - count < o) & (o <= offset))
        if len(here) < 2:
            continue
        right[right_order] = np.cumsum(right_lcp < window - o)
        left[left_order] = np.cumsum(left_lcp < o)
        by = here[np.lexsort((age[here], left[here], right[here]))]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (right[by[1:]] != right[by[:-1]]) | (left[by[1:]] != left[by[:-1]])
        oldest = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = doc[by] > doc[oldest]
        again[1:] |= ~new[1:] & (doc[by[1:]] == doc[by[:-1]]) & (row[by[1:]] == row[by[:-1]])
        repeats[by[again], offset[by[again]] - o] = True
    change = np.diff(np.concatenate((np.zeros((n, 1), dtype=np.int8), repeats.astype(np.int8)), axis=1), axis=1)
    r, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    return list(zip(r.tolist(), (start[r] + begin).tolist(), (start[r] + end - 1 + window).tolist(), strict=True)), repeats.sum(axis=1) == count
