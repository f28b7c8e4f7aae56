"""Suffix sorting of a shard by external induced sorting, with the common prefix of neighbours.

The suffixes that are smaller than both neighbours' (S*) are sorted by their first DEPTH symbols: blocks of them are
sorted in memory, and a priority queue of the heads of the sorted runs merges them. All other suffixes are induced from them, L-suffixes in
one ascending pass over the first symbols and S-suffixes in one descending pass. The queue of a first symbol is a region of one
array, filled in order and emptied in symbol order. With every suffix the queues carry its common prefix with the one before it in its
queue: one more than the least common prefix of the suffixes that were read in between.

Arrays of shards above the memory bound lie in scratch files without a name, which go with the task, and are read and filled in blocks; so
a shard may be far larger than memory. Orders beyond DEPTH symbols are not needed.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

DEPTH = 200
#: Symbols up to which a shard's arrays are held in memory (about 25 bytes a symbol), and the share of them that one block takes.
MEMORY, BLOCK_SHARE = 1 << 23, 8
#: Symbols of a shard: 0 ends it, 1 ends a string, bytes follow.
END, SEPARATOR, FIRST = 0, 1, 2
_SYMBOLS = 258
_WORD = 7


class Store:
    """Makes the arrays of one shard: in memory, or above the bound in scratch files of ``folder`` (the worker's own if None)."""

    def __init__(self, memory: int = MEMORY, folder: str | None = None):
        self.memory, self.folder = memory, folder
        self.block = max(64, memory // BLOCK_SHARE)

    def empty(self, n: int, dtype) -> np.ndarray:
        if n <= self.memory:
            return np.empty(n, dtype)
        with tempfile.TemporaryFile(dir=self.folder) as file:  # the mapping keeps the space, the name is gone
            file.truncate(n * np.dtype(dtype).itemsize)
            return np.memmap(file, dtype, "r+", shape=(n,))

    def blocks(self, n: int, start: int = 0) -> Iterator[tuple[int, int]]:
        return ((a, min(n, a + self.block)) for a in range(start, n, self.block))

    def text(self, strings: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The strings with separators and an end, as symbols, and where each string starts. Above the bound they go to a file as they come."""
        parts: list[np.ndarray] = []
        starts, size, held, file = [], 0, 0, None

        def flush() -> None:
            nonlocal held
            np.concatenate(parts).tofile(file)
            parts.clear()
            held = 0

        for s in strings:
            part = np.empty(len(s) + 1, np.uint16)
            part[:-1] = np.frombuffer(s, np.uint8)
            part[:-1] += FIRST
            part[-1] = SEPARATOR
            parts.append(part)
            starts.append(size)
            size, held = size + len(part), held + len(part)
            if held > self.memory:
                file = file or tempfile.TemporaryFile(dir=self.folder)
                flush()
        parts.append(np.array([END], np.uint16))
        if file is None:
            return np.concatenate(parts), np.array(starts, np.int64)
        with file:
            flush()
            file.flush()
            return np.memmap(file, np.uint16, "r+", shape=(size + 1,)), np.array(starts, np.int64)


def shard_text(strings: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return Store().text(strings)


def _types(text: np.ndarray, store: Store) -> np.ndarray:
    """True where the suffix is smaller than the one after it (S); the end is S. Blocks are read from the back."""
    n = len(text)
    out = store.empty(n, bool)
    out[n - 1] = True
    for a, b in reversed(list(store.blocks(n - 1))):
        step = np.diff(text[a : b + 1].astype(np.int16))  # above 0: S, below: L, 0: as the next
        at = np.arange(b - a)
        nearest = np.minimum.accumulate(np.where(step != 0, at, b - a)[::-1])[::-1]
        out[a:b] = np.append(step > 0, out[b])[nearest]
    return out


def packed(text: np.ndarray, store: Store) -> np.ndarray:
    """Seven symbols from each position as one number of 63 bits, zeros past the end."""
    n = len(text)
    out = store.empty(n, np.uint64)
    for a, b in store.blocks(n):
        piece = np.zeros(b - a + _WORD - 1, np.uint64)
        piece[: min(n, b + _WORD - 1) - a] = text[a : b + _WORD - 1]
        word = piece[: b - a].copy()
        for k in range(1, _WORD):
            word <<= np.uint64(9)
            word |= piece[k : k + b - a]
        out[a:b] = word
    return out


def _words(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Seven symbols from each position, zeros past the end."""
    last = len(words) - 1
    return np.where(at <= last, words[np.minimum(at, last)], np.uint64(0))


def _sorted_run(words: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols: ties of seven symbols are broken by the next seven."""
    order = np.argsort(_words(words, stars), kind="stable")
    stars = stars[order]
    key = _words(words, stars)
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    for offset in range(_WORD, depth, _WORD):
        same = np.concatenate(([False], group[1:] == group[:-1]))
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        part, mine = stars[tied], group[tied]
        key = _words(words, part + offset)
        order = np.lexsort((key, mine))
        stars[tied] = part[order]
        key = key[order]
        new = np.concatenate(([True], (mine[1:] != mine[:-1]) | (key[1:] != key[:-1])))
        first = np.concatenate(([True], mine[1:] != mine[:-1]))  # mine is in order
        ids = np.cumsum(new) - 1
        group = group * (len(stars) + 1)
        group[tied] += ids - ids[np.flatnonzero(first)][np.cumsum(first) - 1]
        group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
    return stars


def _sorted_stars(text: np.ndarray, words: np.ndarray, small: np.ndarray, depth: int, store: Store) -> np.ndarray:
    """S* suffixes in the order of their first ``depth`` symbols: sorted runs, merged by a priority queue of their heads."""
    n, count, runs = len(text), 0, []
    found = store.empty(n // 2 + 1, np.int64)
    for a, b in store.blocks(n, 1):
        at = np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1]) + a
        found[count : count + len(at)] = at
        count += len(at)
    for a, b in store.blocks(count):
        found[a:b] = _sorted_run(words, np.array(found[a:b]), depth)
        runs.append((a, b))
    if len(runs) == 1:
        return found[:count]
    piece = max(16, store.block // len(runs))

    def tuples(a: int, b: int) -> Iterator[tuple[bytes, int]]:
        for i in range(a, b, piece):
            for p in found[i : min(b, i + piece)].tolist():
                yield text[p : p + depth].astype(">u2").tobytes(), p

    out, at, some = store.empty(count, np.int64), 0, []
    for _, p in heapq.merge(*(tuples(a, b) for a, b in runs), key=lambda x: x[0]):
        some.append(p)
        if len(some) == store.block:
            out[at : at + len(some)] = some
            at += len(some)
            some.clear()
    out[at:count] = some
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and at ``b`` share, up to ``depth``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for offset in range(0, depth, _WORD):
        x = _words(words, a[live] + offset) ^ _words(words, b[live] + offset)
        for k in range(1, _WORD):
            out[live] += x < (1 << (9 * (_WORD - k)))
        out[live] += x == 0
        live = live[x == 0]
        if not len(live):
            break
    return np.minimum(out, depth)


def _run_length(text: np.ndarray, i: int, depth: int) -> int:
    """Times that the suffix's first symbol is repeated at its start, up to ``depth``."""
    part = np.asarray(text[i : i + depth])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


class _Queues:
    """The queues of all first symbols in one pass: where each grows, and the least common prefix read since each grew."""

    def __init__(self, text: np.ndarray, small: np.ndarray, order: np.ndarray, prefix: np.ndarray, ends: np.ndarray, want_small: bool, depth: int):
        self.text, self.small, self.order, self.prefix, self.want_small, self.depth = text, small, order, prefix, want_small, depth
        self.at, self.sign = ends.copy(), -1 if want_small else 1
        self.least = np.full(_SYMBOLS, -1, np.int64)  # -1: nothing is queued yet, so there is no common prefix

    def read(self, parents: np.ndarray, shared: np.ndarray) -> None:
        """Queue the suffixes before ``parents`` that have the wanted type. ``shared``: common prefix of each parent with the one read before it."""
        have = np.flatnonzero(parents > 0)
        have = have[self.small[parents[have] - 1] == self.want_small]
        whole = int(shared.min())
        if not len(have):
            np.minimum(self.least, whole, out=self.least)
            return
        before = parents[have] - 1
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")
        have, before, symbols = have[order], before[order], symbols[order].astype(np.int64)
        head = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        since = np.where(head, -1, np.concatenate(([-1], have[:-1])))  # the parent of the symbol's queue entry before
        low = _range_minima(shared, since + 1, have)
        low[head] = np.minimum(low[head], self.least[symbols[head]])
        got = np.minimum(low + 1, self.depth)
        firsts = np.flatnonzero(head)
        lasts = np.append(firsts[1:], len(have)) - 1
        np.minimum(self.least, whole, out=self.least)
        tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], np.iinfo(np.int64).max)
        self.least[symbols[firsts]] = tail[have[lasts] + 1]
        for f, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            s, m = int(symbols[f]), last + 1 - f
            a = int(self.at[s])
            if self.sign > 0:
                self.order[a : a + m], self.prefix[a : a + m] = before[f : f + m], got[f : f + m]
            else:
                self.order[a - m : a], self.prefix[a - m : a] = before[f : f + m][::-1], got[f : f + m][::-1]
            self.at[s] = a + self.sign * m


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values`` from ``first`` to ``last``, both included, by minima over powers of two."""
    out = np.empty(len(first), np.int64)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[: len(table) - (1 << (k - 1))], table[1 << (k - 1) :])
        now = np.flatnonzero(level == k)
        out[now] = np.minimum(table[first[now]], table[last[now] - (1 << k) + 1])
    return out


def sort_suffixes(text: np.ndarray, depth: int = DEPTH, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` (which ends with END, its only one) in the order of their suffixes' first ``depth`` symbols, and the
    common prefix of each with the one before it, up to ``depth``."""
    store, n = store or Store(), len(text)
    small, words = _types(text, store), packed(text, store)
    stars = _sorted_stars(text, words, small, depth, store)
    counts, larges, firsts = (np.zeros(_SYMBOLS, np.int64) for _ in range(3))
    for a, b in store.blocks(n):
        counts += np.bincount(text[a:b], minlength=_SYMBOLS)
        larges += np.bincount(text[a:b][~small[a:b]], minlength=_SYMBOLS)
    for a, b in store.blocks(len(stars)):
        firsts += np.bincount(text[stars[a:b]], minlength=_SYMBOLS)
    ends = np.cumsum(counts)
    heads, star_ends = ends - counts, np.cumsum(firsts)
    order, prefix = store.empty(n, np.int64), store.empty(n, np.uint16)

    def seam(large: int, other: int) -> int:
        """Common prefix of an L-suffix and an S-suffix of one first symbol: the shorter run of that symbol."""
        return min(_run_length(text, int(order[large]), depth), _run_length(text, other, depth))

    # L-suffixes, ascending: each symbol's queue grows from its head while it is read; then come the symbol's S*.
    queues = _Queues(text, small, order, prefix, heads, False, depth)
    for c in range(_SYMBOLS):
        at = int(heads[c])
        while at < queues.at[c]:
            upto = min(int(queues.at[c]), at + store.block)
            queues.read(np.array(order[at:upto]), np.array(prefix[at:upto], np.int64))
            at = upto
        a, b = int(star_ends[c] - firsts[c]), int(star_ends[c])
        for i, j in store.blocks(b, a):
            mine = np.array(stars[i:j])
            before = np.array(stars[max(a, i - 1) : j - 1])
            shared = common_prefix(words, mine[len(mine) - len(before) :], before, depth)
            if i == a:
                shared = np.concatenate(([seam(at - 1, int(mine[0])) if at > heads[c] else 0], shared))
            queues.read(mine, shared)
    # S-suffixes, descending: each queue grows backwards from its end; after it come the symbol's L. Here prefixes are with the suffix after.
    order[0], prefix[0] = n - 1, 0
    queues = _Queues(text, small, order, prefix, ends, True, depth)
    for c in range(_SYMBOLS - 1, -1, -1):
        at, first_large = int(ends[c]), int(heads[c] + larges[c])
        while at > queues.at[c]:
            upto = max(int(queues.at[c]), at - store.block)
            queues.read(np.array(order[upto:at])[::-1], np.array(prefix[upto:at], np.int64)[::-1])
            at = upto
        for j, i in ((first_large - x, first_large - y) for x, y in store.blocks(int(larges[c]))):
            after = np.array(prefix[i + 1 : min(j + 1, first_large)], np.int64)
            if j == first_large:
                after = np.append(after, seam(first_large - 1, int(order[first_large])) if first_large < ends[c] else 0)
            queues.read(np.array(order[i:j])[::-1], after[::-1])
    for c in range(_SYMBOLS):  # prefixes of S with the suffix after become those with the one before
        a, b = int(heads[c] + larges[c]), int(ends[c])
        if b > a:
            for i, j in reversed(list(store.blocks(b, a + 1))):
                prefix[i:j] = np.array(prefix[i - 1 : j - 1])
            prefix[a] = seam(a - 1, int(order[a])) if larges[c] else 0
    return order, prefix


def repeated(text: np.ndarray, order: np.ndarray, prefix: np.ndarray, starts: np.ndarray, places: np.ndarray | None = None, depth: int = DEPTH, store: Store | None = None) -> np.ndarray:
    """Marks the positions whose next ``depth`` symbols lie in one string and also start elsewhere.

    ``places`` names where each string really starts (by default, where it starts here): positions of one place are one.
    Suffixes with a common prefix of ``depth`` are neighbours in ``order``: a group of them repeats if two neighbours differ in place.
    """
    store, n = store or Store(), len(text)
    marks = store.empty(n, bool)
    for a, b in store.blocks(n):
        marks[a:b] = False
    stops = np.append(starts[1:] - 1, n - 2) if len(starts) else np.empty(0, np.int64)

    def place(at: np.ndarray) -> np.ndarray:
        owner = np.searchsorted(starts, at, side="right") - 1
        return (places[owner] - starts[owner] if places is not None else 0) + at

    def group(a: int, b: int) -> None:
        """Marks one group, block by block."""
        differs = False
        for i, j in store.blocks(b, a):
            where = place(np.array(order[max(a, i - 1) : j]))
            differs = differs or bool((where[1:] != where[:-1]).any())
        for i, j in store.blocks(b, a) if differs else ():
            marks[np.array(order[i:j])] = True

    since = 0  # start of the group that the block before left open
    for a, b in store.blocks(n, 1):
        now = np.array(order[a:b])
        owner = np.maximum(np.searchsorted(starts, now, side="right") - 1, 0)
        equal = (np.array(prefix[a:b]) >= depth) & (now < n - 1)
        equal[equal] = stops[owner[equal]] - now[equal] >= depth
        cuts = np.flatnonzero(~equal) + a  # starts of groups
        if not len(cuts):
            continue
        if cuts[0] - since > 1:
            group(since, int(cuts[0]))
        sizes = np.diff(cuts)
        many = np.flatnonzero(sizes > 1)
        if len(many):
            at = np.array(order[a - 1 : b])
            where = place(at)
            differs = np.concatenate(([0], np.cumsum(where[1:] != where[:-1])))  # up to each of at
            first, last = cuts[many] - a + 1, cuts[many + 1] - a
            real = differs[last] > differs[first]
            inside = np.zeros(len(at) + 1, np.int64)
            np.add.at(inside, first[real], 1)
            np.add.at(inside, last[real] + 1, -1)
            marks[at[np.cumsum(inside[:-1]) > 0]] = True
        since = int(cuts[-1])
    if n - since > 1:
        group(since, n)
    return marks
