"""A run-length index over a bounded set of short byte strings, in numpy.

The Burrows-Wheeler transform of the strings is kept as runs, with the suffix array sampled at the
first and last row of every run. Matching statistics stream over patterns from right to left, all
patterns in step: a symbol that continues a run follows the last-to-first mapping; otherwise the
nearest run ends of that symbol compete by their common prefix with the match so far. The rows whose
suffixes share ``window`` symbols stand together and carry one value: the least owner.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K


class RunIndex:
    def __init__(self, body: np.ndarray, sizes: np.ndarray, owner: np.ndarray, window: int):
        """body: the indexed strings, one after the other, of sizes bytes; owner: a number for each (the least document that holds it)."""
        self.window = window
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.sizes = sizes
        n = int((sizes + 1).sum())
        self.small = np.int32 if n < 1 << 30 else np.int64  # rows and positions: half the memory to move
        used = np.zeros(256, bool)
        used[body] = True
        self.rank = np.cumsum(used)  # bytes as dense symbols from 1, so that a key holds as many as can be
        width = max(1, int(self.rank[-1]).bit_length())
        self.pack, self.width = 63 // width, width
        text = np.zeros(n + self.pack, np.uint16)
        inside = np.ones(n, bool)
        inside[self.first + sizes] = False
        text[:n][inside] = self.rank.astype(np.uint16)[body]
        self.text, self.n = text, n
        self.stop = np.repeat((self.first + sizes).astype(self.small), sizes + 1)  # where the own string ends, by position
        order = self._sort()
        before = np.append(np.uint16(0), text[: n - 1])[order]  # a string follows the end of another, which is 0
        self.run_row = np.append(0, np.flatnonzero(before[1:] != before[:-1]) + 1)
        self.run_symbol = before[self.run_row]
        length = np.diff(np.append(self.run_row, n))
        self.run_last = self.run_row + length - 1
        self.head, self.tail = order[self.run_row].astype(np.int64), order[self.run_last].astype(np.int64)
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        to = np.empty(len(length), np.int64)
        to[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
        self.run_hop = (to - self.run_row).astype(self.small)  # from a row of the run to that of the symbol before it
        self.run_of = np.repeat(np.arange(len(length), dtype=self.small), length)  # select support: the run of a row
        self.by_symbol = by_symbol
        self.symbol_at = np.searchsorted(self.run_symbol[by_symbol], np.arange(259))
        self._combined = self.run_symbol[by_symbol].astype(np.int64) * len(length) + by_symbol
        self.least = np.repeat(np.asarray(owner, np.int64), sizes + 1)[order]  # by row
        again = self.near[self._same(order[self.near], order[self.near - 1])]  # rows that share window symbols with the row above
        if len(again):
            top = np.append(True, np.diff(again) > 1)
            size = np.diff(np.append(np.flatnonzero(top), len(again))) + 1
            rows = np.repeat(again[top] - 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            self.least[rows] = np.repeat(np.minimum.reduceat(self.least[rows], np.cumsum(size) - size), size)

    def _packed(self) -> np.ndarray:
        """The next ``pack`` symbols of every position in one number."""
        have, span, out, done = self.text.astype(np.uint64), 1, None, 0
        while True:  # by the binary digits of pack
            if self.pack & span:
                out = have if out is None else (have[: len(out) - span] << np.uint64(self.width * done)) | out[span:]
                done += span
            if span * 2 > self.pack:
                return out[: self.n]
            have = (have[: len(have) - span] << np.uint64(self.width * span)) | have[span:]
            span *= 2

    def _sort(self) -> np.ndarray:
        """Suffix order by doubling; a string's end is below every byte, and ends compare by position. near: the rows that may share window symbols with the row above."""
        n, pack = self.n, self.pack
        self.packed = self._packed()
        self.mask = np.array([((1 << self.width * r) - 1) << self.width * (pack - r) for r in range(pack + 1)], np.uint64)
        key = self.packed.copy()
        for left in range(pack):  # symbols before the end: what lies behind it doesn't count
            at = (self.first + self.sizes)[self.sizes >= left] - left
            key[at] &= self.mask[left]
        order = K.sort_order(key)
        key = key[order]
        order = order.astype(self.small)
        depth = pack
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (key[1:] & np.uint64((1 << self.width) - 1) == 0)
        rows = np.arange(n, dtype=self.small)
        self.near = np.flatnonzero(~new) if depth <= self.window else rows[1:]
        upper = np.maximum.accumulate(np.where(new, rows, 0))
        rank = np.empty(n, self.small)
        rank[order] = upper
        while True:  # the rows of suffixes that share depth symbols with a neighbour
            go = ~new
            go[:-1] |= go[1:]
            rows = rows[go]
            if not len(rows):
                return order
            p = order[rows]
            key = upper[go].astype(np.uint64) * np.uint64(n) + rank[p + self.small(depth)].astype(np.uint64)
            o = K.sort_order(key)
            p, key = p[o], key[o]
            order[rows] = p
            new = np.ones(len(p), bool)
            new[1:] = key[1:] != key[:-1]
            upper = np.maximum.accumulate(np.where(new, rows, 0))
            rank[p] = upper
            depth *= 2
            if depth <= self.window:
                self.near = rows[~new]

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two suffixes share their first ``window`` symbols."""
        out = (self.stop[a] - a >= self.window) & (self.stop[b] - b >= self.window)
        some = np.flatnonzero(out)
        a, b = a[some], b[some]
        keep = np.ones(len(a), bool)
        for depth in range(0, self.window, self.pack):
            mask = self.mask[min(self.pack, self.window - depth)]
            keep &= (self.packed[a + depth] & mask) == (self.packed[b + depth] & mask)
        out[some] = keep
        return out

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b inside their strings, up to most and the window."""
        most = np.minimum(np.minimum(most, self.window), np.minimum(self.stop[a] - a, self.stop[b] - b))
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for d in range(self.window):
            live = live[(most[live] > d) & (self.text[a[live] + d] == self.text[b[live] + d])]
            if not len(live):
                break
            out[live] += 1
        return out

    def statistics(self, body: np.ndarray, sizes: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns in body, of sizes bytes each, (first, length, least): for position i of pattern p, entry first[p] + i holds the length of the
        longest match that starts there (exact up to ``window``, a lower bound of at least that beyond) and, for matches
        of ``window`` symbols, the least owner of those ``window`` symbols. own: the patterns are the indexed strings, in their order."""
        if own:
            return self._own_statistics()
        first = np.cumsum(sizes) - sizes
        known = np.append(True, np.diff(self.rank) > 0)
        known[0] = self.rank[0] > 0
        symbols = np.where(known, self.rank, 257)[body]  # 257: a byte that the index doesn't have
        length_out = np.zeros(len(symbols), np.int64)
        least_out = np.full(len(symbols), np.iinfo(np.int64).max)
        by_size = np.argsort(-sizes, kind="stable")
        at = (first + sizes)[by_size]
        ordered = sizes[by_size]
        row = np.zeros(len(sizes), np.int64)
        matched = np.zeros(len(sizes), np.int64)
        here = np.full(len(sizes), self.head[0])
        run_at = self.run_of[row]
        for step in range(int(ordered[0]) if len(ordered) else 0):
            m = int(np.searchsorted(-ordered, -step, "left"))  # patterns longer than step
            c = symbols[at[:m] - 1 - step]
            run = run_at[:m]
            hop = np.flatnonzero(self.run_symbol[run] != c)
            source = row[:m].copy()
            if len(hop):
                cc, rr = c[hop], run[hop]
                lo, hi = self.symbol_at[cc], self.symbol_at[cc + 1]
                nxt = self._next_run(cc, rr)
                has_next, has_prev = nxt < hi, nxt > lo
                down = self.by_symbol[np.minimum(nxt, len(self.by_symbol) - 1)]
                up = self.by_symbol[np.maximum(nxt - 1, 0)]
                l_down = np.where(has_next, self._common(here[hop], self.head[down], matched[hop]), -1)
                l_up = np.where(has_prev, self._common(here[hop], self.tail[up], matched[hop]), -1)
                use = l_up > l_down
                run[hop] = np.where(use, up, down)
                source[hop] = np.where(use, self.run_last[up], self.run_row[down])
                here[hop] = np.where(use, self.tail[up], self.head[down])
                matched[hop] = np.maximum(np.maximum(l_up, l_down), 0)
                lost = hop[~has_next & ~has_prev]
            else:
                lost = hop
            row[:m] = source + self.run_hop[run]
            here[:m] -= 1
            matched[:m] += 1
            if len(lost):  # a symbol that the index doesn't have
                row[lost], matched[lost], here[lost] = 0, 0, self.head[0]
            run_at = self.run_of[row[:m]]
            place = at[:m] - 1 - step
            length_out[place] = matched[:m]
            long = np.flatnonzero(matched[:m] >= self.window)
            least_out[place[long]] = self.least[row[long]]
        return first, length_out, least_out

    def _own_statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """statistics of the indexed strings: each starts at the row of its own end, which is that of its number, and follows its runs without a hop,
        so that a match reaches to its end and the place of a row is known by the step."""
        sizes = self.sizes
        first, end = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        length = np.repeat(end, sizes) - np.arange(int(sizes.sum()))
        by_size = np.argsort(-sizes, kind="stable")
        at, ordered = end[by_size], sizes[by_size]
        row = by_size.astype(self.small)
        rows = np.zeros(len(length), self.small)
        for step in range(1, int(ordered[0]) + 1 if len(ordered) else 1):
            m = int(np.searchsorted(-ordered, -step, "right"))  # strings of step symbols or more
            row = row[:m]
            row = row + self.run_hop[self.run_of[row]]
            if step >= self.window:
                rows[at[:m] - step] = row
        return first, length, np.where(length >= self.window, self.least[rows], np.iinfo(np.int64).max)

    def _next_run(self, symbol: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Place in by_symbol of the first run of symbol after run."""
        return np.searchsorted(self._combined, symbol * len(self.run_row) + run, "right")
