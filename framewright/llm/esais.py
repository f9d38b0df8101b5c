"""Suffix order and common prefixes by external induced sorting.

Suffixes are of L or S type; those of S type after one of L type (S*) are sorted first: their substrings are sorted and
named, and the string of names is sorted by the same procedure, or in memory once it is short.  From their order the
order of all other suffixes is induced, L types from left to right and S types from right to left.  What is still to come
waits in a monotone priority queue that keeps a run for each symbol and spills runs to disk; each entry carries its
position and the length of the prefix it shares with the entry before it.  An induced entry's common prefix is one more
than the least common prefix between the two entries that induced it and its neighbour, so no suffix is ever compared.

Entries are handled in batches: all that stand in line for one symbol are popped, emitted and turned into pushes with a
few numpy operations.  Common prefixes are cut off at ``cap``; suffixes that agree that far may stand in either order.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Callable

import numpy as np

BIG = np.int32(2**30)
#: Names are sorted in memory up to this many; a longer string of names is induced again.
BASE = 1 << 24
BATCH = 1 << 17


class RunQueue:
    """Monotone priority queue of (symbol, position, common prefix): a first-in first-out run for each symbol.

    Runs live in memory until together they exceed ``budget`` bytes; then all go to their files in ``folder``.
    """

    def __init__(self, folder: str, budget: int, largest_first: bool):
        self.folder, self.budget, self.sign = folder, budget, -1 if largest_first else 1
        self.memory: dict[int, list[np.ndarray]] = {}
        self.disk: dict[int, tuple[str, int, int]] = {}  # file, bytes taken, bytes there
        self.heap: list[int] = []
        self.size = 0

    def push(self, keys: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Append entries that are sorted by key."""
        if not len(keys):
            return
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(cut[1:], len(keys))
        both = np.empty((len(keys), 2), np.int64)
        both[:, 0], both[:, 1] = pos, lcp
        for lo, hi in zip(cut.tolist(), ends.tolist(), strict=True):
            k = int(keys[lo])
            if k not in self.memory and k not in self.disk:
                heapq.heappush(self.heap, self.sign * k)
            self.memory.setdefault(k, []).append(both[lo:hi])
        self.size += both.nbytes
        if self.size > self.budget:
            self._spill()

    def _spill(self) -> None:
        for k, parts in self.memory.items():
            name, taken, there = self.disk.get(k) or (os.path.join(self.folder, f"run{id(self)}-{k}"), 0, 0)
            with open(name, "ab") as f:
                for p in parts:
                    f.write(np.ascontiguousarray(p).tobytes())
                    there += p.nbytes
            self.disk[k] = (name, taken, there)
        self.memory, self.size = {}, 0

    def peek(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next batch of the run of ``key``, or None when nothing more stands in line for it."""
        if key in self.disk:
            name, taken, there = self.disk[key]
            want = min(there - taken, BATCH * 16)
            with open(name, "rb") as f:
                f.seek(taken)
                both = np.frombuffer(f.read(want), np.int64).reshape(-1, 2)
            if taken + want == there:
                os.unlink(name)
                del self.disk[key]
            else:
                self.disk[key] = (name, taken + want, there)
        elif key in self.memory:
            parts, n = self.memory[key], 0
            take = []
            while parts and n < BATCH:
                take.append(parts.pop(0))
                n += len(take[-1])
            if not parts:
                del self.memory[key]
            both = take[0] if len(take) == 1 else np.concatenate(take)
            self.size -= both.nbytes
        else:
            if self.heap and self.sign * self.heap[0] == key:
                heapq.heappop(self.heap)
            return None
        return both[:, 0], both[:, 1]


class _Between:
    """Least common prefix between successive pushes to the same symbol, over the batches of one source symbol."""

    def __init__(self) -> None:
        self.open: dict[int, int] = {}  # symbol -> least value since its last push, for the present source symbol

    def start(self) -> None:
        self.open.clear()

    def __call__(self, lcp: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``lcp`` of all entries of the batch, the entries ``at`` push ``keys``: order of pushes by key, and their values."""
        order = np.argsort(keys, kind="stable")
        i, k = at[order], keys[order]
        first = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        value = np.zeros(len(k), np.int64)
        if len(k):
            j = np.append(0, i[:-1])
            n = np.where(first, 1, i - j)
            level = np.frexp(n.astype(np.float64))[1] - 1
            lo = np.where(first, i, j + 1)
            tab, width = lcp, 1
            for v in range(int(level.max()) + 1):
                here = np.flatnonzero(level == v)
                value[here] = np.minimum(tab[lo[here]], tab[i[here] - width + 1])
                if v < level.max():
                    tab = np.minimum(tab[:-width], tab[width:])
                    width *= 2
            head = np.flatnonzero(first)
            before = np.minimum.accumulate(lcp)
            value[head] = [min(int(before[x]), self.open[s]) if s in self.open else 0 for x, s in zip(i[head].tolist(), k[head].tolist(), strict=True)]
        whole = int(lcp.min()) if len(lcp) else int(BIG)
        for s, v in self.open.items():
            if v > whole:
                self.open[s] = whole
        if len(k):
            last = np.append(head[1:] - 1, len(k) - 1)
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], BIG)
            for s, x in zip(k[last].tolist(), i[last].tolist(), strict=True):
                self.open[s] = int(after[x + 1])
        return order, value


class Suffixes:
    """Order of the suffixes of ``text`` (integers >= 0), reported to a sink in runs.

    sink(positions, common) gets runs of entries in ascending or descending order; common[i] belongs to entries i - 1 and
    i, and common[0] to the entry before the run in the same direction (0 where a new symbol begins).
    """

    def __init__(self, text: np.ndarray, cap: int, folder: str, budget: int = 64 << 20, base: int = BASE):
        self.text, self.cap, self.folder, self.budget, self.base = text, cap, folder, budget, base
        self.n = len(text)

    def run_length(self, p: int) -> int:
        """How often the symbol at p stands there in a row."""
        at, c = p, self.text[p]
        while at < self.n:
            other = np.flatnonzero(self.text[at : at + 4096] != c)
            if len(other):
                return at + int(other[0]) - p
            at += 4096
        return self.n - p

    def s_types(self, block: int = 1 << 20) -> np.ndarray:
        """True where a suffix is less than the next one; the last suffix is of L type (nothing is less than all).

        From the right, a block at a time: a byte a symbol is all that stays in memory.
        """
        out = np.zeros(self.n, bool)
        carry = False  # the type of the symbol after the block
        for hi in range(self.n - 1, 0, -block):
            lo = max(0, hi - block)
            t = np.asarray(self.text[lo : hi + 1])
            up, same = t[:-1] < t[1:], t[:-1] == t[1:]
            # a symbol takes the type of the end of its run of equal ones
            k = np.where(same, hi - lo, np.arange(hi - lo))
            k = np.minimum.accumulate(k[::-1])[::-1]
            out[lo:hi] = np.append(up, carry)[k]
            carry = bool(out[lo])
        return out

    # -- S* suffixes ----------------------------------------------------------------------------------------------
    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """S* positions in order, and what each shares with the one before."""
        t, kinds = self.text, self.s_types()
        star = np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1
        m = len(star)
        if m == 0:
            return star, np.zeros(0, np.int64)
        length = np.append(star[1:] + 1, self.n) - star
        wide = int(t.max()) >= 512
        per, bits = (1, 0) if wide else (6, 10)

        def key(items: np.ndarray, r: int) -> np.ndarray:
            out = np.zeros(len(items), np.int64)
            for x in range(per):
                off = r * per + x
                ok = off < length[items]
                p = star[items] + np.where(ok, off, 0)
                out = (out << bits) | np.where(ok, 2 * t[p].astype(np.int64) + kinds[p] + 1, 0)
            return out

        def ranked(group: np.ndarray | None, k: np.ndarray, items: np.ndarray, name: np.ndarray) -> None:
            """Give the items, which are whole groups of ``name``, the index of their first in sorted order."""
            order = np.argsort(k, kind="stable") if group is None else np.lexsort((k, group))
            ks, g = k[order], group[order] if group is not None else np.zeros(len(k), np.int64)
            new_g = np.append(True, g[1:] != g[:-1])
            new = new_g | np.append(True, ks[1:] != ks[:-1])
            at = np.arange(len(k))
            start_g = np.maximum.accumulate(np.where(new_g, at, 0))
            start = np.maximum.accumulate(np.where(new, at, 0))
            name[items[order]] = g + start - start_g

        name = np.zeros(m, np.int64)
        everything = np.arange(m)
        ranked(None, key(everything, 0), everything, name)
        r = 1
        while True:
            many = np.bincount(name, minlength=m)[name] > 1
            items = np.flatnonzero(many & (length > r * per))
            if not len(items):
                break
            ranked(name[items], key(items, r), items, name)
            r += 1
        units = self.cap // 2 + 2  # two S* positions are at least two apart
        if m > self.base:
            order, same = _names_recursive(name, units, self.folder, self.budget, self.base)
        else:
            order, same = _names_in_memory(name, units)
        pos = star[order]
        common = np.zeros(m, np.int64)
        if m > 1:
            a, b = order[:-1] + same[1:], order[1:] + same[1:]
            done = (a >= m) | (b >= m)
            pa, pb = star[np.minimum(a, m - 1)], star[np.minimum(b, m - 1)]
            skip = pa - pos[:-1]
            # where all names of one are used up, what is left is less than a substring
            tail = np.flatnonzero(done)
            pa[tail], pb[tail], skip[tail] = pos[:-1][tail], pos[1:][tail], 0
            common[1:] = np.minimum(self.cap, skip + self._compare(pa, pb, self.cap))
        return pos, common

    def _compare(self, a: np.ndarray, b: np.ndarray, cap: int, block: int = 1 << 15) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        step = np.arange(8)
        for lo in range(0, len(a), block):  # the places of a block's symbols take many times its bytes
            live, off = np.arange(lo, min(lo + block, len(a))), 0
            while len(live) and off < cap:
                x, y = a[live, None] + off + step, b[live, None] + off + step
                ok = (x < self.n) & (y < self.n)
                eq = ok & (self.text[np.minimum(x, self.n - 1)] == self.text[np.minimum(y, self.n - 1)])
                same = np.where(eq.all(axis=1), 8, eq.argmin(axis=1))
                out[live] += same
                live = live[same == 8]
                off += 8
        return np.minimum(out, cap)

    # -- induction --------------------------------------------------------------------------------------------------
    def induce(self, sink: Callable[[np.ndarray, np.ndarray], None]) -> None:
        t, n = self.text, self.n
        if n == 0:
            return
        pos, common = self.stars()
        # runs of S* suffixes by first symbol
        first = t[pos] if len(pos) else np.zeros(0, t.dtype)
        cut = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(pos) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(pos))[: len(cut)]
        star_run = {int(first[lo]): (int(lo), int(hi)) for lo, hi in zip(cut, ends, strict=True)}
        waiting = sorted(star_run, reverse=True)
        queue, between = RunQueue(self.folder, self.budget, False), _Between()
        queue.push(np.array([t[n - 1]]), np.array([n - 1]), np.array([0]))
        kept: list[tuple[int, str, int]] = []  # L runs by symbol, on disk for the pass back

        def advance(p: np.ndarray, c: np.ndarray, ok: Callable[[np.ndarray], np.ndarray], q: RunQueue) -> None:
            prior = t[np.maximum(p - 1, 0)].astype(np.int64)
            at = np.flatnonzero((p > 0) & ok(prior))
            order, value = between(c, at, prior[at])
            q.push(prior[at][order], p[at][order] - 1, np.minimum(self.cap, value + 1) * self._seen(q, prior[at][order]))

        self.had: dict[int, set[int]] = {id(queue): {int(t[n - 1])}}
        while queue.peek() is not None or waiting:
            head = queue.peek()
            c = head if not waiting or (head is not None and head <= waiting[-1]) else waiting[-1]
            between.start()
            last, name, count = None, os.path.join(self.folder, f"l{id(self)}-{c}"), 0
            while (got := queue.pop(c)) is not None:
                p, l = got
                sink(p, l)
                with open(name, "ab") as f:
                    f.write(np.column_stack(got).astype(np.int64).tobytes())
                count += len(p)
                last = int(p[-1])
                advance(p, l, lambda x, c=c: x >= c, queue)
            if count:
                kept.append((c, name, count))
            if waiting and waiting[-1] == c:
                waiting.pop()
                lo, hi = star_run[c]
                for at in range(lo, hi, BATCH):
                    p, l = pos[at : min(hi, at + BATCH)], common[at : min(hi, at + BATCH)].copy()
                    if at == lo:
                        l[0] = min(self.cap, self.run_length(last), self.run_length(int(p[0]))) if last is not None else 0
                    advance(p, l, lambda x, c=c: x > c, queue)
        # back from the right: S types, each symbol's S run before its L run
        queue, between = RunQueue(self.folder, self.budget, True), _Between()
        self.had = {id(queue): set()}
        while queue.peek() is not None or kept:
            head = queue.peek()
            c = head if not kept or (head is not None and head >= kept[-1][0]) else kept[-1][0]
            between.start()
            last = None
            while (got := queue.pop(c)) is not None:
                p, l = got
                sink(p, l)
                last = int(p[-1])
                advance(p, l, lambda x, c=c: x <= c, queue)
            if kept and kept[-1][0] == c:
                _, name, count = kept.pop()
                run = np.memmap(name, np.int64, "r", shape=(count, 2))
                carry = None
                for hi in range(count, 0, -BATCH):
                    part = np.array(run[max(0, hi - BATCH) : hi])[::-1]
                    p = part[:, 0]
                    if carry is None:
                        top = 0 if last is None else min(self.cap, self.run_length(last), self.run_length(int(p[0])))
                        if last is not None:
                            sink(np.array([last, int(p[0])]), np.array([0, top]))
                        carry = top
                    l = np.append(carry, part[:-1, 1])
                    carry = int(part[-1, 1])
                    advance(p, l, lambda x, c=c: x < c, queue)
                del run
                os.unlink(name)

    def _seen(self, q: RunQueue, keys: np.ndarray) -> np.ndarray:
        """0 for the first entry that a symbol ever gets (nothing stands before it), else 1."""
        had = self.had[id(q)]
        out = np.ones(len(keys), np.int64)
        if len(keys):
            for i in np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist():
                if int(keys[i]) not in had:
                    had.add(int(keys[i]))
                    out[i] = 0
        return out


def _names_in_memory(name: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of names by their first ``units`` names, and how many neighbours share."""
    m = len(name)
    levels = [np.append(name, -1).astype(np.int32)]
    width = 1
    while width < units and np.unique(levels[-1][:m]).size < m:
        r = levels[-1].astype(np.int64)
        nxt = r[np.minimum(np.arange(m) + width, m)]
        key = (r[:m] << 32) | (nxt + 1)
        order = np.argsort(key, kind="stable")
        ks = key[order]
        new = np.append(True, ks[1:] != ks[:-1])
        rank = np.empty(m + 1, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        rank[m] = -1
        levels.append(rank)
        width *= 2
    order = np.argsort(levels[-1][:m], kind="stable")
    same = np.zeros(m, np.int64)
    a, b = order[:-1], order[1:]
    off = np.zeros(max(0, m - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + off, m), np.minimum(b + off, m)
        eq = (levels[k][x] == levels[k][y]) & (x < m) & (y < m)
        off += np.where(eq, 1 << k, 0)
    same[1:] = np.minimum(off, np.minimum(m - a, m - b))
    return order, same


def _names_recursive(name: np.ndarray, units: int, folder: str, budget: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by induction over the string of names."""
    dense = np.unique(name, return_inverse=True)[1].astype(np.int64)
    order, same = sort_all(dense, units, folder, budget, base)
    return order, same


def sort_all(text: np.ndarray, cap: int, folder: str, budget: int = 64 << 20, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and what each shares with the one before (cut off at ``cap``)."""
    n = len(text)
    down: list[tuple[np.ndarray, np.ndarray]] = []
    up: list[tuple[np.ndarray, np.ndarray]] = []
    seam: dict[int, int] = {}
    s = Suffixes(text, cap, folder, budget, base)
    kinds = s.s_types() if n else np.zeros(0, bool)

    def sink(p: np.ndarray, l: np.ndarray) -> None:
        if len(p) == 2 and kinds[p[0]] and not kinds[p[1]]:
            seam[int(p[0])] = int(l[1])
        elif kinds[p[0]]:
            down.append((p.copy(), l.copy()))
        else:
            up.append((p.copy(), l.copy()))

    s.induce(sink)
    none = (np.zeros(0, np.int64),) * 2
    lp, ll = (np.concatenate(x) for x in zip(*up, strict=True)) if up else none
    sp, sl = (np.concatenate(x) for x in zip(*down, strict=True)) if down else none
    # descending S runs turned round: what an entry shares with the next becomes what the next shares with it
    sp, sl = sp[::-1], np.append(0, sl[::-1][:-1]) if len(sl) else sl
    # merge symbol by symbol: L entries, then S entries
    sym = np.concatenate([text[lp], text[sp]]) if n else np.zeros(0, np.int64)
    kind = np.concatenate([np.zeros(len(lp)), np.ones(len(sp))])
    order = np.lexsort((np.arange(len(sym)), kind, sym))
    pos = np.concatenate([lp, sp])[order]
    common = np.concatenate([ll, sl])[order]
    for i in range(1, len(pos)):
        if text[pos[i]] != text[pos[i - 1]]:
            common[i] = 0
        elif int(pos[i]) in seam and not kinds[pos[i - 1]]:
            common[i] = seam[int(pos[i])]
    if len(common):
        common[0] = 0
    return pos, common
