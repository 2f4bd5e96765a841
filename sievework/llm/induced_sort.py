"""Suffix order and common prefixes of a byte string by induced sorting, to a limited depth.

The leftmost suffixes of ascending runs are sorted first. From them all descending suffixes are induced in one
sweep over the characters upwards, then all ascending ones in a sweep downwards: a suffix that is taken out puts
the suffix one place before it into the queue of that one's first character. With a suffix goes the prefix it
shares with the one queued before it: one more than the least shared prefix taken out in between. Queues move
to disk when more than ``held`` entries wait in memory, so the string and its order are all that must fit.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np


class DiskQueue:
    """Runs of (suffix, common prefix) in order of arrival, beyond a size in an unnamed file of the task."""

    def __init__(self, held: int):
        self.held, self.waiting, self.size = held, [], 0
        self.file, self.spilled = None, []

    def put(self, suffix: np.ndarray, common: np.ndarray) -> None:
        self.waiting.append((suffix, common))
        self.size += len(suffix)
        if self.size > self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for s, c in self.waiting:
                self.file.seek(0, 2)
                self.spilled.append((self.file.tell(), len(s)))
                self.file.write(s.astype("<i8").tobytes() + c.astype("<i2").tobytes())
            self.waiting, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All that waits, in order."""
        runs = []
        for at, n in self.spilled:
            self.file.seek(at)
            data = self.file.read(n * 10)
            runs.append((np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i2", n, n * 8)))
        runs += self.waiting
        self.waiting, self.size, self.spilled = [], 0, []
        if self.file is not None:
            self.file.truncate(0)
        if not runs:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, ``depth`` at most."""
    n = len(text)
    out = np.zeros(len(a), np.int16)
    live = np.arange(len(a))
    for k in range(depth):
        x, y = a[live] + k, b[live] + k
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the one behind it; the last one is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = -1
    settled = np.flatnonzero(step)
    return step[settled[np.searchsorted(settled, np.arange(n))]] > 0


def _sorted_seeds(text: np.ndarray, seeds: np.ndarray, depth: int, run: int) -> np.ndarray:
    """Seeds in order of ``depth`` characters: sorted runs, merged by a heap if there are several."""
    padded = np.r_[text, np.zeros(depth, text.dtype)].astype(">u2")

    def keys(at):
        rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[at]
        return np.ascontiguousarray(rows).view(f"S{2 * depth}").ravel()

    runs = []
    for lo in range(0, len(seeds), run):
        part = seeds[lo : lo + run]
        runs.append(part[np.argsort(keys(part), kind="stable")])
    if len(runs) == 1:
        return runs[0]

    def stream(part):
        for lo in range(0, len(part), 4096):
            yield from zip(keys(part[lo : lo + 4096]).tolist(), part[lo : lo + 4096].tolist())

    merged = heapq.merge(*(stream(r) for r in runs))
    return np.fromiter((p for _, p in merged), np.int64, len(seeds))


def _sweep(text, seeds, seed_common, ascending, depth, held, rising, below=None):
    """One induction. Returns for each character its induced suffixes and their common prefixes, in order.

    ``rising``: characters upwards, seeds behind what is induced, descending suffixes come out. Else downwards
    over ``below`` (the descending suffixes by character), and ascending suffixes come out, greatest first.
    """
    chars = int(text.max()) + 1
    queues = [DiskQueue(held) for _ in range(chars)]
    since = np.full(chars, depth, np.int16)
    pushed = np.zeros(chars, bool)
    out = [None] * chars
    wanted = ~ascending if rising else ascending
    edges = np.searchsorted(text[seeds], np.arange(chars + 1)) if rising else None

    def visit(suffix, common):
        """Takes suffixes out in order: ``common`` is with the one taken out before."""
        if not len(suffix):
            return
        before = suffix - 1
        use = np.flatnonzero((before >= 0) & wanted[before])
        first = text[before[use]]
        order = np.argsort(first, kind="stable")
        use, first = use[order], first[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        ends = np.r_[cuts[1:], len(first)] if len(first) else []
        least_of_all = int(common.min())
        hit = {}
        for a, b in zip(cuts, ends):
            c, at = int(first[a]), use[a:b]
            # Least common prefix from behind the last one queued here up to each.
            lows = np.minimum.reduceat(common[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            lows[0] = min(lows[0], since[c])
            got = np.minimum(lows + 1, depth).astype(np.int16)
            if not pushed[c]:
                got[0], pushed[c] = 0, True
            queues[c].put(before[at], got)
            hit[c] = common[at[-1] + 1 :].min() if at[-1] + 1 < len(common) else depth
        np.minimum(since, least_of_all, out=since)
        for c, low in hit.items():
            since[c] = low

    if rising:
        # The end of the string stands before everything: its last character is induced first.
        last = len(text) - 1
        queues[int(text[last])].put(np.array([last]), np.zeros(1, np.int16))
        pushed[int(text[last])] = True
        since[int(text[last])] = 0
    for c in range(chars) if rising else range(chars - 1, -1, -1):
        suffixes, commons = [], []
        while True:
            s, m = queues[c].take()
            if not len(s):
                break
            suffixes.append(s)
            commons.append(m)
            visit(s, m)
        s = np.concatenate(suffixes) if suffixes else np.zeros(0, np.int64)
        m = np.concatenate(commons) if commons else np.zeros(0, np.int16)
        out[c] = (s, m)
        if rising:
            own, share = seeds[edges[c] : edges[c + 1]], seed_common[edges[c] : edges[c + 1]].copy()
            if len(own):
                share[0] = common_prefix(text, s[-1:], own[:1], depth)[0] if len(s) else 0
                visit(own, share)
        else:
            own, share = below[c]
            if len(own):
                down = own[::-1]
                to_next = np.r_[share[1:], 0][::-1].astype(np.int16)
                to_next[0] = common_prefix(text, s[-1:], down[:1], depth)[0] if len(s) else 0
                visit(down, to_next)
    return out


def suffix_order(
    text: np.ndarray, depth: int, held: int = 1 << 20, run: int = 1 << 18
) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of ``text`` (small non-negative numbers), in order of at least ``depth`` characters, and
    the common prefix of each with the one before it, ``depth`` at most.

    An empty string has none. Suffixes that agree on ``depth`` characters stand together in no stated order.
    """
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    text = text.astype(np.uint16) + np.uint16(1)  # 0 is what stands behind the end
    up = _ascending(text)
    seeds = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    # Ascending suffixes that begin the string have no descending one before them, yet induce nothing either.
    if len(seeds):
        seeds = _sorted_seeds(text, seeds, depth, run)
    share = np.zeros(len(seeds), np.int16)
    if len(seeds) > 1:
        share[1:] = common_prefix(text, seeds[:-1], seeds[1:], depth)
    falling = _sweep(text, seeds, share, up, depth, held, True)
    rising = _sweep(text, seeds, share, up, depth, held, False, falling)
    suffixes, commons = [], []
    for c, ((fall, f), (rise, r)) in enumerate(zip(falling, rising)):
        suffixes += [fall, rise[::-1]]
        back = np.r_[r[1:], 0][::-1].astype(np.int16)[: len(rise)]
        if len(rise):
            back[0] = common_prefix(text, fall[-1:], rise[-1:], depth)[0] if len(fall) else 0
        commons += [f, back]
    return np.concatenate(suffixes), np.concatenate(commons)
