"""A run-length Burrows-Wheeler index over short byte strings, built and walked in numpy."""

from __future__ import annotations

import numpy as np

from .arrays import ranges


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


class RunLengthIndex:
    """Index of ``strings`` (non-empty), laid end to end with separators in the order given.

    The transform is kept as its runs: where each starts, its symbol, and how often that symbol
    occurs before it; text positions are sampled at run ends. Suffixes are ordered by their first
    ``depth`` symbols; for each group that agrees on them its first text position is kept.
    """

    def __init__(self, strings: list[bytes], depth: int):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths
        n = int(self.ends[-1]) + 1
        if n >= 1 << 31:
            raise ValueError("an index takes less than 2 GB")
        self.text = text = np.zeros(n, np.int16)
        text[ranges(self.starts, lengths)] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1

        def shifted(r, by):
            out = np.zeros(n, np.int64)
            out[: max(n - by, 0)] = r[by:] + np.int64(1)
            return out

        # Suffixes are ordered by their first `depth` symbols, found by doubling, then by place.
        # A step from symbol to symbol keeps within suffixes that agree so far, which is enough:
        # the groups asked for are those that agree on `depth` symbols.
        span = min(depth, 7)  # symbols of nine bits that fit a key at once
        packed = text.astype(np.int64)
        for k in range(1, span):
            packed <<= 9
            packed |= shifted(text, k)
        group = _ranks(packed)
        while span < depth:
            by = min(span, depth - span)
            packed = group.astype(np.int64)
            packed *= n + 2
            packed += shifted(group, by)
            group = _ranks(packed)
            span += by
        del packed
        self.order = np.argsort(group, kind="stable").astype(np.int32)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        self.end_place = place[self.ends]  # where the walk of each string begins
        del place
        symbols = text[self.order - 1]  # the symbol before each suffix, in suffix order
        self.run_start = np.flatnonzero(np.diff(symbols, prepend=-1)).astype(np.int32)
        self.run_symbol = symbols[self.run_start]
        run_length = np.diff(np.append(self.run_start, np.int32(n)))
        self.run_end_position = self.order[self.run_start + run_length - 1]
        totals = np.bincount(symbols, minlength=258)
        self.below = np.cumsum(totals) - totals
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        before = np.cumsum(run_length[by_symbol]) - run_length[by_symbol]
        first = np.searchsorted(self.run_symbol[by_symbol], np.arange(258))
        base = np.append(before, n)[np.minimum(first, len(before))]
        self.sorted_symbol = self.run_symbol[by_symbol]
        self.sorted_start = self.run_start[by_symbol]
        self.sorted_length = run_length[by_symbol]
        self.sorted_before = before - base[self.sorted_symbol]
        self.sorted_key = self.sorted_symbol.astype(np.int64) * (n + 1) + self.sorted_start
        groups = group[self.order]
        edge = np.flatnonzero(np.diff(groups, prepend=-1))
        self.group_start = edge.astype(np.int32)
        self.group_size = np.diff(np.append(edge, n)).astype(np.int32)
        self.group_first = np.minimum.reduceat(self.order, edge)
        self.group_at = np.repeat(np.arange(len(edge), dtype=np.int32), self.group_size)

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where suffixes begin that put ``symbol`` before those from ``place`` on."""
        n = len(self.text)
        i = np.searchsorted(self.sorted_key, symbol.astype(np.int64) * (n + 1) + place, "left") - 1
        i = np.maximum(i, 0)
        found = (self.sorted_symbol[i] == symbol) & (self.sorted_start[i] < place)
        rank = self.sorted_before[i] + np.minimum(self.sorted_length[i], place - self.sorted_start[i])
        return self.below[symbol] + np.where(found, rank, 0)

    def earlier(self, wanted: list[int] | np.ndarray) -> list[np.ndarray]:
        """Streams every string backwards through the index, whose matching statistics, cut at
        ``depth``, are the group that a position falls into. For string k: a flag for each of its
        first ``wanted[k]`` starts, true where ``depth`` symbols also start earlier in the text."""
        wanted = np.asarray(wanted, np.int64)
        out = [np.zeros(w, bool) for w in wanted]
        order = np.argsort(-(self.ends - self.starts), kind="stable")
        length = (self.ends - self.starts)[order]
        group = self.group_at[self.end_place[order]]
        flat_at = np.concatenate([[0], np.cumsum(wanted)])
        flat = np.zeros(int(flat_at[-1]), bool)
        at = length.copy()
        for _ in range(int(length[0]) if len(length) else 0):
            live = at > 0  # strings stand in order of length, so the live ones only thin out
            if not live.all():
                order, at, group = order[live], at[live], group[live]
            at = at - 1
            # extend to the left, then back to all suffixes that agree on `depth` symbols
            place = self.step(self.text[self.starts[order] + at], self.group_start[group])
            group = self.group_at[place]
            ask = np.flatnonzero(at < wanted[order])
            if len(ask):
                k, g = order[ask], group[ask]
                flat[flat_at[k] + at[ask]] = (self.group_size[g] > 1) & (self.group_first[g] < self.starts[k] + at[ask])
        for k in range(len(out)):
            out[k] = flat[flat_at[k] : flat_at[k + 1]]
        return out
