"""A run-length index of a bounded set of strings, and their matching statistics.

The Burrows-Wheeler transform of the strings (each ended by its own terminator,
ordered by place) is kept as runs: a symbol and a first row each. Of the suffix
array only the text positions at the two ends of every run are kept.

If a suffix's row isn't the first of its run, the row above has the same symbol
before it; so one text position earlier both suffixes stand in neighbouring rows
as well, and match for one more. Read the other way: from one sampled position
to the next, the neighbour moves on with the text and its match gets one shorter.
Statistics are therefore streamed over the text from the samples alone; only
where two runs meet are characters compared.
"""

from __future__ import annotations

import numpy as np

#: Symbols in a first sort key, of 9 bits each (0 is the end of a string).
_FIRST = 7
#: Longest text of an index: ranks of three parts fit one sort key.
MAX_TEXT = (1 << 21) - 2


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. ``left`` is the distance of each
    position to the end of its string; equal suffixes go by place."""
    n = len(text)
    if n > MAX_TEXT:
        raise ValueError(f"an index holds {MAX_TEXT} bytes at most")
    symbols = np.concatenate([text.astype(np.int64) + 1, np.zeros(_FIRST, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(_FIRST):
        key <<= 9
        key |= np.where(left > j, symbols[j : j + n], 0)
    depth, longest = _FIRST, int(left.max(initial=0))
    ways = 4 if (n + 1) ** 4 < 1 << 63 else 3
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        ranks = np.cumsum(new)
        if ranks[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        if depth >= longest:
            return np.argsort(rank * n + np.arange(n))
        tail = np.concatenate([rank, np.zeros((ways - 1) * depth, np.int64)])
        key = rank.copy()
        for j in range(1, ways):
            key *= n + 1
            key += np.where(left > j * depth, tail[j * depth : j * depth + n], 0)
        depth *= ways


class RunIndex:
    """The run-compressed transform of ``text``, the concatenation of strings of ``lengths``."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        self.text = text
        ends = np.cumsum(lengths)
        self.left = np.repeat(ends, lengths) - np.arange(len(text))
        order = suffix_array(text, self.left)
        symbol = text[order - 1].astype(np.int16)
        first = np.zeros(len(text), bool)
        first[(ends - lengths)[lengths > 0]] = True
        symbol[first[order]] = -1  # a terminator: it differs from all others
        head = np.ones(len(text), bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] < 0)
        self.starts = np.flatnonzero(head)
        self.symbols = symbol[self.starts]
        self.head_at = order[self.starts]
        self.tail_at = order[np.append(self.starts[1:], len(text)) - 1]

    def transform(self) -> np.ndarray:
        """The symbols of all rows, -1 for a terminator."""
        return np.repeat(self.symbols, np.diff(np.append(self.starts, len(self.text))))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``, eight bytes a step."""
        words = np.ndarray(len(self.text), "<u8", self.text.tobytes() + bytes(8), strides=(1,))
        out = np.minimum(self.left[a], self.left[b])
        open_, at = np.flatnonzero(out > 0), 0
        while len(open_):
            x = words[a[open_] + at] ^ words[b[open_] + at]
            met = x != 0
            hit = open_[met]
            with np.errstate(over="ignore"):
                lowest = x[met] & (~x[met] + np.uint64(1))
            out[hit] = np.minimum(out[hit], at + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
            at += 8
            open_ = open_[~met]
            open_ = open_[out[open_] > at]
        return out

    def statistics(self) -> np.ndarray:
        """For each position the length of the longest string that starts there
        and also starts anywhere else in the text."""
        n = len(self.text)
        met = self.common(self.tail_at[:-1], self.head_at[1:])
        here = np.arange(n)
        best = np.zeros(n, np.int64)
        for sampled, length in ((self.head_at, np.concatenate([[0], met])), (self.tail_at, np.concatenate([met, [0]]))):
            value, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            value[sampled], last[sampled] = length, sampled
            np.maximum.accumulate(last, out=last)
            np.maximum(best, value[last] - (here - last), out=best)
        return best
