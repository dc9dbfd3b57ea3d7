"""A run-length index of short texts: run-compressed Burrows-Wheeler transform with sampled run ends.

Patterns are streamed backwards through the index, all at once: each keeps a row, the length of its match and the text
position of that row.  Where the row's run has the pattern's next symbol the match grows by one; else the row jumps to the
nearest end of a run of that symbol, whose text position is sampled, and the match is cut to what both positions share.

For matches of ``length`` or more the index tells the least owner among all texts that hold those ``length`` symbols.
"""

from __future__ import annotations

import numpy as np


def words_at(joined: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of an array of bytes as one number, zeros behind the end."""
    n = len(joined)
    padded = np.concatenate([joined, np.zeros(16, np.uint8)])
    word = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        word[k::8] = padded[k : k + 8 * len(range(k, n, 8))].view(np.uint64)
    return word


class RunLengthIndex:
    """``jumps`` counts how often a pattern's match broke off and went on at a sampled run end."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        symbols = joined.astype(np.int16) + 1
        symbols[ends] = 0
        n = len(symbols)
        self.length, self.jumps = length, 0
        self.word = words_at(joined)
        self.rest = (np.repeat(ends, sizes + 1) - np.arange(n)).astype(np.int32)  # symbols up to the text's end
        rows, half, offset = self._sorted(symbols, int(sizes.max(initial=0)) + 1, length)
        # Rows whose first ``length`` symbols agree form a class; a class has a least owner.
        tail = np.append(half, np.full(offset, -1, half.dtype))
        a, b = half[rows], tail[rows + offset]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.class_of = np.cumsum(new, dtype=np.int32) - 1
        owner = np.repeat(owners, sizes + 1)
        self.class_owner = np.minimum.reduceat(owner[rows], np.flatnonzero(new))
        # The transform, kept as runs: rows with one symbol before them, whose steps back lead to rows in sequence.
        back = np.empty(n, np.int32)
        back[rows] = np.arange(n, dtype=np.int32)
        last, image = symbols[rows - 1], back[rows - 1]
        new = np.concatenate([[True], (last[1:] != last[:-1]) | (image[1:] != image[:-1] + 1)])
        self.run_of = np.cumsum(new, dtype=np.int32) - 1
        self.start = np.flatnonzero(new).astype(np.int32)
        self.head, self.to = last[self.start], image[self.start]
        self.stop = np.append(self.start[1:], np.int32(n))
        self.first_at, self.last_at = rows[self.start].astype(np.int32), rows[self.stop - 1].astype(np.int32)
        self.by_symbol = np.argsort(self.head, kind="stable").astype(np.int32)
        self.symbol_key = self.head[self.by_symbol].astype(np.int64) * (len(self.start) + 1) + self.by_symbol

    @staticmethod
    def _sorted(symbols: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Suffixes in order of their first ``depth`` symbols; ranks by the first h <= length symbols, and length - h.

        Ties stay in text order, as the step from a row to the one before it needs."""
        n = len(symbols)
        bits = max(1, int(n).bit_length())
        # Symbols are renumbered, so that the first key holds as many as 64 bits allow.
        number = np.cumsum(np.bincount(symbols, minlength=1) > 0) - 1
        each = max(1, int(number[-1]).bit_length())
        width = max(1, min(length, (64 - bits) // each))
        padded = np.append(number[symbols], np.zeros(width, np.int64)).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(width):
            key = (key << np.uint64(each)) | padded[i : i + n]
        half, offset, key_bits = None, 0, each * width
        everything = np.arange(n, dtype=np.uint64)
        while True:
            if key_bits + bits <= 64:
                packed = np.sort((key << np.uint64(bits)) | everything)
                rows, ordered = (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)
            else:
                rows = np.argsort(key, kind="stable")
                ordered = key[rows]
            rank = np.empty(n, np.int64)
            rank[rows] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
            if width <= length:
                half, offset = rank, length - width
            if width >= depth and width >= length:
                return rows, half, offset
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - width, 0)] = rank[width:] + 1
            key, key_bits = (rank.astype(np.uint64) << np.uint64(bits)) | ahead.astype(np.uint64), 2 * bits
            width *= 2

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols two positions share, up to ``most`` for each: eight at a time."""
        most = np.minimum(most, np.minimum(self.rest[a], self.rest[b]))
        out = np.zeros(len(a), np.int32)
        alive, k = np.flatnonzero(most > 0), 0
        while len(alive):
            x = self.word[a[alive] + k] ^ self.word[b[alive] + k]
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # bytes below the first that differs
            out[alive] += same
            k += 8
            alive = alive[(same == 8) & (most[alive] > k)]
        return np.minimum(out, most)

    def stream(self, patterns: list[bytes], every: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: for each pattern and place the length of the match that starts there, and the least owner of
        its first ``length`` symbols (-1 where the match is shorter).  One row a pattern, aligned left.

        Unless ``every`` length is asked for, a pattern is let go where what is left of it can't make a match of ``length``
        any more; its lengths before that place stay 0."""
        m = len(patterns)
        sizes = np.array([len(p) for p in patterns], np.int64)
        widest = int(sizes.max(initial=0))
        flat = np.frombuffer(b"".join(patterns), np.uint8)
        begins = np.cumsum(sizes) - sizes
        lengths = np.zeros((m, widest), np.int32)
        owner = np.full((m, widest), -1, np.int64)
        row, size = np.zeros(m, np.int32), np.zeros(m, np.int32)
        at = np.full(m, self.first_at[0])
        r = len(self.start)
        live = np.arange(m)
        for k in range(widest):
            live = live[(sizes[live] > k) if every else (sizes[live] - k + size[live] >= self.length) & (sizes[live] > k)]
            if not len(live):
                break
            place = sizes[live] - 1 - k
            symbol = flat[begins[live] + place].astype(np.int64) + 1
            q = row[live]
            run = self.run_of[q]
            goes = self.head[run] == symbol
            if not goes.all():
                miss = np.flatnonzero(~goes)
                self.jumps += len(miss)
                key = symbol[miss] * (r + 1) + run[miss]
                j = np.searchsorted(self.symbol_key, key)
                has_up = (j > 0) & (self.symbol_key[np.maximum(j - 1, 0)] // (r + 1) == symbol[miss])
                has_down = (j < r) & (self.symbol_key[np.minimum(j, r - 1)] // (r + 1) == symbol[miss])
                up, down = self.by_symbol[np.maximum(j - 1, 0)], self.by_symbol[np.minimum(j, r - 1)]
                now, most = at[live[miss]], size[live[miss]]
                share_up = np.where(has_up, self._shared(now, self.last_at[up], most), -1)
                share_down = np.where(has_down, 0, -1)
                ask = np.flatnonzero(has_down & (share_up < most))  # elsewhere the end above is as good as any
                share_down[ask] = self._shared(now[ask], self.first_at[down[ask]], most[ask])
                take_up = share_up >= share_down
                best = np.where(take_up, share_up, share_down)
                found = best >= 0
                into = np.where(take_up, up, down)
                w = live[miss]
                size[w] = np.where(found, best, 0)
                at[w] = np.where(take_up, self.last_at[into], self.first_at[into])
                q[miss] = np.where(take_up, self.stop[into] - 1, self.start[into])
                run[miss] = into
                goes[miss] = found
            step = live[goes]
            row[step] = self.to[run[goes]] + q[goes] - self.start[run[goes]]
            at[step] -= 1
            size[step] += 1
            lost = live[~goes]  # a symbol that the index doesn't have
            size[lost], row[lost], at[lost] = 0, 0, self.first_at[0]
            lengths[live, place] = size[live]
            long = live[size[live] >= self.length]
            if len(long):
                owner[long, sizes[long] - 1 - k] = self.class_owner[self.class_of[row[long]]]
        return lengths, owner
