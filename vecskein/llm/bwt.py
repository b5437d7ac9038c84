"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

A shard's transform comes from its suffix array. To merge shards no suffix is sorted again: all rows start
in one block, and each round deals them by the symbols before their suffixes, stably, which orders them by as
many more symbols. Rows part into blocks as their prefixes differ, and the round in which two neighbours part
gives their common prefix. After ``depth`` symbols the blocks that are left are the repeated intervals.

A round takes ``step`` symbols at once, so the common prefixes are known to that grain; one symbol gives them exactly.
Each string ends in a terminator of its own, so no repeat reaches across strings. Equal strings are one string with a
weight, as in a run-length encoded transform: each of its rows stands for as many suffixes.
"""

from __future__ import annotations

import numpy as np

STEP = 4
#: Symbols that a round takes where only whole repeats are asked for, at most.
WIDEST = 20


class Shard:
    """Suffix array and transform of some strings, laid out one after the other with a terminator each."""

    def __init__(self, strings: list[bytes]) -> None:
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        self.n = int(lens.sum()) + len(strings)
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        ends = np.cumsum(lens + 1) - 1
        text[ends] = 0
        self.suffixes = self._sort(text, ends)
        before = text[self.suffixes - 1]  # the first string's first suffix is preceded by the last terminator
        self.symbols = before
        self.step_back = np.empty(self.n, np.int64)
        self.step_back[np.argsort(before.astype(np.uint16), kind="stable")] = np.arange(self.n)

    @staticmethod
    def _sort(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Prefix doubling from a few symbols; terminators differ by their strings. Rows alone in their group are settled."""
        n, (small, bits) = len(text), _dense(text)
        width = max(1, min(n, (62 - n.bit_length()) // bits))
        key = np.zeros(n, np.int64)
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the string's terminator
        for k in range(width):
            key <<= bits
            key[: n - k] |= small[k:]
        beyond = bits * np.maximum(width - 1 - left, 0)
        key = (key >> beyond) << beyond
        # rows that reach a terminator come by their strings, as they stand: they differ from all others
        order, key = _ordered(key)
        rank, at, rows = np.empty(n, np.int64), np.arange(n), order
        shut = left[rows] < width
        while True:  # the rows at the places ``at`` are in order as far as the keys say: a rank is the place of a group's first row
            new = np.append(True, key[1:] != key[:-1])
            if shut is not None:
                new |= shut
                shut = None
            start = at[np.flatnonzero(new)][new.cumsum() - 1]
            rank[rows] = start
            tied = ~new
            tied[:-1] |= tied[1:]
            at, rows = at[tied], rows[tied]
            if not len(at):
                return order
            by, key = _ordered(rank[rows] * n + rank[rows + width])  # a tied row reaches no terminator yet
            rows = rows[by]
            order[at] = rows
            width *= 2


def _dense(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols renamed in their order without gaps, a terminator as zero, and how many bits they take."""
    there = np.bincount(symbols, minlength=1) > 0
    there[0] = True
    names = there.cumsum() - 1
    return names[symbols], max(1, int(names[-1]).bit_length())


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of non-negative keys, equal ones as they come, and the keys in it."""
    bits = max(1, len(key).bit_length())
    if int(key.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key << bits) | np.arange(len(key)))
    return both & ((1 << bits) - 1), both >> bits


def _names(symbols: np.ndarray, back: np.ndarray, step: int, bits: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, row, open) of every row: its last ``step`` symbols, nearest least, named in their order; the row they lead to;
    and whether a terminator is among them. Long codes are pairs of short ones.
    """
    if step > 5:
        near, row, open_ = half = _names(symbols, back, step // 2, bits)
        far, end, beyond = half if step % 2 == 0 else _names(symbols, back, step - step // 2, bits)
        code = far[row] * (int(near.max(initial=0)) + 1) + near
        row, open_ = end[row], open_ | beyond[row]
    else:
        code, row, taken = symbols, back, 1
        while taken * 2 <= step:
            code, row, taken = code | (code[row] << (bits * taken)), row[row], taken * 2
        for k in range(taken, step):
            code, row = code | (symbols[row] << (bits * k)), back[row]
        ones = sum(1 << (bits * k) for k in range(step))
        open_ = (code - ones) & ~code & (ones << (bits - 1)) != 0  # a field of zeros borrows
    order, code = _ordered(code)
    name = np.empty(len(code), np.int64)
    name[order] = np.append(False, code[1:] != code[:-1])[: len(code)].cumsum()
    return name, row, open_


def merge(shards: list[Shard], depth: int, step: int = STEP, whole: bool = True, weight: np.ndarray | None = None, prefixes: bool = True, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, block, common) of the merged rows, ordered by ``depth`` symbols.

    source: the row in the concatenated shards; block: its repeated interval; common: symbols, to the grain of
    ``step``, that a row shares with the one before it (depth where they are in one block; zeros without ``prefixes``).
    ``depth`` is a multiple of ``step``. ``weight`` says how many equal suffixes a row of the concatenated shards stands for (one each
    unless given): the run length of its place in the transform. Unless ``whole``, only the rows of repeated intervals are
    given, those of two suffixes or more: a row is dropped as soon as its block holds one suffix, since what precedes
    it is then alone in the next round, and as soon as its prefix holds a terminator. ``among``: the rows of the concatenated
    shards, in their order, that have ``depth`` symbols before them, where it is known; only they can be given then.
    """
    sizes = np.array([s.n for s in shards])
    shift = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    symbols = np.concatenate([s.symbols for s in shards])
    back = np.concatenate([s.step_back for s in shards]) + shift
    symbols, bits = _dense(symbols)
    code, row, open_ = _names(symbols, back, step, bits)
    source = np.arange(len(symbols)) if among is None or whole or prefixes else among
    if not len(source):
        return source, source, source
    block = np.zeros(len(source), np.int64)
    common = np.zeros(len(source), np.int64)
    for done in range(0, depth, step):
        order, c = _ordered(code[source])
        old, block = source[order], block[order]
        source, ends = row[old], open_[old]
        part = np.empty(len(c), bool)
        part[0] = True
        part[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        part |= ends
        block = part.cumsum()
        if prefixes:  # rows that a step leads on from share that step and what lay between the rows it came from
            shared = np.zeros(len(c), np.int64)
            on = np.flatnonzero((c[1:] == c[:-1]) & ~ends[1:]) + 1
            if len(on):
                between = np.stack([order[on - 1] + 1, order[on] + 1], 1).ravel()
                shared[on] = step + np.minimum.reduceat(np.append(common, 0), between)[::2]
            common = shared
        if not whole:
            alone = part & np.append(part[1:], True)
            if weight is not None:
                alone &= (weight[source] < 2) | ends
            if alone.any():
                rest = np.flatnonzero(~alone)
                if not len(rest):
                    return source[:0], block[:0], common[:0]
                if prefixes:  # what two neighbours share is the least of what all rows between them did
                    common = np.minimum.reduceat(common[: rest[-1] + 1], np.append(0, rest[:-1] + 1))
                source, block = source[rest], block[rest]
    return source, block, common


def repeats(strings: list[bytes], length: int, shard_bytes: int = 1 << 15, weights: np.ndarray | None = None, step: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, string, offset) of every substring of ``length`` that occurs twice or more in the collection.

    ``weights``: how often each string stands in the collection; it enters the transform once, as a run of that length.
    Strings are dealt over the shards in turn, so that neighbours, which may be alike, meet in the merge and not
    in the suffix array of one shard. A group is an interval of the merged transform: the rows that no round has parted share ``length`` symbols.
    """
    if not strings:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    n = max(1, -(-sum(len(s) + 1 for s in strings) // shard_bytes))
    dealt = [k for at in range(n) for k in range(at, len(strings), n)]
    shards = [Shard(part) for at in range(n) if (part := strings[at::n])]
    step = step or max(d for d in range(1, WIDEST + 1) if length % d == 0)
    lens = np.fromiter((len(strings[k]) + 1 for k in dealt), np.int64, len(dealt))
    starts = np.concatenate(([0], np.cumsum(lens)))
    places = np.concatenate([s.suffixes + o for s, o in zip(shards, np.concatenate(([0], np.cumsum([s.n for s in shards])[:-1])), strict=True)])
    owner = np.repeat(np.arange(len(dealt)), lens)
    names = np.array(dealt, np.int64)
    weight = None if weights is None else np.asarray(weights, np.int64)[names][owner][places]
    offset = places - starts[owner[places]]
    source, block, _ = merge(shards, length, step, False, weight, False, np.flatnonzero(offset >= length))
    place = places[source]
    return block, names[owner[place]], offset[source]
