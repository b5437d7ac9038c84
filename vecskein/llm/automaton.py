"""A suffix automaton of a set of byte strings, and the strings that end at each place of a text.

A state stands for the substrings of the set that end at the same places of it; its suffix link leads to the longest
suffix that ends elsewhere too. Reading a text keeps the longest suffix that is a substring of some string, by
its state and length. The strings that are suffixes of it lie in that state, as far as they are no longer, and
in those that its links reach: they are listed for each state once, longest first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    def __init__(self, strings: Iterable[tuple[bytes, int]]) -> None:
        """strings: (bytes, name), no two alike and none empty."""
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        strings = list(strings)
        for text, _ in strings:
            at = 0
            for byte in text:
                at = self._extend(at, byte)
        own: dict[int, list[tuple[int, int]]] = {}
        for text, name in strings:
            at = 0
            for byte in text:
                at = self.step[at][byte]
            own.setdefault(at, []).append((len(text), name))
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.size)
        for at in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            below = self.ends[self.link[at]]
            self.ends[at] = (*sorted(own[at], reverse=True), *below) if at in own else below

    def _add(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _longest(self, at: int, byte: int) -> int:
        """The state that ``byte`` leads to, whose longest string is that of ``at`` and the byte: parted from its class if need be."""
        to = self.step[at][byte]
        if self.size[to] == self.size[at] + 1:
            return to
        new = self._add(self.size[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = new
        while at >= 0 and self.step[at].get(byte) == to:
            self.step[at][byte] = new
            at = self.link[at]
        return new

    def _extend(self, at: int, byte: int) -> int:
        if byte in self.step[at]:
            return self._longest(at, byte)
        new = self._add(self.size[at] + 1, {}, 0)
        while at >= 0 and byte not in self.step[at]:
            self.step[at][byte] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._longest(at, byte)
        return new

    def iter(self, text: bytes) -> Iterator[tuple[int, int, tuple[tuple[int, int], ...]]]:
        """(end, matched, candidates) for every place: the candidates (size, name) no longer than ``matched`` end there."""
        step, link, size, ends = self.step, self.link, self.size, self.ends
        at = matched = 0
        for end, byte in enumerate(text, 1):
            to = step[at].get(byte)
            while to is None and at:
                at = link[at]
                matched = size[at]
                to = step[at].get(byte)
            if to is None:
                at = matched = 0
            else:
                at, matched = to, matched + 1
            yield end, matched, ends[at]
