"""The suffix automaton, and last tokens by dynamic programming, against plain search and plain merging."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vecskein.llm import bpe
from vecskein.llm.automaton import SuffixAutomaton
from vecskein.llm.queries import vocabulary_path


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.binary(max_size=40).map(lambda b: bytes(97 + x % 4 for x in b)))
def test_all_strings_that_end_at_a_place(strings, text):
    names = {s: k for k, s in enumerate(sorted(strings))}
    seen = 0
    for end, matched, candidates in SuffixAutomaton(names.items()).iter(text):
        seen += 1
        assert end == seen
        longest = max((n for n in range(end + 1) if any(text[end - n : end] in s for s in strings)), default=0)
        assert matched == longest
        want = [(n, names[text[end - n : end]]) for n in range(end, 0, -1) if text[end - n : end] in names]
        assert [c for c in candidates if c[0] <= matched] == want
    assert seen == len(text)


def test_states_are_bounded():
    """Less than twice the bytes of the strings."""
    rnd = random.Random(3)
    strings = {bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 30))) for _ in range(200)}
    assert len(SuffixAutomaton((s, k) for k, s in enumerate(strings)).size) <= 2 * sum(map(len, strings))


def test_last_tokens_are_those_of_merging():
    codec, rnd = bpe.Codec(bpe.load_vocabulary(vocabulary_path())), random.Random(5)
    assert isinstance(codec.automaton, SuffixAutomaton)
    for _ in range(1500):
        piece = bytes(rnd.choice(b"etaoinshr _AB19\xc3\xa9\xff") for _ in range(rnd.randrange(1, 30)))
        ids = codec.solve(piece)
        assert [codec.bytes_of[i] for i in ids] == codec._merged(piece)
