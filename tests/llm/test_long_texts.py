"""Long texts are read in pieces: the same counts and fingerprints as in one go, in memory of a few times the text."""

import random
import tracemalloc

import pytest

from latticeweave.llm import quality, simhash
from test_text_operators import odd_texts


def _texts():
    rnd = random.Random(5)
    words = ["a", "bé", "Ç#", "word", "77", "long-winded-word", "e.", "\n", "\r\n", "\t", "x\ny", "日本"]
    return [t or "" for t in odd_texts()] + [" ".join(rnd.choices(words, k=k)) for k in (0, 1, 2, 3, 4, 50, 400)] + ["a b c\n" * 90, "a\n" * 200, "é" * 700 + " z", "\n" * 50 + "q"]


@pytest.mark.parametrize("size", [1, 64, 1000])
def test_pieces_count_as_the_whole(size):
    for t in (t.encode() for t in _texts() if len(t) < 20_000):
        assert quality._counts_of_long(t, size) == quality.counts_of(t)
        assert simhash.fingerprint(t, size=size) == simhash.fingerprint(t, size=1 << 40)


@pytest.mark.parametrize("read", [quality.counts_of, simhash.fingerprint])
def test_memory_of_a_long_text(read):
    rnd = random.Random(7)
    text = " ".join(f"w{rnd.randrange(100_000)}" for _ in range(1_000_000)).encode()
    tracemalloc.start()
    read(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)  # in one go: 25 times (quality) and 17 times (simhash)
