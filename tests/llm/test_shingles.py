import random

import pytest

from rimeframe.llm import _shingles
from rimeframe.llm.simhash import shingle_hashes

LONG, PIECE = _shingles.LONG, _shingles.PIECE


def texts():
    rng = random.Random(1)
    yield from ["", " \n", "x" * PIECE, "x" * (PIECE + 1) + " y", "a " * PIECE, "q " + "x" * (PIECE + LONG) + " t", " " * (PIECE + 9) + "r"]
    for _ in range(40):
        bits = ["a", "B", "c ", " ", "\n", "\x1c", "é", "日 ", "Q" * rng.choice([900, LONG - 1, LONG, LONG + 1]), "z" * rng.choice([3, PIECE, 3 * PIECE])]
        yield "".join(rng.choices(bits, [20] * 8 + [1, 0.05], k=rng.choice([1, 3, 2000, 8000])))


def test_words_are_told_apart_wherever_they_stand():
    seen = {}
    for text in texts():
        words = text.encode().translate(_shingles._LOWER).split()
        hashes = _shingles.word_hashes(text).tolist()
        assert len(hashes) == len(words)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingles_repeat_where_those_of_words_do(k):
    for text in texts():
        own = _shingles.shingles(_shingles.word_hashes(text), k)
        want = shingle_hashes(text, k)
        assert len({*zip(own.tolist(), want.tolist())}) == len(set(own.tolist())) == len(set(want.tolist()))


def test_null_and_short_texts():
    assert not len(_shingles.word_hashes(None)) and not len(_shingles.shingles(_shingles.word_hashes(""), 5))
    short, spaced, other = (_shingles.shingles(_shingles.word_hashes(t), 5) for t in ("A b", " a\tB ", "b a"))
    assert len(short) == 1 and short == spaced and short != other
