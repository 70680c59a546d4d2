"""The run-length index by itself: its answers come from the transform, and its size follows the runs."""

import random

import numpy as np
import pytest

from placeledger.llm import suffix_dedup


def pieces(rng, base, copies, changes):
    """Different pieces, as copies with changed letters, in falling order of their documents."""
    texts = []
    for _ in range(copies):
        letters = list(base[rng.randint(0, len(base) // 3) :])
        for _ in range(rng.randint(0, changes)):
            letters[rng.randrange(len(letters))] = rng.choice("abcdé")
        texts.append("".join(letters).encode())
    texts = list(dict.fromkeys(texts))
    owners = sorted((rng.randint(-5, 9) for _ in texts), reverse=True)
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    return texts, np.array(owners), data, np.cumsum(sizes + 1) - (sizes + 1), sizes


def answers(index, data, starts, sizes):
    return {
        (int(p), int(w)): int(o)
        for on, window, place in index.stream(data, starts, sizes)
        for p, w, o in zip(on, window, index.first_owner(place), strict=True)
    }


@pytest.mark.parametrize("length", [8, 9, 17, 50])
def test_first_owners(length):
    rng = random.Random(length)
    for _ in range(20):
        base = "".join(rng.choice("ab c") for _ in range(rng.randint(2 * length, 300)))
        texts, owners, data, starts, sizes = pieces(rng, base, rng.randint(1, 12), 3)
        where = {}
        for t, o in zip(texts, owners, strict=True):
            for i in range(len(t) - length + 1):
                where[t[i : i + length]] = min(o, where.get(t[i : i + length], o))
        index = suffix_dedup.RunIndex(data, starts, sizes, owners, length)
        want = {(k, i): where[t[i : i + length]] for k, t in enumerate(texts) for i in range(len(t) - length + 1)}
        assert answers(index, data, starts, sizes) == want


@pytest.mark.parametrize("length", [8, 50, 400])
def test_rows_are_suffixes_a_window_can_follow(length):
    """The index has a row for each window and one more for each piece, not one for each byte, and they are in order."""
    rng = random.Random(length)
    base = "".join(rng.choice("ab c") for _ in range(2 * length))
    texts, owners, data, starts, sizes = pieces(rng, base, 30, 3)
    kept = [len(t) >= length for t in texts]
    texts = [t for t, k in zip(texts, kept, strict=True) if k]
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    index = suffix_dedup.RunIndex(data, starts, sizes, owners[kept], length)
    assert index.n == int((sizes - length + 2).sum()) == index.ends[-1] == index.lengths.sum()
    rows = [(int(s) + i, t[i : i + length - 1]) for s, t in zip(starts, texts, strict=True) for i in range(len(t) - length + 2)]
    last = {}
    for place, row in rows:
        last[row] = place
    assert [int(x) for x in index.end_samples] == [last[row] for row in sorted(last)]


def test_marks():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        marked = rng.random(n) < 0.3
        assert (suffix_dedup.Marks(marked).up_to(np.arange(n)) == np.cumsum(marked)).all()


def test_pieces_of_short_and_empty_texts():
    """Pieces cover each window once, and no window goes over the end of a text."""
    rng = random.Random(4)
    for length in (8, 50):
        texts = ["".join(rng.choice("ab c") for _ in range(rng.choice([0, 0, 1, length - 1, length, length + 1, 3 * length]))) for _ in range(60)]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        text, starts, windows, _, _, inside = suffix_dedup.placed(np.frombuffer("".join(texts).encode(), np.uint8), offsets, length)
        got = [(int(t), int(s - offsets[t]) + i) for t, s, n in zip(text, starts, windows, strict=True) for i in range(n)]
        assert got == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1)]
        assert (inside >= windows - 1).all() and (inside <= length - suffix_dedup.gram(length)).all()


def test_answers_come_from_the_transform():
    rng = random.Random(3)
    base = "".join(rng.choice("ab c") for _ in range(400))
    _, owners, data, starts, sizes = pieces(rng, base, 40, 3)
    good = answers(suffix_dedup.RunIndex(data, starts, sizes, owners, 50), data, starts, sizes)
    for part in ("samples", "end_samples", "before"):
        index = suffix_dedup.RunIndex(data, starts, sizes, owners, 50)
        spoiled = np.roll(getattr(index, part), 1)
        setattr(index, part, np.maximum(spoiled, 1))
        assert answers(index, data, starts, sizes) != good


def test_size_follows_runs():
    """Ten times as many copies make the text ten times as long, but not the index."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))

    def held(copies):
        _, owners, data, starts, sizes = pieces(rng, base, copies, 1)
        index = suffix_dedup.RunIndex(data, starts, sizes, owners, 50)
        return len(data), max(len(x) for x in vars(index).values() if isinstance(x, np.ndarray))

    (short, few), (long, many) = held(20), held(200)
    assert long > 8 * short and many < 5 * few and many < long / 20
