"""What the matcher skips or shortens changes nothing in what it decides."""

from __future__ import annotations

import random

from panelytics.llm import decontaminate as d


def words(rnd: random.Random, n: int, letters: str) -> str:
    return "".join(rnd.choice(letters) for _ in range(n))


def test_single_blanks_are_left_and_texts_are_the_same():
    assert d.UNLIKE_BLANK.search("some plain words") is None
    rnd = random.Random(5)
    for _ in range(20_000):
        text = words(rnd, rnd.randrange(12), "aB  ._-\t\n İΣé1字")
        assert d.normalised(text) == d.OTHER.sub(" ", text.lower()).strip()


def test_positions_point_at_the_letters():
    rnd = random.Random(6)
    for _ in range(5_000):
        text = words(rnd, rnd.randrange(12), "aB  ._-\n İΣé1字")
        own, at = d.normalised(text), d.positions(text)
        assert len(own) == len(at) and at == sorted(at)
        for c, i in zip(own, at, strict=True):
            assert c == " " and d.OTHER.match(text[i].lower()[-1:]) or c in text[i].lower() or c in "σς" and text[i] == "Σ"


def test_kept_grams_are_counted_as_by_a_set():
    rnd = random.Random(7)
    item = words(rnd, 300, "abcd ")
    matcher = d.Matcher(([("x", item)], d.Settings()))
    budget = matcher.budgets[0]
    half = (128 - 129 // (budget + 2)) // 2
    seen = set()
    for _ in range(3_000):
        start = rnd.randrange(240)
        own, text = item[start : start + 128], list(item[start : start + 140])
        for _ in range(rnd.randrange(40)):
            text[rnd.randrange(len(text))] = rnd.choice("abcd ")
        text = "".join(text)
        there = set(d.grams(text[: half + budget]))
        want = len(own) >= half and sum(g in there for g in d.grams(own[:half])) >= half - 2 - 3 * budget
        assert matcher.likely(0, own, text) == want
        seen.add(want)
    assert seen == {True, False}
    first, rest = next(iter(matcher.halves.values()))
    assert first + rest == d.grams("".join([first[0], *(g[2] for g in (first + rest)[1:])])) and len(first) > len(rest) > 0


def test_common_beginning():
    assert [d.same(a, b) for a, b in (("", "a"), ("ab", "ab"), ("abc", "abd"), ("ab", "abc"), ("x", "y"))] == [0, 2, 2, 2, 0]
