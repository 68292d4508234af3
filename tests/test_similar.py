"""Texts similar to earlier ones, against difflib for every pair."""

import difflib
import random
from collections import Counter

import pytest

from tessera.operators import parsing as p


def texts(rng, n):
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.4:
            old = list(rng.choice(out))
            for _ in range(rng.randrange(1 + len(old) // 4)):
                old[rng.randrange(len(old))] = rng.choice("abcdef ")
            out.append("".join(old))
        else:
            out.append("".join(rng.choice("abcdef ") for _ in range(rng.choice([0, 3, 30, 31, 60]))))
    return out


def test_bounds_agree_with_difflib():
    rng = random.Random(4)
    told = texts(rng, 120) + ["", "가나다라", "가나다라마"]
    for least in (0.5, 0.85):
        for a in told:
            for b in told:
                assert p.Judged(b).similar(p.Judged(a), least) == (difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= least)


def test_texts_apart_are_not_matched(monkeypatch):
    """What characters in common or in order rule out, and what stands whole in the other, is not matched block by block."""

    def matched(self):
        raise AssertionError("matched")

    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", matched)
    a = "a grant for small firms that export parts of machines"
    assert not p.Judged(a[::-1]).similar(p.Judged(a), 0.85)
    assert p.Judged(a[2:]).similar(p.Judged(a), 0.85)


def test_large_groups_meet_in_runs(spark):
    rng, rows = random.Random(8), []
    for group, n in ((1, 41), (None, 12), (2**53 + 1, 5), (3, 1)):
        rows += [(group, k // 2, x) for k, x in enumerate(texts(rng, n))]
    want = Counter()
    for group in {g for g, _, _ in rows}:
        own = sorted((at, x) for g, at, x in rows if g == group)
        for k, (at, x) in enumerate(own):
            want[group, at] += any(difflib.SequenceMatcher(None, y, x, autojunk=False).ratio() >= 0.85 for _, y in own[:k])
    held = spark.createDataFrame([*rows, (1, 7, None), (1, None, "x")], "page long, at long, text string")
    for meeting in (4, 64):
        found = Counter(tuple(x) for x in p.similar_to_earlier(held, "page", "at", "text", 0.85, meeting).collect())
        assert found == +want and len(found) > 5


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_common_length(n):
    rng = random.Random(n)
    a, b = ("".join(rng.choice("abcd") for _ in range(k)) for k in (n, 70))
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for k, y in enumerate(b):
            row.append(best[k] + 1 if x == y else max(best[k + 1], row[-1]))
        best = row
    assert p.common_length(p.Judged(a).places, len(a), b) == best[-1]
