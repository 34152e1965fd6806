"""The best window against all windows."""

import random

from fairlead.functions import similarity
from fairlead.functions.similarity import indel_ratio, partial_ratio


def all_windows(a, b):
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long_ else 0.0
    n = len(short)
    edges = [long_[:k] for k in range(1, n)] + [long_[-k:] for k in range(1, n)]
    return max(indel_ratio(short, w) for w in [long_[i:i + n] for i in range(len(long_) - n + 1)] + edges)


def test_same_as_all_windows():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice(rnd.choice(["ab ", "etaoins rh", "éxyz"])) for _ in range(n))
    for _ in range(3000):
        a, b = word(rnd.choice([0, 1, 2, 5, 12, 40])), word(rnd.choice([0, 1, 3, 12, 80]))
        assert partial_ratio(a, b) == all_windows(a, b), (a, b)


def test_few_windows_are_compared(monkeypatch):
    calls, one = [], similarity.window_lcs
    monkeypatch.setattr(similarity, "window_lcs", lambda *x: calls.append(1) or one(*x))
    rnd = random.Random(6)
    long_ = " ".join("".join(rnd.choice("etaoinshrdlcump") for _ in range(7)) for _ in range(1000))
    assert partial_ratio("cv portfolio transcript", long_) == all_windows("cv portfolio transcript", long_)
    assert len(calls) < len(long_) / 3
