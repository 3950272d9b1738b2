"""chrF++ by look-ups, against the plain definition."""

import random
import time
from collections import Counter

from promptloom.functions import text


def plain(hypothesis, reference, chars=6, words=2, beta=2.0):
    def f(hyp, ref, n):
        h, r = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (hyp, ref))
        if not h or not r:
            return None
        same = sum((h & r).values())
        p, q = same / sum(h.values()), same / sum(r.values())
        return 0.0 if not same else (1 + beta**2) * p * q / (beta**2 * p + q)

    a, b = "".join(hypothesis.split()), "".join(reference.split())
    scores = [f(list(a), list(b), n) for n in range(1, chars + 1)] + [f(text._chrf_words(hypothesis), text._chrf_words(reference), n) for n in range(1, words + 1)]
    scores = [s for s in scores if s is not None]
    return sum(scores) / len(scores) if scores else 0.0


def test_look_ups_give_the_plain_scores():
    rng = random.Random(3)
    made = ["", " ", "a", "ab", "a.", "the cat sat.", "ä \U0001f600 x", "aaaaaaaa", "\u00a0x y", "zzz"]
    made += ["".join(rng.choice("ab c.\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for a in made:
        for b in made:
            assert text._Hypothesis(a).score(b) == plain(a, b), (a, b)


def test_long_references_are_quick():
    rng = random.Random(4)
    item, long = (" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n)) for n in (40, 100_000))
    own, began = text._Hypothesis(item), time.time()
    assert 0 < own.score(long) < 1 and time.time() - began < 1.0
