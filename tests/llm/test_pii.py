import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptloom.llm import pii

from .conftest import EDGE


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15],
    ]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111-1111 1111", "1.2.3.4", "+1 (555) 123-4567", "a@b.c", "@", ".", "..", "-", " ", "+", "7", "255", "256.", "x", "é", "("]), max_size=9))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text)[0] == brute(text)


def test_edge_rows(edge, empty):
    got = pii.personal_data(edge).collect()
    assert len(got) == len(EDGE) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in got)
    assert pii.personal_data(empty).count() == 0


def test_spans_and_counts(docs):
    r = pii.personal_data(docs((1, "é mail a@b.co or 1.2.3.4, card 4111111111111111, +1 (555) 123-4567."))).first()
    want = "email:7:13,ip:17:24,card:31:47,phone:49:66"
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_contexts_discover_and_base_spans_stay(docs):
    seeds = [(i, f"please call me on +1 (555) {200 + i}-{1000 + 7 * i} tonight") for i in range(30)]
    unseen = (100, "so call me on +1 (555) 200-1 tonight")
    other = [(200 + i, f"order number {10000 + i} shipped") for i in range(20)]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(*seeds, unseen, *other)).collect()}
    assert all(got[i]["n_phone"] == 1 for i in range(30)) and got[100]["n_phone"] == 0
    assert got[100]["spans"] == "phone:14:28"
    assert all(got[200 + i]["spans"] == "" for i in range(20))


@pytest.mark.parametrize("kind, context, seeds, unseen, never", [
    ("email", "please write to {} today", [f"user{i}@example.com" for i in range(40)], ["bob@localhost", "ann [at] example [dot] org"], ["12345678"]),
    ("ip", "the host {} is up", [f"10.0.{i}.7" for i in range(40)], ["10.0.0.999"], ["77777"]),
    ("card", "paid by card {} today", [x for x in map(str, range(4111111111111000, 4111111111111400)) if luhn(x)], ["4111 1111 1111 1112"], ["4111 1111"]),
    ("phone", "call me on {} tonight", [f"+1 (555) {200 + i}-{1000 + 7 * i}" for i in range(40)], ["(555) 200-1234", "555 200 1234", "+1 (555) 20"], ["1234"]),
])
def test_each_kind_is_discovered(docs, kind, context, seeds, unseen, never):
    rows = [(i, context.format(x)) for i, x in enumerate([*seeds, *unseen, *never])]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(*rows)).collect()}
    at = context.index("{")
    for i, x in enumerate([*seeds, *unseen, *never]):
        assert got[i]["spans"] == ("" if x in never else f"{kind}:{at}:{at + len(x)}")
        assert got[i][f"n_{kind}"] == (x in seeds)


def plain_discovery(texts, rounds=pii.ROUNDS):
    sights = [[x for x in pii.observe(t)[1]] for t in texts]
    graph = {(p, span): k for own in sights for k, _, _, span, ps in own for p in ps if k >= 0}
    graph = {(p, span): k for own in sights for k, _, _, span, ps in own for p in ps} | graph
    base = {span: (1.0, k) for (_, span), k in graph.items() if k >= 0}
    known = dict(base)
    for _ in range(rounds):
        good = {}
        for p in {p for p, _ in graph}:
            own = [s for q, s in graph if q == p]
            by = {}
            for s in own:
                if s in known:
                    by.setdefault(known[s][1], []).append(known[s][0])
            if by:
                weight, n, kind = max((sum(x), len(x), k) for k, x in by.items())
                if n >= pii.SUPPORT and weight / len(own) >= pii.CONFIDENCE:
                    good[p] = (weight / len(own), kind)
        found = {}
        for (p, s), k in graph.items():
            if k < 0 and p in good and (-1 - k) >> good[p][1] & 1:
                found[s] = max(found.get(s, (0, -1)), good[p])
        known = base | found
    return [",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted([x[:3] for x in pii.observe(t)[0]] + [(found[s][1], a, b) for k, a, b, s, _ in own if k < 0 and s in found])) for t, own in zip(texts, sights)]


def test_discovery_equals_a_plain_version(docs):
    rng = random.Random(3)
    ids = [*(f"+1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}" for _ in range(25)), *(f"u{i}@a.org" for i in range(20)), *(str(rng.randrange(10**5, 10**8)) for _ in range(15)), "x@y", "10.0.0.256", "1.2.3.4", "9.9.9.9"]
    left, right = ["call", "phone", "mail to", "see", "room", "dial now"], ["today", "soon", "please", ""]
    texts = []
    for _ in range(250):
        kind = rng.choice(ids)
        side = rng.choice(left[:2] + left[5:]) if kind[0] == "+" and rng.random() < 0.9 else "mail to" if "@" in kind and rng.random() < 0.9 else rng.choice(left)
        texts.append(f"{side} {kind} {rng.choice(right)}".strip() + rng.choice(["", ". " + rng.choice(left) + " " + rng.choice(ids)]))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(*enumerate(texts))).collect()}
    want = plain_discovery(texts)
    assert [got[i] for i in range(len(texts))] == want
    base = [",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.observe(t)[0]) for t in texts]
    assert any(w != b for w, b in zip(want, base))


@pytest.mark.parametrize("text", ["1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+1 " * 20_000, "@" * 10_000])
def test_long_odd_texts_end(text):
    assert pii.base_spans(text)[0][0] == []
