import hashlib
import random

import pytest

from promptloom.llm import suffix_dedup

from .conftest import EDGE


def brute(rows):
    first, out = {}, []
    last = suffix_dedup.LAST
    for d, text in sorted(((r[0] if r[0] is not None else last, r[1]) for r in rows), key=lambda r: r[0]):
        for x in range(len(b := (text or "").encode()) - 49):
            first.setdefault(b[x : x + 50], d)
    for r in rows:
        d, b = r[0] if r[0] is not None else last, (r[1] or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - 49):
            if first[b[x : x + 50]] < d:
                gone[x : x + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((r[0], len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_edge_rows(edge, empty):
    assert sorted(map(tuple, suffix_dedup.substring_dedup(edge).collect()), key=str) == brute(EDGE)
    assert suffix_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_passages(docs, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)  # several blocks and ranges
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.choice([49, 50, 51, 80, 300]))) for _ in range(8)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdef ") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(6)))
        rows.append((rng.randrange(50), text))
    assert sorted(map(tuple, suffix_dedup.substring_dedup(docs(*rows)).collect()), key=str) == brute(rows)


def test_kept_text(docs):
    p = "a passage that is longer than fifty bytes, surely, as it goes on and on"
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.substring_dedup(docs((1, f"x {p} y"), (2, f"before {p}after"), (3, f"before {p}after"), (4, "short")), keep=True).collect()}
    assert got == {1: f"x {p} y".encode(), 2: got[2], 3: b"", 4: b"short"}
    assert got[2].startswith(b"before") and got[2].endswith(b"after") and len(got[2]) < 15
