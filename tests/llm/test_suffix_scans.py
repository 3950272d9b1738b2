import random

import numpy as np
import pytest

from promptloom.llm import suffix_dedup as sd

from .test_suffix_dedup import brute


def _rows():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefg hij") for _ in range(90)) for _ in range(4)]
    rows = [(i % 17, "".join(rng.choice(passages) if rng.random() < 0.5 else rng.choice("xyz ") * rng.randrange(60) for _ in range(4))) for i in range(40)]
    return rows + [(50, rows[3][1]), (51, rows[4][1]), (None, rows[3][1])]


def test_a_pass_reads_the_texts_once(docs, monkeypatch):
    scans, plain = [], sd._pieces

    def pieces(rows, *rest):
        scans.append(rows.select("rid", "text")._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return plain(rows, *rest)

    monkeypatch.setattr(sd, "_pieces", pieces)
    rows = _rows()
    assert sorted(map(tuple, sd.substring_dedup(docs(*rows)).collect()), key=str) == brute(rows)
    assert scans == [1]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_rows_that_the_bit_table_mistakes_for_copies_stay(docs, monkeypatch, most):
    monkeypatch.setattr(sd, "bit_table", lambda keys, column: np.full(sd.TABLE_BITS // 8, 255, np.uint8))
    monkeypatch.setattr(sd, "MISTAKEN", most, raising=False)
    rows = _rows()
    assert sorted(map(tuple, sd.substring_dedup(docs(*rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("bits", [(8, 8, 8), (64, 64, 16), (64, 64, 64), (40, 3, 64)])
def test_keys_are_ranked_as_tuples(bits):
    rng = np.random.default_rng(sum(bits))
    pools = [rng.integers(0, (1 << b) - 1, 9, np.uint64, endpoint=True) for b in bits]
    keys = [p[rng.integers(0, 9, 2000)] for p in pools]
    tuples = list(zip(*(k.tolist() for k in keys)))
    names = {x: i for i, x in enumerate(sorted(set(tuples)))}
    some, inverse = sd._distinct(keys)
    assert inverse.tolist() == [names[x] for x in tuples] and [tuples[i] for i in some] == sorted(names)
    assert np.argsort(sd._joined(keys), kind="stable").tolist() == np.lexsort(keys[::-1]).tolist()
