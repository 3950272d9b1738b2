import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Full

from promptloom.llm import packing

from .conftest import EDGE

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return packing.Tokenizer(PATH), Full.from_file(PATH)


@pytest.mark.parametrize("text", [
    "", " ", "O'Neil's it's DON'T", "İstanbul ΣΑΣ", "café café ́x", "12² ab c", "日本 ǅ", "<|endoftext|> a<|endoftext|>b", "a\x1cb x\x85y", "a,b;c!!d 3.14 ß",
])
def test_tokens_equal_the_tokenizer(both, text):
    fast, full = both
    assert fast.encode(text) == np.array(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aA'sétÉ 1.,-<|>\n\tß́²😀"), max_size=30))
def test_tokens_of_random_texts(both, text):
    fast, full = both
    assert fast.encode(text) == np.array(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=60))
def test_sum_of_squares_against_a_plain_search(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 16)
    gaps = []
    for n, at, offset in zip(lengths, bins, offsets):
        def score(after):
            return sum(c * c for c in np.bincount([g for g in after if g], minlength=17))

        options = [score(gaps[:i] + [gaps[i] - n] + gaps[i + 1 :]) for i in range(len(gaps)) if gaps[i] >= n] + [score(gaps + [16 - n])]
        if at == len(gaps):
            gaps.append(16)
        assert offset == 16 - gaps[at]
        gaps[at] -= n
        assert score(gaps) == min(options)


def test_edge_rows(edge, empty, both):
    got = packing.pack(edge, PATH).toPandas()
    _, full = both
    want = []
    for r in EDGE:
        ids = [*full.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want += [(r[0], i, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    rows = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 4096
    assert packing.pack(empty, PATH).count() == 0


def test_groups_keep_their_sequences_apart_and_full(docs):
    table = docs(*[(i, "word " * (i * 37 % 900 + 1)) for i in range(600)])
    got = packing.pack(table, PATH, group=100).toPandas()
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 4096 and len(used) <= 1.1 * got["length"].sum() / 4096 + 6
