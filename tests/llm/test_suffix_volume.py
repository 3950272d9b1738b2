import hashlib
import random

import numpy as np
import pytest

from promptloom.llm import suffix_dedup as sd


@pytest.mark.parametrize("values, ascending", [([], False), ([0, 0], True), ([7], True), ([3, 3, 1 << 40, (1 << 64) - 1], True), ([(1 << 64) - 1, 0, 255, 256], False)])
def test_packed_arrays_come_back(values, ascending):
    a = np.array(values, np.uint64)
    assert sd._unpack(sd._pack(a, ascending)).tolist() == values


def test_a_passage_among_other_words_is_sorted_once(docs, monkeypatch):
    rng = random.Random(3)

    def prose(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))

    passage, sizes, plain = prose(400), [], sd._least_documents
    # another character on each side in each document, so that nothing more agrees by chance
    texts = [prose(90) + chr(33 + i) + passage + chr(33 + i) + prose(90) for i in range(60)]
    monkeypatch.setattr(sd, "_least_documents", lambda strings, total: sizes.append(total) or plain(strings, total))
    got = {r["doc_id"]: r for r in sd.substring_dedup(docs(*[(i - 5, x) for i, x in enumerate(texts)])).collect()}
    # the passage and the bytes that its pieces share, not one string more for each document
    assert sizes[0] < 2 * len(passage)
    for i, x in enumerate(texts):
        r, gone = got[i - 5], bytearray(len(x))
        for a in range(len(x) - 49):
            if any(x[a : a + 50] in y for y in texts[:i]):
                gone[a : a + 50] = b"\1" * 50
        assert r["n_removed"] == sum(gone) and r["kept_sha256"] == hashlib.sha256(bytes(c for c, z in zip(x.encode(), gone) if not z)).hexdigest()


def test_windows_that_repeat_in_one_document_only_stay(docs):
    line = "the same forty and more letters of a line that stands twice in a single document; "
    got = {r["doc_id"]: r["n_removed"] for r in sd.substring_dedup(docs((1, line + "x" * 60 + line), (2, "quite another text " * 9), (None, line))).collect()}
    assert got == {1: 0, 2: 0, None: len(line)}


def test_hashes_of_windows_tell_the_order_of_bytes():
    rest = bytes(range(48))
    texts = [bytes([a, b]) + rest for a in range(40) for b in range(40)]
    assert len({int(sd._window_hashes(np.frombuffer(x, np.uint8))[0]) for x in texts}) == len(texts)
    assert len({int(sd._grams(np.frombuffer(x[:32], np.uint8))[0]) for x in texts}) == len(texts)
