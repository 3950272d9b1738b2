import random
import zlib

import numpy as np

from promptloom.llm import language_id


def corpus(n=600):
    rng = random.Random(0)
    parts = {"en": "the of and ing th er re", "de": "der ung sch ein ich ge", "fr": "le que eau ment é è"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text, lang, "s"))
    return rows


def test_held_out_accuracy_and_calibration(docs):
    rows = corpus()
    got = {r["doc_id"]: r for r in language_id.language_id(docs(*rows), sample=100).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]]["held_out"] == (r in held) for r in rows)
    right = np.array([got[r[0]]["lang_pred"] == r[2] for r in held])
    score = np.array([got[r[0]]["score"] for r in held])
    assert right.mean() > 0.95 and ((0 <= score) & (score <= 1)).all() and abs(score.mean() - right.mean()) < 0.1


def test_held_out_languages_are_never_looked_at(docs):
    rows = corpus(300)
    lied = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    a, b = (sorted(map(tuple, language_id.language_id(docs(*r), sample=50).collect())) for r in (rows, lied))
    assert a == b


def test_edge_rows(edge, empty, docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.language_id(edge).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and {r[1] for r in got} <= {"und", "en", "de"}
    assert language_id.language_id(empty).count() == 0
    alone = language_id.language_id(docs((1, "no label here"), (2, "123"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in alone} == {("und", 0.0)}


def test_grams_in_steps_equal_grams_at_once(monkeypatch):
    texts = ["The quick brown fox, jumps over ÉÈ the lazy dog " * 50, "ΣΑΣ  12 ab " * 40, "x" + " " * 300 + "y" + "!" * 200, "a", "ab c"]
    once = [language_id.grams(t) for t in texts]
    for step in (1, 2, 7, 97):
        monkeypatch.setattr(language_id, "STEP", step)
        for t, (f, n) in zip(texts, once):
            g, m = language_id.grams(t)
            assert g.tolist() == f.tolist() and m.tolist() == n.tolist()


def test_grams_equal_a_plain_count():
    def plain(text):
        low = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1) if n > 1 or 0 < i < len(low) - 1]

    for t in ("One two, three!", "ÄÖ  x", "zzz zz z"):
        assert language_id.grams(t)[1].sum() == len(plain(t)) and len(language_id.grams(t)[0]) <= len(set(plain(t)))


def test_training_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 10 + rng.integers(5)], np.uint16), np.array([1.0, 0.1])) for y in rng.integers(0, 3, 200)]
    labels = np.array([r[0][0] for r in rows], np.int64)
    w = language_id.train(rows, labels, 3)
    assert (np.count_nonzero(w, axis=1) > 0).sum() <= 8 and (w[:3].argmax(1) == np.arange(3)).all()
    scores = rng.normal(size=(500, 3))
    drawn = np.array([rng.choice(3, p=np.exp(s / 2) / np.exp(s / 2).sum()) for s in scores])
    assert 1.5 < language_id.calibrate(scores, drawn) < 2.8


def test_rejected_documents_go(docs):
    out = language_id.accepted_documents(docs(*corpus(200), (900, "123 456", None, "s"), (901, None, None, "s")), sample=50)
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {900, 901} and len(ids) >= 195 and "text" in out.columns
