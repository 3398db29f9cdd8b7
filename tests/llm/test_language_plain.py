"""Language ID against a plain version: letter by letter, n-gram by n-gram."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import language_id
from quire.llm.language_id import CODES, DIM, N, UNKNOWN, Model, Space, identify
from quire.llm.pii import session_key


def letters(text):
    """Codes of a text's letters, 0 for each run of anything else, with one at both ends."""
    out = [0]
    for c in text or "":
        code = 0
        if c.isalpha():
            small = ord(c.lower()[0])
            code = small if small < CODES else 1 + small * 40503 % (CODES - 1)
        if code or out[-1]:
            out.append(code)
    return out if out[-1] == 0 else [*out, 0]


def profile(texts, vectors):
    total = np.zeros(DIM)
    grams = Counter()
    for text in texts:
        codes = letters(text)
        grams.update(tuple(codes[i : i + N]) for i in range(len(codes) - N + 1))
    for gram, n in grams.items():
        if any(gram):
            v = np.ones(DIM)
            for place, code in enumerate(gram):
                v = v * np.roll(vectors[code].astype(np.float64), N - 1 - place)
            total += n * v
    return total


def plain(rows):
    vectors = Space().rotated[0]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    langs = sorted({x for i, t, x in rows if x and not held[i] and any(letters(t))})
    prototypes = [profile([t for i, t, x in rows if x == lang and not held[i]], vectors) for lang in langs]
    out = {}
    for i, t, _ in rows:
        if not any(letters(t)) or not langs:
            out[i] = (held[i], UNKNOWN, 0.0)
            continue
        own = profile([t], vectors)
        cosines = [float(own @ p) / (np.linalg.norm(own) * np.linalg.norm(p)) for p in prototypes]
        best = int(np.argmax(cosines))
        out[i] = (held[i], langs[best], min(1.0, max(0.0, cosines[best])))
    return out


ROWS = [
    (1, "The cat sat on the mat, and the dog was there.", "en"), (2, "Le chat était sur le tapis; où est le chien ?", "fr"), (3, "Die Katze saß auf der Matte und schlief.", "de"), (4, "the THE the", "en"), (5, "El gato duerme en la casa", "es"), (6, None, "en"), (7, "", "fr"), (8, "12345 ... !!", "de"),
    (9, "日本語のテキスト 漢字", "ja"), (10, "où était le chat", None), (11, "schlief der Hund auf der Matte", None), (12, "El perro no duerme", "es"), (13, "a", "en"), (14, "there was a mat", None), (15, "Кошка спит на ковре", "ru"), (16, "İstanbul'da kedi", "tr"), (17, "la casa del gato", None),
]


@pytest.mark.parametrize("piece", [1 << 14, 7])
def test_predictions_are_those_of_the_plain_version(spark, monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    want = plain(ROWS)
    for r in identify(df).collect():
        held, lang, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang) and r.score == pytest.approx(score, abs=1e-5)


def test_predictions_by_pieces(monkeypatch):
    """In this process, so that the small piece holds: the same as at once."""
    texts = [t or "" for _, t, _ in ROWS]
    space = Space()
    prototypes = np.array([space.bundle(*np.unique(space.grams([t])[0], return_counts=True)) for t in texts[:3]])
    model = Model(["a", "b", "c"], (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).astype(np.float32))
    names, scores = model.predict(texts)
    monkeypatch.setattr(language_id, "PIECE", 5)
    again, more = model.predict(texts)
    assert names == again and np.allclose(scores, more, atol=1e-6)


def test_memory_of_a_long_text_of_many_letters():
    r = np.random.default_rng(3)
    text = "".join(map(chr, r.integers(0x4E00, 0x9FA5, 3_000_000).tolist()))  # 9 MB, hardly an n-gram twice
    model = Model(["x"], np.ones((1, DIM), np.float32))
    tracemalloc.start()
    assert model.predict([text])[0] == ["x"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 350 << 20


def test_the_sessions_key(spark):
    spark.conf.unset("spark.quire.piiKey")
    first = session_key(spark)
    assert len(first) == 64 and session_key(spark) == first
    spark.conf.set("spark.quire.piiKey", "own")
    assert session_key(spark) == b"own"
    spark.conf.unset("spark.quire.piiKey")
