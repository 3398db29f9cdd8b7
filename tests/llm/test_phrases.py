"""Phrase collocations against a plain version that counts every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import phrases
from quire.llm.phrases import build_graph, collocations, slices


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, most, least, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for ws in pieces(text):
            totals[lang] += len(ws)
            for m in range(1, most + 1):
                for i in range(len(ws) - m + 1):
                    counts[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        held = Counter()
        for g, a in found.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    held[g[i : i + m]] = max(held[g[i : i + m]], a)
        kept = []
        for g, a in found.items():
            if 100 * held[g] < share * a or g not in held:
                score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), " ".join(g), a, f[g[:k]], f[g[k:]], score))
        out += [(lang, rank, p, a, l, r, totals[lang], score) for rank, (_, _, _, p, a, l, r, score) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def made(n, seed):
    """Texts of few words, with long passages that many share, rings of words, and languages."""
    r = random.Random(seed)
    words = [*(f"w{i}" for i in range(60)), "É", "été", "日本", "a\x00b", "x y"]
    passages = [" ".join(f"p{j}q{i}" for i in range(r.choice([3, 30, 200]))) for j in range(6)]
    def text():
        parts = []
        for _ in range(r.randrange(1, 30)):
            parts.append(r.choice([r.choice(words), r.choice(words).upper(), r.choice(words), r.choice(passages), "ring of ring of ring of", "no no no no"]) + r.choice([" ", "  ", "\t", ", ", ".\n", " "]))
        return "".join(parts)
    return [(text(), r.choice(["en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("most, least, top", [(2, 3, 50), (3, 4, 2000), (4, 3, 5000), (5, 6, 100)])
def test_made_up_texts(spark, most, least, top):
    rows = made(120, most) + [(None, "en"), ("", None), (" . , ", "xx"), ("Alone", "de")]
    df = spark.createDataFrame([(t, x, 1, "clash") for t, x in rows], "text string, lang string, rank int, phrase string").repartition(3)
    assert sorted(tuple(r) for r in collocations(df, most, least, 50, top).collect()) == plain(rows, most, least, 50, top)


def test_paths_hold_their_passages_and_every_inner_edge_once(spark):
    rows = made(150, 9)
    df = spark.createDataFrame(rows, "text string, lang string")
    graph = build_graph(df, 3, 4)
    edges = graph.longest().select("lang", "gram").collect()
    assert len(edges) == len(set(edges)) == graph.kept[3].count()
    paths = graph.passages().collect()
    assert max(p.n_words for p in paths) > 20 and all(len(p.words.split(" ")) == p.n_words for p in paths)
    counts = Counter()
    for text, lang in rows:
        for ws in pieces(text):
            for i in range(len(ws) - 1):
                counts[lang or "und", ws[i], ws[i + 1]] += 1
    for p in paths:
        ws = p.words.split(" ")
        flows = [counts[p.lang, a, b] for a, b in zip(ws, ws[1:])]
        assert (min(flows), max(flows)) == (p.least, p.most)


def test_nothing(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string"), 3, 2).collect() == []


@pytest.mark.parametrize("size", [16, 50, 400, 1 << 20])
@pytest.mark.parametrize("look", [1, 2, 3])
def test_slices_give_every_gram_once(size, look):
    texts = ["one two three four. five", "", "a" * 70 + " b c d e f g h", "x y  z\t\tw v " * 30, " ", "é ü ö " * 40 + "!", "end"]
    seeds = np.arange(1, len(texts) + 1).astype(np.uint64)
    array = pa.array(texts, pa.large_string())
    for m in range(1, look + 2):
        found = Counter()
        for words in slices(array, seeds, look, size):
            for i in range(words.own):
                if words.follow[i] >= m:
                    found[int(words.text[i]), bytes(words.form[words.begin[i] : words.end[i + m - 1]]).decode()] += 1
        want = Counter((t, " ".join(ws[i : i + m])) for t, text in enumerate(texts) for ws in pieces(text) for i in range(len(ws) - m + 1))
        assert found == want


def test_a_long_text_without_breaks(spark, monkeypatch):
    text = "alpha beta gamma delta " * 300_000  # beyond a slice
    found = {r.phrase: r.a for r in collocations(spark.createDataFrame([(text, "en")], "text string, lang string")).collect()}
    assert found["alpha beta gamma"] == 300_000 and found["delta alpha beta"] == 299_999
    assert phrases.SLICE < len(text)
