"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import lexical_search
from quire.llm.lexical_search import Weights, rank_documents

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    big_n, big_l, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda m: " ".join(words[min(399, int(r.expovariate(0.02)))] for _ in range(m))
    return [(i, text(r.choice([1, 5, 40, 200]))) for i in range(n)], [(i, text(r.choice([1, 8, 40]))) for i in range(25)]


@pytest.mark.parametrize("block, segment, short", [(2048, 24 << 20, 0.25), (7, 3000, 0.25), (16, 20000, 0.0), (16, 20000, 9.0)])
def test_made_up_texts(spark, monkeypatch, block, segment, short):
    """With small blocks and segments, with no short list and with short lists only."""
    from functools import partial

    docs, items = made(300, 5)
    docs += [(1000 + i, t) for i, t in docs[:40]]  # copies: ties of score
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    pool, asked = plain(docs, items, 20), spark.createDataFrame(items, "item_id long, text string")
    # in the tasks too: what is patched here isn't so in Python workers that are forked already, so all is run by hand
    for name, value in (("BLOCK", block), ("SEGMENT", segment), ("SHORT", short), ("BATCH", min(segment, 4 << 20))):
        monkeypatch.setattr(lexical_search, name, value)
    found = by_hand(docs, items, 20)
    assert found == pool
    if block == 2048:
        assert sorted((tuple(r) for r in rank_documents(df, asked, 20).collect()), key=str) == pool


def by_hand(docs, items, k):
    """The steps of rank_documents without Spark."""
    import pyarrow as pa

    asked = lexical_search.distinct_terms(pa.array([t or "" for _, t in items], pa.large_string()))
    vocabulary = np.unique(np.concatenate(asked))
    writer, segments = lexical_search._Writer(vocabulary), []
    for at in range(0, len(docs), 10):
        part = docs[at : at + 10]
        texts = pa.array([t or "" for _, t in part], pa.large_string())
        writer.add(pa.array([i for i, _ in part], pa.int64()), texts, texts.nbytes)
        if writer.bytes >= lexical_search.SEGMENT:
            segments.append(writer.segment())
    segments += [writer.segment()] if writer.n else []
    df = np.zeros(len(vocabulary), np.int64)
    for s in segments:
        np.add.at(df, s["terms"][0].values.to_numpy(), np.diff(s["ends"][0].values.to_numpy(), prepend=0))
    weights = Weights(sum(s["n_docs"][0].as_py() for s in segments), sum(s["n_terms"][0].as_py() for s in segments), df)
    out = []
    for (item, _), terms_of in zip(items, asked):
        best, at = lexical_search.Best(k), np.searchsorted(vocabulary, terms_of)
        for s in segments:
            lexical_search.search(lexical_search.Segment({c: s[c][0].values for c in ("ids", "sizes", "terms", "ends", "docs", "tf")}, weights), at, weights.w[at], best)
        out += [(item, rank, i if known else None, int(x)) for rank, (x, i, known) in enumerate(zip(best.scores, best.ids.tolist(), best.known), 1)]
    return sorted(out, key=str)


def test_odd_rows(spark, none):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, "...\x00 "), (5, "A-B É é"), (6, "x" * 2_000_000 + " a"), (7, "été a " * 100_000)]
    items = [(1, "a É"), (1, "a É"), (2, None), (3, "..."), (4, "missing"), (None, "b")]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, rank int, item_id string")
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    assert sorted((tuple(r) for r in rank_documents(df, asked, 3).collect()), key=str) == plain(docs, items, 3)
    assert rank_documents(none, asked).collect() == [] and rank_documents(df, asked.limit(0)).collect() == []


def test_items_in_parts(spark, monkeypatch):
    docs, items = made(60, 8)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 700)
    found = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(docs, items, 10)


def test_lengths_beyond_64_bits():
    big = Weights(10**13, 10**16, np.zeros(1, np.int64))
    assert big.length_part(np.array([10, 10**7])).tolist() == [50 + 50 * n * 10**13 // 10**16 for n in (10, 10**7)]
