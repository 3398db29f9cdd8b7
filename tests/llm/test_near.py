import random

import brute
import pytest
from conftest import prose

from quire.llm.fingerprints import fingerprint_documents, likeness, read_fingerprint, signatures
from quire.llm.ngram_join import jaccard_components
from quire.llm.repeats import repeated_spans


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_components_of_odd_texts(odd, odd_rows, k, percent):
    assert got(jaccard_components(odd, k, percent)) == brute.components(odd_rows, k, percent)


def near_rows():
    """A large group of near copies, some of which are linked through others only; small groups; a line that many share."""
    r = random.Random(3)
    base, rows = prose(120, 7).split(" "), []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 9])):
            words[r.randrange(len(words))] = f"w{r.randrange(999)}"
        rows.append(" ".join(words))
    line = prose(25, 8)
    rows += [line + " " + prose(80, 100 + i) for i in range(80)]
    for i in range(20):
        text = prose(90, 300 + i)
        rows += [text, text.replace("alpha", "omega", 1), text + " end"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few, tile", [(128, 2048), (8, 40)])
def test_components_of_large_groups(spark, monkeypatch, few, tile):
    from quire.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df, 4, 85)) == brute.components(rows, 4, 85)


def test_sets_of_unlike_sizes_do_not_meet_in_tiles(spark, monkeypatch):
    """Documents of 2 to 40 out of 60 common passages: all share frequent shingles, few are of like size, so no tile of one band is large."""
    from quire.llm import ngram_join

    r, compared = random.Random(9), []
    passages = [prose(20, 700 + i) for i in range(60)]
    rows = [(i, " ".join(r.sample(passages, round(2 * 20 ** r.random())))) for i in range(160)]
    monkeypatch.setattr(ngram_join, "FEW", 8)
    monkeypatch.setattr(ngram_join, "TILE", 48)
    links = ngram_join._tile_links
    monkeypatch.setattr(ngram_join, "_tile_links", lambda members, *rest: compared.append(members.count()) or links(members, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df, 4, 85)) == brute.components(rows, 4, 85)
    assert sum(compared) <= 2 * len(rows)


def test_components_of_nothing(none):
    assert jaccard_components(none).collect() == []


def spans(df):
    out = {}
    for r in df.orderBy("doc_id", "start_word").collect():
        out.setdefault(r.doc_id, []).append([r.start_word, r.end_word])
        assert r.n_words == r.end_word - r.start_word and r.other_id != r.doc_id and r.duplicate == (r.other_id < r.doc_id)
    return out


def test_repeats_are_those_of_brute_force(spark, odd, odd_rows):
    assert spans(repeated_spans(odd, 50)) == brute.repeats(odd_rows, 50)
    shared = [prose(n, 900 + n) for n in (55, 70, 120)]
    rows = [(i, prose(100, 1000 + i) + " " + (shared[i % 3] if i % 4 else "") + " " + prose(80, 2000 + i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert spans(repeated_spans(df, 50)) == brute.repeats(rows, 50)


def test_repeats_of_overlapping_passages(spark):
    """Documents take cuts of few long texts with some words changed: who shares most to the left shares little to the right."""
    r, rows = random.Random(5), []
    bases = [prose(160, 500 + i).split(" ") for i in range(3)]
    for i in range(120):
        base = r.choice(bases)
        a = r.randrange(0, 80)
        words = base[a : a + r.randrange(45, 80)]
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = f"w{r.randrange(9999)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert spans(repeated_spans(df, 50)) == brute.repeats(rows, 50)


def test_repeats_of_periodic_texts(spark):
    import random

    r = random.Random(11)
    rows = []
    for i in range(40):
        loop = r.choice(["ab", "one two", "x y z", "la la"])
        rows.append((i, prose(r.randrange(0, 40), 50 + i % 7) + " " + " ".join([loop] * r.randrange(20, 90)) + " " + prose(r.randrange(10, 60), 70 + i % 5)))
    assert spans(repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50)) == brute.repeats(rows, 50)


@pytest.mark.parametrize("hot", [2, 15])
def test_repeats_of_frequent_keys(spark, monkeypatch, hot):
    """The same with windows in place of suffixes for all but rare keys: other ids too are the least ones."""
    from quire.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    r, rows = random.Random(5), []
    bases = [prose(160, 500 + i).split(" ") for i in range(3)] + [prose(9, 9).split(" ") * 18]
    for i in range(160):
        base = r.choice(bases)
        a = r.randrange(0, 80)
        words = base[a : a + r.randrange(45, 80)]
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = f"w{r.randrange(9999)}"
        rows.append((i, " ".join(words)))
    found = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50).cache()
    assert spans(found) == brute.repeats(rows, 50)
    words, where = dict((i, t.lower().split()) for i, t in rows), {}
    for i, w in words.items():
        for x in range(len(w) - 49):
            where.setdefault(tuple(w[x : x + 50]), set()).add(i)
    for s in found.collect():
        w = words[s.doc_id]
        assert s.other_id == min(d for x in range(s.start_word, s.end_word - 49) for d in where[tuple(w[x : x + 50])] if d != s.doc_id)


def test_repeats_of_a_passage_in_very_many_documents(spark):
    """45 words, with the least 5-gram among them, stand in all of 300,000 documents; two each share the 8 words before them as
    well, and none what follows."""
    from pyspark.sql import functions as F

    common = F.lit(" ".join(f"c{i}v2955" for i in range(45)))
    pair = F.concat_ws(" ", *[F.concat(F.lit("p"), F.expr(f"xxhash64(id div 2, {i})").cast("string")) for i in range(8)])
    docs = spark.range(0, 300_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", pair, common, F.expr("'a' || xxhash64(id, 9)")).alias("text"))
    found = repeated_spans(docs, 50)
    right = F.expr("start_word = 0 and end_word = 53 and other_id = doc_id ^ 1")
    assert found.select(F.count(F.lit(1)), F.count_if(right)).first() == (300_000, 300_000)


def test_repeats_of_nothing(none):
    assert repeated_spans(none).collect() == []


def test_fingerprints(odd, odd_rows):
    import hashlib

    rows = {r.doc_id: r for r in fingerprint_documents(odd).collect()}
    edited = brute.edited(odd_rows)
    texts = {i: t or "" for i, t in odd_rows}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        after, text = edited[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        own, other, following = (set(signatures([t])[0].tolist()) for t in (texts[i], text, texts[after]))
        assert set(read_fingerprint(r.fingerprint).tolist()) == own
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r.near_edited == pytest.approx(jaccard(own, other), abs=1e-12) and r.near_next == pytest.approx(jaccard(own, following), abs=1e-12)
    assert rows[21].fingerprint == rows[22].fingerprint


def test_fingerprints_over_many_runs(spark, monkeypatch):
    from quire.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RUN_ROWS", 7)
    rows = [(i * 3, prose(20 + i % 9, i)) for i in range(100)]
    edited = brute.edited(rows)
    import hashlib

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = fingerprint_documents(df).collect()
    assert len(found) == 100 and all(r.edited_sha256 == hashlib.sha256(edited[r.doc_id][1].encode()).hexdigest() for r in found)


def test_fingerprints_of_one_and_none(spark, none):
    assert fingerprint_documents(none).collect() == []
    only = fingerprint_documents(spark.createDataFrame([(5, "the quick brown fox of the hill")], "doc_id long, text string")).collect()
    assert len(only) == 1 and only[0].near_next == 1.0


def test_likeness_bounds():
    import numpy as np

    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4], np.uint32)
    assert likeness(a, b) == 0.5 and likeness(a, a) == 1 and likeness(a[:0], a) == 0 and likeness(a[:0], b[:0]) == 1


def test_lines_that_many_have_bring_no_sets_together(spark, monkeypatch):
    """Documents of words of their own that take some of few common lines: what they share comes last, so no tile takes in most of them."""
    from quire.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FEW", 16)
    met, write = {}, ngram_join.Scratch.write

    def counted(self, df, name, by=None):
        out = write(self, df, name, by)
        met[name] = out.count() if name == "tiled" else 0
        return out

    monkeypatch.setattr(ngram_join.Scratch, "write", counted)
    r, lines = random.Random(4), [prose(12, 50 + i) for i in range(6)]
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, own(i) + " " + " ".join(r.sample(lines, 3))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df, 4, 85)) == brute.components(rows, 4, 85)
    assert met["tiled"] <= 20


def test_filters_take_few_jobs_with_many_partitions(spark):
    """The driver fetches filters by bytes, not with a job for each shuffle partition."""
    import numpy as np
    from pyspark.sql import functions as F

    from quire.llm.ngram_join import key_filter

    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, context = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("filters", "filters")
        bits = key_filter(spark.range(5000).select(F.expr("id * 211 % (1 << 20)").alias("h")), 20)
        jobs = len(context.statusTracker().getJobIdsForGroup("filters"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted({i * 211 % (1 << 20) for i in range(5000)})
    assert jobs <= 5


def test_components_of_links(spark):
    """Paths, stars, repeated and turned links, links of a node with itself; nodes in finished stars take no round."""
    from quire.llm.components import components
    from quire.shared import Scratch

    r = random.Random(9)
    path = list(range(100, 160))
    r.shuffle(path)
    links = list(zip(path, path[1:])) + [(7, i) for i in range(200, 1500)] + [(-3, 8), (8, -3), (-3, 8), (5, 5)]
    links += [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long").repartition(3), Scratch(spark, "test"), "links").collect()
    assert len(found) == len(root) - len(alone) and {x.node: x.root for x in found} == {x: find(x) for x in root if x not in alone}
    tables, write = [], Scratch.write
    scratch = Scratch(spark, "test")
    scratch.write = lambda df, name: tables.append(name) or write(scratch, df, name)
    assert components(spark.createDataFrame([(1, i) for i in range(2, 9)], "a long, b long"), scratch, "star").count() == 8
    assert tables == ["star-0", "star-near-0"]
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "none").collect() == []
