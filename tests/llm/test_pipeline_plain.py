"""The pipeline against plain versions of its stages, one after the other, on a small table."""

import re

import brute
import pytest
from conftest import prose
from test_language_plain import plain as plain_languages
from test_rest import fold

import corpus_pipeline
from quire.llm.pii import mask_in_place

SHARED = " ".join(f"word{i}" for i in range(60))
#: Values of several kinds, each valid, and text that only looks alike.
PRIVATE = ["mail anna.berg@example.org now", "card 4111 1111 1111 1111 end", "IBAN ES91 2100 0418 4502 0005 1332 BIC", "born 1987-03-14 in town", "call +44 20 7946 0958 today", "again anna.berg@example.org and ES91 2100 0418 4502 0005 1332", "room 4111 1111 1111 1112 is no card"]


def rows():
    en, fr = "the cat sat on the mat and the dog was there with all of them", "le chat était sur le tapis et le chien était là avec eux"
    out = [(i, f"{en} {i} {prose(20, i)}", "en") for i in range(12)] + [(20 + i, f"{fr} {i} maison fleuve été {i}", "fr") for i in range(8)]
    out += [(40, SHARED, "en"), (41, SHARED.upper(), "en"), (42, SHARED + " one more", "en"), (43, "another begin " + SHARED, "en"), (44, SHARED, None), (45, " ".join(f"word{i}" for i in range(30)), "en")]
    out += [(50 + i, f"{en} {i * 7} {t}", "en") for i, t in enumerate(PRIVATE)]
    return out + [(60, None, "en"), (61, "", "en"), (62, "12345 !!", "en"), (63, "\n", None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage leaves, by name, the first being all."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame([(i, t, x, f"s{i % 3}", len(t or "")) for i, t, x in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.quire.piiKey", "a test's key")
    out, docs = {"all": spark.read.parquet(f"{folder}/documents.parquet")}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    found = {name: d.collect() for name, d in out.items()}
    found["run"] = corpus_pipeline.run(spark, folder).collect()
    spark.conf.unset("spark.quire.piiKey")
    return found, out["all"].columns


def texts(stage):
    return {r.doc_id: r.text for r in stage}


def test_columns_stay(stages):
    found, columns = stages
    assert all(list(found[name][0].asDict()) == columns for name, _ in corpus_pipeline.STAGES[:-1])


def test_languages_that_are_known_stay(stages):
    found, _ = stages
    want = {i for i, (_, lang, score) in plain_languages(rows()).items() if lang != "und" and score >= 0.05}
    assert set(texts(found["language_id"])) == want and {60, 61, 62, 63}.isdisjoint(want) and len(want) > 30


def test_of_equal_texts_the_largest_id_stays(stages):
    found, _ = stages
    groups = {}
    for i, t in texts(found["language_id"]).items():
        groups.setdefault(fold(t), []).append(i)
    assert set(texts(found["exact_dedup"])) == {max(g) for g in groups.values()} and 41 not in texts(found["exact_dedup"])


def test_of_near_copies_the_smallest_id_stays(stages):
    found, _ = stages
    before = sorted(texts(found["exact_dedup"]).items())
    want = {root for _, root in brute.components(before, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT).values()}
    assert set(texts(found["near_dedup"])) == want and 45 in want and len(want & {42, 43, 44}) == 1


def test_private_values_get_pseudonyms_that_stay_linked(spark, stages):
    found, columns = stages
    before, after = texts(found["near_dedup"]), texts(found["pii"])
    assert set(before) == set(after)
    private = re.compile(r"anna\.berg@example\.org|4111 1111 1111 1111\b|ES91 2100 0418 4502 0005 1332|1987-03-14|\+44 20 7946 0958")
    for i, t in before.items():
        if not private.search(t):
            assert after[i] == t
            continue
        assert not private.search(after[i])
        # all around the values stays as it is
        around = private.split(t)
        assert re.fullmatch(r"(\S+(?: \S+)*?)".join(map(re.escape, around)), after[i])
    if {50, 55} <= set(after):
        mail = re.search(r"\S+@\S+", after[50])[0]
        assert mail in after[55] and mail != "anna.berg@example.org"
    back = mask_in_place(spark.createDataFrame([(i, t) for i, t in before.items()], "doc_id long, text string"), b"a test's key").collect()
    assert {r.doc_id: r.text for r in back} == after  # the same key, the same pseudonyms


def test_all_ids_are_packed_once(stages):
    found, _ = stages
    ids = brute.packed_ids(texts(found["pii"]).items())
    for pieces in (found["packing"], found["run"]):
        at = {}
        for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
            assert r.start == at.get(r.doc_id, 0) and brute.crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            at[r.doc_id] = r.start + r.length
        assert at == {i: len(x) for i, x in ids.items()}
