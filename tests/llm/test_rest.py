import re
import zlib
from collections import Counter

import pytest
from conftest import prose

from quire.llm import queries
from quire.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from quire.llm.language_id import identify
from quire.llm.pii import FORMS, Feistel, Pseudonyms, luhn, mask_documents, mod97, pseudonymise
from quire.llm.url_filter import UrlTrie, judge_urls


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_duplicates(spark, odd, odd_rows):
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(fold(t), []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(odd).collect()} == want


def test_exact_duplicates_of_repeated_and_null_ids(spark, none):
    rows = [(1, "A"), (1, "a"), (2, "b"), (None, "c"), (None, "C"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_duplicates(df).collect()
    assert len(found) == 7 and sum(r.kept for r in found) == 4
    assert {r.doc_id for r in found if r.kept} == {1, 2, None, 4}
    assert exact_duplicates(none).collect() == []
    assert sorted(r.doc_id for r in drop_exact_duplicates(df.where("doc_id > 1")).collect()) == [2, 4]
    repeated = spark.createDataFrame([(3, "b"), (3, "B"), (3, "b"), (1, "b"), (None, None), (None, ""), (5, "c"), (5, "d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in drop_exact_duplicates(repeated).collect()) == [(0, ""), (3, "b"), (5, "c"), (5, "d")]


def test_directory_splits_full_buckets(spark):
    """Half of the keys lie in one 4096th of the range, so the directory has to double beyond its first level there."""
    from quire.llm.exact_dedup import KEY_BITS, build_directory
    from quire.shared import Scratch

    near, far = f"id * {1 << 20}L", f"id * {1 << (KEY_BITS - 11)}L"
    keys = spark.range(2048).selectExpr(f"{near} key", "100L bytes").union(spark.range(2048).selectExpr(f"{far} key", "10L bytes")).dropDuplicates(["key"])
    directory = build_directory(keys, 1500, Scratch(spark, "test"))
    assert len(directory.levels) > 1
    rows = directory.place(keys).collect()
    held = Counter()
    for r in rows:
        depth = r.bucket.bit_length() - 1
        assert r.key >> (KEY_BITS - depth) == r.bucket - (1 << depth)
        held[r.bucket] += r.bytes
    assert len(rows) == keys.count() and max(held.values()) <= 1500 and len(held) > 200
    one = spark.createDataFrame([(7, 10**9), (9, 1)], "key long, bytes long")  # a key alone can't split
    assert {r.bucket > 0 for r in build_directory(one, 10, Scratch(spark, "test")).place(one).collect()} == {True}


@pytest.mark.parametrize("few", [0, 3])
def test_exact_duplicates_of_frequent_texts(spark, monkeypatch, few):
    from quire.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "FEW_ROWS", few)
    rows = [(i, ["Hot", "hOT", "b", "c", None, ""][i % 6] if i < 60 else f"t{i // 2}", i) for i in range(100)] + [(None, "hot", 100), (57, "B", 101), (57, "b", 102)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long").repartition(5)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(fold(t), []).append(i)
    found = exact_duplicates(df).collect()
    assert len(found) == len(rows)
    for r in found:
        g = next(g for t, g in groups.items() if __import__("hashlib").sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.doc_id in g and r.keep_id == max(x for x in g if x is not None) and r.group_size == len(g) and (not r.kept or r.doc_id == r.keep_id)
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter({r.text_sha256: 1 for r in found})
    stay = drop_exact_duplicates(df).collect()
    assert len(stay) == len(groups) and all(r.doc_id == max(x for x in groups[fold(r.text)] if x is not None) and rows[r.key][0] == r.doc_id for r in stay)


def test_exact_dedup_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "mine", "x", 5), (2, "A", "yours", "y", 6)], "doc_id long, text string, _key string, _sha string, _keep int").selectExpr("*", "1 as key", "2 as bucket", "3 as row", "4 as norm", "5 as place")
    assert [tuple(r) for r in drop_exact_duplicates(df).collect()] == [(2, "A", "yours", "y", 6, 1, 2, 3, 4, 5)]
    assert drop_exact_duplicates(df).columns == df.columns and len(exact_duplicates(df).collect()) == 2


RULES = queries.URL_RULES


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12/", "example.org", "/en/12/", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"),
        ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("x://h?a://b/c", "h", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), RULES).collect()[0]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_trie_takes_the_longest():
    trie = UrlTrie([("block", "a.b", ""), ("allow", "b", "/x/"), ("allow", "a.b", "/x/y"), ("block", "a.b", "/x/yz/")])
    assert trie.match("c.a.b", "/x/yz/1")[0] == "a.b/x/yz/" and trie.match("a.b", "/x/yw")[0] == "a.b/x/y" and trie.match("a.b", "/q")[0] == "a.b" and trie.match("b", "/x/1")[0] == "b/x/"
    with pytest.raises(ValueError):
        UrlTrie([("allow", "", "/")])


def test_feistel_is_a_permutation():
    f = Feistel(b"k")
    for m in (1, 2, 7, 100, 1000):
        assert sorted(f.permute("x", i, m) for i in range(m)) == list(range(m))
        assert all(f.permute("x", f.permute("x", i, m), m, back=True) == i for i in range(m))


PII = "Mail Jo.Doe7@mail.example.com or JO.DOE7@mail.example.com, card 4111 1111 1111 1111 or 4785380592391138 4111111111111111, ip 10.2.30.4 and 999.1.1.1, call +1 (523) 555-1055, born 1984-02-29 or 31/12/1999, not 2023-02-30, ssn 219-09-9999, token \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\", iban DE89 3704 0044 0532 0130 00, version 2.0."


def test_pseudonyms_are_valid_and_go_back(spark):
    df = spark.createDataFrame([(1, PII), (2, PII), (3, None), (4, "nothing here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in mask_documents(df, b"k").collect()}
    new = rows[1].text
    assert rows[2].text == new and rows[3].text is None and rows[4].text == "nothing here" and rows[4].n_found == 0
    for secret in ("Jo.Doe7", "4111 1111 1111 1111", "10.2.30.4", "555-1055", "1984-02-29", "31/12/1999", "219-09-9999", "24be6443", "3704 0044"):
        assert secret not in new
    assert "999.1.1.1" in new and "2023-02-30" in new and "version 2.0." in new and "4785380592391138" in new
    kinds = Counter(m.lastgroup for m in FORMS.finditer(new))
    assert kinds == Counter(m.lastgroup for m in FORMS.finditer(PII))
    found = {k: [m[0] for m in FORMS.finditer(new) if m.lastgroup == k] for k in kinds}
    assert found["email"][0] == found["email"][1]
    assert all(luhn(re.sub(r"\D", "", c)) for c in found["card"][:1]) and re.sub(r"\D", "", found["card"][0]) == found["card"][-1]
    assert mod97(found["iban"][0].replace(" ", "")) == 1
    back = mask_documents(df.where("doc_id = 1").drop("text").join(spark.createDataFrame([(1, new)], "doc_id long, text string"), "doc_id"), b"k", back=True).collect()[0].text
    assert back == PII.replace("Jo.Doe7", "jo.doe7").replace("JO.DOE7", "jo.doe7")


@pytest.mark.parametrize("kind, value", [("date", "1/2/2020"), ("date", "13/2/2020"), ("date", "2/13/2020"), ("date", "2020/01/31"), ("ssn", "667-01-0001"), ("ssn", "665-99-9999"), ("phone", "+493012345678"), ("ip", "0.0.0.0")])
def test_values_go_back(kind, value):
    names = Pseudonyms(b"q")
    new = names.of(kind, value)
    back = names.of(kind, new, back=True)
    assert [int(x) for x in re.findall(r"\d+", back)] == [int(x) for x in re.findall(r"\d+", value)]


@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
@pytest.mark.parametrize("behind", ["", " BIC", " I", " BIC CAIXESBB", " IBAN", " SWIFT", " BERLIN1", " AND DE89 3704 0044 0532 0130 00", " HAVE 4111 1111 1111 1111", ", X"])
def test_ibans_before_words_of_capitals(iban, behind):
    for key in (b"a", b"b", b"c"):
        names, counts, text = Pseudonyms(key), {}, f"IBAN {iban}{behind} end"
        new = pseudonymise(text, names, counts)
        assert counts["iban"] == 1 + ("DE89" in behind) and counts.get("card", 0) == ("4111" in behind)
        shown = new[5 : 5 + len(iban)]
        assert shown != iban and shown[:2] == iban[:2] and mod97(shown.replace(" ", "")) == 1 and "3704 0044" not in new and "4111 1111" not in new
        assert "DE89" in behind or "4111" in behind or new == f"IBAN {shown}{behind} end"
        assert pseudonymise(new, names, {}, back=True) == text


def test_values_behind_what_is_no_iban():
    names, counts = Pseudonyms(b"a"), {}
    new = pseudonymise("AB12 CDEF GHIJ DE89 3704 0044 0532 0130 00 and ID42 CODE 4111 1111 1111 1111", names, counts)
    assert counts == {"iban": 1, "card": 1} and "3704" not in new and "4111" not in new and new.startswith("AB12 CDEF GHIJ DE")


def test_ibans_of_other_lengths_go_back():
    """Countries and lengths that no registry has, before a word: the end is found again in the pseudonym."""
    names = Pseudonyms(b"a")
    for country in ("ZZ", "DE"):
        for i in range(200):
            body = f"{i * 7919 % 10**8:08d}{i:08d}5678"
            plain = f"{country}{98 - mod97(country + '00' + body):02d}{body}"
            text = " ".join(plain[j : j + 4] for j in range(0, len(plain), 4)) + " WORD"
            new = pseudonymise(text, names, {})
            assert new != text and pseudonymise(new, names, {}, back=True) == text


def test_languages(spark, odd, none):
    words = {"en": "the of and is that with have from this they", "fr": "le la des et les dans pour que avec sont", "de": "der die und nicht ist mit sich auf ein werden"}
    import random

    r, rows = random.Random(5), []
    for i in range(300):
        lang = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[lang].split()) for _ in range(30)), lang if i % 7 else None))
    found = {x.doc_id: x for x in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0 and lang]
    assert len(found) == 300 and sum(found[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in found.values())
    one = {x.doc_id: x for x in identify(odd).collect()}
    assert [one[i].lang_pred for i in (0, 1, 2, 16, 18)] == ["und"] * 5 and one[21].lang_pred == "en"
    assert identify(none).collect() == []


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert kept.isdisjoint({0, 1, 2, 3, 16, 18}) and 26 in kept and len(kept & {21, 22}) == 1 and 22 in kept
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where(F.lit(False)), "").columns == docs.columns
