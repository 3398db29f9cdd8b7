"""Licence scans against a plain version, expressions by hand."""

import re

import pytest

from quire.llm.licences import Automaton, evaluate, label_of, licence_digest, read_expression, scan_licences
from quire.llm.queries import LICENCES, op13_licences

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    """(n_words, n_base, first, last, base labels) of a text."""
    words, found = WORDS.findall(fold(text)), []
    for phrase, label in LICENCES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    None, "", " ", "under the mit license", "Under the\nMIT  License. UNDER (the) mit-license!", "xunder the mit license", "under the mit licenses", "cc by nc cc by nc", "CC BY-NC-SA 4.0", "Apache License, Version 2.0", "apache license version 2", "apache license version 2a", "é under the mit license é",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nmore", "// SPDX-License-Identifier: LicenseRef-Own */", "SPDX-License-Identifier tags are words", "licensed under either MIT or Apache-2.0 at your option", "licensed under a tree",
    "word " * 5000 + "under the mit license" + " word" * 5000, "under the", "mit license", "\x00under\x7fthe{mit}license\x00", "a" * 3_000_000 + " cc by nc",
]


def test_texts_against_a_plain_version(spark):
    rows = [*enumerate(TEXTS), (3, "cc by nc"), (3, "cc by nc"), (None, "cc by nc")]
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, hits string, score double").repartition(2)
    found = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licence_digest(scan_licences(df, LICENCES)).collect())
    assert found == sorted((i is None, i, *plain(t)) for i, t in rows)
    labels = {r.doc_id: (r.labels, r.score) for r in licence_digest(scan_licences(df.where("doc_id > 3"), LICENCES)).collect()}
    assert labels[8][0] == "cc-by-nc,cc-by-nc-sa" and labels[13] == ("gpl-3", 0.8) and labels[15] == ("licenseref-own", 1.0) and labels[16] == ("", 0.0) == labels[18]
    assert labels[14][0] == "apache-2,gpl-2-with-classpath-exception-2.0,mit" and labels[14][1] == pytest.approx(0.6)
    assert labels[17] == ("apache-2,mit", 0.1)


def test_nothing(spark):
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string"), LICENCES).collect() == []
    import pyarrow as pa

    assert Automaton({}).scan(pa.array(["a b"], pa.large_string()))[0].tolist() == [2]


def test_expressions():
    value = lambda text, anything=True: (lambda r: (r[0], *evaluate(r[1])))(read_expression(text, anything))
    assert value(": MIT") == ("MIT", {"mit"}, 0.1)
    assert read_expression("MIT OR GPL-3.0 AND BSD-3-Clause", True)[1] == ["MIT", "GPL-3.0", "BSD-3-Clause", "and", "or"]
    assert read_expression("(MIT OR GPL-3.0) AND BSD-3-Clause", True)[1] == ["MIT", "GPL-3.0", "or", "BSD-3-Clause", "and"]
    assert read_expression("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", True)[1] == ["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "and"]
    assert value("MIT OR GPL-3.0 AND BSD-3-Clause")[2] == 0.1 and value("(MIT OR GPL-3.0) AND AGPL-3.0")[2] == 0.9
    assert value("((MIT") == ("((MIT", {"mit"}, 0.1) and value("(MIT))")[0] == "(MIT)"
    assert value("MIT AND") == ("MIT", {"mit"}, 0.1) and value("MIT and others")[0] == "MIT" and value("AND MIT")[1] == frozenset()
    assert value("Nothing") == ("", frozenset(), 0.0) and value("") == ("", frozenset(), 0.0)
    assert value("the MIT license", False)[1] == {"mit"} and value("LicenseRef-x", False)[1] == frozenset()
    assert value("(" * 3000 + "MIT" + ")" * 3000)[1] == {"mit"}
    assert [label_of(x) for x in ("Apache-2.0", "GPL-3.0-or-later", "CC-BY-NC-4.0", "LGPL-2.1+", "BSD-3-Clause", "mitten")] == ["apache-2", "gpl-3", "cc-by-nc", "lgpl-2.1", "bsd-3-clause", None]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: (r.doc_id, *plain(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = op13_licences(spark, folder).collect()
    assert {r.doc_id: tuple(r)[:6] for r in found} == want and len(found) == len(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
