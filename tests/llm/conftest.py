import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = "the of and to alpha beta gamma delta sigma tau rho maison fleuve été naïve straße niño 42 x1 don't we'll".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + r.choice(["", "", "", ",", ".", ".\n", "!", ";"]))
    return " ".join(out)


#: Nulls, empties, ties, copies, odd white space and marks, special strings, letters of many scripts, repeated rows.
ODD = [
    None, "", " ", "\n\n", "a", "A", "  two  spaces ", "tab\tand\r\nreturn", "x" * 300, "<|endoftext|>", "end<|endoftext|>of<|ENDOFTEXT|>text <|startoftext|>", "nbsp\u00a0here \u2003wide \u3000space", "e\u0301 combining, caf\u00e9", "日本語 テキスト。", "Ünïcödé ÀÉÎ, ß.", "emoji 😀 and 👩‍👩‍👧", "1234567890 12.5", "'s 'll don't CAN'T", "...", "\x00\x01 control", prose(30, 1), prose(400, 2), prose(400, 2), prose(400, 2).upper(), prose(60, 3) + " " + prose(60, 4), "pad " + prose(60, 3), prose(9000, 5), "\u00d7\u00f7 \u0149.", "ŉ, Ł. ž!",
]


@pytest.fixture(scope="session")
def odd_rows():
    rows = list(enumerate(ODD))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd texts as documents, with columns whose names clash with those of results."""
    rows = [(i, t, "en", "src0", len(t or ""), "clash", 7) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sid string, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
