"""Licence scans: Aho-Corasick finds notice phrases and identifier tags; licence expressions behind tags are parsed by a
shunting yard and evaluated."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import by_bytes, texts_of
from quire.llm.words import PUNCTUATION, raw

#: Notice phrases as words, each with its licence.
NOTICES = {
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu lesser general public license version 3": "lgpl-3", "gnu lesser general public license version 2 1": "lgpl-2.1", "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2 0": "mpl-2", "eclipse public license version 2 0": "epl-2", "the mit license mit": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit", "redistribution and use in source and binary forms with or without modification": "bsd",
    "bsd 3 clause license": "bsd-3-clause", "bsd 2 clause license": "bsd-2-clause", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "creative commons attribution 4 0": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "cc0 1 0 universal": "cc0-1", "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Tags before an expression; whether identifiers of no known family may follow (LicenseRef-...).
TAGS = {"spdx license identifier": True, "license expression": True, "licensed under": False, "licenced under": False}
#: How much a licence asks of those who use the text, by the family that a label begins with; the longest family counts.
ASKS = {
    "mit": 0.1, "0bsd": 0.05, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "unlicense": 0.0, "cc0": 0.0, "wtfpl": 0.0, "apache": 0.2, "bsl": 0.1, "postgresql": 0.1, "python": 0.15, "psf": 0.15, "artistic": 0.3, "ncsa": 0.1,
    "cc-by": 0.2, "cc-by-sa": 0.5, "cc-by-nd": 0.7, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 1.0, "odbl": 0.5, "ofl": 0.3, "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "eupl": 0.6, "lgpl": 0.6, "gpl": 0.8, "agpl": 0.9, "gfdl": 0.7, "sspl": 1.0, "licenseref": 1.0,
}
#: What an exception (WITH) leaves of what the licence asks.
EXCEPTED = 0.75
BINDS = {"or": 1, "and": 2, "with": 3}
#: Words that may stand between "licensed under" and the licence.
FILLERS = {"the", "either", "both", "a", "of", "terms", "an"}
TOKEN = re.compile(r"[ \t\"'*/#:=]*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+-]*[A-Za-z0-9+]|[A-Za-z0-9]))")
HITS = "array<struct<start: long, words: int, kind: string, found: string, labels: array<string>, asks: double>>"


def label_of(identifier: str) -> str | None:
    """The label of an identifier of a known family: without case, version noughts, "-only" and "-or-later"; of Creative Commons
    licences without the version. None for other words."""
    name = identifier.lower()
    name = re.sub(r"(-only|-or-later|\+)$", "", name)
    name = re.sub(r"^(cc-by(?:-nc|-nd|-sa)*)-\d.*$", r"\1", name)
    name = re.sub(r"(\d)(\.0)+$", r"\1", name)
    return name if family(name) else None


def family(label: str) -> str | None:
    parts = label.split("-")
    return next((f for n in range(len(parts), 0, -1) if (f := "-".join(parts[:n])) in ASKS), None)


def asks(label: str) -> float:
    return ASKS.get(family(label) or "", 1.0)


def read_expression(text: str, anything: bool) -> tuple[str, list[str]]:
    """(what was read, its tokens in postfix order) of the licence expression that ``text`` begins with.

    A shunting yard: operands go to the output, operators wait until one that binds no tighter, or a bracket, comes; WITH binds
    tighter than AND, AND than OR. The expression ends before the first token that cannot go on with it; an operator or
    bracket left without an operand is dropped, an open bracket closes there. anything: identifiers of no known family
    are taken if they begin with LicenseRef-, and nothing may stand before the first identifier."""
    out: list[str] = []
    waiting: list[str] = []
    at = end = 0
    operand = True  # whether one is due
    excepting = False
    while m := TOKEN.match(text, at):
        opens, closes, word = m.groups()
        low = (word or "").lower()
        if operand:
            if opens and not excepting:
                waiting.append("(")
            elif word and low not in BINDS and (excepting or label_of(word)) and (anything or not low.startswith("licenseref")):
                out.append(word)
                operand, excepting, end = False, False, m.end()
            elif word and not anything and not out and low in FILLERS:
                pass
            else:
                break
        elif closes and "(" in waiting:
            while (op := waiting.pop()) != "(":
                out.append(op)
            end = m.end()
        elif low in BINDS:
            ahead = TOKEN.match(text, m.end())
            if not ahead or ahead[2] or low == "with" and not (ahead[3] and "exception" in ahead[3].lower()):
                break  # plain words: "... under MIT and the others"
            if low != "with" and ahead[3] and not label_of(ahead[3]):
                break
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand, excepting = True, low == "with"
        else:
            break
        at = m.end()
    if operand and out:  # operators that found no operand
        while waiting and waiting[-1] != "(" and operand:
            waiting.pop()
            operand = False
    out += [op for op in reversed(waiting) if op != "("]
    return text[:end].strip(" \t\"'*/#:="), out


def evaluate(postfix: list[str]) -> tuple[frozenset[str], float]:
    """(labels, how much is asked) of an expression in postfix order: AND asks what its stricter side asks, OR leaves the choice and so
    asks what the milder one does, WITH asks three quarters and adds the exception to the labels of its licence."""
    stack: list[tuple[frozenset[str], float] | str] = []
    for token in postfix:
        if token in ("and", "or") and len(stack) > 1:
            (b, y), (a, x) = _value(stack.pop()), _value(stack.pop())
            stack.append((a | b, max(x, y) if token == "and" else min(x, y)))
        elif token == "with" and len(stack) > 1:
            exception, (a, x) = stack.pop(), _value(stack.pop())
            stack.append((frozenset(f"{label}-with-{str(exception).lower()}" for label in a), x * EXCEPTED))
        elif token not in BINDS:
            stack.append(token)
    found = [_value(x) for x in stack]
    return frozenset().union(*(a for a, _ in found)), max((x for _, x in found), default=0.0)


def _value(x) -> tuple[frozenset[str], float]:
    return x if isinstance(x, tuple) else (frozenset([label_of(x) or x.lower()]), asks(label_of(x) or ""))


class Automaton:
    """An Aho-Corasick automaton over phrases of words. Texts are brought to the form of the phrases: words with one blank between."""

    def __init__(self, phrases: dict[str, object]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for phrase, value in phrases.items():
            key = f" {phrase} ".encode().decode("latin-1")
            self.machine.add_word(key, (len(key), len(phrase.split(" ")), phrase, value))
        if phrases:
            self.machine.make_automaton()
        self.empty = not phrases
        #: Bytes to bytes: A-Z to a-z, what stands between words to a blank. FF stands between texts.
        self.form = np.where(PUNCTUATION, 32, np.arange(256)).astype(np.uint8)
        self.form[65:91] += 32
        self.form[255] = 255

    def scan(self, texts: pa.Array):
        """(words of each text; text, first word, words, phrase, value, the text behind it as a function) of every place."""
        data, ends = raw(texts)
        joined = np.insert(data, np.repeat(ends[1:], 3), np.tile(np.array([32, 255, 32], np.uint8), len(texts)))
        joined = np.concatenate((np.array([32], np.uint8), joined))
        form = self.form[joined]
        blank = form == 32
        keep = np.ones(len(form), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        origin, form = np.flatnonzero(keep), form[keep]
        begins = np.zeros(len(form), bool)
        begins[1:] = (form[1:] != 32) & (form[1:] != 255) & (form[:-1] == 32)
        words = np.cumsum(begins)
        limits = np.flatnonzero(form == 255)
        upto = np.concatenate((np.zeros(1, np.int64), words[limits]))
        found = []
        blob = joined.tobytes()
        for last, (size, n, phrase, value) in () if self.empty else self.machine.iter(form.tobytes().decode("latin-1")):
            first = last - size + 2
            text = int(np.searchsorted(limits, first))

            def behind(at=int(origin[last - 1]) + 1) -> str:
                stop = min((x for x in (blob.find(b"\n", at), blob.find(b"\xff", at)) if x >= 0), default=len(blob))
                return blob[at:stop].decode("utf-8", "replace")

            found.append((text, int(words[first] - 1 - upto[text]), n, phrase, value, behind))
        return np.diff(upto), found


def scan_licences(docs: DataFrame, base: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, hits, asks.

    Words are those of letters A-Z and a-z (in lower case), digits and all that is no ASCII; a phrase is found where its words
    stand consecutively in the whole text, in as many places as there are, overlapping ones too. hits, by place: start (the first
    word, from 0), words, kind (``base`` for the phrases given, ``notice`` for those of NOTICES, ``tag`` for expressions behind a
    tag), found (the phrase, or the expression as it stands in the text), labels, and what is asked (0 to 1). A tag whose text is no
    licence expression is no hit. asks of a document: the largest of its hits, as all that is stated holds; 0 without any.

    Nulls count as empty texts: no words, no hits. A null id stays null, repeated rows are scanned each, an empty table gives no
    rows, other columns are never read. Rows stay where they were read; a batch holds about 2 MB of text, and a longer text
    stands alone (about 30 bytes of memory for each of its own). Phrases are those of the program, not of the data.
    """
    kinds: dict[str, object] = {p: ("notice", label) for p, label in NOTICES.items()} | {t: ("tag", anything) for t, anything in TAGS.items()} | {p: ("base", label) for p, label in base.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(kinds)
        for batch in by_bytes(batches, "text", 2 << 20):
            texts = texts_of(batch)
            n_words, found = machine.scan(texts)
            hits: list[list[dict]] = [[] for _ in range(len(texts))]
            for text, start, n, phrase, (kind, value), behind in found:
                if kind == "tag":
                    phrase, postfix = read_expression(behind(), value)
                    labels, much = evaluate(postfix)
                    if not labels:
                        continue
                else:
                    labels, much = frozenset([value]), asks(value)
                hits[text].append({"start": start, "words": n, "kind": kind, "found": phrase, "labels": sorted(labels), "asks": much})
            for own in hits:
                own.sort(key=lambda h: (h["start"], h["words"], h["kind"]))
            much = [max((h["asks"] for h in own), default=0.0) for own in hits]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, HIT_TYPE), pa.array(much, pa.float64())], ["doc_id", "n_words", "hits", "asks"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, hits {HITS}, asks double")


HIT_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int32()), ("kind", pa.string()), ("found", pa.string()), ("labels", pa.list_(pa.string())), ("asks", pa.float64())]))


def licence_digest(scanned: DataFrame) -> DataFrame:
    """Per document of scan_licences: doc_id, n_words, n_base (places of base phrases), first_word and last_word (the smallest and
    largest start of these, else null), base_labels and labels (distinct, sorted, joined by commas), score (what is asked)."""
    base = F.filter("hits", lambda h: h["kind"] == "base")
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["labels"])))), ",")
    starts = F.transform(base, lambda h: h["start"])
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("hits")).alias("labels"), F.col("asks").alias("score"))
