"""Plain versions of the operators, for small tables only."""

from __future__ import annotations

import hashlib
import re
import zlib

import public_tokenizers


def table(rows):
    """doc_id -> text of small tables, null as empty."""
    return [(i, t or "") for i, t in rows]


def token_counts(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: (len(t.encode()), len(model.encode(t, add_special_tokens=False))) for i, t in table(rows)}


def bpe(rows):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, t in table(rows):
        ids = model.encode_ordinary(t)
        out[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def packed_ids(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: [*model.encode(t, add_special_tokens=False).ids, 2] for i, t in table(rows)}


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(rows, k, percent):
    rows = table(rows)
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for x, s in enumerate(sets):
        for w in s:
            where.setdefault(w, []).append(x)
    for x, s in enumerate(sets):
        for y in {y for w in s for y in where[w] if y < x}:
            both = len(s & sets[y])
            if 100 * both >= percent * (len(s) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return {i: (len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows)}


def repeats(rows, least):
    """doc_id -> list of [start, end) of words that lie in a window of ``least`` words which another document has too."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for i, t in table(rows)}
    where = {}
    for i, w in words.items():
        for x in range(len(w) - least + 1):
            where.setdefault(hash(tuple(w[x : x + least])), set()).add(i)
    out = {}
    for i, w in words.items():
        spans = []
        for x in range(len(w) - least + 1):
            if len(where[hash(tuple(w[x : x + least]))]) > 1:
                if spans and x <= spans[-1][1]:
                    spans[-1][1] = x + least
                else:
                    spans.append([x, x + least])
        if spans:
            out[i] = spans
    return out


def edited(rows):
    """doc_id -> (next id, edited text), the next being the next smaller id, after the last the first."""
    rows = sorted(table(rows), reverse=True)
    out = {}
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        out[i] = (j, t[: len(t) - half] + u[:half])
    return out
