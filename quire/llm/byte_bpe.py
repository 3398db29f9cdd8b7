"""Byte-level BPE: a minimal perfect hash for pre-tokens that are tokens, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import by_bytes, texts_of
from quire.llm.units import UnitCoder

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal and perfect: n keys take the slots 0 to n - 1. A first hash puts each key in a bucket; each bucket has a
    seed under which a second hash sends its keys to free slots, or, for a bucket of one key, the slot itself as
    -slot - 1. A foreign key lands on some slot too, so the key kept there is compared byte for byte."""

    def __init__(self, table: dict[bytes, int]):
        n = self.n = len(table)
        self.buckets = max(1, n // 3)
        keys = list(table)
        grouped: dict[int, list[bytes]] = {}
        for key in keys:
            grouped.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        taken = bytearray(n)
        singles = []
        for bucket, members in sorted(grouped.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            seed = 1
            while True:
                slots = [xxhash.xxh3_64_intdigest(k, seed) % n for k in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for key, slot in zip(members, slots):
                taken[slot] = 1
                self.keys[slot], self.values[slot] = key, table[key]
        free = iter([s for s in range(n) if not taken[s]])
        for bucket, key in singles:
            slot = next(free)
            self.seeds[bucket] = -slot - 1
            self.keys[slot], self.values[slot] = key, table[key]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.values[slot] if self.keys[slot] == key else None


def unknown_letters() -> dict[int, int]:
    """Letters and numbers that the regular expressions here know and those of tiktoken don't, each with the stand-in U+FFFF, which
    neither takes for one. Both libraries are asked about every code point, so the table is that of the versions installed."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single, found = {bytes([b]): b for b in range(256)}, {}
    for kind in (r"\p{L}", r"\p{N}"):
        theirs = set(bytes(tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        found |= {ord(c): 0xFFFF for c in set(regex.findall(kind, every)) - theirs}
    return found


class BytePairCoder:
    """Encodes by merge ranks and decodes. Texts are split by ``pattern``, with the letters and numbers that tiktoken knows; no string
    is special. units: whether no match of the pattern crosses the places where units.py cuts, as with the usual patterns, where
    a space, line feed or mark begins a match; if not, every text is encoded whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, units: bool = False):
        self.table = PerfectHash(ranks)
        self.pattern, self.by_units = pattern, units
        self.token_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_of[rank] = token
        # Pairs of ids that may merge, by what they give: every way to split a token into two tokens.
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left, right] = rank
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.stand_in = unknown_letters()
        self._units = self._find = self._odd = None

    def __getstate__(self):
        return self.__dict__ | {"_units": None, "_find": None, "_odd": None}

    def _words(self, text: str) -> list[str]:
        """The text's pre-tokens. Where it has letters of the table, matches are found with the stand-in in their place."""
        if self._find is None:
            self._find = regex.compile(self.pattern)
            self._odd = frozenset(map(chr, self.stand_in))
        if not text.isascii() and not self._odd.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self._find.finditer(text.translate(self.stand_in))]
        return self._find.findall(text)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word that is no token: its bytes are a linked list, and a heap yields the pair of lowest rank, the
        leftmost of equal ones. An entry is one number, rank and place; it is passed over where the pair there has another
        rank by now. Numbers in arrays keep a word of n bytes at about 70 n bytes of memory."""
        try:
            ids = array("q", [self.single[b] for b in word])
        except TypeError:
            raise ValueError(f"the vocabulary lacks the byte {next(b for b in word if self.single[b] is None)}") from None
        n, merged = len(ids), self.merged
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        after[n - 1] = -1
        heap = [r << 40 | i for i in range(n - 1) if (r := merged.get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0 or merged.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := merged.get((rank, ids[k]))) is not None:
                    heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0 and (r := merged.get((ids[h], rank))) is not None:
                heappush(heap, r << 40 | h)
        return [x for x in ids if x >= 0]

    def encode_text(self, text: str) -> list[int]:
        """Ids of a text, by its pre-tokens."""
        out: list[int] = []
        for word in self._words(text):
            raw = word.encode()
            whole = self.table.get(raw)
            if whole is not None:
                out.append(whole)
            else:
                out += self.merge(raw)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and where each text's begin (one more at the end). With ``units``, texts are cut into units that no
        pre-token crosses, and a unit met before is not encoded again."""
        if not self.by_units:
            each = [np.array(self.encode_text(t), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        if self._units is None:
            self._units = UnitCoder(lambda units: [np.array(self.encode_text(u), "<u4").tobytes() for u in units])
        ids, starts, _, _ = self._units.ids(texts)
        return ids, starts

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, coder: BytePairCoder, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, token count, SHA-256 of the ids (little-endian, 32 bits) and of the bytes they
    decode to; with ``keep_ids`` also the ids (array of int) and the decoded text.

    The coder (bounded by the vocabulary) is broadcast; rows stay where they were read. A batch holds about 2 MB of text;
    a longer text stands alone and is encoded whole, cut only where no token can cross. A null text counts as empty: no
    ids, the hashes of no bytes. A null id stays null, repeated rows are encoded each, other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in by_bytes(batches, "text", 2 << 20):
            ids, starts = coder.encode(texts_of(batch))
            coded, plain, lists, texts = [], [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                raw = coder.decode(ids[a:b])
                coded.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                plain.append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    lists.append(ids[a:b].astype(np.int32))
                    texts.append(raw.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>, decoded string" * keep_ids)
