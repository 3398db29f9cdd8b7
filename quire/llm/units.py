"""Texts cut into units that a word tokenizer encodes apart, each different unit encoded once.

A unit ends where no token can cross, whatever stands on either side: before a space or line feed that follows something
else than white space, before a punctuation mark of ASCII that follows a letter, and before a full stop, comma or such of
Chinese and Japanese that follows an ideograph. Texts of any length are so split at safe places, found by numpy over the
UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from quire.llm.batches import ragged
from quire.llm.words import BYTE, HALF, ODD, SLICE, mix, place_numbers, raw

#: By byte: ASCII letters; ASCII punctuation; bytes after which a space or line feed never begins a unit.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
BLANK = np.zeros(256, bool)
BLANK[[*range(0, 33), 127]] = True
#: Bytes before a cut at which a slice must look.
BACK = 3


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a unit may begin at each byte but the first."""
    b, prev = data[1:], data[:-1]
    prev2 = np.concatenate((np.zeros(1, np.uint8), data[:-2]))
    prev3 = np.concatenate((np.zeros(2, np.uint8), data[:-3])) if len(data) > 2 else np.zeros(len(prev), np.uint8)
    wide = prev >= 128
    # a space of more than one byte may end there: C2 85, C2 A0, and all that begin with E1, E2 or E3
    odd = wide & (((prev2 == 0xC2) & ((prev == 0x85) | (prev == 0xA0))) | ((prev3 >= 0xE1) & (prev3 <= 0xE3)))
    after_text = ~BLANK[prev] & ~odd
    # letters of two bytes: C3 80 to C5 BF but the signs of times and division, and I with a dot, which becomes two characters in
    # lower case, the second of them a mark
    after_letter = LETTER[prev] | (wide & (prev2 >= 0xC3) & (prev2 <= 0xC5) & ~((prev2 == 0xC3) & ((prev == 0x97) | (prev == 0xB7)) | (prev2 == 0xC4) & (prev == 0xB0)))
    out = ((b == 32) | (b == 10)) & after_text | MARK[b] & after_letter
    if len(data) > 5 and (some := np.flatnonzero((b == 0xE3) | (b == 0xEF))).size:
        some = some[(some >= 2) & (some + 3 < len(data))]
        x, y, z = data[some + 1], data[some + 2], data[some + 3]
        mark = (x == 0xE3) & (y == 0x80) & ((z == 0x81) | (z == 0x82)) | (x == 0xEF) & (y == 0xBC) & np.isin(z, (0x81, 0x8C, 0x9A, 0x9B, 0x9F))
        # ideographs: E4 B8 80 to E9 BE BF
        lead, second = prev3[some], prev2[some]
        out[some] |= mark & ((lead == 0xE4) & (second >= 0xB8) | (lead >= 0xE5) & (lead <= 0xE8) | (lead == 0xE9) & (second <= 0xBE))
    return out


#: As words.BYTE, but with capitals of their own.
EXACT = BYTE.copy()
EXACT[65:91] = np.random.default_rng(7).integers(0, 1 << 63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Pool:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.zeros(max(need, self.n + (self.n >> 1)) - self.n, self.data.dtype)))
        self.data[self.n : need] = values
        self.n = need


class UnitCoder:
    """Codes units by ``encode`` (texts to bytes, 4 for each code) and remembers what it coded: units are found by a hash, and their
    bytes are compared, so equal codes are those of equal units. fold: units that differ in A-Z only, or in one space or
    line feed before them, have the same codes. special: strings that ``encode`` takes as one token; they are never cut. Units
    of more than ``longest`` bytes are not remembered, and all is forgotten when what is held exceeds ``most`` bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], fold: bool = False, special: tuple[str, ...] = (), most: int = 96 << 20, longest: int = 512):
        self.encode, self.fold, self.special, self.most, self.longest = encode, fold, [s.encode() for s in special], most, longest
        self.forget()

    def forget(self) -> None:
        """hashes rise, entry tells whose they are. An entry's bytes and codes lie in two pools, from its starts on."""
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.text, self.codes = Pool(np.uint8), Pool("<u4")
        self.text_at, self.text_n, self.code_at, self.code_n = Pool(np.int64), Pool(np.int32), Pool(np.int64), Pool(np.int32)

    @property
    def held(self) -> int:
        return 36 * len(self.hashes) + self.text.n + 4 * self.codes.n

    def _begins(self, data: np.ndarray, blob: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where every unit begins (every text begins one), and where special strings do."""
        first, whole = np.zeros(len(data), bool), []
        for lo in range(0, len(data), SLICE):
            hi = min(len(data), lo + SLICE)
            back = max(0, lo - BACK)
            found = cuts(data[back : min(len(data), hi + BACK)])
            first[max(lo, 1) : hi] = found[max(lo, 1) - back - 1 : hi - back - 1]
        for string in self.special:
            at = blob.find(string)
            while at >= 0:
                first[at + 1 : at + len(string)] = False
                whole.append(at)
                at = blob.find(string, at + len(string))
        first[ends[:-1][ends[:-1] < len(data)]] = True
        return np.flatnonzero(first), np.array(whole, np.int64)

    def _hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of every unit, worked out some megabytes at a time. Each byte at each place has its own random number."""
        table, size, out = BYTE if self.fold else EXACT, stop - start, np.zeros(len(start), np.uint64)
        bounds = np.searchsorted(start, np.arange(0, len(data) + SLICE + 1, SLICE)) if len(start) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            lo, hi = int(start[a]), int(stop[b - 1])
            mark = np.zeros(hi - lo + 1, np.int64)  # a unit of one blank that doesn't count is empty, and may begin at the end
            mark[start[a:b] - lo] = start[a:b] - lo
            within = np.arange(hi - lo) - np.maximum.accumulate(mark)[:-1]
            value = table[data[lo:hi]]
            value ^= place_numbers(int(within.max(initial=0)) + 1)[within]
            value *= ODD
            value ^= value >> HALF
            # the space before the next unit is left out where that doesn't count
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
            out[a:b] = mix(total[stop[a:b] - lo] - total[start[a:b] - lo] + size[a:b].astype(np.uint64))
        return out

    def _coded(self, units: np.ndarray, start: np.ndarray, stop: np.ndarray, blob: bytes) -> list[bytes]:
        out: list[bytes] = []
        at, ends = 0, np.cumsum(stop[units] - start[units])
        while at < len(units):
            upto = max(at + 1, min(at + 4096, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right"))))
            some = units[at:upto]
            out += self.encode([blob[a:b].decode() for a, b in zip(start[some].tolist(), stop[some].tolist())])
            at = upto
        return out

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All codes in turn, how many each unit has, where each text's units begin (one more at the end), each unit's last byte."""
        data, ends = raw(texts)
        blob = data.tobytes()
        begin, whole = self._begins(data, blob, ends)
        stop = np.append(begin[1:], len(data))
        start = begin + ((data[begin] == 32) | (data[begin] == 10)) if self.fold and len(begin) else begin
        plain = np.frombuffer(blob.lower(), np.uint8) if self.fold else data
        size = stop - start
        hashes = self._hashes(data, start, stop)
        apart = size > self.longest
        apart[np.searchsorted(begin, whole, "right") - 1] = True  # a special string isn't the same in other letters
        if self.held > self.most:
            self.forget()
        # the first of each hash that is new becomes an entry
        usual = np.flatnonzero(~apart)
        different, first = np.unique(hashes[usual], return_index=True)
        at = np.searchsorted(self.hashes, different)
        known = np.zeros(len(different), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == different
        new = usual[first[~known]]
        if len(new):
            coded = self._coded(new, start, stop, blob)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            base = self.text_at.n
            self.text_at.add(self.text.n + np.cumsum(size[new]) - size[new])
            self.code_at.add(self.codes.n + np.cumsum(sizes) - sizes)
            self.text.add(plain[ragged(start[new], size[new])])
            self.codes.add(np.frombuffer(b"".join(coded), "<u4"))
            self.text_n.add(size[new])
            self.code_n.add(sizes)
            self.hashes = np.insert(self.hashes, at[~known], different[~known])
            self.entry = np.insert(self.entry, at[~known], base + np.arange(len(new)))
        entry = self.entry[np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))] if len(self.hashes) else np.zeros(len(hashes), np.int32)
        # whose bytes differ from the entry's are coded by themselves
        if len(self.hashes):
            apart |= self.text_n.data[entry] != size
            same = np.flatnonzero(~apart)
            n = size[same]
            mine = plain if not self.fold and len(same) == len(size) else plain[ragged(start[same], n)]
            differ = np.flatnonzero(mine != self.text.data[ragged(self.text_at.data[entry[same]], n)])
            apart[same[np.searchsorted(np.cumsum(n), differ, "right")]] = True
        counts = self.code_n.data[entry].astype(np.int64) if len(entry) else np.zeros(0, np.int64)
        lone = np.flatnonzero(apart)
        if not len(lone):
            return self.codes.data[ragged(self.code_at.data[entry], counts)] if len(entry) else np.zeros(0, "<u4"), counts, np.searchsorted(begin, ends, "left"), data[stop - 1] if len(begin) else data[:0]
        own = self._coded(lone, start, stop, blob)
        counts[lone] = np.fromiter(map(len, own), np.int64, len(own)) // 4
        after = np.cumsum(counts)
        flat, rest = np.zeros(int(after[-1]), "<u4"), np.flatnonzero(~apart)
        flat[ragged(after[rest] - counts[rest], counts[rest])] = self.codes.data[ragged(self.code_at.data[entry[rest]], counts[rest])]
        flat[ragged(after[lone] - counts[lone], counts[lone])] = np.frombuffer(b"".join(own), "<u4")
        return flat, counts, np.searchsorted(begin, ends, "left"), data[stop - 1]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All codes in turn, where each text's begin (one more at the end), the place after each unit's codes, and each
        unit's last byte."""
        flat, counts, begin, last = self.code(texts)
        after = np.cumsum(counts)
        return flat, np.concatenate((np.zeros(1, np.int64), after))[begin], after, last
