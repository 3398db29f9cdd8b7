"""Suffix-array dedup: sparse suffixes at minimiser positions, sorted; neighbours are compared and extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.batches import by_bytes, texts_of
from quire.llm.hot_keys import MOST_HOT
from quire.llm.ngram_join import filter_bits, key_filter
from quire.llm.words import mix, runs, runs_at, then, word_hashes
from quire.shared import Scratch

#: Words of a minimiser's k-gram, and k-grams of a window of which the least is retained.
GRAM, WINDOW = 5, 20
#: Rows of sorted suffixes that are compared at a time.
BLOCK = 1 << 16
#: Suffixes of one key up to which one task compares them (below BLOCK); of a more frequent key, Spark groups the windows.
HOT = 1 << 13
ROW = "key long, doc_id long, pos int, last int, before binary, after binary"


class Lengths:
    """A match of ``least`` words holds a retained suffix among its first WINDOW places, so at least ``head`` words of that suffix
    belong to it; the ``side`` other words stand before or after the head."""

    def __init__(self, least: int):
        if least < GRAM + WINDOW:
            raise ValueError(f"at least {GRAM + WINDOW} words")
        self.least, self.head, self.side = least, least - WINDOW + 1, WINDOW - 1


def minimisers(words: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place from which WINDOW k-grams of one text stand in a row, the place of the least of them (the first of equal ones)."""
    grams = runs(words, GRAM)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = (grams & ~np.uint64(0xFFFFFFF)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(0xFFFFFFF))
    low, width = rank, 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[WINDOW - width : WINDOW - width + n])
    at = np.arange(n)
    text = np.searchsorted(starts[1:], at, "right")
    end = starts[1:][np.minimum(text, len(starts) - 2)]
    inside = (at + WINDOW + GRAM - 1 <= end) & (end - starts[:-1][np.minimum(text, len(starts) - 2)] >= least)
    at, low = at[inside], low[inside]
    place = (at & ~0xFFFFFFF) | (low & np.uint64(0xFFFFFFF)).astype(np.int64)
    place[place < at] += 0x10000000
    return at, place


def _suffixes(words: np.ndarray, starts: np.ndarray, lengths: Lengths):
    """(text, place, key) of the retained suffixes; key: a hash of their first words. Then (start, suffix) of all windows of
    ``least`` words; suffix: the number of the retained suffix that is the least in it, so equal windows have it in the same place."""
    at, chosen = minimisers(words, starts, lengths.least)
    place = np.unique(chosen)
    text = np.searchsorted(starts[1:], place, "right")
    fits = place + lengths.head <= starts[1:][text] if len(place) else np.zeros(0, bool)
    place, text = place[fits], text[fits]
    key = runs_at(words, place, lengths.head)
    whole = at + lengths.least <= starts[1:][np.searchsorted(starts[1:], at, "right")] if len(at) else np.zeros(0, bool)
    return text, place, key, at[whole], np.searchsorted(place, chosen[whole])


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Whether each value is one of the rising ones."""
    if not len(rising):
        return np.zeros(len(values), bool)
    return rising[np.minimum(np.searchsorted(rising, values), len(rising) - 1)] == values


def _windows(words: np.ndarray, at: np.ndarray, text: np.ndarray, least: int):
    """(text, first, last, hash) of the windows from ``at`` on. Equal windows of one text that touch or overlap, as in a phrase that
    is repeated over and over, are one row with their first and last places."""
    window = runs_at(words, at, least)
    order = np.lexsort((at, window, text))
    at, text, window = at[order], text[order], window[order]
    alike = (text[1:] == text[:-1]) & (window[1:] == window[:-1]) & (at[1:] - at[:-1] <= least)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), ~alike)))
    last = np.append(first[1:] - 1, len(at) - 1) if len(at) else first
    order = np.lexsort((at[first], text[first]))
    first, last = first[order], last[order]
    return text[first], at[first], at[last], window[first]


def _context(short: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, step: int, n: int) -> np.ndarray:
    """The n words from ``place`` on in steps of 1 or -1, as 32-bit numbers; beyond the text's ends, numbers of the text's own."""
    at = place[:, None] + step * np.arange(n)
    inside = (at >= low[:, None]) & (at < high[:, None])
    own = (mix(ids.astype(np.uint64)[:, None] * np.uint64(131) + np.arange(n, dtype=np.uint64) + np.uint64(step & 1023)) >> np.uint64(32)).astype(np.uint32)
    return np.where(inside, short[np.clip(at, 0, len(short) - 1)], own).astype(">u4")


def _merged(text, place, key, before, after) -> tuple[np.ndarray, np.ndarray]:
    """First and last rows of stretches of suffixes of one text that are alike in key and context, as within a word or phrase
    that is repeated over and over: what matches one matches all, so one row stands for them."""
    alike = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (place[1:] - place[:-1] <= WINDOW)
    at = np.flatnonzero(alike)
    alike[at] = (before[at] == before[at + 1]).all(1) & (after[at] == after[at + 1]).all(1)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), ~alike)))
    return first, np.append(first[1:] - 1, len(key) - 1) if len(key) else first


def _matches(key, doc, pos, last, before, after, lengths: Lengths):
    """Per suffix (or stretch of them, from pos to last) the words [start, end) that it shares with other documents, and the least such
    document. A match reaches some l words to the left of the head and ``side`` - l to the right at least: for each l the
    suffixes so extended are sorted, and equal ones are neighbours. All windows of ``least`` words that a suffix shares are so
    found, and together they reach as far as its matches do."""
    n, side = len(key), lengths.side
    start, end = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    other = np.full(n, np.iinfo(np.int64).max)
    right = [np.zeros(n, np.uint64)]
    for i in range(side):
        right.append(then(right[-1], after[:, i].astype(np.uint64)))
    left = key.view(np.uint64)
    for l in range(side + 1):
        if l:
            left = then(left, before[:, l - 1].astype(np.uint64))
        window = then(mix(left), right[side - l])
        order = np.lexsort((doc, window))
        w, d = window[order], doc[order]
        new = np.concatenate((np.ones(min(1, n), bool), w[1:] != w[:-1]))
        group, least = np.cumsum(new) - 1, d[new]
        # the second document of each group that has one
        change = np.flatnonzero(~new[1:] & (d[1:] != d[:-1])) + 1
        found, at = np.unique(group[change], return_index=True)
        second = np.full(len(least), -1)
        second[found] = d[change[at]]
        both = np.zeros(len(least), bool)
        both[found] = True
        row, group = order[both[group]], group[both[group]]
        start[row] = np.minimum(start[row], pos[row] - l)
        end[row] = np.maximum(end[row], last[row] + lengths.head + side - l)
        other[row] = np.minimum(other[row], np.where(doc[row] == least[group], second[group], least[group]))
    return start, end, other


def _shared_windows(rows: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(doc_id, s, e, other) of the windows (rows of key, doc_id, pos, last) that stand in more than one document; other: the least other one.
    Spark counts them by partial sums. Windows that are very frequent again (at most some 1,000,000) are looked up by broadcast,
    so no task holds all rows of a window."""
    windows = rows.select(F.col("key").alias("w"), "doc_id", F.col("pos").cast("long").alias("s"), (F.col("last").cast("long") + least).alias("e"))
    groups = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    groups = scratch.write(groups.where("a < z").drop("z"), "groups")
    many = max(HOT, (groups.agg(F.sum("n")).first()[0] or 0) >> 20)

    def joined(groups: DataFrame) -> DataFrame:
        large = groups.where(F.col("n") > many)
        rest = windows.join(F.broadcast(large.select("w")), "w", "left_anti").join(groups.where(F.col("n") <= many), "w")
        return windows.join(F.broadcast(large), "w").unionByName(rest)

    second = joined(groups).where("doc_id <> a").groupBy("w").agg(F.min("doc_id").alias("b"))
    groups = scratch.write(groups.join(second, "w"), "pairs")

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that overlap or touch the one before and have the same other document go into one."""
        for batch in batches:
            doc, s, e, other = (c.to_numpy() for c in batch.columns)
            on = (doc[1:] == doc[:-1]) & (other[1:] == other[:-1]) & (s[1:] >= s[:-1]) & (s[1:] <= e[:-1])
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), ~on)))
            most = np.maximum.reduceat(e, first) if len(first) else e
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(s[first]), pa.array(most), pa.array(other[first])], ["doc_id", "s", "e", "other"])

    other = F.when(F.col("doc_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")
    return joined(groups).select("doc_id", "s", "e", other).mapInArrow(joint, "doc_id long, s long, e long, other long")


def repeated_spans(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages of ``least`` words and more that stand in more than one document: one row per document and passage, with
    doc_id, start_word, end_word (exclusive; words are what ASCII white space parts, A-Z counts as a-z), n_words, other_id
    (the least id found of a document that shares some of it) and duplicate (whether other_id is less than doc_id, so that this is
    not the copy to keep). Overlapping matches of a document are one passage. Documents that share nothing have no row.

    Every text of any length is read whole, twice. First only keys of the retained suffixes are counted, one for about ten
    words; keys that occur twice set bits in a filter (sized by their count, 128 MB at most). Then the suffixes that pass are sent, by key, with the
    words around them. Of a key with very many suffixes (more than HOT, and so many that there are never more than MOST_HOT such keys), the windows of ``least`` words are sent instead, each by a hash of its
    own, so that no task owns the key and every match is found at any count.
    Null, empty and shorter texts have no rows. Rows of the same id are one document; rows with a null id are left out, as
    nothing could refer to them.
    """
    lengths, spark = Lengths(least), docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            key = _suffixes(*word_hashes(texts_of(batch)), lengths)[2]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    scratch, seen = Scratch(spark, "repeats"), Observation()
    twice = docs.mapInArrow(count, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    twice = scratch.write(twice.observe(seen, F.count("*").alias("keys"), F.sum("n").alias("n")), "keys")
    size = min(30, filter_bits(seen.get["keys"] or 0) + 3)  # a suffix that passes by chance costs more than its bits
    # so many suffixes that a key has a place in the list of the frequent ones: there are at most MOST_HOT of them
    many = max(HOT, (seen.get["n"] or 0) // MOST_HOT)
    hot = twice.where(F.col("n") > many).select("key").toPandas()["key"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((key_filter(twice.select(F.pmod("key", F.lit(1 << size)).alias("h")), size), np.sort(hot.view(np.uint64))))
    scratch.drop("keys")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent = shared.value
        for batch in by_bytes(batches, "text"):
            words, starts = word_hashes(texts_of(batch))
            text, place, key, at, least_suffix = _suffixes(words, starts, lengths)
            every = batch.column("doc_id").to_numpy(zero_copy_only=False)
            often = _among(key, frequent)
            if often.any():
                at, owner = at[often[least_suffix]], text[least_suffix[often[least_suffix]]]
                owner, first, last, window = _windows(words, at, owner, lengths.least)
                none, low = pa.nulls(len(window), pa.binary()), starts[:-1][owner]
                yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(every[owner]), pa.array((first - low).astype(np.int32)), pa.array((last - low).astype(np.int32)), none, none], ["key", "doc_id", "pos", "last", "before", "after"])
            h = (key & np.uint64(8 * len(bits) - 1)).astype(np.int64)
            ok = bits[h >> 3] >> (h & 7).astype(np.uint8) & 1 == 1
            ok &= ~often
            text, place, key = text[ok], place[ok], key[ok]
            ids = every[text]
            short = (words >> np.uint64(32)).astype(np.uint32)
            low, high = starts[:-1][text], starts[1:][text]
            size = 4 * lengths.side
            before, after = _context(short, place - 1, low, high, ids, -1, lengths.side), _context(short, place + lengths.head, low, high, ids, 1, lengths.side)
            first, last = _merged(text, place, key, before, after)
            key, ids, start, stop = key[first], ids[first], (place - low)[first], (place - low)[last]
            sides = []
            for m in (before[first], after[first]):
                sides.append(pc.cast(pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(m), [None, pa.py_buffer(m.tobytes())]), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), *sides], ["key", "doc_id", "pos", "last", "before", "after"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            key, doc, pos, last = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "doc_id", "pos", "last"))
            before, after = (np.frombuffer(b"".join(rows.column(c).to_pylist()), ">u4").reshape(-1, lengths.side) for c in ("before", "after"))
            start, end, other = _matches(key, doc, pos, last, before, after, lengths)
            ok = end > 0
            return pa.RecordBatch.from_arrays([pa.array(doc[ok]), pa.array(start[ok]), pa.array(end[ok]), pa.array(other[ok])], ["doc_id", "s", "e", "other"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                cut = len(key) - int((key == key[-1]).sum())
                if cut:
                    yield done(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    rows, wide = docs.mapInArrow(collect, ROW), None
    if len(hot):
        rows = scratch.write(rows, "suffixes")
        wide = _shared_windows(rows.where("before is null"), lengths.least, scratch)
        rows = rows.where("before is not null")
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "doc_id long, s long, e long, other long")
    if wide is not None:
        found = found.unionByName(wide)
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    found = found.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("span", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = found.groupBy("doc_id", "span").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("other").alias("other_id"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id", (F.col("other_id") < F.col("doc_id")).alias("duplicate"))
