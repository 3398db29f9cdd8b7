"""Ranked lexical search: every item of a query table against all documents, over an inverted index of segments.

A segment is a run of documents with the postings of the terms that are asked for. Within a segment the lists of an item are searched
in two ways: the short ones term at a time, into accumulators, which are then one more rising list with a greatest score;
the long ones, and that list, document at a time in blocks, where what cannot reach the k best is skipped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.batches import by_bytes, texts_of
from quire.llm.words import PUNCTUATION, word_hashes
from quire.shared import Scratch

#: Text bytes of a segment and of what is read at a time; documents of a block; bytes of items that are searched for at a time.
SEGMENT, BATCH, BLOCK, ITEM_BYTES = 24 << 20, 4 << 20, 2048, 16 << 20
#: Short lists have so many postings together, as a share of the segment's documents.
SHORT = 0.25
#: Parts in which the candidates of an item meet before they meet as a whole.
PARTS = 16
INDEX = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<int>, ends array<long>, docs array<int>, tf array<long>"


def distinct_terms(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's different terms: the longest runs of letters, digits and all that is no ASCII, A-Z as a-z."""
    hashes, starts = word_hashes(texts, PUNCTUATION)
    return [np.unique(hashes[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


class _Writer:
    """Gathers documents into segments: for each term the documents (by number) that hold it, rising, and how often."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.bytes, self.ids, self.sizes, self.n, self.keys, self.counts = 0, [], [], 0, [], []

    def add(self, ids: pa.Array, texts: pa.Array, size: int) -> None:
        hashes, starts = word_hashes(texts, PUNCTUATION)
        sizes = np.diff(starts)
        doc = np.repeat(np.arange(len(sizes)) + self.n, sizes)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        asked = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        key, count = np.unique(at[asked] << 40 | doc[asked], return_counts=True)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.keys.append(key)
        self.counts.append(count)
        self.n += len(sizes)
        self.bytes += size

    def segment(self) -> pa.RecordBatch:
        sizes, keys = np.concatenate(self.sizes), np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")  # a document's text stands in one batch, so keys are different
        keys, counts = keys[order], np.concatenate(self.counts)[order]
        term, first = np.unique(keys >> 40, return_index=True)
        row = [int((sizes > 0).sum()), int(sizes.sum()), pa.chunked_array(self.ids).to_pylist(), sizes, term, np.append(first[1:], len(keys))[: len(term)], keys & 0xFFFFFFFFFF, counts]
        self.clear()
        kinds = [pa.int64(), pa.int64(), *map(pa.list_, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["n_docs", "n_terms", "ids", "sizes", "terms", "ends", "docs", "tf"])


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Segments of ``docs`` (doc_id, text) with the postings of the terms in ``vocabulary`` (rising hashes, which are broadcast)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(shared.value)
        for batch in by_bytes(batches, "text", BATCH):
            texts = texts_of(batch)
            writer.add(batch.column("doc_id"), texts, texts.nbytes)
            if writer.bytes >= SEGMENT:
                yield writer.segment()
        if writer.n:
            yield writer.segment()

    return docs.mapInArrow(run, INDEX)


class Weights:
    """What ranks documents: N, the documents with a term at least; L, their terms; w of each term."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def length_part(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents of so many terms, in whole numbers of any size."""
        if int(sizes.max(initial=0)) * 50 * self.n_docs >= 1 << 62:
            return np.array([50 + 50 * n * self.n_docs // max(1, self.n_terms) for n in sizes.tolist()], np.int64)
        return 50 + 50 * sizes * self.n_docs // max(1, self.n_terms)


class Best:
    """The k best documents of an item so far: by score, then by id (a null id first)."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """Documents with a smaller score are of no use."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), np.concatenate((self.known, known))
        order = np.lexsort((ids, known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


class Segment:
    """A segment with the impact of each posting, and the greatest impact of each list in each block of documents."""

    def __init__(self, row: dict, weights: Weights):
        ids = row["ids"]
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(np.iinfo(np.int64).min))
        self.terms, self.docs, tf = (np.asarray(row[c]) for c in ("terms", "docs", "tf"))
        self.n = len(self.ids)
        m = weights.length_part(np.asarray(row["sizes"]))
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])
        ends = np.asarray(row["ends"])
        self.blocks = max(1, -(-self.n // BLOCK))
        # where each block of each list begins: lists one after the other, one place more at the end
        lists = np.repeat(np.arange(len(self.terms)), np.diff(ends, prepend=0))
        cell = lists * self.blocks + self.docs // BLOCK
        self.at = np.searchsorted(cell, np.arange(len(self.terms) * self.blocks + 1))
        some, first = np.unique(cell, return_index=True)
        most = np.zeros(len(self.terms) * self.blocks, np.int64)
        if len(some):
            most[some] = np.maximum.reduceat(self.impact, first)
        self.most = most.reshape(len(self.terms), self.blocks)

    def lists_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms have a list here, and its number."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        here = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, np.int64)
        return here, at[here]

    def part(self, number: int, block: int) -> slice:
        cell = number * self.blocks + block
        return slice(self.at[cell], self.at[cell + 1])


def search(segment: Segment, terms: np.ndarray, w: np.ndarray, best: Best) -> None:
    """Adds the documents of a segment that belong to the ``best`` for an item of these terms, each with its weight.

    The short lists are summed into accumulators (documents rising, with their scores). Blocks come by falling upper bound: what the
    accumulators and each long list give there at most. In a block the lists are taken by falling bound. While what the rest
    can give reaches the least useful score by itself, documents come from each list in turn; after that the rest is looked up, only
    for documents that can still reach it."""
    here, lists = segment.lists_of(terms)
    w = w[here]
    lists, w = lists[w > 0], w[w > 0]
    if not len(lists):
        return
    size = segment.at[(lists + 1) * segment.blocks] - segment.at[lists * segment.blocks]
    order = np.argsort(size, kind="stable")
    lists, w, size = lists[order], w[order], size[order]
    n_short = int(np.searchsorted(np.cumsum(size), SHORT * segment.n, "right"))
    # term at a time: the short lists
    spans = [slice(segment.at[x * segment.blocks], segment.at[(x + 1) * segment.blocks]) for x in lists[:n_short].tolist()]
    docs = np.concatenate([np.zeros(0, np.int32), *(segment.docs[s] for s in spans)])
    score = np.concatenate([np.zeros(0, np.int64), *(segment.impact[s] * x for s, x in zip(spans, w.tolist()))])
    order = np.argsort(docs, kind="stable")
    docs, score = docs[order], score[order]
    held, first = np.unique(docs, return_index=True)
    summed = np.add.reduceat(score, first) if len(first) else score
    cuts = np.searchsorted(held, np.arange(segment.blocks + 1) * BLOCK)
    # document at a time: the long lists and the accumulators, which are list number 0
    lists, w = lists[n_short:], w[n_short:]
    bounds = np.zeros((1 + len(lists), segment.blocks), np.int64)
    bounds[1:] = segment.most[lists] * w[:, None]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        bounds[0, b] = summed[cuts[b] : cuts[b + 1]].max()
    total = bounds.sum(0)
    for b in np.argsort(-total, kind="stable").tolist():
        if total[b] < best.least:
            break
        base = b * BLOCK
        found, seen = np.zeros(min(BLOCK, segment.n - base), np.int64), None
        rest = int(total[b])
        for x in np.argsort(-bounds[:, b], kind="stable").tolist():
            bound = int(bounds[x, b])
            if not bound:
                break
            if x:
                s = segment.part(int(lists[x - 1]), b)
                docs, score, times = segment.docs[s], segment.impact[s], int(w[x - 1])
            else:
                docs, score, times = held[cuts[b] : cuts[b + 1]], summed[cuts[b] : cuts[b + 1]], 1
            if seen is None and rest < best.least:
                seen = np.flatnonzero(found)  # a document that no list so far holds can't reach it
            if seen is None:
                found[docs - base] += score * times
            else:
                seen = seen[found[seen] + rest >= best.least]
                if not len(seen):
                    break
                if 8 * len(seen) < len(docs):  # skip to the documents that still count
                    at = np.minimum(np.searchsorted(docs, seen + base), len(docs) - 1)
                    hit = docs[at] == seen + base
                    found[seen[hit]] += score[at[hit]] * times
                else:
                    found[docs - base] += score * times
            rest -= bound
        good = np.flatnonzero(found >= best.least) if seen is None else seen[found[seen] >= best.least]
        if len(good):
            best.add(found[good], segment.ids[good + base], segment.known[good + base])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k documents with the highest scores above 0 for each row of ``items``: item_id, rank (from 1), doc_id, score.

    Terms are the longest runs of letters, digits and all that is no ASCII in the whole text, A-Z lower-cased. With N documents that
    have a term, L terms in them, n in a document, df documents that hold a term and tf its places in one, a term weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and a document's score sums w * ((10^9 tf) div (1000 tf + 20 m))
    over the item's different terms. Equal scores come by rising id (a null id first), so ranks are defined; rows that repeat an
    id and text are ranked each, in any order among them.

    Null and empty texts have no terms: they are in no result and in no count; such items have no rows, nor has an empty table of either
    kind. An item row that repeats another has its own rows. Other columns are never read. Terms are compared by 64-bit hashes.

    How: items are taken some 16 MB of text at a time (a hash of their rows tells which), so what is broadcast is bounded. For
    each such part the documents are read once into segments, written to the shared folder; N, L and df are sums over these. Then
    every task searches its segments for all items of the part and sends the k best of each, which meet in parts and then by item.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical-search")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_BYTES))
    found = None
    for p in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        rows = mine.toArrow()  # bounded: see above
        terms = distinct_terms(pa.chunked_array(rows.column("text")).cast(pa.large_string()).combine_chunks()) if rows.num_rows else []
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
        index = scratch.write(build_index(docs, vocabulary), f"index-{p}")
        sums = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        lengths = index.select(F.explode(F.arrays_zip("terms", F.expr("transform(ends, (e, i) -> e - if(i = 0, 0L, ends[i - 1]))").alias("n"))).alias("t"))
        df = np.zeros(len(vocabulary), np.int64)
        for row in lengths.groupBy("t.terms").agg(F.sum("t.n").alias("n")).toLocalIterator():  # at most one for each term asked for
            df[row.terms] = row.n
        weights = Weights(sums[0] or 0, sums[1] or 0, df)
        asked = [np.searchsorted(vocabulary, t) for t in terms]
        queries = [(item, a, weights.w[a]) for item, a in zip(rows.column("item_id").to_pylist(), asked)]
        shared = spark.sparkContext.broadcast((weights, queries))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, queries = shared.value
            best = [Best(k) for _ in queries]
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment({c: batch.column(c)[i].values for c in ("ids", "sizes", "terms", "ends", "docs", "tf")}, weights)
                    for (_, terms, w), b in zip(queries, best):
                        search(segment, terms, w, b)
            for number, ((item, _, _), b) in enumerate(zip(queries, best)):
                if len(b.scores):
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(b.scores), pa.int64()), pa.array([item] * len(b.scores), pa.int64()), pa.array(b.ids, mask=~b.known), pa.array(b.scores)], ["query", "item_id", "doc_id", "score"])

        part = index.mapInArrow(run, "query long, item_id long, doc_id long, score long").withColumn("query", F.col("query") * parts + p)
        found = part if found is None else found.unionByName(part)
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order))).where(F.col("place") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
