"""Packing: token sequences of bounded length, cut at document or sentence ends by dynamic programming."""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import by_bytes, ragged, texts_of
from quire.llm.token_count import cuttable
from quire.llm.units import UnitCoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What a cut costs, in padding tokens: after a document, after a sentence, elsewhere at a word's end.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE = 0, 8, 48
#: A cut elsewhere may be at the first word end of each so many tokens.
STEP = 32
#: Tokens that are planned together; the last window of a plan is taken on into the next one.
PLANNED = 1 << 19
#: By byte: what a sentence ends with.
CLOSING = np.zeros(256, bool)
CLOSING[list(b".!?:\n")] = True
#: Bytes of units that a worker remembers; they stay with it when other stages run there.
CODER_BYTES = 48 << 20
_loaded: dict[str, UnitCoder] = {}


def _coder(path: str) -> UnitCoder:
    """A tokenizer file's coder of units; loaded once in each Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        if not cuttable(model):
            raise ValueError(f"{path} does not split texts into words first")
        model.no_truncation()
        model.no_padding()
        encode = lambda units: [np.array(x.ids, "<u4").tobytes() for x in model.encode_batch_fast(units, add_special_tokens=False)]
        lower = any(x.get("type") == "Lowercase" for x in ((json.loads(model.to_str())["normalizer"] or {}).get("normalizers") or []))
        _loaded[path] = UnitCoder(encode, fold=lower, special=tuple(x.content for x in model.get_added_tokens_decoder().values()), most=CODER_BYTES)
    return _loaded[path]


def tokenize(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids in turn, where each text's begin (one more at the end), where cuts may be (places after an id, rising), and
    whether a sentence ends there."""
    ids, starts, after, last = _coder(path).ids(texts)
    sentence = CLOSING[last]
    word = np.zeros(len(after), bool)
    if len(after):
        word[1:] = after[1:] // STEP > after[:-1] // STEP
    some = np.flatnonzero(sentence | word)
    return ids, starts, after[some], sentence[some]


def cut_plan(places: np.ndarray, prices: np.ndarray, total: int, window: int) -> list[int]:
    """The cheapest ends of windows over tokens 0 to ``total``; the last end is ``total``. places (rising) and prices: where
    a cut may be and what it costs. A window of L tokens costs window - L.

    best(j) = price(j) + window - place(j) + min over i of best(i) + place(i), with place(j) - place(i) <= window: the
    minimum of a sliding range, kept in a queue whose values rise."""
    if not total:
        return []
    # where no cut is near, one may be at every eighth of a window, at the highest price
    gaps = np.flatnonzero(np.diff(np.concatenate(([0], places, [total]))) > window // 2)
    if len(gaps):
        edge = np.concatenate(([0], places, [total]))
        more = np.concatenate([np.arange(edge[g], edge[g + 1], max(1, window // 8))[1:] for g in gaps])
        places, prices = np.concatenate((places, more)), np.concatenate((prices, np.full(len(more), ELSEWHERE)))
        order = np.lexsort((prices, places))
        places, prices = places[order], prices[order]
    keep = (places > 0) & (places < total)
    at = [0, *places[keep].tolist(), total]
    price = [0, *prices[keep].tolist(), 0]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # value, place, number
    for j in range(1, len(at)):
        p = at[j]
        low = p - window
        while queue[0][1] < low:
            queue.popleft()
        value, _, back[j] = queue[0]
        value += price[j] + window - p
        best[j] = value
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


def tail_plan(start: int, total: int, window: int) -> list[int]:
    """Ends for the last window: as one, or cut into powers of two where that costs less than the padding."""
    length = total - start
    powers = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    best, done = ([total], 0 if len(powers) == 1 else window - length), 0
    for k in range(1, len(powers)):  # k powers, then the rest in one window
        done += powers[k - 1]
        rest = length - done
        cost = k * ELSEWHERE + (0 if k == len(powers) - 1 else window - rest)
        if cost < best[1]:
            best = (np.cumsum([start, *powers[:k]])[1:].tolist() + [total], cost)
    return best[0]


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens. A document is its text's ids and then ``end_id``.

    Documents keep the order in which their partition is read, and every id lies in exactly one piece. Each partition is
    packed on its own, in plans of about half a million tokens whose last window goes on into the next, so only the last
    window of a partition is short; there is no shuffle, and sequence ids are the partition's number and a counter. Within a
    plan the cuts minimise padding plus the price of each cut (none after a document, 8 tokens after a sentence, 48
    elsewhere). Rows: doc_id, start (its ids before the piece), length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one id (``end_id``), in one piece. A text of any length is cut into as many windows as it needs.
    A null id stays null; repeated rows are packed each; an empty table gives no rows; other columns are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        # what waits: ids, each document's (id, start in ids, ids before, tokens in all), places of sentence ends
        ids, held, marks, costs = np.zeros(0, "<u4"), [], np.zeros(0, np.int64), np.zeros(0, np.int64)

        def planned(last: bool):
            nonlocal number, ids, held, marks, costs
            total = len(ids)
            bounds = np.array([start for _, start, _, _ in held] + [total], np.int64)
            places = np.concatenate((bounds, marks))
            prices = np.concatenate((np.full(len(bounds), AT_DOCUMENT), costs))
            order = np.lexsort((prices, places))
            places, prices = places[order], prices[order]
            first = np.concatenate(([True], places[1:] != places[:-1]))
            ends = cut_plan(places[first], prices[first], total, window)
            if ends:
                ends = ends[:-1] + (tail_plan(ends[-2] if len(ends) > 1 else 0, total, window) if last else [])
            rows, d, at = [], 0, 0
            for end in ends:
                offset = 0
                while at < end:
                    doc_id, start, before, tokens = held[d]
                    stop = min(int(bounds[d + 1]), end)
                    rows.append((doc_id, before + at - start, stop - at, zlib.crc32(ids[at:stop]), tokens, number, offset))
                    offset += stop - at
                    at = stop
                    if stop == bounds[d + 1]:
                        d += 1
                number += 1
            held = [(i, max(0, s - at), b + max(0, at - s), n) for i, s, b, n in held[d:]]
            ids, marks, costs = ids[at:].copy(), marks[marks > at] - at, costs[marks > at]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in by_bytes(batches, "text", 2 << 20):
            new, starts, cuts, sentence = tokenize(texts_of(batch), tokenizer)
            n = np.diff(starts)
            # an end_id after each document's ids
            own = starts[:-1] + np.arange(len(n))
            every = np.full(len(new) + len(n), end_id, "<u4")
            every[ragged(own, n)] = new
            cuts = cuts + np.searchsorted(starts[1:], cuts, side="left")
            base = len(ids)
            held += zip(batch.column("doc_id").to_pylist(), (own + base).tolist(), [0] * len(n), (n + 1).tolist())
            marks = np.concatenate((marks, cuts + base))
            costs = np.concatenate((costs, np.where(sentence, AT_SENTENCE, ELSEWHERE)))
            ids = np.concatenate((ids, every))
            if len(ids) >= PLANNED:
                yield planned(False)
        if len(ids):
            yield planned(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
