"""Token counts: batch encoding inside Arrow functions that hand back lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import by_bytes, per_text, texts_of
from quire.llm.units import UnitCoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_loaded: dict[str, tuple] = {}


def _counter(path: str):
    """(count whole texts, coder of units or None) of a tokenizer file; loaded once in each Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # a piece model looks across spaces, so its texts are never cut
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            count = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            coder = UnitCoder(lambda units: [n.to_bytes(4, "little") for n in count(units)], special=tuple(x.content for x in model.get_added_tokens_decoder().values()))
            _loaded[path] = (count, coder if cuttable(model) else None)
    return _loaded[path]


def cuttable(model) -> bool:
    """Whether a tokenizer of the tokenizers library splits texts into words first, as units.py takes for granted: by the
    common byte-level pattern, or by a pattern that drops white space. Others get whole texts."""
    parts = json.loads(model.to_str())
    first = parts["pre_tokenizer"] or {}
    if first.get("type") == "ByteLevel":
        return bool(first.get("use_regex")) and not first.get("add_prefix_space") and parts["normalizer"] is None
    steps = first.get("pretokenizers") or [{}]
    return steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and "\\p{L}]+" in str(steps[0].get("pattern"))


def lengths(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text. Texts are cut into units at safe places, and every different unit is encoded once."""
    count, coder = _counter(path)
    if coder is None:
        return np.array(count(texts.to_pylist()), np.int64)
    counts, _, starts, _ = coder.code(texts)  # one number for each unit: how many tokens it has
    return per_text(counts.astype(np.int64), starts)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, UTF-8 bytes, tokens, and whether it has more than ``limit`` tokens.

    ``tokenizer`` is a file of the tokenizers (.json) or sentencepiece (.model) library, at a path that every executor
    has. No shuffle: rows stay where they were read, and each Python batch holds about 2 MB of text whatever the row
    count; a longer text stands alone and is cut into units at safe places. A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each; an
    empty table gives an empty result; other columns are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            texts = texts_of(batch)
            n = lengths(texts, tokenizer)
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
