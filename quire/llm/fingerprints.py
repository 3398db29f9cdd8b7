"""Document fingerprints: SpotSigs, chains of content words that follow common words."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.batches import texts_of
from quire.llm.ngram_join import JaccardSpec, linked_documents
from quire.llm.words import PUNCTUATION, mix, then, word_hashes

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
#: Content words in a chain.
CHAIN = 2
#: Rows of a run of neighbours, on average; runs at most, as their edges (8 bytes each) are part of every task. Beyond that, runs
#: grow, and Spark sorts a longer run on disk.
RUN_ROWS, MOST_RUNS = 2000, 1 << 17
BLOCK = 2 << 20

# Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from has he in is it its of on or that the this to was were will with you not have but they his her
au aux avec ce ces dans de des du elle en est et il ils la le les leur lui ne nous on ou par pas pour qu que qui sa se ses son sur un une
als am auch auf aus bei bin das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht oder sich sie sind und von war wird zu zum zur
al como con del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se si sin su sus un una y ya
"""


def _anchor_hashes() -> np.ndarray:
    return np.unique(word_hashes(pa.array([ANCHORS], pa.large_string()), PUNCTUATION)[0])


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's set of signatures, as rising 64-bit numbers.

    A word is a run of letters and digits (any character beyond ASCII counts as a letter). Each common word starts a
    chain with the next CHAIN words of the text that are not common. A text without any chain has one signature, of all
    its words; without words, of its characters; an empty one has none."""
    words, starts = word_hashes(texts, PUNCTUATION)
    anchors = _anchor_hashes()
    common = anchors[np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)] == words
    content = np.flatnonzero(~common)
    heads = np.flatnonzero(common)
    at = np.searchsorted(content, heads)
    fits = at + CHAIN <= len(content)
    heads, at = heads[fits], at[fits]
    text_of = np.searchsorted(starts[1:], heads, "right")
    if len(heads):
        inside = content[at + CHAIN - 1] < starts[1:][text_of]
        heads, at, text_of = heads[inside], at[inside], text_of[inside]
    value = words[heads]
    for i in range(CHAIN):
        value = then(value, words[content[at + i]])
    value = mix(value)
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1), "left")
    out = []
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            out.append(np.unique(value[a:b]))
        else:
            rest = words[starts[i] : starts[i + 1]].tobytes() or texts[i].as_buffer().to_pybytes()
            out.append(np.array([xxhash.xxh3_64_intdigest(rest)] if rest else [], np.uint64))
    return out


def signatures(texts: list[str]) -> list[np.ndarray]:
    return signature_sets(pa.array(texts, pa.large_string()))


def fingerprint(sigs: np.ndarray) -> str:
    """The set as text: its size, by which a search is partitioned, and the numbers in base64."""
    return f"{len(sigs)}:{base64.b64encode(sigs.astype('<u8').tobytes()).decode()}"


def read_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), "<u8")


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard similarity, 1 for two empty sets. The smaller size over the larger bounds it from above: sets of sizes that leave
    less than ``floor`` are not compared, nor those whose ranges don't meet; they give 0."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < floor * large or not small or a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def similar_fingerprints(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_signatures, component_id (the smallest id that links reach, its own included). Two documents
    link when the Jaccard similarity of their signature sets is ``percent`` or more; a null or empty text links with nothing.

    The search of SpotSigs: signatures in order of frequency, those at the front of a set as the keys under which documents
    meet; only sets whose sizes lie in the same or the next partition of lengths can be that similar, which prunes before
    bitmaps bound the overlap and sorted sets decide (see ngram_join, which does the same for shingles)."""
    found = linked_documents(docs, JaccardSpec(CHAIN, percent), signature_sets, id_col, text_col)
    return found.select("doc_id", F.col("n_shingles").alias("n_signatures"), "component_id")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, and for the text and its edited text the fingerprint, with the likeness of
    the text's to the edited text's and to the next document's.

    The next document is that of the next smaller id, after the last one the first; of rows of equal id, the order is that of
    their texts, and null ids come last. The edited text has its last floor(n/2) code points replaced by as many first ones
    of the next document, or all. A null text counts as empty. A table of one row has itself as next. Empty: no rows.

    Neighbours are found without one global sort: quantiles of the ids cut the documents into runs, each run is
    sorted within a task (on disk where it is long), and the first document of a run is also sent to the end of the run before it, so
    every text is shuffled once. Ids are meant to differ: all rows of one id are in one run.
    """
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", least))
    n = rows.count()
    wanted = int(min(MOST_RUNS, max(1, n // RUN_ROWS)))
    edges = sorted({int(e) for e in rows.approxQuantile("place", [i / wanted for i in range(1, wanted)], 0.1 / wanted)}) if wanted > 1 and n else []
    # how many edges are at or below the place, by halving; run 0 has the largest ids
    listed, steps = F.from_json(F.lit(json.dumps(edges)), "array<bigint>"), F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(listed, at + step - 1) <= F.col("place"), F.lit(False)), at + step).otherwise(at)) if edges else F.lit(0)
    rows = rows.withColumn("run", F.lit(len(edges)) - below)
    heads = rows.groupBy("run").agg(F.max("place").alias("place"))  # one row per run
    # the first one's before is the last: all in a ring
    order = Window.partitionBy(F.lit(0)).orderBy("run")
    heads = heads.select("place", F.coalesce(F.lag("run").over(order), F.max("run").over(Window.partitionBy(F.lit(0)))).alias("sent"))
    target, guest = F.struct("run", F.lit(0).alias("guest")), F.struct(F.col("sent").alias("run"), F.lit(1).alias("guest"))
    both = rows.join(F.broadcast(heads), "place", "left").select("doc_id", "place", "text", F.explode(F.when(F.col("sent").isNull(), F.array(target)).otherwise(F.array(target, guest))).alias("to"))
    spread = both.select("doc_id", "place", "text", "to.run", "to.guest").repartition(min(4096, len(edges) + 1), "run")
    spread = spread.sortWithinPartitions("run", "guest", F.desc("place"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, runs, guests = [], [], [], []

        def done(keep_last: bool) -> pa.RecordBatch | None:
            """Rows for all that is held but guests and, as its next is not known yet, the last."""
            nonlocal ids, texts, runs, guests
            sigs = signatures(texts)
            own = [i for i in range(len(ids) - 1) if not guests[i] and runs[i + 1] == runs[i]]
            edited = [texts[i][: len(texts[i]) - (half := len(texts[i]) // 2)] + texts[i + 1][:half] for i in own]
            changed = signatures(edited)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([fingerprint(sigs[i]) for i in own], pa.string()),
                    pa.array([fingerprint(s) for s in changed], pa.string()),
                    pa.array([likeness(sigs[i], s) for i, s in zip(own, changed)], pa.float64()),
                    pa.array([likeness(sigs[i], sigs[i + 1]) for i in own], pa.float64()),
                    pa.array([len(sigs[i]) for i in own], pa.int64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"],
            )
            ids, texts, runs, guests = ([x[-1]] if keep_last else [] for x in (ids, texts, runs, guests))
            return out

        size = 0
        for batch in batches:
            for i, text, r, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "run", "guest"))):
                ids.append(i)
                texts.append(text)
                runs.append(r)
                guests.append(guest)
                size += len(text)
                if size >= BLOCK and len(ids) > 1:
                    yield done(True)
                    size = len(texts[-1])
        if len(ids) > 1:
            yield done(False)

    return spread.select("doc_id", "text", "run", "guest").mapInArrow(work, SCHEMA)
