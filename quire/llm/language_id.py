"""Language ID by hyperdimensional profiles: letter vectors bound into n-gram vectors, bundled and compared by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import by_bytes, texts_of

#: Dimensions of the vectors, letters in an n-gram.
DIM, N = 512, 3
#: Codes of letters: 0 stands for anything that is no letter. Letters below it are their own code, which holds those of all alphabets;
#: the others, such as ideographs, share these codes by a hash.
CODES = 1 << 12
#: Different n-grams of a batch up to which its texts share their vectors (2 KB each); n-grams that are bundled at a time; text bytes of a batch.
PIECE, BUNDLED, BATCH = 1 << 14, 1 << 11, 1 << 20
#: Languages at most, as their prototypes are gathered and broadcast (DIM numbers each).
MOST_LANGUAGES = 2000
UNKNOWN = "und"


def _code_table() -> np.ndarray:
    """The code of each character: that of its small letter; 0 for what is no letter."""
    table = np.zeros(0x110000, np.int16)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            small = ord(ch.lower()[0])
            table[c] = small if small < CODES else 1 + small * 40503 % (CODES - 1)
    return table


class Space:
    """The letters' random vectors of +1 and -1. A letter that stands i places before the end of an n-gram has its vector
    rotated i times; the n-gram's vector is the product of them, element by element."""

    def __init__(self, seed: int = 11):
        base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CODES, DIM))
        self.rotated = [np.roll(base, i, axis=1) for i in range(N)]
        self.codes = _code_table()

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """float32 rows for n-grams given as numbers in base CODES."""
        out = self.rotated[0][grams % CODES]
        for i in range(1, N):
            out = out * self.rotated[i][grams // CODES**i % CODES]
        return out.astype(np.float32)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of different n-grams, each as often as it counts; in whole numbers, some thousands at a time."""
        total = np.zeros(DIM)
        for at in range(0, len(grams), BUNDLED):
            total += counts[at : at + BUNDLED].astype(np.float64) @ self.vectors(grams[at : at + BUNDLED])
        return total

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All n-grams in turn, where each text's begin (one more at the end), and whether a text has a letter. Anything
        between words is one gap; a text begins and ends with one."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        code = self.codes[chars]
        letters = np.concatenate(([0], np.cumsum(code > 0)))
        has = letters[ends[1:]] > letters[ends[:-1]]
        # a gap on both sides of every text, then each run of gaps as one
        code = np.insert(code, np.concatenate((ends[:-1], ends[1:])), 0)
        ends = ends + 2 * np.arange(len(ends))
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
        keep[ends[:-1]] = True
        kept = np.concatenate(([0], np.cumsum(keep)))
        code, ends = code[keep].astype(np.int64), kept[ends]
        gram = np.zeros(len(code), np.int64)
        for i in range(N):
            gram[N - 1 :] += code[N - 1 - i : len(code) - i] * CODES**i
        own = np.ones(len(code), bool)  # an n-gram lies within its text
        for i in range(N - 1):
            own[np.minimum(ends[:-1] + i, max(0, len(code) - 1))] = False
        own &= gram > 0
        count = np.concatenate(([0], np.cumsum(own)))
        return gram[own], count[ends], has


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, mod ``folds``; rows of fold 0 are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: the bundle of the n-grams of all their texts, at unit length. Every task bundles its
    rows by language; the sums are joined by a grouped sum over (language, dimension), and only DIM numbers a
    language come to the driver. Rows without language or letters teach nothing."""
    space = Space()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in by_bytes(batches, "text", BATCH):
            grams, starts, _ = space.grams(texts_of(batch).to_pylist())
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                at = np.repeat(np.array([x == lang for x in langs]), np.diff(starts))
                found, counts = np.unique(grams[at], return_counts=True)
                if len(found):
                    total[lang] = total.get(lang, 0) + space.bundle(found, counts)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector], pa.list_(pa.float64()))], ["lang", "vector"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = known.mapInArrow(bundle, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("i", "x"))
    # sums of whole numbers below 2^53: the same in any order
    rows = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows.sort(key=lambda r: r.lang)
    vectors = np.array([[x.x for x in r.xs] for r in rows], np.float64).reshape(-1, DIM)
    return [r.lang for r in rows], (vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs, self.prototypes, self.space = langs, prototypes, Space()

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """A language and a cosine (0 to 1) for each text; und and 0 where there is no letter or nothing was learned."""
        space = self.space
        grams, starts, has = space.grams(texts)
        # a batch of few different n-grams, as is usual, shares their vectors
        different, place = np.unique(grams, return_inverse=True)
        vectors = space.vectors(different) if len(different) <= PIECE else None
        names, scores = [], np.zeros(len(texts))
        for i in range(len(texts)):
            if not has[i] or not self.langs:
                names.append(UNKNOWN)
                continue
            if vectors is None:
                whole = space.bundle(*np.unique(grams[starts[i] : starts[i + 1]], return_counts=True)).astype(np.float32)
            else:
                counts = np.bincount(place[starts[i] : starts[i + 1]])
                found = np.flatnonzero(counts)
                whole = counts[found].astype(np.float32) @ vectors[found]
            cosines = self.prototypes @ whole / max(1e-12, float(np.linalg.norm(whole)))
            best = int(np.argmax(cosines))
            names.append(self.langs[best])
            scores[i] = min(1.0, max(0.0, float(cosines[best])))
        return names, scores


def predict_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. The prediction sees the whole text and nothing else; null, empty
    and letterless texts are ``und`` with score 0. held_out says whether the id is in fold 0. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(Model(langs, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            names, scores = model.value.predict(texts_of(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows outside fold 0 that have a language, then predict all rows: doc_id, held_out, lang_pred, score.

    Letters of every script count, each by its own vector (those beyond the alphabets share some). A null, empty or letterless text is
    ``und`` with score 0; a row with a null text, language or no letter teaches nothing; a null id is in the fold of the empty text;
    repeated rows each count and are each predicted; a very long text stands alone in a batch (about thirty bytes of memory for each of its own); an empty table gives no rows;
    other columns are never read."""
    langs, prototypes = learn(docs.where(fold(id_col) != 0), text_col, lang_col)
    return predict_languages(docs, langs, prototypes, id_col, text_col)


def keep_known_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows whose text is in one of the languages: those without letters (und) go, and those whose cosine with every
    prototype is below ``least``, which even two words of a learned language reach. All columns stay as they are, whatever their names.
    Null and empty texts go; repeated rows are each judged; where nothing was learned, all rows go; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(Model(langs, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, BATCH):
            names, scores = model.value.predict(texts_of(batch, text_col).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
