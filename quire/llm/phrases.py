"""Phrase collocation mining over a weighted de Bruijn graph: edges are the longest grams, nodes the grams of a word less."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.batches import by_bytes, ragged, texts_of
from quire.llm.hot_keys import join_hot
from quire.llm.ngram_join import filter_bits, key_filter
from quire.llm.words import BYTE, HALF, ODD, mix, place_numbers, raw, then
from quire.shared import Scratch

#: Text bytes that are taken apart at a time, and of a batch whose counts are summed before they are sent.
SLICE, BATCH = 1 << 20, 4 << 20
#: A unary path goes on beyond a node with the chance of all but one in so many, so paths have some hundred nodes at most; rounds
#: after which what is left are rings.
STEPS, ROUNDS = 32, 14
#: Parts in which the phrases of a language are ranked before they are ranked as a whole.
PARTS = 32
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(10, 14)]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
FORM = np.arange(256).astype(np.uint8)
FORM[65:91] += 32
FORM[9] = 32


@dataclass
class Words:
    """Words of a slice: its bytes in lower case with one blank between words, where each word begins and ends there, its text, its
    hash, and how many words of its piece follow from it on (itself included). Those before ``own`` belong to the slice; the
    others are only looked at."""

    form: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    follow: np.ndarray
    own: int

    def grams(self, m: int) -> np.ndarray:
        """Hashes of the m words from each place on (anything where so many don't follow)."""
        n = max(0, len(self.hashes) - m + 1)
        out = np.full(n, m, np.uint64)
        for i in range(m):
            out = then(out, self.hashes[i : n + i])
        return np.concatenate((mix(out), np.zeros(len(self.hashes) - n, np.uint64)))


def _after(data: np.ndarray, at: int, where: np.ndarray, count: int = 1) -> int:
    """The place behind the count-th byte of a kind from ``at`` on that follows one of another kind, or the end."""
    width = 1 << 16
    while True:
        hit = where[data[at : at + width]]
        found = np.flatnonzero(hit[1:] & ~hit[:-1]) + 1 if count > 1 else np.flatnonzero(hit)
        if len(found) >= count:
            return at + int(found[count - 1]) + 1
        if at + width >= len(data):
            return len(data)
        width *= 4


def slices(texts: pa.Array, seeds: np.ndarray, look: int, size: int) -> Iterator[Words]:
    """The words of texts, some megabytes at a time. A slice ends with a piece or a text; in a piece that is longer than a
    slice it ends with a word, and the ``look`` words behind it are looked at. seeds: a number for each text that its words'
    hashes depend on."""
    data, ends = raw(texts)
    lo = 0
    while lo < len(data):
        hi = stop = min(len(data), lo + size)
        if hi < len(data):
            text_end = int(ends[np.searchsorted(ends, hi, "left")])
            piece_end = min(text_end, _after(data[: min(text_end, hi + size)], hi, BREAK))
            if piece_end < min(text_end, hi + size) or piece_end == text_end:
                hi = stop = piece_end
            else:
                hi = min(text_end, _after(data, hi, BLANK | BREAK))
                stop = min(text_end, _after(data, hi, BLANK | BREAK, look + 2))
        yield _words(data[lo:stop], ends[np.searchsorted(ends, lo, "left") : np.searchsorted(ends, stop, "left")] - lo, int(np.searchsorted(ends, lo, "right")) - 1, seeds, hi - lo)
        lo = hi


def _words(part: np.ndarray, cuts: np.ndarray, text: int, seeds: np.ndarray, own: int) -> Words:
    """``cuts``: where texts begin in ``part``; text: the number of the one that its first byte is of."""
    blank = BLANK[part]
    keep = np.ones(len(part), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(keep)
    form, cuts = FORM[part[at]], np.searchsorted(at, cuts)
    cuts = cuts[cuts < len(form)]
    stops = BREAK[form]
    alive = ~(stops | (form == 32))
    first = alive.copy()
    first[1:] &= ~alive[:-1]
    first[cuts] = alive[cuts]
    begin = np.flatnonzero(first)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Words(form, none, none, none, np.zeros(0, np.uint64), none, 0)
    bounds = np.append(np.flatnonzero(first | ~alive), len(form))
    end = bounds[np.searchsorted(bounds, begin, "right")]
    of = np.searchsorted(cuts, begin, "right")
    if len(cuts) and cuts[0] == 0:  # its first byte begins a text
        of = of - 1
    start = np.zeros(len(form), np.int32)
    start[begin] = begin
    within = np.arange(len(form), dtype=np.int32) - np.maximum.accumulate(start)
    within[~alive] = 0
    value = BYTE[form]
    value ^= place_numbers(int(within.max()) + 1)[within]
    value *= ODD
    value ^= value >> HALF
    value[~alive] = 0
    hashes = mix(np.add.reduceat(value, begin))
    text_of = text + of
    piece = np.cumsum(stops)[begin]
    last = np.ones(len(begin), bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (of[1:] != of[:-1])
    ending = np.flatnonzero(last)
    follow = ending[np.searchsorted(ending, np.arange(len(begin)))] - np.arange(len(begin)) + 1
    return Words(form, begin, end, text_of, mix(hashes ^ seeds[text_of]), follow, int(np.searchsorted(at[begin], own)))


def _langs(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, each text's, and a number for each text by its language."""
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    codes = np.asarray(coded.indices).astype(np.int64)
    return names, codes, seeds[codes] if len(codes) else seeds


def _gram_hashes(rows: DataFrame, n: int) -> DataFrame:
    """(h, n) of the grams of 1 to n - 1 words in all texts, by hash; counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            _, _, seeds = _langs(batch)
            found = [words.grams(m)[: words.own][words.follow[: words.own] >= m] for words in slices(texts_of(batch), seeds, n - 1, SLICE) for m in range(1, n)]
            h, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "n"])

    return rows.mapInArrow(run, "h long, n long")


def _strings(form: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(form[ragged(begin, size)]))


def _grams(rows: DataFrame, n: int, often) -> DataFrame:
    """(lang, gram, words, n): from every place of a text the longest gram of up to n words that may count, and each language's
    words (0). often: a filter of the hashes of grams that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = often.value
        low = np.uint64(8 * len(bits) - 1)

        def passes(hashes: np.ndarray) -> np.ndarray:
            h = (hashes & low).astype(np.int64)
            return (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)

        for batch in by_bytes(batches, "text", BATCH):
            names, codes, seeds = _langs(batch)
            for words in slices(texts_of(batch), seeds, n - 1, SLICE):
                if not len(words.begin):
                    continue
                # frequent grams of m words from each place on; a longest gram needs both of its nodes
                length, key, good = np.zeros(len(words.begin), np.int64), np.zeros(len(words.begin), np.uint64), np.ones(len(words.begin), bool)
                for m in range(1, n + 1):
                    h = words.grams(m)
                    if m < n:
                        node = passes(h) & (words.follow >= m)
                        good &= node
                    else:
                        good &= np.append(node[1:], False) & (words.follow >= m)
                    length[good], key[good] = m, h[good]
                own = np.flatnonzero(length[: words.own])
                begin, last = words.begin[own], own + length[own] - 1
                size = words.end[last] - begin
                _, first, of, count = np.unique(key[own], return_index=True, return_inverse=True, return_counts=True)
                # those whose bytes differ from the first of their hash go alone
                alike = size == size[first][of] if len(own) else np.zeros(0, bool)
                same = np.flatnonzero(alike)
                differ = np.flatnonzero(words.form[ragged(begin[same], size[same])] != words.form[ragged(begin[first][of][same], size[same])]) if len(same) else same
                alike[same[np.searchsorted(np.cumsum(size[same]), differ, "right")]] = False
                alone = np.flatnonzero(~alike)
                np.subtract.at(count, of[alone], 1)
                each = np.concatenate((first, alone))
                lang = codes[words.text]
                totals = np.bincount(lang[: words.own], minlength=len(names))
                rows = {
                    "lang": pa.array(names, pa.string()).take(pa.array(np.concatenate((lang[own[each]], np.arange(len(names)))))),
                    "gram": pa.concat_arrays([_strings(words.form, begin[each], size[each]), pa.array([""] * len(names), pa.large_string())]).cast(pa.string()),
                    "words": pa.array(np.concatenate((length[own[each]], np.zeros(len(names), np.int64))), pa.int32()),
                    "n": pa.array(np.concatenate((count, np.ones(len(alone), np.int64), totals)).astype(np.int64)),
                }
                yield pa.RecordBatch.from_pydict(rows)

    return rows.mapInArrow(run, "lang string, gram string, words int, n long")


def first_words(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def last_words(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def key(gram: Column) -> Column:
    """Gram and language as one string; a gram has no tab."""
    return F.concat(gram, F.lit("\t"), F.col("lang"))


class PhraseGraph:
    """The grams of up to n words of each language with their counts, as a graph.

    An edge is a gram of n words, its nodes are its first and last n - 1 words; its weight counts the places where it stands. A
    shorter gram's count is the flow out of it, the sum of the edges (or longer grams) that begin with it, and a
    correction for the places where a piece ends with it, or goes on with what is too rare to count. Only grams of at
    least ``least`` places are kept; all those within one are as frequent."""

    def __init__(self, rows: DataFrame, n: int, least: int, scratch: Scratch):
        """rows: lang (not null), text."""
        self.n, self.least, self.scratch = n, least, scratch
        seen = Observation()
        often = _gram_hashes(rows, n).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")
        often = scratch.write(often.observe(seen, F.count("*").alias("n")), "often")
        bits = min(30, filter_bits(seen.get["n"] or 0) + 2)
        shared = rows.sparkSession.sparkContext.broadcast(key_filter(often.select(F.pmod("h", F.lit(1 << bits)).alias("h")), bits))
        grams = _grams(rows, n, shared).groupBy("lang", "gram", "words").agg(F.sum("n").alias("f"))
        grams = scratch.write(grams, "grams")
        self.totals = grams.where("words = 0").select("lang", F.col("f").alias("n"))
        whole = grams.where(F.col("words") == n).select("lang", "gram", "f")
        self.kept = {n: whole.where(F.col("f") >= least)}
        for m in range(n - 1, 0, -1):
            ends = grams.where(F.col("words") == m).select("lang", "gram", "f")
            flow = whole.select("lang", first_words("gram", m).alias("gram"), "f").unionByName(ends)
            whole = scratch.write(flow.groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"flow-{m}")
            self.kept[m] = whole.where(F.col("f") >= least)
        self.nodes: dict[int, DataFrame] = {}
        known = self.kept[1].select("lang", "gram", key(F.col("gram")).alias("key"), "f", F.expr("cast(array() as array<bigint>)").alias("pre"), F.expr("cast(array() as array<bigint>)").alias("suf"))
        for m in range(2, n + 1):
            longer = self.kept[m].select("lang", "gram", "f", key(first_words("gram", m - 1)).alias("head"), key(last_words("gram", m - 1)).alias("tail"))
            # what goes out of and into each gram of m - 1 words
            out = longer.groupBy("head").agg(F.count("*").alias("outs"), F.max("f").alias("out_most"), F.min(last_words("gram", 1)).alias("next")).withColumnRenamed("head", "key")
            into = longer.groupBy("tail").agg(F.count("*").alias("ins"), F.max("f").alias("in_most"), F.min(first_words("gram", 1)).alias("before")).withColumnRenamed("tail", "key")
            known = known.join(out, "key", "left").join(into, "key", "left")
            self.nodes[m - 1] = scratch.write(known.fillna(0, ["outs", "ins", "out_most", "in_most"]).withColumn("inner", F.lit(False)), f"nodes-{m - 1}")
            if m < n:
                known = self.scored(longer, self.nodes[m - 1])
        self.edges = longer
        self.paths = scratch.write(self._paths(), "paths")

    def scored(self, longer: DataFrame, nodes: DataFrame) -> DataFrame:
        """Grams with the counts of their first (pre) and last words (suf): a gram's are those of its two nodes, and the nodes' own.
        Grams whose last node is an inner one of a path are left out. A node that very many grams share is looked up by broadcast."""
        total = longer.count()
        tails = nodes.select(F.col("key").alias("tail"), F.concat("suf", F.array("f")).alias("suf"), "ins", "inner")
        heads = nodes.select(F.col("key").alias("head"), F.concat("pre", F.array("f")).alias("pre"), "outs")
        rows = join_hot(join_hot(longer, tails, "tail", total, "ins").where(~F.col("inner")), heads, "head", total, "outs")
        return rows.select("lang", "gram", key(F.col("gram")).alias("key"), "f", "pre", "suf")

    def _paths(self) -> DataFrame:
        """Unary paths of nodes, one row each: path (its first node's key), lang, inner (keys of the nodes that follow a node of the
        path), nodes (rising by hop: gram, f, in_most, pre, suf).

        A node with one edge in and one out belongs to a path with the node before it if that is such a node too. Each node's way
        back to its path's first node is doubled in every round. One node in STEPS, by a hash, begins a path of its own, so paths
        and rounds stay short however long a passage is; nodes of a ring without such a node stand alone."""
        m = self.n - 1
        nodes = self.nodes[m].where("ins = 1 and outs = 1").withColumn("up", key(F.concat_ws(" ", "before", first_words("gram", m - 1)) if m > 1 else F.col("before")))
        unary = nodes.select("key", "up")
        links = unary.join(unary.select(F.col("key").alias("up")), "up", "left_semi").where((F.pmod(F.xxhash64("key"), F.lit(STEPS)) != 0) & (F.col("key") != F.col("up")))
        state = unary.select("key").join(links, "key", "left").select("key", F.coalesce("up", "key").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("hop"), F.col("up").isNull().alias("done"))
        for turn in range(ROUNDS):
            seen = Observation()
            table = self.scratch.write(state.observe(seen, F.count_if(~F.col("done")).alias("open")), f"ways-{turn}")
            if turn:
                self.scratch.drop(f"ways-{turn - 1}")
            if not seen.get["open"]:
                break
            further = table.select(F.col("key").alias("up"), F.col("up").alias("above"), F.col("hop").alias("more"), F.col("done").alias("ends"))
            moved = table.where(~F.col("done")).join(further, "up").select("key", F.col("above").alias("up"), (F.col("hop") + F.col("more")).alias("hop"), F.col("ends").alias("done"))
            state = table.where("done").unionByName(moved)
        alone = ~F.col("done")
        ways = table.select("key", F.when(alone, F.col("key")).otherwise(F.col("up")).alias("path"), F.when(alone, 0).otherwise(F.col("hop")).alias("hop"))
        found = nodes.drop("up").join(ways, "key")
        rows = found.groupBy("path", "lang").agg(F.sort_array(F.collect_list(F.struct("hop", "gram", "f", "in_most", "pre", "suf", "key"))).alias("nodes"))
        return rows.withColumn("inner", F.expr("transform(slice(nodes, 2, greatest(size(nodes) - 1, 0)), x -> x.key)"))

    def longest(self) -> DataFrame:
        """The edges as ``scored`` gives them. Those within a path take both nodes from its row; only the others look theirs up."""
        at = self.paths.select("lang", F.posexplode("nodes").alias("i", "x"), "nodes").where("i > 0").withColumn("u", F.expr("nodes[i - 1]"))
        gram = F.concat_ws(" ", "u.gram", last_words("x.gram", 1))
        within = at.select("lang", gram.alias("gram"), F.col("x.in_most").alias("f"), F.concat("u.pre", F.array("u.f")).alias("pre"), F.concat("x.suf", F.array("x.f")).alias("suf"))
        inner = self.paths.select(F.explode("inner").alias("key"), F.lit(True).alias("inside"))
        nodes = self.nodes[self.n - 1].drop("inner").join(inner, "key", "left").withColumn("inner", F.col("inside").isNotNull())
        return within.unionByName(self.scored(self.edges, nodes).select(*within.columns))

    def passages(self) -> DataFrame:
        """The unary paths as text: lang, words (of the whole path), n_words, least and most (counts of its nodes)."""
        words = F.expr("transform(nodes, (x, i) -> if(i = 0, x.gram, substring_index(x.gram, ' ', -1)))")
        flows = F.transform("nodes", lambda x: x["f"])
        return self.paths.select("lang", F.array_join(words, " ").alias("words"), (F.size("nodes") + self.n - 2).alias("n_words"), F.array_min(flows).alias("least"), F.array_max(flows).alias("most"))


def build_graph(docs: DataFrame, max_words: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> PhraseGraph:
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return PhraseGraph(rows, max_words, least, Scratch(docs.sparkSession, "phrases"))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at full stops, commas, semicolons, colons, exclamation and question marks and line ends
    into pieces, and these at spaces and tabs into words. Phrases are 2 to max_words words within a piece, with a >= ``least``
    places, overlapping ones too. A cut after k words leaves parts with l and r places; the score is floor(10^6 a a / (l r)) of
    the cut that makes it lowest (of equal ones the first), worked out in whole numbers of 38 digits (so for counts up to
    10^16). A phrase within a longer one that has ``share`` percent of its places or more is dropped, whether or not the longer one is. n:
    all words of the language. Ranks go by falling score, falling a, rising phrase (by UTF-8 bytes), so they are defined.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count each. An empty table gives no rows;
    a language without words or phrases has none. Other columns are never read. Texts of any length are read in slices; a piece
    longer than a slice goes on in the next one.

    How: hashes of all grams of up to max_words - 1 words are counted to find those that may be frequent (a filter of at most 128 MB;
    what passes by chance is counted and then left out), then the graph is built (PhraseGraph): longest grams are counted, shorter ones
    are the flow between them, unary paths are brought into rows.
    """
    graph = build_graph(docs, max_words, least, text_col, lang_col)
    kept = [n.where(F.greatest("in_most", "out_most") * 100 < F.col("f") * share).select("lang", "gram", "f", "pre", "suf") for m, n in graph.nodes.items() if m > 1]
    found = graph.longest() if max_words > 1 else None
    for rows in kept:
        found = found.unionByName(rows)
    big = "cast({} as decimal(38, 0))".format
    cut = f"named_struct('score', ({big('1000000')} * {big('f')} * {big('f')}) div ({big('pre[k - 1]')} * {big('suf[size(suf) - k]')}), 'k', k, 'l', pre[k - 1], 'r', suf[size(suf) - k])"
    found = found.withColumn("cut", F.expr(f"array_min(transform(sequence(1, size(pre)), k -> {cut}))")).select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))).where(F.col("place") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return few.join(graph.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
