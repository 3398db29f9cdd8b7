"""N-gram Jaccard join: documents meet in size-banded tiles, hashed bitmaps bound their overlap, and sorted arrays of
shingle hashes decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.llm.batches import by_bytes, texts_of
from quire.llm.components import components
from quire.llm.hot_keys import join_hot
from quire.shared import Scratch
from quire.llm.words import shingle_sets

#: Sets that share a shingle: up to so many, all their possible pairs are listed; more of them meet in a tile, which gives no
#: more links than it has sets.
FEW = 128
#: Sets a tile compares with each other; a tile of more first becomes components in so many rounds, each of which joins up to
#: TILE of them.
TILE, ROUNDS = 1024, 3
#: Text bytes that a task turns into shingles at a time.
BATCH = 1 << 20
#: Bits of a signature; sets of more shingles put every 2nd, 4th, 8th ... of their shingles in it.
BITS = 512
#: Shingles in so many documents' first prefixes, and each time so many times as many, come later in the order; levels at most.
COMMON, COMMON_STEP, LEVELS = 4, 8, 6
#: Bytes of filters that the driver fetches at a time, about.
FETCHED = 16 << 20
#: Bits of a wide signature at least and most: about two to four for each shingle.
LEAST_WIDE, MOST_WIDE = 9, 20
SET_SCHEMA = "doc_id long, text_hash long, sid long, n int, sig binary, wide binary, prefix array<long>"


class JaccardSpec:
    """k-word shingles, and num / den as the least Jaccard similarity of a link."""

    def __init__(self, k: int, num: int, den: int = 100):
        self.k, self.num, self.den = k, num, den

    def prefix(self, n: int) -> int:
        """Two linked sets of n and more shingles share one of the n - ceil(t n) + 1 first shingles in any order."""
        return n + (-self.num * n // self.den) + 1

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))


def _sampled(n):
    """How many low bits of a hash must be 0 for the shingle to enter the signature of a set of n."""
    return np.ceil(np.log2(np.maximum(1, np.asarray(n) / BITS) + 1e-9)).clip(0).astype(np.int64)


def signature(hashes: np.ndarray) -> bytes:
    rate = int(_sampled(len(hashes)))
    taken = hashes[(hashes & np.uint64((1 << rate) - 1)) == 0]
    bits = np.zeros(BITS, np.uint8)
    bits[(taken >> np.uint64(40)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).tobytes()


def wide_signature(hashes: np.ndarray) -> bytes:
    size = 1 << min(MOST_WIDE, max(LEAST_WIDE, (2 * len(hashes) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(20)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(bits).tobytes()


def _missing(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Bits of two wide signatures that only the first, and only the second, has; the longer one is folded to the size of the
    other, which keeps that a bit stands for at least one shingle."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())


#: Texts to sets of 64-bit hashes, each rising.
SetsOf = Callable[[pa.Array], list[np.ndarray]]


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes())[:8], "little", signed=True)


class Levels:
    """How common a shingle is, from 0, by a filter of bits for each level. Now and then one shares another's bits and so its level, but
    the level is the same wherever the shingle stands, so that the order is one order."""

    def __init__(self, filters: list[np.ndarray]):
        self.filters = filters

    def of(self, hashes: np.ndarray) -> np.ndarray:
        level = np.zeros(len(hashes), np.uint8)
        for bits in self.filters:
            h = hashes & np.uint64(8 * len(bits) - 1)
            level += bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1
        return level


def _prefixes_of(sets: list[np.ndarray], spec: JaccardSpec, levels: Levels) -> list[np.ndarray]:
    """The prefix of each set, in the order of: rare ones by hash, then commoner ones by hash, and so on."""
    level = levels.of(np.concatenate(sets)) if sets else np.zeros(0, np.uint8)
    out, at = [], 0
    for s in sets:
        own = level[at : at + len(s)]
        at += len(s)
        first = np.argsort(own, kind="stable")[: spec.prefix(len(s))] if own.any() else slice(spec.prefix(len(s)))
        out.append(s[first].view(np.int64) if len(s) else np.zeros(0, np.int64))
    return out


def _bounds(spec: JaccardSpec, n_a, sig_a, n_b, sig_b) -> np.ndarray:
    """At most so large is the similarity (0 where below the threshold). A bit that only a has stands for a shingle at
    least that only a has, so the overlap is at most n_a less these bits; likewise for b."""
    only_a = np.bitwise_count(sig_a & ~sig_b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(sig_b & ~sig_a).sum(-1, dtype=np.int64)
    most = np.minimum(np.minimum(n_a, n_b), np.minimum(n_a - only_a, n_b - only_b))
    most = np.where(_sampled(n_a) == _sampled(n_b), most, np.minimum(n_a, n_b))
    return np.where(most >= spec.needed(n_a, n_b), most / np.maximum(1, n_a + n_b - most), 0)


def _pairs_of_few(spec: JaccardSpec):
    """An Arrow function over rows sorted by token: (token, sid, n, sig) to the pairs (a, b) that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(cols) -> pa.RecordBatch:
            out = []
            for step in range(1, FEW):  # each row with the one ``step`` further on, in all tiles at once
                if step >= len(cols["token"]):
                    break
                x = np.flatnonzero(cols["token"][step:] == cols["token"][:-step])
                if not len(x):
                    break
                y = x + step
                ok = _bounds(spec, cols["n"][x], cols["sig"][x], cols["n"][y], cols["sig"][y]) > 0
                a, b = cols["sid"][x[ok]], cols["sid"][y[ok]]
                out.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1))
            both = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "sid", "n")}
            cols["n"] = cols["n"].astype(np.int64)
            cols["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            if held is not None:
                cols = {c: np.concatenate((held[c], cols[c])) for c in cols}
            last = cols["token"] == cols["token"][-1]
            yield pairs({c: v[~last] for c, v in cols.items()})
            held = {c: v[last].copy() for c, v in cols.items()}
        if held is not None:
            yield pairs(held)

    return run


def _links_of_tile(spec: JaccardSpec, sid, n, sig, side, group, hashes) -> list[tuple[int, int]]:
    """(set, least set of its group) for what links connect in a tile. A set is compared with those of other groups only, the
    most similar first, by the bounds of the signatures and then exactly. group: sets of one number are connected already.
    side: 0, or 1 and 2 where only pairs of different sides are asked for."""
    order = np.argsort(n, kind="stable")
    sid, n, sig, side = sid[order], n[order], sig[order], side[order]
    component = np.unique(group[order], return_inverse=True)[1]
    touched = np.zeros(len(n), bool)
    for i in range(1, len(n)):
        first = int(np.searchsorted(n, -(-n[i] * spec.num // spec.den)))
        apart = first + np.flatnonzero(component[first:i] != component[i])
        if side[i]:
            apart = apart[side[apart] != side[i]]
        if not len(apart):
            continue
        score = _bounds(spec, n[i], sig[i], n[apart], sig[apart])
        found = np.flatnonzero(score)
        found = apart[found[np.argsort(-score[found], kind="stable")]]
        x = hashes[order[i]]
        while len(found):
            j, found = found[0], found[1:]
            y = hashes[order[j]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if spec.den * both >= spec.num * (len(x) + len(y) - both):
                component[component == component[i]] = component[j]
                touched[component == component[j]] = True
                found = found[component[found] != component[j]]
    least: dict[int, int] = {}
    for c, s in zip(component.tolist(), sid.tolist()):
        least[c] = min(s, least.get(c, s))
    return [(s, least[c]) for c, s, t in zip(component.tolist(), sid.tolist(), touched.tolist()) if t and s != least[c]]


def _links_of_tiles(spec: JaccardSpec):
    """An Arrow function over rows sorted by tile and part: (tile, part, sid, n, sig, side, grp, hashes) to links (tile, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None

        def done() -> pa.RecordBatch:
            sid, n, side, group = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3, 4))
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(-1, BITS // 64)
            links = _links_of_tile(spec, sid, n, sig, side, group, [np.frombuffer(r[5], np.uint64) for r in rows])
            columns = [now[0]] * len(links), [x[0] for x in links], [x[1] for x in links]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tile", "a", "b"])

        for batch in batches:
            for tile, part, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "part", "sid", "n", "sig", "side", "grp", "hashes"))):
                if (tile, part) != now:
                    if len(rows) > 1:
                        yield done()
                    rows, now = [], (tile, part)
                rows.append(row)
        if len(rows) > 1:
            yield done()

    return run


def _postings(posting: DataFrame, node: str = "sid") -> DataFrame:
    """posting (token and others) with c and least: how many rows share the token, and the least node of them. Lone tokens go."""
    counts = posting.groupBy("token").agg(F.count("*").cast("int").alias("c"), F.min(node).alias("least")).where("c > 1")
    total = counts.agg(F.sum("c")).first()[0] or 0
    return join_hot(posting, counts, "token", total, "c")


def _banded(postings: DataFrame, sets: DataFrame, spec: JaccardSpec) -> DataFrame:
    """Postings of frequent shingles by bands of size, (token, c, sid, node, least): linked sets lie in one band or in neighbouring ones, so each set
    is in its own and in the next, as a node for each. What one shingle brings together in several sizes so never meets."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(spec.den / spec.num))).cast("int")
    rows = postings.select("token", "sid").join(sets.select("sid", "n"), "sid").withColumn("band", F.explode(F.array(band, band + 1)))
    return _postings(rows.select(F.xxhash64("token", "band").alias("token"), "sid", F.xxhash64("sid", "band").alias("node")), "node")


def _tile_links(members: DataFrame, hashes: DataFrame, spec: JaccardSpec) -> DataFrame:
    """Links (tile, a, b) within the parts of members (tile, part, sid, n, sig, side, grp)."""
    rows = members.join(hashes, "sid").select("tile", "part", "sid", "n", "sig", "side", "grp", "hashes")
    return rows.repartition("tile", "part").sortWithinPartitions("tile", "part").mapInArrow(_links_of_tiles(spec), "tile long, a long, b long")


def _large_links(large: DataFrame, hashes: DataFrame, spec: JaccardSpec, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """Links of tiles of more than TILE sets, large: (tile, sid, n, sig, prefix), and members of parts that are still to be compared.

    First in ROUNDS rounds, each about linear: sets that share the least of their prefix shingles by a hash of the round meet in parts
    of at most TILE; of what is connected, one set goes on to the next round. A group of near copies so becomes one
    component. Then, so that no link is lost, the sets outside of the largest component of their tile (which holds sets of a size band and the
    one before) are compared with all others there: they go to each block of the others, which stay in one."""
    found: list[DataFrame] = []
    groups = large.withColumn("grp", F.col("sid"))
    for turn in range(ROUNDS):
        one = groups.where("sid = grp").withColumn("key", F.array_min(F.transform("prefix", lambda t: F.xxhash64(t, F.lit(turn)))))
        sizes = one.groupBy("tile", "key").agg(F.ceil(F.count("*") / TILE).alias("k"))
        parts = one.join(sizes, ["tile", "key"]).withColumn("part", F.xxhash64("key", F.pmod(F.xxhash64("sid", F.lit(turn)), "k"))).withColumn("side", F.lit(0))
        joined = scratch.write(_tile_links(parts.select("tile", "part", "sid", "n", "sig", "side", "grp"), hashes, spec), f"large-{turn}")
        found.append(joined.select("a", "b"))
        # each set of a tile is in one part, so it goes to one group: the least set that it is connected with there
        groups = groups.join(joined.select("tile", F.col("a").alias("grp"), F.col("b").alias("to")), ["tile", "grp"], "left").withColumn("grp", F.coalesce("to", "grp")).drop("to")
        groups = scratch.write(groups, f"grouped-{turn}")
    counts = groups.groupBy("tile", "grp").agg(F.count("*").alias("c"))
    counts = counts.groupBy("tile").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("c"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(2 * n / TILE)).cast("int")
    counts = counts.where("c > most").select("tile", "main", blocks(F.col("c") - F.col("most")).alias("ks"), blocks(F.col("most")).alias("km"))
    counts = scratch.write(counts, "strays")
    if counts.isEmpty():
        return found, None
    rows = groups.join(counts, "tile")
    aside = F.col("grp") != F.col("main")
    own = F.pmod(F.xxhash64("sid"), F.when(aside, F.col("ks")).otherwise(F.col("km"))).cast("int")
    rows = rows.withColumn("own", own)
    part = lambda kind, i, j, side: F.struct(F.xxhash64(F.lit(kind), i, j).alias("part"), side.alias("side"))
    each = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    among = F.transform(each("ks"), lambda i: part(0, F.least(i, "own"), F.greatest(i, "own"), F.when(i == F.col("own"), 0).when(i > F.col("own"), 1).otherwise(2)))
    across = F.transform(each("km"), lambda j: part(1, F.col("own"), j, F.lit(1)))
    within = F.transform(each("ks"), lambda i: part(1, i, F.col("own"), F.lit(2)))
    rows = rows.select("tile", "sid", "n", "sig", "grp", F.explode(F.when(aside, F.concat(among, across)).otherwise(within)).alias("p"))
    return found, rows.select("tile", "p.part", "sid", "n", "sig", "p.side", "grp")


def filter_bits(keys: int) -> int:
    """Of a filter for so many keys: about four to eight bits for each, between 128 KB and 128 MB."""
    return min(30, max(20, (4 * keys).bit_length()))


def key_filters(rows: DataFrame, bits: dict[int, int]) -> dict[int, np.ndarray]:
    """A filter of 2^bits[f] bits for each f, with those in ``rows`` (columns f and h) set. The driver fetches some 16 MB at a time, so its jobs
    are as many as that takes, however many shuffle partitions there are."""
    found = rows.groupBy("f", F.expr("h div 32768").cast("int").alias("k")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("bits"))
    out = {f: np.zeros((1 << b) // 8, np.uint8) for f, b in bits.items()}
    for row in found.repartition(-(-sum(map(len, out.values())) // FETCHED)).toLocalIterator():
        out[row.f][row.k * 4096 : row.k * 4096 + 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def key_filter(rows: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2^bits bits with those in ``rows`` (column h) set."""
    return key_filters(rows.select(F.lit(0).alias("f"), "h"), {0: bits})[0]


def _prefixes(docs: DataFrame, spec: JaccardSpec, sets_of: SetsOf, levels) -> DataFrame:
    """The prefix shingles of all documents, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            sets = [p for p in _prefixes_of(sets_of(texts_of(batch)), spec, levels.value) if len(p)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["token"])

    return docs.select("text").mapInArrow(run, "token long")


def _levels(docs: DataFrame, spec: JaccardSpec, sets_of: SetsOf, scratch: Scratch) -> Levels:
    """How common shingles are, counted over the hash-ordered prefixes of all documents. Any one order gives the same links; this one, about that of
    their counts, brings few sets together, as what very many documents have by chance is in a prefix only where nothing rarer is. The least
    counts are fixed, so that a shingle comes late at any size of the input; filters are bounded (filter_bits)."""
    context = docs.sparkSession.sparkContext
    counts = _prefixes(docs, spec, sets_of, context.broadcast(Levels([]))).groupBy("token").count()
    least = [COMMON * COMMON_STEP**k for k in range(LEVELS)]
    seen = Observation()
    found = [F.count_if(F.col("count") >= n).alias(f"n{k}") for k, n in enumerate(least)]
    table = scratch.write(counts.where(F.col("count") >= COMMON).observe(seen, *found), "common")
    sizes = [seen.get[f"n{k}"] or 0 for k in range(LEVELS)]
    bits = {k: filter_bits(keys) for k, keys in enumerate(sizes) if keys}
    if not bits:
        return Levels([])
    of_level = [F.when(F.col("count") >= least[k], F.struct(F.lit(k).alias("f"), F.pmod("token", F.lit(1 << b)).alias("h"))) for k, b in bits.items()]
    filters = key_filters(table.select(F.explode(F.array_compact(F.array(*of_level))).alias("x")).select("x.*"), bits)
    scratch.drop("common")
    return Levels([filters[k] for k in bits])


def _sets(docs: DataFrame, spec: JaccardSpec, sets_of: SetsOf, scratch: Scratch) -> DataFrame:
    """Every document's set: id of the set, size, signatures, and those prefix shingles that another set may have too."""
    context = docs.sparkSession.sparkContext
    levels = context.broadcast(_levels(docs, spec, sets_of, scratch))
    seen = Observation()
    twice = _prefixes(docs, spec, sets_of, levels).groupBy("token").count().where("count > 1").select("token")
    twice = scratch.write(twice.observe(seen, F.count("*").alias("n")), "shared")
    size = filter_bits(seen.get["n"])
    shared = context.broadcast(key_filter(twice.select(F.pmod("token", F.lit(1 << size)).alias("h")), size))
    scratch.drop("shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in by_bytes(batches, "text", BATCH):
            sets = sets_of(texts_of(batch))
            prefixes = []
            for tokens in _prefixes_of(sets, spec, levels.value):
                h = tokens & ((1 << size) - 1)
                prefixes.append(tokens[bits[h >> 3] >> (h & 7).astype(np.uint8) & 1 == 1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([signature(s) for s in sets], pa.binary()),
                    pa.array([wide_signature(s) if len(p) else b"" for s, p in zip(sets, prefixes)], pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "sid", "n", "sig", "wide", "prefix"],
            )

    return docs.mapInArrow(run, SET_SCHEMA)


def _near(pairs: DataFrame, sets: DataFrame, spec: JaccardSpec) -> DataFrame:
    """Those of the pairs whose wide signatures leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, nb, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("x"), batch.column("y")):
                only_x, only_y = _missing(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                ok.append((spec.num + spec.den) * min(na - only_x, nb - only_y) >= spec.num * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda s, n, w: sets.select(F.col("sid").alias(s), F.col("n").alias(n), F.col("wide").alias(w))
    both = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def _hashes(docs: DataFrame, ids: DataFrame, sets: DataFrame, sets_of: SetsOf, scratch: Scratch) -> DataFrame:
    """(sid, hashes) of the sets in ``ids``. The texts are read again, and a set is sent by one of its documents only: a filter
    tells which, so now and then another one comes too, but none is missing."""
    seen = Observation()
    ends = scratch.write(ids.join(sets.select("sid", "first_id"), "sid").observe(seen, F.count("*").alias("n")), "ends")
    size = filter_bits(seen.get["n"])
    low = lambda c: F.coalesce(F.pmod(c, F.lit(1 << size)), F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(ends.select(low("sid").bitwiseXOR(low("first_id")).alias("h")), size))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in by_bytes(batches, "text", BATCH):
            found = {}
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), sets_of(texts_of(batch))):
                if len(s):
                    h = ((sid := set_id(s)) ^ (doc_id or 0)) & ((1 << size) - 1)
                    if bits[h >> 3] >> (h & 7) & 1:
                        found[sid] = s
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["sid", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(load, "sid long, hashes binary")


def _of_sets(hashes: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``hashes`` whose set is among ids (column sid), and now and then another one: a filter of bits picks them where they are read."""
    size = filter_bits(ids.count())
    shared = hashes.sparkSession.sparkContext.broadcast(key_filter(ids.select(F.pmod("sid", F.lit(1 << size)).alias("h")), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            h = batch.column("sid").to_numpy(zero_copy_only=False) & ((1 << size) - 1)
            yield batch.filter(pa.array(bits[h >> 3] >> (h & 7).astype(np.uint8) & 1 == 1))

    return scratch.write(hashes.mapInArrow(run, "sid long, hashes binary"), "hashes-large")


def _linked(pairs: DataFrame, hashes: DataFrame, spec: JaccardSpec) -> DataFrame:
    """Those of the pairs (a, b) whose similarity reaches the threshold, by exact intersection."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(spec.den * both >= spec.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(hashes.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(hashes.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def linked_documents(docs: DataFrame, spec: JaccardSpec, sets_of: SetsOf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, and first: whether the row is the one of its component with the
    smallest id (and, of rows of that id, the least hash of the text). Rows without a set are components of their own."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    every = scratch.write(_sets(docs, spec, sets_of, scratch), "documents")
    first = lambda c: F.first(c).alias(c)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    sets = every.where("sid is not null").groupBy("sid").agg(least.alias("least"), first("n"), first("sig"), first("wide"), first("prefix"))
    seen = Observation()
    sets = sets.select("sid", F.col("least.doc_id").alias("first_id"), "least", "n", "sig", "wide", "prefix")
    sets = scratch.write(sets.observe(seen, F.count("*").alias("n")), "sets")
    postings = scratch.write(_postings(sets.select("sid", F.explode("prefix").alias("token"))), "postings")
    banded = scratch.write(_banded(postings.where(F.col("c") > FEW), sets, spec), "banded")

    few = postings.where(F.col("c") <= FEW).select("token", "sid").unionByName(banded.where(F.col("c") <= FEW).select("token", "sid"))
    few = few.join(sets.where(F.size("prefix") > 0).select("sid", "n", "sig"), "sid")
    few = few.select("token", "sid", "n", "sig").repartition("token").sortWithinPartitions("token")
    pairs = scratch.write(_near(few.mapInArrow(_pairs_of_few(spec), "a long, b long").distinct(), sets, spec), "pairs")
    banded = banded.where(F.col("c") > FEW)
    tiled = components(banded.select(F.col("node").alias("a"), F.col("least").alias("b")), scratch, "tiles").withColumnRenamed("root", "tile")
    tiled = tiled.join(banded.select("node", "sid").distinct(), "node").select("sid", "tile").distinct()
    tiled = scratch.write(tiled.join(sets.select("sid", "n", "sig", "prefix"), "sid"), "tiled")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(tiled.select("sid")).distinct()
    hashes = scratch.write(_hashes(docs, wanted, sets, sets_of, scratch), "hashes")
    sizes = scratch.write(tiled.groupBy("tile").agg(F.count("*").alias("c")), "sizes")
    big = sizes.where(F.col("c") > TILE).select("tile")
    small = tiled.join(big, "tile", "left_anti").select("tile", F.lit(0).cast("long").alias("part"), "sid", "n", "sig", F.lit(0).alias("side"), F.col("sid").alias("grp"))
    found, members = [], small
    if not big.isEmpty():
        large = scratch.write(tiled.join(big, "tile"), "large")
        found, rest = _large_links(large, _of_sets(hashes, large.select("sid").distinct(), scratch), spec, scratch)
        members = members.unionByName(rest) if rest is not None else members
    links = scratch.write(_linked(pairs, hashes, spec).unionByName(_tile_links(members, hashes, spec).select("a", "b")), "links")
    found = components(reduce(DataFrame.unionByName, found, links), scratch, "groups")
    scratch.drop("hashes", "hashes-large", "ends", "links", "pairs", "postings", "banded", "tiled", "sizes", "large", "strays", *(f"{t}-{i}" for t in ("large", "grouped") for i in range(ROUNDS)))

    named = sets.select("sid", "least").join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("f"), F.count("*").alias("n"))
    named = scratch.write(join_hot(named.select("sid", "root"), roots, "root", seen.get["n"] or 0).select("sid", "f"), "named")
    copies = every.groupBy("sid").agg(F.count("*").alias("n")).where("sid is not null")
    rows = every.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "sid")
    lone = rows.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"), "text_hash")
    tied = join_hot(rows, named.join(copies, "sid"), "sid", every.count())
    is_first = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash"))
    return tied.select("doc_id", "n_shingles", F.col("f.doc_id").alias("component_id"), is_first.alias("first"), "text_hash").unionByName(lone)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included).

    A text is lower-cased for A-Z and cut into words at ASCII white space; its set holds its different k-word shingles, or its
    whole sequence if it has fewer words. Two documents link when 100 * intersection >= percent * union. A null, empty or
    wordless text has 0 shingles and no links, its component is its own id. Repeated rows are rows of their own that link;
    null ids come after all others, and a component of null ids only has null.

    How: equal sets are one set (copies are never paired). Sets that share one of their first n - ceil(t n) + 1 shingles, in
    an order of about their counts, rare ones first, are compared, so no pair is left out. Where few sets share a shingle, their pairs are
    listed, unless the bits of their signatures bound the overlap below the threshold; wide signatures sort out more, and
    the rest is decided by intersecting sorted hashes. Sets that share a shingle with many, such as groups of near copies,
    are gathered into tiles (connected by such shingles within a band of size), whose sets come with
    their hashes: there a set is compared only with sets that it isn't connected with yet, so a tile of m sets gives less
    than m links. Exact up to equal 64-bit hashes of different shingles and equal ids of different sets.
    """
    found = linked_documents(docs, JaccardSpec(k, percent), partial(shingle_sets, k=k), id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component of jaccard_components: that of the smallest id, of rows of one
    id that of the least hash of the text. Rows that repeat both id and text stay or go together; rows without words stay;
    rows with a null id stay, and no row goes because of them. An empty table stays empty. Only rows to go are joined back, by id and hash of the
    text, so other texts of the same id are not touched."""
    found = linked_documents(docs.where(F.col(id_col).isNotNull()), JaccardSpec(k, percent), partial(shingle_sets, k=k), id_col, text_col)
    gone = found.where("not first").select(F.struct("doc_id", "text_hash").alias("gone")).distinct()
    mark = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"))
    rows = docs.select(F.struct("*").alias("row"), mark.alias("mark"))
    return rows.join(gone, F.col("mark") == F.col("gone"), "left_anti").select("row.*")
