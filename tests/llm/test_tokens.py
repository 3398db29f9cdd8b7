import hashlib

import brute
import public_tokenizers
import pytest

from quire.llm.byte_bpe import BytePairCoder, PerfectHash, encode_documents, read_ranks
from quire.llm.packing import cut_plan, pack, tail_plan
from quire.llm.token_count import count_tokens


def test_counts_are_the_librarys(odd, odd_rows):
    want = brute.token_counts(odd_rows)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == want


def test_piece_model_counts(odd, odd_rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(odd, path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in odd_rows}


def test_counts_of_nothing(none):
    assert count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@pytest.fixture(scope="module")
def coder():
    return BytePairCoder(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_is_the_librarys_and_goes_back(odd, odd_rows, coder):
    want = brute.bpe(odd_rows)
    rows = encode_documents(odd, coder, keep_ids=True).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert {r.doc_id: r.decoded for r in rows} == {i: t or "" for i, t in odd_rows}


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = {f"key{i}".encode(): i for i in range(1000)}
    table = PerfectHash(keys)
    assert sorted(table.values) == list(range(1000)) and all(table.get(k) == v for k, v in keys.items())
    assert table.get(b"other") is None and PerfectHash({}).get(b"x") is None


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append(r)
    return out.values()


def test_packing_holds_every_id_once(odd, odd_rows):
    ids = brute.packed_ids(odd_rows)
    rows = pack(odd, public_tokenizers.path("word_bpe_49k.json"), window=256).collect()
    parts = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and brute.crc(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, spans in parts.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert set(parts) == set(ids)
    for rows in sequences(rows):
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256


def test_packing_nothing(none):
    assert pack(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_plan_is_the_cheapest():
    import itertools

    import numpy as np

    places, prices, total, window = [3, 5, 6, 9, 11], [0, 4, 1, 0, 2], 13, 7
    cost = dict(zip(places, prices)) | {total: 0}

    def value(ends):
        starts = [0, *ends[:-1]]
        return None if any(b - a > window for a, b in zip(starts, ends)) else sum(window - (b - a) + cost[b] for a, b in zip(starts, ends))

    every = [[*c, total] for k in range(len(places) + 1) for c in itertools.combinations(places, k)]
    best = min(v for e in every if (v := value(e)) is not None)
    assert value(cut_plan(np.array(places), np.array(prices), total, window)) == best


def test_tail_ends_in_powers_of_two_if_that_is_cheap():
    assert tail_plan(0, 4096, 4096) == [4096]
    assert tail_plan(10, 10 + 2048, 4096) == [10 + 2048]
    assert tail_plan(0, 2049, 4096) == [2048, 2049]
    assert tail_plan(0, 4095, 4096) == [4095]


#: What texts of a fuzz test are made of: all of ASCII, special strings, blanks, letters that grow in lower case or are new.
CRUMBS = [*map(chr, range(128)), *" \n  \n. ,", "<|endoftext|>", "<|startoftext|>", *"éÉßİıŁñŉ×÷", "e\u0301", *"日本語。、「", "\u3000", "\u00a0", "\u2003", "😀", "\u1100", "\U0001e6f4", "\U00018f98", "\U0001df40", "\U00018ee4", "\u0558", "the", " of", "word ", "'s", "12"]


@pytest.fixture(scope="module")
def crumbled():
    import random

    r = random.Random(11)
    texts = ["".join(r.choice(CRUMBS) for _ in range(r.randrange(12))) for _ in range(20_000)]
    # ends that are blanks: alone, last of a batch, last of a slice of 1 MB
    return texts + ["A line that ends with a line feed.\n", "abc ", " ", "\n", "a" * ((1 << 20) - 1) + " ", "b" * (1 << 20) + " ", "İ.", "def", "abc "]


def arrow(texts):
    import pyarrow as pa

    return pa.array(texts, pa.large_string())


def test_fuzzed_counts_are_the_librarys(crumbled):
    from tokenizers import Tokenizer

    from quire.llm.token_count import lengths

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    want = [len(x.ids) for x in model.encode_batch(crumbled, add_special_tokens=False)]
    for at in range(0, len(crumbled), 997):
        assert lengths(arrow(crumbled[at : at + 997]), path).tolist() == want[at : at + 997]


def test_fuzzed_ids_of_packing_are_the_librarys(crumbled):
    from tokenizers import Tokenizer

    from quire.llm.packing import tokenize

    path = public_tokenizers.path("word_bpe_49k.json")
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(crumbled, add_special_tokens=False)]
    for at in range(0, len(crumbled), 997):
        ids, starts, *_ = tokenize(arrow(crumbled[at : at + 997]), path)
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == want[at : at + 997]
    for t in ("abc ", " ", "\n", "İ."):  # each alone in its batch
        assert tokenize(arrow([t]), path)[0].tolist() == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids


def test_fuzzed_bpe_is_the_librarys(crumbled):
    coder = BytePairCoder(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, units=True)
    want = brute.bpe(enumerate(crumbled))
    for at in range(0, len(crumbled), 997):
        ids, starts = coder.encode(arrow(crumbled[at : at + 997]))
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:]), at):
            assert (b - a, hashlib.sha256(ids[a:b].tobytes()).hexdigest()) == want[i][:2], crumbled[i]
