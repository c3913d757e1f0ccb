"""Encoder, packing and bit planes: exact against the tokenizers library, round trips, and the search's gains."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadlens.llm import bitplanes, packing
from threadlens.llm.common import shared_path
from threadlens.llm.encode import Encoder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ENCODERS = {p: Encoder(p, kept=64) for p in (BYTE, WORD)}  # so few that kept pieces go and come again


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list("aB é's\n\t 12.|中ßİ² ﬁ½\x1c“​\x85😀ñ<>")), max_size=40))
def test_encoder_equals_library(path, text):
    enc = ENCODERS[path]
    assert enc.encode(text) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", ENCODERS)
@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<unk>y <UNK>", "<|ENDOFTEXT|>", "<|endoftext|"])
def test_special_tokens_inside_a_text(path, text):
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert ENCODERS[path].encode(text) == np.array(want, "<u4").tobytes()


def ids_of(path, text, end):
    tok = Tokenizer.from_file(path)
    return tok.encode(text or "", add_special_tokens=False).ids + [end]


def test_pieces_and_sequences(odd, odd_rows, clashing):
    out = packing.pack(packing.pieces(clashing, WORD, most=300), capacity=300, shard_pieces=20).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = ids_of(WORD, text, 0)
        want += [(doc_id, k // 300, k, len(p := ids[k:k + 300]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 300)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 300


def test_pack_keeps_columns_and_rejects_long_rows(spark):
    table = spark.createDataFrame([(5, "x", 1), (3, "y", 2), (3, "y", 2)], "length int, uid string, shard int")
    out = packing.pack(table, capacity=8)
    assert out.columns == ["length", "uid", "shard", "sequence_id", "offset"] and out.count() == 3
    assert packing.pack(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="not within"):
        packing.pack(table, capacity=4).collect()


def brute_force(lengths, capacity):
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[k]}:
            left = list(rooms)
            left[left.index(r)] -= lengths[k]
            place(k + 1, left)
        place(k + 1, rooms + [capacity - lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fill_is_near_the_fewest_bins(lengths):
    sizes = np.array(sorted(lengths, reverse=True))
    bins, _ = packing.fill(sizes, 20)
    fewest = brute_force(sizes.tolist(), 20)
    assert fewest <= bins.max() + 1 <= fewest + 1


def test_search_only_gains():
    rng = np.random.default_rng(3)
    sizes = rng.integers(25, 60, 600)
    plain = packing.best_fit(sizes, 128)
    better = packing.improve([list(b) for b in plain], sizes, 128)
    assert sorted(i for b in better for i in b) == list(range(600))
    assert all(sizes[b].sum() <= 128 for b in better) and len(better) < len(plain)


@pytest.mark.parametrize("bits", [False, True])
@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 2 ** 32 - 1), max_size=70))
def test_planes_round_trip(bits, ids):
    ids = np.array(ids, np.uint32)
    assert (bitplanes.from_planes(bitplanes.to_planes(ids, bits), len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip(spark, clashing, odd_rows, bits):
    folder = bitplanes.write_ids(clashing, shared_path(spark, "ids"), BYTE, 2, chunk_ids=500, bits=bits)
    got = bitplanes.read_ids(spark, folder, with_ids=True).orderBy("start").collect()
    order = lambda i: (i is not None, i or 0)
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=order)
    want = sorted((order(r[0]), ids_of(BYTE, r[1], 2)) for r in odd_rows)
    assert sorted((order(r.doc_id), list(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens


def test_files_of_an_empty_table(spark, empty):
    folder = bitplanes.write_ids(empty, shared_path(spark, "ids"), BYTE, 2)
    assert bitplanes.read_ids(spark, folder).count() == 0 and packing.pieces(empty, WORD).count() == 0
