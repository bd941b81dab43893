"""Tokenization, the bit-plane store and packing: exact round trips and small optima."""

from __future__ import annotations

import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import packing, token_store, tokens
from tidegraph.llm.common import materialise, scratch_path
from tidegraph.llm.queries_tokens import pack_documents, vocabulary

VOCABULARIES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def plain_ids(name, texts):
    """By the library alone."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(x.ids, dtype="<u4").tobytes() for x in found]


@pytest.mark.parametrize(("name", "keeps_space"), VOCABULARIES)
def test_encoder_is_exact(name, keeps_space, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    r = random.Random(7)
    parts = ["a", "Ab", chr(233), "e" + chr(0x301), " ", "  ", "\n", "\t", chr(160), chr(28), chr(0x85), "'s", "don't", "12", "!", "<|endoftext|>",
             chr(0x3A3), chr(0x391) + chr(0x3A3), chr(0x130), chr(0x65E5), chr(0x1F600), chr(0x200B), "\r\n", ".", ",", chr(0x2028), " ", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)] + [None, "", " ", "x" * 5000, " ".join(["word,"] * 3000)]
    made = tokens.Encoder(vocabulary(name), keeps_space)
    got = [ids for at in range(0, len(texts), 500) for ids in made.encode_block(texts[at : at + 500])]
    assert got == plain_ids(name, texts)
    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(len(texts))), "t": pa.array(texts, pa.string())})
    assert [ids for block in made.encode_rows(batch) for _, ids in block] == got


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_and_shards(unit, tmp_path):
    r = np.random.default_rng(1)
    for ids in ([], [0], [0, 0], [2**32 - 1, 0, 5], r.integers(0, 50257, 1001), r.integers(0, 2**32, 77)):
        ids = np.array(ids, dtype="<u4")
        assert (token_store.from_planes(token_store.to_planes(ids, unit), len(ids), unit) == ids).all()
    docs = [(i, r.integers(0, 60000, n).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 500, 64, 0, 3, 129, 0])]
    sink = io.BytesIO()
    writer = token_store.ShardWriter(sink, unit, chunk_ids=64)
    for doc in docs:
        writer.add(*doc)
    writer.close()
    shard = token_store.Shard.open(pa.BufferReader(sink.getvalue()))
    assert [(d, ids) for d, _, ids in shard.documents()] == docs
    with pytest.raises(ValueError, match="cut short"):
        token_store.Shard.open(pa.BufferReader(sink.getvalue()[:-3]))


def test_store_round_trip(spark):
    texts = ["Hello world, hello", None, "", "b " * 3000, "Hello world, hello", "last"]
    rows = [(i, t, "clash") for i, t in zip([5, 3, 3, 9, None, 1], texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    folder = scratch_path(spark, "t")
    written = materialise(token_store.write_tokens(df, folder, vocabulary("byte_bpe_50k.json"), True, shards=3), "w")
    got = sorted(token_store.read_tokens(spark, folder, written).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None, 1, 3, 3, 5, 9]
    end = np.zeros(1, dtype="<u4").tobytes()
    assert Counter((x.doc_id, bytes(x.tokens)) for x in got) == Counter((i, ids + end) for (i, _, _), ids in zip(rows, plain_ids("byte_bpe_50k.json", texts), strict=True))
    at = 0
    for x in got:
        assert x.start == at
        at += len(x.tokens) // 4
    empty = materialise(token_store.write_tokens(df.limit(0), scratch_path(spark, "t"), vocabulary("byte_bpe_50k.json"), True), "w")
    assert empty.agg(F.sum("total")).first()[0] in (None, 0)


def best_possible(items, size):
    """The least number of sequences, by trying everything."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                left = rooms.copy()
                left.remove(room)
                go(i + 1, [*left, room - items[i]])
        go(i + 1, [*rooms, size - items[i]])

    go(0, [])
    return best


def test_plan_is_valid_and_nearly_best():
    r = random.Random(2)
    over = 0
    for _ in range(300):
        size = r.choice([10, 20, 50])
        items = [r.randint(1, size) for _ in range(r.randint(0, 9))]
        patterns = packing.plan(dict(Counter(items)), size)
        assert all(sum(p) <= size for p, _ in patterns)
        assert Counter(n for p, t in patterns for n in p * t) == Counter(items)
        used = sum(t for _, t in patterns)
        fixed, left = packing.reduce_dominated(dict(Counter(items)), size)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + best_possible(rest, size) == best_possible(items, size)  # reduction loses nothing
        over += used - best_possible(items, size)
    assert over <= 6


def test_reduction_fixes_one_two_or_three():
    assert packing.reduce_dominated({50: 3, 26: 1, 24: 1}, 100)[0] == [((50, 50), 1), ((50, 26, 24), 1)]
    assert packing.reduce_dominated({70: 1, 30: 1, 20: 1, 10: 3}, 100)[0][0] == ((70, 30), 1)
    assert packing.reduce_dominated({90: 2, 60: 2, 35: 1, 33: 1}, 100)[0][:2] == [((90,), 2), ((60, 35), 1)]
    assert packing.reduce_dominated({40: 1, 5: 30}, 100) == ([], {40: 1, 5: 30})  # many small pieces: nothing is certain
    assert packing.reduce_dominated({}, 100) == ([], {})


def test_plan_is_fast_at_any_count():
    r = random.Random(4)
    patterns = packing.plan({n: r.randint(1, 10**9) for n in range(1, 2049)})
    assert len(patterns) < 20_000


def test_pack_documents(spark):
    texts = ["hello world"] * 5 + [None, "", "w " * 5000, " ".join(map(str, range(900)))] + ["x " * n for n in range(1, 60)]
    df = spark.createDataFrame([(i % 60, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, length int").repartition(3)
    got = pack_documents(df).collect()
    wanted = Counter()
    end = np.zeros(1, dtype="<u4").tobytes()
    for (i, _), ids in zip(enumerate(texts), plain_ids("word_bpe_49k.json", texts), strict=True):
        for k, at in enumerate(range(0, len(ids + end), 4 * 2048)):
            part = (ids + end)[at : at + 4 * 2048]
            wanted[i % 60, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == wanted
    sequences = defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(x.length for x in got) // 2048)
    assert pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "keeps_space"), VOCABULARIES)
def test_added_tokens_are_found_in_texts(name, keeps_space):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(name))
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b c", "<|startoftext|>x\ny <|endoftext|>", "<|endoftext|", "no token, here", None]
    got = list(tokens.Encoder(vocabulary(name), keeps_space).encode_block(texts))
    assert got == [np.array(x.ids, dtype="<u4").tobytes() for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert plain.token_to_id("<|endoftext|>") in np.frombuffer(got[0], dtype="<u4")
