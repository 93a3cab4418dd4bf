"""Packing against the tokenizer on whole texts, plain best-fit decreasing and all packings of small sets."""
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lettergraph.llm import packing
from lettergraph.shared import written

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts(seed, n=150):
    r = random.Random(seed)
    bits = ["word", "don't", "it's", "É", "日本", "x1", "12", "...", "\n", "\t", "  ", " ", " ", " ", "\u0085", "\x1c", "<|endoftext|>", "Ġ", "🙂", "é", "\r\n", "'s", "-"]
    made = ["".join(r.choice(bits) + r.choice(["", " ", " ", " "]) for _ in range(r.randrange(30))) for _ in range(n)]
    return [*made, None, "", " ", "  ", " a", "a ", "a\n", "a\n\n", "a \n b", "a\n b", "long" * 3000, "x " * 5000, *made[:3]]


def test_tokens_are_those_of_whole_texts(plain):
    tokens = packing.Tokens(PATH)
    for seed in range(8):
        batch = texts(seed)
        for text, ids in zip(batch, tokens.of(pa.array(batch)), strict=True):
            assert ids.tolist() == plain(text), repr(text)
    assert list(tokens.of(pa.array([], type=pa.string()))) == []
    assert [x.tolist() for x in tokens.of(pa.array(["", None, "a\u00a0 b"]))] == [[], [], plain("a\u00a0 b")]
    assert [x.tolist() for x in tokens.of(pa.array(["skipped", "a b c", "d"]).slice(1))] == [plain("a b c"), plain("d")]


def test_tokens_of_all_letters_that_are_not_read_whole(plain):
    """Every letter of the settled blocks, beside others of its block, with digits, marks and spaces between."""
    tokens, r = packing.Tokens(PATH), random.Random(5)
    blocks = [(0x21, 0x7E), (0xA1, 0x24F), (0x400, 0x4FF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    made = []
    for lo, hi in blocks:
        some = [chr(c) for c in range(lo, hi + 1)]
        some = r.sample(some, min(len(some), 600))
        r.shuffle(some)
        text = "".join(c + r.choice(["", "", " ", "1", ".", "'s", "\n", "\t", "x"]) for c in some)
        made += [text, *text.split(" ")]
    assert not any(packing.pc.match_substring_regex(pa.array([t.replace("\n ", "").replace("\t ", "").strip() for t in made]), packing._WHOLE).to_pylist())
    for text, ids in zip(made, tokens.of(pa.array(made)), strict=True):
        assert ids.tolist() == plain(text), repr(text)


@pytest.mark.parametrize("capacity", [1024, 8])
def test_pieces(spark, plain, capacity):
    rows = [(i, t, "x") for i, t in enumerate(texts(7, 40))]
    out = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string, pieces string"), PATH, capacity=capacity)
    assert out.columns == ["doc_id", "text", "pieces"]
    for r in out.collect():
        ids = [*plain(r.text), packing.END]
        assert [p.piece for p in r.pieces] == list(range(len(r.pieces)))
        assert [x for p in r.pieces for x in np.frombuffer(p.ids, dtype="<u4").tolist()] == ids
        assert all(p.length == len(p.ids) // 4 for p in r.pieces) and all(p.length == capacity for p in r.pieces[1:])
        assert [p.start for p in r.pieces] == [sum(q.length for q in r.pieces[:i]) for i in range(len(r.pieces))]
        assert 0 < r.pieces[0].length <= capacity and len(r.pieces) == -(-len(ids) // capacity)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 1024])
    lengths = [r.randrange(1, r.choice([capacity, capacity // 3 + 1]) + 1) for _ in range(r.randrange(1, 400))] + [capacity // 3] * (seed * 20)
    where, offset, rooms = packing.best_fit(np.array(lengths), capacity)
    assert sorted(rooms.tolist()) == plain_best_fit(lengths, capacity)
    held = {}
    for n, b, o in zip(lengths, where.tolist(), offset.tolist(), strict=True):
        held.setdefault(b, []).append((o, n))
    for b, some in held.items():
        at = 0
        for o, n in sorted(some):
            assert o == at
            at += n
        assert at == capacity - rooms[b]


def test_lower_bound_never_exceeds_the_optimum():
    @lru_cache(None)
    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        best = fewest(rest[1:], tuple(sorted([*rooms, 10 - rest[0]])))
        for r in set(rooms):
            if r >= rest[0]:
                left = list(rooms)
                left.remove(r)
                best = min(best, fewest(rest[1:], tuple(sorted([*left, r - rest[0]]))))
        return best

    r, tight = random.Random(3), 0
    for _ in range(150):
        lengths = sorted((r.randrange(1, 11) for _ in range(r.randrange(1, 9))), reverse=True)
        bound, best = packing.lower_bound(np.bincount(lengths, minlength=11), 10), fewest(tuple(lengths), ())
        assert -(-sum(lengths) // 10) <= bound <= best
        tight += bound == best
    assert tight > 140
    assert packing.lower_bound(np.bincount([6] * 7, minlength=11), 10) == 7  # the sum alone proves five
    assert packing.lower_bound(np.bincount([4] * 7, minlength=11), 10) == 4
    assert packing.lower_bound(np.zeros(11, dtype=np.int64), 10) == 0


@pytest.mark.parametrize(("partition", "rounds"), [(50, 4), (20_000, 4), (50, 1)])
def test_packed(spark, partition, rounds):
    r = random.Random(partition)
    lengths = [r.choice([r.randrange(1, 1025), 700, 1024, 343]) for _ in range(900)]
    pieces = written(spark.createDataFrame([(i * 7, n, "x") for i, n in enumerate(lengths)], "uid long, length long, part string"), "test-pieces")
    got = {x.uid: (x.sequence_id, x.offset) for x in packing.packed(pieces, partition_pieces=partition, rounds=rounds).collect()}
    assert len(got) == len(lengths) == packing.packed(pieces, partition_pieces=partition, rounds=rounds).count()
    held = {}
    for i, n in enumerate(lengths):
        s, o = got[i * 7]
        held.setdefault(s, []).append((o, n))
    for some in held.values():
        at = 0
        for o, n in sorted(some):
            assert o == at
            at += n
        assert at <= 1024
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025))
    single = len(plain_best_fit(lengths, 1024))
    assert bound <= len(held) <= (single if partition > 1000 else single * 1.02 if rounds > 1 else single * 1.1)


def test_sequences_hold_the_tokens(spark, plain):
    rows = [(i, t) for i, t in enumerate(texts(11, 30))]
    each = written(packing.exploded_pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH, capacity=64), "test-each")
    placed = packing.packed(each, capacity=64, partition_pieces=40)
    out = packing.sequences(each, placed).collect()
    tokens = {(r.doc_id, r.piece): r.ids for r in each.collect()}
    assert sum(len(r.documents) for r in out) == len(tokens)
    for r in out:
        ends = [d.offset * 4 for d in r.documents[1:]] + [len(r.ids)]
        assert len(r.ids) <= 256 and r.documents[0].offset == 0
        assert [bytes(r.ids[d.offset * 4 : e]) for d, e in zip(r.documents, ends, strict=True)] == [bytes(tokens[d.doc_id, d.piece]) for d in r.documents]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    each = written(packing.exploded_pieces(none, PATH), "test-none")
    assert packing.packed(each).collect() == [] and packing.sequences(each, packing.packed(each)).collect() == []
    one = written(packing.exploded_pieces(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH), "test-one")
    assert [(r.doc_id, r.piece, r.length) for r in one.collect()] == [(None, 0, 1)]
    assert one.select(F.crc32("ids")).count() == 1
