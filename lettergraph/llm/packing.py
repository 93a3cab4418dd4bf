"""Best-fit packing: lower bounds by dual feasible functions certify each partition's number of bins.

A document's tokens are those of a public byte-level tokenizer, then the id ``END``.  Only
documents of more than ``capacity`` tokens are cut: the first piece takes the remainder
of the division, all others are full, so a document leaves one piece at most that does
not fill a sequence alone.

Pieces are dealt by a hash of their row over partitions of about ``partition_pieces``.
Each partition packs its pieces by best-fit decreasing and compares the number of bins
with the best of two families of dual feasible functions over its sizes: none can do
with fewer bins than such a bound, so where both agree the partition is certified and
stays as it is.  The others keep their full bins, hand their remaining pieces to a
common pool and are packed anew: the pool is dealt over fewer partitions by another
hash, so pieces meet others than before, and best-fit decreasing runs again, for
``rounds`` rounds or until nothing is left.  A round that needs more bins than it was
given is not taken.

Sizes are whole numbers up to ``capacity``, so best-fit decreasing goes by size: one
sweep over the bins' free room a size places all pieces of that size.  A partition
holds rows of five numbers; no text and no token travels.

Defined cases: a null text is empty and has the one token ``END``; texts of any length
are read whole; control strings of the tokenizer inside a text are ordinary text; rows
that repeat an id or a text are packed apart; an empty table has no pieces; extra
columns are not read.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.shared import discard, written

CAPACITY = 1024
END = 2
PARTITION_PIECES = 20_000
ROUNDS = 4
# Fixed value: how the byte-level tokenizers of this kind split a text before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts that ``tokenizers`` reads whole: with letters outside long-settled blocks, rare white space, or a space after white space or at the end.
_WHOLE = r"[^\x09-\x0d\x20-\x7e\x{a1}-\x{24f}\x{400}-\x{4ff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]|[\x09-\x0d\x20]( |$)"
_PIECES = 20_000
ROUNDS = 4
KNOWN_UNITS = 300_000
#: Spaces that can stand before a space; only texts without such a pair are cut into units.
_WIDE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]( |$)"
_PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids:binary>>"
_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


class Tokens:
    """Token ids of texts, those that the library ``tokenizers`` gives for a byte-level vocabulary.

    A unit is a space and what follows it up to the next one.  No token goes on over the start of a unit whose predecessor
    ends in another letter than white space, so a text's ids are those of its units, and the different units of a batch are
    coded once.  That is done by the merges of the same file in ``tiktoken``, which is faster; texts with anything on which
    the two libraries could differ are read whole by ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # control strings inside texts are ordinary text
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others come after 255
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        if any(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] != 256 + i for i, m in enumerate(model["model"]["merges"])):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
        self.units = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, by row; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.asarray(pc.match_substring_regex(texts, _WHOLE))
        parts = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        edges = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        head = np.zeros(edges[-1], dtype=bool)
        head[edges[:-1]] = True
        flat = parts.flatten()
        heads = iter(self.units.encode_ordinary(h) for h in flat.filter(pa.array(head)).to_pylist())
        units = flat.filter(pa.array(~head)).dictionary_encode()  # none is empty: no space follows another
        names = units.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], type=pa.int32()), names), " ")[0].as_py()
        ids = np.array(self.units.encode_ordinary(f" {joined}") if len(names) else [], dtype=np.uint32)
        starts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
        if len(starts) != len(names) + 1:
            raise ValueError("the vocabulary does not keep units apart")
        unit = np.asarray(units.indices)
        size = starts[unit + 1] - starts[unit]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat_ids = ids[np.repeat(starts[unit] - ends[:-1], size) + np.arange(ends[-1])]
        cut = ends[edges - np.arange(len(edges))]  # where each text's units end
        row = 0
        for at in range(len(texts)):
            if whole[at]:
                yield np.array(self.whole.encode(texts[at].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield np.concatenate([np.array(next(heads), dtype=np.uint32), flat_ids[cut[row] : cut[row + 1]]])
                row += 1


_TOKENS: dict[str, Tokens] = {}


def token_pieces(docs: DataFrame, tokenizer: str, text_col: str = "text", capacity: int = CAPACITY, out: str = "pieces") -> DataFrame:
    """``docs`` with array ``out``: piece, start (tokens before it), length and ids (little-endian unsigned 32-bit numbers)."""

    @F.arrow_udf(_PIECES)
    def run(text: pa.Array) -> pa.Array:
        if tokenizer not in _TOKENS:
            _TOKENS[tokenizer] = Tokens(tokenizer)
        rows = []
        for ids in _TOKENS[tokenizer].of(text):
            ids = np.append(ids, np.uint32(END)).astype("<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
            rows.append([{"piece": i, "start": s, "length": e - s, "ids": ids[s:e].tobytes()} for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))])
        return pa.array(rows, type=pa.list_(_PIECE))

    return docs.withColumn(out, run(F.col(text_col)))


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins that dual feasible functions prove for ``counts[s]`` pieces of size s.

    Two families over integers, both with values that no bin's pieces can sum above one: pieces over ``capacity - t`` count as
    whole and those under t as nothing, for every t up to half; and sizes rounded to parts of k + 1, for k up to 20.
    """
    sizes, n = np.flatnonzero(counts), counts[np.flatnonzero(counts)]
    if not len(sizes):
        return 0
    best = -(-int((sizes * n).sum()) // capacity)
    edges = np.arange(capacity + 1)
    total, number = np.zeros(capacity + 2, dtype=np.int64), np.zeros(capacity + 2, dtype=np.int64)
    np.add.at(total, sizes + 1, sizes * n)
    np.add.at(number, sizes + 1, n)
    total, number = np.cumsum(total), np.cumsum(number)  # of sizes below the index
    t = edges[: capacity // 2 + 1]
    middle, large = total[capacity - t + 1] - total[t], number[-1] - number[capacity - t + 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 21):
        exact = sizes * (k + 1) % capacity == 0
        value = np.where(exact, sizes * k, sizes * (k + 1) // capacity * capacity)  # of k * capacity
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each piece and the free room of each bin."""
    order = np.argsort(-length, kind="stable")
    sizes, starts = np.unique(-length[order], return_index=True)
    where, offset = np.empty((2, len(length)), dtype=np.int64)
    free: dict[int, list[np.ndarray]] = {}  # room: bins
    bins = 0
    for size, lo, hi in zip((-sizes).tolist(), starts.tolist(), [*starts[1:].tolist(), len(length)], strict=True):
        todo = order[lo:hi]
        for room in sorted(r for r in free if r >= size):
            if not len(todo):
                break
            open_ = np.concatenate(free.pop(room))
            each = room // size  # the fullest bin that fits takes pieces until it fits no more
            used = open_[: -(-len(todo) // each)]
            if len(open_) > len(used):
                free[room] = [open_[len(used) :]]
            todo = _place(todo, used, each, room, size, capacity, where, offset, free)
        if len(todo):
            each = capacity // size
            used = np.arange(bins, bins + -(-len(todo) // each))
            bins += len(used)
            _place(todo, used, each, capacity, size, capacity, where, offset, free)
    rooms = np.zeros(bins, dtype=np.int64)
    for room, some in free.items():
        for b in some:
            rooms[b] = room
    return where, offset, rooms


def _place(todo: np.ndarray, used: np.ndarray, each: int, room: int, size: int, capacity: int, where: np.ndarray, offset: np.ndarray, free: dict) -> np.ndarray:
    """Put pieces of one size into bins of one room, ``each`` a bin; what is left over."""
    now, later = todo[: len(used) * each], todo[len(used) * each :]
    nth = np.arange(len(now))
    where[now], offset[now] = used[nth // each], capacity - room + nth % each * size
    taken = np.bincount(nth // each, minlength=len(used))
    for n in np.unique(taken).tolist():
        free.setdefault(room - n * size, []).append(used[taken == n])
    return later


def _packed(capacity: int, round_: int):
    """Pack each partition's pieces (sorted by partition): bins, certificates and what goes to the pool."""
    kind = pa.schema([("uid", pa.int64()), ("length", pa.int64()), ("part", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bins", pa.int64()), ("bound", pa.int64()), ("settled", pa.bool_())])

    def pack(part: int, uid: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(uid)  # the same bins whatever order the rows come in
        uid, length = uid[order], length[order]
        where, offset, rooms = best_fit(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        settled = np.full(len(uid), True) if bound == len(rooms) else rooms[where] == 0
        ids = (round_ << 54) + (part << 27) + where
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, length, np.full(len(uid), part), ids, offset, np.full(len(uid), len(rooms)), np.full(len(uid), bound), settled)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            part, uid, length = (np.asarray(batch.column(k)) for k in ("part", "uid", "length"))
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if part[lo] != current and held:
                    yield pack(current, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                current = int(part[lo])
                held.append((uid[lo:hi], length[lo:hi]))
        if held:
            yield pack(current, *map(np.concatenate, zip(*held, strict=True)))

    return run, ", ".join(f"{f.name} {'boolean' if f.name == 'settled' else 'bigint'}" for f in kind)


def packed(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(uid, sequence_id, offset) for rows (uid, length) with different uids; lengths are 1 to ``capacity``."""
    spark = pieces.sparkSession
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    out = [pieces.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    given = None  # bins that hold the pool now, and the rows that say where
    for round_ in range(rounds):
        n = rest.count()
        if not n:
            break
        parts = max(1, math.ceil(n / partition_pieces))
        dealt = rest.select("uid", "length", F.pmod(F.xxhash64(F.lit(round_), F.col("uid")), F.lit(parts)).alias("part"))
        run, schema = _packed(capacity, round_)
        tasks = min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
        now = written(dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema), "packed")
        bins = now.groupBy("part").agg(F.max("bins").alias("b")).agg(F.sum("b")).first()[0]
        if given is not None and bins >= given[0]:
            discard(now)
            break
        open_ = now.where("NOT settled")
        if given is not None:
            out.pop()  # the pool's bins of the round before
        out += [now.where("settled").select("uid", "sequence_id", "offset"), open_.select("uid", "sequence_id", "offset")]
        left = open_.agg(F.count_distinct("sequence_id")).first()[0]
        given, rest = (left,), open_.select("uid", "length")
    result = out[0]
    for part in out[1:]:
        result = result.union(part)
    return result


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the tokens of each sequence joined in order, with where each document's piece begins.

    A sequence holds ``capacity`` tokens at most, so no group grows.
    """
    part = F.struct("offset", "ids", "doc_id", "piece")
    rows = pieces.join(placed, "uid").groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select(
        "sequence_id", F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("documents"),
    )


def exploded_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: uid, doc_id, piece, start, length, ids.  Number them once, when they are written: uid follows the row's place."""
    each = token_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer, "text", capacity).select("doc_id", F.explode("pieces").alias("p"))
    return each.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "p.*")
