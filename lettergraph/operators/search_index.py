"""A trigram index for search: from each run of three letters to the messages that hold it.

The index is a table of postings.  A block has the ids of one trigram with the same
``id >> 16``: at most 65,536 of them whatever the trigram, as sorted gaps of two bytes.
Blocks are dealt over folders by trigram and, within one, over files by range of ids, so
a trigram that most messages hold is many blocks in many files.  New messages come as a
further segment; ``merge`` makes one of all.  Both are commits of versioned tables, so a
search sees whole segments.

A search takes a few of the rarest trigrams of each word it looks for, reads their blocks
alone, and has the messages they leave judged by the search itself.  Blocks only leave
messages out that cannot match, so results are those of a scan, as long as every message
was indexed as it stands; blocks of messages that are gone or changed do no harm.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettergraph.functions.query import parse
from lettergraph.operators import search as scan
from lettergraph.shared import small_batches
from lettergraph.versions import Manifest, Versions

BUCKETS = 32
RARE = 4  # trigrams of a word that are looked up
FEW = 1_000  # ids that are pushed down to the scan of the messages
_TEXTS = ("subject", "body")


def trigram(letters: str) -> int:
    """Three letters as one number, 21 bits each."""
    return reduce(lambda n, c: n << 21 | ord(c), letters, 0)


def trigrams_of(needle: str) -> list[int]:
    """The different trigrams of a word as the search compares it."""
    low = needle.lower()
    return sorted({trigram(low[i : i + 3]) for i in range(len(low) - 2)})


def trigrams(*texts: Column) -> Column:
    """The different trigrams of each text, all together; no trigram spans two texts."""

    @F.arrow_udf("array<bigint>")
    def run(*columns: pa.Array) -> pa.Array:
        found, sizes = [np.zeros(0, dtype=np.int64)], []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            grams = []
            for text in row:
                c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
                if len(c) > 2:
                    grams.append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
            own = np.unique(np.concatenate(grams)) if grams else found[0]
            found.append(own)
            sizes.append(len(own))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(found)))

    return run(*[F.lower(t) for t in texts])


@F.arrow_udf(T.BinaryType())
def _gaps(lows: pa.Array) -> pa.Array:
    """Sorted numbers below 65,536 as differences to the one before, two bytes each."""
    edges, flat = np.asarray(lows.offsets), np.asarray(lows.values)
    step = np.diff(flat, prepend=0)
    first = edges[:-1][np.diff(edges) > 0]
    step[first] = flat[first]
    return pa.Array.from_buffers(pa.binary(), len(lows), [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(step.astype("<u2"))])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _lows(gaps: pa.Array) -> pa.Array:
    """The numbers that ``_gaps`` coded."""
    raw = gaps.to_pylist()
    edges = np.concatenate([[0], np.cumsum([len(g) // 2 for g in raw])])
    total = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(raw), dtype="<u2").astype(np.int64))])
    flat = total[1:] - np.repeat(total[edges[:-1]], np.diff(edges))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _blocks(ids: DataFrame) -> DataFrame:
    """Blocks of (gram, high, lows): bucket, gram, high, n, gaps."""
    bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
    return ids.select(bucket.alias("bucket"), "gram", "high", F.size("lows").alias("n"), _gaps(F.col("lows")).alias("gaps"))


def postings(m: DataFrame, columns: tuple[str, ...] = _TEXTS) -> DataFrame:
    """Blocks of all messages; rows with a null id are left out, a null text has no trigrams."""
    each = m.where("id IS NOT NULL").select("id", F.explode(trigrams(*map(F.col, columns))).alias("gram"))
    lows = F.sort_array(F.collect_set(F.col("id").bitwiseAND(F.lit(0xFFFF)).cast("int")))
    return _blocks(each.groupBy("gram", F.shiftright("id", 16).alias("high")).agg(lows.alias("lows")))


def merged(blocks: DataFrame) -> DataFrame:
    """One block where several segments have the same ids' range."""
    lows = F.sort_array(F.array_distinct(F.flatten(F.collect_list("lows"))))
    return _blocks(blocks.select("gram", "high", _lows("gaps").alias("lows")).groupBy("gram", "high").agg(lows.alias("lows")))


def _sizes(m: DataFrame, subject_weight: float) -> DataFrame:
    return m.agg(F.count("*").alias("n"), F.coalesce(F.sum(scan.weighted_size(subject_weight)), F.lit(0.0)).alias("size"))


class SearchIndex:
    """Postings and message counts in a folder of versioned tables."""

    def __init__(self, versions: Versions, subject_weight: float = 3.0):
        self.versions, self.subject_weight = versions, subject_weight
        small_batches(versions.spark, megabytes=4)  # a block's ids take a dozen times its bytes while they are decoded

    def _put(self, blocks: DataFrame) -> dict:
        dealt = blocks.repartition("bucket", F.shiftright("high", 6)).sortWithinPartitions("bucket", "gram", "high")
        return self.versions.put(dealt, "postings", ("bucket",))

    def add(self, m: DataFrame) -> Manifest:
        """A segment of new messages."""
        base = self.versions.at()
        changes = {"postings": self._put(postings(m)), "sizes": self.versions.put(_sizes(m, self.subject_weight), "sizes")}
        return self.versions.commit(base, changes, add=True)

    def merge(self) -> Manifest:
        """All segments as one; searches that began before go on with theirs."""
        base = self.versions.at()
        read = lambda t: self.versions.read(t, base)
        sizes = read("sizes").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        return self.versions.commit(base, {"postings": self._put(merged(read("postings"))), "sizes": self.versions.put(sizes, "sizes")})

    def blocks_of(self, grams: list[int], version: Manifest | None = None) -> DataFrame:
        """The blocks of some trigrams: folders are chosen by bucket, row groups by trigram."""
        blocks = self.versions.read("postings", version)
        buckets = blocks.sparkSession.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(g)), F.lit(BUCKETS)).cast("int") for g in grams]).alias("b")).first().b
        return blocks.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("gram").isin(grams))

    def candidates(self, needles: list[str], version: Manifest | None = None) -> DataFrame | None:
        """Ids of messages that hold all looked-up trigrams of any needle; None where a needle has none."""
        by_needle = {x: trigrams_of(x) for x in needles}
        if not needles or not all(by_needle.values()):
            return None
        every = sorted({g for grams in by_needle.values() for g in grams})
        # One number a trigram of the line.
        n = {r.gram: r.n for r in self.blocks_of(every, version).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        chosen = [sorted(grams, key=lambda g: (n[g], g))[:RARE] for grams in by_needle.values() if all(g in n for g in grams)]
        blocks = self.blocks_of(sorted({g for grams in chosen for g in grams}) or every[:1], version)
        ids = blocks.select("gram", (F.shiftleft(F.col("high"), 16)).alias("base"), F.explode(_lows("gaps")).alias("low")).select("gram", (F.col("base") + F.col("low")).alias("id"))
        held = ids.groupBy("id").agg(F.collect_set("gram").alias("g"))
        hit = [F.size(F.array_intersect("g", F.array(*map(F.lit, grams)))) == len(grams) for grams in chosen]
        return held.where(reduce(lambda a, b: a | b, hit) if hit else F.lit(False)).select("id")

    def _near(self, m: DataFrame, ids: DataFrame) -> DataFrame:
        """The messages with these ids: a few are pushed down to the scan, more are joined."""
        few = [r.id for r in ids.limit(FEW + 1).collect()]
        return m.where(F.col("id").isin(few)) if len(few) <= FEW else m.join(ids, "id", "left_semi")

    def matches(self, m: DataFrame, line: str, addresses: dict[str, str] | None = None) -> DataFrame:
        """As ``search.matches``; lines without a word of three letters are scanned, as no trigram tells of them."""
        ids = self.candidates(scan.needles(parse(line)), self.versions.at())
        return scan.matches(m if ids is None else self._near(m, ids), line, addresses)

    def search(self, m: DataFrame, line: str, limit: int = 50, addresses: dict[str, str] | None = None) -> DataFrame:
        """As ``search.search``."""
        return scan.best(self.matches(m, line, addresses), limit)

    def ranked(self, m: DataFrame, terms: list[str]) -> DataFrame:
        """As ``search.ranked``: how many messages there are and how long comes from the index."""
        version = self.versions.at()
        ids = self.candidates(terms, version)
        if ids is None:
            return scan.ranked(m, terms, self.subject_weight)
        facts = self.versions.read("sizes", version).agg(F.sum("n").alias("n"), (F.sum("size") / F.sum("n")).alias("mean"))
        return scan.ranked(self._near(m, ids), terms, self.subject_weight, facts=facts)
