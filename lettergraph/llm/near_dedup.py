"""MinHash near-duplicates by tensored banding, links confirmed on full sets.

A document's set holds its distinct shingles of ``shingle`` words (A-Z
lower-cased, words ``[^\\x20\\x09-\\x0D]+``); a shorter text is one shingle; a text
without words has an empty set and no links.

Two collections of ``halves`` half keys, each of ``rows`` minhashes, stand for
``halves ** 2`` tables: table (i, j) is keyed by half i of the first and half j of
the second, so 100 tables of four hashes need 40 minhashes, not 400.  A pair with
similarity 0.8 meets in some table with probability 0.99993, one with 0.85 with
0.999995.

Equal sets form one class first.  In each bucket all classes are compared with
its smallest one, and verified links give components.  Of the buckets that still
hold more than one component, each class is then compared with every class of
another component that a prefix filter over the full sets leaves, which is exact.
No pair within a component is built, and no candidate is dropped.

Defined cases: null text is empty; texts of any length are read whole; an empty
table has no rows; null ids form no links and keep component null; each row is judged by its own text, and an id that repeats with different
texts may join their groups; ties fall to the smallest id.  Extra columns pass through; result columns replace
columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.llm._shared import free_name
from lettergraph.llm._words import SPACED, chunks, lists, mix
from lettergraph.llm.components import components
from lettergraph.shared import written

SHINGLE = 5
HALVES = 10
PERCENT = 80
ROWS = 2
_SIGNATURE = "struct<n:bigint,d1:bigint,d2:bigint,a:array<bigint>,b:array<bigint>>"


def _sets(texts: pa.Array, shingle: int):
    """(rows, flat sorted shingle hashes, size of each row's set) chunk by chunk."""
    for lo, hi, c in chunks(texts, SPACED, lower=True):
        n = np.diff(c.first)
        grams = c.grams(shingle)
        at = np.arange(len(c.hashes))
        doc = np.repeat(np.arange(hi - lo), n)
        whole = at + shingle <= c.first[1:][doc]
        values, owner = grams[at[whole]], doc[whole]
        for d in np.flatnonzero((n > 0) & (n < shingle)):
            size = int(n[d])
            values = np.append(values, mix(c.grams(size)[c.first[d] : c.first[d] + 1] + np.uint64(size)))
            owner = np.append(owner, d)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        yield hi - lo, values[new], np.bincount(owner[new], minlength=hi - lo)


def _reduce(ufunc, values: np.ndarray, sizes: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(sizes), empty, dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = ufunc.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def signatures(shingle: int = SHINGLE, halves: int = HALVES, rows: int = ROWS):
    """Arrow function of a text: set size, digest of the set, half keys of both collections."""
    seeds = mix(np.arange(1, 2 * halves * rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    @F.arrow_udf(_SIGNATURE)
    def run(text: pa.Array) -> pa.Array:
        parts: list[list] = [[], [], [], [], []]
        for n, values, sizes in _sets(text, shingle):
            parts[0].append(sizes.astype(np.int64))
            for k, salt in ((1, 0x51), (2, 0xA7)):
                parts[k].append(_reduce(np.add, mix(values + np.uint64(salt)), sizes, 0).view(np.int64))
            keys = []
            for first in range(0, len(seeds), rows):
                key = np.full(n, first + 1, dtype=np.uint64)
                for s in seeds[first : first + rows]:
                    hashed = values * s
                    hashed ^= hashed >> np.uint64(29)
                    hashed *= np.uint64(0xBF58476D1CE4E5B9)
                    hashed ^= hashed >> np.uint64(32)
                    key = mix(key ^ _reduce(np.minimum, hashed, sizes, 0))
                keys.append(key.view(np.int64))
            both = np.stack(keys, axis=1) if keys else np.zeros((n, 0), dtype=np.int64)
            parts[3].append(both[:, :halves].reshape(-1))
            parts[4].append(both[:, halves:].reshape(-1))
        flat = [np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]
        width = np.full(len(text), halves)
        return pa.StructArray.from_arrays(
            [pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2]), lists(flat[3], width), lists(flat[4], width)], names=["n", "d1", "d2", "a", "b"]
        )

    return run


def shingle_sets(shingle: int = SHINGLE):
    """Arrow function of a text: its set as sorted 64-bit fingerprints."""

    @F.arrow_udf("array<bigint>")
    def run(text: pa.Array) -> pa.Array:
        values, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for _, v, s in _sets(text, shingle):
            values.append(v.view(np.int64))
            sizes.append(s)
        return lists(np.concatenate(values), np.concatenate(sizes))

    return run


def _similar(percent: int):
    @F.arrow_udf("boolean")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x), dtype=bool)
        xs, ys = (np.asarray(v.flatten()).view(np.uint64) for v in (x, y))
        xo, yo = (np.concatenate([[0], np.cumsum(np.asarray(v.value_lengths().fill_null(0)))]) for v in (x, y))
        for i in range(len(x)):
            p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
            both = len(np.intersect1d(p, q, assume_unique=True))
            out[i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
        return pa.array(out)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"), F.col("n").alias("n_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"), F.col("n").alias("n_b"))
    sizes = sets.select("id", "n")
    near = (
        pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("m_a")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("m_b")), "b")
        .where(F.least("m_a", "m_b") * 100 >= F.greatest("m_a", "m_b") * percent).select("a", "b")
    )
    return near.join(left, "a").join(right, "b").where(_similar(percent)(F.col("set_a"), F.col("set_b"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, halves: int = HALVES,
                    rows: int = ROWS) -> DataFrame:
    """One row a document: id, n_shingles, component (smallest id reachable)."""
    signed = docs.select(F.col(id_col).alias("id"), signatures(shingle, halves, rows)(F.col(text_col)).alias("s")).select("id", "s.*")
    signed = written(signed, "signatures")
    classes = (
        signed.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n")
        .agg(F.min("id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"))
    )
    classes = written(classes.select("rep", "n", "d1", "d2", "a", "b"), "classes")

    def shared(side: str) -> DataFrame:
        half = classes.select("rep", F.posexplode(side).alias("i", "h"))
        often = half.groupBy("i", "h").agg(F.count("*").alias("c")).where("c > 1").select("i", "h")
        return half.join(often, ["i", "h"], "left_semi").groupBy("rep").agg(F.collect_list(F.struct("i", "h")).alias(f"keys_{side}"))

    # Only half keys that some other class shares can meet in a table.
    tables = (
        shared("a").join(shared("b"), "rep")
        .select("rep", F.explode("keys_a").alias("x"), "keys_b").select("rep", "x", F.explode("keys_b").alias("y"))
        .select("rep", F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("key"), (F.col("x.i") == F.col("y.i")).alias("diagonal"))
    )
    sizes = tables.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("low")).where("c > 1")
    tables = written(tables.join(sizes, "key").select("key", "rep", "low", "diagonal"), "tables")
    wanted = tables.select(F.col("rep").alias("id")).distinct()
    # The full sets of classes that share a bucket.
    sets = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(wanted, "id", "left_semi")
    sets = sets.withColumn("set", shingle_sets(shingle)(F.col("t"))).select("id", F.size("set").cast("bigint").alias("n"), "set").where("n > 0")
    sets = written(sets, "sets")

    stars = tables.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    found = components(written(_verified(stars, sets, percent), "verified"))
    # A second star a bucket of the diagonal tables, around another class, for groups whose smallest class is off centre.
    mixed = _mixed(tables.where("diagonal"), found)
    leaders = mixed.groupBy("key").agg(F.min_by(F.struct("rep", "comp"), F.xxhash64("rep")).alias("l"))
    more = mixed.join(leaders, "key").where("comp <> l.comp").select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct()
    found = _merged(found, written(_verified(more, sets, percent), "verified"))
    apart = _mixed(tables, found).select(F.col("rep").alias("id"), "comp").distinct()
    close = _close_pairs(sets.join(apart, "id"), percent)
    found = _merged(found, written(_verified(close, sets, percent), "verified"))
    return _labelled(signed, classes, found)


def _mixed(tables: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, rep, comp) of the buckets that hold more than one component."""
    placed = tables.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return written(placed.join(several, "key", "left_semi"), "mixed")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links: these join whole components, so only their names are linked anew."""
    if links.isEmpty():
        return found
    name = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"name_{end}"))
    named = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("name_a", "a").alias("a"), F.coalesce("name_b", "b").alias("b"))
    joined = components(named)
    old = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(old.union(joined.join(old.select("node"), "node", "left_anti").select("node", "component")), "components")


def _close_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can be similar enough, from the rare ends of their sets.

    With shingles ordered by frequency, rarest first, two sets x and y that are similar enough, x no smaller, share one of
    the first ``n - ceil(t n) + 1`` of x and the first ``n - ceil(2 t n / (1 + t)) + 1`` of y: y is looked up by the shorter
    end only.  Texts on one template that are too far apart have the template's shingles behind that end, so a hot
    shingle joins no two of them, and the larger side of a join has no more rows a shingle than sets that may be linked.
    From the first common shingle on enough must be left in both.
    """
    rows = sets.select("id", "n", "comp", F.explode("set").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(often, "h").groupBy("id", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    alone = F.col("n") - F.size("t")  # shingles of this set only come first and match nothing
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    heads = ranked.where(first > 0).select("id", "n", "comp", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), first.cast("int"))).alias("i", "t"))
    place = F.col("alone") + F.col("i")
    short = place < F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    heads = heads.select("id", "n", "comp", (F.col("n") - place).alias("left"), F.col("t.h").alias("h"), short.alias("short"))
    several = heads.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("h")
    heads = written(heads.join(several, "h", "left_semi"), "heads")
    p, q = heads.alias("p"), heads.where("short").alias("q")
    near = (F.col("p.h") == F.col("q.h")) & (F.col("p.comp") != F.col("q.comp")) & (F.struct("p.n", "p.id") > F.struct("q.n", "q.id")) & (
        F.least("p.left", "q.left") * (100 + percent) >= (F.col("p.n") + F.col("q.n")) * percent
    )
    return p.join(q, near).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def _labelled(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    return (
        signed.join(named, ["d1", "d2", "n"], "left")
        .select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents without their near copies: of each component the smallest id stays; of repeated ids all rows with its text."""
    found, gone = near_duplicates(docs, id_col, text_col, **options), free_name(docs, "gone")
    dropped = found.groupBy(F.col("id").alias(gone)).agg(F.bool_or(F.col("id") == F.col("component")).alias("stays")).where("NOT stays").select(gone)
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")
