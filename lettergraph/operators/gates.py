"""Derived tables that are recomputed where their inputs changed, and nowhere else.

A set of rows is known by an order-free fingerprint: their number and the sums of two 64-bit
hashes, exact as decimals.  It adds up from partial sums, grows and shrinks as rows come and
leave, and a row that is there twice counts twice.

A stage's part (a month, say) is digested from the stage's version, the settings it reads and
the fingerprints of its input parts.  Where that digest stands in the last version the part
stays as it is; the others are computed together and written aside, and one commit shows all.
As inputs are known by their rows, a stage whose result comes out the same stops the chain.
Earlier versions are the backup, until ``Versions.expire`` drops them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettergraph.versions import Versions

_SALTS = {"a": 1, "b": 2}


def set_sums(*columns: str) -> list[Column]:
    """Aggregates n, a and b of a set of rows, told apart by ``columns``; those of disjoint sets add up.

    A hash passes over nulls, so where they stand is hashed along; nulls inside arrays are not told apart.
    """
    columns = [F.col(c) for c in columns] + [F.isnull(c) for c in columns]
    return [F.count("*").cast("decimal(38)").alias("n"), *[F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(20)")).cast("decimal(38)").alias(k) for k, salt in _SALTS.items()]]


def fingerprint() -> Column:
    """One value of a set from its sums n, a and b."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(k), F.lit(0)).cast("string") for k in ("n", *_SALTS)]).cast("binary"), 256)


def changed_sums(before: DataFrame, come: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of sets by key after rows came and left, from the sums of these alone; sets without rows are left out."""
    signed = lambda df, sign: df.select(*keys, *[(F.col(k) * sign).cast("decimal(38)").alias(k) for k in ("n", *_SALTS)])
    both = signed(before, 1).union(signed(come, 1)).union(signed(gone, -1))
    return both.groupBy(*keys).agg(*[F.sum(k).cast("decimal(38)").alias(k) for k in ("n", *_SALTS)]).where("n <> 0")


def set_fingerprints(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, fingerprint): cached results of a set are kept under it."""
    return rows.groupBy(*keys).agg(*set_sums(*columns)).select(*keys, fingerprint().alias("fingerprint"))


def same_rows(one: DataFrame, other: DataFrame) -> bool:
    """Have two tables of the same columns the same rows, each as often?  Both directions by one aggregation."""
    both = one.withColumn("_side", F.lit(1)).unionByName(other.withColumn("_side", F.lit(-1)))
    return both.groupBy(*one.columns).agg(F.sum("_side").alias("_more")).where("_more <> 0").isEmpty()


@dataclass(frozen=True)
class Stage:
    """A derived table.  ``compute`` gets its inputs by name, all parts together with their column ``part``, and the settings.

    A ``whole`` stage looks over the parts and has one of its own; the others give rows of the parts they are given.
    """

    name: str
    compute: Callable[[dict[str, DataFrame], Mapping], DataFrame]
    inputs: tuple[str, ...] = ("source",)
    settings: tuple[str, ...] = ()
    version: str = "1"
    whole: bool = False


class Gates:
    """Stages over a source whose rows have a text column ``part``."""

    def __init__(self, versions: Versions, stages: Iterable[Stage]):
        self.versions, self.stages = versions, list(stages)

    def _prints(self, df: DataFrame) -> dict[str, str]:
        rest = [c for c in df.columns if c != "part"]
        return {r.part: r.fingerprint for r in set_fingerprints(df, ["part"], rest).collect()}  # a row a part

    def read(self, stage: str, parts: Iterable[str] | None = None) -> DataFrame:
        """A stage's rows with their part, in the version that stands."""
        return self._read(self.versions.at().tables, stage, parts)

    def _read(self, tables: Mapping[str, dict], stage: str, parts: Iterable[str] | None = None) -> DataFrame:
        names = [n for n in tables if n.startswith(f"{stage}@") and (parts is None or n.split("@", 1)[1] in set(parts))]
        every = []
        for entry in {tables[n]["schema"]: [tables[k] for k in names if tables[k]["schema"] == tables[n]["schema"]] for n in names}.values():
            schema = T.StructType.fromJson(json.loads(entry[0]["schema"]))
            paths = [f"{self.versions.root}/{p}" for e in entry for p in e["paths"]]
            # The part is the last folder's name.
            part = F.regexp_extract("_metadata.file_path", "/part=([^/]*)/[^/]*$", 1).alias("part")
            every.append(self.versions.spark.read.schema(schema).parquet(*paths).select("*", part))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)

    def refresh(self, source: DataFrame, settings: Mapping) -> list[tuple[str, str]]:
        """Bring all stages up to date; the (stage, part) pairs that were computed."""
        base = self.versions.at()
        tables = {n: e for n, e in base.tables.items()}
        prints = {"source": self._prints(source)}
        facts, ran = {}, []
        for stage in self.stages:
            used = json.dumps([stage.name, stage.version, {k: settings[k] for k in sorted(stage.settings)}], sort_keys=True, default=str)
            known = [prints[i] for i in stage.inputs]
            parts = ["all"] if stage.whole else sorted({p for k in known for p in k})
            digest = {p: hashlib.sha256(json.dumps([used, [sorted(k.items()) if stage.whole else k.get(p) for k in known]]).encode()).hexdigest() for p in parts}
            due = [p for p in parts if base.facts.get(f"digest {stage.name}@{p}") != digest[p]]
            for name in [n for n in tables if n.startswith(f"{stage.name}@") and n.split("@", 1)[1] not in parts]:
                del tables[name]  # parts that the inputs no longer have
            if due:
                given = {i: source if i == "source" else self._read(tables, i, None if stage.whole else due) for i in stage.inputs}
                if not stage.whole:
                    given = {i: df.where(F.col("part").isin(due)) for i, df in given.items()}
                result = stage.compute(given, settings)
                result = result.withColumn("part", F.lit("all")) if stage.whole else result
                put = self.versions.put(result, stage.name, ("part",))
                schema = T.StructType([f for f in result.schema if f.name != "part"]).json()
                made = set(self.versions.listed(put["paths"][0]))
                for p in due:
                    tables[f"{stage.name}@{p}"] = {"schema": schema, "paths": [f"{put['paths'][0]}/part={p}"] if f"part={p}" in made else []}
                ran += [(stage.name, p) for p in due]
            old = {p: base.facts[k] for p in parts if p not in due and (k := f"print {stage.name}@{p}") in base.facts}
            filled = [p for p in due if tables[f"{stage.name}@{p}"]["paths"]]
            prints[stage.name] = {**old, **(self._prints(self._read(tables, stage.name, filled)) if filled else {})}
            facts |= {f"digest {stage.name}@{p}": d for p, d in digest.items()} | {f"print {stage.name}@{p}": v for p, v in prints[stage.name].items()}
        if ran or set(tables) != set(base.tables):
            self.versions.commit(base, tables, facts, only=True)
        return ran
